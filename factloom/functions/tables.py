"""Table functions: one row in, several out, as arrays of structs for ``inline``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def path_prefixes(path: Column) -> Column:
    """(depth, prefix) of all prefixes of a dotted path, shortest first; none for null or empty paths."""
    parts = F.split(path, r"\.", -1)
    some = F.sequence(F.lit(1), F.size(parts))
    each = F.transform(some, lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), ".").alias("prefix")))
    return F.when(F.length(path) > 0, each)
