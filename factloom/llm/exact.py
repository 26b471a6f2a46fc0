"""Exact dedup with heavy hitters split off.

Texts are told apart by SHA-256.  A Misra-Gries summary of each partition names every
digest that can be frequent; a second pass counts those exactly and finds the row that
stays, and only what is frequent indeed (the verified winners) is broadcast, so that rows
of hot groups are resolved where they lie.  All other groups are small by then and meet
by one ordinary shuffle of (digest, id).  Texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow, written

SHARE, GROUP, MOST = 1 / 256, 1_000_000, 32_768


def reduced(held: pa.Table, counters: int) -> pa.Table:
    """One Misra-Gries step over (d, n): sums by digest, less the (counters + 1)-th largest
    sum; those left above zero are at most ``counters``."""
    held = held.group_by("d").aggregate([("n", "sum")]).rename_columns(["d", "n"])
    if held.num_rows <= counters:
        return held
    n = held.column("n").to_numpy()
    less = np.partition(n, len(n) - counters - 1)[len(n) - counters - 1]
    above = n > less
    return pa.table({"d": held.column("d").filter(pa.array(above)).combine_chunks(), "n": pa.array(n[above] - less, pa.int64())})


def frequent(rows: DataFrame, column: str, total: int, share: float) -> DataFrame:
    """(``column``, n): every value that at least ``share`` of ``total`` rows hold is among
    them, and at most 2 / share values are.

    A summary of c counters undercounts a value by at most rows / (c + 1), also summed over
    partitions; with c + 1 = 2 / share a frequent value keeps half of its count at least."""
    counters = int(np.ceil(2 / share)) - 1

    def run(batches):
        held = pa.table({"d": pa.array([], pa.binary()), "n": pa.array([], pa.int64())})
        for batch in batches:
            new = pa.table({"d": batch.column(0), "n": pa.array(np.ones(batch.num_rows, np.int64))})
            held = reduced(pa.concat_tables([held, new]), counters)
        yield from held.to_batches()

    summed = arrow(rows.where(F.col(column).isNotNull()).select(F.col(column).alias("d")), run, "d binary, n long").groupBy("d").agg(F.sum("n").alias("n"))
    return summed.where(F.col("n") >= total * share / 2).withColumnRenamed("d", column)


def find_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] | None = None, share: float | None = None) -> DataFrame:
    """One row per input row: (id, keep_id, group_size, kept, sha256).

    Texts are equal if they are after ``normalise`` (none: as they are); a null text counts
    as empty.  Of equal texts the row of the largest id stays, a null id being the smallest
    (``keep_id`` is null if all ids of a group are); of rows equal in both, one stays.  Other
    columns are not read, an empty table gives an empty result.

    ``share``: groups of at least this share of all rows are resolved by broadcast.  By
    default 1/256, or less, so that what is left to one task stays below a million rows as
    long as 65,536 counters (a few MB) suffice for that; whatever it is, the result is the same."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(normalise(text) if normalise else text, 256))
    rows = written(docs.select(F.col(id_col).cast("long").alias("id"), digest.alias("digest"), F.monotonically_increasing_id().alias("row")), "exact-digests")
    total = rows.count()
    if share is None:
        share = max(1 / MOST, min(SHARE, GROUP / max(total, 1)))
    last = F.max(F.struct("id", "row"))
    maybe = frequent(rows, "digest", total, share).select("digest")  # at most 2 / share
    counted = rows.join(F.broadcast(maybe), "digest", "left_semi").groupBy("digest").agg(last.alias("last"), F.count("*").alias("group_size"))
    winners = written(counted.where(F.col("group_size") >= total * share), "exact-winners")
    hot = rows.join(F.broadcast(winners), "digest")
    same = Window.partitionBy("digest")
    rest = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    rest = rest.withColumns({"last": last.over(same), "group_size": F.count("*").over(same)})
    found = hot.unionByName(rest)
    return found.select("id", F.col("last.id").alias("keep_id"), F.col("group_size").cast("long").alias("group_size"), (F.col("row") == F.col("last.row")).alias("kept"), F.lower(F.hex("digest")).alias("sha256"))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] | None = None, share: float | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one for each different text."""
    found = find_copies(docs, id_col, text_col, normalise, share)
    marks = written(found.groupBy("id", "sha256").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n")).where("kept").select(F.col("id").alias("__id"), F.col("sha256").alias("__sha"), "n"), "exact-kept")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    sha = F.sha2(normalise(text) if normalise else text, 256)
    own = lambda of: docs.join(marks.where(of), F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (sha == F.col("__sha")), "left_semi")
    if marks.where("n > 1").isEmpty():
        return own("n = 1")
    key = "__sha256"
    return own("n = 1").union(own("n > 1").withColumn(key, sha).dropDuplicates([id_col, key]).drop(key))
