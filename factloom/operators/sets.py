"""Set operations over fact tables, layers and pack states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prefixed(df: DataFrame, prefix: str, *ids: str) -> DataFrame:
    return df.withColumns({c: F.concat(F.lit(f"{prefix}:"), F.col(c)) for c in ids})


def merged_graphs(parts: list[tuple[str, DataFrame]], *ids: str) -> DataFrame:
    """Graphs under prefixed ids, one after the other; nothing is dropped."""
    out = None
    for prefix, df in parts:
        one = prefixed(df, prefix, *ids)
        out = one if out is None else out.unionByName(one)
    return out


def appended(base: DataFrame, fragments: list[tuple[str, DataFrame]], *ids: str) -> DataFrame:
    """The base's ids stay; fragments are prefixed."""
    return base.unionByName(merged_graphs(fragments, *ids)) if fragments else base


def difference(a: DataFrame, b: DataFrame, key: str | list[str]) -> DataFrame:
    return a.join(b, key, "left_anti")


def first_by(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a total order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def layered(layers: list[DataFrame], key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of several layers by key, later layers first, and how many each layer gave and lost."""
    all_ = None
    for i, df in enumerate(layers):
        one = df.withColumn("layer", F.lit(i))
        all_ = one if all_ is None else all_.unionByName(one)
    w = Window.partitionBy(key).orderBy(F.desc("layer"))
    ranked = all_.withColumn("__n", F.row_number().over(w))
    status = ranked.groupBy("layer").agg(F.count("*").alias("given"), F.count_if(F.col("__n") == 1).alias("used"))
    return ranked.where("__n = 1").drop("__n"), status


def enabled(packs: DataFrame, on: DataFrame | None, off: DataFrame | None, key: str) -> DataFrame:
    out = packs if on is None else packs.join(on, key, "left_semi")
    return out if off is None else out.join(off, key, "left_anti")


def planes_and(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def planes_or(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def planes_minus(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_except(a, b))
