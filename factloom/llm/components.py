"""Connected components of a link table, wholly on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100) -> DataFrame:
    """(node, component) for every node of ``edges``; component is the smallest
    node reachable.

    Alternates two steps until nothing changes: every node's larger neighbours
    are linked to its smallest neighbour, then every node and its smaller
    neighbours are linked to the smallest of them.  Both keep connectivity and
    need one aggregation each; stars of any size are summed as (node, min)
    first, so no neighbour list is ever collected.  Null ends and self links are
    ignored; an empty table gives an empty result.
    """
    links = (
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .where("u is not null and v is not null and u <> v")
        .distinct()
    )
    links = cut(links)
    signature = [F.count("*"), F.sum(F.hash("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))]
    before = links.agg(*signature).first()
    for _ in range(max_rounds):
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # larger neighbours of u hang on u's smallest neighbour
        large = (
            links.select(F.col("v").alias("u"), F.col("u").alias("w"))
            .join(least, "u")
            .select(F.col("w").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
        )
        large = large.distinct()
        # u and its smaller neighbours hang on the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        links = cut(small)
        now = links.agg(*signature).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # settled: every link is (node, component)
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
