"""Provenance: backward closure from sinks, bounded simple paths, their status."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .fixpoint import cut, fixpoint, whole


def backward_dag(derivations: DataFrame, sinks: DataFrame, max_facts: int | None = None, max_rounds: int | None = None) -> DataFrame:
    """(sink, fact, round): facts from which each sink (fact) derives, with their
    distance; derivations: (from_fact, to_fact).  ``max_facts`` keeps the nearest per
    sink and adds ``truncated``, whether that sink had more."""
    seed = sinks.select(F.col("fact").alias("sink"), "fact")
    back = derivations.select(F.col("to_fact").alias("at"), F.col("from_fact").alias("source"))
    found = whole(fixpoint(seed, lambda d, _: d.join(back, F.col("fact") == F.col("at")).select("sink", F.col("source").alias("fact")), ["sink", "fact"], max_rounds))
    if max_facts is not None:
        w = Window.partitionBy("sink").orderBy("round", "fact")
        more = found.groupBy("sink").agg((F.count("*") > max_facts).alias("truncated"))
        found = found.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= max_facts).drop("__n").join(more, "sink")
    return found


def paths(derivations: DataFrame, sinks: DataFrame, max_paths: int = 128, max_depth: int = 128, max_open: int = 100_000) -> DataFrame:
    """(sink, path, status, reasons): simple paths from each sink back to facts
    without predecessor.

    Shortest first, then by their facts; at most ``max_paths`` a sink, ``max_depth``
    facts a path.  A path that is cut is kept as truncated; a repeated fact ends its
    branch (cycle_skipped).  ``max_open`` bounds the open branches of a sink in a round;
    where it does, the sink is truncated for max_open."""
    ways = derivations.select(F.col("to_fact").alias("at"), F.col("from_fact").alias("source")).distinct()
    has_way = ways.select("at").distinct().withColumn("__way", F.lit(True))
    open_ = cut(sinks.select(F.col("fact").alias("sink"), F.array("fact").alias("path")))
    done, skipped, crowded = None, None, None
    for depth in range(max_depth + 1):
        last = F.element_at("path", -1)
        marked = open_.withColumn("last", last).join(has_way.withColumnRenamed("at", "last"), "last", "left")
        ended = marked.where("__way is null").select("sink", "path", F.lit(False).alias("cut"))
        going = marked.where("__way").select("sink", "path", "last")
        if depth + 1 >= max_depth:
            ended = ended.union(going.select("sink", "path", F.lit(True).alias("cut")))
            done = ended if done is None else done.union(ended)
            done = cut(done)
            break
        done = cut(ended if done is None else done.union(ended))
        grown = going.join(ways, F.col("last") == F.col("at"))
        loops = grown.where(F.array_contains("path", F.col("source"))).select("sink").distinct()
        skipped = cut(loops if skipped is None else skipped.union(loops).distinct())
        w = Window.partitionBy("sink").orderBy("path")
        nxt = grown.where(~F.array_contains("path", F.col("source"))).select("sink", F.concat("path", F.array("source")).alias("path"))
        counted = cut(nxt.withColumn("__n", F.row_number().over(w)))
        over = counted.where(F.col("__n") > max_open).select("sink").distinct()
        crowded = over if crowded is None else crowded.union(over).distinct()
        open_ = counted.where(F.col("__n") <= max_open).drop("__n")
        if open_.isEmpty():
            break
    w = Window.partitionBy("sink").orderBy(F.size("path"), "path")
    ranked = done.withColumn("place", F.row_number().over(w))
    totals = ranked.groupBy("sink").agg(F.count("*").alias("n"), F.max("cut").alias("deep"))
    names = sinks.select(F.col("fact").alias("sink")).distinct()
    loops = (skipped if skipped is not None else names.limit(0)).withColumn("loop", F.lit(True))
    full = (crowded if crowded is not None else names.limit(0)).withColumn("full", F.lit(True))
    state = names.join(totals, "sink", "left").join(loops, "sink", "left").join(full, "sink", "left")
    reason = F.filter(F.array(F.when(F.coalesce("n", F.lit(0)) > max_paths, F.lit("max_paths")), F.when(F.coalesce("deep", F.lit(False)), F.lit("max_depth")), F.when(F.coalesce("full", F.lit(False)), F.lit("max_open")), F.when(F.coalesce("loop", F.lit(False)), F.lit("cycle_skipped"))), lambda r: r.isNotNull())
    state = state.select("sink", reason.alias("reasons"), F.coalesce("n", F.lit(0)).alias("found"))
    status = F.when(F.arrays_overlap("reasons", F.array(F.lit("max_paths"), F.lit("max_depth"), F.lit("max_open"))), "truncated").when(F.size("reasons") > 0, "incomplete").otherwise("complete")
    kept = ranked.where(F.col("place") <= max_paths).select("sink", "path", "place", "cut")
    return state.join(kept, "sink", "left").select("sink", "path", "place", "cut", status.alias("status"), F.array_join("reasons", ",").alias("reasons"), "found")
