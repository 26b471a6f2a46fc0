"""Temperature mixing of sources.

A source's weight is its token share to the power alpha, normalised.  alpha is
bisected until the weights reach a target entropy, or further towards 1 where a
small source would otherwise repeat more often than allowed.  Weights become
token budgets, and budgets whole or partial passes over a permutation of each
source's blocks (sets of documents by a hash of their id).

Per-source totals (a dimension: one row for each source) reach the driver; blocks
and documents do not.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def weights_at(tokens: np.ndarray, alpha: float) -> np.ndarray:
    logs = alpha * np.log(tokens)
    w = np.exp(logs - logs.max())
    return w / w.sum()


def entropy(w: np.ndarray) -> float:
    w = w[w > 0]
    return float(-(w * np.log(w)).sum())


def repetition(tokens: np.ndarray, alpha: float) -> float:
    """Passes over the most repeated source, where each source gets one at least."""
    w = weights_at(tokens, alpha)
    passes = w / tokens
    return float(passes.max() / passes.min())


def temperature(tokens: np.ndarray, evenness: float, most_passes: float, rounds: int = 80) -> float:
    """alpha in [0, 1]: the largest at which entropy reaches ``evenness`` of its
    way from the natural shares' to the even one; larger if passes exceed ``most_passes``."""
    if len(tokens) < 2 or tokens.min() == tokens.max():
        return 1.0
    natural = entropy(weights_at(tokens, 1.0))
    target = natural + evenness * (math.log(len(tokens)) - natural)

    def bisected(enough) -> float:
        low, high = 0.0, 1.0  # enough(low) holds, enough(high) may not
        if enough(high):
            return high
        for _ in range(rounds):
            mid = (low + high) / 2
            low, high = (mid, high) if enough(mid) else (low, mid)
        return low

    alpha = bisected(lambda a: entropy(weights_at(tokens, a)) >= target)
    if repetition(tokens, alpha) > most_passes:
        low, high = alpha, 1.0
        for _ in range(rounds):
            mid = (low + high) / 2
            low, high = (low, mid) if repetition(tokens, mid) <= most_passes else (mid, high)
        alpha = high
    return alpha


def plan_budgets(totals: dict, evenness: float = 0.5, most_passes: float = 2.0, budget: int | None = None) -> dict:
    """source -> (weight, budget in tokens); without ``budget`` the smallest one
    that leaves no source with less than one pass, so that nothing is dropped."""
    named = sorted((s for s in totals if totals[s] > 0), key=lambda s: (s is None, s))
    if not named:
        return {}
    tokens = np.array([totals[s] for s in named], float)
    w = weights_at(tokens, temperature(tokens, evenness, most_passes))
    total = float(budget) if budget is not None else float((tokens / w).max())
    return {s: (float(a), total * float(a)) for s, a in zip(named, w)}


def mix(docs: DataFrame, tokens_col: str, source_col: str = "source", id_col: str = "doc_id", evenness: float = 0.5, most_passes: float = 2.0, budget: int | None = None, block_tokens: int = 16_384, seed: int = 5, sizes: DataFrame | None = None) -> DataFrame:
    """``docs`` with each row repeated as its source's budget asks, and columns
    ``mix_epoch`` (pass, from 0), ``mix_block``, ``mix_weight`` and ``mix_place``
    (0 to 1; ascending order interleaves the sources by their weights).

    A block is in a pass whole or not; the last one is in if half of it fits the
    budget.  A null source is a source of its own.  Rows without tokens (empty
    texts) come once.  Rows of one id share their block, so repeated rows are
    treated alike.  A ``budget`` far beyond the tokens there are is met by as many passes.  An
    empty table gives an empty result.  ``docs`` is read
    twice: give a written table where making it is costly, or ``sizes``, the id, source and
    tokens of the same rows without their texts; then ``tokens_col`` of ``docs`` need only
    tell rows with tokens (above 0) from those without."""
    spark = docs.sparkSession
    reserved = [c for c in docs.columns if c.startswith("mix_")]
    if reserved:
        raise ValueError(f"columns {reserved} would clash")
    sizes = docs if sizes is None else sizes
    n = F.greatest(F.coalesce(F.col(tokens_col), F.lit(0)), F.lit(0)).cast("long")
    totals = {r[0]: r[1] or 0 for r in sizes.groupBy(source_col).agg(F.sum(n)).collect()}  # one row for each source
    plan = plan_budgets(totals, evenness, most_passes, budget)
    rows = [(i, s, w, b, max(1, math.ceil(totals[s] / block_tokens)), float(totals[s])) for i, (s, (w, b)) in enumerate(plan.items())]
    kind = docs.schema[source_col].dataType.simpleString()
    sources = spark.createDataFrame(rows, f"mix_number int, mix_source {kind}, mix_weight double, budget double, blocks int, total double")
    named = lambda rows: rows.join(F.broadcast(sources), F.col(source_col).eqNullSafe(F.col("mix_source")), "left").withColumn("mix_block", F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.coalesce("blocks", F.lit(1))).cast("int"))  # noqa: E731  one row for each source
    known = named(docs)
    # tokens of each block, laid out in the order of each pass: sums of 256 lots of a pass first, then within each
    blocks = named(sizes).where(n > 0).groupBy("mix_number", "mix_block", "budget", "total").agg(F.sum(n).alias("size"))
    passes = F.explode(F.sequence(F.lit(0), F.ceil(F.col("budget") / F.col("total")).cast("int") - 1))
    laid = blocks.withColumn("mix_epoch", passes).withColumn("turn", F.xxhash64("mix_block", "mix_epoch", F.lit(seed))).withColumn("lot", F.shiftright("turn", 56))
    ahead = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    lots = laid.groupBy("mix_number", "mix_epoch", "lot").agg(F.sum("size").alias("size"))
    lots = lots.select("mix_number", "mix_epoch", "lot", F.coalesce(F.sum("size").over(ahead("mix_number", "mix_epoch").orderBy("lot")), F.lit(0)).alias("before"))
    laid = laid.join(lots, ["mix_number", "mix_epoch", "lot"])
    within = F.coalesce(F.sum("size").over(ahead("mix_number", "mix_epoch", "lot").orderBy("turn", "mix_block")), F.lit(0))
    laid = laid.withColumn("start", F.col("before") + within + F.col("mix_epoch") * F.col("total"))
    chosen = laid.where(F.col("start") + F.col("size") / 2 <= F.col("budget") + 0.5)
    chosen = chosen.select(F.col("mix_number").alias("s"), F.col("mix_block").alias("b"), "mix_epoch", F.least(F.col("start") / F.col("budget"), F.lit(1.0)).alias("mix_place"))
    if budget is None:  # what one pass holds is never dropped
        first = laid.where("mix_epoch = 0").select(F.col("mix_number").alias("s"), F.col("mix_block").alias("b"), "mix_epoch", F.least(F.col("start") / F.col("budget"), F.lit(1.0)).alias("mix_place"))
        chosen = chosen.where("mix_epoch > 0").union(first)
    picked = chosen.groupBy("s", "b").agg(F.sort_array(F.collect_list(F.struct("mix_epoch", "mix_place"))).alias("mix_turns"))  # one entry for each pass
    full = known.where(n > 0).join(picked, (F.col("mix_number") == F.col("s")) & (F.col("mix_block") == F.col("b")))
    full = full.select(*docs.columns, "mix_block", "mix_weight", F.explode("mix_turns").alias("mix_turn"))
    full = full.select(*docs.columns, "mix_block", "mix_weight", "mix_turn.mix_epoch", "mix_turn.mix_place")
    bare = known.where(n == 0).select(*docs.columns, "mix_block", F.coalesce("mix_weight", F.lit(0.0)).alias("mix_weight"), F.lit(0).alias("mix_epoch"), F.lit(0.0).alias("mix_place"))
    return full.union(bare)
