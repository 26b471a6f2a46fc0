"""Ordered state effects: currentness verdicts, slices, handoff."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.fixpoint import cut

SLICE_LIMIT = 128


def compatibility(l: Column, r: Column) -> Column:
    """exact, may or no of two cells (structs of kind, owner, key, precision): equal
    keys are exact, other kinds no, imprecise cells may, equal dimensions exact."""
    same = (l["kind"] == r["kind"]) & l["owner"].eqNullSafe(r["owner"]) & l["key"].eqNullSafe(r["key"])
    loose = l["precision"].isin("unknown", "partial") | r["precision"].isin("unknown", "partial")
    return F.when(same & (l["precision"] == r["precision"]), "exact").when(l["kind"] != r["kind"], "no").when(loose, "may").when(same, "exact").otherwise("no")


def with_running(effects: DataFrame) -> DataFrame:
    """Running counts per cell: all effects, invalidators, strong invalidators.

    Differences of them at a load and a store are the counts strictly between the
    two, so no interval join is needed."""
    w = Window.partitionBy("cell").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    hits = F.col("kind").isin("store-clean", "kill")
    strong = hits & (F.col("precision") == "exact") & (F.col("strength") != "weak") & (F.col("confidence") != "unknown")
    last = lambda c, kind: F.max(F.when(c & (F.col("kind") == kind), F.col("seq"))).over(w)
    return effects.withColumns({"n_all": F.count("*").over(w), "n_hits": F.count_if(hits).over(w), "n_strong": F.count_if(strong).over(w), "last_kill": last(strong, "kill"), "last_clean": last(strong, "store-clean")})


def currentness(effects: DataFrame, limit: int = SLICE_LIMIT) -> DataFrame:
    """A verdict for every store before a load of the same cell."""
    ran = with_running(effects)
    s = ran.where("kind = 'store'").select("cell", F.col("id").alias("producer"), F.col("seq").alias("s_seq"), F.col("precision").alias("s_precision"), F.col("confidence").alias("s_confidence"), *[F.col(c).alias(f"s_{c}") for c in ("n_all", "n_hits", "n_strong")])
    d = ran.where("kind = 'load'").select("cell", F.col("id").alias("consumer"), "seq", "precision", "confidence", "n_all", "n_hits", "n_strong", "last_kill")
    pairs = s.join(d, "cell").where("s_seq < seq")
    between = F.col("n_all") - F.col("s_n_all") - 1
    strong = (F.col("n_strong") - F.col("s_n_strong")) > 0
    loose = (F.col("precision") != "exact") | (F.col("s_precision") != "exact")
    row = lambda v, r: F.struct(F.lit(v).alias("verdict"), F.lit(r).alias("reason"))
    out = (
        F.when(between > limit, row("unknown", "slice_incomplete"))
        .when((F.col("confidence") == "unknown") | (F.col("s_confidence") == "unknown"), row("unknown", "unknown_model_confidence"))
        .when(strong & (F.col("precision") == "exact") & (F.col("last_kill") > F.col("s_seq")), row("dead", "strong_kill"))
        .when(strong & (F.col("precision") == "exact"), row("dead", "strong_clean_overwrite"))
        .when((F.col("n_hits") - F.col("s_n_hits") > 0) | loose, row("may-live", "possible_update"))
        .otherwise(row("live", "no_intervening_update"))
    )
    return pairs.select("cell", "producer", "consumer", between.alias("between"), out.alias("v")).select("cell", "producer", "consumer", "between", "v.verdict", "v.reason")


def sink_hits(effects: DataFrame, conservative: bool = True) -> DataFrame:
    """Loads that some producer's label reaches."""
    passing = ["live", "may-live", "unknown"] if conservative else ["live"]
    return currentness(effects).where(F.col("verdict").isin(*passing)).groupBy("cell", "consumer").agg(F.count("*").alias("producers"), F.min("producer").alias("first_producer"))


def latest_store(effects: DataFrame) -> DataFrame:
    """As-of: each load with the latest store, clean or kill before it in its cell."""
    w = Window.partitionBy("cell").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    touch = F.when(F.col("kind").isin("store", "store-clean", "kill"), F.struct("seq", "id", "kind"))
    seen = effects.withColumn("before", F.max(touch).over(w)).where("kind = 'load'")
    live = F.when(F.col("before").isNull(), "live").when(F.col("before.kind") == "store", "live").otherwise("dead")
    return seen.select("cell", F.col("id").alias("load_id"), F.col("before.id").alias("store_id"), F.col("before.kind").alias("store_kind"), live.alias("state"))


def effect_slices(effects: DataFrame, limit: int = SLICE_LIMIT) -> DataFrame:
    """(producer, consumer, held, truncated, first_mid): per store and load of a cell with
    an invalidator strictly between, how many a slice of ``limit`` holds, whether there
    are more, and the first one.  Counts are differences of running ones, the first is
    the next one behind the store; no interval is joined."""
    hit = F.col("kind").isin("kill", "store-clean")
    w = Window.partitionBy("cell")
    ran = effects.withColumns({"n": F.count_if(hit).over(w.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)), "next": F.last(F.when(hit, F.col("id")), ignorenulls=True).over(w.orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1))})
    s = ran.where("kind = 'store'").select("cell", F.col("id").alias("producer"), F.col("seq").alias("lo"), F.col("n").alias("before"), F.col("next").alias("first_mid"))
    d = ran.where("kind = 'load'").select("cell", F.col("id").alias("consumer"), F.col("seq").alias("hi"), "n")
    between = (F.col("n") - F.col("before")).cast("long")
    pairs = s.join(d, "cell").where("lo < hi and n > before")
    return pairs.select("producer", "consumer", F.least(between, F.lit(limit).cast("long")).alias("held"), (between > limit).alias("truncated"), "first_mid")


# ---------------------------------------------------------------- handoff


def handoff_pairs(puts: DataFrame, gets: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Puts with gets of the same handle key (key, id, seq, scope), or one link away
    in either direction; a get definitely before its put in the same scope drops out."""
    p = puts.select(F.col("key").alias("put_key"), F.col("id").alias("put_id"), F.col("seq").alias("put_seq"), F.col("scope").alias("put_scope"))
    g = gets.select(F.col("key").alias("get_key"), F.col("id").alias("get_id"), F.col("seq").alias("get_seq"), F.col("scope").alias("get_scope"))
    both = p.join(g, F.col("put_key") == F.col("get_key"))
    if links is not None:
        ways = links.select("a", "b").union(links.select("b", "a")).distinct()
        both = both.union(p.join(ways, F.col("put_key") == F.col("a")).join(g, F.col("b") == F.col("get_key")).select(*both.columns))
    reverse = F.col("put_scope").eqNullSafe(F.col("get_scope")) & (F.col("get_seq") < F.col("put_seq"))
    return both.where(~F.coalesce(reverse, F.lit(False))).select("put_id", "get_id", "put_seq", "get_seq", "put_scope", "get_scope", "put_key", "get_key").distinct()


def kills_between(pairs: DataFrame, kills: DataFrame) -> DataFrame:
    """Number of kills of the put's key between put and get, where orders compare
    (equal scope): a range count by running sums, not a range join."""
    pairs = cut(pairs)
    marks = kills.select(F.col("key").alias("k"), F.col("scope").alias("sc"), F.col("seq").alias("at"), F.lit(1).alias("one"), F.lit(None).cast("long").alias("put_id"), F.lit(None).cast("long").alias("get_id"), F.lit(0).alias("side"))
    same = pairs.where("put_scope <=> get_scope")
    ends = lambda col, side: same.select(F.col("put_key").alias("k"), F.col("put_scope").alias("sc"), F.col(col).alias("at"), F.lit(0).alias("one"), "put_id", "get_id", F.lit(side).alias("side"))
    points = marks.union(ends("put_seq", 1)).union(ends("get_seq", -1))
    ran = points.withColumn("ran", F.sum("one").over(Window.partitionBy("k", "sc").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)))
    count = ran.where("put_id is not null").groupBy("put_id", "get_id").agg((F.max(F.when(F.col("side") == -1, F.col("ran"))) - F.max(F.when(F.col("side") == 1, F.col("ran")))).alias("kills"))
    return pairs.join(count, ["put_id", "get_id"], "left").withColumn("kills", F.coalesce("kills", F.lit(0)))


def kill_then_put(calls: DataFrame) -> DataFrame:
    """A strong kill and then a strong put for each call (id, stmt, key): orders 2n and 2n + 1."""
    kinds = F.posexplode(F.array(F.lit("kill"), F.lit("put"))).alias("pos", "effect")
    return calls.select("id", "key", "stmt", kinds).select("id", "key", "effect", (F.col("stmt") * 2 + F.col("pos")).alias("seq"), F.lit("strong").alias("strength"))


def validate(effects: DataFrame) -> DataFrame:
    """Rows that break a rule: no cell, an unknown kind, a missing order, or a strong
    update of an imprecise cell."""
    kinds = ["source", "copy", "store", "store-clean", "load", "kill", "sanitize", "link", "unlink", "noop"]
    problem = (
        F.when(F.col("cell").isNull(), "missing cell")
        .when(~F.col("kind").isin(*kinds), "unknown kind")
        .when(F.col("seq").isNull(), "missing order")
        .when((F.col("strength") == "strong") & (F.col("precision") != "exact") & F.col("kind").isin("kill", "store-clean"), "strong update of an imprecise cell")
    )
    return effects.select("id", problem.alias("problem")).where("problem is not null")
