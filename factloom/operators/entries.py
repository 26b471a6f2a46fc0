"""Entries: facts of thirteen kinds, contracts, bridges between entries, why each is
active, and the synthetic root that calls them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fact kinds, and the phase in which an entry of that kind runs first.
FACTS = (
    ("ability_lifecycle", "bootstrap"), ("stage_lifecycle", "bootstrap"), ("extension_lifecycle", "bootstrap"), ("page_build", "composition"), ("page_lifecycle", "composition"),
    ("component_lifecycle", "composition"), ("ui_callback", "interaction"), ("channel_callback", "interaction"), ("scheduler_callback", "interaction"), ("state_watch", "reactive_handoff"),
    ("navigation", "reactive_handoff"), ("ability_handoff", "reactive_handoff"), ("explicit_seed", "bootstrap"),
)


def seeds(assets: DataFrame, methods: DataFrame) -> DataFrame:
    """(method, asset) of entry assets (asset, method) whose methods (method) exist."""
    return assets.select("asset", "method").join(methods, "method", "left_semi").select("method", "asset").distinct()


def facts(methods: DataFrame, scans: dict) -> DataFrame:
    """(method, kind, reason): one row for each kind of scan (a condition on methods) that a
    method meets; kinds that are not in FACTS are an error."""
    known = {k for k, _ in FACTS}
    if lost := sorted(set(scans) - known):
        raise ValueError(f"unknown fact kinds {lost}")
    told = F.array(*[F.when(cond, F.struct(F.lit(kind).alias("kind"), F.concat(F.lit("scan "), F.lit(kind)).alias("reason"))) for kind, cond in scans.items()])
    return methods.select("method", F.inline(F.filter(told, lambda x: x.isNotNull())))


def contracts(found: DataFrame, methods: DataFrame) -> DataFrame:
    """(method, phase, kinds, parameters): one contract for each method with facts, in the
    earliest phase of its kinds; methods: (method, parameters)."""
    spark = found.sparkSession
    order = ("bootstrap", "composition", "interaction", "reactive_handoff", "teardown")
    phases = spark.createDataFrame([(k, order.index(p)) for k, p in FACTS], "kind string, rank int")
    one = found.join(F.broadcast(phases), "kind").groupBy("method").agg(F.min("rank").alias("rank"), F.array_sort(F.collect_set("kind")).alias("kinds"))  # thirteen rows
    return one.join(methods, "method").select("method", F.element_at(F.lit(list(order)), F.col("rank") + 1).alias("phase"), "kinds", "parameters")


def bridges(edges: DataFrame, schedule: DataFrame) -> DataFrame:
    """(src, dst, family, kind): activation edges (src, dst, family) between two entries that
    the schedule (method, round) activates: forward to a later round, else feedback."""
    s = schedule.select(F.col("method").alias("src"), F.col("round").alias("a"))
    d = schedule.select(F.col("method").alias("dst"), F.col("round").alias("b"))
    return edges.join(s, "src").join(d, "dst").where("src <> dst").select("src", "dst", "family", F.when(F.col("a") < F.col("b"), "forward").otherwise("feedback").alias("kind")).distinct()


def explained(schedule: DataFrame, edges: DataFrame) -> DataFrame:
    """(method, round, phase, reasons): for each active entry the edges (family, src, dst)
    from entries of earlier rounds, or that it is a root."""
    before = schedule.select(F.col("method").alias("src"), F.col("round").alias("at"))
    came = edges.join(before, "src").select(F.col("dst").alias("method"), "family", "src", "at")
    j = schedule.join(came, "method", "left").where("at is null or at < round")
    told = F.array_sort(F.collect_set(F.concat_ws("<-", "family", "src")))
    reasons = j.where("at is not null").groupBy("method").agg(told.alias("reasons"))
    return schedule.join(reasons, "method", "left").select("method", "round", "phase", F.coalesce("reasons", F.array(F.when(F.col("round") == 0, "root").otherwise("rule"))).alias("reasons"))


def root_calls(schedule: DataFrame, root: str = "@root") -> DataFrame:
    """(caller, callee, place): calls of a synthetic root to all entries, in the order of
    rounds, phases and names."""
    from .ledgers import placed

    rank = F.array_position(F.lit(["bootstrap", "composition", "interaction", "reactive_handoff", "teardown"]), F.col("phase"))
    order = placed(schedule.select("round", rank.alias("rank"), "method"), ["round", "rank", "method"])
    return order.select(F.lit(root).alias("caller"), F.col("method").alias("callee"), "place")


def lifecycle_main(classes: DataFrame, hooks: list[str], root: str = "@main") -> DataFrame:
    """(caller, stmt, op, target): a synthetic main that makes every class (class) once and
    calls its lifecycle hooks (class, hook) in their fixed order."""
    pos = F.array_position(F.lit(hooks), F.col("hook"))
    new = classes.select("class").distinct().select("class", F.lit(0).cast("long").alias("stmt"), F.lit("new").alias("op"), F.col("class").alias("target"))
    call = classes.where(F.col("hook").isin(*hooks)).select("class", pos.alias("stmt"), F.lit("call").alias("op"), F.concat_ws(".", "class", "hook").alias("target")).distinct()
    return new.union(call).select(F.concat_ws("/", F.lit(root), "class").alias("caller"), "stmt", "op", "target")
