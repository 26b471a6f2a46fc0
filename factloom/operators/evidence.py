"""Post-solve evidence: judgements of paths and flows, countability, refinements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEGATIVE = ("Refuted-Strong", "Refuted-Weak")


def path_judgements(evidence: DataFrame) -> DataFrame:
    """(path, flow, kind, reason) by priority; evidence: (flow, path, ord, polarity,
    strength, scope, holds, reason).  A strong negative about the path whose
    preconditions hold refutes strongly, any scoped negative weakly, any positive
    confirms; the first reason of the deciding rank is given."""
    e = F.col
    rank = (
        F.when((e("polarity") == "negative") & (e("strength") == "strong") & (e("scope") == "path") & e("holds"), 1)
        .when((e("polarity") == "negative") & e("scope").isin("path", "sink", "source"), 2)
        .when(e("polarity") == "positive", 3)
        .otherwise(4)
    )
    best = evidence.withColumn("rank", rank).groupBy("flow", "path").agg(F.min(F.struct("rank", "ord", "reason")).alias("b"))
    kind = F.element_at(F.lit(["Refuted-Strong", "Refuted-Weak", "Confirmed", "Unresolved"]), F.col("b.rank"))
    return best.select("flow", "path", kind.alias("kind"), F.when(F.col("b.rank") < 4, F.col("b.reason")).alias("reason"))


def downgrade(judged: DataFrame, incomplete: str = "incomplete") -> DataFrame:
    """Refutations of incomplete paths are undecided."""
    open_ = F.col(incomplete) & F.col("kind").isin(*NEGATIVE)
    return judged.withColumn("reason", F.when(open_, "path_incomplete").otherwise(F.col("reason"))).withColumn("kind", F.when(open_, "Unresolved").otherwise(F.col("kind")))


def flow_judgements(paths: DataFrame) -> DataFrame:
    """(flow, kind, reason) of path judgements (flow, path, kind, incomplete)."""
    refuted, k = F.col("kind").isin(*NEGATIVE), F.col("kind")
    g = paths.groupBy("flow").agg(F.bool_and(k == "Refuted-Strong").alias("strong"), F.bool_and(refuted).alias("all_refuted"), F.bool_or(refuted).alias("any_refuted"), F.bool_or(k == "Confirmed").alias("confirmed"), F.bool_or("incomplete").alias("open"))
    row = lambda kind, reason: F.struct(F.lit(kind).alias("kind"), F.lit(reason).alias("reason"))
    out = (
        F.when(F.col("all_refuted") & F.col("open"), row("Unresolved", "materialization_incomplete"))
        .when(F.col("strong"), row("Refuted-Strong", "all_paths_refuted_strong"))
        .when(F.col("all_refuted"), row("Refuted-Weak", "all_paths_refuted"))
        .when(F.col("confirmed") & ~F.col("any_refuted"), row("Confirmed", "path_confirmed"))
        .when(F.col("any_refuted"), row("Unresolved", "not_all_paths_refuted"))
        .otherwise(row("Unresolved", "no_decisive_evidence"))
    )
    return g.select("flow", out.alias("o")).select("flow", "o.kind", "o.reason")


def path_countability(kind: Column, truncated: Column, cycle: Column) -> Column:
    return F.when(truncated, "truncated").when(cycle, "cycle_blocked").when(kind == "Confirmed", "confirmed").when(kind.isin(*NEGATIVE), "refuted").otherwise("near_hit_unresolved")


def flow_countability(flows: DataFrame, paths: DataFrame) -> DataFrame:
    """(flow, status) of flows (flow, kind) with path rows (flow, status)."""
    s = F.col("status")
    g = paths.groupBy("flow").agg(F.count("*").alias("n"), F.bool_or(s == "confirmed").alias("c"), F.bool_or(s == "truncated").alias("t"), F.bool_or(s == "cycle_blocked").alias("y"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    out = (
        F.when((F.col("kind") == "Confirmed") & yes("c"), "confirmed").when(yes("t"), "truncated").when(yes("y"), "cycle_blocked")
        .when(F.col("n").isNull(), "out_of_scope").when(F.col("kind").isin(*NEGATIVE), "refuted").otherwise("near_hit_unresolved")
    )
    return flows.join(g, "flow", "left").select("flow", out.alias("status"))


def flattened(evidence: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each evidence key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return evidence.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def guard_conflicts(steps: DataFrame) -> DataFrame:
    """First contradiction of literal guards on a path; steps: (path, idx, var, op, literal)
    with op in eq, neq, assign.  An assignment of the variable starts an epoch anew."""
    per_var = Window.partitionBy("path", "var").orderBy("idx")
    epochs = steps.withColumn("epoch", F.sum((F.col("op") == "assign").cast("int")).over(per_var.rowsBetween(Window.unboundedPreceding, 0)))
    before = Window.partitionBy("path", "var", "epoch").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    same = lambda op: F.when(F.col("op") == op, F.col("literal"))
    seen = epochs.withColumns({"eqs": F.collect_set(same("eq")).over(before), "neqs": F.collect_set(same("neq")).over(before)})
    other = F.exists("eqs", lambda x: x != F.col("literal"))
    bad = ((F.col("op") == "eq") & (other | F.array_contains("neqs", F.col("literal")))) | ((F.col("op") == "neq") & F.array_contains("eqs", F.col("literal")))
    return seen.where(bad).groupBy("path").agg(F.min(F.struct("idx", "var", "literal")).alias("f")).select("path", "f.idx", "f.var", "f.literal")


def dead_type_branches(steps: DataFrame) -> DataFrame:
    """Paths on which a variable's allowed type tags (array ``tags`` at ``idx``) shrink to none."""
    g = steps.groupBy("path", "var").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "tags"))), lambda s: s["tags"]).alias("all"))
    left = F.aggregate(F.slice("all", F.lit(2), F.greatest(F.size("all") - 1, F.lit(0))), F.col("all")[0], lambda acc, t: F.array_intersect(acc, t))
    return g.where(F.size(left) == 0).select("path", "var")


def reassigned_between(spans: DataFrame, assigns: DataFrame) -> DataFrame:
    """Spans (id, method, name, lo, hi) in which the name is assigned strictly in
    between: an as-of look at the next assignment after lo, not a range join."""
    marks = assigns.select("method", "name", F.col("idx").alias("at"), F.col("idx").alias("assigned"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("hi"), F.lit(1).alias("side"))
    points = marks.union(spans.select("method", "name", F.col("lo").alias("at"), F.lit(None).cast("long"), "id", "hi", F.lit(2)))
    after = Window.partitionBy("method", "name").orderBy(F.desc("at"), F.desc("side")).rowsBetween(Window.unboundedPreceding, -1)
    nxt = points.withColumn("next", F.min("assigned").over(after))
    return nxt.where(F.col("id").isNotNull()).select("id", F.coalesce(F.col("next") < F.col("hi"), F.lit(False)).alias("reassigned"))


def sanitizer_evidence(path_steps: DataFrame, calls: DataFrame, rules: DataFrame) -> DataFrame:
    """Paths on which a rule's sanitizing call defines the sink's value last: (path, api, idx).

    path_steps: (path, method, name, sink_idx); calls: (method, name, idx, api) assigns;
    rules: (api).  The latest assignment before the sink decides."""
    none = lambda of, c: F.lit(None).cast(of.schema[c].dataType)
    one = calls.groupBy("method", "name", "idx").agg(F.min("api").alias("api"))
    marks = one.where("method is not null and name is not null and idx is not null").select("method", "name", F.col("idx").alias("at"), F.lit(1).alias("side"), F.struct("idx", "api").alias("last"), none(path_steps, "path").alias("path"))
    asks = path_steps.select("method", "name", F.col("sink_idx").alias("at"), F.lit(0).alias("side"), none(marks, "last").alias("last"), "path")
    # a running look back for each variable: a sink meets one assignment, not all before it
    w = Window.partitionBy("method", "name").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, -1)
    seen = asks.unionByName(marks).withColumn("last", F.last("last", ignorenulls=True).over(w)).where("side = 0 and last is not null").select("path", "last.*")
    # a path of several steps: the latest of theirs
    last = seen.groupBy("path").agg(F.max(F.struct("idx", F.col("api"))).alias("last")).select("path", "last.api", "last.idx")
    return last.join(rules, "api", "left_semi").select("path", "api", "idx")


def parameterized(sinks: DataFrame) -> DataFrame:
    """Sinks (id, arg, arg0_kind, arg0) whose tainted argument is bound, not part of the static text."""
    return sinks.where((F.col("arg") >= 1) & (F.col("arg0_kind") == "constant") & F.lower("arg0").rlike(r"^\s*(select|insert|update|delete)\b")).select("id")


def storage_flags(sources: DataFrame) -> DataFrame:
    """Sources (id, key, default) that read a flag: a boolean default, a flag-like key, nothing sensitive."""
    flag, secret = r"^(is|has|enable|show|use|flag)|(enabled|flag|switch)$", r"password|token|secret|account|phone"
    k = F.lower("key")
    return sources.where(F.lower(F.trim("default")).isin("true", "false", "0", "1") & k.rlike(flag) & ~k.rlike(secret)).select("id")


def currentness_evidence(certificates: DataFrame) -> DataFrame:
    """(flow, path, ...) evidence rows from verdicts: dead is negative, live positive, the rest open."""
    v = F.col("verdict")
    polarity = F.when(v.isin("dead", "blocked-mismatch"), "negative").when(v == "live", "positive").otherwise("neutral")
    strength = F.when(v.isin("dead", "live"), "strong").otherwise("weak")
    return certificates.select(F.col("consumer").alias("flow"), F.col("producer").alias("path"), F.lit(1).alias("ord"), polarity.alias("polarity"), strength.alias("strength"), F.lit("path").alias("scope"), F.lit(True).alias("holds"), "reason")
