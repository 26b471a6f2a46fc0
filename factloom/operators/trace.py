"""Trace graphs: summary, waypoint queries, explanations, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REPAIR_HINTS = {
    "preanalysis": "Look at the observed surfaces first.",
    "coverage_ledger": "Account for identity, role, endpoint and guard in the ledger.",
    "semanticflow": "Look at what was asked of the model, and what it had to see.",
    "semanticflow_llm": "Read the raw answer and how it was parsed.",
    "asset_validation": "Mend the asset until its schema holds.",
    "asset_promotion": "Review or replay the asset, so that it may be promoted.",
    "asset_lowering": "Check that every binding of the asset names a known template.",
    "module_lowering": "Check that the module's kind has a lowering.",
    "module": "Check the module's sites and keys.",
    "entry_recovery": "Check that the entry's method is found and scheduled.",
    "source_seed": "Match the source by its api and endpoint.",
    "rule": "Match the rule by endpoint, guard and role.",
    "ordinary": "Add the propagation of the missing statement form.",
    "OCLFS": "Check the ordered effects and their verdicts.",
    "UDE": "Check the edges of deferred execution.",
    "provenance": "Raise the path budgets, or look for a cycle.",
    "sink_candidate": "Check why the candidate was not counted as a sink.",
    "sink": "Match the sink by its endpoint.",
    "postsolve": "Check the scope of the evidence.",
    "reporting": "Check the report's filters and limits.",
}
DEFAULT_HINT = "Look at the first layer that the graph blames."
# fixed values
CAUSES = {"ordinary": "ordinary.overbroad_propagation", "sink": "sink.overbroad_or_missing_sink_match", "postsolve": "postsolve.scoped_decision_gap"}


def looked_up(key: Column, table: dict[str, str], default: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(pairs[key], default)


def repair_hint(stage: Column) -> Column:
    return looked_up(stage, REPAIR_HINTS, F.lit(DEFAULT_HINT))


def illegal_cause(stage: Column) -> Column:
    return looked_up(stage, CAUSES, F.concat(stage, F.lit(".gap")))


def waypoint(label: str | None = None, method: str | None = None, value: str | None = None, fact: str | None = None) -> Column:
    """All parts given must hold: equal id, and text contained."""
    out = F.lit(True)
    for column, part in (("label", label), ("method", method), ("value", value)):
        if part is not None:
            out = out & F.coalesce(F.col(column).contains(part), F.lit(False))
    return out if fact is None else out & (F.col("id") == fact)


def summary(facts: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: facts, labels, edges by status and the ascending stages."""
    f = facts.agg(F.count("*").alias("facts"), F.countDistinct("label").alias("labels"))
    s = F.col("status")
    e = edges.agg(F.count("*").alias("edges"), F.count_if(s == "emitted").alias("emitted"), F.count_if(s.isin("blocked", "failed")).alias("blocked"), F.count_if(s == "skipped").alias("skipped"), F.array_join(F.array_sort(F.collect_set("stage")), ",").alias("stages"))
    return f.crossJoin(e)  # one row each


def queried(facts: DataFrame, edges: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, verdict, fact, label) of should-report queries.

    queries: (query, source_label, source_method, sink_label).  Sources with an
    incoming emitted edge give way to those without.  No source: missing-source;
    more than one: source-ambiguous; then a fact of the sink's label under the
    source's method must be there, else missing-sink."""
    q = queries.select("query", "source_label", "source_method", "sink_label")
    entered = edges.where("status = 'emitted'").select(F.col("to_fact").alias("id")).distinct().withColumn("entered", F.lit(True))
    at = facts.join(entered, "id", "left")
    hits = q.join(at, (F.col("label") == F.col("source_label")) & (F.col("method") == F.col("source_method")), "left")
    per = hits.groupBy("query").agg(F.count("id").alias("n"), F.count_if(F.col("id").isNotNull() & F.col("entered").isNull()).alias("fresh"), F.min(F.when(F.col("entered").isNull(), F.col("id"))).alias("a"), F.min("id").alias("b"))
    one = per.select("query", F.when(F.col("fresh") > 0, F.col("fresh")).otherwise(F.col("n")).alias("n"), F.coalesce("a", "b").alias("source"))
    sinks = q.join(facts.select("label", "method", "id"), (F.col("label") == F.col("sink_label")) & (F.col("method") == F.col("source_method"))).groupBy("query").agg(F.min("id").alias("sink"))
    verdict = F.when(F.col("n") == 0, "missing-source").when(F.col("n") > 1, "source-ambiguous").when(F.col("sink").isNull(), "missing-sink").otherwise("reached")
    return q.select("query").join(one, "query").join(sinks, "query", "left").select("query", verdict.alias("verdict"), F.when(F.col("n") == 1, F.col("source")).alias("source"), F.when((F.col("n") == 1), F.col("sink")).alias("sink"))


def forbidden(facts: DataFrame, edges: DataFrame, queries: DataFrame) -> DataFrame:
    """should-not-report: the first forbidden fact (query, label, method), and the emitted edge into it."""
    hit = queries.join(facts, ["label", "method"]).groupBy("query").agg(F.min("id").alias("fact"))
    into = edges.where("status = 'emitted'").groupBy(F.col("to_fact").alias("fact")).agg(F.min(F.struct("id", "stage")).alias("edge"))
    all_ = queries.select("query").distinct().join(hit, "query", "left").join(into, "fact", "left")
    return all_.select("query", F.when(F.col("fact").isNull(), "reached").otherwise("illegal-propagation").alias("verdict"), "fact", F.col("edge.id").alias("edge"), F.when(F.col("fact").isNotNull(), illegal_cause(F.coalesce("edge.stage", F.lit("unknown")))).alias("cause"))


def duplicates(facts: DataFrame, queries: DataFrame) -> DataFrame:
    """duplicate queries (query, label, method): more than one sink fact."""
    n = queries.join(facts, ["label", "method"], "left").groupBy("query").agg(F.count("id").alias("n"))
    return n.select("query", F.when(F.col("n") > 1, "duplicate").when(F.col("n") == 1, "reached").otherwise("missing-sink").alias("verdict"), "n")


def explained(results: DataFrame, coverage: DataFrame, gates: DataFrame) -> DataFrame:
    """Why a missing query misses: an open coverage record comes first, then a blocked
    gate, else unknown; coverage: (query, stage), gates: (query, stage)."""
    first = lambda df, n: df.groupBy("query").agg(F.min("stage").alias(n))
    j = results.where(F.col("verdict").startswith("missing")).join(first(coverage, "by_coverage"), "query", "left").join(first(gates, "by_gate"), "query", "left")
    stage = F.coalesce("by_coverage", "by_gate")
    origin = F.when(F.col("by_coverage").isNotNull(), "coverage").when(F.col("by_gate").isNotNull(), "gate").otherwise("unknown")
    return j.select("query", origin.alias("origin"), stage.alias("stage"), repair_hint(stage).alias("hint"))


def nearby(facts: DataFrame, edges: DataFrame, at: DataFrame, limit: int = 40) -> DataFrame:
    """Edges that touch given facts (id), at most ``limit`` a fact."""
    ends = edges.select("id", F.col("from_fact").alias("fact")).union(edges.select("id", F.col("to_fact").alias("fact"))).distinct()
    w = Window.partitionBy("fact").orderBy("id")
    near = ends.join(at.select(F.col("id").alias("fact")), "fact", "left_semi").withColumn("place", F.row_number().over(w))
    return near.where(F.col("place") <= limit).select("fact", F.col("id").alias("edge"), "place")


def evidence_chain(edges: DataFrame, limit: int = 8) -> DataFrame:
    """Per target fact the first edges into it, written out in order."""
    text = F.concat("stage", F.lit(":"), "status", F.lit(":"), "id")
    w = Window.partitionBy("to_fact").orderBy("id")
    few = edges.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= limit)
    return few.groupBy(F.col("to_fact").alias("fact")).agg(F.array_join(F.array_sort(F.collect_list(text)), " > ").alias("chain"))


def difference(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change): added, removed or changed rows; equal ones are left out."""
    b, a = before.select(key, F.col(value).alias("__b")), after.select(key, F.col(value).alias("__a"))
    j = b.withColumn("__in_b", F.lit(True)).join(a.withColumn("__in_a", F.lit(True)), key, "full_outer")
    change = F.when(F.col("__in_b").isNull(), "added").when(F.col("__in_a").isNull(), "removed").when(~F.col("__a").eqNullSafe(F.col("__b")), "changed")
    return j.select(key, change.alias("change")).where("change is not null")


def verdict_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """closed, regressed, moved or unchanged of query verdicts (query, verdict)."""
    j = before.select("query", F.col("verdict").alias("b")).join(after.select("query", F.col("verdict").alias("a")), "query", "full_outer")
    good = lambda c: F.coalesce(F.col(c) == "reached", F.lit(False))
    out = F.when(good("a") & ~good("b"), "closed").when(good("b") & ~good("a"), "regressed").when(F.col("a").eqNullSafe(F.col("b")), "unchanged").otherwise("moved")
    return j.select("query", out.alias("change"))


def gap_counts(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """One row: open gaps that closed, and those that opened."""
    return before.select(key).exceptAll(after.select(key)).agg(F.count("*").alias("closed")).crossJoin(after.select(key).exceptAll(before.select(key)).agg(F.count("*").alias("opened")))  # one row each


def gate_coverage(gates: DataFrame, facts: DataFrame) -> DataFrame:
    """Coverage records of gates: each attempt with the method of the fact that it would have
    given as its subject, its status and why it did not get through."""
    status = F.when(F.col("emitted"), "emitted").when(~F.col("matched"), "skipped").otherwise("blocked")
    told = gates.where("attempted").join(facts.select(F.col("id").alias("to_fact"), F.col("method").alias("subject")), "to_fact")
    return told.select(F.concat(F.lit("c"), "id").alias("id"), F.lit("coverage_query").alias("kind"), "stage", "subject", status.alias("status"), F.col("id").alias("gate_id"), F.coalesce("skipped_reason", "blocked_reason").alias("reason"))
