"""Coverage ledgers and summaries: conditional counts, grouping sets, checks, rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.fixpoint import cut

# fixed values
STATUSES = ("covered-exact-role", "covered-partial", "covered-surface-but-role-missing", "not-covered", "covered-conflict", "identity-unresolved", "ignored-by-policy", "need-more-evidence")
TERMINAL = ("covered-exact-role", "ignored-by-policy")


def summary(ledger: DataFrame) -> DataFrame:
    """One row: the total and counts by status and decision."""
    names = ("exact_covered", "partial_covered", "role_missing", "not_covered", "conflicts", "identity_unresolved", "ignored_by_policy", "need_more_evidence")
    counts = [F.count_if(F.col("coverage_status") == s).alias(n) for s, n in zip(STATUSES, names)]
    return ledger.agg(F.count("*").alias("total"), *counts, F.count_if(F.col("decision") == "send-to-llm").alias("sent"))


def problems(ledger: DataFrame, observed: DataFrame) -> DataFrame:
    """(surface, problem) of a ledger against the observed surfaces (surface)."""
    e = ledger.select("surface", "coverage_status", "decision", "reason")
    s, d = F.col("coverage_status"), F.col("decision")
    rules = [
        (F.trim(F.coalesce("reason", F.lit(""))) == "", "no reason"),
        (d.isNull(), "no decision"),
        ((d == "skip-llm") & ~s.isin(*TERMINAL), "skipped without cover"),
        ((d == "ignore") & (s != "ignored-by-policy"), "ignored without policy"),
        ((d == "send-to-llm") & s.isin(*TERMINAL), "sent though terminal"),
    ]
    own = e.select("surface", F.explode(F.filter(F.array(*[F.when(c, F.lit(t)) for c, t in rules]), lambda x: x.isNotNull())).alias("problem"))
    unknown = e.join(observed, "surface", "left_anti").select("surface", F.lit("unknown surface").alias("problem"))
    double = e.groupBy("surface").count().where("count > 1").select("surface", F.lit("duplicate entry").alias("problem"))
    missing = observed.join(e, "surface", "left_anti").select("surface", F.lit("no entry").alias("problem"))
    return own.union(unknown).union(double).union(missing)


def grouped(df: DataFrame, sets: list[list[str]], *aggs: Column) -> DataFrame:
    """Summaries by several keys at once (GROUPING SETS); keys outside a set are null."""
    keys = sorted({k for s in sets for k in s})
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(k) for k in keys]).agg(F.grouping_id().alias("set_id"), *aggs)


def ranked(df: DataFrame, key: str, amount: str, limit: int) -> DataFrame:
    """Largest positive amounts, ties by key."""
    return df.where(F.col(amount) > 0).orderBy(F.desc(amount), key).limit(limit)


def ranked_within(df: DataFrame, group: str, key: str, amount: str, limit: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.desc(amount), key)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def capped(df: DataFrame, key: list[str], limit: int, marker: DataFrame) -> DataFrame:
    """Distinct rows, the first ``limit`` by key, and a marker row if there were more."""
    distinct = df.dropDuplicates(key)
    more = distinct.agg((F.count("*") > limit).alias("more")).where("more")
    return distinct.orderBy(*key).limit(limit).union(marker.join(more.select(F.lit(1).alias("__x")), how="cross").drop("__x"))


def merged_counters(*counters: DataFrame) -> DataFrame:
    """(rule, hits) of several counters, added."""
    out = counters[0]
    for c in counters[1:]:
        out = out.unionByName(c)
    return out.groupBy("rule").agg(F.sum("hits").alias("hits"))


def zero_hits(rules: DataFrame, hits: DataFrame, sites: DataFrame) -> DataFrame:
    """Rules (rule, api) without hits: the reason and up to five sites of their api."""
    w = Window.partitionBy("api").orderBy("site")
    few = sites.withColumn("n", F.row_number().over(w)).groupBy("api").agg(F.count("*").alias("sites"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("n") <= 5, F.col("site")))), ",").alias("samples"))
    silent = rules.join(hits.where("hits > 0"), "rule", "left_anti").join(few, "api", "left")
    return silent.select("rule", F.when(F.col("sites").isNull(), "no_candidate_site").otherwise("endpoint_not_matched").alias("reason"), F.coalesce("samples", F.lit("")).alias("samples"))


def completed(sites: DataFrame, projected: DataFrame) -> DataFrame:
    """Projected endpoint rows (site, status, reason), and a row for every site without one."""
    rest = sites.select("site").join(projected, "site", "left_anti").select("site", F.lit("no_runtime_endpoint").alias("status"), F.lit("mandatory_endpoint_projection_missing").alias("reason"))
    return projected.select("site", "status", "reason").union(rest)


def placed(rows: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """``rows`` with ``place``, their number in the whole order, from 1: rows are dealt out
    by ranges, numbered within each, and moved up by what the ranges before hold."""
    ranged = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
    held = cut(ranged.withColumn("__part", F.spark_partition_id()))
    sizes = held.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    ahead = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__ahead"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return held.join(F.broadcast(ahead), "__part").select(*rows.columns, (within + F.col("__ahead")).alias("place"))  # one row for each range
