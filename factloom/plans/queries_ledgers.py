"""Queries over ledgers, rankings and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledgers, sets
from ..sources.fixtures import read
from .registry import query

LEDGER_SQL = """ledger AS (
  SELECT d.doc_id AS surface, d.source, d.lang, CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 'covered-exact-role' WHEN l.quality = 1 THEN 'covered-partial' WHEN l.toxic = 1 THEN 'covered-surface-but-role-missing' WHEN l.quality = 0 THEN 'covered-conflict'
      WHEN d.doc_id % 11 = 0 THEN 'ignored-by-policy' WHEN d.doc_id % 13 = 0 THEN 'need-more-evidence' WHEN d.doc_id % 17 = 0 THEN 'identity-unresolved' ELSE 'not-covered' END AS coverage_status,
    CASE WHEN d.doc_id % 5 = 0 THEN 'skip-llm' WHEN d.doc_id % 5 = 1 THEN 'ignore' WHEN d.doc_id % 19 = 0 THEN NULL ELSE 'send-to-llm' END AS decision, CASE WHEN d.doc_id % 23 = 0 THEN ' ' ELSE 'seen' END AS reason
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


def _ledger(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    j = d.join(read(spark, sf_dir, "labels"), "doc_id", "left")
    k, q, t = F.col("doc_id"), F.col("quality"), F.col("toxic")
    status = (
        F.when((q == 1) & (t == 0), "covered-exact-role").when(q == 1, "covered-partial").when(t == 1, "covered-surface-but-role-missing").when(q == 0, "covered-conflict")
        .when(k % 11 == 0, "ignored-by-policy").when(k % 13 == 0, "need-more-evidence").when(k % 17 == 0, "identity-unresolved").otherwise("not-covered")
    )
    decision = F.when(k % 5 == 0, "skip-llm").when(k % 5 == 1, "ignore").when(k % 19 == 0, F.lit(None)).otherwise("send-to-llm")
    return j.select(k.alias("surface"), "source", "lang", status.alias("coverage_status"), decision.alias("decision"), F.when(k % 23 == 0, " ").otherwise("seen").alias("reason"))


@query(
    f"""WITH {LEDGER_SQL} SELECT count(*) AS total, count_if(coverage_status = 'covered-exact-role') AS exact_covered, count_if(coverage_status = 'covered-partial') AS partial_covered, count_if(coverage_status = 'covered-surface-but-role-missing') AS role_missing,
count_if(coverage_status = 'not-covered') AS not_covered, count_if(coverage_status = 'covered-conflict') AS conflicts, count_if(coverage_status = 'identity-unresolved') AS identity_unresolved, count_if(coverage_status = 'ignored-by-policy') AS ignored_by_policy,
count_if(coverage_status = 'need-more-evidence') AS need_more_evidence, count_if(decision = 'send-to-llm') AS sent FROM ledger"""
)
def coverage_summary(spark, sf_dir):
    return ledgers.summary(_ledger(spark, sf_dir))


@query(
    f"""WITH {LEDGER_SQL}, entries AS (SELECT * FROM ledger WHERE surface % 29 <> 0 UNION ALL SELECT * FROM ledger WHERE surface % 31 = 0), observed AS (SELECT doc_id AS surface FROM documents WHERE doc_id % 37 <> 0)
SELECT surface, 'no reason' AS problem FROM entries WHERE trim(reason) = '' UNION ALL SELECT surface, 'no decision' FROM entries WHERE decision IS NULL
UNION ALL SELECT surface, 'skipped without cover' FROM entries WHERE decision = 'skip-llm' AND coverage_status NOT IN ('covered-exact-role', 'ignored-by-policy')
UNION ALL SELECT surface, 'ignored without policy' FROM entries WHERE decision = 'ignore' AND coverage_status <> 'ignored-by-policy'
UNION ALL SELECT surface, 'sent though terminal' FROM entries WHERE decision = 'send-to-llm' AND coverage_status IN ('covered-exact-role', 'ignored-by-policy')
UNION ALL SELECT surface, 'unknown surface' FROM entries WHERE surface NOT IN (SELECT surface FROM observed)
UNION ALL SELECT surface, 'duplicate entry' FROM entries GROUP BY surface HAVING count(*) > 1
UNION ALL SELECT surface, 'no entry' FROM observed WHERE surface NOT IN (SELECT surface FROM entries)"""
)
def ledger_problems(spark, sf_dir):
    led = _ledger(spark, sf_dir)
    entries = led.where("surface % 29 <> 0").union(led.where("surface % 31 = 0"))
    observed = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("surface")).where("surface % 37 <> 0")
    return ledgers.problems(entries, observed)


@query(f"WITH {LEDGER_SQL} SELECT coverage_status, lang, source, CAST(grouping(coverage_status) * 4 + grouping(lang) * 2 + grouping(source) AS BIGINT) AS set_id, count(*) AS n, count(DISTINCT surface % 10) AS kinds FROM ledger GROUP BY GROUPING SETS ((coverage_status), (coverage_status, lang), (source), (lang, source), ())")
def ledger_grouping_sets(spark, sf_dir):
    return ledgers.grouped(_ledger(spark, sf_dir), [["coverage_status"], ["coverage_status", "lang"], ["source"], ["lang", "source"], []], F.count("*").alias("n"), F.countDistinct(F.col("surface") % 10).alias("kinds"))


@query("SELECT l_shipdate::DATE::VARCHAR AS shipped, l_returnflag AS flag, l_linestatus AS status, CAST(grouping(l_returnflag) * 4 + grouping(l_linestatus) AS BIGINT) AS set_id, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((shipped, l_returnflag, l_linestatus), (shipped, l_returnflag), (shipped))")
def effect_ledger_rollup(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    rows = li.select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipped"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))
    return ledgers.grouped(rows, [["shipped", "flag", "status"], ["shipped", "flag"], ["shipped"]], F.count("*").alias("n"))


@query("SELECT l_returnflag AS role, l_linestatus AS status, count(*) AS n, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def effect_ledger_cube(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("role"), F.col("l_linestatus").alias("status"), "l_partkey")
    return li.cube("role", "status").agg(F.count("*").alias("n"), F.countDistinct("l_partkey").alias("parts"))


HITS_SQL = "hits AS (SELECT l_partkey AS rule, count(*) AS hits FROM lineitem WHERE l_quantity > 45 GROUP BY l_partkey)"


def _hits(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").where("l_quantity > 45").groupBy(F.col("l_partkey").alias("rule")).agg(F.count("*").alias("hits"))


@query(f"WITH {HITS_SQL} SELECT rule, hits FROM hits ORDER BY hits DESC, rule LIMIT 20")
def topk_rules(spark, sf_dir):
    return ledgers.ranked(_hits(spark, sf_dir), "rule", "hits", 20)


@query(f"WITH {HITS_SQL}, r AS (SELECT p_brand AS brand, rule, hits, row_number() OVER (PARTITION BY p_brand ORDER BY hits DESC, rule) AS place FROM hits JOIN part ON p_partkey = rule) SELECT * FROM r WHERE place <= 3")
def topk_per_group(spark, sf_dir):
    j = _hits(spark, sf_dir).join(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("rule"), F.col("p_brand").alias("brand")), "rule")
    return ledgers.ranked_within(j.select("brand", "rule", "hits"), "brand", "rule", "hits", 3)


@query(
    f"""WITH {HITS_SQL}, rules AS (SELECT p_partkey AS rule, p_size AS api FROM part), sites AS (SELECT s_nationkey AS api, s_suppkey AS site FROM supplier),
few AS (SELECT api, count(*) AS sites, string_agg(CASE WHEN n <= 5 THEN CAST(site AS VARCHAR) END, ',' ORDER BY site) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY api ORDER BY site) AS n FROM sites) GROUP BY api)
SELECT r.rule, CASE WHEN f.sites IS NULL THEN 'no_candidate_site' ELSE 'endpoint_not_matched' END AS reason, coalesce(f.samples, '') AS samples FROM rules r LEFT JOIN few f ON f.api = r.api WHERE r.rule NOT IN (SELECT rule FROM hits)"""
)
def rule_zero_hits(spark, sf_dir):
    rules = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("rule"), F.col("p_size").alias("api"))
    sites = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("api"), F.col("s_suppkey").alias("site"))
    return ledgers.zero_hits(rules, _hits(spark, sf_dir), sites)


@query(f"WITH {HITS_SQL} SELECT rule, CAST(sum(hits) AS BIGINT) AS hits FROM (SELECT * FROM hits UNION ALL SELECT rule % 100, hits * 2 FROM hits) GROUP BY rule")
def rule_counter_merge(spark, sf_dir):
    h = _hits(spark, sf_dir)
    return ledgers.merged_counters(h, h.select((F.col("rule") % 100).alias("rule"), (F.col("hits") * 2).alias("hits")))


@query("SELECT l_partkey AS item, l_suppkey AS callee, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 20) GROUP BY ALL ORDER BY n DESC, item, callee LIMIT 100")
def no_candidate_callsites(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    open_ = li.join(li.where("l_returnflag = 'R' and l_quantity > 20").select("l_partkey").distinct(), "l_partkey", "left_anti")
    return open_.groupBy(F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("callee")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "item", "callee").limit(100)


@query("SELECT * FROM (SELECT DISTINCT user_id, event_type AS kind FROM events ORDER BY user_id, kind LIMIT 200) UNION ALL SELECT -1, 'truncated' WHERE (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type FROM events)) > 200")
def gap_ledger_cap(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("kind"))
    return ledgers.capped(rows, ["user_id", "kind"], 200, spark.createDataFrame([(-1, "truncated")], "user_id long, kind string"))


@query("WITH sites AS (SELECT o_orderkey AS site FROM orders), rows_ AS (SELECT l_orderkey AS site, 'resolved' AS status, l_returnflag AS reason FROM lineitem WHERE l_quantity > 40) SELECT * FROM rows_ UNION ALL SELECT site, 'no_runtime_endpoint', 'mandatory_endpoint_projection_missing' FROM sites WHERE site NOT IN (SELECT site FROM rows_)")
def endpoint_ledger_completion(spark, sf_dir):
    sites = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("site"))
    rows = read(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("site"), F.lit("resolved").alias("status"), F.col("l_returnflag").alias("reason"))
    return ledgers.completed(sites, rows)


@query("SELECT coalesce(nullif(trim(p_brand), ''), CAST(p_partkey AS VARCHAR)) AS family, p_partkey AS id, row_number() OVER (ORDER BY coalesce(nullif(trim(p_brand), ''), CAST(p_partkey AS VARCHAR)), p_partkey) AS place FROM part")
def rule_ordering(spark, sf_dir):
    """Rules by family, else id, then id, each with its place."""
    p = read(spark, sf_dir, "part")
    family = F.coalesce(F.nullif(F.trim("p_brand"), F.lit("")), F.col("p_partkey").cast("string"))
    return ledgers.placed(p.select(family.alias("family"), F.col("p_partkey").alias("id")), ["family", "id"])


@query("SELECT 'a:' || n_nationkey AS id, n_name AS label FROM nation UNION ALL SELECT 'b:' || s_nationkey, s_name FROM supplier UNION ALL SELECT CAST(r_regionkey AS VARCHAR), r_name FROM region")
def merge_trace_graphs(spark, sf_dir):
    part = lambda t, k, n: read(spark, sf_dir, t).select(F.col(k).cast("string").alias("id"), F.col(n).alias("label"))
    return sets.appended(part("region", "r_regionkey", "r_name"), [("a", part("nation", "n_nationkey", "n_name")), ("b", part("supplier", "s_nationkey", "s_name"))], "id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def map_difference(spark, sf_dir):
    return sets.difference(read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels"), "doc_id")


@query("SELECT user_id, event_type, min_by(event_id, (ts, event_id)) AS first_id FROM events GROUP BY user_id, event_type")
def coverage_dedup(spark, sf_dir):
    return sets.first_by(read(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", F.col("event_id").alias("first_id"))


LAYER_SQL = "layers AS (SELECT p_partkey AS rule, p_brand AS body, 0 AS layer FROM part UNION ALL SELECT p_partkey, 'project', 1 FROM part WHERE p_size > 25 UNION ALL SELECT p_partkey, 'candidate', 2 FROM part WHERE p_size > 40), r AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY layer DESC) AS n FROM layers)"


def _layers(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    base = p.select(F.col("p_partkey").alias("rule"), F.col("p_brand").alias("body"))
    over = lambda n, c: p.where(F.col("p_size") > n).select(F.col("p_partkey").alias("rule"), F.lit(c).alias("body"))
    return sets.layered([base, over(25, "project"), over(40, "candidate")], "rule")


@query(f"WITH {LAYER_SQL} SELECT rule, body, layer FROM r WHERE n = 1")
def layered_rule_catalog(spark, sf_dir):
    return _layers(spark, sf_dir)[0]


@query(f"WITH {LAYER_SQL} SELECT layer, count(*) AS given, count_if(n = 1) AS used FROM r GROUP BY layer")
def layered_rule_status(spark, sf_dir):
    return _layers(spark, sf_dir)[1]


@query("SELECT p_brand AS pack, count(*) AS modules FROM part WHERE p_size IN (SELECT n_nationkey FROM nation) AND p_partkey NOT IN (SELECT s_suppkey FROM supplier) GROUP BY p_brand")
def enabled_packs(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    on = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("p_size"))
    off = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("p_partkey"))
    return sets.enabled(sets.enabled(p, on, None, "p_size"), None, off, "p_partkey").groupBy(F.col("p_brand").alias("pack")).agg(F.count("*").alias("modules"))


@query(
    """WITH g AS (SELECT l_partkey AS pack, list(DISTINCT l_returnflag) FILTER (l_quantity > 25) AS a, list(DISTINCT l_returnflag) FILTER (l_quantity <= 25) AS b FROM lineitem GROUP BY l_partkey),
n AS (SELECT pack, coalesce(a, []) AS a, coalesce(b, []) AS b FROM g)
SELECT pack, array_to_string(list_sort(list_filter(a, lambda x: list_contains(b, x))), '') AS both, array_to_string(list_sort(list_distinct(list_concat(a, b))), '') AS either, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), '') AS rest FROM n"""
)
def pack_plane_algebra(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    g = li.groupBy(F.col("l_partkey").alias("pack")).agg(F.collect_set(F.when(F.col("l_quantity") > 25, F.col("l_returnflag"))).alias("a"), F.collect_set(F.when(F.col("l_quantity") <= 25, F.col("l_returnflag"))).alias("b"))
    a, b = F.col("a"), F.col("b")
    return g.select("pack", *[F.array_join(f(a, b), "").alias(n) for f, n in ((sets.planes_and, "both"), (sets.planes_or, "either"), (sets.planes_minus, "rest"))])


@query("SELECT l_shipdate::DATE::VARCHAR AS from_ep, l_returnflag AS to_ep, count(*) AS n FROM lineitem GROUP BY 1, 2")
def transfer_endpoint_histogram(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    return li.groupBy(F.date_format("l_shipdate", "yyyy-MM-dd").alias("from_ep"), F.col("l_returnflag").alias("to_ep")).agg(F.count("*").alias("n"))
