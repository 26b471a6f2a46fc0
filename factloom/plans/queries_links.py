"""Queries over bounded traces, shared state and table functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tables, text
from ..operators import links
from ..sources.fixtures import TRACE_SQL, read, trace
from .registry import query

VALUE_SQL = "ways AS (SELECT DISTINCT p_partkey AS src, unnest([p_partkey // 2, (p_partkey + p_size) // 2]) AS dst FROM part), consts AS (SELECT p_partkey AS node, p_brand AS text FROM part WHERE p_size % 6 = 2)"


def _ways(spark, sf_dir):
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    ways = F.explode(F.array(F.floor(k / 2), F.floor((k + F.col("p_size")) / 2)))
    return p.select(k.alias("src"), ways.alias("dst")).distinct(), p.where("p_size % 6 = 2").select(k.alias("node"), F.col("p_brand").alias("text"))


@query(
    f"""WITH RECURSIVE {VALUE_SQL}, walk AS (SELECT p_partkey AS seed, p_partkey AS node, 0 AS hops FROM part UNION SELECT seed, dst, hops + 1 FROM walk JOIN ways ON node = src WHERE hops < 4),
f AS (SELECT seed, text, min(hops) AS hops FROM walk JOIN consts USING (node) GROUP BY seed, text), r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY hops, text) AS n FROM f)
SELECT seed, string_agg(text, ',' ORDER BY n) AS texts FROM r WHERE n <= 6 GROUP BY seed"""
)
def string_candidates(spark, sf_dir):
    ways, consts = _ways(spark, sf_dir)
    seeds = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("seed"), F.col("p_partkey").alias("node"))
    return links.string_candidates(ways, consts, seeds).select("seed", F.array_join("texts", ",").alias("texts"))


@query(
    f"""WITH RECURSIVE {VALUE_SQL}, walk AS (SELECT s_suppkey AS seed, s_suppkey AS node, 0 AS hops FROM supplier UNION SELECT seed, dst, hops + 1 FROM walk JOIN ways ON node = src WHERE hops < 4),
h AS (SELECT seed, text, hops FROM walk JOIN consts USING (node)) SELECT DISTINCT seed AS call, text AS callback FROM h WHERE hops = (SELECT min(hops) FROM h x WHERE x.seed = h.seed)"""
)
def callback_registrations(spark, sf_dir):
    ways, consts = _ways(spark, sf_dir)
    calls = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("call"), F.col("s_suppkey").alias("callee"))
    return links.registrations(calls, consts.select(F.col("node").alias("callee"), F.col("text").alias("callback")), ways)


@query("WITH a AS (SELECT o_custkey % 60 AS target, o_orderkey AS idx, o_orderstatus || o_orderkey AS source FROM orders WHERE o_orderkey % 2 = 0), r AS (SELECT o_orderkey AS read, o_custkey % 60 AS target, o_orderkey AS idx FROM orders WHERE o_orderkey % 2 = 1) SELECT r.read, (SELECT max_by(source, a.idx) FROM a WHERE a.target = r.target AND a.idx < r.idx) AS source FROM r WHERE EXISTS (SELECT 1 FROM a WHERE a.target = r.target AND a.idx < r.idx)")
def object_assign_bridge(spark, sf_dir):
    k, t = F.col("o_orderkey"), (F.col("o_custkey") % 60).alias("target")
    o = read(spark, sf_dir, "orders")
    return links.assigned_fields(o.where(k % 2 == 1).select(k.alias("read"), t, k.alias("idx")), o.where(k % 2 == 0).select(t, k.alias("idx"), F.concat("o_orderstatus", "o_orderkey").alias("source")))


@query("WITH w AS (SELECT s_suppkey AS write, 'f' || (s_nationkey % 9) AS field FROM supplier), r AS (SELECT c_custkey AS read, CASE WHEN c_custkey % 2 = 0 THEN 'f' || (c_nationkey % 9) ELSE 'i' || (c_nationkey % 5) END AS field FROM customer), i AS (SELECT 'i' || n_nationkey AS alias, 'f' || (n_nationkey + 1) AS field FROM nation) SELECT write, read FROM w JOIN r USING (field) UNION SELECT write, read FROM r JOIN i ON r.field = i.alias JOIN w ON w.field = i.field")
def shared_state(spark, sf_dir):
    w = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("write"), F.concat(F.lit("f"), F.col("s_nationkey") % 9).alias("field"))
    n = F.col("c_nationkey")
    r = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("read"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("f"), n % 9)).otherwise(F.concat(F.lit("i"), n % 5)).alias("field"))
    i = read(spark, sf_dir, "nation").select(F.concat(F.lit("i"), "n_nationkey").alias("alias"), F.concat(F.lit("f"), F.col("n_nationkey") + 1).alias("field"))
    return links.shared_state(w, r, i)


@query("WITH d AS (SELECT p_partkey AS value, p_brand AS type, CASE WHEN p_size % 3 = 0 THEN 'class' ELSE 'number' END AS kind FROM part), s AS (SELECT l_partkey AS value, CASE WHEN l_suppkey % 3 = 0 THEN p_brand ELSE 'T' || (l_suppkey % 3) END AS type FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber = 1), g AS (SELECT s.value, d.type AS own, list_sort(list(DISTINCT s.type)) AS types FROM s JOIN d USING (value) WHERE d.kind = 'class' GROUP BY s.value, d.type) SELECT value, array_to_string(types, ',') AS types FROM g WHERE len(types) > 1 OR types[1] <> own")
def type_differences(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    d = p.select(F.col("p_partkey").alias("value"), F.col("p_brand").alias("type"), F.when(F.col("p_size") % 3 == 0, "class").otherwise("number").alias("kind"))
    li = read(spark, sf_dir, "lineitem").where("l_linenumber = 1").join(p, F.col("l_partkey") == F.col("p_partkey"))
    s = li.select(F.col("l_partkey").alias("value"), F.when(F.col("l_suppkey") % 3 == 0, F.col("p_brand")).otherwise(F.concat(F.lit("T"), F.col("l_suppkey") % 3)).alias("type"))
    return links.type_differences(d, s).select("value", F.array_join("types", ",").alias("types"))


@query("WITH d AS (SELECT DISTINCT l_suppkey AS entry, l_partkey AS key FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY entry ORDER BY key) AS place FROM d) SELECT * FROM r WHERE place <= 5")
def max_flows_per_entry(spark, sf_dir):
    return links.flows_per_entry(read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("entry"), F.col("l_partkey").alias("key")), 5)


@query("WITH k AS (SELECT n_nationkey AS template, 'k/' || CASE WHEN n_regionkey < 4 THEN n_regionkey || 'v' ELSE '<unknown>' END || '/' || n_name AS key FROM nation) SELECT template, CASE WHEN NOT contains(key, '<unknown>') THEN key END AS key, CASE WHEN contains(key, '<unknown>') THEN 'unknown endpoint' END AS problem FROM k")
def handle_templates(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    part = lambda pos, kind, col: n.select(F.col("n_nationkey").alias("template"), F.lit(pos).alias("pos"), F.lit(kind).alias("kind"), col.cast("string").alias("text"))
    t = part(0, "const", F.lit("k")).union(part(1, "endpoint", F.concat(F.lit("r"), "n_regionkey"))).union(part(2, "literal", F.col("n_name")))
    v = read(spark, sf_dir, "region").where("r_regionkey < 4").select(F.concat(F.lit("r"), "r_regionkey").alias("endpoint"), F.concat("r_regionkey", F.lit("v")).alias("value"))
    return links.handles(t, v)


@query("SELECT l_partkey AS value, min_by(l_orderkey, (l_linenumber, l_orderkey)) AS stmt FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_partkey")
def store_anchors(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    return links.store_anchors(li.select(F.col("l_partkey").alias("value"), F.col("l_orderkey").alias("stmt"), F.col("l_linenumber").alias("idx"), (F.col("l_returnflag") == "A").alias("is_store")))


@query("SELECT o_orderkey AS site, unnest([o_orderkey, o_orderkey + 1]) AS src, s_suppkey AS dst FROM orders JOIN supplier ON s_suppkey = o_custkey % 50 WHERE o_orderkey % 3 <> 0 AND s_suppkey % 2 = 0 AND s_suppkey % 4 <> 0")
def rest_parameters(spark, sf_dir):
    k, s = F.col("o_orderkey"), F.col("s_suppkey")
    calls = read(spark, sf_dir, "orders").select(k.alias("site"), (F.col("o_custkey") % 50).alias("callee"), F.when(k % 3 != 0, F.array(k, k + 1)).otherwise(F.array(k)).alias("args"))
    params = read(spark, sf_dir, "supplier").select(s.alias("callee"), s.alias("param"), (s % 2 == 0).alias("is_rest"))
    params = params.union(params.where("callee % 4 = 0"))
    return links.rest_parameters(calls, params)


@query("SELECT o_custkey + i AS src, o_orderkey AS dst, 'f' || (n_nationkey + i) AS field FROM orders JOIN nation ON n_nationkey = o_orderkey % 30, range(2) t(i) WHERE (n_nationkey + i) % 3 <> 0")
def constructor_stores(spark, sf_dir):
    k, c, n = F.col("o_orderkey"), F.col("o_custkey"), F.col("n_nationkey")
    news = read(spark, sf_dir, "orders").select(k.alias("obj"), (k % 30).alias("class"), F.array(c, c + 1).alias("args"))
    one = lambda i: read(spark, sf_dir, "nation").where((n + i) % 3 != 0).select(n.cast("long").alias("class"), F.lit(i).alias("pos"), F.concat(F.lit("f"), n + i).alias("field"))
    return links.constructor_stores(news, one(0).union(one(1)))


@query(f"WITH {TRACE_SQL} SELECT e.id, e.status, CASE WHEN f.label = 'view' THEN 'ordinary' ELSE 'ordinary' END AS family, f.method FROM trace_edges e LEFT JOIN facts f ON f.id = e.from_fact WHERE e.status <> 'emitted'")
def propagation_gaps(spark, sf_dir):
    facts, edges = trace(spark, sf_dir)
    open_ = edges.where("status <> 'emitted'").join(facts.select(F.col("id").alias("from_fact"), "method", "label"), "from_fact", "left")
    return open_.select("id", "status", text.gap_of(F.concat_ws(" ", "stage", "label"))["family"].alias("family"), "method")


@query("SELECT p_partkey AS id, i AS depth, array_to_string(string_split(p_brand || '.x.' || p_size, '.')[1:i], '.') AS prefix FROM part, range(1, 4) t(i)")
def path_prefixes(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    path = F.concat(F.col("p_brand"), F.lit(".x."), F.col("p_size"))
    return p.select(F.col("p_partkey").alias("id"), F.inline(tables.path_prefixes(path)))
