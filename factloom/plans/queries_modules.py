"""Queries over module semantics and the engine's stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import semantics
from ..sources import readers
from ..sources.fixtures import read
from . import queries_identity
from .engine import Engine
from .registry import query

SPEC_SQL = """spec AS (SELECT * FROM (VALUES ('bridge', 'api0', 'api1', 'arg0', 'arg1', true), ('bridge', 'api2', 'api9', 'arg1', 'arg0', false)) t(kind, api, to_api, from_ep, to_ep, same_receiver)),
sites AS (SELECT CASE WHEN l_orderkey = 3 THEN 'api9' ELSE 'api' || (l_partkey % 6) END AS api, l_orderkey AS site, l_orderkey // 4 AS receiver, 'arg' || (l_linenumber % 2) AS endpoint, l_orderkey * 10 + l_linenumber AS node FROM lineitem)"""


def _sites(spark, sf_dir):
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    return read(spark, sf_dir, "lineitem").select(F.when(k == 3, "api9").otherwise(F.concat(F.lit("api"), F.col("l_partkey") % 6)).alias("api"), k.alias("site"), F.floor(k / 4).alias("receiver"), F.concat(F.lit("arg"), n % 2).alias("endpoint"), (k * 10 + n).alias("node"))


@query(f"WITH {SPEC_SQL} SELECT DISTINCT a.node AS src, b.node AS dst, a.site FROM spec s JOIN sites a ON a.api = s.api AND a.endpoint = s.from_ep JOIN sites b ON b.api = s.to_api AND b.endpoint = s.to_ep WHERE NOT s.same_receiver OR a.receiver = b.receiver")
def module_bridge(spark, sf_dir):
    spec = spark.createDataFrame([("bridge", "api0", "api1", "arg0", "arg1", True), ("bridge", "api2", "api9", "arg1", "arg0", False)], "kind string, api string, to_api string, from_ep string, to_ep string, same_receiver boolean")
    return semantics.bridge(spec, _sites(spark, sf_dir)).select("src", "dst", "site")


CALLS_SQL = "calls AS (SELECT 'api' || (l_partkey % 6) AS api, CASE WHEN l_suppkey % 7 <> 0 THEN 'k' || (l_orderkey // 10) END AS key, l_orderkey * 10 + l_linenumber AS node, l_suppkey % 30 AS receiver, l_orderkey AS stmt, 'w' || (l_partkey % 3) AS scope FROM lineitem)"


def _calls(spark, sf_dir):
    k = F.col("l_orderkey")
    return read(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("api"), F.col("l_partkey") % 6).alias("api"), F.when(F.col("l_suppkey") % 7 != 0, F.concat(F.lit("k"), F.floor(k / 10))).alias("key"), (k * 10 + F.col("l_linenumber")).alias("node"),
        (F.col("l_suppkey") % 30).alias("receiver"), k.alias("stmt"), F.concat(F.lit("w"), F.col("l_partkey") % 3).alias("scope"),
    )


@query(f"WITH {CALLS_SQL}, spec(api, effect) AS (VALUES ('api0', 'put'), ('api1', 'get'), ('api2', 'kill')), j AS (SELECT * FROM calls JOIN spec USING (api) WHERE key IS NOT NULL) SELECT effect, key, node, stmt * 10 + 1 AS seq, scope FROM j UNION ALL SELECT 'kill', key, node, stmt * 10, scope FROM j WHERE effect = 'put'")
def module_keyed_storage(spark, sf_dir):
    spec = spark.createDataFrame([("keyed_storage", "api0", "put"), ("keyed_storage", "api1", "get"), ("keyed_storage", "api2", "kill"), ("state", "api3", "put")], "kind string, api string, effect string")
    return semantics.keyed(spec, _calls(spark, sf_dir), "keyed_storage")


@query(f"WITH {CALLS_SQL}, spec(api, family, capability) AS (VALUES ('api0', 'map', 'set'), ('api1', 'map', 'get'), ('api2', 'list', 'push'), ('api3', 'list', 'values')) SELECT CASE WHEN capability IN ('set', 'push') THEN 'store' ELSE 'load' END AS kind, CASE WHEN capability IN ('set', 'push') THEN node ELSE receiver END AS src, CASE WHEN capability IN ('set', 'push') THEN receiver ELSE node END AS dst, '$c$:' || family || ':' || coalesce(key, '*') AS field FROM calls JOIN spec USING (api)")
def module_container(spark, sf_dir):
    spec = spark.createDataFrame([("container", "api0", "map", "set"), ("container", "api1", "map", "get"), ("container", "api2", "list", "push"), ("container", "api3", "list", "values")], "kind string, api string, family string, capability string")
    return semantics.container(spec, _calls(spark, sf_dir)).select("kind", "src", "dst", "field")


@query(f"WITH {CALLS_SQL}, spec(api, capability) AS (VALUES ('api0', 'emit'), ('api1', 'on')) SELECT CASE capability WHEN 'emit' THEN 'put' ELSE 'get' END AS effect, receiver || '#' || key AS key, node FROM calls JOIN spec USING (api) WHERE key IS NOT NULL")
def module_event_emitter(spark, sf_dir):
    spec = spark.createDataFrame([("event_emitter", "api0", "emit"), ("event_emitter", "api1", "on")], "kind string, api string, capability string")
    return semantics.channel(spec, _calls(spark, sf_dir)).select("effect", "key", "node")


@query(f"WITH {CALLS_SQL}, spec(api, capability) AS (VALUES ('api0', 'start'), ('api1', 'receive')), j AS (SELECT * FROM calls JOIN spec USING (api) WHERE key IS NOT NULL) SELECT DISTINCT a.node AS src, b.node AS dst FROM j a JOIN j b ON a.key = b.key WHERE a.capability = 'start' AND b.capability = 'receive'")
def module_route_bridge(spark, sf_dir):
    spec = spark.createDataFrame([("route_bridge", "api0", "start"), ("route_bridge", "api1", "receive"), ("ability_handoff", "api2", "start")], "kind string, api string, capability string")
    return semantics.handoff_by_target(spec, _calls(spark, sf_dir), "route_bridge").select("src", "dst")


@query(
    """WITH f AS (SELECT c_custkey AS node, c_custkey % 200 AS owner, c_custkey % 200 // 2 AS parent, 'n' || (c_nationkey % 3) AS name, CASE c_custkey % 4 WHEN 0 THEN 'link' WHEN 1 THEN 'prop' ELSE 'state' END AS decorator FROM customer),
j AS (SELECT c.node AS c, p.node AS p, c.decorator = 'link' AS two FROM f c JOIN f p ON p.owner = c.parent AND p.name = c.name WHERE c.decorator IN ('link', 'prop')) SELECT p AS src, c AS dst FROM j UNION SELECT c, p FROM j WHERE two"""
)
def module_state_binding(spark, sf_dir):
    k = F.col("c_custkey")
    f = read(spark, sf_dir, "customer").select(k.alias("node"), (k % 200).alias("owner"), F.floor(k % 200 / 2).cast("long").alias("parent"), F.concat(F.lit("n"), F.col("c_nationkey") % 3).alias("name"), F.when(k % 4 == 0, "link").when(k % 4 == 1, "prop").otherwise("state").alias("decorator"))
    spec = spark.createDataFrame([("state_binding", "link", True), ("state_binding", "prop", False)], "kind string, decorator string, both boolean")
    return semantics.bindings(spec, f).select("src", "dst")


@query("SELECT s_suppkey AS src, n_nationkey AS dst FROM supplier JOIN nation ON n_nationkey = s_nationkey % 10 WHERE s_suppkey % 3 = 0")
def module_declarative_binding(spark, sf_dir):
    s, n = F.col("s_suppkey"), F.col("n_nationkey")
    surfaces = read(spark, sf_dir, "supplier").where(s % 3 == 0).select(F.concat(F.lit("t"), F.col("s_nationkey") % 10).alias("trigger"), s.alias("node"))
    handlers = read(spark, sf_dir, "nation").select(F.concat(F.lit("h"), n).alias("name"), n.alias("node"))
    spec = spark.range(10).select(F.lit("declarative_binding").alias("kind"), F.concat(F.lit("t"), "id").alias("trigger"), F.concat(F.lit("h"), "id").alias("handler"))
    return semantics.declarative(spec, surfaces, handlers).select("src", "dst")


@query("SELECT p_partkey % 1990 AS id, CASE WHEN p_size % 7 = 0 THEN 'unknown kind' WHEN p_partkey % 9 = 0 AND p_size % 2 = 0 THEN 'missing api' ELSE 'duplicate id' END AS error FROM part WHERE p_size % 7 = 0 OR (p_partkey % 9 = 0 AND p_size % 2 = 0) OR p_partkey % 1990 IN (SELECT p_partkey % 1990 FROM part GROUP BY 1 HAVING count(*) > 1)")
def module_spec_errors(spark, sf_dir):
    k, z = F.col("p_partkey"), F.col("p_size")
    spec = read(spark, sf_dir, "part").select((k % 1990).alias("id"), F.when(z % 7 == 0, "other").when(z % 2 == 0, "bridge").otherwise("state_binding").alias("kind"), F.when(k % 9 != 0, "api").alias("api"))
    return semantics.spec_errors(spec)


@query(queries_identity.SQL_SINKS)
def engine_flows(spark, sf_dir):
    """The engine's stages from rules to flows."""
    rules, sites, edges, sink_rules, sink_sites, sanitized = queries_identity.taint_tables(spark, sf_dir)
    return Engine(spark, spark.createDataFrame([], "caller long, callee long"), edges).run(rules, sites, sink_rules, sink_sites, sanitized)["flows"]


@query("SELECT 'p' || (s_suppkey % 7) || '/src/main/ets' AS dir, 4 AS depth FROM supplier WHERE s_suppkey % 3 <> 0 GROUP BY ALL")
def source_dir_discovery(spark, sf_dir):
    s = F.col("s_suppkey")
    files = read(spark, sf_dir, "supplier").select(F.concat(F.lit("p"), s % 7, F.lit("/src/main/ets/pages/a"), s, F.when(s % 3 == 0, ".json").when(s % 3 == 1, ".ets").otherwise(".TS")).alias("path"))
    return readers.source_dirs(files)


@query("SELECT p_name AS path FROM part WHERE p_size > 3 AND p_name NOT IN (SELECT p_name FROM part WHERE p_size > 8)")
def unparsed_files(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    name = F.col("p_name").alias("path")
    return readers.unparsed(p.where("p_size > 3").select(name), p.where("p_size > 8").select(name))


@query("SELECT event_id AS stmt, user_id AS method FROM events WHERE event_type = 'purchase' AND user_id = 7")
def statement_scan(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("stmt"), F.col("user_id").alias("method"), F.col("event_type").alias("kind"))
    return readers.statements(e, "purchase", method=7).select("stmt", "method")


@query("SELECT c_custkey AS node FROM customer WHERE c_nationkey IS NULL OR c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 4 = 0)")
def reachability_filter(spark, sf_dir):
    """Nodes without a method, or whose method is among the allowed ones."""
    c = read(spark, sf_dir, "customer")
    allowed = read(spark, sf_dir, "supplier").where("s_suppkey % 4 = 0").select(F.col("s_nationkey").alias("c_nationkey")).distinct()
    return c.where("c_nationkey is null").select(F.col("c_custkey").alias("node")).union(c.join(allowed, "c_nationkey", "left_semi").select("c_custkey"))
