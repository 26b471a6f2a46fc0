"""Queries over rules, assets, identity, calls, schedules, taint and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assets as ops
from ..sources import readers, writers
from ..sources.fixtures import read
from . import schedule, taint
from .fixpoint import whole
from .registry import query

# ---------------------------------------------------------------- coverage and assets

BIND_SQL = """bindings AS (SELECT p_partkey AS binding, 'api' || (p_partkey // 5) AS api, CASE p_size % 3 WHEN 0 THEN 'source' WHEN 1 THEN 'sink' ELSE 'transfer' END AS role, 'arg' || (p_partkey % 2) AS base,
  CASE WHEN p_size % 4 = 0 THEN ['a'] WHEN p_size % 4 = 1 THEN ['a', 'b'] ELSE CAST([] AS VARCHAR[]) END AS path, CASE WHEN p_partkey % 5 = 0 THEN 'partial' ELSE 'complete' END AS completeness, CASE WHEN p_partkey % 7 = 0 THEN 'unknown' ELSE 'certain' END AS confidence FROM part),
asked AS (SELECT o_orderkey AS query, CASE WHEN o_orderkey % 13 <> 0 THEN 'api' || (o_custkey // 3) END AS api, CASE WHEN o_orderstatus = 'F' THEN 'source' ELSE 'sink' END AS role, 'arg' || (o_orderkey % 2) AS base, CASE WHEN o_orderkey % 3 = 0 THEN ['a', 'b'] ELSE ['a'] END AS path FROM orders)"""


@query(
    f"""WITH {BIND_SQL}, j AS (SELECT a.query, a.api, b.api IS NOT NULL AS hit, coalesce(a.role = b.role, false) AS role_hit, b.completeness, b.confidence,
    CASE WHEN b.base <> a.base THEN 'disjoint' WHEN b.path = a.path THEN 'exact' WHEN len(b.path) < len(a.path) AND a.path[1:len(b.path)] = b.path THEN 'subsumes' WHEN len(a.path) < len(b.path) AND b.path[1:len(a.path)] = a.path THEN 'subsumed-by' ELSE 'disjoint' END AS relation
  FROM asked a LEFT JOIN bindings b ON a.api = b.api),
g AS (SELECT query, any_value(api) AS api, bool_or(hit) AS hit, bool_or(role_hit) AS role_hit, bool_or(role_hit AND relation <> 'disjoint') AS near, bool_or(role_hit AND (relation = 'exact' OR (relation = 'subsumes' AND completeness = 'complete')) AND confidence <> 'unknown') AS full_ FROM j GROUP BY query)
SELECT query, CASE WHEN api IS NULL THEN 'identity-unresolved' WHEN NOT hit THEN 'not-covered' WHEN NOT role_hit THEN 'covered-surface-but-role-missing' WHEN full_ THEN 'covered-exact-role' WHEN near THEN 'covered-partial' ELSE 'not-covered' END AS status FROM g"""
)
def coverage_status(spark, sf_dir):
    k, z = F.col("p_partkey"), F.col("p_size")
    none = F.array().cast("array<string>")
    b = read(spark, sf_dir, "part").select(
        k.alias("binding"), F.concat(F.lit("api"), F.floor(k / 5)).alias("api"), F.when(z % 3 == 0, "source").when(z % 3 == 1, "sink").otherwise("transfer").alias("role"), F.concat(F.lit("arg"), k % 2).alias("base"),
        F.when(z % 4 == 0, F.lit(["a"])).when(z % 4 == 1, F.lit(["a", "b"])).otherwise(none).alias("path"), F.when(k % 5 == 0, "partial").otherwise("complete").alias("completeness"), F.when(k % 7 == 0, "unknown").otherwise("certain").alias("confidence"),
    )
    o = F.col("o_orderkey")
    q = read(spark, sf_dir, "orders").select(o.alias("query"), F.when(o % 13 != 0, F.concat(F.lit("api"), F.floor(F.col("o_custkey") / 3))).alias("api"), F.when(F.col("o_orderstatus") == "F", "source").otherwise("sink").alias("role"), F.concat(F.lit("arg"), o % 2).alias("base"), F.when(o % 3 == 0, F.lit(["a", "b"])).otherwise(F.lit(["a"])).alias("path"))
    return ops.coverage(q, b)


@query(
    """WITH g AS (SELECT s_suppkey AS id, [{'s': 'x', 'v': s_suppkey % 2}, {'s': 'y', 'v': s_nationkey % 3}] AS a, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE [{'s': 'x', 'v': s_suppkey % 4}] END AS b FROM supplier)
SELECT id, CASE WHEN b IS NULL THEN 'overlap' WHEN a[1].v <> b[1].v THEN 'disjoint' ELSE 'overlap' END AS relation FROM g"""
)
def guard_relation(spark, sf_dir):
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    cond = lambda s, v: F.struct(F.lit(s).alias("subject"), v.cast("long").alias("value"))
    a = F.array(cond("x", k % 2), cond("y", n % 3))
    b = F.when(k % 7 != 0, F.array(cond("x", k % 4)))
    return read(spark, sf_dir, "supplier").select(k.alias("id"), ops.guard_relation(a, b).alias("relation"))


LOWER_SQL = """surfaces AS (SELECT s_suppkey AS surface, 'api' || s_suppkey AS api FROM supplier), refs AS (SELECT p_partkey AS binding, p_partkey // 20 AS surface, unnest(['t' || (p_size % 6), 't' || (p_size % 9)]) AS template FROM part), templates AS (SELECT 't' || n_nationkey AS template, n_name AS kind FROM nation WHERE n_nationkey < 7)"""


def _lowered(spark, sf_dir):
    p, z = F.col("p_partkey"), F.col("p_size")
    surfaces = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("surface"), F.concat(F.lit("api"), F.col("s_suppkey")).alias("api"))
    bindings = read(spark, sf_dir, "part").select(p.alias("binding"), F.floor(p / 20).alias("surface"), F.array(F.concat(F.lit("t"), z % 6), F.concat(F.lit("t"), z % 9)).alias("refs"))
    templates = read(spark, sf_dir, "nation").where("n_nationkey < 7").select(F.concat(F.lit("t"), "n_nationkey").alias("template"), F.col("n_name").alias("kind"))
    return surfaces, bindings, templates


@query(f"WITH {LOWER_SQL} SELECT binding, api, kind, template FROM refs JOIN templates USING (template) JOIN surfaces USING (surface)")
def rule_lowering(spark, sf_dir):
    return ops.lowered(*_lowered(spark, sf_dir))[0]


@query(f"WITH {LOWER_SQL} SELECT binding, template FROM refs WHERE template NOT IN (SELECT template FROM templates)")
def rule_lowering_dangling(spark, sf_dir):
    return ops.lowered(*_lowered(spark, sf_dir))[1]


OCC_SQL = "occ AS (SELECT c_custkey AS site, 'api' || (c_custkey // 15) AS api, CASE WHEN c_custkey % 3 = 0 THEN 'rejected' ELSE 'accepted' END AS status, CASE WHEN c_custkey % 4 = 0 THEN 'partial' ELSE 'exact' END AS endpoint_status FROM customer)"


@query(f"WITH {LOWER_SQL}, {OCC_SQL}, rules AS (SELECT binding, api, kind, template FROM refs JOIN templates USING (template) JOIN surfaces USING (surface)) SELECT binding || ':' || template || ':' || site AS effect, api, site, kind FROM rules JOIN occ USING (api) WHERE status = 'accepted' AND endpoint_status = 'exact'")
def effect_sites(spark, sf_dir):
    rules = rule_lowering(spark, sf_dir)
    c = F.col("c_custkey")
    occ = read(spark, sf_dir, "customer").select(c.alias("site"), F.concat(F.lit("api"), F.floor(c / 15)).alias("api"), F.when(c % 3 == 0, "rejected").otherwise("accepted").alias("status"), F.when(c % 4 == 0, "partial").otherwise("exact").alias("endpoint_status"))
    return ops.effect_sites(rules, occ)


@query(
    """WITH e AS (SELECT l_orderkey AS occurrence, CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'ambiguous' ELSE CASE WHEN l_quantity > 25 THEN 'rejected' ELSE 'unresolved' END END AS status, 'api' || (l_partkey % 3) AS api, 'k' || (l_suppkey % 4) AS kind, l_linenumber AS priority FROM lineitem),
g AS (SELECT occurrence, count(DISTINCT CASE WHEN status = 'accepted' THEN api END) AS n, min(CASE WHEN status = 'accepted' THEN api END) AS api, min_by(kind, (priority, kind)) AS kind, bool_or(status = 'ambiguous') AS amb, bool_or(status = 'rejected') AS rej FROM e GROUP BY occurrence)
SELECT occurrence, CASE WHEN n = 1 THEN 'accepted' WHEN n > 1 OR amb THEN 'ambiguous' WHEN rej THEN 'rejected' ELSE 'unresolved' END AS status, CASE WHEN n = 1 THEN api END AS api, kind FROM g"""
)
def occurrence_resolution(spark, sf_dir):
    f = F.col("l_returnflag")
    status = F.when(f == "A", "accepted").when(f == "R", "ambiguous").when(F.col("l_quantity") > 25, "rejected").otherwise("unresolved")
    e = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("occurrence"), status.alias("status"), F.concat(F.lit("api"), F.col("l_partkey") % 3).alias("api"), F.concat(F.lit("k"), F.col("l_suppkey") % 4).alias("kind"), F.col("l_linenumber").alias("priority"))
    return ops.resolved(e)


@query(
    """WITH idx AS (SELECT 1 AS rank, p_name AS key, p_partkey AS api, p_brand AS equiv FROM part UNION ALL SELECT 2, p_brand, p_partkey, p_brand FROM part UNION ALL SELECT 3, p_type, p_partkey, p_brand FROM part),
req AS (SELECT p_partkey AS request, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE 'none' END AS k1, CASE WHEN p_partkey % 3 = 1 THEN p_brand ELSE 'none' END AS k2, CASE WHEN p_partkey % 6 = 2 THEN p_type ELSE 'none' END AS k3 FROM part),
asked AS (SELECT request, 1 AS rank, k1 AS key FROM req UNION ALL SELECT request, 2, k2 FROM req UNION ALL SELECT request, 3, k3 FROM req), hits AS (SELECT a.request, a.rank, i.api, i.equiv, min(a.rank) OVER (PARTITION BY a.request) AS best FROM asked a JOIN idx i USING (rank, key)),
g AS (SELECT request, count(DISTINCT equiv) AS n, min(api) AS api FROM hits h WHERE rank = best GROUP BY request)
SELECT r.request, CASE WHEN n IS NULL THEN 'unresolved' WHEN n = 1 THEN 'unique' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN api END AS api FROM req r LEFT JOIN g USING (request)"""
)
def registry_lookup(spark, sf_dir):
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    one = lambda rank, key: p.select(F.lit(rank).alias("rank"), F.col(key).alias("key"), k.alias("api"), F.col("p_brand").alias("equiv"))
    index = one(1, "p_name").union(one(2, "p_brand")).union(one(3, "p_type"))
    key = lambda rank, c, v: F.struct(F.lit(rank).alias("rank"), F.when(c, F.col(v)).otherwise("none").alias("key"))
    req = p.select(k.alias("request"), F.array(key(1, k % 3 == 0, "p_name"), key(2, k % 3 == 1, "p_brand"), key(3, k % 6 == 2, "p_type")).alias("keys"))
    return ops.registry_lookup(req, index)


@query("SELECT p_brand || '#' || p_size AS key, count(*) AS members, min(p_partkey) AS representative FROM part GROUP BY 1")
def mirror_groups(spark, sf_dir):
    return ops.mirror_groups(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("api"), F.concat_ws("#", "p_brand", "p_size").alias("key")))


ASSET_SQL = "assets AS (SELECT p_partkey AS asset, CASE p_size % 4 WHEN 0 THEN 'reviewed' WHEN 1 THEN 'replayed' WHEN 2 THEN 'official' ELSE 'schema-valid' END AS status, CASE WHEN p_partkey % 9 <> 0 THEN 'r' END AS reviewer, p_partkey % 8 <> 0 AS valid FROM part)"


def _assets(spark, sf_dir):
    k, z = F.col("p_partkey"), F.col("p_size") % 4
    return read(spark, sf_dir, "part").select(k.alias("asset"), F.when(z == 0, "reviewed").when(z == 1, "replayed").when(z == 2, "official").otherwise("schema-valid").alias("status"), F.when(k % 9 != 0, "r").alias("reviewer"), (k % 8 != 0).alias("valid"))


@query(f"WITH {ASSET_SQL}, s AS (SELECT DISTINCT l_partkey AS asset, l_suppkey AS surface FROM lineitem WHERE l_linenumber = 1) SELECT asset FROM assets WHERE status IN ('reviewed', 'replayed') AND reviewer IS NOT NULL AND valid AND asset NOT IN (SELECT asset FROM s WHERE surface NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 23))")
def asset_promotion(spark, sf_dir):
    surfaces = read(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_partkey").alias("asset"), F.col("l_suppkey").alias("surface")).distinct()
    backed = read(spark, sf_dir, "supplier").where("s_nationkey < 23").select(F.col("s_suppkey").alias("surface"))
    return ops.promoted(_assets(spark, sf_dir), surfaces, backed)


@query(f"WITH {ASSET_SQL} SELECT asset, status FROM assets WHERE status IN ('reviewed', 'replayed', 'official')")
def trusted_assets(spark, sf_dir):
    return ops.loadable(_assets(spark, sf_dir)).select("asset", "status")


@query("WITH b AS (SELECT p_partkey % 1900 AS binding, p_partkey % 130 AS surface, p_size % 5 AS n FROM part) SELECT binding AS id, 'duplicate id' AS error FROM b GROUP BY binding HAVING count(*) > 1 UNION ALL SELECT binding, 'unknown surface' FROM b WHERE surface NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT binding, 'no effect' FROM b WHERE n = 0")
def asset_document_errors(spark, sf_dir):
    k, n = F.col("p_partkey"), (F.col("p_size") % 5).cast("int")
    b = read(spark, sf_dir, "part").select((k % 1900).alias("binding"), (k % 130).alias("surface"), F.array_repeat(F.lit("t"), n).alias("refs"))
    return ops.document_errors(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("surface")), b)


# ---------------------------------------------------------------- calls and deferred execution


@query("SELECT user_id AS method, event_id AS idx, concat_ws(',', lag(event_type, 2) OVER w, lag(event_type, 1) OVER w) AS before, concat_ws(',', lead(event_type, 1) OVER w, lead(event_type, 2) OVER w) AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def callsite_slices(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("method"), F.col("event_id").alias("idx"), F.col("event_type").alias("name"))
    return ops.callsite_slices(e)


@query(
    """WITH t AS (SELECT n_nationkey AS id, ['then', 'catch', 'finally', 'map'][n_nationkey % 4 + 1] AS m, CASE n_nationkey % 3 WHEN 0 THEN [0] WHEN 1 THEN [1] ELSE [0, 1] END AS a, n_nationkey % 2 AS ports, n_nationkey % 5 = 0 AS res FROM nation)
SELECT id, CASE WHEN m = 'finally' AND list_contains(a, 0) AND ports = 0 THEN 'settle(any)' WHEN m = 'catch' AND list_contains(a, 0) THEN 'settle(rejected)' WHEN m = 'then' AND list_contains(a, 0) THEN 'settle(fulfilled)' WHEN m = 'then' THEN 'settle(rejected)' END AS activation,
  CASE WHEN m = 'finally' AND list_contains(a, 0) AND ports = 0 THEN 'settle(any)' WHEN m = 'catch' AND list_contains(a, 0) THEN 'settle(fulfilled)' WHEN m = 'then' AND list_contains(a, 0) AND NOT list_contains(a, 1) THEN 'settle(rejected)' WHEN m = 'then' THEN '' END AS preserve FROM t"""
)
def completion_semantics(spark, sf_dir):
    n = F.col("n_nationkey")
    c = ops.completion_semantics(F.element_at(F.lit(["then", "catch", "finally", "map"]), n % 4 + 1), F.when(n % 3 == 0, F.lit([0])).when(n % 3 == 1, F.lit([1])).otherwise(F.lit([0, 1])), n % 2, n % 5 == 0)
    return read(spark, sf_dir, "nation").select(n.alias("id"), c["activation"].alias("activation"), F.array_join(c["preserve"], ",").alias("preserve"))


@query("SELECT l_orderkey AS unit, count_if(l_returnflag = 'A') AS payload, count_if(l_returnflag = 'R') AS captures, count(DISTINCT CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN l_partkey % 3 END) AS reads, count(DISTINCT CASE WHEN l_returnflag = 'N' AND l_linestatus <> 'O' THEN l_partkey % 3 END) AS writes FROM lineitem GROUP BY l_orderkey")
def execution_unit_summary(spark, sf_dir):
    f = F.col("l_returnflag")
    role = F.when(f == "A", "payload").when(f == "R", "capture").when(F.col("l_linestatus") == "O", "read").otherwise("write")
    return ops.unit_summary(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("unit"), (F.col("l_partkey") % 3).alias("port"), role.alias("role")))


@query(
    "SELECT DISTINCT src, dst, kind FROM (SELECT unnest([o_custkey, o_custkey + 1]) AS src, o_orderkey % 40 AS t, o_orderstatus AS kind FROM orders WHERE o_orderkey % 3 <> 0), LATERAL (SELECT unnest([t, t + 5]) AS dst)"
)
def deferred_edges(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = read(spark, sf_dir, "orders").select(k.alias("contract"), F.when(k % 3 == 0, "call(c)").otherwise("event(c)").alias("activation"), F.array(c, c + 1).alias("sources"), F.array(k % 40, k % 40 + 5).alias("targets"), F.col("o_orderstatus").alias("kind"))
    return ops.deferred_edges(rows)


ARGS_SQL = "args AS (SELECT o_orderkey AS site, o_custkey % 20 AS callee, i AS pos, o_orderkey * 10 + i AS node, CASE WHEN (o_orderkey + i) % 4 = 0 THEN 'constant' ELSE 'local' END AS kind FROM orders, range(3) t(i)), params AS (SELECT n_nationkey AS callee, i AS pos, n_nationkey * 100 + i AS param FROM nation, range(3) t(i) WHERE (n_nationkey + i) % 5 <> 0)"


@query(f"WITH {ARGS_SQL} SELECT a.site, a.node AS src, p.param AS dst FROM args a JOIN params p ON a.callee = p.callee AND a.pos = p.pos WHERE a.kind <> 'constant' AND NOT EXISTS (SELECT 1 FROM range(3) t(j) WHERE j < a.pos AND NOT EXISTS (SELECT 1 FROM params q WHERE q.callee = a.callee AND q.pos = j))")
def argument_edges(spark, sf_dir):
    k = F.col("o_orderkey")
    arg = lambda i: F.struct((k * 10 + i).alias("node"), F.when((k + i) % 4 == 0, "constant").otherwise("local").alias("kind"))
    calls = read(spark, sf_dir, "orders").select(k.alias("site"), (F.col("o_custkey") % 20).alias("callee"), F.array(arg(0), arg(1), arg(2)).alias("args"))
    n = F.col("n_nationkey")
    params = read(spark, sf_dir, "nation").select(n.cast("long").alias("callee"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("pos")).where((F.col("callee") + F.col("pos")) % 5 != 0).withColumn("param", F.col("callee") * 100 + F.col("pos"))
    return ops.argument_edges(calls, params)


@query("SELECT o_orderkey AS site, s_suppkey AS src, o_orderkey + 7 AS dst FROM supplier JOIN orders ON s_nationkey = o_custkey % 25 WHERE s_suppkey % 3 <> 0 AND o_orderkey % 2 = 0")
def return_edges(spark, sf_dir):
    s, k = F.col("s_suppkey"), F.col("o_orderkey")
    returns = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("callee"), s.alias("node"), (s % 3 != 0).alias("is_local"))
    calls = read(spark, sf_dir, "orders").select(k.alias("site"), (F.col("o_custkey") % 25).alias("callee"), F.when(k % 2 == 0, k + 7).alias("result"))
    return ops.return_edges(returns, calls)


@query("WITH r AS (SELECT s_suppkey % 5 AS owner, CASE WHEN s_suppkey % 9 <> 0 THEN 'ch' || (s_nationkey % 4) END AS channel, s_suppkey AS handler FROM supplier), e AS (SELECT c_custkey % 5 AS owner, 'ch' || (c_nationkey % 4) AS channel, c_custkey AS payload FROM customer), x AS (SELECT payload, handler, channel, row_number() OVER (PARTITION BY payload ORDER BY handler) AS n FROM e JOIN r USING (owner, channel)) SELECT payload, handler, channel FROM x WHERE n <= 2")
def channel_pairs(spark, sf_dir):
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    r = read(spark, sf_dir, "supplier").select((s % 5).alias("owner"), F.when(s % 9 != 0, F.concat(F.lit("ch"), F.col("s_nationkey") % 4)).alias("channel"), s.alias("handler"))
    e = read(spark, sf_dir, "customer").select((c % 5).alias("owner"), F.concat(F.lit("ch"), F.col("c_nationkey") % 4).alias("channel"), c.alias("payload"))
    return ops.channel_pairs(r, e, limit=2)


@query("WITH t AS (SELECT l_orderkey AS flow, coalesce(list(DISTINCT l_partkey % 6) FILTER (l_linenumber <= 2), []) AS d, coalesce(list(DISTINCT l_suppkey % 6) FILTER (l_linenumber >= 2), []) AS r, coalesce(list(DISTINCT l_partkey % 6) FILTER (l_linenumber >= 4), []) AS p FROM lineitem GROUP BY l_orderkey) SELECT flow FROM t WHERE len(list_intersect(d, r)) > 0 AND len(p) > 0 AND NOT list_has_any(list_intersect(d, r), p)")
def route_mismatch(spark, sf_dir):
    n = F.col("l_linenumber")
    keys = lambda c, key: F.collect_set(F.when(c, F.col(key) % 6))
    t = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("flow")).agg(keys(n <= 2, "l_partkey").alias("dispatched"), keys(n >= 2, "l_suppkey").alias("registered"), keys(n >= 4, "l_partkey").alias("pushed"))
    return ops.route_mismatch(t)


@query("WITH c AS (SELECT event_id AS stmt, CASE event_type WHEN 'signup' THEN 'write' WHEN 'error' THEN 'delete' ELSE 'read' END AS op, 'k' || (user_id % 20) AS key, event_id % 4 = 0 AS weak FROM events WHERE user_id % 6 <> 0), x AS (SELECT stmt, key, unnest(CASE WHEN op = 'write' AND NOT weak THEN ['kill', 'put'] WHEN op = 'write' THEN ['put'] WHEN op = 'delete' THEN ['kill'] ELSE ['get'] END) AS effect, op, weak FROM c) SELECT stmt, key, effect, stmt * 10 + CASE WHEN op = 'write' AND NOT weak AND effect = 'put' THEN 1 ELSE 0 END AS seq FROM x")
def keyed_storage_effects(spark, sf_dir):
    t, u, e = F.col("event_type"), F.col("user_id"), F.col("event_id")
    calls = read(spark, sf_dir, "events").select(e.alias("stmt"), F.when(t == "signup", "write").when(t == "error", "delete").otherwise("read").alias("op"), F.when(u % 6 != 0, F.concat(F.lit("k"), u % 20)).alias("key"), (e % 4 == 0).alias("weak"))
    return ops.storage_effects(calls)


# ---------------------------------------------------------------- schedule

FAMILIES = [r[0] for r in schedule.RULES]
# written out, so that a wrong row of the operator's table shows
SCHED_SQL = """roots AS (SELECT 'm' || n_nationkey AS method FROM nation WHERE n_nationkey < 3),
ways AS (SELECT DISTINCT ['composition_lifecycle', 'interaction_lifecycle', 'teardown_lifecycle', 'ui_callback', 'channel_callback', 'scheduler_callback', 'state_watch', 'navigation_channel', 'ability_handoff'][CAST(p_partkey % 9 AS INTEGER) + 1] AS family,
  'm' || (p_partkey // 4) AS src, 'm' || p_partkey AS dst FROM part WHERE p_partkey > 2),
rules(family, phase, rank, allowed, rootless) AS (VALUES
  ('composition_lifecycle', 'composition', 1, ['bootstrap'], false), ('interaction_lifecycle', 'interaction', 2, ['bootstrap', 'composition'], false),
  ('teardown_lifecycle', 'teardown', 4, ['bootstrap', 'composition', 'interaction'], false), ('ui_callback', 'interaction', 2, ['composition'], false),
  ('channel_callback', 'interaction', 2, CAST([] AS VARCHAR[]), false), ('scheduler_callback', 'interaction', 2, ['bootstrap', 'composition', 'reactive_handoff'], false),
  ('state_watch', 'reactive_handoff', 3, ['bootstrap', 'composition', 'reactive_handoff'], false), ('navigation_channel', 'reactive_handoff', 3, ['composition'], true),
  ('ability_handoff', 'reactive_handoff', 3, ['bootstrap'], false)),
s0 AS (SELECT method, 0 AS round, 'bootstrap' AS phase FROM roots)"""
for _n in range(1, 5):
    SCHED_SQL += f""", x{_n} AS (SELECT w.dst, r.phase, row_number() OVER (PARTITION BY w.dst ORDER BY r.rank, r.family) AS n FROM ways w JOIN rules r USING (family) LEFT JOIN s{_n - 1} a ON a.method = w.src WHERE CASE WHEN a.method IS NULL THEN r.rootless ELSE len(r.allowed) = 0 OR list_contains(r.allowed, a.phase) END),
s{_n} AS (SELECT * FROM s{_n - 1} UNION ALL SELECT dst, {_n}, phase FROM x{_n} WHERE n = 1 AND dst NOT IN (SELECT method FROM s{_n - 1}))"""


@query(f"WITH {SCHED_SQL} SELECT method, round, phase, row_number() OVER (PARTITION BY round ORDER BY list_position(['bootstrap', 'composition', 'interaction', 'reactive_handoff', 'teardown'], phase), method) AS place FROM s4")
def entry_schedule(spark, sf_dir):
    k = F.col("p_partkey")
    roots = read(spark, sf_dir, "nation").where("n_nationkey < 3").select(F.concat(F.lit("m"), "n_nationkey").alias("method"))
    edges = read(spark, sf_dir, "part").where("p_partkey > 2").select(F.element_at(F.lit(FAMILIES), (k % 9 + 1).cast("int")).alias("family"), F.concat(F.lit("m"), F.floor(k / 4)).alias("src"), F.concat(F.lit("m"), k).alias("dst"))
    return schedule.ordered(schedule.activation_schedule(roots, edges)[0])


@query(
    """WITH m AS (SELECT s_suppkey AS method, 'o' || (s_suppkey % 12) AS owner, ['bootstrap', 'composition', 'interaction', 'reactive_handoff', 'teardown'][s_nationkey % 5 + 1] AS phase, s_nationkey % 5 AS rank FROM supplier),
p AS (SELECT owner, rank, lag(rank) OVER (PARTITION BY owner ORDER BY rank) AS prev FROM (SELECT DISTINCT owner, rank FROM m)) SELECT DISTINCT p.owner, a.method AS src, b.method AS dst, b.phase FROM p JOIN m a ON a.owner = p.owner AND a.rank = p.prev JOIN m b ON b.owner = p.owner AND b.rank = p.rank"""
)
def lifecycle_edges(spark, sf_dir):
    s = F.col("s_suppkey")
    return schedule.lifecycle_edges(read(spark, sf_dir, "supplier").select(s.alias("method"), F.concat(F.lit("o"), s % 12).alias("owner"), F.element_at(F.lit(list(schedule.PHASES)), F.col("s_nationkey") % 5 + 1).alias("phase")))


# ---------------------------------------------------------------- taint

TAINT_KINDS = ["copy", "store", "load", "expression", "call", "return", "array_load", "object_result", "object_container", "load_prefix", "module_state", "getter", "reflect_get", "reflect_set", "rest_param"]
TAINT_SQL = (
    "seeds AS (SELECT CAST(n_nationkey AS BIGINT) AS node, 'src' || (n_nationkey % 2) AS source FROM nation WHERE n_nationkey < 4), ways AS (SELECT DISTINCT ["
    + ", ".join(f"'{k}'" for k in TAINT_KINDS)
    + f"][CAST(p_partkey % {len(TAINT_KINDS)} AS INTEGER) + 1] AS kind, unnest([p_partkey // 3, p_partkey // 4]) AS src, p_partkey AS dst, 'f' || (p_size % 2) AS field, p_size % 3 AS site FROM part WHERE p_partkey > 0)"
)
TAINT_WALK = """, walk(node, ctx, path, source) AS (SELECT node, CAST(-1 AS BIGINT), CAST([] AS VARCHAR[]), source FROM seeds
  UNION SELECT w.dst, CASE kind WHEN 'module_state' THEN -1 WHEN 'call' THEN w.site WHEN 'return' THEN -1 ELSE ctx END,
    CASE WHEN kind IN ('store', 'module_state', 'load_prefix', 'reflect_set') THEN list_prepend(w.field, path)[1:12] WHEN kind IN ('load', 'reflect_get', 'getter') THEN path[2:] WHEN kind IN ('expression', 'object_result') THEN CAST([] AS VARCHAR[]) WHEN kind = 'object_container' THEN ['arr:*'] ELSE path END, source
  FROM walk t JOIN ways w ON t.node = w.src WHERE CASE WHEN kind IN ('copy', 'expression', 'store', 'reflect_set', 'module_state', 'call') THEN true WHEN kind IN ('array_load', 'rest_param') THEN len(path) = 0 WHEN kind IN ('load', 'reflect_get') THEN len(path) > 0 AND path[1] = w.field WHEN kind = 'getter' THEN len(path) > 1 AND path[1] = w.field
    WHEN kind = 'load_prefix' THEN len(path) BETWEEN 1 AND 11 WHEN kind IN ('object_result', 'object_container') THEN len(path) > 0 WHEN kind = 'return' THEN ctx = -1 OR ctx = w.site END)
"""


def taint_tables(spark, sf_dir):
    """Source rules and sites, edges, sink rules and sites, sanitised pairs."""
    k, z = F.col("p_partkey"), F.col("p_size")
    edges = read(spark, sf_dir, "part").where("p_partkey > 0").select(F.element_at(F.lit(TAINT_KINDS), (k % len(TAINT_KINDS) + 1).cast("int")).alias("kind"), F.explode(F.array(F.floor(k / 3), F.floor(k / 4))).alias("src"), k.alias("dst"), F.concat(F.lit("f"), z % 2).alias("field"), (z % 3).cast("long").alias("site")).distinct()
    n = F.col("n_nationkey")
    rules = spark.createDataFrame([("src0", "a0", "call_return"), ("src1", "a1", "call_arg"), ("never", "a0", "entry_param")], "rule string, api string, kind string").withColumn("path", F.lit(None).cast("array<string>"))
    sites = read(spark, sf_dir, "nation").where(n < 4).select(F.concat(F.lit("a"), n % 2).alias("api"), n.cast("long").alias("node"), F.when(n % 2 == 0, "call_return").otherwise("call_arg").alias("kind"))
    sink_rules = spark.createDataFrame([("any", "x", []), ("field", "y", ["f1"])], "rule string, api string, path array<string>")
    sink_sites = read(spark, sf_dir, "part").where(z < 30).select(k.alias("node"), F.when(k % 2 == 0, "x").otherwise("y").alias("api"))
    return rules, sites, edges, sink_rules, sink_sites, spark.createDataFrame([("src1", "any")], "source string, rule string")


def _taint(spark, sf_dir):
    rules, sites, edges, *_ = taint_tables(spark, sf_dir)
    return taint.seeds(rules, sites), edges


@query(f"WITH {TAINT_SQL} SELECT node, '' AS path, source FROM seeds")
def taint_seeds(spark, sf_dir):
    return _taint(spark, sf_dir)[0].select("node", F.array_join("path", ".").alias("path"), "source")


@query(f"WITH RECURSIVE {TAINT_SQL}{TAINT_WALK} SELECT node, CASE WHEN ctx = -1 THEN '' ELSE CAST(ctx AS VARCHAR) END AS ctx, array_to_string(path, '.') AS path, source FROM walk")
def taint_propagation(spark, sf_dir):
    found = whole(taint.propagate(*_taint(spark, sf_dir), k=1))
    return found.select("node", F.array_join("ctx", ",").alias("ctx"), F.array_join("path", ".").alias("path"), "source")


SQL_SINKS = f"""WITH RECURSIVE {TAINT_SQL}{TAINT_WALK}, rules(rule, api, want) AS (VALUES ('any', 'x', CAST([] AS VARCHAR[])), ('field', 'y', ['f1'])), sites AS (SELECT p_partkey AS node, CASE WHEN p_partkey % 2 = 0 THEN 'x' ELSE 'y' END AS api FROM part WHERE p_size < 30)
SELECT DISTINCT t.source, r.rule, t.node, array_to_string(t.path, '.') AS path FROM walk t JOIN sites s ON s.node = t.node JOIN rules r ON r.api = s.api WHERE (len(r.want) = 0 OR t.path[1:len(r.want)] = r.want) AND NOT (t.source = 'src1' AND r.rule = 'any')"""


@query(SQL_SINKS)
def taint_sinks(spark, sf_dir):
    found = whole(taint.propagate(*_taint(spark, sf_dir), k=1))
    return taint.sinks(found, *taint_tables(spark, sf_dir)[3:])


# ---------------------------------------------------------------- files


@query("SELECT r_regionkey AS id, r_name AS name, 'rule' AS kind FROM region")
def json_asset_round_trip(spark, sf_dir):
    """Written as JSON and read again under a schema that fails on bad rows."""
    rows = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit("rule").alias("kind"))
    return readers.json_table(spark, writers.scratch(rows, "json"), "id int, name string, kind string")


@query("SELECT n_nationkey AS id, n_name AS name FROM nation")
def csv_findings_export(spark, sf_dir):
    rows = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return spark.read.schema("id int, name string").option("header", True).csv(writers.scratch(rows, "csv"))


@query("SELECT o_orderkey AS entry, o_totalprice AS value FROM orders WHERE o_orderkey % 3 = 1")
def incremental_cache(spark, sf_dir):
    """Two scopes written, one replaced, one read; a scope that is not there is empty."""
    o = read(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderkey").alias("entry"), F.col("o_totalprice").alias("value"), F.concat(F.lit("s"), F.col("o_orderkey") % 3).alias("scope"))
    path = writers.scratch_path(spark)
    writers.save_cache(rows.where("scope <> 's2'").withColumn("value", F.lit(0.0)), path, "scope")
    writers.save_cache(rows.where("scope = 's1'"), path, "scope")
    got = readers.load_cache(spark, path, "entry long, value double, scope string", {"scope": "s1"})
    return got.select("entry", "value").union(readers.load_cache(spark, path, "entry long, value double, scope string", {"scope": "gone"}).select("entry", "value"))


@query("SELECT s_suppkey AS id, json_extract_string(props, '$.k') AS dummy FROM (SELECT s_suppkey, '{\"k\": \"' || s_name || '\"}' AS props FROM supplier)")
def json_text_fields(spark, sf_dir):
    props = F.concat(F.lit('{"k": "'), "s_name", F.lit('"}'))
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.get_json_object(props, "$.k").alias("dummy"))


@query("SELECT s_nationkey AS graph, 'digraph g { ' || string_agg('n' || s_suppkey || ' -> m' || s_nationkey || ';', ' ' ORDER BY s_suppkey) || ' }' AS dot FROM supplier GROUP BY s_nationkey")
def dot_dump(spark, sf_dir):
    e = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("graph"), F.col("s_suppkey").alias("ord"), F.concat(F.lit("n"), "s_suppkey").alias("src"), F.concat(F.lit("m"), "s_nationkey").alias("dst"))
    return writers.dot(e)
