"""Queries over captures, dispatch, synthetic calls, callbacks, library calls and field rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calls as ops
from ..operators import fields
from ..sources.fixtures import read
from . import graph, taint
from .fixpoint import written
from .queries_graph import PTS_WALK, _points_to
from .registry import query


def _c(name):
    return F.col(name)


@query("SELECT DISTINCT 'copy' AS kind, s_suppkey AS src, c_custkey AS dst, CAST(NULL AS VARCHAR) AS field, CAST(NULL AS BIGINT) AS site FROM customer JOIN supplier ON s_nationkey = c_nationkey AND s_suppkey % 8 = c_custkey % 8")
def capture_edges(spark, sf_dir):
    uses = read(spark, sf_dir, "customer").select(_c("c_nationkey").alias("method"), (_c("c_custkey") % 8).alias("name"), _c("c_custkey").alias("node"))
    outer = read(spark, sf_dir, "supplier").select(_c("s_nationkey").alias("method"), (_c("s_suppkey") % 8).alias("name"), _c("s_suppkey").alias("outer"))
    return ops.capture_edges(uses, outer)


@query(
    PTS_WALK
    + """, known AS (SELECT DISTINCT var AS base, CAST(substr(obj, 2) AS BIGINT) % 7 AS class FROM pts WHERE NOT contains(var, '.')),
calls AS (SELECT p_partkey AS site, 'm' || (p_partkey % 40) AS caller, 'v' || p_partkey AS base, p_size % 3 AS name FROM part), lookup AS (SELECT c AS class, n AS name, 'm' || (c * 5 + n) AS method FROM range(7) t(c), range(3) u(n)),
above AS (SELECT DISTINCT 'm' || (p_partkey % 40) AS caller, 'm' || (p_partkey % 13) AS callee FROM part WHERE p_size > 45)
SELECT DISTINCT site, caller, method AS callee FROM calls JOIN known USING (base) JOIN lookup USING (class, name) WHERE caller <> method AND NOT EXISTS (SELECT 1 FROM above a WHERE a.callee = calls.caller AND a.caller = method)"""
)
def dispatch_on_points_to(spark, sf_dir):
    p, k = read(spark, sf_dir, "part"), _c("p_partkey")
    pts = _points_to(spark, sf_dir)
    types = pts.select("obj").distinct().select("obj", (F.substring("obj", 2, 20).cast("long") % 7).alias("class"))
    calls = p.select(k.alias("site"), F.concat(F.lit("m"), k % 40).alias("caller"), F.concat(F.lit("v"), k).alias("base"), (_c("p_size") % 3).alias("name"))
    lookup = spark.range(7).select(_c("id").alias("class"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("name")).withColumn("method", F.concat(F.lit("m"), _c("class") * 5 + _c("name")))
    above = p.where("p_size > 45").select(F.concat(F.lit("m"), k % 40).alias("caller"), F.concat(F.lit("m"), k % 13).alias("callee")).distinct()
    return ops.dispatch(calls, pts.where("not contains(var, '.')"), types, lookup, above)


SYNTH_SQL = """calls AS (SELECT o_orderkey AS site, o_custkey AS caller, 'f' || (o_orderkey % 500) AS value FROM orders), callables AS (SELECT 'f' || p_partkey AS value, p_partkey AS method FROM part WHERE p_size % 2 = 0), taken AS (SELECT DISTINCT l_orderkey AS site FROM lineitem WHERE l_returnflag = 'R'),
j AS (SELECT * FROM calls JOIN callables USING (value) WHERE site NOT IN (SELECT site FROM taken)), edges AS (SELECT 'call' AS kind, caller AS src, method AS dst, CAST(NULL AS VARCHAR) AS field, site FROM j UNION SELECT 'return', method, caller, NULL, site FROM j)"""


def _synthetic(spark, sf_dir):
    k = _c("o_orderkey")
    calls = read(spark, sf_dir, "orders").select(k.alias("site"), _c("o_custkey").alias("caller"), F.concat(F.lit("f"), k % 500).alias("value"))
    callables = read(spark, sf_dir, "part").where("p_size % 2 = 0").select(F.concat(F.lit("f"), "p_partkey").alias("value"), _c("p_partkey").alias("method"))
    taken = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(_c("l_orderkey").alias("site")).distinct()
    return ops.synthetic_invokes(calls, callables, taken)


@query(f"WITH {SYNTH_SQL} SELECT * FROM edges")
def synthetic_invoke_edges(spark, sf_dir):
    return _synthetic(spark, sf_dir)


@query(f"WITH {SYNTH_SQL} SELECT * FROM edges WHERE src IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def lazy_edges(spark, sf_dir):
    """Only what leaves a tainted node."""
    return ops.on_frontier(_synthetic(spark, sf_dir), read(spark, sf_dir, "customer").where("c_acctbal < 0").select(_c("c_custkey").alias("node")))


# facts go from suppliers over copies of parts, which a table holds, and over calls and returns, made when asked for
LAZY_SQL = f"""WITH RECURSIVE {SYNTH_SQL}, fixed AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey % 3 = 0),
walk(node, ctx) AS (SELECT s_suppkey, CAST(-1 AS BIGINT) FROM supplier WHERE s_suppkey % 10 = 3 UNION SELECT n.node, n.ctx FROM (
  SELECT f.dst AS node, w.ctx FROM walk w JOIN fixed f ON f.src = w.node
  UNION ALL SELECT e.dst, CASE e.kind WHEN 'call' THEN e.site ELSE -1 END FROM walk w JOIN edges e ON e.src = w.node WHERE e.kind = 'call' OR w.ctx IN (-1, e.site)) n)
"""


def _lazily(spark, sf_dir):
    k, p = _c("o_orderkey"), read(spark, sf_dir, "part")
    calls = read(spark, sf_dir, "orders").select(k.alias("site"), _c("o_custkey").alias("caller"), F.concat(F.lit("f"), k % 500).alias("value"))
    callables = p.where("p_size % 2 = 0").select(F.concat(F.lit("f"), "p_partkey").alias("value"), _c("p_partkey").alias("method"))
    taken = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(_c("l_orderkey").alias("site")).distinct()
    calls, callables = written(ops.unowned(calls, taken)), written(callables)  # rounds ask them again and again
    of = lambda table, name, nodes: table.join(nodes.select(_c("node").alias(name)), name, "left_semi")
    makers = [
        lambda nodes: ops.synthetic_invokes(of(calls, "caller", nodes), callables).where("kind = 'call'"),
        lambda nodes: ops.synthetic_invokes(calls, of(callables, "method", nodes)).where("kind = 'return'"),
    ]
    none = lambda kind: F.lit(None).cast(kind)
    fixed = p.where("p_partkey % 3 = 0").select(F.lit("copy").alias("kind"), _c("p_partkey").alias("src"), F.floor(_c("p_partkey") / 2).alias("dst"), none("string").alias("field"), none("long").alias("site"))
    seeds = read(spark, sf_dir, "supplier").where("s_suppkey % 10 = 3").select(_c("s_suppkey").alias("node"), F.array().cast(taint.EMPTY_CTX).alias("ctx"), F.array().cast(taint.EMPTY_PATH).alias("path"), F.lit("s").alias("source"))
    return taint.propagate_lazily(seeds, fixed, makers, 1)


@query(LAZY_SQL + "SELECT node, CASE WHEN ctx = -1 THEN '' ELSE CAST(ctx AS VARCHAR) END AS ctx FROM walk")
def lazy_propagation(spark, sf_dir):
    """The facts that all edges together would give."""
    return _lazily(spark, sf_dir)[0].select("node", F.array_join("ctx", ",").alias("ctx"))


@query(LAZY_SQL + "SELECT kind, src, dst, site FROM edges WHERE src IN (SELECT node FROM walk)")
def lazy_edges_made(spark, sf_dir):
    """The edges that were made for them: those of reached nodes, no others."""
    return _lazily(spark, sf_dir)[1].select("kind", "src", "dst", "site")


BIND_SQL = "calls AS (SELECT o_orderkey AS site, [o_orderkey * 3, o_orderkey * 3 + 1, o_orderkey * 3 + 2] AS args, o_custkey AS callback, o_orderkey % 2 AS skip FROM orders)"


@query(f"WITH {BIND_SQL}, a AS (SELECT site, callback, i - skip AS pos, args[i + 1] AS arg FROM calls, range(3) t(i)) SELECT DISTINCT 'copy' AS kind, arg AS src, callback * 10 + pos AS dst, CAST(NULL AS VARCHAR) AS field, site FROM a WHERE pos >= 0 AND pos < 2")
def callback_parameter_edges(spark, sf_dir):
    k = _c("o_orderkey")
    o = read(spark, sf_dir, "orders")
    calls = o.select(k.alias("site"), F.array(k * 3, k * 3 + 1, k * 3 + 2).alias("args"))
    bindings = o.select(k.alias("site"), _c("o_custkey").alias("callback"), (k % 2).alias("skip"))
    parameters = o.select(_c("o_custkey").alias("callback")).distinct().select("callback", F.explode(F.array(F.lit(0), F.lit(1))).alias("pos")).withColumn("node", _c("callback") * 10 + _c("pos"))
    return ops.callback_parameters(calls, bindings, parameters)


@query("WITH b AS (SELECT DISTINCT o_orderkey AS site, o_custkey % 100 AS callback FROM orders) SELECT DISTINCT 'copy' AS kind, s_suppkey AS src, site AS dst, CAST(NULL AS VARCHAR) AS field, CAST(NULL AS BIGINT) AS site FROM b JOIN supplier ON s_suppkey % 100 = callback")
def callback_capture_edges(spark, sf_dir):
    """Captured locals of a callback at the site that registers it."""
    uses = read(spark, sf_dir, "orders").select((_c("o_custkey") % 100).alias("method"), F.lit("captured").alias("name"), _c("o_orderkey").alias("node"))
    outer = read(spark, sf_dir, "supplier").select((_c("s_suppkey") % 100).alias("method"), F.lit("captured").alias("name"), _c("s_suppkey").alias("outer"))
    return ops.capture_edges(uses, outer)


@query(
    """WITH stores AS (SELECT DISTINCT 'n:' || s_nationkey AS class, 'f' || (s_suppkey % 3) AS field, s_suppkey AS callback FROM supplier), invokes AS (SELECT c_custkey AS site, 'c:' || c_custkey AS class, 'f' || (c_custkey % 4) AS field FROM customer)
SELECT DISTINCT site, callback FROM invokes i JOIN customer ON c_custkey = i.site JOIN stores s ON s.class = 'n:' || c_nationkey AND s.field = i.field"""
)
def stored_callbacks(spark, sf_dir):
    s, c = _c("s_suppkey"), _c("c_custkey")
    stores = read(spark, sf_dir, "supplier").select(F.concat(F.lit("n:"), "s_nationkey").alias("class"), F.concat(F.lit("f"), s % 3).alias("field"), s.alias("callback"))
    customer = read(spark, sf_dir, "customer")
    invokes = customer.select(c.alias("site"), F.concat(F.lit("c:"), c).alias("class"), F.concat(F.lit("f"), c % 4).alias("field"))
    h = customer.select(F.concat(F.lit("c:"), c).alias("child"), F.concat(F.lit("n:"), "c_nationkey").alias("parent"))
    return ops.stored_callbacks(stores, invokes, graph.subtypes(h, stores))


@query("SELECT DISTINCT l_orderkey AS method, l_returnflag AS source, r.flag AS target FROM lineitem JOIN (SELECT l_orderkey AS m, l_partkey % 5 AS v, l_linestatus AS flag FROM lineitem) r ON r.m = l_orderkey AND r.v = l_partkey % 5 WHERE l_returnflag <> r.flag")
def field_bridges(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    row = lambda f: li.select(_c("l_orderkey").alias("method"), _c(f).alias("field"), (_c("l_partkey") % 5).alias("value"))
    return ops.field_bridges(row("l_returnflag"), row("l_linestatus"))


@query("WITH i AS (SELECT l_suppkey AS class, l_linenumber AS field, max_by(l_partkey, (l_orderkey, l_partkey)) AS value FROM lineitem GROUP BY 1, 2) SELECT 'copy' AS kind, value AS src, s_suppkey * 10 + field AS dst, CAST(field AS VARCHAR) AS field, CAST(NULL AS BIGINT) AS site FROM i JOIN supplier ON s_suppkey = class")
def static_init_stores(spark, sf_dir):
    inits = read(spark, sf_dir, "lineitem").select(_c("l_suppkey").alias("class"), _c("l_linenumber").alias("field"), F.struct("l_orderkey", "l_partkey").alias("order"), _c("l_partkey").alias("value"))
    reads = read(spark, sf_dir, "supplier").select(_c("s_suppkey").alias("class"), F.explode(F.sequence(F.lit(1), F.lit(7))).alias("field")).withColumn("node", _c("class") * 10 + _c("field"))
    return ops.static_init_stores(inits, reads)


HALF_SQL = "ways AS (SELECT DISTINCT p_partkey AS src, unnest([p_partkey // 2, p_partkey // 3]) AS dst FROM part)"


def _halves(spark, sf_dir):
    k = _c("p_partkey")
    return read(spark, sf_dir, "part").select(k.alias("src"), F.explode(F.array(F.floor(k / 2), F.floor(k / 3))).alias("dst")).distinct()


@query(f"WITH RECURSIVE {HALF_SQL}, walk(unit, node, hops) AS (SELECT s_suppkey, s_suppkey, 0 FROM supplier WHERE s_suppkey > 0 UNION SELECT unit, src, hops + 1 FROM walk JOIN ways ON dst = node WHERE hops < 3) , f AS (SELECT unit, node, min(hops) AS hops FROM walk GROUP BY unit, node), cut AS (SELECT DISTINCT unit FROM f WHERE hops = 3 AND node IN (SELECT dst FROM ways)) SELECT unit, node, hops, unit IN (SELECT unit FROM cut) AS truncated FROM f")
def activation_paths(spark, sf_dir):
    s = _c("s_suppkey")
    return ops.activation_paths(_halves(spark, sf_dir), read(spark, sf_dir, "supplier").where(s > 0).select(s.alias("unit"), s.alias("node")), 3)


@query(f"WITH RECURSIVE {HALF_SQL}, walk(promise, node, hops) AS (SELECT p_partkey, p_partkey, 0 FROM part UNION SELECT promise, dst, hops + 1 FROM walk JOIN ways ON src = node WHERE hops < 8), f AS (SELECT promise, node, min(hops) AS hops FROM walk GROUP BY promise, node), r AS (SELECT *, row_number() OVER (PARTITION BY promise ORDER BY hops, node) AS place, count(*) OVER (PARTITION BY promise) > 256 OR max(hops) OVER (PARTITION BY promise) >= 8 AS truncated FROM f) SELECT promise, node AS source, truncated FROM r WHERE place <= 256 AND node IN (SELECT p_partkey FROM part WHERE p_size % 5 = 0)")
def promise_sources(spark, sf_dir):
    k = _c("p_partkey")
    p = read(spark, sf_dir, "part")
    return ops.fulfilment_sources(_halves(spark, sf_dir), p.select(k.alias("promise"), k.alias("node")), p.where("p_size % 5 = 0").select(k.alias("node")))


@query("WITH c AS (SELECT o_orderkey AS site, CASE o_orderkey % 3 WHEN 0 THEN 'set' WHEN 1 THEN 'get' ELSE 'link' END AS op, 'cell:' || o_custkey AS cell, CAST(o_orderkey AS VARCHAR) AS node FROM orders WHERE o_orderstatus <> 'P') SELECT 'copy' AS kind, node AS src, cell AS dst, CAST(NULL AS VARCHAR) AS field, CAST(NULL AS BIGINT) AS site FROM c WHERE op IN ('set', 'link') UNION ALL SELECT 'copy', cell, node, NULL, NULL FROM c WHERE op IN ('get', 'link')")
def storage_plugin(spark, sf_dir):
    k = _c("o_orderkey")
    calls = read(spark, sf_dir, "orders").select(k.alias("site"), F.when(k % 3 == 0, "set").when(k % 3 == 1, "get").otherwise("link").alias("op"), F.when(_c("o_orderstatus") != "P", _c("o_custkey")).alias("key"), k.alias("node"))
    return ops.generated({"storage": (calls,)})


@query("SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'store' ELSE 'load' END AS kind, CAST(CASE WHEN l_linenumber % 2 = 0 THEN l_orderkey ELSE l_suppkey END AS VARCHAR) AS src, CAST(CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey ELSE l_orderkey END AS VARCHAR) AS dst, 'element' AS field, CAST(NULL AS BIGINT) AS site FROM lineitem")
def container_plugin(spark, sf_dir):
    n = _c("l_linenumber")
    calls = read(spark, sf_dir, "lineitem").select(_c("l_orderkey").alias("site"), F.when(n % 4 == 0, "push").when(n % 4 == 2, "add").when(n % 4 == 1, "get").otherwise("pop").alias("op"), _c("l_suppkey").alias("base"), _c("l_orderkey").alias("node"))
    return ops.generated({"container": (calls,)})


def _function_calls(spark, sf_dir):
    k, c = _c("o_orderkey"), _c("o_custkey")
    calls = read(spark, sf_dir, "orders").select(k.alias("site"), F.when(k % 3 == 0, "call").when(k % 3 == 1, "apply").otherwise("bind").alias("op"), c.alias("function"), F.array(k * 3, k * 3 + 1, k * 3 + 2).alias("args"))
    parameters = read(spark, sf_dir, "customer").select(_c("c_custkey").alias("function"), F.explode(F.sequence(F.lit(-1), F.lit(1))).alias("pos")).withColumn("node", _c("function") * 10 + _c("pos") + 1)
    return calls, parameters


ARGS_SQL = "c AS (SELECT o_orderkey AS site, o_orderkey % 3 AS op, o_custkey AS function, i AS slot, o_orderkey * 3 + i AS arg FROM orders, range(3) t(i)), p AS (SELECT c_custkey AS function, i AS pos, c_custkey * 10 + i + 1 AS node FROM customer, range(-1, 2) t(i))"


@query(f"WITH {ARGS_SQL} SELECT 'copy' AS kind, CAST(arg AS VARCHAR) AS src, CAST(node AS VARCHAR) AS dst, CAST(NULL AS VARCHAR) AS field, site FROM c JOIN p ON p.function = c.function AND p.pos = c.slot")
def task_plugin(spark, sf_dir):
    calls, parameters = _function_calls(spark, sf_dir)
    return ops.generated({"task": (calls, parameters)})


@query(f"WITH {ARGS_SQL} SELECT 'copy' AS kind, CAST(arg AS VARCHAR) AS src, CAST(node AS VARCHAR) AS dst, CASE WHEN op = 1 AND slot = 1 THEN 'arr:*' END AS field, site FROM c JOIN p ON p.function = c.function AND p.pos = CASE WHEN op = 1 THEN CASE slot WHEN 0 THEN -1 WHEN 1 THEN 0 END ELSE c.slot - 1 END")
def function_plugin(spark, sf_dir):
    return ops.generated({"function": _function_calls(spark, sf_dir)})


# ---------------------------------------------------------------- field rules


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 14 = 0 THEN 'not-field' WHEN o_orderkey % 5 = 0 THEN 'invalid-field' ELSE 'location' END AS status, CASE WHEN o_orderkey % 14 > 0 AND o_orderkey % 5 > 0 THEN array_to_string(list_transform(range(1, least(o_orderkey % 14, 12) + 1), lambda i: 'f' || i), '.') END AS path, CASE WHEN o_orderkey % 14 > 0 AND o_orderkey % 5 > 0 THEN CASE WHEN o_orderkey % 14 > 12 THEN 'partial' ELSE 'exact' END END AS precision FROM orders")
def field_endpoint_projection(spark, sf_dir):
    k = _c("o_orderkey")
    path = F.transform(F.when(k % 14 == 0, F.array().cast("array<bigint>")).otherwise(F.sequence(F.lit(1).cast("bigint"), k % 14)), lambda i: F.when(k % 5 == 0, F.lit(" ")).otherwise(F.concat(F.lit("f"), i)))
    out = fields.projection(path, F.lit("exact"))
    return read(spark, sf_dir, "orders").select(k.alias("id"), out["status"].alias("status"), out["path"].alias("path"), out["precision"].alias("precision"))


@query("WITH s AS (SELECT l_orderkey * 10 + l_linenumber AS stmt, l_partkey AS lb, l_suppkey AS rb, l_returnflag AS lf, CASE WHEN l_linestatus = 'O' THEN l_linestatus END AS rf, l_partkey % 4 AS lw, l_suppkey % 4 AS rw FROM lineitem), w AS (SELECT ['local', 'instance', 'static', 'array'] AS w), r AS (SELECT stmt, 'store' AS access, w[lw + 1] AS way, lb AS base, lf AS field FROM s, w UNION ALL SELECT stmt, 'load', w[rw + 1], rb, rf FROM s, w) SELECT stmt, access, way, base, CASE WHEN way = 'array' THEN 'arr:' || coalesce(field, '*') ELSE field END AS field FROM r WHERE way <> 'local'")
def field_accesses(spark, sf_dir):
    ways = F.lit(["local", "instance", "static", "array"])
    ref = lambda base, field: F.struct(F.element_at(ways, (_c(base) % 4 + 1).cast("int")).alias("way"), _c(base).alias("base"), field.alias("field"))
    li = read(spark, sf_dir, "lineitem")
    return fields.accesses(li.select((_c("l_orderkey") * 10 + _c("l_linenumber")).alias("stmt"), ref("l_partkey", _c("l_returnflag")).alias("left"), ref("l_suppkey", F.when(_c("l_linestatus") == "O", _c("l_linestatus"))).alias("right")))


@query(PTS_WALK + ", loads_ AS (SELECT 'v' || l_partkey AS base, 'f' || (l_linenumber % 3) AS field, l_orderkey AS dst FROM lineitem) SELECT coalesce(obj, base) AS owner, field, count(DISTINCT dst) AS targets, min(dst) AS first FROM loads_ LEFT JOIN pts ON base = var GROUP BY 1, 2")
def field_index(spark, sf_dir):
    loads = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("v"), "l_partkey").alias("base"), F.concat(F.lit("f"), _c("l_linenumber") % 3).alias("field"), _c("l_orderkey").alias("dst"))
    found = fields.field_index(loads, _points_to(spark, sf_dir))
    return found.select("owner", "field", F.size("targets").cast("long").alias("targets"), F.element_at("targets", 1).alias("first"))


@query("SELECT DISTINCT o_orderkey AS node, 'k' || (o_orderkey % 3) || CASE WHEN c_custkey % 2 = 0 THEN '.f' ELSE '' END AS path, c_mktsegment AS source FROM customer JOIN orders ON o_custkey = c_custkey")
def literal_captures(spark, sf_dir):
    none = F.array().cast("array<string>")
    facts = read(spark, sf_dir, "customer").select(_c("c_custkey").alias("node"), F.when(_c("c_custkey") % 2 == 0, F.array(F.lit("f"))).otherwise(none).alias("path"), _c("c_mktsegment").alias("source"))
    literals = read(spark, sf_dir, "orders").select(_c("o_orderkey").alias("obj"), F.concat(F.lit("k"), _c("o_orderkey") % 3).alias("key"), _c("o_custkey").alias("node"))
    return fields.literal_captures(literals, facts).select("node", F.array_join("path", ".").alias("path"), "source")


THIS_SQL = "facts AS (SELECT s_suppkey % 10 AS file, 'n:' || s_nationkey AS class, 'f' || (s_suppkey % 3) AS field, s_suppkey AS source FROM supplier), loads AS (SELECT c_custkey % 10 AS file, CASE WHEN c_custkey % 5 > 0 THEN c_nationkey END AS nation, 'f' || (c_custkey % 3) AS field, c_custkey AS dst FROM customer)"


@query(f"WITH {THIS_SQL} SELECT DISTINCT dst, source FROM loads l JOIN facts f ON l.file = f.file AND l.field = f.field WHERE l.nation IS NULL OR f.class = 'n:' || l.nation")
def unresolved_this_loads(spark, sf_dir):
    s, c = _c("s_suppkey"), _c("c_custkey")
    facts = read(spark, sf_dir, "supplier").select((s % 10).alias("file"), F.concat(F.lit("n:"), "s_nationkey").alias("class"), F.concat(F.lit("f"), s % 3).alias("field"), s.alias("source"))
    customer = read(spark, sf_dir, "customer")
    loads = customer.select((c % 10).alias("file"), F.when(c % 5 > 0, F.concat(F.lit("c:"), c)).alias("class"), F.concat(F.lit("f"), c % 3).alias("field"), c.alias("dst"))
    h = customer.select(F.concat(F.lit("c:"), c).alias("child"), F.concat(F.lit("n:"), "c_nationkey").alias("parent"))
    return fields.this_loads(facts, loads, graph.subtypes(h, facts))


@query("SELECT c_custkey AS dst, CASE WHEN c_custkey % 6 > 0 THEN c_nationkey END AS method FROM customer WHERE c_custkey % 6 = 0 OR c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 0)")
def reachable_this_loads(spark, sf_dir):
    loads = read(spark, sf_dir, "customer").select(_c("c_custkey").alias("dst"), F.when(_c("c_custkey") % 6 > 0, _c("c_nationkey")).alias("method"))
    return fields.reachable_loads(loads, read(spark, sf_dir, "supplier").where("s_acctbal > 0").select(_c("s_nationkey").alias("method")))


@query("WITH u AS (SELECT l_orderkey AS arg, l_suppkey AS base, l_returnflag AS field FROM lineitem), f AS (SELECT DISTINCT l_partkey AS obj, l_returnflag AS field, l_linestatus AS source FROM lineitem WHERE l_quantity > 45), a AS (SELECT s_suppkey AS base, unnest([s_suppkey, s_suppkey + 1]) AS obj FROM supplier) SELECT DISTINCT arg, source FROM u JOIN a USING (base) JOIN f USING (obj, field) WHERE NOT (arg % 7 = 0 AND source = 'O')")
def argument_field_uses(spark, sf_dir):
    li, s = read(spark, sf_dir, "lineitem"), _c("s_suppkey")
    uses = li.select(_c("l_orderkey").alias("arg"), _c("l_suppkey").alias("base"), _c("l_returnflag").alias("field"))
    facts = li.where("l_quantity > 45").select(_c("l_partkey").alias("obj"), _c("l_returnflag").alias("field"), _c("l_linestatus").alias("source")).distinct()
    aliases = read(spark, sf_dir, "supplier").select(s.alias("base"), F.explode(F.array(s, s + 1)).alias("obj"))
    done = read(spark, sf_dir, "orders").where("o_orderkey % 7 = 0").select(_c("o_orderkey").alias("arg"), F.lit("O").alias("source"))
    return fields.argument_uses(facts, uses, aliases, done)


@query("SELECT DISTINCT o_custkey AS node, 'k' || (o_orderkey % 20) AS field, o_orderpriority AS source FROM orders WHERE o_orderkey % 4 <> 0")
def object_from_entries(spark, sf_dir):
    k = _c("o_orderkey")
    o = read(spark, sf_dir, "orders")
    slot = lambda n, node, text: F.struct(F.lit(n).alias("slot"), node.alias("node"), text.cast("string").alias("text"))
    rows = o.select(k.alias("row"), _c("o_custkey").alias("result"), F.inline(F.array(slot(0, F.lit(-1).cast("long"), F.when(k % 4 != 0, F.concat(F.lit("k"), k % 20))), slot(1, k, F.lit(None)))))
    return fields.from_entries(rows, o.select(k.alias("node"), _c("o_orderpriority").alias("source")))


@query("SELECT DISTINCT l_orderkey * 10 + l_linenumber AS node, o_orderstatus AS source FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE (l_returnflag = 'A' OR (l_returnflag = 'R' AND o_orderkey % 2 = 0)) AND l_returnflag = CASE WHEN o_custkey % 2 = 0 THEN 'A' ELSE 'R' END")
def query_result_facts(spark, sf_dir):
    o, k = read(spark, sf_dir, "orders"), _c("o_orderkey")
    queries = o.select(k.alias("result"), F.when(k % 2 == 0, F.lit(["A", "R"])).otherwise(F.lit(["A"])).alias("columns"))
    reads = read(spark, sf_dir, "lineitem").select(_c("l_orderkey").alias("result"), _c("l_returnflag").alias("column"), (_c("l_orderkey") * 10 + _c("l_linenumber")).alias("node"))
    facts = o.select(k.alias("result"), F.when(_c("o_custkey") % 2 == 0, "A").otherwise("R").alias("field"), _c("o_orderstatus").alias("source"))
    return fields.query_results(queries, reads, facts)


@query("WITH l AS (SELECT DISTINCT l_suppkey AS src, l_returnflag AS selector, l_orderkey AS local FROM lineitem), s AS (SELECT DISTINCT l_partkey AS dst, l_returnflag AS selector, l_orderkey AS local FROM lineitem) SELECT DISTINCT src, dst FROM l JOIN s USING (selector, local) WHERE src <> dst")
def selector_mirrors(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    row = lambda base: li.select(_c(base).alias("base"), _c("l_returnflag").alias("selector"), _c("l_orderkey").alias("local")).distinct()
    return fields.mirrors(row("l_suppkey"), row("l_partkey"))


@query("SELECT DISTINCT o_custkey AS node, l_returnflag AS field, l_linestatus AS source FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def captured_field_writes(spark, sf_dir):
    writes = read(spark, sf_dir, "lineitem").select(_c("l_orderkey").alias("inner"), _c("l_returnflag").alias("field"), _c("l_linestatus").alias("source"))
    return fields.captured_writes(writes, read(spark, sf_dir, "orders").select(_c("o_orderkey").alias("inner"), _c("o_custkey").alias("outer")))


@query("WITH f AS (SELECT o_custkey AS node, CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END AS head FROM orders), p AS (SELECT s_suppkey AS put, s_suppkey * 3 AS node, CASE WHEN s_suppkey % 2 = 0 THEN 'F' END AS field FROM supplier) SELECT DISTINCT node, coalesce(head || '.x', '') AS path, put FROM f JOIN p USING (node) WHERE field IS NULL OR field = head")
def facts_at_puts(spark, sf_dir):
    s, none = _c("s_suppkey"), F.array().cast("array<string>")
    facts = read(spark, sf_dir, "orders").select(_c("o_custkey").alias("node"), F.when(_c("o_orderkey") % 3 > 0, F.array("o_orderstatus", F.lit("x"))).otherwise(none).alias("path"))
    puts = read(spark, sf_dir, "supplier").select(s.alias("put"), (s * 3).alias("node"), F.when(s % 2 == 0, "F").alias("field"))
    return fields.put_effects(facts, puts).select("node", F.array_join("path", ".").alias("path"), "put")


@query(PTS_WALK + "SELECT DISTINCT obj AS carrier, var AS local FROM pts WHERE NOT contains(var, '.')")
def alias_locals(spark, sf_dir):
    pts = _points_to(spark, sf_dir)
    return fields.alias_locals(pts.where("not contains(var, '.')"), pts.select(_c("obj").alias("carrier"), "obj").distinct())


@query(f"WITH RECURSIVE {HALF_SQL}, walk(value, node, hops) AS (SELECT c_custkey, c_custkey, 0 FROM customer UNION SELECT value, dst, hops + 1 FROM walk JOIN ways ON src = node WHERE hops < 4), f AS (SELECT value, node, min(hops) AS hops FROM walk GROUP BY value, node), cut AS (SELECT DISTINCT value FROM f WHERE hops = 4 AND node IN (SELECT src FROM ways)) SELECT DISTINCT value, s_suppkey * 7 AS obj, value IN (SELECT value FROM cut) AS truncated FROM f JOIN supplier ON s_suppkey = node")
def carriers_at_statement(spark, sf_dir):
    c, s = _c("c_custkey"), _c("s_suppkey")
    values = read(spark, sf_dir, "customer").select(c.alias("value"), c.alias("node"))
    assigns = _halves(spark, sf_dir).select(_c("src").alias("dst"), _c("dst").alias("src"))
    return fields.carriers_at(values, assigns, read(spark, sf_dir, "supplier").select(s.alias("node"), (s * 7).alias("obj")), 4)
