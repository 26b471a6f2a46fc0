"""Queries over entries and their contracts, and over program text and structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import entries, ir, sets
from ..operators import trace as ops
from ..sources import readers, writers
from ..sources.fixtures import TRACE_SQL, read, trace
from . import engine, schedule
from .queries_identity import FAMILIES, SCHED_SQL
from .registry import query


def _c(name):
    return F.col(name)


# ---------------------------------------------------------------- entries


@query("SELECT DISTINCT o_custkey AS method, o_orderpriority AS asset FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def entry_seeds(spark, sf_dir):
    assets = read(spark, sf_dir, "orders").select(_c("o_orderpriority").alias("asset"), _c("o_custkey").alias("method"))
    return entries.seeds(assets, read(spark, sf_dir, "customer").where("c_acctbal > 0").select(_c("c_custkey").alias("method")))


FACTS_SQL = """facts AS (SELECT c_custkey AS method, 'ability_lifecycle' AS kind FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT c_custkey, 'page_build' FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT c_custkey, 'ui_callback' FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT c_custkey, 'state_watch' FROM customer WHERE c_acctbal < 0 UNION ALL SELECT c_custkey, 'explicit_seed' FROM customer WHERE c_nationkey = 7)"""


def _facts(spark, sf_dir):
    k = _c("c_custkey")
    methods = read(spark, sf_dir, "customer").withColumn("method", k)
    return entries.facts(methods, {"ability_lifecycle": k % 10 == 0, "page_build": _c("c_mktsegment") == "BUILDING", "ui_callback": k % 3 == 0, "state_watch": _c("c_acctbal") < 0, "explicit_seed": _c("c_nationkey") == 7})


@query(f"WITH {FACTS_SQL} SELECT method, kind, 'scan ' || kind AS reason FROM facts")
def entry_facts(spark, sf_dir):
    return _facts(spark, sf_dir)


@query(f"WITH {FACTS_SQL}, p AS (SELECT *, CASE kind WHEN 'page_build' THEN 1 WHEN 'ui_callback' THEN 2 WHEN 'state_watch' THEN 3 ELSE 0 END AS rank FROM facts) SELECT method, ['bootstrap', 'composition', 'interaction', 'reactive_handoff'][min(rank) + 1] AS phase, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, any_value(c_nationkey) AS parameters FROM p JOIN customer ON c_custkey = method GROUP BY method")
def entry_contracts(spark, sf_dir):
    methods = read(spark, sf_dir, "customer").select(_c("c_custkey").alias("method"), _c("c_nationkey").alias("parameters"))
    return entries.contracts(_facts(spark, sf_dir), methods).select("method", "phase", F.array_join("kinds", ",").alias("kinds"), "parameters")


def _scheduled(spark, sf_dir):
    k = _c("p_partkey")
    roots = read(spark, sf_dir, "nation").where("n_nationkey < 3").select(F.concat(F.lit("m"), "n_nationkey").alias("method"))
    edges = read(spark, sf_dir, "part").where("p_partkey > 2").select(F.element_at(F.lit(FAMILIES), (k % 9 + 1).cast("int")).alias("family"), F.concat(F.lit("m"), F.floor(k / 4)).alias("src"), F.concat(F.lit("m"), k).alias("dst"))
    return schedule.activation_schedule(roots, edges)[0], edges


@query(f"WITH {SCHED_SQL} SELECT DISTINCT w.src, w.dst, w.family, CASE WHEN a.round < b.round THEN 'forward' ELSE 'feedback' END AS kind FROM ways w JOIN s4 a ON a.method = w.src JOIN s4 b ON b.method = w.dst WHERE w.src <> w.dst")
def entry_bridges(spark, sf_dir):
    found, edges = _scheduled(spark, sf_dir)
    return entries.bridges(edges, found)


@query(f"WITH {SCHED_SQL}, r AS (SELECT b.method, string_agg(DISTINCT w.family || '<-' || w.src, ',' ORDER BY w.family || '<-' || w.src) AS reasons FROM ways w JOIN s4 a ON a.method = w.src JOIN s4 b ON b.method = w.dst WHERE a.round < b.round GROUP BY b.method) SELECT method, round, phase, coalesce(reasons, CASE WHEN round = 0 THEN 'root' ELSE 'rule' END) AS reasons FROM s4 LEFT JOIN r USING (method)")
def entry_reasons(spark, sf_dir):
    found, edges = _scheduled(spark, sf_dir)
    return entries.explained(found, edges).select("method", "round", "phase", F.array_join("reasons", ",").alias("reasons"))


@query(f"WITH {SCHED_SQL} SELECT '@root' AS caller, method AS callee, row_number() OVER (ORDER BY round, list_position(['bootstrap', 'composition', 'interaction', 'reactive_handoff', 'teardown'], phase), method) AS place FROM s4")
def synthetic_root(spark, sf_dir):
    return entries.root_calls(_scheduled(spark, sf_dir)[0])


@query("WITH h AS (SELECT DISTINCT s_nationkey AS class, ['onCreate', 'onShow', 'onHide', 'other'][s_suppkey % 4 + 1] AS hook, s_suppkey % 4 + 1 AS pos FROM supplier) SELECT '@main/' || class AS caller, CAST(0 AS BIGINT) AS stmt, 'new' AS op, CAST(class AS VARCHAR) AS target FROM (SELECT DISTINCT class FROM h) UNION ALL SELECT '@main/' || class, pos, 'call', class || '.' || hook FROM h WHERE hook <> 'other'")
def lifecycle_main(spark, sf_dir):
    hooks = F.element_at(F.lit(["onCreate", "onShow", "onHide", "other"]), (_c("s_suppkey") % 4 + 1).cast("int"))
    classes = read(spark, sf_dir, "supplier").select(_c("s_nationkey").cast("string").alias("class"), hooks.alias("hook"))
    return entries.lifecycle_main(classes, ["onCreate", "onShow", "onHide"])


# ---------------------------------------------------------------- text and structure


def _statements(spark, sf_dir):
    n = _c("l_linenumber")
    return read(spark, sf_dir, "lineitem").select(_c("l_orderkey").alias("method"), n.alias("idx"), F.when(n % 2 == 0, "call").otherwise("assign").alias("op"), F.concat(F.lit("v"), "l_partkey").alias("text"))


@query("SELECT l_orderkey AS method, CAST(l_linenumber AS BIGINT) AS idx, CASE WHEN l_linenumber % 2 = 0 THEN 'call' ELSE 'assign' END AS op, 'v' || l_partkey AS text FROM lineitem")
def ir_json_round_trip(spark, sf_dir):
    return ir.from_json(ir.to_json(_statements(spark, sf_dir)))


@query("SELECT l_orderkey AS method, string_agg(repeat('  ', l_linenumber % 3) || 'v' || l_partkey, chr(10) ORDER BY l_linenumber, repeat('  ', l_linenumber % 3) || 'v' || l_partkey) AS text FROM lineitem GROUP BY l_orderkey")
def ir_printed(spark, sf_dir):
    return ir.printed(_statements(spark, sf_dir).withColumn("depth", _c("idx") % 3))


@query(
    """WITH o AS (SELECT o_orderkey AS id, ['+', '-', '*', '%', '&', '|', '^', '<', '<=', '>', '>=', '==', '!=', '&&', '||', '??', '~', '!', 'in'][o_orderkey % 19 + 1] AS op, CASE WHEN o_orderkey % 5 > 0 THEN o_custkey % 7 END AS a, o_custkey % 4 AS b FROM orders)
SELECT id, op, CAST(CASE op WHEN '+' THEN a + b WHEN '-' THEN CASE WHEN a IS NULL THEN -b ELSE a - b END WHEN '*' THEN a * b WHEN '%' THEN CASE WHEN b <> 0 THEN a % b END WHEN '&' THEN a & b WHEN '|' THEN a | b WHEN '^' THEN xor(a, b) WHEN '<' THEN CAST(a < b AS BIGINT) WHEN '<=' THEN CAST(a <= b AS BIGINT) WHEN '>' THEN CAST(a > b AS BIGINT) WHEN '>=' THEN CAST(a >= b AS BIGINT)
  WHEN '==' THEN CAST(a = b AS BIGINT) WHEN '!=' THEN CAST(a <> b AS BIGINT) WHEN '&&' THEN CASE WHEN a = 0 THEN a ELSE b END WHEN '||' THEN CASE WHEN a <> 0 THEN a ELSE b END WHEN '??' THEN coalesce(a, b) WHEN '~' THEN -b - 1 WHEN '!' THEN CAST(b = 0 AS BIGINT) END AS BIGINT) AS value FROM o"""
)
def folded_operators(spark, sf_dir):
    k, c = _c("o_orderkey"), _c("o_custkey")
    names = ["+", "-", "*", "%", "&", "|", "^", "<", "<=", ">", ">=", "==", "!=", "&&", "||", "??", "~", "!", "in"]
    o = read(spark, sf_dir, "orders").select(k.alias("id"), F.element_at(F.lit(names), (k % 19 + 1).cast("int")).alias("op"), F.when(k % 5 > 0, c % 7).alias("a"), (c % 4).alias("b"))
    return o.select("id", "op", ir.folded(_c("op"), _c("a"), _c("b")).alias("value"))


@query("SELECT o_orderkey AS site, o_custkey AS method FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))")
def sdk_provenance(spark, sf_dir):
    calls = read(spark, sf_dir, "orders").select(_c("o_orderkey").alias("site"), _c("o_custkey").alias("method"))
    origins = read(spark, sf_dir, "customer").select(_c("c_custkey").alias("method"), _c("c_mktsegment").alias("origin"))
    return ir.provenance_filter(calls, origins, ("BUILDING", "MACHINERY")).select("site", "method")


@query("SELECT l_suppkey % 10 AS \"group\", count(DISTINCT l_partkey) AS members FROM lineitem GROUP BY 1")
def bitmap_unions(spark, sf_dir):
    """Sets of parts by supplier as bitmaps, united by groups of suppliers."""
    maps = ir.bitmaps(read(spark, sf_dir, "lineitem").select(_c("l_suppkey").alias("owner"), _c("l_partkey").alias("id")))
    return ir.union_sizes(maps.select((_c("owner") % 10).alias("group"), "bucket", "bits"))


@query(
    """WITH sets AS (SELECT DISTINCT l_suppkey AS owner, l_partkey % 40 + CASE WHEN l_suppkey % 3 = 0 THEN 70000 ELSE 0 END AS id FROM lineitem WHERE l_suppkey % 7 > 0),
pairs AS (SELECT s_suppkey AS a, s_suppkey // 2 AS b FROM supplier UNION SELECT s_suppkey, s_suppkey + 3 FROM supplier),
l AS (SELECT p.a, p.b, s.id FROM pairs p JOIN sets s ON s.owner = p.a), r AS (SELECT p.a, p.b, s.id FROM pairs p JOIN sets s ON s.owner = p.b),
j AS (SELECT coalesce(l.a, r.a) AS a, coalesce(l.b, r.b) AS b, count_if(l.id IS NOT NULL AND r.id IS NOT NULL) AS common, count_if(r.id IS NULL) AS only_a, count_if(l.id IS NULL) AS only_b FROM l FULL JOIN r ON l.a = r.a AND l.b = r.b AND l.id = r.id GROUP BY 1, 2)
SELECT a, b, CAST(coalesce(common, 0) AS BIGINT) AS common, CAST(coalesce(only_a, 0) AS BIGINT) AS only_a, CAST(coalesce(only_b, 0) AS BIGINT) AS only_b, coalesce(only_a, 0) = 0 AND coalesce(only_b, 0) = 0 AS equal, coalesce(only_a, 0) = 0 AS within FROM pairs LEFT JOIN j USING (a, b)"""
)
def bitmap_comparisons(spark, sf_dir):
    """Intersection, differences and equality of suppliers' sets; every seventh set is empty."""
    s = _c("l_suppkey")
    rows = read(spark, sf_dir, "lineitem").where(s % 7 > 0).select(s.alias("owner"), (_c("l_partkey") % 40 + F.when(s % 3 == 0, 70000).otherwise(0)).alias("id"))
    k = _c("s_suppkey")
    pairs = read(spark, sf_dir, "supplier").select(k.alias("a"), F.explode(F.array(F.floor(k / 2), k + 3)).alias("b"))
    return ir.compared(ir.bitmaps(rows), pairs)


@query("SELECT l_orderkey AS method, r.rule, CAST(sum(CASE r.rule WHEN 'calls' THEN CAST(l_linenumber % 2 = 0 AS INTEGER) WHEN 'large' THEN CAST(l_quantity > 40 AS INTEGER) ELSE CAST(l_returnflag = 'R' AS INTEGER) END) AS BIGINT) AS hits FROM lineitem, (VALUES ('calls'), ('large'), ('returned')) r(rule) GROUP BY 1, 2")
def method_passes(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").withColumn("method", _c("l_orderkey"))
    return ir.passes(li, {"calls": _c("l_linenumber") % 2 == 0, "large": _c("l_quantity") > 40, "returned": _c("l_returnflag") == "R"})


@query("SELECT event_id AS id, CASE event_type WHEN 'click' THEN 'c' || user_id WHEN 'view' THEN 'v' ELSE upper(event_type) END AS out FROM events")
def statement_dispatch(spark, sf_dir):
    values = read(spark, sf_dir, "events").withColumns({"id": _c("event_id"), "kind": _c("event_type")})
    return ir.handled(values, {"click": F.concat(F.lit("c"), "user_id"), "view": F.lit("v")}, F.upper("kind"))


@query("WITH RECURSIVE t AS (SELECT CAST(0 AS BIGINT) AS node, 0 AS depth, '0' AS path UNION ALL SELECT p_partkey, depth + 1, path || '/' || p_partkey FROM t JOIN part ON p_partkey // 5 = node AND p_partkey > 0) SELECT * FROM t")
def view_tree(spark, sf_dir):
    k = _c("p_partkey")
    nodes = read(spark, sf_dir, "part").where("p_partkey > 0").select(k.alias("node"), F.floor(k / 5).alias("parent"))
    return ir.tree(spark.createDataFrame([(0, None)], "node long, parent long").union(nodes))


@query("WITH o AS (SELECT o_orderstatus AS section, o_orderpriority AS reason, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS total, max(o_custkey) AS most FROM orders GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY total DESC, reason) AS place FROM o) SELECT * FROM r WHERE place <= 3")
def worklist_profile(spark, sf_dir):
    return ir.profile(read(spark, sf_dir, "orders").select(_c("o_orderstatus").alias("section"), _c("o_orderpriority").alias("reason"), _c("o_custkey").alias("cost")))


@query("SELECT l_orderkey AS src, l_partkey AS dst, 'derivation' AS kind, CASE WHEN s_acctbal IS NULL OR s_acctbal < 0 THEN 'unproved' WHEN s_nationkey % 2 = 0 THEN 'blocked' ELSE 'carries' END AS status FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey UNION ALL SELECT o_custkey, o_orderkey, 'gap', 'no transfer' FROM orders WHERE o_orderstatus = 'P'")
def base_evidence_graph(spark, sf_dir):
    derivations = read(spark, sf_dir, "lineitem").select(_c("l_orderkey").alias("src"), _c("l_partkey").alias("dst"), _c("l_suppkey").alias("certificate"))
    verdicts = read(spark, sf_dir, "supplier").where("s_acctbal >= 0").select(_c("s_suppkey").alias("certificate"), F.when(_c("s_nationkey") % 2 == 0, "dead").otherwise("live").alias("verdict"))
    gaps = read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(_c("o_custkey").alias("src"), _c("o_orderkey").alias("dst"), F.lit("no transfer").alias("reason"))
    return ir.evidence_graph(derivations, verdicts, gaps)


@query("WITH e AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst, l_returnflag AS kind FROM lineitem) SELECT p_partkey AS node, p_brand AS kind, (SELECT count(*) FROM e WHERE src = p_partkey) AS uses, (SELECT count(*) FROM e WHERE dst = p_partkey) AS used FROM part")
def depends_graph(spark, sf_dir):
    edges = read(spark, sf_dir, "lineitem").select(_c("l_suppkey").alias("src"), _c("l_partkey").alias("dst"), _c("l_returnflag").alias("kind"))
    return ir.depends(read(spark, sf_dir, "part").select(_c("p_partkey").alias("node"), _c("p_brand").alias("kind")), edges)


@query("WITH s AS (SELECT o_orderkey // 2 * 2 + CASE WHEN o_orderkey % 9 = 1 THEN 0 ELSE o_orderkey % 2 END AS id, o_custkey AS method, o_orderstatus AS f, o_orderkey % 4 AS t FROM orders) SELECT DISTINCT id, 'unknown method' AS problem FROM s WHERE method NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 8 > 0) UNION SELECT id, 'repeated id' FROM s GROUP BY id HAVING count(*) > 1 UNION SELECT id, 'jump to nothing' FROM s WHERE f = 'F' AND t = 0 UNION SELECT DISTINCT l_orderkey, 'edge to nothing' FROM lineitem WHERE l_orderkey NOT IN (SELECT id FROM s)")
def ir_problems(spark, sf_dir):
    k = _c("o_orderkey")
    ident = F.floor(k / 2) * 2 + F.when(k % 9 == 1, 0).otherwise(k % 2)
    statements = read(spark, sf_dir, "orders").select(ident.alias("id"), _c("o_custkey").alias("method"), F.when(_c("o_orderstatus") == "F", "jump").otherwise("other").alias("kind"), F.when(k % 4 > 0, k).alias("target"))
    methods = read(spark, sf_dir, "customer").where("c_custkey % 8 > 0").select(_c("c_custkey").alias("method"))
    return ir.problems(statements, methods, read(spark, sf_dir, "lineitem").select(_c("l_orderkey").alias("src"), _c("l_orderkey").alias("dst")))


@query("SELECT p_brand AS owner, count(*) AS members, min(p_name) AS first, max(p_name) AS last FROM part GROUP BY p_brand")
def declaration_inventory(spark, sf_dir):
    return ir.inventory(read(spark, sf_dir, "part").select(_c("p_brand").alias("owner"), _c("p_name").alias("member")))


# ---------------------------------------------------------------- files


@query(f"WITH {TRACE_SQL}, a AS (SELECT 'fact' AS kind, id, label AS detail FROM facts), b AS (SELECT 'edge' AS kind, id, from_fact || '>' || to_fact AS detail FROM trace_edges) SELECT * FROM a UNION ALL SELECT * FROM b")
def trace_graph_round_trip(spark, sf_dir):
    """The artefacts of a trace graph, written and read again."""
    facts, edges = trace(spark, sf_dir)
    path = writers.scratch_path(spark)
    writers.trace_graph({"facts": facts, "edges": edges}, path)
    got = readers.trace_graph(spark, path)
    return got["facts"].select(F.lit("fact").alias("kind"), "id", _c("label").alias("detail")).union(got["edges"].select(F.lit("edge"), "id", F.concat_ws(">", "from_fact", "to_fact")))


@query("SELECT 'orders' AS ledger, o_orderkey AS id, o_orderstatus AS status FROM orders UNION ALL SELECT 'parts', p_partkey, p_brand FROM part")
def ledgers_as_json_lines(spark, sf_dir):
    """A folder of JSON lines for each ledger, read under a schema that fails on bad rows."""
    path = writers.scratch_path(spark)
    writers.ledgers({"orders": read(spark, sf_dir, "orders").select(_c("o_orderkey").alias("id"), _c("o_orderstatus").alias("status")), "parts": read(spark, sf_dir, "part").select(_c("p_partkey").alias("id"), _c("p_brand").alias("status"))}, path)
    one = lambda name: readers.json_table(spark, f"{path}/{name}", "id long, status string").select(F.lit(name).alias("ledger"), "id", "status")
    return one("orders").union(one("parts"))


@query("SELECT s_nationkey::VARCHAR AS section, '## ' || s_nationkey || chr(10) || '| s_suppkey | s_name |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || s_suppkey || ' | ' || s_name || ' |', chr(10) ORDER BY s_suppkey) AS text FROM supplier GROUP BY s_nationkey")
def markdown_report(spark, sf_dir):
    return writers.report(read(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", "s_name"), "s_nationkey", ["s_suppkey"])


@query("SELECT count(*) AS lines, count(DISTINCT p_name) AS names FROM part")
def file_list_scan(spark, sf_dir):
    """Lines of text files that a list of paths names, whole files as (path, text)."""
    path = writers.text_files(read(spark, sf_dir, "part").select(_c("p_name").alias("line")).repartition(3), writers.scratch_path(spark))
    files = readers.documents(spark, path, "*.txt")
    lines = files.select(F.explode(F.split(F.rtrim("text", F.lit("\n")), "\n")).alias("line")).where("line <> ''")
    return lines.agg(F.count("*").alias("lines"), F.countDistinct("line").alias("names"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS label FROM nation UNION ALL SELECT 'x:' || s_suppkey, s_name FROM supplier UNION ALL SELECT 'y:' || r_regionkey, r_name FROM region")
def appended_fragments(spark, sf_dir):
    row = lambda t, k, n: read(spark, sf_dir, t).select(_c(k).cast("string").alias("id"), _c(n).alias("label"))
    return sets.appended(row("nation", "n_nationkey", "n_name"), [("x", row("supplier", "s_suppkey", "s_name")), ("y", row("region", "r_regionkey", "r_name"))], "id")


@query("SELECT l_orderkey * 10 + l_linenumber AS id, ['preanalysis', 'coverage_ledger', 'semanticflow', 'semanticflow_llm', 'asset_validation', 'asset_promotion', 'asset_lowering', 'module_lowering', 'module', 'entry_recovery', 'source_seed', 'rule', 'ordinary', 'OCLFS', 'UDE', 'provenance', 'sink_candidate', 'sink', 'postsolve', 'reporting', 'other'][l_partkey % 21 + 1] AS stage, l_partkey % 21 < 20 AS own FROM lineitem")
def repair_hints(spark, sf_dir):
    """Every stage has a hint of its own."""
    stages = [*ops.REPAIR_HINTS, "other"]
    rows = read(spark, sf_dir, "lineitem").select((_c("l_orderkey") * 10 + _c("l_linenumber")).alias("id"), F.element_at(F.lit(stages), (_c("l_partkey") % 21 + 1).cast("int")).alias("stage"))
    return rows.select("id", "stage", (ops.repair_hint(_c("stage")) != ops.DEFAULT_HINT).alias("own"))


# each supplier is a component built by its parts in order: a third of them create, a name of every fifth is another component
BUILD_SQL = """ev AS (SELECT 'c' || (p_partkey // 20) AS view, p_partkey % 20 AS idx, CASE WHEN p_partkey % 20 = 0 OR p_size % 3 < 2 THEN 'create' ELSE 'pop' END AS kind, CASE WHEN p_size % 7 = 3 THEN 'c' || (p_partkey // 20 // 2 + p_size % 2) ELSE 'w' || (p_size % 4) END AS name FROM part),
run AS (SELECT *, sum(CASE kind WHEN 'create' THEN 1 ELSE -1 END) OVER (PARTITION BY view ORDER BY idx) AS s FROM ev), deep AS (SELECT *, CAST(s - least(min(s) OVER (PARTITION BY view ORDER BY idx), 0) - 1 AS INTEGER) AS depth FROM run),
made AS (SELECT view, idx, name, depth FROM deep WHERE kind = 'create'),
trees AS (SELECT a.view, a.idx AS node, (SELECT max(b.idx) FROM made b WHERE b.view = a.view AND b.depth = a.depth - 1 AND b.idx < a.idx) AS parent, a.name, a.depth FROM made a)
"""


def _built(spark, sf_dir):
    k, size = _c("p_partkey"), _c("p_size")
    view = F.floor(k / 20)
    name = F.when(size % 7 == 3, F.concat(F.lit("c"), F.floor(view / 2) + size % 2)).otherwise(F.concat(F.lit("w"), size % 4))
    events = read(spark, sf_dir, "part").select(F.concat(F.lit("c"), view).alias("view"), (k % 20).alias("idx"), F.when((k % 20 == 0) | (size % 3 < 2), "create").otherwise("pop").alias("kind"), name.alias("name"))
    return ir.built_tree(events)


@query(f"WITH {BUILD_SQL} SELECT view, node, parent, name, depth FROM trees")
def view_tree_of_events(spark, sf_dir):
    return _built(spark, sf_dir)


@query(
    f"""WITH RECURSIVE {BUILD_SQL}, walk(top, chain, path, parent, name, depth) AS (
  SELECT view, [view], CAST(node AS VARCHAR), CAST(parent AS VARCHAR), name, depth FROM trees WHERE view IN ('c3', 'c4', 'c8') OR CAST(substr(view, 2) AS BIGINT) % 10 = 9
  UNION ALL SELECT w.top, w.chain || [w.name], w.path || '/' || t.node, CASE WHEN t.parent IS NULL THEN w.path ELSE w.path || '/' || t.parent END, t.name, w.depth + 1 + t.depth FROM walk w JOIN trees t ON t.view = w.name WHERE NOT list_contains(w.chain, w.name))
SELECT top AS view, path, parent, name, depth, list_contains(chain, name) AS recursive FROM walk"""
)
def expanded_view_tree(spark, sf_dir):
    trees = _built(spark, sf_dir)
    n = F.substring("view", 2, 20).cast("long")
    return ir.expanded_tree(trees, trees.where(n.isin(3, 4, 8) | (n % 10 == 9)).select("view"))


GATES_SQL = """gates AS (SELECT 'g' || id AS id, from_fact, to_fact, stage, true AS attempted, status <> 'skipped' AS matched, status = 'emitted' AS emitted, CASE status WHEN 'skipped' THEN 'no match at ' || stage END AS skipped_reason, CASE status WHEN 'blocked' THEN 'stopped at ' || stage END AS blocked_reason, status FROM trace_edges)"""


@query(f"""WITH {TRACE_SQL}, {GATES_SQL}, c AS (SELECT 'c' || g.id AS id, f.method AS subject, g.status, g.id AS gate_id, coalesce(g.skipped_reason, g.blocked_reason) AS reason, g.stage FROM gates g JOIN facts f ON f.id = g.to_fact)
SELECT c.id, subject, c.status, gate_id, reason, g.matched, g.emitted, g.stage AS seen FROM c JOIN gates g ON g.id = c.gate_id""")
def trace_gates_and_coverage(spark, sf_dir):
    """Gates of a trace graph and the coverage that follows from them, written and read again."""
    facts, edges = trace(spark, sf_dir)
    status, stage = _c("status"), _c("stage")
    gates = edges.select(
        F.concat(F.lit("g"), "id").alias("id"), "from_fact", "to_fact", "stage", F.lit(True).alias("attempted"), (status != "skipped").alias("matched"), (status == "emitted").alias("emitted"),
        F.when(status == "skipped", F.concat(F.lit("no match at "), stage)).alias("skipped_reason"), F.when(status == "blocked", F.concat(F.lit("stopped at "), stage)).alias("blocked_reason"),
        F.create_map(F.lit("stage"), stage, F.lit("status"), status).alias("evidence"),
    )
    path = writers.scratch_path(spark)
    writers.trace_graph({"facts": facts, "edges": edges, "gates": gates, "coverage": ops.gate_coverage(gates, facts)}, path)
    got = readers.trace_graph(spark, path)
    g = got["gates"].select(_c("id").alias("gate_id"), "matched", "emitted", _c("evidence")["stage"].alias("seen"))
    return got["coverage"].join(g, "gate_id").select("id", "subject", "status", "gate_id", "reason", "matched", "emitted", "seen")


# an order is a method of its customer's class, in the file of its priority and the module of its status; lines are statements, two a block
PROGRAM_SQL = """st AS (SELECT o_orderstatus AS module, o_orderpriority AS file, 'c' || o_custkey AS class, 'm' || o_orderkey AS method, (l_linenumber - 1) // 2 AS block, l_linenumber AS idx, l_returnflag AS op, 'v' || l_partkey AS dst, 'v' || l_suppkey AS a FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def _methods(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select(_c("l_orderkey").alias("k"), _c("l_linenumber").cast("int").alias("idx"), F.floor((_c("l_linenumber") - 1) / 2).cast("int").alias("id"), _c("l_returnflag").alias("op"), F.concat(F.lit("v"), "l_partkey").alias("dst"), F.array(F.concat(F.lit("v"), "l_suppkey")).alias("args"), _c("l_linestatus").alias("kind"))
    blocks = li.groupBy("k", "id").agg(F.sort_array(F.collect_list(F.struct("idx", "op", "dst", "args"))).alias("statements"), F.concat_ws("@", F.max("dst"), "id").alias("var"), F.max("kind").alias("kind"))
    each = F.sort_array(F.collect_list(F.struct("id", F.array(_c("id") + 1).alias("successors"), "statements")))
    whole = blocks.groupBy("k").agg(each.alias("blocks"), F.max("id").cast("int").alias("last"), F.map_from_entries(F.collect_list(F.struct("var", "kind"))).alias("types"))
    whole = whole.withColumn("blocks", F.transform("blocks", lambda b: F.when(b["id"] == _c("last"), b.withField("successors", F.array().cast("array<int>"))).otherwise(b)))
    traps = F.when(_c("last") > 1, F.array(F.struct(F.array(F.lit(0), F.lit(1)).alias("blocks"), _c("last").alias("handler")))).otherwise(F.array())
    o = read(spark, sf_dir, "orders").select(_c("o_orderkey").alias("k"), _c("o_orderstatus").alias("module"), _c("o_orderpriority").alias("file"), F.concat(F.lit("c"), "o_custkey").alias("class"))
    return o.join(whole, "k").select("file", "class", F.concat(F.lit("m"), "k").alias("method"), F.array(F.struct(F.lit("a").alias("name"), F.lit("any").alias("type"))).alias("parameters"), "blocks", "types", traps.alias("traps"), "module")


def _project(spark, sf_dir, **only):
    path = writers.scratch_path(spark)
    writers.program(_methods(spark, sf_dir), path)
    return readers.program(spark, path, **only)


@query(f"WITH {PROGRAM_SQL} SELECT module, file, class, method, CAST(block AS INTEGER) AS block, CAST(idx AS INTEGER) AS idx, op, dst, a AS arg FROM st WHERE module IN ('F', 'P') AND file LIKE '1%'")
def project_scan(spark, sf_dir):
    """Nested methods written as a project, and the statements of some of its modules and files."""
    urgent = [r.o_orderpriority for r in read(spark, sf_dir, "orders").where("o_orderpriority like '1%'").select("o_orderpriority").distinct().collect()]  # one of five
    return readers.program_statements(_project(spark, sf_dir, modules=["F", "P"], files=urgent)).select("module", "file", "class", "method", "block", "idx", "op", "dst", _c("args")[0].alias("arg"))


@query(f"WITH {PROGRAM_SQL}, b AS (SELECT DISTINCT method, CAST(block AS INTEGER) AS block FROM st), n AS (SELECT method, max(block) AS last FROM b GROUP BY method) SELECT method, block AS src, block + 1 AS dst, 'next' AS kind FROM b JOIN n USING (method) WHERE block < last UNION ALL SELECT method, unnest([0, 1]), last, 'exception' FROM n WHERE last > 1")
def project_edges(spark, sf_dir):
    """Successors and traps of the nested methods, as read again."""
    return readers.program_edges(_project(spark, sf_dir))


@query("SELECT l_orderkey * 10 + l_linenumber AS slice, ['accept', 'reject', 'failed', 'failed', 'failed'][(l_partkey % 50) % 5 + 1] AS decision, CAST(CASE WHEN (l_partkey % 50) % 5 < 2 THEN 1 ELSE 3 END AS INTEGER) AS rounds FROM lineitem")
def modelling_session(spark, sf_dir):
    """A plain decider: texts end in a number; more text counts one on, and some always fail."""

    def decide(texts):
        rest = texts.map(lambda t: (int(t.rstrip("+").split()[-1]) + t.count("+")) % 5)
        if (rest == 4).any():
            raise ValueError("no answer")
        return rest.map({0: "accept", 1: "reject", 2: "more", 3: "more"})

    li = read(spark, sf_dir, "lineitem").select((_c("l_orderkey") * 10 + _c("l_linenumber")).alias("slice"), F.concat(F.lit("call "), _c("l_partkey") % 50).alias("text"))
    return engine.ModellingSession(decide, lambda c: F.concat(c, F.lit("+"))).run(li)
