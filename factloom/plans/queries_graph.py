"""Queries over graphs and fixpoints."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources.fixtures import HIERARCHY_SQL, RING_SQL, TRADE_SQL, hierarchy, read, ring_edges, trade_edges
from . import graph
from .fixpoint import closure, whole
from .registry import query


def _customers(spark, sf_dir):
    c = read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    return c.select(F.concat(F.lit("c:"), "c_custkey").alias("node"))


# SQL form: hop by hop over the four typed layers
LAYERS_SQL = f"""WITH {TRADE_SQL}, l0 AS (SELECT DISTINCT 'c:' || c_custkey AS node FROM customer WHERE c_mktsegment = 'BUILDING'),
l1 AS (SELECT DISTINCT dst AS node FROM edges SEMI JOIN l0 ON src = node), l2 AS (SELECT DISTINCT dst AS node FROM edges SEMI JOIN l1 ON src = node),
l3 AS (SELECT DISTINCT dst AS node FROM edges SEMI JOIN l2 ON src = node), l4 AS (SELECT DISTINCT dst AS node FROM edges SEMI JOIN l3 ON src = node),
reached AS (SELECT node, 0 AS hops FROM l0 UNION ALL SELECT node, 1 FROM l1 UNION ALL SELECT node, 2 FROM l2 UNION ALL SELECT node, 3 FROM l3 UNION ALL SELECT node, 4 FROM l4)
"""


@query(LAYERS_SQL + "SELECT node FROM reached")
def reach_from_segment(spark, sf_dir):
    return whole(closure(trade_edges(spark, sf_dir), _customers(spark, sf_dir))).select("node")


@query(LAYERS_SQL + "SELECT hops, count(*) AS nodes FROM reached GROUP BY hops")
def hop_distance(spark, sf_dir):
    found = whole(closure(trade_edges(spark, sf_dir), _customers(spark, sf_dir)))
    return found.groupBy(F.col("round").alias("hops")).agg(F.count("*").alias("nodes"))


REACH_SQL = f"WITH RECURSIVE {RING_SQL}, reach AS (SELECT src, dst FROM ring UNION SELECT r.src, g.dst FROM reach r JOIN ring g ON r.dst = g.src)\n"


@query(REACH_SQL + "SELECT src, dst FROM reach")
def cyclic_reachability(spark, sf_dir):
    return graph.reach_pairs(ring_edges(spark, sf_dir))


@query(REACH_SQL + ", nodes AS (SELECT src AS node FROM ring UNION SELECT dst FROM ring) SELECT node, least(node, (SELECT min(a.dst) FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src WHERE a.src = node)) AS component FROM nodes")
def strongly_connected(spark, sf_dir):
    return graph.components(ring_edges(spark, sf_dir))


CALLS_SQL = "calls AS (SELECT src AS caller, dst AS callee, src * 1000000 + dst AS site FROM ring)"


def _calls(spark, sf_dir):
    return ring_edges(spark, sf_dir).select(F.col("src").alias("caller"), F.col("dst").alias("callee"), (F.col("src") * 1000000 + F.col("dst")).alias("site"))


def _roots(spark, sf_dir):
    """The seventh node of each ring."""
    return read(spark, sf_dir, "part").select((F.floor(F.col("p_partkey") / 97) * 97 + 7).alias("node")).distinct()


CONTEXT_SQL = f"""WITH RECURSIVE {RING_SQL}, {CALLS_SQL}, walk(node, a, b) AS (
  SELECT DISTINCT p_partkey // 97 * 97 + 7, CAST(-1 AS BIGINT), CAST(-1 AS BIGINT) FROM part UNION SELECT callee, site, a FROM walk JOIN calls ON node = caller)
"""


@query(CONTEXT_SQL + "SELECT node, CASE WHEN a = -1 THEN '' WHEN b = -1 THEN CAST(a AS VARCHAR) ELSE a || ',' || b END AS ctx FROM walk")
def k_limited_contexts(spark, sf_dir):
    return whole(graph.contexts(_calls(spark, sf_dir), _roots(spark, sf_dir), 2)).select("node", F.array_join("ctx", ",").alias("ctx"))


@query(CONTEXT_SQL + "SELECT DISTINCT caller AS node, CASE WHEN b = -1 THEN '' ELSE CAST(b AS VARCHAR) END AS ctx, site FROM walk JOIN calls ON node = callee AND a = site")
def matched_returns(spark, sf_dir):
    calls = _calls(spark, sf_dir)
    ctx = whole(graph.contexts(calls, _roots(spark, sf_dir), 2))
    return graph.matched_returns(calls, ctx.drop("round")).select("node", F.array_join("ctx", ",").alias("ctx"), "site")


FAN_SQL = """fan AS (SELECT l_partkey AS callee, count(DISTINCT l_suppkey) AS fan_in, count(DISTINCT (l_suppkey, l_linenumber)) AS sites, bool_or(l_returnflag = 'R') AS used FROM lineitem GROUP BY l_partkey),
chosen AS (SELECT *, CASE WHEN fan_in >= 6 THEN 2 WHEN fan_in >= 3 THEN 1 ELSE 0 END AS k FROM fan)"""


def _fan(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    return graph.adaptive_k(li.select(F.col("l_partkey").alias("callee"), F.col("l_suppkey").alias("caller"), F.col("l_linenumber").alias("line"), (F.col("l_returnflag") == "R").alias("used")))


@query(f"WITH {FAN_SQL} SELECT * FROM chosen")
def fan_in_adaptive_k(spark, sf_dir):
    return _fan(spark, sf_dir)


@query(f"WITH {FAN_SQL} SELECT k, count(*) AS methods, CAST(sum(sites) AS BIGINT) AS sites FROM chosen GROUP BY k")
def adaptive_k_histogram(spark, sf_dir):
    return _fan(spark, sf_dir).groupBy("k").agg(F.count("*").alias("methods"), F.sum("sites").alias("sites"))


@query(f"WITH {FAN_SQL} SELECT callee, fan_in FROM chosen ORDER BY fan_in DESC, callee LIMIT 10")
def fan_in_hotspots(spark, sf_dir):
    return _fan(spark, sf_dir).select("callee", "fan_in").orderBy(F.desc("fan_in"), "callee").limit(10)


BELOW_SQL = f"""WITH RECURSIVE {HIERARCHY_SQL}, up AS (SELECT child AS descendant, parent AS ancestor FROM hierarchy UNION SELECT u.descendant, h.parent FROM up u JOIN hierarchy h ON u.ancestor = h.child),
below AS (SELECT ancestor, descendant FROM up UNION SELECT child, child FROM hierarchy UNION SELECT parent, parent FROM hierarchy),
methods AS (SELECT child AS class, 'm' || (length(child) % 3) AS name, child LIKE 'n:%' AS abstract FROM hierarchy),
sites AS (SELECT o_orderkey AS site, CASE WHEN o_orderkey % 5 = 0 THEN 'c:' || o_custkey ELSE 'n:' || (o_custkey % 25) END AS class, 'm' || (o_orderkey % 3) AS name, CASE WHEN o_orderkey % 5 = 0 THEN 'static' ELSE 'virtual' END AS kind FROM orders)
"""


def _classes(spark, sf_dir):
    h = hierarchy(spark, sf_dir)
    methods = h.select(F.col("child").alias("class"), F.concat(F.lit("m"), F.length("child") % 3).alias("name"), F.col("child").startswith("n:").alias("abstract"))
    k = F.col("o_orderkey")
    o = read(spark, sf_dir, "orders")
    sites = o.select(k.alias("site"), F.when(k % 5 == 0, F.concat(F.lit("c:"), "o_custkey")).otherwise(F.concat(F.lit("n:"), F.col("o_custkey") % 25)).alias("class"), F.concat(F.lit("m"), k % 3).alias("name"), F.when(k % 5 == 0, "static").otherwise("virtual").alias("kind"))
    return h, methods, sites


@query(BELOW_SQL + "SELECT ancestor, count(*) AS classes, min(descendant) AS first FROM below GROUP BY ancestor")
def subtype_closure(spark, sf_dir):
    return graph.subtypes(_classes(spark, sf_dir)[0]).groupBy("ancestor").agg(F.count("*").alias("classes"), F.min("descendant").alias("first"))


@query(
    BELOW_SQL
    + """SELECT site, count(*) AS targets, min(target) AS first FROM (
  SELECT s.site, t.target FROM sites s JOIN (SELECT DISTINCT s.class, s.name, m.class AS target FROM (SELECT DISTINCT class, name FROM sites WHERE kind = 'virtual') s JOIN below b ON s.class = b.ancestor JOIN methods m ON m.class = b.descendant AND m.name = s.name WHERE NOT m.abstract) t ON t.class = s.class AND t.name = s.name WHERE s.kind = 'virtual'
  UNION ALL SELECT s.site, m.class FROM sites s JOIN methods m ON m.class = s.class AND m.name = s.name WHERE s.kind <> 'virtual' AND NOT m.abstract) GROUP BY site"""
)
def cha_targets(spark, sf_dir):
    """Targets are counted for each different call and joined to its sites."""
    h, methods, sites = _classes(spark, sf_dir)
    shapes = graph.call_shapes(sites, graph.subtypes(h, sites), methods)
    counted = shapes.groupBy("class", "name", "kind").agg(F.count("*").alias("targets"), F.min("target").alias("first"))
    return sites.join(counted, ["class", "name", "kind"]).select("site", "targets", "first")




# each part a class under the one of a third of its number, with one method that calls another and creates two
RTA_SQL = """hierarchy AS (SELECT p_partkey AS child, p_partkey // 3 AS parent FROM part WHERE p_partkey // 3 <> p_partkey),
below AS (SELECT p_partkey AS ancestor, p_partkey AS descendant FROM part UNION SELECT b.ancestor, h.child FROM below b JOIN hierarchy h ON b.descendant = h.parent),
targets AS (SELECT DISTINCT c.p_partkey AS caller, c.p_partkey % 4 <> 0 AS virtual, b.descendant AS target FROM part c JOIN below b ON b.ancestor = c.p_partkey // 2 AND (c.p_partkey % 4 <> 0 OR b.descendant = b.ancestor)),
created AS (SELECT p_partkey AS method, p_partkey * 2 AS class FROM part UNION SELECT p_partkey, p_partkey + 1 FROM part)"""


@query(
    f"""WITH RECURSIVE {RTA_SQL}, walk(kind, name) AS (SELECT 'm', p_partkey FROM part WHERE p_size = 50 OR p_partkey = 7
  UNION SELECT n.kind, n.name FROM (
    SELECT 'c' AS kind, c.class AS name FROM walk w JOIN created c ON w.kind = 'm' AND c.method = w.name
    UNION ALL SELECT 'm', t.target FROM walk w JOIN targets t ON w.kind = 'm' AND t.caller = w.name WHERE NOT t.virtual
    UNION ALL SELECT 'm', t.target FROM walk w JOIN targets t ON w.kind = 'm' AND t.caller = w.name JOIN recurring.walk q ON q.kind = 'c' AND q.name = t.target WHERE t.virtual
    UNION ALL SELECT 'm', t.target FROM walk w JOIN targets t ON w.kind = 'c' AND t.target = w.name JOIN recurring.walk q ON q.kind = 'm' AND q.name = t.caller WHERE t.virtual) n)
SELECT 'k' || name || '.m' AS node FROM walk WHERE kind = 'm'"""
)
def rta_reached(spark, sf_dir):
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    name = lambda x: F.concat(F.lit("k"), x.cast("long"))
    method = F.concat(name(k), F.lit(".m"))
    h = p.where(F.floor(k / 3) != k).select(name(k).alias("child"), name(F.floor(k / 3)).alias("parent"))
    methods = p.select(name(k).alias("class"), F.lit("m").alias("name"), F.lit(False).alias("abstract"))
    calls = p.select(k.alias("site"), method.alias("caller"), name(F.floor(k / 2)).alias("class"), F.lit("m").alias("name"), F.when(k % 4 == 0, "static").otherwise("virtual").alias("kind"))
    created = p.select(method.alias("method"), F.explode(F.array(name(k * 2), name(k + 1))).alias("class"))
    roots = p.where("p_size = 50 or p_partkey = 7").select(method.alias("node"))
    return graph.rapid_targets(calls, graph.subtypes(h, calls), methods, created, roots)


# points-to: each part is one statement: an allocation, a copy, a field load or a field store
PTS_SQL = """address AS (SELECT 'v' || p_partkey AS var, 'o' || p_partkey AS obj FROM part WHERE p_partkey % 4 = 0),
copies AS (SELECT 'v' || (p_partkey // 3) AS src, 'v' || p_partkey AS dst FROM part WHERE p_partkey % 4 = 1),
loads AS (SELECT 'v' || (p_partkey // 3) AS base, 'f' || (p_size % 2) AS field, 'v' || p_partkey AS dst FROM part WHERE p_partkey % 4 = 2),
stores AS (SELECT 'v' || (p_partkey // 3) AS base, 'f' || (p_size % 2) AS field, 'v' || (p_partkey // 2) AS src FROM part WHERE p_partkey % 4 = 3)"""


def _points_to(spark, sf_dir):
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    v, f = lambda x: F.concat(F.lit("v"), x.cast("long")), F.concat(F.lit("f"), F.col("p_size") % 2)
    third = v(F.floor(k / 3))
    address = p.where(k % 4 == 0).select(v(k).alias("var"), F.concat(F.lit("o"), k).alias("obj"))
    copies = p.where(k % 4 == 1).select(third.alias("src"), v(k).alias("dst"))
    loads = p.where(k % 4 == 2).select(third.alias("base"), f.alias("field"), v(k).alias("dst"))
    stores = p.where(k % 4 == 3).select(third.alias("base"), f.alias("field"), v(F.floor(k / 2)).alias("src"))
    return graph.points_to(address, copies, loads, stores)


PTS_WALK = f"""WITH RECURSIVE {PTS_SQL}, pts AS (
  SELECT var, obj FROM address
  UNION SELECT n.var, n.obj FROM (
    SELECT c.dst AS var, p.obj FROM pts p JOIN copies c ON p.var = c.src
    UNION ALL SELECT l.dst, q.obj FROM pts p JOIN loads l ON p.var = l.base JOIN recurring.pts q ON q.var = p.obj || '.' || l.field
    UNION ALL SELECT l.dst, p.obj FROM pts p JOIN loads l ON split_part(p.var, '.', 2) = l.field JOIN recurring.pts q ON q.var = l.base AND p.var = q.obj || '.' || l.field
    UNION ALL SELECT q.obj || '.' || s.field, p.obj FROM pts p JOIN stores s ON p.var = s.src JOIN recurring.pts q ON q.var = s.base
    UNION ALL SELECT p.obj || '.' || s.field, q.obj FROM pts p JOIN stores s ON p.var = s.base JOIN recurring.pts q ON q.var = s.src) n)
"""


@query(PTS_WALK + "SELECT var, obj FROM pts")
def points_to(spark, sf_dir):
    return _points_to(spark, sf_dir)


@query(PTS_WALK + "SELECT DISTINCT x.var AS a, y.var AS b FROM pts x JOIN pts y ON x.obj = y.obj AND x.var < y.var")
def may_alias(spark, sf_dir):
    return graph.may_alias(_points_to(spark, sf_dir))


# control flow: each customer's orders as blocks of a method
CFG_SQL = """blocks AS (SELECT DISTINCT 'm' || o_custkey AS method, o_orderkey % 20 AS block FROM orders),
cfg AS (SELECT DISTINCT method, block AS src, dst FROM (SELECT method, block, unnest([block + 1, (block * 3 + 1) % 20, CASE WHEN block % 4 = 0 THEN block + 2 ELSE block + 1 END]) AS dst FROM blocks) WHERE dst < 20 AND (dst > block OR block % 7 = 3)),
defs AS (SELECT method, block, CASE WHEN block % 3 = 0 THEN 'x' WHEN block % 3 = 1 THEN 'y' END AS var FROM blocks)"""


def _cfg(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    blocks = o.select(F.concat(F.lit("m"), F.col("o_custkey")).alias("method"), (F.col("o_orderkey") % 20).alias("block")).distinct()
    b = F.col("block")
    ways = F.explode(F.array(b + 1, (b * 3 + 1) % 20, F.when(b % 4 == 0, b + 2).otherwise(b + 1)))
    edges = blocks.select("method", b.alias("src"), ways.alias("dst")).where("dst < 20 and (dst > src or src % 7 = 3)").distinct()
    return blocks.select("method", "block", F.when(b % 3 == 0, "x").when(b % 3 == 1, "y").alias("var")), edges


RD_SQL = f"""WITH RECURSIVE {CFG_SQL}, rd AS (
  SELECT c.method, c.dst AS block, d.var, d.block AS def FROM defs d JOIN cfg c ON d.method = c.method AND d.block = c.src WHERE d.var IS NOT NULL
  UNION SELECT r.method, c.dst, r.var, r.def FROM rd r JOIN defs d ON d.method = r.method AND d.block = r.block JOIN cfg c ON c.method = r.method AND c.src = r.block WHERE d.var IS NULL OR d.var <> r.var)
"""


@query(RD_SQL + "SELECT method, block, var, def FROM rd")
def reaching_defs(spark, sf_dir):
    blocks, edges = _cfg(spark, sf_dir)
    return graph.reaching_definitions(blocks, edges)


@query(RD_SQL + "SELECT DISTINCT method, def, block AS use, var FROM rd JOIN blocks USING (method, block) WHERE (block % 2 = 0 AND var = 'x') OR (block % 2 = 1 AND var = 'y')")
def def_use(spark, sf_dir):
    blocks, edges = _cfg(spark, sf_dir)
    uses = blocks.select("method", "block", F.when(F.col("block") % 2 == 0, "x").otherwise("y").alias("var"))
    return graph.def_use(graph.reaching_definitions(blocks, edges), uses)


DOM_SQL = f"""WITH RECURSIVE {CFG_SQL}, seen AS (SELECT DISTINCT method, CAST(0 AS BIGINT) AS block FROM cfg UNION SELECT c.method, c.dst FROM seen s JOIN cfg c ON c.method = s.method AND c.src = s.block),
without AS (SELECT method, block AS cutoff, CAST(0 AS BIGINT) AS block FROM seen WHERE block <> 0 UNION SELECT w.method, w.cutoff, c.dst FROM without w JOIN cfg c ON c.method = w.method AND c.src = w.block WHERE c.dst <> w.cutoff),
dom AS (SELECT s.method, s.block, d.block AS by FROM seen s JOIN seen d ON s.method = d.method WHERE d.block = s.block OR d.block = 0 OR NOT EXISTS (SELECT 1 FROM without w WHERE w.method = s.method AND w.cutoff = d.block AND w.block = s.block)),
size AS (SELECT method, block, count(*) AS n FROM dom GROUP BY method, block),
idom AS (SELECT d.method, d.block, max_by(d.by, z.n) AS idom FROM dom d JOIN size z ON z.method = d.method AND z.block = d.by WHERE d.by <> d.block GROUP BY d.method, d.block)
"""


@query(DOM_SQL + "SELECT s.method, s.block, i.idom FROM seen s LEFT JOIN idom i ON i.method = s.method AND i.block = s.block")
def dominators(spark, sf_dir):
    return graph.dominators(_cfg(spark, sf_dir)[1]).select("method", "block", "idom")


FRONT_SQL = ", front AS (SELECT DISTINCT d.method, d.by AS block, c.dst AS front FROM dom d JOIN cfg c ON c.method = d.method AND c.src = d.block WHERE NOT EXISTS (SELECT 1 FROM dom x WHERE x.method = d.method AND x.block = c.dst AND x.by = d.by AND d.by <> c.dst)) "


@query(DOM_SQL + FRONT_SQL + "SELECT method, block, front FROM front")
def dominance_frontiers(spark, sf_dir):
    return graph.dominators(_cfg(spark, sf_dir)[1]).select("method", "block", F.explode("frontier").alias("front"))


@query(DOM_SQL + ", tree AS (SELECT method, block, 0 AS depth FROM seen WHERE block = 0 UNION SELECT i.method, i.block, t.depth + 1 FROM tree t JOIN idom i ON i.method = t.method AND i.idom = t.block) SELECT method, block, depth FROM tree")
def dominator_tree(spark, sf_dir):
    return graph.dominator_tree(graph.dominators(_cfg(spark, sf_dir)[1]).select("method", "block", "idom"))


@query(DOM_SQL + FRONT_SQL + ", phi AS (SELECT d.method, f.front AS block, d.var FROM defs d JOIN front f ON f.method = d.method AND f.block = d.block WHERE d.var IS NOT NULL UNION SELECT p.method, f.front, p.var FROM phi p JOIN front f ON f.method = p.method AND f.block = p.block) SELECT method, block, var FROM phi")
def ssa_phi_places(spark, sf_dir):
    blocks, edges = _cfg(spark, sf_dir)
    return graph.phi_places(blocks, graph.dominators(edges))


@query(
    """SELECT user_id AS method, event_id AS stmt, event_type AS var, lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS def FROM events"""
)
def straight_line_defs(spark, sf_dir):
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("method"), F.col("event_id").alias("stmt"), F.col("event_type").alias("var"), F.lag("event_id").over(w).alias("def"))


# procedures are suppliers of six statements each, which call those of half and a third of their number; facts 0, u, v
IFDS_SQL = """p AS (SELECT s_suppkey AS s FROM supplier), i AS (SELECT unnest(range(5)) AS i),
flows AS (SELECT s, i, d, s AS ts, i + 1 AS ti, d AS e FROM p, i, (VALUES ('0'), ('u'), ('v')) f(d) WHERE NOT (d = 'u' AND i = s % 5) UNION SELECT s, 2, '0', s, 3, CASE WHEN s % 2 = 1 THEN 'u' ELSE 'v' END FROM p),
callee AS (SELECT s, q FROM p, LATERAL (SELECT unnest([s // 2, s // 3]) AS q) WHERE q <> s),
calls AS (SELECT DISTINCT s, d, s || '>' || q AS site, q, e FROM callee, (VALUES ('0', '0'), ('u', 'v')) f(d, e)),
returns AS (SELECT DISTINCT q, d, s || '>' || q AS site, s, e FROM callee, (VALUES ('v', 'u'), ('0', '0')) f(d, e)),
walk(ps, pd, s, i, d) AS (SELECT s, '0', s, 0, '0' FROM p UNION SELECT n.ps, n.pd, n.s, n.i, n.d FROM (
  SELECT w.ps, w.pd, f.ts AS s, CAST(f.ti AS INTEGER) AS i, f.e AS d FROM walk w JOIN flows f ON f.s = w.s AND f.i = w.i AND f.d = w.d
  UNION ALL SELECT c.q, c.e, c.q, 0, c.e FROM walk w JOIN calls c ON w.i = 3 AND c.s = w.s AND c.d = w.d
  UNION ALL SELECT w.ps, w.pd, r.s, 4, r.e FROM walk w JOIN calls c ON w.i = 3 AND c.s = w.s AND c.d = w.d JOIN recurring.walk x ON x.ps = c.q AND x.pd = c.e AND x.s = c.q AND x.i = 5 JOIN returns r ON r.site = c.site AND r.d = x.d
  UNION ALL SELECT x.ps, x.pd, r.s, 4, r.e FROM walk w JOIN calls c ON w.i = 5 AND w.s = c.q AND w.ps = c.q AND w.pd = c.e JOIN recurring.walk x ON x.s = c.s AND x.i = 3 AND x.d = c.d JOIN returns r ON r.site = c.site AND r.d = w.d) n)"""


@query(f"WITH RECURSIVE {IFDS_SQL} SELECT 'p' || ps || '.0/' || pd AS d1, 'p' || s || '.' || i AS n, d AS d2 FROM walk")
def ifds_path_edges(spark, sf_dir):
    """Undefined variables over a program of all suppliers."""
    return graph.tabulate(*ifds_program(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("s"))))


def ifds_program(procedures):
    """flows, calls, returns and seeds of procedures (s)."""
    spark = procedures.sparkSession
    n = lambda s, i: F.concat(F.lit("p"), s, F.lit("."), i)
    s, i, d = F.col("s"), F.col("i"), F.col("d")
    facts = lambda *rows: spark.createDataFrame(rows, "d string, e string")
    steps = procedures.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(4))))
    flows = steps.crossJoin(F.broadcast(facts(("0", "0"), ("u", "u"), ("v", "v")))).where(~((d == "u") & (i == s % 5)))  # three rows
    made = procedures.select(n(s, F.lit(2)).alias("n"), F.lit("0").alias("d"), n(s, F.lit(3)).alias("to"), F.when(s % 2 == 1, "u").otherwise("v").alias("e"))
    flows = flows.select(n(s, i).alias("n"), "d", n(s, i + 1).alias("to"), "e").union(made).distinct()
    callee = procedures.select("s", F.explode(F.array_distinct(F.array(F.floor(s / 2), F.floor(s / 3)))).alias("q")).where("q <> s").withColumn("site", F.concat_ws(">", "s", "q"))
    q = F.col("q")
    calls = callee.crossJoin(F.broadcast(facts(("0", "0"), ("u", "v")))).select(n(s, F.lit(3)).alias("n"), "d", "site", n(q, F.lit(0)).alias("entry"), "e")  # two rows
    returns = callee.crossJoin(F.broadcast(facts(("v", "u"), ("0", "0")))).select(n(q, F.lit(5)).alias("exit"), "d", "site", n(s, F.lit(4)).alias("to"), "e")  # two rows
    return flows, calls, returns, procedures.select(n(s, F.lit(0)).alias("n"), F.lit("0").alias("d"))
