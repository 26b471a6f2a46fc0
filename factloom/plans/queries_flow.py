"""Queries over the structure of control flow: loops, branches, single assignment, data flow."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.fixtures import read
from . import flow, graph
from .fixpoint import written
from .queries_graph import CFG_SQL, DOM_SQL, FRONT_SQL, _cfg
from .registry import query


def _c(name):
    return F.col(name)


def dom_sql(p: str, cfg: str, entry: int) -> str:
    """Tables {p}seen, {p}dom (every dominator, itself included) and {p}idom of a graph ``cfg``."""
    return f"""{p}seen AS (SELECT DISTINCT method, CAST({entry} AS BIGINT) AS block FROM {cfg} UNION SELECT c.method, c.dst FROM {p}seen s JOIN {cfg} c ON c.method = s.method AND c.src = s.block),
{p}without AS (SELECT method, block AS cutoff, CAST({entry} AS BIGINT) AS block FROM {p}seen WHERE block <> {entry} UNION SELECT w.method, w.cutoff, c.dst FROM {p}without w JOIN {cfg} c ON c.method = w.method AND c.src = w.block WHERE c.dst <> w.cutoff),
{p}dom AS (SELECT s.method, s.block, d.block AS by FROM {p}seen s JOIN {p}seen d ON s.method = d.method WHERE d.block = s.block OR d.block = {entry} OR NOT EXISTS (SELECT 1 FROM {p}without w WHERE w.method = s.method AND w.cutoff = d.block AND w.block = s.block)),
{p}size AS (SELECT method, block, count(*) AS n FROM {p}dom GROUP BY method, block),
{p}idom AS (SELECT d.method, d.block, max_by(d.by, z.n) AS idom FROM {p}dom d JOIN {p}size z ON z.method = d.method AND z.block = d.by WHERE d.by <> d.block GROUP BY d.method, d.block)"""


# ten blocks for each supplier, with ways back, in every other one a way into the middle, and in every third other numbers
LOOP_CFG = """plain AS (SELECT s_suppkey AS s, i AS src, i + 1 AS dst FROM supplier, range(9) r(i) UNION SELECT s_suppkey, i, i // 2 FROM supplier, range(1, 10) r(i) WHERE (s_suppkey + i) % 4 = 0 UNION SELECT s_suppkey, 0, 5 FROM supplier WHERE s_suppkey % 2 = 0 UNION SELECT s_suppkey, 3, 8 FROM supplier WHERE s_suppkey % 5 < 2 UNION SELECT s_suppkey, 8, 6 FROM supplier WHERE s_suppkey % 5 = 1),
cfg AS (SELECT DISTINCT 'm' || s AS method, CASE WHEN s % 3 = 0 THEN src * 7 % 10 ELSE src END AS src, CASE WHEN s % 3 = 0 THEN dst * 7 % 10 ELSE dst END AS dst FROM plain)"""
LOOPS_SQL = f"""WITH RECURSIVE {LOOP_CFG}, {dom_sql("", "cfg", 0)},
known AS (SELECT c.* FROM cfg c JOIN seen s ON s.method = c.method AND s.block = c.src),
back AS (SELECT k.* FROM known k JOIN dom d ON d.method = k.method AND d.block = k.src AND d.by = k.dst),
fwd AS (SELECT * FROM known EXCEPT SELECT * FROM back),
reach AS (SELECT method, src, dst FROM fwd UNION SELECT r.method, r.src, f.dst FROM reach r JOIN fwd f ON f.method = r.method AND f.src = r.dst),
odd AS (SELECT f.* FROM fwd f JOIN reach r ON r.method = f.method AND r.src = f.dst AND r.dst = f.src),
body AS (SELECT method, dst AS header, dst AS block FROM back UNION SELECT method, dst, src FROM back UNION SELECT b.method, b.header, k.src FROM body b JOIN known k ON k.method = b.method AND k.dst = b.block WHERE b.block <> b.header)
"""


def _loops(spark, sf_dir):
    s, i = _c("s_suppkey"), _c("i")
    blocks = read(spark, sf_dir, "supplier").select(s, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("i"))
    edge = lambda rows, src, dst: rows.select(s, src.cast("long").alias("src"), dst.cast("long").alias("dst"))
    every = edge(blocks.where("i < 9"), i, i + 1).union(edge(blocks.where((i > 0) & ((s + i) % 4 == 0)), i, F.floor(i / 2)))
    for cond, a, b in ((s % 2 == 0, 0, 5), (s % 5 < 2, 3, 8), (s % 5 == 1, 8, 6)):
        every = every.union(edge(blocks.where((i == a) & cond), i, F.lit(b)))
    name = lambda c: F.when(s % 3 == 0, _c(c) * 7 % 10).otherwise(_c(c)).alias(c)
    return every.select(F.concat(F.lit("m"), s).alias("method"), name("src"), name("dst")).distinct()


@query(LOOPS_SQL + "SELECT method, header, CAST(sum(l) AS BIGINT) AS latches, CAST(sum(o) AS BIGINT) AS irregular FROM (SELECT method, dst AS header, 1 AS l, 0 AS o FROM back UNION ALL SELECT method, dst, 0, 1 FROM odd) GROUP BY method, header")
def natural_loops(spark, sf_dir):
    return flow.loops(_loops(spark, sf_dir))


@query(LOOPS_SQL + "SELECT method, header, block FROM body")
def loop_bodies(spark, sf_dir):
    return flow.loop_bodies(_loops(spark, sf_dir))


@query(
    LOOPS_SQL
    + """, n AS (SELECT method, header, count(*) AS blocks FROM body GROUP BY method, header)
SELECT n.method, n.header, n.blocks, count(*) AS depth, arg_min(o.header, (o.blocks, o.header)) FILTER (WHERE o.header <> n.header) AS parent
FROM n JOIN body b ON b.method = n.method AND b.block = n.header JOIN n o ON o.method = n.method AND o.header = b.header GROUP BY n.method, n.header, n.blocks"""
)
def loop_nesting(spark, sf_dir):
    return flow.loop_nesting(flow.loop_bodies(_loops(spark, sf_dir)))


@query(
    LOOPS_SQL
    + f""", turned AS (SELECT method, dst AS src, src AS dst FROM cfg UNION SELECT c.method, -1, c.dst FROM cfg c WHERE NOT EXISTS (SELECT 1 FROM cfg x WHERE x.method = c.method AND x.src = c.dst)),
{dom_sql("r", "turned", -1)},
ways AS (SELECT k.method, k.src AS block, k.dst, nullif(i.idom, -1) AS "join",
  EXISTS (SELECT 1 FROM dom d WHERE d.method = k.method AND d.block = k.src AND d.by = k.dst) OR (EXISTS (SELECT 1 FROM body b WHERE b.method = k.method AND b.header = k.src) AND NOT EXISTS (SELECT 1 FROM body b WHERE b.method = k.method AND b.header = k.src AND b.block = k.dst)) AS loops,
  coalesce(nullif(i.idom, -1) = k.dst, false) AS direct, k.src <> k.dst AND EXISTS (SELECT 1 FROM dom d WHERE d.method = k.method AND d.block = k.dst AND d.by = k.src) AS own
  FROM known k LEFT JOIN ridom i ON i.method = k.method AND i.block = k.src),
one AS (SELECT method, block, "join", count(*) AS ways, bool_or(loops) AS loops, count_if(direct) AS direct, count_if(own AND NOT direct) AS own FROM ways GROUP BY method, block, "join")
SELECT method, block, ways, "join", CASE WHEN loops THEN 'loop' WHEN "join" IS NULL OR direct + own < ways THEN 'open' WHEN ways = 2 AND direct = 1 THEN 'if' WHEN ways = 2 THEN 'if-else' ELSE 'switch' END AS kind FROM one WHERE ways > 1"""
)
def branch_regions(spark, sf_dir):
    return flow.branches(_loops(spark, sf_dir))


# ---------------------------------------------------------------- single assignment

SSA_SQL = (
    DOM_SQL
    + FRONT_SQL
    + """, phi AS (SELECT d.method, f.front AS block, d.var FROM defs d JOIN front f ON f.method = d.method AND f.block = d.block WHERE d.var IS NOT NULL UNION SELECT p.method, f.front, p.var FROM phi p JOIN front f ON f.method = p.method AND f.block = p.block),
named AS (SELECT *, row_number() OVER (PARTITION BY method, var ORDER BY block, idx NULLS FIRST) AS version FROM (SELECT method, block, 1 AS idx, var FROM defs WHERE var IS NOT NULL UNION ALL SELECT method, block, NULL, var FROM phi)),
outs AS (SELECT method, block, var, max(version) AS version FROM named GROUP BY method, block, var),
points AS (SELECT d.method, d.block, o.var, z.n, o.version, d.by FROM dom d JOIN outs o ON o.method = d.method AND o.block = d.by JOIN size z ON z.method = d.method AND z.block = d.by)
"""
)


def _ssa(spark, sf_dir):
    blocks, edges = _cfg(spark, sf_dir)
    doms = written(flow.dominators(edges))  # read by several joins and every round of the phis
    known = doms.select("method", "block")
    uses = blocks.join(known.hint("merge"), ["method", "block"]).select("method", "block", F.lit(0).alias("idx"), F.when(_c("block") % 2 == 0, "x").otherwise("y").alias("var"))
    defs = blocks.where("var is not null").select("method", "block", F.lit(1).alias("idx"), "var")
    reached = edges.join(known.withColumnRenamed("block", "src").hint("merge"), ["method", "src"])
    return flow.renamed(defs, uses, written(graph.phi_places(blocks, doms)), doms, reached)


@query(
    SSA_SQL
    + """, uses AS (SELECT b.method, b.block, CASE WHEN b.block % 2 = 0 THEN 'x' ELSE 'y' END AS var FROM blocks b JOIN seen s ON s.method = b.method AND s.block = b.block)
SELECT u.method, u.block, 0 AS idx, u.var, coalesce(max(p.version), max_by(o.version, o.n), 0) AS version FROM uses u
LEFT JOIN named p ON p.method = u.method AND p.block = u.block AND p.var = u.var AND p.idx IS NULL LEFT JOIN points o ON o.method = u.method AND o.block = u.block AND o.var = u.var AND o.by <> u.block GROUP BY u.method, u.block, u.var"""
)
def ssa_uses(spark, sf_dir):
    """Each use with the one version of its variable that it reads."""
    return _ssa(spark, sf_dir)[1]


@query(
    SSA_SQL
    + """SELECT f.method, f.block, f.var, c.src AS pred, coalesce(max_by(o.version, o.n), 0) AS version FROM phi f JOIN cfg c ON c.method = f.method AND c.dst = f.block JOIN seen s ON s.method = c.method AND s.block = c.src
LEFT JOIN points o ON o.method = c.method AND o.block = c.src AND o.var = f.var GROUP BY f.method, f.block, f.var, c.src"""
)
def ssa_phi_operands(spark, sf_dir):
    return _ssa(spark, sf_dir)[2]


# ---------------------------------------------------------------- data flow

FLOW_SQL = f"""WITH RECURSIVE {CFG_SQL}, nodes AS (SELECT method, block FROM blocks UNION SELECT method, src FROM cfg UNION SELECT method, dst FROM cfg),
gen AS (SELECT method, block, CASE block % 3 WHEN 0 THEN 'x' ELSE 'y' END AS fact FROM nodes WHERE block % 3 < 2), lost AS (SELECT method, block, CASE block % 5 WHEN 2 THEN 'x' ELSE 'y' END AS fact FROM nodes WHERE block % 5 IN (2, 4)),
kill AS (SELECT * FROM lost EXCEPT SELECT * FROM gen), facts AS (SELECT DISTINCT method, fact FROM gen)"""


def _ways_sql(a: str, b: str) -> str:
    return f", ways AS (SELECT method, {a} AS block, {b} AS too FROM cfg)"


GONE_SQL = """, gone AS (SELECT n.method, n.block, f.fact FROM nodes n JOIN facts f USING (method) WHERE NOT EXISTS (SELECT 1 FROM ways w WHERE w.method = n.method AND w.too = n.block) {edge}
UNION SELECT w.method, w.too, k.fact FROM kill k JOIN facts f USING (method, fact) JOIN ways w ON w.method = k.method AND w.block = k.block
UNION SELECT w.method, w.too, g.fact FROM gone g JOIN ways w ON w.method = g.method AND w.block = g.block WHERE NOT EXISTS (SELECT 1 FROM gen x WHERE x.method = g.method AND x.block = g.block AND x.fact = g.fact))
SELECT n.method, n.block, f.fact FROM nodes n JOIN facts f USING (method) EXCEPT SELECT method, block, fact FROM gone"""


def _flow(spark, sf_dir, **how):
    blocks, edges = _cfg(spark, sf_dir)
    ends = edges.select("method", _c("src").alias("block")).union(edges.select("method", "dst"))
    nodes = blocks.select("method", "block").union(ends).distinct()
    b = _c("block")
    gen = nodes.where(b % 3 < 2).withColumn("fact", F.when(b % 3 == 0, "x").otherwise("y"))
    kill = nodes.where((b % 5).isin(2, 4)).withColumn("fact", F.when(b % 5 == 2, "x").otherwise("y"))
    kill = kill.join(gen, ["method", "block", "fact"], "left_anti")
    entry = nodes.where("block = 0") if how.pop("entry", False) else None
    return flow.dataflow(nodes, edges, gen, kill, boundary=entry, **how)


@query(FLOW_SQL + _ways_sql("src", "dst") + GONE_SQL.format(edge="OR n.block = 0"))
def available_facts(spark, sf_dir):
    """What every way from the entry has made and not lost again: a greatest fixpoint forward."""
    return _flow(spark, sf_dir, meet="intersection", entry=True)


@query(FLOW_SQL + _ways_sql("dst", "src") + GONE_SQL.format(edge=""))
def anticipated_facts(spark, sf_dir):
    """What every way on makes before it is lost: a greatest fixpoint backward."""
    return _flow(spark, sf_dir, meet="intersection", direction="backward")


@query(
    FLOW_SQL
    + _ways_sql("dst", "src")
    + """, live AS (SELECT w.method, w.too AS block, g.fact FROM gen g JOIN ways w ON w.method = g.method AND w.block = g.block
UNION SELECT w.method, w.too, l.fact FROM live l JOIN ways w ON w.method = l.method AND w.block = l.block WHERE NOT EXISTS (SELECT 1 FROM kill k WHERE k.method = l.method AND k.block = l.block AND k.fact = l.fact))
SELECT method, block, fact FROM live"""
)
def live_facts(spark, sf_dir):
    """What some way on uses before it is set: liveness."""
    return _flow(spark, sf_dir, direction="backward")
