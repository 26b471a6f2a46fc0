"""Queries over points-to sets that grow their own call graph.

Twenty parts make a method: allocations, copies, field accesses, calls by receiver, by
function and by name, a captured variable; classes stand under those of half their number."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.fixtures import read
from . import pointers
from .registry import query

#: (place in the method, variables of the copy, rest of p_size modulo the second number that leaves it out)
COPIES = [(2, "v0", "v2", 0, 3), (3, "v1", "v2", 9, 2), (13, "v10", "r", 9, 2), (15, "v8", "r", 9, 2), (16, "v5", "r", 1, 2)]
STORES = [(4, "v0", "f", "v1"), (11, "this", "g", "a")]
LOADS = [(5, "v2", "f", "v3"), (12, "this", "g", "v10")]
#: (place, kind, base, name, argument, result); the static one calls the method of a third of its number
CALLS = [(6, "virtual", "v2", "run", "v3", "v4"), (7, "static", None, None, "v4", "v5"), (9, "pointer", "v6", None, "v1", "v7"), (14, "virtual", "v10", "go", "v0", "v12")]


def program(spark, sf_dir) -> tuple[pointers.Program, object]:
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    st = p.select(F.concat(F.lit("s"), k).alias("site"), F.concat(F.lit("o"), k).alias("obj"), F.floor(k / 20).alias("i"), (k % 20).alias("j"), "p_size").withColumn("method", F.concat(F.lit("m"), "i"))
    i = F.col("i")
    name = lambda x, n: F.concat(F.lit(x), n.cast("long"))

    def rows(table, columns, place=lambda at: F.col("j") == at):
        out = None
        for at, *values in table:
            some = st.where(place(at)).select("method", "site", "i", "p_size", *[F.lit(v).cast("string").alias(c) for c, v in zip(columns, values)])
            out = some if out is None else out.union(some)
        return out

    none = F.lit(None).cast("string")
    new = lambda at, var, kind, function: st.where(F.col("j") == at).select("method", F.lit(var).alias("var"), "obj", kind.alias("type"), function.alias("function"))
    address = new(0, "v0", name("k", i), none).union(new(1, "v1", name("k", F.floor(i / 2)), none)).union(new(8, "v6", none, name("m", F.floor(i / 5))))
    copies = rows(COPIES, ["src", "dst", "rest", "of"]).where("p_size % cast(of as int) <> cast(rest as int)").select("method", "src", "dst")
    calls = rows(CALLS, ["kind", "base", "name", "argument", "result"])
    methods = st.select("method", "i").distinct()
    formals = methods.select("method", F.inline(F.array(F.struct(F.lit(-1).alias("pos"), F.lit("this").alias("var")), F.struct(F.lit(0).alias("pos"), F.lit("a").alias("var")))))
    hierarchy = methods.where(i > 0).select(name("k", i).alias("child"), name("k", F.floor(i / 2)).alias("parent"))
    says = lambda n, cond: methods.where(cond).select(name("k", i).alias("type"), F.lit(n).alias("name"), F.col("method").alias("callee"))
    declared = says("run", i % 3 != 1).union(says("go", i % 2 == 0))
    captures = st.where("j = 10 and i % 3 = 0").select("method", F.lit("v8").alias("dst"), name("m", F.floor(i / 2)).alias("owner"), F.lit("v2").alias("src"))
    made = pointers.Program(
        address=address,
        copies=copies,
        loads=rows(LOADS, ["base", "field", "dst"]).select("method", "base", "field", "dst"),
        stores=rows(STORES, ["base", "field", "src"]).select("method", "base", "field", "src"),
        captures=captures,
        calls=calls.select("method", "site", "kind", "base", F.when(F.col("kind") == "static", name("m", F.floor(i / 3))).otherwise(F.col("name")).alias("name")),
        arguments=calls.select("site", F.lit(0).alias("pos"), F.col("argument").alias("var")),
        results=calls.select("site", F.col("result").alias("var")),
        formals=formals,
        returns=methods.select("method", F.lit("r").alias("var")),
        targets=pointers.method_table(hierarchy, declared),
    )
    return made, methods.where(i % 5 == 3).select("method")


def _values(table) -> str:
    one = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return ", ".join(f"({', '.join(one(v) for v in row)})" for row in table)


def _sql(kind: str, k: int, heap: int, this: str, select: str) -> str:
    item = {"site": "{site}", "object": "{obj}", "function": "{callee}"}[kind]

    def context(site, obj, callee):
        if kind == "object" and obj is None:
            return "w.c"
        return f"([{item.format(site=site, obj=obj, callee=callee)}] || w.c)[1:{k}]"

    seed = "['m' || i]" if kind == "function" else "CAST([] AS VARCHAR[])"
    none = "CAST([] AS VARCHAR[])"
    hctx = f"w.c[1:{heap}]" if heap else none
    found = "JOIN calls k ON w.kind = 'p' AND k.m = w.m AND k.base = w.v JOIN types y ON y.obj = w.o"
    virtual = f"walk w {found} AND k.kind = 'virtual' JOIN targets t ON t.type = y.type AND t.name = k.name"
    own = "" if this == "base" else f"UNION ALL SELECT 'p', t.callee, {context('k.site', 'w.o', 't.callee')}, 'this', w.o, w.h, '' FROM {virtual}"
    base = f"UNION ALL SELECT 's' || p, -1, base FROM st JOIN (VALUES {_values(CALLS)}) q(j, kind, base, name, arg, res) USING (j) WHERE kind = 'virtual'" if this == "base" else ""
    return f"""WITH RECURSIVE st AS (SELECT p_partkey AS p, p_partkey // 20 AS i, 'm' || (p_partkey // 20) AS m, p_partkey % 20 AS j, p_size FROM part),
classes AS (SELECT DISTINCT i FROM st),
climb AS (SELECT i, i AS up, name FROM classes, (VALUES ('run'), ('go')) n(name) UNION ALL SELECT i, up // 2, name FROM climb WHERE NOT CASE name WHEN 'run' THEN up % 3 <> 1 ELSE up % 2 = 0 END),
targets AS (SELECT 'k' || i AS type, name, 'm' || up AS callee FROM climb WHERE CASE name WHEN 'run' THEN up % 3 <> 1 ELSE up % 2 = 0 END),
address AS (SELECT m, CASE j WHEN 0 THEN 'v0' WHEN 1 THEN 'v1' ELSE 'v6' END AS var, 'o' || p AS obj, CASE j WHEN 0 THEN 'k' || i WHEN 1 THEN 'k' || (i // 2) END AS type, CASE j WHEN 8 THEN 'm' || (i // 5) END AS function FROM st WHERE j IN (0, 1, 8)),
types AS (SELECT obj, type, function FROM address),
copies AS (SELECT m, src, dst FROM st JOIN (VALUES {_values(COPIES)}) c(j, src, dst, rest, of) USING (j) WHERE p_size % of <> rest),
loads AS (SELECT m, base, field, dst FROM st JOIN (VALUES {_values(LOADS)}) c(j, base, field, dst) USING (j)),
stores AS (SELECT m, base, field, src FROM st JOIN (VALUES {_values(STORES)}) c(j, base, field, src) USING (j)),
captures AS (SELECT m, 'v8' AS dst, 'm' || (i // 2) AS owner, 'v2' AS src FROM st WHERE j = 10 AND i % 3 = 0),
calls AS (SELECT m, 's' || p AS site, kind, base, CASE kind WHEN 'static' THEN 'm' || (i // 3) ELSE name END AS name FROM st JOIN (VALUES {_values(CALLS)}) c(j, kind, base, name, arg, res) USING (j)),
arguments AS (SELECT 's' || p AS site, 0 AS pos, arg AS var FROM st JOIN (VALUES {_values(CALLS)}) c(j, kind, base, name, arg, res) USING (j) {base}),
results AS (SELECT 's' || p AS site, res AS var FROM st JOIN (VALUES {_values(CALLS)}) c(j, kind, base, name, arg, res) USING (j)),
walk(kind, m, c, v, o, h, t) AS (
  SELECT 'r', 'm' || i, {seed}, '', '', {none}, '' FROM classes WHERE i % 5 = 3
  UNION SELECT n.* FROM (
    SELECT 'p' AS kind, w.m, w.c, a.var, a.obj, {hctx} AS h, '' AS t FROM walk w JOIN address a ON w.kind = 'r' AND a.m = w.m
    UNION ALL SELECT 'p', w.m, w.c, x.dst, w.o, w.h, '' FROM walk w JOIN copies x ON w.kind = 'p' AND x.m = w.m AND x.src = w.v
    UNION ALL SELECT 'p', q.o, q.h, q.t, w.o, w.h, '' FROM walk w JOIN recurring.walk q ON w.kind = 'p' AND q.kind = 'e' AND q.m = w.m AND q.c = w.c AND q.v = w.v
    UNION ALL SELECT 'p', w.o, w.h, w.t, q.o, q.h, '' FROM walk w JOIN recurring.walk q ON w.kind = 'e' AND q.kind = 'p' AND q.m = w.m AND q.c = w.c AND q.v = w.v
    UNION ALL SELECT 'e', '', w.h, w.o || '.' || l.field, w.m, w.c, l.dst FROM walk w JOIN loads l ON w.kind = 'p' AND l.m = w.m AND l.base = w.v
    UNION ALL SELECT 'e', w.m, w.c, s.src, '', w.h, w.o || '.' || s.field FROM walk w JOIN stores s ON w.kind = 'p' AND s.m = w.m AND s.base = w.v
    UNION ALL SELECT 'c', w.m, w.c, k.site, t.callee, {context('k.site', 'w.o', 't.callee')}, '' FROM {virtual}
    {own}
    UNION ALL SELECT 'c', w.m, w.c, k.site, y.function, {context('k.site', 'w.o', 'y.function')}, '' FROM walk w {found} AND k.kind = 'pointer' AND y.function IS NOT NULL
    UNION ALL SELECT 'c', w.m, w.c, k.site, k.name, {context('k.site', None, 'k.name')}, '' FROM walk w JOIN calls k ON w.kind = 'r' AND k.kind = 'static' AND k.m = w.m
    UNION ALL SELECT 'r', w.o, w.h, '', '', {none}, '' FROM walk w WHERE w.kind = 'c'
    UNION ALL SELECT 'e', w.m, w.c, g.var, w.o, w.h, CASE g.pos WHEN 0 THEN 'a' ELSE 'this' END FROM walk w JOIN arguments g ON w.kind = 'c' AND g.site = w.v
    UNION ALL SELECT 'e', w.o, w.h, 'r', w.m, w.c, r.var FROM walk w JOIN results r ON w.kind = 'c' AND r.site = w.v
    UNION ALL SELECT 'p', q.m, q.c, x.dst, w.o, w.h, '' FROM walk w JOIN captures x ON w.kind = 'p' AND x.owner = w.m AND x.src = w.v JOIN recurring.walk q ON q.kind = 'r' AND q.m = x.m
    UNION ALL SELECT 'p', w.m, w.c, x.dst, q.o, q.h, '' FROM walk w JOIN captures x ON w.kind = 'r' AND x.m = w.m JOIN recurring.walk q ON q.kind = 'p' AND q.m = x.owner AND q.v = x.src) n)
{select}"""


PTS = "SELECT m AS method, array_to_string(c, '>') AS ctx, v AS var, o AS obj, array_to_string(h, '>') AS hctx FROM walk WHERE kind = 'p'"
CALL = "SELECT m AS method, array_to_string(c, '>') AS ctx, v AS site, o AS callee, array_to_string(h, '>') AS callee_ctx FROM walk WHERE kind = 'c'"


def _solved(spark, sf_dir, **how):
    made, roots = program(spark, sf_dir)
    return pointers.solve(made, roots, **how)


def _shown(pts):
    return pts.select("method", F.array_join("ctx", ">").alias("ctx"), "var", "obj", F.array_join("hctx", ">").alias("hctx"))


@query(_sql("object", 1, 0, "receiver", PTS))
def points_to_by_object(spark, sf_dir):
    return _shown(_solved(spark, sf_dir, kind="object", k=1, this="receiver")[0])


@query(_sql("function", 1, 0, "base", CALL))
def calls_on_the_fly(spark, sf_dir):
    """Calls that points-to sets find while they grow, in their contexts."""
    calls = _solved(spark, sf_dir, kind="function", k=1)[1]
    return calls.select("method", F.array_join("ctx", ">").alias("ctx"), "site", "callee", F.array_join("callee_ctx", ">").alias("callee_ctx"))
