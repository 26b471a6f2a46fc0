"""Queries that build control flow from statement streams and infer types."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import build
from ..sources.fixtures import read
from .registry import query

#: what an order contributes to its customer's method, by its key modulo their number
SNIPPETS = [
    "stmt",
    "if stmt end",
    "if stmt else stmt stmt end",
    "loop stmt if break end stmt if stmt continue else end end",
    "switch case stmt break case stmt default stmt end",
    "try stmt throw catch stmt finally stmt end",
    "loop if return end stmt end",
    "try loop try stmt catch throw end end stmt finally end",
    "switch case end if else end loop end try catch end",
    "if if stmt else switch case break end end else return end stmt",
]
#: what stands around a method, by the customer's key modulo their number
AROUND = [("", ""), ("loop stmt", "continue end stmt"), ("try", "catch stmt end"), ("try try", "finally end catch break end")]


def tokens(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    pick = lambda table, key: F.element_at(F.array(*[F.lit(x) for x in table]), (key % len(table) + 1).cast("int"))
    whose = F.col("o_custkey")
    parts = o.select(whose.alias("c"), F.col("o_orderkey").alias("part"), pick(SNIPPETS, F.col("o_orderkey")).alias("text"))
    c = o.select(whose.alias("c")).distinct()
    big = F.lit(1 << 60)
    parts = parts.union(c.select("c", -big, pick([a for a, _ in AROUND], F.col("c")))).union(c.select("c", big, pick([b for _, b in AROUND], F.col("c"))))
    n = build.tasks(spark, o.count(), build.ROWS // 8)  # an order gives about eight tokens
    parts = parts.where("text <> ''").select(F.concat(F.lit("m"), "c").alias("method"), "part", "text").repartition(n, "method")
    each = parts.select("method", "part", F.posexplode(F.split("text", " ")).alias("pos", "kind"))
    w = Window.partitionBy("method").orderBy("part", "pos")
    return each.select("method", (F.row_number().over(w) - 1).alias("idx"), "kind")


def _list(table) -> str:
    return "[" + ", ".join(f"'{x}'" for x in table) + "]"


TOKENS_SQL = f"""parts AS (SELECT o_custkey AS c, o_orderkey AS part, {_list(SNIPPETS)}[o_orderkey % {len(SNIPPETS)} + 1] AS t FROM orders
  UNION ALL SELECT DISTINCT o_custkey, -9000000000000000, {_list([a for a, _ in AROUND])}[o_custkey % {len(AROUND)} + 1] FROM orders UNION ALL SELECT DISTINCT o_custkey, 9000000000000000, {_list([b for _, b in AROUND])}[o_custkey % {len(AROUND)} + 1] FROM orders),
pieces AS (SELECT c, part, unnest(string_split(t, ' ')) AS kind, generate_subscripts(string_split(t, ' '), 1) AS pos FROM parts WHERE t <> ''),
tok AS (SELECT 'm' || c AS method, CAST(row_number() OVER (PARTITION BY c ORDER BY part, pos) - 1 AS INTEGER) AS idx, kind FROM pieces)"""
EDGES_SQL = f"""WITH {TOKENS_SQL},
deep AS (SELECT *, sum(CASE WHEN kind IN ('if', 'loop', 'switch', 'try') THEN 1 WHEN kind = 'end' THEN -1 ELSE 0 END) OVER (PARTITION BY method ORDER BY idx) AS d FROM tok),
spans AS (SELECT o.method, o.idx AS s, o.kind, o.d, min(e.idx) AS e FROM deep o JOIN deep e ON e.method = o.method AND e.kind = 'end' AND e.idx > o.idx AND e.d = o.d - 1 WHERE o.kind IN ('if', 'loop', 'switch', 'try') GROUP BY ALL),
regs AS (SELECT s.method, s.s, s.kind, s.e, min(m.idx) FILTER (WHERE m.kind = 'else') AS els, min(m.idx) FILTER (WHERE m.kind = 'catch') AS cat, min(m.idx) FILTER (WHERE m.kind = 'finally') AS fin, min(m.idx) FILTER (WHERE m.kind = 'default') AS def
  FROM spans s LEFT JOIN deep m ON m.method = s.method AND m.d = s.d AND m.idx > s.s AND m.idx < s.e AND m.kind IN ('else', 'case', 'default', 'catch', 'finally') GROUP BY ALL),
falls AS (SELECT t.method, t.idx, CASE t.kind WHEN 'else' THEN e.e WHEN 'catch' THEN coalesce(c.fin, c.e) ELSE t.idx END AS too FROM tok t LEFT JOIN regs e ON e.method = t.method AND e.els = t.idx LEFT JOIN regs c ON c.method = t.method AND c.cat = t.idx),
nxt AS (SELECT t.method, t.idx, t.kind, coalesce(f.too, -1) AS nxt FROM tok t LEFT JOIN falls f ON f.method = t.method AND f.idx = t.idx + 1),
lefts AS (SELECT r.*, n.nxt AS after FROM regs r JOIN nxt n ON n.method = r.method AND n.idx = r.e),
encl AS (SELECT t.method, t.idx, t.kind, max(r.s) FILTER (WHERE r.kind = 'loop' AND t.idx < r.e) AS loop, arg_max(CASE r.kind WHEN 'loop' THEN r.after ELSE r.e END, r.s) FILTER (WHERE r.kind IN ('loop', 'switch') AND t.idx < r.e) AS lft,
  arg_max(coalesce(r.cat, r.fin), r.s) FILTER (WHERE r.kind = 'try' AND t.idx < coalesce(r.cat, r.fin)) AS handler FROM tok t LEFT JOIN lefts r ON r.method = t.method AND r.s < t.idx AND t.idx < r.e WHERE t.kind IN ('stmt', 'break', 'continue', 'throw') GROUP BY ALL),
edges AS (SELECT method, idx AS src, nxt AS dst, CASE WHEN kind IN ('if', 'loop') THEN 'true' ELSE 'next' END AS kind FROM nxt n WHERE kind NOT IN ('break', 'continue', 'return', 'throw', 'switch') AND NOT EXISTS (SELECT 1 FROM regs r WHERE r.method = n.method AND r.e = n.idx AND r.kind = 'loop')
  UNION SELECT method, s, coalesce(els, e), 'false' FROM regs WHERE kind = 'if' UNION SELECT method, s, after, 'false' FROM lefts WHERE kind = 'loop' UNION SELECT method, e, s, 'back' FROM regs WHERE kind = 'loop'
  UNION SELECT method, idx, coalesce(lft, -1), 'jump' FROM encl WHERE kind = 'break' UNION SELECT method, idx, coalesce(loop, -1), 'jump' FROM encl WHERE kind = 'continue' UNION SELECT method, idx, -1, 'jump' FROM tok WHERE kind = 'return'
  UNION SELECT method, idx, coalesce(handler, -1), 'exception' FROM encl WHERE kind = 'throw' OR (kind = 'stmt' AND handler IS NOT NULL)
  UNION SELECT r.method, r.s, t.idx, 'case' FROM regs r JOIN spans s ON s.method = r.method AND s.s = r.s JOIN deep t ON t.method = r.method AND t.d = s.d AND t.idx > r.s AND t.idx < r.e AND t.kind IN ('case', 'default') WHERE r.kind = 'switch'
  UNION SELECT method, s, e, 'case' FROM regs WHERE kind = 'switch' AND def IS NULL)
"""


@query(EDGES_SQL + "SELECT method, src, dst, kind FROM edges")
def statement_edges(spark, sf_dir):
    return build.statement_edges(tokens(spark, sf_dir))


BLOCKS_SQL = """, joined AS (SELECT t.method, t.idx, NOT coalesce(e.kind = 'next' AND (SELECT count(*) FROM edges o WHERE o.method = t.method AND o.src = t.idx - 1) = 1 AND (SELECT count(*) FROM edges i WHERE i.method = t.method AND i.dst = t.idx) = 1, false) AS leads
  FROM tok t LEFT JOIN edges e ON e.method = t.method AND e.src = t.idx - 1 AND e.dst = t.idx AND e.kind = 'next'),
placed AS (SELECT method, idx, max(CASE WHEN leads THEN idx END) OVER (PARTITION BY method ORDER BY idx) AS block FROM joined)
"""


@query(EDGES_SQL + BLOCKS_SQL + "SELECT method, block, count(*) AS statements FROM placed GROUP BY method, block")
def basic_blocks(spark, sf_dir):
    t = tokens(spark, sf_dir)
    return build.basic_blocks(t, build.statement_edges(t))[0].groupBy("method", "block").agg(F.count("*").alias("statements"))


@query(EDGES_SQL + BLOCKS_SQL + "SELECT DISTINCT e.method, a.block AS src, coalesce(b.block, e.dst) AS dst, e.kind FROM edges e JOIN placed a ON a.method = e.method AND a.idx = e.src LEFT JOIN placed b ON b.method = e.method AND b.idx = e.dst WHERE b.block IS NULL OR a.block <> b.block OR e.dst = b.block")
def block_edges(spark, sf_dir):
    t = tokens(spark, sf_dir)
    return build.basic_blocks(t, build.statement_edges(t))[1]


# ---------------------------------------------------------------- types: parts are statements over classes k0, k1, ..
# each under that of a third of its number; every part is a variable

PATHS_SQL = """paths(n, path) AS (SELECT CAST(0 AS BIGINT), 'any/k0' UNION ALL SELECT p_partkey, path || '/k' || p_partkey FROM paths JOIN part ON p_partkey // 3 = n AND p_partkey > 0),
st AS (SELECT p_partkey AS p, p_partkey % 8 AS j, p_partkey // 8 AS i, p_partkey // 2 AS half, p_partkey // 3 AS third FROM part),
literals AS (SELECT 'v' || p AS var, path AS type FROM st JOIN paths ON n = i WHERE j IN (0, 1)),
copies AS (SELECT 'v' || half AS src, 'v' || p AS dst FROM st WHERE j IN (2, 3, 4) UNION SELECT 'v' || third, 'v' || p FROM st WHERE j IN (3, 4)),
uses AS (SELECT 'v' || third AS var, 'f' || (p % 3) AS member, 'field' AS what, 'v' || p AS dst FROM st WHERE j IN (5, 6) UNION ALL SELECT 'v' || half, 'g' || (p % 2), 'method', 'v' || p FROM st WHERE j = 7),
members AS (SELECT path AS owner, 'f' || (n % 3) AS member, 'field' AS what, 'any/k0/k' || (n % 2 + 1) AS value FROM paths WHERE n < 9 UNION ALL SELECT path, 'g' || (n % 2), 'method', 'v' || (n * 8 + 1) FROM paths WHERE n < 5)"""


def _types_sql(rounds: int) -> str:
    """Rounds one by one: from what is known of each variable, everything that flows."""
    lub = "array_to_string(list_filter(list_transform(list_zip(min(string_split(type, '/')), max(string_split(type, '/')), range(99)), lambda z, k: CASE WHEN z[1] = z[2] THEN z[1] END), lambda x, k: x IS NOT NULL), '/')"
    # equal steps after a different one cannot occur: a step names all that is above it
    text = f"WITH RECURSIVE {PATHS_SQL}, t0 AS (SELECT var, {lub} AS type FROM literals GROUP BY var)"
    for n in range(rounds):
        text += f""", hit{n} AS (SELECT u.dst, u.what, arg_max(m.value, length(m.owner)) AS value FROM t{n} t JOIN uses u USING (var) LEFT JOIN members m ON m.member = u.member AND m.what = u.what AND (t.type = m.owner OR starts_with(t.type, m.owner || '/')) GROUP BY u.dst, u.what, u.var, u.member),
t{n + 1} AS (SELECT var, {lub} AS type FROM (SELECT * FROM t{n} UNION ALL SELECT c.dst, t.type FROM t{n} t JOIN copies c ON c.src = t.var UNION ALL SELECT dst, coalesce(value, 'any') FROM hit{n} WHERE what = 'field' OR value IS NULL UNION ALL SELECT h.dst, t.type FROM hit{n} h JOIN t{n} t ON h.what = 'method' AND t.var = h.value) GROUP BY var)"""
    return text + f" SELECT var, type FROM t{rounds}"


@query(_types_sql(24))
def inferred_types(spark, sf_dir):
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    name = lambda x, n: F.concat(F.lit(x), n.cast("long"))
    v = lambda n: name("v", n)
    paths = build.type_paths(p.where(k > 0).select(name("k", k).alias("child"), name("k", F.floor(k / 3)).alias("parent")))
    n = F.substring("type", 2, 20).cast("long")
    half, third = F.floor(k / 2), F.floor(k / 3)
    kind = lambda *j: p.where((k % 8).isin(*j))
    literals = kind(0, 1).select(v(k).alias("var"), name("k", F.floor(k / 8)).alias("type")).join(paths, "type").select("var", F.col("path").alias("type"))
    copies = kind(2, 3, 4).select(v(half).alias("src"), v(k).alias("dst")).union(kind(3, 4).select(v(third), v(k)))
    loads = kind(5, 6).select(v(third).alias("base"), name("f", k % 3).alias("field"), v(k).alias("dst"))
    calls = kind(7).select(v(half).alias("base"), name("g", k % 2).alias("name"), v(k).alias("dst"))
    fields = paths.where(n < 9).select(F.col("path").alias("type"), name("f", n % 3).alias("field"), F.concat(F.lit("any/k0/k"), n % 2 + 1).alias("kind"))
    methods = paths.where(n < 5).select(F.col("path").alias("type"), name("g", n % 2).alias("name"), v(n * 8 + 1).alias("result"))
    return build.infer_types(literals, copies, loads, calls, fields, methods)
