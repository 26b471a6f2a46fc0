"""Program text and structure: JSON and text forms of methods, checks, operators as data,
sets as bitmaps, loops, trees and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import graph
from ..plans.fixpoint import written
from .build import tasks

STATEMENT = "array<struct<idx:bigint,op:string,text:string>>"


def to_json(statements: DataFrame) -> DataFrame:
    """(method, json): one object for each method (method, idx, op, text)."""
    body = F.array_sort(F.collect_list(F.struct(F.col("idx").cast("long").alias("idx"), "op", "text")))
    one = statements.groupBy("method").agg(body.alias("body"))
    return one.select("method", F.to_json(F.struct("method", "body")).alias("json"))


def from_json(rows: DataFrame) -> DataFrame:
    """Statements (method, idx, op, text) of the objects (json); a bad one is an error."""
    got = F.from_json("json", f"method bigint, body {STATEMENT}", {"mode": "FAILFAST"})
    return rows.select(got.alias("g")).select("g.method", F.inline("g.body"))


def printed(statements: DataFrame, indent: str = "  ") -> DataFrame:
    """(method, text): statements (method, idx, depth, text) in order, each on its line,
    indented by its depth."""
    line = F.concat(F.repeat(F.lit(indent), F.col("depth").cast("int")), F.col("text"))
    one = statements.select("method", "idx", line.alias("line")).groupBy("method").agg(F.array_sort(F.collect_list(F.struct("idx", "line"))).alias("lines"))
    return one.select("method", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text"))


def folded(op: Column, a: Column, b: Column) -> Column:
    """What an integer operator gives for constants; null for one that is not known, and for
    division by zero.  Comparisons give 0 or 1; ``-``, ``~`` and ``!`` of one value have no ``a``."""
    flag = lambda c: c.cast("long")
    table = [
        ("+", a + b), ("*", a * b), ("&", a.bitwiseAND(b)), ("|", a.bitwiseOR(b)), ("^", a.bitwiseXOR(b)), ("<", flag(a < b)), ("<=", flag(a <= b)), (">", flag(a > b)), (">=", flag(a >= b)),
        ("==", flag(a == b)), ("===", flag(a == b)), ("!=", flag(a != b)), ("!==", flag(a != b)), ("&&", F.when(a == 0, a).otherwise(b)), ("||", F.when(a != 0, a).otherwise(b)), ("??", F.coalesce(a, b)), ("~", F.bitwise_not(b)), ("!", flag(b == 0)),
    ]
    out = F.when(op == "-", F.when(a.isNull(), -b).otherwise(a - b)).when(op == "%", F.when(b != 0, a % F.when(b != 0, b)))
    for name, value in table:
        out = out.when(op == name, value)
    return out.cast("long")


def provenance_filter(calls: DataFrame, origins: DataFrame, sdk: tuple[str, ...]) -> DataFrame:
    """Calls (.., method) whose method comes (method, origin) from one of the ``sdk`` origins."""
    return calls.join(origins.where(F.col("origin").isin(*sdk)).select("method").distinct(), "method", "left_semi")


def bitmaps(rows: DataFrame) -> DataFrame:
    """(owner, bucket, bits): sets of ids (owner, id) as bitmaps of 32768 places.

    Ids are dealt out, not bitmaps, which are large next to the ids they hold and shrink so much
    when written that too many of them would come to one task."""
    placed = rows.select("owner", "id", F.bitmap_bucket_number("id").alias("bucket"))
    placed = placed.repartition(tasks(rows.sparkSession, rows.count(), 1 << 18), "owner", "bucket")
    return placed.groupBy("owner", "bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))


def union_sizes(maps: DataFrame) -> DataFrame:
    """(group, members): sizes of the unions of bitmaps (group, bucket, bits)."""
    each = maps.groupBy("group", "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n"))
    return each.groupBy("group").agg(F.sum("n").alias("members"))


def compared(maps: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, common, only_a, only_b, equal, within): how the sets of ``pairs`` (a, b) of owners
    of bitmaps (owner, bucket, bits) lie to each other: sizes of their intersection and of
    both differences, whether they are equal, and whether a lies within b.  An owner
    without a bitmap is the empty set."""
    pairs = pairs.select("a", "b").distinct()
    side = lambda end: pairs.join(maps, F.col(end) == F.col("owner")).select("a", "b", "bucket", F.lit(end).alias("side"), "bits")
    n = F.bitmap_count
    own = lambda end: F.coalesce(n(F.bitmap_or_agg(F.when(F.col("side") == end, F.col("bits")))), F.lit(0))
    met = F.when(F.count("*") == 2, n(F.bitmap_and_agg("bits"))).otherwise(0)
    each = side("a").union(side("b")).groupBy("a", "b", "bucket").agg(own("a").alias("in_a"), own("b").alias("in_b"), met.alias("common"))
    total = each.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("in_a", "in_b", "common")])
    every = pairs.join(total, ["a", "b"], "left").na.fill(0, ["in_a", "in_b", "common"])
    return every.select("a", "b", "common", (F.col("in_a") - F.col("common")).alias("only_a"), (F.col("in_b") - F.col("common")).alias("only_b"), ((F.col("in_a") == F.col("common")) & (F.col("in_b") == F.col("common"))).alias("equal"), (F.col("in_a") == F.col("common")).alias("within"))


def passes(statements: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(method, rule, hits): a visitor of each kind of statement: per method how many meet
    each rule's condition, none left out."""
    counted = statements.groupBy("method").agg(*[F.count_if(cond).alias(name) for name, cond in rules.items()])
    return counted.select("method", F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("hits")) for n in rules])))


def handled(values: DataFrame, handlers: dict[str, Column], default: Column) -> DataFrame:
    """(id, out): each value (id, kind, ..) by the handler of its kind."""
    out = default
    for kind, f in reversed(list(handlers.items())):
        out = F.when(F.col("kind") == kind, f).otherwise(out)
    return values.select("id", out.alias("out"))


def tree(nodes: DataFrame) -> DataFrame:
    """(node, depth, path): a component tree from its parent table (node, parent or null)."""
    ways = nodes.where("parent is not null").select(F.col("parent").alias("src"), F.col("node").alias("dst"))
    level = nodes.where("parent is null").select("node", F.lit(0).alias("depth"), F.col("node").cast("string").alias("path"))
    out = level
    while not level.isEmpty():
        level = graph.cut(level.join(ways, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), (F.col("depth") + 1).alias("depth"), F.concat_ws("/", "path", "dst").alias("path")))
        out = out.union(level)
    return out


def profile(steps: DataFrame, top: int = 3) -> DataFrame:
    """(section, reason, n, total, most, place): work counted by section and reason
    (section, reason, cost), the ``top`` costliest reasons of each section."""
    one = steps.groupBy("section", "reason").agg(F.count("*").alias("n"), F.sum("cost").alias("total"), F.max("cost").alias("most"))
    w = Window.partitionBy("section").orderBy(F.desc("total"), "reason")
    return one.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)


def evidence_graph(derivations: DataFrame, verdicts: DataFrame, gaps: DataFrame) -> DataFrame:
    """(src, dst, kind, status): derivations (src, dst, certificate) with their certificate's
    verdict (certificate, verdict), and gaps (src, dst, reason): dead ones do not carry."""
    d = derivations.join(verdicts, "certificate", "left")
    status = F.when(F.col("verdict").isNull(), "unproved").when(F.col("verdict") == "dead", "blocked").otherwise("carries")
    return d.select("src", "dst", F.lit("derivation").alias("kind"), status.alias("status")).unionByName(gaps.select("src", "dst", F.lit("gap").alias("kind"), F.col("reason").alias("status")))


def depends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, kind, uses, used): a typed graph's nodes (node, kind) with how many different
    edges (src, dst, kind) leave and reach them."""
    e = edges.select("src", "dst", "kind").distinct()
    out = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("uses"))
    into = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("used"))
    return nodes.join(out, "node", "left").join(into, "node", "left").select("node", "kind", F.coalesce("uses", F.lit(0)).alias("uses"), F.coalesce("used", F.lit(0)).alias("used"))


def problems(statements: DataFrame, methods: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, problem): statements (id, method, kind, target) of an unknown method, repeated
    ids, jumps to nothing, and edges (src, dst) that end at no statement."""
    lost = statements.join(methods, "method", "left_anti").select("id", F.lit("unknown method").alias("problem"))
    twice = statements.groupBy("id").count().where("count > 1").select("id", F.lit("repeated id").alias("problem"))
    jump = statements.where("kind = 'jump' and target is null").select("id", F.lit("jump to nothing").alias("problem"))
    ends = edges.select(F.col("dst").alias("id")).join(statements.select("id"), "id", "left_anti").select("id", F.lit("edge to nothing").alias("problem"))
    return lost.union(twice).union(jump).union(ends).distinct()


def inventory(declarations: DataFrame) -> DataFrame:
    """(owner, members, first, last): a declaration inventory (owner, member) by owner."""
    return declarations.groupBy("owner").agg(F.count("*").alias("members"), F.min("member").alias("first"), F.max("member").alias("last"))


def built_tree(events: DataFrame) -> DataFrame:
    """(view, node, parent, name, depth): a component tree from its build stream.

    events: (view, idx, kind, name) in order of ``idx``: ``create`` opens a component, ``pop``
    closes the last open one.  A node is named by its idx; its parent is the last component
    created one level above before it.  Pops without a component are ignored, components
    that are never popped stay open to the end."""
    order = Window.partitionBy("view").orderBy("idx")
    step = F.when(F.col("kind") == "create", 1).when(F.col("kind") == "pop", -1).otherwise(0)
    run = events.withColumn("sum", F.sum(step).over(order))
    # a pop too many lowers the floor from which depth counts
    floor = F.least(F.min("sum").over(order), F.lit(0))
    run = run.withColumn("depth", (F.col("sum") - floor - 1).cast("int")).where("kind = 'create'").select("view", "idx", "name", "depth")
    asked = run.select("view", (F.col("depth") - 1).alias("level"), "idx", "name", "depth", F.lit(None).cast("long").alias("made"))
    given = run.select("view", F.col("depth").alias("level"), "idx", F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("depth"), F.col("idx").cast("long").alias("made"))
    near = Window.partitionBy("view", "level").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    found = asked.unionByName(given).withColumn("parent", F.last("made", ignorenulls=True).over(near)).where("made is null")
    return found.select("view", F.col("idx").cast("long").alias("node"), "parent", "name", "depth")


def expanded_tree(trees: DataFrame, roots: DataFrame) -> DataFrame:
    """(view, path, parent, name, depth, recursive): the trees (of ``built_tree``) of the views
    ``roots`` (view), each component that is a view itself with that view's tree below it.

    ``path`` names the nodes from the root on, by their numbers in the streams; a component
    within itself is not expanded again but marked ``recursive``.  Rounds grow with how deeply
    components are nested, the result with the expanded trees.  Rounds follow only the places
    where a view stands; once so many places share a view, that view is expanded by itself, once,
    and put below each of them at the end, so no expanded tree is written."""
    own = written(trees.select("view", F.col("node").cast("string").alias("node"), F.col("parent").cast("string").alias("parent"), "name", "depth"))
    inner = written(own.join(own.select(F.col("view").alias("name")).distinct(), "name", "left_semi").select("view", "node", "name", "depth"))
    none = F.lit(None)
    start = own.join(roots.select("view").distinct(), "view", "left_semi").select("view").distinct()
    ringed = _ringed(inner.select("view", "name").distinct())
    return _expanded(_chained(start.select("view", none.cast("array<string>").alias("chain"), none.cast("string").alias("ring")), ringed), own, inner, ringed).select("view", "path", "parent", "name", "depth", "recursive")


def _ringed(ways: DataFrame) -> DataFrame:
    """(view, ring): views on cycles of ``ways`` (view, name), and the strong component they are in.
    Only what is above in the same one can come again below; all else does not matter there."""
    left, n = graph.cut(ways), -1
    while n != (n := left.count()):  # views that nothing leads to or that lead to nothing are on none
        some = left.join(left.select(F.col("name").alias("view")).distinct(), "view", "left_semi")
        left = graph.cut(some.join(left.select(F.col("view").alias("name")).distinct(), "name", "left_semi").select("view", "name"))
    of = graph.components(left.select(F.col("view").alias("src"), F.col("name").alias("dst"))) if n else None
    if of is None:
        return left.select("view", F.col("view").alias("ring"))
    ring = lambda end: of.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
    on = left.join(ring("view"), "view").join(ring("name"), "name").where("of_view = of_name")
    return graph.cut(on.select("view", F.col("of_view").alias("ring")).distinct())


def _chained(at: DataFrame, ringed: DataFrame) -> DataFrame:
    """Places (view, chain, ring, ..), the chain and ring of those above them, with their own: a chain holds what is
    above in the view's ring."""
    own = at.join(ringed.withColumnRenamed("ring", "__ring"), "view", "left")
    one = F.array("view")
    chain = F.when(F.col("__ring").isNull(), F.array().cast("array<string>")).when(F.col("ring") == F.col("__ring"), F.concat("chain", one)).otherwise(one)
    return own.select(*[{"chain": chain.alias("chain"), "ring": F.col("__ring").alias("ring")}.get(c, F.col(c)) for c in at.columns])


#: places of one view, in the mean, from which on views are expanded by themselves
SHARED = 1024
#: places of one view that are put together with what lies below it in one task
PLACES = 4096


def _expanded(starts: DataFrame, own: DataFrame, inner: DataFrame, ringed: DataFrame) -> DataFrame:
    """(view, chain, path, parent, name, depth, recursive): the trees below ``starts`` (view, chain, ring),
    with paths and depths from there on."""
    under = F.when(F.col("under") != "", F.col("under"))
    path, depth = F.concat_ws("/", under, "node"), F.col("base") + F.col("depth")
    above = F.when(F.col("parent").isNull(), under).otherwise(F.concat_ws("/", under, "parent"))
    top = [F.col("top_view").alias("view"), F.col("top_chain").alias("chain")]

    def shown(rows, recursive):
        return rows.select(*top, path.alias("path"), above.alias("parent"), "name", depth.alias("depth"), recursive.alias("recursive"))

    level = written(starts.select(F.col("view").alias("top_view"), F.col("chain").alias("top_chain"), "view", "chain", "ring", F.lit("").alias("under"), F.lit(0).alias("base")))
    places, below = None, None
    while True:
        each = level.groupBy("view", "chain", "ring").agg(F.count(F.lit(1)).alias("n"))
        n, of = each.agg(F.sum("n"), F.count(F.lit(1))).first()
        if not n:
            break
        if n >= SHARED * of:  # written, as what it holds is read at every place
            tree = written(_expanded(each.select("view", "chain", "ring"), own, inner, ringed).withColumnRenamed("path", "node"))
            times = each.select("view", "chain", F.ceil(F.col("n") / PLACES).alias("times"))
            made = each.join(tree.groupBy("view", "chain").count(), ["view", "chain"]).agg(F.sum(F.col("n") * F.col("count"))).first()[0]
            size = tasks(own.sparkSession, made, 1 << 22)
            lot = F.pmod(F.xxhash64("top_view", "top_chain", "under"), F.col("times")).alias("lot")
            at = level.join(times, ["view", "chain"]).select(*level.columns, lot).repartition(size, "view", "chain", "lot")
            tree = tree.join(times, ["view", "chain"]).withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1))).drop("times").repartition(size, "view", "chain", "lot")
            below = shown(at.join(tree, ["view", "chain", "lot"]), F.col("recursive"))
            break
        places = level if places is None else places.union(level)
        on = level.join(inner, "view").where(~F.array_contains("chain", F.col("name")))
        found = on.select("top_view", "top_chain", F.col("name").alias("view"), "chain", "ring", path.alias("under"), (depth + 1).alias("base"))
        level = written(_chained(found, ringed))
    made = shown((level if places is None else places).join(own, "view"), F.array_contains("chain", F.col("name")))
    return made if below is None else made.union(below)
