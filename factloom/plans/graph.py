"""Graph analyses: reachability, contexts, components, calls, points-to, data flow."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fixpoint import Grown, closure, cut, fixpoint, whole
from .flow import dominators, per_method  # noqa: F401


def reach_pairs(edges: DataFrame) -> DataFrame:
    """(src, dst) of all paths of at least one edge.  Its result is all pairs; where only some
    sources are asked for, use ``reached_from``.

    Edges without a source are none.  Those that hang together (``weak_parts``) go to one task if they are at most LOT, and that makes
    their pairs, so pairs are not shuffled.  For larger parts, a round makes the last one's new
    pairs longer by one edge, so each pair is extended once."""
    ways = cut(edges.select(F.col("src").alias("at"), F.col("dst").alias("to")).distinct().repartition("at")).hint("merge")
    dealt = ways.join(weak_parts(ways).hint("merge"), "at")
    many = cut(dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LOT).select("part"))
    names = f"src {ways.schema['at'].dataType.simpleString()}, dst {ways.schema['to'].dataType.simpleString()}"
    pairs = dealt.join(many, "part", "left_anti").groupBy("part").applyInArrow(_pairs_of, names)
    if many.isEmpty():
        return pairs
    ways = cut(dealt.join(many, "part", "left_semi").select("at", "to").repartition("at")).hint("merge")
    seed = ways.select(F.col("at").alias("src"), F.col("to").alias("dst"))
    step = lambda d, _: d.join(ways, F.col("dst") == F.col("at")).select("src", F.col("to").alias("dst"))
    return pairs.union(whole(fixpoint(seed, step, ["src", "dst"])).drop("round"))


#: edges that hang together, up to which one task makes their pairs
LOT = 4096


def weak_parts(ways: DataFrame) -> DataFrame:
    """(at, part): the smallest node that each source of ``ways`` (at, to) hangs together with, whichever way edges go."""
    both = cut(ways.union(ways.select("to", "at")).distinct().repartition("at")).hint("merge")
    part = cut(both.groupBy("at").agg(F.least("at", F.min("to")).alias("part")))
    changed = True
    while changed:
        told = part.join(both, "at").select(F.col("to").alias("at"), "part", F.lit(None).cast(part.schema["part"].dataType).alias("before"))
        new = cut(part.select("at", "part", F.col("part").alias("before")).union(told).groupBy("at").agg(F.min("part").alias("part"), F.min("before").alias("before")))
        part, changed = new.select("at", "part"), not new.where("part < before").isEmpty()
    return part


def _pairs_of(edges: pa.Table) -> pa.Table:
    """All paths among a few edges; what a node reaches is held as bits."""
    ends = [edges.column(c).to_pylist() for c in ("at", "to")]
    place = {node: i for i, node in enumerate(dict.fromkeys(ends[0] + ends[1]))}
    after = [[] for _ in place]
    for a, b in zip(*ends):
        after[place[a]].append(place[b])
    reach, changed = [sum(1 << b for b in ways) for ways in after], True
    while changed:
        changed = False
        for a, ways in enumerate(after):
            found = reach[a]
            for b in ways:
                found |= reach[b]
            if found != reach[a]:
                reach[a], changed = found, True
    size = -(-len(place) // 8)
    to = [np.flatnonzero(np.unpackbits(np.frombuffer(bits.to_bytes(size, "little"), "u1"), bitorder="little")) for bits in reach]
    src = np.repeat(np.arange(len(to)), [len(x) for x in to])
    of = lambda column, at: pa.array(list(place), edges.schema.field(column).type).take(pa.array(at))
    return pa.table({"src": of("at", src), "dst": of("to", np.concatenate(to))})


def reached_from(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node): what each start (column ``start``) reaches, itself included."""
    ways = cut(edges.select("src", "dst").distinct().repartition("src")).hint("merge")
    seed = starts.select("start", F.col("start").alias("node"))
    step = lambda d, _: d.join(ways, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node"))
    return whole(fixpoint(seed, step, ["start", "node"])).drop("round")


def components(edges: DataFrame) -> DataFrame:
    """Strongly connected components: (node, component), component the smallest member.

    Colouring: every node takes the smallest node that reaches it, and those that the
    namesake is reached from over nodes of its colour are its component; what is left is
    coloured anew.  Rounds grow with the depth of the graph, rows with its edges; no
    table of pairs is made."""
    ways = cut(edges.select("src", "dst").where("src <> dst").distinct().repartition("src")).hint("merge")
    left = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    done = None
    while True:
        # nodes without a way in or out are components of one, and need no colour
        ends = ways.select(F.col("src").alias("node")).distinct().join(ways.select(F.col("dst").alias("node")).distinct().hint("merge"), "node")
        marked = cut(left.join(ends.withColumn("open", F.lit(True)).hint("merge"), "node", "left"))
        lone = marked.where("open is null").select("node", F.col("node").alias("component"))
        done = lone if done is None else done.union(lone)
        left = marked.where("open").select("node")
        if left.isEmpty():
            return cut(done)
        colour = left.select("node", F.col("node").alias("colour"))
        while True:
            told = colour.join(ways, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), "colour", F.lit(False).alias("own"))
            both = colour.select("node", "colour", F.lit(True).alias("own")).union(told)
            new = both.groupBy("node").agg(F.min("colour").alias("colour"), F.min(F.when(F.col("own"), F.col("colour"))).alias("before"))
            new = cut(new.where("before is not null"))
            colour = new.select("node", "colour")
            if new.where("colour < before").isEmpty():
                break
        of = lambda end, name: colour.select(F.col("node").alias(end), F.col("colour").alias(name))
        inside = ways.join(of("src", "c"), "src").join(of("dst", "d").hint("merge"), "dst").where("c = d").select("src", "dst")
        found = closure(inside, colour.where("node = colour").select("node"), src="dst", dst="src")[0].select("node")
        found = found.hint("merge")
        done = cut(done.union(found.join(colour, "node").select("node", F.col("colour").alias("component"))))
        left = colour.select("node").join(found, "node", "left_anti")
        kept = colour.join(found, "node", "left_anti").select("node").hint("merge")
        ways = cut(ways.join(kept, F.col("src") == F.col("node"), "left_semi").join(kept, F.col("dst") == F.col("node"), "left_semi")).hint("merge")


def push(context, site, k):
    """A call site in front of a context of at most ``k`` sites."""
    return F.slice(F.concat(F.array(site), context), F.lit(1), k)


def pop(context):
    """A context without its first site."""
    return F.slice(context, 2, F.greatest(F.size(context), F.lit(1)))


def contexts(calls: DataFrame, roots: DataFrame, k: int, max_rounds: int | None = None) -> tuple[DataFrame, bool]:
    """Reachable (node, ctx) under ``k``-limited call strings; calls: (caller, callee, site)."""
    seed = roots.select("node", F.array().cast("array<bigint>").alias("ctx"))
    calls = cut(calls.select("caller", "callee", "site").repartition("caller")).hint("merge")

    def step(delta, _):
        found = delta.join(calls, F.col("node") == F.col("caller"))
        ctx = push(F.col("ctx"), F.col("site"), F.lit(k)) if k else F.array().cast("array<bigint>")
        return found.select(F.col("callee").alias("node"), ctx.alias("ctx"))

    return fixpoint(seed, step, ["node", "ctx"], max_rounds)


def matched_returns(calls: DataFrame, contexts_: DataFrame) -> DataFrame:
    """Return steps: a callee's context goes back to a call site only if that leads it."""
    back = contexts_.join(calls.hint("merge"), F.col("node") == F.col("callee")).where((F.size("ctx") > 0) & (F.col("ctx")[0] == F.col("site")))
    return back.select(F.col("caller").alias("node"), pop(F.col("ctx")).alias("ctx"), "site").distinct()


def adaptive_k(calls: DataFrame) -> DataFrame:
    """Fan-in per callee name and the context depth it gets: 2 from six callers, 1 from three, else 0."""
    fan = calls.groupBy("callee").agg(F.countDistinct("caller").alias("fan_in"), F.countDistinct("caller", "line").alias("sites"), F.bool_or("used").alias("used"))
    return fan.withColumn("k", F.when(F.col("fan_in") >= 6, 2).when(F.col("fan_in") >= 3, 1).otherwise(0))


# ---------------------------------------------------------------- call resolution


def subtypes(hierarchy: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(ancestor, descendant), each class below itself; cycles in the input do no harm.

    ``of`` (class): only these ancestors, so that no more pairs are made than are asked for."""
    ways = hierarchy.select(F.col("parent").alias("src"), F.col("child").alias("dst"))
    own = hierarchy.select(F.col("child").alias("start")).union(hierarchy.select("parent")).distinct()
    starts = own if of is None else own.join(of.select(F.col("class").alias("start")).distinct(), "start", "left_semi")
    return reached_from(ways, starts).select(F.col("start").alias("ancestor"), F.col("node").alias("descendant"))


def class_targets(calls: DataFrame, below: DataFrame, methods: DataFrame) -> DataFrame:
    """Class-hierarchy resolution: calls (site, class, name, kind) to concrete methods
    (class, name, abstract); static and special calls to their declared one only."""
    return call_shapes(calls, below, methods).join(calls.select("site", "class", "name", "kind"), ["class", "name", "kind"]).select("site", "target", "name").distinct()


def call_shapes(calls: DataFrame, below: DataFrame, methods: DataFrame) -> DataFrame:
    """(class, name, kind, target): targets of each different (class, name, kind) of calls,
    worked out once however many sites share it."""
    m = methods.where("not abstract").select(F.col("class").alias("target"), F.col("name").alias("m_name"))
    shapes = calls.select("class", "name", "kind").distinct()
    virtual = shapes.where("kind = 'virtual'").join(below, F.col("class") == F.col("ancestor")).join(m, (F.col("descendant") == F.col("target")) & (F.col("name") == F.col("m_name")))
    direct = shapes.where("kind <> 'virtual'").join(m, (F.col("class") == F.col("target")) & (F.col("name") == F.col("m_name")))
    return virtual.select("class", "name", "kind", "target").union(direct.select("class", "name", "kind", "target")).distinct()


def rapid_targets(calls: DataFrame, below: DataFrame, methods: DataFrame, created: DataFrame, roots: DataFrame) -> DataFrame:
    """Rapid-type resolution: methods (class.name) reached from ``roots`` (node), where a
    virtual call's target class must have been created by a reached method.

    calls: (site, caller, class, name, kind); created: (method, class).  Each round
    joins only what is new: the calls of new methods with all live classes, and the
    calls that waited for a class with the new ones."""
    targets = call_shapes(calls, below, methods).join(calls.select("caller", "class", "name", "kind"), ["class", "name", "kind"])
    targets = cut(targets.select("caller", "kind", "target", F.concat_ws(".", "target", "name").alias("callee")).distinct().repartition("caller"))
    reached = fresh = cut(roots.select("node").distinct())
    live = fresh.limit(0).select(F.col("node").alias("live"))
    while not fresh.isEmpty():
        born = created.join(fresh, F.col("method") == F.col("node"), "left_semi").select(F.col("class").alias("live")).distinct()
        born = cut(born.join(live, "live", "left_anti"))
        live = cut(live.union(born))
        opened = targets.join(fresh, F.col("caller") == F.col("node"), "left_semi")
        waited = targets.where("kind = 'virtual'").join(born, F.col("target") == F.col("live"), "left_semi").join(reached, F.col("caller") == F.col("node"), "left_semi")
        found = opened.where("kind <> 'virtual'").union(opened.where("kind = 'virtual'").join(live, F.col("target") == F.col("live"), "left_semi")).union(waited)
        fresh = cut(found.select(F.col("callee").alias("node")).distinct().join(reached, "node", "left_anti"))
        reached = cut(reached.union(fresh))
    return reached


# ---------------------------------------------------------------- points-to


def points_to(address: DataFrame, copies: DataFrame, loads: DataFrame, stores: DataFrame) -> DataFrame:
    """Inclusion-based points-to (var, obj) with fields.

    address: (var, obj); copies: (src, dst); loads: (base, field, dst); stores:
    (base, field, src).  A field of an object is a variable ``obj.field``; each new
    object of a base adds the copy edges of its loads and stores."""
    total, ways = Grown(address.select("var", "obj"), ["var", "obj"]), Grown(copies.select("src", "dst"), ["src", "dst"])
    move = lambda facts, edges: facts.join(edges, F.col("var") == F.col("src")).select(F.col("dst").alias("var"), "obj")
    while total.fresh:
        cell = F.concat_ws(".", F.col("obj"), F.col("field"))
        seen, old_ways = total.new.withColumnRenamed("var", "base"), ways.all
        ways.add(seen.join(loads, "base").select(cell.alias("src"), "dst").union(seen.join(stores, "base").select("src", cell.alias("dst"))))
        # new objects over all ways, all objects over new ways
        total.add(move(total.new, old_ways).union(move(total.all, ways.new)))
    return total.all


def may_alias(pts: DataFrame) -> DataFrame:
    """Pairs of variables (a < b) with a common object."""
    return pts.alias("x").join(pts.alias("y"), (F.col("x.obj") == F.col("y.obj")) & (F.col("x.var") < F.col("y.var"))).select(F.col("x.var").alias("a"), F.col("y.var").alias("b")).distinct()


# ---------------------------------------------------------------- control flow


def reaching_definitions(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """(method, block, var, def): definitions that reach a block's start.

    blocks: (method, block, var): the variable that a block defines, if any."""
    gen = blocks.where("var is not null").select("method", F.col("block").alias("at"), "var", F.col("block").alias("def"))
    ways = edges.select("method", F.col("src").alias("at"), F.col("dst").alias("to"))
    own = blocks.select("method", F.col("block").alias("at"), F.col("var").alias("killed"))
    seed = gen.join(ways, ["method", "at"]).select("method", F.col("to").alias("block"), "var", "def")

    def step(delta, _):
        through = delta.withColumnRenamed("block", "at").join(own, ["method", "at"]).where("killed is null or killed <> var")
        return through.join(ways, ["method", "at"]).select("method", F.col("to").alias("block"), "var", "def")

    return whole(fixpoint(seed, step, ["method", "block", "var", "def"])).drop("round")


def def_use(reaching: DataFrame, uses: DataFrame) -> DataFrame:
    """(method, def, use, var) links of definitions with the blocks that use them."""
    return reaching.join(uses.select("method", "block", "var"), ["method", "block", "var"]).select("method", "def", F.col("block").alias("use"), "var").distinct()


def dominator_tree(idoms: DataFrame) -> DataFrame:
    """(method, block, depth) below the entry, by the links to immediate dominators."""


    def rows(pdf):
        up = {b: None if i != i or i is None else int(i) for b, i in zip(pdf["block"].tolist(), pdf["idom"].tolist())}
        deep = {}
        for b in up:
            chain = []
            while b is not None and b in up and b not in deep:
                deep[b] = None  # on the chain: a cycle has no depth
                chain.append(b)
                b = up[b]
            base = -1 if b is None else deep.get(b)
            for at in reversed(chain):
                base = None if base is None else base + 1
                deep[at] = base
        return [(b, d) for b, d in deep.items() if d is not None]

    kind = idoms.schema["block"].dataType.simpleString()
    return per_method(idoms.select("method", "block", "idom"), rows, f"block {kind}, depth int")


def phi_places(blocks: DataFrame, idoms: DataFrame) -> DataFrame:
    """Where SSA form needs phi nodes: iterated dominance frontiers of the definitions."""


    def rows(pdf):
        front, todo, seen = {}, [], set()
        for b, to, v in zip(pdf["block"].tolist(), pdf["frontier"].tolist(), pdf["var"].tolist()):
            if to is not None:
                front.setdefault(b, []).extend(int(t) for t in to)
            if v is not None:
                todo.append((b, v))
        while todo:
            b, v = todo.pop()
            for t in front.get(b, ()):
                if (t, v) not in seen:
                    seen.add((t, v))
                    todo.append((t, v))
        return list(seen)

    both = idoms.where(F.size("frontier") > 0).select("method", "block", "frontier").unionByName(blocks.where("var is not null").select("method", "block", "var"), allowMissingColumns=True)
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    return per_method(both, rows, f"block {kind(idoms, 'block')}, var {kind(blocks, 'var')}")


def tabulate(flows: DataFrame, calls: DataFrame, returns: DataFrame, seeds: DataFrame) -> DataFrame:
    """IFDS tabulation: path edges (d1, n, d2) from a procedure's entry fact.

    flows: (n, d, to, e): inside a procedure; calls: (n, d, site, entry, e); returns:
    (exit, d, site, to, e); seeds: (n, d).  A round joins only new path edges: inside
    their procedure, into the ones they call, new callers with all known exits, and
    new exits with all known callers."""
    path = fresh = cut(seeds.select(F.concat_ws("/", "n", "d").alias("d1"), "n", F.col("d").alias("d2")).distinct())
    opened = None
    while not fresh.isEmpty():
        at = fresh.alias("p")
        inner = at.join(flows, (F.col("p.n") == flows["n"]) & (F.col("p.d2") == flows["d"])).select("p.d1", F.col("to").alias("n"), F.col("e").alias("d2"))
        call = cut(at.join(calls, (F.col("p.n") == calls["n"]) & (F.col("p.d2") == calls["d"])).select("p.d1", "site", "entry", "e").distinct())
        inside = call.select(F.concat_ws("/", "entry", "e").alias("d1"), F.col("entry").alias("n"), F.col("e").alias("d2"))
        exits = lambda p: p.select(F.col("d1").alias("own"), F.col("n").alias("exit"), F.col("d2").alias("d"))
        owner = lambda c: c.withColumn("own", F.concat_ws("/", "entry", "e")).drop("e")
        summary = owner(call).join(exits(path), "own")
        if opened is not None:
            summary = summary.unionByName(owner(opened).join(exits(fresh), "own"))
        back = summary.join(returns, ["exit", "d", "site"]).select("d1", F.col("to").alias("n"), returns["e"].alias("d2"))
        opened = cut(call if opened is None else opened.union(call).distinct())
        fresh = cut(inner.union(inside).union(back).distinct().join(path, ["d1", "n", "d2"], "left_anti"))
        path = cut(path.union(fresh))
    return path
