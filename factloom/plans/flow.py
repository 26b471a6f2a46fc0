"""Structure of control flow: dominators, loops, branches, single-assignment form, and data
flow with either meet.

What one method's graph needs in depth-first order is worked out per method, in arrays whose
size is that of its graph; everything else is joins and fixpoints over rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .fixpoint import fixpoint, whole, written

EXIT = -1
EDGES = ["method", "src", "dst"]


class Flow:
    """One method's graph from its entry: reverse postorder, immediate dominators, and the
    dominator tree's preorder intervals.  Blocks are numbered by reverse postorder."""

    def __init__(self, src, dst, entry: int):
        names, flat = np.unique(np.r_[entry, src, dst], return_inverse=True)
        m = (len(flat) - 1) // 2
        s, d, root = flat[1 : m + 1], flat[m + 1 :], int(flat[0])
        pairs = np.unique(np.stack([s, d], axis=1), axis=0) if m else np.zeros((0, 2), np.int64)
        first = np.searchsorted(pairs[:, 0], np.arange(len(names) + 1))
        after, seen, at = [], np.zeros(len(names), bool), first[:-1].copy()
        stack = [root]
        seen[root] = True
        while stack:
            v = stack[-1]
            if at[v] < first[v + 1]:
                w = int(pairs[at[v], 1])
                at[v] += 1
                if not seen[w]:
                    seen[w] = True
                    stack.append(w)
            else:
                after.append(stack.pop())
        order = np.array(after[::-1])
        place = np.full(len(names), -1)
        place[order] = np.arange(len(order))
        self.names, n = names[order], len(order)
        known = pairs[(place[pairs[:, 0]] >= 0)]
        self.edges = np.stack([place[known[:, 0]], place[known[:, 1]]], axis=1)
        self.before = [[] for _ in range(n)]
        self.after = [[] for _ in range(n)]
        for a, b in self.edges.tolist():
            self.before[b].append(a)
            self.after[a].append(b)
        up = [0] + [-1] * (n - 1)
        changed = True
        while changed:
            changed = False
            for v in range(1, n):
                new = -1
                for p in self.before[v]:
                    if up[p] >= 0:
                        new = p if new < 0 else self._meet(up, new, p)
                if new != up[v]:
                    up[v], changed = new, True
        self.up = up
        # sizes of subtrees give the intervals: a dominates b if first[a] <= first[b] <= last[a]
        size = [1] * n
        for v in range(n - 1, 0, -1):
            size[up[v]] += size[v]
        self.first, free = [0] * n, [1] * n
        for v in range(1, n):
            p = up[v]
            self.first[v] = self.first[p] + free[p]
            free[p] += size[v]
        self.last = [f + z - 1 for f, z in zip(self.first, size)]

    @staticmethod
    def _meet(up, a, b):
        while a != b:
            if a > b:
                a = up[a]
            else:
                b = up[b]
        return a

    def dominates(self, a: int, b: int) -> bool:
        return self.first[a] <= self.first[b] <= self.last[a]

    def frontiers(self) -> list[set]:
        out = [set() for _ in self.names]
        for v, ps in enumerate(self.before):
            if len(ps) > 1 or v == 0 and ps:
                for p in ps:
                    while p != self.up[v] or v == 0:
                        out[p].add(v)
                        if p == 0:
                            break
                        p = self.up[p]
        return out

    def kinds(self) -> list[str]:
        """For each edge ``back`` (its target dominates its source), ``irregular`` (it lies on
        a cycle that has no back edge) or ``forward``."""
        back = [self.dominates(b, a) for a, b in self.edges.tolist()]
        group = _components(len(self.names), [e for e, x in zip(self.edges.tolist(), back) if not x])
        return ["back" if x else "irregular" if group[a] == group[b] else "forward" for (a, b), x in zip(self.edges.tolist(), back)]

    def bodies(self) -> dict[int, set]:
        """Blocks of each natural loop, by its header."""
        out: dict[int, set] = {}
        for a, b in self.edges.tolist():
            if self.dominates(b, a):
                body, stack = out.setdefault(b, {b}), [a]
                while stack:
                    v = stack.pop()
                    if v not in body:
                        body.add(v)
                        stack += self.before[v]
        return out


def _components(n: int, edges: list) -> list[int]:
    """Strongly connected components by two depth-first walks."""
    nxt, prv = [[] for _ in range(n)], [[] for _ in range(n)]
    for a, b in edges:
        nxt[a].append(b)
        prv[b].append(a)
    seen, after = [False] * n, []
    for r in range(n):
        stack = [] if seen[r] else [(r, iter(nxt[r]))]
        seen[r] = True
        while stack:
            v, it = stack[-1]
            w = next(it, None)
            if w is None:
                after.append(v)
                stack.pop()
            elif not seen[w]:
                seen[w] = True
                stack.append((w, iter(nxt[w])))
    group = [-1] * n
    for r in reversed(after):
        stack = [r] if group[r] < 0 else []
        while stack:
            v = stack.pop()
            if group[v] < 0:
                group[v] = r
                stack += [w for w in prv[v] if group[w] < 0]
    return group


def _runs(batches):
    """The row batches of tables sorted by method as lists of (method, rows), none cut in two."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        m = pdf["method"].to_numpy()
        codes = pd.factorize(m, use_na_sentinel=False)[0]
        ends = [*(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(m)]
        out, start = [], 0
        if held:
            last = held[0]["method"].iloc[0]
            if last == m[0] or pd.isna(last) and pd.isna(m[0]):
                held.append(pdf.iloc[: ends[0]])
                start = ends[0]
            if start < len(m):
                out.append((last, pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]))
                held = []
        for end in ends:
            if start < end < len(m):
                out.append((m[start], pdf.iloc[start:end]))
                start = end
        if start < len(m):
            held = [pdf.iloc[start:]]
        yield out
    yield [(held[0]["method"].iloc[0], pd.concat(held, ignore_index=True))] if held else []


def per_method(table: DataFrame, rows, schema: str) -> DataFrame:
    """``rows(pdf)``, tuples of ``schema``, of every method's rows of ``table`` (method, ..).

    Methods are dealt out whole; a task takes its own one after the other, many to a batch,
    as most are far smaller than what a call of Python costs."""
    names = [c.split()[0] for c in schema.split(", ")]
    n = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        for group in _runs(batches):
            found = [(m, *r) for m, pdf in group for r in rows(pdf)]
            if found:
                yield pd.DataFrame(found, columns=["method", *names])

    kind = table.schema["method"].dataType.simpleString()
    return table.repartition(n, "method").sortWithinPartitions("method").mapInPandas(run, f"method {kind}, {schema}")


def _each(edges: DataFrame, rows, schema: str, entry: int) -> DataFrame:
    """``rows(flow)`` of every method."""
    return per_method(edges.select(*EDGES), lambda pdf: rows(Flow(pdf["src"].to_numpy(np.int64), pdf["dst"].to_numpy(np.int64), entry)), schema)


def dominators(edges: DataFrame, entry: int = 0) -> DataFrame:
    """(method, block, idom, frontier, first, last): immediate dominators, dominance frontiers
    and preorder intervals: a dominates b if first of a <= first of b <= last of a.  Blocks
    that the entry does not reach are left out."""

    def rows(f: Flow):
        n = f.names
        fronts = f.frontiers()
        return [(int(n[v]), int(n[f.up[v]]) if v else None, sorted(int(n[w]) for w in fronts[v]), f.first[v], f.last[v]) for v in range(len(n))]

    return _each(edges, rows, "block long, idom long, frontier array<long>, first long, last long", entry)


def post_dominators(edges: DataFrame) -> DataFrame:
    """(method, block, join): the first block that every way from a block to the method's end
    passes; null where that is the end itself.  Blocks from which no way ends are left out."""
    ends = edges.select("method", F.col("dst").alias("src")).join(edges.select("method", "src"), ["method", "src"], "left_anti").distinct()
    turned = edges.select("method", F.col("dst").alias("src"), F.col("src").alias("dst")).union(ends.select("method", F.lit(EXIT).cast("long"), "src"))
    doms = dominators(turned, EXIT).where(F.col("block") != EXIT)
    return doms.select("method", "block", F.when(F.col("idom") != EXIT, F.col("idom")).alias("join"))


def edge_kinds(edges: DataFrame, entry: int = 0) -> DataFrame:
    """(method, src, dst, kind): ``back``, ``irregular`` or ``forward``, whatever the numbers of blocks."""
    rows = lambda f: [(int(f.names[a]), int(f.names[b]), k) for (a, b), k in zip(f.edges.tolist(), f.kinds())]
    return _each(edges, rows, "src long, dst long, kind string", entry)


def loop_bodies(edges: DataFrame, entry: int = 0) -> DataFrame:
    """(method, header, block): the blocks of each natural loop."""
    rows = lambda f: [(int(f.names[h]), int(f.names[v])) for h, body in f.bodies().items() for v in body]
    return _each(edges, rows, "header long, block long", entry)


def loops(edges: DataFrame, entry: int = 0) -> DataFrame:
    """(method, header, latches, irregular): back edges into each header, and ways of cycles
    without one; a block into which only such lead is listed with no latch."""
    k = edge_kinds(edges, entry).where("kind <> 'forward'")
    return k.groupBy("method", F.col("dst").alias("header")).agg(F.count_if(F.col("kind") == "back").alias("latches"), F.count_if(F.col("kind") == "irregular").alias("irregular"))


def loop_nesting(bodies: DataFrame) -> DataFrame:
    """(method, header, blocks, depth, parent): size of each loop, how many loops hold its
    header, itself included, and the smallest of the others."""
    size = bodies.groupBy("method", "header").agg(F.count("*").alias("blocks"))
    holds = bodies.select("method", F.col("header").alias("outer"), F.col("block").alias("header"))
    outer = size.select("method", F.col("header").alias("outer"), F.col("blocks").alias("n"))
    held = size.join(holds, ["method", "header"]).join(outer, ["method", "outer"])
    other = F.when(F.col("outer") != F.col("header"), F.struct("n", "outer"))
    return held.groupBy("method", "header", "blocks").agg(F.count("*").alias("depth"), F.min(other)["outer"].alias("parent"))


def branches(edges: DataFrame, entry: int = 0) -> DataFrame:
    """(method, block, ways, join, kind): what each block of several successors opens.

    ``loop`` if it has a back edge or one of its ways leaves the loop that it heads;
    ``if`` if one way is the join; ``if-else`` if its two ways are its own until the join;
    ``switch`` for more of them; else ``open``: a way enters from elsewhere, or never ends."""
    e = edges.select(*EDGES).distinct()
    doms = written(dominators(edges, entry).select("method", "block", "first", "last"))
    side = lambda name: doms.select("method", F.col("block").alias(name), F.col("first").alias(f"{name}_first"), F.col("last").alias(f"{name}_last"))
    ways = e.join(side("src"), ["method", "src"]).join(side("dst"), ["method", "dst"])
    joins = post_dominators(edges).select("method", F.col("block").alias("src"), "join")
    ways = ways.join(joins, ["method", "src"], "left")
    body = written(loop_bodies(edges, entry)).select("method", F.col("header").alias("src"), F.col("block").alias("dst"), F.lit(True).alias("within"))
    heads = body.select("method", "src", F.lit(True).alias("heads")).distinct()
    ways = ways.join(body, ["method", "src", "dst"], "left").join(heads, ["method", "src"], "left")
    back = (F.col("dst_first") <= F.col("src_first")) & (F.col("src_first") <= F.col("dst_last"))
    own = (F.col("src_first") < F.col("dst_first")) & (F.col("dst_first") <= F.col("src_last"))
    straight = F.col("join").isNotNull() & (F.col("dst") == F.col("join"))
    one = ways.groupBy("method", F.col("src").alias("block"), "join").agg(
        F.count("*").alias("ways"), F.bool_or(back | (F.coalesce("heads", F.lit(False)) & F.col("within").isNull())).alias("loops"), F.count_if(straight).alias("direct"), F.count_if(own & ~straight).alias("own")
    )
    kind = F.when(F.col("loops"), "loop").when(F.col("join").isNull() | (F.col("direct") + F.col("own") < F.col("ways")), "open").when((F.col("ways") == 2) & (F.col("direct") == 1), "if").when(F.col("ways") == 2, "if-else").otherwise("switch")
    return one.where("ways > 1").select("method", "block", "ways", "join", kind.alias("kind"))


# ---------------------------------------------------------------- single assignment


def renamed(defs: DataFrame, uses: DataFrame, phis: DataFrame, doms: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Single-assignment names: (definitions, uses, operands of phis).

    defs, uses: (method, block, idx, var), in the order of ``idx``; a use comes before a
    definition of the same idx.  phis: (method, block, var); doms: of ``dominators``.
    Definitions get versions from 1 by (block, idx), a phi first: (method, block, idx, var,
    version), idx null for a phi; uses: (.., version), operands: (method, block, var, pred,
    version), version 0 where nothing is defined.  The version of a use is that of the last
    definition before it in its block, else of the block's phi, else of the innermost
    dominating block with either: an interval of the dominator tree that holds it."""
    every = defs.select("method", "block", "idx", "var").union(phis.select("method", "block", F.lit(None).cast("int"), "var"))
    w = Window.partitionBy("method", "var").orderBy("block", F.col("idx").asc_nulls_first())
    named = written(every.withColumn("version", F.row_number().over(w).cast("long")))
    span = doms.select("method", "block", "first", "last").hint("merge")  # large and written compressed: its size on disk says too little for a broadcast
    # what a block leaves behind, as an interval of blocks below it
    left = named.groupBy("method", "var", "block").agg(F.max_by("version", F.coalesce("idx", F.lit(-1))).alias("out")).join(span, ["method", "block"])
    left = left.select("method", "var", F.col("first").alias("d_first"), F.col("last").alias("d_last"), "out").hint("merge")

    def above(points: DataFrame, keys: list[str]) -> DataFrame:
        """The innermost definition of points (method, var, first, ..) strictly above, or also in, their block."""
        j = points.join(left, ["method", "var"], "left")
        holds = (F.col("d_first") <= F.col("upto")) & (F.col("first") <= F.col("d_last"))
        return j.groupBy(*keys).agg(F.max_by("out", F.when(holds, F.col("d_first"))).alias("out"))

    inner = named.select("method", "block", "var", F.col("idx").alias("d_idx"), "version").hint("merge")
    keys = ["method", "block", "idx", "var"]
    at = uses.select(*keys).distinct()
    near = at.join(inner, ["method", "block", "var"]).where("d_idx is null or d_idx < idx").groupBy(*keys).agg(F.max_by("version", F.coalesce("d_idx", F.lit(-1))).alias("near"))
    far = above(at.join(span, ["method", "block"]).withColumn("upto", F.col("first") - 1), keys)
    used = far.join(near.hint("merge"), keys, "left").select(*keys, F.coalesce("near", "out", F.lit(0).cast("long")).alias("version"))
    preds = phis.join(edges.select("method", F.col("dst").alias("block"), F.col("src").alias("pred")).distinct().hint("merge"), ["method", "block"])
    preds = preds.join(span.withColumnRenamed("block", "pred").hint("merge"), ["method", "pred"]).withColumn("upto", F.col("first"))
    keys = ["method", "block", "var", "pred"]
    operands = above(preds, keys).select(*keys, F.coalesce("out", F.lit(0).cast("long")).alias("version"))
    return named, used, operands


# ---------------------------------------------------------------- data flow


def dataflow(blocks: DataFrame, edges: DataFrame, gen: DataFrame, kill: DataFrame, meet: str = "union", direction: str = "forward", boundary: DataFrame | None = None) -> DataFrame:
    """(method, block, fact): what holds where a block is entered (backward: left).

    blocks: (method, block); gen, kill: (method, block, fact), a block that does both leaves
    the fact.  ``union``: on some way; ``intersection``: on all ways, the greatest fixpoint.
    That one starts from everything and each round removes what some neighbour does not
    give: facts killed, or removed before and not made anew.  Blocks without a neighbour on
    that side hold nothing, those of ``boundary`` (method, block) neither."""
    if meet not in ("union", "intersection") or direction not in ("forward", "backward"):
        raise ValueError(f"no data flow {meet} {direction}")
    a, b = ("src", "dst") if direction == "forward" else ("dst", "src")
    ways = edges.select("method", F.col(a).alias("block"), F.col(b).alias("to")).distinct()
    key = ["method", "block", "fact"]
    gen, kill = gen.select(*key).distinct(), kill.select(*key).distinct()
    on = lambda rows: rows.join(ways, ["method", "block"]).select("method", F.col("to").alias("block"), "fact")
    if meet == "union":
        return whole(fixpoint(on(gen), lambda d, _: on(d.join(kill, key, "left_anti")), key)).drop("round")
    facts = gen.select("method", "fact").distinct()
    every = blocks.select("method", "block").distinct().join(facts, "method")
    shut = blocks.select("method", "block").join(ways.select("method", F.col("to").alias("block")), ["method", "block"], "left_anti")
    if boundary is not None:
        shut = shut.union(boundary.select("method", "block"))
    lost = kill.join(facts, ["method", "fact"], "left_semi").select(*key).join(gen, key, "left_anti")
    seed = shut.distinct().join(facts, "method").select(*key).union(on(lost))
    gone = whole(fixpoint(seed, lambda d, _: on(d.join(gen, key, "left_anti")), key))
    return every.select(*key).join(gone.select(*key), key, "left_anti")
