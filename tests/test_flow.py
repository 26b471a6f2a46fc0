"""Control flow against brute force: removal of blocks, random walks, plain sets, a small reader of programs."""

import random

import pytest

from pyspark.sql import functions as F

from factloom.operators import build
from factloom.plans import flow, graph, queries_build


def reach(edges, start, without=None):
    seen, stack = set(), [start] if start != without else []
    while stack:
        v = stack.pop()
        if v not in seen:
            seen.add(v)
            stack += [b for a, b in edges if a == v and b != without]
    return seen


def graphs(n, seed):
    rng = random.Random(seed)
    for _ in range(n):
        k = rng.randrange(1, 12)
        names = rng.sample(range(1, 40), k)
        at = [0, *names]
        edges = {(at[i], at[i + 1]) for i in range(k) if rng.random() < 0.9} | {(rng.choice(at), rng.choice(at)) for _ in range(rng.randrange(0, 2 * k))}
        yield sorted(edges or {(0, 0)})


def test_dominance_loops_and_kinds():
    for edges in graphs(300, 1):
        f = flow.Flow([a for a, _ in edges], [b for _, b in edges], 0)
        known = reach(edges, 0)
        names = f.names.tolist()
        assert set(names) == known
        dom = {(a, b) for a in known for b in known if a == b or b not in reach(edges, 0, without=a)}
        assert {(names[a], names[b]) for a in range(len(names)) for b in range(len(names)) if f.dominates(a, b)} == dom
        live = [(a, b) for a, b in edges if a in known]
        front = {(n, d) for n in known for p, d in live if (n, p) in dom and not ((n, d) in dom and n != d)}
        assert {(names[v], names[w]) for v, ws in enumerate(f.frontiers()) for w in ws} == front
        back = {e for e in live if (e[1], e[0]) in dom}
        rest = [e for e in live if e not in back]
        kinds = {(names[a], names[b]): k for (a, b), k in zip(f.edges.tolist(), f.kinds())}
        assert kinds == {e: "back" if e in back else "irregular" if e[0] in reach(rest, e[1]) else "forward" for e in live}
        bodies = {}
        for a, h in back:
            turned = [(y, x) for x, y in live if y != h]
            bodies.setdefault(h, {h}).update(reach(turned, a) if a != h else {h})
        assert {names[h]: {names[v] for v in b} for h, b in f.bodies().items()} == bodies


def test_loops_do_not_depend_on_numbers(spark):
    """0 -> 5 -> 2 -> 5, 5 -> 9: the header has the larger number."""
    e = spark.createDataFrame([("m", 0, 5), ("m", 5, 2), ("m", 2, 5), ("m", 5, 9), ("i", 0, 1), ("i", 0, 2), ("i", 1, 2), ("i", 2, 1)], "method string, src long, dst long")
    assert sorted(map(tuple, flow.loops(e).collect())) == [("i", 1, 0, 1), ("i", 2, 0, 1), ("m", 5, 1, 0)]
    assert sorted(map(tuple, flow.loop_bodies(e).collect())) == [("m", 5, 2), ("m", 5, 5)]
    assert [(r.block, r.kind) for r in flow.branches(e).where("method = 'm'").collect()] == [(5, "loop")]


def test_names_follow_every_walk(spark):
    """A use's version, phis filled in from the block one comes from, is what was set last."""
    rng, edges, defs, uses = random.Random(4), [], [], []
    for m, es in enumerate(graphs(12, 5)):
        edges += [(f"m{m}", a, b) for a, b in es]
        for b in sorted({x for e in es for x in e} | {0}):
            for i in range(4):
                if rng.random() < 0.4:
                    (defs if rng.random() < 0.5 else uses).append((f"m{m}", b, i, rng.choice("xy")))
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    e = frame(edges, "method string, src long, dst long")
    doms = flow.dominators(e)
    known = doms.select("method", "block")
    d = frame(defs, "method string, block long, idx int, var string").join(known, ["method", "block"], "left_semi")
    u = frame(uses, "method string, block long, idx int, var string").join(known, ["method", "block"], "left_semi")
    reached = e.join(known.withColumnRenamed("block", "src"), ["method", "src"], "left_semi").select("method", "src", "dst")
    named, used, operands = flow.renamed(d, u, graph.phi_places(d.select("method", "block", "var").distinct(), doms), doms, reached)
    version = {(r.method, r.block, r.idx, r.var): r.version for r in named.collect()}
    reads = {(r.method, r.block, r.idx, r.var): r.version for r in used.collect()}
    takes = {(r.method, r.block, r.var, r.pred): r.version for r in operands.collect()}
    assert set(reads) == {tuple(r) for r in u.collect()} and len({(m, v, x) for (m, _, _, v), x in version.items()}) == len(version)
    nxt = {}
    for m, a, b in edges:
        nxt.setdefault((m, a), set()).add(b)
    checked = 0
    for m in sorted({m for m, _, _ in edges}):
        for _ in range(40):
            at, held, last = 0, {}, {}
            for _ in range(25):
                for i in range(4):
                    for v in "xy":
                        if (m, at, i, v) in reads:
                            assert held.get((v, reads[m, at, i, v])) == last.get(v)
                            checked += 1
                    for v in "xy":
                        if (m, at, i, v) in version:
                            last[v] = (at, i)
                            held[v, version[m, at, i, v]] = (at, i)
                ways = sorted(nxt.get((m, at), ()))
                if not ways:
                    break
                to = rng.choice(ways)
                filled = {v: held.get((v, takes[m, to, v, at])) for v in "xy" if (m, to, None, v) in version}
                held.update({(v, version[m, to, None, v]): x for v, x in filled.items()})
                at = to
    assert checked > 500


@pytest.mark.parametrize("meet,direction", [("union", "forward"), ("union", "backward"), ("intersection", "forward"), ("intersection", "backward")])
def test_data_flow_by_plain_sets(spark, meet, direction):
    rng, edges, gen, kill, blocks, want = random.Random(6), [], [], [], [], set()
    for m, es in enumerate(graphs(15, 7)):
        nodes = sorted({x for e in es for x in e} | {0})
        g = {b: {f for f in "pqr" if rng.random() < 0.3} for b in nodes}
        k = {b: {f for f in "pqr" if rng.random() < 0.3} for b in nodes}
        facts = set().union(*g.values())
        ways = [(a, b) if direction == "forward" else (b, a) for a, b in es]
        before = {b: [a for a, c in ways if c == b] for b in nodes}
        shut = {b for b in nodes if not before[b]} | {0}
        at = {b: set() if meet == "union" or b in shut else set(facts) for b in nodes}
        changed = True
        while changed:
            changed = False
            for b in nodes:
                outs = [g[a] | (at[a] - k[a]) for a in before[b]]
                new = set().union(*outs) if meet == "union" else set() if b in shut else set.intersection(*outs) & facts
                changed |= new != at[b]
                at[b] = new
        name = f"m{m}"
        want |= {(name, b, f) for b in nodes for f in at[b]}
        edges += [(name, a, b) for a, b in es]
        blocks += [(name, b) for b in nodes]
        gen += [(name, b, f) for b in nodes for f in g[b]]
        kill += [(name, b, f) for b in nodes for f in k[b]]
    fact = "method string, block long, fact string"
    b = spark.createDataFrame(blocks, "method string, block long")
    got = flow.dataflow(b, spark.createDataFrame(edges, "method string, src long, dst long"), spark.createDataFrame(gen, fact), spark.createDataFrame(kill, fact), meet, direction, b.where("block = 0"))
    assert {tuple(r) for r in got.collect()} == want and want


# ---------------------------------------------------------------- statements


def read_program(kinds):
    """Edges of one method by reading it recursively."""
    edges, n = set(), len(kinds)

    def block(i, loop, left, handler, stop):
        """Reads statements from i up to one of ``stop``; returns where it stands."""
        while i < n and kinds[i] not in stop:
            i = one(i, loop, left, handler)
        return i

    spans = {}

    def scan(i):
        """Parts of each region: its start, middle parts and end."""
        start, parts = i, []
        i += 1
        while kinds[i] != "end":
            if kinds[i] in build.MID:
                parts.append(i)
                i += 1
            elif kinds[i] in build.OPEN:
                i = scan(i) + 1
            else:
                i += 1
        spans[start] = (parts, i)
        return i

    i = 0
    while i < n:
        i = scan(i) + 1 if kinds[i] in build.OPEN else i + 1
    owner = {p: s for s, (parts, _) in spans.items() for p in parts}

    def fall(i):
        if i >= n:
            return -1
        if kinds[i] == "else":
            return spans[owner[i]][1]
        if kinds[i] == "catch":
            parts, end = spans[owner[i]]
            return next((p for p in parts if kinds[p] == "finally"), end)
        return i

    def one(i, loop, left, handler):
        k = kinds[i]
        if k not in build.OPEN:
            if k == "stmt" and handler is not None:
                edges.add((i, handler, "exception"))
            if k in ("break", "continue", "return"):
                to = {"break": left, "continue": loop, "return": -1}[k]
                edges.add((i, -1 if to is None else to, "jump"))
            elif k == "throw":
                edges.add((i, -1 if handler is None else handler, "exception"))
            else:
                edges.add((i, fall(i + 1), "next"))
            return i + 1
        parts, end = spans[i]
        part = {kinds[p]: p for p in parts}
        inner = (loop, left, handler)
        if k == "if":
            edges.update({(i, fall(i + 1), "true"), (i, part.get("else", end), "false")})
        elif k == "loop":
            edges.update({(i, fall(i + 1), "true"), (i, fall(end + 1), "false"), (end, i, "back")})
            inner = (i, fall(end + 1), handler)
        elif k == "switch":
            edges.update({(i, p, "case") for p in parts} | ({(i, end, "case")} if "default" not in part else set()))
            inner = (loop, end, handler)
        else:
            edges.add((i, fall(i + 1), "next"))
        if k != "loop":
            edges.add((end, fall(end + 1), "next"))
        guard = min((p for p in parts), default=end)
        at = i + 1
        for p in [*parts, end]:
            in_guard = k == "try" and at <= guard
            at = block(at, *inner[:2], part.get("catch", part.get("finally")) if in_guard else inner[2], [*build.MID, "end"])
            if p != end:
                edges.add((p, fall(p + 1), "next"))
                at = p + 1
        return end + 1

    block(0, None, None, None, [])
    return edges


def test_statements_as_read_by_a_reader(spark):
    rng, rows, want = random.Random(8), [], set()
    for m in range(40):
        kinds = " ".join(rng.choice(queries_build.SNIPPETS) for _ in range(rng.randrange(1, 6))).split()
        for _ in range(rng.randrange(3)):
            a, b = rng.choice(queries_build.AROUND)
            kinds = [*a.split(), *kinds, *b.split()]
        rows += [(f"m{m}", i, k) for i, k in enumerate(kinds)]
        want |= {(f"m{m}", *e) for e in read_program(kinds)}
    t = spark.createDataFrame(rows, "method string, idx int, kind string")
    assert {tuple(r) for r in build.statement_edges(t).collect()} == want
    bad = spark.createDataFrame([("a", 0, "if"), ("b", 0, "end"), ("b", 1, "if"), ("c", 0, "stmt")], "method string, idx int, kind string")
    assert dict(map(tuple, build.balanced(t.union(bad)).where("method in ('a', 'b', 'c', 'm0')").collect())) == {"a": False, "b": False, "c": True, "m0": True}


def test_blocks_of_a_diamond(spark):
    t = spark.createDataFrame([("m", i, k) for i, k in enumerate("stmt stmt if stmt else stmt stmt end stmt return".split())], "method string, idx int, kind string")
    placed, ways = build.basic_blocks(t, build.statement_edges(t))
    assert [r.block for r in placed.orderBy("idx").collect()] == [0, 0, 0, 3, 4, 4, 4, 7, 7, 7]
    assert {tuple(r)[1:] for r in ways.collect()} == {(0, 3, "true"), (0, 4, "false"), (3, 7, "next"), (4, 7, "next"), (7, -1, "jump")}


# ---------------------------------------------------------------- types


def test_types_meet_at_the_nearest_ancestor(spark):
    h = spark.createDataFrame([("A", "object"), ("B", "A"), ("C", "A"), ("A-b", "object"), ("number", "any value")], "child string, parent string")
    paths = dict(map(tuple, build.type_paths(h).collect()))
    assert paths["C"] == "any/object/A/C" and paths["number"] == "any/any value/number"
    p = paths.__getitem__
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    types = build.infer_types(
        frame([("b", p("B")), ("c", p("C")), ("n", p("number")), ("t", p("A-b")), ("r", p("number"))], "var string, type string"),
        frame([("b", "x"), ("c", "x"), ("x", "y"), ("y", "x"), ("x", "z"), ("t", "z"), ("z", "w"), ("n", "w")], "src string, dst string"),
        frame([("x", "f", "xf"), ("z", "f", "zf"), ("xf", "f", "deep")], "base string, field string, dst string"),
        frame([("b", "go", "bg"), ("w", "go", "wg")], "base string, name string, dst string"),
        frame([(p("A"), "f", p("B")), (p("B"), "f", p("C"))], "type string, field string, kind string"),
        frame([(p("object"), "go", "r")], "type string, name string, result string"),
    )
    got = dict(map(tuple, types.collect()))
    assert got == {"b": p("B"), "c": p("C"), "n": p("number"), "t": p("A-b"), "r": p("number"), "x": p("A"), "y": p("A"), "z": p("object"), "w": "any", "xf": p("B"), "zf": "any", "deep": p("C"), "bg": p("number"), "wg": "any"}
    assert types.select("var").distinct().count() == types.count()


def test_bounds_of_paths(spark):
    rows = [(1, "any/a"), (1, "any/a-b"), (1, "any/a/x"), (2, "any/q/r"), (2, "any/q/r/s"), (3, "any/k1"), (3, "any/k10")]
    df = spark.createDataFrame(rows, "g int, type string").groupBy("g").agg(build.least_upper(F.col("type")).alias("t"))
    assert dict(map(tuple, df.collect())) == {1: "any", 2: "any/q/r", 3: "any"}


def test_statements_dealt_by_method_stay_where_they_lie(spark, monkeypatch):
    plans, kept = [], build.written
    monkeypatch.setattr(build, "written", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df))
    rows = [(f"m{m}", i, kind) for m in range(3) for i, kind in enumerate("try loop stmt end catch stmt end stmt".split())]
    t = spark.createDataFrame(rows, "method string, idx int, kind string").repartition(5, "method")
    placed, ways = build.basic_blocks(t, build.statement_edges(t))
    assert ways.count() == 3 * len({(r.src, r.dst, r.kind) for r in ways.where("method = 'm0'").collect()}) and placed.count() == len(rows)
    assert plans[0].count("Exchange hashpartitioning") == 1 and plans[-1].count("Exchange hashpartitioning") == 2
    assert build.tasks(spark, 100 * build.ROWS) == 100
