"""Steps whose rows once grew with pairs: against plain loops, and by what their plans hold."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import assets, calls, evidence, fields, links, lowering, pairs, semantics
from factloom.plans import flow, graph, schedule


def top(df):
    return df._jdf.queryExecution().optimizedPlan().toString().split("\n")[0]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_distinct_pairs_against_loops(spark):
    draw = random.Random(5)
    left = [(draw.choice([None, *range(9)]), str(draw.randrange(3)), draw.choice([None, *range(30)])) for _ in range(300)] + [(k, "0", 77) for k in range(90)]
    right = [(draw.choice([None, *range(9)]), str(draw.randrange(3)), draw.choice([None, *range(30)])) for _ in range(300)] + [(k, "0", 88) for k in range(90)]
    l, r = spark.createDataFrame(left, "k long, s string, a long"), spark.createDataFrame(right, "k long, s string, b long")
    got = [tuple(x) for x in pairs.distinct_pairs(l, r, ["k", "s"], "a", "b").collect()]
    want = {(a, b) for k, s, a in left for j, t, b in right if k is not None and (k, s) == (j, t)}
    assert len(got) == len(want) and set(got) == want
    with pytest.raises(ValueError):
        pairs.distinct_pairs(l.withColumn("k", F.col("k").cast("string")), r, ["k", "s"], "a", "b")


def test_no_pairs_are_made_distinct_as_a_whole(spark):
    t = lambda schema: spark.createDataFrame([], schema)
    below = t("ancestor string, descendant string")
    for df in (
        calls.capture_edges(t("method long, name string, node long"), t("method long, name string, outer long")),
        calls.stored_callbacks(t("class string, field string, callback long"), t("site long, class string, field string"), below),
        links.shared_state(t("write long, field string"), t("read long, field string"), t("alias string, field string")),
        semantics.bindings(t("kind string, decorator string, both boolean"), t("owner long, parent long, name string, decorator string, node long")),
        fields.this_loads(t("file long, class string, field string, source long"), t("file long, class string, field string, dst long"), below),
        schedule.lifecycle_edges(t("owner string, method long, phase string")),
    ):
        assert not top(df).startswith(("Aggregate", "Distinct")), top(df)


def test_receivers_are_keys(spark):
    t = lambda schema: spark.createDataFrame([], schema)
    df = semantics.bridge(t("kind string, api string, to_api string, from_ep string, to_ep string, same_receiver boolean"), t("api string, site long, receiver long, endpoint string, node long"))
    assert "<=>" in plan(df) and "OR" not in plan(df)


def test_bridge_of_null_receivers(spark):
    spec = spark.createDataFrame([("bridge", "a", "b", "x", "y", True), ("bridge", "a", "c", "x", "y", False)], "kind string, api string, to_api string, from_ep string, to_ep string, same_receiver boolean")
    sites = spark.createDataFrame([("a", 1, None, "x", 10), ("a", 2, 5, "x", 20), ("b", 3, None, "y", 30), ("b", 4, 5, "y", 40), ("c", 5, 9, "y", 50)], "api string, site long, receiver long, endpoint string, node long")
    assert sorted((r.src, r.dst) for r in semantics.bridge(spec, sites).collect()) == [(10, 30), (10, 50), (20, 40), (20, 50)]


def shuffled(spark):
    return sum(e.totalShuffleWrite() for e in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().statusStore().executorList(True)))


def test_reach_pairs_of_a_clique(spark):
    """A round extends new pairs by edges; doubling joined all pairs with all pairs, a ring of n nodes n times n times n."""
    n = 240
    ring = spark.createDataFrame([(i, (i + d) % n) for i in range(n) for d in range(1, 40)], "src long, dst long")
    assert graph.reach_pairs(ring).count() == n * n
    chain = graph.reach_pairs(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long"))
    assert sorted(map(tuple, chain.collect())) == sorted((a, b) for a in (1, 2, 3) for b in (1, 2, 3, 4))


def test_only_first_handlers_of_a_channel_meet_emissions(spark):
    reg = spark.createDataFrame([(1, "c", h) for h in range(50)] + [(1, None, 99), (2, "d", 7), (2, "d", 7)], "owner long, channel string, handler long")
    emi = spark.createDataFrame([(1, "c", 5), (2, "d", 5), (2, "d", 6), (1, None, 6)], "owner long, channel string, payload long")
    df = assets.channel_pairs(reg, emi, 3)
    assert sorted(map(tuple, df.collect())) == [(5, 0, "c"), (5, 1, "c"), (5, 2, "c"), (6, 7, "d"), (6, 7, "d")]
    assert plan(df).count("Window [row_number()") == 2


def test_sanitizer_by_a_look_back(spark):
    draw = random.Random(3)
    steps = [(draw.randrange(40), draw.randrange(4), draw.choice("ab"), draw.choice([None, *range(30)])) for _ in range(80)]
    made = {(draw.randrange(4), draw.choice("ab"), draw.randrange(30)): f"api{draw.randrange(4)}" for _ in range(60)}
    df = evidence.sanitizer_evidence(spark.createDataFrame(steps, "path long, method long, name string, sink_idx long"), spark.createDataFrame([(*k, v) for k, v in made.items()], "method long, name string, idx long, api string"), spark.createDataFrame([("api1",), ("api3",)], "api string"))
    want = {}
    for path, m, n, sink in steps:
        for (m2, n2, i), api in made.items():
            if (m2, n2) == (m, n) and sink is not None and i < sink:
                want.setdefault(path, []).append((i, api))
    best = {p: max(i for i, _ in v) for p, v in want.items()}
    got = [tuple(r) for r in df.collect()]
    # several variables of one path may be assigned at one idx; any of them may decide
    assert all(i == best[p] and (i, a) in want[p] and a in ("api1", "api3") for p, a, i in got) and len({g[0] for g in got}) == len(got)
    assert {p for p in best if {a for i, a in want[p] if i == best[p]} <= {"api1", "api3"}} <= {g[0] for g in got}
    assert "idx < sink_idx" not in plan(df) and not any("Join Inner" in line and "<" in line for line in plan(df).split("\n"))


def test_bindings_are_made_distinct_before_they_meet_sites(spark):
    t = lambda schema: spark.createDataFrame([], schema)
    df = lowering.instances(t("asset long, plane string"), t("asset long, surface long, api string"), t("asset long, surface long, template string, role string"), t("template string, kind string, endpoint string"), t("api string, site long"))
    assert df._jdf.queryExecution().analyzed().toString().count("Distinct") == 2 or df._jdf.queryExecution().analyzed().toString().count("Deduplicate") == 2


def test_methods_cut_by_batches():
    import pandas as pd

    table = pd.DataFrame({"method": ["a"] * 5 + ["b"] + ["c"] * 7 + [None] * 3, "x": range(16)})
    for size in range(1, 17):
        got = [(m, p["x"].tolist()) for group in flow._runs(table.iloc[i : i + size] for i in range(0, 16, size)) for m, p in group]
        assert [x for _, x in got] == [list(range(5)), [5], list(range(6, 13)), [13, 14, 15]], size
        assert [m for m, _ in got][:3] == ["a", "b", "c"]


def test_phis_and_depths_take_no_rounds(spark, monkeypatch):
    def never(*a, **k):
        raise AssertionError("a fixpoint over rows")

    monkeypatch.setattr(graph, "fixpoint", never)
    idoms = spark.createDataFrame([("m", 0, None, []), ("m", 1, 0, [3]), ("m", 2, 0, [3]), ("m", 3, 0, [0]), ("n", 4, None, None)], "method string, block long, idom long, frontier array<long>")
    blocks = spark.createDataFrame([("m", 1, "x"), ("m", 2, None), ("n", 4, "x")], "method string, block long, var string")
    assert sorted(map(tuple, graph.phi_places(blocks, idoms).collect())) == [("m", 0, "x"), ("m", 3, "x")]
    assert sorted(map(tuple, graph.dominator_tree(idoms).collect())) == [("m", 0, 0), ("m", 1, 1), ("m", 2, 1), ("m", 3, 1), ("n", 4, 0)]


def test_reach_pairs_of_small_parts_take_no_rounds(spark, monkeypatch):
    draw = random.Random(8)
    edges = {(g * 100 + draw.randrange(12), g * 100 + draw.randrange(12)) for g in range(6) for _ in range(3 + 4 * g)}
    want, found = set(edges), True
    while found:
        found = {(a, d) for a, b in want for c, d in edges if b == c} - want
        want |= found
    show = lambda kind: sorted((int(r.src), int(r.dst)) for r in graph.reach_pairs(spark.createDataFrame([tuple(map(kind, e)) for e in edges], f"src {'long' if kind is int else 'string'}, dst {'long' if kind is int else 'string'}")).collect())
    with monkeypatch.context() as patched:
        patched.setattr(graph, "fixpoint", None)  # none is needed
        assert show(int) == show(str) == sorted(want)
    monkeypatch.setattr(graph, "LOT", 9)
    assert show(int) == sorted(want)
