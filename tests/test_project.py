"""Nested methods, view trees and edges on demand: round trips, pushed filters and small cases."""

from pyspark.sql import functions as F

from factloom.operators import ir
from factloom.plans import queries_program, taint
from factloom.sources import readers, writers

SF = "/root/testdata/sf0.001"


def test_project_comes_back_whole(spark, tmp_path):
    methods = queries_program._methods(spark, SF).cache()
    writers.program(methods, f"{tmp_path}/p")
    got = readers.program(spark, f"{tmp_path}/p")
    plain = lambda df: sorted(map(repr, (r.asDict(recursive=True) for r in df.select(*sorted(methods.columns)).collect())))
    assert plain(got) == plain(methods)
    assert methods.where("size(traps) > 0").count() > 0 and methods.where("size(blocks) > 2").count() > 0


def test_filters_reach_the_scan(spark, tmp_path, capsys):
    writers.program(queries_program._methods(spark, SF), f"{tmp_path}/p")
    some = readers.program(spark, f"{tmp_path}/p", modules=["F"], files=["1-URGENT"])
    some.explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(module" in plan and "PushedFilters: [IsNotNull(file), EqualTo(file,1-URGENT)]" in plan
    assert {(r.module, r.file) for r in some.select("module", "file").distinct().collect()} == {("F", "1-URGENT")}


def test_trace_tables_hold_their_schema(spark, tmp_path):
    facts = spark.createDataFrame([("f", "l")], "id string, label string")
    writers.trace_graph({"facts": facts}, f"{tmp_path}/t")
    got = readers.trace_graph(spark, f"{tmp_path}/t")
    assert got["facts"].first().asDict()["field_path"] is None and got["gates"].count() == got["coverage"].count() == 0
    for bad in ({"facts": facts.withColumn("more", F.lit(1))}, {"other": facts}):
        try:
            writers.trace_graph(bad, f"{tmp_path}/t2")
            raise AssertionError
        except ValueError:
            pass


def test_views_nest_and_expand(spark):
    events = [("page", i, k, n) for i, (k, n) in enumerate([("create", "column"), ("create", "text"), ("pop", ""), ("create", "card"), ("pop", ""), ("pop", ""), ("pop", ""), ("create", "last")])]
    events += [("card", 0, "create", "row"), ("card", 1, "create", "card"), ("card", 2, "create", "image")]
    trees = ir.built_tree(spark.createDataFrame(events, "view string, idx int, kind string, name string"))
    assert {(r.view, r.node): (r.parent, r.depth) for r in trees.collect()} == {("page", 0): (None, 0), ("page", 1): (0, 1), ("page", 3): (0, 1), ("page", 7): (None, 0), ("card", 0): (None, 0), ("card", 1): (0, 1), ("card", 2): (1, 2)}
    got = {r.path: (r.parent, r.name, r.depth, r.recursive) for r in ir.expanded_tree(trees, spark.createDataFrame([("page",)], "view string")).collect()}
    assert got["3/0"] == ("3", "row", 2, False) and got["3/1"] == ("3/0", "card", 3, True) and got["3/2"] == ("3/1", "image", 4, False) and len(got) == 7
    assert got["7"] == (None, "last", 0, False)


def test_rounds_write_places_of_views_only(spark, monkeypatch):
    events = [("page", i, kind, name) for i in range(0, 60, 2) for i, kind, name in [(i, "create", "card" if i == 0 else "text"), (i + 1, "pop", None)]]
    events += [("card", 0, "create", "page"), ("card", 1, "create", "image")]
    trees, rounds = ir.built_tree(spark.createDataFrame(events, "view string, idx int, kind string, name string")), []
    kept = ir.written
    monkeypatch.setattr(ir, "written", lambda df: rounds.append(kept(df)) or rounds[-1])
    got = ir.expanded_tree(trees, spark.createDataFrame([("page",), ("page",)], "view string")).collect()
    assert len(got) == len({r.path for r in got}) == 32 and [r.path for r in got if r.recursive] == ["0/0"]
    assert [r.count() for r in rounds[2:]] == [1, 1, 0]


def test_shared_views_are_expanded_once(spark, monkeypatch):
    """Nested pairs: the places of a view double with each level, the views do not."""
    events = [(f"c{i}", 2 * j + on, "pop" if on else "create", f"c{i // 2 + j}") for i in range(40) for j in range(2) for on in range(2)] + [("c39", 9, "create", "c39")]
    schema, rows = "view string, idx int, kind string, name string", []
    trees, roots = ir.built_tree(spark.createDataFrame(events, schema)), spark.createDataFrame([(f"c{i}",) for i in (1, 3, 4, 17, 38, 39)], "view string")
    show = lambda: sorted(map(tuple, ir.expanded_tree(trees, roots).collect()), key=repr)
    want, kept = show(), ir.written
    monkeypatch.setattr(ir, "SHARED", 2)
    monkeypatch.setattr(ir, "PLACES", 3)
    monkeypatch.setattr(ir, "written", lambda df: rows.append(kept(df)) or rows[-1])
    assert show() == want and any("node" in r.columns and "chain" in r.columns for r in rows)
    assert any(r[-1] for r in want) and sum(r.count() for r in rows[2:] if "under" in r.columns) < len(want) / 4


def test_ids_not_bitmaps_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(ir, "tasks", lambda spark, rows, each: rows)
    ids = spark.createDataFrame([(o, i * 9000) for o in range(3) for i in range(10)] * 2, "owner long, id long")
    maps = ir.bitmaps(ids)
    plan = maps._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and ", 60), REPARTITION_BY_NUM" in plan
    assert [tuple(r) for r in ir.union_sizes(maps.withColumnRenamed("owner", "group")).orderBy("group").collect()] == [(0, 10), (1, 10), (2, 10)]


def test_edges_on_demand_give_the_same_facts(spark):
    edge = "kind string, src string, dst string, field string, site long"
    rows = [("call", "a", "m", None, 1), ("return", "m", "b", None, 1), ("store", "b", "c", "f", None), ("load", "c", "d", "f", None), ("copy", "d", "a", None, None), ("copy", "x", "y", None, None), ("return", "m", "z", None, 9)]
    every = spark.createDataFrame(rows, edge)
    fixed, made = every.where("kind in ('store', 'copy') and src <> 'x'"), every.where("kind not in ('store', 'copy') or src = 'x'")
    seed = spark.createDataFrame([("a", [], [], "s")], f"node string, ctx {taint.EMPTY_CTX}, path {taint.EMPTY_PATH}, source string")
    asked = []

    def maker(nodes):
        asked.extend(r.node for r in nodes.collect())
        return made.join(nodes, made["src"] == nodes["node"], "left_semi")

    got, edges = taint.propagate_lazily(seed, fixed, [maker], 1)
    want = taint.propagate(seed, every, 1)[0].drop("round")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(*got.columns).collect()))
    assert len(asked) == len(set(asked)) and "x" not in asked
    assert {(r.src, r.dst) for r in edges.collect()} == {("a", "m"), ("m", "b"), ("m", "z"), ("c", "d")}


def test_edges_made_are_not_compared_again(spark, monkeypatch):
    grown = []

    class Counted(taint.Grown):
        def __init__(self, rows, key):
            grown.append(key)
            super().__init__(rows, key)

    monkeypatch.setattr(taint, "Grown", Counted)
    row = "kind string, src long, dst long, field string, site long"
    ways = spark.createDataFrame([("copy", i, i + 1, None, None) for i in range(10)], row)
    seed = spark.createDataFrame([(0, [], [], "s")], "node long, ctx array<bigint>, path array<string>, source string")
    facts, edges = taint.propagate_lazily(seed, spark.createDataFrame([], row), [lambda nodes: ways.join(nodes.withColumnRenamed("node", "src"), "src")], 1)
    assert sorted(r.node for r in facts.collect()) == list(range(11)) and sorted(r.src for r in edges.collect()) == list(range(10))
    assert not any("src" in key for key in grown)
