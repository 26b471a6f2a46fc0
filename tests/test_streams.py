"""Streams with state: equal to the batch form, bounded for a hot cell, whole for odd input."""

from datetime import datetime, timedelta

import pandas as pd

from factloom.operators import effects
from factloom.streaming import producers

EFFECT = "id long, cell long, seq long, kind string, precision string, confidence string, strength string"
SLICE = "id long, cell long, kind string, ts timestamp"


class Held:
    """State of one cell, kept in plain lists."""

    def __init__(self):
        self.value, self.rows, self.appends, self.read = None, [], 0, 0

    def getValueState(self, *_):
        return self

    def getListState(self, *_):
        return Listed(self)

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class Listed:
    def __init__(self, held):
        self.held = held

    def get(self):
        for row in self.held.rows:
            self.held.read += 1
            yield row

    def appendList(self, rows):
        self.held.appends += len(rows)
        self.held.rows += rows


def test_list_state_equals_batch_over_several_runs(spark):
    kinds = ("store", "load", "kill", "store-clean", "store", "noop")
    rows = [(i, i % 4, i // 4, kinds[i * 7 % 6], ("exact", "partial")[i % 5 == 0], ("certain", "unknown")[i % 11 == 0], ("strong", "weak")[i % 3 == 0]) for i in range(160)]
    df = spark.createDataFrame(rows, EFFECT)
    got = producers.in_lots(df, "seq", 3, producers.verdicts, producers.OUT).collect()
    want = effects.currentness(df).collect()
    assert sorted((r.cell, r.producer, r.consumer, r.verdict) for r in got) == sorted((r.cell, r.producer, r.consumer, r.verdict) for r in want)


def test_odd_input(spark):
    df = spark.createDataFrame([(1, None, 0, "store", "exact", "certain", "strong"), (2, None, 1, "load", "exact", "certain", "strong"), (3, 5, 0, "store", None, "certain", None), (4, 5, 1, "load", "exact", None, None)], EFFECT)
    got = producers.in_lots(df, "seq", 2, producers.verdicts, producers.OUT).collect()
    assert [tuple(r) for r in got] == [(5, 3, 4, "may-live")]
    none = producers.in_lots(df.where("false"), "seq", 2, producers.verdicts, producers.OUT)
    assert none.count() == 0 and none.columns == ["cell", "producer", "consumer", "verdict"]


def test_hot_cell_is_appended_once_and_read_in_pieces():
    state, cell = Held(), producers.Producers(limit=1 << 40)
    cell.init(state)
    of = lambda ids, kind: pd.DataFrame({"id": ids, "seq": ids, "kind": kind, "precision": "exact", "confidence": "certain", "strength": "strong"})
    for at in range(0, 1_000_000, 100_000):
        assert not list(cell.handleInputRows((1,), iter([of(range(at, at + 100_000), "store")]), None))
    assert state.appends == len(state.rows) == 1_000_000
    list(cell.handleInputRows((1,), iter([of(range(1_000_000, 1_000_001), "kill")]), None))
    state.read = count = dead = 0
    for frame in cell.handleInputRows((1,), iter([of(range(1_000_001, 1_000_004), "load")]), None):
        count, dead = count + len(frame), dead + int((frame["verdict"] == "dead").sum())
        assert len(frame) <= producers.PIECE and state.read <= count // 3 + producers.PIECE + 1  # no further ahead than a piece
    assert count == dead == 3_000_000 and state.appends == 1_000_000


def test_small_cells_give_one_frame_and_few_calls_of_state():
    """Most cells are small; what one costs beside its rows is what a stream takes."""
    state, cell = Held(), producers.Producers()
    cell.init(state)
    asked, state.exists = [], lambda: asked.append(1) or state.value is not None
    of = lambda seq, kind: pd.DataFrame({"id": seq, "seq": seq, "kind": kind, "precision": "exact", "confidence": None, "strength": None})
    assert not list(cell.handleInputRows((1,), iter([of([0, 1], "store")]), None))
    frames = list(cell.handleInputRows((1,), iter([of([3], "load"), of([2], "store"), of([4], None)]), None))
    assert [f.values.tolist() for f in frames] == [[[1, 0, 3, "live"], [1, 1, 3, "live"], [1, 2, 3, "live"]]]
    assert not asked and state.value == (5, 0, 0, 3) and state.read == 2


def test_slices_within_an_interval(spark):
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    rows = [(1, 1, "store", at(0)), (2, 1, "load", at(0)), (3, 1, "load", at(60)), (4, 1, "load", at(61)), (5, 2, "load", at(30)), (6, 1, "store", at(59)), (7, None, "store", at(1)), (8, None, "load", at(2)), (9, 1, "noop", at(5)), (10, 1, "load", at(500))]
    df = spark.createDataFrame(rows, SLICE)
    got = producers.in_lots(df, "ts", 3, lambda s: producers.slices(s, "60 minutes"), "cell long, producer long, consumer long")
    assert sorted(map(tuple, got.collect())) == [(1, 1, 3), (1, 6, 3), (1, 6, 4)]


def test_cache_keeps_the_last_row_of_each_key(spark):
    rows = [(i % 7 if i % 5 else None, i, f"v{i}" if i % 3 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "key long, at long, value string")
    put = lambda batch, n, path: [producers.newest(batch, path, "key", ["at"], buckets=4) for _ in range(2)]
    got = producers.in_lots(df, "at", 3, lambda s: s, "key long, at long, value string", put)
    assert {tuple(r) for r in got.collect()} == {max((r for r in rows if r[0] == k), key=lambda r: r[1]) for k in {r[0] for r in rows}}
