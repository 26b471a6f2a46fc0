"""Packing by cutting-stock column generation.

A document's whole stretches of ``capacity`` tokens are sequences of their own;
what is left over is an item.  Items are counted by length (in steps of
``grid`` tokens, rounded up).  A linear program over patterns of lengths is
solved by column generation, with a knapsack dynamic program that prices new
patterns; its solution is rounded down, the few items that remain are placed by
first fit.  Every pattern becomes a range of sequences, and the items of a length
are assigned to them by rank.

Only the histogram (one row for each length class) and the patterns (at most as
many as classes, and the rest's) reach the driver.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow, sliced, written
from .tokens import default_files, encoder


def column_generation(sizes: np.ndarray, counts: np.ndarray, capacity: int, gap: float = 1e-4, most_rounds: int = 20_000) -> tuple[list[np.ndarray], np.ndarray]:
    """Patterns (copies per size) and how often each is used, by the linear program

    min sum(x) with sum(pattern * x) = counts, x >= 0.  Revised simplex; an
    unbounded knapsack over the dual prices gives the entering pattern.  Ends when
    Farley's bound leaves less than half a sequence, or a share ``gap`` of them, to gain.
    Counts are shifted by up to a millionth, so that no step is empty."""
    m = len(sizes)
    counts = counts + np.random.default_rng(3).uniform(0, 1e-6, m)
    columns = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1.0 / np.diag(columns))
    x = inverse @ counts
    for turn in range(most_rounds):
        if turn % 200 == 199:  # a Newton step takes the updates' rounding errors out
            slip = np.eye(m) - np.einsum("ij,jk->ik", columns, inverse)
            inverse = inverse + np.einsum("ij,jk->ik", inverse, slip)
            x = np.maximum(inverse @ counts, 0)
        price = inverse.sum(axis=0)
        pattern, value = knapsack(sizes, price, capacity)
        z = x.sum()
        if value <= 1 + 1e-9 or z - z / value < max(0.5, gap * z):
            break
        step = inverse @ pattern
        able = step > 1e-10
        ratio = np.where(able, x / np.where(able, step, 1), np.inf)
        out = int(ratio.argmin())
        x = x - ratio[out] * step
        x[out] = ratio[out]
        columns[:, out] = pattern
        row = inverse[out] / step[out]
        inverse = inverse - np.outer(step, row)
        inverse[out] = row
        np.maximum(x, 0, out=x)
    return [columns[:, j].astype(np.int64) for j in range(m)], x


def knapsack(sizes: np.ndarray, price: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """Best multiset of sizes within capacity, by dynamic programming (sizes ascend)."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    able = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for w in range(1, capacity + 1):
        best[w], k = best[w - 1], able[w]
        if k:
            value = best[w - sizes[:k]] + price[:k]
            i = int(value.argmax())
            if value[i] > best[w] + 1e-12:
                best[w], choice[w] = value[i], i
    pattern, w = np.zeros(len(sizes)), capacity
    while w > 0:
        if choice[w] < 0:
            w -= 1
        else:
            pattern[choice[w]] += 1
            w -= int(sizes[choice[w]])
    return pattern, float(best[capacity])


def plan_patterns(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(pattern, uses) that hold every item of the histogram exactly once."""
    sizes = np.array(sorted(histogram), np.int64)
    if not len(sizes):
        return []
    counts = np.array([histogram[s] for s in sizes], np.int64)
    patterns, x = column_generation(sizes, counts, capacity)
    used, left = [], counts.copy()
    for j in np.argsort(-x, kind="stable"):
        p = patterns[j]
        held = p > 0
        n = min(int(np.floor(x[j] + 1e-9)), int((left[held] // p[held]).min())) if held.any() else 0
        if n > 0:
            left -= n * p
            used.append(({int(s): int(c) for s, c in zip(sizes[held], p[held])}, n))
    bins: list[list] = []  # first fit, longest first, over what rounding left
    for s, c in zip(sizes[::-1].tolist(), left[::-1].tolist()):
        for _ in range(c):
            for b in bins:
                if b[0] >= s:
                    break
            else:
                bins.append(b := [capacity, {}])
            b[0] -= s
            b[1][s] = b[1].get(s, 0) + 1
    return used + [(b[1], 1) for b in bins]


def pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, grid: int, end_id: int, files, with_ids: bool) -> DataFrame:
    """Pieces of all documents; ``class`` 0 marks whole sequences, ``part`` and ``nth``
    number the pieces of a class within the task that made them."""
    files = files or default_files()
    kinds = {"id": "long", "start": "long", "length": "long", "ids_crc32": "long", "doc_tokens": "long", "class": "int", "part": "int", "nth": "long"} | ({"ids": "array<int>"} if with_ids else {})

    def run(batches):
        encode, part, seen = encoder(*files), TaskContext.get().partitionId(), {}
        for batch in sliced(batches):
            out, ids_out = [], []
            for key, text in zip(batch.column(0), batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                n, key = len(ids), key.as_py()
                for start in range(0, n, capacity):
                    piece = ids[start : start + capacity]
                    kind = 0 if len(piece) == capacity else -(-len(piece) // grid)
                    nth = seen.get(kind, 0)
                    seen[kind] = nth + 1
                    out.append((key, start, len(piece), zlib.crc32(piece), n, kind, part, nth))
                    if with_ids:
                        ids_out.append(piece.astype(np.int32))
            columns = list(zip(*out)) if out else [()] * 8
            types = [pa.int64()] * 5 + [pa.int32(), pa.int32(), pa.int64()]
            arrays = [pa.array(c, t) for c, t in zip(columns, types)] + ([pa.array(ids_out, pa.list_(pa.int32()))] if with_ids else [])
            yield pa.RecordBatch.from_arrays(arrays, names=list(kinds))

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return arrow(rows, run, ", ".join(f"`{k}` {t}" for k, t in kinds.items()))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, grid: int = 8, end_id: int = 1, files=None, with_ids: bool = False) -> DataFrame:
    """One row per piece: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]).

    Each token of a document (its ids and ``end_id``) lies in exactly one piece;
    sequences hold at most ``capacity`` tokens, gapless from 0.  Null texts count
    as empty (one token); repeated rows are documents of their own; null ids stay
    null; an empty table gives an empty result."""
    spark = docs.sparkSession
    made = written(pieces(docs, id_col, text_col, capacity, grid, end_id, files, with_ids), "packing-pieces")
    counts = made.groupBy("class", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each task
    ahead = counts.select("class", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    histogram = {r[0]: r[1] for r in counts.groupBy("class").agg(F.sum("n")).collect()}  # at most capacity / grid + 1 rows
    whole = histogram.pop(0, 0)
    slots, sequence, placed = [], whole, dict.fromkeys(histogram, 0)
    for pattern, uses in plan_patterns(histogram, capacity // grid):
        for size, copies in pattern.items():
            slots.append((size, placed[size], placed[size] + copies * uses, sequence, copies))
            placed[size] += copies * uses
        sequence += uses
    slots = spark.createDataFrame([(0, 0, whole, 0, 1), *slots], "`class` int, lo long, hi long, base long, copies long")
    kept = ["id", "start", "length", "ids_crc32", "doc_tokens"]
    last = ["ids"] if with_ids else []
    ranked = made.join(ahead, ["class", "part"]).withColumn("rank", F.col("nth") + F.col("ahead"))
    # bounded by the number of classes and patterns, whatever the input
    placed_rows = ranked.join(F.broadcast(slots), "class").where("rank >= lo and rank < hi").withColumn("sequence_id", F.expr("base + (rank - lo) div copies"))
    alone = placed_rows.where("class = 0").select(*kept, "sequence_id", F.lit(0).cast("long").alias("offset"), *last)
    within = Window.partitionBy("sequence_id").orderBy(F.desc("class"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    shared = placed_rows.where("class > 0").withColumn("offset", F.coalesce(F.sum("length").over(within), F.lit(0)))
    return alone.union(shared.select(*kept, "sequence_id", "offset", *last))
