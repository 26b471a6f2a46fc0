"""Hard-negative mining by exact inner products, with early discarding.

Vectors are integers.  An orthogonal rotation to principal components puts most of their
length into the leading ones; a product is summed over these step by step, what is left of
it is at most the product of the residual norms (and some slack for rounding), and a pair
that can no longer matter is discarded.  Survivors are scored by integer products, so the
result does not depend on the rotation.  Anchors and rows meet in blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import thinned, written

STEPS, CELLS = (1 / 16, 1 / 8, 1 / 4, 1 / 2, 1), 1 << 21


def rotation(sample: np.ndarray) -> np.ndarray:
    """Orthogonal matrix whose columns are principal directions about zero, largest first."""
    if not sample.size:
        return np.eye(sample.shape[1])
    x = sample / max(np.abs(sample).max(), 1.0)
    return np.linalg.eigh(x.T @ x)[1][:, ::-1]


class Rotated:
    """Integer rows, their rotated form and the norms of what follows each step."""

    def __init__(self, whole: np.ndarray, turn: np.ndarray, steps: list[int]):
        self.whole, self.turned = whole, whole.astype(np.float64) @ turn
        squares = np.cumsum((self.turned**2)[:, ::-1], axis=1)[:, ::-1]
        tail = np.concatenate([squares, np.zeros((len(whole), 1))], axis=1)
        self.rest = {m: np.sqrt(tail[:, m]) for m in [0, *steps]}


def survivors(a: Rotated, b: Rotated, part: slice, low: np.ndarray, high: np.ndarray, steps: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, product) of anchors and rows of ``part``: all pairs whose product lies between
    the anchor's ``low`` and ``high``, both included, and few others."""
    lengths = a.rest[0][:, None], b.rest[0][part][None, :]
    eps = 64 * (a.whole.shape[1] + 4) * np.finfo(np.float64).eps
    at, sums = 0, np.zeros((len(a.whole), part.stop - part.start))
    for to in steps:  # all pairs, until most are gone
        sums += a.turned[:, at:to] @ b.turned[part, at:to].T
        at = to
        reach = a.rest[to][:, None] * b.rest[to][part][None, :] + eps * lengths[0] * lengths[1]
        open_ = (sums + reach >= low[:, None]) & (sums - reach <= high[:, None])
        if open_.mean() < 1 / 8:
            break
    i, j = np.nonzero(open_)
    sums, j = sums[i, j], j + part.start
    for to in [s for s in steps if s > at]:  # the pairs that are left
        sums = sums + np.einsum("ij,ij->i", a.turned[i, at:to], b.turned[j, at:to])
        at = to
        reach = a.rest[to][i] * b.rest[to][j] + eps * a.rest[0][i] * b.rest[0][j]
        open_ = (sums + reach >= low[i]) & (sums - reach <= high[i])
        i, j, sums = i[open_], j[open_], sums[open_]
    score = np.concatenate([np.einsum("ij,ij->i", a.whole[i[k : k + 65536]], b.whole[j[k : k + 65536]]) for k in range(0, len(i), 65536)] or [np.zeros(0, np.int64)])
    return i, j, score


def first(keys: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ``most`` best of each key, in order (score falling, then id, then row),
    and their rank from 0."""
    order = np.lexsort((rows, ids, -score, keys))
    k = keys[order]
    start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    rank = np.arange(len(k)) - np.repeat(start, np.diff(np.r_[start, len(k)]))
    return order[rank < most], rank[rank < most]


def _sides(frame: pd.DataFrame, turns: dict[int, np.ndarray]):
    """Anchors and rows of a block, rotated, and the steps."""
    anchor = frame["anchor"].to_numpy(bool)
    d = int(frame["dim"].iloc[0])
    steps = sorted({max(1, int(d * s)) for s in STEPS}) if d else [0]
    ints = lambda part: np.stack([np.asarray(v, np.int64) for v in part["v"]]) if len(part) else np.zeros((0, d), np.int64)
    a, b = frame[anchor].reset_index(drop=True), frame[~anchor].reset_index(drop=True)
    turn = turns.get(d, np.eye(d))
    return a, b, Rotated(ints(a), turn, steps), Rotated(ints(b), turn, steps), steps


def _parts(anchors: int, rows: int):
    size = max(64, CELLS // max(anchors, 1))
    return [slice(k, min(k + size, rows)) for k in range(0, rows, size)]


def _nearest(turns: dict[int, np.ndarray], most: int):
    """The best ``most`` rows of each anchor within a block."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        a, b, x, y, steps = _sides(frame, turns)
        low, high = np.full(len(a), -np.inf), np.full(len(a), np.inf)
        own, of = a["row"].to_numpy(), b["row"].to_numpy()
        ids = b["id"].to_numpy()
        held = np.zeros((3, 0), np.int64)  # anchor, row of b, score
        for part in _parts(len(a), len(b)) if len(a) else []:
            i, j, score = survivors(x, y, part, low, high, steps)
            other = of[j] != own[i]
            held = np.concatenate([held, np.stack([i, j, score])[:, other]], axis=1)
            places, rank = first(held[0], held[2], ids[held[1]], of[held[1]], most)
            held = held[:, places]
            full = rank == most - 1
            low[held[0][full]] = held[2][full]
        return pd.DataFrame({"anchor_row": own[held[0]], "row": of[held[1]], "id": ids[held[1]], "score": held[2]})

    return run


def _between(turns: dict[int, np.ndarray], most: int, low_share: tuple[int, int], high_share: tuple[int, int]):
    """The best ``most`` rows of another label for each of an anchor's positive scores."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        a, b, x, y, steps = _sides(frame, turns)
        own, of, ids = a["row"].to_numpy(), b["row"].to_numpy(), b["id"].to_numpy()
        la, lb = a["label"].to_numpy(object), b["label"].to_numpy(object)
        base = np.array([s for scores in a["scores"] for s in scores], np.int64)
        holder = np.repeat(np.arange(len(a)), [len(s) for s in a["scores"]]) if len(a) else np.zeros(0, np.int64)
        lo, hi = -(-low_share[0] * base // low_share[1]), high_share[0] * base // high_share[1]
        wide = lo <= hi
        base, holder, lo, hi = base[wide], holder[wide], lo[wide], hi[wide]  # sorted by holder
        begin = np.searchsorted(holder, np.arange(len(a)))
        count = np.searchsorted(holder, np.arange(len(a)), "right") - begin
        least = lo.astype(np.float64)
        high = np.full(len(a), -np.inf)
        np.maximum.at(high, holder, hi)
        held = np.zeros((3, 0), np.int64)  # window, row of b, score
        for part in _parts(len(a), len(b)) if len(base) else []:
            low = np.full(len(a), np.inf)
            np.minimum.at(low, holder, least)
            i, j, score = survivors(x, y, part, low, high, steps)
            apart = la[i] != lb[j]
            i, j, score = i[apart], j[apart], score[apart]
            each = count[i]
            pair = np.repeat(np.arange(len(i)), each)
            window = begin[i][pair] + np.arange(len(pair)) - np.repeat(np.cumsum(each) - each, each)
            fits = (score[pair] >= least[window]) & (score[pair] <= hi[window])
            window, pair = window[fits], pair[fits]
            held = np.concatenate([held, np.stack([window, j[pair], score[pair]])], axis=1)
            places, rank = first(held[0], held[2], ids[held[1]], of[held[1]], most)
            held = held[:, places]
            full = rank == most - 1
            least[held[0][full]] = held[2][full]
        return pd.DataFrame({"anchor_row": own[holder[held[0]]], "base": base[held[0]], "row": of[held[1]], "id": ids[held[1]], "score": held[2]})

    return run


def _met(anchors: DataFrame, rows: DataFrame, keys: list[str], run, schema: str) -> DataFrame:
    """Anchors and rows of equal keys in blocks of bounded numbers of components, each
    anchor block with each row block."""
    d = F.greatest(F.col("dim"), F.lit(1))
    size = lambda df, most, name: df.groupBy(keys).agg(F.count("*").alias("n"), F.first(d).alias("d")).select(*keys, F.ceil(F.col("n") / F.greatest(F.lit(1), F.floor(F.lit(most) / F.col("d")))).cast("int").alias(name))
    # row blocks: 64 of them, if that keeps them between 2^19 and 2^23 components
    blocks = rows.groupBy(keys).agg(F.count("*").alias("n"), F.first(d).alias("d")).select(*keys, F.greatest(F.ceil(F.col("n") * F.col("d") / (1 << 23)), F.least(F.lit(64), F.ceil(F.col("n") * F.col("d") / (1 << 19)))).cast("int").alias("row_blocks"))
    sizes = written(blocks.join(size(anchors, 1 << 20, "anchor_blocks"), keys), "negatives-blocks")
    lot = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    names = ["dim", "label", "row", "id", "v", "scores"]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    near = anchors.join(sizes, keys).select(*names, F.lit(True).alias("anchor"), lot("anchor_blocks").alias("ab"), every("row_blocks").alias("rb"))
    far = rows.withColumn("scores", F.lit(None).cast("array<long>")).join(sizes, keys).select(*names, F.lit(False).alias("anchor"), every("anchor_blocks").alias("ab"), lot("row_blocks").alias("rb"))
    return near.union(far).groupBy(*keys, "ab", "rb").applyInPandas(run, schema)


def hard_negatives(
    vectors: DataFrame,
    anchor: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label: Column | str = "label",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 10,
    low: tuple[int, int] = (30, 100),
    high: tuple[int, int] = (90, 100),
    sample: int = 20_000,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows for which ``anchor`` holds.  Components x become floor(scale * x);
    scores are inner products.  An anchor's positives are the first ``positives`` other rows
    of its label; a pair's negatives the first ``negatives`` rows of another label whose
    score lies between the shares ``low`` and ``high`` of the positive's.  Order: higher
    scores, then smaller ids.

    Rows of null id, label or vector, or with a null or non-finite component, take no part.
    Only vectors of equal length are compared (empty ones score 0).  Repeated rows are rows
    of their own, as anchors, positives and negatives.  A squared norm of 2^53 or more is an
    error: scores would no longer be exact.  The rotation is fitted on about ``sample``
    vectors; it decides about speed alone."""
    v = F.col(vector_col).cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.col(label) if isinstance(label, str) else label
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("string").alias("label"), F.coalesce(anchor, F.lit(False)).alias("is_anchor"), v.alias("x"), F.coalesce(sound, F.lit(False)).alias("sound"))
    rows = rows.where("id is not null and label is not null and x is not null and sound")
    whole = F.transform("x", lambda c: F.floor(c * scale))
    norm = F.aggregate(F.transform("x", lambda c: F.floor(c * scale).cast("double")), F.lit(0.0), lambda s, c: s + c * c)
    rows = rows.withColumn("v", F.when(norm < float(1 << 53), whole).otherwise(F.raise_error(F.lit("a vector is too long for exact scores"))))
    rows = written(rows.select("id", "label", "is_anchor", F.size("v").alias("dim"), F.col("v").cast("array<int>").alias("v"), F.monotonically_increasing_id().alias("row")), "negatives-rows")
    picked: dict[int, list] = {}
    for x in thinned(rows, "row", sample).select("v").toPandas()["v"]:  # about ``sample`` rows
        picked.setdefault(len(x), []).append(np.asarray(x, np.float64))
    turns = {d: rotation(np.stack(x)) for d, x in picked.items()}
    # all but what one label and length hold: (dim, label, row, id, v)
    plain = rows.select("dim", "label", "row", "id", "v")
    anchors = rows.where("is_anchor").select("dim", "label", "row", "id", "v", F.lit(None).cast("array<long>").alias("scores"))
    found = _met(anchors, plain, ["dim", "label"], _nearest(turns, positives), "anchor_row long, row long, id long, score long")
    best = Window.partitionBy("anchor_row").orderBy(F.desc("score"), "id", "row")
    good = written(found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives), "negatives-positives")
    scores = good.groupBy("anchor_row").agg(F.sort_array(F.collect_set("score")).alias("scores"))  # at most ``positives``
    asked = anchors.drop("scores").join(scores, F.col("row") == F.col("anchor_row")).select("dim", "label", "row", "id", "v", "scores")
    found = _met(asked, plain, ["dim"], _between(turns, negatives, low, high), "anchor_row long, base long, row long, id long, score long")
    best = Window.partitionBy("anchor_row", "base").orderBy(F.desc("score"), "id", "row")
    bad = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives).select("anchor_row", F.col("base").alias("score"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = good.select("anchor_row", F.col("id").alias("positive_id"), "score").join(anchors.select(F.col("row").alias("anchor_row"), F.col("id").alias("anchor_id")), "anchor_row")
    out = named.join(bad, ["anchor_row", "score"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", F.col("score").alias("positive_score"), "negative_score")
