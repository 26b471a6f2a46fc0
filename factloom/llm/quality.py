"""Quality classifier: random Fourier features, ridge scores, isotonic calibration.

Document statistics are taken from the whole text.  Random Fourier features
approximate a Gaussian kernel over them; each partition of the labelled sample
sums its share of the normal equations; the summed equations are solved once and
the ridge scores are calibrated by isotonic regression on rows kept aside.
"""

from __future__ import annotations

import math
import operator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, sliced, thinned, told, written

NAMES = ("log_words", "word_len", "word_len_sd", "distinct_words", "repeated_next", "distinct_pairs", "upper", "lower", "digit", "space", "newline", "bang", "pipe", "mark", "symbol", "beyond_ascii", "entropy", "line_len", "distinct_lines", "short_words")
DIM = len(NAMES)

_KIND = np.zeros(256, np.int64)
for _i in range(256):
    _c = chr(_i)
    _KIND[_i] = 0 if _i >= 128 else 1 if "A" <= _c <= "Z" else 2 if "a" <= _c <= "z" else 3 if _c.isdigit() else 4 if _c == " " else 5 if _c == "\n" else 6 if _c == "!" else 7 if _c == "|" else 8 if _c in ".,;:?'\"()-" else 9


def statistics(text: str | None) -> np.ndarray:
    """The statistics named in NAMES, all finite; null and empty texts give zeros."""
    out = np.zeros(DIM)
    if not text:
        return out
    raw = text.encode("utf-8", "replace")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = np.bincount(_KIND, weights=counts, minlength=10) / len(raw)
    p = counts[counts > 0] / len(raw)
    words = text.split()
    n = len(words)
    lines = text.split("\n")
    if n:
        sizes = np.fromiter(map(len, words), np.float64, n)
        out[0] = math.log1p(n)
        out[1] = min(sizes.mean(), 50.0)
        out[2] = min(sizes.std(), 50.0)
        out[3] = len(set(words)) / n
        if n > 1:
            out[4] = sum(map(operator.eq, words, words[1:])) / (n - 1)
            out[5] = len(set(pairwise(words))) / (n - 1)
        else:
            out[5] = 1.0
        out[19] = float((sizes <= 3).mean())
    out[6:16] = share[[1, 2, 3, 4, 5, 6, 7, 8, 9, 0]]
    out[16] = float(-(p * np.log2(p)).sum())
    out[17] = math.log1p(len(text) / len(lines))
    out[18] = len(set(lines)) / len(lines)
    return out


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phase: np.ndarray
    beta: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.beta

    def features(self, stats: np.ndarray) -> np.ndarray:
        return rff((stats - self.mean) / self.scale, self.weights, self.phase)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.knots, self.values)


def rff(x: np.ndarray, weights: np.ndarray, phase: np.ndarray) -> np.ndarray:
    z = np.cos(np.clip(x, -8, 8) @ weights + phase) * math.sqrt(2 / len(phase))
    return np.hstack([z, np.ones((len(x), 1))])


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: increasing knots and their values."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    blocks: list[list[float]] = []  # sum of y, count, sum of x
    for a, b in zip(x, y):
        blocks.append([b, 1, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, c, t = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += c
            blocks[-1][2] += t
    # a block's value is shrunk by one row to the overall mean, so that it stays inside (0, 1)
    base = float(y.mean())
    knots = np.array([t / c for _, c, t in blocks])
    values = np.array([(s + base) / (c + 1) for s, c, _ in blocks])
    return knots, np.maximum.accumulate(values)


def with_statistics(docs: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    names = list(keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema)

    def run(batches):
        for batch in sliced(batches):
            stats = np.array([statistics(t.as_py()) for t in batch.column(len(names))]).reshape(-1, DIM)
            flat = pa.array(stats.reshape(-1), pa.float64())
            offsets = pa.array(np.arange(0, stats.size + 1, DIM), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.ListArray.from_arrays(offsets, flat)], names=[*names, "stats"])

    return arrow(docs.select(*names, F.col(text_col).cast("string").alias("__text")), run, f"{fields}, stats array<double>")


def sample_labels(labels: DataFrame, id_col: str, label_col: str, allowed, most: int) -> DataFrame:
    """At most ``most`` labelled ids (bounded, by a hash of the id): (id, label, fold).

    Rows of one id are merged (the largest label); null ids and labels are left out."""
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & allowed)
    one = rows.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    return thinned(one, "id", most + most // 4 + 100).orderBy(F.xxhash64("id"), "id").limit(most)


def fit(docs: DataFrame, labels: DataFrame, allowed, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = 20_000, features: int = 256, width: float = 0.25, ridge: float = 1e-3, parts: int = 8, seed: int = 7) -> QualityModel | None:
    """Fits on at most ``most`` labelled documents (a documented bound).

    None where fewer than two classes are labelled."""
    ids = sample_labels(labels, id_col, label_col, allowed, most)
    picked = docs.select(F.col(id_col).cast("long").alias("id"), text_col).join(F.broadcast(ids), "id")  # at most ``most`` ids
    rows = with_statistics(picked, ["id", "label"], text_col).dropDuplicates(["id"])
    rows = rows.withColumn("aside", F.pmod(F.xxhash64(F.col("id"), F.lit(1)), F.lit(4)) == 0).repartition(parts, "id")
    rows = written(rows, "quality-sample")
    head = rows.where("not aside").agg(
        *[F.avg(F.col("stats")[i]).alias(f"m{i}") for i in range(DIM)], *[F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in range(DIM)], F.min("label").alias("lo"), F.max("label").alias("hi")
    ).first()
    if head.lo is None or head.lo == head.hi:
        return None
    mean = np.array([head[f"m{i}"] for i in range(DIM)])
    scale = np.array([max(head[f"s{i}"], 1e-3) for i in range(DIM)])
    rng = np.random.default_rng(seed)
    weights, phase = rng.normal(0, width, (DIM, features)), rng.uniform(0, 2 * math.pi, features)
    size = features + 1
    upper = np.triu_indices(size)

    def normal(frames):
        a, b = np.zeros((size, size)), np.zeros(size)
        for f in frames:
            if len(f):
                z = rff((np.vstack(f["stats"].to_numpy()) - mean) / scale, weights, phase)
                a += z.T @ z
                b += z.T @ f["label"].to_numpy(float)
        yield pd.DataFrame({"a": [a[upper].tolist()], "b": [b.tolist()]})

    a, b = np.zeros((size, size)), np.zeros(size)
    # one row for each of ``parts`` partitions at most
    for row in rows.where("not aside").select("stats", "label").coalesce(parts).mapInPandas(normal, "a array<double>, b array<double>").toLocalIterator():
        a[upper] += np.array(row.a)
        b += np.array(row.b)
    a = a + np.triu(a, 1).T
    n = max(a[-1, -1], 1.0)
    beta = np.linalg.solve(a + ridge * n / features * np.eye(size), b)
    model = QualityModel(mean, scale, weights, phase, beta, np.zeros(1), np.zeros(1))
    aside = rows.where("aside").orderBy("id").select("stats", "label").toPandas()  # at most ``most`` rows
    if not len(aside):
        aside = rows.orderBy("id").select("stats", "label").toPandas()
    model.knots, model.values = isotonic(model.raw(np.vstack(aside["stats"].to_numpy())), aside["label"].to_numpy(float))
    return model


def score(docs: DataFrame, model: QualityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row; without a model 0.5.  Null and empty texts are
    scored by their (zero) statistics; repeated rows come out as often as they went in."""

    def run(batches):
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), scores(model, batch.column(1))], names=["id", "score"])

    return arrow(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), run, "id long, score double")


def scores(model: QualityModel | None, texts: pa.Array) -> pa.Array:
    stats = np.array([statistics(t.as_py()) for t in texts]).reshape(-1, DIM)
    return pa.array(model.score(stats) if model is not None and len(stats) else np.full(len(stats), 0.5), pa.float64())


def keep_good(docs: DataFrame, model: QualityModel | None, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``threshold``, all columns kept; only
    the texts go to Python, only the scores come back."""
    return docs.where(told(docs, text_col, lambda texts: scores(model, texts), "double") >= threshold)
