"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams, each with an embedding; a window of
words is the mean of its words; a linear softmax scores it.  Embeddings and
softmax are trained jointly in numpy, each round over a random half of every word's
n-grams, so that no few of them carry a word alone.  A document is scored by its most
toxic window, so that a few words count as much in a long text as in a short one.
Misspellings that were never seen share n-gram vectors with the words they bend.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, sliced
from .quality import sample_labels

BUCKETS = 1 << 16
LAST = BUCKETS - 1
WINDOW = 4
PIECE, SHARED = 40, 4  # longer tokens are read in pieces that overlap, so that no n-gram is lost
STRIP = ".,;:!?'\"()[]{}|*%$&#<>"
LEAST = 2  # a window of one word counts as one of two
WORDS_HELD = 1_000_000


def subwords(word: str) -> list[int]:
    """Buckets of the bag of n-grams (3 to 5 characters) of a word with its ends marked, and of the word itself."""
    w = f"<{word}>".encode("utf-16-le", "replace")  # two bytes a character
    size = len(w)
    ids = [crc32(w[i : i + n]) & LAST for n in (6, 8, 10) for i in range(0, size - n + 1, 2)]
    ids.append(crc32(w) & LAST)
    return ids


def words_of(text: str | None) -> list[str]:
    """Lower-cased words; tokens over PIECE characters become pieces that overlap by SHARED."""
    if not text:
        return []
    words = text.lower().split()
    if words and max(map(len, words)) > PIECE:
        words = [w[i : i + PIECE] for w in words for i in range(0, max(len(w) - SHARED, 1), PIECE - SHARED)]
    return words


def windows(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all windows of WINDOW words over n words (fewer words: one window)."""
    starts = np.arange(max(n - WINDOW + 1, 1), dtype=np.int32)
    return starts, np.minimum(starts + WINDOW, n)


class Margins(dict):
    """A word's share of the toxic class's margin, worked out when first asked for."""

    def __init__(self, gram: list):
        super().__init__()
        self.gram = gram

    def __missing__(self, w: str) -> float:
        if len(self) > WORDS_HELD:  # memory only; a word is worth the same again
            self.clear()
        ids = subwords(w.strip(STRIP))
        known = self[w] = sum(map(self.gram.__getitem__, ids)) / len(ids)
        return known

    def __reduce__(self):
        return Margins, (self.gram,)


@dataclass
class ToxicModel:
    words: Margins
    bias: float
    slope: float
    shift: float

    def word(self, w: str) -> float:
        return self.words[w]

    def margin(self, text: str | None) -> float:
        """Largest margin of a window (the bias alone for a text without words)."""
        words = words_of(text)
        if not words:
            return self.bias
        sums = np.cumsum([0.0, *map(self.words.__getitem__, words)])
        a, b = windows(len(words))
        return float(((sums[b] - sums[a]) / np.maximum(b - a, LEAST)).max()) + self.bias

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(text) + self.shift, -30, 30))))


def train(texts: list[str | None], labels: np.ndarray, dim: int = 8, rounds: int = 100, warm: int = 40, keep: float = 0.5, rate: float = 0.3, decay: float = 1e-6, seed: int = 11) -> ToxicModel | None:
    """Joint full-batch training (AdaGrad).  For ``warm`` rounds all windows of a document
    carry its label; after that each round uses its worst window as it stands."""
    labels = np.asarray(labels, np.float64)
    if len(labels) == 0 or labels.min() == labels.max():
        return None
    vocabulary: dict[str, int] = {}
    tokens, starts, ends, sizes, docs = [], [], [], [], []
    at = 0
    for d, text in enumerate(texts):
        words = [w.strip(STRIP) for w in words_of(text)]
        if not words:
            continue
        tokens.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words), np.int32, len(words)))
        a, b = windows(len(words))
        starts.append(a + at)
        ends.append(b + at)
        sizes.append(len(a))
        docs.append(d)
        at += len(words)
    if not tokens:
        return None
    tokens, starts, ends = map(np.concatenate, (tokens, starts, ends))
    sizes, docs = np.array(sizes), np.array(docs)
    length = np.maximum(ends - starts, LEAST)
    bags = [subwords(w) for w in vocabulary]
    count = np.fromiter(map(len, bags), np.int64, len(bags))
    flat = np.fromiter((i for b in bags for i in b), np.int32, count.sum())
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    of_word = np.repeat(np.arange(len(bags), dtype=np.int32), count)
    del bags
    rng = np.random.default_rng(seed)
    grams = rng.normal(0, 0.05, (BUCKETS, dim))
    soft = rng.normal(0, 0.3, (dim, 2))
    bias = np.zeros(2)
    past = [np.full_like(x, 1e-8) for x in (grams, soft, bias)]
    head = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    y = labels[docs]
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    want_all, share_all = np.repeat(y, sizes), np.repeat(weight / sizes, sizes)
    for r in range(rounds):
        gap = soft[:, 1] - soft[:, 0]
        held = rng.random(len(flat)) < keep
        held[first] = True
        alive = np.add.reduceat(held, first)  # n-grams of each word in this round
        by_word = np.add.reduceat(np.where(held, (grams @ gap)[flat], 0), first) / alive
        sums = np.concatenate([[0.0], np.cumsum(by_word[tokens])])
        margin = (sums[ends] - sums[starts]) / length + bias[1] - bias[0]
        if r < warm:
            pick, want, share = slice(None), want_all, share_all
        else:  # the first window that reaches the top of its document
            at_top = np.flatnonzero(margin == np.repeat(np.maximum.reduceat(margin, head), sizes))
            pick, want, share = at_top[np.searchsorted(at_top, head)], y, weight
        slip = (1 / (1 + np.exp(-np.clip(margin[pick], -30, 30))) - want) * share
        g = slip / length[pick]
        n = len(tokens) + 1
        each = np.cumsum(np.bincount(starts[pick], g, n) - np.bincount(ends[pick], g, n))[:-1]  # what each place gets of its windows
        g_word = np.bincount(tokens, weights=each, minlength=len(count)) / alive
        g_gram = np.bincount(flat, weights=np.where(held, g_word[of_word], 0), minlength=BUCKETS)
        d_gap = grams.T @ g_gram
        d_bias = slip.sum()
        steps = (np.outer(g_gram, gap) + decay * grams, np.stack([-d_gap, d_gap], 1) + decay * soft, np.array([-d_bias, d_bias]))
        for x, s, h in zip((grams, soft, bias), steps, past):
            h += s * s
            x -= rate * s / np.sqrt(h)
    return ToxicModel(Margins((grams @ (soft[:, 1] - soft[:, 0])).tolist()), float(bias[1] - bias[0]), 1.0, 0.0)


def bent(text: str, rng: np.random.Generator, share: float = 0.5) -> str:
    """The text with a letter doubled, dropped, swapped or changed in about ``share`` of its words."""
    words = words_of(text)
    chance, kind, place, letter = rng.random(len(words)), rng.integers(0, 4, len(words)), rng.random(len(words)), rng.integers(97, 123, len(words))
    for k, w in enumerate(words):
        if chance[k] < share and len(w) > 3:
            i = 1 + int(place[k] * (len(w) - 2))
            words[k] = (w[: i + 1] + w[i:], w[:i] + w[i + 1 :], w[:i] + w[i + 1] + w[i] + w[i + 2 :], w[:i] + chr(letter[k]) + w[i + 1 :])[kind[k]]
    return " ".join(words)


def with_bent(texts: list[str | None], labels: np.ndarray, most: int = 300, seed: int = 13) -> tuple[list, np.ndarray]:
    """The training texts, and bent copies of at most ``most`` of each class."""
    rng = np.random.default_rng(seed)
    extra = [i for y in (1, 0) for i in np.flatnonzero(labels == y)[:most].tolist()]
    return [*texts, *[bent(texts[i] or "", rng) for i in extra]], np.r_[labels, labels[extra]]


def calibrate(model: ToxicModel, margins: np.ndarray, labels: np.ndarray) -> ToxicModel:
    """Fits slope and shift of the last logistic to the labels, by Newton steps with a
    small ridge, so that a score is the probability of the label."""
    x = np.stack([margins, np.ones_like(margins)], 1)
    theta = np.array([1.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        grad = x.T @ (p - labels) + 1e-2 * (theta - [1.0, 0.0])
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2), grad)
        theta = theta - np.clip(step, -1, 1)
    if theta[0] > 0:
        model.slope, model.shift = float(theta[0]), float(theta[1])
    return model


def fit(docs: DataFrame, labels: DataFrame, allowed, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = 4_000, most_chars: int = 12_000_000, longest: int = 200_000) -> ToxicModel | None:
    """Fits on at most ``most`` labelled documents of at most ``longest`` characters each and
    ``most_chars`` together (documented bounds; picked by a hash of the id); a quarter of them
    is kept aside for the calibration.  A longer document is passed over, so that none decides
    whether there is a model.  None where a class is missing."""
    ids = sample_labels(labels, id_col, label_col, allowed, most)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # lengths first, which is at most ``most`` rows; only texts that are taken are gathered
    sizes = texts.select("id", F.coalesce(F.length("text"), F.lit(0)).alias("n")).join(F.broadcast(ids), "id").groupBy("id").agg(F.max("n").alias("n"))
    sizes = sizes.where(F.col("n") <= longest).select("id", "n", F.xxhash64("id").alias("h")).toPandas().sort_values(["h", "id"])
    taken = sizes[sizes["n"].cumsum() <= most_chars]["id"].tolist()
    if not taken:
        return None
    picked = ids.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in taken], "id long")), "id")
    rows = texts.join(F.broadcast(picked), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    rows = rows.toPandas().sort_values("id", ignore_index=True)
    if not len(rows):
        return None
    aside = np.array([crc32(b"aside%d" % i) % 4 == 0 for i in rows["id"]])
    texts, y = rows["text"].tolist(), rows["label"].to_numpy(float)
    model = train(*with_bent([t for t, a in zip(texts, aside) if not a], y[~aside]))
    if model is None:
        return None
    kept = [t for t, a in zip(texts, aside) if a]
    if len(kept) and 0 < y[aside].mean() < 1:
        calibrate(model, np.array([model.margin(t) for t in kept]), y[aside])
    return model


def score(docs: DataFrame, model: ToxicModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row; without a model 0.  Null and empty texts are
    scored by the bias; repeated rows come out as often as they went in."""

    def run(batches):
        for batch in sliced(batches):
            p = [model.score(t.as_py()) if model is not None else 0.0 for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], names=["id", "score"])

    return arrow(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), run, "id long, score double")
