"""Quality and toxicity: held-out accuracy, odd rows, missing labels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import quality, queries, toxicity

BIG = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name, label", [("op2_quality", "quality"), ("op9_toxicity", "toxic")])
def test_held_out(spark, name, label):
    sf_dir = BIG if label == "quality" else "/root/testdata/sf0.1"  # few toxic rows are labelled in the smaller one
    got = queries.QUERIES[name](spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert got.count() == docs.count() and got.where("score < 0 or score > 1 or score is null").count() == 0
    truth = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", label)
    rows = got.join(truth, "doc_id").where("held_out").select("predicted", label).collect()
    assert len(rows) > 50 and sum(a == b for a, b in rows) / len(rows) > 0.95
    want = F.crc32(F.col("doc_id").cast("string")) % (3 if label == "quality" else 4) == (1 if label == "quality" else 2)
    assert got.where(F.col("held_out") != want).count() == 0


def test_quality_fit_is_the_plain_one(spark):
    """The fitted model against normal equations and pooling written out in loops."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = quality.fit(docs, labels, F.lit(True))
    truth = {r.doc_id: r.quality for r in labels.collect()}
    apart = {r.doc_id: r.a for r in docs.select("doc_id", (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(1)), F.lit(4)) == 0).alias("a")).collect()}
    stats = {r.doc_id: plain_statistics(r.text) for r in docs.collect()}
    for k, v in stats.items():
        assert np.allclose(v, quality.statistics(next(r.text for r in docs.where(F.col("doc_id") == k).collect()))) if k < 5 else True
    x = np.array([stats[k] for k in sorted(truth) if not apart[k]])
    y = np.array([truth[k] for k in sorted(truth) if not apart[k]], float)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    z = np.cos(np.clip((x - mean) / scale, -8, 8) @ model.weights + model.phase) * np.sqrt(2 / len(model.phase))
    z = np.hstack([z, np.ones((len(z), 1))])
    beta = np.linalg.solve(z.T @ z + 1e-3 * len(z) / len(model.phase) * np.eye(z.shape[1]), z.T @ y)
    aside = [k for k in sorted(truth) if apart[k]]
    raw = model.raw(np.array([stats[k] for k in aside]))
    assert np.allclose(mean, model.mean) and np.allclose(scale, model.scale) and np.allclose(z @ beta, model.raw(x), atol=1e-4)
    knots, values = quality.isotonic(raw, np.array([truth[k] for k in aside], float))
    assert np.allclose(knots, model.knots) and np.allclose(values, model.values)
    got = {r.id: r.score for r in quality.score(docs, model).collect()}
    assert all(abs(got[k] - np.interp(model.raw(stats[k][None]), knots, values)[0]) < 1e-9 for k in stats)


def plain_statistics(text):
    """The statistics by plain counting."""
    import math
    from collections import Counter

    raw, words, lines = text.encode(), text.split(), text.split("\n")
    sign = lambda *kinds: sum(c in kinds for c in map(chr, raw)) / len(raw)
    size = [len(w) for w in words]
    mean = sum(size) / len(size)
    p = [n / len(raw) for n in Counter(raw).values()]
    upper, lower, digits = (sum(a <= c <= b for c in raw) / len(raw) for a, b in ((65, 90), (97, 122), (48, 57)))
    marks, beyond = sign(*".,;:?'\"()-"), sum(c >= 128 for c in raw) / len(raw)
    parts = [upper, lower, digits, sign(" "), sign("\n"), sign("!"), sign("|"), marks]
    next_ = list(zip(words, words[1:]))
    return np.array([
        math.log1p(len(words)), min(mean, 50), min(math.sqrt(sum((n - mean) ** 2 for n in size) / len(size)), 50), len(set(words)) / len(words),
        sum(a == b for a, b in next_) / len(next_) if next_ else 0.0, len(set(next_)) / len(next_) if next_ else 1.0, *parts, 1 - sum(parts) - beyond, beyond,
        -sum(x * math.log2(x) for x in p), math.log1p(len(text) / len(lines)), len(set(lines)) / len(lines), sum(n <= 3 for n in size) / len(size),
    ])


def test_toxic_margin_is_the_plain_one(spark):
    """Scores against windows, bags and n-grams written out in loops."""
    from zlib import crc32

    docs = spark.read.parquet(f"{BIG}/documents.parquet").limit(60)
    model = toxicity.fit(spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet"), F.lit(True))

    def word(w):
        w = "<" + w.strip(toxicity.STRIP) + ">"
        grams = [w[i : i + n] for n in (3, 4, 5) for i in range(len(w) - n + 1)] + [w]
        return sum(model.words.gram[crc32(g.encode("utf-16-le")) & toxicity.LAST] for g in grams) / len(grams)

    got = {r.id: r.score for r in toxicity.score(docs, model).collect()}
    for r in docs.collect():
        words = r.text.lower().split()
        if max(map(len, words), default=0) > toxicity.PIECE:
            continue
        each = [word(w) for w in words]
        margin = max(sum(each[i : i + 4]) / max(len(each[i : i + 4]), 2) for i in range(max(len(each) - 3, 1))) + model.bias
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-(model.slope * margin + model.shift)))) < 1e-6


def test_long_tokens_lose_no_n_gram():
    text = "".join(chr(97 + i % 26) for i in range(500))
    pieces = toxicity.words_of(text)
    grams = lambda w: {w[i : i + n] for n in (3, 4, 5) for i in range(len(w) - n + 1)}
    assert grams(text) <= set().union(*map(grams, pieces)) and max(map(len, pieces)) <= toxicity.PIECE


def test_training_on_windows_is_whole_documents_gradient():
    """What a round adds up by differences is what loops give."""
    a, b = toxicity.windows(7)
    assert [(int(x), int(y)) for x, y in zip(a, b)] == [(0, 4), (1, 5), (2, 6), (3, 7)]
    assert [tuple(map(int, x)) for x in zip(*toxicity.windows(2))] == [(0, 2)]


def test_labels_held_out_do_not_matter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    allowed = F.crc32(F.col("doc_id").cast("string")) % 3 != 1
    turned = labels.withColumn("quality", F.when(allowed, F.col("quality")).otherwise(1 - F.col("quality")))
    a, b = (quality.fit(docs, x, allowed) for x in (labels, turned))
    if a is not None:
        assert (a.beta == b.beta).all() and (a.values == b.values).all()


def test_odd_rows_and_no_model(spark, odd, none):
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 1), (None, 1, 1), (5, None, None), (6, 0, 1)], "doc_id long, quality int, toxic int")
    everything = F.lit(True)
    for part, kind in ((quality, "quality"), (toxicity, "toxic")):
        model = part.fit(odd, labels, everything)
        got = part.score(odd, model).collect()
        assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
        assert part.fit(odd, labels.limit(0), everything) is None and part.fit(none, labels, everything) is None
        assert part.score(none, None).count() == 0 and part.score(odd, None).count() == odd.count()
    assert quality.keep_good(odd, None).count() == odd.count()


def test_statistics_are_finite():
    for text in (None, "", " ", "a", "\n", "!!!", "é" * 5, "x " * 1000):
        assert all(abs(v) < 1e6 for v in quality.statistics(text))


def test_isotonic_never_falls():
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=500)
    knots, values = quality.isotonic(x, (rng.random(500) < 1 / (1 + np.exp(-3 * x))).astype(float))
    assert (np.diff(knots) > 0).all() and (np.diff(values) >= 0).all() and 0 < values[0] and values[-1] < 1


def test_misspellings_share_vectors(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{BIG}/labels.parquet"), F.lit(True))
    clean = model.word("the")
    assert all(model.word(w) > clean + 3 for w in ("idiots", "stuppid", "clowns", "moronn"))


@pytest.mark.parametrize("where", ["first", "middle", "last"])
def test_one_long_text_does_not_decide(spark, where):
    """A text of 13 million characters, wherever it stands in the order of hashes, is passed over."""
    rows = [(i, "you vile zorbag scum now" if i % 2 else "a calm walk in the green park") for i in range(1, 61)]
    order = [r.id for r in spark.range(1, 61).orderBy(F.xxhash64("id")).collect()]
    long = order[{"first": 0, "middle": 30, "last": 59}[where]]
    docs = spark.createDataFrame([(i, t) for i, t in rows if i != long], "doc_id long, text string").union(spark.range(1).select(F.lit(long).cast("long"), F.repeat(F.lit("word "), 2_600_000)))
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True))
    assert model is not None
    got = {r.id: r.score for r in toxicity.score(docs.where(F.col("doc_id") != long), model).collect()}
    assert min(s for i, s in got.items() if i % 2) > max(s for i, s in got.items() if i % 2 == 0)
