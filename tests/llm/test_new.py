"""Periodic runs, hard negatives and exact dedup against brute force."""

import hashlib
import random
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import exact, negatives, periodic, queries


# ---------------------------------------------------------------- runs


def plain_runs(w):
    """Every period on its own: maximal stretches of equal words, and whether a smaller period holds too."""
    n, out = len(w), []
    for q in range(1, n // 3 + 1):
        same = [w[i] == w[i + q] for i in range(n - q)] + [False]
        start = None
        for i, x in enumerate(same):
            if x and start is None:
                start = i
            if not x and start is not None:
                length = i - start + q
                part = w[start : start + length]
                if length >= max(24, 3 * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                    out.append((start, length, q))
                start = None
    return sorted(out, key=lambda r: (r[0], r[2]))


def made(rng):
    """Random words, repeated stretches of many periods, nested and overlapping ones."""
    out = []
    for _ in range(rng.randrange(1, 7)):
        kind = rng.randrange(5)
        unit = [rng.randrange(rng.choice((2, 3, 50))) for _ in range(rng.randrange(1, 40))]
        if kind == 0:
            out += [rng.randrange(5) for _ in range(rng.randrange(60))]
        elif kind == 1:
            out += (unit * 40)[: rng.randrange(24, 120 + len(unit) * 4)]
        elif kind == 2:
            out += unit * 3
        elif kind == 3:
            inner = (unit[:3] * 20)[: rng.randrange(20, 40)] + unit
            out += inner * rng.randrange(2, 5)
        else:
            out += [7] * rng.randrange(20, 90)
    return out


@pytest.mark.parametrize("seed", range(150))
def test_runs_are_all_runs(seed):
    w = made(random.Random(seed))
    assert periodic.runs(np.array(w, np.int64)) == plain_runs(w)


@pytest.mark.parametrize("q", [1, 2, 7, 8, 9, 15, 16, 17, 31, 32, 33, 63, 64, 65])
def test_shortest_runs_at_every_place(q):
    """A run of just the length asked for is found wherever blocks fall, one word less is none."""
    unit = list(range(q))
    length = max(24, 3 * q)
    for shift in range(0, 20):
        front = [1000 + i for i in range(shift)]
        w = np.array(front + (unit * 30)[:length] + [5000], np.int64)
        assert periodic.runs(w) == [(shift, length, q)]
        assert periodic.runs(np.array(front + (unit * 30)[: length - 1] + [5000], np.int64)) == []


def test_long_run_over_many_windows(monkeypatch):
    monkeypatch.setattr(periodic, "WINDOW", 64)
    rng = random.Random(3)
    w = [rng.randrange(9) for _ in range(100)] * 9 + [rng.randrange(9) for _ in range(333)] * 4 + [3] * 500
    assert periodic.runs(np.array(w, np.int64)) == plain_runs(w)


def test_one_word_a_hundred_thousand_times():
    assert periodic.runs(np.zeros(100_000, np.int64)) == [(0, 100_000, 1)]


def test_words_in_pieces():
    text = (" \t\x0bab\xa0c d\x0c\re " * 200_000 + "x" * 3_000_000 + " end").encode()
    ids, names = periodic.numbered(text)
    assert [names[i] for i in ids] == text.split()
    assert periodic.numbered(b"  \n")[0].size == 0


def expected_row(doc_id, text):
    w = (text or "").encode().split()
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and w:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))]
    found = plain_runs(w)
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found).encode()
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(lines), sha(kept))


ROW = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_op11_rows(spark, sf, odd, none, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 20000")
    docs.select("doc_id", "text").union(odd.where("doc_id <> 6 or doc_id is null").select("doc_id", "text")).write.parquet(f"{tmp_path}/documents.parquet")
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet").collect()
    got = queries.op11_periodic_runs(spark, str(tmp_path)).select(*ROW).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((expected_row(r.doc_id, r.text) for r in rows), key=repr)
    assert sum(r.n_runs > 0 for r in got) > 5
    assert periodic.find_runs(none).count() == 0


# ---------------------------------------------------------------- hard negatives


def plain_negatives(rows, positives=5, negatives_=10):
    """(anchor, positive, rank, negative, scores) of rows (id, vector, label) by plain loops."""
    able = [(k, i, [int(np.floor(256 * float(x))) for x in v], lab) for k, (i, v, lab) in enumerate(rows) if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for k, i, v, lab in able:
        if i % 100:
            continue
        score = [(sum(a * b for a, b in zip(v, w)), j, m, other) for m, j, w, other in able if m != k and len(w) == len(v)]
        score.sort(key=lambda s: (-s[0], s[1], s[2]))
        for p, j, _, _ in [s for s in score if s[3] == lab][:positives]:
            bad = [s for s in score if s[3] != lab and 30 * p <= 100 * s[0] <= 90 * p][:negatives_]
            out += [(i, j, r, s[1], p, s[0]) for r, s in enumerate(bad, 1)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<float>, label int, score string, row int, v string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, lab, "s", 1, "v") for i, v, lab in rows], VECTORS).repartition(5)


def mined(df, **more):
    return sorted(map(tuple, negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, **more).collect()))


def test_negatives_of_random_and_tied_vectors(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(4, 12))
    rows = [(int(i), (centre[i % 4] + rng.normal(size=12) * rng.choice([0.05, 0.6])).round(1).tolist(), int(rng.integers(4))) for i in range(700)]
    rows += [(1000 + i, [1.0] * 12, i % 2) for i in range(40)]  # ties
    rows += [(1000, [1.0] * 12, 0), (1000, [1.0] * 12, 0)]  # repeated rows
    rows += [(2000, [0.0] * 12, 1), (2100, [-1.0, 2.0], 1), (2101, [-1.0, 2.5], 1), (2102, [0.0, 1.5], 0), (2200, [], 1), (2201, [], 1), (2202, [], 2)]
    rows += [(None, [1.0] * 12, 1), (3000, None, 1), (3100, [1.0] * 12, None), (3200, [float("nan")] + [1.0] * 11, 1), (3300, [float("inf")] + [1.0] * 11, 1), (3400, [None] + [1.0] * 11, 1)]
    want = plain_negatives(rows)
    assert len(want) > 300 and any(w[0] == 2100 for w in want) and any(w[0] == 2200 for w in want)
    assert mined(vectors(spark, rows)) == want
    assert mined(vectors(spark, rows), sample=3) == want


def test_blocks_of_a_few_rows(spark, monkeypatch):
    """The same rows whatever the number of blocks and the size of parts."""
    rng = np.random.default_rng(6)
    rows = [(int(i) * 10, rng.normal(size=6).tolist(), int(i % 3 == 0)) for i in range(150)]
    frame = vectors(spark, rows)
    met = negatives._met

    def small(anchors, plain, keys, run, schema):
        return met(anchors.withColumn("dim", F.lit(1 << 18)), plain.withColumn("dim", F.lit(1 << 18)), keys, lambda f: run(f.assign(dim=6)), schema)

    monkeypatch.setattr(negatives, "_met", small)
    monkeypatch.setattr(negatives, "CELLS", 256)
    assert mined(frame) == plain_negatives(rows)


def test_survivors_lose_nothing():
    rng = np.random.default_rng(7)
    a, b = (rng.integers(-300, 300, (n, 16)) * np.arange(16, 0, -1) ** 2 for n in (20, 900))
    turn = negatives.rotation(b.astype(float))
    assert np.allclose(turn @ turn.T, np.eye(16))
    steps = [1, 2, 4, 8, 16]
    x, y = negatives.Rotated(a, turn, steps), negatives.Rotated(b, turn, steps)
    true = a @ b.T
    low, high = np.sort(true, axis=1)[:, -30].astype(float), np.sort(true, axis=1)[:, -5].astype(float)
    i, j, s = negatives.survivors(x, y, slice(0, 900), low, high, steps)
    assert (true[i, j] == s).all()
    got = set(zip(i.tolist(), j.tolist()))
    want = set(zip(*(z.tolist() for z in np.nonzero((true >= low[:, None]) & (true <= high[:, None])))))
    assert want <= got and len(got) < 4 * len(want)


def test_too_long_vectors_are_an_error(spark):
    with pytest.raises(Exception, match="too long"):
        mined(vectors(spark, [(0, [1e30, 0.0], 1), (1, [1.0, 0.0], 1)]))


# ---------------------------------------------------------------- exact dedup


def plain_copies(rows):
    by = {}
    for k, (i, t) in enumerate(rows):
        by.setdefault(t or "", []).append((i is not None, i or 0, k, i))
    out = []
    for t, group in by.items():
        last = max(g[:2] for g in group)
        keep = last[1] if last[0] else None
        one = False
        for known, i, _, own in group:
            stays = (known, i) == last and not one
            one |= stays
            out.append((own, keep, len(group), stays, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_copies_with_hot_groups(spark, odd, none):
    rows = [(i, "hot" if i % 3 == 0 else "warm" if i % 50 == 1 else None if i % 90 == 2 else f"text {i // 4}") for i in range(3000)]
    rows += [(9, "hot"), (2999, "warm"), (2999, "warm"), (None, "hot"), (None, "lonely"), (None, "lonely"), (5000, ""), (-4, "neg")]
    rng = random.Random(1)
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "x", 1, "d") for i, t in rows], "doc_id long, text string, digest string, row int, id string").repartition(7)
    want = plain_copies(rows)
    for share in (None, 0.5, 0.01, 0.0005, 1e-9 + 1 / 3000):
        assert sorted(map(tuple, exact.find_copies(docs, share=share).collect()), key=repr) == want
    kept = exact.without_copies(docs).collect()
    assert len(kept) == len({t or "" for _, t in rows}) == len({r.text or "" for r in kept})
    assert {(r.doc_id, r.text) for r in kept if r.doc_id is not None} <= set(rows) and kept[0].digest == "x"
    assert exact.find_copies(none).count() == exact.without_copies(none).count() == 0
    assert len(exact.find_copies(odd).collect()) == odd.count()
    upper = exact.find_copies(docs, normalise=F.upper).where("sha256 = sha2('HOT', 256)").count()
    assert upper == sum(t == "hot" for _, t in rows)


def test_heavy_hitters_are_never_missed(spark):
    rng = random.Random(2)
    for _ in range(20):
        counters = rng.randrange(1, 6)
        values = [rng.choice("aaabbcdefghijklmnop") for _ in range(400)]
        import pyarrow as pa

        held = pa.table({"d": pa.array([], pa.binary()), "n": pa.array([], pa.int64())})
        for k in range(0, 400, 37):
            part = [v.encode() for v in values[k : k + 37]]
            held = exact.reduced(pa.concat_tables([held, pa.table({"d": pa.array(part, pa.binary()), "n": pa.array([1] * len(part), pa.int64())})]), counters)
        got = dict(zip([d.decode() for d in held.column("d").to_pylist()], held.column("n").to_pylist()))
        assert len(got) <= counters
        for v in set(values):
            true = values.count(v)
            assert true - 400 / (counters + 1) <= got.get(v, 0) <= true


@pytest.mark.parametrize("name", ["op12_hard_negatives", "op13_exact_dedup"])
def test_same_rows_as_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    got, want = queries.QUERIES[name](spark, sf), con.sql(queries.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall()) != []
