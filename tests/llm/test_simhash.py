import re

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from factloom.llm import components, queries, simhash


def plain_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_groups(fps, ids, limit=3):
    fps, lab = np.array(fps, np.uint64), np.array(ids)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= limit
    while True:
        new = np.where(near, lab[None, :], 1 << 62).min(axis=1)
        if (new == lab).all():
            return lab.tolist()
        lab = new


def test_query_against_all_pairs(spark, sf):
    got = sorted(queries.op1_simhash(spark, sf).collect())
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    prints = [plain_print(d.text) for d in docs]
    assert [g.fingerprint for g in got] == [f"{p:016x}" for p in prints]
    assert [g.component_id for g in got] == plain_groups(prints, [d.doc_id for d in docs])


def test_odd_rows(odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {r.id: r for r in got if r.id is not None}
    assert by[1].fp == by[2].fp == by[3].fp == 0 and by[1].component == by[3].component == 1
    assert by[5].component == by[8].component == 5 and [r.component for r in got if r.id is None] == [None]
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("largest", [2, 5, 1 << 16])
def test_hot_blocks_lose_no_link(spark, largest):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 12).astype(np.uint64)
    fps = base[rng.integers(0, 12, 250)]
    for _ in range(3):
        fps = fps ^ (np.uint64(1) << rng.integers(0, 64, 250).astype(np.uint64))
    fps = np.unique(np.r_[fps, base[0] ^ np.arange(60, dtype=np.uint64)])
    df = spark.createDataFrame([(int(x), i) for i, x in enumerate(fps.view(np.int64))], "fp long, rep long")
    links = simhash.fingerprint_links(df, 3, largest)
    comp = {r.node: r.component for r in components.connected_components(links).collect()}
    assert [comp.get(i, i) for i in range(len(fps))] == plain_groups(fps, range(len(fps)))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 500 for i in range(500, 560)) and len(got) == 121


def shingles(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_near_copies_against_plain_shingles(spark):
    rng = np.random.default_rng(9)
    texts = []
    for i in range(25):
        words = [f"w{x}" for x in rng.integers(0, 4000, int(rng.integers(60, 240)))]
        texts.append(" ".join(words))
        for share in (0.0, 0.01, 0.02, 0.2):
            new = [w if rng.random() > share else "changed" + str(i) for w in words]
            texts.append(" ".join(new))
    texts += ["", " ", texts[0].upper()]
    got = {r.id: r.component for r in simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [shingles(t) for t in texts]
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    missed = wrong = total = 0
    for i in range(len(texts)):
        for j in range(i):
            if like(i, j) >= 0.8 or not sets[i] | sets[j]:
                total += 1
                missed += got[i] != got[j]
            elif like(i, j) < 0.4:
                wrong += got[i] == got[j]
    assert total > 40 and missed <= 0.03 * total and wrong == 0
    assert got[125] == got[126] and got[127] == 0


def test_near_copies_odd_rows(odd, none):
    got = simhash.near_copies(odd).collect()
    assert len(got) == odd.where(F.col("doc_id").isNotNull()).count() and {r.component for r in got if r.id in (1, 2, 3)} == {1}
    assert simhash.near_copies(none).count() == 0


def plain_components(texts, similarity=0.8):
    """Over whole sets of 5-word shingles, by an index of them."""
    sets = [shingles(t or "") if (t or "").split() else set() for t in texts]
    lab, seen, empty = list(range(len(texts))), {}, None

    def top(x):
        while lab[x] != x:
            x = lab[x]
        return x

    for i, s in enumerate(sets):
        shared = {}
        for x in s:
            for j in seen.setdefault(x, []):
                shared[j] = shared.get(j, 0) + 1
            seen[x].append(i)
        near = [j for j, n in shared.items() if n >= similarity * (len(s) + len(sets[j]) - n) - 1e-9]
        if not s:
            near, empty = ([] if empty is None else [empty]), (i if empty is None else empty)
        for j in near:
            a, b = top(i), top(j)
            lab[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(texts))]


def copies_of(spark, texts, **more):
    got = {r.id: r.component for r in simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), **more).collect()}
    return [got[i] for i in range(len(texts))]


def test_near_copies_quoting_and_short(spark):
    """All that two copies share is quoted from unrelated earlier texts; and copies of 15 to 60 words."""
    rng = np.random.default_rng(31)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 50_000, n)]
    texts = []
    for _ in range(6):
        quotes = [words(60) for _ in range(6)]
        texts += [" ".join(words(400) + q + words(400)) for q in quotes]
        body = sum(quotes, [])
        texts += [" ".join(body), " ".join(body[:-1] + ["other"]), " ".join(["first"] + body)]
    for n in range(15, 60):
        body = words(n)
        texts += [" ".join(body), " ".join(body[:-1] + ["last"]), " ".join(["first"] + body[1:])]
    want = plain_components(texts)
    assert len(set(want)) < len(texts) - 80
    assert copies_of(spark, texts) == want


def test_near_copies_that_share_a_quoted_article(spark):
    """B and C share only what an earlier, unlike A quotes too."""
    rng = np.random.default_rng(41)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 5_000, n)]
    texts = []
    for _ in range(40):
        quote = words(200)
        texts += [" ".join(quote + words(2000)), " ".join(quote + words(12)), " ".join(quote + words(12))]
    got = copies_of(spark, texts)
    assert all(got[3 * k + 1] == got[3 * k + 2] for k in range(40)) and got == plain_components(texts)


def test_near_copies_of_long_texts_at_the_border(spark):
    """Pairs that sketches leave open are judged by whole sets."""
    rng = np.random.default_rng(42)
    texts = []
    for _ in range(40):
        body = [f"w{x}" for x in rng.integers(0, 5_000, 3000)]
        other = list(body)
        for i in rng.choice(3000, int(rng.integers(55, 80)), replace=False):
            other[i] = f"w{rng.integers(0, 5_000)}"
        texts += [" ".join(body), " ".join(other)]
    want = plain_components(texts)
    assert 45 < len(set(want)) < 75 and copies_of(spark, texts) == want


def test_near_copies_over_a_whole_table(spark):
    """Every group, against the whole sets of all documents."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    want = plain_components([r.text for r in docs])
    got = {r.id: r.component for r in simhash.near_copies(spark.createDataFrame(docs)).collect()}
    assert [got[r.doc_id] for r in docs] == [docs[i].doc_id for i in want]


def test_judged_leaves_open_what_it_cannot_tell():
    rng = np.random.default_rng(43)
    whole = rng.integers(0, 1 << 63, 20_000).astype(np.uint64)
    for share in (0.5, 0.7, 0.79, 0.81, 0.9, 0.99, 1.0):
        n = 10_000
        shared = int(round(2 * n * share / (1 + share)))
        a, b = np.unique(whole[:n]), np.unique(np.r_[whole[:shared], whole[n : 2 * n - shared]])
        told = simhash.judged(simhash.sketch(a), simhash.sketch(b), 0.8)
        assert told in ((0, -1) if simhash.likeness(a, b) < 0.8 else (1, -1)) and (told >= 0) == (abs(share - 0.8) > 0.07)


def test_near_copies_chains_of_edits(spark):
    """Dense groups in which most pairs are not alike and only neighbours in the chain are."""
    rng = np.random.default_rng(32)
    texts = []
    for _ in range(4):
        body = [f"w{x}" for x in rng.integers(0, 50_000, 120)]
        for step in range(40):
            texts.append(" ".join(body))
            for at in rng.integers(0, 120, 1 + step % 3):
                body = body[:at] + [f"n{rng.integers(0, 50_000)}"] + body[at + 1 :]
    texts = [texts[i] for i in rng.permutation(len(texts))]
    want = plain_components(texts)
    assert copies_of(spark, texts) == want
    assert copies_of(spark, texts, chunk=7) == want


def test_lists_hold_only_texts_that_may_be_alike(spark, monkeypatch):
    """Edits of one text that are too far from all others stay out of its lists, so no tile compares them."""
    rng, held = np.random.default_rng(34), {}
    base = [f"w{x}" for x in rng.integers(0, 50_000, 150)]
    texts = []
    for i in range(150):
        body = list(base)
        for at in np.arange(int(rng.integers(0, 15)), 150, 15 if i % 3 else 75):  # every third a near copy
            body[at] = f"n{rng.integers(0, 1 << 40)}"
        texts.append(" ".join(body))

    def spied(df, tag):
        out = written(df, tag)
        held[tag] = out.count()
        return out

    written = simhash.written
    monkeypatch.setattr(simhash, "written", spied)
    assert copies_of(spark, texts) == plain_components(texts)
    assert held["near-copies-still"] == 0


def test_posting_meets_all_alike():
    rng = np.random.default_rng(35)
    common = np.zeros(0, [("key", np.uint32), ("rank", np.int64)])
    for n in (3, 40, 300, 500, 600, 700):
        for _ in range(60):
            base = np.unique(rng.integers(0, 1 << 32, n, dtype=np.uint32))
            a, b = (np.unique(np.r_[base[rng.random(len(base)) < 0.93], rng.integers(0, 1 << 32, int(rng.integers(0, 1 + n // 12)), dtype=np.uint32)]) for _ in range(2))
            if len(a) and len(b) and simhash.likeness(a, b) >= 0.8:
                (ka, ca), (kb, cb) = (simhash.posting(x, len(x), common, 0.8) for x in (a, b))
                met = [(ca[i], cb[np.flatnonzero(kb == k)[0]]) for i, k in enumerate(ka) if k in kb]
                assert any(len(b) <= x and len(a) <= y for x, y in met)


def test_near_dedup_stage_decides_by_row(spark):
    import corpus_pipeline

    rng = np.random.default_rng(33)
    text = [" ".join(f"w{x}" for x in rng.integers(0, 50_000, 80)) for _ in range(4)]
    rows = [(1, text[0]), (2, text[0] + " more"), (2, text[1]), (3, text[2]), (3, text[2]), (4, text[2]), (5, text[3]), (None, text[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, corpus_pipeline.near_dedup_stage(spark, docs, "").collect()), key=repr)
    assert got == sorted([(1, text[0]), (2, text[1]), (3, text[2]), (5, text[3]), (None, text[3])], key=repr)


def test_tiles_judge_pairs_like_single_ones():
    rng = np.random.default_rng(5)
    for size in (60, 500, 1500):  # whole sets, and sampled ones
        base = np.unique(rng.integers(0, 1 << 32, size, dtype=np.uint32))
        sets = [np.unique(np.r_[base[rng.random(len(base)) < keep], rng.integers(0, 1 << 32, size // 20, dtype=np.uint32)]) for keep in rng.choice([0.8, 0.9, 0.95, 1.0], 60)]
        sketches = [x[: simhash.SKETCH] for x in sets]
        rows = pd.DataFrame({"rep": range(60), "n": [len(x) for x in sets], "sketch": [x.tobytes() for x in sketches], "component": range(60), "chunk": 0, "lo": 0, "hi": 0})
        told = {(max(a, b), min(a, b)): say for a, b, say in simhash._tile(0.8)(rows).itertuples(index=False)}
        alone = {(i, j): simhash.judged(sketches[i], sketches[j], 0.8) for i in range(60) for j in range(i)}
        assert told and all(alone[pair] == say for pair, say in told.items())
        lab = list(range(60))
        for (i, j), say in told.items():
            if say > 0:
                lab = [lab[j] if x == lab[i] else x for x in lab]
        assert all(lab[i] == lab[j] for (i, j), say in alone.items() if say > 0)
        if size < simhash.SKETCH:
            assert all(told.get(pair) == -1 or lab[pair[0]] == lab[pair[1]] for pair, say in alone.items() if say < 0)


def test_shared_counts_listed_and_dense_columns():
    rng = np.random.default_rng(6)
    sets = [np.unique(np.r_[rng.integers(0, 40, 30), rng.integers(40, 4000, 60)]).astype(np.uint32) for _ in range(90)] + [np.zeros(0, np.uint32)]
    got = simhash._shared(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(91) for j in range(i))
