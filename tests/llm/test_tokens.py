"""Packing, token counts and mixing."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from factloom.llm import mixing, packing, queries, tokens

WORDS = ["the", "Foo", "x1", "  ", "\n", "\n\n", "é", "ñandú", "...", "don't", "a" * 30, "<|endoftext|>", "$%", "12 34", "\t", " \n ", "日本"]


def made(rng, n):
    return "".join(rng.choice(WORDS) + rng.choice([" ", " ", "", "  ", "\n"]) for _ in range(n))


def test_fast_encoder_gives_the_same_ids():
    rng = random.Random(3)
    fast, slow = tokens.encoder(*tokens.default_files()), tokens.encoder(tokens.default_files()[0], None)
    for text in [made(rng, n) for n in (0, 1, 7, 90, 400) for _ in range(25)] + ["y" * 9000, "<|endoftext|>", " \u00a0\u3000 a"]:
        assert fast(text) == slow(text)


def test_tree_edits_equal_whole_encoding():
    rng, encode = random.Random(5), tokens.encoder(*tokens.default_files())
    for _ in range(60):
        text = made(rng, rng.choice([0, 1, 5, 60, 200]))
        tree = tokens.TokenTree(text, encode, rng.choice([5, 20, 100]))
        for _ in range(6):
            a, d, new = rng.randrange(len(text) + 3), rng.choice([0, 0, 1, 5, 50]), rng.choice(["", " ", "x", made(rng, 3), made(rng, 40)])
            tree.edit(a, d, new)
            a = min(a, len(text))
            text = text[:a] + new + text[a + d :]
            assert "".join(tree.leaves) == text and tree.total == len(encode(text)) and tree.length == len(text)


def test_op7_against_whole_texts(spark, sf):
    got = {r.doc_id: r for r in queries.op7_token_counts(spark, sf).collect()}
    encode = tokens.encoder(*tokens.default_files())
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        n, t = len(d.text), d.text
        t = t[: n // 2] + f" edited {d.doc_id}" + t[n // 2 :]
        t = t[: n // 3] + t[n // 3 + 40 :] + "\nThe end."
        assert (got[d.doc_id].n_tokens, got[d.doc_id].n_tokens_edited) == (len(encode(d.text)), len(encode(t)))
        assert got[d.doc_id].reencoded_chars < 6000


def test_edits_odd_rows(spark, odd, none):
    edits = spark.createDataFrame([(5, 2, 0, 3, "TWO "), (5, 1, 4, 100, ""), (6, 1, -5, 2, None), (None, 1, 0, 0, "x")], "doc_id long, seq int, start long, removed long, inserted string")
    got = tokens.edited_counts(tokens.attach_edits(odd, edits)).collect()
    assert len(got) == odd.count() and [r.n_chars_edited for r in got if r.id == 5] == [5, 5]
    assert [r.n_tokens for r in got if r.id in (1, 2)] == [0, 0]
    assert tokens.edited_counts(tokens.attach_edits(none, edits)).count() == 0
    assert tokens.count_tokens(odd).where("doc_id = 1").first().n_tokens == 0


def check_packing(docs, pieces, capacity=2048):
    slow = tokens.encoder(tokens.default_files()[0], None)
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault((p.doc_tokens, p.id), []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    want = {}
    for key, text in docs:
        ids = np.array([*slow(text or ""), 1], "<u4")
        for s in range(0, len(ids), capacity):
            want.setdefault((key, len(ids), s, len(ids[s : s + capacity]), zlib.crc32(ids[s : s + capacity])), []).append(1)
    got = {}
    for p in pieces:
        got.setdefault((p.id, p.doc_tokens, p.start, p.length, p.ids_crc32), []).append(1)
    assert got == want
    for rows in by_seq.values():
        at = 0
        for p in sorted(rows, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
    used = sum(p.length for p in pieces)
    return 1 - used / (len(by_seq) * capacity)


def test_packing_round_trip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    padding = check_packing([(r.doc_id, r.text) for r in docs.collect()], packing.pack(docs).collect())
    assert padding < 0.05  # two hundred documents


def test_packing_odd_rows_and_ids(odd, none):
    pieces = packing.pack(odd, with_ids=True).collect()
    check_packing([(r.doc_id, r.text) for r in odd.collect()], pieces)
    assert all(zlib.crc32(np.array(p.ids, "<u4")) == p.ids_crc32 and len(p.ids) == p.length for p in pieces)
    assert packing.pack(none).count() == 0


def test_patterns_hold_every_item_with_little_waste():
    rng = np.random.default_rng(2)
    for n in (1, 40, 3000):
        sizes, counts = np.unique(rng.integers(1, 257, n), return_counts=True)
        histogram = dict(zip(sizes.tolist(), counts.tolist()))
        plan, held = packing.plan_patterns(histogram, 256), {}
        for pattern, uses in plan:
            assert sum(s * c for s, c in pattern.items()) <= 256
            for s, c in pattern.items():
                held[s] = held.get(s, 0) + c * uses
        assert held == histogram
        least = -(-int((sizes * counts).sum()) // 256)
        assert sum(u for _, u in plan) <= least * 1.03 + 2


def test_mixing_by_sizes_kept_apart(spark):
    rows = [(i, f"text {i}", "ab"[i % 7 == 0], i % 50) for i in range(400)] + [(400, None, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n long")
    marked = df.selectExpr("doc_id", "text", "source", "cast(n > 0 as int) as n")
    want, got = (mixing.mix(d, "n", block_tokens=500, sizes=s).drop("n").collect() for d, s in ((df, None), (marked, df.select("doc_id", "source", "n"))))
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(want) > len(rows)


def test_mixing_against_plain_sums(spark):
    rng = np.random.default_rng(6)
    rows = [(i, "hot" if i % 3 else f"s{i % 7}", int(rng.integers(1, 400))) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n long")
    got = mixing.mix(df, "n", block_tokens=500).collect()
    totals = {}
    for _, s, n in rows:
        totals[s] = totals.get(s, 0) + n
    plan = mixing.plan_budgets(totals)
    assert abs(sum(w for w, _ in plan.values()) - 1) < 1e-9
    sums, first, most = {}, {}, {}
    for r in got:
        sums[r.source] = sums.get(r.source, 0) + r.n
        first[r.doc_id] = min(first.get(r.doc_id, 9), r.mix_epoch)
        most[r.doc_id] = most.get(r.doc_id, 0) + 1
    assert set(first) == {i for i, _, _ in rows} and set(first.values()) == {0} and max(most.values()) <= 2
    for s, (_, budget) in plan.items():
        assert abs(sums[s] - budget) <= 1500, (s, sums[s], budget)
    # places are the running sums of the permuted blocks
    for s in totals:
        blocks = {}
        for r in got:
            if r.source == s and r.mix_epoch == 0:
                blocks.setdefault((r.mix_place, r.mix_block), 0)
                blocks[(r.mix_place, r.mix_block)] += r.n
        at = 0
        for (place, _), size in sorted(blocks.items()):
            assert abs(place - at / plan[s][1]) < 1e-9
            at += size


def test_temperature_meets_its_targets():
    t = np.array([1000.0, 100.0, 10.0, 10.0])
    natural, even = mixing.entropy(mixing.weights_at(t, 1)), np.log(4)
    a = mixing.temperature(t, 0.5, 1e9)
    assert abs(mixing.entropy(mixing.weights_at(t, a)) - (natural + even) / 2) < 1e-6
    b = mixing.temperature(t, 0.5, 2.0)
    assert abs(mixing.repetition(t, b) - 2.0) < 1e-6
    assert mixing.temperature(np.array([5.0]), 0.5, 2) == 1.0


def test_mixing_odd_rows(spark, odd, none):
    counted = odd.withColumn("n", F.length("text"))
    got = mixing.mix(counted, "n")
    assert got.select("doc_id", "text").distinct().count() == odd.select("doc_id", "text").distinct().count() and got.count() >= odd.count()
    assert mixing.mix(none.withColumn("n", F.lit(1)), "n").count() == 0
    small = mixing.mix(counted, "n", budget=10)
    assert small.where("n > 0").agg(F.sum("n")).first()[0] is None or small.count() <= odd.count()
