"""Embeddings, personal data, fingerprints, url filters and the pipeline."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import embeddings, multiset, pii, queries, urls

# ---------------------------------------------------------------- embeddings


def plain_links(rows, limit=0.93):
    units = [embeddings.unit(v) for _, v, _ in rows]
    out, lab = [0] * len(rows), [r[0] for r in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and rows[i][2] is not None and rows[i][2] == rows[j][2] and float(units[i] @ units[j]) >= limit]
    for i, j in pairs:
        out[i] += 1
        out[j] += 1
    changed = True
    while changed:
        changed = False
        for i, j in pairs:
            m = min(lab[i], lab[j])
            changed |= lab[i] != m or lab[j] != m
            lab[i] = lab[j] = m
    return sorted((r[0], n, c, r[0] == c) for r, n, c in zip(rows, out, lab))


@pytest.mark.parametrize("cell, block", [(4096, 4096), (20, 7)])
def test_embeddings_against_all_pairs(spark, sf, cell, block):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    rng = np.random.default_rng(1)
    extra = [(10_000 + i, (np.array(rows[i % 5][1]) * (1 + i % 2) + rng.normal(0, 0.04 * (i % 3), 64)).tolist(), rows[i % 5][2]) for i in range(40)]
    extra += [(20_000, None, 1), (20_001, [0.0] * 64, 1), (20_002, [float("nan")] * 64, 1), (20_003, rows[0][1], None), (20_004, [1.0, 2.0], 1), (20_005, [2.0, 4.0], 1), (20_006, [], 1)]
    rows += extra
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), cell=cell, block=block)
    assert sorted(tuple(r) for r in got.collect()) == plain_links(rows)


def test_embeddings_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embeddings.near_duplicates(none).count() == 0
    bad = spark.createDataFrame([(None, [1.0], 1), (3, None, 1)], "vec_id long, embedding array<float>, label int")
    assert sorted((r.id or -1, r.n_links) for r in embeddings.near_duplicates(bad).collect()) == [(-1, 0), (3, 0)]


# ---------------------------------------------------------------- personal data

PLAIN = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_spans(t):
    out = [(0, m.start(), m.end()) for m in PLAIN[0].finditer(t)]
    out += [(1, m.start(), m.end()) for m in PLAIN[1].finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
    for kind in (2, 3):
        for m in PLAIN[kind].finditer(t):
            digits = re.sub("[^0-9]", "", m.group())
            if (kind == 2 and 13 <= len(digits) <= 19 and pii.luhn(digits)) or (kind == 3 and 9 <= len(digits) <= 15):
                out.append((kind, m.start(), m.end()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["1", "2", "4", "0", ".", "-", " ", "@", "a", "b", "+", "(", ")", "é", "9", ".com", "@x.y", "255", "4111111111111111", "٣"])).map("".join))
def test_base_spans_are_the_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_base_is_linear():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "1." * 150_000, "+1(" * 100_000):
        pii.base_spans(text)


@pytest.fixture(scope="module")
def tagger(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    return pii.fit(docs)


def written_in(make, hosts, words, count, seed):
    """Texts into which ``make`` writes something, and its (kind, start, end)."""
    rng = np.random.default_rng(seed)
    texts, spans = [], []
    for _ in range(count):
        host = hosts[int(rng.integers(len(hosts)))]
        cut = host.find(" ", int(rng.integers(300))) + 1
        kind, span = make(rng, words)
        texts.append(host[:cut] + span + " " + host[cut:])
        spans.append((kind, cut, cut + len(span)))
    return texts, spans


def test_network_finds_held_out_spans_of_other_forms(spark, tagger):
    """Precision and recall over whole texts that it was not trained on."""
    found = [r.text for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").collect()]
    hosts = [t for t in found if len(t) > 400 and not re.search("[0-9@]", t)][:1500]
    words = sorted({w for t in hosts[:50] for w in re.findall("[a-z]{2,9}", t)})
    texts, want = written_in(pii.spelled, hosts, words, 300, 99)
    got = pii.added_spans(texts, [pii.base_spans(t) for t in texts], tagger)
    hit = sum(w in g for w, g in zip(want, got))
    assert hit >= 0.9 * len(want) and hit >= 0.9 * sum(map(len, got))
    for t, g in zip(texts, got):
        for kind, a, b in g:
            digits = re.sub("[^0-9]", "", t[a:b])
            assert kind != 2 or (13 <= len(digits) <= 19 and pii.luhn(digits))
    texts, _ = written_in(lambda rng, words: (0, pii.harmless(rng, words)), hosts, words, 300, 98)
    assert sum(map(bool, pii.added_spans(texts, [[]] * 300, tagger))) <= 9
    base = [pii.base_spans(t) for t in found]
    assert sum(map(len, pii.added_spans(found[:3000], base[:3000], tagger))) <= 0.1 * sum(map(len, base[:3000]))


def test_network_alone_finds_base_spans(spark, tagger):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    base = [pii.base_spans(t) for t in texts]
    alone = pii.added_spans(texts, [[]] * len(texts), tagger)
    total = sum(map(len, base))
    assert total > 50 and sum(s in a for b, a in zip(base, alone) for s in b) > 0.8 * total


def test_windows_cover_every_character():
    for n in [*range(0, 1200, 7), 511, 512, 513, 975, 976, 977, 100_000]:
        found = pii.windows(n)
        assert (not found) == (n == 0)
        if found:
            assert found[0][0] == 0 and found[-1][1] == n
            assert all(b - a <= pii.WIDTH for a, b in found) and all(c[0] <= b[1] - min(pii.OVERLAP, n) for b, c in zip(found, found[1:]))


def test_settled_windows_are_what_viterbi_gives(tagger):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abc 123@.+()dot at"), 90)) for _ in range(60)] + ["the people of the town went home " * 3] * 60
    x = np.zeros((len(texts), 100), np.uint8)
    for row, t in zip(x, texts):
        row[: len(t[:100])] = pii.encode(t[:100])
    lengths = np.array([min(len(t), 100) for t in texts])
    whole = tagger.best(tagger.scores(tagger.states(x)), lengths)
    assert (tagger.decode(x, lengths) == whole).all()


def test_network_gradients():
    """What training follows is the slope of the likelihood."""
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 20, (3, 9)).astype(np.uint8), rng.integers(0, 5, (3, 9))
    model = pii.train(x, y, epochs=1, rate=0.0, size=4, width=3)
    p = model.p

    def loss():
        s = model.scores(model.states(x)).astype(float)
        best = s[0] + p["first"]
        for i in range(1, 9):
            best = pii._logsum(best[:, :, None] + p["trans"], 1) + s[i]
        of = lambda j: p["first"][y[j, 0]] + sum(s[i, j, y[j, i]] for i in range(9)) + sum(p["trans"][y[j, i - 1], y[j, i]] for i in range(1, 9))
        return sum(pii._logsum(best, 1)[j] - of(j) for j in range(3)) / 3

    out, held = model.states(x, keep=True)
    ds, dtrans, _ = pii._crf(model.scores(out), y.T, p["trans"], p["first"])
    dboth = (ds @ p["out"].T).transpose(0, 2, 1)
    dw, _ = pii._lstm_back(np.stack([dboth[:, :4], dboth[::-1, 4:]], axis=1), held, np.concatenate([p["wh"], p["wx"], p["b"][:, :, None]], axis=2))
    for name, slope in (("wh", dw[:, :, :4]), ("wx", dw[:, :, 4:-1]), ("b", dw[:, :, -1]), ("trans", dtrans)):
        for _ in range(4):
            at = tuple(int(rng.integers(n)) for n in p[name].shape)
            held_, step = p[name][at], 1e-2
            p[name][at] = held_ + step
            up = loss()
            p[name][at] = held_ - step
            assert abs((up - loss()) / (2 * step) - slope[at]) < 5e-3
            p[name][at] = held_


def test_pii_odd_rows_and_mask(spark, odd, none, tagger):
    assert pii.find(odd, tagger).count() == odd.count() and pii.find(none, tagger).count() == 0 and pii.fit(none) is not None
    rows = spark.createDataFrame([(1, "mail a.b@c.de or +1 (555) 555-1234 now", 5), (2, None, 7), (3, "clean", 5)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in pii.mask(rows, None).collect()}
    assert got[1].text == "mail <EMAIL> or <PHONE> now" and got[1].n_chars == 27
    assert got[2].text is None and got[2].n_chars == 7 and got[3] == rows.where("doc_id = 3").first()
    assert pii.mask(odd, tagger).columns == odd.columns


def test_op5_digest(spark, sf):
    got = {r.doc_id: r for r in queries.op5_pii(spark, sf).collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        spans = plain_spans(d.text)
        want = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans)
        assert got[d.doc_id].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert (got[d.doc_id].n_email, got[d.doc_id].n_ip, got[d.doc_id].n_card, got[d.doc_id].n_phone) == tuple(sum(k == i for k, _, _ in spans) for i in range(4))
        assert set(want.split(",")) - {""} <= set(got[d.doc_id].spans.split(","))


# ---------------------------------------------------------------- fingerprints


def native(df):
    plan = df._jdf.queryExecution().toString()
    return not re.search("Python|Pandas|Arrow", plan)


def test_fingerprints_do_not_depend_on_order_and_follow_edits(spark):
    a, b, c = "First one, of several words.", "Second here!", "And a third, the last."
    texts = {"p": [a, b, c], "q": [c, a, b], "r": [a, b], "s": [c], "e": [], "t": [a + " ", b, c], "u": [a, b, c, ""]}
    df = spark.createDataFrame([(k, "\n".join(v)) for k, v in texts.items()], "k string, t string")
    prints = multiset.fingerprints(df, ["k"], "t")
    assert native(prints)
    wide = prints.groupBy().pivot("k", sorted(texts)).agg(F.first("f"))
    f = F.col
    out = wide.select((f("p") == f("q")).alias("same"), (multiset.plus(f("r"), f("s")) == f("p")).alias("plus"), (multiset.minus(f("p"), f("s")) == f("r")).alias("minus"), multiset.likeness(f("p"), f("r")).alias("near"), multiset.likeness(f("e"), f("e")).alias("empty"), multiset.likeness(f("e"), f("p")).alias("none"), (f("p")["wide"] == f("t")["wide"]).alias("blank"), (f("p")["wide"] == f("u")["wide"]).alias("line"))
    r = out.first()
    assert r.same and r.plus and r.minus and 0.4 < r.near < 1 and r.empty == 1.0 and r.none == 0.0 and not r.blank and not r.line


def test_an_edit_changes_only_what_it_touches(spark):
    """One character in a long paragraph without line breaks."""
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(4000)]
    rows = [(0, " ".join(words)), (1, " ".join([*words[:9], "x" + words[9], *words[10:]])), (2, "z" * 200_000), (3, None)]
    f = {r.k: r.f for r in multiset.fingerprints(spark.createDataFrame(rows, "k long, t string"), ["k"], "t").collect()}
    assert abs(f[0].phrases - f[1].phrases) <= 1 and f[0].phrases > 500 and f[2].phrases == 1 and f[3].phrases == 0
    assert sum(a != b for a, b in zip(f[0].bits, f[1].bits)) > 0 and sum(abs(a - b) for a, b in zip(f[0].bits, f[1].bits)) <= 2 * 128


def test_op6_against_plain_texts(spark, sf):
    df = queries.op6_fingerprints(spark, sf)
    assert native(df)
    got = {r.doc_id: r for r in df.collect()}
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    apart = []
    for i, (k, t) in enumerate(docs):
        half = len(t) // 2
        nxt = docs[(i + 1) % len(docs)][1]
        edited = t[: len(t) - half] + nxt[:half]
        assert got[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[k].n_chars == len(t)
        assert (got[k].fingerprint == got[k].edited_fingerprint) == (t == edited)
        if len(t) > 500:
            apart.append(got[k].near_edited > got[k].near_next)
    assert np.mean(apart) > 0.95


def test_op6_keeps_every_row(spark, tmp_path, odd, none):
    for i, df in enumerate((odd, none)):
        df.write.parquet(f"{tmp_path}/{i}/documents.parquet")
        out = queries.op6_fingerprints(spark, f"{tmp_path}/{i}").collect()
        assert len(out) == df.count() and all(r.fingerprint is not None and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)


def test_next_row_over_many_ranges(spark, odd, none):
    keys = [(random.Random(i).randrange(10**6) * 3, f"t{i}") for i in range(500)] + [(9, "a"), (9, "b"), (None, "x")]
    df = spark.createDataFrame(keys, "k long, t string")
    got = multiset.with_next(df, "k", ["k", "t"], rows=20).collect()
    assert len(got) == 503 and [r.next for r in got if r.k is None] == [None]
    got = [r for r in got if r.k is not None]
    order = sorted(k for k, _ in keys if k is not None)
    after = {}
    for r in got:
        after.setdefault(r.k, []).append(r.next.k)
    for i, k in enumerate(order[:-1]):
        assert order[i + 1] in after[k]
    assert after[order[-1]] == [order[0]]
    assert multiset.with_next(none, "doc_id", ["text"]).count() == 0
    assert multiset.with_next(odd, "doc_id", ["text"]).count() == odd.count()


# ---------------------------------------------------------------- url filters


def plain_rule(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h), len(p), v, h + p) for h, p, v in rules if rest and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[2] if best else "allow"


def test_urls_against_all_rules(spark):
    rules = [*queries.RULES, ("d.example.com", "", "block"), ("example.com", "/en/7/x", "block"), ("com", "/en/", "allow")]
    parts = ["http://", "ftp://A://", "", "https://WWW."], ["example.com", "a.d.example.com", "com", "notexample.com", "x.net", ".org", "é.Example.NET"], ["", "/", "/en/", "/en/7", "/en/7/x/y", "/de/8#q", "/es?x=/en/", "?a#b", "#://com/en/"]
    found = [(i, a + b + c) for i, (a, b, c) in enumerate((a, b, c) for a in parts[0] for b in parts[1] for c in parts[2])] + [(900, None), (901, "http://com/en/"), (901, "http://com/en/"), (None, "http://com/en/")]
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in found], "page_id long, url string, host string, digest string")
    out = urls.filtered(df, spark.createDataFrame(rules, "host string, path string, verdict string"))
    got = sorted(((r.id, r.host, r.path, r.rule, r.verdict) for r in out.collect()), key=repr)
    assert got == sorted(((i, *plain_rule(u, rules)) for i, u in found), key=repr) and native(out)
    long = "http://" + "a." * 100_000 + "Example.com/en/7" + "x" * 300_000
    began = time.time()
    got = urls.filtered(spark.createDataFrame([(1, long)], "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string")).first()
    assert (got.rule, got.verdict) == ("example.com/en/7", "allow") and time.time() - began < 20
    assert urls.filtered(df.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0
    assert {r.verdict for r in urls.filtered(df, spark.createDataFrame([], "host string, path string, verdict string")).collect()} == {"allow"}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf)
    want = con.sql(queries.SQL[name])
    order = lambda rows, names: sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in rows), key=repr)
    assert order(got.collect(), got.columns) == order(want.fetchall(), want.columns)


# ---------------------------------------------------------------- pipeline


def test_stages_follow_their_contracts(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept[-1], sf)
        assert out.columns == columns
        kept.append(spark.createDataFrame(out.collect(), docs.schema))
    good, lone, private, mixed = kept[1:]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert good.join(labels, "doc_id").where("quality = 0").count() == 0
    clean = docs.join(labels.where("quality = 1"), "doc_id", "left_semi")
    assert good.join(clean, "doc_id", "left_semi").count() > 0.98 * clean.count()
    assert lone.groupBy("text").count().where("count > 1").count() == 0
    assert lone.count() < good.count() and private.count() == lone.count()
    for r in private.select("text").collect():
        assert not plain_spans(r.text)
    assert mixed.select("doc_id").distinct().count() == private.count() <= mixed.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, mixed, sf)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    assert packed.where("start = 0").count() == mixed.count()



def test_pipeline_against_plain_stages(spark):
    """Every stage of the run, decided again document by document in plain loops."""
    from collections import Counter

    from factloom.llm import packing, quality, tokens
    from factloom.llm.common import crc_mod

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"), crc_mod("doc_id", 3) != 1)
    rows = sorted((r.doc_id, r.text, r.source) for r in docs.collect())
    kept = [r for r in rows if model is None or model.score(quality.statistics(r[1])[None])[0] >= 0.5]

    def shingles(t):
        w = t.lower().split()
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, lab = [shingles(t) for _, t, _ in kept], list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n) - 1e-9:
                lab = [min(lab[i], lab[j]) if x in (lab[i], lab[j]) else x for x in lab]
    lone = [kept[i] for i in range(len(kept)) if lab[i] == i]
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, corpus_pipeline.quality_stage(spark, docs, sf), sf).collect()) == [r[0] for r in lone]
    frame = spark.createDataFrame(lone, "doc_id long, text string, source string")
    tagger = pii.fit(frame)
    private = {}
    for k, t, s in lone:
        base = pii.base_spans(t)
        out, done = "", 0
        for kind, a, b in sorted(base + pii.added_spans([t], [base], tagger)[0], key=lambda x: (x[1], x[2], x[0])):
            if a >= done:
                out += t[done:a] + f"<{pii.KINDS[kind].upper()}>"
            done = max(done, b)
        private[k] = out + t[done:]
    assert {r.doc_id: r.text for r in corpus_pipeline.pii_stage(spark, frame, sf).collect()} == private
    encode = tokens.encoder(*tokens.default_files())
    mixed = Counter(r.doc_id for r in corpus_pipeline.mixing_stage(spark, spark.createDataFrame([(k, private[k], s) for k, _, s in lone], "doc_id long, text string, source string"), sf).collect())
    assert set(mixed) == set(private) and max(mixed.values()) <= 2
    packed = corpus_pipeline.run(spark, sf).collect()
    held = Counter()
    for r in packed:
        held[r.doc_id] += r.length
    assert {k: n // (len(encode(private[k])) + 1) for k, n in held.items()} == dict(mixed)
    for r in packed:
        ids = np.array([*encode(private[r.doc_id]), 1], "<u4")[r.start : r.start + r.length]
        assert packing.zlib.crc32(ids) == r.ids_crc32 and len(ids) == r.length
    at = sorted((r.sequence_id, r.offset, r.length) for r in packed)
    assert all(b[1] == (a[1] + a[2] if a[0] == b[0] else 0) for a, b in zip(at, at[1:])) and max(o + n for _, o, n in at) <= 2048


def test_stages_on_odd_and_empty_tables(spark, odd, none):
    sf = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, odd, sf).count()
        assert stage(spark, none, sf).count() == 0
