"""The queries op1 to op13 and their SQL, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import embeddings, exact, mixing, multiset, negatives, packing, periodic, pii, quality, simhash, tokens, toxicity, urls
from .common import crc_mod, table, written


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = simhash.near_duplicates(docs, shingle=3, limit=3)
    return found.select(F.col("id").alias("doc_id"), simhash.hex_digits().alias("fingerprint"), F.col("component").alias("component_id"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 3) != 1)
    scored = quality.score(docs, model).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), capacity=2048).withColumnRenamed("id", "doc_id")


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), limit=0.93)
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.fit(docs))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(F.col("id").alias("doc_id"), *[count(k) for k in pii.KINDS], F.sha2(line("base"), 256).alias("base_sha256"), line("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row of null id has no next document: only its first half is left of its edited text.

    Texts are shuffled once, by ranges of ids; both texts' fingerprints, and the next
    document's, are worked out where the text then lies."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    placed = multiset.ranged(docs, "doc_id", ["text"]).withColumn("next", multiset.following("text"))
    n = F.length("text").cast("long")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("text", (n - half).cast("int")), F.left(F.coalesce("next", F.lit("")), half))
    texts = placed.select("range", "place", "copy", "doc_id", n.alias("n_chars"), "text", F.when(~F.col("copy"), edited).alias("edited"))
    texts = texts.withColumn("edited_sha256", F.sha2("edited", 256))
    own = F.struct(F.lit(0).alias("which"), F.col("text"))
    both = F.when(F.col("copy"), F.array(own)).otherwise(F.array(own, F.struct(F.lit(1).alias("which"), F.col("edited").alias("text"))))
    keys = ["range", "place", "copy", "doc_id", "n_chars", "edited_sha256", "which"]
    texts = texts.select(*keys[:-1], F.inline(both))
    prints = multiset.fingerprints(texts, keys, "text")
    prints = prints.withColumns({"e": F.lead("f").over(Window.partitionBy("range").orderBy("place", "which")), "g": multiset.following("f", 2, "which")})
    f, e, g = F.col("f"), F.col("e"), F.col("g")
    return prints.where("which = 0 and not copy").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        multiset.shown(f).alias("fingerprint"),
        multiset.shown(e).alias("edited_fingerprint"),
        multiset.likeness(f, e).alias("near_edited"),
        F.coalesce(multiset.likeness(f, g), F.lit(0.0)).alias("near_next"),
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edits a document: words put in front of its middle, 40 characters cut
    out of its first third, and a line added at its end."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.length(F.coalesce("text", F.lit(""))).cast("long")
    edit = lambda start, removed, inserted: F.struct(start.cast("long").alias("start"), F.lit(removed).cast("long").alias("removed"), inserted.alias("inserted"))
    edits = F.array(
        edit(F.floor(n / 2), 0, F.concat(F.lit(" edited "), F.col("doc_id").cast("string"))),
        edit(F.floor(n / 3), 40, F.lit("")),
        edit(n * 2, 0, F.lit("\nThe end.")),
    )
    return tokens.edited_counts(docs.withColumn("edits", edits)).withColumnRenamed("id", "doc_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    counted = written(tokens.count_tokens(docs).drop("text"), "mixing-tokens")
    return mixing.mix(counted, "n_tokens", evenness=0.5, most_passes=2.0)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 4) != 2)
    scored = toxicity.score(docs, model).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    found = urls.filtered(table(spark, sf_dir, "pages"), rules)
    return found.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def repeating(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in a tenth of the documents, by crc32 of the id, the words from one
    place on are repetitions of the first few of them."""
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"))
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))
    rows = rows.withColumn("w", words).withColumn("n", F.size("w").cast("long"))
    n, g, a, p = (F.col(c) for c in "ngap")
    rows = rows.withColumn("a", F.when(n > 0, g % n)).withColumn("p", 1 + F.floor((n - a) / (3 + g % 8)))
    place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
    again = F.array_join(F.transform("w", lambda w, i: F.get("w", place(i))), " ")
    return rows.select("doc_id", F.when(n > 0, again).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(repeating(table(spark, sf_dir, "documents")))
    top = F.col("strongest")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return found.select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        top["start"].alias("start"),
        top["length"].alias("length"),
        top["period"].alias("period"),
        F.floor(1000 * top["length"] / top["period"]).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose id is divisible by 7 bear a wrong label."""
    vec = F.col("vec_id")
    label = F.when(vec % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), vec % 100 == 0, label=label)


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.find_copies(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha256").alias("text_sha256"))


OP12_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS k, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
), e AS (
  SELECT k, vec_id, label, list_transform(x, lambda c: floor(256 * c)) AS e FROM v
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), scores AS (
  SELECT a.k AS a, a.vec_id AS anchor_id, b.k AS b, b.vec_id AS other_id, a.label = b.label AS same, CASE WHEN len(a.e) = 0 THEN 0 ELSE CAST(list_inner_product(a.e, b.e) AS BIGINT) END AS s
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.k <> b.k AND len(a.e) = len(b.e)
), pos AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, other_id, b) AS place FROM scores WHERE same) WHERE place <= 5
), neg AS (
  SELECT p.anchor_id, p.other_id AS positive_id, n.other_id AS negative_id, p.s AS positive_score, n.s AS negative_score,
         row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.other_id, n.b) AS rank
  FROM pos p JOIN scores n ON n.a = p.a AND NOT n.same AND 30 * p.s <= 100 * n.s AND 100 * n.s <= 90 * p.s
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 10
"""

OP13_SQL = """
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST)
"""

OP10_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), hits AS (
  SELECT p.page_id, p.host, p.path, r.rule_host || r.rule_path AS rule, r.rule_verdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule_host) DESC NULLS LAST, length(r.rule_path) DESC) AS place
  FROM parts p LEFT JOIN rules r
    ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
)
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM hits WHERE place = 1
"""

OP4_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), able AS (
  SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(e, lambda x: abs(x))) > 0
), links AS (
  SELECT a.vec_id AS src, b.vec_id AS dst FROM able a JOIN able b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), walk(node, top) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT w.node, l.dst FROM walk w JOIN links l ON w.top = l.src
), least_ AS (SELECT node, min(top) AS component_id FROM walk GROUP BY node),
counted AS (SELECT src, count(*) AS n FROM links GROUP BY src)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN least_ ON node = vec_id LEFT JOIN counted ON src = vec_id
"""


def _op6_sql() -> str:
    """Sums of the lanes in SQL: paragraphs by SHA-256, phrases by MD5."""
    word = lambda digest, i, digits: f"CAST('0x' || substr({digest}, {i * digits + 1}, {digits}) AS UBIGINT)"
    wide = ", ".join(f"CAST(sum({word('sha256(p)', i, 8)}) % 4294967296 AS BIGINT)" for i in range(multiset.WIDE))
    places = [(h, j + up) for up in (0, 32) for h in range(2) for j in range(32)]
    bits = ", ".join(f"CAST(sum((b{h} >> {j}) & 1) AS BIGINT)" for h, j in places)
    none = lambda n: f"list_transform(range({n}), lambda x: CAST(0 AS BIGINT))"
    dot = lambda a, b: f"list_sum(list_transform(list_zip({a}.bits, {b}.bits), lambda z: CAST(z[1] * 2 - {a}.n AS DOUBLE) * CAST(z[2] * 2 - {b}.n AS DOUBLE)))"
    like = lambda a, b: f"CASE WHEN {a}.wide = {b}.wide AND {a}.bits = {b}.bits THEN 1.0 WHEN sqrt({dot(a, a)}) * sqrt({dot(b, b)}) > 0 THEN least(greatest({dot(a, b)} / (sqrt({dot(a, a)}) * sqrt({dot(b, b)})), 0.0), 1.0) ELSE 0.0 END"
    hex_ = lambda f: f"array_to_string(list_transform(list_concat({f}.wide, {f}.bits), lambda x: lower(to_hex(x))), '.')"
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id) AS k, count(*) OVER () AS total FROM documents
), t AS (
  SELECT d.doc_id, d.k, length(d.text) AS n_chars, d.text, left(d.text, length(d.text) - length(d.text) // 2) || left(x.text, length(d.text) // 2) AS edited, x.k AS after
  FROM d JOIN d x ON x.k = d.k % d.total + 1
), texts AS (
  SELECT k, 0 AS which, text AS t FROM t UNION ALL SELECT k, 1, edited FROM t
), paragraphs AS (
  SELECT k, which, unnest(string_split(t, chr(10))) AS p FROM texts WHERE t <> ''
), phrases AS (
  SELECT k, which, unnest(string_split(regexp_replace(p, '([.!?;:,dgmrty])[ \\t]+', '\\1' || chr(1), 'g'), chr(1))) AS u FROM paragraphs
), words AS (
  SELECT k, which, {word("md5(u)", 0, 16)} AS b0, {word("md5(u)", 1, 16)} AS b1 FROM phrases
), w AS (SELECT k, which, [{wide}] AS wide FROM paragraphs GROUP BY k, which),
b AS (SELECT k, which, count(*) AS n, [{bits}] AS bits FROM words GROUP BY k, which),
f AS (SELECT x.k, x.which, coalesce(n, 0) AS n, coalesce(wide, {none(multiset.WIDE)}) AS wide, coalesce(bits, {none(multiset.BITS)}) AS bits FROM texts x LEFT JOIN w USING (k, which) LEFT JOIN b USING (k, which))
SELECT t.doc_id, t.n_chars, sha256(t.edited) AS edited_sha256, {hex_("f")} AS fingerprint, {hex_("e")} AS edited_fingerprint, {like("f", "e")} AS near_edited, {like("f", "g")} AS near_next
FROM t JOIN f ON f.k = t.k AND f.which = 0 JOIN f e ON e.k = t.k AND e.which = 1 JOIN f g ON g.k = t.after AND g.which = 0
"""


QUERIES = {
    "op1_simhash": op1_simhash,
    "op10_url_filters": op10_url_filters,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_exact_dedup": op13_exact_dedup,
    "op2_quality": op2_quality,
    "op3_packing": op3_packing,
    "op4_embeddings": op4_embeddings,
    "op5_pii": op5_pii,
    "op6_fingerprints": op6_fingerprints,
    "op7_token_counts": op7_token_counts,
    "op8_mixing": op8_mixing,
    "op9_toxicity": op9_toxicity,
}
SQL: dict[str, str] = {"op4_embeddings": OP4_SQL, "op6_fingerprints": _op6_sql(), "op10_url_filters": OP10_SQL, "op12_hard_negatives": OP12_SQL, "op13_exact_dedup": OP13_SQL}
