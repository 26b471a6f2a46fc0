"""Homomorphic multiset fingerprints of documents, in DataFrame functions only.

A text is the multiset of its paragraphs (what stands between line breaks, empty
ones too; an empty text has none).  Each paragraph is hashed to a wide vector: eight
lanes that are uniform in the whole paragraph, and 128 lanes that count, bit by bit,
the hashes of its phrases.  A fingerprint is the sum of its paragraphs' vectors,
lane by lane modulo 2^32.  So it does not depend on the order of paragraphs, and a
paragraph is inserted or deleted by adding or subtracting its vector.  The uniform
lanes tell multisets apart; the products of the counting ones estimate how much two
texts share.

A phrase ends where the text says so (after punctuation, or a word with a rare last
letter), never after a number of characters, so an edit changes only the phrases
that it touches.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Between two phrases of a paragraph: blanks after punctuation, or after a word with one of a few last letters.
BETWEEN = r"(?<=[.!?;:,dgmrty])[ \t]+"
WIDE, BITS = 8, 128
HALF = (1 << 32) - 1
TWO = 1 | 1 << 32


def _sums(word: str, wide: bool) -> list[Column]:
    """Sums over the rows of a group: uniform lanes, or counts of set bits, two to a long."""
    if wide:
        return [F.sum(F.col(f"__{word}{i}")) for i in range(WIDE)]
    return [F.sum(F.shiftrightunsigned(F.col(f"__{word}{h}"), j).bitwiseAND(F.lit(TWO))) for h in range(2) for j in range(32)]


def _word(digest: Column, i: int, digits: int) -> Column:
    """The ``i``-th stretch of hexadecimal ``digits`` of a digest, as a number."""
    return F.conv(F.substring(digest, i * digits + 1, digits), 16, -10).cast("long")


def fingerprints(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(``keys``, f): one row for each group of equal keys, f a struct (phrases,
    paragraphs, wide array<long>, bits array<long>, norm).

    ``keys`` tell rows apart; texts of equal keys are summed as one multiset.  Null
    texts count as empty; the empty multiset has all lanes zero.  Rows are grouped
    without a shuffle if they are already dealt out by some of the keys."""
    lines = F.when(F.coalesce(F.length(text), F.lit(0)) > 0, F.split(F.col(text), "\n", -1))
    parts = rows.select(*keys, F.explode_outer(lines).alias("__p"))
    parts = parts.select(*keys, F.sha2(F.col("__p"), 256).alias("__s"), F.posexplode_outer(F.split("__p", BETWEEN, -1)).alias("__i", "__u"))
    first = F.coalesce(F.col("__i"), F.lit(0)) == 0  # a paragraph's own lanes count once
    parts = parts.select(*keys, "__u", F.when(first, F.col("__s")).alias("__s"), F.md5("__u").alias("__m"))
    parts = parts.select(
        *keys,
        F.col("__u").isNotNull().cast("long").alias("__n"),
        F.col("__s").isNotNull().cast("long").alias("__q"),
        *[_word(F.col("__s"), i, 8).alias(f"__w{i}") for i in range(WIDE)],
        *[_word(F.col("__m"), i, 16).alias(f"__b{i}") for i in range(2)],
    )
    sums = [*_sums("w", True), *_sums("b", False)]
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    named = [zero(c).alias(f"__x{i}") for i, c in enumerate(sums)]
    out = parts.groupBy(*keys).agg(F.sum("__n").alias("__n"), F.sum("__q").alias("__q"), *named)
    wide = F.array(*[F.col(f"__x{i}").bitwiseAND(F.lit(HALF)) for i in range(WIDE)])
    pairs = [F.col(f"__x{WIDE + i}") for i in range(BITS // 2)]
    bits = F.array(*[x.bitwiseAND(F.lit(HALF)) for x in pairs], *[F.shiftrightunsigned(x, 32) for x in pairs])
    out = out.select(*keys, F.col("__n").alias("phrases"), F.col("__q").alias("paragraphs"), wide.alias("wide"), bits.alias("bits"))
    norm = product(F.col("bits"), F.col("phrases"), F.col("bits"), F.col("phrases"))
    return out.select(*keys, F.struct("phrases", "paragraphs", "wide", "bits", norm.alias("norm")).alias("f"))


def product(a: Column, n: Column, b: Column, m: Column) -> Column:
    """Sum over lanes of the products of signed counts (set bits less unset ones)."""
    zero = F.lit(0.0)
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x * 2 - n).cast("double") * (y * 2 - m).cast("double")), zero, lambda s, v: s + v)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: estimated cosine of two multisets of phrases; 1 for equal fingerprints, 0 if one is empty."""
    same = (a["wide"] == b["wide"]) & (a["bits"] == b["bits"])
    dot = product(a["bits"], a["phrases"], b["bits"], b["phrases"])
    norm = F.sqrt(a["norm"]) * F.sqrt(b["norm"])
    return F.when(same, 1.0).when(norm > 0, F.least(F.greatest(dot / norm, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)


def shown(f: Column) -> Column:
    """A fingerprint as text: its lanes in hexadecimal."""
    return F.array_join(F.transform(F.concat(f["wide"], f["bits"]), lambda x: F.lower(F.hex(x))), ".")


def plus(a: Column, b: Column) -> Column:
    """Fingerprint of the union of two multisets (paragraphs inserted)."""
    return _lanewise(a, b, lambda x, y: x + y)


def minus(a: Column, b: Column) -> Column:
    """Fingerprint of the difference of two multisets (paragraphs deleted)."""
    return _lanewise(a, b, lambda x, y: x - y)


def _lanewise(a, b, f):
    phrases, paragraphs = f(a["phrases"], b["phrases"]), f(a["paragraphs"], b["paragraphs"])
    lanes = lambda name: F.zip_with(a[name], b[name], lambda x, y: f(x, y).bitwiseAND(F.lit(HALF)))
    bits = lanes("bits")
    return F.struct(phrases.alias("phrases"), paragraphs.alias("paragraphs"), lanes("wide").alias("wide"), bits.alias("bits"), product(bits, phrases, bits, phrases).alias("norm"))


# ---------------------------------------------------------------- each row's successor


def _bucket(key: Column, bounds: list[int]) -> Column:
    """Number of bounds at or below ``key``, found over two levels."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    upper = F.size(F.filter(longs([g[0] for g in groups]), lambda b: b <= key))
    inner = F.element_at(F.array(*[longs(g) for g in groups]), F.greatest(upper, F.lit(1)))
    return F.when(upper == 0, 0).otherwise((upper - 1) * step + F.size(F.filter(inner, lambda b: b <= key)))


def ranged(docs: DataFrame, key: str, ties: list[str], rows: int = 4_000, most: int = 1 << 17) -> DataFrame:
    """``docs`` dealt out by ranges of ``key``, with columns ``range``, ``place`` (row
    number within the range) and ``copy``: behind each range's end stands a copy of the
    row that follows (after the last: the first), so that windows over ``range`` see
    every row's successor.  Rows of equal keys follow one another by a hash of ``ties``;
    rows whose key is null are dealt out to ranges of their own, which are negative.

    There are at most ``most`` ranges, whose bounds are part of the plan; beyond
    ``most`` x ``rows`` rows they grow, and their sorts spill."""
    spark = docs.sparkSession
    able = docs.where(F.col(key).isNotNull())
    tie = F.xxhash64(*ties)
    count, lost = docs.agg(F.count(key), F.count_if(F.col(key).isNull())).first()
    parts = min(most, -(-count // rows))
    cuts = able.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], min(100 * parts, 1_000_000))).first()[0] if parts > 1 else []
    bounds = sorted(set(cuts))
    placed = able.withColumn("range", _bucket(F.col(key), bounds))
    heads = sorted((r[1], r[0]) for r in placed.groupBy("range").agg(F.min(key)).collect())  # one row for each range
    before = [(h, heads[i - 1][1], i == 0) for i, (h, _) in enumerate(heads)]
    copies = able.join(F.broadcast(spark.createDataFrame(before, "__head long, range int, __wrap boolean")), F.col(key) == F.col("__head"))
    # of rows that share a head, the first by the order of ties: one row for each range
    copies = copies.groupBy("range", "__wrap").agg(F.min_by(F.struct(*docs.columns), tie).alias("__row")).select("__row.*", "range", "__wrap")
    body = placed.select(*docs.columns, "range", F.lit(False).alias("__wrap"), F.lit(False).alias("copy"))
    both = body.union(copies.select(*docs.columns, "range", "__wrap", F.lit(True).alias("copy")))
    if lost:
        alone = F.lit(-1) - F.pmod(tie, F.lit(-(-lost // rows))).cast("int")
        both = both.union(docs.where(F.col(key).isNull()).select(*docs.columns, alone.alias("range"), F.lit(False), F.lit(False)))
    order = Window.partitionBy("range").orderBy("__wrap", key, "copy", tie)
    return both.withColumn("place", F.row_number().over(order)).select(*docs.columns, "range", "place", "copy")


def following(column: str, step: int = 1, *order: str) -> Column:
    """A column of the row ``step`` behind, over the ranges of ``ranged``; null where there is none."""
    window = Window.partitionBy("range").orderBy("place", *order)
    return F.when(F.col("range") >= 0, F.lead(column, step).over(window))


def with_next(docs: DataFrame, key: str, columns: list[str], rows: int = 4_000) -> DataFrame:
    """``docs`` with ``next``: struct of ``columns`` of the row that follows by ``key``
    (after the last: the first).  Rows of equal keys follow one another by their
    hash; rows whose key is null have none and are followed by nothing (null)."""
    both = ranged(docs.withColumn("__next", F.struct(*columns)), key, columns, rows)
    return both.withColumn("next", following("__next")).where("not copy").select(*docs.columns, "next")
