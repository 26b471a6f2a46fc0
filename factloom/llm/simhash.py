"""SimHash near-dedup over a Gray-order hierarchical index.

Fingerprints are sorted by Gray rank, so neighbours share many bits.  An upper
node of the index keeps the bits that all its members share (a value under a
mask).  A search compares two nodes only in bits that their parents did not yet
compare, adds those differences to the parents' and drops the whole pair of
groups once the sum exceeds the limit.

Over a cluster the distinct fingerprints are dealt out by bit blocks: with k
differing bits at most, two of them agree in at least one of k + 1 blocks.  A
group that is still too large is dealt out again by blocks of the bits that are
left, so no task ever gets an unbounded group and no link is lost.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow, sliced, thinned, written
from .components import connected_components

FAN = 8
SEED = 42
LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str | None, size: int = 3) -> np.ndarray:
    """64-bit hashes of the shingles of ``size`` words in order (fewer words: of the whole sequence; none: empty)."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    n = len(words)
    joined = b" ".join(words)
    if n <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)] if n else [], np.uint64)
    length = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(length + 1) - 1
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip((ends - length)[: n - size + 1].tolist(), ends[size - 1 :].tolist())], np.uint64)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of the whole text (unsigned).

    A-Z lower-cased, words cut at ASCII white space, shingles of ``shingle``
    words with repeats; fewer words make one shingle; no words (or null) give 0.
    """
    hashes = shingle_hashes(text, shingle)
    return _majority(hashes) if len(hashes) else 0


def _majority(hashes: np.ndarray) -> int:
    m = len(hashes)
    cuts = np.arange(0, m, 255)
    value = 0
    for j in range(8):  # bit j of each byte; 255 rows fit a byte lane
        lanes = np.add.reduceat((hashes >> np.uint64(j)) & LANES, cuts)
        counts = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
        for byte in np.flatnonzero(counts * 2 > m):
            value |= 1 << (8 * int(byte) + j)
    return value


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp long) per row; fp holds the unsigned value's 64 bits."""

    def run(batches):
        for batch in sliced(batches):
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return arrow(rows, run, "id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each 64-bit value in Gray order."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Hierarchical index over fingerprints in Gray order.

    ``must`` marks bits in which linked fingerprints agree (the dealt block)."""

    def __init__(self, fps: np.ndarray, must: int, limit: int):
        self.limit, self.must = limit, np.uint64(must)
        self.order = np.argsort(gray_rank(fps), kind="stable")
        self.rows = fps[self.order]
        full = np.full(len(fps), np.uint64(0xFFFFFFFFFFFFFFFF))
        self.levels = [(self.rows, full)]
        ones, some = self.rows, self.rows
        while len(ones) > 1:
            at = np.arange(0, len(ones), FAN)
            ones, some = np.bitwise_and.reduceat(ones, at), np.bitwise_or.reduceat(some, at)
            mask = ~(ones ^ some)
            self.levels.append((ones & mask, mask))

    def roots(self) -> np.ndarray:
        """Links all pairs within the limit; per input row the smallest row (in Gray order) of its group."""
        n = len(self.rows)
        lab = np.arange(n)
        top = len(self.levels) - 1
        stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.uint64))]
        while stack:
            level, a, b, acc, seen = stack.pop()
            if level == 0:
                hit = a != b
                _join(lab, a[hit], b[hit])
                continue
            if len(a) > 8192:
                for i in range(0, len(a), 8192):
                    stack.append((level, a[i : i + 8192], b[i : i + 8192], acc[i : i + 8192], seen[i : i + 8192]))
                continue
            if level == 1 and len(a):  # groups that are one already need no look
                keep = ~self._one(lab, a, b)
                a, b, acc, seen = a[keep], b[keep], acc[keep], seen[keep]
            value, mask = self.levels[level - 1]
            size = len(value)
            step = np.arange(FAN)
            ca = np.repeat(a[:, None] * FAN + step, FAN, axis=1).reshape(-1)
            cb = np.tile(b[:, None] * FAN + step, (1, FAN)).reshape(-1)
            from_pair = np.repeat(np.arange(len(a)), FAN * FAN)
            ok = (ca < size) & (cb < size) & (ca <= cb)
            ca, cb, from_pair = ca[ok], cb[ok], from_pair[ok]
            both = mask[ca] & mask[cb]
            new = (value[ca] ^ value[cb]) & both & ~seen[from_pair]
            total = acc[from_pair] + np.bitwise_count(new)
            ok = (total <= self.limit) & ((new & self.must) == 0)
            stack.append((level - 1, ca[ok], cb[ok], total[ok], both[ok]))
        out = np.empty(n, np.int64)
        out[self.order] = self.order[_find(lab, np.arange(n))]
        return out

    def _one(self, lab, a, b):
        step = np.arange(FAN)
        n = len(lab)
        ga = _find(lab, np.minimum(a[:, None] * FAN + step, n - 1).reshape(-1)).reshape(-1, FAN)
        gb = _find(lab, np.minimum(b[:, None] * FAN + step, n - 1).reshape(-1)).reshape(-1, FAN)
        low = np.minimum(ga.min(axis=1), gb.min(axis=1))
        return low == np.maximum(ga.max(axis=1), gb.max(axis=1))


def _find(lab, x):
    root = lab[x]
    while True:
        above = lab[root]
        if np.array_equal(above, root):
            break
        root = above
    lab[x] = root
    return root


def _join(lab, i, j):
    while len(i):
        a, b = _find(lab, i), _find(lab, j)
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        if len(i):
            lab[np.maximum(a, b)] = np.minimum(a, b)


def _blocks(free: int, parts: int) -> list[int]:
    """Masks that cut the bits of ``free`` into ``parts`` blocks, evenly."""
    bits = [i for i in range(63, -1, -1) if free >> i & 1]
    cuts = [round(len(bits) * i / parts) for i in range(parts + 1)]
    return [sum(1 << b for b in bits[cuts[i] : cuts[i + 1]]) for i in range(parts)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _local(limit: int):
    """Links within each dealt group of a partition, as stars: (src, dst) representatives."""

    def run(frames):
        held = list(frames)
        if not held:
            return
        rows = pd.concat(held, ignore_index=True)
        for must, part in rows.groupby("must", sort=False):
            fps = part["fp"].to_numpy(np.int64).view(np.uint64)
            reps = part["rep"].to_numpy(np.int64)
            bits = np.uint64(int(must) & 0xFFFFFFFFFFFFFFFF)
            # the dealt bits lead the order, so that groups lie together
            by = np.argsort(fps & bits, kind="stable")
            fps, reps = fps[by], reps[by]
            turned, turned_must = _lead(fps, int(bits))
            roots = GrayIndex(turned, turned_must, limit).roots()
            apart = roots != np.arange(len(roots))
            if apart.any():
                yield pd.DataFrame({"src": reps[apart], "dst": reps[roots[apart]]})

    return run


def _lead(fps: np.ndarray, must: int) -> tuple[np.ndarray, int]:
    """Moves the bits of ``must`` to the top (Hamming distances stay)."""
    out = np.zeros_like(fps)
    place = 63
    for want in (1, 0):
        for i in range(63, -1, -1):
            if (must >> i & 1) == want:
                out |= ((fps >> np.uint64(i)) & np.uint64(1)) << np.uint64(place)
                place -= 1
    count = bin(must).count("1")
    return out, ((1 << count) - 1) << (64 - count)


def fingerprint_links(distinct: DataFrame, limit: int = 3, largest: int = 1 << 16) -> DataFrame:
    """(src, dst) links between representatives (``rep``) of distinct fingerprints
    (``fp``), enough to join all that are within ``limit`` bits of one another.

    A group that shares a block and has over ``largest`` members is dealt out once
    more by blocks of the bits in which its members differ, again and again; with
    at most ``limit`` such bits it has few members and needs no more dealing."""
    full = (1 << 64) - 1
    masks = F.array(*[F.lit(_signed(m)) for m in _blocks(full, limit + 1)])
    todo = distinct.select("fp", "rep", F.explode(masks).alias("must")).withColumn("part", F.col("fp").bitwiseAND(F.col("must")))
    links = None
    while True:
        groups = todo.groupBy("must", "part").agg(F.count("*").alias("n"), F.bit_or("fp").bitwiseXOR(F.bit_and("fp")).alias("loose"))
        hot = groups.where((F.col("n") > largest) & (F.bit_count("loose") > limit)).select("must", "part", "loose")
        hot = written(hot.mapInPandas(_deeper(limit), "must long, part long, next array<long>"), "hot-blocks")
        done = hot.isEmpty()
        cool = todo if done else todo.join(hot, ["must", "part"], "left_anti")
        got = cool.repartition("must", "part").select("must", "fp", "rep").mapInPandas(_local(limit), "src long, dst long")
        links = got if links is None else links.union(got)
        if done:
            return links
        again = todo.join(hot, ["must", "part"]).select("fp", "rep", F.explode("next").alias("must")).distinct()
        todo = written(again.withColumn("part", F.col("fp").bitwiseAND(F.col("must"))), "dealt-again")


def _deeper(limit: int):
    """Per hot group the masks that it is dealt out by next."""

    def run(frames):
        for f in frames:
            nexts = []
            for must, loose in zip(f["must"].tolist(), f["loose"].tolist()):
                loose &= (1 << 64) - 1
                shared = (must | ~loose) & ((1 << 64) - 1)  # bits in which all members agree
                nexts.append([_signed(shared | b) for b in _blocks(loose, limit + 1)])
            yield pd.DataFrame({"must": f["must"], "part": f["part"], "next": nexts})

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, limit: int = 3, largest: int = 1 << 16) -> DataFrame:
    """One row per input row: (id, fp, component).

    component is the smallest id reachable over links of at most ``limit``
    differing bits.  Texts that are null, empty or blank have fingerprint 0 and
    link like any other.  Repeated rows come out as often as they went in; rows
    whose id is null keep a fingerprint and a null component.  An empty table
    gives an empty result.
    """
    prints = written(fingerprints(docs, id_col, text_col, shingle), "simhash")
    distinct = written(prints.where("id is not null").groupBy("fp").agg(F.min("id").alias("rep")), "simhash-distinct")
    found = connected_components(fingerprint_links(distinct, limit, largest))
    classes = distinct.join(found, distinct.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component"))
    named = prints.where("id is not null").join(classes, "fp").select("id", "fp", "component")
    return named.union(prints.where("id is null").select("id", "fp", F.lit(None).cast("long").alias("component")))


# ---------------------------------------------------------------- near copies of whole texts

SKETCH = 1024  # shingles that a sketch holds; texts with no more are judged by all of theirs
POSTED = 128  # of these, the ones that posting lists of long texts are made from
WHOLE = 512  # shingles up to which a text is posted by all of them, with no slack for sampling
DEVIATIONS = 5  # standard deviations of a sampled likeness; one in a few millions lies further off
CENTRES = 8  # members of each posting list that all its others are compared with first
COMMON = 50_000  # shingles at most that a sample names as common; they only move to the end of the order


def five_words(hashes: np.ndarray) -> np.ndarray:
    """The set of 5-word shingles, as ascending 64-bit hashes, from those of the 3-word ones.

    Two 3-word shingles two words apart make a 5-word one; fewer words make one of the
    whole sequence."""
    if len(hashes) > 2:
        five = (hashes[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ ((hashes[2:] << np.uint64(31)) | (hashes[2:] >> np.uint64(33)))
    else:
        five = hashes[:1] * np.uint64(0x9E3779B97F4A7C15) if len(hashes) < 2 else (hashes[:1] ^ (hashes[1:] << np.uint64(1)))
    return np.unique(five * np.uint64(0xC2B2AE3D27D4EB4F))


def sketch(five: np.ndarray) -> np.ndarray:
    """The upper halves of the smallest hashes, at most SKETCH, ascending."""
    return np.unique((five[: 2 * SKETCH] >> np.uint64(32)).astype(np.uint32))[:SKETCH]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of common shingles of two whole sets (ascending); two empty ones are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def judged(a: np.ndarray, b: np.ndarray, similarity: float) -> int:
    """Whether two texts are alike, by their sketches: 1 yes, 0 no, -1 not settled.

    Sketches below SKETCH are whole sets and settle all but ties (two of 32-bit hashes
    may meet); others settle what lies DEVIATIONS standard deviations off ``similarity``."""
    if not len(a) or not len(b):
        return int(len(a) == len(b))
    sampled = len(a) >= SKETCH or len(b) >= SKETCH
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    same = a[at] == b
    shared = int(np.count_nonzero(same))
    n = len(a) + len(b) - shared
    if sampled and n > SKETCH:  # of the union only its smallest are a fair sample
        last = np.partition(np.concatenate([a, b[~same]]), SKETCH - 1)[SKETCH - 1]
        shared, n = int(np.count_nonzero(same & (b <= last))), SKETCH
    if not sampled:
        return int(by_shared(shared, len(a) + len(b), similarity))
    off = shared - similarity * n
    return -1 if abs(off) <= DEVIATIONS * np.sqrt(similarity * (1 - similarity) * n) and shared < n else int(off > 0)


def by_shared(shared, sizes, similarity: float):
    """``judged`` for whole sets (or arrays of pairs of them) that share so many of their
    ``sizes`` together."""
    n = sizes - shared
    off = shared - similarity * n
    return np.where((np.abs(off) <= 2.0) & (shared < n), -1, off > 0)


def least_shared(size: int, n: int, similarity: float) -> int:
    """How many of the POSTED smallest of its ``n`` shingles (``size`` of them) a text shares
    at least with any text alike.

    Texts alike share that part of the larger set; where a set is sampled, all but a few
    millionths of the pairs share what lies DEVIATIONS below it."""
    least = int(np.ceil(similarity * size - 1e-9))
    if n > POSTED * similarity:  # may meet a set that is sampled
        spread = DEVIATIONS * np.sqrt(similarity * (1 - similarity) / POSTED)
        least = max(1, min(least, int(POSTED * (similarity - spread))))
    return least


def leading(held: np.ndarray, n: int, common: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a sketch, as many as any text alike must share one of.

    ``held``: the POSTED smallest of a text's ``n`` shingles.  Sets that share m have a
    shared one among their first size - m + 1, whatever order all sets are put in.
    ``common`` (ascending) holds the shingles that come last in the order and their
    rank; others go by value."""
    size = len(held)
    if not size:
        return held
    return _ordered(held, common)[: size - least_shared(size, n, similarity) + 1]


def _ordered(held: np.ndarray, common: np.ndarray) -> np.ndarray:
    if not len(common) or not len(held):
        return held
    at = np.minimum(np.searchsorted(common["key"], held), len(common) - 1)
    late = common["key"][at] == held
    return np.r_[held[~late], held[late][np.argsort(common["rank"][at[late]], kind="stable")]]


def posting(held: np.ndarray, n: int, common: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys that a text of ``n`` shingles (``held``: its sketch) is posted under, and for each
    the size of the largest text that may be alike and share no earlier key.

    Pairs of at most WHOLE shingles meet by their whole sets: what two texts share from place p
    of one's order on is n - p at most, and must be similarity / (1 + similarity) of both
    sizes.  Others meet by the POSTED smallest, under keys of their own (from 2 ** 32 on)."""
    keys, caps = [], []
    if n <= WHOLE:
        first = _ordered(held, common)[: n - int(np.ceil(similarity * n - 1e-9)) + 1]
        keys.append(first.astype(np.int64))
        caps.append(np.floor((n - np.arange(len(first))) * (1 + similarity) / similarity - n + 1e-6).astype(np.int64))
    if n > WHOLE * similarity - 1:
        first = leading(held[:POSTED], n, common, similarity)
        keys.append(first.astype(np.int64) + (1 << 32))
        caps.append(np.full(len(first), int(n / similarity) + 1, np.int64))
    return np.concatenate(keys), np.concatenate(caps)


def _common(rows: DataFrame, most: int = COMMON, most_docs: int = 20_000) -> np.ndarray:
    """(key, rank) of shingles that several of about ``most_docs`` sketches hold, the commonest with the highest rank.

    Only the order of the shingles depends on it, never which pairs are found."""

    def run(batches):
        for batch in sliced(batches):
            held = [np.frombuffer(x.as_py(), np.uint32)[:WHOLE] for x in batch.column(0)]
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(counts.astype(np.int64))], names=["key", "n"])

    found = arrow(thinned(rows, "row", most_docs).select("sketch"), run, "key long, n long")
    top = found.groupBy("key").agg(F.sum("n").alias("n")).where("n > 2").orderBy(F.desc("n"), "key").limit(most).toPandas()
    out = np.zeros(len(top), [("key", np.uint32), ("rank", np.int64)])
    out["key"], out["rank"] = top["key"].to_numpy(np.int64), np.arange(len(top), 0, -1)
    return np.sort(out, order="key")


def _whole_sets(docs: DataFrame, rows: DataFrame, needed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rep, five): whole shingle sets of the texts that ``needed`` (rep) names, from the texts themselves."""

    def run(batches):
        for batch in sliced(batches):
            held = [five_words(shingle_hashes(t.as_py())).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.binary())], names=["rep", "five"])

    # a table of its own, so that its size decides how it is joined
    asked = written(rows.join(needed, F.col("row") == F.col("rep"), "left_semi").select(F.col("row").alias("rep"), F.col("id").alias("asked_id"), F.col("digest").alias("asked_digest")), "near-copies-asked")
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("digest"))
    texts = texts.join(asked, (F.col("id") == F.col("asked_id")) & (F.col("digest") == F.col("asked_digest"))).select("rep", "text")
    return arrow(texts, run, "rep long, five binary").dropDuplicates(["rep"])


def _settled(pairs: DataFrame, rows: DataFrame, docs: DataFrame, similarity: float, id_col: str, text_col: str, tag: str) -> DataFrame:
    """The pairs (src, dst) that are alike: by their sketches, and where these do not
    settle it by their texts' whole shingle sets."""

    def by_sketch(batches):
        for batch in sliced(batches):
            a, b = batch.column(1), batch.column(3)
            v = np.array([judged(np.frombuffer(x.as_py(), np.uint32), np.frombuffer(y.as_py(), np.uint32), similarity) for x, y in zip(a, b)], np.int32)
            ok = pa.array(v != 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(2).filter(ok), pa.array(v[v != 0])], names=["src", "dst", "settled"])

    pairs = written(pairs, f"{tag}-pairs")
    ends = lambda p: p.select(F.explode(F.array("src", "dst")).alias("rep")).distinct()
    needed = written(ends(pairs), f"{tag}-ends")
    held = rows.join(needed, F.col("row") == F.col("rep"), "left_semi").select(F.col("row").alias("rep"), "sketch")
    of = lambda part, name, what: part.select(F.col("rep").alias(name), F.col(what).alias(f"{what}_{name}"))
    shown = pairs.join(of(held, "src", "sketch"), "src").join(of(held, "dst", "sketch"), "dst")
    told = written(arrow(shown.select("src", "sketch_src", "dst", "sketch_dst"), by_sketch, "src long, dst long, settled int"), f"{tag}-told")
    links = told.where("settled = 1").select("src", "dst")
    return links.union(_exact(told.where("settled < 0").select("src", "dst"), rows, docs, similarity, id_col, text_col, tag))


def _exact(pairs: DataFrame, rows: DataFrame, docs: DataFrame, similarity: float, id_col: str, text_col: str, tag: str) -> DataFrame:
    """The pairs (src, dst) that are alike by their texts' whole shingle sets."""

    def by_text(batches):
        for batch in sliced(batches, 64):
            a, b = batch.column(1), batch.column(3)
            ok = pa.array([likeness(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) >= similarity - 1e-12 for x, y in zip(a, b)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(2).filter(ok)], names=["src", "dst"])

    if pairs.isEmpty():
        return pairs
    needed = written(pairs.select(F.explode(F.array("src", "dst")).alias("rep")).distinct(), f"{tag}-asked")
    sets = written(_whole_sets(docs, rows, needed, id_col, text_col), f"{tag}-sets")
    of = lambda name: sets.select(F.col("rep").alias(name), F.col("five").alias(f"five_{name}"))
    shown = pairs.join(of("src"), "src").join(of("dst"), "dst")
    return written(arrow(shown.select("src", "five_src", "dst", "five_dst"), by_text, "src long, dst long"), f"{tag}-links")


FEW = 32  # owners up to which a shingle's pairs are listed; others go into a matrix product


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many members each two of the sets have in common; [i, j] holds for j < i only.

    Most shingles have few owners, whose pairs are fewer than the cells of a matrix product."""
    n, shared = len(sets), np.zeros((len(sets), len(sets)))
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    by = np.argsort(column, kind="stable")
    owner, column = owner[by], column[by]
    width = counts[column]
    for k in np.unique(counts[(counts > 1) & (counts <= FEW)]).tolist():
        less, more = np.triu_indices(k, 1)
        owners = owner[width == k].reshape(-1, k)
        step = max(1, (1 << 20) // len(less))
        for at in range(0, len(owners), step):
            part = owners[at : at + step]
            shared += np.bincount((part[:, more] * n + part[:, less]).ravel(), minlength=n * n).reshape(n, n)
    dense, owner = (np.cumsum(counts > FEW) - 1)[column[width > FEW]], owner[width > FEW]
    for start in range(0, int(dense[-1]) + 1 if len(dense) else 0, 2048):
        lo, hi = np.searchsorted(dense, [start, start + 2048])
        x = np.zeros((n, min(2048, int(dense[-1]) + 1 - start)), np.float32)
        x[owner[lo:hi], dense[lo:hi] - start] = 1
        shared += x @ x.T
    return shared


def _tile(similarity: float):
    """Links of one tile of a posting list, (src, dst, settled), enough to join all pairs
    of different components that are alike, and the pairs that sketches do not settle.
    A tile off the diagonal compares its two chunks only.  Pairs of whole sets are judged
    by what they share, counted for the tile at once; where a set is sampled, pairs that
    share enough of their posted shingles are judged one by one."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        held = [np.frombuffer(x, np.uint32) for x in pdf["sketch"]]
        reps, chunk = pdf["rep"].to_numpy(np.int64), pdf["chunk"].to_numpy(np.int64)
        lab = np.unique(pdf["component"].to_numpy(np.int64), return_inverse=True)[1]
        cap = pdf["cap"].to_numpy(np.float64) if "cap" in pdf else np.full(len(pdf), np.inf)
        n, size = pdf["n"].to_numpy(np.float64), np.array([len(x) for x in held])
        whole = size < SKETCH
        shared = _shared([x if w else x[:0] for x, w in zip(held, whole)])
        if not whole.all():
            posted = [x[:POSTED] for x in held]
            shared_posted, least = _shared(posted), np.array([least_shared(len(x), k, similarity) for x, k in zip(posted, pdf["n"].tolist())])
        off = pdf["lo"].iloc[0] != pdf["hi"].iloc[0]
        out = []
        for i in range(len(held)):
            fit = (lab[:i] != lab[i]) & (np.minimum(n[i], n[:i]) >= np.maximum(n[i], n[:i]) * similarity - 1e-9) & (n[:i] <= cap[i]) & (n[i] <= cap[:i])
            if off:
                fit &= chunk[:i] != chunk[i]
            told = by_shared(shared[i, :i], size[i] + size[:i], similarity)
            sampled = np.zeros(i, bool) if whole.all() else ~(whole[:i] & whole[i])
            if sampled.any():
                fit &= ~sampled | (shared_posted[i, :i] >= np.minimum(least[i], least[:i]))
            for j in np.flatnonzero(fit & (sampled | (told != 0))).tolist():
                if lab[i] != lab[j] and (say := judged(held[i], held[j], similarity) if sampled[j] else int(told[j])):
                    out.append((reps[i], reps[j], say))
                    if say > 0:
                        lab[lab == lab[i]] = lab[j]
        return pd.DataFrame(out, columns=["src", "dst", "settled"], dtype=np.int64)

    return run


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, limit: int = 3, chunk: int = 512) -> DataFrame:
    """One row per input row with an id: (id, digest, component, group), digest being the
    xxhash64 of its text and group a number of the component's own (where an id has
    several texts, two components may have the same smallest id).

    Two texts are linked if they share ``similarity`` of their 5-word shingles;
    component is the smallest id reachable over links.  Texts whose SimHash fingerprints
    lie within ``limit`` bits come from the Gray-order index and are judged first, which
    joins most copies.  What such fingerprints miss comes from posting lists of the
    texts' leading shingles, which name every pair that can be alike (of texts with over
    POSTED shingles, all but a few in a million).  Only lists that are not one component
    yet are looked into: their members are judged against the first few (by hash), which
    joins large groups at a linear cost, and then, if still apart, against each other in
    tiles of ``chunk`` by ``chunk`` members.  A pair is judged by whole shingle sets, or by
    sketches where these leave no doubt.  Texts without words are copies of each other;
    repeated rows come out as often as they went in; rows of null id are left out."""

    def run(batches):
        part, row = TaskContext.get().partitionId() << 40, 0
        for batch in sliced(batches):
            out = []
            for t in batch.column(1):
                three = shingle_hashes(t.as_py())
                five = five_words(three)
                fp = _majority(three) if len(three) else 0
                out.append((part + row, xxhash.xxh3_128_digest(five.tobytes()), fp - (1 << 64) if fp >> 63 else fp, len(five), sketch(five).tobytes()))
                row += 1
            columns = [pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], names=names)

    names = ["id", "digest", "row", "same", "fp", "n", "sketch"]
    text = F.col(text_col).cast("string")
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("digest"))
    rows = written(arrow(rows, run, "id long, digest long, row long, same binary, fp long, n long, sketch binary"), "near-copies")
    common = _common(rows)

    def posted(batches):
        for batch in sliced(batches):
            first = [posting(np.frombuffer(x.as_py(), np.uint32), n, common, similarity) for x, n in zip(batch.column(5), batch.column(4).to_pylist())]
            keys, caps = (pa.array(c, pa.list_(pa.int64())) for c in zip(*first))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], keys, caps], names=["row", "id", "same", "fp", "n", "keys", "caps"])

    # texts of equal shingle sets are one from here on; an id may come with several texts
    keyed = arrow(rows.select("row", "id", "same", "fp", "n", "sketch"), posted, "row long, id long, same binary, fp long, n long, keys array<long>, caps array<long>")
    distinct = written(keyed.groupBy("same").agg(F.min("row").alias("rep"), F.min("id").alias("id"), F.min("fp").alias("fp"), F.min("n").alias("n"), F.first(F.arrays_zip("keys", "caps")).alias("keys")), "near-copies-distinct")
    settled = lambda pairs, tag: _settled(pairs, rows, docs, similarity, id_col, text_col, f"near-copies-{tag}")

    # the fingerprints' index: every text against the first of its group
    prints = written(distinct.groupBy("fp").agg(F.min("rep").alias("rep")), "near-copies-prints")
    equal = distinct.select("fp", "rep").join(prints.select("fp", F.col("rep").alias("first")), "fp").where("rep <> first").select(F.col("rep").alias("src"), F.col("first").alias("dst"))
    alike = fingerprint_links(prints, limit).union(equal).distinct()
    links = written(settled(alike, "prints"), "near-copies-links")
    found = connected_components(links)

    # posting lists, without those whose sizes fit no other member; of lists with the same
    # members the first in order is enough: the room that keys leave falls with their place
    held = distinct.select("rep", "n", F.explode("keys").alias("k")).select("rep", "n", F.col("k.keys").alias("key"), F.col("k.caps").alias("cap"))
    sizes = held.groupBy("key").agg(F.count("*").alias("docs"), F.min("n").alias("least"), F.max("cap").alias("most")).where("docs > 1 and least <= most").drop("docs")
    held = written(held.join(sizes, "key").where("cap >= least and n <= most").drop("least", "most"), "near-copies-fitting")
    shared = held.groupBy("key").agg(F.count("*").alias("docs"), F.sum("cap").alias("room"), F.bit_xor(F.xxhash64("rep")).alias("mark"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("other"))
    shared = shared.where("docs > 1").groupBy("docs", "mark", "other").agg(F.max(F.struct("room", "key")).alias("first")).select("first.key", "docs")
    lists = written(held.join(shared, "key"), "near-copies-lists")

    def open_lists(lists, found):
        """Members (key, rep, n, cap, docs, component) of the lists that are not in one component."""
        named = lists.join(found, F.col("rep") == F.col("node"), "left").select("key", "rep", "n", "cap", "docs", F.coalesce("component", "rep").alias("component"))
        apart = named.groupBy("key").agg(F.min("component").alias("one"), F.max("component").alias("other_one")).where("one <> other_one").select("key")
        return named.join(apart, "key")

    lists = written(open_lists(lists, found), "near-copies-open")
    by = Window.partitionBy("key").orderBy(F.xxhash64("rep"), "rep")
    centres = written(lists.select("key", "rep", "n", "cap", "component", F.row_number().over(by).alias("place")).where(F.col("place") <= CENTRES).drop("place"), "near-copies-centres")
    n, m = F.col("a.n"), F.col("b.n")
    met = lists.alias("a").join(centres.alias("b"), F.col("a.key") == F.col("b.key")).where((F.col("a.component") != F.col("b.component")) & (F.least(n, m) >= F.greatest(n, m) * similarity - 1e-9) & (n <= F.col("b.cap")) & (m <= F.col("a.cap")))
    pairs = met.select(F.greatest("a.rep", "b.rep").alias("src"), F.least("a.rep", "b.rep").alias("dst")).distinct()
    links = written(links.union(settled(pairs, "centres")), "near-copies-links")
    found = connected_components(links)

    # lists of at most CENTRES + 1 members have had all their pairs judged
    still = open_lists(lists.where(F.col("docs") > CENTRES + 1).drop("component"), found)
    chunks = F.ceil(F.col("docs") / chunk)
    dealt = written(still.withColumn("chunk", F.pmod(F.xxhash64(F.lit(2), "rep"), chunks)), "near-copies-still")
    if not dealt.isEmpty():
        needed = written(dealt.select("rep").distinct(), "near-copies-needed")
        sketches = rows.join(needed, F.col("row") == F.col("rep"), "left_semi").select(F.col("row").alias("rep"), "sketch")
        tiles = dealt.withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)))
        tiles = tiles.select("key", "rep", "n", "cap", "component", "chunk", F.least("chunk", "to").alias("lo"), F.greatest("chunk", "to").alias("hi")).join(sketches, "rep")
        told = written(tiles.groupBy("key", "lo", "hi").applyInPandas(_tile(similarity), "src long, dst long, settled long").distinct(), "near-copies-tiles")
        doubt = told.where("settled < 0").select("src", "dst")
        links = links.union(told.where("settled > 0").select("src", "dst")).union(_exact(doubt, rows, docs, similarity, id_col, text_col, "near-copies-tiles"))
        found = connected_components(links)
    grouped = distinct.select("same", "rep", "id").join(found, F.col("rep") == F.col("node"), "left").select("same", "id", F.coalesce("component", "rep").alias("group"))
    least = grouped.groupBy("group").agg(F.min("id").alias("component"))
    classes = grouped.drop("id").join(least, "group")
    return rows.select("id", "digest", "same").join(classes, "same").select("id", "digest", "component", "group")


def hex_digits(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
