"""Runs: stretches of words that repeat with a period, found by block matching.

A run of period q and length of at least max(24, 3 q) holds, whatever its place, a whole
block [k L, (k + 1) L) of some power of two L whose copy at distance q is in the run as well:
L = 8 for q < 16, else the largest power of two that q reaches.  So for each L the aligned
blocks are keys of an Aho-Corasick automaton over word numbers, which is searched over the
text; a block and a copy of it at a distance that fits L seed an exact extension to both
sides.  Whatever grows to the length asked for, and has no smaller period, is a run.

Only stretches in which every eight words come again somewhere in the text can be part of a
run; the others are left out first.
"""

from __future__ import annotations

import re
from fractions import Fraction

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, sliced

BLOCK, LEAST, TIMES, WINDOW = 8, 24, 3, 1 << 16
SPACE = re.compile(rb"[\x20\x09-\x0d]")
RUN = "array<struct<start:long,length:long,period:long>>"


def numbered(text: bytes) -> tuple[np.ndarray, list[bytes]]:
    """Words (what ASCII white space parts) as numbers, and the words of the numbers.

    The text is split piece by piece, so that only its different words are held at once."""
    known: dict[bytes, int] = {}
    parts, at, n = [], 0, len(text)
    while at < n:
        end = min(at + (1 << 20), n)
        if end < n and (gap := SPACE.search(text, end)):
            end = gap.start()
        elif end < n:
            end = n
        words = text[at:end].split()
        parts.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)))
        at = end
    return (np.concatenate(parts) if parts else np.zeros(0, np.int64)), list(known)


def suspects(ids: np.ndarray) -> list[tuple[int, int]]:
    """Stretches [start, end) of at least LEAST words in which all of each BLOCK words come
    again in the text.  They hold every run; a hash that collides only adds to them."""
    n = len(ids) - BLOCK + 1
    if n < LEAST - BLOCK + 1:
        return []
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    h = np.zeros(n, np.uint64)
    for k in range(BLOCK):
        h = h * np.uint64(0xD1342543DE82EF95) + mixed[k : k + n]
    order = np.argsort(h, kind="stable")
    s = h[order]
    twin = np.zeros(n, bool)
    same = s[1:] == s[:-1]
    twin[order[1:][same]] = True
    twin[order[:-1][same]] = True
    edges = np.flatnonzero(np.diff(np.r_[False, twin, False].astype(np.int8)))
    return [(int(a), int(b) + BLOCK - 1) for a, b in zip(edges[::2], edges[1::2]) if b - a >= LEAST - BLOCK + 1]


def _seeds(ids: np.ndarray, size: int) -> np.ndarray:
    """(distance, place) of aligned blocks of ``size`` words and their copies at a distance
    that fits the size, in that order."""
    least, most, n = (1 if size == BLOCK else size), 2 * size, len(ids)
    out = []
    span = max(WINDOW, 4 * size) // size * size
    for base in range(0, n - size + 1, span):  # keys of one window at a time, which bounds the automaton
        end = min(base + span + most, n)
        text = tuple(ids[base:end].tolist())
        tree = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        blocks = []
        for at in range(0, min(span, len(text)) - size + 1, size):
            block = text[at : at + size]
            key = tree.get(block, -1)
            if key < 0:
                key = len(tree)
                tree.add_word(block, key)
            blocks.append(key)
        if not blocks:
            continue
        tree.make_automaton()
        hits = np.array(list(tree.iter(text)), np.int64).reshape(-1, 2)
        wide = np.int64(len(text) + most + 1)
        copies = np.sort(hits[:, 1] * wide + hits[:, 0] - size + 1)
        home = np.arange(len(blocks), dtype=np.int64) * size
        key = np.array(blocks, np.int64) * wide + home
        left, right = np.searchsorted(copies, key + least), np.searchsorted(copies, key + most)
        many = right - left
        of = np.repeat(np.arange(len(blocks)), many)
        at = left[of] + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
        out.append(np.stack([copies[at] - key[of], home[of] + base], axis=1))
    found = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
    return found[np.lexsort((found[:, 1], found[:, 0]))]


def _agree(ids: np.ndarray, at: int, far: int, step: int) -> int:
    """How many words in a row are equal, from ``at`` and ``far`` on (step 1) or back (-1)."""
    n, got, size = len(ids), 0, 64
    while True:
        if step > 0:
            more = min(size, n - far - got)
            differ = np.flatnonzero(ids[at + got : at + got + more] != ids[far + got : far + got + more])
        else:
            more = min(size, at + 1 - got)
            a, f = at - got + 1, far - got + 1
            differ = np.flatnonzero((ids[a - more : a] != ids[f - more : f])[::-1])
        if len(differ):
            return got + int(differ[0])
        got += more
        if more < size:
            return got
        size *= 2


def _primitive(unit: np.ndarray) -> bool:
    """Whether a unit is no repetition of a shorter one."""
    q = left = len(unit)
    p = 2
    while left > 1:
        if p * p > left:
            p = left
        if left % p == 0:
            while left % p == 0:
                left //= p
            if np.array_equal(unit[q // p :], unit[: q - q // p]):
                return False
        p += 1
    return True


def runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal stretch of smallest period q and length of at
    least max(LEAST, TIMES * q), by start, then period."""
    found = set()
    for first, end in suspects(ids):
        part = ids[first:end]
        n = len(part)
        owner = np.full(n, -1, np.int64)
        known: list[tuple[int, int, int]] = []
        size = BLOCK
        while TIMES * (size if size > BLOCK else 1) <= n and size <= n:
            seeds = _seeds(part, size)
            starts = np.flatnonzero(np.r_[True, seeds[1:, 0] != seeds[:-1, 0]]) if len(seeds) else []
            for lot, lot_end in zip(starts, np.r_[starts[1:], len(seeds)] if len(seeds) else []):
                d, places = int(seeds[lot, 0]), seeds[lot:lot_end, 1]
                k = 0
                while k < len(places):
                    s = int(places[k])
                    inside = next((known[o] for o in (owner[s], owner[s + d + size - 1]) if o >= 0 and d % known[o][2] == 0 and known[o][0] <= s and s + d + size <= known[o][1]), None)
                    if inside is not None:  # a multiple of the period of a run that is known
                        k = max(k + 1, int(np.searchsorted(places, inside[1] - d - size, "right")))
                        continue
                    a = s - _agree(part, s - 1, s + d - 1, -1) if s else 0
                    b = s + d + size + _agree(part, s + size, s + d + size, 1)
                    k = max(k + 1, int(np.searchsorted(places, b - d - size, "right")))  # these would grow to the same stretch
                    if b - a >= max(LEAST, TIMES * d) and _primitive(part[a : a + d]):
                        known.append((a, b, d))
                        here = owner[a:b]
                        here[here < 0] = len(known) - 1
            size *= 2
        found |= {(first + a, b - a, d) for a, b, d in known}
    return sorted(found, key=lambda r: (r[0], r[2]))


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length / period; of those the smallest start, then period."""
    return max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if found else None


def collapsed(ids: np.ndarray, words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words that no run repeats, joined by one space: of each run the first period stays,
    unless another run repeats it."""
    gone = np.zeros(len(ids) + 1, np.int64)
    for start, length, period in found:
        gone[start + period] += 1
        gone[start + length] -= 1
    kept = ids[np.cumsum(gone[:-1]) == 0] if found else ids
    return b" ".join(map(words.__getitem__, kept.tolist()))


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, n_words, runs, strongest, collapsed).

    ``runs``: all (start, length, period) in words, from 0, by start, then period;
    ``strongest``: the one of greatest exact length / period (ties: smallest start, then
    period), null without a run; ``collapsed``: the text without the words that a run
    repeats, its words joined by one space.  A null text counts as empty: no words, no runs,
    an empty text.  Rows of null id and repeated rows are rows like any other; other columns
    are not read.  Texts are read whole."""

    def run(batches):
        for batch in sliced(batches, 256):
            ids, n, every, best, left = batch.column(0), [], [], [], []
            for text in batch.column(1):
                words, names = numbered(text.as_buffer().to_pybytes() if text.is_valid else b"")
                found = runs(words)
                top = strongest(found)
                n.append(len(words))
                every.append([dict(zip(("start", "length", "period"), r)) for r in found])
                best.append(dict(zip(("start", "length", "period"), top)) if top else None)
                left.append(collapsed(words, names, found))
            kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(every, pa.list_(kind)), pa.array(best, kind), pa.array(left, pa.binary()).cast(pa.string())], names=["id", "n_words", "runs", "strongest", "collapsed"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return arrow(rows, run, f"id long, n_words long, runs {RUN}, strongest struct<start:long,length:long,period:long>, collapsed string")
