"""Token ids and edit-aware token counts.

A document's tokens are counted over a segment tree whose leaves are stretches of
whole pre-tokens.  An edit touches few leaves; only their text, and the context
up to the next safe boundary, is encoded again and the sums above are updated.

A boundary is safe between a non-space character and a single space that a
non-space character follows: there every pre-token ends, whatever surrounds it,
and byte pairs are never merged over the end of a pre-token.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, sliced, told

END = "<|endoftext|>"
#: A stretch without white space beyond this length goes to the slower library, whose merge is not quadratic.
LONG_RUN = 4000
BOUNDARY = re.compile(r"(?<=\S) (?=\S)")
LEAF_CHARS = 400


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=4)
def encoder(json_file: str, ranks_file: str | None):
    """text -> ids as ``tokenizers`` gives for ``json_file`` (add_special_tokens=False).

    With ``ranks_file``, which holds the same vocabulary, the faster of two
    equal encoders is used, but for very long stretches without white space."""

    @lru_cache(maxsize=1)
    def slow():  # held only where it is needed
        from tokenizers import Tokenizer

        return Tokenizer.from_file(json_file)

    if ranks_file is None:
        return lambda text: slow().encode(text, add_special_tokens=False).ids
    import public_tokenizers
    import tiktoken

    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END: len(ranks)})

    def encode(text: str) -> list[int]:
        if len(text) > LONG_RUN and max(map(len, text.split()), default=0) > LONG_RUN:
            return slow().encode(text, add_special_tokens=False).ids
        if END in text:
            return fast.encode(text, allowed_special="all")
        return fast.encode_ordinary(text)

    return encode


def count_tokens(docs: DataFrame, text_col: str = "text", out: str = "n_tokens", files: tuple[str, str | None] | None = None) -> DataFrame:
    """``docs`` with a column of token counts (null and empty texts: 0); only the texts go
    to Python, only the counts come back.  A column named ``out`` must not be there yet."""
    if out in docs.columns:
        raise ValueError(f"column {out} would clash")
    files = files or default_files()
    count = lambda texts: pa.array([len(encoder(*files)(t.as_py())) if t.is_valid else 0 for t in texts], pa.int64())
    return docs.withColumn(out, told(docs, text_col, count, "long"))


class TokenTree:
    """Token counts of one document over a segment tree of its stretches."""

    def __init__(self, text: str, encode, leaf_chars: int = LEAF_CHARS):
        self.encode, self.leaf_chars = encode, leaf_chars
        self.leaves = self._cut(text)
        self.encoded_chars = len(text)
        counts = [len(encode(x)) for x in self.leaves]
        self._build(counts)

    def _cut(self, text: str) -> list[str]:
        """Whole stretches between safe boundaries, of about ``leaf_chars`` characters."""
        found, at, n = [], 0, len(text)
        while n - at > self.leaf_chars:
            m = BOUNDARY.search(text, at + self.leaf_chars)
            if m is None:
                break
            found.append(text[at : m.start()])
            at = m.start()
        found.append(text[at:])
        return found

    def _build(self, counts: list[int]) -> None:
        """Heap of sums: children of i are 2i and 2i + 1; tokens and characters."""
        size = 1
        while size < len(counts):
            size *= 2
        self.size = size
        self.tokens = np.zeros(2 * size, np.int64)
        self.chars = np.zeros(2 * size, np.int64)
        self.tokens[size : size + len(counts)] = counts
        self.chars[size : size + len(counts)] = [len(x) for x in self.leaves]
        for i in range(size - 1, 0, -1):
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    @property
    def length(self) -> int:
        return int(self.chars[1])

    def _leaf_at(self, place: int) -> tuple[int, int]:
        """Leaf that holds character ``place`` (the last one at the end), and where it starts."""
        node, start = 1, 0
        while node < self.size:
            left = int(self.chars[2 * node])
            if place - start < left or self.chars[2 * node + 1] == 0:
                node = 2 * node
            else:
                node, start = 2 * node + 1, start + left
        return min(node - self.size, len(self.leaves) - 1), start

    def edit(self, start: int, removed: int, inserted: str) -> None:
        """Replaces ``removed`` characters from ``start``; only touched stretches are encoded again."""
        start = max(0, min(start, self.length))
        removed = max(0, min(removed, self.length - start))
        a, at = self._leaf_at(max(start - 1, 0))
        b, _ = self._leaf_at(min(start + removed, max(self.length - 1, 0)))
        b = max(a, b)
        held = "".join(self.leaves[a : b + 1])
        text = held[: start - at] + inserted + held[start - at + removed :]
        # the first character of the stretch must still be a safe place to start
        while a > 0 and not (len(text) > 1 and text[0] == " " and not text[1].isspace()):
            a -= 1
            text = self.leaves[a] + text
        # the stretch must end on a non-space character before the next one
        while b + 1 < len(self.leaves) and (not text or text[-1].isspace()):
            b += 1
            text += self.leaves[b]
        fresh = self._cut(text)
        self.encoded_chars += len(text)
        counts = [len(self.encode(x)) for x in fresh]
        if len(fresh) == b - a + 1:
            self.leaves[a : b + 1] = fresh
            for i, (c, x) in enumerate(zip(counts, fresh)):
                node = self.size + a + i
                dt, dc = c - int(self.tokens[node]), len(x) - int(self.chars[node])
                while node:
                    self.tokens[node] += dt
                    self.chars[node] += dc
                    node //= 2
        else:  # another number of leaves: sums are laid out anew, nothing else is encoded
            kept = self.tokens[self.size : self.size + len(self.leaves)].tolist()
            self.leaves[a : b + 1] = fresh
            self._build(kept[:a] + counts + kept[b + 1 :])


def edited_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits", files: tuple[str, str | None] | None = None, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """Token counts before and after each document's edits.

    ``edits_col``: array of struct(start, removed, inserted), in the order in
    which they apply, in code points of the text as it then stands; places beyond
    the text are clipped to it; null means no edits.  Null texts count as empty;
    repeated rows come out as often as they went in; other columns are ignored.
    Returns (id, n_tokens, n_tokens_edited, n_leaves, n_chars, n_chars_edited,
    reencoded_chars)."""
    files = files or default_files()
    names = ["id", "n_tokens", "n_tokens_edited", "n_leaves", "n_chars", "n_chars_edited", "reencoded_chars"]

    def run(batches):
        encode = encoder(*files)
        for batch in sliced(batches):
            out = []
            for text, edits in zip(batch.column(1), batch.column(2)):
                text = text.as_py() or ""
                tree = TokenTree(text, encode, leaf_chars)
                before, n = tree.total, tree.encoded_chars
                for e in edits.as_py() or []:
                    tree.edit(e["start"] or 0, e["removed"] or 0, e["inserted"] or "")
                out.append((before, tree.total, len(tree.leaves), len(text), tree.length, tree.encoded_chars - n))
            columns = list(zip(*out)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns]], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(edits_col).cast("array<struct<start:long,removed:long,inserted:string>>").alias("edits"))
    return arrow(rows, run, ", ".join(f"{n} long" for n in names))


def attach_edits(docs: DataFrame, edits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Gathers a table of edits (id, seq, start, removed, inserted) per document, in order of seq."""
    one = edits.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("seq", "start", "removed", "inserted"))).alias("__e"))
    one = one.select(id_col, F.transform("__e", lambda e: F.struct(e["start"].alias("start"), e["removed"].alias("removed"), e["inserted"].alias("inserted"))).alias("edits"))
    return docs.join(one, id_col, "left")
