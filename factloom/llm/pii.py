"""Personal data: base patterns and a character-level BiLSTM with a CRF.

Base spans come from the patterns over whole texts.  The network is trained in
numpy on labelled spans (the base spans of a bounded sample of windows, and spellings
that no base pattern knows, written into the corpus's own text) and reads every
character of every text, in overlapping windows.  Each window is decoded for itself;
windows are reconciled for the whole text, each character by the window in which it
lies deepest.  The network adds spans where the base has none; base spans always stay.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, sliced, thinned, told

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can only start at the head of a run of digits; no backtracking, so linear on any text.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
ANCHOR = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind as listed, then start; ends are exclusive."""
    found = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((0, start, m.end()))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", max(done, at + 1))
    if ANCHOR.search(text) is None:
        return found
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            found.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m.group())) <= 15:
                found.append((3, m.start(), m.end()))
    return found


# ---------------------------------------------------------------- windows

WIDTH, OVERLAP = 512, 48
HOP = WIDTH - OVERLAP


def _symbols() -> np.ndarray:
    """Code of each character below 256 (others have OTHER): letters, digits and signs
    their own, upper case that of one class."""
    known = "abcdefghijklmnopqrstuvwxyz0123456789 .,:;-_+@()[]{}<>/\\=\"'%#&*!?|$\n\t"
    codes = np.full(256, OTHER, np.uint8)
    for i, c in enumerate(known):
        codes[ord(c)] = i + 3
    codes[[i for i in range(256) if chr(i).isupper()]] = UPPER
    return codes


PAD, OTHER, UPPER = 0, 1, 2
CODES = _symbols()
SYMBOLS = int(CODES.max()) + 1


def encode(text: str) -> np.ndarray:
    """Codes of a whole text, one for each code point."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 256, CODES[np.minimum(points, 255)], np.uint8(OTHER))


def windows(n: int) -> list[tuple[int, int]]:
    """(start, end) of the windows that cover a text of ``n`` characters; neighbours overlap."""
    return [(s, min(s + WIDTH, n)) for s in range(0, max(n - OVERLAP, 1), HOP)] if n else []


HELD = np.float32(4)  # bound of what a cell holds, so that long runs of one sign do not pile up
TAGS = 1 + len(KINDS)  # outside, and one for each kind; between two spans there is an outside


@dataclass
class Tagger:
    p: dict
    border: float = 0.0  # what entering a span costs on top, set on pieces kept aside

    # -- network -----------------------------------------------------------
    def states(self, x: np.ndarray, keep: bool = False):
        """Hidden states (time, direction, size, batch) of code rows (batch, time).

        Both directions step together, as one stack, with the batch as the last axis.
        The gates (input, forget, output) use the piecewise linear logistic, all else
        x / (1 + |x|), which cost numpy a fifth of the usual ones."""
        p = self.p
        t, n, size = x.shape[1], len(x), p["wh"].shape[2]
        emb, codes = np.ascontiguousarray(p["emb"].T), np.ascontiguousarray(x.T)
        weights = np.concatenate([p["wh"], p["wx"], p["b"][:, :, None]], axis=2)
        at = np.empty((2, weights.shape[2], n), np.float32)  # the state before, the symbol, and one
        at[:, :size], at[:, -1] = 0, 1
        c, a, spare = np.zeros((2, size, n), np.float32), np.empty((2, 4 * size, n), np.float32), np.empty((2, size, n), np.float32)
        out, held = np.empty((t, 2, size, n), np.float32), []
        for i in range(t):
            at[0, size:-1], at[1, size:-1] = emb[:, codes[i]], emb[:, codes[t - 1 - i]]
            a = np.matmul(weights, at, out=None if keep else a)
            gates, new = a[:, : 3 * size], a[:, 3 * size :]
            np.clip(gates, 0, 1, out=gates)
            new /= np.abs(new, out=spare) + 1
            old, c = c, gates[:, size : 2 * size] * c
            c += np.multiply(gates[:, :size], new, out=spare)
            np.clip(c, -HELD, HELD, out=c)
            tc = c / (np.abs(c, out=spare) + 1)
            np.multiply(gates[:, 2 * size :], tc, out=out[i])
            if keep:
                held.append((at.copy(), a, old, tc))
            at[:, :size] = out[i]
        return (out, held) if keep else out

    def scores(self, out: np.ndarray, against: int | None = None) -> np.ndarray:
        """Tag scores (time, batch, TAGS) from hidden states, or how far the other tags lie above one."""
        w, b, size = self.p["out"], self.p["bo"], out.shape[2]
        if against is not None:
            w, b = (np.delete(v - v[..., against, None], against, axis=-1) for v in (w, b))
        s = out[:, 0].transpose(0, 2, 1) @ w[:size]
        s += out[::-1, 1].transpose(0, 2, 1) @ w[size:]
        s += b
        return s

    def moves(self) -> tuple[np.ndarray, np.ndarray]:
        """Transitions, and what the first tag is given, with the border."""
        trans, first = self.p["trans"].copy(), self.p["first"].copy()
        trans[0, 1:] -= self.border
        first[1:] -= self.border
        return trans, first

    def suspects(self, x: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the windows whose best tags may be other than all outside, and their scores.

        The other windows are settled: no run of other tags can win back what entering
        and leaving it cost."""
        out = self.states(x)
        (trans, first), t, n = self.moves(), len(out), len(x)
        above = self.scores(out, against=0)
        if lengths.min() < t:
            above[np.arange(t)[:, None] >= lengths] = -1e6
        enter = max(trans[0, 1:].max() - trans[0, 0], (first[1:] - first[0]).max())
        leave, stay = max(trans[1:, 0].max() - trans[0, 0], 0), trans[1:, 1:].max() - trans[0, 0]
        gap = above.reshape(t, -1).max(axis=0).reshape(n, -1).max(axis=1)
        rows = np.flatnonzero((gap + stay > 0) | (gap + enter + leave > 0))
        if len(rows):  # the most that any run can win
            sums = np.cumsum(above[:, rows].max(axis=2).astype(np.float64) + stay, axis=0)
            low = np.minimum.accumulate(np.concatenate([np.zeros((1, len(rows))), sums[:-1]]), axis=0)
            rows = rows[(sums - low).max(axis=0) + enter + leave - stay > 0]
        return rows, self.scores(out[..., rows])

    def best(self, s: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best tag rows (batch, time) of scores (time, batch, TAGS) by Viterbi, over the first ``lengths`` characters."""
        trans, first = self.moves()
        t, n, k = s.shape
        inside = np.arange(t)[:, None] < lengths
        best, back, tags = s[0] + first, np.zeros((t, n, k), np.int8), np.zeros((n, t), np.int8)
        for i in range(1, t):
            step = best[:, :, None] + trans
            back[i] = step.argmax(axis=1)
            best = np.where(inside[i][:, None], step.max(axis=1) + s[i], best)
        last, at = best.argmax(axis=1), np.arange(n)
        for i in range(t - 1, -1, -1):
            tags[:, i] = np.where(inside[i], last, 0)
            if i:
                last = np.where(inside[i], back[i, at, last], last)
        return tags

    def decode(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best tag rows (batch, time) of code rows."""
        tags = np.zeros(x.shape, np.int8)
        rows, s = self.suspects(x, lengths)
        if len(rows):
            tags[rows] = self.best(s, lengths[rows])
        return tags


def _lstm_back(dh_all, held, weights):
    """Gradients of the stacked steps: of ``weights``, and of the symbols (time, direction, width, batch)."""
    t, _, size, n = dh_all.shape
    das, dats = np.empty((t, *held[0][1].shape), np.float32), np.empty((t, *held[0][0].shape), np.float32)
    dh, dc = np.zeros((2, size, n), np.float32), np.zeros((2, size, n), np.float32)
    back = np.ascontiguousarray(weights.transpose(0, 2, 1))
    for i in range(t - 1, -1, -1):
        _, a, old, tc = held[i]
        dh = dh + dh_all[i]
        gates, new, da = a[:, : 3 * size], a[:, 3 * size :], das[i]
        dc += dh * gates[:, 2 * size :] * (1 - np.abs(tc)) ** 2
        dc *= np.abs(tc) < HELD / (1 + HELD) - 1e-6
        np.multiply(dc, new, out=da[:, :size])
        np.multiply(dc, old, out=da[:, size : 2 * size])
        np.multiply(dh, tc, out=da[:, 2 * size : 3 * size])
        da[:, : 3 * size] *= (gates > 0) & (gates < 1)
        np.multiply(dc * gates[:, :size], (1 - np.abs(new)) ** 2, out=da[:, 3 * size :])
        dat = np.matmul(back, da, out=dats[i])
        dh = dat[:, :size]
        dc *= gates[:, size : 2 * size]
    dw = sum(da @ at.transpose(0, 2, 1) for da, (at, *_) in zip(das, held))
    return dw, dats[:, :, size:-1]


def _logsum(a, axis):
    m = a.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def _crf(s, y, trans, first):
    """Gradients of the mean negative log-likelihood of the tag rows ``y`` (time, batch)."""
    t, n, _ = s.shape
    fwd, bwd = np.zeros_like(s), np.zeros_like(s)
    fwd[0] = s[0] + first
    for i in range(1, t):
        fwd[i] = _logsum(fwd[i - 1][:, :, None] + trans, 1) + s[i]
    for i in range(t - 2, -1, -1):
        bwd[i] = _logsum(trans + (s[i + 1] + bwd[i + 1])[:, None, :], 2)
    z = _logsum(fwd[-1], 1)
    ds = np.exp(fwd + bwd - z[:, None])
    pair = np.exp(fwd[:-1, :, :, None] + trans + (s[1:] + bwd[1:])[:, :, None, :] - z[:, None, None]).sum(axis=(0, 1))
    dfirst = ds[0].sum(axis=0)
    np.subtract.at(ds, (np.arange(t)[:, None], np.arange(n)[None, :], y), 1)
    np.subtract.at(pair, (y[:-1].reshape(-1), y[1:].reshape(-1)), 1)
    np.subtract.at(dfirst, y[0], 1)
    return ds / n, pair / n, dfirst / n


def train(x: np.ndarray, y: np.ndarray, width: int = 12, size: int = 12, epochs: int = 8, batch: int = 64, rate: float = 0.02, seed: int = 17, start: Tagger | None = None) -> Tagger | None:
    """Trains embeddings, both LSTM directions, the output layer and the CRF
    transitions together (Adam), on code and tag rows (batch, time); ``start`` is trained on."""
    if not len(x):
        return start
    rng = np.random.default_rng(seed)
    f = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[-1]), shape).astype(np.float32)
    scale = np.repeat(np.float32([0.25, 0.25, 0.25, 1]), size)[:, None]  # gates run from 0 to 1 over four units
    bias = np.repeat(np.float32([0.5, 0.75, 0.5, 0]), size) * np.ones((2, 1), np.float32)
    p = {"emb": f(SYMBOLS, width) * 3, "wx": f(2, 4 * size, width) * scale, "wh": f(2, 4 * size, size) * scale, "b": bias, "out": f(2 * size, TAGS) * 2, "bo": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32), "first": np.zeros(TAGS, np.float32)}
    p = start.p if start is not None else p
    m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    model, step, total = Tagger(p), 0, epochs * -(-len(x) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            pick = order[at : at + batch]
            out, held = model.states(x[pick], keep=True)
            s = model.scores(out)
            ds, dtrans, dfirst = _crf(s, y[pick].T, p["trans"], p["first"])
            both = np.concatenate([out[:, 0], out[::-1, 1]], axis=1).transpose(1, 0, 2).reshape(2 * size, -1)
            dboth = (ds @ p["out"].T).transpose(0, 2, 1)
            dw, dsym = _lstm_back(np.stack([dboth[:, :size], dboth[::-1, size:]], axis=1), held, np.concatenate([p["wh"], p["wx"], p["b"][:, :, None]], axis=2))
            demb = np.zeros_like(p["emb"])
            each = (dsym[:, 0] + dsym[::-1, 1]).transpose(0, 2, 1).reshape(-1, width)  # both directions read the same symbol
            codes = x[pick].T.reshape(-1)
            by = np.argsort(codes, kind="stable")
            heads = np.flatnonzero(np.r_[True, codes[by][1:] != codes[by][:-1]])
            demb[codes[by][heads]] = np.add.reduceat(each[by], heads, axis=0)
            grads = {"emb": demb, "wx": dw[:, :, size:-1], "wh": dw[:, :, :size], "b": dw[:, :, -1], "out": both @ ds.reshape(-1, TAGS), "bo": ds.sum(axis=(0, 1)), "trans": dtrans, "first": dfirst}
            step += 1
            lr = rate * (1 - 0.9 * step / total)
            for k, g in grads.items():
                g = np.clip(g, -1, 1)
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.99 * m2[k] + 0.01 * g * g
                p[k] -= (lr * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return model


# ---------------------------------------------------------------- labelled spans

PIECE = 96  # characters of a training row


def _luhn_ends(body: str) -> str:
    return body + next(c for c in "0123456789" if luhn(body + c))


def spelled(rng: np.random.Generator, words: list[str]) -> tuple[int, str]:
    """(kind, text): personal data in a spelling that no base pattern takes whole."""
    digit = lambda n: "".join(str(d) for d in rng.integers(0, 10, n))
    word = lambda: _word(rng, words)
    pick = lambda *xs: xs[int(rng.integers(len(xs)))]
    kind = int(rng.choice([0, 0, 0, 1, 2, 3, 3]))
    if kind == 0:
        at = pick(" (at) ", " (at) ", " [at] ", "[at]", " at ", "@")
        dot = pick(" dot ", "[dot]", "[.]") if at == "@" else " dot " if at == " at " else pick(".", ".", " dot ", "[dot]", "[.]")
        name = word() + pick("", "", "." + word(), "_" + word(), digit(2))
        return 0, name + at + word() + pick("", "", digit(1), "-" + word()) + dot + pick("com", "org", "net", "info", "co", "io", "edu", "de", "fr", "es")
    if kind == 1:
        between = pick(" dot ", "[.]", " . ", "[dot]")
        return 1, between.join(str(v) for v in rng.integers(0, 256, 4))
    if kind == 2:
        body = _luhn_ends(pick("4", "5", "3", "6") + digit(14))
        return 2, pick(".", "/", "  ", " - ").join(body[j : j + 4] for j in range(0, 16, 4))
    return 3, pick(f"({digit(3)}) {digit(3)}-{digit(4)}", f"{digit(3)}-{digit(3)}-{digit(4)}", f"{digit(3)} {digit(3)} {digit(4)}", f"{digit(3)}.{digit(3)}.{digit(4)}", f"({digit(3)}) {digit(3)} {digit(4)}")


def usual(rng: np.random.Generator, words: list[str]) -> tuple[int, str]:
    """(kind, text): personal data that a base pattern takes."""
    digit = lambda n: "".join(str(d) for d in rng.integers(0, 10, n))
    kind = int(rng.integers(4))
    if kind == 0:
        return 0, f"{_word(rng, words)}{('', '.' + digit(2), '_' + digit(1))[int(rng.integers(3))]}@{_word(rng, words)}{('', digit(1))[int(rng.integers(2))]}{('.example', '')[int(rng.integers(2))]}.com"
    if kind == 1:
        return 1, ".".join(str(v) for v in rng.integers(0, 256, 4))
    if kind == 2:
        body = _luhn_ends(("4", "5", "3", "6")[int(rng.integers(4))] + digit(14))
        return 2, ("", " ", "-")[int(rng.integers(3))].join(body[j : j + 4] for j in range(0, 16, 4))
    return 3, (f"+{rng.integers(1, 99)} ({digit(3)}) {digit(3)}-{digit(4)}", f"+{rng.integers(1, 99)} {digit(3)} {digit(3)} {digit(4)}", f"+{rng.integers(1, 99)}{digit(9)}")[int(rng.integers(3))]


def harmless(rng: np.random.Generator, words: list[str]) -> str:
    """What looks like personal data and is none."""
    n = lambda a, b: int(rng.integers(a, b))
    digit = lambda k: "".join(str(d) for d in rng.integers(0, 10, k))
    word = lambda: _word(rng, words)
    made = [
        lambda: f"{n(1900, 2100)}-{n(1, 13):02d}-{n(1, 29):02d}", lambda: f"{n(0, 24)}:{n(0, 60):02d}", lambda: f"{n(0, 99)}.{n(0, 99)}", lambda: f"v{n(0, 9)}.{n(0, 20)}.{n(0, 20)}",
        lambda: f"{n(1, 999)},{digit(3)}.{digit(2)}", lambda: f"{n(1, 9999)}", lambda: f"{word()} at {word()}", lambda: f"{word()} (at) the {word()}", lambda: f"the {word()} dot {word()}", lambda: f"@{word()}",
        lambda: f'token = "{rng.bytes(20).hex()}"', lambda: f"{n(1, 99)}/{n(1, 99)}/{n(1900, 2100)}", lambda: f"({n(1900, 2100)})", lambda: f"{n(1, 999)} - {n(1, 999)}", lambda: f"#{digit(6)}", lambda: f"{word()}.{word()}.com", lambda: f"${n(1, 999)}.{digit(2)}",
        lambda: f"{word()}@{word()}", lambda: f"{n(256, 999)}.{n(1, 999)}.{n(256, 999)}.{n(1, 999)}", lambda: f"+{n(1, 99)}", lambda: f"a[{n(0, 9)}] + b[{n(0, 9)}] - {n(1, 99)}", lambda: f"{word()} dot com", lambda: f"at {n(1, 13)} dot", lambda: " ".join(str(v) for v in rng.integers(0, 99, 5)),
        lambda: digit(16 if rng.random() < 0.7 else n(5, 24)), lambda: " ".join([word()] * n(3, 30)), lambda: " ".join([word()] * n(3, 30)), lambda: (word() + ". ") * n(2, 20), lambda: f"{word()} at at {word()}", lambda: f"at {word()} at {word()} at", lambda: f"{word()} at that {word()} at {word()}", lambda: f"at at at {word()}",
    ]
    while True:
        text = made[n(0, len(made))]()
        if not base_spans(text):
            return text


def _word(rng: np.random.Generator, words: list[str]) -> str:
    if words and rng.random() < 0.5:
        return words[int(rng.integers(len(words)))]
    return "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(rng.integers(2, 10))))


def training_rows(pieces: list[str], made: int, seed: int = 23) -> tuple[np.ndarray, np.ndarray]:
    """Code and tag rows (batch, PIECE): the sampled pieces with their base spans, and as
    many as ``made`` pieces into which spans, or what only looks like one, are written."""
    rng = np.random.default_rng(seed)
    quiet = [p for p in pieces if not re.search(r"[0-9@+]", p)] or ["the people of the town went to see what it was and came home again in the evening without a word "]
    words = sorted({w for p in quiet[:400] for w in re.findall(r"[a-z]{2,9}", p.lower())})
    x, y = [], []

    def add(text, spans):
        row, tags = np.zeros(PIECE, np.uint8), np.zeros(PIECE, np.int64)
        codes = encode(text[:PIECE])
        row[: len(codes)] = codes
        for kind, a, b in spans:
            tags[min(a, PIECE) : min(b, PIECE)] = 1 + kind
        x.append(row)
        y.append(tags)

    for p in pieces:
        add(p, base_spans(p))
    for i in range(made):
        host, text, spans = quiet[int(rng.integers(len(quiet)))], "", []
        for _ in range(2):
            cut = host.find(" ", int(rng.integers(0, 30))) + 1
            text, host = text + host[:cut], host[cut:]
            if rng.random() < 0.6:
                kind, span = spelled(rng, words) if rng.random() < 0.7 else usual(rng, words)
                if rng.random() < 0.1:
                    text += ("<", "(", "mail: ", "tel. ", "card ", '"')[int(rng.integers(6))]
                spans.append((kind, len(text), len(text) + len(span)))
                text += span + (" ", " ", ", ", ". ", "\n", ") ", "; ")[int(rng.integers(7))]
            else:
                text += harmless(rng, words) + " "
        add(text + host, spans)
    return np.array(x), np.array(y)


def coded(pieces: list[str]) -> np.ndarray:
    x = np.zeros((len(pieces), PIECE), np.uint8)
    for row, p in zip(x, pieces):
        codes = encode(p)[:PIECE]
        row[: len(codes)] = codes
    return x


def learn(pieces: list[str], made: int) -> Tagger | None:
    """A tagger from pieces of text.  It is trained on those with digits or @ signs and a
    part of the quiet ones, then on the quiet pieces in which it still finds something;
    a fifth of the quiet ones is kept aside, and entering a span costs as much on top as keeps it still there."""
    loud, quiet = [p for p in pieces if ANCHOR.search(p)], [p for p in pieces if not ANCHOR.search(p)]
    first, rest, aside = quiet[: len(quiet) // 5], quiet[len(quiet) // 5 : -len(quiet) // 5 or None], quiet[len(quiet) - len(quiet) // 5 :]
    x, y = training_rows(loud + first, made)
    model = train(x, y)
    if model is None:
        return None
    full = lambda x: np.full(len(x), PIECE)
    if rest:
        held = coded(rest)
        wrong = held[model.decode(held, full(held)).any(axis=1)]
        more = np.concatenate([np.repeat(wrong, 4, axis=0), held[: len(x) // 4]])
        model = train(np.concatenate([x, more]), np.concatenate([y, np.zeros(more.shape, np.int64)]), epochs=2, rate=0.005, start=model)
    if aside:
        held, model.border = coded(aside), 2.0
        while model.border < 20 and model.decode(held, full(held)).any():
            model.border += 1
    return model


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 1_000, most_quiet: int = 5_000, most_docs: int = 20_000, made: int = 5_000) -> Tagger | None:
    """Trains on pieces of about ``most_docs`` documents, picked by hashes: at most ``most``
    different ones around digits or @ signs, and ``most_quiet`` of others (documented
    bounds), and on ``made`` pieces into which spans are written."""

    def run(batches):
        for batch in sliced(batches):
            seen = set()
            for t in batch.column(0):
                t = t.as_py() or ""
                m = ANCHOR.search(t)
                starts = [max(0, m.start() - 40)] if m else []
                if t:
                    starts.append(crc32(t[:64].encode("utf-8", "replace")) % max(1, len(t) - PIECE))
                seen |= {t[s : s + PIECE] for s in starts}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.string())], names=["piece"])

    found = arrow(thinned(docs, id_col, most_docs).select(F.col(text_col).cast("string").alias("text")), run, "piece string").distinct()
    loud = F.col("piece").rlike("[0-9@]")
    order = [F.xxhash64("piece"), "piece"]
    return learn([r.piece for part, n in ((found.where(loud), most), (found.where(~loud), most_quiet)) for r in part.orderBy(*order).limit(n).collect()], made)


# ---------------------------------------------------------------- whole texts

BATCH = 384  # windows that are decoded at once
SHORTEST = 7  # characters of the shortest of all forms, 1.1.1.1


def added_spans(texts: list[str], base: list[list], model: Tagger | None) -> list[list]:
    """Spans that the network finds outside the base spans, per text."""
    out = [[] for _ in texts]
    if model is None:
        return out
    codes = [encode(t) for t in texts]
    where = [(i, a, b) for i, c in enumerate(codes) for a, b in windows(len(c))]
    order = sorted(range(len(where)), key=lambda k: where[k][2] - where[k][1])  # windows of like length together
    left: list[tuple[list, np.ndarray]] = []  # windows that are not settled, and their scores
    for at in range(0, len(order), BATCH):
        part = [where[k] for k in order[at : at + BATCH]]
        lengths = np.array([b - a for _, a, b in part])
        x = np.zeros((len(part), int(lengths.max())), np.uint8)
        for row, (i, a, b) in zip(x, part):
            row[: b - a] = codes[i][a:b]
        rows, s = model.suspects(x, lengths)
        if len(rows):
            left.append(([part[k] for k in rows.tolist()], s))
    tags: dict[int, dict[int, np.ndarray]] = {}  # of texts in which anything is found, by start
    for part, s in _together(left):
        found = model.best(s, np.array([b - a for _, a, b in part]))
        for k in np.flatnonzero(found.any(axis=1)).tolist():
            i, a, _ = part[k]
            tags.setdefault(i, {})[a] = found[k]
    for i, held in tags.items():
        whole = np.zeros(len(codes[i]), np.int8)
        for a, b in windows(len(codes[i])):  # up to the middle of an overlap the earlier window holds
            if a in held:
                lo = a + OVERLAP // 2 if a else 0
                hi = b if b == len(whole) else b - OVERLAP // 2
                whole[lo:hi] = held[a][lo - a : hi - a]
        out[i] = _spans_of(texts[i], whole, base[i])
    return out


def _together(left: list[tuple[list, np.ndarray]]):
    """Groups of windows with their scores, some BATCH windows in each, as long as the longest."""
    while left:
        n, size = 0, 0
        while n < len(left) and size < BATCH:
            size += len(left[n][0])
            n += 1
        t = max(s.shape[0] for _, s in left[:n])
        yield [w for part, _ in left[:n] for w in part], np.concatenate([np.pad(s, ((0, t - s.shape[0]), (0, 0), (0, 0))) for _, s in left[:n]], axis=1)
        left = left[n:]


def _spans_of(text: str, tags: np.ndarray, base: list) -> list:
    """Runs of one kind, widened to whole words, that touch no base span.  As for base
    spans, a card must have 13 to 19 digits and pass Luhn, a phone number 9 to 15."""
    cuts = np.flatnonzero(np.diff(tags, prepend=0, append=0))
    kept, done = [], 0
    taken = sorted((a, b) for _, a, b in base)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        kind = int(tags[a]) - 1
        if kind < 0:
            continue
        while a < b and not text[a].isalnum() and text[a] not in "+(":
            a += 1
        while b > a and not text[b - 1].isalnum():
            b -= 1
        while a > done and text[a - 1].isalnum() and b - a < WIDTH:
            a -= 1
        while b < len(text) and text[b].isalnum() and b - a < WIDTH:
            b += 1
        digits = "".join(c for c in text[a:b] if "0" <= c <= "9")
        if b - a < SHORTEST or (kind == 2 and not (13 <= len(digits) <= 19 and luhn(digits))) or (kind == 3 and not 9 <= len(digits) <= 15):
            continue
        if all(b <= lo or hi <= a for lo, hi in taken):
            kept.append((kind, a, b))
            done = b
    return kept


def shown(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find(docs: DataFrame, model: Tagger | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base array<struct<kind, start, end>>, spans likewise) for every row.

    Null texts count as empty; repeated rows come out as often as they went in."""

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        rows = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in spans]
        for batch in sliced(batches):
            texts = [t.as_py() or "" for t in batch.column(1)]
            base = [base_spans(t) for t in texts]
            more = added_spans(texts, base, model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([rows(b) for b in base], kind), pa.array([rows(sorted(b + m)) for b, m in zip(base, more)], kind)], names=["id", "base", "spans"])

    span = "array<struct<kind:string,start:long,end:long>>"
    return arrow(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), run, f"id long, base {span}, spans {span}")


def mask(docs: DataFrame, model: Tagger | None, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; where spans
    overlap, their union is replaced once.  ``chars_col``, if there, is counted anew for
    rows that change.  Only the texts go to Python."""

    def masked(text, spans):
        parts, done = [], 0
        for a, b, kind in sorted((a, b, k) for k, a, b in spans):
            if a >= done:
                parts += [text[done:a], f"<{KINDS[kind].upper()}>"]
            done = max(done, b)
        return "".join(parts) + text[done:]

    def changed(texts: pa.Array) -> pa.Array:
        """The new text where anything is found, else null."""
        texts = [t or "" for t in texts.to_pylist()]
        base = [base_spans(t) for t in texts]
        return pa.array([masked(t, b + m) if b or m else None for t, b, m in zip(texts, base, added_spans(texts, base, model))], pa.string())

    new, old = "__masked", F.col(text_col)
    found = docs.withColumn(new, told(docs, text_col, changed, "string"))
    count = {chars_col: F.when(F.col(new).isNotNull(), F.length(new)).otherwise(F.col(chars_col)).cast(docs.schema[chars_col].dataType)} if chars_col in docs.columns else {}
    return found.withColumns({text_col: F.coalesce(F.col(new), old), **count}).select(*docs.columns)
