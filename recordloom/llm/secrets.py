"""Secret scanning with a linear-chain conditional random field.

Base patterns (assign, access, hex) find spans outright. Beyond them, a CRF tags each token of a text as outside, begin
or inside of a secret, from hashed features of the token's shape and word, its neighbours, and the file; tags are
decoded by Viterbi. The CRF is fitted on a bounded sample of distinct text windows (TRAIN_WINDOWS, half of them around
base matches), whose base matches are the labels, digits alone excepted. As those show few kinds of secrets, each window
also stands in the sample in another guise: with its secrets and the words before them drawn anew from other alphabets and
names, or, where it has none, with harmless long tokens (compound words, identifiers, links, dates, numbers) put in.

Features of a token are sums of weights by bucket, so a block of texts is scored by array look-ups. Decoding cuts a
text at tokens that any best path must leave outside: where outside leads the other tags by more than what follows can
make up for. What lies between is decoded by Viterbi, exactly; most text costs a comparison.

One pass over the texts samples windows: each task passes on its TRAIN_WINDOWS / 2 distinct windows of the least hashes,
of either sort. A second pass scans every text in the task that reads it.
"""

from __future__ import annotations

import heapq
import random
import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate
from operator import or_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm.common import blocks, durable, keyed_texts, prepared, table, text_or_empty

KINDS = ("assign", "access", "hex")
#: The kind that only the method adds, last in the order of equal starts.
ALL_KINDS = (*KINDS, "secret")
TRAIN_WINDOWS, WINDOW = 2000, 400
BUCKETS = 1 << 13
ROUNDS, RATE, L2 = 60, 0.5, 1e-5
#: Code points of a long text that are read at once, and chunks around them that are read too.
PART, LOOK = 1 << 20, 4
SPACES = re.compile("[ \n]")
#: Code points of an added span, at least.
MIN_ADDED = 12
OUT, BEGIN, INSIDE = range(3)
#: Weight of a move that can't be.
BARRED = -1e4

# An assignment is found from its sign: patterns that begin with what is rare are searched for fast.
SIGN_OF = re.compile("[:=]")
KEY_END = re.compile(r"(?:password|passwd|secret|token|api_?key)\Z", re.IGNORECASE | re.ASCII)
VALUE = re.compile(r"""\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LONG_HEX = re.compile(r"[0-9a-f]{16,}")

Span = tuple[str, int, int]


def assignments(text: str) -> list[tuple[int, int, int]]:
    """Leftmost non-overlapping assignments: start, start of the value, end."""
    found, floor = [], 0
    m = SIGN_OF.search(text)
    while m:
        at = m.start()
        while at > floor and text[at - 1] == " ":
            at -= 1
        at -= at > floor and text[at - 1] in "\"'"
        key = KEY_END.search(text[max(floor, at - 8) : at])
        value = VALUE.match(text, m.end()) if key else None
        if value:
            found.append((at - len(key[0]), value.start(1), value.end()))
            floor = value.end()
        m = SIGN_OF.search(text, max(floor, m.end()))
    return found


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the base patterns, whole matches, by start, then kind as listed."""
    found = [("assign", s, e) for s, v, e in assignments(text) if e - v >= 12]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [("hex", m.start(), m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], ALL_KINDS.index(s[0])))


def secret_spans(text: str) -> list[tuple[int, int]]:
    """What of the base matches is the secret itself: an assignment's value, a key, a hex string that isn't all digits; overlaps united."""
    raw = [(v, e) for _, v, e in assignments(text) if e - v >= 12]
    raw += [m.span() for m in ACCESS.finditer(text) if len(m[0]) >= 18] + [m.span() for m in LONG_HEX.finditer(text) if not m[0].isdigit()]
    out: list[tuple[int, int]] = []
    for s, e in sorted(raw):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


# Classes of code points: 0 white space, 1 digits, 2 a-f, 3 other small letters, 4 capitals, 5 letters beyond ASCII,
# 6 signs that secrets have, 7 other signs.
SPACE, DIGIT, HEX_LETTER, SMALL, CAPITAL, LETTER, SIGN, OTHER = range(8)
_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    global _classes
    if _classes is None:
        table_ = np.full(0x110000, OTHER, np.uint8)
        table_[[i for i in range(0x3000) if chr(i).isspace()] + [0x3000]] = SPACE
        table_[[i for i in range(128, 0x110000) if chr(i).isalnum()]] = LETTER
        for chars, kind in (("0123456789", DIGIT), ("abcdef", HEX_LETTER), ("ghijklmnopqrstuvwxyz", SMALL), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", CAPITAL), ("+/_.=-", SIGN)):
            table_[[ord(c) for c in chars]] = kind
        _classes = table_
    return _classes


@dataclass
class Tokens:
    """Tokens of some texts one after another: runs of letters and digits, and runs of signs of one class."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    features: np.ndarray  # a bucket of each feature, for each token


def mixed(*parts: np.ndarray) -> np.ndarray:
    """A bucket for each combination of values."""
    h = np.zeros(1, np.uint64)
    for p in parts:
        h = (h ^ p.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h = h ^ (h >> np.uint64(29))
    return (h % np.uint64(BUCKETS)).astype(np.int32)


def tokenized(texts: list[str], share: float | None = None) -> Tokens:
    """Tokens of texts, with starts and ends as code points in their own text; share: of signs in the file, if the texts are part of one."""
    encoded = [t.encode("utf-32-le", "surrogatepass") for t in texts]
    sizes = np.array([len(e) // 4 for e in encoded], np.int64)
    points = np.frombuffer(b"".join(encoded), np.uint32)
    kind = classes()[points] if len(points) else np.zeros(0, np.uint8)
    group = np.where((kind >= DIGIT) & (kind <= LETTER), 1, np.where(kind == SPACE, 0, kind))
    first = np.cumsum(sizes) - sizes
    edge = np.ones(len(points), bool)
    edge[1:] = group[1:] != group[:-1]
    edge[first[sizes > 0]] = True
    starts = np.flatnonzero(edge)
    ends = np.append(starts[1:], len(points))
    if not len(starts):
        none = np.zeros(0, np.int64)
        return Tokens(none, none, none, np.zeros((0, len(FEATURE_NAMES)), np.int32))

    def count(k: int) -> np.ndarray:
        return np.add.reduceat((kind == k).astype(np.int64), starts)

    length = ends - starts
    place = np.arange(len(points)) - np.repeat(starts, length)
    lower = np.where(kind == CAPITAL, points + 32, points).astype(np.uint64)
    powers = np.cumprod(np.full(int(length.max()) + 1, 0x100000001B3, np.uint64), dtype=np.uint64)
    word = np.add.reduceat(lower * powers[place], starts)
    digits, hexes, small, capital, foreign = (count(k) for k in (DIGIT, HEX_LETTER, SMALL, CAPITAL, LETTER))
    bin_ = np.minimum(np.log2(length + 1).astype(np.int64) * 2 + (length > 11) + (length > 23), 20)
    turns = np.zeros(len(points), np.int64)
    turns[1:] = (kind[1:] == DIGIT) != (kind[:-1] == DIGIT)
    turns = np.minimum(np.add.reduceat(turns, starts) * 4 // np.maximum(length, 1), 3)
    shape = mixed(np.full(1, 1), bin_, (digits > 0) + (digits * 2 > length) + (digits == length), (hexes > 0) * 2 + (small > 0), (capital > 0) + (capital > 1), foreign > 0, group[starts], turns)
    keep = group[starts] > 0
    text_of = np.repeat(np.arange(len(texts)), sizes)[starts]
    start, end, shape, word, length, doc = (x[keep] for x in (starts - first[text_of], ends - first[text_of], shape, word, length, text_of))
    glued = np.zeros(len(start), np.int64)
    glued[1:] = (start[1:] == end[:-1]) & (doc[1:] == doc[:-1])
    known = np.where(length <= 12, word, np.uint64(0))  # longer words are no vocabulary

    def beside(x: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros_like(x)
        if len(x) > abs(by):
            to, from_ = (slice(by, None), slice(None, -by)) if by > 0 else (slice(None, by), slice(-by, None))
            out[to] = np.where(doc[to] == doc[from_], x[from_], 0)
        return out

    signs = np.bincount(doc, weights=(group[starts][keep] != 1), minlength=len(texts)) / np.maximum(np.bincount(doc, minlength=len(texts)), 1) if share is None else np.full(len(texts), share)
    file = mixed(np.full(1, 9), np.minimum((signs * 8).astype(np.int64), 7))[doc]
    columns = [shape, mixed(np.full(1, 2), known), mixed(np.full(1, 3), beside(known, 1)), mixed(np.full(1, 4), beside(known, 2)), mixed(np.full(1, 5), beside(known, 3)), mixed(np.full(1, 6), beside(shape, 1), glued), mixed(np.full(1, 7), beside(shape, -1)), mixed(np.full(1, 8), shape, beside(known, 2)), file]
    return Tokens(start, end, doc, np.stack(columns, axis=1))


FEATURE_NAMES = ("shape", "word", "word before", "two before", "three before", "shape before, whether glued", "shape after", "shape with two before", "file")


@dataclass
class Crf:
    """emission[bucket, tag], transition[from, to] and first[tag] weights."""

    emission: np.ndarray
    transition: np.ndarray
    first: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        out = np.zeros((len(features), 3))
        for j in range(features.shape[1]):
            out += self.emission[features[:, j]]
        return out

    def decode(self, tokens: Tokens, scores: np.ndarray) -> np.ndarray:
        """The best path's tags of all tokens."""
        tags = np.zeros(len(tokens.start), np.int8)
        if not len(tags):
            return tags
        t = self.transition
        new = np.append(True, tokens.doc[1:] != tokens.doc[:-1])
        # A tag that gives way to OUT changes at most three moves, and if the next tag is INSIDE, it becomes BEGIN.
        moves = np.concatenate([t.ravel(), self.first])
        moves = moves[moves > BARRED / 2]
        turned = np.append(np.where(new[1:], 0, np.maximum(scores[1:, INSIDE] - scores[1:, BEGIN], 0)), 0)
        sure = scores[:, OUT] - scores[:, BEGIN:].max(axis=1) > 3 * (moves.max() - moves.min()) + turned
        for a, b in runs(~sure, new):
            path = viterbi(scores[a:b], t, self.first if new[a] else t[OUT], t[:, OUT] if b < len(tags) and not new[b] else np.zeros(3))
            tags[a:b] = path
        return tags


    def read(self, texts: list[str]) -> tuple[Tokens, np.ndarray]:
        """Tokens of texts and their tags' scores; a long text, which comes alone, is read part by part.

        Parts end at white space, and each is read with the LOOK chunks between white space around it, which hold all
        neighbours that its tokens' features look at.
        """
        if max(map(len, texts), default=0) <= PART:
            tokens = tokenized(texts)
            return tokens, self.scores(tokens.features)
        (text,) = texts
        bounds = parted(text)
        counts = np.zeros(2, np.int64)
        for _, a, b, _ in bounds:
            counts += sign_counts(text[a:b])
        starts, ends, scores = [], [], []
        for low, a, b, high in bounds:
            t = tokenized([text[low:high]], counts[0] / max(counts[1], 1))
            own = (t.start >= a - low) & (t.start < b - low)
            starts.append(t.start[own] + low)
            ends.append(t.end[own] + low)
            scores.append(self.scores(t.features[own]))
        start = np.concatenate(starts)
        return Tokens(start, np.concatenate(ends), np.zeros(len(start), np.int64), np.zeros((len(start), 0), np.int32)), np.concatenate(scores)


def parted(text: str) -> list[tuple[int, int, int, int]]:
    """Parts of a text (begin, end) between the bounds of what is read with them."""
    out, a = [], 0
    while a < len(text):
        cut = SPACES.search(text, a + PART) if len(text) - a > PART else None
        b = cut.start() if cut else len(text)
        low, high = a, b
        for _ in range(LOOK):
            low = max((text.rfind(c, 0, max(low - 1, 0)) for c in " \n"), default=-1) if low > 0 else 0
            low = max(low, 0)
            after = SPACES.search(text, high + 1) if high < len(text) else None
            high = after.start() if after else len(text)
        out.append((low, a, b, high))
        a = b
    return out


def sign_counts(text: str) -> np.ndarray:
    """Tokens of signs, and all tokens."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = classes()[points]
    group = np.where((kind >= DIGIT) & (kind <= LETTER), np.uint8(1), np.where(kind == SPACE, np.uint8(0), kind))
    first = np.append(True, group[1:] != group[:-1]) if len(group) else np.zeros(0, bool)
    return np.array([(first & (group > 1)).sum(), (first & (group > 0)).sum()])


def runs(wanted: np.ndarray, new: np.ndarray) -> list[tuple[int, int]]:
    """Runs of wanted places, cut where a new text begins."""
    edge = wanted.copy()
    edge[1:] = wanted[1:] & (~wanted[:-1] | new[1:])
    starts = np.flatnonzero(edge)
    stop = np.append((~wanted[1:] | new[1:]), True) & wanted
    return list(zip(starts.tolist(), (np.flatnonzero(stop) + 1).tolist(), strict=True))


def viterbi(scores: np.ndarray, transition: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    back = np.zeros((len(scores), 3), np.int8)
    best = first + scores[0]
    for i in range(1, len(scores)):
        ways = best[:, None] + transition
        back[i] = ways.argmax(axis=0)
        best = ways.max(axis=0) + scores[i]
    path = np.zeros(len(scores), np.int8)
    path[-1] = int((best + last).argmax())
    for i in range(len(scores) - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def labelled(tokens: Tokens, secrets: list[list[tuple[int, int]]]) -> np.ndarray:
    tags = np.zeros(len(tokens.start), np.int64)
    for d, spans in enumerate(secrets):
        own = np.flatnonzero(tokens.doc == d) if spans else ()
        for s, e in spans:
            inner = [i for i in own if tokens.start[i] < e and tokens.end[i] > s]
            if inner:
                tags[inner] = INSIDE
                tags[inner[0]] = BEGIN
    return tags


def fitted(windows: list[tuple[str, list[tuple[int, int]]]], rounds: int = ROUNDS) -> Crf:
    """Maximum likelihood by AdaGrad; forward and backward run over all windows at once, padded to equal length."""
    transition, first = np.zeros((3, 3)), np.zeros(3)
    transition[OUT, INSIDE] = first[INSIDE] = BARRED  # a secret begins before it goes on
    emission = np.zeros((BUCKETS, 3))
    crf = Crf(emission, transition, first)
    if not windows:
        first[BEGIN] = transition[:, BEGIN] = BARRED
        return crf
    tokens = tokenized([t for t, _ in windows])
    tags = labelled(tokens, [s for _, s in windows])
    if not len(tags):
        return crf
    sizes = np.bincount(tokens.doc, minlength=len(windows))
    n, width = len(windows), int(sizes.max())
    place = np.arange(len(tags)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = tokens.doc, place
    real = np.zeros((n, width), bool)
    real[at] = True
    pairs = np.flatnonzero(place > 0)
    true_pairs = np.bincount(tags[pairs - 1] * 3 + tags[pairs], minlength=9).reshape(3, 3)
    true_first = np.bincount(tags[place == 0], minlength=3)
    squares = [np.full(x.shape, 1e-6) for x in (emission, transition, first)]
    for _ in range(rounds):
        scores = np.zeros((n, width, 3))
        scores[at] = crf.scores(tokens.features)
        moves = np.exp(transition)
        alpha, scale = np.zeros((n, width, 3)), np.ones((n, width))
        emit = np.exp(scores - scores.max(axis=2, keepdims=True))
        for i in range(width):
            a = np.exp(first) * emit[:, 0] if not i else (alpha[:, i - 1] @ moves) * emit[:, i]
            scale[:, i] = np.where(real[:, i], a.sum(axis=1), 1)
            alpha[:, i] = np.where(real[:, i, None], a / scale[:, i, None], alpha[:, i - 1] if i else 0)
        beta, expected = np.ones((n, 3)), np.zeros((3, 3))
        gamma = np.zeros((n, width, 3))
        for i in range(width - 1, -1, -1):
            gamma[:, i] = alpha[:, i] * beta
            if i:
                step = emit[:, i] * beta / scale[:, i, None]
                both = np.einsum("na,ab,nb->ab", np.where(real[:, i, None], alpha[:, i - 1], 0), moves, np.where(real[:, i, None], step, 0))
                expected += both
                beta = np.where(real[:, i, None], step @ moves.T, beta)
        chance = gamma[at]
        chance /= chance.sum(axis=1, keepdims=True)
        wrong = chance.copy()
        wrong[np.arange(len(tags)), tags] -= 1
        g = np.stack([np.bincount(tokens.features.ravel(), np.repeat(wrong[:, k], tokens.features.shape[1]), BUCKETS) for k in range(3)], axis=1)
        g_first = chance[place == 0].sum(axis=0) - true_first
        for weights, gradient, square in zip((emission, transition, first), (g / n + L2 * emission, (expected - true_pairs) / n, g_first / n), squares, strict=True):
            square += gradient**2
            weights -= RATE * gradient / np.sqrt(square)
        transition[OUT, INSIDE] = first[INSIDE] = BARRED
    return crf


# How secrets are written, and words that go before them, beside those of the base patterns; and what else is long.
ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-_", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
NAMES = ("password", "pass", "secret", "token", "auth", "key", "private key", "client_secret", "access-key", "credentials", "bearer", "login", "signing key", "session", "apikey")
NAME = re.compile(r"(?:password|passwd|secret|token|api_?key)(?=[\"']?\x20*[:=])", re.IGNORECASE)
PREFIXES = ("", "", "", "pk_", "key-", "glpat-", "AIza", "v1.")
MORE = 8
MARKS = (" = ", "=", ": ", ":", " is ", " ", ' = "', ": '")


def invented(r: random.Random) -> str:
    alphabet = r.choice(ALPHABETS)
    while True:
        body = "".join(r.choices(alphabet, k=r.randrange(16, 64)))
        if not body.isalpha() and not body.isdigit():
            return r.choice(PREFIXES) + body


def harmless(r: random.Random, words: list[str]) -> str:
    """A long token that is no secret, some of it of words of the text itself."""
    a, b, c = (r.choice(words) for _ in range(3))
    day = f"20{r.randrange(10, 30)}-{r.randrange(1, 13):02d}-{r.randrange(1, 29):02d}"
    return r.choice([
        a + b, a + b + c, a + b.title() + c.title(), f"{a}_{b}_{c}", f"{a}-{b}-{c}", f"{a}_{b}".upper(), f"https://www.{a}.com/{b}/{c}{r.randrange(100)}.html", f"/usr/{a}/{b}/{c}.txt", f"{a}.{b}@{c}.org",
        day, f"{day}T{r.randrange(24):02d}:{r.randrange(60):02d}:00Z", str(r.randrange(10**16)), f"{r.randrange(10**9):,}.{r.randrange(100):02d}", f"{r.randrange(20)}.{r.randrange(20)}.{r.randrange(200)}", f"+{r.randrange(1, 99)} ({r.randrange(100, 999)}) {r.randrange(100, 999)}-{r.randrange(1000, 9999)}",
        f"{r.choice(NAMES)} of {a}", f"the {r.choice(NAMES)}: {a} {b}", f"{a}({b}={c})", (a + b + c).upper(), f"{a}{r.randrange(10**6)}",
    ])


def disguised(text: str, spans: list[tuple[int, int]], r: random.Random) -> tuple[str, list[tuple[int, int]]]:
    """A window with its secrets drawn anew and maybe other words before them; or with harmless long tokens put in."""
    if not spans:
        words = text.split(" ")
        short = [w for w in words if w.isalpha() and len(w) < 12] or ["word"]
        for _ in range(6):
            words.insert(r.randrange(len(words) + 1), harmless(r, short))
        return " ".join(words), []
    out, found, at = "", [], 0
    for s, e in spans:
        named = list(NAME.finditer(text, at, s))
        before = text[at : named[-1].start()] if named else text[at:s]
        other = r.choice([w for w in before.split(" ") if w] or [""])
        out += before + r.choice([r.choice(NAMES), other, ""]) + r.choice(MARKS)
        secret = invented(r)
        found.append((len(out), len(out) + len(secret)))
        out, at = out + secret, e
    return out + text[at:], found


def guises(windows: list[tuple[str, list[tuple[int, int]]]], seeds: list[int], most: int) -> list[tuple[str, list[tuple[int, int]]]]:
    """A disguise of each window, and where few windows have secrets, as many of each as make up for that, but MORE at most."""
    times = min(MORE, max(1, most // max(1, sum(bool(s) for _, s in windows))))
    return [disguised(*w, random.Random(f"{h} {i}")) for w, h in zip(windows, seeds, strict=True) for i in range(times if w[1] else 1)]


def window(text: str) -> tuple[str, list[int]]:
    """What is around a text's first base match, or its middle where there is none, and the labels' bounds in it."""
    found = secret_spans(text)
    centre = (found[0][0] + min(found[0][1], found[0][0] + WINDOW)) // 2 if found else len(text) // 2
    low, high = max(0, centre - WINDOW // 2), centre + WINDOW // 2
    return text[low:high], [x for s, e in found if s < high and e > low for x in (max(s, low) - low, min(e, high) - low)]


def sampler(most: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow function: a task's distinct windows (has, h, text, spans) of the least hashes, at most so many of either sort."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[bool, dict[int, tuple[str, list[int]]]] = {True: {}, False: {}}
        worst: dict[bool, list[int]] = {True: [], False: []}  # the hashes kept, negative: a heap whose first is the largest
        for block in blocks(batches):
            for text in block["text"].to_pylist():
                if text:
                    cut, spans = window(text)
                    has, h = bool(spans), xxhash.xxh64_intdigest(cut.encode()) >> 1
                    if h not in kept[has] and (len(worst[has]) < most or h < -worst[has][0]):
                        kept[has][h] = cut, spans
                        heapq.heappush(worst[has], -h)
                        if len(worst[has]) > most:
                            del kept[has][-heapq.heappop(worst[has])]
        rows = [(has, h, *kept[has][h]) for has in kept for h in kept[has]]
        if rows:
            has, h, cut, spans = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(h, pa.int64()), pa.array(cut), pa.array(spans, pa.list_(pa.int32()))], names=["has", "h", "text", "spans"])

    return run


def train(df: DataFrame, text_col: str = "text", train_windows: int = TRAIN_WINDOWS) -> Crf:
    """A CRF from at most train_windows distinct windows of the texts of df, half with base matches, chosen by a hash, and their disguises."""
    half = train_windows // 2
    texts = prepared(df.select(text_or_empty(text_col).alias("text")))
    found = durable(texts.mapInArrow(sampler(half), "has boolean, h long, text string, spans array<int>").groupBy("has", "h").agg(F.any_value(F.struct("text", "spans")).alias("w")))
    # Hashes are even, so about as many as wanted, and a third more, lie below this; no sort has to gather all tasks' windows.
    bounds = {r["has"]: min((1 << 63) - 1, int((1 << 63) * 1.3 * half / r["n"])) for r in found.groupBy("has").agg(F.count(F.lit(1)).alias("n")).collect()}
    least = reduce(or_, [(F.col("has") == has) & (F.col("h") < bound) for has, bound in bounds.items()], F.lit(False))
    near = sorted(found.where(least).select("has", "h", "w.*").collect(), key=lambda r: r["h"])
    rows = sorted((r for has in bounds for r in [r for r in near if r["has"] == has][:half]), key=lambda r: r["h"])
    plain = [(r["text"], list(zip(r["spans"][::2], r["spans"][1::2], strict=True))) for r in rows]
    return fitted(sorted(plain + guises(plain, [r["h"] for r in rows], half)))


def added_spans(crf: Crf, texts: list[str], base: list[list[Span]]) -> list[list[Span]]:
    """Secrets that the CRF tags, of at least MIN_ADDED code points, without white space and not letters alone, which don't overlap base spans."""
    long = [i for i, t in enumerate(texts) if len(t) > PART] if len(texts) > 1 else []
    if long:
        short = [i for i in range(len(texts)) if i not in set(long)]
        found = dict(zip(short, added_spans(crf, [texts[i] for i in short], [base[i] for i in short]), strict=True))
        return [found[i] if i in found else added_spans(crf, [t], [base[i]])[0] for i, t in enumerate(texts)]
    tokens, scores = crf.read(texts)
    tags = crf.decode(tokens, scores)
    out: list[list[Span]] = [[] for _ in texts]
    bounds = [([s for _, s, _ in b], [0, *accumulate((e for _, _, e in b), max)]) for b in base]
    for i in np.flatnonzero(tags == BEGIN):
        j = i
        while j + 1 < len(tags) and tags[j + 1] == INSIDE and tokens.doc[j + 1] == tokens.doc[i] and tokens.start[j + 1] == tokens.end[j]:
            j += 1
        d, s, e = int(tokens.doc[i]), int(tokens.start[i]), int(tokens.end[j])
        starts, reach = bounds[d]
        if e - s >= MIN_ADDED and s >= reach[bisect_left(starts, e)] and not texts[d][s:e].isalpha():
            out[d].append(("secret", s, e))
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def finder(sent) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = sent.value
        for block in blocks(batches, limit=2 << 20):
            texts = block["text"].to_pylist()
            base = [base_spans(t) for t in texts]
            spans = [sorted(b + a, key=lambda s: (s[1], ALL_KINDS.index(s[0]), s[2])) for b, a in zip(base, added_spans(crf, texts, base), strict=True)]
            counts = [pa.array([sum(k == kind for k, _, _ in b) for b in base], pa.int64()) for kind in KINDS]
            columns = [block["doc_id"], *counts, pa.array(map(written, base), pa.string()), pa.array(map(written, spans), pa.string())]
            yield from pa.table(columns, names=["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans"]).to_batches()

    return run


def secrets(df: DataFrame, crf: Crf | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base and spans of every row of df.

    base and spans are kind:start:end (code points, end exclusive), comma-joined, by start, then kind as in ALL_KINDS.
    Null and empty texts have none; repeated rows give repeated rows; null ids stay null; no rows give no rows.
    """
    crf = crf or train(df, text_col)
    texts = keyed_texts(df, id_col, text_col)
    sent = df.sparkSession.sparkContext.broadcast(crf)
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return texts.mapInArrow(finder(sent), f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, {counts}, base string, spans string")


def op8_crf_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")
