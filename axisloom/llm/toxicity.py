"""Toxicity by gradient-boosted trees over dense features of whole texts, with isotonic calibration.

Features: densities of a lexicon learnt from labelled rows, words in the second person and how near they stand to it,
capitals, punctuation, and rates of obfuscated writing (digits and signs for letters, stretched and parted letters).
All but a few are sums over pieces of a text, so a text of any length is read through in bounded memory.
"""

from __future__ import annotations

import bisect
import functools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisloom.llm import common, pretoken, words

# Words of the second person (English, German, French, Spanish).
SECOND_PERSON = (
    "you your yours yourself yourselves u ur du dich dir dein deine deinen deinem deiner euch euer eure ihr "
    "tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros vuestro vuestra"
).split()
# Digits and signs that are written for letters.
WRITTEN_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

#: Letters of a word's beginning that can be a lexicon entry; longer words count as their own entries too.
PREFIXES = (4, 5, 6, 7, 8)
#: Characters of a text that are looked at together; a piece ends beside a blank where it can.
PIECE = 1 << 17
NEAR = 5
STRONG = 3.0
NAMES = (
    "words strong strong_each strong_found medium medium_each weight weight_most repeated repeated_each repeated_most second_person second_person_near second_person_next "
    "capitals capital_words exclamations questions punctuation punctuation_runs digits replaced replaced_hits stretched stretched_hits parted parted_hits word_length"
).split()


@functools.cache
def _upper() -> np.ndarray:
    """Whether a code point is an upper-case letter."""
    out = np.zeros(0x110000, bool)
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    at = np.array(points)
    for m in regex.finditer(r"\p{Lu}+", "".join(map(chr, points))):
        out[at[m.start() : m.end()]] = True
    return out


@functools.cache
def _folded() -> np.ndarray:
    """The lower-case letter of every code point, where that is one code point."""
    out = np.arange(0x110000, dtype=np.int32)
    for p in np.flatnonzero(_upper()).tolist():
        low = chr(p).lower()
        if len(low) == 1:
            out[p] = ord(low)
    return out


@functools.cache
def _letter_for() -> np.ndarray:
    out = np.zeros(128, np.int32)
    for c, x in WRITTEN_FOR.items():
        out[ord(c)] = ord(x)
    return out


def word_hash(word: str) -> np.uint64:
    points = np.array([ord(c) for c in word], np.int32)
    return words.segment_hashes(points, np.array([0]), np.array([len(points)]))[0]


@dataclass
class Lexicon:
    """Entries by hash, sorted: beginnings of words and whole words, each with its weight (a log ratio of odds).

    ``repeated`` holds beginnings that tell something where a text has them twice or more.
    """

    entries: dict[tuple[str, bool], float] = field(default_factory=dict)
    repeated: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        held = sorted((int(word_hash(w)), v) for w, v in self.repeated.items())
        self.again = np.array([h for h, _ in held], np.uint64), np.array([v for _, v in held])
        self.tables = []
        for whole in (False, True):
            held = sorted((int(word_hash(w)), v) for (w, k), v in self.entries.items() if k == whole)
            self.tables.append((np.array([h for h, _ in held], np.uint64), np.array([v for _, v in held])))
        self.second = np.sort(np.array([word_hash(w) for w in SECOND_PERSON], np.uint64))

    def _find(self, table: tuple[np.ndarray, np.ndarray], h: np.ndarray) -> np.ndarray:
        keys, values = table
        if not len(keys):
            return np.zeros(len(h))
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where(keys[at] == h, values[at], 0.0)

    def weights(self, points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The weight of each word [begin, end): the greatest of its entries, 0 if it has none."""
        if not len(begin):
            return np.zeros(0)
        out = self._find(self.tables[1], words.segment_hashes(points, begin, end))
        for p in PREFIXES:
            long = np.flatnonzero(end - begin >= p)
            if len(long) and len(self.tables[0][0]):
                out[long] = np.maximum(out[long], self._find(self.tables[0], words.segment_hashes(points, begin[long], begin[long] + p)))
        return out

    def repeats(self, points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, number of the entry that it begins with) for every such pair."""
        keys = self.again[0]
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for p in PREFIXES if len(keys) else ():
            long = np.flatnonzero(end - begin >= p)
            h = words.segment_hashes(points, begin[long], begin[long] + p) if len(long) else np.zeros(0, np.uint64)
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            on = keys[at] == h
            found.append((long[on], at[on]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def is_second(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.second, h), len(self.second) - 1)
        return self.second[at] == h


def _runs(on: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[begin, end) of the stretches where ``on`` holds; none crosses one of ``cuts``."""
    if not len(on):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    head = np.ones(len(on) + 1, bool)
    head[1:-1] = on[1:] != on[:-1]
    head[cuts] = True
    edge = np.flatnonzero(head)
    begin, end = edge[:-1], edge[1:]
    keep = on[begin]
    return begin[keep], end[keep]


def _rewritten(points: np.ndarray, keep: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The kept code points of some stretches one after the other, and where each stretch lies among them."""
    at = pretoken.ranges(begin, end - begin)
    on = keep[at]
    sums = np.append(0, np.cumsum(on))
    size = np.append(0, np.cumsum(end - begin))
    return points[at[on]], sums[size[:-1]], sums[size[1:]]


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code points, folded ones, classes, first of each text, begin and end of words) of neighbouring texts."""
    part = data[off[0] : off[-1]]
    lead, points = pretoken.code_points(part)
    first = np.searchsorted(lead, off - off[0])
    kind = pretoken.classes()[points]
    begin, end = _runs(kind == pretoken.LETTER, first)
    return points, _folded()[points], kind, first, begin, end


#: What is counted for every piece; ``MAXIMA`` are the columns that are greatest values rather than sums.
COUNTS = "chars words letters word_hits strong medium weight second near capitals capital_words exclaim question punct punct_runs digits replaced replaced_hits stretched stretched_hits parted parted_hits most next".split()
MAXIMA = (COUNTS.index("most"), COUNTS.index("next"))


def counts(data: np.ndarray, off: np.ndarray, lexicon: Lexicon) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(counts by text, hashes of the strong entries' words of each text, uses of every entry that counts when repeated) of neighbouring texts."""
    n = len(off) - 1
    points, low, kind, first, begin, end = word_bounds(data, off)
    total = {}

    def by_text(at: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(np.searchsorted(first, at, "right") - 1, values, n)[:n] if len(at) else np.zeros(n)

    upper = _upper()[points]
    size = end - begin
    h = words.segment_hashes(low, begin, end) if len(begin) else np.zeros(0, np.uint64)
    weight = lexicon.weights(low, begin, end)
    total["chars"], total["words"], total["letters"] = np.diff(first), by_text(begin), by_text(begin, size)
    hit, strong = weight > 0, weight >= STRONG
    total["word_hits"], total["strong"], total["medium"] = by_text(begin[hit]), by_text(begin[strong]), by_text(begin[hit & ~strong])
    total["weight"] = by_text(begin, weight)
    second = lexicon.is_second(h) if len(h) else np.zeros(0, bool)
    total["second"] = by_text(begin[second])
    # how many words lie between an entry and the nearest word in the second person of the same text
    text_of = np.searchsorted(first, begin, "right") - 1
    number, near = np.arange(len(begin)), np.full(len(begin), 1 << 30)
    on = np.flatnonzero(second)
    if len(on) and hit.any():
        for side, at in (("left", np.searchsorted(on, number, "right") - 1), ("right", np.searchsorted(on, number, "left"))):
            ok = (at >= 0) if side == "left" else (at < len(on))
            at = np.clip(at, 0, len(on) - 1)
            ok &= text_of[on[at]] == text_of
            near = np.where(ok, np.minimum(near, np.abs(on[at] - number)), near)
    total["near"] = by_text(begin[hit & (near <= NEAR)])
    closeness = np.where(hit, 1 / (1.0 + near), 0)
    total["capitals"] = by_text(np.flatnonzero(upper))
    ups = np.append(0, np.cumsum(upper))
    total["capital_words"] = by_text(begin[(size > 1) & (ups[end] - ups[begin] == size)])
    total["exclaim"], total["question"] = by_text(np.flatnonzero(points == ord("!"))), by_text(np.flatnonzero(points == ord("?")))
    other = kind == pretoken.OTHER
    total["punct"], total["digits"] = by_text(np.flatnonzero(other)), by_text(np.flatnonzero(kind == pretoken.NUMBER))
    run_begin, run_end = _runs(other, first)
    total["punct_runs"] = by_text(run_begin[run_end - run_begin > 1])

    # digits and signs between letters or before them: rewritten as letters
    ascii_point = np.minimum(points, 127)
    letter_for = np.where(points < 128, _letter_for()[ascii_point], 0)
    wide_begin, wide_end = _runs((kind == pretoken.LETTER) | (letter_for > 0), first)
    letters = np.append(0, np.cumsum(kind == pretoken.LETTER))
    # signs at a word's end are punctuation: cut them
    last_letter = np.maximum.accumulate(np.where(kind == pretoken.LETTER, np.arange(len(points)), -1)) if len(points) else np.zeros(0, np.int64)
    wide_end = np.maximum(wide_begin, last_letter[wide_end - 1] + 1) if len(wide_end) else wide_end
    has = letters[wide_end] - letters[wide_begin]
    mixed = (has > 0) & (has < wide_end - wide_begin)
    mixed_begin, mixed_end = wide_begin[mixed], wide_end[mixed]
    spelled = np.where(letter_for > 0, letter_for, low)
    rewritten = lexicon.weights(spelled, mixed_begin, mixed_end) >= STRONG
    total["replaced"], total["replaced_hits"] = by_text(mixed_begin), by_text(mixed_begin[rewritten])

    # letters written three times or more: once
    same = np.zeros(len(low) + 1, bool)
    same[1:-1] = (low[1:] == low[:-1]) & (kind[1:] == pretoken.LETTER)
    same[first] = False
    triple = same[:-1] & np.append(False, same[:-2]) if len(low) else np.zeros(0, bool)
    if len(low) and triple.any():
        threes = np.append(0, np.cumsum(triple))
        drawn = threes[end] - threes[np.minimum(begin + 2, end)] > 0
        squeezed, b, e = _rewritten(low, ~same[: len(low)], begin[drawn], end[drawn])
        found = lexicon.weights(squeezed, b, e) >= STRONG
        total["stretched"], total["stretched_hits"] = by_text(begin[drawn]), by_text(begin[drawn][found & ~strong[drawn]])

    # single letters with one other character between them: joined
    single = size == 1
    follows = np.zeros(len(begin), bool)
    if len(begin):
        follows[1:] = single[1:] & single[:-1] & (begin[1:] - begin[:-1] == 2) & (text_of[1:] == text_of[:-1])
    chain_begin, chain_end = _runs(follows, np.zeros(0, np.int64))
    chain_begin = chain_begin - 1
    chain = chain_end - chain_begin >= 3
    if chain.any():
        chain_begin, chain_end = chain_begin[chain], chain_end[chain]
        joined, b, e = low[begin[pretoken.ranges(chain_begin, chain_end - chain_begin)]], *(lambda s: (np.cumsum(s) - s, np.cumsum(s)))(chain_end - chain_begin)
        found = lexicon.weights(joined, b, e) >= STRONG
        total["parted"], total["parted_hits"] = by_text(begin[chain_begin]), by_text(begin[chain_begin][found])

    out = np.column_stack([total.get(c, np.zeros(n)) for c in COUNTS]).astype(np.float64)
    for column, values in zip(MAXIMA, (weight, closeness), strict=True):
        np.maximum.at(out[:, column], text_of, values)
    at = np.flatnonzero(strong)
    cut = np.searchsorted(text_of[at], np.arange(n + 1))
    uses = np.zeros((n, len(lexicon.again[0])), np.int64)
    word, entry = lexicon.repeats(low, begin, end)
    np.add.at(uses, (text_of[word], entry), 1)
    return out, [np.unique(h[at[a:b]]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], uses


def dense(c: np.ndarray, different: np.ndarray, uses: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """The features of texts from their counts, the number of their different strong words and the uses of entries."""
    x = dict(zip(COUNTS, c.T, strict=True))
    w, chars = np.maximum(x["words"], 1), np.maximum(x["chars"], 1)
    again = np.where(uses > 1, uses, 0)
    most_used = again.max(axis=1, initial=0)
    return np.column_stack([
        np.log1p(x["words"]), x["strong"] / w, np.minimum(x["strong"], 50), different, x["medium"] / w, np.minimum(x["medium"], 50), x["weight"] / w, x["most"],
        most_used / w, np.minimum(most_used, 20), np.where(again > 0, lexicon.again[1], 0).max(axis=1, initial=0),
        x["second"] / w, np.minimum(x["near"], 20), x["next"], x["capitals"] / np.maximum(x["letters"], 1), x["capital_words"] / w, x["exclaim"] / chars, x["question"] / chars,
        x["punct"] / chars, x["punct_runs"] / w, x["digits"] / chars, x["replaced"] / w, np.minimum(x["replaced_hits"], 20), x["stretched"] / w, np.minimum(x["stretched_hits"], 20),
        x["parted"] / w, np.minimum(x["parted_hits"], 20), x["letters"] / w,
    ])


def _cuts(part: np.ndarray) -> list[int]:
    """Where a long text is cut: after the last blank of every piece, else before a character."""
    out, at = [0], 0
    while len(part) - at > PIECE:
        to = at + PIECE
        blank = np.flatnonzero(part[at:to] <= 0x20)
        if len(blank):
            to = at + int(blank[-1]) + 1
        else:
            while to > at + 1 and part[to] & 0xC0 == 0x80:
                to -= 1
        out.append(to)
        at = to
    return [*out, len(part)]


def features(data: np.ndarray, off: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """The features of neighbouring texts; of a long one, counts of its pieces are added up."""
    made = []
    for i, j in common.groups(off):
        if off[j] - off[i] <= PIECE or j - i > 1:
            c, strong, uses = counts(data, off[i : j + 1], lexicon)
            made.append(dense(c, np.array([len(s) for s in strong], float), uses, lexicon))
            continue
        part = data[off[i] : off[j]]
        edges = _cuts(part)
        sums, found, total = np.zeros(len(COUNTS)), np.zeros(0, np.uint64), np.zeros((1, len(lexicon.again[0])), np.int64)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            c, strong, uses = counts(part, np.array([a, b]), lexicon)
            total += uses
            most = np.maximum(sums, c[0])
            sums = sums + c[0]
            sums[list(MAXIMA)] = most[list(MAXIMA)]
            found = np.union1d(found, strong[0])
        made.append(dense(sums[None], np.array([len(found)], float), total, lexicon))
    return np.concatenate(made) if made else np.zeros((0, len(NAMES)))


BINS = 48


class Trees:
    """Boosted trees of fixed depth for the logistic loss, by histograms of binned features."""

    def __init__(self, depth: int = 3):
        self.depth, self.start = depth, 0.0
        self.edges: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(self.edges)]) if len(self.edges) else np.zeros((len(x), 0), np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 120, rate: float = 0.1, smooth: float = 2.0) -> Trees:
        self.edges = [np.unique(np.quantile(x[:, k], np.arange(1, BINS) / BINS, method="lower")) for k in range(x.shape[1])]
        b = self._binned(x)
        n, k = b.shape
        mean = np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)
        self.start = float(np.log(mean / (1 - mean)))
        score = np.full(n, self.start)
        columns = np.arange(k) * BINS
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = weight * (y - p), weight * p * (1 - p)
            inner = (1 << self.depth) - 1
            split_on, split_at = np.zeros(inner, np.int64), np.full(inner, BINS)
            node = np.zeros(n, np.int64)
            for d in range(self.depth):
                base = (1 << d) - 1
                key = ((node - base)[:, None] * k * BINS + columns + b).ravel()
                shape = (1 << d, k, BINS)
                gs = np.bincount(key, np.repeat(g, k), (1 << d) * k * BINS).reshape(shape).cumsum(axis=2)
                hs = np.bincount(key, np.repeat(h, k), (1 << d) * k * BINS).reshape(shape).cumsum(axis=2)
                gt, ht = gs[:, :, -1:], hs[:, :, -1:]
                gain = gs**2 / (hs + smooth) + (gt - gs) ** 2 / (ht - hs + smooth) - gt**2 / (ht + smooth)
                gain[(hs < 1) | (ht - hs < 1)] = 0
                flat = gain.reshape(1 << d, -1)
                best = flat.argmax(axis=1)
                useful = flat[np.arange(1 << d), best] > 1e-9
                split_on[base : base + (1 << d)] = np.where(useful, best // BINS, 0)
                split_at[base : base + (1 << d)] = np.where(useful, best % BINS, BINS)
                node = 2 * node + 1 + (b[np.arange(n), split_on[node]] > split_at[node])
            leaf = node - inner
            gs, hs = np.bincount(leaf, g, 1 << self.depth), np.bincount(leaf, h, 1 << self.depth)
            value = rate * gs / (hs + smooth)
            self.trees.append((split_on, split_at, value))
            score += value[leaf]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        if not self.trees or not len(x):
            return out
        b, inner = self._binned(x), (1 << self.depth) - 1
        for split_on, split_at, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[np.arange(len(x)), split_on[node]] > split_at[node])
            out += value[node - inner]
        return out


def isotonic(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scores, probabilities) of the rising function nearest to the labels: neighbours that fall are pooled."""
    at, group = np.unique(score, return_inverse=True)
    w, s = np.bincount(group, weight), np.bincount(group, weight * y)
    blocks: list[list[float]] = []  # weight, weighted labels, first, last
    for k in range(len(at)):
        blocks.append([w[k], s[k], k, k])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            b = blocks.pop()
            blocks[-1] = [blocks[-1][0] + b[0], blocks[-1][1] + b[1], blocks[-1][2], b[3]]
    # one weight's worth of doubt keeps probabilities off 0 and 1
    xs, ps = [], []
    for bw, bs, a, b in blocks:
        p = (bs + 0.5 * weight.mean()) / (bw + weight.mean())
        xs += [at[a], at[b]]
        ps += [p, p]
    return np.array(xs), np.maximum.accumulate(np.array(ps)) if ps else np.zeros(0)


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees
    at: np.ndarray
    probability: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.at):
            return np.full(len(x), self.prior)
        raw = self.trees.score(x)
        # scores within a pooled block differ by a hair, so that they still rank
        return np.clip(np.interp(raw, self.at, self.probability) + 1e-6 * np.tanh(raw / 4), 0, 1)


def _entries(found: DataFrame, most: int) -> list:
    """Word beginnings and whole words of labelled texts with the number of texts of each class and half that hold them.

    n10: of class 1 and half 0 that hold it, m10: that hold it twice or more, and so on. Counted by tasks first. Kept:
    those that stand out most in class 1 by either count, at most ``4 * most``.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = common.text_buffers(batch.column("t"))
            for r, (y, half) in enumerate(zip(batch.column("y").to_pylist(), batch.column("half").to_pylist(), strict=True)):
                part = data[off[r] : off[r + 1]]
                seen: Counter[tuple[str, bool]] = Counter()
                edges = _cuts(part)
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    _, low, _, _, begin, end = word_bounds(part, np.array([a, b]))
                    text = low.astype("<u4").tobytes().decode("utf-32-le", "replace")
                    for w, k in Counter(text[p:q] for p, q in zip(begin.tolist(), end.tolist(), strict=True)).items():
                        for p in PREFIXES:
                            if len(w) >= p:
                                seen[w[:p], False] += k
                        if 2 <= len(w) <= 40:
                            seen[w, True] += k
                rows = list(seen.items())
                for at in range(0, len(rows), 20_000):
                    some = rows[at : at + 20_000]
                    cols = [pa.array([w for (w, _), _ in some], pa.string()), pa.array([k for (_, k), _ in some], pa.bool_()), pa.array([k > 1 for _, k in some], pa.bool_()), pa.array([y] * len(some), pa.int32()), pa.array([half] * len(some), pa.int32())]
                    yield pa.RecordBatch.from_arrays(cols, names=["w", "whole", "twice", "y", "half"])

    rows = found.select("t", "y", "half").mapInArrow(step, "w string, whole boolean, twice boolean, y int, half int")
    of = [(y, half, (F.col("y") == y) & (F.col("half") == half)) for y in (0, 1) for half in (0, 1)]
    tally = rows.groupBy("w", "whole").agg(*(F.count_if(on).alias(f"n{y}{half}") for y, half, on in of), *(F.count_if(on & F.col("twice")).alias(f"m{y}{half}") for y, half, on in of))
    out = [(F.col(f"{c}10") + F.col(f"{c}11")) / (F.col(f"{c}00") + F.col(f"{c}01") + 2) * F.log(F.col(f"{c}10") + F.col(f"{c}11") + 1) for c in "nm"]
    return tally.where("n10 + n11 >= 3").orderBy(F.desc(F.greatest(*out)), "w", "whole").limit(4 * most).collect()


def _telling(rows: list[tuple[str, bool, float, float]], n1: float, n0: float, most: int) -> dict[tuple[str, bool], float]:
    """Of (word, whole, texts of class 1, other texts) those whose share in class 1 is well above that among others.

    A beginning gives way to a longer one, or to a word, that nine tenths of its texts of class 1 hold.
    """
    held = []
    for w, whole, a, b in rows:
        if a < 3:
            continue
        weight = float(np.log((a + 0.25) / (n1 + 0.5)) - np.log((b + 0.25) / (n0 + 0.5)))
        # by how many deviations more often than by chance
        expected = (a + b) * n1 / (n1 + n0)
        if weight >= 1.5 and a - expected >= 3.5 * np.sqrt(expected * n0 / (n1 + n0) + 0.05):
            held.append((w, whole, a, weight))
    held.sort()
    kept = []
    for k, (w, whole, a, weight) in enumerate(held):
        to = bisect.bisect_left(held, (w + chr(0x10FFFF),))
        if whole or all(x[2] < 0.9 * a for x in held[k + 1 : to]):
            kept.append((-weight * np.log1p(a), w, whole, weight))
    return {(w, whole): v for _, w, whole, v in sorted(kept)[:most]}


def _lexicon(rows: list, n: dict[tuple[int, int], int], halves: tuple[int, ...], most: int) -> Lexicon:
    """Learnt from the given halves of the sample; a half alone counts double, so that it stands for the whole."""
    k = 2 / len(halves)
    n1, n0 = (k * sum(n.get((y, f), 0) for f in halves) for y in (1, 0))
    of = lambda c, y, r: k * sum(r[f"{c}{y}{f}"] for f in halves)
    entries = _telling([(r.w, r.whole, of("n", 1, r), of("n", 0, r)) for r in rows], n1, n0, most)
    again = _telling([(r.w, False, of("m", 1, r), of("m", 0, r)) for r in rows if not r.whole], n1, n0, most // 4)
    return Lexicon(entries, {w: v for (w, _), v in again.items()})


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = 3000, most: int = 400) -> Model:
    """Learn from labelled rows whose crc32(key as text) mod 5 isn't 0.

    A bounded sample is fitted: of the labelled rows of each class that have a text, the ``sample`` rows that come first
    by a hash of the key. Their texts, whole and of any length, stay with the tasks: lexicon entries are counted there,
    at most ``4 * most`` of which come to the driver with ``2 * sample`` rows of features. The halves of the sample
    (by another hash) are looked at through the lexicon of the other half, so trees see entries as new texts show them;
    the calibration is fitted on scores of trees that the row had no part in. Rows weigh as their class does among all
    labels. Labels that aren't 0 or 1, null keys and null texts are left out; a key labelled both ways stands in both
    classes; labels and rows that repeat count once. Without rows of both classes the score is the share of ones.
    """
    known = labels.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").cast("int").alias("y")).where("k is not null and y in (0, 1)").where(F.crc32(F.col("k").cast("string")) % 5 != 0).distinct()
    total = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    prior = total.get(1, 0) / max(1, sum(total.values())) if total else 0.5
    untrained = Model(Lexicon(), Trees(), np.zeros(0), np.zeros(0), prior)
    if len(total) < 2:
        return untrained
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).where("k is not null and t is not null")
    held = known.join(rows.select("k"), "k", "left_semi")
    order = [F.xxhash64("k"), F.col("k")]
    picked = held.where("y = 0").orderBy(*order).limit(sample).unionAll(held.where("y = 1").orderBy(*order).limit(sample))
    half = (F.crc32(F.concat(F.lit("half "), F.col("k").cast("string"))) % 2).cast("int").alias("half")
    common.bounded_batches(docs.sparkSession)
    found = common.written(rows.join(F.broadcast(picked), "k").distinct().select("k", "t", "y", half), "labelled")  # at most 2 * sample keys
    n = {(r.y, r.half): r.n for r in found.groupBy("y", "half").agg(F.count("*").alias("n")).collect()}
    size = [sum(n.get((y, f), 0) for f in (0, 1)) for y in (0, 1)]
    if not all(size):
        common.dropped(found)
        return untrained
    entries = _entries(found, most)
    lexicon, *others = (_lexicon(entries, n, halves, most) for halves in ((0, 1), (1,), (0,)))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = common.text_buffers(batch.column("t"))
            halves = batch.column("half").to_numpy()
            x = np.where((halves == 0)[:, None], features(data, off, others[0]), features(data, off, others[1]))
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("y"), batch.column("half"), pa.array(list(x), pa.list_(pa.float64()))], names=["k", "y", "half", "x"])

    kind = found.schema["k"].dataType.simpleString()
    got = found.select("k", "t", "y", "half").mapInArrow(step, f"k {kind}, y int, half int, x array<double>").collect()
    common.dropped(found)
    got.sort(key=lambda r: (str(r.k), r.y, r.x))
    x, y, fold = np.array([r.x for r in got]), np.array([r.y for r in got], float), np.array([r.half for r in got])
    share = np.array([total[0] / size[0], total[1] / size[1]])
    weight = share[y.astype(int)] / np.average(share, weights=np.array(size))
    held_out = np.full(len(y), np.nan)
    for f in (0, 1):
        if 0 < y[fold != f].sum() < (fold != f).sum():
            held_out[fold == f] = Trees().fit(x[fold != f], y[fold != f], weight[fold != f]).score(x[fold == f])
    ok = ~np.isnan(held_out)
    at, p = isotonic(held_out[ok], y[ok], weight[ok])
    return Model(lexicon, Trees().fit(x, y, weight), at, p, prior)


def toxicity_scores(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row for each document: ``doc_id``, ``held_out``, ``score`` and ``predicted``.

    Null texts are scored as empty ones. Null keys (held_out null) and repeated rows are kept.
    """
    common.bounded_batches(docs.sparkSession)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = common.text_buffers(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(features(data, off, model.lexicon)), pa.float64())], names=["doc_id", "score"])

    kind = docs.schema[key].dataType.simpleString()
    scored = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(common.tidied(step), f"doc_id {kind}, score double")
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
