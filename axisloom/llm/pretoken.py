"""Splitting text before byte-level BPE, and encoders that meet each different word once.

The split is that of the pattern published with the vocabularies (public_tokenizers.PATTERN): contractions,
then letters, numbers or other signs with one blank before them, then white space. It is done on arrays of
code point classes instead of by a backtracking engine.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import regex

from axisloom.llm import words

SPACE, LETTER, NUMBER, OTHER = range(4)


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    text = "".join(map(chr, points))
    at = np.array(points)
    for kind, pattern in ((SPACE, r"\p{White_Space}+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, text):
            out[at[m.start() : m.end()]] = kind
    return out


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte position, code point) of every character of valid UTF-8."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    points = data[lead].astype(np.int32)
    many = np.flatnonzero(points >= 0xC0)
    if len(many):
        at, first = lead[many], points[many]
        n = 2 + (first >= 0xE0) + (first >= 0xF0)
        value = first & np.where(n == 2, 0x1F, np.where(n == 3, 0x0F, 0x07))
        for k in (1, 2, 3):
            on = n > k
            value[on] = value[on] << 6 | (data[at[on] + k] & 0x3F)
        points[many] = value
    return lead, points


def token_starts(data: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Byte positions at which the words of the pattern begin; none crosses one of ``doc_starts``."""
    lead, points = code_points(data)
    n = len(lead)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    new_doc = np.zeros(n + 1, bool)
    new_doc[np.searchsorted(lead, doc_starts[doc_starts < len(data)])] = True
    new_doc[0] = new_doc[n] = True
    change = new_doc[:n].copy()
    change[1:] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(change)
    end = np.append(run[1:], n)
    of = kind[run]
    starts = np.zeros(n, bool)
    starts[run] = True
    # white space before something else in its document: the last of it stands apart, a blank joins what follows
    before = np.flatnonzero((of == SPACE) & ~new_doc[end])
    last = end[before] - 1
    starts[last] = True
    blank = points[last] == 0x20
    starts[end[before][blank]] = False
    # contractions: one apostrophe that begins a word, then letters
    single = np.flatnonzero((points[run] == 0x27) & (end - run == 1) & (of == OTHER) & starts[run] & ~new_doc[end])
    single = single[of[np.minimum(single + 1, len(of) - 1)] == LETTER]
    if len(single):
        a = run[single] + 1
        room = end[single + 1] - a
        x = points[a]
        y = np.where(room > 1, points[np.minimum(a + 1, n - 1)], 0)
        one = np.isin(x, [ord(c) for c in "stmd"])
        two = ((x == ord("r")) & (y == ord("e"))) | ((x == ord("v")) & (y == ord("e"))) | ((x == ord("l")) & (y == ord("l")))
        for hit, size in ((one, 1), (two & ~one, 2)):
            starts[a[hit]] = False
            rest = hit & (room > size)
            starts[a[rest] + size] = True
    return lead[starts]


class WordTable:
    """Open-addressed map from 64-bit hashes to consecutive numbers, in arrays."""

    def __init__(self, bits: int = 16):
        self.size, self.keys, self.values = 0, np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        mask = np.uint64(len(self.keys) - 1)
        out = np.full(len(h), -1, np.int32)
        left, slot = np.arange(len(h)), h & mask
        while len(left):
            key = self.keys[slot]
            hit = key == h[left]
            out[left[hit]] = self.values[slot[hit]]
            on = ~hit & (key != 0)
            left, slot = left[on], slot[on] + np.uint64(1) & mask
        return out

    def _place(self, h: np.ndarray, values: np.ndarray) -> None:
        mask = np.uint64(len(self.keys) - 1)
        slot = h & mask
        while len(h):
            free = np.flatnonzero(self.keys[slot] == 0)
            _, first = np.unique(slot[free], return_index=True)
            took = free[first]
            self.keys[slot[took]], self.values[slot[took]] = h[took], values[took]
            on = np.ones(len(h), bool)
            on[took] = False
            h, values, slot = h[on], values[on], slot[on] + np.uint64(1) & mask

    def add(self, h: np.ndarray) -> None:
        """Numbers different hashes that aren't held yet."""
        if 2 * (self.size + len(h)) > len(self.keys):
            held = self.keys != 0
            keys, values = self.keys[held], self.values[held]
            bits = int(2 * (self.size + len(h))).bit_length()
            self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
            self._place(keys, values)
        self._place(h, np.arange(self.size, self.size + len(h), dtype=np.int32))
        self.size += len(h)


def ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All positions of the ranges, one range after the other."""
    return np.arange(int(count.sum())) + np.repeat(begin - (np.cumsum(count) - count), count)


class WordEncoder:
    """Encodes texts word by word; ``encode_new`` gets each word that isn't known yet once.

    ``texts`` numbers the words of texts and keeps the unknown ones; ``learn`` encodes these. At most
    ``most`` words are kept from one ``learn`` to the next.
    """

    def __init__(self, encode_new: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int = 1_000_000):
        self.encode_new, self.most = encode_new, most
        self.reset()

    def reset(self) -> None:
        self.table = WordTable()
        self.ids, self.off, self.fresh = np.zeros(0, np.int32), np.zeros(1, np.int64), []

    def starts(self, part: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Where the words of the texts in ``part`` begin."""
        return token_starts(part, off[:-1])

    def texts(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word numbers, word offsets by text) of neighbouring texts in ``data``."""
        lo, hi = int(off[0]), int(off[-1])
        part = data[lo:hi]
        begin = self.starts(part, off - lo)
        if not len(begin):
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        end = np.append(begin[1:], len(part))
        h = words.segment_hashes(part, begin, end)
        h[h == 0] = np.uint64(1)
        number = self.table.find(h)
        new = np.flatnonzero(number < 0)
        if len(new):
            unique, first = np.unique(h[new], return_index=True)
            self.table.add(unique)
            at = new[first]
            raw = part.tobytes()
            self.fresh.extend(raw[s:e] for s, e in zip(begin[at].tolist(), end[at].tolist(), strict=True))
            number[new] = self.table.find(h[new])
        return number, np.searchsorted(begin, off - lo)

    def learn(self) -> None:
        if self.fresh:
            ids, count = self.encode_new(self.fresh)
            self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
            self.off = np.concatenate([self.off, self.off[-1] + np.cumsum(count)])
            self.fresh = []

    def spell(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(token ids, how many for each word)."""
        count = self.off[numbers + 1] - self.off[numbers]
        return self.ids[ranges(self.off[numbers], count)], count

    def trim(self) -> None:
        if self.table.size > self.most:
            self.reset()
