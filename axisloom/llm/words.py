"""Words of UTF-8 text as arrays: boundaries, 64-bit hashes and hashes of word runs.

Both word patterns in use are sets of bytes: every byte of a code point above 0x7F belongs to a
word, so splitting bytes and splitting code points give the same words.
"""

from __future__ import annotations

import numpy as np

#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(separators: str) -> np.ndarray:
    out = np.ones(256, bool)
    out[[ord(c) for c in separators]] = False
    return out


#: [^\x20\x09-\x0D]+
BLANK_WORDS = byte_class(" \t\n\v\f\r")
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALNUM_WORDS = np.ones(256, bool)
ALNUM_WORDS[0x00:0x30] = ALNUM_WORDS[0x3A:0x61] = ALNUM_WORDS[0x7B:0x80] = False

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MOD = 1 << 64
_POW: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

_rng = np.random.default_rng(20240229)
#: Odd multipliers for the words of a run, first to last, and for its length.
RUN = (_rng.integers(0, 1 << 63, 16, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    if len(_POW[0]) <= n:
        size = 1 << int(n + 1).bit_length()
        for k, base in ((0, int(_BASE)), (1, pow(int(_BASE), -1, _MOD))):
            have = np.ones(1, np.uint64)
            while len(have) < size:
                have = np.concatenate([have, have * np.uint64(pow(base, len(have), _MOD))])
            _POW[k] = have
    return _POW[0], _POW[1]


def segment_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte segments [start, end) of ``data``, equal for equal bytes."""
    up, down = _powers(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * RUN[15])


def split(data: np.ndarray, starts: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of the words in ``data``, lower-cased already; none crosses one of ``starts``."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inside = kind[data]
    first = np.ones(len(data) + 1, bool)
    first[1:-1] = ~inside[:-1]
    first[starts] = True
    begin = np.flatnonzero(inside & first[:-1])
    last = np.ones(len(data), bool)
    last[:-1] = ~inside[1:]
    cut = starts[(starts > 0) & (starts <= len(data))] - 1
    last[cut] = True
    end = np.flatnonzero(inside & last) + 1
    return begin, end, segment_hashes(data, begin, end)


def document_words(data: np.ndarray, off: np.ndarray, kind: np.ndarray, piece: int = (1 << 18) - 2) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of neighbouring documents: (start, end, hash) by byte of ``data``, and word offsets by document.

    A long stretch is taken in pieces that end beside a separator, so memory beyond the words stays bounded.
    """
    lo, hi = int(off[0]), int(off[-1])
    parts = []
    while lo < hi:
        to = min(hi, lo + piece)
        if to < hi:
            near = np.flatnonzero(~kind[LOWER[data[lo:to]]])
            if len(near):
                to = lo + int(near[-1]) + 1
            else:
                while to < hi and kind[LOWER[data[to]]]:
                    to = min(hi, to + 1)
        inner = off[(off >= lo) & (off < to)] - lo
        s, e, h = split(LOWER[data[lo:to]], inner, kind)
        parts.append((s + lo, e + lo, h))
        lo = to
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    start, end, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
    return start, end, hashes, np.searchsorted(start, off)


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of ``k`` words that begin at each word, while k words are left."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n] * RUN[0]
    for j in range(1, k):
        out += hashes[j : j + n] * RUN[j]
    return mix(out + np.uint64(k * int(RUN[14]) % _MOD))


def shingles(hashes: np.ndarray, word_off: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """For each document its sorted distinct k-word shingles; with fewer words the whole sequence is one."""
    grams = runs(hashes, k)
    out = []
    for a, b in zip(word_off[:-1].tolist(), word_off[1:].tolist(), strict=True):
        if b - a >= k:
            g = np.sort(grams[a : b - k + 1])
            keep = np.empty(len(g), bool)
            keep[0] = True
            np.not_equal(g[1:], g[:-1], out=keep[1:])
            out.append(g if keep.all() else g[keep])
        elif b > a:
            out.append(runs(hashes[a:b], b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
