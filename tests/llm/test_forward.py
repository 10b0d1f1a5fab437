"""Forward passes of the quality network and the language model against plain Python, window by window and subword by subword."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from axisloom.llm import langid, quality


def plain_quality(net, text):
    """One window after the other: every filter over its bytes, the maximum by chunk, then both pools."""
    embed, filters, bias = net.embed.tolist(), net.filters.tolist(), net.bias.tolist()
    windows = max(1, math.ceil(len(text) / quality.STEP))
    padded = text + bytes(quality.WIDTH)
    chunks = []
    for w in range(windows):
        x = [v for b in padded[w * quality.STEP :][: quality.WIDTH] for v in embed[b]]
        out = [bias[f] + sum(x[i] * filters[i][f] for i in range(len(x))) for f in range(quality.FILTERS)]
        if w % quality.CHUNK == 0:
            chunks.append(out)
        else:
            chunks[-1] = [max(a, b) for a, b in zip(chunks[-1], out, strict=True)]
    top = [max(c[f] for c in chunks) for f in range(quality.FILTERS)]
    mean = [sum(c[f] for c in chunks) / len(chunks) for f in range(quality.FILTERS)]
    s = sum(max(t, 0) * a + max(m, 0) * b for t, m, a, b in zip(top, mean, net.top.tolist(), net.mean.tolist(), strict=True))
    return 1 / (1 + math.exp(-(s + float(net.offset[0]) + float(net.prior[0]))))


@pytest.mark.parametrize("seed", [1, 2])
def test_quality_by_windows(seed):
    net, r = quality.Network(seed), random.Random(seed)
    rng = np.random.default_rng(seed)
    net.bias[:], net.offset[0], net.prior[0] = rng.normal(0, 0.3, quality.FILTERS), 0.2, -0.7
    texts = [b"", b"a", "Grüße, 北京".encode(), b"x" * 8, *(r.randbytes(n) for n in (7, 23, 24, 25, 255, 256, 257, 700, 1500))]
    want = [plain_quality(net, t) for t in texts]
    arrays = [np.frombuffer(t, np.uint8) for t in texts]
    assert np.abs(net.score(arrays) - want).max() < 1e-5
    # taken in pieces of one chunk and of three
    for piece in (quality.CHUNK * quality.STEP, 3 * quality.CHUNK * quality.STEP):
        assert max(abs(net.pool_long(t, piece)[0] - w) for t, w in zip(arrays, want, strict=True) if len(t)) < 1e-5


def plain_language(model, text):
    """The mean of the table's rows over all subwords of three and four bytes with a letter inside, then a softmax."""
    raw = [b if b >= 128 or chr(b).isalpha() else 32 for b in text.lower().encode()]
    mask, sums, n = (1 << 32) - 1, [0.0] * len(model.base), 0
    for i in range(len(raw)):
        found = []
        if i + 3 <= len(raw) and raw[i + 1] != 32:
            w = raw[i] | raw[i + 1] << 8 | raw[i + 2] << 16
            found.append((w * 2654435769 & mask) >> 32 - langid.BITS)
        if i + 4 <= len(raw) and raw[i + 1] != 32 and raw[i + 2] != 32:
            w = raw[i] | raw[i + 1] << 8 | raw[i + 2] << 16 | raw[i + 3] << 24
            found.append((((w * 2246822507 & mask) ^ 0x5BD1E995) * 3266489917 & mask) >> 32 - langid.BITS)
        for h in found:
            n += 1
            sums = [a + float(b) for a, b in zip(sums, model.table[h], strict=True)]
    z = [(b + s / max(n, 1)) / model.temperature for b, s in zip(model.base.tolist(), sums, strict=True)]
    e = [math.exp(x - max(z)) for x in z]
    p = [x / sum(e) for x in e]
    best = max(range(len(p) - 1), key=lambda c: (p[c], -c))
    letters = any(c.isalpha() for c in text)
    return (model.langs[best] if letters else "und", p[best] if letters else 0.0, not letters or 1 - p[-1] < model.reject_below)


def test_language_by_subwords():
    rng, r = np.random.default_rng(4), random.Random(4)
    model = langid.Model(["de", "en", "fr"], rng.normal(0, 3, (1 << langid.BITS, 4)), rng.normal(0, 0.2, 4), 1.3, 0.6)
    words = ["Haus", "the", "déjà", "of", "übung", "x", "42", "...", "北京", "a-b"]
    texts = ["", " ", "12 34", "a", "ab", "abc", *(" ".join(r.choices(words, k=n)) for n in (1, 2, 5, 30, 200)), " ".join(r.choices(words, k=60_000))]
    assert len(texts[-1].encode()) > 1 << 18  # more than one piece
    names, scores, rejected = langid._predict(model, pa.array([*texts, None]))
    for got, want in zip(zip(names, scores.tolist(), rejected.tolist(), strict=True), [*map(plain_language, [model] * len(texts), texts), ("und", 0.0, True)], strict=True):
        assert got[0] == want[0] and got[2] == want[2] and abs(got[1] - want[1]) < 1e-6
