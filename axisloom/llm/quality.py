"""Quality by a byte-level convolutional network in numpy.

Bytes are embedded; learned filters of ``WIDTH`` bytes move over the whole document in steps of ``STEP``,
so that their windows overlap. Chunks of ``CHUNK`` windows (each chunk reaches into the next) are max-pooled;
the maximum and the mean over a document's chunks pass through a rectifier and are combined into one
probability. Training is stochastic gradient descent with step sizes by weight; through a maximum the
gradient goes to the one window that gave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisloom.llm import common

STEP, PARTS, CHUNK = 8, 3, 32
WIDTH = STEP * PARTS
EMBED, FILTERS = 6, 32


def layout(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes in blocks of STEP, first block of each text, number of windows of each text).

    Each text is padded with zeros to whole blocks and by PARTS - 1 more, so its last window is whole; an
    empty text has one window of zeros.
    """
    windows = np.array([max(1, -(-len(t) // STEP)) for t in texts])
    size = windows + PARTS - 1
    first = np.cumsum(size) - size
    blocks = np.zeros(int(size.sum()) * STEP, np.uint8)
    for t, at in zip(texts, (first * STEP).tolist(), strict=True):
        blocks[at : at + len(t)] = t
    return blocks.reshape(-1, STEP), first, windows


class Network:
    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        self.embed = r.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.filters = r.normal(0, 0.12, (WIDTH * EMBED, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.top, self.mean = r.normal(0, 0.2, (2, FILTERS)).astype(np.float32)
        self.offset = np.zeros(1, np.float32)
        self.prior = np.zeros(1, np.float32)

    def weights(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.top, self.mean, self.offset]

    def responses(self, blocks: np.ndarray) -> np.ndarray:
        """Every filter at every block; the last PARTS - 1 rows are cut short."""
        x = self.embed[blocks].reshape(len(blocks), STEP * EMBED)
        y = self.filters.reshape(PARTS, STEP * EMBED, FILTERS)
        out = x @ y[0]
        for p in range(1, PARTS):
            out[:-p] += x[p:] @ y[p]
        return out + self.bias

    @staticmethod
    def chunks(first: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first window, number of windows, text) of every chunk."""
        n = -(-windows // CHUNK)
        text = np.repeat(np.arange(len(first)), n)
        no = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        begin = first[text] + no * CHUNK
        return begin, np.minimum(CHUNK, windows[text] - no * CHUNK), text

    def pooled(self, blocks: np.ndarray, first: np.ndarray, windows: np.ndarray):
        z = self.responses(blocks)
        begin, count, text = self.chunks(first, windows)
        edges = np.column_stack([begin, begin + count]).ravel()
        if edges[-1] >= len(z):
            edges = edges[:-1]
        chunk = np.maximum.reduceat(z, edges, axis=0)[::2]
        heads = np.flatnonzero(np.diff(text, prepend=-1))
        n = np.diff(np.append(heads, len(text)))
        return z, begin, count, text, heads, n, chunk

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        *_, heads, n, chunk = self.pooled(*layout(texts))
        top, mean = np.maximum.reduceat(chunk, heads, axis=0), np.add.reduceat(chunk, heads, axis=0) / n[:, None]
        return self._probability(top, mean)

    def _probability(self, top: np.ndarray, mean: np.ndarray) -> np.ndarray:
        s = np.maximum(top, 0) @ self.top + np.maximum(mean, 0) @ self.mean + self.offset[0] + self.prior[0]
        return 1 / (1 + np.exp(-np.clip(s.astype(np.float64), -30, 30)))

    def pool_long(self, text: np.ndarray, piece: int = 1 << 17) -> np.ndarray:
        """The score of one long text, taken in pieces of whole chunks that reach into one another."""
        step = piece - piece % (CHUNK * STEP)
        tops, sums, n = [], [], 0
        for at in range(0, len(text), step):
            part = text[at : at + step + (PARTS - 1) * STEP]
            blocks, first, windows = layout([part])
            windows = np.minimum(windows, -(-(min(len(text) - at, step)) // STEP))
            chunk = self.pooled(blocks, first, windows)[-1]
            tops.append(chunk.max(axis=0))
            sums.append(chunk.sum(axis=0))
            n += len(chunk)
        return self._probability(np.max(tops, axis=0)[None], (np.sum(sums, axis=0) / n)[None])

    def peaks(self, text: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
        """Of every chunk of one text and every filter the maximum, and the bytes under the window that gave it."""
        step = piece - piece % (CHUNK * STEP)
        best, seen = [], []
        for at in range(0, max(1, len(text)), step):
            blocks, first, windows = layout([text[at : at + step + (PARTS - 1) * STEP]])
            windows = np.minimum(windows, max(1, -(-min(len(text) - at, step) // STEP)))
            z, begin, count, *_, chunk = self.pooled(blocks, first, windows)
            where = np.stack([a + z[a : a + c].argmax(axis=0) for a, c in zip(begin.tolist(), count.tolist(), strict=True)])
            best.append(chunk)
            seen.append(blocks[where[..., None] + np.arange(PARTS)].reshape(*where.shape, WIDTH))
        return np.concatenate(best), np.concatenate(seen)

    def gradients(self, texts: list[np.ndarray], y: np.ndarray, weight: np.ndarray, piece: int = 1 << 17) -> list[np.ndarray]:
        """Gradients of the mean loss over whole texts; a text is taken in pieces of about ``piece`` bytes."""
        made = [self.peaks(t, piece) for t in texts]
        n = np.array([len(c) for c, _ in made])
        text, heads = np.repeat(np.arange(len(texts)), n), np.cumsum(n) - n
        chunk, under = np.concatenate([c for c, _ in made]), np.concatenate([s for _, s in made])
        top = np.maximum.reduceat(chunk, heads, axis=0)
        mean = np.add.reduceat(chunk, heads, axis=0) / n[:, None]
        g = ((self._probability(top, mean) - y) * weight / len(texts)).astype(np.float32)
        g_top, g_mean = np.maximum(top, 0).T @ g, np.maximum(mean, 0).T @ g
        d_top, d_mean = g[:, None] * self.top * (top > 0), g[:, None] * self.mean * (mean > 0) / n[:, None]
        d_chunk = d_mean[text]
        best = chunk == top[text]
        d_chunk += np.where(best, d_top[text] / np.maximum(1, np.add.reduceat(best.astype(np.int64), heads, axis=0))[text], 0)
        d_chunk = d_chunk.astype(np.float32)
        g_filters, g_embed = np.zeros_like(self.filters), np.zeros_like(self.embed)
        for k in range(FILTERS):  # one filter at a time bounds what is held
            on = np.flatnonzero(d_chunk[:, k])
            for at in range(0, len(on), 16_384):
                rows = on[at : at + 16_384]
                d, seen = d_chunk[rows, k], under[rows, k]
                g_filters[:, k] += d @ self.embed[seen].reshape(-1, WIDTH * EMBED)
                place = np.bincount((seen + 256 * np.arange(WIDTH)).ravel(), np.repeat(d, WIDTH), 256 * WIDTH).reshape(WIDTH, 256)
                g_embed += place.T.astype(np.float32) @ self.filters[:, k].reshape(WIDTH, EMBED)
        return [g_embed, g_filters, d_chunk.sum(axis=0), g_top, g_mean, np.array([g.sum()], np.float32)]


def fit(texts: list[np.ndarray], y: np.ndarray, share_of_ones: float, rounds: int = 6, batch: int = 32, rate: float = 0.02, seed: int = 7) -> Network:
    """Both classes weigh alike in training; the share of ones among all labels comes back as a prior."""
    net, r = Network(), np.random.default_rng(seed)
    share = min(max(share_of_ones, 0.01), 0.99)
    prior = np.log(share / (1 - share))
    if not len(texts):
        net.prior[0] = prior
        return net
    y = y.astype(np.float64)
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    m1, m2, t = [np.zeros_like(w) for w in net.weights()], [np.zeros_like(w) for w in net.weights()], 0
    for k in range(rounds):
        order = r.permutation(len(texts))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            t += 1
            for w, g, a, b in zip(net.weights(), net.gradients([texts[i] for i in pick], y[pick], weight[pick]), m1, m2, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                w -= rate * 0.6**k * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    net.prior[0] = prior
    return net


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = 1200) -> Network:
    """Learn from labelled rows whose crc32(key as text) mod 5 isn't 0.

    A bounded sample is fitted: of the labelled rows of each class that have a text, empty or of any length, the
    ``sample`` rows that come first by a hash of the key (of equal keys, by text). They are learnt whole. The share
    of ones is counted over all labels of such keys. Labels that aren't 0 or 1, null keys and null texts are left
    out. A key labelled both ways stands in both classes; labels and rows that repeat count once in the sample.
    Without rows of both classes the network stays untrained, with the prior of what there is.
    """
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y in (0, 1)").where(F.crc32(F.col("k").cast("string")) % 5 != 0)
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values())) if counts else 0.5
    if len(counts) < 2:
        return fit([], np.zeros(0), share)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where("k is not null and t is not null")
    # keys of rows that have a label and a text, before any of the texts are fetched
    held = known.distinct().join(rows.select("k"), "k", "left_semi")
    order = [F.xxhash64("k"), F.col("k")]
    picked = held.where("y = 0").orderBy(*order).limit(sample).unionAll(held.where("y = 1").orderBy(*order).limit(sample))
    found = rows.join(F.broadcast(picked), "k").distinct()  # at most 2 * sample keys
    texts, y = [], []
    for c in (0, 1):
        for r in found.where(F.col("y") == c).orderBy(*order, "t").limit(sample).toLocalIterator():
            texts.append(np.frombuffer(r.t.encode(), np.uint8))
            y.append(c)
    if len(set(y)) < 2:
        return fit([], np.zeros(0), share)
    return fit(texts, np.array(y), share)


def quality_scores(docs: DataFrame, net: Network, key: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row for each document: ``doc_id``, ``held_out``, ``score`` and ``predicted``.

    Null texts are scored as empty ones. Null keys (held_out null) and repeated rows are kept.
    """
    common.bounded_batches(docs.sparkSession)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = common.text_buffers(batch.column("text"))
            scores = []
            for i, j in common.groups(off):
                if off[j] - off[i] > common.GROUP_BYTES:
                    scores.append(net.pool_long(data[off[i] : off[j]]))
                else:
                    scores.append(net.score([data[a:b] for a, b in zip(off[i:j].tolist(), off[i + 1 : j + 1].tolist(), strict=True)]))
            score = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64())], names=["doc_id", "score"])

    kind = docs.schema[key].dataType.simpleString()
    scored = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(step, f"doc_id {kind}, score double")
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
