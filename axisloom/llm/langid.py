"""Language by averaged hashed subword embeddings with a linear softmax.

Subwords are the runs of 3 and of 4 bytes of the lower-cased text whose inner bytes belong to a word (the
outer ones may be its edges). Each is hashed to an embedding; a text is the mean of its embeddings, and a
softmax layer over it gives the languages. Both layers are trained together by stochastic gradient descent
in numpy. For prediction the layers fold into one table of a number for each hash and language.

One more class stands for none of the languages; it is learnt from texts made by rule. A temperature, fitted
on rows kept from training, calibrates the probabilities. A text is rejected when what the languages have of
them together lies below a level: at most the share ``allowed`` of the kept texts that are labelled rightly
lies below it, and it is never above one half.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from axisloom.llm import common

BITS, EMBED = 16, 12
UNKNOWN = "und"
_WORD = np.arange(256, dtype=np.uint8)
for _c in range(128):
    if not (chr(_c).isalpha()):
        _WORD[_c] = 32


def _hashes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(positions, hashes, how many have 3 bytes) of the subwords of bytes whose non-letters are blanks."""
    n = len(x)
    if n < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    w = x.astype(np.uint32)
    three = w[:-2] | w[1:-1] << np.uint32(8) | w[2:] << np.uint32(16)
    inner = x != 32
    at3 = np.flatnonzero(inner[1:-1])
    h3 = (three[at3] * np.uint32(2654435769)) >> np.uint32(32 - BITS)
    at4 = np.flatnonzero(inner[1:-2] & inner[2:-1]) if n > 3 else np.zeros(0, np.int64)
    h4 = ((three[at4] | w[at4 + 3] << np.uint32(24)) * np.uint32(2246822507) ^ np.uint32(0x5BD1E995)) * np.uint32(3266489917) >> np.uint32(32 - BITS)
    return np.concatenate([at3, at4]), np.concatenate([h3, h4]), len(at3)


def _bytes(text: str) -> np.ndarray:
    return _WORD[np.frombuffer(f" {text.lower()} ".encode(), np.uint8)]


class Model:
    """``table``: score of each hash for each language and for none; ``base``: scores of a text without subwords."""

    def __init__(self, langs: list[str], table: np.ndarray, base: np.ndarray, temperature: float = 1.0, reject_below: float = 0.0):
        self.langs, self.table, self.base, self.temperature, self.reject_below = langs, table, base, temperature, reject_below

    def logits(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Of neighbouring texts, lower-cased and with blanks for non-letters already."""
        lo = int(off[0])
        sums = np.zeros((len(off) - 1, len(self.base)))
        count = np.zeros(len(off) - 1)
        step = 1 << 18
        for at in range(lo, int(off[-1]), step):  # pieces reach 3 bytes into the next
            part = data[at : min(int(off[-1]), at + step + 3)]
            pos, h, threes = _hashes(part)
            size = np.where(np.arange(len(pos)) < threes, 3, 4)
            pos += at
            text = np.searchsorted(off, pos, "right") - 1
            ok = (pos + size <= off[text + 1]) & (pos < at + step)
            text, h = text[ok], h[ok]
            count += np.bincount(text, minlength=len(count))
            for c in range(len(self.base)):
                sums[:, c] += np.bincount(text, self.table[h, c], len(count))
        return self.base + sums / np.maximum(count, 1)[:, None]

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def _other(texts: list[str], r: np.random.Generator, n: int) -> list[str]:
    """Texts in none of the languages, made by rule: keyboard noise, and words of invented alphabets and spellings.

    Half take a text's word lengths with its letters exchanged one for one, as in a language never met; a quarter
    draw every letter evenly; a quarter draw letters of other scripts.
    """
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    scripts = [(0x391, 0x3C9), (0x410, 0x44F), (0x5D0, 0x5EA), (0x627, 0x64A), (0x905, 0x939), (0xE01, 0xE2E), (0x3041, 0x3096), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3), (0x100, 0x17F)]
    out = []
    for no in range(n):
        size = int(r.integers(1, 60))
        if no % 4 < 2 and texts:
            t = texts[int(r.integers(len(texts)))]
            at = int(r.integers(0, max(1, len(t) - 400)))
            exchanged = str.maketrans(dict(zip(letters, r.permutation(letters), strict=True)))
            out.append(t[at : at + 400].lower().translate(exchanged))
            continue
        a, z = scripts[int(r.integers(len(scripts)))]
        draw = (lambda k: "".join(r.choice(letters, k))) if no % 4 == 2 else (lambda k, a=a, z=z: "".join(map(chr, r.integers(a, z + 1, k))))
        out.append(" ".join(draw(int(r.integers(1, 12))) for _ in range(size)))
    return out


def fit(texts: list[str], langs: list[str], rounds: int = 6, rate: float = 0.6, seed: int = 3, allowed: float = 0.002) -> Model:
    """Every text is learnt whole and by two excerpts; every fifth text is kept for calibration.

    A further class, which is never predicted, is learnt from texts in no language at all (:func:`_other`, half as
    many as there are texts, 200 at least). What it leaves to the languages is a text's belonging.
    """
    names = sorted(set(langs))
    r = np.random.default_rng(seed)
    none, width = len(names), len(names) + 1
    embed = np.zeros((1 << BITS, EMBED), np.float32)
    out, bias = r.normal(0, 0.3, (EMBED, width)).astype(np.float32), np.zeros(width, np.float32)
    rows, kept = [], []
    made = list(zip(texts, langs, strict=True))
    if made:
        made += [(t, None) for t in _other(texts, r, max(200, len(texts) // 2))]
    number = {x: i for i, x in enumerate(names)}
    for i, (t, lang) in enumerate(made):
        cuts = [t]
        for size in (60, 250):
            at = int(r.integers(0, max(1, len(t) - size)))
            cuts.append(t[at : at + size])
        for c in cuts:
            h, n = np.unique(_hashes(_bytes(c))[1], return_counts=True)
            if len(h):
                (kept if i % 5 == 4 else rows).append((h.astype(np.uint16), (n / n.sum()).astype(np.float32), number.get(lang, none)))
    if not names or not any(y < none for *_, y in rows):
        return Model(names or [UNKNOWN], np.zeros((1 << BITS, max(1, none) + 1)), np.zeros(max(1, none) + 1))
    total = rounds * len(rows)
    for k in range(rounds):
        for no, i in enumerate(r.permutation(len(rows))):
            h, share, y = rows[i]
            mean = share @ embed[h]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            step = rate * (1 - (k * len(rows) + no) / total)
            back = out @ p
            out -= step * np.outer(mean, p)
            bias -= 0.1 * step * p
            embed[h] -= step * len(h) ** 0.5 * np.outer(share, back)
    model = Model(names, (embed @ out).astype(np.float64), bias.astype(np.float64))
    if kept:
        z = np.array([model.base + share @ model.table[h] for h, share, _ in kept])
        y = np.array([c for *_, c in kept])

        def loss(t: float) -> float:
            model.temperature = t
            return -np.log(model.probabilities(z)[np.arange(len(y)), y] + 1e-12).mean()

        model.temperature = min((2.0**e for e in np.arange(-3, 3.01, 0.25)), key=loss)
        p = model.probabilities(z)
        right = np.sort(1 - p[(y < none) & (p[:, :none].argmax(axis=1) == y), none])
        if len(right):
            model.reject_below = float(min(0.5, right[int(allowed * len(right))]))
    return model


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = 400, longest: int = 4096) -> Model:
    """Learn from rows with a language whose crc32(key as text) mod 4 isn't 2.

    Every language of these rows is learnt, from a bounded sample of each: the ``sample`` keys that come first by
    a hash of the key. A text of more than ``longest`` characters gives an excerpt of that length, which begins
    anywhere in it as the key's hash says. Rows without text, key or language are left out; of rows that repeat
    a key and a language one is learnt, that with the least text hash.

    Languages are counted first; of each only the keys whose hash is low enough to be among its first go on, so
    the window that picks from these meets a few times ``sample`` rows of a language, whatever its size.
    """
    known = docs.select(F.col(key).alias("k"), F.col(lang).alias("lang"), F.col(text).alias("t")).where("k is not null and lang is not null and t <> ''")
    known = known.where(F.crc32(F.col("k").cast("string")) % 4 != 2).withColumn("at", F.xxhash64("k"))
    keys = known.select("lang", "k", "at")
    counts = keys.groupBy("lang").agg(F.approx_count_distinct("k", 0.02).alias("n"))
    low = F.lit(-(2.0**63)) + F.lit(2.0**64) * (2 * sample + 200) / F.col("n")
    near = keys.join(F.broadcast(counts), "lang").where(F.col("at").cast("double") <= low).select("lang", "k", "at").distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy("at", "k"))
    picked = near.withColumn("no", place).where(F.col("no") <= sample).select("lang", "k")
    begin = F.lit(1) + F.pmod(F.xxhash64("k", F.lit(1)), F.greatest(F.length("t") - longest + 1, F.lit(1))).cast("int")
    found = known.join(F.broadcast(picked), ["lang", "k"]).select("lang", "k", F.struct(F.xxhash64("t").alias("h"), F.substring("t", begin, F.lit(longest)).alias("t")).alias("one"))
    rows = sorted((r.lang, r.k, r.one.t) for r in found.groupBy("lang", "k").agg(F.min("one").alias("one")).toLocalIterator())
    return fit([t for *_, t in rows], [x for x, *_ in rows])


def _predict(model: Model, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    lower = pc.utf8_lower(pc.fill_null(column, ""))
    letters = pc.match_substring_regex(lower, r"\p{L}").to_numpy(zero_copy_only=False)
    data, off = common.text_buffers(lower)
    scores = np.zeros(len(off) - 1)
    best = np.zeros(len(off) - 1, np.int64)
    belongs = np.zeros(len(off) - 1)
    for i, j in common.groups(off):
        part = _WORD[data[off[i] : off[j]]]
        p = model.probabilities(model.logits(part, off[i : j + 1] - off[i]))
        best[i:j], scores[i:j], belongs[i:j] = p[:, :-1].argmax(axis=1), p[:, :-1].max(axis=1), 1 - p[:, -1]
    names = [model.langs[b] if x else UNKNOWN for b, x in zip(best.tolist(), letters.tolist(), strict=True)]
    scores[~letters] = 0.0
    return names, scores, ~letters | (belongs < model.reject_below)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``rejected``; columns of those names are replaced.

    Without text, or without a letter in it, ``lang_pred`` is ``und``, the score 0 and the row rejected. Of equal
    probabilities the language that sorts first wins. Repeated rows are judged one by one.
    """
    common.bounded_batches(docs.sparkSession)
    names = ["lang_pred", "score", "rejected"]
    own = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    rest = docs.select(F.col(text).alias("text"), common.carried(docs, names))
    schema = docs.select(*own, F.lit("").cast("string").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("rejected")).schema

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, rejected = _predict(model, batch.column("text"))
            yield pa.RecordBatch.from_arrays([*common.uncarried(batch), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], names=schema.names)

    return rest.mapInArrow(common.tidied(step), schema)


def language_report(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: ``doc_id``, ``held_out``, ``lang_pred``, ``score`` and ``rejected``."""
    found = identify(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), model)
    return found.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out"), "lang_pred", "score", "rejected")


def recognised(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents that aren't rejected, with their own columns, whatever these are called."""
    found = identify(docs.select(F.struct("*").alias("document"), F.col(text).alias("text")), model)
    return found.where(~F.col("rejected")).select("document.*")
