"""Benchmark decontamination by winnowing.

Training and test texts are fingerprinted alike: of every ``WINDOW`` neighbouring k-grams of words the
one with the least hash is kept (the rightmost of equals). Two texts that share ``GRAM + WINDOW - 1``
words in a row share a fingerprint inside them. Each hit is extended to the spans of ``SPAN`` words around it
that occur in an item, and overlapping spans merge. With SPAN = GRAM + WINDOW - 1 no shared span is missed.
Items of fewer words than SPAN are one window each and are looked up by their own length.

1. Every benchmark item gives its fingerprints and the hashes of its windows; they fold into one bitmap that
   is sent to the executors. Its size follows the number of windows, between fixed bounds; what it lets through
   wrongly costs work, never a result.
2. The documents are read once. Of a fingerprint that the bitmap knows, the windows around it that the bitmap
   knows too go on, with their words. Windows of one batch that are alike go on as one row with the places of
   all of them, so a passage that a third of all documents share gives rows by batches, not by documents. Document
   rows are numbered and written beside them, and the table is read from then on.
3. Windows join those of the benchmark by their words, in a shuffle, and so are verified. What they hit is put
   together by document; only documents with candidates are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axisloom.llm import common, words

GRAM, WINDOW = 5, 9
SPAN = GRAM + WINDOW - 1
#: Bits of the bitmap: 16 for each window, between these powers of two (2 MB and 128 MB).
LEAST_BITS, MOST_BITS = 24, 30
#: Rows that one task numbers.
ROWS = 1 << 40


def winnow(grams: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the k-grams that are the rightmost least of a window, ascending."""
    n = len(grams) - window + 1
    if n <= 0:
        return np.flatnonzero(grams == grams.min())[-1:] if len(grams) else np.zeros(0, np.int64)
    least, at = grams[:n].copy(), np.zeros(n, np.int8)
    for j in range(1, window):
        x = grams[j : j + n]
        less = x <= least
        np.copyto(least, x, where=less)
        at[less] = j
    at = np.arange(n) + at
    return at[np.concatenate([[True], at[1:] != at[:-1]])]


def _window_hashes(hashes: np.ndarray, where: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word windows that begin at ``where``, as :func:`words.runs` gives them."""
    sums = np.zeros(len(where), np.uint64)
    for j in range(n):
        sums += hashes[where + j] * words.RUN[j]
    return words.mix(sums + np.uint64(n * int(words.RUN[14]) % (1 << 64)))


def _spelled(data: np.ndarray, start: np.ndarray, end: np.ndarray, at: int, n: int) -> str:
    """The n lower-cased words from the at-th on, with one blank between them."""
    return " ".join(words.LOWER[data[s:e]].tobytes().decode() for s, e in zip(start[at : at + n].tolist(), end[at : at + n].tolist(), strict=True))


# ---- the benchmark's side

WINDOWS = "item string, n int, words string, print long"


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of items with their words, and hashes: rows without an item are fingerprints."""
    names = [c.split()[0] for c in WINDOWS.split(", ")]
    for batch in batches:
        data, off = common.text_buffers(batch.column("text"))
        items = batch.column("item").to_pylist()
        for i, j in common.groups(off):
            start, end, hashes, word_off = words.document_words(data, off[i : j + 1], words.ALNUM_WORDS)
            item, size, spelled, prints = [], [], [], []
            for who, a, b in zip(items[i:j], word_off[:-1].tolist(), word_off[1:].tolist(), strict=True):
                if a == b:
                    continue
                n = min(SPAN, b - a)
                item += [who] * (b - a - n + 1)
                size += [n] * (b - a - n + 1)
                spelled += [_spelled(data, start, end, at, n) for at in range(a, b - n + 1)]
                prints.append(words.runs(hashes[a:b], n))
                if n == SPAN:
                    grams = words.runs(hashes[a:b], GRAM)
                    kept = grams[winnow(grams)]
                    item += [None] * len(kept)
                    size += [None] * len(kept)
                    spelled += [None] * len(kept)
                    prints.append(kept)
            if item:
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.string()), pa.array(size, pa.int32()), pa.array(spelled, pa.string()), common.longs(np.concatenate(prints))], names=names)


class Bitmap:
    """Which hashes may be known: one bit for each leading part of a hash."""

    def __init__(self, bits: int):
        self.bits, self.held = bits, np.zeros(1 << bits - 3, np.uint8)

    def has(self, x: np.ndarray) -> np.ndarray:
        at = (x >> np.uint64(64 - self.bits)).astype(np.int64)
        return (self.held[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _bitmap(windows: DataFrame, bits: int) -> Bitmap:
    """Folded where the windows lie, in chunks of 4096 bytes; what comes to the driver is the bitmap itself."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            at = (batch.column("print").to_numpy().view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
            for chunk in np.unique(at >> 15).tolist():
                mine = at[at >> 15 == chunk] & 0x7FFF
                np.bitwise_or.at(held.setdefault(chunk, np.zeros(4096, np.uint8)), mine >> 3, np.left_shift(1, mine & 7).astype(np.uint8))
        for chunk, value in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([value.tobytes()])], names=["chunk", "value"])

    made = Bitmap(bits)
    chunk = F.shiftrightunsigned("print", 64 - bits + 15)
    parts = int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_in = windows.select("print").repartition(parts, chunk).sortWithinPartitions("print")  # so that a chunk is met in few batches
    for row in sorted_in.mapInArrow(fold, "chunk long, value binary").toLocalIterator():
        made.held[row.chunk * 4096 : (row.chunk + 1) * 4096] = np.frombuffer(row.value, np.uint8)
    return made


# ---- the documents' side


def candidates(bitmap: Bitmap, sizes: list[int], hashes: np.ndarray, word_off: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(n, first words) of the n-word windows, inside a document, that may occur in the benchmark."""
    last = np.repeat(word_off[1:], np.diff(word_off))
    for n in sizes:
        if n == SPAN:
            grams = words.runs(hashes, GRAM)
            at = winnow(grams)
            hit = at[bitmap.has(grams[at])]
            where = np.unique((hit[:, None] - np.arange(WINDOW)).ravel())
            where = where[(where >= 0) & (where + SPAN <= len(hashes))]
        else:
            where = np.arange(max(0, len(hashes) - n + 1))
        where = where[where + n <= last[where]] if len(where) else where
        if len(where):
            where = where[bitmap.has(_window_hashes(hashes, where, n))]
        if len(where):
            yield n, where


def _marked(sent, sizes: list[int]):
    """Document rows (number, n_words, asks, document), and rows of windows (n, words, rows, places)."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = sent.value
        number = TaskContext.get().partitionId() * ROWS
        for batch in batches:
            kinds = pa.schema([("number", pa.int64()), ("n_words", pa.int64()), ("asks", pa.bool_()), ("document", batch.column("document").type), ("n", pa.int32()), ("words", pa.string()), ("rows", pa.list_(pa.int64())), ("places", pa.list_(pa.int64()))])
            size = batch.num_rows
            data, off = common.text_buffers(batch.column("text"))
            n_words, asks = np.zeros(size, np.int64), np.zeros(size, bool)
            found: dict[tuple[int, str], tuple[list[int], list[int]]] = {}
            for i, j in common.groups(off):
                start, end, hashes, word_off = words.document_words(data, off[i : j + 1], words.ALNUM_WORDS)
                n_words[i:j] = np.diff(word_off)
                for n, where in candidates(bitmap, sizes, hashes, word_off):
                    owner = np.searchsorted(word_off, where, "right") - 1
                    asks[i + owner] = True
                    for at, d in zip(where.tolist(), owner.tolist(), strict=True):
                        rows, places = found.setdefault((n, _spelled(data, start, end, at, n)), ([], []))
                        rows.append(number + i + d)
                        places.append(at - int(word_off[d]))
            none = lambda names, n: [pa.nulls(n, kinds.field(k).type) for k in names]  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array(number + np.arange(size)), pa.array(n_words), pa.array(asks), batch.column("document"), *none(("n", "words", "rows", "places"), size)], schema=kinds)
            keys = list(found)
            for at in range(0, len(keys), 2000):
                part = keys[at : at + 2000]
                columns = [[n for n, _ in part], [w for _, w in part], [found[k][0] for k in part], [found[k][1] for k in part]]
                columns = [pa.array(c, kinds.field(4 + k).type) for k, c in enumerate(columns)]
                yield pa.RecordBatch.from_arrays([*none(("number", "n_words", "asks", "document"), len(part)), *columns], schema=kinds)
            number += size

    return step


def _judged(documents: DataFrame, benchmark: DataFrame, item: str, item_text: str) -> DataFrame:
    """``document``, ``n_words``, ``hit_spans`` and ``hit_items`` of rows (document, text)."""
    spark = documents.sparkSession
    common.bounded_batches(spark)
    items = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("text")).where("item is not null and text is not null")
    windows = common.written(items.mapInArrow(_windows, WINDOWS), "windows")
    counts = windows.groupBy("n").agg(F.count("*").alias("rows")).collect()  # SPAN + 1 rows at most
    bits = (16 * sum(r.rows for r in counts)).bit_length()
    sent = spark.sparkContext.broadcast(_bitmap(windows, min(MOST_BITS, max(LEAST_BITS, bits))))
    kinds = [("number", T.LongType()), ("n_words", T.LongType()), ("asks", T.BooleanType()), ("document", documents.schema["document"].dataType)]
    kinds += [("n", T.IntegerType()), ("words", T.StringType()), ("rows", T.ArrayType(T.LongType())), ("places", T.ArrayType(T.LongType()))]
    schema = T.StructType([T.StructField(name, kind) for name, kind in kinds])
    marked = common.written(documents.mapInArrow(common.tidied(_marked(sent, sorted(r.n for r in counts if r.n is not None))), schema), "marked")

    known = windows.where("item is not null").select("n", "words", "item").distinct()
    met = marked.where("words is not null").select("n", "words", "rows", "places").join(known, ["n", "words"])
    met = met.select("n", "item", "places", F.posexplode("rows").alias("no", "number"))
    begin = F.element_at("places", F.col("no") + 1)
    hits = met.select("number", "item", (begin * 16 + F.col("n")).alias("span"))
    hits = hits.groupBy("number").agg(F.collect_set("span").alias("spans"), F.array_sort(F.collect_set("item")).alias("hit_items"))
    rows = marked.where("words is null").select("number", "n_words", "asks", "document")
    spans, none = F.array().cast("array<long>"), F.array().cast("array<string>")
    free = rows.where("not asks").select("document", "n_words", spans.alias("hit_spans"), none.alias("hit_items"))
    judged = rows.where("asks").join(hits, "number", "left").select("document", "n_words", "spans", F.coalesce("hit_items", none).alias("hit_items"))
    return free.unionAll(judged.mapInArrow(_merged, free.schema))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(document, n_words, spans, hit_items) with the union of spans, each 16 times its begin and its length, as
    begin, end, begin, end ..."""

    def one(spans: pa.Scalar) -> np.ndarray:
        if not spans.is_valid or not len(spans.values):
            return np.zeros(0, np.int64)
        x = np.sort(spans.values.to_numpy())
        begin, reach = x >> 4, np.maximum.accumulate((x >> 4) + (x & 15))
        new = np.concatenate([[True], begin[1:] > reach[:-1]])
        return np.column_stack([begin[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(x) - 1)]]).ravel()

    for batch in batches:
        hit = pa.array([one(x) for x in batch.column("spans")], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("document"), batch.column("n_words"), hit, batch.column("hit_items")], names=["document", "n_words", "hit_spans", "hit_items"])


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``hit_spans`` (begin, end, begin, end ... in words, disjoint) and ``hit_items``.

    Null and empty texts have no words and no hits. Items whose id or text is null take no part; an item id
    that comes twice counts once. Repeated rows are judged one by one. Columns of ``docs`` with one of the
    three result names are replaced; all others pass through.
    """
    added = ["n_words", "hit_spans", "hit_items"]
    kept = [c for c in docs.columns if c not in added]
    found = _judged(docs.select(common.carried(docs, added).alias("document"), F.col(text).alias("text")), benchmark, item, item_text)
    return found.select(*(F.col("document").getField(c).alias(c) for c in kept), *added)


N_HIT = "aggregate(hit_spans, 0L, (a, x) -> x - a)"  # ends less begins, as the signs alternate


def contamination_report(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: ``n_words``, ``n_hit``, ``n_items``, ``items_sha256`` and ``contaminated``.

    A document is contaminated when a word is hit and at least a twentieth of its words are. A null key is kept.
    """
    own = docs.select(F.struct(F.col(key).alias("doc_id")).alias("document"), F.col(text).alias("text"))
    found = _judged(own, benchmark, "item_id", "text").select("document.doc_id", "n_words", "hit_spans", "hit_items")
    return found.select(
        "doc_id", "n_words", F.expr(N_HIT).alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("hit_items"), ","), 256).alias("items_sha256"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def clean_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that are not contaminated, with their own columns, whatever these are called."""
    found = _judged(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("document"), F.col(text).alias("text")), benchmark, item, item_text)
    return found.where(f"not ({N_HIT} > 0 and 20 * {N_HIT} >= n_words)").select("document.*")
