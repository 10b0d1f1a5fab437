"""Token files: concatenated ids with Elias-Fano encoded document boundaries.

A shard is one binary value. Its ids lie one after the other in two or four bytes each, whichever the
vocabulary needs. Where each document ends, and the ascending document ids, are Elias-Fano sequences:
the low bits of every value packed, the high bits in unary in a bit vector, and the place of every 256th
one as a 32-bit number, from which ``select`` walks on. There is no 64-bit table. Shards are written as a
Parquet table through Spark, so any store that Spark writes will do, and a lost task is simply written again.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axisloom.llm import bpe, common, pretoken

SAMPLE = 256
MAGIC = b"AXTF1\0\0\0"


class EliasFano:
    """An ascending sequence (equal neighbours allowed) of integers, as offsets from its first value."""

    def __init__(self, n: int, base: int, width: int, low: np.ndarray, high: np.ndarray, places: np.ndarray):
        self.n, self.base, self.width, self.low, self.high, self.places = n, base, width, low, high, places

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        if not n:
            return cls(0, 0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint32))
        base = int(values[0])
        x = (values - values[0]).astype(np.uint64)
        width = max(0, ((int(x[-1]) + 1) // n).bit_length() - 1)
        bits = (x[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        ones = (x >> np.uint64(width)).astype(np.int64) + np.arange(n)
        vector = np.zeros(int(ones[-1]) + 1, np.uint8)
        vector[ones] = 1
        return cls(n, base, width, low, np.packbits(vector, bitorder="little"), ones[::SAMPLE].astype(np.uint32))

    def _low(self, i: np.ndarray) -> np.ndarray:
        at = i[:, None] * self.width + np.arange(self.width)
        bit = self.low[at >> 3] >> (at & 7).astype(np.uint8) & 1
        return (bit.astype(np.int64) << np.arange(self.width)).sum(axis=1) if self.width else np.zeros(len(i), np.int64)

    def select(self, i: int) -> int:
        """The i-th value: from the sampled place on, whole bytes of the bit vector are counted."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, more = int(self.places[i // SAMPLE]), i % SAMPLE
        byte = place >> 3
        head = int(self.high[byte]) >> (place & 7) << (place & 7)
        more += 1
        while (ones := head.bit_count()) < more:
            more -= ones
            byte += 1
            head = int(self.high[byte])
        for _ in range(more - 1):
            head &= head - 1
        at = byte * 8 + (head & -head).bit_length() - 1
        return self.base + ((at - i) << self.width) + int(self._low(np.array([i]))[0])

    def between(self, a: int, b: int) -> np.ndarray:
        """The values from the a-th to before the b-th: the sampled places say which bytes hold their bits."""
        if not 0 <= a <= b <= self.n:
            raise IndexError((a, b))
        head = a - a % SAMPLE
        if a == b:
            return np.zeros(0, np.int64)
        begin = int(self.places[head // SAMPLE])
        last = -(-b // SAMPLE)
        stop = int(self.places[last]) if last < len(self.places) else 8 * len(self.high)
        bits = np.unpackbits(self.high[begin >> 3 : -(-stop // 8)], bitorder="little")[begin & 7 :]
        ones = begin + np.flatnonzero(bits)[a - head : b - head]
        i = np.arange(a, b)
        return self.base + ((ones - i) << self.width) + self._low(i)

    def to_bytes(self) -> bytes:
        return struct.pack("<QqIIII", self.n, self.base, self.width, len(self.low), len(self.high), len(self.places)) + self.low.tobytes() + self.high.tobytes() + self.places.astype("<u4").tobytes()

    @classmethod
    def parse(cls, raw: bytes, at: int) -> tuple[EliasFano, int]:
        n, base, width, a, b, c = struct.unpack_from("<QqIIII", raw, at)
        at += struct.calcsize("<QqIIII")
        low = np.frombuffer(raw, np.uint8, a, at)
        high = np.frombuffer(raw, np.uint8, b, at + a)
        places = np.frombuffer(raw, "<u4", c, at + a + b)
        return cls(n, base, width, low, high, places), at + a + b + 4 * c


class Shard:
    """Documents in ascending order of id; ``n_null`` documents without an id come first."""

    def __init__(self, n_null: int, keys: EliasFano, ends: EliasFano, ids: np.ndarray):
        self.n_null, self.keys, self.ends, self.ids = n_null, keys, ends, ids

    def bounds(self, i: int) -> tuple[int, int]:
        """Where the i-th document begins and ends among the shard's ids."""
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def document(self, i: int) -> np.ndarray:
        a, b = self.bounds(i)
        return self.ids[a:b]

    def offsets(self, a: int, b: int) -> np.ndarray:
        """Where the documents from the a-th to before the b-th begin, and where the last of them ends."""
        return np.append(self.ends.select(a - 1) if a else 0, self.ends.between(a, b))

    def names(self, a: int, b: int) -> list[int | None]:
        """The documents' ids."""
        known = self.keys.between(max(0, a - self.n_null), max(0, b - self.n_null)).tolist()
        return [None] * (b - a - len(known)) + known

    def to_bytes(self) -> bytes:
        width = self.ids.dtype.itemsize
        return MAGIC + struct.pack("<QQI", self.n_null, len(self.ids), width) + self.keys.to_bytes() + self.ends.to_bytes() + self.ids.astype(f"<u{width}").tobytes()

    @classmethod
    def parse(cls, raw: bytes) -> Shard:
        if raw[:8] != MAGIC:
            raise ValueError("not a token shard")
        n_null, n_ids, width = struct.unpack_from("<QQI", raw, 8)
        keys, at = EliasFano.parse(raw, 8 + struct.calcsize("<QQI"))
        ends, at = EliasFano.parse(raw, at)
        return cls(n_null, keys, ends, np.frombuffer(raw, f"<u{width}", n_ids, at))


def build_shard(keys: list[int | None], documents: list[np.ndarray], wide: bool) -> Shard:
    known = np.array([k for k in keys if k is not None], np.int64)
    ends = np.cumsum([len(d) for d in documents])
    kind = np.uint32 if wide else np.uint16
    return Shard(len(keys) - len(known), EliasFano.of(known), EliasFano.of(ends), np.concatenate(documents).astype(kind))


_encoders: dict[tuple[str, bool], tuple[pretoken.WordEncoder, int]] = {}


class AddedTokenEncoder(pretoken.WordEncoder):
    """Texts are split at added tokens first, as the library does; each of these is a word, so one id."""

    def __init__(self, encode_new: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], added: list[bytes]):
        self.added = re.compile(b"|".join(map(re.escape, sorted(added, key=len, reverse=True))))
        super().__init__(encode_new)

    def starts(self, part: np.ndarray, off: np.ndarray) -> np.ndarray:
        raw = part.tobytes()
        if not self.added.search(raw):
            return super().starts(part, off)
        found = [m.span() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True) for m in self.added.finditer(raw, a, b)]
        at, end = np.array(found, np.int64).reshape(-1, 2).T
        begin = pretoken.token_starts(part, np.concatenate([off[:-1], at, end]))
        if not len(at):
            return begin
        last = np.searchsorted(at, begin, "right") - 1
        return begin[(last < 0) | (begin == at[last]) | (begin >= end[last])]


def library_encoder(path: str, added_tokens: bool = False) -> tuple[pretoken.WordEncoder, int]:
    """(encoder, vocabulary size): the tokenizers library gets each different word of the texts once.

    Byte-level BPE never merges across the words of its own pattern, so a text's ids are its words' ids. The
    library spends nearly all its time on splitting, which the arrays of :mod:`pretoken` do at a quarter of the cost.
    Special tokens' strings in a text are ordinary text, unless ``added_tokens`` asks for the library's default,
    by which they are their own ids.
    """
    if (path, added_tokens) not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        made.encode_special_tokens = not added_tokens

        def encode_new(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            ids, count = [], []
            for at in range(0, len(pieces), 20_000):
                for e in made.encode_batch_fast([w.decode() for w in pieces[at : at + 20_000]], add_special_tokens=False):
                    x = e.ids
                    ids.extend(x)
                    count.append(len(x))
            return np.array(ids, np.int32), np.array(count, np.int64)

        held = list(made.get_added_tokens_decoder().values()) if added_tokens else []
        if any(t.single_word or t.lstrip or t.rstrip for t in held):
            raise ValueError("added tokens that look at what is around them aren't split here")
        added = [t.content.encode() for t in held]
        of = AddedTokenEncoder(encode_new, added) if added else pretoken.WordEncoder(encode_new)
        _encoders[path, added_tokens] = of, made.get_vocab_size()
    return _encoders[path, added_tokens]


def counter(path: str) -> Callable[[], pretoken.WordEncoder]:
    """What makes, or finds, the library's encoder in a worker."""
    return functools.partial(_first, path)


def _first(path: str) -> pretoken.WordEncoder:
    return library_encoder(path, added_tokens=True)[0]


SHARDS = "part int, seq int, before long, n_docs long, n_ids long, shard binary"


def write_token_files(docs: DataFrame, tokenizer_path: str, path: str, end_id: int, key: str = "doc_id", text: str = "text", shard_ids: int = 2_000_000, added_tokens: bool = False) -> None:
    """Write every document's ids and ``end_id``, in ascending order of key, as shards at ``path``.

    Each task holds one range of keys and starts a new shard after ``shard_ids`` ids. ``before`` is the number
    of ids in the task's earlier shards. Null texts are empty; null keys come first; repeated keys stay apart, in
    their order in the table, and many rows of one key are dealt over several tasks. A text of more than
    ``shard_ids`` ids is one shard. Without documents there are no shards. ``added_tokens`` as in
    :func:`library_encoder`.
    """
    spark = docs.sparkSession
    common.bounded_batches(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("place"))
    dealt = dealt.repartitionByRange(n, "key", "place").sortWithinPartitions("key", "place").drop("place")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, size = library_encoder(tokenizer_path, added_tokens)
        wide = max(size, end_id + 1) > 1 << 16
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        keys, held, n_ids = [], [], 0

        def shard() -> pa.RecordBatch:
            row = [part, seq, before, len(keys), n_ids, build_shard(keys, held, wide).to_bytes()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["part", "seq", "before", "n_docs", "n_ids", "shard"])

        for batch, groups in bpe.encoded(batches, "text", of, 24 << 20):
            found = (ids for numbers, word_off in groups for ids in bpe.documents(of, numbers, word_off))
            for k, ids in zip(batch.column("key").to_pylist(), found, strict=True):
                keys.append(k)
                held.append(np.append(ids, end_id).astype(np.uint32 if wide else np.uint16))
                n_ids += len(ids) + 1
                if n_ids >= shard_ids:
                    yield shard()
                    seq, before = seq + 1, before + n_ids
                    keys, held, n_ids = [], [], 0
        if keys:
            yield shard()

    dealt.mapInArrow(step, SHARDS).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document of the files: ``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32``.

    Offsets and document ids come from the select structures, some thousand documents at a time.
    ``start`` counts the ids of all documents before. Only the totals of the writing tasks, one number each,
    come to the driver; the rest follows from each shard alone.
    """
    shards = spark.read.schema(SHARDS).parquet(path)
    totals = {r.part: r.n for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    base, sums = {}, 0
    for part in sorted(totals):
        base[part], sums = sums, sums + totals[part]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, raw in zip(*(batch.column(c).to_pylist() for c in ("part", "before", "shard")), strict=True):
                s = Shard.parse(raw)
                for at in range(0, s.ends.n, 16 * SAMPLE):
                    to = min(s.ends.n, at + 16 * SAMPLE)
                    off = s.offsets(at, to)
                    sums = [zlib.crc32(s.ids[a:b].astype("<u4").tobytes()) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(s.names(at, to), pa.int64()), pa.array(off[:-1] + before + base[part]), pa.array(np.diff(off)), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    common.bounded_batches(spark)
    return shards.select("part", "before", "shard").mapInArrow(step, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_report(docs: DataFrame, tokenizer_path: str, end_id: int = 2, path: str | None = None, **how) -> DataFrame:
    """Write the token files (into the shared folder, unless ``path`` says otherwise) and read them back."""
    path = path or common.scratch(docs.sparkSession, "tokens")
    write_token_files(docs, tokenizer_path, path, end_id, **how)
    return read_token_files(docs.sparkSession, path)
