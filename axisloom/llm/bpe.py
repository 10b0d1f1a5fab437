"""Byte-level BPE by corpus-level merge replay, and decoding.

A task gathers the different words of its texts. An inverted index leads from each pair of neighbouring
tokens, named by the rank of their joined bytes, to its positions in those words. Ranks are taken in
ascending order from a heap; a merge is applied at all of its positions at once (of overlapping ones in
a word every second, from the left), and only the pairs beside a merge are looked up and indexed again.
Each word's merges thus come lowest rank first, as when it is encoded on its own.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisloom.llm import common, pretoken, words
from axisloom.llm.pretoken import ranges

#: Text gathered before a replay, and token ids written out at a time.
REPLAY_BYTES, OUT_IDS = 8 << 20, 1 << 18
#: Pairs that are looked up at a time.
RANK_PAIRS = 1 << 17
NO_RANK = np.int32(1 << 30)


class Vocabulary:
    """Ranks of byte strings; a token's id is its rank."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        by_id = sorted((r, b) for b, r in self.ranks.items())
        self.size = by_id[-1][0] + 1
        self.length = np.zeros(self.size, np.int64)
        self.length[[r for r, _ in by_id]] = [len(b) for _, b in by_id]
        self.begin = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(b for _, b in by_id), np.uint8)
        numbers = [f" {i}".encode() for i in range(self.size)]
        self.digits = np.frombuffer(b"".join(numbers), np.uint8)
        self.digits_length = np.array([len(x) for x in numbers])
        self.digits_begin = np.cumsum(self.digits_length) - self.digits_length
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        left, right, joined = [], [], []
        for b, r in self.ranks.items():
            for i in range(1, len(b)):
                if (x := self.ranks.get(b[:i])) is not None and (y := self.ranks.get(b[i:])) is not None:
                    left.append(x)
                    right.append(y)
                    joined.append(r)
        keys = self._pair(np.array(left, np.int64), np.array(right, np.int64))
        self.table = pretoken.WordTable(20)
        self.table.add(keys)
        self.joined = np.array(joined, np.int32)

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return words.mix((a.astype(np.uint64) << np.uint64(32)) | (b.astype(np.uint64) + np.uint64(1)))

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair's joined bytes; many pairs are looked up in pieces, as that takes ten times their memory."""
        if len(a) > RANK_PAIRS:
            return np.concatenate([self.rank(a[i : i + RANK_PAIRS], b[i : i + RANK_PAIRS]) for i in range(0, len(a), RANK_PAIRS)])
        at = self.table.find(self._pair(a, b))
        return np.where(at >= 0, self.joined[at], NO_RANK)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.bytes[ranges(self.begin[ids], self.length[ids])].tobytes()

    def encode_words(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many for each word); a word that is a token stays whole."""
        known = [self.ranks.get(w, -1) for w in pieces]
        rest = [w for w, r in zip(pieces, known, strict=True) if r < 0]
        ids, count = replay(self, rest)
        known = np.array(known, np.int64)
        counts = np.ones(len(pieces), np.int64)
        counts[known < 0] = count
        out = np.empty(int(counts.sum()), np.int32)
        begin = np.cumsum(counts) - counts
        out[begin[known >= 0]] = known[known >= 0]
        out[ranges(begin[known < 0], count)] = ids
        return out, counts


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def replay(v: Vocabulary, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, how many for each word) of words, all merged side by side."""
    if not pieces:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    size = np.array([len(w) for w in pieces])
    token = v.single[np.frombuffer(b"".join(pieces), np.uint8)]
    n = len(token)
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    ends = np.cumsum(size) - 1
    after[ends] = -1
    before[ends - size + 1] = -1
    alive = np.ones(n, bool)
    rank = np.full(n, NO_RANK, np.int32)
    inner = np.flatnonzero(after >= 0).astype(np.int32)
    rank[inner] = v.rank(token[inner], token[after[inner]])
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def enter(at: np.ndarray) -> None:
        r = rank[at]
        at, r = at[r < NO_RANK], r[r < NO_RANK]
        if not len(at):
            return
        order = np.argsort(r, kind="stable")
        at, r = at[order], r[order]
        cut = np.flatnonzero(r[1:] != r[:-1]) + 1
        for k, positions in zip(r[np.concatenate([[0], cut])].tolist(), np.split(at, cut) if len(cut) else [at], strict=True):
            if k in index:
                index[k].append(positions)
            else:
                index[k] = [positions]
                heapq.heappush(heap, k)

    enter(inner)
    while heap:
        r = heapq.heappop(heap)
        held = index.pop(r)
        at = held[0] if len(held) == 1 else np.concatenate(held)
        at = at[alive[at] & (rank[at] == r)]
        if len(at) > 1:
            at = np.unique(at)
            chained = np.concatenate([[False], after[at[:-1]] == at[1:]])
            if chained.any():
                head = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - head) % 2 == 0]
        if not len(at):
            continue
        gone = after[at]
        beyond = after[gone]
        token[at] = r
        alive[gone] = False
        after[at] = beyond
        on = beyond >= 0
        before[beyond[on]] = at[on]
        back = before[at]
        touched = np.concatenate([at, back[back >= 0]])
        if len(touched) > 1:
            touched = np.unique(touched)
        right = after[touched]
        rank[touched] = np.where(right >= 0, v.rank(token[touched], token[right]), NO_RANK)
        enter(touched)
    sums = np.concatenate([[0], np.cumsum(alive)])
    return token[alive].astype(np.int32), sums[ends + 1] - sums[ends - size + 1]


_encoders: dict[str, pretoken.WordEncoder] = {}


def encoder(path: str) -> pretoken.WordEncoder:
    """One for each Python worker, so that later tasks know the words of earlier ones."""
    if path not in _encoders:
        _encoders[path] = pretoken.WordEncoder(vocabulary(path).encode_words)
    return _encoders[path]


def encoded(batches: Iterator[pa.RecordBatch], text: str, of: pretoken.WordEncoder, most: int = REPLAY_BYTES) -> Iterator[tuple[pa.RecordBatch, list[tuple[np.ndarray, np.ndarray]]]]:
    """Batches without their text, with (word numbers, word offsets) for groups of their rows.

    Of the texts only word numbers are held until the words are learnt.
    """
    waiting, size = [], 0
    for batch in batches:
        data, off = common.text_buffers(batch.column(text))
        waiting.append((batch.drop_columns([text]), [of.texts(data, off[i : j + 1]) for i, j in common.groups(off)]))
        size += int(off[-1] - off[0])
        if size >= most:
            of.learn()
            yield from waiting
            of.trim()
            waiting, size = [], 0
            common.give_back()
    of.learn()
    yield from waiting
    of.trim()
    common.give_back()


def documents(of: pretoken.WordEncoder, numbers: np.ndarray, word_off: np.ndarray, most: int = OUT_IDS) -> Iterator[np.ndarray]:
    """The token ids of each text of a group; long texts are spelled in pieces."""
    for a, b in zip(word_off[:-1].tolist(), word_off[1:].tolist(), strict=True):
        parts = [of.spell(numbers[at : min(b, at + most)])[0] for at in range(a, b, most)]
        yield parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.int32), *parts])


CODES = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_digests(docs: DataFrame, vocabulary_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: ``doc_id``, ``n_tokens`` and SHA-256 of its ids and of its decoded bytes.

    ids: decimal, joined by one space. Null and empty texts have no ids. Repeated rows and null keys are kept.
    """
    common.bounded_batches(docs.sparkSession)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, of = vocabulary(vocabulary_path), encoder(vocabulary_path)
        for batch, groups in encoded(batches, "text", of):
            n, id_sums, text_sums = [], [], []
            for numbers, word_off in groups:
                for ids in documents(of, numbers, word_off):
                    a, b = hashlib.sha256(), hashlib.sha256()
                    for at in range(0, len(ids), OUT_IDS):
                        part = ids[at : at + OUT_IDS]
                        spelled = v.digits[ranges(v.digits_begin[part], v.digits_length[part])]
                        a.update(spelled[0 if at else 1 :].tobytes())
                        b.update(v.decode(part))
                    n.append(len(ids))
                    id_sums.append(a.hexdigest())
                    text_sums.append(b.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(id_sums, pa.string()), pa.array(text_sums, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(step, f"doc_id {kind}, {CODES}")


def encode_ids(docs: DataFrame, vocabulary_path: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """``docs`` with the array of token ids of each text in column ``ids``, replaced if it is there."""
    common.bounded_batches(docs.sparkSession)
    rest = docs.select(F.col(text).alias("text"), common.carried(docs, [ids]))
    schema = docs.drop(ids).withColumn(ids, F.lit(None).cast("array<int>")).schema

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary(vocabulary_path)
        of = encoder(vocabulary_path)
        for batch, groups in encoded(batches, "text", of, 8 << 20):
            spelled = [x for numbers, word_off in groups for x in documents(of, numbers, word_off)]
            yield pa.RecordBatch.from_arrays([*common.uncarried(batch), pa.array(spelled, pa.list_(pa.int32()))], names=schema.names)

    return rest.mapInArrow(step, schema)


def counter(vocabulary_path: str) -> Callable[[], pretoken.WordEncoder]:
    """What makes, or finds, the encoder in a worker."""
    return functools.partial(encoder, vocabulary_path)


def token_counts(docs: DataFrame, of: Callable[[], pretoken.WordEncoder], text: str = "text", n: str = "n_tokens") -> DataFrame:
    """``docs`` without their text and with the number of its tokens in column ``n``; null texts have none."""
    common.bounded_batches(docs.sparkSession)
    rest = docs.select(F.col(text).alias("text"), common.carried(docs, [text, n]))
    schema = docs.drop(text, n).withColumn(n, F.lit(None).cast("long")).schema

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = of()
        for batch, groups in encoded(batches, "text", made):
            counts = []
            for numbers, word_off in groups:
                sums = np.concatenate([[0], np.cumsum(made.off[numbers + 1] - made.off[numbers])])
                counts.append(sums[word_off[1:]] - sums[word_off[:-1]])
            total = np.concatenate([np.zeros(0, np.int64), *counts])
            yield pa.RecordBatch.from_arrays([*common.uncarried(batch), pa.array(total, pa.int64())], names=schema.names)

    return rest.mapInArrow(step, schema)


def decode_ids(docs: DataFrame, vocabulary_path: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the text of each array of ids; bytes that aren't UTF-8 become U+FFFD. Null ids give null."""
    common.bounded_batches(docs.sparkSession)
    schema = docs.drop(text).withColumn(text, F.lit(None).cast("string")).schema

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(vocabulary_path)
        for batch in batches:
            made = [None if x is None else v.decode(np.array(x, np.int64)).decode("utf-8", "replace") for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in schema.names[:-1]), pa.array(made, pa.string())], names=schema.names)

    return docs.select(*schema.names[:-1], *([ids] if ids not in schema.names else [])).mapInArrow(step, schema)
