"""Alignment of two tokenizers' tokens over the same bytes.

Both tokenizers' tokens tile the bytes of a text. The ranges of B's tokens are a static index: two sorted arrays,
stabbed by bisection. For each A token the index lists the B tokens that its range overlaps; a gap between A tokens
that no listed B token spans is a group boundary. Where an A and a B token end together they are linked.

Tokens that end together are suffixes of one another, so all pairs that can ever be linked follow from the two
vocabularies: at most as many as these have bytes in all, times the ids that share the same bytes. Counts of linked
pairs are one array over that list, whatever the corpus, and so have a size bound when they are sent to tasks.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisloom.llm import bpe, common, tokenfile
from axisloom.llm.pretoken import ranges

#: Tokens aligned at a time.
WINDOW = 1 << 17
#: Bytes of one text that the piece tokenizer gets at a time, where its vocabulary allows to cut.
PIECE_BYTES = 1 << 20


def byte_letters() -> dict[str, int]:
    """The letter by which byte-level vocabularies write each byte: printable ones stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Spelling:
    """The bytes of every id, with those of all ids in one array; ids that spell nothing have no bytes."""

    def __init__(self, spelled: list[bytes]):
        self.spelled = spelled
        self.length = np.array([len(b) for b in spelled], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(spelled), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.data[ranges(self.begin[ids], self.length[ids])]


def _wide(n: int) -> str:
    return "<u2" if n <= 1 << 16 else "<u4"


class Tokenizers:
    """Both tokenizers, their spellings, and the list of pairs that can end together."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        letters = byte_letters()
        with open(a_path, encoding="utf-8") as f:
            made = json.load(f)
        spelled = defaultdict(bytes, {i: bytes(letters[c] for c in w) for w, i in made["model"]["vocab"].items() if all(c in letters for c in w)})
        for t in made.get("added_tokens", []):
            spelled[t["id"]] = b""  # never met: their strings are plain text
        self.a = Spelling([spelled[i] for i in range(max(spelled) + 1)])
        self.a_path = a_path
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b = Spelling([self._piece(i) for i in range(self.pieces.get_piece_size())])
        # a cut before a blank is safe if no piece goes on after one
        self.cuts = not any(b" " in s.lstrip(b" ") for s in self.b.spelled)
        self.a_kind, self.b_kind = _wide(len(self.a.spelled)), _wide(len(self.b.spelled))
        self.pairs = self._pairs()

    def _piece(self, i: int) -> bytes:
        if self.pieces.is_control(i) or self.pieces.is_unknown(i):
            return b""
        piece = self.pieces.id_to_piece(i)
        if self.pieces.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def _pairs(self) -> np.ndarray:
        """Sorted keys of all (A id, B id) of which one's bytes end with the other's."""
        by_bytes: tuple[dict, dict] = ({}, {})
        for held, of in zip(by_bytes, (self.a, self.b), strict=True):
            for i, s in enumerate(of.spelled):
                if s:
                    held.setdefault(s, []).append(i)
        keys = set()
        for s, ids in by_bytes[0].items():
            for k in range(len(s)):
                keys.update(a << 32 | b for b in by_bytes[1].get(s[k:], ()) for a in ids)
        for s, ids in by_bytes[1].items():
            for k in range(1, len(s)):
                keys.update(a << 32 | b for a in by_bytes[0].get(s[k:], ()) for b in ids)
        return np.array(sorted(keys), np.int64)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of each pair in the list."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        if not (self.pairs[at] == key).all():
            raise ValueError("tokens that end together must be suffixes of one another")
        return at

    def encode_b(self, text: str) -> list[int]:
        """The ids of a whole text; a long one is cut before single blanks, which no piece crosses."""
        if not self.cuts or len(text) <= PIECE_BYTES:
            return self.pieces.encode(text, num_threads=1)
        ids, at = [], 0
        while at < len(text):
            to = at + PIECE_BYTES
            while to < len(text) and not (text[to] == " " and text[to - 1] not in " ▁" and text[to + 1 : to + 2] not in ("", " ", "▁")):
                to += 1
            ids += self.pieces.encode(text[at + (at > 0) : to], num_threads=1)  # the tokenizer puts the blank back
            at = to
        return ids


@functools.cache
def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    """One for each process."""
    return Tokenizers(a_path, b_path)


class IntervalIndex:
    """The byte ranges of tokens that tile a stretch from 0 on, for stabbing by bisection."""

    def __init__(self, length: np.ndarray):
        self.ends = np.cumsum(length)
        self.starts = self.ends - length

    def overlapping(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and past the last of the ranges that share a byte with each [start, end)."""
        return np.searchsorted(self.ends, start, "right"), np.searchsorted(self.starts, end, "left")


def align(a_length: np.ndarray, b_length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A token at the end of each group, B token there, overlaps of each A token) of two tilings of the same bytes.

    The B tokens that an A token overlaps are first .. past; a boundary lies after it if the next one's first is its past.
    """
    if not len(a_length):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    index = IntervalIndex(b_length)
    end = np.cumsum(a_length)
    first, past = index.overlapping(end - a_length, end)
    last = np.flatnonzero(np.append(first[1:] == past[:-1], True))
    return last, past[last] - 1, past - first


def token_table(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and the ids of both tokenizers, packed, in a table of the shared folder.

    A tokenizes a blank and the text, B the text, before which it puts a blank itself. Texts that are null, empty, or
    whose joined A or B bytes differ from a blank and the text have no ids. Null keys and repeated rows are kept.
    """
    common.bounded_batches(docs.sparkSession)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(a_path, b_path)
        of, _ = tokenfile.library_encoder(a_path)
        of.trim()
        for batch in batches:
            data, off = common.text_buffers(batch.column("spaced"))
            a_ids, b_ids = [], []
            for i, j in common.groups(off):
                numbers, word_off = of.texts(data, off[i : j + 1])
                of.learn()
                texts = [data[s + 1 : e].tobytes().decode("utf-8", "replace") for s, e in zip(off[i:j].tolist(), off[i + 1 : j + 1].tolist(), strict=True)]
                if j - i > 1:
                    found = both.pieces.encode(texts, num_threads=1)
                else:
                    found = [both.encode_b(texts[0])]
                for n, (a, b) in enumerate(zip(bpe.documents(of, numbers, word_off), found, strict=True)):
                    want, b = data[off[i + n] : off[i + n + 1]], np.array(b, np.int64)
                    whole = len(want) > 1 and all(np.array_equal(s.joined(x), want) for s, x in ((both.a, a), (both.b, b)))
                    a_ids.append(a.astype(both.a_kind).tobytes() if whole else b"")
                    b_ids.append(b.astype(both.b_kind).tobytes() if whole else b"")
                of.trim()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(a_ids, pa.binary()), pa.array(b_ids, pa.binary())], names=["doc_id", "a", "b"])

    kind = docs.schema[key].dataType.simpleString()
    spaced = docs.select(F.col(f"`{key}`").alias("doc_id"), F.concat(F.lit(" "), F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("spaced"))
    return common.written(spaced.mapInArrow(common.tidied(step), f"doc_id {kind}, a binary, b binary"), "aligned")


def _ids(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a packed column and the offsets of its rows among them."""
    data, off = common.text_buffers(column)
    size = np.dtype(kind).itemsize
    return np.frombuffer(data[off[0] : off[-1]].tobytes(), kind), (off - off[0]) // size


def windows(both: Tokenizers, a: np.ndarray, b: np.ndarray, most: int = WINDOW) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The tokens of one text in stretches of about ``most`` that end where tokens of both end."""
    at, bt = 0, 0
    while at < len(a):
        room = most
        while True:
            x, y = a[at : at + room], b[bt : bt + room]
            if at + room >= len(a) and bt + room >= len(b):
                break
            ends_a, ends_b = np.cumsum(both.a.length[x]), np.cumsum(both.b.length[y])
            met = np.flatnonzero(np.isin(ends_a, ends_b, assume_unique=True))
            if len(met):
                x = x[: met[-1] + 1]
                y = y[: np.searchsorted(ends_b, ends_a[met[-1]]) + 1]
                break
            room *= 2
        yield x, y
        at, bt = at + len(x), bt + len(y)


def _stretches(both: Tokenizers, a: np.ndarray, a_off: np.ndarray, b: np.ndarray, b_off: np.ndarray) -> Iterator[tuple[int, int, bool, np.ndarray, np.ndarray]]:
    """(first row, past the last, whether their tokens end here, A ids, B ids): several rows at a time, or a part of a long one."""
    n = len(a_off) - 1
    i = 0
    while i < n:
        j = max(i + 1, int(min(np.searchsorted(a_off, a_off[i] + WINDOW, "right"), np.searchsorted(b_off, b_off[i] + WINDOW, "right"))) - 1)
        j = min(j, n)
        x, y = a[a_off[i] : a_off[j]], b[b_off[i] : b_off[j]]
        if j - i > 1 or max(len(x), len(y)) <= WINDOW:
            yield i, j, True, x, y
        else:
            parts = windows(both, x, y, WINDOW)
            held = next(parts)
            for part in parts:
                yield i, j, False, *held
                held = part
            yield i, j, True, *held
        i = j


def pair_counts(tokens: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``pair`` (its number in the list), ``a_id``, ``b_id`` and ``links``: how often these two end together in all texts.

    Each task adds up its own links first. Rows: at most as many as the list of pairs, for any corpus.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(a_path, b_path)
        total = np.zeros(len(both.pairs), np.int64)
        for batch in batches:
            (a, a_off), (b, b_off) = _ids(batch.column("a"), both.a_kind), _ids(batch.column("b"), both.b_kind)
            for *_, x, y in _stretches(both, a, a_off, b, b_off):
                end_a, end_b, _ = align(both.a.length[x], both.b.length[y])
                total += np.bincount(both.pair(x[end_a], y[end_b]), minlength=len(total))
        at = np.flatnonzero(total)
        key = both.pairs[at]
        for k in range(0, len(at), 50_000):
            part = slice(k, k + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(at[part], pa.int32()), pa.array(key[part] >> 32, pa.int32()), pa.array(key[part] & 0xFFFFFFFF, pa.int32()), pa.array(total[at[part]])], names=["pair", "a_id", "b_id", "links"])

    return tokens.select("a", "b").mapInArrow(common.tidied(step), "pair int, a_id int, b_id int, links long").groupBy("pair", "a_id", "b_id").agg(F.sum("links").alias("links"))


def groups(tokens: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``doc_id`` and ``groups``: the smallest stretches that both tokenizers end together, as ids of A and of B."""
    kind = tokens.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, groups array<struct<a: array<int>, b: array<int>>>"
    field = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(a_path, b_path)
        for batch in batches:
            (a, a_off), (b, b_off) = _ids(batch.column("a"), both.a_kind), _ids(batch.column("b"), both.b_kind)
            out = []
            for r in range(batch.num_rows):
                x, y = a[a_off[r] : a_off[r + 1]], b[b_off[r] : b_off[r + 1]]
                end_a, end_b, _ = align(both.a.length[x], both.b.length[y])
                out.append([{"a": p.tolist(), "b": q.tolist()} for p, q in zip(np.split(x, end_a[:-1] + 1), np.split(y, end_b[:-1] + 1), strict=True)] if len(x) else [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, field)], names=["doc_id", "groups"])

    return tokens.mapInArrow(step, schema)


class _Writer:
    """Groups as text: ids in decimal, A's before B's, with what parts them."""

    def __init__(self, size: int):
        digits = [str(i).encode() for i in range(size)]
        self.length = np.array([len(x) for x in digits])
        self.begin = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(digits), np.uint8)

    def write(self, x: np.ndarray, y: np.ndarray, end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, where each group's end): every group ends with a semicolon."""
        group_a, group_b = np.searchsorted(end_a, np.arange(len(x))), np.searchsorted(end_b, np.arange(len(y)))
        place_a = np.arange(len(x)) + np.append(0, end_b + 1)[group_a]
        place_b = np.arange(len(y)) + end_a[group_b] + 1
        ids = np.empty(len(x) + len(y), np.int64)
        after = np.full(len(ids), ord(","), np.uint8)
        ids[place_a], ids[place_b] = x, y
        after[place_a[end_a]], after[place_b[end_b]] = ord("|"), ord(";")
        length = self.length[ids]
        stop = np.cumsum(length + 1)
        out = np.empty(int(stop[-1]) if len(stop) else 0, np.uint8)
        out[stop - 1] = after
        out[ranges(stop - 1 - length, length)] = self.data[ranges(self.begin[ids], length)]
        return out, stop[place_b[end_b]]


@functools.cache
def _writer(size: int) -> _Writer:
    return _Writer(size)


REPORT = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, n_overlaps long"


def alignment_report(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: tokens, groups, links, links whose pair is the best of its B id (ties included), the sum of the links' counts, and a digest of the groups.

    The texts are tokenized once; a second pass over the ids counts pairs, a third reads the counts. What reaches the
    driver, and from there each task, is the array of counts over the list of pairs, whose size the vocabularies bound.
    """
    both = tokenizers(a_path, b_path)
    tokens = token_table(docs, a_path, b_path, key, text)
    count = np.zeros(len(both.pairs), np.int64)
    for batch in pair_counts(tokens, a_path, b_path).select("pair", "links").toArrow().to_batches():
        count[batch.column("pair").to_numpy()] = batch.column("links").to_numpy()
    best = np.zeros(len(both.b.spelled), np.int64)
    np.maximum.at(best, both.pairs & 0xFFFFFFFF, count)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(a_path, b_path)
        writer = _writer(max(len(both.a.spelled), len(both.b.spelled)))
        for batch in batches:
            (a, a_off), (b, b_off) = _ids(batch.column("a"), both.a_kind), _ids(batch.column("b"), both.b_kind)
            sums = np.zeros((batch.num_rows, 4), np.int64)  # groups, best links, counts, overlaps
            digests, digest = [], hashlib.sha256()
            for i, j, over, x, y in _stretches(both, a, a_off, b, b_off):
                end_a, end_b, overlaps = align(both.a.length[x], both.b.length[y])
                pair = both.pair(x[end_a], y[end_b])
                links = count[pair]
                raw, stop = writer.write(x, y, end_a, end_b)
                raw = raw.tobytes()
                if not over or j - i == 1:
                    sums[i] += len(pair), (links == best[y[end_b]]).sum(), links.sum(), overlaps.sum()
                    digest.update(raw[: len(raw) - over])
                    if over:
                        digests.append(digest.hexdigest() if sums[i, 0] else "")
                        digest = hashlib.sha256()
                    continue
                # several whole rows: their tokens end together, so a row's groups are a run of them
                edge = a_off[i : j + 1] - a_off[i]
                cut = np.searchsorted(end_a, edge)
                for col, values, at in ((0, np.ones(len(pair), np.int64), cut), (1, links == best[y[end_b]], cut), (2, links, cut), (3, overlaps, edge)):
                    total = np.append(0, np.cumsum(values))
                    sums[i:j, col] = total[at[1:]] - total[at[:-1]]
                edges = np.append(0, stop)[cut].tolist()
                digests += [hashlib.sha256(raw[p : q - 1]).hexdigest() if q > p else "" for p, q in zip(edges[:-1], edges[1:], strict=True)]
            cols = [np.diff(a_off), np.diff(b_off), sums[:, 0], sums[:, 0], sums[:, 1], sums[:, 2]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c.astype(np.int64)) for c in cols), pa.array(digests, pa.string()), pa.array(sums[:, 3])],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps"],
            )

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.mapInArrow(common.tidied(step), f"doc_id {kind}, {REPORT}")
