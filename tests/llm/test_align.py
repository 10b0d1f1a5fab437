import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from axisloom.llm import align, queries

A, B = queries.tokenizer_file("byte_bpe_50k.json"), queries.tokenizer_file("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B), {i: w for w, i in a.get_vocab().items()}


def brute(libraries, texts):
    """Per text, from the untouched libraries: token ends one by one, groups by a walk over both lists."""
    a, b, words = libraries
    letters = align.byte_letters()
    told, counts = [], Counter()
    for text in texts:
        row = None
        if text:
            ids_a = a.encode(" " + text, add_special_tokens=False).ids
            ids_b = b.encode(text)
            bytes_a = [bytes(letters[c] for c in words[i]) for i in ids_a]
            bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
            want = (" " + text).encode()
            if b"".join(bytes_a) == want and b"".join(bytes_b) == want:
                ends = [{}, {}]
                for k, (ids, raw) in enumerate(((ids_a, bytes_a), (ids_b, bytes_b))):
                    at = 0
                    for i, w in zip(ids, raw, strict=True):
                        at += len(w)
                        ends[k][at] = i
                cuts = sorted(set(ends[0]) & set(ends[1]))
                links = [(ends[0][e], ends[1][e]) for e in cuts]
                counts.update(links)
                parts, before = [], 0
                for e in cuts:
                    parts.append("|".join(",".join(str(i) for at, i in sorted(ends[k].items()) if before < at <= e) for k in (0, 1)))
                    before = e
                row = (len(ids_a), len(ids_b), len(cuts), links, ";".join(parts))
        told.append(row)
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [
        (0, 0, 0, 0, 0, 0, "") if r is None else (r[0], r[1], r[2], len(r[3]), sum(counts[p] == best[p[1]] for p in r[3]), sum(counts[p] for p in r[3]), hashlib.sha256(r[4].encode()).hexdigest())
        for r in told
    ]


COLS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_matches_the_libraries(spark, libraries):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text is null or length(text) < 4000").repartition(5)
    rows = docs.collect()
    want = brute(libraries, [r.text for r in rows])
    got = {r.doc_id: tuple(r[c] for c in COLS) for r in align.alignment_report(docs, A, B).collect()}
    assert len(got) == len(rows) == len({r.doc_id for r in rows})
    for r, w in zip(rows, want, strict=True):
        assert got[r.doc_id] == w, r.doc_id


def test_whole_query(spark):
    got = queries.op13_alignment(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted(got.doc_id) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    # every link of a pair adds the pair's count: the sum over texts is the sum of squares
    tokens = align.token_table(docs, A, B)
    links = align.pair_counts(tokens, A, B).toPandas()
    assert got.count_sum.sum() == (links.links**2).sum() and got.n_links.sum() == links.links.sum()
    assert (got.n_overlaps >= got.n_groups).all()


ODD = [None, "", " ", "  ", "\n", "a▁b", "▁", "<|endoftext|> x<|endoftext|>", "<s>x</s> <unk> <0x41>", "nul\x00byte", "é́ 漢字 \U0001f600\U0001f600", "tabs\t\tand\r\nlines  ", "don't I'll WE'VE 123456 78,9", "　wide x", "a" * 300, "!?" * 200, "word " * 50, "word " * 50, "<0x0A>"]


def test_odd_texts_and_columns(spark, libraries):
    rows = [(i, t, "x", 1) for i, t in enumerate(ODD)] + [(None, "null key", "y", 2), (None, None, "y", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, a string, n_a int")
    want = brute(libraries, [r[1] for r in rows])
    got = sorted(((r.doc_id is None, r.doc_id or 0, *(r[c] for c in COLS)) for r in align.alignment_report(docs, A, B).collect()), key=repr)
    assert got == sorted(((r[0] is None, r[0] or 0, *w) for r, w in zip(rows, want, strict=True)), key=repr)
    empty = align.alignment_report(docs.where("doc_id > 99"), A, B)
    assert empty.count() == 0 and empty.columns[:8] == ["doc_id", *COLS]


def test_groups_are_the_text(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    both = align.tokenizers(A, B)
    for r in align.groups(align.token_table(docs, A, B), A, B).collect():
        text = ODD[r.doc_id]
        for g in r.groups:
            assert both.a.joined(np.array(g.a)).tobytes() == both.b.joined(np.array(g.b)).tobytes()
        if r.groups:
            assert b"".join(both.a.joined(np.array(g.a)).tobytes() for g in r.groups) == (" " + text).encode()


def test_long_texts_in_windows_and_pieces(spark, monkeypatch):
    """A text of many windows equals itself in one; pieces of a long text are those of the whole."""
    text = "\n".join(t for t in ODD if t and "▁" not in t) * 40
    docs = spark.createDataFrame([(1, text), (2, "short"), (3, text)], "doc_id long, text string").coalesce(1)
    both = align.tokenizers(A, B)
    monkeypatch.setattr(align, "PIECE_BYTES", 100)
    assert both.encode_b(text) == both.pieces.encode(text)
    tokens = align.token_table(docs, A, B).collect()
    x, y = (np.frombuffer(bytes(next(r for r in tokens if r.doc_id == 1)[c]), np.uint16) for c in ("a", "b"))
    parts = list(align.windows(both, x, y, 16))
    assert len(parts) > 100
    assert np.array_equal(np.concatenate([p for p, _ in parts]), x) and np.array_equal(np.concatenate([q for _, q in parts]), y)
    assert all(both.a.length[p].sum() == both.b.length[q].sum() for p, q in parts)
    want = {r.doc_id: r for r in align.alignment_report(docs, A, B).collect()}
    assert want[1][1:] == want[3][1:]
    monkeypatch.setattr(align, "WINDOW", 64)
    cut = list(align._stretches(both, x, np.array([0, len(x)]), y, np.array([0, len(y)])))
    assert len(cut) > 50 and [c[2] for c in cut] == [False] * (len(cut) - 1) + [True]
    joined = [align.align(both.a.length[c[3]], both.b.length[c[4]]) for c in cut]
    assert sum(len(e) for e, _, _ in joined) == want[1].n_groups and sum(o.sum() for *_, o in joined) == want[1].n_overlaps


def test_pairs_are_all_suffixes():
    both = align.tokenizers(A, B)
    assert len(both.pairs) <= 2 * (both.a.length.sum() + both.b.length.sum())
    some = both.pairs[:: len(both.pairs) // 500]
    for k in some.tolist():
        p, q = both.a.spelled[k >> 32], both.b.spelled[k & 0xFFFFFFFF]
        assert p.endswith(q) or q.endswith(p)
