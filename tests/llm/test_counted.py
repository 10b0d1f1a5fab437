"""Counts by tokenizer versions."""

import base64

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from axisloom.llm import queries, rollup


def test_counts_by_the_encoder(spark, tmp_path):
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(1, "s", "en", "unbelievable   words, don't!"), (2, "s", "en", "é漢字 12"), (3, "s", None, None), (None, "t", "en", ""), (4, "t", "en", "x" * 500)]
    d = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")
    got = rollup.counted(d, "byte_bpe_50k")
    want = [(k, s, x, "byte_bpe_50k", len(own.encode_ordinary(t or ""))) for k, s, x, t in rows]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    roll = rollup.Rollup(spark, str(tmp_path / "roll"))
    roll.apply("a", got.selectExpr("'insert' as op", "*", "cast(null as bigint) as old_n_tokens"))
    assert {(x.source, x.lang): (x.n_docs, x.n_tokens) for x in roll.totals().collect()}["s", "en"] == (2, want[0][-1] + want[1][-1])


TABLE = "doc_id long, source string, lang string, text string"
ROWS = [(k, f"s{k % 3}", "en" if k % 4 else None, t) for k, t in enumerate(["unbelievable   words, don't!", "é漢字 12", None, "", "a <|endoftext|> b", "x" * 3000, "two  words"] * 9)]
ROWS += [(None, "s0", "en", "no id"), (35, "s2", "en", "an id that comes twice"), (35, "s2", "en", "an id that comes twice")]


def test_the_query_against_the_libraries(spark, tmp_path):
    import public_tokenizers as P
    import tiktoken
    from tokenizers import Tokenizer

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    made = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {}
    for k, source, lang, t in ROWS:
        for version, n in (("byte_bpe_50k", len(own.encode_ordinary(t or ""))), ("byte_bpe_50k.json", len(made.encode(t or "", add_special_tokens=False).ids))):
            if version == "byte_bpe_50k":
                if k is not None and k % 7 == 0:
                    continue
                n += k is not None and k % 5 == 0
            docs, tokens = want.get((source, lang, version), (0, 0))
            want[source, lang, version] = docs + 1, tokens + n
    spark.createDataFrame(ROWS, TABLE).withColumns({"n": F.lit("clash"), "tokenizer": F.lit("clash")}).write.parquet(str(tmp_path / "documents.parquet"))
    got = {(x.source, x.lang, x.tokenizer): (x.n_docs, x.n_tokens) for x in queries.op4_token_counts(spark, str(tmp_path)).collect()}
    assert got == want
    assert rollup.history(spark.createDataFrame([], TABLE)).count() == 0


def test_the_history_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.register("documents", pa.Table.from_pylist([dict(zip(("doc_id", "source", "lang", "text"), x, strict=True)) for x in ROWS]))
    want = sorted(map(repr, con.execute(rollup.HISTORY_SQL).fetchall()))
    got = rollup.history(spark.createDataFrame(ROWS, TABLE), versions=(rollup.WORDS_V1, rollup.BYTES_V1)).select("source", "lang", "tokenizer", "n_docs", "n_tokens")
    assert sorted(repr(tuple(x)) for x in got.collect()) == want


def test_unknown_tokenizers_raise(spark):
    with pytest.raises(ValueError):
        rollup.counted(spark.createDataFrame([], "doc_id long, source string, lang string, text string"), "words-v2")
