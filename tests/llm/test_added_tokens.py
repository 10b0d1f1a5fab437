"""Jobs done whole, against brute force."""

import random
import zlib

import numpy as np
import pyarrow as pa

from axisloom.llm import bpe, queries, tokenfile

TEXT = "doc_id long, text string"


# ---- 7


def added_token_texts():
    r = random.Random(11)
    some = ["<|endoftext|>", "<|endof", "text|>", "a", " b", "\n", "don't", " ", "  ", "é", "'", "12", ""]
    fixed = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>", "<|endof", "text|> after a split one", "<|<|endoftext|>|>", "it'<|endoftext|>s", "", "plain"]
    return fixed + ["".join(r.choice(some) for _ in range(r.randint(0, 12))) for _ in range(300)]


def untouched():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_file("byte_bpe_50k.json"))


def test_added_tokens_as_the_untouched_library():
    texts, made = added_token_texts(), untouched()
    of, _ = tokenfile.library_encoder(queries.tokenizer_file("byte_bpe_50k.json"), added_tokens=True)
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    ids = [x.tolist() for _, gs in bpe.encoded(iter([batch]), "text", of) for n, o in gs for x in bpe.documents(of, n, o)]
    assert ids == [made.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids[0] == [64, 220, 50256, 275]


def test_op7_as_the_untouched_library(spark, tmp_path):
    texts, made = added_token_texts()[:40], untouched()
    spark.createDataFrame(list(enumerate(texts)), TEXT).write.parquet(str(tmp_path / "documents.parquet"))
    want, at = [], 0
    for k, t in enumerate(texts):
        ids = made.encode(t, add_special_tokens=False).ids + [2]
        want.append((k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(tuple(x) for x in queries.op7_token_files(spark, str(tmp_path)).collect()) == want
