"""The pipeline's stages and their chain against brute force."""

import base64
import hashlib
import random

import pyarrow as pa
import pytest
from test_llm import brute_components, brute_contamination, brute_spans

import corpus_pipeline
from axisloom.llm import langid

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MAIL = {200: "jo.1@mail.example.com", 201: "x_y@a-b.org"}
ITEM = "one rare passage of a benchmark item that has rather more than thirteen words in it"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("corpus"))
    r = random.Random(12)
    vocab = {"aa": ["bridge", "water", "house", "the", "night"], "bb": ["straße", "wasser", "haus", "und", "nacht"], "cc": ["rivière", "maison", "nuit", "et", "où"]}
    say = lambda x, n: " ".join(r.choice(vocab[x]) for _ in range(n))
    rows = [(i, say(x, r.randint(20, 60)), x) for i in range(120) for x in [sorted(vocab)[i % 3]]]
    rows += [(k, say("aa", 20) + f" {m} " + say("aa", 15), "aa") for k, m in MAIL.items()]
    rows += [(300, rows[5][1], "cc"), (301, rows[3][1].upper(), "aa"), (302, rows[8][1] + " nuit", "cc"), (303, rows[9][1], "aa")]
    rows += [(400, say("aa", 10) + f" {ITEM} " + say("aa", 10), "aa"), (401, ITEM, "aa"), (402, "water " + " ".join(ITEM.split()[:12]) + " house", "aa")]
    rows += [(500, None, "aa"), (501, "12 !?", "bb"), (502, "", None), (None, say("bb", 30), None), (503, "<|endoftext|> " + say("aa", 25), "aa")]
    rows = [(k, t, x, "s", None if t is None else len(t)) for k, t, x in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, "short item")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows


def brute_stages(spark, d, rows):
    """The rows after each stage, and then the digests."""
    import public_tokenizers as P
    import tiktoken

    model = langid.train(spark.read.parquet(f"{d}/documents.parquet"))
    out = [[x for x in rows if not langid._predict(model, pa.array([x[1]], pa.string()))[2][0]]]
    of = brute_components([x[:2] for x in out[-1]])
    out.append([x for x, (k, _, c) in zip(out[-1], of, strict=True) if k == c])
    hit = brute_contamination([x[:2] for x in out[-1]], [(1, ITEM), (2, "short item")])
    out.append([x for x, h in zip(out[-1], hit, strict=True) if not h[-1]])
    masked = []
    for k, t, lang, source, _ in out[-1]:
        for a, kind, b in reversed(brute_spans(t)):
            t = t[:a] + ["[EMAIL]", "[IP]", "[CARD]", "[PHONE]"][kind] + t[b:]
        masked.append((k, t, lang, source, len(t)))
    out.append(masked)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    last = []
    for k, t, *_ in masked:
        ids = own.encode_ordinary(t)
        last.append((k, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    return [*out, last]


def test_stages_and_run(spark, corpus):
    d, rows = corpus
    want = brute_stages(spark, d, rows)
    gone = [{x[0] for x in a} - {x[0] for x in b} for a, b in zip([rows, *want], want)]
    assert {500, 501, 502} <= gone[0] and {300, 301, 302, 303} <= gone[1] and gone[2] == {400, 401}
    assert {x[0] for x in want[3] if "[EMAIL]" in x[1]} == set(MAIL)
    at = spark.read.parquet(f"{d}/documents.parquet")
    for no, ((name, stage), expected) in enumerate(zip(corpus_pipeline.STAGES, want, strict=True)):
        out = stage(spark, at, d)
        assert no == 4 or out.columns == COLUMNS, name
        assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, expected)), name
        at = spark.createDataFrame(expected, at.schema) if no < 4 else at
    assert sorted(map(repr, map(tuple, corpus_pipeline.run(spark, d).collect()))) == sorted(map(repr, want[-1]))
