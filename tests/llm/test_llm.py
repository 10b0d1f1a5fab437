"""The training-data operators against brute force, exact round trips and held-out accuracy, and edge cases."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from axisloom.llm import bpe, chat, common, decontam, jaccard, langid, pii, pretoken, quality, queries, rollup, tokenfile, topk, words
from axisloom.llm.components import components

AZ = {i: i + 32 for i in range(65, 91)}
TEXT = "doc_id long, text string"


def docs(spark, rows, schema=TEXT):
    return spark.createDataFrame(rows, schema)


EDGES = [(1, None), (2, ""), (3, " \n\t"), (None, "some words of a text without an id"), (4, "é"), (4, "é"), (5, "x" * 5000)]


# ---- words


@pytest.mark.parametrize("kind,pattern", [(words.BLANK_WORDS, r"[^\x20\x09-\x0D]+"), (words.ALNUM_WORDS, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")])
def test_words_match_the_patterns(kind, pattern):
    r = random.Random(1)
    texts = ["".join(r.choice("abZ9 \n\t.,-é漢\x1f'") for _ in range(r.randint(0, 60))) for _ in range(300)]
    data, off = common.text_buffers(pa.array(texts))
    for piece in (7, 1 << 20):
        s, e, h, word_off = words.document_words(data, off, kind, piece)
        got = [bytes(words.LOWER[data[a:b]]).decode() for a, b in zip(s, e)]
        want = [re.findall(pattern, t.translate(AZ)) for t in texts]
        assert got == [w for ws in want for w in ws]
        assert np.diff(word_off).tolist() == [len(w) for w in want]
        by_word = {}
        assert all(by_word.setdefault(w, x) == x for w, x in zip(got, h)) and len(set(by_word.values())) == len(by_word)


# ---- 1


def test_top_k_against_all_pairs(spark):
    r = np.random.default_rng(0)
    x = np.repeat(r.normal(0, 0.2, (60, 16)), 3, axis=0)  # ties
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(None, [1.0] * 16), (500, None), (550, [float("nan")] * 16), (600, [None] * 16), (650, []), (700, [0.5] * 3), (701, [0.5] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    want = brute_top_k(rows)
    for load in (1, 40, 1 << 20):
        assert sorted(tuple(t) for t in topk.top_k(df, load=load).collect()) == want
    assert topk.top_k(df.where("false")).count() == 0 and topk.surviving_share(df.where("false")) == 0


def brute_top_k(rows):
    """Rows as nodes: only a query's own row is left out."""
    own = [(i, np.floor(256 * np.array(v, np.float32).astype(float))) for i, v in rows if i is not None and v and all(t is not None and np.isfinite(t) for t in v)]
    out = []
    for a, (q, x) in enumerate(own):
        if q % 50 == 0:
            score = lambda y: max(-(2**63), min(2**63 - 1, sum(int(s) * int(t) for s, t in zip(x, y))))  # noqa: E731, B023
            best = sorted((-score(y), c) for b, (c, y) in enumerate(own) if b != a and len(x) == len(y))[:5]
            out += [(q, n, c, -s) for n, (s, c) in enumerate(best, 1)]
    return sorted(out)


def test_top_k_of_repeated_rows_and_large_numbers(spark):
    r = np.random.default_rng(14)
    x = r.normal(0, 1, (30, 8))
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    rows += [(0, rows[0][1]), (0, rows[1][1]), (50, rows[0][1]), (50, rows[0][1]), (50, rows[0][1]), (3, rows[3][1])]
    schema = "vec_id long, embedding array<float>"
    assert sorted(tuple(t) for t in topk.top_k(spark.createDataFrame(rows, schema)).collect()) == brute_top_k(rows)
    few = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.0, 1.0])]
    assert sorted(tuple(t) for t in topk.top_k(spark.createDataFrame(few, schema)).collect()) == brute_top_k(few) and len(brute_top_k(few)) == 4
    huge = [(i, [float(v) * 2.0**24 for v in row]) for i, row in enumerate(x[:8])] + [(50, [3e38] * 8), (51, [-3e38] * 8)]
    assert sorted(tuple(t) for t in topk.top_k(spark.createDataFrame(huge, schema)).collect()) == brute_top_k(huge)


def test_segment_statistics_turn_away_most_pairs(spark):
    r = np.random.default_rng(15)
    centers = r.normal(size=(40, 64)) * (0.85 ** np.arange(64))
    x = centers[r.integers(0, 40, 4000)] + 0.05 * r.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    turn = np.linalg.qr(r.normal(size=(64, 64)))[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x @ turn)], "vec_id long, embedding array<double>")
    assert topk.surviving_share(df) < 0.2
    even = r.normal(size=(4000, 64))
    df = spark.createDataFrame([(i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(even)], "vec_id long, embedding array<double>")
    assert topk.surviving_share(df) < 0.9


def test_bounds_hold():
    r = np.random.default_rng(1)
    x, y = np.floor(256 * r.normal(size=(40, 50))), np.floor(256 * r.normal(size=(30, 50)))
    basis = topk.Basis(x)
    for level in range(len(topk.resolutions(50))):
        bound = basis.statistics(x @ basis.axes, level) @ basis.statistics(y @ basis.axes, level).T
        assert (bound >= x @ y.T - 1e-5 * np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)).all()


# ---- 2, 3


def test_quality_learns_and_covers_long_texts(spark):
    r = random.Random(2)
    good = lambda n: " ".join(r.choice(["the", "river", "runs", "on", "under", "bridges", "slowly"]) for _ in range(n)) + "."
    bad = lambda n: " ".join(r.choice(["the", "river", "runs"]) + r.choice(["###", "$$$", "%%%"]) for _ in range(n))
    rows = [(i, good(r.randint(5, 60)) if i % 2 else bad(r.randint(5, 60))) for i in range(300)]
    d, labels = docs(spark, rows + [(900, None), (901, ""), (None, "x")]), docs(spark, [(i, i % 2) for i in range(300)] + [(900, None), (77, 3)], "doc_id long, quality int")
    net = quality.train(d, labels)
    got = {x.doc_id: x for x in quality.quality_scores(d, net).collect()}
    assert len(got) == 303 and got[None].held_out is None
    held = [got[i] for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(x.held_out for x in held) and np.mean([x.predicted == x.doc_id % 2 for x in held]) > 0.95
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for x in got.values())
    long = np.frombuffer((good(3000) + bad(3000)).encode(), np.uint8)
    assert np.isclose(net.pool_long(long, 1024)[0], net.score([long])[0], atol=1e-4)
    assert quality.quality_scores(d, quality.train(d, labels.where("false"))).count() == 303


def test_gradient_of_the_network():
    r = np.random.default_rng(3)
    net, texts, y = quality.Network(), [r.integers(32, 120, n).astype(np.uint8) for n in (5, 300, 700)], np.array([1.0, 0.0, 1.0])
    for w in net.weights():
        w += 0  # float32 throughout
    grads = net.gradients(texts, y, np.ones(3))

    def loss():
        p = net.score(texts)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for w, g in zip(net.weights(), grads, strict=True):
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old, e = w[at], 2e-3
        w[at] = old + e
        up = loss()
        w[at] = old - e
        down = loss()
        w[at] = old
        assert np.isclose((up - down) / (2 * e), g[at], rtol=0.1, atol=1e-3)


def test_language_learns_and_rejects(spark):
    r = random.Random(4)
    vocab = {"aa": ["bridge", "water", "house", "the", "night"], "bb": ["straße", "wasser", "haus", "und", "nacht"], "cc": ["rivière", "maison", "nuit", "et", "où"]}
    rows = [(i, " ".join(r.choice(vocab[x]) for _ in range(r.randint(5, 40))), x) for i in range(300) for x in [sorted(vocab)[i % 3]]]
    d = spark.createDataFrame(rows + [(400, None, "aa"), (401, "12 !?", "bb"), (402, "", None), (None, "haus und wasser", None)], "doc_id long, text string, lang string").withColumn("score", F.lit(1))
    model = langid.train(d)
    got = {x.doc_id: x for x in langid.language_report(d, model).collect()}
    held = [x for i, x in got.items() if x.held_out and i is not None and i < 300]
    assert held and np.mean([x.lang_pred == sorted(vocab)[x.doc_id % 3] for x in held]) > 0.97
    assert all(got[i].lang_pred == "und" and got[i].rejected and got[i].score == 0 for i in (400, 401, 402))
    kept = langid.recognised(d, model)
    assert kept.columns == d.columns and kept.where("doc_id in (400, 401, 402)").count() == 0 and kept.count() >= 300
    assert langid.language_report(d.where("false"), langid.train(d.where("false"))).count() == 0
    long = "haus und wasser " * 40000
    a = langid._predict(model, pa.array([long]))[1][0]
    assert np.isclose(a, langid._predict(model, pa.array(["haus und wasser " * 400]))[1][0], atol=1e-3)


# ---- 4, 5


def test_rollup_is_idempotent(spark, tmp_path):
    roll = rollup.Rollup(spark, str(tmp_path / "roll"))
    change = lambda rows: spark.createDataFrame(rows, rollup.CHANGES)
    assert roll.totals().count() == 0
    assert roll.apply("a", change([("insert", 1, "s", "en", "v1", 10, None), ("insert", 2, "s", None, "v1", 5, None), ("insert", 3, "s", "en", "v1", None, None)]))
    assert not roll.apply("a", change([("insert", 9, "s", "en", "v1", 99, None)]))
    assert roll.apply("b", change([("delete", 2, "s", None, "v1", 5, None), ("revise", 1, "s", "en", "v1", 7, 10)]))
    assert roll.apply("c", change([]))
    assert [tuple(x) for x in roll.totals().collect()] == [("s", "en", "v1", 2, 7)]
    assert roll.batches() == ["a", "b", "c"]
    with pytest.raises(Exception):
        roll.apply("d", change([("upsert", 1, "s", "en", "v1", 1, None)]))
    with pytest.raises(ValueError):
        roll.apply("../x", change([]))
    assert roll.batches() == ["a", "b", "c"]
    for wrong in (("delete", 77, "s", "en", "v1", 5, None), ("delete", 2, "s", None, "v1", 5, None), ("revise", 1, "s", "en", "v1", 1, 9), ("delete", 1, "s", "en", "v2", 7, None)):
        with pytest.raises(rollup.Refused):
            roll.apply("d", change([("insert", 5, "s", "en", "v1", 3, None), wrong]))
    assert roll.batches() == ["a", "b", "c"] and roll.totals().count() == 1
    assert roll.compact() and roll.batches() == ["a", "b", "c"] and roll._names("batches") == []
    assert not roll.apply("b", change([("insert", 9, "s", "en", "v1", 99, None)]))
    assert roll.apply("e", change([("delete", 1, "s", "en", "v1", 7, None), ("insert", None, None, "en", "v1", 4, None), ("insert", None, None, "en", "v1", 4, None)]))
    assert roll.compact() and roll.compact() and len(roll._names("bases")) == 1
    assert sorted(map(repr, (tuple(x) for x in roll.totals().collect()))) == sorted(map(repr, [("s", "en", "v1", 1, 0), (None, "en", "v1", 2, 8)]))
    with pytest.raises(rollup.Refused):
        roll.apply("f", change([("delete", 1, "s", "en", "v1", 7, None)]))


def test_chat_pairs(spark):
    turns = "conv_id long, turn long, role string, text string"
    a = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", None), (2, 1, "assistant", "same"), (3, 0, "user", "only here"), (None, 0, "user", "x")], turns)
    b = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "no"), (1, 2, "user", "why"), (2, 0, "user", ""), (2, 1, "assistant", "same")], turns)
    got = {r.pair_id: r for r in chat.preference_pairs(chat.conversations(a), chat.conversations(b)).collect()}
    assert sorted(got) == [1, 2, 3]
    one = got[1]
    assert one.n_prompt_turns == 1 and one.prompt == "<|im_start|>user\nhi<|im_end|>\n"
    begin, end = map(int, one.chosen_mask.split(":"))
    assert one.chosen[begin:end] == "yes<|im_end|>" and one.rejected_mask == f"{begin}:{end - 1}"
    assert got[2].n_prompt_turns == 2 and got[2].chosen == got[2].rejected == got[2].chosen_mask == ""
    assert got[3].n_prompt_turns == 0 and got[3].rejected == "" and got[3].chosen


# ---- 6


def brute_contamination(rows, items):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(AZ))
    out = []
    for doc, text in rows:
        w, hit, ids = find(text), set(), set()
        for item, it in items:
            x = find(it)
            n = min(13, len(x))
            for a in range(len(x) - n + 1 if n else 0):
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == x[a : a + n]:
                        hit |= set(range(b, b + n))
                        ids.add(str(item))
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(ids), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_contamination_against_brute_force(spark):
    r = random.Random(6)
    vocab = ["a", "B", "c3", "dé", "e"]
    say = lambda n, v=vocab: " ".join(r.choice(v) for _ in range(n))
    items = [(k, say(r.choice([0, 1, 4, 12, 13, 14, 30]), vocab + ["f", "g"])) for k in range(25)] + [(30, "z " * 40), (31, None), (None, "q r s"), (3, say(20))]
    rows = [(k, " ".join(x for x in (say(r.randint(0, 30)), (r.choice(items)[1] or "").upper() if r.random() < 0.7 else "", say(r.randint(0, 30))))) for k in range(120)]
    rows += [(200, "z, " * 60), *EDGES]
    d = docs(spark, rows).withColumn("n_words", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(repr, brute_contamination(rows, [x for x in items if x[0] is not None])))
    assert sorted(repr(tuple(x)) for x in decontam.contamination_report(d, bench).collect()) == want
    found = decontam.find_contamination(docs(spark, rows[:120]), bench)
    n_hit = {x.doc_id: sum(b - a for a, b in zip(x.hit_spans[::2], x.hit_spans[1::2])) for x in found.collect()}
    assert all(n_hit[x[0]] == x[2] for x in brute_contamination(rows[:120], [x for x in items if x[0] is not None]))
    clean = decontam.clean_documents(d, bench)
    assert clean.columns == d.columns and clean.count() == sum("False" in x for x in want)
    assert decontam.contamination_report(d.where("false"), bench).count() == 0
    assert decontam.contamination_report(d, bench.where("false")).where("n_hit > 0").count() == 0


# ---- 7, 8


def alphabet_texts(n, seed=7):
    r = random.Random(seed)
    a = list("aab'sstrevmld  \n\t19.,!é£漢字́😀½\x1c\x85\r")
    return ["".join(r.choice(a) for _ in range(r.randint(0, 40))) for _ in range(n)] + ["'", "don't they'll 'tis ''s", "a" * 3000, " " * 500, "ab" * 800, "\n\n  \n x", "<|endoftext|>"]


def test_bpe_as_the_libraries(spark):
    import public_tokenizers as P
    import tiktoken
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [*enumerate(alphabet_texts(1500)), (8000, None), (None, "no id"), (8001, ""), (8001, "")]
    d = docs(spark, rows).withColumn("n_tokens", F.lit("clash"))
    got = sorted(repr(tuple(x)) for x in bpe.encode_digests(d, path).collect())
    want = []
    for k, t in rows:
        ids = own.encode_ordinary(t or "")
        want.append(repr((k, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())))
    assert got == sorted(want)
    back = bpe.decode_ids(bpe.encode_ids(d, path), path)
    assert back.where("coalesce(text, '') <> decoded").count() == 0
    made = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    made.encode_special_tokens = True
    of, _ = tokenfile.library_encoder(P.path("byte_bpe_50k.json"))
    batch = pa.RecordBatch.from_arrays([pa.array([t or "" for _, t in rows])], names=["text"])
    ids = [x.tolist() for _, gs in bpe.encoded(iter([batch]), "text", of) for n, o in gs for x in bpe.documents(of, n, o)]
    assert ids == [made.encode(t or "", add_special_tokens=False).ids for _, t in rows]


def test_word_table():
    t, r = pretoken.WordTable(4), np.random.default_rng(8)
    keys = np.unique(r.integers(1, 1 << 62, 5000).astype(np.uint64))
    for part in np.array_split(keys, 7):
        t.add(part)
    assert (t.find(keys) >= 0).all() and len(set(t.find(keys))) == len(keys) and (t.find(keys + np.uint64(1)) < 0).all()


def test_elias_fano():
    r = np.random.default_rng(9)
    for n in (1, 255, 256, 257, 3000):
        for top in (1, 50, 10**10):
            v = np.sort(r.integers(0, top, n)) - 7
            e, _ = tokenfile.EliasFano.parse(tokenfile.EliasFano.of(v).to_bytes(), 0)
            assert (e.between(0, n) == v).all() and (e.between(n // 3, n - n // 4) == v[n // 3 : n - n // 4]).all() and all(e.select(i) == v[i] for i in range(0, n, max(1, n // 100)))
            assert len(e.to_bytes()) * 8 <= n * (3 + max(1, (top // n).bit_length() + 1)) + 8 * (60 + n // 64)
    with pytest.raises(IndexError):
        e.select(n)


def test_token_files(spark, tmp_path):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = [(k * 3 % 101, t) for k, t in enumerate(alphabet_texts(90))] + [(None, "no id"), (500, None), (500, "")]
    got = tokenfile.token_file_report(docs(spark, rows), P.path("byte_bpe_50k.json"), path=str(tmp_path / "t"), shard_ids=200).collect()
    made.encode_special_tokens = True
    want = {}
    for k, t in rows:
        ids = made.encode(t or "", add_special_tokens=False).ids + [2]
        want.setdefault(k, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    have, end = {}, 0
    for x in sorted(got, key=lambda x: x.start):
        assert x.start == end
        end += x.n_tokens
        have.setdefault(x.doc_id, []).append((x.n_tokens, x.ids_crc32))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    order = [x.doc_id for x in sorted(got, key=lambda x: x.start)]
    assert order == sorted(order, key=lambda k: (k is not None, k or 0))
    shard = tokenfile.Shard.parse(bytes(spark.read.parquet(str(tmp_path / "t")).where("seq = 0 and part = 0").first().shard))
    assert shard.document(0)[-1] == 2


# ---- 9


def brute_components(rows):
    sets, of = {}, []
    for k, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(AZ))
        s = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
        of.append((k, s))
        if s and k is not None:
            sets[s] = min(k, sets.get(s, k))
    root = {s: s for s in sets}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    every = list(sets)
    for i, a in enumerate(every):
        for b in every[:i]:
            n = len(a & b)
            if 100 * n >= 80 * (len(a) + len(b) - n):
                root[find(a)] = find(b)
    least = {}
    for s, k in sets.items():
        least[find(s)] = min(k, least.get(find(s), k))
    return [(k, len(s), None if k is None else least[find(s)] if s else k) for k, s in of]


def near_copies(seed=10):
    r = random.Random(seed)
    say = lambda n: [f"w{r.randint(0, 3000)}" for _ in range(n)]
    passage = say(40)
    rows = []
    for n in (3, 5, 9, 30, 80, 200):
        for _ in range(4):
            base = say(n)
            for _ in range(r.randint(1, 12)):
                x = list(base)
                for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                    x[r.randrange(len(x))] = f"e{r.randint(0, 10**6)}"
                if r.random() < 0.3:
                    x += passage
                rows.append(" ".join(x))
    r.shuffle(rows)
    return [*enumerate(rows, 10), *EDGES]


@pytest.mark.parametrize("how", [{}, {"block_sets": 6, "hot_rows": 3}])
def test_jaccard_against_all_pairs(spark, how):
    rows = near_copies()
    got = jaccard.jaccard_components(docs(spark, rows).withColumn("n", F.lit("clash")), **how).collect()
    assert sorted(map(repr, ((x.doc_id, x.n_shingles, x.component_id) for x in got))) == sorted(map(repr, brute_components(rows)))


def test_deduplicated_keeps_one_of_each(spark):
    rows = near_copies(11)
    d = docs(spark, rows).withColumn("source", F.lit("s"))
    kept = jaccard.deduplicated(d)
    want = sorted({c for _, _, c in brute_components(rows) if c is not None})
    assert kept.columns == d.columns and sorted(x.doc_id for x in kept.where("doc_id is not null").collect()) == want
    assert kept.where("doc_id is null").count() == 1
    assert jaccard.jaccard_components(d.where("false")).count() == 0


def test_prefixes_never_lose_a_link():
    r = np.random.default_rng(12)
    order = jaccard.Prefixes(r.integers(0, 50, 1 << jaccard.SKETCH_BITS).astype(np.uint32), 80)
    for _ in range(300):
        n = int(r.integers(1, 80))
        pool = r.integers(1, 1 << 63, 2 * n).astype(np.uint64)
        a = np.unique(pool[:n])
        b = np.unique(np.concatenate([a[r.random(len(a)) > 0.12], pool[n : n + int(r.integers(0, max(1, n // 8)))]]))
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= 80 * (len(a) + len(b) - both):
            (p, x), (q, y) = order.of(a), order.of(b)
            cut = lambda s, z: s[: order.plain(z) + min(x, y) - 1]  # noqa: E731, B023
            assert len(np.intersect1d(cut(p, len(a)), cut(q, len(b)))) >= min(x, y)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (None, 3)]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 130)}}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# ---- 10


def brute_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        x = re.sub("[^0-9]", "", m.group())
        if 14 <= len(x) <= 19 and pii.luhn(x):
            out.append((m.start(), 2, m.end()))
    return sorted(out + [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15])


def test_base_spans_against_the_patterns():
    r = random.Random(13)
    for chars, n in (("ab.@-%é 1", 8000), ("0123.25 +()-", 8000), ("4 -0", 3000)):
        for _ in range(n):
            t = "".join(r.choice(chars) for _ in range(r.randint(0, 40)))
            assert pii.base_spans(t) == brute_spans(t), t
    for t in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "a@" * 50_000, "+1" + " " * 200_000):
        pii.base_spans(t)


def test_field_learns_and_masks(spark):
    held = pii.labelled_table(150, 77)
    data, start, end, text = pii.tokenized([" ".join(x) for x, _ in held])
    got = pii.field().decode(pii.field().scores(data, start, end, text), text)
    assert np.mean([a == pii.LABELS[b] for a, b in zip((a for _, y in held for a in y), got, strict=True)]) > 0.98
    t = "Call (555) 123-4567 or write to jo.1@mail.example.com. Card 4111 1111 1111 1111, host 10.0.0.1, order 1234 5678 9012 3456."
    rows = [*EDGES, (20, t), (21, "nothing here 12"), (22, "é +1 (269) 555-3296 4524132264652876 x")]
    d = docs(spark, rows).withColumn("n_chars", F.length("text").cast("long"))
    got = {x.doc_id: x for x in pii.pii_report(d.where("doc_id is not null")).collect()}
    assert (got[20].n_email, got[20].n_ip, got[20].n_card, got[20].n_phone) == (1, 1, 1, 0)
    base = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in brute_spans(t))
    assert got[20].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert set(base.split(",")) < set(got[20].spans.split(",")) and "phone:5:19" in got[20].spans
    assert got[21].spans == "" and got[1].spans == "" and got[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    out = {x.doc_id: x for x in pii.masked(d).collect()}
    assert out[20].text == "Call [PHONE] or write to [EMAIL]. Card [CARD], host [IP], order 1234 5678 9012 3456."
    assert out[20].n_chars == len(out[20].text) and out[21].text == "nothing here 12" and out[1].text is None
    assert not re.search(r"\d{4}", out[22].text)
    assert pii.masked(d).columns == d.columns and pii.masked(d.where("false")).count() == 0


def test_every_operator_has_its_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("total", [10, 300_000, 10**9])
def test_spread_join_as_a_plain_one(spark, total):
    left = spark.createDataFrame([(k, (k * k) % 7, "x") for k in range(200)] + [(300, None, "x"), (301, 0, "alone")], "row long, key int, tag string")
    right = left.where("key is not null and key <> 4").groupBy("key").agg(F.count("*").alias("rows"), F.max("row").alias("most"))
    got = jaccard._spread_join(left, right, ["key"], "rows", total, "row", "tag = 'alone2'")
    want = left.join(right.drop("rows"), "key", "left").select(*got.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
