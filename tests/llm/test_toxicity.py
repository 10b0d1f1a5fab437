import itertools
import math

import numpy as np
import regex

from axisloom.llm import queries, toxicity

LEXICON = toxicity.Lexicon({("idiot", True): 5.0, ("moron", False): 4.0, ("dull", True): 2.0}, {"bocot": 1.5})


def features(texts, lexicon=LEXICON):
    raw = [t.encode() for t in texts]
    off = np.cumsum([0, *map(len, raw)])
    return toxicity.features(np.frombuffer(b"".join(raw), np.uint8), off, lexicon)


def plain(text):
    """The same by regular expressions, one text at a time."""
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    words = [m.group() for m in regex.finditer(r"\p{L}+", low)]
    raw = [m.group() for m in regex.finditer(r"\p{L}+", text)]

    def weight(w):
        return max([v for (e, whole), v in LEXICON.entries.items() if w == e or (not whole and w.startswith(e))], default=0.0)

    ws = [weight(w) for w in words]
    second = [i for i, w in enumerate(words) if w in toxicity.SECOND_PERSON]
    near = [min((abs(i - j) for j in second), default=1 << 30) for i in range(len(words))]
    n, chars = max(1, len(words)), max(1, len(text))
    strong = [w for w, v in zip(words, ws, strict=True) if v >= 3]
    repeated = sum(w.startswith("bocot") for w in words)
    repeated = repeated if repeated > 1 else 0
    mixed = []
    for m in regex.finditer(r"[\p{L}013457@$!]+", low):
        w = regex.sub(r"[^\p{L}]+$", "", m.group())
        if regex.search(r"\p{L}", w) and not regex.fullmatch(r"\p{L}+", w):
            mixed.append("".join(toxicity.WRITTEN_FOR.get(c, c) for c in w))
    drawn = [w for w in words if regex.search(r"(.)\1\1", w)]
    parted = [m.group() for m in regex.finditer(r"(?<!\p{L})\p{L}(?:\P{L}\p{L}(?!\p{L})){2,}", low)]
    letters = [regex.sub(r"\P{L}", "", p) for p in parted]
    return [
        math.log1p(len(words)), len(strong) / n, min(len(strong), 50), len(set(strong)), sum(0 < v < 3 for v in ws) / n, min(50, sum(0 < v < 3 for v in ws)), sum(ws) / n, max(ws, default=0),
        repeated / n, repeated, 1.5 if repeated else 0,
        len(second) / n, min(20, sum(v > 0 and d <= 5 for v, d in zip(ws, near, strict=True))), max((1 / (1 + d) for v, d in zip(ws, near, strict=True) if v > 0), default=0),
        len(regex.findall(r"\p{Lu}", text)) / max(1, sum(map(len, words))), sum(len(w) > 1 and bool(regex.fullmatch(r"\p{Lu}+", w)) for w in raw) / n,
        text.count("!") / chars, text.count("?") / chars, len(regex.findall(r"[^\s\p{L}\p{N}]", text)) / chars, len(regex.findall(r"[^\s\p{L}\p{N}]{2,}", text)) / n, len(regex.findall(r"\p{N}", text)) / chars,
        len(mixed) / n, min(20, sum(weight(w) >= 3 for w in mixed)), len(drawn) / n, min(20, sum(weight(regex.sub(r"(.)\1+", r"\1", w)) >= 3 > weight(w) for w in drawn)),
        len(parted) / n, min(20, sum(weight(w) >= 3 for w in letters)), sum(map(len, words)) / n,
    ]


TEXTS = [
    "", " ", "You IDIOT!! you are a moronic fool, not an idiot?", "1d10t and m0r0n5!!! x1 99 4ever", "i d i o t, m.o.r.o.n a b", "iiidiot moooron sooo", "Ünïcode ÀÉ bocot bocota bocott dull",
    "no second person here: moron dull dull", "漢字 \U0001f600\U0001f600 you", "idiot" * 3, "a", "you\nyou\nidiot", "B.O.C.O.T  q w\te", "ǅungla İstanbul STRASSE", "!!!", "bocot", "a-b-c de-f", "$tupid @ss 7h3 id!ot!",
]


def test_features_match_plain_ones():
    got = features(TEXTS)
    assert got.shape == (len(TEXTS), len(toxicity.NAMES))
    for t, row in zip(TEXTS, got, strict=True):
        for name, a, b in zip(toxicity.NAMES, row, plain(t), strict=True):
            assert abs(a - b) < 1e-9, (t, name, a, b)
    assert np.allclose(features(TEXTS[::-1])[::-1], got)
    assert np.allclose(np.concatenate([features([t]) for t in TEXTS]), got)


def test_long_texts_are_added_up_from_pieces(monkeypatch):
    text = "\n".join(TEXTS) * 5
    whole = features([text])
    monkeypatch.setattr(toxicity, "PIECE", 400)
    parts = features([text])
    apart = [i for i, n in enumerate(toxicity.NAMES) if n not in ("second_person_near", "second_person_next", "parted", "parted_hits")]
    assert np.allclose(whole[0, apart], parts[0, apart])
    unbroken = "ж" * 5000
    assert toxicity._cuts(np.frombuffer(unbroken.encode(), np.uint8))[-1] == 10000
    assert np.isfinite(features([unbroken])).all()


def test_trees_follow_their_splits():
    r = np.random.default_rng(1)
    x = np.column_stack([r.normal(size=600), r.integers(0, 3, 600), r.normal(size=600)])
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] == 2)).astype(float)
    trees = toxicity.Trees().fit(x, y, np.ones(600), rounds=40)
    got = trees.score(x)
    for i in range(0, 600, 37):
        want = trees.start
        for on, at, value in trees.trees:
            node = 0
            for _ in range(trees.depth):
                k = int(on[node])
                rank = sum(e < x[i, k] for e in trees.edges[k].tolist())
                node = 2 * node + (2 if rank > at[node] else 1)
            want += value[node - (2**trees.depth - 1)]
        assert abs(got[i] - want) < 1e-9
    assert ((got > 0) == y).mean() > 0.97
    same = toxicity.Trees().fit(np.zeros((20, 2)), np.arange(20.0) % 2, np.ones(20))
    assert np.allclose(same.score(np.zeros((3, 2))), same.start)


def test_first_split_is_the_best_of_all():
    r = np.random.default_rng(2)
    x, y = r.normal(size=(80, 3)), r.integers(0, 2, 80).astype(float)
    tree = toxicity.Trees(depth=1).fit(x, y, np.ones(80), rounds=1)
    p = y.mean()
    best = -1.0
    for k, cut in itertools.product(range(3), range(79)):
        edge = np.sort(x[:, k])[cut]
        left = x[:, k] <= edge
        if edge not in tree.edges[k] or min(left.sum(), (~left).sum()) * p * (1 - p) < 1:
            continue
        part = [((y[m] - p).sum() ** 2) / (m.sum() * p * (1 - p) + 2.0) for m in (left, ~left)]
        best = max(best, sum(part))
    on, at, _ = tree.trees[0]
    left = x[:, on[0]] <= tree.edges[on[0]][at[0]]
    assert abs(sum(((y[m] - p).sum() ** 2) / (m.sum() * p * (1 - p) + 2.0) for m in (left, ~left)) - best) < 1e-9


def test_calibration_is_the_nearest_rising_function():
    r = np.random.default_rng(3)
    for _ in range(20):
        n = int(r.integers(2, 9))
        s, y, w = r.permutation(n).astype(float), r.integers(0, 2, n).astype(float), r.uniform(0.5, 2, n)
        at, p = toxicity.isotonic(s, y, w)
        assert (np.diff(p) >= 0).all()
        order = np.argsort(s)
        best = (math.inf, None)
        for cuts in itertools.product((0, 1), repeat=n - 1):  # every way to pool neighbours
            groups = np.split(order, np.flatnonzero(cuts) + 1)
            means = [np.average(y[g], weights=w[g]) for g in groups]
            if all(a <= b + 1e-12 for a, b in itertools.pairwise(means)):
                loss = sum((w[g] * (y[g] - m) ** 2).sum() for g, m in zip(groups, means, strict=True))
                if loss < best[0] - 1e-12:
                    best = (loss, groups)
        want = np.empty(n)
        for g in best[1]:
            want[g] = ((w[g] * y[g]).sum() + 0.5 * w.mean()) / (w[g].sum() + w.mean())
        # doubt pulls small blocks to the middle; where that breaks the order it is restored
        assert np.allclose(np.interp(s[order], at, p), np.maximum.accumulate(want[order]))


def test_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op12_toxicity(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    p = got.join(labels, "doc_id").where("held_out").toPandas()
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert len(p) > 700 and ((p.predicted == 1) == (p.score >= 0.5)).all() and p.score.between(0, 1).all()
    assert (p.predicted == p.toxic).mean() >= 0.975  # about one label in a hundred says toxic of a text without a sign of it
    rank = p.score.rank()
    ones = p.toxic.sum()
    assert (rank[p.toxic == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(p) - ones)) >= 0.985


def test_scores_leave_the_learnt_labels_aside(spark):
    """Held-out labels change nothing; odd labels and rows are left out."""
    texts = [f"you are {'an idiot' if i % 3 == 0 else 'a friend'} number {i}" for i in range(240)]
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t in enumerate(texts)] + [(None, "an idiot", "y", 2.0), (900, None, "z", 0.0), (901, "", "z", 0.0), (7, texts[7], "x", 1.0)], "doc_id long, text string, y string, score double")
    rows = [(i, int(i % 3 == 0)) for i in range(240)] + [(None, 1), (5, None), (6, 7), (8, 0), (8, 0), (5000, 1)]
    labels = spark.createDataFrame(rows, "doc_id long, toxic int")
    first = toxicity.toxicity_scores(docs, toxicity.train(docs, labels))
    assert first.columns == ["doc_id", "held_out", "score", "predicted"] and first.count() == 244
    got = {(r.doc_id): r for r in first.collect()}
    assert all(got[i].predicted == (i % 3 == 0) for i in range(240))
    assert got[None].held_out is None and got[None].predicted == 1 and got[900].score == got[901].score < 0.5
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    again = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, toxicity.train(docs, flipped)).collect()}
    assert all(again[k] == r.score for k, r in got.items())


def test_without_enough_to_learn(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.toxicity_scores(docs, toxicity.train(docs, none)).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.toxicity_scores(docs, toxicity.train(docs, one)).collect()} == {1.0}
    assert toxicity.toxicity_scores(docs.where("doc_id > 5"), toxicity.train(docs.where("doc_id > 5"), one)).count() == 0
