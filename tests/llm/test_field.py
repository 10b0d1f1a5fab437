"""The field of personal data: Viterbi against enumeration, spans in writings it was not trained on, edge cases."""

import itertools
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from axisloom.llm import pii


def best_by_enumeration(scores, move):
    def total(path):
        return sum(scores[i, x] for i, x in enumerate(path)) + sum(move[a, b] for a, b in itertools.pairwise(path))

    return max(itertools.product(range(scores.shape[1]), repeat=len(scores)), key=total)


def test_viterbi_against_enumeration():
    r = np.random.default_rng(1)
    field = pii.Field(np.zeros((pii.FEATURES, len(pii.LABELS)), np.float32), r.normal(0, 2, (len(pii.LABELS), len(pii.LABELS))).astype(np.float32))
    chains = [r.normal(0, 2, (n, len(pii.LABELS))).astype(np.float32) for n in (1, 2, 3, 4, 4, 3)]
    no = np.zeros(len(chains), bool)
    for chain, path in zip(chains, field.viterbi(chains, no, no), strict=True):
        assert tuple(path) == best_by_enumeration(chain.astype(float), field.move.astype(float))


def test_tokens_surely_outside_change_no_path():
    r = random.Random(2)
    field, table = pii.field(), pii.labelled_table(60, 5)
    texts = [" ".join(t for x, _ in r.sample(table, 6) for t in x) for _ in range(40)] + ["one", ""]
    data, start, end, text = pii.tokenized(texts)
    scores = field.scores(data, start, end, text, most=50)
    assert np.array_equal(scores, field.scores(data, start, end, text))
    chains = [scores[text == i] for i in range(len(texts))]
    no = np.zeros(len(chains), bool)
    assert np.array_equal(field.decode(scores, text), np.concatenate(field.viterbi(chains, no, no)))


NAMES, HOSTS, TOPS = ["anna", "john.smith", "m_weber", "lee42", "Paula"], ["acme", "data-lab", "north7", "mail"], ["com", "org", "net", "de"]
FRAMES = ["You can reach me under {} any time.", "Contact: {}", "{} is where Peter answers", "Please send the draft to {}, thanks", "(see {})", "Il faut écrire à {} avant lundi.", "Unser Büro: {}; geöffnet bis 18:00"]


def writings():
    r = random.Random(5)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    for who, host in itertools.product(NAMES, HOSTS):
        top = r.choice(TOPS)
        for x in (f"{who} (at) {host} (dot) {top}", f"{who} [at] {host} [dot] {top}", f"{who}(at){host}.{top}", f"{who}[at]{host}[dot]{top}", f"{who} (at) {host}.{top}", f"{who}@{host} (dot) {top}"):
            yield 0, x, r.choice(FRAMES).format(x)
    for _ in range(20):
        for x in (f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"{d(3)} {d(3)} {d(4)}"):
            yield 3, x, r.choice(FRAMES).format(x)


def test_spans_in_other_writings():
    rows = list(writings())
    found = {i: [*base, *more] for i, _, base, more in pii._found(pa.array([t for *_, t in rows]), pii.field())}
    for kind in (0, 3):
        mine = [i for i, x in enumerate(rows) if x[0] == kind]
        right = sum((rows[i][2].index(rows[i][1]), kind, rows[i][2].index(rows[i][1]) + len(rows[i][1])) in found.get(i, []) for i in mine)
        assert right >= 0.9 * len(mine), pii.KINDS[kind]
        assert right >= 0.9 * sum(len(found.get(i, [])) for i in mine)
    plain = ["The cat sat at home on a dot.", "Version 1.2.3 of 2024-05-06, p. 117, costs 1,234.50", "key 5f4dcc3b5aa765d61d8327deb882cf99", "it.&&& that*** ### 12:30:45"]
    assert not list(pii._found(pa.array(plain), pii.field()))


def test_report_of_empty_tables_and_clashing_columns(spark):
    d = spark.createDataFrame([(1, "mail jo.1@mail.example.com now"), (1, "mail jo.1@mail.example.com now"), (None, None), (2, "")], "doc_id long, text string")
    d = d.withColumns({"spans": F.lit("x"), "n_email": F.lit("y"), "row": F.lit(0)})
    assert sorted((x.doc_id or 0, x.n_email, x.spans) for x in pii.pii_report(d).collect()) == [(0, 0, ""), (1, 1, "email:5:26"), (1, 1, "email:5:26"), (2, 0, "")]
    assert pii.pii_report(d.where("false")).count() == 0
    assert pii.masked(d).columns == d.columns and pii.masked(d).where("text = 'mail [EMAIL] now'").count() == 2


def test_a_very_long_text():
    text = "lorem ipsum 12 " * 40_000 + "é call 555-123-4567 or anna [at] mail [dot] com"
    ((_, _, base, more),) = pii._found(pa.array([text]), pii.field())
    assert not base and [(k, text[a:b]) for a, k, b in more] == [(3, "555-123-4567"), (0, "anna [at] mail [dot] com")]
