"""Spans that the field decodes are kept at any length."""

import time

import pytest
from hypothesis import given
from hypothesis import strategies as st

from axisloom.llm import pii


@pytest.mark.parametrize("parts", [1, 12, 300])
def test_long_obfuscated_address(spark, parts):
    address = "jo.smith (at) mail" + " (dot) example" * parts + " (dot) com"
    text = f"Please write to {address}."
    at = text.index(address)
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert pii.pii_report(d).first().spans == f"email:{at}:{at + len(address)}"
    assert pii.masked(d).first().text == "Please write to [EMAIL]."


def test_many_spans_of_one_text(spark):
    sentence = "Please write to jo.smith (at) mail (dot) example (dot) com, é, or to ann.b@web.org today. "
    n, at = 10_000, [(sentence.index(x), sentence.index(x) + len(x)) for x in ("jo.smith (at) mail (dot) example (dot) com", "ann.b@web.org")]
    d = spark.createDataFrame([(1, sentence * n)], "doc_id long, text string")
    begun = time.perf_counter()
    r = pii.pii_report(d).first()
    took = time.perf_counter() - begun
    assert (r.n_email, r.n_added) == (n, n)
    assert r.spans == ",".join(f"email:{a + k * len(sentence)}:{b + k * len(sentence)}" for k in range(n) for a, b in at)
    assert took < 15  # linear: 20,000 spans in 0.9 MB


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 6)), max_size=8), st.lists(st.tuples(st.integers(0, 30), st.integers(1, 12)), max_size=8))
def test_added_spans_apart_from_base_spans(added, base):
    added, base = ([(a, 0, a + n) for a, n in sorted(x)] for x in (added, base))
    assert pii._apart(added, base) == [s for s in added if not any(s[0] < b and a < s[2] for a, _, b in base)]
