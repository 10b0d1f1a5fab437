import math
from decimal import Decimal

import numpy as np
import pytest

from axisloom.llm import queries, whiten

SF = "/root/testdata/sf0.01"


def brute(vectors, most=16):
    """Mean and covariance in exact integers, eigenvectors by LAPACK."""
    x = sorted({tuple(math.floor(64 * float(c)) + 1_000_000 for c in v) for v in vectors})
    n, d = len(x), len(x[0])
    s = [sum(v[i] for v in x) for i in range(d)]
    y = np.array([[n * v[i] - s[i] for i in range(d)] for v in x], dtype=object)
    cov = np.array((y.T @ y), dtype=object)
    cov = np.array([[float(Decimal(int(c)) / (Decimal(n) ** 3)) for c in row] for row in cov])
    e, v = np.linalg.eigh(cov)
    return n, s, e[::-1][:most], v[:, ::-1].T[:most], np.trace(cov)


def test_whitening_matches_exact_integers(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    use = [r for r in rows if r.embedding is not None and all(c is not None and math.isfinite(c) for c in r.embedding)]
    n, s, e, v, trace = brute([r.embedding for r in use])
    got = queries.op11_whitening(spark, SF).toPandas()
    assert len(got) == 16 * len(use) and set(got.n) == {n}
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9
    by = {(r.vec_id, r.component): r for r in got.itertuples()}
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in r.embedding] for r in use])
    want = (x - np.array(s) / n) @ v.T / np.sqrt(e)
    for k in range(16):
        mine = np.array([by[r.vec_id, k + 1].whitened for r in use])
        sign = np.sign(mine @ want[:, k])
        assert np.abs(mine - sign * want[:, k]).max() < 1e-6
        assert abs(by[use[0].vec_id, k + 1].explained - e[k] / trace) < 1e-9 * e[k] / trace
    for r, row in list(zip(use, x.tolist(), strict=True))[:50]:
        assert by[r.vec_id, 1].deviation == sum((n * a - b) ** 2 for a, b in zip(row, s, strict=True))


def test_factors_merge_in_a_tree(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(900, 6)) @ r.normal(size=(6, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "vec_id long, embedding array<double>").repartition(40)
    whole, parts = whiten.fit(df.coalesce(1)), whiten.fit(df)
    n, _, e, v, _ = brute(base)
    for m in (whole, parts):
        assert m.n == n and m.identity_error < 1e-9
        assert np.allclose(m.variances, e, rtol=1e-12)
        assert np.allclose(np.abs((m.directions * v).sum(axis=1)), 1, atol=1e-12)


def test_large_offsets_keep_their_digits(spark):
    """Entries of about a million that differ by little: sums must be exact before rows are centred."""
    r = np.random.default_rng(4)
    base = 1e9 + np.round(r.normal(size=(200, 3)) * 64 * 40) / 64
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "vec_id long, embedding array<double>")
    m = whiten.fit(df)
    _, _, e, _, _ = brute(base)
    assert np.allclose(m.variances, e, rtol=1e-12) and m.identity_error < 1e-9
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in base.tolist()])
    s = x.sum(axis=0)
    got = {row.vec_id: row.deviation for row in whiten.whitened(df, m).collect()}
    assert got[7] == sum((m.n * int(a) - int(b)) ** 2 for a, b in zip(x[7], s, strict=True))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], "p"), (1, [1.0, 2.0], "q"), (None, [3.0, 1.0], "r"), (4, None, "s"), (5, [1.0, None], "t"), (6, [nan, 1.0], "u"), (7, [1.0, -inf], "v"), (8, [], "w"), (9, [2.0, 2.5], None), (10, [1.0, 2.0, 3.0], "z")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<float>, x string, whitened int")
    got = whiten.whitening_report(df)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    found = sorted((-1 if r.vec_id is None else r.vec_id, r.component) for r in got.collect())
    assert found == sorted((k, c) for k in (1, 1, -1, 9) for c in (1, 2))
    assert {r.n for r in got.collect()} == {3}
    # no spread at all, one row, no row
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert whiten.fit(one).n == 1 and whiten.whitening_report(one).count() == 0
    assert whiten.whitening_report(one.where("vec_id > 5")).count() == 0
    # one direction without spread is left out
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)], "vec_id long, embedding array<double>")
    assert len(whiten.fit(flat).variances) == 1
    with pytest.raises(Exception, match="too large"):
        whiten.fit(spark.createDataFrame([(1, [1e30]), (2, [0.0])], "vec_id long, embedding array<double>"))
