import functools
import operator

import numpy as np
import pytest

from axisloom.operators import nearest
from axisloom.operators.iterate import saved as kept


def brute(rows, n, radius=None):
    out = []
    for a, *x in rows:
        near = sorted((functools.reduce(operator.add, [(p - q) * (p - q) for p, q in zip(x, y, strict=True)]), b) for b, *y in rows if b != a)[:n]
        out += [(a, r, b, d) for r, (d, b) in enumerate(near, 1) if radius is None or d <= radius * radius]
    return sorted(out)


def clouds():
    r = np.random.default_rng(5)
    yield "even", [(i, *map(float, v)) for i, v in enumerate(r.uniform(-3, 9, (150, 3)))]
    near = [(i, *map(float, v)) for i, v in enumerate(r.normal(0, 1e-3, (120, 2)))]
    yield "a cluster and far points", [*near, (500, 4.0, 4.0), (501, -900.0, 3.0), (502, 0.01, 0.0), (503, 4.0, 4.0)]
    yield "copies", [(i, 1.0, 2.0) for i in range(60)] + [(100 + i, 1.0 + i, 2.0) for i in range(10)]
    yield "a line", [(i, 5.0, float(i * i)) for i in range(40)]
    yield "two", [(1, 0.0, 0.0), (2, 3.0, 4.0)]
    yield "one", [(1, 0.0, 0.0)]


@pytest.mark.parametrize(("name", "rows"), list(clouds()), ids=lambda x: x if isinstance(x, str) else "")
def test_all_neighbors_are_found(spark, name, rows, monkeypatch):
    monkeypatch.setattr(nearest, "FEW", 3)
    axes = ["x", "y", "z"][: len(rows[0]) - 1]
    df = spark.createDataFrame(rows, "k long, " + ", ".join(f"{c} double" for c in axes))
    got = sorted(tuple(r) for r in nearest.nearest_neighbors(df, "k", axes, 5).collect())
    assert got == brute(rows, 5)
    if name == "copies":
        got = sorted(tuple(r) for r in nearest.nearest_neighbors(df, "k", axes, 4, radius=1.5).collect())
        assert got == brute(rows, 4, 1.5)


def test_a_dense_cluster_is_not_compared_with_itself(spark, monkeypatch):
    """One far point makes the extent large: still only near points of the cluster may meet."""
    r = np.random.default_rng(7)
    rows = [(i, *map(float, v)) for i, v in enumerate(r.uniform(0, 1, (4000, 2)))] + [(9999, 1e7, 1e7)]
    df = spark.createDataFrame(rows, "k long, x double, y double")
    meet = []
    monkeypatch.setattr(nearest, "saved", lambda t: meet.append(kept(t)) or meet[-1])
    got = nearest.nearest_neighbors(df, "k", ["x", "y"], 2).toPandas()
    assert len(meet) <= 9
    assert len(got) == 2 * len(rows)
    x = np.array([v for _, *v in rows])
    for k in range(0, 4000, 400):
        d = ((x - x[k]) ** 2).sum(axis=1)
        assert set(got[got.a == k].b) == set(np.argsort(d, kind="stable")[1:3])
    assert set(got[got.a == 9999].b) == set(np.argsort(((x - x[-1]) ** 2).sum(axis=1), kind="stable")[1:3])


def test_dense_cells_are_split_and_odd_rows_left_out(spark, monkeypatch):
    monkeypatch.setattr(nearest, "CELL_PIECE", 3)
    r = np.random.default_rng(6)
    rows = [(i, *map(float, v)) for i, v in enumerate(r.normal(0, 1, (90, 2)))]
    odd = [(None, 0.0, 0.0), (900, None, 0.0), (901, float("nan"), 0.0), (902, 0.0, float("inf"))]
    df = spark.createDataFrame([(*x, "t", 1) for x in rows + odd], "k long, x double, y double, loc string, piece int")
    assert sorted(tuple(x) for x in nearest.nearest_neighbors(df, "k", ["x", "y"], 3, width=10.0).collect()) == brute(rows, 3)
    empty = nearest.nearest_neighbors(df.where("k = -1"), "k", ["x", "y"], 3)
    assert empty.count() == 0 and empty.columns == ["a", "rank", "b", "d2"]
