import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from axisloom.operators import graph, spectral, stencil, tiles


def frame(spark, x):
    at = np.indices(x.shape).reshape(x.ndim, -1)
    return spark.createDataFrame([(*map(int, p), float(v)) for p, v in zip(at.T, x.ravel(), strict=True)], ", ".join(f"{c} long" for c in "ijk"[: x.ndim]) + ", v double")


@pytest.mark.parametrize(("shape", "side"), [((5, 7, 6), 3), ((4, 4, 4), 8), ((9, 1, 2), 2)])
def test_pencils_transform_as_a_whole(spark, shape, side):
    x = np.random.default_rng(1).normal(size=shape)
    grid = spectral.bricks(frame(spark, x).repartition(5), shape, side)
    waves = spectral.forward(grid, shape, side)
    got = np.zeros(shape, complex)
    for r in spectral.cells(waves, shape, side).collect():
        got[r.i, r.j, r.k] = r.re + 1j * r.im
    assert np.allclose(got, np.fft.fftn(x), atol=1e-12)
    back = np.zeros(shape)
    for r in spectral.cells(spectral.inverse(waves, shape, side), shape, side).collect():
        back[r.i, r.j, r.k] = r.re
    assert np.allclose(back, x, atol=1e-13)


def test_no_group_holds_the_grid(spark, monkeypatch):
    """Every bundle is one brick across, and missing cells are zeros, also in bricks without any cell."""
    shape, side = (6, 6, 6), 2
    held = []
    made = spectral.along(spectral.bricks(spark.createDataFrame([(0, 0, 0, 2.0), (0, 0, 0, 1.0)], "i long, j long, k long, v double"), shape, side), 0, shape, side, lambda x, index: np.full_like(x, x.size))
    held = {r.re for r in spectral.cells(made, shape, side).collect()}
    assert held == {6 * 2 * 2.0}
    with pytest.raises(Exception, match="beyond the grid"):
        spectral.bricks(spark.createDataFrame([(0, 6, 0, 2.0)], "i long, j long, k long, v double"), shape, side).collect()


def test_phase_field_is_kept_in_sum(spark):
    shape = (6, 5, 4)
    x = np.random.default_rng(2).uniform(0, 1, shape)
    k2 = sum(np.meshgrid(*[(2 * np.pi * np.fft.fftfreq(n)) ** 2 for n in shape], indexing="ij"))
    want = np.fft.ifftn((np.fft.fftn(x) - 0.1 * 2 * k2 * np.fft.fftn(4 * x**3 - 6 * x**2 + 2 * x)) / (1 + 0.1 * 2 * 0.5 * k2 * k2)).real
    got = np.zeros(shape)
    for r in spectral.phase_field_step(frame(spark, x), shape, 0.1, side=3, mobility=2.0, kappa=0.5).collect():
        got[r.i, r.j, r.k] = r.v
    assert np.allclose(got, want, atol=1e-13) and abs(got.sum() - x.sum()) < 1e-10


def relaxed(x, steps):
    for _ in range(steps):
        y = x.copy()
        y[1:-1, 1:-1] = (x[2:, 1:-1] + x[:-2, 1:-1] + x[1:-1, 2:] + x[1:-1, :-2]) / 4
        x = y
    return x


@pytest.mark.parametrize(("shape", "side", "deep", "steps"), [((13, 17), 5, 3, 8), ((6, 6), 64, 8, 3), ((9, 30), 4, 1, 3), ((1, 5), 2, 2, 2)])
def test_tiles_relax_as_the_whole_grid(spark, shape, side, deep, steps):
    x = np.random.default_rng(3).normal(size=shape)
    got = np.full(shape, np.nan)
    out, done = tiles.jacobi(frame(spark, x), *shape, None, most=steps, side=side, deep=deep)
    for r in out.collect():
        got[r.i, r.j] = r.v
    assert done == steps and np.array_equal(got, relaxed(x, steps))


def test_tiles_stop_as_the_plain_grid_does(spark):
    x = np.random.default_rng(4).uniform(size=(8, 8))
    plain, steps = stencil.jacobi(frame(spark, x), 8, 8, 1e-2, every=4)
    tiled, done = tiles.jacobi(frame(spark, x), 8, 8, 1e-2, side=4, deep=4)
    assert done == steps
    assert plain.join(tiled.withColumnRenamed("v", "w"), ["i", "j"]).where("v <> w").count() == 0 and tiled.count() == 64
    with pytest.raises(RuntimeError):
        tiles.jacobi(frame(spark, x), 8, 8, 0.0, most=4, side=4, deep=4)


def test_only_rims_are_shuffled(spark, monkeypatch):
    """The tiles' side of the join has no exchange, and no table stays behind."""
    plans = []
    put = tiles._Bucketed.put

    def seen(self, df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return put(self, df)

    monkeypatch.setattr(tiles._Bucketed, "put", seen)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tiles.jacobi(frame(spark, np.ones((24, 24))), 24, 24, None, most=4, side=8, deep=2)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    steps = plans[1:]
    assert len(steps) == 2 and all("Bucketed: true" in p for p in steps)
    for p in steps:
        exchanges = [line for line in p.split("\n") if "Exchange hashpartitioning" in line]
        assert exchanges
        left = p[p.index("Join") : p.index("ObjectHashAggregate") if "ObjectHashAggregate" in p else None]
        assert "Exchange" not in left.split("FileScan")[0]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("axisloom_")]
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    assert not [f for f in os.listdir(folder) if f.startswith("axisloom_")]


def floyd(n, edges):
    d = np.full((n, n), np.inf)
    np.fill_diagonal(d, 0)
    for a, b, w in edges:
        d[a, b] = min(d[a, b], w)
    for k in range(n):
        d = np.minimum(d, d[:, k, None] + d[k])
    return d


@pytest.mark.parametrize("sent", [tiles.MOST_SENT, 0])
def test_tile_distances(spark, monkeypatch, sent):
    monkeypatch.setattr(tiles, "MOST_SENT", sent)
    r = np.random.default_rng(5)
    edges = [(int(a), int(b), float(w)) for a, b, w in zip(r.integers(0, 30, 70), r.integers(0, 30, 70), r.integers(0, 9, 70), strict=True)]
    want = floyd(30, edges)
    df = spark.createDataFrame([(a * 10 + 3, b * 10 + 3, w) for a, b, w in edges] + [(None, 3, 1.0), (3, None, 1.0), (3, 13, None)], "src long, dst long, w double")
    got = {((x.src - 3) // 10, (x.dst - 3) // 10): x.dist for x in tiles.all_distances(df, "w", side=8).collect()}
    used = {a for a, *_ in edges} | {b for _, b, _ in edges}
    assert got == {(a, b): want[a, b] for a in used for b in used if np.isfinite(want[a, b])}
    if sent:
        plain = graph.distances(df.where("src is not null and dst is not null and w is not null"), "w")
        assert {((x.src - 3) // 10, (x.dst - 3) // 10): x.dist for x in plain.collect()} == got
        assert tiles.all_distances(df.where("src = -1"), "w").count() == 0
        hops = {(x.src, x.dst): x.dist for x in tiles.all_distances(df.where("src is not null and dst is not null"), side=64).collect()}
        assert all(v == int(v) for v in hops.values()) and len(hops) >= len(got)
        with pytest.raises(ValueError, match="negative"):
            tiles.all_distances(df.withColumn("w", -F.col("w") - 1), "w")


def _apart(seed):
    """Three graphs that aren't tied to each other: of 20, 9 and 2 nodes, and a loop."""
    r = np.random.default_rng(seed)
    sizes, edges, base = (20, 9, 2), [(40, 40, 3.0)], 0
    for n in sizes:
        edges += [(base + k, base + k + 1, 2.0) for k in range(n - 1)]
        edges += [(base + int(a), base + int(b), float(w)) for a, b, w in zip(r.integers(0, n, 2 * n), r.integers(0, n, 2 * n), r.integers(0, 9, 2 * n), strict=True)]
        base += n
    return edges


@pytest.mark.parametrize(("whole", "side", "rounds"), [(2048, 2, 0), (9, 8, 3), (0, 8, 4)])
def test_pieces_of_a_graph_need_no_rounds_of_their_own(spark, monkeypatch, whole, side, rounds):
    """Only nodes of pieces beyond ``WHOLE`` make tiles: three tables of crossing tiles for 20 nodes, none where all pieces are small."""
    edges = _apart(6)
    want = floyd(41, edges)
    made = []
    keep = tiles.written
    monkeypatch.setattr(tiles, "WHOLE", whole)
    monkeypatch.setattr(tiles, "written", lambda df: made.append(df.columns) or keep(df))
    df = spark.createDataFrame(edges, "src long, dst long, w double")
    got = {(x.src, x.dst): x.dist for x in tiles.all_distances(df, "w", side=side).collect()}
    used = {a for a, *_ in edges} | {b for _, b, _ in edges}
    assert got == {(a, b): want[a, b] for a in used for b in used if np.isfinite(want[a, b])}
    assert made.count(["ti", "tj", "tile"]) == (2 * rounds + 1 if rounds else 0)
