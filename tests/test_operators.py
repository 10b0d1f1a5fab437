"""Closed-form expectations, edge cases and refusals of the operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from axisloom.functions import scalar
from axisloom.operators import arrays, dist, graph, iterate, linalg, loops, mesh, points, ragged, reduce, sparse, stencil, vectors


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_empty_and_strided_ranges(spark):
    assert loops.index_space(spark, (5, 5)).count() == 0
    assert loops.index_space(spark, (5, 3), (0, 4)).count() == 0
    assert rows(loops.index_space(spark, (0, 10, 4)), "i") == [(0,), (4,), (8,)]
    assert rows(loops.index_space(spark, (0, 8, 4), inclusive=True), "i") == [(0,), (4,), (8,)]
    assert loops.nested(loops.index_space(spark, (0, 3)), "j", F.col("i"), 1).count() == 1
    assert rows(loops.nested(loops.index_space(spark, (0, 2)), "j", F.col("i"), 5, step=2), "i", "j") == [(0, 0), (0, 2), (0, 4), (1, 1), (1, 3)]
    assert rows(loops.nested(loops.index_space(spark, (0, 1)), "j", 1, 5, inclusive=True, step=2), "j") == [(1,), (3,), (5,)]
    assert loops.nested(loops.index_space(spark, (0, 3)), "j", 0, F.lit(None).cast("long")).count() == 0
    assert loops.bounds(loops.index_space(spark, (4, 9)), "i") == (4, 9)
    assert loops.bounds(loops.index_space(spark, (4, 4)), "i") == (0, 0)
    with pytest.raises(ValueError):
        loops.extent(0, 3, 0)


def test_row_major_fill_is_its_flat_index(spark):
    a = arrays.DenseArray.filled(spark, (3, 4, 5), F.col("i") * 20 + F.col("j") * 5 + F.col("k"))
    assert a.df.where(a.flat() != F.col("v")).count() == 0
    assert a.size == 60 and a.order == 3


def test_seven_dimensions_and_one_based(spark):
    a = arrays.DenseArray.filled(spark, (2,) * 7, 1.0, base=1, layout="F")
    assert sorted(r.f for r in a.df.select(a.flat().alias("f")).collect()) == list(range(128))


def test_reductions_pass_nan_over(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (-3.0,)], "x double")
    r = reduce.reduce_all(df, most=("max", F.col("x")), least=("min", F.col("x"))).first()
    assert (r.most, r.least) == (1.0, -3.0)
    none = reduce.reduce_all(df.where("false"), "long", s=("sum", F.col("x")), m=("max", F.col("x"))).first()
    assert (none.s, none.m) == (0, -(2**63))


def test_validate(spark):
    a = arrays.DenseArray.filled(spark, (2, 2))
    a.validate()
    with pytest.raises(IndexError):
        arrays.DenseArray(a.df, (1, 2)).validate()
    with pytest.raises(ValueError):
        arrays.DenseArray(a.df.limit(3), (2, 2)).validate()
    with pytest.raises(ValueError):
        a.reshape((3, 2))
    with pytest.raises(IndexError):
        a.view(2, (3,))


def test_override_keeps_the_old(spark):
    a = arrays.DenseArray.filled(spark, (2, 2))
    b = a.override(spark.createDataFrame([(0, 1, 5.0)], "i long, j long, v double"))
    assert sum(r.v for r in a.df.collect()) == 0 and sum(r.v for r in b.df.collect()) == 5


def test_dynamic_bounds(spark):
    a = arrays.DynamicArray(spark.range(0).select(F.col("id").alias("i"), F.lit(0.0).alias("v")), 3, 0)
    assert a.pop_back().length == 0
    a = a.push_back(1.0, 2.0, 3.0)
    with pytest.raises(OverflowError):
        a.push_back(4.0)
    assert rows(a.pop_back().df, "i", "v") == [(0, 1.0), (1, 2.0)]


def test_ragged_example(spark):
    data = [[1, 2, 3], [4, 5], [6], [], [7, 8, 9, 10]]
    e = spark.createDataFrame([(r, p, v) for r, x in enumerate(data) for p, v in enumerate(x)], "row long, pos long, v long")
    every = spark.range(5).toDF("row")
    assert rows(ragged.offsets(every, e, "row"), "row", "stride", "start") == [(0, 3, 0), (1, 2, 3), (2, 1, 5), (3, 0, 6), (4, 4, 6)]
    assert ragged.access(e, "row", spark.createDataFrame([(1, 2)], "row long, pos long")).first().v is None


def test_prefix_sum_over_many_blocks(spark):
    df = spark.range(-50, 200).select(F.col("id").alias("k"), (F.col("id") % 7 + 7).alias("n"))
    got = rows(ragged.prefix_sum(df, "k", "n", block=16), "k", "start")
    want, total = [], 0
    for k in range(-50, 200):
        want.append((k, total))
        total += int(np.fmod(k, 7)) + 7
    assert got == want


def test_csr_example(spark):
    i, j = [0, 0, 1, 1, 2, 2, 2, 3], [0, 1, 1, 3, 2, 3, 4, 5]
    a = spark.createDataFrame(list(zip(i, j, [float(x) for x in range(1, 9)])), "i long, j long, v double")
    assert [s for _, s in rows(sparse.major_counts(a, 4), "i", "stride")] == [2, 2, 3, 1]
    assert [v for _, v in rows(sparse.flat_positions(a, 6, "j"), "flat", "v")] == [1, 2, 3, 5, 4, 6, 7, 8]
    at = spark.createDataFrame([(3, 0), (0, 1)], "i long, j long")
    assert rows(sparse.lookup(a, at), "i", "v") == [(0, 2.0), (3, 0.0)]
    assert rows(sparse.flat_lookup(a, at, 4, miss=8), "i", "flat") == [(0, 1), (3, 8)]
    assert sparse.update_stored(a, spark.createDataFrame([(3, 0, 9.0)], "i long, j long, v double")).agg(F.sum("v")).first()[0] == 36
    empty = a.where("false")
    assert [s for _, s in rows(sparse.starts(empty, 3), "i", "start")] == [0, 0, 0]


def test_from_parts(spark):
    a = spark.createDataFrame([(0, 1, 2.0), (2, 0, 3.0)], "i long, j long, v double")
    minor = sparse.flat_positions(a, 3).select("flat", F.col("j").alias("index"), "v")
    assert rows(sparse.from_parts(sparse.starts(a, 3), minor), "i", "j", "v") == rows(a, "i", "j", "v")


def test_blocks_cover_every_id(spark):
    for n, p in ((10, 3), (3, 5), (12, 4)):
        got = rows(dist.partition_map(spark.range(n), "id", n, p), "id", "part", "lid")
        flat = [(k, r, s) for k, (r, s) in enumerate((r, s) for r in range(p) for s in range(n // p + (r < n % p)))]
        assert got == flat


def test_matching_plans_leave_nothing(spark):
    m = dist.partition_map(spark.range(20), "id", 20, 4)
    needs = m.select("part", (F.col("id") + 1).alias("id"))
    plan = dist.halo_plan(needs, m, "id")
    assert plan.count() == 3 and dist.unmatched(plan, plan, "id").count() == 0


def test_norms_of_nothing(spark):
    n = vectors.norms(spark.createDataFrame([], "v double")).first()
    assert (n.norm1, n.norm2, n.norm_inf) == (0, 0, 0)
    assert vectors.reciprocal(spark.createDataFrame([(0.0,)], "v double")).first().v == float("inf")


def test_ieee_division(spark):
    got = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (1.0, 4.0)], "a double, b double").select(scalar.divide(F.col("a"), F.col("b")).alias("q"))
    assert [r.q for r in got.collect()] == [float("inf"), float("-inf"), 0.25]


def test_box_mesh_patches(spark):
    for n in (1, 3):
        p = mesh.patches(mesh.box_mesh(spark, n))
        assert p.count() == 3 * n * n * (n + 1) and p.where("n_elems = 1").count() == 6 * n * n
        assert mesh.box_nodes(spark, n).count() == (n + 1) ** 3


def test_neighbours_match_all_pairs(spark):
    pts = [(k, (k * 37 % 50) / 10, (k * 23 % 40) / 10) for k in range(60)]
    got = rows(points.box_neighbors(spark.createDataFrame(pts, "p long, x double, y double"), "p", {"x": 0.5, "y": 0.7}), "a", "b")
    assert got == sorted((a, b) for a, x, y in pts for b, u, v in pts if a != b and abs(x - u) <= 0.5 and abs(y - v) <= 0.7)


def test_small_world_is_repeatable_and_sparse(spark):
    a, b = (graph.ring(spark, 60, 2, 0.3, 7) for _ in range(2))
    assert rows(a, "src", "dst") == rows(b, "src", "dst") and a.where("src = dst").count() == 0


def test_bfs_on_two_islands(spark):
    e = graph.undirected(spark.createDataFrame([(0, 1), (1, 2), (5, 6)], "src long, dst long"))
    got = rows(graph.bfs(e, spark.createDataFrame([(0,)], "root long")), "node", "dist")
    assert got == [(0, 0), (1, 1), (2, 2)]


def test_heat_settles(spark):
    g = loops.index_space(spark, (0, 5), (0, 5)).withColumn("v", F.when(F.col("i") == 4, 100.0).otherwise(0.0))
    out, n = stencil.jacobi(g, 5, 5, 0.5, most=40, every=10)
    m = np.zeros((5, 5))
    m[4] = 100
    for _ in range(n):
        m[1:-1, 1:-1] = (m[2:, 1:-1] + m[:-2, 1:-1] + m[1:-1, 2:] + m[1:-1, :-2]) / 4
    assert all(abs(r.v - m[r.i, r.j]) < 1e-9 for r in out.collect())


def test_iterate_counts_steps(spark):
    out, n = iterate.iterate(spark.range(3).select(F.col("id").alias("x")), lambda d: d.select((F.col("x") + 1).alias("x")), most=7, every=3)
    assert n == 7 and rows(out, "x") == [(7,), (8,), (9,)]


@pytest.mark.parametrize("n", [1, 2, 5, 9])
def test_solvers(n):
    r = np.random.default_rng(n)
    a, b = r.normal(size=(n, n)), -np.abs(r.normal(size=n))
    assert np.allclose(linalg.lu_solve(a, b), np.linalg.solve(a, b))
    assert np.allclose(linalg.qr_solve(a, b), np.linalg.solve(a, b))
    assert np.isclose(linalg.lu_determinant(a), np.linalg.det(a))
    q, t = linalg.qr_decompose(a)
    assert np.allclose(q @ t, a) and np.allclose(q.T @ q, np.eye(n))


def test_singular_block():
    assert np.isnan(linalg.lu_solve(np.zeros((2, 2)), np.ones(2))).all()
