"""Loops that don't settle, growing rows, dense blocks and distances against plain computations."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from axisloom.functions import scalar
from axisloom.operators import arrays, graph, hydro, iterate, linalg, mesh, ragged, reduce, stencil
from axisloom.operators.loops import index_space


def test_what_does_not_settle_raises(spark):
    grid = index_space(spark, (0, 6), (0, 6)).withColumn("v", (F.col("i") * 7 + F.col("j")) * 1.0)
    with pytest.raises(RuntimeError):
        stencil.jacobi(grid.withColumn("v", F.when(F.col("i") == 0, 9.0).otherwise(0.0)), 6, 6, 1e-9, most=2, every=1)
    with pytest.raises(RuntimeError):
        iterate.iterate(spark.range(3).select(F.col("id").alias("x")), lambda s: s.select((F.col("x") + 1).alias("x")), lambda a, b: 1.0, most=2, every=1)
    with pytest.raises(RuntimeError):
        hydro.run(*hydro.initial(spark, 10), until=1.0, most=1)


def test_empty_ends_are_finite(spark):
    x = F.col("id").cast("double")
    r = reduce.reduce_all(spark.range(0), most=("max", x), least=("min", x)).first()
    assert r.most == -np.finfo(float).max and r.least == np.finfo(float).max


def test_rows_grow_up_to_a_capacity(spark):
    e = spark.createDataFrame([(1, 0, 5), (1, 1, 6), (2, 0, 7)], "row long, pos long, v long")
    more = spark.createDataFrame([(1, 0, 8), (3, 0, 9), (3, 1, 10)], "row long, ord int, v long")
    want = [(1, 0, 5), (1, 1, 6), (1, 2, 8), (2, 0, 7), (3, 0, 9), (3, 1, 10)]
    assert sorted(map(tuple, ragged.append(e, more, "row", 3).collect())) == want
    with pytest.raises(Exception, match="2 elements at most"):
        ragged.append(e, more, "row", 2).collect()
    assert ragged.append(e.where("false"), more.where("false"), "row", 1).count() == 0


def test_vectors_in_slots(spark):
    e = spark.createDataFrame([(1, 0, 0, 1.0), (1, 0, 2, 3.0), (1, 1, 1, 5.0)], "row long, pos long, k int, v double")
    assert ragged.pack_vectors(e, "row", "pos", ["k"], "v", [3]).first().vals == [[1.0, 0.0, 3.0], [0.0, 5.0, 0.0]]
    with pytest.raises(Exception, match="beyond"):
        ragged.pack_vectors(e, "row", "pos", ["k"], "v", [2]).collect()


def test_dense_blocks_against_numpy(spark):
    r = np.random.default_rng(3)
    made = {k: r.normal(size=(n, n)) for k, n in enumerate((1, 2, 5, 9))}
    made[9] = np.array([[1.0, 2.0], [0.0, 0.0]])  # a zero row
    cells = spark.createDataFrame([(k, i, j, float(a[i, j])) for k, a in made.items() for i in range(len(a)) for j in range(len(a))], "block long, i long, j long, v double")
    got = {(x.block, x.i, x.j): x.v for x in linalg.invert_blocks(cells).collect()}
    for k, a in made.items():
        mine = np.array([[got[k, i, j] for j in range(len(a))] for i in range(len(a))])
        assert all(v is None for v in mine.ravel()) if k == 9 else np.allclose(mine.astype(float), np.linalg.inv(a))
    for method, sign in (("lu", lambda x: x), ("qr", abs)):
        det = {x.block: x.det for x in linalg.block_determinants(cells, method).collect()}
        assert all(np.isclose(det[k], sign(np.linalg.det(a))) for k, a in made.items())


def test_distances_against_floyd(spark):
    r = np.random.default_rng(4)
    edges = [(int(a), int(b), float(w)) for a, b, w in zip(r.integers(0, 14, 40), r.integers(0, 14, 40), r.integers(1, 9, 40))]
    d = {(a, b): 0.0 if a == b else min((w for x, y, w in edges if (x, y) == (a, b)), default=np.inf) for a, b in itertools.product({n for e in edges for n in e[:2]}, repeat=2)}
    for k, a, b in itertools.product({a for a, _ in d}, repeat=3):
        d[a, b] = min(d[a, b], d[a, k] + d[k, b])
    got = {(x.src, x.dst): x.dist for x in graph.distances(spark.createDataFrame(edges, "src long, dst long, w double"), "w").collect()}
    assert got == {k: v for k, v in d.items() if v < np.inf}


def test_all_pairs_in_bits(spark):
    edges = [(0, 1), (1, 2), (2, 0), (2, 3), (5, 6), (6, 6), (0, 1)] + [(k, k + 1) for k in range(10, 90)]
    df = spark.createDataFrame(edges, "src long, dst long")
    near = {n: {b for a, b in edges if a == n} for n in range(100)}
    want = []
    for root in range(100):
        dist, front = {root: 0}, [root]
        while front:
            front = [b for a in front for b in near[a] if b not in dist and not dist.update({b: dist[a] + 1})]
        want.append((root, sum(dist.values()), len(dist), max(dist.values())))
    assert sorted(map(tuple, graph.all_pairs(spark, 100, df).collect())) == want
    assert sorted(map(tuple, graph.all_pairs(spark, 3, df.where("false")).collect())) == [(k, 0, 1, 0) for k in range(3)]


def test_random_fields_follow_seed_and_place(spark):
    df = spark.range(1000).select(F.col("id").alias("i"))
    draw = lambda seed, parts=4: {x.i: x.v for x in arrays.randomize(df.repartition(parts), ["i"], seed, 2.0, 3.0).collect()}
    assert draw(1) == draw(1, 7) != draw(2) and all(2 <= v < 3 for v in draw(1).values()) and len(set(draw(1).values())) > 990


def test_power_iteration(spark):
    m = np.array([[2.0, 1, 0], [1, -7, 2], [0, 2, 1]])
    cells = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(3) for j in range(3) if m[i, j]], "i long, j long, v double")
    vector, value, _ = linalg.power_iteration(cells)
    values, vectors = np.linalg.eigh(m)
    at = np.abs(values).argmax()
    x = np.array([r.x for r in sorted(vector.collect())])
    assert abs(value - values[at]) < 1e-9
    assert np.abs(x / np.linalg.norm(x)).round(8).tolist() == np.abs(vectors[:, at]).round(8).tolist()
    with pytest.raises(ValueError):
        linalg.power_iteration(cells.limit(0))
    with pytest.raises(RuntimeError):
        linalg.power_iteration(spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0), (1, 0, 1.0), (1, 1, -1.0)], "i long, j long, v double"), most=20)


def test_boxes_by_axis(spark):
    cells = mesh.box_mesh(spark, (3, 2, 1))
    assert cells.count() == 48
    assert cells.agg(F.max("node")).first()[0] == 4 * 3 * 2 - 1
    at = {r.node: (r.x, r.y, r.z) for r in mesh.box_nodes(spark, (3, 2, 1), (6.0, 1.0, 2.0), (1.0, 0.0, -1.0)).collect()}
    assert len(at) == 24 and at[0] == (1.0, 0.0, -1.0) and at[23] == (7.0, 1.0, 1.0) and at[5] == (3.0, 0.5, -1.0)
    first = {r.lid: at[r.node] for r in cells.where("elem = 0").collect()}
    assert first[7] == (3.0, 0.5, 1.0)
    assert mesh.box_mesh(spark, (3, 0, 2)).count() == 0
    with pytest.raises(ValueError):
        mesh.box_nodes(spark, (3, 0, 2))


def test_split_and_lists(spark):
    df = spark.createDataFrame([("a.b..",), ("",), (None,), ("..",)], "s string")
    assert [r[0] for r in df.select(scalar.split(F.col("s"), ".")).collect()] == [["a", "b", "", ""], [""], None, ["", "", ""]]
    df = spark.createDataFrame([("[1, -2.5e1,x,3z]",), ("[]",), (None,), ("7",)], "s string")
    assert [r[0] for r in df.select(scalar.extract_list(F.col("s"))).collect()] == [[1.0, -25.0, 0.0, 3.0], [0.0], None, [7.0]]
    with pytest.raises(ValueError):
        scalar.split(F.col("s"), "")
