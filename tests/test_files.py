"""Meshes by many tasks and in pieces, logs, local writes and rewired rings."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from axisloom.operators import dist, graph, linalg, mesh, points
from axisloom.sources import meshlines, pvtu, steplog, vtk


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture
def small_ranges(spark):
    """Files are cut every 64 bytes."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


TEXT = """# vtk DataFile Version 2.0
3 things
ASCII
DATASET UNSTRUCTURED_GRID

POINTS 5 double
0 0 0 1 0
0
1 1.5e0 -.5
nan 2 3   4 5
6
CELLS 3 11
3 0 1 2
2 3 4

3 4 0 2
CELL_TYPES 3
5
3 5
POINT_DATA 5
SCALARS heat double
LOOKUP_TABLE default
1 2 3
4 5
VECTORS flow float
1 2 3 4 5 6 7 8 9 10 11 12
13 14 15
CELL_DATA 3
SCALARS two int 2
LOOKUP_TABLE default
1 2 3 4 5
6
"""


@pytest.mark.parametrize("cut", [True, False])
def test_a_file_by_many_tasks(spark, tmp_path, cut, request):
    if cut:
        request.getfixturevalue("small_ranges")
    for name in "ab":
        (tmp_path / f"{name}.vtk").write_text(TEXT)
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > (8 if cut else 0)
    lines = meshlines.place_lines(spark, str(tmp_path))
    got = [tuple(r) for r in meshlines.nodes(lines).where("file like '%a.vtk'").orderBy("node").drop("file").collect()]
    assert str(got) == str([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 1.0, 1.5, -0.5), (3, float("nan"), 2.0, 3.0), (4, 4.0, 5.0, 6.0)])
    cells = meshlines.incidence(lines)
    assert cells.select("file").distinct().count() == 2
    assert rows(cells.where("file like '%b.vtk'"), "elem", "lid", "node") == [(0, 0, 0), (0, 1, 1), (0, 2, 2), (1, 0, 3), (1, 1, 4), (2, 0, 4), (2, 1, 0), (2, 2, 2)]
    v = meshlines.values(lines).where("file like '%b.vtk'")
    assert rows(v.where("name = 'heat'"), "of", "id", "v") == [("POINT_DATA", k, k + 1.0) for k in range(5)]
    assert rows(v.where("name = 'flow'"), "id", "component", "v") == [(k // 3, k % 3, k + 1.0) for k in range(15)]
    assert rows(v.where("name = 'two'"), "of", "id", "component", "v") == [("CELL_DATA", k // 2, k % 2, k + 1.0) for k in range(6)]


def test_the_same_mesh_as_by_one_task(spark, tmp_path, small_ranges):
    path = str(tmp_path / "mesh")
    vtk.write_mesh(mesh.box_nodes(spark, 2), mesh.box_mesh(spark, 2), path)
    lines = meshlines.place_lines(spark, path)
    assert rows(meshlines.incidence(lines), "elem", "lid", "node") == rows(vtk.read_incidence(spark, path), "elem", "lid", "node") == rows(mesh.box_mesh(spark, 2), "elem", "lid", "node")
    assert rows(meshlines.nodes(lines), "node", "x", "y", "z") == rows(vtk.read_nodes(spark, path), "node", "x", "y", "z")


@pytest.mark.parametrize("bad", ["POINTS 2 double\n1 2 3 4\n", "POINTS 1 double\n1 2 3 4\n", "CELLS 1 3\n2 0\n1\n"])
def test_files_that_lack_or_overflow(spark, tmp_path, bad):
    (tmp_path / "m.vtk").write_text(bad)
    lines = meshlines.place_lines(spark, str(tmp_path))
    with pytest.raises(Exception, match="more numbers|lacks numbers|line of its own"):
        (meshlines.nodes(lines) if bad.startswith("P") else meshlines.incidence(lines)).collect()


def found(path):
    return sorted(f for _, _, names in os.walk(path) for f in names)


def test_pieces_through_the_index(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.dataSource.register(pvtu.Pvtu)
    box = pvtu.cells(mesh.box_nodes(spark, 3), mesh.box_mesh(spark, 3)).repartition(4)
    box.write.format("pvtu").mode("overwrite").option("cells", 5).save(path)
    read = spark.read.format("pvtu").load(path)
    pieces = pvtu.listed(path)
    assert len(pieces) >= 6 and read.groupBy("piece").count().agg(F.max("count")).first()[0] <= 5
    assert found(path) == sorted([pvtu.INDEX, *(x.split("/")[1] for x in pieces)])
    want = rows(mesh.box_mesh(spark, 3).join(mesh.box_nodes(spark, 3), "node"), "elem", "lid", "node", "x", "y", "z")
    assert rows(pvtu.incidence(read), "elem", "lid", "node", "x", "y", "z") == want
    # replaced as a whole, then added to
    box.where("elem < 3").write.format("pvtu").mode("overwrite").save(path)
    assert not set(pieces) & set(pvtu.listed(path)) and found(path) == sorted([pvtu.INDEX, *(x.split("/")[1] for x in pvtu.listed(path))])
    box.where("elem = 20").write.format("pvtu").mode("append").save(path)
    assert rows(spark.read.format("pvtu").load(path), "elem") == [(0,), (1,), (2,), (20,)]
    box.where("elem < 0").write.format("pvtu").mode("overwrite").save(path)
    assert pvtu.listed(path) == [] and spark.read.format("pvtu").load(path).count() == 0


def test_a_failed_task_leaves_no_piece(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.dataSource.register(pvtu.Pvtu)
    box = pvtu.cells(mesh.box_nodes(spark, 3), mesh.box_mesh(spark, 3)).repartition(4)
    box.where("elem < 5").write.format("pvtu").mode("overwrite").save(path)
    before = found(path)
    short = box.withColumn("xyz", F.when(F.col("elem") == 26, F.slice("xyz", 1, 3)).otherwise(F.col("xyz")))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="three coordinates"):
            short.write.format("pvtu").mode(mode).option("cells", 1).save(path)
        assert found(path) == before
    assert rows(spark.read.format("pvtu").load(path), "elem") == [(k,) for k in range(5)]


def test_pieces_of_tetrahedra(spark, tmp_path):
    spark.dataSource.register(pvtu.Pvtu)
    d = spark.createDataFrame([(7, [4, 2, 9, 1], [float(x) / 3 for x in range(12)])], "elem long, node array<long>, xyz array<double>")
    d.write.format("pvtu").mode("overwrite").save(str(tmp_path / "t"))
    r = spark.read.format("pvtu").load(str(tmp_path / "t")).first()
    assert (r.elem, r.node, r.xyz) == tuple(d.first())
    with pytest.raises(Exception, match="tetrahedra or hexahedra"):
        spark.createDataFrame([(1, [1, 2], [0.0] * 6)], "elem long, node array<long>, xyz array<double>").write.format("pvtu").mode("append").save(str(tmp_path / "t"))


def test_steps_written_again(spark, tmp_path):
    d = lambda *r: spark.createDataFrame(r, "step int, e double")
    path = str(tmp_path / "log")
    steplog.write_steps(d((1, 0.1), (2, 1 / 3)), path)
    steplog.write_steps(d((2, 2 / 3), (3, 1e-300)), path)
    assert rows(steplog.read_steps(spark, path, "e double, step int"), "step", "e") == [(1, 0.1), (2, 2 / 3), (3, 1e-300)]


def test_local_writes_maps_and_replicas(spark):
    m = spark.createDataFrame([(0, 0, 10, 1.0), (0, 1, 11, None), (1, 0, 12, 3.0)], "part int, lid long, gid long, v double")
    w = spark.createDataFrame([(0, 1, 5.0), (0, 1, 7.0), (1, 0, None), (9, 9, 1.0)], "part int, lid long, v double")
    assert [r.v for r in dist.replace_local(m, w).orderBy("gid").collect()] == [1.0, 7.0, None]
    assert [r.v for r in dist.sum_into_local(m.fillna(0.0, ["v"]), w).orderBy("gid").collect()] == [1.0, 12.0, 3.0]
    assert rows(dist.replace_map(m.where("gid <> 11"), m.where("gid <> 11").selectExpr("part", "lid", "-gid as gid"), "gid"), "part", "lid", "gid", "v") == [(0, 0, -10, 1.0), (1, 0, -12, 3.0)]
    with pytest.raises(Exception, match="different local places"):
        dist.replace_map(m, m.where("part = 0"), "gid").collect()
    c = spark.createDataFrame([(p, k, float(10 * p + k)) for p in range(3) for k in range(2)], "part int, k int, v double")
    assert rows(dist.reduce_replicas(c, "k"), "part", "k", "v") == [(p, k, 30.0 + 3 * k) for p in range(3) for k in range(2)]


def test_ghost_nodes_and_owners(spark):
    e = spark.createDataFrame([(0, 0, 1), (0, 0, 2), (1, 1, 2), (1, 1, 3), (2, 2, 2), (2, 2, 3), (2, 3, 8)], "part int, elem int, node int")
    assert rows(dist.ghost_nodes(e), "part", "node", "owner") == [(0, 3, 2), (1, 1, 0), (2, 1, 0)]


def test_bins_over_blocks_of_keys(spark):
    b = spark.createDataFrame([(k, k % 2) for k in (-9, -4, 0, 1, 2, 5, 6, 11, 40)], "id long, b_x long")
    want = sorted((x, p, k) for x in (0, 1) for p, k in enumerate(k for k in (-9, -4, 0, 1, 2, 5, 6, 11, 40) if k % 2 == x))
    b = b.withColumn("b_x", F.pmod("b_x", F.lit(2)))
    assert rows(points.bin_members(b, "id", "x", block=4), "b_x", "pos", "id") == rows(points.bin_members(b, "id", "x"), "b_x", "pos", "id") == want


def test_rewired_ring_keeps_backward_edges_and_distances(spark):
    n, k = 40, 3
    e = rows(graph.small_world(spark, n, k, 1.0, 3), "src", "dst")
    assert {(i, (i - s) % n) for i in range(n) for s in (1, 2, 3)} <= set(e)
    assert all(k <= (b - a) % n < n - k or (a - b) % n <= k for a, b in e)
    assert rows(graph.small_world(spark, n, k, 0.0), "src", "dst") == sorted((i, (i + s) % n) for i in range(n) for s in (-3, -2, -1, 1, 2, 3))
    with pytest.raises(ValueError):
        graph.small_world(spark, 6, 3, 0.5)


def test_inverse_from_one_factorization(monkeypatch):
    a, calls = np.random.default_rng(0).normal(size=(60, 60)), []
    real = linalg.lu_decompose
    monkeypatch.setattr(linalg, "lu_decompose", lambda x: calls.append(1) or real(x))
    assert np.abs(linalg.lu_inverse(a) @ a - np.eye(60)).max() < 1e-9 and len(calls) == 1
    assert np.isnan(linalg.lu_inverse(np.array([[1.0, 2], [0, 0]]))).all()
