"""Files, kernels on blocks, and gas dynamics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from axisloom.operators import hydro, iterate, kernels, mesh, points
from axisloom.operators.loops import index_space
from axisloom.plans import fields
from axisloom.plans.base import query, table
from axisloom.sources import meshlines, vtk


def _shared(spark) -> str:
    """A path in the folder that driver and executors share."""
    iterate.saved(spark.range(1))
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/axisloom-{uuid.uuid4().hex}"


@query(f"WITH {fields.BOX} SELECT elem, lid, node FROM b")
def vtk_roundtrip(spark, d):
    path, counts = _shared(spark), fields.counts(spark, d)
    vtk.write_mesh(mesh.box_nodes(spark, counts), mesh.box_mesh(spark, counts), path)
    return meshlines.incidence(meshlines.place_lines(spark, path, parts=True)).drop("file")


@query("SELECT 0::BIGINT AS grid, 256::BIGINT AS n, round(sum(((range * 37) % 64) / 64.0), 6) AS total FROM range(256)")
def fft_step(spark, d):
    """A conserved field keeps its sum over a spectral step."""
    g = index_space(spark, (0, 16), (0, 16)).select(F.lit(0).cast("long").alias("grid"), "i", "j", (((F.col("i") * 16 + F.col("j")) * 37) % 64 / 64.0).alias("v"))
    return kernels.spectral_step(g, 16, 0.01).groupBy("grid").agg(F.count("*").alias("n"), F.round(F.sum("v"), 6).alias("total"))


@query("SELECT range AS a, 1.0::DOUBLE AS one, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS z FROM range(27)")
def rk_coeffs(spark, d):
    """Corrected kernel sums reproduce constants and linear offsets at every point of a lattice."""
    p = index_space(spark, (0, 3), (0, 3), (0, 3)).withColumn("a", F.col("i") * 9 + F.col("j") * 3 + F.col("k"))
    pairs = points.box_neighbors(p, "a", {"i": 1.0, "j": 1.0, "k": 1.0}).unionByName(p.select("a", F.col("a").alias("b")))
    near = pairs.join(p, "a").join(p.select(F.col("a").alias("b"), F.col("i").alias("x"), F.col("j").alias("y"), F.col("k").alias("z")), "b")
    near = near.select("a", (F.col("x") - F.col("i")).cast("double").alias("dx"), (F.col("y") - F.col("j")).cast("double").alias("dy"), (F.col("z") - F.col("k")).cast("double").alias("dz"))
    near = near.withColumn("w", 1 / (1 + F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz")))
    w = F.col("w") * (F.col("c0") + F.col("c1") * F.col("dx") + F.col("c2") * F.col("dy") + F.col("c3") * F.col("dz"))
    sums = near.join(kernels.reproducing_coefficients(near), "a").groupBy("a")
    clean = lambda c: F.round(c, 6) + 0.0
    return sums.agg(clean(F.sum(w)).alias("one"), clean(F.sum(w * F.col("dx"))).alias("x"), clean(F.sum(w * F.col("dy"))).alias("y"), clean(F.sum(w * F.col("dz"))).alias("z"))


@query()
def rbf_surface(spark, d):
    """One surface for each 60 parts that follow one another; together they cover all parts."""
    p = table(spark, d, "part")
    return kernels.radial_basis(p.select(F.expr("p_partkey div 60").alias("cloud"), (F.col("p_size") / 10.0).alias("x"), (F.col("p_retailprice") / 500.0).alias("y"), (F.col("p_partkey") % 7 / 2.0).alias("z"), F.sin("p_partkey").alias("v")))


@query()
def isosurface(spark, d):
    """Triangles of a sphere of radius 0.7 on a lattice of 10 cubes a side."""
    h = 0.2
    at = index_space(spark, (0, 10), (0, 10), (0, 10)).select((F.col("i") * 100 + F.col("j") * 10 + F.col("k")).alias("cell"), (F.col("i") * h - 1).alias("x"), (F.col("j") * h - 1).alias("y"), (F.col("k") * h - 1).alias("z"), F.lit(h).alias("h"))
    value = lambda c: 0.49 - ((F.col("x") + h * (c & 1)) ** 2 + (F.col("y") + h * (c >> 1 & 1)) ** 2 + (F.col("z") + h * (c >> 2)) ** 2)
    return kernels.surface(at.withColumn("f", F.array(*(value(c) for c in range(8)))))


@query("SELECT range AS cell, (CASE WHEN range < 50 THEN 1.0 ELSE 0.125 END / 100)::DOUBLE AS mass, CASE WHEN range < 50 THEN 2.5 ELSE 2.0 END::DOUBLE AS e, 1.4::DOUBLE AS gamma FROM range(100)")
def hydro_init(spark, d):
    return hydro.initial(spark, 100)[1]


@query("SELECT round(sum(CASE WHEN range < 20 THEN 1.0 * 2.5 ELSE 0.125 * 2.0 END) / 40, 4)::DOUBLE AS total FROM range(40)")
def energy_audit(spark, d):
    """Two steps of the shock tube keep the total energy."""
    nodes, cells = hydro.initial(spark, 40)
    for _ in range(2):
        nodes, cells, _ = hydro.advance(nodes, cells, 1.0)
    return hydro.energy(nodes, cells).select(F.round(F.col("internal") + F.col("kinetic"), 4).alias("total"))
