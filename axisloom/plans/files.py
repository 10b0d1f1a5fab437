"""Mesh files read and written in parts, logs, local writes, replicas, ghost nodes, bin lists and rewired rings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from axisloom.operators import dist, graph, mesh, points, ragged
from axisloom.plans import fields
from axisloom.plans.base import query, table
from axisloom.plans.blocks import _shared
from axisloom.plans.spread import _MAP, PARTS, _mapped
from axisloom.sources import meshlines, pvtu, steplog, vtk

# a mesh of the tables: points are parts, cells the lines of an order
_CELLS = "cells AS (SELECT dense_rank() OVER (ORDER BY l_orderkey) - 1 AS elem, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS slot, l_partkey AS node FROM lineitem)"


def _order_mesh(spark, d):
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"), (F.col("p_partkey") % 7 / 2).alias("z"))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_partkey").alias("node"))
    slot = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "node", "l_suppkey")) - 1
    numbered = ragged.prefix_sum(lines.select("l_orderkey").distinct().withColumn("one", F.lit(1)), "l_orderkey", "one", "elem")
    return nodes, lines.withColumn("lid", slot).join(numbered, "l_orderkey").select("elem", "lid", "node")


def _written_mesh(spark, d):
    path, (nodes, cells) = _shared(spark), _order_mesh(spark, d)
    vtk.write_mesh(nodes, cells, path, values={"price": nodes.select("node", F.col("y").alias("v")), "twice": nodes.select("node", (2 * F.col("x")).alias("v"))})
    return meshlines.place_lines(spark, path, parts=True)


@query(f"WITH {_CELLS} SELECT elem, slot::INTEGER AS lid, node FROM cells")
def mesh_lines_cells(spark, d):
    """Cells of one file that many tasks read; those of eight corners went through the file in another order."""
    return meshlines.incidence(_written_mesh(spark, d)).drop("file")


@query("SELECT p_partkey AS node, p_size::DOUBLE AS x, p_retailprice AS y, p_partkey % 7 / 2.0::DOUBLE AS z FROM part")
def mesh_lines_nodes(spark, d):
    return meshlines.nodes(_written_mesh(spark, d)).drop("file")


@query("SELECT 'price' AS name, p_partkey AS id, p_retailprice AS v FROM part UNION ALL SELECT 'twice', p_partkey, 2.0::DOUBLE * p_size FROM part")
def mesh_lines_values(spark, d):
    return meshlines.values(_written_mesh(spark, d)).where("of = 'POINT_DATA' and component = 0").select("name", "id", "v")


@query(f"WITH {fields.BOX} SELECT elem, lid, node, (node % (nx + 1)) * (1.0::DOUBLE / nx) AS x, (node // (nx + 1) % (ny + 1)) * (1.0::DOUBLE / ny) AS y, (node // ((nx + 1) * (ny + 1))) * (1.0::DOUBLE / nz) AS z FROM b, n")
def pvtu_round_trip(spark, d):
    """A box written in pieces by task and read back through the index."""
    path, counts = _shared(spark), fields.counts(spark, d)
    spark.dataSource.register(pvtu.Pvtu)
    pvtu.cells(mesh.box_nodes(spark, counts), mesh.box_mesh(spark, counts)).write.format("pvtu").mode("overwrite").option("cells", 5000).save(path)
    return pvtu.incidence(spark.read.format("pvtu").load(path))


@query("SELECT (12 * year(o_orderdate) + month(o_orderdate))::INTEGER AS step, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def step_log(spark, d):
    """Totals by month as a log whose last steps are written twice, first wrongly."""
    o = table(spark, d, "orders").withColumn("step", (12 * F.year("o_orderdate") + F.month("o_orderdate")).cast("int"))
    months = o.groupBy("step").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    path, last = _shared(spark), months.agg(F.max("step") - 3).first()[0]
    steplog.write_steps(months.withColumn("total", F.when(F.col("step") > last, F.lit(-1.0)).otherwise(F.col("total"))), path)
    steplog.write_steps(months.where(F.col("step") > last), path)
    return steplog.read_steps(spark, path, "n long, total double, step int").select("step", "n", "total")


def _writes(spark, d):
    """Order totals as writes to the local places of their customers."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("gid"), F.col("o_totalprice").alias("w"))
    return o.join(_mapped(spark, d).select("gid", "part", "lid"), "gid").select("part", "lid", F.col("w").alias("v"))


@query(f"WITH {_MAP}, w AS (SELECT o_custkey AS gid, max(o_totalprice) AS w FROM orders GROUP BY 1) SELECT gid, part, lid, coalesce(w, v) AS v FROM p LEFT JOIN w USING (gid)")
def local_replace(spark, d):
    return dist.replace_local(_mapped(spark, d).select("gid", "part", "lid", "v"), _writes(spark, d))


@query(f"WITH {_MAP}, w AS (SELECT o_custkey AS gid, sum(o_totalprice) AS w FROM orders GROUP BY 1) SELECT gid, part, lid, round(v + coalesce(w, 0), 2) AS v FROM p LEFT JOIN w USING (gid)")
def local_sum_into(spark, d):
    return dist.sum_into_local(_mapped(spark, d).select("gid", "part", "lid", "v"), _writes(spark, d)).withColumn("v", F.round("v", 2))


@query(f"WITH {_MAP} SELECT part, lid, 3 * gid + 5 AS gid, v FROM p")
def map_replace(spark, d):
    """Account balances under other global ids at the same local places."""
    m = _mapped(spark, d)
    return dist.replace_map(m, m.select("part", "lid", (3 * F.col("gid") + 5).alias("gid")), "gid")


@query(f"WITH c AS (SELECT DISTINCT part, l_suppkey AS k FROM lineitem, (SELECT unnest(range({PARTS}))::INTEGER AS part)), s AS (SELECT l_suppkey AS k, sum(l_quantity) AS v FROM lineitem GROUP BY 1) SELECT part, k, v FROM c JOIN s USING (k)")
def reduce_replicas(spark, d):
    """Quantities by supplier, each part holding a copy of the vector with what its own orders sold."""
    l = table(spark, d, "lineitem").select((F.col("l_orderkey") % PARTS).cast("int").alias("part"), F.col("l_suppkey").alias("k"), F.col("l_quantity").alias("v"))  # noqa: E741
    sold = l.groupBy("part", "k").agg(F.sum("v").alias("v"))
    every = l.select("k").distinct().withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return dist.reduce_replicas(every.join(sold, ["part", "k"], "left").withColumn("v", F.coalesce("v", F.lit(0.0))), "k")


@query("""
WITH e AS (SELECT DISTINCT l_orderkey % 31 AS part, l_orderkey AS elem, l_partkey AS node FROM lineitem), own AS (SELECT DISTINCT part, node FROM e),
g AS (SELECT DISTINCT own.part, e.elem FROM e JOIN own ON own.node = e.node AND own.part <> e.part)
SELECT g.part, e.node, max(e.part) AS owner FROM g JOIN e USING (elem) WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.part = g.part AND own.node = e.node) GROUP BY 1, 2
""")
def ghost_nodes(spark, d):
    """Orders dealt to 31 parts, and the parts of neighbouring orders that each lacks."""
    e = table(spark, d, "lineitem").select((F.col("l_orderkey") % 31).alias("part"), F.col("l_orderkey").alias("elem"), F.col("l_partkey").alias("node"))
    return dist.ghost_nodes(e)


@query("WITH b AS (SELECT p_partkey, least(19, greatest(0, round(p_size / 2.5 - 1e-8)))::BIGINT AS b_x, least(19, greatest(0, round(p_retailprice / 120.0 - 1e-8)))::BIGINT AS b_y FROM part) SELECT b_x, b_y, row_number() OVER (PARTITION BY b_x, b_y ORDER BY p_partkey) - 1 AS pos, p_partkey FROM b")
def bin_members(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    return points.bin_members(points.with_bins(p, {"x": 2.5, "y": 120.0}, 20), "p_partkey", "x", "y")


@query("""
WITH n AS (SELECT count(*) AS n FROM customer), e AS (SELECT n, src, step, md5('7:' || src || ':' || step) AS m FROM (SELECT n, unnest(range(n)) AS src FROM n) CROSS JOIN (SELECT unnest(range(1, 4)) AS step))
SELECT DISTINCT src, dst FROM (SELECT src, (src + n - step) % n AS dst FROM e UNION ALL
SELECT src, (src + CASE WHEN ('0x' || substr(m, 1, 8))::BIGINT < 0.1 * 4294967296 THEN 3 + ('0x' || substr(m, 9, 8))::BIGINT % (n - 6) ELSE step END) % n FROM e)
""")
def rewired_ring(spark, d):
    """A ring of the customers with a tenth of the forward edges rewired."""
    return graph.small_world(spark, table(spark, d, "customer").count(), 3, 0.1, 7)
