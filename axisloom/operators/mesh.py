"""Unstructured meshes as incidence relations (elem, lid, node)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Local corners of a hexahedron's six sides, two for each axis: those whose step along it is 0, then those where it is 1. Made by rule.
SIDES = tuple(tuple(c for c in range(8) if c >> axis & 1 == end) for axis in range(3) for end in (0, 1))


#: Cells of a box that one task makes, with what is aggregated before a shuffle.
MOST_CELLS = 1 << 18


def _three(n: int | float | tuple, kind: type) -> tuple:
    return tuple(kind(x) for x in n) if isinstance(n, tuple) else (kind(n),) * 3


def box_mesh(spark: SparkSession, n: int | tuple[int, int, int]) -> DataFrame:
    """(elem, lid, node) of a box of ``n`` cells along each axis, or of as many as given by axis.

    Corner lid = x + 2y + 4z of the step along each axis. No cells along some axis make an empty mesh.
    """
    nx, ny, nz = _three(n, int)
    total = nx * ny * nz
    cells = spark.range(0, total, 1, max(spark.sparkContext.defaultParallelism, -(-total // MOST_CELLS)))
    at = cells.select(F.col("id").alias("elem"), F.expr(f"id % {max(nx, 1)}").alias("x"), F.expr(f"id div {max(nx, 1)} % {max(ny, 1)}").alias("y"), F.expr(f"id div {max(nx * ny, 1)}").alias("z"))
    out = at.withColumn("lid", F.explode(F.sequence(F.lit(0), F.lit(7))))
    node = (F.col("x") + F.col("lid") % 2) + (nx + 1) * (F.col("y") + F.expr("lid div 2 % 2")) + (nx + 1) * (ny + 1) * (F.col("z") + F.expr("lid div 4"))
    return out.select("elem", "lid", node.cast("long").alias("node"))


def box_nodes(spark: SparkSession, n: int | tuple[int, int, int], length: float | tuple[float, float, float] = 1.0, origin: float | tuple[float, float, float] = 0.0) -> DataFrame:
    """(node, x, y, z) of the corners of :func:`box_mesh`, from ``origin`` over ``length`` along each axis."""
    counts, sizes, first = _three(n, int), _three(length, float), _three(origin, float)
    if min(counts) < 1:
        raise ValueError("each axis has a cell at least")
    mx, my, mz = (c + 1 for c in counts)
    steps = F.expr(f"id % {mx}"), F.expr(f"id div {mx} % {my}"), F.expr(f"id div {mx * my}")
    at = (F.lit(o) + step * (size / c) for o, step, size, c in zip(first, steps, sizes, counts, strict=True))
    return spark.range(mx * my * mz).select(F.col("id").alias("node"), *(c.alias(name) for c, name in zip(at, "xyz", strict=True)))


def elements_of_nodes(incidence: DataFrame) -> DataFrame:
    """``node``, ``elems``: inverse connectivity, ascending."""
    return incidence.select("node", "elem").distinct().groupBy("node").agg(F.array_sort(F.collect_list("elem")).alias("elems"))


def element_adjacency(incidence: DataFrame) -> DataFrame:
    """``elem``, ``other``: different elements that share a node.

    Each element goes to its nodes with its nodes before that one, so two that share several are a pair at the first of
    them alone: pairs are made last, once each, and never shuffled.
    """
    held = incidence.groupBy("elem").agg(F.array_sort(F.collect_set("node")).alias("nodes")).select("elem", "nodes", F.posexplode("nodes").alias("at", "node"))
    at = held.select("node", "elem", F.slice("nodes", 1, F.col("at")).alias("before"))
    far = at.select("node", F.col("elem").alias("other"), F.col("before").alias("others"))
    met = at.join(far, "node").where((F.col("elem") < F.col("other")) & ~F.arrays_overlap("before", "others"))
    both = F.array(F.struct("elem", "other"), F.struct(F.col("other").alias("elem"), F.col("elem").alias("other")))
    return met.select(F.inline(both))


def _corners(incidence: DataFrame) -> DataFrame:
    """``elem``, ``at``: the nodes of the eight corners, null where one is missing; a corner given twice is an error."""
    bit = F.when(F.col("lid").between(0, 7), F.expr("shiftleft(1, cast(lid as int))"))
    nodes = [F.max(F.when(F.col("lid") == c, F.col("node"))).alias(f"_{c}") for c in range(8)]
    held = incidence.groupBy("elem").agg(*nodes, F.sum(bit).alias("_sum"), F.bit_or(bit).alias("_or"))
    once = F.when(F.col("_sum") == F.col("_or"), F.array(*(f"_{c}" for c in range(8)))).otherwise(F.raise_error(F.lit("an element has a corner twice")))
    return held.select("elem", once.alias("at"))


def faces(incidence: DataFrame) -> DataFrame:
    """``elem``, ``side``, ``key``: every side of every hexahedron by its sorted nodes."""
    sides = F.array(*(F.array(*(F.col("at")[c] for c in s)) for s in SIDES))
    return _corners(incidence).select("elem", F.posexplode(sides).alias("side", "nodes")).select("elem", "side", F.array_sort("nodes").alias("key"))


def patches(incidence: DataFrame) -> DataFrame:
    """``key``, ``n_elems``: faces once each; 2 elements make an inner face, 1 a boundary face."""
    return faces(incidence).groupBy("key").agg(F.count("*").alias("n_elems"))


#: Pairs of corners that an edge of a hexahedron joins: those that differ in one step. Made by rule.
EDGES = tuple((a, b) for a in range(8) for b in range(a + 1, 8) if (a ^ b) in (1, 2, 4))


def node_edges(incidence: DataFrame) -> DataFrame:
    """``a``, ``b``: edges of hexahedra in both directions, each once."""
    ends = [(F.col("at")[x], F.col("at")[y]) for x, y in EDGES]
    swap = lambda x, y: x.isNull() | (x > y)
    pairs = [F.struct(F.when(swap(x, y), y).otherwise(x).alias("a"), F.when(swap(x, y), x).otherwise(y).alias("b")) for x, y in ends]
    once = _corners(incidence).select(F.inline(F.array(*pairs))).distinct()
    # the way back is made last, and there is none where both ends are one node
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return once.select(F.inline(F.when(F.col("a").eqNullSafe(F.col("b")), F.slice(ways, 1, 1)).otherwise(ways)))
