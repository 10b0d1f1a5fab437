"""One-dimensional Lagrangian gas dynamics: nodes and cells as two relations, advanced by a driver loop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axisloom.operators.iterate import saved
from axisloom.operators.loops import index_space

#: Shock tube regions: from, to, density, specific internal energy, velocity, gamma.
TUBE = ((0.0, 0.5, 1.0, 2.5, 0.0, 1.4), (0.5, 1.0, 0.125, 2.0, 0.0, 1.4))


def initial(spark: SparkSession, n: int, regions=TUBE) -> tuple[DataFrame, DataFrame]:
    """(nodes: node, x, u), (cells: cell, mass, e, gamma); a later region wins where two meet."""
    lo, hi = regions[0][0], regions[-1][1]
    h = (hi - lo) / n
    cells = index_space(spark, (0, n)).toDF("cell").withColumn("c", lo + (F.col("cell") + 0.5) * h)
    pick = {k: F.lit(None).cast("double") for k in ("rho", "e", "u", "gamma")}
    for a, b, rho, e, u, g in regions:
        pick = {k: F.when(F.col("c").between(a, b), F.lit(v)).otherwise(pick[k]) for k, v in (("rho", rho), ("e", e), ("u", u), ("gamma", g))}
    cells = cells.select("cell", (pick["rho"] * h).alias("mass"), pick["e"].alias("e"), pick["gamma"].alias("gamma"))
    nodes = index_space(spark, (0, n + 1)).toDF("node").select("node", (lo + F.col("node") * h).alias("x"), F.lit(0.0).alias("u"))
    return nodes, cells


def state(nodes: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells with their length, density, pressure, sound speed and end velocities: two joins on the node."""
    left = nodes.select(F.col("node").alias("cell"), F.col("x").alias("x0"), F.col("u").alias("u0"))
    right = nodes.select((F.col("node") - 1).alias("cell"), F.col("x").alias("x1"), F.col("u").alias("u1"))
    s = cells.join(left, "cell").join(right, "cell").withColumn("dx", F.col("x1") - F.col("x0"))
    s = s.withColumn("rho", F.col("mass") / F.col("dx")).withColumn("p", (F.col("gamma") - 1) * F.col("rho") * F.col("e"))
    s = s.withColumn("sound", F.sqrt(F.greatest(F.col("gamma") * F.col("p") / F.col("rho"), F.lit(0.0))))
    squeeze = F.least(F.col("u1") - F.col("u0"), F.lit(0.0))
    return s.withColumn("q", F.col("rho") * (2 * squeeze * squeeze - F.col("sound") * squeeze))


def energy(nodes: DataFrame, cells: DataFrame) -> DataFrame:
    """``internal``, ``kinetic``: sums of mass * e, and of half the mass at the nodes times the squared velocity."""
    s = state(nodes, cells)
    half = 0.25 * F.col("mass") * (F.col("u0") * F.col("u0") + F.col("u1") * F.col("u1"))
    return s.agg(F.sum(F.col("mass") * F.col("e")).alias("internal"), F.sum(half).alias("kinetic"))


def step(nodes: DataFrame, cells: DataFrame, dt: float, base: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """From ``base`` over dt with the forces of (nodes, cells); fixed ends. Total energy is conserved."""
    b_nodes, b_cells = base or (nodes, cells)
    s = state(nodes, cells)
    push = s.select(F.explode(F.array(F.struct(F.col("cell").alias("node"), (-(F.col("p") + F.col("q"))).alias("f"), (F.col("mass") / 2).alias("m")), F.struct((F.col("cell") + 1).alias("node"), (F.col("p") + F.col("q")).alias("f"), (F.col("mass") / 2).alias("m")))).alias("r")).select("r.*")
    force = push.groupBy("node").agg(F.sum("f").alias("f"), F.sum("m").alias("m"), F.count("*").alias("sides"))
    moved = b_nodes.join(force, "node").withColumn("v", F.when(F.col("sides") == 2, F.col("u") + dt * F.col("f") / F.col("m")).otherwise(0.0))
    new = moved.select("node", (F.col("x") + dt * (F.col("u") + F.col("v")) / 2).alias("x"), F.col("v").alias("u"), ((F.col("u") + F.col("v")) / 2).alias("mean"))
    left, right = new.select(F.col("node").alias("cell"), F.col("mean").alias("a")), new.select((F.col("node") - 1).alias("cell"), F.col("mean").alias("b"))
    work = s.select("cell", (F.col("p") + F.col("q")).alias("pq")).join(left, "cell").join(right, "cell")
    out = b_cells.join(work, "cell").select("cell", "mass", (F.col("e") - dt * F.col("pq") * (F.col("b") - F.col("a")) / F.col("mass")).alias("e"), "gamma")
    return new.select("node", "x", "u"), out


def advance(nodes: DataFrame, cells: DataFrame, longest: float, cfl: float = 0.3) -> tuple[DataFrame, DataFrame, float]:
    """One two-stage step of the stable size (a min-reduction over the cells), of ``longest`` at most; saved."""
    dt = state(nodes, cells).agg(F.min(F.col("dx") / (F.col("sound") + F.abs(F.col("u1") - F.col("u0")) + 1e-12))).first()[0]
    dt = min(cfl * dt, longest)
    half = step(nodes, cells, dt / 2)
    nodes, cells = step(*half, dt, (nodes, cells))
    return saved(nodes), saved(cells), dt


def run(nodes: DataFrame, cells: DataFrame, until: float, cfl: float = 0.3, most: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """Steps until the time is reached; an error if ``most`` steps don't reach it."""
    t = 0.0
    for _ in range(most):
        if t >= until - 1e-12:
            return nodes, cells
        nodes, cells, dt = advance(nodes, cells, until - t, cfl)
        t += dt
    if t >= until - 1e-12:
        return nodes, cells
    raise RuntimeError(f"{most} steps reach {t}, not {until}")
