"""Grids: neighbour access by lag and lead along an axis, or by shifted keys in more dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axisloom.operators.iterate import saved


def neighbours(df: DataFrame, offsets: list[tuple[int, int]], v: str = "v", missing: float = 0.0) -> DataFrame:
    """(i, j, v, n0, n1, ...): values at (i + di, j + dj), ``missing`` beyond the grid.

    Every cell is sent once to each reader and one aggregate gathers them: one shuffle, whatever the stencil.
    """
    sent = F.array(*(F.struct((F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j"), F.lit(n).alias("n"), F.col(v).alias("x")) for n, (di, dj) in enumerate(offsets)), F.struct("i", "j", F.lit(-1).alias("n"), F.col(v).alias("x")))
    got = df.select(F.explode(sent).alias("e")).select("e.*").groupBy("i", "j")
    pick = [F.max(F.when(F.col("n") == n, F.col("x"))).alias(f"n{n}") for n in range(len(offsets))]
    out = got.agg(F.max(F.when(F.col("n") == -1, F.col("x"))).alias(v), F.count_if(F.col("n") == -1).alias("_own"), *pick).where("_own > 0").drop("_own")
    return out.withColumns({f"n{n}": F.coalesce(f"n{n}", F.lit(missing)) for n in range(len(offsets))})


CROSS = [(1, 0), (-1, 0), (0, 1), (0, -1)]


def laplacian_1d(df: DataFrame, order: str, v: str, group: list[str]) -> DataFrame:
    """Second difference along an ordered axis within groups; 0 at the ends."""
    w = Window.partitionBy(*group).orderBy(order)
    left, right = F.lag(v).over(w), F.lead(v).over(w)
    return df.withColumn("lap", F.coalesce(left - 2 * F.col(v) + right, F.lit(0.0)))


def jacobi_step(df: DataFrame, rows: int, cols: int) -> DataFrame:
    """Inner cells become the mean of their four neighbours; the rim stays."""
    inner = F.col("i").between(1, rows - 2) & F.col("j").between(1, cols - 2)
    return neighbours(df, CROSS).select("i", "j", F.when(inner, (F.col("n0") + F.col("n1") + F.col("n2") + F.col("n3")) / 4).otherwise(F.col("v")).alias("v"))


def jacobi(df: DataFrame, rows: int, cols: int, tolerance: float, most: int = 500, every: int = 10) -> tuple[DataFrame, int]:
    """Steps until the largest change of a step is at most the tolerance, and their number; an error after ``most``."""
    for done in range(1, most + 1):
        new = jacobi_step(df, rows, cols)
        if done % every and done < most:
            df = new
            continue
        old, new = df, saved(new)
        diff = old.withColumnRenamed("v", "w").join(new, ["i", "j"]).agg(F.max(F.abs(F.col("v") - F.col("w")))).first()[0]
        df = new
        if diff is None or diff <= tolerance:
            return df, done
    raise RuntimeError(f"the grid did not settle in {most} steps")


def dfdc(c: Column) -> Column:
    """Derivative of the double well c**2 * (1 - c)**2."""
    return 4 * c * c * c - 6 * c * c + 2 * c


def free_energy(df: DataFrame, rows: int, cols: int, kappa: float = 1.0) -> DataFrame:
    """Sum over inner cells of the double well and half kappa times the squared central gradient."""
    g = neighbours(df, CROSS).where(F.col("i").between(1, rows - 2) & F.col("j").between(1, cols - 2))
    c = F.col("v")
    gx, gy = (F.col("n0") - F.col("n1")) / 2, (F.col("n2") - F.col("n3")) / 2
    return g.agg(F.coalesce(F.sum(c * c * (1 - c) * (1 - c) + 0.5 * kappa * (gx * gx + gy * gy)), F.lit(0.0)).alias("energy"))
