"""Small dense systems: closed forms as expressions; LU and QR in numpy for each block of a grouped relation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axisloom.operators.iterate import saved

TINY = 1e-16


def det3(a: list[list[Column]]) -> Column:
    return a[0][0] * (a[1][1] * a[2][2] - a[1][2] * a[2][1]) - a[0][1] * (a[1][0] * a[2][2] - a[1][2] * a[2][0]) + a[0][2] * (a[1][0] * a[2][1] - a[1][1] * a[2][0])


def determinant(a: list[list[Column]]) -> Column:
    """By the cofactors of the first row; for a handful of rows."""
    if len(a) == 1:
        return a[0][0]
    parts = [a[0][c] * determinant([[x for k, x in enumerate(row) if k != c] for row in a[1:]]) * (-1) ** c for c in range(len(a))]
    return sum(parts[1:], parts[0])


def inv4(a: list[list[Column]]) -> list[list[Column]]:
    """Adjugate over determinant of a 4 by 4 matrix; the determinant is moved off zero by 1e-16."""
    d = determinant(a) + TINY
    without = lambda r, c: [[x for k, x in enumerate(row) if k != c] for n, row in enumerate(a) if n != r]
    return [[determinant(without(c, r)) * (-1) ** (r + c) / d for c in range(4)] for r in range(4)]


def inv3(a: list[list[Column]]) -> list[list[Column]]:
    """Adjugate over determinant; the determinant is moved off zero by 1e-16."""
    d = det3(a) + TINY

    def minor(r: int, c: int) -> Column:
        p, q = (x for x in range(3) if x != r), (x for x in range(3) if x != c)
        (p0, p1), (q0, q1) = p, q
        return a[p0][q0] * a[p1][q1] - a[p0][q1] * a[p1][q0]

    return [[(minor(c, r) if (r + c) % 2 == 0 else -minor(c, r)) / d for c in range(3)] for r in range(3)]


def lu_decompose(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(L and U in one matrix, row order, parity) with scaled partial pivots; parity 0 if a row is all zero."""
    a, n = a.astype(float).copy(), len(a)
    scale, order, parity = np.abs(a).max(axis=1), np.arange(n), 1
    if (scale == 0).any():
        return a, order, 0
    for k in range(n):
        p = k + int(np.argmax(np.abs(a[k:, k]) / scale[k:]))
        if p != k:
            a[[k, p]], scale[[k, p]], order[[k, p]] = a[[p, k]], scale[[p, k]], order[[p, k]]
            parity = -parity
        if a[k, k] == 0:
            a[k, k] = 1e-15
        a[k + 1 :, k] /= a[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k], a[k, k + 1 :])
    return a, order, parity


def lu_solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Forward over every row, then back, for one right side or several side by side; NaN where the matrix has a zero row."""
    lu, order, parity = lu_decompose(a)
    if parity == 0:
        return np.full(b.shape, np.nan)
    x = b.astype(float)[order]
    for k in range(len(x)):
        x[k] -= lu[k, :k] @ x[:k]
    for k in range(len(x) - 1, -1, -1):
        x[k] = (x[k] - lu[k, k + 1 :] @ x[k + 1 :]) / lu[k, k]
    return x


def lu_determinant(a: np.ndarray) -> float:
    lu, _, parity = lu_decompose(a)
    return parity * float(np.prod(np.diag(lu)))


def lu_inverse(a: np.ndarray) -> np.ndarray:
    """All columns of the identity from one factorization; NaN where the matrix has a zero row."""
    return lu_solve(a, np.eye(len(a))) if len(a) else a


def qr_determinant(a: np.ndarray) -> float:
    """Product of the diagonal of R. Gram-Schmidt leaves it non-negative, so the sign of the determinant is lost."""
    return float(np.prod(np.diag(qr_decompose(a)[1])))


def qr_decompose(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Modified Gram-Schmidt."""
    q, n = a.astype(float).copy(), a.shape[1]
    r = np.zeros((n, n))
    for k in range(n):
        r[k, k] = np.linalg.norm(q[:, k])
        q[:, k] /= r[k, k] if r[k, k] else 1.0
        r[k, k + 1 :] = q[:, k] @ q[:, k + 1 :]
        q[:, k + 1 :] -= np.outer(q[:, k], r[k, k + 1 :])
    return q, r


def qr_solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    q, r = qr_decompose(a)
    x = q.T @ b
    for k in range(len(x) - 1, -1, -1):
        x[k] = (x[k] - r[k, k + 1 :] @ x[k + 1 :]) / (r[k, k] if r[k, k] else TINY)
    return x


def _each_block(cells: DataFrame, block: str, schema: str, of) -> DataFrame:
    """``of`` (columns of what it gives, from a block's number and its i, j and v), for the cells of each small block.

    Cells of a block travel as flat arrays, and many blocks come in one batch. A block has at most 2000 rows.
    """
    cell = F.struct(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.col("v").cast("double").alias("v"))
    packed = cells.groupBy(F.col(block).cast("long").alias("block")).agg(F.collect_list(cell).alias("c")).select("block", "c.i", "c.j", "c.v")

    def step(batches):
        for batch in batches:
            found = []
            for k, i, j, v in zip(batch["block"], batch["i"], batch["j"], batch["v"], strict=True):
                if max(i.max(), j.max()) >= 2000:
                    raise ValueError("a block has at most 2000 rows")
                found.append(of(k, i, j, v))
            if found:
                yield pd.DataFrame({name: np.concatenate([np.atleast_1d(x[n]) for x in found]) for n, name in enumerate(y.split()[0] for y in schema.split(", "))})

    return packed.mapInPandas(step, schema)


def _matrix(i: np.ndarray, j: np.ndarray, v: np.ndarray) -> np.ndarray:
    n = int(max(i.max(), j.max())) + 1
    a = np.zeros((n, n))
    a[i, j] = v
    return a


def solve_blocks(cells: DataFrame, method: str = "lu", block: str = "block") -> DataFrame:
    """Solve each block's system: (block, i, j, v), the right side at j = -1; gives (block, i, x).

    A block is one small dense system of at most 2000 unknowns, so it fits a task.
    """
    solver = {"lu": lu_solve, "qr": qr_solve}[method]

    def of(k: int, i: np.ndarray, j: np.ndarray, v: np.ndarray):
        n = int(i.max()) + 1
        a, b = np.zeros((n, n)), np.zeros(n)
        rhs = j < 0
        b[i[rhs]] = v[rhs]
        a[i[~rhs], j[~rhs]] = v[~rhs]
        return np.full(n, k), np.arange(n), solver(a, b)

    return _each_block(cells, block, f"{block} long, i long, x double", of)


def invert_blocks(cells: DataFrame, block: str = "block") -> DataFrame:
    """The inverse of each block's matrix (block, i, j, v), by LU; nulls for a matrix with a zero row."""

    def of(k: int, i: np.ndarray, j: np.ndarray, v: np.ndarray):
        x = lu_inverse(_matrix(i, j, v))
        at = np.divmod(np.arange(x.size), len(x))
        return np.full(x.size, k), *at, x.ravel()

    return _each_block(cells, block, f"{block} long, i long, j long, v double", of)


def block_determinants(cells: DataFrame, method: str = "lu", block: str = "block") -> DataFrame:
    """``det`` of each block's matrix (block, i, j, v); by QR without its sign."""
    by = {"lu": lu_determinant, "qr": qr_determinant}[method]
    return _each_block(cells, block, f"{block} long, det double", lambda k, i, j, v: (k, by(_matrix(i, j, v))))


def matmul_blocked(a: DataFrame, b: DataFrame, size: int = 256) -> DataFrame:
    """Dense product by blocks: cells meet in numpy tiles of ``size``; partial tiles are added in the plan.

    A tile travels as two flat arrays, the places of its cells in the tile and their values.
    """

    def tiles(df: DataFrame) -> DataFrame:
        place = ((F.col("i") % size) * size + F.col("j") % size).cast("int")
        at = F.expr(f"i div {size}").alias("bi"), F.expr(f"j div {size}").alias("bj")
        cells = df.groupBy(*at).agg(F.collect_list(F.struct(place.alias("at"), F.col("v").cast("double").alias("v"))).alias("cells"))
        return cells.select("bi", "bj", F.col("cells.at").alias("at"), F.col("cells.v").alias("v"))

    left = tiles(a).select("bi", F.col("bj").alias("bk"), F.col("at").alias("p"), F.col("v").alias("x"))
    right = tiles(b).select(F.col("bi").alias("bk"), "bj", F.col("at").alias("q"), F.col("v").alias("y"))

    def product(batches):
        for batch in batches:
            out = []
            for bi, bj, p, x, q, y in zip(*(batch[c] for c in ("bi", "bj", "p", "x", "q", "y")), strict=True):
                # rows and columns that hold a cell are all that is multiplied
                i, row = np.unique(p // size, return_inverse=True)
                j, col = np.unique(q % size, return_inverse=True)
                u, w = np.zeros((len(i), size)), np.zeros((size, len(j)))
                u[row, p % size], w[q // size, col] = x, y
                z = u @ w
                r, c = np.nonzero(z)
                out.append((i[r] + bi * size, j[c] + bj * size, z[r, c]))
            if out:
                yield pd.DataFrame({n: np.concatenate(c) for n, c in zip("ijv", zip(*out, strict=True), strict=True)})

    # dealt by number: compressed tiles look small, so they would be put together into a few long tasks
    n = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = left.repartition(n, "bk"), right.repartition(n, "bk")
    joined = left.join(right, "bk").select("bi", "bj", "p", "x", "q", "y")
    return joined.mapInPandas(product, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))


def power_iteration(a: DataFrame, tolerance: float = 1e-12, most: int = 1000, every: int = 5) -> tuple[DataFrame, float, int]:
    """(vector (i, x), eigenvalue, steps) of the largest eigenvalue in size of a square sparse matrix (i, j, v).

    From ones, ``every`` products at a time; then the vector is scaled to a largest entry of 1 and its L1 change since
    the last test is compared with ``tolerance`` times its L1 norm. Only these sums reach the driver. The eigenvalue is
    the Rayleigh quotient. Not settling in ``most`` steps, or a vector of zeros, is an error; so are no cells.
    """
    a = saved(a.select("i", "j", "v"))
    x = saved(a.select(F.explode(F.array("i", "j")).alias("i")).distinct().withColumn("x", F.lit(1.0)))
    if x.isEmpty():
        raise ValueError("the matrix has no cells")
    for done in range(every, most + every, every):
        new = x
        for _ in range(every):
            y = a.join(new.withColumnRenamed("i", "j"), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("x"))
            new = y
        new = saved(new)
        size = new.agg(F.max(F.abs("x"))).first()[0]
        if not size:
            raise ValueError("the vector became zero")
        lead = new.where(F.abs("x") == size).agg(F.max("x")).first()[0]  # its sign keeps the scaled vector from flipping
        new = new.withColumn("x", F.col("x") / lead)
        both = x.withColumnRenamed("x", "w").join(new, "i", "full").select(F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("w", F.lit(0.0)).alias("w"))
        change, norm = both.agg(F.sum(F.abs(F.col("x") - F.col("w"))), F.sum(F.abs("x"))).first()
        x = new
        if change <= tolerance * norm:
            y = a.join(x.withColumnRenamed("i", "j"), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("y"))
            top, low = x.join(y, "i", "left").agg(F.sum(F.col("x") * F.coalesce("y", F.lit(0.0))), F.sum(F.col("x") * F.col("x"))).first()
            return x, top / low, done
    raise RuntimeError(f"the vector did not settle in {most} steps")
