"""Operators that need numpy on a bounded block: spectral steps, moment systems, surfaces, radial bases."""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisloom.operators.linalg import lu_solve

MOST_CELLS = 1 << 22


def spectral_step(grids: DataFrame, n: int, dt: float, mobility: float = 1.0, kappa: float = 1.0) -> DataFrame:
    """(grid, i, j, v) one semi-implicit step of a conserved field with a double well, on periodic n by n grids.

    Each grid is transformed as a whole, so n * n is at most 2**22; many grids spread over the cluster.
    """
    if n * n > MOST_CELLS:
        raise ValueError("a grid has at most 2**22 cells")
    k = 2 * np.pi * np.fft.fftfreq(n)
    k2 = k[:, None] ** 2 + k[None, :] ** 2

    def one(part: pd.DataFrame) -> pd.DataFrame:
        c = np.zeros((n, n))
        c[part["i"], part["j"]] = part["v"]
        force = np.fft.fft2(4 * c**3 - 6 * c**2 + 2 * c)
        new = (np.fft.fft2(c) - dt * mobility * k2 * force) / (1 + dt * mobility * kappa * k2 * k2)
        i, j = np.divmod(np.arange(n * n), n)
        return pd.DataFrame({"grid": part["grid"].iloc[0], "i": i, "j": j, "v": np.fft.ifft2(new).real.ravel()})

    return grids.groupBy("grid").applyInPandas(one, "grid long, i long, j long, v double")


def reproducing_coefficients(neighbours: DataFrame) -> DataFrame:
    """``a``, ``c0`` .. ``c3``: corrections that let kernel sums reproduce linear fields.

    ``neighbours`` (a, dx, dy, dz, w): each point's neighbours with offset and kernel weight. The moments are
    aggregates; only each point's 4 by 4 system goes to numpy.
    """
    p = [F.lit(1.0), F.col("dx"), F.col("dy"), F.col("dz")]
    moments = neighbours.groupBy("a").agg(*(F.sum(p[r] * p[c] * F.col("w")).alias(f"m{r}{c}") for r in range(4) for c in range(r, 4)))

    def solve(batches):
        for batch in batches:
            m = np.array([[batch[f"m{min(r, c)}{max(r, c)}"] for c in range(4)] for r in range(4)], float).transpose(2, 0, 1)
            one = np.array([1.0, 0, 0, 0])
            if np.linalg.cond(m).max(initial=0) < 1e12:
                x = np.linalg.solve(m, np.broadcast_to(one[:, None], (len(m), 4, 1)))[..., 0]
            else:  # points whose neighbours lie in a plane
                x = np.array([lu_solve(a, one) for a in m])
            yield pd.DataFrame({"a": batch["a"], **{f"c{c}": x[:, c] for c in range(4)}})

    return moments.mapInPandas(solve, "a long, c0 double, c1 double, c2 double, c3 double")


def radial_basis(points: DataFrame, most: int = 2000) -> DataFrame:
    """(cloud, k, coef): exp(-r**2) weights of each cloud's points (cloud, x, y, z, v), then 1, x, y, z terms (k = -1 .. -4)."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        if len(part) > most:
            raise ValueError(f"a cloud has at most {most} points")
        part = part.sort_values(["x", "y", "z", "v"])
        x = part[["x", "y", "z"]].to_numpy()
        n = len(x)
        a = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1))
        p = np.column_stack([np.ones(n), x])
        whole = np.block([[a, p], [p.T, np.zeros((4, 4))]])
        coef = np.linalg.lstsq(whole, np.concatenate([part["v"], np.zeros(4)]), rcond=None)[0]
        return pd.DataFrame({"cloud": part["cloud"].iloc[0], "k": [*range(n), -1, -2, -3, -4], "coef": coef})

    return points.groupBy("cloud").applyInPandas(one, "cloud long, k long, coef double")


#: The six tetrahedra of a cube around the diagonal from corner 0 to corner 7: one for each order of the axes.
TETRAHEDRA = tuple((0, 1 << a, (1 << a) | (1 << b), 7) for a, b, _ in permutations(range(3)))


def surface(cells: DataFrame, level: float = 0.0) -> DataFrame:
    """Triangles of the level set: (cell, x, y, z, h, f) with f the 8 corner values in x + 2y + 4z order.

    Each cube is cut into six tetrahedra by rule, and each of these into at most two triangles with corners
    interpolated along its edges; no case table is needed, and neighbouring cubes meet without gaps.
    """

    def cut(batches):
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                f = np.asarray(row.f, float) - level
                if (f > 0).all() or (f <= 0).all():
                    continue
                corner = np.array([[row.x + row.h * (c & 1), row.y + row.h * (c >> 1 & 1), row.z + row.h * (c >> 2)] for c in range(8)])
                no = 0
                for t in TETRAHEDRA:
                    up, down = [c for c in t if f[c] > 0], [c for c in t if f[c] <= 0]
                    if not up or not down:
                        continue
                    mid = lambda a, b: corner[a] + (corner[b] - corner[a]) * f[a] / (f[a] - f[b])  # noqa: E731, B023
                    if len(up) == 2:
                        q = [mid(up[0], down[0]), mid(up[0], down[1]), mid(up[1], down[1]), mid(up[1], down[0])]
                        faces = [(q[0], q[1], q[2]), (q[0], q[2], q[3])]
                    else:
                        one, rest = (up[0], down) if len(up) == 1 else (down[0], up)
                        faces = [tuple(mid(one, r) for r in rest)]
                    for face in faces:
                        out.append((row.cell, no, *np.concatenate(face)))
                        no += 1
            yield pd.DataFrame(out, columns=["cell", "no", *(f"{c}{k}" for k in range(3) for c in "xyz")])

    return cells.mapInPandas(cut, "cell long, no int, " + ", ".join(f"{c}{k} double" for k in range(3) for c in "xyz"))
