"""Fourier transforms of grids that no task holds: bricks of cells, gathered into pencils along one axis after the other.

A grid (i, j, k, v) is packed into bricks of ``side`` cells a side, several fields beside one another. To transform an
axis the bricks of one pencil bundle, all along the axis and one brick across, come together in a task, are transformed
there as one array and leave as bricks again. A bundle holds n * side * side cells; a plane or the whole grid never
meets in one place.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BRICK = "b0 int, b1 int, b2 int, data binary"
_NAMES = ["b0", "b1", "b2", "data"]
Shape = tuple[int, int, int]


def _extent(at: int, n: int, side: int) -> int:
    return min(side, n - at * side)


def _table(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
    return pa.table([pa.array(cols[k], pa.int32()) for k in range(3)] + [pa.array(cols[3], pa.binary())], names=_NAMES)


def _array(data: bytes, size: list[int]) -> np.ndarray:
    return np.frombuffer(data, np.complex128).reshape(-1, *size)


def bricks(cells: DataFrame, shape: Shape, side: int, v: str = "v") -> DataFrame:
    """Pack (i, j, k, v) into bricks of one field. Cells that are missing are 0, repeated ones add up; those beyond the shape are an error."""

    def pack(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        b = [k.as_py() for k in key]
        size = [_extent(at, n, side) for at, n in zip(b, shape, strict=True)]
        out = np.zeros(size, np.complex128)
        place = tuple(rows.column(c).to_numpy() - at * side for c, at in zip("ijk", b, strict=True))
        np.add.at(out, place, rows.column("v").to_numpy())
        return _table([(*b, out.tobytes())])

    inside = [F.col(c).between(0, n - 1) for c, n in zip("ijk", shape, strict=True)]
    checked = F.when(inside[0] & inside[1] & inside[2], F.coalesce(F.col(v).cast("double"), F.lit(0.0))).otherwise(F.raise_error(F.lit("a cell lies beyond the grid")).cast("double"))
    placed = cells.select(*(F.expr(f"cast({c} div {side} as int)").alias(f"b{k}") for k, c in enumerate("ijk")), *(F.col(c).cast("long").alias(c) for c in "ijk"), checked.alias("v"))
    held = placed.groupBy("b0", "b1", "b2").applyInArrow(pack, BRICK)
    # bricks without a cell are zeros: a pencil needs all of its bricks
    count = [-(-n // side) for n in shape]
    empty = cells.sparkSession.range(count[0] * count[1] * count[2]).select(*(F.expr(e).cast("int").alias(f"b{k}") for k, e in enumerate((f"id div {count[1] * count[2]}", f"(id div {count[2]}) % {count[1]}", f"id % {count[2]}"))))
    size = [F.least(F.lit(side), F.lit(n) - F.col(f"b{k}") * side) for k, n in enumerate(shape)]
    filled = F.coalesce("data", F.expr("unhex(repeat('00', cast(_n as int) * 16))"))
    return empty.join(held, ["b0", "b1", "b2"], "left").withColumn("_n", size[0] * size[1] * size[2]).select("b0", "b1", "b2", filled.alias("data"))


def along(grid: DataFrame, axis: int, shape: Shape, side: int, of: Callable[[np.ndarray, tuple[np.ndarray, ...]], np.ndarray]) -> DataFrame:
    """``of`` (fields by cells of a pencil bundle, and the indices along each axis) applied to every bundle along an axis."""
    across = [k for k in range(3) if k != axis]

    def step(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        b = dict(zip(across, (k.as_py() for k in key), strict=True))
        rows = rows.sort_by(f"b{axis}")
        parts = []
        for at, data in zip(rows.column(f"b{axis}").to_pylist(), rows.column("data").to_pylist(), strict=True):
            parts.append(_array(data, [_extent(at if k == axis else b[k], shape[k], side) for k in range(3)]))
        whole = np.concatenate(parts, axis=axis + 1)
        index = tuple(np.arange(shape[k]) if k == axis else np.arange(b[k] * side, b[k] * side + whole.shape[k + 1]) for k in range(3))
        made = of(whole, index)
        out = []
        for at in range(-(-shape[axis] // side)):
            cut = [slice(None)] * 4
            cut[axis + 1] = slice(at * side, (at + 1) * side)
            out.append((*(at if k == axis else b[k] for k in range(3)), np.ascontiguousarray(made[tuple(cut)], np.complex128).tobytes()))
        return _table(out)

    return grid.groupBy(*(f"b{k}" for k in across)).applyInArrow(step, BRICK)


def each(grid: DataFrame, shape: Shape, side: int, of: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``of`` (fields by cells) applied to every brick where it lies."""

    def step(batches):
        for batch in batches:
            rows = []
            for *b, data in zip(*(batch.column(c).to_pylist() for c in _NAMES), strict=True):
                rows.append((*b, np.ascontiguousarray(of(_array(data, [_extent(at, n, side) for at, n in zip(b, shape, strict=True)])), np.complex128).tobytes()))
            yield from _table(rows).to_batches()

    return grid.mapInArrow(step, BRICK)


def forward(grid: DataFrame, shape: Shape, side: int) -> DataFrame:
    """The discrete Fourier transform along all three axes."""
    for axis in range(3):
        grid = along(grid, axis, shape, side, lambda x, _, a=axis: np.fft.fft(x, axis=a + 1))
    return grid


def inverse(grid: DataFrame, shape: Shape, side: int) -> DataFrame:
    for axis in (2, 1, 0):
        grid = along(grid, axis, shape, side, lambda x, _, a=axis: np.fft.ifft(x, axis=a + 1))
    return grid


def cells(grid: DataFrame, shape: Shape, side: int) -> DataFrame:
    """(i, j, k, re, im) of the first field."""

    def step(batches):
        for batch in batches:
            for *b, data in zip(*(batch.column(c).to_pylist() for c in _NAMES), strict=True):
                x = _array(data, [_extent(at, n, side) for at, n in zip(b, shape, strict=True)])[0]
                at = [(a + s * side).ravel() for a, s in zip(np.indices(x.shape), b, strict=True)]
                yield pa.RecordBatch.from_arrays([*(pa.array(a.astype(np.int64)) for a in at), pa.array(x.real.ravel()), pa.array(x.imag.ravel())], names=[*"ijk", "re", "im"])

    return grid.mapInArrow(step, "i long, j long, k long, re double, im double")


def phase_field_step(start: DataFrame, shape: Shape, dt: float, side: int = 32, mobility: float = 1.0, kappa: float = 1.0) -> DataFrame:
    """(i, j, k, v) after one semi-implicit step of a conserved field with a double well, on a periodic grid.

    The field and its force are transformed side by side; along the last axis the step is taken between transform and
    inverse, so five gatherings do for both directions. What is missing of the grid is 0.
    """
    waves = [2 * np.pi * np.fft.fftfreq(n) for n in shape]

    def turn(x: np.ndarray, index: tuple[np.ndarray, ...]) -> np.ndarray:
        y = np.fft.fft(x, axis=3)
        k2 = sum((waves[k][index[k]] ** 2).reshape([-1 if a == k else 1 for a in range(3)]) for k in range(3))
        new = (y[0] - dt * mobility * k2 * y[1]) / (1 + dt * mobility * kappa * k2 * k2)
        return np.fft.ifft(new[None], axis=3)

    both = each(bricks(start, shape, side), shape, side, lambda x: np.stack([x[0], 4 * x[0] ** 3 - 6 * x[0] ** 2 + 2 * x[0]]))
    for axis in (0, 1):
        both = along(both, axis, shape, side, lambda x, _, a=axis: np.fft.fft(x, axis=a + 1))
    new = along(both, 2, shape, side, turn)
    for axis in (1, 0):
        new = along(new, axis, shape, side, lambda x, _, a=axis: np.fft.ifft(x, axis=a + 1))
    return cells(new, shape, side).select("i", "j", "k", F.col("re").alias("v"))
