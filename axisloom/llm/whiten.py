"""Whitening of embeddings by a tree of QR factorizations.

Vectors are taken as integers: an entry c becomes floor(64 * c) + 1000000. The fit list holds each distinct vector
once. Its sums are exact, so rows are centred with one rounding; every task reduces its centred rows to one
triangular factor, factors are merged in a tree, and the singular values and right vectors of the last one give the
spread and the directions. No covariance is formed: its condition would be the square of that of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisloom.llm import common

SCALE, SHIFT = 64, 1_000_000
#: Factors merged by one task, and at the end by the driver.
FAN = 8


@dataclass
class Whitening:
    """What was learnt: exact sums as quotient and remainder by ``n``, directions as rows, and their variances."""

    n: int
    quotient: np.ndarray
    remainder: np.ndarray
    directions: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, rounded once."""
        return (x - self.quotient).astype(np.float64) - self.remainder / self.n

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.directions.T / np.sqrt(self.variances)

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Sum over dimensions of (n * x - S)^2, exact; more than a long holds is an error."""
        off = x - self.quotient
        most = self.n * (int(np.abs(off).max(initial=0)) + 1)
        if most * most * max(1, x.shape[1]) < 1 << 63:
            return ((off * self.n - self.remainder) ** 2).sum(axis=1)
        exact = [sum((int(a) * self.n - int(b)) ** 2 for a, b in zip(row, self.remainder, strict=True)) for row in off]
        if any(v >= 1 << 63 for v in exact):
            raise OverflowError("a deviation doesn't fit into a long")
        return np.array(exact, np.int64)


def _integers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(usable rows, their lengths, all their entries as integers) of a list column."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values
    data = values.to_numpy(zero_copy_only=False).astype(np.float64)
    bad = ~np.isfinite(data)  # nulls come as NaN
    sums = np.concatenate([[0], np.cumsum(bad)])
    n = np.diff(offsets)
    ok = (sums[offsets[1:]] == sums[offsets[:-1]]) & (n > 0) & column.is_valid().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(ok)
    taken = np.zeros(len(data) + 1, np.int64)
    np.add.at(taken, offsets[:-1][rows], 1)
    np.add.at(taken, offsets[1:][rows], -1)
    x = np.floor(data[np.cumsum(taken[:-1]) > 0] * SCALE)
    if np.abs(x).max(initial=0) >= 1 << 61:
        raise OverflowError("an entry is too large for an integer vector")
    return rows, n[rows], x.astype(np.int64) + SHIFT


def _vectors(df: DataFrame, vector: str, key: str | None) -> DataFrame:
    """``x``, little-endian longs, beside ``vec_id`` if there is a key; unusable vectors are left out."""
    common.bounded_batches(df.sparkSession)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, n, x = _integers(batch.column("v"))
            off = np.concatenate([[0], np.cumsum(n)]) * 8
            packed = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(x.astype("<i8"))])
            kept = [batch.column("vec_id").take(pa.array(rows))] if key else []
            yield pa.RecordBatch.from_arrays([*kept, packed], names=[*(["vec_id"] if key else []), "x"])

    kind = f"vec_id {df.schema[key].dataType.simpleString()}, " if key else ""
    cols = [F.col(f"`{key}`").alias("vec_id")] if key else []
    return df.select(*cols, F.col(f"`{vector}`").alias("v")).mapInArrow(step, f"{kind}x binary")


def _matrix(column: pa.Array) -> np.ndarray:
    """The rows of a binary column of equal lengths."""
    data, off = common.text_buffers(column)
    return np.frombuffer(data[off[0] : off[-1]].tobytes(), "<i8").reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _sums(fit_list: DataFrame) -> tuple[int, list[int]]:
    """(rows, sum by dimension), exact: a task adds its own rows, Spark the tasks' sums."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"))
            small = int(np.abs(x).max()) * len(x) < 1 << 62
            part = [int(v) for v in (x.sum(axis=0) if small else x.astype(object).sum(axis=0))]
            total = part if total is None else [a + b for a, b in zip(total, part, strict=True)]
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(total)), pa.int32()), pa.array([Decimal(v) for v in [n, *total]], pa.decimal128(28, 0))], names=["dim", "s"])

    found = {r.dim: int(r.s) for r in fit_list.mapInArrow(step, "dim int, s decimal(28,0)").groupBy("dim").agg(F.sum("s").alias("s")).collect()}
    return found.pop(-1, 0), [found[d] for d in range(len(found))]


def _upper(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def _packed(r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.astype("<f8").tobytes()], pa.binary())], names=["r"])


def _merge(d: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for raw in batch.column("r").to_pylist():
                r = np.frombuffer(raw, "<f8").reshape(-1, d)
                held = r if held is None else _upper(np.vstack([held, r]))
        if held is not None:
            yield _packed(held)

    return step


def fit(df: DataFrame, vector: str = "embedding", most: int = 16) -> Whitening | None:
    """Learn the first ``most`` directions from the distinct usable vectors of ``df``; None if there are none.

    Vectors that are null, empty or hold a null or a number that isn't finite take no part. Of vectors of several
    lengths those of the length that most distinct ones have (the greatest of such lengths) are learnt. Directions
    along which the fit list doesn't vary, to double precision, are left out, so there may be fewer than ``most``.
    What reaches the driver is bounded by the dimensions alone: sums, ``FAN`` factors, and products of the directions.
    """
    fit_list = common.written(_vectors(df, vector, None).distinct(), "vectors")
    top = fit_list.groupBy(F.length("x").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    if top is None:
        common.dropped(fit_list)
        return None
    d = top["size"] // 8
    same = fit_list.where(F.length("x") == top["size"])
    n, total = _sums(same)
    split = [divmod(s, n) for s in total]
    model = Whitening(n, np.array([q for q, _ in split], np.int64), np.array([r for _, r in split], np.int64), np.zeros((0, d)), np.zeros(0), 0.0)

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, d))
        for batch in batches:
            if batch.num_rows:
                held = _upper(np.vstack([held, model.centred(_matrix(batch.column("x")))]))
        if len(held):
            yield _packed(held)

    factors = common.written(same.mapInArrow(leaf, "r binary"), "factors")
    while (count := factors.count()) > FAN:
        merged = common.written(factors.repartition(-(-count // FAN)).mapInArrow(_merge(d), "r binary"), "factors")
        common.dropped(factors)
        factors = merged
    last = _upper(np.vstack([np.frombuffer(bytes(r.r), "<f8").reshape(-1, d) for r in factors.collect()]))
    common.dropped(factors)
    _, s, v = np.linalg.svd(last)
    model.trace = float((s**2).sum() / n)
    keep = np.flatnonzero(s > s[0] * d * np.finfo(np.float64).eps)[:most] if s[0] > 0 else np.zeros(0, np.int64)
    v = v[keep]
    # either sign is right; the entry of largest size is made positive, so that runs agree
    model.directions = v * np.sign(np.take_along_axis(v, np.abs(v).argmax(axis=1)[:, None], axis=1)) if len(keep) else v
    model.variances = s[keep] ** 2 / n
    model.identity_error = _identity_error(same, model)
    common.dropped(fit_list)
    return model


def _identity_error(fit_list: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity."""
    k = len(model.variances)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((k + 1, k + 1))
        for batch in batches:
            if batch.num_rows:
                w = model.project(_matrix(batch.column("x")))
                w = np.hstack([w, np.ones((len(w), 1))])
                gram += w.T @ w
        i, j = np.nonzero(np.triu(np.ones_like(gram, bool)))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(gram[i, j])], names=["i", "j", "g"])

    if not k:
        return 0.0
    rows = fit_list.mapInArrow(step, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).collect()
    gram = np.zeros((k + 1, k + 1))
    for r in rows:
        gram[r.i, r.j] = gram[r.j, r.i] = r.g
    mean = gram[:k, k] / model.n
    return float(np.abs(gram[:k, :k] / model.n - np.outer(mean, mean) - np.eye(k)).max())


def whitened(df: DataFrame, model: Whitening | None, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``vec_id``, ``deviation`` (exact) and ``whitened``, an array by component, for each usable vector of the fitted length.

    Repeated rows and null keys are kept, columns beside key and vector aren't. Without a model there are no rows.
    """
    kind = df.schema[key].dataType.simpleString()
    schema = f"vec_id {kind}, deviation long, whitened array<double>"
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    size = 8 * len(model.quotient)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x")).reshape(batch.num_rows, size // 8)
            w = model.project(x)
            off = pa.array(np.arange(len(x) + 1, dtype=np.int32) * w.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(model.deviation(x)), pa.ListArray.from_arrays(off, pa.array(w.ravel()))], names=["vec_id", "deviation", "whitened"])

    return _vectors(df, vector, key).where(F.length("x") == size).mapInArrow(step, schema)


def whitening_report(df: DataFrame, vector: str = "embedding", key: str = "vec_id", most: int = 16) -> DataFrame:
    """One row for each usable vector and component, numbered from 1 by falling variance."""
    model = fit(df, vector, most)
    rows = whitened(df, model, vector, key).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    shares = (model.variances / model.trace).tolist() if model is not None else []
    explained = F.element_at(F.array(*map(F.lit, shares)), F.col("at") + 1) if shares else F.lit(None).cast("double")
    return rows.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation", "whitened",
        explained.alias("explained"), F.lit(model.identity_error if model else 0.0).alias("identity_error"),
    )
