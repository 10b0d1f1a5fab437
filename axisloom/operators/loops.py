"""Index spaces: loops as generators, bodies as column expressions.

A half-open (``inclusive=False``) or closed range per dimension gives the rows of a nest; a body is what is
selected over them. A nest of several ranges is one flat range split by ``div`` and ``%``, so it is
generated in parallel without any join. Inner bounds that depend on outer indices go through ``nested``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def extent(lo: int, hi: int, step: int = 1, inclusive: bool = False) -> int:
    """Iterations of one loop; none where it is empty."""
    if step <= 0:
        raise ValueError("steps are positive")
    return max(0, -(-(hi + inclusive - lo) // step))


def index_space(spark: SparkSession, *ranges: tuple[int, ...], names: str = "ijklmno", inclusive: bool = False) -> DataFrame:
    """Rows of a nest of up to seven ranges (lo, hi[, step]), the first outermost."""
    if not 1 <= len(ranges) <= 7:
        raise ValueError("one to seven ranges")
    loops = [(r[0], r[2] if len(r) > 2 else 1, extent(*r, inclusive=inclusive)) for r in ranges]
    total = 1
    for *_, n in loops:
        total *= n
    cols, rest = [], total
    for (lo, step, n), name in zip(loops, names, strict=False):
        rest = rest // n if n else 0
        at = F.expr(f"(id div {max(rest, 1)}) % {max(n, 1)}") if len(loops) > 1 else F.col("id")
        cols.append((F.lit(lo).cast("long") + at * step).cast("long").alias(name))
    return spark.range(total).select(*cols)


def bounds(df: DataFrame, index: str) -> tuple[int, int]:
    """Half-open bounds (lo, hi) of the loop over an index column; (0, 0) over no rows or nulls alone."""
    lo, hi = df.agg(F.min(index), F.max(index)).first()
    return (0, 0) if lo is None else (int(lo), int(hi) + 1)


def nested(df: DataFrame, name: str, lo: Column | int, hi: Column | int, inclusive: bool = False, step: int = 1) -> DataFrame:
    """One more level whose bounds may use outer indices; an empty inner range yields no row.

    Each outer row makes its own inner indices, so no join or shuffle is needed. Null bounds make an empty range.
    """
    if step <= 0:
        raise ValueError("steps are positive")
    low, high = (F.lit(x) if isinstance(x, int) else x for x in (lo, hi))
    last = high.cast("long") - (0 if inclusive else 1)
    return df.where(low <= last).withColumn(name, F.explode(F.sequence(low.cast("long"), last, F.lit(step).cast("long"))))


def strided(df: DataFrame, index: str, lo: int, hi: int, step: int, inclusive: bool = False) -> DataFrame:
    """The rows that a strided loop over an index column visits."""
    c = F.col(index)
    return df.where((c >= lo) & ((c <= hi) if inclusive else (c < hi)) & ((c - lo) % step == 0))


def run(spark: SparkSession, **values: Column) -> DataFrame:
    """A body that runs once."""
    return spark.range(1).select(*(v.alias(k) for k, v in values.items()))
