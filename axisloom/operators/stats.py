"""Column statistics of a wide table in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def means(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*(F.avg(c).alias(c) for c in columns))


def sample_variances(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*(F.var_samp(c).alias(c) for c in columns))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) for every two columns, 1 on the diagonal: all pairs in one aggregate, then unpivoted."""
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k + 1 :]]
    wide = df.agg(*(F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs))
    cells = [(a, b, F.lit(1.0) if a == b else F.col(f"`{a}|{b}`" if f"{a}|{b}" in wide.columns else f"`{b}|{a}`")) for a in columns for b in columns]
    return wide.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r.alias("r")) for a, b, r in cells))).alias("e")).select("e.*")
