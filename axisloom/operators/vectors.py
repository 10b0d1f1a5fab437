"""Vectors and multi-vectors: (key, one column for each vector)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def combine(x: DataFrame, y: DataFrame, key: str, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """alpha * x + beta * y on equal keys; x and y have a column v."""
    other = y.select(key, F.col("v").alias("_w"))
    return x.join(other, key).select(key, (F.col("v") * alpha + F.col("_w") * beta).alias("v"))


def scale(x: DataFrame, by: float) -> DataFrame:
    return x.withColumn("v", F.col("v") * by)


def multiply(x: DataFrame, y: DataFrame, key: str) -> DataFrame:
    return x.join(y.select(key, F.col("v").alias("_w")), key).select(key, (F.col("v") * F.col("_w")).alias("v"))


def reciprocal(x: DataFrame) -> DataFrame:
    """1 / v with IEEE results at 0: signs of zero aside, infinity; NaN stays."""
    return x.withColumn("v", F.when(F.col("v") == 0, F.lit(float("inf"))).otherwise(1 / F.col("v")))


def dot(x: DataFrame, y: DataFrame, key: str) -> DataFrame:
    return x.join(y.select(key, F.col("v").alias("_w")), key).agg(F.coalesce(F.sum(F.col("v") * F.col("_w")), F.lit(0.0)).alias("dot"))


def norms(x: DataFrame) -> DataFrame:
    """``norm1``, ``norm2``, ``norm_inf`` and ``mean`` in one pass; 0 over no rows."""
    zero = F.lit(0.0)
    return x.agg(
        F.coalesce(F.sum(F.abs("v")), zero).alias("norm1"), F.sqrt(F.coalesce(F.sum(F.col("v") * F.col("v")), zero)).alias("norm2"),
        F.coalesce(F.max(F.abs("v")), zero).alias("norm_inf"), F.coalesce(F.avg("v"), zero).alias("mean"),
    )


def put_scalar(x: DataFrame, value: float) -> DataFrame:
    return x.withColumn("v", F.lit(value))


def replace_values(x: DataFrame, writes: DataFrame, key: str) -> DataFrame:
    return x.join(writes.select(key, F.col("v").alias("_w")), key, "left").select(key, F.coalesce("_w", "v").alias("v"))


def sum_into(x: DataFrame, more: DataFrame, key: str) -> DataFrame:
    return x.select(key, "v").unionByName(more.select(key, "v")).groupBy(key).agg(F.sum("v").alias("v"))
