"""Scalar functions that bodies use and Spark lacks, and rules by region."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axisloom.operators.loops import index_space


@F.pandas_udf(T.DoubleType())
def erf(x: pd.Series) -> pd.Series:
    """The error function, element by element."""
    return pd.Series(np.frompyfunc(math.erf, 1, 1)(x.to_numpy(float)).astype(float))


def divide(a: Column, b: Column) -> Column:
    """IEEE division: infinities and NaN where b is 0."""
    a, b = a.cast("double"), b.cast("double")
    by_zero = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    return F.when(b != 0, a / b).otherwise(by_zero)


def assign_regions(df: DataFrame, key: str, at: str, regions: list[tuple[int, float, float, float]]) -> DataFrame:
    """``key``, ``v``: of the regions (number, lo, hi, value), closed on both ends, that hold ``at`` the last one's value."""
    value = F.lit(None).cast("double")
    for _, lo, hi, v in sorted(regions):
        value = F.when(F.col(at).between(lo, hi), F.lit(v)).otherwise(value)
    return df.select(key, value.alias("v"))


def shape_area(kind: Column, a: Column, b: Column) -> Column:
    """Area by kind of shape: circle by radius, square by side, triangle by base and height."""
    return F.when(kind == "circle", F.lit(math.pi) * a * a).when(kind == "square", (a * a).cast("double")).when(kind == "triangle", 0.5 * a * b)


def halfspace_cooling(spark: SparkSession, depths: int, ages: int, surface: float = 0.0, mantle: float = 1350.0, diffusivity: float = 1e-6, dz: float = 5000.0, dt: float = 1e7, close: float = 0.995) -> DataFrame:
    """(age, pos, t): for each age a ragged column of temperatures down to the first within ``close`` of the mantle's.

    t = surface + (mantle - surface) * erf(z / (2 * sqrt(diffusivity * age))); ages in years of 365 days.
    """
    cells = index_space(spark, (1, ages + 1), (0, depths)).toDF("age", "pos")
    seconds = F.col("age") * dt * 365.0 * 86400.0
    t = surface + (mantle - surface) * erf(F.col("pos") * dz / (2 * F.sqrt(diffusivity * seconds)))
    hot = cells.withColumn("t", t)
    last = hot.where(F.col("t") >= close * mantle).groupBy("age").agg(F.min("pos").alias("last"))
    return hot.join(last, "age", "left").where(F.col("last").isNull() | (F.col("pos") <= F.col("last"))).select("age", "pos", "t")


def split(text: Column, delimiter: str) -> Column:
    """The pieces of a text between occurrences of a literal delimiter, empty ones included; null for null."""
    if not delimiter:
        raise ValueError("a delimiter has a character at least")
    return F.split(text, "".join(f"\\x{{{ord(c):x}}}" for c in delimiter), -1)


def extract_list(text: Column) -> Column:
    """The numbers of a list written as ``[a, b, ...]``.

    Of each piece between commas the decimal number that it begins with counts; a piece that begins with none gives 0,
    an empty list one 0. Null for null.
    """
    words = split(F.translate(text, "[]", "  "), ",")

    def number(word: Column) -> Column:
        found = F.regexp_extract(word, r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1)
        return F.when(found == "", F.lit(0.0)).otherwise(found.cast("double"))

    return F.transform(words, number)
