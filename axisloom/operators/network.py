"""Layers of a feed-forward network as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def layer(inputs: DataFrame, weights: DataFrame, biases: DataFrame, repeat_bias: bool = False) -> DataFrame:
    """(row, i, x) through weights (i, j, w) and biases (j, b): ``row``, ``j``, ``y``.

    With ``repeat_bias`` the bias is added once for every input instead of once.
    """
    sums = inputs.join(weights, "i").groupBy("row", "j").agg(F.sum(F.col("x") * F.col("w")).alias("s"), F.count("*").alias("n"))
    b = F.col("b") * F.col("n") if repeat_bias else F.col("b")
    return sums.join(biases, "j").select("row", "j", sigmoid(F.col("s") + b).alias("y"))
