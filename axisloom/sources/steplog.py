"""Logs of steps as CSV, such as a run's energy: one folder for each step, so that a step written again replaces itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_steps(rows: DataFrame, path: str, step: str = "step") -> None:
    """Add the steps of ``rows`` to the log; steps that it holds already are replaced, others stay.

    Numbers are written so that they read back as they were.
    """
    rows.write.partitionBy(step).mode("overwrite").option("partitionOverwriteMode", "dynamic").option("header", True).csv(path)


def read_steps(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The log's rows; ``schema`` names all columns and their types, the step's too."""
    return spark.read.schema(schema).option("header", True).csv(path)
