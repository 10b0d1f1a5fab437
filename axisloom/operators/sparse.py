"""Sparse matrices as coordinates (i, j, v), unique on (i, j); rows or columns in order on demand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axisloom.operators.ragged import prefix_sum


def coo(df: DataFrame, i: str, j: str, v: str) -> DataFrame:
    """Coordinates from entries that may repeat: equal cells add up."""
    return df.groupBy(F.col(i).cast("long").alias("i"), F.col(j).cast("long").alias("j")).agg(F.sum(v).alias("v"))


def from_parts(starts: DataFrame, minor: DataFrame, major: str = "i", other: str = "j") -> DataFrame:
    """Coordinates of compressed parts: ``starts`` (major, start, stride) and ``minor`` (flat, index, v)."""
    spans = starts.where("stride > 0").select(F.col(major), F.explode(F.expr("sequence(start, start + stride - 1)")).alias("flat"))
    return spans.join(minor, "flat").select(major, F.col("index").alias(other), "v")


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def nnz(a: DataFrame) -> DataFrame:
    return a.agg(F.count("*").alias("nnz"))


def major_counts(a: DataFrame, n: int, major: str = "i") -> DataFrame:
    """``major``, ``stride``: stored entries of every row (or column) from 0 to n - 1."""
    every = a.sparkSession.range(n).select(F.col("id").alias(major))
    return every.join(a.groupBy(major).agg(F.count("*").alias("stride")), major, "left").select(major, F.coalesce("stride", F.lit(0)).alias("stride"))


def starts(a: DataFrame, n: int, major: str = "i") -> DataFrame:
    """``major``, ``stride``, ``start``: the offsets of the compressed form."""
    return prefix_sum(major_counts(a, n, major), major, "stride")


def flat_positions(a: DataFrame, n: int, major: str = "i") -> DataFrame:
    """(i, j, v, flat): the place of every entry in storage by rows, or by columns if major is j.

    Places within a row are counted within that row alone and moved by the row's start.
    """
    from pyspark.sql import Window

    minor = "j" if major == "i" else "i"
    place = F.row_number().over(Window.partitionBy(major).orderBy(minor)) - 1
    return a.withColumn("_p", place).join(starts(a, n, major).select(major, "start"), major).select("i", "j", "v", (F.col("start") + F.col("_p")).cast("long").alias("flat"))


def lookup(a: DataFrame, cells: DataFrame) -> DataFrame:
    """Bulk reads of (i, j): a cell that isn't stored reads as 0."""
    return cells.join(a, ["i", "j"], "left").withColumn("v", F.coalesce("v", F.lit(0).cast(a.schema["v"].dataType)))


def flat_lookup(a: DataFrame, cells: DataFrame, n: int, miss: int = -1) -> DataFrame:
    """Storage places of cells (i, j); ``miss`` where none is stored."""
    return cells.join(flat_positions(a, n).select("i", "j", "flat"), ["i", "j"], "left").withColumn("flat", F.coalesce("flat", F.lit(miss).cast("long")))


def update_stored(a: DataFrame, writes: DataFrame) -> DataFrame:
    """Writes (i, j, v) to stored cells; writes elsewhere are lost, as the pattern is fixed."""
    return a.join(writes.select("i", "j", F.col("v").alias("_new")), ["i", "j"], "left").select("i", "j", F.coalesce("_new", "v").alias("v"))


def to_dense(a: DataFrame, rows: int, cols: int) -> DataFrame:
    """Every cell of the extents, 0 where none is stored. The result has rows * cols rows, so keep it small."""
    spark: SparkSession = a.sparkSession
    cells = spark.range(rows * cols).select(F.expr(f"id div {cols}").alias("i"), (F.col("id") % cols).alias("j"))
    return lookup(a, cells)


def from_dense(cells: DataFrame) -> DataFrame:
    return cells.where("v <> 0").select("i", "j", "v")


def spmv(a: DataFrame, x: DataFrame, y: str = "y") -> DataFrame:
    """``i``, ``y``: the products of rows that have entries, with x (j, x). Sums combine before the shuffle."""
    return a.join(x, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias(y))


def spmm(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product of two coordinate matrices."""
    right = b.select(F.col("i").alias("k"), F.col("j").alias("_j"), F.col("v").alias("_w"))
    return a.withColumnRenamed("j", "k").join(right, "k").groupBy("i", F.col("_j").alias("j")).agg(F.sum(F.col("v") * F.col("_w")).alias("v"))


def scale(a: DataFrame, by: float) -> DataFrame:
    return a.withColumn("v", F.col("v") * by)


def add(a: DataFrame, b: DataFrame, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """alpha * a + beta * b on the union of their patterns."""
    both = a.select("i", "j", (F.col("v") * alpha).alias("v")).unionByName(b.select("i", "j", (F.col("v") * beta).alias("v")))
    return both.groupBy("i", "j").agg(F.sum("v").alias("v"))
