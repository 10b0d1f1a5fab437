"""Dense arrays as relations of index columns and a value, with extents, base and layout beside them."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce as fold

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from axisloom.operators.loops import index_space


def flat_index(indices: list[Column], dims: list[int], layout: str = "C", base: int = 0) -> Column:
    """Offset of a cell: C runs the last index fastest, F the first."""
    pairs = list(zip(indices, dims, strict=True))
    if layout == "F":
        pairs.reverse()
    return fold(lambda at, x: at * x[1] + (x[0] - base), pairs, F.lit(0).cast("long"))


def unflatten(flat: Column, dims: list[int], layout: str = "C", base: int = 0) -> list[Column]:
    """Indices of an offset, in the order of ``dims``."""
    out: list[Column] = []
    stride = 1
    order = list(enumerate(dims))
    for d, n in reversed(order) if layout == "C" else order:
        out.append((d, F.call_function("div", flat, F.lit(stride)) % n + base))
        stride *= n
    return [c for _, c in sorted(out, key=lambda x: x[0])]


@dataclass(frozen=True)
class DenseArray:
    """``df`` has index columns ``names`` and a value ``v``; indices start at ``base``."""

    df: DataFrame
    dims: tuple[int, ...]
    base: int = 0
    layout: str = "C"
    names: tuple[str, ...] = ("i", "j", "k", "l", "m", "n", "o")

    @classmethod
    def filled(cls, spark: SparkSession, dims: tuple[int, ...], body: Column | float = 0.0, base: int = 0, layout: str = "C") -> DenseArray:
        space = index_space(spark, *((base, base + n) for n in dims), names="ijklmno")
        return cls(space.withColumn("v", body if isinstance(body, Column) else F.lit(body)), tuple(dims), base, layout)

    @property
    def order(self) -> int:
        return len(self.dims)

    @property
    def size(self) -> int:
        return fold(lambda a, b: a * b, self.dims, 1)

    @property
    def index(self) -> list[str]:
        return list(self.names[: self.order])

    def flat(self) -> Column:
        return flat_index([F.col(c) for c in self.index], list(self.dims), self.layout, self.base)

    def map(self, body: Column) -> DenseArray:
        return replace(self, df=self.df.select(*self.index, body.alias("v")))

    def set_values(self, value: float) -> DenseArray:
        return self.map(F.lit(value))

    def reshape(self, dims: tuple[int, ...]) -> DenseArray:
        """A view of the same elements under other extents of the same size."""
        if fold(lambda a, b: a * b, dims, 1) != self.size:
            raise ValueError("a reshape keeps the size")
        cells = unflatten(F.col("_flat"), list(dims), self.layout, self.base)
        df = self.df.select(self.flat().alias("_flat"), "v")
        return replace(self, df=df.select(*(c.alias(n) for c, n in zip(cells, self.names, strict=False)), "v"), dims=tuple(dims))

    def view(self, offset: int, dims: tuple[int, ...]) -> DenseArray:
        """A view of neighbouring elements from an offset on."""
        n = fold(lambda a, b: a * b, dims, 1)
        if offset < 0 or offset + n > self.size:
            raise IndexError("the view reaches beyond the array")
        df = self.df.select((self.flat() - offset).alias("_flat"), "v").where(f"_flat between 0 and {n - 1}")
        cells = unflatten(F.col("_flat"), list(dims), self.layout, self.base)
        return replace(self, df=df.select(*(c.alias(m) for c, m in zip(cells, self.names, strict=False)), "v"), dims=tuple(dims))

    def slice(self, **ranges: tuple[int, int]) -> DenseArray:
        """A sub-block by half-open ranges of named indices, moved to the base."""
        df, dims = self.df, list(self.dims)
        for name, (lo, hi) in ranges.items():
            df = df.where((F.col(name) >= lo) & (F.col(name) < hi)).withColumn(name, F.col(name) - lo + self.base)
            dims[self.index.index(name)] = hi - lo
        return replace(self, df=df, dims=tuple(dims))

    def transpose(self) -> DenseArray:
        if self.order != 2:
            raise ValueError("a matrix has two indices")
        return replace(self, df=self.df.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), dims=self.dims[::-1])

    def override(self, cells: DataFrame) -> DenseArray:
        """Written cells (index columns and v) over the old ones; a new array, as tables don't change."""
        new = cells.select(*self.index, F.col("v").alias("_new"))
        df = self.df.join(new, self.index, "left").select(*self.index, F.coalesce("_new", "v").alias("v"))
        return replace(self, df=df)

    def validate(self) -> DenseArray:
        """Raise if an index is out of bounds or a cell is missing or doubled: one aggregate."""
        outside = fold(lambda a, b: a | b, [(F.col(c) < self.base) | (F.col(c) >= self.base + n) for c, n in zip(self.index, self.dims, strict=True)])
        row = self.df.agg(F.count_if(outside).alias("bad"), F.count("*").alias("n"), F.countDistinct(*self.index).alias("cells")).first()
        if row.bad:
            raise IndexError(f"{row.bad} cells are out of bounds")
        if row.n != self.size or row.cells != self.size:
            raise ValueError(f"{row.n} rows and {row.cells} cells for a size of {self.size}")
        return self


@dataclass(frozen=True)
class DynamicArray:
    """``df`` (i, v) with ``length`` live elements of a fixed ``capacity``."""

    df: DataFrame
    capacity: int
    length: int

    def push_back(self, *values: float) -> DynamicArray:
        if self.length + len(values) > self.capacity:
            raise OverflowError("over capacity")
        spark = self.df.sparkSession
        new = spark.createDataFrame([(self.length + k, v) for k, v in enumerate(values)], self.df.schema)
        return replace(self, df=self.df.unionByName(new), length=self.length + len(values))

    def pop_back(self, n: int = 1) -> DynamicArray:
        left = max(0, self.length - n)
        return replace(self, df=self.df.where(F.col("i") < left), length=left)

    def set_values(self, value: float, count: int | None = None) -> DynamicArray:
        n = self.length if count is None else count
        if n > self.capacity:
            raise OverflowError("over capacity")
        kind = self.df.schema["v"].dataType
        return replace(self, df=self.df.sparkSession.range(n).select(F.col("id").alias("i"), F.lit(value).cast(kind).alias("v")), length=n)


def randomize(df: DataFrame, at: list[str], seed: int, low: float = 0.0, high: float = 1.0, v: str = "v") -> DataFrame:
    """``df`` with ``v`` drawn evenly from [low, high) by a hash of the seed and the place, so the same wherever rows lie."""
    share = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *at), 11) / float(1 << 53)
    return df.withColumn(v, F.lit(low) + F.lit(high - low) * share)
