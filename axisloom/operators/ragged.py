"""Ragged arrays: rows of different length, in long form (row, pos, v) or packed (row, vals)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys in a block of the two-level prefix sum.
SCAN_BLOCK = 1 << 16
#: Components of a slot that are aggregated each on its own.
FEW_CELLS = 16


def prefix_sum(df: DataFrame, key: str, value: str, name: str = "start", block: int = SCAN_BLOCK) -> DataFrame:
    """Exclusive running sum of ``value`` by ascending unique long ``key``, in two levels.

    Sums of blocks of keys are scanned first (one row for each block), then every block on its own, in
    parallel; no window ever holds the whole table.
    """
    at = F.call_function("div", F.col(key) - F.pmod(F.col(key), F.lit(block)), F.lit(block))
    blocked = df.withColumn("_block", at)
    sums = blocked.groupBy("_block").agg(F.sum(value).alias("_sum"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_block").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    out = blocked.join(base, "_block").withColumn(name, (F.col("_base") + F.coalesce(F.sum(value).over(within), F.lit(0))).cast("long"))
    return out.drop("_block", "_base")


def with_positions(df: DataFrame, row: str, order: list[str | Column], name: str = "pos") -> DataFrame:
    """Slots of the elements of each row, from 0, in the given order."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(row).orderBy(*order)) - 1).cast("long"))


def strides(rows: DataFrame, elements: DataFrame, row: str) -> DataFrame:
    """``row``, ``stride``: lengths of all rows, 0 for the empty ones. ``rows`` holds every row once."""
    count = elements.groupBy(row).agg(F.count("*").alias("stride"))
    return rows.select(row).join(count, row, "left").select(row, F.coalesce("stride", F.lit(0)).cast("long").alias("stride"))


def offsets(rows: DataFrame, elements: DataFrame, row: str) -> DataFrame:
    """``row``, ``stride``, ``start``: where each row begins in the flat storage."""
    return prefix_sum(strides(rows, elements, row), row, "stride")


def pack(elements: DataFrame, row: str, pos: str, value: str) -> DataFrame:
    """``row``, ``vals``: values in the order of their slots."""
    return elements.groupBy(row).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(value).alias("x")))), lambda s: s.x).alias("vals"))


def unpack(packed: DataFrame, row: str, vals: str = "vals") -> DataFrame:
    """(row, pos, v) of a packed array; rows without elements have none."""
    return packed.select(row, F.posexplode(vals).alias("pos", "v"))


def access(elements: DataFrame, row: str, at: DataFrame) -> DataFrame:
    """Bulk reads: ``at`` (row, pos) gets ``v``, or null where pos isn't below the row's length."""
    return at.join(elements.select(row, "pos", "v"), [row, "pos"], "left")


def set_values_sparse(cells: DataFrame, lengths: DataFrame, row: str, value: float) -> DataFrame:
    """Fill the live part (pos < stride) of a dense buffer (row, pos, v); what lies behind keeps its value."""
    live = cells.join(lengths.select(row, "stride"), row, "left")
    return live.select(row, "pos", F.when(F.col("pos") < F.coalesce("stride", F.lit(0)), F.lit(value)).otherwise(F.col("v")).alias("v"))


def pack_down(elements: DataFrame, col: str = "col", pos: str = "pos", value: str = "v") -> DataFrame:
    """``col``, ``vals`` of an array whose columns differ in length: the values down each column in the order of their slots."""
    return pack(elements, col, pos, value)


def pack_vectors(elements: DataFrame, row: str, pos: str, dims: list[str], value: str, sizes: list[int]) -> DataFrame:
    """``row``, ``vals``: for each slot of a row its vector (one dimension) or tensor (more), flat with the last running fastest.

    ``sizes`` gives the length of every dimension; a component that isn't there reads as 0, one beyond or given twice fails.
    """
    flat, total = F.lit(0).cast("long"), 1
    for d, n in zip(dims, sizes, strict=True):
        inside = F.col(d).between(0, n - 1)
        flat, total = flat * n + F.when(inside, F.col(d)).otherwise(F.raise_error(F.lit(f"{d} is beyond {n}"))), total * n
    if total <= FEW_CELLS:
        # a value for each component: these are added up by hashing, while lists would be sorted and spilled
        placed = elements.select(row, pos, flat.alias("_k"), F.col(value).alias("_x"))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_k").cast("int"))
        cells = [F.max(F.when(F.col("_k") == k, F.col("_x"))).alias(f"_{k}") for k in range(total)]
        slot = placed.groupBy(row, pos).agg(*cells, F.sum(bit).alias("_sum"), F.bit_or(bit).alias("_or"))
        x = F.array(*(F.coalesce(f"_{k}", F.lit(0.0)) for k in range(total)))
        slot = slot.withColumn("x", F.when(F.col("_sum") == F.col("_or"), x).otherwise(F.raise_error(F.lit("a component is there twice"))))
    else:
        slot = elements.groupBy(row, pos).agg(F.map_from_entries(F.collect_list(F.struct(flat.alias("k"), F.col(value).alias("x")))).alias("m"))
        slot = slot.withColumn("x", F.transform(F.sequence(F.lit(0).cast("long"), F.lit(total - 1).cast("long")), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0))))
    return slot.groupBy(row).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), "x"))), lambda s: s.x).alias("vals"))


def append(elements: DataFrame, more: DataFrame, row: str, capacity: int | None = None) -> DataFrame:
    """``more`` (row, ord, v) behind what each row holds, in the order of ``ord``; a slot at or beyond ``capacity`` fails.

    With columns in place of rows it is the same for an array whose columns grow.
    """
    length = elements.groupBy(row).agg(F.count("*").alias("_n"))
    placed = with_positions(more, row, ["ord"]).join(length, row, "left")
    at = F.col("pos") + F.coalesce("_n", F.lit(0))
    if capacity is not None:
        at = F.when(at < capacity, at).otherwise(F.raise_error(F.lit(f"a row holds {capacity} elements at most")))
    return elements.select(row, "pos", "v").unionByName(placed.select(row, at.alias("pos"), "v"))
