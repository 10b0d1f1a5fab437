"""The nearest neighbours of every point of a cloud, by rings of cells that grow where a point still lacks some.

Cells double their width from round to round; a point looks into its own cell and those that adjoin it. All points no
further away than a cell's width are then seen, so a point whose n-th neighbour lies that near is done, and only the
others look again; the last few are compared with all. Whole cells are put off by counts alone while too few points lie around them. A location that many
points share is searched once and offers its n + 1 least keys, and a cell with many locations is dealt over several
tasks, so neither copies nor dense cells meet in one task.
"""

from __future__ import annotations

from functools import reduce as fold

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axisloom.operators.iterate import saved

#: Locations of a cell that one task compares with those that look into the cell.
CELL_PIECE = 2048
#: Locations left that are compared with all others rather than in more rounds.
FEW = 256
#: Locations in a first cell for each neighbour asked for, and the finest cells as a share of the extent.
FULL_CELL, FINEST = 8, 2.0**40


def _squares(pairs: list[tuple[Column, Column]]) -> Column:
    return fold(lambda a, b: a + b, [(x - y) * (x - y) for x, y in pairs])


def _cells(axes: list[str], width: float) -> list[Column]:
    return [F.floor(F.col(c) / width).alias(f"c{k}") for k, c in enumerate(axes)]


def _around(df: DataFrame, names: list[str]) -> DataFrame:
    """Every row once for its cell and each that adjoins it."""
    for c in names:
        df = df.withColumn(c, F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1)))
    return df


def nearest_neighbors(points: DataFrame, key: str, axes: list[str], n: int, radius: float | None = None, width: float | None = None) -> DataFrame:
    """``a``, ``rank`` (from 1), ``b``, ``d2``: for each point the ``n`` nearest others (all, if there are fewer) and their squared distance.

    Ties go to the smaller key. ``radius`` cuts what lies further away. ``key`` is unique; rows with a null key or
    coordinate, or one that isn't finite, take no part. ``width`` is the greatest that the first cells may have; by
    default it is chosen from the extent so that a cell holds about n / 2 locations on average. Narrower ones are
    taken while a cell holds many times n.
    """
    if n < 1:
        raise ValueError("n is at least 1")
    names = [f"c{k}" for k in range(len(axes))]
    usable = fold(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")) for c in axes], F.col(key).isNotNull())
    clean = points.where(usable).select(F.col(key).alias("a"), *(F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(axes)))
    xs = [f"x{k}" for k in range(len(axes))]
    # at most n + 1 keys of a location can be among the n nearest of anything
    least = Window.partitionBy(*xs).orderBy("a")
    offers = clean.withColumn("r", F.row_number().over(least)).where(F.col("r") <= n + 1).groupBy(*xs).agg(F.sort_array(F.collect_list("a")).alias("keys"))
    places = saved(offers.withColumn("loc", F.struct(*xs)))
    ends = places.agg(F.count("*").alias("n"), F.sum(F.size("keys")).alias("keys"), *(F.min(x).alias(f"lo{x}") for x in xs), *(F.max(x).alias(f"hi{x}") for x in xs)).first()
    schema = f"a {points.schema[key].dataType.simpleString()}, rank int, b {points.schema[key].dataType.simpleString()}, d2 double"
    if not ends.n:
        return points.sparkSession.createDataFrame([], schema)
    sides = [ends[f"hi{x}"] - ends[f"lo{x}"] for x in xs]
    span = max(sides)
    if width is None:
        volume = fold(lambda a, b: a * b, [max(s, span / 1e6) for s in sides], 1.0)
        width = (volume * max(1.0, n / 2) / ends.n) ** (1 / len(xs))
    width = width or 1.0
    # where the cloud is dense cells must be small from the first round on, else all of a cell meets all of it
    while width > span / FINEST and places.groupBy(*_cells(xs, width)).count().agg(F.max("count")).first()[0] > FULL_CELL * (n + 1):
        width /= 16
    reach = span if radius is None else min(span, radius)
    found, asking = [], places.select("loc", *xs, F.lit(None).cast("double").alias("bound"))
    while True:
        last = width >= reach
        cells = places.withColumns({c: v for c, v in zip(names, _cells(xs, width), strict=True)})
        count = cells.groupBy(*names).agg(F.sum(F.size("keys")).alias("keys"), F.count("*").alias("places"))
        count = count.withColumn("pieces", F.ceil(F.col("places") / CELL_PIECE).cast("int"))
        # cells around which too few points lie wait for wider ones
        held = _around(count.select(*names, "keys"), names).groupBy(*names).agg(F.sum("keys").alias("around"))
        ready = held if last else held.where(F.col("around") > n)
        now = asking.withColumns({c: v for c, v in zip(names, _cells(xs, width), strict=True)})
        looks = _around(now.join(ready.select(*names), names, "left_semi"), names).join(count.select(*names, "pieces"), names)
        looks = looks.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        there = cells.join(count.select(*names, F.col("pieces").alias("of")), names).withColumn("piece", F.pmod(F.xxhash64("loc"), F.col("of")).cast("int"))
        there = there.select(*names, "piece", *(F.col(x).alias(f"o{x}") for x in xs), "keys")
        d2 = _squares([(F.col(x), F.col(f"o{x}")) for x in xs])
        pairs = looks.join(there, [*names, "piece"]).withColumn("d2", d2).where("bound is null or d2 <= bound")
        # ranked among locations first: each task keeps n + 1 for a place before rows are moved
        near = Window.partitionBy("loc").orderBy("d2", F.col("keys")[0])
        kept = pairs.select("loc", "d2", "keys").withColumn("r", F.row_number().over(near)).where(F.col("r") <= n + 1)
        offered = kept.select("loc", "d2", F.explode("keys").alias("b")).groupBy("loc").agg(F.slice(F.sort_array(F.collect_list(F.struct("d2", "b"))), 1, n + 1).alias("near"))
        got = saved(offered.withColumn("bound", F.when(F.size("near") > n, F.col("near")[n]["d2"])))
        sure = F.lit(True) if last else F.col("bound").isNotNull() & (F.col("bound") <= width * width)
        found.append(got.where(sure).select("loc", "near"))
        if last:
            break
        bounds = got.where(~sure).select("loc", F.col("bound").alias("new"))
        done = got.where(sure).select("loc")
        asking = saved(asking.join(done, "loc", "left_anti").join(bounds, "loc", "left").withColumn("bound", F.coalesce("new", "bound")).drop("new"))
        left = asking.count()
        if not left:
            break
        # far points would take many rounds: a bounded number of them looks at everything instead
        width = reach if left <= FEW else width * (2 if left * 50 > ends.n else 8)
    lists = fold(lambda a, b: a.unionByName(b), found)
    # every point of a location but itself
    each = clean.select("a", F.struct(*xs).alias("loc")).join(lists, "loc")
    others = F.slice(F.filter("near", lambda s: s["b"] != F.col("a")), 1, n)
    out = each.select("a", F.posexplode(others).alias("at", "s")).select("a", (F.col("at") + 1).cast("int").alias("rank"), F.col("s.b").alias("b"), F.col("s.d2").alias("d2"))
    return out if radius is None else out.where(F.col("d2") <= radius * radius)
