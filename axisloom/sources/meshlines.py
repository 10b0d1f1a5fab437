"""Legacy VTK files (ASCII, unstructured grid) read by many tasks, with their point and cell values.

Spark cuts a file at byte ranges, and a line belongs to the range that it begins in. Each range is numbered on its own:
its lines of numbers, the numbers before each, and the heading above each. One row for each range (what it holds and its
last heading) is then summed over the ranges before it, so every line knows its section and its place there, wherever it
was read. No task needs more of a file than one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from axisloom.operators.iterate import written
from axisloom.sources.vtk import HEX_ORDER

#: Components of a value by its heading; SCALARS name their own number. Fixed values.
COMPONENTS = {"VECTORS": 3, "NORMALS": 3}


def place_lines(spark: SparkSession, path: str, parts: bool = False) -> DataFrame:
    """Lines of numbers: ``file``, ``words``, ``section`` (the heading's words), ``at`` and ``row``, and ``of``.

    ``at`` counts the numbers before the line in its section, ``row`` the lines; ``of`` is POINT_DATA or CELL_DATA, the
    last of the two above. A line whose first word begins with a letter is a heading, but for nan, inf and for
    LOOKUP_TABLE with a name alone, which stands between a heading and its numbers. Blank lines count for nothing.
    With ``parts`` the files of a folder are one, in the order of their names, as ``vtk.write_mesh`` leaves them.
    """
    name = F.col("_metadata.file_path")
    file, at = (F.regexp_replace(name, "/[^/]*$", ""), F.regexp_extract(name, "[^/]*$", 0)) if parts else (name, F.lit(""))
    raw = spark.read.text(path).select(
        file.alias("file"), F.struct(at.alias("name"), F.col("_metadata.file_block_start").alias("at")).alias("range"), F.monotonically_increasing_id().alias("line"),
        F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("words"),
    )
    first = F.col("words")[0]
    number = first.rlike(r"^([-+.]?[0-9]|[-+.]?\.[0-9]|[-+]?(?i:nan|inf(inity)?)$)")
    heading = ~number & (first != "") & ~((first == "LOOKUP_TABLE") & (F.size("words") == 2))
    here = Window.partitionBy("file", "range").orderBy("line")
    before, up_to = here.rowsBetween(Window.unboundedPreceding, -1), here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    zero = F.lit(0).cast("long")
    own = raw.withColumns({"n": F.when(number, F.size("words")).otherwise(0).cast("long"), "one": number.cast("int").cast("long"), "heading": heading})
    own = own.withColumns({"at": F.coalesce(F.sum("n").over(before), zero), "row": F.coalesce(F.sum("one").over(before), zero)})
    own = own.withColumns({"mark": F.when(F.col("heading"), F.struct("words", "at", "row")), "of": F.when(first.isin("POINT_DATA", "CELL_DATA"), first)})
    own = own.withColumns({"under": F.last("mark", True).over(up_to), "of": F.last("of", True).over(up_to)})
    own = written(own.select("file", "range", "line", "words", "n", "one", "at", "row", "under", "of"))
    # one row for each range of a file
    ends = own.groupBy("file", "range").agg(F.sum("n").alias("n"), F.sum("one").alias("one"), F.max_by("under", "line").alias("under"), F.max_by("of", "line").alias("of"))
    earlier = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumns({"at0": F.coalesce(F.sum("n").over(earlier), zero), "row0": F.coalesce(F.sum("one").over(earlier), zero)})
    ends = ends.withColumn("under", _moved(F.col("under"), F.col("at0"), F.col("row0")))
    ends = written(ends.select("file", "range", "at0", "row0", F.last("under", True).over(earlier).alias("under0"), F.last("of", True).over(earlier).alias("of0")))
    both = own.where("one = 1").join(ends, ["file", "range"])
    under = F.coalesce(_moved(F.col("under"), F.col("at0"), F.col("row0")), F.col("under0"))
    both = both.select("file", "words", under.alias("under"), (F.col("at0") + F.col("at")).alias("at"), (F.col("row0") + F.col("row")).alias("row"), F.coalesce("of", "of0").alias("of"))
    return both.where("under is not null").select("file", "words", F.col("under.words").alias("section"), (F.col("at") - F.col("under.at")).alias("at"), (F.col("row") - F.col("under.row")).alias("row"), "of")


def _moved(mark: Column, at: Column, row: Column) -> Column:
    """A heading counted from its range's begin, counted from the file's."""
    return F.when(mark.isNotNull(), F.struct(mark["words"].alias("words"), (mark["at"] + at).alias("at"), (mark["row"] + row).alias("row")))


def _numbers(lines: DataFrame, *more: str) -> DataFrame:
    """Each number with ``k``, its place in the section."""
    return lines.select("file", "at", *more, F.posexplode("words").alias("pos", "v")).select("file", *more, (F.col("at") + F.col("pos")).alias("k"), F.col("v").cast("double").alias("v"))


def nodes(lines: DataFrame) -> DataFrame:
    """``file``, ``node``, ``x``, ``y``, ``z`` from :func:`place_lines`; a point's numbers may lie on several lines.

    A section that holds another number of points than its heading says is an error.
    """
    own = lines.where(F.col("section")[0] == "POINTS").withColumn("n", F.col("section")[1].cast("long"))
    whole = F.when(F.col("k") < 3 * F.col("n"), F.expr("k div 3")).otherwise(F.raise_error(F.lit("more numbers than points have")))
    part = lambda c: F.max(F.when(F.col("k") % 3 == c, F.col("v")))
    found = _numbers(own, "n").groupBy("file", "n", whole.alias("node")).agg(*(part(c).alias(name) for c, name in enumerate("xyz")), F.count("*").alias("got"))
    # the last point can only be whole if all before it are
    full = F.when(F.col("got") == 3, F.col("z")).otherwise(F.raise_error(F.lit("a point lacks numbers")))
    return found.select("file", "node", "x", "y", full.alias("z"))


def incidence(lines: DataFrame) -> DataFrame:
    """``file``, ``elem``, ``lid``, ``node`` from :func:`place_lines`; eight corners are a hexahedron, put in the order of the mesh operators.

    A cell stands on a line of its own, its number of corners first; a line that holds another number of corners is an error.
    """
    own = lines.where(F.col("section")[0] == "CELLS")
    size = F.col("words")[0].cast("long")
    corners = F.when(F.size("words") == size + 1, F.slice("words", 2, F.size("words") - 1)).otherwise(F.raise_error(F.lit("a cell isn't a line of its own")))
    flat = own.select("file", F.col("row").alias("elem"), size.alias("size"), F.posexplode(corners).alias("pos", "node"))
    # the order of a hexahedron's corners is its own inverse
    lid = F.when(F.col("size") == 8, F.try_element_at(F.array(*map(F.lit, HEX_ORDER)), F.col("pos") + 1)).otherwise(F.col("pos"))
    return flat.select("file", "elem", lid.cast("int").alias("lid"), F.col("node").cast("long").alias("node"))


def values(lines: DataFrame) -> DataFrame:
    """``file``, ``of`` (POINT_DATA, CELL_DATA), ``name``, ``id``, ``component``, ``v`` of SCALARS, VECTORS and NORMALS from :func:`place_lines`."""
    kind = F.col("section")[0]
    own = lines.where(kind.isin("SCALARS", *COMPONENTS)).withColumn("name", F.col("section")[1])
    size = F.coalesce(F.try_element_at("section", F.lit(4)).cast("long"), F.lit(1).cast("long"))
    for name, n in COMPONENTS.items():
        size = F.when(kind == name, F.lit(n).cast("long")).otherwise(size)
    own = own.withColumn("size", size)
    return _numbers(own, "of", "name", "size").select("file", "of", "name", F.expr("k div size").alias("id"), (F.col("k") % F.col("size")).cast("int").alias("component"), "v")
