"""Distributed arrays: partition maps, communication plans, ghost rows and all-reduce as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axisloom.operators.reduce import combine


def block_of(gid: Column, n: int, parts: int) -> Column:
    """Contiguous blocks of n global ids: the first n % parts blocks have one more."""
    size, more = divmod(n, parts)
    edge = more * (size + 1)
    small = F.call_function("div", gid - edge, F.lit(max(size, 1))) + more
    return F.when(gid < edge, F.call_function("div", gid, F.lit(size + 1))).otherwise(small).cast("int")


def partition_map(df: DataFrame, gid: str, n: int, parts: int) -> DataFrame:
    """``df`` with ``part`` and ``lid``, the place within the block; no shuffle, as blocks are arithmetic."""
    size, more = divmod(n, parts)
    part = block_of(F.col(gid), n, parts)
    begin = part * size + F.least(part, F.lit(more))
    return df.withColumn("part", part).withColumn("lid", (F.col(gid) - begin).cast("long"))


def extents(mapped: DataFrame, gid: str) -> DataFrame:
    """``part``, ``n``, ``min_gid``, ``max_gid``."""
    return mapped.groupBy("part").agg(F.count("*").alias("n"), F.min(gid).alias("min_gid"), F.max(gid).alias("max_gid"))


def to_local(gids: DataFrame, mapped: DataFrame, gid: str, miss: int = -1) -> DataFrame:
    """Local ids of global ids; ``miss`` where the map has none."""
    return gids.join(mapped.select(gid, "part", "lid"), gid, "left").withColumn("lid", F.coalesce("lid", F.lit(miss).cast("long")))


def to_global(lids: DataFrame, mapped: DataFrame, gid: str) -> DataFrame:
    return lids.join(mapped.select("part", "lid", gid), ["part", "lid"], "left")


def halo_plan(needs: DataFrame, mapped: DataFrame, gid: str) -> DataFrame:
    """``src``, ``dst``, gid for each ghost: ids that ``needs`` (part, gid) asks for and another part owns."""
    owner = mapped.select(gid, F.col("part").alias("src"))
    return needs.select(F.col("part").alias("dst"), gid).distinct().join(owner, gid).where("src <> dst").select("src", "dst", gid)


def exchange(plan: DataFrame, values: DataFrame, gid: str) -> DataFrame:
    """``dst``, gid, ``v``: the ghost values that every part receives."""
    return plan.join(values.select(gid, "v"), gid).select("dst", gid, "v")


def counts_and_displacements(plan: DataFrame, by: str, to: str) -> DataFrame:
    """For each ``by`` part and neighbour: elements and where they begin in its buffer."""
    counts = plan.groupBy(by, to).agg(F.count("*").alias("n"))
    before = Window.partitionBy(by).orderBy(to).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("displ", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long"))


def unmatched(sends: DataFrame, receives: DataFrame, gid: str) -> DataFrame:
    """Entries of one plan that the other lacks; none in a plan that holds."""
    key = ["src", "dst", gid]
    return sends.join(receives, key, "left_anti").select(*key).unionByName(receives.join(sends, key, "left_anti").select(*key))


def all_reduce(df: DataFrame, op: str, value: Column, owned: Column | None = None, fixed: dict[str, int] | None = None, kind: str = "double", name: str = "v") -> DataFrame:
    """One value over the owned rows of all parts, with trailing indices held fixed."""
    for c, x in (fixed or {}).items():
        df = df.where(F.col(c) == x)
    return (df if owned is None else df.where(owned)).agg(combine(op, value, kind).alias(name))


def reverse(target: DataFrame, incoming: DataFrame, gid: str, mode: str) -> DataFrame:
    """Ghost values (src, gid, v) go back to their owners' ``target`` (gid, v).

    sum adds all to what is there; insert and replace put the value of the highest sender, insert also where
    the target has no row; absmax keeps the largest size; zero sets what is sent to 0.
    """
    got = incoming.groupBy(gid).agg(F.sum("v").alias("s"), F.max_by("v", "src").alias("last"), F.max(F.abs("v")).alias("a"))
    both = target.select(gid, "v").join(got, gid, "full_outer" if mode == "insert" else "left")
    new = {
        "sum": F.col("v") + F.coalesce("s", F.lit(0.0)), "insert": F.coalesce("last", "v"), "replace": F.coalesce("last", "v"),
        "absmax": F.greatest(F.abs("v"), F.coalesce("a", F.lit(0.0))), "zero": F.when(F.col("last").isNotNull(), F.lit(0.0)).otherwise(F.col("v")),
    }[mode]
    return both.select(gid, new.alias("v"))


#: Parts that share a word, a bit each.
WORD = 63


def _bits(incidence: DataFrame, part: str) -> DataFrame:
    """(part, _word, _bit): a bit in some word for every part."""
    each = incidence.agg(F.array_sort(F.collect_set(part)).alias("_all")).select(F.posexplode("_all").alias("_k", part))
    return each.select(part, F.expr(f"_k div {WORD}").alias("_word"), F.expr(f"shiftleft(1L, _k % {WORD})").alias("_bit"))


def _touched(incidence: DataFrame, bits: DataFrame, part: str, elem: str, node: str) -> tuple[DataFrame, DataFrame]:
    """(node, _word, _own): the parts that hold a node; (elem, _word, _mask): other parts that hold one of an element's nodes.

    What is shuffled are words of bits, of which an aggregate keeps one for each key: pairs of elements and parts are never made.
    """
    mine = incidence.join(F.broadcast(bits), part).select(elem, node, F.col("_word").alias("_in"), "_bit")  # one row for each part
    own = mine.groupBy(node, F.col("_in").alias("_word")).agg(F.bit_or("_bit").alias("_own"))
    others = F.when(F.col("_word") == F.col("_in"), F.col("_own").bitwiseAND(F.bitwise_not("_bit"))).otherwise(F.col("_own"))
    met = mine.join(own, node).select(elem, "_word", others.alias("_mask")).where("_mask <> 0")
    return own, met.groupBy(elem, "_word").agg(F.bit_or("_mask").alias("_mask"))


def ghost_elements(incidence: DataFrame, part: str = "part", elem: str = "elem", node: str = "node") -> DataFrame:
    """``part``, ``elem``: elements of other parts that touch one of a part's nodes."""
    bits = _bits(incidence, part)
    _, touched = _touched(incidence, bits, part, elem, node)
    return touched.join(F.broadcast(bits), "_word").where("_mask & _bit <> 0").select(part, elem)


def ghost_nodes(incidence: DataFrame, part: str = "part", elem: str = "elem", node: str = "node") -> DataFrame:
    """``part``, ``node``, ``owner``: nodes of a part's ghost elements that none of its own elements has.

    They are received from ``owner``, the highest part that holds such an element.
    """
    bits = _bits(incidence, part)
    own, touched = _touched(incidence, bits, part, elem, node)
    met = incidence.select(elem, node, F.col(part).alias("owner")).join(touched, elem).groupBy(node, "_word", "owner").agg(F.bit_or("_mask").alias("_mask"))
    # a part asks the first owner, from the highest down, that has a ghost element of it there
    higher = Window.partitionBy(node, "_word").orderBy(F.desc_nulls_last("owner")).rowsBetween(Window.unboundedPreceding, -1)
    met = met.withColumn("_asked", F.coalesce(F.bit_or("_mask").over(higher), F.lit(0).cast("long"))).join(own, [node, "_word"], "left")
    new = met.withColumn("_new", F.expr("_mask & ~(_asked | coalesce(_own, 0L))")).where("_new <> 0")
    return new.join(F.broadcast(bits), "_word").where("_new & _bit <> 0").select(part, node, "owner")


def replace_local(mapped: DataFrame, writes: DataFrame) -> DataFrame:
    """``mapped`` (part, lid, v and more) with the values of ``writes`` (part, lid, v) in place; writes to no row are lost.

    Of several writes to one place the greatest value stays.
    """
    new = writes.groupBy("part", "lid").agg(F.max(F.struct(F.lit(1).alias("there"), "v")).alias("_new"))
    both = mapped.join(new, ["part", "lid"], "left")
    return both.withColumn("v", F.when(F.col("_new").isNull(), F.col("v")).otherwise(F.col("_new.v"))).select(*mapped.columns)


def sum_into_local(mapped: DataFrame, more: DataFrame) -> DataFrame:
    """``mapped`` (part, lid, v and more) plus all values of ``more`` (part, lid, v) at their places; those to no row are lost."""
    sums = more.groupBy("part", "lid").agg(F.sum("v").alias("_more"))
    both = mapped.join(sums, ["part", "lid"], "left")
    return both.withColumn("v", F.col("v") + F.coalesce("_more", F.lit(0))).select(*mapped.columns)


def replace_map(mapped: DataFrame, other: DataFrame, gid: str) -> DataFrame:
    """(part, lid, gid, v): the values of ``mapped`` stay at their local places and take the global ids of ``other`` (part, lid, gid).

    The two maps must have the same local places; one that only one of them has is an error.
    """
    both = mapped.select("part", "lid", "v", F.lit(True).alias("_a")).join(other.select("part", "lid", gid, F.lit(True).alias("_b")), ["part", "lid"], "full")
    known = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.col(gid)).otherwise(F.raise_error(F.lit("the maps have different local places")))
    return both.select("part", "lid", known.alias(gid), "v")


def reduce_replicas(copies: DataFrame, key: str, part: str = "part") -> DataFrame:
    """(part, key, v) of a vector that every part holds a copy of: each copy becomes the sum of all. Partial sums are made before the shuffle."""
    sums = copies.groupBy(key).agg(F.sum("v").alias("_sum"))
    return copies.select(part, key).join(sums, key).select(part, key, F.col("_sum").alias("v"))


def balanced_parts(df: DataFrame, parts: int, *coordinates: str) -> DataFrame:
    """Repartition by coordinate ranges of near-equal counts (a geometric partition along the given order)."""
    return df.repartitionByRange(parts, *coordinates)
