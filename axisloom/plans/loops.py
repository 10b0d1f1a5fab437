"""Loops, reductions and team nests over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from axisloom.operators import loops, reduce
from axisloom.plans.base import query, table

LINE = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity"


def _amount():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


@query("SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY l_returnflag")
def reduce_sum_by_key(spark, d):
    return reduce.reduce_by(table(spark, d, "lineitem"), ["l_returnflag"], revenue=("sum", _amount())).withColumn("revenue", F.round("revenue", 2))


@query(f"SELECT {LINE}, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS v FROM lineitem")
def for_all_1d(spark, d):
    return table(spark, d, "lineitem").select(*LINE.split(", "), F.round(_amount() * (1 + F.col("l_tax")), 6).alias("v"))


# nests whose outer loop runs over a table's rows and whose inner ones over the keys of nation and region
_NEST_2D = "customer CROSS JOIN nation"
_NEST_3D = "supplier CROSS JOIN nation CROSS JOIN region"


def _outer(spark, d, name, index, value):
    return table(spark, d, name).select(F.col(index).cast("long").alias("i"), F.col(value).alias("v"))


def _inner(spark, d, space, *names, lo=0, step=1, inclusive=False):
    """Loops over the keys from ``lo`` on of nation (j), then region (k), inside a space."""
    for name, at in zip(("j", "k")[: len(names)], names, strict=True):
        _, hi = loops.bounds(table(spark, d, at), f"{at[0]}_{at}key")
        space = loops.nested(space, name, lo, hi - inclusive, inclusive, step)
    return space


def _nest_2d(spark, d, **how):
    return _inner(spark, d, _outer(spark, d, "customer", "c_custkey", "c_acctbal"), "nation", **how)


def _nest_3d(spark, d, **how):
    return _inner(spark, d, _outer(spark, d, "supplier", "s_suppkey", "s_acctbal"), "nation", "region", **how)


@query(f"SELECT c_custkey::BIGINT AS i, n_nationkey::BIGINT AS j, round(c_acctbal * (n_nationkey + 1), 2) AS v FROM {_NEST_2D}")
def for_all_2d(spark, d):
    return _nest_2d(spark, d).withColumn("v", F.round(F.col("v") * (F.col("j") + 1), 2))


@query(f"SELECT s_suppkey::BIGINT AS i, n_nationkey::BIGINT AS j, r_regionkey::BIGINT AS k, round(s_acctbal * (n_nationkey + 1) + r_regionkey, 2) AS v FROM {_NEST_3D}")
def for_all_3d(spark, d):
    return _nest_3d(spark, d).withColumn("v", F.round(F.col("v") * (F.col("j") + 1) + F.col("k"), 2))


@query("SELECT p_partkey::BIGINT AS i, round(2 * p_retailprice, 2) AS v FROM part")
def do_all_1d(spark, d):
    """Both ends, the least and the greatest key, belong to the loop."""
    parts = _outer(spark, d, "part", "p_partkey", "p_retailprice")
    lo, hi = loops.bounds(parts, "i")
    return loops.strided(parts, "i", lo, hi - 1, 1, inclusive=True).withColumn("v", F.round(2 * F.col("v"), 2))


@query(f"SELECT c_custkey::BIGINT AS i, n_nationkey::BIGINT AS j, round(c_acctbal - n_nationkey * 21, 2) AS v FROM {_NEST_2D} WHERE n_nationkey >= 3")
def do_all_2d(spark, d):
    return _nest_2d(spark, d, lo=3, inclusive=True).withColumn("v", F.round(F.col("v") - F.col("j") * 21, 2))


@query(f"SELECT s_suppkey::BIGINT AS i, n_nationkey::BIGINT AS j, r_regionkey::BIGINT AS k, round(s_acctbal + n_nationkey * 6 + r_regionkey * 42, 2) AS v FROM {_NEST_3D} WHERE n_nationkey >= 1 AND r_regionkey >= 1")
def do_all_3d(spark, d):
    return _nest_3d(spark, d, lo=1, inclusive=True).withColumn("v", F.round(F.col("v") + F.col("j") * 6 + F.col("k") * 42, 2))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 10 AND (o_orderkey - 10) % 7 = 0")
def for_loop_delta(spark, d):
    orders = table(spark, d, "orders")
    return loops.strided(orders, "o_orderkey", 10, loops.bounds(orders, "o_orderkey")[1], 7).select("o_orderkey", "o_custkey")


@query("SELECT p_partkey::BIGINT AS i, p_retailprice AS v FROM part WHERE (p_partkey - (SELECT min(p_partkey) FROM part)) % 8 = 0")
def do_loop_delta(spark, d):
    """Every eighth key from the least on; the greatest belongs to the loop if the stride meets it."""
    parts = _outer(spark, d, "part", "p_partkey", "p_retailprice")
    lo, hi = loops.bounds(parts, "i")
    return loops.strided(parts, "i", lo, hi - 1, 8, inclusive=True)


@query("SELECT (SELECT count(*) FROM lineitem) AS rows, (SELECT max(o_totalprice) FROM orders) AS most")
def run_once(spark, d):
    return loops.run(spark, rows=table(spark, d, "lineitem").agg(F.count("*")).scalar(), most=table(spark, d, "orders").agg(F.max("o_totalprice")).scalar())


@query(f"SELECT CAST(sum(c_custkey * n_nationkey) AS BIGINT) AS v FROM {_NEST_2D}")
def reduce_sum_2d(spark, d):
    return reduce.reduce_all(_nest_2d(spark, d), "long", v=("sum", F.col("i") * F.col("j")))


@query(f"SELECT CAST(sum((s_suppkey * 300 + n_nationkey * 20 + r_regionkey)::BIGINT ** 2) AS BIGINT) AS v FROM {_NEST_3D}")
def reduce_sum_3d(spark, d):
    x = F.col("i") * 300 + F.col("j") * 20 + F.col("k")
    return reduce.reduce_all(_nest_3d(spark, d), "long", v=("sum", x * x))


# the product of a whole space leaves the range of doubles
_PRODUCT = "(CASE WHEN count(*) FILTER (x = 0) > 0 THEN 0 ELSE 1 - 2 * (count(*) FILTER (x < 0) % 2) END)::INTEGER AS sign, round(sum(ln(abs(x))), 5) AS log"


@query(f"SELECT {_PRODUCT} FROM (SELECT (c_acctbal + 0.005) * (n_nationkey + 1) AS x FROM {_NEST_2D})")
def reduce_product_2d(spark, d):
    return reduce.product_log(_nest_2d(spark, d), (F.col("v") + 0.005) * (F.col("j") + 1)).withColumn("log", F.round("log", 5))


@query(f"SELECT {_PRODUCT} FROM (SELECT (s_acctbal + 0.005) * (n_nationkey + 1) * (r_regionkey + 2) AS x FROM {_NEST_3D})")
def reduce_product_3d(spark, d):
    return reduce.product_log(_nest_3d(spark, d), (F.col("v") + 0.005) * (F.col("j") + 1) * (F.col("k") + 2)).withColumn("log", F.round("log", 5))


@query(f"SELECT round(max(c_acctbal * (n_nationkey - 10)), 2) AS most, round(min(c_acctbal * (n_nationkey - 10)), 2) AS least FROM {_NEST_2D}")
def reduce_max_min_2d(spark, d):
    x = F.col("v") * (F.col("j") - 10)
    return reduce.reduce_all(_nest_2d(spark, d), most=("max", F.round(x, 2)), least=("min", F.round(x, 2)))


@query(f"SELECT round(max(s_acctbal - n_nationkey * r_regionkey), 2) AS most, round(min(s_acctbal - n_nationkey * r_regionkey), 2) AS least FROM {_NEST_3D}")
def reduce_max_min_3d(spark, d):
    x = F.round(F.col("v") - F.col("j") * F.col("k"), 2)
    return reduce.reduce_all(_nest_3d(spark, d), most=("max", x), least=("min", x))


@query("SELECT 0.0::DOUBLE AS s, 1.0::DOUBLE AS p, (-1.7976931348623157e308)::DOUBLE AS most, 1.7976931348623157e308::DOUBLE AS least")
def reduce_empty(spark, d):
    x = F.col("l_tax")
    return reduce.reduce_all(table(spark, d, "lineitem").where("l_orderkey < 0"), s=("sum", x), p=("product", x), most=("max", x), least=("min", x))


@query("SELECT CAST(sum(l_partkey) AS BIGINT) AS s, max(l_partkey) AS most, min(l_partkey) AS least FROM lineitem")
def do_reduce_sum_max_min(spark, d):
    x = F.col("l_partkey")
    lines = table(spark, d, "lineitem")
    lo, hi = loops.bounds(lines, "l_orderkey")
    return reduce.reduce_all(loops.strided(lines, "l_orderkey", lo, hi - 1, 1, inclusive=True), "long", s=("sum", x), most=("max", x), least=("min", x))


@query(f"SELECT CAST(sum(c_custkey * 7 - n_nationkey) AS BIGINT) AS s, max((c_custkey - 3) * (n_nationkey - 9))::BIGINT AS most, min((c_custkey - 3) * (n_nationkey - 9))::BIGINT AS least FROM {_NEST_2D} WHERE n_nationkey >= 2")
def do_reduce_2d(spark, d):
    """Both ends of the inner loop belong to the space."""
    i, j = F.col("i"), F.col("j")
    return reduce.reduce_all(_nest_2d(spark, d, lo=2, inclusive=True), "long", s=("sum", i * 7 - j), most=("max", (i - 3) * (j - 9)), least=("min", (i - 3) * (j - 9)))


@query(f"SELECT CAST(sum(s_suppkey * n_nationkey - r_regionkey) AS BIGINT) AS s, max(s_suppkey - n_nationkey * r_regionkey)::BIGINT AS most, min(s_suppkey - n_nationkey * r_regionkey)::BIGINT AS least FROM {_NEST_3D} WHERE n_nationkey >= 1 AND r_regionkey >= 1")
def do_reduce_3d(spark, d):
    i, j, k = F.col("i"), F.col("j"), F.col("k")
    return reduce.reduce_all(_nest_3d(spark, d, lo=1, inclusive=True), "long", s=("sum", i * j - k), most=("max", i - j * k), least=("min", i - j * k))


@query(f"SELECT c_custkey::BIGINT AS i, n_nationkey::BIGINT AS j, c_acctbal AS v FROM {_NEST_2D} WHERE n_nationkey >= 1 AND (n_nationkey - 1) % 4 = 0")
def for_loop_delta_2d(spark, d):
    return _nest_2d(spark, d, lo=1, step=4)


@query(f"SELECT s_suppkey::BIGINT AS i, n_nationkey::BIGINT AS j, r_regionkey::BIGINT AS k, s_acctbal AS v FROM {_NEST_3D} WHERE n_nationkey % 2 = 0 AND r_regionkey % 2 = 0")
def do_loop_delta_3d(spark, d):
    """The greatest keys, 24 and 4, are met by the strides and belong to the space."""
    return _nest_3d(spark, d, step=2, inclusive=True)


@query("SELECT l_orderkey, CAST(sum(l_partkey) AS BIGINT) AS s, max(l_partkey) AS most, min(l_partkey) AS least FROM lineitem GROUP BY l_orderkey")
def team_reduce_second(spark, d):
    x = F.col("l_partkey")
    return reduce.reduce_by(table(spark, d, "lineitem"), ["l_orderkey"], "long", s=("sum", x), most=("max", x), least=("min", x))


@query("SELECT l_orderkey, l_linenumber, CAST(sum(l_partkey) AS BIGINT) AS s, max(l_partkey) AS most, min(l_partkey) AS least FROM lineitem GROUP BY l_orderkey, l_linenumber")
def team_reduce_third(spark, d):
    x = F.col("l_partkey")
    return reduce.reduce_by(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], "long", s=("sum", x), most=("max", x), least=("min", x))


_LINES = "n AS (SELECT l_orderkey::BIGINT AS i, count(*) AS n FROM lineitem GROUP BY 1)"


def _lines(spark, d):
    """A team for each order, with its number of lines."""
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("long").alias("i")).agg(F.count("*").alias("n"))


@query(f"WITH {_LINES} SELECT i, j, unnest(range(j, n)) AS k, n - j AS v FROM (SELECT i, n, unnest(range(n)) AS j FROM n)")
def team_nested_bounds(spark, d):
    """Pairs of lines of each order, the second not before the first."""
    nest = loops.nested(loops.nested(_lines(spark, d), "j", 0, F.col("n")), "k", F.col("j"), F.col("n"))
    return nest.select("i", "j", "k", (F.col("n") - F.col("j")).alias("v"))


@query(f"WITH {_LINES} SELECT i, (n * (n + 1) // 2)::BIGINT AS s FROM n")
def team_triangular_sum(spark, d):
    """Sums of 1 to the number of lines of each order, both included."""
    nest = loops.nested(_lines(spark, d), "j", 1, F.col("n"), inclusive=True)
    return reduce.reduce_by(nest, ["i"], "long", s=("sum", F.col("j")))
