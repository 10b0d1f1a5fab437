"""Distributed semantics, vectors and statistics over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from axisloom.operators import dist, linalg, network, reduce, sparse, stats, vectors
from axisloom.plans.base import query, table

PARTS = 7


def _mapped(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("gid"), F.col("c_acctbal").alias("v"))
    return dist.partition_map(c, "gid", c.count(), PARTS)


# blocks of n ids: the first n % 7 have one more
_MAP = f"""
n AS (SELECT count(*) AS n, count(*) // {PARTS} AS q, count(*) % {PARTS} AS r FROM customer),
m AS (SELECT c_custkey AS gid, c_acctbal AS v,
  CASE WHEN c_custkey < r * (q + 1) THEN c_custkey // (q + 1) ELSE r + (c_custkey - r * (q + 1)) // q END::INTEGER AS part, q, r FROM customer, n),
p AS (SELECT gid, v, part, (gid - (part * q + least(part, r)))::BIGINT AS lid FROM m)
"""


@query(f"WITH {_MAP} SELECT gid, part, lid FROM p")
def partition_block(spark, d):
    return _mapped(spark, d).select("gid", "part", "lid")


@query(f"WITH {_MAP} SELECT part, count(*) AS n, min(gid) AS min_gid, max(gid) AS max_gid FROM p GROUP BY 1")
def min_max_gid(spark, d):
    return dist.extents(_mapped(spark, d), "gid")


@query(f"WITH {_MAP} SELECT o_orderkey, o_custkey AS gid, p.part, coalesce(p.lid, -1) AS lid FROM orders LEFT JOIN p ON p.gid = o_custkey")
def global_to_local(spark, d):
    gids = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("gid"))
    return dist.to_local(gids, _mapped(spark, d), "gid").select("o_orderkey", "gid", "part", "lid")


def _needs(spark, d):
    """Every part needs the ids just beside its own."""
    m = _mapped(spark, d)
    return m.select("part", F.explode(F.array(F.col("gid") - 1, F.col("gid") + 1)).alias("gid")), m


_PLAN = f"{_MAP}, plan AS (SELECT DISTINCT b.part AS src, a.part AS dst, b.gid FROM p a JOIN p b ON abs(a.gid - b.gid) = 1 AND a.part <> b.part)"


@query(f"WITH {_PLAN} SELECT src, dst, gid FROM plan")
def halo_plan(spark, d):
    needs, m = _needs(spark, d)
    return dist.halo_plan(needs, m, "gid")


@query(f"WITH {_PLAN} SELECT dst, gid, v FROM plan JOIN p USING (gid)")
def halo_exchange(spark, d):
    needs, m = _needs(spark, d)
    return dist.exchange(dist.halo_plan(needs, m, "gid"), m, "gid")


@query(f"WITH {_PLAN}, c AS (SELECT src, dst, count(*) AS n FROM plan GROUP BY 1, 2) SELECT src, dst, n, coalesce(sum(n) OVER (PARTITION BY src ORDER BY dst ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS displ FROM c")
def comm_counts_displs(spark, d):
    needs, m = _needs(spark, d)
    return dist.counts_and_displacements(dist.halo_plan(needs, m, "gid"), "src", "dst")


@query(f"WITH {_PLAN} SELECT src, dst, gid FROM plan WHERE gid % 2 = 0")
def comm_unmatched(spark, d):
    needs, m = _needs(spark, d)
    plan = dist.halo_plan(needs, m, "gid")
    return dist.unmatched(plan, plan.where("gid % 2 = 1"), "gid")


@query("SELECT CAST(sum(l_partkey) AS BIGINT) AS v FROM lineitem WHERE l_linenumber = 2")
def all_reduce_fixed_1(spark, d):
    return dist.all_reduce(table(spark, d, "lineitem"), "sum", F.col("l_partkey"), fixed={"l_linenumber": 2}, kind="long")


@query("SELECT max(l_partkey) AS v FROM lineitem WHERE l_linenumber = 2 AND l_suppkey = 3")
def all_reduce_fixed_2(spark, d):
    return dist.all_reduce(table(spark, d, "lineitem"), "max", F.col("l_partkey"), fixed={"l_linenumber": 2, "l_suppkey": 3}, kind="long")


@query("SELECT coalesce(min(l_orderkey), 9223372036854775807) AS v FROM lineitem WHERE l_linenumber = 1 AND l_suppkey = 3 AND l_partkey = 5")
def all_reduce_fixed_3(spark, d):
    return dist.all_reduce(table(spark, d, "lineitem"), "min", F.col("l_orderkey"), fixed={"l_linenumber": 1, "l_suppkey": 3, "l_partkey": 5}, kind="long")


# ---- vectors: prices of parts and their totals sold

_XY = "WITH x AS (SELECT p_partkey AS k, p_retailprice AS v FROM part), y AS (SELECT l_partkey AS k, sum(l_quantity) AS v FROM lineitem GROUP BY 1)"


def _xy(spark, d):
    x = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("v"))
    return x, table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(F.sum("l_quantity").alias("v"))


@query(f"{_XY} SELECT k, round(x.v + y.v, 4) AS v FROM x JOIN y USING (k)")
def vec_add(spark, d):
    return vectors.combine(*_xy(spark, d), "k").withColumn("v", F.round("v", 4))


@query(f"{_XY} SELECT k, round(x.v - y.v, 4) AS v FROM x JOIN y USING (k)")
def vec_sub(spark, d):
    return vectors.combine(*_xy(spark, d), "k", 1.0, -1.0).withColumn("v", F.round("v", 4))


@query(f"{_XY} SELECT k, round(2.5 * v, 4) AS v FROM x")
def vec_scale(spark, d):
    return vectors.scale(_xy(spark, d)[0], 2.5).withColumn("v", F.round("v", 4))


@query(f"{_XY} SELECT k, round(x.v * y.v, 4) AS v FROM x JOIN y USING (k)")
def vec_multiply(spark, d):
    return vectors.multiply(*_xy(spark, d), "k").withColumn("v", F.round("v", 4))


@query(f"{_XY} SELECT k, round(1 / v, 8) AS v FROM x")
def vec_reciprocal(spark, d):
    return vectors.reciprocal(_xy(spark, d)[0]).withColumn("v", F.round("v", 8))


@query(f"{_XY} SELECT round(sum(x.v * y.v), 2) AS dot FROM x JOIN y USING (k)")
def vec_dot(spark, d):
    return vectors.dot(*_xy(spark, d), "k").withColumn("dot", F.round("dot", 2))


@query("SELECT round(sum(abs(c_acctbal)), 2) AS norm1, round(sqrt(sum(c_acctbal * c_acctbal)), 4) AS norm2, max(abs(c_acctbal)) AS norm_inf, round(avg(c_acctbal), 6) AS mean FROM customer")
def vec_norms(spark, d):
    n = vectors.norms(table(spark, d, "customer").select(F.col("c_acctbal").alias("v")))
    return n.select(F.round("norm1", 2).alias("norm1"), F.round("norm2", 4).alias("norm2"), "norm_inf", F.round("mean", 6).alias("mean"))


@query(f"{_XY} SELECT k, round(coalesce(y.v, x.v), 4) AS v FROM x LEFT JOIN y USING (k)")
def vec_replace(spark, d):
    return vectors.replace_values(*_xy(spark, d), "k").withColumn("v", F.round("v", 4))


@query(f"{_XY} SELECT k, round(sum(v), 4) AS v FROM (SELECT k, v FROM x UNION ALL SELECT k, v FROM y) GROUP BY 1")
def vec_sum_into(spark, d):
    return vectors.sum_into(*_xy(spark, d), "k").withColumn("v", F.round("v", 4))


# ---- statistics

_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("SELECT " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in _COLS) + " FROM lineitem")
def column_mean(spark, d):
    return stats.means(table(spark, d, "lineitem"), _COLS).select(*(F.round(c, 6).alias(c) for c in _COLS))


@query("SELECT " + ", ".join(f"round(var_samp({c}), 4) AS {c}" for c in _COLS) + " FROM lineitem")
def sample_variance(spark, d):
    return stats.sample_variances(table(spark, d, "lineitem"), _COLS).select(*(F.round(c, 4).alias(c) for c in _COLS))


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round({'1.0::DOUBLE' if a == b else f'corr({a}, {b})'}, 6) AS r FROM lineitem" + (" GROUP BY 1, 2" if a == b else "") for a in _COLS for b in _COLS))
def correlation_matrix(spark, d):
    return stats.correlations(table(spark, d, "lineitem"), _COLS).withColumn("r", F.round("r", 6))


# ---- products and layers

_MM = "WITH a AS (SELECT l_suppkey::BIGINT AS i, l_partkey AS j, sum(l_quantity)::DOUBLE AS v FROM lineitem GROUP BY 1, 2), b AS (SELECT l_partkey AS i, l_linenumber::BIGINT AS j, sum(l_quantity)::DOUBLE AS v FROM lineitem GROUP BY 1, 2) SELECT a.i, b.j, sum(a.v * b.v) AS v FROM a JOIN b ON a.j = b.i GROUP BY 1, 2"


def _ab(spark, d):
    """Pieces by supplier and part, and by part and number of the line."""
    cells = lambda i, j: table(spark, d, "lineitem").groupBy(F.col(i).cast("long").alias("i"), F.col(j).cast("long").alias("j")).agg(F.sum("l_quantity").cast("double").alias("v"))
    return cells("l_suppkey", "l_partkey"), cells("l_partkey", "l_linenumber")


@query(_MM)
def matmul_relational(spark, d):
    return sparse.spmm(*_ab(spark, d))


@query(_MM)
def matmul_blocked(spark, d):
    """As all pieces are more than 0, the cells that the blocks fill up with zeros are those without a pair."""
    return linalg.matmul_blocked(*_ab(spark, d), size=256).where("v <> 0")


def _layer(spark, d, repeat):
    x = table(spark, d, "embeddings").select(F.col("vec_id").alias("row"), F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    w = spark.range(64 * 10).select(F.expr("cast(id div 10 as int)").alias("i"), (F.col("id") % 10).alias("j"), ((F.col("id") * 7) % 11 / 10.0 - 0.5).alias("w"))
    b = spark.range(10).select(F.col("id").alias("j"), (F.col("id") / 100.0).alias("b"))
    return network.layer(x, F.broadcast(w), F.broadcast(b), repeat).withColumn("y", F.round("y", 6))  # 640 weights, fixed by the layer


def _layer_sql(bias: str) -> str:
    return f"WITH x AS (SELECT vec_id AS row, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), s AS (SELECT row, j.range AS j, sum(x * ((i * 10 + j.range) * 7 % 11 / 10.0 - 0.5)) AS s, count(*) AS n FROM x, range(10) j GROUP BY 1, 2) SELECT row, j, round(1 / (1 + exp(-(s + {bias}))), 6) AS y FROM s"


@query(_layer_sql("j / 100.0"))
def ann_layer(spark, d):
    return _layer(spark, d, False)


@query(_layer_sql("n * (j / 100.0)"))
def ann_layer_repeated_bias(spark, d):
    return _layer(spark, d, True)


def _matrix(r: int, c: int):
    return F.col("s_suppkey") % (3 + r) + F.lit(1.0 + c) * (2 if r == c else 1) + (F.col("s_suppkey") % 7) * int(r == c)


_A = [[f"(s_suppkey % {3 + r} + {1.0 + c} * {2 if r == c else 1} + (s_suppkey % 7) * {1 if r == c else 0})" for c in range(3)] for r in range(3)]
_DET = f"({_A[0][0]}*({_A[1][1]}*{_A[2][2]}-{_A[1][2]}*{_A[2][1]})-{_A[0][1]}*({_A[1][0]}*{_A[2][2]}-{_A[1][2]}*{_A[2][0]})+{_A[0][2]}*({_A[1][0]}*{_A[2][1]}-{_A[1][1]}*{_A[2][0]}))::DOUBLE"


@query(f"SELECT s_suppkey, round({_DET}, 6) AS det FROM supplier")
def det3(spark, d):
    a = [[_matrix(r, c) for c in range(3)] for r in range(3)]
    return table(spark, d, "supplier").select("s_suppkey", F.round(linalg.det3(a), 6).alias("det"))


@query(f"SELECT s_suppkey, round((({_A[1][1]}*{_A[2][2]}-{_A[1][2]}*{_A[2][1]}) / nullif({_DET}, 0))::DOUBLE, 6) AS x00, round((-({_A[0][1]}*{_A[2][2]}-{_A[0][2]}*{_A[2][1]}) / nullif({_DET}, 0))::DOUBLE, 6) AS x01 FROM supplier WHERE abs({_DET}) > 0.5")
def inv3(spark, d):
    a = [[_matrix(r, c) for c in range(3)] for r in range(3)]
    x = linalg.inv3(a)
    return table(spark, d, "supplier").where(F.abs(linalg.det3(a)) > 0.5).select("s_suppkey", F.round(x[0][0], 6).alias("x00"), F.round(x[0][1], 6).alias("x01"))


def _systems(spark, d):
    """One 4 by 4 system for each supplier, diagonally dominant, with solution 1, 2, 3, 4."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("block"))
    at = s.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
    a = at.withColumn("v", F.when(F.col("i") == F.col("j"), 20.0 + F.col("block") % 5).otherwise((F.col("block") + 3 * F.col("i") + 5 * F.col("j")) % 7 * 1.0))
    return a.unionByName(a.groupBy("block", "i").agg(F.sum(F.col("v") * (F.col("j") + 1)).alias("v")).withColumn("j", F.lit(-1).cast("long")))


_SOLVED = "SELECT s_suppkey AS block, range AS i, (range + 1)::DOUBLE AS x FROM supplier, range(4)"


@query(_SOLVED)
def lu_solve(spark, d):
    return linalg.solve_blocks(_systems(spark, d), "lu").withColumn("x", F.round("x", 6))


@query(_SOLVED)
def qr_solve(spark, d):
    return linalg.solve_blocks(_systems(spark, d), "qr").withColumn("x", F.round("x", 6))
