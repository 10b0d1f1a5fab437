"""Dense, ragged and sparse arrays over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from axisloom.operators import arrays, loops, ragged, sparse
from axisloom.plans.base import query, table


@query("SELECT p_partkey AS i, 3.5::DOUBLE AS v FROM part")
def set_values(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("i"), F.lit(3.5).alias("v"))


@query("SELECT o_orderkey AS row, p.range AS pos, CASE WHEN p.range < coalesce(n, 0) THEN 7.0 ELSE 0.0 END::DOUBLE AS v FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey, range(8) p")
def set_values_sparse(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("row"))
    lengths = ragged.strides(rows, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("row")), "row")
    buffer = loops.nested(rows, "pos", 0, 8).withColumn("v", F.lit(0.0))
    return ragged.set_values_sparse(buffer, lengths, "row", 7.0)


def _balances(spark, d):
    """Balances of customers, by customer and nation of whoever holds them: one row of the array for each customer."""
    customers = table(spark, d, "customer")
    (lo, hi), (_, nations) = loops.bounds(customers, "c_custkey"), loops.bounds(table(spark, d, "nation"), "n_nationkey")
    cells = loops.nested(customers.select((F.col("c_custkey") - lo).cast("long").alias("i"), F.col("c_acctbal").alias("b"), "c_nationkey"), "j", 0, nations)
    return arrays.DenseArray(cells.select("i", "j", F.when(F.col("j") == F.col("c_nationkey"), F.col("b")).otherwise(0.0).alias("v")), (hi - lo, nations))


_BALANCES = "b AS (SELECT c_custkey - (SELECT min(c_custkey) FROM customer) AS i, n_nationkey AS j, CASE WHEN n_nationkey = c_nationkey THEN c_acctbal ELSE 0.0 END::DOUBLE AS v FROM customer CROSS JOIN nation)"


@query(f"WITH {_BALANCES} SELECT i::BIGINT AS i, j::BIGINT - 2 AS j, v FROM b WHERE j >= 2 AND j < 10")
def view_slice(spark, d):
    return _balances(spark, d).slice(j=(2, 10)).df


@query(f"WITH {_BALANCES} SELECT j::BIGINT AS i, i::BIGINT AS j, v FROM b")
def transpose(spark, d):
    return _balances(spark, d).transpose().df


def _grid(spark, d):
    n = table(spark, d, "nation")
    return n.select(F.col("n_nationkey").cast("long").alias("i"), F.col("n_regionkey").cast("long").alias("j"))


@query("SELECT n_nationkey::BIGINT AS i, n_regionkey::BIGINT AS j, n_nationkey::BIGINT * 5 + n_regionkey AS flat FROM nation")
def c_flat(spark, d):
    return _grid(spark, d).withColumn("flat", arrays.flat_index([F.col("i"), F.col("j")], [25, 5], "C"))


@query("SELECT n_nationkey::BIGINT AS i, n_regionkey::BIGINT AS j, n_nationkey::BIGINT + n_regionkey * 25 AS flat FROM nation")
def f_flat(spark, d):
    return _grid(spark, d).withColumn("flat", arrays.flat_index([F.col("i"), F.col("j")], [25, 5], "F"))


@query("SELECT n_nationkey::BIGINT + 1 AS i, n_regionkey::BIGINT + 1 AS j, n_nationkey::BIGINT * 5 + n_regionkey AS c, n_nationkey::BIGINT + n_regionkey * 25 AS f FROM nation")
def matrix_one_based(spark, d):
    one = _grid(spark, d).select((F.col("i") + 1).alias("i"), (F.col("j") + 1).alias("j"))
    ij = [F.col("i"), F.col("j")]
    return one.withColumns({"c": arrays.flat_index(ij, [25, 5], "C", 1), "f": arrays.flat_index(ij, [25, 5], "F", 1)})


_SLOT = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1"


def _lines(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("row"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return ragged.with_positions(x, "row", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]).withColumn("v", F.col("l_partkey"))


def _orders(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("row"))


@query(f"WITH e AS (SELECT l_orderkey AS row, {_SLOT} AS pos, l_partkey AS v FROM lineitem) SELECT row, array_to_string(list(v ORDER BY pos), ',') AS vals FROM e GROUP BY row")
def ragged_pack(spark, d):
    return ragged.pack(_lines(spark, d), "row", "pos", "v").withColumn("vals", F.array_join(F.col("vals").cast("array<string>"), ","))


@query(f"SELECT l_orderkey AS row, {_SLOT} AS pos, l_partkey AS v FROM lineitem")
def ragged_unpack(spark, d):
    return ragged.unpack(ragged.pack(_lines(spark, d), "row", "pos", "v"), "row").withColumn("pos", F.col("pos").cast("long"))


@query("SELECT o_orderkey AS row, coalesce(n, 0)::BIGINT AS stride FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def ragged_stride(spark, d):
    return ragged.strides(_orders(spark, d), _lines(spark, d), "row")


@query("SELECT row, stride, coalesce(sum(stride) OVER (ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM (SELECT o_orderkey AS row, coalesce(n, 0)::BIGINT AS stride FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)")
def ragged_offsets(spark, d):
    return ragged.offsets(_orders(spark, d), _lines(spark, d), "row")


@query(f"WITH e AS (SELECT l_orderkey AS row, {_SLOT} AS pos, l_partkey AS v FROM lineitem) SELECT o.o_orderkey AS row, 2::BIGINT AS pos, v FROM orders o LEFT JOIN e ON e.row = o.o_orderkey AND e.pos = 2")
def ragged_access(spark, d):
    return ragged.access(_lines(spark, d), "row", _orders(spark, d).withColumn("pos", F.lit(2).cast("long")))


@query(f"WITH e AS (SELECT l_orderkey AS row, {_SLOT} AS pos, l_partkey AS v FROM lineitem) SELECT row, pos, v FROM e UNION ALL SELECT o_orderkey, coalesce(n, 0), o_custkey FROM orders LEFT JOIN (SELECT row, count(*) AS n FROM e GROUP BY 1) x ON x.row = o_orderkey")
def ragged_append(spark, d):
    more = table(spark, d, "orders").select(F.col("o_orderkey").alias("row"), F.lit(0).alias("ord"), F.col("o_custkey").alias("v"))
    return ragged.append(_lines(spark, d), more, "row")


@query("SELECT l_partkey AS col, count(*) AS stride, sum(l_suppkey)::BIGINT AS total FROM lineitem GROUP BY 1")
def ragged_down(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("col")).agg(F.count("*").alias("stride"), F.sum("l_suppkey").alias("total"))


@query(f"WITH e AS (SELECT l_orderkey AS row, {_SLOT} AS pos, l_quantity AS a, l_extendedprice AS b FROM lineitem) SELECT row, pos, 0::BIGINT AS k, a AS v FROM e UNION ALL SELECT row, pos, 1, b FROM e")
def ragged_vectors(spark, d):
    return _lines(spark, d).select("row", "pos", F.posexplode(F.array("l_quantity", "l_extendedprice")).alias("k", "v")).withColumn("k", F.col("k").cast("long"))


@query(f"WITH e AS (SELECT l_orderkey AS row, {_SLOT} AS pos, l_quantity AS a, l_partkey::DOUBLE AS b FROM lineitem) SELECT row, pos, k.range AS k, l.range AS l, round(CASE WHEN k.range = 0 THEN a ELSE b END * CASE WHEN l.range = 0 THEN a ELSE b END, 4) AS v FROM e, range(2) k, range(2) l")
def ragged_tensors(spark, d):
    x = _lines(spark, d).withColumn("u", F.array(F.col("l_quantity"), F.col("l_partkey").cast("double")))
    x = x.select("row", "pos", "u", F.posexplode("u").alias("k", "a"))
    return x.select("row", "pos", F.col("k").cast("long").alias("k"), "a", F.posexplode("u").alias("l", "b")).select("row", "pos", "k", F.col("l").cast("long").alias("l"), F.round(F.col("a") * F.col("b"), 4).alias("v"))


@query("SELECT p_partkey::BIGINT - (SELECT min(p_partkey) FROM part) AS i, p_retailprice AS v FROM part UNION ALL SELECT count(*), 9.0 FROM part")
def dynamic_push_pop(spark, d):
    """Prices of all parts, then three values pushed, of which the last two are popped."""
    parts = table(spark, d, "part")
    lo, hi = loops.bounds(parts, "p_partkey")
    prices = parts.select((F.col("p_partkey").cast("long") - lo).alias("i"), F.col("p_retailprice").alias("v"))
    return arrays.DynamicArray(prices, hi - lo + 10, hi - lo).push_back(9.0, 8.0, 7.0).pop_back(2).df


# ---- sparse: quantities by supplier and part

_COO = "SELECT l_suppkey AS i, l_partkey AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2"


def _coo(spark, d):
    return sparse.coo(table(spark, d, "lineitem"), "l_suppkey", "l_partkey", "l_quantity")


def _n(spark, d, name):
    return table(spark, d, name).count()


@query(f"SELECT count(*) AS nnz FROM ({_COO})")
def csr_nnz(spark, d):
    return sparse.nnz(_coo(spark, d))


@query(f"SELECT s_suppkey AS i, count(c.i) AS stride FROM supplier LEFT JOIN ({_COO}) c ON c.i = s_suppkey GROUP BY 1")
def csr_row_nnz(spark, d):
    return sparse.major_counts(_coo(spark, d), _n(spark, d, "supplier"))


def _starts_sql(keys: str, key: str, major: str) -> str:
    return f"SELECT {major}, stride, coalesce(sum(stride) OVER (ORDER BY {major} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM (SELECT {key} AS {major}, count(c.{major}) AS stride FROM {keys} LEFT JOIN ({_COO}) c ON c.{major} = {key} GROUP BY 1)"


@query(_starts_sql("supplier", "s_suppkey", "i"))
def csr_starts(spark, d):
    return sparse.starts(_coo(spark, d), _n(spark, d, "supplier"))


@query(_starts_sql("part", "p_partkey", "j"))
def csc_starts(spark, d):
    return sparse.starts(_coo(spark, d), _n(spark, d, "part"), "j")


_BY_ROW = f"SELECT i, j, v, row_number() OVER (ORDER BY i, j) - 1 AS flat FROM ({_COO})"
_BY_COL = f"SELECT i, j, v, row_number() OVER (ORDER BY j, i) - 1 AS flat FROM ({_COO})"


@query(_BY_ROW)
def csc_to_csr(spark, d):
    return sparse.flat_positions(_coo(spark, d), _n(spark, d, "supplier"))


@query(_BY_COL)
def csr_to_csc(spark, d):
    return sparse.flat_positions(_coo(spark, d), _n(spark, d, "part"), "j")


_NR = "SELECT n_nationkey::BIGINT AS i, n_regionkey::BIGINT AS j, 1.0 + n_nationkey AS v FROM nation"


def _nation(spark, d):
    return _grid(spark, d).withColumn("v", F.col("i") + 1.0)


@query(f"SELECT a.range AS i, b.range AS j, coalesce(v, 0)::DOUBLE AS v FROM range(25) a CROSS JOIN range(5) b LEFT JOIN ({_NR}) c ON c.i = a.range AND c.j = b.range")
def csr_to_dense(spark, d):
    return sparse.to_dense(_nation(spark, d), 25, 5)


@query(f"SELECT i, j, v::DOUBLE AS v FROM ({_NR})")
def csr_from_dense(spark, d):
    return sparse.from_dense(sparse.to_dense(_nation(spark, d), 25, 5))


@query(f"SELECT i, j, CASE WHEN j % 3 = 0 THEN -1.0 ELSE v END::DOUBLE AS v FROM ({_COO})")
def csr_matched_update(spark, d):
    a = _coo(spark, d)
    writes = a.where("j % 3 = 0").select("i", "j", F.lit(-1.0).alias("v")).unionByName(spark.createDataFrame([(-5, 0, 1.0)], "i long, j long, v double"))
    return sparse.update_stored(a, writes)


@query(f"SELECT i, round(sum(v * p_retailprice), 2) AS y FROM ({_COO}) JOIN part ON p_partkey = j GROUP BY 1")
def spmv_csr(spark, d):
    x = table(spark, d, "part").select(F.col("p_partkey").alias("j"), F.col("p_retailprice").alias("x"))
    return sparse.spmv(_coo(spark, d), x).withColumn("y", F.round("y", 2))


@query(f"SELECT j AS i, round(sum(v * s_acctbal), 2) AS y FROM ({_COO}) JOIN supplier ON s_suppkey = i GROUP BY 1")
def spmv_csc(spark, d):
    x = table(spark, d, "supplier").select(F.col("s_suppkey").alias("j"), F.col("s_acctbal").alias("x"))
    return sparse.spmv(sparse.transpose(_coo(spark, d)), x).withColumn("y", F.round("y", 2))


@query("WITH a AS (SELECT c_custkey % 40 AS i, c_nationkey::BIGINT AS j, count(*)::DOUBLE AS v FROM customer GROUP BY 1, 2), b AS (SELECT s_nationkey::BIGINT AS i, s_suppkey % 30 AS j, count(*)::DOUBLE AS v FROM supplier GROUP BY 1, 2) SELECT a.i, b.j, sum(a.v * b.v) AS v FROM a JOIN b ON a.j = b.i GROUP BY 1, 2")
def spmm(spark, d):
    one = F.lit(1.0)
    a = sparse.coo(table(spark, d, "customer").withColumns({"r": F.col("c_custkey") % 40, "w": one}), "r", "c_nationkey", "w")
    b = sparse.coo(table(spark, d, "supplier").withColumns({"c": F.col("s_suppkey") % 30, "w": one}), "s_nationkey", "c", "w")
    return sparse.spmm(a, b)


@query(f"SELECT i, j, round(v * 0.5, 4) AS v FROM ({_COO})")
def csr_scale(spark, d):
    return sparse.scale(_coo(spark, d), 0.5).withColumn("v", F.round("v", 4))


@query(f"SELECT i, j, round(sum(v), 4) AS v FROM (SELECT i, j, 2 * v AS v FROM ({_COO}) UNION ALL SELECT s_suppkey, s_suppkey, -s_acctbal FROM supplier) GROUP BY 1, 2")
def csr_add(spark, d):
    diagonal = table(spark, d, "supplier").select(F.col("s_suppkey").alias("i"), F.col("s_suppkey").alias("j"), F.col("s_acctbal").alias("v"))
    return sparse.add(_coo(spark, d), diagonal, 2.0, -1.0).withColumn("v", F.round("v", 4))
