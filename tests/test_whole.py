"""Whole-table queries against brute force on small tables of their own."""

import math
import re

import pytest
from pyspark.sql import functions as F

from axisloom.operators import reduce
from axisloom.plans.registry import ORACLE_SQL, QUERIES


def rows(df):
    return sorted(tuple(x) for x in df.collect())


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    """Orders far beyond every prefix; part 7 is in all of them, and some lines come twice."""
    d = str(tmp_path_factory.mktemp("whole"))
    made = [(o, p, (o * 7 + p) % 11 / 100, p % 9 / 100, float(o + p)) for o in [*range(0, 90), *range(4000, 4090), 10**9] for p in (7, o % 13 + 20, o % 13 + 20)]
    spark.createDataFrame(made, "l_orderkey long, l_partkey long, l_discount double, l_tax double, l_extendedprice double").write.parquet(f"{d}/lineitem.parquet")
    return d, made


def test_incidence_of_all_lines(spark, lines):
    d, made = lines
    e = {(o, p) for o, p, *_ in made}
    assert rows(QUERIES["element_adjacency"](spark, d)) == sorted({(a, b) for a, p in e for b, q in e if p == q and a != b})
    assert rows(QUERIES["ghost_elements"](spark, d)) == sorted({(a % 5, b) for a, p in e for b, q in e if p == q and a % 5 != b % 5})


def test_reductions_of_all_lines(spark, lines):
    d, made = lines
    assert rows(QUERIES["reduce_sum_1d"](spark, d)) == [(sum(x[1] for x in made),)]
    assert rows(QUERIES["reduce_max_min_1d"](spark, d)) == [(max(x[4] for x in made), min(x[4] for x in made))]
    for name, c in (("reduce_product_1d", 2), ("do_reduce_product", 3)):
        [(sign, log)] = rows(QUERIES[name](spark, d))
        assert sign == 1 and abs(log - math.log(math.prod(1 + x[c] / 100 for x in made))) < 1e-6


def test_product_beyond_doubles(spark):
    some = lambda *x: tuple(reduce.product_log(spark.createDataFrame([(v,) for v in x], "v double"), F.col("v")).first())
    sign, log = some(*[-1e200] * 5, None)
    assert sign == -1 and math.isclose(log, 5 * math.log(1e200))
    assert some() == (1, 0.0) and some(2.0, 0.0) == (0, float("-inf")) and math.isnan(some(float("nan"))[1])


def test_queries_filter_no_ids():
    """A key is bounded only where an empty space or the bounds of a strided loop are what is asked for."""
    kept = {n for n, q in ORACLE_SQL.items() if re.search(r"WHERE [a-z]_\w*key (<|BETWEEN|>)", q)}
    assert kept <= {"reduce_empty", "for_loop_delta", "view_offset"}


@pytest.fixture(scope="module")
def dense(spark, tmp_path_factory):
    """Sizes that no extent of the partial forms divides."""
    d = str(tmp_path_factory.mktemp("dense"))
    spark.createDataFrame([(i, i % 50, 900.0 + i) for i in range(455)], "p_partkey long, p_size int, p_retailprice double").write.parquet(f"{d}/part.parquet")
    spark.createDataFrame([(i, i * 1.25 - 300) for i in range(500)], "c_custkey long, c_acctbal double").write.parquet(f"{d}/customer.parquet")
    return d


def test_views_of_all_parts(spark, dense):
    assert rows(QUERIES["view_reshape"](spark, dense).select("i", "j", "k", "v")) == [(i, 0, k, 900.0 + i * 5 + k) for i in range(91) for k in range(5)]
    got = rows(QUERIES["view_offset"](spark, dense).select("i", "j", "v"))
    assert got == [(i, j, 920.0 + i * 3 + j) for i in range(145) for j in range(3)]


def test_all_owned_rows(spark, dense):
    acct = [i * 1.25 - 300 for i in range(500)]
    sizes = [72] * 3 + [71] * 4
    want = [(p, lid, sum(sizes[:p]) + lid if lid < n else None) for p, n in enumerate(sizes) for lid in range(n + 1)]
    assert [tuple(x) for x in QUERIES["local_to_global"](spark, dense).orderBy("part", "lid").collect()] == want
    assert rows(QUERIES["all_reduce"](spark, dense)) == [(round(sum(acct), 2), max(acct), min(acct))]
    [(sign, log)] = rows(QUERIES["all_reduce_product"](spark, dense))
    assert sign == 1 and abs(log - sum(math.log(1 + x / 1e6) for x in acct)) < 1e-6


def test_surfaces_cover_all_parts(spark, dense):
    got = QUERIES["rbf_surface"](spark, dense)
    assert rows(got.where("k >= 0").groupBy("cloud").count()) == [(c, 60 if c < 7 else 35) for c in range(8)]


def test_exchange_probes_and_closure(spark, tmp_path):
    d = str(tmp_path)
    made = [(o, o % 5, o * 3 % 17, float(o % 4 + 1)) for o in range(60)]
    spark.createDataFrame(made, "l_orderkey long, l_suppkey long, l_partkey long, l_quantity double").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(i, float(i)) for i in range(5)], "s_suppkey long, s_acctbal double").write.parquet(f"{d}/supplier.parquet")
    spark.createDataFrame([(i, i - 200.0) for i in range(401)], "c_custkey long, c_acctbal double").write.parquet(f"{d}/customer.parquet")
    spark.createDataFrame([(i, i % 3, 900.0 + i) for i in range(40)], "p_partkey long, p_size int, p_retailprice double").write.parquet(f"{d}/part.parquet")
    got = {g: [i - 200.0 for i in range(401) if i % 150 == g] for g in range(150)}
    own = range(5)
    assert rows(QUERIES["reverse_comm_sum"](spark, d)) == [(g, g + sum(got[g])) for g in own]
    assert rows(QUERIES["reverse_comm_insert"](spark, d)) == [(g, got[g][-1]) for g in range(150)]
    assert rows(QUERIES["reverse_comm_replace"](spark, d)) == [(g, got[g][-1]) for g in own]
    assert rows(QUERIES["reverse_comm_absmax"](spark, d)) == [(g, max(g, *map(abs, got[g]))) for g in own]
    assert rows(QUERIES["reverse_comm_zero"](spark, d)) == [(g, 0.0) for g in own]
    cells = {}
    for _, i, j, v in made:
        cells[i, j] = cells.get((i, j), 0) + v
    missing = [(-1 - i, j) for i, j in cells]
    assert rows(QUERIES["csr_lookup"](spark, d).select("i", "j", "v")) == sorted([(*c, v) for c, v in cells.items()] + [(*c, 0.0) for c in missing])
    assert rows(QUERIES["csr_flat_index"](spark, d).select("i", "j", "flat")) == sorted([(*c, n) for n, c in enumerate(sorted(cells))] + [(*c, -1) for c in missing])
    want = [(a, b) for a in range(40) for b in range(40) if a != b and abs(a % 3 - b % 3) <= 1 and abs(a - b) <= 5]
    assert rows(QUERIES["symmetric_neighbors"](spark, d)) == want
