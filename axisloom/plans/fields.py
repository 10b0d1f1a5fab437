"""Meshes, points, graphs, grids and iteration."""

from __future__ import annotations

from pyspark.sql import functions as F

from axisloom.functions import scalar
from axisloom.operators import graph, iterate, linalg, loops, mesh, points, sparse, stencil
from axisloom.operators.loops import index_space
from axisloom.plans.base import query, table


@query("WITH e AS (SELECT DISTINCT l_orderkey AS elem, l_partkey AS node FROM lineitem) SELECT node, array_to_string(list(elem ORDER BY elem), ',') AS elems FROM e GROUP BY node")
def inverse_connectivity(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("elem"), F.col("l_partkey").alias("node"))
    return mesh.elements_of_nodes(e).withColumn("elems", F.array_join(F.col("elems").cast("array<string>"), ","))


# a box of one cell by supplier, nation and region: corners by the bits of lid
BOX = """n AS (SELECT (SELECT count(*) FROM supplier) AS nx, (SELECT count(*) FROM nation) AS ny, (SELECT count(*) FROM region) AS nz),
c AS (SELECT nx, ny, x, y, unnest(range(nz)) AS z FROM (SELECT *, unnest(range(ny)) AS y FROM (SELECT *, unnest(range(nx)) AS x FROM n))),
b AS (SELECT x + nx * y + nx * ny * z AS elem, lid, (x + (lid & 1)) + (nx + 1) * (y + (lid >> 1 & 1)) + (nx + 1) * (ny + 1) * (z + (lid >> 2)) AS node FROM c CROSS JOIN (SELECT unnest(range(8))::INTEGER AS lid))"""


def counts(spark, d):
    return tuple(table(spark, d, t).count() for t in ("supplier", "nation", "region"))


@query(f"WITH {BOX} SELECT elem, lid, node FROM b")
def box_mesh(spark, d):
    return mesh.box_mesh(spark, counts(spark, d))


@query("""
WITH n AS (SELECT (SELECT count(*) FROM supplier) AS nx, (SELECT count(*) FROM nation) AS ny, (SELECT count(*) FROM region) AS nz)
SELECT x + (nx + 1) * y + (nx + 1) * (ny + 1) * z AS node, round(-1 + x * 10.0::DOUBLE / nx, 9) AS x, round(2 + y * 5.0::DOUBLE / ny, 9) AS y, round(z * 2.0::DOUBLE / nz, 9) AS z
FROM (SELECT *, unnest(range(nz + 1)) AS z FROM (SELECT *, unnest(range(ny + 1)) AS y FROM (SELECT *, unnest(range(nx + 1)) AS x FROM n)))
""")
def box_nodes(spark, d):
    """Corners of a box from (-1, 2, 0) on, of lengths 10, 5 and 2."""
    at = mesh.box_nodes(spark, counts(spark, d), (10.0, 5.0, 2.0), (-1.0, 2.0, 0.0))
    return at.select("node", *(F.round(c, 9).alias(c) for c in "xyz"))


# a side's four corners agree in one bit
_FACES = f"{BOX}, f AS (SELECT elem, string_agg(node::VARCHAR, ',' ORDER BY node) AS key FROM b CROSS JOIN range(3) a WHERE true GROUP BY elem, a.range, lid >> a.range::INTEGER & 1)"


@query(f"WITH {_FACES} SELECT key, count(*) AS n_elems FROM f GROUP BY key")
def shared_faces(spark, d):
    return mesh.patches(mesh.box_mesh(spark, counts(spark, d))).withColumn("key", F.array_join(F.col("key").cast("array<string>"), ","))


@query("SELECT (nx + 1) * ny * nz + nx * (ny + 1) * nz + nx * ny * (nz + 1) AS patches, 2 * (nx * ny + ny * nz + nx * nz) AS boundary FROM (SELECT (SELECT count(*) FROM supplier) AS nx, (SELECT count(*) FROM nation) AS ny, (SELECT count(*) FROM region) AS nz)")
def boundary_faces(spark, d):
    return mesh.patches(mesh.box_mesh(spark, counts(spark, d))).agg(F.count("*").alias("patches"), F.count_if(F.col("n_elems") == 1).alias("boundary"))


@query(f"WITH {BOX} SELECT DISTINCT p.node AS a, q.node AS b FROM b p JOIN b q USING (elem) WHERE xor(p.lid, q.lid) IN (1, 2, 4)")
def node_edges(spark, d):
    return mesh.node_edges(mesh.box_mesh(spark, counts(spark, d)))


_PRICE = "p_retailprice / 100"


@query("SELECT p_partkey, least(19, greatest(0, round(p_size / 2.5 - 1e-8)))::BIGINT AS b_x, least(19, greatest(0, round(p_retailprice / 120.0 - 1e-8)))::BIGINT AS b_y FROM part")
def bin_assign(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    return points.with_bins(p, {"x": 2.5, "y": 120.0}, 20).select("p_partkey", "b_x", "b_y")


@query("SELECT least(19, greatest(0, round(p_size / 2.5 - 1e-8)))::BIGINT AS b_x, least(19, greatest(0, round(p_retailprice / 120.0 - 1e-8)))::BIGINT AS b_y, count(*) AS n FROM part GROUP BY 1, 2")
def bin_counts(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    return points.bin_counts(points.with_bins(p, {"x": 2.5, "y": 120.0}, 20), "x", "y")


_NEAR = "SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_partkey <> b.p_partkey AND abs(a.p_size - b.p_size) <= 1 AND abs(a.p_retailprice - b.p_retailprice) <= 5"


_REACH = {"x": 1.0, "y": 5.0}


def _sized(spark, d):
    return table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))


def _near(spark, d):
    return points.box_neighbors(_sized(spark, d), "p_partkey", _REACH)


@query(_NEAR)
def box_neighbors(spark, d):
    return _near(spark, d)


@query(f"WITH n AS ({_NEAR}), p AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY b) - 1 AS pos FROM n) SELECT x.a, x.b, x.pos, y.pos AS rev FROM p x JOIN p y ON x.a = y.b AND x.b = y.a")
def reverse_position(spark, d):
    return points.box_reverse_positions(_sized(spark, d), "p_partkey", _REACH)


@query("WITH n AS (SELECT count(*) AS n FROM customer) SELECT src, (src + step) % n AS dst FROM (SELECT n, unnest(range(n)) AS src FROM n) CROSS JOIN (SELECT unnest(range(1, 4)) AS step)")
def watts_ring(spark, d):
    return graph.ring(spark, table(spark, d, "customer").count(), 3)


# parts and suppliers that meet in a line: parts have even numbers, suppliers odd ones
_MET = "h AS (SELECT DISTINCT 2 * l_partkey::BIGINT AS a, 2 * l_suppkey::BIGINT + 1 AS b FROM lineitem), e AS MATERIALIZED (SELECT a AS src, b AS dst FROM h UNION ALL SELECT b, a FROM h)"


@query(f"WITH RECURSIVE {_MET}, w(root, node, dist) AS (SELECT min(dst), min(dst), 0 FROM e WHERE dst % 2 = 1 UNION SELECT w.root, e.dst, w.dist + 1 FROM w JOIN e ON e.src = w.node WHERE w.dist < 10) SELECT root, node, min(dist)::INTEGER AS dist FROM w GROUP BY 1, 2")
def bfs_distance(spark, d):
    """Hops from the first supplier to all parts and suppliers."""
    met = table(spark, d, "lineitem").select((2 * F.col("l_partkey").cast("long")).alias("src"), (2 * F.col("l_suppkey").cast("long") + 1).alias("dst"))
    return graph.bfs(iterate.saved(graph.undirected(met)), met.agg(F.min("dst").alias("root")))


_NEXT = "l AS (SELECT l_orderkey, l_suppkey - (SELECT min(l_suppkey) FROM lineitem) AS s, l_linenumber FROM lineitem), h AS (SELECT DISTINCT a.s AS a, b.s AS b FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1), e AS MATERIALIZED (SELECT a AS src, b AS dst FROM h UNION SELECT b, a FROM h)"


@query(f"WITH RECURSIVE {_NEXT}, w(root, node, dist) AS (SELECT s, s, 0 FROM (SELECT DISTINCT s FROM l) UNION SELECT w.root, e.dst, w.dist + 1 FROM w JOIN e ON e.src = w.node WHERE w.dist < 4), m AS (SELECT root, node, min(dist) AS dist FROM w GROUP BY 1, 2) SELECT round(sum(dist) / (SELECT (max(s) + 1.0) * (max(s) + 1) FROM l), 6)::DOUBLE AS average FROM m")
def average_distance(spark, d):
    """Mean hops between suppliers of consecutive lines of an order."""
    lines = table(spark, d, "lineitem")
    lo, hi = loops.bounds(lines, "l_suppkey")
    at = lines.select("l_orderkey", "l_linenumber", (F.col("l_suppkey") - lo).cast("long").alias("src"))
    after = at.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("src").alias("dst"))
    found = graph.all_pairs(spark, hi - lo, at.join(after, ["l_orderkey", "l_linenumber"]).select("src", "dst"), both=True)
    return found.agg(F.round(F.sum("total") / float((hi - lo) ** 2), 6).alias("average"))


# hops beyond h still to go, summed over h
@query("WITH n AS (SELECT count(*) AS n FROM customer) SELECT round(sum(greatest(n - 1 - 12 * h, 0)) / any_value(n), 6)::DOUBLE AS average FROM (SELECT n, unnest(range(n)) AS h FROM n)")
def average_distance_closed_form(spark, d):
    """On a ring each node sees the same distances, so those of one node have the mean of all pairs."""
    n = table(spark, d, "customer").count()
    return index_space(spark, (0, n)).agg(F.round(F.sum(graph.ring_distance(F.lit(0), F.col("i"), n, 6)) / float(n), 6).alias("average"))


@query("SELECT o_orderkey, round(coalesce(lag(o_totalprice) OVER w - 2 * o_totalprice + lead(o_totalprice) OVER w, 0), 2) AS lap FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def stencil_1d(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("v"))
    return stencil.laplacian_1d(o, "o_orderkey", "v", ["o_custkey"]).select("o_orderkey", F.round("lap", 2).alias("lap"))


_GRID = """q AS (SELECT l_suppkey - (SELECT min(l_suppkey) FROM lineitem) AS i, (year(l_shipdate) - 1992) * 12 + month(l_shipdate) - 1 AS j, sum(l_quantity) AS v FROM lineitem GROUP BY ALL),
m AS (SELECT max(i) + 1 AS rows, max(j) + 1 AS cols FROM q),
g AS MATERIALIZED (SELECT a.i, b.j, coalesce(v, 0) / 100.0::DOUBLE AS v FROM (SELECT unnest(range(rows)) AS i FROM m) a CROSS JOIN (SELECT unnest(range(cols)) AS j FROM m) b LEFT JOIN q ON q.i = a.i AND q.j = b.j)"""


def _grid(spark, d):
    """(cells, rows, cols): hundreds of pieces by supplier and month of shipping from January 1992 on; 0 where there are none."""
    lines = table(spark, d, "lineitem")
    lo, hi = loops.bounds(lines, "l_suppkey")
    month = ((F.year("l_shipdate") - 1992) * 12 + F.month("l_shipdate") - 1).cast("long")
    cells = lines.select((F.col("l_suppkey") - lo).cast("long").alias("i"), month.alias("j"), F.col("l_quantity").cast("double").alias("v"))
    cols = loops.bounds(cells, "j")[1]
    none = index_space(spark, (0, hi - lo), (0, cols)).withColumn("v", F.lit(0.0))
    return cells.unionByName(none).groupBy("i", "j").agg((F.sum("v") / 100.0).alias("v")), hi - lo, cols


_STEP = "(SELECT c.i, c.j, CASE WHEN c.i BETWEEN 1 AND rows - 2 AND c.j BETWEEN 1 AND cols - 2 THEN (n.v + s.v + e.v + w.v) / 4 ELSE c.v END AS v FROM {t} c CROSS JOIN m LEFT JOIN {t} n ON n.i = c.i + 1 AND n.j = c.j LEFT JOIN {t} s ON s.i = c.i - 1 AND s.j = c.j LEFT JOIN {t} e ON e.i = c.i AND e.j = c.j + 1 LEFT JOIN {t} w ON w.i = c.i AND w.j = c.j - 1)"


def _steps_sql(k: int) -> str:
    names = ["g", *(f"g{x}" for x in range(1, k + 1))]
    ctes = ", ".join(f"{new} AS MATERIALIZED {_STEP.format(t=old)}" for old, new in zip(names, names[1:], strict=False))
    return f"WITH {_GRID}, {ctes} SELECT i, j, round(v, 10) AS v FROM {names[-1]}"


@query(_steps_sql(1))
def stencil_2d(spark, d):
    return stencil.jacobi_step(*_grid(spark, d)).withColumn("v", F.round("v", 10))


@query(_steps_sql(4))
def jacobi_k_steps(spark, d):
    cells, rows, cols = _grid(spark, d)
    state, _ = iterate.iterate(cells, lambda s: stencil.jacobi_step(s, rows, cols), most=4, every=2)
    return state.withColumn("v", F.round("v", 10))


@query(f"WITH {_GRID} SELECT round(sum(c.v * c.v * (1 - c.v) * (1 - c.v) + 0.5 * (((n.v - s.v) / 2) ** 2 + ((e.v - w.v) / 2) ** 2)), 4) AS energy FROM g c JOIN g n ON n.i = c.i + 1 AND n.j = c.j JOIN g s ON s.i = c.i - 1 AND s.j = c.j JOIN g e ON e.i = c.i AND e.j = c.j + 1 JOIN g w ON w.i = c.i AND w.j = c.j - 1")
def free_energy(spark, d):
    return stencil.free_energy(*_grid(spark, d)).withColumn("energy", F.round("energy", 4))


@query(f"WITH {_GRID} SELECT i, j, round(4 * v * v * v - 6 * v * v + 2 * v, 8) AS v FROM g")
def dfdc(spark, d):
    return _grid(spark, d)[0].select("i", "j", F.round(stencil.dfdc(F.col("v")), 8).alias("v"))


@query("SELECT round(sum(l_extendedprice), 2) AS total, max(l_extendedprice) AS most, min(l_extendedprice) AS least FROM lineitem")
def field_progress(spark, d):
    x = "l_extendedprice"
    return table(spark, d, "lineitem").agg(F.round(F.sum(x), 2).alias("total"), F.max(x).alias("most"), F.min(x).alias("least"))


@query("SELECT a.p_partkey::BIGINT AS i, round(sum(a.p_retailprice * b.p_size), 2) AS y FROM part a JOIN part b ON b.p_partkey BETWEEN a.p_partkey - 1 AND a.p_partkey + 1 GROUP BY 1")
def banded_row(spark, d):
    """A matrix of three diagonals, prices by part, times the sizes."""
    parts = table(spark, d, "part")
    lo, hi = loops.bounds(parts, "p_partkey")
    band = loops.nested(parts.select(F.col("p_partkey").cast("long").alias("i"), F.col("p_retailprice").alias("v")), "j", F.greatest(F.col("i") - 1, F.lit(lo)), F.least(F.col("i") + 1, F.lit(hi - 1)), inclusive=True)
    y = sparse.spmv(band, parts.select(F.col("p_partkey").cast("long").alias("j"), F.col("p_size").cast("double").alias("x")))
    return y.select("i", F.round("y", 2).alias("y"))


TRADE = "t AS (SELECT c_nationkey AS i, s_nationkey AS j, count(*)::DOUBLE AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"


def trade(spark, d):
    """Lines between customers of nation i and suppliers of nation j."""
    who = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").cast("long").alias("i"))
    by = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("j"))
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("n"))
    found = lines.join(who, F.col("l_orderkey") == F.col("o_orderkey")).join(by, F.col("l_suppkey") == F.col("s_suppkey"))
    return found.groupBy("i", "j").agg(F.sum("n").cast("double").alias("v"))


@query(f"""
WITH RECURSIVE {TRADE}, ids AS (SELECT DISTINCT i FROM (SELECT i FROM t UNION ALL SELECT j FROM t)),
o AS (SELECT i, row_number() OVER (ORDER BY i) AS r FROM ids),
a AS MATERIALIZED (SELECT list(row ORDER BY r) AS a FROM (SELECT x.r, list(coalesce(t.v, 0) ORDER BY y.r) AS row FROM o x CROSS JOIN o y LEFT JOIN t ON t.i = x.i AND t.j = y.i GROUP BY x.r)),
p(k, x) AS (SELECT 0, list_transform(a, lambda row: 1.0::DOUBLE) FROM a UNION ALL SELECT k + 1, list_transform(y, lambda v: v / list_max(y)) FROM (SELECT k, list_transform(a, lambda row: list_inner_product(row, x)) AS y FROM p, a WHERE k < 100))
SELECT round(list_inner_product(x, list_transform(a, lambda row: list_inner_product(row, x))) / list_inner_product(x, x), 4) AS eigenvalue FROM p, a WHERE k = 100
""")
def power_iteration(spark, d):
    """The largest eigenvalue of the matrix of trade between nations."""
    _, largest, _ = linalg.power_iteration(trade(spark, d))
    return spark.range(1).select(F.round(F.lit(largest), 4).alias("eigenvalue"))


# ---- scalar functions and region rules

@query("SELECT s_suppkey, round(CASE WHEN q < 1 THEN 1 - 1.5 * q * q + 0.75 * q * q * q WHEN q < 2 THEN 0.25 * (2 - q) ** 3 ELSE 0 END, 8) AS w FROM (SELECT s_suppkey, (s_suppkey % 30) / 10.0::DOUBLE AS q FROM supplier)")
def piecewise_kernel(spark, d):
    q = (F.col("s_suppkey") % 30) / 10.0
    return table(spark, d, "supplier").select("s_suppkey", F.round(points.cubic_spline(q), 8).alias("w"))


_REGIONS = [(0, 0.0, 30.0, 1.0), (1, 10.0, 20.0, 2.0), (2, 20.0, 25.0, 3.0)]


@query("WITH r(no, lo, hi, v) AS (VALUES (0, 0.0, 30.0, 1.0), (1, 10.0, 20.0, 2.0), (2, 20.0, 25.0, 3.0)) SELECT p_partkey, arg_max(r.v, no)::DOUBLE AS v FROM part LEFT JOIN r ON p_size BETWEEN lo AND hi GROUP BY 1")
def region_assign_last(spark, d):
    return scalar.assign_regions(table(spark, d, "part"), "p_partkey", "p_size", _REGIONS)


@query("SELECT p_partkey, round(CASE p_partkey % 3 WHEN 0 THEN pi() * p_size * p_size WHEN 1 THEN p_size * p_size ELSE 0.5 * p_size * (p_size + 1) END, 6) AS area FROM part")
def shape_area(spark, d):
    kind = F.element_at(F.array(F.lit("circle"), F.lit("square"), F.lit("triangle")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", F.round(scalar.shape_area(kind, F.col("p_size"), F.col("p_size") + 1), 6).alias("area"))


@query("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN NULL ELSE round(sqrt(s_acctbal), 6) END AS root, round(abs(s_acctbal), 2) AS size, s_suppkey // 7 AS whole, s_suppkey % 7 AS rest, greatest(s_acctbal, 0.0) AS up, least(s_acctbal, 0.0) AS down FROM supplier")
def scalar_functions(spark, d):
    b, k = F.col("s_acctbal"), F.col("s_suppkey")
    return table(spark, d, "supplier").select("s_suppkey", F.when(b >= 0, F.round(F.sqrt(b), 6)).alias("root"), F.round(F.abs(b), 2).alias("size"), F.call_function("div", k, F.lit(7)).alias("whole"), (k % 7).alias("rest"), F.greatest(b, F.lit(0.0)).alias("up"), F.least(b, F.lit(0.0)).alias("down"))


# the error function by its power series, of 80 terms
@query("""
WITH c AS (SELECT a.range AS age, p.range AS pos, p.range * 5000.0 / (2 * sqrt(1e-6 * a.range * 1e7 * 365 * 86400)) AS x FROM range(1, 13) a, range(40) p),
s AS (SELECT age, pos, x, list_reduce(list_transform(range(80), lambda n: (CASE WHEN n % 2 = 0 THEN 1.0 ELSE -1.0 END) * x ** (2 * n + 1) / gamma(n + 1.0) / (2 * n + 1)), lambda a, b: a + b) * 2 / sqrt(pi()) AS erf FROM c WHERE x < 3.5),
t AS (SELECT age, pos, 1350 * erf AS t FROM s), l AS (SELECT age, min(pos) AS last FROM t WHERE t >= 0.995 * 1350 GROUP BY age)
SELECT age, pos, round(t, 5) AS t FROM t LEFT JOIN l USING (age) WHERE last IS NULL OR pos <= last
""")
def erf_profile(spark, d):
    """Temperatures of a cooling half space: depth by age, cut where the mantle's temperature is reached."""
    return scalar.halfspace_cooling(spark, depths=40, ages=12).withColumn("t", F.round("t", 5))


@query("SELECT o_orderkey, unnest(string_split(o_orderpriority, '-')) AS piece, generate_subscripts(string_split(o_orderpriority, '-'), 1)::INTEGER - 1 AS pos FROM orders")
def split_texts(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.posexplode(scalar.split(F.col("o_orderpriority"), "-")).alias("pos", "piece"))


@query("SELECT p_partkey, unnest([p_size::DOUBLE, p_retailprice, 0.0, -0.5]) AS v, unnest([0, 1, 2, 3])::INTEGER AS pos FROM part")
def extract_lists(spark, d):
    """Sizes and prices written as a list with a word and a number with a unit behind them, read back."""
    text = F.concat(F.lit("["), F.col("p_size").cast("string"), F.lit(", "), F.col("p_retailprice").cast("string"), F.lit(",none, -.5mm]"))
    return table(spark, d, "part").select("p_partkey", F.posexplode(scalar.extract_list(text)).alias("pos", "v"))
