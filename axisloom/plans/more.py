"""Dense systems, growing ragged arrays, weighted distances, random fields, and steps held against SQL of their own."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from axisloom.operators import arrays, graph, hydro, kernels, linalg, ragged
from axisloom.operators.iterate import saved
from axisloom.operators.loops import index_space
from axisloom.plans import fields
from axisloom.plans.base import query, table

# ---- a 4 by 4 matrix for each supplier, by expressions and by blocks


def _cell(r: int, c: int):
    k = F.col("s_suppkey")
    return (k % (3 + r) + (c + 1) * (5 if r == c else 1) + (k % 7 if r == c else 0)).cast("double")


_M = [[f"(s_suppkey % {3 + r} + {(c + 1) * (5 if r == c else 1)} + {'s_suppkey % 7' if r == c else '0'})::DOUBLE" for c in range(4)] for r in range(4)]


def _sum_of_permutations(m: list[list[str]]) -> str:
    """The determinant as signed products over all permutations."""
    n = len(m)
    odd = lambda p: sum(p[a] > p[b] for a, b in itertools.combinations(range(n), 2)) % 2
    return " ".join(f"{'-' if odd(p) else '+'} {'*'.join(m[r][p[r]] for r in range(n))}" for p in itertools.permutations(range(n)))


_D4 = f"({_sum_of_permutations(_M)})"


def _matrices(spark, d):
    cells = [F.struct(F.lit(r).cast("long").alias("i"), F.lit(c).cast("long").alias("j"), _cell(r, c).alias("v")) for r in range(4) for c in range(4)]
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("block"), F.explode(F.array(*cells)).alias("x")).select("block", "x.*")


@query(f"SELECT s_suppkey, round({_D4}, 6) AS det FROM supplier")
def det4(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", F.round(linalg.determinant([[_cell(r, c) for c in range(4)] for r in range(4)]), 6).alias("det"))


def _inverse_sql(r: int, c: int) -> str:
    """Cell (r, c) of the inverse: the minor without row c and column r, signed, over the determinant."""
    minor = _sum_of_permutations([[x for k, x in enumerate(row) if k != r] for n, row in enumerate(_M) if n != c])
    return f"round({'-' if (r + c) % 2 else ''}({minor}) / {_D4}, 6)"


@query("SELECT s_suppkey, " + ", ".join(f"{_inverse_sql(r, c)} + 0.0 AS x{r}{c}" for r in range(4) for c in range(4)) + f" FROM supplier WHERE abs({_D4}) > 0.5")
def inv4(spark, d):
    a = [[_cell(r, c) for c in range(4)] for r in range(4)]
    x = linalg.inv4(a)
    found = table(spark, d, "supplier").where(F.abs(linalg.determinant(a)) > 0.5)
    return found.select("s_suppkey", *((F.round(x[r][c], 6) + 0.0).alias(f"x{r}{c}") for r in range(4) for c in range(4)))


@query(" UNION ALL ".join(f"SELECT s_suppkey AS block, {r}::BIGINT AS i, {c}::BIGINT AS j, {_inverse_sql(r, c)} + 0.0 AS v FROM supplier WHERE abs({_D4}) > 0.5" for r in range(4) for c in range(4)))
def lu_inverse(spark, d):
    regular = linalg.block_determinants(_matrices(spark, d)).where("abs(det) > 0.5").select("block")
    return linalg.invert_blocks(_matrices(spark, d)).join(regular, "block", "left_semi").withColumn("v", F.round("v", 6) + 0.0)


@query(f"SELECT s_suppkey AS block, round({_D4}, 4) + 0.0 AS det FROM supplier")
def lu_determinant(spark, d):
    return linalg.block_determinants(_matrices(spark, d)).withColumn("det", F.round("det", 4) + 0.0)


@query(f"SELECT s_suppkey AS block, round(abs({_D4}), 4) AS det FROM supplier")
def qr_determinant(spark, d):
    """R's diagonal gives the size; its sign is lost."""
    return linalg.block_determinants(_matrices(spark, d), "qr").withColumn("det", F.round("det", 4))


# ---- ragged arrays: down, of vectors, growing up to a capacity

_SLOT = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) - 1"


def _slots(spark, d):
    return ragged.with_positions(table(spark, d, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_quantity"])


@query("SELECT l_partkey AS col, array_to_string(list(l_orderkey ORDER BY l_orderkey, l_linenumber), ',') AS vals FROM lineitem GROUP BY 1")
def ragged_down_pack(spark, d):
    lines = ragged.with_positions(table(spark, d, "lineitem"), "l_partkey", [F.col("l_orderkey"), F.col("l_linenumber")])
    packed = ragged.pack_down(lines.select(F.col("l_partkey").alias("col"), "pos", F.col("l_orderkey").alias("v")))
    return packed.withColumn("vals", F.array_join(F.col("vals").cast("array<string>"), ","))


@query(f"WITH e AS (SELECT l_orderkey AS row, {_SLOT} AS pos, l_quantity AS a, l_partkey::DOUBLE AS b FROM lineitem) SELECT row, count(*) AS stride, round(sum(a * (pos + 1)), 4) AS a, round(sum(b * (pos + 1)), 4) AS b FROM e GROUP BY row")
def ragged_vectors_pack(spark, d):
    """Each slot holds a vector of two; moments of both components by slot."""
    cells = _slots(spark, d).select(F.col("l_orderkey").alias("row"), "pos", F.posexplode(F.array(F.col("l_quantity").cast("double"), F.col("l_partkey").cast("double"))).alias("k", "v"))
    moment = lambda k: F.round(F.aggregate(F.transform("vals", lambda x, i: x[k] * (i + 1)), F.lit(0.0), lambda a, x: a + x), 4)
    return ragged.pack_vectors(cells, "row", "pos", ["k"], "v", [2]).select("row", F.size("vals").cast("long").alias("stride"), moment(0).alias("a"), moment(1).alias("b"))


@query(f"WITH e AS (SELECT l_orderkey AS row, {_SLOT} AS pos, l_quantity AS a, l_linenumber AS b FROM lineitem) SELECT row, round(sum(a * a), 4) AS aa, round(sum(a * b), 4) AS ab, round(sum(b * a), 4) AS ba, 0.0::DOUBLE AS bb FROM e GROUP BY row")
def ragged_tensors_pack(spark, d):
    """Each slot holds a 2 by 2 tensor whose last cell is never written."""
    a, b = F.col("l_quantity").cast("double"), F.col("l_linenumber").cast("double")
    parts = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(m).alias("m"), v.alias("v")) for k, m, v in ((0, 0, a * a), (0, 1, a * b), (1, 0, b * a))))
    cells = _slots(spark, d).select(F.col("l_orderkey").alias("row"), "pos", F.explode(parts).alias("x")).select("row", "pos", "x.*")
    total = lambda n: F.round(F.aggregate(F.transform("vals", lambda x: x[n]), F.lit(0.0), lambda s, x: s + x), 4)
    return ragged.pack_vectors(cells, "row", "pos", ["k", "m"], "v", [2, 2]).select("row", *(total(n).alias(c) for n, c in enumerate(("aa", "ab", "ba", "bb"))))


@query(f"WITH e AS (SELECT l_orderkey AS row, {_SLOT} AS pos, l_partkey AS v FROM lineitem) SELECT row, pos, v FROM e UNION ALL SELECT row, max(pos) + 1, -1 FROM e GROUP BY row")
def ragged_append_capacity(spark, d):
    """One more element behind each row, within a capacity that no row reaches."""
    lines = _slots(spark, d).select(F.col("l_orderkey").alias("row"), "pos", F.col("l_partkey").alias("v"))
    more = lines.select("row").distinct().select("row", F.lit(0).alias("ord"), F.lit(-1).cast("long").alias("v"))
    return ragged.append(lines, more, "row", 1 << 20)


# ---- graphs and random fields


@query(f"""
WITH RECURSIVE {fields.TRADE}, u AS (SELECT a, b, min(v) AS w FROM (SELECT i AS a, j AS b, v FROM t UNION ALL SELECT j, i, v FROM t) GROUP BY 1, 2),
n AS (SELECT a, row_number() OVER (ORDER BY a) - 1 AS k FROM (SELECT DISTINCT a FROM u)),
r(k, src, dst, dist) AS (
  SELECT 0, x.a, y.a, CASE WHEN x.a = y.a THEN 0.0 ELSE coalesce(w, 1e18) END::DOUBLE FROM n x CROSS JOIN n y LEFT JOIN u ON u.a = x.a AND u.b = y.a
  UNION ALL
  SELECT r.k + 1, r.src, r.dst, least(r.dist, x.dist + y.dist) FROM r JOIN n ON n.k = r.k JOIN r x ON x.src = r.src AND x.dst = n.a JOIN r y ON y.src = n.a AND y.dst = r.dst
) SELECT src::BIGINT AS src, dst::BIGINT AS dst, dist FROM r WHERE k = (SELECT count(*) FROM n) AND dist < 1e18
""")
def weighted_distances(spark, d):
    """Ways between nations over the rarest trade: an edge weighs as many as there are lines of the rarer direction."""
    one = saved(fields.trade(spark, d).select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col("v").alias("w")))
    return graph.distances(one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")), "w")


@query("SELECT count(*) AS n, true AS inside, true AS spread, true AS again FROM part")
def random_field(spark, d):
    """Numbers drawn by seed and place: within bounds, with the mean and the variance of an even spread, and the same when drawn again."""
    a = arrays.DenseArray(table(spark, d, "part").select(F.col("p_partkey").alias("i"), F.lit(0.0).alias("v")), (1,))
    x, y = arrays.randomize(a.df, ["i"], 7, -2.0, 4.0), arrays.randomize(a.df, ["i"], 7, -2.0, 4.0).withColumnRenamed("v", "w")
    found = x.join(y, "i").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("mean"), F.var_pop("v").alias("var"), F.count_if(F.col("v") != F.col("w")).alias("other"))
    far = 6 * 3.0 / F.sqrt(F.col("n"))
    return found.select("n", ((F.col("lo") >= -2) & (F.col("hi") < 4)).alias("inside"), ((F.abs(F.col("mean") - 1) < far) & (F.abs(F.col("var") - 3) < 2 * far)).alias("spread"), (F.col("other") == 0).alias("again"))


# ---- one step of the gas and of the spectral solver against the same sums in SQL

_CELLS = 40
_TUBE = f"n0 AS (SELECT range AS i, range / {_CELLS}.0::DOUBLE AS x, 0.0::DOUBLE AS u FROM range({_CELLS} + 1)), c0 AS (SELECT range AS i, CASE WHEN range < {_CELLS // 2} THEN 1.0 ELSE 0.125 END / {_CELLS}::DOUBLE AS m, CASE WHEN range < {_CELLS // 2} THEN 2.5 ELSE 2.0 END::DOUBLE AS e FROM range({_CELLS}))"


def _state_sql(nodes: str, cells: str) -> str:
    return f"""(SELECT c.i, c.m, c.e, a.x AS x0, b.x AS x1, 0.4 * c.m / (b.x - a.x) * c.e + c.m / (b.x - a.x) * (2 * least(b.u - a.u, 0) ** 2 - sqrt(1.4 * 0.4 * c.e) * least(b.u - a.u, 0)) AS f,
    sqrt(1.4 * 0.4 * c.e) + abs(b.u - a.u) AS speed FROM {cells} c JOIN {nodes} a ON a.i = c.i JOIN {nodes} b ON b.i = c.i + 1)"""


def _stage_sql(no: int, nodes: str, cells: str, share: str) -> str:
    """Nodes and cells from the first ones over a share of dt, by the forces of the given ones; ends stand still."""
    s = _state_sql(nodes, cells)
    return f"""s{no} AS {s}, n{no} AS (SELECT n.i, n.x + {share} * dt * (n.u + v) / 2 AS x, v AS u, (n.u + v) / 2 AS mean FROM (
      SELECT n.i, n.x, n.u, dt, CASE WHEN l.i IS NULL OR r.i IS NULL THEN 0.0 ELSE n.u + {share} * dt * (l.f - r.f) / ((l.m + r.m) / 2) END AS v
      FROM n0 n CROSS JOIN t LEFT JOIN s{no} l ON l.i = n.i - 1 LEFT JOIN s{no} r ON r.i = n.i) n),
    c{no} AS (SELECT c.i, c.m, c.e - {share} * dt * s.f * (b.mean - a.mean) / c.m AS e FROM c0 c CROSS JOIN t JOIN s{no} s ON s.i = c.i JOIN n{no} a ON a.i = c.i JOIN n{no} b ON b.i = c.i + 1)"""


@query(f"WITH {_TUBE}, t AS (SELECT 0.3 * min((x1 - x0) / (speed + 1e-12)) AS dt FROM {_state_sql('n0', 'c0')}), {_stage_sql(1, 'n0', 'c0', '0.5')}, {_stage_sql(2, 'n1', 'c1', '1.0')} SELECT c.i AS cell, round(a.x, 9) AS x, round(a.u, 9) + 0.0 AS u, round(c.e, 9) AS e FROM c2 c JOIN n2 a ON a.i = c.i")
def hydro_step(spark, d):
    """A whole step of the shock tube: left ends, their velocities and energies of the cells."""
    nodes, cells = hydro.initial(spark, _CELLS)
    nodes, cells, _ = hydro.advance(nodes, cells, 1.0)
    both = cells.join(nodes.withColumnRenamed("node", "cell"), "cell")
    return both.select("cell", F.round("x", 9).alias("x"), (F.round("u", 9) + 0.0).alias("u"), F.round("e", 9).alias("e"))


_SIDE = 8
_WAVE = f"CASE WHEN {{0}} < {_SIDE // 2} THEN {{0}} ELSE {{0}} - {_SIDE} END * 2 * pi() / {_SIDE}"


@query(f"""
WITH g AS (SELECT a.range AS i, b.range AS j, (((a.range * {_SIDE} + b.range) * 37) % 64) / 64.0::DOUBLE AS v FROM range({_SIDE}) a, range({_SIDE}) b),
k AS (SELECT a.range AS p, b.range AS q, ({_WAVE.format('a.range')}) ** 2 + ({_WAVE.format('b.range')}) ** 2 AS k2 FROM range({_SIDE}) a, range({_SIDE}) b),
h AS (SELECT p, q, k2, sum(v * cos(2 * pi() * (p * i + q * j) / {_SIDE})) AS c, -sum(v * sin(2 * pi() * (p * i + q * j) / {_SIDE})) AS s,
  sum((4 * v ** 3 - 6 * v ** 2 + 2 * v) * cos(2 * pi() * (p * i + q * j) / {_SIDE})) AS fc, -sum((4 * v ** 3 - 6 * v ** 2 + 2 * v) * sin(2 * pi() * (p * i + q * j) / {_SIDE})) AS fs FROM k, g GROUP BY p, q, k2),
n AS (SELECT p, q, (c - 0.01 * k2 * fc) / (1 + 0.01 * k2 * k2) AS c, (s - 0.01 * k2 * fs) / (1 + 0.01 * k2 * k2) AS s FROM h)
SELECT 0::BIGINT AS grid, i, j, round(sum(c * cos(2 * pi() * (p * i + q * j) / {_SIDE}) - s * sin(2 * pi() * (p * i + q * j) / {_SIDE})) / {_SIDE * _SIDE}, 8) AS v FROM n, g GROUP BY i, j
""")
def spectral_step(spark, d):
    """Every cell of a spectral step of 8 by 8 cells, against sums of waves."""
    v = (((F.col("i") * _SIDE + F.col("j")) * 37) % 64) / 64.0
    grid = index_space(spark, (0, _SIDE), (0, _SIDE)).select(F.lit(0).cast("long").alias("grid"), "i", "j", v.alias("v"))
    return kernels.spectral_step(grid, _SIDE, 0.01).withColumn("v", F.round("v", 8))


_CUBE = "range // 100 AS i, (range // 10) % 10 AS j, range % 10 AS k"
_INSIDE = "CASE WHEN 0.49 - ((i * 0.2 - 1 + 0.2 * (c & 1)) ** 2 + (j * 0.2 - 1 + 0.2 * ((c >> 1) & 1)) ** 2 + (k * 0.2 - 1 + 0.2 * (c >> 2)) ** 2) > 0 THEN 1 ELSE 0 END"


@query(f"""
WITH t(no, c) AS (VALUES {', '.join(f'({no}, {c})' for no, (a, b) in enumerate(itertools.permutations(range(3), 2)) for c in (0, 1 << a, (1 << a) + (1 << b), 7))}),
u AS (SELECT range AS cell, no, sum({_INSIDE}) AS up FROM (SELECT range, {_CUBE} FROM range(1000)) x, t GROUP BY 1, 2)
SELECT cell, sum(CASE up WHEN 2 THEN 2 ELSE 1 END)::BIGINT AS n FROM u WHERE up BETWEEN 1 AND 3 GROUP BY cell
""")
def isosurface_counts(spark, d):
    """Triangles in each cube of the sphere's surface, as the signs at the corners of six tetrahedra ask for."""
    from axisloom.plans.blocks import isosurface

    return isosurface(spark, d).groupBy("cell").agg(F.count("*").alias("n"))
