import pytest
from pyspark.sql import functions as F

from axisloom.operators import mesh, ragged


def test_edges_are_told_apart_before_the_way_back(spark):
    """Half of the edges go through the shuffle, and corners are values, not lists."""
    cells = [(e, c, (e + c) * 2) for e in range(3) for c in range(8)] + [(7, c, 5) for c in range(8)] + [(8, 0, 1), (8, 1, 9)]
    df = spark.createDataFrame(cells, "elem long, lid int, node long").repartition(3)
    made = mesh.node_edges(df)
    at = {}
    for e, c, n in cells:
        at.setdefault(e, {})[c] = n
    want = {(v.get(x), v.get(y)) for v in at.values() for p in mesh.EDGES for x, y in (p, p[::-1])}
    assert sorted(map(str, ((r.a, r.b) for r in made.collect()))) == sorted(map(str, want))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "Generate" in plan.split("Aggregate")[0]
    with pytest.raises(Exception, match="corner twice"):
        mesh.node_edges(df.unionAll(df.limit(1))).collect()


def test_a_box_is_made_by_more_tasks_as_it_grows(spark, monkeypatch):
    monkeypatch.setattr(mesh, "MOST_CELLS", 10)
    assert mesh.box_mesh(spark, (5, 5, 4)).rdd.getNumPartitions() == 10


@pytest.mark.parametrize("sizes", [[2, 2], [3, 7]])
def test_slots_of_few_and_of_many_components(spark, sizes):
    cells = [(r, p, r % sizes[0], p % sizes[1], r * 10.0 - p) for r in range(4) for p in range(3)] + [(0, 0, 1, 1, 7.5), (1, 2, 0, 0, None)]
    df = spark.createDataFrame(cells, "row long, pos long, k int, m int, v double").repartition(3)
    made = ragged.pack_vectors(df, "row", "pos", ["k", "m"], "v", sizes)
    want = {}
    for r, p, k, m, v in cells:
        want.setdefault((r, p), [0.0] * (sizes[0] * sizes[1]))[k * sizes[1] + m] = v or 0.0
    assert {(x.row, p): list(c) for x in made.collect() for p, c in enumerate(x.vals)} == want
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") == (1 if sizes == [2, 2] else 2)
    for wrong in (df.unionAll(df.where("row = 0 and k = 1")), df.withColumn("m", F.lit(9))):
        with pytest.raises(Exception, match="twice|beyond|DUPLICATED_MAP_KEY|Duplicate"):
            ragged.pack_vectors(wrong, "row", "pos", ["k", "m"], "v", sizes).collect()
