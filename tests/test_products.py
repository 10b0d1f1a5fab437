import numpy as np

from axisloom.operators import linalg


def test_products_of_tiles_with_few_rows_and_columns(spark):
    """Tiles that hold cells in a few rows and columns, dealt to as many tasks as there are shuffle partitions."""
    r = np.random.default_rng(8)
    a, b = np.zeros((23, 40)), np.zeros((40, 11))
    a[r.integers(0, 23, 60), r.integers(0, 40, 60)] = r.integers(1, 9, 60)
    b[r.integers(0, 40, 30), 3] = r.integers(1, 9, 30)
    b[r.integers(0, 40, 30), 9] = r.integers(1, 9, 30)
    cells = lambda x: spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)], "i long, j long, v double")
    made = linalg.matmul_blocked(cells(a), cells(b), size=8)
    got = {(x.i, x.j): x.v for x in made.collect()}
    assert got == {(i, j): v for (i, j), v in np.ndenumerate(a @ b) if v}
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression [bk") == 2
