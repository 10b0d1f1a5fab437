import random

import pytest

from axisloom.operators import dist, mesh


def shown(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def drawn(parts, seed=4):
    """Elements of several nodes, some in two parts, some nodes null."""
    r = random.Random(seed)
    rows = [(r.randrange(parts), e, r.choice([None, *range(60)]) if r.random() < 0.1 else r.randrange(60)) for e in range(150) for _ in range(r.randrange(1, 6))]
    own = {}
    return [(own.setdefault(e, p) if r.random() < 0.97 else p, e, n) for p, e, n in rows]


@pytest.mark.parametrize("parts", [3, 63, 140])
def test_ghosts_of_few_and_of_many_parts(spark, parts):
    rows = drawn(parts)
    e = spark.createDataFrame(rows, "part long, elem long, node long").repartition(5)
    want = {(p, b) for p, _, n in rows for q, b, m in rows if n is not None and n == m and p != q}
    got = [(x.part, x.elem) for x in dist.ghost_elements(e).collect()]
    assert sorted(got) == sorted(want)
    own = {(p, n) for p, _, n in rows if n is not None}
    owners = {}
    for p, b in want:
        for q, c, n in rows:
            if b == c and (p, n) not in own:
                owners[p, n] = max(q, owners.get((p, n), q))
    got = {(x.part, x.node): x.owner for x in dist.ghost_nodes(e).collect()}
    assert got == owners


def test_ghosts_are_words_of_bits(spark):
    """No aggregate has a key of pairs of a part and an element or node."""
    e = spark.createDataFrame(drawn(5), "part long, elem long, node long")
    for made in (dist.ghost_elements(e), dist.ghost_nodes(e)):
        keys = [line.split("[", 1)[1] for line in shown(made).splitlines() if "Aggregate [" in line]
        assert keys and not any(k.startswith(("part#", "_p#")) and "#" in k.split("]")[0].partition(",")[2] for k in keys)


def test_adjacent_elements_are_paired_last(spark):
    """Elements that share several nodes are one pair, without a shuffle or aggregate of pairs."""
    rows = [(e, n) for _, e, n in drawn(3)] + [(None, 1), (500, 1), (500, 1), (501, 1)]
    e = spark.createDataFrame(rows, "elem long, node long").repartition(5)
    made = mesh.element_adjacency(e)
    want = {(a, b) for a, n in rows for b, m in rows if n is not None and n == m and None not in (a, b) and a != b}
    assert sorted((x.elem, x.other) for x in made.collect()) == sorted(want)
    assert "Aggregate" not in shown(made).split("Join Inner")[0]
