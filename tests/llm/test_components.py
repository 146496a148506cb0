import random

import pytest

from tessera.llm.components import connected_components


@pytest.mark.parametrize("seed", range(2))
def test_same_as_union_find(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range([60, 170][seed])] + [(i, i + 1) for i in range(300, 340)] + [(500, 500 + i) for i in range(50)] + [(7, 7)]
    parent = {}

    def top(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = top(a), top(b)
            parent[max(x, y)] = min(x, y)
    got = [tuple(x) for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()]
    assert len(got) == len(parent) and dict(got) == {x: top(x) for x in list(parent)}


def test_empty(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_written_tables_are_released(spark):
    from tessera.llm import common

    common.release(spark)
    df = common.materialize(spark.range(5).selectExpr("id as a"), "five")
    assert df.count() == 5 and common.release(spark) == 1 and common.release(spark) == 0
