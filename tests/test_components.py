import random

import pytest

from quire.operators.components import connected_components


def test_components_match_union_find(spark):
    random.seed(4)
    links = [(i, i + 1) for i in range(60)] + [(random.randrange(100, 200), random.randrange(100, 200)) for _ in range(60)] + [(500, 501), (501, 500), (7, 7), (None, 3)]
    parent: dict[int, int] = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_unfinished_components_are_an_error(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    with pytest.raises(RuntimeError):
        connected_components(chain, rounds=1)
