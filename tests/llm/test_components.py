"""Connected components against union by hand, in one task and in rounds."""

import random

import pytest

from flowlab.llm.components import components, joined_components


def by_hand(edges):
    parent = {}

    def top(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = top(a), top(b)
        parent[max(x, y)] = min(x, y)
    return {x: top(x) for x in list(parent)}


def graphs():
    rnd = random.Random(2)
    path = list(range(60))
    rnd.shuffle(path)
    yield list(zip(path, path[1:]))
    yield [(0, k) for k in range(1, 90)] + [(1000 + k, 2000) for k in range(80)] + [(k, k + 1) for k in range(3000, 3100, 2)]
    yield [(rnd.randrange(400), rnd.randrange(400)) for _ in range(180)] + [(5, 6)] * 10


@pytest.mark.parametrize("few", [10**6, 0])
def test_components(spark, few):
    for edges in graphs():
        expected = {k: v for k, v in by_hand([e for e in edges if e[0] != e[1]]).items()}
        got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long"), few).collect()}
        assert got == expected
    assert components(spark.createDataFrame([], "a long, b long"), few).count() == 0


def test_added_edges_join_old_components(spark):
    first = [(1, 2), (3, 4), (8, 9)]
    labels = components(spark.createDataFrame(first, "a long, b long"))
    more = [(2, 3), (5, 6), (1, 4)]
    got = {r.node: r.comp for r in joined_components(labels, spark.createDataFrame(more, "a long, b long")).collect()}
    assert got == by_hand(first + more)
