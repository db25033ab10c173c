import random

from tidewake.llm.components import connected_components


def test_components_match_union_find(spark):
    rng = random.Random(4)
    edges = [(i, rng.randrange(i)) for i in range(1, 300) if rng.random() < 0.7]
    edges += [(1000, 1001 + i) for i in range(200)] + [(2000 + i, 2001 + i) for i in range(30)] + [(5, 5), (None, 3), (7, None), (1000, 1001)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in list(parent)}


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
