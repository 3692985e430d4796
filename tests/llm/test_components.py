import random

from riskloom.llm.components import connected_components


def test_components_of_chains_stars_and_random_graphs(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, 501 + i) for i in range(300)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(250)]
    edges += [(3, 3), (None, 4), (5, None), (140, 139), (140, 139)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            lo, hi = sorted((root(a), root(b)))
            parent[hi] = lo
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for x in parent}


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0
