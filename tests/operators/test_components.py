import random

import pytest

from lakewright.operators import components


@pytest.mark.parametrize("one_task", [0, 1_000_000])
def test_components_are_brute_force(spark, monkeypatch, one_task):
    monkeypatch.setattr(components, "ONE_TASK", one_task)
    rnd = random.Random(0)
    edges = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(60)] + [(200, 200), (300, 301), (301, 302), (302, 303), (303, 304), (None, 3), (2**60 + 1, 2**60)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
