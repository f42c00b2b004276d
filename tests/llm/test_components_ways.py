"""Connected components with and without broadcast neighbours, against union-find."""

import random

import pytest

from provenir.llm import components as module
from provenir.llm.components import components


@pytest.mark.parametrize("most", [100_000, 0, 60])
def test_components_equal_union_find(spark, monkeypatch, most):
    monkeypatch.setattr(module, "BROADCAST_ROWS", most)
    rng = random.Random(most)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 60)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)] + [(5, 5), (None, 3), (-9, 7)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            up[b] = a
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in up}
