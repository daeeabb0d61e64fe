import random

import pytest

from spanforge.llm import components as C


@pytest.mark.parametrize("few", [0, 10, 10_000])
@pytest.mark.parametrize("kind", ["chain", "star", "random", "none"])
def test_components_equal_union_find(spark, kind, few, monkeypatch):
    monkeypatch.setattr(C, "FEW", few)
    rng = random.Random(1)
    if kind == "chain":
        edges = [(i, i + 1) for i in range(60)] + [(100, 101)]
    elif kind == "star":
        edges = [(50, i) for i in range(50)] + [(9, 9), (None, 4)]
    elif kind == "random":
        edges = [(rng.randrange(-80, 80), rng.randrange(-80, 80)) for _ in range(70)] * 2
    else:
        edges = []
    part = {}

    def root(x):
        part.setdefault(x, x)
        while part[x] != x:
            x = part[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            part[max(x, y)] = min(x, y)
    got = C.components(spark.createDataFrame(edges, "a long, b long"), [])
    assert {tuple(r) for r in got.collect()} == {(x, root(x)) for x in part}
