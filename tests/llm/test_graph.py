import random

import pytest
from llm.common import collected

from barograph.llm import graph


@pytest.mark.parametrize("part", [200_000, 40])
def test_components(spark, monkeypatch, part):
    monkeypatch.setattr(graph, "EDGES_PER_PART", part)
    rnd = random.Random(part)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(130)] + [(k, k + 1) for k in range(300, 330)]
    root = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    assert collected(graph.components(df), "node", "component") == sorted(((x, find(x)) for x in root), key=repr)
