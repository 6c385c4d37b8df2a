from __future__ import annotations

import random

import pytest

from folium.llm.common import components


@pytest.mark.parametrize("per_task", [40, 1_000_000])
def test_components_equal_a_search(spark, per_task):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(-(1 << 62) - i, (1 << 62) + i) for i in range(40)]
    edges += [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(80)] + [(7, 7), (3, 2)]
    rng.shuffle(edges)
    near: dict[int, set[int]] = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for node in sorted(near):
        front = [] if node in want else [node]
        while front:
            x = front.pop()
            if x not in want:
                want[x] = node
                front += near[x]
    got = components(spark.createDataFrame(edges, "a long, b long").repartition(8), per_task).collect()
    assert sorted(map(tuple, got)) == sorted(want.items())


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
