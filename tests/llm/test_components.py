"""Connected components against union-find, with as many rounds as partitions make of them."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tempora.llm import components as c


def expected(edges):
    top: dict[int, int] = {}

    def root(k: int) -> int:
        top.setdefault(k, k)
        while top[k] != k:
            top[k] = top[top[k]]
            k = top[k]
        return k

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            top[max(x, y)] = min(x, y)
    return {k: root(k) for k in list(top)}


def graphs():
    local = random.Random(1)
    n = 1500
    names = [local.randrange(-(2**62), 2**62) for _ in range(n)]
    return {
        "empty": [], "loop": [(3, 3)], "pair": [(-5, 3), (3, 9)], "path": [(i, i + 1) for i in range(n)], "shuffled path": list(zip(names, names[1:], strict=False)),
        "random": [(local.choice(names), local.choice(names)) for _ in range(n // 2)], "two stars": [(0, i) for i in range(1, n)] + [(n - 1, n + i) for i in range(n)], "tree": [(i, (i - 1) // 2) for i in range(1, n)],
        "repeated": [(1, 2), (2, 1)] * 40 + [(7, 8)],
    }


@pytest.mark.parametrize("name", sorted(graphs()))
def test_components(spark, name):
    edges = graphs()[name]
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else few edges meet in one task at once
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        rows = spark.createDataFrame(edges, "x long, y long").repartition(11)
        got = [(r.node, r.component) for r in c.components(rows, "x", "y").collect()]
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert len(got) == len(dict(got)) and dict(got) == expected(edges)


def test_stars():
    local = np.random.default_rng(2)
    a, b = local.integers(0, 300, 200), local.integers(0, 300, 200)
    node, least = c.stars(a, b)
    assert dict(zip(node.tolist(), least.tolist(), strict=True)) == {k: v for k, v in expected(zip(a.tolist(), b.tolist(), strict=True)).items() if k != v}
