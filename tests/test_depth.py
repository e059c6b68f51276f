"""Depths in graphs with cycles against a straight telling of the walk."""

from __future__ import annotations

import random

import pytest

from knotwork import catalog
from knotwork.operators import graph


def straight(nodes, edges):
    """Recursive: enter a node again whenever the way to it is longer, unless it lies on the way."""
    out = {n: [b for a, b in edges if a == n and b != n and b in set(nodes)] for n in nodes}
    depth = dict.fromkeys(nodes, -1)

    def enter(node, way):
        for other in out[node]:
            if other not in way and depth[node] + 1 > depth[other]:
                depth[other] = depth[node] + 1
                enter(other, way | {other})

    for n in nodes:
        if depth[n] < 0:
            depth[n] = 0
            enter(n, {n})
    return depth


def spread(spark, nodes, edges, places=True):
    points = spark.createDataFrame([(n, i) for i, n in enumerate(nodes)], "id string, place long")
    ways = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(edges)], "src string, dst string, place long")
    points, ways = points.repartition(3), ways.repartition(3)
    return {r.id: r.depth for r in graph.cyclic_depth(points if places else points.drop("place"), ways if places else ways.drop("place")).collect()}


@pytest.mark.parametrize("seed", range(4))
def test_walks(spark, seed):
    pick = random.Random(seed)
    nodes = [f"v{i}" for i in range(26)]
    pick.shuffle(nodes)
    edges = [tuple(pick.choices(nodes, k=2)) for _ in range(34)]
    edges += edges[:3] + [("v1", "nowhere")]
    assert spread(spark, nodes, edges) == straight(nodes, edges)
    if seed == 0:
        assert spread(spark, nodes, edges, places=False) == straight(sorted(nodes), sorted(edges))


def test_published_cases(spark):
    assert spread(spark, list("ABC"), [("A", "B"), ("B", "A"), ("B", "C")]) == {"A": 0, "B": 1, "C": 2}
    ring = list("ABCDE")
    assert spread(spark, ring, [(a, ring[(i + 1) % 5]) for i, a in enumerate(ring)]) == {n: i for i, n in enumerate(ring)}
    assert spread(spark, list("AB"), [("A", "A"), ("A", "B")]) == {"A": 0, "B": 1}
    assert spread(spark, list("ABCD"), [("A", "B"), ("B", "D"), ("A", "D")]) == {"A": 0, "B": 1, "C": 0, "D": 2}
    assert spread(spark, [], []) == {}


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    nodes, edges = catalog._cycles_above_nations(spark, sf)
    want = straight(sorted(r.id for r in nodes.collect()), sorted(tuple(r) for r in edges.select("src", "dst").collect()))
    assert {r.id: r.depth for r in catalog.queries()["cyclic_depth"](spark, sf).collect()} == want


def test_weak_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40) if i != 20] + [(50, 50)], "src long, dst long")
    got = {r.id: r.component for r in graph.weak_components(spark.range(0, 52), edges).collect()}
    assert got == {i: 0 if i <= 20 else 21 if i <= 40 else i for i in range(52)}
