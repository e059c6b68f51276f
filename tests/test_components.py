"""Strongly connected components: random graphs against brute force, and rings in few rounds."""

from __future__ import annotations

import random

import pytest

from knotwork.operators import graph


def brute(nodes, edges):
    reach = {n: {n} for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            new = reach[b] - reach[a]
            if new:
                reach[a] |= new
                changed = True
    return {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}


def components(spark, nodes, edges):
    points = spark.createDataFrame([(n,) for n in nodes], "id long")
    return {r.id: r.component for r in graph.strong_components(points, spark.createDataFrame(edges, "src long, dst long")).collect()}


@pytest.mark.parametrize("seed", range(5))
def test_random(spark, seed):
    pick = random.Random(seed)
    nodes = list(range(60))
    edges = [tuple(pick.choices(nodes, k=2)) for _ in range((30, 60, 75, 90, 120)[seed])]
    # Chains into, out of and between them, and rings with tails.
    edges += [(60 + i, 61 + i) for i in range(8)] + [(68, pick.randrange(60)), (pick.randrange(60), 60), (pick.randrange(60), 64)]
    edges += [(80 + i, 80 + (i + 1) % 7) for i in range(7)] + [(90, 91), (91, 83), (3, 90), (85, 85)]
    nodes = list(range(95))
    assert components(spark, nodes, edges) == brute(nodes, edges)


def test_empty(spark):
    assert components(spark, [], []) == {} and components(spark, [4, 5], [(4, 4)]) == {4: 4, 5: 5}


def test_ring_in_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(graph, "written", lambda df, name, write=graph.written: rounds.append(name) or write(df, name))
    n = 100_000
    ids = spark.range(n)
    edges = ids.selectExpr("id AS src", f"(id + 1) % {n} AS dst")
    got = graph.strong_components(ids, edges)
    assert got.where("component = 0").count() == n == got.count() and len(rounds) < 40
    assert rounds.count("chains") <= 20


def test_no_table_through_the_driver(spark, monkeypatch):
    """However small the tables of the rounds are, none is broadcast."""
    plans = []
    shown = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(graph, "written", lambda df, name, write=graph.written: plans.append(shown(df)) or write(df, name))
    edges = [(0, 1), (1, 0), (0, 2), (2, 3), (3, 0), (2, 0), (3, 2), (1, 4), (4, 5), (5, 6), (6, 4), (7, 8), (8, 9), (9, 7), (9, 8)]
    points, links = spark.range(10), spark.createDataFrame(edges, "src long, dst long")
    found = graph.strong_components(points, links)
    cyclic = graph.cyclic_edges(links, found)
    plans += [shown(found), shown(cyclic)]
    assert len(plans) > 10 and not [p for p in plans if "BroadcastHashJoin" in p or "BroadcastExchange" in p]
    want = brute(range(10), edges)
    assert {r.id: r.component for r in found.collect()} == want
    assert {(r.src, r.dst) for r in cyclic.collect()} == {e for e in edges if want[e[0]] == want[e[1]]}
