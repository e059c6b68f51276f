"""Hard negatives against brute force."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import numpy as np
import pytest

from knotwork.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, row string, block string, windows string, v int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "r", "b", "w", 1) for r in rows], SCHEMA)


def whole(v):
    return tuple(math.floor(256 * float(np.float32(x))) for x in v)


def brute(rows, every):
    taken = {(i, lab, whole(v)) for i, v, lab in rows if None not in (i, lab, v) and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for i, lab, q in taken:
        if i % every:
            continue
        score = lambda o: max(-H.LONG, min(H.LONG, sum(a * b for a, b in zip(q, o[2], strict=True))))  # noqa: B023, E731
        others = [(score(o), o) for o in taken if o[0] != i and len(o[2]) == len(q)]
        others.sort(key=lambda s: (-s[0], s[1][0]))
        for p, pos in [s for s in others if s[1][1] == lab][: H.POSITIVES]:
            fits = [(s, o) for s, o in others if o[1] != lab and 30 * p <= 100 * s <= 90 * p][: H.NEGATIVES]
            out |= {(i, pos[0], n + 1, o[0], p, s) for n, (s, o) in enumerate(fits)}
    return out


def made(n=700, seed=1):
    pick, rng = random.Random(seed), np.random.default_rng(seed)
    centres = rng.standard_normal((6, 12))
    rows = [(i, [float(np.float32(x)) for x in 0.4 * centres[pick.randrange(6)] + 0.2 * rng.standard_normal(12)], pick.randrange(4)) for i in range(n)]
    copy = rows[20][1]
    rows += [(1000 + i, copy, i % 3) for i in range(60)]  # ties
    rows += [(2000 + i, [0.1 * (i % 7), -0.3], i % 2) for i in range(30)]  # another length
    rows += [(3000, None, 1), (3010, [None, 1.0], 1), (3020, [float("nan")] * 12, 1), (3030, [float("inf")] * 12, 2), (None, copy, 1), (3040, copy, None), (3050, [], 1), (3051, [], 1), (3060, [0.0] * 12, 1)]
    rows += [(3070, [1e9] * 12, 1), (3071, [2e9] * 12, 1), (3072, [1e9] * 12, 2), (3073, [3e30] * 12, 3)]  # beyond exact doubles, beyond longs
    return rows + rows[:20]


@pytest.mark.parametrize("least", [25, 10_000])
def test_mine(spark, monkeypatch, least):
    monkeypatch.setattr(H, "LEAST_ROWS", least)
    monkeypatch.setattr(H, "ENOUGH_BLOCKS", 1 << 20)
    rows = made()
    got = [tuple(r) for r in H.mine(table(spark, rows), "id % 10 = 0").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 10)
    assert len({r[0] for r in got}) > 50


def test_one_id_two_vectors(spark):
    rows = [(10, [1.0, 0.0], 1), (10, [0.0, 1.0], 1), (11, [0.5, 0.0], 1), (12, [0.4, 0.0], 2), (13, [0.0, 0.4], 2), (14, [0.0, 0.5], 1)]
    got = {tuple(r) for r in H.mine(table(spark, rows), "id = 10").collect()}
    assert got == brute(rows, 10) and {(r[0], r[1], r[3]) for r in got} == {(10, 11, 12), (10, 14, 13)}


def test_empty(spark, tmp_path):
    table(spark, [(0, [1.0], 1)]).limit(0).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert H.op12_hard_negatives(spark, str(tmp_path)).count() == 0


def test_index_is_exact_and_prunes():
    rng = np.random.default_rng(2)
    x = np.floor(256 * rng.standard_normal((2000, 24)) * np.linspace(1, 0.05, 24))
    block = H.Block(np.arange(2000), np.zeros(2000, np.int64), x)
    q = x[:5]
    scores = q @ x.T
    for t in (0.9, 0.5, 0.1, -1.0):
        least = t * (q * q).sum(1)
        a, r, s = block.pairs(q, least)
        by_pair = defaultdict(int, {(i, j): int(v) for i, j, v in zip(a, block.ids[r], s, strict=True)})
        want = {(i, j): int(scores[i, j]) for i in range(5) for j in range(2000) if scores[i, j] >= least[i]}
        assert by_pair == want
