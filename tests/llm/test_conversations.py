"""Repair and formatting of conversations against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict
from functools import lru_cache

import pandas as pd
import pytest

from knotwork.llm import chat_format, conversation_repair as repair

SCHEMA = "conv_id long, turn long, role string, text string, key string, place int, audit string, signature string, gone boolean, formatted string"
SPACES = " \t\n\x0b\x0c\r"


def table(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, "DDD", "sss", True, "f") for r in rows], SCHEMA)


def least_edits(rows):
    """(cost, audit, repaired rows) by trying all edits; ``rows`` are (role, text, must go, truncated)."""
    ways = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @lru_cache(None)
    def best(i, last, inserted):
        found = []
        if i == len(rows) and last in ("", "a"):
            found.append((0, "", ()))
        steps = []
        if inserted < 2:
            steps += [(3, "I", i, x, (x, ""), inserted + 1) for x in ("user", "assistant")]
        if i < len(rows):
            role, text, gone, cut = rows[i]
            steps.append((4, "D", i + 1, None, None, 0))
            if not gone:
                steps += [(3 * cut, "K", i + 1, role, (role, text), 0)] + [(3 + 3 * cut, "R", i + 1, x, (x, text), 0) for x in ("user", "assistant")]
        for cost, letter, at, role, row, n in steps:
            state = last if role is None else ways.get((last, role[:1]))
            if state is not None:
                rest = best(at, state, n)
                if rest is not None:
                    found.append((cost + rest[0], letter + rest[1], (() if row is None else (row,)) + rest[2]))
        return min(found) if found else None

    return best(0, "", 0)


def damage(rows):
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        for _ in range(2 if kind == 3 else 1):
            yield conv, turn, "user" if kind == 4 else role, text


def brute(rows):
    own = defaultdict(list)
    for r in damage(rows):
        own[r[0]].append(r)
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted(own[conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, faults, judged = set(), [0, 0, 0], []
        for _, _, role, text in mine:
            said = text.rstrip(SPACES)
            fault = 0 if not said else 1 if (role, text) in seen else 2 if said[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                faults[fault] += 1
            judged.append((role, text, fault in (0, 1), fault == 2))
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        cost, audit, kept = least_edits(tuple(judged))
        text = "\n".join(f"{r}:{t}" for r, t in kept)
        out[conv] = (gaps, *faults, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def made_rows(n, seed=5):
    pick = random.Random(seed)
    texts = ["Hi.", "Hi.", "What?", "no end", "", " \n", "Déjà vu!  ", None, "x.y", "¿Sí", "a" * 20_000 + "."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "sys", "ua"]
    rows = []
    for conv in [*range(n), None]:
        for turn in range(pick.choice([0, 1, 2, 3, 4, 5, 6])):
            rows.append((conv, pick.choice([turn, turn, turn, turn * 2, None]) if conv is not None and conv % 3 else turn, pick.choice(roles), pick.choice(texts)))
    return [*rows, *rows[:7]]


def test_repair(spark, tmp_path):
    rows = made_rows(400)
    table(spark, rows).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:] for r in repair.op11_conversation_repair(spark, str(tmp_path)).collect()}
    assert got == brute(rows)
    assert {"I", "D", "K", "R"} <= set("".join(r[6] for r in got.values()))


def test_repair_table(spark):
    rows = made_rows(60, seed=9)
    reports, after = repair.repair(table(spark, rows).drop("gone"))
    audits = {r.key: r.audit for r in reports.collect()}
    assert len(audits) == len({r[0] for r in rows})
    by_key = defaultdict(list)
    for r in after.collect():
        by_key[r.key].append(r)
    for key, audit in audits.items():
        kept = sorted(by_key[key], key=lambda r: r.place)
        assert "".join(r.edit for r in kept) == audit.replace("D", "")
        walk = "".join(r.role[:1] for r in kept)
        assert walk.removeprefix("s").replace("ua", "") == "" and walk != "s"


def test_repair_all_dropped_and_empty(spark, tmp_path):
    conv = next(i for i in range(10_000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    table(spark, [(conv, 0, "user", "Hi.")]).write.parquet(f"{tmp_path}/a/conversations.parquet")
    none = hashlib.sha256(b"").hexdigest()
    assert [tuple(r) for r in repair.op11_conversation_repair(spark, f"{tmp_path}/a").collect()] == [(conv, 0, 0, 0, 0, 0, 0, "", none)]
    table(spark, [(1, 0, "user", "Hi.")]).limit(0).write.parquet(f"{tmp_path}/b/conversations.parquet")
    assert repair.op11_conversation_repair(spark, f"{tmp_path}/b").count() == 0


def test_repair_one_long_conversation(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"word {i}.") for i in range(20_000)]
    reports, after = repair.repair(table(spark, rows).drop("gone"))
    assert reports.select("cost", "audit").first() == (0, "K" * 20_000)
    assert after.count() == 20_000


def test_nodes_are_shared():
    """Signatures that share a suffix compute it once."""
    made = []
    node_before, repair.node_before = repair.node_before, lambda s, after: made.append(s) or node_before(s, after)
    try:
        import pyarrow as pa

        words = sorted(["auau", "auaus", "auau", "auas", "x"])
        (batch,) = repair.audits([pa.RecordBatch.from_pydict({"key": list("abcde"), "signature": words})])
    finally:
        repair.node_before = node_before
    assert len(made) == len({w[:i] for w in words for i in range(1, len(w) + 1)})
    assert batch["audit"].to_pylist() == [least_edits(tuple(({"s": "system", "u": "user", "a": "assistant", "x": "z"}[c], ".", c == "x", False) for c in reversed(w)))[1] for w in words]


CONTROLS = ["\\", "</turn>", "### ", ": ", "\n", "t", "h", "-", "c", "#", "##", "</turn", ">", "user", " ", "é", "😀", "assistant"]


def test_chat_round_trip(spark):
    pick = random.Random(3)
    texts = ["".join(pick.choices(CONTROLS, k=pick.randrange(9))) for _ in range(3000)] + [None, "", "word " * 200_000]
    rows = [(i // 5 if i % 11 else None, i % 7 or None, pick.choice(["user", "assistant", "assistant", None, pick.choice(texts[:3000])]), t) for i, t in enumerate(texts)]
    rows += rows[:20]
    source = defaultdict(list)
    for conv, turn, role, text in rows:
        source[conv].append((turn is not None, turn or 0, role or "", text or ""))
    chats = chat_format.format_chats(table(spark, rows))
    assert {r.conv_id for r in chats.collect()} == set(source)
    for r in chats.join(chat_format.read_back(chats).withColumnRenamed("conv_id", "c"), chats["conv_id"].eqNullSafe(F_col("c"))).collect():
        want = [t[2:] for t in sorted(source[r.conv_id])]
        assert [tuple(t) for t in r.turns] == want
        assert r.loss == "".join(t for role, t in want if role == "assistant")
        spans = [r.formatted[m.offset + m.start :][: m.length] for m in r.mask]
        assert all(x not in s for s in spans for x in ("</turn>", "### ")) and len(spans) == sum(role == "assistant" for role, _ in want)


def F_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


def test_chat_plain_text_stays(spark):
    (r,) = chat_format.format_chats(table(spark, [(1, 0, "user", "a\\b # x"), (1, 1, "assistant", "c: d")])).collect()
    assert r.formatted == "### user: a\\b # x</turn>\n### assistant: c: d</turn>\n"
    assert [tuple(m) for m in r.mask] == [(1, 25, 15, 4)]


@pytest.mark.parametrize("rows", [[], [(None, None, None, None)]])
def test_chat_query(spark, tmp_path, rows):
    table(spark, rows or [(1, 1, "u", "t")]).limit(len(rows)).write.parquet(f"{tmp_path}/conversations.parquet")
    got = chat_format.op13_chat_format(spark, str(tmp_path)).toPandas()
    assert len(got) == 1 + len(rows)
    probe = got[got.conv_id == -7].iloc[0]
    assert probe.n_turns == 2 and probe.loss_chars == len(chat_format.PROBE)
    assert probe.loss_sha256 == hashlib.sha256(chat_format.PROBE.encode()).hexdigest()
    assert isinstance(got, pd.DataFrame)
