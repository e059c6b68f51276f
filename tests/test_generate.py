"""Runs of generation: waves, one correction, used-up engines, new types."""

from __future__ import annotations

import json
import random
import uuid
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from knotwork import catalog
from knotwork.api import Engine
from knotwork.plans import generate
from knotwork.tables import written

NOW = datetime(2026, 1, 1)


@pytest.fixture
def answer():
    def made(number, label="Person", end="1", **more):  # local, so that tasks get it by value
        nodes = [{"id": "1", "label": label, "properties": {"name": f"N{number}", "age": 3, "tags": ["a", "b"]}}]
        return json.dumps({"meta": {"engine": "made up"}, "nodes": nodes, "relationships": [{"type": "KNOWS", "start_node_id": "1", "end_node_id": end}]} | more)

    return made


def counted(folder, name, engine):
    """The engine, each call of which leaves a file."""
    calls = folder / name
    calls.mkdir()
    place = str(calls)

    def ask(prompt):
        with open(f"{place}/{uuid.uuid4().hex}", "w") as f:
            f.write(prompt)
        return engine(prompt)

    return ask, lambda: [p.read_text() for p in calls.iterdir()]


def test_two_engines_over_a_hundred_documents(spark, tmp_path, answer):
    def one(prompt):
        n = int(prompt.split()[0])
        if n >= 50:
            raise RuntimeError("usage limit reached")
        return answer(n)

    first, first_calls = counted(tmp_path, "one", one)
    second, second_calls = counted(tmp_path, "two", lambda p: answer(p.split()[0]))
    rows = spark.createDataFrame([(f"s{i:03}", str(i)) for i in range(100)], "stem string, prompt string")
    got = generate.run(rows, {"one": first, "two": second}, NOW, tasks=5)
    made = got.documents.collect()
    assert len(made) == 100 and all(r.kind is None for r in made) and not got.exhausted and got.switches == [("one", "two")] and got.remaining.count() == 0
    by = {e: sum(r.engine == e for r in made) for e in ("one", "two")}
    # A task asks a used-up engine once; what was refused or not asked goes to the other, once.
    assert len(first_calls()) - by["one"] <= 5 and len(second_calls()) == by["two"] == 100 - by["one"] >= 50
    doc = json.loads(made[0].json)
    assert doc["meta"] == {"input_file": f"{made[0].stem}.md", "schema_version": 1, "engine": made[0].engine, "generated_at": "2026-01-01T00:00:00"}
    assert doc["nodes"][0]["properties"] == {"name": f"N{int(made[0].stem[1:])}", "age": 3, "tags": ["a", "b"]}


def test_both_used_up(spark, answer):
    def spent(prompt):
        raise RuntimeError("HTTP 429" if prompt != "good" else "rate limit")

    rows = spark.createDataFrame([("a", "x"), ("b", "good")], "stem string, prompt string")
    got = generate.run(rows, {"one": spent, "two": spent}, NOW)
    assert got.exhausted and got.documents.count() == 0 and sorted(r.stem for r in got.remaining.collect()) == ["a", "b"]
    alone = generate.run(rows, {"one": spent, "two": lambda p: answer(1)}, NOW, failover=False)
    assert alone.exhausted and alone.switches == []


def test_rules_before_the_one_correction(spark, tmp_path, answer):
    def engine(prompt):
        kind = prompt.split("\n")[0]
        again = "refused" in prompt
        if kind == "crash":
            raise RuntimeError("disk quota")
        if kind == "slow":
            raise TimeoutError("too slow")
        if kind == "dangling" or not again:
            bad = {"dangling": answer(1, end="9"), "label": answer(1, label="person"), "text": "no object", "list": "[]", "empty": answer(1, nodes=[]), "half": '{"nodes": []}'}
            return bad.get(kind, answer(1))
        return answer(1)

    ask, calls = counted(tmp_path, "calls", engine)
    kinds = ["good", "crash", "slow", "dangling", "label", "text", "list", "empty", "half"]
    rows = spark.createDataFrame([(k, k) for k in kinds] + [("good", "zzz")], "stem string, prompt string")
    got = generate.run(rows, {"one": ask}, NOW, tasks=3)
    made = {r.stem: r for r in got.documents.collect()}
    assert {k for k, r in made.items() if r.kind is None} == {"good", "label", "text", "list", "empty", "half"}
    assert {k: r.kind for k, r in made.items() if r.kind} == {"crash": "crash", "slow": "timeout", "dangling": "bad_output"}
    assert {k for k, r in made.items() if r.corrected} == {"dangling", "label", "text", "list", "empty", "half"} and "dangling_end" in made["dangling"].summary
    assert (made["good"].n_nodes, made["good"].n_rels) == (1, 1) and len(calls()) == 3 + 2 * 6
    assert any("label_rule" in c and c.startswith("label\n") for c in calls())


def test_new_types_and_targets(spark, answer):
    known = spark.createDataFrame([("label", "Person")], "kind string, name string")
    rows = spark.createDataFrame([("a", None), ("b", "x")], "stem string, prompt string")
    got = generate.run(rows, {"one": lambda p: answer(1, label="Person" if p else "Place")}, NOW, known=known)
    assert sorted(map(tuple, got.new_types.collect())) == [("label", "Place"), ("type", "KNOWS")]
    metas = {r.stem: json.loads(r.json)["meta"]["new_types"] for r in got.documents.collect()}
    assert metas == {"a": {"node_labels": ["Place"], "relationships": ["KNOWS"]}, "b": {"node_labels": [], "relationships": ["KNOWS"]}}
    assert [r.stem for r in generate.targets(rows, limit=0).collect()] == ["a"]
    assert [r.stem for r in generate.targets(rows, rows.where("stem = 'b'"), 5).collect()] == ["b"]
    empty = generate.run(rows.limit(0), {"one": lambda p: p}, NOW)
    assert empty.documents.count() == 0 and not empty.exhausted
    with pytest.raises(ValueError):
        generate.run(rows, {"one": str}, NOW, start="two")


def test_an_answer_is_taken_apart_once(spark):
    raws = [None, "", "[1]", '{"nodes": [], "relationships": []}', 'x ```json\n {"nodes": [], "relationships": []} \n``` y', "```\u00a0```{}", "{bad", '{"nodes": 1}']
    rows = spark.createDataFrame([(str(i), r) for i, r in enumerate(raws)], "stem string, raw string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    read = generate.extracted(rows)
    assert plan(read).count("regexp_extract(") == 2 and plan(read).count("try_parse_json(") <= 1
    judged = generate.judge(written(read, "answers"))
    assert not any(f in plan(judged) for f in ("regexp_extract(", "try_parse_json(", "raw#0, json"))
    got = {int(r.stem): r.errors for r in judged.collect()}
    none, empty = "no single JSON object", " no_nodes"
    assert {k: v for k, v in got.items() if k not in (3, 4)} == {0: None, 1: none, 2: none, 5: none, 6: none, 7: "no nodes or relationships"}
    assert got[3] == got[4] and got[3].strip() == empty.strip()


def test_prompts_are_written_once(spark, answer):
    """Whatever the waves: the tables of a run hold each prompt once, and rows without a stem come through all of them."""
    base = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    size = lambda: sum(f.stat().st_size for f in base.rglob("*.parquet"))
    texts = {(f"s{i}" if i else None): f"{i}\n{random.Random(i).randbytes(15_000).hex()}" for i in range(60)}

    def one(prompt):
        raise RuntimeError("usage limit reached")

    def two(prompt):
        return answer(1, label="Person" if "refused; mend this" in prompt else "person", seen=[len(prompt)])

    rows = spark.createDataFrame([*texts.items(), ("s1", "zzz")], "stem string, prompt string")
    before = size()
    got = generate.run(rows, {"one": one, "two": two}, NOW, tasks=3)
    made = got.documents.collect()
    assert {r.stem for r in made} == set(texts) and len(made) == 60 and got.switches == [("one", "two")]
    assert all((r.kind, r.corrected, r.engine) == (None, True, "two") for r in made if r.stem)
    assert sum(map(len, texts.values())) // 2 < size() - before < 1.3 * sum(map(len, texts.values()))
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("prompts_")]


def test_prompts_are_shuffled_once(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "b"), ("b", None), (None, "z")], "stem string, prompt string")
    with generate.dealt(rows, 3) as prompts:
        waiting = written(prompts.select("key", F.lit("!").alias("note"), F.lit(True).alias("corrected")), "waiting")
        asked = generate.with_prompts(waiting, prompts, 3)
        assert sorted(map(str, asked.select("stem", "prompt", "note").collect())) == sorted(map(str, [Row(stem="a", prompt="b", note="!"), Row(stem="b", prompt="", note="!"), Row(stem=None, prompt="z", note="!")]))
        plan = asked._jdf.queryExecution().executedPlan().toString()
        assert plan.split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1 and asked.rdd.getNumPartitions() == 3


def test_query_over_documents(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(catalog.oracle_sql()["generation_outcomes"]).fetchall()
    got = [tuple(r) for r in catalog.queries()["generation_outcomes"](spark, sf).collect()]
    assert sorted(got) == sorted(want) and len(got)


def test_verbs(spark, tmp_path, answer):
    e = Engine(spark, str(tmp_path))
    assert e.schema_get() == {}
    new, warned = e.schema_update([{"op": "add", "path": "node_labels", "value": "Person"}])
    assert new == e.schema_get() == {"node_labels": ["Person"], "schema_version": 1} and not warned
    assert e.schema_update([{"op": "add", "path": "node_labels", "value": "Person"}])[0] == new
    assert e.schema_update([{"op": "add", "path": "node_labels", "value": "인물"}])[0]["schema_version"] == 2 and e.schema_get()["node_labels"] == ["Person", "인물"]
    rows = spark.createDataFrame([("b", "1"), ("a", "2")], "stem string, prompt string")
    made = e.kg_generate_run(rows, {"one": lambda p: answer(p)}, NOW)
    assert [(r.stem, json.loads(r.json)["meta"]["schema_version"]) for r in made.documents.collect()] == [("a", 2)]
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/generated").select("file", "engine", "n_nodes", "n_rels").collect()] == [("a.kg.json", "one", 1, 1)]
