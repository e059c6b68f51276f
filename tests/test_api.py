"""The verbs end to end on a folder."""

import json
from datetime import datetime

import pytest

from knotwork import api
from knotwork.functions import schema_text


def test_verbs(spark, tmp_path):
    (tmp_path / "reviewed").mkdir()
    doc = {"meta": {"input_file": "a.md", "schema_version": 1, "engine": "e", "generated_at": "t"}, "nodes": [{"id": i, "label": "Person", "properties": {"name": n}} for i, n in enumerate(["Aoi", "Ken", "Rin"])], "relationships": [{"type": "KNOWS", "start_node_id": "0", "end_node_id": "1"}]}
    (tmp_path / "reviewed" / "a.kg.json").write_text(json.dumps(doc))
    e = api.Engine(spark, str(tmp_path))
    assert e.kg_rebuild(datetime(2026, 1, 1)).summary.first().nodes == 3
    assert e.view()[0].count() == 3 and e.view("connected")[0].count() == 2 and e.view(nodes=0)[0].count() == 1
    first, got = e.kg_search(["aoi"], datetime(2026, 1, 2))
    assert sorted(r.name for r in got.nodes.collect()) == ["Aoi", "Ken"]
    verified, lit = e.kg_cite(first, ["r1", "n7"])
    assert {r.alias: r.outcome for r in verified.collect()} == {"r1": "accepted", "n7": "unknown_alias"} and lit.count() == 2
    e.kg_search(["ken"], datetime(2026, 1, 3))
    assert e.kg_cite(first, ["n1"])[1].count() == 0
    with pytest.raises(ValueError):
        e.kg_search([], datetime(2026, 1, 3))
    made = e.kg_generate(spark.createDataFrame([("s", "ok"), ("t", "bad")], "stem string, prompt string"), lambda p: '{"a": 1}' if p == "ok" else "[]").collect()
    assert [(m.stem, m.json, m.error is None) for m in made] == [("s", '{"a": 1}', True), ("t", None, False)]


def test_schema_text():
    assert schema_text.inject("a {{SCHEMA}} b", "x") == "a x b"
    with pytest.raises(ValueError):
        schema_text.inject("none", "x")
    new, warned = schema_text.update({"schema_version": 3, "node_labels": [{"label": "A"}], "property_overrides": [{"node": {"label": "A"}}]}, [{"op": "remove", "path": "node_labels", "value": "A"}])
    assert new["schema_version"] == 4 and new["node_labels"] == [] and len(warned) == 1
    assert schema_text.update({"schema_version": 3}, []) == ({"schema_version": 3}, [])
    assert [schema_text.reconnect_delay(n) for n in (1, 3, 9)] == [1000, 4000, 30_000] and schema_text.reconnect_delay(9, opened=False) is None
