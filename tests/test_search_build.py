"""Substring joins, the stored index and path search against brute force."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from knotwork import catalog
from knotwork.operators import audit, merge, search, substrings, text_index
from knotwork.plans import store
from knotwork.sources import documents


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tokens_of_mixed_words(spark):
    rows = [("abc한국어x", ["abc", "한국", "국어", "x"]), ("카나カナ刀剣ひ", ["카나", "カナ", "刀剣", "ひ"]), ("the한 a·b c", ["한", "a·b", "c"]), ("刀 剣", ["刀", "剣"]), ("x·한국", ["x", "한국"]), ("", []), (None, None)]
    got = spark.createDataFrame([(t,) for t, _ in rows], "t string").select(search.tokens(F.col("t")).alias("w")).collect()
    assert [r.w for r in got] == [w for _, w in rows]


def words(seed, n):
    pick = random.Random(seed)
    return ["".join(pick.choices("abc한", k=pick.randrange(0, 7))) for _ in range(n)]


def test_holders(spark):
    needles, texts = words(1, 80), words(2, 200)
    got = substrings.holders(spark.createDataFrame([(w,) for w in needles], "needle string"), spark.createDataFrame([(w,) for w in texts], "text string"))
    assert {tuple(r) for r in got.collect()} == {(n, t) for n in needles for t in texts if n and n in t}
    labelled = spark.createDataFrame([(("L", "M")[i % 2], w) for i, w in enumerate(texts)], "label string, name_key string")
    pairs = {tuple(r) for r in merge.similar_names(labelled).collect()}
    keys = [{w for i, w in enumerate(texts) if i % 2 == k} for k in range(2)]
    assert pairs == {("LM"[k], a, b) for k in range(2) for a in keys[k] for b in keys[k] if a and a in b and (len(a), a) < (len(b), b)}


def graph(spark, names):
    return spark.createDataFrame([(f"n{i:03}", "L", w.upper(), w) for i, w in enumerate(names)], "kgid string, label string, name string, name_key string")


@pytest.mark.parametrize("stored", [False, True])
def test_containing(spark, tmp_path, stored):
    names, keywords = words(4, 120) + ["abcabca"], [w for w in words(5, 40) if w][:24] + ["abcabcabcab", "ㅁ"]
    nodes = graph(spark, names)
    asked = spark.createDataFrame([("s", i, w, None, w) for i, w in enumerate(keywords)], "search_id string, kw_pos int, keyword string, question string, kw_key string")
    index = None
    if stored:
        search.write_index(nodes, f"{tmp_path}/index")
        index = search.read_index(spark, f"{tmp_path}/index")
    found = search.containing(asked, nodes, index)
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)
    got = defaultdict(list)
    for r in found.orderBy("kw_pos", "rank").collect():
        got[r.kw_pos].append(r.kgid)
    for i, k in enumerate(keywords):
        fits = sorted((w, f"n{j:03}") for j, w in enumerate(names) if w and (k in w or (len(k) >= 4 and w in k)))
        assert got[i] == [kgid for _, kgid in fits[:5]]


def test_stored_index_scores_alike(spark, tmp_path):
    nodes = graph(spark, ["red ring", "ring 한국어", "한국 blue", "blue blue ring", "", "of the"])
    search.write_index(nodes, f"{tmp_path}/index")
    stored = search.read_index(spark, f"{tmp_path}/index")
    asked = search.with_keys(spark.createDataFrame([("s", 0, "Blue 한국어", None), ("s", 1, "zzz", None)], "search_id string, kw_pos int, keyword string, question string"))
    one, two = ({(r.kw_pos, r.kgid): r.score for r in search.bm25(asked, nodes, i).collect()} for i in (search.build_index(nodes), stored))
    assert one == two and set(one) == {(0, "n001"), (0, "n002"), (0, "n003")}
    assert "bucket" in plan(stored.postings.of(asked.select(F.lit("blue").alias("token"))))
    assert {r.kgid for r in search.exact(asked.withColumn("kw_key", F.lit("red ring")), nodes, stored).collect()} == {"n000"}


def test_absent_nodes(spark):
    nodes = graph(spark, ["blue ring", "rin", "old"])
    claims = spark.createDataFrame([("Ring",), ("RIN",), ("in",), ("x",), ("",), ("blue ring!",), ("ring",)], "name string")
    got = {r.name: r.verdict for r in audit.absent_nodes(claims, nodes).collect()}
    assert got == {"Ring": "refuted", "RIN": "refuted", "in": "refuted", "x": "true", "": "refuted", "blue ring!": "true", "ring": "refuted"}
    assert audit.absent_nodes(claims, nodes.limit(0)).where("verdict <> 'true'").count() == 0
    assert "NestedLoop" not in plan(audit.absent_nodes(claims, nodes))


def least_path(links, a, b, most):
    """(nodes, rels) of the least shortest path by a walk from all nodes' distances."""
    far, level = {b: 0}, [b]
    while level:
        level = [o for n in level for o, _ in links[n] if o not in far and not far.update({o: far[n] + 1})]
    if a == b or far.get(a, most + 1) > most:
        return None
    nodes, rels = [a], []
    while nodes[-1] != b:
        step = min((o, r) for o, r in links[nodes[-1]] if far.get(o) == far[nodes[-1]] - 1)
        nodes.append(step[0])
        rels.append(step[1])
    return nodes, rels


@pytest.mark.parametrize("bucketed", [False, True])
def test_shortest_paths(spark, tmp_path, bucketed):
    pick = random.Random(8)
    names = [f"v{i:02}" for i in range(40)]
    rels = [(f"r{i:03}", "T", *pick.choices(names[:36], k=2)) for i in range(46)] + [("r900", "T", "v38", "v39"), ("r901", "T", "v39", "v38"), (None, "T", "v00", "v39")]
    links = defaultdict(list)
    for r, _, a, b in rels:
        if r:
            links[a].append((b, r))
            links[b].append((a, r))
    table = spark.createDataFrame(rels, "kgid string, type string, from_kgid string, to_kgid string")
    ways = table
    if bucketed:
        search.write_bucketed(search.steps(table), f"{tmp_path}/steps", "at", 100)
        ways = text_index.read_bucketed(spark, f"{tmp_path}/steps", "at", "at string, to string, kgid string, type string, from_kgid string, to_kgid string")
    ends = [("s", i, *pick.choices(names, k=2)) for i in range(60)] + [("s", 60, "v01", "v01"), ("s", 61, "v38", "v39"), ("s", 62, "v38", "v00")]
    got = {r.pair: (r.nodes, r.rels, r.length) for r in search.shortest_paths(spark.createDataFrame(ends, "search_id string, pair int, a string, b string"), ways).collect()}
    want = {p: (*found, len(found[1])) for _, p, a, b in ends if (found := least_path(links, a, b, 4))}
    assert got == want and {w[2] for w in want.values()} >= {1, 2, 3, 4}


def test_stored_build_is_made_once(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    first = store.stored_build(spark, sf)
    monkeypatch.setattr(store, "sample", lambda *a: pytest.fail("made again"))
    again = store.stored_build(spark, sf)
    assert again.nodes.inputFiles() == first.nodes.inputFiles()
    assert catalog.queries()["search_t2_stored"](spark, sf).count() > 0


def test_fingerprint(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/t")
    one = store.fingerprint(spark, [f"{tmp_path}/t"])
    assert one == store.fingerprint(spark, [f"{tmp_path}/t"])
    spark.range(3).write.mode("append").parquet(f"{tmp_path}/t")
    assert one != store.fingerprint(spark, [f"{tmp_path}/t"])


def test_keywords_without_python(spark):
    """Keywords of the queries are literals, and only those beyond ASCII are composed by Python."""
    asked = catalog._keywords(spark)
    for df in (asked, search.anchor_candidates(asked)):
        assert "Python" not in plan(df) and "ExistingRDD" not in plan(df)
    assert asked.schema.simpleString() == "struct<search_id:string,kw_pos:int,keyword:string,question:string,kw_key:string>"
    rows = spark.createDataFrame([("s", 0, " Éa  B", None), ("s", 1, " A b ", None), ("s", 2, None, None)], "search_id string, kw_pos int, keyword string, question string")
    assert {(r.kw_pos, r.keyword, r.kw_key) for r in search.with_keys(rows).collect()} == {(0, " Éa  B", "éa b"), (1, " A b ", "a b"), (2, None, None)}


def test_stored_tables_hold_nothing_twice(spark, tmp_path):
    """Gram postings name each text once, steps each end once; what is read is whole, of builds in the former layout too."""
    nodes = graph(spark, ["red ring", "blue"]).unionByName(spark.createDataFrame([("m000", "M", "Red ring", "red ring")], "kgid string, label string, name string, name_key string"))
    rels = spark.createDataFrame([("r0", "T", "n000", "n001"), ("r1", "T", "n001", "n000"), ("r2", "U", "n001", "n001"), ("r3", "T", "m000", "n000")], "kgid string, type string, from_kgid string, to_kgid string")
    documents.write_search_tables(nodes, rels, f"{tmp_path}/new")
    kept = {t: spark.read.parquet(f"{tmp_path}/new/{t}") for t in ("grams", "steps")}
    assert {*kept["grams"].columns} == {"gram", "name_key", "bucket", "buckets"} and {*kept["steps"].columns} == {"at", "to", "kgid", "type", "outward", "bucket", "buckets"}
    assert kept["grams"].where("gram = 'rin'").count() == 1
    search.write_index(nodes, f"{tmp_path}/old")
    search.write_bucketed(search.steps(rels), f"{tmp_path}/old/steps", "at", 100)
    for layout in ("new", "old"):
        index, steps = documents.read_search_tables(spark, f"{tmp_path}/{layout}")
        want = search.steps(rels)
        assert sorted(map(tuple, steps.all().select(want.columns).collect())) == sorted(map(tuple, want.collect())) and want.count() == 7
        asked = search.with_keys(spark.createDataFrame([("s", 0, "ed ri", None)], "search_id string, kw_pos int, keyword string, question string"))
        assert {r.kgid for r in search.containing(asked, nodes, index).collect()} == {"n000", "m000"}
