"""Scalar vectors, merge rules, validation, search, analytics, workflow and streaming on small graphs."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from knotwork import catalog
from knotwork.functions import identity, text
from knotwork.operators import audit, filters, graph, merge, search, validate, workflow
from knotwork.plans import rebuild
from knotwork.plans import search as search_plan
from knotwork.sources import documents
from knotwork.streaming import hub
from knotwork.tables import written


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_keys(spark):
    rows = [("  Aoi\u3000 \u00a0Ken ",), ("cafe\u0301",), ("ＡＢ",), (None,), ("",)]
    got = [r[0] for r in values(spark, rows, "x string", identity.name_key(F.col("x")))]
    assert got == ["aoi ken", "café", "ａｂ", None, ""]
    ids = values(spark, [("Person", "카마도 탄지로")], "l string, k string", identity.node_kgid(F.col("l"), F.col("k")))
    assert ids == [("n_bcfe481dc38bafcd",)]
    once = identity.name_key(F.col("x"))
    again = spark.createDataFrame(rows, "x string").select(once.alias("x")).select("x", identity.name_key(F.col("x")).alias("y")).collect()
    assert all(r.x == r.y for r in again)


def test_safe_numbers_beyond_64_bits(spark, tmp_path):
    rows = [(0,), (1000,), (1001,), (1_024_001,), (6_000_000,), (35_999_999,), (-1001,), (2**62,)]
    spark.createDataFrame(rows, "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: r.safe for r in catalog.queries()["json_safe_numbers"](spark, str(tmp_path)).collect()}
    assert got == {n: f'"{n * 9007199254740}"' if abs(n) > 1000 else str(n * 9007199254740) for (n,) in rows}
    assert values(spark, [(2**63 - 1,), (-(2**63),), (None,)], "x long", text.json_safe_long(F.col("x"))) == [(f'"{2**63 - 1}"',), (f'"{-(2**63)}"',), (None,)]


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_values_are_counted_down_before_they_are_put_in_order(spark):
    rows = [("b", 1, "P", "x", {"p": "2", "q": "1"}), ("a", 9, "P", "x", {"p": "3"}), ("a", 10, "P", "x", {"p": "2", "name": "n"}), ("c", 0, "P", "x", {"p": None}), ("a", 9, "P", "y", {"p": None}), ("b", 0, "P", "y", {"p": "1"})]
    keyed = spark.createDataFrame(rows, "file string, pos long, label string, name_key string, props map<string,string>")
    first = merge.first_values(keyed, "label", "name_key")
    assert sorted(map(tuple, first.collect())) == [("P", "x", "p", "3"), ("P", "x", "q", "1"), ("P", "y", "p", None)]
    assert "partial_min(pos" in physical(first)
    nodes = keyed.withColumn("kgid", F.col("name_key")).withColumn("name", F.upper("name_key")).withColumn("input_file", F.concat("file", F.lit(".md")))
    assert "partial_min(pos" in physical(merge.merged_nodes(nodes))
    assert [(r.name_key, r.name, r.reviewed_files) for r in merge.merged_nodes(nodes).orderBy("name_key").collect()] == [("x", "X", ["a", "b", "c"]), ("y", "Y", ["a", "b"])]


def test_relationships_and_citations_meet_nodes_unsorted(spark, docs):
    keyed = merge.canonicalize(docs[0])
    assert "SortMergeJoin" not in physical(merge.linked_rels(docs[1], keyed).hint("merge").select("kgid")) and physical(merge.linked_rels(docs[1], keyed)).count("ShuffledHashJoin") == 2
    merged, linked = merge.merged_rels(merge.linked_rels(docs[1], keyed)), merge.linked_rels(docs[1], keyed)
    assert sorted(r.kgid for r in merged.collect()) == sorted({r.kgid for r in linked.collect()})
    cited = spark.createDataFrame([("s", "n1"), ("s", "n1"), ("s", "n2")], "search_id string, alias string")
    aliases = spark.createDataFrame([("s", "n1", "node", "k", None, None)], "search_id string, alias string, kind string, kgid string, from_kgid string, to_kgid string")
    verified = search.verify_citations(cited, aliases)
    assert "ShuffledHashJoin" in physical(verified)
    assert sorted((r.alias, r.outcome) for r in verified.collect()) == [("n1", "accepted"), ("n2", "unknown_alias")]


def test_tokens_are_counted_by_document_within_parts(spark, tmp_path):
    import duckdb

    rows = [(7, 1), (7, 1), (8, 2), (11, 3)]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    counted = catalog.queries()["cjk_tokens"](spark, str(tmp_path))
    plan = physical(counted)
    assert "hashpartitioning(c_custkey" in plan and "hashpartitioning(token#" in plan and "hashpartitioning(token#0, c_custkey" not in plan and plan.count("Exchange") == 2
    con = duckdb.connect()
    con.sql(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    assert sorted(map(tuple, counted.collect())) == sorted(con.sql(catalog.oracle_sql()["cjk_tokens"]).fetchall())


def test_jamo(spark):
    rows = [("일륨도", "일륜도", 1), ("탄지로", "탄지로", 0), ("가", "나다", 2), ("abc", "abd", 1)]
    got = values(spark, rows, "a string, b string, d int", identity.jamo_distance(F.col("a"), F.col("b"), 1), "d")
    assert got == [(1, 1), (0, 0), (2, 2), (1, 1)]


def test_urls(spark):
    cases = {
        "HTTP://X.com:80/a/?utm_source=1&b=2&a=1#f": "http://x.com/a?a=1&b=2", "https://x.com": "https://x.com/", "https://x.com/a%2fb/": "https://x.com/a%2Fb",
        "https://x.com/?q=a b&fbclid=1": "https://x.com/?q=a+b", "https://x.com/a/../b/": "https://x.com/b", "https://x.com:8443/": "https://x.com:8443/", "nothing": None, "https://bücher.de/": "https://xn--bcher-kva.de/",
    }
    got = values(spark, [(k,) for k in cases], "u string", "u", text.normalize_url("u"))
    assert dict(got) == cases
    twice = values(spark, [(v,) for v in cases.values() if v], "u string", "u", text.normalize_url("u"))
    assert all(a == b for a, b in twice)


def test_text_functions(spark):
    md = "[![logo](i.png)](/home) [a](b.html \"t\") ![x](y.png) [m](mailto:a@b) [a2](b.html)"
    links = spark.createDataFrame([(md,)], "m string").select(F.posexplode(text.markdown_links(F.col("m"))).alias("p", "l")).select(text.resolve_url(F.lit("https://s.org/d/"), F.col("l")).alias("l"))
    assert [r.l for r in links.collect()] == ["https://s.org/home", "https://s.org/d/b.html", None, "https://s.org/d/b.html"]
    names = values(spark, [("a<b>:c?. ",), ("con",), ("",), ("x" * 99,)], "n string", text.safe_file_name(F.col("n")))
    assert [n[0] for n in names] == ["a_b__c_", "con_", "untitled", "x" * 80]
    assert values(spark, [(1,), (12,), (123,)], "p int", text.page_stem(F.lit("s"), F.lit("n"), F.col("p"))) == [("s_n_p01",), ("s_n_p12",), ("s_n_p123",)]
    page = values(spark, [("Title: T\n\nURL Source: https://a/b\n\nMarkdown Content:\n# H",), ("plain",)], "t string", text.reader_page(F.col("t")))
    assert [tuple(p[0]) for p in page] == [("T", "https://a/b", "# H"), (None, None, "plain")]
    hosts = values(spark, [("https://a.b.co.kr/x",), ("http://www.s.com",), ("http://10.0.0.1/",), ("http://localhost/",)], "u string", text.registrable_domain("u"))
    assert [h[0] for h in hosts] == ["b.co.kr", "s.com", None, None]
    rules = ["com", "*.ck", "!www.ck", "uk", "co.uk", "b.co.uk"]
    hosts = [(f"http://{h}/",) for h in ("x.a.b.ck", "b.ck", "y.www.ck", "a.b.co.uk", "x.a.c.uk", "B.CO.UK", "x.y.unlisted")]
    assert [v[0] for v in values(spark, hosts, "u string", text.registrable_domain("u", rules))] == ["a.b.ck", None, "www.ck", "a.b.co.uk", "c.uk", None, "y.unlisted"]
    blocked = text.robots_blocked("User-agent: *\nDisallow: /api/")
    assert values(spark, [("https://s/api",), ("https://s/apix",)], "u string", blocked("u")) == [(True,), (False,)]
    out = values(spark, [('```json\n{"a": 1}\n```',), ("[1]",), ('x {"a": {"b": 2}} y',), ("",), ("{bad",)], "o string", text.engine_json(F.col("o")))
    assert [o[0] for o in out] == ['{"a": 1}', None, '{"a": {"b": 2}}', None, None]
    runs = [(0, "429 rate limit", False, None, "ok"), (1, "HTTP 429", False, None, "rate_limit"), (1, "room 429", False, None, "crash"), (None, "", True, None, "timeout"), (None, "", False, "spawn ENOENT", "not_installed"), (9009, "", False, None, "not_installed")]
    got = values(spark, runs, "c int, e string, t boolean, s string, w string", text.engine_failure(F.col("c"), F.col("e"), F.col("t"), F.col("s")), "w")
    assert all(a == b for a, b in got)
    env = values(spark, [("A=1 # c",), ("# x",), ('B="q # r"',)], "l string", text.environment_line(F.col("l")))
    assert [None if e[0] is None else tuple(e[0]) for e in env] == [("A", "1"), None, ("B", "q # r")]
    assert values(spark, [("C:\\x",), ("file://a",), ("a/b",)], "p string", text.looks_like_path(F.col("p"))) == [(True,), (True,), (False,)]


NODES = "file string, input_file string, pos long, local_id string, label string, name string, props map<string,string>"
RELS = "file string, input_file string, pos long, rel_id string, type string, start_id string, end_id string, props map<string,string>"


@pytest.fixture(scope="module")
def docs(spark):
    nodes = [
        ("a", "a.md", 0, "1", "Person", "Tan Jiro", {"age": "15", "role": '"x"'}), ("a", "a.md", 1, "2", "Person", "Nez", {}), ("a", "a.md", 2, "3", "Sword", "Tan Jiro", {}),
        ("b", "b.md", 0, "1", "Person", " tan  jiro", {"age": "16", "new": '"n"'}), ("b", "b.md", 1, "9", "Person", "Nezuko", {"age": "14"}),
    ]
    rels = [("a", "a.md", 0, None, "KNOWS", "1", "2", {"since": "1"}), ("a", "a.md", 1, None, "KNOWS", "1", "2", {"since": "2", "w": "3"}), ("a", "a.md", 2, None, "HAS", "1", "3", {}), ("b", "b.md", 0, None, "KNOWS", "9", "1", {})]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(rels, RELS)


def test_merge(spark, docs):
    made = rebuild.build(*docs)
    nodes = {(r.label, r.name_key): r for r in made.nodes.collect()}
    jiro = nodes["Person", "tan jiro"]
    assert jiro.name == "Tan Jiro" and jiro.props == {"age": "15", "role": '"x"', "new": '"n"'} and jiro.reviewed_files == ["a", "b"]
    assert len(nodes) == 4
    knows = [r for r in made.rels.collect() if r.type == "KNOWS"]
    assert sorted(r.occurrences for r in knows) == [1, 2]
    assert [r.props for r in knows if r.occurrences == 2] == [{"since": "1", "w": "3"}]
    s = made.summary.first()
    assert (s.files, s.nodes, s.rels, s.merged, s.canonicalized) == (2, 4, 3, 1, 0)
    conflict = merge.conflicts(made.observed).collect()
    assert [(c.name_key, c.prop, c.vals) for c in conflict] == [("tan jiro", "age", ["15", "16"])]
    pairs = merge.similar_names(made.nodes).collect()
    assert [(p.a_key, p.b_key) for p in pairs] == [("nez", "nezuko")]


def test_dictionary_and_overrides(spark, docs):
    entries = spark.createDataFrame([("Person", "Nezuko", "Person", "nez")], "canonical_label string, canonical_name string, label string, name string")
    over = spark.createDataFrame([("Person", "tan jiro", "age", "16"), ("Person", "nobody", "age", "1"), ("Person", "tan jiro", "age2", "1")], "label string, name_key string, prop string, value string")
    made = rebuild.build(*docs, dictionary=entries, overrides=over)
    assert made.nodes.count() == 3 and made.summary.first().canonicalized == 1
    assert made.nodes.where("name_key = 'tan jiro' and label = 'Person'").first().props["age"] == "16"
    assert {r.outcome for r in made.overrides.collect()} == {"applied", "no_node", "no_property"}
    chain = spark.createDataFrame([("P", "b", "P", "a"), ("P", "c", "P", "b"), ("P", "d", "P", "a")], entries.schema)
    assert {r.code for r in validate.dictionary_problems(chain).collect()} == {"chain", "variant_in_two_entries"}
    with pytest.raises(rebuild.Refused):
        rebuild.build(*docs, dictionary=chain)


def test_rebuild_is_idempotent_and_order_free(spark, docs):
    one = rebuild.build(*docs)
    two = rebuild.build(docs[0].orderBy(F.desc("pos"), F.desc("file")), docs[1].orderBy(F.desc("pos")))
    assert sorted(map(str, one.nodes.collect())) == sorted(map(str, two.nodes.collect()))
    assert sorted(map(str, one.rels.collect())) == sorted(map(str, two.rels.collect()))


def test_validation(spark, docs):
    nodes, rels = docs
    bad = nodes.unionByName(spark.createDataFrame([("a", "a.md", 7, "1", "person", " ", {"o": "{}", "m": '[1,"a"]', "n": "[1,null]", "e": "[]", "f": "[1,1.5]"})], NODES))
    wrong = rels.unionByName(spark.createDataFrame([("a", "a.md", 9, None, "", "1", "77", {}), ("b", "b.md", 9, None, "x", "1", None, {})], RELS))
    codes = {r.code for r in validate.structure(bad, wrong, spark.createDataFrame([("a",), ("z",)], "file string")).collect()}
    assert codes == {"node_id_duplicate", "type_missing", "end_missing", "dangling_end", "no_nodes"}
    found = [(r.place, r.code) for r in validate.schema(bad, wrong).collect()]
    assert {c for _, c in found} == {"label_rule", "type_rule", "name_missing", "property_type"}
    assert {p for p, c in found if c == "property_type"} == {"7.o", "7.m", "7.n"}
    with pytest.raises(rebuild.Refused):
        rebuild.build(bad, rels)
    ids = [r.rel_id for r in validate.with_rel_ids(rels.where("file = 'a'")).orderBy("pos").collect()]
    assert ids == ['["1","KNOWS","2",0]', '["1","KNOWS","2",1]', '["1","HAS","3",0]']


def test_files(spark, tmp_path):
    doc = {"meta": {"input_file": "in.md", "schema_version": 1, "engine": "e", "generated_at": "t"}, "nodes": [{"id": " 1 ", "label": "Person", "properties": {"name": "A", "n": 1.50, "l": ["x", "y"]}}, {"id": 2, "label": "Person", "properties": {"name": "B"}}], "relationships": [{"type": "KNOWS", "start_node_id": "1", "end_node_id": "2"}]}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.kg.json").write_text(json.dumps(doc))
    made = rebuild.rebuild(spark, str(tmp_path / "in"), str(tmp_path / "out"), "b1", lock=str(tmp_path / "lock"))
    assert made.summary.first().nodes == 2
    nodes, rels = documents.read_graph(spark, str(tmp_path / "out"))
    assert nodes.count() == 2 and rels.count() == 1
    assert nodes.where("name = 'A'").first().props["n"] == "1.5"
    (tmp_path / "in" / "y.kg.json").write_text("{")
    with pytest.raises(rebuild.Refused):
        rebuild.rebuild(spark, str(tmp_path / "in"), str(tmp_path / "out"), "b2")
    (tmp_path / "in" / "m.md").write_text('---\ntitle: "T"\nurl: https://x\n---\nbody\n')
    row = documents.read_front_matter(spark, str(tmp_path / "in")).first()
    assert row.front_matter == {"title": "T", "url": "https://x"} and row.body == "body\n"
    assert {r.kind for r in documents.read_binary_folder(spark, str(tmp_path / "in")).collect()} == {None}
    pages = documents.fetched_pages(spark.createDataFrame([("u1",), ("u2",)], "url string"), lambda u: f"Title: {u}" if u == "u1" else 1 / 0).collect()
    assert [(p.url, p.title, p.error) for p in pages] == [("u1", "u1", None), ("u2", None, "division by zero")]


def small_graph(spark):
    names = ["네즈코", "카마도 네즈코", "일륜도", "blue ring", "old ring", "ring", "탄지로"]
    nodes = merge.merged_nodes(merge.canonicalize(spark.createDataFrame([("f", "f.md", i, str(i), "Thing", n, {}) for i, n in enumerate(names)], NODES)))
    ids = {r.name: r.kgid for r in nodes.collect()}
    pairs = [("네즈코", "탄지로"), ("탄지로", "일륜도"), ("일륜도", "blue ring"), ("blue ring", "old ring"), ("old ring", "ring")]
    rels = spark.createDataFrame([(f"r{i}", "T", ids[a], ids[b]) for i, (a, b) in enumerate(pairs)], "kgid string, type string, from_kgid string, to_kgid string")
    return nodes, rels, ids


def test_search(spark):
    nodes, rels, ids = small_graph(spark)
    asked = spark.createDataFrame([("s", 0, "일륨도", "탄지로의 일륜도가 뭐야"), ("s", 1, "네즈코", None), ("s", 2, "zzz", None), ("t", 0, "Blue  RING", None), ("t", 1, "rin", None)], "search_id string, kw_pos int, keyword string, question string")
    got = search_plan.search(asked, nodes, rels, hops=1)
    seeds = {(r.search_id, r.kw_pos): (r.tier, r.name, r.restored) for r in got.seeds.where("rank = 1").collect()}
    assert seeds["s", 0] == ("T1", "일륜도", "일륜도") and seeds["s", 1][:2] == ("T1", "네즈코") and seeds["t", 0][:2] == ("T1", "blue ring") and seeds["t", 1][0] == "T3"
    assert [(r.search_id, r.keyword) for r in got.unmatched.collect()] == [("s", "zzz")]
    hop = {r.name: r.hop for r in got.nodes.where("search_id = 's'").collect()}
    assert hop == {"일륜도": "0", "네즈코": "0", "탄지로": "path", "blue ring": "1"}
    rel = got.rels.where("search_id = 's'").collect()
    assert len(rel) == 3 and all(r.from_alias.startswith("n") and r.alias.startswith("r") for r in rel)
    aliases = got.nodes.select("search_id", "alias", F.lit("node").alias("kind"), "kgid", F.lit(None).cast("string").alias("from_kgid"), F.lit(None).cast("string").alias("to_kgid"))
    cited = spark.createDataFrame([("s", "n1"), ("s", "n99")], "search_id string, alias string")
    status = search.citation_status(search.verify_citations(cited, aliases), spark.createDataFrame([("s", 7)], "search_id string, total int")).first()
    assert (status.submitted, status.accepted, status.status, status.dense) == (2, 1, "partial", False)


def test_bm25_over_pairs(spark):
    nodes, _, ids = small_graph(spark)
    asked = search.with_keys(spark.createDataFrame([("s", 0, "네즈코", None)], "search_id string, kw_pos int, keyword string, question string"))
    got = {r.name: r.score for r in search.bm25(asked, nodes, search.build_index(nodes)).collect()}
    # 7 documents of 2, 4, 2, 2, 2, 1 and 2 tokens; both pairs of the keyword lie in two of them.
    idf, avg = __import__("math").log(1 + 5.5 / 2.5), 15 / 7
    want = {n: 2 * idf / (1 + 1.2 * (0.25 + 0.75 * dl / avg)) for n, dl in (("네즈코", 2), ("카마도 네즈코", 4))}
    assert {n: round(s, 6) for n, s in got.items()} == {n: round(s, 6) for n, s in want.items()}


def test_anchor_guards(spark):
    rows = [("a", 0, "일륨도", "일륨도는 뭐야"), ("a", 1, "일륨", "일륜"), ("a", 2, "일륨도", "가일륜도"), ("a", 3, "일륨도", None), ("a", 4, "ilryun", "ilryum"), ("a", 5, "일륨도", "일륜도 일률도")]
    got = audit.damaged_keywords(spark.createDataFrame(rows, "search_id string, kw_pos int, keyword string, question string")).orderBy("kw_pos").collect()
    assert [r.verdict for r in got] == ["sound", "sound", "sound", "unmeasured", "sound", "sound"]


def test_paths_and_components(spark):
    nodes, rels, ids = small_graph(spark)
    pairs = spark.createDataFrame([("s", 1, ids["네즈코"], ids["old ring"]), ("s", 2, ids["네즈코"], ids["ring"]), ("s", 3, ids["ring"], ids["old ring"])], "search_id string, pair int, a string, b string")
    got = {r.pair: (r.length, r.nodes) for r in search.shortest_paths(pairs, rels).collect()}
    assert got == {1: (4, [ids[n] for n in ("네즈코", "탄지로", "일륜도", "blue ring", "old ring")]), 3: (1, [ids["ring"], ids["old ring"]])}
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (5, 7)], "src long, dst long")
    points = spark.range(1, 9)
    parts = {r.id: r.component for r in graph.strong_components(points, edges).collect()}
    assert parts == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8}
    depth = {r.id: r.depth for r in graph.cyclic_depth(points, edges).collect()}
    assert depth == {1: 0, 2: 1, 3: 2, 4: 3, 5: 4, 6: 0, 7: 5, 8: 0}
    assert graph.analyze_dag(points.limit(0), edges.limit(0), graph.strong_components(points.limit(0), edges.limit(0))).first().is_dag is False


def test_filters(spark):
    nodes = spark.createDataFrame([(1, "A", {"name": '"x"', "n": "1", "l": '["p","q"]', "kgid": '"k"'}), (2, "B", {}), (3, "A", {"t": '"' + "y" * 200 + '"'})], "id long, label string, props map<string,string>")
    rels = spark.createDataFrame([(1, "T", 1, 2, {"w": "1"}), (2, "U", 2, 2, {})], "id long, type string, start_node_id long, end_node_id long, props map<string,string>")
    kept, some = filters.filtered_subgraph(nodes, rels, {"type": "T"})
    assert sorted(r.id for r in kept.collect()) == [1, 2] and some.count() == 1
    assert sorted(r.id for r in filters.filtered_subgraph(nodes, rels, {})[0].collect()) == [1, 2]
    facts = {r.id: (r.facts, r.omitted) for r in filters.node_facts(nodes).collect()}
    assert facts[1] == ({"l": "p, q", "n": "1"}, 0) and len(facts[3][0]["t"]) == 160
    assert filters.clamp(0, 80, 150) == 1 and filters.clamp(999, 80, 150) == 150 and filters.clamp(None, 80, 150) == 80


def test_workflow(spark):
    ledger = spark.createDataFrame([("k1", "f1", "h1", "collected", 3), ("k2", "f1", "h2", "collected", 0), ("k3", "f3", "h2", "failed", 1), ("k4", "f4", "h9", "blocked", 0)], "key string, file string, final_hash string, status string, reject_count int")
    start = spark.createDataFrame([("k1",)], "key string")
    assert sorted(r.key for r in workflow.twins(ledger, start).collect()) == ["k1", "k2", "k3"]
    assert [r.key for r in workflow.remove_sources(ledger, start, False).collect()] == ["k4"]
    assert workflow.remove_sources(ledger, start, True).where("status = 'blocked'").count() == 4
    held = {r.file: r.held for r in workflow.review_queue(spark.createDataFrame([("f1",), ("f9",)], "file string"), ledger).collect()}
    assert held == {"f1": True, "f9": False}
    links = spark.createDataFrame([("a", 0, "b", "d"), ("a", 1, "c", "d"), ("b", 0, "e", "d"), ("c", 0, "a", "d"), ("a", 2, "z", "other")], "src string, pos long, dst string, dst_domain string")
    crawl = workflow.crawl(spark.createDataFrame([("a", "d")], "url string, domain string"), links, blocked=spark.createDataFrame([("c",)], "url string"))
    assert [(r.url, r.level, r.place) for r in crawl.orderBy("place").collect()] == [("a", 0, 1), ("b", 1, 2), ("e", 2, 3)]
    stats = workflow.population_stats(spark.createDataFrame([("g", x) for x in (4, 1, 3, 2)], "g string, v int"), "g", "v").first()
    assert (stats.n, stats.median, stats.most) == (4, 3, 4)


def test_hub_stream_equals_batch(spark, tmp_path):
    rows = [("c", 1, "graph.show", "g1"), ("c", 2, "highlight.set", "h1"), ("c", 3, "highlight.clear", ""), ("d", 1, "graph.show", "g2"), ("d", 2, "graph.refresh", ""), ("d", 3, "highlight.set", "h2"), ("e", 1, "highlight.set", "h3")]
    log = spark.createDataFrame(rows, "channel string, seq long, type string, payload string").withColumn("ts", F.timestamp_seconds("seq"))
    log.select("channel", "seq", "ts", "type", "payload").write.parquet(str(tmp_path / "log"))
    want = sorted((r.channel, r.type, r.seq, r.payload) for r in hub.retained(log).collect())
    assert want == [("c", "graph.show", 1, "g1"), ("d", "highlight.set", 3, "h2"), ("e", "highlight.set", 1, "h3")]
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "log")).schema).parquet(str(tmp_path / "log"))
    q = hub.retained_stream(stream).writeStream.format("memory").queryName("held").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.channel, r.type, r.seq, r.payload) for r in spark.table("held").collect()) == want


@pytest.mark.parametrize("name", ["node_merge", "prop_conflicts", "rel_merge_dedupe", "search_t2_bm25", "scc", "url_normalize", "hub_replay", "shortest_path_pairs"])
def test_catalog_against_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(catalog.oracle_sql()[name]).df()
    got = catalog.queries()[name](spark, sf).toPandas()[list(want.columns)]
    rows = lambda d: sorted(map(repr, d.astype(object).where(d.notna(), None).values.tolist()))
    assert rows(got) == rows(want)


def against_sql(spark, name, sf):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(catalog.oracle_sql()[name]).df()
    got = catalog.queries()[name](spark, sf).toPandas()[list(want.columns)]
    rows = lambda d: sorted(map(repr, d.astype(object).where(d.notna(), None).values.tolist()))
    assert rows(got) == rows(want)
    return got


@pytest.mark.parametrize(("name", "rows"), [("dag_depth", 15000), ("highlight_state", 1500), ("highlight_nm", 2), ("citation_verify", 40), ("filtered_subgraph", 45)])
def test_whole_tables(spark, name, rows):
    assert len(against_sql(spark, name, "/root/testdata/sf0.01")) >= rows


def test_whole_components(spark):
    """Components of all customers against the pairs that reach each other."""
    import numpy as np

    sf = "/root/testdata/sf0.001"
    customers = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_nationkey").collect()
    edges = {(i, (i * 7 + 3) % 60 + 60 * (i // 60)) for i, _ in customers} | {(i, (i * 31 + 11) % 150) for i, nation in customers if nation < 20}
    edges = {e for e in edges if e[1] < 150}
    reach = np.eye(150, dtype=bool)
    for a, b in edges:
        reach[a, b] = True
    for k in range(150):
        reach |= reach[:, [k]] & reach[[k], :]
    least = (reach & reach.T).argmax(1)
    nodes, links = catalog._cycles_whole(spark, sf)
    parts = written(graph.strong_components(nodes, links), "parts")
    assert {r.id: r.component for r in parts.collect()} == dict(enumerate(least.tolist())) and np.bincount(least).max() > 60
    cyclic = {(a, b) for a, b in edges if least[a] == least[b]}
    assert {tuple(r) for r in graph.cyclic_edges(links, parts).select("src", "dst").collect()} == cyclic
    assert tuple(graph.analyze_dag(nodes, links, parts).first()) == (False, len(cyclic), sum(a == b for a, b in cyclic), int((np.bincount(least) > 1).sum()))


@pytest.mark.parametrize(("name", "rows"), [("khop_1", 100), ("khop_2", 100), ("seed_global_cap", 13), ("node_facts", 1000)])
def test_operators_own_limits(spark, name, rows):
    assert len(against_sql(spark, name, "/root/testdata/sf0.01")) >= rows


def test_one_hop_reads_all_relationships(spark, tmp_path):
    """2,500 customers of two nations and what else lies there; within the limit a search still stops at it."""
    import duckdb

    sf = "/root/testdata/sf0.001"
    for t in "region nation supplier part orders lineitem events".split():
        (tmp_path / f"{t}.parquet").symlink_to(f"{sf}/{t}.parquet")
    duckdb.sql(f"COPY (SELECT i AS c_custkey, 'C' || i AS c_name, (CASE WHEN i % 2 = 0 THEN 3 ELSE 8 END)::INTEGER AS c_nationkey, 0.0::DOUBLE AS c_acctbal, 'X' AS c_mktsegment FROM range(2500) t(i)) TO '{tmp_path}/customer.parquet'")
    got = against_sql(spark, "khop_1", str(tmp_path))
    assert (got.hop == 0).sum() == 2 and (got.hop == 1).sum() > 2500
    rels = spark.range(2500).selectExpr("concat('r', id) kgid", "'T' type", "'hub' from_kgid", "concat('n', id) to_kgid")
    start = spark.createDataFrame([("s", "hub")], "search_id string, kgid string")
    assert [search.hops(start, rels, 1, *most)[0].where("hop = 1").count() for most in ([None], [], [7])] == [2500, 2000, 7]


def test_paths_over_all_types(spark):
    """The least shortest path of each pair, by a breadth-first walk over all relationships."""
    sf = "/root/testdata/sf0.001"
    g = catalog.sample(spark, sf)
    ids: dict[str, list[str]] = {}
    for r in g.graph_nodes.select("kgid", "name_key").collect():
        ids.setdefault(r.name_key, []).append(r.kgid)
    near: dict[str, set[str]] = {}
    for r in g.graph_rels.select("from_kgid", "to_kgid").collect():
        near.setdefault(r.from_kgid, set()).add(r.to_kgid)
        near.setdefault(r.to_kgid, set()).add(r.from_kgid)
    want = {}
    for pair, (a, b) in enumerate(catalog.ENDS, 1):
        (start,), (end,) = ids[a], ids[b]
        paths = {start: [start]}
        layer, length = paths, 0
        while end not in paths and length < 4:
            new: dict[str, list[str]] = {}
            for at, path in layer.items():
                for to in near[at] - {*paths}:
                    new[to] = min(new.get(to, [*path, to]), [*path, to])
            layer, length = new, length + 1
            paths = paths | new
        if end in paths:
            want[pair] = (length, ">".join(paths[end]))
    got = {r.pair: (r.length, r.path) for r in catalog.queries()["shortest_path_pairs"](spark, sf).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and got[1][0] == 2
    assert got == want


def test_review_and_verdicts(spark):
    ledger = spark.createDataFrame([("a", 1, "old"), ("b", 2, "old"), ("c", 0, None), ("d", 1, "old")], "file string, reject_count int, last_reject_reason string")
    decisions = spark.createDataFrame([("a", True, None), ("c", False, "new" * 200), ("d", False, "")], "file string, approve boolean, reason string")
    got = {r.file: (r.reject_count, r.last_reject_reason) for r in workflow.review(ledger, decisions).collect()}
    assert got == {"a": (0, "old"), "b": (2, "old"), "c": (1, ("new" * 200)[:500]), "d": (2, None)}
    rows = [(3, 0, 0, 0), (3, 1, 0, 0), (0, 1, 0, 0), (0, 0, 2, 0), (0, 0, 0, 2), (0, 1, 0, 1)]
    verdict = workflow.collection_verdict(*map(F.col, "cfrp"))
    assert [v[0] for v in values(spark, rows, "c int, f int, r int, p int", verdict)] == ["success", "partial", "fail", "fail", "success", "partial"]
    failures = [(1, "disk quota of the host", "crash"), (1, "Quota exceeded", "rate_limit"), (0, "429", "ok"), (1, "HTTP 429", "rate_limit"), (1, "dong 429-2", "crash"), (1, "사용량 한도", "rate_limit")]
    kind = text.engine_failure(F.col("c"), F.col("e"), F.lit(False), F.lit(None).cast("string"))
    assert [tuple(v) for v in values(spark, failures, "c int, e string, w string", kind, "w")] == [(w, w) for *_, w in failures]


def test_depth_with_cycles_ends(spark):
    nodes = spark.range(7).select("id")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 1), (2, 3), (4, 4), (5, 6)], "src long, dst long")
    got = {r.id: r.depth for r in graph.dag_depth(nodes, edges).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 0, 5: 0, 6: 1}


def test_crawl(spark):
    """Long ways, the cap, known pages and robots."""
    chain = [(f"u{i}", 0, f"u{i + 1}", "d") for i in range(25)]
    links = spark.createDataFrame(chain + [("u0", 1, "x", "other"), ("u1", 1, "r", "d"), ("u1", 2, "b", "d")], "src string, pos long, dst string, dst_domain string")
    start = spark.createDataFrame([("u0", "d")], "url string, domain string")
    known, blocked = spark.createDataFrame([("u2",), ("u4",)], "url string"), spark.createDataFrame([("b",)], "url string")
    got = workflow.crawl(start, links, known, blocked, pages=15, robots=lambda u: u == "r").orderBy("place").collect()
    tried = [f"u{i}" for i in range(17) if i not in (2, 4)]
    assert [(r.url, r.level, r.place) for r in got] == [(u, int(u[1:]), k) for k, u in enumerate(tried, 1)]
    wide = spark.createDataFrame([("u0", i, f"w{i:02}", "d") for i in range(30)] + [("w20", 0, "y", "d")], "src string, pos long, dst string, dst_domain string")
    assert [r.url for r in workflow.crawl(start, wide, pages=5).orderBy("place").collect()] == ["u0", "w00", "w01", "w02", "w03"]
    assert workflow.crawl(start.limit(0), links).count() == 0


def test_generate_changes_engine_on_a_used_up_quota_only(spark, tmp_path):
    from knotwork.api import Engine

    def first(prompt):
        if "limit" in prompt:
            raise RuntimeError("usage limit reached")
        if "crash" in prompt:
            raise RuntimeError("disk quota")
        return "```json\n{\"a\": 1}\n```" if "bad output" in prompt or "good" in prompt else "no object"

    rows = spark.createDataFrame([("s1", "good"), ("s2", "limit"), ("s3", "crash"), ("s4", "odd")], "stem string, prompt string")
    got = {r.stem: (r.json, r.error) for r in Engine(spark, str(tmp_path)).kg_generate(rows, first, lambda p: '{"p": "' + p + '"}').collect()}
    assert got["s1"] == ('{"a": 1}', None) and got["s2"] == ('{"p": "limit"}', None) and got["s3"][0] is None and got["s4"] == ('{"a": 1}', None)


@pytest.mark.parametrize("name", ["counter_texts", "restoration_texts", "database_statuses", "review_moves", "highlight_checks", "probe_pairs", "answer_trace", "golden_digests", "golden_verdicts", "property_absence", "relationship_absence"])
def test_texts_moves_and_audits(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in "customer part orders events documents conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(catalog.oracle_sql()[name]).df()
    got = catalog.queries()[name](spark, sf).toPandas()[list(want.columns)]
    rows = lambda d: sorted(map(repr, d.astype(object).where(d.notna(), None).values.tolist()))
    assert rows(got) == rows(want) and len(got)


def test_sink_keeps_what_is_not_its_own(spark, tmp_path):
    node = "kgid string, label string, name_key string, name string, reviewed_files array<string>, input_files array<string>"
    rel = "kgid string, from_kgid string, type string, to_kgid string, reviewed_files array<string>"
    out, none = str(tmp_path / "g"), spark.createDataFrame([], rel)
    ours = [("a", "P", "a", "A", ["f"], ["f"]), ("b", "P", "b", "B", ["f"], ["f"])]
    theirs = [("x", "P", "x", "X", None, None), ("y", "P", "y", "Y", [], []), (None, "Q", None, "Z", None, None)]
    links = [("r1", "x", "T", "y", None), ("r2", "x", "T", "a", None), ("r3", "a", "T", "b", ["f"])]
    documents.write_graph(spark.createDataFrame(ours + theirs, node), spark.createDataFrame(links, rel), out, "b9")
    documents.write_graph(spark.createDataFrame(ours[:1], node), none, out, "b10")
    nodes, rels = documents.read_graph(spark, out)
    assert documents.current_build(spark, out) == "b10"
    assert sorted(r.name for r in nodes.collect()) == ["A", "X", "Y", "Z"] and [r.kgid for r in rels.collect()] == ["r1"]
    for rows, links, build in ((ours + ours[:1], [], "b11"), ([*ours, ("c", "P", "b", "C", ["f"], ["f"])], [], "b12"), ([("c", "P", "x", "C", ["f"], ["f"])], [], "b13"), (ours, links[2:] * 2, "b14"), (ours, [], "b10")):
        with pytest.raises(ValueError, match=build):
            documents.write_graph(spark.createDataFrame(rows, node), spark.createDataFrame(links, rel), out, build)
    assert documents.current_build(spark, out) == "b10"
    with pytest.raises(FileNotFoundError):
        documents.read_graph(spark, str(tmp_path / "other"))

