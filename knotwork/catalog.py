"""All queries of the graph engine by name, with DuckDB SQL for each that SQL can express."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import limits as L
from .functions import identity, notices, text
from .operators import audit, filters, graph, merge, validate, workflow
from .operators import search as S
from .plans import generate
from .plans.sample_graph import sample, table
from .plans.search import search
from .plans.store import stored_build
from .streaming import hub, keyed

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


# Common table expressions of the SQL side, in the order they build on each other.
KEY = "lower(trim(regexp_replace(name, '\\s+', ' ', 'g')))"
N = f"""files AS (SELECT unnest(range(4)) AS f), n0 AS (
SELECT 'f' || f AS file, p_partkey AS pos, 'part:' || p_partkey AS local_id, 'Part' AS label, p_name AS name FROM part, files
UNION ALL SELECT 'f' || f, 100000000 + s_suppkey, 'supplier:' || s_suppkey, 'Supplier', s_name FROM supplier, files
UNION ALL SELECT 'f0', 200000000 + n_nationkey, 'nation:' || n_nationkey, 'Nation', n_name FROM nation
UNION ALL SELECT 'f0', 300000000 + r_regionkey, 'region:' || r_regionkey, 'Region', r_name FROM region
UNION ALL SELECT 'f0', 400000000 + c_custkey, 'customer:' || c_custkey, 'Customer', c_name FROM customer),
n AS (SELECT *, {KEY} AS name_key, 'n_' || substr(sha256(label || chr(31) || {KEY}), 1, 16) AS kgid FROM n0)"""
P = f"""{N}, pr AS (
SELECT 'f' || f AS file, p_partkey AS pos, 'Part' AS label, p_name AS name, prop, value FROM (SELECT *, unnest(['brand', 'type', 'size']) AS prop, unnest(['"' || p_brand || '"', '"' || p_type || '"', p_size::VARCHAR]) AS value FROM part), files
UNION ALL SELECT 'f' || f, 100000000 + s_suppkey, 'Supplier', s_name, 'nation', s_nationkey::VARCHAR FROM supplier, files
UNION ALL SELECT 'f0', 200000000 + n_nationkey, 'Nation', n_name, 'region', n_regionkey::VARCHAR FROM nation
UNION ALL SELECT 'f0', 400000000 + c_custkey, 'Customer', c_name, 'segment', '"' || c_mktsegment || '"' FROM customer),
p AS (SELECT file, pos, label, {KEY} AS name_key, prop, value FROM pr)"""
R = f"""{N}, r AS (
SELECT 'f' || (l_orderkey % 4) AS file, l_orderkey * 100 + l_linenumber AS pos, 'SUPPLIES' AS type, 'supplier:' || l_suppkey AS start_id, 'part:' || l_partkey AS end_id, l_orderkey::VARCHAR AS value FROM lineitem
UNION ALL SELECT 'f0', s_suppkey, 'IN_NATION', 'supplier:' || s_suppkey, 'nation:' || s_nationkey, NULL FROM supplier
UNION ALL SELECT 'f0', c_custkey, 'IN_NATION', 'customer:' || c_custkey, 'nation:' || c_nationkey, NULL FROM customer
UNION ALL SELECT 'f0', n_nationkey, 'IN_REGION', 'nation:' || n_nationkey, 'region:' || n_regionkey, NULL FROM nation),
lk AS (SELECT r.*, a.kgid AS from_kgid, b.kgid AS to_kgid, 'r_' || substr(sha256(a.kgid || chr(31) || type || chr(31) || b.kgid), 1, 16) AS kgid
  FROM r JOIN n a ON a.file = r.file AND a.local_id = r.start_id JOIN n b ON b.file = r.file AND b.local_id = r.end_id)"""
GN = "gn AS (SELECT kgid, label, name_key, arg_min(name, (file, pos)) AS name FROM n GROUP BY kgid, label, name_key)"
GR = "gr AS (SELECT kgid, type, from_kgid, to_kgid, count(*) AS occurrences FROM lk GROUP BY ALL)"
KW = """kw(search_id, kw_pos, keyword) AS (VALUES ('s1', 0, 'blue ring'), ('s1', 1, 'NATION_7'), ('s1', 2, ' ring '), ('s1', 3, 'zzzz'),
('s2', 0, 'supplier#000000001'), ('s2', 1, 'upplier#00000000'), ('s2', 2, 'old rod in gear'), ('s3', 0, 'eur'), ('s3', 1, 'new'))"""
KEYED = f"{KW}, k AS (SELECT *, lower(trim(regexp_replace(keyword, '\\s+', ' ', 'g'))) AS kw_key FROM kw)"
STOP = ", ".join(f"'{w}'" for w in S.STOP)


def _tok(x: str) -> str:
    return f"list_filter(regexp_extract_all({x}, '[0-9a-z\\p{{L}}]+(?:·[0-9a-z\\p{{L}}]+)*'), lambda w: w NOT IN ({STOP}))"


T1 = f"""t1 AS (SELECT * FROM (SELECT search_id, kw_pos, kgid, label, name, name_key, 1.0::DOUBLE AS score, row_number() OVER (PARTITION BY search_id, kw_pos ORDER BY name_key, kgid) AS rank FROM k JOIN gn ON kw_key = name_key) WHERE rank <= 5)"""
T2 = f"""dt AS (SELECT kgid, len(t) AS dl, unnest(t) AS token FROM (SELECT kgid, {_tok("name_key")} AS t FROM gn)),
po AS (SELECT token, kgid, count(*) AS tf, max(dl) AS dl FROM dt GROUP BY token, kgid),
co AS (SELECT count(*) AS n_docs, avg(len({_tok("name_key")})) AS avgdl FROM gn),
ak AS (SELECT DISTINCT search_id, kw_pos, unnest({_tok("kw_key")}) AS token FROM k),
df AS (SELECT token, count(*) AS df FROM po GROUP BY token),
sc AS (SELECT search_id, kw_pos, kgid, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * (tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl)))), 9) AS score FROM ak JOIN po USING (token) JOIN df USING (token), co GROUP BY search_id, kw_pos, kgid),
b5 AS (SELECT *, max(score) OVER (PARTITION BY search_id, kw_pos) AS top FROM (SELECT sc.*, label, name, name_key, row_number() OVER (PARTITION BY search_id, kw_pos ORDER BY score DESC, name_key, kgid) AS rank FROM sc JOIN gn USING (kgid)) WHERE rank <= 5),
t2 AS (SELECT search_id, kw_pos, kgid, label, name, name_key, score, rank, score >= 0.5 * top AS kept, round(score / top, 4) AS ratio FROM b5)"""
T3 = """t3 AS (SELECT * FROM (SELECT search_id, kw_pos, kgid, label, name, name_key, 0.5::DOUBLE AS score, row_number() OVER (PARTITION BY search_id, kw_pos ORDER BY name_key, kgid) AS rank
  FROM k JOIN gn ON contains(name_key, kw_key) OR (length(kw_key) >= 4 AND contains(kw_key, name_key)) WHERE kw_key <> '') WHERE rank <= 5)"""
WF = f"""{N}, {GN}, {KEYED}, {T1}, {T2}, {T3}, wf AS (
SELECT search_id, kw_pos, kgid, label, name, name_key, score, rank, 'T1' AS tier FROM t1
UNION ALL SELECT search_id, kw_pos, kgid, label, name, name_key, score, rank, 'T2' FROM t2 WHERE kept AND (search_id, kw_pos) NOT IN (SELECT (search_id, kw_pos) FROM t1)
UNION ALL SELECT search_id, kw_pos, kgid, label, name, name_key, score, rank, 'T3' FROM t3 WHERE (search_id, kw_pos) NOT IN (SELECT (search_id, kw_pos) FROM t1) AND (search_id, kw_pos) NOT IN (SELECT (search_id, kw_pos) FROM t2 WHERE kept))"""


def _keywords(spark: SparkSession) -> DataFrame:
    rows = [("s1", 0, "blue ring"), ("s1", 1, "NATION_7"), ("s1", 2, " ring "), ("s1", 3, "zzzz"), ("s2", 0, "supplier#000000001"), ("s2", 1, "upplier#00000000"), ("s2", 2, "old rod in gear"), ("s3", 0, "eur"), ("s3", 1, "new")]
    # Literals: a list of Python's rows would be read by Python workers, once for each tier that asks.
    return S.with_keys(spark.sql(f"SELECT search_id, kw_pos, keyword, cast(NULL AS string) AS question FROM VALUES {', '.join(map(str, rows))} AS t(search_id, kw_pos, keyword)"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rebuild the graph, search ``blue ring`` within one hop: layer-1 nodes."""
    asked = spark.createDataFrame([("s", 0, "blue ring", None)], "search_id string, kw_pos int, keyword string, question string")
    g = stored_build(spark, sf_dir)
    return search(asked, g.nodes, g.rels, g.index, g.steps).nodes


# --- merge -------------------------------------------------------------------------------------------------


@query(f"WITH {N} SELECT label, name_key, arg_min(name, (file, pos)) AS name, count(DISTINCT file) AS n_files FROM n GROUP BY label, name_key")
def node_merge(spark, sf_dir):
    return sample(spark, sf_dir).graph_nodes.select("label", "name_key", "name", F.size("reviewed_files").cast("long").alias("n_files"))


@query(f"WITH {N} SELECT DISTINCT label, name_key, kgid FROM n")
def kgid_nodes(spark, sf_dir):
    return sample(spark, sf_dir).keyed.select("label", "name_key", "kgid").distinct()


@query(f"WITH {P} SELECT label, name_key, prop, arg_min(value, (file, pos)) AS value FROM p GROUP BY label, name_key, prop")
def node_props_first_wins(spark, sf_dir):
    return merge.first_values(sample(spark, sf_dir).keyed, "label", "name_key")


@query(f"WITH {P} SELECT label, name_key, prop, value, array_to_string(list_sort(list(DISTINCT file)), ',') AS files FROM p GROUP BY label, name_key, prop, value")
def prop_observations(spark, sf_dir):
    return merge.observations(sample(spark, sf_dir).keyed).withColumn("files", F.array_join("files", ","))


@query(f"WITH {P} SELECT label, name_key, prop, count(DISTINCT value) AS n_values FROM p GROUP BY label, name_key, prop HAVING count(DISTINCT value) > 1")
def prop_conflicts(spark, sf_dir):
    return merge.conflicts(merge.observations(sample(spark, sf_dir).keyed)).drop("vals")


OV = [("Part", "blue ring", "brand", '"Brand#1"'), ("Part", "blue ring", "brand2", '"x"'), ("Part", "no such part", "brand", '"x"'), ("Part", "red rod", "size", "7"), ("Part", "red rod", "type", '"NEVER"')]
OV_SQL = "ov(label, name_key, prop, value) AS (VALUES " + ", ".join("('{}', '{}', '{}', '{}')".format(*o) for o in OV) + ")"


def _judged(spark, sf_dir):
    g = sample(spark, sf_dir)
    rows = spark.createDataFrame(OV, "label string, name_key string, prop string, value string")
    return merge.judge_overrides(rows, g.graph_nodes, merge.observations(g.keyed)), g


JUDGED = f"""{OV_SQL}, jd AS (SELECT ov.*, CASE WHEN NOT EXISTS (SELECT 1 FROM n WHERE n.label = ov.label AND n.name_key = ov.name_key) THEN 'no_node'
WHEN NOT EXISTS (SELECT 1 FROM p WHERE p.label = ov.label AND p.name_key = ov.name_key AND p.prop = ov.prop) THEN 'no_property'
WHEN NOT EXISTS (SELECT 1 FROM p WHERE p.label = ov.label AND p.name_key = ov.name_key AND p.prop = ov.prop AND p.value = ov.value) THEN 'value_not_observed' ELSE 'applied' END AS outcome FROM ov)"""


@query(f"WITH {P}, {JUDGED} SELECT * FROM jd WHERE outcome <> 'applied'")
def prop_overrides_unapplied(spark, sf_dir):
    return _judged(spark, sf_dir)[0].where("outcome <> 'applied'")


@query(f"""WITH {P}, {JUDGED}, fw AS (SELECT label, name_key, prop, arg_min(value, (file, pos)) AS value FROM p GROUP BY label, name_key, prop)
SELECT fw.label, fw.name_key, fw.prop, coalesce(jd.value, fw.value) AS value FROM fw LEFT JOIN jd ON jd.label = fw.label AND jd.name_key = fw.name_key AND jd.prop = fw.prop AND outcome = 'applied'""")
def prop_overrides_applied(spark, sf_dir):
    judged, g = _judged(spark, sf_dir)
    return merge.apply_overrides(merge.first_values(g.keyed, "label", "name_key"), judged)


CANON = [("Part", "blue ring", "Part", "Old Ring"), ("Part", "blue ring", "Part", "new  ring"), ("Region", "NOWHERE", "Nation", "nation_3")]


@query(f"""WITH {N}, cd(cl, cn, label, name_key) AS (VALUES ('Part', 'blue ring', 'Part', 'old ring'), ('Part', 'blue ring', 'Part', 'new ring'), ('Region', 'NOWHERE', 'Nation', 'nation_3'))
SELECT coalesce(cl, label) AS label, lower(coalesce(cn, name)) AS name_key, count(*) AS n, count(cl) AS n_changed FROM n LEFT JOIN cd USING (label, name_key) GROUP BY ALL""")
def canonicalize_entities(spark, sf_dir):
    entries = spark.createDataFrame(CANON, "canonical_label string, canonical_name string, label string, name string")
    keyed = sample(spark, sf_dir, F.broadcast(merge.dictionary_index(entries))).keyed
    return keyed.groupBy("label", "name_key").agg(F.count("*").alias("n"), F.count_if("changed").alias("n_changed"))


@query(f"WITH {R} SELECT type, from_kgid, to_kgid, kgid, count(*) AS occurrences FROM lk GROUP BY ALL")
def rel_merge_dedupe(spark, sf_dir):
    return sample(spark, sf_dir).graph_rels.select("type", "from_kgid", "to_kgid", "kgid", "occurrences")


@query(f"WITH {R} SELECT kgid, arg_min(value, (file, pos)) AS first_order FROM lk WHERE value IS NOT NULL GROUP BY kgid")
def rel_props_first_wins(spark, sf_dir):
    g = sample(spark, sf_dir)
    # One property a row instead of a map, and no row without one, before the joins.
    rels = g.rels.where(F.size("props") > 0).select("file", "pos", "type", "start_id", "end_id", F.explode("props").alias("prop", "value"))
    linked = merge.linked_rels(rels, g.keyed)
    return merge.first_of(linked, "kgid").select("kgid", F.col("value").alias("first_order"))


@query(f"WITH {R} SELECT kgid, array_to_string(list_sort(list(DISTINCT file || '.md')), ',') AS input_files FROM lk GROUP BY kgid")
def provenance_sets(spark, sf_dir):
    return sample(spark, sf_dir).graph_rels.select("kgid", F.array_join("input_files", ",").alias("input_files"))


@query(f"""WITH {R}, {GN}, {GR} SELECT (SELECT count(DISTINCT file) FROM n) AS files, (SELECT count(*) FROM gn) AS nodes, (SELECT count(*) FROM gr) AS rels,
(SELECT count(*) FROM n) - (SELECT count(*) FROM gn) AS merged, 0::BIGINT AS canonicalized""")
def merge_summary(spark, sf_dir):
    g = sample(spark, sf_dir)
    return merge.summary(g.graph_nodes, g.keyed, g.graph_nodes, g.graph_rels)


@query(f"""WITH {N}, {GN}, gs AS (SELECT DISTINCT label, name_key FROM gn) SELECT a.label, a.name_key AS a_key, b.name_key AS b_key FROM gs a JOIN gs b ON a.label = b.label AND a.name_key <> '' AND (length(a.name_key), a.name_key) < (length(b.name_key), b.name_key) AND contains(b.name_key, a.name_key)""")
def similar_name_pairs(spark, sf_dir):
    return merge.similar_names(sample(spark, sf_dir).graph_nodes.select("label", "name_key").distinct())


# --- validation --------------------------------------------------------------------------------------------


@query(f"WITH {R}, m AS (SELECT file, local_id FROM n WHERE pos % 10 <> 0) SELECT file, pos::VARCHAR AS place, 'dangling_end' AS code FROM (SELECT file, pos, unnest([start_id, end_id]) AS local_id FROM r) ANTI JOIN m USING (file, local_id)")
def validate_dangling(spark, sf_dir):
    g = sample(spark, sf_dir)
    return validate.dangling(g.nodes.where("pos % 10 <> 0"), g.rels)


@query("SELECT 'x' AS file, l_orderkey || ':' || l_linenumber AS place, 'duplicate_id' AS code FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def validate_duplicate_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.lit("x").alias("file"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("id"))
    return validate.duplicate_ids(rows, "id")


@query("SELECT DISTINCT 'label' AS kind, 'T' || c_mktsegment AS name FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') UNION SELECT 'type', 'E_' || event_type FROM events WHERE event_type <> 'click'")
def new_types(spark, sf_dir):
    nodes = table(spark, sf_dir, "customer").select(F.concat(F.lit("T"), "c_mktsegment").alias("label"))
    rels = table(spark, sf_dir, "events").select(F.concat(F.lit("E_"), "event_type").alias("type"))
    known = spark.createDataFrame([("label", "TBUILDING"), ("label", "TMACHINERY"), ("type", "E_click")], "kind string, name string")
    return validate.new_types(nodes, rels, known)


@query("""SELECT kind, count(*) AS n FROM (SELECT CASE event_id % 5 WHEN 0 THEN 'scalar' WHEN 1 THEN 'array' WHEN 2 THEN 'null_element' WHEN 3 THEN 'mixed' ELSE 'object' END AS kind FROM events) GROUP BY kind""")
def prop_type_gate(spark, sf_dir):
    n = F.pmod("event_id", F.lit(5))
    made = F.when(n == 0, F.col("value").cast("string")).when(n == 1, F.concat(F.lit('["a", "'), "event_type", F.lit('"]'))).when(n == 2, F.lit("[1, null]")).when(n == 3, F.concat(F.lit('["'), "event_type", F.lit('", 2]'))).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select(validate.value_kind(made).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT 'v' || event_id % 7 AS place, count(*) AS n FROM events WHERE event_id % 7 IN (0, 3) GROUP BY 1")
def naming_gate(spark, sf_dir):
    labels = F.element_at(F.array(*(F.lit(x) for x in ("person", "Person", "Work", "A-B", "P1", "Ab", "Film"))), (F.pmod("event_id", F.lit(7)) + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", labels.alias("label"))
    return rows.where(~F.col("label").rlike(L.LABEL_RULE)).groupBy(F.concat(F.lit("v"), F.pmod("event_id", F.lit(7))).alias("place")).agg(F.count("*").alias("n"))


# --- search ------------------------------------------------------------------------------------------------

COLS = ["search_id", "kw_pos", "kgid", "name", "cast(rank as bigint) AS rank"]


@query(f"WITH {N}, {GN}, {KEYED}, {T1} SELECT search_id, kw_pos, kgid, name, rank FROM t1")
def search_t1(spark, sf_dir):
    g = stored_build(spark, sf_dir)
    return S.exact(_keywords(spark), g.nodes, g.index).selectExpr(*COLS)


T2_ROWS = f"WITH {N}, {GN}, {KEYED}, {T2} SELECT search_id, kw_pos, kgid, name, rank, round(score, 6) AS score FROM t2"


@query(T2_ROWS)
def search_t2_bm25(spark, sf_dir):
    """With an index made for this search."""
    nodes = sample(spark, sf_dir).stored_nodes()
    return S.floored(S.bm25(_keywords(spark), nodes, S.build_index(nodes))).selectExpr(*COLS, "round(score, 6) AS score")


@query(T2_ROWS)
def search_t2_stored(spark, sf_dir):
    """With the index that was kept with the build."""
    g = stored_build(spark, sf_dir)
    return S.floored(S.bm25(_keywords(spark), g.nodes, g.index)).selectExpr(*COLS, "round(score, 6) AS score")


# Names of mixed scripts from a table: 2 to 6 characters of Hangul, kana or han behind, before and inside Latin words.
MIXED = "concat(substr('ab12한국어사전', 1 + c_custkey % 5, 2 + c_custkey % 6), substr('カタナひら刀剣鬼滅', 1 + c_nationkey % 7, 1 + c_custkey % 4), ' ', substr('x대한y민국zカナ日本', 1 + c_custkey % 9, 3 + c_nationkey % 4), '·', c_nationkey)"
SCRIPT_RUNS = "[가-힣]+|[\\u3040-\\u30FF]+|[\\u4E00-\\u9FFF]+|[0-9a-z]+(?:·[0-9a-z]+)*"
CJK_RUNS = "[가-힣]+|[\\x{3040}-\\x{30FF}]+|[\\x{4E00}-\\x{9FFF}]+|[0-9a-z]+(?:·[0-9a-z]+)*"


@query(f"""WITH m AS (SELECT c_custkey, {MIXED} AS name FROM customer), r AS (SELECT c_custkey, unnest(regexp_extract_all(name, '{CJK_RUNS}')) AS run FROM m),
t AS (SELECT c_custkey, unnest(CASE WHEN length(run) > 1 AND regexp_matches(run, '^[^0-9a-z]') THEN list_transform(range(1, length(run)), lambda i: substr(run, i, 2)) ELSE [run] END) AS token FROM r WHERE run NOT IN ({STOP}))
SELECT token, count(*) AS n, count(DISTINCT c_custkey) AS n_docs FROM t GROUP BY token""")
def cjk_tokens(spark, sf_dir):
    """Tokens of names that mix scripts inside a word."""
    # Dealt by document before names become tokens: (document, token) is counted within parts, whose size doesn't follow the file's.
    named = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{MIXED} AS name").repartition("c_custkey")
    rows = named.select("c_custkey", F.explode(S.tokens(F.col("name"))).alias("token"))
    each = rows.groupBy("c_custkey", "token").agg(F.count("*").alias("n"))
    return each.groupBy("token").agg(F.sum("n").alias("n"), F.count("c_custkey").alias("n_docs"))


@query(f"WITH {N}, {GN}, {KEYED}, {T2} SELECT search_id, kw_pos, kgid, ratio FROM t2 WHERE NOT kept")
def t2_floor_cuts(spark, sf_dir):
    g = stored_build(spark, sf_dir)
    return S.floored(S.bm25(_keywords(spark), g.nodes, g.index)).where("not kept").select("search_id", "kw_pos", "kgid", "ratio")


T3_ROWS = f"WITH {N}, {GN}, {KEYED}, {T3} SELECT search_id, kw_pos, kgid, name, rank FROM t3"


@query(T3_ROWS)
def search_t3_contains(spark, sf_dir):
    return S.containing(_keywords(spark), sample(spark, sf_dir).stored_nodes()).selectExpr(*COLS)


@query(T3_ROWS)
def search_t3_stored(spark, sf_dir):
    """Over the gram postings that were kept with the build."""
    g = stored_build(spark, sf_dir)
    return S.containing(_keywords(spark), g.nodes, g.index).selectExpr(*COLS)


@query(f"WITH {WF} SELECT search_id, kw_pos, kgid, name, rank, tier FROM wf")
def search_waterfall(spark, sf_dir):
    g = stored_build(spark, sf_dir)
    return S.waterfall(_keywords(spark), g.nodes, g.index).selectExpr(*COLS, "tier")


@query(f"WITH {WF} SELECT search_id, kw_pos, keyword FROM kw WHERE (search_id, kw_pos) NOT IN (SELECT (search_id, kw_pos) FROM wf)")
def search_unmatched(spark, sf_dir):
    g, asked = stored_build(spark, sf_dir), _keywords(spark)
    return S.unmatched(asked, S.seeds(asked, g.nodes, g.index))


CAP = f"cap AS (SELECT * FROM wf WHERE (search_id, kgid) IN (SELECT (search_id, kgid) FROM (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY score DESC, kw_pos, rank) AS g FROM wf) WHERE g <= {L.MAX_SEEDS}))"


@query(f"WITH {WF}, {CAP} SELECT search_id, kw_pos, kgid, tier FROM cap")
def seed_global_cap(spark, sf_dir):
    g = stored_build(spark, sf_dir)
    return S.capped(S.seeds(_keywords(spark), g.nodes, g.index)).select("search_id", "kw_pos", "kgid", "tier")


LOC = "nx AS (SELECT DISTINCT kgid, label, name_key FROM n), wy AS (SELECT from_kgid AS fr, to_kgid AS o, kgid FROM gr UNION ALL SELECT to_kgid, from_kgid, kgid FROM gr WHERE from_kgid <> to_kgid)"
H1 = f"h0 AS (SELECT kgid FROM nx WHERE label = 'Nation' AND name_key IN ('nation_3', 'nation_8')), e1 AS (SELECT * FROM wy WHERE fr IN (SELECT kgid FROM h0) ORDER BY kgid, fr LIMIT {L.RELS_PER_HOP}), h1 AS (SELECT DISTINCT o AS kgid FROM e1 WHERE o NOT IN (SELECT kgid FROM h0))"
H2 = f"e2 AS (SELECT * FROM wy WHERE fr IN (SELECT kgid FROM h1) ORDER BY kgid, fr LIMIT {L.RELS_PER_HOP}), h2 AS (SELECT DISTINCT o AS kgid FROM e2 WHERE o NOT IN (SELECT kgid FROM h0) AND o NOT IN (SELECT kgid FROM h1))"


H1_ALL = "h0 AS (SELECT kgid FROM nx WHERE label = 'Nation' AND name_key IN ('nation_3', 'nation_8')), e1 AS (SELECT * FROM wy WHERE fr IN (SELECT kgid FROM h0)), h1 AS (SELECT DISTINCT o AS kgid FROM e1 WHERE o NOT IN (SELECT kgid FROM h0))"


def _hops(spark, sf_dir, k, most=L.RELS_PER_HOP):
    g = stored_build(spark, sf_dir)
    start = g.nodes.where("label = 'Nation' and name_key in ('nation_3', 'nation_8')").select(F.lit("s").alias("search_id"), "kgid")
    return S.hops(start, g.steps, k, most)[0].select("kgid", F.col("hop").cast("long").alias("hop"))


@query(f"WITH {R}, {GR}, {LOC}, {H1_ALL} SELECT kgid, 0::BIGINT AS hop FROM h0 UNION ALL SELECT kgid, 1 FROM h1")
def khop_1(spark, sf_dir):
    """All neighbours, however many a hop reads."""
    return _hops(spark, sf_dir, 1, None)


@query(f"WITH {R}, {GR}, {LOC}, {H1}, {H2} SELECT kgid, 0::BIGINT AS hop FROM h0 UNION ALL SELECT kgid, 1 FROM h1 UNION ALL SELECT kgid, 2 FROM h2")
def khop_2(spark, sf_dir):
    return _hops(spark, sf_dir, 2)




ENDS = [("supplier#000000000", "supplier#000000001"), ("nation_1", "nation_6"), ("customer#000000001", "nation_19"), ("customer#000000000", "nation_7"), ("nation_0", "nation_1")]


def _walk_sql() -> str:
    """Steps p0 .. p4 from a pair's first node, each to the least neighbour that is one nearer to the second."""
    steps = ["p0 AS (SELECT pp.pair, a AS here, ds.d AS length, a AS path FROM pp JOIN ds ON ds.pair = pp.pair AND ds.kgid = a)"]
    for k in range(1, L.PATH_LENGTH + 1):
        nearer = f"SELECT p.pair, min(o) AS o FROM p{k - 1} p JOIN tw ON fr = here JOIN ds ON ds.pair = p.pair AND ds.kgid = o AND ds.d = length - {k} GROUP BY p.pair"
        steps.append(f"p{k} AS (SELECT p.pair, coalesce(o, here) AS here, length, CASE WHEN o IS NULL THEN path ELSE path || '>' || o END AS path FROM p{k - 1} p LEFT JOIN ({nearer}) x ON x.pair = p.pair)")
    return ", ".join(steps)


@query(f"""WITH RECURSIVE {R}, {GR}, tw AS (SELECT from_kgid AS fr, to_kgid AS o FROM gr UNION SELECT to_kgid, from_kgid FROM gr), pe(pair, a_key, b_key) AS (VALUES {", ".join(f"({i + 1}, '{a}', '{b}')" for i, (a, b) in enumerate(ENDS))}),
pp AS (SELECT pair, a.kgid AS a, b.kgid AS b FROM pe JOIN (SELECT DISTINCT kgid, name_key FROM n) a ON a.name_key = a_key JOIN (SELECT DISTINCT kgid, name_key FROM n) b ON b.name_key = b_key),
w AS (SELECT pair, b AS kgid, 0 AS d FROM pp UNION SELECT pair, o, d + 1 FROM w JOIN tw ON fr = kgid WHERE d < {L.PATH_LENGTH}),
ds AS (SELECT pair, kgid, min(d) AS d FROM w GROUP BY pair, kgid), {_walk_sql()} SELECT pair, length::BIGINT AS length, path FROM p{L.PATH_LENGTH}""")
def shortest_path_pairs(spark, sf_dir):
    """Over relationships of all types."""
    return _paths(spark, sf_dir)


def _paths(spark, sf_dir):
    g = stored_build(spark, sf_dir)
    ids = g.nodes.select("kgid", "name_key")
    ends = spark.createDataFrame([(i + 1, a, b) for i, (a, b) in enumerate(ENDS)], "pair int, a_key string, b_key string")
    pairs = ends.join(ids.withColumnsRenamed({"kgid": "a", "name_key": "a_key"}), "a_key").join(ids.withColumnsRenamed({"kgid": "b", "name_key": "b_key"}), "b_key").select(F.lit("s").alias("search_id"), "pair", "a", "b")
    found = S.shortest_paths(pairs, g.steps)
    return found.select("pair", F.col("length").cast("long").alias("length"), F.array_join("nodes", ">").alias("path"))


def _hop_sql(k: int) -> str:
    """Hops e1, h1 .. ek, hk of all searches from their seeds."""
    out = ["h0 AS (SELECT DISTINCT search_id, kgid, 0 AS hop FROM cap)", "wy AS (SELECT from_kgid AS fr, to_kgid AS o, kgid, type, from_kgid, to_kgid FROM gr UNION ALL SELECT to_kgid, from_kgid, kgid, type, from_kgid, to_kgid FROM gr WHERE from_kgid <> to_kgid)"]
    for i in range(1, k + 1):
        seen = " UNION ALL ".join(f"SELECT search_id, kgid FROM h{j}" for j in range(i))
        out.append(f"e{i} AS (SELECT h.search_id, {i} AS hop, w.* FROM h{i - 1} h JOIN wy w ON fr = h.kgid QUALIFY row_number() OVER (PARTITION BY h.search_id ORDER BY w.kgid, fr) <= {L.RELS_PER_HOP})")
        out.append(f"h{i} AS (SELECT DISTINCT search_id, o AS kgid, {i} AS hop FROM e{i} WHERE (search_id, o) NOT IN ({seen}))")
    return ", ".join(out)


def _seed_path_sql() -> str:
    """Path pt(search_id, pair, p, kgid, rel) of each pair of first seeds: the least shortest one."""
    steps = ["p0 AS (SELECT sp.search_id, sp.pair, a AS here, ds.d AS length, NULL AS rel FROM sp JOIN ds ON ds.search_id = sp.search_id AND ds.pair = sp.pair AND ds.kgid = a WHERE a <> b)"]
    for k in range(1, L.PATH_LENGTH + 1):
        steps.append(f"""p{k} AS (SELECT x.search_id, x.pair, s.o AS here, x.length, s.kgid AS rel FROM (SELECT p.search_id, p.pair, p.length, min({{'o': w.o, 'kgid': w.kgid}}) AS s FROM p{k - 1} p JOIN wy w ON w.fr = p.here
  JOIN ds ON ds.search_id = p.search_id AND ds.pair = p.pair AND ds.kgid = w.o AND ds.d = p.length - {k} GROUP BY p.search_id, p.pair, p.length) x)""")
    every = " UNION ALL ".join(f"SELECT search_id, pair, {k} AS p, here AS kgid, rel FROM p{k}" for k in range(L.PATH_LENGTH + 1))
    return f"""fs AS (SELECT search_id, kgid, min(kw_pos) AS kw_pos FROM cap WHERE rank = 1 GROUP BY search_id, kgid),
sp AS (SELECT a.search_id, row_number() OVER (PARTITION BY a.search_id ORDER BY a.kw_pos, b.kw_pos) AS pair, a.kgid AS a, b.kgid AS b FROM fs a JOIN fs b ON a.search_id = b.search_id AND a.kw_pos < b.kw_pos QUALIFY pair <= {L.PATH_PAIRS}),
rw AS (SELECT search_id, pair, b AS kgid, 0 AS d FROM sp UNION SELECT search_id, pair, w.o, d + 1 FROM rw JOIN wy w ON fr = rw.kgid WHERE d < {L.PATH_LENGTH}),
ds AS (SELECT search_id, pair, kgid, min(d) AS d FROM rw GROUP BY ALL), {", ".join(steps)}, pt AS ({every})"""


def _layer_sql(k: int) -> str:
    reached = " UNION ALL ".join(f"SELECT search_id, kgid, 0.0, {i} + 1 FROM h{i}" for i in range(1, k + 1))
    return f"""WITH RECURSIVE {R}, {GN}, {GR}, {KEYED}, {T1}, {T2}, {T3}, {WF[WF.index("wf AS"):]}, {CAP}, {_hop_sql(k)}, {_seed_path_sql()},
ev AS (SELECT search_id, kgid, min(priority) AS priority, max(score) AS score FROM (SELECT search_id, kgid, score, 0 AS priority FROM cap UNION ALL SELECT search_id, kgid, 0.0, 1 FROM pt UNION ALL {reached}) GROUP BY search_id, kgid),
ly AS (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY priority, score DESC, name_key, kgid) AS k, count(*) OVER (PARTITION BY search_id) AS total FROM ev JOIN gn USING (kgid)),
tp AS (SELECT search_id, 'n' || k AS alias, kgid, label, name, CASE priority WHEN 0 THEN '0' WHEN 1 THEN 'path' ELSE (priority - 1)::VARCHAR END AS hop, score, total > {L.DEFAULT_NODES} AS truncated FROM ly WHERE k <= {L.DEFAULT_NODES})"""


@query(f"{_layer_sql(2)} SELECT * FROM tp")
def layer1_nodes(spark, sf_dir):
    """On the stored build, within two hops."""
    g = stored_build(spark, sf_dir)
    return search(_keywords(spark).drop("kw_key"), g.nodes, g.rels, g.index, g.steps, hops=2).nodes


@query(f"""{_layer_sql(1)}, us AS (SELECT search_id, kgid, min(hop) AS first FROM (SELECT search_id, kgid, hop FROM e1 UNION ALL SELECT search_id, rel, {L.MAX_HOPS + 1} FROM pt WHERE rel IS NOT NULL) GROUP BY search_id, kgid),
kp AS (SELECT us.*, type, a.alias AS from_alias, b.alias AS to_alias, row_number() OVER (PARTITION BY us.search_id ORDER BY first, us.kgid) AS k, count(*) OVER (PARTITION BY us.search_id) AS total
  FROM us JOIN gr USING (kgid) JOIN tp a ON a.search_id = us.search_id AND a.kgid = from_kgid JOIN tp b ON b.search_id = us.search_id AND b.kgid = to_kgid)
SELECT search_id, 'r' || k AS alias, kgid, type, from_alias, to_alias, total > {L.RELS} AS truncated FROM kp WHERE k <= {L.RELS}""")
def layer1_rels(spark, sf_dir):
    """On the stored build, within one hop."""
    g = stored_build(spark, sf_dir)
    return search(_keywords(spark).drop("kw_key"), g.nodes, g.rels, g.index, g.steps).rels


@query(f"""WITH {P}, f AS (SELECT kgid, prop, arg_min(value, (p.file, p.pos)) AS value FROM p JOIN (SELECT DISTINCT kgid, label, name_key FROM n) USING (label, name_key) GROUP BY kgid, prop)
SELECT kgid AS id, string_agg(prop || '=' || left(trim(value, '"'), {L.FACT_CHARS}), ';' ORDER BY prop) AS facts FROM f GROUP BY kgid""")
def node_facts(spark, sf_dir):
    return _facts(spark, sf_dir)



def _facts(spark, sf_dir):
    keyed = sample(spark, sf_dir).keyed
    nodes = merge.as_map(merge.first_values(keyed, "kgid"), "kgid").withColumnRenamed("kgid", "id")
    shown = filters.node_facts(nodes)
    return shown.select("id", F.array_join(F.transform(F.array_sort(F.map_entries("facts")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("facts"))


@query("""WITH al AS (SELECT 'n' || s_suppkey AS alias, 'node' AS kind, 'k' || s_suppkey AS kgid FROM supplier UNION ALL SELECT 'r' || s_suppkey, 'rel', 'q' || s_suppkey FROM supplier),
ci AS (SELECT DISTINCT 's' || c_custkey % 40 AS search_id, CASE c_custkey % 3 WHEN 0 THEN 'n' WHEN 1 THEN 'r' ELSE 'x' END || c_custkey AS alias FROM customer)
SELECT search_id, count(*) AS submitted, count(kgid) AS accepted, CASE WHEN count(kgid) = 0 THEN 'none' WHEN count(kgid) < count(*) THEN 'partial' ELSE 'verified' END AS status, count(*) > 0.5 * 12 AS dense FROM ci LEFT JOIN al USING (alias) GROUP BY search_id""")
def citation_verify(spark, sf_dir):
    return _citations(spark, sf_dir, table(spark, sf_dir, "customer"))



def _citations(spark, sf_dir, customers):
    of = table(spark, sf_dir, "supplier").select(F.explode(F.sequence(F.lit(0), F.lit(39))).alias("s"), "s_suppkey")
    search_id = F.concat(F.lit("s"), "s").alias("search_id")
    nodes = of.select(search_id, F.concat(F.lit("n"), "s_suppkey").alias("alias"), F.lit("node").alias("kind"), F.concat(F.lit("k"), "s_suppkey").alias("kgid"), F.lit(None).cast("string").alias("from_kgid"), F.lit(None).cast("string").alias("to_kgid"))
    rels = of.select(search_id, F.concat(F.lit("r"), "s_suppkey").alias("alias"), F.lit("rel").alias("kind"), F.concat(F.lit("q"), "s_suppkey").alias("kgid"), F.concat(F.lit("k"), "s_suppkey").alias("from_kgid"), F.lit("k0").alias("to_kgid"))
    n = F.pmod("c_custkey", F.lit(3))
    cited = customers.select(F.concat(F.lit("s"), F.pmod("c_custkey", F.lit(40))).alias("search_id"), F.concat(F.when(n == 0, "n").when(n == 1, "r").otherwise("x"), "c_custkey").alias("alias"))
    sizes = of.select(search_id, F.lit(12).alias("total")).distinct()
    return S.citation_status(S.verify_citations(cited, nodes.unionByName(rels)), sizes)


# --- graph analytics ---------------------------------------------------------------------------------------

# A graph with cycles of many sizes: each customer points to another of its block of 60.
CY = "ed AS (SELECT c_custkey AS src, (c_custkey * 7 + 3) % 60 + 60 * (c_custkey // 60) AS dst FROM customer), no AS (SELECT c_custkey AS id FROM customer), e AS (SELECT ed.* FROM ed JOIN no ON dst = id)"
REACH = "re AS (SELECT src AS a, dst AS b FROM e UNION SELECT a, dst FROM re JOIN e ON b = src)"
SCC = "sc AS (SELECT id, least(id, coalesce(min(x.b), id)) AS component FROM no LEFT JOIN (SELECT p.a, p.b FROM re p JOIN re q ON p.a = q.b AND p.b = q.a) x ON x.a = id GROUP BY id)"


def _cycles(spark, sf_dir):
    nodes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    edges = nodes.select(F.col("id").alias("src"), (F.pmod(F.col("id") * 7 + 3, F.lit(60)) + 60 * F.floor(F.col("id") / 60)).alias("dst"))
    return nodes, edges.join(nodes.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")


@query(f"WITH RECURSIVE {CY}, {REACH}, {SCC} SELECT id, component FROM sc")
def scc(spark, sf_dir):
    return graph.strong_components(*_cycles(spark, sf_dir))


@query(f"WITH RECURSIVE {CY}, {REACH}, {SCC} SELECT src, dst FROM e JOIN sc a ON a.id = src JOIN sc b ON b.id = dst WHERE a.component = b.component")
def dag_cycle_edges(spark, sf_dir):
    nodes, edges = _cycles(spark, sf_dir)
    return graph.cyclic_edges(edges, graph.strong_components(nodes, edges)).select("src", "dst")


@query(f"""WITH RECURSIVE {CY}, {REACH}, {SCC}, cy AS (SELECT src, dst FROM e JOIN sc a ON a.id = src JOIN sc b ON b.id = dst WHERE a.component = b.component)
SELECT (SELECT count(*) FROM cy) = 0 AS is_dag, (SELECT count(*) FROM cy) AS cyclic_edges, (SELECT count(*) FROM cy WHERE src = dst) AS self_loops, (SELECT count(*) FROM (SELECT component FROM sc GROUP BY 1 HAVING count(*) > 1)) AS cyclic_components""")
def dag_summary(spark, sf_dir):
    nodes, edges = _cycles(spark, sf_dir)
    return graph.analyze_dag(nodes, edges, graph.strong_components(nodes, edges))


def _cycles_whole(spark, sf_dir):
    """All customers, with the same edges; those of nations 0 to 19 point to one anywhere in the table as well."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("src"), "c_nationkey")
    near = customers.select("src", (F.pmod(F.col("src") * 7 + 3, F.lit(60)) + 60 * F.floor(F.col("src") / 60)).alias("dst"))
    far = customers.where("c_nationkey < 20").select("src", F.pmod(F.col("src") * 31 + 11, F.lit(max(1, customers.count()))).alias("dst"))
    nodes = customers.select(F.col("src").alias("id"))
    return nodes, near.unionByName(far).distinct().join(nodes.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")


@query()
def scc_whole(spark, sf_dir):
    """No SQL: the closure of a component of thousands has millions of pairs."""
    return graph.strong_components(*_cycles_whole(spark, sf_dir))


@query()
def dag_cycle_edges_whole(spark, sf_dir):
    nodes, edges = _cycles_whole(spark, sf_dir)
    return graph.cyclic_edges(edges, graph.strong_components(nodes, edges)).select("src", "dst")


@query()
def dag_summary_whole(spark, sf_dir):
    nodes, edges = _cycles_whole(spark, sf_dir)
    return graph.analyze_dag(nodes, edges, graph.strong_components(nodes, edges))


# An acyclic one: each order points to orders of a smaller key. Order 0 would point to itself; it is a node through order 1.
DG = "ed AS (SELECT o_orderkey AS src, o_orderkey // 2 AS dst FROM orders WHERE o_orderkey >= 1 UNION SELECT o_orderkey, o_orderkey // 3 FROM orders WHERE o_orderkey >= 1), no AS (SELECT DISTINCT unnest([src, dst]) AS id FROM ed)"


@query()
def cyclic_depth(spark, sf_dir):
    """Customers in cycles, below them nations and regions. No SQL: depths in a cycle depend on the walk's order."""
    return graph.cyclic_depth(*_cycles_above_nations(spark, sf_dir))


def _cycles_above_nations(spark, sf_dir):
    nodes, edges = _cycles(spark, sf_dir)
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    nation_id, region_id = (lambda c: -100 - F.col(c)), (lambda c: -1000 - F.col(c))  # beside all customers' keys
    lower = customer.select(F.col("c_custkey").alias("src"), nation_id("c_nationkey").alias("dst"))
    lowest = nation.select(nation_id("n_nationkey").alias("src"), region_id("n_regionkey").alias("dst"))
    below = lower.unionByName(lowest)
    return nodes.unionByName(below.select(F.col("dst").alias("id")).distinct()), edges.unionByName(below)


@query(f"WITH RECURSIVE {DG}, wk AS (SELECT id, 0::BIGINT AS depth FROM no UNION SELECT dst, depth + 1 FROM wk JOIN ed ON src = id) SELECT id, max(depth) AS depth FROM wk GROUP BY id")
def dag_depth(spark, sf_dir):
    return _order_depth(table(spark, sf_dir, "orders").where("o_orderkey >= 1"))



def _order_depth(keys):
    edges = keys.select(F.col("o_orderkey").alias("src"), F.floor(F.col("o_orderkey") / 2).alias("dst")).unionByName(keys.select(F.col("o_orderkey").alias("src"), F.floor(F.col("o_orderkey") / 3).alias("dst"))).distinct()
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return graph.dag_depth(nodes, edges)


def _edges(spark, sf_dir):
    return sample(spark, sf_dir).graph_rels.select(F.col("kgid").alias("id"), "type", F.col("from_kgid").alias("src"), F.col("to_kgid").alias("dst"))


@query(f"WITH {R}, {GR} SELECT id, count(*) AS degree FROM (SELECT from_kgid AS id FROM gr UNION ALL SELECT to_kgid FROM gr) GROUP BY id ORDER BY degree DESC, id LIMIT 1")
def highest_degree(spark, sf_dir):
    return graph.highest_degree(_edges(spark, sf_dir))


@query(f"WITH {R}, {GR}, b AS (SELECT from_kgid AS id, to_kgid AS o FROM gr UNION ALL SELECT to_kgid, from_kgid FROM gr) SELECT id, count(DISTINCT o) AS n_neighbours, count(*) AS links FROM b GROUP BY id")
def neighbors(spark, sf_dir):
    return graph.neighbour_counts(_edges(spark, sf_dir))


@query(f"""WITH {R}, {GR}, c AS (SELECT DISTINCT kgid AS id FROM n WHERE label = 'Nation' AND name_key < 'nation_15'), s AS (SELECT id FROM c UNION SELECT to_kgid FROM gr WHERE from_kgid IN (FROM c) UNION SELECT from_kgid FROM gr WHERE to_kgid IN (FROM c))
SELECT kgid AS id FROM gr WHERE from_kgid IN (FROM s) AND to_kgid IN (FROM s)""")
def expand_subset(spark, sf_dir):
    nodes = sample(spark, sf_dir).graph_nodes.where("label = 'Nation' and name_key < 'nation_15'").select(F.col("kgid").alias("id"))
    return graph.expanded(_edges(spark, sf_dir), nodes)[1].select("id")


@query("""WITH e AS (SELECT event_id AS id, user_id % 12 AS src, event_id % 9 AS dst FROM events)
SELECT id, row_number() OVER (PARTITION BY least(src, dst), greatest(src, dst) ORDER BY id) - 1 AS place, count(*) OVER (PARTITION BY least(src, dst), greatest(src, dst)) AS group_size, src = dst AS self_loop FROM e""")
def parallel_edge_groups(spark, sf_dir):
    edges = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.pmod("user_id", F.lit(12)).alias("src"), F.pmod("event_id", F.lit(9)).alias("dst"))
    return graph.parallel_edges(edges).select("id", "place", "group_size", "self_loop")


@query(f"WITH {R}, {GR} SELECT DISTINCT kgid AS id FROM n WHERE kgid IN (SELECT from_kgid FROM gr UNION SELECT to_kgid FROM gr)")
def connected_only(spark, sf_dir):
    nodes = sample(spark, sf_dir).graph_nodes.select(F.col("kgid").alias("id"))
    return graph.connected_only(nodes, _edges(spark, sf_dir))


L12 = "l1 AS (SELECT DISTINCT user_id AS id FROM events WHERE event_id % 3 = 0), l2 AS (SELECT DISTINCT user_id AS id FROM events WHERE event_id % 97 = 0 UNION SELECT 100000), nd AS (SELECT c_custkey AS id FROM customer)"


def _layers(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    one = events.where("event_id % 3 = 0").select(F.col("user_id").alias("id")).distinct()
    two = events.where("event_id % 97 = 0").select(F.col("user_id").alias("id")).union(spark.range(100000, 100001)).distinct()
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), one, two


@query(f"WITH {L12} SELECT id, CASE WHEN id IN (FROM l2) THEN 'layer2' WHEN id IN (FROM l1) THEN 'layer1' ELSE 'out' END AS state FROM nd")
def highlight_state(spark, sf_dir):
    return graph.highlight_states(*_layers(spark, sf_dir))


@query(f"WITH {L12}, b AS (SELECT 'layer1' AS layer, id FROM l1 UNION ALL SELECT 'layer2', id FROM l2) SELECT layer, count(*) AS received, count(nd.id) AS matched, (SELECT count(*) FROM b JOIN nd USING (id)) > 0 AS active FROM b LEFT JOIN nd USING (id) GROUP BY layer")
def highlight_nm(spark, sf_dir):
    return graph.highlight_counts(*_layers(spark, sf_dir))




@query(f"WITH {R}, {GN}, {GR} (SELECT 'label' AS kind, label AS name, count(*) AS n FROM gn GROUP BY label ORDER BY n DESC, name LIMIT 8) UNION ALL (SELECT 'type', type, count(*) AS n FROM gr GROUP BY type ORDER BY n DESC, type LIMIT 8)")
def structure_summary(spark, sf_dir):
    g = sample(spark, sf_dir)
    return graph.structure_summary(g.graph_nodes, g.graph_rels)


# --- filters and facets ------------------------------------------------------------------------------------

FR = "fr AS (SELECT event_id AS id, event_type AS type, user_id % 50 AS s, event_id % 40 AS d, (event_id % 6)::VARCHAR AS level FROM events)"


def _event_graph(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    rels = events.select(F.col("event_id").alias("id"), F.col("event_type").alias("type"), F.pmod("user_id", F.lit(50)).alias("start_node_id"), F.pmod("event_id", F.lit(40)).alias("end_node_id"), F.create_map(F.lit("level"), F.pmod("event_id", F.lit(6)).cast("string")).alias("props"))
    nodes = spark.range(60).select("id", F.lit("N").alias("label"), F.create_map(F.lit("name"), F.concat(F.lit('"u'), "id", F.lit('"'))).alias("props"))
    return nodes, rels


@query(f"WITH {FR}, k AS (SELECT * FROM fr WHERE type IN ('click', 'error') AND level = '3') SELECT DISTINCT unnest([s, d]) AS id FROM k")
def filtered_subgraph(spark, sf_dir):
    nodes, rels = _event_graph(spark, sf_dir)
    nodes, _ = filters.filtered_subgraph(nodes, rels, {"type": ["click", "error"], "level": lambda v: v == "3"})
    return nodes.select("id")



@query(f"WITH {FR} SELECT DISTINCT 'type' AS facet, type AS value FROM fr UNION ALL SELECT DISTINCT 'level', level FROM fr")
def facets_relationship(spark, sf_dir):
    return filters.facets(_event_graph(spark, sf_dir)[1], ["type", "level"])


@query(f"WITH {P} SELECT DISTINCT prop AS facet, value FROM p")
def facets_node(spark, sf_dir):
    return filters.node_facets(sample(spark, sf_dir).nodes)


# --- sources, collection, review ---------------------------------------------------------------------------


@query("""WITH a AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS h, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p, regexp_extract(url, '\\?([^#]*)', 1) AS q FROM pages),
b AS (SELECT *, array_to_string(list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_'))), '&') AS k FROM a)
SELECT page_id, lower(h) || CASE WHEN rtrim(p, '/') = '' THEN '/' ELSE rtrim(p, '/') END || CASE WHEN k = '' THEN '' ELSE '?' || k END AS url FROM b""")
def url_normalize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.normalize_url("url").alias("url"))


@query("""WITH l AS (SELECT page_id, generate_subscripts(x, 1) AS pos, unnest(x) AS link FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS x FROM pages))
SELECT page_id, link, min(pos) - 1 AS first_pos FROM l GROUP BY page_id, link""")
def links_from_html(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(text.href_links(F.col("html"))).alias("pos", "link"))
    return rows.groupBy("page_id", "link").agg(F.min("pos").cast("long").alias("first_pos"))


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS key, CASE WHEN length(trim(text)) = 0 THEN 'empty' WHEN length(trim(text)) < 200 THEN 'low' ELSE 'ok' END AS quality FROM documents")
def document_quality(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", identity.sha16(F.col("text")).alias("key"), text.quality(F.col("text")).alias("quality"))


LED = "up AS (SELECT event_id AS seq, 'k' || user_id AS key, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'blocked' ELSE 'collected' END AS status, 'f' || user_id % 37 AS file, 'h' || event_id % 53 AS final_hash FROM events), ld AS (SELECT key, arg_max((seq, status, file, final_hash), seq) AS r FROM up GROUP BY key), lg AS (SELECT key, r[1] AS seq, r[2] AS status, r[3] AS file, r[4] AS final_hash FROM ld)"
LED = LED.replace("arg_max((seq, status, file, final_hash), seq) AS r", "max(seq) AS seq, arg_max(status, seq) AS status, arg_max(file, seq) AS file, arg_max(final_hash, seq) AS final_hash").split(", lg AS")[0].replace("ld AS", "lg AS")


def _updates(spark, sf_dir):
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("k"), "user_id").alias("key"), F.col("event_id").alias("seq"), F.when(kind == "error", "failed").when(kind == "signup", "blocked").otherwise("collected").alias("status"),
        F.concat(F.lit("f"), F.pmod("user_id", F.lit(37))).alias("file"), F.concat(F.lit("h"), F.pmod("event_id", F.lit(53))).alias("final_hash"),
    )


@query(f"WITH {LED} SELECT key, seq, status, file, final_hash FROM lg")
def ledger_latest(spark, sf_dir):
    return workflow.ledger_latest(_updates(spark, sf_dir))


@query(f"WITH {LED} SELECT key, CASE WHEN status = 'blocked' THEN 'skip_blocked' WHEN key < 'k3' THEN 'collect' WHEN status = 'collected' THEN 'skip' ELSE 'collect' END AS decision FROM lg")
def ledger_skip(spark, sf_dir):
    return workflow.ledger_latest(_updates(spark, sf_dir)).select("key", workflow.ledger_skip(F.col("status"), F.col("key") < "k3").alias("decision"))


@query(f"""WITH {LED}, a AS (SELECT * FROM lg WHERE key IN ('k1', 'k2')), b AS (SELECT * FROM lg WHERE file IN (SELECT file FROM a)),
c AS (SELECT * FROM lg WHERE final_hash IN (SELECT final_hash FROM b) OR key IN (SELECT key FROM b)) SELECT key FROM lg WHERE file IN (SELECT file FROM c) OR key IN (SELECT key FROM c)""")
def twin_closure(spark, sf_dir):
    return workflow.twins(workflow.ledger_latest(_updates(spark, sf_dir)), spark.createDataFrame([("k1",), ("k2",)], "key string"))


@query("SELECT 'd' || doc_id AS stem FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def pending_inputs(spark, sf_dir):
    inputs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("stem"))
    done = table(spark, sf_dir, "labels").select(F.when(F.col("quality") == 1, "Reviewed").otherwise("Rejected").alias("folder"), F.concat(F.lit("d"), "doc_id").alias("stem"))
    return workflow.pending_inputs(inputs, done)


@query(f"WITH {LED}, rj AS (SELECT 'f' || user_id % 37 AS file, count(*) // 60 AS reject_count FROM events WHERE event_type = 'error' GROUP BY 1) SELECT 'f' || i AS file, coalesce(reject_count, 0)::BIGINT AS reject_count, coalesce(reject_count, 0) >= 3 AS held FROM (SELECT unnest(range(45)) AS i) LEFT JOIN rj ON rj.file = 'f' || i")
def review_queue(spark, sf_dir):
    rejected = table(spark, sf_dir, "events").where("event_type = 'error'").groupBy(F.concat(F.lit("f"), F.pmod("user_id", F.lit(37))).alias("file")).agg(F.floor(F.count("*") / 60).alias("reject_count"))
    return workflow.review_queue(spark.range(45).select(F.concat(F.lit("f"), "id").alias("file")), rejected).select("file", "reject_count", "held")


@query()
def crawl_frontier(spark, sf_dir):
    """Pages in breadth-first order: every page links to the ones of twice and thrice its number."""
    pages = table(spark, sf_dir, "pages").select("page_id", text.normalize_url("url").alias("url")).withColumn("domain", text.registrable_domain("url"))
    ids = pages.select("page_id", "url", "domain")
    links = ids.select("page_id", F.col("url").alias("src"), F.posexplode(F.array(F.col("page_id") * 2 + 1, F.col("page_id") * 3 + 1)).alias("pos", "to"))
    links = links.join(ids.select(F.col("page_id").alias("to"), F.col("url").alias("dst"), F.col("domain").alias("dst_domain")), "to").select("src", F.col("pos").cast("long"), "dst", "dst_domain")
    return workflow.crawl(pages.where("page_id < 8").select("url", "domain").dropDuplicates(["url"]), links)


# --- hub, logs, statistics ---------------------------------------------------------------------------------

TYPES = {"view": "graph.show", "purchase": "highlight.set", "signup": "graph.refresh", "click": "highlight.clear"}
HUB = "lg AS (SELECT 'c' || user_id AS channel, event_id AS seq, ts, props AS payload, CASE event_type WHEN 'view' THEN 'graph.show' WHEN 'purchase' THEN 'highlight.set' WHEN 'signup' THEN 'graph.refresh' WHEN 'click' THEN 'highlight.clear' END AS type FROM events WHERE event_type <> 'error')"
HELD = f"""{HUB}, st AS (SELECT channel, max(seq) FILTER (type = 'graph.show') AS sh, max(seq) FILTER (type = 'highlight.set') AS hl, coalesce(max(seq) FILTER (type = 'graph.refresh'), -1) AS e1, coalesce(max(seq) FILTER (type IN ('graph.refresh', 'highlight.clear')), -1) AS e2 FROM lg GROUP BY channel),
hd AS (SELECT channel, 'graph.show' AS type, sh AS seq FROM st WHERE sh > e1 UNION ALL SELECT channel, 'highlight.set', hl FROM st WHERE hl > e2)"""


def _log(spark, sf_dir):
    kind = F.create_map(*(F.lit(x) for kv in TYPES.items() for x in kv))[F.col("event_type")]
    return table(spark, sf_dir, "events").where("event_type <> 'error'").select(F.concat(F.lit("c"), "user_id").alias("channel"), F.col("event_id").alias("seq"), "ts", kind.alias("type"), F.col("props").alias("payload"))


@query(f"WITH {HELD} SELECT hd.channel, hd.type, seq, payload FROM hd JOIN lg USING (channel, seq)")
def hub_retained(spark, sf_dir):
    return hub.retained(_log(spark, sf_dir)).select("channel", "type", "seq", "payload")


@query(f"WITH {HELD} SELECT channel, arg_max(hd.type, ((ts, hd.type = 'graph.show'))) AS type, arg_max(seq, ((ts, hd.type = 'graph.show'))) AS seq FROM hd JOIN lg USING (channel, seq) GROUP BY channel")
def hub_replay(spark, sf_dir):
    return hub.replay(hub.retained(_log(spark, sf_dir))).select("channel", "type", "seq")


# Each event is a request for a graph; its answer comes some events later.
LOADS = "ld AS (SELECT 'v' || user_id % 211 AS viewer, event_id AS request, 2 * event_id AS began, 2 * (event_id + event_id % 97) + 1 AS ended, CASE WHEN event_type = 'error' THEN 'error' WHEN event_id % 11 = 0 THEN 'cancelled' ELSE 'ok' END AS outcome FROM events)"
VERDICTS = f"""{LOADS}, lv AS (SELECT viewer, request, seq, outcome, last_value(CASE WHEN outcome IS NULL THEN request END IGNORE NULLS) OVER (PARTITION BY viewer ORDER BY seq, request) AS latest
  FROM (SELECT viewer, request, began AS seq, NULL AS outcome FROM ld UNION ALL SELECT viewer, request, ended, outcome FROM ld)),
vd AS (SELECT viewer, request, seq, CASE WHEN latest IS DISTINCT FROM request THEN 'superseded' WHEN outcome = 'ok' THEN 'replaced' WHEN outcome = 'cancelled' THEN 'cancelled' ELSE 'failed' END AS verdict FROM lv WHERE outcome IS NOT NULL)"""


def _loads(spark, sf_dir):
    made = table(spark, sf_dir, "events").select(
        F.concat(F.lit("v"), F.col("user_id") % 211).alias("viewer"), F.col("event_id").alias("request"),
        F.explode(F.array(F.struct((2 * F.col("event_id")).alias("seq"), F.lit(None).cast("string").alias("outcome")),
                          F.struct((2 * (F.col("event_id") + F.col("event_id") % 97) + 1).alias("seq"), F.when(F.col("event_type") == "error", "error").when(F.col("event_id") % 11 == 0, "cancelled").otherwise("ok").alias("outcome")))).alias("e"),
    )
    return made.select("viewer", "e.seq", "request", "e.outcome")


@query(f"WITH {VERDICTS} SELECT viewer, request, verdict FROM vd")
def load_verdicts(spark, sf_dir):
    return keyed.load_verdicts(_loads(spark, sf_dir)).select("viewer", "request", "verdict")


@query(f"WITH {VERDICTS} SELECT viewer, arg_max(request, seq) AS request FROM vd WHERE verdict = 'replaced' GROUP BY viewer")
def loads_shown(spark, sf_dir):
    return keyed.shown(keyed.load_verdicts(_loads(spark, sf_dir)))


def _attempts(spark, sf_dir):
    """Events as attempts at sources: errors fail, a few block, purchases are forced."""
    status = F.when(F.col("event_id") % 503 == 0, "blocked").when((F.col("event_type") == "error") | (F.col("event_id") % 3 == 0), "failed").otherwise("collected")
    file = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("f"), "event_id"))
    return table(spark, sf_dir, "events").select(F.concat(F.lit("k"), F.col("user_id") % 307).alias("key"), F.col("event_id").alias("seq"), "ts", status.alias("status"), (F.col("event_type") == "purchase").alias("forced"), file.alias("file"))


@query()
def ledger_merged(spark, sf_dir):
    """The ledger after all attempts, each judged by the entry before it. No SQL: a fold; tests hold it against one."""
    return keyed.ledger_batch(_attempts(spark, sf_dir))


@query("SELECT event_id AS search_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 5")
def rolling_last5(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("search_id"), "ts", "event_type")
    return S.last_searches(log).select("search_id", "event_type")


@query("""WITH t AS (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS question FROM conversations)
SELECT conv_id, question, min(turn) AS answer, row_number() OVER (PARTITION BY conv_id ORDER BY question) AS occurrence FROM t WHERE role = 'assistant' AND question IS NOT NULL GROUP BY conv_id, question""")
def qa_pairs(spark, sf_dir):
    return workflow.qa_pairs(table(spark, sf_dir, "conversations"))


@query("""WITH s AS (SELECT role, length(text) AS v, row_number() OVER (PARTITION BY role ORDER BY length(text)) AS k, count(*) OVER (PARTITION BY role) AS n FROM conversations)
SELECT role, count(*) AS n, max(v) FILTER (k = n // 2 + 1) AS median, round(avg(v), 6) AS mean, max(v) AS most FROM s GROUP BY role""")
def qa_latency_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("role", F.length("text").cast("long").alias("v"))
    return workflow.population_stats(rows, "role", "v").withColumn("mean", F.round("mean", 6))


@query("SELECT conv_id, min(turn) AS turn FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def first_in_session(spark, sf_dir):
    return workflow.first_in_session(table(spark, sf_dir, "conversations").where("role = 'assistant'"), "conv_id", "turn").select("conv_id", "turn")


CLAIMS = [("blue ring",), ("purple ring",), ("nation_24",), ("rin",), ("atlantis",)]


@query(f"WITH {N}, {GN}, cl(name) AS (VALUES {', '.join(f'({c[0]!r})' for c in CLAIMS)}) SELECT cl.name, CASE WHEN EXISTS (SELECT 1 FROM gn WHERE contains(name_key, cl.name)) THEN 'refuted' ELSE 'true' END AS verdict FROM cl")
def absence_audit(spark, sf_dir):
    claims = spark.createDataFrame(CLAIMS, "name string")
    return audit.absent_nodes(claims, sample(spark, sf_dir).graph_nodes)


@query("SELECT start_id, type, end_id, k FROM (SELECT l_suppkey AS start_id, l_returnflag AS type, l_partkey AS end_id, row_number() OVER (PARTITION BY l_suppkey, l_returnflag, l_partkey ORDER BY l_orderkey, l_linenumber) - 1 AS k FROM lineitem)")
def rel_occurrence_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("start_id"), F.col("l_returnflag").alias("type"), F.col("l_partkey").alias("end_id"), "l_orderkey", "l_linenumber")
    each = Window.partitionBy("start_id", "type", "end_id").orderBy("l_orderkey", "l_linenumber")
    return rows.select("start_id", "type", "end_id", (F.row_number().over(each) - 1).cast("long").alias("k"))


@query("SELECT * FROM (VALUES ('a', 0, '일륨도', '일륜도', 'damaged'), ('a', 1, '네즈코', NULL, 'sound'), ('b', 0, '귀살데', '귀살대', 'damaged'), ('b', 1, '물', NULL, 'sound')) v(search_id, kw_pos, keyword, candidate, verdict)")
def jamo_repair(spark, sf_dir):
    """Damaged Hangul keywords and what their questions make of them."""
    rows = [("a", 0, "일륨도", "탄지로의 일륜도가 뭐야?"), ("a", 1, "네즈코", "네즈코는 누구야"), ("b", 0, "귀살데", "귀살대 대원"), ("b", 1, "물", "물의 호흡")]
    return audit.damaged_keywords(spark.createDataFrame(rows, "search_id string, kw_pos int, keyword string, question string"))


# --- functions over whole tables ---------------------------------------------------------------------------

@query("""WITH a AS (SELECT page_id, regexp_replace(url, '[<>:"/\\\\|?*]', '_', 'g') AS x FROM pages), b AS (SELECT page_id, regexp_replace(left(x, 80), '[. ]+$', '') AS x FROM a)
SELECT page_id, CASE WHEN x = '' THEN 'untitled' ELSE x END AS name FROM b""")
def safe_file_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.safe_file_name(F.col("url")).alias("name"))


@query("""SELECT doc_id, 's_' || lang || '_p' || CASE WHEN doc_id < 10 THEN '0' ELSE '' END || doc_id AS stem, 's_' || lang || '_p' || CASE WHEN doc_id < 10 THEN '0' ELSE '' END || doc_id || '.kg.json' AS file,
lang || '.kg.rej' || doc_id || '.json' AS rejected FROM documents""")
def file_stems(spark, sf_dir):
    stem = text.page_stem(F.lit("s"), F.col("lang"), F.col("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", stem.alias("stem"), text.kg_file(stem).alias("file"), text.rejected_file(F.col("lang"), F.col("doc_id")).alias("rejected"))


EXT = "['pdf', 'PNG', 'jpeg', 'txt', 'tif', 'md']"


@query(f"""WITH f AS (SELECT event_id, ({EXT})[event_id % 6 + 1] AS ext FROM events)
SELECT event_id, CASE WHEN ext = 'pdf' THEN 'pdf' WHEN lower(ext) IN ('png', 'jpeg', 'tif') THEN 'image' END AS kind FROM f""")
def source_types(spark, sf_dir):
    ext = F.get(F.array(*map(F.lit, ["pdf", "PNG", "jpeg", "txt", "tif", "md"])), F.pmod("event_id", F.lit(6)).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", text.source_type(F.concat(F.lit("/a.b/c"), "event_id", F.lit("."), ext)).alias("kind"))


@query("SELECT doc_id, regexp_replace(text, '([+\\-&|!(){}\\[\\]^\"~*?:\\\\/])', '\\\\\\1', 'g') AS escaped FROM documents")
def escaped_queries(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", identity.escape_query(F.col("text")).alias("escaped"))


@query("""SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%S') || '+09:00' AS kst, strftime(ts, '%Y%m%d%H%M%S') AS stamp, strftime(ts, '%Y%m%dT%H%M%S') AS build FROM events""")
def time_stamps(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.iso_kst(F.col("ts")).alias("kst"), text.batch_stamp(F.col("ts")).alias("stamp"), text.build_id(F.col("ts")).alias("build"))


@query("""WITH x AS (SELECT event_id, event_id * 9007199254740 AS n FROM events) SELECT event_id, CASE WHEN n > 9007199254740991 THEN '"' || n || '"' ELSE n::VARCHAR END AS safe FROM x""")
def json_safe_numbers(spark, sf_dir):
    # Products leave 64 bits from event 1,024,001 on: taken as decimals of 38 digits at most.
    made = F.col("event_id").cast("decimal(20,0)") * F.lit(9007199254740).cast("decimal(13,0)")
    return table(spark, sf_dir, "events").select("event_id", text.json_safe_long(made).alias("safe"))


@query("""SELECT p_partkey, '#' || string_agg(lower(printf('%02x', (v + round((255 - v) * 0.4))::INT)), '' ORDER BY k) AS colour FROM (SELECT p_partkey, unnest([0, 1, 2]) AS k, unnest([p_partkey % 256, p_size * 5 % 256, (p_partkey * 7) % 256]) AS v FROM part) GROUP BY p_partkey""")
def brightened(spark, sf_dir):
    parts = [F.lower(F.lpad(F.hex(F.pmod(x, F.lit(256))), 2, "0")) for x in (F.col("p_partkey"), F.col("p_size") * 5, F.col("p_partkey") * 7)]
    return table(spark, sf_dir, "part").select("p_partkey", text.brighten(F.concat(F.lit("#"), *parts), 0.4).alias("colour"))


@query("""WITH RECURSIVE t AS (SELECT DISTINCT p_brand AS name FROM part), w AS (SELECT name, 0 AS i, 0::BIGINT AS h FROM t UNION ALL SELECT name, i + 1, (h * 31 + ascii(substr(name, i + 1, 1))) % 4294967296 FROM w WHERE i < length(name))
SELECT name, abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 25 AS colour FROM w WHERE i = length(name)""")
def type_colours(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("name")).distinct().select("name", text.type_colour(F.col("name")).cast("long").alias("colour"))


@query("""SELECT event_id, 'K_' || event_type AS key, user_id::VARCHAR AS value FROM events WHERE event_id % 4 <> 3""")
def environment_lines(spark, sf_dir):
    n, name, value = F.pmod("event_id", F.lit(4)), F.concat(F.lit("K_"), "event_type"), F.col("user_id").cast("string")
    line = F.when(n == 0, F.concat(name, F.lit("="), value, F.lit("  # note"))).when(n == 1, F.concat(F.lit(" export "), name, F.lit(' = "'), value, F.lit('"'))).when(n == 2, F.concat(name, F.lit("='"), value, F.lit("'"))).otherwise(F.concat(F.lit("# "), name))
    rows = table(spark, sf_dir, "events").select("event_id", text.environment_line(line).alias("pair"))
    return rows.where("pair is not null").select("event_id", "pair.key", "pair.value")


@query("""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'url' WHEN 1 THEN 'file' ELSE 'invalid' END AS kind, page_id % 5 IN (2, 3) AS path FROM pages""")
def target_kinds(spark, sf_dir):
    n = F.pmod("page_id", F.lit(5))
    target = F.when(n == 0, F.col("url")).when(n == 1, F.concat(F.lit("d"), "page_id", F.lit(".kg.json"))).when(n == 2, F.concat(F.lit("C:\\d\\"), "page_id")).when(n == 3, F.concat(F.lit("file://x/"), "page_id", F.lit(".kg.json"))).otherwise(F.concat(F.lit("../"), "page_id", F.lit(".kg.json")))
    return table(spark, sf_dir, "pages").select("page_id", text.target_kind(target).alias("kind"), text.looks_like_path(target).alias("path"))


@query("""SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'ok' WHEN event_id % 6 IN (1, 2) THEN 'rate_limit' WHEN event_id % 6 = 3 THEN 'timeout' WHEN event_id % 6 = 4 THEN 'not_installed' ELSE 'crash' END AS engine,
CASE event_id % 4 WHEN 0 THEN 'auth' WHEN 1 THEN 'paused' WHEN 2 THEN 'unconfigured' ELSE 'other' END AS db FROM events""")
def failure_kinds(spark, sf_dir):
    n, m = F.pmod("event_id", F.lit(6)), F.pmod("event_id", F.lit(4))
    stderr = F.when(n == 0, "rate limit").when(n == 1, "Too many requests").when(n == 2, "status: 429").when(n == 5, "disk quota, road 429-2")
    engine = text.engine_failure(F.when(n == 0, 0).when(n == 4, 9009).otherwise(1), stderr, n == 3, F.lit(None).cast("string"))
    db = text.database_failure(F.when(m == 0, "Unauthorized").when(m == 1, "connect ECONNREFUSED").when(m == 2, "X_UNCONFIGURED").otherwise("else"))
    return table(spark, sf_dir, "events").select("event_id", engine.alias("engine"), db.alias("db"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN '{"n": ' || event_id || '}' WHEN 1 THEN '{"n": 1}' END AS found FROM events""")
def engine_answers(spark, sf_dir):
    n = F.pmod("event_id", F.lit(5))
    raw = F.when(n == 0, F.concat(F.lit("Here:\n```json\n{\"n\": "), "event_id", F.lit("}\n```\nbye"))).when(n == 1, 'so {"n": 1} it is').when(n == 2, '[{"n": 1}]').when(n == 3, "").otherwise("{broken")
    return table(spark, sf_dir, "events").select("event_id", text.engine_json(raw).alias("found"))


@query("""SELECT c_custkey AS id, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_name END, CASE WHEN c_custkey % 3 = 1 THEN 'T' || c_custkey END, c_custkey::VARCHAR) AS shown, contains(lower(coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_name END, CASE WHEN c_custkey % 3 = 1 THEN 'T' || c_custkey END, c_custkey::VARCHAR) || ' Customer ' || c_custkey), '00') AS hit,
'name: ' || CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE ' ' END || chr(10) || 'title: ' || CASE WHEN c_custkey % 3 = 1 THEN 'T' || c_custkey ELSE '' END AS tip FROM customer""")
def shown_names(spark, sf_dir):
    n = F.pmod("c_custkey", F.lit(3))
    props = F.create_map(F.lit("name"), F.when(n == 0, F.col("c_name")).otherwise(" "), F.lit("title"), F.when(n == 1, F.concat(F.lit("T"), "c_custkey")).otherwise(""))
    nodes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("Customer").alias("label"), props.alias("props"))
    return filters.search_dim(nodes, "00").select("id", filters.display_name(nodes).alias("shown"), "hit", filters.tooltip(F.col("props")).alias("tip"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 2 THEN 'Node' ELSE event_type END AS label FROM events")
def display_labels(spark, sf_dir):
    n, kind = F.pmod("event_id", F.lit(3)), F.col("event_type")
    labels = F.when(n == 0, F.array(F.lit(L.SYSTEM_LABEL), kind)).when(n == 1, F.array(kind, F.lit("Other"))).otherwise(F.array(F.lit(L.SYSTEM_LABEL)))
    return table(spark, sf_dir, "events").select("event_id", validate.display_label(labels).alias("label"))


@query("""WITH e AS (SELECT 'seg' || c_custkey % 50 AS key, c_mktsegment AS own FROM customer), d AS (SELECT DISTINCT key, own FROM e)
SELECT 'variant_in_two_entries' AS code, 'V' AS label, key FROM d GROUP BY key HAVING count(*) > 1""")
def dictionary_errors(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.lit("C").alias("canonical_label"), F.col("c_mktsegment").alias("canonical_name"), F.lit("V").alias("label"), F.concat(F.lit(" SEG"), F.pmod("c_custkey", F.lit(50))).alias("name"))
    return validate.dictionary_problems(rows)


@query("""WITH o AS (SELECT 'N' AS label, 'k' || event_id % 900 AS name_key, CASE WHEN event_id % 10 = 0 THEN 'kgid' ELSE event_type END AS prop, event_id % 11 = 0 AS bad FROM events)
SELECT 'forbidden_property' AS code, label, name_key, prop FROM o WHERE prop = 'kgid' UNION ALL SELECT 'value_type', label, name_key, prop FROM o WHERE bad UNION ALL SELECT 'duplicate', label, name_key, prop FROM o GROUP BY ALL HAVING count(*) > 1""".replace("GROUP BY ALL", "GROUP BY label, name_key, prop"))
def override_errors(spark, sf_dir):
    n = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(F.lit("N").alias("label"), F.concat(F.lit("k"), F.pmod(n, F.lit(900))).alias("name_key"), F.when(F.pmod(n, F.lit(10)) == 0, "kgid").otherwise(F.col("event_type")).alias("prop"), F.when(F.pmod(n, F.lit(11)) == 0, "[1, null]").otherwise('"x"').alias("value"))
    return validate.override_problems(rows)


@query("""WITH m AS (SELECT * FROM events), k AS (SELECT event_id FROM events WHERE event_type IN ('view', 'purchase')) SELECT (SELECT count(*) FROM customer) AS nodes, (SELECT count(*) FROM events WHERE user_id IN (SELECT c_custkey FROM customer) AND event_id % 200 IN (SELECT c_custkey FROM customer)) AS edges,
(SELECT count(*) FROM events) - (SELECT count(*) FROM events WHERE user_id IN (SELECT c_custkey FROM customer) AND event_id % 200 IN (SELECT c_custkey FROM customer)) AS dangling, true AS truncated""")
def dangling_counts(spark, sf_dir):
    edges = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("src"), F.pmod("event_id", F.lit(200)).alias("dst"))
    return graph.dangling_summary(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), edges, L.VIEW_NODES, L.VIEW_RELS)


@query("""WITH nd AS (SELECT c_custkey AS id FROM customer), l1 AS (SELECT DISTINCT user_id AS id FROM events WHERE event_id % 3 = 0), l2 AS (SELECT DISTINCT user_id AS id FROM events WHERE event_id % 97 = 0 UNION SELECT 100000), t AS (SELECT id FROM l2 INTERSECT SELECT id FROM nd)
SELECT 'layer1' AS layer, id FROM (SELECT id FROM l1 INTERSECT SELECT id FROM nd EXCEPT SELECT id FROM t) UNION ALL SELECT 'layer2', id FROM t""")
def rendered_sets(spark, sf_dir):
    one, two = graph.rendered_layers(*_layers(spark, sf_dir))
    return one.select(F.lit("layer1").alias("layer"), "id").unionByName(two.select(F.lit("layer2").alias("layer"), "id"))


@query("""WITH a AS (SELECT p_name AS name FROM part WHERE p_partkey % 7 <> 0), b AS (SELECT p_name AS name FROM part WHERE p_partkey % 5 <> 0) SELECT name, 'extra' AS side FROM (FROM a EXCEPT ALL FROM b) UNION ALL SELECT name, 'missing' FROM (FROM b EXCEPT ALL FROM a)""")
def graph_source_difference(spark, sf_dir):
    names = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"))
    return graph.differences(names.where("p_partkey % 7 <> 0").select("name"), names.where("p_partkey % 5 <> 0").select("name")).select("name", "side")


TW = f"""{LED}, a AS (SELECT * FROM lg WHERE key IN ('k1', 'k2')), b AS (SELECT * FROM lg WHERE file IN (SELECT file FROM a)),
c AS (SELECT * FROM lg WHERE final_hash IN (SELECT final_hash FROM b) OR key IN (SELECT key FROM b)), tw AS (SELECT key FROM lg WHERE file IN (SELECT file FROM c) OR key IN (SELECT key FROM c))"""


@query(f"WITH {TW} SELECT key, 'blocked' AS status FROM tw UNION ALL SELECT key, status FROM lg WHERE key NOT IN (SELECT key FROM tw)")
def sources_blocked(spark, sf_dir):
    targets = spark.createDataFrame([("k1",), ("k2",)], "key string")
    return workflow.remove_sources(workflow.ledger_latest(_updates(spark, sf_dir)), targets, True).select("key", "status")


@query(f"WITH {TW} SELECT key, status FROM lg WHERE key NOT IN (SELECT key FROM tw)")
def sources_removed(spark, sf_dir):
    targets = spark.createDataFrame([("k1",), ("k2",)], "key string")
    return workflow.remove_sources(workflow.ledger_latest(_updates(spark, sf_dir)), targets, False).select("key", "status")


FILES = "fl AS (SELECT CASE quality WHEN 1 THEN 'Reviewed' ELSE 'Generated' END AS folder, 's' || doc_id % 40 AS stem, 'f' || doc_id AS file, doc_id FROM labels)"


def _files(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(F.when(F.col("quality") == 1, "Reviewed").otherwise("Generated").alias("folder"), F.concat(F.lit("s"), F.pmod("doc_id", F.lit(40))).alias("stem"), F.concat(F.lit("f"), "doc_id").alias("file"))


@query(f"WITH {FILES} SELECT stem, min(folder) AS folder FROM fl GROUP BY stem")
def located_documents(spark, sf_dir):
    return workflow.locate(_files(spark, sf_dir)).select("stem", "folder")


@query(f"""WITH {FILES}, {LED} SELECT 'folder:' || folder AS measure, count(*) AS n FROM fl GROUP BY folder UNION ALL SELECT 'status:' || status, count(*) FROM lg GROUP BY status UNION ALL SELECT 'held', count(*) FILTER (seq % 5 >= 3) FROM lg""")
def status_measures(spark, sf_dir):
    ledger = workflow.ledger_latest(_updates(spark, sf_dir)).withColumn("reject_count", F.pmod("seq", F.lit(5)))
    return workflow.status_counts(_files(spark, sf_dir), ledger)


@query(f"""WITH {LED}, d AS (SELECT 'f' || i AS file, i % 2 = 0 AS approve FROM (SELECT unnest(range(20)) AS i))
SELECT key, CASE WHEN approve THEN 0 WHEN NOT approve THEN seq % 5 + 1 ELSE seq % 5 END AS reject_count, CASE WHEN NOT approve THEN 'new' ELSE 'old' END AS last_reject_reason FROM lg LEFT JOIN d USING (file)""")
def review_effects(spark, sf_dir):
    ledger = workflow.ledger_latest(_updates(spark, sf_dir)).withColumn("reject_count", F.pmod("seq", F.lit(5))).withColumn("last_reject_reason", F.lit("old"))
    decisions = spark.range(20).select(F.concat(F.lit("f"), "id").alias("file"), (F.col("id") % 2 == 0).alias("approve"), F.when(F.col("id") % 2 == 1, "new").alias("reason"))
    return workflow.review(ledger, decisions).select("key", "reject_count", "last_reject_reason")


@query("""WITH c AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS collected, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'signup') AS robots, count(*) FILTER (event_type = 'purchase') AS passed FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN failed > 0 THEN CASE WHEN collected + passed > 0 THEN 'partial' ELSE 'fail' END WHEN collected + passed = 0 AND robots > 0 THEN 'fail' ELSE 'success' END AS verdict, greatest(failed, robots) + 1 AS round FROM c""")
def collection_verdicts(spark, sf_dir):
    kinds = {"collected": "view", "failed": "error", "robots": "signup", "passed": "purchase"}
    runs = table(spark, sf_dir, "events").groupBy("user_id").agg(*(F.count_if(F.col("event_type") == v).alias(k) for k, v in kinds.items()))
    return runs.select("user_id", workflow.collection_verdict(*map(F.col, kinds)).alias("verdict"), workflow.rejection_round(F.col("failed"), F.col("robots")).alias("round"))


@query("SELECT max(page_id) + 1 AS page FROM pages")
def next_page_number(spark, sf_dir):
    files = table(spark, sf_dir, "pages").select(F.concat(F.lit("b1_name_p"), "page_id", F.lit(".md")).alias("file"))
    return workflow.next_page(files, "b1").select(F.col("page").cast("long").alias("page"))


@query("SELECT user_id, coalesce(CASE WHEN user_id % 3 = 0 THEN 'two' END, CASE WHEN user_id % 2 = 0 THEN 'bad' END, 'one') AS asked, CASE WHEN user_id % 3 <> 0 AND user_id % 2 = 0 THEN NULL WHEN user_id % 3 = 0 THEN 'two' ELSE 'one' END AS engine FROM (SELECT DISTINCT user_id FROM events)")
def engine_choices(spark, sf_dir):
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    argument, environment = F.when(F.col("user_id") % 3 == 0, "two").otherwise(""), F.when(F.col("user_id") % 2 == 0, "bad")
    return users.select("user_id", F.coalesce(F.nullif(argument, F.lit("")), environment, F.lit("one")).alias("asked"), workflow.engine_choice(argument, environment, "one", ["one", "two"]).alias("engine"))


# --- texts of counters, moves at review, audits of what clients saw ------------------------------------------

PER_USER = "u AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'view') AS views FROM events GROUP BY user_id)"


@query(f"""WITH {PER_USER} SELECT user_id, CASE user_id % 4 WHEN 0 THEN '{notices.CITED_ALL}' WHEN 1 THEN '인용 ' || n || '건 중 ' || views || '건이 검색 결과에 존재 (일부 탈락)' WHEN 2 THEN '{notices.CITED_NONE}' ELSE '{notices.CITED_NOT_YET}' END AS phrase,
CASE WHEN views < n THEN '검색 결과 ' || n || '개 중 ' || views || '개 표시 중 — ' || CASE WHEN user_id % 2 = 0 THEN '필터 해제' ELSE '그래프 새로고침' END || ' 권장' END AS notice FROM u""")
def counter_texts(spark, sf_dir):
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "view").alias("views"))
    kind, n, views = F.pmod("user_id", F.lit(4)), F.col("n"), F.col("views")
    status = F.when(kind == 0, "verified").when(kind == 1, "partial").when(kind == 2, "none")
    return users.select("user_id", notices.citation_phrase(status, n, views).alias("phrase"), notices.coverage_notice(n, views, F.pmod("user_id", F.lit(2)) == 0).alias("notice"))


@query(f"""WITH s AS (SELECT user_id, event_id, chr(39) || 'w' || event_id || chr(39) || '는 그래프에 없어, 이 호출의 question에서 자모 1개만 다른 ' || chr(39) || event_type || chr(39) || '로 다시 검색함' AS line FROM events WHERE event_id % 3 = 0 AND event_id % 2 > 0),
r AS (SELECT user_id, '키워드 자동 재검색 ' || count(*) || '건: ' || string_agg(line, ' / ' ORDER BY event_id) || ' (자동 추정 — 확정된 오타 판정이 아니다)' || chr(10) || '{notices.RESTORED_ADVICE}' AS lines FROM s GROUP BY user_id)
SELECT user_id, coalesce(lines, '') AS lines FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN r USING (user_id)""")
def restoration_texts(spark, sf_dir):
    seed = F.struct("event_id", F.col("event_type").alias("keyword"), F.when(F.pmod("event_id", F.lit(3)) == 0, F.concat(F.lit("w"), "event_id")).alias("restored_from"), F.pmod("event_id", F.lit(2)).alias("n_matched"))
    seeds = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(seed)).alias("seeds"))
    return seeds.select("user_id", F.array_join(notices.restoration_lines(F.col("seeds")), "\n").alias("lines"))


@query("""SELECT event_id, ([502, 502, 502, 504, 504, 502, 500, 500])[event_id % 8 + 1] AS status, (['AUTH_FAILED', 'NETWORK_ERROR', 'NETWORK_ERROR', 'TIMEOUT', 'TIMEOUT', 'NETWORK_ERROR', 'INTERNAL_ERROR', 'INTERNAL_ERROR'])[event_id % 8 + 1] AS code FROM events""")
def database_statuses(spark, sf_dir):
    n = F.pmod("event_id", F.lit(8))
    code = F.when(n == 0, L.DATABASE_AUTH_CODES[1]).when(n == 1, "SessionExpired").when(n == 3, L.DATABASE_TIMEOUT_CODES[0])
    name = F.when(n == 2, L.DATABASE_ERROR_NAME).when(n == 6, "TypeError")
    message = F.when(n == 2, "No routing servers").when(n == 4, "it timed out").when(n == 5, "EHOSTUNREACH 10.0.0.1").when(n == 6, "bad certificate").when(n == 7, "else")
    return table(spark, sf_dir, "events").select("event_id", text.database_status(code, name, message).alias("s")).select("event_id", "s.*")


@query("""WITH d AS (SELECT doc_id, 'd' || doc_id AS stem, doc_id % 6 < 3 AS approve, doc_id % 3 = 0 AS gen, doc_id % 4 = 0 AS rev, CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 0 END AS rej, CASE WHEN doc_id % 2 = 0 THEN doc_id % 4 END AS led FROM documents),
m AS (SELECT *, CASE WHEN gen THEN 'Generated' WHEN NOT approve AND rev THEN 'Reviewed' END AS came_from, greatest(coalesce(led, 0), rej) + 1 AS times FROM d)
SELECT stem, came_from, CASE WHEN came_from IS NULL THEN NULL WHEN approve THEN 'Reviewed' ELSE 'Rejected' END AS goes_to, CASE WHEN came_from IS NULL THEN NULL WHEN approve THEN stem || '.kg.json' ELSE stem || '.kg.rej' || times || '.json' END AS file,
CASE WHEN came_from IS NULL THEN coalesce(led, 0) WHEN approve THEN 0 ELSE times END AS reject_count, came_from IS NOT NULL AND NOT approve AND times >= 3 AS held, came_from IS NOT NULL AND NOT approve AND came_from = 'Reviewed' AS rebuild,
CASE WHEN came_from IS NULL OR approve THEN NULL WHEN doc_id % 11 = 0 THEN 'not_asked' WHEN times >= 3 THEN 'held' WHEN doc_id % 7 = 0 THEN 'no_input' ELSE 'run' END AS again FROM m""")
def review_moves(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d"), "doc_id").alias("stem"))
    folders = [F.when(F.col("doc_id") % n == 0, name) for n, name in ((3, "Generated"), (4, "Reviewed"), (5, "Rejected"), (5, "Rejected"))]
    files = docs.select("stem", F.explode(F.array_compact(F.array(*folders))).alias("folder"))
    ledger = docs.where("doc_id % 2 = 0").select("stem", (F.col("doc_id") % 4).alias("reject_count"))
    decisions = docs.select("stem", (F.col("doc_id") % 6 < 3).alias("approve"), (F.col("doc_id") % 11 != 0).alias("regenerate"))
    return workflow.review_moves(files, ledger, docs.where("doc_id % 7 <> 0"), decisions)


HC = """p AS (SELECT DISTINCT user_id AS s, CASE WHEN event_id % 2 = 0 THEN 'node' ELSE 'rel' END AS kind, event_id % 20 AS id FROM events),
l1 AS (SELECT * FROM p WHERE NOT (s % 5 = 0 AND id = 3)), l2 AS (SELECT * FROM l1 WHERE s % 3 = 0 AND id % 4 = 0 UNION ALL SELECT DISTINCT s, 'node', 99 FROM p WHERE s % 7 = 0),
d1 AS (SELECT l1.* FROM l1 LEFT JOIN l2 USING (s, kind, id) WHERE l1.s % 11 = 0 OR l2.s IS NULL),
c AS (SELECT *, coalesce(n2_, 0) AS n2, coalesce(nd_, 0) AS nd, coalesce(twice_, 0) AS twice, coalesce(r1_, 0) AS r1 FROM (SELECT s, count(*) AS np, count(*) FILTER (kind = 'rel') AS rp FROM p GROUP BY s) LEFT JOIN (SELECT s, count(*) AS n2_ FROM l2 GROUP BY s) USING (s)
LEFT JOIN (SELECT s, count(*) AS nd_ FROM d1 GROUP BY s) USING (s) LEFT JOIN (SELECT s, count(*) AS twice_ FROM d1 JOIN l2 USING (s, kind, id) GROUP BY s) USING (s) LEFT JOIN (SELECT s, count(*) AS r1_ FROM l1 WHERE kind = 'rel' GROUP BY s) USING (s))"""
HC_CHECKS = {
    "search_id": "s % 13 <> 0", "question": "s % 13 = 0 AND s % 17 = 0 OR s % 13 <> 0 AND s % 17 <> 0", "layer1_nodes": "true", "layer1_rels": "rp = r1", "total": "s % 2 = 0", "truncated": "NOT (s % 4 = 0 AND s % 13 = 0)",
    "layer2_nodes": "s % 7 <> 0", "layer2_rels": "true", "drawn_once": "twice = 0", "drawn": "nd + n2 = CASE WHEN s % 19 = 0 THEN 0 ELSE np END", "citation": "(s % 3 = 0) = (n2 > 0)",
}


@query(f"WITH {HC} " + " UNION ALL ".join(f"""SELECT s AS search_id, '{k}' AS "check", {v} AS ok FROM c""" for k, v in HC_CHECKS.items()))
def highlight_checks(spark, sf_dir):
    search, kind = F.col("user_id").alias("search_id"), F.when(F.col("event_id") % 2 == 0, "node").otherwise("rel").alias("kind")
    pushed = table(spark, sf_dir, "events").select(search, kind, (F.col("event_id") % 20).alias("id")).distinct()
    one = pushed.where("not (search_id % 5 = 0 and id = 3)")
    two = one.where("search_id % 3 = 0 and id % 4 = 0").union(pushed.where("search_id % 7 = 0").select("search_id", F.lit("node"), F.lit(99).cast("long")).distinct())
    drawn = one.where("search_id % 11 = 0").union(one.where("search_id % 11 <> 0").join(two, ["search_id", "kind", "id"], "left_anti"))
    shown = [rows.select("search_id", F.lit(part).alias("part"), "kind", "id") for part, rows in (("layer1", one), ("layer2", two), ("drawn1", drawn), ("drawn2", two))]
    totals = pushed.groupBy("search_id").agg(F.count("*").alias("n"))
    s, asked = F.col("search_id"), F.concat(F.lit("q"), "search_id")
    searches = totals.where("search_id % 13 <> 0").select("search_id", asked.alias("question"), F.when(s % 4 == 0, True).alias("truncated"))
    cited = F.when(s % 3 == 0, F.when(s % 2 == 0, "verified").otherwise("partial")).otherwise("none")
    screens = totals.select("search_id", F.when(s % 17 != 0, asked).alias("question"), (s % 4 == 0).alias("truncated"), (F.col("n") - s % 2).alias("total"), F.col("n").alias("matched"), (s % 19 != 0).alias("active"), cited.alias("citation"))
    return audit.highlight_checks(searches, pushed, screens, shown[0].union(shown[1]).union(shown[2]).union(shown[3]))


SAID = r"max_by(CASE WHEN role = 'user' THEN trim(regexp_replace(text, '\s+', ' ', 'g')) END, CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn)"


def _parts(spark, sf_dir):
    """Conversations as sessions: users' turns are utterances, the others calls with their results."""
    asked, n = F.col("role") == "user", F.col("turn")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session"), F.col("conv_id").alias("at"), n.alias("pos"), F.when(asked, F.col("text")).alias("utterance"),
        F.when(~asked, F.when(n % 4 == 1, "mcp__x__kg_search").when(n % 4 == 3, "mcp__x__kg_cite")).alias("tool"), F.concat_ws("-", "conv_id", "turn").alias("tool_id"),
        F.when(n % 8 == 1, F.concat(F.lit("q"), "conv_id")).alias("question"), F.when(F.col("conv_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"))).alias("keywords"),
        F.concat(F.lit("{"), "turn", F.lit("}")).alias("input"), F.when(~asked, F.concat(F.lit("상태: "), "turn", F.lit("\nother\n  시드 2 "))).alias("result"),
    )


@query(f"""WITH t AS (SELECT *, {SAID} AS said FROM conversations) SELECT conv_id || '-' || turn AS tool_id, CASE WHEN turn % 8 = 1 THEN 'q' || conv_id ELSE said END AS question, CASE WHEN turn % 8 = 1 THEN 'tool-arg' ELSE 'user-utterance' END AS question_source,
CASE WHEN conv_id % 3 = 0 THEN 3 ELSE -1 END AS seed_count, conv_id % 3 <> 0 AS parse_failed FROM t WHERE role <> 'user' AND turn % 4 = 1 AND conv_id % 5 <> 0""")
def probe_pairs(spark, sf_dir):
    fence, n = "`" * 3, F.col("session") % 3
    block = F.when(n == 0, '{"seeds": [{"keyword": "a", "matched": ["x", "y"]}, {"matched": ["z"]}, {}]}').when(n == 1, "{broken")
    parts = _parts(spark, sf_dir)
    results = parts.select("tool_id", F.coalesce(F.concat(F.lit(f"ok\n{fence}json\n"), block, F.lit(f"\n{fence}")), F.lit("no block")).alias("content"))
    # -1 stands for the null of what was not measured.
    return audit.probes(parts, results).drop("keywords").withColumn("seed_count", F.coalesce("seed_count", F.lit(-1)))


@query(f"""WITH t AS (SELECT *, {SAID} AS said FROM conversations), l AS (SELECT max(conv_id) AS c FROM conversations WHERE role = 'user' AND contains(text, 'on '))
SELECT conv_id AS session, turn AS pos, left(said, 60) AS question, CASE turn % 4 WHEN 1 THEN 'kg_search {{' || turn || '}}' WHEN 3 THEN 'kg_cite {{' || turn || '}}' END AS call, '상태: ' || turn || '|시드 2' AS shown FROM t, l WHERE conv_id = c AND role <> 'user' AND contains(said, 'on ')""")
def answer_trace(spark, sf_dir):
    return audit.answer_trace(_parts(spark, sf_dir), "on ").select("session", "pos", "question", "call", F.array_join("shown", "|").alias("shown"))


@query("""SELECT event_type AS "case", count(*) AS n, sum(('0x' || substr(sha256(event_id || chr(31) || user_id), 1, 15))::BIGINT)::VARCHAR AS digest FROM events GROUP BY event_type""")
def golden_digests(spark, sf_dir):
    return audit.digests(table(spark, sf_dir, "events"), "event_type", "event_id", "user_id")


@query("""SELECT DISTINCT event_type AS "case", CASE event_type WHEN 'view' THEN 'changed' WHEN 'signup' THEN 'missing' WHEN 'click' THEN 'new' ELSE 'same' END AS verdict FROM events""")
def golden_verdicts(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    now = events.where("event_type <> 'signup'").withColumn("user_id", F.when(F.col("event_type") == "view", F.col("user_id") + 1).otherwise(F.col("user_id")))
    before, after = (audit.digests(rows, "event_type", "event_id", "user_id") for rows in (events.where("event_type <> 'click'"), now))
    return audit.golden_differences(before, after)


@query("""WITH c AS (SELECT DISTINCT CASE WHEN p_partkey % 10 = 0 THEN 'no ' ELSE '' END || p_name AS name, (['colour', 'maker', 'weight'])[p_partkey % 3 + 1] AS prop FROM part)
SELECT name, prop, CASE WHEN prop = 'weight' OR lower(name) NOT IN (SELECT lower(p_name) FROM part) THEN 'unmeasured' WHEN prop = 'maker' THEN 'refuted' ELSE 'true' END AS verdict FROM c""")
def property_absence(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    prop = F.element_at(F.array(F.lit("colour"), F.lit("maker"), F.lit("weight")), (F.col("p_partkey") % 3 + 1).cast("int"))
    claims = part.select(F.concat(F.when(F.col("p_partkey") % 10 == 0, "no ").otherwise(""), "p_name").alias("name"), prop.alias("prop")).distinct()
    values = part.select(identity.ascii_name_key(F.col("p_name")).alias("name_key"), F.explode(F.array(F.lit("brand"), F.lit("type"))).alias("prop"))
    families = spark.createDataFrame([("colour", "^colou?r"), ("maker", "^brand$"), ("maker", "^make")], "family string, pattern string")
    return audit.absent_properties(claims, values, families)


@query("""WITH t AS (SELECT DISTINCT o_custkey AS k, o_orderstatus AS type FROM orders)
SELECT c_name AS name, '^[F]' AS pattern, CASE WHEN c_custkey % 9 = 0 THEN 'unmeasured' WHEN EXISTS (SELECT 1 FROM t WHERE k = c_custkey AND type = 'F') THEN 'refuted' ELSE 'true' END AS verdict FROM customer""")
def relationship_absence(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    nodes = customer.where("c_custkey % 9 <> 0").select(identity.ascii_name_key(F.col("c_name")).alias("name_key"), F.concat(F.lit("c"), "c_custkey").alias("kgid"))
    rels = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("from_kgid"), F.concat(F.lit("o"), "o_orderkey").alias("to_kgid"), F.col("o_orderstatus").alias("type"))
    return audit.absent_relationships(customer.select(F.col("c_name").alias("name"), F.lit("^[F]").alias("pattern")), nodes, rels)


def _answering(quota: bool) -> Callable[[str], str]:
    """An engine that answers by the number in its prompt's first line; ``quota``: its own is used up at some prompts."""

    def engine(prompt: str) -> str:
        n, again = int(prompt.split("\n")[0]), "refused; mend this" in prompt
        if n % 7 == 4:
            raise RuntimeError("disk quota")
        if n % 7 == 5 and quota:
            raise RuntimeError("usage limit reached")
        if n % 7 == 1 and not again:
            return "no object"
        label = "person" if n % 7 == 3 and not again else "Person"
        nodes = [{"id": str(i), "label": label, "properties": {"name": f"P{i}"}} for i in range(1 + n % 5)]
        rels = [{"type": "KNOWS", "start_node_id": "0", "end_node_id": "x" if n % 7 == 2 else str(n % 5)}]
        return "Here:\n```json\n" + json.dumps({"nodes": nodes, "relationships": rels}) + "\n```"

    return engine


@query("""WITH d AS (SELECT doc_id, coalesce(length(text), 0) AS n FROM documents)
SELECT doc_id, CASE n % 7 WHEN 2 THEN 'bad_output' WHEN 4 THEN 'crash' END AS kind, n % 7 IN (1, 2, 3) AS corrected, CASE WHEN n % 7 NOT IN (2, 4) THEN (1 + n % 5)::INTEGER END AS n_nodes, CASE WHEN n % 7 NOT IN (2, 4) THEN 1::INTEGER END AS n_rels FROM d""")
def generation_outcomes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("stem"), F.concat_ws("\n", F.coalesce(F.length("text"), F.lit(0)).cast("string"), "text").alias("prompt"))
    got = generate.run(docs, {"one": _answering(True), "two": _answering(False)}, datetime(2026, 1, 1))
    return got.documents.select(F.col("stem").cast("long").alias("doc_id"), "kind", "corrected", "n_nodes", "n_rels")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
