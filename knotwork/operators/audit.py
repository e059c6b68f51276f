"""Audits: claims of absence, damaged keywords, pushed against rendered highlights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import name_key
from ..limits import RESULT_LINES
from .search import anchor_candidates
from .substrings import holders


def absent_nodes(claims: DataFrame, nodes: DataFrame) -> DataFrame:
    """``claims(name)`` with verdict: refuted where some node's key holds the name."""
    keyed = claims.select("name", name_key(F.col("name")).alias("needle")).distinct()
    found = holders(keyed, nodes.select(F.col("name_key").alias("text"))).select("needle").distinct()
    # An empty name lies in any node's.
    any_node = nodes.where("name_key is not null").limit(1).select(F.lit("").alias("needle"))
    hit = keyed.join(found.unionByName(any_node), "needle").select("name", F.lit(True).alias("hit"))
    return claims.join(hit, "name", "left").withColumn("verdict", F.when(F.col("hit"), "refuted").otherwise("true")).drop("hit")


def absent_properties(claims: DataFrame, values: DataFrame, families: DataFrame) -> DataFrame:
    """``claims(name, prop)``: a property is there if any of its family's patterns fits one of the node's.

    ``values(name_key, prop)``; ``families(family, pattern)``. A property without a
    family, or a node that isn't there, leaves the claim unmeasured.
    """
    keyed = claims.withColumn("name_key", name_key(F.col("name"))).join(F.broadcast(families), F.col("prop") == F.col("family"), "left")
    own = values.select("name_key", F.col("prop").alias("own")).distinct()
    rows = keyed.join(own, "name_key", "left")
    return rows.groupBy("name", "prop").agg(
        F.when(F.max(F.col("pattern").isNull()) | F.max(F.col("own").isNull()), "unmeasured").when(F.max(F.rlike("own", F.col("pattern"))), "refuted").otherwise("true").alias("verdict")
    )


def absent_relationships(claims: DataFrame, nodes: DataFrame, rels: DataFrame) -> DataFrame:
    """``claims(name, pattern)``: refuted where a relationship at the node has a type that fits; unmeasured without the node."""
    keyed = claims.withColumn("name_key", name_key(F.col("name"))).join(nodes.select("name_key", "kgid"), "name_key", "left")
    ends = rels.select(F.explode(F.array("from_kgid", "to_kgid")).alias("kgid"), "type").distinct()
    rows = keyed.join(ends, "kgid", "left")
    return rows.groupBy("name", "pattern").agg(
        F.when(F.max(F.col("kgid").isNotNull()) == F.lit(False), "unmeasured").when(F.max(F.coalesce(F.rlike("type", F.col("pattern")), F.lit(False))), "refuted").otherwise("true").alias("verdict")
    )


def damaged_keywords(probes: DataFrame) -> DataFrame:
    """(search_id, kw_pos, keyword, candidate, verdict) of ``probes(search_id, kw_pos, keyword, question)``.

    damaged: the question has one reading a jamo away; sound: it holds the
    keyword or nothing near; unmeasured: no question was kept.
    """
    keyed = probes.withColumn("kw_key", name_key(F.col("keyword")))
    rows = keyed.join(anchor_candidates(keyed), ["search_id", "kw_pos"], "left")
    verdict = F.when(F.col("question").isNull(), "unmeasured").when(F.col("candidate").isNotNull(), "damaged").otherwise("sound")
    return rows.select("search_id", "kw_pos", "keyword", "candidate", verdict.alias("verdict"))


def highlight_differences(pushed: DataFrame, rendered: DataFrame) -> DataFrame:
    """(layer, kind, id, side): what was pushed but not rendered, or the other way."""
    keys = ["layer", "kind", "id"]
    lost = pushed.select(keys).distinct().join(rendered, keys, "left_anti").withColumn("side", F.lit("not_rendered"))
    return lost.unionByName(rendered.select(keys).distinct().join(pushed, keys, "left_anti").withColumn("side", F.lit("not_pushed")))


def highlight_checks(searches: DataFrame, pushed: DataFrame, screens: DataFrame, shown: DataFrame) -> DataFrame:
    """(search_id, check, ok): eleven checks of each screen against what its search pushed.

    ``searches(search_id, question, truncated)``, ``pushed(search_id, kind, id)``;
    ``screens(search_id, question, truncated, total, matched, active, citation)``,
    ``shown(search_id, part, kind, id)`` with the parts layer1, layer2 (what the
    screen knows) and drawn1, drawn2. Ids are compared in one aggregation.
    """
    parts = ["pushed", "layer1", "layer2", "drawn1", "drawn2"]
    ids = pushed.select("search_id", F.lit("pushed").alias("part"), "kind", "id").unionByName(shown.select("search_id", "part", "kind", "id"))
    ids = ids.groupBy("search_id", "kind", "id").agg(*(F.max(F.col("part") == p).alias(p) for p in parts))

    def wrong(kind: str, rule: Column) -> Column:
        return F.count_if((F.col("kind") == kind) & rule)

    differs, beyond = F.col("pushed") != F.col("layer1"), F.col("layer2") & ~F.col("layer1")
    counts = ids.groupBy("search_id").agg(
        *(wrong(k, differs).alias(f"{k}_differ") for k in ("node", "rel")), *(wrong(k, beyond).alias(f"{k}_beyond") for k in ("node", "rel")),
        F.count_if("pushed").alias("n_pushed"), F.count_if("layer2").alias("n_layer2"), F.count_if(F.col("drawn1") & F.col("drawn2")).alias("n_twice"),
        (F.count_if("drawn1") + F.count_if("drawn2")).alias("n_drawn"),
    )
    asked = searches.select("search_id", F.col("question").alias("asked"), F.coalesce("truncated", F.lit(False)).alias("cut"), F.lit(True).alias("known"))
    rows = screens.join(asked, "search_id", "left").join(counts, "search_id", "left").fillna(0, [c for c in counts.columns if c != "search_id"])
    checks = {
        "search_id": F.col("known").isNotNull(), "question": F.col("question").eqNullSafe(F.col("asked")), "layer1_nodes": F.col("node_differ") == 0, "layer1_rels": F.col("rel_differ") == 0,
        "total": F.col("total") == F.col("n_pushed"), "truncated": F.coalesce("truncated", F.lit(False)) == F.coalesce("cut", F.lit(False)),
        "layer2_nodes": F.col("node_beyond") == 0, "layer2_rels": F.col("rel_beyond") == 0, "drawn_once": F.col("n_twice") == 0,
        "drawn": F.col("n_drawn") == F.when(F.col("active"), F.col("matched")).otherwise(0), "citation": F.coalesce(F.col("citation").isin("verified", "partial"), F.lit(False)) == (F.col("n_layer2") > 0),
    }
    each = F.array(*(F.struct(F.lit(k).alias("check"), F.coalesce(v, F.lit(False)).alias("ok")) for k, v in checks.items()))
    return rows.select("search_id", F.explode(each).alias("c")).select("search_id", "c.*")


def last_question(session: str = "session", order: str = "pos") -> Column:
    """The user's last utterance up to a row; what a client puts in (it begins with ``<``) is none."""
    said = F.when(~F.col("utterance").startswith("<"), F.trim(F.regexp_replace("utterance", r"\s+", " ")))
    return F.last(said, ignorenulls=True).over(Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def probes(parts: DataFrame, results: DataFrame) -> DataFrame:
    """Search calls paired with their results by id: (tool_id, question, question_source, keywords, seed_count, parse_failed).

    ``parts(session, pos, utterance, tool, tool_id, question, keywords)`` holds a
    row for each utterance and call, ``results(tool_id, content)`` the answers. A
    call without a question takes the user's last utterance. An answer without a
    JSON block, or with a broken one, is not measured: its count is null, not 0.
    """
    calls = parts.withColumn("said", last_question()).where(F.col("tool").contains("kg_search") & (F.size("keywords") > 0))
    own = F.nullif(F.col("question"), F.lit(""))
    calls = calls.select("tool_id", F.coalesce(own, F.col("said")).alias("question"), F.when(own.isNotNull(), "tool-arg").otherwise("user-utterance").alias("question_source"), "keywords")
    block = F.regexp_extract("content", r"(?s)```json\s*(.*?)```", 1)
    answers = results.select("tool_id", F.when(F.try_parse_json(block).isNotNull(), block).alias("block"))
    seeds = F.from_json("block", "seeds array<struct<matched array<string>>>")["seeds"]
    count = F.aggregate(F.coalesce(seeds, F.array()), F.lit(0), lambda n, s: n + F.coalesce(F.size(s["matched"]), F.lit(0)))
    return calls.join(answers, "tool_id").select("tool_id", "question", "question_source", "keywords", F.when(F.col("block").isNotNull(), count).alias("seed_count"), F.col("block").isNull().alias("parse_failed"))


def answer_trace(parts: DataFrame, needle: str, lines: int = 6) -> DataFrame:
    """(session, pos, question, call, shown): searches, citations and telling result lines that followed a question holding ``needle``.

    ``parts(session, at, pos, utterance, tool, input, result)``; only the latest
    session with such a question counts. Sessions without one are left out before
    the rows of a session are ordered.
    """
    hit = parts.where(F.col("utterance").contains(needle) & ~F.col("utterance").startswith("<"))
    latest = hit.agg(F.max_by("session", F.struct("at", "session")).alias("session"))
    rows = parts.join(F.broadcast(latest), "session").withColumn("asked", last_question()).where(F.col("asked").contains(needle))
    call = F.when(F.col("tool").rlike("kg_(search|cite)"), F.concat_ws(" ", F.regexp_replace("tool", "^.*__", ""), F.left("input", F.lit(120))))
    telling = F.slice(F.filter(F.split("result", "\n"), lambda x: x.rlike(RESULT_LINES)), 1, lines)
    shown = F.transform(telling, lambda x: F.left(F.trim(x), F.lit(110)))
    rows = rows.select("session", "pos", F.left("asked", F.lit(60)).alias("question"), call.alias("call"), shown.alias("shown"))
    return rows.where(F.col("call").isNotNull() | (F.size("shown") > 0))


def digests(rows: DataFrame, case: str, *columns: str) -> DataFrame:
    """(case, n, digest): rows counted and summed up by hash, whatever their order; a golden record of a case's result."""
    text = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns))
    value = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.groupBy(F.col(case).alias("case")).agg(F.count("*").alias("n"), F.sum(value).cast("string").alias("digest"))


def golden_differences(golden: DataFrame, now: DataFrame) -> DataFrame:
    """(case, verdict) of two sets of digests: same, changed, missing or new."""
    a = golden.select("case", F.struct("n", "digest").alias("was"))
    b = now.select("case", F.struct("n", "digest").alias("is"))
    verdict = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "missing").when(F.col("was") == F.col("is"), "same").otherwise("changed")
    return a.join(b, "case", "full").select("case", verdict.alias("verdict"))
