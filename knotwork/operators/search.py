"""Keyword search over the merged graph, for many searches at once.

``keywords(search_id, kw_pos, keyword, question)`` is the small side everywhere;
``nodes(kgid, label, name, name_key)`` and ``rels(kgid, type, from_kgid,
to_kgid)`` are the graph. Every limit has a total order behind it: score, then
name_key, then kgid.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import limits as L
from ..functions.identity import ascii_name_key, composed, jamo
from ..tables import written
from . import substrings
from .text_index import STOP, Bucketed, Index, build_index, read_index, tokens, write_bucketed, write_index  # noqa: F401

def best(rows: DataFrame, most: int = L.SEEDS_PER_KEYWORD) -> DataFrame:
    """The first rows of each keyword; cut before the shuffle too, as the filter on row_number is pushed down."""
    order = Window.partitionBy("search_id", "kw_pos").orderBy(F.desc("score"), "name_key", "kgid")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def exact(keywords: DataFrame, nodes: DataFrame, index: Index | None = None) -> DataFrame:
    """T1: the keyword's key is the name's."""
    named = nodes if index is None or index.names is None else index.names.of(keywords, "kw_key")
    rows = keywords.join(named, keywords["kw_key"] == named["name_key"])
    return best(rows.select("search_id", "kw_pos", "kgid", "label", "name", "name_key", F.lit(1.0).alias("score")))


def bm25(keywords: DataFrame, nodes: DataFrame, index: Index) -> DataFrame:
    """T2 before the floor: all nodes that share a token with the keyword, scored."""
    asked = keywords.select("search_id", "kw_pos", F.explode(F.array_distinct(tokens(F.col("kw_key")))).alias("token"))
    rows = index.postings.of(asked).join(asked, "token").join(index.counts.of(asked), "token")
    corpus = index.corpus.first()
    idf = F.log(1 + (corpus.n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") / (F.col("tf") + L.BM25_K1 * (1 - L.BM25_B + L.BM25_B * F.col("dl") / (corpus.avgdl or 1)))
    scored = rows.groupBy("search_id", "kw_pos", "kgid").agg(F.round(F.sum(idf * tf), 9).alias("score"))
    return scored.join(nodes.select("kgid", "label", "name", "name_key"), "kgid").select("search_id", "kw_pos", "kgid", "label", "name", "name_key", "score")


def floored(scored: DataFrame) -> DataFrame:
    """The best five of each keyword with ``ratio`` to its first, and ``kept`` where that reaches the floor."""
    top = F.max("score").over(Window.partitionBy("search_id", "kw_pos"))
    rows = best(scored).withColumn("top", top)
    return rows.withColumn("kept", F.col("score") >= L.FLOOR * F.col("top")).withColumn("ratio", F.round(F.col("score") / F.col("top"), 4)).drop("top")


def containing(keywords: DataFrame, nodes: DataFrame, index: Index | None = None) -> DataFrame:
    """T3: one key lies inside the other, by equi-joins over grams and runs; with an index only the asked grams are read."""
    asked = keywords.where("kw_key <> ''").select("search_id", "kw_pos", F.col("kw_key").alias("needle"))
    long = asked.where(F.length("needle") >= L.CONTAINED_MIN_CHARS)  # these may also hold a name
    columns = ["needle", "kgid", "label", "name", "name_key"]
    if index is None or index.grams is None:
        named = nodes.where("name_key <> ''")
        names = written(named.select(F.col("name_key").alias("text")).distinct(), "names")
        longest = names.agg(F.max(F.length("text")).alias("n")).first().n or 1
        pairs = substrings.holders(asked, names).unionByName(substrings.inner_runs(long, longest).join(names, "text", "left_semi"))
        rows = named.join(pairs.withColumnRenamed("text", "name_key").distinct(), "name_key").select(columns)
    else:
        needles = asked.select("needle").distinct()
        own = needles.select(F.explode(substrings.own_grams(F.col("needle"))).alias("gram"))
        chosen = written(substrings.rarest(needles, index.gram_counts.of(own)), "rarest")
        over = index.grams.of(chosen).join(chosen, "gram").where(F.contains("name_key", "needle")).select("needle", "name_key")
        under = substrings.inner_runs(long, index.corpus.first().longest or 1).select("needle", F.col("text").alias("name_key"))
        pairs = written(over.unionByName(under).distinct(), "t3-pairs")
        rows = index.names.of(pairs).join(pairs, "name_key").select(columns)
    return best(rows.join(asked, "needle").select("search_id", "kw_pos", "kgid", "label", "name", "name_key", F.lit(0.5).alias("score")))


def with_keys(keywords: DataFrame) -> DataFrame:
    """At most 8 keywords a search, with their keys."""
    asked = keywords.where(F.col("kw_pos") < L.MAX_KEYWORDS).withColumn("kw_key", F.col("keyword"))
    return composed(asked, "kw_key").withColumn("kw_key", ascii_name_key(F.col("kw_key")))


def waterfall(keywords: DataFrame, nodes: DataFrame, index: Index, tiers: int = 3) -> DataFrame:
    """Each keyword's nodes of the first tier that has any; a later tier only sees what earlier ones missed."""
    key = ["search_id", "kw_pos"]
    # A few rows a keyword: written, so that no tier is computed again by the next.
    t1 = written(exact(keywords, nodes, index).withColumn("tier", F.lit("T1")), "t1")
    left = keywords.join(t1, key, "left_anti")
    t2 = written(floored(bm25(left, nodes, index)).where("kept").drop("kept", "ratio").withColumn("tier", F.lit("T2")), "t2")
    if tiers < 3:
        return t1.unionByName(t2)
    t3 = written(containing(left.join(t2, key, "left_anti"), nodes, index).withColumn("tier", F.lit("T3")), "t3")
    return t1.unionByName(t2).unionByName(t3)


def anchor_candidates(keywords: DataFrame) -> DataFrame:
    """(search_id, kw_pos, candidate): the one window of the question that a damaged Hangul keyword can stand for.

    Windows have as many characters as the keyword, begin at a word's start,
    are Hangul and inner spaces only, and lie one jamo away. A keyword that the
    question holds as it is, or with two different candidates, has none.
    """
    hangul = "^[가-힣 ]+$"
    n = F.length("kw_key")
    rows = composed(keywords.where(F.col("question").isNotNull()).withColumn("q", F.col("question")), "q").withColumn("q", ascii_name_key(F.col("q")))
    rows = rows.where((F.col("question") != "") & F.col("kw_key").rlike(hangul) & (n >= L.ANCHOR_MIN_CHARS) & ~F.col("q").contains(F.col("kw_key")))
    runs = rows.select("search_id", "kw_pos", "kw_key", F.explode(F.split("q", "[^0-9a-z가-힣 ]+")).alias("run")).where(F.length("run") >= n)
    windows = runs.select("search_id", "kw_pos", "kw_key", "run", F.explode(F.sequence(F.lit(1), F.length("run") - n + 1)).alias("i"))
    windows = windows.withColumn("candidate", F.col("run").substr(F.col("i"), n))
    ok = F.col("candidate").rlike(hangul) & ~F.col("candidate").rlike("^ | $") & ((F.col("i") == 1) | (F.col("run").substr(F.col("i") - 1, F.lit(1)) == " "))
    near = windows.where(ok).where(F.levenshtein(jamo(F.col("kw_key")), jamo(F.col("candidate")), L.ANCHOR_DISTANCE).between(1, L.ANCHOR_DISTANCE))
    one = near.groupBy("search_id", "kw_pos").agg(F.min("candidate").alias("candidate"), F.max("candidate").alias("other"))
    return one.where("candidate = other").drop("other")


def seeds(keywords: DataFrame, nodes: DataFrame, index: Index) -> DataFrame:
    """All keywords' seeds, repaired ones after T1 and T2 of their candidate; cut to 15 rows a search by score."""
    first = waterfall(keywords, nodes, index).withColumn("restored", F.lit(None).cast("string"))
    missed = keywords.join(first, ["search_id", "kw_pos"], "left_anti")
    again = written(missed.join(anchor_candidates(missed), ["search_id", "kw_pos"]).withColumn("kw_key", F.col("candidate")), "repaired")
    if not again.limit(1).count():
        return first
    second = waterfall(again.drop("candidate"), nodes, index, 2).join(again.select("search_id", "kw_pos", F.col("candidate").alias("restored")), ["search_id", "kw_pos"])
    return first.unionByName(second)


def unmatched(keywords: DataFrame, found: DataFrame) -> DataFrame:
    return keywords.join(found, ["search_id", "kw_pos"], "left_anti").select("search_id", "kw_pos", "keyword")


def capped(found: DataFrame, most: int = L.MAX_SEEDS) -> DataFrame:
    """Seed rows whose node is among the best ``most`` rows of the search, by score, keyword and rank."""
    order = Window.partitionBy("search_id").orderBy(F.desc("score"), "kw_pos", "rank")
    top = found.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).select("search_id", "kgid").distinct()
    return found.join(top, ["search_id", "kgid"], "left_semi")


def steps(rels: DataFrame) -> DataFrame:
    """Relationships from both ends: (at, to, kgid, type, from_kgid, to_kgid)."""
    whole = rels.where("kgid is not null")
    out = whole.select(F.col("from_kgid").alias("at"), F.col("to_kgid").alias("to"), "kgid", "type", "from_kgid", "to_kgid")
    return out.unionByName(whole.where("from_kgid <> to_kgid").select(F.col("to_kgid").alias("at"), F.col("from_kgid").alias("to"), "kgid", "type", "from_kgid", "to_kgid"))


def ways_of(rels: DataFrame | Bucketed) -> Bucketed:
    """The steps of relationships, or of a build those that lie with it."""
    return rels if isinstance(rels, Bucketed) else Bucketed(steps(rels), "at")


def hops(start: DataFrame, rels: DataFrame | Bucketed, k: int, most: int | None = L.RELS_PER_HOP) -> tuple[DataFrame, DataFrame]:
    """Nodes (search_id, kgid, hop) and relationships (search_id, hop, ...) within k hops of ``start(search_id, kgid)``.

    A hop reads at most ``most`` relationship rows a search, least kgid first; all of them where that is None.
    """
    seen = written(start.select("search_id", "kgid").distinct().withColumn("hop", F.lit(0)), "hop")
    frontier, ways, used = seen, ways_of(rels), None
    for hop in range(1, k + 1):
        rows = ways.of(frontier, "kgid").withColumnRenamed("kgid", "rel_kgid").join(frontier.select("search_id", F.col("kgid").alias("at")), "at")
        if most is not None:
            order = Window.partitionBy("search_id").orderBy("rel_kgid", "at")
            rows = rows.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most)
        rows = written(rows.select("search_id", F.lit(hop).alias("hop"), F.col("rel_kgid").alias("kgid"), "type", "from_kgid", "to_kgid", "to"), "hop-rels")
        used = rows if used is None else used.unionByName(rows)
        fresh = rows.select("search_id", F.col("to").alias("kgid")).distinct().join(seen, ["search_id", "kgid"], "left_anti").withColumn("hop", F.lit(hop))
        frontier = written(fresh, "hop")
        seen = seen.unionByName(frontier)
    return seen, used.drop("to")


def seed_pairs(found: DataFrame, most: int = L.PATH_PAIRS) -> DataFrame:
    """(search_id, pair, a, b): pairs of the keywords' distinct first seeds, in keyword order."""
    first = found.where("rank = 1").groupBy("search_id", "kgid").agg(F.min("kw_pos").alias("kw_pos"))
    a, b = (first.select("search_id", F.col("kgid").alias(s), F.col("kw_pos").alias(f"pos_{s}")) for s in "ab")
    rows = a.join(b, "search_id").where("pos_a < pos_b")
    order = Window.partitionBy("search_id").orderBy("pos_a", "pos_b")
    return rows.withColumn("pair", F.row_number().over(order)).where(F.col("pair") <= most).select("search_id", "pair", "a", "b")


def shortest_paths(pairs: DataFrame, rels: DataFrame | Bucketed, most: int = L.PATH_LENGTH) -> DataFrame:
    """(search_id, pair, a, b, length, nodes, rels): one shortest undirected path of at most ``most`` steps.

    Both ends advance level by level, the smaller front first, and keep only
    (pair, node, distance). Where the fronts meet, the nodes between are told by
    walks inside the levels, and the path takes the least next node at each
    step, and the least relationship to it. Pairs of one node have no path.
    """
    ways = ways_of(rels)
    if not ways.buckets:
        ways = Bucketed(written(ways.table, "ways"), "at")
    key = ["search_id", "pair"]
    node = [*key, "node"]
    pairs = written(pairs, "pairs")
    levels = {s: [pairs.where("a <> b").select(*key, F.col(s).alias("node"), F.lit(False).alias("hit"))] for s in "ab"}
    met: list[DataFrame] = []

    def open_front(side: str) -> DataFrame:
        front = levels[side][-1].select(node)
        return front.join(reduce(DataFrame.unionByName, met).select(key).distinct(), key, "left_anti") if met else front

    def near(front: DataFrame, parts: list[int | None]) -> DataFrame:
        return front.join(ways.parts(parts).select(F.col("at").alias("node"), "to", F.col("kgid").alias("rel")), "node")

    for _ in range(most):
        # One look at both fronts: their sizes, and the buckets that their nodes lie in.
        both = reduce(DataFrame.unionByName, [open_front(s).select(F.lit(s).alias("side"), ways.part("node").alias("part")) for s in "ab"])
        fronts = {r.side: r for r in both.groupBy("side").agg(F.count("*").alias("n"), F.collect_set("part").alias("parts")).collect()}
        if len(fronts) < 2:
            break
        side, other = sorted("ab", key=lambda s: fronts[s].n)
        fresh = near(open_front(side), fronts[side].parts).select(*key, F.col("to").alias("node")).distinct()
        for level in levels[side][-2:]:  # a neighbour lies in this level, the one before or the next
            fresh = fresh.join(level, node, "left_anti")
        facing = levels[other][-1].select(*node, F.lit(True).alias("hit"))
        levels[side].append(written(fresh.join(facing, node, "left").select(*node, F.coalesce("hit", F.lit(False)).alias("hit")), "level"))
        place = [F.lit(len(levels[s]) - 1).alias(f"from_{s}") for s in "ab"]
        met.append(levels[side][-1].where("hit").select(*node, *place))
    if not met:
        return pairs.limit(0).select(*key, "a", "b", F.lit(0).alias("length"), F.array("a").alias("nodes"), F.array("a").alias("rels"))
    here = reduce(DataFrame.unionByName, met)
    # Steps on shortest ways, from where the fronts met back to both ends; place: how far a node lies from its end.
    labelled = [t.select(*key, F.col("node").alias("to"), F.lit(s).alias("side"), F.lit(i + 1).alias("place")) for s in "ab" for i, t in enumerate(levels[s][:-1])]
    nearer = reduce(DataFrame.unionByName, labelled)
    at = here.select(*node, F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"from_{s}").alias("place")) for s in "ab"))).alias("e")).select(*node, "e.*")
    inside: list[DataFrame] = []
    for _ in range(max(map(len, levels.values())) - 1):
        at = at.where("place > 0")
        parts = at.agg(F.collect_set(ways.part("node")).alias("p")).first().p
        rows = near(at, parts).join(nearer, [*key, "to", "side", "place"]).groupBy(*node, "to", "side", "place").agg(F.min("rel").alias("rel"))
        inside.append(written(rows, "on-way"))
        at = inside[-1].select(*key, F.col("to").alias("node"), "side", (F.col("place") - 1).alias("place")).distinct()
    length = here.groupBy(key).agg(F.max(F.col("from_a") + F.col("from_b")).alias("length"))
    # All of them away from the first node, with their number; a path takes the least at each.
    first = F.col("side") == "a"
    rows = reduce(DataFrame.unionByName, inside).join(F.broadcast(length), key)
    step = F.when(first, F.col("place")).otherwise(F.col("length") - F.col("place") + 1)
    away = written(rows.select(*key, step.alias("step"), F.when(first, F.col("to")).otherwise(F.col("node")).alias("last"), F.when(first, F.col("node")).otherwise(F.col("to")).alias("next"), "rel"), "away")
    path = pairs.join(length, key).select(*key, "a", "b", "length", F.array("a").alias("nodes"), F.array().cast("array<string>").alias("rels"))
    same = path.columns
    for k in range(1, most + 1):
        ahead = away.where(F.col("step") == k).select(*key, "last", F.struct("next", "rel").alias("s"))
        chosen = path.withColumn("last", F.element_at("nodes", -1)).join(ahead, [*key, "last"], "left").groupBy(same).agg(F.min("s").alias("s"))
        more = lambda c, f: F.when(F.col("s").isNull(), F.col(c)).otherwise(F.concat(c, F.array(f"s.{f}"))).alias(c)
        path = chosen.select(*key, "a", "b", "length", more("nodes", "next"), more("rels", "rel"))
    return path


def assemble(found: DataFrame, hop_nodes: DataFrame, hop_rels: DataFrame, paths: DataFrame, nodes: DataFrame, rels: DataFrame, limit_nodes: int = L.DEFAULT_NODES) -> tuple[DataFrame, DataFrame]:
    """Layer 1: nodes by (priority, score) up to the limit, and the relationships among them.

    Priorities: seeds 0, path nodes 1, hop nodes 1 + hop; the least counts.
    Aliases n1.., r1.. follow the order; ``truncated`` marks a search that lost any.
    """
    one = found.groupBy("search_id", "kgid").agg(F.max("score").alias("score")).withColumn("priority", F.lit(0))
    two = paths.select("search_id", F.explode("nodes").alias("kgid")).distinct().select("search_id", "kgid", F.lit(0.0).alias("score"), F.lit(1).alias("priority"))
    three = hop_nodes.where("hop > 0").select("search_id", "kgid", F.lit(0.0).alias("score"), (F.col("hop") + 1).alias("priority"))
    every = one.unionByName(two).unionByName(three).groupBy("search_id", "kgid").agg(F.min("priority").alias("priority"), F.max("score").alias("score"))
    every = every.join(nodes.select("kgid", "label", "name", "name_key"), "kgid")
    order = Window.partitionBy("search_id").orderBy("priority", F.desc("score"), "name_key", "kgid")
    counted = every.withColumn("k", F.row_number().over(order)).withColumn("total", F.count("*").over(Window.partitionBy("search_id")))
    shape = F.when(F.col("priority") == 0, "0").when(F.col("priority") == 1, "path").otherwise((F.col("priority") - 1).cast("string"))
    top = counted.where(F.col("k") <= limit_nodes).select("search_id", F.concat(F.lit("n"), "k").alias("alias"), "kgid", "label", "name", shape.alias("hop"), "score", (F.col("total") > limit_nodes).alias("truncated"))
    most = L.RELS_LARGE if limit_nodes > L.DEFAULT_NODES else L.RELS
    by_path = paths.select("search_id", F.explode("rels").alias("kgid")).withColumn("hop", F.lit(L.MAX_HOPS + 1))
    used = hop_rels.select("search_id", "kgid", "hop").unionByName(by_path).groupBy("search_id", "kgid").agg(F.min("hop").alias("first"))
    ends = top.select("search_id", "kgid", "alias")
    kept = used.join(rels.select("kgid", "type", "from_kgid", "to_kgid"), "kgid")
    kept = kept.join(ends.select("search_id", F.col("kgid").alias("from_kgid"), F.col("alias").alias("from_alias")), ["search_id", "from_kgid"])
    kept = kept.join(ends.select("search_id", F.col("kgid").alias("to_kgid"), F.col("alias").alias("to_alias")), ["search_id", "to_kgid"])
    each = Window.partitionBy("search_id").orderBy("first", "kgid")
    kept = kept.withColumn("k", F.row_number().over(each)).withColumn("total", F.count("*").over(Window.partitionBy("search_id"))).where(F.col("k") <= most)
    return top, kept.select("search_id", F.concat(F.lit("r"), "k").alias("alias"), "kgid", "type", "from_alias", "to_alias", (F.col("total") > most).alias("truncated"))


def verify_citations(cited: DataFrame, aliases: DataFrame) -> DataFrame:
    """``cited(search_id, alias)`` against ``aliases(search_id, alias, kind, kgid, from_kgid, to_kgid)``: each with its kgid or a reason.

    The citations, of which there are fewer, are the hashed side by parts; aliases pass unsorted.
    """
    rows = cited.distinct().hint("shuffle_hash").join(aliases, ["search_id", "alias"], "left")
    return rows.withColumn("outcome", F.when(F.col("kgid").isNotNull(), "accepted").otherwise("unknown_alias"))


def cited_nodes(verified: DataFrame) -> DataFrame:
    """Nodes that citations light up: those cited and both ends of cited relationships."""
    ok = verified.where("outcome = 'accepted'")
    ids = F.when(F.col("kind") == "rel", F.array("from_kgid", "to_kgid")).otherwise(F.array("kgid"))
    return ok.select("search_id", F.explode(ids).alias("kgid")).distinct()


def citation_status(verified: DataFrame, layer1_size: DataFrame) -> DataFrame:
    """(search_id, submitted, accepted, status, dense); dense: over half of layer 1 was cited."""
    counts = verified.groupBy("search_id").agg(F.count("*").alias("submitted"), F.count_if(F.col("outcome") == "accepted").alias("accepted"))
    status = F.when(F.col("accepted") == 0, "none").when(F.col("accepted") < F.col("submitted"), "partial").otherwise("verified")
    return counts.join(layer1_size, "search_id").select("search_id", "submitted", "accepted", status.alias("status"), (F.col("submitted") > L.CITATION_DENSITY * F.col("total")).alias("dense"))


def last_searches(log: DataFrame, most: int = 5) -> DataFrame:
    """The newest searches of ``log(search_id, ts, ...)``: what the rolling log holds."""
    return log.orderBy(F.desc("ts"), F.desc("search_id")).limit(most)


def is_latest(log: DataFrame, search_id: str) -> DataFrame:
    return log.agg((F.max_by("search_id", F.struct("ts", "search_id")) == search_id).alias("is_latest"))
