"""Graph analytics on ``edges(src, dst)`` and ``nodes(id)``: iterated joins, one table a round.

Rounds join by shuffles: a table that is sent round by the driver costs it a
few MB, and there are hundreds of such joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import written


def _any(df: DataFrame) -> bool:
    return bool(df.limit(1).count())


def _dealt(df: DataFrame) -> DataFrame:
    """A side of a join that is dealt to parts and sorted, however small it is: no rows pass through the driver."""
    return df.hint("merge")


def _within(links: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among the ids."""
    return links.join(_dealt(ids.select(F.col("id").alias("src"))), "src", "left_semi").join(_dealt(ids.select(F.col("id").alias("dst"))), "dst", "left_semi").select("src", "dst")


def _spread(labels: DataFrame, edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Greatest label that reaches each node along the edges, by rounds until nothing changes; a label's own label counts too."""
    while True:
        sent = edges.join(_dealt(labels.withColumnRenamed("id", src)), src).select(F.col(dst).alias("id"), "colour", F.lit(None).cast(labels.schema["colour"].dataType).alias("before"))
        best = sent.unionByName(labels.withColumn("before", F.col("colour"))).groupBy("id").agg(F.max("colour").alias("colour"), F.max("before").alias("before"))
        above = best.select(F.col("id").alias("colour"), F.col("colour").alias("above"))
        new = written(best.join(_dealt(above), "colour", "left").select("id", F.greatest("colour", F.coalesce("above", "colour")).alias("colour"), "before"), "colours")
        labels = new.drop("before")
        if not _any(new.where("colour <> before")):
            return labels


def _coloured(left: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round of colouring: (id, component) of what it settles, and the colours of all.

    The greatest id that reaches a node is its colour; the nodes of a colour
    that can reach back to its root form a component.
    """
    colours = _spread(left.select("id", F.col("id").alias("colour")), links, "src", "dst")
    same = links.join(_dealt(colours.withColumnsRenamed({"id": "src", "colour": "c1"})), "src").join(_dealt(colours.withColumnsRenamed({"id": "dst", "colour": "c2"})), "dst")
    same = written(same.where("c1 = c2").select("src", "dst", F.col("c1").alias("colour")), "same-colour")
    reach = written(colours.where("id = colour"), "roots")
    while True:
        back = same.join(_dealt(reach.select(F.col("id").alias("dst"))), "dst").select(F.col("src").alias("id"), "colour")
        fresh = written(back.distinct().join(_dealt(reach), "id", "left_anti"), "fresh")
        if not _any(fresh):
            return reach.select("id", F.col("colour").alias("component")), colours
        reach = written(reach.unionByName(fresh), "reach")


def _chains(links: DataFrame) -> list[DataFrame]:
    """Nodes with one way out and where 1, 2, 4, .. steps along such nodes lead: (id, to, least), least the least id on the way.

    Pointers are doubled until all have left such nodes, or only rings are left
    to go round: as many nodes are pointed at as before (so they lie on rings),
    and no least id has changed (so each ring has been gone round).
    """
    jumps = [written(links.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"), F.min("dst").alias("to")).where("n = 1").select("id", "to", F.col("id").alias("least")), "chains")]
    before = None
    while True:
        last = jumps[-1]
        ahead = last.select(F.col("id").alias("to"), F.col("to").alias("far"), F.col("least").alias("low"))
        both = last.join(_dealt(ahead), "to", "left").select("id", F.coalesce("far", "to").alias("to"), F.least("least", "low").alias("least"), F.col("far").isNotNull().alias("went"), (F.col("low") < F.col("least")).alias("moved"))
        new = written(both, "chains")
        now = new.where("went").agg(F.count_distinct("to").alias("n"), F.count_if("moved").alias("moved")).first()
        if not now.n:
            return [*jumps, new.drop("went", "moved")]
        jumps.append(new.drop("went", "moved"))
        if now.n == before and not now.moved:
            return jumps
        before = now.n


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least id of each strongly connected component.

    Nodes without a way in or out are components of one. Nodes with one way out
    (or in) are drawn into the node that their chain leads to, which doubling of
    pointers tells in a logarithmic number of rounds; a chain that never leaves
    such nodes is a ring, and a component. Whatever is left is coloured: each
    round settles a component per colour. Then the chains are let out again:
    their nodes belong to the component if it has a way into the chain at or
    before them.
    """
    left = written(nodes.select("id").distinct(), "nodes")
    links = written(edges.select("src", "dst").where("src <> dst").distinct(), "edges")
    found = _solved(left, links)
    least = found.groupBy("component").agg(F.min("id").alias("least"))
    return found.join(_dealt(least), "component").select("id", F.col("least").alias("component"))


def _solved(left: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component), the component named by any of its nodes."""
    inner = written(left.join(_dealt(links.select(F.col("src").alias("id"))), "id", "left_semi").join(_dealt(links.select(F.col("dst").alias("id"))), "id", "left_semi"), "inner")
    alone = left.join(_dealt(inner), "id", "left_anti").select("id", F.col("id").alias("component"))
    if inner.count() < left.count():
        return alone if not _any(inner) else alone.unionByName(_solved(inner, written(_within(links, inner), "edges")))
    if not _any(left):
        return alone
    for turned in (False, True):
        ways = links.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if turned else links
        jumps = _chains(ways)
        if _any(jumps[0]):
            return _drawn_in(left, ways, jumps, turned)
    settled, colours = _coloured(left, links)
    settled = written(settled, "settled")
    rest = written(left.join(_dealt(settled), "id", "left_anti"), "nodes")
    if not _any(rest):
        return settled
    # A component lies in one colour: edges between colours are in none.
    of = rest.join(_dealt(colours), "id")
    inside = _within(links, rest).join(_dealt(of.select(F.col("id").alias("src"), F.col("colour").alias("c1"))), "src").join(_dealt(of.select(F.col("id").alias("dst"), F.col("colour").alias("c2"))), "dst")
    return settled.unionByName(_solved(rest, written(inside.where("c1 = c2").select("src", "dst"), "edges")))


def _drawn_in(left: DataFrame, links: DataFrame, jumps: list[DataFrame], turned: bool) -> DataFrame:
    """Components of a graph whose chains are drawn into the nodes they lead to."""
    ids, ends = jumps[0].select("id"), jumps[-1]
    endless = written(ends.join(_dealt(ids.select(F.col("id").alias("to"))), "to", "left_semi"), "endless")  # these lead to a ring
    ring = endless.select(F.col("to").alias("id")).distinct()
    of_ring = endless.join(_dealt(ring), "id", "left_semi").select("id", F.col("least").alias("component"))
    to_ring = endless.join(_dealt(ring), "id", "left_anti").select("id", F.col("id").alias("component"))
    roots = written(ends.join(_dealt(endless.select("id")), "id", "left_anti").select("id", F.col("to").alias("root")), "roots")
    core = written(left.join(_dealt(ids), "id", "left_anti"), "nodes")
    own = links.join(_dealt(ids.select(F.col("id").alias("src"))), "src", "left_anti").join(_dealt(endless.select(F.col("id").alias("dst"))), "dst", "left_anti")
    drawn = written(own.join(_dealt(roots.withColumnRenamed("id", "dst")), "dst", "left").select("src", "dst", "root"), "drawn")
    across = drawn.select("src", F.coalesce("root", "dst").alias("dst")).where("src <> dst").distinct()
    across = across.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if turned else across
    inner = written(_solved(core, written(across, "edges")), "inner")
    named = roots.join(_dealt(inner.select(F.col("id").alias("root"), "component")), "root").select("id", "component")
    # Chain nodes that the component of their end has a way into, and from these on along the chain.
    entry = drawn.where("root is not null").join(_dealt(inner.select(F.col("id").alias("src"), F.col("component").alias("from"))), "src")
    marked = written(entry.select(F.col("dst").alias("id"), "from").join(_dealt(named), "id").where("from = component").select("id").distinct(), "marked")
    for step in jumps if _any(marked) else []:
        marked = written(marked.unionByName(marked.join(_dealt(step), "id").select(F.col("to").alias("id")).join(_dealt(ids), "id", "left_semi")).distinct(), "marked")
    inside = named.join(_dealt(marked), "id", "left_semi")
    outside = named.join(_dealt(marked), "id", "left_anti").select("id", F.col("id").alias("component"))
    return inner.unionByName(of_ring).unionByName(to_ring).unionByName(inside).unionByName(outside)


def cyclic_edges(edges: DataFrame, components: DataFrame) -> DataFrame:
    """Self loops and edges inside a component."""
    a = components.select(F.col("id").alias("src"), F.col("component").alias("c1"))
    b = components.select(F.col("id").alias("dst"), F.col("component").alias("c2"))
    return edges.join(_dealt(a), "src").join(_dealt(b), "dst").where("c1 = c2").drop("c1", "c2")


def analyze_dag(nodes: DataFrame, edges: DataFrame, components: DataFrame) -> DataFrame:
    """One row: is_dag (false for an empty graph), cyclic edges, self loops, components of several nodes."""
    cyclic = cyclic_edges(edges, components).agg(F.count("*").alias("cyclic_edges"), F.count_if(F.col("src") == F.col("dst")).alias("self_loops"))
    large = components.groupBy("component").count().where("count > 1").agg(F.count("*").alias("cyclic_components"))
    size = nodes.agg(F.count("*").alias("n"))
    return cyclic.crossJoin(large).crossJoin(size).select(((F.col("cyclic_edges") == 0) & (F.col("n") > 0)).alias("is_dag"), "cyclic_edges", "self_loops", "cyclic_components")


def dag_depth(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, depth): the longest path from a root, level by level: a node's level is settled once all before it are.

    Where that leaves nodes over, there are cycles: then :func:`cyclic_depth` has the result.
    """
    links = written(edges.select("src", "dst").distinct(), "links")
    waits = links.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("waits"))
    left = written(nodes.select("id").distinct().join(waits, "id", "left").select("id", F.coalesce("waits", F.lit(0)).alias("waits")), "waiting")
    found, level = None, 0
    while True:
        now = written(left.where("waits = 0").select("id", F.lit(level).cast("long").alias("depth")), "level")
        if not now.limit(1).count():
            break
        found = now if found is None else found.unionByName(now)
        if level % 16 == 15:
            found = written(found, "levels")
        done = links.join(now.select(F.col("id").alias("src")), "src", "left_semi").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("done"))
        left = written(left.where("waits > 0").join(done, "id", "left").select("id", (F.col("waits") - F.coalesce("done", F.lit(0))).alias("waits")), "waiting")
        level += 1
    if left.limit(1).count():
        return cyclic_depth(nodes, edges)
    return found if found is not None else nodes.select("id", F.lit(0).cast("long").alias("depth"))


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least id of each part that edges of either direction hold together.

    Every round takes the least label among neighbours and the label's own
    label, so that chains shrink by halves.
    """
    both = written(both_ways(edges).where("id <> other").select("id", "other").distinct(), "both-ways")
    labels = written(nodes.select("id").distinct().withColumn("component", F.col("id")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "other"), "other").select("id", "component")
        least = near.unionByName(labels).groupBy("id").agg(F.min("component").alias("component"))
        up = least.select(F.col("id").alias("component"), F.col("component").alias("above"))
        new = written(least.join(up, "component", "left").select("id", F.least("component", F.coalesce("above", "component")).alias("component")), "labels")
        changed = new.join(labels.withColumnRenamed("component", "before"), "id").where("component <> before").limit(1).count()
        labels = new
        if not changed:
            return labels


def walk_depths(order: list, out: dict) -> dict:
    """Depths of a walk from all nodes in ``order``: a node is entered again whenever a longer way to it is found, but never from itself.

    ``out``: each node's next nodes in the order of their edges.
    """
    depth = dict.fromkeys(order, -1)
    for start in order:
        if depth[start] >= 0:
            continue
        depth[start] = 0
        trail, open_ = [(start, iter(out.get(start, ())))], {start}
        while trail:
            node, ahead = trail[-1]
            for other in ahead:
                if other not in open_ and depth[other] <= depth[node]:
                    depth[other] = depth[node] + 1
                    trail.append((other, iter(out.get(other, ()))))
                    open_.add(other)
                    break
            else:
                trail.pop()
                open_.discard(node)
    return depth


def cyclic_depth(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, depth) where cycles occur: nodes and edges in the order of ``place``, where they have one, else of their ids.

    With cycles a longest path depends on where a walk starts and on the way it
    takes. So the nodes that can get to a cycle are walked as they come, one
    task for each weakly connected part of them. All others are settled by
    rounds, from the depths of the nodes before them: those are the same for
    any order.
    """
    node_place, edge_place = ("place" if "place" in t.columns else None for t in (nodes, edges))
    points = written(nodes.groupBy("id").agg((F.min(node_place) if node_place else F.min("id")).alias("place")), "points")
    ids = points.select("id")
    inside = edges.where("src <> dst").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    links = written(inside.groupBy("src", "dst").agg((F.min(edge_place) if edge_place else F.min("dst")).alias("place")), "links")
    # What has no way out, again and again: the rest gets to a cycle.
    core = links
    while True:
        kept = written(core.join(core.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst", "place"), "core")
        if kept.count() == core.count():
            break
        core = kept
    walked = written(points.join(core.select(F.col("src").alias("id")).distinct(), "id", "left_semi"), "walked")
    parts = weak_components(walked, core)
    rows = walked.join(parts, "id").select("component", F.col("id").alias("src"), F.col("id").alias("dst"), "place")  # a node: no edge has one end only
    rows = rows.unionByName(core.join(parts.withColumnRenamed("id", "src"), "src").select("component", "src", "dst", "place"))

    def walk(part):
        import pandas as pd

        part = part.sort_values(["place", "src", "dst"], kind="stable")
        at = part["src"] == part["dst"]
        out = part[~at].groupby("src", sort=False)["dst"].agg(list).to_dict()
        depth = walk_depths(part["src"][at].tolist(), out)
        return pd.DataFrame({"id": list(depth), "depth": list(depth.values())})

    kind = points.schema["id"].dataType.simpleString()
    found = written(rows.groupBy("component").applyInPandas(walk, f"id {kind}, depth long"), "depths")
    rest = links.join(walked.select(F.col("id").alias("dst")), "dst", "left_anti")
    left = written(points.select("id").join(walked.select("id"), "id", "left_anti"), "left")
    fresh = found
    ready = left.join(rest.select(F.col("dst").alias("id")).distinct(), "id", "left_anti").withColumn("depth", F.lit(0).cast("long"))
    waits = written(rest.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("waits")).withColumn("depth", F.lit(0).cast("long")), "waits")
    while True:
        if ready is not None:
            fresh, ready = written(fresh.unionByName(ready), "fresh"), None
            found = fresh
        done = rest.join(fresh.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("done"), F.max(F.col("depth") + 1).alias("ahead"))
        now = waits.join(done, "id", "left").select("id", (F.col("waits") - F.coalesce("done", F.lit(0))).alias("waits"), F.greatest("depth", F.coalesce("ahead", F.lit(0))).alias("depth"))
        now = written(now, "waits")
        fresh = now.where("waits = 0").select("id", "depth")
        if not fresh.limit(1).count():
            return found
        found, waits = found.unionByName(fresh), now.where("waits > 0")


def both_ways(edges: DataFrame) -> DataFrame:
    """(id, other, edge end) in both directions; a self loop counts twice."""
    return edges.select(F.col("src").alias("id"), F.col("dst").alias("other")).unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("other")))


def expanded(edges: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen nodes with their direct neighbours, and the edges with both ends among them."""
    near = both_ways(edges).join(chosen.select("id"), "id", "left_semi").select(F.col("other").alias("id"))
    seen = near.unionByName(chosen.select("id")).distinct()
    inside = edges.join(seen.withColumnRenamed("id", "src"), "src", "left_semi").join(seen.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return seen, inside


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy("id").agg(F.count("*").alias("degree"))


def highest_degree(edges: DataFrame) -> DataFrame:
    """The node of most edge ends; of several the least id."""
    return degrees(edges).orderBy(F.desc("degree"), "id").limit(1)


def neighbours(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy("id").agg(F.sort_array(F.collect_set("other")).alias("neighbours"), F.count("*").alias("links"))


def neighbour_counts(edges: DataFrame) -> DataFrame:
    """(id, n_neighbours, links): a hub's neighbours are counted by pairs, never gathered."""
    pairs = both_ways(edges).groupBy("id", "other").agg(F.count("*").alias("links"))
    return pairs.groupBy("id").agg(F.count("*").alias("n_neighbours"), F.sum("links").alias("links"))


def parallel_edges(edges: DataFrame, key: str = "id") -> DataFrame:
    """Edges with their place in, and the size of, the group between the same two nodes; ``rotation`` fans them out."""
    pair = [F.least("src", "dst"), F.greatest("src", "dst")]
    each, all_ = Window.partitionBy(*pair).orderBy(key), Window.partitionBy(*pair)
    rows = edges.withColumn("place", (F.row_number().over(each) - 1).cast("long")).withColumn("group_size", F.count("*").over(all_))
    return rows.withColumn("self_loop", F.col("src") == F.col("dst")).withColumn("rotation", F.col("place") * 2 * F.pi() / F.col("group_size"))


def connected_only(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(both_ways(edges).select("id").distinct(), "id", "left_semi")


def without_dangling(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges (by id) without repeats, and only the edges whose ends exist."""
    kept = nodes.dropDuplicates(["id"])
    ids = kept.select("id")
    inside = edges.dropDuplicates(["id"]).join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return kept, inside


def dangling_summary(nodes: DataFrame, edges: DataFrame, most_nodes: int, most_edges: int) -> DataFrame:
    """One row: nodes and edges kept, edges with a missing end, and ``truncated``: a limit was reached or an edge dangles."""
    kept, inside = without_dangling(nodes, edges)
    counts = kept.agg(F.count("*").alias("nodes")).crossJoin(inside.agg(F.count("*").alias("edges"))).crossJoin(edges.select("id").distinct().agg(F.count("*").alias("all")))
    cut = (F.col("nodes") >= most_nodes) | (F.col("all") >= most_edges) | (F.col("all") > F.col("edges"))
    return counts.select("nodes", "edges", (F.col("all") - F.col("edges")).alias("dangling"), cut.alias("truncated"))


def highlight_states(nodes: DataFrame, layer1: DataFrame, layer2: DataFrame) -> DataFrame:
    """(id, state): layer2 over layer1 over out."""
    one = layer1.select("id").distinct().withColumn("in1", F.lit(True))
    two = layer2.select("id").distinct().withColumn("in2", F.lit(True))
    state = F.when(F.col("in2"), "layer2").when(F.col("in1"), "layer1").otherwise("out")
    return nodes.join(one, "id", "left").join(two, "id", "left").select("id", state.alias("state"))


def highlight_counts(nodes: DataFrame, layer1: DataFrame, layer2: DataFrame) -> DataFrame:
    """One row a layer: ids received, ids present, and whether the highlight is active at all."""
    ids = nodes.select("id").distinct().withColumn("here", F.lit(True))
    rows = layer1.select("id").distinct().withColumn("layer", F.lit("layer1")).unionByName(layer2.select("id").distinct().withColumn("layer", F.lit("layer2")))
    counts = rows.join(ids, "id", "left").groupBy("layer").agg(F.count("*").alias("received"), F.count_if(F.col("here")).alias("matched"))
    return counts.withColumn("active", F.sum("matched").over(Window.partitionBy(F.lit(1))) > 0)


def rendered_layers(nodes: DataFrame, layer1: DataFrame, layer2: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is really drawn: both layers cut to present nodes, the first without the second."""
    two = layer2.select("id").intersect(nodes.select("id"))
    return layer1.select("id").intersect(nodes.select("id")).exceptAll(two), two


def structure_summary(nodes: DataFrame, rels: DataFrame, most: int = 8) -> DataFrame:
    """(kind, name, n): the most frequent labels and types."""
    counts = nodes.groupBy(F.lit("label").alias("kind"), F.col("label").alias("name")).agg(F.count("*").alias("n"))
    counts = counts.unionByName(rels.groupBy(F.lit("type").alias("kind"), F.col("type").alias("name")).agg(F.count("*").alias("n")))
    order = Window.partitionBy("kind").orderBy(F.desc("n"), "name")
    return counts.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).drop("k")


def differences(graph: DataFrame, source: DataFrame) -> DataFrame:
    """(side, row columns): what either has beyond the other, counting repeats."""
    return graph.exceptAll(source).withColumn("side", F.lit("extra")).unionByName(source.exceptAll(graph).withColumn("side", F.lit("missing")))
