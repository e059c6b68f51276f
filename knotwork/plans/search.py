"""A whole search: keywords to seeds, hops, paths, layer 1 - for many searches in one run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from .. import limits as L
from ..operators import search as S
from ..operators.filters import clamp
from ..tables import written


@dataclass
class Result:
    seeds: DataFrame
    unmatched: DataFrame
    nodes: DataFrame
    rels: DataFrame


def search(keywords: DataFrame, nodes: DataFrame, rels: DataFrame, index: S.Index | None = None, steps: S.Bucketed | None = None, hops: int = L.DEFAULT_HOPS, limit_nodes: int | None = None) -> Result:
    """``index`` and ``steps`` are a stored build's; without them they are made for this search. ``keywords(search_id, kw_pos, keyword, question)``; limits are clamped as the API clamps them."""
    limit_nodes = clamp(limit_nodes, L.DEFAULT_NODES, L.MAX_NODES)
    asked = written(S.with_keys(keywords), "keywords")
    found = written(S.seeds(asked, nodes, index or S.build_index(nodes)), "seeds")
    kept = written(S.capped(found), "seeds")
    ways = steps or S.Bucketed(written(S.steps(rels), "steps"), "at")
    hop_nodes, hop_rels = S.hops(kept, ways, clamp(hops, L.DEFAULT_HOPS, L.MAX_HOPS))
    paths = S.shortest_paths(written(S.seed_pairs(kept), "pairs"), ways)
    layer_nodes, layer_rels = S.assemble(kept, hop_nodes, hop_rels, written(paths, "paths"), nodes, rels, limit_nodes)
    return Result(kept, S.unmatched(asked, found), layer_nodes, layer_rels)
