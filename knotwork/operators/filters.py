"""Filters, facets and projections over a graph's nodes and relationships.

``nodes(id, label, props)`` and ``rels(id, type, start_node_id, end_node_id, props)``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import trim_space
from ..limits import FACT_CHARS, FACTS_PER_NODE, SYSTEM_PROPS

RESERVED = {"id", "start_node_id", "end_node_id", "properties"}
TOP_LEVEL = {"type": "type", "label": "label"}


def field(rows: DataFrame, path: str) -> Column:
    """A facet's value: a column unless reserved or missing there, then the property of that name."""
    own = F.col("props")[path]
    return F.coalesce(F.col(path).cast("string"), own) if path in rows.columns and path not in RESERVED else own


def matching(rows: DataFrame, conditions: dict[str, object | list | Callable[[Column], Column]]) -> DataFrame:
    """All conditions: a list is IN, a function a predicate, anything else equality."""

    def one(path: str, want) -> Column:
        value = field(rows, path)
        if callable(want):
            return want(value)
        return value.isin([str(w) for w in want]) if isinstance(want, list) else value == str(want)

    return rows.where(reduce(lambda a, b: a & b, [one(p, w) for p, w in conditions.items()])) if conditions else rows


def touched(rels: DataFrame) -> DataFrame:
    return rels.select(F.explode(F.array("start_node_id", "end_node_id")).alias("id")).distinct()


def filtered_subgraph(nodes: DataFrame, rels: DataFrame, conditions: dict) -> tuple[DataFrame, DataFrame]:
    """Matching relationships and only the nodes that these touch."""
    kept = matching(rels, conditions)
    return nodes.join(touched(kept), "id", "left_semi"), kept


def facets(rows: DataFrame, paths: list[str]) -> DataFrame:
    """(facet, value): distinct values as text, nulls left out."""
    each = reduce(DataFrame.unionByName, [rows.select(F.lit(p).alias("facet"), field(rows, p).alias("value")) for p in paths])
    return each.where("value is not null").distinct()


def node_facets(nodes: DataFrame) -> DataFrame:
    """(facet, value) of all scalar properties."""
    rows = nodes.select(F.explode("props").alias("facet", "value")).where("value is not null and not startswith(value, '[')")
    return rows.distinct()


def node_facts(nodes: DataFrame, most: int = FACTS_PER_NODE, chars: int = FACT_CHARS) -> DataFrame:
    """(id, facts, omitted): sorted properties without the system's, arrays joined, texts clipped, empty ones dropped."""

    def shown(value: Column) -> Column:
        items = F.from_json(F.concat(F.lit('{"v":'), value, F.lit("}")), "v array<string>")["v"]
        text = F.from_json(F.concat(F.lit('{"v":'), value, F.lit("}")), "v string")["v"]
        joined = F.array_join(F.filter(items, lambda x: x.isNotNull()), ", ")
        return F.left(F.when(value.startswith("["), joined).otherwise(text), F.lit(chars))

    own = F.map_filter("props", lambda k, v: ~k.isin(SYSTEM_PROPS))
    entries = F.array_sort(F.map_entries(F.transform_values(own, lambda k, v: shown(v))))
    rows = nodes.select("id", F.filter(entries, lambda e: e["value"].isNotNull() & (e["value"] != "")).alias("e"))
    return rows.select("id", F.map_from_entries(F.slice("e", 1, most)).alias("facts"), F.greatest(F.size("e") - most, F.lit(0)).alias("omitted"))


def display_name(nodes: DataFrame) -> Column:
    texts = [F.nullif(trim_space(F.col("props")[k]), F.lit("")) for k in ("name", "title", "label")]
    return F.coalesce(*texts, F.col("id").cast("string"))


def search_dim(nodes: DataFrame, term: str) -> DataFrame:
    """Nodes with ``hit``: the term, in lower case, inside name, label and id."""
    text = F.lower(F.concat_ws(" ", display_name(nodes), "label", "id"))
    return nodes.withColumn("hit", text.contains(term.lower()))


def tooltip(props: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(props)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def clamp(value: int | float | None, default: int, most: int) -> int:
    """A limit as the API takes it: whole, at least 1, at most ``most``."""
    return max(1, min(int(value), most)) if isinstance(value, (int, float)) and value == value else default
