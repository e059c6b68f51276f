"""Documents' nodes and relationships merged into one graph.

Inputs: ``nodes(file, input_file, pos, local_id, label, name, props)`` and
``rels(file, input_file, pos, type, start_id, end_id, props)``; props map a name
to the value's JSON text. Order is (file, pos) throughout, so results don't
depend on row order. Every step is an aggregation by a key that pre-aggregates:
what repeats is first counted down to one row a value and file, in hash tables
of fixed width; only what that leaves is put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import ascii_name_key, composed, name_key, nfc, node_kgid, rel_kgid
from ..limits import PAIRS_REPORTED, RESERVED_PROPS
from . import substrings


def order() -> Column:
    """What comes first: by file, then by place in it."""
    return F.struct("file", "pos")


def dictionary_index(entries: DataFrame) -> DataFrame:
    """(label, variant_key, canonical_label, canonical_name) of ``entries(canonical_label, canonical_name, label, name)``; a variant of itself is none."""
    keyed = entries.select("label", name_key(F.col("name")).alias("variant_key"), "canonical_label", nfc(F.col("canonical_name")).alias("canonical_name"), name_key(F.col("canonical_name")).alias("own_key"))
    return keyed.where(~((F.col("label") == F.col("canonical_label")) & (F.col("variant_key") == F.col("own_key")))).drop("own_key").distinct()


def canonicalize(nodes: DataFrame, dictionary: DataFrame | None = None, key=name_key) -> DataFrame:
    """Nodes with canonical label and name, ``changed``, name_key and kgid. The dictionary is small: one broadcast lookup."""
    named = nodes
    if key is name_key:
        named = composed(nodes, "name")
    # Composed by now.
    key = ascii_name_key
    keyed = named.withColumn("variant_key", key(F.col("name")))
    if dictionary is None:
        found = keyed.withColumn("changed", F.lit(False))
    else:
        found = keyed.join(dictionary, ["label", "variant_key"], "left").withColumn("changed", F.col("canonical_name").isNotNull())
        found = found.withColumn("label", F.coalesce("canonical_label", "label")).withColumn("name", F.coalesce("canonical_name", "name")).drop("canonical_label", "canonical_name")
    found = found.withColumn("name_key", F.when(F.col("changed"), key(F.col("name"))).otherwise(F.col("variant_key"))).drop("variant_key")
    return found.withColumn("kgid", node_kgid(F.col("label"), F.col("name_key")))


def merged_nodes(keyed: DataFrame) -> DataFrame:
    """One row a (label, name_key): first name by order, and the sorted sets of files."""
    seen = keyed.groupBy("kgid", "label", "name_key", "name", "file", "input_file").agg(F.min("pos").alias("pos"))
    return seen.groupBy("kgid", "label", "name_key").agg(
        F.min_by("name", order()).alias("name"), F.sort_array(F.collect_set("file")).alias("reviewed_files"), F.sort_array(F.collect_set("input_file")).alias("input_files")
    )


def exploded(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.select(*keys, "file", "pos", F.explode("props").alias("prop", "value"))


def first_values(rows: DataFrame, *keys: str) -> DataFrame:
    """First value by order of each property, for nodes or relationships."""
    values = exploded(rows, *keys)
    return first_of(values.groupBy(*keys, "prop", "value", "file").agg(F.min("pos").alias("pos")), *keys)


def first_of(values: DataFrame, *keys: str) -> DataFrame:
    """The same from one row a value (..., file, pos, prop, value); for values that hardly repeat."""
    return values.where("prop <> 'name'").groupBy(*keys, "prop").agg(F.min_by("value", order()).alias("value"))


def as_map(values: DataFrame, *keys: str) -> DataFrame:
    return values.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("prop", "value")))).alias("props"))


def linked_rels(rels: DataFrame, keyed: DataFrame) -> DataFrame:
    """Relationships with their ends' kgids and their own.

    Nodes are the hashed side of both joins, by parts: the relationships, of
    which there are many more, are neither sorted nor spilled for them. Ends come
    first: relationships point to what fewer names stand for, so that the kgids
    which go through the second shuffle repeat.
    """
    ids = keyed.select("file", "local_id", "kgid").hint("shuffle_hash")
    start = ids.select("file", F.col("local_id").alias("start_id"), F.col("kgid").alias("from_kgid"))
    end = ids.select("file", F.col("local_id").alias("end_id"), F.col("kgid").alias("to_kgid"))
    return rels.join(end, ["file", "end_id"]).join(start, ["file", "start_id"]).withColumn("kgid", rel_kgid(F.col("from_kgid"), F.col("type"), F.col("to_kgid")))


def merged_rels(linked: DataFrame) -> DataFrame:
    merged = linked.groupBy("from_kgid", "type", "to_kgid").agg(
        F.count("*").alias("occurrences"), F.sort_array(F.collect_set("file")).alias("reviewed_files"), F.sort_array(F.collect_set("input_file")).alias("input_files")
    )
    # The id follows from the three: told once for each relationship, not carried by every row.
    return merged.select(rel_kgid(F.col("from_kgid"), F.col("type"), F.col("to_kgid")).alias("kgid"), "*")


def observations(keyed: DataFrame) -> DataFrame:
    """Every distinct value of each node property with its files, first-wins or not."""
    rows = exploded(keyed, "label", "name_key").where(~F.col("prop").isin("name", *RESERVED_PROPS))
    return rows.groupBy("label", "name_key", "prop", "value").agg(F.sort_array(F.collect_set("file")).alias("files"))


def conflicts(observed: DataFrame, applied: DataFrame | None = None) -> DataFrame:
    """Properties with several values that no override settles; values in their order."""
    many = observed.groupBy("label", "name_key", "prop").agg(F.count("*").alias("n_values"), F.sort_array(F.collect_list("value")).alias("vals")).where("n_values > 1")
    return many if applied is None else many.join(applied.select("label", "name_key", "prop"), ["label", "name_key", "prop"], "left_anti")


def conflict_report(found: DataFrame, most: int = PAIRS_REPORTED) -> DataFrame:
    by = [F.collate(F.col(c), "UNICODE") for c in ("label", "name_key", "prop")]
    return found.orderBy(*by).limit(most)


def judge_overrides(overrides: DataFrame, nodes: DataFrame, observed: DataFrame) -> DataFrame:
    """``overrides(label, name_key, prop, value)`` with ``outcome``: an override chooses an observed value, it never invents one."""
    node = nodes.select("label", "name_key", F.lit(True).alias("has_node"))
    prop = observed.select("label", "name_key", "prop").distinct().withColumn("has_prop", F.lit(True))
    value = observed.select("label", "name_key", "prop", "value", F.lit(True).alias("has_value"))
    rows = overrides.join(node, ["label", "name_key"], "left").join(prop, ["label", "name_key", "prop"], "left").join(value, ["label", "name_key", "prop", "value"], "left")
    outcome = F.when(F.col("has_node").isNull(), "no_node").when(F.col("has_prop").isNull(), "no_property").when(F.col("has_value").isNull(), "value_not_observed").otherwise("applied")
    return rows.select("label", "name_key", "prop", "value", outcome.alias("outcome"))


def apply_overrides(values: DataFrame, applied: DataFrame) -> DataFrame:
    """``values(label, name_key, prop, value)`` with the applied overrides' values."""
    chosen = applied.where("outcome = 'applied'").select("label", "name_key", "prop", F.col("value").alias("chosen"))
    return values.join(chosen, ["label", "name_key", "prop"], "left").select("label", "name_key", "prop", F.coalesce("chosen", "value").alias("value"))


def similar_names(nodes: DataFrame) -> DataFrame:
    """Pairs of one label where the shorter name_key (of equally long ones the lesser) lies inside the other: an equi-join over grams."""
    named = nodes.select("label", F.col("name_key").alias("text")).distinct()
    found = substrings.holders(named.withColumnRenamed("text", "needle"), named, "label").withColumnsRenamed({"needle": "a_key", "text": "b_key"})
    return found.where(F.struct(F.length("a_key"), "a_key") < F.struct(F.length("b_key"), "b_key")).select("label", "a_key", "b_key")


def summary(nodes: DataFrame, keyed: DataFrame, graph_nodes: DataFrame, graph_rels: DataFrame) -> DataFrame:
    """One row: files, merges, canonicalised nodes and the graph's size."""
    per_file = keyed.agg(F.count("*").alias("rows"), F.countDistinct("file").alias("files"), F.count_if("changed").alias("canonicalized"))
    counts = graph_nodes.agg(F.count("*").alias("nodes")).crossJoin(graph_rels.agg(F.count("*").alias("rels")))
    return per_file.crossJoin(counts).select("files", "nodes", "rels", F.greatest(F.col("rows") - F.col("nodes"), F.lit(0)).alias("merged"), "canonicalized")


def foreign_rows(nodes: DataFrame) -> DataFrame:
    """Rows without the system's provenance: a rebuild leaves them alone and counts them."""
    return nodes.where(F.col("reviewed_files").isNull() | (F.size("reviewed_files") == 0))


def duplicate_keys(nodes: DataFrame) -> DataFrame:
    """What a uniqueness constraint on (label, name_key) would refuse."""
    return nodes.groupBy("label", "name_key").agg(F.count("*").alias("n")).where("n > 1")


def json_number(value: Column) -> Column:
    return value.cast("string")


def json_string(value: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(value, r'(["\\])', r"\\$1"), F.lit('"'))
