"""The star-schema tables as graph documents, so that every operator has data of any size.

Four documents f0..f3 each name all parts and suppliers; the first also names
nations, regions and customers. Line items are SUPPLIES relationships of the
document that their order falls in. 2,000 parts share 64 names, so nodes merge
and their properties conflict.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import ascii_name_key
from ..operators import merge
from ..tables import written

FILES = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _props(**values: Column) -> Column:
    if not values:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v)))


def document_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    def rows(name: str, key: str, label: str, shown: str, base: int, files: int, **props: Column) -> DataFrame:
        each = F.explode(F.sequence(F.lit(0), F.lit(files - 1)))
        local = F.concat(F.lit(f"{label.lower()}:"), F.col(key))
        return table(spark, sf_dir, name).select(
            each.alias("f"), (F.col(key) + base).cast("long").alias("pos"), local.alias("local_id"), F.lit(label).alias("label"), F.col(shown).alias("name"), _props(**props).alias("props")
        )

    text, number = merge.json_string, merge.json_number
    parts = rows("part", "p_partkey", "Part", "p_name", 0, FILES, brand=text(F.col("p_brand")), type=text(F.col("p_type")), size=number(F.col("p_size")))
    suppliers = rows("supplier", "s_suppkey", "Supplier", "s_name", 10**8, FILES, nation=number(F.col("s_nationkey")))
    nations = rows("nation", "n_nationkey", "Nation", "n_name", 2 * 10**8, 1, region=number(F.col("n_regionkey")))
    regions = rows("region", "r_regionkey", "Region", "r_name", 3 * 10**8, 1)
    customers = rows("customer", "c_custkey", "Customer", "c_name", 4 * 10**8, 1, segment=text(F.col("c_mktsegment")))
    every = parts.unionByName(suppliers).unionByName(nations).unionByName(regions).unionByName(customers)
    return every.select(F.concat(F.lit("f"), "f").alias("file"), F.concat(F.lit("f"), "f", F.lit(".md")).alias("input_file"), "pos", "local_id", "label", "name", "props")


def document_rels(spark: SparkSession, sf_dir: str) -> DataFrame:
    def rows(df: DataFrame, file: Column, pos: Column, kind: str, a: Column, b: Column, **props: Column) -> DataFrame:
        return df.select(file.alias("file"), F.concat(file, F.lit(".md")).alias("input_file"), pos.cast("long").alias("pos"), F.lit(kind).alias("type"), a.alias("start_id"), b.alias("end_id"), _props(**props).alias("props"))

    def at(label: str, key: str) -> Column:
        return F.concat(F.lit(f"{label}:"), F.col(key))

    f0 = F.lit("f0")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    file = F.concat(F.lit("f"), F.pmod("l_orderkey", F.lit(FILES)))
    supplies = rows(items, file, F.col("l_orderkey") * 100 + F.col("l_linenumber"), "SUPPLIES", at("supplier", "l_suppkey"), at("part", "l_partkey"), order=merge.json_number(F.col("l_orderkey")))
    of_supplier = rows(table(spark, sf_dir, "supplier"), f0, F.col("s_suppkey"), "IN_NATION", at("supplier", "s_suppkey"), at("nation", "s_nationkey"))
    of_customer = rows(table(spark, sf_dir, "customer"), f0, F.col("c_custkey"), "IN_NATION", at("customer", "c_custkey"), at("nation", "c_nationkey"))
    of_nation = rows(table(spark, sf_dir, "nation"), f0, F.col("n_nationkey"), "IN_REGION", at("nation", "n_nationkey"), at("region", "n_regionkey"))
    return supplies.unionByName(of_supplier).unionByName(of_customer).unionByName(of_nation)


@dataclass
class Sample:
    """The documents, keyed nodes and merged graph of one scale."""

    nodes: DataFrame
    rels: DataFrame
    keyed: DataFrame

    @property
    def graph_nodes(self) -> DataFrame:
        return merge.merged_nodes(self.keyed)

    @property
    def linked(self) -> DataFrame:
        return merge.linked_rels(self.rels, self.keyed)

    @property
    def graph_rels(self) -> DataFrame:
        return merge.merged_rels(self.linked)

    def stored_nodes(self) -> DataFrame:
        """The merged nodes alone, which is all that finding seeds reads."""
        return written(self.graph_nodes, "graph-nodes")

    def stored(self) -> tuple[DataFrame, DataFrame]:
        """The merged graph as tables, as a rebuild leaves it for searches."""
        return written(self.graph_nodes, "graph-nodes"), written(self.graph_rels, "graph-rels")


def sample(spark: SparkSession, sf_dir: str, dictionary: DataFrame | None = None) -> Sample:
    nodes = document_nodes(spark, sf_dir)
    return Sample(nodes, document_rels(spark, sf_dir), merge.canonicalize(nodes, dictionary, ascii_name_key))
