"""Builds kept between queries: a graph is merged and indexed once, and searched as often as one likes."""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators import search as S
from ..sources import documents
from ..tables import shared_folder
from .sample_graph import sample

TABLES = ("part", "supplier", "nation", "region", "customer", "lineitem")


@dataclass
class Stored:
    nodes: DataFrame
    rels: DataFrame
    index: S.Index
    steps: S.Bucketed


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """Changes whenever a file below the paths is added, removed, or written anew."""
    seen = []
    for path in paths:
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = root.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(root, True)
        while files.hasNext():
            s = files.next()
            seen.append(f"{s.getPath()} {s.getLen()} {s.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()[:24]


def stored_build(spark: SparkSession, sf_dir: str) -> Stored:
    """The build of the tables' graph, from the shared folder; made there first where these files have none yet.

    A build is written under a name of its own and renamed once it is whole, so
    a broken or concurrent one is never read.
    """
    base = shared_folder(spark, "x").rsplit("/", 1)[0]
    path = f"{base}/builds/{fingerprint(spark, [f'{sf_dir}/{t}.parquet' for t in TABLES])}"
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(target):
        own = f"{path}-{uuid.uuid4().hex[:8]}"
        made = sample(spark, sf_dir)
        made.graph_nodes.select("kgid", "label", "name", "name_key").write.parquet(f"{own}/nodes")
        made.graph_rels.select("kgid", "type", "from_kgid", "to_kgid").write.parquet(f"{own}/rels")
        documents.write_search_tables(spark.read.parquet(f"{own}/nodes"), spark.read.parquet(f"{own}/rels"), f"{own}/search")
        if not fs.rename(jvm.org.apache.hadoop.fs.Path(own), target) and not fs.exists(target):
            raise OSError(f"cannot name the build {path}")
    string = "kgid string, {} string, {} string, {} string"
    nodes = spark.read.schema(string.format("label", "name", "name_key")).parquet(f"{path}/nodes")
    rels = spark.read.schema(string.format("type", "from_kgid", "to_kgid")).parquet(f"{path}/rels")
    return Stored(nodes, rels, *documents.read_search_tables(spark, f"{path}/search"))
