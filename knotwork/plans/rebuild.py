"""The rebuild job: documents in, one verified graph build out."""

from __future__ import annotations

import os
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merge, validate
from ..sources import documents
from ..tables import written


class Refused(ValueError):
    """Documents or dictionaries with errors: nothing was written."""


@contextmanager
def build_lock(path: str):
    """One rebuild at a time on this driver; a lock whose process is gone is taken over once."""
    for attempt in range(2):
        try:
            handle = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
            break
        except FileExistsError:
            with open(path) as f:
                pid = int(f.read() or 0)
            if attempt or (pid and os.path.exists(f"/proc/{pid}")):
                raise RuntimeError(f"a rebuild is running (process {pid})") from None
            os.unlink(path)
    with os.fdopen(handle, "w") as f:
        f.write(str(os.getpid()))
    try:
        yield
    finally:
        os.unlink(path)


@dataclass
class Build:
    nodes: DataFrame
    rels: DataFrame
    observed: DataFrame
    overrides: DataFrame | None
    summary: DataFrame


def build(nodes: DataFrame, rels: DataFrame, dictionary: DataFrame | None = None, overrides: DataFrame | None = None, files: DataFrame | None = None) -> Build:
    """Validate everything, then merge. Errors refuse the whole build before anything is written.

    ``files(file)``: all documents, so that one without nodes is found too.
    """
    errors = validate.structure(nodes, rels, files).unionByName(validate.schema(nodes, rels))
    found = errors.limit(20).collect()
    if found:
        raise Refused("; ".join(f"{e.file} {e.place}: {e.code}" for e in found))
    index = None
    if dictionary is not None:
        wrong = validate.dictionary_problems(dictionary).limit(20).collect()
        if wrong:
            raise Refused("; ".join(f"{p.label}/{p.key}: {p.code}" for p in wrong))
        index = F.broadcast(merge.dictionary_index(dictionary))
    keyed = written(merge.canonicalize(validate.without_reserved(nodes), index), "keyed")
    linked = written(merge.linked_rels(rels, keyed), "linked")
    base, observed = merge.merged_nodes(keyed), merge.observations(keyed)
    values = merge.first_values(keyed, "label", "name_key")
    judged = None
    if overrides is not None:
        wrong = validate.override_problems(overrides).limit(20).collect()
        if wrong:
            raise Refused("; ".join(f"{p.label}/{p.name_key}.{p.prop}: {p.code}" for p in wrong))
        judged = merge.judge_overrides(overrides, base, observed)
        values = merge.apply_overrides(values, judged)
    empty = F.create_map().cast("map<string,string>")
    graph_nodes = base.join(merge.as_map(values, "label", "name_key"), ["label", "name_key"], "left").withColumn("props", F.coalesce("props", empty))
    rel_props = merge.as_map(merge.first_values(linked, "kgid"), "kgid")
    graph_rels = merge.merged_rels(linked).join(rel_props, "kgid", "left").withColumn("props", F.coalesce("props", empty))
    return Build(graph_nodes, graph_rels, observed, judged, merge.summary(base, keyed, graph_nodes, graph_rels))


def rebuild(spark: SparkSession, reviewed: str, target: str, build_id: str, lock: str | None = None, **dictionaries: DataFrame) -> Build:
    """From a folder of approved documents to a build that readers see only once it is verified."""

    def run() -> Build:
        docs = documents.read_graph_files(spark, reviewed)
        bad = docs.where("error is not null").select("file", "error").limit(20).collect()
        if bad:
            raise Refused("; ".join(f"{b.file}: {b.error}" for b in bad))
        made = build(validate.with_defaults(documents.document_nodes(docs)), documents.document_rels(docs), files=docs.select("file"), **dictionaries)
        documents.write_graph(made.nodes, made.rels, target, build_id)
        return made

    if lock is None:
        return run()
    with build_lock(lock):
        return run()


def inject_single(nodes: DataFrame, rels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One document's graph where nothing may merge: two nodes with one key refuse it; repeated relationships count once."""
    keyed = merge.canonicalize(nodes)
    if keyed.groupBy("label", "name_key").count().where("count > 1").limit(1).count():
        raise Refused("two nodes share a label and name")
    return merge.merged_nodes(keyed), merge.merged_rels(merge.linked_rels(rels, keyed))
