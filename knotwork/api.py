"""The engine's verbs: what a user calls, by name and with the arguments they know.

State is a folder: ``reviewed/`` documents, ``graph/`` builds and tables
``ledger``, ``searches`` and ``aliases``. A verb returns DataFrames; failures of
single rows are columns, failures of a whole verb exceptions.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import limits as L
from .functions import text
from .functions.identity import document_key, sha16
from .functions.schema_text import new_search_id, update
from .operators import filters, graph, search, validate, workflow
from .plans import generate, rebuild
from .plans import search as search_plan
from .sources import documents


@dataclass
class Engine:
    spark: SparkSession
    folder: str

    def _read(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.folder}/{name}")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    # Collection -------------------------------------------------------------------------------------------

    def collect_web(self, start: DataFrame, links: DataFrame, fetch: Callable[[str], str], pages: int = L.CRAWL_PAGES, rules: str | None = None, suffixes: Iterable[str] = text.SECOND_LEVEL) -> DataFrame:
        """Pages from ``start(url)`` over ``links(src, pos, dst)``, breadth first inside each start's domain, with ledger columns.

        ``rules``: robots.txt, where all starts are of one site; ``suffixes``: the lines of a public suffix list.
        """
        canon = start.select(text.normalize_url("url").alias("url")).withColumn("domain", text.registrable_domain("url", suffixes))
        known = links.select(text.normalize_url("src").alias("src"), "pos", text.normalize_url("dst").alias("dst")).withColumn("dst_domain", text.registrable_domain("dst", suffixes))
        ledger = self._read("ledger")
        skip = ledger.where("status = 'collected'").select(F.col("source").alias("url")) if ledger is not None else None
        blocked = ledger.where("status = 'blocked'").select(F.col("source").alias("url")) if ledger is not None else None
        tried = workflow.crawl(canon, known, skip, blocked, pages, text.robots_blocked(rules) if rules else None)
        got = documents.fetched_pages(tried, fetch)
        status = F.when(F.col("error").isNull(), "collected").otherwise("failed")
        return got.withColumn("key", sha16(F.col("url"))).withColumn("status", status).withColumn("quality", text.quality(F.col("markdown")))

    def collect_docs(self, folder: str, extract: Callable[[bytes, str], str]) -> DataFrame:
        """(key, file, kind, text, quality, error) of a folder's PDF and image files, by a plug-in extractor."""
        import pandas as pd

        def run(frames):
            for frame in frames:
                rows = []
                for file, kind, content in frame[["file", "kind", "content"]].itertuples(index=False):
                    try:
                        rows.append((file, kind, content, extract(bytes(content), kind) if kind else None, None if kind else "unsupported"))
                    except Exception as e:  # noqa: BLE001
                        rows.append((file, kind, content, None, str(e)[:200]))
                yield pd.DataFrame(rows, columns=["file", "kind", "content", "text", "error"])

        got = documents.read_binary_folder(self.spark, folder).mapInPandas(run, "file string, kind string, content binary, text string, error string")
        return got.select(document_key(F.col("content")).alias("key"), "file", "kind", "text", text.quality(F.col("text")).alias("quality"), "error")

    def kg_generate(self, inputs: DataFrame, engine: Callable[[str], str], second: Callable[[str], str] | None = None) -> DataFrame:
        """(stem, json, error) of ``inputs(stem, prompt)``: one corrective retry on bad output; one change of engine, with the prompt as it was, where the first is used up. Other failures end a document."""
        import re

        import pandas as pd

        def one(prompt: str) -> tuple[str | None, str | None]:
            engines, asked, error = [e for e in (engine, second) if e], prompt, None
            for attempt in range(3):
                try:
                    raw = engines[0](asked).strip()
                except Exception as e:  # noqa: BLE001
                    error = str(e)[:200]
                    if len(engines) < 2 or not re.search(L.RATE_LIMIT, str(e)):
                        return None, error
                    engines, asked = engines[1:], prompt
                    continue
                fenced = re.search(r"```(?:json)?\s*(.*?)```", raw, re.S)
                body = (fenced[1] if fenced else raw).strip()
                a, b = body.find("{"), body.rfind("}")
                try:
                    if raw.startswith("[") or body.startswith("[") or a < 0:
                        raise ValueError("no single JSON object")
                    json.loads(body[a : b + 1])
                    return body[a : b + 1], None
                except ValueError as e:
                    if error is not None and error.startswith("bad output"):
                        return None, f"bad output: {e}"
                    error = f"bad output: {e}"
                    asked = f"{prompt}\n\n{error}"
            return None, error

        def run(frames):
            for frame in frames:
                got = [one(p) for p in frame["prompt"]]
                yield pd.DataFrame({"stem": frame["stem"], "json": [g[0] for g in got], "error": [g[1] for g in got]})

        return inputs.select("stem", "prompt").mapInPandas(run, "stem string, json string, error string")

    def kg_generate_run(self, inputs: DataFrame, engines: dict[str, Callable[[str], str]], now: datetime, files: DataFrame | None = None, limit: int | None = 1, **options) -> generate.Run:
        """A run over ``inputs(stem, prompt)`` (``files(stem)`` beats ``limit``) whose answers are judged before their one retry; see :func:`generate.run`.

        Documents are appended to ``generated``. New types stay with the result: :meth:`schema_update` registers them.
        """
        got = generate.run(generate.targets(inputs, files, limit), engines, now, version=int(self.schema_get().get("schema_version", 1)), **options)
        got.documents.where("kind is null").select(F.concat("stem", F.lit(".kg.json")).alias("file"), "json", "engine", "n_nodes", "n_rels").write.mode("append").parquet(f"{self.folder}/generated")
        return got

    def schema_get(self) -> dict:
        """The type registry of the highest version; an empty one where there is none yet."""
        try:
            kept = self.spark.read.text(f"{self.folder}/schema", wholetext=True).orderBy(F.desc("version")).first()
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return {}
        return json.loads(kept.value)

    def schema_update(self, operations: list[dict]) -> tuple[dict, list[str]]:
        """The registry after :func:`schema_text.update`, and its warnings. A version is written once: of two updates at a time the later one fails."""
        old = self.schema_get()
        new, warnings = update(old, operations)
        if new != old:
            self.spark.createDataFrame([(json.dumps(new, ensure_ascii=False),)], "value string").coalesce(1).write.text(f"{self.folder}/schema/version={new['schema_version']}", lineSep="\n")
        return new, warnings

    # Review -----------------------------------------------------------------------------------------------

    def review_list(self, generated: DataFrame) -> DataFrame:
        ledger = self._read("ledger")
        return workflow.review_queue(generated, ledger if ledger is not None else self.spark.createDataFrame([], "file string, reject_count int"))

    def review_show(self, docs: DataFrame) -> DataFrame:
        """Errors of documents before anyone is shown them; no rows: all well."""
        nodes, rels = validate.with_defaults(documents.document_nodes(docs)), documents.document_rels(docs)
        return validate.structure(nodes, rels, docs.select("file")).unionByName(validate.schema(nodes, rels, documents.document_meta(docs)))

    def review_approve(self, ledger: DataFrame, files: DataFrame) -> DataFrame:
        return workflow.review(ledger, files.select("file", F.lit(True).alias("approve"), F.lit(None).cast("string").alias("reason")))

    def review_reject(self, ledger: DataFrame, files: DataFrame) -> DataFrame:
        """``files(file, reason)``."""
        return workflow.review(ledger, files.select("file", F.lit(False).alias("approve"), "reason"))

    def kg_rebuild(self, now: datetime, **dictionaries: DataFrame) -> rebuild.Build:
        return rebuild.rebuild(self.spark, f"{self.folder}/reviewed", f"{self.folder}/graph", f"{now:%Y%m%dT%H%M%S}", **dictionaries)

    def source_remove(self, ledger: DataFrame, targets: DataFrame, block: bool = False) -> DataFrame:
        return workflow.remove_sources(ledger, targets, block)

    # Search -----------------------------------------------------------------------------------------------

    def kg_search(self, keywords: list[str], now: datetime, question: str | None = None, hops: int = L.DEFAULT_HOPS, limit_nodes: int | None = None) -> tuple[str, search_plan.Result]:
        """One search; its id and aliases are kept for :meth:`kg_cite`, and the last five searches are listed."""
        if not keywords:
            raise ValueError("give at least one keyword")
        search_id = new_search_id(now)
        rows = [(search_id, i, k, question) for i, k in enumerate(keywords[: L.MAX_KEYWORDS])]
        asked = self.spark.createDataFrame(rows, "search_id string, kw_pos int, keyword string, question string")
        got = search_plan.search(asked, *documents.read_searchable(self.spark, f"{self.folder}/graph"), hops=hops, limit_nodes=limit_nodes)
        ends = got.nodes.select("search_id", "alias", "kgid")
        named = got.rels.join(ends.select("search_id", F.col("alias").alias("from_alias"), F.col("kgid").alias("from_kgid")), ["search_id", "from_alias"]).join(ends.select("search_id", F.col("alias").alias("to_alias"), F.col("kgid").alias("to_kgid")), ["search_id", "to_alias"])
        none = F.lit(None).cast("string")
        aliases = ends.select("search_id", "alias", F.lit("node").alias("kind"), "kgid", none.alias("from_kgid"), none.alias("to_kgid"))
        aliases.unionByName(named.select("search_id", "alias", F.lit("rel").alias("kind"), "kgid", "from_kgid", "to_kgid")).write.mode("append").parquet(f"{self.folder}/aliases")
        self.spark.createDataFrame([(search_id, now, question)], "search_id string, ts timestamp, question string").write.mode("append").parquet(f"{self.folder}/searches")
        return search_id, got

    def kg_cite(self, search_id: str, aliases: list[str]) -> tuple[DataFrame, DataFrame]:
        """Verdict on each alias, and the nodes to light up; these are empty unless the search is the latest."""
        log = search.last_searches(self._read("searches"))
        latest = search.is_latest(log, search_id).first().is_latest
        cited = self.spark.createDataFrame([(search_id, a) for a in aliases], "search_id string, alias string")
        verified = search.verify_citations(cited, self._read("aliases"))
        lit = search.cited_nodes(verified)
        return verified, lit if latest else lit.limit(0)

    def kg_status(self, files: DataFrame) -> DataFrame:
        ledger = self._read("ledger")
        return workflow.status_counts(files, ledger if ledger is not None else self.spark.createDataFrame([], "status string, reject_count int"))

    def view(self, preset: str = "all", nodes: int | None = None, rels: int | None = None) -> tuple[DataFrame, DataFrame]:
        """The viewer's graph under a preset (all, connected) and its limits; relationships with a missing end are left out."""
        if preset not in ("all", "connected"):
            raise ValueError(f"no preset {preset}")
        all_nodes, all_rels = documents.read_graph(self.spark, f"{self.folder}/graph")
        edges = all_rels.select(F.col("kgid").alias("id"), "type", F.col("from_kgid").alias("src"), F.col("to_kgid").alias("dst"), "props")
        points = all_nodes.withColumnRenamed("kgid", "id")
        if preset == "connected":
            points = graph.connected_only(points, edges)
        points = points.orderBy("id").limit(filters.clamp(nodes, L.VIEW_NODES, L.VIEW_NODES_MAX))
        return graph.without_dangling(points, edges.orderBy("id").limit(filters.clamp(rels, L.VIEW_RELS, L.VIEW_RELS_MAX)))
