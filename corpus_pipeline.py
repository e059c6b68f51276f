"""A training corpus from raw documents, in five stages.

Each stage reads all that the one before kept, as a Parquet table in the shared
folder, so a lost executor costs one stage's tasks at most. All but the last
return the columns they are given, whatever the names of those beside doc_id and
text. Every rule and limit is the operator's own; near-duplicates are judged on
five-word shingles here. Null, empty and very long texts and rows without an id
go through all stages; empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm import words as W
from knotwork.llm.bpe import encode, tokenizer_path
from knotwork.llm.decontaminate import contained
from knotwork.llm.minmax_dedup import near_duplicates
from knotwork.llm.substring_dedup import remove_repeats
from knotwork.llm.toxicity import THRESHOLD, Model


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold stay."""
    scored = Model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).score(docs)
    return scored.where(F.col("score") < THRESHOLD).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least doc_id of each group stays.

    Equal rows count once. Of different rows with one doc_id the one of the least
    hash bears it; the others, and rows without an id, are documents of their own
    behind all with ids (in the order of a hash of the row), so that they are
    compared and lost to none but near copies. Empty texts all stay.
    """
    plain = [c for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.xxhash64(*(F.col(f"`{c}`") for c in plain)).alias("hash"))
    rows = rows.withColumn("doc_id", F.col("row.doc_id").cast("long"))
    # As a table: it is small, and so joined without a shuffle of the texts.
    several = W.stage_table(rows.groupBy("doc_id").agg(F.min("hash").alias("least"), F.max("hash").alias("most")).where("doc_id is not null and least <> most").select("doc_id", "least"), "repeated-ids")
    own = F.col("doc_id").isNotNull() & (F.col("least").isNull() | (F.col("least") == F.col("hash")))
    named = rows.join(several, "doc_id", "left").select("row", F.when(own, F.col("doc_id")).otherwise(F.lit(1 << 62) + F.pmod("hash", F.lit(1 << 62))).alias("key"))
    kept = near_duplicates(named.select("key", "row.text"), 5, id_col="key").where("kept").select(F.col("doc_id").alias("key")).distinct()
    return named.join(kept, "key", "left_semi").dropDuplicates(["key"]).select("row.*")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the passages that repeat, and nothing else: white space stays, and texts without repeats as they are. All documents stay."""
    got = remove_repeats(docs, as_is=True)
    changed = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return got.select(*(changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain a benchmark item go, whether they have an id or not; others of the same id stay."""
    found = contained(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("doc_id").alias("found_id"), F.col("text_key").alias("found_key")).distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    same = F.col("row.doc_id").cast("long").eqNullSafe(F.col("found_id")) & (F.xxhash64("row.text") == F.col("found_key"))
    return rows.join(W.stage_table(found, "contaminated"), same, "left_anti").select("row.*")


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) per row; null texts count as empty. ids are little-endian unsigned 32-bit integers, and their text again."""
    return encode(docs, tokenizer_path(), decoded=True)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontaminate", decontaminate),
    ("bpe", bpe),
]

#: Trees, min-max hashes and byte-pair merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = W.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = W.stage_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
