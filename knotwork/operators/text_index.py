"""The full-text and gram index of a build: made once, kept with it, read by the buckets that a search asks for."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import written
from .substrings import grams

HANGUL, KANA, HAN = "가-힣", "\\u3040-\\u30FF", "\\u4E00-\\u9FFF"
OTHER = f"[0-9a-z\\p{{L}}&&[^{HANGUL}{KANA}{HAN}]]+"
#: Runs of one script: Hangul, kana, han, or the rest, which a middle dot holds together.
RUN = f"[{HANGUL}]+|[{KANA}]+|[{HAN}]+|{OTHER}(?:·{OTHER})*"
#: Words that the full-text analyzer leaves out.
STOP = "a and are as at be but by for if in into is it no not of on or s such t that the their then there these they this to was will with www".split()
#: Rows of a table that one bucket holds, or so; and the most buckets.
BUCKET_ROWS, MOST_BUCKETS = 200_000, 4096


def tokens(text: Column) -> Column:
    """Words of lower-cased text; runs of Hangul, kana or han, also inside a mixed word, become overlapping pairs."""
    words = F.filter(F.regexp_extract_all(text, F.lit(RUN), 0), lambda w: ~w.isin(STOP))
    pairs = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, F.lit(2)))
    return F.flatten(F.transform(words, lambda w: F.when(w.rlike(f"^[{HANGUL}{KANA}{HAN}]{{2,}}$"), pairs(w)).otherwise(F.array(w))))


@dataclass
class Bucketed:
    """A table whose folder is parted by a hash of ``key``; ``buckets`` 0: one that isn't."""

    table: DataFrame
    key: str
    buckets: int = 0

    def of(self, asked: DataFrame, column: str | None = None) -> DataFrame:
        """The buckets that hold the asked keys. At most ``buckets`` numbers come to the driver, as a filter on folders."""
        if not self.buckets:
            return self.table
        return self.parts(r.b for r in asked.select(self.part(column).alias("b")).distinct().collect())

    def part(self, column: str | None = None) -> Column:
        """The bucket of a key; 0 where there are none."""
        return bucket(F.col(column or self.key), self.buckets) if self.buckets else F.lit(0)

    def parts(self, found: Iterable[int | None]) -> DataFrame:
        """The buckets of these numbers."""
        if not self.buckets:
            return self.table
        wanted = sorted({b for b in found if b is not None})
        return self.table.where(F.col("bucket").isin(wanted)).drop("bucket") if wanted else self.table.limit(0).drop("bucket")

    def all(self) -> DataFrame:
        return self.table.drop("bucket") if self.buckets else self.table


def bucket(key: Column, buckets: int) -> Column:
    return F.when(key.isNotNull(), F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def write_bucketed(df: DataFrame, path: str, key: str, rows: int) -> None:
    """``df`` by buckets of ``key``, sorted by it; large buckets are written by several tasks. Rows without a key are left out."""
    buckets = 8
    while buckets < MOST_BUCKETS and rows > buckets * BUCKET_ROWS:
        buckets *= 2
    dealt = df.where(F.col(key).isNotNull()).withColumn("bucket", bucket(F.col(key), buckets)).hint("rebalance", "bucket")
    dealt.sortWithinPartitions("bucket", key).write.partitionBy("bucket").parquet(f"{path}/buckets={buckets}")


def read_bucketed(spark: SparkSession, path: str, key: str, schema: str) -> Bucketed:
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [s.getPath().getName() for s in fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(fs_path)]
    (name,) = [n for n in names if n.startswith("buckets=")]
    return Bucketed(spark.read.schema(f"{schema}, bucket int").parquet(f"{path}/{name}"), key, int(name.split("=")[1]))


@dataclass
class Index:
    """postings(token, kgid, tf, dl), counts(token, df), grams(gram, name_key), gram_counts(gram, n), names(name_key, kgid, label, name).

    corpus: one row (n_docs, avgdl, longest).
    """

    postings: Bucketed
    counts: Bucketed
    corpus: DataFrame
    grams: Bucketed | None = None
    gram_counts: Bucketed | None = None
    names: Bucketed | None = None


TABLES = {
    "postings": ("token", "token string, kgid string, tf long, dl int"),
    "counts": ("token", "token string, df long"),
    "grams": ("gram", "gram string, name_key string"),
    "gram_counts": ("gram", "gram string, n long"),
    "names": ("name_key", "name_key string, kgid string, label string, name string"),
}
CORPUS = "n_docs long, avgdl double, longest int"


def posted(nodes: DataFrame) -> DataFrame:
    docs = nodes.where("kgid is not null").select("kgid", tokens(F.col("name_key")).alias("tokens")).withColumn("dl", F.size("tokens"))
    return docs.select("kgid", "dl", F.explode("tokens").alias("token")).groupBy("token", "kgid").agg(F.count("*").alias("tf"), F.max("dl").alias("dl"))


def corpus_row(nodes: DataFrame) -> DataFrame:
    return nodes.where("kgid is not null").agg(F.count("*").alias("n_docs"), F.avg(F.size(tokens(F.col("name_key")))).alias("avgdl"), F.max(F.length("name_key")).alias("longest"))


def build_index(nodes: DataFrame) -> Index:
    """The full-text part alone, for a graph that is searched once."""
    postings = written(posted(nodes), "postings")
    return Index(Bucketed(postings, "token"), Bucketed(postings.groupBy("token").agg(F.count("*").alias("df")), "token"), written(corpus_row(nodes), "corpus"))


def write_index(nodes: DataFrame, path: str) -> None:
    """All tables of the index below ``path``. ``nodes`` is read several times: a written table."""
    spark = nodes.sparkSession
    corpus_row(nodes).coalesce(1).write.parquet(f"{path}/corpus")
    rows = spark.read.schema(CORPUS).parquet(f"{path}/corpus").first()
    held = nodes.where("kgid is not null")
    put = {
        "names": (held.select("name_key", "kgid", "label", "name"), rows.n_docs),
        "postings": (posted(nodes), int(rows.n_docs * (rows.avgdl or 0))),
        "grams": (held.select("name_key").distinct().select(F.explode(grams(F.col("name_key"))).alias("gram"), "name_key"), rows.n_docs * 3 * (rows.longest or 0)),
    }
    for name, (df, n) in put.items():
        write_bucketed(df, f"{path}/{name}", TABLES[name][0], n)
    for name, of, n in (("counts", "postings", "df"), ("gram_counts", "grams", "n")):
        key, schema = TABLES[of]
        counted = read_bucketed(spark, f"{path}/{of}", key, schema).all().groupBy(key).agg(F.count("*").alias(n))
        write_bucketed(counted, f"{path}/{name}", key, put[of][1] // 4)


def read_index(spark: SparkSession, path: str) -> Index:
    parts = {name: read_bucketed(spark, f"{path}/{name}", key, schema) for name, (key, schema) in TABLES.items()}
    return Index(corpus=spark.read.schema(CORPUS).parquet(f"{path}/corpus"), **parts)
