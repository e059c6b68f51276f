"""Benchmark items inside documents: size-partitioned MinHash containment search.

Items are partitioned by their number of shingles. An item's MinHash sketch is
the least hash values of its shingle set; its length follows from the size
class: of n shingles a containing document may lack n - ceil(0.8 n), so one more
than the class's largest such number cannot all be missing. The search therefore
finds every document that contains an item to 0.8 or more, however long the
document is, and compares only documents that hold a sketch value of the item
and are large enough for its class. Documents are probed with all their
shingles: a sketch of a long document would not hold a short item's (20
shingles in 20,000 have a similarity of 0.001). Each candidate is then verified
on the shingles' text itself. DataFrame functions only.

The sketches are broadcast up to ``BROADCAST_ROWS`` rows (a few tens of MB), and
joined by a shuffle of hashes and row keys beyond that; the results are the
same. Texts are joined to the candidates only, once.

Results: words are ``[^\\x20\\x09-\\x0D]+`` in lower case, a shingle is five
words, a text of one to four words is one shingle as a whole; null, empty and
word-free texts contain nothing and are contained nowhere. Rows with equal
doc_id (null ones too) and text give one result for each item; empty tables give
an empty one; columns besides the two named of each table are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W

SHINGLE, PERCENT = 5, 80
#: Sketch rows (hash, item, size: some 40 bytes each in memory) that may be broadcast.
BROADCAST_ROWS = 1_000_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), "")


def bound(value: Column, of) -> Column:
    """``of`` a lambda's variable that stands for the value: else the optimizer would compute it again at each use."""
    return F.element_at(F.transform(F.array(value), of), 1)


def starts(w: Column, n: int) -> Column:
    """Where shingles begin, from 0: at the first word of a shorter text; nowhere without words."""
    return F.when(F.size(w) > 0, F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def hashed(words: Column, n: int) -> Column:
    """A hash of each shingle, from hashes of its words: each word is hashed once."""
    each = F.transform(words, lambda x: F.xxhash64(x))
    return bound(each, lambda h: F.transform(starts(h, n), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(n)))))


def spelled(words: Column, n: int) -> Column:
    return bound(words, lambda w: F.array_distinct(F.transform(starts(w, n), lambda i: F.array_join(F.slice(w, i + 1, n), " "))))


def sketches(items: DataFrame, n: int, percent: int) -> DataFrame:
    """(item_id, need, hash): the least hashes of each item, as many as its size class asks for."""
    sized = items.select("item_id", F.array_sort(F.array_distinct(hashed(words_of(F.col("text")), n))).alias("hashes")).where(F.size("hashes") > 0)
    size = F.size("hashes")
    low = F.pow(F.lit(2.0), F.floor(F.log2(size.cast("double")))).cast("int")
    most_missing = F.floor((2 * low - 1) * (100 - percent) / F.lit(100)).cast("int")
    need = F.ceil(low * percent / F.lit(100)).cast("int")
    return sized.select("item_id", need.alias("need"), F.explode(F.slice("hashes", F.lit(1), most_missing + 1)).alias("hash"))


def contained(docs: DataFrame, items: DataFrame, n: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment, text_key): items that a document contains to ``percent`` or more.

    text_key: xxhash64 of the document's text, which tells rows of one id apart.
    """
    docs = W.id_and_text(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text"))
    items = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).dropDuplicates()
    sketch = sketches(items, n, percent)
    small = sketch.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    sketch = F.broadcast(sketch) if small else sketch
    rows = docs.select("doc_id", "text_key", hashed(words_of(F.col("text")), n).alias("hashes")).select("doc_id", "text_key", F.size("hashes").alias("size"), F.explode("hashes").alias("hash"))
    key = ["doc_id", "text_key", "item_id"]
    pairs = W.stage_table(rows.join(sketch, "hash").where("size >= need").select(*key).distinct(), "candidates").withColumnsRenamed({"doc_id": "of", "text_key": "of_key"})
    texts = docs.join(pairs, docs["doc_id"].eqNullSafe(pairs["of"]) & (docs["text_key"] == pairs["of_key"])).select(*key, "text").dropDuplicates(key)
    own = items.select("item_id", spelled(words_of(F.col("text")), n).alias("own"))
    found = texts.join(own, "item_id").withColumn("n_found", F.size(F.array_intersect(spelled(words_of(F.col("text")), n), "own")))
    found = found.withColumn("n_shingles", F.size("own")).where(100 * F.col("n_found") >= percent * F.col("n_shingles"))
    return found.select("doc_id", "item_id", F.col("n_shingles").cast("long"), F.col("n_found").cast("long"), (F.col("n_found") / F.col("n_shingles")).alias("containment"), "text_key")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark items in all documents."""
    return contained(W.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text_key")


def _sql_shingles(table: str, key: str) -> str:
    return f"""SELECT DISTINCT {key}, array_to_string(list_slice(w, i, i + {SHINGLE - 1}), ' ') AS s
  FROM (SELECT {key}, w, unnest(generate_series(1, greatest(len(w) - {SHINGLE - 1}, 1))) AS i
    FROM (SELECT {key}, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {table}) WHERE len(w) > 0)"""


ORACLE_SQL = {
    "op6_decontaminate": f"""
WITH d AS ({_sql_shingles("documents", "doc_id")}), b AS ({_sql_shingles("benchmark", "item_id")}),
n AS (SELECT item_id, count(*) AS n_shingles FROM b GROUP BY item_id),
f AS (SELECT doc_id, item_id, count(*) AS n_found FROM d JOIN b USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shingles, n_found, n_found / n_shingles AS containment FROM f JOIN n USING (item_id) WHERE 100 * n_found >= {PERCENT} * n_shingles
"""
}
