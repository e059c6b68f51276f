"""Shared helpers of the text operators: words, hashes and a bounded word memo.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]`` - exactly what
``bytes.split()`` returns, and in UTF-8 the same as the character rule.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles; longer texts make a step of their own.
STEP_BYTES = 1 << 20

U64 = np.uint64
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which all executors share.

    The setting is read from the session; only where it is unset, and all runs
    in one process (tests), a temporary folder takes its place.
    """
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="knotwork-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    # The table takes the place of the shuffles behind it: their files may go at once.
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_stage(*tables: DataFrame) -> None:
    """Delete the folders of tables that :func:`stage_table` wrote and nothing reads any more."""
    for t in tables:
        jvm = t.sparkSession._jvm
        for f in t.inputFiles()[:1]:
            folder = jvm.org.apache.hadoop.fs.Path(f).getParent()
            folder.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def texts_of(column: pa.Array) -> list[bytes]:
    """The column's UTF-8 texts; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def steps(texts: list[bytes], limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes each."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= limit:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, in place where it can."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, len(words))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, from the words' hashes."""
    if len(h) < n:
        return np.empty(0, U64)
    m = len(h) - n + 1
    out = h[:m].copy()
    for i in range(1, n):
        out = mix64(out * U64(0x9E3779B97F4A7C15)) + h[i : i + m]
    return mix64(out)


class WordMemo:
    """Numbers per word, computed once for each word that a worker meets.

    ``encode`` maps a list of new words to (flat values, lengths). The memo is
    emptied when it holds ``most`` words, so memory stays bounded. ``prepare``
    may change a text before it is split (say, its case).
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int = 600_000, prepare: Callable[[bytes], bytes] = bytes, most_bytes: int = 64 << 20):
        self.encode, self.most, self.prepare, self.most_bytes = encode, most, prepare, most_bytes
        self.clear()

    def clear(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.flat = np.empty(0, np.uint32)  # more room than values, as are the next two
        self.starts, self.lens = np.empty(0, np.int64), np.empty(0, np.int64)
        self.values = self.bytes = 0

    @staticmethod
    def put(room: np.ndarray, at: int, new: np.ndarray) -> np.ndarray:
        """``new`` behind the first ``at`` values; the room doubles where it has to grow."""
        if at + len(new) > len(room):
            room = np.concatenate([room[:at], np.empty(max(at + len(new), 1024), room.dtype)])
        room[at : at + len(new)] = new
        return room

    def lookup(self, words: list[bytes]) -> np.ndarray:
        """The memo's row of each word."""
        if len(self.rows) > self.most or self.bytes > self.most_bytes:
            self.clear()
        got = np.fromiter(map(self.rows.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(got < 0).tolist()
        if missing:
            unknown = [words[i] for i in missing]
            new = list(dict.fromkeys(unknown))
            flat, lens = self.encode(new)
            n = len(self.rows)
            self.starts = self.put(self.starts, n, np.cumsum(lens) - lens + self.values)
            self.lens = self.put(self.lens, n, lens)
            self.flat = self.put(self.flat, self.values, flat)
            self.values += len(flat)
            self.bytes += 4 * len(flat) + sum(map(len, new))
            self.rows.update(zip(new, range(n, n + len(new)), strict=True))
            got[missing] = np.fromiter(map(self.rows.__getitem__, unknown), np.int64, len(unknown))
        return got

    def texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' values in one flat array, and how many each text has."""
        split = [self.prepare(t).split() for t in texts]
        per_text = np.fromiter(map(len, split), np.int64, len(split))
        rows = self.lookup(list(chain.from_iterable(split)))
        lens = self.lens[rows]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.starts[rows] - (ends - lens), lens) + np.arange(total)
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per_text)])]
        return self.flat[at], np.diff(upto)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, so that other columns can bear any name."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
