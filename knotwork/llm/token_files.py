"""Token ids as Arrow stream files with fixed-size-list batches.

A file holds two Arrow streams, one behind the other:

1. ``ids fixed_size_list<uint16 or uint32>[L], mask fixed_size_list<bool>[L]``:
   equal-length sequences; the mask is false on the padding behind a file's last id.
2. ``doc_id int64, start int64, n_tokens int64``: which ids of this file each
   document owns (start counts from the file's first id).

Buffers are not compressed, so a memory map gives any sequence without copying
(:class:`TokenFile`). Files hold whole documents in ascending doc_id order and
are cut at about ``file_bytes``; file names sort in that order too. Ids take 16
bits where the vocabulary allows it.

Each task writes its own range of doc_ids. A file is written under an attempt's
name and then renamed, and its content depends only on its rows, so a task that
runs again after a lost executor replaces what it wrote before.

Results: null and empty texts own the end id only; repeated rows are written
each; rows with a null doc_id come first; an empty table gives no files and no
rows; columns besides the two named are not read.
"""

from __future__ import annotations

import uuid
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as W
from .bpe import load, lower_ascii, tokenizer_path

SEQUENCE = 2048
FILE_BYTES = 16 << 20
MANIFEST = "shard int, file int, path string, docs long, tokens long, sequences long"


def file_system(url: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(url)


@lru_cache(2)
def library_memo(path: str) -> W.WordMemo:
    """Ids from the tokenizers library, asked once for each white-space-free word that a worker meets.

    No piece crosses white space, so a text's ids are its words' ids in turn.
    The file must mark the last id of each piece with ``</w>``, as word-end vocabularies do.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    own = load(path)
    ends = np.array([t.endswith("</w>") for t in own.tokens])

    def each(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(lens.sum())), lens

    def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Many words as one text for the library; their pieces' last ids tell where each word's ids end."""
        flat, lens = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for at in range(0, len(words), 5000):
            text = b"\n".join(words[at : at + 5000]).decode("utf-8", "replace")
            pieces = np.array(own.piece_counts(text))
            ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            last = np.concatenate([[0], np.flatnonzero(ends[ids]) + 1])
            if len(last) - 1 == pieces.sum() and last[-1] == len(ids) and not own.specials.search(text):
                flat.append(ids)
                lens.append(np.diff(last[np.concatenate([[0], np.cumsum(pieces)])]))
            else:
                for have, got in zip((flat, lens), each(text.split("\n")), strict=True):
                    have.append(got)
        return np.concatenate(flat), np.concatenate(lens)

    return W.WordMemo(encode, prepare=lower_ascii)


class FileWriter:
    """Gathers whole documents and writes a file whenever enough ids are held."""

    def __init__(self, base: str, shard: int, sequence: int, width: type, file_bytes: int):
        self.fs, self.root = file_system(base)
        self.base, self.shard, self.sequence, self.width, self.limit = base, shard, sequence, width, file_bytes // width().itemsize
        self.file, self.held = 0, 0
        self.ids: list[np.ndarray] = []
        self.docs: list[int | None] = []
        self.lens: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> bool:
        """Whether the file is now large enough to be written."""
        self.ids.append(ids.astype(self.width))
        self.docs.append(doc_id)
        self.lens.append(len(ids))
        self.held += len(ids)
        return self.held >= self.limit

    def write(self) -> tuple:
        rows = -(-self.held // self.sequence)
        flat = np.zeros(rows * self.sequence, self.width)
        np.concatenate(self.ids, out=flat[: self.held])
        mask = np.arange(len(flat)) < self.held
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.sequence) for x in (flat, mask)]
        batch = pa.record_batch(columns, names=["ids", "mask"])
        lens = np.array(self.lens, np.int64)
        index = pa.record_batch([pa.array(self.docs, pa.int64()), pa.array(np.cumsum(lens) - lens), pa.array(lens)], names=["doc_id", "start", "n_tokens"])
        name = f"shard-{self.shard:06d}-{self.file:06d}.arrows"
        part = f"{self.root}/.{name}.{uuid.uuid4().hex}"
        self.fs.create_dir(self.root, recursive=True)
        with self.fs.open_output_stream(part) as out:
            for x in (batch, index):
                with pa.ipc.new_stream(out, x.schema) as stream:
                    stream.write_batch(x)
        final = f"{self.root}/{name}"
        try:
            self.fs.move(part, final)
        except OSError:  # stores that don't rename over an earlier attempt's file
            self.fs.delete_file(final)
            self.fs.move(part, final)
        row = (self.shard, self.file, f"{self.base}/{name}", len(lens), self.held, rows)
        self.file, self.held, self.ids, self.docs, self.lens = self.file + 1, 0, [], [], []
        return row


class TokenFile:
    """Random access to one file; arrays are views on its (mapped) buffer."""

    def __init__(self, url: str):
        files, path = file_system(url)
        self.buffer = pa.memory_map(path).read_buffer() if files.type_name == "local" else files.open_input_file(path).read_buffer()
        source = pa.BufferReader(self.buffer)
        self.batches = pa.ipc.open_stream(source).read_all().to_batches()
        self.index = pa.ipc.open_stream(source).read_all()
        self.first = np.cumsum([0, *(b.num_rows for b in self.batches)])

    def __len__(self) -> int:
        return int(self.first[-1])

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """The i-th sequence's ids and mask, without a copy."""
        k = int(np.searchsorted(self.first, i, "right")) - 1
        ids, mask = (self.batches[k].column(c)[i - int(self.first[k])].values for c in ("ids", "mask"))
        return ids.to_numpy(zero_copy_only=True), mask

    def tokens(self) -> np.ndarray:
        """All ids but the padding; without a copy if the file has one batch."""
        flat = [b.column("ids").flatten().to_numpy(zero_copy_only=True) for b in self.batches]
        n = sum(b.column("mask").flatten().true_count for b in self.batches)
        return (flat[0] if len(flat) == 1 else np.concatenate(flat) if flat else np.empty(0, np.uint16))[:n]

    def documents(self):
        """(doc_id, start in this file, ids) of each document in turn."""
        ids = self.tokens()
        docs, starts, lens = (self.index.column(c).to_pylist() for c in ("doc_id", "start", "n_tokens"))
        for d, a, n in zip(docs, starts, lens, strict=True):
            yield d, a, ids[a : a + n]


def write(docs: DataFrame, base: str, path: str, end_id: int = 2, shards: int | None = None, sequence: int = SEQUENCE, file_bytes: int = FILE_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and write all documents below ``base``; the manifest, one row a file.

    One shuffle: rows are dealt by ranges of doc_id. The manifest is itself a
    table below ``base``, and only files that it names count.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    width = np.uint16 if max(Tokenizer.from_file(path).get_vocab_size() - 1, end_id) < 1 << 16 else np.uint32

    def run(batches):
        cache, end = library_memo(path), np.array([end_id], np.uint32)
        out = FileWriter(base, TaskContext.get().partitionId(), sequence, width, file_bytes)
        made = []
        for batch in batches:
            ids, texts = batch["doc_id"].to_pylist(), W.texts_of(batch["text"])
            for a, b in W.steps(texts):
                flat, lens = cache.texts(texts[a:b])
                for doc_id, own in zip(ids[a:b], np.split(flat, np.cumsum(lens)[:-1]), strict=True):
                    if out.add(doc_id, np.concatenate([own, end])):
                        made.append(out.write())
        if out.docs:
            made.append(out.write())
        schema = pa.schema([("shard", pa.int32()), ("file", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64()), ("sequences", pa.int64())])
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in made], schema=schema)

    rows = W.id_and_text(docs, id_col, text_col).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(run, MANIFEST).write.parquet(f"{base}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{base}/manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with ``before``: all ids in the files before each file.

    Sums go first over each shard's files, then over the shards (as many as the
    writer's tasks), so no task sees all files.
    """
    inside = Window.partitionBy("shard").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.groupBy("shard").agg(F.sum("tokens").alias("all")).select("shard", F.coalesce(F.sum("all").over(over), F.lit(0)).alias("shard_before"))
    files = manifest.withColumn("in_shard", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    return files.join(shards, "shard").select(*manifest.columns, (F.col("shard_before") + F.col("in_shard")).alias("before"))


def read_digests(manifest: DataFrame) -> DataFrame:
    """Read the files back: per document its start among all ids, its length and the CRC of its ids."""
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        for batch in batches:
            for path, before in zip(batch["path"].to_pylist(), batch["before"].to_pylist(), strict=True):
                rows = [(d, before + a, len(x), zlib.crc32(x.astype("<u4").tobytes())) for d, a, x in TokenFile(path).documents()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), out.types, strict=True)], schema=out)

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return with_starts(manifest).select("path", "before").repartition(n, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and checksum in the token files written from the whole table."""
    base = W.shared_dir(spark, "token-files")
    return read_digests(write(W.documents(spark, sf_dir), base, tokenizer_path()))
