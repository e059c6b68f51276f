"""Removal of word passages that repeat, by prefix-partitioned suffix trees.

A passage repeats if the corpus's suffix tree has an inner node ``WINDOW`` words
deep or deeper above it. The tree is built in parts, each holding the suffixes
below some prefixes:

1. A suffix (a window start) is filed under its *anchor*: the least-hashed run
   of ``GRAM`` words among those in its window. The words from the suffix's
   start through the anchor are its prefix, of variable length. Equal windows
   have equal prefixes, so they are always filed together; one row stands for
   all suffixes in a text that share an anchor, about one word in ten.
2. Anchors are counted (pre-aggregated before the shuffle). An anchor that
   occurs once heads a part with single leaves only, and is dropped.
3. The suffixes of every other anchor are read from the texts again, as the
   stretch of words that they cover. Parts of up to ``PART`` anchors fit in
   memory: their suffixes are ordered by their words (ranks of 3, 9, 27 and 35
   words, or 2, 4, 8 and on in very large parts, each from the one before), and neighbours whose common prefix has 35
   words are leaves of one deep node. For larger parts the prefix is drawn out
   to all 35 words; each node is then a part of its own, of which only the
   number of leaves counts, again pre-aggregated, under 128 bits of its words' hash.

Words themselves are compared, hashes only choose anchors, but for the nodes of
those larger parts. All counts cover all rows; nothing is sampled or capped.

Results: every word covered by a window whose word sequence also starts
elsewhere - in another row or in the same one - is removed, judged on the input.
Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Texts of under 35 words, null and
empty texts lose nothing; rows repeated as a whole repeat each other's passages;
an empty table gives an empty table; columns besides the two named are not read.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W

WINDOW, GRAM = 35, 16
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Anchors of one part that a task holds at once, each with 35 to 54 words; rows that a task orders at once besides.
PART, ROWS = 65_536, 16_384

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Step:
    """The windows of several texts: start, anchor place, anchor hash and text number of each."""

    def __init__(self, texts: list[bytes], window: int, gram: int):
        split = [t.split() for t in texts]
        size = np.fromiter(map(len, split), np.int64, len(split))
        self.offset = np.cumsum(size) - size
        begins = [np.arange(o, o + n - window + 1) for o, n in zip(self.offset.tolist(), size.tolist(), strict=True) if n >= window]
        self.text = np.repeat(np.arange(len(texts)), np.maximum(size - window + 1, 0))
        self.words = list(chain.from_iterable(split))
        if not begins:
            self.start = self.anchor = self.anchor_hash = np.empty(0, np.int64)
            return
        self.start = np.concatenate(begins)
        h = W.word_hashes(self.words)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers(BASE, len(h)))])
        back = powers(INVERSE, len(h))
        grams = W.mix64((sums[gram:] - sums[:-gram]) * back[: len(h) - gram + 1])
        self.anchor = np.empty(len(self.start), np.int64)
        views = sliding_window_view(grams, window - gram + 1)
        for a in range(0, len(self.start), 50_000):
            s = self.start[a : a + 50_000]
            self.anchor[a : a + 50_000] = s + views[s].argmin(1)
        self.anchor_hash = grams[self.anchor].view(np.int64)
        self.start = self.start - self.offset[self.text]
        self.anchor = self.anchor - self.offset[self.text]

    def runs(self) -> np.ndarray:
        """Where the windows of a new anchor begin."""
        new = np.ones(len(self.text), bool)
        new[1:] = (self.text[1:] != self.text[:-1]) | (self.anchor[1:] != self.anchor[:-1])
        return np.flatnonzero(new)


KEY = [pa.field("doc_id", pa.int64()), pa.field("text_key", pa.int64())]


def anchors(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(doc_id, text_key, place, anchor): every anchor of every text."""
    out = pa.schema([*KEY, ("place", pa.int32()), ("anchor", pa.int64())])

    def run(batches):
        for batch in batches:
            texts = W.texts_of(batch["text"])
            for a, b in W.steps(texts):
                step = Step(texts[a:b], window, gram)
                at = step.runs()
                of = pa.array(step.text[at] + a)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].take(of), batch["text_key"].take(of), pa.array(step.anchor[at].astype(np.int32)), pa.array(step.anchor_hash[at])], schema=out)

    return docs.mapInArrow(run, "doc_id long, text_key long, place int, anchor long")


def suffixes(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(doc_id, text_key, start, anchor, large, stretch): the words of all suffixes of each anchor in ``places`` or ``large_places``."""
    out = pa.schema([*KEY, ("start", pa.int32()), ("anchor", pa.int64()), ("large", pa.bool_()), ("stretch", pa.binary())])

    def run(batches):
        for batch in batches:
            texts, places, large = W.texts_of(batch["text"]), batch["places"].to_pylist(), batch["large_places"].to_pylist()
            for a, b in W.steps(texts):
                step = Step(texts[a:b], window, gram)
                at = step.runs()
                ends = np.append(at[1:], len(step.text))
                some, many = ({(i, p) for i, ps in enumerate(x[a:b]) for p in ps} for x in (places, large))
                pairs = list(zip(step.text[at].tolist(), step.anchor[at].tolist(), strict=True)) if len(at) else []
                rows = [k for k, pair in enumerate(pairs) if pair in some or pair in many]
                big = [pairs[k] in many for k in rows]
                first = at[rows] if rows else at[:0]
                begin = (step.start[first] + step.offset[step.text[first]]).tolist()
                stretches = [b" ".join(step.words[i : i + int(ends[k] - at[k]) + window - 1]) for i, k in zip(begin, rows, strict=True)]
                of = pa.array(step.text[first] + a if rows else [], pa.int64())
                yield pa.RecordBatch.from_arrays([batch["doc_id"].take(of), batch["text_key"].take(of), pa.array(step.start[first].astype(np.int32)), pa.array(step.anchor_hash[first]), pa.array(big, pa.bool_()), pa.array(stretches, pa.binary())], schema=out)

    return docs.mapInArrow(run, "doc_id long, text_key long, start int, anchor long, large boolean, stretch binary")


SPANS = "doc_id long, text_key long, start int, length int"


def ranked(keys: np.ndarray) -> np.ndarray:
    """The place of each key among the distinct ones, in order."""
    order = keys.argsort()
    new = np.ones(len(keys), bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def window_ranks(words: list[bytes], at: np.ndarray, window: int) -> np.ndarray:
    """For each place in ``at`` the rank, by its words, of the window of words that begins there."""
    number = {w: i for i, w in enumerate(sorted({*words}))}
    rank = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    # As many ranks as fit make one sort key.
    fold, bits, span = (3, 21, 1) if len(words) < 1 << 21 else (2, 31, 1)
    while fold * span <= window:
        wide = np.zeros(len(rank) + (fold - 1) * span, np.int64)  # places behind the end belong to no window
        wide[: len(rank)] = rank
        keys = rank
        for k in range(1, fold):
            keys = (keys << bits) | wide[k * span : k * span + len(rank)]
        rank = ranked(keys)
        span *= fold
    keys = np.zeros(len(at), np.int64)
    for i in [*range(0, window - span, span), window - span]:
        keys = ranked((keys << bits) | rank[at + i])
    return keys


def deep_nodes(rows: DataFrame, window: int) -> DataFrame:
    """Spans of window starts that are leaves of deep nodes; rows are dealt and sorted by anchor."""
    out = pa.schema([*KEY, ("start", pa.int32()), ("length", pa.int32())])

    def leaves(part: pa.Table) -> pa.RecordBatch:
        """part: whole groups of anchors."""
        stretches = part["stretch"].to_pylist()
        size = np.fromiter((x.count(b" ") + 1 for x in stretches), np.int64, len(part))
        counts = size - (window - 1)
        row = np.repeat(np.arange(len(part)), counts)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        key = window_ranks(b" ".join(stretches).split(b" "), (np.cumsum(size) - size)[row] + inside, window)
        start = part["start"].to_numpy()[row] + inside
        leaf = np.bincount(key)[key] > 1
        at = np.flatnonzero(leaf)
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])
        first = np.flatnonzero(new)
        length = np.diff(np.append(first, len(at)))
        of = pa.array(row[at[first]])
        columns = [part["doc_id"].combine_chunks().take(of), part["text_key"].combine_chunks().take(of), pa.array(start[at[first]].astype(np.int32)), pa.array(length.astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, schema=out)

    def run(batches):
        held = None
        for batch in batches:
            for a in range(0, len(batch), ROWS // 4):
                table = pa.Table.from_batches([batch.slice(a, ROWS // 4)])
                held = table if held is None else pa.concat_tables([held, table])
                edges = np.flatnonzero(np.diff(held["anchor"].to_numpy())) + 1
                if len(held) >= ROWS and len(edges):
                    yield leaves(held.slice(0, int(edges[-1])))
                    held = held.slice(int(edges[-1]))
        if held is not None and len(held):
            yield leaves(held)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "anchor").sortWithinPartitions("anchor").mapInArrow(run, SPANS)


def large_nodes(rows: DataFrame, window: int) -> DataFrame:
    """The same for anchors of large parts: one node a window, and only its number of leaves is gathered."""
    out = pa.schema([*KEY, ("start", pa.int32()), ("node", pa.binary())])

    def run(batches):
        for batch in batches:
            for a in range(0, len(batch), 5000):
                part = batch.slice(a, 5000)
                split = [x.split(b" ") for x in part["stretch"].to_pylist()]
                counts = np.fromiter((len(x) - window + 1 for x in split), np.int64, len(split))
                row = np.repeat(np.arange(len(part)), counts)
                start = part["start"].to_numpy()[row] + np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                nodes = [xxhash.xxh3_128_digest(b" ".join(x[i : i + window])) for x in split for i in range(len(x) - window + 1)]
                of = pa.array(row)
                yield pa.RecordBatch.from_arrays([part["doc_id"].take(of), part["text_key"].take(of), pa.array(start.astype(np.int32)), pa.array(nodes, pa.binary())], schema=out)

    windows = rows.mapInArrow(run, "doc_id long, text_key long, start int, node binary")
    nodes = W.stage_table(windows.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node"), "large-nodes")
    return windows.join(nodes, "node", "left_semi").select("doc_id", "text_key", "start", F.lit(1).alias("length"))


def repeats(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(doc_id, text_key, spans): for each text with repeats the runs of window starts that repeat."""
    found = W.stage_table(anchors(docs, window, gram), "anchors")
    counts = found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor", (F.col("n") > PART).alias("large"))
    # As a table, so that the join's two shuffles are plain ones and frequent anchors can be split.
    counts = W.stage_table(counts, "repeated-anchors")
    kept = found.join(counts, "anchor").groupBy("doc_id", "text_key").agg(
        F.collect_set(F.when(~F.col("large"), F.col("place"))).alias("places"), F.collect_set(F.when(F.col("large"), F.col("place"))).alias("large_places")
    )
    texts = docs.join(kept, same_row(docs, kept)).select(docs["doc_id"], docs["text_key"], "text", "places", "large_places")
    rows = W.stage_table(suffixes(texts, window, gram), "suffixes")
    W.drop_stage(found)
    spans = deep_nodes(rows.where("not large"), window).unionByName(large_nodes(rows.where("large"), window))
    spans = W.stage_table(spans.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "length")).alias("spans")), "spans")
    W.drop_stage(rows, counts)
    return spans


def same_row(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_key"] == b["text_key"])


def without(text: bytes, keep: np.ndarray, as_is: bool) -> bytes:
    """The text's words that are kept: joined by one space, or with the white space that stands before and between them."""
    if not as_is:
        return b" ".join(w for w, k in zip(text.split(), keep.tolist(), strict=True) if k)
    if keep.all():
        return text
    edges = [m.span() for m in WORD.finditer(text)]
    runs = np.flatnonzero(np.diff(np.concatenate([[False], keep, [False]]).astype(np.int8)))
    out = [text[: edges[0][0]]] if keep[0] else []
    for first, end in zip(runs[::2].tolist(), runs[1::2].tolist(), strict=True):
        out += [text[edges[first - 1][1] : edges[first][0]] if out and first else b"", text[edges[first][0] : edges[end - 1][1]]]
    return b"".join([*out, text[edges[-1][1] :] if keep[-1] else b""])


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", as_is: bool = False) -> DataFrame:
    """(row, text, n_words, n_removed) per row; row: all other columns, text: the kept words joined by one space.

    ``as_is``: with the text's own white space, so that a text without repeats (or a null) stays byte for byte.
    """
    named = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col)).alias("row")
    whole = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), named)
    whole = whole.withColumn("text_key", F.xxhash64("text"))
    spans = repeats(whole.select("doc_id", "text", "text_key"), window, gram)
    rows = whole.join(spans, same_row(whole, spans), "left").select("row", "text", F.col("spans.start").alias("starts"), F.col("spans.length").alias("lengths"))

    def run(batches):
        for batch in batches:
            for a in range(0, len(batch), 1000):
                part = batch.slice(a, 1000)
                texts, n_words, n_removed = [], [], []
                for text, null, starts, lengths in zip(W.texts_of(part["text"]), part["text"].is_null().to_pylist(), part["starts"].to_pylist(), part["lengths"].to_pylist(), strict=True):
                    n = len(text.split())
                    keep = np.ones(n, bool)
                    if starts:
                        edge = np.zeros(n + 1, np.int32)
                        first, size = np.array(starts), np.array(lengths)
                        np.add.at(edge, first, 1)
                        np.subtract.at(edge, first + size + window - 1, 1)
                        keep = np.cumsum(edge[:-1]) == 0
                    n_words.append(n)
                    n_removed.append(n - int(keep.sum()))
                    texts.append(None if null and as_is else without(text, keep, as_is))
                columns = [part["row"], pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "text", "n_words", "n_removed"])

    schema = T.StructType([whole.schema["row"], T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    return rows.mapInArrow(run, schema)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to repeated passages of 35 words, and a digest of what it keeps."""
    got = remove_repeats(W.documents(spark, sf_dir).select("doc_id", "text"))
    return got.select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
