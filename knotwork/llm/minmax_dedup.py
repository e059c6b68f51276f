"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets.

Under each of ``PERMUTATIONS`` hash functions a document keeps both its least
and its greatest shingle value: two almost independent, unbiased samples for
one evaluation. The values form ``BANDS`` bands of ``ROWS``; documents that
agree on a band share a bucket. A pair of the threshold's similarity 0.8 misses
all buckets with probability (1 - 0.8^4)^40 < 1e-9.

Groups of copies never become all their pairs:

1. Documents with equal shingle sets are one class, named by its least doc_id.
2. Every class is compared with the least class of each of its buckets.
3. Classes that are not yet joined with their bucket's main component are
   compared with one member of that component for each bucket.
4. What is then still apart is compared with all members of the other
   components in its buckets, by tasks of bounded size: blocks of members
   against chunks of those apart. Signatures say which members of a task may
   have a link at all, then the texts of these alone come to the task, which
   gives a spanning forest of the links it finds. A bucket's large main
   component is met as a whole, once and not for each of its buckets. No pair is
   ever a row, and pairs inside one component are never looked at.

Signatures that agree in under ``LEAST_ESTIMATE`` (over 6 standard deviations
below 0.8), or sets whose sizes rule it out, are dropped; all other links are
confirmed on full sets. Many documents apart that share a bucket cost
comparisons by the square inside tasks, rows by the square over ``BLOCK``.

Results: words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; a text with
fewer words than a shingle is one shingle as a whole; null, empty and word-free
texts have 0 shingles and are their own components; rows with one doc_id are
one document, in one component, even if their texts differ; an empty table gives an empty table; columns besides the two
named are not read. Rows with a null doc_id keep a null component.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .components import components

PERMUTATIONS, BANDS, ROWS = 80, 40, 4
PERCENT = 80
LEAST_ESTIMATE = 0.6
#: Members of a bucket that are compared by signature in one block, and documents compared by set.
BLOCK, SET_BLOCK = 1000, 400
#: A bucket's main component of more classes than this is compared once for all its buckets.
LARGE = 48

_random = np.random.default_rng(20_240_229)
FLIP = _random.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)
FACTOR = _random.integers(0, 1 << 31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_set(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes of the text's n-word shingles."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = W.word_hashes(words)
    return np.unique(W.gram_hashes(h, min(n, len(h))))


def signatures_of(sets: list[np.ndarray]) -> np.ndarray:
    """A row of PERMUTATIONS least and as many greatest values for each non-empty set."""
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), 2, PERMUTATIONS), np.uint32)
    for j in range(PERMUTATIONS):
        y = (x ^ FLIP[j]) * FACTOR[j]
        out[:, 0, j] = np.minimum.reduceat(y, starts)
        out[:, 1, j] = np.maximum.reduceat(y, starts)
    return out.reshape(len(sets), 2 * PERMUTATIONS)


def band_hashes(signatures: np.ndarray) -> np.ndarray:
    values = signatures.astype(np.uint64).reshape(len(signatures), BANDS, ROWS)
    h = np.broadcast_to(W.mix64(np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(40)), values.shape[:2]).copy()
    for r in range(ROWS):
        h = W.mix64(h * np.uint64(0x9E3779B97F4A7C15) + values[:, :, r])
    return h.view(np.int64)


def sketch(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, signature) per row; the last two null for empty sets."""
    out = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("signature", pa.binary())])

    def run(batches):
        for batch in batches:
            texts = W.texts_of(batch["text"])
            for a, b in W.steps(texts, W.STEP_BYTES // 2):
                sets = [shingle_set(t, n) for t in texts[a:b]]
                full = [s for s in sets if len(s)]
                signs = iter(signatures_of(full) if full else [])
                rows = [((int(W.mix64(s).sum(dtype=np.uint64)).to_bytes(8, "little") + int(np.bitwise_xor.reduce(W.mix64(s ^ np.uint64(0x5851F42D4C957F2D)))).to_bytes(8, "little")), next(signs).tobytes()) if len(s) else (None, None) for s in sets]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), pa.array(map(len, sets), pa.int64()), *(pa.array(c, pa.binary()) for c in zip(*rows, strict=True))], schema=out)

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, signature binary")


def buckets_of(classes: DataFrame) -> DataFrame:
    """(bucket, id): one row per class and band."""

    def run(batches):
        for batch in batches:
            for a in range(0, len(batch), 2000):
                part = batch.slice(a, 2000)
                signs = np.frombuffer(b"".join(part["signature"].to_pylist()), np.uint32).reshape(len(part), -1)
                ids = np.repeat(part["id"].to_numpy(), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(band_hashes(signs).ravel()), pa.array(ids)], names=["bucket", "id"])

    return classes.select("id", "signature").mapInArrow(run, "bucket long, id long")


def promising(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures and sizes allow the threshold."""
    each = {s: classes.select(F.col("id").alias(s), F.col("n_shingles").alias(f"n_{s}"), F.col("signature").alias(f"s_{s}")) for s in "ab"}
    fits = (100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b"))
    rows = pairs.join(each["a"], "a").join(each["b"], "b").where(fits).select("a", "b", "s_a", "s_b")

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.slice(at, 2000)
                one, two = (np.frombuffer(b"".join(part[c].to_pylist()), np.uint32).reshape(len(part), -1) for c in ("s_a", "s_b"))
                keep = pa.array((one == two).mean(1) >= LEAST_ESTIMATE)
                yield pa.RecordBatch.from_arrays([part[c].filter(keep) for c in "ab"], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def confirm(pairs: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """Pairs (a, b) with ``linked``: whether their full sets reach the threshold."""
    one, two = (docs.select(F.col("doc_id").alias(s), F.col("text").alias(f"t_{s}")) for s in "ab")
    # By the first id, so that a task meets it in a row and hashes it once.
    rows = pairs.join(two, "b").join(one, "a")

    def run(batches):
        known: OrderedDict[int, np.ndarray] = OrderedDict()

        def of(i: int, text: bytes) -> np.ndarray:
            if i not in known:
                known[i] = shingle_set(text, n)
                if len(known) > 64:
                    known.popitem(last=False)
            return known[i]

        for batch in batches:
            a, b, texts = batch["a"].to_pylist(), batch["b"].to_pylist(), [W.texts_of(batch[c]) for c in ("t_a", "t_b")]
            linked = []
            for i, j, s, t in zip(a, b, *texts, strict=True):
                x, y = of(i, s), of(j, t)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return rows.mapInArrow(run, "a long, b long, linked boolean")


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("id <> other").select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def apart(rows: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bucket rows with their component; and the buckets with several, with their main component and its rows."""
    known = rows.join(labels, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("component"))
    known = W.stage_table(known, "bucket-rows")
    parts = known.groupBy("bucket", "component").agg(F.count("*").alias("k"))
    mains = parts.groupBy("bucket").agg(F.max_by("component", "k").alias("main"), F.max("k").alias("of_main"), F.sum("k").alias("n"), F.count("*").alias("parts"))
    return known, W.stage_table(mains.where("parts > 1").drop("parts"), "buckets")


def dealt(rows: DataFrame, key: list[str], sizes: DataFrame) -> DataFrame:
    """Rows of each group (``key``) for tasks of bounded size: (key, block, chunk, side, ...) from (key, outside, ...).

    All members are cut into ``blocks`` and those that ask into ``chunks`` (both
    columns of ``sizes``); a member goes to its block's tasks with each chunk,
    one that asks to its chunk's tasks with each block.
    """
    own = {c: F.pmod(F.xxhash64("id", F.lit(c)), F.col(f"{c}s")).cast("int").alias(c) for c in ("block", "chunk")}
    every = {c: F.explode(F.sequence(F.lit(0), F.col(f"{c}s") - 1)).alias(c) for c in ("block", "chunk")}
    rows = rows.join(sizes, key)
    other = [c for c in rows.columns if c not in ("blocks", "chunks", "outside")]
    held = rows.where("held").select(*other, F.lit(0).alias("side"), own["block"], every["chunk"])
    sent = rows.where("outside").select(*other, F.lit(1).alias("side"), own["chunk"], every["block"])
    return held.unionByName(sent)


def candidates(known: DataFrame, mains: DataFrame, classes: DataFrame) -> DataFrame:
    """(bucket, block, chunk, id, component): the members of a task that signatures allow a link to another component.

    Large main components are left to :func:`links_to_large`. A pair counts in
    its first common band only. Rows are members of tasks, never pairs.
    """
    few = mains.withColumn("others", F.when(F.col("of_main") > LARGE, F.col("n") - F.col("of_main")).otherwise(F.col("n")))
    outside = F.col("component") != F.col("main")
    rows = known.join(few, "bucket").where((F.col("of_main") <= LARGE) | outside & (F.col("others") > 1))
    rows = rows.select("bucket", "id", "component", "main", outside.alias("outside"), F.lit(True).alias("held"))
    sizes = few.select("bucket", F.ceil(F.col("others") / BLOCK).cast("int").alias("blocks"), F.ceil((F.col("n") - F.col("of_main")) / BLOCK).cast("int").alias("chunks"))
    rows = dealt(rows, ["bucket"], sizes).drop("held").join(classes.select("id", "signature", "n_shingles"), "id")
    out = pa.schema([("bucket", pa.int64()), ("block", pa.int32()), ("chunk", pa.int32()), ("id", pa.int64()), ("component", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        side = group["side"].to_numpy()
        signs = np.frombuffer(b"".join(group["signature"].to_pylist()), np.uint32).reshape(len(group), -1)
        hashes = band_hashes(signs)
        ids, parts, size, main = (group[c].to_numpy() for c in ("id", "component", "n_shingles", "main"))
        band = int(np.flatnonzero(hashes[0] == group["bucket"][0].as_py())[0])
        members, chosen = np.flatnonzero(side == 0), np.zeros(len(group), bool)
        for i in np.flatnonzero(side == 1):
            fit = parts[members] != parts[i]
            fit &= 100 * np.minimum(size[members], size[i]) >= PERCENT * np.maximum(size[members], size[i])
            # Two outsiders meet in both directions: only one counts.
            fit &= (parts[members] == main[members]) | (ids[members] > ids[i])
            near = members[fit]
            near = near[(signs[near] == signs[i]).mean(1) >= LEAST_ESTIMATE]
            near = near[(hashes[near] == hashes[i]).argmax(1) == band]
            chosen[near] = True
            chosen[i] = len(near) > 0
        at = np.flatnonzero(chosen)
        at = at[np.unique(ids[at], return_index=True)[1]]
        return group.take(pa.array(at)).select(out.names).cast(out)

    return rows.groupBy("bucket", "block", "chunk").applyInArrow(run, "bucket long, block int, chunk int, id long, component long")


def links_between(asks: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """Links (a, b) on full sets between components that meet in one task of :func:`candidates`.

    A task gives a spanning forest of its links: fewer rows than it has members.
    """
    rows = asks.join(docs.select(F.col("doc_id").alias("id"), "text"), "id")

    def run(group: pa.Table) -> pa.Table:
        ids, parts = group["id"].to_numpy(), group["component"].to_numpy()
        sets = [shingle_set(t, n) for t in W.texts_of(group["text"].combine_chunks())]
        index = Postings(sets)
        a, b = [], []
        for i in range(len(group)):
            near = index.linked(sets[i])
            for j in near[parts[near] != parts[i]].tolist():
                if parts[j] != parts[i]:  # not joined by an earlier link of this task
                    a.append(min(ids[i], ids[j]))
                    b.append(max(ids[i], ids[j]))
                    parts = np.where(parts == parts[j], parts[i], parts)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("bucket", "block", "chunk").applyInArrow(run, "a long, b long")


class Postings:
    """Shingle sets by shingle, to intersect one set with all of them at once."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets])
        values = np.concatenate(sets)
        order = np.argsort(values, kind="stable")
        self.owner = np.repeat(np.arange(len(sets)), self.size)[order]
        self.terms, first = np.unique(values[order], return_index=True)
        self.first = np.append(first, len(values))

    def linked(self, s: np.ndarray) -> np.ndarray:
        """Which of the sets reach the threshold with s."""
        at = np.minimum(np.searchsorted(self.terms, s), len(self.terms) - 1)
        at = at[self.terms[at] == s]
        begin, count = self.first[at], self.first[at + 1] - self.first[at]
        where = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
        both = np.bincount(self.owner[where], minlength=len(self.size))
        return np.flatnonzero(100 * both >= PERCENT * (self.size + len(s) - both))


def links_to_large(known: DataFrame, mains: DataFrame, labels: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """Links (a, b) of classes apart with the large main components of their buckets: one for each task at most."""
    asks = known.join(mains.where(F.col("of_main") > LARGE), "bucket").where("component <> main").select("id", F.col("main").alias("component")).distinct()
    asks = W.stage_table(asks, "asks")
    members = labels.join(asks.select("component").distinct(), "component", "left_semi")
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / SET_BLOCK).cast("int").alias("blocks"))
    sizes = sizes.join(asks.groupBy("component").agg(F.ceil(F.count("*") / SET_BLOCK).cast("int").alias("chunks")), "component")
    rows = members.select("component", "id", F.lit(False).alias("outside")).unionByName(asks.select("component", "id", F.lit(True).alias("outside")))
    rows = dealt(rows.withColumn("held", ~F.col("outside")), ["component"], sizes).drop("held").join(docs.select(F.col("doc_id").alias("id"), "text"), "id")

    def run(group: pa.Table) -> pa.Table:
        side, ids = group["side"].to_numpy(), group["id"].to_numpy()
        sets = [shingle_set(t, n) for t in W.texts_of(group["text"].combine_chunks())]
        held = np.flatnonzero(side == 0)
        a, b = [], []
        if len(held):
            index = Postings([sets[i] for i in held])
            for i in np.flatnonzero(side == 1):
                for j in index.linked(sets[i])[:1]:
                    a.append(min(ids[i], ids[held[j]]))
                    b.append(max(ids[i], ids[held[j]]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("component", "block", "chunk").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row, linking documents of similarity 0.8 or more on n-word shingles."""
    docs = W.id_and_text(docs, id_col, text_col)
    sketches = W.stage_table(sketch(docs, n), "sketches")
    full = sketches.where("set_key is not null and doc_id is not null")
    firsts = full.groupBy("set_key").agg(F.min("doc_id").alias("id"))
    classes = full.join(firsts, "set_key").where("id = doc_id").select("id", "set_key", "n_shingles", "signature").dropDuplicates(["id", "set_key"])
    classes = W.stage_table(classes, "classes")
    rows = buckets_of(classes)
    shared = rows.groupBy("bucket").agg(F.min("id").alias("other"), F.count("*").alias("n")).where("n > 1").select("bucket", "other")
    rows = W.stage_table(rows.join(shared, "bucket").select("bucket", "id", "other"), "bucket-rows")
    # The texts that may have to be compared, as a table: the whole corpus's text is dealt once only.
    texts = W.stage_table(docs.join(rows.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi"), "texts")

    def verdicts(pairs: DataFrame, name: str) -> DataFrame:
        return W.stage_table(confirm(promising(pairs, classes), texts, n), name)

    judged = verdicts(ordered(rows), "judged")
    known, mains = apart(rows, components(judged.where("linked")))
    joined = known.join(mains, "bucket")
    partner = joined.where("component = main").groupBy("bucket").agg(F.min_by("id", F.xxhash64("id", "bucket")).alias("other"))
    more = ordered(joined.where("component <> main").join(partner, "bucket").select("id", "other"))
    judged = judged.unionByName(verdicts(more.join(judged, ["a", "b"], "left_anti"), "judged"))
    labels = components(judged.where("linked"))
    known, mains = apart(rows, labels)
    asks = W.stage_table(candidates(known, mains, classes), "candidates")
    links = judged.where("linked").select("a", "b").unionByName(links_between(asks, texts, n)).unionByName(links_to_large(known, mains, labels, texts, n))
    # Rows of one doc_id with different texts are one document: its classes are joined.
    several = full.groupBy("doc_id").agg(F.min("set_key").alias("least"), F.max("set_key").alias("most")).where("least <> most").select("doc_id")
    links = links.unionByName(full.join(several, "doc_id").join(firsts, "set_key").select(F.col("doc_id").alias("a"), F.col("id").alias("b")).where("a <> b"))

    found = components(links)
    W.drop_stage(classes, rows, texts, known, asks)
    named = firsts.join(found, "id", "left").select("set_key", F.coalesce("component", "id").alias("component_id"))
    whole = sketches.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.coalesce("component_id", "doc_id")
    return whole.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def op4_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents on 2-word shingles."""
    return near_duplicates(W.documents(spark, sf_dir), 2)
