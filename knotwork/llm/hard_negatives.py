"""Hard negatives by L2AP-style threshold joins.

For every anchor the nearest rows of its own label are its positives; for each
positive, the best rows of other labels whose score lies in a window below the
positive's are its hard negatives. Scores are inner products of integer vectors.

Rows are dealt to blocks by hash; anchors visit every block, in streams: a task
holds the rows of one block and a few hundred anchors at a time. A block's index
lists rows by runs of dimensions, the strongest first, and leaves out of each
row the last dimensions whose norm, times the largest anchor's, stays below the
least threshold asked for: those alone can't bring a pair there. Partial scores
are accumulated list by list, and a pair is dropped once its partial score plus
the product of both remaining norms lies below its anchor's threshold; rows with
dimensions left out are finished by the exact product. Thresholds begin high and
are lowered until each anchor's windows are full or their lower end is reached.

A pilot of about the square root of all blocks comes first: the last place that
it fills in a window is the threshold for all other blocks, so what these give
grows with the square root of their number. All cuts are exact.

Results: rows with a null id, label or vector, or with a null or non-finite
component, take no part. Vectors of each length are searched by themselves. Rows
equal in id, label and vector count once; other rows of one id are rows of their
own, but no partners of each other. A score beyond the range of a long counts as
the end of that range. An empty table gives an empty one; columns besides the
three named are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as W

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: The window in hundredths of the positive's score.
LOW, HIGH = 30, 90
#: Rows of a block: the fewest, and the most, from where there are enough blocks.
LEAST_ROWS, MOST_ROWS, ENOUGH_BLOCKS = 4096, 65_536, 64
#: Dimensions of one run of lists, and pairs of one step.
RUN, STEP_PAIRS = 8, 1 << 20
#: Vectors below this norm have exact products in doubles.
EXACT_NORM = 2.0**26
LONG = (1 << 63) - 1
ROWS = "dim int, block int, kind int, id long, label long, row long, narrow boolean, v binary"


def quantised(batches):
    """(id, label, v) to rows with integer components, two bytes each where these do."""
    for batch in batches:
        out = []
        for i, label, v in zip(batch["id"].to_pylist(), batch["label"].to_pylist(), batch["v"].to_pylist(), strict=True):
            q = np.floor(SCALE * np.array(v, np.float64))
            narrow = not len(q) or bool(np.abs(q).max() < 1 << 15)
            out.append((len(q), i, label, narrow, q.astype("<i2" if narrow else "<f8").tobytes()))
        columns = list(zip(*out, strict=True)) or [[]] * 5
        types = (pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["dim", "id", "label", "narrow", "v"])


def matrix(narrow: list[bool], raw: list[bytes], dim: int) -> np.ndarray:
    if all(narrow):
        return np.frombuffer(b"".join(raw), "<i2").reshape(len(raw), dim).astype(np.float64)
    return np.array([np.frombuffer(x, "<i2" if n else "<f8") for n, x in zip(narrow, raw, strict=True)], np.float64).reshape(len(raw), dim)


def whole_products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Products of one vector with rows in whole numbers of any size, cut to the range of a long."""
    own = [int(c) for c in q]
    return np.array([max(-LONG, min(LONG, sum(int(a) * b for a, b in zip(r, own, strict=True)))) for r in x], np.int64)


class Block:
    """The inverted index of some rows."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        norms = np.sqrt((x * x).sum(1))
        tame = norms < EXACT_NORM
        self.ids, self.labels = np.concatenate([ids[tame], ids[~tame]]), np.concatenate([labels[tame], labels[~tame]])
        self.all = np.concatenate([x[tame], x[~tame]])
        self.tame = int(tame.sum())
        x = x[tame]
        self.order = np.argsort(-(x * x).sum(0), kind="stable")
        x = x[:, self.order]
        self.cuts = list(range(0, x.shape[1], RUN)) + [x.shape[1]]
        self.runs = [np.ascontiguousarray(x[:, a:b]) for a, b in zip(self.cuts, self.cuts[1:], strict=False)]
        self.left = self.suffix_norms(x)

    def suffix_norms(self, x: np.ndarray) -> np.ndarray:
        """Row norms from each cut on (a column a cut), a little upwards, as a bound has to be."""
        squares = np.concatenate([np.cumsum((x * x)[:, ::-1], 1)[:, ::-1], np.zeros((len(x), 1))], 1)
        return np.sqrt(squares[:, self.cuts]) * (1 + 1e-12)

    def above(self, q: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, row, score) of all pairs that reach the anchors' thresholds; ``q`` tame."""
        mine = q[:, self.order]
        q_left = self.suffix_norms(mine)
        top, bottom = q_left[:, 0].max(initial=0), least.min(initial=np.inf)
        rows, partial = np.arange(self.tame), np.zeros((len(q), self.tame))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for c, run in enumerate(self.runs):
            listed = self.left[rows, c] * top >= bottom
            if not listed.all():  # the index ends here for these rows: what may still get there is finished exactly
                out = rows[~listed]
                a, r = np.nonzero(partial[:, ~listed] + q_left[:, c, None] * self.left[out, c] >= least[:, None])
                score = np.einsum("ij,ij->i", q[a], self.all[out[r]])
                fits = score >= least[a]
                found.append((a[fits], out[r][fits], score[fits]))
                rows, partial = rows[listed], partial[:, listed]
            partial += mine[:, self.cuts[c] : self.cuts[c + 1]] @ run[rows].T
            open_ = (partial + q_left[:, c + 1, None] * self.left[rows, c + 1] >= least[:, None]).any(0)
            if not open_.all():
                rows, partial = rows[open_], partial[:, open_]
        a, r = np.nonzero(partial >= least[:, None])
        found.append((a, rows[r], partial[a, r]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def pairs(self, q: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same with whole scores, for vectors of any norm."""
        tame = np.sqrt((q * q).sum(1)) < EXACT_NORM
        a, r, s = self.above(q[tame], least[tame])
        found = [(np.flatnonzero(tame)[a], r, s.astype(np.int64))]
        for i in range(len(q)):
            begin = self.tame if tame[i] else 0
            if begin < len(self.all):
                s = whole_products(self.all[begin:], q[i])
                fits = np.flatnonzero(s >= least[i])
                found.append((np.full(len(fits), i), fits + begin, s[fits]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Windows:
    """What some anchors ask of a block: the best ``k`` rows of each window [low, high] of scores, of the own or of other labels."""

    def __init__(self, block: Block, q: np.ndarray, ids: list[int], labels: list[int], windows: list[list[tuple[int, int]]], k: int, same: bool):
        self.block, self.q, self.k, self.same, self.windows = block, q, k, same, windows
        self.ids, self.labels = np.array(ids, np.int64), np.array(labels, np.int64)

    def thresholds(self, i: int, rung: float) -> int:
        """Anchor i's threshold at a rung from 0 (high) to 1 (the lower end of its lowest window)."""
        low = min(w[0] for w in self.windows[i])
        if rung == 1:
            return low
        high = min(min(w[1] for w in self.windows[i]), self.tops[i])
        return max(low, high - math.ceil(rung * (high - max(low, -self.tops[i]))))

    def search(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(anchor, window, ids, scores), thresholds lowered until the windows are full."""
        reach = np.sqrt((self.block.all**2).sum(1)).max(initial=0)
        self.tops = [min(LONG, int(t)) for t in np.sqrt((self.q**2).sum(1)) * reach + 1]
        left = [i for i in range(len(self.ids)) if self.windows[i]]
        for rung in (0.25, 0.375, 0.5, 1):
            if not left:
                return
            least = [self.thresholds(i, rung) for i in left]
            a, r, s = self.block.pairs(self.q[left], np.array(least, np.float64))
            own = np.array(left)[a]
            fits = ((self.block.labels[r] == self.labels[own]) == self.same) & (self.block.ids[r] != self.ids[own])
            a, ids, s = a[fits], self.block.ids[r[fits]], s[fits]
            order = np.lexsort((ids, -s, a))
            a, ids, s = a[order], ids[order], s[order]
            edges = np.searchsorted(a, np.arange(len(left) + 1))
            again = []
            for n, i in enumerate(left):
                mine, scores = ids[edges[n] : edges[n + 1]], s[edges[n] : edges[n + 1]]
                best = []
                for low, high in self.windows[i]:
                    begin = int(np.searchsorted(-scores, -high))
                    end = int(np.searchsorted(-scores, -max(low, -LONG), "right"))
                    best.append((begin, min(end, begin + self.k)))
                if rung < 1 and any(e - b < self.k and least[n] > w[0] for (b, e), w in zip(best, self.windows[i], strict=True)):
                    again.append(i)
                    continue
                for w, (b, e) in enumerate(best):
                    if e > b:
                        yield i, w, mine[b:e], scores[b:e]
            left = again


FOUND = "row long, anchor_id long, partner long, id long, score long"


def task(k: int, same: bool):
    """Rows of blocks, then the anchors that visit them, in order, to the best of each window."""
    names, types = [c.split()[0] for c in FOUND.split(", ")], [pa.int64()] * 5

    def run(batches):
        place, held, block = None, [], None
        for batch in batches:
            cols = {n: batch[n].to_pylist() for n in ("dim", "block", "kind", "id", "label", "row", "narrow", "v", "windows")}
            places = list(zip(cols["dim"], cols["block"], strict=True))
            at = 0
            while at < len(places):
                if places[at] != place:
                    place, held, block = places[at], [], None
                end = at + 1
                while end < len(places) and places[end] == place and cols["kind"][end] == cols["kind"][at]:
                    end += 1
                part = {n: c[at:end] for n, c in cols.items()}
                if part["kind"][0] == 0:
                    held.append((part["id"], part["label"], matrix(part["narrow"], part["v"], place[0])))
                elif held:
                    if block is None:
                        block = Block(*(np.concatenate([np.asarray(h[j], np.float64 if j == 2 else np.int64) for h in held]) for j in range(3)))
                    step = max(1, STEP_PAIRS // len(block.ids))
                    for a in range(0, end - at, step):
                        cut = {n: c[a : a + step] for n, c in part.items()}
                        windows = [[(w["low"], w["high"]) for w in ws] for ws in cut["windows"]]
                        asked = Windows(block, matrix(cut["narrow"], cut["v"], place[0]), cut["id"], cut["label"], windows, k, same)
                        got = [(cut["row"][i], cut["id"][i], cut["windows"][i][w]["partner"], n, s) for i, w, ids, scores in asked.search() for n, s in zip(ids.tolist(), scores.tolist(), strict=True)]
                        if got:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), types, strict=True)], names)
                at = end

    return run


WINDOWS = "array<struct<partner:long,low:long,high:long>>"


def visit(rows: DataFrame, anchors: DataFrame, first: int, end: int, blocks: int, k: int, same: bool) -> DataFrame:
    """``anchors`` (rows with their windows) against the blocks from ``first`` to ``end``."""
    data = rows.where(F.col("block").between(first, end - 1)).withColumn("windows", F.lit(None).cast(WINDOWS))
    asked = anchors.withColumn("block", F.explode(F.sequence(F.lit(first), F.lit(end - 1)))).withColumn("kind", F.lit(1))
    dealt = data.unionByName(asked).repartitionById(blocks, F.col("block")).sortWithinPartitions("dim", "block", "kind")
    return dealt.mapInArrow(task(k, same), FOUND)


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("row", "partner").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def filled(rows: DataFrame, anchors: DataFrame, blocks: int, k: int, same: bool) -> DataFrame:
    """The best ``k`` of each window of each anchor, over all blocks: a pilot of them first, then the others above what it filled."""
    pilot = math.isqrt(blocks - 1) + 1
    some = visit(rows, anchors, 0, pilot, blocks, k, same)
    if pilot == blocks:
        return best(some, k)
    some = W.stage_table(best(some, k), "pilot")
    full = some.where(F.col("rank") == k).select("row", F.struct("partner", "score").alias("last")).groupBy("row").agg(F.collect_list("last").alias("full"))
    # A window's new lower end is the pilot's k-th score; windows of one anchor are few.
    of = lambda w: F.filter(F.coalesce("full", F.array().cast("array<struct<partner:long,score:long>>")), lambda f: f["partner"].eqNullSafe(w["partner"]))
    raised = F.transform("windows", lambda w: F.struct(w["partner"].alias("partner"), F.greatest(w["low"], F.get(of(w), F.lit(0))["score"]).alias("low"), w["high"].alias("high")))
    higher = anchors.join(full, "row", "left").withColumn("windows", raised).drop("full")
    return best(some.drop("rank").unionByName(visit(rows, higher, pilot, blocks, blocks, k, same)), k)


def mine(rows: DataFrame, anchor: str, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); ``anchor`` is a condition on ``id``."""
    spark = rows.sparkSession
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    taken = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & finite)
    taken = taken.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), v.cast("array<double>").alias("v"))
    taken = taken.mapInArrow(quantised, "dim int, id long, label long, narrow boolean, v binary").dropDuplicates(["id", "label", "v"])
    taken = W.stage_table(taken.withColumn("row", F.xxhash64("id", "label", "v")), "vectors")
    count = taken.count()
    size = max(LEAST_ROWS, min(MOST_ROWS, count // ENOUGH_BLOCKS))
    blocks = max(1, -(-count // size))
    placed = taken.select("dim", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), "id", "label", "row", "narrow", "v")
    anchors = placed.where(anchor)
    everything = F.array(F.struct(F.lit(0).cast("long").alias("partner"), F.lit(-LONG).cast("long").alias("low"), F.lit(LONG).cast("long").alias("high")))
    own = W.stage_table(filled(placed, anchors.withColumn("windows", everything), blocks, positives, True).select("row", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # Whole numbers of any size: the ends are the least score of at least, and the largest of at most, so many hundredths.
    wide = F.col("positive_score").cast("decimal(20,0)")
    ends = own.withColumn("low", F.ceil(wide * low / F.lit(100)).cast("long")).withColumn("high", F.floor(wide * high / F.lit(100)).cast("long")).where("low <= high")
    windows = ends.groupBy("row").agg(F.collect_list(F.struct(F.col("positive_id").alias("partner"), "low", "high")).cast(WINDOWS).alias("windows"))
    found = filled(placed, anchors.join(windows, "row"), blocks, negatives, False)
    scored = found.join(own.withColumnRenamed("positive_id", "partner").drop("anchor_id"), ["row", "partner"])
    return scored.select("anchor_id", F.col("partner").alias("positive_id"), "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, against all vectors."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", label.alias("label"), "embedding"), "id % 100 = 0")


ORACLE_SQL = {
    "op12_hard_negatives": f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= {POSITIVES})
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)::INTEGER AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score QUALIFY rank <= {NEGATIVES}
"""
}
