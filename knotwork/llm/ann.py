"""Nearest neighbours by stable projections, kd-trees and a chi-square stopping test.

Vectors are projected to ``M`` dimensions (half of their own at most) with
Gaussian (2-stable) directions, made orthonormal. A projected squared distance,
scaled by D / M, is then the true one times a variable of mean 1 and variance
2 (1 - M / D) / M: a chi-square one of M D / (D - M) degrees over its degrees.
Largest inner products become nearest neighbours by one more component,
sqrt(max |x|^2 - |x|^2), which queries (scaled to the largest norm) have as 0.

A coarse kd-tree over the projections, fitted on a sample of at most
``SAMPLE_ROWS`` rows, cuts all rows into blocks of about ``BLOCK_ROWS``; blocks
that come out larger (many equal vectors) are cut again by hash. Each block
task builds a kd-tree of its own rows, which gives a query's neighbours in the
order of their projected distance. They are verified with exact inner products
until the chi-square test holds: were an unseen row nearer than the 20th found,
its projected distance would lie below the next one's with probability
``CONFIDENCE``. Queries first visit their own block, and then, knowing how good
their 20th is, only the blocks that the same test doesn't rule out.

Every row is indexed. What the driver and tasks hold besides rows is the coarse
tree and the blocks' bounding boxes: some 500 bytes for each ``BLOCK_ROWS`` rows.

Results: scores are double-precision inner products of the original vectors;
ties go to the smaller vec_id, products that are no number come last. Vectors
that are null, zero, or hold a null or non-finite component take no part,
neither do null ids; all other magnitudes do, as the search itself runs on
scaled vectors. Vectors of each length are searched by themselves. Rows with one
vec_id count once if equal. A query with no other vector has no rows; an empty
table gives an empty table; columns besides the two named are not read.
"""

from __future__ import annotations

import math
from functools import reduce
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as W

M = 32
CONFIDENCE = 0.75
BLOCK_ROWS, LEAF_ROWS, CHUNK_QUERIES, SAMPLE_ROWS = 8192, 64, 2048, 20_000


def chi_square_quantile(p: float, degrees: float) -> float:
    """By Wilson's and Hilferty's cube of a normal variable."""
    spread = 2 / (9 * degrees)
    return degrees * (1 - spread + NormalDist().inv_cdf(p) * math.sqrt(spread)) ** 3


class Space:
    """The projection of vectors of ``dim`` components, the largest of which is ``top``, and norms up to ``norm`` times that."""

    def __init__(self, dim: int, top: float, norm: float):
        self.dim, self.top, self.norm = dim, top, norm
        self.m = max(1, min(M, (dim + 1) // 2))
        directions, _ = np.linalg.qr(np.random.default_rng(7).standard_normal((dim + 1, self.m)))
        self.directions = directions * math.sqrt((dim + 1) / self.m)
        degrees = self.m * (dim + 1) / (dim + 1 - self.m)
        #: How many times its true squared distance a row's projected one is at most, by the test.
        self.limit = chi_square_quantile(CONFIDENCE, degrees) / degrees

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return x / self.top

    def units(self, x: np.ndarray) -> np.ndarray:
        """Queries of length 1, whatever their magnitude."""
        x = x / np.abs(x).max(1, keepdims=True)
        return x / np.sqrt((x * x).sum(1, keepdims=True))

    def rows(self, x: np.ndarray) -> np.ndarray:
        x = self.scaled(x)
        last = np.sqrt(np.maximum(self.norm**2 - (x * x).sum(1), 0))
        return x @ self.directions[:-1] + last[:, None] * self.directions[-1]

    def queries(self, x: np.ndarray) -> np.ndarray:
        return (self.units(x) @ self.directions[:-1]) * self.norm

    def reach(self, near: float) -> float:
        """The projected squared distance that a row with the scaled inner product ``near`` hardly exceeds."""
        return self.limit * max(2 * self.norm * (self.norm - near), 0.0)


def halves(points: np.ndarray, order: np.ndarray) -> tuple[int, float, np.ndarray, np.ndarray]:
    """Split rows at the median of their widest dimension."""
    part = points[order]
    d = int((part.max(0) - part.min(0)).argmax())
    mid = len(order) // 2
    by = np.argpartition(part[:, d], mid)
    return d, float(part[by[mid], d]), order[by[:mid]], order[by[mid:]]


class Coarse:
    """The upper levels: a perfect tree whose 2^levels leaves are the blocks."""

    def __init__(self, sample: np.ndarray, levels: int):
        self.levels = levels
        self.dims, self.cuts = np.zeros(1 << levels, np.int64), np.zeros(1 << levels)
        groups = {1: np.arange(len(sample))}
        for node in range(1, 1 << levels):
            rows = groups.pop(node)
            if len(rows) < 2:
                groups[2 * node], groups[2 * node + 1] = rows, rows[:0]
                continue
            self.dims[node], self.cuts[node], groups[2 * node], groups[2 * node + 1] = halves(sample, rows)

    def blocks(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), np.int64)
        for _ in range(self.levels):
            node = 2 * node + (points[np.arange(len(points)), self.dims[node]] >= self.cuts[node])
        return node - (1 << self.levels)


def box_distance2(low: np.ndarray, high: np.ndarray, q: np.ndarray) -> np.ndarray:
    gap = np.maximum(np.maximum(low - q, q - high), 0)
    return (gap * gap).sum(1)


class Tree:
    """A kd-tree of one block: rows reordered so that each leaf is a slice."""

    def __init__(self, points: np.ndarray):
        stack, leaves = [np.arange(len(points))], []
        while stack:
            rows = stack.pop()
            if len(rows) <= LEAF_ROWS:
                leaves.append(rows)
            else:
                _, _, left, right = halves(points, rows)
                stack += [right, left]
        self.order = np.concatenate(leaves)
        self.starts = np.cumsum([0, *map(len, leaves)])
        self.low = np.array([points[r].min(0) for r in leaves])
        self.high = np.array([points[r].max(0) for r in leaves])


def search(space: Space, ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray, k: int) -> tuple[list[tuple[int, int, float, float]], int]:
    """(query, row, score, scaled score) of the k best found for each query, and how many rows were verified in all.

    bounds: a scaled score that k rows elsewhere reach, or -inf.
    """
    points = space.rows(x)
    tree = Tree(points)
    ids, x, points = ids[tree.order], x[tree.order], points[tree.order]
    scaled, units = space.scaled(x), space.units(queries)
    found, verified = [], 0
    for qid, q, unit, p, best in zip(query_ids.tolist(), queries, units, space.queries(queries), bounds.tolist(), strict=True):
        box = box_distance2(tree.low, tree.high, p)
        leaves = box.argsort(kind="stable")
        box = np.append(box[leaves], np.inf)
        scores, rows, reach = np.empty(0), np.empty(0, np.int64), space.reach(best) if best > -np.inf else np.inf
        held, held_far, at, step = np.empty(0, np.int64), np.empty(0), 0, 16
        while box[at] <= reach and at < len(leaves):
            take = np.concatenate([np.arange(tree.starts[v], tree.starts[v + 1]) for v in leaves[at : at + step]])
            at, step = min(at + step, len(leaves)), 2 * step
            gap = points[take] - p
            held, held_far = np.concatenate([held, take]), np.concatenate([held_far, np.einsum("ij,ij->i", gap, gap)])
            # Rows nearer than all leaves not yet opened are the next projected neighbours.
            ready = np.flatnonzero(held_far <= min(box[at], reach))
            ready = ready[held_far[ready].argsort(kind="stable")]
            done, size = 0, 64
            while done < len(ready) and held_far[ready[done]] <= reach:
                now = held[ready[done : done + size]]
                done, size = done + len(now), min(2 * size, 512)
                got = scaled[now] @ unit
                verified += len(now)
                ok = (got >= best - 1e-9) & (ids[now] != qid)
                scores, rows = np.concatenate([scores, got[ok]]), np.concatenate([rows, now[ok]])
                if len(scores) >= k:
                    best = max(best, float(np.partition(scores, len(scores) - k)[len(scores) - k]))
                    reach = space.reach(best)
                    ok = scores >= best - 1e-9
                    scores, rows = scores[ok], rows[ok]
            rest = held_far > box[at]
            held, held_far = held[rest], held_far[rest]
        # Scores of the vectors as they are, summed row by row: equal vectors get equal scores.
        with np.errstate(over="ignore", invalid="ignore"):
            exact = (x[rows] * q).sum(1)
        top = np.lexsort((ids[rows], -exact))[:k]
        found += zip([qid] * len(top), ids[rows[top]].tolist(), exact[top].tolist(), scores[top].tolist(), strict=True)
    return found, verified


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def salt(ids: np.ndarray, parts: np.ndarray) -> np.ndarray:
    return (W.mix64(ids.astype(np.uint64)) % parts.astype(np.uint64)).astype(np.int64)


FOUND = "query_id long, vec_id long, score double, near double"


def nearest(vectors: DataFrame, every: int, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", verified=None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every`` the k rows of largest inner product.

    ``verified``: an accumulator that gets the number of exact inner products.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fit = F.forall("v", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    peak = F.array_max(F.transform("v", F.abs))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(fit).withColumn("peak", peak).where("peak > 0")
    part = F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / F.col("peak")) * (x / F.col("peak")))
    norm = F.log2("peak") + F.log2(part) / 2
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max("peak").alias("top"), F.max(norm).alias("longest")).orderBy("dim").collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = []
    for r in sizes:
        space = Space(r.dim, r.top, 2 ** (r.longest - math.log2(r.top)) * (1 + 1e-9))
        found.append(nearest_of(rows.where(F.size("v") == r.dim).select("vec_id", "v"), space, r.n, every, k, verified))
    # An id with vectors of several lengths still gets one list.
    return found[0] if len(found) == 1 else ranked(reduce(DataFrame.unionByName, found).drop("rank"), k)


def nearest_of(rows: DataFrame, space: Space, n: int, every: int, k: int, verified=None) -> DataFrame:
    """:func:`nearest` over the n rows (vec_id, v) of one length."""
    dim, m = space.dim, space.m

    def arrays(batch) -> np.ndarray:
        return batch["v"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)

    def project(batches):
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([pa.array(space.rows(arrays(batch)).tolist(), pa.list_(pa.float64()))], names=["p"])

    levels = max(0, math.ceil(math.log2(n / BLOCK_ROWS)))
    every_nth = max(1, math.ceil(n / SAMPLE_ROWS))
    sample = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(every_nth)) == 0).limit(2 * SAMPLE_ROWS) if levels else rows.limit(0)
    coarse = Coarse(np.array([r.p for r in sample.select("v").mapInArrow(project, "p array<double>").collect()]).reshape(-1, m), levels)

    bounds = [f"{e}{d}" for e in ("low", "high") for d in range(m)]

    def boxes(batches):
        for batch in batches:
            if not len(batch):
                continue
            x = arrays(batch)
            p = space.rows(x)
            block = coarse.blocks(p)
            ids = batch["vec_id"].to_numpy()
            home = coarse.blocks(space.queries(x))
            names = np.unique(np.concatenate([block, home]))
            for b in names.tolist():
                own = p[block == b]
                low, high = (own.min(0), own.max(0)) if len(own) else (np.full(m, np.inf), np.full(m, -np.inf))
                values = [b, len(own), int(((home == b) & (ids % every == 0)).sum()), *low.tolist(), *high.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=["block", "n", "q", *bounds])

    parts = rows.select("vec_id", "v").mapInArrow(boxes, "block long, n long, q long, " + ", ".join(f"{b} double" for b in bounds))
    total = parts.groupBy("block").agg(F.sum("n").alias("n"), F.sum("q").alias("q"), *(F.min(b).alias(b) for b in bounds[:m]), *(F.max(b).alias(b) for b in bounds[m:])).collect()
    blocks = 1 << levels
    held, asked = np.zeros(blocks, np.int64), np.zeros(blocks, np.int64)
    low, high = np.full((blocks, m), np.inf), np.full((blocks, m), -np.inf)
    for r in total:
        held[r.block], asked[r.block] = r.n, r.q
        low[r.block], high[r.block] = r[3 : 3 + m], r[3 + m :]
    subs = np.maximum(1, -(-held // (2 * BLOCK_ROWS)))
    dealt = pa.schema([("block", pa.int64()), ("sub", pa.int64()), ("chunk", pa.int64()), ("role", pa.int32()), ("vec_id", pa.int64()), ("bound", pa.float64()), ("v", pa.binary())])
    kinds = "block long, sub long, chunk long, role int, vec_id long, bound double, v binary"

    def deal(block, sub, chunk, role, ids, bound, x, repeat):
        """Rows for the tasks; ``repeat`` picks the vectors."""
        raw = [x[i].tobytes() for i in range(len(x))]
        return pa.RecordBatch.from_arrays(
            [pa.array(block), pa.array(sub), pa.array(chunk), pa.array(np.full(len(block), role, np.int32)), pa.array(ids[repeat]), pa.array(bound[repeat]), pa.array([raw[i] for i in repeat.tolist()], pa.binary())], schema=dealt
        )

    def spread(of: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row so many times, with the number of each time."""
        repeat = np.repeat(np.arange(len(of)), times[of])
        return repeat, np.arange(len(repeat)) - np.repeat(np.cumsum(times[of]) - times[of], times[of])

    def data(chunks: np.ndarray):
        """All rows of blocks that queries visit, once for each chunk of those."""

        def run(batches):
            for batch in batches:
                for a in range(0, len(batch), 5000):
                    part = batch.slice(a, 5000)
                    x, ids = arrays(part), part["vec_id"].to_numpy()
                    block = coarse.blocks(space.rows(x))
                    repeat, chunk = spread(block, chunks)
                    yield deal(block[repeat], salt(ids, subs[block])[repeat], chunk, 0, ids, np.full(len(ids), -np.inf), x, repeat)

        return rows.select("vec_id", "v").mapInArrow(run, kinds)

    def task(group: pa.Table) -> pa.Table:
        role = group["role"].to_numpy()
        is_query, ids = role == 1, group["vec_id"].to_numpy()
        found = []
        if is_query.any() and not is_query.all():
            x = matrix(group["v"], dim)
            found, looked_at = search(space, ids[~is_query], x[~is_query], ids[is_query], x[is_query], group["bound"].to_numpy()[is_query], k)
            if verified is not None:
                verified.add(looked_at)
        columns = list(zip(*found, strict=True)) if found else [[], [], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score", "near"])

    def run_tasks(chunks: np.ndarray, queries: DataFrame) -> DataFrame:
        return data(chunks).unionByName(queries).groupBy("block", "sub", "chunk").applyInArrow(task, FOUND)

    asking = rows.where(F.col("vec_id") % every == 0).select("vec_id", "v")
    chunks = -(-asked // CHUNK_QUERIES)

    def home(batches):
        for batch in batches:
            if len(batch):
                x, ids = arrays(batch), batch["vec_id"].to_numpy()
                block = coarse.blocks(space.queries(x))
                repeat, sub = spread(block, subs)
                yield deal(block[repeat], sub, salt(ids, chunks[block])[repeat], 1, ids, np.full(len(ids), -np.inf), x, repeat)

    first = W.stage_table(run_tasks(chunks, asking.mapInArrow(home, kinds)), "neighbours")
    if blocks == 1:
        return ranked(first, k)
    # Each query's k-th best so far, and the blocks that may hold better rows.
    so_far = ranked(first, k, "near").groupBy("query_id").agg(F.min("near").alias("bound"), F.count("*").alias("found"))
    known = asking.join(so_far.withColumnRenamed("query_id", "vec_id"), "vec_id", "left")
    known = known.select("vec_id", "v", F.when(F.col("found") >= k, F.col("bound")).otherwise(F.lit(float("-inf"))).alias("bound"))

    def visits(batches):
        for batch in batches:
            if not len(batch):
                continue
            x, bound = arrays(batch), batch["bound"].to_numpy()
            p = space.queries(x)
            own = coarse.blocks(p)
            row, block = [], []
            for i in range(len(x)):
                reach = space.reach(bound[i]) if bound[i] > -np.inf else np.inf
                go = np.flatnonzero((box_distance2(low, high, p[i]) <= reach) & (held > 0) & (np.arange(blocks) != own[i]))
                row.append(np.full(len(go), i))
                block.append(go)
            repeat, block = np.concatenate(row), np.concatenate(block)
            ids = batch["vec_id"].to_numpy()
            yield deal(block, block * 0, block * 0, 1, ids, bound, x, repeat)

    visited = W.stage_table(known.mapInArrow(visits, kinds), "visits")
    asked2 = np.zeros(blocks, np.int64)
    for r in visited.groupBy("block").count().collect():
        asked2[r.block] = r["count"]
    chunks2 = -(-asked2 // CHUNK_QUERIES)

    def dealt_visits(batches):
        for batch in batches:
            if len(batch):
                block, ids = batch["block"].to_numpy(), batch["vec_id"].to_numpy()
                repeat, sub = spread(block, subs)
                yield deal(block[repeat], sub, salt(ids, chunks2[block])[repeat], 1, ids, batch["bound"].to_numpy(), matrix(batch["v"], dim), repeat)

    second = run_tasks(chunks2, visited.mapInArrow(dealt_visits, kinds))
    return ranked(first.unionByName(second), k)


def ranked(found: DataFrame, k: int, *more: str) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.nanvl("score", F.lit(float("-inf"))).desc(), "vec_id")
    rows = found.dropDuplicates(["query_id", "vec_id", "score"])
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", *more)


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector, against all vectors."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 20)
