"""Approximate nearest neighbours by inner product with collision-counting hashing.

Vectors are turned to unit length in one further dimension (the root of what
their squared length lacks to the longest), where the largest inner product is
the smallest distance. A block of vectors keeps one sorted array for each random
projection. A query opens a window around its own projection in every array and
counts how often each vector lies in a window; windows widen step by step
(virtual rehashing), and vectors whose count reaches the threshold are verified
with their exact inner product, until enough of the block has been verified. Most
queries end at one of two steps, so the search for a query's last step begins
where the queries before it ended.

Blocks of queries meet strips of blocks of vectors: each pair is one task's group
of bounded size, and only the best of each pair go on to the next shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from medialake.operators.ordered import stage

PROJECTIONS = 96
THRESHOLD = 0.85  # part of the projections in which a vector must collide
WIDTH, WIDER = 1.3, 1.15  # half of the first window, and its growth
VERIFY = 0.12  # part of a block that a query verifies at least, beside those it looks for
USUAL = 0.9  # quantile of the lengths in a block; longer vectors are verified for every query, so that they do not squeeze the others together
BLOCK = 4096
STRIP = 4  # most blocks of vectors that a block of queries meets in one task
GROUPS = 8  # for each core, at least, before blocks go into strips
TASKS, TASKS_MOST = 4, 2000  # partitions for each group, so that few groups share one, and the most of all
TILE = 64  # queries that are worked on together
HALVES = np.cumprod([WIDTH] + [WIDER] * 200)  # of the windows, step by step; the last spans all projections of unit vectors


def _projections(dim: int, seed: int = 20) -> np.ndarray:
    return np.random.default_rng(seed).normal(0, 1, (dim + 1, PROJECTIONS))


def exact(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products with one query, or with one for each vector, in double precision, summed in the order of the components, so that equal vectors score equally wherever they lie."""
    out = np.zeros(len(vectors))
    for d in range(vectors.shape[1]):
        out += vectors[:, d] * query[..., d]
    return out


class Index:
    """Sorted projections of one block. Components of any finite size do: a block is scaled by its largest first."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        scaled = self.vectors / np.abs(self.vectors).max()
        length = np.sqrt((scaled**2).sum(1))
        longest = float(np.quantile(length, USUAL)) or float(length.max())
        self.long = np.flatnonzero(length > longest * (1 + 1e-6))
        rest = np.sqrt(np.maximum(longest**2 - length**2, 0))
        self.axes = _projections(vectors.shape[1])
        lifted = np.hstack([scaled, rest[:, None]]) / longest
        values = lifted @ self.axes
        order = np.argsort(values, axis=0, kind="stable")
        self.sorted = np.ascontiguousarray(np.take_along_axis(values, order, 0).T)
        # place of each vector in each sorted array, so that a window is a range of places
        self.place = np.empty((PROJECTIONS, len(ids)), np.uint16 if len(ids) < 1 << 16 else np.uint32)
        np.put_along_axis(self.place, order.T, np.arange(len(ids), dtype=self.place.dtype)[None, :], 1)

    def search(self, keys: np.ndarray, queries: np.ndarray, k: int):
        """(ids, scores) for each query: the best ``k`` of the vectors it verified, without its own row."""
        found, start = [], 0
        for lo in range(0, len(queries), TILE):
            some = queries[lo : lo + TILE]
            near, step = self.collided(some, min(len(self.ids), k + 1 + int(VERIFY * len(self.ids))), start)
            found += self.best(keys[lo : lo + TILE], some, near, k)
            start = max(int(np.median(step)) - 1, 0)  # the next queries end nearby
        return found

    def collided(self, queries: np.ndarray, enough: int, start: int) -> tuple[list[np.ndarray], np.ndarray]:
        """For each query the first step of the windows at which ``enough`` vectors collide, or all lie in them, and these vectors.

        The windows of a step hold those of the steps before, so that steps are
        tried from ``start`` on, upwards until there are enough and downwards until
        there are not.
        """
        n, need, kind = len(self.ids), max(1, round(THRESHOLD * PROJECTIONS)), self.place.dtype
        unit = queries / np.abs(queries).max(1, keepdims=True)
        at = np.hstack([unit / np.linalg.norm(unit, axis=1, keepdims=True), np.zeros((len(queries), 1))]) @ self.axes
        near: list = [None] * len(queries)
        step, short = np.full(len(queries), start), np.full(len(queries), -1)  # short: the last step that has too few
        open_ = np.arange(len(queries))
        while len(open_):
            here, half = at[open_], HALVES[step[open_]]
            first = np.stack([np.searchsorted(s, x - half) for s, x in zip(self.sorted, here.T)], 1)
            size = np.stack([np.searchsorted(s, x + half, "right") for s, x in zip(self.sorted, here.T)], 1) - first
            whole = size.min(1) == n
            hits = np.zeros((len(open_), n), np.uint8 if PROJECTIONS < 256 else np.uint16)
            for place, a, m in zip(self.place, first.astype(kind).T, size.astype(kind).T):
                # unsigned: places before the window wrap round and lie beyond it
                hits += (place - a[:, None] < m[:, None]).view(np.uint8)
            close = hits >= need
            done = (np.count_nonzero(close, 1) >= enough) | whole
            for r in np.flatnonzero(done).tolist():
                near[open_[r]] = np.flatnonzero(close[r])
            short[open_[~done]] = step[open_[~done]]
            step[open_] += np.where(done, -1, [near[i] is None for i in open_.tolist()])
            open_ = open_[step[open_] > short[open_]]
        return near, short + 1

    def best(self, keys: np.ndarray, queries: np.ndarray, near: list[np.ndarray], k: int):
        """(ids, scores) of the best ``k`` of each query's vectors, and of those longer than usual.

        A matrix product, which sums in any order, leaves the vectors that may be
        among the best, within what rounding can change; only these are scored exactly.
        """
        dim, may = self.vectors.shape[1], []
        with np.errstate(over="ignore", invalid="ignore"):  # nothing is left out where products are not finite
            rough = queries @ self.vectors.T
            most = dim * np.abs(self.vectors).max() * np.abs(queries).max(1)  # of a product, and of its partial sums
        error = dim * 1e-15 * most + np.finfo(float).tiny
        for i, (key, at) in enumerate(zip(keys, near)):
            if len(self.long):
                at = np.union1d(at, self.long)
            at = at[self.ids[at] != key]
            if len(at) > k and np.isfinite(most[i]):
                values = rough[i, at]
                at = at[values >= np.partition(values, -k)[-k] - error[i]]
            may.append(at)
        count = np.array([len(at) for at in may])
        at, owner = np.concatenate(may), np.repeat(np.arange(len(may)), count)
        score = exact(self.vectors[at], queries[owner])
        order = np.lexsort((self.ids[at], -score, owner))
        at, score = at[order], score[order]
        return [(self.ids[at[a : a + min(k, c)]], score[a : a + min(k, c)]) for a, c in zip((np.cumsum(count) - count).tolist(), count.tolist())]


def usable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """``vec_id, v`` (array of float if it was one, else of double) of the vectors that take part: with an id, not null, not zero, all components finite."""
    (kind,) = vectors.select(column).schema
    v = F.col(column) if kind.dataType.elementType in (FloatType(), DoubleType()) else F.transform(column, lambda x: x.cast("double"))
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), v.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", column: str = "embedding", block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest found for each row of ``queries`` among ``vectors``.

    The measure is the inner product; ties go to the smaller id, and a row is not its
    own neighbour. Vectors that are null, zero or hold null or non-finite components
    take no part, nor do candidates of another length than the query. Rows that
    repeat an id and vector count once; with fewer than ``k`` candidates all are given.
    """
    pool = stage(usable(vectors, key, column).distinct())
    asked = stage(usable(queries, key, column).distinct())
    size = pool.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    sizes = stage(size)
    blocks = F.ceil(F.col("n") / block).cast("int")
    left = pool.withColumn("dim", F.size("v")).join(F.broadcast(sizes), "dim")  # one row for each length of vectors
    left = left.withColumn("vb", F.pmod(F.xxhash64("vec_id"), blocks).cast("int"))
    n_asked = asked.groupBy(F.size("v").alias("dim")).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    parts = stage(n_asked)
    right = asked.withColumn("dim", F.size("v")).join(F.broadcast(sizes), "dim").join(F.broadcast(parts), "dim")
    right = right.withColumn("qb", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("parts")).cast("int"))
    # every block of vectors goes to every block of queries, blocks and not rows being multiplied; a group has a strip of blocks
    pairs, spark = sizes.join(parts, "dim").agg(F.sum(blocks * F.col("parts"))).first()[0] or 1, pool.sparkSession
    strip = min(STRIP, max(1, pairs // (GROUPS * spark.sparkContext.defaultParallelism)))
    left = left.join(F.broadcast(parts), "dim").withColumn("strip", F.floor(F.col("vb") / strip).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = right.withColumn("strip", F.explode(F.sequence(F.lit(0), F.ceil(blocks / strip).cast("int") - 1)))
    groups = ["dim", "strip", "qb"]

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        keys, vectors, queries = b["vec_id"].to_numpy(), a["v"], _matrix(b["v"])
        owner, ids, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        of, every = a["vb"].to_numpy(), a["vec_id"].to_numpy()
        for one in np.unique(of) if len(keys) else []:
            at = np.flatnonzero(of == one)
            found = Index(every[at], _matrix(vectors.take(at))).search(keys, queries, k)
            owner = np.concatenate((owner, np.repeat(np.arange(len(keys)), [len(i) for i, _ in found])))
            ids, score = np.concatenate((ids, *(i for i, _ in found))), np.concatenate((score, *(s for _, s in found)))
            order = np.lexsort((ids, -score, owner))
            order = order[np.arange(len(order)) - np.searchsorted(owner[order], owner[order]) < k]
            owner, ids, score = owner[order], ids[order], score[order]
        return pa.table({"query_id": keys[owner], "vec_id": ids, "score": score})

    # a group is small but takes long, so it is dealt out by number: Spark would merge partitions by their bytes
    tasks = max(min(TASKS * -(-pairs // strip), TASKS_MOST), int(spark.conf.get("spark.sql.shuffle.partitions")))
    left = left.select(*groups, "vb", "vec_id", "v").repartition(tasks, *groups).groupBy(*groups)
    right = right.select(*groups, "vec_id", "v").repartition(tasks, *groups).groupBy(*groups)
    local = left.cogroup(right).applyInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy().astype(np.float64, copy=False).reshape(len(column), -1)
