"""Approximate nearest neighbours by collision counting, for the largest inner product.

Inner-product search is turned into search on the unit sphere: a block's vectors are scaled by its largest norm and
lifted by one coordinate to norm 1. Each of m Gaussian projections of a block is kept as a sorted array. A query opens in
every array a window around its own projection; windows of half-width t hold a vector at distance d with probability
P(|N(0,1)| <= t/d). Virtual rehashing widens all windows step by step, counting for each vector the arrays in which it
has been met; vectors met in at least a share alpha of them are verified by their inner product in double precision. A
query ends when t is so wide, against the distance of the k-th best verified vector, that anything nearer reaches the
threshold with probability `confidence`; at last the windows hold everything, so the search itself drops nothing.

Scale: vectors are dealt by hash into blocks, queries into chunks, each pair of which is a task's unit of bounded size,
so a block's arrays are sorted once for CHUNK_ROWS queries, which costs a few hundredths of what searching them does; a
block's best k for a query are merged across blocks. Nothing is broadcast. The more projections, the fewer vectors reach
the threshold by chance, but the more must be counted: on vectors of next to no contrast counting costs more than
verifying. A step's windows in all arrays are found by one search.

Edge cases: vectors that are null, zero, hold null or non-finite components or have another length than most take no
part, nor do rows without id; rows equal in id and vector count once; if an id has several vectors, the least of them
(as an array) is the query and all are candidates, but never for their own id; ties go to the smaller id; an empty table
gives an empty result; other columns do not matter, whatever their names.
"""

from __future__ import annotations

from statistics import NormalDist
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldmark.llm._base import store, table

BLOCK_ROWS = 32_768
CHUNK_ROWS = 2048
PROJECTIONS = 96
ALPHA = 0.5
CONFIDENCE = 0.95
GROWTH = 1.2


def window_ratio(m: int, alpha: float, confidence: float) -> float:
    """The t/d from which a vector at distance d is met in alpha*m of m arrays with the given probability (normal approximation)."""
    z = NormalDist().inv_cdf(confidence)
    low, high = 1e-3, 10.0
    for _ in range(60):
        mid = (low + high) / 2
        p = 2 * NormalDist().cdf(mid) - 1
        low, high = (low, mid) if p - z * (p * (1 - p) / m) ** 0.5 >= alpha else (mid, high)
    return high


class CollisionIndex:
    """Sorted projection arrays of one block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, m: int = PROJECTIONS, alpha: float = ALPHA, confidence: float = CONFIDENCE, seed: int = 29):
        self.ids, self.vectors, self.m = ids, vectors, m
        self.need = max(1, int(np.ceil(alpha * m)))
        self.ratio = window_ratio(m, alpha, confidence)
        norms = np.sqrt((vectors * vectors).sum(axis=1))
        self.top = float(norms.max()) if len(norms) else 1.0
        self.axes = np.random.default_rng(seed).standard_normal((vectors.shape[1] + 1, m))
        lift = np.sqrt(np.maximum(0.0, 1.0 - (norms / self.top) ** 2))
        flat = (vectors / self.top) @ self.axes[:-1] + lift[:, None] * self.axes[-1]
        # Array j holds its projections moved by j times `band`, so all stand in one ascending array, searched in one call.
        self.order = np.ascontiguousarray(np.argsort(flat, axis=0, kind="stable").T.astype(np.intp)).ravel()
        self.buffer = np.empty_like(self.order)
        self.reach = float(np.abs(flat).max(initial=0.0)) + 1.0
        self.band = 4 * self.reach * np.arange(m)
        self.sorted = (np.sort(flat, axis=0).T + self.band[:, None]).ravel()
        self.verified = 0
        # Single precision, scaled to at most 1, screens candidates; what it leaves is measured in double precision.
        self.coarse = (vectors / self.top).astype(np.float32)
        self.slack = 2e-7 * max(16, vectors.shape[1])

    def search(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best, best first, ties to the smaller id; never the query's own id."""
        n, m = len(self.ids), self.m
        norm = float(np.sqrt((q * q).sum()))
        centre = (q / norm) @ self.axes[:-1]
        at = lambda x, side: np.searchsorted(self.sorted, np.clip(x, -self.reach, self.reach) + self.band, side)
        left = right = at(centre, "left")
        counts = np.zeros(n, dtype=np.int64)
        seen = np.zeros(n, dtype=bool)
        ids = np.empty(0, dtype=np.int64)
        scores = np.empty(0)
        unit = (q / norm).astype(np.float32)
        t = 0.6
        while True:
            lo, hi = np.minimum(at(centre - t, "left"), left), np.maximum(at(centre + t, "right"), right)
            parts = [self.order[x:y] for x, y in zip([*lo.tolist(), *right.tolist()], [*left.tolist(), *hi.tolist()], strict=True) if x < y]
            left, right = lo, hi
            full = int((hi - lo).sum()) == n * m
            if parts:
                met = np.concatenate(parts, out=self.buffer[: sum(map(len, parts))])
                counts += np.bincount(met, minlength=n)
            new = np.flatnonzero((counts >= self.need) & ~seen)
            if len(new):
                seen[new] = True
                self.verified += len(new)
                new = new[self.ids[new] != query_id]
                near = (self.coarse @ unit)[new] if len(new) > n // 8 else self.coarse[new] @ unit
                bar = scores.min() / (self.top * norm) - self.slack if len(ids) >= k else -np.inf
                if len(new) > k:
                    bar = max(bar, float(np.partition(near, -k)[-k]) - 2 * self.slack)
                new = new[near >= bar]
                got = (self.vectors[new] * q).sum(axis=1)
                ids, scores = np.concatenate([ids, self.ids[new]]), np.concatenate([scores, got])
                if len(ids) > k:
                    best = np.lexsort((ids, -scores))[:k]
                    ids, scores = ids[best], scores[best]
            if full:
                break
            if len(ids) >= k:
                far = float(np.sqrt(max(0.0, 2.0 - 2.0 * scores.min() / (self.top * norm))))
                if t >= self.ratio * far:
                    break
                t = min(t * GROWTH, max(self.ratio * far, t * 1.02))
            else:
                t *= GROWTH
        best = np.lexsort((ids, -scores))[:k]
        return ids[best], scores[best]


def _matrix(column: Any) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def nearest(vectors: DataFrame, queries: DataFrame, *, k: int = 20, m: int = PROJECTIONS, alpha: float = ALPHA, confidence: float = CONFIDENCE, block_rows: int = BLOCK_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries (vec_id, embedding) its k best of vectors (the same columns)."""
    ok = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    clean = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(ok)
    base = store(clean(vectors).dropDuplicates(), "ann-vectors")
    asked = store(clean(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "ann-queries")
    usual = base.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = usual["d"] if usual else 0
    base, asked = base.where(F.size("embedding") == dim), asked.where(F.size("embedding") == dim)
    blocks, chunks = max(1, -(-base.count() // block_rows)), max(1, -(-asked.count() // chunk_rows))
    left = base.withColumn("_vb", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks)).cast("int")).withColumn("_qc", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    right = asked.withColumn("_qc", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(chunks)).cast("int")).withColumn("_vb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def tile(block: Any, chunk: Any) -> Any:
        import pyarrow as pa

        out: list[list[Any]] = [[], [], []]
        if len(block) and len(chunk):
            index = CollisionIndex(block.column("vec_id").to_numpy(), _matrix(block.column("embedding")), m, alpha, confidence)
            for query_id, q in zip(chunk.column("vec_id").to_pylist(), _matrix(chunk.column("embedding")), strict=True):
                ids, scores = index.search(query_id, q, k)
                out[0].append(np.full(len(ids), query_id, dtype=np.int64))
                out[1].append(ids)
                out[2].append(scores)
        kinds = (np.int64, np.int64, np.float64)
        return pa.table({c: np.concatenate(x) if x else np.empty(0, d) for c, x, d in zip(("query_id", "vec_id", "score"), out, kinds, strict=True)})

    found = left.groupBy("_vb", "_qc").cogroup(right.groupBy("_vb", "_qc")).applyInArrow(tile, "query_id long, vec_id long, score double")
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))
