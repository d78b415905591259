"""Descriptor matching: exact nearest neighbours, weights, votes, rankings.

Descriptors: q or d side with fx (feature), aid (observation), nid (name) and vec. A match row is a query feature with
one of its neighbours.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldmark.functions.weights import NAMED

#: Rows of either side of a tile: as few as give each core several tiles, but no fewer and no more than these.
LEAST_ROWS, MOST_ROWS = 2048, 32768
SLICE_ROWS = 64
DIST_PLACES = 5


def tile_of(k: int, exclude: str | None = None, places: int = DIST_PLACES) -> Callable[[Any, Any], Any]:
    """The work of one tile, for cogrouped Arrow tables with fx, vec (and exclude): the k nearest d of each q."""

    def tile(q: Any, d: Any) -> Any:
        import numpy as np
        import pyarrow as pa

        out: list[list[Any]] = [[], [], []]
        if len(q) and len(d):
            mat = lambda t: t.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(t), -1)
            x, y, qf, df = mat(q), mat(d), q.column("fx").to_numpy(), d.column("fx").to_numpy()
            values = {v: i for i, v in enumerate(dict.fromkeys(d.column(exclude).to_pylist()))} if exclude else {}
            own, other = (np.array([values.get(v, -1) for v in t.column(exclude).to_pylist()]) if exclude else np.full(len(t), -1) for t in (q, d))
            xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
            # Vectors with no finite length have no distance. Equal values of exclude lie together on both sides.
            a, b = np.argsort(own, kind="stable"), np.argsort(other, kind="stable")
            a, b = a[np.isfinite(xx[a])], b[np.isfinite(yy[b])]
            x, qf, own, xx, y, df, other, yy = x[a], qf[a], own[a], xx[a], y[b], df[b], other[b], yy[b]
            left, right = np.hstack([-2 * x, np.ones((len(x), 1))]), np.hstack([y, yy[:, None]]).T
            n = min(k, len(y))
            fold = max(1, len(y) // max(512, n))
            wide = len(y) // fold
            for at in range(0, len(x) if n else 0, SLICE_ROWS):
                part = slice(at, at + SLICE_ROWS)
                # Squared distances, less the query's own square, by one product choose candidates, with room for its rounding;
                # those are measured anew.
                near = left[part] @ right
                for v in np.unique(own[part]) if exclude else ():
                    rows, columns = (slice(*np.searchsorted(side, (v, v + 1))) for side in (own[part], other))
                    near[rows, columns] = np.inf
                # The n-th of the least numbers of groups is no less than the n-th of all.
                some = np.concatenate([near[:, : fold * wide].reshape(len(near), fold, wide).min(axis=1), near[:, fold * wide :]], axis=1)
                kth = np.partition(some, n - 1, axis=1)[:, n - 1] + xx[part]
                slack = 1e-12 * (xx[part] + yy.max())
                limit = (np.sqrt(np.maximum(kth, 0) + slack) + 2 * 10.0**-places) ** 2 + slack - xx[part]
                i, j = np.divmod(np.flatnonzero(near <= limit[:, None]), len(y))
                met = np.isfinite(near[i, j])
                i, j = i[met], j[met]
                parts = [slice(c, c + 65536) for c in range(0, len(i), 65536)]
                dist = np.round(np.sqrt(np.concatenate([((y[j[c]] - x[i[c] + at]) ** 2).sum(axis=1) for c in parts] or [np.empty(0)])), places)
                best = np.lexsort((df[j], dist, i))
                i, j, dist = i[best], j[best], dist[best]
                best = np.arange(len(i)) - np.searchsorted(i, i, "left") < k
                out[0].append(qf[i[best] + at])
                out[1].append(df[j[best]])
                out[2].append(dist[best])
        kinds = (np.int64, np.int64, np.float64)
        return pa.table({c: np.concatenate(v) if v else np.empty(0, t) for c, v, t in zip(("q_fx", "d_fx", "dist"), out, kinds, strict=True)})

    return tile


def knn(queries: DataFrame, database: DataFrame, k: int, *, exclude: str | None = None, places: int = DIST_PLACES) -> DataFrame:
    """(q_fx, d_fx, dist, rank): each query feature's k nearest by Euclidean distance, rounded; ties to the lesser d_fx.

    exclude: a column of both sides; database rows of the query's own value do not count, and others take their places.
    Both sides are dealt by hash into blocks of bounded size; each pair of blocks is one unit of work, whose best k by
    query meet in a window. Nothing is broadcast. A row goes to every block of the other side, so blocks are as large as
    memory and the number of cores allow.
    """
    keep = [exclude] if exclude else []
    nd, nq = database.count(), queries.count()
    side = min(MOST_ROWS, max(LEAST_ROWS, math.isqrt(nd * nq // (4 * queries.sparkSession.sparkContext.defaultParallelism))))
    nb, nc = max(1, -(-nd // side)), max(1, -(-nq // side))
    left = queries.select(F.col("fx").cast("long").alias("fx"), "vec", *keep).withColumn("_c", F.pmod(F.xxhash64("fx"), F.lit(nc)).cast("int")).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))))
    right = database.select(F.col("fx").cast("long").alias("fx"), "vec", *keep).withColumn("_b", F.pmod(F.xxhash64("fx"), F.lit(nb)).cast("int")).withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(nc - 1))))

    near = left.groupBy("_b", "_c").cogroup(right.groupBy("_b", "_c")).applyInArrow(tile_of(k, exclude, places), "q_fx long, d_fx long, dist double")
    nth = F.row_number().over(W.partitionBy("q_fx").orderBy("dist", "d_fx"))
    return near.withColumn("rank", nth).where(F.col("rank") <= k)


def neighbours(queries: DataFrame, database: DataFrame, k: int, knorm: int, exclude: str | None = None) -> DataFrame:
    """knn of k + knorm with aid and nid of both ends."""
    near = knn(queries, database, k + knorm, exclude=exclude)
    q = queries.select(F.col("fx").alias("q_fx"), F.col("aid").alias("q_aid"), F.col("nid").alias("q_nid"))
    d = database.select(F.col("fx").alias("d_fx"), F.col("aid").alias("d_aid"), F.col("nid").alias("d_nid"))
    return near.join(q, "q_fx").join(d, "d_fx")


def votes(near: DataFrame, k: int, knorm: int, rule: str = "last") -> DataFrame:
    """The first k neighbours with the distance of their normaliser.

    rule 'last': the last neighbour. 'name': the first of the knorm after the k whose name is neither among the k nor
    the query's; else the last.
    """
    w = W.partitionBy("q_fx")
    last = F.max(F.when(F.col("rank") == k + knorm, F.col("dist"))).over(w)
    if rule == "last":
        return near.withColumn("norm", last).where(F.col("rank") <= k)
    valid = ~F.array_contains("_top", F.col("d_nid")) & (F.col("d_nid") != F.col("q_nid")) & (F.col("rank") > k)
    first = F.min_by(F.when(valid, F.col("dist")), F.when(valid, F.col("rank"))).over(w)
    named = near.withColumn("_top", F.collect_set(F.when(F.col("rank") <= k, F.col("d_nid"))).over(w))
    return named.withColumn("norm", F.coalesce(first, last)).where(F.col("rank") <= k).drop("_top")


def name_normalizer(near: DataFrame, k: int, knorm: int) -> DataFrame:
    """(q_fx, norm_k): 0-based place among the normalisers by the rule 'name', the last if none is valid."""
    top = F.collect_set(F.when(F.col("rank") <= k, F.col("d_nid"))).over(W.partitionBy("q_fx"))
    rows = near.withColumn("_top", top).where(F.col("rank") > k)
    valid = ~F.array_contains("_top", F.col("d_nid")) & (F.col("d_nid") != F.col("q_nid"))
    return rows.groupBy("q_fx").agg(F.coalesce(F.min(F.when(valid, F.col("rank") - k - 1)), F.lit(knorm - 1)).alias("norm_k"))


def weigh(voted: DataFrame, name: str = "lnbnn") -> DataFrame:
    """voted with score, rounded so that sums do not depend on their order."""
    return voted.withColumn("score", F.round(NAMED[name](F.col("dist"), F.col("norm")), 5))


def _sum(column: str) -> Any:
    return F.sum(F.col(column).cast("decimal(18,5)"))


def annot_scores(scored: DataFrame) -> DataFrame:
    """(q_aid, d_aid, d_nid, score): csum, the sum of an observation's votes."""
    return scored.groupBy("q_aid", "d_aid", "d_nid").agg(_sum("score").cast("double").alias("score"))


def name_scores(scored: DataFrame, method: str = "nsum") -> DataFrame:
    """(q_aid, d_nid, score): nsum, each query feature votes once for a name, by its best; csum, the best observation's
    sum; sumamech, the sum over a name's observations."""
    if method == "nsum":
        return scored.groupBy("q_aid", "d_nid", "q_fx").agg(F.max("score").alias("score")).groupBy("q_aid", "d_nid").agg(_sum("score").cast("double").alias("score"))
    own = annot_scores(scored)
    agg = {"csum": F.max("score"), "sumamech": _sum("score").cast("double")}[method]
    return own.groupBy("q_aid", "d_nid").agg(agg.alias("score"))


def ranked(scores: DataFrame, item: str) -> DataFrame:
    """scores with rank from 1 by query: higher scores first, ties to the lesser item."""
    return scores.withColumn("rank", F.row_number().over(W.partitionBy("q_aid").orderBy(F.desc("score"), item)))


def shortlist(annots: DataFrame, names: DataFrame, n_names: int, n_annots: int) -> DataFrame:
    """(q_aid, d_aid, d_nid, name_rank, annot_rank): the best names' best observations."""
    top = ranked(names, "d_nid").where(F.col("rank") <= n_names).select("q_aid", "d_nid", F.col("rank").alias("name_rank"))
    nth = F.row_number().over(W.partitionBy("q_aid", "d_nid").orderBy(F.desc("score"), "d_aid"))
    return annots.join(top, ["q_aid", "d_nid"]).withColumn("annot_rank", nth).where(F.col("annot_rank") <= n_annots).select("q_aid", "d_aid", "d_nid", "name_rank", "annot_rank")


def align_name_scores(annots: DataFrame, names: DataFrame) -> DataFrame:
    """(q_aid, d_aid, d_nid, score): a name's score goes to its best observation, null to the others."""
    nth = F.row_number().over(W.partitionBy("q_aid", "d_nid").orderBy(F.desc("score"), "d_aid"))
    both = annots.withColumn("_nth", nth).drop("score").join(names, ["q_aid", "d_nid"])
    return both.select("q_aid", "d_aid", "d_nid", F.when(F.col("_nth") == 1, F.col("score")).alias("score"))


def top_of_truth(rank: DataFrame, truth: DataFrame, n: int, same: bool) -> DataFrame:
    """The first n right (or wrong) names of each query; truth has q_aid and q_nid."""
    met = rank.join(truth, "q_aid").where((F.col("d_nid") == F.col("q_nid")) == same)
    return met.withColumn("place", F.row_number().over(W.partitionBy("q_aid").orderBy("rank"))).where(F.col("place") <= n).select("q_aid", "d_nid", "score", "rank", "place")


def summarize(rank: DataFrame, truth: DataFrame) -> DataFrame:
    """(q_aid, gt_rank, gt_score, gf_rank, gf_score): the best right and the best wrong name; null where none is."""
    met = rank.join(truth, "q_aid")
    gt = F.col("d_nid") == F.col("q_nid")
    best = lambda c, v: F.min_by(F.when(c, F.col(v)), F.when(c, F.col("rank")))
    return met.groupBy("q_aid").agg(F.min(F.when(gt, F.col("rank"))).alias("gt_rank"), best(gt, "score").alias("gt_score"), F.min(F.when(~gt, F.col("rank"))).alias("gf_rank"), best(~gt, "score").alias("gf_score"))


def cmc(summary: DataFrame, most: int) -> DataFrame:
    """(rank, queries, share): how many queries have their name at this rank or a better one."""
    ranks = summary.sparkSession.range(1, most + 1).select(F.col("id").alias("rank"))
    counts = summary.groupBy(F.col("gt_rank").cast("long").alias("rank")).agg(F.count(F.lit(1)).alias("n"))
    total = summary.agg(F.count(F.lit(1)).alias("total"))
    run = F.sum(F.coalesce("n", F.lit(0))).over(W.orderBy("rank"))
    return ranks.join(counts, "rank", "left").withColumn("queries", run).crossJoin(F.broadcast(total)).select("rank", "queries", F.try_divide(F.col("queries").cast("double"), F.col("total")).alias("share"))


def average_precision(rank: DataFrame, truth: DataFrame) -> DataFrame:
    """(q_aid, q_nid, ap): mean over right items of the precision at their ranks."""
    met = rank.join(truth, "q_aid").withColumn("hit", (F.col("d_nid") == F.col("q_nid")).cast("int"))
    run = met.withColumn("hits", F.sum("hit").over(W.partitionBy("q_aid").orderBy("rank")))
    return run.where("hit = 1").groupBy("q_aid", "q_nid").agg(F.avg(F.col("hits") / F.col("rank")).alias("ap"))


def case_filter(rank: DataFrame, truth: DataFrame, *, least_rank: int, per_name: int) -> DataFrame:
    """Queries whose right name comes at least this late, worst first, at most so many of one name."""
    hard = summarize(rank, truth).join(truth, "q_aid").where(F.col("gt_rank") >= least_rank)
    nth = F.row_number().over(W.partitionBy("q_nid").orderBy(F.desc("gt_rank"), "q_aid"))
    return hard.withColumn("nth", nth).where(F.col("nth") <= per_name).select("q_aid", "q_nid", "gt_rank", "nth")


def candidate_pairs(rank: DataFrame, reviewed: DataFrame, n: int) -> DataFrame:
    """(a, b): each query's best n observations as undirected pairs, those already reviewed left out."""
    top = rank.where(F.col("rank") <= n).select(F.least("q_aid", "d_aid").alias("a"), F.greatest("q_aid", "d_aid").alias("b")).where("a <> b").distinct()
    return top.join(reviewed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
