"""One observation against one other: matches inside a pair, what sums them up, and which of them agree in space.

A pair is (a, b); features are (aid, fx, vec) and, for spatial checks, x, y, scale and ori (radians). Pairs are dealt by
hash into buckets of about BUCKET_ROWS feature rows, each one Arrow call; a pair's features, which are as many as an
image has, are together in one bucket.
"""

from __future__ import annotations

import math
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.operators.matching import DIST_PLACES

BUCKET_ROWS = 20_000
RATIO = 0.8
#: Of the extent of the matched points, of scale, of a turn.
XY_SHARE, SCALE_FACTOR, ORI_TURN = 0.01, 2.0, math.tau / 4
#: Room for rounding in a distance between places.
SLACK = 1e-6


def _sides(pairs: DataFrame, features: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """The features of a and of b of each pair, both with the pair's bucket."""
    pairs = pairs.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL").distinct()
    weight = features.groupBy("aid").agg(F.count(F.lit(1)).alias("n"))
    rows = pairs.join(weight, F.col("a") == F.col("aid")).agg(F.sum("n").alias("n")).first()["n"] or 0
    dealt = pairs.withColumn("_bucket", F.pmod(F.xxhash64("a", "b"), F.lit(max(1, -(-rows // BUCKET_ROWS)))))
    side = lambda end: dealt.join(features.select(F.col("aid").alias(end), *columns), end).select("_bucket", "a", "b", *columns)
    right = side("b")
    # Columns of their own, for both sides come from one table.
    return side("a"), right.select(*[F.col(c).alias(c) for c in right.columns])


def _runs(t: Any) -> dict[tuple[int, int], np.ndarray]:
    """Row numbers of each pair, in order of fx."""
    a, b, fx = (t.column(c).to_numpy() for c in ("a", "b", "fx"))
    order = np.lexsort((fx, b, a))
    cut = np.flatnonzero(np.diff(a[order]) | np.diff(b[order])) + 1
    return {(int(a[r[0]]), int(b[r[0]])): r for r in np.split(order, cut) if len(r)}


def pair_matches(pairs: DataFrame, features: DataFrame, *, ratio: float = RATIO, mutual: bool = False, places: int = DIST_PLACES) -> DataFrame:
    """(a, b, fx1, fx2, dist, norm, ratio): each feature of a with its nearest of b, if that is nearer than `ratio` times the second nearest.

    mutual: only if the match is also fx2's nearest of a. Ties go to the lesser fx; equal distances of 0 have a ratio of 1;
    a feature of a pair whose b has a single feature has nothing to be told by, and no match.
    """
    left, right = _sides(pairs, features.where(F.col("vec").isNotNull()), "fx", "vec")

    def match(x: Any, y: Any) -> Any:
        import pyarrow as pa

        out: list[list[np.ndarray]] = [[] for _ in range(7)]
        if len(x) and len(y):
            mat = lambda t: t.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(t), -1)
            u, v, fu, fv = mat(x), mat(y), x.column("fx").to_numpy(), y.column("fx").to_numpy()
            theirs = _runs(y)
            for (a, b), i in _runs(x).items():
                j = theirs.get((a, b))
                if j is None or len(j) < 2:
                    continue
                # Differences, not a product, so that distances round as they do elsewhere; rows are taken in slices.
                dist = np.concatenate([np.round(np.sqrt(((u[i[s : s + 64], None] - v[None, j]) ** 2).sum(axis=2)), places) for s in range(0, len(i), 64)])
                order = np.argsort(dist, axis=1, kind="stable")[:, :2]
                one, two = dist[np.arange(len(i)), order[:, 0]], dist[np.arange(len(i)), order[:, 1]]
                share = np.where(two > 0, one / np.where(two > 0, two, 1), 1.0)
                good = share < ratio
                if mutual:
                    good &= dist.argmin(axis=0)[order[:, 0]] == np.arange(len(i))
                n = int(good.sum())
                for part, value in zip(out, (np.full(n, a), np.full(n, b), fu[i][good], fv[j][order[good, 0]], one[good], two[good], share[good]), strict=True):
                    part.append(value)
        kinds = [np.int64] * 4 + [np.float64] * 3
        return pa.table({c: np.concatenate(p) if p else np.empty(0, t) for c, p, t in zip(("a", "b", "fx1", "fx2", "dist", "norm", "ratio"), out, kinds, strict=True)})

    return left.groupBy("_bucket").cogroup(right.groupBy("_bucket")).applyInArrow(match, "a long, b long, fx1 long, fx2 long, dist double, norm double, ratio double")


def pair_features(pairs: DataFrame, matches: DataFrame, facts: DataFrame) -> DataFrame:
    """One row per pair for a classifier: how many matches, their distances and ratios, and the differences of the pair's facts.

    facts: aid and numeric columns; each gives delta_<name>, null where either is. Pairs without a match have 0 of them.
    """
    pairs = pairs.select("a", "b").distinct()
    ten = lambda c: c.cast("decimal(18,6)")
    local = matches.groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("matches"), (F.sum(ten(1 - F.col("ratio"))).cast("double")).alias("score"), F.min("dist").alias("least_dist"), F.min("ratio").alias("least_ratio"), F.max("ratio").alias("most_ratio"),
        F.round(F.avg("ratio"), 6).alias("mean_ratio"), F.median("dist").alias("median_dist"), F.count_distinct("fx2").alias("targets"),
    )
    names = [c for c in facts.columns if c != "aid"]
    of = lambda end: facts.select(F.col("aid").alias(end), *[F.col(c).alias(f"_{end}_{c}") for c in names])
    both = pairs.join(local, ["a", "b"], "left").join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.select("a", "b", F.coalesce("matches", F.lit(0)).alias("matches"), F.coalesce("score", F.lit(0.0)).alias("score"), "least_dist", "least_ratio", "most_ratio", "mean_ratio", "median_dist", F.coalesce("targets", F.lit(0)).alias("targets"), *[F.abs(F.col(f"_a_{c}") - F.col(f"_b_{c}")).alias(f"delta_{c}") for c in names])


def similarity(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """3 x 3 maps that take keypoint p[i] (x, y, scale, ori) onto q[i], turning and scaling as their frames do."""
    s, turn = q[:, 2] / p[:, 2], q[:, 3] - p[:, 3]
    c, d = s * np.cos(turn), s * np.sin(turn)
    out = np.zeros((len(p), 3, 3))
    out[:, 0, 0], out[:, 0, 1], out[:, 1, 0], out[:, 1, 1], out[:, 2, 2] = c, -d, d, c, 1
    out[:, 0, 2] = q[:, 0] - c * p[:, 0] + d * p[:, 1]
    out[:, 1, 2] = q[:, 1] - d * p[:, 0] - c * p[:, 1]
    return out


def errors(maps: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every map and match: distance in place, factor in scale (at least 1) and turn (0 to pi) between mapped p and q.

    Scale and turn of a map that is no similarity are those of its first derivative at p.
    """
    x, y = p[None, :, 0], p[None, :, 1]
    m = maps[:, :, :, None]
    w = m[:, 2, 0] * x + m[:, 2, 1] * y + m[:, 2, 2]
    w = np.where(np.abs(w) < 1e-12, 1e-12, w)
    u, v = (m[:, 0, 0] * x + m[:, 0, 1] * y + m[:, 0, 2]) / w, (m[:, 1, 0] * x + m[:, 1, 1] * y + m[:, 1, 2]) / w
    j = [[(m[:, r, c] - t * m[:, 2, c]) / w for c in (0, 1)] for r, t in ((0, u), (1, v))]
    scale = np.sqrt(np.abs(j[0][0] * j[1][1] - j[0][1] * j[1][0])) * p[None, :, 2]
    cos, sin = np.cos(p[None, :, 3]), np.sin(p[None, :, 3])
    turn = np.arctan2(j[1][0] * cos + j[1][1] * sin, j[0][0] * cos + j[0][1] * sin)
    factor = np.where(scale > 0, scale, 1e-12) / q[None, :, 2]
    away = np.abs((turn - q[None, :, 3] + np.pi) % (2 * np.pi) - np.pi)
    return np.hypot(u - q[None, :, 0], v - q[None, :, 1]), np.maximum(factor, 1 / factor), away


def inliers(maps: np.ndarray, p: np.ndarray, q: np.ndarray, near: float, factor: float = SCALE_FACTOR, turn: float = ORI_TURN) -> np.ndarray:
    xy, scale, ori = errors(maps, p, q)
    return (xy <= near + SLACK) & (scale <= factor) & (ori <= turn)


def extent(q: np.ndarray) -> float:
    """The diagonal of the matched points' box."""
    return float(np.hypot(np.ptp(q[:, 0]), np.ptp(q[:, 1]))) if len(q) else 0.0


def affine_fit(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Least squares, of three matches at least."""
    m = np.eye(3)
    m[:2] = np.linalg.lstsq(np.column_stack([p[:, :2], np.ones(len(p))]), q[:, :2], rcond=None)[0].T
    return m


def homography_fit(p: np.ndarray, q: np.ndarray) -> np.ndarray | None:
    """Direct linear transform of four matches at least, in coordinates of mean 0 and mean length sqrt 2; None if it is singular."""

    def normal(x: np.ndarray) -> np.ndarray:
        c = x[:, :2].mean(axis=0)
        s = math.sqrt(2) / max(float(np.hypot(*(x[:, :2] - c).T).mean()), 1e-12)
        return np.array([[s, 0, -s * c[0]], [0, s, -s * c[1]], [0, 0, 1]])

    t, r = normal(p), normal(q)
    x, y = (np.column_stack([a[:, :2], np.ones(len(a))]) @ n.T for a, n in ((p, t), (q, r)))
    zero = np.zeros_like(x)
    rows = np.vstack([np.hstack([-x, zero, x * y[:, :1]]), np.hstack([zero, -x, x * y[:, 1:2]])])
    _, values, v = np.linalg.svd(rows)
    if len(values) < 8 or values[7] < 1e-9 * values[0]:
        return None
    m = np.linalg.inv(r) @ v[-1].reshape(3, 3) @ t
    return m / m[2, 2] if abs(m[2, 2]) > 1e-12 else None


def verify_matches(p: np.ndarray, q: np.ndarray, *, refine: str = "homography", share: float = XY_SHARE, factor: float = SCALE_FACTOR, turn: float = ORI_TURN) -> tuple[int, np.ndarray, np.ndarray]:
    """(hypothesis, map, inlier flags): the match whose own map most others agree with, ties to the first, then a fit to those.

    A fit that loses more inliers than it had minimal points for, or has too few of them, is not used.
    """
    near = share * extent(q)
    # Maps of all matches against all matches, in slices.
    count = np.concatenate([inliers(similarity(p[s : s + 128], q[s : s + 128]), p, q, near, factor, turn).sum(axis=1) for s in range(0, len(p), 128)])
    best = int(count.argmax())
    first = similarity(p[best : best + 1], q[best : best + 1])[0]
    flags = inliers(first[None], p, q, near, factor, turn)[0]
    fit = None
    if refine == "homography" and flags.sum() >= 4:
        fit = homography_fit(p[flags], q[flags])
    if fit is None and refine != "none" and flags.sum() >= 3:
        fit = affine_fit(p[flags], q[flags])
    if fit is not None:
        again = inliers(fit[None], p, q, near, factor, turn)[0]
        if again.sum() >= flags.sum():
            return best, fit, again
    return best, first, flags


def spatially_verified(matches: DataFrame, keypoints: DataFrame, *, refine: str = "homography", share: float = XY_SHARE, factor: float = SCALE_FACTOR, turn: float = ORI_TURN) -> DataFrame:
    """(a, b, fx1, fx2, hypothesis, xy_err, scale_err, ori_err): the matches of each pair that agree on one map from a to b.

    matches: a, b, fx1, fx2; keypoints: aid, fx, x, y, scale, ori. refine: 'none', 'affine' or 'homography'; hypothesis is fx1
    of the match whose map was the best. Put a shortlist before it: a pair costs the square of its matches.
    """
    at = lambda end, fx: keypoints.select(F.col("aid").alias(end), F.col("fx").alias(fx), *[F.col(c).cast("double").alias(f"{c}_{end}") for c in ("x", "y", "scale", "ori")])
    placed = matches.select("a", "b", "fx1", "fx2").join(at("a", "fx1"), ["a", "fx1"]).join(at("b", "fx2"), ["b", "fx2"]).where("scale_a > 0 AND scale_b > 0")
    rows = matches.count()
    placed = placed.withColumn("_bucket", F.pmod(F.xxhash64("a", "b"), F.lit(max(1, -(-rows // BUCKET_ROWS)))))

    def check(t: Any) -> Any:
        import pyarrow as pa

        t = t.sort_by([("a", "ascending"), ("b", "ascending"), ("fx1", "ascending"), ("fx2", "ascending")])
        a, b, fx1, fx2 = (t.column(c).to_numpy() for c in ("a", "b", "fx1", "fx2"))
        p, q = (np.column_stack([t.column(f"{c}_{end}").to_numpy() for c in ("x", "y", "scale", "ori")]) for end in "ab")
        cut = np.flatnonzero(np.diff(a) | np.diff(b)) + 1
        parts: list[list[np.ndarray]] = [[] for _ in range(5)]
        for r in np.split(np.arange(len(a)), cut):
            if not len(r):
                continue
            best, m, flags = verify_matches(p[r], q[r], refine=refine, share=share, factor=factor, turn=turn)
            xy, scale, ori = (e[0][flags] for e in errors(m[None], p[r], q[r]))
            for part, value in zip(parts, (r[flags], np.full(int(flags.sum()), fx1[r[best]]), xy, scale, ori), strict=True):
                part.append(value)
        rows_, hypothesis, xy, scale, ori = (np.concatenate(x) if x else np.empty(0) for x in parts)
        at_ = rows_.astype(np.int64)
        return pa.table({"a": a[at_], "b": b[at_], "fx1": fx1[at_], "fx2": fx2[at_], "hypothesis": hypothesis.astype(np.int64), "xy_err": xy, "scale_err": scale, "ori_err": ori})

    return placed.groupBy("_bucket").applyInArrow(check, "a long, b long, fx1 long, fx2 long, hypothesis long, xy_err double, scale_err double, ori_err double")
