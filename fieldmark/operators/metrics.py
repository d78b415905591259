"""Evaluation: precision and recall, curves, confusion, boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldmark.functions.geometry import iou
from fieldmark.operators.prefix import sums_before


def pr_grid(pred: DataFrame, steps: int = 100) -> DataFrame:
    """(conf, tp, fp, fn, precision, recall) at thresholds 0 to 1: positive where the threshold is at most the score.

    pred: score, truth (boolean). Scores are first counted by grid cell, so rows do not meet all thresholds; thresholds
    where precision or recall would divide by nothing are left out.
    """
    cells = pred.groupBy(F.least(F.floor(F.col("score") * steps + 1e-9), F.lit(steps)).alias("i")).agg(F.count_if("truth").alias("p"), F.count_if(~F.col("truth")).alias("n"))
    grid = pred.sparkSession.range(0, steps + 1).select(F.col("id").alias("i")).join(cells, "i", "left").na.fill(0, ["p", "n"])
    down, all_rows = W.orderBy(F.desc("i")), W.partitionBy(F.lit(0))
    rows = grid.select("i", F.sum("p").over(down).alias("tp"), F.sum("n").over(down).alias("fp"), F.sum("p").over(all_rows).alias("_pos"))
    rows = rows.withColumn("fn", F.col("_pos") - F.col("tp")).where("tp + fp > 0 AND tp + fn > 0")
    return rows.select((F.col("i") / steps).alias("conf"), "tp", "fp", "fn", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("tp") / (F.col("tp") + F.col("fn"))).alias("recall"))


def interpolated(curve: DataFrame) -> DataFrame:
    """curve with interp: the greatest precision at this recall or a higher one."""
    w = W.orderBy(F.desc("recall")).rangeBetween(W.unboundedPreceding, W.currentRow)
    return curve.withColumn("interp", F.max("precision").over(w))


def average_precision_at(curve: DataFrame, points: int = 11) -> DataFrame:
    """One row: mean of the interpolated precision at recalls 0, 1/(points-1), ..., 1."""
    grid = curve.sparkSession.range(points).select((F.col("id") / (points - 1)).alias("r"))
    met = grid.join(curve, F.col("recall") >= F.col("r") - 1e-12, "left").groupBy("r").agg(F.coalesce(F.max("precision"), F.lit(0.0)).alias("p"))
    return met.agg(F.avg("p").alias("ap"))


def operating_point(curve: DataFrame) -> DataFrame:
    """The point of the curve nearest to precision and recall of 1; ties to the least threshold."""
    d = F.sqrt(F.pow(1 - F.col("precision"), 2) + F.pow(1 - F.col("recall"), 2))
    return curve.withColumn("dist", F.round(d, 9)).orderBy("dist", "conf").limit(1).select("conf", "precision", "recall", "dist")


def confusion(pred: DataFrame) -> DataFrame:
    return pred.groupBy("truth", "predicted").agg(F.count(F.lit(1)).alias("n"))


def auc(pred: DataFrame) -> DataFrame:
    """One row: area under the ROC curve from scores counted by value, ties halved."""
    per = pred.groupBy("score").agg(F.count_if("truth").alias("p"), F.count_if(~F.col("truth")).alias("n"))
    wins = sums_before(per, "score", "n").withColumn("w", F.col("p") * (F.col("n_before") + F.col("n") / 2.0))
    return wins.agg(F.try_divide(F.sum("w"), (F.sum("p") * F.sum("n")).cast("double")).alias("auc"))


def binary_report(pred: DataFrame) -> DataFrame:
    """One row: counts, precision, recall, fpr, markedness, bookmaker informedness and the Matthews correlation."""
    c = lambda t, p: F.count_if((F.col("truth") == t) & (F.col("predicted") == p)).cast("double")
    n = pred.agg(c(True, True).alias("tp"), c(False, True).alias("fp"), c(True, False).alias("fn"), c(False, False).alias("tn"))
    n = n.withColumn("precision", F.try_divide("tp", F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide("tp", F.col("tp") + F.col("fn"))).withColumn("fpr", F.try_divide("fp", F.col("fp") + F.col("tn")))
    n = n.withColumn("markedness", F.col("precision") + F.try_divide("tn", F.col("tn") + F.col("fn")) - 1).withColumn("bookmaker", F.col("recall") - F.col("fpr"))
    root = F.sqrt((F.col("tp") + F.col("fp")) * (F.col("tp") + F.col("fn")) * (F.col("tn") + F.col("fp")) * (F.col("tn") + F.col("fn")))
    return n.withColumn("mcc", F.try_divide(F.col("tp") * F.col("tn") - F.col("fp") * F.col("fn"), root))


def threshold_at_fpr(pred: DataFrame, most: float) -> DataFrame:
    """One row: the least score at which no more than this share of negatives passes."""
    per = pred.groupBy("score").agg(F.count_if(~F.col("truth")).alias("n"))
    per = sums_before(per, "score", "n").crossJoin(F.broadcast(per.agg(F.sum("n").alias("all"))))
    return per.withColumn("fpr", F.try_divide(F.col("all") - F.col("n_before"), F.col("all").cast("double"))).where(F.col("fpr") <= most).agg(F.min("score").alias("thresh"))


def iou_pairs(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """(image, t, p, conf, iou) of the boxes of one image."""
    box = lambda s: tuple(F.col(f"{s}_{c}") for c in ("x", "y", "w", "h"))
    a = truth.select("image", F.col("id").alias("t"), *[F.col(c).alias(f"t_{c}") for c in ("x", "y", "w", "h")])
    b = pred.select("image", F.col("id").alias("p"), "conf", *[F.col(c).alias(f"p_{c}") for c in ("x", "y", "w", "h")])
    return a.join(b, "image").select("image", "t", "p", "conf", iou(box("t"), box("p")).alias("iou"))


def _won(overlaps: DataFrame, least: float) -> DataFrame:
    """The overlaps that count: a prediction's box is the truth that it overlaps most, if by more than `least`; of several
    predictions of one truth the surest counts."""
    best = overlaps.where(F.col("iou") > least).withColumn("_n", F.row_number().over(W.partitionBy("image", "p").orderBy(F.desc("iou"), "t"))).where("_n = 1")
    return best.withColumn("_m", F.row_number().over(W.partitionBy("image", "t").orderBy(F.desc("conf"), "p"))).where("_m = 1")


def assign_boxes(overlaps: DataFrame, truth: DataFrame, pred: DataFrame, least: float) -> DataFrame:
    """One row (tp, fp, fn): a prediction's box is the truth that it overlaps most, if by more than `least`; of several
    predictions of one truth the surest counts."""
    tp = _won(overlaps, least).agg(F.count(F.lit(1)).alias("tp"))
    return tp.crossJoin(pred.agg(F.count(F.lit(1)).alias("_p"))).crossJoin(truth.agg(F.count(F.lit(1)).alias("_t"))).select("tp", (F.col("_p") - F.col("tp")).alias("fp"), (F.col("_t") - F.col("tp")).alias("fn"))


def cumulative_tp_fp(overlaps: DataFrame, pred: DataFrame, least: float) -> DataFrame:
    """(conf, tp, fp): boxes right and wrong among those predicted with at least this confidence, a row for each confidence.

    Boxes are assigned as by assign_boxes; no confidence is read as the least of all.
    """
    right = _won(overlaps, least).groupBy("conf").agg(F.count(F.lit(1)).alias("_tp"))
    per = pred.groupBy("conf").agg(F.count(F.lit(1)).alias("_all")).withColumnRenamed("conf", "_conf")
    per = per.join(right, F.col("_conf").eqNullSafe(F.col("conf")), "left").select(F.col("_conf").alias("conf"), F.coalesce("_tp", F.lit(0)).alias("_tp"), "_all")
    # Nulls come first in ascending order, so confidences are turned round within a pair.
    placed = sums_before(per.withColumn("_at", F.struct(F.col("conf").isNull().alias("none"), (-F.col("conf")).alias("down"))), "_at", "_tp", "_all")
    tp = F.col("_tp_before") + F.col("_tp")
    return placed.select("conf", tp.alias("tp"), (F.col("_all_before") + F.col("_all") - tp).alias("fp"))


def rank_histogram(ranks: DataFrame, edges: list[int]) -> DataFrame:
    """(config, bin, n): queries by rank in bins [edge, next), the last one closed."""
    last = len(edges) - 2
    which = F.when(F.col("rank") == edges[-1], last)
    for i, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
        which = which.when((F.col("rank") >= low) & (F.col("rank") < high), i)
    return ranks.withColumn("bin", which).where(F.col("bin").isNotNull()).groupBy("config", "bin").agg(F.count(F.lit(1)).alias("n"))


def less_than(ranks: DataFrame, limits: list[int]) -> DataFrame:
    """One row per config: how many ranks lie below each limit."""
    return ranks.groupBy("config").agg(*[F.count_if(F.col("rank") < x).alias(f"below_{x}") for x in limits])


def config_overlap(ranks: DataFrame, most: int) -> DataFrame:
    """(a, b, both, either): queries that two configs, or one of them, answer by this rank; ranks: config, query, rank."""
    won = ranks.where(F.col("rank") <= most).select("config", "query").distinct()
    sizes = won.groupBy("config").agg(F.count(F.lit(1)).alias("n"))
    both = won.select(F.col("config").alias("a"), "query").join(won.select(F.col("config").alias("b"), "query"), "query").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("both"))
    both = both.join(sizes.select(F.col("config").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("config").alias("b"), F.col("n").alias("nb")), "b")
    return both.select("a", "b", "both", (F.col("na") + F.col("nb") - F.col("both")).alias("either"))


def differing(ranks: DataFrame) -> DataFrame:
    """Queries whose rank is not the same under all configs."""
    return ranks.groupBy("query").agg(F.min("rank").alias("best"), F.max("rank").alias("worst")).where("best <> worst")


def ensemble(votes: DataFrame, hard: bool = False) -> DataFrame:
    """(sample, cls, score): the class of greatest weighted mean probability, or of most weighted votes; ties to the least.

    votes: model, sample, cls, p, weight.
    """
    if hard:
        top = F.row_number().over(W.partitionBy("model", "sample").orderBy(F.desc("p"), "cls"))
        sums = votes.withColumn("_i", top).where(F.col("_i") == 1).groupBy("sample", "cls").agg(F.sum("weight").alias("score"))
    else:
        sums = votes.groupBy("sample", "cls").agg((F.sum(F.col("p") * F.col("weight")) / F.sum("weight")).alias("score"))
    return sums.withColumn("_i", F.row_number().over(W.partitionBy("sample").orderBy(F.desc("score"), "cls"))).where(F.col("_i") == 1).drop("_i")


def predict_with_thresholds(pred: DataFrame, thresholds: list[float], force: bool = False, multi: bool = True) -> DataFrame:
    """pred with cls: of the classes of array p those over their thresholds; none: null, or the likeliest if forced;
    several: the likeliest, or null unless multi."""
    over = F.size(F.filter(F.arrays_zip(F.col("p").alias("p"), F.array(*[F.lit(t) for t in thresholds]).alias("t")), lambda x: x["p"] > x["t"]))
    passed = F.transform(F.arrays_zip(F.col("p").alias("p"), F.array(*[F.lit(t) for t in thresholds]).alias("t")), lambda x: F.when(x["p"] > x["t"], x["p"]).otherwise(-1.0))
    best, likeliest = F.array_position(passed, F.array_max(passed)) - 1, F.array_position("p", F.array_max("p")) - 1
    chosen = F.when(over == 0, likeliest if force else F.lit(None)).when((over == 1) | F.lit(multi), best)
    return pred.withColumn("cls", chosen.cast("int"))


def hardness(pred: DataFrame) -> DataFrame:
    """(sample, margin, failed): the true class's probability less the greatest of the others; pred: sample, truth, p."""
    p, t = F.col("p"), F.col("truth")
    others = F.filter(F.transform(p, lambda x, i: F.when(i != t, x)), lambda x: x.isNotNull())
    margin = F.element_at(p, t + 1) - F.array_max(others)
    return pred.select("sample", margin.alias("margin"), (margin < 0).alias("failed"))


def trapezoid(curve: DataFrame, x: str, y: str) -> DataFrame:
    """One row: area under a curve by trapezoids in order of x."""
    w = W.orderBy(x, y)
    return curve.select(((F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2).alias("a")).agg(F.sum("a").alias("area"))
