"""Visual words: assignment to centroids, inverted lists, aggregated residuals, the selective match kernel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldmark.functions.weights import idf, selectivity
from fieldmark.lineage import store
from fieldmark.operators.matching import knn


#: Rows of a vocabulary that may be broadcast; a larger one is joined by shuffle.
BROADCAST_WORDS = 10_000


def _small(words: DataFrame) -> DataFrame:
    return F.broadcast(words) if words.count() <= BROADCAST_WORDS else words


def train_vocabulary(descriptors: DataFrame, n: int, rounds: int = 10, seed: int = 0) -> DataFrame:
    """(word, vec): n centroids by k-means over all descriptors (fx, vec), begun with those whose ids hash least.

    Sums are combined by task before the shuffle; a word that no descriptor is nearest to stays where it is.
    """
    first = descriptors.select(F.md5(F.concat(F.col("fx").cast("string"), F.lit(f":{seed}"))).alias("h"), "fx", "vec").orderBy("h", "fx").limit(n)
    # n rows, numbered in one task.
    words = store(first.select((F.row_number().over(W.orderBy("h", "fx")) - 1).cast("long").alias("word"), F.col("vec").cast("array<double>").alias("vec")), "vocabulary")
    head = words.select(F.size("vec").alias("d")).first()
    for _ in range(rounds if head else 0):
        held = assign(descriptors, words).join(descriptors.select("fx", "vec"), "fx")
        means = held.groupBy("word").agg(F.array(*[F.avg(F.col("vec")[i].cast("double")) for i in range(head["d"])]).alias("mean"))
        words = store(words.join(means, "word", "left").select("word", F.coalesce("mean", "vec").alias("vec")), "vocabulary")
    return words


def assign(descriptors: DataFrame, words: DataFrame, n: int = 1) -> DataFrame:
    """(fx, word, dist, rank): the n nearest words of each descriptor."""
    near = knn(descriptors.select("fx", "vec"), words.select(F.col("word").alias("fx"), "vec"), n)
    return near.select(F.col("q_fx").alias("fx"), F.col("d_fx").alias("word"), "dist", "rank")


def weigh_assigns(assigned: DataFrame, alpha: float = 1.2, sigma: float = 80.0, equal: bool = False) -> DataFrame:
    """(fx, word, weight): words beyond alpha times the nearest distance go (the second nearest where that is 0); the
    others share a weight of 1, equally or by exp(-d / 2 sigma^2)."""
    w = W.partitionBy("fx")
    d0, d1 = F.min(F.when(F.col("rank") == 1, F.col("dist"))).over(w), F.min(F.when(F.col("rank") == 2, F.col("dist"))).over(w)
    base = F.when(d0 < 1e-9, F.coalesce(d1, d0)).otherwise(d0)
    kept = assigned.withColumn("_lim", alpha * (base + 0.001)).where((F.col("rank") == 1) | (F.col("dist") < F.col("_lim")))
    raw = F.lit(1.0) if equal else F.exp(-F.col("dist") / (2 * sigma * sigma))
    kept = kept.withColumn("_raw", raw)
    return kept.select("fx", "word", (F.col("_raw") / F.sum("_raw").over(w)).alias("weight"))


def inverted_list(assigned: DataFrame) -> DataFrame:
    """(word, aid, n): the observations that hold a word, and with how many descriptors."""
    return assigned.groupBy("word", "aid").agg(F.count(F.lit(1)).alias("n"))


def word_weights(assigned: DataFrame, total: DataFrame) -> DataFrame:
    """(word, n_aids, idf): total is a table of one row with n, the number of observations."""
    held = assigned.groupBy("word").agg(F.count_distinct("aid").alias("n_aids"))
    return held.crossJoin(F.broadcast(total)).select("word", "n_aids", idf(F.col("n").cast("double"), F.col("n_aids")).alias("idf"))


def word_weights_maw(assigned: DataFrame, total: DataFrame) -> DataFrame:
    """The same by soft counts: an observation counts for a word by its best assignment weight, at most 1."""
    held = assigned.groupBy("word", "aid").agg(F.max("weight").alias("w")).groupBy("word").agg(F.sum(F.least("w", F.lit(1.0))).alias("soft"))
    return held.crossJoin(F.broadcast(total)).select("word", "soft", idf(F.col("n").cast("double"), F.col("soft")).alias("idf"))


def aggregate_residuals(assigned: DataFrame, descriptors: DataFrame, words: DataFrame) -> DataFrame:
    """(aid, word, rvec): normalised sum of an observation's unit residuals at a word; null where it vanishes."""
    both = assigned.select("aid", "fx", "word").join(descriptors.select("fx", "vec"), "fx").join(_small(words.select("word", F.col("vec").alias("centre"))), "word")
    head = words.select(F.size("vec").alias("d")).first()
    squares = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x))
    parts = both.select("aid", "word", F.zip_with("vec", "centre", lambda a, b: a.cast("double") - b.cast("double")).alias("r")).withColumn("_n", squares("r"))
    unit = parts.withColumn("u", F.transform("r", lambda x: F.when(F.col("_n") > 1e-12, x / F.col("_n")).otherwise(0.0)))
    sums = unit.groupBy("aid", "word").agg(F.array(*[F.sum(F.col("u")[i]) for i in range(head["d"] if head else 0)]).cast("array<double>").alias("v"))
    return sums.withColumn("_n", squares("v")).select("aid", "word", F.when(F.col("_n") > 1e-9, F.transform("v", lambda x: x / F.col("_n"))).alias("rvec"))


def smk_scores(queries: DataFrame, database: DataFrame, weights: DataFrame, alpha: float = 3.0, least: float = 0.0, places: int = 6) -> DataFrame:
    """(q_aid, d_aid, score): gamma_q gamma_d sum over common words of weight times selectivity of the residuals' product.

    A residual that vanished matches with 1. Words are joined, so observations without a common word do not meet.
    """
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    match = lambda a, b: F.coalesce(selectivity(F.when(F.col(a).isNull() | F.col(b).isNull(), 1.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b)))), alpha, least), F.lit(0.0))
    w = weights.select("word", "idf")

    def gammas(side: DataFrame) -> DataFrame:
        own = side.join(w, "word").groupBy("aid").agg(F.sum(F.col("idf") * match("rvec", "rvec")).alias("g"))
        return own.select("aid", F.when(F.col("g") > 0, 1 / F.sqrt("g")).otherwise(0.0).alias("gamma"))

    q = queries.select("word", F.col("aid").alias("q_aid"), F.col("rvec").alias("x"))
    d = database.select("word", F.col("aid").alias("d_aid"), F.col("rvec").alias("y"))
    sums = q.join(d, "word").join(w, "word").groupBy("q_aid", "d_aid").agg(F.sum(F.col("idf") * match("x", "y")).alias("s"))
    gq, gd = gammas(queries).select(F.col("aid").alias("q_aid"), F.col("gamma").alias("gq")), gammas(database).select(F.col("aid").alias("d_aid"), F.col("gamma").alias("gd"))
    return sums.join(gq, "q_aid").join(gd, "d_aid").select("q_aid", "d_aid", F.round(F.col("s") * F.col("gq") * F.col("gd"), places).alias("score"))
