"""Pairs to train a verifier on: drawn at random by component, or taken from reviews in balance. No pairs of all rows are made.

A component of n nodes has M = n(n-1)/2 pairs. They are numbered, and a walk k -> (start + k * step) mod M with a step that
shares no factor with M visits each number once; its first numbers are the draw. So a draw costs what it returns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldmark.lineage import store
from fieldmark.operators.cohort import hash_order
from fieldmark.operators.components_deep import bridges
from fieldmark.operators.graph import inconsistent, labelled
from fieldmark.operators.prefix import sums_before

#: Primes for steps; a step that divides M is passed over. No M below their product is divided by all three.
STEPS = (2147483647, 1000000007, 998244353)
BLOCK, BUCKETS = 4096, 256


def _walk(k: Column, m: Column, start: Column) -> Column:
    """The k-th number below m; whole-number arithmetic that cannot overflow: decimals of 38 digits."""
    step = F.coalesce(*[F.when(m % p != 0, F.lit(p)) for p in STEPS])
    wide = lambda c: c.cast("decimal(19,0)")
    return ((wide(k) * wide(step) + wide(F.pmod(start, m))) % wide(m)).cast("long")


def _unrank(i: Column) -> tuple[Column, Column]:
    """The i-th pair (x, y), x < y, of 0, 1, ...: pairs by y, then x. The root is mended by one where doubles round it."""
    y = F.floor((F.sqrt(i.cast("double") * 8 + 1) + 1) / 2).cast("long")
    y = F.when(F.shiftright(y * (y - 1), 1) > i, y - 1).when(F.shiftright(y * (y + 1), 1) <= i, y + 1).otherwise(y)
    return i - F.shiftright(y * (y - 1), 1), y


def _numbered(nodes: DataFrame, by: str, key: str) -> DataFrame:
    """nodes with pos, from 0 within `by`: by buckets of a hash first, so a large group is not ordered in one task."""
    at = nodes.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(BUCKETS)))
    counts = at.groupBy(by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    nth = F.row_number().over(W.partitionBy(by, "_b").orderBy(key)) - 1
    return at.withColumn("_i", nth).join(counts.select(by, "_b", before.alias("_base")), [by, "_b"]).withColumn("pos", F.col("_base") + F.col("_i")).drop("_b", "_i", "_base")


def _draws(groups: DataFrame, n: str) -> DataFrame:
    """groups with k = 0 .. n-1: blocks first, dealt out, then the numbers of a block."""
    blocks = groups.where(F.col(n) > 0).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / BLOCK))))
    first = F.col("_block") * BLOCK
    return blocks.repartition("_block", *groups.columns[:1]).withColumn("k", F.explode(F.sequence(first, F.least(first + BLOCK, F.col(n)) - 1))).drop("_block")


def _first(rows: DataFrame, by: str, n: str) -> DataFrame:
    """Of each group the n rows of least k: counts by block of k, then within the block."""
    at = rows.withColumn("_block", F.floor(F.col("k") / BLOCK))
    counts = at.groupBy(by, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(by).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = at.join(counts.select(by, "_block", before.alias("_base")), [by, "_block"])
    return placed.withColumn("_i", F.row_number().over(W.partitionBy(by, "_block").orderBy("k"))).where(F.col("_base") + F.col("_i") <= F.col(n)).drop("_block", "_base", "_i")


def random_pairs(roots: DataFrame, known: DataFrame, target: int, seed: int = 0, least: int = 2) -> DataFrame:
    """(a, b, kind): `target` pairs, or fewer if there are fewer. roots is (node, root), known (a, b) with a < b.

    kind 'known' are the known pairs, which all count. Half of what is missing comes from within components ('same'), evenly:
    each gives at least `least`, or all the pairs it has. The rest are pairs of nodes of two components ('different'), one
    for a pair of components. No drawn pair is known, and quotas are met exactly: a draw is longer by the number of known
    pairs that it may meet. An empty table gives the known pairs only.
    """
    known = store(known.select("a", "b").distinct(), "known-pairs")
    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    n_known, n_groups = known.count(), sizes.count()
    if not n_groups:
        return known.withColumn("kind", F.lit("known"))
    each = max(least, int(max(target - n_known, 0) / n_groups / 2))
    nodes = store(_numbered(roots, "root", "node"), "numbered")
    inside = labelled(known.withColumn("state", F.lit("")), roots).where("r1 = r2").groupBy(F.col("r1").alias("root")).agg(F.count(F.lit(1)).alias("have"))
    m = F.shiftright(F.col("size") * (F.col("size") - 1), 1)
    groups = sizes.where("size > 1").join(inside, "root", "left").select("root", m.alias("m"), F.coalesce("have", F.lit(0)).alias("have"))
    groups = groups.withColumn("draw", F.least("m", F.col("have") + each)).withColumn("most", F.lit(each))
    x, y = _unrank(_walk(F.col("k"), F.col("m"), F.xxhash64("root", F.lit(seed))))
    drawn = _draws(groups, "draw").select("root", "k", "most", x.alias("x"), y.alias("y"))
    at = lambda pos, name, root="root": nodes.select(F.col("root").alias(root), F.col("pos").alias(pos), F.col("node").alias(name))
    pair = [F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")]
    same = drawn.join(at("x", "p"), ["root", "x"]).join(at("y", "q"), ["root", "y"]).select("root", "k", "most", *pair)
    same = store(_first(same.join(known, ["a", "b"], "left_anti"), "root", "most").select("a", "b"), "same-pairs")
    need = max(target - n_known - same.count(), 0)
    total = n_groups * (n_groups - 1) // 2
    draw = min(total, need + n_known)
    spark = roots.sparkSession
    ranked = store(_numbered(sizes.withColumn("all", F.lit(0)), "all", "root"), "numbered-components")
    u, v = _unrank(_walk(F.col("k"), F.lit(max(total, 1)), F.lit(seed)))
    # Numbers of the draw come from a range, which Spark deals out by itself.
    pairs = spark.range(draw).select(F.col("id").alias("k"), u.alias("u"), v.alias("v"))
    side = lambda c, name: ranked.select(F.col("pos").alias(c), F.col("root").alias(f"r{c}"), F.col("size").alias(f"n{c}"))
    pairs = pairs.join(side("u", "ru"), "u").join(side("v", "rv"), "v")
    pairs = pairs.select("k", "ru", "rv", F.pmod(F.xxhash64("k", F.lit(seed), "ru"), F.col("nu")).alias("x"), F.pmod(F.xxhash64("k", F.lit(seed), "rv"), F.col("nv")).alias("y"))
    other = pairs.join(at("x", "p", "ru"), ["ru", "x"]).join(at("y", "q", "rv"), ["rv", "y"]).select("k", *pair).join(known, ["a", "b"], "left_anti")
    other = _first(other.withColumn("all", F.lit(0)).withColumn("most", F.lit(need)), "all", "most").select("a", "b")
    return known.withColumn("kind", F.lit("known")).unionByName(same.withColumn("kind", F.lit("same"))).unionByName(other.withColumn("kind", F.lit("different")))


def review_pairs(edges: DataFrame, roots: DataFrame, seed: int = 0, balance: float = 1.2) -> DataFrame:
    """(a, b, state) of match, nomatch, notcomp: reviewed edges, at most `balance` times as many of a state as the rarer of match
    and nomatch has. edges are (a, b, state, by_user).

    Edges that touch an inconsistent component do not count. Others count if a user made them, if they say nomatch, or if
    they are match edges that are no bridges. Which of too many are kept goes by a hash.
    """
    bad = inconsistent(edges, roots).select("root")
    rows = labelled(edges, roots).join(bad.withColumnRenamed("root", "r1"), "r1", "left_anti").join(bad.withColumnRenamed("root", "r2"), "r2", "left_anti")
    rows = rows.where("state in ('match', 'nomatch', 'notcomp')").join(bridges(edges).select("a", "b", F.lit(True).alias("bridge")), ["a", "b"], "left")
    sure = F.col("by_user") | (F.col("state") == "nomatch") | ((F.col("state") == "match") & F.col("bridge").isNull())
    kept = rows.where(sure).select("a", "b", "state").distinct()
    kept = store(kept.withColumn("_h", hash_order(F.concat_ws(":", "a", "b"), seed)).withColumn("_one", F.lit(1)), "review-pairs")
    n = {r["state"]: r["n"] for r in kept.groupBy("state").agg(F.count(F.lit(1)).alias("n")).collect()}
    most = int(balance * min(n.get("match", 0), n.get("nomatch", 0)))
    first = [sums_before(kept.where(F.col("state") == s), "_h", "_one").where(F.col("_one_before") < most).select("a", "b", "state") for s in ("match", "nomatch", "notcomp")]
    return first[0].unionByName(first[1]).unionByName(first[2])
