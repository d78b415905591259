"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets the exponential key -ln(u) / w, u being a keyed hash of its id and w its quality weight; within a
source, documents in ascending key order form a weighted sample without replacement of any length. A source's target is
first served by whole epochs; what is left selects the prefix of the key order whose sizes sum to the remainder.

Scale: no source is ever sorted as a whole. The logarithms of keys are cut into as many ranges as keep a few thousand
documents each; sums by (source, range) tell in which range the budget ends, and only that range is ordered
by row. Hot sources are thus spread over all tasks.

Edge cases: a null text has size 0; a null source is a source of its own, sorted last; sizes of 0 are taken 0 times
words; ties of key are ordered by id, then by size; identical rows that straddle the budget split it among themselves;
an empty table gives an empty result; a null id hashes as the empty text; the pipeline's stage carries all columns of
docs, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldmark.llm._base import quoted, store, table, word_count

#: Documents for each key range, on average.
RANGE_ROWS = 4000
SYMBOLS = "!\"#$%&()*+/0123456789;<=>?@[\\]^_`{|}~"


def quality_weight(text: Column) -> Column:
    """1 less the share of symbols and digits, at least 0.05; 0.05 for null and empty texts."""
    n = F.length(text)
    rest = F.length(F.translate(text, SYMBOLS, ""))
    return F.when(n > 0, F.greatest(rest / n, F.lit(0.05))).otherwise(0.05)


def unit_hash(key: Column, seed: int) -> Column:
    """A number in (0, 1) from 52 bits of the md5 of seed and key."""
    head = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary")), 1, 13)
    return (F.conv(head, 16, 10).cast("double") + 0.5) / F.lit(2.0**52)


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size) -> with weight and target.

    Sources in code-point order, null last, get the weights in turn; share times all sizes is split by weight, no target
    above cap times its source's size, the excess reshared. The level at which the uncapped ones stand is found in one
    pass over sources sorted by the level at which each caps. One row per source, in one task.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("_r", (F.row_number().over(by_name) - 1) % len(weights))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("_r") + 1))
    full = F.lit(cap) * F.col("source_size")
    by_level = W.orderBy(full / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    after = by_level.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = by_level.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum(full).over(before), F.lit(0.0))) / F.sum("weight").over(after)
    # A source caps while the level that its predecessors leave exceeds its own cap; the first that does not sets it.
    ranked = ranked.withColumn("_level", level).withColumn("_free", F.col("_level") * F.col("weight") < full)
    found = F.min(F.when(F.col("_free"), F.struct(full / F.col("weight"), F.col("_level")))).over(W.partitionBy(F.lit(0)))
    return ranked.withColumn("_at", found).select("source", "source_size", "weight", F.when(F.col("_at").isNull() | ~(full / F.col("weight") >= F.col("_at")["col1"]), full).otherwise(F.least(full, F.col("_at._level") * F.col("weight"))).alias("target"))


def mix(
    docs: DataFrame, *, size: Column, weight: Column, source: str = "source", key: str = "doc_id", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 17, boundary: str = "cut", carry: tuple[str, ...] = ()
) -> DataFrame:
    """One row per document: key, source, carry columns, size, source_size, target, epochs, picked, taken.

    boundary: what happens to the document in which a budget ends: "cut" takes its first words up to the budget, "whole"
    takes it if at least half of it lies within the budget. taken = epochs * size + what the fractional pass takes.
    """
    if boundary not in ("cut", "whole"):
        raise ValueError(boundary)
    keyed = docs.select(F.col(key), F.col(source).alias("source"), *carry, size.cast("long").alias("size"), (-F.log(unit_hash(F.col(key), seed)) / weight).alias("_key"))
    keyed = store(keyed, "mix-keys")
    sizes = keyed.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_n"))
    plan = targets(sizes, weights, share, cap).join(sizes.select(F.col("source").alias("_s"), "_n"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("_budget", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size")))
    plan = plan.withColumn("_ranges", F.ceil(F.col("_n") / RANGE_ROWS)).select(F.col("source").alias("_src"), "source_size", "target", "epochs", "_budget", "_ranges")
    plan = store(plan, "mix-plan")
    rows = keyed.join(plan, F.col("source").eqNullSafe(F.col("_src")))
    # The logarithm of an exponential variable of any rate has a density of 1/e at most, so no range holds more than its
    # share of rows, however weights differ.
    rows = rows.withColumn("_range", F.floor(F.log("_key") * F.col("_ranges")).cast("long"))
    sums = rows.groupBy("_src", "_range").agg(F.sum("size").alias("_in"), F.first("_budget").alias("_budget"))
    # Prefix sums in two steps, so that a hot source's ranges do not queue in one task.
    sums = sums.withColumn("_block", F.floor(F.col("_range") / 1024))
    blocks = sums.groupBy("_src", "_block").agg(F.sum("_in").alias("_b"))
    blocks = blocks.withColumn("_base", F.coalesce(F.sum("_b").over(W.partitionBy("_src").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    blocks = blocks.select(F.col("_src").alias("_src2"), F.col("_block").alias("_block2"), "_base")
    sums = sums.join(blocks, F.col("_src").eqNullSafe(F.col("_src2")) & (F.col("_block") == F.col("_block2")))
    run = W.partitionBy("_src", "_block").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.col("_base") + F.coalesce(F.sum("_in").over(run), F.lit(0)))
    ends = sums.where((F.col("_before") < F.col("_budget")) & (F.col("_before") + F.col("_in") > F.col("_budget")))
    # One range per source, at most, holds its budget's end.
    ends = store(ends.select(F.col("_src").alias("_src3"), F.col("_range").alias("_end"), "_before"), "mix-ends")
    whole = sums.where(F.col("_before") + F.col("_in") <= F.col("_budget")).groupBy("_src").agg(F.max("_range").alias("_upto"))
    whole = store(whole.select(F.col("_src").alias("_src4"), "_upto"), "mix-whole")
    rows = rows.join(ends, F.col("_src").eqNullSafe(F.col("_src3")), "left").join(whole, F.col("_src").eqNullSafe(F.col("_src4")), "left")
    at_end = F.col("_range") == F.col("_end")
    rest = rows.where(~F.coalesce(at_end, F.lit(False)))
    # Where the budget is 0, ranges before any positive size still sum to no more than it: take nothing of them.
    picked = (F.col("_range") <= F.col("_upto")) & (F.col("_budget") > 0)
    rest = rest.withColumn("_part", F.when(picked, F.col("size")).otherwise(0).cast("long")).withColumn("picked", F.coalesce(picked, F.lit(False)))
    order = W.partitionBy("_src", "_range").orderBy("_key", F.col(key).asc_nulls_first(), "size").rowsBetween(W.unboundedPreceding, -1)
    edge = rows.where(at_end).withColumn("_gone", F.col("_before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    left = F.col("_budget") - F.col("_gone")
    if boundary == "cut":
        part = F.least(F.col("size"), F.greatest(F.lit(0), F.floor(left))).cast("long")
        edge = edge.withColumn("_part", part).withColumn("picked", F.col("_part") > 0)
    else:
        edge = edge.withColumn("picked", left * 2 >= F.greatest(F.col("size"), F.lit(1))).withColumn("_part", F.when(F.col("picked"), F.col("size")).otherwise(0).cast("long"))
    out = ("source_size", "target", "epochs")
    final = rest.select(key, "source", *carry, "size", *out, "picked", "_part").unionByName(edge.select(key, "source", *carry, "size", *out, "picked", "_part"))
    return final.withColumn("taken", F.col("epochs") * F.col("size") + F.col("_part")).drop("_part")


def emit(mixed: DataFrame) -> DataFrame:
    """Each document as often as the mix takes it: its epochs, and once more if picked. Needs boundary="whole"."""
    times = F.col("epochs").cast("int") + F.col("picked").cast("int")
    return mixed.withColumn("_copy", F.explode(F.when(times > 0, F.sequence(F.lit(1), times)))).drop("_copy", "size", "source_size", "target", "epochs", "picked", "taken")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mix(docs, size=word_count(F.col("text")), weight=quality_weight(F.col("text")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "epochs")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents as often as the mix takes them; the columns of docs."""
    # A row travels as one struct, so that no column of docs meets one of the mix.
    packed = docs.select("doc_id", "source", word_count(F.col("text")).alias("n"), quality_weight(F.col("text")).alias("w"), F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"))
    mixed = mix(packed, size=F.col("n"), weight=F.col("w"), boundary="whole", carry=("row",))
    return emit(mixed).select("row.*")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    CASE WHEN length(text) > 0 THEN greatest(length(translate(text, '!"#$%&()*+/0123456789;<=>?@[\]^_`{|}~', ''))::DOUBLE / length(text), 0.05) ELSE 0.05 END AS w,
    (('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM s),
l AS (SELECT *, 2.0 * source_size / w AS top,
    (1.5 * sum(source_size) OVER () - coalesce(sum(2.0 * source_size) OVER (ORDER BY 2.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (ORDER BY 2.0 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM r),
f AS (SELECT min(top) AS top0, arg_min(lev, top) AS lev0 FROM l WHERE lev * w < 2.0 * source_size),
t AS (SELECT source, source_size, CASE WHEN top >= top0 THEN least(2.0 * source_size, lev0 * w) ELSE 2.0 * source_size END::DOUBLE AS target FROM l, f),
k AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS epochs,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln(u) / w, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, source, epochs,
  (epochs * size + least(size, greatest(0, floor(target - epochs * source_size - gone))))::BIGINT AS taken
FROM k
"""
