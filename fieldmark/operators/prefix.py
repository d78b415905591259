"""Sums along an order that no single task has to sort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldmark.lineage import store


def sums_before(df: DataFrame, order: str, *columns: str) -> DataFrame:
    """df with <column>_before: the column's sum over the rows before a row in ascending order, 0 for the first.

    Rows are cut into ranges by sampled quantiles of the order and stored, so that ranges stay what they are when a task is
    run again; sums go by range first, one row for each shuffle partition, then within a range. Equal values of the order
    share a range, in any order among themselves; nulls come first.
    """
    ranged = store(df.repartitionByRange(F.col(order)).withColumn("_range", F.spark_partition_id()), "ranges")
    per = ranged.groupBy("_range").agg(*[F.sum(c).alias(f"_in_{c}") for c in columns])
    earlier = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    base = per.select("_range", *[F.coalesce(F.sum(f"_in_{c}").over(earlier), F.lit(0)).alias(f"_base_{c}") for c in columns])
    within = W.partitionBy("_range").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    placed = ranged.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"_within_{c}") for c in columns]).join(F.broadcast(base), "_range")
    return placed.select(*df.columns, *[(F.col(f"_base_{c}") + F.col(f"_within_{c}")).alias(f"{c}_before") for c in columns])
