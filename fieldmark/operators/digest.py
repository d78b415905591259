"""A digest of a set of rows in the order of a key, by a tree of hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.lineage import store
from fieldmark.operators.prefix import sums_before

#: Levels of the tree. What is left above them is hashed at once: a row for each billion at the default width.
LEVELS = 3


def ordered_digest(rows: DataFrame, key: str, *columns: str, width: int = 1024) -> DataFrame:
    """(n, digest): how many rows there are, and a SHA-256 of them in ascending order of the key.

    A row's own hash covers key and columns as text, nulls told apart. A node ends where its own hash, of which the first
    eight hexadecimal digits are taken as a number, is a multiple of `width`; so where the tree is cut depends on the rows
    alone, not on partitions, and rows that change leave other nodes as they are. Rows of one key go by their hash; rows alike
    count as often as they occur. A node holds about `width` rows, so no task holds all of them. No rows: the hash of ''.
    """
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.hex(F.col(c).cast("string"))), F.lit("-"))
    own = F.sha2(F.concat_ws("|", part(key), *[part(c) for c in columns]), 256)
    alike = rows.select(F.col(key).alias("key"), own.alias("h")).groupBy("key", "h").agg(F.count(F.lit(1)).alias("n"))
    level = alike.select(F.struct("key", "h").alias("at"), F.sha2(F.concat_ws("*", "h", "n"), 256).alias("h"), "n")
    for _ in range(LEVELS):
        last = (F.conv(F.substring("h", 1, 8), 16, 10).cast("long") % width == 0).cast("int")
        cut = sums_before(level.withColumn("last", last), "at", "last")
        nodes = cut.groupBy("last_before").agg(F.array_sort(F.collect_list(F.struct("at", "h"))).alias("own"), F.sum("n").alias("n"))
        level = store(nodes.select(F.col("own")[0]["at"].alias("at"), F.sha2(F.concat_ws("", F.transform("own", lambda x: x["h"])), 256).alias("h"), "n"), "digest")
    top = level.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.array_sort(F.collect_list(F.struct("at", "h"))).alias("own"))
    return top.select("n", F.sha2(F.concat_ws("", F.transform("own", lambda x: x["h"])), 256).alias("digest"))
