"""Groups, profiles, reports, and the first or best rows of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldmark.functions.geo import in_polygon
from fieldmark.functions.keys import age_class, is_known, name_key
from fieldmark.operators.prefix import sums_before


def group_by_name(obs: DataFrame, distinguish: bool = True) -> DataFrame:
    """(name_key, n, first_aid, last_aid): groups by name; unknown ones stand alone if they are told apart."""
    key = name_key(F.col("aid"), F.col("nid"), distinguish)
    return obs.groupBy(key.alias("name_key")).agg(F.count(F.lit(1)).alias("n"), F.min("aid").alias("first_aid"), F.max("aid").alias("last_aid"))


def groundtruth_count(obs: DataFrame) -> DataFrame:
    """(aid, n): how many observations share the name, itself included; 1 for unknown ones."""
    counts = obs.where(is_known(F.col("nid"))).groupBy("nid").agg(F.count(F.lit(1)).alias("_n"))
    return obs.select("aid", "nid").join(counts, "nid", "left").select("aid", F.when(is_known(F.col("nid")), F.col("_n")).otherwise(1).cast("long").alias("n"))


def pername_stats(obs: DataFrame) -> DataFrame:
    counts = obs.where(is_known(F.col("nid"))).groupBy("nid").agg(F.count(F.lit(1)).alias("c"))
    return counts.agg(F.min("c").alias("least"), F.max("c").alias("most"), F.avg("c").alias("mean"), F.stddev_pop("c").alias("std"), F.median("c").alias("median"), F.count(F.lit(1)).alias("names"))


def pername_bins(obs: DataFrame) -> DataFrame:
    """(bin, names, annots) with bins 1, 2-3, 4-5, >=6."""
    counts = obs.where(is_known(F.col("nid"))).groupBy("nid").agg(F.count(F.lit(1)).alias("c"))
    bins = F.when(F.col("c") == 1, "1").when(F.col("c") <= 3, "2-3").when(F.col("c") <= 5, "4-5").otherwise(">=6")
    return counts.groupBy(bins.alias("bin")).agg(F.count(F.lit(1)).alias("names"), F.sum("c").alias("annots"))


def profile(obs: DataFrame, names: DataFrame) -> DataFrame:
    """One row: names by how many observations they have, and observations by what name they have."""
    counts = names.select("nid").join(obs.where(is_known(F.col("nid"))).groupBy("nid").agg(F.count(F.lit(1)).alias("c")), "nid", "left")
    per = counts.agg(F.count(F.lit(1)).alias("names"), F.count_if(F.col("c") == 1).alias("names_singleton"), F.count_if(F.col("c") > 1).alias("names_multiton"), F.count_if(F.col("c").isNull()).alias("names_unassociated"), F.sum(F.when(F.col("c") == 1, 1).otherwise(0)).alias("annots_singleton"), F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0)).alias("annots_multiton"))
    total = obs.agg(F.count(F.lit(1)).alias("annots"), F.count_if(~is_known(F.col("nid"))).alias("annots_unknown"))
    return per.crossJoin(total)


def group_counts_with_empty(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Every key of left with the number of its rows in right, 0 included."""
    return left.select(key).join(right.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def primary_category(df: DataFrame, category: str, position: str) -> DataFrame:
    """The most frequent category; the one seen first wins ties."""
    return df.groupBy(category).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("_p")).orderBy(F.desc("n"), "_p").limit(1).select(category, "n")


def adjacent_category_names(obs: DataFrame, order: list[str], size: int = 2) -> DataFrame:
    """(window, nid, n): for each run of `size` neighbouring categories on a ring, names seen in all of them."""
    spark = obs.sparkSession
    rows = [(i, order[(i + j) % len(order)]) for i in range(len(order)) for j in range(size)]
    windows = spark.createDataFrame(rows, "window int, view string")
    met = obs.join(F.broadcast(windows), "view").groupBy("window", "nid").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("view").alias("_v"))
    return met.where(F.col("_v") == size).drop("_v")


def first_seen(obs: DataFrame, *by: str) -> DataFrame:
    """obs with is_first: the earliest of each group; unknown names never are."""
    w = W.partitionBy(*by).orderBy(F.col("t").asc_nulls_last(), "aid")
    return obs.withColumn("is_first", is_known(F.col("nid")) & (F.row_number().over(w) == 1))


def best_per_group(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group in this order."""
    return df.withColumn("_nth", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_nth") <= n).drop("_nth")


def exemplar_value(quality: Column, exemplar: Column, multiple: Column) -> Column:
    """Worth of an observation as an exemplar: by quality, then being one already, less where several are in the box."""
    worth = F.when(quality >= 5, 5.0).when(quality == 4, 4.0).when(quality == 3, 3.0).when(quality == 2, 1.0).when(quality <= 1, 0.1).otherwise(0.5)
    return worth + F.when(exemplar, 1.0).otherwise(0.0) - F.when(multiple, 0.5).otherwise(0.0)


def farthest_pair(obs: DataFrame) -> DataFrame:
    """(nid, first_aid, last_aid, seconds): per name its earliest and its latest observation, the pair farthest apart in time."""
    known = obs.where(is_known(F.col("nid")) & F.col("t").isNotNull())
    ends = known.groupBy("nid").agg(F.min(F.struct("t", "aid")).alias("a"), F.max(F.struct("t", "aid")).alias("b"), F.count(F.lit(1)).alias("n"))
    return ends.where(F.col("n") > 1).select("nid", F.col("a.aid").alias("first_aid"), F.col("b.aid").alias("last_aid"), (F.col("b.t") - F.col("a.t")).alias("seconds"))


def track(obs: DataFrame) -> DataFrame:
    """(nid, pos, aid, t, lat, lon): each name's points in time order, from 1; points without place are left out."""
    w = W.partitionBy("nid").orderBy("t", "aid")
    return obs.where(is_known(F.col("nid")) & F.col("lat").isNotNull() & F.col("lon").isNotNull()).withColumn("pos", F.row_number().over(w)).select("nid", "pos", "aid", "t", "lat", "lon")


def associations(members: DataFrame) -> DataFrame:
    """(a, b, n): names seen in the same group, and in how many; members has name and grp.

    The pairs of one group are joined, not all pairs; a group's names are distinct first.
    """
    own = members.select("grp", "name").distinct()
    other = own.select("grp", F.col("name").alias("b"))
    return own.join(other, "grp").where(F.col("name") < F.col("b")).groupBy(F.col("name").alias("a"), "b").agg(F.count(F.lit(1)).alias("n"))


def sightings(obs: DataFrame) -> DataFrame:
    """Observations in row order with flags: first of its name, first of its name that day, name seen before."""
    known = is_known(F.col("nid"))
    nth = F.row_number().over(W.partitionBy("nid").orderBy("t", "aid"))
    nth_day = F.row_number().over(W.partitionBy("nid", "day").orderBy("t", "aid"))
    return obs.withColumn("first_seen", known & (nth == 1)).withColumn("marked", known & (nth > 1)).withColumn("first_that_day", known & (nth_day == 1))


def mixed_property_names(obs: DataFrame, flag: Column) -> DataFrame:
    """(nid, n, having): names of which some but not all observations have a property."""
    counts = obs.where(is_known(F.col("nid"))).groupBy("nid").agg(F.count(F.lit(1)).alias("n"), F.count_if(flag).alias("having"))
    return counts.where((F.col("having") > 0) & (F.col("having") < F.col("n")))


def balanced_parts(df: DataFrame, k: int, order: str, size: str) -> DataFrame:
    """df with part: rows in order cut into k runs of near equal sums, a row going where its middle falls."""
    total = df.agg(F.sum(size).alias("_total"))
    middle = F.col(f"{size}_before") + F.col(size) / 2
    placed = sums_before(df, order, size).crossJoin(F.broadcast(total))
    return placed.select(*df.columns, F.least(F.floor(middle * k / F.col("_total")), F.lit(k - 1)).cast("int").alias("part"))


def geofence(rows: DataFrame, areas: dict[str, list[tuple[float, float]]]) -> DataFrame:
    """rows with area: the first, by name, of the polygons of (lat, lon) corners that a row lies in."""
    area = F.lit(None).cast("string")
    for name in sorted(areas, reverse=True):
        area = F.when(in_polygon(F.col("lat"), F.col("lon"), areas[name]), name).otherwise(area)
    return rows.withColumn("area", area)


def demographics(ages: DataFrame) -> DataFrame:
    """(nid, age): a name's age class from its observations' age_min and age_max in months; AMBIGUOUS if they differ."""
    seen = lambda c: F.count_distinct(F.coalesce(c, F.lit(-999)))
    per = ages.groupBy("nid").agg(seen("age_min").alias("a"), seen("age_max").alias("b"), F.min("age_min").alias("low"), F.min("age_max").alias("high"))
    return per.select("nid", F.when((F.col("a") > 1) | (F.col("b") > 1), "AMBIGUOUS").otherwise(age_class(F.col("low"), F.col("high"))).alias("age"))


def alternatives(names: DataFrame) -> DataFrame:
    """(item, name, alias): of the names that an item is listed under the first in order that is known; others as alias."""
    known = F.col("name") != "____"
    w = W.partitionBy("item").orderBy((~known).cast("int"), "pos", "name")
    first = names.withColumn("_i", F.row_number().over(w))
    own = first.where(F.col("_i") == 1).select("item", "name")
    rest = first.where((F.col("_i") > 1) & known).groupBy("item").agg(F.array_join(F.array_sort(F.array_distinct(F.collect_list("name"))), ";").alias("alias"))
    return own.join(rest, "item", "left").select("item", "name", F.coalesce("alias", F.lit("")).alias("alias"))
