"""Counts, partners and rows to export of images, names, pairs and groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldmark.functions.keys import is_known


def datetime_text(t: Column) -> Column:
    """yyyy-mm-dd hh:mm:ss of seconds since 1970 in UTC, whatever the session's time zone; null stays null."""
    return F.timestamp_add("SECOND", t, F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")).cast("string")


def csv_cell(value: Column) -> Column:
    """A value as the text of an exported cell. NONE for null, UNKNOWN for -1, <COMMA> for a comma."""
    text = value.cast("string")
    return F.when(text.isNull(), "NONE").when(text == "-1", "UNKNOWN").otherwise(F.replace(text, F.lit(","), F.lit("<COMMA>")))


def rotated_corners(x: Column, y: Column, w: Column, h: Column, theta: Column) -> Column:
    """The four corners of a box turned by theta about its centre, clockwise from the upper left, as structs (x, y)."""
    c, s = F.cos(theta), F.sin(theta)
    corner = lambda dx, dy: F.struct((x + w / 2 + dx * w / 2 * c - dy * h / 2 * s).alias("x"), (y + h / 2 + dx * w / 2 * s + dy * h / 2 * c).alias("y"))
    return F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1))


def number_reviews(reviews: DataFrame, rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (aid1, aid2, ..) with review_count, which goes on in this order from that of their pair in reviews; a pair has no direction."""
    pair = [F.least("aid1", "aid2").alias("_a"), F.greatest("aid1", "aid2").alias("_b")]
    top = reviews.groupBy(*pair).agg(F.max("review_count").alias("_top"))
    nth = F.row_number().over(W.partitionBy("_a", "_b").orderBy(*order))
    new = rows.select("*", *pair).withColumn("_nth", nth).join(top, ["_a", "_b"], "left")
    return new.withColumn("review_count", (F.coalesce("_top", F.lit(0)) + F.col("_nth")).cast("long")).drop("_a", "_b", "_top", "_nth")


def groundfalse_count(obs: DataFrame) -> DataFrame:
    """(aid, n): how many known observations bear another name; from counts by name, without pairs."""
    known = obs.where(is_known(F.col("nid")))
    own = known.groupBy("nid").agg(F.count(F.lit(1)).alias("_own"))
    total = known.agg(F.count(F.lit(1)).alias("_all"))
    return obs.select("aid", "nid").join(own, "nid", "left").crossJoin(F.broadcast(total)).select("aid", (F.col("_all") - F.coalesce("_own", F.lit(0))).alias("n"))


def partners(edges: DataFrame, states: list[str]) -> DataFrame:
    """(node, partner): distinct, both ways, of the pairs (a, b, state) whose state is one of these."""
    kept = edges.where(F.col("state").isin(*states))
    both = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("partner")), F.struct(F.col("b").alias("node"), F.col("a").alias("partner"))))
    return kept.select(both.alias("p")).select("p.node", "p.partner").distinct()


def reviewed_share(members: DataFrame, reviewed: DataFrame) -> DataFrame:
    """(grp, n, reviewed, share): of each group's members (grp, aid) those that stand in reviewed (aid)."""
    seen = members.join(reviewed.select("aid").distinct().withColumn("_seen", F.lit(True)), "aid", "left")
    per = seen.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.count("_seen").alias("reviewed"))
    return per.withColumn("share", F.col("reviewed") / F.col("n"))


def name_conflicts(mapping: DataFrame) -> DataFrame:
    """(key, names): keys that (key, name) maps to more than one name, null not being one."""
    per = mapping.groupBy("key").agg(F.count_distinct("name").alias("names"))
    return per.where(F.col("names") > 1)


def without_children(parents: DataFrame, key: str, children: DataFrame, column: str) -> DataFrame:
    """Rows of parents that no row of children points to: what a cleanup of empty names or groups deletes."""
    return parents.join(children.select(F.col(column).alias(key)), key, "left_anti").select(*parents.columns)


def overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row (only_left, only_right, both): distinct keys of two stores."""
    side = lambda df, n: df.where(F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.lit(n).alias("_side"))
    per = side(left, 1).unionByName(side(right, 2)).groupBy("_k").agg(F.bit_or("_side").alias("s"))
    return per.agg(F.count_if(F.col("s") == 1).alias("only_left"), F.count_if(F.col("s") == 2).alias("only_right"), F.count_if(F.col("s") == 3).alias("both"))


def image_info(obs: DataFrame) -> DataFrame:
    """(gid, n, known, names, first_time, first_view): a row an image for export; its first observation goes by time, then id."""
    known = is_known(F.col("nid"))
    per = obs.groupBy("gid").agg(F.count(F.lit(1)).alias("n"), F.count_if(known).alias("known"), F.count_distinct(F.when(known, F.col("nid"))).alias("names"), F.min(F.struct("t", "aid", "view")).alias("f"))
    return per.select("gid", "n", "known", "names", datetime_text(F.col("f.t")).alias("first_time"), csv_cell(F.col("f.view")).alias("first_view"))
