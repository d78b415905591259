"""Pairs of observations: within names, between sets, undirected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldmark.functions.geo import haversine_km, speed_kmh
from fieldmark.functions.keys import is_known


def within_names(obs: DataFrame, *columns: str) -> DataFrame:
    """(nid, a, b, and each column as a_* and b_*) for a < b of the same known name.

    Quadratic in an individual's sightings, as asked; Spark splits the join of a name that has very many.
    """
    known = obs.where(is_known(F.col("nid")))
    left = known.select("nid", F.col("aid").alias("a"), *[F.col(c).alias(f"a_{c}") for c in columns])
    right = known.select("nid", F.col("aid").alias("b"), *[F.col(c).alias(f"b_{c}") for c in columns])
    return left.join(right, "nid").where(F.col("a") < F.col("b"))


def timedeltas(obs: DataFrame) -> DataFrame:
    return within_names(obs, "t").select("nid", "a", "b", F.abs(F.col("a_t") - F.col("b_t")).alias("seconds"))


def speeds(obs: DataFrame) -> DataFrame:
    """(nid, a, b, km, hours, kmh) of pairs within names."""
    p = within_names(obs, "t", "lat", "lon")
    p = p.withColumn("km", haversine_km(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))).withColumn("hours", F.abs(F.col("a_t") - F.col("b_t")) / 3600.0)
    return p.select("nid", "a", "b", "km", "hours", speed_kmh(F.col("km"), F.col("hours")).alias("kmh"))


def undirected(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Distinct pairs with the lesser end first; pairs of one with itself go."""
    return pairs.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def between(edges: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Edges (a, b) with one end in left and the other in right, in either direction; left and right have node."""
    one = edges.join(left.select(F.col("node").alias("a")), "a", "left_semi").join(right.select(F.col("node").alias("b")), "b", "left_semi")
    two = edges.join(right.select(F.col("node").alias("a")), "a", "left_semi").join(left.select(F.col("node").alias("b")), "b", "left_semi")
    return one.select("a", "b").union(two.select("a", "b")).distinct()


def inside(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.select(F.col("node").alias("a")), "a", "left_semi").join(nodes.select(F.col("node").alias("b")), "b", "left_semi")


def outgoing(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with exactly one end among nodes."""
    n = nodes.select("node").distinct()
    tagged = edges.join(n.withColumn("_in_a", F.lit(1)).withColumnRenamed("node", "a"), "a", "left").join(n.withColumn("_in_b", F.lit(1)).withColumnRenamed("node", "b"), "b", "left")
    return tagged.where(F.col("_in_a").isNull() != F.col("_in_b").isNull()).drop("_in_a", "_in_b")


def in_cliques(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(grp, a, b): edges with both ends in one group; members has grp and node."""
    return edges.join(members.select("grp", F.col("node").alias("a")), "a").join(members.select("grp", F.col("node").alias("b")), ["grp", "b"]).select("grp", "a", "b")


def missing_in_cliques(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(grp, a, b): pairs of a group's members, a < b, that no edge joins."""
    own = members.select("grp", F.col("node").alias("a")).join(members.select("grp", F.col("node").alias("b")), "grp").where(F.col("a") < F.col("b"))
    return own.join(undirected(edges), ["a", "b"], "left_anti").select("grp", "a", "b")


def corresponding_groups(left: DataFrame, right: DataFrame) -> DataFrame:
    """(nid, n_left, n_right, side): names in both sets, or in one of them only."""
    a = left.groupBy("nid").agg(F.count(F.lit(1)).alias("n_left"))
    b = right.groupBy("nid").agg(F.count(F.lit(1)).alias("n_right"))
    both = a.join(b, "nid", "full_outer")
    side = F.when(F.col("n_left").isNull(), "right").when(F.col("n_right").isNull(), "left").otherwise("both")
    return both.select("nid", F.coalesce("n_left", F.lit(0)).alias("n_left"), F.coalesce("n_right", F.lit(0)).alias("n_right"), side.alias("side"))


def nearest_time(rows: DataFrame, donors: DataFrame, key: str, most: int, t: str = "t") -> DataFrame:
    """rows joined with the donor of equal key that is nearest in time, within `most`; ties to the lesser id.

    Times are cut into spans of `most`, so a row looks into three spans only, not into all of its key. Nothing is joined: rows
    and donors of a span are put in order of time, once each way, and a row takes the donor last seen, or the last one with
    another id where that is the row's own. So work grows with rows and donors, not with their pairs.
    """
    span = lambda c: F.floor(c / most)
    extra = [c for c in donors.columns if c not in (key, "aid", t)]
    usable = lambda df: df.where(F.col(key).isNotNull() & F.col(t).isNotNull() & F.col("aid").isNotNull())
    at = [F.col(key).alias("_key"), F.col(t).alias("_t"), F.col("aid").alias("_id")]
    left = usable(rows).select(*at, F.struct(*rows.columns).alias("_row"), F.explode(F.array(*[span(F.col(t)) + d for d in (-1, 0, 1)])).alias("_span"))
    right = usable(donors).select(*at, F.struct(F.col("aid").alias("donor"), F.col(t).alias("donor_t"), *[F.col(c).alias(f"donor_{c}") for c in extra]).alias("_own"), span(F.col(t)).alias("_span"))
    both = left.unionByName(right, allowMissingColumns=True)
    last = lambda c, w: F.last(c, ignorenulls=True).over(w)
    sides = []
    for order in (F.asc("_t"), F.desc("_t")):
        # Of donors as near, the least id comes last; donors come before rows of their time.
        w = W.partitionBy("_key", "_span").orderBy(order, F.col("_own").isNull(), F.desc("_id"))
        seen, before = w.rowsBetween(W.unboundedPreceding, W.currentRow), w.rowsBetween(W.unboundedPreceding, -1)
        one, two = f"_one{len(sides)}", f"_two{len(sides)}"
        both = both.withColumn("_prior", last("_own", before)).withColumn("_other", F.when(F.col("_prior.donor") != F.col("_own.donor"), F.col("_prior")))
        both = both.withColumn(one, last("_own", seen)).withColumn(two, last("_other", seen)).drop("_prior", "_other")
        sides.append(F.when(F.col(f"{one}.donor") != F.col("_id"), F.col(one)).otherwise(F.col(two)))
    gaps = [F.abs(F.col("_t") - s["donor_t"]) for s in sides]
    later = gaps[0].isNull() | (F.struct(gaps[1].alias("gap"), sides[1]["donor"].alias("donor")) < F.struct(gaps[0].alias("gap"), sides[0]["donor"].alias("donor")))
    found = both.where(F.col("_row").isNotNull()).select("_row", F.when(gaps[1].isNotNull() & later, sides[1]).otherwise(sides[0]).alias("_found"))
    met = found.select("_row.*", "_found.*").withColumn("gap", F.abs(F.col(t) - F.col("donor_t"))).where(F.col("gap") <= most)
    return met.withColumn("_nth", F.row_number().over(W.partitionBy("aid").orderBy("gap", "donor"))).where(F.col("_nth") == 1).drop("_nth")


def pair_features(rows: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Per pair sum, mean, population deviation, median and count of each value."""
    aggs: list[Column] = [F.count(F.lit(1)).alias("len")]
    for v in values:
        aggs += [F.sum(v).alias(f"sum_{v}"), F.avg(v).alias(f"mean_{v}"), F.stddev_pop(v).alias(f"std_{v}"), F.median(v).alias(f"med_{v}")]
    return rows.groupBy(*by).agg(*aggs)
