"""The registry of queries, and the driver tables seen as observations, reviews and descriptors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldmark.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *, name: str | None = None) -> Callable[[Callable[[SparkSession, str], DataFrame]], Callable[[SparkSession, str], DataFrame]]:
    """Register a function under its name, with its SQL if it has one."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return add


def rounded(value: Column, places: int) -> Column:
    """value rounded as the SQL does: times a power of ten, the product to a whole number, halves away from 0. F.round goes by the
    decimal digits that are printed, so the two differ where one of them is a half and the other is not quite."""
    return F.round(value * 10.0**places, 0) / 10.0**places


VIEWS = ["click", "view", "purchase", "signup", "error"]

OBS_SQL = """obs AS (
  SELECT event_id AS aid, CASE WHEN user_id % 7 = 0 THEN 0 ELSE user_id END AS nid, epoch_us(ts) // 1000000 AS t, event_type AS view,
    (floor(value)::BIGINT % 7) - 1 AS quality, 'species_' || (user_id % 3) AS species,
    CASE WHEN event_id % 11 = 0 THEN NULL ELSE ((event_id * 37) % 18000)::DOUBLE / 100::DOUBLE - 90 END AS lat,
    CASE WHEN event_id % 11 = 0 THEN NULL ELSE ((event_id * 91) % 36000)::DOUBLE / 100::DOUBLE - 180 END AS lon,
    epoch_us(ts) // 86400000000 AS imgset, floor(value)::BIGINT AS numfeat, event_id % 5 = 0 AS exemplar, event_id % 13 = 0 AS multiple, value
  FROM events)"""


#: The same with names by key: an unknown one is its own, minus the observation's id.
APART_SQL = OBS_SQL.replace("THEN 0 ELSE user_id END AS nid", "THEN -event_id ELSE user_id END AS nid")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as observations: a user is a name (every seventh unknown), an event's type its viewpoint, a day an imageset."""
    e = table(spark, sf_dir, "events")
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    place = lambda by, of, back: F.when(F.col("event_id") % 11 != 0, (F.col("event_id") * by % of).cast("double") / 100 - back)
    whole = F.floor("value").cast("long")
    return e.select(
        F.col("event_id").alias("aid"), F.when(F.col("user_id") % 7 == 0, 0).otherwise(F.col("user_id")).cast("long").alias("nid"), F.floor(micros / 1000000).cast("long").alias("t"), F.col("event_type").alias("view"),
        (whole % 7 - 1).alias("quality"), F.concat(F.lit("species_"), (F.col("user_id") % 3).cast("string")).alias("species"), place(37, 18000, 90).alias("lat"), place(91, 36000, 180).alias("lon"),
        F.floor(micros / 86400000000).cast("long").alias("imgset"), whole.alias("numfeat"), (F.col("event_id") % 5 == 0).alias("exemplar"), (F.col("event_id") % 13 == 0).alias("multiple"), "value",
    )


EDGES_SQL = """o AS (
  SELECT event_id AS a, lead(event_id, 1) OVER w AS n1, lead(event_id, 2) OVER w AS n2, event_type, value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
edges AS (
  SELECT least(a, n1) AS a, greatest(a, n1) AS b, CASE event_type WHEN 'error' THEN 'nomatch' WHEN 'signup' THEN 'notcomp' ELSE 'match' END AS state, value FROM o WHERE n1 IS NOT NULL
  UNION ALL SELECT least(a, n2), greatest(a, n2), CASE WHEN value < 20 THEN 'nomatch' WHEN value < 40 THEN 'match' WHEN value < 60 THEN 'unknown' ELSE 'unreviewed' END, value FROM o WHERE n2 IS NOT NULL)"""

ROOTS_SQL = EDGES_SQL + """,
m AS (SELECT a, b FROM edges WHERE state = 'match' UNION SELECT b, a FROM edges WHERE state = 'match'),
nodes AS (SELECT a AS node FROM edges UNION SELECT b FROM edges),
r(node, reach) AS (SELECT node, node FROM nodes UNION SELECT r.node, m.b FROM r JOIN m ON r.reach = m.a),
roots AS (SELECT node, min(reach) AS root FROM r GROUP BY node),
lab AS (SELECT e.*, least(x.root, y.root) AS r1, greatest(x.root, y.root) AS r2 FROM edges e JOIN roots x ON x.node = e.a JOIN roots y ON y.node = e.b),
bad AS (SELECT r1 AS root, count(*) AS negatives FROM lab WHERE state = 'nomatch' AND r1 = r2 GROUP BY r1)"""


def review_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's successive events as pairs under review: neighbours, and those two apart."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    o = table(spark, sf_dir, "events").select(F.col("event_id").alias("x"), F.lead("event_id", 1).over(w).alias("n1"), F.lead("event_id", 2).over(w).alias("n2"), "event_type", "value")
    one = F.when(F.col("event_type") == "error", "nomatch").when(F.col("event_type") == "signup", "notcomp").otherwise("match")
    two = F.when(F.col("value") < 20, "nomatch").when(F.col("value") < 40, "match").when(F.col("value") < 60, "unknown").otherwise("unreviewed")
    side = lambda n, s: o.where(F.col(n).isNotNull()).select(F.least("x", n).alias("a"), F.greatest("x", n).alias("b"), s.alias("state"), "value")
    return side("n1", one).unionByName(side("n2", two))


DESC_SQL = """d AS (SELECT vec_id AS fx, (label * 8 + vec_id % 8)::BIGINT AS aid, label::BIGINT AS nid, embedding::DOUBLE[] AS vec FROM embeddings)"""


def descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as descriptors: a label is a name with eight observations."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("fx"), (F.col("label") * 8 + F.col("vec_id") % 8).cast("long").alias("aid"), F.col("label").cast("long").alias("nid"), F.col("embedding").alias("vec"))
