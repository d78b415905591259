"""Queries on records: counts, partners, exports, cleanup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.operators import records
from fieldmark.plans.registry import EDGES_SQL, OBS_SQL, observations, query, review_edges
from fieldmark.sources.tables import table

WITH = f"WITH {OBS_SQL} "


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_shipdate, l_suppkey AS aid1, l_partkey AS aid2, least(l_suppkey, l_partkey) AS a, greatest(l_suppkey, l_partkey) AS b, l_returnflag = 'A' AS old FROM lineitem),
o AS (SELECT a, b, count(*) AS n FROM p WHERE old GROUP BY ALL)
SELECT aid1, aid2, l_orderkey, l_linenumber, (coalesce(n, 0) + row_number() OVER (PARTITION BY a, b ORDER BY l_orderkey, l_linenumber))::BIGINT AS review_count FROM p LEFT JOIN o USING (a, b) WHERE NOT old""")
def review_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Returned lines are the reviews of a part and supplier that a store has, all other lines new ones."""
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("aid1"), F.col("l_partkey").alias("aid2"), "l_orderkey", "l_linenumber", "l_returnflag")
    old = rows.where(F.col("l_returnflag") == "A")
    old = old.groupBy(F.least("aid1", "aid2").alias("aid1"), F.greatest("aid1", "aid2").alias("aid2")).agg(F.count(F.lit(1)).alias("review_count"))
    return records.number_reviews(old, rows.where(F.col("l_returnflag") != "A").drop("l_returnflag"), ["l_orderkey", "l_linenumber"])


@query(WITH + ", k AS (SELECT nid, count(*) AS own FROM obs WHERE nid > 0 GROUP BY nid) SELECT aid, (SELECT sum(own) FROM k)::BIGINT - coalesce(own, 0) AS n FROM obs LEFT JOIN k USING (nid)")
def groundfalse_count(spark: SparkSession, sf: str) -> DataFrame:
    return records.groundfalse_count(observations(spark, sf))


@query(f"WITH {EDGES_SQL}, s AS (SELECT a, b FROM edges WHERE state IN ('match', 'nomatch', 'notcomp')), p AS (SELECT a AS node, b AS partner FROM s UNION SELECT b, a FROM s) SELECT node, count(*) AS n, min(partner) AS least, max(partner) AS greatest FROM p GROUP BY node")
def reviewed_partners(spark: SparkSession, sf: str) -> DataFrame:
    pairs = records.partners(review_edges(spark, sf), ["match", "nomatch", "notcomp"])
    return pairs.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("partner").alias("least"), F.max("partner").alias("greatest"))


@query(f"WITH {OBS_SQL}, {EDGES_SQL}, s AS (SELECT a AS aid FROM edges WHERE state = 'match' UNION SELECT b FROM edges WHERE state = 'match') SELECT imgset AS grp, count(*) AS n, count(s.aid) AS reviewed, count(s.aid)::DOUBLE / count(*) AS share FROM obs LEFT JOIN s USING (aid) GROUP BY imgset")
def imageset_reviewed_share(spark: SparkSession, sf: str) -> DataFrame:
    members = observations(spark, sf).select(F.col("imgset").alias("grp"), "aid")
    reviewed = records.partners(review_edges(spark, sf), ["match"]).select(F.col("node").alias("aid"))
    return records.reviewed_share(members, reviewed)


@query("SELECT l_partkey AS key, count(DISTINCT l_suppkey) AS names FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) > 1")
def name_mapping_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return records.name_conflicts(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_suppkey").alias("name")))


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_custkey IS NOT NULL)")
def empty_names(spark: SparkSession, sf: str) -> DataFrame:
    """Customers without a pending order as names without an observation; most have some order."""
    return records.without_children(table(spark, sf, "customer"), "c_custkey", table(spark, sf, "orders").where("o_orderstatus = 'P'"), "o_custkey").select("c_custkey", "c_nationkey")


@query("WITH a AS (SELECT DISTINCT user_id AS k FROM events WHERE user_id IS NOT NULL), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey IS NOT NULL) SELECT (SELECT count(*) FROM a WHERE k NOT IN (SELECT k FROM b)) AS only_left, (SELECT count(*) FROM b WHERE k NOT IN (SELECT k FROM a)) AS only_right, (SELECT count(*) FROM a JOIN b USING (k)) AS \"both\"")
def store_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return records.overlap(table(spark, sf, "events").select(F.col("user_id").alias("k")), table(spark, sf, "orders").select(F.col("o_custkey").alias("k")), "k")


@query(WITH + """, i AS (SELECT *, aid // 4 AS gid, row_number() OVER (PARTITION BY aid // 4 ORDER BY t, aid) AS i FROM obs)
SELECT gid, count(*) AS n, count(*) FILTER (nid > 0) AS known, count(DISTINCT nid) FILTER (nid > 0) AS names, strftime(make_timestamp(min(t) * 1000000), '%Y-%m-%d %H:%M:%S') AS first_time, coalesce(max(view) FILTER (i = 1), 'NONE') AS first_view FROM i GROUP BY gid""")
def image_info(spark: SparkSession, sf: str) -> DataFrame:
    """Four observations in a row as an image."""
    return records.image_info(observations(spark, sf).withColumn("gid", F.floor(F.col("aid") / 4)))


_CELLS = "SELECT event_id, CASE WHEN q = -1 THEN 'UNKNOWN' ELSE q::VARCHAR END AS quality, event_type || '<COMMA>' || user_id AS label FROM (SELECT *, (floor(value)::BIGINT % 7) - 1 AS q FROM events)"


@query(_CELLS)
def csv_cells(spark: SparkSession, sf: str) -> DataFrame:
    q = F.floor("value").cast("long") % 7 - 1
    return table(spark, sf, "events").select("event_id", records.csv_cell(q).alias("quality"), records.csv_cell(F.concat_ws(",", "event_type", F.col("user_id").cast("string"))).alias("label"))


_X, _Y = "(l_partkey % 100)::DOUBLE", "(l_suppkey % 100)::DOUBLE"
_W, _H, _T = "l_quantity::DOUBLE", "l_linenumber::DOUBLE", "l_discount::DOUBLE"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, round({_X} + {_W} / 2 - {_W} / 2 * cos({_T}) + {_H} / 2 * sin({_T}), 6) AS x0, round({_Y} + {_H} / 2 + {_W} / 2 * sin({_T}) + {_H} / 2 * cos({_T}), 6) AS y2 FROM lineitem")
def rotated_boxes(spark: SparkSession, sf: str) -> DataFrame:
    d = lambda c: F.col(c).cast("double")
    rows = table(spark, sf, "lineitem").withColumn("c", records.rotated_corners((F.col("l_partkey") % 100).cast("double"), (F.col("l_suppkey") % 100).cast("double"), d("l_quantity"), d("l_linenumber"), d("l_discount")))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("c")[0]["x"], 6).alias("x0"), F.round(F.col("c")[2]["y"], 6).alias("y2"))
