"""Queries on reports, thresholds and review planning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.functions.keys import duration_text, percent_text
from fieldmark.operators import components_deep, graph, grouping, metrics
from fieldmark.plans.graphs import _BOXES, _PRED, _boxes, _graph, _pred
from fieldmark.plans.registry import OBS_SQL, ROOTS_SQL, observations, query, review_edges
from fieldmark.sources.tables import table

WITH = f"WITH {OBS_SQL} "
REC = f"WITH RECURSIVE {ROOTS_SQL} "

_AGES = "a AS (SELECT l_suppkey AS nid, CASE WHEN l_suppkey % 5 = 0 THEN l_linenumber WHEN l_suppkey % 5 = 1 THEN -1 ELSE l_suppkey % 60 END AS age_min, CASE WHEN l_suppkey % 5 = 1 THEN -1 ELSE l_suppkey % 60 END AS age_max FROM lineitem)"


@query(f"""WITH {_AGES}, p AS (SELECT nid, count(DISTINCT age_min) AS x, count(DISTINCT age_max) AS y, min(age_min) AS lo, min(age_max) AS hi FROM a GROUP BY nid)
SELECT nid, CASE WHEN x > 1 OR y > 1 THEN 'AMBIGUOUS' WHEN lo = -1 AND hi = -1 THEN 'UNREVIEWED' WHEN lo < 12 AND hi < 12 THEN 'FOAL' WHEN lo BETWEEN 12 AND 23 AND hi BETWEEN 12 AND 23 THEN 'YEARLING'
  WHEN lo BETWEEN 24 AND 35 AND hi BETWEEN 24 AND 35 THEN '2 YEARS' WHEN lo >= 36 AND hi >= 36 THEN '3+ YEARS' ELSE 'UNKNOWN' END AS age FROM p""")
def demographics(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("l_suppkey")
    rows = table(spark, sf, "lineitem").select(k.alias("nid"), F.when(k % 5 == 0, F.col("l_linenumber")).when(k % 5 == 1, -1).otherwise(k % 60).cast("long").alias("age_min"), F.when(k % 5 == 1, -1).otherwise(k % 60).cast("long").alias("age_max"))
    return grouping.demographics(rows)


_AREAS = {"north": [(0.0, -180.0), (0.0, 180.0), (60.0, 180.0), (60.0, -180.0)], "wedge": [(-60.0, 0.0), (0.0, 90.0), (-60.0, 90.0)]}


@query(WITH + "SELECT aid, CASE WHEN lat >= 0 AND lat < 60 AND lon >= -180 AND lon < 180 THEN 'north' WHEN lon >= 0 AND lon < 90 AND lat >= -60 AND lat < -60 + lon * 60 / 90 THEN 'wedge' END AS area FROM obs")
def geofence(spark: SparkSession, sf: str) -> DataFrame:
    return grouping.geofence(observations(spark, sf), _AREAS).select("aid", "area")


@query("SELECT o_orderkey AS item, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus ELSE o_orderpriority END AS name, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority ELSE '' END AS alias FROM orders")
def resolve_name_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Orders listed under their status (P is unknown) and, second, their priority."""
    o = table(spark, sf, "orders")
    one = o.select(F.col("o_orderkey").alias("item"), F.lit(0).alias("pos"), F.when(F.col("o_orderstatus") == "P", "____").otherwise(F.col("o_orderstatus")).alias("name"))
    return grouping.alternatives(one.unionByName(o.select(F.col("o_orderkey").alias("item"), F.lit(1).alias("pos"), F.col("o_orderpriority").alias("name"))))


@query(WITH + "SELECT imgset, printf('%06.2f %%', count(*) FILTER (exemplar) * 100.0::DOUBLE / count(*)) AS reviewed, printf('%d:%02d:%02d:%02d', (max(t) - min(t)) // 86400, (max(t) - min(t)) // 3600 % 24, (max(t) - min(t)) // 60 % 60, (max(t) - min(t)) % 60) AS duration FROM obs GROUP BY imgset")
def imageset_texts(spark: SparkSession, sf: str) -> DataFrame:
    per = observations(spark, sf).groupBy("imgset").agg(F.count_if("exemplar").alias("n"), F.count(F.lit(1)).alias("all"), (F.max("t") - F.min("t")).alias("d"))
    return per.select("imgset", percent_text(F.col("n"), F.col("all")).alias("reviewed"), duration_text(F.col("d")).alias("duration"))


_RANKS = "k AS (SELECT l_returnflag AS config, l_orderkey AS query, min(l_linenumber) AS rank FROM lineitem GROUP BY ALL)"


def _ranks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("config"), F.col("l_orderkey").alias("query")).agg(F.min("l_linenumber").alias("rank"))


@query(f"WITH {_RANKS} SELECT config, CASE WHEN rank = 1 THEN 0 WHEN rank < 4 THEN 1 ELSE 2 END::INT AS bin, count(*) AS n FROM k WHERE rank BETWEEN 1 AND 7 GROUP BY ALL")
def rank_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.rank_histogram(_ranks(spark, sf), [1, 2, 4, 7])


@query(f"WITH {_RANKS} SELECT config, count(*) FILTER (rank < 1) AS below_1, count(*) FILTER (rank < 2) AS below_2, count(*) FILTER (rank < 5) AS below_5 FROM k GROUP BY config")
def ranks_below(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.less_than(_ranks(spark, sf), [1, 2, 5])


@query(f'WITH {_RANKS}, w AS (SELECT * FROM k WHERE rank <= 1), s AS (SELECT config, count(*) AS n FROM w GROUP BY config) SELECT x.config AS a, y.config AS b, count(*) AS "both", any_value(p.n) + any_value(q.n) - count(*) AS either FROM w x JOIN w y ON x.query = y.query AND x.config < y.config JOIN s p ON p.config = x.config JOIN s q ON q.config = y.config GROUP BY ALL')
def config_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.config_overlap(_ranks(spark, sf), 1)


@query(f"WITH {_RANKS} SELECT query, min(rank) AS best, max(rank) AS worst FROM k GROUP BY query HAVING min(rank) <> max(rank)")
def differing_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.differing(_ranks(spark, sf))


_VOTES = "v AS (SELECT l_linenumber AS model, l_orderkey AS sample, l_returnflag AS cls, max(l_discount * 100)::BIGINT AS p, min(l_quantity)::BIGINT AS weight FROM lineitem GROUP BY ALL)"


def _votes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("model"), F.col("l_orderkey").alias("sample"), F.col("l_returnflag").alias("cls")).agg(F.round(F.max(F.col("l_discount") * 100)).cast("long").alias("p"), F.min("l_quantity").cast("long").alias("weight"))


@query(f"WITH {_VOTES}, s AS (SELECT sample, cls, sum(p * weight) / sum(weight) AS score FROM v GROUP BY ALL) SELECT sample, cls, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY sample ORDER BY score DESC, cls) = 1")
def ensemble_soft(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.ensemble(_votes(spark, sf)).withColumn("score", F.round("score", 6))


@query(f"WITH {_VOTES}, t AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY model, sample ORDER BY p DESC, cls) = 1), s AS (SELECT sample, cls, sum(weight)::BIGINT AS score FROM t GROUP BY ALL) SELECT sample, cls, score FROM s QUALIFY row_number() OVER (PARTITION BY sample ORDER BY score DESC, cls) = 1")
def ensemble_hard(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.ensemble(_votes(spark, sf), hard=True)


@query(f"WITH {_PRED}, c AS (SELECT DISTINCT score, (SELECT count(*) FROM p q WHERE q.truth AND q.score <= p.score) AS y FROM p), l AS (SELECT score - lag(score) OVER (ORDER BY score) AS dx, y + lag(y) OVER (ORDER BY score) AS yy FROM c) SELECT round(sum(dx * yy / 2), 5) AS area FROM l")
def trapezoid_area(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window as W

    per = _pred(spark, sf).groupBy("score").agg(F.count_if("truth").alias("n"))
    return metrics.trapezoid(per.withColumn("y", F.sum("n").over(W.orderBy("score"))), "score", "y").select(F.round("area", 5).alias("area"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN (a > 30)::INT + (b > 4)::INT + (c > 5)::INT = 1 THEN CASE WHEN a > 30 THEN 'match' WHEN b > 4 THEN 'nomatch' ELSE 'notcomp' END END AS decision FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS a, round(l_discount * 100) AS b, round(l_tax * 100) AS c FROM lineitem)")
def auto_review(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("p_match"), F.round(F.col("l_discount") * 100).alias("p_nomatch"), F.round(F.col("l_tax") * 100).alias("p_notcomp"))
    return graph.auto_review(rows, 30, 4, 5).select("l_orderkey", "l_linenumber", "decision")


@query(REC + """, pr AS (SELECT a, b, r1, r2, value, max(value + CASE WHEN r1 = r2 AND r1 IN (SELECT root FROM bad) THEN 10 ELSE 0 END) OVER (PARTITION BY a, b) AS p, row_number() OVER (PARTITION BY a, b ORDER BY value) AS i FROM lab)
SELECT a, b, CASE WHEN p < 10 THEN greatest(CASE WHEN r1 = r2 THEN (a % 10) / 10.0::DOUBLE ELSE (b % 10) / 10.0::DOUBLE END, 1e-9) ELSE round(p, 6) END AS priority FROM pr WHERE i = 1""")
def graph_corrected_priority(spark: SparkSession, sf: str) -> DataFrame:
    e, roots = _graph(spark, sf)
    e = e.withColumn("p_no", (F.col("a") % 10) / 10.0).withColumn("p_yes", (F.col("b") % 10) / 10.0)
    out = graph.corrected_priorities(e, roots, "value", "p_no", "p_yes")
    return out.withColumn("priority", F.when(F.col("priority") >= 10, F.round("priority", 6)).otherwise(F.col("priority")))


@query()
def graph_confidently_connected(spark: SparkSession, sf: str) -> DataFrame:
    return graph.confidently_connected(review_edges(spark, sf).withColumn("confidence", (F.col("value") % 5).cast("int")), 2)


@query(REC + ", p AS (SELECT user_id AS name, root, min(node) AS b FROM roots JOIN events ON event_id = node GROUP BY ALL), l AS (SELECT name, lag(b) OVER (PARTITION BY name ORDER BY b) AS a, b FROM p) SELECT name, a, b FROM l WHERE a IS NOT NULL")
def graph_connecting_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.connecting_edges(review_edges(spark, sf), table(spark, sf, "events").select(F.col("event_id").alias("node"), F.col("user_id").alias("name")))


@query(REC + """, h AS (SELECT r1, r2, count(*) FILTER (state = 'nomatch') AS n FROM lab WHERE r1 <> r2 GROUP BY ALL HAVING count(*) FILTER (state = 'nomatch') < 2),
f AS (SELECT * FROM roots QUALIFY row_number() OVER (PARTITION BY root ORDER BY node) <= 2),
c AS (SELECT h.r1, h.r2, n, least(x.node, y.node) AS a, greatest(x.node, y.node) AS b FROM h JOIN f x ON x.root = h.r1 JOIN f y ON y.root = h.r2)
SELECT a, b FROM c WHERE (a, b) NOT IN (SELECT (a, b) FROM edges) QUALIFY row_number() OVER (PARTITION BY r1, r2 ORDER BY a, b) <= 2 - n""")
def graph_neg_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return graph.negative_candidates(*_graph(spark, sf), 2)


@query(WITH + ", l AS (SELECT nid, aid, lag(aid) OVER (PARTITION BY nid ORDER BY t, aid) AS p FROM obs WHERE nid > 0) SELECT nid AS grp, least(aid, p) AS a, greatest(aid, p) AS b FROM l WHERE p IS NOT NULL")
def graph_spanning_edges(spark: SparkSession, sf: str) -> DataFrame:
    return components_deep.spanning_edges(observations(spark, sf).where("nid > 0").select(F.col("nid").alias("grp"), F.col("aid").alias("node"), "t"))


@query()
def box_assignment_sequential(spark: SparkSession, sf: str) -> DataFrame:
    truth, pred = _boxes(spark, sf)
    return components_deep.assign_sequentially(truth.withColumn("cls", F.lit("a")), pred.withColumn("cls", F.lit("a")), 0.5)


@query(f"WITH {_BOXES} SELECT image, count(*) AS boxes, max(w * w + h * h) AS dlen_sqrd FROM pb GROUP BY image")
def box_extent(spark: SparkSession, sf: str) -> DataFrame:
    return _boxes(spark, sf)[1].groupBy("image").agg(F.count(F.lit(1)).alias("boxes"), F.max(F.col("w") * F.col("w") + F.col("h") * F.col("h")).alias("dlen_sqrd"))
