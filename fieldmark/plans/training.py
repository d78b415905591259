"""Queries on training pairs, on digests of tables and on a review graph that loses edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.lineage import fresh_path
from fieldmark.operators import cohort, graph
from fieldmark.operators.digest import ordered_digest
from fieldmark.operators.training_pairs import random_pairs, review_pairs
from fieldmark.plans.graphs import BRIDGES_SQL
from fieldmark.plans.registry import EDGES_SQL, OBS_SQL, ROOTS_SQL, observations, query, review_edges
from fieldmark.sources.coco import write_coco
from fieldmark.sources.tables import read_coco
from fieldmark.streaming.incremental import read_stream
from fieldmark.streaming.review_graph import ReviewGraph

#: Training pairs per observation.
PER_NODE = 2


@query()
def training_random(spark: SparkSession, sf: str) -> DataFrame:
    edges = review_edges(spark, sf)
    roots = graph.positive_components(edges)
    return random_pairs(roots, edges.where("state in ('match', 'nomatch')").select("a", "b"), PER_NODE * roots.count(), seed=7)


@query(BRIDGES_SQL + """, t AS (SELECT DISTINCT a, b, state FROM lab WHERE r1 NOT IN (SELECT root FROM bad) AND r2 NOT IN (SELECT root FROM bad) AND state IN ('match', 'nomatch', 'notcomp')
  AND (floor(value)::BIGINT % 2 = 0 OR state = 'nomatch' OR (state = 'match' AND (a, b) NOT IN (SELECT (a, b) FROM br)))),
most AS (SELECT floor(1.2::DOUBLE * least(count(*) FILTER (state = 'match'), count(*) FILTER (state = 'nomatch')))::BIGINT AS most FROM t)
SELECT a, b, state FROM t, most QUALIFY row_number() OVER (PARTITION BY state ORDER BY md5(a || ':' || b || ':0')) <= most""")
def training_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """Reviews with an even value count as made by a user."""
    edges = review_edges(spark, sf).withColumn("by_user", F.floor("value") % 2 == 0)
    return review_pairs(edges, graph.positive_components(edges))


def _level(i: int) -> str:
    return f"""c{i} AS (SELECT key, h, n, coalesce(sum((('0x' || substr(h, 1, 8))::BIGINT % 1024 = 0)::INT) OVER (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM l{i}),
l{i + 1} AS (SELECT min(key) AS key, sha256(string_agg(h, '' ORDER BY key)) AS h, sum(n) AS n FROM c{i} GROUP BY c)"""


@query("WITH " + OBS_SQL + f""", l0 AS (SELECT aid AS key, sha256(sha256('=' || hex(aid::VARCHAR) || '|=' || hex(nid::VARCHAR) || '|=' || hex(view)) || '*1') AS h, 1 AS n FROM obs),
{_level(0)}, {_level(1)}, {_level(2)} SELECT sum(n)::BIGINT AS n, sha256(string_agg(h, '' ORDER BY key)) AS digest FROM l3""")
def observations_digest(spark: SparkSession, sf: str) -> DataFrame:
    return ordered_digest(observations(spark, sf), "aid", "nid", "view")


REVISED_SQL = EDGES_SQL.replace("\nedges AS (", "\nfirsts AS (") + """,
edges AS (SELECT a, b, CASE WHEN value > 60 THEN CASE state WHEN 'match' THEN 'nomatch' ELSE 'match' END ELSE state END AS state, value FROM firsts)"""


@query("WITH RECURSIVE " + ROOTS_SQL.replace(EDGES_SQL, REVISED_SQL) + """,
apart AS (SELECT r1, r2, count(*) AS n FROM lab WHERE state = 'nomatch' GROUP BY r1, r2),
oth AS (SELECT root, count(*) AS others FROM (SELECT r1 AS root FROM apart WHERE r1 <> r2 UNION ALL SELECT r2 FROM apart WHERE r1 <> r2) GROUP BY root)
SELECT node, root, coalesce(negatives, 0)::BIGINT AS inside, coalesce(others, 0)::BIGINT AS others FROM roots LEFT JOIN bad USING (root) LEFT JOIN oth USING (root)""")
def stream_review_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions as a stream of three batches; those with a value over 60 are taken back by a second one, which may come first."""
    edges = review_edges(spark, sf)
    back = edges.where("value > 60").select("a", "b", F.when(F.col("state") == "match", "nomatch").otherwise("match").alias("state"), F.lit(2).cast("long").alias("seq"))
    both = edges.select("a", "b", "state", F.lit(1).cast("long").alias("seq")).unionByName(back)
    feed, at = fresh_path(spark, "decisions"), fresh_path(spark, "review-graph")
    both.repartition(3, "a", "b", "seq").write.parquet(feed)
    held = ReviewGraph(spark, at)
    run = read_stream(spark, feed, both.schema).writeStream.foreachBatch(held.apply).option("checkpointLocation", f"{at}-state").trigger(availableNow=True).start()
    run.awaitTermination()
    inside = held.negatives().where("r1 = r2").select(F.col("r1").alias("root"), F.col("n").alias("inside"))
    across = held.negatives().where("r1 <> r2")
    others = across.select(F.col("r1").alias("root")).union(across.select("r2")).groupBy("root").agg(F.count(F.lit(1)).alias("others"))
    zero = F.lit(0).cast("long")
    return held.roots().join(inside, "root", "left").join(others, "root", "left").select("node", "root", F.coalesce("inside", zero).alias("inside"), F.coalesce("others", zero).alias("others"))


def _cohorts(role: str, *tests: str) -> str:
    return " UNION ALL ".join(f"SELECT {i} AS config, '{role}' AS role, aid FROM obs WHERE {t}" for i, t in enumerate(tests))


def _sized(of: str) -> str:
    return f"""SELECT config, role, aid FROM {of} JOIN (SELECT config, min(count(*)) OVER (ORDER BY config) AS most FROM {of} GROUP BY config) USING (config)
QUALIFY row_number() OVER (PARTITION BY config ORDER BY md5(aid || ':0'), aid) <= most"""


CONFIGS = [
    {"query": {"is_exemplar": True, "min_numfeat": 60}, "database": {"is_known": True, "max_numfeat": 50}},
    {"query": {"is_exemplar": True}, "database": {"is_known": True}},
    {"query": {"is_exemplar": True, "require_gps": True}, "database": {}},
]


@query("WITH " + OBS_SQL + f""", q AS ({_cohorts("query", "exemplar AND numfeat >= 60", "exemplar", "exemplar AND lat IS NOT NULL AND lon IS NOT NULL")}),
qs AS ({_sized("q")}), d AS (SELECT * FROM ({_cohorts("database", "nid > 0 AND numfeat <= 50", "nid > 0", "true")}) WHERE (config, aid) NOT IN (SELECT (config, aid) FROM qs)), ds AS ({_sized("d")})
SELECT * FROM qs UNION ALL SELECT * FROM ds""")
def consistent_cohorts(spark: SparkSession, sf: str) -> DataFrame:
    return cohort.expand_consistently(observations(spark, sf), CONFIGS)


@query("WITH " + OBS_SQL + """, b AS (SELECT *, nid * 100000 + imgset AS image FROM obs), i AS (SELECT image, row_number() OVER (ORDER BY image) - 1 AS image_id FROM b GROUP BY image)
SELECT row_number() OVER (ORDER BY aid) - 1 AS id, image_id, image || '.jpg' AS file_name, view AS category, numfeat::DOUBLE AS x, quality::DOUBLE AS y, value::DOUBLE AS w, 1::DOUBLE AS h FROM b JOIN i USING (image)""")
def coco_export(spark: SparkSession, sf: str) -> DataFrame:
    """Observations as boxes, a name's day as an image: written, and read back with their images."""
    boxes = observations(spark, sf).select(F.col("aid").alias("id"), (F.col("nid") * 100000 + F.col("imgset")).alias("image_id"), F.col("view").alias("category"), F.col("numfeat").alias("x"), F.col("quality").alias("y"), F.col("value").alias("w"), F.lit(1.0).alias("h"))
    images = boxes.select(F.col("image_id").alias("id")).distinct().select("id", F.concat(F.col("id").cast("string"), F.lit(".jpg")).alias("file_name"), F.lit(640).alias("width"), F.lit(480).alias("height"))
    at = fresh_path(spark, "coco")
    write_coco(images, boxes, at)
    got, rows = read_coco(spark, f"{at}/coco-*.json")
    return rows.join(got.select(F.col("id").alias("image_id"), "file_name"), "image_id").select("id", "image_id", "file_name", "category", "x", "y", "w", "h")
