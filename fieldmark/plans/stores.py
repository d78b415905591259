"""Queries on whole stores: merging, parts, associations with their times, exports as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldmark.lineage import fresh_path
from fieldmark.operators.associations import association_times, matrix_rows
from fieldmark.operators.stores import merge_stores, store_part
from fieldmark.plans.registry import OBS_SQL, observations, query
from fieldmark.sources.tables import table
from fieldmark.sources.voc import read_voc, write_voc

# Two stores of orders as annots and customers as names: one has all but the open orders, the other all but the filled ones
# and numbers its rows in its own way, so that pending orders stand in both.
_STORES = """one AS (SELECT o_orderkey AS aid, o_custkey AS nid, 'order ' || o_orderkey AS annot_uuid FROM orders WHERE o_orderstatus <> 'O'),
two AS (SELECT o_orderkey * 3 + 1 AS aid, o_custkey * 5 + 2 AS nid, 'order ' || o_orderkey AS annot_uuid FROM orders WHERE o_orderstatus <> 'F'),
names1 AS (SELECT c_custkey AS nid, c_name AS name_text FROM customer WHERE c_custkey IN (SELECT nid FROM one)),
names2 AS (SELECT c_custkey * 5 + 2 AS nid, c_name AS name_text FROM customer WHERE c_custkey * 5 + 2 IN (SELECT nid FROM two)),
m1 AS (SELECT n.nid AS old, coalesce(h.nid, (SELECT max(nid) FROM names1) + row_number() OVER (PARTITION BY h.nid IS NULL ORDER BY n.nid)) AS new, n.name_text FROM names2 n LEFT JOIN names1 h USING (name_text)),
m2 AS (SELECT n.aid AS old, coalesce(h.aid, (SELECT max(aid) FROM one) + row_number() OVER (PARTITION BY h.aid IS NULL ORDER BY n.aid)) AS new, h.aid IS NULL AS added, n.nid, n.annot_uuid FROM two n LEFT JOIN one h USING (annot_uuid)),
names AS (SELECT * FROM names1 UNION ALL SELECT new, name_text FROM m1 WHERE name_text NOT IN (SELECT name_text FROM names1)),
annots AS (SELECT * FROM one UNION ALL SELECT m2.new, m1.new, annot_uuid FROM m2 JOIN m1 ON m1.old = m2.nid WHERE added)"""
_PAIRS = """, o1 AS (SELECT aid, nid, lead(aid) OVER (PARTITION BY nid ORDER BY aid) AS b FROM one), o2 AS (SELECT aid, lead(aid) OVER (PARTITION BY nid ORDER BY aid) AS b FROM two),
p1 AS (SELECT aid AS aid1, b AS aid2, 'one' AS side FROM o1 WHERE b IS NOT NULL), p2 AS (SELECT y.new AS aid1, x.new AS aid2, 'two' AS side FROM o2 JOIN m2 x ON x.old = o2.aid JOIN m2 y ON y.old = o2.b),
pairs AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2 WHERE (least(aid1, aid2), greatest(aid1, aid2)) NOT IN (SELECT (least(aid1, aid2), greatest(aid1, aid2)) FROM p1))"""


def two_stores(spark: SparkSession, sf: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    orders, customers = table(spark, sf, "orders"), table(spark, sf, "customer")
    out = []
    for without, side, aid, nid in (("O", "one", F.col("o_orderkey"), F.col("o_custkey")), ("F", "two", F.col("o_orderkey") * 3 + 1, F.col("o_custkey") * 5 + 2)):
        kept = orders.where(F.col("o_orderstatus") != without)
        annots = kept.select(aid.alias("aid"), nid.alias("nid"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("annot_uuid"))
        names = customers.join(kept.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select((F.col("c_custkey") if side == "one" else F.col("c_custkey") * 5 + 2).alias("nid"), F.col("c_name").alias("name_text"))
        later = annots.select("aid", F.lead("aid").over(W.partitionBy("nid").orderBy("aid")).alias("b")).where("b is not null")
        a, b = ("aid", "b") if side == "one" else ("b", "aid")
        pairs = later.select(F.col("aid").alias("am_id"), F.col(a).alias("aid1"), F.col(b).alias("aid2"), F.lit(side).alias("side"))
        out.append({"names": names, "annots": annots, "annotmatch": pairs})
    return out[0], out[1]


@query(f"WITH {_STORES} SELECT aid, annot_uuid, nid, name_text FROM annots JOIN names USING (nid)")
def store_merge(spark: SparkSession, sf: str) -> DataFrame:
    """The annots of two merged stores with their names."""
    merged, _ = merge_stores(*two_stores(spark, sf))
    return merged["annots"].join(merged["names"], "nid").select("aid", "annot_uuid", "nid", "name_text")


@query(f"WITH {_STORES}{_PAIRS} SELECT aid1, aid2, side FROM pairs")
def store_merge_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The pairs of two merged stores; the second lists them the other way round, so its ids are remapped before they are compared."""
    merged, _ = merge_stores(*two_stores(spark, sf))
    return merged["annotmatch"].select("aid1", "aid2", "side")


@query(f"WITH {_STORES}, rich AS (SELECT c_custkey AS nid FROM customer WHERE c_acctbal > 5000), part AS (SELECT * FROM one WHERE nid IN (SELECT nid FROM rich)), o1 AS (SELECT aid, lead(aid) OVER (PARTITION BY nid ORDER BY aid) AS b FROM one) SELECT 'annot' AS kind, aid AS a, nid AS b FROM part UNION ALL SELECT 'name', nid, NULL FROM names1 WHERE nid IN (SELECT nid FROM rich) UNION ALL SELECT 'pair', aid, b FROM o1 WHERE aid IN (SELECT aid FROM part) AND b IN (SELECT aid FROM part)")
def store_parts(spark: SparkSession, sf: str) -> DataFrame:
    """What customers with a high balance need of a store."""
    mine, _ = two_stores(spark, sf)
    part = store_part(mine, "names", table(spark, sf, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("nid")))
    rows = lambda kind, df, a, b: df.select(F.lit(kind).alias("kind"), F.col(a).alias("a"), b.cast("long").alias("b"))
    return rows("annot", part["annots"], "aid", F.col("nid")).union(rows("name", part["names"], "nid", F.lit(None))).union(rows("pair", part["annotmatch"], "aid1", F.col("aid2")))


_MET = """m AS (SELECT DISTINCT l_orderkey AS grp, 's' || l_suppkey AS name FROM lineitem),
p AS (SELECT x.name AS name1, y.name AS name2, epoch_us(o_orderdate) // 1000000 AS t FROM m x JOIN m y ON x.grp = y.grp AND x.name <= y.name JOIN orders ON o_orderkey = x.grp)"""


def _met(spark: SparkSession, sf: str) -> DataFrame:
    """An order as an occurrence, its suppliers as names."""
    at = table(spark, sf, "orders").select(F.col("o_orderkey").alias("grp"), F.floor(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', o_orderdate)") / 1000000).cast("long").alias("t"))
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("grp"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("name"))
    return association_times(rows.join(at, "grp"))


@query(f"WITH {_MET}, d AS (SELECT name1, name2, t, count(*) AS groups FROM p GROUP BY ALL) SELECT name1, name2, sum(groups)::BIGINT AS groups, count(*) AS n, string_agg(t, ',' ORDER BY t::VARCHAR) AS times FROM d GROUP BY name1, name2")
def association_list(spark: SparkSession, sf: str) -> DataFrame:
    return _met(spark, sf).withColumn("times", F.array_join("times", ","))


@query(f"WITH {_MET}, c AS (SELECT name1, name2, count(*) AS n FROM p GROUP BY ALL), s AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS pos FROM (SELECT DISTINCT name FROM m)) SELECT r.pos, r.name, string_agg(coalesce(n::VARCHAR, ''), ',' ORDER BY q.pos) AS cells FROM s r CROSS JOIN s q LEFT JOIN c ON c.name2 = r.name AND c.name1 = q.name GROUP BY ALL")
def association_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return matrix_rows(_met(spark, sf))


# A name's day is an image, twice as high as wide for every other name; observations are boxes in it, turned by nothing.
_VOC = OBS_SQL + """, b AS (SELECT *, nid * 100000 + imgset AS image FROM obs),
i AS (SELECT image, row_number() OVER (ORDER BY image) AS pos, CASE WHEN any_value(nid) % 2 = 0 THEN 400 ELSE 1600 END AS w, 800 AS h FROM b GROUP BY image),
s AS (SELECT *, 900.0::DOUBLE / greatest(w, h) AS f, CASE WHEN w > h THEN 900 ELSE trunc(900 * (w / h))::BIGINT END AS sw, CASE WHEN w > h THEN trunc(900 * (h / w))::BIGINT ELSE 900 END AS sh FROM i)"""


@query(f"WITH {_VOC} SELECT '2000_' || lpad(pos::VARCHAR, 6, '0') AS name, sw::BIGINT AS width, sh::BIGINT AS height, view AS category, quality::VARCHAR AS view, trunc(3 * numfeat * f)::BIGINT AS xmin, trunc(numfeat * f)::BIGINT AS ymin, least(trunc((3 * numfeat + 40) * f)::BIGINT, sw - 1)::BIGINT AS xmax, least(trunc((numfeat + 60) * f)::BIGINT, sh - 1)::BIGINT AS ymax FROM b JOIN s USING (image) WHERE quality <> -1 AND view <> 'error'")
def voc_export(spark: SparkSession, sf: str) -> DataFrame:
    """Observations as boxes, written as archives of XML and read back; errors are no species of the export."""
    obs = observations(spark, sf).withColumn("image_id", F.col("nid") * 100000 + F.col("imgset"))
    boxes = obs.where("quality <> -1").select(F.col("aid").alias("id"), "image_id", F.col("view").alias("category"), F.col("quality").alias("view"), (3 * F.col("numfeat")).alias("x"), F.col("numfeat").alias("y"), F.lit(40).alias("w"), F.lit(60).alias("h"), F.lit(0.0).alias("theta"))
    images = obs.groupBy(F.col("image_id").alias("id")).agg(F.any_value("nid").alias("nid")).select("id", F.concat(F.col("id").cast("string"), F.lit(".jpg")).alias("file_name"), F.when(F.col("nid") % 2 == 0, 400).otherwise(1600).alias("width"), F.lit(800).alias("height"), F.when(F.col("nid") == 0, "test").alias("subset"))
    at = fresh_path(spark, "voc")
    write_voc(images, boxes, at, year=2000, species=["click", "view", "purchase", "signup"])
    return read_voc(spark, at).select("name", "width", "height", F.explode("boxes").alias("b")).select("name", "width", "height", "b.*")
