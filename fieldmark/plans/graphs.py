"""Queries on sessions, review graphs, evaluation, stores and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldmark.functions.keys import name_key
from fieldmark.operators import components_deep, deltas, graph, metrics, sessions
from fieldmark.plans.registry import APART_SQL, OBS_SQL, ROOTS_SQL, observations, query, review_edges
from fieldmark.sources.tables import table

WITH = f"WITH {OBS_SQL} "
APART = f"WITH {APART_SQL} "
REC = f"WITH RECURSIVE {ROOTS_SQL} "


@query(APART + ", g AS (SELECT *, coalesce((t - lag(t) OVER (PARTITION BY nid ORDER BY t, aid) > 86400)::INT, 1) AS new FROM obs) SELECT aid, nid, sum(new) OVER (PARTITION BY nid ORDER BY t, aid)::BIGINT AS session FROM g")
def sessions_gap(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.gap_sessions(observations(spark, sf), 86400).select("aid", name_key(F.col("aid"), F.col("nid")).alias("nid"), "session")


@query(APART + ', g AS (SELECT *, coalesce((t - lag(t) OVER (PARTITION BY nid ORDER BY t, aid) > 86400)::INT, 1) AS new FROM obs), s AS (SELECT *, sum(new) OVER (PARTITION BY nid ORDER BY t, aid)::BIGINT AS session FROM g) SELECT nid, session, count(*) AS n, min(t) AS start, max(t) AS "end" FROM s GROUP BY nid, session')
def sessions_stats(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.session_stats(sessions.gap_sessions(observations(spark, sf), 86400))


@query(WITH + ", g AS (SELECT *, CASE WHEN t - lag(t) OVER (ORDER BY t, aid) > 900 THEN 1 ELSE 0 END AS new FROM obs), s AS (SELECT aid, sum(new) OVER (ORDER BY t, aid) AS c FROM g) SELECT aid, c::BIGINT AS chunk FROM s")
def time_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.chunks_of_time(observations(spark, sf), 900).select("aid", F.col("chunk").cast("long").alias("chunk"))


@query("WITH RECURSIVE " + OBS_SQL + """, p AS (SELECT aid, t, lat, lon, CASE WHEN lat IS NULL THEN 1 ELSE 0 END AS kind FROM obs),
e AS (SELECT x.aid AS a, y.aid AS b FROM p x JOIN p y ON x.kind = y.kind AND x.aid <> y.aid AND abs(x.t - y.t) <= 1200
  WHERE abs(x.t - y.t) + CASE WHEN x.kind = 1 THEN 0 ELSE 2 * 6367.0::DOUBLE * asin(sqrt(least(pow(sin((radians(y.lat) - radians(x.lat)) / 2), 2) + cos(radians(x.lat)) * cos(radians(y.lat)) * pow(sin((radians(y.lon) - radians(x.lon)) / 2), 2), 1.0))) / 0.5::DOUBLE END <= 1200),
r(node, reach) AS (SELECT aid, aid FROM p UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a)
SELECT node AS aid, min(reach) AS occurrence FROM r GROUP BY node""")
def occurrence_timespace(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.occurrences(observations(spark, sf), 1200, 0.5)


@query(WITH + """, k AS (SELECT aid, t, row_number() OVER (ORDER BY aid) - 1 AS pos FROM obs), w AS (SELECT n_nationkey::BIGINT AS waypoint, n_nationkey * 100 AS first, n_nationkey * 100 + 80 AS last FROM nation)
SELECT waypoint, count(*) AS n, min(t) AS start, max(t) AS "end" FROM k JOIN w ON pos >= first AND pos < last GROUP BY waypoint""")
def waypoint_ranges(spark: SparkSession, sf: str) -> DataFrame:
    rows = sessions.positions(observations(spark, sf), "aid")
    w = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("waypoint"), (F.col("n_nationkey") * 100).alias("first"), (F.col("n_nationkey") * 100 + 80).alias("last"))
    return sessions.waypoint_ranges(rows, w)


def _graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = review_edges(spark, sf)
    return e, graph.positive_components(e)


@query(REC + "SELECT node, root FROM roots")
def graph_components(spark: SparkSession, sf: str) -> DataFrame:
    return _graph(spark, sf)[1]


@query(REC + "SELECT root, negatives FROM bad")
def graph_inconsistent(spark: SparkSession, sf: str) -> DataFrame:
    return graph.inconsistent(*_graph(spark, sf))


@query(REC + """, per AS (SELECT r1, r2, bool_or(state = 'match') AS m, bool_or(state = 'nomatch') AS n, bool_or(state = 'notcomp') AS c, bool_or(state = 'unknown') AS u, count(*) AS edges FROM lab GROUP BY r1, r2)
SELECT r1, r2, CASE WHEN r1 = r2 AND r1 IN (SELECT root FROM bad) THEN 'inconsistent_internal' WHEN r1 IN (SELECT root FROM bad) OR r2 IN (SELECT root FROM bad) THEN 'inconsistent_external'
  WHEN m THEN 'positive' WHEN n THEN 'negative' WHEN c THEN 'incomparable' WHEN u THEN 'unknown' ELSE 'unreviewed' END AS category, edges FROM per""")
def graph_categories(spark: SparkSession, sf: str) -> DataFrame:
    return graph.categories(*_graph(spark, sf))


@query(REC + "SELECT r1, r2, count(*) AS n FROM lab WHERE state = 'nomatch' AND r1 <> r2 GROUP BY r1, r2")
def graph_metagraph(spark: SparkSession, sf: str) -> DataFrame:
    return graph.negative_counts(*_graph(spark, sf))


_NEG = """, sz AS (SELECT root, count(*) AS size FROM roots GROUP BY root), mg AS (SELECT r1, r2, count(*) AS n FROM lab WHERE state = 'nomatch' AND r1 <> r2 GROUP BY r1, r2),
neg AS (SELECT r1, r2, n FROM mg JOIN sz x ON x.root = r1 JOIN sz y ON y.root = r2 WHERE n >= 2 OR n = x.size OR n = y.size),
com AS (SELECT root, size FROM sz JOIN (SELECT r1, count(DISTINCT (a, b)) AS e FROM lab WHERE r1 = r2 AND state IN ('match', 'notcomp') GROUP BY r1) ON r1 = root WHERE e = size * (size - 1) / 2)"""


@query(REC + _NEG + " SELECT r1, r2, n FROM neg")
def graph_neg_redundant(spark: SparkSession, sf: str) -> DataFrame:
    return graph.negative_redundant(*_graph(spark, sf))


@query(REC + _NEG + " SELECT root, size FROM com")
def graph_pos_complete(spark: SparkSession, sf: str) -> DataFrame:
    return graph.complete_components(*_graph(spark, sf))


@query(REC + _NEG + " SELECT a, b, state FROM lab WHERE (r1, r2) NOT IN (SELECT (r1, r2) FROM neg) AND NOT (r1 = r2 AND r1 IN (SELECT root FROM com))")
def graph_not_redundant(spark: SparkSession, sf: str) -> DataFrame:
    return graph.not_redundant(*_graph(spark, sf))


@query(REC + "SELECT a, b, round(value + CASE WHEN r1 = r2 AND r1 IN (SELECT root FROM bad) THEN 10 ELSE 0 END, 6) AS priority FROM lab")
def graph_priority(spark: SparkSession, sf: str) -> DataFrame:
    return graph.priorities(*_graph(spark, sf), "value").withColumn("priority", F.round("priority", 6))


@query(REC + "SELECT count(*) FILTER (state = 'match') AS match, count(*) FILTER (state = 'nomatch') AS nomatch, count(*) FILTER (state = 'notcomp') AS notcomp, count(*) FILTER (state = 'unreviewed') AS unreviewed, count(*) FILTER (state = 'unknown') AS unknown, (SELECT count(DISTINCT root) FROM roots) AS components, (SELECT count(*) FROM bad) AS inconsistent FROM edges")
def graph_status(spark: SparkSession, sf: str) -> DataFrame:
    return graph.status(*_graph(spark, sf))


@query(REC + "SELECT r1, r2, count(*) AS n FROM lab WHERE r1 <> r2 GROUP BY r1, r2")
def graph_collapse(spark: SparkSession, sf: str) -> DataFrame:
    return graph.collapse(*_graph(spark, sf))


BRIDGES_SQL = f"""WITH RECURSIVE {ROOTS_SQL},
me AS (SELECT DISTINCT a, b FROM edges WHERE state = 'match'),
way(a, b, node) AS (SELECT a, b, a FROM me UNION SELECT w.a, w.b, m.b FROM way w JOIN m ON m.a = w.node AND NOT (least(m.a, m.b) = w.a AND greatest(m.a, m.b) = w.b)),
br AS (SELECT a, b FROM me WHERE (a, b) NOT IN (SELECT (a, b) FROM way WHERE node = way.b)),
m2 AS (SELECT m.a, m.b FROM m WHERE (least(m.a, m.b), greatest(m.a, m.b)) NOT IN (SELECT (a, b) FROM br)),
r2(node, reach) AS (SELECT node, node FROM nodes UNION SELECT r2.node, m2.b FROM r2 JOIN m2 ON r2.reach = m2.a)"""


@query(BRIDGES_SQL + " SELECT root, a, b FROM br JOIN roots ON node = a")
def graph_bridges(spark: SparkSession, sf: str) -> DataFrame:
    return components_deep.bridges(review_edges(spark, sf))


@query(BRIDGES_SQL + " SELECT node, min(reach) AS root FROM r2 GROUP BY node")
def graph_two_edge_components(spark: SparkSession, sf: str) -> DataFrame:
    return components_deep.two_edge_components(review_edges(spark, sf))


@query(BRIDGES_SQL + " SELECT root, count(*) AS size FROM roots WHERE root NOT IN (SELECT root FROM br JOIN roots ON node = a) GROUP BY root HAVING count(*) > 1")
def graph_pos_redundant_k2(spark: SparkSession, sf: str) -> DataFrame:
    return components_deep.positive_redundant(review_edges(spark, sf), 2)


@query()
def graph_mincut(spark: SparkSession, sf: str) -> DataFrame:
    return components_deep.cut_hypotheses(review_edges(spark, sf), "value")


@query()
def graph_augment(spark: SparkSession, sf: str) -> DataFrame:
    return components_deep.augment(review_edges(spark, sf))


@query()
def relabel_consistent(spark: SparkSession, sf: str) -> DataFrame:
    """Components get back old names, each name once: a user's own, or where the value is over 50 the one that three users share."""
    e, roots = _graph(spark, sf)
    old = F.when(F.col("value") > 50, F.floor(F.col("user_id") / 3) * 3).otherwise(F.col("user_id"))
    own = roots.join(table(spark, sf, "events").select(F.col("event_id").alias("node"), old.alias("old")), "node")
    return components_deep.consistent_labels(components_deep.with_parts(own.groupBy(F.col("root").alias("grp"), "old").agg(F.count(F.lit(1)).alias("n"))))


@query("""SELECT l_partkey AS a, l_suppkey AS b, arg_max(l_returnflag, (l_shipdate, l_orderkey, l_linenumber, l_returnflag)) AS state, count(*) AS reviews FROM lineitem GROUP BY 1, 2""")
def review_latest(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, "lineitem").withColumnsRenamed({"l_partkey": "a", "l_suppkey": "b", "l_returnflag": "state"})
    return graph.latest_reviews(log, [F.desc("l_shipdate"), F.desc("l_orderkey"), F.desc("l_linenumber"), F.desc("state")])


@query("SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS by_user, arg_max(role, turn) AS last_role FROM conversations GROUP BY conv_id")
def review_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.count_if(F.col("role") == "user").alias("by_user"), F.max_by("role", "turn").alias("last_role"))


@query("""WITH RECURSIVE k AS (SELECT conv_id, length(text) % 2 AS v, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
s AS (SELECT conv_id, i, 0.5::DOUBLE * v + 0.5::DOUBLE AS e FROM k WHERE i = 1 UNION ALL SELECT k.conv_id, k.i, 0.5::DOUBLE * k.v + 0.5::DOUBLE * s.e FROM s JOIN k ON k.conv_id = s.conv_id AND k.i = s.i + 1)
SELECT conv_id, count(*) AS n, round(arg_max(e, i), 6) AS ewma FROM s GROUP BY conv_id""")
def ewma_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Moving average of span 3 over each conversation's turns, from 1."""
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", (F.length("text") % 2).alias("v")))).alias("o"))
    mean = F.aggregate("o", F.lit(1.0), lambda s, x: F.lit(0.5) * x["v"] + F.lit(0.5) * s)
    return rows.select("conv_id", F.size("o").cast("long").alias("n"), F.round(mean, 6).alias("ewma"))


_PRED = "p AS (SELECT quality = 1 AS truth, least(n_chars, 5000) / 5000.0::DOUBLE AS score, n_chars >= 500 AS predicted FROM labels JOIN documents USING (doc_id))"


def _pred(spark: SparkSession, sf: str) -> DataFrame:
    both = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return both.select((F.col("quality") == 1).alias("truth"), (F.least(F.col("n_chars"), F.lit(5000)) / 5000.0).alias("score"), (F.col("n_chars") >= 500).alias("predicted"))


_CURVE = _PRED + """, c AS (SELECT i, count(*) FILTER (truth AND floor(score * 100 + 1e-9) >= i) AS tp, count(*) FILTER (NOT truth AND floor(score * 100 + 1e-9) >= i) AS fp, count(*) FILTER (truth AND floor(score * 100 + 1e-9) < i) AS fn FROM p, range(101) r(i) GROUP BY i),
g AS (SELECT i / 100.0::DOUBLE AS conf, tp, fp, fn, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall FROM c WHERE tp + fp > 0 AND tp + fn > 0)"""


@query(f"WITH {_CURVE} SELECT conf, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall FROM g")
def pr_grid(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.pr_grid(_pred(spark, sf)).withColumn("precision", F.round("precision", 6)).withColumn("recall", F.round("recall", 6))


@query(f"WITH {_CURVE} SELECT conf, round((SELECT max(precision) FROM g h WHERE h.recall >= g.recall), 6) AS interp FROM g")
def pr_interpolated(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.interpolated(metrics.pr_grid(_pred(spark, sf))).select("conf", F.round("interp", 6).alias("interp"))


@query(f"WITH {_CURVE}, r AS (SELECT i / 10.0::DOUBLE AS r FROM range(11) x(i)), b AS (SELECT r, coalesce((SELECT max(precision) FROM g WHERE recall >= r - 1e-12), 0) AS p FROM r) SELECT round(avg(p), 6) AS ap FROM b")
def pr_interpolated_ap(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.average_precision_at(metrics.pr_grid(_pred(spark, sf))).select(F.round("ap", 6).alias("ap"))


@query(f"WITH {_CURVE} SELECT conf, round(precision, 6) AS precision, round(recall, 6) AS recall FROM g ORDER BY round(sqrt(pow(1 - precision, 2) + pow(1 - recall, 2)), 9), conf LIMIT 1")
def operating_point(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.operating_point(metrics.pr_grid(_pred(spark, sf))).select("conf", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(f"WITH {_PRED} SELECT truth, predicted, count(*) AS n FROM p GROUP BY ALL")
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion(_pred(spark, sf))


@query(f"WITH {_PRED}, w AS (SELECT sum(CASE WHEN x.score > y.score THEN 1.0 WHEN x.score = y.score THEN 0.5 ELSE 0 END)::DOUBLE AS w, count(*) AS n FROM p x, p y WHERE x.truth AND NOT y.truth) SELECT round(w / n, 6) AS auc FROM w")
def auc(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.auc(_pred(spark, sf)).select(F.round("auc", 6).alias("auc"))


@query(f"""WITH {_PRED}, n AS (SELECT count(*) FILTER (truth AND predicted)::DOUBLE AS tp, count(*) FILTER (NOT truth AND predicted)::DOUBLE AS fp, count(*) FILTER (truth AND NOT predicted)::DOUBLE AS fn, count(*) FILTER (NOT truth AND NOT predicted)::DOUBLE AS tn FROM p)
SELECT round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(fp / (fp + tn), 6) AS fpr, round(tp / (tp + fp) + tn / (tn + fn) - 1, 6) AS markedness, round(tp / (tp + fn) - fp / (fp + tn), 6) AS bookmaker,
  round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc FROM n""")
def mcc_report(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.binary_report(_pred(spark, sf)).select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "fpr", "markedness", "bookmaker", "mcc")])


@query(f"WITH {_PRED}, s AS (SELECT DISTINCT score FROM p), f AS (SELECT s.score, (SELECT count(*) FROM p WHERE NOT truth AND p.score >= s.score) / (SELECT count(*) FROM p WHERE NOT truth) AS fpr FROM s) SELECT min(score) AS thresh FROM f WHERE fpr <= 0.25")
def threshold_at_fpr(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.threshold_at_fpr(_pred(spark, sf), 0.25)


_BOXES = """tb AS (SELECT l_orderkey AS image, l_linenumber * 100000 + l_partkey AS id, l_quantity AS x, l_tax * 100 AS y, l_quantity + 10 AS w, l_discount * 100 + 10 AS h FROM lineitem WHERE l_linestatus = 'O'),
pb AS (SELECT l_orderkey AS image, l_linenumber * 100000 + l_partkey AS id, l_quantity AS x, l_tax * 100 AS y, l_quantity + 10 AS w, l_discount * 100 + 10 AS h, l_extendedprice AS conf FROM lineitem WHERE l_linestatus = 'F')"""


def _boxes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    b = table(spark, sf, "lineitem").select("l_linestatus", F.col("l_orderkey").alias("image"), (F.col("l_linenumber").cast("long") * 100000 + F.col("l_partkey")).alias("id"), F.col("l_quantity").alias("x"), (F.col("l_tax") * 100).alias("y"), (F.col("l_quantity") + 10).alias("w"), (F.col("l_discount") * 100 + 10).alias("h"), F.col("l_extendedprice").alias("conf"))
    return b.where("l_linestatus = 'O'").drop("l_linestatus", "conf"), b.where("l_linestatus = 'F'").drop("l_linestatus")


_IOU = _BOXES + """, i AS (SELECT t.image, t.id AS t, p.id AS p, p.conf, least(t.x + t.w, p.x + p.w) - greatest(t.x, p.x) AS ww, least(t.y + t.h, p.y + p.h) - greatest(t.y, p.y) AS hh, t.w * t.h + p.w * p.h AS area FROM tb t JOIN pb p ON t.image = p.image),
v AS (SELECT image, t, p, conf, CASE WHEN ww <= 0 OR hh <= 0 THEN 0.0 ELSE ww * hh / (area - ww * hh) END AS iou FROM i)"""


@query(f"WITH {_IOU} SELECT image, t, p, conf, round(iou, 6) AS iou FROM v")
def iou_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.iou_pairs(*_boxes(spark, sf)).withColumn("iou", F.round("iou", 6))


@query(f"""WITH {_IOU}, b AS (SELECT * FROM v WHERE iou > 0.5 QUALIFY row_number() OVER (PARTITION BY image, p ORDER BY iou DESC, t) = 1), w AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY image, t ORDER BY conf DESC, p) = 1)
SELECT (SELECT count(*) FROM w) AS tp, (SELECT count(*) FROM pb) - (SELECT count(*) FROM w) AS fp, (SELECT count(*) FROM tb) - (SELECT count(*) FROM w) AS fn""")
def box_assignment(spark: SparkSession, sf: str) -> DataFrame:
    truth, pred = _boxes(spark, sf)
    return metrics.assign_boxes(metrics.iou_pairs(truth, pred), truth, pred, 0.5)


@query(f"""WITH {_IOU}, b AS (SELECT * FROM v WHERE iou > 0.5 QUALIFY row_number() OVER (PARTITION BY image, p ORDER BY iou DESC, t) = 1), w AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY image, t ORDER BY conf DESC, p) = 1),
c AS (SELECT conf, count(*) AS n, coalesce(any_value(k), 0) AS k FROM pb LEFT JOIN (SELECT conf, count(*) AS k FROM w GROUP BY conf) USING (conf) GROUP BY conf)
SELECT conf, sum(k) OVER o AS tp, sum(n) OVER o - sum(k) OVER o AS fp FROM c WINDOW o AS (ORDER BY conf DESC)""")
def box_tp_fp(spark: SparkSession, sf: str) -> DataFrame:
    truth, pred = _boxes(spark, sf)
    return metrics.cumulative_tp_fp(metrics.iou_pairs(truth, pred), pred, 0.5)


@query()
def nms(spark: SparkSession, sf: str) -> DataFrame:
    return components_deep.suppress(_boxes(spark, sf)[1], 0.5)


@query()
def merge_reviewer_boxes(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "lineitem")
    rows = b.select(F.col("l_orderkey").alias("image"), (F.col("l_linenumber").cast("long") * 100000 + F.col("l_partkey")).alias("id"), (F.col("l_linenumber") % 3).alias("reviewer"), F.col("l_quantity").alias("x"), (F.col("l_tax") * 100).alias("y"), (F.col("l_quantity") + 10).alias("w"), (F.col("l_discount") * 100 + 10).alias("h"), (F.col("l_returnflag") == "A").alias("interest"))
    return components_deep.merge_boxes(rows, 0.25, 2)


@query("SELECT k.pos, k.o_custkey, c_name, c_mktsegment FROM (SELECT o_orderkey AS pos, o_custkey FROM orders) k LEFT JOIN customer ON c_custkey = k.o_custkey")
def lookup_order_preserving(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "orders").select(F.col("o_orderkey").alias("pos"), "o_custkey")
    return deltas.lookup(ids, table(spark, sf, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey", "c_name", "c_mktsegment")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def lookup_missing_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").join(table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("SELECT l_orderkey, l_linenumber, c_name, n_name, r_name FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def fk_chain_names(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda n: table(spark, sf, n)
    out = t("lineitem").select("l_orderkey", "l_linenumber").join(t("orders").select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    out = out.join(t("customer").select("c_custkey", "c_name", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey"), "left").join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left").join(t("region"), F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return out.select("l_orderkey", "l_linenumber", "c_name", "n_name", "r_name")


@query("WITH k AS (SELECT s_suppkey FROM supplier WHERE s_acctbal > 9000), l AS (SELECT * FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM k)), o AS (SELECT * FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM l)) SELECT 'lineitem' AS part, count(*) AS n FROM l UNION ALL SELECT 'orders', count(*) FROM o UNION ALL SELECT 'customer', count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM o)")
def export_closure(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda n: table(spark, sf, n)
    keys = t("supplier").where("s_acctbal > 9000").select(F.col("s_suppkey").alias("l_suppkey"))
    parts = deltas.export_closure(t("lineitem"), keys, "l_suppkey", [(t("orders"), "o_orderkey", "l_orderkey"), (t("customer"), "c_custkey", "o_custkey")])
    counts = [p.agg(F.lit(n).alias("part"), F.count(F.lit(1)).alias("n")) for p, n in zip(parts, ("lineitem", "orders", "customer"), strict=True)]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("WITH o AS (SELECT replace(n_name, '_1', '_X') AS r_name FROM nation UNION SELECT r_name FROM region) SELECT r_regionkey, r_name FROM region UNION ALL SELECT (SELECT max(r_regionkey) FROM region) + row_number() OVER (ORDER BY r_name), r_name FROM o WHERE r_name NOT IN (SELECT r_name FROM region)")
def merge_by_superkey(spark: SparkSession, sf: str) -> DataFrame:
    region = table(spark, sf, "region")
    other = table(spark, sf, "nation").select(F.lit(0).alias("r_regionkey"), F.replace("n_name", F.lit("_1"), F.lit("_X")).alias("r_name")).unionByName(region.select("r_regionkey", "r_name"))
    return deltas.merge_by_superkey(region, other, "r_name", "r_regionkey")


@query("WITH n AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 1 - quality ELSE quality END AS quality, toxic FROM labels), o AS (SELECT * FROM labels WHERE doc_id % 7 <> 0) SELECT n.doc_id, o.quality AS old_quality, n.quality AS new_quality, o.toxic AS old_toxic, n.toxic AS new_toxic, o.doc_id IS NULL AS is_new FROM n LEFT JOIN o USING (doc_id) WHERE o.doc_id IS NULL OR o.quality IS DISTINCT FROM n.quality OR o.toxic IS DISTINCT FROM n.toxic")
def state_delta(spark: SparkSession, sf: str) -> DataFrame:
    """Two snapshots of the labels: an old one that lacks every seventh document, a new one in which every fifth differs."""
    labels = table(spark, sf, "labels")
    new = labels.withColumn("quality", F.when(F.col("doc_id") % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    return deltas.state_delta(labels.where("doc_id % 7 <> 0"), new, ["doc_id"], ["quality", "toxic"])


@query("""WITH o AS (SELECT event_id AS node, user_id AS g FROM events), n AS (SELECT event_id AS node, CASE WHEN user_id % 4 = 0 THEN 1000000 + user_id // 8 WHEN user_id % 4 = 1 THEN user_id * 10 + event_id % 2 ELSE user_id * 10 END AS g FROM events),
s AS (SELECT g, count(*) AS no FROM o GROUP BY g), m AS (SELECT n.g, o.g AS o, count(*) AS c FROM n JOIN o USING (node) GROUP BY ALL),
p AS (SELECT m.g, count(*) AS olds, bool_and(c = no) AS whole FROM m JOIN s ON s.g = m.o GROUP BY m.g)
SELECT CASE WHEN olds = 1 AND whole THEN 'unchanged' WHEN olds = 1 THEN 'split' WHEN whole THEN 'merge' ELSE 'hybrid' END AS kind, count(*) AS groups FROM p GROUP BY 1""")
def grouping_delta(spark: SparkSession, sf: str) -> DataFrame:
    """Users as old groups; as new ones some users joined two by two, some cut in two."""
    e, u = table(spark, sf, "events"), F.col("user_id")
    new = F.when(u % 4 == 0, 1000000 + F.floor(u / 8)).when(u % 4 == 1, u * 10 + F.col("event_id") % 2).otherwise(u * 10)
    return deltas.grouping_delta(e.select(F.col("event_id").alias("node"), u.alias("grp")), e.select(F.col("event_id").alias("node"), new.alias("grp")))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def integrity_dangling_fk(spark: SparkSession, sf: str) -> DataFrame:
    return deltas.dangling(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "l_orderkey", table(spark, sf, "orders").where("o_orderstatus <> 'P'"), "o_orderkey")


@query("SELECT s_suppkey, format('LOC_{}_{:04d}', s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey)) AS new_name FROM supplier")
def consecutive_rename(spark: SparkSession, sf: str) -> DataFrame:
    return deltas.consecutive_names(table(spark, sf, "supplier"), "s_nationkey", "s_suppkey", "LOC").select("s_suppkey", "new_name")


@query("SELECT max(regexp_extract(n_name, '^NATION_?([0-9]+)$', 1)::BIGINT) + 1 AS next FROM nation")
def next_free_number(spark: SparkSession, sf: str) -> DataFrame:
    return deltas.next_number(table(spark, sf, "nation"), "n_name", "NATION")


@query("SELECT * FROM (SELECT p_partkey, p_size + 1 AS p_size FROM part WHERE p_type = 'SMALL' UNION ALL SELECT p_partkey, p_size FROM part WHERE p_type <> 'SMALL')")
def update_by_key(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select("p_partkey", "p_size", "p_type")
    return deltas.update_column(part, part.where("p_type = 'SMALL'").select("p_partkey", (F.col("p_size") + 1).alias("p_size")), "p_partkey", "p_size").select("p_partkey", "p_size")


@query("WITH k AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY') SELECT 'customer' AS part, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM k) UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM k)")
def delete_cascade(spark: SparkSession, sf: str) -> DataFrame:
    t = {n: table(spark, sf, n) for n in ("customer", "orders")}
    left = deltas.delete_cascade(t, "customer", "c_custkey", t["customer"].where("c_mktsegment = 'MACHINERY'").select("c_custkey"), {"orders": "o_custkey"})
    return left["customer"].agg(F.lit("customer").alias("part"), F.count(F.lit(1)).alias("n")).unionByName(left["orders"].agg(F.lit("orders").alias("part"), F.count(F.lit(1)).alias("n")))
