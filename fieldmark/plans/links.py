"""Queries on the descriptor index, on one observation against another, and on how review graphs hold together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.operators import connectivity, pair_matching
from fieldmark.operators.descriptor_index import DescriptorIndex, cover
from fieldmark.plans.registry import DESC_SQL, EDGES_SQL, ROOTS_SQL, VIEWS, descriptors, observations, query, review_edges
from fieldmark.sources.tables import table

CELLS, PROBES, NEAREST = 64, 8, 5


def _index(spark: SparkSession, sf: str) -> DescriptorIndex:
    """Built over the observations that are first of their name's, then all others added, then each name's last removed."""
    d = descriptors(spark, sf)
    index = DescriptorIndex.build(d.where("aid % 8 = 0"), cells=CELLS)
    index.add(d.where("aid % 8 <> 0"))
    index.remove(d.where("aid % 8 = 7").select("aid"))
    return index


@query(f"""WITH {DESC_SQL}, x AS (SELECT q.fx AS q_fx, d.fx AS d_fx, round(list_distance(q.vec, d.vec), 5) AS dist FROM d q JOIN d ON q.aid <> d.aid WHERE d.aid % 8 <> 7)
SELECT q_fx, d_fx, dist, row_number() OVER (PARTITION BY q_fx ORDER BY dist, d_fx) AS rank FROM x QUALIFY rank <= {NEAREST}""")
def index_exact(spark: SparkSession, sf: str) -> DataFrame:
    return _index(spark, sf).search(descriptors(spark, sf), NEAREST, probes=PROBES, exact=True, exclude="aid").select("q_fx", "d_fx", "dist", "rank")


@query()
def index_probed(spark: SparkSession, sf: str) -> DataFrame:
    return _index(spark, sf).search(descriptors(spark, sf), NEAREST, probes=CELLS * 5 // 8, exclude="aid").select("q_fx", "d_fx", "dist", "rank")


@query()
def index_cover(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as kept indexes of parts, large parts as those wanted."""
    wanted = table(spark, sf, "part").where("p_size > 20").select(F.col("p_partkey").alias("aid"))
    kept, missing = cover(wanted, table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_partkey").alias("aid")))
    return kept.select(F.col("key").cast("long").alias("key"), F.col("aid").cast("long").alias("aid")).unionByName(missing.select(F.lit(None).cast("long").alias("key"), F.col("aid").cast("long").alias("aid")))


#: All pairs of a name's observations, and each observation with its like of the next name.
_PAIRS_SQL = f"""{DESC_SQL}, o AS (SELECT DISTINCT aid, nid FROM d),
pairs AS (SELECT x.aid AS a, y.aid AS b FROM o x JOIN o y ON x.nid = y.nid AND x.aid < y.aid UNION SELECT x.aid, y.aid FROM o x JOIN o y ON y.aid = x.aid + 8),
dist AS (SELECT a, b, x.fx AS fx1, y.fx AS fx2, round(list_distance(x.vec, y.vec), 5) AS dist FROM pairs JOIN d x ON x.aid = a JOIN d y ON y.aid = b),
two AS (SELECT *, row_number() OVER w AS i, lead(dist) OVER w AS norm FROM dist WINDOW w AS (PARTITION BY a, b, fx1 ORDER BY dist, fx2)),
m AS (SELECT a, b, fx1, fx2, dist, norm, CASE WHEN norm > 0 THEN dist / norm ELSE 1.0 END AS ratio FROM two WHERE i = 1 AND norm IS NOT NULL),
matches AS (SELECT * FROM m WHERE ratio < 0.98)"""


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    o = descriptors(spark, sf).select("aid", "nid").distinct()
    same = o.select(F.col("aid").alias("a"), "nid").join(o.select(F.col("aid").alias("b"), "nid"), "nid").where("a < b").select("a", "b")
    return same.union(o.select((F.col("aid") - 8).alias("a"), F.col("aid").alias("b")).join(o.select(F.col("aid").alias("a")), "a", "left_semi").select("a", "b")).distinct()


def _matches(spark: SparkSession, sf: str, mutual: bool = False) -> DataFrame:
    return pair_matching.pair_matches(_pairs(spark, sf), descriptors(spark, sf), ratio=0.98, mutual=mutual)


@query(f"WITH {_PAIRS_SQL} SELECT a, b, fx1, fx2, dist, norm, round(ratio, 6) AS ratio FROM matches")
def pair_matches(spark: SparkSession, sf: str) -> DataFrame:
    return _matches(spark, sf).withColumn("ratio", F.round("ratio", 6))


@query(f"WITH {_PAIRS_SQL}, back AS (SELECT a, b, fx2, fx1 FROM dist QUALIFY row_number() OVER (PARTITION BY a, b, fx2 ORDER BY dist, fx1) = 1) SELECT a, b, fx1, fx2, dist FROM matches JOIN back USING (a, b, fx1, fx2)")
def pair_matches_mutual(spark: SparkSession, sf: str) -> DataFrame:
    return _matches(spark, sf, mutual=True).select("a", "b", "fx1", "fx2", "dist")


@query(f"""WITH {_PAIRS_SQL}, l AS (SELECT a, b, count(*) AS matches, sum((1 - ratio)::DECIMAL(18, 6))::DOUBLE AS score, min(dist) AS least_dist, round(min(ratio), 6) AS least_ratio, round(max(ratio), 6) AS most_ratio,
  round(avg(ratio), 6) AS mean_ratio, median(dist) AS median_dist, count(DISTINCT fx2) AS targets FROM matches GROUP BY a, b), f AS (SELECT aid, count(*) AS features, min(fx) AS first FROM d GROUP BY aid)
SELECT a, b, coalesce(matches, 0) AS matches, coalesce(score, 0) AS score, least_dist, least_ratio, most_ratio, mean_ratio, median_dist, coalesce(targets, 0) AS targets, abs(x.features - y.features) AS delta_features, abs(x.first - y.first) AS delta_first
FROM pairs LEFT JOIN l USING (a, b) JOIN f x ON x.aid = a JOIN f y ON y.aid = b""")
def pair_features(spark: SparkSession, sf: str) -> DataFrame:
    facts = descriptors(spark, sf).groupBy("aid").agg(F.count(F.lit(1)).alias("features"), F.min("fx").alias("first"))
    out = pair_matching.pair_features(_pairs(spark, sf), _matches(spark, sf), facts)
    return out.withColumns({c: F.round(c, 6) for c in ("least_ratio", "most_ratio")})


#: Keypoints as the descriptors' first numbers place them.
_KPTS_SQL = "k AS (SELECT aid, fx, 500 + 1000 * vec[1] AS x, 500 + 1000 * vec[2] AS y, exp(vec[3]) AS s, atan2(vec[4], vec[5]) AS o FROM d)"


def _keypoints(spark: SparkSession, sf: str) -> DataFrame:
    v = lambda i: F.col("vec")[i].cast("double")
    return descriptors(spark, sf).select("aid", "fx", (500 + 1000 * v(0)).alias("x"), (500 + 1000 * v(1)).alias("y"), F.exp(v(2)).alias("scale"), F.atan2(v(3), v(4)).alias("ori"))


@query(f"""WITH {_PAIRS_SQL}, {_KPTS_SQL},
p AS (SELECT a, b, fx1, fx2, u.x AS x1, u.y AS y1, u.s AS s1, u.o AS o1, v.x AS x2, v.y AS y2, v.s AS s2, v.o AS o2 FROM matches JOIN k u ON u.aid = a AND u.fx = fx1 JOIN k v ON v.aid = b AND v.fx = fx2),
e AS (SELECT a, b, 0.2 * sqrt(pow(max(x2) - min(x2), 2) + pow(max(y2) - min(y2), 2)) AS near FROM p GROUP BY a, b),
h AS (SELECT *, s2 / s1 * cos(o2 - o1) AS c, s2 / s1 * sin(o2 - o1) AS n FROM p),
t AS (SELECT h.a, h.b, h.fx1 AS hypothesis, h.fx2 AS h2, p.fx1, p.fx2, sqrt(pow(h.c * p.x1 - h.n * p.y1 + h.x2 - h.c * h.x1 + h.n * h.y1 - p.x2, 2) + pow(h.n * p.x1 + h.c * p.y1 + h.y2 - h.n * h.x1 - h.c * h.y1 - p.y2, 2)) AS xy_err,
  greatest(h.s2 / h.s1 * p.s1 / p.s2, p.s2 / (h.s2 / h.s1 * p.s1)) AS scale_err, abs(atan2(sin(h.o2 - h.o1 + p.o1 - p.o2), cos(h.o2 - h.o1 + p.o1 - p.o2))) AS ori_err FROM h JOIN p USING (a, b)),
g AS (SELECT t.* FROM t JOIN e USING (a, b) WHERE xy_err <= near + 1e-6 AND scale_err <= 2 AND ori_err <= pi() / 2),
b1 AS (SELECT a, b, hypothesis, h2 FROM (SELECT a, b, hypothesis, h2, count(*) AS n FROM g GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY n DESC, hypothesis, h2) = 1)
SELECT a, b, fx1, fx2, hypothesis, round(xy_err, 4) AS xy_err, round(scale_err, 6) AS scale_err, round(ori_err, 6) AS ori_err FROM g JOIN b1 USING (a, b, hypothesis, h2)""")
def spatial_hypotheses(spark: SparkSession, sf: str) -> DataFrame:
    out = pair_matching.spatially_verified(_matches(spark, sf), _keypoints(spark, sf), refine="none", share=0.2)
    return out.withColumn("xy_err", F.round("xy_err", 4)).withColumns({c: F.round(c, 6) for c in ("scale_err", "ori_err")})


@query()
def spatial_inliers(spark: SparkSession, sf: str) -> DataFrame:
    out = pair_matching.spatially_verified(_matches(spark, sf), _keypoints(spark, sf), share=0.2)
    return out.withColumns({c: F.round(c, 4) for c in ("xy_err", "scale_err", "ori_err")})


@query()
def graph_k3_components(spark: SparkSession, sf: str) -> DataFrame:
    return connectivity.k_edge_components(review_edges(spark, sf), 3)


@query()
def graph_k3_subgraphs(spark: SparkSession, sf: str) -> DataFrame:
    return connectivity.k_edge_subgraphs(review_edges(spark, sf), 3)


@query()
def graph_augment_weighted(spark: SparkSession, sf: str) -> DataFrame:
    """What reviews could still be asked for, the likeliest first, to leave no component with a bridge."""
    edges = review_edges(spark, sf)
    available = edges.where("state IN ('unreviewed', 'unknown', 'notcomp')").select("a", "b", (100 - F.col("value")).alias("w"))
    return connectivity.augment_with(edges, available, 2).withColumn("w", F.round("w", 6))


@query()
def spanning_tree_views(spark: SparkSession, sf: str) -> DataFrame:
    own = observations(spark, sf).withColumn("nid", F.when(F.col("nid") == 0, -F.col("aid")).otherwise(F.col("nid")))
    return connectivity.spanning_forest(connectivity.view_weights(own, VIEWS))


@query("WITH RECURSIVE " + ROOTS_SQL + """, q AS (SELECT DISTINCT a, b FROM edges WHERE state IN ('unreviewed', 'unknown', 'notcomp', 'nomatch')),
own AS (SELECT DISTINCT q.a, x.root FROM q JOIN roots x ON x.node = q.a JOIN roots y ON y.node = q.b AND y.root = x.root), big AS (SELECT root, count(*) AS n FROM roots GROUP BY root),
walk(src, node, d, n) AS (SELECT a, a, 0, n FROM own JOIN big USING (root) UNION SELECT w.src, m.b, w.d + 1, n FROM walk w JOIN m ON m.a = w.node WHERE w.d < w.n - 1),
far AS (SELECT src AS a, node AS b, min(d) AS hops FROM walk GROUP BY ALL), st AS (SELECT a, b, min(state) AS state FROM edges GROUP BY ALL),
neg AS (SELECT r1, r2, count(*) AS negatives FROM lab WHERE state = 'nomatch' GROUP BY r1, r2)
SELECT q.a, q.b, x.root AS root_a, y.root AS root_b, st.state, hops, coalesce(negatives, 0) AS negatives FROM q JOIN roots x ON x.node = q.a JOIN roots y ON y.node = q.b
LEFT JOIN st ON st.a = q.a AND st.b = q.b LEFT JOIN far ON far.a = q.a AND far.b = q.b LEFT JOIN neg ON neg.r1 = least(x.root, y.root) AND neg.r2 = greatest(x.root, y.root)""")
def pair_connection(spark: SparkSession, sf: str) -> DataFrame:
    edges = review_edges(spark, sf)
    return connectivity.pair_connections(edges.where("state IN ('unreviewed', 'unknown', 'notcomp', 'nomatch')"), edges)


@query("WITH RECURSIVE " + EDGES_SQL + """, c AS (SELECT a, b, state FROM edges WHERE floor(value) % 5 >= 1), m AS (SELECT a, b FROM c WHERE state = 'match' UNION SELECT b, a FROM c WHERE state = 'match'),
q AS (SELECT DISTINCT a, b FROM edges), nodes AS (SELECT a AS node FROM q UNION SELECT b FROM q), r(node, reach) AS (SELECT node, node FROM nodes UNION SELECT r.node, m.b FROM r JOIN m ON r.reach = m.a),
root AS (SELECT node, min(reach) AS root FROM r GROUP BY node), n AS (SELECT DISTINCT least(x.root, y.root) AS r1, greatest(x.root, y.root) AS r2 FROM c JOIN root x ON x.node = a JOIN root y ON y.node = b WHERE state = 'nomatch')
SELECT a, b, EXISTS (SELECT 1 FROM n WHERE r1 = least(x.root, y.root) AND r2 = greatest(x.root, y.root)) AS separated FROM q JOIN root x ON x.node = a JOIN root y ON y.node = b""")
def confidently_separated(spark: SparkSession, sf: str) -> DataFrame:
    edges = review_edges(spark, sf).withColumn("confidence", (F.floor("value") % 5).cast("int"))
    return connectivity.confidently_separated(edges.select("a", "b"), edges, 1)
