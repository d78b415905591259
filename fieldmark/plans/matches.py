"""Queries on descriptor matching, visual words and rankings over embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.functions.weights import NAMED
from fieldmark.operators import matching, words
from fieldmark.plans.registry import DESC_SQL, descriptors, query

K, KNORM = 4, 1

#: Every feature against the features of all other observations, the K + 1 nearest with their normaliser.
NEAR_SQL = f"""WITH {DESC_SQL},
x AS (SELECT q.fx AS q_fx, q.aid AS q_aid, q.nid AS q_nid, d.fx AS d_fx, d.aid AS d_aid, d.nid AS d_nid, round(list_distance(q.vec, d.vec), 5) AS dist FROM d q JOIN d ON q.aid <> d.aid),
near AS (SELECT *, row_number() OVER (PARTITION BY q_fx ORDER BY dist, d_fx) AS rank FROM x QUALIFY rank <= {K + KNORM}),
v AS (SELECT n.*, m.dist AS norm FROM near n JOIN near m ON m.q_fx = n.q_fx AND m.rank = {K + KNORM} WHERE n.rank <= {K}),
s AS (SELECT *, round(norm - dist, 5) AS score FROM v)"""
_DEC = "sum(score::DECIMAL(18, 5))::DOUBLE"
ANNOT_SQL = NEAR_SQL + f", an AS (SELECT q_aid, d_aid, d_nid, {_DEC} AS score FROM s GROUP BY ALL)"
NAME_SQL = NEAR_SQL + f", f AS (SELECT q_aid, d_nid, q_fx, max(score) AS score FROM s GROUP BY ALL), nm AS (SELECT q_aid, d_nid, {_DEC} AS score FROM f GROUP BY ALL), an AS (SELECT q_aid, d_aid, d_nid, {_DEC} AS score FROM s GROUP BY ALL)"
RANK_SQL = NAME_SQL + ", rk AS (SELECT *, row_number() OVER (PARTITION BY q_aid ORDER BY score DESC, d_nid) AS rank FROM nm), tr AS (SELECT DISTINCT aid AS q_aid, nid AS q_nid FROM d)"
SUM_SQL = RANK_SQL + """, sm AS (SELECT q_aid, min(rank) FILTER (d_nid = q_nid) AS gt_rank, arg_min(score, rank) FILTER (d_nid = q_nid) AS gt_score, min(rank) FILTER (d_nid <> q_nid) AS gf_rank, arg_min(score, rank) FILTER (d_nid <> q_nid) AS gf_score FROM rk JOIN tr USING (q_aid) GROUP BY q_aid)"""


def _near(spark: SparkSession, sf: str, k: int = K, knorm: int = KNORM) -> DataFrame:
    d = descriptors(spark, sf)
    return matching.neighbours(d, d, k, knorm, exclude="aid")


def _scored(spark: SparkSession, sf: str, weight: str = "lnbnn") -> DataFrame:
    return matching.weigh(matching.votes(_near(spark, sf), K, KNORM), weight)


def _truth(spark: SparkSession, sf: str) -> DataFrame:
    return descriptors(spark, sf).select(F.col("aid").alias("q_aid"), F.col("nid").alias("q_nid")).distinct()


def _rank(spark: SparkSession, sf: str) -> DataFrame:
    return matching.ranked(matching.name_scores(_scored(spark, sf)), "d_nid")


@query(RANK_SQL + " SELECT q_aid, d_nid, score, rank FROM rk")
def match_rank_nsum(spark: SparkSession, sf: str) -> DataFrame:
    return _rank(spark, sf).select("q_aid", "d_nid", "score", "rank")


@query(ANNOT_SQL + ", c AS (SELECT q_aid, d_nid, max(score) AS score FROM an GROUP BY ALL) SELECT q_aid, d_nid, score, row_number() OVER (PARTITION BY q_aid ORDER BY score DESC, d_nid) AS rank FROM c")
def match_rank_csum(spark: SparkSession, sf: str) -> DataFrame:
    return matching.ranked(matching.name_scores(_scored(spark, sf), "csum"), "d_nid").select("q_aid", "d_nid", "score", "rank")


@query(ANNOT_SQL + f", c AS (SELECT q_aid, d_nid, {_DEC} AS score FROM an GROUP BY ALL) SELECT q_aid, d_nid, score, row_number() OVER (PARTITION BY q_aid ORDER BY score DESC, d_nid) AS rank FROM c")
def match_rank_sumamech(spark: SparkSession, sf: str) -> DataFrame:
    return matching.ranked(matching.name_scores(_scored(spark, sf), "sumamech"), "d_nid").select("q_aid", "d_nid", "score", "rank")


@query(ANNOT_SQL + " SELECT q_aid, d_aid, score, row_number() OVER (PARTITION BY q_aid ORDER BY score DESC, d_aid) AS rank FROM an")
def match_rank_annots(spark: SparkSession, sf: str) -> DataFrame:
    return matching.ranked(matching.annot_scores(_scored(spark, sf)), "d_aid").select("q_aid", "d_aid", "score", "rank")


_WEIGHTS = {"lnbnn": "norm - dist", "ratio": "dist / norm", "bar_l2": "1 - dist", "loglnbnn": "ln(norm - dist + 1)", "logratio": "ln(norm / (dist + 1e-8) + 1)", "normonly": "norm", "const": "1.0::DOUBLE"}


def _weight(name: str) -> None:
    @query(NEAR_SQL + f" SELECT q_fx, d_fx, round({_WEIGHTS[name]}, 6) AS weight FROM v", name=f"match_weights_{name}")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        v = matching.votes(_near(spark, sf), K, KNORM)
        return v.select("q_fx", "d_fx", F.round(NAMED[name](F.col("dist"), F.col("norm")), 6).alias("weight"))


for _name in _WEIGHTS:
    _weight(_name)

_NEAR3 = f"""WITH {DESC_SQL}, x AS (SELECT q.fx AS q_fx, q.nid AS q_nid, d.fx AS d_fx, d.nid AS d_nid, round(list_distance(q.vec, d.vec), 5) AS dist FROM d q JOIN d ON q.aid <> d.aid),
near AS (SELECT *, row_number() OVER (PARTITION BY q_fx ORDER BY dist, d_fx) AS rank FROM x QUALIFY rank <= 7),
top AS (SELECT q_fx, list(DISTINCT d_nid) AS l FROM near WHERE rank <= 4 GROUP BY q_fx)"""


@query(_NEAR3 + " SELECT q_fx, coalesce(min(rank - 5) FILTER (NOT list_contains(l, d_nid) AND d_nid <> q_nid), 2)::INT AS norm_k FROM near JOIN top USING (q_fx) WHERE rank > 4 GROUP BY q_fx")
def match_name_normalizer(spark: SparkSession, sf: str) -> DataFrame:
    return matching.name_normalizer(_near(spark, sf, 4, 3), 4, 3).select("q_fx", F.col("norm_k").cast("int").alias("norm_k"))


@query(_NEAR3 + """, nk AS (SELECT q_fx, coalesce(arg_min(dist, rank) FILTER (rank > 4 AND NOT list_contains(l, d_nid) AND d_nid <> q_nid), max(dist) FILTER (rank = 7)) AS norm FROM near JOIN top USING (q_fx) GROUP BY q_fx)
SELECT q_fx, d_fx, round(norm - dist, 6) AS weight FROM near JOIN nk USING (q_fx) WHERE rank <= 4""")
def match_votes_name_rule(spark: SparkSession, sf: str) -> DataFrame:
    return matching.votes(_near(spark, sf, 4, 3), 4, 3, "name").select("q_fx", "d_fx", F.round(F.col("norm") - F.col("dist"), 6).alias("weight"))


def _excluded(name: str, column: str) -> None:
    @query(f"WITH {DESC_SQL}, x AS (SELECT q.fx AS q_fx, d.fx AS d_fx, round(list_distance(q.vec, d.vec), 5) AS dist FROM d q JOIN d ON q.{column} <> d.{column}) SELECT q_fx, d_fx, dist, row_number() OVER (PARTITION BY q_fx ORDER BY dist, d_fx) AS rank FROM x QUALIFY rank <= 5", name=name)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        d = descriptors(spark, sf)
        return matching.knn(d, d, 5, exclude=column).select("q_fx", "d_fx", "dist", "rank")


_excluded("match_self_excluded", "aid")
_excluded("match_same_name_excluded", "nid")


@query(RANK_SQL + " SELECT an.q_aid, d_aid, an.d_nid, rk.rank AS name_rank, row_number() OVER (PARTITION BY an.q_aid, an.d_nid ORDER BY an.score DESC, d_aid) AS annot_rank FROM an JOIN rk ON rk.q_aid = an.q_aid AND rk.d_nid = an.d_nid AND rk.rank <= 3 QUALIFY annot_rank <= 2")
def match_shortlist(spark: SparkSession, sf: str) -> DataFrame:
    s = _scored(spark, sf)
    return matching.shortlist(matching.annot_scores(s), matching.name_scores(s), 3, 2)


@query(NAME_SQL + ", b AS (SELECT *, row_number() OVER (PARTITION BY q_aid, d_nid ORDER BY score DESC, d_aid) AS i FROM an) SELECT b.q_aid, d_aid, b.d_nid, CASE WHEN i = 1 THEN nm.score END AS score FROM b JOIN nm ON nm.q_aid = b.q_aid AND nm.d_nid = b.d_nid")
def match_align_name_scores(spark: SparkSession, sf: str) -> DataFrame:
    s = _scored(spark, sf)
    return matching.align_name_scores(matching.annot_scores(s), matching.name_scores(s))


def _top(name: str, same: bool) -> None:
    @query(RANK_SQL + f" SELECT q_aid, d_nid, score, rank, row_number() OVER (PARTITION BY q_aid ORDER BY rank) AS place FROM rk JOIN tr USING (q_aid) WHERE (d_nid = q_nid) = {same} QUALIFY place <= 2", name=name)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return matching.top_of_truth(_rank(spark, sf), _truth(spark, sf), 2, same)


_top("match_topk_gt", True)
_top("match_topk_gf", False)


@query(SUM_SQL + " SELECT q_aid, gt_rank, gt_score, gf_rank, gf_score FROM sm")
def match_summarize(spark: SparkSession, sf: str) -> DataFrame:
    return matching.summarize(_rank(spark, sf), _truth(spark, sf))


@query(SUM_SQL + ", c AS (SELECT r.rank, count(gt_rank) AS n FROM range(1, 11) r(rank) LEFT JOIN sm ON gt_rank = r.rank GROUP BY r.rank) SELECT rank, sum(n) OVER (ORDER BY rank)::BIGINT AS queries, round(sum(n) OVER (ORDER BY rank)::DOUBLE / (SELECT count(*) FROM sm), 6) AS share FROM c")
def cmc_curve(spark: SparkSession, sf: str) -> DataFrame:
    return matching.cmc(matching.summarize(_rank(spark, sf), _truth(spark, sf)), 10).withColumn("share", F.round("share", 6))


@query(RANK_SQL + ", h AS (SELECT *, (d_nid = q_nid)::INT AS hit, sum((d_nid = q_nid)::INT) OVER (PARTITION BY q_aid ORDER BY rank) AS hits FROM rk JOIN tr USING (q_aid)), ap AS (SELECT q_aid, q_nid, avg(hits / rank) AS ap FROM h WHERE hit = 1 GROUP BY ALL) SELECT q_nid, round(avg(ap), 6) AS map FROM ap GROUP BY q_nid")
def mean_average_precision(spark: SparkSession, sf: str) -> DataFrame:
    return matching.average_precision(_rank(spark, sf), _truth(spark, sf)).groupBy("q_nid").agg(F.round(F.avg("ap"), 6).alias("map"))


@query(SUM_SQL + " SELECT q_aid, q_nid, gt_rank, row_number() OVER (PARTITION BY q_nid ORDER BY gt_rank DESC, q_aid) AS nth FROM sm JOIN tr USING (q_aid) WHERE gt_rank >= 1 QUALIFY nth <= 2")
def case_filter_orderby_pername(spark: SparkSession, sf: str) -> DataFrame:
    return matching.case_filter(_rank(spark, sf), _truth(spark, sf), least_rank=1, per_name=2)


@query(ANNOT_SQL + ", r AS (SELECT *, row_number() OVER (PARTITION BY q_aid ORDER BY score DESC, d_aid) AS rank FROM an), e AS (SELECT DISTINCT least(q_aid, d_aid) AS a, greatest(q_aid, d_aid) AS b FROM r WHERE rank <= 5) SELECT a, b FROM e WHERE NOT (a // 8 = b // 8)")
def match_candidate_pairs(spark: SparkSession, sf: str) -> DataFrame:
    rank = matching.ranked(matching.annot_scores(_scored(spark, sf)), "d_aid")
    # Pairs of one name count as reviewed.
    own = descriptors(spark, sf).select("aid", "nid").distinct()
    reviewed = own.select(F.col("aid").alias("a"), "nid").join(own.select(F.col("aid").alias("b"), "nid"), "nid").select("a", "b")
    return matching.candidate_pairs(rank, reviewed, 5)


WORDS, ROUNDS = 32, 2
_ROUND = """
a{i} AS (SELECT d.fx, w.word, row_number() OVER (PARTITION BY d.fx ORDER BY round(list_distance(d.vec, w.vec), 5), w.word) AS rank FROM d, w{i} w),
m{i} AS (SELECT word, list(m ORDER BY i) AS vec FROM (SELECT word, x.i, avg(d.vec[x.i]) AS m FROM a{i} JOIN d USING (fx), range(1, 65) x(i) WHERE rank = 1 GROUP BY ALL) GROUP BY word),
w{n} AS (SELECT word, coalesce(m.vec, w.vec) AS vec FROM w{i} w LEFT JOIN m{i} m USING (word)),"""
#: Words are centroids of two rounds of k-means over all descriptors, begun with the 32 whose ids hash least.
WORDS_SQL = f"""WITH {DESC_SQL}, w0 AS (SELECT row_number() OVER (ORDER BY md5(fx || ':0'), fx) - 1 AS word, vec FROM d QUALIFY word < {WORDS}),""" + "".join(_ROUND.format(i=i, n=i + 1) for i in range(ROUNDS)) + f"""
w AS (SELECT * FROM w{ROUNDS}),
a AS (SELECT d.fx, d.aid, w.word, round(list_distance(d.vec, w.vec), 5) AS dist, row_number() OVER (PARTITION BY d.fx ORDER BY round(list_distance(d.vec, w.vec), 5), w.word) AS rank FROM d, w)"""


def _assigned(spark: SparkSession, sf: str, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    d = descriptors(spark, sf)
    vocab = words.train_vocabulary(d, WORDS, ROUNDS)
    return words.assign(d, vocab, n).join(d.select("fx", "aid"), "fx"), d, vocab


@query(WORDS_SQL + " SELECT fx, word, dist FROM a WHERE rank = 1")
def vocab_assign(spark: SparkSession, sf: str) -> DataFrame:
    return _assigned(spark, sf, 1)[0].select("fx", "word", "dist")


_MULTI = WORDS_SQL + """, l AS (SELECT fx, max(dist) FILTER (rank = 1) AS d0, max(dist) FILTER (rank = 2) AS d1 FROM a GROUP BY fx),
k AS (SELECT a.*, exp(-dist / 12800.0::DOUBLE) AS raw FROM a JOIN l USING (fx) WHERE rank <= 3 AND (rank = 1 OR dist < 1.2::DOUBLE * (CASE WHEN d0 < 1e-9 THEN d1 ELSE d0 END + 0.001::DOUBLE))),
ma AS (SELECT fx, aid, word, raw / sum(raw) OVER (PARTITION BY fx) AS weight FROM k)"""


@query(_MULTI + " SELECT fx, word, round(weight, 6) AS weight FROM ma")
def vocab_multiassign(spark: SparkSession, sf: str) -> DataFrame:
    return words.weigh_assigns(_assigned(spark, sf, 3)[0]).withColumn("weight", F.round("weight", 6))


@query(WORDS_SQL + " SELECT word, count(DISTINCT aid) AS n_aids, round(ln((SELECT count(DISTINCT aid) FROM d) / count(DISTINCT aid)), 6) AS idf FROM a WHERE rank = 1 GROUP BY word")
def word_idf(spark: SparkSession, sf: str) -> DataFrame:
    a, d, _ = _assigned(spark, sf, 1)
    return words.word_weights(a, d.agg(F.count_distinct("aid").alias("n"))).withColumn("idf", F.round("idf", 6))


@query(_MULTI + ", h AS (SELECT word, aid, max(weight) AS w FROM ma GROUP BY ALL) SELECT word, round(sum(least(w, 1.0)), 5) AS soft, round(ln((SELECT count(DISTINCT aid) FROM d) / sum(least(w, 1.0))), 5) AS idf FROM h GROUP BY word")
def word_idf_maw(spark: SparkSession, sf: str) -> DataFrame:
    a, d, _ = _assigned(spark, sf, 3)
    soft = words.weigh_assigns(a).join(d.select("fx", "aid"), "fx")
    return words.word_weights_maw(soft, d.agg(F.count_distinct("aid").alias("n"))).select("word", F.round("soft", 5).alias("soft"), F.round("idf", 5).alias("idf"))


@query(WORDS_SQL + " SELECT word, aid, count(*) AS n FROM a WHERE rank = 1 GROUP BY ALL")
def inverted_index(spark: SparkSession, sf: str) -> DataFrame:
    return words.inverted_list(_assigned(spark, sf, 1)[0])


@query(WORDS_SQL + """, r AS (SELECT a.aid, a.word, a.fx, i, d.vec[i] - w.vec[i] AS r FROM a JOIN d ON d.fx = a.fx JOIN w ON w.word = a.word, range(1, 65) x(i) WHERE rank = 1),
n AS (SELECT *, sqrt(sum(r * r) OVER (PARTITION BY fx)) AS len FROM r),
u AS (SELECT aid, word, i, sum(CASE WHEN len > 1e-12 THEN r / len ELSE 0 END) AS s FROM n GROUP BY ALL),
g AS (SELECT aid, word, i, s, sqrt(sum(s * s) OVER (PARTITION BY aid, word)) AS len FROM u),
v AS (SELECT aid, word, CASE WHEN max(len) > 1e-9 THEN list(s / len ORDER BY i) END AS rvec FROM g GROUP BY ALL),
c AS (SELECT word, ln((SELECT count(DISTINCT aid) FROM d) / count(DISTINCT aid)) AS idf FROM a WHERE rank = 1 GROUP BY word),
p AS (SELECT x.aid AS q_aid, y.aid AS d_aid, idf, CASE WHEN x.rvec IS NULL OR y.rvec IS NULL THEN 1.0 ELSE greatest(-1.0, least(1.0, list_dot_product(x.rvec, y.rvec))) END AS u FROM v x JOIN v y ON x.word = y.word JOIN c ON c.word = x.word),
k AS (SELECT q_aid, d_aid, sum(idf * CASE WHEN u >= 0 THEN sign(u) * pow(abs(u), 3) ELSE 0 END) AS s FROM p GROUP BY ALL),
ga AS (SELECT q_aid AS aid, CASE WHEN s > 0 THEN 1 / sqrt(s) ELSE 0 END AS gamma FROM k WHERE q_aid = d_aid)
SELECT k.q_aid, k.d_aid, round(s * a.gamma * b.gamma, 5) AS score FROM k JOIN ga a ON a.aid = k.q_aid JOIN ga b ON b.aid = k.d_aid WHERE k.q_aid <> k.d_aid""")
def smk_scores(spark: SparkSession, sf: str) -> DataFrame:
    a, d, vocab = _assigned(spark, sf, 1)
    rvecs = words.aggregate_residuals(a, d, vocab)
    weights = words.word_weights(a, d.agg(F.count_distinct("aid").alias("n")))
    return words.smk_scores(rvecs, rvecs, weights, places=5).where("q_aid <> d_aid")
