"""Queries on filters, groups, windows, samples and pairs over observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.functions.keys import encounter_text, match_truth, name_key
from fieldmark.functions.tags import tag_predicate
from fieldmark.operators import cohort, deltas, grouping, pairs
from fieldmark.plans.registry import APART_SQL, OBS_SQL, VIEWS, observations, query, rounded
from fieldmark.schema import ring_distance
from fieldmark.sources.tables import table

WITH = f"WITH {OBS_SQL} "
#: Queries that group by name return its key: minus the observation's id where it is unknown.
APART = f"WITH {APART_SQL} "


def _key() -> Column:
    return name_key(F.col("aid"), F.col("nid")).alias("nid")


def _filter(name: str, cfg: dict, where: str) -> None:
    @query(WITH + f"SELECT aid, nid FROM obs WHERE {where}", name=name)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return cohort.filter_rows(observations(spark, sf), **cfg).select("aid", "nid")


_filter("filter_known", {"is_known": True}, "nid > 0")
_filter("filter_time", {"require_timestamp": True, "min_unixtime": 1704300000, "max_unixtime": 1705900000}, "t BETWEEN 1704300000 AND 1705900000")
_filter("filter_gps", {"require_gps": True}, "lat IS NOT NULL AND lon IS NOT NULL")
_filter("filter_quality", {"minqual": 3}, "quality = -1 OR quality >= 3")
_filter("filter_quality_required", {"minqual": 3, "require_quality": True}, "quality >= 3")
_filter("filter_view", {"view": ["click", "error"], "require_viewpoint": True}, "view IN ('click', 'error')")
_filter("filter_species", {"species": "species_1"}, "species = 'species_1'")
_filter("filter_species_primary", {"species": "primary"}, "species = (SELECT species FROM obs GROUP BY species ORDER BY count(*) DESC, min(aid) LIMIT 1)")
_filter("filter_numfeat", {"min_numfeat": 10, "max_numfeat": 60}, "numfeat BETWEEN 10 AND 60")
_filter("filter_flags", {"is_exemplar": True, "multiple": False}, "exemplar AND NOT multiple")
_filter("filter_pername_global", {"min_pername_global": 60, "max_pername_global": 75}, "nid IN (SELECT nid FROM obs GROUP BY nid HAVING count(*) BETWEEN 60 AND 75)")


@query("SELECT c_custkey, c_name FROM customer WHERE contains(c_name, '42')")
def filter_contributor(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").withColumn("contributor", F.col("c_name"))
    return cohort.filter_rows(c, contributor_contains="42").select("c_custkey", "c_name")


_TAGS = "list_distinct(list_transform(list_filter(string_split(p_name, ' '), lambda x: x <> ''), lambda x: lower(x)))"
_TAG_RULES = {
    "tag_has_any": ({"has_any": ["Red", "bolt"]}, f"list_has_any({_TAGS}, ['red', 'bolt'])"),
    "tag_has_all": ({"has_all": ["red", "bolt"]}, f"list_has_all({_TAGS}, ['red', 'bolt'])"),
    "tag_has_none": ({"has_none": ["red", "bolt"]}, f"NOT list_has_any({_TAGS}, ['red', 'bolt'])"),
    "tag_num": ({"min_num": 2, "max_num": 2}, f"len({_TAGS}) = 2"),
    "tag_startswith": ({"any_startswith": "b"}, f"len(list_filter({_TAGS}, lambda x: starts_with(x, 'b'))) > 0"),
    "tag_endswith": ({"any_endswith": "t"}, f"len(list_filter({_TAGS}, lambda x: ends_with(x, 't'))) > 0"),
    "tag_match": ({"any_match": "^r.d$"}, f"len(list_filter({_TAGS}, lambda x: regexp_matches(x, '^r.d$'))) > 0"),
    "tag_none_match": ({"none_match": "^r.d$"}, f"len(list_filter({_TAGS}, lambda x: regexp_matches(x, '^r.d$'))) = 0"),
    "tag_or_logic": ({"has_all": ["red", "bolt"], "any_startswith": "sm", "logic": "or"}, f"list_has_all({_TAGS}, ['red', 'bolt']) OR len(list_filter({_TAGS}, lambda x: starts_with(x, 'sm'))) > 0"),
}


def _tag(name: str, rules: dict, where: str) -> None:
    @query(f"SELECT p_partkey FROM part WHERE {where}", name=name)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        tags = F.filter(F.split("p_name", " "), lambda t: t != "")
        return table(spark, sf, "part").where(tag_predicate(tags, **rules)).select("p_partkey")


for _n, (_rules, _where) in _TAG_RULES.items():
    _tag(_n, _rules, _where)


@query("SELECT doc_id, lang FROM documents WHERE regexp_matches(text, '[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+')")
def notes_search(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where(F.col("text").rlike("[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+")).select("doc_id", "lang")


@query(WITH + "SELECT CASE WHEN nid > 0 THEN nid ELSE -aid END AS name_key, count(*) AS n, min(aid) AS first_aid, max(aid) AS last_aid FROM obs GROUP BY 1")
def group_by_name(spark: SparkSession, sf: str) -> DataFrame:
    return grouping.group_by_name(observations(spark, sf))


@query(WITH + "SELECT aid, CASE WHEN nid > 0 THEN count(*) OVER (PARTITION BY nid) ELSE 1 END AS n FROM obs")
def groundtruth_count(spark: SparkSession, sf: str) -> DataFrame:
    return grouping.groundtruth_count(observations(spark, sf))


@query(WITH + ", c AS (SELECT count(*) AS c FROM obs WHERE nid > 0 GROUP BY nid) SELECT min(c) AS least, max(c) AS most, round(avg(c), 6) AS mean, round(stddev_pop(c), 6) AS std, median(c)::DOUBLE AS median, count(*) AS names FROM c")
def pername_stats(spark: SparkSession, sf: str) -> DataFrame:
    return grouping.pername_stats(observations(spark, sf)).withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query("""WITH c AS (SELECT o_custkey, count(*) AS c FROM orders GROUP BY o_custkey)
SELECT CASE WHEN c = 1 THEN '1' WHEN c <= 3 THEN '2-3' WHEN c <= 5 THEN '4-5' ELSE '>=6' END AS bin, count(*) AS names, sum(c)::BIGINT AS annots FROM c WHERE o_custkey > 0 GROUP BY 1""")
def annot_stats_per_name_bins(spark: SparkSession, sf: str) -> DataFrame:
    return grouping.pername_bins(table(spark, sf, "orders").select(F.col("o_orderkey").alias("aid"), F.col("o_custkey").alias("nid")))


@query("""WITH c AS (SELECT c_custkey AS nid, n.c FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS c FROM orders WHERE o_custkey > 0 GROUP BY o_custkey) n ON n.o_custkey = c_custkey)
SELECT count(*) AS names, count(*) FILTER (c = 1) AS names_singleton, count(*) FILTER (c > 1) AS names_multiton, count(*) FILTER (c IS NULL) AS names_unassociated,
  sum(CASE WHEN c = 1 THEN 1 ELSE 0 END)::BIGINT AS annots_singleton, sum(CASE WHEN c > 1 THEN c ELSE 0 END)::BIGINT AS annots_multiton,
  (SELECT count(*) FROM orders) AS annots, (SELECT count(*) FROM orders WHERE o_custkey <= 0) AS annots_unknown FROM c""")
def dbinfo_profile(spark: SparkSession, sf: str) -> DataFrame:
    obs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("aid"), F.col("o_custkey").alias("nid"))
    return grouping.profile(obs, table(spark, sf, "customer").select(F.col("c_custkey").alias("nid")))


@query("SELECT c_custkey AS key, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def group_counts_with_empty(spark: SparkSession, sf: str) -> DataFrame:
    return grouping.group_counts_with_empty(table(spark, sf, "customer").select(F.col("c_custkey").alias("key")), table(spark, sf, "orders").select(F.col("o_custkey").alias("key")), "key")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 12")
def valid_names_min_pername(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).where("n >= 12")


@query("SELECT p_type, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, min(p_partkey) LIMIT 1")
def primary_category(spark: SparkSession, sf: str) -> DataFrame:
    return grouping.primary_category(table(spark, sf, "part"), "p_type", "p_partkey")


_RING = ", ".join(f"({i}, '{VIEWS[(i + j) % len(VIEWS)]}')" for i in range(len(VIEWS)) for j in range(2))


@query(WITH + f', w(win, view) AS (VALUES {_RING}) SELECT win::INT AS "window", nid, count(*) AS n FROM obs JOIN w USING (view) GROUP BY win, nid HAVING count(DISTINCT view) = 2')
def viewpoint_adjacent_names(spark: SparkSession, sf: str) -> DataFrame:
    return grouping.adjacent_category_names(observations(spark, sf), VIEWS)


_DIST = ", ".join(f"('{a}', '{b}', {d})" for a, b, d in ring_distance(VIEWS))


@query(WITH + f", v(x, y, d) AS (VALUES {_DIST}) SELECT p.aid AS a, q.aid AS b, d::INT AS dist FROM obs p JOIN obs q ON p.nid = q.nid AND p.aid < q.aid AND p.nid > 0 JOIN v ON v.x = p.view AND v.y = q.view")
def view_distance(spark: SparkSession, sf: str) -> DataFrame:
    dist = spark.createDataFrame(ring_distance(VIEWS), "a_view string, b_view string, dist int")
    return pairs.within_names(observations(spark, sf), "view").join(F.broadcast(dist), ["a_view", "b_view"]).select("a", "b", "dist")


@query("WITH m AS (SELECT DISTINCT l_orderkey AS grp, l_suppkey AS name FROM lineitem) SELECT x.name AS a, y.name AS b, count(*) AS n FROM m x JOIN m y ON x.grp = y.grp AND x.name < y.name GROUP BY 1, 2")
def association_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return grouping.associations(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("grp"), F.col("l_suppkey").alias("name")))


@query(WITH + ", s AS (SELECT *, row_number() OVER (PARTITION BY nid ORDER BY t, aid) AS n, row_number() OVER (PARTITION BY nid, imgset ORDER BY t, aid) AS d FROM obs) SELECT aid, nid > 0 AND n = 1 AS first_seen, nid > 0 AND n > 1 AS marked, nid > 0 AND d = 1 AS first_that_day FROM s")
def sightings_report(spark: SparkSession, sf: str) -> DataFrame:
    return grouping.sightings(observations(spark, sf).withColumn("day", F.col("imgset"))).select("aid", "first_seen", "marked", "first_that_day")


@query(WITH + "SELECT aid, nid > 0 AND row_number() OVER (PARTITION BY species, nid ORDER BY t, aid) = 1 AS is_first FROM obs")
def first_seen_per_group(spark: SparkSession, sf: str) -> DataFrame:
    return grouping.first_seen(observations(spark, sf), "species", "nid").select("aid", "is_first")


@query(WITH + """, v AS (SELECT *, CASE WHEN quality >= 5 THEN 5.0 WHEN quality = 4 THEN 4.0 WHEN quality = 3 THEN 3.0 WHEN quality = 2 THEN 1.0 WHEN quality <= 1 THEN 0.1 ELSE 0.5 END
  + CASE WHEN exemplar THEN 1.0 ELSE 0.0 END - CASE WHEN multiple THEN 0.5 ELSE 0.0 END AS worth FROM obs)
SELECT aid, nid, view FROM v WHERE nid > 0 QUALIFY row_number() OVER (PARTITION BY nid, view ORDER BY worth DESC, aid) <= 2""")
def best_n_per_name_view(spark: SparkSession, sf: str) -> DataFrame:
    worth = grouping.exemplar_value(F.col("quality"), F.col("exemplar"), F.col("multiple"))
    return grouping.best_per_group(observations(spark, sf).where("nid > 0").withColumn("worth", worth), ["nid", "view"], [F.desc("worth"), F.col("aid")], 2).select("aid", "nid", "view")


@query(WITH + "SELECT nid, arg_min(aid, (t, aid)) AS first_aid, arg_max(aid, (t, aid)) AS last_aid, max(t) - min(t) AS seconds FROM obs WHERE nid > 0 GROUP BY nid HAVING count(*) > 1")
def farthest_pair_per_name(spark: SparkSession, sf: str) -> DataFrame:
    return grouping.farthest_pair(observations(spark, sf))


@query(WITH + "SELECT nid, row_number() OVER (PARTITION BY nid ORDER BY t, aid) AS pos, aid, t, lat, lon FROM obs WHERE nid > 0 AND lat IS NOT NULL")
def gps_track(spark: SparkSession, sf: str) -> DataFrame:
    return grouping.track(observations(spark, sf))


@query(WITH + "SELECT aid, ('Occurrence ' || imgset) || '_' || CASE WHEN nid > 0 THEN 'name_' || nid END AS encounter FROM obs")
def encounter_texts(spark: SparkSession, sf: str) -> DataFrame:
    o = observations(spark, sf)
    return o.select("aid", encounter_text(F.concat(F.lit("Occurrence "), F.col("imgset").cast("string")), F.when(F.col("nid") > 0, F.concat(F.lit("name_"), F.col("nid").cast("string")))).alias("encounter"))


@query(WITH + "SELECT nid, count(*) AS n, count(*) FILTER (exemplar) AS having FROM obs WHERE nid > 0 GROUP BY nid HAVING count(*) FILTER (exemplar) BETWEEN 1 AND count(*) - 1")
def mixed_property_names(spark: SparkSession, sf: str) -> DataFrame:
    return grouping.mixed_property_names(observations(spark, sf), F.col("exemplar"))


@query("""WITH n AS (SELECT n_name, count(*) AS size, row_number() OVER (ORDER BY n_name) AS i FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name),
r AS (SELECT n_name, size, sum(size) OVER (ORDER BY n_name) - size / 2.0 AS mid, sum(size) OVER () AS total FROM n)
SELECT n_name, size, least(floor(mid * 4 / total), 3)::INT AS part FROM r""")
def balanced_parts(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("size"))
    return grouping.balanced_parts(n, 4, "n_name", "size").select("n_name", "size", "part")


@query(WITH + "SELECT p.nid, p.aid AS a, q.aid AS b, abs(p.t - q.t) AS seconds FROM obs p JOIN obs q ON p.nid = q.nid AND p.aid < q.aid WHERE p.nid > 0")
def pair_timedelta(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.timedeltas(observations(spark, sf))


@query(WITH + "SELECT p.nid, round(max(abs(p.t - q.t)) / 3600.0::DOUBLE, 6) AS max_hours, count(*) AS n FROM obs p JOIN obs q ON p.nid = q.nid AND p.aid < q.aid WHERE p.nid > 0 GROUP BY p.nid")
def pair_max_hours(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.timedeltas(observations(spark, sf)).groupBy("nid").agg(F.round(F.max("seconds") / 3600.0, 6).alias("max_hours"), F.count(F.lit(1)).alias("n"))


@query(WITH + """, p AS (SELECT p.nid, p.aid AS a, q.aid AS b, abs(p.t - q.t) / 3600.0::DOUBLE AS hours,
  2 * 6367.0::DOUBLE * asin(sqrt(least(pow(sin((radians(q.lat) - radians(p.lat)) / 2), 2) + cos(radians(p.lat)) * cos(radians(q.lat)) * pow(sin((radians(q.lon) - radians(p.lon)) / 2), 2), 1.0))) AS km
  FROM obs p JOIN obs q ON p.nid = q.nid AND p.aid < q.aid WHERE p.nid > 0)
SELECT nid, a, b, round(km, 4) AS km, CASE WHEN hours <> 0 THEN round(km / hours, 3) WHEN km < 0.5 THEN 0.0 ELSE 1e308 END::DOUBLE AS kmh FROM p WHERE km IS NOT NULL""")
def pair_speed(spark: SparkSession, sf: str) -> DataFrame:
    s = pairs.speeds(observations(spark, sf)).where(F.col("km").isNotNull())
    return s.select("nid", "a", "b", rounded(F.col("km"), 4).alias("km"), F.when(F.col("kmh") == float("inf"), 1e308).otherwise(rounded(F.col("kmh"), 3)).alias("kmh"))


@query("""WITH e AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)
SELECT x.l_orderkey AS a_order, x.l_linenumber AS a, y.l_linenumber AS b, CASE WHEN x.l_suppkey > 0 AND y.l_suppkey > 0 THEN (x.l_suppkey = y.l_suppkey)::INT ELSE 2 END AS truth
FROM e x JOIN e y ON x.l_orderkey = y.l_orderkey AND (x.l_linenumber, x.l_partkey, x.l_suppkey) < (y.l_linenumber, y.l_partkey, y.l_suppkey)""")
def match_truths(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("x"))
    both = e.join(e.select("l_orderkey", F.col("x").alias("y")), "l_orderkey").where(F.col("x") < F.col("y"))
    return both.select(F.col("l_orderkey").alias("a_order"), F.col("x.l_linenumber").alias("a"), F.col("y.l_linenumber").alias("b"), match_truth(F.col("x.l_suppkey"), F.col("y.l_suppkey")).alias("truth"))


_PAIRS = "e AS (SELECT l_partkey AS a, 1000000000 + l_suppkey AS b FROM lineitem)"


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("a"), (F.lit(1000000000) + F.col("l_suppkey")).cast("long").alias("b"))


@query(f"WITH {_PAIRS} SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM e WHERE a <> b")
def pairs_undirected_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.undirected(_pairs(spark, sf))


_SETS = f"{_PAIRS}, l AS (SELECT p_partkey AS node FROM part WHERE p_type = 'SMALL'), r AS (SELECT 1000000000 + s_suppkey AS node FROM supplier WHERE s_acctbal < 5000)"


def _sets(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    left = table(spark, sf, "part").where("p_type = 'SMALL'").select(F.col("p_partkey").alias("node"))
    return left, table(spark, sf, "supplier").where("s_acctbal < 5000").select((F.lit(1000000000) + F.col("s_suppkey")).cast("long").alias("node"))


@query(f"WITH {_SETS} SELECT DISTINCT a, b FROM e WHERE a IN (SELECT node FROM l) AND b IN (SELECT node FROM r)")
def pairs_between_sets(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.between(_pairs(spark, sf), *_sets(spark, sf))


@query(f"WITH {_SETS}, n AS (SELECT node FROM l UNION SELECT node FROM r) SELECT DISTINCT a, b FROM e WHERE (a IN (SELECT node FROM n)) <> (b IN (SELECT node FROM n))")
def edges_outgoing(spark: SparkSession, sf: str) -> DataFrame:
    left, right = _sets(spark, sf)
    return pairs.outgoing(_pairs(spark, sf).distinct(), left.union(right)).select("a", "b")


@query(f"WITH {_SETS}, n AS (SELECT node FROM l UNION SELECT node FROM r) SELECT DISTINCT a, b FROM e WHERE a IN (SELECT node FROM n) AND b IN (SELECT node FROM n)")
def edges_inside(spark: SparkSession, sf: str) -> DataFrame:
    left, right = _sets(spark, sf)
    return pairs.inside(_pairs(spark, sf).distinct(), left.union(right)).select("a", "b")


@query("""WITH x AS (SELECT o_custkey AS nid, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), y AS (SELECT o_custkey AS nid, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT coalesce(x.nid, y.nid) AS nid, coalesce(x.n, 0) AS n_left, coalesce(y.n, 0) AS n_right, CASE WHEN x.n IS NULL THEN 'right' WHEN y.n IS NULL THEN 'left' ELSE 'both' END AS side FROM x FULL JOIN y ON x.nid = y.nid""")
def corresponding_groups(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("nid"), "o_orderstatus")
    return pairs.corresponding_groups(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'P'"))


@query(WITH + """, r AS (SELECT * FROM obs WHERE lat IS NULL), d AS (SELECT * FROM obs WHERE lat IS NOT NULL),
m AS (SELECT r.aid, d.aid AS donor, abs(r.t - d.t) AS gap, d.lat AS donor_lat, d.lon AS donor_lon FROM r JOIN d ON r.view = d.view AND abs(r.t - d.t) <= 1800 AND r.aid <> d.aid)
SELECT aid, donor, gap, donor_lat, donor_lon FROM m QUALIFY row_number() OVER (PARTITION BY aid ORDER BY gap, donor) = 1""")
def nearest_time_fill(spark: SparkSession, sf: str) -> DataFrame:
    o = observations(spark, sf)
    got = pairs.nearest_time(o.where("lat IS NULL").select("aid", "t", "view"), o.where("lat IS NOT NULL").select("aid", "t", "view", "lat", "lon"), "view", 1800)
    return got.select("aid", "donor", "gap", "donor_lat", "donor_lon")


@query(WITH + """, p AS (SELECT p.nid AS n, p.value - q.value AS dv FROM obs p JOIN obs q ON p.nid = q.nid AND p.aid < q.aid WHERE p.nid > 0)
SELECT n AS nid, count(*) AS len, round(sum(round(dv, 4)::DECIMAL(18, 4))::DOUBLE, 3) AS sum_dv, round(stddev_pop(dv), 4) AS std_dv, round(median(dv), 4) AS med_dv FROM p GROUP BY n""")
def pair_features(spark: SparkSession, sf: str) -> DataFrame:
    p = pairs.within_names(observations(spark, sf), "value").select("nid", (F.col("a_value") - F.col("b_value")).alias("dv"))
    exact = p.groupBy("nid").agg(F.round(F.sum(F.round("dv", 4).cast("decimal(18,4)")).cast("double"), 3).alias("sum_dv"))
    return pairs.pair_features(p, ["nid"], ["dv"]).select("nid", "len", F.round("std_dv", 4).alias("std_dv"), F.round("med_dv", 4).alias("med_dv")).join(exact, "nid")


def _sample(rule: str, order: str) -> None:
    @query(APART + f"SELECT aid, nid FROM obs QUALIFY row_number() OVER (PARTITION BY nid ORDER BY {order}) BETWEEN 2 AND 4", name=f"sample_per_name_{rule}")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return cohort.sample_per_name(observations(spark, sf), 3, rule, offset=1, seed=7).select("aid", _key())


_sample("mintime", "t NULLS LAST, aid")
_sample("maxtime", "t DESC NULLS LAST, aid")
_sample("hash", "md5(aid || ':7'), aid")
_sample("qual_and_view", "quality DESC NULLS LAST, view, aid")


@query(APART + ", n AS (SELECT nid, row_number() OVER (ORDER BY nid) AS i FROM (SELECT DISTINCT nid FROM obs)) SELECT aid, nid FROM obs WHERE nid IN (SELECT nid FROM n WHERE i BETWEEN 6 AND 25)")
def sample_names_slice(spark: SparkSession, sf: str) -> DataFrame:
    return cohort.names_slice(observations(spark, sf), 20, 5).select("aid", _key())


@query(APART + ", n AS (SELECT nid, count(*) AS c FROM obs GROUP BY nid), s AS (SELECT nid, sum(c) OVER (ORDER BY md5(nid || ':3'), nid) AS total FROM n) SELECT aid, nid FROM obs WHERE nid IN (SELECT nid FROM s WHERE total <= 3000)")
def sample_greedy_size(spark: SparkSession, sf: str) -> DataFrame:
    return cohort.sample_whole_names(observations(spark, sf), 3000, seed=3).select("aid", _key())


@query(APART + ", s AS (SELECT nid, imgset, row_number() OVER (PARTITION BY nid ORDER BY imgset) AS i FROM (SELECT DISTINCT nid, imgset FROM obs)) SELECT aid, nid FROM obs JOIN s USING (nid, imgset) WHERE i = 2")
def sample_nth_occurrence(spark: SparkSession, sf: str) -> DataFrame:
    return cohort.nth_occurrence(observations(spark, sf), 1).select("aid", _key())


@query(APART + ", g AS (SELECT nid, (row_number() OVER (ORDER BY md5(nid || ':5'), nid) - 1) % 4 AS fold FROM (SELECT DISTINCT nid FROM obs)) SELECT aid, nid, fold FROM obs JOIN g USING (nid)")
def crossval_folds(spark: SparkSession, sf: str) -> DataFrame:
    return cohort.folds(observations(spark, sf), 4, seed=5).select("aid", _key(), F.col("fold").cast("long").alias("fold"))


@query(APART + """, c AS (SELECT nid, view, count(*) AS n FROM obs GROUP BY nid, view), m AS (SELECT nid, view FROM c QUALIFY row_number() OVER (PARTITION BY nid ORDER BY n DESC, view DESC) = 1),
g AS (SELECT nid, (row_number() OVER (PARTITION BY view ORDER BY md5(nid || ':5'), nid) - 1) % 3 AS fold FROM m) SELECT aid, nid, fold FROM obs JOIN g USING (nid)""")
def stratified_folds(spark: SparkSession, sf: str) -> DataFrame:
    return cohort.stratified_folds(observations(spark, sf).withColumn("nid", _key()), 3, "view", "nid", seed=5).select("aid", _key(), F.col("fold").cast("long").alias("fold"))


@query(APART + """, p AS (SELECT aid, nid, row_number() OVER (PARTITION BY nid ORDER BY md5(aid || ':2'), aid) - 1 AS i, count(*) OVER (PARTITION BY nid) AS n FROM obs)
SELECT (i // 3)::INT AS split, CASE WHEN i % 3 < 1 THEN 'query' ELSE 'database' END AS role, aid, nid FROM p WHERE n >= 3 AND i < 15 AND (i // 3 + 1) * 3 <= n
UNION ALL SELECT s::INT, 'confusor', aid, nid FROM p, range(5) x(s) WHERE n < 3""")
def crossval_roles(spark: SparkSession, sf: str) -> DataFrame:
    return cohort.crossval(observations(spark, sf), queries=1, database=2, splits=5, seed=2)


@query(APART + "SELECT aid, row_number() OVER (PARTITION BY species ORDER BY md5(aid || ':1'), aid) <= floor(count(*) OVER (PARTITION BY species) * 0.8::DOUBLE) AS train FROM obs")
def train_test_split(spark: SparkSession, sf: str) -> DataFrame:
    return cohort.train_test(observations(spark, sf), 0.8, "species", seed=1).select("aid", "train")


@query(APART + """, f AS (SELECT o.* FROM obs o WHERE NOT exemplar AND (nid, imgset) NOT IN (SELECT (nid, imgset) FROM obs WHERE exemplar)), r AS (SELECT nid, t AS rt FROM obs WHERE exemplar),
d AS (SELECT f.aid, f.nid, avg(abs(f.t - rt)) AS d FROM f JOIN r USING (nid) GROUP BY f.aid, f.nid)
SELECT aid, nid FROM d QUALIFY row_number() OVER (PARTITION BY nid ORDER BY d DESC, aid) <= 2
UNION ALL SELECT aid, nid FROM f WHERE nid NOT IN (SELECT nid FROM r) QUALIFY row_number() OVER (PARTITION BY nid ORDER BY md5(aid || ':0'), aid) <= 1""")
def sample_wrt_reference(spark: SparkSession, sf: str) -> DataFrame:
    o = observations(spark, sf).select("aid", "nid", "imgset", "t", "exemplar")
    return cohort.sample_wrt_reference(o, o.where("exemplar"), per_ref_name=2, per_name=1).select("aid", _key())


@query("WITH RECURSIVE " + APART_SQL + """, k AS (SELECT aid, nid, t, row_number() OVER (PARTITION BY nid ORDER BY t, aid) AS i FROM obs),
s AS (SELECT aid, nid, t, i, t AS last, true AS keep FROM k WHERE i = 1
  UNION ALL SELECT k.aid, k.nid, k.t, k.i, CASE WHEN k.t - s.last >= 43200 THEN k.t ELSE s.last END, k.t - s.last >= 43200 FROM s JOIN k ON k.nid = s.nid AND k.i = s.i + 1)
SELECT aid, nid FROM s WHERE keep""")
def min_timedelta_subset(spark: SparkSession, sf: str) -> DataFrame:
    return cohort.min_timedelta(observations(spark, sf), 43200).select("aid", _key())


@query(APART + ", g AS (SELECT nid FROM obs GROUP BY nid HAVING count(*) FILTER (view = 'click') >= 12 AND count(*) FILTER (view = 'error') >= 12) SELECT aid, nid FROM obs WHERE nid IN (SELECT nid FROM g)")
def intragroup_view_pername(spark: SparkSession, sf: str) -> DataFrame:
    return cohort.view_pername(observations(spark, sf), {"click": 12, "error": 12}).select("aid", _key())


@query(APART + ", s AS (SELECT nid, imgset, count(*) AS n FROM obs GROUP BY nid, imgset), b AS (SELECT nid, imgset FROM s QUALIFY row_number() OVER (PARTITION BY nid ORDER BY n DESC, imgset) = 1) SELECT aid, nid FROM obs JOIN b USING (nid, imgset)")
def intragroup_same_imageset(spark: SparkSession, sf: str) -> DataFrame:
    return cohort.same_imageset(observations(spark, sf)).select("aid", _key())


@query(APART + """, s AS (SELECT nid, imgset, count(*) AS n FROM obs GROUP BY nid, imgset), b AS (SELECT nid, imgset FROM s QUALIFY row_number() OVER (PARTITION BY nid ORDER BY n DESC, imgset) = 1),
o AS (SELECT obs.* FROM obs JOIN b USING (nid, imgset)) SELECT aid, nid FROM o WHERE nid IN (SELECT nid FROM o GROUP BY nid HAVING count(*) BETWEEN 4 AND 7)""")
def intragroup_chain(spark: SparkSession, sf: str) -> DataFrame:
    return cohort.intragroup(observations(spark, sf), imageset=True, least=4, most=7).select("aid", _key())


@query("WITH x AS (SELECT *, md5(text) AS h FROM documents) SELECT doc_id, row_number() OVER (PARTITION BY h ORDER BY doc_id) AS nth FROM x QUALIFY nth > 1")
def duplicates_by_hash(spark: SparkSession, sf: str) -> DataFrame:
    return deltas.duplicates_by_hash(table(spark, sf, "documents"), F.col("text"), [F.col("doc_id")]).select("doc_id", F.col("nth").cast("long").alias("nth"))


_HIST = WITH + "SELECT species, view, count(*) AS n FROM obs GROUP BY species, view HAVING count(*) >= 10"


@query(_HIST)
def localizer_distributions(spark: SparkSession, sf: str) -> DataFrame:
    return observations(spark, sf).groupBy("species", "view").agg(F.count(F.lit(1)).alias("n")).where("n >= 10")


@query(WITH + "SELECT imgset, count(*) AS images, count(*) FILTER (exemplar) AS reviewed, count(DISTINCT CASE WHEN exemplar THEN nid END) AS names_with_exemplar, round(count(*) FILTER (exemplar)::DOUBLE / nullif(count(*), 0), 6) AS fraction, min(t) AS start, max(t) AS \"end\" FROM obs GROUP BY imgset")
def imageset_stats(spark: SparkSession, sf: str) -> DataFrame:
    o = observations(spark, sf)
    return o.groupBy("imgset").agg(F.count(F.lit(1)).alias("images"), F.count_if("exemplar").alias("reviewed"), F.count_distinct(F.when(F.col("exemplar"), F.col("nid"))).alias("names_with_exemplar"), F.round(F.try_divide(F.count_if("exemplar").cast("double"), F.count(F.lit(1))), 6).alias("fraction"), F.min("t").alias("start"), F.max("t").alias("end"))


