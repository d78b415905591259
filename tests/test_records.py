"""Operators on records, on small tables with nulls, ties and empty inputs."""

import math

from pyspark.sql import functions as F

from fieldmark.operators import records


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_number_reviews(spark):
    old = spark.createDataFrame([(1, 2, 4), (2, 1, 3)], "aid1 long, aid2 long, review_count long")
    new = spark.createDataFrame([(2, 1, 10), (1, 2, 11), (5, 6, 12)], "aid1 long, aid2 long, at long")
    assert rows(records.number_reviews(old, new, ["at"]), "at", "review_count") == [(10, 5), (11, 6), (12, 1)]
    assert rows(records.number_reviews(old.limit(0), new, ["at"]), "at", "review_count") == [(10, 1), (11, 2), (12, 1)]


def test_groundfalse_count(spark):
    obs = spark.createDataFrame([(1, 7), (2, 7), (3, 8), (4, 0), (5, None)], "aid long, nid long")
    assert rows(records.groundfalse_count(obs), "aid", "n") == [(1, 1), (2, 1), (3, 2), (4, 3), (5, 3)]
    assert rows(records.groundfalse_count(obs.where("nid = 0")), "aid", "n") == [(4, 0)]


def test_partners_and_share(spark):
    edges = spark.createDataFrame([(1, 2, "match"), (2, 1, "match"), (2, 3, "nomatch"), (3, 4, "unreviewed"), (4, 5, None)], "a long, b long, state string")
    pairs = records.partners(edges, ["match", "nomatch"])
    assert rows(pairs, "node", "partner") == [(1, 2), (2, 1), (2, 3), (3, 2)]
    members = spark.createDataFrame([("x", 1), ("x", 4), ("y", 5)], "grp string, aid long")
    assert rows(records.reviewed_share(members, pairs.select(F.col("node").alias("aid"))), "grp", "n", "reviewed", "share") == [("x", 2, 1, 0.5), ("y", 1, 0, 0.0)]


def test_conflicts_and_cleanup(spark):
    mapping = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, None), (3, "c"), (3, "c")], "key long, name string")
    assert rows(records.name_conflicts(mapping), "key", "names") == [(1, 2)]
    names = spark.createDataFrame([(1, "p"), (2, "q"), (3, "r")], "nid long, text string")
    obs = spark.createDataFrame([(1,), (1,), (None,)], "nid long")
    assert rows(records.without_children(names, "nid", obs, "nid"), "nid", "text") == [(2, "q"), (3, "r")]
    assert rows(records.overlap(names, obs, "nid"), "only_left", "only_right", "both") == [(2, 0, 1)]
    assert rows(records.overlap(names.limit(0), obs.limit(0), "nid"), "only_left", "only_right", "both") == [(0, 0, 0)]


def test_image_info(spark):
    obs = spark.createDataFrame([(1, 10, 5, 90, "left"), (1, 11, 5, 90, "right"), (1, 12, 0, 95, "up"), (2, 13, 6, None, None)], "gid long, aid long, nid long, t long, view string")
    assert rows(records.image_info(obs.where("gid = 1")), "gid", "n", "known", "names", "first_time", "first_view") == [(1, 3, 2, 1, "1970-01-01 00:01:30", "left")]
    assert rows(records.image_info(obs.where("gid = 2")), "gid", "n", "known", "names", "first_time", "first_view") == [(2, 1, 1, 1, None, "NONE")]


def test_texts(spark):
    df = spark.createDataFrame([(0, "a,b"), (-1, "-1"), (None, None)], "t long, v string")
    got = df.select(records.datetime_text(F.col("t")), records.csv_cell(F.col("v")), records.csv_cell(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("1970-01-01 00:00:00", "a<COMMA>b", "0"), ("1969-12-31 23:59:59", "UNKNOWN", "UNKNOWN"), (None, "NONE", "NONE")]


def test_rotated_corners(spark):
    box = [F.lit(v) for v in (0.0, 0.0, 4.0, 2.0)]
    flat, quarter = spark.range(1).select(records.rotated_corners(*box, F.lit(0.0)), records.rotated_corners(*box, F.lit(math.pi / 2))).first()
    assert [tuple(p) for p in flat] == [(0, 0), (4, 0), (4, 2), (0, 2)]
    assert [(round(p.x, 9), round(p.y, 9)) for p in quarter] == [(3, -1), (3, 3), (1, 3), (1, -1)]
