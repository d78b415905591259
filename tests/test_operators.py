"""Operators on small literal inputs."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldmark.functions import geo, geometry, keys, tags, weights
from fieldmark.operators import cohort, components_deep, deltas, graph, grouping, matching, metrics, pairs, sessions, words
from fieldmark.sources import tables
from fieldmark.streaming.incremental import growing_components


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(expr.alias("v")).first()["v"]


def test_haversine(spark):
    km = geo.haversine_km(F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    assert one(spark, km, a=-80.21895315, b=-158.81099213, c=9.77816711, d=-17.27471498) == pytest.approx(11930.909364, abs=1e-5)
    far = one(spark, geo.timespace_km(geo.haversine_km(F.col("a"), F.col("b"), F.col("c"), F.col("d")), F.col("s")), a=40.779299, b=-73.9719498, c=37.7336402, d=-122.5050342, s=360)
    assert far == pytest.approx(4137.1768647922627, rel=1e-9)


def test_speed(spark):
    v = geo.speed_kmh(F.col("km"), F.col("h"))
    assert one(spark, v, km=10.0, h=2.0) == 5 and one(spark, v, km=0.4, h=0.0) == 0 and one(spark, v, km=3.0, h=0.0) == math.inf


def test_polygon(spark):
    square = [(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0)]
    assert one(spark, geo.in_polygon(F.col("a"), F.col("b"), square), a=1.0, b=1.0) and not one(spark, geo.in_polygon(F.col("a"), F.col("b"), square), a=3.0, b=1.0)


def test_iou(spark):
    box = lambda s: tuple(F.col(f"{s}{c}") for c in "xywh")
    v = geometry.iou(box("a"), box("b"))
    base = dict(ax=0.0, ay=0.0, aw=2.0, ah=2.0, by=0.0, bw=2.0, bh=2.0)
    assert one(spark, v, bx=1.0, **base) == pytest.approx(1 / 3) and one(spark, v, bx=2.0, **base) == 0


def test_selectivity(spark):
    u = [-1.0, -0.5, -0.1, 0.0, 0.1, 0.5, 1.0]
    got = [r["v"] for r in spark.createDataFrame([(x,) for x in u], ["u"]).select(weights.selectivity(F.col("u")).alias("v")).collect()]
    assert got == pytest.approx([0, 0, 0, 0, 0.001, 0.125, 1])


def test_idf(spark):
    counts = [0, 21, 20, 2, 15, 8, 12, 1, 2]
    got = [r["v"] for r in spark.createDataFrame([(float(c),) for c in counts], ["n"]).select(weights.idf(F.lit(21.0), F.col("n")).alias("v")).collect()]
    assert [round(x, 2) for x in got] == [0, 0, 0.05, 2.35, 0.34, 0.97, 0.56, 3.04, 2.35]


ANNOTS = [(1, 0), (2, 1), (3, 1), (4, 0), (5, 2), (6, 2), (7, 3), (8, 4), (9, 0), (10, 5), (11, 0), (12, 6), (13, 7)]


def test_grouping(spark):
    obs = spark.createDataFrame(ANNOTS, "aid long, nid long")
    groups = {r["name_key"]: (r["n"], r["first_aid"]) for r in grouping.group_by_name(obs).collect()}
    assert groups == {-11: (1, 11), -9: (1, 9), -4: (1, 4), -1: (1, 1), 1: (2, 2), 2: (2, 5), 3: (1, 7), 4: (1, 8), 5: (1, 10), 6: (1, 12), 7: (1, 13)}
    counts = {r["aid"]: r["n"] for r in grouping.groundtruth_count(obs).collect()}
    assert [counts[i] for i in range(1, 14)] == [1, 2, 2, 1, 2, 2, 1, 1, 1, 1, 1, 1, 1]
    p = grouping.profile(obs, spark.createDataFrame([(i,) for i in range(1, 8)], "nid long")).first()
    assert (p["names"], p["names_singleton"], p["names_multiton"], p["annots"], p["annots_unknown"], p["annots_singleton"], p["annots_multiton"]) == (7, 5, 2, 13, 4, 5, 4)


def test_tags(spark):
    df = spark.createDataFrame([(["Red", "bolt"],), ([],), (None,), (["x"],)], "t array<string>")
    flags = lambda **k: [r["v"] for r in df.select(tags.tag_predicate(F.col("t"), **k).alias("v")).collect()]
    assert flags(has_any=["RED"]) == [True, False, False, False] and flags(has_none=["red"]) == [False, True, True, True]
    assert flags(min_num=1, max_num=1) == [False, False, False, True] and flags() == [True] * 4 and flags(logic="or") == [False] * 4
    assert one(spark, tags.parse_tags(F.col("s")), s="a; b;;c ") == ["a", "b", "c"]
    assert one(spark, tags.consolidate(F.array(F.lit("bad"), F.lit("old"), F.lit("new")), ["bad"], {"old": "new"}), s=1) == ["New"]


def test_quality_and_decisions(spark):
    q = spark.createDataFrame([(None,), (-1,), (2,), (4,)], "q int")
    assert [r["v"] for r in q.select(keys.quality_ok(F.col("q"), 3).alias("v")).collect()] == [True, True, False, True]
    assert [r["v"] for r in q.select(keys.quality_ok(F.col("q"), 3, False).alias("v")).collect()] == [False, False, False, True]
    d = spark.createDataFrame([(1, None), (2, 1), (3, 0), (2, None)], "e int, m int")
    assert [r["v"] for r in d.select(keys.rectified_decision(F.col("e"), F.col("m")).alias("v")).collect()] == [1, 1, 0, 2]


def test_min_timedelta(spark):
    obs = spark.createDataFrame([(i, 1, t) for i, t in enumerate([0, 5, 9, 10, 21, 30])], "aid long, nid long, t long")
    assert sorted(r["aid"] for r in cohort.min_timedelta(obs, 10).collect()) == [0, 3, 4]


def test_expand_grid():
    assert cohort.expand_grid("base:K=[1,4],sv=True,rule=last") == [{"_name": "base", "K": k, "sv": True, "rule": "last"} for k in (1, 4)]


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    root = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == root


def test_components_empty(spark):
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def connected(edges, nodes):
    seen, stack = set(), [min(nodes)]
    while stack:
        x = stack.pop()
        if x not in seen:
            seen.add(x)
            stack += [b if a == x else a for a, b in edges if x in (a, b)]
    return seen >= set(nodes)


@pytest.mark.parametrize("seed", range(5))
def test_bridges_brute_force(seed):
    rng = random.Random(seed)
    edges = sorted({tuple(sorted(rng.sample(range(8), 2))) for _ in range(10)})
    def parts(es):
        left, n = {x for e in edges for x in e}, 0
        while left:
            seen, stack = set(), [min(left)]
            while stack:
                x = stack.pop()
                if x not in seen:
                    seen.add(x)
                    stack += [b if a == x else a for a, b in es if x in (a, b)]
            left, n = left - seen, n + 1
        return n
    assert components_deep.find_bridges(edges) == {e for e in edges if parts([x for x in edges if x != e]) > parts(edges)}


@pytest.mark.parametrize("seed", range(5))
def test_min_cut_brute_force(seed):
    rng = random.Random(seed)
    edges = sorted({tuple(sorted(rng.sample(range(6), 2))) for _ in range(9)} | {(0, 5)})
    weighted = [(a, b, float(rng.randrange(1, 9))) for a, b in edges]
    best = min(sum(w for a, b, w in weighted if (a in side) != (b in side)) for k in range(5) for rest in itertools.combinations(range(1, 5), k) for side in [{0, *rest}])
    value, cut = components_deep.min_cut(weighted, 0, 5)
    assert value == pytest.approx(best) and sum(w for a, b, w in weighted if (a, b) in cut) == pytest.approx(best)


@pytest.mark.parametrize("seed", range(5))
def test_assignment_brute_force(seed):
    rng = random.Random(seed)
    profit = [[float(rng.randrange(10)) for _ in range(5)] for _ in range(4)]
    got = components_deep.assignment(profit)
    assert len(set(got)) == 4 and sum(profit[i][j] for i, j in enumerate(got)) == max(sum(profit[i][j] for i, j in enumerate(p)) for p in itertools.permutations(range(5), 4))


def test_augment_leaves_no_bridge(spark):
    path = [(i, i + 1, "match") for i in range(5)] + [(2, 10, "match"), (10, 11, "match"), (11, 2, "match"), (11, 12, "match")]
    added = [(r["a"], r["b"]) for r in components_deep.augment(spark.createDataFrame(path, "a long, b long, state string")).collect()]
    assert added and not components_deep.find_bridges([(a, b) for a, b, _ in path] + added)


def test_consistent_labels(spark):
    rows = [(1, 1, "a", 1), (1, 1, "b", 1), (1, 2, "b", 2)]
    got = {r["grp"]: r["name"] for r in components_deep.consistent_labels(spark.createDataFrame(rows, "part long, grp long, old string, n long")).collect()}
    assert got == {1: "a", 2: "b"}


def test_occurrences(spark):
    rows = [(1, 0, None, None), (2, 100, None, None), (3, 500, None, None), (4, None, None, None), (5, 0, 1.0, 1.0), (6, 10, 1.0, 1.0), (7, 10, 40.0, 1.0), (8, None, 1.0, 1.0), (9, None, 1.0, 1.0001)]
    obs = spark.createDataFrame(rows, "aid long, t long, lat double, lon double")
    got = {r["aid"]: r["occurrence"] for r in sessions.occurrences(obs, 250).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 5, 7: 7, 8: 8, 9: 8}


def test_knn_brute_force(spark):
    rng = random.Random(0)
    rows = [(i, i % 5, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "fx long, aid long, vec array<float>")
    got = {}
    for r in matching.knn(df, df, 3, exclude="aid").collect():
        got.setdefault(r["q_fx"], []).append((r["rank"], r["d_fx"]))
    import numpy as np

    for i, a, v in rows:
        want = sorted((round(float(np.sqrt(sum((np.float32(x) - np.float64(np.float32(y))) ** 2 for x, y in zip(v, w)))), 5), j) for j, b, w in rows if b != a)[:3]
        assert [d for _, d in sorted(got[i])] == [j for _, j in want]


def test_name_normalizer(spark):
    top = [[2, 3, 4], [2, 3, 1], [5, 6, 7]]
    norm = [[3, 4, 9], [8, 9, 9], [1, 1, 1]]
    rows = [(q, 1, n, r + 1) for q in range(3) for r, n in enumerate(top[q] + norm[q])]
    got = {r["q_fx"]: r["norm_k"] for r in matching.name_normalizer(spark.createDataFrame(rows, "q_fx long, q_nid long, d_nid long, rank int"), 3, 3).collect()}
    assert got == {0: 2, 1: 0, 2: 2}


def test_multi_assigns(spark):
    dist = [[0.1, 0.11], [0.2, 0.25], [0.03, 0.25], [0.0, 1.0]]
    word = [[0, 1], [2, 3], [4, 5], [2, 0]]
    rows = [(f, word[f][r], dist[f][r], r + 1) for f in range(4) for r in range(2)]
    got = {}
    for r in words.weigh_assigns(spark.createDataFrame(rows, "fx long, word long, dist double, rank int"), equal=True).collect():
        got.setdefault(r["fx"], {})[r["word"]] = r["weight"]
    assert got == {0: {0: 0.5, 1: 0.5}, 1: {2: 1.0}, 2: {4: 1.0}, 3: {2: 0.5, 0: 0.5}}


def test_state_delta_and_grouping(spark):
    old = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, None)], "k int, v string")
    assert sorted((r["k"], r["is_new"]) for r in deltas.state_delta(old, new, ["k"], ["v"]).collect()) == [(2, False), (3, False), (4, True)]
    groups = lambda g: spark.createDataFrame([(n, i) for i, ns in enumerate(g) for n in ns], "node int, grp int")
    got = {r["kind"]: r["groups"] for r in deltas.grouping_delta(groups([[1, 2], [3], [4], [5, 6], [7, 8]]), groups([[1, 2], [3, 4], [5], [6, 7], [8]])).collect()}
    assert got == {"unchanged": 1, "merge": 1, "split": 2, "hybrid": 1}


def test_pairs(spark):
    e = spark.createDataFrame([(1, 2), (2, 1), (3, 3), (4, 1)], "a long, b long")
    n = lambda *x: spark.createDataFrame([(i,) for i in x], "node long")
    assert sorted(map(tuple, pairs.undirected(e).collect())) == [(1, 2), (1, 4)]
    assert sorted(map(tuple, pairs.between(e, n(1), n(4)).collect())) == [(4, 1)]
    assert sorted(map(tuple, pairs.outgoing(e, n(1, 2)).select("a", "b").collect())) == [(4, 1)]
    m = spark.createDataFrame([(0, 1), (0, 2), (0, 4)], "grp long, node long")
    assert sorted((r["a"], r["b"]) for r in pairs.missing_in_cliques(e, m).collect()) == [(2, 4)]


def test_append_and_upsert(spark):
    t = spark.createDataFrame([(1, "a")], "id int, v string")
    rows = spark.createDataFrame([(1, "z"), (2, "b"), (2, "c")], "id int, v string")
    assert sorted(map(tuple, deltas.append_new(t, rows, ("id",)).collect())) == [(1, "a"), (2, "b")]
    assert sorted(map(tuple, deltas.upsert(t, rows.limit(1), ("id",)).collect())) == [(1, "z")]


def test_auc_perfect_and_chance(spark):
    df = spark.createDataFrame([(True, 0.9), (True, 0.8), (False, 0.1)], "truth boolean, score double")
    assert metrics.auc(df).first()["auc"] == 1
    assert metrics.auc(df.withColumn("score", F.lit(0.5))).first()["auc"] == 0.5


def test_growing_components(spark, tmp_path):
    held = []

    def write(df):
        held.append(f"{tmp_path}/{len(held)}")
        df.write.parquet(held[-1])

    merge = growing_components(lambda: spark.read.parquet(held[-1]) if held else None, write)
    edges = [[(5, 6), (1, 2)], [(2, 3), (8, 9)], [(3, 5), (10, 8)]]
    for i, part in enumerate(edges):
        merge(spark.createDataFrame(part, "a long, b long"), i)
    want = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(sum(edges, []), "a long, b long")).collect()}
    assert {r["node"]: r["root"] for r in spark.read.parquet(held[-1]).collect()} == want


def test_sources(spark, tmp_path):
    import json
    import zipfile

    (tmp_path / "c.json").write_text(json.dumps({"images": [{"id": 1, "file_name": "a.jpg", "width": 4, "height": 5}], "annotations": [{"id": 7, "image_id": 1, "category_id": 2, "bbox": [0, 1, 2, 3]}], "categories": [{"id": 2, "name": "zebra"}]}))
    images, boxes = tables.read_coco(spark, str(tmp_path / "c.json"))
    assert images.first()["file_name"] == "a.jpg" and tuple(boxes.first()) == (7, 1, "zebra", 0.0, 1.0, 2.0, 3.0)
    df = spark.createDataFrame([(1, ["x", "y"])], "a int, b array<string>")
    tables.write_csv(df, str(tmp_path / "csv"))
    assert tables.read_csv(spark, str(tmp_path / "csv"), "a int, b string").first()["b"] == '["x","y"]'
    tables.write_json(df, str(tmp_path / "json"))
    assert tables.read_json(spark, str(tmp_path / "json"), df.schema.simpleString()[7:-1].replace(":", " ")).first()["b"] == ["x", "y"]
    (tmp_path / "q_good.txt").write_text("i1 3\n\ni2\n")
    assert sorted(map(tuple, tables.read_truth_lists(spark, str(tmp_path / "q_good.txt")).collect())) == [("q", "good", "i1"), ("q", "good", "i2")]
    (tmp_path / "w.xml").write_text('<p><waypoint id="1" time="t" x="2.5" y="1.5"/></p>')
    assert tuple(tables.read_waypoints(spark, str(tmp_path / "w.xml")).first()) == ("1", "t", 1.5, 2.5)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/x.txt", "hello")
    files = spark.read.format("binaryFile").load(str(tmp_path / "a.zip"))
    assert [(r["name"], bytes(r["content"])) for r in tables.read_zip(files).collect()] == [("d/x.txt", b"hello")]
    payload = spark.createDataFrame([('{"a": [1, 2], "b": ["x", null]}',)], "p string")
    assert sorted(map(tuple, tables.rows_of_lists(payload, "p", {"a": "int", "b": "string"}).collect())) == [(1, "x"), (2, None)]
    assert one(spark, tables.name_from_path(F.col("p"), ["/([a-z]+)_[0-9]+\\.jpg$", "/([a-z]+)/[^/]+$"]), p="/x/unknown/a_1.jpg") == "a"
    assert one(spark, tables.normal_name(F.col("p")), p="Unknown") == "____"
    assert tables.read_files(spark, str(tmp_path), "*.xml").first()["name"] == "w.xml"


def test_derived_tables(spark, tmp_path):
    from fieldmark.operators import derived

    calls = []

    @derived.derivation("twice", "k", by=2)
    def twice(rows, by):
        calls.append(rows.count())
        return rows.select("k", (F.col("k") * by).alias("v"))

    rows = spark.range(5).select(F.col("id").alias("k"))
    folder = f"file://{tmp_path}"
    assert sorted(r["v"] for r in twice.get(rows.where("k < 3"), folder).collect()) == [0, 2, 4]
    assert sorted(r["v"] for r in twice.get(rows, folder).collect()) == [0, 2, 4, 6, 8] and calls == [3, 2]
    assert sorted(r["v"] for r in twice.get(rows, folder, by=3).collect()) == [0, 3, 6, 9, 12]
    with pytest.raises(TypeError):
        twice.config(by="x")
    with pytest.raises(KeyError):
        twice.config(other=1)
    got = derived.model_scores(rows, "k", lambda xs: [x + 0.5 for x in xs]).collect()
    assert all(r["score"] == r["k"] + 0.5 for r in got)


def test_thresholds_and_hardness(spark):
    df = spark.createDataFrame([(1, 0, [0.6, 0.3]), (2, 1, [0.6, 0.55]), (3, 0, [0.1, 0.2])], "sample int, truth int, p array<double>")
    pick = lambda **k: [r["cls"] for r in metrics.predict_with_thresholds(df, [0.5, 0.5], **k).orderBy("sample").collect()]
    assert pick() == [0, 0, None] and pick(force=True) == [0, 0, 1] and pick(multi=False) == [0, None, None]
    assert [(round(r["margin"], 3), r["failed"]) for r in metrics.hardness(df).orderBy("sample").collect()] == [(0.3, False), (-0.05, True), (-0.1, True)]


def test_age_class(spark):
    rows = [(None, None, "UNREVIEWED"), (-1, -1, "UNREVIEWED"), (None, 3, "FOAL"), (0, 11, "FOAL"), (12, 23, "YEARLING"), (24, 35, "2 YEARS"), (36, None, "3+ YEARS"), (40, 50, "3+ YEARS"), (3, 30, "UNKNOWN")]
    df = spark.createDataFrame([(a, b) for a, b, _ in rows], "a int, b int")
    assert [r["v"] for r in df.select(keys.age_class(F.col("a"), F.col("b")).alias("v")).collect()] == [c for _, _, c in rows]


def test_assign_sequentially(spark):
    t = spark.createDataFrame([(1, 1, "a", 0.0, 0.0, 10.0, 10.0), (1, 2, "a", 5.0, 0.0, 10.0, 10.0)], "image long, id long, cls string, x double, y double, w double, h double")
    p = spark.createDataFrame([(1, 7, "a", 1.0, 0.0, 10.0, 10.0, 0.9), (1, 8, "a", 0.0, 0.0, 10.0, 10.0, 0.8), (1, 9, "b", 0.0, 0.0, 10.0, 10.0, 0.7)], "image long, id long, cls string, x double, y double, w double, h double, conf double")
    assert sorted((r["p"], r["t"]) for r in components_deep.assign_sequentially(t, p, 0.3).collect()) == [(7, 1), (8, 2)]


#: Thirteen observations, four of them of unknown names.
SMALL_DB = [(a, {2: 1, 3: 1, 5: 2, 6: 2, 7: 3, 8: 4, 10: 5, 12: 6, 13: 7}.get(a, 0), 100 * a) for a in range(1, 14)]


def test_unknown_names_are_told_apart(spark):
    obs = spark.createDataFrame(SMALL_DB, "aid long, nid long, t long").withColumn("imgset", F.lit(1)).withColumn("view", F.lit("left"))
    keys = {}
    for r in cohort.told_apart(obs).collect():
        keys.setdefault(r[cohort.WHO], []).append(r["aid"])
    assert keys == {-11: [11], -9: [9], -4: [4], -1: [1], 1: [2, 3], 2: [5, 6], 3: [7], 4: [8], 5: [10], 6: [12], 7: [13]}
    ids = lambda df: sorted(r["aid"] for r in df.collect())
    everyone = list(range(1, 14))
    assert ids(cohort.min_timedelta(obs, 10_000)) == [a for a in everyone if a not in (3, 6)]
    assert ids(cohort.sample_per_name(obs, 1, "mintime")) == [a for a in everyone if a not in (3, 6)]
    assert ids(cohort.pername(obs, least=2)) == [2, 3, 5, 6] and ids(cohort.same_imageset(obs)) == everyone
    assert ids(cohort.view_pername(obs, {"left": 2})) == [2, 3, 5, 6] and ids(cohort.nth_occurrence(obs)) == everyone
    assert ids(cohort.names_slice(obs, 3, 3)) == [1, 2, 3, 5, 6]
    dealt = {r["aid"]: r["fold"] for r in cohort.folds(obs, 11).collect()}
    assert sorted(set(dealt.values())) == list(range(11)) and dealt[2] == dealt[3] and dealt[5] == dealt[6]
    found = sessions.gap_sessions(obs, 50)
    assert {(r["nid"], r["session"], r["n"]) for r in sessions.session_stats(found).collect()} == {(k, i + 1, 1) for k, v in keys.items() for i in range(len(v))}


def test_positions_and_waypoints(spark):
    rng = random.Random(4)
    numbers = rng.sample(range(-500, 90_000), 700)
    rows = sessions.positions(spark.createDataFrame([(n, 2 * n) for n in numbers], "aid long, t long"), "aid", cell=16)
    got = {r["aid"]: r["pos"] for r in rows.collect()}
    assert got == {n: i for i, n in enumerate(sorted(numbers))}
    spans = [(1, 0, 100), (2, 63, 65), (3, 5, 5), (4, 690, 900), (5, -10, 3)]
    out = {r["waypoint"]: (r["n"], r["start"], r["end"]) for r in sessions.waypoint_ranges(rows, spark.createDataFrame(spans, "waypoint long, first long, last long")).collect()}
    t = [2 * n for n in sorted(numbers)]
    assert out == {w: (len(t[max(a, 0) : b]), t[max(a, 0)], t[min(b, 700) - 1]) for w, a, b in spans if b > a}


def test_vocabulary_and_neighbours_by_brute_force(spark):
    rng = np.random.default_rng(2)
    x = np.repeat(rng.standard_normal((6, 5)) * 10, 30, axis=0) + rng.standard_normal((180, 5))
    d = spark.createDataFrame([(i, i % 9, v.tolist()) for i, v in enumerate(x)], "fx long, aid long, vec array<double>")
    got = {(r["q_fx"], r["rank"]): r["d_fx"] for r in matching.knn(d, d, 4, exclude="aid").collect()}
    for i in range(180):
        dist = np.round(np.sqrt(((x - x[i]) ** 2).sum(axis=1)), 5)
        dist[np.arange(180) % 9 == i % 9] = np.inf
        assert [got[i, k] for k in range(1, 5)] == np.lexsort((np.arange(180), dist))[:4].tolist()
    centres = np.array([r["vec"] for r in words.train_vocabulary(d, 8, 3).orderBy("word").collect()])
    start = sorted(range(180), key=lambda i: hashlib.md5(f"{i}:0".encode()).hexdigest())[:8]
    want = x[start].copy()
    for _ in range(3):
        at = np.round(np.sqrt(((x[:, None] - want[None]) ** 2).sum(axis=2)), 5).argmin(axis=1)
        want = np.array([x[at == k].mean(axis=0) if (at == k).any() else want[k] for k in range(8)])
    assert np.allclose(centres, want)
