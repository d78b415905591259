"""The COCO sink: a round trip, ids, overwriting and appending; consistent cohorts on golden cases."""

import os

from fieldmark.operators.cohort import expand_consistently
from fieldmark.sources.coco import write_coco
from fieldmark.sources.tables import read_coco

IMAGES, BOXES = "id long, file_name string, width int, height int, extra string", "id long, image_id long, category string, x double, y double, w double, h double"


def test_round_trip(spark, tmp_path):
    images = [(10 * i, f"é{i}.jpg", 5, None, "n") for i in range(7)]
    boxes = [(100 + i, 10 * (i % 4), ["b", "a", None][i % 3], i + 0.1, 1.0, 2.0, 3.0) for i in range(9)] + [(500, 999, "c", 1.0, 1.0, 1.0, 1.0)]
    path = f"file://{tmp_path}/out"
    for _ in range(2):
        write_coco(spark.createDataFrame(images, IMAGES), spark.createDataFrame(boxes, BOXES), path, per_file=3)
        assert sorted(os.listdir(f"{tmp_path}/out")) == [f"coco-{i:08d}.json" for i in range(3)]
    got_images, got = read_coco(spark, f"{path}/coco-*.json")
    assert sorted(tuple(r) for r in got_images.collect()) == [(i, f"é{i}.jpg", 5, None) for i in range(7)]
    want = [(i, i % 4, ["b", "a", ""][i % 3], i + 0.1, 1.0, 2.0, 3.0) for i in range(9)]
    assert sorted(tuple(r) for r in got.select("id", "image_id", "category", "x", "y", "w", "h").collect()) == want
    write_coco(spark.createDataFrame(images[:1], IMAGES), spark.createDataFrame(boxes, BOXES), path, mode="append")
    assert len(os.listdir(f"{tmp_path}/out")) == 4
    write_coco(spark.createDataFrame([], IMAGES), spark.createDataFrame([], BOXES), path)
    assert os.listdir(f"{tmp_path}/out") == []


def test_consistent_cohorts(spark):
    obs = spark.createDataFrame([(i, i % 5 + 1, i) for i in range(1, 41)], "aid long, nid long, numfeat long")
    cfgs = [{"query": {"max_numfeat": 6}, "database": {"min_numfeat": 21}}, {"query": {"max_numfeat": 12}, "database": {}}, {"query": {"max_numfeat": 12}, "database": {"max_numfeat": 30}, "database_size": 9, "const_query": False, "apart": False}]
    got = {}
    for c, role, aid in expand_consistently(obs, cfgs).collect():
        got.setdefault((c, role), set()).add(aid)
    assert got[0, "query"] == set(range(1, 7)) and got[0, "database"] == set(range(21, 41))
    assert len(got[1, "query"]) == 6 and got[1, "query"] <= got[2, "query"] == set(range(1, 13))
    assert len(got[1, "database"]) == 20 and not got[1, "database"] & got[1, "query"]
    assert len(got[2, "database"]) == 9
    assert expand_consistently(obs, []).collect() == []
    assert {r["config"] for r in expand_consistently(obs.limit(0), cfgs).collect()} == set()
