"""The VOC sink: a round trip against plain boxes, sets, names, overwriting, empty tables."""

import math
import os
from pathlib import Path

from fieldmark.sources.voc import read_voc, write_voc

IMAGES = "id long, file_name string, width int, height int, subset string, extra int"
BOXES = "id long, image_id long, category string, view string, x double, y double, w double, h double, theta double"


def plain(box, w, h, target):
    """The box's hull in its scaled image, by hand."""
    f, sw, sh = (target / w, target, int(target * (h / w))) if w > h else (target / h, int(target * (w / h)), target)
    _, _, _, _, x, y, bw, bh, t = box
    t, cx, cy = t or 0.0, x + bw / 2, y + bh / 2
    pts = [(cx + dx * bw / 2 * math.cos(t) - dy * bh / 2 * math.sin(t), cy + dx * bw / 2 * math.sin(t) + dy * bh / 2 * math.cos(t)) for dx in (-1, 1) for dy in (-1, 1)]
    xs, ys = [round(p[0]) for p in pts], [round(p[1]) for p in pts]
    return max(int(min(xs) * f), 0), max(int(min(ys) * f), 0), min(int(max(xs) * f), sw - 1), min(int(max(ys) * f), sh - 1)


def lists(path, name):
    return "".join(p.read_text() for p in sorted(Path(f"{path}/ImageSets/Main/{name}").glob("part-*.txt"))).split()


def test_round_trip(spark, tmp_path):
    images = [(10 * i, f"<é&{i}>.jpg", 300 + 100 * (i % 3), 400, "test" if i % 4 == 0 else None, 1) for i in range(13)]
    boxes = [(i, 10 * (i % 5), ["a&b", "old", None, "no"][i % 4], [None, "-1", "left"][i % 3], 7.5 * i - 20, 4.0 * i, 90.0, 51.0, [0.0, 0.4, None, -2.1][i % 4]) for i in range(40)] + [(500, 999, "a&b", None, 1.0, 1.0, 1.0, 1.0, 0.0)]
    path, at = f"file://{tmp_path}/out", f"{tmp_path}/out"
    for _ in range(2):
        write_voc(spark.createDataFrame(images, IMAGES), spark.createDataFrame(boxes, BOXES), path, year=2001, species=["a&b", "new"], mapping={"old": "new"}, target=200, offset=3, per_file=5)
        assert sorted(os.listdir(f"{at}/Annotations")) == [f"voc-{i:08d}.tar" for i in range(3)]
    got = {r["name"]: r for r in read_voc(spark, path).collect()}
    assert sorted(got) == [f"2001_{i + 3:06d}" for i in range(13)]
    for i, (gid, file_name, w, h, _, _) in enumerate(images):
        r = got[f"2001_{i + 3:06d}"]
        assert r["file_name"] == file_name and max(r["width"], r["height"]) == 200
        kept = [b for b in boxes if b[1] == gid and b[2] in ("a&b", "old")]
        assert [tuple(b) for b in r["boxes"]] == [("new" if b[2] == "old" else "a&b", b[3] if b[3] != "-1" else None, *plain(b, w, h, 200)) for b in kept]
    train, val, test = (lists(at, n) for n in ("train", "val", "test"))
    assert test == [f"2001_{i + 3:06d}" for i in range(0, 13, 4)] and lists(at, "trainval") == sorted(train + val) and len(train) + len(val) == 9 and train


def test_empty(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    write_voc(spark.createDataFrame([(1, None, 5, 5, None, 1)], IMAGES), spark.createDataFrame([], BOXES), path, year=2001)
    (only,) = read_voc(spark, path).collect()
    assert only["name"] == "2001_000001" and only["boxes"] == [] and (only["width"], only["height"]) == (900, 900)
    write_voc(spark.createDataFrame([], IMAGES), spark.createDataFrame([], BOXES), path, year=2001)
    assert os.listdir(f"{tmp_path}/out/Annotations") == []
