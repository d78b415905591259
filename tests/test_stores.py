"""Merged stores against a plain merge row by row, odd rows, and the part of a store that rows need."""

import random

import pytest

from fieldmark.operators.stores import LINKS, Link, merge_stores, store_part

SCHEMAS = {
    "names": "nid long, name_text string", "images": "gid long, image_uuid string, note string", "annots": "aid long, annot_uuid string, gid long, nid long", "annotmatch": "am_id long, aid1 long, aid2 long, count int",
    "imagesets": "imgsetid long, text string", "imageset_images": "imgsetid long, gid long",
}


def frames(spark, tables):
    return {n: spark.createDataFrame(rows, SCHEMAS[n]) for n, rows in tables.items()}


def plain(into, other):
    out, maps = {n: list(rows) for n, rows in into.items()}, {}
    for name, link in LINKS.items():
        if name not in other:
            continue
        cols = [c.split()[0] for c in SCHEMAS[name].split(", ")]
        ident = (lambda r: r[link.id]) if link.id else (lambda r: tuple((v is not None, v) for v in r.values()))

        def key(r, link=link):
            v = [r[c] for c in link.key]
            if None in v:
                return None
            return tuple(sorted(v)) if link.undirected else tuple(v)

        rows = [dict(zip(cols, r, strict=True)) for r in other[name]]
        for r in rows:
            for c, parent in link.refs.items():
                if r.get(c) is not None and r[c] > 0:
                    r[c] = maps.get(parent, {}).get(r[c])
        have = {}
        for r in [dict(zip(cols, r, strict=True)) for r in into[name]]:
            if key(r) is not None:
                have[key(r)] = min(have.get(key(r), r[cols[0]]), r[cols[0]])
        top, maps[name] = max([r[0] for r in into[name] if r[0] is not None], default=0), {}
        for r in sorted(rows, key=ident):
            old, k = r[cols[0]], key(r)
            if k is None or k not in have:
                if link.id:
                    top += 1
                    r[link.id] = top
                if k is not None:
                    have[k] = r[cols[0]]
                out[name].append(tuple(r[c] for c in cols))
                maps[name][old] = r[cols[0]]
            else:
                maps[name][old] = have[k]
    return out, maps


def drawn(rng, shift):
    pick = lambda xs: rng.choice([*xs, None])
    uuid = lambda s, n: pick([f"{s}{i}" for i in range(n)])
    names = [(shift + 3 * i, uuid("n", 6)) for i in range(1, 7)]
    images = [(shift + 2 * i, uuid("g", 8), "x") for i in range(1, 8)]
    annots = [(shift + i, uuid("a", 20), pick([g[0] for g in images]), rng.choice([n[0] for n in names] + [0, -4, 999])) for i in range(1, 15)]
    of = lambda: rng.choice([a[0] for a in annots])
    sets = [(shift + i, uuid("s", 3)) for i in range(1, 4)]
    return {
        "names": names, "images": images, "annots": annots, "annotmatch": [(shift + i, of(), of(), i) for i in range(1, 12)], "imagesets": sets,
        "imageset_images": [(rng.choice(sets)[0], rng.choice(images)[0]) for _ in range(10)],
    }


@pytest.mark.parametrize("seed", range(3))
def test_merge_as_plain(spark, seed):
    rng = random.Random(seed)
    a, b = drawn(rng, 0), drawn(rng, 100)
    a["imageset_images"] = sorted(set(a["imageset_images"]))
    got, maps = merge_stores(frames(spark, a), frames(spark, b))
    want, links = plain(a, b)
    order = lambda rows: sorted(rows, key=str)
    for name in SCHEMAS:
        assert order(tuple(r) for r in got[name].collect()) == order(want[name]), name
    for name in maps:
        assert {r["old"]: r["new"] for r in maps[name].collect()} == links[name], name


def test_merge_edges(spark):
    a = frames(spark, {"names": [(5, "x")], "annots": [(1, "u", None, 5)]})
    b = frames(spark, {"names": [(1, "x"), (2, "y"), (None, "z")], "annots": [(8, "v", 3, 2), (9, "u", 3, 1)], "imagesets": [(4, "s")]})
    got, maps = merge_stores(a, b)
    assert sorted(tuple(r) for r in got["names"].collect()) == [(5, "x"), (6, "y")]
    assert sorted(map(tuple, got["annots"].collect()), key=str) == [(1, "u", None, 5), (2, "v", None, 6)]  # image 3 is not in the store
    assert [tuple(r) for r in got["imagesets"].collect()] == [(1, "s")]
    assert sorted(tuple(r) for r in maps["annots"].collect()) == [(8, 2, True), (9, 1, False)]
    # Merging the same again adds nothing; empty tables neither.
    again, _ = merge_stores(got, b)
    assert {n: df.count() for n, df in again.items()} == {"names": 2, "annots": 2, "imagesets": 1}
    none, _ = merge_stores(got, {n: df.limit(0) for n, df in b.items()})
    assert none["annots"].count() == 2
    extra = {"names": b["names"].selectExpr("nid", "'w' || nid as name_text", "1 as `a.b`")}
    assert sorted(r["name_text"] for r in merge_stores(got, extra, {"names": Link("nid", ("name_text",))})[0]["names"].collect()) == ["w1", "w2", "x", "y"]


def test_store_part(spark):
    tables = frames(spark, {
        "names": [(1, "x"), (2, "y"), (3, "z")], "images": [(1, "g", None), (2, "h", None), (3, "i", None)], "annots": [(1, "a", 1, 1), (2, "b", 1, 2), (3, "c", 2, 1), (4, "d", None, None)],
        "annotmatch": [(1, 1, 3, 0), (2, 1, 2, 0), (3, None, 1, 0)], "imagesets": [(1, "s"), (2, "t")], "imageset_images": [(1, 1), (2, 3), (1, 3)],
    })
    ids = lambda name, column, *vs: {n: sorted(tuple(r)[:2] for r in df.collect()) for n, df in store_part(tables, name, spark.createDataFrame([(v,) for v in vs], f"{column} long")).items()}
    by_name = ids("names", "nid", 1, 77)
    assert by_name["annots"] == [(1, "a"), (3, "c")] and by_name["images"] == [(1, "g"), (2, "h")] and by_name["names"] == [(1, "x")]
    assert by_name["annotmatch"] == [(1, 1)] and by_name["imageset_images"] == [(1, 1)] and by_name["imagesets"] == [(1, "s")]
    by_image = ids("images", "gid", 1, 3)
    assert by_image["annots"] == [(1, "a"), (2, "b")] and by_image["images"] == [(1, "g"), (3, "i")] and by_image["imagesets"] == [(1, "s"), (2, "t")]
    lone = ids("annots", "aid", 4)
    assert lone["annots"] == [(4, "d")] and lone["images"] == lone["names"] == lone["annotmatch"] == []
