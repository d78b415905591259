"""Nearest neighbours of one tile against all pairs."""

import math
import random

import pyarrow as pa
import pytest

from fieldmark.operators.matching import tile_of


def nearest(queries, data, k, exclude):
    out = []
    for fx, vec, aid in queries:
        met = [(round(math.dist(vec, other), 5), at) for at, other, own in data if not (exclude and own == aid)]
        out += [(fx, at, dist) for dist, at in sorted(m for m in met if math.isfinite(m[0]))[:k]]
    return sorted(out)


@pytest.mark.parametrize("exclude", ["aid", None])
@pytest.mark.parametrize(("nq", "nd", "k", "names"), [(150, 1300, 5, 7), (20, 700, 600, 3), (70, 3, 5, 2), (5, 40, 2, 1)])
def test_tile_of_all_pairs(nq, nd, k, names, exclude):
    """Vectors on a coarse grid tie often; some have no finite length, which hides no others; some names are on one side only."""
    rng = random.Random(nd)
    some = lambda n, bad: [(3 * i + 1, [rng.randrange(-4, 5) / 2 for _ in range(3)] if rng.random() > bad else [1.0, math.nan, 0.0], rng.choice([None, *range(names)])) for i in rng.sample(range(n), n)]
    queries, data = some(nq, 0.1), some(nd, 0.02) + [(0, [9.0, 9.0, 9.0], 99), (2, [1.0, math.nan, 1.0], 99)]
    sides = [pa.table({"fx": [r[0] for r in side], "vec": [r[1] for r in side], "aid": pa.array([r[2] for r in side], pa.int64())}) for side in (queries, data)]
    got = tile_of(k, exclude)(*sides)
    assert sorted(zip(*(got.column(c).to_pylist() for c in ("q_fx", "d_fx", "dist")), strict=True)) == nearest(queries, data, k, exclude)
