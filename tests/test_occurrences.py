"""Clusters in time and space against all pairs."""

import math
import random

import pytest

from fieldmark.operators import sessions
from fieldmark.operators.sessions import occurrences

OBS = "aid long, t long, lat double, lon double"


def brute(rows, seconds, speed):
    root = {r[0]: r[0] for r in rows}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    def kind(r):
        place = r[2] is not None and r[3] is not None
        return 0 if r[1] is not None and place else 1 if r[1] is not None else 2 if place else 3

    for p in rows:
        for q in rows:
            if p[0] >= q[0] or kind(p) != kind(q) or kind(p) == 3:
                continue
            km = 0.0
            if kind(p) != 1:
                x, y = math.radians(p[2]), math.radians(q[2])
                h = math.sin((y - x) / 2) ** 2 + math.cos(x) * math.cos(y) * math.sin(math.radians(q[3] - p[3]) / 2) ** 2
                km = 2 * 6367.0 * math.asin(math.sqrt(min(h, 1.0)))
            if km / speed + (abs(p[1] - q[1]) if kind(p) != 2 else 0) <= seconds:
                a, b = sorted((find(p[0]), find(q[0])))
                root[b] = a
    return sorted((r[0], find(r[0])) for r in rows)


def some(rng, n, span, spread, null=0.1):
    rows = []
    for i in range(n):
        lat, lon = max(-90.0, min(90.0, rng.gauss(rng.choice([0, 89.9, -60]), spread))), rng.choice([179.95, 10.0]) + rng.gauss(0, spread)
        lon = lon - 360 if lon > 180 else lon
        rows.append((i + 1, None if rng.random() < null else rng.randrange(span), None if rng.random() < null else lat, lon))
    return rows


@pytest.mark.parametrize(("n", "span", "spread", "seconds", "speed"), [(250, 20000, 0.05, 600, 0.002), (300, 4000, 1.0, 600, 0.2), (120, 3000, 30.0, 1200, 20.0), (200, 60, 0.001, 600, 0.002)])
def test_occurrences_of_all_pairs(spark, n, span, spread, seconds, speed):
    rows = some(random.Random(n), n, span, spread)
    assert sorted(tuple(r) for r in occurrences(spark.createDataFrame(rows, OBS), seconds, speed).collect()) == brute(rows, seconds, speed)


def test_occurrences_of_nothing_and_of_copies(spark):
    assert occurrences(spark.createDataFrame([], OBS), 600).collect() == []
    copies = [(i, 100, 5.0, 5.0) for i in range(1, 60)] + [(99, None, None, 3.0)]
    assert {tuple(r) for r in occurrences(spark.createDataFrame(copies, OBS), 600).collect()} == {(i, 1) for i in range(1, 60)} | {(99, 99)}


def test_occurrences_store_no_pairs(spark, monkeypatch):
    """Of 1,500 rows each is near hundreds of others, in narrow cells of their own; what is stored grows with rows."""
    rng, counts = random.Random(5), []
    rows = [(i + 1, rng.randrange(3600), rng.uniform(-8, 8), rng.uniform(-8, 8)) for i in range(1500)]
    keep = sessions.store
    monkeypatch.setattr(sessions, "store", lambda df, label: counts.append(keep(df, label)) or counts[-1])
    assert sorted(tuple(r) for r in occurrences(spark.createDataFrame(rows, OBS), 1200, 0.5).collect()) == brute(rows, 1200, 0.5)
    assert max(df.count() for df in counts) < 5 * len(rows)
