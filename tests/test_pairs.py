"""Nearest donors in time against all pairs."""

import random

import duckdb
import pytest

from fieldmark.operators.pairs import nearest_time
from fieldmark.plans import cohorts  # noqa: F401
from fieldmark.plans.registry import QUERIES, SQL


def nearest(rows, donors, most):
    best = {}
    for aid, key, t in rows:
        for donor, own, at, note in donors:
            if None not in (aid, donor, key, t, at) and key == own and aid != donor and abs(t - at) <= most:
                best[aid] = min(best.get(aid, (most + 1,)), (abs(t - at), donor, at, note))
    return sorted((aid, donor, at, note, gap) for aid, (gap, donor, at, note) in best.items())


@pytest.mark.parametrize(("ids", "span", "most"), [(400, 3000, 50), (60, 400, 100), (5, 200, 40), (300, 20, 7)])
def test_nearest_time_of_all_pairs(spark, ids, span, most):
    """Rows may be donors too, at the same time and at others; several lie at one time, some have no key or time."""
    rng = random.Random(ids)
    key, when = lambda: rng.choice(["a", "b", None]), lambda: None if rng.random() < 0.05 else rng.randrange(-span, span)
    rows = [(i, key(), when()) for i in range(ids)]
    donors = [(rng.randrange(ids), key(), when()) for _ in range(300)] + [r for r in rows if r[0] % 3 == 0]
    donors = [(*d, None if d[0] % 7 == 0 else f"{d[0]} {d[2]}") for d in donors]
    got = nearest_time(spark.createDataFrame(rows, "aid long, view string, t long"), spark.createDataFrame(donors, "aid long, view string, t long, note string"), "view", most)
    alone = lambda found: [r[:2] + r[4:] for r in found]
    got = sorted(tuple(r) for r in got.select("aid", "donor", "donor_t", "donor_note", "gap").collect())
    assert alone(got) == alone(nearest(rows, donors, most))
    assert {(d[0], d[2], d[3]) for d in donors} >= {r[1:4] for r in got}


def test_nearest_time_makes_no_pairs(spark):
    """All of 3,000 rows and 3,000 donors lie within reach of each other, but no step makes more rows than a few a row."""
    rows = spark.range(3000).selectExpr("id AS aid", "'a' AS view", "id % 1000 AS t")
    plan = nearest_time(rows, rows.selectExpr("aid + 3000 AS aid", "view", "t"), "view", 1000)
    assert "Join" not in plan._jdf.queryExecution().executedPlan().toString()
    assert {(r.donor - r.aid, r.gap) for r in plan.where("aid < 1000").collect()} == {(3000, 0)}


def test_speeds_round_as_the_sql(spark, tmp_path):
    """Speeds just below a half of the last place, whose product with 1000 is that half."""
    rows = "VALUES (312, 0, 1), (1022, 3, 1), (562, 0, 2), (1689, 10, 2)"
    con = duckdb.connect()
    con.execute(f"CREATE TABLE events AS SELECT e::BIGINT AS event_id, TIMESTAMP '2024-01-01' + to_seconds(s) AS ts, u::BIGINT AS user_id, 'view' AS event_type, 1.0::DOUBLE AS value FROM ({rows}) v(e, s, u)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got = sorted(tuple(r) for r in QUERIES["pair_speed"](spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(SQL["pair_speed"]).fetchall())
    assert [r[4] for r in got] == [14573016.33, 2781939.661]
