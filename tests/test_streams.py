"""Moving averages of streams whose rows come in no order."""

import duckdb

from fieldmark.plans import streams  # noqa: F401
from fieldmark.plans.registry import QUERIES, SQL


def moving_averages(spark, folder):
    got = sorted(tuple(r) for r in QUERIES["stream_moving_average"](spark, str(folder)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    return got, sorted(con.execute(SQL["stream_moving_average"]).fetchall())


def write_events(folder, *orders):
    """A file of events for each order of them."""
    (folder / "events.parquet").mkdir()
    for i, order in enumerate(orders):
        rows = f"SELECT e::BIGINT AS event_id, TIMESTAMP '2024-01-01' + to_seconds(e) AS ts, (e % 7)::BIGINT AS user_id, (e * 37 % 101)::DOUBLE AS value FROM range(2000) r(e) WHERE e % {len(orders)} = {i}"
        duckdb.connect().execute(f"COPY ({rows} ORDER BY {order}) TO '{folder}/events.parquet/{i}.parquet' (FORMAT parquet)")


def test_moving_average_of_keys_in_pieces(spark, tmp_path):
    write_events(tmp_path, "e DESC")
    most = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        got, want = moving_averages(spark, tmp_path)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
    assert got == want and len(got) == 7


def test_moving_average_of_events_in_several_files(spark, tmp_path):
    write_events(tmp_path, "e", "e DESC", "hash(e)")
    got, want = moving_averages(spark, tmp_path)
    assert got == want and len(got) == 7
