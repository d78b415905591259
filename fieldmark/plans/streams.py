"""Queries that run a stream to its end over a table, to be held against a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.lineage import fresh_path
from fieldmark.plans.registry import ROOTS_SQL, query, review_edges
from fieldmark.sources.tables import table
from fieldmark.streaming.incremental import growing_components, moving_average, once, read_stream


def _run(stream: DataFrame, spark: SparkSession, label: str) -> DataFrame:
    """The rows that a stream appends, from files in the shared folder."""
    out = fresh_path(spark, label)
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("SELECT event_id, user_id, event_type FROM events")
def stream_once(spark: SparkSession, sf: str) -> DataFrame:
    """Every event once, though the stream reads its table twice."""
    path = f"{sf}/events.parque[t]"
    schema = table(spark, sf, "events").schema
    read = lambda: read_stream(spark, path, schema).withColumn("at", F.expr("cast(ts AS timestamp)"))
    both = read().unionByName(read())
    return _run(once(both, ["event_id"], "at", "365 days").select("event_id", "user_id", "event_type"), spark, "stream-once")


@query("""WITH RECURSIVE k AS (SELECT user_id, (value > 50)::INT AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
s AS (SELECT user_id, i, 0.1::DOUBLE * v + 0.9::DOUBLE AS e FROM k WHERE i = 1 UNION ALL SELECT k.user_id, k.i, 0.1::DOUBLE * k.v + 0.9::DOUBLE * s.e FROM s JOIN k ON k.user_id = s.user_id AND k.i = s.i + 1)
SELECT user_id::VARCHAR AS key, count(*) AS n, round(arg_max(e, i), 6) AS ewma FROM s GROUP BY user_id""")
def stream_moving_average(spark: SparkSession, sf: str) -> DataFrame:
    """Moving average of span 19 over each user's events; the last state of each user. All files make one batch, for events are in
    no order among files."""
    schema = table(spark, sf, "events").schema
    rows = read_stream(spark, f"{sf}/events.parque[t]", schema, files_per_batch=None).select(F.col("user_id").cast("string").alias("key"), (F.col("value") > 50).cast("int").alias("value"), F.col("event_id").alias("pos"))
    out = fresh_path(spark, "stream-average")

    def keep(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(out)

    q = moving_average(rows, 19).writeStream.foreachBatch(keep).option("checkpointLocation", f"{out}-state").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    last = spark.read.parquet(out).groupBy("key").agg(F.max_by(F.struct("n", "ewma"), "batch").alias("s"))
    return last.select("key", F.col("s.n").alias("n"), F.round("s.ewma", 6).alias("ewma"))


@query(f"WITH RECURSIVE {ROOTS_SQL} SELECT node, root FROM roots WHERE node IN (SELECT a FROM m)")
def stream_components(spark: SparkSession, sf: str) -> DataFrame:
    """Match edges arriving in three batches; the same components as of all at once."""
    edges = review_edges(spark, sf).where("state = 'match'").withColumn("part", F.pmod(F.xxhash64("a", "b"), F.lit(3)))
    held: list[str] = []

    def write(labels: DataFrame) -> None:
        held.append(fresh_path(spark, "stream-labels"))
        labels.write.parquet(held[-1])

    merge = growing_components(lambda: spark.read.parquet(held[-1]) if held else None, write)
    for i in range(3):
        merge(edges.where(F.col("part") == i), i)
    return spark.read.parquet(held[-1])
