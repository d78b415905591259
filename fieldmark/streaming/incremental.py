"""Streams of observations and reviews: sessions, deduplication, moving averages, growing components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, schema: Any, files_per_batch: int | None = 1) -> DataFrame:
    """A folder of Parquet files as a stream; None: all files that are there make one batch."""
    read = spark.readStream.schema(schema)
    return (read if files_per_batch is None else read.option("maxFilesPerTrigger", files_per_batch)).parquet(path)


def sessions(stream: DataFrame, gap: str, late: str, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """(key, start, end, n): session windows, closed once the watermark passes them."""
    window = F.session_window(F.col(ts), gap)
    return stream.withWatermark(ts, late).groupBy(window.alias("w"), F.col(key)).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(stream: DataFrame, key: list[str], ts: str, late: str) -> DataFrame:
    """Rows with a key not seen within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


def moving_average(stream: DataFrame, window: int, key: str = "key", value: str = "value", order: str = "pos") -> DataFrame:
    """(key, n, ewma): exponentially weighted mean of each key's values in order within a batch; starts at 1, weight
    2 / (window + 1). A key's rows of a batch reach its task in any order and in several pieces: their two numbers are held
    until all are there. What a later batch brings comes after, whatever its order."""
    alpha = 2.0 / (window + 1)

    def step(k: tuple[Any, ...], batches: Iterator[Any], state: Any) -> Iterator[Any]:
        import numpy as np
        import pandas as pd

        n, mean = state.get if state.exists else (0, 1.0)
        pieces = [(pdf[order].to_numpy(), pdf[value].to_numpy(dtype="float64")) for pdf in batches]
        at, values = (np.concatenate(side) for side in zip(*pieces, strict=True))
        for v in values[np.argsort(at, kind="stable")]:
            mean, n = alpha * float(v) + (1 - alpha) * mean, n + 1
        state.update((n, mean))
        yield pd.DataFrame({"key": [str(k[0])], "n": [n], "ewma": [mean]})

    return stream.select(key, value, order).groupBy(key).applyInPandasWithState(step, "key string, n long, ewma double", "n long, mean double", "update", "NoTimeout")


def growing_components(table: Callable[[], DataFrame | None], write: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that merges a batch of edges (a, b) into a table of (node, root).

    The batch's ends are replaced by their present roots, the components of that small graph are found, and labels move
    where a root has a new one. table() reads the labels, or None at first; write() replaces them.
    """
    from fieldmark.operators.graph import components

    def merge(batch: DataFrame, _: int) -> None:
        have = table()
        ends = batch.select("a", "b")
        if have is None:
            write(components(ends))
            return
        a, b = have.select(F.col("node").alias("a"), F.col("root").alias("ra")), have.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = components(ends.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
        new = moved.select(F.col("node").alias("old"), F.col("root").alias("to"))
        kept = have.join(new, F.col("root") == F.col("old"), "left").select("node", F.coalesce("to", "root").alias("root"))
        fresh = ends.select(F.col("a").alias("node")).union(ends.select(F.col("b").alias("node"))).distinct().join(have, "node", "left_anti")
        write(kept.unionByName(fresh.join(new, F.col("node") == F.col("old"), "left").select("node", F.coalesce("to", "node").alias("root"))))

    return merge
