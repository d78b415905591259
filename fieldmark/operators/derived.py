"""Derived tables: per-row computations kept by a hash of their configuration.

A derivation is a function from rows to rows with typed configuration; its result is a table under a folder named by the
hash of its name and configuration. Rows already derived are not computed again; others are appended.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REGISTRY: dict[str, Derivation] = {}


class Derivation:
    """A named derivation: compute(rows, **config) keeps the key column of its rows."""

    def __init__(self, name: str, key: str, compute: Callable[..., DataFrame], defaults: dict[str, Any]):
        self.name, self.key, self.compute, self.defaults = name, key, compute, defaults

    def config(self, **given: Any) -> dict[str, Any]:
        """Defaults with what is given; keys and types are checked."""
        out = dict(self.defaults)
        for k, v in given.items():
            if k not in out:
                raise KeyError(f"{self.name} has no setting {k}")
            if out[k] is not None and not isinstance(v, type(out[k])):
                raise TypeError(f"{self.name}.{k}: {v!r} is no {type(out[k]).__name__}")
            out[k] = v
        return out

    def suffix(self, **given: Any) -> str:
        return hashlib.sha1(json.dumps([self.name, self.config(**given)], sort_keys=True).encode()).hexdigest()[:16]

    def get(self, rows: DataFrame, folder: str, **given: Any) -> DataFrame:
        """Derived rows for the keys of rows; those that the kept table lacks are computed and appended."""
        spark, config, path = rows.sparkSession, self.config(**given), f"{folder}/{self.name}_{self.suffix(**given)}"
        jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        have = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath)
        missing = rows.join(spark.read.parquet(path).select(self.key), self.key, "left_anti") if have else rows
        if not have or missing.limit(1).count():
            self.compute(missing, **config).write.mode("append").parquet(path)
        return spark.read.parquet(path).join(rows.select(self.key).distinct(), self.key, "left_semi")


def derivation(name: str, key: str, **defaults: Any) -> Callable[[Callable[..., DataFrame]], Derivation]:
    """Register a function as a derivation."""

    def add(f: Callable[..., DataFrame]) -> Derivation:
        REGISTRY[name] = Derivation(name, key, f, defaults)
        return REGISTRY[name]

    return add


@derivation("dlen", "aid")
def box_diagonal(rows: DataFrame) -> DataFrame:
    """(aid, dlen_sqrd): squared diagonal of each box."""
    return rows.select("aid", (F.col("width") * F.col("width") + F.col("height") * F.col("height")).alias("dlen_sqrd"))


@derivation("localizations", "image", sensitivity=0.05, nms=0.4)
def localizations(rows: DataFrame, sensitivity: float, nms: float) -> DataFrame:
    """(image, id, conf) of boxes that are sure enough and overlap no surer one too much."""
    from fieldmark.operators.components_deep import suppress

    return suppress(rows.where(F.col("conf") >= sensitivity), 1 - nms)


def model_scores(rows: DataFrame, column: str, predict: Callable[[Any], Any], name: str = "score") -> DataFrame:
    """rows with a model's score: predict takes a list of values and gives a list of numbers, a batch at a time.

    Image and network models plug in here; none comes with the library.
    """
    import pyarrow as pa

    def run(batches: Any) -> Any:
        for b in batches:
            yield pa.array([float(x) for x in predict(b.to_pylist())], pa.float64())

    from collections.abc import Iterator

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return rows.withColumn(name, F.arrow_udf(run, "double")(F.col(column)))
