"""A stored index of descriptors that grows and shrinks: cells around centroids, searched by cell.

The index is a folder: `cells` (cell, vec), fixed when it is built; `entries` (cell, fx, aid, vec, reach, batch), to which
every addition appends; `removed` (aid, batch). An entry is live unless its observation was removed after the entry's
batch, so removing writes ids only, and an observation may come back. `compact` writes the live entries anew.

A search reads the cells nearest to each query first. In its exact form the k-th distance so found bounds what is left: by
the triangle inequality a cell whose centre is farther than that by more than its radius holds nothing nearer, and only
the other cells are read. How many those are depends on the data's contrast, not on how many blocks the index has.

Work is cut into tiles (cell, block of its entries, chunk of its queries) of bounded size, so neither a large cell nor
one that all queries want meets in one task. Centroids, at most MAX_CELLS, are all that is collected.

Edge cases: null vectors and ids take no part; repeated fx within an index are entries of their own; fewer than k entries
give fewer rows; an index of nothing finds nothing; adding nothing and removing unknown ids change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldmark.lineage import fresh_path, store
from fieldmark.operators.matching import DIST_PLACES, tile_of
from fieldmark.operators.words import train_vocabulary

#: Rows of a cell's block, and queries that search it at once.
BLOCK_ROWS, CHUNK_ROWS = 8192, 2048
MAX_CELLS = 16_384
#: Rows by which centroids are placed; every row is indexed.
TRAIN_ROWS = 200_000
_ENTRIES = "cell int, fx long, aid long, vec array<double>, reach double, batch long"
_CELLS = "cell int, vec array<double>"
_REMOVED = "aid long, batch long"


def _matrix(column: Any) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1) - 2 * (x @ centres.T), 0))


class DescriptorIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def build(cls, descriptors: DataFrame, *, cells: int, path: str | None = None, rounds: int = 4, train_rows: int = TRAIN_ROWS, seed: int = 0) -> DescriptorIndex:
        """An index of descriptors (fx, aid, vec) around `cells` centroids, placed by k-means over at most train_rows of them."""
        spark = descriptors.sparkSession
        index = cls(spark, path or fresh_path(spark, "descriptor-index"))
        known = descriptors.where(F.col("vec").isNotNull() & F.col("fx").isNotNull())
        sample = store(known.select("fx", "vec").orderBy(F.xxhash64("fx", F.lit(seed)), "fx").limit(train_rows), "index-sample")
        centres = train_vocabulary(sample, min(cells, MAX_CELLS), rounds, seed)
        centres.select(F.col("word").cast("int").alias("cell"), "vec").write.parquet(f"{index.path}/cells")
        spark.createDataFrame([], _REMOVED).write.parquet(f"{index.path}/removed")
        spark.createDataFrame([], _ENTRIES).write.parquet(f"{index.path}/entries")
        index.add(descriptors)
        return index

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _centres(self) -> tuple[np.ndarray, np.ndarray]:
        rows = self._read("cells", _CELLS).orderBy("cell").limit(MAX_CELLS).collect()
        return np.array([r["cell"] for r in rows], dtype=np.int32), np.array([r["vec"] for r in rows], dtype=np.float64)

    def _next_batch(self) -> int:
        last = self._read("entries", _ENTRIES).select("batch").unionByName(self._read("removed", _REMOVED).select("batch")).agg(F.max("batch").alias("b")).first()
        return (last["b"] or 0) + 1

    def add(self, descriptors: DataFrame) -> None:
        """Index descriptors (fx, aid, vec), each in its nearest cell."""
        numbers, centres = self._centres()
        if not len(numbers):
            return

        def place(batches: Iterator[Any]) -> Iterator[Any]:
            import pyarrow as pa

            for b in batches:
                if len(b):
                    far = _distances(_matrix(b.column("vec")), centres)
                    at = far.argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(numbers[at]), b.column("fx"), b.column("aid"), b.column("vec"), pa.array(far[np.arange(len(at)), at])], names=["cell", "fx", "aid", "vec", "reach"])

        known = descriptors.where(F.col("vec").isNotNull() & F.col("fx").isNotNull()).select(F.col("fx").cast("long").alias("fx"), F.col("aid").cast("long").alias("aid"), F.col("vec").cast("array<double>").alias("vec"))
        placed = known.mapInArrow(place, "cell int, fx long, aid long, vec array<double>, reach double").withColumn("batch", F.lit(self._next_batch()).cast("long"))
        placed.repartitionByRange("cell", "fx").sortWithinPartitions("cell").write.mode("append").parquet(f"{self.path}/entries")

    def remove(self, aids: DataFrame) -> None:
        """Forget the descriptors of observations (aid) that are there now."""
        batch = self._next_batch()
        aids.select(F.col("aid").cast("long").alias("aid")).where(F.col("aid").isNotNull()).distinct().withColumn("batch", F.lit(batch).cast("long")).write.mode("append").parquet(f"{self.path}/removed")

    def live(self) -> DataFrame:
        """The entries that count: added after their observation was last removed."""
        gone = self._read("removed", _REMOVED).groupBy("aid").agg(F.max("batch").alias("_gone"))
        return self._read("entries", _ENTRIES).join(gone, "aid", "left").where(F.col("_gone").isNull() | (F.col("batch") > F.col("_gone"))).select("cell", "fx", "aid", "vec", "reach", "batch")

    def compact(self, path: str | None = None) -> DescriptorIndex:
        """The same index with its live entries only."""
        new = DescriptorIndex(self.spark, path or fresh_path(self.spark, "descriptor-index"))
        self._read("cells", _CELLS).write.parquet(f"{new.path}/cells")
        self.spark.createDataFrame([], _REMOVED).write.parquet(f"{new.path}/removed")
        self.live().repartitionByRange("cell", "fx").sortWithinPartitions("cell").write.parquet(f"{new.path}/entries")
        return new

    def _route(self, queries: DataFrame, probes: int, stats: dict[int, float], bound: bool) -> DataFrame:
        """queries with the cells each has to read: the nearest `probes`, or, given bounds, the others that may hold something nearer."""
        numbers, centres = self._centres()
        filled = np.isin(numbers, list(stats))
        numbers, centres = numbers[filled], centres[filled]
        radius = np.array([stats[int(c)] for c in numbers])
        names = [c for c in queries.columns if c != "bound"]

        def route(batches: Iterator[Any]) -> Iterator[Any]:
            import pyarrow as pa

            for b in batches:
                if not len(b) or not len(numbers):
                    continue  # nothing to ask, or nobody to be asked
                far = _distances(_matrix(b.column("vec")), centres)
                near = np.zeros(far.shape, dtype=bool)
                if probes < len(numbers):
                    np.put_along_axis(near, np.argpartition(far, probes - 1, axis=1)[:, :probes], True, axis=1)
                else:
                    near[:] = True
                if bound:
                    # Room for the rounding of distances and of the product above.
                    most = b.column("bound").to_numpy(zero_copy_only=False)[:, None]
                    near = ~near & (far - radius - 1e-6 * (1 + far) - 2 * 10.0**-DIST_PLACES <= most)
                i, j = np.nonzero(near)
                yield pa.RecordBatch.from_arrays([*[b.column(c).take(pa.array(i)) for c in names], pa.array(numbers[j])], names=[*names, "cell"])

        kinds = ", ".join(f"{c} {dict(queries.dtypes)[c]}" for c in names)
        return queries.mapInArrow(route, f"{kinds}, cell int")

    def _tiles(self, routed: DataFrame, entries: DataFrame, k: int, exclude: str | None) -> DataFrame:
        """(q_fx, d_fx, dist): the best k of each query and tile."""
        keep = [exclude] if exclude else []
        blocks = entries.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("_blocks"))
        chunks = routed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CHUNK_ROWS).cast("int").alias("_chunks"))
        # One row a cell.
        plan = F.broadcast(store(blocks.join(chunks, "cell"), "index-plan"))
        upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        of = lambda n: F.pmod(F.xxhash64("fx"), F.col(n)).cast("int")
        left = routed.join(plan, "cell").withColumn("_b", upto("_blocks")).withColumn("_c", of("_chunks")).select("cell", "_b", "_c", "fx", "vec", *keep)
        right = entries.join(plan, "cell").withColumn("_c", upto("_chunks")).withColumn("_b", of("_blocks")).select("cell", "_b", "_c", "fx", "vec", *keep)
        at = ("cell", "_b", "_c")
        return left.groupBy(*at).cogroup(right.groupBy(*at)).applyInArrow(tile_of(k, exclude), "q_fx long, d_fx long, dist double")

    def search(self, queries: DataFrame, k: int, *, probes: int = 8, exact: bool = False, exclude: str | None = None) -> DataFrame:
        """(q_fx, d_fx, dist, rank): the k nearest live entries of each query (fx, vec) that its cells hold; exact: of all.

        exclude: 'aid'; entries of the query's own observation do not count.
        """
        keep = [exclude] if exclude else []
        entries = store(self.live(), "index-live")
        # One row a cell.
        stats = {r["cell"]: r["radius"] for r in entries.groupBy("cell").agg(F.max("reach").alias("radius")).collect()}
        asked = queries.where(F.col("vec").isNotNull()).select(F.col("fx").cast("long").alias("fx"), F.col("vec").cast("array<double>").alias("vec"), *keep)
        nth = F.row_number().over(W.partitionBy("q_fx").orderBy("dist", "d_fx"))
        best = lambda df: df.withColumn("rank", nth).where(F.col("rank") <= k)
        first = best(self._tiles(store(self._route(asked, probes, stats, False), "index-routed"), entries, k, exclude))
        if not exact:
            return first
        first = store(first, "index-first")
        bounds = first.where(F.col("rank") == k).select(F.col("q_fx").alias("fx"), F.col("dist").alias("bound"))
        rest = asked.join(bounds, "fx", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
        more = self._tiles(store(self._route(rest, probes, stats, True), "index-routed"), entries, k, exclude)
        return best(first.select("q_fx", "d_fx", "dist").unionByName(more))


def cover(wanted: DataFrame, members: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """((key, aid) of the kept indexes that together hold wanted (aid), (aid) that none of them holds).

    members: key, aid. An index is of use only if all it holds is wanted; the largest is taken first, ties to the lesser
    key, then the largest that shares nothing with those taken. In rounds: an index that comes first among those left for
    every one of its members is taken, and those that share a member with it go.
    """
    members = members.select("key", "aid").distinct()
    want = wanted.select("aid").distinct()
    foreign = members.join(want, "aid", "left_anti").select("key").distinct()
    left = store(members.join(foreign, "key", "left_anti"), "cover-left")
    size = store(left.groupBy("key").agg(F.count(F.lit(1)).alias("size")), "cover-size")
    left = store(left.join(size, "key"), "cover-left")
    taken = []
    while left.limit(1).count():
        ahead = F.min(F.struct((-F.col("size")).alias("s"), "key")).over(W.partitionBy("aid"))
        ranked = left.withColumn("_first", ahead["key"] == F.col("key"))
        won = store(ranked.groupBy("key").agg(F.min("_first").alias("all")).where("all").select("key"), "cover-won")
        taken.append(store(left.join(won, "key", "left_semi"), "cover-taken"))
        lost = left.join(taken[-1].select("aid").distinct(), "aid", "left_semi").select("key").distinct()
        left = store(left.join(lost, "key", "left_anti"), "cover-left")
    out = left
    for t in taken:
        out = out.unionByName(t)
    if most is not None:
        # The first `most` in the order in which a greedy search takes them.
        best = out.select("key", "size").distinct().orderBy(F.desc("size"), "key").limit(most).select("key")
        out = out.join(best, "key", "left_semi")
    return out.select("key", "aid"), want.join(out.select("aid"), "aid", "left_anti")
