"""A review graph kept along with a stream of decisions, which may also take edges away."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.lineage import discard, store
from fieldmark.operators.graph import components

SCHEMAS = {
    "edges": "a long, b long, state string, seq long, batch long",
    "labels": "node long, root long, batch long",
    "negatives": "r1 long, r2 long, n long, batch long",
}


class ReviewGraph:
    """Decisions, positive components and the counts of nomatch edges inside and between them, as logs in a shared folder.

    A decision is (a, b, state, seq), a and b in any order; of a pair's decisions that of the greatest (seq, state) holds,
    whenever it arrives. A batch rewrites only what it touches: the components that hold an end of an edge whose state
    has changed are found anew from their own match edges, so they may grow, merge and split; then the counts of pairs
    of components with one of these are taken anew. A batch's rows are a folder of their own and it reads only those of earlier
    batches, so a batch that is run again writes the same. Decisions on a node itself or with a null end, state or seq
    are left out; an empty batch changes nothing. snapshot() writes the present state as a new, short log.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        for table, schema in SCHEMAS.items():
            self._write(spark.createDataFrame([], schema).drop("batch"), table, -1)

    def _write(self, rows: DataFrame, table: str, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{table}/batch={batch}")

    def _log(self, table: str, before: int | None) -> DataFrame:
        rows = self.spark.read.schema(SCHEMAS[table]).parquet(f"{self.path}/{table}")
        return rows if before is None else rows.where(F.col("batch") < before)

    def edges(self, before: int | None = None) -> DataFrame:
        """(a, b, state, seq): what holds of each pair."""
        last = self._log("edges", before).groupBy("a", "b").agg(F.max(F.struct("seq", "state")).alias("s"))
        return last.select("a", "b", "s.state", "s.seq")

    def roots(self, before: int | None = None) -> DataFrame:
        """(node, root): the positive components, by their least node."""
        return self._log("labels", before).groupBy("node").agg(F.max_by("root", "batch").alias("root"))

    def negatives(self, before: int | None = None) -> DataFrame:
        """(r1, r2, n): nomatch edges between two components (r1 < r2) or inside one (r1 = r2)."""
        return self._log("negatives", before).groupBy("r1", "r2").agg(F.max_by("n", "batch").alias("n")).where("n > 0")

    def apply(self, batch: DataFrame, n: int) -> None:
        """Merge a batch of decisions; a function for foreachBatch."""
        own = batch.where("a is not null and b is not null and a <> b and state is not null and seq is not null")
        own = own.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max(F.struct("seq", "state")).alias("s"))
        held = self.edges(n).select("a", "b", F.struct("seq", "state").alias("old"))
        newer = own.join(held, ["a", "b"], "left").where(F.col("old").isNull() | (F.col("s") > F.col("old")))
        newer = store(newer.select("a", "b", "s.state", "s.seq", F.col("old.state").alias("was")), "newer")
        self._write(newer.drop("was"), "edges", n)
        changed = newer.where(~F.col("state").eqNullSafe(F.col("was")))
        ends = changed.select(F.col("a").alias("node")).union(changed.select(F.col("b").alias("node"))).distinct()
        roots = self.roots(n)
        touched = ends.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
        touched = store(touched, "touched")
        gone = touched.select("root").distinct()
        members = store(roots.join(gone, "root", "left_semi").select("node", "root").unionByName(touched.join(roots, "node", "left_anti")), "members")
        match = self.edges(n + 1).where("state = 'match'").join(members.select(F.col("node").alias("a")), "a", "left_semi")
        found = components(match.select("a", "b"))
        labels = members.join(found.withColumnRenamed("root", "to"), "node", "left").select("node", F.coalesce("to", "node").alias("root"))
        self._write(labels, "labels", n)
        # Counts: of all pairs with a component that was, or now is, among these.
        present = self.roots(n + 1)
        again = gone.union(present.join(members.select("node"), "node", "left_semi").select("root")).distinct()
        old = self.negatives(n).join(again.withColumnRenamed("root", "r1"), "r1", "left_semi").unionByName(self.negatives(n).join(again.withColumnRenamed("root", "r2"), "r2", "left_semi")).select("r1", "r2").distinct()
        apart = self.edges(n + 1).where("state = 'nomatch'")
        mine = members.select("node")
        near = apart.join(mine.withColumnRenamed("node", "a"), "a", "left_semi").unionByName(apart.join(mine.withColumnRenamed("node", "b"), "b", "left_semi"), allowMissingColumns=False).select("a", "b").distinct()
        at = lambda c: present.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
        counts = near.join(at("a"), "a").join(at("b"), "b").groupBy(F.least("ra", "rb").alias("r1"), F.greatest("ra", "rb").alias("r2")).agg(F.count(F.lit(1)).alias("n"))
        self._write(old.join(counts, ["r1", "r2"], "full").select("r1", "r2", F.coalesce("n", F.lit(0).cast("long")).alias("n")), "negatives", n)
        discard(newer, touched, members)

    def snapshot(self, path: str) -> ReviewGraph:
        """The present state in a new folder, as if it had come in one batch."""
        new = ReviewGraph(self.spark, path)
        new._write(self.edges(), "edges", -1)
        new._write(self.roots(), "labels", -1)
        new._write(self.negatives(), "negatives", -1)
        return new
