"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

Documents with equal texts form a group, which is placed whole; only a group that is larger than a shard's share in any
dimension is cut, by a hash of the row, into pieces that are not. Groups that are a notable part of the whole, and those
pieces, are few whatever the input's size (at most PIECES for each dimension and two for each shard): the driver places
them first, from large to small, each in the shard where the dot product of its vector with the residual capacities is
highest, bytes counting most. All other groups are dealt by hash into cells of about CELL_GROUPS; each cell's task places
its groups one by one in the same way, its capacities being its part of what the large ones left free in each shard. At
last single groups, of the large ones as of each cell, move from the fullest to the emptiest shard while that lessens
the spread of bytes, those first that bring all dimensions closest.

Slots number a shard's rows without gaps: rows are counted by (shard, bucket of the row), bucket counts are prefix-summed,
and only rows within a bucket, a few thousand, are ordered.

Edge cases: a null text counts as empty (size 1, crc32 0), and such rows form a group; null ids hash as the empty text;
identical rows get slots of their own; an empty table gives an empty result. A single document larger than a shard's
share is placed whole. Columns are taken by name; others do not matter, nor do their names.
"""

from __future__ import annotations

from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldmark.llm._base import store, table, word_count

PIECES = 1024
CELL_GROUPS = 20_000
SLOT_ROWS = 4000
#: How much bytes, tokens and rows count in the dot product.
DIMS = (4.0, 1.0, 1.0)


def pack(vectors: np.ndarray, capacity: np.ndarray, dims: tuple[float, ...] = DIMS) -> np.ndarray:
    """Shard of each row of vectors (items x dimensions), by shares of the whole; capacity (shards x dimensions) is in
    the same shares. Ties go to the lower shard; large items come first."""
    weight, left = np.asarray(dims), capacity.astype(float).copy()
    at = np.zeros(len(vectors), dtype=np.int64)
    for i in np.lexsort((np.arange(len(vectors)), -vectors.max(axis=1, initial=0))):
        k = int(np.argmax(left @ (vectors[i] * weight)))
        at[i] = k
        left[k] -= vectors[i]
    return at


def level(vectors: np.ndarray, at: np.ndarray, capacity: np.ndarray, dims: tuple[float, ...] = DIMS, rounds: int = 2000) -> np.ndarray:
    """Move single items from the fullest to the emptiest shard while that lessens the spread of the first dimension."""
    weight, over = np.asarray(dims), -capacity.astype(float)
    np.add.at(over, at, vectors)
    for _ in range(rounds):
        high, low = int(over[:, 0].argmax()), int(over[:, 0].argmin())
        gap = over[high] - over[low]
        if gap[0] <= 1e-4 * capacity[:, 0].mean():
            break
        own = np.flatnonzero((at == high) & (vectors[:, 0] > 0) & (vectors[:, 0] < gap[0]))
        if not len(own):
            break
        x = vectors[own]
        i = own[np.argmin((weight * x * (x - gap)).sum(axis=1))]
        at[i] = low
        over[high] -= vectors[i]
        over[low] += vectors[i]
    return at


def _place_cells(small: DataFrame, cells: int, free: np.ndarray) -> DataFrame:
    """(_group, shard) of the groups (_group, _b, _t, _n); free: the part of each dimension that each shard takes."""
    parts = np.maximum(free, 0)
    parts = np.where(parts.sum(axis=0) > 0, parts, 1.0)
    parts = parts / parts.sum(axis=0)

    def place(key: tuple[Any, ...], t: Any) -> Any:
        import pyarrow as pa

        # Cells begin with different shards, so that what they leave uneven does not add up.
        turn = key[0].as_py() % len(parts)
        own = np.roll(parts, -turn, axis=0)

        t = t.sort_by("_group")
        v = np.stack([t.column(c).to_numpy().astype(float) for c in ("_b", "_t", "_n")], axis=1)
        total = v.sum(axis=0)
        v = v / np.where(total > 0, total, 1)
        at = (level(v, pack(v, own), own) + turn) % len(parts)
        return pa.table({"_group": t.column("_group"), "shard": pa.array(at.astype(np.int32))})

    cell = F.pmod(F.xxhash64("_group", F.lit(11)), F.lit(cells)).cast("int")
    return small.select(cell.alias("_cell"), "_group", "_b", "_t", "_n").groupBy("_cell").applyInArrow(place, "_group long, shard int")


def assign_shards(docs: DataFrame, *, text: str = "text", key: str = "doc_id", shards: int = 16, tokens: Column | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: key, carry columns, size (UTF-8 bytes and 1), tokens, text_crc32, shard, slot."""
    body = F.coalesce(F.col(text), F.lit(""))
    group = F.xxhash64(body)
    base = docs.select(
        key, *carry, (F.octet_length(body) + 1).cast("long").alias("size"), (word_count(F.col(text)) if tokens is None else tokens).cast("long").alias("tokens"), F.crc32(body.cast("binary")).alias("text_crc32"),
        group.alias("_group"), F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), group).alias("_row"),
    )
    base = store(base, "shard-rows") if not carry else base
    spark = docs.sparkSession
    sums = [F.sum("size").alias("_b"), F.sum("tokens").alias("_t"), F.count(F.lit(1)).alias("_n")]
    groups = store(base.groupBy("_group").agg(*sums), "shard-groups")
    total = groups.agg(F.sum("_b").alias("_b"), F.sum("_t").alias("_t"), F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("groups")).first()
    whole = np.array([float(max(total[c] or 0, 1)) for c in ("_b", "_t", "_n")])
    share = F.greatest(*[F.col(c) / F.lit(float(v)) for c, v in zip(("_b", "_t", "_n"), whole, strict=True)])
    # No more than PIECES groups for each dimension can be this large.
    large = groups.where(share >= 1.0 / PIECES).select("_group", F.when(share > 1.0 / shards, F.least(F.col("_n"), F.ceil(share * shards))).otherwise(1).cast("long").alias("_k"))
    large = F.broadcast(store(large, "shard-large"))
    rows = base.join(large, "_group", "left")
    rows = rows.withColumn("_piece", F.when(F.col("_k").isNotNull(), F.pmod(F.col("_row"), F.col("_k"))).cast("int"))
    # A bounded list: large groups and pieces.
    items = rows.where(F.col("_k").isNotNull()).groupBy("_group", "_piece").agg(*sums).orderBy("_group", "_piece").collect()
    vectors = np.array([[x["_b"], x["_t"], x["_n"]] for x in items], dtype=float).reshape(-1, 3) / whole
    free = np.full((shards, 3), 1.0 / shards)
    placed = level(vectors, pack(vectors, free), free)
    np.subtract.at(free, placed, vectors)
    plan = spark.createDataFrame([(x["_group"], x["_piece"], int(k)) for x, k in zip(items, placed, strict=True)], "_group long, _piece int, shard int")
    small = groups.join(large, "_group", "left_anti")
    of_group = _place_cells(small, max(1, -(-total["groups"] // CELL_GROUPS)), free)
    first_of = lambda df: df.drop("_k", "_piece")
    kept = first_of(rows.where(F.col("_k").isNotNull()).join(F.broadcast(plan), ["_group", "_piece"]))
    rows = store(kept.unionByName(first_of(rows.where(F.col("_k").isNull())).join(of_group, "_group")), "shard-placed")
    n = total["_n"] or 0
    buckets = max(1, -(-n // (shards * SLOT_ROWS)))
    rows = rows.withColumn("_bucket", F.pmod(F.col("_row"), F.lit(buckets)))
    counts = rows.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_c"))
    first = F.coalesce(F.sum("_c").over(W.partitionBy("shard").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = store(counts.withColumn("_first", first).drop("_c"), "shard-counts")
    within = F.row_number().over(W.partitionBy("shard", "_bucket").orderBy("_row", F.col(key).asc_nulls_first(), "text_crc32", "_group"))
    rows = rows.withColumn("_within", within).join(counts, ["shard", "_bucket"])
    return rows.select(key, *carry, "size", "tokens", "text_crc32", "shard", (F.col("_first") + F.col("_within") - 1).cast("long").alias("slot"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: doc_id, size, text_crc32, shard, slot of every row of docs."""
    return assign_shards(docs).select("doc_id", "size", "tokens", "text_crc32", "shard", "slot")
