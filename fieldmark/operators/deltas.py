"""Set operations, differences of snapshots, updates, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldmark.operators.prefix import sums_before


def append_new(table: DataFrame, rows: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """table and those of rows whose key it lacks; of rows that share a key the first in order of all columns is taken."""
    order = [F.col(c).asc_nulls_last() for c in rows.columns]
    once = rows.withColumn("_nth", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where(F.col("_nth") == 1).drop("_nth")
    return table.unionByName(once.join(table.select(*key), list(key), "left_anti").select(*table.columns))


def upsert(table: DataFrame, rows: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """rows, and those of table whose key they lack."""
    return rows.select(*table.columns).unionByName(table.join(rows.select(*key), list(key), "left_anti").select(*table.columns))


def update_column(table: DataFrame, values: DataFrame, key: str, column: str) -> DataFrame:
    """table with new values of a column where values (key, column) has them."""
    new = values.select(key, F.col(column).alias("_new"), F.lit(True).alias("_has"))
    return table.join(new, key, "left").withColumn(column, F.when(F.col("_has"), F.col("_new")).otherwise(F.col(column))).select(*table.columns)


def delete_rows(table: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    return table.join(keys.select(*on), list(on), "left_anti")


def delete_cascade(tables: dict[str, DataFrame], root: str, key: str, keys: DataFrame, children: dict[str, str]) -> dict[str, DataFrame]:
    """Tables without these keys of root, nor rows of children (table -> foreign key column) that point to them."""
    out = dict(tables)
    out[root] = delete_rows(tables[root], keys, key)
    for child, column in children.items():
        out[child] = tables[child].join(keys.select(F.col(key).alias(column)), column, "left_anti").select(*tables[child].columns)
    return out


def dangling(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows of child whose non-null reference has no parent."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)), column, "left_anti").select(*child.columns)


def duplicates_by_hash(df: DataFrame, content: Column, order: list[Column]) -> DataFrame:
    """Rows that repeat the content of an earlier one, in this order."""
    hashed = df.withColumn("_hash", F.md5(content.cast("binary")))
    return hashed.withColumn("nth", F.row_number().over(W.partitionBy("_hash").orderBy(*order))).where(F.col("nth") > 1).drop("_hash")


def state_delta(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows of new that are not in old (is_new) or differ from it, with old_* and new_* columns."""
    a = old.select(*keys, *[F.col(c).alias(f"old_{c}") for c in columns], F.lit(True).alias("_old"))
    b = new.select(*keys, *[F.col(c).alias(f"new_{c}") for c in columns])
    both = b.join(a, keys, "left")
    changed = F.lit(False)
    for c in columns:
        changed = changed | ~F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    both = both.withColumn("is_new", F.col("_old").isNull())
    return both.where(F.col("is_new") | changed).drop("_old")


def grouping_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """(kind, groups): new groups of (node, grp) that are unchanged, a part of one old group (split), a union of whole
    ones (merge), or both (hybrid)."""
    o = old.select("node", F.col("grp").alias("o")).join(old.groupBy(F.col("grp").alias("o")).agg(F.count(F.lit(1)).alias("no")), "o")
    met = new.select("node", F.col("grp").alias("g")).join(o, "node").groupBy("g", "o", "no").agg(F.count(F.lit(1)).alias("c"))
    per = met.groupBy("g").agg(F.count(F.lit(1)).alias("olds"), F.min((F.col("c") == F.col("no")).cast("int")).alias("whole"))
    kind = F.when((F.col("olds") == 1) & (F.col("whole") == 1), "unchanged").when(F.col("olds") == 1, "split").when(F.col("whole") == 1, "merge").otherwise("hybrid")
    return per.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("groups"))


def consecutive_names(names: DataFrame, code: str, order: str, prefix: str) -> DataFrame:
    """names with new_name: prefix, code and a number that runs within the code."""
    nth = F.row_number().over(W.partitionBy(code).orderBy(order))
    return names.withColumn("new_name", F.format_string(f"{prefix}_%s_%04d", F.col(code).cast("string"), nth))


def next_number(names: DataFrame, column: str, prefix: str) -> DataFrame:
    """One row: the least number beyond all names of this prefix."""
    n = F.regexp_extract(column, f"^{prefix}_?([0-9]+)$", 1)
    return names.agg(F.coalesce(F.max(F.when(n != "", n.cast("long"))), F.lit(0)).alias("last")).select((F.col("last") + 1).alias("next"))


def export_closure(child: DataFrame, keys: DataFrame, on: str, parents: list[tuple[DataFrame, str, str]]) -> list[DataFrame]:
    """The rows of child with these keys and, table by table, the rows of parents that they reach: (table, its key, the
    column of the table before that points to it)."""
    out = [child.join(keys, on, "left_semi")]
    for table, key, column in parents:
        out.append(table.join(out[-1].select(F.col(column).alias(key)).distinct(), key, "left_semi"))
    return out


def merge_by_superkey(into: DataFrame, other: DataFrame, key: str, id_column: str) -> DataFrame:
    """into, and the rows of other whose superkey it lacks, with ids that continue its own."""
    top = into.agg(F.coalesce(F.max(id_column), F.lit(-1)).alias("_top"))
    fresh = other.join(into.select(key), key, "left_anti")
    fresh = sums_before(fresh.withColumn("_one", F.lit(1)), key, "_one").withColumn("_nth", F.col("_one_before") + 1)
    fresh = fresh.crossJoin(F.broadcast(top)).withColumn(id_column, (F.col("_top") + F.col("_nth")).cast(into.schema[id_column].dataType)).select(*into.columns)
    return into.unionByName(fresh)


def lookup(ids: DataFrame, table: DataFrame, key: str, *columns: str) -> DataFrame:
    """ids (pos, key) with columns of table: order and repeats kept, missing ids null."""
    return ids.join(table.select(key, *columns), key, "left").select("pos", key, *columns)
