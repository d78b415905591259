"""Which names are seen together, when and how often, as rows and as lines of text to export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.operators.prefix import sums_before


def of_species(members: DataFrame, seen: DataFrame, species: str) -> DataFrame:
    """Rows of members whose name is mostly of this species in seen (name, species); of equally frequent ones the least counts."""
    counts = seen.where(F.col("species").isNotNull()).groupBy("name", "species").agg(F.count(F.lit(1)).alias("n"))
    most = counts.groupBy("name").agg(F.min_by("species", F.struct(-F.col("n"), "species")).alias("species"))
    return members.join(most.where(F.col("species") == species).select("name"), "name", "left_semi").select(*members.columns)


def association_times(members: DataFrame) -> DataFrame:
    """(name1, name2, groups, n, times): names seen in one group, name1 <= name2, a name with itself too.

    members has grp, name, t (a group's time; its least where rows differ). groups counts the groups, n the distinct times, which
    are listed as texts in their order; a group without a time counts as `None`. Rows without group or name are left out.
    The result has a row for each pair that occurs, so a group of m names costs m * m / 2 rows before they are counted.
    """
    rows = members.where(F.col("grp").isNotNull() & F.col("name").isNotNull())
    own = rows.select("grp", F.col("name").cast("string").alias("name1")).distinct()
    times = rows.groupBy("grp").agg(F.coalesce(F.min("t").cast("string"), F.lit("None")).alias("t"))
    pairs = own.join(own.withColumnRenamed("name1", "name2"), "grp").where(F.col("name1") <= F.col("name2"))
    met = pairs.join(times, "grp").groupBy("name1", "name2", "t").agg(F.count(F.lit(1)).alias("groups"))
    per = met.groupBy("name1", "name2").agg(F.sum("groups").alias("groups"), F.array_sort(F.collect_list("t")).alias("times"))
    return per.select("name1", "name2", "groups", F.size("times").cast("long").alias("n"), "times")


def quoted(text: Column) -> Column:
    """A field of a CSV line, in quotes where it holds a comma, a quote or a line's end."""
    return F.when(text.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def _numbered(label: str, n: Column) -> Column:
    """label for one column, label1,label2,.. for any other number."""
    return F.when(n == 1, F.lit(label)).when(n > 1, F.array_join(F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: F.concat(F.lit(label), i.cast("string"))), ",")).otherwise(F.lit(""))


def list_lines(pairs: DataFrame) -> DataFrame:
    """(place, line): the header, then a line a pair: both names, n, the times."""
    head = pairs.agg(F.max("n").alias("_most")).select(F.struct(F.lit(0).alias("head"), F.lit("").alias("a"), F.lit("").alias("b")).alias("place"), F.concat(F.lit("NAME1,NAME2,ASSOCIATIONS,"), _numbered("TIME", F.coalesce("_most", F.lit(0)))).alias("line"))
    line = F.concat_ws(",", quoted(F.col("name1")), quoted(F.col("name2")), F.col("n").cast("string"), F.array_join(F.transform("times", quoted), ","))
    return head.unionByName(pairs.select(F.struct(F.lit(1).alias("head"), F.col("name1").alias("a"), F.col("name2").alias("b")).alias("place"), line.alias("line")))


def matrix_rows(pairs: DataFrame) -> DataFrame:
    """(pos, name, cells): a row a name, from 0 in code point order; cells has a field for each name up to the row's own with
    the number of common groups, empty where there is none, and empty fields for the names after it.

    Fields are laid out from the pairs that occur, as runs of commas between them, so that no table of all pairs is made.
    """
    names = pairs.where("name1 = name2").select(F.col("name1").alias("name"), F.lit(1).cast("long").alias("_one"))
    placed = sums_before(names, "name", "_one").select("name", F.col("_one_before").alias("pos"))
    col = placed.select(F.col("name").alias("name1"), F.col("pos").alias("_j"))
    entries = pairs.join(col, "name1").groupBy(F.col("name2").alias("name")).agg(F.array_sort(F.collect_list(F.struct("_j", "groups"))).alias("e"))
    total = placed.agg(F.count(F.lit(1)).alias("_all"))
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("e", i - 1)["_j"])
    fields = F.transform("e", lambda x, i: F.concat(F.repeat(F.lit(","), (x["_j"] - before(i)).cast("int")), x["groups"].cast("string")))
    rest = F.repeat(F.lit(","), (F.col("_all") - 1 - F.col("pos")).cast("int"))
    return entries.join(placed, "name").crossJoin(F.broadcast(total)).select("pos", "name", F.concat(F.array_join(fields, ""), rest).alias("cells"))


def matrix_lines(pairs: DataFrame) -> DataFrame:
    """(place, line): the header, then a line for each of matrix_rows."""
    rows = matrix_rows(pairs)
    n = pairs.where("name1 = name2").agg(F.count(F.lit(1)).alias("_n"))
    head = n.select(F.lit(-1).cast("long").alias("place"), F.concat(F.lit("MATRIX,"), _numbered("NAME", F.col("_n"))).alias("line"))
    return head.unionByName(rows.select(F.col("pos").alias("place"), F.concat_ws(",", quoted(F.col("name")), F.col("cells")).alias("line")))


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines as text in the order of place: the files, in the order of their names, are one file cut in parts."""
    lines.sort("place").select("line").write.mode("overwrite").text(path)
