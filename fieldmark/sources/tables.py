"""Reading and writing: tables and views, CSV, JSON, COCO-style annotations, text lists, waypoints, files, archives."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.schema import TABLES


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def open_store(spark: SparkSession, folder: str, names: list[str] | None = None, views: bool = True) -> dict[str, DataFrame]:
    """The store's tables by name, under their fixed schemas, as views too."""
    out = {n: spark.read.schema(TABLES[n]).parquet(f"{folder}/{n}.parquet") for n in names or TABLES}
    for n, df in out.items() if views else ():
        df.createOrReplaceTempView(n)
    return out


def write_table(df: DataFrame, folder: str, name: str, partition_by: list[str] | None = None) -> None:
    df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(f"{folder}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, mode="PERMISSIVE")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; arrays and structs as JSON."""
    nested = {f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "struct", "map")}
    df.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns]).write.mode("overwrite").csv(path, header=True)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def rows_of_lists(payload: DataFrame, column: str, fields: dict[str, str]) -> DataFrame:
    """Rows of a JSON object of equally long lists, such as a bulk insert: {"a": [..], "b": [..]}."""
    parsed = payload.select(F.from_json(column, ", ".join(f"{k} ARRAY<{t}>" for k, t in fields.items())).alias("p"))
    return parsed.select(F.explode(F.arrays_zip(*[F.col(f"p.{k}").alias(k) for k in fields])).alias("r")).select(*[F.col(f"r.{k}").alias(k) for k in fields])


COCO = "images ARRAY<STRUCT<id: BIGINT, file_name: STRING, width: INT, height: INT>>, annotations ARRAY<STRUCT<id: BIGINT, image_id: BIGINT, category_id: BIGINT, bbox: ARRAY<DOUBLE>>>, categories ARRAY<STRUCT<id: BIGINT, name: STRING>>"


def read_coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(images, boxes) of COCO-style files; boxes have the category's name."""
    files = spark.read.schema(COCO).json(path, multiLine=True)
    images = files.select(F.explode("images").alias("i")).select("i.*")
    names = files.select(F.explode("categories").alias("c")).select(F.col("c.id").alias("category_id"), F.col("c.name").alias("category")).distinct()
    boxes = files.select(F.explode("annotations").alias("a")).select("a.*").join(names, "category_id", "left")
    return images, boxes.select("id", "image_id", "category", *[F.col("bbox")[i].alias(c) for i, c in enumerate(("x", "y", "w", "h"))])


def read_truth_lists(spark: SparkSession, path: str) -> DataFrame:
    """(query, kind, item) of text files <query>_<good|ok|junk|query>.txt, an item a line."""
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    lines = spark.read.text(path).select(F.regexp_extract(name, "^(.*)_(good|ok|junk|query)\\.txt$", 1).alias("query"), F.regexp_extract(name, "^(.*)_(good|ok|junk|query)\\.txt$", 2).alias("kind"), F.element_at(F.split(F.trim("value"), " "), 1).alias("item"))
    return lines.where(F.col("item") != "")


def read_waypoints(spark: SparkSession, path: str) -> DataFrame:
    """(id, time, lat, lon) of patrol XML: elements waypoint with these attributes."""
    rows = spark.read.format("xml").option("rowTag", "waypoint").schema("_id STRING, _time STRING, _x DOUBLE, _y DOUBLE").load(path)
    return rows.select(F.col("_id").alias("id"), F.col("_time").alias("time"), F.col("_y").alias("lat"), F.col("_x").alias("lon"))


def read_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, content_id, length, parent, name): files of a tree with an id of their content and the folder they lie in."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    parts = F.split("path", "/")
    return files.select("path", F.sha2("content", 256).alias("content_id"), "length", F.element_at(parts, -2).alias("parent"), F.element_at(parts, -1).alias("name"))


def name_from_path(path: Column, patterns: list[str]) -> Column:
    """The first pattern's first group that matches a path; unknown spellings become ____."""
    found = [F.when(F.regexp_extract(path, p, 1) != "", F.regexp_extract(path, p, 1)) for p in patterns]
    return normal_name(F.coalesce(*found))


def normal_name(name: Column) -> Column:
    return F.when(name.isNull() | F.lower(F.trim(name)).isin("", "unknown", "unidentified", "none", "____"), "____").otherwise(F.trim(name))


def read_zip(files: DataFrame) -> DataFrame:
    """(archive, name, content) of zip files given as rows of binaryFile (path, content)."""

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import io
        import zipfile

        import pandas as pd

        for pdf in batches:
            for path, content in zip(pdf.path, pdf.content, strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for n in z.namelist():
                        if not n.endswith("/"):
                            yield pd.DataFrame({"archive": [path], "name": [n], "content": [z.read(n)]})

    return files.select("path", "content").mapInPandas(run, "archive string, name string, content binary")


def record_uuid(*parts: Column) -> Column:
    """A name-based id of columns, the same on every run."""
    h = F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.lit("a"), F.substring(h, 18, 3)), F.substring(h, 21, 12))


def query_results_json(rank: DataFrame, n: int) -> DataFrame:
    """(q_aid, json): each query's best n items."""
    top = rank.where(F.col("rank") <= n).groupBy("q_aid").agg(F.array_sort(F.collect_list(F.struct("rank", "d_nid", "score"))).alias("items"))
    return top.select("q_aid", F.to_json("items").alias("json"))
