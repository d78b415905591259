"""COCO-style JSON as a sink: one folder of files, each complete with its images, annotations and categories."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from fieldmark.operators.sessions import positions


@dataclass
class Staged(WriterCommitMessage):
    """What a task's attempt has written: names of its own below the staging folder, and the names that they get."""

    files: list[tuple[str, str]]


class CocoWriter(DataSourceWriter):
    """Rows are (part, image, boxes), in order of part. Each attempt writes files of its own names; only those of the attempts
    that Spark commits are moved to their place, and what is left of others goes with the staging folder."""

    KIND, ENDING = "coco", "json"

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def _fs(self) -> tuple[Any, str]:
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[Any]) -> Staged:
        from itertools import groupby

        fs, root = self._fs()
        stage, files = f"{root}/_temporary-{self.job}", []
        fs.create_dir(stage, recursive=True)
        for part, rows in groupby(iterator, key=lambda r: r["part"]):
            images, boxes, names = [], [], {}
            for r in rows:
                images.append(json.loads(r["image"]))
                for box in json.loads(r["boxes"]):
                    names[box["category_id"]] = box.pop("category")
                    boxes.append(box)
            own = f"{stage}/{uuid.uuid4().hex}.json"
            with fs.open_output_stream(own) as out:
                out.write(json.dumps({"images": images, "annotations": boxes, "categories": [{"id": i, "name": n} for i, n in sorted(names.items())]}, ensure_ascii=False).encode())
            files.append((own, f"{root}/coco-{part:08d}.json" if self.overwrite else f"{root}/coco-{part:08d}-{self.job}.json"))
        return Staged(files)

    def commit(self, messages: list[Staged | None]) -> None:
        from pyarrow.fs import FileSelector

        fs, root = self._fs()
        if self.overwrite:
            for f in fs.get_file_info(FileSelector(root, allow_not_found=True)):
                if f.base_name.startswith(f"{self.KIND}-") and f.extension == self.ENDING:
                    fs.delete_file(f.path)
        for m in messages:
            for own, to in m.files if m else []:
                fs.move(own, to)
        self._clear(fs, root)

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear(*self._fs())

    def _clear(self, fs: Any, root: str) -> None:
        from pyarrow.fs import FileSelector

        stage = f"{root}/_temporary-{self.job}"
        if fs.get_file_info(FileSelector(stage, allow_not_found=True)) or fs.get_file_info(stage).type.name == "Directory":
            fs.delete_dir(stage)


class CocoSource(DataSource):
    """Format fieldmark_coco: write only."""

    @classmethod
    def name(cls) -> str:
        return "fieldmark_coco"

    def writer(self, schema: Any, overwrite: bool) -> CocoWriter:
        return CocoWriter(self.options["path"], overwrite)


def write_coco(images: DataFrame, boxes: DataFrame, path: str, *, per_file: int = 10000, mode: str = "overwrite") -> None:
    """images (id, file_name, width, height) and boxes (id, image_id, category, x, y, w, h) as files of `per_file` images each.

    path is a URI that driver and executors share. Ids become whole numbers from 0 in their order, categories from 0 by name,
    and boxes follow their images and categories. Boxes whose image is not there are left out; images without boxes stay; a
    null category is ''. Ids are distinct. An empty table of images writes no file, and on overwrite leaves none.
    A task holds one file's rows at a time, nothing passes through the driver.
    """
    spark = images.sparkSession
    spark.dataSource.register(CocoSource)
    placed = positions(images.select("id", "file_name", "width", "height"), "id").withColumnRenamed("pos", "image_id")
    named = boxes.select("id", F.col("image_id").alias("_image"), F.coalesce("category", F.lit("")).alias("category"), *[F.col(c).cast("double").alias(c) for c in "xywh"])
    named = named.join(placed.select(F.col("id").alias("_image"), "image_id"), "_image")
    # One row a category.
    kinds = named.select("category").distinct().withColumn("category_id", F.row_number().over(W.orderBy("category")) - 1)
    box = positions(named, "id").join(kinds, "category").select("image_id", F.struct(F.col("pos").alias("id"), "image_id", "category_id", "category", F.array(*"xywh").alias("bbox")).alias("box"))
    per = box.groupBy("image_id").agg(F.to_json(F.sort_array(F.collect_list("box"))).alias("boxes"))
    image = F.to_json(F.struct(F.col("image_id").alias("id"), "file_name", "width", "height"))
    rows = placed.select("image_id", image.alias("image")).join(per, "image_id", "left")
    rows = rows.select(F.floor(F.col("image_id") / per_file).alias("part"), "image_id", "image", F.coalesce("boxes", F.lit("[]")).alias("boxes"))
    rows.repartition("part").sortWithinPartitions("part", "image_id").drop("image_id").write.format("fieldmark_coco").mode(mode).save(path)
