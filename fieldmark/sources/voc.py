"""VOC-style XML as a sink: archives of one file an image, and the lists of the sets that images are in."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.operators.records import rotated_corners
from fieldmark.operators.sessions import positions
from fieldmark.sources.coco import CocoSource, CocoWriter, Staged


class VocWriter(CocoWriter):
    """Rows are (part, name, xml), in order of part: a tar archive for each part. Staging and commit are those of the COCO sink."""

    KIND, ENDING = "voc", "tar"

    def write(self, iterator: Iterator[Any]) -> Staged:
        import io
        import tarfile
        from itertools import groupby

        fs, root = self._fs()
        stage, files = f"{root}/_temporary-{self.job}", []
        fs.create_dir(stage, recursive=True)
        for part, rows in groupby(iterator, key=lambda r: r["part"]):
            own = f"{stage}/{uuid.uuid4().hex}.tar"
            with fs.open_output_stream(own) as out, tarfile.open(fileobj=out, mode="w|") as tar:
                for r in rows:
                    data = r["xml"].encode()
                    info = tarfile.TarInfo(f"Annotations/{r['name']}.xml")
                    info.size = len(data)
                    tar.addfile(info, io.BytesIO(data))
            files.append((own, f"{root}/voc-{part:08d}.tar" if self.overwrite else f"{root}/voc-{part:08d}-{self.job}.tar"))
        return Staged(files)


class VocSource(CocoSource):
    """Format fieldmark_voc: write only."""

    @classmethod
    def name(cls) -> str:
        return "fieldmark_voc"

    def writer(self, schema: Any, overwrite: bool) -> VocWriter:
        return VocWriter(self.options["path"], overwrite)


def _escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def _tag(name: str, *inside: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), *[F.coalesce(c.cast("string"), F.lit("")) for c in inside], F.lit(f"</{name}>"))


def scaled(width: Column, height: Column, target: int) -> tuple[Column, Column, Column]:
    """Width, height and factor of an image whose longer side becomes target; the other one is cut to a whole number."""
    wide = width > height
    factor = F.when(wide, F.lit(float(target)) / width).otherwise(F.lit(float(target)) / height)
    w = F.when(wide, F.lit(target).cast("long")).otherwise((F.lit(target) * (width / height)).cast("long"))
    h = F.when(wide, (F.lit(target) * (height / width)).cast("long")).otherwise(F.lit(target).cast("long"))
    return w, h, factor


def voc_boxes(images: DataFrame, boxes: DataFrame, target: int) -> DataFrame:
    """(image_id, id, category, view, xmin, ymin, xmax, ymax): the upright hulls of turned boxes, corners rounded to whole
    numbers (halves to the even one), scaled with their image, cut towards 0 and kept inside of it."""
    w, h, factor = scaled(F.col("_w"), F.col("_h"), target)
    sized = images.select(F.col("id").alias("image_id"), F.col("width").cast("double").alias("_w"), F.col("height").cast("double").alias("_h"))
    sized = sized.select("image_id", w.alias("_w"), h.alias("_h"), factor.alias("_f"))
    d = lambda c: F.col(c).cast("double")
    rows = boxes.withColumn("_c", rotated_corners(d("x"), d("y"), d("w"), d("h"), F.coalesce(d("theta"), F.lit(0.0)))).join(sized, "image_id")
    whole = lambda axis: F.transform("_c", lambda p: F.rint(p[axis]))
    low = lambda axis: F.greatest((F.array_min(whole(axis)) * F.col("_f")).cast("long"), F.lit(0))
    high = lambda axis, size: F.least((F.array_max(whole(axis)) * F.col("_f")).cast("long"), F.col(size) - 1)
    return rows.select("image_id", "id", F.coalesce("category", F.lit("")).alias("category"), "view", low("x").alias("xmin"), low("y").alias("ymin"), high("x", "_w").alias("xmax"), high("y", "_h").alias("ymax"))


def split_sets(images: DataFrame, train: float = 0.75, seed: int = 0) -> DataFrame:
    """(id, set): test images stay test; of the others this share, by a hash of their ids, is train and the rest val."""
    share = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("double") / float(2**32)
    return images.select("id", F.when(F.col("subset") == "test", "test").when(share < train, "train").otherwise("val").alias("set"))


def write_voc(
    images: DataFrame, boxes: DataFrame, path: str, *, year: int, species: list[str] | None = None, mapping: dict[str, str] | None = None, target: int = 900, offset: int = 1, per_file: int = 10000, train: float = 0.75, seed: int = 0, mode: str = "overwrite",
) -> None:
    """images (id, file_name, width, height, subset) and boxes (id, image_id, category, view, x, y, w, h, theta).

    path/Annotations gets archives of per_file images, each image an XML file named by year and its number from offset in the
    order of ids; path/ImageSets/Main/<train|val|trainval|test> are texts with these names. Categories are renamed by mapping,
    then those not in species are left out. Boxes of images that are not there are left out, images without boxes stay. A
    null category is '', a view of null or -1 is left out, theta null is 0. Ids are distinct whole numbers, sizes positive.
    path is a URI that driver and executors share; a task holds one image at a time.
    """
    spark = images.sparkSession
    spark.dataSource.register(VocSource)
    w, h, _ = scaled(F.col("width").cast("double"), F.col("height").cast("double"), target)
    placed = positions(images.select("id", "file_name", "subset", w.alias("width"), h.alias("height")), "id")
    placed = placed.withColumn("name", F.format_string(f"{year}_%06d", F.col("pos") + offset))
    named = boxes
    if mapping:
        named = named.withColumn("category", F.coalesce(F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])[F.col("category")], F.col("category")))
    if species is not None:
        named = named.where(F.col("category").isin(*species))
    box = voc_boxes(images, named, target)
    view = F.col("view").cast("string")
    pose = F.when(view.isNotNull() & (view != "-1"), _tag("pose", _escaped(view))).otherwise(F.lit(""))
    obj = _tag("object", _tag("name", _escaped(F.col("category"))), pose, _tag("bndbox", *[_tag(c, F.col(c)) for c in ("xmin", "ymin", "xmax", "ymax")]))
    per = box.select(F.col("image_id").alias("id"), F.struct(F.col("id").alias("i"), obj.alias("xml")).alias("o")).groupBy("id").agg(F.array_sort(F.collect_list("o")).alias("o"))
    objects = F.array_join(F.transform(F.coalesce("o", F.array().cast("array<struct<i:bigint,xml:string>>")), lambda o: o["xml"]), "")
    size = _tag("size", _tag("width", F.col("width")), _tag("height", F.col("height")), F.lit("<depth>3</depth>"))
    source = _tag("source", _tag("image", _escaped(F.col("file_name"))))
    xml = _tag("annotation", F.lit(f"<folder>VOC{year}</folder>"), _tag("filename", F.col("name"), F.lit(".jpg")), source, size, objects)
    rows = placed.join(per, "id", "left").select(F.floor(F.col("pos") / per_file).alias("part"), "name", xml.alias("xml"))
    rows.repartition("part").sortWithinPartitions("part", "name").write.format("fieldmark_voc").mode(mode).save(f"{path}/Annotations")
    sets = placed.join(split_sets(placed, train, seed), "id").select("name", "set")
    for of, members in (("train", ["train"]), ("val", ["val"]), ("trainval", ["train", "val"]), ("test", ["test"])):
        sets.where(F.col("set").isin(*members)).sort("name").select("name").write.mode(mode).text(f"{path}/ImageSets/Main/{of}")


VOC = "name STRING, file_name STRING, width BIGINT, height BIGINT, boxes ARRAY<STRUCT<category: STRING, view: STRING, xmin: BIGINT, ymin: BIGINT, xmax: BIGINT, ymax: BIGINT>>"


def read_voc(spark: SparkSession, path: str) -> DataFrame:
    """A row an image of write_voc's archives, its boxes in order."""

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import io
        import tarfile
        from xml.etree import ElementTree

        import pandas as pd

        for batch in batches:
            for content in batch["content"]:
                rows = []
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for member in tar:
                        root = ElementTree.fromstring(tar.extractfile(member).read())
                        boxes = [{"category": o.findtext("name"), "view": o.findtext("pose"), **{c: int(o.findtext(f"bndbox/{c}")) for c in ("xmin", "ymin", "xmax", "ymax")}} for o in root.iter("object")]
                        rows.append((member.name.rsplit("/", 1)[1].removesuffix(".xml"), root.findtext("source/image"), int(root.findtext("size/width")), int(root.findtext("size/height")), boxes))
                yield pd.DataFrame(rows, columns=["name", "file_name", "width", "height", "boxes"])

    return spark.read.format("binaryFile").load(f"{path}/Annotations/voc-*.tar").select("content").mapInPandas(run, VOC)
