"""Whole stores: merging one into another with ids remapped along references, and the part of a store that a set of rows needs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.lineage import store
from fieldmark.operators.sessions import positions


@dataclass(frozen=True)
class Link:
    """How a table's rows are known: id (None where nothing points to them), natural key, and the table that a column points to.

    undirected names two columns whose order does not tell rows apart.
    """

    id: str | None
    key: tuple[str, ...]
    refs: dict[str, str] = field(default_factory=dict)
    undirected: tuple[str, str] | None = None


#: The tables of fieldmark.schema, each after those that it points to.
LINKS: dict[str, Link] = {
    "contributors": Link("contributor_id", ("tag",)),
    "species": Link("species_id", ("species_text",)),
    "names": Link("nid", ("name_text",)),
    "imagesets": Link("imgsetid", ("text",)),
    "annotgroups": Link("group_id", ("text",)),
    "images": Link("gid", ("image_uuid",), {"contributor_id": "contributors"}),
    "annots": Link("aid", ("annot_uuid",), {"gid": "images", "nid": "names", "species_id": "species"}),
    "parts": Link("part_id", ("part_uuid",), {"aid": "annots"}),
    "annotmatch": Link("am_id", ("aid1", "aid2"), {"aid1": "annots", "aid2": "annots"}, ("aid1", "aid2")),
    "reviews": Link("review_id", ("aid1", "aid2", "review_count"), {"aid1": "annots", "aid2": "annots"}, ("aid1", "aid2")),
    "imageset_images": Link(None, ("imgsetid", "gid"), {"imgsetid": "imagesets", "gid": "images"}),
    "annotgroup_annots": Link(None, ("group_id", "aid"), {"group_id": "annotgroups", "aid": "annots"}),
    "metadata": Link(None, ("key",)),
}


def _keyed(df: DataFrame, link: Link) -> tuple[DataFrame, list[str]]:
    """df with _k0, _k1, ..: its natural key, both ways of an undirected pair alike."""
    turned = {}
    if link.undirected:
        a, b = link.undirected
        swap = F.col(a) > F.col(b)
        turned = {a: F.when(swap, F.col(b)).otherwise(F.col(a)), b: F.when(swap, F.col(a)).otherwise(F.col(b))}
    keys = [f"_k{i}" for i in range(len(link.key))]
    return df.withColumns({k: turned.get(c, F.col(c)) for k, c in zip(keys, link.key, strict=True)}), keys


def _remapped(df: DataFrame, refs: dict[str, str], maps: dict[str, DataFrame]) -> DataFrame:
    """References as ids of the merged store; one that points to no row becomes null. Non-positive ids stay as they are, since
    they stand for what is unknown."""
    for column, parent in refs.items():
        if column in df.columns:
            known = F.when(F.col(column) <= 0, F.col(column))
            if parent in maps:
                new = maps[parent].select(F.col("old").alias(column), F.col("new").alias("_to"))
                df = df.join(new, column, "left").withColumn(column, known.otherwise(F.col("_to"))).drop("_to")
            else:
                df = df.withColumn(column, known)
    return df


def merge_stores(into: dict[str, DataFrame], other: dict[str, DataFrame], links: dict[str, Link] = LINKS) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """(tables, maps): `into` with the rows of `other` that it lacks by natural key; maps (old, new, added) tell by table
    which id a row of `other` has now.

    Tables go in the order of links, so that references are remapped before keys that hold them are compared. Rows of `into`
    stay as they are. New rows get ids after the greatest of `into`, in the order of their old ones. Rows of `other` with one
    natural key become one, the one of the least id; a null in the key equals nothing, so such rows all come in. Ids are
    distinct; rows of a table with ids that have none are left out. Of rows without ids one of each key is taken, the least
    in order of all columns. A table that one side lacks counts as empty; extra columns of `other` are left out, those that it
    lacks are null.
    """
    out, maps = dict(into), {}
    for name, link in links.items():
        if name not in other:
            continue
        if name not in into:
            into = into | {name: other[name].limit(0)}
        mine, columns = into[name], into[name].columns
        rows, keys = _keyed(_remapped(other[name], link.refs, maps), link)
        own, _ = _keyed(mine, link)
        if link.id is None:
            fresh = rows.join(own.select(*keys).distinct(), keys, "left_anti")
            lone = F.lit(False)
            for k in keys:
                lone = lone | F.col(k).isNull()
            whole = F.struct(*[c for c in fresh.columns if c not in keys])
            once = fresh.where(~lone).groupBy(*keys).agg(F.min(whole).alias("_row")).select("_row.*")
            new = once.unionByName(fresh.where(lone).select(*once.columns))
        else:
            rows = rows.where(F.col(link.id).isNotNull())
            have = own.groupBy(*keys).agg(F.min(link.id).alias("_have"))
            first = rows.groupBy(*keys).agg(F.min(link.id).alias("_least"))
            # A null key meets nothing in a join, so that each such row leads itself.
            met = store(rows.join(have, keys, "left").join(first, keys, "left").withColumn("_lead", F.coalesce("_least", F.col(link.id))).drop("_least"), f"merge-{name}")
            leaders = met.where(F.col("_have").isNull() & (F.col("_lead") == F.col(link.id)))
            top = mine.agg(F.coalesce(F.max(link.id), F.lit(0)).alias("_top"))
            placed = positions(leaders, link.id).crossJoin(F.broadcast(top)).withColumn("_new", F.col("_top") + F.col("pos") + 1)
            placed = store(placed, f"merge-new-{name}")
            to = met.select(F.col(link.id).alias("old"), "_have", F.col("_lead")).join(placed.select(F.col(link.id).alias("_lead"), "_new"), "_lead", "left")
            maps[name] = to.select("old", F.coalesce("_have", "_new").alias("new"), (F.col("_have").isNull() & (F.col("old") == F.col("_lead"))).alias("added"))
            new = placed.withColumn(link.id, F.col("_new"))
        types = {f.name: f.dataType for f in mine.schema.fields}
        out[name] = mine.unionByName(new.select(*[F.col(c).cast(types[c]).alias(c) if c in new.columns else F.lit(None).cast(types[c]).alias(c) for c in columns]))
    return out, maps


def store_part(tables: dict[str, DataFrame], start: str, ids: DataFrame) -> dict[str, DataFrame]:
    """The part of a store that these annots, images or names (ids holds the id column of table `start`) need.

    With names or images come their annots; with annots their images, names and species, and with images their contributors and
    the imagesets and memberships that they are in; groups likewise by annots. Pairs stay where both sides do, parts with their
    annots. Ids that are not there are ignored; tables that the store lacks are left out.
    """
    out: dict[str, DataFrame] = {}
    semi = lambda name, keys, column: tables[name].join(keys, column, "left_semi").select(*tables[name].columns)
    own = LINKS[start].id
    ids = ids.select(own)
    out["annots"] = semi("annots", ids, own)
    for column, parent in LINKS["annots"].refs.items():
        if parent in tables:
            keys = out["annots"].select(column)
            out[parent] = semi(parent, keys.union(ids) if parent == start else keys, column)
    if "contributors" in tables and "images" in out:
        out["contributors"] = semi("contributors", out["images"].select("contributor_id"), "contributor_id")
    for member, column, of, group in (("imageset_images", "gid", "images", "imagesets"), ("annotgroup_annots", "aid", "annots", "annotgroups")):
        if member in tables and of in out:
            out[member] = semi(member, out[of].select(column), column)
            if group in tables:
                key = LINKS[group].id
                out[group] = semi(group, out[member].select(key), key)
    aids = out["annots"].select("aid")
    if "parts" in tables:
        out["parts"] = semi("parts", aids, "aid")
    for pairs in ("annotmatch", "reviews"):
        if pairs in tables:
            one = semi(pairs, aids.withColumnRenamed("aid", "aid1"), "aid1")
            out[pairs] = one.join(aids.withColumnRenamed("aid", "aid2"), "aid2", "left_semi").select(*tables[pairs].columns)
    if "metadata" in tables:
        out["metadata"] = tables["metadata"]
    return out
