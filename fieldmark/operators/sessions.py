"""Sessions and occurrences: clusters in time and in time and space."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldmark.functions.geo import EARTH_KM, haversine_km, timespace_sec
from fieldmark.lineage import store
from fieldmark.operators.cohort import WHO, told_apart
from fieldmark.operators.graph import components


def gap_sessions(obs: DataFrame, gap: int, key: str | None = None) -> DataFrame:
    """obs with session, from 1 by key (the name unless told otherwise): a new one where the time since the last is over
    `gap` seconds. Each unknown observation is a session of its own."""
    rows = obs if key else told_apart(obs)
    w = W.partitionBy(key or WHO).orderBy("t", "aid")
    new = F.coalesce((F.col("t") - F.lag("t").over(w) > gap).cast("int"), F.lit(1))
    return rows.withColumn("_new", new).withColumn("session", F.sum("_new").over(w)).drop("_new", WHO)


def session_stats(sessions: DataFrame, key: str | None = None) -> DataFrame:
    """Per key (the name unless told otherwise, unknown ones by minus the observation's id) and session: n, start, end."""
    rows = sessions if key else told_apart(sessions).drop("nid").withColumnRenamed(WHO, "nid")
    return rows.groupBy(key or "nid", "session").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("start"), F.max("t").alias("end"))


def chunks_of_time(obs: DataFrame, gap: int) -> DataFrame:
    """obs with chunk: runs in time with no gap over `gap`, over all rows and without putting them all in one task.

    Times are cut into cells of `gap` seconds. A cell's rows are in one chunk, for none of its gaps is over `gap`; so only
    cells, one row each, are ordered, with their least and greatest times.
    """
    cells = obs.groupBy(F.floor(F.col("t") / gap).alias("_cell")).agg(F.min("t").alias("low"), F.max("t").alias("high"))
    # Cells follow each other in blocks; a block's chunks are counted apart, then blocks are added up.
    block = W.partitionBy("_block").orderBy("_cell")
    cells = cells.withColumn("_block", F.floor(F.col("_cell") / 4096)).withColumn("_last", F.lag("high").over(block))
    ends = cells.groupBy("_block").agg(F.min("low").alias("first_low"), F.max("high").alias("last_high"), F.sum(F.when(F.col("low") - F.col("_last") > gap, 1).otherwise(0)).alias("_breaks"))
    over = W.orderBy("_block")
    ends = ends.withColumn("_new", F.when(F.col("first_low") - F.lag("last_high").over(over) > gap, 1).otherwise(0))
    ends = ends.withColumn("_base", F.sum(F.col("_new")).over(over) + F.coalesce(F.sum("_breaks").over(over.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inner = F.sum(F.when(F.col("low") - F.col("_last") > gap, 1).otherwise(0)).over(block)
    numbered = cells.withColumn("_in", inner).join(ends.select("_block", "_base"), "_block").select("_cell", (F.col("_base") + F.col("_in")).alias("chunk"))
    return obs.withColumn("_cell", F.floor(F.col("t") / gap)).join(numbered, "_cell").drop("_cell")


def _placed(rows: DataFrame, seconds: float, km_per_sec: float) -> DataFrame:
    """rows with x, y, z in km on the sphere, wide cells (_w0 time, _w1.._w3 place) and narrow cells (_f0.._f3).

    Two rows within the threshold lie in the same or in neighbouring wide cells; two rows of a narrow cell are within it.
    """
    slack = 1 + 1e-9
    # The chord of an arc: half the threshold is left to a narrow cell's time, half to its diagonal in space.
    chord = lambda km: 2 * EARTH_KM * math.sin(min(km / (2 * EARTH_KM), math.pi / 2))
    wide, narrow = chord(seconds * km_per_sec) * slack, chord(seconds * km_per_sec / 2) / math.sqrt(3) / slack
    lat, lon = F.radians("lat"), F.radians("lon")
    at = rows.select("*", (F.cos(lat) * F.cos(lon) * EARTH_KM).alias("x"), (F.cos(lat) * F.sin(lon) * EARTH_KM).alias("y"), (F.sin(lat) * EARTH_KM).alias("z"))
    # Rows without time share a cell of time.
    t = F.coalesce(F.col("t").cast("double"), F.lit(0.0))
    cells = [F.floor(t / (seconds * slack)).alias("_w0"), *[F.floor(F.col(c) / wide).alias(f"_w{i}") for i, c in enumerate("xyz", 1)]]
    return at.select("*", *cells, F.floor(t / (seconds / 2 / slack)).alias("_f0"), *[F.floor(F.col(c) / narrow).alias(f"_f{i}") for i, c in enumerate("xyz", 1)])


WIDE, NARROW = [f"_w{i}" for i in range(4)], [f"_f{i}" for i in range(4)]


def _gap_sec(low: dict[str, Column], high: dict[str, Column], low2: dict[str, Column], high2: dict[str, Column], km_per_sec: float) -> Column:
    """No more than the distance in seconds of any two points of two boxes (t, x, y, z)."""
    gap = {c: F.greatest(low2[c] - high[c], low[c] - high2[c], F.lit(0.0)) for c in low}
    return F.coalesce(gap["t"].cast("double"), F.lit(0.0)) + F.sqrt(gap["x"] * gap["x"] + gap["y"] * gap["y"] + gap["z"] * gap["z"]) / km_per_sec


#: Wide cells along each side of a tile, and cells that are compared in one call.
TILE, BUCKET_CELLS = 4, 20000


def _tile_links(cells: DataFrame, seconds: float, km_per_sec: float) -> DataFrame:
    """(a, b, met) of cells within reach: met ones as links to the least of those that they lead to within a tile, others as
    pairs if their ends are still apart.

    A tile has the cells of TILE wide cells each way and of the next one, so any two neighbours lie in one tile together, and
    few cells in more than one. Geometry bounds its cells, which are compared in memory: pairs of cells are never stored.
    """
    import numpy as np

    of = lambda w: F.explode(F.array_distinct(F.array(F.floor(F.col(w) / TILE), F.floor((F.col(w) - 1) / TILE))))
    # Cells of one row need no bounds.
    wide = F.when(F.col("n") > 1, F.struct(*[F.coalesce(f"{n}_{c}", F.lit(0)).cast("double").alias(f"{n}_{c}") for n in ("low", "high") for c in ("t", "x", "y", "z")]))
    tiles = cells.select("kind", *WIDE, F.col("rep"), F.coalesce("at.t", F.lit(0)).cast("double").alias("t"), "at.lat", "at.lon", wide.alias("w"))
    for w in WIDE:
        tiles = tiles.withColumn(w, of(w))
    tiles = tiles.select(F.xxhash64("kind", *WIDE).alias("tile"), "kind", "rep", "t", "lat", "lon", "w.*")
    buckets = max(1, -(-cells.count() // BUCKET_CELLS))

    def linked(rep: Any, p: dict[str, Any], low: Any, high: Any) -> list[Any]:
        pairs = []
        for at in range(0, len(rep), 256):
            part = slice(at, at + 256)
            gap = [np.maximum(np.maximum(low[c][None] - high[c][part, None], low[c][part, None] - high[c][None]), 0.0) for c in range(4)]
            i, j = np.nonzero(gap[0] + np.sqrt(gap[1] ** 2 + gap[2] ** 2 + gap[3] ** 2) / km_per_sec <= seconds * (1 + 1e-9))
            pairs.append((i[i + at < j] + at, j[i + at < j]))
        i, j = (np.concatenate(side) for side in zip(*pairs, strict=True))
        h = np.sin((p["lat"][j] - p["lat"][i]) / 2) ** 2 + np.cos(p["lat"][i]) * np.cos(p["lat"][j]) * np.sin((p["lon"][j] - p["lon"][i]) / 2) ** 2
        met = 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(h, 1.0))) / km_per_sec + np.abs(p["t"][i] - p["t"][j]) <= seconds
        label, moved = np.arange(len(rep)), True
        while moved:
            x, y = label[i[met]], label[j[met]]
            new = label.copy()
            np.minimum.at(new, np.maximum(x, y), np.minimum(x, y))
            while (new[new] != new).any():
                new = new[new]
            label, moved = new, (new != label).any()
        own = np.nonzero(label != np.arange(len(rep)))[0]
        open_ = ~met & (label[i] != label[j])
        return [(rep[own], rep[label[own]], np.ones(len(own), bool)), (rep[i[open_]], rep[j[open_]], np.zeros(open_.sum(), bool))]

    def bucket(pdf: Any) -> Any:
        import pandas as pd

        pdf = pdf.sort_values(["kind", "tile", "rep"])
        rep, kind, tile = (pdf[c].to_numpy() for c in ("rep", "kind", "tile"))
        p = {"t": pdf["t"].to_numpy(), "lat": np.radians(pdf["lat"].to_numpy()), "lon": np.radians(pdf["lon"].to_numpy())}
        point = [p["t"], np.cos(p["lat"]) * np.cos(p["lon"]) * EARTH_KM, np.cos(p["lat"]) * np.sin(p["lon"]) * EARTH_KM, np.sin(p["lat"]) * EARTH_KM]
        low, high = ([np.where(np.isnan(b), q, b) for q, b in zip(point, (pdf[f"{n}_{c}"].to_numpy(dtype="float64") for c in "txyz"), strict=True)] for n in ("low", "high"))
        ends = np.concatenate(([0], np.nonzero((tile[1:] != tile[:-1]) | (kind[1:] != kind[:-1]))[0] + 1, [len(rep)]))
        out = [(rep[:0], rep[:0], np.zeros(0, bool))]
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            if b - a > 1:
                out += linked(rep[a:b], {c: v[a:b] for c, v in p.items()}, [v[a:b] for v in low], [v[a:b] for v in high])
        return pd.DataFrame(dict(zip(("a", "b", "met"), (np.concatenate(side) for side in zip(*out, strict=True)), strict=True)))

    return tiles.groupBy(F.pmod("tile", F.lit(buckets)).alias("bucket_")).applyInPandas(bucket, "a long, b long, met boolean")


def occurrences(obs: DataFrame, seconds: int, km_per_sec: float = 0.002) -> DataFrame:
    """(aid, occurrence): single-linkage clusters at a distance in seconds, space turned into time by a speed.

    Rows with both time and place, with one of them and with neither are clustered apart; those with neither stand alone.
    An occurrence is named by its least id. Rows with time only are runs without a gap over the threshold.

    Rows with a place are grouped by narrow cells of time and space, whose rows are all within the threshold. Only cells, one
    row each, are compared with those of neighbouring wide cells, of which geometry bounds the number however many rows a
    cell holds. Cells whose first rows are near are linked; where such links leave two near cells in different clusters, their
    rows within reach of the other's bounds are compared, so no link is lost.
    """
    both = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    kind = F.when(F.col("t").isNotNull() & both, 0).when(F.col("t").isNotNull(), 1).when(both, 2).otherwise(3)
    rows = obs.select("aid", "t", "lat", "lon", kind.alias("kind"))
    runs = chunks_of_time(rows.where("kind = 1"), seconds)
    timed = runs.join(runs.groupBy("chunk").agg(F.min("aid").alias("occurrence")), "chunk").select("aid", "occurrence")
    alone = rows.where("kind = 3").select("aid", F.col("aid").alias("occurrence"))
    key = ["kind", *NARROW]
    placed = store(_placed(rows.where("kind in (0, 2)"), seconds, km_per_sec), "placed")
    first = F.min_by(F.struct("t", "lat", "lon"), "aid")
    bounds = [f(c).alias(f"{n}_{c}") for c in ("t", "x", "y", "z") for f, n in ((F.min, "low"), (F.max, "high"))]
    cells = store(placed.groupBy(*key, *WIDE).agg(F.min("aid").alias("rep"), F.count(F.lit(1)).alias("n"), first.alias("at"), *bounds), "cells")
    # A narrow cell may be cut by walls of wide ones: its parts are linked by its least id.
    least = cells.withColumn("least", F.min("rep").over(W.partitionBy(*key)))
    parts = least.where("rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b"))
    sides = {side: {c: F.col(f"{side}_{c}") for c in ("t", "x", "y", "z")} for side in ("low", "high", "low2", "high2")}
    apart = lambda p, q: timespace_sec(haversine_km(p("lat"), p("lon"), q("lat"), q("lon")), F.abs(p("t") - q("t")), km_per_sec)
    pairs = store(_tile_links(cells, seconds, km_per_sec).distinct(), "cell-links")
    found = components(pairs.where("met").select("a", "b").unionByName(parts))
    comp = store(cells.select("rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("rep", F.coalesce("root", "rep").alias("comp")), "cell-clusters")
    open_ = pairs.where("not met").select(F.col("a").alias("rep"), F.col("b").alias("rep2")).join(comp, "rep").join(comp.select(F.col("rep").alias("rep2"), F.col("comp").alias("comp2")), "rep2").where("comp <> comp2")
    box = lambda i: cells.select(F.col("rep").alias(f"rep{i}"), *[F.col(f"{n}_{c}").alias(f"{n}{i}_{c}") for n in ("low", "high") for c in ("t", "x", "y", "z")])
    open_ = store(open_.join(box(""), "rep").join(box("2"), "rep2"), "open-cells")
    # Only rows in reach of the other cell's bounds are compared.
    members = placed.join(cells.select("kind", *NARROW, *WIDE, "rep"), [*key, *WIDE]).select("rep", "aid", "t", "lat", "lon", "x", "y", "z")
    point = {c: F.col(c) for c in ("t", "x", "y", "z")}
    reach = lambda low, high: _gap_sec(point, point, sides[low], sides[high], km_per_sec) <= seconds * (1 + 1e-9)
    of = lambda n: F.struct("t", "lat", "lon").alias(n)
    left = open_.join(members, "rep").where(reach("low2", "high2")).select("rep", "rep2", "comp", "comp2", of("p"))
    right = open_.select("rep", F.col("rep2"), "low_t", "low_x", "low_y", "low_z", "high_t", "high_x", "high_y", "high_z").join(members.withColumnRenamed("rep", "rep2"), "rep2").where(reach("low", "high")).select("rep", "rep2", of("q"))
    more = left.join(right, ["rep", "rep2"]).where(apart(lambda c: F.col(f"p.{c}"), lambda c: F.col(f"q.{c}")) <= seconds).select(F.col("comp").alias("a"), F.col("comp2").alias("b")).distinct()
    joined = components(more)
    root = comp.join(joined.withColumnRenamed("node", "comp"), "comp", "left").select("rep", F.coalesce("root", "comp").alias("occurrence"))
    return members.select("rep", "aid").join(root, "rep").select("aid", "occurrence").unionByName(timed).unionByName(alone)


def relabel_by_time(clusters: DataFrame, obs: DataFrame, least: int = 1) -> DataFrame:
    """(aid, label): clusters of at least so many rows, numbered from 0 by their mean time."""
    both = clusters.join(obs.select("aid", "t"), "aid")
    per = both.groupBy("occurrence").agg(F.avg("t").alias("_t"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    return both.join(per.withColumn("label", F.row_number().over(W.orderBy("_t", "occurrence")) - 1).select("occurrence", "label"), "occurrence").select("aid", "label")


def waypoint_ranges(rows: DataFrame, waypoints: DataFrame, cell: int = 64) -> DataFrame:
    """(waypoint, n, start, end): rows by position in [first, last) of a waypoint.

    Positions are cut into cells; a waypoint joins the rows of the cells that it touches by equality.
    """
    spans = waypoints.where(F.col("last") > F.col("first")).withColumn("_cell", F.explode(F.sequence(F.floor(F.col("first") / cell), F.floor((F.col("last") - 1) / cell))))
    met = rows.withColumn("_cell", F.floor(F.col("pos") / cell)).join(spans, "_cell").where((F.col("pos") >= F.col("first")) & (F.col("pos") < F.col("last")))
    return met.groupBy("waypoint").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("start"), F.max("t").alias("end"))


def positions(rows: DataFrame, by: str, cell: int = 4096) -> DataFrame:
    """rows with pos, from 0 in the order of a distinct whole number: counts by cell of the number first, then within cells."""
    placed = rows.withColumn("_cell", F.floor(F.col(by) / cell))
    counts = placed.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n")).withColumn("_block", F.floor(F.col("_cell") / cell))
    blocks = counts.groupBy("_block").agg(F.sum("_n").alias("_bn"))
    before = lambda n, w: F.coalesce(F.sum(n).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("_block", before("_bn", W.orderBy("_block")).alias("_base"))
    first = counts.join(blocks, "_block").select("_cell", (F.col("_base") + before("_n", W.partitionBy("_block").orderBy("_cell"))).alias("_first"))
    nth = F.row_number().over(W.partitionBy("_cell").orderBy(by)) - 1
    return placed.withColumn("_nth", nth).join(first, "_cell").withColumn("pos", F.col("_first") + F.col("_nth")).drop("_cell", "_nth", "_first")
