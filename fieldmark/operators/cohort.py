"""Choosing cohorts: row filters from a configuration, group filters, sampling, splits.

Observations have aid, nid and, for the keys that use them, t, view, quality, species, tags, imgset. Where rows are grouped
by name, every unknown one is an individual of its own. Random choices go by a hash of id and seed, so they are the same
on every run and at every number of partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldmark.functions.keys import is_known, name_key, quality_ok, viewpoint_ok
from fieldmark.functions.tags import tag_predicate


def hash_order(key: Column, seed: int) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


#: Whom an observation shows: the key by which names are told apart.
WHO = "_who"


def told_apart(obs: DataFrame) -> DataFrame:
    """obs with WHO."""
    return obs.withColumn(WHO, name_key(F.col("aid"), F.col("nid")))


def filter_rows(obs: DataFrame, **cfg: Any) -> DataFrame:
    """The conjunction of the given keys; each looks at one row, but for *_pername_global, which count in obs as given.

    Keys: is_known, is_exemplar, reviewed, multiple, require_timestamp, require_gps, min_unixtime, max_unixtime, species
    ('primary' is the most frequent), minqual, require_quality, view, require_viewpoint, min_numfeat, max_numfeat,
    contributor_contains, min_pername_global, max_pername_global, tags (a dict for tag_predicate).
    """
    cfg = dict(cfg)
    out = obs
    if "min_pername_global" in cfg or "max_pername_global" in cfg:
        counts = told_apart(obs).groupBy(WHO).agg(F.count(F.lit(1)).alias("_n"))
        low, high = cfg.pop("min_pername_global", None), cfg.pop("max_pername_global", None)
        fit = F.lit(True)
        fit = fit & (F.col("_n") >= low) if low is not None else fit
        fit = fit & (F.col("_n") <= high) if high is not None else fit
        out = told_apart(out).join(counts.where(fit).select(WHO), WHO, "left_semi").drop(WHO)
    if cfg.get("species") == "primary":
        first = obs.groupBy("species").agg(F.count(F.lit(1)).alias("n"), F.min("aid").alias("first")).orderBy(F.desc("n"), "first").limit(1)
        cfg.pop("species")
        out = out.join(F.broadcast(first.select("species")), "species", "left_semi")
    tests: dict[str, Any] = {
        "is_known": lambda v: is_known(F.col("nid")) if v else F.lit(True),
        "is_exemplar": lambda v: F.col("exemplar") == v,
        "reviewed": lambda v: F.col("reviewed") == v,
        "multiple": lambda v: F.col("multiple") == v,
        "require_timestamp": lambda v: F.col("t").isNotNull() & (F.col("t") != -1) if v else F.lit(True),
        "require_gps": lambda v: F.col("lat").isNotNull() & F.col("lon").isNotNull() if v else F.lit(True),
        "min_unixtime": lambda v: F.col("t") >= v,
        "max_unixtime": lambda v: F.col("t") <= v,
        "species": lambda v: F.lit(True) if v in (None, "none") else F.col("species") == v,
        "minqual": lambda v: quality_ok(F.col("quality"), v, not cfg.get("require_quality", False)),
        "view": lambda v: viewpoint_ok(F.col("view"), v, not cfg.get("require_viewpoint", False)),
        "min_numfeat": lambda v: F.col("numfeat") >= v,
        "max_numfeat": lambda v: F.col("numfeat") <= v,
        "contributor_contains": lambda v: F.col("contributor").contains(v),
        "tags": lambda v: tag_predicate(F.col("tags"), **v),
    }
    for key, value in cfg.items():
        if key in ("require_quality", "require_viewpoint"):
            continue
        if key not in tests:
            raise ValueError(f"unknown filter key: {key}")
        out = out.where(tests[key](value))
    return out


def same_imageset(obs: DataFrame) -> DataFrame:
    """Per name the observations of the imageset that holds most of them; ties to the least imageset."""
    named = told_apart(obs)
    sizes = named.groupBy(WHO, "imgset").agg(F.count(F.lit(1)).alias("_n"))
    best = sizes.groupBy(WHO).agg(F.max_by("imgset", F.struct("_n", -F.col("imgset"))).alias("imgset"))
    return named.join(best, [WHO, "imgset"], "left_semi").drop(WHO)


def view_pername(obs: DataFrame, needs: dict[str, int]) -> DataFrame:
    """Names that have at least so many observations of each of these viewpoints."""
    named = told_apart(obs)
    counts = named.groupBy(WHO).agg(*[F.count_if(F.col("view") == v).alias(f"_v{i}") for i, v in enumerate(needs)])
    fit = F.lit(True)
    for i, n in enumerate(needs.values()):
        fit = fit & (F.col(f"_v{i}") >= n)
    return named.join(counts.where(fit).select(WHO), WHO, "left_semi").drop(WHO)


def min_timedelta(obs: DataFrame, least: int) -> DataFrame:
    """Per name a largest subset with gaps of at least `least` seconds: a scan in time order that keeps what is far enough.

    A name's rows stream through one task in order of time; nothing but the last kept time is held.
    """

    def scan(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        who, last = None, 0
        for b in batches:
            kept = []
            for w, t, aid in zip(*(b.column(c).to_pylist() for c in (WHO, "t", "aid")), strict=True):
                if w != who or t - last >= least:
                    who, last = w, t
                    kept.append(aid)
            yield pa.RecordBatch.from_pydict({"aid": pa.array(kept, pa.int64())})

    rows = told_apart(obs).where(F.col("t").isNotNull()).select(WHO, "t", F.col("aid").cast("long").alias("aid"))
    return obs.join(rows.repartition(WHO).sortWithinPartitions(WHO, "t", "aid").mapInArrow(scan, "aid long"), "aid", "left_semi")


def pername(obs: DataFrame, least: int | None = None, most: int | None = None) -> DataFrame:
    """Observations of names with so many of them."""
    return filter_rows(obs, **({"min_pername_global": least} if least is not None else {}), **({"max_pername_global": most} if most is not None else {}))


def intragroup(obs: DataFrame, *, imageset: bool = False, views: dict[str, int] | None = None, timedelta: int | None = None, least: int | None = None, most: int | None = None) -> DataFrame:
    """The group filters, in this order; the order matters."""
    out = same_imageset(obs) if imageset else obs
    out = view_pername(out, views) if views else out
    out = min_timedelta(out, timedelta) if timedelta is not None else out
    return pername(out, least, most) if least is not None or most is not None else out


def sample_per_name(obs: DataFrame, n: int, rule: str = "hash", offset: int = 0, seed: int = 0) -> DataFrame:
    """Per name n rows after the first offset, by rule: mintime, maxtime, hash, qual_and_view."""
    orders = {
        "mintime": [F.col("t").asc_nulls_last(), "aid"], "maxtime": [F.col("t").desc_nulls_last(), "aid"], "hash": [hash_order(F.col("aid"), seed), "aid"],
        "qual_and_view": [F.col("quality").desc_nulls_last(), F.col("view"), "aid"],
    }
    nth = F.row_number().over(W.partitionBy(WHO).orderBy(*orders[rule]))
    return told_apart(obs).withColumn("_nth", nth).where(F.col("_nth").between(offset + 1, offset + n)).drop("_nth", WHO)


def names_slice(obs: DataFrame, n: int, offset: int = 0) -> DataFrame:
    """Observations of n names, in order of id, after the first offset."""
    named = told_apart(obs)
    # The first of an order: Spark keeps so many rows of each task, and merges those.
    first = named.select(WHO).distinct().orderBy(WHO).limit(offset + n)
    names = first.orderBy(WHO).offset(offset).limit(n)
    return named.join(names, WHO, "left_semi").drop(WHO)


def nth_occurrence(obs: DataFrame, offset: int = 0) -> DataFrame:
    """Per name the observations of one imageset: the one at this place in order."""
    named = told_apart(obs)
    sets = named.select(WHO, "imgset").distinct().withColumn("_nth", F.row_number().over(W.partitionBy(WHO).orderBy("imgset"))).where(F.col("_nth") == offset + 1)
    return named.join(sets.select(WHO, "imgset"), [WHO, "imgset"], "left_semi").drop(WHO)


def _hash_places(groups: DataFrame, key: str, seed: int, size: str) -> DataFrame:
    """groups with _before: the sum of `size` over the groups before it in hash order; sums go by range of hashes first."""
    groups = groups.withColumn("_h", hash_order(F.col(key), seed)).withColumn("_range", F.substring("_h", 1, 4))
    sums = groups.groupBy("_range").agg(F.sum(size).alias("_in"))
    # At most 65,536 ranges, one row each.
    base = F.coalesce(F.sum("_in").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    within = F.coalesce(F.sum(size).over(W.partitionBy("_range").orderBy("_h", key).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = groups.withColumn("_within", within).join(sums.select("_range", base.alias("_base")), "_range")
    return placed.withColumn("_before", F.col("_base") + F.col("_within")).drop("_h", "_range", "_within", "_base")


def sample_whole_names(obs: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """Whole names in hash order while their rows sum to at most size; a prefix of that order."""
    named = told_apart(obs)
    sizes = _hash_places(named.groupBy(WHO).agg(F.count(F.lit(1)).alias("_n")), WHO, seed, "_n")
    return named.join(sizes.where(F.col("_before") + F.col("_n") <= size).select(WHO), WHO, "left_semi").drop(WHO)


def sample_wrt_reference(obs: DataFrame, ref: DataFrame, *, per_ref_name: int, per_name: int, seed: int = 0) -> DataFrame:
    """Candidates to match a reference set: its own rows and those of its names' imagesets go; then per name of the
    reference the rows farthest in time from it on average, and of other names rows in hash order."""
    seen = told_apart(ref)
    free = told_apart(obs).join(ref.select("aid"), "aid", "left_anti").join(seen.select(WHO, "imgset").distinct(), [WHO, "imgset"], "left_anti")
    own = free.join(seen.select(WHO, F.col("t").alias("_rt")), WHO).groupBy(*free.columns).agg(F.avg(F.abs(F.col("t") - F.col("_rt"))).alias("_d"))
    nth = F.row_number().over(W.partitionBy(WHO).orderBy(F.desc("_d"), "aid"))
    truth = own.withColumn("_nth", nth).where(F.col("_nth") <= per_ref_name).select(*obs.columns)
    others = sample_per_name(free.join(seen.select(WHO), WHO, "left_anti").drop(WHO), per_name, "hash", seed=seed)
    return truth.unionByName(others.select(*obs.columns))


def folds(obs: DataFrame, k: int, seed: int = 0, group: str | None = None) -> DataFrame:
    """obs with a fold: groups (names unless told otherwise) stay whole and are dealt in hash order."""
    by = group or WHO
    rows = obs if group else told_apart(obs)
    groups = _hash_places(rows.select(by).distinct().withColumn("_one", F.lit(1)), by, seed, "_one")
    dealt = rows.join(groups.select(by, (F.col("_before") % k).alias("fold")), by)
    return dealt if group else dealt.drop(WHO)


def stratified_folds(obs: DataFrame, k: int, label: str, group: str, seed: int = 0) -> DataFrame:
    """obs with a fold: groups stay whole and are dealt within the label that most of a group's rows have."""
    main = obs.groupBy(group, label).agg(F.count(F.lit(1)).alias("_n")).groupBy(group).agg(F.max(F.struct("_n", label)).alias("_m")).select(group, F.col(f"_m.{label}").alias("_label"))
    dealt = main.withColumn("fold", (F.row_number().over(W.partitionBy("_label").orderBy(hash_order(F.col(group), seed), group)) - 1) % k)
    return obs.join(dealt.select(group, "fold"), group)


def crossval(obs: DataFrame, *, queries: int, database: int, splits: int, seed: int = 0) -> DataFrame:
    """(split, role, aid, nid): names with enough rows give each split its own query and database rows; smaller names are
    confusors of every split, and so is each unknown observation, whose nid is minus its id."""
    obs = told_apart(obs).drop("nid").withColumnRenamed(WHO, "nid")
    nth = F.row_number().over(W.partitionBy("nid").orderBy(hash_order(F.col("aid"), seed), "aid")) - 1
    need = queries + database
    placed = obs.withColumn("_i", nth).withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("nid")))
    enough = placed.where((F.col("_n") >= need) & (F.col("_i") < need * splits)).withColumn("split", F.floor(F.col("_i") / need))
    # A split that a name fills in part only is left out.
    enough = enough.where((F.col("split") + 1) * need <= F.col("_n")).withColumn("role", F.when(F.col("_i") % need < queries, "query").otherwise("database"))
    small = placed.where(F.col("_n") < need).withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1)))).withColumn("role", F.lit("confusor"))
    cols = [F.col("split").cast("int").alias("split"), "role", "aid", "nid"]
    return enough.select(*cols).unionByName(small.select(*cols))


def train_test(obs: DataFrame, share: float, by: str, seed: int = 0) -> DataFrame:
    """obs with train: of each class the first share of its rows in hash order."""
    w = W.partitionBy(by).orderBy(hash_order(F.col("aid"), seed), "aid")
    return obs.withColumn("train", F.row_number().over(w) <= F.floor(F.count(F.lit(1)).over(W.partitionBy(by)) * share))


def expand_grid(text: str) -> list[dict[str, Any]]:
    """'name:key=val,key=[a,b]' -> the product of all lists, as dicts."""
    import itertools
    import re

    name, _, rest = text.partition(":")
    pairs = re.findall(r"(\w+)=(\[[^\]]*\]|[^,]*)", rest)

    def value(v: str) -> Any:
        v = v.strip()
        low = v.lower()
        if low in ("true", "false", "none"):
            return {"true": True, "false": False, "none": None}[low]
        for kind in (int, float):
            try:
                return kind(v)
            except ValueError:
                pass
        return v

    lists = [[value(x) for x in v[1:-1].split(",")] if v.startswith("[") else [value(v)] for _, v in pairs]
    return [{"_name": name, **dict(zip([k for k, _ in pairs], combo, strict=True))} for combo in itertools.product(*lists)]


def first_in_hash_order(obs: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n rows, or all if fewer, in hash order of aid; of a greater n, a smaller one takes the first."""
    places = _hash_places(obs.select("aid").withColumn("_one", F.lit(1)), "aid", seed, "_one")
    return obs.join(places.where(F.col("_before") < n).select("aid"), "aid", "left_semi")


def expand_consistently(obs: DataFrame, configs: list[dict[str, Any]], seed: int = 0) -> DataFrame:
    """(config, role, aid): the query and database cohorts of each configuration, of sizes that can be compared.

    A configuration has query and database (dicts for filter_rows), and may have query_size, database_size (no size: all),
    const_query, const_database (true unless told otherwise) and apart (true: its queries are not in its database).
    Where a size is to be constant, no cohort is larger than the smallest before it, so smaller configurations come
    first. Rows are taken in one hash order, so configurations with the same filter share their queries. A cohort
    may be empty; those after it with a constant size then are too.
    """
    if not configs:
        return obs.select(F.lit(0).alias("config"), F.lit("query").alias("role"), "aid").limit(0)
    out: list[DataFrame] = []
    least: dict[str, int | None] = {"query": None, "database": None}
    for i, cfg in enumerate(configs):
        chosen: dict[str, DataFrame] = {}
        for role in ("query", "database"):
            rows = filter_rows(obs, **cfg.get(role, {})).select("aid")
            if role == "database" and cfg.get("apart", True):
                rows = rows.join(chosen["query"], "aid", "left_anti")
            const = cfg.get(f"const_{role}", True)
            limits = [n for n in (cfg.get(f"{role}_size"), least[role] if const else None) if n is not None]
            there = rows.count()
            size = min([there, *limits])
            chosen[role] = first_in_hash_order(rows, size, seed) if size < there else rows
            least[role] = size if const and (least[role] is None or size < least[role]) else least[role]
            out.append(chosen[role].select(F.lit(i).alias("config"), F.lit(role).alias("role"), "aid"))
    first, *rest = out
    for rows in rest:
        first = first.unionByName(rows)
    return first
