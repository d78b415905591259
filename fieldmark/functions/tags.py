"""Tags: parsing, tidying, and predicates on lower-cased sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_tags(text: Column, mark: str = ";") -> Column:
    """Trimmed tags of a marked text, blanks left out; null gives none."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), mark), lambda t: F.trim(t))
    return F.filter(parts, lambda t: t != "")


def lowered(tags: Column) -> Column:
    return F.array_distinct(F.transform(F.coalesce(tags, F.array().cast("array<string>")), F.lower))


def tag_predicate(
    tags: Column, *, has_any: list[str] | None = None, has_all: list[str] | None = None, has_none: list[str] | None = None, min_num: int | None = None, max_num: int | None = None, any_startswith: str | None = None, any_endswith: str | None = None, any_match: str | None = None,
    none_match: str | None = None, logic: str = "and",
) -> Column:
    """The rules that are given, joined by and (true without rules) or by or (false without rules)."""
    own = lowered(tags)
    wanted = lambda xs: F.array(*[F.lit(x.lower()) for x in xs])
    rules = []
    if min_num is not None:
        rules.append(F.size(own) >= min_num)
    if max_num is not None:
        rules.append(F.size(own) <= max_num)
    if has_any:
        rules.append(F.arrays_overlap(own, wanted(has_any)))
    if has_all:
        rules.append(F.size(F.array_except(wanted(has_all), own)) == 0)
    if has_none:
        rules.append(~F.arrays_overlap(own, wanted(has_none)))
    if any_startswith is not None:
        rules.append(F.exists(own, lambda t: t.startswith(any_startswith)))
    if any_endswith is not None:
        rules.append(F.exists(own, lambda t: t.endswith(any_endswith)))
    if any_match is not None:
        rules.append(F.exists(own, lambda t: t.rlike(any_match)))
    if none_match is not None:
        rules.append(~F.exists(own, lambda t: t.rlike(none_match)))
    out = F.lit(logic == "and")
    for r in rules:
        out = out & r if logic == "and" else out | r
    return out


def consolidate(tags: Column, drop: list[str], rename: dict[str, str]) -> Column:
    """Tags without those to drop, renamed, each once in first place, capitalised."""
    kept = F.filter(tags, lambda t: ~t.isin(*drop)) if drop else tags

    def named(t: Column) -> Column:
        out = F.when(F.lit(False), t)
        for a, b in rename.items():
            out = out.when(t == a, b)
        return out.otherwise(t)

    return F.array_distinct(F.transform(F.transform(kept, named), lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 1000))))
