"""Column expressions on identity, time, quality and viewpoint."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_known(nid: Column) -> Column:
    return F.coalesce(nid > 0, F.lit(False))


def name_key(aid: Column, nid: Column, distinguish: bool = True) -> Column:
    """The name's id; an unknown one's is minus the observation's id, or 0 where unknowns are not told apart."""
    return F.when(is_known(nid), nid).otherwise(-aid if distinguish else F.lit(0))


def corrected_time(t: Column, delta: Column) -> Column:
    """Time with its offset; a missing time (null or -1) stays missing."""
    return F.when(t.isNotNull() & (t != -1), t + F.coalesce(delta, F.lit(0)))


def quality_ok(quality: Column, least: int, unknown_ok: bool = True) -> Column:
    """Quality of at least `least`. Unknown is null or -1; if it is not accepted, -1 fails by comparison and null fails."""
    if unknown_ok:
        return quality.isNull() | (quality == -1) | (quality >= least)
    return F.coalesce(quality >= least, F.lit(False))


def viewpoint_ok(view: Column, valid: list[str] | None, unknown_ok: bool = True) -> Column:
    """Membership in valid; with None any viewpoint does. Unknown passes if accepted."""
    known = view.isNotNull()
    inside = known if valid is None else known & view.isin(*valid)
    return F.coalesce(inside, F.lit(False)) | ~known if unknown_ok else F.coalesce(inside, F.lit(False))


def match_truth(nid1: Column, nid2: Column) -> Column:
    """1 the same name, 0 different names, 2 if either is unknown."""
    return F.when(is_known(nid1) & is_known(nid2), (nid1 == nid2).cast("int")).otherwise(2)


def encounter_text(occurrence: Column, name: Column) -> Column:
    """occurrence_name, null if either is."""
    return F.concat(occurrence, F.lit("_"), name)


def rectified_decision(evidence: Column, meta: Column) -> Column:
    """Evidence that infers nothing gives way to the meta decision; codes: match 1, nomatch 0; meta: same 1, diff 0."""
    return F.when(evidence.isin(0, 1), evidence).when(meta == 1, 1).when(meta == 0, 0).otherwise(evidence)


def age_class(least: Column, most: Column) -> Column:
    """Age class of months; -1 counts as missing only where both are. Bins of a year up to three."""
    fits = lambda low, high: F.coalesce((least >= low) & (least < high) & (most >= low) & (most < high), F.lit(False))
    return (
        F.when((least.isNull() & most.isNull()) | ((least == -1) & (most == -1)), "UNREVIEWED").when((least.isNull() | (least < 12)) & (most < 12), "FOAL").when(fits(12, 24), "YEARLING").when(fits(24, 36), "2 YEARS")
        .when((least >= 36) & (most.isNull() | (most >= 36)), "3+ YEARS").otherwise("UNKNOWN")
    )


def percent_text(part: Column, whole: Column) -> Column:
    """A percentage with two places, or undef of nothing."""
    return F.coalesce(F.when(whole > 0, F.format_string("%06.2f %%", part * 100.0 / whole)), F.lit("undef"))


def duration_text(seconds: Column) -> Column:
    """d:hh:mm:ss; empty without a duration."""
    s = seconds.cast("long")
    text = F.format_string("%d:%02d:%02d:%02d", F.floor(s / 86400), F.floor(s / 3600) % 24, F.floor(s / 60) % 60, s % 60)
    return F.when(s.isNull() | (s < 0), "").otherwise(text)
