"""Helpers shared by the corpus operators: words, batches, folds; tables and lineage come from the library."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.lineage import discard, free_shuffles, fresh_path, release, shared_dir, store
from fieldmark.sources.tables import table

__all__ = ["discard", "free_shuffles", "fresh_path", "release", "shared_dir", "store", "table"]

#: A word is a run of anything but space, tab, LF, VT, FF and CR.
WORD = "[^\\x20\\x09-\\x0D]+"
GAP = "[\\x20\\x09-\\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
_WORD = re.compile(WORD)
#: str.split() splits on more than WORD does; these are the code points that differ.
_ODD_SPACES = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def fold(text: str) -> str:
    """Lower-case A-Z only."""
    return text.encode().lower().decode()


def words_of(text: str) -> list[str]:
    """The words of WORD in a Python string."""
    return _WORD.findall(text) if _ODD_SPACES.search(text) else text.split()


def word_count(text: Column) -> Column:
    """Number of words; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Let Arrow batches hold fewer rows than usual, for whole texts are long; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def texts_of(batch: Any, column: str, rows: int = 500) -> Iterator[tuple[Any, list[str | None]]]:
    """Slices of an Arrow batch with their texts, so that few are held as strings at once."""
    for at in range(0, len(batch), rows):
        part = batch.slice(at, rows)
        yield part, part.column(column).to_pylist()


def held_out(doc_id: Column, folds: int, fold_no: int) -> Column:
    """Whether crc32 of the id's text falls in the held-out fold. A null id counts as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds) == fold_no


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that clashes with none of df's."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = "_" + name
    return name


def quoted(name: str) -> str:
    """A column's name as it is, dots and all."""
    return "`" + name.replace("`", "``") + "`"
