"""Language identification by rank-order profiles.

A profile is a list of the most frequent n-grams (runs of one to three letters of a word, its ends counting as a letter), most
frequent first. Each language's comes from all its training texts; a document's from its whole text. Their distance is
how far the document's n-grams are out of place, PROFILE for one that the language's list lacks; the nearest language is
the prediction, and 1 less the distance's part of the largest possible one is its score.

Scale: training sums n-grams within tasks before they are shuffled, then keeps PROFILE rows for each language; that list
(PROFILE times the number of languages) is all that travels through the driver. Scoring is one scan without a shuffle,
n-grams of a batch being counted by one sort.

Edge cases: a text that is null, empty or without a letter is `und`, score 0, and so is every text when nothing was
learned; a null language teaches nothing; repeated rows count as often as they stand; ties between n-grams go to the
smaller code points, between languages to the smaller name; a character whose lower case is several is taken as it is;
long texts are counted whole; an empty table gives an empty result. Columns of docs that are named like the results stay,
the results' names get underscores.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldmark.llm._base import fresh_name, held_out, quoted, small_batches, table

#: N-grams in a profile.
PROFILE = 400
BATCH_CHARS = 1_000_000
HELD_ROWS = 1_000_000
_PART = 21
_EDGE = 1


def _letters(cps: np.ndarray) -> np.ndarray:
    """Lower-case code points of letters, _EDGE for all else."""
    found = np.flatnonzero(np.bincount(cps))
    of = np.full(int(found[-1]) + 1 if len(found) else 1, _EDGE, dtype=np.int64)
    for c in found.tolist():
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            of[c] = ord(low) if len(low) == 1 else c
    return of[cps]


def gram_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, n-gram, count), by document and then n-gram. An n-gram is its code points in _PART bits each, 0 where it is shorter than three."""
    size = np.array([len(t or "") + 1 for t in texts], dtype=np.int64)
    cps = np.frombuffer("".join(f"{t or ''}\n" for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    of = _letters(cps) if len(cps) else np.empty(0, dtype=np.int64)
    known = np.unique(np.append(of, _EDGE))
    # 0: nothing, 1: an end of a word, from 2 on: letters in order.
    x = np.concatenate([[1], np.searchsorted(known, of) + 1])
    doc = np.concatenate([[0], np.repeat(np.arange(len(texts)), size)])
    base = len(known) + 1
    if len(texts) * float(base) ** 3 > 2**62:
        half = len(texts) // 2
        if not half:
            raise ValueError("one text has over two million different letters")
        a, b = gram_counts(texts[:half]), gram_counts(texts[half:])
        return np.concatenate([a[0], b[0] + half]), np.concatenate([a[1], b[1]]), np.concatenate([a[2], b[2]])
    one = x > 1
    two = one[1:] | one[:-1]
    keys = [doc[one] * base**3 + x[one], (doc[1:] * base**3 + x[:-1] * base + x[1:])[two], (doc[1:-1] * base**3 + (x[:-2] * base + x[1:-1]) * base + x[2:])[one[1:-1]]]
    every = np.sort(np.concatenate(keys))
    head = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.empty(0, dtype=np.int64)
    count = np.diff(np.append(head, len(every)))
    key = every[head]
    of_id = np.concatenate([[0], known])
    code = (of_id[key // base**2 % base] << 2 * _PART) | (of_id[key // base % base] << _PART) | of_id[key % base]
    return key // base**3, code, count


def top_grams(doc: np.ndarray, code: np.ndarray, count: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, n-gram, rank from 0) of each document's `most` most frequent n-grams."""
    order = np.lexsort((code, -count, doc))
    doc, code = doc[order], code[order]
    rank = np.arange(len(doc)) - np.searchsorted(doc, doc)
    kept = rank < most
    return doc[kept], code[kept], rank[kept]


def _slices(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of about BATCH_CHARS each."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t or "") + 1
        if size >= BATCH_CHARS:
            yield at, texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield at, texts[at:]


def _summed(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of equal (number, n-gram) added up."""
    number, code, count = (np.concatenate(x) for x in zip(*rows, strict=True))
    order = np.lexsort((code, number))
    number, code, count = number[order], code[order], count[order]
    head = np.flatnonzero(np.concatenate([[True], (number[1:] != number[:-1]) | (code[1:] != code[:-1])])) if len(code) else np.empty(0, dtype=np.int64)
    return number[head], code[head], np.add.reduceat(count, head) if len(head) else count


def learn(docs: DataFrame, *, text: str = "text", lang: str = "lang", most: int = PROFILE) -> DataFrame:
    """lang, gram, rank from 0: the profile of each language of docs."""

    def counts(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        names: list[str] = []
        number: dict[str, int] = {}
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rows = 0

        def give() -> Any:
            n, code, count = held[0]
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(n)), pa.array(code), pa.array(count)], names=["lang", "gram", "count"])

        for b in batches:
            langs = b.column(1).to_pylist()
            for at, texts in _slices(b.column(0).to_pylist()):
                of = []
                for name in langs[at : at + len(texts)]:
                    if name not in number:
                        number[name] = len(names)
                        names.append(name)
                    of.append(number[name])
                doc, code, count = gram_counts(texts)
                held.append((np.array(of, dtype=np.int64)[doc], code, count))
                rows += len(code)
                if rows >= HELD_ROWS:
                    held = [_summed(held)]
                    rows = len(held[0][1])
                    if rows >= HELD_ROWS // 2:
                        yield give()
                        held, rows = [], 0
        if held:
            held = [_summed(held)]
            yield give()

    small_batches(docs.sparkSession)
    known = docs.select(F.col(quoted(text)).alias("text"), F.col(quoted(lang)).cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sums = known.mapInArrow(counts, "lang string, gram long, count long").groupBy("lang", "gram").agg(F.sum("count").alias("count"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("count"), "gram"))
    return sums.withColumn("rank", rank).where(F.col("rank") <= most).select("lang", "gram", (F.col("rank") - 1).cast("int").alias("rank"))


class Profiles:
    """Languages in order, the n-grams of all profiles, and each language's rank of each, `most` where it has none."""

    def __init__(self, rows: list[tuple[str, int, int]], most: int = PROFILE):
        self.most = most
        self.langs = sorted({r[0] for r in rows}, key=lambda s: s.encode())
        self.grams = np.unique(np.array([r[1] for r in rows], dtype=np.int64))
        self.ranks = np.full((len(self.langs), len(self.grams) + 1), most, dtype=np.int64)
        for name, gram, rank in rows:
            self.ranks[self.langs.index(name), np.searchsorted(self.grams, gram)] = rank

    def nearest(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(language, score) of each text."""
        doc, code, rank = top_grams(*gram_counts(texts), self.most)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        at = np.searchsorted(self.grams, code)
        at = np.where((at < len(self.grams)) & (self.grams[np.minimum(at, len(self.grams) - 1)] == code), at, len(self.grams))
        far = np.stack([np.bincount(doc, weights=np.where(r[at] < self.most, np.abs(r[at] - rank), self.most), minlength=len(texts)) for r in self.ranks])
        number = np.bincount(doc, minlength=len(texts))
        best = far.argmin(axis=0)
        score = np.where(number > 0, 1 - far[best, np.arange(len(texts))] / (self.most * np.maximum(number, 1)), 0.0)
        return [self.langs[k] if n else "und" for k, n in zip(best.tolist(), number.tolist(), strict=True)], score


def identify(docs: DataFrame, profiles: DataFrame, *, text: str = "text", most: int = PROFILE) -> DataFrame:
    """docs with lang_pred and score. The profiles, `most` rows a language, are collected."""
    model = Profiles([(r["lang"], r["gram"], r["rank"]) for r in profiles.collect()], most)

    def predict(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        for b in batches:
            names: list[str] = []
            scores = [np.empty(0)]
            for _, texts in _slices(b.to_pylist()):
                found, score = model.nearest(texts)
                names += found
                scores.append(score)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(scores), pa.float64())], names=["lang", "score"])

    import pyarrow as pa

    predict.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    small_batches(docs.sparkSession)
    found, name, score = (fresh_name(docs, c) for c in ("_found", "lang_pred", "score"))
    out = docs.withColumn(found, F.arrow_udf(predict, "lang string, score double")(F.col(quoted(text)).cast("string")))
    return out.select(*[F.col(quoted(c)) for c in docs.columns], F.col(f"{found}.lang").alias(name), F.col(f"{found}.score").alias(score))


def op12_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept_back = held_out(F.col("doc_id"), 4, 2)
    out = identify(docs.select("doc_id", "text"), learn(docs.where(~kept_back)))
    return out.select("doc_id", kept_back.alias("held_out"), "lang_pred", "score")
