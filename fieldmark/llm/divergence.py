"""Source divergence audit: how far each source's use of words is from that of its language's other sources.

Texts are folded (A-Z lower-cased, every other ASCII byte but letters a space) and gathered, task by task, into chunks of one
language and about CHUNK_BYTES. First pass: each chunk's words with the number of its documents that hold them; their sums
over all chunks are exact document frequencies, and a language keeps the words in at least `least` of its documents. Second
pass: each chunk meets those of its own words that were kept, builds an Aho-Corasick automaton of them, padded with a
space on both sides, and counts what it finds in its texts, by source. No task holds more of the vocabulary than a
chunk's words, however large the corpus, and nothing is broadcast but what Spark finds small.

Postings are sparse: a word that a source does not use has the source's smallest probability. The sum of a pair over all
kept words is therefore that of the smallest probabilities, corrected for the words of either side (by distinct
probabilities, whose number does not grow with the vocabulary) and for the words of both (from the words' postings, summed
in tasks before they are shuffled). All numbers are whole, so no order of summing changes them.

Edge cases: null text, lang and source count as ''; every row is a document, repeated ones too; a group without words has
postings nowhere and still takes part; a language that keeps no word gives pairs of value 0 and no terms; ties go to the
smaller item by its UTF-8 bytes; a text longer than a chunk is a chunk; an empty table gives an empty result. Columns are
taken by name; others do not matter, nor do their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import itemgetter
from typing import Any

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldmark.llm._base import discard, free_shuffles, quoted, small_batches, store, table

#: Folded text in a chunk, and in all chunks that a task has open.
CHUNK_BYTES = 8_000_000
OPEN_BYTES = 48_000_000
LEAST_DOCS = 3
TOP_TERMS = 200
PAIR_BLOCK = 2_000_000
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_CHUNK_SCHEMA = "chunk long, lang string, sources array<string>, sizes array<long>, blobs array<binary>, terms array<string>, docs array<long>"


def folded_words(raw: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return raw.translate(_FOLD).split()


def _gather(batches: Iterator[Any]) -> Iterator[Any]:
    """Chunks of (lang, source, text as bytes): each source's folded texts, and the words with their documents."""
    import pyarrow as pa

    number = TaskContext.get().partitionId() << 33
    open_: dict[str, tuple[dict[str, list[bytes]], Counter[bytes]]] = {}
    held: dict[str, int] = {}

    def close(lang: str) -> Any:
        nonlocal number
        texts, seen = open_.pop(lang)
        held.pop(lang)
        number += 1
        whole = {s: b" ".join(t) for s, t in texts.items()}
        row = {
            "chunk": [number], "lang": [lang], "sources": [list(whole)], "sizes": [[len(t) for t in whole.values()]], "blobs": [[pa.compress(t, codec="zstd", asbytes=True) for t in whole.values()]],
            "terms": [[w.decode("utf-8", "replace") for w in seen]], "docs": [list(seen.values())],
        }
        kinds = [pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.string()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row.values(), kinds, strict=True)], names=list(row))

    for b in batches:
        for lang, source, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            words = folded_words(raw.as_py())
            texts, seen = open_.setdefault(lang, ({}, Counter()))
            seen.update(set(words))
            of = texts.setdefault(source, [])
            if words:
                text = b" ".join(words)
                of.append(text)
                held[lang] = held.get(lang, 0) + len(text) + 1
            # A document that holds nothing still counts a little, so that no chunk is open for ever.
            held[lang] = held.get(lang, 0) + 64
            if held[lang] >= CHUNK_BYTES:
                yield close(lang)
            elif sum(held.values()) >= OPEN_BYTES:
                yield close(max(held, key=lambda x: held[x]))
    for lang in list(open_):
        yield close(lang)


def _recount(key: tuple[Any, ...], chunk: Any, kept: Any) -> Any:
    """Occurrences of a chunk's kept terms by source, as an automaton finds them."""
    import ahocorasick
    import pyarrow as pa

    terms = kept.column("term")
    words = [w.encode().decode("latin-1") for w in terms.to_pylist()]
    machine = ahocorasick.Automaton()
    for i, w in enumerate(words):
        machine.add_word(f" {w} ", i)
    machine.make_automaton()
    names: list[str] = []
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.empty(0, dtype=np.int64),) * 3]
    langs = chunk.column("lang").to_pylist()
    for sources, sizes, blobs in zip(*(chunk.column(c).to_pylist() for c in ("sources", "sizes", "blobs")), strict=True):
        for source, size, blob in zip(sources if words else [], sizes, blobs):
            text = f" {pa.decompress(blob, decompressed_size=size, codec='zstd', asbytes=True).decode('latin-1')} "
            counts = np.bincount(np.fromiter(map(itemgetter(1), machine.iter(text)), dtype=np.int64), minlength=len(words))
            at = np.flatnonzero(counts)
            found.append((at, np.full(len(at), len(names)), counts[at]))
            names.append(source)
    term, source_, count = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(term, kind="stable")
    which, first = np.unique(term[order], return_index=True)
    ends = pa.array(np.append(first, len(term)), pa.int32())
    lists = [pa.ListArray.from_arrays(ends, v) for v in (pa.array(names, pa.string()).take(pa.array(source_[order])), pa.array(count[order]))]
    return pa.table([pa.array(langs[:1] * len(which), pa.string()), terms.take(pa.array(which)).combine_chunks().cast(pa.string()), *lists], names=["lang", "term", "sources", "counts"])


def postings(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """(lang, term, source, count) of kept terms where the source uses them, and (lang, source) of every group; both stored."""
    said = lambda c: F.coalesce(F.col(quoted(c)).cast("string"), F.lit(""))
    small_batches(docs.sparkSession, 2000)
    chunks = store(docs.select(said(lang).alias("lang"), said(source).alias("source"), said(text).cast("binary").alias("text")).mapInArrow(_gather, _CHUNK_SCHEMA), "divergence-chunks")
    groups = store(chunks.select("lang", F.explode("sources").alias("source")).distinct(), "divergence-groups")
    seen = chunks.select("chunk", "lang", F.explode(F.arrays_zip("terms", "docs")).alias("x")).select("chunk", "lang", F.col("x.terms").alias("term"), F.col("x.docs").alias("docs"))
    # Chunks are numbered apart for each language, so a chunk's terms are its language's.
    kept = seen.withColumn("_all", F.sum("docs").over(W.partitionBy("lang", "term"))).where(F.col("_all") >= least).select(F.col("chunk").alias("of"), "term")
    # Stored step by step, so that shuffle files of one step are gone before the next one's are written.
    kept = store(kept, "divergence-kept")
    free_shuffles(docs.sparkSession)
    counted = chunks.select("chunk", "lang", "sources", "sizes", "blobs").groupBy("chunk").cogroup(kept.groupBy("of")).applyInArrow(_recount, "lang string, term string, sources array<string>, counts array<long>")
    counted = store(counted, "divergence-counted")
    discard(chunks, kept)
    free_shuffles(docs.sparkSession)
    # Dealt once, by term, while a term's sources still stand in one row.
    apart = counted.repartition("lang", "term").select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("x")).select("lang", "term", F.col("x.sources").alias("source"), F.col("x.counts").alias("count"))
    out = store(apart.groupBy("lang", "term", "source").agg(F.sum("count").alias("count")), "divergence-postings")
    discard(counted)
    free_shuffles(docs.sparkSession)
    return out, groups


def share(count: Column | str, total: Column | str, kinds: Column | str) -> Column:
    """1 + floor(10^9 (count + 1) / (total + kinds)), exactly."""
    c, n, v = (F.col(x) if isinstance(x, str) else x for x in (count, total, kinds))
    whole = lambda x: x.cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", F.lit(1_000_000_000).cast("decimal(10,0)") * whole(c + 1), whole(n + v))


def surplus(p: Column | str, q: Column | str) -> Column:
    """floor((p - q)^2 / q) of whole numbers."""
    p, q = (F.col(x) if isinstance(x, str) else x for x in (p, q))
    return F.call_function("div", (p - q) * (p - q), q)


def _both(batches: Iterator[Any]) -> Iterator[Any]:
    """Of rows with postings (g, p, p0): for each pair of groups, what their common terms add to the sparse sum."""
    import pyarrow as pa

    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) * (p - q) // q

    for b in batches:
        lists = b.column(0)
        size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        flat = lists.flatten()
        g, p, p0 = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("g", "p", "p0"))
        names, code = np.unique(g, return_inverse=True)
        start = np.repeat(np.cumsum(size) - size, size)
        reach = np.repeat(size, size)
        ends = np.cumsum(reach)
        keys: list[np.ndarray] = []
        sums: list[np.ndarray] = []
        at = 0
        while at < len(g):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIR_BLOCK, side="right")))
            n = reach[at:to]
            i = np.repeat(np.arange(at, to), n)
            j = np.repeat(start[at:to], n) + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
            apart = i != j
            i, j = i[apart], j[apart]
            value = f(p[i], p[j]) - f(p[i], p0[j]) - f(p0[i], p[j]) + f(p0[i], p0[j])
            k, inverse = np.unique(code[i] * len(names) + code[j], return_inverse=True)
            s = np.zeros(len(k), dtype=np.int64)
            np.add.at(s, inverse, value)
            keys.append(k)
            sums.append(s)
            at = to
        if keys:
            k, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            s = np.zeros(len(k), dtype=np.int64)
            np.add.at(s, inverse, np.concatenate(sums))
            yield pa.RecordBatch.from_arrays([pa.array(names[k // len(names)]), pa.array(names[k % len(names)]), pa.array(s)], names=["g", "h", "value"])


def audit(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: a source's distance to each other one of its language, and its most telling terms."""
    post, found = postings(docs, text=text, lang=lang, source=source, least=least)
    of_group = post.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    of_lang = post.groupBy("lang", "term").agg(F.sum("count").alias("c")).groupBy("lang").agg(F.sum("c").alias("all"), F.count(F.lit(1)).alias("kinds"))
    groups = found.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0, ["n", "all", "kinds"])
    groups = groups.withColumn("p0", F.when(F.col("kinds") > 0, share(F.lit(0), F.col("n"), F.col("kinds")))).withColumn("g", F.monotonically_increasing_id())
    groups = store(groups, "divergence-stats")
    used = post.join(groups, ["lang", "source"]).withColumn("p", share(F.col("count"), F.col("n"), F.col("kinds")))

    of_term = used.groupBy("lang", "term", "all", "kinds").agg(F.collect_list(F.struct("g", "p", "p0")).alias("x"), F.sum("count").alias("c"))
    of_term = store(of_term.select("lang", "term", share("c", "all", "kinds").alias("q"), "x"), "divergence-terms")
    free_shuffles(docs.sparkSession)
    used = of_term.select("lang", "term", "q", F.explode("x").alias("x")).select("lang", "term", "q", "x.*")

    telling = used.where(F.col("p") > F.col("q")).select("g", F.col("term").alias("item"), surplus("p", "q").alias("value"))
    telling = telling.withColumn("rank", F.row_number().over(W.partitionBy("g").orderBy(F.desc("value"), "item"))).where(F.col("rank") <= top)
    telling = telling.join(groups.select("g", "lang", "source"), "g").select("lang", "source", "item", "value", "rank")

    here = groups.select("lang", "g", "p0", "kinds")
    other = groups.select("lang", F.col("g").alias("h"), F.col("p0").alias("q0"))
    base = here.join(other, "lang").where(F.col("g") != F.col("h"))
    floor_ = base.select("g", "h", F.coalesce(F.col("kinds") * surplus("p0", "q0"), F.lit(0)).cast("long").alias("value"))
    distinct = used.groupBy("lang", "g", "p0", "p").agg(F.count(F.lit(1)).alias("terms")).join(other, "lang").where(F.col("g") != F.col("h"))
    mine = distinct.groupBy("g", "h").agg(F.sum(F.col("terms") * (surplus("p", "q0") - surplus("p0", "q0"))).alias("value"))
    theirs = distinct.groupBy(F.col("h").alias("g"), F.col("g").alias("h")).agg(F.sum(F.col("terms") * (surplus("q0", "p") - surplus("q0", "p0"))).alias("value"))
    common = of_term.where(F.size("x") > 1).select("x").mapInArrow(_both, "g long, h long, value long")
    sums = floor_.unionByName(mine).unionByName(theirs).unionByName(common).groupBy("g", "h").agg(F.sum("value").alias("value"))
    pairs = sums.join(groups.select("g", "lang", "source"), "g").join(groups.select(F.col("g").alias("h"), F.col("source").alias("item")), "h").select("lang", "source", "item", "value")
    pairs = pairs.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return pairs.withColumn("part", F.lit("pair")).unionByName(telling.withColumn("part", F.lit("term"))).select("lang", "source", "part", "item", "value", "rank")


ORACLE_SQL = r"""WITH docs AS (SELECT row_number() OVER () AS d, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
words AS (SELECT d, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 3),
kinds AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
post AS (SELECT lang, source, term, count(*) AS c FROM words JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
of_group AS (SELECT g.lang, g.source, coalesce(sum(c), 0)::HUGEINT AS n FROM groups g LEFT JOIN post p ON p.lang = g.lang AND p.source = g.source GROUP BY ALL),
whole AS (SELECT lang, term, sum(c)::HUGEINT AS c FROM post GROUP BY ALL),
dense AS (SELECT g.lang, g.source, k.term, coalesce(p.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(p.c, 0) + 1)) // (g.n + v) AS p
  FROM of_group g JOIN kept k ON k.lang = g.lang JOIN kinds ON kinds.lang = g.lang LEFT JOIN post p ON p.lang = g.lang AND p.source = g.source AND p.term = k.term),
of_lang AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (c + 1)) // (sum(c) OVER (PARTITION BY lang) + v) AS q FROM whole JOIN kinds USING (lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM groups x JOIN groups y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN sums s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM dense JOIN of_lang USING (lang, term) WHERE c > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM pairs
UNION ALL SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM terms) WHERE rank <= 200"""


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))
