"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Texts become sequences of template words: numbers (in digits or words), names (capitalised words) and units (after a
number) turn into typed placeholders that keep their value beside them; all else is lower-cased and stripped of
punctuation. Windows of WINDOW words are hashed and joined with those of the benchmark's items: a document's as template
and by its values, an item's by its values and with each capitalised word both as a name and as a plain word. Windows
that meet on the same alignment of a document with an item are added up; where they cover enough words, the slots that
they cover must match one to one: the same value in the item stands for the same value in the document, and different
ones for different ones. So a question is found again when its numbers, names or units have been changed throughout. A
capitalised word that opens a sentence may be no name: where slots do not match, the alignment is judged again by the
windows in which such words are equal, and by those in which all values are.

Scale: every window of every text is looked at; a document's matches are combined before the shuffle. Benchmark windows
are broadcast up to BROADCAST_WINDOWS rows, beyond that joined by shuffle; documents that match are read again to check
their slots, picked by broadcast only up to BROADCAST_DOCS.

Edge cases: null and empty texts match nothing, on either side; items of fewer words than a window are one window of
their own length, and those of one or two words count only where a document has them, values and all, as a whole line;
an item's first word matches in any letter case; windows with less than half literal words count where all their values are equal; repeated rows, and rows that share an id, are judged by id and text; an empty table on either side gives an empty result; other columns of docs do not matter, whatever their names.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.llm._base import fresh_name, quoted, store, table

WINDOW = 8
#: Words that the windows of one alignment must cover, or all of a shorter item's.
COVERED = 13
#: Items of fewer words are found only where they are a line of their own.
SHORT = 3
BROADCAST_WINDOWS = 500_000
BROADCAST_DOCS = 1_000_000
#: _OPEN is a capitalised word that does not stand within a sentence.
_NUMBER, _NAME, _UNIT, _OPEN = "\ue000", "\ue001", "\ue002", "\ue003"
#: The first character after the marks.
_AFTER = "\ue004"
#: Fixed values.
UNITS = "km|cm|mm|m|kg|mg|g|lbs|lb|oz|ml|l|mph|kmh|hours|hour|minutes|minute|seconds|second|days|day|weeks|week|months|month|years|year|meters|meter|metres|metre|miles|mile|feet|foot|inches|inch|dollars|dollar|euros|euro|cents|cent|pounds|pound|percent|degrees|degree|liters|liter|litres|litre|grams|gram|kilometers|kilometres|kilograms"


_ONES = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
_TEENS = ("ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen")
_TENS = ("twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")
_BIG = {"hundred": 100, "thousand": 1000, "million": 10**6, "billion": 10**9}
#: Number words, those of two words written as one, with their values.
_BELOW_100 = dict(zip(("zero", *_ONES, *_TEENS), range(20), strict=True)) | {t + o: 20 + 10 * i + j for i, t in enumerate(_TENS) for j, o in enumerate(("", *_ONES))}
NUMBER_WORDS = _BELOW_100 | {w + big: n * x for w, n in _BELOW_100.items() for big, x in _BIG.items()}
_WORD = "\\p{L}\\p{N}"
_LAST = f"(?![{_WORD}])"
_NUMBERS = (
    f"(?<![{_WORD}{_NAME}{_OPEN}])[{_NAME}{_OPEN}]?(?=[0-9eofnstz])(?:(?:({'|'.join(_TENS)})(?: ({'|'.join(_ONES)}))?|({'|'.join(('zero', *_ONES, *_TEENS))}))(?: ({'|'.join(_BIG)}))?{_LAST}"
    f"|([0-9]+)(?: ({'|'.join(_BIG)}){_LAST}|(?=(?:{UNITS})?{_LAST})))"
)


def template_words(text: Column, openers: bool = False) -> Column:
    """Words of a text; placeholders are a mark of their type and their value. With openers, names that do not stand within a sentence get a mark of their own."""
    t = F.regexp_replace(text, f"[{_NUMBER}-{_OPEN}]", " ")
    t = F.regexp_replace(t, "(?<=[0-9])[.,:](?=[0-9])", "")
    if openers:
        t = F.regexp_replace(t, "(?<=[\\p{Ll},;] )(\\p{Lu}\\p{Ll}+)", _NAME + "$1")
    t = F.regexp_replace(t, f"(?<![{_WORD}{_NAME}])(\\p{{Lu}}\\p{{Ll}}+)", (_OPEN if openers else _NAME) + "$1")
    t = F.regexp_replace(F.lower(t), f"[^{_WORD}{_NAME}{_OPEN}]+", " ")
    t = F.regexp_replace(t, _NUMBERS, _NUMBER + "$1$2$3$4$5$6")
    t = F.regexp_replace(t, f"({_NUMBER}[0-9a-z]+?) ?({UNITS}){_LAST}", "$1 " + _UNIT + "$2")
    return F.array_remove(F.split(t, " "), "")


def _let(value: Column, then: Any) -> Column:
    """then(value), the value being evaluated once for each row: a lambda does not share what it refers to."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _marked(w: Column) -> Column:
    return (w >= _NUMBER) & (w < _AFTER)


def _kind(w: Column) -> Column:
    """The mark of a placeholder, empty for other words."""
    return F.when(_marked(w), F.translate(F.substring(w, 1, 1), _OPEN, _NAME)).otherwise("")


def _value(w: Column) -> Column:
    return F.when(_marked(w), F.substring(w, 2, 1 << 30)).otherwise(w)


def _starts(words: Column, size: int) -> Column:
    return F.sequence(F.lit(1), F.greatest(F.size(words) - (size - 1), F.lit(1)))


def _runs(hashes: Column, size: int) -> Column:
    """A hash of each run of `size` elements, of which there are as many at least: from runs of half as many, and so on."""
    # A lambda with a second parameter would be given the index.
    joined = lambda by: lambda h: F.zip_with(F.slice(h, 1, F.size(h) - by), F.slice(h, 1 + by, F.size(h) - by), lambda x, y: F.xxhash64(x, y))
    span = 1
    while span < size:
        by = min(span, size - span)
        hashes = _let(hashes, joined(by))
        span += by
    return hashes


def windows(words: Column, size: int) -> Column:
    """Of all runs of `size` words the hashes as a template and by values, one if they are the same; null if there are fewer words."""
    as_template = F.transform(words, lambda w: F.xxhash64(F.when(_marked(w), F.substring(w, 1, 1)).otherwise(w)))
    as_values = F.transform(words, lambda w: F.xxhash64(_value(w)))
    return F.when(F.size(words) >= size, F.zip_with(_runs(as_template, size), _runs(as_values, size), lambda t, v: F.when(t == v, F.array(t)).otherwise(F.array(t, v))))


def readings(words: Column, size: int) -> Column:
    """Of all runs of `size` words of an item the hashes of its readings: by values, and those with at least half literal words of each name both as it is and as a placeholder."""
    # The first word of an item may be capitalised in the document.
    name = lambda w, i: (_kind(w) == _NAME) | ((i == 0) & ~_marked(w))
    each = F.transform(words, lambda w, i: F.struct(F.xxhash64(F.when(name(w, i), _NAME).when(_marked(w), _kind(w)).otherwise(w)).alias("t"), F.xxhash64(_value(w)).alias("v"), name(w, i).alias("name"), _marked(w).alias("slot")))

    def grow(held: Column, x: Column) -> Column:
        literal = F.transform(held, lambda a: F.struct(F.array_append(a["h"], x["v"]).alias("h"), (a["n"] + 0).alias("n")))
        slot = F.filter(F.transform(held, lambda a: F.struct(F.array_append(a["h"], x["t"]).alias("h"), (a["n"] + 1).alias("n"))), lambda a: a["n"] * 2 <= size)
        return F.when(x["name"], F.concat(literal, slot)).when(x["slot"], slot).otherwise(literal)

    def run(h: Column, i: Column) -> Column:
        part = F.slice(h, i, size)
        none = F.array(F.struct(F.array().cast("array<bigint>").alias("h"), F.lit(0).alias("n")))
        exact = _runs(F.transform(part, lambda x: x["v"]), size)
        return F.array_union(exact, F.transform(F.aggregate(part, none, grow), lambda a: F.element_at(_runs(a["h"], size), 1)))

    return F.when(F.size(words) >= size, _let(each, lambda h: F.transform(_starts(words, size), lambda i: run(h, i))))


def row_key(key: Column, text: Column) -> Column:
    return F.xxhash64(F.coalesce(key.cast("string"), F.lit("")), text)


def _benchmark(items: DataFrame, window: int) -> DataFrame:
    words = items.where(F.col("text").isNotNull()).select("item_id", template_words(F.col("text"), openers=True).alias("item"))
    return store(words.where(F.size("item") > 0).withColumn("len", F.least(F.size("item"), F.lit(window))), "leak-items")


def _covered(ats: Column) -> Column:
    """Words that windows cover: each adds what lies beyond the one before it."""
    return F.aggregate(ats, F.struct(F.lit(0).alias("n"), F.lit(-1).alias("end")), lambda s, a: F.struct((s["n"] + a + F.col("len") - F.greatest(a, s["end"])).alias("n"), (a + F.col("len")).alias("end")))["n"]


def _pair(i: Column, d: Column) -> Column:
    """An item's word beside the document's: type if both have it, values, and whether either opens a sentence."""
    words = F.create_map(*[F.lit(x) for w, n in NUMBER_WORDS.items() for x in (w, str(n))])
    value = lambda w: F.when(_kind(w) == _NUMBER, F.coalesce(F.try_element_at(words, _value(w)), _value(w))).otherwise(_value(w))
    opens = lambda w: _marked(w) & (w >= _OPEN)
    return F.struct(F.when(_kind(i) == _kind(d), _kind(i)).otherwise("").alias("kind"), value(i).alias("i"), value(d).alias("d"), (opens(i) | opens(d)).alias("open"))


#: What two words must be for a window to count: equal, or of one type; openers equal; all equal.
RULES = (
    lambda p: (p["i"] == p["d"]) | (p["kind"] != ""),
    lambda p: (p["i"] == p["d"]) | ((p["kind"] != "") & ~p["open"]),
    lambda p: p["i"] == p["d"],
)


def _judged(rule: Any) -> Column:
    """(covered, slots, changed, one_to_one) of an alignment by the windows that meet the rule."""
    part = lambda a: F.slice("pairs", a - F.col("first") + 1, F.col("len"))

    def of(ats: Column) -> Column:
        seen = F.array_distinct(F.flatten(F.transform(ats, part)))
        return _let(F.filter(seen, lambda p: (p["kind"] != "") & ~(p["open"] & (p["i"] == p["d"]))), lambda slots: judge(ats, slots))

    def judge(ats: Column, slots: Column) -> Column:
        n = lambda *names: F.size(F.array_distinct(F.transform(slots, lambda p: F.struct(p["kind"], *[p[x] for x in names]))))
        return F.struct(_covered(ats).alias("covered"), F.size(slots).alias("slots"), F.exists(slots, lambda p: p["i"] != p["d"]).alias("changed"), ((n("i", "d") == n("i")) & (n("i", "d") == n("d"))).alias("one_to_one"))

    return _let(F.filter("ats", lambda a: F.forall(part(a), rule)), of)


def _short(texts: DataFrame, bench: DataFrame) -> DataFrame:
    """Rows like those of longer items for items of fewer than SHORT words, found as whole lines of equal values."""
    line = lambda words: F.array_join(F.transform(words, _value), " ")
    own = bench.where(F.size("item") < SHORT).select("item_id", line(F.col("item")).alias("line"), F.size("item").alias("words"), F.size(F.filter("item", lambda w: _marked(w) & (w < _OPEN))).alias("n"))
    side = F.broadcast(own) if own.count() <= BROADCAST_WINDOWS else own
    lines = texts.select("_key", "row", F.explode(F.split("text", "\\R")).alias("text")).select("_key", "row", line(template_words(F.col("text"))).alias("line"))
    met = lines.join(side, "line").dropDuplicates(["row", "item_id"])
    return met.select("row", "_key", "item_id", F.struct(F.col("words").alias("covered"), F.col("words").alias("item_words"), "n", F.lit(False).alias("changed")).alias("b"))


def find_leaks(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = WINDOW, covered: int = COVERED) -> DataFrame:
    """One row per document (by id and text) and item that it holds: row, key, item_id, covered, item_words, coverage, slots, changed."""
    bench = _benchmark(items, window)
    lengths = [r["len"] for r in bench.select("len").distinct().orderBy("len").collect()]
    texts = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("_key"), row_key(F.col(key), F.col(text)).alias("row"), F.col(text).alias("text"))
    words = texts.select("_key", "row", template_words(F.col("text")).alias("words"))
    found = None
    for n in [n for n in lengths if n >= min(SHORT, window)]:
        own = bench.where(F.col("len") == n).select("item_id", F.posexplode(readings(F.col("item"), n)).alias("at", "w"))
        own = store(own.select("item_id", "at", F.explode("w").alias("w")), "leak-windows")
        side = F.broadcast(own) if own.count() <= BROADCAST_WINDOWS else own
        seen = words.select("_key", "row", F.posexplode(windows(F.col("words"), n)).alias("pos", "w")).select("_key", "row", "pos", F.explode("w").alias("w")).join(side, "w")
        runs = seen.groupBy("_key", "row", "item_id", (F.col("pos") - F.col("at")).alias("shift")).agg(F.sort_array(F.collect_set("at")).alias("ats"), F.lit(n).alias("len"))
        found = runs if found is None else found.unionByName(runs)
    if found is None:
        found = docs.select(F.col(key).alias("_key"), F.lit(0).cast("long").alias("row"), F.lit(None).cast("long").alias("item_id"), F.lit(0).alias("shift"), F.array().cast("array<int>").alias("ats"), F.lit(0).alias("len")).limit(0)
    found = found.withColumn("covered", _covered(F.col("ats"))).withColumn("first", F.element_at("ats", 1)).withColumn("last", F.element_at("ats", -1) + F.col("len"))
    few_items = bench.count() <= BROADCAST_WINDOWS // 10
    enough = F.least(F.lit(covered), F.size("item"))
    found = found.join(F.broadcast(bench.drop("len")) if few_items else bench.drop("len"), "item_id").where(F.col("covered") >= enough)
    found = store(found.drop("covered"), "leak-found")
    rows = found.select("row").distinct()
    pick = F.broadcast(rows) if found.count() <= BROADCAST_DOCS else rows
    again = texts.join(pick, "row", "left_semi").dropDuplicates(["row"]).select("row", template_words(F.col("text"), openers=True).alias("words"))
    span = lambda c, start: F.slice(c, start, F.col("last") - F.col("first"))
    pairs = F.zip_with(span("item", F.col("first") + 1), span("words", F.col("first") + F.col("shift") + 1), _pair)
    # Stored, for lambdas that refer to it would make it anew each time.
    both = store(found.join(again, "row").withColumn("pairs", F.transform(pairs, lambda p, k: p.withField("k", k))).drop("words"), "leak-pairs")
    both = both.withColumn("judged", F.array(*[_judged(rule) for rule in RULES]))
    both = both.withColumn("judged", F.array_max(F.filter("judged", lambda j: j["one_to_one"] & (j["covered"] >= enough))))
    both = store(both.select("row", "_key", "item_id", "item", "judged"), "leak-judged").where(F.col("judged").isNotNull())
    both = both.select("row", "_key", "item_id", "item", F.col("judged.covered").alias("covered"), F.col("judged.slots").alias("n"), F.col("judged.changed").alias("changed"))
    best = both.groupBy("row", "_key", "item_id").agg(F.max(F.struct("covered", F.size("item").alias("item_words"), "n", "changed")).alias("b"))
    if lengths and lengths[0] < min(SHORT, window):
        best = best.unionByName(_short(texts, bench))
    return best.select("row", F.col("_key").alias(key), "item_id", F.col("b.covered").cast("long").alias("covered"), F.col("b.item_words").cast("long").alias("item_words"), (F.col("b.covered") / F.col("b.item_words")).alias("coverage"), F.col("b.n").cast("long").alias("slots"), F.col("b.changed").alias("changed"))


def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")).drop("row")


def decontam_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows of docs that hold no benchmark item; the columns of docs."""
    mark = fresh_name(docs, "_leak_row")
    leaks = store(find_leaks(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark")).select(F.col("row").alias(mark)).distinct(), "leak-rows")
    side = F.broadcast(leaks) if leaks.count() <= BROADCAST_DOCS else leaks
    return docs.withColumn(mark, row_key(F.col("doc_id"), F.col("text"))).join(side, mark, "left_anti").select(*[quoted(c) for c in docs.columns])
