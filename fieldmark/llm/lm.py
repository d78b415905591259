"""Language-model scoring with a Brown class bigram model.

A text is a sequence of lower-cased words and one end. Exchange clustering assigns the most frequent words, and groups of
all others by their last letters, to classes so that the class bigram likelihood of all training text is greatest. Then
every other word of the training text, however rare, is assigned a class of its own: the one that makes what stands before
the word likeliest, its last letters counting as some occurrences more. A token's probability is that of its class after
the class of the token before it, times that of the word in its class. Every word of the training text goes by its own
class, also as what stands before; only while classes are being assigned, what stands before goes by last letters if it
is not among the most frequent, and so do words that training has not seen; in each class, unseen words have half a count
together, as in the unigram base. Transitions are interpolated with class frequencies.

Scale: word counts and contexts cover all training text, combined by task before the shuffle, and grow with it. The words
above a frequency that at most HEAD_WORDS reach travel to every task with their counts and classes; the rest of each
document's words, each rare, meet theirs in a shuffled join, with the classes beside them where these are known, and where
two rare words stand together in a join for each; so where the line falls changes no result. Bigrams for the exchange are counted into a dense matrix of fixed size by task and summed by chunk; only that matrix reaches the driver.

Edge cases: null and empty texts are one end token; a null id counts as the empty text for the fold; without training
text every base probability is 1 and N is 0; repeated rows are scored each; long texts are scored whole; an empty table
gives an empty result; a carried column whose name is one of the results' gets an underscore in front.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.llm._base import discard, held_out, small_batches, store, table

HEAD_WORDS = 200_000
#: Frequent words, and endings, that the exchange clusters.
OWN_TYPES = 600
SHARED_TYPES = 200
CLASSES = 48
#: How many occurrences a word's ending counts for when the word is assigned its class.
ENDING_WEIGHT = 2.0
CHUNKS = 16
#: Words, counted by runs of texts, and tokens that a task holds at once before it passes their counts on.
TASK_WORDS = 500_000
TASK_TOKENS = 4_000_000
END = 0
OTHER = 1


def exchange(bigrams: np.ndarray, classes: int, rounds: int = 12) -> np.ndarray:
    """Class of each type: types move one by one, most frequent first, to the class that raises the likelihood most."""
    n = len(bigrams)
    b = bigrams.astype(float)
    f = lambda x: x * np.log(np.maximum(x, 1e-300))
    mass = b.sum(axis=1) + b.sum(axis=0)
    order = np.lexsort((np.arange(n), -mass))
    at = np.zeros(n, dtype=np.int64)
    at[order] = np.arange(n) % classes
    hot = np.zeros((n, classes))
    hot[np.arange(n), at] = 1
    m = hot.T @ b @ hot
    right, left = b @ hot, b.T @ hot
    k = np.arange(classes)
    for _ in range(rounds):
        moved = 0
        for w in order:
            if not mass[w]:
                continue
            c, r, s, own = at[w], right[w].copy(), left[w].copy(), b[w, w]
            # Without w: its counts leave the row and the column of its class.
            r[c] -= own
            s[c] -= own
            m[c] -= r
            m[:, c] -= s
            m[c, c] -= own
            row, col = m.sum(axis=1), m.sum(axis=0)
            grown = f(m + r[None]) - f(m)
            gain = grown.sum(axis=1) - grown[k, k]
            grown = f(m + s[:, None]) - f(m)
            gain += grown.sum(axis=0) - grown[k, k]
            gain += f(m[k, k] + r + s + own) - f(m[k, k])
            gain -= f(row + r.sum() + own) - f(row) + f(col + s.sum() + own) - f(col)
            to = int(np.argmax(gain))
            if gain[to] <= gain[c] + 1e-9:
                to = c
            m[to] += r
            m[:, to] += s
            m[to, to] += own
            if to != c:
                moved += 1
                at[w] = to
                right[:, c] -= b[:, w]
                right[:, to] += b[:, w]
                left[:, c] -= b[w]
                left[:, to] += b[w]
        if not moved:
            break
    return at


class ClassModel:
    """Types and classes of words, and log10 probabilities of transitions."""

    def __init__(self, own: list[str], shared: list[str], tokens: int, vocabulary: int, ends: int):
        self.own = {w: i + 2 for i, w in enumerate(own)}
        self.shared = {e: i + 2 + len(own) for i, e in enumerate(shared)}
        self.types = 2 + len(own) + len(shared)
        self.tokens, self.vocabulary, self.ends = tokens, vocabulary, ends
        self.whole = float(np.log10(tokens + 0.5 * (vocabulary + 1)))
        self.classes = np.zeros(self.types, dtype=np.int64)
        #: log10 of what divides (c + 0.5) in a class; log10 P(class | class before).
        self.share, self.move = np.zeros(1), np.zeros((1, 1))
        self.sets: Any = None

    @classmethod
    def of(cls, fields: dict[str, Any]) -> ClassModel:
        """A model from another's fields: broadcast values are plain data, which needs no import on the executors."""
        out = cls.__new__(cls)
        vars(out).update(fields)
        return out

    def types_of(self, words: Any) -> np.ndarray:
        """The type of each word of an Arrow array: its own, that of its ending, or OTHER."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if self.sets is None:
            self.sets = pa.array(list(self.own), pa.string()), pa.array(list(self.shared), pa.string())
        own = _places(words, self.sets[0])
        by_end = _places(pc.utf8_slice_codeunits(words, -2), self.sets[1])
        return np.where(own >= 0, own + 2, np.where(by_end >= 0, by_end + 2 + len(self.own), OTHER))

    def type_of(self, word: str) -> int:
        import pyarrow as pa

        return int(self.types_of(pa.array([word], pa.string()))[0])

    def fields(self) -> dict[str, Any]:
        """What tasks need."""
        return {k: v for k, v in vars(self).items() if k != "head"} | {"sets": None}

    def cluster(self, bigrams: np.ndarray, classes: int = CLASSES) -> None:
        """Classes of types; pairs: how often each class is followed by each."""
        self.classes = exchange(bigrams, classes)
        hot = np.zeros((self.types, classes))
        hot[np.arange(self.types), self.classes] = 1
        self.pairs = hot.T @ bigrams @ hot

    def name_head(self, head: dict[str, tuple[int, int]]) -> None:
        """From now on the words of head (with count and class) are the types of their own."""
        self.head = {w: i for i, w in enumerate(head)}
        self.logs = np.log10(np.array([c for c, _ in head.values()], dtype=float) + 0.5)
        self.of_head = np.array([k for _, k in head.values()], dtype=np.int64)
        self.classes = np.concatenate([self.classes[:2], self.of_head, self.classes[2 + len(self.own) :]])
        self.own = {w: i + 2 for w, i in self.head.items()}
        self.types, self.sets = len(self.classes), None

    def fit(self, pairs: np.ndarray, mass: np.ndarray, words: np.ndarray, back: float = 5.0) -> None:
        """pairs: tokens of class l before class k; mass and words: tokens and distinct words of each class."""
        base = np.where(words > 0, mass + 0.5, 0)
        base = base / max(base.sum(), 1e-300)
        with np.errstate(divide="ignore"):
            self.move = np.log10((pairs + back * base[None]) / (pairs.sum(axis=1, keepdims=True) + back))
        self.share = np.log10(mass + 0.5 * (words + 1))

    def choices(self) -> tuple[np.ndarray, np.ndarray]:
        """(what an occurrence after each class adds to the log likelihood of each class; the same for an ending's class)."""
        mass = self.pairs.sum(axis=0) + 0.5
        step = np.log((self.pairs + mass / mass.sum()) / (self.pairs.sum(axis=1, keepdims=True) + 1)) - np.log(mass)
        n = len(mass)
        ending_of = np.where(np.eye(n, dtype=bool), np.log(0.5), np.log(0.5 / max(1, n - 1)))
        return step, ENDING_WEIGHT * ending_of


#: Bytes of text that are split at once; a longer text is split alone.
GROUP_BYTES = 4_000_000


def _groups(texts: Any) -> Iterator[tuple[Any, np.ndarray, np.ndarray]]:
    """(distinct words, the number among them of each word in a row, how many words each text has) of runs of an Arrow
    array of texts. White space and letters of ASCII are what words_of and fold go by."""
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.fill_null(texts.cast(pa.string()), "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + GROUP_BYTES, "right")))
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.slice(at, to - at)))
        flat, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        # White space at a text's ends leaves empty words.
        full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
        if not full.all():
            sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[full], minlength=len(sizes))
            flat = flat.filter(pa.array(full))
        coded = flat.dictionary_encode()
        yield coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), sizes
        at = to


def _places(words: Any, among: Any) -> np.ndarray:
    """Where each word stands in another Arrow array of words; -1 if nowhere."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.index_in(words, value_set=among), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _before(values: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(what stands before each word, what stands before each text's end), a text beginning after an end."""
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    before = np.concatenate([[end], values])
    last = np.where(sizes > 0, before[cuts[1:]], end)
    before = before[:-1]
    before[cuts[:-1][sizes > 0]] = end
    return before, last


def _after(values: np.ndarray, sizes: np.ndarray, end: int) -> np.ndarray:
    """What stands after each word, an end after a text's last."""
    after = np.concatenate([values[1:], [end]])[: len(values)]
    after[np.cumsum(sizes)[sizes > 0] - 1] = end
    return after


def _met(m: ClassModel, words: Any, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(type, class, class before and class after of each word; class before each end). Neighbours that are no types of
    their own have class -1; such words themselves that of their ending."""
    types = m.types_of(words)[codes]
    at = m.classes[types]
    last = int(m.classes[END])
    known = np.where((types >= 2) & (types < 2 + len(m.own)), at, -1)
    before, at_end = _before(known, sizes, last)
    return types, at, before, _after(known, sizes, last), at_end


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over all texts, combined by task first."""
    name = texts.columns[0]

    def count(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        words: list[Any] = []
        counts: list[np.ndarray] = []

        def out() -> Any:
            coded = pa.concat_arrays(words).dictionary_encode()
            c = np.bincount(coded.indices.to_numpy(zero_copy_only=False), weights=np.concatenate(counts), minlength=len(coded.dictionary))
            words.clear()
            counts.clear()
            return pa.RecordBatch.from_arrays([coded.dictionary, pa.array(c.astype(np.int64))], names=["word", "c"])

        for b in batches:
            for distinct, codes, _ in _groups(b.column(name)):
                words.append(distinct)
                counts.append(np.bincount(codes, minlength=len(distinct)))
                if sum(map(len, words)) > TASK_WORDS:
                    yield out()
        if words:
            yield out()

    return texts.mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def type_bigrams(texts: DataFrame, model: Any) -> np.ndarray:
    """How often each type follows each; a text begins after an end."""
    name = texts.columns[0]

    def count(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa
        from pyspark import TaskContext

        m = ClassModel.of(model.value)
        n = m.types
        total, any_row = np.zeros(n * n, dtype=np.int64), False
        for b in batches:
            for words, codes, sizes in _groups(b.column(name)):
                any_row = True
                seq = np.concatenate([[END], np.insert(m.types_of(words)[codes], np.cumsum(sizes), END)])
                total += np.bincount(seq[:-1] * n + seq[1:], minlength=n * n)
        if any_row:
            parts = np.array_split(total, CHUNKS)
            salt = TaskContext.get().partitionId() % 64
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(range(CHUNKS), pa.int32()), "salt": pa.array([salt] * CHUNKS, pa.int32()), "counts": pa.array([p.tobytes() for p in parts], pa.binary())})

    def add(t: Any) -> Any:
        import pyarrow as pa

        held = sum(np.frombuffer(x, dtype=np.int64) for x in t.column("counts").to_pylist())
        return pa.table({"chunk": t.column("chunk").slice(0, 1).cast(pa.int32()), "salt": pa.array([0], pa.int32()), "counts": pa.array([held.tobytes()], pa.binary())})

    schema = "chunk int, salt int, counts binary"
    rows = texts.mapInArrow(count, schema).groupBy("chunk", "salt").applyInArrow(add, schema).groupBy("chunk").applyInArrow(add, schema).collect()
    n = model.value["types"]
    if not rows:
        return np.zeros((n, n))
    return np.concatenate([np.frombuffer(r["counts"], dtype=np.int64) for r in sorted(rows, key=lambda r: r["chunk"])]).reshape(n, n)


def assign_words(texts: DataFrame, model: ClassModel) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """((word, c, k) of every word that is no type of its own: its count and class; tokens and distinct words of each class)."""
    name = texts.columns[0]
    shipped = texts.sparkSession.sparkContext.broadcast(model.fields())
    n = len(model.pairs)

    def contexts(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        m = ClassModel.of(shipped.value)
        end = int(m.classes[END])
        words: list[Any] = []
        held: list[np.ndarray] = []

        def out() -> Any:
            coded = pa.concat_arrays(words).dictionary_encode()
            keys = np.concatenate(held)
            keys, counts = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[keys // n] * n + keys % n, return_counts=True)
            words.clear()
            held.clear()
            return pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(keys // n)), pa.array((keys % n).astype(np.int32)), pa.array(counts.astype(np.int64))], names=["word", "l", "c"])

        for b in batches:
            for distinct, codes, sizes in _groups(b.column(name)):
                types = m.types_of(distinct)
                before, _ = _before(m.classes[types][codes], sizes, end)
                rest = ((types == OTHER) | (types >= 2 + len(m.own)))[codes]
                held.append(((codes + sum(map(len, words))) * n + before)[rest])
                words.append(distinct)
                if sum(map(len, words)) > TASK_WORDS or sum(map(len, held)) > TASK_TOKENS:
                    yield out()
        if words:
            yield out()

    step, ending_of = model.choices()

    def assign(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        m = ClassModel.of(shipped.value)
        mass, words = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32()]
        names = ["word", "c", "k", "l"]
        for b in batches:
            if not len(b):
                continue
            lists = b.column("x")
            offsets = np.asarray(lists.offsets)
            flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
            first = offsets[:-1] - offsets[0]
            left, count = np.asarray(flat.field("l")).astype(np.int64), np.asarray(flat.field("c"))
            k = np.empty(len(b), dtype=np.int64)
            ends = m.classes[m.types_of(b.column("word"))]
            # A few thousand words at once: a row of `classes` numbers for each context.
            for at in range(0, len(b), 4000):
                lo, hi = first[at], first[at + 4000] if at + 4000 < len(b) else len(left)
                add = np.add.reduceat(count[lo:hi, None] * step[left[lo:hi]], first[at : at + 4000] - lo, axis=0)
                k[at : at + 4000] = (add + ending_of[ends[at : at + 4000]]).argmax(axis=1)
            c = np.add.reduceat(count, first)
            mass += np.bincount(k, weights=c, minlength=n).astype(np.int64)
            words += np.bincount(k, minlength=n)
            yield pa.RecordBatch.from_arrays([b.column("word"), pa.array(c.astype(np.int64)), pa.array(k.astype(np.int32)), pa.nulls(len(k), pa.int32())], names=names)
        # Sums of the task: rows without a word; l is -1 for tokens, -2 for distinct words of a class.
        rows = [(int(v), y, of) for of, vs in ((-1, mass), (-2, words)) for y, v in enumerate(vs) if v]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.nulls(len(rows), pa.string())] + [pa.array([int(r[i]) for r in rows], kinds[i + 1]) for i in range(3)], names=names)

    seen = texts.mapInArrow(contexts, "word string, l int, c long").groupBy("word", "l").agg(F.sum("c").alias("c"))
    seen = seen.groupBy("word").agg(F.collect_list(F.struct("l", "c")).alias("x"))
    both = store(seen.mapInArrow(assign, "word string, c long, k int, l int"), "lm-words")
    sums = both.where(F.col("word").isNull()).groupBy("l", "k").agg(F.sum("c").alias("c")).collect()
    mass, words = np.zeros(n), np.zeros(n)
    for r in sums:
        (mass if r["l"] == -1 else words)[r["k"]] += r["c"]
    return both.where(F.col("word").isNotNull()).select("word", "c", "k"), mass, words


def class_pairs(texts: DataFrame, model: ClassModel, rare: DataFrame) -> np.ndarray:
    """How often each class follows each in all texts, every word going by its own: those of the model's head, and of rare."""
    name = texts.columns[0]
    shipped = texts.sparkSession.sparkContext.broadcast(model.fields())
    n = len(model.pairs)

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        m = ClassModel.of(shipped.value)
        last = int(m.classes[END])
        total = np.zeros(n * n, dtype=np.int64)
        names = ["word", "l", "r", "p", "c"]
        for b in batches:
            for words, codes, sizes in _groups(b.column(name)):
                types, at, before, after, at_end = _met(m, words, codes, sizes)
                there = (types >= 2) & (types < 2 + len(m.own))
                both = there & (before >= 0)
                total += np.bincount(np.concatenate([before[both] * n + at[both], at_end[at_end >= 0] * n + last]), minlength=n * n)
                tail = np.flatnonzero(~there)
                ahead = words.take(pa.array(codes[tail - 1], mask=before[tail] >= 0))
                yield pa.RecordBatch.from_arrays([words.take(pa.array(codes[tail])), *[pa.array(x[tail].astype(np.int32)) for x in (before, after)], ahead, pa.array(np.ones(len(tail), dtype=np.int64))], names=names)
        l, r = np.divmod(np.flatnonzero(total), n)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(l), pa.string()), pa.array(l.astype(np.int32)), pa.array(r.astype(np.int32)), pa.nulls(len(l), pa.string()), pa.array(total[total > 0])], names=names)

    rows = store(texts.mapInArrow(run, "word string, l int, r int, p string, c long"), "lm-pairs")
    own = rare.select("word", "k")
    add = lambda df: df.groupBy("l", "r").agg(F.sum("c").alias("c"))
    beside = rows.where(F.col("word").isNotNull() & ((F.col("l") >= 0) | (F.col("r") >= 0))).join(own, "word").groupBy("l", "k", "r").agg(F.sum("c").alias("c"))
    sides = F.array(F.struct("l", F.col("k").alias("r")), F.struct(F.col("k").alias("l"), "r"))
    beside = beside.select(F.explode(sides).alias("x"), "c").select("x.l", "x.r", "c").where((F.col("l") >= 0) & (F.col("r") >= 0))
    among = rows.where(F.col("p").isNotNull()).join(own.select(F.col("word").alias("p"), F.col("k").alias("before")), "p").join(own, "word").select(F.col("before").alias("l"), F.col("k").alias("r"), "c")
    known = rows.where(F.col("word").isNull()).select("l", "r", "c")
    out = np.zeros((n, n))
    for x in add(add(known).unionByName(add(beside)).unionByName(add(among))).collect():
        out[x["l"], x["r"]] = x["c"]
    discard(rows)
    return out


def train(texts: DataFrame) -> tuple[ClassModel, DataFrame]:
    """The model, and the counts and classes of the words that are too rare for its head."""
    spark = texts.sparkSession
    small_batches(spark)
    counts = store(word_counts(texts), "lm-counts")
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    ends = texts.count()
    own_rows = counts.orderBy(F.desc("c"), "word").limit(OWN_TYPES).collect()
    own = [r["word"] for r in own_rows]
    kept = F.broadcast(spark.createDataFrame([(w,) for w in own], "word string"))
    by_end = counts.join(kept, "word", "left_anti").groupBy(F.substring("word", -2, 2).alias("e")).agg(F.sum("c").alias("c"))
    shared = sorted(r["e"] for r in by_end.orderBy(F.desc("c"), "e").limit(SHARED_TYPES).collect())
    discard(counts)
    model = ClassModel(own, shared, sums["n"] + ends, sums["v"] + (ends > 0), ends)
    model.cluster(type_bigrams(texts, spark.sparkContext.broadcast(model.fields())))
    words, mass, distinct = assign_words(texts, model)
    # Own words and the end have the classes of their types.
    fixed = np.array([ends, 0, *[r["c"] for r in own_rows]], dtype=float)
    there = np.array([ends > 0, False, *[True] * len(own)])
    at = model.classes[: len(fixed)]
    mass += np.bincount(at, weights=fixed, minlength=len(mass))
    distinct += np.bincount(at, weights=there, minlength=len(mass))
    # The least count that at most HEAD_WORDS words reach, by steps of an eighth of an octave.
    step = F.floor(F.log2("c") * 8)
    left, bar = HEAD_WORDS, None
    for r in sorted(words.groupBy(step.alias("s")).count().collect(), key=lambda r: -r["s"]):
        left -= r["count"]
        if left < 0:
            break
        bar = r["s"]
    head = {r["word"]: (r["c"], model.classes[model.own[r["word"]]]) for r in own_rows}
    head |= {r["word"]: (r["c"], r["k"]) for r in words.where(step >= bar).collect()} if bar is not None else {}
    rare = words.where(step < bar) if bar is not None else words
    model.name_head(head)
    model.fit(class_pairs(texts, model, rare), mass, distinct)
    return model, rare


def score(docs: DataFrame, model: ClassModel, rare: DataFrame, *, text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """carry columns with n_tokens, n_known, base_score and score (log10) of each row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    shipped = spark.sparkContext.broadcast(model.fields())
    names = ["rid", "n_tokens", "n_known", "base", "own", "rare"]

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa
        from pyspark import TaskContext

        m = ClassModel.of(shipped.value)
        end = float(np.log10(m.ends + 0.5))
        last = int(m.classes[END])
        emit = m.logs - m.share[m.of_head]
        rid = TaskContext.get().partitionId() << 36
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        for batch in batches:
            start = 0
            for words, codes, sizes in _groups(batch.column("text")):
                types, own, before, after, at_end = _met(m, words, codes, sizes)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                there = (types >= 2) & (types < 2 + len(m.own))
                at, of = types[there] - 2, doc[there]
                by_text = lambda v, d=of, k=len(sizes): np.bincount(d, weights=v, minlength=k)
                in_head = by_text(m.logs[at])
                steps = by_text(np.where(before[there] >= 0, m.move[before[there], own[there]], 0) + emit[at]) + np.where(at_end >= 0, m.move[at_end, last], 0) + end - m.share[last]
                known_words = np.bincount(of, minlength=len(sizes)) + int(m.ends > 0)
                # What only the joined counts and classes can tell: words outside the head, and steps from and to them.
                tail = np.flatnonzero(~there)
                ahead = pa.array(codes[tail - 1], mask=before[tail] >= 0)
                numbers = (before[tail], own[tail], after[tail], own[tail - 1])
                found = pa.StructArray.from_arrays([words.take(pa.array(codes[tail])), words.take(ahead), *[pa.array(x.astype(np.int32)) for x in numbers]], names=["w", "p", "l", "k", "r", "pk"])
                cuts = np.cumsum(np.concatenate([[0], np.bincount(doc[tail], minlength=len(sizes))]))
                values = (rid + np.arange(len(sizes)), sizes + 1, known_words, in_head + end - (sizes + 1) * m.whole, steps)
                arrays = [batch.column("carried").slice(start, len(sizes)), *[pa.array(v, k) for v, k in zip(values, kinds, strict=True)], pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), found)]
                yield pa.RecordBatch.from_arrays(arrays, names=["carried", *names])
                rid += len(sizes)
                start += len(sizes)

    taken = {"n_tokens", "n_known", "base_score", "score"}
    kept = docs.select(F.struct(F.lit(True).alias("row"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]).alias("carried"), F.col(text).alias("text"))
    schema = f"carried {kept.schema['carried'].dataType.simpleString()}, rid long, n_tokens long, n_known long, base double, own double, rare array<struct<w:string,p:string,l:int,k:int,r:int,pk:int>>"
    # Row ids are given once: they are read from the table, never made anew.
    rows = store(kept.mapInArrow(run, schema), "lm-rows")
    # Numbers written out as text make one literal.
    numbers = lambda x: F.split(F.lit(",".join(map(repr, x.ravel().tolist()))), ",").cast("array<double>")
    move, share, none = numbers(model.move), numbers(model.share), F.lit(0.0)
    step = lambda l, k: F.when((l >= 0) & (k >= 0), F.get(move, l * len(model.move) + k)).otherwise(none)
    tail = rows.select("rid", F.explode("rare").alias("x")).select("rid", F.col("x.w").alias("word"), "x.p", "x.l", F.col("x.k").alias("by_end"), "x.r", "x.pk")
    met = tail.select("rid", "word", "l", "by_end", "r").join(rare, "word", "left").withColumn("k", F.coalesce("k", "by_end"))
    log = F.log10(F.coalesce("c", F.lit(0)) + 0.5)
    met = met.select("rid", log.alias("t"), (log - F.get(share, F.col("k")) + step(F.col("l"), F.col("k")) + step(F.col("k"), F.col("r"))).alias("u"), F.col("c").isNotNull().cast("int").alias("m"))
    # Two words outside the head, one after the other.
    pairs = tail.where(F.col("p").isNotNull()).select("rid", "word", "p", "by_end", "pk").join(rare.select(F.col("word").alias("p"), F.col("k").alias("l")), "p", "left").join(rare.select("word", "k"), "word", "left")
    pairs = pairs.select("rid", none.alias("t"), step(F.coalesce("l", "pk"), F.coalesce("k", "by_end")).alias("u"), F.lit(0).alias("m"))
    met = met.unionByName(pairs).groupBy("rid").agg(F.sum("t").alias("t"), F.sum("u").alias("u"), F.sum("m").alias("m"))
    both = rows.drop("rare").join(met, "rid", "left")
    named = [F.col(f"carried.c{i}").alias(f"_{c}" if c.lower() in taken else c) for i, c in enumerate(carry)]
    return both.select(*named, "n_tokens", (F.col("n_known") + F.coalesce("m", F.lit(0))).alias("n_known"), (F.col("base") + F.coalesce("t", none)).alias("base_score"), (F.col("own") + F.coalesce("u", none)).alias("score"))


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, rare = train(docs.where(~held_out(F.col("doc_id"), 5, 1)).select("text"))
    scored = score(docs, model, rare, carry=("doc_id",))
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 1).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
