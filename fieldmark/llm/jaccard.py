"""N-gram Jaccard join by multiple global orders.

A document's set is its distinct word n-grams, hashed to 64 bits. Documents with equal sets form a class, combined before
any shuffle; the join runs over classes. For a threshold t, two sets that link share an element among the first
n - ceil(t n) + 1 of each under any global order of elements. Two orders are used, by two independent hashed counts of
all elements of all documents, rare ones first; a pair must meet under both, and their bitmaps, which bound the overlap
from above, must be near enough, before it is verified on the sets.

Pairs come from posting lists of the first order. First all of a list are paired with one member drawn by hash; then, for
a few rounds, what lies outside the component of the list's best linked member is paired with that member, so a large
group of near copies falls into one component with a number of pairs linear in its size. What then still lies outside a
list's main component is paired with every member of another component. Pairs within a component need no test, so
components are exact while no group is expanded into all its pairs.

Edge cases: null and empty texts have an empty set (0 shingles) and link with nothing; texts of fewer words than n are
one shingle; repeated rows are copies of each other; rows with a null id link like all others and hold components
together, but never name one (a component of such rows only is null); sets are told apart and compared by 64-bit hashes
of their elements; an empty table gives an empty result; other columns do not matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.llm._base import discard, free_shuffles, fresh_name, quoted, small_batches, store, table, texts_of
from fieldmark.operators.graph import components

#: Rounds in which lists are linked to one member before what is left is tested in full.
STAR_ROUNDS = 1
#: Lists of at least so many classes are tested in tiles: blocks of what is outside the main component by blocks of all.
LONG = 128
TILE_REST, TILE_ALL = 256, 2048
#: Ids of up to so many candidate classes (16 bytes each) are broadcast to pick their texts; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
CHUNKS = 64
_MULT = np.random.default_rng(41).integers(1, 2**63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray, by: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(by)
    return h ^ (h >> np.uint64(29))


#: Bytes of text that are hashed at once; a longer text is hashed alone.
HASH_BYTES = 1 << 20
_GAP = np.zeros(256, dtype=bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E6C63D0876A9A47


class _Powers:
    """Powers of an odd base and of its inverse, modulo 2**64, as far as they have been needed."""

    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(cls.up) < n:
            k = len(cls.up)
            cls.up = np.concatenate([cls.up, cls.up * np.uint64(pow(_BASE, k, 1 << 64))])
            cls.down = np.concatenate([cls.down, cls.down * np.uint64(pow(pow(_BASE, -1, 1 << 64), k, 1 << 64))])
        return cls.up, cls.down


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, 64-bit hash) of each word: a polynomial of its bytes, taken from sums over all bytes."""
    b = np.frombuffer(data, dtype=np.uint8)
    gap = _GAP[b]
    edge = np.flatnonzero(np.diff(gap, prepend=True, append=True))
    start, end = edge[::2], edge[1::2]
    up, down = _Powers.of(len(b) + 1)
    sums = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=sums[1:])
    return start, _mix((sums[end] - sums[start]) * down[start])


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word n-grams; of a text of fewer words, the one of them all."""
    out: list[np.ndarray] = []
    held: list[bytes] = []
    size = 0

    def flush() -> None:
        if not held:
            return
        ends = np.cumsum([len(x) + 1 for x in held])
        start, w = word_hashes(b"\n".join(held))
        first = np.concatenate([[0], np.searchsorted(start, ends)])
        h = np.full(max(0, len(w) - n + 1), n, dtype=np.uint64)
        for i in range(n):
            h += w[i : i + len(h)] * _MULT[i & 63]
        h = _mix(h)
        for a, z in zip(first[:-1], first[1:], strict=True):
            if z - a >= n:
                s = np.sort(h[a : z - n + 1])
                out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
            elif z > a:
                own = np.uint64(z - a) + (w[a:z] * _MULT[: z - a]).sum(dtype=np.uint64)
                out.append(_mix(np.array([own], dtype=np.uint64)))
            else:
                out.append(np.empty(0, dtype=np.uint64))
        held.clear()

    for t in texts:
        data = (t or "").encode().lower()
        if size + len(data) > HASH_BYTES:
            flush()
            size = 0
        held.append(data)
        size += len(data) + 1
    flush()
    return out


def signature(s: np.ndarray) -> int:
    """64 bits that name a set."""
    if not len(s):
        return 0
    parts = np.array([len(s), s.sum(dtype=np.uint64), np.bitwise_xor.reduce(_mix(s, 0xC2B2AE3D27D4EB4F))], dtype=np.uint64)
    return int((_mix(parts * _MULT[:3]).sum(dtype=np.uint64)).astype(np.int64))


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


class Orders:
    """Two global orders of shingles: by two independent hashed counts of the corpus, rare ones first; ties by hash.

    A cell's count is at least the shingle's own frequency, so frequent shingles come last in both; among rare ones the
    orders differ, for the other shingles of a cell do.
    """

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.shift = np.uint64(64 - (len(first).bit_length() - 1))
        self.counts = (first.astype(np.uint32), second.astype(np.uint32))

    def prefix(self, s: np.ndarray, length: int, second: bool) -> np.ndarray:
        """The first elements of a set, themselves in no order. Ties of counts are broken by halves of hashes, then by whole ones."""
        if length >= len(s):
            return s
        key = _mix(s, _SECOND) if second else s
        rank = (self.counts[second][key >> self.shift].astype(np.uint64) << np.uint64(32)) | (key & np.uint64(0xFFFFFFFF))
        last = np.partition(rank, length - 1)[length - 1]
        inside, tied = s[rank < last], np.flatnonzero(rank == last)
        return np.concatenate([inside, s[tied[np.argsort(key[tied])[: length - len(inside)]]]])


_SECOND = 0x165667B19E3779F9


def sketch(docs: DataFrame, key: str, text: str, n: int) -> tuple[DataFrame, tuple[np.ndarray, np.ndarray]]:
    """One pass over the texts: (id, node, n) of each document, the set's name and size; and how many of all documents'
    shingles fall in each of a number of hash cells (2**18 to 2**22, by document count), under two hashes. Tasks' counts
    stop at 65535 a cell, which is frequent enough to come last."""
    rows = docs.count()
    bits = min(22, max(18, (rows * 8).bit_length() - 1))
    cells, shift, width = 1 << bits, np.uint64(64 - bits), (1 << bits) // CHUNKS
    names = ["id", "node", "n", "chunk", "salt", "counts"]

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import zlib

        import pyarrow as pa
        from pyspark import TaskContext

        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        counts = np.zeros((2, cells), dtype=np.int64)
        held: list[np.ndarray] = []

        def add() -> None:
            all_of = np.concatenate(held)
            counts[0] += np.bincount((all_of >> shift).astype(np.int64), minlength=cells)
            counts[1] += np.bincount((_mix(all_of, _SECOND) >> shift).astype(np.int64), minlength=cells)
            held.clear()

        def batch(columns: list[Any], size: int) -> Any:
            return pa.RecordBatch.from_arrays([pa.nulls(size, k) if c is None else c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for b in batches:
            for part, texts in texts_of(b, "text"):
                sets = shingle_sets(texts, n)
                yield batch([part.column("id"), [signature(s) for s in sets], [len(s) for s in sets], None, None, None], len(sets))
                held += sets
                if sum(map(len, held)) > cells:
                    add()
        if held:
            add()
        if counts.any():
            salt = TaskContext.get().partitionId() % 64
            small = np.minimum(counts, 65535).astype(np.uint16)
            parts = [zlib.compress(small[:, i * width : (i + 1) * width].tobytes(), 1) for i in range(CHUNKS)]
            yield batch([None, None, None, list(range(CHUNKS)), [salt] * CHUNKS, parts], CHUNKS)

    def total(t: Any) -> Any:
        import zlib

        import pyarrow as pa

        held = np.zeros(2 * width, dtype=np.uint32)
        for x in t.column("counts").to_pylist():
            raw = zlib.decompress(x)
            held += np.frombuffer(raw, dtype=np.uint16 if len(raw) == 4 * width else np.uint32)
        return pa.table({"chunk": t.column("chunk").slice(0, 1).cast(pa.int32()), "salt": pa.array([0], pa.int32()), "counts": pa.array([zlib.compress(held.tobytes(), 1)], pa.binary())})

    import zlib

    both = store(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, node long, n long, chunk int, salt int, counts binary"), "join-sketch")
    schema = "chunk int, salt int, counts binary"
    sums = both.where(F.col("chunk").isNotNull()).select("chunk", "salt", "counts").groupBy("chunk", "salt").applyInArrow(total, schema).groupBy("chunk").applyInArrow(total, schema)
    out = np.zeros((2, cells), dtype=np.uint32)
    for r in sums.collect():
        out[:, r["chunk"] * width : (r["chunk"] + 1) * width] = np.frombuffer(zlib.decompress(r["counts"]), dtype=np.uint32).reshape(2, width)
    own = store(both.where(F.col("chunk").isNull()).select("id", "node", "n"), "join-own")
    discard(both)
    return own, (out[0], out[1])


def parity(s: np.ndarray) -> bytes:
    """A set's bitmap: bit h mod b is whether an odd number of elements fall there; b is a power of two not below the
    set's size. The bitmap of half the length is the exclusive or of the halves."""
    b = max(64, 1 << max(0, len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & np.uint64(b - 1)).astype(np.int64), minlength=b).astype(np.uint8) & 1, bitorder="little").tobytes()


def _fold(bits: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) cut to `width` words."""
    return np.bitwise_xor.reduce(bits.reshape(len(bits), -1, width), axis=1)


def enough(shared: Any, a: Any, b: Any, num: int, den: int) -> Any:
    return den * shared >= num * (a + b - shared)


def possible(x: bytes, y: bytes, a: int, b: int, num: int, den: int) -> bool:
    """Whether sets of sizes a and b with these bitmaps may overlap enough: every bit that differs is an element of one only."""
    u, v = np.frombuffer(x, np.uint64)[None], np.frombuffer(y, np.uint64)[None]
    width = min(u.shape[1], v.shape[1])
    apart = int(np.bitwise_count(_fold(u, width) ^ _fold(v, width)).sum())
    return enough((a + b - apart) // 2, a, b, num, den)


def describe(docs: DataFrame, key: str, text: str, n: int, num: int, den: int, orders: Any) -> DataFrame:
    """(id, node, n, prefix, second, bits): the set's name, its size, its prefixes under both orders (of the second's
    elements the upper halves, which share an element if the prefixes do) and its bitmap; of texts with words only."""

    def lists(parts: list[np.ndarray], kind: Any) -> Any:
        import pyarrow as pa

        offsets = pa.array(np.concatenate([[0], np.cumsum([len(h) for h in parts])]), pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(parts), kind))

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        order = Orders(*orders.value)
        for b in batches:
            for part, texts in texts_of(b, "text"):
                sets = shingle_sets(texts, n)
                size = [prefix_length(len(s), num, den) if len(s) else 0 for s in sets]
                one = [order.prefix(s, m, False).astype(np.int64) for s, m in zip(sets, size, strict=True)]
                two = [(order.prefix(s, m, True) >> np.uint64(32)).astype(np.uint32).astype(np.int32) for s, m in zip(sets, size, strict=True)]
                cols = [part.column("id"), pa.array([signature(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), lists(one, pa.int64()), lists(two, pa.int32()), pa.array([parity(s) for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "node", "n", "prefix", "second", "bits"]).filter(pa.array([len(s) > 0 for s in sets], pa.bool_()))

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, node long, n long, prefix array<long>, second array<int>, bits binary")


def _bounded(df: DataFrame) -> DataFrame:
    """df, which is stored, marked for broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _candidates(docs: DataFrame, wanted: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """(node, hashes) of the wanted classes (node, rep), from the text of the document rep: the sorted set."""
    side = _bounded(wanted).select(F.col("rep").alias("_rep"), F.col("node").alias("_node"))
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    rows = rows.join(side, F.col("id") == F.col("_rep")).select(F.col("_node").alias("node"), "text")

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        for b in batches:
            for part, texts in texts_of(b, "text"):
                out: list[list[Any]] = [[], []]
                for node, s in zip(part.column("node").to_pylist(), shingle_sets(texts, n), strict=True):
                    # Another text may bear the same id.
                    if signature(s) == node:
                        out[0].append(node)
                        out[1].append(s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary())], names=["node", "hashes"])

    return rows.mapInArrow(run, "node long, hashes binary")


def _overlapping(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) of the pairs whose sets overlap enough."""

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        for batch in batches:
            kept = []
            for u, v in zip(batch.column("x"), batch.column("y"), strict=True):
                u, v = np.frombuffer(u.as_py(), np.uint64), np.frombuffer(v.as_py(), np.uint64)
                both = np.concatenate([u, v])
                both.sort(kind="stable")
                kept.append(bool(enough(int((both[1:] == both[:-1]).sum()), len(u), len(v), num, den)))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(kept, pa.bool_()))

    a, b = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


class _Verifier:
    """Verifies pairs of classes; a class's set is read from its text once, when a pair of it first passes all filters."""

    def __init__(self, docs: DataFrame, reps: DataFrame, key: str, text: str, n: int, num: int, den: int, repeated: bool):
        self.docs, self.reps, self.at, self.num, self.den, self.repeated = docs, reps, (key, text, n), num, den, repeated
        self.sets: DataFrame | None = None
        self.held: list[DataFrame] = []

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        """df stored until all is done."""
        self.held.append(store(df, label))
        return self.held[-1]

    def verify(self, met: DataFrame) -> DataFrame:
        """(a, b) of the stored pairs whose sets overlap enough."""
        num, den = self.num, self.den
        nodes = met.select(F.col("a").alias("node")).unionByName(met.select(F.col("b").alias("node"))).distinct()
        if self.sets is not None:
            nodes = nodes.join(self.sets.select("node"), "node", "left_anti")
        wanted = self.keep(self.reps.select("node", "rep").join(nodes, "node"), "join-wanted")
        fresh = _candidates(self.docs, wanted, *self.at)
        # Where rows share an id, a class may be read from several of them.
        fresh = self.keep(fresh.dropDuplicates(["node"]) if self.repeated else fresh, "join-sets")
        self.sets = fresh if self.sets is None else self.sets.unionByName(fresh)
        return self.keep(_overlapping(met, self.sets, num, den), "join-links")

    def links(self, pairs: DataFrame) -> DataFrame:
        """(a, b) of the stored pairs whose prefixes meet under the second order too, whose bitmaps are near enough and whose sets overlap enough."""
        num, den = self.num, self.den
        nodes = self.keep(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "join-nodes")
        own = self.reps.select("node", "n", "second", "bits").join(_bounded(nodes), "node", "left_semi")
        side = lambda c: own.select(F.col("node").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in ("n", "second", "bits")])
        met = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").where(F.arrays_overlap("a_second", "b_second"))

        def run(batches: Iterator[Any]) -> Iterator[Any]:
            import pyarrow as pa

            for batch in batches:
                kept = [possible(x, y, n, m, num, den) for x, y, n, m in zip(*(batch.column(c).to_pylist() for c in ("a_bits", "b_bits", "a_n", "b_n")), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(kept, pa.bool_()))

        return self.verify(self.keep(met.select("a", "b", "a_n", "b_n", "a_bits", "b_bits").mapInArrow(run, "a long, b long"), "join-met"))

    def tiles(self, lists: DataFrame) -> DataFrame:
        """(a, b) of the links between classes outside their list's main component and classes of other components.

        lists: tok, node, root, main. A tile has a block of a list's outside and a block of all its members, so what is
        sent grows with blocks, not with pairs; a pair passes the same filters here.
        """
        num, den = self.num, self.den
        sizes = lists.groupBy("tok").agg(F.ceil(F.count_if(F.col("root") != F.col("main")) / TILE_REST).alias("nr"), F.ceil(F.count(F.lit(1)) / TILE_ALL).alias("na"))
        own = lists.join(self.reps.select("node", "n", "second", "bits"), "node").join(sizes, "tok")
        block = lambda of: F.pmod(F.xxhash64("node", F.lit(5)), of).cast("int")
        what = ("node", "root", "n", "second", "bits")
        cols = ["tok", "i", "j", *what]
        rest = own.where((F.col("root") != F.col("main")) & (F.col("nr") > 0)).withColumn("i", block(F.col("nr"))).withColumn("j", F.explode(F.sequence(F.lit(0), (F.col("na") - 1).cast("int")))).select(*[F.col(c).alias(f"rest_{c}") for c in cols])
        every = own.where(F.col("nr") > 0).withColumn("j", block(F.col("na"))).withColumn("i", F.explode(F.sequence(F.lit(0), (F.col("nr") - 1).cast("int")))).select(*cols)

        def tile(left: Any, right: Any) -> Any:
            import pyarrow as pa

            out: list[list[Any]] = [[], []]
            if len(left) and len(right):
                seconds = [np.array(x, np.int32) for x in right.column("second").to_pylist()]
                nodes, roots, sizes = (right.column(c).to_numpy() for c in ("node", "root", "n"))
                where = np.repeat(np.arange(len(nodes)), [len(x) for x in seconds])
                known, place = np.unique(np.concatenate(seconds), return_inverse=True)
                hit = np.zeros(len(known) + 1, dtype=bool)
                bits = [np.frombuffer(x, np.uint64) for x in right.column("bits").to_pylist()]
                widths = np.array([len(x) for x in bits])
                alike = {w: np.flatnonzero(widths == w) for w in np.unique(widths).tolist()}
                maps = {(w, w): np.stack([bits[k] for k in at]) for w, at in alike.items()}
                for node, root, n, second, own_bits in zip(*(left.column(f"rest_{c}").to_pylist() for c in what), strict=True):
                    x, y = np.frombuffer(own_bits, np.uint64)[None], np.array(second, np.int32)
                    at = np.searchsorted(known, y)
                    at = at[known[np.minimum(at, len(known) - 1)] == y]
                    hit[at] = True
                    meet = np.bincount(where[hit[place]], minlength=len(nodes)) > 0
                    hit[at] = False
                    apart = np.zeros(len(nodes), dtype=np.int64)
                    for w, of in alike.items():
                        least = min(w, x.shape[1])
                        if (w, least) not in maps:
                            maps[w, least] = _fold(maps[w, w], least)
                        apart[of] = np.bitwise_count(maps[w, least] ^ _fold(x, least)).sum(axis=1)
                    for k in np.flatnonzero(meet & (roots != root) & enough(np.minimum((n + sizes - apart) // 2, np.minimum(n, sizes)), n, sizes, num, den)):
                        out[0].append(min(node, int(nodes[k])))
                        out[1].append(max(node, int(nodes[k])))
            return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

        keys = ("tok", "i", "j")
        met = rest.groupBy(*[f"rest_{k}" for k in keys]).cogroup(every.groupBy(*keys)).applyInArrow(tile, "a long, b long").distinct()
        return self.verify(self.keep(met, "join-met"))


def _ordered(u: Any, v: Any) -> list[Any]:
    return [F.least(u, v).alias("a"), F.greatest(u, v).alias("b")]


def _mixed(posts: DataFrame, roots: DataFrame) -> DataFrame:
    """Postings with the root of each, of the lists that hold more than one root, and the list's most frequent root."""
    at = posts.join(roots, "node", "left").select("tok", "node", "n", F.coalesce("root", "node").alias("root"))
    sizes = at.groupBy("tok", "root").agg(F.count(F.lit(1)).alias("c"))
    main = sizes.groupBy("tok").agg(F.max(F.struct("c", "root")).alias("m"), F.count(F.lit(1)).alias("roots")).where(F.col("roots") > 1)
    return at.join(main.select("tok", F.col("m.root").alias("main")), "tok")


def classes_and_links(docs: DataFrame, *, key: str = "doc_id", text: str = "text", n: int = 5, num: int = 80, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """((id, node, n) of each document, (node, root) of the classes that link with another)."""
    spark = docs.sparkSession
    small_batches(spark)
    own, counts = sketch(docs, key, text, n)
    keyed = own
    if own.where(F.col("id").isNull() & (F.col("n") > 0)).limit(1).count():
        # Rows without id are found again by their texts' hashes.
        docs = docs.select(F.coalesce(F.col(quoted(key)).cast("long"), F.xxhash64(quoted(text))).alias("_key"), F.col(quoted(text)).alias("_text"))
        key, text = "_key", "_text"
        keyed = sketch(docs, key, text, n)[0]
    orders = spark.sparkContext.broadcast(counts)
    # A class is described by its document of least id.
    first = keyed.where((F.col("n") > 0) & F.col("id").isNotNull()).groupBy("node").agg(F.min("id").alias("id"))
    others = store(keyed.where(F.col("id").isNotNull()).join(first, ["id", "node"], "left_anti").select("id", "node").distinct(), "join-others")
    repeated = keyed.groupBy("id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").limit(1).count() > 0
    reps = describe(docs, key, text, n, num, den, orders).where(F.col("id").isNotNull()).join(_bounded(others), ["id", "node"], "left_anti")
    reps = store((reps.dropDuplicates(["node"]) if repeated else reps).withColumnRenamed("id", "rep"), "join-classes")
    free_shuffles(spark)
    posts = reps.select("node", F.col("n").cast("int").alias("n"), F.explode("prefix").alias("tok"))
    # Names of sets are hashes, so the least of a list is drawn at random, and alike in lists that share members.
    lists = posts.groupBy("tok").agg(F.count(F.lit(1)).alias("len"), F.min("node").alias("lead")).where(F.col("len") > 1)
    verifier = _Verifier(docs, reps, key, text, n, num, den, repeated)
    posts = verifier.keep(posts.join(lists.select("tok", "lead", "len"), "tok"), "join-posts")
    free_shuffles(spark)
    fits = lambda x, y: F.least(x, y) * den >= F.greatest(x, y) * num
    star = posts.where(F.col("node") != F.col("lead")).select("node", "lead", "n").distinct()
    sizes = reps.select(F.col("node").alias("lead"), F.col("n").alias("lead_n"))
    tested = verifier.keep(star.join(sizes, "lead").where(fits(F.col("n"), F.col("lead_n"))).select(*_ordered(F.col("node"), F.col("lead"))).distinct(), "join-pairs")
    links = verifier.links(tested)
    roots = components(links)

    def done() -> tuple[DataFrame, DataFrame]:
        discard(reps, others, *verifier.held)
        free_shuffles(spark)
        return own, roots

    # The pairs of lists of two are all tested.
    posts = posts.where(F.col("len") > 2).select("tok", "node", "n")
    for turn in range(STAR_ROUNDS):
        free_shuffles(spark)
        # Again with each list's best linked member and with one drawn from its main component, list by list, for what
        # is still outside.
        mixed = verifier.keep(_mixed(posts, roots), "join-mixed")
        if not mixed.limit(1).count():
            return done()
        ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("deg"))
        ranked = mixed.join(ends, "node", "left").withColumn("deg", F.coalesce("deg", F.lit(0)))
        own_hash = F.xxhash64("node", "tok", F.lit(turn))
        best = F.max(F.struct("deg", own_hash.alias("h"), "node", "n", "root"))
        drawn = F.max(F.struct((F.col("root") == F.col("main")).alias("deg"), own_hash.alias("h"), "node", "n", "root"))
        lead = ranked.groupBy("tok").agg(best.alias("best"), drawn.alias("drawn"))
        lead = lead.select("tok", F.explode(F.array(*[F.struct(F.col(f"{c}.node").alias("node"), F.col(f"{c}.n").alias("n"), F.col(f"{c}.root").alias("root")) for c in ("best", "drawn")])).alias("l"))
        more = mixed.join(lead, "tok").where((F.col("root") != F.col("l.root")) & fits(F.col("n"), F.col("l.n"))).select(*_ordered(F.col("node"), F.col("l.node"))).distinct()
        more = verifier.keep(more.join(tested, ["a", "b"], "left_anti"), "join-pairs")
        found = verifier.links(more)
        tested = tested.unionByName(more)
        if not found.limit(1).count():
            break
        links = links.unionByName(found)
        roots = components(links)
    free_shuffles(spark)
    # What is left is tested in full: all outside a list's main component against all of other components. Long lists
    # are tested in tiles.
    mixed = verifier.keep(_mixed(posts, roots), "join-mixed")
    lengths = mixed.groupBy("tok").agg(F.count(F.lit(1)).alias("len"))
    long = verifier.keep(mixed.join(lengths.where(F.col("len") >= LONG).select("tok"), "tok"), "join-long")
    found = [verifier.tiles(long.select("tok", "node", "root", "main"))] if long.limit(1).count() else []
    short = mixed.join(lengths.where(F.col("len") < LONG).select("tok"), "tok")
    every = short.select("tok", *[F.col(c).alias(f"{c}2") for c in ("node", "n", "root")])
    met = short.where(F.col("root") != F.col("main")).join(every, "tok")
    both = (F.col("root") != F.col("root2")) & fits(F.col("n"), F.col("n2")) & ((F.col("root2") == F.col("main")) | (F.col("node") < F.col("node2")))
    met = met.where(both).select(*_ordered(F.col("node"), F.col("node2"))).distinct()
    rest = verifier.keep(met.join(tested, ["a", "b"], "left_anti"), "join-pairs")
    for more in [*found, verifier.links(rest)]:
        links = links.unionByName(more)
    roots = components(links)
    return done()


def component_ids(own: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, node, n, component_id) of each document; those without shingles are alone."""
    named = own.where(F.col("n") > 0).groupBy("node").agg(F.min("id").alias("rep")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_node = named.join(least, "root").select("node", "component_id")
    return own.join(by_node, "node", "left").select("id", "node", "n", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, roots = classes_and_links(table(spark, sf_dir, "documents"), n=3, num=90, den=100)
    return component_ids(own, roots).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near copies (five words, 0.8) the document of least id stays; the columns of docs.

    Rows without words or without id stay. Of rows equal in id and set, one stays.
    """
    own, roots = classes_and_links(docs, n=5, num=80, den=100)
    ids = store(component_ids(own, roots), "dedup-ids")
    repeated = ids.where((F.col("n") > 0) & F.col("id").isNotNull()).groupBy("id").count().where("count > 1").limit(1).count()
    gone = ids.where((F.col("n") > 0) & F.col("id").isNotNull() & (F.col("id") != F.col("component_id"))).select("id", "node").distinct()
    gone = store(gone, "dedup-gone")
    side = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    if not repeated:
        mark = fresh_name(docs, "_dedup_id")
        return docs.withColumn(mark, F.col("doc_id").cast("long")).join(side.select(F.col("id").alias(mark)), mark, "left_anti").select(*[quoted(c) for c in docs.columns])
    node, mark = fresh_name(docs, "_dedup_node"), fresh_name(docs, "_dedup_id")
    marked = docs.withColumn(node, _node_udf(5)(F.col("text"))).withColumn(mark, F.col("doc_id").cast("long"))
    left = marked.join(side.select(F.col("id").alias(mark), F.col("node").alias(node)), [mark, node], "left_anti")
    alone = left.where(F.col(mark).isNull() | (F.col(node) == 0))
    once = left.where(F.col(mark).isNotNull() & (F.col(node) != 0)).dropDuplicates([mark, node])
    return once.unionByName(alone).select(*[quoted(c) for c in docs.columns])


def _node_udf(n: int) -> Any:
    import pyarrow as pa

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([signature(s) for s in shingle_sets(b.to_pylist(), n)], pa.int64())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "long")


ORACLE_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM t),
c AS MATERIALIZED (SELECT row_number() OVER (ORDER BY g) AS k, g, min(doc_id) AS rep, len(g) AS n FROM (SELECT doc_id, list_sort(g) AS g FROM s WHERE len(g) > 0) GROUP BY g),
e AS (SELECT k, n, unnest(g) AS tok FROM c),
p AS (SELECT x.k AS a, y.k AS b, count(*) AS inter, any_value(x.n) AS na, any_value(y.n) AS nb FROM e x JOIN e y ON x.tok = y.tok AND x.k <> y.k AND least(x.n, y.n) * 10 >= greatest(x.n, y.n) * 9 GROUP BY x.k, y.k),
l AS (SELECT a, b FROM p WHERE 100 * inter >= 90 * (na + nb - inter)),
r(a, b) AS (SELECT k, k FROM c UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a AS k, min(c.rep) AS component_id FROM r JOIN c ON c.k = r.b GROUP BY a)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, CASE WHEN len(s.g) = 0 THEN s.doc_id ELSE m.component_id END AS component_id
FROM s LEFT JOIN c ON list_sort(s.g) = c.g LEFT JOIN m ON m.k = c.k
"""
