"""Cross-tokenizer alignment: which tokens of one tokenizer stand for which of another.

The byte ranges of B's tokens are a static interval index: two sorted lists, of starts and of ends. Each A token stabs it by
bisection and gets the B tokens that it overlaps; where no B token spans the gap between two A tokens, a group ends. All
A and B tokens of a group are linked.

Texts are first cut at single spaces between two marks, which neither tokenizer's tokens cross: A cuts there before it
merges, and no piece of B has a space anywhere but in front (checked when the files are read; if it isn't so, texts stay
whole). Tokens, groups and links of a text are therefore those of its cuts, and a chunk of documents tokenizes and aligns
each of its distinct cuts once. Texts with a cut whose tokens don't give its bytes back are tokenized whole, and have no
tokens if they don't then either.

Scale: a task turns its documents into chunks of about CHUNK_CHARS, stored with each chunk's distinct links and the number of
its documents that hold them. Links' counts are sums over chunks; each chunk gets back those of its own links, so that
no task holds more of the table of links than a chunk's, which nothing broadcasts.

Edge cases: null and empty texts have no tokens, as have those that either tokenizer doesn't give back byte for byte; every
row is a document, repeated ones too; a group of many tokens is linked by its distinct ids and their numbers; long texts
are read whole; an empty table gives an empty result. Columns are taken by name; others do not matter, nor do their names.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import Any

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldmark.llm._base import discard, free_shuffles, quoted, small_batches, store, table

TOKENIZERS = "/opt/tokenizers"
FILE_A = "byte_bpe_50k.json"
FILE_B = "piece_bpe_32k.model"
CHUNK_CHARS = 4_000_000
#: How byte-level vocabularies split texts before they merge (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Groups with more links than this are linked by distinct ids.
WIDE = 4096
_SPACE = "\u2581"
#: Single spaces between two characters that no edition of Unicode calls a space, nor B writes as one.
_ODD = f"\u180e\u200b\ufeff{_SPACE}"
_CUT = re.compile(f"(?<=[^\\s{_ODD}]) (?=[^\\s{_ODD}])")
_OTHER = re.compile("[^\\x00-\u024f]")
_UNEVEN = re.compile(f"\\s\\s|[{_ODD}]")
_DOC = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def byte_of_letter() -> dict[str, int]:
    """How byte-level vocabularies write bytes: printable ones as themselves, the others as letters from U+0100 on, in order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each A and of each B token; ends: where tokens end, ascending, both up to the same byte."""
    if not len(ends_a):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    starts_a, starts_b = (np.concatenate([[0], e[:-1]]) for e in (ends_a, ends_b))
    low = np.searchsorted(ends_b, starts_a, side="right")
    high = np.searchsorted(starts_b, ends_a, side="left")
    # A token of B spans the gap after A's token i if the next one overlaps it too.
    closed = high[:-1] <= low[1:]
    group_a = np.concatenate([[0], np.cumsum(closed)])
    first = np.flatnonzero(np.concatenate([[True], closed]))
    last = np.append(first[1:], len(ends_a)) - 1
    group_b = np.repeat(np.arange(len(first)), high[last] - low[first])
    return group_a, group_b


class Tokenizers:
    """Both tokenizers, and what their ids stand for."""

    def __init__(self, folder: str, file_a: str, file_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(f"{folder}/{file_a}")
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{file_b}")
        letters = byte_of_letter()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            self.bytes_a[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        most = max(len(self.bytes_a), len(self.bytes_b))
        #: Each id in decimal, zero bytes behind it.
        self.digits = np.arange(most).astype(f"S{len(str(most)) + 1}").view(np.uint8).reshape(most, -1)
        with open(f"{folder}/{file_a}", encoding="utf-8") as f:
            said = json.load(f)
        before = said.get("pre_tokenizer") or {}
        merged = [vocabulary.get("".join(m if isinstance(m, list) else m.split(" "))) for m in said["model"].get("merges", [])]
        byte_level = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not said.get("normalizer")
        self.ranks = None
        if byte_level and all(merged) and merged == sorted(merged):
            import tiktoken

            special = {x["id"] for x in said.get("added_tokens", [])}
            self.ranks = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={self.bytes_a[i]: i for i in vocabulary.values() if i not in special}, special_tokens={})
        self.cuts = byte_level and not any(_SPACE in p[1:] and p.strip(_SPACE) for p in pieces)

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of texts that begin with a space. Where a vocabulary's ids are its merges in order, merging by rank gives the
        same ids several times as fast; letters that editions of Unicode may class differently are left to the file's own rules."""
        if self.ranks is None:
            a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        else:
            plain, by_rank = _OTHER.search, self.ranks._core_bpe.encode_ordinary
            a = [by_rank(t) if t.isascii() or plain(t) is None else self.a.encode(t, add_special_tokens=False).ids for t in texts]
        return a, self.b.encode([t[1:] for t in texts], num_threads=1)

    def cut(self, text: str) -> list[str]:
        """A text, with the space in front, in parts that begin with a space and that both tokenizers read alone."""
        if not self.cuts:
            return [text]
        if not _UNEVEN.search(text) and not text.endswith(" "):
            return [f" {w}" for w in text[1:].split(" ")]
        first, *others = _CUT.split(text)
        return [first, *[f" {w}" for w in others]]


class Aligned:
    """Alignments of distinct texts, one after the other: counts of each, its groups as text, and its links (CSR)."""

    def __init__(self, tools: Tokenizers, texts: list[str]):
        a, b = tools.encode(texts)
        name_a, name_b = tools.bytes_a, tools.bytes_b
        self.good = np.array([b"".join([name_a[i] for i in x]) == t.encode() == b"".join([name_b[i] for i in y]) for t, x, y in zip(texts, a, b, strict=True)], dtype=bool)
        a = [x if ok else [] for x, ok in zip(a, self.good, strict=True)]
        b = [x if ok else [] for x, ok in zip(b, self.good, strict=True)]
        self.n_a, self.n_b = (np.array([len(x) for x in s], dtype=np.int64) for s in (a, b))
        ids_a, ids_b = (np.array([i for x in s for i in x], dtype=np.int64) for s in (a, b))
        size_a, size_b = (np.array([len(x) for x in s], dtype=np.int64) for s in (name_a, name_b))
        group_a, group_b = align(np.cumsum(size_a[ids_a]), np.cumsum(size_b[ids_b]))
        groups = int(group_a[-1]) + 1 if len(group_a) else 0
        many_a, many_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        text_of = np.zeros(groups, dtype=np.int64)
        text_of[group_a] = np.repeat(np.arange(len(texts)), self.n_a)
        self.n_groups = np.bincount(text_of, minlength=len(texts))
        # Sums of products stay exact in whole numbers; bincount's weights would not.
        self.n_links = np.zeros(len(texts), dtype=np.int64)
        np.add.at(self.n_links, text_of, many_a * many_b)
        self.written = self._write(tools.digits, ids_a, ids_b, many_a, many_b)
        self._link(ids_a, ids_b, many_a, many_b, text_of, len(texts), len(name_b))

    def _write(self, digits: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray, many_a: np.ndarray, many_b: np.ndarray) -> list[bytes]:
        """The groups of each text, all tokens written at once: digits and what stands behind them, in rows of fixed width."""
        group_a, group_b = np.repeat(np.arange(len(many_a)), many_a), np.repeat(np.arange(len(many_b)), many_b)
        end_a, end_b = np.cumsum(many_a), np.cumsum(many_b)
        at_a = np.arange(len(ids_a)) + (end_b - many_b)[group_a]
        at_b = np.arange(len(ids_b)) + end_a[group_b]
        ids = np.empty(len(ids_a) + len(ids_b), dtype=np.int64)
        ids[at_a], ids[at_b] = ids_a, ids_b
        behind = np.full(len(ids), ord(","), dtype=np.uint8)
        behind[at_a[end_a - 1]] = ord("|")
        behind[at_b[end_b - 1]] = ord(";")
        full = self.n_groups > 0
        behind[at_b[end_b[np.cumsum(self.n_groups)[full] - 1] - 1]] = ord("\n")
        rows = digits[ids]
        rows[np.arange(len(ids)), (rows != 0).sum(axis=1)] = behind
        found = iter(rows[rows != 0].tobytes().split(b"\n"))
        return [next(found) if x else b"" for x in full.tolist()]

    def _link(self, ids_a: np.ndarray, ids_b: np.ndarray, many_a: np.ndarray, many_b: np.ndarray, text_of: np.ndarray, texts: int, width: int) -> None:
        links = many_a * many_b
        wide = links > WIDE
        n = np.where(wide, 0, links)
        group = np.repeat(np.arange(len(n)), n)
        nth = np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)
        first_a, first_b = np.cumsum(many_a) - many_a, np.cumsum(many_b) - many_b
        code = [ids_a[first_a[group] + nth // many_b[group]] * width + ids_b[first_b[group] + nth % many_b[group]]]
        number, owner = [np.ones(len(group), dtype=np.int64)], [text_of[group]]
        for g in np.flatnonzero(wide).tolist():
            x, nx = np.unique(ids_a[first_a[g] : first_a[g] + many_a[g]], return_counts=True)
            y, ny = np.unique(ids_b[first_b[g] : first_b[g] + many_b[g]], return_counts=True)
            code.append((x[:, None] * width + y[None, :]).ravel())
            number.append((nx[:, None] * ny[None, :]).ravel())
            owner.append(np.full(len(x) * len(y), text_of[g]))
        owner_, code_, number_ = np.concatenate(owner), np.concatenate(code), np.concatenate(number)
        order = np.argsort(owner_, kind="stable")
        self.code, self.number = code_[order], number_[order]
        self.reach = np.bincount(owner_, minlength=texts)


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All indices from start to start + size, range after range."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _planes(x: np.ndarray) -> bytes:
    """Numbers as zstd likes them: their lowest bytes, then the next, ..."""
    import pyarrow as pa

    return pa.compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def _numbers(raw: bytes, n: int) -> np.ndarray:
    import pyarrow as pa

    return np.ascontiguousarray(np.frombuffer(pa.decompress(raw, decompressed_size=8 * n, codec="zstd", asbytes=True), dtype=np.uint8).reshape(8, n).T).view("<u8").ravel().astype(np.int64) if n else np.empty(0, dtype=np.int64)


def align_documents(tools: Tokenizers, texts: list[str | None]) -> tuple[dict[str, Any], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts and digest of each text; then distinct links, the documents that hold each, and by document how many of them it
    has, which ones (ascending) and how often."""
    number: dict[str, int] = {}
    doc: list[int] = []
    cut: list[int] = []
    for i, t in enumerate(texts):
        if t:
            own = [number.setdefault(c, len(number)) for c in tools.cut(f" {t}")]
            cut += own
            doc += [i] * len(own)
    known = list(number)
    of = Aligned(tools, known)
    docs_, cuts_ = np.array(doc, dtype=np.int64), np.array(cut, dtype=np.int64)
    # Where a part fails, the whole text decides.
    odd = np.unique(docs_[~of.good[cuts_]]) if len(cuts_) else np.empty(0, dtype=np.int64)
    if len(odd) and tools.cuts:
        whole = [f" {texts[i]}" for i in odd.tolist()]
        keep = ~np.isin(docs_, odd)
        docs_, cuts_ = np.concatenate([docs_[keep], odd]), np.concatenate([cuts_[keep], np.arange(len(known), len(known) + len(odd))])
        order = np.argsort(docs_, kind="stable")
        docs_, cuts_ = docs_[order], cuts_[order]
        apart = Aligned(tools, whole)
        for name in ("n_a", "n_b", "n_groups", "n_links", "code", "number", "reach"):
            setattr(of, name, np.concatenate([getattr(of, name), getattr(apart, name)]))
        of.written += apart.written
    n = len(texts)
    out: dict[str, Any] = {}
    for name in ("n_a", "n_b", "n_groups", "n_links"):
        total = np.zeros(n, dtype=np.int64)
        np.add.at(total, docs_, getattr(of, name)[cuts_])
        out[name] = total
    written, ends = of.written, np.cumsum(np.bincount(docs_, minlength=n)).tolist()
    order_ = cuts_.tolist()
    out["groups_sha256"] = [
        hashlib.sha256(b";".join([written[c] for c in order_[i:j]])).hexdigest() if tokens else "" for i, j, tokens in zip([0, *ends[:-1]], ends, out["n_a"].tolist(), strict=True)
    ]
    codes, link = np.unique(of.code, return_inverse=True)
    first = np.cumsum(of.reach) - of.reach
    cuts_of, times = np.unique(docs_ * max(len(of.reach), 1) + cuts_, return_counts=True)
    d, c = cuts_of // max(len(of.reach), 1), cuts_of % max(len(of.reach), 1)
    size = of.reach[c]
    at = _spread(first[c], size)
    key = np.repeat(d, size) * max(len(codes), 1) + link[at]
    times = np.repeat(times, size) * of.number[at]
    order = np.argsort(key)
    key, times = key[order], times[order]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, dtype=np.int64)
    held, often = key[head], np.add.reduceat(times, head) if len(head) else times
    holder, which = held // max(len(codes), 1), held % max(len(codes), 1)
    return out, codes, np.bincount(which, minlength=len(codes)), np.bincount(holder, minlength=n), which, often


def chunks_of(docs: DataFrame, *, text: str = "text", key: str = "doc_id", tokenizers: str = TOKENIZERS, file_a: str = FILE_A, file_b: str = FILE_B) -> DataFrame:
    """Chunks of aligned documents: chunk, docs (key, counts, digest, number of distinct links), links a, b and df, and for
    the documents one after the other which links they hold and how often."""
    kind = docs.select(quoted(key)).schema[0].dataType

    def work(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        chunk = TaskContext.get().partitionId() << 33
        tools = Tokenizers(tokenizers, file_a, file_b)
        width = len(tools.bytes_b)
        keys: list[Any] = []
        texts: list[str | None] = []
        size = 0

        def close(keys: list[Any], texts: list[str | None]) -> Any:
            out, codes, df, many, which, often = align_documents(tools, texts)
            # Common links get small numbers, and a document's are told by their distances.
            place = np.empty(len(codes), dtype=np.int64)
            by = np.argsort(-df, kind="stable")
            place[by] = np.arange(len(codes))
            owner = np.repeat(np.arange(len(texts)), many)
            order = np.lexsort((place[which], owner))
            at, often = place[which][order], often[order]
            step = np.diff(at, prepend=0)
            first = (np.cumsum(many) - many)[many > 0]
            step[first] = at[first]
            per_doc = pa.StructArray.from_arrays([pa.concat_arrays(keys), *[pa.array(out[c]) for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")], pa.array(many)], names=["key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "held"])
            one = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
            arrays = [pa.array([chunk]), one(per_doc), *[one(pa.array(v[by])) for v in (codes // width, codes % width, df)], pa.array([_planes(step)], pa.binary()), pa.array([_planes(often)], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=["chunk", "docs", "a", "b", "df", "which", "often"])

        for batch in batches:
            start = 0
            for i, t in enumerate(batch.column(1).to_pylist()):
                texts.append(t)
                size += len(t or "") + 64
                if size >= CHUNK_CHARS:
                    keys.append(batch.column(0).slice(start, i + 1 - start))
                    chunk += 1
                    yield close(keys, texts)
                    keys, texts, size, start = [], [], 0, i + 1
            keys.append(batch.column(0).slice(start))
        if texts:
            chunk += 1
            yield close(keys, texts)

    schema = f"chunk long, docs array<struct<key:{kind.simpleString()},{_DOC.replace(' ', ':').replace(',:', ',')},held:long>>, a array<long>, b array<long>, df array<long>, which binary, often binary"
    small_batches(docs.sparkSession, 2000)
    return docs.select(F.col(quoted(key)).alias("key"), F.col(quoted(text)).cast("string").alias("text")).mapInArrow(work, schema)


def link_counts(chunks: DataFrame) -> DataFrame:
    """a, b, count (documents that hold the link), best (whether no link of a is held by more)."""
    seen = chunks.select(F.explode(F.arrays_zip("a", "b", "df")).alias("x")).select("x.a", "x.b", "x.df")
    total = seen.groupBy("a", "b").agg(F.sum("df").alias("count"))
    return total.withColumn("best", F.col("count") == F.max("count").over(W.partitionBy("a")))


def align_tokens(docs: DataFrame, *, text: str = "text", key: str = "doc_id", tokenizers: str = TOKENIZERS, file_a: str = FILE_A, file_b: str = FILE_B) -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of docs."""
    kind = docs.select(quoted(key)).schema[0].dataType
    chunks = store(chunks_of(docs, text=text, key=key, tokenizers=tokenizers, file_a=file_a, file_b=file_b), "aligned-chunks")
    counts = store(link_counts(chunks), "link-counts")
    free_shuffles(docs.sparkSession)
    seen = chunks.select(F.col("chunk").alias("of"), F.posexplode(F.arrays_zip("a", "b")).alias("k", "x")).select("of", "k", "x.a", "x.b")
    wanted = seen.join(counts, ["a", "b"]).select("of", "k", "count", "best")

    def add_up(_: tuple[Any, ...], left: Any, right: Any) -> Any:
        import pyarrow as pa

        n = len(right)
        count, best = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        k = right.column("k").to_numpy()
        count[k], best[k] = right.column("count").to_numpy(), right.column("best").to_numpy().astype(np.int64)
        rows = left.column("docs").combine_chunks().flatten()
        field = {c: rows.field(c) for c in ("key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "held")}
        held = field["held"].to_numpy()
        total = int(held.sum())
        step, often = (_numbers(left.column(c)[0].as_py(), total) for c in ("which", "often"))
        ends = np.cumsum(held)
        first = ends - held
        # Distances within a document: its links are running sums less what stood before it.
        run = np.concatenate([[0], np.cumsum(step)])
        at = run[1:] - np.repeat(run[first], held)
        sums = [np.concatenate([[0], np.cumsum(often * v[at])]) for v in (best, count)]
        n_best, count_sum = (s[ends] - s[first] for s in sums)
        return pa.table([field["key"], field["n_a"], field["n_b"], field["n_groups"], field["n_links"], pa.array(n_best), pa.array(count_sum), field["groups_sha256"]], names=["key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    schema = f"key {kind.simpleString()}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    out = chunks.select("chunk", "docs", "which", "often").groupBy("chunk").cogroup(wanted.groupBy("of")).applyInArrow(add_up, schema)
    return out.withColumnRenamed("key", key)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(table(spark, sf_dir, "documents"))
