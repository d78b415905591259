"""Quality classifier: a linear-chain conditional random field over lines.

Each line gets surface features (shares of letters, capitals, digits and symbols, word lengths, repetition within the
line, recurrence within the document, ...) and those of its neighbours. A two-state CRF, fitted on a bounded sample of
labelled documents whose lines bear the document's label and two of which in a row make a chain, gives each line's marginal probability of being good by
forward-backward; a document's score is the length-weighted mean of its lines' marginals, passed through a logistic
curve fitted on the same sample. Nothing but the text enters a score.

Scale: fitting sees at most TRAIN_DOCS documents at any size of input; scoring is one scan without a shuffle, feature
counts being vectorised over all characters of a batch.

Edge cases: null and empty texts are one empty line; null labels and repeated ids in labels: the least non-null label
counts; with no labels at all every score is 0.5; long texts are scored whole, in batches bounded by characters; an
empty table gives an empty result; a column of docs named like the score stays, the score's name gets an underscore.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import zip_longest
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.llm._base import fresh_name, held_out, small_batches, table

#: The most labelled documents that a fit uses: those whose ids have the least hashes.
TRAIN_DOCS = 4000
BATCH_CHARS = 500_000
GOOD_FROM = 0.7
_LETTER, _UPPER, _DIGIT, _SPACE, _POINT, _SYMBOL, _BREAK = range(7)
_KNOWN = 0x3000


def _class_table() -> np.ndarray:
    out = np.full(_KNOWN, _LETTER, dtype=np.uint8)
    for c in range(_KNOWN):
        s = chr(c)
        if s == "\n":
            out[c] = _BREAK
        elif c in (32, 9, 11, 12, 13):
            out[c] = _SPACE
        elif s.isupper():
            out[c] = _UPPER
        elif s.isdigit():
            out[c] = _DIGIT
        elif s in ".,;:?'\"()-’“”«»":
            out[c] = _POINT
        elif not s.isalpha():
            out[c] = _SYMBOL
    return out


_CLASS = _class_table()
_MULT = np.random.default_rng(5).integers(1, 2**63, size=64, dtype=np.uint64) | np.uint64(1)
#: Own features of a line, before those of its neighbours.
OWN = ("letters", "capitals", "digits", "points", "symbols", "word length", "distinct words", "repeated word", "length", "empty", "recurs", "ends in a point")


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document index of each line, its length in characters and 1, features of it and its neighbours)."""
    whole = "\n".join("" if t is None else t for t in texts)
    cps = np.frombuffer((whole + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = np.where(cps < _KNOWN, _CLASS[np.minimum(cps, _KNOWN - 1)], _LETTER)
    ends = np.flatnonzero(kind == _BREAK)
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(ends)
    size = (ends - starts).astype(np.float64)
    last = np.cumsum([(0 if t is None else t.count("\n")) + 1 for t in texts]) if texts else np.empty(0, dtype=np.int64)
    doc = np.repeat(np.arange(len(texts)), np.diff(np.concatenate([[0], last])))

    def count(flags: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return (run[ends] - run[starts]).astype(np.float64)

    letters, capitals, digits = count(kind == _LETTER), count(kind == _UPPER), count(kind == _DIGIT)
    points, symbols = count(kind == _POINT), count(kind == _SYMBOL)
    gap = (kind == _SPACE) | (kind == _BREAK)
    head = ~gap & np.concatenate([[True], gap[:-1]])
    at = np.flatnonzero(head)
    words = count(head)
    if len(at):
        word_of = np.cumsum(head) - 1
        place = np.arange(len(cps)) - at[np.maximum(word_of, 0)]
        value = np.where(gap, np.uint64(0), (cps.astype(np.uint64) + np.uint64(1)) * _MULT[place & 63])
        hashes = np.add.reduceat(value, at)
        line = np.searchsorted(ends, at)
        same = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])])
        repeated = np.bincount(line, weights=same, minlength=n)
        order = np.lexsort((hashes, line))
        h, g = hashes[order], line[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])])
        distinct = np.bincount(g, weights=new, minlength=n)
        mixed = hashes * _MULT[(np.arange(len(at)) - np.searchsorted(line, line)) & 63]
        of_line = np.zeros(n, dtype=np.uint64)
        np.add.at(of_line, line, mixed)
    else:
        repeated = distinct = np.zeros(n)
        of_line = np.zeros(n, dtype=np.uint64)
    order = np.lexsort((of_line, doc))
    h, g = of_line[order], doc[order]
    eq = (h[1:] == h[:-1]) & (g[1:] == g[:-1])
    twin = np.zeros(n)
    twin[order] = np.concatenate([[False], eq]) | np.concatenate([eq, [False]])
    ink = np.maximum(letters + capitals + digits + points + symbols, 1)
    final = np.zeros(n)
    full = size > 0
    final[full] = kind[ends[full] - 1] == _POINT
    own = np.column_stack(
        [letters / ink, capitals / np.maximum(letters + capitals, 1), digits / ink, np.minimum(points / ink * 5, 2), np.minimum(symbols / ink * 5, 2), np.minimum(ink / np.maximum(words, 1) / 8, 3), distinct / np.maximum(words, 1), repeated / np.maximum(words, 1), np.log1p(size) / 6, words == 0, twin * (words > 0), final]
    ).astype(np.float64)
    near = own[:, [0, 1, 4, 7, 10]]
    first = np.concatenate([[True], doc[1:] != doc[:-1]]) if n else np.empty(0, bool)
    final_line = np.concatenate([first[1:], [True]]) if n else first
    before, after = np.roll(near, 1, axis=0), np.roll(near, -1, axis=0)
    before[first], after[final_line] = 0, 0
    return doc, size + 1, np.column_stack([own, own**2, before, after, first, final_line, np.ones(n)])


def _steps(lengths: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Starts of documents, longest first, and how many are longer than t lines for each t."""
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    order = np.argsort(-lengths, kind="stable")
    ordered = lengths[order]
    alive = [int(np.searchsorted(-ordered, -t, side="left")) for t in range(int(ordered[0]) if len(ordered) else 0)]
    return starts[order], alive


def forward_backward(scores: np.ndarray, move: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of all lines (L x 2), expected transition counts (2 x 2) and the sum of log partition functions.

    scores: L x 2, documents one after the other; lengths: lines of each, 1 at least. All documents advance together.
    """
    starts, alive = _steps(lengths)
    a, b = scores.copy(), np.zeros_like(scores)
    for t in range(1, len(alive)):
        i = starts[: alive[t]] + t
        p = a[i - 1]
        a[i, 0] += np.logaddexp(p[:, 0] + move[0, 0], p[:, 1] + move[1, 0])
        a[i, 1] += np.logaddexp(p[:, 0] + move[0, 1], p[:, 1] + move[1, 1])
    for t in range(len(alive) - 1, 0, -1):
        i = starts[: alive[t]] + t
        q = b[i] + scores[i]
        b[i - 1, 0] = np.logaddexp(move[0, 0] + q[:, 0], move[0, 1] + q[:, 1])
        b[i - 1, 1] = np.logaddexp(move[1, 0] + q[:, 0], move[1, 1] + q[:, 1])
    both = a + b
    z = np.logaddexp(both[:, 0], both[:, 1])
    marginals = np.exp(both - z[:, None])
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    inner = np.ones(len(scores), dtype=bool)
    inner[first] = False
    i = np.flatnonzero(inner)
    pairs = a[i - 1][:, :, None] + move[None] + (scores[i] + b[i])[:, None, :] - z[i][:, None, None]
    return marginals, np.exp(pairs).sum(axis=0), float(z[first].sum())


class LineCrf:
    """State weights on features for the good state, transition weights, and the curve from mean marginal to score."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, move: np.ndarray, curve: tuple[float, float] = (0.0, 1.0)):
        self.mean, self.scale, self.weights, self.move, self.curve = mean, scale, weights, move, curve

    def marginals(self, x: np.ndarray, doc: np.ndarray) -> np.ndarray:
        s = np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights
        return forward_backward(np.column_stack([-s / 2, s / 2]), self.move, np.bincount(doc))[0][:, 1]

    def documents(self, texts: list[str | None]) -> np.ndarray:
        """Scores, in pieces of BATCH_CHARS."""
        out: list[np.ndarray] = []
        held: list[str | None] = []
        size = 0
        for t in texts:
            held.append(t)
            size += len(t or "") + 1
            if size >= BATCH_CHARS:
                out.append(self._scores(held))
                held, size = [], 0
        if held:
            out.append(self._scores(held))
        return np.concatenate(out) if out else np.empty(0)

    def _scores(self, texts: list[str | None]) -> np.ndarray:
        doc, size, x = line_features(texts)
        return self.curve_of(self.mean_marginal(doc, size, x))

    def mean_marginal(self, doc: np.ndarray, size: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.bincount(doc, weights=self.marginals(x, doc) * size) / np.bincount(doc, weights=size)

    def curve_of(self, mean: np.ndarray) -> np.ndarray:
        p = np.clip(mean, 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * np.log(p / (1 - p)), -30, 30)))


def fit(doc: np.ndarray, size: np.ndarray, x: np.ndarray, labels: np.ndarray, rounds: int = 150, ridge: float = 1e-3) -> LineCrf:
    """Fit by full-batch Adam on the conditional log-likelihood; labels: one of each document.

    Two documents in a row make one chain, so that chains pass from good lines to bad ones where their labels differ.
    """
    width = x.shape[1]
    mean, scale = x.mean(axis=0), x.std(axis=0)
    mean[-1], scale[scale < 1e-9] = 0.0, 1.0
    model = LineCrf(mean, scale, np.zeros(width), np.zeros((2, 2)))
    z = np.clip((x - mean) / scale, -6, 6)
    y = labels[doc]
    chain = doc // 2
    lengths = np.bincount(chain)
    same = chain[1:] == chain[:-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:-1][same], y[1:][same]), 1)
    total = len(y)
    theta, m, v = np.zeros(width + 4), np.zeros(width + 4), np.zeros(width + 4)
    for k in range(1, rounds + 1):
        s = z @ theta[:width]
        marginals, pairs, _ = forward_backward(np.column_stack([-s / 2, s / 2]), theta[width:].reshape(2, 2), lengths)
        grad = np.concatenate([z.T @ (y - marginals[:, 1]), (seen - pairs).ravel()]) / total - ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta + 0.08 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    model.weights, model.move = theta[:width], theta[width:].reshape(2, 2)
    p = np.clip(model.mean_marginal(doc, size, x), 1e-6, 1 - 1e-6)
    model.curve = _logistic(np.log(p / (1 - p)), labels)
    return model


def _logistic(f: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Offset and slope of a ridge-regularised logistic curve, by Newton steps."""
    x, w = np.column_stack([np.ones_like(f), f]), np.array([0.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(2)
        w = w + np.linalg.solve(h, x.T @ (y - p) / len(y) - ridge * (w - np.array([0.0, 1.0])))
    return float(w[0]), float(max(w[1], 1e-3))


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold_no: int, limit: int) -> DataFrame:
    """(label, text) of at most `limit` labelled documents outside the held-out fold, those of least id hash."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds, fold_no)).groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(limit)
    # Of rows that share an id one counts, so the bound holds.
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("label").alias("label"), F.min("text").alias("text")).select("label", "text")


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> LineCrf:
    """Fit on a bounded sample; features are computed on the executors."""

    def features(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        for b in batches:
            if not len(b):
                continue
            doc, size, x = line_features(b.column("text").to_pylist())
            cut = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(b)))])
            rows = [np.column_stack([size[i:j], x[i:j]]).astype(np.float32).tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(rows, pa.binary())], names=["label", "x"])

    small_batches(docs.sparkSession, 500)
    rows = sample(docs, labels, "quality", 4, 2, limit).mapInArrow(features, "label int, x binary").toArrow()
    blocks = [np.frombuffer(v, dtype=np.float32) for v in rows.column("x").to_pylist()]
    width = line_features([""])[2].shape[1] + 1
    blocks = [v.reshape(-1, width).astype(np.float64) for v in blocks]
    y = np.array(rows.column("label").to_pylist(), dtype=np.int64)
    if not len(y):
        return LineCrf(np.zeros(width - 1), np.ones(width - 1), np.zeros(width - 1), np.zeros((2, 2)))
    # Executors return rows in no fixed order; the fit must not depend on it.
    order = sorted(range(len(y)), key=lambda i: (int(y[i]), blocks[i].tobytes()))
    # Beside a document of the first half stands one of the second, so that many pairs have both labels.
    half = (len(order) + 1) // 2
    order = [i for pair in zip_longest(order[:half], order[half:]) for i in pair if i is not None]
    every = np.concatenate([blocks[i] for i in order])
    doc = np.repeat(np.arange(len(y)), [len(blocks[i]) for i in order])
    return fit(doc, every[:, 0], every[:, 1:], y[order])


def score_documents(docs: DataFrame, labels: DataFrame, *, limit: int = TRAIN_DOCS, name: str = "score") -> DataFrame:
    """docs with a column of scores, fitted on labels; underscores go in front of its name where docs has a column of it."""
    return docs.withColumn(fresh_name(docs, name), _score_udf(train(docs, labels, limit))(F.col("text")))


def _score_udf(model: LineCrf) -> Any:
    import pyarrow as pa

    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            parts = [model.documents(b.slice(at, 500).to_pylist()) for at in range(0, len(b), 500)]
            yield pa.array(np.concatenate(parts) if parts else np.empty(0), pa.float64())

    scored.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(scored, "double")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= GOOD_FROM).cast("int").alias("predicted"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows of docs whose score is at least GOOD_FROM; the columns of docs."""
    model = train(docs, table(spark, sf_dir, "labels"))
    return docs.where(_score_udf(model)(F.col("text")) >= GOOD_FROM)
