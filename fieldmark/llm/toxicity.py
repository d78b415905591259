"""Toxicity: a lexicon trie intersected with Levenshtein automata, and context windows.

The lexicon, whole terms and stems, is learned from a bounded sample of labelled documents: candidates whose document
frequencies lean to the toxic side are taken greedily, each for the toxic documents that none before it explains, so
words that only happen to share documents with a term stay out. The trie of the lexicon and the Levenshtein automaton of
each term's edit allowance are walked together as one lazily determinised automaton: a state is a set of (trie node,
edits), and a text's word is dropped as soon as its set is empty. Each match has a weight, by term and number of edits,
learned from the sample; its context window lowers what stands in quotation or reported speech, and counts further
matches and words of address. A logistic model over these sums gives the score.

Scale: learning sees TRAIN_DOCS documents at most; scoring is one scan without a shuffle; words are matched once per
task and remembered, in a memory of bounded size.

Edge cases: null and empty texts have no match and get the score of no match; no labels of one class give an empty
lexicon and a constant score; long texts are scored whole; words of any script match; repeated ids in labels count by
the least label.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.llm._base import held_out, small_batches, store, table, words_of
from fieldmark.llm.quality import sample

TRAIN_DOCS = 6000
MEMORY_WORDS = 150_000
#: Words on either side of a match that make its context.
WINDOW = 6
STEM_LENGTHS = (4, 5, 6, 7)
_EDGE = re.compile(r"^\W+|\W+$")
_QUOTES = "\"“”„«»‹›`"
#: Words that report speech or speak about a word. Fixed values.
REPORTING = frozenset("said says quoted quote wrote called calls word term slur insult phrase reported allegedly dit disait mot sagte wort dijo palabra".split())
#: Words of address. Fixed values.
ADDRESS = frozenset("you your you're yourself u ur du dein dich tu toi vous usted eres".split())


def edits_for(term: str, stem: bool) -> int:
    """Edit allowance: stems none; terms one from 5 letters, two from 9."""
    return 0 if stem else 2 if len(term) >= 9 else 1 if len(term) >= 5 else 0


class FuzzyLexicon:
    """Trie of terms and stems, walked together with the Levenshtein automata of their edit allowances."""

    def __init__(self, entries: list[tuple[str, bool]]):
        self.entries = entries
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.allow: list[int] = [-1]
        for i, (term, stem) in enumerate(entries):
            node, k = 0, edits_for(term, stem)
            self.allow[0] = max(self.allow[0], k)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.allow.append(-1)
                node = self.children[node][c]
                self.allow[node] = max(self.allow[node], k)
            self.ends[node].append(i)
        self.limit = [edits_for(*x) for x in entries]
        self.names: dict[tuple[tuple[int, int], ...], int] = {}
        self.sets: list[tuple[tuple[int, int], ...]] = []
        self.moves: list[dict[str, int]] = []
        self.stems: list[tuple[tuple[int, int], ...]] = []
        self.finals: list[tuple[tuple[int, int], ...]] = []
        self.start = self._state({0: 0})

    def _state(self, found: dict[int, int]) -> int:
        """Number of the state with these least edits by node, closed under leaving out trie letters."""
        stack = list(found)
        while stack:
            node = stack.pop()
            for child in self.children[node].values():
                e = found[node] + 1
                if e <= self.allow[child] and e < found.get(child, 99):
                    found[child] = e
                    stack.append(child)
        key = tuple(sorted(found.items()))
        if key not in self.names:
            self.names[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            ends = [(i, e) for node, e in key for i in self.ends[node] if e <= self.limit[i]]
            self.stems.append(tuple((i, e) for i, e in ends if self.entries[i][1]))
            self.finals.append(tuple(ends))
        return self.names[key]

    def _move(self, state: int, c: str) -> int:
        found: dict[int, int] = {}

        def add(node: int, e: int) -> None:
            if e <= self.allow[node] and e < found.get(node, 99):
                found[node] = e

        for node, e in self.sets[state]:
            for x, child in self.children[node].items():
                add(child, e if x == c else e + 1)
            add(node, e + 1)
        to = self._state(found) if found else -1
        self.moves[state][c] = to
        return to

    def match(self, word: str) -> tuple[tuple[int, int], ...]:
        """(entry, edits) of all entries that the word matches; a stem matches what it begins."""
        state, out = self.start, ()
        for c in word:
            to = self.moves[state].get(c)
            state = self._move(state, c) if to is None else to
            if state < 0:
                return out
            if self.stems[state]:
                out += self.stems[state]
        return out + tuple(x for x in self.finals[state] if not self.entries[x[0]][1])


def plain(word: str) -> str:
    return _EDGE.sub("", word.lower())


class ToxicModel:
    """Lexicon, weights by (entry, edits), and the logistic model over a document's sums."""

    def __init__(self, entries: list[tuple[str, bool]], weights: dict[tuple[int, int], float], coefficients: np.ndarray):
        self.entries, self.weights, self.coefficients = entries, weights, coefficients
        self._lexicon: FuzzyLexicon | None = None
        self._memory: dict[str, tuple[tuple[int, int], ...]] = {}

    def __getstate__(self) -> dict[str, Any]:
        return {"entries": self.entries, "weights": self.weights, "coefficients": self.coefficients, "_lexicon": None, "_memory": {}}

    def lookup(self, word: str) -> tuple[tuple[int, int], ...]:
        got = self._memory.get(word)
        if got is None:
            if self._lexicon is None:
                self._lexicon = FuzzyLexicon(self.entries)
            if len(self._memory) > MEMORY_WORDS:
                self._memory.clear()
            got = self._memory[word] = self._lexicon.match(plain(word))
        return got

    def forget(self) -> None:
        self._memory.clear()
        self._lexicon = None

    def matches(self, text: str | None) -> list[tuple[int, tuple[tuple[int, int], ...], list[str]]]:
        """(position, entries matched, context words) of each match."""
        words = words_of(text or "")
        lookup, memory = self.lookup, self._memory
        hits = {w for w in set(words) if (memory.get(w) if w in memory else lookup(w))}
        if not hits:
            return []
        return [(i, lookup(w), words[max(0, i - WINDOW) : i + WINDOW + 1]) for i, w in enumerate(words) if w in hits]

    def features(self, text: str | None) -> np.ndarray:
        """1, strongest weight, log of abuse, log of quotation, further matches near by, address."""
        best = abuse = quoted = crowd = address = 0.0
        for _, found, context in self.matches(text):
            w = max((self.weights.get(x, 0.0) for x in found), default=0.0)
            if w <= 0:
                continue
            c = context_score(context)
            best = max(best, w * c)
            abuse += w * c
            quoted += w * (1 - c)
            crowd += sum(bool(self.lookup(x)) for x in context) > 1
            address += any(plain(x) in ADDRESS for x in context)
        return np.array([1.0, best, np.log1p(abuse), np.log1p(quoted), np.log1p(crowd), np.log1p(address)])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([self.features(t) for t in texts]).reshape(-1, 6)
        return 1 / (1 + np.exp(-np.clip(x @ self.coefficients, -30, 30)))


def context_score(context: list[str]) -> float:
    """1 for abuse, less where the window holds quotation marks in pairs or words that report speech; 0.2 at least."""
    marks = sum(c in _QUOTES for w in context for c in w)
    told = sum(plain(w) in REPORTING for w in context)
    return max(0.2, 1.0 - 0.3 * (marks >= 2) - 0.25 * min(told, 2))


def _g2(a: float, b: float, na: float, nb: float) -> float:
    """Log-likelihood ratio of a of na against b of nb."""

    def part(x: float, e: float) -> float:
        return x * np.log(x / e) if x > 0 else 0.0

    p = (a + b) / (na + nb)
    q = 1 - p
    return 2 * (part(a, na * p) + part(na - a, na * q) + part(b, nb * p) + part(nb - b, nb * q))


def _units(text: str | None) -> set[str]:
    """Words, and stems marked by a final *."""
    words = {plain(w) for w in set(words_of(text or ""))}
    words = {w for w in words if len(w) >= 4 and any(c.isalpha() for c in w)}
    return words | {w[:n] + "*" for w in words for n in STEM_LENGTHS if len(w) > n}


def learn_lexicon(rows: DataFrame, most: int = 400, least: int = 4) -> list[tuple[str, bool]]:
    """Greedy cover of the toxic documents of rows (rid, label, text) by words and stems that lean to them."""

    def counts(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        for b in batches:
            c: list[Counter[str]] = [Counter(), Counter()]
            for y, t in zip(b.column("label").to_pylist(), b.column("text").to_pylist(), strict=True):
                c[int(y > 0)].update(_units(t))
            units = list(c[0] | c[1])
            yield pa.RecordBatch.from_pydict({"unit": pa.array(units, pa.string()), "clean": pa.array([c[0][u] for u in units], pa.int64()), "toxic": pa.array([c[1][u] for u in units], pa.int64())})

    totals = {r["t"]: r["n"] for r in rows.groupBy((F.col("label") > 0).alias("t")).agg(F.count(F.lit(1)).alias("n")).collect()}
    nt, nc = totals.get(True, 0), totals.get(False, 0)
    if not nt or not nc:
        return []
    found = rows.select("label", "text").mapInArrow(counts, "unit string, clean long, toxic long").groupBy("unit").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    lean = found.where((F.col("toxic") >= least) & (F.col("clean") * 50 <= F.col("toxic")) & (F.col("toxic") / nt >= 20 * (F.col("clean") + 0.5) / nc))
    # A bounded list: the sample is bounded, and so are the candidates taken from it.
    listed = lean.orderBy(F.desc("toxic"), "unit").limit(20_000).collect()
    strong = {r["unit"]: (r["toxic"], r["clean"]) for r in listed if _g2(r["toxic"], r["clean"], nt, nc) >= 18}

    def incidence(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        for b in batches:
            for r, t in zip(b.column("rid").to_pylist(), b.column("text").to_pylist(), strict=True):
                own = [u for u in _units(t) if u in strong]
                yield pa.RecordBatch.from_pydict({"rid": pa.array([r] * len(own), pa.int64()), "unit": pa.array(own, pa.string())})

    has: dict[str, set[int]] = defaultdict(set)
    for r in rows.where("label > 0").select("rid", "text").mapInArrow(incidence, "rid long, unit string").collect():
        has[r["unit"]].add(r["rid"])
    left = set().union(*has.values()) if has else set()
    out: list[tuple[str, bool]] = []
    while left and len(out) < most:
        gains = {u: _g2(len(d & left), strong[u][1], nt, nc) for u, d in has.items() if len(d & left) >= least}
        if not gains:
            break
        # Of the near best, a whole word before a stem, then the longer, then by name.
        top = max(gains.values())
        unit = min((u for u, g in gains.items() if g >= 0.97 * top), key=lambda u: (u.endswith("*"), -len(u), u))
        left -= has.pop(unit)
        out.append((unit.rstrip("*"), unit.endswith("*")))
    # What explains the same documents as well, by itself: words as frequent as any of the chosen.
    chosen = {t for t, _ in out}
    floor = np.median([len(strong) and strong.get(t + "*" * s, (0, 0))[0] for t, s in out]) / 2 if out else 0
    for u, d in sorted(has.items()):
        stem, term = u.endswith("*"), u.rstrip("*")
        if len(d) >= max(floor, 3 * least) and not any(term.startswith(x) or x.startswith(term) for x in chosen):
            if stem and any(v != u and v.startswith(term) and len(dv) >= 0.97 * len(d) for v, dv in has.items()):
                continue
            out.append((term, stem))
            chosen.add(term)
    return out


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> ToxicModel:
    """Learn lexicon, weights and coefficients from a bounded sample of labelled documents outside fold 0 of 5."""
    small_batches(docs.sparkSession)
    rows = store(sample(docs, labels, "toxic", 5, 0, limit).withColumn("rid", F.monotonically_increasing_id()), "toxic-sample")
    entries = learn_lexicon(rows)
    blank = ToxicModel(entries, {}, np.zeros(6))

    def matched(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        for b in batches:
            found = [sorted({f"{i}:{e}" for _, x, _ in blank.matches(t) for i, e in x}) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(found, pa.list_(pa.string()))], names=["label", "found"])

    seen = rows.select("label", "text").mapInArrow(matched, "label int, found array<string>").collect()
    nt, nc = sum(r["label"] > 0 for r in seen), sum(r["label"] <= 0 for r in seen)
    per: list[Counter[str]] = [Counter(), Counter()]
    for r in seen:
        per[int(r["label"] > 0)].update(r["found"])
    weights: dict[tuple[int, int], float] = {}
    for x in sorted(per[0] | per[1]):
        i, e = map(int, x.split(":"))
        w = float(np.log(((per[1][x] + 0.5) / (nt + 1)) / ((per[0][x] + 0.5) / (nc + 1))))
        if w > 0 and per[1][x] > 0.5 * (per[0][x] + per[1][x]):
            weights[i, e] = w
    # Misspellings too rare to be measured: those of terms whose measured ones are not clean words count half.
    for i, x in enumerate(entries):
        for e in range(1, edits_for(*x) + 1):
            if (i, e) not in weights and not per[0][f"{i}:{e}"] and (i, e - 1) in weights:
                weights[i, e] = weights[i, e - 1] / 2
    model = ToxicModel(entries, weights, np.zeros(6))

    def featured(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        for b in batches:
            x = [model.features(t).tolist() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(x, pa.list_(pa.float64()))], names=["label", "x"])

    data = sorted((int(r["label"] > 0), *r["x"]) for r in rows.select("label", "text").mapInArrow(featured, "label int, x array<double>").collect())
    model.coefficients = _fit(np.array([d[1:] for d in data]).reshape(-1, 6), np.array([d[0] for d in data]))
    return model


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    w = np.zeros(x.shape[1])
    if not len(y):
        return w
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (y - p) / len(y) - ridge * w)
    return w


def score_udf(model: ToxicModel) -> Any:
    import pyarrow as pa

    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for b in batches:
                parts = [model.scores(b.slice(at, 500).to_pylist()) for at in range(0, len(b), 500)]
                yield pa.array(np.concatenate(parts) if parts else np.empty(0), pa.float64())
        finally:
            # A worker outlives its tasks, and a task's model may wait long for the garbage collector.
            model.forget()

    scored.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(scored, "double")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = docs.withColumn("score", score_udf(model)(F.col("text")))
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
