"""Operators 11 to 13 against brute force, and on odd rows; links and numbers that once were lost."""

import hashlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldmark.llm import alignment, divergence, jaccard, langid, pii
from fieldmark.llm._base import held_out
from fieldmark.sources.tables import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TRICKY = [
    (1, None, "en", "a", 0), (2, "", None, None, 0), (3, "the cat", "en", None, 3), (3, "the cat", "en", None, 3), (None, "ab " * 4000, "en", "b", 9), (5, "The  cat\tsat.\n\n  On <|endoftext|> the <s> mat ", "en", "b", 9),
    (6, "naïve café — ДОБРЫЙ день 你好 世界 🙂🙂", "en", "b", 9), (7, "12345 67.8 ___", "de", "a", 9), (8, "a▁b c​d ᠎e <0x41>", "de", "b", 9), (9, " lead", "de", "a", 9), (10, "ÀÉ cat Cat", "de", "a", 9), (11, "x" * 3000, "en", "a", 9),
]


@pytest.fixture(scope="module")
def tricky(spark):
    clash = {c: F.lit("x") for c in ("chunk", "key", "g", "p", "rank", "count", "lang_pred", "score", "_found", "n_a", "a.b")}
    return spark.createDataFrame(TRICKY, DOCS).withColumns(clash)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def tools():
    return alignment.Tokenizers(alignment.TOKENIZERS, alignment.FILE_A, alignment.FILE_B)


# 11 alignment


def brute_align(tools, texts):
    """(n_a, n_b, n_groups, n_links, digest, links) of each text, from whole texts and sets of ends."""
    out = []
    for text in texts:
        raw = f" {text or ''}".encode()
        a, b = tools.a.encode(f" {text or ''}", add_special_tokens=False).ids, tools.b.encode(text or "")
        if not text or b"".join(tools.bytes_a[i] for i in a) != raw or b"".join(tools.bytes_b[i] for i in b) != raw:
            out.append((0, 0, 0, 0, "", Counter()))
            continue
        ends = [np.cumsum([len(names[i]) for i in ids]).tolist() for names, ids in ((tools.bytes_a, a), (tools.bytes_b, b))]
        links, parts, at = Counter(), [], [0, 0]
        for end in sorted(set(ends[0]) & set(ends[1])):
            to = [e.index(end) + 1 for e in ends]
            x, y = a[at[0] : to[0]], b[at[1] : to[1]]
            links.update((i, j) for i in x for j in y)
            parts.append(f"{','.join(map(str, x))}|{','.join(map(str, y))}")
            at = to
        out.append((len(a), len(b), len(parts), links.total(), hashlib.sha256(";".join(parts).encode()).hexdigest(), links))
    return out


def check_alignment(spark, docs, tools):
    rows = docs.select("doc_id", "text").collect()
    plain = brute_align(tools, [r["text"] for r in rows])
    held = Counter(p for x in plain for p in x[5])
    most = defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    want = sorted((r["doc_id"] or -1, *x[:4], sum(n for p, n in x[5].items() if held[p] == most[p[0]]), sum(n * held[p] for p, n in x[5].items()), x[4]) for r, x in zip(rows, plain, strict=True))
    got = alignment.align_tokens(docs).collect()
    assert sorted((r["doc_id"] or -1, *r[1:]) for r in got) == want


def test_alignment_brute_force(spark, sf, tools, tricky, monkeypatch):
    check_alignment(spark, tricky, tools)
    monkeypatch.setattr(alignment, "CHUNK_CHARS", 20_000)
    monkeypatch.setattr(alignment, "WIDE", 6)
    check_alignment(spark, table(spark, sf, "documents").limit(60), tools)


def test_alignment_empty(spark, empty):
    assert alignment.align_tokens(empty).collect() == []


def test_align_groups():
    a, b = alignment.align(np.array([2, 3, 7, 9]), np.array([1, 3, 5, 9]))
    assert a.tolist() == [0, 0, 1, 1] and b.tolist() == [0, 0, 1, 1]
    assert alignment.byte_of_letter()["Ġ"] == 32 and len(alignment.byte_of_letter()) == 256


def test_cuts_read_alone(tools):
    for text in ("plain words here", "two  spaces", "tab\there and", "a​ b c", "x ▁ y z"):
        parts = tools.cut(f" {text}")
        assert "".join(parts) == f" {text}"
        a, b = tools.encode(parts)
        assert sum(a, []) == tools.a.encode(f" {text}", add_special_tokens=False).ids and sum(b, []) == tools.b.encode(text)


# 12 language


def brute_grams(text):
    out = Counter()
    word = ""
    for c in [*(text or ""), " "]:
        if c.isalpha():
            word += c.lower() if len(c.lower()) == 1 else c
        elif word:
            w = f"_{word}_"
            out.update(word)
            out.update(w[i : i + 2] for i in range(len(w) - 1))
            out.update(w[i : i + 3] for i in range(len(w) - 2))
            word = ""
    return out


def gram_text(code):
    return "".join("_" if c == 1 else chr(c) for c in (int(code) >> s & 0x1FFFFF for s in (42, 21, 0)) if c)


def test_grams_brute_force():
    texts = [r[1] for r in TRICKY]
    doc, code, count = langid.gram_counts(texts)
    for i, text in enumerate(texts):
        assert {gram_text(c): n for d, c, n in zip(doc, code, count, strict=True) if d == i} == dict(brute_grams(text))


def test_langid_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    rows = docs.select("doc_id", "text", "lang", held_out(F.col("doc_id"), 4, 2).alias("h")).collect()
    order = lambda grams: sorted(grams, key=lambda g: (-grams[g], [0] * (3 - len(g)) + [1 if c == "_" else ord(c) for c in g]))[: langid.PROFILE]
    learned = defaultdict(Counter)
    for r in rows:
        if not r["h"]:
            learned[r["lang"]] += brute_grams(r["text"])
    ranks = {k: {g: i for i, g in enumerate(order(v))} for k, v in learned.items()}
    got = {r["doc_id"]: r for r in langid.op12_langid(spark, sf).collect()}
    wrong = 0
    for r in rows:
        mine = order(brute_grams(r["text"]))
        far = {k: sum(abs(v[g] - i) if g in v else langid.PROFILE for i, g in enumerate(mine)) for k, v in ranks.items()}
        best = min(far, key=lambda k: (far[k], k.encode()))
        assert got[r["doc_id"]]["lang_pred"] == best and got[r["doc_id"]]["score"] == pytest.approx(1 - far[best] / (langid.PROFILE * len(mine)))
        wrong += r["h"] and best != r["lang"]
    assert wrong == 0


def test_langid_odd(spark, tricky, empty):
    profiles = langid.learn(tricky)
    out = langid.identify(tricky, profiles)
    assert out.columns == [*tricky.columns, "_lang_pred", "_score"]
    of = {r["doc_id"]: (r["_lang_pred"], r["_score"]) for r in out.collect()}
    assert of[1] == of[2] == of[7] == ("und", 0.0) and of[3][0] == "en" and of[10][0] == "de" and 0 <= of[6][1] <= 1
    assert langid.identify(empty, profiles).collect() == [] and {r["lang_pred"] for r in langid.identify(tricky.select("text"), langid.learn(empty)).collect()} == {"und"}


# 13 divergence


def rows_of(df):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect())


@pytest.mark.parametrize("whole", [False, True])
def test_divergence_odd(spark, tricky, monkeypatch, whole):
    monkeypatch.setattr(divergence, "CHUNK_BYTES", 8_000_000 if whole else 100)
    monkeypatch.setattr(divergence, "PAIR_BLOCK", 3)
    docs = tricky.unionByName(tricky.withColumn("source", F.lit("c"))).unionByName(tricky.where("doc_id > 5"))
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "lang", "source").toPandas())
    out = con.execute(divergence.ORACLE_SQL)
    names = [d[0] for d in out.description]
    want = sorted(tuple(r[names.index(c)] for c in ("lang", "source", "part", "item", "value", "rank")) for r in out.fetchall())
    assert rows_of(divergence.audit(docs)) == want and {r[2] for r in want} == {"pair", "term"}


def test_divergence_nothing_kept(spark, empty, tricky):
    assert divergence.audit(empty).collect() == []
    out = rows_of(divergence.audit(tricky, least=1000))
    assert {r[2] for r in out} == {"pair"} and {r[4] for r in out} == {0}


def test_share_is_exact(spark):
    n = 3 * 10**12 + 7
    row = spark.range(1).select(divergence.share(F.lit(10**12), F.lit(n), F.lit(5)).alias("p"), divergence.surplus(F.lit(10**9).cast("long"), F.lit(3).cast("long")).alias("f")).first()
    assert row["p"] == 1 + 10**9 * (10**12 + 1) // (n + 5) and row["f"] == (10**9 - 3) ** 2 // 3


# Links and numbers


def test_jaccard_links_through_rows_without_id(spark):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[a:b]) for a, b in ((0, 340), (16, 356), (32, 372))]
    docs = spark.createDataFrame([(1, texts[0]), (None, texts[1]), (2, texts[2]), (None, "all alone here"), (None, texts[1])], "doc_id long, text string")
    own, roots = jaccard.classes_and_links(docs, n=3, num=90, den=100)
    got = sorted((r["id"] or 0, r["component_id"] or 0) for r in jaccard.component_ids(own, roots).collect())
    assert got == [(0, 0), (0, 1), (0, 1), (1, 1), (2, 1)]


def test_pii_phones_and_short_names(spark):
    texts = ["Call (415) 555-1234, 315-555-1234 or +1 415 555 1234, +49 151 2345678 or +44 151 2345678.", "Mr Li met us. Later Li left."]
    rows = [r["text"] for r in pii.replace_entities(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()]
    head, second, third, german, british = (rows[0].split(w)[1] for w in ("Call ", ", ", " or ", ", +49 ", " or +44 "))
    digits = lambda s: "".join(c for c in s if c.isdigit())
    first, plus = digits(head.split(",")[0]), digits(third.split(",")[0])
    assert plus == f"1{first}" and first[:3] != "415" and digits(second.split(" or ")[0]) != first
    assert german.split(" or ")[0] != british.rstrip(".") and "Li" not in rows[1].split() and rows[1].count(rows[1].split()[1]) == 2
