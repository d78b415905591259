"""Training pairs and ordered digests against plain versions."""

import hashlib
import random
from collections import Counter

from fieldmark.operators.digest import ordered_digest
from fieldmark.operators.training_pairs import random_pairs


def test_random_pairs_meet_quotas(spark):
    rng = random.Random(1)
    root = {n: (1 if n <= 40 else n - n % 3) for n in range(1, 101)}
    root = {n: min(m for m in root if root[m] == r) for n, r in root.items()}
    members = Counter(root.values())
    known = {tuple(sorted(rng.sample(range(1, 101), 2))) for _ in range(60)} | {(a, b) for a in range(1, 12) for b in range(a + 1, 12)}
    df = spark.createDataFrame(sorted(root.items()), "node long, root long")
    out = random_pairs(df, spark.createDataFrame(sorted(known), "a long, b long"), 400, seed=3)
    plan = out._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    got = [tuple(r) for r in out.collect()]
    pairs = [(a, b) for a, b, _ in got]
    assert len(pairs) == len(set(pairs)) and all(a < b for a, b in pairs)
    assert {(a, b) for a, b, k in got if k == "known"} == known
    each = max(2, int((400 - len(known)) / len(members) / 2))
    same = Counter(root[a] for a, b, k in got if k == "same")
    assert all(root[a] == root[b] and (a, b) not in known for a, b, k in got if k == "same")
    for r, n in members.items():
        free = n * (n - 1) // 2 - sum(root[a] == root[b] == r for a, b in known)
        assert same[r] == min(each, free)
    different = [(root[a], root[b]) for a, b, k in got if k == "different"]
    assert all(r != s and p not in known for (r, s), p in zip(different, [(a, b) for a, b, k in got if k == "different"], strict=True))
    assert len({tuple(sorted(p)) for p in different}) == len(different)
    total = len(members) * (len(members) - 1) // 2
    assert len(got) == 400 or len(different) >= total - len(known)
    assert sorted(got) == sorted(tuple(r) for r in random_pairs(df.repartition(7), spark.createDataFrame(sorted(known), "a long, b long"), 400, seed=3).collect())


def test_random_pairs_of_all_there_are(spark):
    df = spark.createDataFrame([(n, n - n % 4) for n in range(4, 20)], "node long, root long")
    got = [tuple(r) for r in random_pairs(df, spark.createDataFrame([(4, 5)], "a long, b long"), 10**6).collect()]
    assert Counter(k for *_, k in got) == {"known": 1, "same": 23, "different": 6}
    empty = random_pairs(df.limit(0), spark.createDataFrame([], "a long, b long"), 10)
    assert empty.collect() == []


def plain_digest(rows, width):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    part = lambda v: "-" if v is None else "=" + str(v).encode().hex().upper()
    own = Counter((k, sha("|".join([part(k), part(v)]))) for k, v in rows)
    level = [sha(f"{h}*{n}") for (_, h), n in sorted(own.items(), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[0][1]))]
    for _ in range(3):
        up, node = [], ""
        for h in level:
            node += h
            if int(h[:8], 16) % width == 0:
                up, node = [*up, sha(node)], ""
        level = up + ([sha(node)] if node else [])
    return len(rows), sha("".join(level))


def test_digest_is_that_of_any_partitioning(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(400), rng.choice(["x", "", None, "é"])) for _ in range(500)] + [(None, "n"), (None, "n"), (None, None)]
    want = plain_digest(rows, 4)
    df = spark.createDataFrame(rows, "k long, v string")
    for n in (1, 5):
        assert tuple(ordered_digest(df.repartition(n), "k", "v", width=4).collect()[0]) == want
    assert tuple(ordered_digest(df.limit(0), "k", "v").collect()[0]) == plain_digest([], 4)
    assert tuple(ordered_digest(df.where("k <> 7"), "k", "v", width=4).collect()[0])[1] != want[1]


def test_old_names_by_parts(spark):
    import itertools

    from fieldmark.operators.components_deep import consistent_labels, with_parts

    rng = random.Random(5)
    rows = {(g, f"p{g // 3}-{rng.randrange(4)}") for g in range(12) for _ in range(3)} | {(20, None)}
    n = {k: rng.randrange(1, 9) for k in sorted(rows, key=str)}
    parted = with_parts(spark.createDataFrame([(*k, v) for k, v in n.items()], "grp long, old string, n long"))
    part = {r["grp"]: r["part"] for r in parted.collect()}
    assert part[20] == 20 and all(part[g] <= g and (part[g] == 20 or part[g] // 3 == g // 3) for g in part)
    assert all(part[g] == part[h] for (g, o), (h, p) in itertools.combinations(n, 2) if o == p and o is not None)
    got = {r["grp"]: r["name"] for r in consistent_labels(parted.where("old is not null")).collect()}
    assert len(set(got.values())) == len(got)
    for p in range(4):
        groups, names = [g for g in range(12) if g // 3 == p], sorted({o for g, o in n if o and g // 3 == p}) + [None] * 3
        best = max(sum(n.get((g, o), 0) for g, o in zip(groups, c, strict=True) if o) for c in itertools.permutations(names, 3))
        assert sum(n.get((g, got[g]), 0) for g in groups) == best
