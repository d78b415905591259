"""A review graph that gains and loses edges, against components from scratch after every batch."""

import random
from collections import Counter

from fieldmark.streaming.review_graph import ReviewGraph

EDGE = "a long, b long, state string, seq long"


def plain(edges):
    root = {n: n for e in edges for n in e}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for (a, b), (_, state) in edges.items():
        if state == "match":
            x, y = sorted((find(a), find(b)))
            root[y] = x
    roots = {n: find(n) for n in root}
    apart = Counter(tuple(sorted((roots[a], roots[b]))) for (a, b), (_, state) in edges.items() if state == "nomatch")
    return sorted(roots.items()), sorted((*k, n) for k, n in apart.items())


def test_any_prefix_of_batches(spark, tmp_path):
    rng = random.Random(4)
    held, edges = ReviewGraph(spark, f"file://{tmp_path}/g"), {}
    for i in range(4):
        batch = []
        for _ in range(25):
            a, b = rng.sample(range(24), 2)
            batch.append((a, b, rng.choice(["match", "match", "nomatch", "unknown"]), rng.randrange(60)))
        if i == 1:
            batch += [(3, 3, "match", 99), (None, 4, "match", 99), (4, 5, None, 99)]
        for a, b, state, seq in batch:
            if a is not None and a != b and state is not None:
                key = (min(a, b), max(a, b))
                edges[key] = max(edges.get(key, (-1, "")), (seq, state))
        df = spark.createDataFrame(batch, EDGE)
        held.apply(df, i)
        if i == 2:
            held.apply(df, i)  # run again, as after a failure
        if i == 3:
            held.apply(df.limit(0), 4)
        want = plain(edges)
        assert sorted(tuple(r) for r in held.roots().collect()) == want[0]
        assert sorted(tuple(r) for r in held.negatives().select("r1", "r2", "n").collect()) == want[1]
    short = held.snapshot(f"file://{tmp_path}/s")
    assert sorted(tuple(r) for r in short.roots().collect()) == want[0]


def test_a_lost_edge_splits(spark, tmp_path):
    held = ReviewGraph(spark, f"file://{tmp_path}/g")
    held.apply(spark.createDataFrame([(1, 2, "match", 1), (2, 3, "match", 1), (1, 3, "nomatch", 1)], EDGE), 0)
    assert [tuple(r) for r in held.negatives().collect()] == [(1, 1, 1)]
    held.apply(spark.createDataFrame([(3, 2, "nomatch", 2)], EDGE), 1)
    assert sorted(tuple(r) for r in held.roots().collect()) == [(1, 1), (2, 1), (3, 3)]
    assert [tuple(r) for r in held.negatives().collect()] == [(1, 3, 2)]
