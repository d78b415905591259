"""The descriptor index, pair matching, spatial checks and connectivity against plain versions."""

import itertools
import math
import random
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldmark.operators import components_deep, connectivity, graph, pair_matching
from fieldmark.operators import descriptor_index as di
from fieldmark.operators.matching import knn
from fieldmark.plans.registry import descriptors

VEC = "fx long, aid long, vec array<double>"


def vectors(spark, n, seed, aids=20, dims=8, groups=6):
    g = np.random.default_rng(seed)
    centres = g.normal(size=(groups, dims)) * 4
    return spark.createDataFrame([(i, int(g.integers(aids)), (centres[i % groups] + g.normal(size=dims)).tolist()) for i in range(n)], VEC)


def rows(df):
    return sorted(tuple(r) for r in df.select("q_fx", "d_fx", "dist", "rank").collect())


def test_index_is_exact_and_cells_bound_it(spark, monkeypatch):
    monkeypatch.setattr(di, "BLOCK_ROWS", 16)
    monkeypatch.setattr(di, "CHUNK_ROWS", 8)
    data, queries = vectors(spark, 300, 1), vectors(spark, 40, 2)
    index = di.DescriptorIndex.build(data, cells=10, rounds=2)
    assert rows(index.search(queries, 4, probes=2, exact=True)) == rows(knn(queries, data, 4))
    assert rows(index.search(queries, 4, probes=2, exact=True, exclude="aid")) == rows(knn(queries, data, 4, exclude="aid"))
    assert rows(index.search(queries, 400, probes=1, exact=True)) == rows(knn(queries, data, 400))
    stats = {r["cell"]: r["m"] for r in index.live().groupBy("cell").agg(F.max("reach").alias("m")).collect()}
    first = index.search(queries, 4, probes=2).where("rank = 4").select(F.col("q_fx").alias("fx"), F.col("dist").alias("bound"))
    more = index._route(queries.select("fx", "vec").join(first, "fx"), 2, stats, True).count()
    assert more < 40 * 8 / 2


def test_index_recall(spark, sf):
    d = descriptors(spark, sf)
    index = di.DescriptorIndex.build(d, cells=64)
    found, want = index.search(d, 5, probes=40, exclude="aid"), knn(d, d, 5, exclude="aid")
    assert found.join(want, ["q_fx", "d_fx"], "left_semi").count() >= 0.9 * want.count()


def test_index_adds_and_removes_as_a_rebuild(spark):
    data, queries = vectors(spark, 200, 3), vectors(spark, 20, 4)
    index = di.DescriptorIndex.build(data.where("fx < 80"), cells=6, rounds=2)
    index.add(data.where("fx >= 80"))
    index.remove(data.where("aid < 7").select("aid"))
    index.remove(spark.createDataFrame([(12345,), (None,)], "aid long"))
    assert rows(index.search(queries, 3, exact=True)) == rows(knn(queries, data.where("aid >= 7"), 3))
    index.add(data.where("aid = 2"))
    left = data.where("aid >= 7 OR aid = 2")
    assert rows(index.search(queries, 3, exact=True)) == rows(knn(queries, left, 3)) == rows(index.compact().search(queries, 3, exact=True))
    index.remove(data.select("aid"))
    index.add(data.limit(0))
    assert rows(index.search(queries, 3, exact=True)) == []


def test_index_odd(spark):
    nothing = spark.createDataFrame([], VEC)
    index = di.DescriptorIndex.build(nothing, cells=4)
    index.add(spark.createDataFrame([(1, 1, [0.0, 1.0])], VEC))
    assert index.search(nothing, 2).collect() == [] and index.search(vectors(spark, 3, 1, dims=2), 2, exact=True).collect() == []
    data = spark.createDataFrame([(1, 1, [0.0, 1.0]), (2, None, [0.0, 1.0]), (None, 3, [1.0, 1.0]), (4, 4, None), (1, 5, [0.0, 3.0])], VEC)
    index = di.DescriptorIndex.build(data, cells=9, rounds=1)
    assert rows(index.search(data.where("fx = 1 AND aid = 1"), 5, exact=True)) == [(1, 1, 0.0, 1), (1, 1, 2.0, 3), (1, 2, 0.0, 2)]


def greedy_cover(wanted, sets, most=None):
    left, out = set(wanted), []
    for key, own in sorted(sets.items(), key=lambda x: (-len(x[1]), x[0])):
        if own <= left and (most is None or len(out) < most):
            out.append(key)
            left -= own
    return {(k, a) for k in out for a in sets[k]}, left


@pytest.mark.parametrize("seed", range(3))
def test_cover(spark, seed):
    g = random.Random(seed)
    sets = {k: set(g.sample(range(40), g.randint(1, 6))) for k in range(30)}
    wanted = set(g.sample(range(40), 32))
    members = spark.createDataFrame([(k, a) for k, own in sets.items() for a in own] + [(0, min(sets[0]))], "key long, aid long")
    for most in (None, 2):
        kept, missing = di.cover(spark.createDataFrame([(a,) for a in wanted], "aid long"), members, most)
        assert ({tuple(r) for r in kept.collect()}, {r[0] for r in missing.collect()}) == greedy_cover(wanted, sets, most)


# Pairs


def frame(g, n):
    return np.column_stack([g.uniform(0, 1000, n), g.uniform(0, 1000, n), g.uniform(1, 5, n), g.uniform(-3, 3, n)])


def moved(m, p):
    """p under a 3 x 3 map, frames included."""
    out = []
    for x, y, s, o in p:
        at = lambda u, v: (lambda w: (w[0] / w[2], w[1] / w[2]))(m @ [u, v, 1])
        e = 1e-4
        (x0, y0), (x1, y1), (x2, y2) = at(x, y), at(x + e, y), at(x, y + e)
        j = np.array([[x1 - x0, x2 - x0], [y1 - y0, y2 - y0]]) / e
        d = j @ [math.cos(o), math.sin(o)]
        out.append((x0, y0, s * math.sqrt(abs(np.linalg.det(j))), math.atan2(d[1], d[0])))
    return np.array(out)


MAPS = {
    "similarity": np.array([[0.8, -0.6, 40], [0.6, 0.8, -7], [0, 0, 1]]) * [[1.5, 1.5, 1], [1.5, 1.5, 1], [1, 1, 1]],
    "affine": np.array([[1.1, 0.2, 10], [-0.1, 0.9, 30], [0, 0, 1]]),
    "homography": np.array([[1.0, 0.05, 12], [0.02, 1.05, -20], [6e-5, -4e-5, 1]]),
}


@pytest.mark.parametrize("kind", MAPS)
def test_planted_maps_are_found(spark, kind):
    g = np.random.default_rng(7)
    p = frame(g, 60)
    q = moved(MAPS[kind], p)
    wrong = np.arange(60) >= 40
    q[wrong] = frame(g, 20)
    best, m, flags = pair_matching.verify_matches(p, q, share=0.05)
    assert (flags == ~wrong).all() and best < 40 and (kind == "similarity" or np.abs(moved(m, p[:40])[:, :2] - q[:40, :2]).max() < 1e-6 * 1000)
    points = spark.createDataFrame([(aid, i, *map(float, r)) for aid, side in ((1, p), (2, q)) for i, r in enumerate(side)], "aid long, fx long, x double, y double, scale double, ori double")
    matches = spark.createDataFrame([(1, 2, i, i) for i in range(60)] + [(1, 3, 0, 0)], "a long, b long, fx1 long, fx2 long")
    out = pair_matching.spatially_verified(matches, points, share=0.05).collect()
    assert sorted(r["fx1"] for r in out) == list(range(40)) and {(r["a"], r["b"], r["hypothesis"]) for r in out} == {(1, 2, best)}


def test_hypotheses_brute_force():
    g = np.random.default_rng(3)
    p, q = frame(g, 30), frame(g, 30)
    near = 0.3 * math.hypot(np.ptp(q[:, 0]), np.ptp(q[:, 1]))
    count = []
    for h in range(30):
        s, t = q[h, 2] / p[h, 2], q[h, 3] - p[h, 3]
        m = np.array([[s * math.cos(t), -s * math.sin(t), 0], [s * math.sin(t), s * math.cos(t), 0], [0, 0, 1]])
        m[:2, 2] = q[h, :2] - (m @ [*p[h, :2], 1])[:2]
        n = 0
        for a, b in zip(p, q, strict=True):
            u = (m @ [a[0], a[1], 1])[:2]
            turn = abs(math.remainder(a[3] + t - b[3], math.tau))
            n += math.dist(u, b[:2]) <= near and max(s * a[2] / b[2], b[2] / (s * a[2])) <= 2 and turn <= math.tau / 4
        count.append(n)
    best, _, flags = pair_matching.verify_matches(p, q, refine="none", share=0.3)
    assert best == count.index(max(count)) and flags.sum() == max(count)
    assert pair_matching.homography_fit(p[:1].repeat(5, axis=0), q[:5]) is None


def test_pair_matches_odd(spark):
    f = spark.createDataFrame([(1, 1, [0.0, 0.0]), (1, 2, [5.0, 5.0]), (2, 3, [0.0, 1.0]), (2, 4, [0.0, 4.0]), (3, 5, [0.0, 0.0]), (4, 6, None), (5, 7, [0.0, 0.0]), (5, 8, [0.0, 0.0])], "aid long, fx long, vec array<double>")
    pairs = spark.createDataFrame([(1, 2), (1, 2), (1, 3), (1, 4), (1, 9), (None, 2), (1, 5)], "a long, b long")
    got = sorted(tuple(r) for r in pair_matching.pair_matches(pairs, f, ratio=0.9).collect())
    assert [r[:6] for r in got] == [(1, 2, 1, 3, 1.0, 4.0), (1, 2, 2, 4, 5.09902, 6.40312)] and pair_matching.pair_matches(pairs, f, ratio=0.9, mutual=True).count() == 1
    table = pair_matching.pair_features(pairs.where("a IS NOT NULL"), pair_matching.pair_matches(pairs, f), f.groupBy("aid").agg(F.min("fx").alias("first"))).collect()
    assert {(r["b"], r["matches"], r["delta_first"]) for r in table} == {(2, 2, 2), (3, 0, 4), (4, 0, 5), (9, 0, None), (5, 0, 6)}


# Connectivity


def random_edges(seed, n=14, p=0.3):
    g = random.Random(seed)
    return [(a, b) for a, b in itertools.combinations(range(n), 2) if g.random() < p]


def flow(edges, s, t):
    """Edge-disjoint ways, by augmenting paths over arcs of both directions."""
    cap = defaultdict(int)
    for a, b in edges:
        cap[a, b] += 1
        cap[b, a] += 1
    total = 0
    while True:
        back, todo = {s: s}, [s]
        while todo:
            u = todo.pop()
            for (x, v), c in list(cap.items()):
                if x == u and c > 0 and v not in back:
                    back[v] = u
                    todo.append(v)
        if t not in back:
            return total
        while t != s and (v := t) is not None:
            while v != s:
                cap[back[v], v] -= 1
                cap[v, back[v]] += 1
                v = back[v]
            break
        total += 1


def classes_of(df):
    out = defaultdict(set)
    for r in df.collect():
        out[r["root"]].add(r["node"])
    assert all(min(own) == root for root, own in out.items())
    return sorted(map(sorted, out.values()))


def as_edges(spark, edges, extra=()):
    return spark.createDataFrame([(a, b, "match") for a, b in edges] + [(a, b, "nomatch") for a, b in extra], "a long, b long, state string")


@pytest.mark.parametrize("seed, k", [(s, k) for s in range(12) for k in (2, 3, 4)])
def test_edge_classes_brute_force(seed, k):
    edges = random_edges(seed, 10, 0.25 + seed / 30)
    near = connectivity.neighbours_of(edges)
    got = connectivity.edge_classes(near, k)
    for s, t in itertools.combinations(sorted(near), 2):
        assert (got[s] == got[t]) == (flow(edges, s, t) >= k)


def test_three_edge_classes_of_a_large_part():
    """A long ladder: three ways join the ends of an inner rung, two ways all else. Flows between its nodes would take hours."""
    near = connectivity.neighbours_of([e for i in range(0, 20000, 2) for e in ((i, i + 1), (i, i + 2), (i + 1, i + 3))])
    began = time.perf_counter()
    got = connectivity.edge_classes(near, 3)
    assert time.perf_counter() - began < 60
    assert got == {v: v - v % 2 if 2 <= v < 19998 else v for v in range(20002)}


def test_k3_components_label_the_table_once(spark, monkeypatch):
    """Components go over the whole table in many rounds, so once must do."""
    rounds = []
    monkeypatch.setattr(connectivity, "positive_components", lambda edges: rounds.append(1) or graph.positive_components(edges))
    monkeypatch.setattr(components_deep, "positive_components", connectivity.positive_components)
    connectivity.k_edge_components(as_edges(spark, [(1, 2), (2, 3), (1, 3)]), 3)
    assert len(rounds) == 1


def plain_subgraphs(edges, nodes, k):
    """Split by any pair that fewer than k ways join, inside what is left, until none is."""
    own = [(a, b) for a, b in edges if a in nodes and b in nodes]
    for s, t in itertools.combinations(sorted(nodes), 2):
        if flow(own, s, t) < k:
            side = {v for v in nodes if v == s or flow(own, s, v) >= k}
            return plain_subgraphs(edges, side, k) + plain_subgraphs(edges, nodes - side, k)
    return [sorted(nodes)]


@pytest.mark.parametrize("seed", range(2))
def test_k_edge_tables(spark, seed):
    edges = random_edges(seed + 40, 12, 0.3)
    far = [(a + 100, b + 100) for a, b in random_edges(seed + 50, 9, 0.5)]
    nodes = {v for e in edges + far for v in e} | {998, 999}
    table = as_edges(spark, edges + far, [(998, 999)])
    for k in (1, 3):
        want, left = [], set(nodes)
        while left:
            v = min(left)
            own = {u for u in left if u == v or flow(edges + far, v, u) >= k}
            want.append(sorted(own))
            left -= own
        assert classes_of(connectivity.k_edge_components(table, k)) == sorted(want)
    assert classes_of(connectivity.k_edge_subgraphs(table, 3)) == sorted(plain_subgraphs(edges + far, nodes, 3))


@pytest.mark.parametrize("k", [2, 3])
def test_augment_with(spark, k):
    ring = [(i, i + 1) for i in range(7)]
    g = random.Random(k)
    extra = [(a, b, float(g.randint(1, 9))) for a, b in itertools.combinations(range(8), 2) if (a, b) not in ring]
    got = [tuple(r) for r in connectivity.augment_with(as_edges(spark, ring), spark.createDataFrame([*extra, (0, 99, 1.0), (3, 3, 1.0)], "a long, b long, w double"), k).collect()]
    chosen = [(a, b) for _, a, b, _ in got]
    assert {(a, b, w) for _, a, b, w in got} <= set(extra) and all(flow(ring + chosen, 0, v) >= k for v in range(1, 8))
    for e in chosen:
        assert min(flow(ring + [x for x in chosen if x != e], 0, v) for v in range(1, 8)) < k


@pytest.mark.parametrize("seed", range(3))
def test_spanning_forest(spark, seed):
    g = random.Random(seed)
    edges = [(a, b, g.randint(1, 6)) for a, b in random_edges(seed, 16, 0.2)]
    root = {v: v for e in edges for v in e[:2]}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    want = set()
    for w, a, b in sorted((w, a, b) for a, b, w in edges):
        if find(a) != find(b):
            root[find(a)] = find(b)
            want.add((a, b, w))
    table = spark.createDataFrame([*edges, (5, 5, 0), (edges[0][1], edges[0][0], 99), (3, 4, None)], "a long, b long, w long")
    assert {tuple(r) for r in connectivity.spanning_forest(table).collect()} == want and connectivity.spanning_forest(table.limit(0)).collect() == []


def test_separated_cases(spark):
    edges = [(1, 2, "match"), (3, 4, "match"), (5, 6, "match"), (7, 8, "match"), (1, 5, "nomatch"), (5, 8, "nomatch"), (3, 6, "nomatch")]
    table = lambda rows: spark.createDataFrame([(*e, 3) for e in rows], "a long, b long, state string, confidence int")
    ask = spark.createDataFrame([(1, 4), (2, 6), (1, 1), (9, 10), (None, 1)], "a long, b long")
    of = lambda rows, least: {(r["a"], r["b"]): r["separated"] for r in connectivity.confidently_separated(ask, table(rows), least).collect()}
    # Two nomatch edges lie between 1 and 4; then one does.
    assert of(edges, 0) == {(1, 4): False, (2, 6): True, (1, 1): False, (9, 10): False}
    assert of([*edges, (2, 3, "nomatch")], 3)[1, 4] and not of([*edges, (2, 3, "nomatch")], 4)[1, 4]


def test_pair_connection_on_a_path(spark):
    edges = as_edges(spark, [(i, i + 1) for i in range(9)], [(0, 9), (3, 50)])
    out = connectivity.pair_connections(spark.createDataFrame([(0, 9), (4, 2), (3, 3), (0, 50), (0, 77), (1, None)], "a long, b long"), edges)
    assert {tuple(r) for r in out.collect()} == {(0, 9, 0, 0, "nomatch", 9, 1), (4, 2, 0, 0, None, 2, 1), (3, 3, 0, 0, None, 0, 1), (0, 50, 0, 50, None, None, 1)}


@pytest.mark.parametrize("name", ["match_rank_nsum", "match_candidate_pairs", "match_votes_name_rule", "smk_scores"])
def test_neighbours_are_searched_once(spark, sf, name):
    from fieldmark.plans import matches

    df = getattr(matches, name)(spark, sf)
    tree = df._jdf.queryExecution().optimizedPlan().toString()
    assert tree.count("FlatMapCoGroupsInArrow") <= (7 if name == "smk_scores" else 1)
