"""What needs a whole component or a whole image at once: bridges, cuts, augmentation, relabelling, suppression.

Each function's unit is one component of the review graph or one image, which are bounded by how often an individual is
seen or how many boxes an image has. Units are dealt by hash into buckets of some ten thousand rows, each a call.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Callable
from itertools import groupby
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldmark.operators.graph import components, labelled, positive_components


BUCKET_ROWS = 20_000


def per_unit(df: DataFrame, unit: str, run: Callable[[list[Any]], list[tuple[Any, ...]]], schema: str) -> DataFrame:
    """The rows that run makes of each unit's rows (named tuples, in no fixed order)."""
    buckets = max(1, -(-df.count() // BUCKET_ROWS))

    def bucket(pdf: Any) -> Any:
        import pandas as pd

        out: list[tuple[Any, ...]] = []
        for _, rows in groupby(pdf.sort_values(unit).itertuples(index=False), key=lambda r: getattr(r, unit)):
            out += run(list(rows))
        return pd.DataFrame(out, columns=[f.split()[0] for f in schema.split(", ")])

    dealt = df.withColumn("bucket_", F.pmod(F.xxhash64(unit), F.lit(buckets)))
    return dealt.groupBy("bucket_").applyInPandas(bucket, schema)


def find_bridges(edges: list[tuple[int, int]]) -> set[tuple[int, int]]:
    """Edges whose removal disconnects their component: lowest reachable depth-first numbers, without recursion."""
    near: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for i, (a, b) in enumerate(edges):
        near[a].append((b, i))
        near[b].append((a, i))
    seen: dict[int, int] = {}
    low: dict[int, int] = {}
    out: set[tuple[int, int]] = set()
    for start in near:
        if start in seen:
            continue
        seen[start] = low[start] = len(seen)
        stack = [(start, -1, iter(near[start]))]
        while stack:
            node, came, it = stack[-1]
            for to, i in it:
                if i == came:
                    continue
                if to in seen:
                    low[node] = min(low[node], seen[to])
                else:
                    seen[to] = low[to] = len(seen)
                    stack.append((to, i, iter(near[to])))
                    break
            else:
                stack.pop()
                if stack:
                    parent = stack[-1][0]
                    low[parent] = min(low[parent], low[node])
                    if low[node] > seen[parent]:
                        out.add(tuple(sorted(edges[came])))
    return out


def min_cut(edges: list[tuple[int, int, float]], s: int, t: int) -> tuple[float, list[tuple[int, int]]]:
    """Weight and edges of a least cut between s and t: shortest augmenting paths."""
    cap: dict[int, dict[int, float]] = defaultdict(lambda: defaultdict(float))
    for a, b, w in edges:
        cap[a][b] += w
        cap[b][a] += w
    flow = 0.0
    while True:
        back = {s: s}
        queue = deque([s])
        while queue and t not in back:
            u = queue.popleft()
            for v, c in sorted(cap[u].items()):
                if c > 1e-12 and v not in back:
                    back[v] = u
                    queue.append(v)
        if t not in back:
            break
        path, v = [], t
        while v != s:
            path.append((back[v], v))
            v = back[v]
        least = min(cap[u][v] for u, v in path)
        for u, v in path:
            cap[u][v] -= least
            cap[v][u] += least
        flow += least
    side = set(back)
    return flow, sorted({(min(a, b), max(a, b)) for a, b, _ in edges if (a in side) != (b in side)})


def assignment(profit: list[list[float]]) -> list[int]:
    """Column of each row in an assignment of greatest profit (rows <= columns): shortest augmenting paths with potentials."""
    n, m = len(profit), len(profit[0]) if profit else 0
    u, v, match = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    way = [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = [float("inf")] * (m + 1), [False] * (m + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = match[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    c = -profit[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < least[j]:
                        least[j], way[j] = c, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    out = [-1] * n
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def bridges(edges: DataFrame) -> DataFrame:
    """(root, a, b): bridges of the positive components."""
    rows = labelled(edges.where("state = 'match'"), positive_components(edges)).select(F.col("r1").alias("root"), "a", "b").distinct()

    def run(own: list[Any]) -> list[tuple[Any, ...]]:
        return [(own[0].root, a, b) for a, b in sorted(find_bridges([(r.a, r.b) for r in own]))]

    return per_unit(rows, "root", run, "root long, a long, b long")


def two_edge_components(edges: DataFrame) -> DataFrame:
    """(node, root): components over match edges that are no bridges; nodes without such edges are their own."""
    rest = edges.where("state = 'match'").join(bridges(edges).select("a", "b"), ["a", "b"], "left_anti")
    nodes = positive_components(edges).select(F.col("node").alias("a")).withColumn("b", F.col("a"))
    return positive_components(rest.select("a", "b", F.lit("match").alias("state")).unionByName(nodes.withColumn("state", F.lit("match"))))


def positive_redundant(edges: DataFrame, k: int = 2) -> DataFrame:
    """(root, size) of components of two nodes and more that are k-edge-connected, for k 1 or 2."""
    roots = positive_components(edges)
    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return sizes if k <= 1 else sizes.join(bridges(edges).select("root").distinct(), "root", "left_anti")


def cut_hypotheses(edges: DataFrame, weight: str) -> DataFrame:
    """(root, a, b, kind): for each nomatch edge inside a positive component, the edges that are likely wrong: itself, if
    it weighs less than the least cut of the match edges between its ends, else the cut."""
    rows = labelled(edges.where("state IN ('match', 'nomatch')"), positive_components(edges)).where("r1 = r2")
    rows = rows.select(F.col("r1").alias("root"), "a", "b", "state", F.col(weight).cast("double").alias("w"))
    bad = rows.where("state = 'nomatch'").select("root").distinct()

    def run(own: list[Any]) -> list[tuple[Any, ...]]:
        pos = [(r.a, r.b, r.w) for r in own if r.state == "match"]
        out = set()
        for r in own:
            if r.state == "nomatch":
                total, cut = min_cut(pos, r.a, r.b)
                out |= {(r.a, r.b, "nomatch")} if r.w < total else {(a, b, "match") for a, b in cut}
        return [(own[0].root, *x) for x in sorted(out)]

    return per_unit(rows.join(bad, "root", "left_semi"), "root", run, "root long, a long, b long, kind string")


def augment(edges: DataFrame) -> DataFrame:
    """(root, a, b): edges that, added to a positive component, leave it without bridges: leaves of its bridge tree joined
    in a ring, half a turn apart."""
    rows = labelled(edges.where("state = 'match'"), positive_components(edges)).select(F.col("r1").alias("root"), "a", "b").distinct()

    def run(rows_: list[Any]) -> list[tuple[Any, ...]]:
        own = [(r.a, r.b) for r in rows_]
        cut = find_bridges(own)
        label: dict[int, int] = {}

        def find(x: int) -> int:
            while label.setdefault(x, x) != x:
                label[x] = label[label[x]]
                x = label[x]
            return x

        for a, b in own:
            find(a), find(b)
            if tuple(sorted((a, b))) not in cut:
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
        degree: dict[int, int] = defaultdict(int)
        near: dict[int, list[int]] = defaultdict(list)
        for a, b in cut:
            for x, y in ((find(a), find(b)), (find(b), find(a))):
                degree[x] += 1
                near[x].append(y)
        # Leaves in depth-first order, so that those half a turn apart lie in different subtrees.
        leaves, seen, stack = [], set(), [min(degree, key=lambda n: (degree[n] == 1, n))] if degree else []
        while stack:
            x = stack.pop()
            if x in seen:
                continue
            seen.add(x)
            leaves += [x] if degree[x] == 1 else []
            stack += sorted(near[x], reverse=True)
        half = (len(leaves) + 1) // 2
        found = sorted({(min(a, b), max(a, b)) for a, b in ((leaves[i], leaves[(i + half) % len(leaves)]) for i in range(half))}) if len(leaves) > 1 else []
        return [(rows_[0].root, a, b) for a, b in found]

    return per_unit(rows, "root", run, "root long, a long, b long")


def with_parts(members: DataFrame) -> DataFrame:
    """(grp, old, n) with part: the least group that a group reaches by old names that groups share. A null name is shared by none."""
    first = members.where("old is not null").groupBy("old").agg(F.min("grp").alias("b"))
    roots = components(members.join(first, "old").select(F.col("grp").alias("a"), "b"))
    return members.join(roots.select(F.col("node").alias("grp"), F.col("root").alias("part")), "grp", "left").withColumn("part", F.coalesce("part", "grp"))


def consistent_labels(members: DataFrame) -> DataFrame:
    """(grp, name): old names for new groups that change least; members has part, grp, old, n (rows of grp with old).

    part is a component of groups that share old names; groups for which no old name is left get a new one.
    """

    def run(own: list[Any]) -> list[tuple[Any, ...]]:
        groups, olds = sorted({r.grp for r in own}), sorted({r.old for r in own})
        count = {(r.grp, r.old): r.n for r in own}
        # One spare column for each group: no old name, worth nothing.
        profit = [[float(count.get((g, o), 0)) for o in olds] + [0.0] * len(groups) for g in groups]
        at = assignment(profit)
        names = [str(olds[j]) if j < len(olds) and profit[i][j] > 0 else f"_extra_name{g}" for i, (g, j) in enumerate(zip(groups, at, strict=True))]
        return list(zip(groups, names, strict=True))

    return per_unit(members, "part", run, "grp long, name string")


def suppress(boxes: DataFrame, most: float) -> DataFrame:
    """Non-maximum suppression: per image boxes (id, x, y, w, h, conf), surest first, that overlap no kept one by more."""

    def run(own: list[Any]) -> list[tuple[Any, ...]]:
        kept: list[Any] = []
        for r in sorted(own, key=lambda r: (-r.conf, r.id)):
            for k in kept:
                w, h = min(r.x + r.w, k.x + k.w) - max(r.x, k.x), min(r.y + r.h, k.y + k.h) - max(r.y, k.y)
                if w > 0 and h > 0 and w * h > most * (r.w * r.h + k.w * k.h - w * h):
                    break
            else:
                kept.append(r)
        return [(k.image, k.id, k.conf) for k in kept]

    return per_unit(boxes, "image", run, "image long, id long, conf double")


def merge_boxes(boxes: DataFrame, least: float, reviewers: int) -> DataFrame:
    """(image, cluster, n, x, y, w, h, interest): boxes by several reviewers, clustered greedily by overlap, averaged;
    interest where most say so; clusters of fewer reviewers go."""

    def run(own: list[Any]) -> list[tuple[Any, ...]]:
        clusters: list[list[Any]] = []
        for r in sorted(own, key=lambda r: (r.reviewer, r.id)):
            best, at = least, None
            for c in clusters:
                if any(k.reviewer == r.reviewer for k in c):
                    continue
                mean = 0.0
                for k in c:
                    w, h = min(r.x + r.w, k.x + k.w) - max(r.x, k.x), min(r.y + r.h, k.y + k.h) - max(r.y, k.y)
                    mean += (w * h / (r.w * r.h + k.w * k.h - w * h) if w > 0 and h > 0 else 0.0) / len(c)
                if mean > best:
                    best, at = mean, c
            at.append(r) if at is not None else clusters.append([r])
        return [(own[0].image, min(k.id for k in c), len(c), *(sum(getattr(k, f) for k in c) / len(c) for f in "xywh"), 2 * sum(bool(k.interest) for k in c) > len(c)) for c in clusters if len(c) >= reviewers]

    return per_unit(boxes, "image", run, "image long, cluster long, n long, x double, y double, w double, h double, interest boolean")


def assign_sequentially(truth: DataFrame, pred: DataFrame, least: float) -> DataFrame:
    """(image, p, t): predictions, surest first, each take the free truth of their class that they overlap most, if by
    `least` at least; truth: image, id, cls, x, y, w, h; pred has conf too."""
    both = truth.withColumn("conf", F.lit(None).cast("double")).withColumn("kind", F.lit("t")).unionByName(pred.withColumn("kind", F.lit("p")))

    def run(own: list[Any]) -> list[tuple[Any, ...]]:
        free, out = {r.id: r for r in own if r.kind == "t"}, []
        for r in sorted((r for r in own if r.kind == "p"), key=lambda r: (-r.conf, r.id)):
            best, at = least, None
            for t in sorted(free.values(), key=lambda t: t.id):
                w, h = min(r.x + r.w, t.x + t.w) - max(r.x, t.x), min(r.y + r.h, t.y + t.h) - max(r.y, t.y)
                o = w * h / (r.w * r.h + t.w * t.h - w * h) if t.cls == r.cls and w > 0 and h > 0 else 0.0
                if o >= best and o > 0:
                    best, at = o, t.id
            if at is not None:
                out.append((r.image, r.id, free.pop(at).id))
        return out

    return per_unit(both, "image", run, "image long, p long, t long")


def spanning_edges(nodes: DataFrame) -> DataFrame:
    """(grp, a, b): per group a least spanning tree by time difference; nodes: grp, node, t.

    On a line the tree joins neighbours in time.
    """
    last = lambda c: F.lag(c).over(W.partitionBy("grp").orderBy(F.col("t").asc_nulls_last(), "node"))
    return nodes.withColumn("a", last("node")).where(F.col("a").isNotNull()).select("grp", F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b"))
