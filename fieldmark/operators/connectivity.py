"""Review graphs beyond components: edge connectivity, what would raise it, spanning edges, and how two nodes are joined.

What needs flows runs within one two-edge-connected part of a component at a time, and three-edge classes within one
component, which is as large as an individual is often seen; all else is joins and components over the whole table. Edges are as in `graph`: a < b and a state.
"""

from __future__ import annotations

import random
from collections import defaultdict, deque
from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.lineage import store
from fieldmark.operators.components_deep import per_unit, two_edge_components
from fieldmark.operators.graph import components, labelled, nodes_of, positive_components


def cut_below(near: dict[int, set[int]], s: int, t: int, k: int) -> set[int] | None:
    """The side of s of a cut of fewer than k edges between s and t; None if every cut has k or more."""
    # Units of flow along an edge, from the lesser to the greater node.
    flow: dict[tuple[int, int], int] = {}
    for _ in range(k):
        back, queue = {s: s}, deque([s])
        while queue and t not in back:
            u = queue.popleft()
            for v in near[u]:
                if v not in back and (flow.get((u, v), 0) < 1 if u < v else flow.get((v, u), 0) > -1):
                    back[v] = u
                    queue.append(v)
        if t not in back:
            return set(back)
        v = t
        while v != s:
            u = back[v]
            flow[min(u, v), max(u, v)] = flow.get((min(u, v), max(u, v)), 0) + (1 if u < v else -1)
            v = u
    return None


def neighbours_of(edges: Iterable[tuple[int, int]]) -> dict[int, set[int]]:
    near: dict[int, set[int]] = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    return near


def three_edge_classes(near: dict[int, set[int]]) -> dict[int, int]:
    """edge_classes for k = 3, in time linear in nodes and edges.

    Two edges cut a graph if the same cycles pass them. Each edge that a depth-first tree leaves out gets random bits, and an edge
    of the tree the sum of those whose cycle it is on: none for a bridge, equal ones for edges that cut together, which lie
    on one way down the tree, with at most one edge beside it. They cut the graph into a ring of segments; a node's label
    sums, over all such sets, random bits of the segment it is in. Bits are 128, so no two sums agree by chance.
    """
    bits = random.Random(3).getrandbits
    order: list[int] = []
    up: dict[int, int | None] = {}
    when: dict[int, int] = {}
    cover: dict[int, int] = defaultdict(int)
    beside: set[int] = set()
    for start in sorted(near):
        if start in up:
            continue
        up[start], when[start] = None, len(order)
        order.append(start)
        stack = [(start, iter(near[start]))]
        while stack:
            u, todo = stack[-1]
            for v in todo:
                if v not in up:
                    up[v], when[v] = u, len(order)
                    order.append(v)
                    stack.append((v, iter(near[v])))
                    break
                if v != up[u] and when[v] < when[u]:
                    own = bits(128)
                    beside.add(own)
                    cover[u] ^= own
                    cover[v] ^= own
            else:
                stack.pop()
    for v in reversed(order):
        if up[v] is not None:
            cover[up[v]] ^= cover[v]
    left: dict[int, int] = defaultdict(int)
    for v in order:
        if up[v] is not None:
            left[cover[v]] += 1
    label: dict[int, int] = {}
    least: dict[int, int] = {}
    segment: dict[int, int] = defaultdict(int)
    for v in order:
        if up[v] is None:
            label[v] = bits(128)
            continue
        c = cover[v]
        left[c] -= 1
        # Below a set's last edge in the tree lies what is above its first, unless an edge beside the tree is cut with them.
        new = bits(128) if not c or left[c] or c in beside else 0
        label[v] = label[up[v]] ^ new ^ (segment[c] if c else 0)
        segment[c] = new
    for v in sorted(near):
        least.setdefault(label[v], v)
    return {v: least[label[v]] for v in near}


def edge_classes(near: dict[int, set[int]], k: int) -> dict[int, int]:
    """node -> least node of its class: nodes that no cut of fewer than k edges separates.

    A tree of cuts: each node in turn is cut from its parent, and takes along the later nodes on its side that have the
    same parent. Cuts of k edges or more separate nobody, so flows end at k.
    """
    if k == 3:
        return three_edge_classes(near)
    nodes = sorted(near)
    parent = {v: nodes[0] for v in nodes}
    joined: dict[int, int] = {v: v for v in nodes}
    for i, v in enumerate(nodes[1:], 1):
        p = parent[v]
        side = {v} if len(near[v]) < k else cut_below(near, v, p, k)
        if side is None:
            joined[v] = joined[p]
            continue
        for w in nodes[i + 1 :]:
            if parent[w] == p and w in side:
                parent[w] = v
    least: dict[int, int] = {}
    for v in nodes:
        least.setdefault(joined[v], v)
    return {v: least[joined[v]] for v in nodes}


def _inside(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(part, a, b): match edges with both ends in one part."""
    return labelled(edges.where("state = 'match' AND a <> b").select("a", "b").distinct(), roots).where("r1 = r2").select(F.col("r1").alias("part"), "a", "b")


def k_edge_components(edges: DataFrame, k: int) -> DataFrame:
    """(node, root) of all nodes: no k - 1 match edges' loss separates nodes of one root, though paths may leave the class."""
    if k <= 1:
        return positive_components(edges)
    if k == 2:
        return two_edge_components(edges)
    # Three edges take time linear in a component; more are sought in its two-edge-connected parts.
    parts = positive_components(edges) if k == 3 else two_edge_components(edges)

    def run(rows: list[Any]) -> list[tuple[Any, ...]]:
        return list(edge_classes(neighbours_of((r.a, r.b) for r in rows), k).items())

    found = per_unit(_inside(edges, parts), "part", run, "node long, root long")
    return parts.select("node").join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def k_edge_subgraphs(edges: DataFrame, k: int) -> DataFrame:
    """(node, root) of all nodes: largest sets whose own match edges leave them connected when any k - 1 are lost."""
    if k <= 1:
        return positive_components(edges)

    def run(rows: list[Any]) -> list[tuple[Any, ...]]:
        out: list[tuple[int, int]] = []
        todo = [neighbours_of((r.a, r.b) for r in rows)]
        while todo:
            near = todo.pop()
            groups: dict[int, set[int]] = defaultdict(set)
            for v, root in edge_classes(near, k).items():
                groups[root].add(v)
            for root, own in groups.items():
                if len(own) == 1 or len(groups) == 1:
                    out += [(v, root) for v in own]
                else:
                    # Only edges inside a class may hold it together.
                    inner = neighbours_of((v, w) for v in own for w in near[v] if v < w and w in own)
                    out += [(v, v) for v in own if v not in inner]
                    if inner:
                        todo.append(inner)
        return out

    found = per_unit(_inside(edges, two_edge_components(edges)), "part", run, "node long, root long")
    return nodes_of(edges).join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def augment_with(edges: DataFrame, available: DataFrame, k: int) -> DataFrame:
    """(root, a, b, w): available edges (a, b, w) that, added to the match edges, raise components to k edges between any
    two nodes, as far as they can: cheapest first where they join two classes, then without those that the others made
    needless, dearest first. Ties go to the lesser edge; available edges that leave a component are not used."""
    roots = positive_components(edges)
    own = labelled(edges.where("state = 'match' AND a <> b").select("a", "b").distinct(), roots).select(F.col("r1").alias("root"), "a", "b", F.lit(None).cast("double").alias("w"))
    extra = available.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("w").cast("double").alias("w")).where("a <> b AND w IS NOT NULL").groupBy("a", "b").agg(F.min("w").alias("w"))
    extra = labelled(extra, roots).where("r1 = r2").select(F.col("r1").alias("root"), "a", "b", "w")

    def run(rows: list[Any]) -> list[tuple[Any, ...]]:
        held = {(r.a, r.b) for r in rows if r.w != r.w or r.w is None}
        near = neighbours_of(held)
        classes = edge_classes(near, k)
        added: list[tuple[float, int, int]] = []
        for w, a, b in sorted((r.w, r.a, r.b) for r in rows if r.w == r.w and r.w is not None):
            if (a, b) not in held and classes[a] != classes[b]:
                near[a].add(b)
                near[b].add(a)
                added.append((w, a, b))
                classes = edge_classes(near, k)
        want = len(set(classes.values()))
        kept = []
        for w, a, b in sorted(added, key=lambda x: (-x[0], x[1], x[2])):
            near[a].discard(b)
            near[b].discard(a)
            if len(set(edge_classes(near, k).values())) > want:
                near[a].add(b)
                near[b].add(a)
                kept.append((rows[0].root, a, b, w))
        return kept

    return per_unit(own.unionByName(extra), "root", run, "root long, a long, b long, w double")


def spanning_forest(candidates: DataFrame) -> DataFrame:
    """(a, b, w): the edges of a least spanning forest of candidates (a, b, w), ties to the lesser edge.

    In rounds: every tree takes the least edge that leaves it, and trees so joined become one; their number at least halves.
    """
    edges = candidates.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w").where("a <> b AND w IS NOT NULL").groupBy("a", "b").agg(F.min("w").alias("w"))
    left = store(edges.withColumn("_a", F.col("a")).withColumn("_b", F.col("b")), "spanning-left")
    taken = left.select("a", "b", "w").limit(0)
    while left.limit(1).count():
        ends = left.select(F.col("_a").alias("tree"), "w", "a", "b", "_a", "_b").unionByName(left.select(F.col("_b").alias("tree"), "w", "a", "b", "_a", "_b"))
        best = store(ends.groupBy("tree").agg(F.min(F.struct("w", "a", "b", "_a", "_b")).alias("e")).select("e.*").distinct(), "spanning-best")
        taken = taken.unionByName(best.select("a", "b", "w"))
        roots = components(best.select(F.col("_a").alias("a"), F.col("_b").alias("b")))
        to = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}2"))  # noqa: E731, B023
        moved = left.join(to("_a"), "_a").join(to("_b"), "_b").where("_a2 <> _b2")
        left = store(moved.select("a", "b", "w", F.col("_a2").alias("_a"), F.col("_b2").alias("_b")), "spanning-left")
    return taken


def view_weights(observations: DataFrame, views: list[str], *, reach: int = 3) -> DataFrame:
    """(grp, a, b, w): within each name, pairs of observations at most `reach` places apart in time; w is a day and their time
    apart in seconds, and ten days for each step that their views differ by around the circle of views, 1.5 where either
    has none of them. observations: aid, nid, t, view."""
    from pyspark.sql import Window as W

    w = W.partitionBy("nid").orderBy(F.col("t").asc_nulls_last(), "aid")
    place = F.when(F.col("view").isin(views), F.array_position(F.array(*[F.lit(v) for v in views]), F.col("view")))
    own = observations.select("nid", "aid", "t", place.alias("v"))
    sides = [own.select("nid", F.col("aid").alias("x"), F.col("t").alias("tx"), F.col("v").alias("vx"), F.lead("aid", i).over(w).alias("y"), F.lead("t", i).over(w).alias("ty"), F.lead("v", i).over(w).alias("vy")) for i in range(1, reach + 1)]
    both = sides[0]
    for s in sides[1:]:
        both = both.unionByName(s)
    around = F.least(F.abs(F.col("vx") - F.col("vy")), F.lit(len(views)) - F.abs(F.col("vx") - F.col("vy")))
    weight = F.lit(86_400) + F.coalesce(F.abs(F.col("tx") - F.col("ty")), F.lit(0)) + (F.coalesce(around.cast("double"), F.lit(1.5)) * 864_000).cast("long")
    return both.where(F.col("y").isNotNull()).select(F.col("nid").alias("grp"), F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), weight.cast("long").alias("w"))


def pair_connections(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, root_a, root_b, state, hops, negatives) of pairs (a, b) of nodes: their components, the state of an edge of their
    own (null without), the least number of match edges from one to the other (null if none lead there) and the number of
    nomatch edges between their components (inside it, if it is one).

    Both ends of all pairs spread at once, a step each a round, within what has not been reached; a pair is done when its
    two sides meet, after half its length in rounds. Pairs with a node that no edge has are left out.
    """
    roots = store(positive_components(edges), "connection-roots")
    asked = pairs.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL").distinct()
    of = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
    known = store(asked.join(of("a"), "a").join(of("b"), "b"), "connection-pairs")
    direct = edges.select(F.least("a", "b").alias("_x"), F.greatest("a", "b").alias("_y"), "state").groupBy("_x", "_y").agg(F.min("state").alias("state"))
    step = edges.where("state = 'match'").select("a", "b")
    step = store(step.unionByName(step.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().select(F.col("a").alias("node"), F.col("b").alias("to")), "connection-steps")
    open_ = store(known.where("root_a = root_b").select("a", "b"), "connection-open")
    seen = {end: store(open_.select("a", "b", F.col(end).alias("node"), F.lit(0).alias("d")), "connection-seen") for end in ("a", "b")}
    found: list[DataFrame] = []
    depth = 0
    while open_.limit(1).count():
        meet = seen["a"].join(seen["b"].select("a", "b", "node", F.col("d").alias("e")), ["a", "b", "node"]).groupBy("a", "b").agg(F.min(F.col("d") + F.col("e")).alias("hops"))
        found.append(store(meet, "connection-found"))
        open_ = store(open_.join(found[-1], ["a", "b"], "left_anti"), "connection-open")
        depth += 1
        for end in ("a", "b"):
            rest = seen[end].join(open_, ["a", "b"], "left_semi")
            next_ = rest.where(F.col("d") == depth - 1).join(step, "node").select("a", "b", F.col("to").alias("node"), F.lit(depth).alias("d")).distinct()
            seen[end] = store(rest.unionByName(next_.join(rest.select("a", "b", "node"), ["a", "b", "node"], "left_anti")), "connection-seen")
    hops = found[0] if found else known.limit(0).select("a", "b", F.lit(0).alias("hops"))
    for f in found[1:]:
        hops = hops.unionByName(f)
    negatives = labelled(edges.where("state = 'nomatch'"), roots).groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("negatives"))
    out = known.withColumn("_x", F.least("a", "b")).withColumn("_y", F.greatest("a", "b")).join(direct, ["_x", "_y"], "left").join(hops, ["a", "b"], "left")
    out = out.withColumn("r1", F.least("root_a", "root_b")).withColumn("r2", F.greatest("root_a", "root_b")).join(negatives, ["r1", "r2"], "left")
    return out.select("a", "b", "root_a", "root_b", "state", F.col("hops").cast("long").alias("hops"), F.coalesce("negatives", F.lit(0)).cast("long").alias("negatives"))


def confidently_separated(pairs: DataFrame, edges: DataFrame, least: int) -> DataFrame:
    """(a, b, separated): whether a way of match edges and exactly one nomatch edge, all of at least this confidence, leads
    from a to b. edges: a, b, state, confidence (null: none).

    Match edges first fall into components; what is left is whether a nomatch edge joins the components of both ends, a
    component with such an edge inside being separated from itself. Nodes without edges are components of their own.
    """
    sure = edges.where(F.coalesce("confidence", F.lit(0)) >= least)
    asked = pairs.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL").distinct()
    roots = components(sure.where("state = 'match'").select("a", "b"))
    of = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"_root_{end}"))

    def meta(df: DataFrame) -> DataFrame:
        both = df.join(of("a"), "a", "left").join(of("b"), "b", "left").withColumn("_p", F.coalesce("_root_a", "a")).withColumn("_q", F.coalesce("_root_b", "b"))
        return both.select("a", "b", F.least("_p", "_q").alias("r1"), F.greatest("_p", "_q").alias("r2"))

    apart = meta(sure.where("state = 'nomatch'").select("a", "b")).select("r1", "r2").distinct().withColumn("separated", F.lit(True))
    return meta(asked).join(apart, ["r1", "r2"], "left").select("a", "b", F.coalesce("separated", F.lit(False)).alias("separated"))
