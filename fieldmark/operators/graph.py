"""Review graphs: components, consistency, categories, redundancy, priorities.

Edges are undirected, with a < b and a state: match, nomatch, notcomp, unreviewed or unknown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldmark.lineage import discard, store


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, root): the least node that each node of an edge reaches.

    Labels fall to the least among neighbours and then jump to their label's label, so rounds grow with the logarithm of
    a component's width. Each round's labels are written, which cuts the lineage; a hub's neighbours are combined before
    they are shuffled. Self-loops are allowed, null ends are not.
    """
    both = store(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = store(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "cc-labels")
    while True:
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("least"))
        near = labels.join(around, "node", "left").select("node", F.least("root", "least").alias("near"), "root")
        hop = labels.select(F.col("node").alias("near"), F.col("root").alias("far"))
        moved = store(near.join(hop, "near", "left").select("node", F.least("near", "far").alias("to"), "root"), "cc-labels")
        discard(labels)
        labels = moved.select("node", F.col("to").alias("root"))
        if not moved.where(F.col("to") != F.col("root")).limit(1).count():
            discard(both)
            return labels


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()


def positive_components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes: components over match edges; nodes without any are their own."""
    roots = components(edges.where("state = 'match'"))
    return store(nodes_of(edges).join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "pcc")


def labelled(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """edges with the roots of both ends, and the pair of roots in order as r1 and r2."""
    a, b = roots.select(F.col("node").alias("a"), F.col("root").alias("root_a")), roots.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
    both = edges.join(a, "a").join(b, "b")
    return both.withColumn("r1", F.least("root_a", "root_b")).withColumn("r2", F.greatest("root_a", "root_b"))


def inconsistent(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, negatives): components with a nomatch edge inside."""
    inner = labelled(edges.where("state = 'nomatch'"), roots).where("r1 = r2")
    return inner.groupBy(F.col("r1").alias("root")).agg(F.count(F.lit(1)).alias("negatives"))


def categories(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(r1, r2, category) of every pair of components that an edge joins, and of every component with an edge inside.

    Match over nomatch over what infers nothing; a component that holds both match and nomatch is inconsistent, and so,
    outwardly, are all edges that leave it.
    """
    rows = labelled(edges, roots)
    has = lambda s: F.max((F.col("state") == s).cast("int"))
    per = rows.groupBy("r1", "r2").agg(has("match").alias("m"), has("nomatch").alias("n"), has("notcomp").alias("c"), has("unknown").alias("u"), F.count(F.lit(1)).alias("edges"))
    bad = inconsistent(edges, roots).select("root")
    per = per.join(bad.select(F.col("root").alias("r1"), F.lit(True).alias("bad1")), "r1", "left").join(bad.select(F.col("root").alias("r2"), F.lit(True).alias("bad2")), "r2", "left")
    inner = F.col("r1") == F.col("r2")
    category = (
        F.when(inner & F.col("bad1"), "inconsistent_internal").when(F.col("bad1") | F.col("bad2"), "inconsistent_external").when(F.col("m") == 1, "positive")
        .when(F.col("n") == 1, "negative").when(F.col("c") == 1, "incomparable").when(F.col("u") == 1, "unknown").otherwise("unreviewed")
    )
    return per.select("r1", "r2", category.alias("category"), "edges")


def negative_counts(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(r1, r2, n): the metagraph of nomatch edges between components."""
    return labelled(edges.where("state = 'nomatch'"), roots).where("r1 <> r2").groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("n"))


def negative_redundant(edges: DataFrame, roots: DataFrame, k: int = 2) -> DataFrame:
    """Pairs of components with k nomatch edges between them, or as many as one of the two has nodes."""
    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    n = negative_counts(edges, roots).join(sizes.select(F.col("root").alias("r1"), F.col("size").alias("s1")), "r1").join(sizes.select(F.col("root").alias("r2"), F.col("size").alias("s2")), "r2")
    return n.where((F.col("n") >= k) | (F.col("n") == F.col("s1")) | (F.col("n") == F.col("s2"))).select("r1", "r2", "n")


def complete_components(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, size): components of two nodes and more whose match and incomparable edges join all pairs."""
    inner = labelled(edges.where("state IN ('match', 'notcomp')"), roots).where("r1 = r2").select("r1", "a", "b").distinct().groupBy(F.col("r1").alias("root")).agg(F.count(F.lit(1)).alias("e"))
    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    return sizes.join(inner, "root").where(F.col("e") == F.col("size") * (F.col("size") - 1) / 2).select("root", "size")


def not_redundant(edges: DataFrame, roots: DataFrame, k: int = 2) -> DataFrame:
    """Edges neither inside complete components nor between negative-redundant pairs."""
    rows = labelled(edges, roots)
    done = complete_components(edges, roots).select(F.col("root").alias("r1"), F.col("root").alias("r2")).union(negative_redundant(edges, roots, k).select("r1", "r2"))
    return rows.join(done, ["r1", "r2"], "left_anti").select("a", "b", "state")


def priorities(edges: DataFrame, roots: DataFrame, metric: str) -> DataFrame:
    """(a, b, priority): the metric, 1e-9 where it is missing; 10 more for edges inside inconsistent components."""
    bad = inconsistent(edges, roots).select(F.col("root").alias("r1"), F.lit(True).alias("bad"))
    rows = labelled(edges, roots).join(bad, "r1", "left")
    base = F.when(F.col(metric).isNull() | F.isnan(F.col(metric)), 1e-9).otherwise(F.col(metric))
    return rows.select("a", "b", (base + F.when(F.col("bad") & (F.col("r1") == F.col("r2")), 10.0).otherwise(0.0)).alias("priority"))


def status(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """One row of totals: edges by state, components, inconsistent components."""
    states = edges.agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("match", "nomatch", "notcomp", "unreviewed", "unknown")])
    return states.crossJoin(roots.agg(F.count_distinct("root").alias("components"))).crossJoin(inconsistent(edges, roots).agg(F.count(F.lit(1)).alias("inconsistent")))


def latest_reviews(log: DataFrame, order: list[Column]) -> DataFrame:
    """(a, b, state, reviews): each pair's last review in this order, and how many it has."""
    w = W.partitionBy("a", "b")
    nth = F.row_number().over(w.orderBy(*order))
    return log.withColumn("_nth", nth).withColumn("reviews", F.count(F.lit(1)).over(w)).where(F.col("_nth") == 1).select("a", "b", "state", "reviews")


def collapse(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """(r1, r2, n): the quotient graph by (node, root), edges within a group left out."""
    return labelled(edges, groups).where("r1 <> r2").groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("n"))


def corrected_priorities(edges: DataFrame, roots: DataFrame, metric: str, negative: str, positive: str) -> DataFrame:
    """(a, b, priority): below 10, what an edge tells against its state counts: the probability of no match inside a
    component, of a match between two."""
    base = priorities(edges, roots, metric).withColumnRenamed("priority", "p")
    rows = labelled(edges.select("a", "b", negative, positive).dropDuplicates(["a", "b"]), roots).join(base.groupBy("a", "b").agg(F.max("p").alias("p")), ["a", "b"])
    other = F.when(F.col("r1") == F.col("r2"), F.col(negative)).otherwise(F.col(positive))
    return rows.select("a", "b", F.when(F.col("p") < 10, F.greatest(other, F.lit(1e-9))).otherwise(F.col("p")).alias("priority"))


def confidently_connected(edges: DataFrame, least: int) -> DataFrame:
    """(node, root): components over match edges of at least this confidence."""
    return components(edges.where((F.col("state") == "match") & (F.col("confidence") >= least)))


def connecting_edges(edges: DataFrame, names: DataFrame) -> DataFrame:
    """(name, a, b): edges that join the positive components of a name in a chain, by their least nodes; names: node, name."""
    roots = positive_components(edges)
    per = names.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).groupBy("name", "root").agg(F.min("node").alias("b"))
    last = F.lag("b").over(W.partitionBy("name").orderBy("b"))
    return per.withColumn("a", last).where(F.col("a").isNotNull()).select("name", "a", "b")


def negative_candidates(edges: DataFrame, roots: DataFrame, k: int = 2) -> DataFrame:
    """(a, b): for pairs of components with too few nomatch edges, as many of their unjoined pairs of nodes as are missing.

    Pairs of components are those that an edge joins already; of each component the k nodes of least id are enough.
    """
    have = labelled(edges, roots).where("r1 <> r2").groupBy("r1", "r2").agg(F.count_if(F.col("state") == "nomatch").alias("n")).where(F.col("n") < k)
    few = roots.withColumn("i", F.row_number().over(W.partitionBy("root").orderBy("node"))).where(F.col("i") <= k)
    left, right = few.select(F.col("root").alias("r1"), F.col("node").alias("x")), few.select(F.col("root").alias("r2"), F.col("node").alias("y"))
    free = have.join(left, "r1").join(right, "r2").select("r1", "r2", "n", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    free = free.join(edges.select("a", "b"), ["a", "b"], "left_anti")
    nth = F.row_number().over(W.partitionBy("r1", "r2").orderBy("a", "b"))
    return free.withColumn("i", nth).where(F.col("i") <= k - F.col("n")).select("a", "b")


def auto_review(edges: DataFrame, match: float, nomatch: float, notcomp: float) -> DataFrame:
    """edges with decision: the state whose probability (p_match, p_nomatch, p_notcomp) passes its threshold; null if none or several do."""
    passes = [(F.col("p_match") > match), (F.col("p_nomatch") > nomatch), (F.col("p_notcomp") > notcomp)]
    n = sum(p.cast("int") for p in passes)
    return edges.withColumn("decision", F.when(n == 1, F.when(passes[0], "match").when(passes[1], "nomatch").otherwise("notcomp")))
