"""Single-linkage clusters of keys, from the minimum spanning tree of their distances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.sources.sink import written


def _roots(hooks: DataFrame) -> DataFrame:
    """id, root: hooks (id, up) followed to their ends by doubling; an end has itself as up."""
    now = written(hooks)
    while True:
        jump = now.join(now.select(F.col("id").alias("up"), F.col("up").alias("further")), "up")
        now = written(jump.select("id", F.col("further").alias("up"), (F.col("further") != F.col("up")).alias("moved")))
        if not now.where("moved").limit(1).count():
            return now.select("id", F.col("up").alias("root"))
        now = now.select("id", "up")


def minimum_tree(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tree, labels): the edges of a minimum spanning forest of edges (a, b, d), and id, label of all nodes (id), a label for each part that hangs together.

    Boruvka's rounds: each part takes its least edge to another (of equal ones that of the least ends, so there are no
    circles), and parts that are joined become one. Parts at least halve in a round. Labels are nodes' ids. Edges within a
    part are dropped as they appear, so each round reads less.
    """
    labels = written(nodes.select("id", F.col("id").alias("label")).distinct())
    left = written(edges.where("a <> b AND d IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("d").cast("double").alias("d"), F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")))
    tree = None
    while left.limit(1).count():
        ends = left.select(F.col("x").alias("id"), F.col("y").alias("other"), "d", "a", "b").unionByName(left.select(F.col("y").alias("id"), F.col("x").alias("other"), "d", "a", "b"))
        least = written(ends.groupBy("id").agg(F.min_by(F.struct("other", "d", "a", "b"), F.struct("d", "a", "b")).alias("e")).select("id", "e.*"))
        own = least.select("a", "b", "d").distinct()
        tree = own if tree is None else tree.unionByName(own)
        # Two parts that chose the same edge would point at each other: the lesser one is the end.
        twin = least.select(F.col("id").alias("other"), F.col("other").alias("back"))
        hooks = least.join(twin, "other", "left").select("id", F.when((F.col("back") == F.col("id")) & (F.col("id") < F.col("other")), F.col("id")).otherwise(F.col("other")).alias("up"))
        roots = _roots(hooks)
        at = lambda df, c: df.join(roots.select(F.col("id").alias(c), "root"), c, "left").withColumn(c, F.coalesce("root", c)).drop("root")
        labels = written(at(labels, "label").select("id", "label"))
        left = written(at(at(left, "x"), "y").where("x <> y").select("a", "b", "d", "x", "y"))
    return left.select("a", "b", "d") if tree is None else tree, labels


def correlation_clusters(correlations: DataFrame, k: int, min_size: int, rho: str = "rho") -> DataFrame:
    """id, cluster: keys of correlations (a, b, rho) in k single-linkage clusters by the distance 1 - rho.

    The hierarchy is the minimum spanning tree: without its longest edges (of equal ones those of the greater ends go first)
    it falls into k clusters, or into more if so many parts don't hang together at all. A cluster goes by its least key;
    keys of clusters below min_size have null. Pairs without a rho are no edge.
    """
    edges = written(correlations.select("a", "b", (1 - F.col(rho)).alias("d")))
    nodes = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    tree, labels = minimum_tree(nodes, edges)
    more = k - labels.select("label").distinct().count()
    if more > 0:
        long = tree.orderBy(F.desc("d"), F.desc("a"), F.desc("b")).limit(more).select("a", "b")  # as many as clusters are asked for
        _, labels = minimum_tree(nodes, tree.join(long, ["a", "b"], "left_anti"))
    size = labels.groupBy("label").agg(F.min("id").alias("_least"), F.count("*").alias("_n"))
    return labels.join(size, "label").select("id", F.when(F.col("_n") >= min_size, F.col("_least")).alias("cluster"))
