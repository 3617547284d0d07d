"""Connected components by hooking and pointer jumping; nothing of the graph reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuplemill.llm.storage import settle


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for each end of the edges ``a``, ``b``; ``comp`` is one of the component's nodes.

    Each round, every node with a smaller neighbour hooks to its smallest one, chains of hooks are
    halved until they are stars, and edges are drawn anew between the stars' roots. Groups are only
    ever reduced by ``min``, so a node with very many edges is combined on the map side.
    """
    edges = settle(_ordered(edges), "edges")
    labels = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("comp", F.col("node"))
    while not edges.isEmpty():
        hooks = settle(edges.groupBy("a").agg(F.min("b").alias("root")), "hooks")
        while True:
            next_ = hooks.select(F.col("a").alias("root"), F.col("root").alias("up"))
            hooks = settle(hooks.join(next_, "root", "left").select("a", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), "hooks")
            if hooks.filter("moved").isEmpty():
                break
            hooks = hooks.select("a", "root")
        comp = hooks.select(F.col("a").alias("comp"), "root")
        labels = settle(labels.join(comp, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")), "labels")
        for end in ("a", "b"):
            at = hooks.select(F.col("a").alias(end), "root")
            edges = edges.join(at, end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
        edges = settle(_ordered(edges.select("a", "b")), "edges")
    return labels
