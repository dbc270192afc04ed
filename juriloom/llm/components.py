"""Connected components of an edge table, without collecting it."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Temporary, written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of the edges (a, b); the component is its smallest node.

    Each round sends every node to the first of itself and its neighbours in a fixed random order, and goes on with the
    edges between what is left, so edges shrink quickly. A round is written to the shared folder. Self-loops, repeated
    and reversed edges are allowed.
    """
    left = written(_between(edges), "edges")
    roots = written(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")), "roots")
    while not left.isEmpty():
        keyed = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
        both = left.select(F.col("a").alias("node"), keyed("b").alias("other")).union(left.select(F.col("b"), keyed("a")))
        to = written(both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("other", keyed("node"))["id"].alias("to")), "hooks")
        moved = left.join(to.withColumnsRenamed({"node": "a", "to": "ta"}), "a").join(to.withColumnsRenamed({"node": "b", "to": "tb"}), "b")
        left = written(_between(moved.select(F.col("ta").alias("a"), F.col("tb").alias("b"))), "edges")
        roots = written(roots.join(to.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
    return roots.join(roots.groupBy("root").agg(F.min("node").alias("component")), "root").select("node", "component")


def _between(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (node, component) of all nodes after new links (a, b) between them."""
    with Temporary(labels.sparkSession) as temporary:
        out = _joined(labels, links)
        temporary.keep(out)
    return out


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    own = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    merged = connected_components(links.join(own("a"), "a").join(own("b"), "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    lower = merged.select(F.col("node").alias("component"), F.col("component").alias("lower"))
    return written(labels.join(lower, "component", "left").select("node", F.coalesce("lower", "component").alias("component")), "labels")
