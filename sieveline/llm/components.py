"""Connected components of an edge table, by contraction in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) for each node of `edges` (src, dst: long); nodes of one component share a label.

    Every round points each node to the least of itself and its neighbours in an order that is
    drawn anew, then replaces both ends of each edge by what they point to. A constant share of
    the nodes goes in each round, also on chains, so the rounds grow with the logarithm of the
    largest component. Neighbours meet in a `min` that is combined before the shuffle, so a hub
    costs no more than other nodes. Each round's tables are written to the shared folder.
    Loops, repeated and reversed edges are allowed; an empty table gives an empty table.
    """
    pair = [F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")]
    edges, path = scratch.write(edges.where("src <> dst").select(*pair).distinct(), "edges")
    labels = label_path = None
    turn = 0
    while True:
        both = edges.select("src", "dst").union(edges.select("dst", "src"))
        order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("o"), F.col(c).alias("n"))  # noqa: E731, B023
        points = both.groupBy("src").agg(F.min(order("dst")).alias("least"))
        points = points.select(
            F.col("src").alias("node"), F.least(order("src"), "least")["n"].alias("label")
        )
        points, points_path = scratch.write(points, "points")
        if labels is None:
            labels, label_path = points, points_path
        else:
            step = points.select(F.col("node").alias("label"), F.col("label").alias("next"))
            moved = labels.join(step, "label", "left").select(
                "node", F.coalesce("next", "label").alias("label")
            )
            old = label_path
            labels, label_path = scratch.write(moved, "labels")
            scratch.drop(old)
        src = points.select(F.col("node").alias("src"), F.col("label").alias("a"))
        dst = points.select(F.col("node").alias("dst"), F.col("label").alias("b"))
        left = (
            edges.join(src, "src").join(dst, "dst").where("a <> b")
            .select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
            .distinct()
        )
        old, old_points = path, points_path
        edges, path = scratch.write(left, "edges")
        scratch.drop(old)
        if old_points != label_path:
            scratch.drop(old_points)
        turn += 1
        if edges.isEmpty():
            scratch.drop(path)
            return labels
