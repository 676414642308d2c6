"""Greedy choices in a fixed order, made in rounds on tables instead of one after the other in one task.

A round settles whatever no open choice can change any more, everywhere at once; what is
left goes on. The result is that of the sequential choice. Rounds grow with the longest
chain of choices that hang on one another, not with the rows; each is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import written


def greedy_matching(edges: DataFrame) -> DataFrame:
    """(drawing_id, a, b): the edges that stay if they are taken in the order of ``rank``, each whose two ends are both free.

    ``edges`` has drawing_id, a, b and rank, a struct that is unique in its drawing. An edge
    that comes first among the open edges at both of its ends is taken: nothing before it
    can use its ends.
    """
    left, out = written(edges.select("drawing_id", "a", "b", "rank"), "open-edges"), None
    while left.limit(1).count():
        ends = left.select("drawing_id", F.explode(F.array("a", "b")).alias("node"), F.struct("rank", "a", "b").alias("edge"))
        first = ends.groupBy("drawing_id", "node").agg(F.min("edge").alias("edge"))
        both = first.groupBy("drawing_id", "edge").agg(F.count("*").alias("n")).filter("n = 2")
        taken = written(both.select("drawing_id", "edge.a", "edge.b"), "taken-edges")
        out = taken if out is None else out.union(taken)
        used = taken.select("drawing_id", F.explode(F.array("a", "b")).alias("node"))
        for end in ("a", "b"):
            left = left.join(used.withColumnRenamed("node", end), ["drawing_id", end], "left_anti")
        left = written(left, "open-edges")
    return out if out is not None else edges.select("drawing_id", "a", "b").limit(0)


def dropped_by_earlier(edges: DataFrame) -> DataFrame:
    """(drawing_id, node): the nodes that go if each goes that has an earlier neighbour which stays.

    ``edges`` has drawing_id, earlier and later. A node without an open earlier neighbour
    stays, so all later ones around it go, and with them their own edges.
    """
    left, out = written(edges.select("drawing_id", "earlier", "later").distinct(), "open-edges"), None
    while left.limit(1).count():
        behind = left.select("drawing_id", F.col("later").alias("earlier")).distinct()
        stays = left.join(behind, ["drawing_id", "earlier"], "left_anti")
        gone = written(stays.select("drawing_id", F.col("later").alias("node")).distinct(), "gone-nodes")
        out = gone if out is None else out.union(gone)
        for end in ("earlier", "later"):
            left = left.join(gone.withColumnRenamed("node", end), ["drawing_id", end], "left_anti")
        left = written(left, "open-edges")
    return out if out is not None else edges.select("drawing_id", F.col("later").alias("node")).limit(0)
