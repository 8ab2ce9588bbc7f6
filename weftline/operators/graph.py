"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.lineage import Rounds


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in (a, b): nodes of one component share a root, the smallest of their ids.

    Each round maps every node to its neighbour (or itself) of smallest pseudo-random rank and contracts the edges along
    that map, until none is left: nodes fall by a constant factor in expectation. Each round is written to the shared folder.
    """
    kept = Rounds(edges.sparkSession)
    left = kept.put(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")), "edges0")
    nodes = left.select(F.col("a").alias("node")).union(left.select(F.col("b").alias("node"))).distinct()
    roots = kept.put(nodes.select("node", F.col("node").alias("root")), "roots")
    left = left.where("a <> b")
    k = 0
    while not left.isEmpty():
        k += 1
        both = left.union(left.select("b", "a"))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("rank"), F.col(c).alias("node"))
        to = kept.put(both.groupBy("a").agg(F.min(rank("b")).alias("m")).select("a", F.least(rank("a"), F.col("m"))["node"].alias("to")), "to")
        ta, tb = to.withColumnRenamed("to", "ta"), to.select(F.col("a").alias("b"), F.col("to").alias("tb"))
        moved = left.join(ta, "a").join(tb, "b").where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
        roots = kept.put(roots.join(to.withColumnRenamed("a", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
        left = kept.put(moved.distinct(), "edges")
    least = roots.groupBy("root").agg(F.min("node").alias("least"))
    return roots.join(least, "root").select("node", F.col("least").alias("root"))
