"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Staged


def connect(edges: DataFrame, staged: Staged) -> DataFrame:
    """(node, root) for every node that occurs in ``edges`` (a long, b long); nodes of one component share a root.

    Each round maps every node to the neighbour (or itself) of smallest pseudo-random rank and contracts the edges along
    that map, until none is left. As ranks are drawn anew each round, the nodes fall by a constant factor in
    expectation, so the rounds grow with the logarithm of the input. Tables between rounds are written to the shared
    folder. A node with very many edges is pre-aggregated before the shuffle; joins on it are ordinary sort-merge joins
    that Spark can split. Self-loops are allowed. An empty edge table gives no rows.
    """
    now = staged.put(edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL"), "edges0")
    nodes = now.select(F.col("a").alias("node")).union(now.select(F.col("b").alias("node"))).distinct()
    roots = staged.put(nodes.select("node", F.col("node").alias("root")), "roots0")
    left = now.where("a <> b")
    k = 0
    while not left.isEmpty():
        k += 1
        both = left.select("a", "b").union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("rank"), F.col(c).alias("node"))
        to = staged.put(both.groupBy("a").agg(F.min(rank("b")).alias("m")).select("a", F.least(rank("a"), F.col("m"))["node"].alias("to")), f"to{k}")
        ta, tb = to.withColumnRenamed("to", "ta"), to.select(F.col("a").alias("b"), F.col("to").alias("tb"))
        moved = left.join(ta, "a").join(tb, "b").where("ta <> tb")
        shrunk = staged.put(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), f"edges{k}")
        step = to.select(F.col("a").alias("root"), "to")
        roots = staged.put(roots.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root")), f"roots{k}")
        staged.drop(f"edges{k - 1}", f"roots{k - 1}", f"to{k}")
        left = shrunk
    return roots
