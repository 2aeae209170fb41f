"""Connected components of graphs, such as those of anomaly types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telescribe.operators.scratch import checkpointed, discard

#: Edges of one node that a join leaves to one task, and the most nodes that are sent to every task instead.
HUB, MOST_SENT = 4096, 500_000


def _met(rows: DataFrame, lows: DataFrame, total: int) -> DataFrame:
    """rows (a, b) with the low of a. lows: (a, low, n) once a node, n its rows; total: of all rows.

    Rows of nodes with many stay where they lie, and those nodes' one row is sent to them: no more than MOST_SENT, as so
    many rows cannot make more nodes so large. Only the others are dealt out by node.
    """
    most = max(HUB, total // MOST_SENT)
    hubs, rest = lows.where(F.col("n") > most).drop("n"), lows.where(F.col("n") <= most).drop("n")
    few = rows.join(F.broadcast(hubs.select("a")), "a", "left_anti")
    return rows.join(F.broadcast(hubs), "a").unionByName(few.join(rest, "a"))


def components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, component): every node with the smallest node it reaches over edges (a, b), itself included.

    A round contracts stars twice: each node's larger neighbours are pointed at the smallest of all, then each node's
    smaller neighbours and itself at the smallest of those, until every edge points at a root. Rounds grow with the
    logarithm of the largest component. Ends of edges that are no nodes take part but do not come out.
    """
    both = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    now = checkpointed(edges.select(*both).where("a <> b").distinct())
    total = now.count()
    for _ in range(most_rounds):
        # done once no root points at anything and every other node at one root
        up = now.groupBy("a").agg(F.count("*").alias("n"))
        open_ = up.where("n > 1").limit(1).count() or now.join(now.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count()
        if not open_:
            found = nodes.select("node").distinct().join(now.select(F.col("a").alias("node"), F.col("b").alias("low")), "node", "left")
            out = checkpointed(found.select("node", F.coalesce("low", "node").alias("component")))
            discard(now)
            return out
        each = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = each.groupBy("a").agg(F.least("a", F.min("b")).alias("low"), F.count("*").alias("n"))
        large = checkpointed(_met(each.where("b > a"), low, 2 * total).select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n"))
        small = _met(large, low, 2 * total).select(F.col("b").alias("a"), F.col("low").alias("b"))
        small = small.unionByName(low.select("a", F.col("low").alias("b")))
        after = checkpointed(small.where("a <> b").distinct())
        discard(now, large)
        now = after
    raise RuntimeError(f"components have not settled in {most_rounds} rounds")
