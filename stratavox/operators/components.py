"""Connected components of an edge table by rounds of contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavox.runtime import settle


def _relabel(edges: DataFrame, parent: DataFrame) -> DataFrame:
    """Edges between the parents of their ends; loops and repeats go."""
    left = edges.join(parent.select(F.col("node").alias("a"), F.col("up").alias("pa")), "a")
    both = left.join(parent.select(F.col("node").alias("b"), F.col("up").alias("pb")), "b")
    return both.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).where("a <> b").distinct()


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b", max_rounds: int = 100) -> DataFrame:
    """One row (node, root) for each node that an edge touches; root is the component's smallest node.

    Every round hooks each node to the neighbour, or itself, whose hash of the round is smallest, jumps one pointer
    and contracts the edges. Hashes rather than numbers decide, so chains of consecutive numbers, which hooking to
    the smaller number would only shift along themselves, shrink by a constant factor too, and the rounds are logarithmic.
    The choice is combined on the map side, hence a hub of any degree is cheap; relabelling is a plain shuffle
    join that AQE can split. Rows with a null end are ignored; loops give no row.
    """
    e = settle(
        edges.select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b"))
        .where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col("a") != F.col("b")))
        .distinct(),
        "edges",
    )
    label: DataFrame | None = None
    for turn in range(max_rounds):
        if e.isEmpty():
            break
        order = lambda c, turn=turn: F.xxhash64(c, F.lit(turn))
        ends = e.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(e.select(F.col("b").alias("node"), F.col("a").alias("to")))
        best = ends.groupBy("node").agg(F.min_by("to", order("to")).alias("to"))
        hook = settle(best.select("node", F.when(order("to") < order("node"), F.col("to")).otherwise(F.col("node")).alias("up")), "hook")
        jump = hook.join(hook.select(F.col("node").alias("up"), F.col("up").alias("top")), "up", "left")
        hook = settle(jump.select("node", F.coalesce("top", "up").alias("up")), "jump")
        e = settle(_relabel(e, hook), "edges")
        if label is None:
            label = hook
        else:  # a node whose parent lost every edge in a round keeps it
            nxt = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
            label = label.join(nxt, "up", "left").select("node", F.coalesce("top", "up").alias("up"))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if label is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root")).where("false")
    label = settle(label, "labels")
    least = settle(label.groupBy("up").agg(F.min("node").alias("root")), "least")
    return label.join(least, "up").select("node", "root")
