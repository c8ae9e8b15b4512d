"""Connected components of an edge table by contraction.

Every node points to the least among itself and its neighbours; pointers are jumped over until they end at nodes that
point to themselves, and edges are carried to those. What is left is a far smaller graph of the same components, which
is contracted in turn, and the levels' pointers are put together at the end. So a level moves the edges twice, jumps
move nodes only, and a chain of ordered ids is one level. Neighbours are aggregated before they move, so a node with
very many isn't one task's work. Joins are merge joins: no level goes through the driver. Each table is written to the shared folder, which cuts lineage and survives lost
executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def roots(labels: DataFrame, keep: Callable[[DataFrame, int], DataFrame], max_rounds: int) -> DataFrame:
    """(v, l) with every pointer at its end."""
    for k in range(1, max_rounds + 1):
        up = labels.select(F.col("v").alias("l"), F.col("l").alias("up"))
        jumped = keep(labels.join(up.hint("merge"), "l").select("v", F.col("l").alias("old"), F.col("up").alias("l")), k)
        labels = jumped.select("v", "l")
        if not jumped.where("l <> old").limit(1).count():
            return labels
    raise RuntimeError(f"pointers did not end in {max_rounds} rounds")


def connected_components(edges: DataFrame, keep: Callable[[DataFrame, int], DataFrame], src: str = "src", dst: str = "dst", max_rounds: int = 50, kept: bool = False) -> DataFrame:
    """(node, component) of every node in ``edges``; the component is the smallest node in it.

    ``keep(df, round)`` stores a table and returns it read again; with ``kept``, ``edges`` is such a table already. Null
    ends and self-loops link nothing.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    e = e if kept else keep(e, -1)
    levels = []
    for _ in range(max_rounds):
        ends = e.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")))).alias("x")).select("x.v", "x.w")
        at = roots(keep(ends.groupBy("v").agg(F.least(F.col("v"), F.min("w")).alias("l")), 0), keep, max_rounds)
        levels.append(at)
        one, other = at.select(F.col("v").alias("a"), F.col("l").alias("x")), at.select(F.col("v").alias("b"), F.col("l").alias("y"))
        e = keep(e.join(one.hint("merge"), "a").join(other.hint("merge"), "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), 0)
        if not e.limit(1).count():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    out = levels.pop()
    while levels:
        up = out.select(F.col("v").alias("l"), F.col("l").alias("up"))
        out = levels.pop().join(up, "l", "left").select("v", F.coalesce("up", "l").alias("l"))
    return out.select(F.col("v").alias("node"), F.col("l").alias("component"))
