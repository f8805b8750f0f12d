"""Connected components by alternating large-star and small-star rounds.

Both stars group by node, take the minimum neighbour (combined map-side) and
join it back to the edges. The minima are written first, so that both join
inputs are plain exchanges whose skewed partitions adaptive execution can split:
a hub that holds a third of all edges does not land in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.plans.tables import discard, materialize


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100, rows: int | None = None) -> DataFrame:
    """``(node, component)`` for every node of ``edges``; component = its smallest node.

    Edges are undirected and may repeat; self-loops give a component of one node.
    Rows with a null endpoint are ignored. An empty input gives an empty result.
    ``rows`` is about how many edges there are at most, where that is known.
    """
    both = edges.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b")).where("a is not null and b is not null")
    nodes = materialize(both.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc-input", rows)
    now = nodes.where("u <> v")
    seen, old = _digest(now), None
    for _ in range(max_rounds):
        if not seen[0]:
            break
        size = 2 * seen[0]  # no table of a round has more rows
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "cc-min", size)
        large = materialize(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc-large", size)
        low2 = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "cc-min", size)
        # a node points at its minimum, and so do its other smaller neighbours
        moved = large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = materialize(low2.select("u", F.col("m").alias("v")).union(moved).distinct(), "cc-edges", size)
        discard(low, large, low2)
        if old is not None:
            discard(old)
        now, old, before = new, new, seen
        seen = _digest(now)
        if seen == before:
            break
    else:
        raise RuntimeError("connected components did not settle")
    roots = now.select(F.col("v").alias("node")).union(nodes.where("u = v").select("u")).distinct()
    roots = roots.join(now.select(F.col("u").alias("node")), "node", "left_anti")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
