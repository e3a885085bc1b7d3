"""Connected components of an edge table, by alternating star contraction.

Each round hangs every node's larger neighbours on its least neighbour
(large-star), then every node's smaller neighbours likewise (small-star).  The
edge count never grows and the number of rounds is logarithmic, also on chains.
A node's least neighbour comes from an aggregate that combines on the map side.
It goes back to the edges by a join on the node; hubs, of which there are at most
``HUBS`` whatever the graph, take it from a broadcast instead, so the edges of a
hub are never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from caseloom.operators.checkpoints import checkpoint

#: A hub has more than LEAST_DEGREE neighbours and more than its share of 2 * edges / HUBS.
HUBS, LEAST_DEGREE = 50_000, 200
#: Edges of a task, from one task a core on.
TASK_EDGES = 1 << 18


def _star(edges: DataFrame, large: bool, degree: int) -> DataFrame:
    """One contraction; ``edges`` are (u, v) with u > v, each once.  Nodes with more neighbours than ``degree`` are hubs."""
    both = edges.select(F.col("u").alias("n"), F.col("v").alias("m"))
    if large:
        both = both.unionByName(edges.select(F.col("v").alias("n"), F.col("u").alias("m")))
    least = both.groupBy("n").agg(F.min("m").alias("least"), F.count(F.lit(1)).alias("degree")).select(F.col("n").alias("k"), F.least("n", "least").alias("least"), "degree")
    hubs = F.broadcast(least.filter(F.col("degree") > degree).select("k", F.col("least").alias("hub_least")))  # at most HUBS rows
    split = both.join(hubs, F.col("n") == F.col("k"), "left").drop("k")
    dealt = split.filter("hub_least is null").select("n", "m").join(least.filter(F.col("degree") <= degree), F.col("n") == F.col("k"))
    met = dealt.select("n", "m", "least").unionByName(split.filter("hub_least is not null").select("n", "m", F.col("hub_least").alias("least")))
    hung = met.filter("m > n") if large else met
    out = hung.select(F.col("m").alias("u"), F.col("least").alias("v"))
    if not large:
        out = out.unionByName(least.select(F.col("k").alias("u"), F.col("least").alias("v")))
    return out.filter("u > v").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) of every node that an edge names; a component is named by its least node.

    Edges to or from null are ignored; an edge of a node to itself makes it a
    component of its own; no edges give no rows.
    """
    ends = edges.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b")).filter("a is not null and b is not null")
    cores = edges.sparkSession.sparkContext.defaultParallelism
    # Written before all else: the edges may be dear, and are read again for the nodes that have none but their own.
    pairs = checkpoint(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), 2 * cores)
    now = pairs.filter("u > v")
    edge_count = now.count()
    parts = max(cores, edge_count // TASK_EDGES)
    degree = max(LEAST_DEGREE, 2 * edge_count // HUBS)
    mark = None
    while True:
        now = checkpoint(_star(checkpoint(_star(now, True, degree), parts), False, degree), parts)
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == tuple(seen):
            break
        mark = tuple(seen)
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    alone = pairs.filter("u = v").select(F.col("u").alias("node"), F.col("v").alias("component"))
    alone = alone.join(stars.select("node").unionByName(roots.select("node")), "node", "left_anti")
    return stars.unionByName(roots).unionByName(alone)
