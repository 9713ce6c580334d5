"""Connected components of an edge list, by alternating star contractions.

Each round points every node at the smallest node it knows of (large star: the larger neighbours; small star: the
smaller ones and itself), so that the edges become stars round the smallest node in O(log n) rounds. Only edges are
moved, never components, and each round is written to the shared folder (and the one before it deleted), so that a lost
executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from engramlake.session import release, stage


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge between two different nodes; component is the smallest node reached.

    Null ends and self loops are ignored; repeated edges count once; without edges the result is empty.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = stage(e, "components")
    for _ in range(max_rounds):
        # Large star: every neighbour above a node goes to the least of the node and its neighbours. A node without lower
        # neighbours keeps its edges, so the side that is joined lacks the centres, which are the nodes of most edges.
        low = e.union(e.select("v", "u")).groupBy("u").agg(F.min("v").alias("m")).where("m < u")
        large = e.join(low.withColumnRenamed("u", "v"), "v", "left").select("u", F.coalesce("m", "v").alias("v"))
        # Small star: a node and its lower neighbours go to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = stage(small.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "components")
        release(e)
        e = new
        if _is_star(e):
            break
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())


def _is_star(e: DataFrame) -> bool:
    """Whether each point has one centre, and no node is both."""
    ends = e.select(F.col("u").alias("n"), F.lit(1).alias("points"), F.lit(0).alias("centres")).union(e.select("v", F.lit(0), F.lit(1)))
    both = ends.groupBy("n").agg(F.sum("points").alias("points"), F.max("centres").alias("centres"))
    return not both.where("points > 1 or points = 1 and centres = 1").limit(1).count()
