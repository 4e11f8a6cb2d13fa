"""Connected components of an edge table, by large and small stars.

Each round links every node to the smallest node around it; the number of rounds
grows with the logarithm of the longest path.  Minima are aggregated before they
are shuffled, and the joins that bring them back are split where a node has very
many edges, so a hub is nobody's single task.  Every round is written to the
shared folder, which cuts the lineage.
"""

from pyspark.sql import functions as F

from ..session import write_shared

MAX_ROUNDS = 60


def _state(edges):
    row = edges.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    ).first()
    return tuple(row)


def connected_components(edges, a="a", b="b"):
    """``(node, component)`` for each node of an edge that is not its own component.

    The component is the smallest node that can be reached.  Loops, repeated edges
    and edges with a null end are ignored; no edges give no rows.
    """
    stars = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.col(a).alias("_a"), F.col(b).alias("_b"))
    stars = stars.where("_a is not null and _b is not null and a < b").select("a", "b").distinct()
    stars = write_shared(stars, "edges")
    before = _state(stars)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        both = stars.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            stars.select(F.col("b"), F.col("a"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))
        large = (
            both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        ).distinct()
        smallest = large.groupBy("b").agg(F.min("a").alias("m"))
        small = (
            large.join(smallest, "b")
            .where("a <> m")
            .select(F.col("m").alias("a"), F.col("a").alias("b"))
            .union(smallest.select(F.col("m").alias("a"), "b"))
            .distinct()
        )
        stars = write_shared(small, "stars")
        after = _state(stars)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return stars.select(F.col("b").alias("node"), F.col("a").alias("component"))
