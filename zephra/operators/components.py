"""Connected components by alternating star operations (large star, small star).

Each round is two grouped minima and two joins on a written edge table; the number of rounds grows with the logarithm of
the graph. Both operations keep connectivity, so the loop ends once the edges are disjoint stars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zephra.scale import ROWS_PER_TASK, cut_lineage


def _large_star(edges: DataFrame, many: bool) -> DataFrame:
    """Every node links its larger neighbours to the smallest of its neighbourhood. ``many`` nodes are not broadcast."""
    both = edges.unionByName(edges.select("run", F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("run", "u").agg(F.min("v").alias("m")).select("run", "u", F.least("u", "m").alias("m"))
    return both.filter(F.col("v") > F.col("u")).join(least.hint("merge") if many else least, ["run", "u"]).select(
        "run", F.col("v").alias("u"), F.col("m").alias("v")
    )


def _small_star(edges: DataFrame, many: bool) -> DataFrame:
    """Every node links its smaller neighbours, and itself, to the smallest of them."""
    down = edges.select("run", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("run", "u").agg(F.min("v").alias("m"))
    moved = down.join(least.hint("merge") if many else least, ["run", "u"]).select("run", F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("run", "u", F.col("m").alias("v"))).filter(F.col("u") != F.col("v")).distinct()


def _are_stars(edges: DataFrame) -> tuple[bool, int]:
    """Whether no node has two parents, or is a parent and a child; and the number of nodes."""
    child = edges.select("run", F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    parent = edges.select("run", F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    ends = child.unionByName(parent).groupBy("run", "node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    bad = (F.col("up") > 1) | ((F.col("up") == 1) & (F.col("down") == 1))
    found = ends.agg(F.count_if(bad).alias("bad"), F.count(F.lit(1)).alias("nodes")).first()
    return found["bad"] == 0, found["nodes"]


def components(edges: DataFrame) -> DataFrame:
    """(run, u, label) for every node with an edge: the smallest node of its component."""
    now = cut_lineage(
        edges.filter(F.col("u") != F.col("v"))
        .select("run", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    stars, n = _are_stars(now)
    while not stars:
        # Catalyst takes the minima of all nodes to be as small as the compressed files of the edges.
        many = n > ROWS_PER_TASK
        now = cut_lineage(_small_star(_large_star(now, many), many))
        stars, n = _are_stars(now)
    roots = now.select("run", F.col("v").alias("u"), F.col("v").alias("label")).distinct()
    return now.select("run", "u", F.col("v").alias("label")).unionByName(roots)
