"""Connected components of a table of links, in rounds of joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.session import materialize


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """One half round: each node's neighbours move to the least of them.

    ``large``: of all neighbours, those above the node move. Otherwise the node and those below it move.
    """
    if large:
        near = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a"))
    else:
        near = links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other"))
    least = near.groupBy("node").agg(F.min("other").alias("least"))
    least = least.select("node", F.least("least", "node").alias("least"))
    moved = near.join(least, "node")
    if large:
        moved = moved.where(F.col("other") > F.col("node")).select(F.col("other").alias("a"), F.col("least").alias("b"))
        # A node without a lower neighbour keeps its own links; they point to itself.
    else:
        moved = moved.where(F.col("other") != F.col("least")).select(F.col("other").alias("a"), F.col("least").alias("b"))
        moved = moved.union(least.select("node", "least"))
    return moved.where("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root: for every node of the undirected links (a, b) the least node that it reaches.

    Large-star and small-star rounds alternate until nothing moves, a number of rounds that grows
    with the logarithm of the nodes. Each round is written to the shared folder, so that a lost
    executor repeats one round at most. A hub's neighbours are never gathered: its least neighbour
    comes from a partial aggregate, and the join back splits large keys at run time.
    """
    links = materialize(links.select("a", "b").where("a != b").distinct())
    mark = None
    while True:
        moved = materialize(_stars(_stars(links, True), False))
        row = moved.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("digest")
        ).first()
        links = moved
        if (row.n, row.digest) == mark:
            break
        mark = row.n, row.digest
    flat = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return flat.union(links.select("b", "b")).distinct()
