"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest node it is connected to.

    Each round writes its edges to the shared folder, so lineage stays short; the number of rounds
    grows with the logarithm of the longest chain. Raises RuntimeError if it does not settle.
    """
    edges = storage.materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    before = None
    for _ in range(most_rounds):
        # large star: every larger neighbour is tied to the smallest of a node and its neighbours
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # there are never more of these than edges, so repeated ones may stay until the end of the round
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        # small star: smaller neighbours and the node itself are tied to the smallest of them
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(small, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = storage.materialize(tied.union(small.select("a", F.col("m").alias("b"))).distinct(), "links")
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (state.n, state.h) == before:
            break
        before = (state.n, state.h)
    else:
        raise RuntimeError("the components did not settle")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
