"""Connected components of a written edge table, by alternating star contraction.

Each round replaces edges by edges to smaller nodes, first for larger then for smaller neighbours, with
joins and partial minima only: no node's neighbours are ever gathered in one place. Rounds grow with
the logarithm of the longest path; every round's edges go to the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import written
from millrace.session import shared_folder

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a long, b long): root is the component's smallest node.

    Loops, repeated edges and null ends don't matter; without edges the result is empty.
    """
    shared_folder(edges.sparkSession)
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(edges, "edges")
    before = _mark(edges)
    for _ in range(MAX_ROUNDS):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        # large star: every larger neighbour of u goes to u's least neighbour (or u itself)
        large = edges.join(least, edges["b"] == least["u"]).select("a", F.col("m").alias("b")).where("a <> b").distinct()
        # small star: u and its smaller neighbours go to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        pairs = large.join(low, large["a"] == low["u"])
        small = pairs.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        edges = small.checkpoint()
        after = _mark(edges)
        if after == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = after
    raise RuntimeError("components did not settle")


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
