"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.session import cut_lineage

JUMPS = 3


def components(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(node, root): one node of its component for each node of rows (a, b).

    A round hangs the larger of two linked roots below the smallest it is linked with, then shortens
    the pointers, ``JUMPS`` at a time. Every round is written down, and rounds go on until no edge
    joins two roots. ``known`` is the result for earlier edges: those are not looked at again, only
    its roots are. A hot node costs nothing more: minima combine before the shuffle, and joins on it
    split.
    """
    links = edges.where(F.col("a") != F.col("b")).select("a", "b")
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    fresh = ends.withColumn("root", F.col("node"))
    if known is not None:
        fresh = known.unionByName(fresh.join(known, "node", "left_anti"))
    state = cut_lineage(fresh)
    while True:
        left = state.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = state.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        joined = links.join(left, "a").join(right, "b").where(F.col("ra") != F.col("rb"))
        links = cut_lineage(joined.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        if links.isEmpty():
            return state
        low = links.groupBy("b").agg(F.min("a").alias("to"))
        while True:  # shorten the chains of roots
            for _ in range(JUMPS):
                further = low.select(F.col("b").alias("to"), F.col("to").alias("further"))
                low = low.join(further, "to", "left").select("b", F.coalesce("further", "to").alias("to"))
            low = cut_lineage(low)
            if low.join(low.select(F.col("b").alias("to")), "to", "left_semi").isEmpty():
                break
        state = cut_lineage(state.join(low.withColumnRenamed("b", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root")))
