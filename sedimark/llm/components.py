"""Connected components by alternating large-star and small-star rounds.

After a round every edge leads from a larger to a smaller id; rounds go on until
the edges no longer change and each component is a star around its smallest id.
Each round is joins and aggregations on the edges alone, written to the shared
folder, so lineage stays short and nothing but a count and a checksum reaches
the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.llm._common import discard, stored


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"]


def connected_components(edges: DataFrame, folder: str, name: str = "star") -> DataFrame:
    """node and component (the smallest id) of each node that isn't its component's smallest.

    edges has long columns a and b; loops and repeated edges don't matter.
    """
    spark = edges.sparkSession
    oriented = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current = stored(oriented, folder, f"{name}-0")
    state, n = _state(current), 0
    while state[0]:
        n += 1
        # The smallest neighbour below each node. It is written so that the join has a shuffle on
        # either side, which adaptive execution can split where a node has very many neighbours.
        lower = stored(current.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m")), folder, f"{name}-{n}-lower")
        large = current.join(lower, "b", "left").select("a", F.coalesce("m", "b").alias("b")).distinct()
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        turned = large.join(root, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        following = stored(turned.unionByName(root.select("a", F.col("m").alias("b"))).distinct(), folder, f"{name}-{n}")
        new_state = _state(following)
        for old in (f"{name}-{n - 1}", f"{name}-{n}-lower"):
            discard(spark, f"{folder}/{old}")
        current = following
        if new_state == state:
            break
        state = new_state
    return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
