"""Recursive queries over trees and dependency graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimark.operators import graph, sessions
from sedimark.plans.registry import register
from sedimark.plans.tables import load


def _parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part follows the part at half its number: a tree of logarithmic depth."""
    parts = load(spark, sf_dir, "part")
    return parts.filter("p_partkey > 1").select(F.floor(F.col("p_partkey") / 2).alias("src"), F.col("p_partkey").alias("dst"))


_EDGES = "e AS (SELECT p_partkey // 2 AS src, p_partkey AS dst FROM part WHERE p_partkey > 1)"


@register("reach", f"WITH RECURSIVE {_EDGES}, r AS (SELECT 1 AS root, 1 AS node, 0 AS depth UNION ALL SELECT root, dst, depth + 1 FROM r JOIN e ON src = node) SELECT CAST(root AS BIGINT) AS root, CAST(node AS BIGINT) AS node, depth FROM r")
def reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = spark.range(1, 2).select(F.col("id").alias("root"), F.col("id").alias("node"))
    return graph.reach(_parents(spark, sf_dir), start)


@register(
    "shortest_paths",
    f"WITH RECURSIVE {_EDGES}, r AS (SELECT 1 AS node, '1' AS path UNION ALL SELECT dst, path || '>' || dst FROM r JOIN e ON src = node) SELECT CAST(node AS BIGINT) AS node, path FROM r",
)
def shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = spark.range(1, 2).select(F.col("id").alias("root"), F.col("id").alias("node"))
    return graph.shortest_paths(_parents(spark, sf_dir), start).select("node", F.array_join("path", ">").alias("path"))


@register(
    "contracted_tree",
    """WITH n AS (SELECT conv_id AS tree, turn AS id, CASE WHEN turn > 0 THEN turn - 1 END AS parent_id FROM conversations), c AS (SELECT tree, parent_id AS id, count(*) AS n_children FROM n WHERE parent_id IS NOT NULL GROUP BY 1, 2)
       SELECT tree, id, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c USING (tree, id) WHERE parent_id IS NULL OR coalesce(n_children, 0) <> 1""",
)
def contracted_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("tree"), F.col("turn").alias("id"), F.when(F.col("turn") > 0, F.col("turn") - 1).alias("parent_id"))
    return graph.contracted(nodes).select("tree", "id", "n_children")


@register("cycle_nodes")
def cycle_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers on a cycle where a supplier's number leads to those of its parts; the closure is too much for SQL."""
    return graph.on_cycles(load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")))


@register(
    "tree_roots",
    """SELECT conv_id, turn FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 1)""",
)
def tree_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("id"), (F.col("turn") - 1).alias("parent_id"))
    return sessions.roots(turns, ["conv_id"]).select("conv_id", F.col("id").alias("turn"))


@register(
    "cells_in_ranges",
    """SELECT range_id, count(*) AS cells FROM (SELECT p_partkey AS row_index, p_size AS col_index FROM part) JOIN (SELECT s_suppkey AS range_id, s_suppkey * 7 AS a, s_suppkey * 7 + 300 AS b FROM supplier) ON row_index BETWEEN a AND b AND col_index BETWEEN 5 AND 20 GROUP BY 1""",
)
def cells_in_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = load(spark, sf_dir, "part").select(F.lit("s").alias("sheet"), F.col("p_partkey").alias("row_index"), F.col("p_size").alias("col_index"))
    key = F.col("s_suppkey")
    ranges = load(spark, sf_dir, "supplier").select(F.lit("s").alias("sheet"), key.alias("range_id"), (key * 7).alias("row_start"), (key * 7 + 300).alias("row_end"), F.lit(5).alias("col_start"), F.lit(20).alias("col_end"))
    return graph.cells_in_ranges(cells, ranges, ["sheet"]).groupBy("range_id").agg(F.count("*").alias("cells"))
