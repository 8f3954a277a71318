"""Dependency graphs: reach, depth, paths, cycles and contraction, by frontier joins."""

from __future__ import annotations

import re
import tempfile
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _cut(df: DataFrame, level: int = 0, every: int = 4) -> DataFrame:
    """Lineage ends every few levels, in the session's checkpoint folder; one machine may do with a temporary one."""
    if level % every:
        return df
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


def _levels(max_depth: int | None):
    return count(1) if max_depth is None else range(1, max_depth + 1)


def _outgoing(edges: DataFrame) -> DataFrame:
    """Edges (src, dst) written once, where they lie by their src, and never copied to the driver for a join: a walk reads them each level."""
    return _cut(edges.select("src", "dst").filter("src IS NOT NULL").repartition("src")).hint("merge")


def _new(found: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of found whose root and node aren't known; nulls are equal, so that a null root ends too."""
    seen = known.select(F.col("root").alias("_root"), F.col("node").alias("_node")).hint("merge")
    return found.join(seen, F.col("root").eqNullSafe(F.col("_root")) & F.col("node").eqNullSafe(F.col("_node")), "left_anti")


def reach(edges: DataFrame, start: DataFrame, max_depth: int | None = None) -> DataFrame:
    """root, node and depth of everything that edges (src, dst) lead to from start (root, node).

    depth is the least number of edges. Each level joins the nodes found last with
    the edges and leaves out what is known, so a node is expanded once for a root.
    It ends when a level finds nothing, or after max_depth levels if the caller sets it.
    """
    edges = _outgoing(edges)
    known = frontier = _cut(start.select("root", "node").distinct().withColumn("depth", F.lit(0)))
    for depth in _levels(max_depth):
        found = frontier.select("root", F.col("node").alias("src")).join(edges, "src").select("root", F.col("dst").alias("node")).distinct()
        frontier = _cut(_new(found, known).withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        known = _cut(known.unionByName(frontier), depth)
    return known


def _stripped(core: DataFrame) -> DataFrame:
    """Edges between nodes that have a way in and a way out, again and again."""
    size = core.count()
    while True:
        left = core.join(core.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        core = _cut(left.join(core.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst"))
        if (now := core.count()) == size:
            return core
        size = now


def on_cycles(edges: DataFrame) -> DataFrame:
    """Nodes that lead back to themselves, over any number of edges (src, dst). Edges with a null end don't matter.

    A node with an edge to itself is one. The rest follows from the strongly
    connected components: every node takes the largest id among those that lead to
    it as its colour, and those that lead back to the node of their colour without
    leaving the colour are its component. Components go, and what is left is taken
    again. No round has more rows than there are edges; pairs of nodes aren't made.
    """
    core = _cut(edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct())
    found = core.filter("src = dst").select(F.col("src").alias("node"))
    core = _stripped(core.filter("src <> dst"))
    while not core.isEmpty():
        colours = core.select(F.col("src").alias("node"), F.col("src").alias("colour")).distinct()
        while True:
            handed = core.join(colours.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "colour")
            after = _cut(colours.select("node", "colour", F.col("colour").alias("old")).unionByName(handed.withColumn("old", F.lit(None)))
                         .groupBy("node").agg(F.max("colour").alias("colour"), F.max("old").alias("old")))
            colours = after.select("node", "colour")
            if after.filter("colour <> old").isEmpty():
                break
        inside = core.join(colours.select(F.col("node").alias("src"), "colour"), "src").join(colours.select(F.col("node").alias("dst"), F.col("colour").alias("other")), "dst").filter("colour = other")
        inside = _cut(inside.select("src", "dst", "colour"))
        members = frontier = colours.filter("node = colour").select("node")
        while True:
            back = inside.join(frontier.withColumnRenamed("node", "dst"), "dst", "left_semi").select(F.col("src").alias("node")).distinct()
            frontier = _cut(back.join(members, "node", "left_anti"))
            if frontier.isEmpty():
                break
            members = _cut(members.unionByName(frontier))
        sizes = colours.join(members, "node", "left_semi").groupBy("colour").agg(F.count("*").alias("n")).filter("n > 1").select("colour")
        found = _cut(found.unionByName(colours.join(members, "node", "left_semi").join(sizes, "colour", "left_semi").select("node")).distinct())
        gone = members
        core = core.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
        core = _stripped(_cut(core.select("src", "dst")))
    return found.distinct()


def shortest_paths(edges: DataFrame, start: DataFrame, max_depth: int | None = None) -> DataFrame:
    """root, node and path: the nodes of a shortest way, the smallest where there are several.

    max_depth, if the caller sets it, is the most edges of a way.
    """
    edges = _outgoing(edges)
    known = frontier = _cut(start.select("root", "node", F.array(F.col("node")).alias("path")))
    for depth in _levels(max_depth):
        step = frontier.withColumnRenamed("node", "src").join(edges, "src").select("root", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        best = step.groupBy("root", "node").agg(F.min("path").alias("path"))
        frontier = _cut(_new(best, known))
        if frontier.isEmpty():
            break
        known = _cut(known.unionByName(frontier), depth)
    return known


def contracted(nodes: DataFrame) -> DataFrame:
    """Nodes to show of trees (tree, id, parent_id): roots, branch points and leaves, with n_children."""
    counts = nodes.groupBy("tree", F.col("parent_id").alias("id")).agg(F.count("*").alias("n_children"))
    joined = nodes.join(counts, ["tree", "id"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    return joined.filter("parent_id IS NULL OR n_children <> 1")


def cells_in_ranges(cells: DataFrame, ranges: DataFrame, keys: list[str], tile: int = 256) -> DataFrame:
    """Cells inside rectangles of the same sheet: an equal join on row tiles, then the exact bounds.

    ranges has range_id, row_start, row_end, col_start and col_end. A range is
    repeated for each tile of rows that it meets.
    """
    tiled = ranges.withColumn("_tile", F.explode(F.sequence(F.floor(F.col("row_start") / tile), F.floor(F.col("row_end") / tile))))
    placed = cells.withColumn("_tile", F.floor(F.col("row_index") / tile))
    inside = F.col("row_index").between(F.col("row_start"), F.col("row_end")) & F.col("col_index").between(F.col("col_start"), F.col("col_end"))
    return placed.join(tiled, [*keys, "_tile"]).filter(inside).drop("_tile")
