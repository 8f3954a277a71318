"""Session logs: JSON lines, one file a session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str, glob: str = "*.jsonl", since: str | None = None) -> DataFrame:
    """file, modified, line_no (from 0) and value of every line below path; since skips files not modified after that time.

    A long file is read in the blocks that Spark cuts it into: lines are numbered in
    their block, and a block begins after the lines of those before it.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("lineSep", "\n")
    if since:
        reader = reader.option("modifiedAfter", since)
    meta = {"file": "file_path", "modified": "file_modification_time", "_block": "file_block_start"}
    lines = reader.text(path).select(*[F.col(f"_metadata.{m}").alias(c) for c, m in meta.items()], F.regexp_replace("value", r"\r$", "").alias("value"), F.monotonically_increasing_id().alias("_at"))
    earlier = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("file", "_block").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy("file", "_block").orderBy("_at")) - 1
    return lines.withColumn("_inside", inside).join(blocks, ["file", "_block"]).select("file", "modified", (F.col("_before") + F.col("_inside")).cast("int").alias("line_no"), "value")


def read_sessions(spark: SparkSession, path: str, **options) -> DataFrame:
    """file, line_no, type, id, parent_id, ts, name and record (variant) of session entries.

    Lines that aren't JSON objects are passed over. A file counts only if its first
    record is a session header.
    """
    lines = read_lines(spark, path, **options)
    parsed = lines.withColumn("record", F.try_parse_json("value")).filter("record IS NOT NULL")
    text = lambda p: F.try_variant_get("record", f"$.{p}", "string")
    rows = parsed.select("file", "modified", "line_no", text("type").alias("type"), text("id").alias("id"), text("parentId").alias("parent_id"), F.try_to_timestamp(text("timestamp")).alias("ts"), text("name").alias("name"), text("cwd").alias("cwd"), text("message.role").alias("role"), "record").filter("type IS NOT NULL")
    first = F.first("type").over(Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("_first", first).filter("_first = 'session'").drop("_first")


def session_list(entries: DataFrame) -> DataFrame:
    """A row for each file: messages, first user message, last activity and latest name (a later clear counts)."""
    user = F.when(F.col("role") == "user", F.col("line_no"))
    return entries.groupBy("file").agg(
        F.count_if(F.col("type") == "message").alias("messages"), F.min_by(F.col("id"), user).alias("first_user_id"), F.max("ts").alias("last_at"),
        F.max_by(F.struct("name"), F.when(F.col("type") == "session_info", F.col("line_no"))).alias("_name"), F.max("cwd").alias("cwd"),
    ).withColumn("name", F.col("_name.name")).drop("_name")


def latest_session(sessions: DataFrame, cwd: str | None = None) -> DataFrame:
    found = sessions if cwd is None else sessions.filter(F.col("cwd") == cwd)
    return found.orderBy(F.desc("last_at"), "file").limit(1)
