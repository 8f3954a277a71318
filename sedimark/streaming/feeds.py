"""Incremental feeds by Structured Streaming: deduplication, running totals, outbox."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sedimark.functions.numbers import backoff_ms


def read_stream(spark: SparkSession, path: str, schema, time: str | None = None) -> DataFrame:
    """A Parquet folder as a stream; time is read as UTC, as watermarks need a zoned timestamp."""
    stream = spark.readStream.schema(schema).parquet(path)
    return stream.withColumn(time, F.col(time).cast("timestamp")) if time else stream


def deduplicated(stream: DataFrame, keys: list[str], time: str, overlap: str = "2 days") -> DataFrame:
    """The first of rows with the same keys within overlap; polls that overlap deliver nothing twice."""
    return stream.withWatermark(time, overlap).dropDuplicatesWithinWatermark(keys)


def windowed_totals(stream: DataFrame, time: str, every: str, late: str, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """Counts and sums of each window and key, final once late has passed."""
    return stream.withWatermark(time, late).groupBy(F.window(time, every), *keys).agg(F.count("*").alias("n"), *[F.sum(c).alias(n) for n, c in sums.items()])


def running_totals(stream: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """Totals of each key so far; written in update mode."""
    return stream.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(c).alias(n) for n, c in sums.items()])


def drained(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run what is there now through sink and stop; the checkpoint remembers what was taken."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()
    return query


def parquet_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A batch goes to a folder of its number, so a batch that comes again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def delivered(outbox: DataFrame, results: DataFrame, now_ms: int) -> DataFrame:
    """The outbox after an attempt: sent, or waiting longer by the number of failures.

    outbox has id, status, attempts and next_attempt_at; results has id and ok.
    """
    joined = outbox.join(results.select("id", "ok"), "id", "left")
    tries = F.when(F.col("ok").isNull(), F.col("attempts")).otherwise(F.col("attempts") + 1)
    return joined.select(
        "id", F.when(F.col("ok"), "delivered").otherwise(F.col("status")).alias("status"), tries.alias("attempts"),
        F.when(F.col("ok").isNull() | F.col("ok"), F.col("next_attempt_at")).otherwise(F.lit(now_ms) + backoff_ms(tries)).alias("next_attempt_at"),
    )


def due(outbox: DataFrame, now_ms: int, limit: int = 100) -> DataFrame:
    """What is to be delivered now, oldest first; the limit is a round's."""
    return outbox.filter((F.col("status") == "pending") & (F.col("next_attempt_at") <= now_ms)).orderBy("next_attempt_at", "id").limit(limit)


def requeued(jobs: DataFrame, now_ms: int, most: int = 3) -> DataFrame:
    """Jobs whose lease has run out wait again, or have failed after most attempts."""
    expired = (F.col("status") == "running") & (F.col("lease_until") < now_ms)
    return jobs.withColumn("status", F.when(expired & (F.col("attempts") >= most), "failed").when(expired, "retry_wait").otherwise(F.col("status")))


def merged_bars(old: DataFrame, new: DataFrame, today: str) -> DataFrame:
    """Bars with new ones added; only today's may be restated."""
    fresh = new.join(old.select("date"), "date", "left_anti")
    restated = new.filter(F.col("date") == today)
    kept = old.join(restated.select("date"), "date", "left_anti")
    return kept.unionByName(fresh.filter(F.col("date") != today)).unionByName(restated)
