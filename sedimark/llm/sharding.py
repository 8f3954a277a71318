"""Shards and slots by a Feistel permutation of global row numbers.

Row number i of N goes to p(i), a keyed permutation of 0..N-1: a balanced
Feistel network over the smallest even number of bits that holds N, walked
until the value is below N. Shard is p(i) mod shards and slot p(i) div shards,
so both can be computed for any row, counts differ by one at most and slots
have no gaps. Row numbers follow (doc_id, checksum, size), so they don't depend
on how the input is partitioned.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.llm._common import mix64, shared_folder, stored, text_of

ROUNDS = 4


def permute(values: np.ndarray, n: int, seed: int) -> np.ndarray:
    """p(values) for values in 0..n-1, by cycle walking."""
    if n <= 1:
        return np.zeros(len(values), dtype=np.int64)
    half = max(1, -(-(n - 1).bit_length() // 2))
    low, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mix64(np.uint64(seed) + np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & low
        for key in keys:
            left, right = right, left ^ (mix64(right + key) & low)
        return left << shift | right

    out = once(values.astype(np.uint64))
    while (far := np.flatnonzero(out >= np.uint64(n))).size:
        out[far] = once(out[far])
    return out.astype(np.int64)


def numbered(rows: DataFrame, *keys: str) -> tuple[DataFrame, int]:
    """rows with row_number from 0 in the order of keys, and how many there are.

    Ordered parts are written with the place of each row in its part; only the
    parts' sizes go through the driver, as many as the shuffle has partitions.
    """
    spark = rows.sparkSession
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_place", F.monotonically_increasing_id())
    placed = stored(placed, shared_folder(spark), "numbered")
    part = F.shiftright("_place", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    before, total = [], 0
    for row in sizes:
        before.append((row["part"], total))
        total += row["n"]
    offsets = spark.createDataFrame(before, "_part long, _before long")
    joined = placed.join(F.broadcast(offsets), part == F.col("_part"))  # a row for each partition of the shuffle
    return joined.withColumn("row_number", F.col("_before") + F.col("_place").bitwiseAND((1 << 33) - 1)).drop("_place", "_part", "_before"), total


def shard_rows(docs: DataFrame, shards: int = 24, seed: int = 20240229) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row.

    A null text has no bytes; null doc_ids come first; repeated rows are rows of
    their own. grown_shard is null: the law is that of rows, not of keys.
    """
    text = text_of()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = stored(rows, shared_folder(docs.sparkSession), "sizes")
    placed, total = numbered(rows, "doc_id", "text_crc32", "size")

    @F.pandas_udf("long")
    def place(row_number: pd.Series) -> pd.Series:
        return pd.Series(permute(row_number.to_numpy(), total, seed))

    return placed.withColumn("_at", place("row_number")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("_at") % shards).cast("int").alias("shard"),
        F.floor(F.col("_at") / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )
