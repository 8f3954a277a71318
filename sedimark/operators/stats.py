"""Histograms, clusters, paired comparisons and diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def histogram(rows: DataFrame, group: list[str], name: Column, names: list[str]) -> DataFrame:
    """Rows of each group and bucket, zero where a bucket is empty."""
    counted = rows.withColumn("bucket", name).groupBy(*group, "bucket").agg(F.count("*").alias("n"))
    every = rows.select(*group).distinct().withColumn("bucket", F.explode(F.array(*[F.lit(n) for n in names])))
    return every.join(counted, [*group, "bucket"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def above(rows: DataFrame, group: list[str], value: str, thresholds: list[float]) -> DataFrame:
    """Rows over each threshold, in one pass."""
    return rows.groupBy(*group).agg(*[F.count_if(F.col(value) > t).alias(f"over_{t:g}") for t in thresholds])


def clusters(rows: DataFrame, keys: list[str], parent: str, least: int = 2) -> DataFrame:
    """n_clusters, n_rows, n_parents and mean size of the groups of keys with least rows or more."""
    groups = rows.groupBy(*keys, parent).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return groups.agg(F.count("*").alias("n_clusters"), F.sum("n").alias("n_rows"), F.countDistinct(parent).alias("n_parents"), F.avg("n").alias("mean_size"))


def median_of_rates(rows: DataFrame, bucket: list[str], unit: str, hit: Column) -> DataFrame:
    """The median over units of each bucket of the unit's share of hits."""
    rates = rows.groupBy(*bucket, unit).agg(F.avg(hit.cast("double")).alias("rate"))
    return rates.groupBy(*bucket).agg(F.count("*").alias("units"), F.expr("percentile(rate, 0.5D)").alias("median_rate"))


def paired(rows: DataFrame, group: list[str], side: str, baseline: str, candidate: str, value: str) -> DataFrame:
    """group, base and cand where either side has exactly one row."""
    counts = rows.filter(F.col(side).isin(baseline, candidate)).groupBy(*group).agg(
        F.count_if(F.col(side) == baseline).alias("_b"), F.count_if(F.col(side) == candidate).alias("_c"),
        F.max(F.when(F.col(side) == baseline, F.col(value))).alias("base"), F.max(F.when(F.col(side) == candidate, F.col(value))).alias("cand"),
    )
    return counts.filter("_b = 1 AND _c = 1").drop("_b", "_c")


def pair_summary(pairs: DataFrame) -> DataFrame:
    """pairs, means and delta over pairs with both values, and wins, ties and losses of the candidate."""
    both = F.col("base").isNotNull() & F.col("cand").isNotNull()
    rows = pairs.filter(both)
    return rows.agg(
        F.count("*").alias("pairs"), F.avg("base").alias("mean_base"), F.avg("cand").alias("mean_cand"), F.avg(F.col("cand") - F.col("base")).alias("mean_delta"),
        F.count_if(F.col("cand") > F.col("base")).alias("wins"), F.count_if(F.col("cand") == F.col("base")).alias("ties"), F.count_if(F.col("cand") < F.col("base")).alias("losses"),
    )


def diagnostics(rows: DataFrame, group: list[str], side: str, sides: list[str]) -> DataFrame:
    """missing, duplicate or ok for each group and side."""
    counted = rows.groupBy(*group, side).agg(F.count("*").alias("n"))
    every = rows.select(*group).distinct().withColumn(side, F.explode(F.array(*[F.lit(s) for s in sides])))
    joined = every.join(counted, [*group, side], "left")
    return joined.select(*group, side, F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicate").otherwise("ok").alias("status"))


def full_diff(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """added, removed, changed or same for each key of either table."""
    a, b = old.select(*keys, F.col(value).alias("_old"), F.lit(1).alias("_in_old")), new.select(*keys, F.col(value).alias("_new"), F.lit(1).alias("_in_new"))
    joined = a.join(b, keys, "full_outer")
    kind = F.when(F.col("_in_old").isNull(), "added").when(F.col("_in_new").isNull(), "removed").when(F.col("_old").eqNullSafe(F.col("_new")), "same").otherwise("changed")
    return joined.select(*keys, kind.alias("change"))
