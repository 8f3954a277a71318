"""The driver's tables, and the shapes that stand in for research data.

The tables hold no claims, prices or sessions, so queries work by analogy: an
order is a claim of its customer on its priority, a user's events are a session,
a part's line items are trades, a conversation is a chain of entries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def cents(column: str):
    """A money value as whole cents, whose sums don't depend on their order."""
    return F.round(F.col(column) * 100).cast("long")
