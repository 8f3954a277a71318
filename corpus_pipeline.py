"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of documents. No stage can be written in SQL as a whole, so ORACLE_SQL
is None; tests compare each with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sedimark.llm._common import shared_folder, stored, table
from sedimark.llm.exact_dedup import drop_exact_duplicates
from sedimark.llm.near_dedup import drop_near_duplicates
from sedimark.llm.packing import pack
from sedimark.llm.quality import accepted, train
from sedimark.llm.secret_scan import redacted
from sedimark.llm.word_tokens import tokenizer_path

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model rejects go."""
    return accepted(docs, train(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by shingles of five words at a similarity of 0.8, the smallest doc_id stays."""
    return drop_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; every document stays."""
    return redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 2048 tokens."""
    return pack(docs, tokenizer_path(), end_id=1, memo_bytes=64 << 20, keep_memo=False)


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("secrets", secrets), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), folder, name)
    return STAGES[-1][1](spark, docs, sf_dir)
