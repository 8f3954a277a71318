"""What a write leaves behind, as a table made of the old one and the new rows.

Each function gives the whole table after the write, to be written beside the old
one and swapped, so that a write that is repeated or lost half-way does no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _same(keys: list[str]):
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return same


def _keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*[F.col(k).alias(f"_key_{k}") for k in keys]).distinct()


def without(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of old whose key gone doesn't have; nulls are equal."""
    return old.join(_keys(gone, keys), _same(keys), "left_anti")


def replaced(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of new, and those of old whose key isn't among new's; a key's rows change together."""
    return old.join(_keys(new, keys), _same(keys), "left_anti").unionByName(new.select(*old.columns))


def appended(history: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """An append-only history: rows of keys that it has already change nothing, and of several new ones with a key the first (by the other columns) counts."""
    others = [c for c in history.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min(F.struct(*others)).alias("_first")).select(*keys, "_first.*").select(*history.columns)
    return history.unionByName(first.join(_keys(history, keys), _same(keys), "left_anti"))


def replaced_if_unchanged(old: DataFrame, new: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """replaced() for the keys of new whose fingerprint is still the current one; results for inputs that changed since are left out."""
    now = current.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("fingerprint").alias("_now"))
    return replaced(old, new.join(now, _same(keys) & F.col("fingerprint").eqNullSafe(F.col("_now")), "left_semi"), keys)


def admitted(documents: DataFrame, loads: DataFrame, replace: bool) -> DataFrame:
    """loads (doc_id, content_hash, filename) with admitted and reason.

    With replace, a load takes its doc_id's place. Without, one whose hash or file
    name a document has already, or an earlier load (by doc_id), is a duplicate.
    """
    if replace:
        return loads.withColumns({"admitted": F.lit(True), "reason": F.lit(None).cast("string")})
    marked = loads
    for c, late, known in (("content_hash", "_h", "_old_h"), ("filename", "_f", "_old_f")):
        first = loads.groupBy(c).agg(F.min("doc_id").alias(late))  # a hash that many share is one row before it is joined
        marked = marked.join(first, c, "left").withColumn(late, F.coalesce(F.col("doc_id") > F.col(late), F.lit(False)))
        marked = marked.join(documents.select(c).distinct().withColumn(known, F.lit(True)), c, "left")
    reason = F.when(F.col("_h") | F.coalesce("_old_h", F.lit(False)), "duplicate content").when(F.col("_f") | F.coalesce("_old_f", F.lit(False)), "duplicate name")
    return marked.withColumns({"admitted": reason.isNull(), "reason": reason}).select(*loads.columns, "admitted", "reason")


def publish(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace the partitions that df has rows of, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
