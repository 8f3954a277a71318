"""Versioned catalogs: what is active, new versions, upserts and fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimark.functions.folds import folded


def active(df: DataFrame, history: bool = False) -> Column:
    """Not deleted, current and active, by those of the three columns that df has."""
    have, out = set(df.columns), F.lit(True)
    if "deleted_at" in have:
        out = out & F.col("deleted_at").isNull()
    if "is_current" in have and not history:
        out = out & (F.coalesce(F.col("is_current").cast("int"), F.lit(1)) == 1)
    if "lifecycle_state" in have:
        out = out & (F.coalesce("lifecycle_state", F.lit("active")) == "active")
    return out


def numbered_within(df: DataFrame, key: str, order: str, span: int = 65_536) -> DataFrame:
    """df with _n, the place of each row among its key's rows by order (a whole number, nulls first).

    Rows are numbered within spans of order, and the spans' counts are added up
    before them, so that a hot key is spread over its spans.
    """
    cut = df.withColumn("_span", F.floor(F.col(order) / span))
    counts = cut.groupBy(key, "_span").agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(F.col(key).alias("_k"), F.col("_span").alias("_s"), F.coalesce(before, F.lit(0)).alias("_before"))
    inner = cut.withColumn("_n", F.row_number().over(Window.partitionBy(key, "_span").orderBy(order)))
    met = inner.join(offsets, F.col(key).eqNullSafe(F.col("_k")) & F.col("_span").eqNullSafe(F.col("_s")))
    return met.withColumn("_n", F.col("_n") + F.col("_before")).drop("_span", "_k", "_s", "_before")


def registered(catalog: DataFrame, incoming: DataFrame, logical: str, checksum: str) -> DataFrame:
    """The catalog after a registration: known checksums are reused, new ones are the next version.

    catalog has logical, checksum, version_no and is_current; incoming has logical,
    checksum and ord, a number for the order in which several versions of one id
    arrive; a checksum that comes several times counts once, as first seen.
    """
    seen = incoming.groupBy(logical, checksum).agg(F.min("ord").alias("ord"))
    new = seen.join(catalog.select(logical, checksum), [logical, checksum], "left_anti")
    top = catalog.groupBy(logical).agg(F.max("version_no").alias("_top"))
    numbered = numbered_within(new, logical, "ord").join(top, logical, "left").withColumn("version_no", (F.coalesce("_top", F.lit(0)) + F.col("_n")).cast("int"))
    both = catalog.select(logical, checksum, "version_no").unionByName(numbered.select(logical, checksum, "version_no"))
    newest = both.groupBy(logical).agg(F.max("version_no").alias("_newest"))
    return both.join(newest, logical).withColumn("is_current", F.col("version_no") == F.col("_newest")).drop("_newest")


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """old with the rows of new in place of those with the same keys; of several new rows the last by order."""
    last = new.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in old.columns if c not in keys]), F.struct(*order)).alias("_n")).select(*keys, "_n.*").select(*old.columns)
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(last)


def inserted_if_absent(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """old and the first new row of each key that old lacks."""
    absent = new.join(old.select(*keys), keys, "left_anti")
    first = absent.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in old.columns if c not in keys]), F.struct(*order)).alias("_n")).select(*keys, "_n.*").select(*old.columns)
    return old.unionByName(first)


def request_conflicts(rows: DataFrame, keys: list[str], payload: Column) -> DataFrame:
    """Requests that came again with another payload."""
    return rows.groupBy(*keys).agg(F.countDistinct(payload).alias("payloads")).filter("payloads > 1")


def fingerprint(rows: DataFrame, keys: list[str], order: list[str], parts: list[str]) -> DataFrame:
    """SHA-256 of each group's row digests in order; a group's rows are its document's pages or cells.

    Digests are made where the rows lie and streamed through one hash, so that a group of any size takes no memory.
    """
    row = F.sha2(F.concat_ws("\0", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]), 256)

    def hashed(group: Iterable[tuple]) -> Iterator[tuple]:
        whole, mark = hashlib.sha256(), b""
        for *_, digest in group:
            whole.update(mark + digest.encode())
            mark = b"\0"
        yield (whole.hexdigest(),)

    return folded(rows.select(*keys, *order, row.alias("_d")), keys, [*order, "_d"], hashed, "fingerprint string").select(*keys, "fingerprint")


def pending(every: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What isn't done yet."""
    return every.join(done.select(*keys), keys, "left_anti")


def one_dataset(df: DataFrame, column: str = "dataset_id") -> str:
    """The only non-blank dataset id of a collection; anything else is an error."""
    found = [r[0] for r in df.filter(F.trim(column) != "").select(column).distinct().limit(2).collect()]
    if len(found) != 1:
        raise ValueError(f"a collection has one {column}, this one has {len(found) or 'none'}")
    return found[0]


def page_range(pages: DataFrame, first: int, last: int) -> DataFrame:
    """Pages first to last with complete: whether all of them are there."""
    inside = pages.filter(F.col("page_number").between(first, last))
    whole = inside.groupBy("doc_id").agg((F.countDistinct("page_number") == last - first + 1).alias("complete"))
    return inside.join(whole, "doc_id")


def cells_of(cells: DataFrame, bounds: Column, offset: int, limit: int) -> DataFrame:
    """A page of the cells inside bounds (struct of rows and columns) in sheet, row and column order."""
    inside = F.col("row_index").between(bounds["row_start"], bounds["row_end"]) & F.col("col_index").between(bounds["col_start"], bounds["col_end"])
    return cells.filter(inside).orderBy("sheet_index", "row_index", "col_index").offset(offset).limit(limit)


def conformed(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with exactly these columns; those that it lacks are null."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])
