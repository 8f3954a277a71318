"""A full-text index of overlapping trigrams, kept up batch by batch.

The index is a set of tables with versions. A batch appends one segment of postings: a
row for each trigram of a text with its places. Segments are never changed. Who is live
is a table of its own, id and stamp (the batch that wrote its text); postings of another
stamp are dead. merged() writes the live postings as one segment.

A phrase is found by its trigrams alone: they stand at consecutive places where, and only
where, the phrase does. A search reads the postings of these trigrams and no text; segments
are sorted by trigram, so that the filter reaches the row groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimark.sources.commits import Tables, append, replace, replace_keys

POSTINGS = "gram string, id long, stamp long, places array<int>"


def postings(texts: DataFrame, stamp: int, form: Callable[[Column], Column] = F.lower) -> DataFrame:
    """gram, id, stamp and places (from 0) of the trigrams of texts (id, text), a row for each trigram of a text.

    form is what makes texts and phrases alike. Texts of fewer than three characters have none.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                some, rows = batch.slice(at, 200), []
                for own, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    found: dict[str, list[int]] = {}
                    for k in range(len(text) - 2):
                        found.setdefault(text[k : k + 3], []).append(k)
                    rows += [(gram, own, stamp, places) for gram, places in found.items()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32())), strict=True)], ["gram", "id", "stamp", "places"])

    letters = texts.select(F.col("id").cast("long").alias("id"), form(F.col("text")).alias("t")).filter("id IS NOT NULL AND length(t) >= 3")
    return letters.mapInArrow(work, POSTINGS)


def _sorted(rows: DataFrame, spread: int = 16) -> DataFrame:
    """In files sorted by trigram; a common one is dealt over spread partitions."""
    return rows.repartition("gram", F.pmod(F.xxhash64("id"), F.lit(spread))).sortWithinPartitions("gram", "id")


def apply_batch(tables: Tables, batch: int, texts: DataFrame, deleted: DataFrame | None = None, form: Callable[[Column], Column] = F.lower) -> int:
    """Index texts (id, text), which replace earlier ones of their ids, and drop the ids of deleted; returns the version.

    Batches come in the order of their numbers; one that comes again changes nothing. Of
    several texts with an id in a batch the greatest counts. An id that is in both is deleted
    first. A null text, like one of two characters, can't be found but is live.
    """
    base = tables.version()
    notes = tables.manifest(base)["notes"]
    if batch <= notes.get("batch", -1):
        return base
    one = texts.filter("id IS NOT NULL").groupBy(F.col("id").cast("long").alias("id")).agg(F.max("text").alias("text"))
    live = one.select("id", F.lit(batch).cast("long").alias("stamp"))
    gone = None if deleted is None else deleted.select(F.col("id").cast("long").alias("id"))
    return tables.commit({"postings": append(_sorted(postings(one, batch, form))), "live": replace_keys(live, ["id"], gone)}, base, {"batch": batch})


def live_postings(tables: Tables, version: int | None = None) -> DataFrame:
    version = tables.version() if version is None else version
    return tables.read("postings", version).join(tables.read("live", version), ["id", "stamp"], "left_semi").select("gram", "id", "stamp", "places")


def merged(tables: Tables) -> int:
    """Replace all segments by one with the live postings."""
    base = tables.version()
    return tables.commit({"postings": replace(_sorted(live_postings(tables, base)))}, base)


def search(tables: Tables, phrase: str, version: int | None = None, form: Callable[[Column], Column] = F.lower) -> DataFrame:
    """id, hits (places, overlapping ones too) and first (from 0) of the live texts that hold the phrase, of three characters or more."""
    spark, version = tables.spark, tables.version() if version is None else version
    want = spark.range(1).select(form(F.lit(phrase)).alias("p")).first()["p"]
    if len(want) < 3:
        raise ValueError("a phrase needs three characters")
    shifts: dict[str, list[int]] = {}
    for k in range(len(want) - 2):
        shifts.setdefault(want[k : k + 3], []).append(k)
    found = tables.read("postings", version).filter(F.col("gram").isin(list(shifts)))
    shift = F.create_map(*[x for g, ks in shifts.items() for x in (F.lit(g), F.array(*[F.lit(k) for k in ks]))])
    starts = found.select("id", "stamp", "places", F.explode(shift[F.col("gram")]).alias("k")).select("id", "stamp", F.explode("places").alias("place"), "k")
    whole = starts.groupBy("id", "stamp", (F.col("place") - F.col("k")).alias("at")).agg(F.count("*").alias("n")).filter(F.col("n") == len(want) - 2)
    hits = whole.groupBy("id", "stamp").agg(F.count("*").alias("hits"), F.min("at").alias("first"))
    return hits.join(tables.read("live", version), ["id", "stamp"], "left_semi").select("id", "hits", "first")
