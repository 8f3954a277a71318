"""Records with revisions: edits that name the revision they rest on, reads as of any time, restores as new revisions.

A table of revisions has card_id, revision (from 1), valid_from, valid_to (null: current)
and content columns. A record's revisions follow each other without a gap or an overlap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FRAME = ("card_id", "revision", "valid_from", "valid_to")


def _content(revisions: DataFrame) -> list[str]:
    return [c for c in revisions.columns if c not in FRAME]


def current(revisions: DataFrame) -> DataFrame:
    return revisions.filter("valid_to IS NULL")


def as_of(revisions: DataFrame, at) -> DataFrame:
    """The revision of each record that was valid at a time; none before its first."""
    return revisions.filter((F.col("valid_from") <= F.lit(at)) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.lit(at))))


def outcomes(revisions: DataFrame, edits: DataFrame) -> DataFrame:
    """edits (card_id, expected, at, request_id and content) with outcome.

    An edit is created (expected 0, no such record), revised (expected is the current revision),
    unchanged (its content is the current one), stale, unknown, or too_early (not after the
    revision it follows). Of several edits of one record in a batch the first, by at and
    request_id, counts and the others are stale; an edit without a record's id is unknown.
    """
    content = _content(revisions)
    held = current(revisions).select(F.col("card_id").alias("_card"), F.col("revision").alias("_now"), F.col("valid_from").alias("_since"), F.struct(*content).alias("_held"))
    rank = F.row_number().over(Window.partitionBy("card_id").orderBy("at", "request_id", F.struct(*content)))
    rows = edits.withColumn("_place", rank).join(held, F.col("card_id") == F.col("_card"), "left")
    expected, now = F.coalesce("expected", F.lit(0)), F.coalesce("_now", F.lit(0))
    outcome = (
        F.when(F.col("card_id").isNull() | ((now == 0) & (expected != 0)), "unknown")
        .when((expected != now) | (F.col("_place") > 1), "stale")
        .when(now == 0, "created")
        .when(F.col("_held").eqNullSafe(F.struct(*content)), "unchanged")
        .when(F.coalesce(F.col("at") > F.col("_since"), F.lit(False)), "revised")
        .otherwise("too_early")
    )
    return rows.select(*edits.columns, outcome.alias("outcome"))


def edited(revisions: DataFrame, edits: DataFrame) -> DataFrame:
    """The table after the edits that are created or revised: the current revision ends where the new one begins."""
    taken = outcomes(revisions, edits).filter(F.col("outcome").isin("created", "revised"))
    ends = taken.select(F.col("card_id").alias("_card"), F.col("at").alias("_end"))
    closed = revisions.join(ends, (F.col("card_id") == F.col("_card")) & F.col("valid_to").isNull(), "left").withColumn("valid_to", F.coalesce("valid_to", "_end"))
    kind = {f.name: f.dataType for f in revisions.schema}
    values = {"revision": F.coalesce("expected", F.lit(0)) + 1, "valid_from": F.col("at"), "valid_to": F.lit(None)}
    new = taken.select(*[values.get(c, F.col(c)).cast(kind[c]).alias(c) for c in revisions.columns])
    return closed.select(*revisions.columns).unionByName(new)


def restoring(revisions: DataFrame, requests: DataFrame) -> DataFrame:
    """Edits that bring the content of an earlier revision back, for requests (card_id, revision, expected, at, request_id); unknown revisions give none."""
    content = _content(revisions)
    old = revisions.select(F.col("card_id").alias("_card"), F.col("revision").alias("_old"), *content)
    found = requests.join(old, (F.col("card_id") == F.col("_card")) & (F.col("revision") == F.col("_old")))
    return found.select("card_id", "expected", "at", "request_id", *content)


def history(revisions: DataFrame) -> DataFrame:
    """All revisions, the newest first, each with whether it is the current one."""
    return revisions.withColumn("is_current", F.col("valid_to").isNull()).orderBy("card_id", F.desc("revision"))


def checked_selection(revisions: DataFrame, selection: DataFrame, archived: str = "archived") -> DataFrame:
    """selection (card_id, revision) with state: ready, changed (another revision is current), archived or unknown; content comes with ready ones."""
    content = _content(revisions)
    held = current(revisions).select(F.col("card_id").alias("_card"), F.col("revision").alias("_now"), *content)
    rows = selection.join(held, F.col("card_id") == F.col("_card"), "left")
    state = F.when(F.col("_now").isNull(), "unknown").when(F.col("_now") != F.col("revision"), "changed").when(F.coalesce(F.col("status") == archived, F.lit(False)), "archived").otherwise("ready")
    rows = rows.withColumn("state", state)
    return rows.select("card_id", "revision", "state", *[F.when(F.col("state") == "ready", F.col(c)).alias(c) for c in content])


def breaks(revisions: DataFrame) -> DataFrame:
    """Rows that don't follow the revision before them: a number is left out, or validity has a gap, an overlap or is empty."""
    along = Window.partitionBy("card_id").orderBy("revision", "valid_from")
    rows = revisions.withColumns({"_n": F.row_number().over(along), "_end": F.lag("valid_to").over(along)})
    right = (F.col("revision") == F.col("_n")) & ((F.col("_n") == 1) | F.coalesce(F.col("_end") == F.col("valid_from"), F.lit(False))) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("valid_from")))
    return rows.filter(~F.coalesce(right, F.lit(False))).select(*revisions.columns)
