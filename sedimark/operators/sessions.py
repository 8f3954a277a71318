"""Append-only session logs: paths, context, active time, cache use and usage totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def active_time(entries: DataFrame, keys: list[str], order: list[str], at: str, boundary: Column) -> DataFrame:
    """active: the sum of positive gaps before rows that aren't boundaries, in at's unit.

    Rows without a time are passed over; a boundary moves the clock and adds nothing.
    """
    rows = entries.filter(F.col(at).isNotNull()).withColumn("_boundary", boundary)
    gap = F.col(at) - F.lag(at).over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_gap", F.when(~F.col("_boundary") & (gap > 0), gap).otherwise(0)).groupBy(*keys).agg(F.sum("_gap").alias("active"))


def cache_waste(turns: DataFrame, keys: list[str], order: list[str], floor: int = 1024) -> DataFrame:
    """turns with missed: prompt tokens that the cache held before and that were sent again.

    turns has prompt, cache_read, cache_write and reset. The previous prompt is that
    of the last turn with tokens since the last reset; a turn without any cache
    traffic counts only if an earlier one of the stretch reported some. Misses up
    to floor are noise.
    """
    all_rows = Window.partitionBy(*keys).orderBy(*order)
    rows = turns.withColumn("_stretch", F.sum(F.col("reset").cast("int")).over(all_rows))
    before = Window.partitionBy(*keys, "_stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    used = F.col("cache_read") + F.col("cache_write") > 0
    live = ~F.col("reset") & (F.col("prompt") > 0)
    rows = rows.withColumn("_previous", F.last(F.when(live, F.col("prompt")), ignorenulls=True).over(before)).withColumn("_reported", F.coalesce(F.max(F.when(live, used)).over(before), F.lit(False)))
    missed = F.least("_previous", "prompt") - F.col("cache_read")
    counts = live & F.col("_previous").isNotNull() & (used | F.col("_reported")) & (missed > floor)
    return rows.withColumn("missed", F.when(counts, missed).otherwise(0)).drop("_stretch", "_previous", "_reported")


def latest_fact(facts: DataFrame, keys: list[str], value: str, order: str, keep_null: bool = False) -> DataFrame:
    """The value with the largest order of each key; a null that came last clears the key."""
    out = facts.groupBy(*keys).agg(F.max_by(F.struct(value), F.col(order)).alias("_f")).select(*keys, F.col(f"_f.{value}").alias(value))
    return out if keep_null else out.filter(F.col(value).isNotNull())


def leaves(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Entries that are no entry's parent."""
    parents = entries.select(*keys, F.col("parent_id").alias("id")).filter("id IS NOT NULL").distinct()
    return entries.join(parents, [*keys, "id"], "left_anti")


def roots(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Entries without a parent, with themselves as parent, or with one that isn't there."""
    known = entries.select(*keys, F.col("id").alias("parent_id")).distinct()
    orphans = entries.join(known, [*keys, "parent_id"], "left_anti")
    return orphans.unionByName(entries.filter("id = parent_id"))


def cut_point(messages: DataFrame, keys: list[str], order: str, tokens: str, valid: Column, keep: int) -> DataFrame:
    """first_kept of each key: the earliest valid cut at or after the entry where keep tokens are reached from the end."""
    back = Window.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = messages.withColumns({"_valid": valid, "_sum": F.sum(tokens).over(back)})
    reached = rows.filter(F.col("_sum") >= keep).groupBy(*keys).agg(F.max(order).alias("_at"))
    return rows.join(reached, keys).filter(F.col("_valid") & (F.col(order) >= F.col("_at"))).groupBy(*keys).agg(F.min(order).alias("first_kept"))


def compacted_context(path: DataFrame, keys: list[str], order: str) -> DataFrame:
    """What of a path is still context: its last compaction first, then the kept tail and what followed.

    path has type and, on compactions, first_kept (an order value). Without a
    compaction the whole path stays.
    """
    whole = Window.partitionBy(*keys)
    last = F.max_by(F.struct(F.col(order).alias("at"), "first_kept"), F.when(F.col("type") == "compaction", F.col(order))).over(whole)
    rows = path.withColumn("_last", F.when(F.max(F.when(F.col("type") == "compaction", 1)).over(whole) == 1, last))
    kept = F.col("_last").isNull() | (F.col(order) == F.col("_last.at")) | ((F.col("type") != "compaction") & (F.col(order) >= F.coalesce("_last.first_kept", "_last.at")))
    first = F.col(order) == F.col("_last.at")
    ranked = Window.partitionBy(*keys).orderBy(F.when(first, 0).otherwise(1), order)
    return rows.filter(kept).withColumn("position", F.row_number().over(ranked)).drop("_last")


def stop_bounded(branch: DataFrame, keys: list[str], order: str, stop: Column) -> DataFrame:
    """Rows of a branch from its last stop on, the stop included; all of it without a stop."""
    rows = branch.withColumn("_stop", stop)
    at = F.max(F.when(F.col("_stop"), F.col(order))).over(Window.partitionBy(*keys))
    return rows.withColumn("_at", at).filter(F.col("_at").isNull() | (F.col(order) >= F.col("_at"))).drop("_stop", "_at")


def merged_log(streams: dict[str, DataFrame], after: int, limit: int) -> DataFrame:
    """The next limit rows after a sequence number, over several typed streams with seq and id."""
    parts = [df.select("seq", F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id")).filter(F.col("seq") > after) for kind, df in streams.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.orderBy("seq", "kind", "id").limit(limit)


def usage_rollup(usage: DataFrame, levels: list[str], sums: dict[str, Column], distinct: Column) -> DataFrame:
    """Sums and distinct sessions at every prefix of levels, down to the grand total; level tells which."""
    out = usage.rollup(*levels).agg(F.grouping_id().alias("level"), *[F.sum(c).alias(n) for n, c in sums.items()], F.countDistinct(distinct).alias("sessions"))
    return out.withColumn("level", F.col("level").cast("long"))


PATH = "session string, leaf string, position int, id string"


def leaf_paths(entries: DataFrame, tips: DataFrame) -> DataFrame:
    """The way from the root to each tip (session, leaf): position and id, the root first.

    entries has session, id and parent_id. A session's entries are walked in one
    task, as chains are thousands of entries deep; a loop ends the walk. An unknown
    tip gives nothing.
    """
    import pandas as pd

    def walk(key, nodes: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        parent = dict(zip(nodes["id"], nodes["parent_id"], strict=True))
        out = []
        for leaf in ends["leaf"]:
            path, seen, at = [], set(), leaf
            while at in parent and at not in seen:
                path.append(at)
                seen.add(at)
                at = parent[at]
            out += [(key[0], leaf, i, x) for i, x in enumerate(reversed(path))]
        return pd.DataFrame(out, columns=["session", "leaf", "position", "id"])

    return entries.select("session", "id", "parent_id").groupBy("session").cogroup(tips.select("session", "leaf").groupBy("session")).applyInPandas(walk, PATH)


def forked(entries: DataFrame, path: DataFrame, new_session: str) -> DataFrame:
    """A path's entries as a session of their own, numbered from 1."""
    joined = path.join(entries.select("session", "id", "parent_id", "type"), ["session", "id"])
    return joined.select(F.lit(new_session).alias("session"), (F.col("position") + 1).alias("seq"), "id", "parent_id", "type")


def tool_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls, results, errors, unresolved calls and mean tokens of each tool."""
    joined = calls.join(results.select("call_id", "is_error", "tokens"), "call_id", "left")
    return joined.groupBy("tool").agg(F.count("*").alias("calls"), F.count("is_error").alias("results"), F.count_if("is_error").alias("errors"), F.count_if(F.col("is_error").isNull()).alias("unresolved"), F.avg("tokens").alias("mean_tokens"))


def pending_calls(calls: DataFrame, results: DataFrame) -> DataFrame:
    """The last call of each session that has no result."""
    open_ = calls.join(results.select("call_id"), "call_id", "left_anti")
    return open_.groupBy("session").agg(F.max_by("call_id", "seq").alias("call_id"), F.count("*").alias("pending"))


def context_usage(sessions: DataFrame, group: list[str], windows: DataFrame) -> DataFrame:
    """Mean and median of the largest prompt as a share of its model's window, and how many went over 80, 90 and 100 %.

    sessions has model, prompt and compacted; windows (model, window) is a
    dimension of a few thousand rows.
    """
    joined = sessions.join(windows, "model").withColumn("share", F.col("prompt") / F.col("window"))
    return joined.groupBy(*group).agg(
        F.count("*").alias("sessions"), F.avg("share").alias("mean_share"), F.expr("percentile(share, 0.5D)").alias("median_share"), F.avg(F.col("compacted").cast("int")).alias("compaction_rate"),
        *[F.count_if(F.col("share") > t / 100).alias(f"over_{t}") for t in (80, 90, 100)],
    )


def attempt_gaps(records: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Records whose attempt number isn't the one after the last of their operation."""
    w = Window.partitionBy(*keys).orderBy(order)
    expected = F.coalesce(F.lag("attempt").over(w), F.lit(0)) + 1
    return records.withColumn("expected", expected).filter("attempt <> expected")
