"""Filters that callers put together, listings, due work, votes and checks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def where_all(df: DataFrame, after: tuple[str, int] | None = None, **equal) -> DataFrame:
    """Rows that meet every condition given; None asks for nothing, a list for any of its values, after for later numbers only."""
    for column, wanted in equal.items():
        if wanted is not None:
            df = df.filter(F.col(column).isin(list(wanted)) if isinstance(wanted, (list, tuple, set)) else F.col(column) == wanted)
    return df if after is None else df.filter(F.col(after[0]) > after[1])


def of_run(records: DataFrame, run: Column | str) -> DataFrame:
    """Records of a run; a record that starts an operation belongs to the run of its own id."""
    return records.filter(F.when(F.col("type") == "operation_started", F.col("id")).otherwise(F.col("run_id")) == run)


def chosen_sessions(sessions: DataFrame, commands: DataFrame, session: str, model: str | None = None, prefixes: Iterable[str] = (), contains: Iterable[str] = ()) -> DataFrame:
    """Sessions whose model has a text in it, starts with one of the prefixes and ran a command with one of the texts; case doesn't matter.

    commands (session, command) are met by a semi join on the sessions that ran one.
    """
    low = F.lower("model")
    if model:
        sessions = sessions.filter(F.contains(low, F.lit(model.lower())))
    starts = [F.startswith(low, F.lit(p.lower())) for p in prefixes]
    if starts:
        sessions = sessions.filter(_any(starts))
    texts = [F.contains(F.lower("command"), F.lit(t.lower())) for t in contains]
    return sessions.join(commands.filter(_any(texts)).select(session).distinct(), session, "left_semi") if texts else sessions


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def due_trackers(trackers: DataFrame, observations: DataFrame, now_ms: int, again_ms: int = 1_800_000, late_minutes: int = 120) -> DataFrame:
    """Trackers that are to be looked at now.

    trackers has id, enabled, start_date, lease_until, last_attempt_at (both in ms)
    and, of its venue's clock, day, after_close, minutes_after_close, checked_day and
    checked_after_close. One is due after the close of a day that it wasn't checked
    after, or within late_minutes if observations (id, day) lack that day; not
    while it is leased or within again_ms of an attempt.
    """
    free = ~F.coalesce(F.col("lease_until") > now_ms, F.lit(False)) & ~F.coalesce(now_ms - F.col("last_attempt_at") < again_ms, F.lit(False))
    ready = trackers.filter(F.col("enabled") & F.col("after_close") & (F.col("day") >= F.col("start_date")) & free)
    seen = observations.select("id", "day").distinct().withColumn("_seen", F.lit(True))
    unchecked = F.col("checked_day").isNull() | (F.col("checked_day") < F.col("day")) | ~F.col("checked_after_close")
    return ready.join(seen, ["id", "day"], "left").filter(unchecked | ((F.col("minutes_after_close") <= late_minutes) & F.col("_seen").isNull())).drop("_seen")


def due_monitors(monitors: DataFrame, requests: DataFrame, now_ms: int) -> DataFrame:
    """Enabled monitors whose time has come, and any that a request (id) asks for."""
    asked = requests.select("id").distinct().withColumn("_asked", F.lit(True))
    return monitors.join(asked, "id", "left").filter(F.col("_asked").isNotNull() | (F.col("enabled") & (F.col("next_run_at") <= now_ms))).drop("_asked")


def polls(subscriptions: DataFrame, today: str, lookback_days: int = 30, overlap_days: int = 2) -> DataFrame:
    """subscriptions with poll_from and poll_to: from some days before the last check, or as far back as a first look goes."""
    end = F.lit(today).cast("date")
    start = F.coalesce(F.date_sub(F.to_date("last_checked_at"), overlap_days), F.date_sub(end, lookback_days))
    return subscriptions.withColumns({"poll_from": start, "poll_to": end})


def unconsumed(inputs: DataFrame, cursor: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """Inputs that a monitor hasn't seen in this form; none means that there is nothing to do."""
    return inputs.join(cursor.select(*keys, digest).distinct(), [*keys, digest], "left_anti")


def run_totals(deliveries: DataFrame, known: DataFrame, key: str, digest: str) -> DataFrame:
    """run, discovered, created and duplicates: a document counts as new in its first run, if known has neither its key nor its content.

    deliveries has run (in order), key and digest.
    """
    each = deliveries.groupBy("run", key, digest).agg(F.count("*").alias("_n"))
    marked = each.join(known.select(key, F.lit(True).alias("_k")).distinct(), key, "left").join(known.select(digest, F.lit(True).alias("_d")).distinct(), digest, "left")
    fresh = marked.filter(F.col("_k").isNull() & F.col("_d").isNull())
    first = fresh.groupBy(digest).agg(F.min(F.struct("run", key)).alias("_f")).select("_f.*").groupBy(key).agg(F.min("run").alias("run"))
    created = first.groupBy("run").agg(F.count("*").alias("created"))
    totals = each.groupBy("run").agg(F.sum("_n").alias("discovered"))
    out = totals.join(created, "run", "left").withColumn("created", F.coalesce("created", F.lit(0)))
    return out.withColumn("duplicates", F.col("discovered") - F.col("created"))


def counted(dimension: DataFrame, facts: DataFrame, key: str, name: str = "n") -> DataFrame:
    """dimension with the number of its facts, none being 0."""
    return dimension.join(facts.groupBy(key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def read_rates(reads: DataFrame, group: list[str], message: list[str]) -> DataFrame:
    """reads, messages, full, partial and the two rates of each group; reads has mode, full or partial."""
    full = F.count_if(F.col("mode") == "full")
    counts = reads.groupBy(*group).agg(F.count("*").alias("reads"), F.countDistinct(F.struct(*message)).alias("messages"), full.alias("full"))
    counts = counts.withColumn("partial", F.col("reads") - F.col("full"))
    return counts.withColumns({"full_rate": F.col("full") / F.col("reads"), "partial_rate": F.col("partial") / F.col("reads")})


def voted_house(hits: DataFrame, key: list[str], most_other: int = 30) -> DataFrame:
    """The house that each document names most: hits on its cover count 100, others 1 up to a bound; ties go to the earlier rank.

    hits has house, rank, cover and other, the numbers of hits.
    """
    score = F.col("cover") * 100 + F.least(F.col("other"), F.lit(most_other))
    scored = hits.withColumn("score", score).filter("score > 0")
    return scored.groupBy(*key).agg(F.max_by(F.struct("house", "score"), F.struct("score", -F.col("rank"))).alias("_b")).select(*key, "_b.*")


def evaluated(cases: DataFrame, results: DataFrame, group: list[str], case: str) -> DataFrame:
    """cases, passed and mean score of each group; results has case, score and passed.

    A case without a result, or with several, which have to be evaluated apart, scores 0 and hasn't passed.
    """
    one = results.groupBy(case).agg(F.count("*").alias("_n"), F.max("score").alias("_s"), F.bool_or("passed").alias("_p")).filter("_n = 1")
    met = cases.join(one, case, "left")
    return met.groupBy(*group).agg(F.count("*").alias("cases"), F.count_if("_p").alias("passed"), F.round(F.avg(F.coalesce("_s", F.lit(0))), 1).alias("score"))


def named_hits(hits: DataFrame, entries: DataFrame, sessions: DataFrame, facts: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Search hits (entry_id, score) with their entry, its session and the session's latest name.

    facts has session_id, seq, kind and value; a name that was cleared is null, and has_name tells it from none.
    """
    found = where_all(hits.join(entries, "entry_id"), type=types).join(sessions, "session_id")
    names = facts.filter("kind = 'name'").groupBy("session_id").agg(F.max_by("value", "seq").alias("session_name"), F.lit(True).alias("has_name"))
    return found.join(names, "session_id", "left").withColumn("has_name", F.coalesce("has_name", F.lit(False)))


def newest(df: DataFrame, key: list[str], order: list[Column], limit: int) -> DataFrame:
    """The first rows of each key by order, at most limit."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("_r") <= limit).drop("_r")


def ranked(df: DataFrame, key: list[str], order: list[Column], name: str) -> DataFrame:
    """df with the place of each row among its key's rows, from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order)).cast("long"))


def written_files(calls: DataFrame, results: DataFrame, turn: list[str]) -> DataFrame:
    """The files that each turn wrote, and the place of the first call that did.

    calls has call_id, position, name and arguments (JSON with file_path or path);
    only writes and edits with a result (call_id, is_error) that is no error count.
    """
    path = F.coalesce(F.get_json_object("arguments", "$.file_path"), F.get_json_object("arguments", "$.path"))
    writes = calls.filter(F.lower("name").isin("write", "edit")).withColumn("path", path).filter(F.length("path") > 0)
    done = writes.join(results.filter("NOT is_error").select("call_id").distinct(), "call_id", "left_semi")
    return done.groupBy(*turn, "path").agg(F.min("position").alias("first_position"))


def path_references(entries: DataFrame, paths: DataFrame, path_chars: str = r"[\w./~-]") -> DataFrame:
    """path and entry_id where an entry's text names exactly that path.

    Texts are cut into runs of path characters, which meet the paths by an equal
    join; a final dot or comma of a sentence isn't part of a run.
    """
    plain = F.regexp_replace(F.regexp_replace("text", r"\\+", "/"), r"file://", " ")
    runs = entries.select("entry_id", F.explode(F.array_distinct(F.regexp_extract_all(plain, F.lit(f"({path_chars}+)"), F.lit(1)))).alias("_p"))
    trimmed = runs.select("entry_id", F.regexp_replace("_p", r"\.+$", "").alias("path")).distinct()
    return trimmed.join(paths.select(F.regexp_replace("path", r"\\+", "/").alias("path")).distinct(), "path")


def calculations(asked: DataFrame, facts: DataFrame) -> DataFrame:
    """asked (id, operation, left, right) with value, or the issue that stands against it.

    facts has id, base_value, dimension, period, year, grain, label, cell, condition
    and role. growth and change take one metric at two ordered periods (change also
    one cell under two conditions), ratio two facts of one period, upside a per-share
    result and a price, product a per-share amount and a multiple.
    """
    side = lambda p: facts.select(*[F.col(c).alias(f"{p}_{c}") for c in facts.columns])
    met = asked.join(side("l"), F.col("left") == F.col("l_id"), "left").join(side("r"), F.col("right") == F.col("r_id"), "left")
    c = F.col
    truth = lambda x: F.coalesce(x, F.lit(False))
    same = truth((c("l_dimension") == c("r_dimension")) & ~F.startswith("l_dimension", F.lit("unknown_")))
    share = truth(F.endswith("l_dimension", F.lit("/share")))
    moved = (c("operation") == "change") & c("l_cell").eqNullSafe(c("r_cell")) & c("l_period").eqNullSafe(c("r_period")) & ~c("l_condition").eqNullSafe(c("r_condition"))
    ordered = truth((c("l_grain") == c("r_grain")) & (c("l_year") < c("r_year")))
    comparable = same & c("l_label").eqNullSafe(c("r_label")) & (moved | ordered)
    step = c("operation").isin("growth", "change")
    issue = (
        F.when(c("l_id").isNull() | c("r_id").isNull(), "unknown input")
        .when(step & ~comparable, "not comparable")
        .when((c("operation") == "growth") & (c("l_base_value") <= 0), "base not positive")
        .when((c("operation") == "ratio") & ~(same & truth(c("l_period") == c("r_period")) & (c("r_base_value") != 0)), "not comparable")
        .when((c("operation") == "upside") & ~(same & share & (c("r_base_value") > 0) & truth(c("l_role").isin("target_price", "per_share_value")) & truth(c("r_role") == "current_price")), "not comparable")
        .when((c("operation") == "product") & ~(share & truth(c("r_dimension") == "multiple") & F.coalesce(c("l_period") == c("r_period"), F.lit(True))), "not comparable")
        .when(~c("operation").isin("growth", "change", "ratio", "upside", "product"), "unknown operation")
    )
    ratio = F.try_divide("l_base_value", "r_base_value")
    value = (
        F.when(c("operation") == "growth", F.try_divide("r_base_value", "l_base_value") - 1)
        .when(c("operation") == "change", c("r_base_value") - c("l_base_value"))
        .when(c("operation") == "ratio", ratio)
        .when(c("operation") == "upside", ratio - 1)
        .when(c("operation") == "product", c("l_base_value") * c("r_base_value"))
    )
    finite = ~F.isnan(value) & (F.abs(value) < float("inf"))
    out = met.withColumn("issue", F.coalesce(issue, F.when(~truth(finite), "not finite")))
    return out.select("id", "operation", F.when(c("issue").isNull(), value).alias("value"), "issue")


def complete_traces(traces: DataFrame, issues: DataFrame) -> DataFrame:
    """traces (trace_id, truncated) with complete: nothing cut off, and no issue (trace_id, code) but missing cached values."""
    bad = issues.filter("code IS NULL OR code <> 'formula_cache_unavailable'").select("trace_id").distinct().withColumn("_bad", F.lit(True))
    return traces.join(bad, "trace_id", "left").withColumn("complete", ~F.col("truncated") & F.col("_bad").isNull()).drop("_bad")


def in_budget(lines: DataFrame, key: list[str], order: str, text: str, most: int) -> DataFrame:
    """The first lines of each key that fit into most bytes with a line end each, and how many there are beside them.

    A line that doesn't fit ends the text.
    """
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.octet_length(F.coalesce(text, F.lit(""))) + 1
    total = lines.groupBy(*key).agg(F.count("*").alias("_all"))
    kept = lines.withColumn("_used", F.sum(size).over(w)).filter(F.col("_used") <= most)
    shown = kept.groupBy(*key).agg(F.count("*").alias("shown"), F.max("_used").alias("bytes"))
    return total.join(shown, key, "left").select(*key, F.coalesce("shown", F.lit(0)).alias("shown"), F.coalesce("bytes", F.lit(0)).alias("bytes"), (F.col("_all") - F.coalesce("shown", F.lit(0))).alias("left_out"))
