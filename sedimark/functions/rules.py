"""Dates, clocks, costs, scenarios and review rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Venue suffix, its zone and the minute of the day when it closes.
VENUES = (("HK", "Asia/Hong_Kong", 960), ("SH", "Asia/Shanghai", 900), ("SZ", "Asia/Shanghai", 900), ("O", "America/New_York", 960), ("N", "America/New_York", 960))


def venue_clock(code: Column, now_utc: Column) -> Column:
    """struct(day, weekday, minute, after_close) of a code's venue; null for an unknown suffix."""
    suffix, zone, close = F.upper(F.substring_index(code, ".", -1)), F.lit(None).cast("string"), F.lit(None).cast("int")
    for name, place, minute in VENUES:
        zone, close = F.when(suffix == name, place).otherwise(zone), F.when(suffix == name, minute).otherwise(close)
    local = F.from_utc_timestamp(now_utc, zone)
    minute = F.hour(local) * 60 + F.minute(local)
    weekday = ~F.dayofweek(local).isin(1, 7)
    return F.when(zone.isNotNull(), F.struct(F.to_date(local).alias("day"), weekday.alias("weekday"), minute.alias("minute"), (weekday & (minute >= close)).alias("after_close")))


def report_week(at_utc: Column, zone: str = "Europe/Berlin") -> Column:
    """The Monday of a moment's week in the report's zone."""
    return F.to_date(F.date_trunc("week", F.from_utc_timestamp(at_utc, zone)))


def tiered_cost(tokens: Column, base: Column, tiers: Column) -> Column:
    """Cost of tokens at the rate of the highest tier (above, rate; a million tokens) that they exceed, else at base."""
    over = F.filter(tiers, lambda t: tokens > t["above"])
    rate = F.when(F.size(over) > 0, F.array_max(over)["rate"]).otherwise(base)
    return tokens * rate / 1e6


def scenario(operation: str, values: Column) -> Column:
    """sum, product, ratio or compound of an array; null where the result isn't finite or a value is missing."""
    if operation == "sum":
        out = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    elif operation == "product":
        out = F.aggregate(values, F.lit(1.0), lambda a, x: a * x)
    elif operation == "ratio":
        out = F.when(F.size(values) == 2, F.try_divide(values[0], values[1]))
    elif operation == "compound":
        out = F.when(F.size(values) == 3, values[0] * F.pow(1 + values[1], values[2]))
    else:
        raise ValueError(operation)
    return F.when(~F.isnan(out) & (F.abs(out) < float("inf")), out)


def importance(title: Column, high: list[str], low: list[str]) -> Column:
    """high, low or normal by patterns; high goes first."""
    return F.when(title.rlike("(?i)" + "|".join(high)), "high").when(title.rlike("(?i)" + "|".join(low)), "low").otherwise("normal")


def published_date(labelled: Column, metadata: Column, model: Column, filename: Column, ingested: Column) -> Column:
    """struct(date, source): the first plausible of four dates, from 2000 to a day after ingestion."""
    good = lambda d: F.when((d >= F.lit("2000-01-01").cast("date")) & (d <= F.date_add(ingested, 1)), d)
    named = [(good(labelled), "labelled"), (good(metadata), "metadata"), (good(model), "model"), (good(filename), "filename")]
    return F.coalesce(*[F.when(d.isNotNull(), F.struct(d.alias("date"), F.lit(n).alias("source"))) for d, n in named])


def dates_in(text: Column) -> Column:
    """The valid dates that a text writes as 2026-01-31, 2026/1/31 or 2026年1月31日."""
    found = F.regexp_extract_all(text, F.lit(r"((?:19|20)\d{2}\s*[-/.年]\s*\d{1,2}\s*[-/.月]\s*\d{1,2})(?!\d)"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.try_to_date(F.regexp_replace(F.regexp_replace(x, r"\s+", ""), r"[/.年月]", "-"), "yyyy-M-d")), lambda d: d.isNotNull()))


def review_action(variance: Column, tolerance: Column, has_evidence: Column, errors: Column) -> Column:
    """What a review of an assumption comes to: blocked, hold, keep or revise."""
    return F.when(errors > 0, "blocked").when(variance.isNull() | ~has_evidence, "hold").when(F.abs(variance) <= tolerance, "keep").otherwise("revise")


def byte_budget(lines: DataFrame, keys: list[str], order: str, text: str, most: int) -> DataFrame:
    """The first lines of each key that fit into most bytes, a line end included, and whether more follow."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(order)
    used = F.sum(F.octet_length(text) + 1).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = lines.withColumns({"_used": used, "_next": F.lead(F.octet_length(text) + 1).over(w)})
    fits = rows.filter(F.col("_used") <= most)
    return fits.withColumn("truncated", F.coalesce(F.col("_used") + F.col("_next") > most, F.lit(False))).drop("_used", "_next")


def canonical_json(value: Column) -> Column:
    """A map as JSON with its keys in order, so equal inputs give equal text."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(value))))
