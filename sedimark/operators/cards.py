"""Consensus cards over normalised claims, and votes on a document's cover."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from sedimark.functions.rules import dates_in
from sedimark.operators.claims import card_type, latest_per_key, majority, robust_stats, stance_counts

ABSOLUTE = {"%": 3.0, "pp": 2.0}


def build_cards(claims: DataFrame, as_of: str) -> DataFrame:
    """A card for each item, period and measure, by priority.

    claims has claim_id, issuer, issuer_kind, item, period, measure, value, unit,
    currency, scope, stance, as_of and created_at, verified ones only. Claims after
    as_of are left out (without a date they count as old), company claims don't
    vote, and each other issuer's latest claim does. Numbers are compared within
    the majority's unit, currency and scope.
    """
    key = ["item", "period", "measure"]
    seen = claims.filter(F.coalesce(F.try_to_date("as_of", "yyyy-MM-dd"), F.lit("0001-01-01").cast("date")) <= F.lit(as_of).cast("date"))
    rows = seen.withColumns({k: F.when(F.col("value").isNotNull(), F.coalesce(k, F.lit(""))).otherwise("") for k in ("period", "measure")})
    rows = rows.withColumns({"scope": F.trim(F.coalesce("scope", F.lit(""))), "currency": F.coalesce("currency", F.lit("")), "unit": F.coalesce("unit", F.lit("")), "as_of": F.coalesce("as_of", F.lit(""))})
    sample = latest_per_key(rows.filter("issuer_kind <> 'company'"), [*key, "issuer"], ["as_of", "created_at", "claim_id"])
    numeric = sample.filter("value IS NOT NULL")
    top = majority(numeric, key, ["unit", "currency", "scope"]).drop("votes")
    comparable = numeric.join(top, [*key, "unit", "currency", "scope"])
    numbers = robust_stats(comparable.select(*key, "value", "unit"), key, "value", ABSOLUTE, "unit").withColumnRenamed("n", "comparable")
    company = latest_per_key(rows.filter("issuer_kind = 'company'"), key, ["as_of", "created_at", "claim_id"]).select(*key, F.col("value").alias("company_value"))
    joined = stance_counts(sample, key, F.col("stance")).join(numbers, key, "left").join(company, key, "left")
    size = F.col("bullish") + F.col("bearish") + F.col("neutral")
    issuers = F.when(F.coalesce("comparable", F.lit(0)) > 0, F.col("comparable")).otherwise(size)
    kind = card_type(issuers, F.coalesce("comparable", F.lit(0)), F.coalesce("divergent", F.lit(False)), F.col("bullish"), F.col("bearish"), F.col("neutral"))
    weight = F.coalesce("spread", F.when((F.col("bullish") > 0) & (F.col("bearish") > 0), 1.0).otherwise(0.0))
    out = joined.withColumns({"sample_size": size, "issuer_count": issuers, "card_type": kind, "priority": F.bround(size * (1 + F.least(weight, F.lit(2.0))), 3)})
    return out.orderBy(F.desc("priority"), *key)


def cover_dates(covers: DataFrame) -> DataFrame:
    """The date of each cover (doc_id, text) by vote: beside a label it counts 3, beside a price snapshot 0.25, else 1.

    Ties go to the date that comes first.
    """
    lines = covers.select("doc_id", F.posexplode(F.split("text", r"\n")).alias("line", "t"))
    weight = F.when(F.col("t").rlike(r"(?i)报告日期|发布日期|published|report date"), 3.0).when(F.col("t").rlike(r"(?i)收盘|股价|closing price|as of"), 0.25).otherwise(1.0)
    votes = lines.select("doc_id", "line", weight.alias("w"), F.explode(dates_in(F.col("t"))).alias("date"))
    summed = votes.groupBy("doc_id", "date").agg(F.sum("w").alias("votes"), F.min("line").alias("first"))
    place = Window.partitionBy("doc_id").orderBy(F.desc("votes"), "first", "date")
    return summed.withColumn("_r", F.row_number().over(place)).filter("_r = 1").select("doc_id", "date", "votes")


def not_mentioned(eligible: DataFrame, observed: DataFrame, keys: list[str], most_issuers: int = 10_000) -> DataFrame:
    """Of a collection's issuers (issuer), those without a claim on each item.

    The issuers are a dimension that every item is compared with; more than most_issuers
    of them are refused.
    """
    names = [r[0] for r in eligible.select("issuer").filter("issuer IS NOT NULL").distinct().limit(most_issuers + 1).collect()]
    if len(names) > most_issuers:
        raise ValueError(f"more than {most_issuers} issuers")
    every = F.from_json(F.lit(json.dumps(names)), ArrayType(eligible.schema["issuer"].dataType))
    listed = F.broadcast(eligible.select("issuer").distinct().withColumn("_listed", F.lit(True)))  # most_issuers at most
    seen = observed.join(listed, "issuer", "left").groupBy(*keys).agg(F.collect_set(F.when(F.col("_listed"), F.col("issuer"))).alias("_seen"))
    return seen.select(*keys, F.explode(F.array_except(every, "_seen")).alias("issuer"))
