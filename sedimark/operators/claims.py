"""Consensus statistics, votes and revision chains over claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of each group of keys, the one with the largest order; ties need order to be total."""
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_best"))
    return best.select(*keys, "_best.*").select(*rows.columns)


def majority(rows: DataFrame, group: list[str], vote: list[str]) -> DataFrame:
    """The most frequent combination of vote in each group; ties go to the largest combination."""
    counted = rows.groupBy(*group, *vote).agg(F.count("*").alias("_n"))
    return counted.groupBy(*group).agg(F.max(F.struct("_n", *vote)).alias("_top")).select(*group, *[F.col(f"_top.{v}").alias(v) for v in vote], F.col("_top._n").alias("votes"))


def robust_stats(rows: DataFrame, group: list[str], value: str, absolute: dict[str, float] | None = None, unit: str | None = None, relative: float = 0.15) -> DataFrame:
    """n, median, mean, low, high, quartiles, iqr, mad, spread and divergent of each group.

    Quartiles are exact with linear interpolation. spread is high - low for units
    named in absolute, with that unit's limit, and else relative to |median| (1 if
    that is 0 and the values differ) with the limit relative; a spread above the
    limit is divergent. Rows of a group share one unit.
    """
    v = F.col(value)
    base = rows.groupBy(*group).agg(
        F.count(v).alias("n"), F.expr(f"percentile({value}, array(0.25D, 0.5D, 0.75D))").alias("_q"), F.avg(v).alias("mean"), F.min(v).alias("low"), F.max(v).alias("high"),
        *([F.max(unit).alias("_unit")] if unit else []),
    )
    base = base.withColumns({"q1": F.col("_q")[0], "median": F.col("_q")[1], "q3": F.col("_q")[2]}).drop("_q")
    joined = rows.select(*group, v.alias("_v")).join(base.select(*group, "median"), group)
    mad = joined.groupBy(*group).agg(F.expr("percentile(abs(_v - median), 0.5D)").alias("mad"))
    width = F.col("high") - F.col("low")
    ratio = F.when(F.col("median") != 0, F.try_divide(width, F.abs("median"))).otherwise(F.when(width != 0, 1.0).otherwise(0.0))
    spread, limit = ratio, F.lit(relative)
    for name, most in (absolute or {}).items():
        spread, limit = F.when(F.col("_unit") == name, width).otherwise(spread), F.when(F.col("_unit") == name, F.lit(most)).otherwise(limit)
    out = base.join(mad, group).withColumns({"iqr": F.col("q3") - F.col("q1"), "spread": spread}).withColumn("divergent", F.col("spread") > limit)
    return out.drop("_unit")


def consensus(claims: DataFrame, group: list[str], issuer: str, value: str, order: list[str], vote: list[str]) -> DataFrame:
    """Robust statistics of each group over one vote an issuer.

    The latest claim of each issuer counts; claims that differ from the group's
    majority combination of vote aren't comparable and are counted in excluded.
    """
    sample = latest_per_key(claims.select(*group, issuer, value, *vote, *[o for o in order if o not in (*group, issuer, value, *vote)]), [*group, issuer], order)
    top = majority(sample, group, vote)
    renamed = top.select(*group, *[F.col(v).alias(f"_{v}") for v in vote])
    marked = sample.join(renamed, group).withColumn("_same", F.forall(F.array(*[F.col(v).eqNullSafe(F.col(f"_{v}")) for v in vote]), lambda x: x))
    counts = marked.groupBy(*group).agg(F.count("*").alias("sample_size"), F.count_if(~F.col("_same")).alias("excluded"))
    return robust_stats(marked.filter("_same").select(*group, value), group, value).join(counts, group)


def stance_counts(rows: DataFrame, group: list[str], stance: Column) -> DataFrame:
    """bullish, bearish and neutral rows of each group and their shares; other stances are neutral."""
    known = F.when(stance.isin("bullish", "bearish"), stance).otherwise("neutral")
    out = rows.withColumn("_s", known).groupBy(*group).agg(*[F.count_if(F.col("_s") == s).alias(s) for s in ("bullish", "bearish", "neutral")])
    total = F.col("bullish") + F.col("bearish") + F.col("neutral")
    return out.withColumns({f"{s}_share": F.try_divide(F.col(s), total) for s in ("bullish", "bearish", "neutral")})


def mode_with_share(rows: DataFrame, group: list[str], value: str, share: float = 0.6, support: int | None = None) -> DataFrame:
    """The winning value of each group, with status agreed, conflict or insufficient.

    A winner needs a unique largest count and the share of the group, or support
    rows where support is given; a group of one row is insufficient.
    """
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_n"))
    places = Window.partitionBy(*group).orderBy(F.desc("_n"), value)
    whole = Window.partitionBy(*group)
    ranked = counted.withColumns({"_total": F.sum("_n").over(whole), "_r": F.row_number().over(places), "_next": F.lead("_n").over(places)}).filter("_r = 1")
    unique = F.col("_next").isNull() | (F.col("_n") > F.col("_next"))
    enough = (F.col("_n") / F.col("_total")) >= share
    if support is not None:
        enough = enough | (F.col("_n") >= support)
    status = F.when(F.col("_total") < 2, "insufficient").when(unique & enough, "agreed").otherwise("conflict")
    return ranked.withColumn("status", status).select(*group, F.when(F.col("status") == "agreed", F.col(value)).alias("winner"), F.col("_n").alias("support"), F.col("_total").alias("total"), "status")


def revision_chain(claims: DataFrame, series: list[str], source: str, value: str, stance: str, order: list[str], comparable: list[str], tolerance: float = 1e-9) -> DataFrame:
    """claims with prior_id, direction and delta against the latest earlier claim of another source.

    claims has claim_id. A claim's prior has the same series and comparable
    columns; null is a source like any other. Within such a group rows are folded in order; the last claim and the
    last one of a different source are all that has to be kept.
    """
    key = [F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias(f"k_{i}") for i, c in enumerate([*series, *comparable])]
    names = [f"k_{i}" for i in range(len(key))]
    rows = claims.select("*", *key)
    item = F.struct(*order, F.col("claim_id").alias("_id"), F.col(source).alias("_source"), F.col(value).alias("_value"), F.col(stance).alias("_stance"))
    # The last row of another source is the last row before the run of rows that share this row's source.
    w = Window.partitionBy(*names).orderBy(*order, "claim_id")
    rows = rows.withColumn("_item", item).withColumn("_new_run", F.when(F.lag("_item").over(w).isNull(), 1).otherwise((~F.lag(source).over(w).eqNullSafe(F.col(source))).cast("int")))
    rows = rows.withColumn("_run", F.sum("_new_run").over(w)).withColumn("_before", F.lag("_item").over(w))
    inside = Window.partitionBy(*names, "_run").orderBy(*order, "claim_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_prior", F.first("_before").over(inside))
    delta = F.col(value) - F.col("_prior._value")
    both = F.col(value).isNotNull() & F.col("_prior._value").isNotNull()
    direction = (
        F.when(F.col("_prior").isNull(), "new")
        .when(both & (F.abs(delta) < tolerance), "unchanged")
        .when(both & (delta > 0), "up")
        .when(both, "down")
        .when(F.col(stance).eqNullSafe(F.col("_prior._stance")), "unchanged")
        .otherwise("changed")
    )
    out = rows.withColumns({"prior_id": F.col("_prior._id"), "direction": direction, "delta": F.when(both, F.when(F.abs(delta) < tolerance, 0.0).otherwise(delta))})
    return out.select(*claims.columns, "prior_id", "direction", "delta")


def card_type(issuers: Column, comparable: Column, divergent: Column, bullish: Column, bearish: Column, neutral: Column) -> Column:
    """single_view, consensus or divergence, by numbers where there are two and else by stances."""
    total = bullish + bearish + neutral
    return (
        F.when(issuers < 2, "single_view")
        .when(comparable >= 2, F.when(divergent, "divergence").otherwise("consensus"))
        .when((bullish > 0) & (bearish > 0), "divergence")
        .when(F.greatest(bullish, bearish, neutral) >= total * 0.75, "consensus")
        .otherwise("divergence")
    )
