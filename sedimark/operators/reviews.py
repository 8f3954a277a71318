"""Reviews of changes: dependencies, evidence of facts, driver sensitivity, card lists and session estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The section that an assessment is in, and the sections that it depends on.
ASSESSMENT, ASSESSED = "currentAssessment", ("investmentJudgments", "businessModel", "valuation", "monitoring")
#: Review tasks by the first pattern that a reason has.
REVIEW_TASKS = (("币种与单位", "币种|记账|换汇|单位"), ("期间与统计口径", "报告期|期间|单期|单季|累计|年化"), ("财务与业务定义", "(?i)口径|定义|归母|分部|IFRS|EBIT|调整后|一次性"), ("实际或预测", "角色|实际或预测|数据类型"))
OTHER_TASK = "未取得的数据与其他问题"


def change_dependencies(changes: DataFrame, review: list[str]) -> DataFrame:
    """change_id and depends_on (group ids in order) of each change of a review that has any.

    changes has group_id, section and judgment_ids. A change depends on another
    group that shares a judgment, and an assessment and the sections it rests on
    depend on each other. Both are equal joins, on judgments and on sections.
    """
    base = changes.select(*review, "change_id", "group_id", "section", "judgment_ids")
    by_id = base.select(*review, F.explode(F.array_distinct("judgment_ids")).alias("_id"), "change_id", "group_id")
    shared = by_id.join(by_id.select(*review, "_id", F.col("group_id").alias("other")).distinct(), [*review, "_id"])
    side = F.when(F.col("section") == ASSESSMENT, "a").when(F.col("section").isin(*ASSESSED), "b")
    sided = base.withColumn("_side", side).filter("_side IS NOT NULL")
    other_side = sided.select(*review, F.when(F.col("_side") == "a", "b").otherwise("a").alias("_side"), F.col("group_id").alias("other")).distinct()
    across = sided.join(other_side, [*review, "_side"])
    pairs = shared.select(*review, "change_id", "group_id", "other").unionByName(across.select(*review, "change_id", "group_id", "other")).filter("group_id <> other")
    return pairs.groupBy(*review, "change_id").agg(F.array_sort(F.collect_set("other")).alias("depends_on"))


def observed_facts(facts: DataFrame, observations: DataFrame) -> DataFrame:
    """fact_id and observation_id where all seven columns agree and one of the observation's passages holds the fact's line.

    Both have doc_id, metric, value, period, unit, scope and quote; nulls agree with
    nulls. observations has evidence, an array of (doc_id, line_start, line_end).
    """
    keys = ["doc_id", "metric", "value", "period", "unit", "scope", "quote"]
    spans = observations.select("observation_id", *[F.col(k).alias(f"_{k}") for k in keys], F.explode("evidence").alias("e")).filter("e.doc_id = _doc_id")
    same = F.col("line").between(F.col("e.line_start"), F.col("e.line_end"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return facts.join(spans, same).select("fact_id", "observation_id").distinct()


def review_task(reason: Column) -> Column:
    """The task that a reason belongs to: the first whose pattern it has."""
    task = F.when(reason.isNull(), None)
    for title, pattern in REVIEW_TASKS:
        task = task.when(reason.rlike(pattern), title)
    return task.otherwise(OTHER_TASK)


def period_class(text: Column) -> Column:
    """historical, forecast or unknown by a period's ending or words."""
    low = F.lower(F.trim(text))
    past = low.rlike(r"^(fy\s*)?\d{2,4}\s*a$") | low.rlike("actual|historical|reported|历史|实际|已披露")
    coming = low.rlike(r"^(fy\s*)?\d{2,4}\s*[ef]$") | low.rlike("estimate|forecast|budget|预测|预计|预算")
    return F.when(past, "historical").when(coming, "forecast").otherwise("unknown")


def same_year(left: Column, right: Column) -> Column:
    """Whether two periods are written alike or name the same full year."""
    bare = lambda c: F.lower(F.regexp_replace(c, r"\s", ""))
    year = lambda c: F.nullif(F.regexp_extract(bare(c), r"^(?:截至)?(20\d{2})(?:e|年|年度|年全年|年12月31日止年度)?$", 1), F.lit(""))
    return F.coalesce(bare(left) == bare(right), F.lit(False)) | F.coalesce(year(left) == year(right), F.lit(False))


def sensitivity(runs: DataFrame, model: list[str], shock_percent: float = 5.0) -> DataFrame:
    """Output changes, elasticities, active_driver and rank of each driver of a model, from recalculated outputs.

    runs has driver_id, baseline_output, down_output and up_output, the outputs
    with the input shock_percent lower and higher. Percentages are null where the
    baseline is 0. Ranks follow the largest change in percent (or, without one, the
    largest change), then driver_id.
    """
    base, percent = F.col("baseline_output"), lambda c: F.try_divide(F.col(c) - base, F.abs(base)) * 100
    out = runs.withColumns({"down_change": F.col("down_output") - base, "up_change": F.col("up_output") - base, "down_percent": percent("down_output"), "up_percent": percent("up_output")})
    largest = F.greatest(F.abs("down_change"), F.abs("up_change"))
    largest_percent = F.when(F.col("down_percent").isNotNull() & F.col("up_percent").isNotNull(), F.greatest(F.abs("down_percent"), F.abs("up_percent")))
    out = out.withColumns({"down_elasticity": F.col("down_percent") / -shock_percent, "up_elasticity": F.col("up_percent") / shock_percent, "max_change": largest, "max_percent": largest_percent})
    active = F.col("max_change") > F.greatest(F.lit(1e-9), F.abs(base) * 1e-9)
    order = Window.partitionBy(*model).orderBy(F.coalesce("max_percent", "max_change").desc(), "driver_id")
    return out.withColumns({"active_driver": active, "rank": F.row_number().over(order)})


def listed_cards(cards: DataFrame, types: list[str] | None = None, item: str | None = None, limit: int = 100) -> DataFrame:
    """The first cards by priority, item and period, of the wanted types and item, with total, the number of all of them."""
    wanted = cards if types is None else cards.filter(F.col("card_type").isin(types))
    wanted = wanted if item is None else wanted.filter(F.col("item") == item)
    total = wanted.agg(F.count("*").alias("total"))
    return wanted.orderBy(F.desc("priority"), "item", "period").limit(limit).join(F.broadcast(total))  # one row


def stale(snapshots: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """snapshots with stale: whether the key's fingerprint is another one now, or gone."""
    now = current.select(*keys, F.col("fingerprint").alias("_now"))
    return snapshots.join(now, keys, "left").withColumn("stale", ~F.col("fingerprint").eqNullSafe(F.col("_now"))).drop("_now")


def context_tokens(messages: DataFrame, session: list[str], order: str) -> DataFrame:
    """tokens, usage_tokens and trailing_tokens of each session: the last reported usage (null: none) and estimates after it."""
    last = messages.groupBy(*session).agg(F.max(F.when(F.col("usage").isNotNull(), F.col(order))).alias("_at"), F.max_by("usage", F.when(F.col("usage").isNotNull(), F.col(order))).alias("usage_tokens"))
    after = F.col("_at").isNull() | (F.col(order) > F.col("_at"))
    out = messages.join(last, session).groupBy(*session).agg(F.coalesce(F.first("usage_tokens"), F.lit(0)).alias("usage_tokens"), F.coalesce(F.sum(F.when(after, F.col("estimate"))), F.lit(0)).alias("trailing_tokens"))
    return out.withColumn("tokens", F.col("usage_tokens") + F.col("trailing_tokens"))


def recent_projects(sessions: DataFrame) -> DataFrame:
    """project, last_used and running, unread: a row for each project of the sessions (project, modified, running, unread), latest first."""
    counts = sessions.groupBy("project").agg(F.max("modified").alias("last_used"), F.count_if("running").alias("running"), F.count_if("unread").alias("unread"))
    return counts.orderBy(F.desc("last_used"), "project")


def with_parents(sessions: DataFrame) -> DataFrame:
    """sessions (session_id, path, parent_path) with parent_id, the id of the session at the parent's path.

    Of several sessions at one path the least id counts.
    """
    at = sessions.filter("path IS NOT NULL").groupBy(F.col("path").alias("parent_path")).agg(F.min("session_id").alias("parent_id"))
    return sessions.join(at, "parent_path", "left")


def display_number(value: Column, digits: int = 1) -> Column:
    """With thousands commas; whole numbers and those from 1000 on without decimals, others without zeros at the end."""
    whole = (value == F.floor(value)) | (F.abs(value) >= 1000)
    return F.when(whole, F.format_number(F.bround(value, 0), 0)).otherwise(F.regexp_replace(F.format_number(value, digits), r"\.?0+$", ""))


def display_amount(value: Column, currency: Column) -> Column:
    """An amount in units of its currency, in 亿 and 万 for CNY (or none) and in bn and mn for others."""
    size, home = F.abs(value), F.coalesce(currency, F.lit("")).isin("", "CNY")
    local = F.when(size >= 1e8, F.concat(display_number(value / 1e8), F.lit(" 亿元"))).when(size >= 1e4, F.concat(display_number(value / 1e4), F.lit(" 万元"))).otherwise(F.concat(display_number(value, 2), F.lit(" 元")))
    scale, word = F.when(size >= 1e9, 1e9).when(size >= 1e6, 1e6).otherwise(1.0), F.when(size >= 1e9, "bn").when(size >= 1e6, "mn").otherwise("")
    return F.when(home, local).otherwise(F.concat(currency, F.lit(" "), display_number(value / scale, 2), word))


def session_fold(entries: DataFrame, session: list[str], order: str) -> DataFrame:
    """first_at, last_at, most_tokens, compaction_tokens (at the first compaction), messages and compactions of each session.

    entries has at, kind (message, compaction or anything) and tokens. All of it is
    one aggregation, combined before the shuffle.
    """
    compaction = F.col("kind") == "compaction"
    return entries.groupBy(*session).agg(
        F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.max("tokens").alias("most_tokens"),
        F.min_by("tokens", F.when(compaction, F.col(order))).alias("compaction_tokens"), F.count_if(F.col("kind") == "message").alias("messages"), F.count_if(compaction).alias("compactions"),
    )


def worst(rows: DataFrame, ratio: str, size: str, name: str, limit: int) -> DataFrame:
    """The rows of the largest ratios (none counts as infinite), then of the largest sizes, then by name."""
    return rows.orderBy(F.desc_nulls_first(ratio), F.desc(size), name).limit(limit)
