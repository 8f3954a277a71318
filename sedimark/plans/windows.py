"""Ordered queries: gaps, states, paths, as-of joins and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedimark.operators import claims, sessions, tracking
from sedimark.plans.registry import register
from sedimark.plans.tables import load, rounded


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


@register(
    "active_time",
    """SELECT user_id, CAST(sum(CASE WHEN event_type NOT IN ('signup', 'purchase') AND gap > 0 THEN gap ELSE 0 END) AS BIGINT) AS active
       FROM (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id) AS gap FROM events WHERE ts IS NOT NULL) GROUP BY 1""",
)
def active_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.active_time(_events(spark, sf_dir), ["user_id"], ["event_id"], "us", F.col("event_type").isin("signup", "purchase"))


@register(
    "cache_waste",
    """WITH t AS (SELECT user_id, event_id, event_type = 'error' AS reset, CAST(round(value * 100) AS BIGINT) AS prompt, CASE WHEN event_type = 'click' THEN CAST(round(value * 40) AS BIGINT) ELSE 0 END AS cache_read,
                    CASE WHEN event_type = 'view' THEN 7 ELSE 0 END AS cache_write FROM events),
       s AS (SELECT *, sum(CASE WHEN reset THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS stretch FROM t),
       p AS (SELECT *, last_value(CASE WHEN NOT reset AND prompt > 0 THEN prompt END IGNORE NULLS) OVER w AS previous, coalesce(bool_or(NOT reset AND prompt > 0 AND cache_read + cache_write > 0) OVER w, false) AS reported
             FROM s WINDOW w AS (PARTITION BY user_id, stretch ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
       SELECT user_id, count(*) AS misses, CAST(sum(least(previous, prompt) - cache_read) AS BIGINT) AS missed FROM p
       WHERE NOT reset AND prompt > 0 AND previous IS NOT NULL AND (cache_read + cache_write > 0 OR reported) AND least(previous, prompt) - cache_read > 1024 GROUP BY 1""",
)
def cache_waste(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = lambda k: F.round(F.col("value") * k).cast("long")
    turns = load(spark, sf_dir, "events").select(
        "user_id", "event_id", (F.col("event_type") == "error").alias("reset"), whole(100).alias("prompt"),
        F.when(F.col("event_type") == "click", whole(40)).otherwise(0).alias("cache_read"), F.when(F.col("event_type") == "view", 7).otherwise(0).alias("cache_write"),
    )
    return sessions.cache_waste(turns, ["user_id"], ["event_id"]).filter("missed > 0").groupBy("user_id").agg(F.count("*").alias("misses"), F.sum("missed").alias("missed"))


@register(
    "cut_point",
    """WITH m AS (SELECT conv_id, turn, role, CAST(ceil(length(coalesce(text, '')) / 4) AS BIGINT) AS tokens FROM conversations),
       s AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS total FROM m),
       a AS (SELECT conv_id, max(turn) AS pos FROM s WHERE total >= 120 GROUP BY 1)
       SELECT conv_id, min(turn) AS first_kept FROM s JOIN a USING (conv_id) WHERE role <> 'system' AND turn >= pos GROUP BY 1""",
)
def cut_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.ceil(F.length(F.coalesce("text", F.lit(""))) / 4).alias("tokens"))
    return sessions.cut_point(turns, ["conv_id"], "turn", "tokens", F.col("role") != "system", 120)


@register(
    "compacted_context",
    """WITH p AS (SELECT conv_id, turn, CASE WHEN turn = 4 THEN 'compaction' ELSE 'message' END AS type, 3 AS first_kept FROM conversations),
       c AS (SELECT *, max(CASE WHEN type = 'compaction' THEN turn END) OVER (PARTITION BY conv_id) AS pos FROM p)
       SELECT conv_id, turn, type, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN turn = pos THEN 0 ELSE 1 END, turn) AS position FROM c
       WHERE pos IS NULL OR turn = pos OR (type <> 'compaction' AND turn >= first_kept)""",
)
def compacted_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") == 4, "compaction").otherwise("message").alias("type"), F.lit(3).cast("long").alias("first_kept"))
    return sessions.compacted_context(path, ["conv_id"], "turn").select("conv_id", "turn", "type", F.col("position").cast("long").alias("position"))


@register(
    "stop_bounded_branch",
    """WITH b AS (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS pos FROM conversations) SELECT conv_id, turn, role FROM b WHERE pos IS NULL OR turn >= pos""",
)
def stop_bounded_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return sessions.stop_bounded(turns, ["conv_id"], "turn", F.col("role") == "user")


@register(
    "last_settings",
    """SELECT user_id, event_id, last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS setting FROM events""",
)
def last_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return load(spark, sf_dir, "events").select("user_id", "event_id", F.last(F.when(F.col("event_type") == "signup", F.col("value")), ignorenulls=True).over(w).alias("setting"))


@register(
    "islands",
    """WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS island FROM events)
       SELECT user_id, event_type, min(event_id) AS first_id, max(event_id) AS last_id, count(*) AS n FROM r GROUP BY user_id, event_type, island HAVING count(*) >= 3""",
)
def islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of rows of one kind."""
    every, kind = Window.partitionBy("user_id").orderBy("event_id"), Window.partitionBy("user_id", "event_type").orderBy("event_id")
    rows = load(spark, sf_dir, "events").withColumn("island", F.row_number().over(every) - F.row_number().over(kind))
    return rows.groupBy("user_id", "event_type", "island").agg(F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.count("*").alias("n")).filter("n >= 3").drop("island")


@register(
    "top_per_group",
    """SELECT p_brand, p_partkey, r AS place FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r <= 3""",
)
def top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return load(spark, sf_dir, "part").select("p_brand", "p_partkey", F.row_number().over(w).cast("long").alias("place")).filter("place <= 3")


@register(
    "key_suffixes",
    """SELECT p_partkey, CASE WHEN r = 1 THEN p_brand ELSE p_brand || '-' || r END AS key FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part)""",
)
def key_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    return load(spark, sf_dir, "part").withColumn("r", r).select("p_partkey", F.when(F.col("r") == 1, F.col("p_brand")).otherwise(F.concat_ws("-", "p_brand", F.col("r").cast("string"))).alias("key"))


@register(
    "revision_chain",
    """WITH c AS (SELECT l_partkey AS item, l_suppkey AS source, l_returnflag AS unit, l_extendedprice AS v, l_shipdate AS day, l_orderkey * 10 + l_linenumber AS claim_id FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS dup FROM lineitem) WHERE dup = 1),
       f AS (SELECT *, CASE WHEN source IS DISTINCT FROM lag(source) OVER w THEN 1 ELSE 0 END AS new_run, lag(claim_id) OVER w AS before_id, lag(v) OVER w AS before_v FROM c WINDOW w AS (PARTITION BY item, unit ORDER BY day, claim_id)),
       g AS (SELECT *, sum(new_run) OVER (PARTITION BY item, unit ORDER BY day, claim_id) AS run FROM f),
       p AS (SELECT *, first_value(before_id) OVER w AS prior_id, first_value(before_v) OVER w AS prior_v FROM g WINDOW w AS (PARTITION BY item, unit, run ORDER BY day, claim_id))
       SELECT claim_id, prior_id, CASE WHEN prior_id IS NULL THEN 'new' WHEN abs(v - prior_v) < 1e-9 THEN 'unchanged' WHEN v > prior_v THEN 'up' ELSE 'down' END AS direction, round(CASE WHEN abs(v - prior_v) < 1e-9 THEN 0 ELSE v - prior_v END, 4) AS delta FROM p""",
)
def revision_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each claim against the latest earlier one of another source."""
    lines = load(spark, sf_dir, "lineitem").withColumn("claim_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    first = lines.groupBy("claim_id").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_returnflag")).alias("f")).select("claim_id", "f.*").withColumn("stance", F.lit(None).cast("string"))
    out = claims.revision_chain(first, ["l_partkey"], "l_suppkey", "l_extendedprice", "stance", ["l_shipdate"], ["l_returnflag"])
    return out.select("claim_id", "prior_id", "direction", F.round("delta", 4).alias("delta"))


_VALUATIONS = """SELECT l_partkey AS part, l_shipdate AS effective_date, l_orderkey * 10 + l_linenumber AS seq, l_extendedprice * 0.9 AS bear, l_extendedprice AS base, l_extendedprice * 1.2 AS bull FROM lineitem WHERE l_returnflag = 'R'"""


@register(
    "as_of_valuation",
    f"""WITH b AS (SELECT row_number() OVER () AS bar, l_partkey AS part, l_shipdate AS bar_date, l_extendedprice AS close FROM lineitem WHERE l_returnflag <> 'R'), v AS ({_VALUATIONS}),
       j AS (SELECT b.*, v.seq, v.base, v.bear, v.bull, row_number() OVER (PARTITION BY b.bar ORDER BY v.effective_date DESC NULLS LAST, v.seq DESC) AS r
             FROM b LEFT JOIN v ON v.part = b.part AND v.effective_date <= b.bar_date AND v.effective_date + INTERVAL 365 DAY >= b.bar_date)
       SELECT part, strftime(bar_date, '%Y-%m-%d') AS bar_date, close, seq AS valuation_seq, round(base / close * 100 - 100, 4) AS upside, round(bear / close * 100 - 100, 4) AS downside,
              round(CASE WHEN bear < close AND close < bull THEN (bull - close) / (close - bear) END, 4) AS reward_risk FROM j WHERE r = 1""",
)
def as_of_valuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem")
    bars = lines.filter("l_returnflag <> 'R'").select(F.col("l_partkey").alias("part"), F.col("l_shipdate").alias("bar_date"), F.col("l_extendedprice").alias("close"))
    price = F.col("l_extendedprice")
    values = lines.filter("l_returnflag = 'R'").select(
        F.col("l_partkey").alias("part"), F.col("l_shipdate").alias("effective_date"), F.col("l_shipdate").alias("effective_at"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        (F.col("l_shipdate") + F.expr("INTERVAL 365 DAYS")).alias("target_date"), (price * 0.9).alias("bear"), price.alias("base"), (price * 1.2).alias("bull"),
    )
    out = tracking.as_of_valuation(bars, values, "part").withColumn("bar_date", F.date_format("bar_date", "yyyy-MM-dd"))
    return rounded(out, 4, "upside", "downside", "reward_risk")


@register(
    "position_ledger",
    """WITH RECURSIVE l AS (SELECT l_partkey, l_shipdate, l_orderkey, l_linenumber, l_returnflag = 'R' AS sale, l_quantity AS quantity, l_extendedprice / l_quantity AS price, l_tax AS fee FROM lineitem),
       t AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, NOT sale, quantity, price, fee) AS r FROM l),
       p AS (SELECT DISTINCT l_partkey, CAST(0 AS BIGINT) AS r, CAST(0 AS DOUBLE) AS qty, CAST(0 AS DOUBLE) AS cost, CAST(0 AS DOUBLE) AS invested, CAST(0 AS DOUBLE) AS realized, CAST(NULL AS VARCHAR) AS error FROM l
             UNION ALL SELECT p.l_partkey, t.r, CASE WHEN NOT sale THEN qty + quantity WHEN quantity > qty + 1e-8 THEN qty WHEN abs(qty - quantity) < 1e-8 THEN 0 ELSE qty - quantity END,
                              CASE WHEN NOT sale THEN cost + (quantity * price + fee) WHEN quantity > qty + 1e-8 THEN cost WHEN abs(qty - quantity) < 1e-8 THEN 0 ELSE cost - cost * (quantity / qty) END,
                              CASE WHEN NOT sale THEN invested + (quantity * price + fee) ELSE invested END,
                              CASE WHEN NOT sale OR quantity > qty + 1e-8 THEN realized ELSE realized + (quantity * price - fee - cost * (quantity / qty)) END,
                              CASE WHEN sale AND quantity > qty + 1e-8 THEN 'oversell' END
             FROM p JOIN t ON t.l_partkey = p.l_partkey AND t.r = p.r + 1 WHERE p.error IS NULL),
       e AS (SELECT *, CASE WHEN qty = 0 THEN 0 ELSE qty * 1000 END AS market FROM p QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY r DESC) = 1)
       SELECT l_partkey, round(qty, 4) AS qty, round(cost, 4) AS cost, round(invested, 4) AS invested, round(realized, 4) AS realized, error, round(market - cost + realized, 4) AS total_return, round(CASE WHEN invested <> 0 THEN (market - cost + realized) / invested * 100 END, 4) AS return_percent FROM e""",
)
def position_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as trades of their part: returned ones are sales."""
    lines = load(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("kind"), F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_tax").alias("fee"), F.lit(0.0).alias("amount"), F.lit(1.0).alias("ratio"),
    )
    out = tracking.with_returns(tracking.position_ledger(lines, ["l_partkey"], ["l_shipdate", "l_orderkey", "l_linenumber"]), F.lit(1000.0))
    return rounded(out, 4, "qty", "cost", "invested", "realized", "total_return", "return_percent").select("l_partkey", "qty", "cost", "invested", "realized", "error", "total_return", "return_percent")


@register(
    "model_history",
    """SELECT part, strftime(effective_date, '%Y-%m-%d') AS day, max(seq) AS seq FROM (SELECT l_partkey AS part, l_shipdate AS effective_date, l_orderkey * 10 + l_linenumber AS seq FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1, 2""",
)
def model_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'")
    return lines.groupBy(F.col("l_partkey").alias("part"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("day")).agg(F.max(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))


@register(
    "week_buckets",
    """SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, hour(ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2""",
)
def week_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").groupBy(F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd").alias("week"), F.hour("ts").cast("long").alias("hour")).agg(F.count("*").alias("n"))
