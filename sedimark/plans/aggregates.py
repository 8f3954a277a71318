"""Aggregation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimark.functions.numbers import bucket
from sedimark.operators import claims, sessions, stats
from sedimark.plans.registry import register
from sedimark.plans.tables import cents, load, rounded

_SAMPLE = """
    s AS (SELECT * FROM (SELECT o_orderpriority AS item, o_custkey, o_totalprice AS v, o_orderstatus AS status,
             row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1)"""


@register(
    "consensus_stats",
    f"""WITH {_SAMPLE},
    m AS (SELECT item, status FROM (SELECT item, status, row_number() OVER (PARTITION BY item ORDER BY count(*) DESC, status DESC) AS r FROM s GROUP BY item, status) WHERE r = 1),
    c AS (SELECT s.item, s.v FROM s JOIN m USING (item, status)),
    q AS (SELECT item, count(*) AS n, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, avg(v) AS mean, min(v) AS low, max(v) AS high FROM c GROUP BY item),
    d AS (SELECT item, quantile_cont(abs(v - median), 0.5) AS mad FROM c JOIN q USING (item) GROUP BY item),
    t AS (SELECT item, count(*) AS sample_size FROM s GROUP BY item)
    SELECT item, n, round(median, 4) AS median, round(q1, 4) AS q1, round(q3, 4) AS q3, round(mean, 4) AS mean, low, high, round(mad, 4) AS mad,
           round(q3 - q1, 4) AS iqr, round((high - low) / abs(median), 4) AS spread, (high - low) / abs(median) > 0.15 AS divergent, sample_size, sample_size - n AS excluded
    FROM q JOIN d USING (item) JOIN t USING (item)""",
)
def consensus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Robust statistics over the latest claim of each issuer."""
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("item"), "o_custkey", F.col("o_totalprice").alias("v"), F.col("o_orderstatus").alias("status"), "o_orderdate", "o_orderkey")
    out = claims.consensus(orders, ["item"], "o_custkey", "v", ["o_orderdate", "o_orderkey"], ["status"])
    return rounded(out, 4, "median", "q1", "q3", "mean", "mad", "iqr", "spread")


@register(
    "majority_vote",
    """SELECT item, status, votes FROM (SELECT c_mktsegment AS item, o_orderstatus AS status, count(*) AS votes,
         row_number() OVER (PARTITION BY c_mktsegment ORDER BY count(*) DESC, o_orderstatus DESC) AS r
       FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) WHERE r = 1""",
)
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = load(spark, sf_dir, "orders").join(load(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return claims.majority(joined.select(F.col("c_mktsegment").alias("item"), F.col("o_orderstatus").alias("status")), ["item"], ["status"])


@register(
    "mode_with_share",
    """WITH n AS (SELECT p_brand AS brand, p_size AS size, count(*) AS support FROM part GROUP BY 1, 2),
       r AS (SELECT *, sum(support) OVER w AS total, row_number() OVER (PARTITION BY brand ORDER BY support DESC, size) AS k,
                    lead(support) OVER (PARTITION BY brand ORDER BY support DESC, size) AS next FROM n WINDOW w AS (PARTITION BY brand))
       SELECT brand, CASE WHEN total >= 2 AND (next IS NULL OR support > next) AND (support / total >= 0.6 OR support >= 5) THEN size END AS winner, support, CAST(total AS BIGINT) AS total,
              CASE WHEN total < 2 THEN 'insufficient' WHEN (next IS NULL OR support > next) AND (support / total >= 0.6 OR support >= 5) THEN 'agreed' ELSE 'conflict' END AS status
       FROM r WHERE k = 1""",
)
def mode_with_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = load(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))
    return claims.mode_with_share(parts, ["brand"], "size", 0.6, support=5)


@register(
    "stance_counts",
    """SELECT o_orderpriority AS item, count(*) FILTER (o_orderstatus = 'F') AS bullish, count(*) FILTER (o_orderstatus = 'O') AS bearish,
              count(*) FILTER (o_orderstatus NOT IN ('F', 'O') OR o_orderstatus IS NULL) AS neutral,
              round(count(*) FILTER (o_orderstatus = 'F') / count(*), 6) AS bullish_share, round(count(*) FILTER (o_orderstatus = 'O') / count(*), 6) AS bearish_share,
              round(count(*) FILTER (o_orderstatus NOT IN ('F', 'O') OR o_orderstatus IS NULL) / count(*), 6) AS neutral_share
       FROM orders GROUP BY 1""",
)
def stance_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    stance = F.when(F.col("o_orderstatus") == "F", "bullish").when(F.col("o_orderstatus") == "O", "bearish").otherwise(F.col("o_orderstatus"))
    out = claims.stance_counts(load(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "item"), ["item"], stance)
    return rounded(out, 6, "bullish_share", "bearish_share", "neutral_share")


@register(
    "card_types",
    f"""WITH {_SAMPLE},
       q AS (SELECT item, count(*) AS issuers, (max(v) - min(v)) / abs(quantile_cont(v, 0.5)) > 0.15 AS divergent,
                    count(*) FILTER (status = 'F') AS up, count(*) FILTER (status = 'O') AS down, count(*) FILTER (status = 'P') AS flat FROM s GROUP BY item)
       SELECT item, issuers, CASE WHEN issuers < 2 THEN 'single_view' WHEN divergent THEN 'divergence' ELSE 'consensus' END AS card_type FROM q""",
)
def card_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("item"), "o_custkey", F.col("o_totalprice").alias("v"), "o_orderstatus", "o_orderdate", "o_orderkey")
    sample = claims.latest_per_key(orders, ["item", "o_custkey"], ["o_orderdate", "o_orderkey"])
    numbers = claims.robust_stats(sample, ["item"], "v")
    stance = F.when(F.col("o_orderstatus") == "F", "bullish").when(F.col("o_orderstatus") == "O", "bearish").otherwise("neutral")
    both = numbers.join(claims.stance_counts(sample, ["item"], stance), "item")
    return both.select("item", F.col("n").alias("issuers"), claims.card_type(F.col("n"), F.col("n"), F.col("divergent"), F.col("bullish"), F.col("bearish"), F.col("neutral")).alias("card_type"))


@register(
    "usage_rollup",
    """SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS provider, CAST(grouping(strftime(ts, '%Y-%m-%d'), event_type) AS BIGINT) AS level,
              count(*) AS turns, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cost, count(DISTINCT user_id) AS sessions
       FROM events GROUP BY ROLLUP (strftime(ts, '%Y-%m-%d'), event_type)""",
)
def usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("provider"), cents("value").alias("c"), "user_id")
    return sessions.usage_rollup(events, ["day", "provider"], {"turns": F.lit(1), "cost": F.col("c")}, F.col("user_id"))


@register(
    "cost_grouping_sets",
    """SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS provider, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cost, count(*) AS turns
       FROM events GROUP BY GROUPING SETS ((strftime(ts, '%Y-%m-%d'), event_type), (strftime(ts, '%Y-%m-%d')), (event_type), ())""",
)
def cost_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("provider"), cents("value").alias("c"))
    day, provider = F.col("day"), F.col("provider")
    return events.groupingSets([[day, provider], [day], [provider], []], day, provider).agg(F.sum("c").alias("cost"), F.count("*").alias("turns"))


@register(
    "cost_by_model",
    """SELECT event_type AS model, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cost, count(*) AS turns FROM events WHERE value IS NOT NULL
       GROUP BY 1 HAVING sum(CAST(round(value * 100) AS BIGINT)) > 0 ORDER BY cost DESC""",
)
def cost_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events").filter("value IS NOT NULL")
    return events.groupBy(F.col("event_type").alias("model")).agg(F.sum(cents("value")).alias("cost"), F.count("*").alias("turns")).filter("cost > 0").orderBy(F.desc("cost"))


@register(
    "running_totals",
    """SELECT user_id AS session_id, count(*) AS messages, count(*) FILTER (event_type = 'click') AS cached, count(*) FILTER (event_type <> 'click') AS uncached,
              CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cost FROM events GROUP BY 1""",
)
def running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    return events.groupBy(F.col("user_id").alias("session_id")).agg(F.count("*").alias("messages"), F.count_if(F.col("event_type") == "click").alias("cached"), F.count_if(F.col("event_type") != "click").alias("uncached"), F.sum(cents("value")).alias("cost"))


@register(
    "exact_quantiles",
    """SELECT l_returnflag AS grp, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95, round(quantile_cont(l_extendedprice, 0.99), 4) AS p99
       FROM lineitem GROUP BY 1""",
)
def exact_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("grp")).agg(F.expr("percentile(l_extendedprice, array(0.5D, 0.95D, 0.99D))").alias("q"))
    return rows.select("grp", *[F.round(F.col("q")[i], 4).alias(n) for i, n in enumerate(("p50", "p95", "p99"))])


_BOUNDS = [10.0, 25.0, 50.0, 100.0]


@register(
    "histogram",
    """WITH names AS (SELECT unnest(['<=10', '<=25', '<=50', '<=100', 'over']) AS bucket), types AS (SELECT DISTINCT event_type AS kind FROM events),
       n AS (SELECT event_type AS kind, CASE WHEN value <= 10 THEN '<=10' WHEN value <= 25 THEN '<=25' WHEN value <= 50 THEN '<=50' WHEN value <= 100 THEN '<=100' ELSE 'over' END AS bucket, count(*) AS n FROM events GROUP BY 1, 2)
       SELECT kind, bucket, coalesce(n, 0) AS n FROM types CROSS JOIN names LEFT JOIN n USING (kind, bucket)""",
)
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events").withColumnRenamed("event_type", "kind")
    return stats.histogram(events, ["kind"], bucket(F.col("value"), _BOUNDS), ["<=10", "<=25", "<=50", "<=100", "over"])


@register(
    "threshold_counts",
    """SELECT source, count(*) FILTER (n_chars > 256) AS over_256, count(*) FILTER (n_chars > 1024) AS over_1024, count(*) FILTER (n_chars > 4096) AS over_4096, count(*) FILTER (n_chars > 16384) AS over_16384 FROM documents GROUP BY 1""",
)
def threshold_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.above(load(spark, sf_dir, "documents"), ["source"], "n_chars", [256, 1024, 4096, 16384])


@register(
    "cluster_stats",
    """WITH g AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) >= 2)
       SELECT count(*) AS n_clusters, CAST(sum(n) AS BIGINT) AS n_rows, count(DISTINCT o_custkey) AS n_parents, round(avg(n), 6) AS mean_size FROM g""",
)
def cluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.clusters(load(spark, sf_dir, "orders"), ["o_orderpriority"], "o_custkey"), 6, "mean_size")


@register(
    "median_of_rates",
    """WITH r AS (SELECT strftime(ts, '%Y-%m-%d') AS day, user_id, avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) AS rate FROM events GROUP BY 1, 2)
       SELECT day, count(*) AS units, round(quantile_cont(rate, 0.5), 6) AS median_rate FROM r GROUP BY 1""",
)
def median_of_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return rounded(stats.median_of_rates(events, ["day"], "user_id", F.col("event_type") == "error"), 6, "median_rate")


@register(
    "role_counts",
    """SELECT conv_id, role, count(*) AS n, count(*) FILTER (length(text) < 40) AS short FROM conversations GROUP BY 1, 2""",
)
def role_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.count("*").alias("n"), F.count_if(F.length("text") < 40).alias("short"))


@register(
    "distinct_supporters",
    """SELECT l_partkey AS item, count(DISTINCT l_suppkey) AS supporters, coalesce(max(l_linenumber), 0) + 1 AS next_sequence FROM lineitem GROUP BY 1""",
)
def distinct_supporters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("item")).agg(F.countDistinct("l_suppkey").alias("supporters"), (F.coalesce(F.max("l_linenumber"), F.lit(0)) + 1).alias("next_sequence"))


@register(
    "latest_per_issuer",
    """SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1""",
)
def latest_per_issuer(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return claims.latest_per_key(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@register(
    "recent_changes",
    """WITH last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS r FROM lineitem
                     WHERE l_shipdate > (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 30 DAY) WHERE r = 1)
       SELECT count(*) FILTER (l_discount > 0.05) AS up, count(*) FILTER (l_discount < 0.05) AS down, count(*) AS issuers FROM last""",
)
def recent_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_discount")
    end = rows.agg(F.max("l_shipdate").alias("end"))
    recent = rows.join(F.broadcast(end), F.col("l_shipdate") > F.col("end") - F.expr("INTERVAL 30 DAYS"))  # one row
    last = claims.latest_per_key(recent.drop("end"), ["l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber"])
    return last.agg(F.count_if(F.col("l_discount") > 0.05).alias("up"), F.count_if(F.col("l_discount") < 0.05).alias("down"), F.count("*").alias("issuers"))


@register(
    "text_quality",
    """SELECT source, count(*) AS n, count(*) FILTER (length(regexp_replace(text, '[^A-Za-z]', '', 'g')) < 0.5 * length(text)) AS needs_ocr, CAST(sum(ceil(length(text) / 4)) AS BIGINT) AS tokens FROM documents GROUP BY 1""",
)
def text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = F.length(F.regexp_replace("text", "[^A-Za-z]", ""))
    docs = load(spark, sf_dir, "documents")
    return docs.groupBy("source").agg(F.count("*").alias("n"), F.count_if(letters < 0.5 * F.length("text")).alias("needs_ocr"), F.sum(F.ceil(F.length("text") / 4)).alias("tokens"))


@register(
    "section_groups",
    """SELECT conv_id, min(turn) AS first_turn, string_agg(role, '>' ORDER BY turn) AS roles, bool_or(role = 'system') AS has_system FROM conversations GROUP BY 1""",
)
def section_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min("turn").alias("first_turn"), F.array_join(F.transform(turns, lambda t: t["role"]), ">").alias("roles"), F.bool_or(F.col("role") == "system").alias("has_system"))
