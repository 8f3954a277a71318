"""Join and set queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimark.operators import catalog, sessions, stats
from sedimark.plans.registry import register
from sedimark.plans.tables import cents, load, rounded


@register(
    "first_child",
    """SELECT o_orderkey, o_orderpriority, first_line, first_part FROM orders LEFT JOIN
         (SELECT l_orderkey, l_linenumber AS first_line, l_partkey AS first_part FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS r FROM lineitem) WHERE r = 1) ON o_orderkey = l_orderkey""",
)
def first_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parent with its first child only, aggregated before the join so that rows don't multiply."""
    first = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_partkey")).alias("f")).select("l_orderkey", F.col("f.l_linenumber").alias("first_line"), F.col("f.l_partkey").alias("first_part"))
    return load(spark, sf_dir, "orders").join(first, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "o_orderpriority", "first_line", "first_part")


@register(
    "latest_label",
    """SELECT user_id, value FROM (SELECT user_id, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 AND value IS NOT NULL""",
)
def latest_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest label of each key; a null that came last clears it."""
    events = load(spark, sf_dir, "events").select("user_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("value"), "event_id")
    return sessions.latest_fact(events, ["user_id"], "value", "event_id")


@register(
    "project_listing",
    """SELECT c_custkey, c_name, n_name, r_name, coalesce(orders, 0) AS orders, coalesce(spent, 0) AS spent FROM customer
       JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
       LEFT JOIN (SELECT o_custkey, count(*) AS orders, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS spent FROM orders GROUP BY 1) ON c_custkey = o_custkey""",
)
def project_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents with lookups and child totals; children are aggregated first."""
    totals = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.sum(cents("o_totalprice")).alias("spent"))
    nation = load(spark, sf_dir, "nation").join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = load(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(totals, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", "c_name", "n_name", "r_name", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("spent", F.lit(0)).alias("spent"))


@register("semi_join", "SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    returned = load(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey")
    return load(spark, sf_dir, "orders").join(returned, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@register("anti_join", "SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an urgent order that is pending."""
    urgent = load(spark, sf_dir, "orders").filter("o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'")
    return load(spark, sf_dir, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_mktsegment")


@register("leaf_turns", "SELECT c.conv_id, c.turn FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.turn = c.turn + 1)")
def leaf_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("id"), (F.col("turn") - 1).alias("parent_id"))
    return sessions.leaves(turns, ["conv_id"]).select("conv_id", F.col("id").alias("turn"))


@register(
    "version_diff",
    """WITH a AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-01-01' GROUP BY 1, 2), b AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY 1, 2)
       SELECT l_partkey, l_suppkey, CASE WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'removed' WHEN a.n = b.n THEN 'same' ELSE 'changed' END AS change FROM a FULL JOIN b USING (l_partkey, l_suppkey)""",
)
def version_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is new, gone or different between two versions."""
    lines = load(spark, sf_dir, "lineitem")
    half = lambda rows: rows.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    cut = F.lit("1995-01-01").cast("timestamp_ntz")
    return stats.full_diff(half(lines.filter(F.col("l_shipdate") < cut)), half(lines.filter(F.col("l_shipdate") >= cut)), ["l_partkey", "l_suppkey"], "n")


_PAIRS = """p AS (SELECT user_id, day, max(CASE WHEN event_type = 'view' THEN value END) AS base, max(CASE WHEN event_type = 'click' THEN value END) AS cand
       FROM (SELECT *, CAST(ts AS DATE) AS day FROM events) GROUP BY 1, 2 HAVING count(*) FILTER (event_type = 'view') = 1 AND count(*) FILTER (event_type = 'click') = 1)"""


@register(
    "paired_summary",
    f"""WITH {_PAIRS} SELECT count(*) AS pairs, round(avg(base), 6) AS mean_base, round(avg(cand), 6) AS mean_cand, round(avg(cand - base), 6) AS mean_delta,
          count(*) FILTER (cand > base) AS wins, count(*) FILTER (cand = base) AS ties, count(*) FILTER (cand < base) AS losses FROM p WHERE base IS NOT NULL AND cand IS NOT NULL""",
)
def paired_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baseline against candidate where a group has exactly one of each."""
    events = load(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return rounded(stats.pair_summary(stats.paired(events, ["user_id", "day"], "event_type", "view", "click", "value")), 6, "mean_base", "mean_cand", "mean_delta")


@register(
    "pair_diagnostics",
    """WITH g AS (SELECT DISTINCT user_id FROM events), h AS (SELECT unnest(['view', 'click', 'purchase']) AS event_type), n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
       SELECT user_id, event_type, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'duplicate' ELSE 'ok' END AS status FROM g CROSS JOIN h LEFT JOIN n USING (user_id, event_type)""",
)
def pair_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.diagnostics(load(spark, sf_dir, "events"), ["user_id"], "event_type", ["view", "click", "purchase"])


@register(
    "lookup_precedence",
    """SELECT p_partkey, coalesce(best.price, p_retailprice) AS price, CASE WHEN best.price IS NOT NULL THEN 'supplier' ELSE 'list' END AS origin FROM part
       LEFT JOIN (SELECT l_partkey, min(l_extendedprice) AS price FROM lineitem WHERE l_quantity = 1 GROUP BY 1) best ON p_partkey = l_partkey""",
)
def lookup_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = load(spark, sf_dir, "lineitem").filter("l_quantity = 1").groupBy("l_partkey").agg(F.min("l_extendedprice").alias("price"))
    joined = load(spark, sf_dir, "part").join(best, F.col("p_partkey") == F.col("l_partkey"), "left")
    return joined.select("p_partkey", F.coalesce("price", "p_retailprice").alias("price"), F.when(F.col("price").isNotNull(), "supplier").otherwise("list").alias("origin"))


@register(
    "merged_log",
    """SELECT seq, kind, id FROM (SELECT event_id AS seq, 'event' AS kind, CAST(user_id AS VARCHAR) AS id FROM events UNION ALL SELECT o_orderkey, 'order', CAST(o_custkey AS VARCHAR) FROM orders
         UNION ALL SELECT p_partkey, 'part', p_brand FROM part) WHERE seq > 100 ORDER BY seq, kind, id LIMIT 500""",
)
def merged_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next entries of several logs in one order; the limit is a page."""
    return sessions.merged_log(
        {"event": load(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("id")), "order": load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("id")), "part": load(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), F.col("p_brand").alias("id"))},
        100, 500,
    )


@register("set_difference", "SELECT l_partkey FROM lineitem EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem")
    return lines.select("l_partkey").distinct().join(lines.filter("l_returnflag = 'R' AND l_quantity > 45").select("l_partkey"), "l_partkey", "left_anti")


@register(
    "first_query_wins",
    """SELECT doc_id, arg_min(query, ord) AS query FROM (SELECT doc_id, 0 AS ord, 'the' AS query FROM documents WHERE contains(lower(text), 'the') UNION ALL SELECT doc_id, 1, 'que' FROM documents WHERE contains(lower(text), 'que')) GROUP BY 1""",
)
def first_query_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A union of two searches without repeats; the first search that found a row names it."""
    low = F.lower("text")
    query = F.when(F.contains(low, F.lit("the")), "the").when(F.contains(low, F.lit("que")), "que")
    return load(spark, sf_dir, "documents").select("doc_id", query.alias("query")).filter("query IS NOT NULL")


@register(
    "registered_versions",
    """WITH d AS (SELECT source, md5(text) AS checksum, min(doc_id) AS ord FROM documents GROUP BY 1, 2)
       SELECT source, checksum, CAST(row_number() OVER (PARTITION BY source ORDER BY ord) AS INTEGER) AS version_no, row_number() OVER (PARTITION BY source ORDER BY ord DESC) = 1 AS is_current FROM d""",
)
def registered_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as versions of their source; equal texts are one version."""
    docs = load(spark, sf_dir, "documents").groupBy("source", F.md5("text").alias("checksum")).agg(F.min("doc_id").alias("ord"))
    nothing = spark.createDataFrame([], "source string, checksum string, version_no int, is_current boolean")
    return catalog.registered(nothing, docs, "source", "checksum")


@register(
    "upserted",
    """SELECT c_custkey, CASE WHEN o.price IS NULL THEN c_acctbal ELSE o.price END AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS price FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) o ON o_custkey = c_custkey""",
)
def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    new = load(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("c_acctbal"), "o_orderkey")
    known = new.join(old.select("c_custkey"), "c_custkey", "left_semi")
    return catalog.upserted(old, known, ["c_custkey"], ["o_orderkey"])


@register(
    "inserted_if_absent",
    """SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)""",
)
def inserted_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    new = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return catalog.inserted_if_absent(old, new, ["id"], ["name"])


@register(
    "request_conflicts",
    "SELECT o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS day, count(DISTINCT o_totalprice) AS payloads FROM orders GROUP BY 1, 2 HAVING count(DISTINCT o_totalprice) > 1",
)
def request_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return catalog.request_conflicts(orders, ["o_custkey", "day"], F.col("o_totalprice"))


@register(
    "fingerprints",
    """SELECT conv_id, sha256(string_agg(sha256(coalesce(role, '') || chr(0) || coalesce(text, '')), chr(0) ORDER BY turn)) AS fingerprint FROM conversations GROUP BY 1""",
)
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.fingerprint(load(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], ["role", "text"])


@register(
    "coverage",
    """SELECT source, count(*) AS documents, count(l.doc_id) AS labelled, CASE WHEN count(l.doc_id) = 0 THEN 'empty' WHEN count(l.doc_id) = count(*) THEN 'complete' ELSE 'partial' END AS status
       FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id GROUP BY 1""",
)
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = load(spark, sf_dir, "labels").select(F.col("doc_id").alias("done_id")).distinct()
    joined = load(spark, sf_dir, "documents").select("doc_id", "source").join(done, F.col("doc_id") == F.col("done_id"), "left")
    out = joined.groupBy("source").agg(F.count("*").alias("documents"), F.count("done_id").alias("labelled"))
    return out.withColumn("status", F.when(F.col("labelled") == 0, "empty").when(F.col("labelled") == F.col("documents"), "complete").otherwise("partial"))


@register("pending_work", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def pending_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.pending(load(spark, sf_dir, "documents").select("doc_id"), load(spark, sf_dir, "labels"), ["doc_id"])
