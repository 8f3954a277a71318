"""Queries of pages around hits, reviews, market points and writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimark.operators import documents, reviews, tracking, writes
from sedimark.plans.registry import register
from sedimark.plans.tables import cents, load

_SPACES = r"regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')"


@register(
    "page_context",
    rf"""WITH h AS (SELECT conv_id * 1000 + turn AS hit_id, conv_id, turn FROM conversations WHERE role = 'user'),
         j AS (SELECT hit_id, p.turn + 1 AS page_number, trim({_SPACES}) AS text FROM h JOIN conversations p ON p.conv_id = h.conv_id AND p.turn BETWEEN h.turn - 1 AND h.turn + 1),
         b AS (SELECT *, least(300, greatest(80, 600 // count(*) OVER (PARTITION BY hit_id))) AS budget FROM j)
         SELECT hit_id, page_number, md5(CASE WHEN length(text) > budget THEN rtrim(left(text, CAST(budget - 1 AS BIGINT))) || '…' ELSE text END) AS text_md5, coalesce(length(text) > budget, false) AS truncated FROM b""",
)
def page_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question with the turns beside it, sharing a budget."""
    turns = load(spark, sf_dir, "conversations")
    hits = turns.filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("hit_id"), F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page_start"), (F.col("turn") + 1).alias("page_end"))
    pages = turns.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page_number"), "text")
    return documents.page_context(hits, pages, 1, 600, 80, 300).select("hit_id", "page_number", F.md5("text").alias("text_md5"), "truncated")


@register(
    "trimmed_lines",
    """WITH t AS (SELECT doc_id, text, instr(text, '.') - 1 AS hit, length(text) AS n FROM documents WHERE contains(text, '.')), s AS (SELECT *, greatest(0, least(hit - 80, n - 240)) AS start FROM t)
       SELECT doc_id, md5(CASE WHEN n <= 240 THEN text ELSE CASE WHEN start > 0 THEN '…' ELSE '' END || substr(text, start + 1, 240) || CASE WHEN start + 240 < n THEN '…' ELSE '' END END) AS line_md5 FROM s""",
)
def trimmed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").filter(F.contains("text", F.lit(".")))
    return docs.select("doc_id", F.md5(documents.trimmed_line(F.col("text"), F.instr("text", ".") - 1)).alias("line_md5"))


@register(
    "change_dependencies",
    """WITH c AS (SELECT l_orderkey AS o, l_linenumber AS id, l_suppkey AS g, CASE l_returnflag WHEN 'A' THEN 'a' WHEN 'R' THEN 'b' END AS side, l_partkey % 7 AS j FROM lineitem)
       SELECT x.o AS l_orderkey, x.id AS change_id, count(DISTINCT y.g) AS n, CAST(sum(DISTINCT y.g) AS BIGINT) AS groups FROM c x JOIN c y ON x.o = y.o AND x.g <> y.g AND (x.j = y.j OR (x.side = 'a' AND y.side = 'b') OR (x.side = 'b' AND y.side = 'a')) GROUP BY 1, 2""",
)
def change_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order that depend on another supplier's."""
    section = F.when(F.col("l_returnflag") == "A", reviews.ASSESSMENT).when(F.col("l_returnflag") == "R", "valuation").otherwise("sources")
    changes = load(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("change_id"), F.col("l_suppkey").alias("group_id"), section.alias("section"), F.array(F.col("l_partkey") % 7).alias("judgment_ids"))
    found = reviews.change_dependencies(changes, ["l_orderkey"])
    return found.select("l_orderkey", "change_id", F.size("depends_on").alias("n"), F.aggregate("depends_on", F.lit(0).cast("long"), lambda t, g: t + g).alias("groups"))


@register(
    "observed_facts",
    """WITH f AS (SELECT l_orderkey, l_partkey, l_linenumber, l_returnflag, l_linestatus FROM lineitem)
       SELECT DISTINCT x.l_partkey AS fact_id, y.l_partkey AS observation_id FROM f x JOIN f y ON x.l_orderkey = y.l_orderkey AND x.l_returnflag = y.l_returnflag AND x.l_linestatus = y.l_linestatus AND x.l_linenumber BETWEEN y.l_linenumber - 1 AND y.l_linenumber + 1""",
)
def observed_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    lines = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("id"), F.col("l_returnflag").alias("metric"), none.alias("value"), F.col("l_linestatus").alias("period"), none.alias("unit"), none.alias("scope"), none.alias("quote"), F.col("l_linenumber").alias("line"))
    around = F.array(F.struct("doc_id", (F.col("line") - 1).alias("line_start"), (F.col("line") + 1).alias("line_end")))
    return reviews.observed_facts(lines.withColumnRenamed("id", "fact_id"), lines.withColumn("evidence", around).withColumnRenamed("id", "observation_id"))


@register(
    "sensitivity",
    """WITH r AS (SELECT p_brand, p_partkey, p_size, p_retailprice AS base, p_retailprice - p_size AS down, p_retailprice + p_size * (p_partkey % 3) AS up FROM part),
       c AS (SELECT *, greatest(abs(down - base), abs(up - base)) AS most, greatest(abs(down - base), abs(up - base)) / abs(base) * 100 AS most_percent FROM r)
       SELECT p_brand, p_partkey AS driver_id, round((up - base) / abs(base) * 100 / 5, 6) AS up_elasticity, most > greatest(1e-9, abs(base) * 1e-9) AS active_driver FROM c""",
)
def sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.col("p_retailprice")
    runs = load(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("driver_id"), base.alias("baseline_output"), (base - F.col("p_size")).alias("down_output"), (base + F.col("p_size") * (F.col("p_partkey") % 3)).alias("up_output"))
    return reviews.sensitivity(runs, ["p_brand"]).select("p_brand", "driver_id", F.round("up_elasticity", 6).alias("up_elasticity"), "active_driver")


@register("listed_cards", "WITH w AS (SELECT * FROM part WHERE p_type IN ('ECONOMY', 'PROMO')) SELECT p_partkey, p_size AS priority, (SELECT count(*) FROM w) AS total FROM w ORDER BY p_size DESC, p_brand, p_partkey LIMIT 100")
def listed_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = load(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("card_type"), F.col("p_size").alias("priority"), F.col("p_brand").alias("item"), F.col("p_partkey").alias("period"))
    return reviews.listed_cards(cards, ["ECONOMY", "PROMO"]).select("p_partkey", "priority", "total")


@register(
    "context_tokens",
    """WITH m AS (SELECT user_id, event_id, CASE WHEN event_type = 'purchase' THEN event_id % 1000 END AS usage, length(props) AS estimate FROM events), l AS (SELECT user_id, max(event_id) FILTER (usage IS NOT NULL) AS last_id FROM m GROUP BY 1)
       SELECT user_id, coalesce(max(usage) FILTER (event_id = last_id), 0) AS usage_tokens, CAST(coalesce(sum(estimate) FILTER (last_id IS NULL OR event_id > last_id), 0) AS BIGINT) AS trailing_tokens FROM m JOIN l USING (user_id) GROUP BY 1""",
)
def context_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = F.when(F.col("event_type") == "purchase", F.col("event_id") % 1000)
    messages = load(spark, sf_dir, "events").select("user_id", "event_id", usage.alias("usage"), F.length("props").alias("estimate"))
    return reviews.context_tokens(messages, ["user_id"], "event_id").select("user_id", "usage_tokens", "trailing_tokens")


@register("recent_projects", "SELECT o_custkey AS project, max(o_orderkey) AS last_used, count(*) FILTER (o_orderstatus = 'O') AS running, count(*) FILTER (o_orderstatus = 'P') AS unread FROM orders GROUP BY 1")
def recent_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("modified"), (F.col("o_orderstatus") == "O").alias("running"), (F.col("o_orderstatus") == "P").alias("unread"))
    return reviews.recent_projects(sessions)


@register("with_parents", "SELECT c.conv_id * 1000 + c.turn AS session_id, p.conv_id * 1000 + p.turn AS parent_id FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1")
def with_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = lambda turn: F.concat_ws("/", "conv_id", turn)
    sessions = load(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("session_id"), path(F.col("turn")).alias("path"), path(F.col("turn") - 1).alias("parent_path"))
    return reviews.with_parents(sessions).select("session_id", "parent_id")


@register(
    "latest_market",
    """WITH b AS (SELECT o_custkey, max(o_orderkey) AS d, arg_max(o_totalprice, o_orderkey) AS c FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1), q AS (SELECT o_custkey, max(o_orderkey) AS d, arg_max(o_totalprice, o_orderkey) AS c FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
       SELECT o_custkey, CASE WHEN q.d IS NOT NULL AND (b.d IS NULL OR q.d >= b.d) THEN q.d ELSE b.d END AS date, CASE WHEN q.d IS NOT NULL AND (b.d IS NULL OR q.d >= b.d) THEN q.c ELSE b.c END AS close, CASE WHEN q.d IS NOT NULL AND (b.d IS NULL OR q.d >= b.d) THEN q.d END AS as_of FROM b FULL JOIN q USING (o_custkey)""",
)
def latest_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, live = load(spark, sf_dir, "orders"), F.col("o_orderstatus") == "O"
    bars = orders.filter(~live).select("o_custkey", F.col("o_orderkey").alias("bar_date"), F.col("o_totalprice").alias("close"))
    quotes = orders.filter(live).select("o_custkey", F.col("o_orderkey").alias("trade_date"), F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("as_of"))
    return tracking.latest_market(bars, quotes, "o_custkey")


@register(
    "unchanged_since",
    """WITH n AS (SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1), o AS (SELECT e.user_id, max(event_id) AS at FROM events e JOIN n ON e.user_id = n.user_id AND e.event_type <> n.event_type GROUP BY 1)
       SELECT e.user_id, n.event_type, min(event_id) AS since FROM events e JOIN n ON n.user_id = e.user_id LEFT JOIN o ON o.user_id = e.user_id WHERE o.at IS NULL OR e.event_id > o.at GROUP BY 1, 2""",
)
def unchanged_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking.unchanged_since(load(spark, sf_dir, "events"), "user_id", "event_type", "event_id", "event_id")


@register(
    "valuation_status",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 3 = 0 THEN 'split_review' WHEN o_orderstatus = 'P' THEN 'unavailable' WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN 'expired' WHEN o_orderkey % 5 = 0 THEN 'split_review'
              WHEN o_orderpriority = '5-LOW' THEN 'stale' ELSE 'valid' END AS status FROM orders""",
)
def valuation_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, error = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")), F.when(F.col("o_orderpriority") == "5-LOW", "late")
    status = tracking.valuation_status(F.col("o_orderstatus") == "O", F.col("o_orderkey") % 3 == 0, target, F.col("o_orderkey") % 5 == 0, error, F.lit("1997-01-01").cast("timestamp"))
    return load(spark, sf_dir, "orders").select("o_orderkey", status.alias("status"))


@register(
    "holdings_at",
    """SELECT DISTINCT l_partkey, l_shipdate AS bar_date, CAST(sum(CAST(l_quantity AS BIGINT)) OVER w AS BIGINT) AS quantity, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) OVER w AS BIGINT) AS invested
       FROM lineitem WINDOW w AS (PARTITION BY l_partkey ORDER BY l_shipdate RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def holdings_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem")
    trades = lines.select("l_partkey", F.col("l_shipdate").alias("trade_date"), F.col("l_quantity").cast("long").alias("quantity"), cents("l_extendedprice").alias("paid"))
    return tracking.holdings_at(lines.select("l_partkey", F.col("l_shipdate").alias("bar_date")).distinct(), trades, "l_partkey")


@register(
    "replaced",
    """SELECT label, count(*) AS n, CAST(sum(key) AS BIGINT) AS keys FROM (SELECT c_custkey AS key, c_mktsegment AS label FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')
       UNION ALL SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'P') GROUP BY 1""",
)
def replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' rows give way to those of their pending orders."""
    old = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("label"))
    new = load(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("label"))
    return writes.replaced(old, new, ["key"]).groupBy("label").agg(F.count("*").alias("n"), F.sum("key").alias("keys"))


@register(
    "appended",
    """WITH h AS (SELECT c_custkey AS key, c_mktsegment AS label FROM customer WHERE c_mktsegment <> 'BUILDING') SELECT label, count(*) AS n FROM (SELECT * FROM h UNION ALL
       SELECT o_custkey, min(o_orderpriority) FROM orders WHERE o_custkey NOT IN (SELECT key FROM h) GROUP BY 1) GROUP BY 1""",
)
def appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history that takes orders' rows for customers it doesn't have."""
    history = load(spark, sf_dir, "customer").filter("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("label"))
    rows = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("label"))
    return writes.appended(history, rows, ["key"]).groupBy("label").agg(F.count("*").alias("n"))


@register(
    "admitted",
    """SELECT doc_id, CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY md5(text)) AND text IS NOT NULL THEN 'duplicate content' WHEN doc_id > min(doc_id) OVER (PARTITION BY n_chars) AND n_chars IS NOT NULL THEN 'duplicate name' END AS reason FROM documents""",
)
def admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text, or else length, an earlier one has."""
    loads = load(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("content_hash"), F.col("n_chars").cast("string").alias("filename"))
    return writes.admitted(loads.limit(0), loads, False).select("doc_id", "reason")


@register(
    "rectangles",
    """WITH c AS (SELECT DISTINCT p_brand, p_partkey // 10 AS r, p_size AS c FROM part), a AS (SELECT *, c - row_number() OVER (PARTITION BY p_brand, r ORDER BY c) AS run FROM c), s AS (SELECT p_brand, r, min(c) AS c0, max(c) AS c1 FROM a GROUP BY p_brand, r, run),
       d AS (SELECT *, r - row_number() OVER (PARTITION BY p_brand, c0, c1 ORDER BY r) AS stack FROM s) SELECT p_brand, c0 AS col_start, c1 AS col_end, min(r) AS row_start, max(r) AS row_end FROM d GROUP BY p_brand, c0, c1, stack""",
)
def rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = load(spark, sf_dir, "part").select("p_brand", F.floor(F.col("p_partkey") / 10).alias("row_index"), F.col("p_size").alias("col_index"))
    return documents.rectangles(cells, ["p_brand"])


@register(
    "gap_groups",
    """WITH m AS (SELECT user_id, event_id, event_id - max(event_id + 5) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM events)
       SELECT user_id, event_id, CAST(sum(CASE WHEN gap > 40 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS group_no FROM m""",
)
def gap_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = load(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_id").alias("x"), F.lit(5).alias("width"))
    return documents.gap_groups(tokens, ["user_id"], 40).select("user_id", "event_id", "group_no")


@register(
    "session_fold",
    """SELECT user_id, min(event_id) AS first_at, max(event_id) AS last_at, max(length(props)) AS most_tokens, arg_min(length(props), event_id) FILTER (event_type = 'purchase') AS compaction_tokens,
              count(*) FILTER (event_type = 'click') AS messages, count(*) FILTER (event_type = 'purchase') AS compactions FROM events GROUP BY 1""",
)
def session_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "message").when(F.col("event_type") == "purchase", "compaction")
    entries = load(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_id").alias("at"), kind.alias("kind"), F.length("props").alias("tokens"))
    return reviews.session_fold(entries, ["user_id"], "event_id")


@register(
    "worst",
    """SELECT p_partkey, p_size, CASE WHEN p_size % 10 > 0 THEN p_retailprice / (p_size % 10) END AS ratio FROM part ORDER BY ratio DESC NULLS FIRST, p_size DESC, p_partkey LIMIT 50""",
)
def worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "part").select("p_partkey", "p_size", F.try_divide("p_retailprice", F.col("p_size") % 10).alias("ratio"))
    return reviews.worst(rows, "ratio", "p_size", "p_partkey", 50)
