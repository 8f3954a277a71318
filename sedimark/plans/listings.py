"""Queries of put-together filters, due work, votes, references, page roles and claim checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimark.functions import references
from sedimark.operators import layout, listings
from sedimark.plans.registry import register
from sedimark.plans.tables import load


@register("filtered_events", "SELECT event_id, event_type FROM events WHERE event_id > 100 AND event_type IN ('click', 'view') AND CAST(json_extract(props, '$.k') AS BIGINT) > 50")
def filtered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions that a caller puts together, and one that is checked after decoding."""
    found = listings.where_all(load(spark, sf_dir, "events"), after=("event_id", 100), event_type=["click", "view"], user_id=None)
    return found.filter(F.get_json_object("props", "$.k").cast("long") > 50).select("event_id", "event_type")


@register("run_records", "SELECT event_id, event_type FROM events WHERE CASE WHEN event_type = 'signup' THEN event_id ELSE user_id END = 7")
def run_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = load(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("run_id"), F.when(F.col("event_type") == "signup", "operation_started").otherwise(F.col("event_type")).alias("type"))
    found = listings.of_run(records, 7)
    return found.select(F.col("id").alias("event_id"), F.when(F.col("type") == "operation_started", "signup").otherwise(F.col("type")).alias("event_type"))


@register(
    "chosen_sessions",
    """SELECT c_custkey FROM customer WHERE (lower(c_mktsegment) LIKE 'auto%' OR lower(c_mktsegment) LIKE 'build%') AND lower(c_mktsegment) LIKE '%i%' AND c_custkey IN (SELECT o_custkey FROM orders WHERE lower(o_orderpriority) LIKE '%urgent%')""",
)
def chosen_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = load(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("model"))
    commands = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("command"))
    return listings.chosen_sessions(sessions, commands, "c_custkey", "I", ["Auto", "Build"], ["Urgent"]).select("c_custkey")


@register(
    "due_trackers",
    """WITH t AS (SELECT c_custkey AS id, c_acctbal > 0 AS enabled, CAST('1995-01-01' AS DATE) + CAST(c_custkey % 2000 AS INTEGER) AS day, c_custkey % 3 = 0 AS unchecked, c_custkey % 200 AS late, c_custkey % 5 = 0 AS leased FROM customer)
       SELECT id FROM t WHERE enabled AND NOT leased AND (unchecked OR (late <= 120 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = id AND CAST(o_orderdate AS DATE) = day)))""",
)
def due_trackers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    day = F.date_add(F.lit("1995-01-01").cast("date"), (key % 2000).cast("int"))
    trackers = load(spark, sf_dir, "customer").select(
        key.alias("id"), (F.col("c_acctbal") > 0).alias("enabled"), day.alias("start_date"), F.when(key % 5 == 0, 2000).alias("lease_until"), F.lit(None).cast("long").alias("last_attempt_at"), day.alias("day"),
        F.lit(True).alias("after_close"), (key % 200).alias("minutes_after_close"), F.when(key % 3 != 0, day).alias("checked_day"), F.lit(True).alias("checked_after_close"),
    )
    seen = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.to_date("o_orderdate").alias("day"))
    return listings.due_trackers(trackers, seen, 1000).select("id")


@register("due_monitors", "SELECT s_suppkey AS id FROM supplier WHERE (s_acctbal > 0 AND s_suppkey % 10 <= 4) OR s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50 AND l_returnflag = 'R')")
def due_monitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    monitors = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") > 0).alias("enabled"), (F.col("s_suppkey") % 10).alias("next_run_at"))
    asked = load(spark, sf_dir, "lineitem").filter("l_quantity = 50 AND l_returnflag = 'R'").select(F.col("l_suppkey").alias("id"))
    return listings.due_monitors(monitors, asked, 4).select("id")


@register(
    "poll_spans",
    """SELECT c_custkey, strftime(coalesce(CAST(max(o_orderdate) AS DATE) - 2, DATE '2000-01-01' - 30), '%Y-%m-%d') AS poll_from FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""",
)
def poll_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last_checked_at"))
    subscriptions = load(spark, sf_dir, "customer").select("c_custkey").join(last, "c_custkey", "left")
    return listings.polls(subscriptions, "2000-01-01").select("c_custkey", F.date_format("poll_from", "yyyy-MM-dd").alias("poll_from"))


@register("unconsumed", "SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents e WHERE e.lang = 'en' AND e.source = d.source AND md5(e.text) = md5(d.text))")
def unconsumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.md5("text").alias("digest"))
    return listings.unconsumed(docs, docs.filter("lang = 'en'"), ["source"], "digest").select("doc_id")


@register(
    "run_totals",
    """WITH d AS (SELECT doc_id % 5 AS run, doc_id AS id, md5(text) AS dg FROM documents), f AS (SELECT run, id FROM d WHERE dg NOT IN (SELECT md5(text) FROM documents WHERE lang = 'de' AND text IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY dg ORDER BY run, id) = 1),
       c AS (SELECT run, count(*) AS n FROM f GROUP BY 1) SELECT d.run, count(*) AS discovered, coalesce(any_value(n), 0) AS created, count(*) - coalesce(any_value(n), 0) AS duplicates FROM d LEFT JOIN c USING (run) GROUP BY 1""",
)
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select((F.col("doc_id") % 5).alias("run"), F.col("doc_id").alias("id"), F.md5("text").alias("digest"), "lang")
    return listings.run_totals(docs, docs.filter("lang = 'de'").select((-F.col("id") - 1).alias("id"), "digest"), "id", "digest")


@register("counted", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.counted(load(spark, sf_dir, "customer").select("c_custkey"), load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@register(
    "read_rates",
    """SELECT l_returnflag, count(*) AS reads, count(DISTINCT l_orderkey) AS messages, count_if(l_linestatus = 'O') AS "full", round(count_if(l_linestatus = 'O') / count(*), 9) AS full_rate FROM lineitem GROUP BY 1""",
)
def read_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = load(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", F.when(F.col("l_linestatus") == "O", "full").otherwise("partial").alias("mode"))
    return listings.read_rates(reads, ["l_returnflag"], ["l_orderkey"]).select("l_returnflag", "reads", "messages", "full", F.round("full_rate", 9).alias("full_rate"))


@register(
    "voted_house",
    """WITH h AS (SELECT o_custkey, o_orderpriority AS house, count_if(o_orderstatus = 'F') * 100 + least(30, count_if(o_orderstatus <> 'F')) AS score FROM orders GROUP BY 1, 2)
       SELECT o_custkey, house, score FROM h WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, house) = 1""",
)
def voted_house(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = load(spark, sf_dir, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("house")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("cover"), F.count_if(F.col("o_orderstatus") != "F").alias("other"))
    return listings.voted_house(hits.withColumn("rank", F.left("house", F.lit(1)).cast("int")), ["o_custkey"])


@register(
    "evaluated",
    """WITH r AS (SELECT o_custkey, count(*) AS n, any_value(o_custkey) % 7 = 0 AS twice FROM orders GROUP BY 1),
       m AS (SELECT c_mktsegment, CASE WHEN n IS NULL OR twice THEN 0 ELSE n * 10 END AS score, coalesce(n >= 12 AND NOT twice, false) AS passed FROM customer LEFT JOIN r ON o_custkey = c_custkey)
       SELECT c_mktsegment, count(*) AS cases, count_if(passed) AS passed, round(avg(score), 1) AS score FROM m GROUP BY 1""",
)
def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg((F.count("*") * 10).alias("score"), (F.count("*") >= 12).alias("passed"))
    return listings.evaluated(load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), found.unionByName(found.filter("c_custkey % 7 = 0")), ["c_mktsegment"], "c_custkey")


@register(
    "named_hits",
    """WITH n AS (SELECT conv_id, arg_max(CASE WHEN turn % 4 = 0 THEN 'cleared' ELSE left(text, 8) END, turn) AS session_name FROM conversations WHERE role = 'user' GROUP BY 1)
       SELECT c.conv_id, c.turn, NULLIF(session_name, 'cleared') AS session_name, session_name IS NOT NULL AS has_name FROM conversations c LEFT JOIN n USING (conv_id) WHERE c.role = 'assistant' AND contains(c.text, 'the')""",
)
def named_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations").withColumn("entry_id", F.struct("conv_id", "turn"))
    hits = turns.filter(F.contains("text", F.lit("the"))).select("entry_id", F.length("text").alias("score"))
    entries = turns.select("entry_id", F.col("conv_id").alias("session_id"), F.col("role").alias("type"), "turn")
    facts = turns.filter("role = 'user'").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), F.lit("name").alias("kind"), F.when(F.col("turn") % 4 != 0, F.left("text", F.lit(8))).alias("value"))
    found = listings.named_hits(hits, entries, turns.select(F.col("conv_id").alias("session_id")).distinct(), facts, ["assistant"])
    return found.select(F.col("session_id").alias("conv_id"), "turn", "session_name", "has_name")


@register("newest_orders", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) <= 3")
def newest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.newest(load(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.asc("o_orderkey")], 3).select("o_custkey", "o_orderkey")


@register(
    "written_files",
    """SELECT user_id, 'f' || CAST(json_extract(props, '$.k') AS BIGINT) AS path, min(event_id) AS first_position FROM events WHERE event_type IN ('purchase', 'view') AND value >= 5 GROUP BY 1, 2""",
)
def written_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    name = F.when(F.col("event_type") == "purchase", "write").when(F.col("event_type") == "view", "Edit").otherwise("read")
    path = F.concat(F.lit("f"), F.get_json_object("props", "$.k"))
    calls = events.select("user_id", F.col("event_id").alias("call_id"), F.col("event_id").alias("position"), name.alias("name"), F.to_json(F.struct(F.when(F.col("event_id") % 2 == 0, path).alias("path"), F.when(F.col("event_id") % 2 == 1, path).alias("file_path"))).alias("arguments"))
    return listings.written_files(calls, events.select(F.col("event_id").alias("call_id"), (F.col("value") < 5).alias("is_error")), ["user_id"])


@register(
    "path_references",
    r"""WITH p AS (SELECT DISTINCT '/' || unnest(string_split(lower(n_name), ' ')) AS path FROM nation UNION SELECT unnest(['/the', '/to', '/and']) AS path),
        r AS (SELECT DISTINCT page_id, regexp_replace(unnest(regexp_extract_all(regexp_replace(regexp_replace(html, '\\+', '/', 'g'), 'file://', ' ', 'g'), '[\w./~-]+')), '\.+$', '') AS path FROM pages)
        SELECT path, page_id AS entry_id FROM r JOIN p USING (path)""",
)
def path_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = load(spark, sf_dir, "nation").select(F.explode(F.split(F.lower("n_name"), " ")).alias("n"))
    paths = nations.select(F.concat(F.lit("/"), "n").alias("path")).unionByName(spark.createDataFrame([("/the",), ("/to",), ("/and",)], "path string"))
    return listings.path_references(load(spark, sf_dir, "pages").select(F.col("page_id").alias("entry_id"), F.col("html").alias("text")), paths)


@register(
    "calculations",
    """WITH f AS (SELECT p_partkey AS id, p_retailprice - 1000 AS v, CASE p_partkey % 8 WHEN 2 THEN 'multiple' WHEN 3 THEN 'unknown_x' ELSE 'CNY/share' END AS dim, 2020 + p_partkey % 3 AS year, p_size % 2 AS label, CASE WHEN p_size % 3 = 0 THEN 'target_price' ELSE 'current_price' END AS role FROM part),
       a AS (SELECT p_partkey AS id, p_partkey AS l, p_partkey + 1 AS r, CASE p_partkey % 5 WHEN 0 THEN 'growth' WHEN 1 THEN 'change' WHEN 2 THEN 'ratio' WHEN 3 THEN 'upside' ELSE 'product' END AS op FROM part),
       j AS (SELECT a.id, op, x.id AS xi, y.id AS yi, x.v AS x, y.v AS y, x.dim = y.dim AND NOT starts_with(x.dim, 'unknown_') AS same, x.dim LIKE '%/share' AS share, y.dim = 'multiple' AS multiple, x.year < y.year AS ordered, x.year = y.year AS together, x.label = y.label AS labelled, x.role = 'target_price' AND y.role = 'current_price' AS priced
             FROM a LEFT JOIN f x ON x.id = a.l LEFT JOIN f y ON y.id = a.r),
       k AS (SELECT *, CASE WHEN xi IS NULL OR yi IS NULL THEN 'unknown input' WHEN op IN ('growth', 'change') AND NOT (same AND labelled AND ordered) THEN 'not comparable' WHEN op = 'growth' AND x <= 0 THEN 'base not positive' WHEN op = 'ratio' AND NOT (same AND together AND y <> 0) THEN 'not comparable'
                    WHEN op = 'upside' AND NOT (same AND share AND y > 0 AND priced) THEN 'not comparable' WHEN op = 'product' AND NOT (share AND multiple AND together) THEN 'not comparable' END AS issue FROM j)
       SELECT id, op AS operation, issue, round(CASE WHEN issue IS NULL THEN CASE op WHEN 'growth' THEN y / x - 1 WHEN 'change' THEN y - x WHEN 'ratio' THEN x / y WHEN 'upside' THEN x / y - 1 ELSE x * y END END, 6) AS value FROM k""",
)
def calculations(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    parts = load(spark, sf_dir, "part")
    facts = parts.select(
        key.alias("id"), (F.col("p_retailprice") - 1000).alias("base_value"), F.when(key % 8 == 2, "multiple").when(key % 8 == 3, "unknown_x").otherwise("CNY/share").alias("dimension"),
        F.concat(F.lit("FY"), 2020 + key % 3).alias("period"), (2020 + key % 3).alias("year"), F.lit("year").alias("grain"), (F.col("p_size") % 2).alias("label"), key.alias("cell"), F.lit(None).cast("string").alias("condition"),
        F.when(F.col("p_size") % 3 == 0, "target_price").otherwise("current_price").alias("role"),
    )
    operation = F.element_at(F.array(*map(F.lit, ("growth", "change", "ratio", "upside", "product"))), (key % 5 + 1).cast("int"))
    out = listings.calculations(parts.select(key.alias("id"), operation.alias("operation"), key.alias("left"), (key + 1).alias("right")), facts)
    return out.withColumn("value", F.round("value", 6))


@register(
    "complete_traces",
    """SELECT o_orderkey, o_orderstatus <> 'P' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_linenumber > 2) AS complete FROM orders""",
)
def complete_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").filter("l_linenumber > 2")
    issues = lines.select(F.col("l_orderkey").alias("trace_id"), F.when(F.col("l_returnflag") == "R", "missing_cell").otherwise("formula_cache_unavailable").alias("code"))
    traces = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trace_id"), (F.col("o_orderstatus") == "P").alias("truncated"))
    return listings.complete_traces(traces, issues).select(F.col("trace_id").alias("o_orderkey"), "complete")


@register(
    "text_in_budget",
    """WITH s AS (SELECT conv_id, sum(strlen(coalesce(text, '')) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS used FROM conversations)
       SELECT conv_id, count_if(used <= 800) AS shown, CAST(coalesce(max(CASE WHEN used <= 800 THEN used END), 0) AS BIGINT) AS bytes, count_if(used > 800) AS left_out FROM s GROUP BY 1""",
)
def text_in_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.in_budget(load(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text", 800)


@register(
    "source_ids",
    """SELECT p_partkey, 'source:' || replace(replace(rtrim(base64(encode('["p' || p_partkey || '","pdf",' || p_size || ',' || (p_size + 2) || ']')), '='), '+', '-'), '/', '_') AS id, CAST(p_size AS VARCHAR) AS first_page,
              CASE p_size % 3 WHEN 0 THEN p_name || ' p.' || p_size || '-' || (p_size + 2) WHEN 1 THEN p_name || ' ' || p_brand || '!A1' ELSE p_name || ':' || p_size || '-' || p_size END AS citation FROM part""",
)
def source_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, none = F.col("p_size"), F.lit(None).cast("string")
    some = lambda k, c: F.when(size % 3 == k, c)
    parts = load(spark, sf_dir, "part").withColumn("id", references.source_id(F.concat(F.lit("p"), "p_partkey"), "pdf", size, size + 2))
    cited = references.citation(F.col("p_name"), some(0, size), some(0, size + 2), some(1, F.col("p_brand")), some(1, F.lit("A1")), some(2, size), none, none)
    return parts.select("p_partkey", "id", references.parsed_source(F.col("id"))["first"].alias("first_page"), cited.alias("citation"))


@register(
    "percent_storage",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN l_discount WHEN l_linenumber % 3 = 1 AND l_quantity > 1 THEN l_quantity / 100 END AS fraction FROM lineitem""",
)
def percent_storage(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("l_linenumber") % 3
    value = F.when(turn == 0, F.col("l_discount")).when(turn == 1, F.col("l_quantity")).otherwise(0.5)
    shape = F.when(turn == 0, "0.0%").when(turn == 1, 'general "%"')
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", references.percent_base(value, shape, F.lit(None).cast("string")).alias("fraction"))


_LINES = r"list_filter(string_split(coalesce(text, ''), chr(10)), lambda b: length(trim(b)) > 0)"
_DIGITS = r"length(b) - length(regexp_replace(b, '[0-9%¥￥$€.,]', '', 'g'))"


@register(
    "page_roles",
    rf"""WITH p AS (SELECT doc_id, doc_id % 7 + 1 AS number, coalesce(text, '') AS text, doc_id % 3 AS images, doc_id % 4 AS large, doc_id % 13 AS drawings, {_LINES} AS lines, length(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', '', 'g')) AS chars FROM documents),
         s AS (SELECT *, len(list_filter(lines, lambda b: NOT regexp_matches(b, '{layout.SPEAKER}') AND length(b) >= 6 AND ({_DIGITS}) / length(b) >= 0.28)) / greatest(len(lines), 1) AS tables, len(list_filter(lines, lambda b: regexp_matches(b, '[0-9]'))) / greatest(len(lines), 1) AS numeric_lines,
                      len(regexp_extract_all(text, '{layout.LEGAL}')) / (greatest(chars, 1) / 1000) AS density, regexp_matches(text, '{layout.EXHIBIT}') AS exhibit FROM p)
         SELECT doc_id, CASE WHEN number = 1 THEN 'cover'
                WHEN regexp_matches(text, '{layout.RATING_HISTORY}') OR (regexp_matches(text, '(?i)price target|目标价') AND regexp_matches(text, '(?i)\brating\b|评级') AND len(regexp_extract_all(text, '{layout.DATE}')) >= 4 AND len(regexp_extract_all(text, '{layout.RATING_WORD}')) >= 3) THEN 'rating_history'
                WHEN regexp_matches(text, '{layout.VALUATION}') THEN 'valuation_method'
                WHEN regexp_matches(text, '{layout.DISCLOSURE}') OR (NOT exhibit AND drawings < 200 AND ((chars >= 1200 AND density >= 6) OR (number >= 6 AND regexp_matches(text, '{layout.LATE_NOTICE}')))) THEN 'disclosure_boilerplate'
                WHEN large >= 2 AND length(text) < 1500 THEN 'exhibit_image' WHEN tables >= 0.28 OR (numeric_lines >= 0.6 AND len(lines) >= 5) THEN 'table_heavy'
                WHEN exhibit AND (drawings >= 12 OR large >= 2) THEN 'exhibit_chart' WHEN exhibit AND images > 0 AND length(text) < 800 THEN 'exhibit_image' ELSE 'body' END AS role FROM s""",
)
def page_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages whose lines are blocks."""
    one, key = F.lit(1.0), F.col("doc_id")
    counts = {"number": key % 7 + 1, "total": F.lit(7), "images": key % 3, "large_images": key % 4, "drawings": key % 13}
    pages = load(spark, sf_dir, "documents").select("doc_id", "text").withColumns(counts)
    lines = pages.select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("text"))
    return layout.page_roles(pages, lines.withColumn("type", layout.block_type(F.col("text"), one, one)), ["doc_id"]).select("doc_id", "role")


@register(
    "claim_quality",
    """WITH c AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q, l_linenumber % 3 <> 0 AS good, l_linenumber % 2 = 0 AS has_unit, l_linenumber % 4 = 1 AS loose FROM lineitem)
       SELECT l_orderkey, l_linenumber, CASE WHEN NOT good OR NOT has_unit THEN 'review_required' WHEN loose THEN 'quote_unverified' ELSE 'verified' END AS status,
              concat_ws(',', CASE WHEN loose THEN 'quote_not_found_in_evidence' END, CASE WHEN NOT has_unit THEN 'numeric_without_unit' END, CASE WHEN NOT good THEN 'value_not_in_quote' END) AS issues, CASE WHEN loose THEN 0.4 ELSE 0.9 END AS confidence FROM c""",
)
def claim_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, q, none = F.col("l_linenumber"), F.col("l_quantity").cast("long"), F.lit(None).cast("double")
    quote = F.concat(F.lit("an order of "), F.when(n % 3 != 0, q).otherwise(q * 10 + 7), F.lit(" pieces came in FY2024"))
    got = layout.claim_quality(q.cast("double"), none, none, F.when(n % 2 == 0, "pieces"), F.lit("FY2024"), F.lit(True), quote, F.when(n % 4 == 1, 1).otherwise(0), F.lit(0), F.lit("Neutral"), F.lit(0.9))
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", got.alias("g")).select("l_orderkey", "l_linenumber", "g.status", F.array_join("g.issues", ",").alias("issues"), "g.confidence")


@register(
    "eligible_issuers",
    "SELECT DISTINCT c_custkey, n_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderstatus IN ('F', 'P') AND c_acctbal > 0 AND n_regionkey = 1",
)
def eligible_issuers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issuers of completed documents, each once; duplicates go before the wider joins."""
    done = listings.where_all(load(spark, sf_dir, "orders"), o_orderstatus=["F", "P"]).select(F.col("o_custkey").alias("c_custkey"))
    issuers = load(spark, sf_dir, "customer").filter("c_acctbal > 0").join(done, "c_custkey", "left_semi")
    nations = load(spark, sf_dir, "nation").filter("n_regionkey = 1")
    return issuers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


@register(
    "reviewed_versions",
    """SELECT o_orderkey, r.n AS reviews, CASE WHEN r.n IS NULL THEN 'pending' WHEN r.rejected THEN 'rejected' ELSE 'accepted' END AS state FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, bool_or(l_returnflag = 'R') AS rejected FROM lineitem WHERE l_quantity > 25 GROUP BY 1) r ON l_orderkey = o_orderkey""",
)
def reviewed_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews = load(spark, sf_dir, "lineitem").filter("l_quantity > 25").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("reviews"), F.bool_or(F.col("l_returnflag") == "R").alias("rejected"))
    state = F.when(F.col("reviews").isNull(), "pending").when(F.col("rejected"), "rejected").otherwise("accepted")
    return load(spark, sf_dir, "orders").select("o_orderkey").join(reviews, "o_orderkey", "left").select("o_orderkey", "reviews", state.alias("state"))


@register(
    "leased_documents",
    "SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL 30 DAY AND l_linestatus = 'O') AS leased FROM orders",
)
def leased_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a document has a lease that still runs at its own time; the latest lease decides, so a join on pairs isn't needed."""
    until = load(spark, sf_dir, "lineitem").filter("l_linestatus = 'O'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("until"))
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").join(until, "o_orderkey", "left")
    return orders.select("o_orderkey", F.coalesce(F.col("until") > F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS"), F.lit(False)).alias("leased"))


@register("last_trades", "SELECT p_partkey, strftime(max(l_shipdate), '%Y-%m-%d') AS last_trade FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1")
def last_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = load(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_shipdate").alias("d"))
    return load(spark, sf_dir, "part").select("p_partkey").join(last, "p_partkey", "left").select("p_partkey", F.date_format("d", "yyyy-MM-dd").alias("last_trade"))


@register("prefixed", "SELECT p_partkey FROM part WHERE p_brand GLOB 'Brand#1*'")
def prefixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").filter(F.startswith("p_brand", F.lit("Brand#1"))).select("p_partkey")


@register(
    "checklist_order",
    """SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE c_mktsegment WHEN 'BUILDING' THEN 0 ELSE 1 END, c_acctbal, c_custkey) AS place FROM customer""",
)
def checklist_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list's places: the general scope first, then by age and key."""
    general = F.when(F.col("c_mktsegment") == "BUILDING", 0).otherwise(1)
    return listings.ranked(load(spark, sf_dir, "customer"), ["c_nationkey"], [general, F.col("c_acctbal"), F.col("c_custkey")], "place").select("c_nationkey", "c_custkey", "place")


@register(
    "discovery_rank",
    """SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, l_quantity, l_partkey, l_suppkey, l_linenumber) AS discovery_rank FROM lineitem""",
)
def discovery_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drivers of a model by role, depth, sheet, row and column."""
    role = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    order = [role, *map(F.col, ("l_quantity", "l_partkey", "l_suppkey", "l_linenumber"))]
    return listings.ranked(load(spark, sf_dir, "lineitem"), ["l_orderkey"], order, "discovery_rank").select("l_orderkey", "l_linenumber", "discovery_rank")


@register("artifacts", "SELECT o_orderkey, 'current' AS kind FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 'attempted' AS kind FROM orders WHERE o_totalprice > 100000")
def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    current, attempted = orders.filter("o_orderstatus = 'F'"), orders.filter("o_totalprice > 100000")
    return current.select("o_orderkey", F.lit("current").alias("kind")).unionByName(attempted.select("o_orderkey", F.lit("attempted").alias("kind")))


@register("unnested_properties", "SELECT event_id, unnest(json_keys(props)) AS key, CAST(json_extract(props, '$.k') AS BIGINT) AS value FROM events")
def unnested_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id", F.explode(F.from_json("props", "map<string,long>")).alias("key", "value"))
