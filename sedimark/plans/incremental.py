"""Queries over streams, and folds that SQL can't express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimark.functions.matching import fuzzy, greedy_windows
from sedimark.functions.numbers import backoff_ms, column_label, column_number, half_up, iso_date, period, positive, quantity
from sedimark.functions.storage import shared_folder
from sedimark.operators import catalog
from sedimark.plans.registry import register
from sedimark.plans.tables import cents, load
from sedimark.streaming import feeds


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = load(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir) if not _is_folder(spark, f"{sf_dir}/events.parquet") else spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory()


@register(
    "stream_running_totals",
    "SELECT user_id, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cost FROM events GROUP BY 1",
)
def stream_running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "stream")
    totals = feeds.running_totals(_event_stream(spark, sf_dir), ["user_id"], {"cost": cents("value")})
    feeds.drained(totals, feeds.parquet_sink(f"{folder}/out"), f"{folder}/state", "complete")
    written = spark.read.parquet(f"{folder}/out")
    return written.filter(F.col("batch") == written.agg(F.max("batch")).first()[0]).drop("batch")


@register("stream_deduplicated", "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, ts FROM events) GROUP BY 1, 2")
def stream_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "stream")
    stream = feeds.deduplicated(_event_stream(spark, sf_dir), ["user_id", "event_type", "ts"], "ts", "60 days")
    feeds.drained(stream, feeds.parquet_sink(f"{folder}/out"), f"{folder}/state")
    return spark.read.parquet(f"{folder}/out").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@register(
    "greedy_windows",
    """WITH RECURSIVE t AS (SELECT conv_id, turn, length(text) AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn, length(text)) AS r FROM conversations WHERE length(text) > 0),
       f AS (SELECT conv_id, turn, r, s AS used, 0 AS w FROM t WHERE r = 1
             UNION ALL SELECT t.conv_id, t.turn, t.r, CASE WHEN f.used + t.s > 400 THEN t.s ELSE f.used + t.s END, f.w + CASE WHEN f.used + t.s > 400 THEN 1 ELSE 0 END FROM f JOIN t ON t.conv_id = f.conv_id AND t.r = f.r + 1)
       SELECT conv_id, turn, CASE WHEN w < 12 THEN w END AS "window" FROM f""",
)
def page_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns packed into windows of 400 characters of their conversation."""
    return greedy_windows(load(spark, sf_dir, "conversations"), ["conv_id"], "turn", F.length("text"), 400)


_STARTS = "(CASE WHEN {0} = 1 OR regexp_matches(low[{0} - 1], '[\\s_./:-]') THEN -10 ELSE 0 END)"


@register(
    "fuzzy_ranking",
    f"""WITH p AS (SELECT p_partkey, lower(p_name) AS low FROM part),
        a AS (SELECT *, instr(low, 'r') AS r, instr(low, 'g') AS g FROM p),
        b AS (SELECT *, r + instr(substr(low, r + 1), 'e') AS e FROM a WHERE r > 0 AND g > 0 AND instr(substr(low, r + 1), 'e') > 0),
        s AS (SELECT p_partkey, CASE WHEN r = 1 THEN -5.0 ELSE 0 END + CASE WHEN e = r + 1 THEN -5.0 * (CASE WHEN r = 1 THEN 2 ELSE 1 END) ELSE 2.0 * (e - r - 1) END + {_STARTS.format("r")} + {_STARTS.format("e")} + 0.1 * (r + e - 2)
               + CASE WHEN low = 're' THEN -100 ELSE 0 END + CASE WHEN g = 1 THEN -5.0 ELSE 0 END + {_STARTS.format("g")} + 0.1 * (g - 1) + CASE WHEN low = 'g' THEN -100 ELSE 0 END AS raw FROM b) SELECT p_partkey, round(raw, 6) AS score FROM s""",
)
def fuzzy_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose names match both words, with the score to six digits."""
    return load(spark, sf_dir, "part").select("p_partkey", F.round(fuzzy(F.col("p_name"), "re/g"), 6).alias("score")).filter("score IS NOT NULL")


@register(
    "active_documents",
    "SELECT doc_id FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS r FROM documents WHERE lang <> 'de') WHERE r = 1",
)
def active_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current document of each source, retired ones left out."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    newest = docs.filter("lang <> 'de'").groupBy("source").agg(F.max("doc_id").alias("newest"))
    marked = docs.join(newest, "source", "left").withColumns({"is_current": (F.col("doc_id") == F.col("newest")).cast("int"), "lifecycle_state": F.when(F.col("lang") == "de", "retired").otherwise("active")})
    return marked.filter(catalog.active(marked)).select("doc_id")


@register("numeric_guards", "SELECT count(*) AS n, CAST(sum(CAST(floor(o_totalprice * 10 + 0.5) AS BIGINT)) AS BIGINT) AS tenths FROM orders WHERE o_totalprice > 0 AND o_totalprice <= 1e12")
def numeric_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").filter(positive(F.col("o_totalprice")))
    return orders.agg(F.count("*").alias("n"), F.sum((half_up(F.col("o_totalprice"), 1) * 10).cast("long")).alias("tenths"))


@register("backoff", "SELECT l_linenumber AS attempts, CAST(least(3600000, pow(2, least(l_linenumber, 10)) * 30000) AS BIGINT) AS wait_ms, count(*) AS n FROM lineitem GROUP BY 1, 2")
def backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("attempts")).agg(F.count("*").alias("n")).withColumn("wait_ms", backoff_ms(F.col("attempts")))


@register("column_labels", "SELECT p_partkey, p_partkey AS back FROM part")
def column_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column labels there and back, of every part's number."""
    return load(spark, sf_dir, "part").select("p_partkey", column_number(column_label(F.col("p_partkey"))).cast("long").alias("back"))


@register(
    "periods",
    """SELECT o_orderkey, CASE WHEN year(o_orderdate) >= 2000 THEN strftime(o_orderdate, '%Y') || 'Q' || quarter(o_orderdate) ELSE 'Q' || quarter(o_orderdate) || strftime(o_orderdate, '%Y') END AS quarter,
              CASE WHEN year(o_orderdate) >= 2000 THEN 'FY' || strftime(o_orderdate, '%Y') ELSE strftime(o_orderdate, '%Y') || '年' END AS fiscal FROM orders""",
)
def periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical periods from two spellings; years before 2000 are no periods and stay as written."""
    year = F.date_format("o_orderdate", "yyyy")
    return load(spark, sf_dir, "orders").select("o_orderkey", period(F.concat(F.lit("Q"), F.quarter("o_orderdate"), year)).alias("quarter"), period(F.concat(year, F.lit("年"))).alias("fiscal"))


#: Spellings of a year's third quarter, second half and whole, and of a range of three years: {y} has four digits, {z} the last two.
SPELLINGS = {
    "{y}Q3": ("{y}Q3", "Q3{y}", "3Q{y}", "{y}第三季度", "{y} 年 3 季", "Q3FY{z}", "3q{z}E", "{y}Ｑ３"),
    "{y}H2": ("{y}H2", "H2 {y}", "2H{z}", "下半年{y}", "{y}年下半年"),
    "FY{y}": ("{y}", "FY{y}", "fy{z}", "{z}E", "{y}年度", "{z}年", "{y}/12"),
    "FY{y}-FY{w}": ("{y}-{w}", "FY{y}-{v}", "{y}～{w}年", "{y} 至 {v}"),
}
_EACH = [(written, canonical) for canonical, several in SPELLINGS.items() for written in several]


def _spelled_sql(template: str, year: str) -> str:
    parts = f"replace(replace('{template}', '{{y}}', CAST({year} AS VARCHAR)), '{{z}}', right(CAST({year} AS VARCHAR), 2))"
    return f"replace(replace({parts}, '{{w}}', CAST({year} + 2 AS VARCHAR)), '{{v}}', right(CAST({year} + 2 AS VARCHAR), 2))"


@register(
    "period_spellings",
    f"""WITH o AS (SELECT o_orderkey, 2000 + o_custkey % 80 AS year, o_orderkey % {len(_EACH)} AS k FROM orders)
        SELECT o_orderkey, CASE k {" ".join(f"WHEN {k} THEN {_spelled_sql(canonical, 'year')}" for k, (_, canonical) in enumerate(_EACH))} END AS period FROM o""",
)
def period_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The period of each order from one of the spellings of years 2000 to 2079."""
    year = (F.pmod("o_custkey", F.lit(80)) + 2000).cast("int")
    form = lambda text, mark, value: F.replace(text, F.lit(mark), value)
    written = F.element_at(F.array(*[F.lit(w) for w, _ in _EACH]), (F.pmod("o_orderkey", F.lit(len(_EACH))) + 1).cast("int"))
    for mark, of in (("{y}", year), ("{w}", year + 2)):
        written = form(written, mark, of.cast("string"))
    for mark, of in (("{z}", year), ("{v}", year + 2)):
        written = form(written, mark, F.right(of.cast("string"), F.lit(2)))
    return load(spark, sf_dir, "orders").select("o_orderkey", period(written).alias("period"))


#: A unit, the currency beside it, and what a value of it is in canonical units.
UNIT_SPELLINGS = (
    ("亿元", "", 1e8, "元", "CNY"), ("$bn", "", 1e9, "元", "USD"), ("USD mn", "", 1e6, "元", "USD"), ("£", "", 1.0, "元", "GBP"), ("€ k", "", 1e3, "元", "EUR"), ("千万港币", "", 1e7, "元", "HKD"), ("万", "rmb", 1e4, "元", "CNY"),
    ("％", "", 1.0, "%", None), ("pct", "", 1.0, "%", None), ("bps", "", 0.01, "pp", None), ("个百分点", "", 1.0, "pp", None), ("ppts", "", 1.0, "pp", None), ("times", "", 1.0, "x", None), ("×", "", 1.0, "x", None), ("倍", "", 1.0, "x", None),
    ("每股元", "", 1.0, "元/股", "CNY"), ("HK$/share", "", 1.0, "元/股", "HKD"), ("GW", "", 1.0, "gw", None), ("万台", "US$", 1.0, "万台", "USD"), ("美元/吨", "", 1.0, "美元/吨", None),
)


@register(
    "unit_spellings",
    f"""WITH u AS (SELECT * FROM (VALUES {", ".join(f"({k}, {f}, '{u}', {'NULL' if c is None else repr(c)})" for k, (_, _, f, u, c) in enumerate(UNIT_SPELLINGS))}) t(k, factor, unit, currency))
        SELECT l_orderkey, l_linenumber, round(l_quantity * factor, 4) AS value, unit, currency FROM lineitem JOIN u ON u.k = l_partkey % {len(UNIT_SPELLINGS)}""",
)
def unit_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quantity of each line item from one of the spellings of its unit."""
    pick = lambda n: F.element_at(F.array(*[F.lit(x[n]) for x in UNIT_SPELLINGS]), (F.pmod("l_partkey", F.lit(len(UNIT_SPELLINGS))) + 1).cast("int"))
    q = quantity(F.col("l_quantity"), pick(0), pick(1))
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", q.alias("q"))
    return rows.select("l_orderkey", "l_linenumber", F.round("q.value", 4).alias("value"), F.col("q.unit").alias("unit"), F.col("q.currency").alias("currency"))


@register("valid_dates", "SELECT count(*) AS n, strftime(max(l_shipdate), '%Y-%m-%d') AS last FROM lineitem")
def valid_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = iso_date(F.date_format("l_shipdate", "yyyyMMdd"))
    return load(spark, sf_dir, "lineitem").agg(F.count(day).alias("n"), F.max(day).cast("string").alias("last"))
