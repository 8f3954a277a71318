"""Search, text and page queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedimark.functions.text import best_excerpt, html_text, lexical_score, occurrences, slug, stable_id
from sedimark.operators import retrieval
from sedimark.plans.registry import register
from sedimark.plans.tables import load

TERMS = ["the", "token", "password"]


@register(
    "matched_lines",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents), t AS (SELECT doc_id, line_no, trim(raw) AS line FROM l)
       SELECT doc_id, line_no, length(line) AS chars, instr(lower(line), 'token') AS "offset" FROM t WHERE contains(lower(line), 'token')""",
)
def matched_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = retrieval.matched_lines(load(spark, sf_dir, "documents").select("doc_id", "text"), "text", ["token"])
    return lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.length("line").cast("long").alias("chars"), F.col("offset").cast("long").alias("offset"))


def _score_sql() -> str:
    hits = lambda t: f"least(5, (length(low) - length(replace(low, '{t}', ''))) // {len(t)}) * {max(1.0, min(len(t), 12) / 2)}"
    return " + ".join(hits(t) for t in TERMS)


@register("lexical_scores", f"SELECT doc_id, round({_score_sql()}, 6) AS score FROM (SELECT doc_id, lower(text) AS low FROM documents) WHERE {_score_sql()} > 0")
def lexical_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.round(lexical_score(F.col("text"), TERMS), 6).alias("score")).filter("score > 0")


@register(
    "ranked_search",
    f"""WITH s AS (SELECT doc_id, {_score_sql()} AS score FROM (SELECT doc_id, lower(text) AS low FROM documents)) SELECT doc_id, round(score, 6) AS score FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 30""",
)
def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 30 best documents; the limit is the search's."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return retrieval.ranked_search(docs, {"text": 1.0}, TERMS, "doc_id", 30).select("doc_id", F.round("score", 6).alias("score"))


@register(
    "bm25",
    """WITH d AS (SELECT doc_id, (length(lower(text)) - length(replace(lower(text), 'token', ''))) // 5 AS hits, greatest(length(text) - 2, 0) AS size FROM documents),
       t AS (SELECT count(*) AS n, count(*) FILTER (hits > 0) AS w, avg(size) AS mean FROM d)
       SELECT doc_id, CAST(hits AS BIGINT) AS hits, round(-greatest(ln((n - w + 0.5) / (w + 0.5)), 1e-6) * hits * 2.2 / (hits + 1.2 * (0.25 + 0.75 * size / mean)), 6) AS score FROM d, t WHERE hits > 0""",
)
def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25(load(spark, sf_dir, "documents"), "doc_id", "text", "token").withColumn("score", F.round("score", 6))


@register(
    "excerpts",
    """SELECT doc_id, substr(text, greatest(1, instr(lower(text), 'token') - 80), 240) AS excerpt FROM documents WHERE contains(lower(text), 'token')""",
)
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").filter(F.contains(F.lower("text"), F.lit("token")))
    return docs.select("doc_id", best_excerpt(F.col("text"), ["token"], 240).alias("excerpt"))


@register("portable_scan", "SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'the') ORDER BY conv_id, turn LIMIT 200")
def portable_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 hits in order; the limit is a page of results."""
    return load(spark, sf_dir, "conversations").filter(F.contains(F.lower("text"), F.lit("the"))).select("conv_id", "turn").orderBy("conv_id", "turn").limit(200)


@register(
    "term_occurrences",
    "SELECT doc_id, (length(text) - length(replace(text, 'th', ''))) // 2 AS n FROM documents",
)
def term_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", occurrences(F.col("text"), "th").alias("n"))


@register(
    "bigram_similarity",
    r"""WITH t AS (SELECT conv_id, turn, lower(regexp_replace(coalesce(text, ''), '[ \t\n\r\f\v]+', '', 'g')) AS x FROM conversations),
       g AS (SELECT conv_id, turn, CASE WHEN length(x) < 2 THEN [x] ELSE list_distinct([substr(x, CAST(i AS BIGINT), 2) FOR i IN range(1, length(x))]) END AS b FROM t)
       SELECT a.conv_id, a.turn, floor(len(list_intersect(a.b, c.b)) / len(list_distinct(list_concat(a.b, c.b))) * 10000 + 0.5) / 10000 AS similarity FROM g a JOIN g c ON a.conv_id = c.conv_id AND c.turn = a.turn + 1""",
)
def bigram_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn against the next one."""
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    return turns.join(following, ["conv_id", "turn"]).select("conv_id", "turn", retrieval.bigram_jaccard(F.col("text"), F.col("next")).alias("similarity"))


@register(
    "link_targets",
    """SELECT page_id, len(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS links, len(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS targets FROM pages""",
)
def link_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return load(spark, sf_dir, "pages").select("page_id", F.size(found).cast("long").alias("links"), F.size(F.array_distinct(found)).cast("long").alias("targets"))


@register("page_text")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", html_text(F.col("html")).alias("text"))


@register(
    "stable_ids",
    r"""SELECT page_id, 'page_' || substr(sha256(coalesce(url, '') || chr(0) || CAST(page_id AS VARCHAR)), 1, 24) AS id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9_\x{3400}-\x{9fff}]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM pages""",
)
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", stable_id("page_", F.col("url"), F.col("page_id")).alias("id"), slug(F.col("url")).alias("slug"))


@register(
    "json_properties",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 50""",
)
def json_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k")).filter("k > 50")


@register(
    "context_lines",
    """WITH h AS (SELECT conv_id, turn FROM conversations WHERE role = 'system'), n AS (SELECT DISTINCT c.conv_id, c.turn, c.role FROM conversations c JOIN h ON c.conv_id = h.conv_id AND c.turn BETWEEN h.turn - 1 AND h.turn + 1) SELECT * FROM n""",
)
def context_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("line_no"), "role")
    return retrieval.with_context(lines, lines.filter("role = 'system'"), ["conv_id"], 1).select("conv_id", F.col("line_no").alias("turn"), "role")


@register(
    "folded_pages",
    """SELECT page_id, CAST(row_number() OVER (ORDER BY url, page_id) AS BIGINT) AS place FROM (SELECT * FROM pages WHERE length(html) >= 3000) QUALIFY place BETWEEN 11 AND 40""",
)
def folded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second to fourth ten result pages; short ones are folded and take no place. The window is the query's."""
    pages = load(spark, sf_dir, "pages")
    shown = retrieval.folded_pages(pages.select("page_id", "url", "html"), ["url", "page_id"], F.length("html") < 3000, 10, 30)
    return shown.select("page_id", (F.row_number().over(Window.orderBy("url", "page_id")) + 10).cast("long").alias("place"))
