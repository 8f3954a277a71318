"""Landed feeds: columnar JSON, HTML tables, nested catalogs, market tables, wide statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILINGS = "struct<accessionNumber:array<string>,filingDate:array<string>,form:array<string>,primaryDocument:array<string>>"


def _checked(df: DataFrame, holds: Column, message: str, refuse: bool) -> DataFrame:
    """The rows of df where holds; with refuse, the job fails with the message at any other."""
    holds = F.coalesce(holds, F.lit(False))
    return df.filter(F.assert_true(holds, message).isNull()) if refuse else df.filter(holds)


def _even_filings() -> Column:
    n = F.size("c.accessionNumber")
    return (F.size("c.filingDate") == n) & (F.size("c.form") == n) & (F.size("c.primaryDocument") == n)


def bad_filings(raw: DataFrame) -> DataFrame:
    """The rows that filings() leaves out or refuses: broken JSON and arrays of unequal lengths."""
    return raw.withColumn("c", F.from_json("json", FILINGS)).filter(~F.coalesce(_even_filings(), F.lit(False))).drop("c")


def filings(raw: DataFrame, forms: list[str], start: str, end: str, refuse: bool = False) -> DataFrame:
    """Rows of columnar filings JSON (column json) of wanted forms and days, one row an accession.

    Broken JSON and uneven arrays are left out and listed by bad_filings(), or refused.
    """
    parsed = raw.withColumn("c", F.from_json("json", FILINGS))
    even = _checked(parsed, _even_filings(), "filings whose columns aren't of one length", refuse)
    rows = even.select(*[k for k in raw.columns if k != "json"], F.inline(F.arrays_zip(*[F.col(f"c.{k}").alias(k) for k in ("accessionNumber", "filingDate", "form", "primaryDocument")])))
    named = rows.select(*[k for k in raw.columns if k != "json"], F.col("accessionNumber").alias("external_id"), F.try_to_date("filingDate", "yyyy-MM-dd").alias("filed"), "form", F.col("primaryDocument").alias("document"))
    return named.filter(F.col("form").isin(forms) & F.col("filed").between(start, end)).dropDuplicates(["external_id"])


def html_rows(pages: DataFrame, html: str = "html", most: int = 1000) -> DataFrame:
    """row_no and cells of each table row of a page; a page of more than most rows is refused, not cut."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    pages = _checked(pages, F.coalesce(F.size(rows), F.lit(0)) <= most, "a page with too many table rows", True)
    exploded = pages.select(*[c for c in pages.columns if c != html], F.posexplode(rows).alias("row_no", "_row"))
    cells = F.regexp_extract_all("_row", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1))
    bare = F.transform(cells, lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", " "), r"\s+", " ")))
    return exploded.withColumn("cells", bare).drop("_row")


MODELS = "map<string,struct<name:string,api:string,models:map<string,struct<id:string,name:string,reasoning:boolean,limit:struct<context:long,output:long>,cost:struct<input:double,output:double,cache_read:double,cache_write:double>>>>>"


def model_catalog(raw: DataFrame) -> DataFrame:
    """A row for each provider and model of a nested catalog (column json)."""
    providers = raw.select(F.explode(F.from_json("json", MODELS)).alias("provider", "p"))
    return providers.select("provider", F.explode("p.models").alias("model", "m")).select("provider", "model", F.col("m.name").alias("name"), F.col("m.limit.context").alias("context"), F.col("m.cost.input").alias("cost_input"), F.col("m.cost.output").alias("cost_output"))


def market_table(raw: DataFrame, refuse: bool = False) -> DataFrame:
    """date, field and value of a market answer (column json: columns, data); answers with broken JSON, repeated columns or rows of another length are left out, or refused."""
    parsed = raw.withColumn("t", F.from_json("json", "struct<columns:array<string>,data:array<array<string>>>")).select("t.*")
    width = F.size("columns")
    checked = _checked(parsed, (F.size(F.array_distinct("columns")) == width) & F.forall("data", lambda r: F.size(r) == width), "a market table that isn't even", refuse)
    rows = checked.select("columns", F.explode("data").alias("r"))
    return rows.select(F.col("r")[0].alias("date"), F.posexplode("r").alias("i", "v"), "columns").filter("i > 0").select(F.try_to_date("date", "yyyy-MM-dd").alias("date"), F.col("columns")[F.col("i")].alias("field"), F.col("v").try_cast("double").alias("value"))


def long_facts(wide: DataFrame, ids: list[str]) -> DataFrame:
    """metric and value rows of a wide statement; empty cells give no row."""
    metrics = [c for c in wide.columns if c not in ids]
    return wide.unpivot(ids, metrics, "metric", "value").filter("value IS NOT NULL")


def with_overrides(base: DataFrame, overrides: DataFrame, keys: list[str], value: str) -> DataFrame:
    """base with the value of overrides where there is one, and the rows that only overrides have."""
    new = overrides.select(*keys, F.col(value).alias("_new"))
    return base.join(new, keys, "full_outer").withColumn(value, F.coalesce("_new", value)).drop("_new")
