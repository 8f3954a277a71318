"""Pages around a hit, lines from glyphs, document filters and clean-up of failed loads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def any_of(df: DataFrame, column: str, names: list[str] | None) -> DataFrame:
    """Rows with one of the names; None filters nothing, an empty list leaves nothing."""
    return df if names is None else df.filter(F.col(column).isin(names))


def page_context(hits: DataFrame, pages: DataFrame, radius: int, max_chars: int, least: int = 800, most: int = 3500) -> DataFrame:
    """hit_id, page_number, text and truncated of the pages around each hit (hit_id, doc_id, page_start, page_end).

    A hit's pages share max_chars evenly, between least and most a page. A hit
    lists its page numbers, so pages (doc_id, page_number, text) are found by an
    equal join and a long document isn't compared with its hits.
    """
    around = F.sequence(F.greatest(F.lit(1).cast("long"), F.col("page_start").cast("long") - radius), F.col("page_end").cast("long") + radius)
    wanted = hits.filter("page_start <= page_end").select("hit_id", "doc_id", F.explode(around).alias("page_number"))
    found = wanted.join(pages.select("doc_id", F.col("page_number").cast("long").alias("page_number"), F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text")), ["doc_id", "page_number"])
    budget = F.least(F.lit(most), F.greatest(F.lit(least), F.floor(F.lit(max_chars) / F.col("_pages")))).cast("int")
    counts = found.groupBy("hit_id").agg(F.count("*").alias("_pages"))
    sized = found.join(counts, "hit_id").withColumn("_budget", budget)
    long = F.length("text") > F.col("_budget")
    clipped = F.when(long, F.concat(F.rtrim(F.left("text", F.col("_budget") - 1)), F.lit("…"))).otherwise(F.col("text"))
    return sized.select("hit_id", "page_number", clipped.alias("text"), F.coalesce(long, F.lit(False)).alias("truncated"))


def trimmed_line(text: Column, hit: Column, most: int = 240) -> Column:
    """At most that many characters of a line, a third of them before the hit (counted from 0), with marks where it is cut."""
    start = F.greatest(F.lit(0), F.least(hit - most // 3, F.length(text) - most)).cast("int")
    body = F.substr(text, start + 1, F.lit(most))
    cut = F.concat(F.when(start > 0, "…").otherwise(""), body, F.when(start + most < F.length(text), "…").otherwise(""))
    return F.when(F.length(text) <= most, text).otherwise(cut)


def newest_first(docs: DataFrame, date: str, name: str) -> DataFrame:
    """Latest dates first, rows without one last, names in order within a day."""
    blank = F.coalesce(F.trim(F.col(date)) == "", F.lit(True))
    return docs.orderBy(blank, F.desc(date), name)


def orphaned(docs: DataFrame, jobs: DataFrame, pages: DataFrame, before: str) -> DataFrame:
    """Registered documents (doc_id, registered_at) older than before that no open job lists and no page belongs to.

    jobs has status and files, a JSON array of objects with a docId.
    """
    listed = jobs.filter(F.col("status").isin("queued", "running")).select(F.explode(F.from_json("files", "array<struct<docId:string>>")).alias("f")).select(F.col("f.docId").alias("doc_id"))
    old = docs.filter((F.col("status") == "registered") & (F.col("registered_at") < F.lit(before).cast("timestamp")))
    return old.join(listed.distinct(), "doc_id", "left_anti").join(pages.select("doc_id").distinct(), "doc_id", "left_anti")


def gap_groups(tokens: DataFrame, line: list[str], gap: float) -> DataFrame:
    """Tokens (x, width) of each line with group_no: a group ends where the next token starts beyond gap from all before."""
    order = Window.partitionBy(*line).orderBy("x", "width")
    right = F.max(F.col("x") + F.col("width")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = tokens.withColumn("_new", F.when(F.col("x") - right > gap, 1).otherwise(0))
    return marked.withColumn("group_no", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new")


def text_lines(tokens: DataFrame, page: list[str], typical_height: float) -> DataFrame:
    """page, line_no, text and center of the lines of each page's tokens (x, y, width, height, text).

    Tokens come by their centre; one belongs to the line before if its centre is
    near the mean of that line's. A page's tokens are folded in one array: a page
    is bounded by what a sheet holds.
    """
    near = max(1.75, typical_height * 0.45)
    center = F.col("y") + F.col("height") / 2
    token = F.struct(center.cast("double").alias("c"), F.col("x").cast("double").alias("x"), "text")
    start = F.struct(F.lit(-1).alias("line"), F.lit(0.0).alias("n"), F.lit(0.0).alias("total"), F.array().cast("array<struct<line:int,c:double,x:double,text:string>>").alias("out"))

    def step(s: Column, t: Column) -> Column:
        same = (s["n"] > 0) & (F.abs(s["total"] / s["n"] - t["c"]) <= near)
        line = F.when(same, s["line"]).otherwise(s["line"] + 1)
        placed = F.struct(line.alias("line"), t["c"].alias("c"), t["x"].alias("x"), t["text"].alias("text"))
        return F.struct(line.alias("line"), F.when(same, s["n"] + 1).otherwise(1.0).alias("n"), F.when(same, s["total"] + t["c"]).otherwise(t["c"]).alias("total"), F.array_append(s["out"], placed).alias("out"))

    folded = tokens.groupBy(*page).agg(F.aggregate(F.array_sort(F.collect_list(token)), start, step)["out"].alias("t"))
    rows = folded.select(*page, F.inline("t"))
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "text"))), lambda t: t["text"]), " ")
    return rows.groupBy(*page, F.col("line").alias("line_no")).agg(words.alias("text"), F.avg("c").alias("center"))


def rectangles(cells: DataFrame, sheet: list[str]) -> DataFrame:
    """The rectangles that the cells (row_index, col_index) of a sheet fill: runs of columns, joined where rows follow on another with the same run."""
    across = Window.partitionBy(*sheet, "row_index").orderBy("col_index")
    runs = cells.select(*sheet, "row_index", "col_index").distinct().withColumn("_run", F.col("col_index") - F.row_number().over(across))
    spans = runs.groupBy(*sheet, "row_index", "_run").agg(F.min("col_index").alias("col_start"), F.max("col_index").alias("col_end"))
    down = Window.partitionBy(*sheet, "col_start", "col_end").orderBy("row_index")
    stacked = spans.withColumn("_stack", F.col("row_index") - F.row_number().over(down))
    return stacked.groupBy(*sheet, "col_start", "col_end", "_stack").agg(F.min("row_index").alias("row_start"), F.max("row_index").alias("row_end")).drop("_stack")
