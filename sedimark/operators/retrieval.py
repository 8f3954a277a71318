"""Searching documents by line, by score and by overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimark.functions.text import first_hit, lexical_score, occurrences


def matched_lines(pages: DataFrame, text: str, needles: list[str]) -> DataFrame:
    """A row for each trimmed line that has a needle (any case): line_no, line, first offset and the needles found."""
    low = [n.lower() for n in needles]
    lines = pages.select(*[c for c in pages.columns if c != text], F.posexplode(F.split(F.col(text), r"\r?\n")).alias("line_no", "_line")).withColumn("line", F.trim("_line")).drop("_line")
    found = F.filter(F.array(*[F.lit(n) for n in low]), lambda n: F.contains(F.lower("line"), n))
    return lines.withColumn("matched", found).filter(F.size("matched") > 0).withColumn("offset", first_hit(F.col("line"), low))


def best_lines(lines: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The lines of each page with most needles, at most so many, in page order."""
    w = Window.partitionBy(*keys).orderBy(F.desc(F.size("matched")), "line_no")
    return lines.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).drop("_r")


def folded_pages(pages: DataFrame, order: list[str], folded: Column, offset: int, most: int) -> DataFrame:
    """A window of result pages; folded ones take no place in it and are left out."""
    w = Window.orderBy(*order)
    eligible = pages.filter(~folded).orderBy(*order).limit(offset + most)
    return eligible.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") > offset).drop("_r")


def ranked_search(rows: DataFrame, fields: dict[str, float], terms: list[str], citation: str, k: int) -> DataFrame:
    """The k best rows by weighted lexical score; rows without a hit are left out."""
    score = F.lit(0.0)
    for field, weight in fields.items():
        score = score + weight * lexical_score(F.col(field), terms)
    return rows.withColumn("score", score).filter(F.col("score") > 0).orderBy(F.desc("score"), citation).limit(k)


def bm25(docs: DataFrame, doc_id: str, text: str, phrase: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """doc_id, hits and score of the documents with the phrase, by BM25 over trigram lengths.

    A smaller score is better, as scores are negative.
    """
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(doc_id, occurrences(low, phrase.lower()).alias("hits"), F.greatest(F.length(low) - 2, F.lit(0)).alias("_size"))
    total = rows.agg(F.count("*").alias("_n"), F.count_if(F.col("hits") > 0).alias("_with"), F.avg("_size").alias("_mean"))
    joined = rows.filter("hits > 0").crossJoin(F.broadcast(total))  # one row of totals
    idf = F.greatest(F.log((F.col("_n") - F.col("_with") + 0.5) / (F.col("_with") + 0.5)), F.lit(1e-6))
    tf = F.col("hits") * (k1 + 1) / (F.col("hits") + k1 * (1 - b + b * F.col("_size") / F.col("_mean")))
    return joined.select(doc_id, "hits", (-idf * tf).alias("score"))


def bigrams(text: Column) -> Column:
    """The distinct pairs of adjacent characters of a text without white space."""
    bare = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", ""))
    chars = F.split(bare, "")
    pairs = F.zip_with(F.slice(chars, F.lit(1), F.size(chars) - 1), F.slice(chars, F.lit(2), F.size(chars) - 1), lambda a, b: F.concat(a, b))
    return F.when(F.length(bare) < 2, F.array(bare)).otherwise(F.array_distinct(pairs))


def bigram_jaccard(a: Column, b: Column) -> Column:
    """Shared bigrams over all bigrams, to four places."""
    x, y = bigrams(a), bigrams(b)
    return F.floor(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)) * 10_000 + 0.5) / 10_000


def with_context(lines: DataFrame, hits: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """Lines within radius of a hit, once each: hits name their neighbours, so the join is on equal line numbers."""
    near = hits.select(*keys, F.explode(F.sequence(F.col("line_no") - radius, F.col("line_no") + radius)).alias("line_no")).distinct()
    return lines.join(near, [*keys, "line_no"], "left_semi")
