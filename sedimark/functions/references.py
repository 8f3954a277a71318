"""Ids, citations and places of sources, and edits of text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sedimark.functions.text import nfkc, occurrences


def citation(filename: Column, page_start: Column, page_end: Column, sheet: Column, cells: Column, line_start: Column, line_end: Column, block: Column) -> Column:
    """A source's name and place: pages go first, then cells, a sheet, lines and a block; the name alone without a place."""
    name = F.coalesce(filename, F.lit("unknown source"))
    pages = F.when(page_end.isNotNull() & (page_end != page_start), F.concat(name, F.lit(" p."), page_start, F.lit("-"), page_end)).otherwise(F.concat(name, F.lit(" p."), page_start))
    named, ranged = sheet.isNotNull() & (sheet != ""), cells.isNotNull() & (cells != "")
    return (
        F.when(page_start.isNotNull(), pages)
        .when(named & ranged, F.concat(name, F.lit(" "), sheet, F.lit("!"), cells))
        .when(named, F.concat(name, F.lit(" "), sheet))
        .when(line_start.isNotNull(), F.concat(name, F.lit(":"), line_start, F.lit("-"), F.coalesce(line_end, line_start)))
        .when(block.isNotNull(), F.concat(name, F.lit(" #"), block))
        .otherwise(name)
    )


def source_id(doc_id: Column, kind: str, *place: Column) -> Column:
    """source: and the URL-safe base-64 form of the JSON array of document, kind and place.

    kind is pdf (first and last page), excel (sheet and range), text (first and last
    line) or block (its number); the place of excel is text, that of others whole numbers.
    """
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    parts = [quoted(c) if kind == "excel" else c.cast("string") for c in place]
    fields = F.concat(F.lit("["), F.concat_ws(",", quoted(doc_id), F.lit(f'"{kind}"'), *parts), F.lit("]"))
    plain = F.regexp_replace(F.base64(F.encode(fields, "UTF-8")), r"[=\s]", "")
    return F.concat(F.lit("source:"), F.translate(plain, "+/", "-_"))


def parsed_source(source: Column) -> Column:
    """struct(doc_id, kind, first, last) of a source_id; null for what isn't one."""
    body = F.translate(F.substr(source, F.lit(8)), "-_", "+/")
    padded = F.concat(body, F.repeat(F.lit("="), F.pmod(-F.length(body), F.lit(4))))
    fields = F.from_json(F.try_to_binary(padded, F.lit("base64")).cast("string"), "array<string>")
    kind, first, last = F.get(fields, F.lit(1)), F.get(fields, F.lit(2)), F.get(fields, F.lit(3))
    low, high = first.try_cast("long"), last.try_cast("long")
    spans = kind.isin("pdf", "text") & (F.size(fields) == 4) & (low >= 1) & (high >= low)
    cells = (kind == "excel") & (F.size(fields) == 4) & F.length(first).between(1, 255) & last.rlike(r"^\$?[A-Za-z]{1,3}\$?[0-9]+(:\$?[A-Za-z]{1,3}\$?[0-9]+)?$")
    block = (kind == "block") & (F.size(fields) == 3) & (low >= 1)
    good = source.rlike("^source:[A-Za-z0-9_-]+$") & (F.length(source) <= 2048) & F.get(fields, F.lit(0)).rlike("^[A-Za-z0-9_-]{1,128}$") & (spans | cells | block)
    return F.when(good, F.struct(F.get(fields, F.lit(0)).alias("doc_id"), kind.alias("kind"), first.alias("first"), last.alias("last")))


def phrase(query: Column) -> Column:
    """A query as one quoted phrase; quotes in it are doubled."""
    return F.concat(F.lit('"'), F.replace(query, F.lit('"'), F.lit('""')), F.lit('"'))


#: Spaces of all kinds as a regex class's inside: no-break, en to hair, narrow, medium mathematical, ideographic.
_SPACES = r"\u00A0\u2002-\u200A\u202F\u205F\u3000"


def plain_text(text: Column) -> Column:
    """NFKC without white space at lines' ends, with plain quotes, dashes and spaces."""
    out = F.regexp_replace(nfkc(text), rf"(?m)[ \t\f\r\x0B{_SPACES}]+$", "")
    out = F.translate(out, "\u2018\u2019\u201a\u201b\u201c\u201d\u201e\u201f", "'" * 4 + '"' * 4)
    out = F.translate(out, "\u2010\u2011\u2012\u2013\u2014\u2015\u2212", "-------")
    return F.regexp_replace(out, f"[{_SPACES}]", " ")


def found_text(content: Column, old: Column) -> Column:
    """struct(place, loose, times) of old in content: where it starts (from 0, -1 if nowhere) and how often its plain form stands there.

    The text as it is goes first; loose tells that only plain forms agree, and the
    place is then one in the plain form. An edit may be made only where times is 1.
    """
    exact, a, b = F.position(old, content) - 1, plain_text(content), plain_text(old)
    loose = F.position(b, a) - 1
    return F.struct(
        F.when(exact >= 0, exact).otherwise(loose).cast("int").alias("place"), ((exact < 0) & (loose >= 0)).alias("loose"), F.when(F.length(b) > 0, occurrences(a, b)).otherwise(0).cast("long").alias("times"),
    )


def percent_base(value: Column, number_format: Column, shown: Column) -> Column:
    """A percentage as a fraction: stored fractions are known by a % in the number format or the value as shown.

    A value up to 1 without such a sign could be either; it is null.
    """
    bare = F.regexp_replace(F.coalesce(number_format, F.lit("")), r'"[^"]*"|\\.', "")
    fraction = F.contains(bare, F.lit("%")) | F.coalesce(F.trim(shown).rlike(r"^[-+]?\d[\d,]*(\.\d+)?\s*%$"), F.lit(False))
    return F.when(fraction, value).when(F.abs(value) > 1, value / 100)
