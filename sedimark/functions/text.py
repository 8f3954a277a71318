"""Text functions as Column expressions; Python only where Spark has no built-in."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Runs that count as query terms.
LATIN_TERM = r"[a-z0-9][a-z0-9._/%+-]{1,}"
CJK_RUN = r"[一-鿿]{2,}"


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value reckoned once however often then names it; written out, each use would reckon it anew."""
    return F.element_at(F.transform(F.array(value), then), 1)


@F.pandas_udf(StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """Unicode compatibility composition, for which Spark has no function."""
    return values.map(lambda v: v if v is None else unicodedata.normalize("NFKC", v))


def collapsed(text: Column) -> Column:
    """White space runs to one space, ends trimmed; after nfkc this is the search form of a text."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def occurrences(text: Column, part: Column | str) -> Column:
    """Non-overlapping occurrences of a literal part; 0 for an empty part or a null text."""
    part = F.lit(part) if isinstance(part, str) else part
    removed = F.length(text) - F.length(F.replace(text, part, F.lit("")))
    return F.when(text.isNull() | (F.length(part) == 0), F.lit(0)).otherwise(F.floor(removed / F.length(part))).cast("long")


def query_terms(query: str, synonyms: dict[str, list[str]] | None = None, most: int = 64) -> list[str]:
    """The distinct search terms of a query: Latin tokens, CJK runs and their 2- to 4-grams, synonyms."""
    import re

    text = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", query)).strip().lower()
    found = re.findall(LATIN_TERM, text)
    for run in re.findall(CJK_RUN, text):
        found.append(run)
        if len(run) > 4:
            found += [run[i : i + n] for n in (2, 3, 4) for i in range(len(run) - n + 1)]
    for key, others in (synonyms or {}).items():
        if key in text:
            found += [key, *others]
    if not found:
        found = re.findall(r"[一-鿿]", text)
    return list(dict.fromkeys(found))[:most]


def lexical_score(text: Column, terms: list[str]) -> Column:
    """Sum over terms of min(5, occurrences) * max(1, min(length, 12) / 2), on the lower-cased text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    total = F.lit(0.0)
    for term in terms:
        total = total + F.least(F.lit(5), occurrences(low, term)) * max(1.0, min(len(term), 12) / 2)
    return total


def first_hit(text: Column, terms: list[str]) -> Column:
    """Position (from 1) of the earliest term, null without one."""
    low = F.lower(text)
    places = F.array(*[F.nullif(F.instr(low, t), F.lit(0)) for t in terms])
    return F.array_min(places)


def clipped(text: Column, most: int) -> Column:
    """text, or its first characters and an ellipsis where it is longer than most."""
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 3)), F.lit("..."))).otherwise(text)


def best_excerpt(text: Column, terms: list[str], most: int = 500) -> Column:
    """A stretch of most characters that starts a third of it before the earliest term."""
    start = F.greatest(F.lit(1), F.coalesce(first_hit(text, terms), F.lit(1)) - most // 3)
    return F.substr(text, start, F.lit(most))


def slug(text: Column) -> Column:
    """Lower case, with runs of other characters than letters, digits and CJK as one dash."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9_㐀-鿿]+", "-"), r"^-+|-+$", "")


def stable_id(prefix: str, *parts: Column, length: int = 24) -> Column:
    """prefix and the first characters of the SHA-256 of NUL-joined parts; nulls count as empty."""
    joined = F.concat_ws("\0", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha2(joined, 256), 1, length))


def token_estimate(text: Column) -> Column:
    """Four characters a token, rounded up."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4)


def stripped_ansi(text: Column) -> Column:
    return F.regexp_replace(text, r"\x1b\[[0-9;?]*[ -/]*[@-~]", "")


def file_extension(path: Column) -> Column:
    """The lower-case extension of a path's last part, or (none)."""
    found = F.regexp_extract(path, r"[^/\\.][^/\\]*\.([A-Za-z0-9_]+)$", 1)
    return F.when(found == "", F.lit("(none)")).otherwise(F.lower(found))


def command_key(command: Column) -> Column:
    """Program and subcommand of a shell line, without assignments and sudo."""
    bare = F.regexp_replace(F.trim(command), r"^(?:(?:[A-Za-z_]\w*=\S*|sudo)\s+)+", "")
    return F.trim(F.regexp_extract(bare, r"^(\S+(?:\s+[a-z][\w-]*)?)", 1))


def table_cell(text: Column) -> Column:
    """A value made safe for a cell of a Markdown table."""
    return F.trim(F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("|"), F.lit("\\|")), r"\s*\n\s*", " "))


def html_text(html: Column) -> Column:
    """Readable text of a page: scripts, styles and comments go, blocks end lines, entities are resolved."""
    out = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1\s*>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>|</(p|div|li|tr|h[1-6]|section|article|table)\s*>", "\n")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    out = F.regexp_replace(out, r"[ \t\r\f]+", " ")
    return F.regexp_replace(F.regexp_replace(out, r" ?\n[ \n]*", "\n"), r"^\s+|\s+$", "")
