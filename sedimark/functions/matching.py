"""Fuzzy matching, edit size, formula references and greedy windows."""

from __future__ import annotations

import os
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimark.functions.folds import folded
from pyspark.sql.types import LongType

_TOKEN = re.compile(r"""(?P<text>"(?:[^"]|"")*")|(?P<error>\#(?:REF|NAME|VALUE|DIV/0|N/A|NUM|NULL)[!?]?)|(?P<book>\[[^\]]+\])?(?:(?P<sheet>'(?:[^']|'')+'|[A-Za-z_][\w.]*(?::[A-Za-z_][\w.]*)?)!)?(?P<ref>\$?[A-Za-z]{1,3}\$?\d+(?::\$?[A-Za-z]{1,3}\$?\d+)?|\$?[A-Za-z]{1,3}:\$?[A-Za-z]{1,3}|\$?\d+:\$?\d+)(?![\w(])|(?P<name>[A-Za-z_\\][\w.]*(?:\[[^\]]*\])?)(?P<call>\()?""")


#: What characters a word starts after, and what a match's parts count for.
WORD_BREAKS, RUN, GAP, START, LATE, WHOLE, SWAPPED = r"[\s\-_./:]", -5.0, 2.0, -10.0, 0.1, -100.0, 5.0


def _score_of(query: str, low: Column) -> Column:
    """Each character of the query is found at its first place after the one before; the score is made of these places."""
    n = len(query)
    places = F.aggregate(F.array(*map(F.lit, query)), F.array(F.lit(0)), lambda found, c: F.array_append(found, F.nullif(F.call_function("locate", c, low, F.element_at(found, -1) + 1), F.lit(0))))
    at = F.slice(places, 2, n)
    # A 1 for each character right behind the one before: in a run of r of them the first counts once, the next twice.
    behind = F.array_join(F.zip_with(at, F.slice(places, 1, n), lambda a, b: F.when(a == b + 1, "1").otherwise("0")), "")
    runs = F.aggregate(F.split(behind, "0"), F.lit(0.0), lambda total, r: total + F.length(r) * (F.length(r) + 1) / 2)
    gaps = F.element_at(at, -1) - F.element_at(at, 1) - (n - 1)
    starts = F.size(F.filter(at, lambda p: (p == 1) | F.substr(low, p - 1, F.lit(1)).rlike(WORD_BREAKS)))
    late = F.aggregate(at, F.lit(0), lambda total, p: (total + p - 1).cast("int"))
    score = RUN * runs + GAP * gaps + START * starts + LATE * late + F.when(low == query, WHOLE).otherwise(0.0)
    return F.when(F.element_at(places, -1).isNotNull(), score)


def fuzzy_score(query: str, text: Column) -> Column:
    """Less is better, null is no match: runs and word starts count for a match, gaps and distance against it.

    A query of letters and digits that doesn't match is tried the other way round.
    """
    query, low = query.lower(), F.lower(text)
    if not query:
        return F.when(text.isNotNull(), F.lit(0.0))
    score = _score_of(query, low)
    if parts := re.fullmatch(r"([a-z]+)([0-9]+)|([0-9]+)([a-z]+)", query):
        first, second = (g for g in parts.groups() if g)
        score = F.coalesce(score, _score_of(second + first, low) + SWAPPED)
    return score


def fuzzy(text: Column, query: str) -> Column:
    """The sum of scores of the query's words, which white space and slashes part; null if one of them doesn't match."""
    return sum((fuzzy_score(word, text) for word in re.split(r"[\s/]+", query.strip()) if word), F.when(text.isNotNull(), F.lit(0.0)))


def changed_bytes(old: Column, new: Column) -> Column:
    """Bytes of new without the prefix and suffix that it shares with old."""

    @F.pandas_udf(LongType())
    def core(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x, y):
            x, y = x or "", y or ""
            prefix = len(os.path.commonprefix([x, y]))
            x, y = x[prefix:], y[prefix:]
            suffix = len(os.path.commonprefix([x[::-1], y[::-1]]))
            return len(y[: len(y) - suffix].encode())

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])

    return core(old, new)


def formula_references(formula: str) -> list[tuple[int, str, str, str | None, str | None, str]]:
    """(index, raw, kind, sheet, workbook, target) of each reference of a formula."""
    out = []
    for m in _TOKEN.finditer(formula.lstrip("=")):
        if m["text"] or m["call"]:
            continue
        raw = m[0]
        if m["error"]:
            kind, target = "error", m["error"]
        elif m["ref"]:
            whole = re.fullmatch(r"\$?[A-Za-z]+:\$?[A-Za-z]+|\$?\d+:\$?\d+", m["ref"])
            sheet = m["sheet"] or ""
            kind = "external" if m["book"] or "[" in sheet else "3d" if ":" in sheet.strip("'") else "whole" if whole else "range" if ":" in m["ref"] else "cell"
            target = m["ref"].replace("$", "").upper()
        elif m["name"] and m["name"].upper() not in ("TRUE", "FALSE"):
            kind, target = "structured" if "[" in m["name"] else "name", m["name"]
        else:
            continue
        sheet = (m["sheet"] or "").strip("'").replace("''", "'") or None
        book = m["book"].strip("[]") if m["book"] else None
        if sheet and (inner := re.match(r"\[([^\]]+)\](.*)", sheet)):
            book, sheet = inner[1], inner[2]
        out.append((len(out), raw, kind, sheet, book, target))
    return out


REFERENCES = "array<struct<reference_index:int,raw:string,kind:string,target_sheet:string,workbook:string,target:string>>"


def references(formula: Column) -> Column:
    """The references of a formula as an array of structs."""

    @F.pandas_udf(REFERENCES)
    def parse(values: pd.Series) -> pd.Series:
        names = ("reference_index", "raw", "kind", "target_sheet", "workbook", "target")
        return values.map(lambda v: [dict(zip(names, r, strict=True)) for r in formula_references(v or "")])

    return parse(formula)


def greedy_windows(pages: DataFrame, keys: list[str], order: str, size: Column, limit: int, most: int = 12) -> DataFrame:
    """window of each page: pages fill windows of limit in order; what comes after most windows gets null.

    A document's pages stream through the fold in order, which keeps two numbers.
    """

    def fill(rows):
        window = used = 0
        for at, length in rows:
            if used and used + length > limit:
                window, used = window + 1, 0
            used += length
            yield at, window if window < most else None

    rows = pages.select(*keys, F.col(order).cast("long").alias("_o"), size.cast("long").alias("_s")).filter("_s > 0")
    return folded(rows, keys, ["_o", "_s"], fill, "_o long, window int").withColumnRenamed("_o", order)


def hard_split(text: str, limit: int) -> list[str]:
    """Pieces of at most limit characters, cut at the last line end or space beyond half of it, if there is one."""
    pieces, rest = [], text.strip()
    while len(rest) > limit:
        cut = max(rest.rfind(c, 0, limit + 1) for c in "\n ")
        cut = cut if cut >= max(1, limit // 2) else limit
        pieces.append(rest[:cut].rstrip())
        rest = rest[cut:].lstrip()
    return [*pieces, rest] if rest else pieces


def packed_items(items: DataFrame, keys: list[str], number: str, text: str, max_chars: int, prefix: str = "") -> DataFrame:
    """keys, start, end, part_index, part_count and content: each key's items, in the order of their numbers, in pieces of max_chars.

    An item that fits goes on with the piece before it, on a line of its own; one that doesn't
    begins a piece. A longer one is cut into parts that stand alone and are counted. Every
    piece starts with the prefix, unless that leaves fewer than 32 characters; a piece has 32 at
    least. Items without text are left out; of those with one number the lesser text comes first.
    A task holds a piece and an item, whatever the size of the key.
    """
    head = prefix.strip()
    head = f"{head}\n" if head and len(head) + 32 < max_chars else ""
    room = max(32, max_chars - len(head))

    def pack(rows):
        held, start, end, used = [], None, None, 0
        for n, t in rows:
            parts = hard_split(t, room)
            if held and (len(parts) > 1 or used + 1 + len(parts[0]) > room):
                yield start, end, 1, 1, head + "\n".join(held)
                held = []
            if len(parts) > 1:
                yield from ((n, n, k, len(parts), head + part) for k, part in enumerate(parts, 1))
                continue
            start, used = (start, used + 1) if held else (n, 0)
            held.append(parts[0])
            end, used = n, used + len(parts[0])
        if held:
            yield start, end, 1, 1, head + "\n".join(held)

    rows = items.select(*keys, F.col(number).cast("long").alias("_n"), F.col(text).alias("_t")).filter(F.col("_n").isNotNull() & F.col("_t").rlike(r"(?U)\S"))
    return folded(rows, keys, ["_n", "_t"], pack, "start long, end long, part_index int, part_count int, content string")
