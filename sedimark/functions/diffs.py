"""Differences of JSON documents, patches and ranked names."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CHANGES = "array<struct<path:string,before:string,after:string>>"


def _identified(items: list) -> dict | None:
    """A list of objects by their id or evidenceId, where all have one of their own."""
    ids = [x.get("id", x.get("evidenceId")) if isinstance(x, dict) else None for x in items]
    return dict(zip(ids, items, strict=True)) if ids and None not in ids and len(set(map(str, ids))) == len(ids) else None


def json_changes(before, after, path: str = "$") -> Iterator[tuple[str, object, object]]:
    """(path, before, after) of each difference; lists of identified objects are matched by id, and their order is told."""
    if isinstance(before, dict) and isinstance(after, dict):
        for key in sorted({*before, *after}):
            yield from json_changes(before.get(key), after.get(key), f"{path}.{key}")
    elif isinstance(before, list) and isinstance(after, list):
        old, new = _identified(before), _identified(after)
        if old is not None and new is not None:
            for key in sorted({*old, *new}, key=str):
                yield from json_changes(old.get(key), new.get(key), f"{path}[{key}]")
            same = [k for k in old if k in new], [k for k in new if k in old]
            if same[0] != same[1]:
                yield f"{path}#order", same[0], same[1]
        else:
            for i in range(max(len(before), len(after))):
                yield from json_changes(before[i] if i < len(before) else None, after[i] if i < len(after) else None, f"{path}[{i}]")
    elif before != after or isinstance(before, bool) != isinstance(after, bool):
        yield path, before, after


def json_diff(before: Column, after: Column) -> Column:
    """The changes between two JSON texts; one that can't be read counts as null."""

    @F.pandas_udf(CHANGES)
    def diff(old: pd.Series, new: pd.Series) -> pd.Series:
        def read(x):
            try:
                return None if x is None else json.loads(x)
            except ValueError:
                return None

        def show(x):
            return None if x is None else json.dumps(x, ensure_ascii=False, sort_keys=True)

        return pd.Series([[{"path": p, "before": show(a), "after": show(b)} for p, a, b in json_changes(read(x), read(y))] for x, y in zip(old, new, strict=True)])

    return diff(before, after)


PATCH = "array<struct<file:string,kind:string,old_line:int,new_line:int,text:string>>"


def patch_lines(patch: str) -> list[dict]:
    """Lines of a unified patch: kind is context, added or removed, with the line numbers of either side."""
    out, file, old, new = [], None, 0, 0
    for line in patch.splitlines():
        if line.startswith("+++ "):
            file = re.sub(r"^b/", "", line[4:].split("\t")[0])
        elif line.startswith("--- ") or line.startswith("diff ") or line.startswith("index "):
            continue
        elif m := re.match(r"@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@", line):
            old, new = int(m[1]), int(m[2])
        elif line[:1] == "+":
            out.append({"file": file, "kind": "added", "old_line": None, "new_line": new, "text": line[1:]})
            new += 1
        elif line[:1] == "-":
            out.append({"file": file, "kind": "removed", "old_line": old, "new_line": None, "text": line[1:]})
            old += 1
        elif line[:1] == " ":
            out.append({"file": file, "kind": "context", "old_line": old, "new_line": new, "text": line[1:]})
            old, new = old + 1, new + 1
    return out


def patch_rows(patch: Column) -> Column:
    @F.pandas_udf(PATCH)
    def rows(values: pd.Series) -> pd.Series:
        return values.map(lambda v: patch_lines(v or ""))

    return rows(patch)


def match_rank(name: Column, query: str) -> Column:
    """0 for the name itself, 1 for its start, 2 for the start of a word in it, 3 for a part; null for none."""
    low, q = F.lower(name), query.lower()
    word = F.length(F.regexp_extract(low, r"(?:^|[^a-z0-9])" + re.escape(q), 0)) > 0
    return F.when(low == q, 0).when(F.startswith(low, F.lit(q)), 1).when(word, 2).when(F.contains(low, F.lit(q)), 3)


def path_score(path: Column, query: str) -> Column:
    """100 for a file of that name, then 80, 60 and 40 for its start, part and a part of the path, 10 for a subsequence; 0 for none."""
    low, q = F.lower(path), query.lower()
    base = F.substring_index(low, "/", -1)
    sequence = ".*".join(re.escape(c) for c in q)
    return F.when(base == q, 100).when(F.startswith(base, F.lit(q)), 80).when(F.contains(base, F.lit(q)), 60).when(F.contains(low, F.lit(q)), 40).when(low.rlike(sequence), 10).otherwise(0)
