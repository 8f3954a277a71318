"""Branches of session trees, kept up as entries arrive."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sedimark.functions.storage import shared_folder, stored

STATE = "last long, tips string, heard long"
OWN = "session string, branch string, id string, parent_id string, seq long"


def _growth(close_after_ms: int | None):
    """Takes a session's new entries; its state is the last seq, the open branches (JSON, tip to branch) and when it was last heard of."""

    def grow(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, held, heard = state.get if state.exists else (-1, "{}", 0)
        now = state.getCurrentProcessingTimeMs()
        tips = {} if close_after_ms is not None and now - heard > close_after_ms else json.loads(held)
        entries = (e for f in frames for e in f["entry"].tolist())
        fresh = sorted({(e["seq"], e["id"], e["parent_id"]) for e in entries if e["seq"] > last}, key=lambda r: r[:2])
        out = []
        for seq, own, parent in fresh:
            branch = tips.pop(parent, own) if parent is not None else own
            tips[own] = branch
            out.append((key[0], branch, own, parent, seq))
        state.update((int(fresh[-1][0]) if fresh else last, json.dumps(tips), now))
        if out:
            yield pd.DataFrame(out, columns=["session", "branch", "id", "parent_id", "seq"])

    return grow


def grown_branches(entries: DataFrame, close_after_ms: int | None = None) -> DataFrame:
    """session, branch, id, parent_id and seq: the branch in which each arriving entry is at home.

    entries (session, id, parent_id, seq) is a stream; a session's seq grows, a parent's is
    less than its child's. An entry whose parent is a tip goes on with its branch; any other
    begins one, named by its id, and branch_paths finds what lies before it. Entries that come
    again are passed over. The state is the tips, not the entries. A session that wasn't heard of
    for close_after_ms has its tips forgotten when it is, and what follows begins a branch; no
    timer runs, so that a stream of what is there now comes to an end.
    """
    rows = entries.select(F.col("session").cast("string").alias("session"), F.col("id").cast("string").alias("id"), F.col("parent_id").cast("string").alias("parent_id"), F.col("seq").cast("long").alias("seq"))
    rows = rows.filter("session IS NOT NULL AND id IS NOT NULL AND seq IS NOT NULL")
    packed = rows.select("session", F.struct("seq", "id", "parent_id").alias("entry"))  # what a session costs is mostly its columns
    return packed.groupBy("session").applyInPandasWithState(_growth(close_after_ms), OWN, STATE, "append", GroupStateTimeout.NoTimeout)


def branch_paths(own: DataFrame) -> DataFrame:
    """session, leaf, position and id: the way from the root to each entry without children.

    own is what grown_branches gives, rows that came twice included. Branches are followed
    to the branch where they began, then to the second above, the fourth and so on, so the rounds are
    the logarithm of the forks on a path; only then entries are joined, each branch's as far as the fork.
    What is written grows with leaves times their ways; branch_totals sums ways up without that.
    """
    folder = shared_folder(own.sparkSession, "paths")
    own = stored(own.select("session", "branch", "id", "parent_id", "seq").dropDuplicates(["session", "id"]), folder, "own")
    new = lambda df, **names: df.select(*[F.col(c).alias(n) for n, c in names.items()])
    home = new(own, _s="session", _p="id", upper="branch", cut="seq")
    begins = own.groupBy("session", "branch").agg(F.min_by("parent_id", "seq").alias("parent_id"), F.max_by("id", "seq").alias("tip"), F.max("seq").alias("last"))
    links = stored(begins.join(home, (F.col("session") == F.col("_s")) & (F.col("parent_id") == F.col("_p")), "left").select("session", "branch", "tip", "last", "upper", "cut"), folder, "links")
    followed = new(own, _s="session", _p="parent_id").filter("_p IS NOT NULL").distinct()
    leaves = links.join(followed, (F.col("session") == F.col("_s")) & (F.col("tip") == F.col("_p")), "left_anti")
    ways = new(links.filter("upper IS NOT NULL"), _s="session", _b="branch", upper="upper", cut="cut")
    stored(new(leaves, session="session", leaf="tip", branch="branch", upto="last"), folder, "pieces/round=0")
    for n in count(1):
        pieces = own.sparkSession.read.schema("session string, leaf string, branch string, upto long").parquet(f"{folder}/pieces")
        on = (F.col("session") == F.col("_s")) & (F.col("branch") == F.col("_b"))
        further = stored(new(pieces.join(ways, on), session="session", leaf="leaf", branch="upper", upto="cut"), folder, f"pieces/round={n}")
        if further.isEmpty():
            break
        above = new(ways, session="_s", branch="_b", over="upper", above="cut")
        ways = stored(new(ways.join(above, (F.col("_s") == F.col("session")) & (F.col("upper") == F.col("branch"))), _s="_s", _b="_b", upper="over", cut="above"), folder, f"ways/round={n}")
    entries = new(own, _s="session", _b="branch", id="id", seq="seq")
    rows = pieces.join(entries, (F.col("session") == F.col("_s")) & (F.col("branch") == F.col("_b"))).filter("seq <= upto")
    place = F.row_number().over(Window.partitionBy("session", "leaf").orderBy("seq")) - 1
    return rows.select("session", "leaf", place.alias("position"), "id")


def _placed(own: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Entries with their number in their branch and its sums up to them; a branch's first one also has its parent, the branch's tip and its whole sums."""
    ordered = Window.partitionBy("session", "branch").orderBy("seq")
    upto, whole = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow), ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    values = {"entries": F.lit(1).cast("long"), **sums}
    rows = own.dropDuplicates(["session", "id"]).withColumns({f"_{n}": F.coalesce(v, F.lit(0)) for n, v in values.items()})
    first = lambda value: F.when(F.row_number().over(ordered) == 1, value)
    totals = [c for n in values for c in (F.sum(f"_{n}").over(upto).alias(n), first(F.sum(f"_{n}").over(whole)).alias(f"own_{n}"))]
    return rows.select("session", "branch", "id", first(F.col("parent_id")).alias("parent_id"), first(F.last("id").over(whole)).alias("tip"), *totals)


def branch_totals(own: DataFrame, **sums: Column) -> DataFrame:
    """session, leaf, entries, root and a sum for each column of own named: what lies on the way from the root to each entry without children.

    The same as branch_paths summed up, but ways aren't written out: a branch has the
    sums of what lies before it, by joining it with the branch above it, then with the one that
    this one has come to, and so on. The rounds are the logarithm of the forks on a path, and no table has more
    rows than there are entries. A null adds nothing.
    """
    folder, names = shared_folder(own.sparkSession, "totals"), ["entries", *sums]
    placed = stored(_placed(own, sums), folder, "placed")
    new = lambda df, **of: df.select(*[F.col(c).alias(n) for n, c in of.items()])
    forks = new(placed, _s="session", _p="id", upper="branch", **{f"_{n}": n for n in names})
    begins = placed.filter("tip IS NOT NULL").drop("id", *names)
    before = [F.coalesce(f"_{n}", F.lit(0)).alias(n) for n in names]
    joined = begins.join(forks, (F.col("session") == F.col("_s")) & (F.col("parent_id") == F.col("_p")), "left")
    ways = stored(joined.select(*begins.columns, "upper", F.col("branch").alias("root"), *before), folder, "ways/round=0")
    branches, followed = ways.drop("upper", "root", *names), new(ways, _s="session", _p="parent_id").filter("_p IS NOT NULL")
    ways = ways.select("session", "branch", "upper", "root", *names)
    for n in count(1):
        if ways.filter("upper IS NOT NULL").isEmpty():
            break
        above = new(ways, _s="session", _b="branch", _upper="upper", _root="root", **{f"_{c}": c for c in names})
        on = (F.col("session") == F.col("_s")) & (F.col("upper") == F.col("_b"))
        more = [(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in names]
        ways = stored(ways.join(above, on, "left").select("session", "branch", F.col("_upper").alias("upper"), F.coalesce("_root", "root").alias("root"), *more), folder, f"ways/round={n}")
    leaves = branches.join(followed, (F.col("session") == F.col("_s")) & (F.col("tip") == F.col("_p")), "left_anti")
    found = leaves.join(ways, ["session", "branch"])
    return found.select("session", F.col("tip").alias("leaf"), (F.col("entries") + F.col("own_entries")).alias("entries"), "root", *[(F.col(n) + F.col(f"own_{n}")).alias(n) for n in sums])
