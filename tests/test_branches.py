"""Branches as they grow, against the walk over whole sessions, after any split into batches and restarts."""

import random

import pytest
from pyspark.sql import functions as F

from sedimark.operators.sessions import leaf_paths
from sedimark.plans import structure
from sedimark.streaming import branches, feeds

ENTRY = "session string, id string, parent_id string, seq long"


def trees(rng):
    out = []
    for s in "ab":
        ids = []
        for seq in range(40):
            parent = None if not ids or rng.random() < 0.03 else ids[-1] if rng.random() < 0.7 else rng.choice(ids)
            ids.append(f"{s}{seq}")
            out.append((s, ids[-1], parent, seq))
    return out


def whole(spark, rows):
    parents = {(r[0], r[2]) for r in rows}
    tips = spark.createDataFrame([(r[0], r[1]) for r in rows if (r[0], r[1]) not in parents], "session string, leaf string")
    return {tuple(r) for r in leaf_paths(spark.createDataFrame(rows, ENTRY), tips).collect()}


def grow(spark, folder, close_after_ms=None):
    """Takes what has come since; each call is a run of its own on the same checkpoint."""
    stream = feeds.read_stream(spark, f"{folder}/in/*", spark.createDataFrame([], ENTRY).schema)
    feeds.drained(branches.grown_branches(stream, close_after_ms), feeds.parquet_sink(f"{folder}/out"), f"{folder}/state")
    return spark.read.parquet(f"{folder}/out")


@pytest.mark.parametrize("cuts", [1, 4])
def test_paths_after_any_split_and_restart(spark, tmp_path, cuts):
    rows, folder = trees(random.Random(cuts)), f"file://{tmp_path}"
    borders = [0, *sorted(random.Random(9).sample(range(1, 40), cuts - 1)), 40]
    for n, (a, b) in enumerate(zip(borders, borders[1:], strict=False)):
        again = [r for r in rows if a - 3 <= r[3] < b]  # the last entries of the batch before come again
        spark.createDataFrame(again, ENTRY).repartition(2).write.parquet(f"{folder}/in/{n}")
        own = grow(spark, folder)
    assert own.count() == len(rows)
    assert {tuple(r) for r in branches.branch_paths(own).collect()} == whole(spark, rows)


def test_forgotten_tips_begin_branches_with_the_same_paths(spark, tmp_path):
    rows, folder = [("s", "a", None, 0), ("s", "b", "a", 1), ("s", "c", "b", 2)], f"file://{tmp_path}"
    for n, row in enumerate(rows):
        spark.createDataFrame([row], ENTRY).write.parquet(f"{folder}/in/{n}")
        own = grow(spark, folder, close_after_ms=1)
    assert {r.branch for r in own.collect()} == {"a", "b", "c"}
    assert {tuple(r) for r in branches.branch_paths(own).collect()} == whole(spark, rows) == {("s", "c", 0, "a"), ("s", "c", 1, "b"), ("s", "c", 2, "c")}


def test_no_entries(spark):
    assert branches.branch_paths(spark.createDataFrame([], branches.OWN)).collect() == []


def summed(paths):
    """What branch_totals gives, from the ways written out; an id is a letter and a number."""
    ways = {}
    for session, leaf, position, entry in paths:
        ways.setdefault((session, leaf), {})[position] = entry
    return {(s, leaf, len(way), way[0], sum(int(x[1:]) for x in way.values())) for (s, leaf), way in ways.items()}


@pytest.mark.parametrize("close_after_ms", [None, 1])
def test_totals_are_those_of_the_ways(spark, tmp_path, close_after_ms):
    rows, folder = [*trees(random.Random(5)), ("a", "a90", "a77", 90)], f"file://{tmp_path}"  # a parent that isn't there
    for n, (a, b) in enumerate([(0, 15), (15, 99)]):
        spark.createDataFrame([r for r in rows if a <= r[3] < b], ENTRY).write.parquet(f"{folder}/in/{n}")
        own = grow(spark, folder, close_after_ms).select("session", "branch", "id", "parent_id", "seq")
    got = branches.branch_totals(own.unionByName(own), numbers=F.substring("id", 2, 9).cast("long"))
    assert got.columns == ["session", "leaf", "entries", "root", "numbers"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(summed(branches.branch_paths(own).collect()))
    assert {tuple(r) for r in branches.branch_paths(own).collect()} >= {("a", "a90", 0, "a90")}
    assert branches.branch_totals(spark.createDataFrame([], branches.OWN)).collect() == []


def test_many_forks_on_a_path_take_few_rounds_and_rows(spark, tmp_path, monkeypatch):
    parent = {i: (i - 2 if i % 3 == 2 else i - 1) if i else None for i in range(180)}  # each error begins a branch, and all later ones follow from it
    events = [(i, 7, "error" if i % 3 == 2 else "view") for i in parent]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    sizes, stored = [], branches.stored

    def counted(df, folder, name):
        out = stored(df, folder, name)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(branches, "stored", counted)
    expected = set()
    for leaf in parent.keys() - set(parent.values()):
        way = [leaf]
        while parent[way[-1]] is not None:
            way.append(parent[way[-1]])
        expected.add(("7", str(leaf), len(way), str(way[-1]), sum(way)))
    assert {tuple(r) for r in structure.branch_growth(spark, str(tmp_path)).collect()} == expected
    assert len(sizes) <= 10 and max(sizes) <= len(events)
