"""Revisions: stale edits, restores, reads as of a time, and no overlap after random batches."""

import random

from sedimark.operators import revisions as rev

TABLE = "card_id string, revision int, valid_from int, valid_to int, title string, status string"
EDIT = "card_id string, expected int, at int, request_id string, title string, status string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_edits_restores_and_selections(spark):
    none = spark.createDataFrame([], TABLE)
    first = spark.createDataFrame([("a", 0, 1, "r1", "one", "draft"), ("b", None, 1, "r2", "two", "draft"), ("c", 4, 1, "r3", "three", "draft"), (None, 0, 1, "r4", "x", "draft")], EDIT)
    assert {r.request_id: r.outcome for r in rev.outcomes(none, first).collect()} == {"r1": "created", "r2": "created", "r3": "unknown", "r4": "unknown"}
    table = rev.edited(none, first)
    second = spark.createDataFrame([("a", 1, 5, "r5", "one more", "draft"), ("a", 1, 6, "r6", "late", "draft"), ("b", 0, 5, "r7", "again", "draft"), ("b", 1, 5, "r8", "two", "draft"), ("b", 1, 1, "r9", "early", "draft")], EDIT)
    assert {r.request_id: r.outcome for r in rev.outcomes(table, second).collect()} == {"r5": "revised", "r6": "stale", "r7": "stale", "r8": "stale", "r9": "too_early"}
    table = rev.edited(table, second)
    assert rows(table) == [("a", 1, 1, 5, "one", "draft"), ("a", 2, 5, None, "one more", "draft"), ("b", 1, 1, None, "two", "draft")]
    same = spark.createDataFrame([("b", 1, 7, "r10", "two", "draft")], EDIT)
    assert rev.outcomes(table, same).first().outcome == "unchanged" and rows(rev.edited(table, same)) == rows(table)
    back = rev.restoring(table, spark.createDataFrame([("a", 1, 2, 9, "r11"), ("a", 7, 2, 9, "r12")], "card_id string, revision int, expected int, at int, request_id string"))
    table = rev.edited(table, back)
    assert [(r.revision, r.title, r.is_current) for r in rev.history(table).filter("card_id = 'a'").collect()] == [(3, "one", True), (2, "one more", False), (1, "one", False)]
    assert [rows(rev.as_of(table, t).select("card_id", "revision")) for t in (0, 1, 5, 8, 9)] == [[], [("a", 1), ("b", 1)], [("a", 2), ("b", 1)], [("a", 2), ("b", 1)], [("a", 3), ("b", 1)]]
    table = rev.edited(table, spark.createDataFrame([("b", 1, 10, "r13", "two", "archived")], EDIT))
    chosen = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2), ("z", 1)], "card_id string, revision int")
    assert rows(rev.checked_selection(table, chosen).select("card_id", "revision", "state", "title")) == [("a", 1, "changed", None), ("a", 3, "ready", "one"), ("b", 2, "archived", None), ("z", 1, "unknown", None)]
    assert rev.breaks(table).count() == 0


def test_random_batches_never_overlap(spark):
    rng, now = random.Random(4), {}
    table = spark.createDataFrame([], TABLE)
    for batch in range(4):
        edits = [(rng.choice("abcde"), rng.randint(0, 3), batch * 10 + rng.randint(0, 9), f"{batch}-{k}", rng.choice("xyz"), "draft") for k in range(15)]
        table = spark.createDataFrame(rev.edited(table, spark.createDataFrame(edits, EDIT)).collect(), TABLE)
        for card in "abcde":
            mine = sorted((e for e in edits if e[0] == card), key=lambda e: (e[2], e[3]))[:1]
            for _, expected, at, _, title, _ in mine:
                revision, since, held = now.get(card, (0, -1, None))
                if expected == revision and title != held and at > since:
                    now[card] = (revision + 1, at, title)
    assert rev.breaks(table).count() == 0
    assert {r.card_id: (r.revision, r.valid_from, r.title) for r in rev.current(table).collect()} == now
    bad = spark.createDataFrame([("a", 1, 0, 5, "x", "d"), ("a", 2, 4, None, "y", "d"), ("b", 2, 0, None, "x", "d"), ("c", 1, 3, 3, "x", "d")], TABLE)
    assert rows(rev.breaks(bad).select("card_id", "revision")) == [("a", 2), ("b", 2), ("c", 1)]
