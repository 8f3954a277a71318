"""Numbered items in pieces, against a version that keeps all of them in lists."""

import random

import pytest

from sedimark.functions.matching import hard_split, packed_items


def brute(items, most, prefix):
    head = prefix.strip()
    if head and len(head) + 32 >= most:
        head = ""
    room = max(32, most - len(head) - (1 if head else 0))
    out, current = [], []
    for n, text in sorted((n, t) for n, t in items if t and t.strip() and n is not None):
        parts = hard_split(text, room)
        if len(parts) > 1 or (current and len("\n".join([*[t for _, t in current], text.strip()])) > room):
            out += [(current[0][0], current[-1][0], 1, 1, "\n".join(t for _, t in current))] if current else []
            current = []
        if len(parts) > 1:
            out += [(n, n, k, len(parts), p) for k, p in enumerate(parts, 1)]
        else:
            current.append((n, text.strip()))
    out += [(current[0][0], current[-1][0], 1, 1, "\n".join(t for _, t in current))] if current else []
    return [(*x[:4], f"{head}\n{x[4]}" if head else x[4]) for x in out]


def test_cuts_look_back_for_a_break():
    assert hard_split("aaaa bbbb cccc", 9) == ["aaaa bbbb", "cccc"] and hard_split("  \n ", 5) == []
    assert hard_split("a bbbbbbbbbbbb", 10) == ["a bbbbbbbb", "bbbb"]  # the space lies before the half
    assert hard_split("aaaaaa\nbb cccccc", 9) == ["aaaaaa\nbb", "cccccc"] and hard_split("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5]


@pytest.mark.parametrize(("most", "prefix"), [(40, ""), (60, " head "), (36, "long prefix"), (10, ""), (300, "p")])
def test_pieces_against_lists(spark, most, prefix):
    rng = random.Random(most)
    make = lambda: "".join(rng.choice("ab \n") for _ in range(rng.choice([0, 3, 20, 33, 80, 700])))
    items = [(rng.choice("xy"), rng.randint(0, 60), make()) for _ in range(160)] + [("x", 3, None), ("x", None, "none"), (None, 1, "null key"), (None, 2, "again"), ("z", 1, "\u3000 ")]
    items += [("long", 1, "w" * 50_000), ("long", 2, "tail"), ("long", 2, "tail")]
    df = spark.createDataFrame(items, "k string, n int, t string").repartition(4)
    got = packed_items(df, ["k"], "n", "t", most, prefix).collect()
    for key in ("x", "y", "z", "long", None):
        mine = [(r.start, r.end, r.part_index, r.part_count, r.content) for r in got if r.k == key]
        assert mine == brute([(n, t) for k, n, t in items if k == key], most, prefix)
    assert packed_items(df.limit(0), ["k"], "n", "t", most).collect() == []
