"""Page layout: columns, spanning headings, tables, weak evidence, odd tokens; and against a version on lists."""

import random

import pytest

from sedimark.operators import pages

TOKEN = "page string, text string, x double, y double, width double, height double"


def laid(spark, tokens, width=600.0, height=800.0, page="p"):
    frame = spark.createDataFrame([(page, *t) for t in tokens], TOKEN).repartition(3)
    sheet = spark.createDataFrame([(page, width, height)], "page string, page_width double, page_height double")
    return pages.page_layout(frame, sheet, ["page"]).orderBy("reading_order").collect()


def word(text, x, y, width=80.0, height=10.0):
    return (text, float(x), float(y), float(width), float(height))


def test_left_column_before_the_right(spark):
    got = laid(spark, [word(f"{side}栏内容{k}", x, 80 + k * 30) for k in range(4) for side, x in (("左", 40), ("右", 330))])
    assert [r.text for r in got] == [f"左栏内容{k}" for k in range(4)] + [f"右栏内容{k}" for k in range(4)]
    assert [r.column_no for r in got] == [1] * 4 + [2] * 4 and all(r.two_column for r in got)
    assert [r.reading_order for r in got] == list(range(8))


def test_weak_evidence_keeps_positions(spark):
    got = laid(spark, [word("第一行", 40, 80), word("第二行", 330, 110), word("第三行", 40, 140)])
    assert [(r.text, r.column_no, r.two_column) for r in got] == [("第一行", 0, False), ("第二行", 0, False), ("第三行", 0, False)]
    assert [(r.text, r.block_type) for r in laid(spark, [word("管理层：今年收入保持增长", 40, 80, 200)])] == [("管理层：今年收入保持增长", "speaker")]


def test_heading_and_footer_across_two_columns(spark):
    body = [word(f"{side} column prose {k}", x, 120 + k * 14, 200) for k in range(12) for side, x in (("left", 40), ("right", 330))]
    got = laid(spark, [word("A title over the whole page", 40, 60, 520, 20), word("and a footer over it all", 40, 700, 520), *body])
    assert [r.text for r in got] == ["A title over the whole page"] + [f"left column prose {k}" for k in range(12)] + [f"right column prose {k}" for k in range(12)] + ["and a footer over it all"]
    assert [r.column_no for r in got] == [0] + [1] * 12 + [2] * 12 + [0] and got[0].block_type == "heading"


def test_a_table_is_no_columns(spark):
    rows = [word(t, x, 100 + 16 * k, 60) for k in range(8) for t, x in ((f"Sales {k}", 40), (f"1,{k}00", 200), (f"2,{k}00", 350), ("12%", 500))]
    got = laid(spark, rows)
    assert not any(r.two_column for r in got) and [r.text for r in got][:2] == ["Sales 0", "1,000"]
    near = laid(spark, [word("Sales", 40, 100, 40), word("1,000", 120, 100, 40), word("2,000", 190, 100, 40)])
    assert [(r.text, r.block_type) for r in near] == [("Sales 1,000 2,000", "table_row")]


def test_words_join_by_gaps_and_lines_by_centres(spark):
    got = laid(spark, [word("b", 52, 81, 10), word("a", 40, 80, 10), word("c", 62, 79.5, 10), word("next", 40, 95, 30), word(" \t ", 200, 80), word("d \t e", 74, 80, 12)])
    assert [r.text for r in got] == ["a bc d e", "next"]
    assert (got[0].x, got[0].width) == (40.0, 46.0)


def test_odd_tokens_and_nothing(spark):
    frame = spark.createDataFrame([("p", None, 1.0, 1.0, 1.0, 1.0), ("p", "t", None, 1.0, 1.0, 1.0), ("other", "t", 1.0, 1.0, 1.0, 1.0), ("q", "ok", 1.0, 1.0, 0.0, 0.0), ("q", "ok", 1.0, 1.0, 0.0, 0.0)], TOKEN)
    sheet = spark.createDataFrame([("p", 600.0, 800.0), ("q", 600.0, 800.0), ("q", 600.0, 800.0)], "page string, page_width double, page_height double")
    assert [(r.page, r.text) for r in pages.page_layout(frame, sheet, ["page"]).collect()] == [("q", "okok")]
    assert pages.page_layout(frame.limit(0), sheet, ["page"]).count() == 0
    texts = pages.page_texts(pages.page_layout(frame, sheet, ["page"]), ["page"]).collect()
    assert [tuple(r) for r in texts] == [("q", "okok", False)]


def brute_gutter(segments, page_width, page_height, top, end):
    """The gutter by a look at each whole position."""
    numeric = lambda t: sum(c in "0123456789%.,()-–" for c in t.replace(" ", "")) >= len(t.replace(" ", "")) * 0.5
    area = [s for s in segments if top <= (s[2] + s[4]) / 2 <= end and page_height * 0.04 < s[2] < page_height * 0.94]
    prose = [s for s in area if not numeric(s[0]) and (len(s[0]) >= 20 or s[3] - s[1] >= page_width * 0.12)]
    if len(prose) < 6:
        return None
    heights = sorted(s[4] - s[2] for s in prose)
    middle = (heights[(len(heights) - 1) // 2] + heights[len(heights) // 2]) / 2
    scores = []
    for at in range(int(page_width * 0.2), int(-(-page_width * 0.8 // 1)) + 1):
        left, right = [s for s in prose if s[3] <= at], [s for s in prose if s[1] >= at]
        score = None
        if min(len(left), len(right)) >= 3:
            a, b = max(min(s[2] for s in left), min(s[2] for s in right)), min(max(s[4] for s in left), max(s[4] for s in right))
            span = min(max(s[4] for s in x) - min(s[2] for s in x) for x in (left, right))
            if b - a >= max(max(1, middle) * 3, span * 0.45):
                score = min(len(left), len(right)) - 3 * sum(s[1] < at < s[3] and s[4] > a and s[2] < b for s in area)
        scores.append((at, score if score is not None and score >= 3 else None))
    runs = []
    for at, score in scores:
        if score is not None and runs and runs[-1][2] == at - 1 and runs[-1][0] == score:
            runs[-1][2] = at
        elif score is not None:
            runs.append([score, at, at])
    return max(((s, b - a, -a) for s, a, b in runs), default=None)


@pytest.mark.parametrize("seed", range(3))
def test_gutters_against_every_position(spark, seed):
    rng = random.Random(seed)
    rows, want = [], {}
    for n in range(40):
        page, split = f"p{n}", rng.randint(200, 420)
        segments = []
        for k in range(rng.randint(4, 40)):
            y = 60.0 + rng.randint(0, 45) * 14
            kind = rng.random()
            x, right = (30.0, split - rng.uniform(0, 60)) if kind < 0.45 else (split + rng.uniform(0, 40), 570.0) if kind < 0.9 else (100.0, 500.0)
            segments.append((rng.choice(["a line of prose that is long", "short", "1,234"]), x, y, right, y + rng.choice([10.0, 12.0])))
        top, end = rng.choice([(0.0, 800.0), (150.0, 800.0)])
        rows += [(page, *s, 600.0, 800.0, top, end) for s in segments]
        found = brute_gutter(segments, 600.0, 800.0, top, end)
        if found:
            want[page] = (-found[2], found[1] - found[2])
    frame = spark.createDataFrame(rows, "page string, text string, x double, y double, right double, bottom double, page_width double, page_height double, top double, end double")
    assert {r.page: (r.gutter_from, r.gutter_to) for r in pages._gutters(frame, ["page"]).collect()} == want and want


def test_words_are_not_written_and_segments_join_as_their_words_do(spark, monkeypatch):
    written, stored = [], pages.stored
    monkeypatch.setattr(pages, "stored", lambda df, folder, name: written.append(name) or stored(df, folder, name))
    got = laid(spark, [word("a", 40, 80, 10), word("b", 52, 80, 10), word("c", 80, 80, 10), word("d", 92, 80, 10)])
    assert [r.text for r in got] == ["a b c d"] and written == ["segments", "regions"]
