import datetime as dt
import zipfile

import pytest
from pyspark.sql import functions as F

from sedimark.functions import diffs
from sedimark.operators import cards
from sedimark.sources import files

SCHEMA = "claim_id int, issuer string, issuer_kind string, item string, period string, measure string, value double, unit string, currency string, scope string, stance string, as_of string, created_at int"


def claim(i, issuer, value, unit="元", kind="broker", stance="neutral", as_of="2026-01-01", scope=None, item="sales"):
    return (i, issuer, kind, item, "FY2026" if value is not None else None, "level", value, unit, "CNY", scope, stance, as_of, i)


def test_cards(spark):
    rows = [claim(1, "a", 100.0), claim(2, "a", 110.0, as_of="2026-02-01"), claim(3, "b", 112.0), claim(4, "c", 5.0, "x"), claim(5, "co", 500.0, kind="company"), claim(6, "d", 999.0, as_of="2027-01-01"), claim(7, "e", 90.0, scope=" core ")]
    rows += [claim(8, "a", None, stance="bullish", item="view"), claim(9, "b", None, stance="bearish", item="view"), claim(10, "a", None, item="alone")]
    got = {r["item"]: r for r in cards.build_cards(spark.createDataFrame(rows, SCHEMA), "2026-06-30").collect()}
    sales = got["sales"]
    assert (sales.comparable, sales.median, sales.sample_size, sales.card_type, sales.company_value) == (2, 111.0, 4, "consensus", 500.0)
    assert sales.priority == round(4 * (1 + 2 / 111), 3)
    assert (got["view"].card_type, got["view"].priority) == ("divergence", 4.0)
    assert got["alone"].card_type == "single_view"


def test_cover_dates_and_silence(spark):
    covers = spark.createDataFrame([(1, "收盘 2026-01-05\n报告日期 2026-01-04\n2026-01-05"), (2, "none")], "doc_id int, text string")
    assert [tuple(r) for r in cards.cover_dates(covers).collect()] == [(1, dt.date(2026, 1, 4), 3.0)]
    issuers = spark.createDataFrame([("a",), ("b",)], "issuer string")
    seen = spark.createDataFrame([("i", "a"), ("j", "a"), ("j", "b")], "item string, issuer string")
    assert [tuple(r) for r in cards.not_mentioned(issuers, seen, ["item"]).collect()] == [("i", "b")]
    more = seen.union(spark.createDataFrame([("k", "other"), ("l", None), (None, "a")], "item string, issuer string"))
    assert sorted(((r.item, r.issuer) for r in cards.not_mentioned(issuers, more, ["item"]).collect()), key=str) == sorted([("i", "b"), ("k", "a"), ("k", "b"), ("l", "a"), ("l", "b"), (None, "b")], key=str)
    with pytest.raises(ValueError, match="more than 1"):
        cards.not_mentioned(issuers, seen, ["item"], most_issuers=1)


def test_json_diff(spark):
    assert sorted(diffs.json_changes({"a": [{"id": 1, "v": 1}, {"id": 2}], "b": 1}, {"a": [{"id": 2}, {"id": 1, "v": 2}], "c": True})) == [("$.a#order", [1, 2], [2, 1]), ("$.a[1].v", 1, 2), ("$.b", 1, None), ("$.c", None, True)]
    df = spark.createDataFrame([('{"x":1}', '{"x":2}'), ("bad", None)], "a string, b string")
    assert [[tuple(c) for c in r[0]] for r in df.select(diffs.json_diff(F.col("a"), F.col("b"))).collect()] == [[("$.x", "1", "2")], []]


def test_patches_and_ranks(spark):
    rows = diffs.patch_lines("--- a/f\n+++ b/f\n@@ -3,2 +3,3 @@\n same\n-old\n+new\n+more\n")
    assert [(r["kind"], r["old_line"], r["new_line"]) for r in rows] == [("context", 3, 3), ("removed", 4, None), ("added", None, 4), ("added", None, 5)]
    df = spark.createDataFrame([("gpt",), ("gpt-4",), ("my gpt",), ("agpt",), ("x",)], "n string")
    assert [r[0] for r in df.select(diffs.match_rank(F.col("n"), "gpt")).collect()] == [0, 1, 2, 3, None]
    paths = spark.createDataFrame([("a/main.py",), ("a/main.pyc",), ("x/domain.pyx",), ("main.py/z",), ("m/a/i/n.p/y",), ("q",)], "p string")
    assert [r[0] for r in paths.select(diffs.path_score(F.col("p"), "main.py")).collect()] == [100, 80, 60, 40, 10, 0]


def test_slides(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "s.pptx", "w") as z:
        for name, text in (("ppt/slides/slide1.xml", "one"), ("ppt/notesSlides/notesSlide1.xml", "note")):
            z.writestr(name, f'<x xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><a:p><a:r><a:t>{text}</a:t></a:r></a:p><a:p/></x>')
    assert [(r.slide, r.part, r.text) for r in files.read_slides(spark, str(tmp_path)).orderBy("part").collect()] == [(1, "notes", "note"), (1, "slide", "one")]
