"""Pages, reviews, market points and writes on golden rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sedimark.operators import documents, reviews, tracking, writes
from sedimark.sources import feeds


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_context_shares_its_budget(spark):
    pages = spark.createDataFrame([("d", i, "word " * 10 * i) for i in range(1, 6)], "doc_id string, page_number long, text string")
    hits = spark.createDataFrame([(1, "d", 1, 1), (2, "d", 4, 5), (3, "e", 1, 1), (4, "d", 3, 2)], "hit_id int, doc_id string, page_start int, page_end int")
    got = {(r.hit_id, r.page_number): (r.text, r.truncated) for r in documents.page_context(hits, pages, 1, 180, 60, 100).collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 3), (2, 4), (2, 5)}
    assert got[1, 1] == (("word " * 10).strip(), False) and got[1, 2][1] and len(got[1, 2][0]) <= 90 and got[1, 2][0].endswith("…")
    assert len(got[2, 5][0]) <= 60


def test_lines_are_trimmed_round_the_hit(spark):
    line = "a" * 100 + "HIT" + "b" * 400
    df = spark.createDataFrame([(line, 100), ("short", 2), (line, 0), (line, 502), (None, 1)], "t string, hit int")
    got = [r[0] for r in df.select(documents.trimmed_line(F.col("t"), F.col("hit"))).collect()]
    assert got == ["…" + line[20:260] + "…", "short", line[:240] + "…", "…" + line[263:], None]


def test_orphans(spark):
    docs = spark.createDataFrame([(c, "registered", dt.datetime(2024, 1, d)) for c, d in (("a", 1), ("b", 1), ("c", 1), ("d", 9))], "doc_id string, status string, registered_at timestamp")
    jobs = spark.createDataFrame([("running", '[{"docId":"b"}]'), ("failed", '[{"docId":"a"}]')], "status string, files string")
    pages = spark.createDataFrame([("c",)], "doc_id string")
    assert [r.doc_id for r in documents.orphaned(docs, jobs, pages, "2024-01-05").collect()] == ["a"]


def test_lines_follow_the_running_mean(spark):
    tokens = [("p", x, y, 5.0, 10.0, t) for x, y, t in ((0, 0.0, "a"), (20, 3.0, "b"), (40, 6.0, "c"), (0, 30.0, "d"), (10, 31.0, "e"))]
    df = spark.createDataFrame([(p, float(x), y, w, h, t) for p, x, y, w, h, t in tokens], "page string, x double, y double, width double, height double, text string")
    assert [(r.line_no, r.text) for r in documents.text_lines(df, ["page"], 10.0).orderBy("line_no").collect()] == [(0, "a b c"), (1, "d e")]
    grouped = documents.gap_groups(df.filter("y < 10"), ["page"], 14.0)
    assert [r.group_no for r in grouped.orderBy("x").collect()] == [0, 1, 2]


def test_rectangles_join_equal_runs(spark):
    cells = [("s", r, c) for r in (1, 2, 3) for c in (1, 2)] + [("s", 2, 5), ("s", 5, 1), ("s", 5, 2), ("s", 1, 1)]
    got = rows(documents.rectangles(spark.createDataFrame(cells, "sheet string, row_index int, col_index int"), ["sheet"]))
    assert got == [("s", 1, 2, 1, 3), ("s", 1, 2, 5, 5), ("s", 5, 5, 2, 2)]


def test_filters_and_order(spark):
    docs = spark.createDataFrame([("a", "2024"), ("b", ""), ("c", "2025"), ("d", None), ("e", "2024")], "name string, date string")
    assert [r.name for r in documents.newest_first(docs, "date", "name").collect()] == ["c", "a", "e", "b", "d"]
    assert documents.any_of(docs, "name", None).count() == 5 and documents.any_of(docs, "name", []).count() == 0 and documents.any_of(docs, "name", ["a", "z"]).count() == 1


def test_dependencies(spark):
    changes = [("r", 1, "g1", "currentAssessment", []), ("r", 2, "g2", "valuation", ["j"]), ("r", 3, "g3", "sources", ["j", "k"]), ("r", 4, "g3", "sources", ["z"]), ("s", 5, "g9", "valuation", ["j"]), ("r", 6, "g4", "currentAssessment", None)]
    df = spark.createDataFrame(changes, "review string, change_id int, group_id string, section string, judgment_ids array<string>")
    assert {r.change_id: r.depends_on for r in reviews.change_dependencies(df, ["review"]).collect()} == {1: ["g2"], 2: ["g1", "g3", "g4"], 3: ["g2"], 6: ["g2"]}


def test_tasks_periods_and_amounts(spark):
    def one(column, *values, schema):
        return [r[0] for r in spark.createDataFrame([(v,) if not isinstance(v, tuple) else v for v in values], schema).select(column).collect()]

    assert one(reviews.review_task(F.col("t")), "单位与口径不符", "累计口径", "EBIT 未定义", "没有回执", None, schema="t string") == ["币种与单位", "期间与统计口径", "财务与业务定义", "未取得的数据与其他问题", None]
    assert one(reviews.period_class(F.col("t")), "FY24A", "2025E", "预计全年", "2025", "24 a", schema="t string") == ["historical", "forecast", "forecast", "unknown", "historical"]
    assert one(reviews.same_year(F.col("a"), F.col("b")), ("2025E", "2025 年度"), ("2025H1", "2025 h1"), ("2025", "2026"), (None, "2025"), schema="a string, b string") == [True, True, False, False]
    amounts = ((2.5e8, "CNY"), (12345.0, None), (3.25, ""), (2e9, "USD"), (1.5e6, "USD"), (-1.23e12, "CNY"))
    assert one(reviews.display_amount(F.col("v"), F.col("c")), *amounts, schema="v double, c string") == ["2.5 亿元", "1.2 万元", "3.25 元", "USD 2bn", "USD 1.5mn", "-12,300 亿元"]


def test_sensitivity_ranks_by_percent(spark):
    df = spark.createDataFrame([("m", "a", 100.0, 95.0, 104.0), ("m", "b", 100.0, 100.0, 100.0), ("m", "c", 100.0, 110.0, 90.0), ("z", "d", 0.0, -1.0, 1.0)], "model string, driver_id string, baseline_output double, down_output double, up_output double")
    got = {r.driver_id: (r["rank"], r.active_driver, r.down_elasticity, r.up_percent) for r in reviews.sensitivity(df, ["model"]).collect()}
    assert got == {"a": (2, True, 1.0, 4.0), "b": (3, False, 0.0, 0.0), "c": (1, True, -2.0, -10.0), "d": (1, True, None, None)}


def test_stale_snapshots_and_guarded_writes(spark):
    old = spark.createDataFrame([("a", "f1", 1), ("b", "f1", 1), ("c", "f1", 1)], "key string, fingerprint string, v int")
    now = spark.createDataFrame([("a", "f1"), ("b", "f2")], "key string, fingerprint string")
    assert {r.key: r.stale for r in reviews.stale(old, now, ["key"]).collect()} == {"a": False, "b": True, "c": True}
    new = spark.createDataFrame([("a", "f0", 2), ("b", "f2", 2), ("b", "f2", 3)], "key string, fingerprint string, v int")
    after = writes.replaced_if_unchanged(old, new, now, ["key"])
    assert rows(after.select("key", "v")) == [("a", 1), ("b", 2), ("b", 3), ("c", 1)]
    assert rows(writes.replaced_if_unchanged(after, new, now, ["key"])) == rows(after)


def test_history_only_grows(spark):
    schema = "key string, v int"
    history = spark.createDataFrame([("a", 1), (None, 5)], schema)
    rows_in = spark.createDataFrame([("a", 9), ("b", 3), ("b", 2), (None, 7)], schema)
    after = writes.appended(history, rows_in, ["key"])
    assert rows(after) == rows(spark.createDataFrame([("a", 1), (None, 5), ("b", 2)], schema)) == rows(writes.appended(after, rows_in, ["key"]))


def test_loads_are_admitted_once(spark):
    schema = "doc_id int, content_hash string, filename string"
    docs = spark.createDataFrame([(1, "h1", "n1")], schema)
    loads = spark.createDataFrame([(2, "h1", "x"), (3, "h3", "n1"), (4, "h4", "n4"), (5, "h4", "n5"), (6, None, None), (7, None, None)], schema)
    assert {r.doc_id: r.reason for r in writes.admitted(docs, loads, False).collect()} == {2: "duplicate content", 3: "duplicate name", 4: None, 5: "duplicate content", 6: None, 7: None}
    assert writes.admitted(docs, loads, True).filter("admitted").count() == 6


def test_publishing_replaces_its_partitions_only(spark, tmp_path):
    path = str(tmp_path / "t")
    writes.publish(spark.createDataFrame([("a", 1), ("b", 2)], "doc string, v int"), path, ["doc"])
    writes.publish(spark.createDataFrame([("b", 3)], "doc string, v int"), path, ["doc"])
    assert rows(spark.read.parquet(path).select("doc", "v")) == [("a", 1), ("b", 3)]


def test_late_trades_change_later_bars(spark):
    bars = spark.createDataFrame([("k", d) for d in (1, 2, 3)], "key string, bar_date int")
    trades = [("k", 2, 10.0, 100.0), ("k", 3, -4.0, -60.0)]
    schema = "key string, trade_date int, quantity double, paid double"
    assert rows(tracking.holdings_at(bars, spark.createDataFrame(trades, schema), "key")) == [("k", 1, 0.0, 0.0), ("k", 2, 10.0, 100.0), ("k", 3, 6.0, 40.0)]
    assert rows(tracking.holdings_at(bars, spark.createDataFrame([*trades, ("k", 1, 1.0, 5.0)], schema), "key")) == [("k", 1, 1.0, 5.0), ("k", 2, 11.0, 105.0), ("k", 3, 7.0, 45.0)]


def test_status_and_open_bars(spark):
    df = spark.createDataFrame([(True, True, None, False, None), (False, True, None, False, None), (False, False, 1, False, None), (False, False, 9, True, "e"), (False, False, 9, False, "e"), (True, False, 9, False, None)], "m boolean, s boolean, target int, after boolean, error string")
    got = [r[0] for r in df.select(tracking.valuation_status(F.col("m"), F.col("s"), F.col("target"), F.col("after"), F.col("error"), F.lit(5))).collect()]
    assert got == ["split_review", "unavailable", "expired", "split_review", "stale", "valid"]
    bars = spark.createDataFrame([(dt.date(2024, 1, 1),), (dt.date(2024, 1, 2),), (dt.date(2024, 1, 3),)], "bar_date date")
    assert tracking.closed_bars(bars, "2024-01-02", False).count() == 1 and tracking.closed_bars(bars, "2024-01-02", True).count() == 2


def test_broken_feeds_are_refused_or_listed(spark):
    for bad in ('{"columns":["d","a","a"],"data":[]}', '{"columns":["d","a"],"data":[["2026-01-01"]]}', "no json"):
        with pytest.raises(Exception, match="market table"):
            feeds.market_table(spark.createDataFrame([(bad,)], "json string"), refuse=True).collect()
    good, uneven = '{"accessionNumber":["a"],"filingDate":["2026-01-02"],"form":["f"],"primaryDocument":["p"]}', '{"accessionNumber":["a"],"filingDate":[],"form":["f"],"primaryDocument":["p"]}'
    raw = spark.createDataFrame([(good,), (uneven,), ("no",), (None,)], "json string")
    assert {r.json for r in feeds.bad_filings(raw).collect()} == {uneven, "no", None}
    with pytest.raises(Exception, match="one length"):
        feeds.filings(raw, ["f"], "2026-01-01", "2026-12-31", refuse=True).collect()
    with pytest.raises(Exception, match="too many"):
        feeds.html_rows(spark.createDataFrame([("<tr></tr><tr></tr>",)], "html string"), most=1).collect()


def test_periods_are_found_in_quotes(spark):
    from sedimark.operators import evidence

    cases = [("FY2026", "revenue in 2026E grew 20%"), ("FY2026", "page 2026 of 2027"), ("2026H1", "in 1H26, sales"), ("FY2026", "26E sales"), ("FY2027", "2026E sales"), ("FY2026", "no period"), ("FY2026", None)]
    df = spark.createDataFrame(cases, "p string, t string")
    assert [r[0] for r in df.select(evidence.period_quoted(F.col("p"), F.col("t"))).collect()] == [True, True, True, True, False, False, False]
