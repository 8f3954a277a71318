"""Filters, due work, votes, references, page roles and claim checks on golden rows; folds of long keys."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from sedimark.functions import folds, references
from sedimark.operators import layout, listings
from sedimark.plans import registry


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_conditions_are_put_together(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "a", "y"), (4, None, "x")], "seq int, lane string, kind string")
    assert [r.seq for r in listings.where_all(df).collect()] == [1, 2, 3, 4]
    assert [r.seq for r in listings.where_all(df, lane="a", kind=None).collect()] == [1, 3]
    assert [r.seq for r in listings.where_all(df, after=("seq", 1), kind="x", lane=["a", "b"]).collect()] == [2]
    assert listings.where_all(df, lane=[]).count() == 0


def test_sessions_by_model_and_command(spark):
    sessions = spark.createDataFrame([(1, "Acme/One"), (2, "acme/two"), (3, "other/one")], "s int, model string")
    commands = spark.createDataFrame([(1, "GIT status"), (1, "git log"), (3, "ls")], "s int, command string")
    assert rows(listings.chosen_sessions(sessions, commands, "s", model="ONE")) == [(1, "Acme/One"), (3, "other/one")]
    assert rows(listings.chosen_sessions(sessions, commands, "s", prefixes=["ACME"], contains=["git", "make"])) == [(1, "Acme/One")]


def test_due_trackers(spark):
    day, old = dt.date(2026, 3, 4), dt.date(2026, 3, 3)
    base = {"enabled": True, "start_date": old, "lease_until": None, "last_attempt_at": None, "day": day, "after_close": True, "minutes_after_close": 30, "checked_day": None, "checked_after_close": None}
    cases = {
        "first": {}, "off": {"enabled": False}, "open": {"after_close": False}, "future": {"start_date": dt.date(2026, 4, 1)}, "leased": {"lease_until": 10_000_000}, "freed": {"lease_until": 1}, "just tried": {"last_attempt_at": 9_000_000},
        "yesterday": {"checked_day": old, "checked_after_close": True}, "before close": {"checked_day": day, "checked_after_close": False}, "missing": {"checked_day": day, "checked_after_close": True},
        "seen": {"checked_day": day, "checked_after_close": True}, "late": {"checked_day": day, "checked_after_close": True, "minutes_after_close": 121},
    }
    schema = "id string, enabled boolean, start_date date, lease_until long, last_attempt_at long, day date, after_close boolean, minutes_after_close int, checked_day date, checked_after_close boolean"
    trackers = spark.createDataFrame([(k, *(base | v).values()) for k, v in cases.items()], schema)
    seen = spark.createDataFrame([("seen", day), ("missing", old)], "id string, day date")
    assert {r.id for r in listings.due_trackers(trackers, seen, 9_500_000).collect()} == {"first", "freed", "yesterday", "before close", "missing"}


def test_monitors_polls_and_cursors(spark):
    monitors = spark.createDataFrame([(1, True, 5), (2, True, 50), (3, False, 5), (4, False, 50)], "id int, enabled boolean, next_run_at int")
    assert [r.id for r in listings.due_monitors(monitors, spark.createDataFrame([(4,), (4,)], "id int"), 10).collect()] == [1, 4]
    polled = listings.polls(spark.createDataFrame([(1, "2026-03-10"), (2, None)], "id int, last_checked_at string"), "2026-03-12", 30)
    assert rows(polled.select("id", "poll_from", "poll_to")) == [(1, dt.date(2026, 3, 8), dt.date(2026, 3, 12)), (2, dt.date(2026, 2, 10), dt.date(2026, 3, 12))]
    inputs = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "k string, d string")
    assert rows(listings.unconsumed(inputs, spark.createDataFrame([("a", "1"), ("b", "9")], "k string, d string"), ["k"], "d")) == [("b", "2"), ("c", "3")]


def test_run_totals(spark):
    deliveries = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (1, "b", "y"), (2, "b", "y"), (2, "c", "x"), (2, "d", "w"), (2, "k", "v"), (3, "a", "x")], "run int, id string, digest string")
    known = spark.createDataFrame([("k", "q"), ("z", "w")], "id string, digest string")
    assert rows(listings.run_totals(deliveries, known, "id", "digest").select("run", "discovered", "created", "duplicates")) == [(1, 3, 2, 1), (2, 4, 0, 4), (3, 1, 0, 1)]


def test_votes_and_evaluations(spark):
    hits = spark.createDataFrame([(1, "A", 1, 0, 99), (1, "B", 2, 1, 0), (2, "A", 1, 0, 40), (2, "B", 2, 0, 31), (3, "A", 1, 0, 0)], "doc int, house string, rank int, cover int, other int")
    assert rows(listings.voted_house(hits, ["doc"])) == [(1, "B", 100), (2, "A", 30)]
    cases = spark.createDataFrame([("a", "g"), ("b", "g"), ("c", "g"), ("d", "h")], "id string, g string")
    results = spark.createDataFrame([("a", 80.0, True), ("b", 90.0, True), ("b", 90.0, True), ("d", 55.5, False)], "id string, score double, passed boolean")
    assert rows(listings.evaluated(cases, results, ["g"], "id")) == [("g", 3, 1, 26.7), ("h", 1, 0, 55.5)]


def test_files_and_paths(spark):
    calls = spark.createDataFrame([(1, "c1", 1, "Write", '{"path":"b.txt"}'), (1, "c2", 2, "edit", '{"file_path":"a.txt","path":"z"}'), (1, "c3", 3, "write", '{"path":"b.txt"}'), (1, "c4", 4, "read", '{"path":"r"}'), (1, "c5", 5, "write", '{"path":"bad"}'), (1, "c6", 6, "write", '{"path":"open"}'), (1, "c7", 7, "write", "{}")], "turn int, call_id string, position int, name string, arguments string")
    results = spark.createDataFrame([("c1", False), ("c2", False), ("c3", False), ("c4", False), ("c5", True), ("c7", False)], "call_id string, is_error boolean")
    assert rows(listings.written_files(calls, results, ["turn"])) == [(1, "a.txt", 2), (1, "b.txt", 1)]
    entries = spark.createDataFrame([(1, "see /tmp/a.txt."), (2, "/tmp/a.txt.bak"), (3, "file:///tmp/a.txt, then"), (4, "x/tmp/a.txt"), (5, 'C:\\tmp "\\tmp\\a.txt"'), (6, None)], "entry_id int, text string")
    assert rows(listings.path_references(entries, spark.createDataFrame([("/tmp/a.txt",)], "path string"))) == [("/tmp/a.txt", 1), ("/tmp/a.txt", 3), ("/tmp/a.txt", 5)]


def test_calculations(spark):
    fact = "id string, base_value double, dimension string, period string, year int, grain string, label string, cell string, condition string, role string"
    facts = spark.createDataFrame(
        [
            ("e24", 2.0, "CNY/share", "FY2024", 2024, "year", "eps", "A1", None, "input"), ("e25", 3.0, "CNY/share", "FY2025", 2025, "year", "eps", "A2", None, "input"), ("e25b", 4.0, "CNY/share", "FY2025", 2025, "year", "eps", "A2", "bull", "input"),
            ("pe", 10.0, "multiple", None, None, None, "pe", "A3", None, "input"), ("t", 30.0, "CNY/share", None, None, None, "target", "A4", None, "target_price"), ("p", 20.0, "CNY/share", None, None, None, "price", "A5", None, "current_price"),
            ("z", 0.0, "CNY/share", "FY2024", 2024, "year", "eps", "A6", None, "input"), ("u", 1.0, "unknown_x", "FY2024", 2024, "year", "eps", "A7", None, "input"),
        ],
        fact,
    )
    asked = [("g", "growth", "e24", "e25"), ("g0", "growth", "z", "e25"), ("gx", "growth", "e25", "e24"), ("c", "change", "e25", "e25b"), ("r", "ratio", "e24", "z"), ("r2", "ratio", "z", "e24"), ("up", "upside", "t", "p"), ("up2", "upside", "p", "t"), ("m", "product", "e25", "pe"), ("ux", "ratio", "u", "u"), ("no", "ratio", "e24", "?"), ("op", "power", "t", "p")]
    got = {r.id: (r.value, r.issue) for r in listings.calculations(spark.createDataFrame(asked, "id string, operation string, left string, right string"), facts).collect()}
    values = {"g": 0.5, "c": 1.0, "r2": 0.0, "up": 0.5, "m": 30.0}
    issues = {"g0": "base not positive", "gx": "not comparable", "r": "not comparable", "up2": "not comparable", "ux": "not comparable", "no": "unknown input", "op": "unknown operation"}
    assert got == {k: (v, None) for k, v in values.items()} | {k: (None, v) for k, v in issues.items()}


def test_source_ids_and_citations(spark):
    df = spark.createDataFrame([("d-1", 3, 5, '预测 "A"', "B2:C9")], "doc string, a int, b int, sheet string, cells string")
    c = F.col
    ids = {"pdf": (c("a"), c("b")), "excel": (c("sheet"), c("cells")), "text": (c("a"), c("b")), "block": (c("a"),)}
    for kind, place in ids.items():
        made = references.source_id(c("doc"), kind, *place)
        r = df.select(made.alias("id"), references.parsed_source(made).alias("p"), *place).first()
        assert r.id.startswith("source:") and not set("+/=") & set(r.id[7:])
        assert tuple(r.p)[:2] == ("d-1", kind) and r.p.first == str(r[2]) and (kind == "block" or r.p.last == str(r[3]))
    assert df.select(references.source_id(c("doc"), "pdf", c("a"), c("b"))).first()[0] == "source:WyJkLTEiLCJwZGYiLDMsNV0"
    bad = spark.createDataFrame([("source:",), ("source:!!",), ("source:WyJkLTEiLCJwZGYiLDUsM10",), ("nothing",), (None,)], "s string")
    assert [r[0] for r in bad.select(references.parsed_source(c("s"))).collect()] == [None] * 5
    assert df.select(references.phrase(F.lit('say "x"'))).first()[0] == '"say ""x"""'


def test_edits_are_found(spark):
    df = spark.createDataFrame([("a 'b' c", "'b'"), ("a \u2018b\u2019 \u2014 c", "'b' -"), ("x  \ny", "x\ny"), ("aXa", "z"), ("aba", "a"), ("a", "")], "content string, old string")
    got = [tuple(r[0]) for r in df.select(references.found_text(F.col("content"), F.col("old"))).collect()]
    assert got[:5] == [(2, False, 1), (2, True, 1), (0, True, 1), (-1, False, 0), (0, False, 2)] and got[5][2] == 0


def test_percentages(spark):
    df = spark.createDataFrame([(0.25, "0.0%", None), (0.25, 'general "%"', None), (25.0, None, None), (0.25, None, "25 %"), (0.25, None, None), (None, "0%", None)], "v double, f string, s string")
    assert [r[0] for r in df.select(references.percent_base(F.col("v"), F.col("f"), F.col("s"))).collect()] == [0.25, None, 0.25, 0.25, None, None]


@pytest.mark.parametrize(
    ("role", "number", "text", "counts"),
    [
        ("cover", 1, "Rating history", (0, 0, 0)), ("rating_history", 3, "Rating History of the firm", (0, 0, 0)), ("valuation_method", 3, "x\n估值方法", (0, 0, 0)), ("valuation_method", 3, "x\nValuation methodology", (0, 0, 0)),
        ("body", 3, "Valuation methods may differ", (0, 0, 0)), ("disclosure_boilerplate", 3, "Exhibit 2: ratings\nImportant Disclosures", (0, 0, 0)), ("disclosure_boilerplate", 3, "securities regulation " * 80, (0, 0, 0)),
        ("disclosure_boilerplate", 9, "其他风险", (0, 0, 0)), ("exhibit_image", 3, "photo", (2, 2, 0)), ("table_heavy", 3, "1,234.5 6,789\ntotal", (0, 0, 0)), ("exhibit_chart", 3, "Figure 3: growth\nwords of text", (0, 0, 12)),
        ("exhibit_image", 3, "图表 5：growth\nwords of text", (1, 0, 0)), ("body", 3, None, (0, 0, 0)),
    ],
)
def test_page_roles(spark, role, number, text, counts):
    one = F.lit(1.0)
    pages = spark.createDataFrame([("p", number, 9, text, *counts)], "page string, number int, total int, text string, images int, large_images int, drawings int")
    lines = pages.select("page", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("text"))
    found = layout.page_roles(pages, lines.withColumn("type", layout.block_type(F.col("text"), one, one)), ["page"]).first()
    assert found.role == role and (role == "body") == (not any(set(names) <= set(found.signals) for _, names in layout.ROLES))


def test_block_types(spark):
    df = spark.createDataFrame([("主持人：您好", 10.0), ("12.5% 3,400", 10.0), ("12", 10.0), ("Outlook", 13.0), ("w " * 41, 13.0)], "t string, h double")
    assert [r[0] for r in df.select(layout.block_type(F.col("t"), F.col("h"), F.lit(10.0))).collect()] == ["speaker", "table_row", "body", "heading", "body"]


def test_claim_quality(spark):
    schema = "v double, lo double, hi double, unit string, period string, required boolean, quote string, unverified int, dropped int, stance string, confidence double"
    good = (12.5, None, None, "%", "FY2025", True, "margin of 12.5% in FY2025", 0, 0, "bullish", 1.7)
    change = lambda **kw: tuple(kw.get(n, x) for n, x in zip(("v", "lo", "hi", "unit", "period", "required", "quote", "unverified", "dropped", "stance", "confidence"), good, strict=True))
    claims = [good, change(v=2.5), change(unit=None), change(unit="bps"), change(period=None), change(period="FY2026"), change(unverified=1), change(dropped=1, stance="?", confidence=None), change(v=None, lo=12.5, hi=3.0), change(v=None, unit=None, period=None)]
    df = spark.createDataFrame(claims, schema)
    got = [tuple(r[0]) for r in df.select(layout.claim_quality(*[F.col(c) for c in df.columns])).collect()]
    review = lambda *issues: ("review_required", list(issues), 1.0)
    assert got == [
        ("verified", [], 1.0), review("value_not_in_quote"), review("numeric_without_unit"), review("unit_not_in_quote"), review("period_missing"), review("period_not_in_quote"), ("quote_unverified", ["quote_not_found_in_evidence"], 0.4),
        ("verified", ["dropped_unknown_evidence_id", "stance_defaulted"], 0.5), review("invalid_value_range", "value_not_in_quote"), ("verified", [], 1.0),
    ]


def test_lines_in_budget(spark):
    lines = spark.createDataFrame([("a", 1, "é"), ("a", 2, "xx"), ("a", 3, "y" * 9), ("a", 4, "z"), ("b", 1, "long line"), ("c", 1, None)], "k string, n int, t string")
    assert rows(listings.in_budget(lines, ["k"], "n", "t", 8)) == [("a", 2, 6, 2), ("b", 0, 0, 1), ("c", 1, 1, 0)]


def test_traces_and_names(spark):
    traces = spark.createDataFrame([(1, False), (2, True), (3, False), (4, False)], "trace_id int, truncated boolean")
    issues = spark.createDataFrame([(3, "formula_cache_unavailable"), (4, "missing"), (4, "missing")], "trace_id int, code string")
    assert rows(listings.complete_traces(traces, issues).select("trace_id", "complete")) == [(1, True), (2, False), (3, True), (4, False)]
    hits = spark.createDataFrame([("e1", 1.0), ("e2", 2.0), ("e3", 3.0)], "entry_id string, score double")
    entries = spark.createDataFrame([("e1", "s1", "message"), ("e2", "s2", "message"), ("e3", "s2", "tool")], "entry_id string, session_id string, type string")
    sessions = spark.createDataFrame([("s1",), ("s2",)], "session_id string")
    facts = spark.createDataFrame([("s2", 1, "name", "old"), ("s2", 2, "name", "new"), ("s2", 3, "tag", "t")], "session_id string, seq int, kind string, value string")
    assert rows(listings.named_hits(hits, entries, sessions, facts, ["message"]).select("entry_id", "session_name", "has_name")) == [("e1", None, False), ("e2", "new", True)]


def test_folds_stream_over_batches(spark):
    """A key that spans many Arrow batches, a null key and an empty table."""
    df = spark.range(50_000).select(F.when(F.col("id") % 3 > 0, "hot").alias("k"), F.col("id").alias("o"))

    def count(group):
        n = last = 0
        for (o,) in group:
            assert o >= last
            n, last = n + 1, o
        yield (n, last)

    assert rows(folds.folded(df, ["k"], ["o"], count, "n long, last long")) == sorted([("hot", 33_333, 49_999), (None, 16_667, 49_998)], key=str)
    odd = spark.createDataFrame([(float("nan"), 1), (float("nan"), 2), (None, 3), (1.0, 4)], "k double, o int").repartition(3)
    assert sorted(r.n for r in folds.folded(odd, ["k"], ["o"], count, "n long, last long").collect()) == [1, 1, 2]
    assert folds.folded(df.limit(0), ["k"], ["o"], count, "n long, last long").collect() == []


def test_page_roles_of_odd_texts_are_those_of_the_sql(spark, tmp_path):
    words = "mots " * 300  # 1,200 letters
    texts = [
        words + "actúa " * 9, words + "act é " * 9, words + "éact " * 9, words + "\u017fecurities " * 9, words + "brokers " * 8, "x\rdisclaimer\rx", "x\u2028disclaimer\u2028x", "\x0bdisclaimer", "x\r\ndisclaimer\r\nx",
        "\n".join(["12345678"] * 7 + ["words of no number"] * 18), "\n".join(["1234567 words of a line.."[:25]] * 3), "\n".join(["a 1"] * 3 + ["b"] * 2 + ["\xa0", "\u3000 "]), "a\x0bFigure 1: x", "Figure\x0b1: x", None, "", "\xa0",
    ]
    rows = [(n * 84 + k, text) for n, text in enumerate(texts) for k in range(84)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = {tuple(r) for r in registry.queries()["page_roles"](spark, str(tmp_path)).collect()}
    assert found == set(con.execute(registry.oracle_sql()["page_roles"]).fetchall())


def test_claim_quality_looks_for_each_pattern_a_few_times(spark):
    row = spark.range(1).selectExpr("1.5D AS v", "'FY' || id AS u", "'1.5 in FY2024' || id AS q", "0.5D + id AS c", "id")
    col, zero, none = F.col, F.col("id"), F.lit(None).cast("double")
    got = row.select(layout.claim_quality(col("v"), none, none, col("u"), F.lit("FY2024"), F.lit(True), col("q"), zero, zero, F.lit("Neutral"), col("c")).alias("g")).select("g.status", "g.issues", "g.confidence")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") <= 4 and plan.count("translate(") <= 8
