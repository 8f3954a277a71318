import pytest
from pyspark.sql import functions as F

from sedimark.functions import matching, numbers, text


def evaluate(spark, column, *rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


@pytest.mark.parametrize(("written", "canonical"), [("2026E", "FY2026"), ("FY26", "FY2026"), ("2026年", "FY2026"), ("26E", "FY2026"), ("2026H1", "2026H1"), ("1H26", "2026H1"), ("2026年上半年", "2026H1"), ("2026Q3", "2026Q3"), ("3Q2026", "2026Q3"), ("FY2026-FY2028", "FY2026-FY2028"), ("FY2028-FY2026", "FY2028"), ("26", "26"), ("soon", "soon"), ("H1 2026", "2026H1"), ("FY2026-28", "FY2026-FY2028"), ("２０２６年", "FY2026"), ("2026第三季度", "2026Q3"), ("Q1FY26", "2026Q1"), ("2026/27", "FY2026"), ("上半年2026", "2026H1"), ("2026 至 2028", "FY2026-FY2028"), ("2026～28年", "FY2026-FY2028"), ("2028-26", "FY2028"), ("3Q26E", "2026Q3"), ("2H26", "2026H2"), ("26A", "FY2026"), ("2022Q3", "2022Q3"), ("2021H2", "2021H2"), ("2024 Q4", "2024Q4"), ("2024 4Q", "2024 4Q"), ("year to Dec 2027", "FY2027"), ("2026年4季", "2026Q4"), ("20261", "20261"), ("未来三年", "未来三年"), (" soon ", "soon"), ("", ""), (None, None)])
def test_period(spark, written, canonical):
    assert evaluate(spark, numbers.period(F.col("x")), (written,), schema="x string") == [canonical]


@pytest.mark.parametrize(("value", "unit", "currency", "want"), [(165.0, "亿元", None, (1.65e10, "元", "CNY")), (16500.0, "百万元", None, (1.65e10, "元", "CNY")), (1.65e10, "元", None, (1.65e10, "元", "CNY")), (25.0, "bp", None, (0.25, "pp", None)), (3.0, "pp", None, (3.0, "pp", None)), (12.0, "%", None, (12.0, "%", None)), (8.0, "x", None, (8.0, "x", None)), (8.0, "倍", None, (8.0, "x", None)), (2.5, "元/股", None, (2.5, "元/股", "CNY")), (3.0, "million", "USD", (3e6, "元", "USD")), (0.5, "元/Wh", None, (0.5, "元/wh", None))])
def test_quantity(spark, value, unit, currency, want):
    (got,) = evaluate(spark, numbers.quantity(F.col("v"), F.col("u"), F.col("c")), (value, unit, currency), schema="v double, u string, c string")
    assert got.value == pytest.approx(want[0]) and (got.unit, got.currency) == want[1:]


def test_cell_ranges(spark):
    got = evaluate(spark, numbers.cell_range(F.col("x")), ("B2:A1",), ("$C$3",), ("XFD1048576",), ("XFE1",), ("A0",), ("?",), schema="x string")
    assert [tuple(g) if g else None for g in got] == [(1, 2, 1, 2), (3, 3, 3, 3), (1048576, 1048576, 16384, 16384), None, None, None]


def test_dates_numbers_and_rounding(spark):
    assert evaluate(spark, numbers.iso_date(F.col("x")).cast("string"), ("2026-02-28",), ("2026-02-30",), ("20260131",), ("x",), schema="x string") == ["2026-02-28", None, "2026-01-31", None]
    assert evaluate(spark, numbers.number(F.col("x")), ("1,234.5",), ("NaN",), ("abc",), (None,), schema="x string") == [1234.5, None, None, None]
    assert evaluate(spark, numbers.half_up(F.col("x")), (2.5,), (-2.5,), (-2.6,), schema="x double") == [3.0, -2.0, -3.0]
    assert evaluate(spark, numbers.backoff_ms(F.col("x")), (0,), (3,), (50,), schema="x int") == [30_000, 240_000, 3_600_000]


def test_query_terms_and_scores(spark):
    terms = text.query_terms("ＧＭＶ growth 动力电池装机量")
    assert terms[:2] == ["gmv", "growth"] and "动力电池装机量" in terms and "电池" in terms and "动力电池" in terms
    assert text.query_terms("价") == ["价"]
    (score,) = evaluate(spark, text.lexical_score(F.col("x"), ["abc"]), ("abcabc ABC",), schema="x string")
    assert score == 3 * 1.5
    assert evaluate(spark, text.occurrences(F.col("x"), "aa"), ("aaaaa",), ("",), (None,), schema="x string") == [2, 0, 0]


def test_html_ansi_commands(spark):
    assert evaluate(spark, text.html_text(F.col("x")), ("<p>a &amp; b</p><script>var x='</p>'</script><!-- c --><div>d<br>e</div>",), schema="x string") == ["a & b\nd\ne"]
    assert evaluate(spark, text.stripped_ansi(F.col("x")), ("\x1b[31mred\x1b[0m",), schema="x string") == ["red"]
    assert evaluate(spark, text.command_key(F.col("x")), ("A=1 sudo git status -s",), ("ls -l",), schema="x string") == ["git status", "ls"]
    assert evaluate(spark, text.file_extension(F.col("x")), ("a/b.TS",), ("a/.env",), ("x",), schema="x string") == ["ts", "(none)", "(none)"]
    assert evaluate(spark, text.slug(F.col("x")), ("Net  Profit 净利润!",), schema="x string") == ["net-profit-净利润"]


def test_nfkc(spark):
    assert evaluate(spark, text.nfkc(F.col("x")), ("Ａ１",), (None,), schema="x string") == ["A1", None]


def test_fuzzy(spark):
    def scores(query, *texts):
        return evaluate(spark, matching.fuzzy_score(query, F.col("t")), *[(t,) for t in texts], schema="t string")

    assert scores("abc", "xyz", None, "ab") == [None, None, None]
    # places 0 1 2: runs of 1, 2, 3, one word start, 0.1 * 3, whole
    assert scores("abc", "ABC", "abcd") == pytest.approx([-30 - 10 + 0.3 - 100, -30 - 10 + 0.3])
    # places 0 2 4: one run, two gaps of one, three starts
    assert scores("abc", "a-b-c", "axbxc") == pytest.approx([-5 + 4 - 30 + 0.6, -5 + 4 - 10 + 0.6])
    assert scores("b", "a(b", "a.b", "a b", "a:b", "a/b", "a_b", "a-b") == pytest.approx([0.2] + [-9.8] * 6)
    assert scores("12ab", "ab12") == pytest.approx([-50 - 10 + 0.6 - 100 + 5])
    assert scores("", "x", None) == [0.0, None]
    both = evaluate(spark, matching.fuzzy(F.col("t"), " ab/cd "), ("ab cd",), ("ab",), (None,), schema="t string")
    assert both[1:] == [None, None] and both[0] == pytest.approx(scores("ab", "ab cd")[0] + scores("cd", "ab cd")[0])


@pytest.mark.parametrize(
    ("unit", "code", "want"),
    [("千亿元", "", (2e11, "元", "CNY")), ("百亿美元", "", (2e10, "元", "USD")), ("千万港币", "", (2e7, "元", "HKD")), ("十万", "CNY", (2e5, "元", "CNY")), ("USD mn", "", (2e6, "元", "USD")), ("us$ bn", "", (2e9, "元", "USD")),
     ("美金", "", (2.0, "元", "USD")), ("k eur", "", (2e3, "元", "EUR")), ("元/股", "", (2.0, "元/股", "CNY")), ("25bps", "", (0.02, "pp", None)), ("新台币", "", (2.0, "元", "TWD")), ("tons", "", (2.0, "tons", None)), ("x", "", (2.0, "x", None)),
     ("$", "", (2.0, "元", "USD")), ("¥", "", (2.0, "元", "CNY")), ("€", "", (2.0, "元", "EUR")), ("£", "", (2.0, "元", "GBP")), ("$bn", "", (2e9, "元", "USD")), ("£ mn", "", (2e6, "元", "GBP")), ("pct", "", (2.0, "%", None)), ("％", "", (2.0, "%", None)),
     ("times", "", (2.0, "x", None)), ("×", "", (2.0, "x", None)), ("ppts", "", (2.0, "pp", None)), ("个百分点", "", (2.0, "pp", None)), ("每股元", "", (2.0, "元/股", "CNY")), ("HK$/share", "", (2.0, "元/股", "HKD")), ("亿", "人民币", (2e8, "元", "CNY")), ("亿", "", (2.0, "亿", None)),
     ("GW", "us$", (2.0, "gw", "USD")), ("万台", "", (2.0, "万台", None)), ("美元/吨", "", (2.0, "美元/吨", None)), ("p/e x", "", (2.0, "x", None)), ("", "Swiss francs", (2.0, "元", "SWISSFRA")), (None, None, (2.0, "", None)), ("ＲＭＢ　ｍｎ", "", (2e6, "元", "CNY"))],
)
def test_quantities(spark, unit, code, want):
    got = evaluate(spark, numbers.quantity(F.col("v"), F.col("u"), F.col("c")), (2.0, unit, code), schema="v double, u string, c string")
    assert tuple(got[0]) == want


def test_changed_bytes(spark):
    assert evaluate(spark, matching.changed_bytes(F.col("a"), F.col("b")), ("hello world", "hello new world"), ("same", "same"), ("aa", "aaa"), schema="a string, b string") == [4, 0, 1]


def test_formula_references():
    found = {r[1]: (r[2], r[3], r[4], r[5]) for r in matching.formula_references("=SUM(A1:B2)+'My Sheet'!$C$3+[Book.xlsx]S!D4+S1:S3!E5+A:A+Rate+#REF!+Table1[Col]+\"A9\"")}
    assert found["A1:B2"] == ("range", None, None, "A1:B2")
    assert found["'My Sheet'!$C$3"] == ("cell", "My Sheet", None, "C3")
    assert found["[Book.xlsx]S!D4"] == ("external", "S", "Book.xlsx", "D4")
    assert found["S1:S3!E5"][0] == "3d" and found["A:A"][0] == "whole" and found["Rate"][0] == "name" and found["#REF!"][0] == "error" and found["Table1[Col]"][0] == "structured"
    assert not any("A9" in raw for raw in found)


def test_greedy_windows(spark):
    pages = spark.createDataFrame([("d", i, n) for i, n in enumerate([5, 5, 0, 4, 9, 20, 1])], "doc string, page int, n int")
    got = {r.page: r.window for r in matching.greedy_windows(pages, ["doc"], "page", F.col("n"), 10, most=3).collect()}
    assert got == {0: 0, 1: 0, 3: 1, 4: 2, 5: None, 6: None}


def test_column_labels_beyond_a_sheet(spark):
    numbers_ = [0, 1, 26, 27, 702, 703, 18278, 18279, 120_000, 7_200_000, 26**7, 2**31, 2**63 - 1]

    def label(n):
        return "" if n == 0 else label((n - 1) // 26) + chr(65 + (n - 1) % 26)

    df = spark.createDataFrame([(n,) for n in [*numbers_, -1, None]], "n long").select("n", numbers.column_label(F.col("n")).alias("label"))
    got = {r.n: (r.label, r.back) for r in df.select("n", "label", numbers.column_number(F.col("label")).alias("back")).collect()}
    assert got == {n: (label(n), n) for n in numbers_} | {-1: (None, None), None: (None, None)}
