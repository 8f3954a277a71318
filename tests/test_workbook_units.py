"""Units of workbooks: what is stated, what isn't enough, and number formats."""

import pytest
from pyspark.sql import functions as F

from sedimark.functions import workbook_units as units

RESOLVED = [
    ("EURm", "EURm"), ("Units: USD billion", "USDbn"), ("HKD bn", "HKDbn"), ("GBP k", "GBPk"), ("JPY million", "JPYm"), ("CNY元", "CNY"), ("人民币万元", "CNY_10k"), ("人民币百万元", "CNYm"), ("人民币（百万元）", "CNYm"), ("人民币亿元", "CNY_100m"),
    ("RMB million", "CNYm"), ("million USD", "USDm"), ("百万股", "shares_m"), ("shares million", "shares_m"), ("shares_m", "shares_m"), ("shares 10k", "shares_10k"), ("股", "shares"), ("CNY/share", "CNY/share"), ("RMB per share", "CNY/share"), ("%", "%"), ("倍", "x"),
    ("per_share", "per_share"), ("per share (currency unspecified)", "per_share"), ("shares (scale unknown)", "share_count_unspecified_scale"), ("percentage", "%"), ("ＥＵＲ　ｍ", "EURm"),
]
METRICS = [("Revenue", "CNYm"), ("Net income", "CNYm"), ("Weighted Average Shares (Fully Diluted)", "shares_m"), ("EPS", "CNY/share"), ("Target price", "CNY/share")]
FORMATS = [('0.00"CNY million"', "CNYm"), ('#,##0.00"USD"', "USD"), ('0.00"CNY/share"', "CNY/share"), ('"EUR"0.00"/share"', "EUR/share"), ('[$EUR-407]0.00"/share"', "EUR/share"), ("[$EUR-407] #,##0.00", "EUR"), ("0.0%", "%"), ("0.0\\x", "x")]


def found(spark, rows, **options):
    """[(status, (dimension, scale))] of rows (text, expected, metric)."""
    df = spark.createDataFrame([(n, *r, None)[:4] if len(r) == 2 else (n, *r) for n, r in enumerate(rows)], "n int, t string, e string, m string")
    got = df.select("n", units.source_unit(F.col("t"), F.col("e"), F.col("m"), **options).alias("s"), units.canonical_unit(F.col("e")).alias("c")).orderBy("n").collect()
    for r in got:
        assert (r.s.status == "resolved") == (r.c is not None and (r.s.dimension, r.s.scale) == tuple(r.c))
    return [r.s.status for r in got]


def test_units_that_are_stated(spark):
    assert found(spark, RESOLVED) == ["resolved"] * len(RESOLVED)
    header = "Synthetic model: CNY million; shares million; price CNY/share"
    assert found(spark, [(header, unit, label) for label, unit in METRICS]) == ["resolved"] * len(METRICS)
    assert found(spark, [(header, "CNYm", "EPS"), (header, "CNYm"), ("%", "%", "Market share"), ("CNY million", "CNYm", "Share capital"), ("CNY million", "CNYm", "股本")]) == ["conflict", "ambiguous", "resolved", "resolved", "resolved"]


@pytest.mark.parametrize(
    ("rows", "status"),
    [
        ([("CNY million", e) for e in ("EURm", "CNY", "CNYbn", "CNY/share")] + [("per_share", "CNY/share"), ("shares", "share_count_unspecified_scale"), ("元/股", "CNYm")], "conflict"),
        ([(t, "CNYm") for t in ("", None, "General", "currency units")] + [("EPS", "per_share"), ("CNY million", "CNYm", "EPS"), ("CNY million", "CNYm", "Diluted shares"), ("CNY/share", "CNY/share", "Revenue")], "missing"),
        ([(t, "CNY") for t in ("CNY mn", "CNY trillion", "CNY; CHF", "百万元", "millions")] + [("金额单位：百万元", "CNYm", "Revenue")], "unresolved"),
        ([("CNY million; CNY", "CNY", "Revenue"), ("CNY million; CNY", "CNYm"), ("USD; EUR", "USD")], "ambiguous"),
        ([("million CNY billion", "CNYm"), ("百万 股 k", "shares_m")], "two_scales"),
        ([("CNY", "yuan"), ("CNY", None), ("CNY", "CNYmm")], "unsupported"),
    ],
)
def test_units_that_are_not_enough(spark, rows, status):
    assert found(spark, rows) == [status] * len(rows)


def test_number_formats(spark):
    assert found(spark, FORMATS, number_format=True) == ["resolved"] * len(FORMATS)
    assert found(spark, [("#,##0,", "CNYm"), ('0.0,,"CNY"', "CNYm"), ("General", "CNYm"), ("#,##0.00", "CNYm"), ('0.00"元"', "CNYm"), ('0.00"百万元"', "CNYm")], number_format=True) == ["display_scaled", "display_scaled", "missing", "missing", "missing", "unresolved"]


def test_labels_and_equal_codes(spark):
    df = spark.createDataFrame([("RMBm",), ("EUR_100m",), ("CNY_10k",), ("USDbn",), ("GBP/share",), ("shares_k",), ("%",), ("x",), ("none",)], "u string")
    q = units.canonical_unit(F.col("u"))
    got = [(tuple(r[0]) if r[0] else None, r[1]) for r in df.select(q, units.unit_label(q)).collect()]
    assert got == [(("CNY", 1e6), "百万CNY"), (("EUR", 1e8), "亿EUR"), (("CNY", 1e4), "万CNY"), (("USD", 1e9), "十亿USD"), (("GBP/share", 1.0), "GBP/股"), (("shares", 1e3), "千股"), (("ratio", 1.0), "%"), (("multiple", 1.0), "倍"), (None, None)]


def test_each_pattern_is_looked_for_a_few_times(spark):
    df = spark.range(1).select(units.source_unit(F.col("id").cast("string"), F.lit("CNYm")).alias("u")).select("u.status", "u.dimension", "u.scale")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") <= 20
