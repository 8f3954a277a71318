"""Units of workbook cells: a dimension and a scale from what is written beside them, and whether that is enough."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sedimark.functions.numbers import narrowed
from sedimark.functions.text import bound

#: Names of currencies and their codes.
CURRENCY_NAMES = {
    "CNY": "CNY",
    "RMB": "CNY",
    "EUR": "EUR",
    "USD": "USD",
    "HKD": "HKD",
    "GBP": "GBP",
    "JPY": "JPY",
    "人民币": "CNY",
    "欧元": "EUR",
    "美元": "USD",
    "港元": "HKD",
    "英镑": "GBP",
    "日元": "JPY",
}
#: Scale words and what they multiply by.
SCALE_WORDS = {
    "元": 1.0,
    "k": 1e3,
    "千": 1e3,
    "千元": 1e3,
    "_10k": 1e4,
    "10k": 1e4,
    "万": 1e4,
    "万元": 1e4,
    "m": 1e6,
    "million": 1e6,
    "百万": 1e6,
    "百万元": 1e6,
    "_100m": 1e8,
    "100m": 1e8,
    "亿": 1e8,
    "亿元": 1e8,
    "bn": 1e9,
    "billion": 1e9,
}
#: How scales are labelled.
SCALE_LABELS = {1.0: "", 1e3: "千", 1e4: "万", 1e6: "百万", 1e8: "亿", 1e9: "十亿"}
#: Words of a metric's label and the kind of quantity that it is, the first that holds.
METRIC_KINDS = (
    ("per_share", r"(?i)\beps\b|per[\s_-]+share|每股|股价|目标价|\b(?:target|current|reference|share) price\b"),
    ("shares", r"(?i)\bshares\b|\bshare count\b|股数|股份数量"),
    ("multiple", r"(?i)\bp\s*/\s*e\b|\bev\s*/\s*ebitda\b|\bmultiple\b|市盈率|估值倍数|倍数"),
    ("ratio", r"(?i)\b(?:growth|margin|rate|yield|wacc)\b|\bmarket share\b|增长率|增速|利润率|毛利率|税率|折现率|收益率|市场份额"),
    ("amount", r"(?i)\b(?:revenue|sales|costs?|profit|income|earnings|ebitda|ebit|fcf|cash|capex|depreciation|assets?|debt|equity|value|capital)\b|收入|成本|利润|净利|现金流|折旧|资本开支|营运资金|资产|债务|股权价值|企业价值"),
)
#: Scales and currencies that no rule resolves; a text with one of them left says too little.
UNRESOLVED = r"(?i)\b(?:millions?|billions?|thousands?|trillions?|lakh|crore|bn|mn|k|m|AUD|CAD|CHF|SGD)\b|百万元|万元|亿元|千元|人民币|欧元|美元|港元|英镑|日元"

_SCALE = "(?:" + "|".join(sorted((w for w in SCALE_WORDS if w not in ("10k", "100m")), key=len, reverse=True)) + ")"
_CURRENCY = "(?:" + "|".join(CURRENCY_NAMES) + ")"
_MONEY = rf"(?i)(?<![A-Za-z0-9_])({_SCALE})?\s*({_CURRENCY})\s*({_SCALE})?\s*((?:/|per\s+)(?:shares?|股))?(?![A-Za-z0-9_])"
_SHARES = rf"(?i)(?<![A-Za-z0-9_])({_SCALE})?\s*(shares?|股)(?:[_\s]+({_SCALE}|100m|10k))?(?![A-Za-z0-9_])"
_FIXED = (
    (r"\bper_share\b", "unknown_currency/share"),
    (r"\bshare_count_unspecified_scale\b", "unknown_share_scale"),
    (r"(?i)\bper share\s*\(currency (?:unknown|unspecified)\)|每股金额[（(]币种(?:未知|未说明)[）)]", "unknown_currency/share"),
    (r"(?i)\bshares?\s*\(scale (?:unknown|unspecified)\)|股数[（(](?:倍率|尺度)(?:未知|未说明)[）)]", "unknown_share_scale"),
)
_PLAIN = ((r"(?i)%|百分比|(?<![A-Za-z])percent(?:age)?(?![A-Za-z])", "ratio"), (r"(?i)倍|(?<![A-Za-z])(?:multiple|times|x)(?![A-Za-z])", "multiple"))
_CANONICAL = r"^(EUR|USD|CNY|RMB|HKD|GBP|JPY)(k|m|bn|_10k|_100m)?(/share)?$"


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _of(dimension: Column | str, scale: Column | float = 1.0) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(lit(dimension).cast("string").alias("dimension"), lit(scale).cast("double").alias("scale"))


def _scale(word: Column) -> Column:
    return F.when(word == "", F.lit(1.0)).otherwise(_map(SCALE_WORDS)[F.lower(word)])


def canonical_unit(unit: Column) -> Column:
    """struct(dimension, scale) of a canonical unit such as CNYm, USD/share, EUR_100m, shares_10k, % or x; else null."""
    text = narrowed(unit)
    part = lambda n: F.regexp_extract(text, _CANONICAL, n)
    shares = F.regexp_extract(text, r"^shares_(k|10k|m|100m|bn)$", 1)
    return (
        F.when(text.rlike(_CANONICAL), _of(F.concat(_map(CURRENCY_NAMES)[part(1)], part(3)), _scale(part(2))))
        .when((text == "shares") | (shares != ""), _of("shares", _scale(shares)))
        .when(text == "%", _of("ratio"))
        .when(text == "per_share", _of("unknown_currency/share"))
        .when(text == "share_count_unspecified_scale", _of("unknown_share_scale"))
        .when(text.isin("x", "multiple", "times", "倍"), _of("multiple"))
    )


def unit_label(quantity: Column) -> Column:
    """How a quantity is shown: 百万CNY, 亿EUR/股, 千股, % or 倍."""
    dimension, scale = quantity["dimension"], _map(SCALE_LABELS)[quantity["scale"]]
    return (
        F.when(dimension == "shares", F.concat(scale, F.lit("股")))
        .when(dimension == "ratio", "%")
        .when(dimension == "multiple", "倍")
        .when(dimension == "unknown_currency/share", "每股金额")
        .when(dimension == "unknown_share_scale", "")
        .otherwise(F.concat(scale, F.replace(dimension, F.lit("/share"), F.lit("/股"))))
    )


def metric_kind(label: Column) -> Column:
    text = narrowed(F.coalesce(label, F.lit("")))
    return F.coalesce(*[F.when(text.rlike(p), F.lit(kind)) for kind, p in METRIC_KINDS])


def _kind_of(dimension: Column) -> Column:
    return F.when(F.endswith(dimension, F.lit("/share")), "per_share").when(dimension.isin("shares", "unknown_share_scale"), "shares").when(dimension.isin("ratio", "multiple"), dimension).otherwise("amount")


def _format_text(text: Column) -> Column:
    """The literals of a number format in their order: quoted text, currency signs, escaped characters, % and ;"""
    marks = F.regexp_extract_all(text, F.lit(r'"[^"]*"|\[\$(?:CNY|RMB|EUR|USD|HKD|GBP|JPY)(?:-[A-Za-z0-9]+)?\]|\\.|%|;'), F.lit(0))
    plain = lambda m: F.when(m.startswith("["), F.substring(m, 3, 3)).when(m.startswith('"'), F.regexp_replace(m, '"', "")).when(m.startswith("\\"), F.substring(m, 2, 1)).otherwise(m)
    return F.array_join(F.transform(marks, plain), "")


def _matches(text: Column, pattern: str, make) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), make)


def _constant(dimension: str):
    return lambda match: _of(dimension)


def _has_two(pattern: str):
    return lambda match: (F.regexp_extract(match, pattern, 1) != "") & (F.regexp_extract(match, pattern, 3) != "")


def _scaled(pattern: str):
    """The quantity of a match of _MONEY or _SHARES, whose groups 1 and 3 are scales before and after what is counted."""

    def make(match: Column) -> Column:
        part = lambda n: F.regexp_extract(match, pattern, n)
        money = F.concat(_map(CURRENCY_NAMES)[F.upper(part(2))], F.when(part(4) != "", "/share").otherwise("")) if pattern == _MONEY else "shares"
        return _of(money, _scale(F.when(part(1) != "", part(1)).otherwise(part(3))))

    return make


def _taken(pattern: str, make):
    """Adds the quantities of a pattern's matches to what was read before, and takes them out of the text that is left."""

    def take(s: Column) -> Column:
        left = s["left"]
        twice = s["twice"] | F.exists(F.regexp_extract_all(left, F.lit(pattern), F.lit(0)), _has_two(pattern)) if pattern in (_MONEY, _SHARES) else s["twice"]
        return F.struct(F.regexp_replace(left, pattern, " ").alias("left"), F.concat(s["units"], _matches(left, pattern, make)).alias("units"), twice.alias("twice"))

    return take


def source_unit(text: Column, expected: Column, metric: Column | None = None, number_format: bool = False) -> Column:
    """struct(status, dimension, scale, label): the one unit that a source's text states, held against the expected canonical unit.

    All units in the text are read, each scale with its currency or count; with a metric's label
    those of its kind count. status is resolved, or why it isn't: missing (nothing is stated),
    two_scales (before and after one currency), unresolved (a scale or currency is left over),
    ambiguous (several units), display_scaled (a number format that divides what it shows),
    unsupported (the expected unit isn't canonical) or conflict (it is another one). Only a
    resolved unit and a conflicting one have dimension, scale and label. A null text is missing.
    """
    written = F.trim(F.coalesce(text, F.lit("")))
    shown = F.regexp_replace(written, r'"[^"]*"|\\.', "")
    scaled = shown.rlike(r"[0#?],+(?=$|[^0#?,])") if number_format else F.lit(False)
    left = narrowed(_format_text(written) if number_format else written)
    left = F.regexp_replace(left, rf"(?i)({_CURRENCY})\s*\(\s*({_SCALE})\s*\)", "$1 $2")
    state = F.struct(left.alias("left"), F.array().cast("array<struct<dimension:string,scale:double>>").alias("units"), F.lit(False).alias("twice"))
    steps = [(p, _constant(d)) for p, d in _FIXED] + [(p, _scaled(p)) for p in (_MONEY, _SHARES)] + [(p, _constant(d)) for p, d in _PLAIN]
    for pattern, make in steps:
        state = bound(state, _taken(pattern, make))
    expects = canonical_unit(expected)
    kind = metric_kind(metric) if metric is not None else None

    def stated(s: Column) -> Column:
        units = F.array_distinct(s["units"])
        if kind is not None:
            units = bound(kind, lambda k: F.filter(units, lambda u: k.isNull() | (_kind_of(u["dimension"]) == k)))
        return F.struct(s["left"].alias("left"), s["twice"].alias("twice"), units.alias("units"), expects.alias("goal"))

    def judged(s: Column) -> Column:
        one = F.get(s["units"], F.lit(0))
        status = (
            F.when(written == "", "missing")
            .when(scaled, "display_scaled")
            .when(s["twice"], "two_scales")
            .when(s["left"].rlike(UNRESOLVED), "unresolved")
            .when(F.size(s["units"]) == 0, "missing")
            .when(F.size(s["units"]) > 1, "ambiguous")
            .when(s["goal"].isNull(), "unsupported")
            .when(one == s["goal"], "resolved")
            .otherwise("conflict")
        )
        return F.struct(status.alias("status"), one.alias("one"))

    def told(s: Column) -> Column:
        one, known = s["one"], s["status"].isin("resolved", "conflict")
        return F.struct(s["status"].alias("status"), F.when(known, one["dimension"]).alias("dimension"), F.when(known, one["scale"]).alias("scale"), F.when(known, unit_label(one)).alias("label"))

    return bound(bound(bound(state, stated), judged), told)
