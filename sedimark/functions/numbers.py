"""Numbers, dates, periods, units and spreadsheet addresses as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sedimark.functions.text import bound

#: Scale words of amounts in the order in which they are looked for, and what they multiply by.
SCALES = (
    ("万亿", 1e12), ("千亿", 1e11), ("百亿", 1e10), ("十亿", 1e9), ("亿", 1e8), ("千万", 1e7), ("百万", 1e6), ("十万", 1e5), ("万", 1e4), ("千", 1e3),
    ("trillion", 1e12), ("tn", 1e12), ("billion", 1e9), ("bn", 1e9), ("million", 1e6), ("mn", 1e6), ("mm", 1e6), ("thousand", 1e3), ("k", 1e3),
)
#: Words for a currency in the order in which they are looked for, and its code.
CURRENCIES = (
    ("人民币", "CNY"),
    ("rmb", "CNY"),
    ("cny", "CNY"),
    ("美元", "USD"),
    ("美金", "USD"),
    ("usd", "USD"),
    ("us$", "USD"),
    ("港元", "HKD"),
    ("港币", "HKD"),
    ("hkd", "HKD"),
    ("hk$", "HKD"),
    ("欧元", "EUR"),
    ("eur", "EUR"),
    ("日元", "JPY"),
    ("jpy", "JPY"),
    ("新台币", "TWD"),
    ("台币", "TWD"),
    ("twd", "TWD"),
    ("元", "CNY"),
    ("$", "USD"),
    ("¥", "CNY"),
    ("€", "EUR"),
    ("£", "GBP"),
    ("gbp", "GBP"),
)
#: How units of percentage points and basis points end, and the marks of percent, multiples and amounts a share.
PP_ENDS = ("个百分点", "百分点", "pp", "ppt", "ppts", "bp", "bps")
PERCENT_MARKS = ("%", "％", "pct", "percent", "百分比")
MULTIPLES = ("x", "×", "倍", "times")
PER_SHARE_MARKS = ("/股", "每股", "/share")
#: How years, quarters, halves and ranges of years are written, in lower case without spaces.
FULL_YEAR = r"(20\d{2})(?!\d)"
MARKED_YEARS = (r"(?:fy|cy|q[1-4]|[1-4]q|h[12]|[12]h)(\d{2})(?!\d)", r"(?<!\d)(\d{2})(?=e|a|f|年)")
QUARTER = r"(?:q([1-4])|(?<!\d)([1-4])q|第?([一二三四1-4])季度?)"
HALF = r"(?:h([12])|(?<!\d)([12])h|(上|下)半年)"
YEAR_RANGE = r"(20\d{2})(?:-|–|—|~|至|到)(?:fy|cy)?(20\d{2}|\d{2})"
#: Full-width forms and the plain characters that they stand for.
_WIDE, _NARROW = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　￥￡", "".join(map(chr, range(0x21, 0x7F))) + " ¥£"


def narrowed(text: Column) -> Column:
    """Full-width forms as plain ones; for other compatibility forms a text goes through text.nfkc first."""
    return F.trim(F.translate(text, _WIDE, _NARROW))


def _bare(text: Column) -> Column:
    return F.replace(F.lower(narrowed(text)), F.lit(" "), F.lit(""))


def half_up(value: Column, digits: int = 0) -> Column:
    """Rounding halves toward plus infinity."""
    scale = 10.0**digits
    return F.floor(value * scale + 0.5) / scale


def number(text: Column) -> Column:
    """A finite double from text with thousands commas, else null."""
    value = F.regexp_replace(F.trim(text), "[,，]", "").try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def positive(value: Column, most: float = 1e12) -> Column:
    return F.coalesce(~F.isnan(value) & (value > 0) & (value <= most), F.lit(False))


def same_value(a: Column, b: Column, tolerance: float = 1e-10) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(tolerance), tolerance * F.greatest(F.abs(a), F.abs(b)))


def change_percent(value: Column, base: Column) -> Column:
    """Change against |base| in percent; null without a base or at zero."""
    return F.try_divide(value - base, F.abs(base)) * 100


def iso_date(text: Column) -> Column:
    """A date from YYYY-MM-DD or YYYYMMDD, null where there is no such day."""
    compact = F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    return F.when(compact.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(compact, "yyyy-MM-dd"))


def period(text: Column) -> Column:
    """FY2026, 2026H1, 2026Q3 or FY2026-FY2028 from the ways in which these are written.

    A range goes first, if its end isn't before its start; two digits at its end are of
    the same century. A canonical range stays as it is. Else the first year counts: four digits, or two with a marker
    (FY26, 26E, 3Q26). With a quarter anywhere beside it that is the period, else with a
    half that; the last digit of a year is no quarter, as in 2022Q3. Text without a year stays as it is written, but for full-width forms and
    spaces at its ends.
    """
    return _period(_bare(text), narrowed(text))


def _period(clean: Column, written: Column) -> Column:
    """The period of a bare text, or what is written."""

    def found(pattern: str, *groups: int) -> Column:
        return F.coalesce(*[F.nullif(F.regexp_extract(clean, pattern, g), F.lit("")) for g in groups])

    first, last = found(YEAR_RANGE, 1), found(YEAR_RANGE, 2)
    last = F.when(F.length(last) == 2, F.concat(F.left(first, F.lit(2)), last)).otherwise(last)
    year = F.coalesce(found(FULL_YEAR, 1), *[F.concat(F.lit("20"), found(p, 1)) for p in MARKED_YEARS])
    quarter, half = F.translate(found(QUARTER, 1, 2, 3), "一二三四", "1234"), F.translate(found(HALF, 1, 2, 3), "上下", "12")
    return (
        F.when(last >= first, F.concat(F.lit("FY"), first, F.lit("-FY"), last))
        .when(year.isNull(), written)
        .when(quarter.isNotNull(), F.concat(year, F.lit("Q"), quarter))
        .when(half.isNotNull(), F.concat(year, F.lit("H"), half))
        .otherwise(F.concat(F.lit("FY"), year))
    )


def is_period(text: Column, canonical: Column) -> Column:
    """Whether the period of a text in NFKC is the canonical one; the text is made bare once."""
    return bound(F.trim(text), lambda t: bound(F.replace(F.lower(t), F.lit(" "), F.lit("")), lambda clean: _period(clean, t)) == canonical)


def period_order(text: Column) -> Column:
    """struct(year, grain) that sorts canonical periods."""
    year = F.regexp_extract(text, r"(20\d{2})", 1).try_cast("int")
    grain = F.coalesce(F.regexp_extract(text, r"Q([1-4])", 1).try_cast("int"), F.regexp_extract(text, r"H([12])", 1).try_cast("int") * 2, F.lit(5))
    return F.struct(year.alias("year"), grain.alias("grain"))


def currency_code(text: Column) -> Column:
    """The code of the first listed currency that a text names, else its first eight characters in upper case; null for nothing."""
    clean = _bare(text)
    named = F.when(F.contains(clean, F.lit(CURRENCIES[0][0])), CURRENCIES[0][1])
    for word, code in CURRENCIES[1:]:
        named = named.when(F.contains(clean, F.lit(word)), code)
    return F.nullif(F.coalesce(named, F.left(F.upper(clean), F.lit(8))), F.lit(""))


def quantity(value: Column, unit: Column, currency: Column) -> Column:
    """struct(value, unit, currency) in canonical units.

    Basis points and percentage points become pp, percent %, multiples x. Amounts of a
    currency, with a scale word before or after it, become units of it (a share, where
    the unit says so); a scale word alone needs the currency beside it. Other units, such
    as prices a ton, keep their value and are written in lower case without spaces.
    """
    clean, code = F.coalesce(_bare(unit), F.lit("")), currency_code(currency)

    def any_of(*tests: Column) -> Column:
        out = tests[0]
        for t in tests[1:]:
            out = out | t
        return out

    per_share = any_of(*[F.contains(clean, F.lit(m)) for m in PER_SHARE_MARKS])
    names_currency = any_of(*[F.contains(clean, F.lit(w)) for w, _ in CURRENCIES])
    words = "|".join(word for word, _ in SCALES)
    front, back = F.regexp_extract(clean, rf"^({words})", 1), F.regexp_extract(clean, rf"^.+?({words})$", 1)
    factors, codes = F.create_map(*[F.lit(x) for pair in SCALES for x in pair]), F.create_map(*[F.lit(x) for pair in CURRENCIES for x in pair])
    scale = F.coalesce(factors[F.coalesce(F.nullif(front, F.lit("")), back)], F.lit(1.0))
    rest = F.when(front != "", F.substr(clean, F.length(front) + 1)).otherwise(F.left(clean, F.length(clean) - F.length(back)))
    for mark in PER_SHARE_MARKS:
        rest = F.replace(rest, F.lit(mark), F.lit(""))
    known = F.coalesce(codes[rest], F.when(rest == "", code))
    make = lambda v, u, c: F.struct(v.cast("double").alias("value"), u.cast("string").alias("unit"), c.cast("string").alias("currency"))
    none = F.lit(None).cast("string")
    return (
        F.when(value.isNull(), make(value, clean, code))
        .when(clean.rlike("bps?$"), make(value * 0.01, F.lit("pp"), none))
        .when(any_of(*[F.endswith(clean, F.lit(e)) for e in PP_ENDS]), make(value, F.lit("pp"), none))
        .when(any_of(*[F.contains(clean, F.lit(m)) for m in PERCENT_MARKS]), make(value, F.lit("%"), none))
        .when(clean.isin(*MULTIPLES) | (clean.rlike("[倍x]$") & ~names_currency), make(value, F.lit("x"), none))
        .when(known.isNotNull(), make(value * scale, F.when(per_share, F.lit("元/股")).otherwise(F.lit("元")), known))
        .otherwise(make(value, clean, code))
    )


def column_number(letters: Column) -> Column:
    """A to 1, Z to 26, AA to 27, as a long."""
    return F.aggregate(F.filter(F.split(F.upper(letters), ""), lambda c: c != ""), F.lit(0).cast("long"), lambda n, c: n * 26 + (F.ascii(c) - 64))


#: The first numbers whose labels have one letter, two and so on, as far as a long goes.
_FIRST_LABELS = [(26**k - 1) // 25 for k in range(1, 15)]


def column_label(n: Column) -> Column:
    """1 to A, 26 to Z, 27 to AA, for all longs; 0 has no letters, a number below it no label."""
    n = n.cast("long")
    letter = lambda k, first: F.char(F.call_function("div", n - first, F.lit(26**k)) % 26 + 65)
    letters = [F.when(n >= first, letter(k, first)).otherwise("") for k, first in enumerate(_FIRST_LABELS)]
    return F.when(n >= 0, F.concat(*reversed(letters)))


def cell_range(text: Column) -> Column:
    """struct(row_start, row_end, col_start, col_end) of an A1 range, ends in order; null if it isn't one."""
    pattern = r"^\$?([A-Za-z]{1,3})\$?(\d{1,7})(?::\$?([A-Za-z]{1,3})\$?(\d{1,7}))?$"
    part = lambda i: F.regexp_extract(text, pattern, i)
    column = lambda i: column_number(part(i)).cast("int")
    c1, r1 = column(1), part(2).try_cast("int")
    c2, r2 = F.when(part(3) == "", c1).otherwise(column(3)), F.coalesce(part(4).try_cast("int"), r1)
    inside = text.rlike(pattern) & (F.greatest(c1, c2) <= 16384) & (F.greatest(r1, r2) <= 1048576) & (F.least(r1, r2) >= 1)
    return F.when(inside, F.struct(F.least(r1, r2).alias("row_start"), F.greatest(r1, r2).alias("row_end"), F.least(c1, c2).alias("col_start"), F.greatest(c1, c2).alias("col_end")))


def backoff_ms(attempts: Column) -> Column:
    """30 s doubled for each attempt, ten times at most and an hour at most."""
    return F.least(F.lit(3_600_000), F.pow(F.lit(2), F.least(attempts, F.lit(10))) * 30_000).cast("long")


def bucket(value: Column, bounds: list[float], over: str = "over") -> Column:
    """Name of the first bound at or above value."""
    out = F.when(value <= bounds[0], F.lit(f"<={bounds[0]:g}"))
    for b in bounds[1:]:
        out = out.when(value <= b, F.lit(f"<={b:g}"))
    return out.otherwise(F.lit(over))
