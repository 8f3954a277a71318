"""Prices, valuations and positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimark.functions.folds import folded


def _position(trades):
    """The state after one key's trades: (quantity, cost, invested, realized, dividends, error)."""
    qty = cost = invested = realized = dividends = 0.0
    error = None
    for kind, quantity, price, fee, amount, ratio in (t[-6:] for t in trades):
        if kind == "buy":
            paid = quantity * price + fee
            qty, cost, invested = qty + quantity, cost + paid, invested + paid
        elif kind == "sell":
            if quantity > qty + 1e-8:
                error = "oversell"
                break
            removed = cost * (quantity / qty) if qty else 0.0
            realized += quantity * price - fee - removed
            left = qty - quantity
            qty, cost = (0.0, 0.0) if abs(left) < 1e-8 else (left, cost - removed)
        elif qty <= 0:
            error = "no holding"
            break
        elif kind == "dividend":
            dividends += amount
        else:
            qty *= ratio
    yield qty, cost, invested, realized, dividends, error


def position_ledger(trades: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The position of each key after its trades in order.

    trades has kind (buy, sell, dividend, split), quantity, price, fee, amount and
    ratio. Average cost includes buying fees; a sale takes cost out in proportion;
    a rest below 1e-8 is nothing. A sale of more than is held, or a dividend or
    split without a holding, sets error and leaves the rest of the trades out.
    A security's trades stream through in order, as sorted by Spark.
    """
    numbers = ["quantity", "price", "fee", "amount", "ratio"]
    rows = trades.select(*keys, *order, "kind", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in numbers])
    return folded(rows, keys, [*order, "kind", *numbers], _position, "qty double, cost double, invested double, realized double, dividends double, error string")


def with_returns(positions: DataFrame, price: Column) -> DataFrame:
    """positions with market_value, unrealized, total_return and the two return percentages."""
    value = F.when(F.col("qty") == 0, F.lit(0.0)).otherwise(F.col("qty") * price)
    out = positions.withColumn("market_value", value).withColumn("unrealized", F.col("market_value") - F.col("cost"))
    out = out.withColumn("total_return", F.col("unrealized") + F.col("realized") + F.col("dividends"))
    return out.withColumns({"return_percent": F.try_divide("total_return", "invested") * 100, "unrealized_return_percent": F.try_divide("unrealized", "cost") * 100})


#: Blocks of days have 1, 4, 16, ... days: two bits a level, as many levels as span 45 years.
_BITS, _LEVELS = 2, 8


def _at_level(blocks: Column, level: int) -> Column:
    return F.transform(blocks, lambda n: F.struct(F.lit(level).alias("level"), n.alias("block")))


def _day_blocks(first: Column, last: Column) -> Column:
    """The fewest blocks (level, block) that together are the days first to last, ends included; none for an empty span."""
    start, stop = F.unix_date(first), F.unix_date(last) + 1
    above = lambda k: -F.shiftright(-start, _BITS * k)  # noqa: E731  the first block from start on
    below = lambda k: F.shiftright(stop, _BITS * k)  # noqa: E731  the first block that doesn't end by stop
    run = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<int>"))
    parts = []
    for k in range(_LEVELS):
        blocks = run(above(k), below(k))
        if k + 1 < _LEVELS:
            a, b = above(k + 1), below(k + 1)
            blocks = F.when(a < b, F.concat(run(above(k), a * (1 << _BITS)), run(b * (1 << _BITS), below(k)))).otherwise(blocks)
        parts.append(_at_level(blocks, k))
    return F.concat(*parts)


def _by_blocks(bars: DataFrame, valuations: DataFrame) -> DataFrame:
    """Bars with the best valuation of their day, in work that grows with bars and valuations and not with their pairs.

    A valuation's days are cut into blocks of 1, 4, 16, ... days; the best of each
    block is one row, found by an aggregate, and a bar looks at the one block of each
    level that its day is in. A hot key is spread over its blocks.
    """
    spans = valuations.select("_key", "_v", F.inline(_day_blocks(F.to_date("_v.effective_date"), F.to_date("_until"))))
    blocks = spans.groupBy("_key", "level", "block").agg(F.max("_v").alias("_v"))
    day = F.unix_date(F.to_date("_bar.bar_date"))
    looks = F.array(*[F.struct(F.lit(k).alias("_level"), F.shiftright(day, _BITS * k).alias("_block")) for k in range(_LEVELS)])
    hits = bars.select("_of", "_bar", F.inline(looks)).join(blocks, (F.col("_of") == F.col("_key")) & (F.col("_level") == F.col("level")) & (F.col("_block") == F.col("block")), "left")
    return hits.groupBy("_bar").agg(F.max("_v").alias("v"))


def _by_pairs(bars: DataFrame, valuations: DataFrame) -> DataFrame:
    day = F.to_date("_bar.bar_date")
    hits = bars.join(valuations, (F.col("_of") == F.col("_key")) & (F.to_date("_v.effective_date") <= day) & (F.to_date("_until") >= day), "left")
    return hits.groupBy("_bar").agg(F.max("_v").alias("v"))


def as_of_valuation(bars: DataFrame, valuations: DataFrame, key: str, most_pairs: int = 4096) -> DataFrame:
    """Each bar (key, bar_date, close) with the valuation that holds on its day.

    valuations has key, effective_date, effective_at, seq, target_date, bear, base
    and bull. The last by (effective_date, effective_at, seq) of those with
    effective_date <= bar_date counts; only if its target_date has come, an
    earlier one whose target_date hasn't is taken.

    Keys with at most most_pairs pairs of a bar and a valuation are joined as they
    are; the others, which that would square, go by blocks of days. Both give the
    same rows. Bars that are equal are looked up once and come back as often as they are there.
    """
    v = valuations.select(F.col(key).alias("_key"), F.struct("effective_date", "effective_at", "seq", "bear", "base", "bull").alias("_v"), F.col("target_date").alias("_until"))
    b = bars.groupBy(key, "bar_date", "close").agg(F.count("*").alias("times")).select(F.col(key).alias("_of"), F.struct(key, "bar_date", "close", "times").alias("_bar"))
    counts = b.groupBy("_of").agg(F.count("*").alias("_n")).join(v.groupBy("_key").agg(F.count("*").alias("_m")), F.col("_of") == F.col("_key"))
    heavy = counts.filter(F.col("_n") * F.col("_m") > most_pairs).select(F.col("_of").alias("_heavy"))
    among = lambda df, c, how: df.join(heavy, F.col(c) == F.col("_heavy"), how)
    best = _by_pairs(among(b, "_of", "left_anti"), v).unionByName(_by_blocks(among(b, "_of", "left_semi"), among(v, "_key", "left_semi")))
    close, bear, base, bull = F.col("_bar.close"), F.col("v.bear"), F.col("v.base"), F.col("v.bull")
    return best.withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("_bar.times")))).select(
        F.col(f"_bar.{key}").alias(key), F.col("_bar.bar_date").alias("bar_date"), close.alias("close"), F.col("v.seq").alias("valuation_seq"),
        (F.try_divide(base, close) * 100 - 100).alias("upside"), (F.try_divide(bear, close) * 100 - 100).alias("downside"),
        F.when((bear < close) & (close < bull), (bull - close) / (close - bear)).alias("reward_risk"),
    )


def alert(return_percent: Column, profit: float, loss: float) -> Column:
    """profit, loss or none by thresholds in percent; loss is given as a positive number."""
    return F.when(return_percent >= profit, "profit").when(return_percent <= -loss, "loss").otherwise("none")


def latest_market(bars: DataFrame, quotes: DataFrame, key: str) -> DataFrame:
    """date, close and as_of of each key: the quote (trade_date, price, as_of) unless a bar (bar_date, close) is later."""
    bar = bars.groupBy(key).agg(F.max("bar_date").alias("_date"), F.max_by("close", "bar_date").alias("_close"))
    quote = quotes.groupBy(key).agg(F.max_by(F.struct("trade_date", "price", "as_of"), F.struct("trade_date", "as_of")).alias("_q"))
    met = bar.join(quote, key, "full_outer")
    live = F.col("_q").isNotNull() & (F.col("_date").isNull() | (F.col("_q.trade_date") >= F.col("_date")))
    pick = lambda a, b: F.when(live, F.col(a)).otherwise(b)
    return met.select(key, pick("_q.trade_date", F.col("_date")).alias("date"), pick("_q.price", F.col("_close")).alias("close"), pick("_q.as_of", F.lit(None)).alias("as_of"))


def unchanged_since(versions: DataFrame, key: str, value: str, revision: str = "revision", at: str = "created_at") -> DataFrame:
    """key, value and since: the newest version's value, and when the last run of versions with that value began.

    The newest and the last different version come from aggregates, so a key's
    versions are never sorted in one task.
    """
    current = versions.groupBy(key).agg(F.max_by(F.struct(value), revision).alias("_now"))
    told = versions.join(current, key)
    other = told.filter(~F.col(value).eqNullSafe(F.col(f"_now.{value}"))).groupBy(key).agg(F.max(revision).alias("_other"))
    run = told.join(other, key, "left").filter(F.col("_other").isNull() | (F.col(revision) > F.col("_other")))
    return run.groupBy(key).agg(F.first(f"_now.{value}").alias(value), F.min(at).alias("since"))


def valuation_status(market_rule: Column, forecast_split: Column, target_date: Column, split_after: Column, error: Column, today: Column) -> Column:
    """split_review, unavailable (no target_date), expired, split_review, stale or valid, whichever holds first."""
    return (
        F.when(market_rule & forecast_split, "split_review")
        .when(target_date.isNull(), "unavailable")
        .when(target_date < today, "expired")
        .when(split_after, "split_review")
        .when(error.isNotNull(), "stale")
        .otherwise("valid")
    )


def holdings_at(bars: DataFrame, trades: DataFrame, key: str) -> DataFrame:
    """bars (key, bar_date) with quantity and invested after all trades (trade_date, quantity, paid) up to that day.

    A trade that is entered late counts from its own date on, so all later bars
    follow. Trades are added up by day before they meet the bars in one ordered
    pass, which holds no more than sums.
    """
    days = trades.groupBy(key, F.col("trade_date").alias("_day")).agg(F.sum("quantity").alias("_q"), F.sum("paid").alias("_p"))
    events = days.withColumn("_kind", F.lit(0)).unionByName(bars.select(key, F.col("bar_date").alias("_day")).withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    upto = Window.partitionBy(key).orderBy("_day", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = events.withColumns({"quantity": F.coalesce(F.sum("_q").over(upto), F.lit(0)), "invested": F.coalesce(F.sum("_p").over(upto), F.lit(0))})
    return run.filter("_kind = 1").select(key, F.col("_day").alias("bar_date"), "quantity", "invested")


def closed_bars(bars: DataFrame, today: str, after_close: bool) -> DataFrame:
    """Bars without today's while its venue is open."""
    return bars.filter(F.col("bar_date") <= F.lit(today).cast("date")) if after_close else bars.filter(F.col("bar_date") < F.lit(today).cast("date"))
