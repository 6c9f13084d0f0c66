"""Ordered-series operators on long panels ``(symbol, date, close)``.

The panel holds one row per symbol and day, so a window partition is bounded by
the trading calendar whatever share of the raw rows a symbol holds.  All features share
one ``(symbol, date)`` ordering: one shuffle, one sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratafin.functions.scalar import half_even

ANNUAL = 252


def _by(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("date")


def pad_to_calendar(prices: DataFrame, calendar: DataFrame) -> DataFrame:
    """Carry every price forward over the calendar days until the symbol's next price.

    Each price row covers the days up to the next one, so the result is the
    dense panel and nothing larger; days outside the calendar fall out in a
    semi-join on the date.
    """
    upcoming = F.lead("date").over(_by(["symbol"]))
    spans = prices.withColumn("_last", F.coalesce(F.date_sub(upcoming, 1), F.col("date")))
    filled = spans.withColumn("date", F.explode(F.sequence("date", "_last"))).drop("_last")
    return filled.join(calendar.select("date").distinct(), "date", "left_semi")


def simple_returns(prices: DataFrame, keys: Sequence[str] = ("symbol",), gap: str = "null", calendar: DataFrame | None = None) -> DataFrame:
    """``ret`` = close / previous close - 1.

    ``gap='null'`` compares consecutive rows of the symbol; ``gap='pad'`` first
    fills calendar holes with the last price (a zero return, then a catch-up).
    """
    if gap == "pad":
        if calendar is None:
            calendar = prices.select("date").distinct()
        prices = pad_to_calendar(prices, calendar)
    elif gap != "null":
        raise ValueError("gap must be 'null' or 'pad'")
    before = F.lag("close").over(_by(keys))
    return prices.withColumn("ret", F.col("close") / F.nullif(before, F.lit(0.0)) - 1)


def cumulative(df: DataFrame, keys: Sequence[str], ret: str = "ret") -> DataFrame:
    """Growth of one unit, its running peak and the drawdown from it."""
    running = _by(keys).rowsBetween(Window.unboundedPreceding, 0)
    growth = F.product(1 + F.coalesce(F.col(ret), F.lit(0.0))).over(running)
    out = df.withColumn("growth", growth)
    return out.withColumn("peak", F.max("growth").over(running)).withColumn("drawdown", F.col("growth") / F.col("peak") - 1)


def rolling_volatility(df: DataFrame, keys: Sequence[str] = ("symbol",), rows: int = 30, ret: str = "ret") -> DataFrame:
    """Annualised sample deviation of the last ``rows`` returns (percent), NULL until complete."""
    frame = _by(keys).rowsBetween(1 - rows, 0)
    value = F.stddev_samp(ret).over(frame) * F.lit(float(ANNUAL**0.5) * 100)
    return df.withColumn("rolling_vol", F.when(F.count(ret).over(frame) == rows, value))


def _rsi(keys: Sequence[str]) -> Column:
    w = _by(keys)
    frame = w.rowsBetween(-13, 0)
    gain = F.avg(F.greatest(F.coalesce(F.col("_step"), F.lit(0.0)), F.lit(0.0))).over(frame)
    loss = F.avg(F.greatest(-F.coalesce(F.col("_step"), F.lit(0.0)), F.lit(0.0))).over(frame)
    strength = F.when(loss == 0, F.lit(100.0)).otherwise(gain / F.nullif(loss, F.lit(0.0)))
    return F.when(F.col("n_prices") >= 15, half_even(100 - 100 / (1 + strength), 1)).otherwise(F.lit(50.0))


def price_features(prices: DataFrame, keys: Sequence[str] = ("symbol",), mode: str = "history") -> DataFrame:
    """52-week range, 3-month and year-to-date performance, 30-day volatility and RSI per row.

    ``mode`` selects the look-back conventions, which differ by one row and by
    the divisor of the deviation:

    ========== ================ ============================ =====================
    mode       3-month base     30-day volatility            year to date
    ========== ================ ============================ =====================
    history    62 rows back     sample, last 30 returns      needs 2 rows in year
    live       63 rows back     population, last 29 returns  NULL when unchanged
    backtest   62 rows back     sample, last 29 returns      needs 2 rows in year
    ========== ================ ============================ =====================
    """
    w = _by(keys)
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    one_year = w.rowsBetween(-(ANNUAL - 1), 0)
    back = 63 if mode == "live" else 62
    n_returns = 30 if mode == "history" else 29
    frame = w.rowsBetween(1 - n_returns, 0)
    deviation = F.stddev_pop("_ret") if mode == "live" else F.stddev_samp("_ret")
    annual = F.lit(float(ANNUAL**0.5) * 100)
    base = prices.withColumns(
        {
            "_ret": F.col("close") / F.nullif(F.lag("close").over(w), F.lit(0.0)) - 1,
            "_step": F.col("close") - F.lag("close").over(w),
            "n_prices": F.count(F.lit(1)).over(past).cast("int"),
            "_base": F.lag("close", back).over(w),
            "high_52w": F.max("close").over(one_year),
            "low_52w": F.min("close").over(one_year),
            "_same_year": F.year("date").eqNullSafe(F.lag(F.year("date")).over(w)),
        }
    )
    # a year begins where it differs from the row before: no second order by year, hence one sort for all features
    base = base.withColumn("_same_year", F.col("_same_year") & (F.col("n_prices") > 1))
    opening = F.last(F.when(~F.col("_same_year"), F.struct("close")), ignorenulls=True).over(past)
    base = base.withColumn("_year_open", opening["close"])
    year_to_date = half_even((F.col("close") / F.nullif("_year_open", F.lit(0.0)) - 1) * 100, 2)
    ytd_known = (F.col("_year_open") != F.col("close")) if mode == "live" else F.col("_same_year")
    return base.withColumns(
        {
            "perf_3m": half_even((F.col("close") / F.nullif("_base", F.lit(0.0)) - 1) * 100, 2),
            "perf_ytd": F.when(ytd_known, year_to_date),
            "vol_30d": F.when(F.col("n_prices") >= 30, half_even(deviation.over(frame) * annual, 2)),
            "rsi": _rsi(keys),
        }
    ).drop("_ret", "_step", "_base", "_year_open", "_same_year")


def enough_history(features: DataFrame, min_rows: int = 30) -> DataFrame:
    return features.where(F.col("n_prices") >= min_rows)


def latest_features(prices: DataFrame, as_of=None, keys: Sequence[str] = ("symbol",), mode: str = "history", min_rows: int = 30) -> DataFrame:
    """The last feature row per symbol on or before ``as_of`` (all data when None), with the row-count gate."""
    rows = prices if as_of is None else prices.where(F.col("date") <= F.lit(as_of).cast("date"))
    features = enough_history(price_features(rows, keys, mode), min_rows)
    payload = [c for c in features.columns if c not in keys]
    return features.groupBy(*keys).agg(F.max_by(F.struct(*payload), "date").alias("_last")).select(*keys, "_last.*")


def five_year_drawdown(prices: DataFrame, as_of: DataFrame, keys: Sequence[str] = ("symbol",), years: int = 5) -> DataFrame:
    """Worst drawdown over the ``years`` up to each as-of date, and the months its recovery took.

    ``as_of`` holds ``as_of_date`` (dates).  Only prices of the trailing window count: the peak is
    the highest close since the window began, and recovery runs from the peak before the worst
    close to the first day that regains it, or to the last price in the window.  A price takes part
    in as many windows as as-of dates follow within ``years``; they meet by year.
    """
    dates = as_of.select(F.col("as_of_date").cast("date").alias("as_of_date")).distinct()
    begins = F.add_months("as_of_date", -12 * years)
    spans = dates.withColumn("_begin", begins).withColumn("_year", F.explode(F.sequence(F.year("_begin"), F.year("as_of_date"))))
    rows = prices.select(*keys, F.col("date").cast("date").alias("date"), "close").withColumn("_year", F.year("date"))
    rows = rows.join(spans, "_year").where((F.col("date") > F.col("_begin")) & (F.col("date") <= F.col("as_of_date")))
    group = [*keys, "as_of_date"]
    ordered = Window.partitionBy(*group).orderBy("date")
    so_far = ordered.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_peak", F.max("close").over(so_far))
    rows = rows.withColumn("drawdown", F.col("close") / F.nullif("_peak", F.lit(0.0)) - 1)
    at_peak = F.when(F.col("close") == F.col("_peak"), F.col("date"))
    rows = rows.withColumns(
        {
            "_from": F.last(at_peak, ignorenulls=True).over(so_far),
            "_to": F.first(at_peak, ignorenulls=True).over(ordered.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    worst = F.min_by(F.struct("_from", "_to"), F.struct("drawdown", "date"))
    out = rows.where(F.col("drawdown").isNotNull()).groupBy(*group).agg(F.min("drawdown").alias("max_drawdown_5y"), worst.alias("_worst"), F.max("date").alias("_last"))
    months = F.datediff(F.coalesce("_worst._to", "_last"), F.col("_worst._from")) / 30.4375
    return out.select(*group, "max_drawdown_5y", F.when(F.col("max_drawdown_5y") < 0, months).otherwise(0.0).alias("dd_recovery_months"))


def price_factor_inputs(prices: DataFrame, keys: Sequence[str] = ("symbol",), lookback: int = 252, skip: int = 20, min_rows: int = 60) -> DataFrame:
    """Per row: one-year return, Sharpe-like ratio, 12-1 momentum and volatility over the look-back window."""
    w = _by(keys)
    frame = w.rowsBetween(-lookback, 0)
    base = prices.withColumn("_ret", F.col("close") / F.nullif(F.lag("close").over(w), F.lit(0.0)) - 1)
    base = base.withColumns(
        {
            "window_rows": F.count(F.lit(1)).over(frame),
            "_first": F.first("close").over(frame),
            "_mean": F.avg("_ret").over(frame),
            "_std": F.stddev_samp("_ret").over(frame),
            "_skipped": F.lag("close", skip).over(w),
        }
    )
    return _price_factors(base.where(F.col("window_rows") >= min_rows)).drop("_ret")


def price_factor_inputs_at(
    prices: DataFrame, instants: DataFrame, keys: Sequence[str] = ("symbol",), lookback: int = 252, skip: int = 20, min_rows: int = 60
) -> DataFrame:
    """``price_factor_inputs`` of the last row of each key on or before every listed ``date``, as ``rebalance_date``.

    Only these rows get a look-back window: each price meets the chosen rows that follow within
    ``lookback`` and is folded into them, in the order by date and without another shuffle.  A key has one
    such row per listed date at most, and both are bounded by the calendar.
    """
    w = _by(keys)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    listed = instants.agg(F.array_sort(F.collect_set(F.col("date").cast("date")))).scalar()
    extra = [c for c in prices.columns if c not in (*keys, "date", "close")]
    rows = prices.withColumns(
        {
            "_n": F.row_number().over(w),
            "_ret": F.col("close") / F.nullif(F.lag("close").over(w), F.lit(0.0)) - 1,
            "_next": F.lead("date").over(w),
            "_opened": F.first("close").over(so_far),
            "_back": F.lag("close", lookback).over(w),
            "_skipped": F.lag("close", skip).over(w),
        }
    )
    in_force = lambda at: (at >= F.col("date")) & (F.col("_next").isNull() | (at < F.col("_next")))
    asked = (F.col("_n") >= min_rows) & F.exists("_listed", in_force)
    rows = rows.withColumn("_listed", listed).withColumn("_asked", asked).drop("_listed")
    # the chosen rows of the key in order, and how many of them lie before this row and up to ``lookback`` behind it
    marked = F.when(F.col("_asked"), F.col("_n"))
    rows = rows.withColumns(
        {
            "_chosen": F.collect_list(marked).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
            "_before": F.count(marked).over(w.rowsBetween(Window.unboundedPreceding, -1)),
            "_until": F.count(marked).over(w.rowsBetween(Window.unboundedPreceding, lookback)),
        }
    ).where(F.col("_until") > F.col("_before"))
    followed = F.slice("_chosen", F.col("_before").cast("int") + 1, (F.col("_until") - F.col("_before")).cast("int"))
    rows = rows.withColumn("_at", F.explode(followed))
    here = F.col("_n") == F.col("_at")
    first_close = F.when(F.col("_n") > lookback, F.col("_back")).otherwise(F.col("_opened"))
    own = {c: F.col(c) for c in ("date", "close", "_next", "_skipped", *extra)} | {"_first": first_close}
    folded = rows.groupBy(*keys, "_at").agg(
        F.avg("_ret").alias("_mean"),
        F.stddev_samp("_ret").alias("_std"),
        *[F.first(F.when(here, c), ignorenulls=True).alias(n) for n, c in own.items()],
    )
    dated = folded.withColumn("_listed", listed).withColumn("rebalance_date", F.explode(F.filter("_listed", in_force))).drop("_listed").withColumn("window_rows", F.least(F.col("_at"), F.lit(lookback + 1)).cast("bigint"))
    return _price_factors(dated.withColumnRenamed("date", "price_date")).drop("_at", "_next")


def _price_factors(rows: DataFrame) -> DataFrame:
    """Return, Sharpe-like ratio, momentum and volatility from the first close, mean and deviation of a window."""
    return rows.withColumns(
        {
            "return_1y": F.col("close") / F.nullif("_first", F.lit(0.0)) - 1,
            "sharpe_1y": F.coalesce(F.col("_mean") / F.nullif("_std", F.lit(0.0)), F.lit(0.0)),
            "momentum_12_1": F.when(F.col("window_rows") > 63, F.col("_skipped") / F.nullif("_first", F.lit(0.0)) - 1),
            "vol_1y": F.col("_std") * F.lit(float(ANNUAL**0.5)),
        }
    ).drop("_first", "_mean", "_std", "_skipped")
