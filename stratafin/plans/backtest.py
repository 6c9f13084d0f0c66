"""Point-in-time universes, portfolio returns and walk-forward runs.

The loops over dates and configurations are tables here: rebalance dates,
configurations and periods are keys, and one plan computes all of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratafin.functions.scalar import half_even, literal_rows
from stratafin.operators.filters import leverage_filter, liquidity_filter
from stratafin.operators.joins import days_in_periods, period_endpoints, valid_at
from stratafin.operators.ranking import Rank, pct_ranks, top_k
from stratafin.operators.scores_v23 import score_pipeline
from stratafin.operators.series import price_factor_inputs_at, price_features, simple_returns
from stratafin.operators.weights import equal_weights, normalise, sector_cap_once, snapshot_changes, turnover
from stratafin.params import (
    PRICE_FACTOR_CONFIGS,
    Constraints,
    Leverage,
    Liquidity,
    PriceFactorConfig,
    Publication,
    Rebalancing,
)
from stratafin.plans.calendar import available_from, rebalance_dates
from stratafin.session import stage

# --- universe at each rebalance date ----------------------------------------------------------


def fundamentals_at(
    fundamentals: DataFrame, instants: DataFrame, p: Publication = Publication(), symbol: str = "symbol", year: str = "year"
) -> DataFrame:
    """Latest published fundamentals per symbol and date, last non-missing value per column."""
    run = Window.partitionBy(symbol).orderBy(year).rowsBetween(Window.unboundedPreceding, 0)
    values = [c for c in fundamentals.columns if c not in (symbol, year)]
    filled = fundamentals.select(symbol, year, *[F.last(c, ignorenulls=True).over(run).alias(c) for c in values])
    known = filled.withColumn("_known", available_from(year, p))
    return valid_at(known, [symbol], "_known", instants.select(F.col("date").alias("rebalance_date")), "rebalance_date").drop("_known")


def prices_at(features: DataFrame, instants: DataFrame) -> DataFrame:
    """Last feature row per symbol on or before each date."""
    rows = features.withColumnRenamed("date", "price_date")
    return valid_at(rows, ["symbol"], "price_date", instants.select(F.col("date").alias("rebalance_date")), "rebalance_date")


def point_in_time_universe(
    prices: DataFrame,
    fundamentals: DataFrame,
    instants: DataFrame,
    publication: Publication = Publication(),
    liquidity: Liquidity | None = None,
    leverage: Leverage | None = None,
    signals: DataFrame | None = None,
) -> DataFrame:
    """One row per rebalance date and eligible symbol: published fundamentals, as-of price,
    30-day volatility, screened; neutral signal scores where none are given."""
    features = price_features(prices, mode="backtest").select("symbol", "date", F.col("close").alias("price"), "vol_30d")
    joined = fundamentals_at(fundamentals, instants, publication).join(prices_at(features, instants), ["symbol", "rebalance_date"])
    if "shares_outstanding" in fundamentals.columns:
        joined = joined.withColumn("market_cap", F.col("shares_outstanding") * F.col("price"))
    if signals is not None:
        joined = joined.join(signals, ["symbol"], "left")
    neutral = {c: F.lit(0.5) for c in ("score_sm", "score_insider", "score_momentum") if c not in joined.columns}
    joined = joined.withColumns(neutral) if neutral else joined
    if liquidity is not None:
        joined = liquidity_filter(joined, liquidity)
    if leverage is not None:
        joined = leverage_filter(joined, leverage)
    return joined


def select_positions(
    scored: DataFrame, by: Sequence[str], c: Constraints = Constraints(), score: str = "score_composite", min_score: float | None = None
) -> DataFrame:
    """Top names per date with equal capped weights; a date with too few names is skipped."""
    rows = scored if min_score is None else scored.where(F.col(score) >= min_score)
    top = top_k(rows, by, [F.col(score).desc(), F.col("symbol")], c.max_positions)
    enough = F.count(F.lit(1)).over(Window.partitionBy(*by)) >= c.min_positions
    return equal_weights(top.withColumn("_ok", enough).where(F.col("_ok")).drop("_ok"), by, c.max_weight)


# --- returns ------------------------------------------------------------------------------------


def holding_days(weights: DataFrame, days: DataFrame, keys: Sequence[str], lag_days: int = 0) -> DataFrame:
    """``(*keys, rebalance_date, date)``: which weights are in force on which traded day.

    A set of weights lasts until the day before the next successful rebalance;
    the interval is matched to days by month.
    """
    sets = weights.select(*keys, "rebalance_date").distinct()
    order = Window.partitionBy(*keys).orderBy("rebalance_date") if keys else Window.partitionBy(F.lit(0)).orderBy("rebalance_date")
    end = days.agg(F.max("date").alias("_e")).scalar()
    spans = sets.withColumns(
        {
            "start": F.date_add("rebalance_date", lag_days),
            "end": F.coalesce(F.date_sub(F.date_add(F.lead("rebalance_date").over(order), lag_days), 1), end),
        }
    ).where(F.col("start") <= F.col("end"))
    return days_in_periods(days, spans, [*keys, "rebalance_date"])


def portfolio_returns(
    weights: DataFrame,
    returns: DataFrame,
    keys: Sequence[str] = ("portfolio_id",),
    cost_bps: float = 12.0,
    effective_lag_days: int = 0,
    days: DataFrame | None = None,
) -> DataFrame:
    """Daily return of each portfolio: weighted returns minus costs on rebalance days.

    ``weights``: ``*keys, rebalance_date, symbol, weight``; ``returns``:
    ``symbol, date, ret``.  New weights earn the return of the rebalance day
    itself unless ``effective_lag_days`` is set; the first set costs nothing.  ``days`` holds the
    traded days where ``returns`` covers the held names only.
    """
    weights = stage(weights.select(*keys, "rebalance_date", "symbol", "weight"))
    held = holding_days(weights, returns if days is None else days, keys, effective_lag_days)
    exposed = held.join(weights, [*keys, "rebalance_date"])
    gross = (
        exposed.join(returns.select("symbol", "date", "ret").where(F.col("ret").isNotNull()), ["symbol", "date"], "left")
        .groupBy(*keys, "date")
        .agg(F.coalesce(F.sum(F.col("weight") * F.col("ret")), F.lit(0.0)).alias("gross_ret"))
    )
    traded = turnover(snapshot_changes(weights, keys, "rebalance_date", stored=True), keys, "rebalance_date").select(
        *keys, F.date_add("rebalance_date", effective_lag_days).alias("date"), (F.col("turnover") * cost_bps / 10000).alias("cost")
    )
    return gross.join(traded, [*keys, "date"], "left").withColumns(
        {"cost": F.coalesce("cost", F.lit(0.0)), "ret": F.col("gross_ret") - F.coalesce("cost", F.lit(0.0))}
    )


def weighted_returns(weights: DataFrame, returns: DataFrame, keys: Sequence[str] = ("portfolio_id",), benchmark: DataFrame | None = None) -> DataFrame:
    """Daily return of fixed weights (normalised), missing returns count as zero; benchmark beside it."""
    # one row per position: the window over a portfolio is as small as the portfolio
    daily = (
        normalise(weights, keys)
        .join(returns.select("symbol", "date", "ret"), "symbol")
        .groupBy(*keys, "date")
        .agg(F.sum(F.col("weight") * F.coalesce("ret", F.lit(0.0))).alias("ret"))
    )
    if benchmark is None:
        return daily
    return daily.join(benchmark.select("date", F.col("ret").alias("benchmark_ret")), "date", "left")


# --- walk-forward runs ------------------------------------------------------------------------------


@dataclass(frozen=True)
class WalkForward:
    frequency: str = "Q"
    calendar: str = "calendar"
    cost_bps: float = Rebalancing().cost_bps
    publication: Publication = field(default_factory=Publication)
    liquidity: Liquidity | None = None
    leverage: Leverage | None = None
    constraints: Constraints = field(default_factory=Constraints)
    value_mode: str = "cross_sectional"
    effective_lag_days: int = 0
    #: names below this composite are never held (None: no floor)
    min_score: float | None = None


def fundamental_weights(prices: DataFrame, fundamentals: DataFrame, p: WalkForward = WalkForward()) -> DataFrame:
    """Weights at every successful rebalance date from the fundamental scores."""
    instants = stage(rebalance_dates(prices, p.frequency, p.calendar))  # a short list: prices meet it without a shuffle
    universe = stage(point_in_time_universe(prices, fundamentals, instants, p.publication, p.liquidity, p.leverage))
    scored = score_pipeline(universe, by=["rebalance_date"], value_mode=p.value_mode, with_ranks=False, stored=True)
    return select_positions(scored, ["rebalance_date"], p.constraints, min_score=p.min_score)


def walk_forward(prices: DataFrame, fundamentals: DataFrame, p: WalkForward = WalkForward(), portfolio_id: str = "strategy") -> DataFrame:
    """Daily net returns of the fundamental strategy."""
    weights = stage(fundamental_weights(prices, fundamentals, p).select(F.lit(portfolio_id).alias("portfolio_id"), "rebalance_date", "symbol", "weight"))
    held = prices.join(weights.select("symbol").distinct(), "symbol", "left_semi")
    return portfolio_returns(weights, simple_returns(held), ["portfolio_id"], p.cost_bps, p.effective_lag_days, prices)


def price_factors_at(prices: DataFrame, instants: DataFrame, min_rows: int = 60, holder: DataFrame | None = None) -> DataFrame:
    """Price-only factor scores per date; missing ranks are neutral."""
    rows = price_factor_inputs_at(prices, instants, min_rows=min_rows).drop("close")
    ranked = pct_ranks(
        rows,
        ["rebalance_date"],
        ["symbol"],
        [Rank("_r", "return_1y"), Rank("_q", "sharpe_1y"), Rank("_m", "momentum_12_1"), Rank("_v", "vol_1y")],
    )
    half = F.lit(0.5)
    scored = ranked.withColumns(
        {
            "value": F.coalesce(1 - F.col("_r"), half),
            "quality": F.coalesce(F.col("_q"), half),
            "momentum": F.coalesce(F.col("_m"), half),
            "low_vol": F.coalesce(1 - F.col("_v"), half),
        }
    ).drop("_r", "_q", "_m", "_v")
    if holder is None:
        return scored.withColumn("holder", half)
    return scored.join(holder, ["symbol"], "left").withColumn("holder", F.coalesce("holder", half))


def config_composites(scored: DataFrame, configs: Sequence[PriceFactorConfig] = tuple(PRICE_FACTOR_CONFIGS)) -> DataFrame:
    """One composite per configuration.  The few configurations are exploded from a
    literal next to each scored row; the scores themselves are computed once."""
    table = literal_rows([asdict(c) for c in configs])
    rows = scored.withColumn("c", F.explode(table))
    total: Column | None = None
    for factor in ("value", "quality", "momentum", "low_vol", "holder"):
        term = F.col(factor) * F.col(f"c.{factor}")
        total = term if total is None else total + term
    return rows.withColumns({"config_id": F.col("c.config_id"), "score_composite": total}).drop("c")


def period_results(weights: DataFrame, prices: DataFrame, periods: DataFrame, benchmark: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Portfolio, benchmark and alpha per period (fractions).

    ``weights``: ``*keys, rebalance_date, symbol, weight`` with the period
    starting at the rebalance date; ``periods``: ``start, end``.
    """
    named = periods.withColumn("rebalance_date", F.col("start"))
    weights = stage(weights)  # the held names decide which prices are needed
    held = prices.join(weights.select("symbol").distinct(), "symbol", "left_semi")
    moves = period_endpoints(held, named, ["rebalance_date"]).select("rebalance_date", "symbol", "period_return")
    market = period_endpoints(benchmark.withColumn("symbol", F.lit("*")), named, ["rebalance_date"]).select(
        "rebalance_date", F.when(F.col("n_prices") >= 2, F.col("period_return")).otherwise(F.lit(0.0)).alias("_b")
    )
    port = (
        weights.join(named.select("rebalance_date"), "rebalance_date", "left_semi")
        .join(moves, ["rebalance_date", "symbol"], "left")
        .groupBy(*keys, "rebalance_date")
        .agg(
            F.sum(F.col("weight") * F.coalesce("period_return", F.lit(0.0))).alias("portfolio_return"),
            F.count(F.lit(1)).alias("n_positions"),
        )
    )
    joined = port.join(market, "rebalance_date", "left").withColumn("benchmark_return", F.coalesce("_b", F.lit(0.0))).drop("_b")
    return joined.withColumn("alpha", F.col("portfolio_return") - F.col("benchmark_return")).withColumnRenamed("rebalance_date", "period_start")


def price_factor_weights(
    prices: DataFrame,
    sectors: DataFrame,
    instants: DataFrame,
    configs: Sequence[PriceFactorConfig] = tuple(PRICE_FACTOR_CONFIGS),
    c: Constraints = Constraints(),
) -> DataFrame:
    """Equal capped weights of the top names per date and configuration, sector-capped once."""
    scored = config_composites(price_factors_at(prices, instants), configs)
    by = ["config_id", "rebalance_date"]
    top = top_k(scored, by, [F.col("score_composite").desc(), F.col("symbol")], c.max_positions)
    with_sector = top.join(sectors, "symbol", "left").withColumn("sector", F.coalesce("sector", F.lit("Other")))
    return sector_cap_once(equal_weights(with_sector, by, c.max_weight), by, c.max_sector)


def forward_test(nav: DataFrame, benchmark: DataFrame, periods: DataFrame, keys: Sequence[str] = ("portfolio_id",)) -> DataFrame:
    """Forward-test record per period: entry and exit value, returns, alpha, hit."""
    named = periods.withColumn("period_start", F.col("start"))
    days = days_in_periods(nav, named, ["period_start"])
    own = (
        nav.join(days, "date")
        .groupBy(*keys, "period_start")
        .agg(F.min_by("nav", "date").alias("entry_nav"), F.max_by("nav", "date").alias("exit_nav"))
        .withColumn("portfolio_return", F.col("exit_nav") / F.nullif("entry_nav", F.lit(0.0)) - 1)
    )
    market = (
        benchmark.join(days_in_periods(benchmark, named, ["period_start"]), "date")
        .groupBy("period_start")
        .agg((F.max_by("close", "date") / F.nullif(F.min_by("close", "date"), F.lit(0.0)) - 1).alias("benchmark_return"))
    )
    return own.join(market, "period_start", "left").withColumn("alpha", F.col("portfolio_return") - F.col("benchmark_return")).withColumn(
        "hit", (F.col("alpha") > 0).cast("int")
    )


def snapshot_results(contributions: DataFrame, benchmark: DataFrame, keys: Sequence[str] = ("snapshot_date",), horizon_days: int = 90) -> DataFrame:
    """Result per stored snapshot from its trailing performance column: return, benchmark
    over the following ``horizon_days``, alpha, concentration (percent)."""
    snaps = contributions.groupBy(*keys).agg(
        F.sum("contribution").alias("_p"), F.count(F.lit(1)).alias("n_positions"), (F.max("weight") * 100).alias("_mp")
    )
    sectors = contributions.groupBy(*keys, F.coalesce("sector", F.lit("Unknown")).alias("sector")).agg(F.sum("weight").alias("_s"))
    largest = sectors.groupBy(*keys).agg((F.max("_s") * 100).alias("_ms"))
    date = keys[-1]
    periods = snaps.select(date).distinct().withColumns({"start": F.col(date), "end": F.date_add(date, horizon_days)})
    market = period_endpoints(benchmark.withColumn("symbol", F.lit("*")), periods, [date]).select(
        date, F.when(F.col("n_prices") >= 2, F.col("period_return") * 100).otherwise(0.0).alias("_b")
    )
    rows = snaps.join(largest, list(keys)).join(market, date, "left").withColumn("_b", F.coalesce("_b", F.lit(0.0)))
    return rows.select(
        *keys,
        half_even("_p", 2).alias("portfolio_return"),
        half_even("_b", 2).alias("benchmark_return"),
        half_even(F.col("_p") - F.col("_b"), 2).alias("alpha"),
        "n_positions",
        half_even("_mp", 2).alias("max_position_weight"),
        half_even("_ms", 2).alias("max_sector_weight"),
    )


__all__ = [
    "WalkForward",
    "config_composites",
    "forward_test",
    "fundamental_weights",
    "fundamentals_at",
    "holding_days",
    "period_results",
    "point_in_time_universe",
    "portfolio_returns",
    "price_factor_weights",
    "price_factors_at",
    "prices_at",
    "select_positions",
    "snapshot_results",
    "walk_forward",
    "weighted_returns",
]
