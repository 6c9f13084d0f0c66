"""Performance metrics over long return series ``(*keys, date, ret)``.

A series holds one row per key and day, so its window is bounded by the
calendar.  Everything after the window pass is one partial aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratafin.functions.scalar import half_even, settled_mean
from stratafin.operators.series import cumulative

_PER_YEAR = 252


def drawdown_spans(returns: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drawdown path with the length in days of each episode at its last row.

    An episode starts on the first day below the peak and ends on the first day
    back at it, or on the last day of the series.
    """
    path = cumulative(returns, keys)
    w = Window.partitionBy(*keys).orderBy("date")
    under = F.col("drawdown") < 0
    path = path.withColumns({"_was_under": F.coalesce(F.lag(under).over(w), F.lit(False)), "_is_last": F.lead("date").over(w).isNull()})
    start = F.last(F.when(under & ~F.col("_was_under"), F.col("date")), ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, 0)
    )
    path = path.withColumn("_start", start)
    ended = (~under & F.col("_was_under")) | (under & F.col("_is_last"))
    return path.withColumn("dd_days", F.when(ended, F.datediff("date", "_start"))).drop("_was_under", "_is_last", "_start")


def performance_metrics(
    returns: DataFrame, keys: Sequence[str], risk_free: float = 0.045, per_year: int = _PER_YEAR, min_rows: int = 10
) -> DataFrame:
    """Return, risk, drawdown and trading statistics per series (series shorter than ``min_rows`` are left out)."""
    path = drawdown_spans(returns.where(F.col("ret").isNotNull()), keys)
    r, root = F.col("ret"), F.lit(float(per_year**0.5))
    raw = path.groupBy(*keys).agg(
        F.count(r).alias("num_periods"),
        F.min("date").alias("start_date"),
        F.max("date").alias("end_date"),
        F.max_by("growth", "date").alias("_growth"),
        F.avg(r).alias("_mean"),
        F.stddev_samp(r).alias("_std"),
        F.stddev_samp(F.when(r < 0, r)).alias("_down"),
        F.count_if(r < 0).alias("_n_loss"),
        F.count_if(r > 0).alias("_n_win"),
        F.avg(F.when(r > 0, r)).alias("_win"),
        F.avg(F.when(r < 0, r)).alias("_loss"),
        F.min("drawdown").alias("_max_dd"),
        F.avg(F.when(F.col("drawdown") < 0, F.col("drawdown"))).alias("_avg_dd"),
        F.coalesce(F.max("dd_days"), F.lit(0)).alias("max_drawdown_duration_days"),
    ).where(F.col("num_periods") >= min_rows)
    excess = F.col("_mean") - risk_free / per_year
    cagr = F.pow(F.col("_growth"), F.lit(float(per_year)) / F.col("num_periods")) - 1
    zero = F.lit(0.0)
    downside = F.when(F.col("_n_loss") > 0, F.col("_down")).otherwise(F.lit(0.001))
    out = raw.withColumns(
        {
            "total_return": half_even((F.col("_growth") - 1) * 100, 2),
            "cagr": half_even(cagr * 100, 2),
            "annual_volatility": half_even(F.col("_std") * root * 100, 2),
            "sharpe_ratio": half_even(F.when(F.col("_std") > 0, excess / F.nullif("_std", zero) * root).otherwise(zero), 3),
            "sortino_ratio": half_even(F.when(downside > 0, excess / F.nullif(downside, zero) * root).otherwise(zero), 3),
            "calmar_ratio": half_even(F.coalesce(cagr / F.nullif(F.abs("_max_dd"), zero), zero), 3),
            "max_drawdown": half_even(F.col("_max_dd") * 100, 2),
            "avg_drawdown": half_even(F.coalesce("_avg_dd", zero) * 100, 2),
            "hit_ratio": half_even(F.col("_n_win") / F.col("num_periods") * 100, 1),
            "avg_win": half_even(F.coalesce("_win", zero) * 100, 3),
            "avg_loss": half_even(F.coalesce("_loss", zero) * 100, 3),
            "win_loss_ratio": half_even(F.abs(F.coalesce("_win", zero) / F.nullif("_loss", zero)), 2),
        }
    )
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def align_benchmark(returns: DataFrame, benchmark: DataFrame, how: str = "inner") -> DataFrame:
    """Benchmark return beside each day; ``inner`` keeps common non-missing days."""
    bench = benchmark.select("date", F.col("ret").alias("benchmark_ret"))
    joined = returns.join(bench, "date", how)
    return joined.where(F.col("ret").isNotNull() & F.col("benchmark_ret").isNotNull()) if how == "inner" else joined


def benchmark_stats(
    aligned: DataFrame, keys: Sequence[str], risk_free: float = 0.045, per_year: int = _PER_YEAR, min_rows: int = 11
) -> DataFrame:
    """Beta, annual alpha, tracking error and information ratio per series."""
    r, b = F.col("ret"), F.col("benchmark_ret")
    raw = aligned.groupBy(*keys).agg(
        F.count(r).alias("n_aligned"),
        (F.covar_samp("ret", "benchmark_ret") / F.nullif(F.var_samp("benchmark_ret"), F.lit(0.0))).alias("_beta"),
        F.avg(r).alias("_r"),
        F.avg(b).alias("_b"),
        F.avg(r - b).alias("_active"),
        F.stddev_samp(r - b).alias("_te"),
    ).where(F.col("n_aligned") >= min_rows)
    daily = risk_free / per_year
    beta = F.coalesce("_beta", F.lit(1.0))
    root = F.lit(float(per_year**0.5))
    return raw.select(
        *keys,
        "n_aligned",
        half_even(beta, 2).alias("beta"),
        half_even((F.col("_r") - daily - beta * (F.col("_b") - daily)) * per_year * 100, 2).alias("alpha"),
        half_even(F.col("_te") * root * 100, 2).alias("tracking_error"),
        half_even(F.when(F.col("_te") > 0, F.col("_active") / F.nullif("_te", F.lit(0.0)) * root).otherwise(0.0), 3).alias("information_ratio"),
    )


def subperiod_metrics(returns: DataFrame, keys: Sequence[str], periods: Sequence[tuple[str, str, str]], min_rows: int = 10) -> DataFrame:
    """Metrics inside named periods.  Each row is tagged with the periods that
    contain its date (a filter over a literal array), so no join is needed."""
    spans = F.array(
        *[
            F.struct(F.lit(n).alias("period"), F.lit(s).cast("date").alias("start"), F.lit(e).cast("date").alias("end"))
            for n, s, e in periods
        ]
    )
    tagged = returns.withColumn(
        "_p", F.explode(F.filter(spans, lambda p: F.col("date").between(p["start"], p["end"])))
    ).withColumn("period", F.col("_p.period")).drop("_p")
    return performance_metrics(tagged, [*keys, "period"], min_rows=min_rows).select(
        *keys, "period", "start_date", "end_date", "cagr", "annual_volatility", "sharpe_ratio", "max_drawdown", "calmar_ratio"
    )


def weighted_period_stats(daily: DataFrame, keys: Sequence[str], risk_free_pct: float = 4.5) -> DataFrame:
    """Statistics of a weighted portfolio's daily series ``ret`` (and ``benchmark_ret`` where present)."""
    path = cumulative(daily, keys)
    active = F.col("ret") - F.col("benchmark_ret")
    raw = path.groupBy(*keys).agg(
        F.count("ret").alias("n_days"),
        F.max_by("growth", "date").alias("_growth"),
        F.avg("ret").alias("_mean"),
        F.stddev_samp("ret").alias("_std"),
        F.min("drawdown").alias("_dd"),
        F.product(1 + F.coalesce("benchmark_ret", F.lit(0.0))).alias("_bench"),
        F.avg(active).alias("_active"),
        F.stddev_samp(active).alias("_te"),
    )
    root, zero = F.lit(float(_PER_YEAR**0.5)), F.lit(0.0)
    te = F.col("_te") * root * 100
    return raw.select(
        *keys,
        "n_days",
        half_even((F.col("_growth") - 1) * 100, 2).alias("total_return"),
        half_even((F.pow("_growth", _PER_YEAR / F.col("n_days")) - 1) * 100, 2).alias("cagr"),
        half_even(F.col("_std") * root * 100, 2).alias("volatility"),
        half_even(F.col("_dd") * 100, 2).alias("max_drawdown"),
        half_even(
            F.when(F.col("_std") > 0, (F.col("_mean") - risk_free_pct / 252 / 100) / F.nullif("_std", zero) * root).otherwise(zero), 2
        ).alias("sharpe"),
        half_even((F.col("_growth") - F.col("_bench")) * 100, 2).alias("alpha"),
        half_even(F.coalesce(te, zero), 2).alias("tracking_error"),
        half_even(F.when(te > 0, F.col("_active") * 252 * 100 / F.nullif(te, zero)).otherwise(zero), 2).alias("information_ratio"),
    )


def benchmark_metrics(prices: DataFrame, keys: Sequence[str], risk_free_pct: float = 4.5) -> DataFrame:
    """Total return, volatility, Sharpe with linear annualisation and max drawdown of a price series."""
    w = Window.partitionBy(*keys).orderBy("date")
    rows = prices.withColumn("ret", F.col("close") / F.nullif(F.lag("close").over(w), F.lit(0.0)) - 1)
    # the path starts at the first return, not at 1
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_g", F.when(F.col("ret").isNotNull(), F.product(1 + F.coalesce("ret", F.lit(0.0))).over(running)))
    rows = rows.withColumn("_dd", F.col("_g") / F.max("_g").over(running) - 1)
    raw = rows.groupBy(*keys).agg(
        F.count("close").alias("days"),
        ((F.max_by("close", "date") / F.nullif(F.min_by("close", "date"), F.lit(0.0)) - 1) * 100).alias("_total"),
        (F.stddev_samp("ret") * F.lit(float(_PER_YEAR**0.5)) * 100).alias("_vol"),
        (F.min("_dd") * 100).alias("_max_dd"),
    )
    annual = F.col("_total") * _PER_YEAR / F.col("days")
    sharpe = F.when(F.col("_vol") > 0, (annual - risk_free_pct) / F.nullif("_vol", F.lit(0.0))).otherwise(0.0)
    return raw.select(
        *keys,
        half_even("_total", 2).alias("return_pct"),
        half_even("_vol", 2).alias("volatility_pct"),
        half_even(sharpe, 2).alias("sharpe"),
        half_even("_max_dd", 2).alias("max_drawdown_pct"),
        "days",
    )


# --- summaries of period results ------------------------------------------------------------


def _path(periods: DataFrame, keys: Sequence[str], ret: Column, start_at_one: bool) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("period_start").rowsBetween(Window.unboundedPreceding, 0)
    grown = periods.withColumn("_growth", F.product(1 + ret).over(w))
    peak = F.max("_growth").over(w)
    if start_at_one:
        peak = F.greatest(peak, F.lit(1.0))
    return grown.withColumn("_dd", F.col("_growth") / peak - 1)


def walk_forward_summary(periods: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Summary of quarterly results in percent (``portfolio_return, benchmark_return, alpha``)."""
    p, b, a = F.col("portfolio_return"), F.col("benchmark_return"), F.col("alpha")
    raw = _path(periods, keys, p / 100, False).groupBy(*keys).agg(
        F.count(p).alias("total_periods"),
        F.product(1 + p / 100).alias("_p"),
        F.product(1 + b / 100).alias("_b"),
        F.sum(a).alias("_alpha"),
        F.avg(a).alias("_mean"),
        settled_mean(a, 2).alias("_settled"),
        F.stddev_pop(a).alias("_std"),
        F.avg((a > 0).cast("double")).alias("_hit"),
        F.stddev_pop(p).alias("_pv"),
        F.stddev_pop(b).alias("_bv"),
        F.min("_dd").alias("_dd"),
        F.min(p).alias("worst_period_return"),
        F.max(p).alias("best_period_return"),
    )
    years = F.col("total_periods") / 4
    te = F.col("_std") * 2
    return raw.select(
        *keys,
        "total_periods",
        half_even((F.pow("_p", 1 / years) - 1) * 100, 2).alias("portfolio_cagr"),
        half_even((F.pow("_b", 1 / years) - 1) * 100, 2).alias("benchmark_cagr"),
        half_even("_alpha", 2).alias("total_alpha"),
        half_even("_settled", 2).alias("avg_alpha_per_period"),
        half_even(F.col("_hit") * 100, 1).alias("hit_rate"),
        half_even(F.when(te > 0, F.col("_mean") * 4 / F.nullif(te, F.lit(0.0))).otherwise(0.0), 2).alias("information_ratio"),
        half_even(F.col("_pv") * 2, 2).alias("portfolio_volatility"),
        half_even(F.col("_bv") * 2, 2).alias("benchmark_volatility"),
        half_even(te, 2).alias("tracking_error"),
        half_even(F.col("_dd") * 100, 2).alias("max_drawdown"),
        "worst_period_return",
        "best_period_return",
    )


def annual_returns(periods: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Compounded returns per calendar year of the period start."""
    return (
        periods.groupBy(*keys, F.year("period_start").alias("year"))
        .agg(
            ((F.product(1 + F.col("portfolio_return") / 100) - 1) * 100).alias("_p"),
            ((F.product(1 + F.col("benchmark_return") / 100) - 1) * 100).alias("_b"),
            F.count(F.lit(1)).alias("periods"),
        )
        .select(
            *keys,
            "year",
            half_even("_p", 2).alias("portfolio"),
            half_even("_b", 2).alias("benchmark"),
            half_even(F.col("_p") - F.col("_b"), 2).alias("alpha"),
            "periods",
        )
    )


def best_and_worst(periods: DataFrame, keys: Sequence[str], n: int = 5) -> DataFrame:
    """The ``n`` best and ``n`` worst periods per series (bounded by the number of periods)."""
    best = Window.partitionBy(*keys).orderBy(F.col("portfolio_return").desc(), "period_start")
    worst = Window.partitionBy(*keys).orderBy(F.col("portfolio_return").asc(), "period_start")
    ranked = periods.withColumns({"_b": F.row_number().over(best), "_w": F.row_number().over(worst)})
    sides = F.array_compact(
        F.array(
            F.when(F.col("_b") <= n, F.struct(F.lit("best").alias("side"), F.col("_b").alias("place"))),
            F.when(F.col("_w") <= n, F.struct(F.lit("worst").alias("side"), F.col("_w").alias("place"))),
        )
    )
    return (
        ranked.select(*keys, "period_start", "portfolio_return", "benchmark_return", "alpha", F.explode(sides).alias("s"))
        .select(*keys, "s.side", "s.place", "period_start", "portfolio_return", "benchmark_return", "alpha")
    )


def config_summary(periods: DataFrame, keys: Sequence[str], risk_free: float = 0.045, faithful_ir: bool = True) -> DataFrame:
    """Out-of-sample summary per configuration from period returns in fractions.

    ``faithful_ir`` keeps the original information ratio, which scales an alpha
    already summed over all years by four; otherwise mean alpha x 4 is used.
    """
    # period figures enter in percent rounded to two digits, the wealth path unrounded
    rp, rb, ra = (half_even(F.col(c) * 100, 2) / 100 for c in ("portfolio_return", "benchmark_return", "alpha"))
    rows = _path(periods.withColumns({"_rp": rp, "_rb": rb, "_ra": ra}), keys, F.col("portfolio_return"), True)
    raw = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_periods"),
        F.product(1 + F.col("portfolio_return")).alias("_p"),
        F.product(1 + F.col("_rb")).alias("_b"),
        F.sum("_ra").alias("_alpha"),
        F.avg("_ra").alias("_mean"),
        F.stddev_pop("_ra").alias("_std"),
        F.stddev_pop("_rp").alias("_vol"),
        F.avg((F.col("_ra") > 0).cast("double")).alias("_hit"),
        F.min("_dd").alias("_dd"),
    )
    years = F.col("n_periods") / 4
    cagr = F.pow("_p", 1 / years) - 1
    bench = F.pow("_b", 1 / years) - 1
    vol, te = F.col("_vol") * 2, F.col("_std") * 2
    annual_alpha = F.col("_alpha") * 4 / years if faithful_ir else F.col("_mean") * 4
    return raw.select(
        *keys,
        "n_periods",
        half_even((F.col("_p") - 1) * 100, 2).alias("total_return"),
        half_even((F.col("_b") - 1) * 100, 2).alias("benchmark_return"),
        half_even(cagr * 100, 2).alias("cagr"),
        half_even(bench * 100, 2).alias("benchmark_cagr"),
        half_even(F.col("_alpha") * 100, 2).alias("total_alpha"),
        half_even(F.col("_alpha") * 100 / years, 2).alias("alpha_per_year"),
        half_even(F.col("_hit") * 100, 1).alias("hit_rate"),
        half_even(F.when(vol > 0, (cagr - risk_free) / F.nullif(vol, F.lit(0.0))).otherwise(0.0), 2).alias("sharpe"),
        half_even(F.col("_dd") * 100, 2).alias("max_drawdown"),
        half_even(F.when(te > 0, annual_alpha / F.nullif(te, F.lit(0.0))).otherwise(0.0), 2).alias("information_ratio"),
    )
