"""Historical stress windows and scenario shocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratafin.functions.scalar import half_even, literal_rows, settled_mean
from stratafin.params import SCENARIOS, STRESS_WINDOWS, Scenario, StressWindow


def _windows(windows: Sequence[StressWindow]):
    def opt(v):
        return F.lit(v).cast("double")

    return F.array(
        *[
            F.struct(
                F.lit(w.name).alias("name"),
                F.lit(w.start).cast("date").alias("start"),
                F.lit(w.end).cast("date").alias("end"),
                opt(w.max_acceptable_dd).alias("max_dd"),
                opt(None if not (w.expected_return and w.min_capture) else w.expected_return * w.min_capture).alias("min_return"),
            )
            for w in windows
        ]
    )


def _window_facts(returns: DataFrame, keys: Sequence[str], windows: Sequence[StressWindow], prefix: str) -> DataFrame:
    """Return, worst drawdown and volatility per key and window.  Rows are tagged
    with the windows that contain their date; there is no range join."""
    hits = F.filter(_windows(windows), lambda w: F.col("date").between(w["start"], w["end"]))
    rows = returns.where(F.col("ret").isNotNull()).withColumn("w", F.explode(hits)).withColumn("window", F.col("w.name"))
    run = Window.partitionBy(*keys, "window").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_g", F.product(1 + F.col("ret")).over(run))
    rows = rows.withColumn("_dd", F.col("_g") / F.max("_g").over(run) - 1)
    return rows.groupBy(*keys, "window").agg(
        F.count("ret").alias(f"{prefix}_rows"),
        ((F.max_by("_g", "date") - 1) * 100).alias(f"{prefix}_return"),
        (F.min("_dd") * 100).alias(f"{prefix}_max_dd"),
        (F.stddev_samp("ret") * F.lit(float(252**0.5)) * 100).alias(f"{prefix}_volatility"),
        F.first("w.max_dd").alias("_limit"),
        F.first("w.min_return").alias("_needed"),
    )


def stress_windows(
    returns: DataFrame,
    benchmark: DataFrame | None = None,
    keys: Sequence[str] = ("portfolio_id",),
    windows: Sequence[StressWindow] = tuple(STRESS_WINDOWS),
    min_rows: int = 3,
) -> DataFrame:
    """Portfolio (and benchmark) behaviour in each window with the pass rules."""
    facts = _window_facts(returns, keys, windows, "portfolio").where(F.col("portfolio_rows") >= min_rows)
    if benchmark is not None:
        bench = _window_facts(benchmark.select("date", "ret"), [], windows, "benchmark")
        facts = facts.join(bench.select("window", "benchmark_return", "benchmark_max_dd"), "window", "left")
    else:
        facts = facts.withColumns({c: F.lit(None).cast("double") for c in ("benchmark_return", "benchmark_max_dd")})
    breached = F.coalesce(F.col("portfolio_max_dd") < F.col("_limit"), F.lit(False))
    missed = F.coalesce(F.col("portfolio_return") < F.col("_needed"), F.lit(False))
    rounded = ["portfolio_return", "portfolio_max_dd", "portfolio_volatility", "benchmark_return", "benchmark_max_dd", "excess_return"]
    out = facts.withColumns(
        {"excess_return": F.col("portfolio_return") - F.col("benchmark_return"), "passed": ~breached & ~missed}
    )
    return out.withColumns({c: half_even(c, 2) for c in rounded}).drop("_limit", "_needed")


def stress_summary(results: DataFrame, keys: Sequence[str] = ("portfolio_id",), hard_limit_pct: float = -35.0) -> DataFrame:
    """Suite summary: at least 70 % of the windows pass and no drawdown breaks the hard limit."""
    e = F.col("excess_return")
    return (
        results.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n_windows"),
            F.count_if(F.col("passed")).alias("passed_count"),
            F.count_if(~F.col("passed")).alias("failed_count"),
            half_even(settled_mean("portfolio_max_dd", 2), 2).alias("avg_dd"),
            F.min("portfolio_max_dd").alias("worst_dd"),
            half_even(settled_mean("portfolio_return", 2), 2).alias("avg_return"),
            half_even(settled_mean(e, 2), 2).alias("avg_excess_return"),
            half_even(F.avg((e > 0).cast("double")) * 100, 1).alias("pct_outperform"),
        )
        .withColumn(
            "overall_passed",
            (F.col("passed_count") / F.col("n_windows") >= 0.7) & (F.col("worst_dd") >= hard_limit_pct),
        )
    )


def scenario_shocks(portfolios: DataFrame, scenarios: Sequence[Scenario] = tuple(SCENARIOS)) -> DataFrame:
    """Estimated drawdown of each portfolio in each scenario.

    ``portfolios``: keys with ``beta, value_exposure, quality_exposure,
    momentum_exposure, concentration_hhi``.  The fixed scenarios are exploded
    from a literal, so there is no cross join.
    """
    table = literal_rows(
        [
            {
                "scenario": s.name,
                "market_drawdown": s.market_drawdown,
                "recovery_base": s.recovery_days,
                "value": s.value_impact,
                "quality": s.quality_impact,
                "momentum": s.momentum_impact,
                "concentration": s.concentration_impact,
            }
            for s in scenarios
        ]
    )
    rows = portfolios.withColumn("s", F.explode(table))
    market = F.col("s.market_drawdown")
    size = F.abs(market)
    raw = (
        market * F.col("beta")
        + F.col("value_exposure") * F.col("s.value") * size
        + F.col("quality_exposure") * F.col("s.quality") * size
        + F.col("momentum_exposure") * F.col("s.momentum") * size
        + F.col("concentration_hhi") * 10 * F.col("s.concentration") * size
    )
    rows = rows.withColumn("_dd", F.greatest(F.least(raw, F.lit(0.0)), market * 1.5))
    dd = F.col("_dd")
    factor = F.abs(dd / F.nullif(market, F.lit(0.0)))
    return rows.withColumns(
        {
            "scenario": F.col("s.scenario"),
            "market_drawdown": half_even(market, 1),
            "portfolio_drawdown": half_even(dd, 1),
            "relative_performance": half_even(dd - market, 1),
            "recovery_days": F.floor(F.col("s.recovery_base") * F.coalesce(factor, F.lit(1.0))).cast("int"),
            "risk_class": F.when(dd > -20, "low").when(dd > -35, "medium").when(dd > -50, "high").otherwise("extreme"),
        }
    ).drop("s", "_dd")


def scenario_summary(shocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    r = F.col("relative_performance")
    return shocks.groupBy(*keys).agg(
        F.min("portfolio_drawdown").alias("worst_portfolio_dd"),
        half_even(settled_mean("portfolio_drawdown", 1), 1).alias("avg_portfolio_dd"),
        F.min(r).alias("worst_relative_perf"),
        half_even(settled_mean(r, 1), 1).alias("avg_relative_perf"),
        F.count_if(r > 0).alias("scenarios_outperform"),
        F.count_if(r < 0).alias("scenarios_underperform"),
    )
