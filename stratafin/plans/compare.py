"""Benchmark comparison, verdicts, acceptance and factor attribution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratafin.functions.scalar import half_even
from stratafin.params import Acceptance


def portfolio_estimate(positions: DataFrame, by: Sequence[str], correlation: float = 0.5, risk_free_pct: float = 4.5) -> DataFrame:
    """Return, volatility with one constant correlation, heuristic drawdown and Sharpe.

    The variance has a closed form, rho (sum w s)^2 + (1 - rho) sum (w s)^2, so
    no pair of positions is ever formed.
    """
    w = F.col("weight")
    perf = F.coalesce("perf_3m", F.lit(0.0))
    vol = F.coalesce(F.nullif("vol_30d", F.lit(0.0)), F.lit(25.0)) / 100
    raw = positions.groupBy(*by).agg(
        F.sum(w * perf).alias("_ret"),
        F.sum(w * vol).alias("_ws"),
        F.sum(w * w * vol * vol).alias("_ws2"),
        F.min(perf).alias("_worst"),
        F.count(F.lit(1)).alias("positions"),
    )
    variance = correlation * F.col("_ws") * F.col("_ws") + (1 - correlation) * F.col("_ws2")
    raw = raw.withColumn("_vol", F.sqrt(F.greatest(variance, F.lit(0.0))) * 100)
    sharpe = F.when(F.col("_vol") > 0, (F.col("_ret") * 4 - risk_free_pct) / F.nullif("_vol", F.lit(0.0))).otherwise(0.0)
    return raw.select(
        *by,
        F.col("_ret").alias("portfolio_return_raw"),
        F.col("_vol").alias("portfolio_vol_raw"),
        sharpe.alias("portfolio_sharpe_raw"),
        half_even("_ret", 2).alias("return_pct"),
        half_even("_vol", 2).alias("volatility_pct"),
        half_even(sharpe, 2).alias("sharpe"),
        half_even(F.least(F.col("_worst") * 0.5, -F.col("_vol") * 0.3), 2).alias("max_drawdown_pct"),
        "positions",
    )


def against_benchmarks(estimate: DataFrame, benchmarks: DataFrame, by: Sequence[str]) -> DataFrame:
    """Alpha, Sharpe and volatility differences to each benchmark.

    ``benchmarks``: a handful of rows ``benchmark, return_pct, volatility_pct,
    sharpe``, folded to one array and attached as a scalar.
    """
    listed = benchmarks.agg(
        F.collect_list(F.struct("benchmark", F.col("return_pct").alias("r"), F.col("volatility_pct").alias("v"), F.col("sharpe").alias("s"))).alias("_b")
    ).scalar()
    rows = estimate.withColumn("b", F.explode(listed))
    alpha = F.col("portfolio_return_raw") - F.col("b.r")
    return rows.select(
        *by,
        F.col("b.benchmark").alias("benchmark"),
        half_even(alpha, 2).alias("alpha_pct"),
        (alpha > 0).alias("outperformance"),
        half_even(F.col("portfolio_sharpe_raw") - F.col("b.s"), 2).alias("sharpe_diff"),
        half_even(F.col("portfolio_vol_raw") - F.col("b.v"), 2).alias("vol_diff"),
        (F.col("return_pct") > F.col("b.r")).alias("beats"),
    )


def outperformance_verdict(comparison: DataFrame, by: Sequence[str], strict: bool = False) -> DataFrame:
    """Valid when the portfolio beats any benchmark, or all of them in strict mode."""
    facts = comparison.groupBy(*by).agg(
        F.max("beats").alias("beats_any"), F.min("beats").alias("beats_all"), F.count_if("beats").alias("n_beaten"), F.count(F.lit(1)).alias("n_benchmarks")
    )
    verdict = F.when(F.col("beats_all"), "beats_all").when(F.col("beats_any"), "beats_some").otherwise("underperforms")
    return facts.withColumns({"valid": F.col("beats_all") if strict else F.col("beats_any"), "verdict": verdict})


def acceptance(metrics: DataFrame, stress: DataFrame | None = None, keys: Sequence[str] = ("portfolio_id",), p: Acceptance = Acceptance()) -> DataFrame:
    """Sharpe floor, drawdown target and hard limit, stress suite; notes list every check."""
    rows = metrics
    if stress is not None:
        rows = rows.join(stress.select(*keys, "overall_passed"), list(keys), "left")
    else:
        rows = rows.withColumn("overall_passed", F.lit(None).cast("boolean"))
    sharpe, dd = F.col("sharpe_ratio"), F.col("max_drawdown")
    stress_ok = F.coalesce("overall_passed", F.lit(True))
    notes = F.array_compact(
        F.array(
            F.when(sharpe < p.min_sharpe, "sharpe below floor").otherwise("sharpe ok"),
            F.when(dd < p.hard_drawdown_pct, "drawdown beyond hard limit").when(dd < p.target_drawdown_pct, "drawdown beyond target").otherwise("drawdown ok"),
            F.when(F.col("overall_passed"), "stress ok").when(~F.col("overall_passed"), "stress failed"),
        )
    )
    return rows.withColumns({"accepted": (sharpe >= p.min_sharpe) & (dd >= p.hard_drawdown_pct) & stress_ok, "notes": notes})


def strategy_verdict(summary: DataFrame) -> DataFrame:
    """Four criteria and the verdict from their number."""
    criteria = {
        "alpha_positive": F.col("total_alpha") > 0,
        "hit_rate_ok": F.col("hit_rate") > 50,
        "drawdown_ok": F.col("max_drawdown") > -40,
        "ir_ok": F.col("information_ratio") > 0.3,
    }
    out = summary.withColumns(criteria)
    passed = sum(F.col(c).cast("int") for c in criteria)
    return out.withColumn("criteria_passed", passed).withColumn(
        "verdict", F.when(F.col("criteria_passed") == 4, "validated").when(F.col("criteria_passed") >= 3, "acceptable").otherwise("rework")
    )


def attribution(summary: DataFrame, base: str = "core", config: str = "config_id", by: Sequence[str] = ()) -> DataFrame:
    """Differences of every configuration to the base one, with a verdict.

    One row per configuration comes in, so the base row is picked by a window
    over that short list.
    """
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    is_base = F.col(config) == base

    def base_value(c: str):
        return F.max(F.when(is_base, F.col(c))).over(w)

    names = {"alpha": "total_alpha", "sharpe": "sharpe", "ir": "information_ratio"}
    diffs = {f"{k}_contribution": half_even(F.col(c) - base_value(c), 2) for k, c in names.items()}
    out = summary.withColumns(diffs)
    return out.withColumn(
        "verdict",
        F.when(is_base, "base")
        .when((F.col("alpha_contribution") > 0) & (F.col("ir_contribution") > 0), "adds_value")
        .when(F.col("alpha_contribution") > 0, "mixed")
        .otherwise("no_value"),
    )


def fallback_estimate(positions: DataFrame, metrics: DataFrame, by: Sequence[str], n: int = 5, risk_free_pct: float = 4.5) -> DataFrame:
    """Estimate without a price history: Sharpe from year-to-date return, drawdown from
    volatility, best and worst names by year-to-date performance."""
    high = Window.partitionBy(*by).orderBy(F.coalesce("perf_ytd", F.lit(-999.0)).desc(), "symbol")
    low = Window.partitionBy(*by).orderBy(F.coalesce("perf_ytd", F.lit(999.0)).asc(), "symbol")
    ranked = positions.withColumns({"_h": F.row_number().over(high), "_l": F.row_number().over(low)})

    def listed(place: str):
        rows = F.array_sort(F.collect_list(F.when(F.col(place) <= n, F.struct(F.col(place).alias("place"), "symbol", "perf_ytd"))))
        return rows

    names = ranked.groupBy(*by).agg(listed("_h").alias("top_performers"), listed("_l").alias("worst_performers"))
    vol = F.coalesce(F.nullif("vol_30d", F.lit(0.0)), F.lit(20.0))
    ytd = F.coalesce("perf_ytd", F.lit(0.0))
    facts = metrics.select(
        *by,
        F.coalesce("perf_3m", F.lit(0.0)).alias("return_pct"),
        ytd.alias("return_ytd_pct"),
        vol.alias("volatility_pct"),
        half_even((ytd - risk_free_pct) / vol, 2).alias("sharpe_estimate"),
        half_even(-vol * 1.5, 1).alias("max_drawdown_estimate"),
        "positions",
    )
    return facts.join(names, list(by))
