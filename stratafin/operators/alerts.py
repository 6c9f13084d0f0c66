"""Alert rules over portfolio positions, as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratafin.functions.scalar import with_missing

_INPUTS = ["rsi", "vol_30d", "perf_ytd", "debt_equity", "roe", "fcf"]


def _rule(name: str, kind: str, severity: str, value: Column, fires: Column) -> Column:
    return F.when(
        fires,
        F.struct(
            F.lit(kind).alias("type"), F.lit(name).alias("rule"), F.lit(severity).alias("severity"), value.cast("double").alias("value")
        ),
    )


def position_alerts(positions: DataFrame, by: Sequence[str]) -> DataFrame:
    """Seven rules per position; an exact zero never raises an alert."""
    df = with_missing(positions, {c: "double" for c in _INPUTS})
    c = {n: F.col(n) for n in _INPUTS}
    rules = F.array_compact(
        F.array(
            _rule("rsi_oversold", "opportunity", "medium", c["rsi"], (c["rsi"] < 30) & (c["rsi"] != 0)),
            _rule("rsi_overbought", "warning", "medium", c["rsi"], c["rsi"] > 70),
            _rule("high_volatility", "risk", "high", c["vol_30d"], c["vol_30d"] > 50),
            _rule("deep_loss", "warning", "high", c["perf_ytd"], c["perf_ytd"] < -30),
            _rule("high_debt", "risk", "medium", c["debt_equity"], c["debt_equity"] > 2),
            _rule("negative_roe", "warning", "high", c["roe"], c["roe"] < 0),
            _rule("negative_fcf", "warning", "medium", c["fcf"], c["fcf"] < 0),
        )
    )
    return df.select(*by, F.col("symbol").alias("ticker"), F.explode(rules).alias("a")).select(*by, "ticker", "a.*")


def portfolio_alerts(metrics: DataFrame, by: Sequence[str], limit: float = 25.0) -> DataFrame:
    fires = F.col("vol_30d") > limit
    one = _rule("portfolio_volatility", "risk", "medium", F.col("vol_30d"), fires)
    return metrics.where(fires).select(*by, F.lit("PORTFOLIO").alias("ticker"), one.alias("a")).select(*by, "ticker", "a.*")


def severity_counts(alerts: DataFrame, by: Sequence[str]) -> DataFrame:
    s = F.col("severity")
    return alerts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("count"),
        F.count_if(s == "high").alias("high"),
        F.count_if(s == "medium").alias("medium"),
        F.count_if(s == "low").alias("low"),
    )


def concentration_alerts(positions: DataFrame, by: Sequence[str], score: str = "score_composite", max_weight: float = 0.055, max_per_sector: int = 3) -> DataFrame:
    """Stated rules: position above 5.5 %, score below 0.4, RSI extremes, more than three names of a sector."""
    df = with_missing(positions, {"rsi": "double"})
    w, s, r = F.col("weight"), F.col(score), F.col("rsi")
    crowd = F.count(F.lit(1)).over(Window.partitionBy(*by, "sector"))
    rules = F.array_compact(
        F.array(
            _rule("concentration", "risk", "medium", w, w > max_weight),
            _rule("low_score", "warning", "medium", s, s < 0.4),
            _rule("extreme_momentum", "warning", "medium", r, (r > 70) | (r < 30)),
            _rule("sector_crowding", "risk", "medium", F.col("_crowd"), F.col("_crowd") > max_per_sector),
        )
    )
    return (
        df.withColumn("_crowd", crowd)
        .select(*by, F.col("symbol").alias("ticker"), F.explode(rules).alias("a"))
        .select(*by, "ticker", "a.*")
    )


def risk_flags(positions: DataFrame, by: Sequence[str]) -> DataFrame:
    """Portfolio flags: top-3 weight, top sector, volatile, loss-making and indebted names."""
    df = with_missing(positions, {c: "double" for c in ("vol_30d", "roe", "debt_equity")})
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("weight").desc(), "symbol"))
    held = F.sum("weight").over(Window.partitionBy(*by, "sector"))
    zero = F.lit(0.0)
    return (
        df.withColumns({"_place": place, "_sector": held})
        .groupBy(*by)
        .agg(
            (F.sum(F.when(F.col("_place") <= 3, F.col("weight"))) * 100).alias("top3_pct"),
            (F.max("_sector") * 100).alias("top_sector_pct"),
            F.count_if(F.coalesce("vol_30d", zero) > 40).alias("n_volatile"),
            F.count_if(F.coalesce("roe", zero) < 0).alias("n_negative_roe"),
            F.count_if(F.coalesce("debt_equity", zero) > 2).alias("n_high_debt"),
        )
        .withColumns({"concentrated": F.col("top3_pct") > 40, "sector_overexposed": F.col("top_sector_pct") > 35})
    )
