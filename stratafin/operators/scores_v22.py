"""Second-generation signal scores: holders, insiders, momentum, sector-ranked quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafin.functions.scalar import clip, half_even, ladder_above, with_missing
from stratafin.operators.ranking import Rank, pct_ranks, zscores
from stratafin.params import CAPEX_HEAVY_SECTORS, PERF_ADDON_LADDER, TIER_SCORES, WEIGHTS_V22
from stratafin.session import stage


def _tier_score() -> Column:
    out = F.when(F.lit(False), F.lit(0.0))
    for t, s in TIER_SCORES.items():
        out = out.when(F.col("gp_tier") == t, F.lit(s))
    return out.otherwise(F.lit(TIER_SCORES["D"]))


def holder_score(dedup: bool = True) -> Column:
    """Tier, purchase rank and weight.  ``dedup`` uses the universe rank of purchases
    (column ``gp_buys_rank``), falling back to purchases/10 where it is missing."""
    plain = F.least(F.col("gp_buys") / 10.0, F.lit(1.0))
    weight = F.least(F.col("gp_weight") / 0.2, F.lit(1.0))
    if dedup:
        score = _tier_score() * 0.25 + F.coalesce(F.col("gp_buys_rank"), plain) * 0.50 + weight * 0.25
    else:
        score = _tier_score() * 0.4 + plain * 0.4 + weight * 0.2
    return half_even(score, 3)


def insider_score() -> Column:
    """Share of purchases and net value clipped to +-10 million."""
    buys, sells = F.coalesce("insider_buys", F.lit(0)), F.coalesce("insider_sells", F.lit(0))
    share = F.when(buys + sells == 0, F.lit(0.5)).otherwise(buys / F.nullif(buys + sells, F.lit(0)))
    net = (clip(F.coalesce("insider_net_value", F.lit(0.0)) / 10_000_000.0, -1, 1) + 1) / 2
    return half_even(share * 0.6 + net * 0.4, 3)


def rsi_band(rsi: str | Column = "rsi") -> Column:
    x = F.coalesce(F.col(rsi) if isinstance(rsi, str) else rsi, F.lit(50.0))
    return (
        F.when(x.between(40, 60), 1.0)
        .when(((x >= 30) & (x < 40)) | ((x > 60) & (x <= 70)), 0.7)
        .when(x < 30, 0.8)
        .otherwise(0.3)
    )


def range_position() -> Column:
    """1 in the middle of the 52-week range, 0 at its ends, 0.5 when the range is unknown."""
    place = (F.col("price") - F.col("low_52w")) / F.nullif(F.col("high_52w") - F.col("low_52w"), F.lit(0.0))
    known = (F.col("high_52w") > F.col("low_52w")) & (F.col("high_52w") > 0)
    return F.when(known, F.greatest(F.lit(0.0), 1 - F.abs(place - 0.5) * 2)).otherwise(F.lit(0.5))


def momentum_score(with_range: bool = False) -> Column:
    addon = ladder_above(F.coalesce("perf_3m", F.lit(0.0)), PERF_ADDON_LADDER, 0.0)
    score = rsi_band() * 0.4
    if with_range:
        score = score + range_position() * 0.3
    return half_even(F.least(score + addon, F.lit(1.0)), 3)


def _steps(value: Column, high: float, mid: float, low: float) -> Column:
    return (
        F.when(value >= 0.8, high).when(value >= 0.6, mid).when(value < 0.2, low).otherwise(0.0)
    )


def _capex_points() -> Column:
    x = F.col("capex_ratio")
    heavy = F.when(x.between(5, 15), 0.10).when(x > 15, 0.05).otherwise(0.0)
    light = F.when(x < 5, 0.10).when(x < 10, 0.05).otherwise(0.0)
    return F.when(x.isNull(), 0.0).when(F.col("sector").isin(CAPEX_HEAVY_SECTORS), heavy).otherwise(light)


def _fcf_points() -> Column:
    return F.when(F.col("fcf").isNull(), 0.0).when(F.col("fcf") > 0, 0.05).otherwise(-0.05)


def _market_points() -> Column:
    """Used only when no fundamental is known."""
    price = F.col("price")
    by_price = F.when(price >= 50, 0.10).when(price >= 20, 0.05).when((price < 10) & (price != 0), -0.10).otherwise(0.0)
    flow = F.when((F.col("avg_volume") > 0) & (F.col("volume") != 0), F.col("volume") / F.nullif("avg_volume", F.lit(0.0)))
    by_flow = F.when(flow > 1.5, 0.05).when(flow < 0.5, -0.05).otherwise(0.0)
    return by_price + by_flow


_FUNDAMENTALS = ["roe", "net_margin", "debt_equity", "current_ratio", "capex_ratio", "fcf"]


def _quality_total(points: Column, basis: Sequence[str]) -> Column:
    known = F.lit(False)
    for c in basis:
        known = known | F.col(c).isNotNull()
    total = 0.5 + points + _capex_points() + _fcf_points() + F.when(known, 0.0).otherwise(_market_points())
    return half_even(clip(total, 0, 1), 3)


def quality_sector_ranked(df: DataFrame, by: Sequence[str] = ("as_of_date",), key: Sequence[str] = ("symbol",)) -> DataFrame:
    """Quality points from ranks inside the sector (lower debt ranks higher)."""
    df = with_missing(df, {c: "double" for c in [*_FUNDAMENTALS, "price", "volume", "avg_volume"]})
    ranked = pct_ranks(
        df,
        by,
        key,
        [
            Rank("roe_rank", "roe", "sector"),
            Rank("net_margin_rank", "net_margin", "sector"),
            Rank("_de_rank", "debt_equity", "sector"),
            Rank("current_ratio_rank", "current_ratio", "sector"),
        ],
    ).withColumn("debt_equity_rank", 1 - F.col("_de_rank")).drop("_de_rank")
    points = (
        _steps(F.col("roe_rank"), 0.20, 0.10, -0.15)
        + _steps(F.col("net_margin_rank"), 0.15, 0.10, -0.10)
        + _steps(F.col("debt_equity_rank"), 0.15, 0.10, -0.10)
        + F.when(F.col("current_ratio_rank") >= 0.8, 0.05).when(F.col("current_ratio_rank") < 0.2, -0.05).otherwise(0.0)
    )
    basis = ["roe_rank", "net_margin_rank", "debt_equity_rank", "current_ratio_rank", "capex_ratio", "fcf"]
    return ranked.withColumn("score_quality", _quality_total(points, basis))


def quality_absolute(df: DataFrame) -> DataFrame:
    """Quality points from absolute levels (percent ratios); row-wise."""
    df = with_missing(df, {c: "double" for c in [*_FUNDAMENTALS, "price", "volume", "avg_volume"]})
    roe, de, margin, current = F.col("roe"), F.col("debt_equity"), F.col("net_margin"), F.col("current_ratio")
    points = (
        F.when(roe.isNull(), 0.0).when(roe >= 25, 0.20).when(roe >= 15, 0.15).when(roe >= 10, 0.10).when(roe >= 0, 0.05).otherwise(-0.15)
        + F.when(de.isNull(), 0.0).when(de < 0.3, 0.15).when(de < 0.7, 0.10).when(de < 1.5, 0.05).when(de > 3, -0.15).otherwise(-0.05)
        + F.when(margin >= 20, 0.15).when(margin >= 10, 0.10).when(margin >= 5, 0.05).when(margin < 0, -0.10).otherwise(0.0)
        + F.when(current >= 1.5, 0.05).when(current < 1, -0.05).otherwise(0.0)
    )
    return df.withColumn("score_quality", _quality_total(points, _FUNDAMENTALS))


def holder_rank(df: DataFrame, by: Sequence[str] = ("as_of_date",)) -> DataFrame:
    return pct_ranks(df, by, ("symbol",), [Rank("gp_buys_rank", "gp_buys")])


def signal_scores(df: DataFrame, by: Sequence[str] = ("as_of_date",), with_range: bool = False) -> DataFrame:
    """Holder, insider and momentum scores beside each other."""
    return holder_rank(df, by).withColumns(
        {"score_sm": holder_score(), "score_insider": insider_score(), "score_momentum": momentum_score(with_range)}
    )


def composite_v22(
    df: DataFrame,
    by: Sequence[str] = ("as_of_date",),
    weights: dict[str, float] | None = None,
    use_zscore: bool = True,
) -> DataFrame:
    """Weighted sum of the four scores, as z-scores over the universe or raw."""
    w = weights or WEIGHTS_V22
    columns = {"holder": "score_sm", "insider": "score_insider", "momentum": "score_momentum", "quality": "score_quality"}
    if use_zscore:
        df = zscores(stage(df), by, list(columns.values()))
    total = None
    for factor, c in columns.items():
        term = F.lit(w[factor]) * F.col(f"{c}_z" if use_zscore else c)
        total = term if total is None else total + term
    return df.withColumn("score_composite", half_even(total, 3))
