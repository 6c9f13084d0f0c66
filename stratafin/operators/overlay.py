"""Owner overlay, crowding, grid score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafin.functions.scalar import band, clip, half_even, with_missing
from stratafin.operators.joins import with_totals
from stratafin.operators.ranking import Rank, descending_rank, ordinal_descending, pct_ranks, quantiles
from stratafin.params import CROWDING_BANDS, OWNER_WEIGHTS
from stratafin.session import stage


def _present(df: DataFrame, names: Sequence[str], otherwise: float | None) -> Column:
    for n in names:
        if n in df.columns:
            return F.col(n)
    return F.lit(otherwise).cast("double")


def _or_half(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.5))


def moat_score(df: DataFrame) -> Column:
    roic = _present(df, ["roic_avg", "roic"], 0.10)
    roe = _present(df, ["roe_avg", "roe"], 0.12)
    stability = _or_half(_present(df, ["margin_stability", "score_quality"], 0.5))
    return clip(
        0.40 * _or_half(clip(roic, 0, 0.25) / 0.25) + 0.30 * _or_half(clip(roe, 0, 0.30) / 0.30) + 0.30 * stability, 0, 1
    )


def cash_quality_score(df: DataFrame) -> Column:
    conversion = _or_half((clip(_present(df, ["fcf_ni_ratio"], None), 0.3, 1.5) - 0.3) / 1.2)
    accruals = _or_half(1 - clip(_present(df, ["accruals"], None), 0, 0.20) / 0.20)
    return clip(0.60 * conversion + 0.40 * accruals, 0, 1)


def owner_score(df: DataFrame, by: Sequence[str] = ("as_of_date",)) -> DataFrame:
    """Moat, cash quality, solidity and capital allocation (60 %) with valuation (40 %), ranked."""
    w = OWNER_WEIGHTS
    solidity = _or_half(_present(df, ["score_risk"], 0.5))
    allocation = _or_half(_present(df, ["capital_discipline", "score_quality"], 0.5))
    value = _or_half(_present(df, ["score_value"], 0.5))
    parts = df.withColumns(
        {"score_moat": moat_score(df), "score_cash": cash_quality_score(df), "_solidity": solidity, "_allocation": allocation, "score_valuation": value}
    )
    quality = half_even(
        clip(
            w["moat"] * F.col("score_moat")
            + w["cash"] * F.col("score_cash")
            + w["solidity"] * F.col("_solidity")
            + w["capital_allocation"] * F.col("_allocation"),
            0,
            1,
        ),
        3,
    )
    scored = parts.withColumn("score_owner_quality", quality).drop("_solidity", "_allocation")
    total = half_even(w["quality"] * F.col("score_owner_quality") + w["value"] * F.col("score_valuation"), 3)
    return descending_rank(scored.withColumn("score_owner", total), by, "score_owner", "rank_owner")


# --- crowding ----------------------------------------------------------------------------------


def crowding(
    df: DataFrame,
    by: Sequence[str] = ("as_of_date",),
    key: Sequence[str] = ("symbol",),
    weights: tuple[float, float, float] = (0.4, 0.3, 0.3),
    penalty: float = 0.5,
) -> DataFrame:
    """How crowded a name is among funds; the holder score is scaled down by it."""
    if abs(sum(weights) - 1.0) > 0.01:
        raise ValueError("crowding weights must sum to 1")
    have = set(df.columns)
    df = with_missing(df, {c: "double" for c in ("nb_hedge_funds", "avg_hf_weight", "hf_change_3m")})
    df = df.withColumn("_inflow", clip("hf_change_3m", 0))
    ranked = pct_ranks(
        df, by, key, [Rank("_funds", "nb_hedge_funds"), Rank("_weight", "avg_hf_weight"), Rank("_pressure", "_inflow")]
    )
    parts = [
        ("_funds", "nb_hedge_funds", weights[0]),
        ("_weight", "avg_hf_weight", weights[1]),
        ("_pressure", "hf_change_3m", weights[2]),
    ]
    score = sum(F.lit(w) * (F.col(r) if source in have else F.lit(0.5)) for r, source, w in parts)
    scored = ranked.withColumn("crowding_score", score).drop("_funds", "_weight", "_pressure", "_inflow")
    scored = pct_ranks(scored, by, key, [Rank("crowding_percentile", "crowding_score")])
    scored = scored.withColumn(
        "crowding_tier", F.when(F.col("crowding_percentile").isNotNull(), band("crowding_percentile", CROWDING_BANDS, "extreme"))
    )
    if "holder_score" in have:
        scored = scored.withColumn("holder_adjusted", F.col("holder_score") * (1 - penalty * F.col("crowding_score")))
    return scored


def most_crowded(df: DataFrame, by: Sequence[str] = ("as_of_date",), top: float = 0.10) -> DataFrame:
    """Rows at or above the (1 - top) quantile of the crowding score."""
    df = stage(df)
    limit = quantiles(df, by, "crowding_score", {"_limit": 1 - top}).drop("n_values")
    return df.join(limit, list(by)).where(F.col("crowding_score") >= F.col("_limit")).drop("_limit")


def crowding_diagnosis(portfolio: DataFrame, universe: DataFrame, by: Sequence[str] = ("as_of_date",)) -> DataFrame:
    """Portfolio crowding against the universe: means, share in the top decile, extreme names."""
    universe = stage(universe)
    limit = quantiles(universe, by, "crowding_score", {"_limit": 0.90}).drop("n_values")
    average = universe.groupBy(*by).agg(F.avg("crowding_score").alias("_universe"))
    held = universe.join(portfolio.select(*by, "symbol").distinct(), [*by, "symbol"], "left_semi")
    return (
        held.join(limit, list(by), "left")
        .groupBy(*by)
        .agg(
            F.avg("crowding_score").alias("_portfolio"),
            (F.avg((F.col("crowding_score") >= F.col("_limit")).cast("double")) * 100).alias("_top"),
            F.count_if(F.col("crowding_tier") == "extreme").alias("nb_extreme_positions"),
        )
        .join(average, list(by))
        .select(
            *by,
            half_even("_portfolio", 3).alias("portfolio_avg_crowding"),
            half_even("_universe", 3).alias("universe_avg_crowding"),
            half_even(F.col("_portfolio") - F.col("_universe"), 3).alias("crowding_vs_universe"),
            half_even("_top", 1).alias("pct_in_top_10_crowded"),
            "nb_extreme_positions",
            (F.col("_top") > 30).alias("warning"),
        )
    )


# --- ownership / purchases grid --------------------------------------------------------------------


def reconcile_zero_list(positive: DataFrame, zero: DataFrame) -> DataFrame:
    """A ticker with a value is dropped from the list of known zeros."""
    return zero.select("ticker").distinct().join(positive.select("ticker"), "ticker", "left_anti")


def _half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("int")


def _list_score(values: DataFrame, by: Sequence[str], prefix: str) -> DataFrame:
    ranked = ordinal_descending(
        values.withColumn("_v", F.coalesce(F.col("value"), F.lit(0.0))), by, "_v", f"{prefix}_rank", "ticker"
    ).drop("_v")
    sizes = values.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    scored = with_totals(ranked, sizes, by, ["_n"])
    place = 1 - (F.col(f"{prefix}_rank") - 1) / F.greatest(F.col("_n") - 1, F.lit(1))
    return scored.select(
        *by, "ticker", F.col("value").alias(f"{prefix}_value"), f"{prefix}_rank", _half_up(place * 100).alias(f"{prefix}_score")
    )


def grid_score(
    ownership: DataFrame, buys: DataFrame, ownership_zero: DataFrame, buys_zero: DataFrame, by: Sequence[str] = ("as_of_date",)
) -> DataFrame:
    """Linear rank scores of two lists combined; being on one list only, or being a
    known zero on the other, lowers the result; top-50 on both raises it.

    Inputs have one row per ``(*by, ticker)``; the lists carry ``value``.
    """
    on = [*by, "ticker"]
    o, b = _list_score(ownership, by, "ownership"), _list_score(buys, by, "buys")
    flag = F.lit(True)
    joined = (
        o.join(b, on, "full_outer")
        .join(ownership_zero.select(*on).distinct().withColumn("ownership_zero", flag), on, "full_outer")
        .join(buys_zero.select(*on).distinct().withColumn("buys_zero", flag), on, "full_outer")
    )
    no = F.lit(False)
    rows = joined.withColumns(
        {
            "ownership_zero": F.coalesce("ownership_zero", no),
            "buys_zero": F.coalesce("buys_zero", no),
            "ownership_score": F.coalesce("ownership_score", F.lit(0)),
            "buys_score": F.coalesce("buys_score", F.lit(0)),
        }
    )
    owned, bought = F.col("ownership_rank").isNotNull(), F.col("buys_rank").isNotNull()
    bonus = owned & bought & F.coalesce((F.col("ownership_rank") <= 50) & (F.col("buys_rank") <= 50), no)
    mean = (F.col("ownership_score") + F.col("buys_score")) / 2
    score = (
        F.when(bonus, mean * 1.2)
        .when(owned & bought, mean)
        .when(owned & ~F.col("buys_zero"), F.col("ownership_score") * 0.5)
        .when(owned, F.col("ownership_score") * 0.3)
        .when(bought & ~F.col("ownership_zero"), F.col("buys_score") * 0.5)
        .when(bought, F.col("buys_score") * 0.4)
        .otherwise(F.lit(0.0))
    )
    return rows.withColumns({"composite_score": _half_up(score), "in_both": owned & bought, "bonus": bonus})


def grid_summary(grid: DataFrame, by: Sequence[str] = ("as_of_date",)) -> DataFrame:
    """Distinct tickers, names on each list and on both."""
    return grid.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_unique"),
        F.count("ownership_rank").alias("in_ownership"),
        F.count("buys_rank").alias("in_buys"),
        F.count_if(F.col("in_both")).alias("in_both"),
        F.count_if(F.col("bonus")).alias("with_bonus"),
    )
