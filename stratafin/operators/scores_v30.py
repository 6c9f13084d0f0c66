"""Third-generation scores: sector-relative quality, value with margin of safety, permanent-loss risk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafin.functions.scalar import clip, half_even, ratio, with_missing
from stratafin.operators.ranking import Rank, descending_rank, pct_ranks, quantiles, top_k
from stratafin.params import CONSTRAINTS_V30, WEIGHTS_V30
from stratafin.session import stage


def _neutral(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0.5))


def _present(df: DataFrame, *names: str) -> Column:
    for n in names:
        if n in df.columns:
            return F.col(n)
    return F.lit(None).cast("double")


def _debt_equity(df: DataFrame) -> Column:
    return F.col("debt_equity") if "debt_equity" in df.columns else (
        ratio("total_debt", "equity") if {"total_debt", "equity"} <= set(df.columns) else F.lit(None).cast("double")
    )


def _coverage(df: DataFrame) -> Column:
    if "interest_coverage" in df.columns:
        return F.col("interest_coverage")
    if {"ebit", "interest_expense"} <= set(df.columns):
        return ratio("ebit", F.abs("interest_expense"))
    return F.lit(None).cast("double")


def _debt_ebitda(df: DataFrame) -> Column:
    have = set(df.columns)
    if "debt_ebitda" in have:
        return F.col("debt_ebitda")
    if {"net_debt", "ebitda"} <= have:
        return ratio("net_debt", "ebitda")
    if {"total_debt", "ebitda"} <= have:
        cash = F.col("cash") if "cash" in have else F.lit(0.0)
        return ratio(F.col("total_debt") - cash, "ebitda")
    return F.lit(None).cast("double")


def _leverage_score(x: Column) -> Column:
    return _neutral(1 - clip(x, 0, 3) / 3)


def _coverage_score(x: Column) -> Column:
    return _neutral(clip(x, 0, 10) / 10)


def _against_history(df: DataFrame, by: Sequence[str], now: str, past: str | None, out: str, median: str) -> DataFrame:
    """The history column, whether the cross-section has any history, and the cross-section's median
    of the current values, which stands in where there is none at all."""
    df = df.withColumn(out, F.lit(None).cast("double") if past is None else F.col(past).cast("double"))
    if past is None:
        df = df.withColumns({f"{out}_known": F.lit(False), "_open": F.col(now)})
    else:
        known = df.groupBy(*by).agg((F.count(out) > 0).alias(f"{out}_known"))
        df = df.join(known, list(by), "left").withColumn("_open", F.when(~F.col(f"{out}_known"), F.col(now)))
    medians = quantiles(df, by, "_open", {median: 0.5}).drop("n_values")
    return df.join(medians, list(by), "left").drop("_open")


def _ranked(df: DataFrame, by: Sequence[str], key: Sequence[str]) -> DataFrame:
    """All ranks of the value and quality scores in one pass over the universe."""
    pe_now, fcf_now = _present(df, "pe_ratio", "pe"), _present(df, "fcf_yield")
    df = df.withColumns(
        {
            "_roe": _present(df, "roe_avg", "roe"),
            "_roic": _present(df, "roic_avg", "roic"),
            "_margin": _present(df, "margin_avg", "operating_margin"),
            "_fcf_yield": fcf_now,
            "_ev_ebit": _present(df, "ev_ebit"),
            "_pe": pe_now,
        }
    )
    df = stage(df)  # the medians and the ranks read it
    have = set(df.columns)
    pe_past = next((c for c in ("pe_5y_avg", "pe_avg") if c in have), None)
    fcf_past = next((c for c in ("fcf_yield_5y_avg", "fcf_yield_avg") if c in have), None)
    df = _against_history(df, by, "_pe", pe_past, "_pe_past", "_pe_median")
    df = _against_history(df, by, "_fcf_yield", fcf_past, "_fcf_past", "_fcf_median")
    own_pe, own_fcf = F.nullif("_pe_past", F.lit(0.0)), F.nullif("_fcf_past", F.lit(0.0))
    discount = F.when(F.col("_pe_past_known"), (own_pe - F.col("_pe")) / F.abs(own_pe)).otherwise(ratio(F.col("_pe_median") - F.col("_pe"), "_pe_median"))
    premium = F.when(F.col("_fcf_past_known"), (F.col("_fcf_yield") - own_fcf) / F.abs(own_fcf)).otherwise(
        ratio(F.col("_fcf_yield") - F.col("_fcf_median"), "_fcf_median")
    )
    df = df.withColumns(
        {"_discount": F.coalesce(discount, F.lit(0.0)), "_premium": F.coalesce(premium, F.lit(0.0))}
    )
    within = "sector" if "sector" in have else None
    return pct_ranks(
        df,
        by,
        key,
        [
            Rank("_roe_r", "_roe", within),
            Rank("_roic_r", "_roic", within),
            Rank("_margin_r", "_margin", within),
            Rank("_fcf_yield_r", "_fcf_yield", within),
            Rank("_ev_ebit_r", "_ev_ebit", within),
            Rank("_pe_r", "_pe", within),
            Rank("_discount_r", "_discount"),
            Rank("_premium_r", "_premium"),
        ],
        stored=True,
    )


def _quality(df: DataFrame) -> dict[str, Column]:
    roe_r, roic_r, margin_r = _neutral("_roe_r"), _neutral("_roic_r"), _neutral("_margin_r")
    profitability = clip(roe_r * (0.20 / 0.50) + roic_r * (0.15 / 0.50) + margin_r * (0.15 / 0.50), 0, 1)

    def stability(spread: Column, level: str, rank: Column) -> Column:
        cv = F.coalesce(ratio(F.abs(spread), F.abs(level)), F.lit(0.5))
        return F.when(spread.isNull(), rank * 0.7 + 0.15).otherwise(clip(1 / (1 + cv), 0, 1))

    steady = clip(
        0.5 * stability(_present(df, "roe_std"), "_roe", roe_r)
        + 0.5 * stability(_present(df, "margin_std"), "_margin", margin_r),
        0,
        1,
    )
    sheet = clip(0.5 * _leverage_score(_debt_equity(df)) + 0.5 * _coverage_score(_coverage(df)), 0, 1)
    return {
        "quality_profitability": profitability,
        "quality_stability": steady,
        "quality_balance_sheet": sheet,
        "score_quality_v30": half_even(0.50 * profitability + 0.30 * steady + 0.20 * sheet, 3),
    }


def _value(df: DataFrame) -> dict[str, Column]:
    cross = clip(
        _neutral("_fcf_yield_r") * (0.25 / 0.60)
        + _neutral(1 - F.col("_ev_ebit_r")) * (0.25 / 0.60)
        + _neutral(1 - F.col("_pe_r")) * (0.10 / 0.60),
        0,
        1,
    )
    safety = clip(0.5 * F.col("_discount_r") + 0.5 * F.col("_premium_r"), 0, 1)
    return {
        "value_cross_section": cross,
        "value_margin_of_safety": safety,
        "score_value_v30": half_even(0.60 * cross + 0.40 * safety, 3),
    }


def _risk(df: DataFrame) -> dict[str, Column]:
    have = set(df.columns)
    sheet = clip(
        _leverage_score(_debt_equity(df)) * (0.25 / 0.50)
        + _neutral(1 - clip(_debt_ebitda(df), 0, 4) / 4) * (0.15 / 0.50)
        + _coverage_score(_coverage(df)) * (0.10 / 0.50),
        0,
        1,
    )
    if "max_drawdown_5y" in have:
        drawdown = F.abs("max_drawdown_5y")
    elif "max_drawdown" in have:
        drawdown = F.abs("max_drawdown")
    else:
        drawdown = F.coalesce(_present(df, "volatility_annual", "volatility") * 2.5, F.lit(0.30))
    drawdown_score = _neutral(1 - clip(drawdown, 0, 0.60) / 0.60)
    if "dd_recovery_months" in have:
        recovery = _neutral(1 - clip("dd_recovery_months", 0, 24) / 24)
    else:
        recovery = _neutral(clip(1 - drawdown / 0.60, 0, 1))
    falls = clip(drawdown_score * (0.20 / 0.30) + recovery * (0.10 / 0.30), 0, 1)
    if "volatility_annual" in have or "volatility" in have:
        vol = _present(df, "volatility_annual", "volatility")
    elif "beta" in have:
        vol = F.col("beta") * 0.16
    else:
        vol = F.lit(0.25)
    calm = _neutral(1 - clip(vol, 0, 0.60) / 0.60)
    return {
        "risk_balance_sheet": sheet,
        "risk_drawdown": falls,
        "risk_volatility": calm,
        "score_risk_v30": half_even(0.50 * sheet + 0.30 * falls + 0.20 * calm, 3),
    }


def _drop_temporary(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def score_value_v30(df: DataFrame, by: Sequence[str] = ("as_of_date",), key: Sequence[str] = ("symbol",)) -> DataFrame:
    ranked = _ranked(df, by, key)
    return _drop_temporary(ranked.withColumns(_value(ranked)))


def score_quality_v30(df: DataFrame, by: Sequence[str] = ("as_of_date",), key: Sequence[str] = ("symbol",)) -> DataFrame:
    ranked = _ranked(df, by, key)
    return _drop_temporary(ranked.withColumns(_quality(df=ranked)))


def score_risk_v30(df: DataFrame) -> DataFrame:
    """Row-wise: no ranks, so no shuffle."""
    return df.withColumns(_risk(df))


def composite_v30(
    df: DataFrame,
    by: Sequence[str] = ("as_of_date",),
    key: Sequence[str] = ("symbol",),
    weights: dict[str, float] | None = None,
    min_score: float = CONSTRAINTS_V30.min_score,
    with_rank: bool = True,
) -> DataFrame:
    """All three scores from one ranked pass, the composite, its rank and the minimum-score flag.

    ``with_rank=False`` leaves the universe rank out, for callers that only
    need the best names (a top-k needs no full ranking)."""
    w = weights or WEIGHTS_V30
    ranked = _ranked(df, by, key)
    scored = ranked.withColumns(_quality(ranked) | _value(ranked) | _risk(ranked))
    composite = half_even(
        w["value"] * F.col("score_value_v30")
        + w["quality"] * F.col("score_quality_v30")
        + w["risk"] * F.col("score_risk_v30"),
        3,
    )
    scored = _drop_temporary(scored).withColumn("score_composite_v30", composite)
    if with_rank:
        scored = descending_rank(scored, by, "score_composite_v30", "rank_v30")
    return scored.withColumn("passes_min_score_v30", F.col("score_composite_v30") >= min_score)


def tie_breaker(df: DataFrame, by: Sequence[str] = ("as_of_date",)) -> DataFrame:
    """A 0.001-sized insider bonus and the rank after it."""
    if "score_insider" in df.columns:
        bonus = F.col("score_insider") * 0.001
    elif "insider_buys" in df.columns:
        bonus = F.when(F.col("insider_buys") > 0, 0.001).otherwise(0.0)
    else:
        bonus = F.lit(0.0)
    out = df.withColumn("tie_breaker_bonus", bonus).withColumn(
        "score_with_tiebreaker", F.col("score_composite_v30") + F.col("tie_breaker_bonus")
    )
    return descending_rank(out, by, "score_with_tiebreaker", "rank_v30_final")


def top_holdings(
    df: DataFrame,
    by: Sequence[str] = ("as_of_date",),
    score: str = "score_composite_v30",
    n: int = 20,
    min_score: float | None = CONSTRAINTS_V30.min_score,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Top ``n`` names per cross-section by a chosen score, with an optional floor."""
    eligible = df if min_score is None else df.where(F.col(score) >= min_score)
    out = top_k(eligible, by, [F.col(score).desc(), F.col("symbol")], n, rank="position")
    if columns is None:
        return out
    return out.select(*by, "position", *[c for c in columns if c in out.columns])
