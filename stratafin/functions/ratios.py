"""Accounting and market ratios as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafin.functions.scalar import clip, col, first_nonzero, half_even, ratio, ratio_if_positive, safe_double, with_missing


def _pct_of(top: str | Column, bottom: str | Column) -> Column:
    return half_even(ratio_if_positive(top, bottom) * 100, 2)


def income_ratios(df: DataFrame) -> DataFrame:
    """Margins in percent; ``ebit`` falls back to operating income when missing or zero."""
    df = with_missing(df, {c: "double" for c in ["gross_profit", "operating_income", "ebit", "net_income", "revenue"]})
    return df.withColumns(
        {
            "ebit": F.coalesce(F.nullif(F.col("ebit"), F.lit(0.0)), F.col("operating_income")),
            "gross_margin": _pct_of("gross_profit", "revenue"),
            "operating_margin": _pct_of("operating_income", "revenue"),
            "net_margin": _pct_of("net_income", "revenue"),
        }
    )


def balance_ratios(df: DataFrame) -> DataFrame:
    """Total debt, current ratio, return on equity/assets (%), debt to equity."""
    wanted = ["short_term_debt", "long_term_debt", "current_assets", "current_liabilities", "equity", "total_assets", "net_income"]
    df = with_missing(df, {c: "double" for c in wanted})
    debt = F.when(
        F.col("short_term_debt").isNotNull() | F.col("long_term_debt").isNotNull(),
        F.coalesce("short_term_debt", F.lit(0.0)) + F.coalesce("long_term_debt", F.lit(0.0)),
    )
    return df.withColumns(
        {
            "total_debt": debt,
            "current_ratio": half_even(ratio_if_positive("current_assets", "current_liabilities"), 2),
            "roe": _pct_of("net_income", "equity"),
            "debt_equity": half_even(ratio_if_positive(debt, "equity"), 2),
            "roa": _pct_of("net_income", "total_assets"),
        }
    )


def cash_flow_ratios(df: DataFrame, infer_capex: bool = False) -> DataFrame:
    """Capex intensity (% of revenue) and free cash flow.

    Free cash flow is the reported figure, else operating cash flow minus
    capex (only when capex is known).  ``infer_capex`` also derives capex from
    the gap between operating and free cash flow when it is missing.
    """
    df = with_missing(df, {c: "double" for c in ["operating_cash_flow", "capex", "free_cash_flow", "revenue"]})
    spent = F.abs("capex")
    intensity = _pct_of(spent, "revenue")
    if infer_capex:
        gap = F.when(
            F.col("free_cash_flow") <= F.col("operating_cash_flow"),
            F.abs(F.col("operating_cash_flow") - F.col("free_cash_flow")),
        )
        intensity = F.coalesce(intensity, _pct_of(gap, "revenue"))
    computed = F.when(F.col("capex").isNotNull(), half_even(F.col("operating_cash_flow") - spent, 0))
    return df.withColumns({"capex_ratio": intensity, "fcf": F.coalesce("free_cash_flow", computed)})


def percent_if_fraction(value: str | Column) -> Column:
    """Ratios quoted as fractions in (-1, 1) become percent; others are kept."""
    x = col(value)
    return F.when((x > -1) & (x < 1), half_even(x * 100, 2)).otherwise(half_even(x, 2))


def statistics_fallback(df: DataFrame, pairs: dict[str, Sequence[str]], plain: Sequence[str] = ("current_ratio",)) -> DataFrame:
    """Fill missing ratios from a provider's statistics block (first non-zero synonym)."""
    out = {}
    for target, synonyms in pairs.items():
        quoted = first_nonzero(*synonyms)
        filled = half_even(quoted, 2) if target in plain else percent_if_fraction(quoted)
        out[target] = F.coalesce(F.col(target), filled)
    return df.withColumns(out)


def market_cap(df: DataFrame, missing_passes: bool = True) -> Column:
    """Given market cap, else shares x price, else NULL (read as "passes" by the screen)."""
    df_cols = set(df.columns)
    parts = [F.col("market_cap")] if "market_cap" in df_cols else []
    if {"shares_outstanding", "price"} <= df_cols:
        parts.append(F.col("shares_outstanding") * F.col("price"))
    value = F.coalesce(*parts) if parts else F.lit(None).cast("double")
    return F.coalesce(value, F.lit(float("inf"))) if missing_passes else value


def dollar_volume(df: DataFrame, missing_passes: bool = True) -> Column:
    df_cols = set(df.columns)
    parts = [F.col("adv_usd")] if "adv_usd" in df_cols else []
    if {"avg_volume", "price"} <= df_cols:
        parts.append(F.col("avg_volume") * F.col("price"))
    value = F.coalesce(*parts) if parts else F.lit(None).cast("double")
    return F.coalesce(value, F.lit(float("inf"))) if missing_passes else value


def leverage_ratios(df: DataFrame) -> DataFrame:
    """D/E, net debt / EBITDA (EBITDA falls back to 1.2 x EBIT) and interest coverage
    (interest falls back to 5 % of debt when the whole column is absent)."""
    have_interest = "interest_expense" in df.columns
    df = with_missing(df, {c: "double" for c in ["ebitda", "cash", "interest_expense", "debt_equity_given"]})
    interest = F.abs("interest_expense") if have_interest else F.col("total_debt") * 0.05
    ebitda = F.coalesce("ebitda", F.col("ebit") * 1.2)
    return df.withColumns(
        {
            "debt_equity": F.coalesce("debt_equity_given", ratio("total_debt", "equity")),
            "debt_ebitda": ratio(F.col("total_debt") - F.coalesce("cash", F.lit(0.0)), ebitda),
            "interest_coverage": ratio("ebit", interest),
        }
    ).drop("debt_equity_given")


def value_ratios(df: DataFrame) -> DataFrame:
    """FCF yield, enterprise value, EV/EBIT and P/E with their clips."""
    given = "pe_ratio" in df.columns
    df = with_missing(df, {"eps": "double", "price": "double", "total_debt": "double", "cash": "double"})
    ev = (
        F.coalesce("market_cap", F.lit(0.0)) + F.coalesce("total_debt", F.lit(0.0)) - F.coalesce("cash", F.lit(0.0))
    )
    pe = F.col("pe_ratio") if given else ratio_if_positive("price", "eps")
    return df.withColumns(
        {
            "fcf_yield": clip(ratio_if_positive("fcf", "market_cap"), -0.50, 0.50),
            "ev": ev,
            "ev_ebit": clip(ratio_if_positive(ev, "ebit"), 0.0, 100.0),
            "pe_ratio": clip(pe, 0.0, 200.0),
        }
    )


def profitability_ratios(df: DataFrame) -> DataFrame:
    """ROE, ROIC (25 % tax) and operating margin as fractions."""
    invested = F.col("equity") + F.coalesce("total_debt", F.lit(0.0)) - F.coalesce("cash", F.lit(0.0))
    return df.withColumns(
        {
            "roe": ratio("net_income", "equity"),
            "roic": F.when(invested > 0, F.col("ebit") * 0.75 / invested),
            "operating_margin": ratio("ebit", "revenue"),
        }
    )


#: fixed values: accepted spellings of operating cash flow, in order of preference
CASH_FLOW_COLUMNS = [
    "operating_cash_flow",
    "cfo",
    "netCashProvidedByOperatingActivities",
    "cashFlowFromOperations",
    "cash_flow_operating",
    "operatingCashFlow",
]


def cash_flow_column(df: DataFrame) -> Column:
    """The first spelling of operating cash flow that is present as a column."""
    for name in CASH_FLOW_COLUMNS:
        if name in df.columns:
            return F.col(name)
    return F.lit(None).cast("double")


def earnings_features(df: DataFrame) -> DataFrame:
    """Accruals = (net income - operating cash flow) / assets, and FCF / net income."""
    accruals = ratio(F.col("net_income") - cash_flow_column(df), "total_assets")
    return df.withColumns(
        {
            "accruals": clip(safe_double(accruals), -0.5, 0.5),
            "fcf_ni_ratio": clip(safe_double(ratio("fcf", "net_income")), -2.0, 3.0),
        }
    )


