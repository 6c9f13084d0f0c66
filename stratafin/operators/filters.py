"""Universe screens.  Each screen exists as flag columns (explanation) and as a filter.

All checks are row-wise expressions: no shuffle.  Only the per-date survivor
count of the relaxed fallback aggregates, with map-side partial counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafin.functions.ratios import dollar_volume, leverage_ratios, market_cap
from stratafin.functions.scalar import half_even, holds, with_missing
from stratafin.operators.ranking import top_k
from stratafin.params import Eligibility, Leverage, Liquidity
from stratafin.session import stage


def clean_universe(df: DataFrame, strict: bool = False) -> DataFrame:
    """Drop rows without a sector; strict mode also wants revenue and net income."""
    df = with_missing(df, {"sector": "string", "industry": "string", "revenue": "double", "net_income": "double"})
    df = df.withColumns({c: F.coalesce(F.col(c), F.lit("Unknown")) for c in ("sector", "industry")})
    keep = F.col("sector") != "Unknown"
    if strict:
        keep = keep & F.col("revenue").isNotNull() & F.col("net_income").isNotNull()
    return df.where(keep)


def candidates(df: DataFrame, min_buys: int = 2, limit: int | None = None, by: Sequence[str] = ("as_of_date",)) -> DataFrame:
    """Names with enough holder purchases or any insider purchase, optionally the first ``limit``."""
    kept = df.where(holds(F.col("gp_buys") >= min_buys) | holds(F.col("insider_buys") > 0))
    if limit is None:
        return kept
    return top_k(kept, by, [F.col("gp_buys").desc(), F.col("symbol")], limit)


# --- liquidity ----------------------------------------------------------------------


def explain_liquidity(df: DataFrame, p: Liquidity = Liquidity()) -> DataFrame:
    """Three pass flags and the position/volume ratio per row.  A size that
    cannot be derived from any column passes; a given but missing one does not."""
    sized = bool({"market_cap"} & set(df.columns)) or {"shares_outstanding", "price"} <= set(df.columns)
    traded = bool({"adv_usd"} & set(df.columns)) or {"avg_volume", "price"} <= set(df.columns)
    cap = market_cap(df, missing_passes=not sized)
    volume = dollar_volume(df, missing_passes=not traded)
    share = F.lit(p.position_usd) / F.when(volume == 0, F.lit(1.0)).otherwise(volume)
    return df.withColumns({"market_cap": cap, "adv_usd": volume, "position_vs_adv": share}).withColumns(
        {
            "market_cap_ok": holds(F.col("market_cap") >= p.min_market_cap),
            "adv_ok": holds(F.col("adv_usd") >= p.min_adv_usd),
            "position_ok": holds(F.col("position_vs_adv") <= p.max_position_vs_adv),
        }
    )


def liquidity_filter(df: DataFrame, p: Liquidity = Liquidity()) -> DataFrame:
    flagged = explain_liquidity(df, p).where(F.col("market_cap_ok") & F.col("adv_ok") & F.col("position_ok"))
    return flagged.drop("market_cap_ok", "adv_ok", "position_ok", "position_vs_adv")


# --- leverage -----------------------------------------------------------------------


def _leverage_flags(p: Leverage) -> dict[str, Column]:
    return {
        "D/E": holds(F.col("debt_equity") > p.max_debt_equity),
        "ND/EBITDA": holds(F.col("debt_ebitda") > p.max_debt_ebitda),
        "Coverage": holds(F.col("interest_coverage") < p.min_interest_coverage),
    }


def mark_leverage(df: DataFrame, p: Leverage = Leverage()) -> DataFrame:
    """``exclude_reasons``: every breached limit; unknown ratios pass."""
    measured = leverage_ratios(df)
    reasons = [F.when(flag, F.lit(name)) for name, flag in _leverage_flags(p).items()]
    return measured.withColumn("exclude_reasons", F.array_compact(F.array(*reasons)))


def leverage_filter(df: DataFrame, p: Leverage = Leverage()) -> DataFrame:
    return mark_leverage(df, p).where(F.size("exclude_reasons") == 0).drop("exclude_reasons")


def explain_leverage(df: DataFrame, p: Leverage = Leverage()) -> DataFrame:
    """Strict reading for one name: no positive equity or EBITDA counts as an
    unbounded ratio, no interest counts as unbounded coverage."""
    inf = F.lit(float("inf"))
    debt, cash = F.coalesce("total_debt", F.lit(0.0)), F.coalesce("cash", F.lit(0.0))
    ebitda = F.col("ebit") * 1.2
    interest = F.abs("interest_expense")
    out = df.withColumns(
        {
            "strict_debt_equity": F.when(F.col("equity") > 0, debt / F.col("equity")).otherwise(inf),
            "strict_debt_ebitda": F.when(ebitda > 0, (debt - cash) / ebitda).otherwise(inf),
            "strict_coverage": F.when(interest > 0, F.col("ebit") / interest).otherwise(inf),
        }
    ).withColumns(
        {
            "de_ok": F.col("strict_debt_equity") <= p.max_debt_equity,
            "nd_ebitda_ok": F.col("strict_debt_ebitda") <= p.max_debt_ebitda,
            "coverage_ok": F.col("strict_coverage") >= p.min_interest_coverage,
        }
    )
    finite = {c: F.when(F.col(c) == inf, None).otherwise(half_even(c, 2)) for c in ("strict_debt_equity", "strict_debt_ebitda", "strict_coverage")}
    return out.withColumn("should_exclude", ~(F.col("de_ok") & F.col("nd_ebitda_ok") & F.col("coverage_ok"))).withColumns(finite)


def screen_with_fallback(
    df: DataFrame, liquidity: Liquidity = Liquidity(), leverage: Leverage = Leverage(), by: Sequence[str] = ("as_of_date",)
) -> DataFrame:
    """Liquidity and leverage screens; a date left with too few names falls back to
    the cleaned universe, thinned to D/E <= 5 when that leaves enough names.

    The decision is taken per group from survivor counts, without a branch on
    collected data.
    """
    flagged = mark_leverage(explain_liquidity(df, liquidity), leverage).withColumns(
        {
            "_strict": F.col("market_cap_ok") & F.col("adv_ok") & F.col("position_ok") & (F.size("exclude_reasons") == 0),
            "_relaxed": F.col("debt_equity").isNull() | holds(F.col("debt_equity") <= leverage.relaxed_debt_equity),
        }
    )
    flagged = stage(flagged)
    counts = flagged.groupBy(*by).agg(
        F.count_if(F.col("_strict")).alias("_n_strict"), F.count_if(F.col("_relaxed")).alias("_n_relaxed")
    )
    least = leverage.relaxed_min_survivors
    mode = (
        F.when(F.col("_n_strict") >= least, F.lit("strict"))
        .when(F.col("_n_relaxed") >= least, F.lit("relaxed"))
        .otherwise(F.lit("unfiltered"))
    )
    keep = (
        F.when(F.col("screen_mode") == "strict", F.col("_strict"))
        .when(F.col("screen_mode") == "relaxed", F.col("_relaxed"))
        .otherwise(F.lit(True))
    )
    return (
        flagged.join(counts, list(by))
        .withColumn("screen_mode", mode)
        .where(keep)
        .drop("_strict", "_relaxed", "_n_strict", "_n_relaxed", "market_cap_ok", "adv_ok", "position_ok", "position_vs_adv", "exclude_reasons")
    )


# --- eligibility ----------------------------------------------------------------------


def _industry_excluded(p: Eligibility) -> Column:
    name = F.lower(F.trim(F.coalesce(F.col("industry"), F.lit(""))))
    return name.isin([i.lower() for i in p.excluded_industries])


def mark_eligibility(df: DataFrame, p: Eligibility = Eligibility()) -> DataFrame:
    """``rejected_for``: the first failed check in order (NULL when eligible).
    Unknown history or loss counts fail."""
    reason = F.lit(None).cast("string")
    checks: list[tuple[str, Column]] = []
    if "years_of_data" in df.columns:
        checks.append(("history_insufficient", ~holds(F.col("years_of_data") >= p.min_history_years)))
    if "loss_years_count" in df.columns:
        checks.append(("chronic_losses", ~holds(F.col("loss_years_count") <= p.max_loss_years)))
    if "industry" in df.columns and p.excluded_industries:
        checks.append(("excluded_industry", _industry_excluded(p)))
    for name, failed in reversed(checks):
        reason = F.when(failed, F.lit(name)).otherwise(reason)
    return df.withColumn("rejected_for", reason)


def explain_eligibility(df: DataFrame, p: Eligibility = Eligibility()) -> DataFrame:
    """All failed checks per row; unknown history or loss counts pass here."""
    reasons = F.array_compact(
        F.array(
            F.when(
                F.col("years_of_data") < p.min_history_years,
                F.concat(F.lit("history="), F.col("years_of_data").cast("string"), F.lit(f"y < {p.min_history_years}y")),
            ),
            F.when(
                F.col("loss_years_count") > p.max_loss_years,
                F.concat(F.lit("losses="), F.col("loss_years_count").cast("string"), F.lit(f" > {p.max_loss_years}")),
            ),
            F.when(_industry_excluded(p), F.concat(F.lit("industry="), F.lower(F.trim("industry")))),
        )
    )
    return df.withColumn("ineligible_reasons", reasons).withColumn("eligible", F.size("ineligible_reasons") == 0)


def rejection_counts(df: DataFrame, by: Sequence[str], reason: str = "rejected_for") -> DataFrame:
    return df.where(F.col(reason).isNotNull()).groupBy(*by, reason).agg(F.count(F.lit(1)).alias("n"))


# --- score gates ------------------------------------------------------------------------


def score_gate(
    df: DataFrame,
    by: Sequence[str] = ("as_of_date",),
    score: str = "score_composite",
    min_score: float = 0.40,
    min_price: float | None = None,
    keep: int = 40,
) -> DataFrame:
    """Minimum price, minimum composite, then the best ``keep`` names
    (twice the number of positions)."""
    rows = df if min_price is None else df.where(F.col("price") >= min_price)
    return top_k(rows.where(F.col(score) >= min_score), by, [F.col(score).desc(), F.col("symbol")], keep)


def only_eligible(df: DataFrame, flag: str = "eligible") -> DataFrame:
    return df.where(holds(F.col(flag)))


def funnel(df: DataFrame, by: Sequence[str], checks: dict[str, Column]) -> DataFrame:
    """Counts before, per failed check and after, in one aggregation."""
    passed = F.lit(True)
    for flag in checks.values():
        passed = passed & holds(flag)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("initial"),
        *[F.count_if(~holds(flag)).alias(f"failed_{name}") for name, flag in checks.items()],
        F.count_if(passed).alias("final"),
    )
