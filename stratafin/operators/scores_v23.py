"""Value, quality, risk and composite scores of the 2.3/2.4 generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafin.functions.ratios import value_ratios
from stratafin.functions.scalar import half_even, ladder_above, ladder_below, ratio_if_positive, with_missing
from stratafin.operators.ranking import Rank, descending_rank, pct_ranks, quantiles, zscores
from stratafin.params import (
    COVERAGE_LADDER,
    EV_EBIT_ABSOLUTE_LADDER,
    EV_EBIT_SECTOR_LADDER,
    FCF_GROWTH_LADDER,
    FCF_MARGIN_GROWTH_LADDER,
    FCF_YIELD_LADDER,
    LEVERAGE_LADDER,
    MARGIN_CV_LADDER,
    PE_ABSOLUTE_LADDER,
    PE_HISTORY_LADDER,
    QUALITY_WEIGHTS,
    RISK_WEIGHTS,
    ROIC_LADDER,
    VALUE_WEIGHTS,
    VOLATILITY_LADDER,
    WEIGHTS_V23,
)
from stratafin.session import stage

_NEEDED = ["fcf", "market_cap", "total_debt", "cash", "ebit", "pe_ratio", "price", "eps", "revenue", "equity"]


def _zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0.0))


# --- value --------------------------------------------------------------------------------


def sector_ev_ebit_medians(df: DataFrame, by: Sequence[str] = ("as_of_date",), min_peers: int = 3) -> DataFrame:
    """Median EV/EBIT per sector over names with positive EBIT; sectors with fewer peers are left out."""
    ev_ebit = ratio_if_positive(F.col("market_cap") + _zero("total_debt") - _zero("cash"), "ebit")
    rows = df.select(*by, "sector", ev_ebit.alias("_ev_ebit"))
    out = quantiles(rows, by, "_ev_ebit", {"sector_ev_ebit": 0.5}, within="sector")
    return out.where(F.col("n_values") >= min_peers).drop("n_values")


def score_value_absolute(
    df: DataFrame,
    by: Sequence[str] = ("as_of_date",),
    medians: DataFrame | None = None,
    historical_pe: DataFrame | None = None,
    weights: dict[str, float] | None = None,
) -> DataFrame:
    """Ladder scores against sector medians and the name's own P/E history.

    ``medians``: ``(*by, sector, sector_ev_ebit)``; computed when not given.
    ``historical_pe``: ``(symbol, historical_pe)``.
    """
    w = weights or VALUE_WEIGHTS
    df = with_missing(df, {c: "double" for c in _NEEDED} | {"sector": "string"})
    if medians is None:
        df = stage(df)
        medians = sector_ev_ebit_medians(df, by)
    rows = df.join(medians, [*by, "sector"], "left")
    if historical_pe is not None:
        rows = rows.join(historical_pe, ["symbol"], "left")
    rows = with_missing(rows, {"historical_pe": "double"}).withColumns(
        {
            "_yield": ratio_if_positive("fcf", "market_cap"),
            "_ev_ebit": ratio_if_positive(F.col("market_cap") + _zero("total_debt") - _zero("cash"), "ebit"),
            "_pe": F.coalesce("pe_ratio", ratio_if_positive("price", "eps")),
        }
    )
    vs_sector = ladder_below(ratio_if_positive("_ev_ebit", "sector_ev_ebit"), EV_EBIT_SECTOR_LADDER, 0.20)
    ev_score = F.when(F.col("_ev_ebit").isNull(), 0.5).otherwise(
        F.coalesce(vs_sector, ladder_below("_ev_ebit", EV_EBIT_ABSOLUTE_LADDER, 0.20))
    )
    vs_history = ladder_below(ratio_if_positive("_pe", "historical_pe"), PE_HISTORY_LADDER, 0.0)
    pe_score = F.when(F.col("_pe").isNull() | (F.col("_pe") <= 0), 0.5).otherwise(
        F.coalesce(vs_history, ladder_below("_pe", PE_ABSOLUTE_LADDER, 0.0))
    )
    return (
        rows.withColumns(
            {
                "score_value_fcf_yield": ladder_above("_yield", FCF_YIELD_LADDER, 0.0, missing=0.5),
                "score_value_ev_ebit": ev_score,
                "score_value_mos": pe_score,
            }
        )
        .withColumn("score_value", _value_total(w))
        .drop("_yield", "_ev_ebit", "_pe", "sector_ev_ebit", "historical_pe")
    )


def _value_total(w: dict[str, float]) -> Column:
    return half_even(
        w["fcf_yield"] * F.col("score_value_fcf_yield")
        + w["ev_ebit"] * F.col("score_value_ev_ebit")
        + w["pe"] * F.col("score_value_mos"),
        3,
    )


def _value_metrics(df: DataFrame) -> DataFrame:
    measured = value_ratios(with_missing(df, {c: "double" for c in ("fcf", "market_cap", "ebit")}))
    return measured.withColumnsRenamed({"fcf_yield": "_fcf_yield", "ev_ebit": "_ev_ebit", "pe_ratio": "_pe"}).drop("ev")


def _percentile_scores(
    df: DataFrame, by, key, within: str | None, min_values: int, w: dict[str, float], stored: bool
) -> DataFrame:
    ranks = [Rank("_y", "_fcf_yield", within), Rank("_e", "_ev_ebit", within), Rank("_p", "_pe", within)]
    ranked = pct_ranks(_value_metrics(df), by, key, ranks, counts="_n", stored=stored)

    def score(rank: str, inverted: bool) -> Column:
        x = 1 - F.col(rank) if inverted else F.col(rank)
        if min_values:
            x = F.when(F.col(f"_n{rank}") >= min_values, x)
        return F.coalesce(x, F.lit(0.5))

    scored = ranked.withColumns(
        {
            "score_value_fcf_yield": score("_y", False),
            "score_value_ev_ebit": score("_e", True),
            "score_value_mos": score("_p", True),
        }
    ).withColumn("score_value", _value_total(w))
    return scored.withColumnRenamed("_pe", "pe_ratio").drop("_y", "_e", "_p", "_n_y", "_n_e", "_n_p", "_fcf_yield", "_ev_ebit")


def score_value_cross_sectional(
    df: DataFrame,
    by: Sequence[str] = ("as_of_date",),
    key: Sequence[str] = ("symbol",),
    weights: dict[str, float] | None = None,
    stored: bool = False,
) -> DataFrame:
    """Universe percentiles; a metric known for fewer than five names is neutral."""
    return _percentile_scores(df, by, key, None, 5, weights or VALUE_WEIGHTS, stored)


def score_value_sector_neutral(
    df: DataFrame,
    by: Sequence[str] = ("as_of_date",),
    key: Sequence[str] = ("symbol",),
    weights: dict[str, float] | None = None,
    stored: bool = False,
) -> DataFrame:
    within = "sector" if "sector" in df.columns else None
    return _percentile_scores(df, by, key, within, 0, weights or VALUE_WEIGHTS, stored)


def score_value(df: DataFrame, mode: str = "cross_sectional", by: Sequence[str] = ("as_of_date",), **kwargs) -> DataFrame:
    """``absolute``, ``cross_sectional`` or ``sector_neutral``."""
    modes = {
        "absolute": score_value_absolute,
        "cross_sectional": score_value_cross_sectional,
        "sector_neutral": score_value_sector_neutral,
    }
    if mode not in modes:
        raise ValueError(f"unknown value mode {mode!r}")
    return modes[mode](df, by, **kwargs)


# --- quality --------------------------------------------------------------------------------


def _mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def _usable(name: str, at_least: int) -> Column:
    return F.coalesce(F.size(F.col(name)) >= at_least, F.lit(False))


def score_quality(df: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Return on capital, margin stability, free-cash-flow growth and capital discipline.

    Histories are array columns ``roic_history, margin_history, fcf_history,
    shares_history`` (oldest first); without them current figures stand in.
    Row-wise: no shuffle.
    """
    w = weights or QUALITY_WEIGHTS
    histories = ["roic_history", "margin_history", "fcf_history", "shares_history"]
    df = with_missing(df, {c: "double" for c in [*_NEEDED, "operating_margin"]} | {c: "array<double>" for c in histories})
    invested = F.col("equity") + _zero("total_debt") - _zero("cash")
    fcf, shares = F.col("fcf_history"), F.col("shares_history")
    per_share = F.when(
        _usable("shares_history", 1) & (F.size(shares) == F.size(fcf)),
        F.zip_with(fcf, shares, lambda f, s: F.when(s > 0, f / F.nullif(s, F.lit(0.0))).otherwise(F.lit(0.0))),
    ).otherwise(fcf)
    staged = df.withColumns(
        {
            "_roic": F.when(_usable("roic_history", 3), _mean(F.col("roic_history"))).otherwise(
                F.when(invested > 0, F.col("ebit") * 0.75 / F.nullif(invested, F.lit(0.0)))
            ),
            "_margin_mean": F.when(_usable("margin_history", 3), _mean(F.col("margin_history"))),
            "_per_share": F.when(_usable("fcf_history", 3), per_share),
            "_de": F.when(F.col("equity") > 0, _zero("total_debt") / F.nullif(F.col("equity"), F.lit(0.0))).otherwise(F.lit(2.0)),
            "_fcf_margin": ratio_if_positive("fcf", "revenue"),
            "_buybacks": F.coalesce(
                F.when(
                    _usable("shares_history", 2),
                    F.try_element_at(shares, F.lit(-1)) / F.nullif(F.try_element_at(shares, F.lit(1)), F.lit(0.0)) - 1 < -0.02,
                ),
                F.lit(False),
            ),
        }
    )
    mean = F.col("_margin_mean")
    spread = F.sqrt(
        F.aggregate("margin_history", F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / F.size("margin_history")
    )
    first, last = F.try_element_at("_per_share", F.lit(1)), F.try_element_at("_per_share", F.lit(-1))
    years = F.size("_per_share") - 1
    staged = staged.withColumns(
        {
            "_cv": F.when(mean.isNotNull(), F.when(mean > 0, spread / F.nullif(mean, F.lit(0.0))).otherwise(F.lit(1.0))).otherwise(
                F.when(F.col("operating_margin").isNotNull(), F.lit(0.25))
            ),
            "_growth": F.when(
                F.col("_per_share").isNotNull(),
                F.when(
                    (first > 0) & (last > 0) & (years > 0),
                    F.pow(last / F.nullif(first, F.lit(0.0)), 1.0 / F.nullif(years, F.lit(0))) - 1,
                )
                .when((first <= 0) & (last > 0), F.lit(0.15))
                .otherwise(F.lit(-0.10)),
            ).otherwise(ladder_above("_fcf_margin", FCF_MARGIN_GROWTH_LADDER, 0.0)),
        }
    )
    de, buybacks = F.col("_de"), F.col("_buybacks")
    discipline = (
        F.when(buybacks & (de < 1.0), 1.0)
        .when(buybacks | (de < 1.0), 0.70)
        .when(de < 1.5, 0.50)
        .when(de < 2.0, 0.30)
        .otherwise(0.0)
    )
    scored = staged.withColumns(
        {
            "score_quality_roic": ladder_above("_roic", ROIC_LADDER, 0.0, missing=0.5),
            "score_quality_margin": ladder_below("_cv", MARGIN_CV_LADDER, 0.0, missing=0.5),
            "score_quality_fcf_growth": ladder_above("_growth", FCF_GROWTH_LADDER, 0.0, missing=0.5),
            "score_quality_discipline": discipline,
        }
    )
    total = (
        w["roic"] * F.col("score_quality_roic")
        + w["margin"] * F.col("score_quality_margin")
        + w["fcf_growth"] * F.col("score_quality_fcf_growth")
        + w["discipline"] * F.col("score_quality_discipline")
    )
    return scored.withColumn("score_quality", half_even(total, 3)).drop(
        "_roic", "_margin_mean", "_per_share", "_de", "_fcf_margin", "_buybacks", "_cv", "_growth"
    )


# --- risk ---------------------------------------------------------------------------------------


def score_risk(df: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Inverted risk (high = safe): leverage, coverage, volatility.  Row-wise."""
    w = weights or RISK_WEIGHTS
    needed = [*_NEEDED, "ebitda", "interest_expense", "vol_30d", "volatility", "vol_annual"]
    df = with_missing(df, {c: "double" for c in needed})
    ebitda = F.coalesce("ebitda", F.col("ebit") * 1.2)
    debt = _zero("total_debt")
    interest = F.when(
        F.col("interest_expense").isNull() | (F.col("interest_expense") == 0), F.when(debt > 0, debt * 0.05)
    ).otherwise(F.abs("interest_expense"))
    vol = F.coalesce("vol_30d", "volatility", "vol_annual")
    staged = df.withColumns(
        {
            "_de": F.when(F.col("equity") > 0, debt / F.nullif(F.col("equity"), F.lit(0.0))).otherwise(F.lit(3.0)),
            "_nd": F.when(ebitda > 0, (debt - _zero("cash")) / F.nullif(ebitda, F.lit(0.0))).otherwise(F.lit(5.0)),
            "_interest": interest,
            "_vol": F.when(vol > 1, vol).otherwise(vol * 100),
        }
    )
    leverage = F.when(F.lit(False), F.lit(0.0))
    for de_limit, nd_limit, score in LEVERAGE_LADDER:
        leverage = leverage.when((F.col("_de") < de_limit) & (F.col("_nd") < nd_limit), score)
    leverage = leverage.when(F.col("_de") < 2.0, 0.20).otherwise(0.0)
    coverage = F.when(F.col("_interest").isNull(), 1.0).otherwise(
        ladder_above(F.col("ebit") / F.nullif("_interest", F.lit(0.0)), COVERAGE_LADDER, 0.0, missing=0.5)
    )
    scored = staged.withColumns(
        {
            "score_risk_leverage": leverage,
            "score_risk_coverage": coverage,
            "score_risk_volatility": ladder_below("_vol", VOLATILITY_LADDER, 0.0, missing=0.5),
        }
    )
    total = (
        w["leverage"] * F.col("score_risk_leverage")
        + w["coverage"] * F.col("score_risk_coverage")
        + w["volatility"] * F.col("score_risk_volatility")
    )
    return scored.withColumn("score_risk", half_even(total, 3)).drop("_de", "_nd", "_interest", "_vol")


# --- composite -------------------------------------------------------------------------------------

#: fixed values: columns accepted per factor, first present wins
FACTOR_COLUMNS = {
    "holder": ["score_sm", "score_holders"],
    "insider": ["score_insider"],
    "momentum": ["score_momentum"],
    "value": ["score_value"],
    "quality": ["score_quality", "score_quality_v23"],
    "risk": ["score_risk"],
}


def composite_v23(
    df: DataFrame,
    by: Sequence[str] = ("as_of_date",),
    weights: dict[str, float] | None = None,
    use_zscore: bool = True,
    with_ranks: bool = True,
) -> DataFrame:
    """Composite over the available factors, weights rescaled to them; legacy quality mean; ranks.

    ``with_ranks=False`` leaves the two universe ranks out (a top-k needs none)."""
    w = weights or WEIGHTS_V23
    found = {f: next((c for c in FACTOR_COLUMNS[f] if c in df.columns), None) for f in w}
    found = {f: c for f, c in found.items() if c is not None}
    total_weight = sum(w[f] for f in found)
    if total_weight == 0:
        raise ValueError("no factor score available for the composite")
    if use_zscore:
        df = zscores(stage(df), by, list(found.values()))
    composite = None
    for factor, c in found.items():
        term = F.lit(w[factor] / total_weight) * F.col(f"{c}_z" if use_zscore else c)
        composite = term if composite is None else composite + term
    out = df.withColumn("score_composite", half_even(composite, 4))
    core = [found.get(f) for f in ("value", "quality", "risk")]
    if None in core:
        out = out.withColumn("core_score", F.lit(None).cast("double"))
        return descending_rank(out, by, "score_composite", "rank_composite") if with_ranks else out
    known = sum(F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in core)
    mean = sum(F.coalesce(F.col(c), F.lit(0.0)) for c in core) / F.nullif(known, F.lit(0))
    out = out.withColumn("core_score", half_even(mean, 3))
    if not with_ranks:
        return out
    out = descending_rank(out, by, "score_composite", "rank_composite")
    return descending_rank(out, by, "core_score", "rank_core")


def score_pipeline(
    df: DataFrame,
    by: Sequence[str] = ("as_of_date",),
    key: Sequence[str] = ("symbol",),
    value_mode: str = "cross_sectional",
    weights: dict[str, float] | None = None,
    use_zscore: bool = True,
    with_ranks: bool = True,
    stored: bool = False,
) -> DataFrame:
    """Value, quality, risk, composite."""
    extra = {} if value_mode == "absolute" else {"key": key, "stored": stored}
    scored = score_risk(score_quality(score_value(df, value_mode, by, **extra)))
    return composite_v23(scored, by, weights, use_zscore, with_ranks)
