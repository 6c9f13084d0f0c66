"""Parameters.  All numbers here are fixed values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass, field


def _sums_to_one(weights: dict[str, float], what: str) -> None:
    total = sum(weights.values())
    if abs(total - 1.0) > 1e-3 or any(w < 0 for w in weights.values()):
        raise ValueError(f"{what}: weights must be non-negative and sum to 1, got {total}")


# --- fixed values: factor weights -------------------------------------------
WEIGHTS_V22 = {"holder": 0.45, "insider": 0.15, "momentum": 0.25, "quality": 0.15}
WEIGHTS_V23 = {
    "holder": 0.15,
    "insider": 0.10,
    "momentum": 0.05,
    "value": 0.30,
    "quality": 0.25,
    "risk": 0.15,
}
WEIGHTS_V30 = {"value": 0.45, "quality": 0.35, "risk": 0.20}
VALUE_WEIGHTS = {"fcf_yield": 0.40, "ev_ebit": 0.40, "pe": 0.20}
QUALITY_WEIGHTS = {"roic": 0.35, "margin": 0.25, "fcf_growth": 0.20, "discipline": 0.20}
RISK_WEIGHTS = {"leverage": 0.50, "coverage": 0.30, "volatility": 0.20}

for _name, _weights in {
    "v2.2": WEIGHTS_V22,
    "v2.3": WEIGHTS_V23,
    "v3.0": WEIGHTS_V30,
    "value": VALUE_WEIGHTS,
    "quality": QUALITY_WEIGHTS,
    "risk": RISK_WEIGHTS,
}.items():
    _sums_to_one(_weights, _name)

# --- fixed values: threshold ladders (threshold, score), first match wins -----
FCF_YIELD_LADDER = [(0.08, 1.00), (0.05, 0.75), (0.03, 0.50), (0.00, 0.25)]
EV_EBIT_SECTOR_LADDER = [(0.60, 1.00), (0.80, 0.80), (1.00, 0.60), (1.20, 0.40)]
EV_EBIT_ABSOLUTE_LADDER = [(8.0, 1.00), (12.0, 0.80), (16.0, 0.60), (20.0, 0.40)]
PE_HISTORY_LADDER = [(0.70, 1.00), (0.85, 0.75), (1.00, 0.50), (1.15, 0.25)]
PE_ABSOLUTE_LADDER = [(10.0, 1.00), (15.0, 0.75), (20.0, 0.50), (25.0, 0.25)]
ROIC_LADDER = [(0.25, 1.00), (0.20, 0.85), (0.15, 0.70), (0.10, 0.50), (0.05, 0.30)]
MARGIN_CV_LADDER = [(0.10, 1.00), (0.20, 0.80), (0.30, 0.60), (0.50, 0.30)]
FCF_GROWTH_LADDER = [(0.15, 1.00), (0.10, 0.80), (0.05, 0.60), (0.00, 0.40)]
FCF_MARGIN_GROWTH_LADDER = [(0.15, 0.12), (0.10, 0.08), (0.05, 0.04)]
COVERAGE_LADDER = [(15.0, 1.00), (10.0, 0.85), (5.0, 0.65), (2.5, 0.40)]
VOLATILITY_LADDER = [(15.0, 1.00), (25.0, 0.80), (35.0, 0.60), (50.0, 0.30)]
LEVERAGE_LADDER = [(0.3, 1.0, 1.00), (0.5, 2.0, 0.85), (1.0, 3.0, 0.65), (1.5, 4.0, 0.40)]
PERF_ADDON_LADDER = [(15.0, 0.30), (5.0, 0.25), (0.0, 0.20), (-10.0, 0.10)]
TIER_SCORES = {"A": 1.0, "B": 0.75, "C": 0.5, "D": 0.25}
TIER_FLOORS = [(8, "A"), (6, "B"), (3, "C")]
CROWDING_BANDS = [(0.50, "low"), (0.75, "medium"), (0.90, "high")]
CAPEX_HEAVY_SECTORS = ["Technology", "Industrials", "Communication Services"]


@dataclass(frozen=True)
class Liquidity:
    min_market_cap: float = 2_000_000_000
    min_adv_usd: float = 5_000_000
    max_position_vs_adv: float = 0.02
    position_usd: float = 1_000_000


LIQUIDITY_V23 = Liquidity()
LIQUIDITY_V30 = Liquidity(min_market_cap=10_000_000_000, max_position_vs_adv=0.05)


@dataclass(frozen=True)
class Leverage:
    max_debt_equity: float = 3.0
    max_debt_ebitda: float = 4.0
    min_interest_coverage: float = 2.5
    relaxed_debt_equity: float = 5.0
    relaxed_min_survivors: int = 15


@dataclass(frozen=True)
class Eligibility:
    min_history_years: int = 7
    max_loss_years: int = 3
    excluded_industries: tuple[str, ...] = ("Biotechnology", "Blank Checks", "Shell Companies")


@dataclass(frozen=True)
class Constraints:
    min_positions: int = 12
    max_positions: int = 20
    max_weight: float = 0.12
    max_sector: float = 0.30
    min_score: float = 0.40
    min_price: float = 5.0
    min_weight: float = 0.03
    min_sectors: int = 4
    max_top5: float = 0.40
    max_top10: float = 0.70
    tolerance: float = 0.005


CONSTRAINTS_V23 = Constraints()
CONSTRAINTS_V30 = Constraints(min_positions=15, max_weight=0.10)


@dataclass(frozen=True)
class Rebalancing:
    frequency: str = "Q"
    cost_bps: float = 12.0
    no_trade_zone: float = 0.01
    max_turnover_annual: float = 0.80
    score_drop: float = 0.10


@dataclass(frozen=True)
class Publication:
    lag_days: int = 60
    double_lag: bool = True
    fiscal_month: int = 12
    fiscal_day: int = 31


@dataclass(frozen=True)
class Correlation:
    shrinkage: float = 0.2
    intra_sector: float = 0.7
    inter_sector: float = 0.4
    default_vol_pct: float = 25.0


@dataclass(frozen=True)
class Acceptance:
    min_sharpe: float = 0.55
    target_drawdown_pct: float = -25.0
    hard_drawdown_pct: float = -35.0


# --- fixed values: plausible ranges per metric (winsorising bounds) ------------
DATA_BOUNDS = {
    "revenue": (0.0, 1e13),
    "gross_profit": (-1e12, 1e13),
    "ebit": (-1e12, 1e12),
    "ebitda": (-1e12, 1.5e12),
    "net_income": (-1e12, 1e12),
    "fcf": (-5e11, 5e11),
    "capex": (-5e11, 0.0),
    "total_debt": (0.0, 5e12),
    "cash": (0.0, 5e12),
    "equity": (-1e12, 5e12),
    "total_assets": (0.0, 1e13),
    "shares_outstanding": (1e6, 50e9),
    "interest_expense": (-1e11, 1e11),
    "market_cap": (1e8, 5e13),
}
REQUIRED_FIELDS = ["revenue", "ebit", "net_income", "equity", "total_debt"]
PREFERRED_FIELDS = ["fcf", "cash", "interest_expense", "shares_outstanding"]

# --- fixed values: owner overlay ------------------------------------------------
OWNER_WEIGHTS = {
    "quality": 0.60,
    "value": 0.40,
    "moat": 0.40,
    "cash": 0.25,
    "solidity": 0.20,
    "capital_allocation": 0.15,
}


@dataclass(frozen=True)
class StressWindow:
    name: str
    start: str
    end: str
    max_acceptable_dd: float | None = None
    expected_return: float | None = None
    min_capture: float | None = None


# --- fixed values: historical stress windows ---------------------------------------
STRESS_WINDOWS = [
    StressWindow("covid_crash", "2020-02-19", "2020-03-23", -40.0),
    StressWindow("covid_recovery", "2020-03-23", "2020-08-31", None, 55.0, 0.5),
    StressWindow("gfc_2008", "2008-09-01", "2009-03-09", -45.0),
    StressWindow("rate_hikes_2022", "2022-01-03", "2022-10-12", -30.0),
    StressWindow("tech_correction_2022", "2021-11-19", "2022-12-28", -30.0),
    StressWindow("flash_crash_2010", "2010-05-06", "2010-05-07", -12.0),
    StressWindow("euro_crisis_2011", "2011-07-01", "2011-10-03", -25.0),
    StressWindow("china_deval_2015", "2015-08-10", "2015-08-25", -18.0),
    StressWindow("volmageddon_2018", "2018-01-26", "2018-02-08", -15.0),
    StressWindow("q4_2018", "2018-10-01", "2018-12-24", -25.0),
]


@dataclass(frozen=True)
class Scenario:
    name: str
    market_drawdown: float
    recovery_days: int
    value_impact: float
    quality_impact: float
    momentum_impact: float
    concentration_impact: float


# --- fixed values: shock scenarios -------------------------------------------------
SCENARIOS = [
    Scenario("2008 Financial Crisis", -56.8, 1400, -0.15, 0.05, -0.20, -0.10),
    Scenario("2011 European Debt Crisis", -21.6, 180, -0.05, 0.08, -0.10, -0.05),
    Scenario("2015-2016 China/Oil", -14.2, 120, -0.08, 0.05, -0.05, -0.03),
    Scenario("Q4 2018 Vol Spike", -19.8, 120, -0.03, 0.02, -0.15, -0.08),
    Scenario("COVID-19 Crash", -33.9, 150, -0.12, 0.10, -0.25, -0.05),
    Scenario("2022 Rate Hike", -25.4, 400, 0.08, -0.05, -0.10, -0.03),
]


@dataclass(frozen=True)
class PriceFactorConfig:
    config_id: str
    value: float
    quality: float
    momentum: float
    low_vol: float
    holder: float = 0.0


# --- fixed values: price-factor configurations ----------------------------------------
PRICE_FACTOR_CONFIGS = [
    PriceFactorConfig("core", 0.40, 0.35, 0.15, 0.10, 0.00),
    PriceFactorConfig("core_holder", 0.30, 0.25, 0.15, 0.15, 0.15),
    PriceFactorConfig("holder_reduced", 0.35, 0.30, 0.15, 0.15, 0.05),
]

# --- fixed values: ticker spellings ---------------------------------------------------
TICKER_ALIASES = {
    "BRK-A": "BRK.A",
    "BRK-B": "BRK.B",
    "BRKA": "BRK.A",
    "BRKB": "BRK.B",
    "BF-A": "BF.A",
    "BF-B": "BF.B",
    "BFA": "BF.A",
    "BFB": "BF.B",
}


@dataclass(frozen=True)
class ScoreRun:
    """What one scoring run needs to know beyond its table."""

    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS_V23))
    use_zscore: bool = True
    value_mode: str = "cross_sectional"
