import pytest
from pyspark.sql import functions as F

from stratafin.functions.ratios import earnings_features
from stratafin.operators import overlay, scores_v22, scores_v23, scores_v30

M1 = [
    ("AAPL", "Tech"), ("MSFT", "Tech"), ("JNJ", "Health"), ("XOM", "Energy"), ("BAC", "Fin"), ("HIGH_RISK", "Tech"),
]


def crowd(spark):
    # eight names in descending order of every signal, as in the demo table's shape
    rows = [
        ("AAPL", 150, 5.0, 20, 0.85), ("MSFT", 140, 4.5, 15, 0.82), ("V", 120, 4.0, 10, 0.78), ("JPM", 100, 3.5, 5, 0.65),
        ("XOM", 80, 2.5, -5, 0.55), ("PG", 60, 2.0, -10, 0.50), ("KO", 40, 1.5, -2, 0.45), ("WMT", 30, 1.6, -3, 0.40),
    ]
    return spark.createDataFrame(rows, "symbol string, nb_hedge_funds int, avg_hf_weight double, hf_change_3m int, holder_score double").withColumn("as_of_date", F.lit("d"))


def test_crowding_bands_and_penalty(spark):
    got = {r.symbol: r for r in overlay.crowding(crowd(spark)).collect()}
    assert got["AAPL"].crowding_score == pytest.approx(1.0)
    assert got["AAPL"].crowding_tier == "extreme" and got["AAPL"].holder_adjusted == pytest.approx(0.425)
    assert got["MSFT"].crowding_score == pytest.approx(0.875) and got["MSFT"].crowding_tier == "high"
    assert got["V"].crowding_tier == "medium" and got["XOM"].crowding_tier == "low"
    # the four non-positive changes are tied at zero
    assert got["XOM"].crowding_score == pytest.approx(0.4 * 0.5 + 0.3 * 0.5 + 0.3 * 2.5 / 8)


def test_accruals_and_conversion(spark):
    df = spark.createDataFrame(
        [("QUALITY", 100.0, 120.0, 110.0, 1000.0), ("WILD", 10.0, -990.0, 900.0, 1000.0)],
        "symbol string, net_income double, operating_cash_flow double, fcf double, total_assets double",
    )
    got = {r.symbol: r for r in earnings_features(df).collect()}
    assert got["QUALITY"].accruals == pytest.approx(-0.02) and got["QUALITY"].fcf_ni_ratio == pytest.approx(1.1)
    assert got["WILD"].accruals == pytest.approx(0.5) and got["WILD"].fcf_ni_ratio == pytest.approx(3.0)


def companies(spark):
    cols = "symbol string, sector string, market_cap double, fcf double, ebit double, total_debt double, equity double, cash double, interest_expense double, vol_30d double, pe_ratio double, revenue double, net_income double"
    rows = [
        ("GOOD", "Technology", 1e11, 1e10, 1.2e10, 1e10, 5e10, 2e10, 5e8, 18.0, 12.0, 5e10, 9e9),
        ("RISKY", "Technology", 1e10, -5e8, 2e8, 2e10, 5e9, 1e8, 1e9, 60.0, None, 1e10, -2e8),
        ("NEUTRAL", "Technology", 5e10, 2e9, 3e9, 1.5e10, 2e10, 3e9, 5e8, 28.0, 20.0, 2e10, 2e9),
        ("EMPTY", "Technology", None, None, None, None, None, None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, cols).withColumn("as_of_date", F.lit("d"))


def test_absolute_value_quality_risk_order(spark):
    df = scores_v23.score_risk(scores_v23.score_quality(scores_v23.score_value_absolute(companies(spark))))
    got = {r.symbol: r for r in df.collect()}
    for c in ("score_value", "score_quality", "score_risk"):
        assert got["GOOD"][c] > got["NEUTRAL"][c] > got["RISKY"][c] or got["GOOD"][c] > got["RISKY"][c]
        assert all(0 <= r[c] <= 1 for r in got.values())
    assert got["EMPTY"].score_value == 0.5
    assert got["EMPTY"].score_risk == pytest.approx(0.5 * 0.0 + 0.3 * 1.0 + 0.2 * 0.5)
    # fcf/mcap .10 -> 1; ev/ebit 7.5, no three peers with a lower median... ladder against the sector median
    assert got["GOOD"].score_value_fcf_yield == 1.0


def test_few_values_are_neutral(spark):
    df = scores_v23.score_value_cross_sectional(companies(spark))
    assert {r.score_value for r in df.collect()} == {0.5}


def test_risk_levels(spark):
    got = {r.symbol: r for r in scores_v23.score_risk(companies(spark)).collect()}
    assert got["GOOD"].score_risk_leverage == 1.0 and got["GOOD"].score_risk_coverage == 1.0 and got["GOOD"].score_risk_volatility == 0.8
    assert got["RISKY"].score_risk_leverage == 0.0 and got["RISKY"].score_risk_coverage == 0.0


def test_quality_history(spark):
    schema = "symbol string, equity double, total_debt double, roic_history array<double>, margin_history array<double>, fcf_history array<double>, shares_history array<double>"
    df = spark.createDataFrame(
        [
            ("UP", 100.0, 50.0, [0.3, 0.3, 0.3], [0.2, 0.2, 0.2], [10.0, 12.0, 14.4], [10.0, 9.5, 9.0]),
            ("DOWN", 100.0, 250.0, [0.01, 0.02, 0.03], [0.2, -0.1, -0.3], [10.0, 5.0, -1.0], [10.0, 10.0, 11.0]),
            ("TURN", 100.0, 120.0, [0.12, 0.12, 0.12], [0.2, 0.25, 0.3], [-1.0, 5.0, 6.0], [10.0, 10.0, 10.0]),
        ],
        schema,
    )
    got = {r.symbol: r for r in scores_v23.score_quality(df).collect()}
    assert got["UP"].score_quality == 1.0
    assert got["DOWN"].score_quality == 0.0
    assert got["TURN"].score_quality_fcf_growth == 0.8 and got["TURN"].score_quality_discipline == 0.5


def test_composite_renormalises_weights(spark):
    df = spark.createDataFrame([("d", "A", 0.8, 0.6, 0.4), ("d", "B", 0.2, 0.4, 0.6)], "as_of_date string, symbol string, score_value double, score_quality double, score_risk double")
    got = {r.symbol: r for r in scores_v23.composite_v23(df, use_zscore=False).collect()}
    want = (0.30 * 0.8 + 0.25 * 0.6 + 0.15 * 0.4) / 0.70
    assert got["A"].score_composite == pytest.approx(round(want, 4)) and got["A"].core_score == pytest.approx(0.6)
    assert got["A"].rank_composite == 1 and got["B"].rank_composite == 2
    with pytest.raises(ValueError):
        scores_v23.composite_v23(df.select("as_of_date", "symbol"))


def test_momentum_bands(spark):
    rows = [(55.0, 20.0, 1.0 * 0.4 + 0.3), (35.0, 6.0, 0.28 + 0.25), (65.0, 1.0, 0.28 + 0.2), (20.0, -5.0, 0.32 + 0.1), (80.0, -50.0, 0.12), (None, None, 0.4 + 0.1)]
    df = spark.createDataFrame([(r, p) for r, p, _ in rows], "rsi double, perf_3m double")
    got = [r.m for r in df.withColumn("m", scores_v22.momentum_score()).collect()]
    assert got == pytest.approx([w for *_, w in rows])


def v30_table(spark):
    cols = "symbol string, sector string, roe double, roic double, operating_margin double, debt_equity double, interest_coverage double, fcf_yield double, ev_ebit double, pe_ratio double, pe_5y_avg double, fcf_yield_5y_avg double, max_drawdown_5y double, volatility_annual double"
    rows = [
        ("A", "T", 0.4, 0.3, 0.30, 0.5, 20.0, 0.05, 15.0, 20.0, 25.0, 0.04, -0.2, 0.2),
        ("B", "T", 0.2, 0.1, 0.10, 2.5, 3.0, 0.02, 30.0, 40.0, 30.0, 0.03, -0.5, 0.5),
    ]
    return spark.createDataFrame(rows, cols).withColumn("as_of_date", F.lit("d"))


def test_v30_by_hand(spark):
    got = {r.symbol: r for r in scores_v30.composite_v30(v30_table(spark)).collect()}
    a = got["A"]
    # best of two: rank 1.0 when high is good, 1 - 0.5 when low is good
    quality = 0.5 * 1.0 + 0.3 * 0.85 + 0.2 * (0.5 * (1 - 0.5 / 3) + 0.5 * 1.0)
    cross = 1.0 * 0.25 / 0.6 + 0.5 * 0.25 / 0.6 + 0.5 * 0.10 / 0.6
    value = 0.6 * cross + 0.4 * 1.0
    risk = 0.5 * ((1 - 0.5 / 3) * 0.5 + 0.5 * 0.3 + 1.0 * 0.2) + 0.3 * ((1 - 0.2 / 0.6) * 2 / 3 + (1 - 0.2 / 0.6) / 3) + 0.2 * (1 - 0.2 / 0.6)
    assert a.score_quality_v30 == pytest.approx(quality, abs=6e-4)
    assert a.score_value_v30 == pytest.approx(value, abs=6e-4)
    assert a.score_risk_v30 == pytest.approx(risk, abs=6e-4)
    assert a.rank_v30 == 1 and got["B"].rank_v30 == 2 and a.passes_min_score_v30


def test_v30_without_history_uses_the_median(spark):
    df = v30_table(spark).drop("pe_5y_avg", "fcf_yield_5y_avg")
    got = {r.symbol: r for r in scores_v30.score_value_v30(df).collect()}
    assert got["A"].value_margin_of_safety == pytest.approx(1.0) and got["B"].value_margin_of_safety == pytest.approx(0.5)


def test_grid_cases(spark):
    def lst(rows):
        return spark.createDataFrame([("d", t, v) for t, v in rows], "as_of_date string, ticker string, value double")

    keys = "as_of_date string, ticker string"
    out = overlay.grid_score(
        lst([("A", 5.0), ("B", 4.0), ("C", 3.0)]), lst([("A", 2.0), ("D", 1.0), ("E", 0.5)]),
        spark.createDataFrame([("d", "D")], keys), spark.createDataFrame([("d", "B"), ("d", "Z")], keys),
    )
    got = {r.ticker: r for r in out.collect()}
    assert got["A"].composite_score == 120 and got["A"].bonus and got["A"].in_both
    assert got["B"].composite_score == 15  # 50 x .3: known zero purchases
    assert got["C"].composite_score == 0 and got["D"].composite_score == 20 and got["E"].composite_score == 0
    assert got["Z"].composite_score == 0 and got["Z"].buys_zero
