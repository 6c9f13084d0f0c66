"""Steps whose cost a larger table showed: the plan or the work they need, and the same rows as before."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stratafin.operators import series
from stratafin.plans import backtest, calendar
from stratafin.sources import text_blocks


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def daily(spark):
    """Two symbols over two turns of the year, a missing price at the second of them, and a row without date."""
    first = dt.date(1996, 11, 20)
    rows = [(s, first + dt.timedelta(days=i), None if (s, i) == ("A", 407) else 100.0 + (i * k) % 17) for s, k in (("A", 5), ("B", 3)) for i in range(450)]
    return spark.createDataFrame([*rows, ("B", None, 7.0)], "symbol string, date date, close double")


@pytest.mark.parametrize("mode", ["history", "live", "backtest"])
def test_price_features_need_one_sort(daily, mode):
    assert plan_of(series.price_features(daily, mode=mode)).count("Sort [") == 1


def test_year_to_date_starts_at_each_year(daily):
    out = {(r.symbol, r.date): r.perf_ytd for r in series.price_features(daily).collect()}
    prices = {(r.symbol, r.date): r.close for r in daily.collect()}
    for (symbol, date), close in prices.items():
        year = sorted(d for s, d in prices if s == symbol and d and date and d.year == date.year)
        opening = prices[symbol, year[0]] if date else None
        if date is None or date == year[0] or close is None or opening is None:
            assert out[symbol, date] is None
        else:
            assert out[symbol, date] == pytest.approx(round((close / opening - 1) * 100, 2), abs=0.011)


def test_price_factors_are_folded_at_listed_dates_only(spark, daily):
    """The same rows as windows over every price would give, without a sliding window over prices."""
    listed = spark.createDataFrame([(dt.date(1997, 1, 1),), (dt.date(1997, 1, 1),), (dt.date(1996, 12, 1),), (dt.date(1997, 11, 3),), (dt.date(1999, 1, 1),)], "date date")
    prices = daily.withColumn("tag", F.concat("symbol", F.dayofyear("date").cast("string")))
    for min_rows in (2, 60):
        got = series.price_factor_inputs_at(prices, listed, min_rows=min_rows)
        want = backtest.prices_at(series.price_factor_inputs(prices, min_rows=min_rows), listed)
        names = sorted(want.columns)
        assert sorted(got.columns) == names and want.count() >= 4
        plain = lambda df: sorted(map(repr, df.select(*names).collect()))
        assert plain(got) == plain(want)
    assert "stddev_samp(" not in "".join(line for line in plan_of(got).splitlines() if "Window [" in line)


def test_period_results_read_held_names_only(spark, daily):
    """Prices of names that are never held don't reach the fold over periods; the results are those of all prices."""
    instants = spark.createDataFrame([(dt.date(1997, 1, 1),), (dt.date(1997, 4, 1),), (dt.date(1997, 7, 1),)], "date date")
    weights = spark.createDataFrame([("c", dt.date(1997, 1, 1), "A", 0.5), ("c", dt.date(1997, 4, 1), "Z", 1.0)], "config_id string, rebalance_date date, symbol string, weight double")
    prices = daily.select("symbol", "date", "close")
    market = prices.where("symbol = 'B'").select("date", "close")
    out = backtest.period_results(weights, prices, calendar.periods_between(instants), market, ["config_id"])
    assert "LeftSemi" in plan_of(out)
    rows = {r.period_start: r for r in out.collect()}
    close = {r.date: r.close for r in prices.where("symbol = 'A'").collect()}
    assert rows[dt.date(1997, 1, 1)].portfolio_return == pytest.approx(0.5 * (close[dt.date(1997, 4, 1)] / close[dt.date(1997, 1, 1)] - 1))
    assert rows[dt.date(1997, 4, 1)].portfolio_return == 0 and rows[dt.date(1997, 4, 1)].n_positions == 1


def test_portfolio_returns_keep_the_days_of_all_names(spark, daily):
    """Returns of the held names with the days of all prices give what the returns of all names give."""
    weights = spark.createDataFrame([("p", dt.date(1996, 12, 2), "A", 0.5), ("p", dt.date(1997, 2, 3), "A", 1.0)], "portfolio_id string, rebalance_date date, symbol string, weight double")
    prices = daily.unionByName(spark.createDataFrame([("B", dt.date(1999, 1, 4), 9.0)], daily.schema))
    held = series.simple_returns(prices.where("symbol = 'A'"))
    got = backtest.portfolio_returns(weights, held, days=prices).orderBy("date").collect()
    assert got == backtest.portfolio_returns(weights, series.simple_returns(prices)).orderBy("date").collect()
    assert got[-1].date == dt.date(1999, 1, 4)


def test_fund_holdings_are_parsed_once_and_inside_the_array(spark):
    """No filter that parses the captures again, no projection of all cells; rows of both layouts as before."""
    cells = ["AAPL", "Apple Inc", "5.25%", "-0.39%", "8.57M", "$ 1,234.5M", "$ 12K", "-36.56% (-4.5M)", "$14.62 (+959.2%)"]
    head = "Jane Roe 13F Portfolio\nF1 Capital | Someone | 7.17% | $1.5T | 2\n"
    table = head + "Stock\tCompany\t%\td\ts\tv\tt\ta\tp\tsector\tdate\n" + "\t".join([*cells, "Tech", "2025-09-30"]) + "\nshort\tline\n"
    block = head + "\n".join([*cells, "Tech2025-09-30"]) + "\n" + "\n".join(["BRK.B", *cells[1:], "Fin\t2025-06-30"])
    docs = spark.createDataFrame([("t", table), ("b", block), ("none", "no rows"), ("null", None)], "doc_id string, text string")
    out = text_blocks.parse_fund_holdings(docs)
    plan = plan_of(out)
    assert not [line for line in plan.splitlines() if "Filter" in line and "regexp_extract_all" in line]
    rows = sorted(map(tuple, out.drop("fund_name").collect()))
    typed = ("Apple Inc", 5.25, -0.39, 8.57, 1234.5, 0.012, -36.56, -4.5, 14.62, 959.2)
    assert rows == [
        ("b", "vertical", 0, "AAPL", *typed, "Tech", "2025-09-30"),
        ("b", "vertical", 1, "BRK.B", *typed, "Fin", "2025-06-30"),
        ("t", "table", 0, "AAPL", *typed, "Tech", "2025-09-30"),
    ]
