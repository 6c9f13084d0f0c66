import json

import pytest
from pyspark.sql import functions as F

from stratafin.functions.ratios import balance_ratios, cash_flow_ratios, income_ratios, statistics_fallback
from stratafin.sources import readers, sinks, text_blocks


def put(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(data if isinstance(data, str) else json.dumps(data, indent=2))
    return str(path)


def test_newest_consensus_file(spark, tmp_path):
    for day, weight in (("2025-11-01", 0.1), ("2025-11-25", 0.2)):
        put(tmp_path / f"consensus_{day}.json", {"metadata": {}, "stocks": [{"symbol": "AAA", "company_name": "A Co", "portfolio_weight": weight, "buys_6m": 4}, {"symbol": "BBB"}]})
    got = {r.symbol: r for r in readers.read_consensus(spark, str(tmp_path)).collect()}
    assert got["AAA"].gp_weight == 0.2 and got["AAA"].gp_buys == 4 and got["BBB"].gp_tier == "D" and got["BBB"].gp_weight == 0.0


def test_both_insider_exports(spark, tmp_path):
    put(tmp_path / "trades_2025-01-01.json", {
        "trades": [{"symbol": "", "ticker": "X", "value": 5.0, "transaction_type": "P-Purchase"}, {"symbol": "", "ticker": ""}],
        "insider_trades": [{"ticker": "Y", "direction": "Sell", "transaction_value_millions": -2.0, "insider_name": "N"}],
    })
    got = {r.symbol: r for r in readers.read_insider(spark, str(tmp_path)).collect()}
    assert set(got) == {"X", "Y"} and got["Y"].value == 2e6 and got["Y"].transaction_type == "Sell"


def test_members_under_either_key(spark, tmp_path):
    a = put(tmp_path / "a.json", {"tickers": ["A", "B"]})
    b = put(tmp_path / "b.json", {"symbols": ["B", "C"]})
    assert {r.symbol for r in readers.read_members(spark, [a, b]).collect()} == {"A", "B", "C"}


def test_snapshots_skip_latest_and_empty(spark, tmp_path):
    row = {"symbol": "V", "sector": "F", "weight": 0.12, "td_price": 295.5}
    put(tmp_path / "2025-11-28" / "portfolio.json", {"metadata": {"date": "x"}, "portfolio": [row]})
    put(tmp_path / "2025-12-01" / "portfolio.json", {"metadata": {}, "portfolio": []})
    put(tmp_path / "latest" / "portfolio.json", {"metadata": {}, "portfolio": [row]})
    got = readers.read_snapshots(spark, str(tmp_path)).collect()
    assert len(got) == 1 and str(got[0].snapshot_date) == "2025-11-28" and got[0].price == 295.5


def test_symbol_csv_folder_and_coverage(spark, tmp_path):
    put(tmp_path / "AAA.csv", "date,close\n2020-01-01,1.5\n2020-01-02,bad\n2020-12-29,2.0\n")
    put(tmp_path / "B.B.csv", "date,close\n2020-06-01,3\n")
    prices = readers.read_symbol_csvs(spark, str(tmp_path))
    assert sorted((r.symbol, r.close) for r in prices.collect()) == [("AAA", 1.5), ("AAA", 2.0), ("B.B", 3.0)]
    cover = {r.symbol: r.covered for r in readers.range_coverage(prices, "2020-01-01", "2020-12-31").collect()}
    assert cover == {"AAA": True, "B.B": False}


def test_price_documents(spark, tmp_path):
    path = put(tmp_path / "ZZZ.json", {"values": [{"datetime": "2020-01-02 16:00:00", "close": "10.5"}, {"datetime": "2020-01-03", "close": "NaN"}]})
    got = readers.read_price_documents(spark, path).collect()
    assert [(r.symbol, str(r.date), r.close) for r in got] == [("ZZZ", "2020-01-02", 10.5)]


def test_statement_ratios_end_to_end(spark, tmp_path):
    path = put(tmp_path / "s.json", {
        "symbol": "Q",
        "income": {"sales": 0, "total_revenue": "200", "net_income": "20", "gross_profit": "90", "operating_income": "30", "ebit": None},
        "balance": {
            "assets": {"total_assets": "400", "current_assets": {"total_current_assets": "80"}},
            "liabilities": {"current_liabilities": {"total_current_liabilities": "40", "short_term_debt": "10"}, "non_current_liabilities": {}},
            "shareholders_equity": {"total_equity": "100"},
        },
        "cashflow": {"operating_activities": {"operating_cash_flow": "35"}, "investing_activities": {"capital_expenditures": "-10"}},
        "statistics": {"shares_outstanding": "7", "financials": {"return_on_equity_ttm": "0.15"}},
    })
    raw = readers.read_statements(spark, path)
    row = cash_flow_ratios(balance_ratios(income_ratios(raw))).first()
    assert row.ebit == 30 and row.gross_margin == 45.0 and row.operating_margin == 15.0 and row.net_margin == 10.0
    assert row.total_debt == 10 and row.current_ratio == 2.0 and row.roe == 20.0 and row.debt_equity == 0.1 and row.roa == 5.0
    assert row.capex_ratio == 5.0 and row.fcf == 25.0 and row.shares_outstanding == 7
    blank = raw.withColumn("roe", F.lit(None).cast("double")).withColumn("current_ratio", F.lit(None).cast("double"))
    filled = statistics_fallback(blank, {"roe": ["stat_roe"], "current_ratio": ["stat_current_ratio"]}).first()
    assert filled.roe == 15.0 and filled.current_ratio is None


def test_wide_panel_to_long(spark):
    wide = spark.createDataFrame([("2020-01-01", 1.0, None), ("2020-01-02", 2.0, 3.0)], "date string, A double, B double")
    assert sorted((r.symbol, str(r.date), r.close) for r in readers.long_prices(wide).collect()) == [("A", "2020-01-01", 1.0), ("A", "2020-01-02", 2.0), ("B", "2020-01-02", 3.0)]


def test_portfolio_written_and_read(spark, tmp_path):
    df = spark.createDataFrame([("A", "T", 0.6, float("nan"), 20.0), ("B", "H", 0.4, 2.0, None)], "symbol string, sector string, weight double, roe double, vol_30d double").withColumn("as_of_date", F.lit("2020-01-01").cast("date"))
    sinks.write_portfolio_json(df, str(tmp_path / "out"))
    back = {r.symbol: r for r in sinks.read_portfolio_documents(spark, str(tmp_path / "out")).collect()}
    assert back["A"].weight == 0.6 and back["A"].roe is None and back["B"].roe == 2.0
    doc = json.loads(next((tmp_path / "out").rglob("*.json")).read_text().splitlines()[0])
    assert doc["metadata"]["positions"] == 2 and doc["metrics"]["sector_weights"] == {"T": 60.0, "H": 40.0}
    assert [p["symbol"] for p in doc["portfolio"]] == ["A", "B"]


# --- captures ------------------------------------------------------------------------------------


def docs(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, text string")


def test_consensus_lines(spark):
    text = "Symbol\tStock\t%\n brk.b\tBerkshire\t0.5%\t9 funds\t$1,234.5\tn/a\t$1\t3%\t$2\nTOOLONG1\ta\tb\tc\td\te\tf\tg\th\nX\tshort"
    parsed = text_blocks.parse_consensus(text_blocks.explode_lines(docs(spark, text)))
    good, bad = text_blocks.split_errors(parsed)
    row = good.first()
    assert (row.symbol, row.buys_6m, row.buys_tier, row.hold_price, row.current_price, row.portfolio_weight) == ("BRK.B", 9, "A", 1234.5, 0.0, 0.5)
    assert sorted(r.line_no for r in bad.collect()) == [3, 4]


def test_insider_layouts(spark):
    block = "AAPL\tTim Cook\nCEO\nPurchase\n+10K\n$150.5\n$1.5M\n2M\nChief\t2024-01-02\t2024-01-03\n"
    rows = "Stock  Insider Trade\nMSFT  Amy Hood CFO  Sale (10b5-1 plan)  5K  $400  $2M  1M  Chief  2024-02-01  2024-02-02\n--- separator\nbad  line"
    got = {r.ticker: r for r in text_blocks.parse_insider(docs(spark, block + block.replace("AAPL", "NVDA"), rows)).where("error is null").collect()}
    assert set(got) == {"AAPL", "NVDA", "MSFT"}
    a, m = got["AAPL"], got["MSFT"]
    assert (a.insider_name, a.role, a.direction, a.is_informative) == ("Tim Cook", "CEO", "Buy", True)
    assert a.change_shares_millions == pytest.approx(0.01) and a.transaction_value_millions == 1.5 and a.trade_date == "2024-01-02"
    assert m.direction == "Sell" and m.transaction_value_millions == -2.0 and m.change_shares_millions == pytest.approx(-0.005) and m.is_informative is False


def test_institutional_layouts(spark):
    text = "Stock  Company Name\nMMM\n3M Co 1,374 659 565\n$ 2.73T\nIndustrials\n$86,62\n$212,19\nAAPL\nApple Inc\n1000 20 30\n$ 500M\nTechnology\n"
    got = {r.ticker: r for r in text_blocks.parse_institutional(docs(spark, text)).collect()}
    assert got["MMM"].company_name == "3M Co" and got["MMM"].total_holders == 1374 and got["MMM"].value_owned_billions == 2730.0
    assert got["AAPL"].sector == "Technology" and got["AAPL"].large_stakes == 30 and got["AAPL"].value_owned_billions == 0.5
    assert all(r.errors == [] for r in got.values())


def test_fund_layouts(spark):
    head = "Jane Roe 13F Portfolio\nBig Fund | x | 7.17% | $267.34B | 41\n"
    block = "PLTR\nPalantir Technologies Inc\n2.06%\n-0.39%\n8.57M\n$ 1.56B\n$ 786.68M\n-36.56% (-4.94M)\n$14.62 (+959.2%)\nTechnology\t2025-09-30\n"
    table = "Stock\tCompany\t%\t\t\t\t\t\t\t\t\n" + "\t".join(block.replace("\t", "\n").strip().split("\n"))
    got = text_blocks.parse_fund_holdings(docs(spark, head + block, head + table)).collect()
    assert sorted(r.layout for r in got) == ["table", "vertical"]
    for r in got:
        assert (r.ticker, r.portfolio_pct, r.shares_owned_millions, r.value_millions, r.latest_activity_shares, r.price_change_pct, r.sector, r.date) == ("PLTR", 2.06, 8.57, 1560.0, -4.94, 959.2, "Technology", "2025-09-30")
    h = text_blocks.parse_fund_headers(docs(spark, head)).first()
    assert (h.fund_name, h.portfolio_manager, h.performance_3y, h.aum_billions, h.total_holdings) == ("Big Fund", "Jane Roe", 7.17, 267.34, 41)


def test_metric_tokens(spark):
    members = spark.createDataFrame([("AAPL",), ("MSFT",), ("BRK.B",), ("KO",)], "ticker string")
    got = {r.ticker: r for r in text_blocks.parse_metrics(docs(spark, "1.45% aapl msft; -3 KO 2 brk-b KO:7 AAPL=-1 ZZZZ"), members).collect()}
    assert got["AAPL"].value == 1.45 and got["MSFT"].value == 1.45 and got["BRK.B"].value == 2.0 and got["KO"].value == 7.0
    assert got["ZZZZ"].is_member is False and got["BRK.B"].is_member


def test_captures_stream(spark, tmp_path):
    from stratafin.streaming.trades import captured_trades, windowed_activity

    block = "AAPL\tTim Cook\nCEO\nPurchase\n+10K\n$150.5\n$1.5M\n2M\nChief\t2024-01-02\t2024-01-03\n"
    put(tmp_path / "in" / "a.txt", block)
    stream = windowed_activity(captured_trades(spark, str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("activity").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        rows = spark.sql("select * from activity").collect()
    finally:
        q.stop()
    assert [(r.ticker, r.buys, r.net_value_millions) for r in rows] == [("AAPL", 1, 1.5)]


def test_dated_store_keeps_other_dates_and_marks_complete_ones(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = lambda dates, v: spark.createDataFrame([(d, "a", v) for d in dates], "as_of_date string, symbol string, x int").withColumn("as_of_date", F.col("as_of_date").cast("date"))
    read = lambda: sorted((str(r["as_of_date"]), r["x"]) for r in spark.read.parquet(path).collect())
    assert sinks.complete_dates(spark, path) == []
    sinks.write_fundamentals(rows(["2024-01-31", "2024-02-29"], 1), path)
    sinks.write_fundamentals(rows(["2024-02-29", "2024-03-31"], 2), path)
    assert read() == [("2024-01-31", 1), ("2024-02-29", 2), ("2024-03-31", 2)]
    assert sinks.complete_dates(spark, path) == ["2024-01-31", "2024-02-29", "2024-03-31"]
    broken = rows(["2024-03-31"], 3)
    with pytest.raises(Exception):
        sinks.write_dated(broken.withColumn("bad", F.expr("raise_error('stop')")), path, ["as_of_date"])
    sinks.write_fundamentals(rows([], 0), path)
    assert read()[-1] == ("2024-03-31", 2) and len(sinks.complete_dates(spark, path)) == 3
    assert readers.read_fundamentals_cache(spark, path, "2024-02-29").count() == 1


def test_late_headers_and_tables_are_found(spark):
    note = "just a note\n"
    row = "\t".join(["AAPL", "Apple", "1.5%", "0.1%", "8.57M", "$ 2M", "$ 1M", "-3% (-4M)", "$1 (+2%)", "Tech", "2025-09-30"])
    facts = "Jane Roe 13F Portfolio\nSome Fund | Someone | a | b | 7.17% | $1.5T | 3\n"
    texts = [note * 15 + facts + note * 30 + row + "\n" + row.replace("AAPL", "MSFT"), row + "\nfoot\t5%\n", "\n".join([note * 40, facts])]
    got = text_blocks.parse_fund_holdings(docs(spark, *texts)).collect()
    assert sorted((r.fund_name, r.ticker) for r in got) == sorted([("Some Fund", "AAPL"), ("Some Fund", "MSFT"), ("foot", "AAPL")])
    heads = text_blocks.parse_fund_headers(docs(spark, *texts)).collect()
    assert [h.performance_3y for h in heads] == [7.17, 5.0, 7.17]
    assert text_blocks.parse_fund_holdings(docs(spark, texts[0]), layout_within=20).count() == 0
    trade = "AAPL\tAnn Lee CEO\tSale\t2500K\t$12.25\t$1M\t3B\tx\t2025-01-02\t2025-01-03\n"
    late = note * 40 + "Stock\tInsider trades\n" + trade
    early = trade + "MSFT\tstock trade\tSale\t2500K\t$12.25\t$1M\t3B\tx\t2025-01-02\t2025-01-03\n"
    got = text_blocks.parse_insider(docs(spark, late, early)).where("error is null").collect()
    assert sorted(r.ticker for r in got) == ["AAPL", "AAPL", "MSFT"]
