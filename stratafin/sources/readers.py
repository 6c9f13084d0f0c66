"""Readers for landed files.  Schemas are explicit: nothing is inferred from the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafin.functions.scalar import first_text, safe_double

CONSENSUS_SCHEMA = """
metadata struct<capture_date: string>,
stocks array<struct<symbol: string, company_name: string, portfolio_weight: double, buys_6m: int, hold_price: double,
  current_price: double, low_52w: double, pct_above_52w_low: double, high_52w: double, buys_tier: string>>
"""
# Two export generations of the trade file are accepted side by side.
INSIDER_SCHEMA = """
trades array<struct<symbol: string, ticker: string, company: string, value: double, transaction_type: string>>,
insider_trades array<struct<symbol: string, ticker: string, insider_name: string, role: string, trade_type: string, direction: string,
  change_shares_millions: double, avg_price: double, transaction_value_millions: double, shares_owned_millions: double,
  title: string, trade_date: string, filed_date: string, is_informative: boolean>>
"""
MEMBERS_SCHEMA = "tickers array<string>, symbols array<string>"
INSTITUTIONAL_SCHEMA = """
top_stocks array<struct<rank: int, ticker: string, company_name: string, total_holders: int, medium_stakes: int,
  large_stakes: int, value_owned_billions: double, sector: string>>
"""
PRICE_DOCUMENT_SCHEMA = "meta struct<symbol: string>, values array<struct<datetime: string, close: string>>"
QUOTE_SCHEMA = """
symbol string, close string, percent_change string, volume string, average_volume string,
fifty_two_week struct<high: string, low: string>
"""
PROFILE_SCHEMA = "symbol string, name string, sector string, industry string"
RSI_SCHEMA = "symbol string, values array<struct<datetime: string, rsi: string>>"
STATEMENT_SCHEMA = """
symbol string,
income struct<sales: string, revenue: string, total_revenue: string, net_income: string, net_income_common_stockholders: string,
  gross_profit: string, operating_income: string, operating_income_loss: string, ebit: string, interest_expense: string>,
balance struct<
  assets: struct<total_assets: string, current_assets: struct<total_current_assets: string, current_assets: string,
    cash_and_cash_equivalents: string, cash: string>>,
  liabilities: struct<current_liabilities: struct<total_current_liabilities: string, current_liabilities: string, short_term_debt: string>,
    non_current_liabilities: struct<long_term_debt: string>>,
  shareholders_equity: struct<total_shareholders_equity: string, total_stockholders_equity: string, stockholders_equity: string, total_equity: string>,
  total_assets: string, total_equity: string, total_current_assets: string, total_current_liabilities: string, cash: string>,
cashflow struct<
  operating_activities: struct<operating_cash_flow: string, net_cash_provided_by_operating_activities: string,
    cash_flow_from_operating_activities: string, free_cash_flow: string>,
  investing_activities: struct<capital_expenditures: string, capital_expenditure: string, free_cash_flow: string>,
  free_cash_flow: string>,
statistics struct<shares_outstanding: string, financials: struct<shares_outstanding: string, return_on_equity_ttm: string, return_on_equity: string,
  return_on_assets_ttm: string, return_on_assets: string, current_ratio: string, gross_margin: string, operating_margin: string,
  profit_margin: string, net_margin: string, balance_sheet: struct<current_ratio: string, current_ratio_mrq: string>>>
"""
POSITION_SCHEMA = """
symbol string, company string, sector string, industry string, weight double, score_composite double, score_sm double,
score_insider double, score_momentum double, score_quality double, perf_3m double, perf_ytd double, vol_30d double, gp_buys double,
gp_tier string, insider_buys double, rsi double, price double, td_price double, roe double, roa double, debt_equity double, current_ratio double,
gross_margin double, operating_margin double, net_margin double, capex_ratio double, fcf double, revenue double, net_income double,
score_value double, score_risk double
"""
SNAPSHOT_SCHEMA = f"""
metadata struct<date: string, positions: int, total_weight: double, engine_version: string>,
metrics struct<positions: int, perf_3m: double, perf_ytd: double, vol_30d: double, sector_weights: map<string, double>,
  avg_roe: double, avg_debt_equity: double, avg_net_margin: double>,
portfolio array<struct<{", ".join(f.strip().replace(" ", ": ", 1) for f in POSITION_SCHEMA.replace(chr(10), " ").split(","))}>>
"""


def _json(spark: SparkSession, path: str | Sequence[str], schema: str, lines: bool = False) -> DataFrame:
    """Documents with their file.  ``lines``: one document per line, which Spark can
    split inside a file; otherwise one (pretty-printed) document per file."""
    return spark.read.schema(schema).option("multiLine", not lines).json(path).withColumn("_file", F.input_file_name())


def newest_file(df: DataFrame, by: Sequence[str] = (), stamp: Column | None = None) -> DataFrame:
    """Rows of the newest file per key, by the date in its name, else in its folder's (or ``stamp``)."""
    own, above = (F.nullif(F.regexp_extract("_file", p, 1), F.lit("")) for p in (r"(\d{4}-\d{2}-\d{2})[^/]*$", r"(\d{4}-\d{2}-\d{2})[^/]*/[^/]*$"))
    when = stamp if stamp is not None else F.coalesce(own, above, F.lit(""))
    marked = df.withColumn("_stamp", when)
    newest = marked.groupBy(*by).agg(F.max("_stamp").alias("_stamp"))
    # one row per file and key on the right; the files themselves are never collected
    return marked.join(newest, [*by, "_stamp"], "left_semi").drop("_stamp")


def read_consensus(spark: SparkSession, path, newest: bool = True, lines: bool = False) -> DataFrame:
    """Consensus holdings with the engine's names."""
    docs = _json(spark, path, CONSENSUS_SCHEMA, lines)
    docs = newest_file(docs) if newest else docs
    s = F.col("s")
    zero = F.lit(0.0)
    return docs.select(F.explode("stocks").alias("s")).select(
        s["symbol"].alias("symbol"),
        F.coalesce(s["portfolio_weight"], zero).alias("gp_weight"),
        F.coalesce(s["buys_6m"], F.lit(0)).alias("gp_buys"),
        F.coalesce(s["buys_tier"], F.lit("D")).alias("gp_tier"),
        *[F.coalesce(s[c], zero).alias(c) for c in ("hold_price", "current_price", "low_52w", "high_52w", "pct_above_52w_low")],
        F.coalesce(s["company_name"], F.lit("")).alias("company"),
    )


def read_insider(spark: SparkSession, path, newest: bool = True, lines: bool = False) -> DataFrame:
    """Trades of either export: symbol or ticker, dollar value or millions, type or direction."""
    docs = _json(spark, path, INSIDER_SCHEMA, lines)
    docs = newest_file(docs) if newest else docs
    nothing = F.lit(None).cast("string")
    old = docs.select(F.explode("trades").alias("t")).select(
        first_text("t.symbol", "t.ticker").alias("symbol"),
        F.col("t.company").alias("company"),
        F.coalesce("t.value", F.lit(0.0)).alias("value"),
        F.coalesce("t.transaction_type", F.lit("")).alias("transaction_type"),
        nothing.alias("insider_name"),
        nothing.alias("role"),
        nothing.alias("trade_date"),
    )
    new = docs.select(F.explode("insider_trades").alias("t")).select(
        first_text("t.symbol", "t.ticker").alias("symbol"),
        nothing.alias("company"),
        (F.abs(F.coalesce("t.transaction_value_millions", F.lit(0.0))) * 1e6).alias("value"),
        F.coalesce("t.direction", F.lit("")).alias("transaction_type"),
        "t.insider_name",
        "t.role",
        "t.trade_date",
    )
    return old.unionByName(new).where(F.col("symbol").isNotNull())


def read_members(spark: SparkSession, path, lines: bool = False) -> DataFrame:
    return _json(spark, path, MEMBERS_SCHEMA, lines).select(F.explode(F.coalesce("tickers", "symbols")).alias("symbol")).distinct()


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet, or CSV with a header and an explicit schema."""
    if path.rstrip("/").endswith(".csv") or schema is not None:
        reader = spark.read.option("header", True)
        return (reader.schema(schema) if schema else reader).csv(path)
    return spark.read.parquet(path)


def long_prices(wide: DataFrame, date: str = "date") -> DataFrame:
    """Wide ``date x symbol`` panel to long rows."""
    symbols = [c for c in wide.columns if c != date]
    return (
        wide.withColumnRenamed(date, "date")
        .withColumns({c: F.col(c).cast("double") for c in symbols})
        .unpivot("date", symbols, "symbol", "close")
        .where(F.col("close").isNotNull())
        .select("symbol", F.col("date").cast("date").alias("date"), "close")
    )


def read_symbol_csvs(spark: SparkSession, folder: str) -> DataFrame:
    """A folder of ``<symbol>.csv`` files, or of ``symbol=<symbol>`` folders, with date and close: one
    scan, symbol from the path."""
    rows = spark.read.schema("date string, close string").options(header=True, recursiveFileLookup=True, pathGlobFilter="*.csv").csv(folder)
    path = F.input_file_name()
    named = F.nullif(F.regexp_extract(path, r"/symbol=([^/]+)/", 1), F.lit(""))
    return rows.select(
        F.coalesce(named, F.regexp_extract(path, r"([^/]+)\.csv$", 1)).alias("symbol"),
        F.to_date(F.substring("date", 1, 10)).alias("date"),
        safe_double("close").alias("close"),
    ).where(F.col("close").isNotNull())


def range_coverage(prices: DataFrame, start: str, end: str, slack_days: int = 5) -> DataFrame:
    """Does each symbol's history reach from ``start`` to ``end`` (minus the slack)?"""
    span = prices.groupBy("symbol").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    begin, finish = F.lit(start).cast("date"), F.date_sub(F.lit(end).cast("date"), slack_days)
    return span.withColumn("covered", (F.col("first_date") <= begin) & (F.col("last_date") >= finish))


def read_price_documents(spark: SparkSession, path, lines: bool = False) -> DataFrame:
    """Landed price documents: ``values[].{datetime, close}`` as text."""
    docs = _json(spark, path, PRICE_DOCUMENT_SCHEMA, lines)
    symbol = F.coalesce("meta.symbol", F.regexp_extract("_file", r"([^/]+)\.json$", 1))
    rows = docs.select(symbol.alias("symbol"), F.explode("values").alias("v"))
    return rows.select("symbol", F.to_date(F.substring("v.datetime", 1, 10)).alias("date"), safe_double("v.close").alias("close")).where(
        F.col("close").isNotNull() & F.col("date").isNotNull()
    )


def read_market_documents(spark: SparkSession, quotes, profiles, rsi, lines: bool = False) -> DataFrame:
    """Quotes, profiles and RSI documents flattened with defaults, one row per symbol."""
    q = _json(spark, quotes, QUOTE_SCHEMA, lines)
    p = _json(spark, profiles, PROFILE_SCHEMA, lines)
    r = _json(spark, rsi, RSI_SCHEMA, lines)

    def number(c: str, otherwise: float = 0.0) -> Column:
        return F.coalesce(safe_double(c), F.lit(otherwise))

    quote = q.select(
        "symbol",
        number("close").alias("price"),
        number("percent_change").alias("change_pct"),
        number("volume").alias("volume"),
        number("average_volume").alias("avg_volume"),
        number("fifty_two_week.high").alias("high_52w"),
        number("fifty_two_week.low").alias("low_52w"),
    )
    profile = p.select(
        "symbol",
        F.coalesce(first_text("sector"), F.lit("Unknown")).alias("sector"),
        F.coalesce(first_text("industry"), F.lit("Unknown")).alias("industry"),
        first_text("name").alias("company"),
    )
    # the newest value comes first in these documents
    strength = r.select("symbol", F.coalesce(safe_double(F.try_element_at("values", F.lit(1))["rsi"]), F.lit(50.0)).alias("rsi"))
    joined = quote.join(profile, "symbol", "left").join(strength, "symbol", "left")
    return joined.withColumns(
        {
            "sector": F.coalesce("sector", F.lit("Unknown")),
            "industry": F.coalesce("industry", F.lit("Unknown")),
            "rsi": F.coalesce("rsi", F.lit(50.0)),
        }
    )


def read_statements(spark: SparkSession, path, lines: bool = False) -> DataFrame:
    """Landed statement documents with synonyms resolved to one name each
    (the first synonym that is neither missing, blank nor zero)."""
    docs = _json(spark, path, STATEMENT_SCHEMA, lines)

    def pick(*paths: str) -> Column:
        return F.coalesce(*[F.nullif(safe_double(p), F.lit(0.0)) for p in paths], *[safe_double(p) for p in paths])

    a, l, e = "balance.assets", "balance.liabilities", "balance.shareholders_equity"
    o, i, s = "cashflow.operating_activities", "cashflow.investing_activities", "statistics"
    f = f"{s}.financials"
    return docs.select(
        "symbol",
        pick("income.sales", "income.revenue", "income.total_revenue").alias("revenue"),
        pick("income.net_income", "income.net_income_common_stockholders").alias("net_income"),
        safe_double("income.gross_profit").alias("gross_profit"),
        pick("income.operating_income", "income.operating_income_loss").alias("operating_income"),
        safe_double("income.ebit").alias("ebit"),
        safe_double("income.interest_expense").alias("interest_expense"),
        pick(f"{a}.total_assets", "balance.total_assets").alias("total_assets"),
        pick(f"{e}.total_shareholders_equity", f"{e}.total_stockholders_equity", f"{e}.stockholders_equity", f"{e}.total_equity", "balance.total_equity").alias("equity"),
        pick(f"{a}.current_assets.total_current_assets", f"{a}.current_assets.current_assets", "balance.total_current_assets").alias("current_assets"),
        pick(f"{a}.current_assets.cash_and_cash_equivalents", f"{a}.current_assets.cash", "balance.cash").alias("cash"),
        pick(f"{l}.current_liabilities.total_current_liabilities", f"{l}.current_liabilities.current_liabilities", "balance.total_current_liabilities").alias("current_liabilities"),
        safe_double(f"{l}.current_liabilities.short_term_debt").alias("short_term_debt"),
        safe_double(f"{l}.non_current_liabilities.long_term_debt").alias("long_term_debt"),
        pick(f"{o}.operating_cash_flow", f"{o}.net_cash_provided_by_operating_activities", f"{o}.cash_flow_from_operating_activities").alias("operating_cash_flow"),
        pick(f"{i}.capital_expenditures", f"{i}.capital_expenditure").alias("capex"),
        pick("cashflow.free_cash_flow", f"{o}.free_cash_flow", f"{i}.free_cash_flow").alias("free_cash_flow"),
        pick(f"{s}.shares_outstanding", f"{f}.shares_outstanding").alias("shares_outstanding"),
        pick(f"{f}.return_on_equity_ttm", f"{f}.return_on_equity").alias("stat_roe"),
        pick(f"{f}.return_on_assets_ttm", f"{f}.return_on_assets").alias("stat_roa"),
        pick(f"{f}.current_ratio", f"{f}.balance_sheet.current_ratio", f"{f}.balance_sheet.current_ratio_mrq").alias("stat_current_ratio"),
        safe_double(f"{f}.gross_margin").alias("stat_gross_margin"),
        safe_double(f"{f}.operating_margin").alias("stat_operating_margin"),
        pick(f"{f}.profit_margin", f"{f}.net_margin").alias("stat_net_margin"),
    )


def read_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """All dated portfolio snapshots, one row per position: ``<folder>/<yyyy-mm-dd>/portfolio.json`` or
    the dated store of ``sinks.write_portfolio_json``, ``<folder>/as_of_date=<yyyy-mm-dd>/part-*``.

    Undated folders (such as ``latest``) and empty portfolios fall out.
    """
    docs = _json(spark, f"{folder.rstrip('/')}/*/{{portfolio,part-}}*.json", SNAPSHOT_SCHEMA)
    date = F.regexp_extract("_file", r"[/=](\d{4}-\d{2}-\d{2})/[^/]+$", 1)
    rows = docs.where(date != "").select(date.cast("date").alias("snapshot_date"), F.explode("portfolio").alias("p"))
    out = rows.select("snapshot_date", "p.*")
    return out.withColumn("price", F.coalesce("price", "td_price")).drop("td_price")


def read_fundamentals_cache(spark: SparkSession, path: str, as_of: str | None = None) -> DataFrame:
    """Fundamentals stored per date; a given date prunes to its partition."""
    df = spark.read.parquet(path)
    return df if as_of is None else df.where(F.col("as_of_date") == F.lit(as_of).cast("date"))
