"""Holder and insider signals: aggregation, merging, alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafin.functions.scalar import default_columns, half_even, holds, with_missing
from stratafin.operators.ranking import top_k

#: fixed values: transaction types counted as purchases
BUY_TYPES = ["buy", "p-purchase", "purchase"]
#: fixed values: neutral signal values for a name without signals
SIGNAL_DEFAULTS = {
    "gp_weight": 0.0,
    "gp_buys": 0,
    "gp_tier": "D",
    "hold_price": 0.0,
    "current_price": 0.0,
    "low_52w": 0.0,
    "high_52w": 0.0,
    "pct_above_52w_low": 0.0,
    "insider_buys": 0,
    "insider_sells": 0,
    "insider_net_value": 0.0,
    "sector": "Unknown",
    "industry": "Unknown",
}
_C_SUITE = r"(?i)ceo|cfo|president"
_ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"


def insider_activity(trades: DataFrame, keys: Sequence[str] = ("symbol",), kind: str = "transaction_type", value: str = "value") -> DataFrame:
    """Purchases, other trades and net value per symbol (anything that is no purchase counts as a sale)."""
    buy = F.lower(F.coalesce(F.col(kind), F.lit(""))).isin(BUY_TYPES)
    amount = F.coalesce(F.col(value), F.lit(0.0))
    aggs = [
        F.count_if(buy).cast("int").alias("insider_buys"),
        F.count_if(~buy).cast("int").alias("insider_sells"),
        F.sum(F.when(buy, amount).otherwise(-amount)).alias("insider_net_value"),
    ]
    if "company" in trades.columns:
        aggs.append(F.max("company").alias("company"))
    return trades.where(F.col(keys[-1]) != "").groupBy(*keys).agg(*aggs)


def merge_signals(holdings: DataFrame, insider: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Full outer merge; an insider record overrides the company name."""
    insider = with_missing(insider, {"company": "string"}).withColumnRenamed("company", "_insider_company")
    joined = with_missing(holdings, {"company": "string"}).join(insider, list(keys), "full_outer")
    return joined.withColumn("company", F.coalesce("_insider_company", "company")).drop("_insider_company")


def build_universe(signals: DataFrame, members: DataFrame | None = None, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Index members with signals attached, or the signals alone, with neutral defaults."""
    if members is None:
        return default_columns(signals, SIGNAL_DEFAULTS)
    joined = members.select(*keys).distinct().join(signals, list(keys), "left")
    return default_columns(joined, {**SIGNAL_DEFAULTS, "company": ""})


# --- trade views ------------------------------------------------------------------------


def is_c_suite(role: str | Column = "role") -> Column:
    c = F.col(role) if isinstance(role, str) else role
    return holds(c.rlike(_C_SUITE))


def trade_view(trades: DataFrame, view: str, large_millions: float = 5.0) -> DataFrame:
    """``sells``, ``buys``, ``c_suite`` or ``large`` trades."""
    predicates = {
        "sells": F.col("direction") == "Sell",
        "buys": F.col("direction") == "Buy",
        "c_suite": is_c_suite(),
        "large": F.abs("transaction_value_millions") >= large_millions,
    }
    return trades.where(predicates[view])


def insider_ticker_summary(trades: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per ticker: trade counts, values, net flow, distinct insiders, executive activity."""
    amount = F.abs("transaction_value_millions")
    sell, buy = F.col("direction") == "Sell", F.col("direction") == "Buy"
    return (
        trades.groupBy(*by, "ticker")
        .agg(
            F.count_if(sell).alias("sell_count"),
            F.count_if(buy).alias("buy_count"),
            F.coalesce(F.sum(F.when(sell, amount)), F.lit(0.0)).alias("sell_value_millions"),
            F.coalesce(F.sum(F.when(buy, amount)), F.lit(0.0)).alias("buy_value_millions"),
            F.countDistinct("insider_name").alias("insider_count"),
            F.max(is_c_suite()).alias("has_c_suite"),
        )
        .withColumn("net_value_millions", F.col("buy_value_millions") - F.col("sell_value_millions"))
    )


def insider_totals(trades: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Global (or per ``by``) trade summary with the sell/buy ratio (NULL without purchases)."""
    amount = F.abs("transaction_value_millions")
    sell, buy = F.col("direction") == "Sell", F.col("direction") == "Buy"
    valid_date = F.when(F.col("trade_date").cast("string").rlike(_ISO_DATE), F.col("trade_date").cast("string"))
    return (
        trades.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("total_trades"),
            F.count_if(sell).alias("total_sells"),
            F.count_if(buy).alias("total_buys"),
            F.coalesce(F.sum(F.when(sell, amount)), F.lit(0.0)).alias("total_sell_value"),
            F.coalesce(F.sum(F.when(buy, amount)), F.lit(0.0)).alias("total_buy_value"),
            F.countDistinct("ticker").alias("unique_tickers"),
            F.countDistinct("insider_name").alias("unique_insiders"),
            F.min(valid_date).alias("first_trade"),
            F.max(valid_date).alias("last_trade"),
        )
        .withColumns(
            {
                "net_flow": F.col("total_buy_value") - F.col("total_sell_value"),
                "sell_buy_ratio": half_even(F.col("total_sells") / F.nullif(F.col("total_buys"), F.lit(0)), 2),
            }
        )
    )


def net_leaders(summary: DataFrame, side: str, n: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Largest net buyers or net sellers."""
    sign = F.col("net_value_millions") > 0 if side == "buyers" else F.col("net_value_millions") < 0
    order = F.col("net_value_millions").desc() if side == "buyers" else F.col("net_value_millions").asc()
    keyed = summary.where(sign)
    if by:
        return top_k(keyed, by, [order, F.col("ticker")], n)
    return keyed.orderBy(order, "ticker").limit(n)


def insider_alerts(
    trades: DataFrame, cluster_insiders: int = 3, cluster_sells: int = 3, large_millions: float = 10.0
) -> DataFrame:
    """One row per alert: cluster sales, executive buys/sales, very large trades, market-wide ratio."""
    summary = insider_ticker_summary(trades)
    none = F.lit(None).cast("double")
    clusters = summary.where((F.col("insider_count") >= cluster_insiders) & (F.col("sell_count") >= cluster_sells)).select(
        F.lit("danger").alias("type"), F.lit("cluster_sells").alias("alert"), "ticker", F.col("sell_value_millions").alias("value")
    )
    executives = (
        trades.where(is_c_suite() & F.col("direction").isin("Buy", "Sell"))
        .groupBy("ticker", "direction")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            F.when(F.col("direction") == "Buy", "success").otherwise("warning").alias("type"),
            F.when(F.col("direction") == "Buy", "c_suite_buy").otherwise("c_suite_sell").alias("alert"),
            "ticker",
            F.col("n").cast("double").alias("value"),
        )
    )
    large = trades.where(F.abs("transaction_value_millions") >= large_millions).select(
        F.when(F.col("direction") == "Buy", "success").otherwise("warning").alias("type"),
        F.lit("large_trade").alias("alert"),
        "ticker",
        F.abs("transaction_value_millions").alias("value"),
    )
    ratio = F.col("sell_buy_ratio")
    market = (
        insider_totals(trades)
        .where((ratio > 5) | ((ratio < 0.5) & (F.col("total_buys") > 5)))
        .select(
            F.when(ratio > 5, "danger").otherwise("success").alias("type"),
            F.when(ratio > 5, "high_sell_buy_ratio").otherwise("low_sell_buy_ratio").alias("alert"),
            F.lit("MARKET").alias("ticker"),
            F.coalesce(ratio, none).alias("value"),
        )
    )
    return clusters.unionByName(executives).unionByName(large).unionByName(market)
