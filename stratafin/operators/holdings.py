"""Consensus, institutional and fund holdings: validation and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafin.functions.scalar import half_even, ladder_at_least
from stratafin.operators.joins import with_totals
from stratafin.operators.ranking import top_k
from stratafin.params import TIER_FLOORS
from stratafin.session import stage


def tier(buys: str | Column) -> Column:
    return ladder_at_least(buys, TIER_FLOORS, "D", missing="D")


def consensus_checks(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Six batch checks as rows ``check, passed, detail`` from one aggregation."""
    facts = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.length("symbol") >= 1).alias("symbols"),
        F.count_if(F.length("company_name") > 2).alias("names"),
        F.sum("portfolio_weight").alias("weight"),
        F.count_if(F.col("buys_6m") >= 1).alias("buys"),
        F.count_if(F.col("current_price") > 0).alias("prices"),
    )
    n = F.col("n")

    def row(name, passed, detail):
        return F.struct(F.lit(name).alias("check"), F.coalesce(passed, F.lit(False)).alias("passed"), detail.cast("double").alias("detail"))

    rows = F.array(
        row("minimum_rows", n >= 5, n),
        row("symbols", F.col("symbols") == n, F.col("symbols")),
        row("company_names", F.col("names") == n, F.col("names")),
        row("weights", (F.col("weight") > 0.1) & (F.col("weight") < 5), F.col("weight")),
        row("buys", F.col("buys") == n, F.col("buys")),
        row("prices", F.col("prices") == n, F.col("prices")),
    )
    return facts.select(*by, F.explode(rows).alias("r")).select(*by, "r.*")


def consensus_summary(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_stocks"),
        F.count_if(F.col("buys_tier") == "A").alias("tier_a"),
        F.count_if(F.col("buys_tier") == "B").alias("tier_b"),
        F.min("buys_6m").alias("min_buys"),
        F.max("buys_6m").alias("max_buys"),
        half_even(F.avg("buys_6m"), 2).alias("avg_buys"),
    )


def sector_distribution(df: DataFrame, by: Sequence[str] = (), key: str = "sector") -> DataFrame:
    """Row counts per sector with their share of all rows.

    The per-sector counts are folded first; the share divides by their sum.
    """
    counts = df.groupBy(*by, key).agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy(*by).agg(F.sum("n").alias("_total"))
    joined = with_totals(counts, total, by, ["_total"])
    return joined.withColumn("pct", half_even(F.col("n") * 100.0 / F.col("_total"), 1)).drop("_total")


def institutional_summary(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Total value, large stakes, average holders and the most frequent sector."""
    per_sector = df.groupBy(*by, "sector").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("value_owned_billions").alias("value"),
        F.sum("large_stakes").alias("large"),
        F.sum("total_holders").alias("holders"),
    )
    return per_sector.groupBy(*by).agg(
        F.sum("n").alias("total_stocks"),
        half_even(F.sum("value"), 2).alias("total_value_billions"),
        F.sum("large").alias("total_large_stakes"),
        F.floor(F.sum("holders") / F.sum("n") + 0.5).alias("avg_holders"),
        # most rows first, then name
        F.min(F.struct((-F.col("n")).alias("k"), F.col("sector").alias("v")))["v"].alias("top_sector"),
    )


def top_by(df: DataFrame, column: str, n: int = 10, tie: str = "ticker", by: Sequence[str] = ()) -> DataFrame:
    """First ``n`` rows by one column (global: a distributed top-k, no full sort)."""
    if by:
        return top_k(df, by, [F.col(column).desc(), F.col(tie)], n)
    return df.orderBy(F.col(column).desc(), F.col(tie)).limit(n)


def prepare_fund_rows(df: DataFrame) -> DataFrame:
    """Fund slug, default holding date, blank funds and tickers dropped."""
    return (
        df.where((F.trim("fund_name") != "") & (F.trim("ticker") != ""))
        .withColumn("fund_id", F.regexp_replace(F.lower(F.trim("fund_name")), r"\s+", "-"))
        .withColumn("date", F.coalesce(F.nullif(F.trim("date"), F.lit("")), F.col("capture_date")))
    )


def most_held(df: DataFrame, by: Sequence[str] = (), fund: str = "fund_id", ticker: str = "ticker") -> DataFrame:
    """Holders per ticker and their share of all funds."""
    holders = df.groupBy(*by, ticker).agg(F.countDistinct(fund).alias("holders"))
    funds = df.groupBy(*by).agg(F.countDistinct(fund).alias("_funds"))
    joined = with_totals(holders, funds, by, ["_funds"])
    return joined.withColumn("pct_of_funds", half_even(F.col("holders") * 100.0 / F.col("_funds"), 1)).drop("_funds")


def holdings_by_sector(df: DataFrame, by: Sequence[str] = (), fund: str = "fund_id", per_fund: int = 30) -> DataFrame:
    """Positions per sector as a share of (funds x positions per fund)."""
    counts = df.groupBy(*by, "sector").agg(F.count(F.lit(1)).alias("positions"))
    funds = df.groupBy(*by).agg(F.countDistinct(fund).alias("_funds"))
    joined = with_totals(counts, funds, by, ["_funds"])
    return joined.withColumn("pct", half_even(F.col("positions") * 100.0 / (F.col("_funds") * per_fund), 1)).drop("_funds")


def fund_stats(funds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return funds.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_funds"),
        F.sum("total_holdings").alias("total_holdings"),
        half_even(F.avg("performance_3y"), 2).alias("avg_performance"),
        half_even(F.sum("aum_billions"), 2).alias("total_aum_billions"),
    )


def consensus_from_funds(df: DataFrame, by: Sequence[str], fund: str = "fund", symbol: str = "symbol", value: str = "value") -> DataFrame:
    """Per symbol and date: number of holding funds, mean weight inside the funds, and total value.

    Rows are folded to one per fund and symbol first (map-side combined, stored
    once); fund totals and weights then come from that table.
    """
    held = stage(df.groupBy(*by, fund, symbol).agg(F.sum(value).alias("_v")))
    totals = held.groupBy(*by, fund).agg(F.sum("_v").alias("_total"))
    weighted = held.join(totals, [*by, fund]).withColumn("_w", F.col("_v") / F.nullif(F.col("_total"), F.lit(0.0)))
    return weighted.groupBy(*by, symbol).agg(
        F.count(F.lit(1)).alias("nb_hedge_funds"), F.avg("_w").alias("avg_hf_weight"), F.sum("_v").alias("total_value")
    )
