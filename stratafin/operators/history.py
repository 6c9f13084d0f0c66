"""Per-symbol history features over annual panels (one row per symbol and year)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def five_year_features(
    df: DataFrame,
    by: Sequence[str] = (),
    symbol: str = "symbol",
    year: str = "year",
    averages: dict[str, str] | None = None,
    spreads: dict[str, str] | None = None,
    years: int = 5,
) -> DataFrame:
    """Trailing means and standard deviations over the last ``years`` annual rows.

    One window per symbol, bounded by the number of fiscal years.
    """
    averages = averages or {
        "roe_avg": "roe",
        "roic_avg": "roic",
        "margin_avg": "operating_margin",
        "pe_5y_avg": "pe_ratio",
        "fcf_yield_5y_avg": "fcf_yield",
    }
    spreads = spreads or {"roe_std": "roe", "margin_std": "operating_margin"}
    w = Window.partitionBy(*by, symbol).orderBy(year).rowsBetween(1 - years, 0)
    cols = {out: F.avg(src).over(w) for out, src in averages.items() if src in df.columns}
    cols |= {out: F.stddev_samp(src).over(w) for out, src in spreads.items() if src in df.columns}
    return df.withColumns(cols)


def history_arrays(df: DataFrame, series: dict[str, str], by: Sequence[str] = (), symbol: str = "symbol", year: str = "year") -> DataFrame:
    """Per-row arrays of the series up to and including the row's year, oldest first."""
    w = Window.partitionBy(*by, symbol).orderBy(year).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({out: F.collect_list(F.col(src)).over(w) for out, src in series.items()})


def track_record(df: DataFrame, by: Sequence[str] = (), symbol: str = "symbol", year: str = "year", income: str = "net_income") -> DataFrame:
    """Years of data and number of loss years up to each row's year."""
    w = Window.partitionBy(*by, symbol).orderBy(year).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns(
        {
            "years_of_data": F.count(F.lit(1)).over(w).cast("int"),
            "loss_years_count": F.sum(F.when(F.col(income) < 0, 1).otherwise(0)).over(w).cast("int"),
        }
    )


def track_record_totals(df: DataFrame, keys: Sequence[str] = ("symbol",), income: str = "net_income") -> DataFrame:
    """One row per symbol: years of data and loss years over the whole panel."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("int").alias("years_of_data"),
        F.count_if(F.col(income) < 0).cast("int").alias("loss_years_count"),
    )
