"""Rebalance calendars and publication dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafin.params import Publication


def rebalance_dates(days: DataFrame, frequency: str = "Q", mode: str = "calendar") -> DataFrame:
    """Rebalance days among the traded ones.

    ``calendar``: the day must be the calendar quarter or month end (a quarter
    that ends on a day without trading has none); ``last_trading_day``: the last
    traded day of the period.  ``W`` takes Fridays.
    """
    traded = days.select(F.col("date").cast("date").alias("date")).distinct()
    if frequency == "W":
        return traded.where(F.dayofweek("date") == 6)
    if frequency not in ("Q", "M"):
        raise ValueError(f"unknown frequency {frequency!r}")
    if mode == "last_trading_day":
        unit = "quarter" if frequency == "Q" else "month"
        return traded.groupBy(F.trunc("date", unit).alias("_p")).agg(F.max("date").alias("date")).select("date")
    if mode != "calendar":
        raise ValueError(f"unknown mode {mode!r}")
    month_end = F.col("date") == F.last_day("date")
    if frequency == "Q":
        month_end = month_end & (F.month("date") % 3 == 0)
    return traded.where(month_end)


def quarter_starts(spark: SparkSession, start: str, end: str) -> DataFrame:
    """First days of the quarters inside [start, end]."""
    dates = F.sequence(
        F.trunc(F.lit(start).cast("date"), "quarter"), F.lit(end).cast("date"), F.expr("interval 3 months")
    )
    return spark.range(1).select(F.explode(dates).alias("date")).where(F.col("date") >= F.lit(start).cast("date"))


def periods_between(instants: DataFrame) -> DataFrame:
    """Consecutive instants as periods ``start, end`` (bounded by the calendar)."""
    ordered = F.array_sort(F.collect_set("date"))
    return (
        instants.agg(ordered.alias("_d"))
        .select(F.explode(F.arrays_zip(F.slice("_d", 1, F.size("_d") - 1).alias("start"), F.slice("_d", 2, F.size("_d") - 1).alias("end"))).alias("p"))
        .select("p.*")
    )


def fiscal_end(year: Column, p: Publication = Publication()) -> Column:
    """Last day of a fiscal year: ``fiscal_day`` of its month, or the month's last day if that is earlier."""
    first = F.make_date(year.cast("int"), F.lit(p.fiscal_month), F.lit(1))
    return F.least(F.date_add(first, p.fiscal_day - 1), F.last_day(first))


def publication_date(year: str | Column = "year", p: Publication = Publication()) -> Column:
    y = F.col(year) if isinstance(year, str) else year
    return F.date_add(fiscal_end(y, p), p.lag_days)


def available_from(year: str | Column = "year", p: Publication = Publication()) -> Column:
    """First as-of date at which a fiscal year may be used (the lag counts twice by default)."""
    published = publication_date(year, p)
    return F.date_add(published, p.lag_days) if p.double_lag else published


def point_in_time(fundamentals: DataFrame, as_of: str | Column, p: Publication = Publication()) -> DataFrame:
    """Rows whose fiscal year may be known at ``as_of`` (a date or a date column)."""
    at = F.lit(as_of).cast("date") if isinstance(as_of, str) and as_of not in fundamentals.columns else F.col(as_of) if isinstance(as_of, str) else as_of
    return fundamentals.where(available_from("year", p) <= at)


def look_ahead_check(fundamentals: DataFrame, as_of: str, p: Publication = Publication()) -> DataFrame:
    """Latest fiscal year in the data, its publication date, and whether it was public at ``as_of``."""
    latest = fundamentals.agg(F.max("year").alias("last_year"))
    cutoff = F.date_sub(F.lit(as_of).cast("date"), p.lag_days)
    published = publication_date("last_year", p)
    return latest.select("last_year", published.alias("published"), (published <= cutoff).alias("no_look_ahead"))


def latest_available_year(as_of: str | Column, p: Publication = Publication()) -> Column:
    """Latest fiscal year published at the date (single lag; two years back when none of five fits)."""
    at = F.col(as_of) if isinstance(as_of, str) else as_of
    years = F.sequence(F.year(at) - 4, F.year(at))
    public = F.filter(years, lambda y: publication_date(y, p) <= at)
    return F.coalesce(F.array_max(public), F.year(at) - 2)
