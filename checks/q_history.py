"""Scores on price history and on missing history, and fiscal years that end in any month."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.derive import raw, table, with_inputs
from checks.q_scores30 import HIST_SQL, PARTS_SQL, RANKS_SQL, RATIO_SQL, UNIVERSE, history_table
from checks.q_series import DRAW
from checks.registry import clip, even, pct, query, rnd
from stratafin.operators import scores_v30, series
from stratafin.params import Publication
from stratafin.plans import calendar

PRICED = {k: v.replace("npx", "px") for k, v in DRAW.items()}

FALLS = f"coalesce(1 - {clip('abs(mdd)', 0, 0.6)} / 0.6, 0.5) * (0.20 / 0.30) + coalesce(1 - {clip('rec', 0, 24)} / 24, 0.5) * (0.10 / 0.30)"
RISK = f"0.50 * r1 + 0.30 * {clip(FALLS, 0, 1)} + 0.20 * coalesce(1 - {clip('vol', 0, 0.6)} / 0.6, 0.5)"


@query(
    "risk_on_prices_v30",
    with_inputs(
        "fin",
        "px",
        extra={
            "rat": RATIO_SQL,
            "hist": HIST_SQL,
            "rk": RANKS_SQL,
            "parts": PARTS_SQL,
            **PRICED,
            "vo": "select symbol, year(date) as y, round(stddev_samp(r), 6) as vol from (select symbol, date, close / nullif(lag(close) over (partition by symbol order by date), 0) - 1 as r from px) z group by 1, 2",
            "in_": "select p.*, round(d.max_dd, 6) as mdd, round(d.recovery, 4) as rec, vo.vol from parts p left join draw d on d.symbol = p.symbol and d.as_of_date = p.as_of_date left join vo on vo.symbol = p.symbol and vo.y = p.year",
        },
    )
    + f""" select symbol, as_of_date, {even(RISK, 3)} as score_risk_v30, mdd as max_drawdown_5y, rec as dd_recovery_months, vol as volatility_annual from in_""",
    "C19 W20",
)
def _risk_on_prices(spark, sf):
    px, universe = table(spark, sf, "px"), history_table(spark, sf)
    falls = series.five_year_drawdown(px, universe.select("as_of_date"))
    falls = falls.withColumns({"max_drawdown_5y": F.round("max_drawdown_5y", 6), "dd_recovery_months": F.round("dd_recovery_months", 4)})
    step = F.col("close") / F.nullif(F.lag("close").over(Window.partitionBy("symbol").orderBy("date")), F.lit(0.0)) - 1
    calm = px.withColumn("ret", step).groupBy("symbol", F.year("date").alias("year")).agg(F.round(F.stddev_samp("ret"), 6).alias("volatility_annual"))
    scored = scores_v30.score_risk_v30(universe.join(falls, ["symbol", "as_of_date"], "left").join(calm, ["symbol", "year"], "left"))
    return scored.select("symbol", "as_of_date", "score_risk_v30", "max_drawdown_5y", "dd_recovery_months", "volatility_annual")


MEDIANS = f"""
select h.*, case when known > 0 then (nullif(pe_past, 0) - pe_ratio) / abs(nullif(pe_past, 0)) else (med - pe_ratio) / nullif(med, 0) end as disc0
from (select *, count(pe_past) over (partition by {UNIVERSE}) as known, median(pe_ratio) over (partition by {UNIVERSE}) as med
  from (select *, case when year % 2 = 0 then pe_5y_avg end as pe_past from hist) a) h
"""


@query(
    "value_without_history",
    with_inputs("fin", extra={"rat": RATIO_SQL, "hist": HIST_SQL, "me": MEDIANS, "d": "select *, coalesce(disc0, 0) as disc, coalesce((fcf_yield - nullif(fcf_yield_5y_avg, 0)) / abs(nullif(fcf_yield_5y_avg, 0)), 0) as prem from me"})
    + f" select symbol, year, {rnd('0.5 * ' + pct('disc', UNIVERSE) + ' + 0.5 * ' + pct('prem', UNIVERSE))} as value_margin_of_safety from d",
    "C18",
)
def _value_without_history(spark, sf):
    rows = history_table(spark, sf).withColumn("pe_5y_avg", F.when(F.col("year") % 2 == 0, F.col("pe_5y_avg")))
    return scores_v30.score_value_v30(rows).select("symbol", "year", F.round("value_margin_of_safety", 6).alias("value_margin_of_safety"))


def _fiscal_sql(month: int) -> str:
    return f"(select max(y) from unnest(range(year(date) - 4, year(date) + 1)) t(y) where last_day(make_date(y::int, {month}, 1)) + 60 <= date)::int"


@query(
    "fiscal_month_ends",
    "with d as (select distinct cast(l_shipdate as date) as date from lineitem) select date, "
    + ", ".join(f"{_fiscal_sql(m)} as fiscal_year_{m}, last_day(make_date(year(date)::int, {m}, 1)) + 60 as published_{m}" for m in (2, 6, 12))
    + " from d",
    "F14 F12",
)
def _fiscal_months(spark, sf):
    days = raw(spark, sf, "lineitem").select(F.col("l_shipdate").cast("date").alias("date")).distinct()
    for m in (2, 6, 12):
        p = Publication(fiscal_month=m, fiscal_day=31, lag_days=60)
        days = days.withColumns({f"fiscal_year_{m}": calendar.latest_available_year("date", p), f"published_{m}": calendar.publication_date(F.year("date"), p)})
    return days


@query(
    "quarter_calendar",
    """with q as (select unnest(generate_series(date_trunc('quarter', min(l_shipdate)), max(l_shipdate), interval 3 month))::date as date, min(l_shipdate)::date as lo from lineitem),
      s as (select date from q where date >= lo) select * from (select date as start, lead(date) over (order by date) as "end" from s) z where "end" is not null""",
    "B13",
)
def _quarter_calendar(spark, sf):
    low, high = raw(spark, sf, "lineitem").agg(F.min("l_shipdate").cast("date").cast("string"), F.max("l_shipdate").cast("date").cast("string")).first()
    return calendar.periods_between(calendar.quarter_starts(spark, low, high))
