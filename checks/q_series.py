"""Price-series windows, calendars, point-in-time joins and return metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.derive import raw, table, with_inputs
from checks.registry import even, pct, query, rnd
from stratafin.operators import joins, series
from stratafin.params import Publication, StressWindow
from stratafin.plans import calendar, metrics, stress
from stratafin.session import stage

W = "partition by symbol order by date"


def _round(df, cols, d=6):
    return df.withColumns({c: F.round(c, d) for c in cols})


@query(
    "simple_returns",
    with_inputs("px") + f" select symbol, date, {rnd(f'close / nullif(lag(close) over ({W}), 0) - 1')} as ret from px",
    "W5",
)
def _returns(spark, sf):
    return _round(series.simple_returns(table(spark, sf, "px")).select("symbol", "date", "ret"), ["ret"])


@query(
    "padded_returns",
    with_inputs("npx", extra={"l": f"select symbol, date, close, coalesce(lead(date) over ({W}) - 1, date) as upto from npx",
      "f": "select l.symbol, d.date, l.close from l join (select distinct date from npx) d on d.date between l.date and l.upto"})
    + f" select symbol, date, {rnd(f'close / nullif(lag(close) over ({W}), 0) - 1')} as ret from f",
    "W5",
)
def _padded(spark, sf):
    out = series.simple_returns(table(spark, sf, "npx"), gap="pad").select("symbol", "date", "ret")
    return _round(out, ["ret"])


RET = {"r": f"select *, close / nullif(lag(close) over ({W}), 0) - 1 as ret from npx"}
CUM = {**RET, "c": f"select *, product(1 + coalesce(ret, 0)) over ({W} rows between unbounded preceding and current row) as growth from r",
       "p": f"select *, max(growth) over ({W} rows between unbounded preceding and current row) as peak from c"}


@query(
    "cumulative_and_drawdown",
    with_inputs("npx", extra=CUM) + f" select symbol, date, {rnd('growth')} as growth, {rnd('peak')} as peak, {rnd('growth / peak - 1')} as drawdown from p",
    "W6 W7",
)
def _cumulative(spark, sf):
    out = series.cumulative(series.simple_returns(table(spark, sf, "npx")), ["symbol"])
    return _round(out.select("symbol", "date", "growth", "peak", "drawdown"), ["growth", "peak", "drawdown"])


@query(
    "rolling_volatility",
    with_inputs("npx", extra=RET)
    + f" select symbol, date, {rnd('case when count(ret) over w = 30 then stddev_samp(ret) over w * sqrt(252.0) * 100 end', 4)} as rolling_vol from r window w as ({W} rows between 29 preceding and current row)",
    "W8",
)
def _vol(spark, sf):
    out = series.rolling_volatility(series.simple_returns(table(spark, sf, "npx")))
    return _round(out.select("symbol", "date", "rolling_vol"), ["rolling_vol"], 4)


def features_sql(source, back, nret, pop, ytd_ok):
    std = "stddev_pop" if pop else "stddev_samp"
    return {
        "f0": f"""select *, close / nullif(lag(close) over ({W}), 0) - 1 as ret, close - lag(close) over ({W}) as step, count(*) over ({W} rows between unbounded preceding and current row) as n,
          lag(close, {back}) over ({W}) as base, max(close) over ({W} rows between 251 preceding and current row) as hi, min(close) over ({W} rows between 251 preceding and current row) as lo,
          first_value(close) over (partition by symbol, year(date) order by date) as yo, count(*) over (partition by symbol, year(date) order by date rows between unbounded preceding and current row) as yn from {source}""",
        "f1": f"""select *, avg(greatest(coalesce(step, 0), 0)) over ({W} rows between 13 preceding and current row) as gain, avg(greatest(-coalesce(step, 0), 0)) over ({W} rows between 13 preceding and current row) as loss,
          {std}(ret) over ({W} rows between {nret - 1} preceding and current row) as sd from f0""",
        "f2": f"""select symbol, date, close, n::int as n_prices, hi as high_52w, lo as low_52w, {even('(close / nullif(base, 0) - 1) * 100', 2)} as perf_3m,
          case when {ytd_ok} then {even('(close / nullif(yo, 0) - 1) * 100', 2)} end as perf_ytd, case when n >= 30 then {even('sd * (sqrt(252.0) * 100)', 2)} end as vol_30d,
          case when n >= 15 then {even('100 - 100 / (1 + case when loss = 0 then 100.0 else gain / nullif(loss, 0) end)', 1)} else 50.0 end as rsi from f1""",
    }


HISTORY = features_sql("px", 62, 30, False, "yn > 1")
FEATURES = "symbol, date, n_prices, round(high_52w, 6) as high_52w, round(low_52w, 6) as low_52w, perf_3m, perf_ytd, vol_30d, rsi"


def _features(spark, sf, mode):
    out = series.price_features(table(spark, sf, "px"), mode=mode)
    out = out.select("symbol", "date", "n_prices", "high_52w", "low_52w", "perf_3m", "perf_ytd", "vol_30d", "rsi")
    return _round(out, ["high_52w", "low_52w"])


@query("price_features_history", with_inputs("px", extra=HISTORY) + f" select {FEATURES} from f2", "W9 W10 W11 W12 W13 W15")
def _features_history(spark, sf):
    return _features(spark, sf, "history")


@query(
    "price_features_live",
    with_inputs("px", extra=features_sql("px", 63, 29, True, "yo <> close")) + f" select {FEATURES} from f2",
    "W11 W12 W13",
)
def _features_live(spark, sf):
    return _features(spark, sf, "live")


@query(
    "latest_features_as_of",
    with_inputs("px", extra={**{k: v.replace("from px", "from px where date <= date '1999-06-30'") for k, v in HISTORY.items()},
       "l": "select *, row_number() over (partition by symbol order by date desc) as rn from f2 where n_prices >= 30"})
    + " select symbol, date, n_prices, perf_3m, vol_30d, rsi from l where rn = 1",
    "W14 W15 F19",
)
def _latest(spark, sf):
    out = series.latest_features(table(spark, sf, "px"), "1999-06-30")
    return out.select("symbol", "date", "n_prices", "perf_3m", "vol_30d", "rsi")


DRAW = {
    "ao": "select distinct last_day(make_date(year(date), 12, 1)) as as_of_date from npx",
    "dw": "select symbol, as_of_date, date, close, max(close) over (partition by symbol, as_of_date order by date) as pk from npx join ao on date <= as_of_date and date > as_of_date - interval 60 month",
    "dd": "select *, close / nullif(pk, 0) - 1 as dd, case when close = pk then date end as top from dw",
    "d5": """select *, last_value(top ignore nulls) over (partition by symbol, as_of_date order by date rows between unbounded preceding and current row) as fr,
      first_value(top ignore nulls) over (partition by symbol, as_of_date order by date rows between current row and unbounded following) as too, max(date) over (partition by symbol, as_of_date) as ld from dd where dd is not null""",
    "d6": "select *, row_number() over (partition by symbol, as_of_date order by dd, date) as rn from d5",
    "draw": "select symbol, as_of_date, dd as max_dd, case when dd < 0 then date_diff('day', fr, coalesce(too, ld)) / 30.4375 else 0.0 end as recovery from d6 where rn = 1",
}


def yearly_drawdowns(spark, sf):
    npx = table(spark, sf, "npx")
    return series.five_year_drawdown(npx, npx.select(F.last_day(F.make_date(F.year("date"), F.lit(12), F.lit(1))).alias("as_of_date")))


@query(
    "five_year_drawdown",
    with_inputs("npx", extra=DRAW) + f" select symbol, as_of_date, {rnd('max_dd')} as max_drawdown_5y, {rnd('recovery', 4)} as dd_recovery_months from draw",
    "W20",
)
def _five(spark, sf):
    return yearly_drawdowns(spark, sf).withColumns({"max_drawdown_5y": F.round("max_drawdown_5y", 6), "dd_recovery_months": F.round("dd_recovery_months", 4)})


# --- calendars ----------------------------------------------------------------------------------


@query(
    "rebalance_dates",
    """with d as (select distinct cast(l_shipdate as date) as date from lineitem) select 'Q' as frequency, date from d where date = last_day(date) and month(date) % 3 = 0
      union all select 'M', date from d where date = last_day(date) union all select 'W', date from d where isodow(date) = 5
      union all select 'Q_last', max(date) from d group by year(date), quarter(date)""",
    "B12",
)
def _rebalance(spark, sf):
    days = raw(spark, sf, "lineitem").select(F.col("l_shipdate").cast("date").alias("date"))
    parts = [
        calendar.rebalance_dates(days, f, m).select(F.lit(n).alias("frequency"), "date")
        for n, f, m in (("Q", "Q", "calendar"), ("M", "M", "calendar"), ("W", "W", "calendar"), ("Q_last", "Q", "last_trading_day"))
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def quarter_instants(spark, sf):
    """Quarter starts spanned by the order dates in the data."""
    span = raw(spark, sf, "lineitem").agg(
        F.min("l_shipdate").cast("date").alias("a"), F.max("l_shipdate").cast("date").alias("b")
    )
    return span.select(
        F.explode(F.sequence(F.trunc("a", "quarter"), F.col("b"), F.expr("interval 3 months"))).alias("date")
    )


QI = "select unnest(generate_series(date_trunc('quarter', min(l_shipdate)), max(l_shipdate), interval 3 month))::date as date from lineitem"
QSTARTS = {"qa": QI, "qi": "select date from qa",
           "per": "select * from (select date as start, lead(date) over (order by date) as \"end\" from qi) z where \"end\" is not null"}


@query(
    "quarter_periods",
    with_inputs("bench", extra=QSTARTS) + ' select start, "end" from per',
    "B13",
)
def _quarters(spark, sf):
    return calendar.periods_between(quarter_instants(spark, sf))


# --- publication dates --------------------------------------------------------------------------------


@query(
    "point_in_time_filter",
    with_inputs("fin") + """ select symbol, year from fin where make_date(year, 12, 31) + 60 <= date '1999-03-15' - 60""",
    "F12",
)
def _pit(spark, sf):
    return calendar.point_in_time(table(spark, sf, "fin"), "1999-03-15").select("symbol", "year")


@query(
    "look_ahead_check",
    with_inputs("fin") + " select max(year) as last_year, make_date(max(year), 12, 31) + 60 as published, make_date(max(year), 12, 31) + 60 <= date '2002-06-30' - 60 as no_look_ahead from fin",
    "F13",
)
def _look_ahead(spark, sf):
    return calendar.look_ahead_check(table(spark, sf, "fin"), "2002-06-30")


@query(
    "latest_available_year",
    """with d as (select distinct cast(l_shipdate as date) as date from lineitem) select date, (select max(y) from unnest(range(year(date) - 4, year(date) + 1)) t(y) where make_date(y::int, 12, 31) + 60 <= date)::int as fiscal_year from d""",
    "F14",
)
def _latest_year(spark, sf):
    days = raw(spark, sf, "lineitem").select(F.col("l_shipdate").cast("date").alias("date")).distinct()
    return days.select("date", calendar.latest_available_year("date").alias("fiscal_year"))


# --- as-of joins --------------------------------------------------------------------------------------


@query(
    "as_of_price",
    with_inputs("px", "hold", extra={"pr": "select distinct symbol, as_of_date as date from hold",
      "a": "select pr.symbol, pr.date, p.close, p.date as price_date from pr asof left join px p on pr.symbol = p.symbol and pr.date >= p.date"})
    + " select symbol, date, close, price_date from a",
    "J4",
)
def _as_of(spark, sf):
    probes = table(spark, sf, "hold").select("symbol", F.col("as_of_date").alias("date")).distinct()
    out = joins.as_of(probes, table(spark, sf, "px").select("symbol", "date", "close"), ["symbol"], "date", "date", ["close"], fact_date_out="price_date")
    return out.select("symbol", "date", "close", "price_date")


PIT_SQL = {
    "g": "select symbol, year, case when year % 2 = 0 then interest_expense end as interest_expense, ebit, make_date(year, 12, 31) + 120 as known from fin",
    "h": "select symbol, known, last_value(interest_expense ignore nulls) over w as interest_expense, last_value(ebit ignore nulls) over w as ebit, year from g window w as (partition by symbol order by year rows between unbounded preceding and current row)",
}


@query(
    "fundamentals_as_of",
    with_inputs("fin", extra={**QSTARTS, **PIT_SQL, "s": "select distinct symbol from fin", "a": "select s.symbol, qi.date as rebalance_date, h.year, h.interest_expense, h.ebit from s cross join qi asof join h on h.symbol = s.symbol and qi.date >= h.known"})
    + " select symbol, rebalance_date, year, interest_expense, ebit from a",
    "J5 B14",
)
def _fundamentals(spark, sf):
    from stratafin.plans.backtest import fundamentals_at

    fin = table(spark, sf, "fin").select("symbol", "year", F.when(F.col("year") % 2 == 0, F.col("interest_expense")).alias("interest_expense"), "ebit")
    return fundamentals_at(fin, quarter_instants(spark, sf), Publication()).select("symbol", "rebalance_date", "year", "interest_expense", "ebit")


@query(
    "as_of_last_known_per_column",
    with_inputs("fin", "hold", extra={"g": "select symbol, as_of_date as known, case when year % 3 = 0 then ebit end as ebit, net_income from fin", "pr": "select distinct symbol, as_of_date as date from hold",
       "h": "select symbol, known, last_value(ebit ignore nulls) over w as ebit, net_income from g window w as (partition by symbol order by known rows between unbounded preceding and current row)"})
    + " select pr.symbol, pr.date, h.ebit, h.net_income from pr asof left join h on pr.symbol = h.symbol and pr.date >= h.known",
    "J5",
)
def _per_column(spark, sf):
    fin = table(spark, sf, "fin").select("symbol", F.col("as_of_date").alias("known"), F.when(F.col("year") % 3 == 0, F.col("ebit")).alias("ebit"), "net_income")
    probes = table(spark, sf, "hold").select("symbol", F.col("as_of_date").alias("date")).distinct()
    return joins.as_of(probes, fin, ["symbol"], "date", "known", ["ebit", "net_income"], per_column=True)


@query(
    "period_endpoints",
    with_inputs("px", extra={**QSTARTS, "j": 'select start as period_id, symbol, arg_min(close, date) as f, arg_max(close, date) as l, count(close) as n from px join per on date between start and "end" group by 1, 2'})
    + f" select period_id, symbol, {rnd('f')} as first_price, {rnd('l')} as last_price, n as n_prices, {rnd('l / nullif(f, 0) - 1')} as period_return from j",
    "J6 F19",
)
def _endpoints(spark, sf):
    periods = calendar.periods_between(quarter_instants(spark, sf)).withColumn("period_id", F.col("start"))
    return _round(joins.period_endpoints(table(spark, sf, "px"), periods), ["first_price", "last_price", "period_return"])


@query(
    "benchmark_period_return",
    with_inputs("bench", extra={**QSTARTS, "j": 'select start as period_id, arg_min(close, date) as f, arg_max(close, date) as l, count(*) as n from bench join per on date between start and "end" group by 1'})
    + f" select period_id, {rnd('case when n >= 2 then l / nullif(f, 0) - 1 else 0 end')} as benchmark_return from j",
    "J7",
)
def _bench_period(spark, sf):
    periods = calendar.periods_between(quarter_instants(spark, sf)).withColumn("period_id", F.col("start"))
    out = joins.period_endpoints(table(spark, sf, "bench").withColumn("symbol", F.lit("*")), periods)
    value = F.when(F.col("n_prices") >= 2, F.col("period_return")).otherwise(0.0)
    return out.select("period_id", F.round(value, 6).alias("benchmark_return"))


# --- metrics ---------------------------------------------------------------------------------------------

# nation series scaled to market-like daily moves
SER = {
    "rr": f"select symbol as portfolio_id, sector, date, (close / nullif(lag(close) over ({W}), 0) - 1) / 400.0 as ret from npx",
    "ser": "select * from rr where ret is not null",
    "bb": "select date, (close / nullif(lag(close) over (order by date), 0) - 1) / 400.0 as ret from bench",
    "ben": "select * from bb where ret is not null",
}
PATH = {
    "pa": "select *, product(1 + ret) over (partition by portfolio_id order by date rows between unbounded preceding and current row) as g from ser",
    "pb": "select *, g / max(g) over (partition by portfolio_id order by date rows between unbounded preceding and current row) - 1 as dd from pa",
    "pc": "select *, coalesce(lag(dd < 0) over (partition by portfolio_id order by date), false) as wu, lead(date) over (partition by portfolio_id order by date) is null as la from pb",
    "pd": "select *, last_value(case when dd < 0 and not wu then date end ignore nulls) over (partition by portfolio_id order by date rows between unbounded preceding and current row) as st from pc",
    "pe": "select *, case when (not dd < 0 and wu) or (dd < 0 and la) then date_diff('day', st, date) end as days from pd",
}


def series_returns(spark, sf):
    npx = table(spark, sf, "npx")
    out = series.simple_returns(npx).select(F.col("symbol").alias("portfolio_id"), "sector", "date", (F.col("ret") / 400.0).alias("ret"))
    return out.where(F.col("ret").isNotNull())


def benchmark_returns(spark, sf):
    b = series.simple_returns(table(spark, sf, "bench").withColumn("symbol", F.lit("*")))
    return b.select("date", (F.col("ret") / 400.0).alias("ret")).where(F.col("ret").isNotNull())


@query(
    "performance_metrics",
    with_inputs("npx", "bench", extra={**SER, **PATH, "m": """select portfolio_id, count(*) as n, min(date) as d0, max(date) as d1, product(1 + ret) as gr, avg(ret) as mu, stddev_samp(ret) as sd, stddev_samp(case when ret < 0 then ret end) as dn,
       count(*) filter (where ret > 0) as nw, avg(case when ret > 0 then ret end) as aw, avg(case when ret < 0 then ret end) as al, min(dd) as md, avg(case when dd < 0 then dd end) as ad, coalesce(max(days), 0) as du from pe group by 1"""})
    + f""" select portfolio_id, n as num_periods, d0 as start_date, d1 as end_date, {even('(gr - 1) * 100', 2)} as total_return, {even('(power(gr, 252.0 / n) - 1) * 100', 2)} as cagr, {even('sd * sqrt(252.0) * 100', 2)} as annual_volatility,
      {even('(mu - 0.045 / 252) / sd * sqrt(252.0)', 3)} as sharpe_ratio, {even('(mu - 0.045 / 252) / dn * sqrt(252.0)', 3)} as sortino_ratio, {even('(power(gr, 252.0 / n) - 1) / abs(md)', 3)} as calmar_ratio,
      {even('md * 100', 2)} as max_drawdown, {even('ad * 100', 2)} as avg_drawdown, {even('nw / n::double * 100', 1)} as hit_ratio, {even('aw * 100', 3)} as avg_win, {even('al * 100', 3)} as avg_loss,
      {even('abs(aw / al)', 2)} as win_loss_ratio, du::int as max_drawdown_duration_days from m where n >= 10""",
    "A24 A27 W18 W7",
)
def _metrics(spark, sf):
    return metrics.performance_metrics(series_returns(spark, sf), ["portfolio_id"])


@query(
    "benchmark_stats",
    with_inputs("npx", "bench", extra={**SER, "al": "select portfolio_id, ser.ret as r, ben.ret as b from ser join ben using (date)",
      "s": "select portfolio_id, count(*) as n, covar_samp(r, b) / nullif(var_samp(b), 0) as be, avg(r) as ar, avg(b) as ab, avg(r - b) as aa, stddev_samp(r - b) as te from al group by 1"})
    + f""" select portfolio_id, n as n_aligned, {even('be', 2)} as beta, {even('(ar - 0.045 / 252 - be * (ab - 0.045 / 252)) * 252 * 100', 2)} as alpha, {even('te * sqrt(252.0) * 100', 2)} as tracking_error, {even('aa / te * sqrt(252.0)', 3)} as information_ratio from s where n >= 11""",
    "A25 J9",
)
def _bench_stats(spark, sf):
    aligned = metrics.align_benchmark(series_returns(spark, sf), benchmark_returns(spark, sf))
    return metrics.benchmark_stats(aligned, ["portfolio_id"])


SUBS = [("early", "1995-06-01", "1996-12-31"), ("crisis", "1998-07-01", "1998-10-31"), ("short", "1999-01-01", "1999-01-05")]
SUB_SQL = " union all ".join(f"select '{n}' as period, date '{a}' as a, date '{b}' as b" for n, a, b in SUBS)


@query(
    "subperiod_metrics",
    with_inputs("npx", "bench", extra={**SER, "sp": SUB_SQL, "x": "select portfolio_id, period, date, ret from ser join sp on date between a and b",
      "y": "select *, product(1 + ret) over (partition by portfolio_id, period order by date rows between unbounded preceding and current row) as g from x",
      "z": "select *, g / max(g) over (partition by portfolio_id, period order by date rows between unbounded preceding and current row) - 1 as dd from y",
      "m": "select portfolio_id, period, count(*) as n, min(date) as d0, max(date) as d1, product(1 + ret) as gr, avg(ret) as mu, stddev_samp(ret) as sd, min(dd) as md from z group by 1, 2"})
    + f""" select portfolio_id, period, d0 as start_date, d1 as end_date, {even('(power(gr, 252.0 / n) - 1) * 100', 2)} as cagr, {even('sd * sqrt(252.0) * 100', 2)} as annual_volatility, {even('(mu - 0.045 / 252) / sd * sqrt(252.0)', 3)} as sharpe_ratio,
      {even('md * 100', 2)} as max_drawdown, {even('coalesce((power(gr, 252.0 / n) - 1) / nullif(abs(md), 0), 0)', 3)} as calmar_ratio from m where n >= 10""",
    "A28 F19",
)
def _sub(spark, sf):
    return metrics.subperiod_metrics(series_returns(spark, sf), ["portfolio_id"], SUBS)


@query(
    "benchmark_price_metrics",
    with_inputs("npx", extra={"r": f"select symbol, date, close, close / nullif(lag(close) over ({W}), 0) - 1 as ret from npx",
      "g": f"select *, case when ret is not null then product(1 + coalesce(ret, 0)) over ({W} rows between unbounded preceding and current row) end as gr from r",
      "d": f"select *, gr / max(gr) over ({W} rows between unbounded preceding and current row) - 1 as dd from g",
      "m": "select symbol, count(*) as n, (arg_max(close, date) / arg_min(close, date) - 1) * 100 as t, stddev_samp(ret) * sqrt(252.0) * 100 as v, min(dd) * 100 as md from d group by 1"})
    + f" select symbol, {even('t', 2)} as return_pct, {even('v', 2)} as volatility_pct, {even('(t * 252 / n - 4.5) / v', 2)} as sharpe, {even('md', 2)} as max_drawdown_pct, n as days from m",
    "A30",
)
def _bench_metrics(spark, sf):
    return metrics.benchmark_metrics(table(spark, sf, "npx").select("symbol", "date", "close"), ["symbol"])


# --- stress -------------------------------------------------------------------------------------------------

WINDOWS = [
    StressWindow("sharp_fall", "2000-02-19", "2000-03-23", -40.0),
    StressWindow("rebound", "2000-03-23", "2000-08-31", None, 55.0, 0.5),
    StressWindow("long_crisis", "1998-09-01", "1999-03-09", -15.0),
    StressWindow("two_days", "2000-05-06", "2000-05-07", -12.0),
    StressWindow("overlap", "1998-10-01", "1998-12-24", -10.0),
    StressWindow("after_data", "2008-09-01", "2009-03-09", -45.0),
]
WIN_SQL = " union all ".join(
    f"select '{w.name}' as win, date '{w.start}' as a, date '{w.end}' as b, {w.max_acceptable_dd if w.max_acceptable_dd is not None else 'null'}::double as lim, {w.expected_return * w.min_capture if w.min_capture else 'null'}::double as need"
    for w in WINDOWS
)


def _facts(source, key):
    part = f"partition by {key}win order by date rows between unbounded preceding and current row"
    return f"""select {key}win, count(*) as n, (product(1 + ret) - 1) * 100 as r, min(dd) * 100 as dd, stddev_samp(ret) * sqrt(252.0) * 100 as v, any_value(lim) as lim, any_value(need) as need from
      (select *, g / max(g) over ({part}) - 1 as dd from (select *, product(1 + ret) over ({part}) as g from {source} join w on date between a and b) x) y group by all"""


STRESS = {**SER, "w": WIN_SQL, "pf": _facts("ser", "portfolio_id, "), "bf": _facts("ben", ""),
          "st": f"""select portfolio_id, pf.win as "window", pf.n as portfolio_rows, {even('pf.r', 2)} as portfolio_return, {even('pf.dd', 2)} as portfolio_max_dd, {even('pf.v', 2)} as portfolio_volatility, {even('bf.r', 2)} as benchmark_return,
            {even('bf.dd', 2)} as benchmark_max_dd, {even('pf.r - bf.r', 2)} as excess_return, not coalesce(pf.dd < pf.lim, false) and not coalesce(pf.r < pf.need, false) as passed from pf left join bf on pf.win = bf.win where pf.n >= 3"""}


def stress_results(spark, sf):
    return stress.stress_windows(series_returns(spark, sf), benchmark_returns(spark, sf), ["portfolio_id"], WINDOWS)


@query("stress_windows", with_inputs("npx", "bench", extra=STRESS) + " select * from st", "B20")
def _stress(spark, sf):
    return stress_results(spark, sf)


@query(
    "stress_summary",
    with_inputs("npx", "bench", extra=STRESS)
    + f""" select portfolio_id, count(*) as n_windows, count(*) filter (where passed) as passed_count, count(*) filter (where not passed) as failed_count, {even('round(sum(portfolio_max_dd) * 100) / 100 / count(portfolio_max_dd)', 2)} as avg_dd, min(portfolio_max_dd) as worst_dd,
      {even('round(sum(portfolio_return) * 100) / 100 / count(portfolio_return)', 2)} as avg_return, {even('round(sum(excess_return) * 100) / 100 / count(excess_return)', 2)} as avg_excess_return, {even('avg((excess_return > 0)::int) * 100', 1)} as pct_outperform,
      count(*) filter (where passed) / count(*)::double >= 0.7 and min(portfolio_max_dd) >= -35 as overall_passed from st group by portfolio_id""",
    "A35",
)
def _stress_summary(spark, sf):
    return stress.stress_summary(stress_results(spark, sf))


# --- price factors ------------------------------------------------------------------------------------------------

FACTORS = {
    **QSTARTS,
    "k0": f"""select symbol, date, close, close / nullif(lag(close) over ({W}), 0) - 1 as ret, lag(close, 20) over ({W}) as sk from px""",
    "k1": f"""select *, count(*) over w as n, first_value(close) over w as f, avg(ret) over w as mu, stddev_samp(ret) over w as sd from k0 window w as ({W} rows between 252 preceding and current row)""",
    "k2": "select symbol, date, n, close / nullif(f, 0) - 1 as r1, coalesce(mu / nullif(sd, 0), 0) as q1, case when n > 63 then sk / nullif(f, 0) - 1 end as m1, sd * sqrt(252.0) as v1 from k1 where n >= 60",
    "k3": "select s.symbol, qi.date as rebalance_date, k2.r1, k2.q1, k2.m1, k2.v1 from (select distinct symbol from k2) s cross join qi asof join k2 on k2.symbol = s.symbol and qi.date >= k2.date",
    "k4": f"select symbol, rebalance_date, coalesce(1 - {pct('r1', 'rebalance_date')}, 0.5) as value, coalesce({pct('q1', 'rebalance_date')}, 0.5) as quality, coalesce({pct('m1', 'rebalance_date')}, 0.5) as momentum, coalesce(1 - {pct('v1', 'rebalance_date')}, 0.5) as low_vol from k3",
}


@query(
    "price_factors",
    with_inputs("px", extra=FACTORS) + f" select symbol, rebalance_date, {rnd('value')} as value, {rnd('quality')} as quality, {rnd('momentum')} as momentum, {rnd('low_vol')} as low_vol from k4",
    "W16",
)
def _factors(spark, sf):
    from stratafin.plans.backtest import price_factors_at

    out = price_factors_at(table(spark, sf, "px").select("symbol", "date", "close"), quarter_instants(spark, sf))
    return _round(out.select("symbol", "rebalance_date", "value", "quality", "momentum", "low_vol"), ["value", "quality", "momentum", "low_vol"])
