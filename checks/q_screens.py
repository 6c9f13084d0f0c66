"""Screens, validation, signal merging and holdings summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.derive import raw, table, with_inputs
from checks.q_scores30 import RATIO_SQL, ratio_table
from checks.registry import clip, even, query, rnd
from stratafin.functions import ratios
from stratafin.functions.scalar import default_columns, half_even, safe_double, winsorise
from stratafin.operators import filters, holdings, signals, validation
from stratafin.operators.history import track_record, track_record_totals
from stratafin.operators.joins import exists_flag
from stratafin.params import Eligibility, Leverage, Liquidity

LIQ = Liquidity(min_market_cap=3_000_000.0, min_adv_usd=10_000.0, max_position_vs_adv=0.02, position_usd=200.0)
FIN = with_inputs("fin")

# --- scalar ratios --------------------------------------------------------------------

STATEMENTS = with_inputs(
    "fin",
    extra={
        "st": """select *, case when s % 5 = 0 then null when s % 5 = 1 then 0.0 else ebit end as ebit_given, ebit * 1.1 as operating_income,
   case when s % 3 = 0 then null else 0.4 * total_debt end as std, case when s % 6 = 0 then null else 0.6 * total_debt end as ltd,
   case when s % 4 = 0 then null else capex end as capex_given, case when s % 2 = 0 then fcf end as fcf_direct
  from (select f.*, cast(substr(symbol, 2) as bigint) as s from fin f) z"""
    },
)


def _pct(a, b):
    return even(f"case when {b} > 0 then {a} / {b} end * 100", 2)


@query(
    "statement_ratios",
    STATEMENTS
    + f""" select symbol, year, coalesce(nullif(ebit_given, 0), operating_income) as ebit,
    {_pct('gross_profit', 'revenue')} as gross_margin, {_pct('operating_income', 'revenue')} as operating_margin, {_pct('net_income', 'revenue')} as net_margin,
    case when std is not null or ltd is not null then coalesce(std, 0) + coalesce(ltd, 0) end as total_debt,
    {even('case when current_liabilities > 0 then current_assets / current_liabilities end', 2)} as current_ratio,
    {_pct('net_income', 'equity')} as roe, {_pct('net_income', 'total_assets')} as roa,
    {even('case when equity > 0 then (case when std is not null or ltd is not null then coalesce(std, 0) + coalesce(ltd, 0) end) / equity end', 2)} as debt_equity,
    {_pct('abs(capex_given)', 'revenue')} as capex_ratio,
    coalesce(fcf_direct, case when capex_given is not null then round_even(operating_cash_flow - abs(capex_given), 0) end) as fcf from st""",
    "P4 P5 P6 P3",
)
def _statements(spark, sf):
    s = F.substring("symbol", 2, 6).cast("bigint")
    fin = table(spark, sf, "fin")
    df = fin.withColumns(
        {
            "short_term_debt": F.when(s % 3 == 0, None).otherwise(0.4 * F.col("total_debt")),
            "long_term_debt": F.when(s % 6 == 0, None).otherwise(0.6 * F.col("total_debt")),
            "operating_income": F.col("ebit") * 1.1,
            "ebit": F.when(s % 5 == 0, None).when(s % 5 == 1, 0.0).otherwise(F.col("ebit")),
            "capex": F.when(s % 4 == 0, None).otherwise(F.col("capex")),
            "free_cash_flow": F.when(s % 2 == 0, F.col("fcf")),
        }
    )
    out = ratios.cash_flow_ratios(ratios.balance_ratios(ratios.income_ratios(df)))
    cols = "ebit gross_margin operating_margin net_margin total_debt current_ratio roe roa debt_equity capex_ratio fcf".split()
    return out.select("symbol", "year", *cols)


@query(
    "statistics_fallback",
    with_inputs("fin", extra={"st": "select *, cast(substr(symbol, 2) as bigint) as s from fin",
      "q": """select symbol, year, s, case when s % 3 = 0 then net_income / nullif(equity, 0) * 100 end as roe, case when s % 2 = 0 then 0.0 end as r1,
       net_income / nullif(total_assets, 0) as r2, case when s % 3 = 1 then current_assets / nullif(current_liabilities, 0) end as cr from st"""})
    + f""" select symbol, year, coalesce(roe, case when v > -1 and v < 1 then {even('v * 100', 2)} else {even('v', 2)} end) as roe,
      coalesce(cr, {even('w', 2)}) as current_ratio from (select *, coalesce(nullif(r1, 0), nullif(r2, 0)) as v, nullif(r2, 0) as w from q) z""",
    "P7 P3 P2",
)
def _statistics(spark, sf):
    s = F.substring("symbol", 2, 6).cast("bigint")
    fin = table(spark, sf, "fin")
    df = fin.select(
        "symbol",
        "year",
        F.when(s % 3 == 0, ratios.ratio("net_income", "equity") * 100).alias("roe"),
        F.when(s % 2 == 0, F.lit(0.0)).alias("return_on_equity_ttm"),
        ratios.ratio("net_income", "total_assets").alias("return_on_equity"),
        F.when(s % 3 == 1, ratios.ratio("current_assets", "current_liabilities")).alias("current_ratio"),
    )
    out = ratios.statistics_fallback(
        df, {"roe": ["return_on_equity_ttm", "return_on_equity"], "current_ratio": ["return_on_equity"]}
    )
    return out.select("symbol", "year", "roe", "current_ratio")


@query(
    "safe_number_parsing",
    """select event_id, try_cast(json_extract_string(props, '$.k') as double) as k,
       case when event_type = 'error' then null else value end as v, case when event_type = 'click' then 0.0 else coalesce(value, 0.0) end as filled from events""",
    "P1 P2",
)
def _safe(spark, sf):
    ev = raw(spark, sf, "events")
    text = F.when(F.col("event_type") == "error", F.lit("NaN")).otherwise(F.col("value").cast("string"))
    df = ev.select(
        "event_id",
        safe_double(F.get_json_object("props", "$.k")).alias("k"),
        safe_double(text).alias("v"),
        F.when(F.col("event_type") == "click", F.lit(None)).otherwise(F.col("value")).alias("filled"),
    )
    return default_columns(df, {"filled": 0.0})


@query(
    "earnings_features",
    FIN
    + f""" select symbol, year, {rnd(clip('((net_income - operating_cash_flow) / nullif(total_assets, 0))', -0.5, 0.5))} as accruals,
      {rnd(clip('(fcf / nullif(net_income, 0))', -2, 3))} as fcf_ni_ratio from fin""",
    "P12 P13",
)
def _earnings(spark, sf):
    df = ratios.earnings_features(table(spark, sf, "fin"))
    return df.select("symbol", "year", F.round("accruals", 6).alias("accruals"), F.round("fcf_ni_ratio", 6).alias("fcf_ni_ratio"))


@query(
    "winsorised_metrics",
    FIN
    + """ select symbol, year, least(greatest(revenue, 0), 3000000.0) as revenue, least(greatest(ebit, -10000.0), 250000.0) as ebit, least(greatest(capex, -20000.0), 0) as capex from fin""",
    "P14",
)
def _winsor(spark, sf):
    bounds = {"revenue": (0.0, 3_000_000.0), "ebit": (-10_000.0, 250_000.0), "capex": (-20_000.0, 0.0), "absent": (0.0, 1.0)}
    return winsorise(table(spark, sf, "fin"), bounds).select("symbol", "year", "revenue", "ebit", "capex")


# --- screens ----------------------------------------------------------------------------

LIQ_SQL = """select *, shares_outstanding * price as mc, avg_volume * price as adv, 200.0 / (case when avg_volume * price = 0 then 1 else avg_volume * price end) as pos from fin"""


@query(
    "liquidity_explained",
    with_inputs("fin", extra={"l": LIQ_SQL})
    + f""" select symbol, year, mc >= 3000000.0 as market_cap_ok, adv >= 10000.0 as adv_ok, pos <= 0.02 as position_ok, {rnd('pos')} as position_vs_adv from l""",
    "P8 P9 F4",
)
def _liq_explain(spark, sf):
    return filters.explain_liquidity(table(spark, sf, "fin"), LIQ).select(
        "symbol", "year", "market_cap_ok", "adv_ok", "position_ok", F.round("position_vs_adv", 6).alias("position_vs_adv")
    )


@query(
    "liquidity_filter",
    with_inputs("fin", extra={"l": LIQ_SQL}) + " select symbol, year from l where mc >= 3000000.0 and adv >= 10000.0 and pos <= 0.02",
    "F3",
)
def _liq_filter(spark, sf):
    return filters.liquidity_filter(table(spark, sf, "fin"), LIQ).select("symbol", "year")


@query(
    "liquidity_funnel",
    with_inputs("fin", extra={"l": LIQ_SQL})
    + """ select as_of_date, count(*) as initial, sum(case when mc >= 3000000.0 then 0 else 1 end)::bigint as failed_market_cap,
     sum(case when adv >= 10000.0 then 0 else 1 end)::bigint as failed_adv, sum(case when pos <= 0.02 then 0 else 1 end)::bigint as failed_position,
     sum(case when mc >= 3000000.0 and adv >= 10000.0 and pos <= 0.02 then 1 else 0 end)::bigint as final from l group by as_of_date""",
    "A17",
)
def _funnel(spark, sf):
    flagged = filters.explain_liquidity(table(spark, sf, "fin"), LIQ)
    return filters.funnel(
        flagged, ["as_of_date"], {"market_cap": F.col("market_cap_ok"), "adv": F.col("adv_ok"), "position": F.col("position_ok")}
    )


LEV_SQL = """select *, total_debt / nullif(equity, 0) as de, (total_debt - cash) / nullif(ebit * 1.2, 0) as nd, ebit / nullif(abs(interest_expense), 0) as cov from fin"""


@query(
    "leverage_reasons",
    with_inputs("fin", extra={"l": LEV_SQL})
    + """ select symbol, year, concat_ws('; ', case when de > 3 then 'D/E' end, case when nd > 4 then 'ND/EBITDA' end, case when cov < 2.5 then 'Coverage' end) as reasons from l""",
    "F5",
)
def _lev(spark, sf):
    return filters.mark_leverage(table(spark, sf, "fin")).select("symbol", "year", F.concat_ws("; ", "exclude_reasons").alias("reasons"))


@query(
    "leverage_explained",
    FIN
    + f""" select symbol, year, coalesce(equity > 0 and total_debt / nullif(equity, 0) <= 3, false) as de_ok,
     coalesce(ebit > 0 and (total_debt - cash) / nullif(ebit * 1.2, 0) <= 4, false) as nd_ebitda_ok,
     coalesce(not (abs(interest_expense) > 0) or interest_expense is null or ebit / nullif(abs(interest_expense), 0) >= 2.5, true) as coverage_ok,
     {even('case when equity > 0 then total_debt / equity end', 2)} as strict_debt_equity from fin""",
    "F6",
)
def _lev_explain(spark, sf):
    return filters.explain_leverage(table(spark, sf, "fin")).select("symbol", "year", "de_ok", "nd_ebitda_ok", "coverage_ok", "strict_debt_equity")


@query(
    "screen_with_fallback",
    with_inputs("fin", extra={"l": LEV_SQL, "f": """select *, coalesce(shares_outstanding * price >= m, false) and not coalesce(de > 1.5, false) and not coalesce(nd > 4, false) and not coalesce(cov < 2.5, false) as strict,
       (de is null or de <= 5) as relaxed from (select *, case when year % 2 = 0 then 3000000.0 else 900000000.0 end as m from l) z
       """, "c": "select as_of_date, count(*) filter (where strict) as ns, count(*) filter (where relaxed) as nr from f group by as_of_date"})
    + """ select f.symbol, f.year, case when ns >= 15 then 'strict' when nr >= 15 then 'relaxed' else 'unfiltered' end as screen_mode
      from f join c using (as_of_date) where case when ns >= 15 then strict when nr >= 15 then relaxed else true end""",
    "F9",
)
def _fallback(spark, sf):
    fin = table(spark, sf, "fin")
    # odd years get an unreachable size limit, so they take the fallback branch
    scaled = fin.withColumn("market_cap", F.col("shares_outstanding") * F.col("price") * F.when(F.col("year") % 2 == 0, 1.0).otherwise(1.0 / 300.0))
    p = Liquidity(min_market_cap=3_000_000.0, min_adv_usd=0.0, max_position_vs_adv=1e12, position_usd=1.0)
    return filters.screen_with_fallback(scaled, p, Leverage(max_debt_equity=1.5)).select("symbol", "year", "screen_mode")


ELIG = Eligibility(min_history_years=4, max_loss_years=1, excluded_industries=("Nation_3", " NATION_7 ".strip()))
ELIG_SQL = """select *, count(*) over w as yrs, count(*) filter (where net_income < 0) over w as losses from fin
  window w as (partition by symbol order by year rows between unbounded preceding and current row)"""
ELIG_REASON = """case when not yrs >= 4 then 'history_insufficient' when not losses <= 1 then 'chronic_losses'
   when lower(trim(industry)) in ('nation_3', 'nation_7') then 'excluded_industry' end"""


@query(
    "eligibility_first_reason",
    with_inputs("fin", extra={"e": ELIG_SQL})
    + f""" select symbol, year, yrs::int as years_of_data, losses::int as loss_years_count, {ELIG_REASON} as rejected_for from e""",
    "F7 W21",
)
def _elig(spark, sf):
    return filters.mark_eligibility(track_record(table(spark, sf, "fin")), ELIG).select(
        "symbol", "year", "years_of_data", "loss_years_count", "rejected_for"
    )


@query(
    "eligibility_rejections",
    with_inputs("fin", extra={"e": ELIG_SQL, "r": f"select as_of_date, {ELIG_REASON} as rejected_for from e"})
    + " select as_of_date, rejected_for, count(*) as n from r where rejected_for is not null group by all",
    "F7 A17",
)
def _elig_counts(spark, sf):
    return filters.rejection_counts(filters.mark_eligibility(track_record(table(spark, sf, "fin")), ELIG), ["as_of_date"])


@query(
    "eligibility_explained",
    with_inputs("fin", extra={"t": "select symbol, any_value(industry) as industry, count(*) as yrs, count(*) filter (where net_income < 0) as losses from fin group by symbol"})
    + """ select symbol, concat_ws('|', case when yrs < 4 then 'history=' || yrs || 'y < 4y' end, case when losses > 1 then 'losses=' || losses || ' > 1' end,
     case when lower(trim(industry)) in ('nation_3', 'nation_7') then 'industry=' || lower(trim(industry)) end) as reasons,
     yrs >= 4 and losses <= 1 and lower(trim(industry)) not in ('nation_3', 'nation_7') as eligible from t""",
    "F8 W21",
)
def _elig_explain(spark, sf):
    totals = track_record_totals(table(spark, sf, "fin"), ["symbol", "industry"])
    out = filters.explain_eligibility(totals, ELIG)
    return out.select("symbol", F.concat_ws("|", "ineligible_reasons").alias("reasons"), "eligible")


@query(
    "clean_universe_strict",
    with_inputs("fin", extra={"u": "select symbol, year, case when year = 1996 then null when year = 1997 then 'Unknown' else sector end as sector, case when year = 1998 then null else revenue end as revenue, net_income from fin"})
    + " select symbol, year, sector from u where coalesce(sector, 'Unknown') <> 'Unknown' and revenue is not null and net_income is not null",
    "F1",
)
def _clean(spark, sf):
    fin = table(spark, sf, "fin")
    df = fin.withColumns(
        {
            "sector": F.when(F.col("year") == 1996, None).when(F.col("year") == 1997, "Unknown").otherwise(F.col("sector")),
            "revenue": F.when(F.col("year") == 1998, None).otherwise(F.col("revenue")),
        }
    )
    return filters.clean_universe(df, strict=True).select("symbol", "year", "sector")


# --- validation ------------------------------------------------------------------------------

VALID_SQL = """
select symbol, year, as_of_date, revenue, ebit, net_income, equity, case when year = 1999 then null else total_debt end as total_debt, fcf,
  cash, interest_expense, shares_outstanding, least(greatest(revenue, 0), 4000000.0) as rev_c, least(greatest(equity, -100000.0), 50000000.0) as eq_c from fin"""
WARN_SQL = """
select *, concat_ws('|', case when interest_expense is null then 'preferred interest_expense missing' end,
  case when revenue < 0 or revenue > 4000000.0 then 'revenue out of range' end, case when equity < -100000.0 or equity > 50000000.0 then 'equity out of range' end,
  case when rev_c > 0 and abs(net_income / nullif(rev_c, 0)) > 1 then 'net margin above 100%' end, case when eq_c > 0 and total_debt / nullif(eq_c, 0) > 10 then 'debt/equity above 10' end,
  case when net_income > 0 and fcf / nullif(net_income, 0) > 3 then 'fcf/net income above 3' end) as w from v"""
BOUNDS = {"revenue": (0.0, 4_000_000.0), "equity": (-100_000.0, 50_000_000.0)}


def _to_validate(spark, sf):
    fin = table(spark, sf, "fin")
    return fin.withColumn("total_debt", F.when(F.col("year") == 1999, None).otherwise(F.col("total_debt")))


@query(
    "row_validation",
    with_inputs("fin", extra={"v": VALID_SQL, "w1": WARN_SQL})
    + """ select symbol, year, total_debt is not null as is_valid, case when total_debt is null then 'missing total_debt' else '' end as errors,
     case when total_debt is null then '' else w end as warnings, rev_c as revenue from w1""",
    "F15 F16 P14",
)
def _validate(spark, sf):
    out = validation.validate_rows(_to_validate(spark, sf), bounds=BOUNDS)
    return out.select("symbol", "year", "is_valid", F.concat_ws("|", "errors").alias("errors"), F.concat_ws("|", "warnings").alias("warnings"), "revenue")


@query(
    "history_validation",
    with_inputs("fin", extra={"v": VALID_SQL})
    + """ select symbol, year, n as valid_years from (select symbol, year, count(*) over (partition by symbol) as n from v where total_debt is not null) z where n >= 5""",
    "F17",
)
def _validate_history(spark, sf):
    return validation.validate_history(_to_validate(spark, sf), bounds=BOUNDS).select("symbol", "year", "valid_years")


@query(
    "universe_validation_messages",
    with_inputs("fin", extra={"v": VALID_SQL, "w1": WARN_SQL, "m": """select as_of_date, 'error' as kind, 'missing total_debt' as message from w1 where total_debt is null
      union all select as_of_date, 'warning', unnest(string_split(w, '|')) from w1 where total_debt is not null and w <> ''"""})
    + " select as_of_date, kind, message, count(*) as n from m group by all",
    "F18",
)
def _validate_universe(spark, sf):
    return validation.universe_warnings(validation.validate_rows(_to_validate(spark, sf), bounds=BOUNDS))


@query(
    "symbol_warnings",
    with_inputs("fin", extra={"v": VALID_SQL, "w1": WARN_SQL}) + " select as_of_date, symbol, w as warnings from w1 where total_debt is not null",
    "F18",
)
def _symbol_warnings(spark, sf):
    out = validation.warnings_per_symbol(validation.validate_rows(_to_validate(spark, sf), bounds=BOUNDS))
    return out.select("as_of_date", "symbol", F.concat_ws("|", "warnings").alias("warnings"))


@query(
    "price_anomalies",
    with_inputs("px", extra={"c": "select *, close / nullif(lag(close) over (partition by symbol order by date), 0) - 1 as ch, case when symbol not like '%3' then floor(close * 7) % 50 end as volume, floor(close * 13) % 90 * close as cap from px"})
    + f""" select symbol, date, {rnd('ch')} as daily_change, concat_ws('|', case when not (close between 1000.0 and 2000.0) then 'price_range' end,
      case when abs(ch) > 0.5 then 'daily_change' end, case when volume < 20 then 'low_volume' end, case when cap < 50000 then 'low_market_cap' end) as anomalies from c""",
    "B25",
)
def _anomalies(spark, sf):
    volume, cap = F.floor(F.col("close") * 7) % 50, F.floor(F.col("close") * 13) % 90 * F.col("close")
    px = table(spark, sf, "px").withColumns({"volume": F.when(~F.col("symbol").endswith("3"), volume), "market_cap": cap})
    out = validation.price_anomalies(px, 1000.0, 2000.0, min_volume=20, min_market_cap=50000)
    return out.select("symbol", "date", F.round("daily_change", 6).alias("daily_change"), F.concat_ws("|", "anomalies").alias("anomalies"))


@query(
    "daily_quality",
    with_inputs("fin")
    + f""" select as_of_date, count(*) as universe_size, {rnd('count(*) filter (where interest_expense is null) / count(*)::double')} as missing_price,
      {rnd('count(*) filter (where ebit is null) / count(*)::double')} as missing_market_cap, count(*) filter (where roe is null) as missing_scores,
      count(*) >= 50 and count(*) filter (where interest_expense is null) / count(*)::double < 0.05 and count(*) filter (where ebit is null) / count(*)::double < 0.02
       and count(*) filter (where roe is null) = 0 as quality_ok from (select *, net_income / nullif(equity, 0) as roe from fin) f group by as_of_date""",
    "A41",
)
def _quality_check(spark, sf):
    df = table(spark, sf, "fin").withColumns(
        {"price": F.col("interest_expense"), "market_cap": F.col("ebit"), "score_composite": ratios.ratio("net_income", "equity")}
    )
    out = validation.daily_quality(df, min_size=50)
    return out.withColumns({c: F.round(c, 6) for c in ("missing_price", "missing_market_cap")})


# --- signals --------------------------------------------------------------------------------


@query(
    "insider_activity",
    with_inputs("trades")
    + f""" select symbol, sum(case when lower(trade_type) in ('buy', 'purchase') then 1 else 0 end)::int as insider_buys,
     sum(case when lower(trade_type) in ('buy', 'purchase') then 0 else 1 end)::int as insider_sells,
     {rnd("sum(case when lower(trade_type) in ('buy', 'purchase') then value else -value end)", 4)} as insider_net_value from trades group by symbol""",
    "A1 S2",
)
def _activity(spark, sf):
    out = signals.insider_activity(table(spark, sf, "trades"), kind="trade_type")
    return out.withColumn("insider_net_value", F.round("insider_net_value", 4))


DIRECTION_SQL = """case when lower(trade_type) like '%sale%' then 'Sell' when lower(trade_type) like '%buy%' or lower(trade_type) like '%purchase%' then 'Buy' when lower(trade_type) like '%gift%' then 'Gift' end"""
TR = {"t": f"select symbol as ticker, insider_name, role, trade_date, {DIRECTION_SQL} as direction, value / 10.0 as v from trades"}
CSUITE_SQL = "(lower(role) like '%ceo%' or lower(role) like '%cfo%' or lower(role) like '%president%')"


def insider_trades(spark, sf):
    from stratafin.functions.text import trade_direction

    return table(spark, sf, "trades").select(
        F.col("symbol").alias("ticker"),
        "insider_name",
        "role",
        "trade_date",
        trade_direction(F.lit(None).cast("string"), F.col("trade_type")).alias("direction"),
        (F.col("value") / 10.0).alias("transaction_value_millions"),
    )


SUMMARY_SQL = f"""select ticker, count(*) filter (where direction = 'Sell') as sell_count, count(*) filter (where direction = 'Buy') as buy_count,
  coalesce(sum(abs(v)) filter (where direction = 'Sell'), 0) as sv, coalesce(sum(abs(v)) filter (where direction = 'Buy'), 0) as bv,
  count(distinct insider_name) as insider_count, max({CSUITE_SQL}) as has_c_suite from t group by ticker"""


@query(
    "insider_ticker_summary",
    with_inputs("trades", extra={**TR, "s": SUMMARY_SQL})
    + f""" select ticker, sell_count, buy_count, {rnd('sv', 4)} as sell_value_millions, {rnd('bv', 4)} as buy_value_millions, insider_count, has_c_suite,
      {rnd('bv - sv', 4)} as net_value_millions from s""",
    "A2 F20",
)
def _ticker_summary(spark, sf):
    out = signals.insider_ticker_summary(insider_trades(spark, sf))
    return out.withColumns({c: F.round(c, 4) for c in ("sell_value_millions", "buy_value_millions", "net_value_millions")})


@query(
    "insider_totals",
    with_inputs("trades", extra=TR)
    + f""" select count(*) as total_trades, count(*) filter (where direction = 'Sell') as total_sells, count(*) filter (where direction = 'Buy') as total_buys,
     {rnd("sum(abs(v)) filter (where direction = 'Sell')", 3)} as total_sell_value, {rnd("sum(abs(v)) filter (where direction = 'Buy')", 3)} as total_buy_value,
     count(distinct ticker) as unique_tickers, count(distinct insider_name) as unique_insiders, min(trade_date)::varchar as first_trade, max(trade_date)::varchar as last_trade,
     {rnd("sum(abs(v)) filter (where direction = 'Buy') - sum(abs(v)) filter (where direction = 'Sell')", 3)} as net_flow,
     {even("count(*) filter (where direction = 'Sell') / nullif(count(*) filter (where direction = 'Buy'), 0)::double", 2)} as sell_buy_ratio from t""",
    "A3 A4",
)
def _totals(spark, sf):
    out = signals.insider_totals(insider_trades(spark, sf))
    return out.withColumns({c: F.round(c, 3) for c in ("total_sell_value", "total_buy_value", "net_flow")})


@query(
    "insider_net_leaders",
    with_inputs("trades", extra={**TR, "s": SUMMARY_SQL})
    + f""" select * from (select 'buyers' as side, ticker, {rnd('bv - sv', 4)} as net_value_millions from s where bv - sv > 0 order by bv - sv desc, ticker limit 10) a
     union all select * from (select 'sellers' as side, ticker, {rnd('bv - sv', 4)} as net_value_millions from s where bv - sv < 0 order by bv - sv, ticker limit 10) b""",
    "K7",
)
def _leaders(spark, sf):
    summary = signals.insider_ticker_summary(insider_trades(spark, sf))
    sides = [signals.net_leaders(summary, s).select(F.lit(s).alias("side"), "ticker", F.round("net_value_millions", 4).alias("net_value_millions")) for s in ("buyers", "sellers")]
    return sides[0].unionByName(sides[1])


@query(
    "insider_alerts",
    with_inputs("trades", extra={**TR, "s": SUMMARY_SQL})
    + f""" select 'danger' as type, 'cluster_sells' as alert, ticker, {rnd('sv', 4)} as value from s where insider_count >= 3 and sell_count >= 3
     union all select case direction when 'Buy' then 'success' else 'warning' end, case direction when 'Buy' then 'c_suite_buy' else 'c_suite_sell' end, ticker, count(*)::double from t
        where {CSUITE_SQL} and direction in ('Buy', 'Sell') group by ticker, direction
     union all select case direction when 'Buy' then 'success' else 'warning' end, 'large_trade', ticker, {rnd('abs(v)', 4)} from t where abs(v) >= 10
     union all select case when r > 5 then 'danger' else 'success' end, case when r > 5 then 'high_sell_buy_ratio' else 'low_sell_buy_ratio' end, 'MARKET', r from
        (select {even("count(*) filter (where direction = 'Sell') / nullif(count(*) filter (where direction = 'Buy'), 0)::double", 2)} as r, count(*) filter (where direction = 'Buy') as b from t) z
        where r > 5 or (r < 0.5 and b > 5)""",
    "C31 F20",
)
def _insider_alerts(spark, sf):
    return signals.insider_alerts(insider_trades(spark, sf)).withColumn("value", F.round("value", 4))


@query(
    "trade_views",
    with_inputs("trades", extra=TR)
    + f""" select 'sells' as view, count(*) as n from t where direction = 'Sell' union all select 'buys', count(*) from t where direction = 'Buy'
     union all select 'c_suite', count(*) from t where {CSUITE_SQL} union all select 'large', count(*) from t where abs(v) >= 5""",
    "F20",
)
def _views(spark, sf):
    trades = insider_trades(spark, sf)
    parts = [signals.trade_view(trades, v).agg(F.lit(v).alias("view"), F.count(F.lit(1)).alias("n")) for v in ("sells", "buys", "c_suite", "large")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


HOLD_SQL = {
    "ft": "select as_of_date, fund, sum(value) as tot from hold group by 1, 2",
    "cons": """select h.as_of_date, symbol, count(distinct h.fund) as nf, avg(value / nullif(tot, 0)) as aw, sum(value) as tv, max(company) as company, sum(n_lines) as buys
       from hold h join ft using (as_of_date, fund) group by 1, 2""",
}


def consensus(spark, sf):
    return holdings.consensus_from_funds(table(spark, sf, "hold"), ["as_of_date"])


@query(
    "consensus_from_funds",
    with_inputs("hold", extra=HOLD_SQL) + f" select as_of_date, symbol, nf as nb_hedge_funds, {rnd('aw')} as avg_hf_weight, {rnd('tv', 2)} as total_value from cons",
    "A6 S1",
)
def _consensus(spark, sf):
    return consensus(spark, sf).withColumns({"avg_hf_weight": F.round("avg_hf_weight", 6), "total_value": F.round("total_value", 2)})


SIG = {
    "g": "select symbol, count(*)::int as gp_buys, max(company) as company from hold group by symbol having count(*) % 3 <> 0",
    "i": "select 'S' || lpad(cast(user_id % 150 as varchar), 6, '0') as symbol, count(*)::int as insider_buys, 'ins' as company from events where event_type = 'purchase' group by 1",
    "m": "select coalesce(g.symbol, i.symbol) as symbol, gp_buys, insider_buys, coalesce(i.company, g.company) as company from g full join i on g.symbol = i.symbol",
}


def merged_signals(spark, sf):
    g = table(spark, sf, "hold").groupBy("symbol").agg(F.count(F.lit(1)).cast("int").alias("gp_buys"), F.max("company").alias("company"))
    g = g.where(F.col("gp_buys") % 3 != 0)
    i = raw(spark, sf, "events").where("event_type = 'purchase'").groupBy(
        F.concat(F.lit("S"), F.lpad((F.col("user_id") % 150).cast("string"), 6, "0")).alias("symbol")
    ).agg(F.count(F.lit(1)).cast("int").alias("insider_buys"), F.lit("ins").alias("company"))
    return signals.merge_signals(g, i)


@query(
    "merge_signals",
    with_inputs("hold", extra=SIG)
    + """ select symbol, company, coalesce(gp_buys, 0) as gp_buys, coalesce(insider_buys, 0) as insider_buys, 'D' as gp_tier, 'Unknown' as sector from m""",
    "J1 P1",
)
def _merge(spark, sf):
    return signals.build_universe(merged_signals(spark, sf)).select("symbol", "company", "gp_buys", "insider_buys", "gp_tier", "sector")


@query(
    "index_universe",
    with_inputs("hold", extra=SIG)
    + """ select u.symbol, coalesce(m.company, '') as company, coalesce(gp_buys, 0) as gp_buys, coalesce(insider_buys, 0) as insider_buys from uni u left join m on u.symbol = m.symbol""",
    "J2 S3",
)
def _index(spark, sf):
    return signals.build_universe(merged_signals(spark, sf), table(spark, sf, "uni")).select("symbol", "company", "gp_buys", "insider_buys")


@query(
    "candidate_selection",
    with_inputs("hold", extra=SIG)
    + """ select symbol, gp_buys, insider_buys from (select symbol, coalesce(gp_buys, 0) as gp_buys, coalesce(insider_buys, 0) as insider_buys from m) z
      where gp_buys >= 40 or insider_buys > 0 order by gp_buys desc, symbol limit 40""",
    "F2",
)
def _candidates(spark, sf):
    u = signals.build_universe(merged_signals(spark, sf)).withColumn("as_of_date", F.lit("all"))
    return filters.candidates(u, 40, 40).select("symbol", "gp_buys", "insider_buys")


@query(
    "membership_flag",
    with_inputs("hold", extra=SIG) + " select u.symbol, exists(select 1 from g where g.symbol = u.symbol) as held from uni u",
    "J11 J10",
)
def _flag(spark, sf):
    g = table(spark, sf, "hold").groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") % 3 != 0)
    return exists_flag(table(spark, sf, "uni"), g, ["symbol"], "held").select("symbol", "held")


@query(
    "eligible_members",
    with_inputs("hold", extra=SIG) + " select u.symbol, u.company from uni u where exists(select 1 from g where g.symbol = u.symbol)",
    "F21",
)
def _eligible_members(spark, sf):
    g = table(spark, sf, "hold").groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") % 3 != 0)
    flagged = exists_flag(table(spark, sf, "uni"), g, ["symbol"], "eligible")
    return filters.only_eligible(flagged).select("symbol", "company")


# --- holdings summaries ----------------------------------------------------------------------

CONSENSUS_ROWS = {
    **HOLD_SQL,
    "cr": """select as_of_date, symbol, company as company_name, aw as portfolio_weight, nf as buys_6m, tv / nf as current_price,
      case when nf >= 8 then 'A' when nf >= 6 then 'B' when nf >= 3 then 'C' else 'D' end as buys_tier from cons""",
}


def consensus_rows(spark, sf):
    from stratafin.operators.holdings import tier

    names = table(spark, sf, "uni").select("symbol", F.col("company").alias("company_name"))
    return (
        consensus(spark, sf)
        .join(names, "symbol")
        .select(
            "as_of_date",
            "symbol",
            "company_name",
            F.col("avg_hf_weight").alias("portfolio_weight"),
            F.col("nb_hedge_funds").alias("buys_6m"),
            (F.col("total_value") / F.col("nb_hedge_funds")).alias("current_price"),
            tier("nb_hedge_funds").alias("buys_tier"),
        )
    )


@query(
    "consensus_validation",
    with_inputs("hold", extra={**CONSENSUS_ROWS, "k": """select as_of_date, count(*) as n, count(*) filter (where length(symbol) >= 1) as s, count(*) filter (where length(company_name) > 2) as c,
      sum(portfolio_weight) as w, count(*) filter (where buys_6m >= 1) as b, count(*) filter (where current_price > 0) as p from cr group by as_of_date"""})
    + f""" select as_of_date, 'minimum_rows' as "check", n >= 5 as passed, n::double as detail from k union all select as_of_date, 'symbols', s = n, s::double from k
     union all select as_of_date, 'company_names', c = n, c::double from k union all select as_of_date, 'weights', w > 0.1 and w < 5, {rnd('w')} from k
     union all select as_of_date, 'buys', b = n, b::double from k union all select as_of_date, 'prices', p = n, p::double from k""",
    "T4",
)
def _consensus_checks(spark, sf):
    return holdings.consensus_checks(consensus_rows(spark, sf), ["as_of_date"]).withColumn("detail", F.round("detail", 6))


@query(
    "consensus_summary",
    with_inputs("hold", extra=CONSENSUS_ROWS)
    + f""" select as_of_date, count(*) as total_stocks, count(*) filter (where buys_tier = 'A') as tier_a, count(*) filter (where buys_tier = 'B') as tier_b,
      min(buys_6m) as min_buys, max(buys_6m) as max_buys, {even('avg(buys_6m)', 2)} as avg_buys from cr group by as_of_date""",
    "T5 T3",
)
def _consensus_summary(spark, sf):
    return holdings.consensus_summary(consensus_rows(spark, sf), ["as_of_date"])


INST = {"inst": "select symbol as ticker, sector, sum(value) / 1e6 as vb, sum(n_lines) as lg, count(distinct fund) as th from hold group by 1, 2"}


def institutional_rows(spark, sf):
    return table(spark, sf, "hold").groupBy(F.col("symbol").alias("ticker"), "sector").agg(
        (F.sum("value") / 1e6).alias("value_owned_billions"), F.sum("n_lines").alias("large_stakes"), F.countDistinct("fund").alias("total_holders")
    )


@query(
    "institutional_summary",
    with_inputs("hold", extra=INST)
    + f""" select count(*) as total_stocks, {even('sum(vb)', 2)} as total_value_billions, sum(lg)::bigint as total_large_stakes, floor(avg(th) + 0.5)::bigint as avg_holders,
     (select sector from inst group by sector order by count(*) desc, sector limit 1) as top_sector from inst""",
    "A5",
)
def _institutional(spark, sf):
    return holdings.institutional_summary(institutional_rows(spark, sf))


@query(
    "sector_distribution",
    with_inputs("hold", extra=INST) + f" select sector, count(*) as n, {even('count(*) * 100.0 / (select count(*) from inst)', 1)} as pct from inst group by sector",
    "A5 A16",
)
def _distribution(spark, sf):
    return holdings.sector_distribution(institutional_rows(spark, sf))


@query(
    "institutional_top10",
    with_inputs("hold", extra=INST)
    + f""" select * from (select 'value' as list, ticker, {rnd('vb', 4)} as amount from inst order by vb desc, ticker limit 10) a
      union all select * from (select 'holders', ticker, th::double from inst order by th desc, ticker limit 10) b""",
    "K6 K10",
)
def _top10(spark, sf):
    inst = institutional_rows(spark, sf)
    a = holdings.top_by(inst, "value_owned_billions").select(F.lit("value").alias("list"), "ticker", F.round("value_owned_billions", 4).alias("amount"))
    b = holdings.top_by(inst, "total_holders").select(F.lit("holders").alias("list"), "ticker", F.col("total_holders").cast("double").alias("amount"))
    return a.unionByName(b)


@query(
    "most_held_tickers",
    with_inputs("hold", extra={"h": "select symbol as ticker, count(distinct fund) as holders from hold group by 1", "f": "select count(distinct fund) as n from hold"})
    + f""" select ticker, holders, {even('holders * 100.0 / (select n from f)', 1)} as pct_of_funds from h order by holders desc, ticker limit 30""",
    "A6 K8 A8",
)
def _most_held(spark, sf):
    df = table(spark, sf, "hold").select(F.col("fund").alias("fund_id"), F.col("symbol").alias("ticker"))
    return holdings.top_by(holdings.most_held(df), "holders", 30)


@query(
    "holdings_by_sector",
    with_inputs("hold") + f""" select sector, count(*) as positions, {even('count(*) * 100.0 / ((select count(distinct fund) from hold) * 30)', 1)} as pct from hold group by sector""",
    "A6",
)
def _by_sector(spark, sf):
    return holdings.holdings_by_sector(table(spark, sf, "hold").withColumnRenamed("fund", "fund_id"))


FUNDS = {"f": "select fund, count(*) as total_holdings, avg(value) / 1e4 as performance_3y, sum(value) / 1e6 as aum_billions from hold group by fund"}


@query(
    "fund_stats",
    with_inputs("hold", extra=FUNDS)
    + f""" select count(*) as n_funds, sum(total_holdings)::bigint as total_holdings, {even('avg(performance_3y)', 2)} as avg_performance, {even('sum(aum_billions)', 2)} as total_aum_billions from f""",
    "A7",
)
def _fund_stats(spark, sf):
    funds = table(spark, sf, "hold").groupBy("fund").agg(
        F.count(F.lit(1)).alias("total_holdings"), (F.avg("value") / 1e4).alias("performance_3y"), (F.sum("value") / 1e6).alias("aum_billions")
    )
    return holdings.fund_stats(funds)


@query(
    "fund_row_preparation",
    with_inputs("hold", extra={"r": "select fund, symbol, case when year % 2 = 0 then '' else year || '-12-31' end as d, case when n_lines > 1 then ' ' else 'Fund  No ' || fund end as fund_name from hold"})
    + """ select regexp_replace(lower(trim(fund_name)), '\\s+', '-', 'g') as fund_id, symbol as ticker, case when trim(d) = '' then '2002-01-01' else d end as date from r where trim(fund_name) <> ''""",
    "P22",
)
def _fund_rows(spark, sf):
    h = table(spark, sf, "hold")
    df = h.select(
        F.when(F.col("n_lines") > 1, " ").otherwise(F.concat(F.lit("Fund  No "), F.col("fund"))).alias("fund_name"),
        F.col("symbol").alias("ticker"),
        F.when(F.col("year") % 2 == 0, "").otherwise(F.concat(F.col("year").cast("string"), F.lit("-12-31"))).alias("date"),
        F.lit("2002-01-01").alias("capture_date"),
    )
    return holdings.prepare_fund_rows(df).select("fund_id", "ticker", "date")
