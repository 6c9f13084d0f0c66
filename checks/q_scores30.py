"""Third-generation scores and their producers."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.derive import table, with_inputs
from checks.registry import clip, desc_rank, even, pct, query, rnd
from stratafin.functions.ratios import leverage_ratios, profitability_ratios, value_ratios
from stratafin.operators import scores_v30
from stratafin.operators.history import five_year_features
from stratafin.operators.ranking import Rank, pct_ranks, top_k

# market cap and the ratio columns, written independently of the library
RATIO_SQL = """
select *, eb / nullif(abs(interest_expense), 0) as interest_coverage
from (select f.*, ebit as eb, shares_outstanding * price as market_cap,
  net_income / nullif(equity, 0) as roe,
  case when equity + total_debt - cash > 0 then ebit * 0.75 / (equity + total_debt - cash) end as roic,
  ebit / nullif(revenue, 0) as operating_margin,
  total_debt / nullif(equity, 0) as debt_equity,
  (total_debt - cash) / nullif(ebit * 1.2, 0) as debt_ebitda,
  least(greatest(fcf / (shares_outstanding * price), -0.5), 0.5) as fcf_yield,
  case when ebit > 0 then least(greatest((shares_outstanding * price + total_debt - cash) / ebit, 0), 100) end as ev_ebit,
  case when net_income > 0 then least(greatest(price / (net_income / shares_outstanding), 0), 200) end as pe_ratio
  from fin f) z
"""
HIST_SQL = """
select *, avg(roe) over w as roe_avg, avg(roic) over w as roic_avg, avg(operating_margin) over w as margin_avg,
  avg(pe_ratio) over w as pe_5y_avg, avg(fcf_yield) over w as fcf_yield_5y_avg,
  stddev_samp(roe) over w as roe_std, stddev_samp(operating_margin) over w as margin_std
from rat window w as (partition by symbol order by year rows between 4 preceding and current row)
"""


def ratio_table(spark, sf):
    fin = table(spark, sf, "fin").withColumns(
        {"market_cap": F.col("shares_outstanding") * F.col("price"), "eps": F.col("net_income") / F.col("shares_outstanding")}
    )
    return profitability_ratios(value_ratios(leverage_ratios(fin)))


def history_table(spark, sf):
    return five_year_features(ratio_table(spark, sf))


@query(
    "ratios_market_and_leverage",
    with_inputs("fin", extra={"rat": RATIO_SQL})
    + f""" select symbol, year, {rnd('roe')} as roe, {rnd('roic')} as roic, {rnd('operating_margin')} as operating_margin,
    {rnd('debt_equity')} as debt_equity, {rnd('debt_ebitda')} as debt_ebitda, {rnd('interest_coverage')} as interest_coverage,
    {rnd('fcf_yield')} as fcf_yield, {rnd('ev_ebit')} as ev_ebit, {rnd('pe_ratio')} as pe_ratio from rat""",
    "P8 P10 P11",
)
def _ratios(spark, sf):
    cols = "roe roic operating_margin debt_equity debt_ebitda interest_coverage fcf_yield ev_ebit pe_ratio".split()
    return ratio_table(spark, sf).select("symbol", "year", *[F.round(c, 6).alias(c) for c in cols])


@query(
    "history_five_year",
    with_inputs("fin", extra={"rat": RATIO_SQL, "hist": HIST_SQL})
    + f""" select symbol, year, {', '.join(f'{rnd(c)} as {c}' for c in
    'roe_avg roic_avg margin_avg pe_5y_avg fcf_yield_5y_avg roe_std margin_std'.split())} from hist""",
    "W19",
)
def _history(spark, sf):
    cols = "roe_avg roic_avg margin_avg pe_5y_avg fcf_yield_5y_avg roe_std margin_std".split()
    return history_table(spark, sf).select("symbol", "year", *[F.round(c, 6).alias(c) for c in cols])


SECTOR = "as_of_date, sector"
UNIVERSE = "as_of_date"
RANKS_SQL = f"""
select *, {pct('roe_avg', SECTOR)} as roe_r, {pct('roic_avg', SECTOR)} as roic_r, {pct('margin_avg', SECTOR)} as margin_r,
  {pct('fcf_yield', SECTOR)} as fy_r, {pct('ev_ebit', SECTOR)} as ev_r, {pct('pe_ratio', SECTOR)} as pe_r,
  {pct('disc', UNIVERSE)} as disc_r, {pct('prem', UNIVERSE)} as prem_r
from (select *, coalesce((nullif(pe_5y_avg, 0) - pe_ratio) / abs(nullif(pe_5y_avg, 0)), 0) as disc,
   coalesce((fcf_yield - nullif(fcf_yield_5y_avg, 0)) / abs(nullif(fcf_yield_5y_avg, 0)), 0) as prem from hist) h
"""
PARTS_SQL = f"""
select *,
 {clip("coalesce(roe_r,0.5)*0.4 + coalesce(roic_r,0.5)*0.3 + coalesce(margin_r,0.5)*0.3", 0, 1)} as q1,
 {clip('''0.5 * (case when roe_std is null then coalesce(roe_r,0.5)*0.7+0.15 else 1/(1+coalesce(abs(roe_std)/nullif(abs(roe_avg),0),0.5)) end)
  + 0.5 * (case when margin_std is null then coalesce(margin_r,0.5)*0.7+0.15 else 1/(1+coalesce(abs(margin_std)/nullif(abs(margin_avg),0),0.5)) end)''', 0, 1)} as q2,
 0.5 * coalesce(1 - {clip('debt_equity', 0, 3)}/3, 0.5) + 0.5 * coalesce({clip('interest_coverage', 0, 10)}/10, 0.5) as q3,
 {clip("coalesce(fy_r,0.5)*(0.25/0.60) + coalesce(1-ev_r,0.5)*(0.25/0.60) + coalesce(1-pe_r,0.5)*(0.10/0.60)", 0, 1)} as v1,
 0.5 * disc_r + 0.5 * prem_r as v2,
 coalesce(1 - {clip('debt_equity', 0, 3)}/3, 0.5)*0.5 + coalesce(1 - {clip('debt_ebitda', 0, 4)}/4, 0.5)*0.3
   + coalesce({clip('interest_coverage', 0, 10)}/10, 0.5)*0.2 as r1
from rk
"""
SCORED_SQL = f"""
select *, {even('0.50*q1 + 0.30*q2 + 0.20*q3', 3)} as sq, {even('0.60*v1 + 0.40*v2', 3)} as sv,
 {even('0.50*r1 + 0.30*((1-0.30/0.60)*(0.20/0.30) + (1-0.30/0.60)*(0.10/0.30)) + 0.20*(1-0.25/0.60)', 3)} as sr from parts
"""
V30 = {"rat": RATIO_SQL, "hist": HIST_SQL, "rk": RANKS_SQL, "parts": PARTS_SQL, "scored": SCORED_SQL,
       "comp": f"select *, {even('0.45*sv + 0.35*sq + 0.20*sr', 3)} as sc from scored"}


@query(
    "rank_within_sector",
    with_inputs("fin", extra={"rat": RATIO_SQL})
    + f""" select symbol, year, {rnd(pct('ev_ebit', SECTOR))} as ev_ebit_rank, {rnd('1 - ' + pct('pe_ratio', SECTOR))} as pe_rank_inverted,
    {rnd(pct('fcf_yield', UNIVERSE))} as fcf_yield_rank from rat""",
    "W1 W2",
)
def _sector_ranks(spark, sf):
    df = pct_ranks(
        ratio_table(spark, sf),
        ["as_of_date"],
        ["symbol"],
        [Rank("ev_ebit_rank", "ev_ebit", "sector"), Rank("pe_rank", "pe_ratio", "sector"), Rank("fcf_yield_rank", "fcf_yield")],
    )
    return df.select(
        "symbol",
        "year",
        F.round("ev_ebit_rank", 6).alias("ev_ebit_rank"),
        F.round(1 - F.col("pe_rank"), 6).alias("pe_rank_inverted"),
        F.round("fcf_yield_rank", 6).alias("fcf_yield_rank"),
    )


@query(
    "score_composite_v30",
    with_inputs("fin", extra=V30)
    + f""" select symbol, year, sq as score_quality_v30, sv as score_value_v30, sr as score_risk_v30, sc as score_composite_v30,
     {desc_rank('sc', UNIVERSE)} as rank_v30, sc >= 0.40 as passes_min_score_v30 from comp""",
    "C17 C18 C19 C20 F11 W3 P21",
)
def _composite(spark, sf):
    return scores_v30.composite_v30(history_table(spark, sf)).select(
        "symbol", "year", "score_quality_v30", "score_value_v30", "score_risk_v30", "score_composite_v30", "rank_v30", "passes_min_score_v30"
    )


@query(
    "top_holdings_v30",
    with_inputs("fin", extra=V30)
    + """ select as_of_date, symbol, company, sector, score_composite_v30, position from (
      select as_of_date, symbol, company, sector, sc as score_composite_v30,
       cast(row_number() over (partition by as_of_date order by sc desc, symbol) as int) as position
      from comp where sc >= 0.40) t where position <= 20""",
    "K1 K2 K3 K9",
)
def _top(spark, sf):
    scored = scores_v30.composite_v30(history_table(spark, sf), with_rank=False)
    return scores_v30.top_holdings(scored, columns=["symbol", "company", "sector", "score_composite_v30"])


@query(
    "value_cross_section_top20",
    with_inputs("fin", extra={"rat": RATIO_SQL, "rk": f"""select *, {pct('fcf_yield', SECTOR)} as a, {pct('ev_ebit', SECTOR)} as b,
      {pct('pe_ratio', SECTOR)} as c from rat""", "s": f"""select as_of_date, symbol, {even("coalesce(a,0.5)*(0.25/0.60) + coalesce(1-b,0.5)*(0.25/0.60) + coalesce(1-c,0.5)*(0.10/0.60)", 6)} as cross_section from rk"""})
    + """ select * from (select *, cast(row_number() over (partition by as_of_date order by cross_section desc, symbol) as int) as position from s) t where position <= 20""",
    "W2 K2",
)
def _minimum_slice(spark, sf):
    scored = scores_v30.score_value_v30(ratio_table(spark, sf))
    scored = scored.select("as_of_date", "symbol", (F.rint(F.col("value_cross_section") * 1e6) / 1e6).alias("cross_section"))
    return top_k(scored, ["as_of_date"], [F.col("cross_section").desc(), F.col("symbol")], 20, rank="position")


INSIDER_FIVE = "case when s6 % 5 = 0 then 0.8 else 0.3 end"


@query(
    "tie_breaker_v30",
    with_inputs("fin", extra=V30 | {"tb": "select *, cast(substr(symbol, 2) as bigint) as s6 from comp",
        "tb2": f"select *, sc + {INSIDER_FIVE} * 0.001 as st from tb"})
    + f""" select symbol, year, {rnd('st')} as score_with_tiebreaker, {desc_rank('st', UNIVERSE)} as rank_v30_final from tb2""",
    "C21",
)
def _tie(spark, sf):
    scored = scores_v30.composite_v30(history_table(spark, sf))
    scored = scored.withColumn("score_insider", F.when(F.substring("symbol", 2, 6).cast("bigint") % 5 == 0, 0.8).otherwise(0.3))
    return scores_v30.tie_breaker(scored).select(
        "symbol", "year", F.round("score_with_tiebreaker", 6).alias("score_with_tiebreaker"), "rank_v30_final"
    )


@query(
    "score_gate",
    with_inputs("fin", extra=V30)
    + """ select as_of_date, symbol, sc as score_composite_v30 from (select *, row_number() over (partition by as_of_date order by sc desc, symbol) as rn from comp where sc >= 0.45 and price >= 1450.0) t where rn <= 10""",
    "F10",
)
def _gate(spark, sf):
    from stratafin.operators.filters import score_gate

    scored = scores_v30.composite_v30(history_table(spark, sf), with_rank=False)
    out = score_gate(scored, score="score_composite_v30", min_score=0.45, min_price=1450.0, keep=10)
    return out.select("as_of_date", "symbol", "score_composite_v30")
