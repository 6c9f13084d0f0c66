"""Signal, value, quality, risk, composite, owner, crowding and grid scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.derive import table, with_inputs
from checks.q_scores30 import HIST_SQL, RATIO_SQL, SECTOR, UNIVERSE, history_table, ratio_table
from checks.q_screens import consensus
from checks.registry import clip, desc_rank, even, pct, query, rnd, steps
from stratafin import params as P
from stratafin.functions import grades, ratios
from stratafin.functions.scalar import half_even
from stratafin.operators import overlay, scores_v22, scores_v23, summaries
from stratafin.operators.history import history_arrays
from stratafin.operators.ranking import zscores
from stratafin.session import stage

# --- inputs: fundamentals with market cap, signals and vol -----------------------------------

# holder and insider signals beside the fundamentals, by deterministic formulas on the key columns
FULL = """select *, cast(floor(cash * 7) as bigint) % 13 as gp_buys, (cast(floor(cash * 3) as bigint) % 40) / 100.0 as gp_weight,
  case when cast(floor(cash * 7) as bigint) % 13 >= 8 then 'A' when cast(floor(cash * 7) as bigint) % 13 >= 6 then 'B' when cast(floor(cash * 7) as bigint) % 13 >= 3 then 'C' else 'D' end as gp_tier,
  cast(floor(cash) as bigint) % 4 as insider_buys, cast(floor(cash) as bigint) % 3 as insider_sells, ebit * 100.0 as insider_net_value,
  case when year = 1999 then null else cast(floor(cash) as bigint) % 100 + 0.5 end as rsi, cast(floor(cash * 11) as bigint) % 60 - 25.5 as perf_3m,
  cast(floor(cash * 5) as bigint) % 70 + 0.25 as vol_30d, cast(floor(cash * 11) as bigint) % 120 - 60.5 as perf_ytd,
  price * 0.8 as low_52w, price * (1.05 + (cast(floor(cash) as bigint) % 9) / 10.0) as high_52w,
  shares_outstanding * price as market_cap, net_income / shares_outstanding as eps from fin"""


def full_table(spark, sf):
    m = lambda k, n: F.floor(F.col("cash") * k).cast("bigint") % n
    return table(spark, sf, "fin").withColumns(
        {
            "gp_buys": m(7, 13),
            "gp_weight": m(3, 40) / 100.0,
            "gp_tier": F.when(m(7, 13) >= 8, "A").when(m(7, 13) >= 6, "B").when(m(7, 13) >= 3, "C").otherwise("D"),
            "insider_buys": m(1, 4),
            "insider_sells": m(1, 3),
            "insider_net_value": F.col("ebit") * 100.0,
            "rsi": F.when(F.col("year") == 1999, None).otherwise(m(1, 100) + 0.5),
            "perf_3m": m(11, 60) - 25.5,
            "vol_30d": m(5, 70) + 0.25,
            "perf_ytd": m(11, 120) - 60.5,
            "low_52w": F.col("price") * 0.8,
            "high_52w": F.col("price") * (1.05 + m(1, 9) / 10.0),
            "market_cap": F.col("shares_outstanding") * F.col("price"),
            "eps": F.col("net_income") / F.col("shares_outstanding"),
        }
    )


# --- signal scores -------------------------------------------------------------------------------

TIER = "case gp_tier when 'A' then 1.0 when 'B' then 0.75 when 'C' then 0.5 else 0.25 end"
RSI = "case when coalesce(rsi, 50) between 40 and 60 then 1.0 when (coalesce(rsi, 50) >= 30 and coalesce(rsi, 50) < 40) or (coalesce(rsi, 50) > 60 and coalesce(rsi, 50) <= 70) then 0.7 when coalesce(rsi, 50) < 30 then 0.8 else 0.3 end"
RANGE = "case when high_52w > low_52w and high_52w > 0 then greatest(0.0, 1 - abs((price - low_52w) / nullif(high_52w - low_52w, 0) - 0.5) * 2) else 0.5 end"
PERF = steps("coalesce(perf_3m, 0)", P.PERF_ADDON_LADDER, ">", "0.0")
SIGNAL_SQL = f"""select *, {even(f"({TIER}) * 0.25 + bk * 0.50 + least(gp_weight / 0.2, 1.0) * 0.25", 3)} as score_sm,
  {even(f"({TIER}) * 0.4 + least(gp_buys / 10.0, 1.0) * 0.4 + least(gp_weight / 0.2, 1.0) * 0.2", 3)} as score_sm_plain,
  {even("(case when insider_buys + insider_sells = 0 then 0.5 else insider_buys / nullif(insider_buys + insider_sells, 0)::double end) * 0.6 + (least(greatest(insider_net_value / 10000000.0, -1), 1) + 1) / 2 * 0.4", 3)} as score_insider,
  {even(f"least(({RSI}) * 0.4 + {PERF}, 1.0)", 3)} as score_momentum, {even(f"least(({RSI}) * 0.4 + ({RANGE}) * 0.3 + {PERF}, 1.0)", 3)} as score_momentum_range
  from (select *, {pct('gp_buys', UNIVERSE)} as bk from full0) z"""
SIG = {"full0": FULL, "sig": SIGNAL_SQL}


@query(
    "signal_scores",
    with_inputs("fin", extra=SIG) + " select symbol, year, score_sm, score_sm_plain, score_insider, score_momentum, score_momentum_range from sig",
    "C1 C2 C3 P16 P17 P18",
)
def _signals(spark, sf):
    out = scores_v22.signal_scores(full_table(spark, sf)).withColumns(
        {"score_sm_plain": scores_v22.holder_score(dedup=False), "score_momentum_range": scores_v22.momentum_score(with_range=True)}
    )
    return out.select("symbol", "year", "score_sm", "score_sm_plain", "score_insider", "score_momentum", "score_momentum_range")


PCT_RATIOS = """select *, case when equity > 0 then net_income / equity * 100 end as roe, net_income / nullif(revenue, 0) * 100 as net_margin,
   case when equity > 0 then total_debt / equity end as debt_equity, current_assets / nullif(current_liabilities, 0) as current_ratio,
   abs(capex) / nullif(revenue, 0) * 1000 as capex_ratio, gross_profit / nullif(revenue, 0) * 100 as gross_margin"""


def percent_ratios(df):
    positive = F.col("equity") > 0
    return df.withColumns(
        {
            "roe": F.when(positive, F.col("net_income") / F.nullif("equity", F.lit(0.0)) * 100),
            "net_margin": ratios.ratio("net_income", "revenue") * 100,
            "debt_equity": F.when(positive, F.col("total_debt") / F.nullif("equity", F.lit(0.0))),
            "current_ratio": ratios.ratio("current_assets", "current_liabilities"),
            "capex_ratio": ratios.ratio(F.abs("capex"), "revenue") * 1000,
            "gross_margin": ratios.ratio("gross_profit", "revenue") * 100,
        }
    )


def _pts(x, high, mid, low):
    return f"(case when {x} >= 0.8 then {high} when {x} >= 0.6 then {mid} when {x} < 0.2 then {low} else 0.0 end)"


CAPEX = "(case when capex_ratio is null then 0.0 when sector in ('Technology', 'Industrials', 'Communication Services') then 0.0 when capex_ratio < 5 then 0.10 when capex_ratio < 10 then 0.05 else 0.0 end)"
FCFP = "(case when fcf is null then 0.0 when fcf > 0 then 0.05 else -0.05 end)"
QRANK = {
    "full0": FULL,
    "pr": PCT_RATIOS + " from full0",
    "qr": f"select *, {pct('roe', SECTOR)} as r1, {pct('net_margin', SECTOR)} as r2, 1 - {pct('debt_equity', SECTOR)} as r3, {pct('current_ratio', SECTOR)} as r4 from pr",
    "qs": f"""select *, {even(clip(f"(0.5 + {_pts('r1', 0.20, 0.10, -0.15)} + {_pts('r2', 0.15, 0.10, -0.10)} + {_pts('r3', 0.15, 0.10, -0.10)} + (case when r4 >= 0.8 then 0.05 when r4 < 0.2 then -0.05 else 0.0 end) + {CAPEX} + {FCFP})", 0, 1), 3)} as score_quality from qr""",
}
QABS = f"""(0.5 + (case when roe is null then 0.0 when roe >= 25 then 0.20 when roe >= 15 then 0.15 when roe >= 10 then 0.10 when roe >= 0 then 0.05 else -0.15 end)
 + (case when debt_equity is null then 0.0 when debt_equity < 0.3 then 0.15 when debt_equity < 0.7 then 0.10 when debt_equity < 1.5 then 0.05 when debt_equity > 3 then -0.15 else -0.05 end)
 + (case when net_margin >= 20 then 0.15 when net_margin >= 10 then 0.10 when net_margin >= 5 then 0.05 when net_margin < 0 then -0.10 else 0.0 end)
 + (case when current_ratio >= 1.5 then 0.05 when current_ratio < 1 then -0.05 else 0.0 end) + {CAPEX} + {FCFP})"""


@query(
    "quality_sector_ranked",
    with_inputs("fin", extra=QRANK) + f" select symbol, year, {rnd('score_quality', 3)} as score_quality, {rnd('r3')} as debt_equity_rank from qs",
    "C4 W2",
)
def _quality22(spark, sf):
    out = scores_v22.quality_sector_ranked(percent_ratios(full_table(spark, sf)))
    return out.select("symbol", "year", F.round("score_quality", 3).alias("score_quality"), F.round("debt_equity_rank", 6).alias("debt_equity_rank"))


@query(
    "quality_absolute_points",
    with_inputs("fin", extra={"full0": FULL, "pr": PCT_RATIOS + " from full0"})
    + f" select symbol, year, {rnd(clip(QABS, 0, 1), 4)} as score_quality from pr",
    "C4",
)
def _quality_abs(spark, sf):
    out = scores_v22.quality_absolute(percent_ratios(full_table(spark, sf)))
    return out.select("symbol", "year", F.round("score_quality", 4).alias("score_quality"))


Z22 = {
    **QRANK,
    "sig": SIGNAL_SQL.replace("from full0", "from qs"),
    "z": """select *, (score_sm - avg(score_sm) over w) / nullif(stddev_samp(score_sm) over w, 0) as z1, (score_insider - avg(score_insider) over w) / nullif(stddev_samp(score_insider) over w, 0) as z2,
     (score_momentum - avg(score_momentum) over w) / nullif(stddev_samp(score_momentum) over w, 0) as z3, (score_quality - avg(score_quality) over w) / nullif(stddev_samp(score_quality) over w, 0) as z4 from sig window w as (partition by as_of_date)""",
    "c": "select *, 0.45 * coalesce(z1, 0) + 0.15 * coalesce(z2, 0) + 0.25 * coalesce(z3, 0) + 0.15 * coalesce(z4, 0) as sc from z",
}


@query(
    "composite_v22",
    with_inputs("fin", extra=Z22) + f" select symbol, year, {even('sc', 3)} as score_composite, {even('0.45 * score_sm + 0.15 * score_insider + 0.25 * score_momentum + 0.15 * score_quality', 3)} as score_raw from c",
    "C5 W4",
)
def _composite22(spark, sf):
    scored = scores_v22.quality_sector_ranked(scores_v22.signal_scores(percent_ratios(full_table(spark, sf))))
    raw = scores_v22.composite_v22(scored, use_zscore=False).withColumnRenamed("score_composite", "score_raw")
    out = scores_v22.composite_v22(raw)
    return out.select("symbol", "year", "score_composite", "score_raw")


@query(
    "zscore_universe",
    with_inputs("fin", extra={"z": "select symbol, year, (revenue - avg(revenue) over w) / nullif(stddev_samp(revenue) over w, 0) as a, (ebit - avg(ebit) over w) / nullif(stddev_samp(ebit) over w, 0) as b from fin window w as (partition by as_of_date)"})
    + f" select symbol, year, {rnd('a')} as revenue_z, {rnd('b')} as ebit_z from z",
    "W4",
)
def _zscore(spark, sf):
    out = zscores(table(spark, sf, "fin"), ["as_of_date"], ["revenue", "ebit"])
    return out.select("symbol", "year", F.round("revenue_z", 6).alias("revenue_z"), F.round("ebit_z", 6).alias("ebit_z"))


# --- value --------------------------------------------------------------------------------------------

EVE = "case when ebit > 0 then (market_cap + total_debt - cash) / ebit end"
VABS = {
    "full0": FULL,
    "v": f"select *, {EVE} as ee, case when eps > 0 then price / eps end as pe, fcf / nullif(market_cap, 0) as fy from full0",
    "md": "select as_of_date, sector, median(ee) as med from v group by all having count(ee) >= 3",
    "hp": "select symbol, median(pe) as hpe from v where year % 2 = 0 group by symbol",
    "vs": f"""select v.*, {steps('fy', P.FCF_YIELD_LADDER, '>', '0.0', '0.5')} as s1,
      case when ee is null then 0.5 else coalesce({steps('(ee / nullif(med, 0))', P.EV_EBIT_SECTOR_LADDER, '<', '0.20')}, {steps('ee', P.EV_EBIT_ABSOLUTE_LADDER, '<', '0.20')}) end as s2,
      case when pe is null or pe <= 0 then 0.5 else coalesce({steps('(pe / nullif(hpe, 0))', P.PE_HISTORY_LADDER, '<', '0.0')}, {steps('pe', P.PE_ABSOLUTE_LADDER, '<', '0.0')}) end as s3
      from v left join md using (as_of_date, sector) left join hp using (symbol)""",
}


@query(
    "sector_ev_ebit_medians",
    with_inputs("fin", extra=VABS) + f" select as_of_date, sector, {rnd('med')} as sector_ev_ebit from md",
    "A9",
)
def _medians(spark, sf):
    return scores_v23.sector_ev_ebit_medians(full_table(spark, sf)).withColumn("sector_ev_ebit", F.round("sector_ev_ebit", 6))


@query(
    "value_absolute",
    with_inputs("fin", extra=VABS)
    + f" select symbol, year, s1::double as score_value_fcf_yield, s2::double as score_value_ev_ebit, s3::double as score_value_mos, {even('0.4 * s1 + 0.4 * s2 + 0.2 * s3', 3)} as score_value from vs",
    "C6 J12 P15 A9",
)
def _value_abs(spark, sf):
    df = full_table(spark, sf)
    from stratafin.operators.ranking import quantiles

    pe = df.where(F.col("year") % 2 == 0).select("symbol", ratios.ratio_if_positive("price", "eps").alias("pe"))
    history = quantiles(pe, ["symbol"], "pe", {"historical_pe": 0.5}).drop("n_values")
    out = scores_v23.score_value_absolute(df, historical_pe=history)
    return out.select("symbol", "year", "score_value_fcf_yield", "score_value_ev_ebit", "score_value_mos", "score_value")


def _value_sql(part, gate):
    g = (lambda x: f"case when count({x}) over (partition by as_of_date) >= 5 then ") if gate else (lambda x: "case when true then ")
    return f"""select symbol, year, as_of_date, a, b, c, {even('0.4 * a + 0.4 * b + 0.2 * c', 3)} as score_value from (select symbol, year, as_of_date,
      coalesce({g('fcf_yield')} {pct('fcf_yield', part)} end, 0.5) as a, coalesce({g('ev_ebit')} 1 - {pct('ev_ebit', part)} end, 0.5) as b,
      coalesce({g('pe_ratio')} 1 - {pct('pe_ratio', part)} end, 0.5) as c from rat) z"""


@query(
    "value_cross_sectional",
    with_inputs("fin", extra={"rat": RATIO_SQL, "v": _value_sql(UNIVERSE, True)})
    + f" select symbol, year, {rnd('a')} as score_value_fcf_yield, {rnd('b')} as score_value_ev_ebit, {rnd('c')} as score_value_mos, score_value from v",
    "C7 C9 W1",
)
def _value_cs(spark, sf):
    out = scores_v23.score_value(full_table(spark, sf), "cross_sectional")
    return out.select("symbol", "year", *[F.round(c, 6).alias(c) for c in ("score_value_fcf_yield", "score_value_ev_ebit", "score_value_mos")], "score_value")


@query(
    "value_sector_neutral",
    with_inputs("fin", extra={"rat": RATIO_SQL, "v": _value_sql(SECTOR, False)})
    + f" select symbol, year, {rnd('a')} as score_value_fcf_yield, {rnd('b')} as score_value_ev_ebit, {rnd('c')} as score_value_mos, score_value from v",
    "C8 C9 W2",
)
def _value_sn(spark, sf):
    out = scores_v23.score_value(full_table(spark, sf), "sector_neutral")
    return out.select("symbol", "year", *[F.round(c, 6).alias(c) for c in ("score_value_fcf_yield", "score_value_ev_ebit", "score_value_mos")], "score_value")


@query(
    "value_distribution",
    with_inputs("fin", extra={"rat": RATIO_SQL, "v": _value_sql(UNIVERSE, True), "d": """select as_of_date, count(score_value) as n, avg(score_value) as m, stddev_samp(score_value) as s, min(score_value) as lo, max(score_value) as hi,
       count(distinct score_value) as u, quantile_cont(score_value, 0.25) as q1, median(score_value) as q2, quantile_cont(score_value, 0.75) as q3 from v group by as_of_date"""})
    + f""" select as_of_date, n as count, {even('m', 3)} as mean, {even('s', 3)} as std, {even('lo', 3)} as min, {even('hi', 3)} as max, u as unique_values, {even('q1', 3)} as q25, {even('q2', 3)} as median,
     {even('q3', 3)} as q75, {even('q3 - q1', 3)} as iqr, {even('s', 3)} < 0.10 or {even('q3 - q1', 3)} < 0.15 as clustering_warning from d""",
    "A12",
)
def _distribution(spark, sf):
    return summaries.score_distribution(scores_v23.score_value(full_table(spark, sf)))


# --- quality and risk ----------------------------------------------------------------------------------

QUAL = {
    "full0": FULL,
    "h": """select *, case when equity + total_debt - cash > 0 then ebit * 0.75 / (equity + total_debt - cash) else 0.0 end as ro, ebit / nullif(revenue, 0) as om, fcf / shares_outstanding as fs from full0""",
    "g": """select *, count(*) over w as n, avg(ro) over w as roic, avg(om) over w as mm, stddev_pop(om) over w as ms, first_value(fs) over w as f0, first_value(shares_outstanding) over w as s0,
       case when equity > 0 then total_debt / equity else 2.0 end as de, fcf / nullif(revenue, 0) as fm from h window w as (partition by symbol order by year rows between unbounded preceding and current row)""",
    "q": """select *, case when n >= 3 then roic when equity + total_debt - cash > 0 then ebit * 0.75 / (equity + total_debt - cash) end as r, case when n >= 3 then (case when mm > 0 then ms / mm else 1.0 end) else 0.25 end as cv,
      case when n >= 3 then (case when f0 > 0 and fs > 0 then power(fs / f0, 1.0 / (n - 1)) - 1 when f0 <= 0 and fs > 0 then 0.15 else -0.10 end)
       else (case when fm > 0.15 then 0.12 when fm > 0.10 then 0.08 when fm > 0.05 then 0.04 else 0.0 end) end as gr, n >= 2 and shares_outstanding / s0 - 1 < -0.02 as bb from g""",
    "qq": f"""select *, {steps('r', P.ROIC_LADDER, '>', '0.0', '0.5')} as q1, {steps('cv', P.MARGIN_CV_LADDER, '<', '0.0', '0.5')} as q2, {steps('gr', P.FCF_GROWTH_LADDER, '>', '0.0', '0.5')} as q3,
      case when bb and de < 1.0 then 1.0 when bb or de < 1.0 then 0.7 when de < 1.5 then 0.5 when de < 2.0 then 0.3 else 0.0 end::double as q4 from q""",
    "qt": f"select *, {even('0.35 * q1 + 0.25 * q2 + 0.20 * q3 + 0.20 * q4', 3)} as sq from qq",
}


def quality_inputs(spark, sf):
    invested = F.col("equity") + F.col("total_debt") - F.col("cash")
    df = full_table(spark, sf).withColumns(
        {
            "_ro": F.when(invested > 0, F.col("ebit") * 0.75 / F.nullif(invested, F.lit(0.0))).otherwise(0.0),
            "operating_margin": ratios.ratio("ebit", "revenue"),
        }
    )
    return history_arrays(
        df, {"roic_history": "_ro", "margin_history": "operating_margin", "fcf_history": "fcf", "shares_history": "shares_outstanding"}
    ).drop("_ro")


@query(
    "quality_v23",
    with_inputs("fin", extra=QUAL)
    + " select symbol, year, q1::double as score_quality_roic, q2::double as score_quality_margin, q3::double as score_quality_fcf_growth, q4::double as score_quality_discipline, sq as score_quality from qt",
    "C10 P15",
)
def _quality23(spark, sf):
    out = scores_v23.score_quality(quality_inputs(spark, sf))
    return out.select("symbol", "year", "score_quality_roic", "score_quality_margin", "score_quality_fcf_growth", "score_quality_discipline", "score_quality")


def _risk_sql(source):
    return {
        "r0": f"""select *, case when equity > 0 then total_debt / equity else 3.0 end as rde, case when ebit > 0 then (total_debt - cash) / (ebit * 1.2) else 5.0 end as rnd,
          case when interest_expense is null or interest_expense = 0 then (case when total_debt > 0 then total_debt * 0.05 end) else abs(interest_expense) end as ri, case when vol_30d > 1 then vol_30d else vol_30d * 100 end as rv from {source}""",
        "r1": f"""select *, case when rde < 0.3 and rnd < 1 then 1.0 when rde < 0.5 and rnd < 2 then 0.85 when rde < 1.0 and rnd < 3 then 0.65 when rde < 1.5 and rnd < 4 then 0.40 when rde < 2.0 then 0.20 else 0.0 end::double as k1,
          case when ri is null then 1.0 else {steps('(ebit / nullif(ri, 0))', P.COVERAGE_LADDER, '>', '0.0', '0.5')} end as k2, {steps('rv', P.VOLATILITY_LADDER, '<', '0.0', '0.5')} as k3 from r0""",
        "rk": f"select *, {even('0.5 * k1 + 0.3 * k2 + 0.2 * k3', 3)} as sr from r1",
    }


@query(
    "risk_v23",
    with_inputs("fin", extra={"full0": FULL, **_risk_sql("full0")})
    + " select symbol, year, k1::double as score_risk_leverage, k2::double as score_risk_coverage, k3::double as score_risk_volatility, sr as score_risk from rk",
    "C11",
)
def _risk23(spark, sf):
    out = scores_v23.score_risk(full_table(spark, sf))
    return out.select("symbol", "year", "score_risk_leverage", "score_risk_coverage", "score_risk_volatility", "score_risk")


PIPE = {
    "rat": RATIO_SQL,
    "vv": _value_sql(UNIVERSE, True),
    **QUAL,
    **_risk_sql("qt"),
    "all0": "select rk.*, vv.score_value as sv from rk join vv using (symbol, year)",
    "zz": "select *, " + ", ".join(f"coalesce(({c} - avg({c}) over w) / nullif(stddev_samp({c}) over w, 0), 0) as z_{c}" for c in ("sv", "sq", "sr")) + " from all0 window w as (partition by as_of_date)",
    "co": f"select *, (0.30 / 0.70) * z_sv + (0.25 / 0.70) * z_sq + (0.15 / 0.70) * z_sr as sc, {even('(sv + sq + sr) / 3', 3)} as core from zz",
}


def pipeline_table(spark, sf):
    return scores_v23.score_pipeline(quality_inputs(spark, sf))


@query(
    "composite_v23_pipeline",
    with_inputs("fin", extra=PIPE)
    + f" select symbol, year, sv as score_value, sq as score_quality, sr as score_risk, {even('sc', 4)} as score_composite, core as core_score, {desc_rank('core', UNIVERSE)} as rank_core from co",
    "C12 C13 P21 W3 W4",
)
def _pipeline(spark, sf):
    return pipeline_table(spark, sf).select(
        "symbol", "year", "score_value", "score_quality", "score_risk", "score_composite", "core_score", "rank_core"
    )


# --- owner overlay --------------------------------------------------------------------------------------

OWN = {
    "rat": RATIO_SQL,
    "hist": HIST_SQL,
    "o": f"""select *, least(greatest((net_income - operating_cash_flow) / nullif(total_assets, 0), -0.5), 0.5) as ac, case when fcf is not null and net_income <> 0 then least(greatest(fcf / nullif(net_income, 0), -2), 3) end as fn,
      0.40 * coalesce({clip('roic_avg', 0, 0.25)} / 0.25, 0.5) + 0.30 * coalesce({clip('roe_avg', 0, 0.30)} / 0.30, 0.5) + 0.30 * 0.5 as moat from hist""",
    "o1": f"select *, 0.60 * coalesce(({clip('fn', 0.3, 1.5)} - 0.3) / 1.2, 0.5) + 0.40 * coalesce(1 - {clip('ac', 0, 0.20)} / 0.20, 0.5) as cashq from o",
    "o2": f"select *, {even('0.40 * moat + 0.25 * cashq + 0.20 * 0.5 + 0.15 * 0.5', 3)} as oq from o1",
    "o3": f"select *, {even('0.60 * oq + 0.40 * 0.5', 3)} as so from o2",
}


@query(
    "owner_score",
    with_inputs("fin", extra=OWN)
    + f" select symbol, year, {rnd('moat')} as score_moat, {rnd('cashq')} as score_cash, oq as score_owner_quality, so as score_owner, {desc_rank('so', UNIVERSE)} as rank_owner from o3",
    "C14 C15 C16",
)
def _owner(spark, sf):
    out = overlay.owner_score(ratios.earnings_features(history_table(spark, sf)))
    return out.select("symbol", "year", F.round("score_moat", 6).alias("score_moat"), F.round("score_cash", 6).alias("score_cash"), "score_owner_quality", "score_owner", "rank_owner")


@query(
    "eligible_universe_stats",
    with_inputs("fin", extra={"e": """select as_of_date, case when total_assets <> 0 then least(greatest((net_income - operating_cash_flow) / nullif(total_assets, 0), -0.5), 0.5) end as ac, case when net_income <> 0 then least(greatest(fcf / nullif(net_income, 0), -2), 3) end as fn from fin"""})
    + f""" select as_of_date, count(*) as total_tickers, count(ac) as with_accruals, count(fn) as with_fcf_ni, {even('avg(ac)', 4)} as accruals_mean, {even('avg((ac < 0.05)::int) * 100', 1)} as accruals_low_pct,
     {even('avg(fn)', 2)} as fcf_ni_mean, {even('avg((fn > 1)::int) * 100', 1)} as fcf_ni_above_1_pct, {even('median(ac)', 4)} as accruals_median from e group by as_of_date""",
    "A14",
)
def _eligible_stats(spark, sf):
    return summaries.eligible_universe_stats(ratios.earnings_features(table(spark, sf, "fin")))


@query(
    "eligible_sector_counts",
    with_inputs("fin", extra={"e": "select as_of_date, case when year = 1996 then null else sector end as sector from fin where total_debt < equity"})
    + " select as_of_date, coalesce(sector, 'Unknown') as sector, count(*) as tickers from e group by 1, 2",
    "A14",
)
def _eligible_sectors(spark, sf):
    rows = table(spark, sf, "fin").where("total_debt < equity")
    return summaries.eligible_sector_counts(rows.withColumn("sector", F.when(F.col("year") != 1996, F.col("sector"))))


@query(
    "ratio_coverage",
    with_inputs("fin", extra={"c": "select as_of_date, case when year % 2 = 0 and equity > 2000000 then null else interest_expense end as a, case when equity < 1000000 then null else ebit end as b from fin"})
    + f" select as_of_date, count(*) as rows, count(*) filter (where a is not null or b is not null) as covered, {rnd('count(*) filter (where a is not null or b is not null) / count(*)::double')} as coverage, count(*) filter (where a is not null or b is not null) / count(*)::double < 0.5 as low_coverage from c group by as_of_date",
    "A15",
)
def _coverage(spark, sf):
    df = table(spark, sf, "fin").select(
        "as_of_date",
        F.when((F.col("year") % 2 == 0) & (F.col("equity") > 2000000), None).otherwise(F.col("interest_expense")).alias("a"),
        F.when(F.col("equity") < 1000000, None).otherwise(F.col("ebit")).alias("b"),
    )
    return summaries.coverage(df, ["a", "b"]).withColumn("coverage", F.round("coverage", 6))


@query(
    "run_summary",
    with_inputs("fin", extra={"rat": RATIO_SQL, "v": _value_sql(UNIVERSE, True)})
    + f" select as_of_date, count(*) as universe_size, count(distinct sector) as n_sectors, {even('avg(v.score_value)', 3)} as avg_score_value, {even('avg((v.score_value > 0.5)::int) * 100', 1)} as eligible_pct from v join fin using (symbol, year, as_of_date) group by as_of_date",
    "A16",
)
def _run_summary(spark, sf):
    scored = scores_v23.score_value(full_table(spark, sf)).withColumn("eligible", F.col("score_value") > 0.5)
    return summaries.run_summary(scored, ["score_value"], eligible="eligible")


# --- crowding --------------------------------------------------------------------------------------------

CROWD = {
    "ft": "select as_of_date, fund, sum(value) as tot from hold group by 1, 2",
    "cons": "select h.as_of_date, year, symbol, count(distinct h.fund) as nf, round(avg(value / nullif(tot, 0)), 8) as aw from hold h join ft using (as_of_date, fund) group by 1, 2, 3",
    "cl": "select c.*, c.nf - p.nf as ch from cons c left join cons p on c.symbol = p.symbol and c.year = p.year + 1",
    "cr": f"select *, 0.4 * {pct('nf', UNIVERSE)} + 0.3 * {pct('aw', UNIVERSE)} + 0.3 * {pct('(case when ch is not null then greatest(ch, 0) end)', UNIVERSE)} as cs from cl",
    "cp": f"select *, {pct('cs', UNIVERSE)} as cpct, row_number() over (partition by as_of_date order by symbol) as rn from cr",
    "ct": "select *, case when cpct is null then null when cpct <= 0.5 then 'low' when cpct <= 0.75 then 'medium' when cpct <= 0.90 then 'high' else 'extreme' end as tier from cp",
}


def crowded(spark, sf):
    from pyspark.sql import Window

    c = consensus(spark, sf).withColumns({"avg_hf_weight": F.round("avg_hf_weight", 8), "year": F.year("as_of_date"), "holder_score": F.lit(0.8)})
    w = Window.partitionBy("symbol").orderBy("year")
    change = F.when(F.lag("year").over(w) == F.col("year") - 1, F.col("nb_hedge_funds") - F.lag("nb_hedge_funds").over(w))
    return overlay.crowding(c.withColumn("hf_change_3m", change))


@query(
    "crowding_score",
    with_inputs("hold", extra=CROWD)
    + f" select as_of_date, symbol, {rnd('cs')} as crowding_score, {rnd('cpct')} as crowding_percentile, tier as crowding_tier, {rnd('0.8 * (1 - 0.5 * cs)')} as holder_adjusted from ct",
    "C22 P20 W1",
)
def _crowding(spark, sf):
    out = crowded(spark, sf)
    cols = ["crowding_score", "crowding_percentile", "holder_adjusted"]
    return out.select("as_of_date", "symbol", "crowding_tier", *[F.round(c, 6).alias(c) for c in cols])


@query(
    "most_crowded",
    with_inputs("hold", extra={**CROWD, "q": "select as_of_date, quantile_cont(cs, 0.9) as lim from ct group by as_of_date"})
    + f" select as_of_date, symbol, {rnd('cs')} as crowding_score from ct join q using (as_of_date) where cs >= lim",
    "K4",
)
def _most_crowded(spark, sf):
    return overlay.most_crowded(crowded(spark, sf)).select("as_of_date", "symbol", F.round("crowding_score", 6).alias("crowding_score"))


@query(
    "crowding_diagnosis",
    with_inputs("hold", extra={**CROWD, "q": "select as_of_date, quantile_cont(cs, 0.9) as lim, avg(cs) as ua from ct group by as_of_date",
      "d": "select as_of_date, avg(cs) as pa, avg((cs >= lim)::int) * 100 as top, count(*) filter (where tier = 'extreme') as nx, any_value(ua) as ua from ct join q using (as_of_date) where symbol like '%7' group by as_of_date"})
    + f""" select as_of_date, {even('pa', 3)} as portfolio_avg_crowding, {even('ua', 3)} as universe_avg_crowding, {even('pa - ua', 3)} as crowding_vs_universe, {even('top', 1)} as pct_in_top_10_crowded,
      nx as nb_extreme_positions, top > 30 as warning from d""",
    "A13 J10",
)
def _crowding_diagnosis(spark, sf):
    universe = stage(crowded(spark, sf))
    return overlay.crowding_diagnosis(universe.where(F.col("symbol").endswith("7")), universe)


# --- grid ----------------------------------------------------------------------------------------------------

GRID = {
    "own": "select as_of_date, symbol as ticker, count(distinct fund)::double as value from hold where symbol not like '%3' group by 1, 2",
    "buy": "select as_of_date, symbol as ticker, sum(n_lines)::double as value from hold where symbol not like '%4' group by 1, 2",
    "oz": "select distinct as_of_date, symbol as ticker from hold where symbol like '%3' or symbol like '%13'",
    "bz": "select distinct as_of_date, symbol as ticker from hold where symbol like '%24' or symbol like '%54'",
    "orr": "select *, row_number() over (partition by as_of_date order by value desc, md5(ticker)) as r, count(*) over (partition by as_of_date) as n from own",
    "brr": "select *, row_number() over (partition by as_of_date order by value desc, md5(ticker)) as r, count(*) over (partition by as_of_date) as n from buy",
    "j": """select coalesce(o.as_of_date, b.as_of_date) as as_of_date, coalesce(o.ticker, b.ticker) as ticker, o.r as orank, b.r as brank,
      coalesce(floor((1 - (o.r - 1) / greatest(o.n - 1, 1)::double) * 100 + 0.5), 0) as os, coalesce(floor((1 - (b.r - 1) / greatest(b.n - 1, 1)::double) * 100 + 0.5), 0) as bs
      from orr o full join brr b on o.as_of_date = b.as_of_date and o.ticker = b.ticker""",
    "jz": "select j.*, oz.ticker is not null as ozf, bz.ticker is not null as bzf from j left join oz on j.ticker = oz.ticker and j.as_of_date = oz.as_of_date left join bz on j.ticker = bz.ticker and j.as_of_date = bz.as_of_date",
    "gs": """select *, orank is not null and brank is not null as in_both, coalesce(orank <= 50 and brank <= 50, false) as bonus, floor(case when orank <= 50 and brank <= 50 then (os + bs) / 2 * 1.2 when orank is not null and brank is not null then (os + bs) / 2
      when orank is not null and not bzf then os * 0.5 when orank is not null then os * 0.3 when brank is not null and not ozf then bs * 0.5 when brank is not null then bs * 0.4 else 0.0 end + 0.5)::int as cs from jz""",
}


def grid(spark, sf):
    hold = stage(table(spark, sf, "hold").withColumnRenamed("symbol", "ticker"))
    end = lambda *s: sum((F.col("ticker").endswith(x).cast("int") for x in s), F.lit(0)) > 0
    own = hold.where(~end("3")).groupBy("as_of_date", "ticker").agg(F.countDistinct("fund").cast("double").alias("value"))
    buy = hold.where(~end("4")).groupBy("as_of_date", "ticker").agg(F.sum("n_lines").cast("double").alias("value"))
    keys = hold.select("as_of_date", "ticker").distinct()
    return overlay.grid_score(own, buy, keys.where(end("3", "13")), keys.where(end("24", "54")))


@query(
    "grid_score",
    with_inputs("hold", extra=GRID)
    + " select as_of_date, ticker, orank::int as ownership_rank, brank::int as buys_rank, os::int as ownership_score, bs::int as buys_score, cs as composite_score, in_both, bonus, ozf as ownership_zero, bzf as buys_zero from gs",
    "C23 J14 D3",
)
def _grid(spark, sf):
    return grid(spark, sf).drop("ownership_value", "buys_value")


@query(
    "grid_summary",
    with_inputs("hold", extra=GRID)
    + " select as_of_date, count(*) as total_unique, count(orank) as in_ownership, count(brank) as in_buys, count(*) filter (where in_both) as in_both, count(*) filter (where bonus) as with_bonus from gs group by as_of_date",
    "A8",
)
def _grid_summary(spark, sf):
    return overlay.grid_summary(grid(spark, sf))


# --- grades ----------------------------------------------------------------------------------------------------


def grade_inputs(spark, sf):
    return percent_ratios(full_table(spark, sf)).withColumn("sector", F.when(F.col("sector") == "ASIA", "Energy").otherwise(F.col("sector")))


@query(
    "company_grades",
    with_inputs("fin", extra={"full0": FULL, "pr": PCT_RATIOS + " from full0", "g": """select *, case when fcf is not null and net_income <> 0 then (case when net_income > 0 then fcf / net_income else -1.0 end) end as cv,
      case when debt_equity is null then null when debt_equity < 0.3 then 3 when debt_equity < 0.8 then 2 when debt_equity < 1.5 then 1 else 0 end as p1,
      case when current_ratio is null then null when current_ratio > 2 then 3 when current_ratio > 1.5 then 2 when current_ratio > 1 then 1 else 0 end as p2,
      case when roe is null then null when roe > 20 then 3 when roe > 15 then 2 when roe > 10 then 1 else 0 end as p3,
      (case when net_margin > 20 then 2 when net_margin > 10 then 1 else 0 end) + (case when roe > 20 and debt_equity < 0.5 and debt_equity <> 0 then 2 when roe > 15 then 1 else 0 end) + (case when gross_margin > 50 then 1 else 0 end) as mp from pr""",
      "h": "select *, (coalesce(p1, 0) + coalesce(p2, 0) + coalesce(p3, 0)) / nullif((p1 is not null)::int + (p2 is not null)::int + (p3 is not null)::int, 0)::double as bp from g"})
    + f""" select symbol, year, {even('cv', 2)} as fcf_vs_income, case when cv is null then 'N/A' when cv >= 1.2 then 'A' when cv >= 0.8 then 'B' when cv >= 0.5 then 'C' else 'D' end as earnings_grade,
     case when capex_ratio > 15 then 'high' when capex_ratio > 8 then 'moderate' when capex_ratio is not null then 'low' end as capex_class,
     case when bp is null then 'insufficient' when bp >= 2.5 then 'institutional' when bp >= 1.5 then 'acceptable' else 'fragile' end as balance_class, mp as moat_points,
     case when mp >= 4 then 'probable' when mp >= 2 then 'possible' else 'uncertain' end as moat_class, case when sector = 'ASIA' then 'Prix commodities' else 'Analyse spécifique requise' end as first_risk from h""",
    "C25 C26 C27 J13",
)
def _grades(spark, sf):
    out = grades.with_sector_profile(grades.moat_indicators(grades.balance_sheet_grade(grades.earnings_quality(grade_inputs(spark, sf)))))
    return out.select("symbol", "year", "fcf_vs_income", "earnings_grade", "capex_class", "balance_class", "moat_points", "moat_class", F.col("typical_risks")[0].alias("first_risk"))
