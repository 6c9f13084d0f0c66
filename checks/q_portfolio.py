"""Weights, allocation, backtests, comparison and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.derive import table, with_inputs
from checks.q_scores23 import FULL, PCT_RATIOS, _risk_sql, full_table, percent_ratios
from checks.q_scores30 import V30, history_table
from checks.q_series import FACTORS, PATH, QSTARTS, SER, STRESS, W, benchmark_returns, quarter_instants, series_returns, stress_results
from checks.registry import even, pct, query, rnd, steps
from stratafin import params as P
from stratafin.operators import alerts, allocation, rebalance, scores_v30, weights
from stratafin.operators.ranking import top_k
from stratafin.operators.series import simple_returns
from stratafin.params import Constraints, Publication
from stratafin.plans import backtest, calendar, compare, metrics, stress
from stratafin.session import stage

BY = ["as_of_date"]

# --- positions: top 20 names per date by composite, equal weights ---------------------------------------

POS = {
    **V30,
    "tp": "select * from (select *, row_number() over (partition by as_of_date order by sc desc, symbol) as rn from comp where sc >= 0.40) t where rn <= 20",
    "ew": "select *, least(1.0 / count(*) over (partition by as_of_date), 0.12) as w0 from tp",
    "pw": "select *, w0 / sum(w0) over (partition by as_of_date) as weight from ew",
}


def positions(spark, sf):
    scored = scores_v30.composite_v30(history_table(spark, sf), with_rank=False)
    top = scores_v30.top_holdings(scored).drop("position")
    return weights.equal_weights(top, BY)


@query(
    "equal_weights_capped",
    with_inputs("fin", extra=POS) + f" select as_of_date, symbol, {rnd('weight')} as weight from pw",
    "B8 K3",
)
def _equal(spark, sf):
    return positions(spark, sf).select("as_of_date", "symbol", F.round("weight", 6).alias("weight"))


# score-proportional weights, so that caps bind
RAWW = {
    **POS,
    "rw": "select *, power(sc, 6) as p6 from tp",
    "sw": "select *, p6 / sum(p6) over (partition by as_of_date) as weight0 from rw",
}


def raw_weights(spark, sf):
    rows = positions(spark, sf).withColumn("weight", F.pow("score_composite_v30", 6))
    return weights.normalise(rows, BY)


@query(
    "cap_once",
    with_inputs("fin", extra={**RAWW, "c": "select as_of_date, symbol, least(weight0, 0.055) as w from sw"})
    + f" select as_of_date, symbol, {rnd('w / sum(w) over (partition by as_of_date)')} as weight from c",
    "B7",
)
def _cap_once(spark, sf):
    out = weights.cap_once(raw_weights(spark, sf), BY, 0.055)
    return out.select("as_of_date", "symbol", F.round("weight", 6).alias("weight"))


SECTOR_CAP = {
    **RAWW,
    "sc1": "select *, sum(weight0) over (partition by as_of_date, sector) as sw from sw",
    "sc2": "select *, case when sw > 0.25 then weight0 * 0.25 / sw else weight0 end as w1 from sc1",
    "sc3": "select *, w1 / sum(w1) over (partition by as_of_date) as weight from sc2",
}


@query("sector_cap_once", with_inputs("fin", extra=SECTOR_CAP) + f" select as_of_date, symbol, {rnd('weight')} as weight from sc3", "B9")
def _sector_cap(spark, sf):
    out = weights.sector_cap_once(raw_weights(spark, sf), BY, 0.25)
    return out.select("as_of_date", "symbol", F.round("weight", 6).alias("weight"))


@query(
    "score_tilt",
    with_inputs("fin", extra={**POS, "t": "select *, weight * exp(0.5 * (sc - avg(sc) over w) / coalesce(nullif(stddev_pop(sc) over w, 0), 1)) as t, weight * sc / avg(sc) over w as l from pw window w as (partition by as_of_date)"})
    + f" select as_of_date, symbol, {rnd('t / sum(t) over (partition by as_of_date)')} as weight, {rnd('l / sum(l) over (partition by as_of_date)')} as weight_linear from t",
    "B5 P19",
)
def _tilt(spark, sf):
    rows = stage(positions(spark, sf))
    linear = weights.score_tilt(rows, BY, "score_composite_v30", use_zscore=False).select("as_of_date", "symbol", F.col("weight").alias("weight_linear"))
    out = weights.score_tilt(rows, BY, "score_composite_v30").join(linear, ["as_of_date", "symbol"])
    return out.select("as_of_date", "symbol", F.round("weight", 6).alias("weight"), F.round("weight_linear", 6).alias("weight_linear"))


@query(
    "constraint_check",
    with_inputs("fin", extra={**RAWW, "p": "select *, row_number() over (partition by as_of_date order by weight0 desc, symbol) as pl from sw",
      "se": "select as_of_date, sector, sum(weight0) as s from sw group by 1, 2", "sx": "select as_of_date, max(s) as ms, count(*) as ns from se group by 1",
      "f": "select as_of_date, max(weight0) as mx, min(weight0) as mn, sum(weight0) as t, count(*) as n, sum(weight0) filter (where pl <= 5) as t5, sum(weight0) filter (where pl <= 10) as t10 from p group by 1",
      "fx": "select * from f join sx using (as_of_date)"})
    + f""" select as_of_date, 'max_weight' as rule, {rnd('mx')} as actual, 0.12::double as "limit", mx > 0.12 + 0.005 as violated from fx union all select as_of_date, 'max_sector', {rnd('ms')}, 0.30, ms > 0.30 + 0.005 from fx
      union all select as_of_date, 'total', {rnd('t')}, 1.0, abs(t - 1.0) > 0.001 from fx union all select as_of_date, 'min_weight', {rnd('mn')}, 0.03, mn < 0.03 - 0.005 from fx
      union all select as_of_date, 'min_sectors', ns, 4, ns < 4 from fx union all select as_of_date, 'min_positions', n, 12, n < 12 from fx
      union all select as_of_date, 'max_top5', {rnd('t5')}, 0.40, t5 > 0.40 + 0.005 from fx union all select as_of_date, 'max_top10', {rnd('t10')}, 0.70, t10 > 0.70 + 0.005 from fx""",
    "B10 B11 A11",
)
def _constraints(spark, sf):
    return weights.constraint_check(stage(raw_weights(spark, sf)), BY).withColumn("actual", F.round("actual", 6))


PM = {**{k: v for k, v in {"full0": FULL, "pr": PCT_RATIOS + " from full0"}.items()},
      "pp": "select pr.*, 1.0 / 20 as weight from (select *, row_number() over (partition by as_of_date order by cash desc, symbol) as rn from pr) pr where rn <= 20"}


def metric_positions(spark, sf):
    rows = top_k(percent_ratios(full_table(spark, sf)), BY, [F.col("cash").desc(), F.col("symbol")], 20)
    return rows.withColumn("weight", F.lit(1.0) / 20)


@query(
    "portfolio_metrics",
    with_inputs("fin", extra={**PM, "s": "select as_of_date, string_agg(sector || '=' || x, ';' order by sector) as sector_weights from (select as_of_date, sector, cast(round_even(sum(weight) * 1000, 0) / 10 as double) as x from pp group by 1, 2) z group by 1"})
    + f""" select as_of_date, count(*) as positions, {even('sum(weight * coalesce(perf_3m, 0))', 2)} as perf_3m, {even('sum(weight * coalesce(perf_ytd, 0))', 2)} as perf_ytd,
      {even('sqrt(sum(weight * weight * power(coalesce(vol_30d, 25) / 100, 2))) * 100', 2)} as vol_30d, {even('avg(roe)', 1)} as avg_roe, {even('avg(debt_equity)', 2)} as avg_debt_equity, {even('avg(net_margin)', 1)} as avg_net_margin,
      any_value(s.sector_weights) as sector_weights from pp join s using (as_of_date) group by as_of_date""",
    "A10 A11",
)
def _portfolio_metrics(spark, sf):
    out = weights.portfolio_metrics(stage(metric_positions(spark, sf)), BY)
    text = F.array_join(F.transform(F.map_entries("sector_weights"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")
    return out.withColumn("sector_weights", text)


@query(
    "largest_sector",
    with_inputs("fin", extra={**RAWW, "s": "select as_of_date, sector, sum(weight0) as x from sw group by 1, 2", "m": "select as_of_date, max(x) as mx, count(*) as n from s group by 1"})
    + f" select as_of_date, {rnd('mx')} as max_sector_weight, (select min(sector) from s where s.as_of_date = m.as_of_date and s.x = m.mx) as max_sector_name, n as n_sectors from m",
    "A11",
)
def _largest(spark, sf):
    return weights.largest_sector(raw_weights(spark, sf), BY).withColumn("max_sector_weight", F.round("max_sector_weight", 6))


@query(
    "position_contributions",
    with_inputs("fin", extra={**PM, "c": "select as_of_date, symbol, weight * coalesce(perf_3m, 0) as ct from pp"})
    + f" select * from (select as_of_date, symbol, {rnd('ct')} as contribution, row_number() over (partition by as_of_date order by ct desc, symbol) <= 3 as is_top, row_number() over (partition by as_of_date order by ct, symbol) <= 3 as is_bottom from c) z where is_top or is_bottom",
    "A18",
)
def _contrib(spark, sf):
    out = weights.contributions(metric_positions(spark, sf), BY).where("is_top or is_bottom")
    return out.select("as_of_date", "symbol", F.round("contribution", 6).alias("contribution"), "is_top", "is_bottom")


MARKET = {"pe": 22.0, "roe": 18.0, "perf_3m": 3.0, "fcf_yield": 0.04, "margin": 11.0}
BETAS = {"AFRICA": 1.2, "ASIA": 0.9, "EUROPE": 1.05}


@query(
    "factor_exposures",
    with_inputs("fin", extra={**PM, "p2": "select *, case when net_income > 0 then price / (net_income / shares_outstanding) end as pe_ratio, fcf / market_cap as fcf_yield from pp",
      "s": "select as_of_date, max(x) as ms from (select as_of_date, sector, sum(weight) as x from pp group by 1, 2) z group by 1",
      "f": "select as_of_date, sum(weight * coalesce(pe_ratio, 20)) as pe, sum(weight * coalesce(fcf_yield, 0)) as fy, sum(weight * coalesce(roe, 15)) as ro, sum(weight * coalesce(net_margin, 10)) as ma, sum(weight * coalesce(perf_3m, 0)) as pf, sum(weight * coalesce(rsi, 50)) as rs, max(weight) as mp, sum(weight * weight) as hh, sum(weight * case sector when 'AFRICA' then 1.2 when 'ASIA' then 0.9 when 'EUROPE' then 1.05 else 1.0 end) as be from p2 group by 1"})
    + f""" select as_of_date, {rnd('pe')} as portfolio_pe, {rnd('fy')} as portfolio_fcf_yield, {rnd('ro')} as portfolio_roe, {rnd('ma')} as portfolio_margin, {rnd('rs')} as avg_rsi, {rnd('mp')} as max_position, {rnd('hh')} as hhi, {rnd('be')} as sector_beta, {rnd('ms')} as max_sector,
     {rnd('pe / 22.0')} as pe_vs_market, {rnd('ro / 18.0')} as roe_vs_market, {rnd('pf - 3.0')} as perf_3m_relative, {rnd('(-(pe / 22.0 - 1) + (fy / 0.04 - 1)) / 2')} as value_tilt, {rnd('((ro / 18.0 - 1) + (ma / 11.0 - 1)) / 2')} as quality_tilt from f join s using (as_of_date)""",
    "A40",
)
def _exposures(spark, sf):
    from stratafin.functions.ratios import ratio_if_positive

    rows = metric_positions(spark, sf).withColumns({"pe_ratio": ratio_if_positive("price", "eps"), "fcf_yield": F.col("fcf") / F.col("market_cap")})
    out = weights.factor_exposures(stage(rows), BY, MARKET, BETAS)
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c != "as_of_date"})


# --- snapshots -----------------------------------------------------------------------------------------------

SNAP = {
    **POS,
    "dts": "select as_of_date as d, lead(as_of_date) over (order by as_of_date) as nx, lag(as_of_date) over (order by as_of_date) is null as first from (select distinct as_of_date from pw) z",
    "nw": "select as_of_date as date, symbol, weight from pw where as_of_date not in (select d from dts where first)",
    "od": "select nx as date, symbol, weight from pw join dts on as_of_date = d where nx is not null",
    "chg": "select coalesce(n.date, o.date) as date, coalesce(n.symbol, o.symbol) as symbol, coalesce(o.weight, 0) as ow, coalesce(n.weight, 0) as nww from nw n full join od o on n.date = o.date and n.symbol = o.symbol",
}


def snapshot_rows(spark, sf):
    return positions(spark, sf).select(F.lit("p").alias("portfolio_id"), F.col("as_of_date").alias("date"), "symbol", "weight")


@query(
    "snapshot_changes",
    with_inputs("fin", extra=SNAP) + f" select date, symbol, {rnd('ow')} as old_weight, {rnd('nww')} as new_weight, {rnd('nww - ow')} as change from chg",
    "D1 D2 W17",
)
def _changes(spark, sf):
    out = weights.snapshot_changes(snapshot_rows(spark, sf), ["portfolio_id"])
    return out.select("date", "symbol", *[F.round(c, 6).alias(c) for c in ("old_weight", "new_weight", "change")])


@query(
    "snapshot_turnover",
    with_inputs("fin", extra=SNAP)
    + f""" select date, {rnd('sum(abs(nww - ow)) / 2')} as turnover, count(*) filter (where nww <> 0 and ow = 0) as entries, count(*) filter (where nww = 0 and ow <> 0) as exits, count(*) filter (where nww <> 0 and ow <> 0) as unchanged,
      count(*) filter (where abs(nww - ow) > 0.01) as trades from chg group by date""",
    "D1 D2",
)
def _turnover(spark, sf):
    out = weights.turnover(weights.snapshot_changes(snapshot_rows(spark, sf), ["portfolio_id"]), ["portfolio_id"])
    return out.drop("portfolio_id").withColumn("turnover", F.round("turnover", 6))


@query(
    "annual_turnover",
    with_inputs("fin", extra=SNAP)
    + f" select 'p' as portfolio_id, {even('sum(abs(nww - ow)) / 2 * 252 / (select count(distinct as_of_date) from pw) * 100', 1)} as turnover_annual, count(*) filter (where abs(nww - ow) > 0.01) as num_trades from chg",
    "A26",
)
def _annual_turnover(spark, sf):
    return weights.annual_turnover(snapshot_rows(spark, sf), ["portfolio_id"])


@query(
    "no_trade_zone",
    with_inputs("fin", extra={**SNAP, "z": "select date, symbol, case when ow > 0 and nww > 0 and abs(nww - ow) < 0.01 then ow else nww end as w from chg"})
    + f" select date, symbol, {rnd('w / sum(w) over (partition by date)')} as weight from z where w > 0",
    "B23",
)
def _no_trade(spark, sf):
    out = weights.no_trade_zone(weights.snapshot_changes(snapshot_rows(spark, sf), ["portfolio_id"]), ["portfolio_id"])
    return out.select("date", "symbol", F.round("weight", 6).alias("weight"))


@query(
    "turnover_budget",
    with_inputs("fin", extra={**SNAP, "t": "select date, sum(abs(nww - ow)) / 2 as t from chg group by date"})
    + f" select year(date)::int as year, {rnd('sum(t)')} as turnover, sum(t) > 0.80 as over_budget from t group by 1",
    "B23",
)
def _budget(spark, sf):
    per = weights.turnover(weights.snapshot_changes(snapshot_rows(spark, sf), ["portfolio_id"]), ["portfolio_id"])
    return weights.turnover_budget(per, ["portfolio_id"]).select("year", F.round("turnover", 6).alias("turnover"), "over_budget")


HELD = {
    **POS,
    "st": "select row_number() over (order by as_of_date) as k, as_of_date as date, map(list(symbol), list(weight)) as t from pw group by as_of_date",
    "fold": """select k, date, t, t as held, 0.0::double as spent, 0.0::double as used from st where k = 1
      union all
      select k, date, t, map([r.s for r in moved if r.w > 0], [r.w for r in moved if r.w > 0]), spent, before + spent from (
        select k, date, t, before, wanted * part as spent, [{'s': r.s, 'w': case when part = 1 then r.w else r.h + part * (r.w - r.h) end} for r in prop] as moved from (
          select *, case when wanted > greatest(0.80 - before, 0) then greatest(0.80 - before, 0) / wanted else 1.0::double end as part from (
            select *, list_sum([abs(r.w - r.h) for r in prop]) / 2 as wanted from (
              select k, date, t, before, [{'s': r.s, 'h': r.h, 'w': r.w / total} for r in raw] as prop from (
                select *, list_sum([r.w for r in raw]) as total from (
                  select k, date, t, before, [{'s': r.s, 'h': r.h, 'w': case when r.h > 0 and r.x > 0 and abs(r.x - r.h) < 0.01 then r.h else r.x end} for r in sides] as raw from (
                    select st.k, st.date, st.t, case when year(st.date) = year(fold.date) then fold.used else 0 end as before,
                      [{'s': s, 'h': coalesce(map_extract(fold.held, s)[1], 0), 'x': coalesce(map_extract(st.t, s)[1], 0)} for s in list_distinct(list_concat(map_keys(fold.held), map_keys(st.t)))] as sides
                    from fold join st on st.k = fold.k + 1) a) b) c) d) e) f) g""",
    "each": "select date, t, spent, used, unnest(map_entries(held)) as e from fold",
}


@query(
    "held_weights",
    with_inputs("fin", extra=HELD).replace("with ", "with recursive ", 1)
    + f" select date, e.key as symbol, {rnd('e.value')} as weight, {rnd('coalesce(map_extract(t, e.key)[1], 0)')} as target_weight, {rnd('spent')} as turnover, {rnd('used')} as turnover_year from each",
    "B23",
)
def _held(spark, sf):
    out = rebalance.held_weights(snapshot_rows(spark, sf), ["portfolio_id"])
    return out.select("date", "symbol", *[F.round(c, 6).alias(c) for c in ("weight", "target_weight", "turnover", "turnover_year")])


# --- correlation and allocation --------------------------------------------------------------------------------

MON = {
    "mo": "select symbol, date_trunc('month', date)::date as date, arg_max(close, date) as close from npx group by 1, 2",
    "mr": f"select symbol, date, close / nullif(lag(close) over ({W}), 0) - 1 as ret from mo",
    "fulld": "select date from mr where ret is not null group by date having count(*) = (select count(distinct symbol) from mr where ret is not null)",
}


def monthly_returns(spark, sf):
    monthly = table(spark, sf, "npx").groupBy("symbol", F.trunc("date", "month").alias("date")).agg(F.max_by("close", "date").alias("close"))
    return simple_returns(monthly).where(F.col("ret").isNotNull()).select("symbol", "date", "ret")


@query(
    "return_correlation",
    with_inputs("npx", extra=MON)
    + f""" select a.symbol, b.symbol as other, {rnd('0.8 * corr(a.ret, b.ret) + case when a.symbol = b.symbol then 0.2 else 0 end')} as correlation
      from mr a join mr b on a.date = b.date and a.symbol <= b.symbol join fulld f on f.date = a.date group by 1, 2""",
    "J15 B1",
)
def _correlation(spark, sf):
    out = allocation.return_correlations(monthly_returns(spark, sf).withColumn("g", F.lit("all")), ["g"])
    return out.select("symbol", "other", F.round("correlation", 6).alias("correlation"))


@query(
    "covariance",
    with_inputs("npx", extra={**MON, "v": "select symbol, case when symbol like '%7' then null else stddev_samp(ret) * 100 end as v from mr group by 1"})
    + f""" select a.symbol, b.symbol as other, {rnd('any_value(coalesce(va.v, 25) / 100) * any_value(coalesce(vb.v, 25) / 100) * (0.8 * corr(a.ret, b.ret) + case when a.symbol = b.symbol then 0.2 else 0 end)')} as covariance
      from mr a join mr b on a.date = b.date and a.symbol <= b.symbol join fulld f on f.date = a.date join v va on va.symbol = a.symbol join v vb on vb.symbol = b.symbol group by 1, 2""",
    "B3",
)
def _covariance(spark, sf):
    r = stage(monthly_returns(spark, sf).withColumn("g", F.lit("all")))
    vols = r.groupBy("g", "symbol").agg((F.stddev_samp("ret") * 100).alias("v")).withColumn(
        "vol_30d", F.when(~F.col("symbol").endswith("7"), F.col("v"))
    )
    out = allocation.covariance(allocation.return_correlations(r, ["g"]), vols, ["g"])
    return out.select("symbol", "other", F.round("covariance", 6).alias("covariance"))


def parity_sql(known: str = "null", joined: str = "") -> dict[str, str]:
    """Risk parity of the rows ``cand`` (g, symbol, sector, vol): Ward merges one at a time, then halves."""
    same = "case when a.i = b.i then 1 when a.sector = b.sector and a.sector <> 'Unknown' then 0.7 else 0.4 end"
    every = "list_transform(range(1, n + 1), lambda x: {})"
    return {
        "pos": "select *, row_number() over (partition by g order by symbol) as i from cand",
        "ids": "select g, count(*)::int as n, list(symbol order by symbol) as syms, list(coalesce(vol, 25) / 100 order by symbol) as v from cand group by g",
        "cells": f"select a.g, a.i, b.i as j, coalesce({known}, {same})::double as rho from pos a join pos b on a.g = b.g {joined}",
        "dm": "select g, list(r order by i) as d from (select g, i, list(sqrt(greatest((1 - rho) / 2, 0)) order by j) as r from cells group by 1, 2) z group by g",
        "prs": "select g, list({'i': a.i, 'j': b.i}) as prs from pos a join pos b using (g) where a.i < b.i group by g",
        "it": f"""select g, n, d, list_transform(range(n), lambda x: 1.0::double) as size, range(n) as label, list_transform(range(1, n + 1), lambda x: [x]) as members, 0 as k from ids join dm using (g)
          union all select g, n, {every.format("case when x = bi then u else list_transform(range(1, n + 1), lambda y: case when y = bi then u[x] else d[x][y] end) end")},
            {every.format("case when x = bi then size[bi] + size[bj] when x = bj then 0 else size[x] end")}, {every.format("case when x = bi then n + k else label[x] end")},
            {every.format("case when x <> bi then members[x] when label[bi] < label[bj] then members[bi] || members[bj] else members[bj] || members[bi] end")}, k + 1
          from (select *, {every.format("sqrt(greatest(((size[x] + size[bi]) * (d[bi][x] * d[bi][x]) + (size[x] + size[bj]) * (d[bj][x] * d[bj][x]) - size[x] * (dij * dij)) / (size[x] + size[bi] + size[bj]), 0))")} as u
            from (select *, best.i as bi, best.j as bj, best.d as dij from (select it.*, list_sort(list_transform(list_filter(prs, lambda q: size[q.i] > 0 and size[q.j] > 0), lambda q: {{'d': d[q.i][q.j], 'i': q.i, 'j': q.j}}))[1] as best
              from it join prs using (g) where k < n - 1) s1) s2) s3""",
        "lv": "select it.g, members[1] as o, list_transform(members[1], lambda x: v[x] * v[x]) as vv from it join ids using (g) where k = it.n - 1",
        "ps": "select g, o, list_transform(range(len(vv) + 1), lambda x: coalesce(list_sum(vv[1:x]), 0)) as ps from lv",
        "sg": """select g, 0 as lo, n as hi, 1.0::double as w from ids union all
          select g, unnest([lo, mid])::int, unnest([mid, hi])::int, unnest([w * t, w * (1 - t)]) from (select *, case when l + r > 0 then r / (l + r) else 0.5 end as t
            from (select sg.*, (lo + hi) // 2 as mid, (ps[mid + 1] - ps[lo + 1]) / (mid - lo) as l, (ps[hi + 1] - ps[mid + 1]) / (hi - mid) as r from sg join ps using (g) where hi - lo > 1) s1) s2""",
        "parity": "select sg.g, syms[o[lo + 1]] as symbol, w / sum(w) over (partition by sg.g) as weight from sg join ps using (g) join ids using (g) where hi - lo = 1",
    }


def recursive(sql: str) -> str:
    return sql.replace("with ", "with recursive ", 1)


CAND = {"full_": FULL, "cand": "select as_of_date as g, symbol, coalesce(sector, 'Unknown') as sector, vol_30d as vol from (select *, row_number() over (partition by as_of_date order by cash desc, symbol) as rn from full_) z where rn <= 40"}
SAMPLE = {
    **MON,
    "kn": "select a.symbol, b.symbol as other, 0.8 * corr(a.ret, b.ret) + case when a.symbol = b.symbol then 0.2 else 0 end as c from mr a join mr b on a.date = b.date and a.symbol <= b.symbol join fulld f on f.date = a.date group by 1, 2 having count(*) > 1",
    "cand": "select 'all' as g, symbol, 'Unknown' as sector, stddev_samp(ret) * 100 as vol from mr group by symbol",
}


@query("hrp_weights", recursive(with_inputs("fin", extra=CAND | parity_sql())) + f" select g as as_of_date, symbol, {rnd('weight', 9)} as weight from parity", "B2 B4")
def _hrp(spark, sf):
    rows = full_table(spark, sf).select("as_of_date", "symbol", "sector", "vol_30d", "cash")
    out = allocation.hrp_weights(rows, BY, gate=[F.col("cash").desc(), F.col("symbol")])
    return out.select("as_of_date", "symbol", F.round("weight", 9).alias("weight"))


@query(
    "hrp_weights_sample_correlation",
    recursive(with_inputs("npx", extra=SAMPLE | parity_sql("case when not isnan(kn.c) then kn.c end", "left join kn on kn.symbol = least(a.symbol, b.symbol) and kn.other = greatest(a.symbol, b.symbol)")))
    + f" select symbol, {rnd('weight', 9)} as weight from parity",
    "B1 B4",
)
def _hrp_sample(spark, sf):
    r = stage(monthly_returns(spark, sf).withColumn("g", F.lit("all")))
    c = r.groupBy("g", "symbol").agg((F.stddev_samp("ret") * 100).alias("vol_30d")).withColumn("sector", F.lit("Unknown"))
    return allocation.hrp_weights(c, ["g"], r).select("symbol", F.round("weight", 9).alias("weight"))


def caps_sql(source: str, weight: str, cap: float, sector_cap: float, out: str) -> dict[str, str]:
    """Iterative caps of the rows ``source`` one step at a time: position cap, each named sector, rescaling."""
    return {
        f"{out}_l": f"""select as_of_date, list(symbol order by symbol) as syms, list(coalesce(sector, 'Unknown') order by symbol) as secs, list({weight} order by symbol) as w,
          list_sort(list_distinct(list(sector) filter (sector <> 'Unknown'))) as names from {source} group by 1""",
        f"{out}_i": f"""select *, 0 as k, w as before, false as done from {out}_l union all
          select as_of_date, syms, secs,
            case when ph = 0 then list_transform(cut, lambda x: case when x < {cap} and surplus > 0 and room > 0 then x * (1 + surplus / room) else x end)
              when ph > len(names) then list_transform(w, lambda x: x / tot)
              when held > {sector_cap} then list_transform(range(1, len(w) + 1), lambda i: w[i] * case when secs[i] = names[ph] then {sector_cap} / held when tot > held then 1 + (held - {sector_cap}) / (tot - held) else 1 end)
              else w end as w, names, k + 1, case when ph = 0 then w else before end,
            ph > len(names) and list_max(list_transform(range(1, len(w) + 1), lambda i: abs(w[i] / tot - before[i]))) < 0.001
          from (select *, list_sum(w) as tot, list_sum(w) - list_sum(cut) as surplus, coalesce(list_sum(list_filter(cut, lambda x: x < {cap})), 0) as room,
              list_sum(list_transform(range(1, len(w) + 1), lambda i: case when secs[i] = names[ph] then w[i] else 0 end)) as held
            from (select *, k % (len(names) + 2) as ph, list_transform(w, lambda x: least(x, {cap})) as cut from {out}_i where not done and k < 20 * (len(names) + 2)) a) b""",
        f"{out}_f": f"select as_of_date, any_value(syms) as syms, any_value(secs) as secs, arg_max(w, k) as w from {out}_i group by 1",
        out: f"select as_of_date, unnest(syms) as symbol, unnest(secs) as sector, unnest(w) as weight from {out}_f",
    }


@query(
    "iterative_caps",
    recursive(with_inputs("fin", extra=RAWW | caps_sql("sw", "weight0", 0.06, 0.25, "cp"))) + f" select as_of_date, symbol, {rnd('weight', 9)} as weight from cp",
    "B6",
)
def _caps(spark, sf):
    out = allocation.iterative_caps(raw_weights(spark, sf).select("as_of_date", "symbol", "sector", "weight"), BY, Constraints(max_weight=0.06, max_sector=0.25))
    return out.select("as_of_date", "symbol", F.round("weight", 9).alias("weight"))


OPT = {
    **V30,
    "cand": """select as_of_date as g, symbol, coalesce(sector, 'Unknown') as sector, abs(roe) * 100 as vol, sc
      from (select *, row_number() over (partition by as_of_date order by sc desc nulls last, symbol) as rn from comp) z where rn <= 40""",
    **parity_sql(),
    "tilted": "select g, symbol, sector, weight * exp(0.5 * (sc - avg(sc) over w) / coalesce(nullif(stddev_pop(sc) over w, 0), 1)) as t from parity join cand using (g, symbol) window w as (partition by g)",
    "t1": "select g as as_of_date, symbol, sector, t / sum(t) over (partition by g) as weight from tilted",
    **caps_sql("t1", "weight", Constraints().max_weight, Constraints().max_sector, "c1"),
    "t2": """select as_of_date, symbol, sector, weight / sum(weight) over (partition by as_of_date) as weight
      from (select *, row_number() over (partition by as_of_date order by weight desc, symbol) as rn from c1) z where rn <= 20""",
    **caps_sql("t2", "weight", Constraints().max_weight, Constraints().max_sector, "c2"),
}


@query("optimised_portfolio", recursive(with_inputs("fin", extra=OPT)) + f" select as_of_date, symbol, {even('weight', 4)} as weight from c2", "B2 B4 B5 B6 K3")
def _optimise(spark, sf):
    scored = scores_v30.composite_v30(history_table(spark, sf), with_rank=False).withColumn("vol_30d", F.abs("roe") * 100)
    out = allocation.optimise(scored.select("as_of_date", "symbol", "sector", "vol_30d", "score_composite_v30"), BY, score="score_composite_v30")
    return out.select("as_of_date", "symbol", "weight")


# --- backtest ----------------------------------------------------------------------------------------------------

# quarterly weights over nations: equal weights of the ten with the largest close at the quarter start
QW = {
    **QSTARTS,
    "ret": f"select symbol, date, close / nullif(lag(close) over ({W}), 0) - 1 as ret from npx",
    "cl": "select s.symbol, qi.date as rd, p.close from (select distinct symbol from npx) s cross join qi asof join npx p on p.symbol = s.symbol and qi.date >= p.date",
    "qw": "select rd, symbol, 0.1::double as weight from (select *, row_number() over (partition by rd order by close desc, symbol) as rn from cl) z where rn <= 10",
    "dy": "select distinct date from npx",
    "sp": "select rd, coalesce(lead(rd) over (order by rd) - 1, (select max(date) from npx)) as upto from (select distinct rd from qw) z",
    "hd": "select rd, date from sp join dy on date between rd and upto",
    "gr": "select hd.date, coalesce(sum(weight * ret), 0) as g from hd join qw using (rd) left join ret on ret.symbol = qw.symbol and ret.date = hd.date group by 1",
    "pr0": "select n.rd, n.symbol, n.weight from qw n",
    "cc": "select coalesce(n.rd, o.rd) as rd, sum(abs(coalesce(n.weight, 0) - coalesce(o.weight, 0))) / 2 as t from (select * from qw where rd > (select min(rd) from qw)) n full join (select (select min(rd) from qw q2 where q2.rd > q.rd) as rd, symbol, weight from qw q where rd < (select max(rd) from qw)) o on n.rd = o.rd and n.symbol = o.symbol group by 1",
    "net": "select gr.date, g as gross_ret, coalesce(t * 12.0 / 10000, 0) as cost, g - coalesce(t * 12.0 / 10000, 0) as ret from gr left join cc on cc.rd = gr.date",
}


def nation_weights(spark, sf):
    rows = backtest.prices_at(table(spark, sf, "npx").select("symbol", "date", "close"), quarter_instants(spark, sf))
    top = top_k(rows, ["rebalance_date"], [F.col("close").desc(), F.col("symbol")], 10)
    return top.select(F.lit("p").alias("portfolio_id"), "rebalance_date", "symbol", F.lit(0.1).alias("weight"))


@query(
    "portfolio_daily_returns",
    with_inputs("npx", extra=QW) + f" select date, {rnd('gross_ret')} as gross_ret, {rnd('cost')} as cost, {rnd('ret')} as ret from net",
    "B16 J8 W17",
)
def _daily(spark, sf):
    out = backtest.portfolio_returns(nation_weights(spark, sf), simple_returns(table(spark, sf, "npx")))
    return out.select("date", *[F.round(c, 6).alias(c) for c in ("gross_ret", "cost", "ret")])


@query(
    "holding_days",
    with_inputs("npx", extra=QW) + " select rd as rebalance_date, date from hd",
    "J8",
)
def _holding(spark, sf):
    return backtest.holding_days(nation_weights(spark, sf), table(spark, sf, "npx"), ["portfolio_id"]).select("rebalance_date", "date")


@query(
    "weighted_daily_returns",
    with_inputs("npx", "bench", extra={"ret": f"select symbol, date, close / nullif(lag(close) over ({W}), 0) - 1 as ret from npx",
      "wt": "select distinct symbol, length(symbol) - 7.5 as w from npx", "br": "select date, close / nullif(lag(close) over (order by date), 0) - 1 as b from bench",
      "d": "select ret.date, sum(w / (select sum(w) from wt) * coalesce(ret, 0)) as r from wt join ret using (symbol) group by 1"})
    + f" select date, {rnd('r')} as ret, {rnd('b')} as benchmark_ret from d left join br using (date)",
    "B17 J9",
)
def _weighted(spark, sf):
    r = simple_returns(table(spark, sf, "npx"))
    w = table(spark, sf, "npx").select("symbol").distinct().select(F.lit("p").alias("portfolio_id"), "symbol", (F.length("symbol") - 7.5).alias("weight"))
    b = simple_returns(table(spark, sf, "bench").withColumn("symbol", F.lit("*"))).select("date", "ret")
    out = backtest.weighted_returns(w, r, benchmark=b)
    return out.select("date", F.round("ret", 6).alias("ret"), F.round("benchmark_ret", 6).alias("benchmark_ret"))


@query(
    "weighted_period_stats",
    with_inputs("npx", "bench", extra={**SER, **PATH, "al": "select pb.*, ben.ret as b from pb left join ben using (date)",
      "m": "select portfolio_id, count(ret) as n, product(1 + ret) as g, avg(ret) as mu, stddev_samp(ret) as sd, min(dd) as md, product(1 + coalesce(b, 0)) as bg, avg(ret - b) as ac, stddev_samp(ret - b) as te from al group by 1"})
    + f""" select portfolio_id, n as n_days, {even('(g - 1) * 100', 2)} as total_return, {even('(power(g, 252.0 / n) - 1) * 100', 2)} as cagr, {even('sd * sqrt(252.0) * 100', 2)} as volatility, {even('md * 100', 2)} as max_drawdown,
      {even('(mu - 4.5 / 252 / 100) / sd * sqrt(252.0)', 2)} as sharpe, {even('te * sqrt(252.0) * 100', 2)} as tracking_error, {even('ac * 252 * 100 / (te * sqrt(252.0) * 100)', 2)} as information_ratio from m""",
    "A29",
)
def _period_stats(spark, sf):
    daily = metrics.align_benchmark(series_returns(spark, sf), benchmark_returns(spark, sf), "left")
    return metrics.weighted_period_stats(daily, ["portfolio_id"]).drop("alpha")


# point-in-time universe at quarter ends with a strategy on it
WF = backtest.WalkForward(constraints=Constraints(min_positions=5, max_positions=20), publication=Publication())
PIT = {
    "rbd": "select distinct date from px where date = last_day(date) and month(date) % 3 = 0",
    "kf": "select *, make_date(year, 12, 31) + 120 as known from fin",
    "fs": f"select symbol, date, close as pclose, count(*) over (partition by symbol order by date rows between unbounded preceding and current row) as n, close / nullif(lag(close) over ({W}), 0) - 1 as ret from px",
    "fv": f"select symbol, date as price_date, pclose, case when n >= 30 then {even('stddev_samp(ret) over (partition by symbol order by date rows between 28 preceding and current row) * (sqrt(252.0) * 100)', 2)} end as vol_30d from fs",
    "fa": "select f.*, r.date as rd from (select distinct symbol as s0 from fin) s cross join rbd r asof join kf f on f.symbol = s.s0 and r.date >= f.known",
    "pu": "select fa.symbol, fa.rd as rebalance_date, fa.year, fv.price_date, fv.pclose as price, fv.vol_30d, fa.shares_outstanding * fv.pclose as market_cap from fa asof join fv on fv.symbol = fa.symbol and fa.rd >= fv.price_date",
}


@query(
    "point_in_time_universe",
    with_inputs("fin", "px", extra=PIT)
    + f" select symbol, rebalance_date, year, price_date, price, vol_30d, market_cap, 0.5::double as score_sm from pu",
    "B14 J4 J5 W13 P8 J3",
)
def _pit_universe(spark, sf):
    px = table(spark, sf, "px").select("symbol", "date", "close")
    fin = table(spark, sf, "fin").drop("price", "as_of_date")
    out = backtest.point_in_time_universe(px, fin, calendar.rebalance_dates(px, "Q"))
    return out.select("symbol", "rebalance_date", "year", "price_date", "price", "vol_30d", "market_cap", "score_sm")


def strategy_returns(spark, sf):
    px = stage(table(spark, sf, "px").select("symbol", "date", "close"))
    fin = stage(table(spark, sf, "fin").drop("price", "as_of_date"))
    return backtest.walk_forward(px, fin, WF)


def _wf_sql():
    z = lambda c: f"coalesce(({c} - avg({c}) over w) / nullif(stddev_samp({c}) over w, 0), 0)"
    part = "rebalance_date"
    return {
        **PIT,
        "u0": """select fa.symbol, fa.rd as rebalance_date, fa.ebit, fa.fcf, fa.revenue, fa.total_debt, fa.cash, fa.equity, fa.interest_expense, fv.vol_30d, fa.shares_outstanding * fv.pclose as market_cap
          from fa asof join fv on fv.symbol = fa.symbol and fa.rd >= fv.price_date""",
        "u1": """select *, least(greatest(fcf / nullif(market_cap, 0), -0.5), 0.5) as fy, case when ebit > 0 then least(greatest((market_cap + total_debt - cash) / ebit, 0), 100) end as ee,
          case when equity + total_debt - cash > 0 then ebit * 0.75 / (equity + total_debt - cash) end as r, fcf / nullif(revenue, 0) as fm, case when equity > 0 then total_debt / equity else 2.0 end as de from u0""",
        "u2": f"""select *, case when count(fy) over (partition by {part}) >= 5 then coalesce({pct('fy', part)}, 0.5) else 0.5 end as a, case when count(ee) over (partition by {part}) >= 5 then coalesce(1 - {pct('ee', part)}, 0.5) else 0.5 end as b,
          {steps('r', P.ROIC_LADDER, '>', '0.0', '0.5')} as q1, {steps("(case when fm is not null then case when fm > 0.15 then 0.12 when fm > 0.10 then 0.08 when fm > 0.05 then 0.04 else 0.0 end end)", P.FCF_GROWTH_LADDER, '>', '0.0', '0.5')} as q3,
          case when de < 1.0 then 0.7 when de < 1.5 then 0.5 when de < 2.0 then 0.3 else 0.0 end::double as q4 from u1""",
        **_risk_sql("u2"),
        "u3": f"select *, {even('0.4 * a + 0.4 * b + 0.2 * 0.5::double', 3)} as sv, {even('0.35 * q1 + 0.25 * 0.5::double + 0.20 * q3 + 0.20 * q4', 3)} as sq from rk",
        "u4": f"select *, {z('sv')} as zv, {z('sq')} as zq, {z('sr')} as zr from u3 window w as (partition by rebalance_date)",
        "u5": f"select *, {even('0.30 * zv + 0.25 * zq + 0.15 * zr', 4)} as sc from u4",
        "u6": "select * from (select symbol, rebalance_date as rd, row_number() over (partition by rebalance_date order by sc desc, symbol) as rn from u5) t where rn <= 20",
        "qw": "select rd, symbol, w0 / sum(w0) over (partition by rd) as weight from (select rd, symbol, least(1.0 / count(*) over (partition by rd), 0.12) as w0 from u6) t",
        "dy": "select distinct date from px",
        "ret": f"select symbol, date, close / nullif(lag(close) over ({W}), 0) - 1 as ret from px",
        "sp": "select rd, coalesce(lead(rd) over (order by rd) - 1, (select max(date) from px)) as upto from (select distinct rd from qw) z",
        **{k: QW[k] for k in ("hd", "gr", "cc", "net")},
    }


WF_SQL = _wf_sql()


@query(
    "walk_forward_weights",
    with_inputs("fin", "px", extra=WF_SQL) + f" select symbol, rd as rebalance_date, {rnd('weight')} as weight from qw",
    "B15 B22 K3",
)
def _walk_forward_weights(spark, sf):
    px = stage(table(spark, sf, "px").select("symbol", "date", "close"))
    fin = stage(table(spark, sf, "fin").drop("price", "as_of_date"))
    return backtest.fundamental_weights(px, fin, WF).select("symbol", "rebalance_date", F.round("weight", 6).alias("weight"))


@query(
    "walk_forward_fundamental",
    with_inputs("fin", "px", extra=WF_SQL) + f" select date, {rnd('gross_ret')} as gross_ret, {rnd('cost', 8)} as cost, {rnd('ret')} as ret from net",
    "B15 B16 B18 B22",
)
def _walk_forward(spark, sf):
    out = strategy_returns(spark, sf)
    return out.select("date", F.round("gross_ret", 6).alias("gross_ret"), F.round("cost", 8).alias("cost"), F.round("ret", 6).alias("ret"))


@query(
    "walk_forward_acceptance",
    with_inputs("fin", "px", extra={**WF_SQL, "g1": "select date, ret, product(1 + ret) over (order by date rows between unbounded preceding and current row) as g from net",
      "g2": "select *, g / max(g) over (order by date rows between unbounded preceding and current row) - 1 as dd from g1",
      "m": f"select count(*) as n, {even('(avg(ret) - 0.045 / 252) / stddev_samp(ret) * sqrt(252.0)', 3)} as sr, {even('min(dd) * 100', 2)} as md from g2"})
    + """ select 'strategy' as portfolio_id, n as num_periods, sr as sharpe_ratio, md as max_drawdown, sr >= 0.55 and md >= -35 as accepted, concat_ws('; ', case when sr < 0.55 then 'sharpe below floor' else 'sharpe ok' end,
      case when md < -35 then 'drawdown beyond hard limit' when md < -25 then 'drawdown beyond target' else 'drawdown ok' end) as notes from m""",
    "A33 B18",
)
def _acceptance(spark, sf):
    daily = stage(strategy_returns(spark, sf))
    m = metrics.performance_metrics(daily, ["portfolio_id"])
    out = compare.acceptance(m).withColumn("notes", F.concat_ws("; ", "notes"))
    return out.select("portfolio_id", "num_periods", "sharpe_ratio", "max_drawdown", "accepted", "notes")


OOS = {
    **{k: v.replace("from px", "from cpx") for k, v in FACTORS.items()},
    "cfg": "select * from (values ('core', 0.40, 0.35, 0.15, 0.10, 0.00), ('core_holder', 0.30, 0.25, 0.15, 0.15, 0.15), ('holder_reduced', 0.35, 0.30, 0.15, 0.15, 0.05)) t(config_id, cv, cq, cm, cl, ch)",
    "cs": "select config_id, symbol, rebalance_date, round(value * cv + quality * cq + momentum * cm + low_vol * cl + 0.5 * ch, 9) as sc from k4 cross join cfg",
    "ct": "select cs.*, sector from (select *, row_number() over (partition by config_id, rebalance_date order by sc desc, symbol) as rn from cs) cs join (select distinct symbol, sector from cpx) s using (symbol) where rn <= 20",
    "c1": "select *, least(1.0 / count(*) over w, 0.12) as w0 from ct window w as (partition by config_id, rebalance_date)",
    "c2": "select *, w0 / sum(w0) over (partition by config_id, rebalance_date) as w1 from c1",
    "c3": "select *, sum(w1) over (partition by config_id, rebalance_date, sector) as sw from c2",
    "c4": "select *, case when sw > 0.30 then w1 * 0.30 / sw else w1 end as w2 from c3",
    "c5": "select *, w2 / sum(w2) over (partition by config_id, rebalance_date) as weight from c4",
    "pe0": 'select start as rebalance_date, symbol, arg_max(close, date) / arg_min(close, date) - 1 as r from cpx join per on date between start and "end" group by 1, 2',
    "be0": 'select start as rebalance_date, arg_max(close, date) / arg_min(close, date) - 1 as b, count(*) as n from cbench join per on date between start and "end" group by 1',
    "pp0": "select config_id, rebalance_date, sum(weight * coalesce(r, 0)) as portfolio_return, count(*) as n_positions from c5 join (select start as rebalance_date from per) q using (rebalance_date) left join pe0 using (rebalance_date, symbol) group by 1, 2",
    "pr": "select config_id, rebalance_date as period_start, portfolio_return, n_positions, case when n >= 2 then b else 0 end as benchmark_return, portfolio_return - case when n >= 2 then b else 0 end as alpha from pp0 join be0 using (rebalance_date)",
}


def oos_periods(spark, sf):
    px = stage(table(spark, sf, "cpx").select("symbol", "date", "close", "sector"))
    instants = stage(quarter_instants(spark, sf))
    prices = px.select("symbol", "date", "close")
    sectors = px.select("symbol", "sector").distinct()
    scored = backtest.config_composites(backtest.price_factors_at(prices, instants))
    scored = scored.withColumn("score_composite", F.round("score_composite", 9))
    by = ["config_id", "rebalance_date"]
    top = top_k(scored, by, [F.col("score_composite").desc(), F.col("symbol")], 20).join(sectors, "symbol", "left")
    w = weights.sector_cap_once(weights.equal_weights(top, by, 0.12), by, 0.30)
    return backtest.period_results(w, prices, calendar.periods_between(instants), table(spark, sf, "cbench"), ["config_id"])


@query(
    "walk_forward_configs",
    with_inputs("cpx", "cbench", extra=OOS)
    + f" select config_id, period_start, n_positions, {rnd('portfolio_return')} as portfolio_return, {rnd('benchmark_return')} as benchmark_return, {rnd('alpha')} as alpha from pr",
    "B19 C24 J16 B9 J6 J7",
)
def _oos(spark, sf):
    out = oos_periods(spark, sf)
    return out.select("config_id", "period_start", "n_positions", *[F.round(c, 6).alias(c) for c in ("portfolio_return", "benchmark_return", "alpha")])


RUN = "partition by config_id order by period_start rows between unbounded preceding and current row"
SUMM = {
    **OOS,
    "s0": f"select *, {even('portfolio_return * 100', 2)} / 100 as rp, {even('benchmark_return * 100', 2)} / 100 as rb, {even('alpha * 100', 2)} / 100 as ra from pr",
    "s1": f"select *, product(1 + portfolio_return) over ({RUN}) as g from s0",
    "s2": f"select *, g / greatest(max(g) over ({RUN}), 1.0) - 1 as dd from s1",
    "s3": "select config_id, count(*) as n, product(1 + portfolio_return) as p, product(1 + rb) as b, sum(ra) as a, stddev_pop(ra) as sa, stddev_pop(rp) as sp, avg((ra > 0)::int) as hit, min(dd) as dd from s2 group by 1",
    "su": f"""select config_id, n as n_periods, {even('(p - 1) * 100', 2)} as total_return, {even('(b - 1) * 100', 2)} as benchmark_return, {even('(power(p, 4.0 / n) - 1) * 100', 2)} as cagr, {even('(power(b, 4.0 / n) - 1) * 100', 2)} as benchmark_cagr,
      {even('a * 100', 2)} as total_alpha, {even('a * 100 / (n / 4.0)', 2)} as alpha_per_year, {even('hit * 100', 1)} as hit_rate, {even('(power(p, 4.0 / n) - 1 - 0.045) / (sp * 2)', 2)} as sharpe, {even('dd * 100', 2)} as max_drawdown,
      {even('(a * 4 / (n / 4.0)) / (sa * 2)', 2)} as information_ratio from s3""",
}


@query("config_summary", with_inputs("cpx", "cbench", extra=SUMM) + " select * from su", "A22 A23")
def _config_summary(spark, sf):
    return metrics.config_summary(oos_periods(spark, sf), ["config_id"])


@query(
    "config_attribution",
    with_inputs("cpx", "cbench", extra={**SUMM, "ba": "select * from su where config_id = 'core'"})
    + f""" select su.config_id, {even('su.total_alpha - ba.total_alpha', 2)} as alpha_contribution, {even('su.sharpe - ba.sharpe', 2)} as sharpe_contribution, {even('su.information_ratio - ba.information_ratio', 2)} as ir_contribution,
      case when su.config_id = 'core' then 'base' when su.total_alpha > ba.total_alpha and su.information_ratio > ba.information_ratio then 'adds_value' when su.total_alpha > ba.total_alpha then 'mixed' else 'no_value' end as verdict from su, ba""",
    "A37",
)
def _attribution(spark, sf):
    out = compare.attribution(metrics.config_summary(oos_periods(spark, sf), ["config_id"]))
    return out.select("config_id", "alpha_contribution", "sharpe_contribution", "ir_contribution", "verdict")


PCTP = {**OOS, "pq": f"select config_id, period_start, {even('portfolio_return * 100', 2)} as p, {even('benchmark_return * 100', 2)} as b, {even('alpha * 100', 2)} as a from pr",
        "q1": "select *, product(1 + p / 100) over (partition by config_id order by period_start rows between unbounded preceding and current row) as g from pq",
        "q2": f"select *, g / max(g) over ({RUN}) - 1 as dd from q1"}


def percent_periods(spark, sf):
    out = oos_periods(spark, sf)
    cols = {c: F.rint(F.col(c) * 10000) / 100 for c in ("portfolio_return", "benchmark_return", "alpha")}
    return out.withColumns(cols)


WFS = {**PCTP, "ws": f"""select config_id, count(*) as total_periods, {even('(power(product(1 + p / 100), 4.0 / count(*)) - 1) * 100', 2)} as portfolio_cagr, {even('(power(product(1 + b / 100), 4.0 / count(*)) - 1) * 100', 2)} as benchmark_cagr,
      {even('sum(a)', 2)} as total_alpha, {even('round(sum(a) * 100) / 100 / count(a)', 2)} as avg_alpha_per_period, {even('avg((a > 0)::int) * 100', 1)} as hit_rate, {even('avg(a) * 4 / (stddev_pop(a) * 2)', 2)} as information_ratio, {even('stddev_pop(p) * 2', 2)} as portfolio_volatility,
      {even('stddev_pop(b) * 2', 2)} as benchmark_volatility, {even('stddev_pop(a) * 2', 2)} as tracking_error, {even('min(dd) * 100', 2)} as max_drawdown, min(p) as worst_period_return, max(p) as best_period_return from q2 group by 1"""}


@query("walk_forward_summary", with_inputs("cpx", "cbench", extra=WFS) + " select * from ws", "A20")
def _wf_summary(spark, sf):
    return metrics.walk_forward_summary(percent_periods(spark, sf), ["config_id"])


@query(
    "strategy_verdict",
    with_inputs("cpx", "cbench", extra={**WFS, "v": "select config_id, total_alpha > 0 as alpha_positive, hit_rate > 50 as hit_rate_ok, max_drawdown > -40 as drawdown_ok, information_ratio > 0.3 as ir_ok from ws"})
    + " select *, alpha_positive::int + hit_rate_ok::int + drawdown_ok::int + ir_ok::int as criteria_passed, case alpha_positive::int + hit_rate_ok::int + drawdown_ok::int + ir_ok::int when 4 then 'validated' when 3 then 'acceptable' else 'rework' end as verdict from v",
    "A34",
)
def _verdict(spark, sf):
    out = compare.strategy_verdict(metrics.walk_forward_summary(percent_periods(spark, sf), ["config_id"]))
    return out.select("config_id", "alpha_positive", "hit_rate_ok", "drawdown_ok", "ir_ok", "criteria_passed", "verdict")


@query(
    "annual_returns",
    with_inputs("cpx", "cbench", extra={**PCTP, "y": "select config_id, year(period_start)::int as year, (product(1 + p / 100) - 1) * 100 as a1, (product(1 + b / 100) - 1) * 100 as b1, count(*) as n from pq group by 1, 2"})
    + f" select config_id, year, {even('a1', 2)} as portfolio, {even('b1', 2)} as benchmark, {even('a1 - b1', 2)} as alpha, n as periods from y",
    "A21",
)
def _annual(spark, sf):
    return metrics.annual_returns(percent_periods(spark, sf), ["config_id"])


@query(
    "best_and_worst_periods",
    with_inputs("cpx", "cbench", extra={**PCTP, "o": "select *, row_number() over (partition by config_id order by p desc, period_start) as h, row_number() over (partition by config_id order by p, period_start) as l from pq"})
    + " select config_id, 'best' as side, h::int as place, period_start, p as portfolio_return from o where h <= 5 union all select config_id, 'worst', l::int, period_start, p from o where l <= 5",
    "K5",
)
def _best(spark, sf):
    return metrics.best_and_worst(percent_periods(spark, sf), ["config_id"]).select("config_id", "side", "place", "period_start", "portfolio_return")


@query(
    "forward_test_record",
    with_inputs("npx", "bench", extra={**SER, **PATH, **QSTARTS, "n1": 'select portfolio_id, start as period_start, arg_min(g, date) as entry_nav, arg_max(g, date) as exit_nav from pb join per on date between start and "end" group by 1, 2',
       "b1": 'select start as period_start, arg_max(close, date) / arg_min(close, date) - 1 as b from bench join per on date between start and "end" group by 1'})
    + f""" select portfolio_id, period_start, {rnd('exit_nav / entry_nav - 1')} as portfolio_return, {rnd('b')} as benchmark_return, {rnd('exit_nav / entry_nav - 1 - b')} as alpha, (exit_nav / entry_nav - 1 - b > 0)::int as hit from n1 join b1 using (period_start)""",
    "B24",
)
def _forward(spark, sf):
    from stratafin.operators.series import cumulative

    nav = cumulative(series_returns(spark, sf), ["portfolio_id"]).select("portfolio_id", "date", F.col("growth").alias("nav"))
    out = backtest.forward_test(stage(nav), table(spark, sf, "bench"), calendar.periods_between(quarter_instants(spark, sf)))
    return out.select("portfolio_id", "period_start", *[F.round(c, 6).alias(c) for c in ("portfolio_return", "benchmark_return", "alpha")], "hit")


@query(
    "snapshot_results",
    with_inputs("fin", "bench", extra={**PM, "sd": "select as_of_date as snapshot_date, sum(weight * coalesce(perf_3m, 0)) as p, count(*) as n, max(weight) * 100 as mp from pp group by 1",
      "ss": "select snapshot_date, max(x) * 100 as ms from (select as_of_date as snapshot_date, sector, sum(weight) as x from pp group by 1, 2) z group by 1",
      "bk": "select snapshot_date, case when count(*) >= 2 then (arg_max(close, date) / arg_min(close, date) - 1) * 100 else 0 end as b from sd join bench on date between snapshot_date and snapshot_date + 90 group by 1"})
    + f""" select snapshot_date, {even('p', 2)} as portfolio_return, {even('coalesce(b, 0)', 2)} as benchmark_return, {even('p - coalesce(b, 0)', 2)} as alpha, n as n_positions, {even('mp', 2)} as max_position_weight, {even('ms', 2)} as max_sector_weight
      from sd join ss using (snapshot_date) left join bk using (snapshot_date)""",
    "A19 A18 J7",
)
def _snapshots(spark, sf):
    rows = stage(weights.contributions(metric_positions(spark, sf), BY).withColumnRenamed("as_of_date", "snapshot_date"))
    return backtest.snapshot_results(rows, table(spark, sf, "bench"))


# --- scenarios ------------------------------------------------------------------------------------------------------

from stratafin.params import SCENARIOS  # noqa: E402

SCN = {
    **PM,
    "ex": "select as_of_date, 0.8 + avg(vol_30d) / 100 as be, avg(fcf / market_cap) as va, avg(net_margin) / 100 as qu, avg(perf_3m) / 100 as mo, sum(weight * weight) as hh from pp group by 1",
    "sc0": " union all ".join(f"select '{s.name}' as scenario, {s.market_drawdown}::double as m, {s.recovery_days} as rb, {s.value_impact}::double as iv, {s.quality_impact}::double as iq, {s.momentum_impact}::double as im, {s.concentration_impact}::double as ic" for s in SCENARIOS),
    "dd": "select as_of_date, scenario, m, rb, greatest(least(m * be + va * iv * abs(m) + qu * iq * abs(m) + mo * im * abs(m) + hh * 10 * ic * abs(m), 0), m * 1.5) as d from ex cross join sc0",
    "sh": f"select as_of_date, scenario, {even('m', 1)} as market_drawdown, {even('d', 1)} as portfolio_drawdown, {even('d - m', 1)} as relative_performance, floor(rb * abs(d / m))::int as recovery_days, case when d > -20 then 'low' when d > -35 then 'medium' when d > -50 then 'high' else 'extreme' end as risk_class from dd",
}


def shocks(spark, sf):
    e = metric_positions(spark, sf).groupBy("as_of_date").agg(
        (0.8 + F.avg("vol_30d") / 100).alias("beta"),
        F.avg(F.col("fcf") / F.col("market_cap")).alias("value_exposure"),
        (F.avg("net_margin") / 100).alias("quality_exposure"),
        (F.avg("perf_3m") / 100).alias("momentum_exposure"),
        F.sum(F.col("weight") * F.col("weight")).alias("concentration_hhi"),
    )
    return stress.scenario_shocks(e)


@query("scenario_shocks", with_inputs("fin", extra=SCN) + " select * from sh", "B21 J16")
def _shocks(spark, sf):
    return shocks(spark, sf).select("as_of_date", "scenario", "market_drawdown", "portfolio_drawdown", "relative_performance", "recovery_days", "risk_class")


@query(
    "scenario_summary",
    with_inputs("fin", extra=SCN)
    + f""" select as_of_date, min(portfolio_drawdown) as worst_portfolio_dd, {even('round(sum(portfolio_drawdown) * 10) / 10 / count(*)', 1)} as avg_portfolio_dd, min(relative_performance) as worst_relative_perf, {even('round(sum(relative_performance) * 10) / 10 / count(*)', 1)} as avg_relative_perf,
      count(*) filter (where relative_performance > 0) as scenarios_outperform, count(*) filter (where relative_performance < 0) as scenarios_underperform from sh group by 1""",
    "A36",
)
def _shock_summary(spark, sf):
    return stress.scenario_summary(shocks(spark, sf), BY)


# --- comparison ---------------------------------------------------------------------------------------------------------

EST = {
    **PM,
    "e": "select as_of_date, sum(weight * coalesce(perf_3m, 0)) as r, sum(weight * coalesce(nullif(vol_30d, 0), 25) / 100) as a, sum(power(weight * coalesce(nullif(vol_30d, 0), 25) / 100, 2)) as b, min(coalesce(perf_3m, 0)) as wo, count(*) as n from pp group by 1",
    "e1": "select *, sqrt(greatest(0.5 * a * a + 0.5 * b, 0)) * 100 as v from e",
    "e2": "select *, (r * 4 - 4.5) / v as s from e1",
    "bm": f"""select symbol as benchmark, {even('t', 2)} as rp, {even('v', 2)} as vp, {even('(t * 252 / n - 4.5) / v', 2)} as sp from (select symbol, count(*) as n, (arg_max(close, date) / arg_min(close, date) - 1) * 100 as t, stddev_samp(ret) * sqrt(252.0) * 100 as v
       from (select *, close / nullif(lag(close) over ({W}), 0) - 1 as ret from npx) q group by 1) z""",
    "cmp": f"""select as_of_date, benchmark, {even('r - rp', 2)} as alpha_pct, r - rp > 0 as outperformance, {even('s - sp', 2)} as sharpe_diff, {even('v - vp', 2)} as vol_diff, {even('r', 2)} > rp as beats from e2 cross join bm""",
}


def comparison(spark, sf):
    est = compare.portfolio_estimate(metric_positions(spark, sf), BY)
    npx = table(spark, sf, "npx").select("symbol", "date", "close")
    bench = metrics.benchmark_metrics(npx, ["symbol"]).withColumnRenamed("symbol", "benchmark")
    return compare.against_benchmarks(est, bench, BY)


@query(
    "portfolio_estimate",
    with_inputs("fin", "npx", extra=EST)
    + f" select as_of_date, {even('r', 2)} as return_pct, {even('v', 2)} as volatility_pct, {even('s', 2)} as sharpe, {even('least(wo * 0.5, -v * 0.3)', 2)} as max_drawdown_pct, n as positions from e2",
    "A31",
)
def _estimate(spark, sf):
    return compare.portfolio_estimate(metric_positions(spark, sf), BY).select("as_of_date", "return_pct", "volatility_pct", "sharpe", "max_drawdown_pct", "positions")


@query("benchmark_comparison", with_inputs("fin", "npx", extra=EST) + " select * from cmp", "A31 A30")
def _comparison(spark, sf):
    return comparison(spark, sf)


@query(
    "outperformance_verdict",
    with_inputs("fin", "npx", extra={**EST, "g": "select as_of_date, max(beats) as beats_any, min(beats) as beats_all, count(*) filter (where beats) as n_beaten, count(*) as n_benchmarks from cmp group by 1"})
    + " select *, beats_any as valid, case when beats_all then 'beats_all' when beats_any then 'beats_some' else 'underperforms' end as verdict from g",
    "A32",
)
def _outperformance(spark, sf):
    return compare.outperformance_verdict(comparison(spark, sf), BY)


@query(
    "series_acceptance",
    with_inputs("npx", "bench", extra={**STRESS, **PATH, "m": f"select portfolio_id, {even('(avg(ret) - 0.045 / 252) / stddev_samp(ret) * sqrt(252.0)', 3)} as sr, {even('min(dd) * 100', 2)} as md from pb group by 1",
      "sm": "select portfolio_id, count(*) filter (where passed) / count(*)::double >= 0.7 and min(portfolio_max_dd) >= -35 as ok from st group by 1"})
    + """ select portfolio_id, sr >= 0.55 and md >= -35 and coalesce(ok, true) as accepted, concat_ws('; ', case when sr < 0.55 then 'sharpe below floor' else 'sharpe ok' end,
      case when md < -35 then 'drawdown beyond hard limit' when md < -25 then 'drawdown beyond target' else 'drawdown ok' end, case when ok then 'stress ok' when not ok then 'stress failed' end) as notes from m left join sm using (portfolio_id)""",
    "A33",
)
def _series_acceptance(spark, sf):
    m = metrics.performance_metrics(series_returns(spark, sf), ["portfolio_id"])
    out = compare.acceptance(m, stress.stress_summary(stress_results(spark, sf)))
    return out.select("portfolio_id", "accepted", F.concat_ws("; ", "notes").alias("notes"))


@query(
    "fallback_estimate",
    with_inputs("fin", extra={**PM, "m": f"select as_of_date, count(*) as n, {even('sum(weight * coalesce(perf_3m, 0))', 2)} as p3, {even('sum(weight * coalesce(perf_ytd, 0))', 2)} as py, {even('sqrt(sum(weight * weight * power(coalesce(vol_30d, 25) / 100, 2))) * 100', 2)} as v from pp group by 1",
      "h": "select as_of_date, string_agg(symbol, ',' order by perf_ytd desc, symbol) as top from (select *, row_number() over (partition by as_of_date order by perf_ytd desc, symbol) as k from pp) z where k <= 5 group by 1",
      "l": "select as_of_date, string_agg(symbol, ',' order by perf_ytd, symbol) as worst from (select *, row_number() over (partition by as_of_date order by perf_ytd, symbol) as k from pp) z where k <= 5 group by 1"})
    + f" select as_of_date, p3 as return_pct, {even('(py - 4.5) / v', 2)} as sharpe_estimate, {even('-v * 1.5', 1)} as max_drawdown_estimate, n as positions, top as top_performers, worst as worst_performers from m join h using (as_of_date) join l using (as_of_date)",
    "A39",
)
def _fallback(spark, sf):
    rows = stage(metric_positions(spark, sf))
    out = compare.fallback_estimate(rows, weights.portfolio_metrics(rows, BY), BY)
    return out.select(
        "as_of_date", "return_pct", "sharpe_estimate", "max_drawdown_estimate", "positions",
        F.concat_ws(",", F.transform("top_performers", lambda x: x["symbol"])).alias("top_performers"),
        F.concat_ws(",", F.transform("worst_performers", lambda x: x["symbol"])).alias("worst_performers"),
    )


# --- alerts -----------------------------------------------------------------------------------------------------------------

AL = {
    **PM,
    "al": """select as_of_date, symbol as ticker, 'opportunity' as type, 'rsi_oversold' as rule, 'medium' as severity, rsi as value from pp where rsi < 30 and rsi <> 0
     union all select as_of_date, symbol, 'warning', 'rsi_overbought', 'medium', rsi from pp where rsi > 70 union all select as_of_date, symbol, 'risk', 'high_volatility', 'high', vol_30d from pp where vol_30d > 50
     union all select as_of_date, symbol, 'warning', 'deep_loss', 'high', perf_ytd from pp where perf_ytd < -30 union all select as_of_date, symbol, 'risk', 'high_debt', 'medium', debt_equity from pp where debt_equity > 2
     union all select as_of_date, symbol, 'warning', 'negative_roe', 'high', roe from pp where roe < 0 union all select as_of_date, symbol, 'warning', 'negative_fcf', 'medium', fcf from pp where fcf < 0
     union all select as_of_date, 'PORTFOLIO', 'risk', 'portfolio_volatility', 'medium', v from (select as_of_date, """ + even("sqrt(sum(weight * weight * power(coalesce(vol_30d, 25) / 100, 2))) * 100", 2) + """ as v from pp group by 1) z where v > 9""",
}


def portfolio_alert_rows(spark, sf):
    rows = stage(metric_positions(spark, sf))
    m = weights.portfolio_metrics(rows, BY)
    return alerts.position_alerts(rows, BY).unionByName(alerts.portfolio_alerts(m, BY, 9.0))


@query("portfolio_alerts", with_inputs("fin", extra=AL) + f" select as_of_date, ticker, type, rule, severity, {rnd('value', 4)} as value from al", "C29")
def _alerts(spark, sf):
    return portfolio_alert_rows(spark, sf).withColumn("value", F.round("value", 4))


@query(
    "alert_severity_counts",
    with_inputs("fin", extra=AL) + " select as_of_date, count(*) as count, count(*) filter (where severity = 'high') as high, count(*) filter (where severity = 'medium') as medium, count(*) filter (where severity = 'low') as low from al group by 1",
    "A38 S14",
)
def _severity(spark, sf):
    return alerts.severity_counts(portfolio_alert_rows(spark, sf), BY)


@query(
    "concentration_alerts",
    with_inputs("fin", extra={**RAWW, "v": "select *, cast(floor(cash) as bigint) % 100 + 0.5 as rsi, count(*) over (partition by as_of_date, sector) as cr from sw"})
    + f""" select as_of_date, symbol as ticker, 'concentration' as rule, {rnd('weight0')} as value from v where weight0 > 0.055 union all select as_of_date, symbol, 'low_score', {rnd('sc - 0.1')} from v where sc - 0.1 < 0.4
      union all select as_of_date, symbol, 'extreme_momentum', rsi from v where rsi > 70 or rsi < 30 union all select as_of_date, symbol, 'sector_crowding', cr from v where cr > 3""",
    "C30",
)
def _concentration(spark, sf):
    rows = raw_weights(spark, sf).withColumns(
        {"rsi": F.floor("cash").cast("bigint") % 100 + 0.5, "score_composite_v30": F.col("score_composite_v30") - 0.1}
    )
    out = alerts.concentration_alerts(rows, BY, "score_composite_v30")
    return out.select("as_of_date", "ticker", "rule", F.round("value", 6).alias("value"))


@query(
    "portfolio_risk_flags",
    with_inputs("fin", extra={**PM, "w": "select *, row_number() over (partition by as_of_date order by weight desc, symbol) as k, sum(weight) over (partition by as_of_date, sector) as s from pp"})
    + f""" select as_of_date, {rnd('sum(weight) filter (where k <= 3) * 100')} as top3_pct, {rnd('max(s) * 100')} as top_sector_pct, count(*) filter (where vol_30d > 40) as n_volatile, count(*) filter (where roe < 0) as n_negative_roe,
      count(*) filter (where debt_equity > 2) as n_high_debt, sum(weight) filter (where k <= 3) * 100 > 40 as concentrated, round(max(s) * 100, 9) > 35 as sector_overexposed from w group by 1""",
    "C28",
)
def _flags(spark, sf):
    out = alerts.risk_flags(metric_positions(spark, sf), BY)
    return out.withColumns({"top3_pct": F.round("top3_pct", 6), "top_sector_pct": F.round("top_sector_pct", 6)}).withColumn(
        "sector_overexposed", F.col("top_sector_pct") > 35
    )
