"""Domain inputs derived from the supplied tables, as SQL text both engines run.

The text below only *builds inputs* (universe, fundamentals, prices, holdings,
trades, text lines).  The operators under test are never part of it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from stratafin.session import tune

RAW = ["region", "nation", "supplier", "customer", "part", "orders", "lineitem", "events", "documents", "labels"]

INPUTS: dict[str, str] = {}

INPUTS["uni"] = """
select concat('S', lpad(cast(s_suppkey as string), 6, '0')) as symbol, s_suppkey, s_name as company,
       r_name as sector, n_name as industry, s_acctbal / 10000.0 as a
from {supplier} join {nation} on s_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey
"""

# one pass over lineitem: sums per supplier and ship year
INPUTS["yearly"] = """
select l_suppkey, cast(year(l_shipdate) as int) as year, cast(count(*) as double) as n, sum(l_quantity) as q,
       round(sum(l_extendedprice), 2) as ext, round(sum(l_extendedprice * l_discount), 4) as dis,
       round(sum(l_extendedprice * l_tax), 4) as tax, round(avg(l_extendedprice / l_quantity), 8) as px
from {lineitem} group by l_suppkey, year(l_shipdate)
"""

INPUTS["fin"] = """
select symbol, company, sector, industry, year, make_date(year, 12, 31) as as_of_date,
       px as price, 1000.0 + q as shares_outstanding, ext as revenue,
       round(0.4 * ext - dis, 4) as gross_profit,
       round(ext * (0.04 + 0.2 * a) - dis + 0.04 * ext, 6) as ebit,
       round(0.7 * (ext * (0.08 + 0.2 * a) - dis) - 0.01 * ext, 6) as net_income,
       round(0.5 * tax + 0.6 * (ext * (0.08 + 0.2 * a) - dis), 6) as operating_cash_flow,
       round(0.0 - 0.3 * tax, 6) as capex,
       round(0.2 * tax + 0.6 * (ext * (0.08 + 0.2 * a) - dis), 6) as fcf,
       case when a > 0.85 then 0.0 else round(500.0 * q * (1.1 - a), 6) end as total_debt,
       dis as cash,
       round(a * 3000000.0 * n / 85.0 + 20.0 * q, 6) as equity,
       round(a * 3000000.0 * n / 85.0 + 500.0 * q + 0.3 * ext, 6) as total_assets,
       round(dis + 0.2 * ext, 4) as current_assets,
       round(0.1 * ext + 100.0 * q * (1.1 - a), 6) as current_liabilities,
       case when s_suppkey % 7 = 3 then null else round(25.0 * q * (1.1 - a), 6) end as interest_expense,
       round(q / 250.0, 4) as avg_volume, round(n / 2.0, 4) as volume
from yearly join uni on l_suppkey = s_suppkey
"""

INPUTS["px"] = """
select symbol, sector, date, close from (
  select l_suppkey, cast(l_shipdate as date) as date, round(avg(l_extendedprice / l_quantity), 8) as close
  from {lineitem} group by l_suppkey, cast(l_shipdate as date)) d
join uni on l_suppkey = s_suppkey
"""

# dense series: one per nation and day
INPUTS["npx"] = """
select industry as symbol, min(sector) as sector, date, round(sum(sp) / sum(n), 8) as close from (
  select l_suppkey, cast(l_shipdate as date) as date, sum(l_extendedprice / l_quantity) as sp, cast(count(*) as double) as n
  from {lineitem} group by l_suppkey, cast(l_shipdate as date)) d
join uni on l_suppkey = s_suppkey group by industry, date
"""

# market series: all suppliers together
INPUTS["bench"] = """
select cast(l_shipdate as date) as date, round(avg(l_extendedprice / l_quantity), 8) as close
from {lineitem} group by cast(l_shipdate as date)
"""

# calmer versions of both, so that compounded returns stay in a usual range
INPUTS["cpx"] = "select symbol, sector, date, round(1500.0 + (close - 1500.0) / 20.0, 8) as close from px"
INPUTS["cbench"] = "select date, round(1500.0 + (close - 1500.0) / 20.0, 8) as close from bench"

INPUTS["trades"] = """
select event_id, cast(ts as date) as trade_date, concat('T', cast(user_id % 37 as string)) as symbol,
       concat('U', cast(user_id as string)) as insider_name,
       case user_id % 5 when 0 then 'CEO' when 1 then 'Director' when 2 then 'CFO' when 3 then '10% Owner' else '' end as role,
       case event_type when 'purchase' then 'Purchase' when 'view' then 'Sale' when 'click' then 'Gift'
            when 'signup' then 'Buy' else 'Sale + Tax Liability' end as trade_type,
       coalesce(value, 0.0) as value
from {events}
"""

INPUTS["hold"] = """
select concat('F', cast(o_custkey as string)) as fund, symbol, company, sector,
       cast(year(o_orderdate) as int) as year, make_date(cast(year(o_orderdate) as int), 12, 31) as as_of_date,
       round(sum(l_extendedprice), 2) as value, cast(count(*) as bigint) as n_lines
from {orders} join {lineitem} on o_orderkey = l_orderkey join uni on l_suppkey = s_suppkey
group by 1, 2, 3, 4, 5, 6
"""


def needs(names: tuple[str, ...]) -> list[str]:
    """Inputs in dependency order."""
    out: list[str] = []

    def visit(name: str) -> None:
        for other in INPUTS:
            if other != name and re.search(rf"\b(from|join)\s+{other}\b", INPUTS[name]):
                visit(other)
        if name not in out:
            out.append(name)

    for n in names:
        visit(n)
    return out


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A derived input as a Spark DataFrame over the whole parquet tables."""
    tune(spark)
    chain = needs((name,))
    text = "with " + ", ".join(f"{n} as ({INPUTS[n]})" for n in chain) + f" select * from {name}"
    used = {r: spark.read.parquet(f"{sf}/{r}.parquet") for r in RAW if "{" + r + "}" in text}
    return spark.sql(text, **used)


def raw(spark: SparkSession, sf: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def with_inputs(*names: str, extra: dict[str, str] | None = None) -> str:
    """``with ...`` prefix for a DuckDB oracle; ``extra`` adds further steps in order."""
    parts = [f"{n} as ({INPUTS[n]})" for n in needs(names)]
    parts += [f"{n} as ({body})" for n, body in (extra or {}).items()]
    text = "with " + ", ".join(parts)
    for r in RAW:
        text = text.replace("{" + r + "}", r)
    return text
