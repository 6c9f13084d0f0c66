"""Text captures built from the tables, parsed, and compared with the source columns; file round trips."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.derive import raw, table, with_inputs
from checks.q_portfolio import AL, POS, SUMM, WF_SQL, _walk_forward_weights, oos_periods, portfolio_alert_rows, positions
from checks.q_screens import DIRECTION_SQL
from checks.q_series import PATH, STRESS, series_returns, stress_results
from checks.registry import even, query, rnd
from stratafin.functions import text as tx
from stratafin.operators.overlay import reconcile_zero_list
from stratafin.operators.series import simple_returns
from stratafin.plans import compare, metrics
from stratafin.session import stage, stage_folder
from stratafin.sources import readers, sinks, text_blocks


def letters(c):
    """Digits to letters, so numeric keys make valid tickers."""
    return F.translate(c, "0123456789", "ABCDEFGHIJ")


LETTERS = "translate({}, '0123456789', 'ABCDEFGHIJ')"


def folder(spark, name):
    return f"{stage_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# --- cells -------------------------------------------------------------------------------------------

CELLS_SQL = """
with p as (select p_partkey, p_retailprice as x, p_size as n, p_partkey % 4 as k from part)
select p_partkey, x as money_value, case k when 0 then x / 1000 when 1 then x when 2 then x * 1000.0 else x end as millions,
  case k when 0 then x / 1000000 when 1 then x / 1000 when 2 then x * 1000.0 else x end as billions,
  case k when 0 then x / 1000 when 1 then x when 2 then x * 1000.0 else (case when x * 1000 > 1000000 then x * 1000 / 1000000 else x * 1000 end) end as shares,
  case k when 0 then x / 1000 when 2 then x * 1000.0 else x end as money_millions, x as price, -(n + 0.5)::double as activity, case k when 0 then -x / 1000 else -x end as activity_shares,
  (n + 0.25)::double as change, (n * 1000)::int as whole, 0.0::double as bad from p
"""


@query("text_cells", CELLS_SQL, "T2 T6 T7 T8 T9 T10 T11 T12 T13")
def _cells(spark, sf):
    p = raw(spark, sf, "part").select(
        "p_partkey", F.col("p_retailprice").cast("string").alias("x"), F.col("p_retailprice").alias("v"), F.col("p_size").alias("n"), (F.col("p_partkey") % 4).alias("k")
    )
    s = lambda *names: F.element_at(F.array(*[F.lit(x) for x in names]), F.col("k").cast("int") + 1)
    n = F.col("n").cast("string")
    shares = F.when(F.col("k") == 3, (F.col("v") * 1000).cast("decimal(20,2)").cast("string")).otherwise(F.col("x"))
    activity = F.concat(F.lit("-"), n, F.lit(".5% (-"), F.col("x"), s("k", "M", "", ""), F.lit(")"))
    out = p.select(
        "p_partkey",
        tx.money(F.concat(F.lit("$ "), F.format_number("v", 2))).alias("money_value"),
        tx.magnitude_millions(F.concat(F.lit("($"), F.col("x"), s("K", "M", "b", ""), F.lit(")"))).alias("millions"),
        tx.money_billions(F.concat(F.lit("$ "), F.col("x"), s("K", "M", "T", ""))).alias("billions"),
        tx.shares_millions(F.concat(shares, s("K", "M", "B", ""))).alias("shares"),
        tx.money_millions(F.concat(F.lit("$"), F.col("x"), s("K", "M", "B", ""))).alias("money_millions"),
        tx.first_price(F.concat(F.lit("at $"), F.col("x"), F.lit(" each"))).alias("price"),
        tx.activity_pct(activity).alias("activity"),
        tx.activity_shares(activity).alias("activity_shares"),
        tx.price_change_pct(F.concat(F.lit("$14.62 (+1.0%) (+"), n, F.lit(".25%)"))).alias("change"),
        tx.int_text(F.concat(n, F.lit(",000"))).alias("whole"),
        tx.money(F.lit("n/a")).alias("bad"),
    )
    return out.withColumn("bad", F.col("bad").cast("double"))


@query(
    "trade_direction_and_flags",
    """with e as (select event_id, event_type, value, user_id % 6 as r from events), t as (select event_id, value, case event_type when 'view' then 'Market Sale' when 'click' then '' when 'error' then 'Tax payment' when 'signup' then 'Option exercise' else 'Purchase' end as ty,
       case when value > 20 then '↑' when value > 10 then '-5K' else '' end as ch, case r when 0 then 'CEO' when 1 then 'Major Shareholder' when 2 then 'Director' when 3 then 'General Counsel' when 4 then 'CFO' else '' end as role from e),
      d as (select *, case when ty = 'Market Sale' then 'Sell' when ty = 'Purchase' then 'Buy' when ty = 'Tax payment' then 'Sell' when ty = 'Option exercise' then 'Exercise' when ch = '-5K' then 'Sell' when ch = '↑' then 'Buy' else 'Unknown' end as direction from t)
      select event_id, direction, role, 'Jane Doe' as name, case when ty = 'Tax payment' then false when direction = 'Buy' and role in ('CEO', 'CFO', 'Director') then true else coalesce(abs(value) > 1, false) end as is_informative from d""",
    "T14 T15 T16",
)
def _directions(spark, sf):
    r = F.col("user_id") % 6
    role = F.when(r == 0, "CEO").when(r == 1, "Major Shareholder").when(r == 2, "Director").when(r == 3, "General Counsel").when(r == 4, "CFO").otherwise("")
    kind = F.col("event_type")
    ty = F.when(kind == "view", "Market Sale").when(kind == "click", "").when(kind == "error", "Tax payment").when(kind == "signup", "Option exercise").otherwise("Purchase")
    ch = F.when(F.col("value") > 20, "↑").when(F.col("value") > 10, "-5K").otherwise("")
    rows = raw(spark, sf, "events").select("event_id", "value", ty.alias("ty"), ch.alias("ch"), F.concat(F.lit("Jane | "), F.lit("Doe - "), role).alias("cell"))
    name, found = tx.split_role(F.col("cell"))
    rows = rows.withColumns({"name": name, "role": found, "direction": tx.trade_direction(F.col("ch"), F.col("ty"))})
    return rows.select("event_id", "direction", "role", "name", tx.informative_trade(F.col("ty"), F.col("role"), F.col("direction"), F.col("value")).alias("is_informative"))


# --- consensus lines -----------------------------------------------------------------------------------

CONS_SQL = {
    "c": f"select {LETTERS.format('substr(symbol, 4)')} as s0, symbol, year, company, cast(floor(cash) as bigint) % 11 as b, revenue, price from fin",
    "c1": "select *, case when year = 1997 then s0 || '9' else s0 end as s1, year = 1998 as short from c",
}


def consensus_lines(spark, sf):
    b = F.floor("cash").cast("bigint") % 11
    ticker = letters(F.substring("symbol", 4, 10))
    ticker = F.when(F.col("year") == 1997, F.concat(ticker, F.lit("9"))).otherwise(ticker)
    full = F.concat_ws(
        "\t", F.lower(ticker), F.col("company"), (b / 100.0).cast("string"), b.cast("string"),
        F.concat(F.lit("$"), F.format_number("revenue", 2)), F.concat(F.lit("$"), F.col("price").cast("string")), F.lit("$1.5"), F.lit("12.5%"), F.lit("$ 2,000"),
    )
    line = F.when(F.col("year") == 1998, F.substring_index(full, "\t", 8)).otherwise(full)
    rows = table(spark, sf, "fin").select("symbol", "year", line.alias("line"))
    header = rows.where("year = 1995").withColumn("line", F.lit("Symbol\tStock\t%\tBuys"))
    return rows.unionByName(header)


@query(
    "consensus_text_rows",
    with_inputs("fin", extra=CONS_SQL)
    + f""" select upper(s0) as symbol, year, company as company_name, (b / 100.0)::double as portfolio_weight, b::int as buys_6m, {rnd('revenue', 2)} as hold_price, price as current_price, 1.5::double as low_52w, 12.5::double as pct_above_52w_low, 2000.0::double as high_52w,
      case when b >= 8 then 'A' when b >= 6 then 'B' when b >= 3 then 'C' else 'D' end as buys_tier from c1 where year not in (1997, 1998)""",
    "T1 T2 T3",
)
def _consensus_rows(spark, sf):
    good, _ = text_blocks.split_errors(text_blocks.parse_consensus(consensus_lines(spark, sf)))
    return good.drop("line")


@query(
    "consensus_text_quarantine",
    with_inputs("fin", extra=CONS_SQL)
    + " select year, case when short then 'too few columns (8/9)' else 'invalid symbol' end as reason, count(*) as n from c1 where year in (1997, 1998) group by all",
    "T1",
)
def _consensus_bad(spark, sf):
    _, bad = text_blocks.split_errors(text_blocks.parse_consensus(consensus_lines(spark, sf)))
    reason = F.when(F.col("error").startswith("invalid symbol"), "invalid symbol").otherwise(F.col("error"))
    return bad.groupBy("year", reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


# --- insider captures ------------------------------------------------------------------------------------

TR_SQL = {
    "t": f"select *, event_id // 100 as doc, {LETTERS.format('symbol')} as tk, {DIRECTION_SQL} as direction from trades",
    "x": """select event_id, tk as ticker, 'Ann Lee' as insider_name, case when role = '' then '' else role end as role, trade_type, direction, (case when direction = 'Sell' then -1 else 1 end) * 2.5 as change_shares_millions, 12.25::double as avg_price,
      round(round(abs(value), 2) + 0.01, 2) as v, 3000.0::double as shares_owned_millions, strftime(trade_date, '%Y-%m-%d') as trade_date from t""",
    "y": """select event_id, ticker, insider_name, role, trade_type, direction, change_shares_millions::double as change_shares_millions, avg_price, case when direction = 'Sell' then -v else v end as transaction_value_millions, shares_owned_millions, trade_date,
      case when trade_type like '%Tax%' then false when direction = 'Buy' and role in ('CEO', 'CFO', 'Director') then true else v > 1 end as is_informative from x""",
}


def insider_docs(spark, sf):
    """About a hundred trades per capture; odd captures in the eight-line layout, and every third with
    its header on line 40."""
    t = table(spark, sf, "trades").withColumn("doc", F.floor(F.col("event_id") / 100))
    ticker, value = letters(F.col("symbol")), F.concat(F.lit("$"), F.format_string("%.2f", F.round(F.abs("value"), 2) + 0.01), F.lit("M"))
    date = F.col("trade_date").cast("string")
    title = F.concat(F.lit("id"), F.col("event_id").cast("string"))
    line = F.concat_ws("\t", ticker, F.concat_ws(" ", F.lit("Ann Lee"), F.col("role")), "trade_type", F.lit("2500K"), F.lit("$12.25"), value, F.lit("3B"), title, date, date)
    # a role line that looks like a ticker must stay inside its block
    block = F.concat_ws("\n", F.concat_ws("\t", ticker, F.lit("Ann Lee")), F.when(F.col("role") == "", F.lit(",")).otherwise(F.col("role")), F.col("trade_type"), F.lit("2500K"), F.lit("$12.25"), value, F.lit("3B"), F.concat_ws("\t", title, date, date))
    rows = t.select("doc", "event_id", F.when(F.col("doc") % 2 == 0, line).otherwise(block).alias("piece"))
    docs = rows.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("event_id", "piece"))).alias("p"))
    body = F.array_join(F.transform("p", lambda x: x["piece"]), "\n")
    notes = F.when(F.col("doc") % 3 == 0, "a note before the table\n" * 39).otherwise("")
    text = F.concat(notes, F.lit("Stock\tInsider Trading\n\n"), body, F.when(F.col("doc") % 2 == 0, F.lit("\n---\nbad line")).otherwise(F.lit("\n")))
    return docs.select(F.col("doc").cast("string").alias("doc_id"), text.alias("text"))


@query(
    "insider_captures",
    with_inputs("trades", extra=TR_SQL) + " select * from y",
    "T17 T18 T14 T15 T16 S2",
)
def _insider(spark, sf):
    parsed = text_blocks.parse_insider(insider_docs(spark, sf)).where("error is null")
    return parsed.select(
        F.substring("title", 3, 20).cast("bigint").alias("event_id"), "ticker", "insider_name", "role", "trade_type", "direction", "change_shares_millions", "avg_price",
        "transaction_value_millions", "shares_owned_millions", "trade_date", "is_informative",
    )


@query(
    "insider_capture_errors",
    with_inputs("trades", extra=TR_SQL) + " select 'too few columns' as error, count(distinct doc) as n from t where doc % 2 = 0",
    "T17",
)
def _insider_bad(spark, sf):
    parsed = text_blocks.parse_insider(insider_docs(spark, sf)).where("error is not null")
    return parsed.groupBy("error").agg(F.count(F.lit(1)).alias("n"))


# --- institutional captures ---------------------------------------------------------------------------------

INST_SQL = {
    "h": f"select symbol, any_value(company) as company, any_value(sector) as sector, {LETTERS.format('substr(symbol, 3)')} as ticker, count(distinct fund) as th, count(*) as md, sum(n_lines)::bigint as lg, round(sum(value) / 1e6, 2) as vb, cast(substr(symbol, 2) as bigint) as k from hold group by symbol",
}


def institutional_docs(spark, sf):
    h = table(spark, sf, "hold").groupBy("symbol").agg(
        F.max("company").alias("company"), F.max("sector").alias("sector"), F.countDistinct("fund").alias("th"), F.count(F.lit(1)).alias("md"),
        F.sum("n_lines").alias("lg"), F.round(F.sum("value") / 1e6, 2).alias("vb"),
    )
    k = F.substring("symbol", 2, 10).cast("bigint")
    ticker = letters(F.substring("symbol", 3, 10))
    company = F.concat(F.when(k % 5 == 0, F.lit("3M ")).otherwise(F.lit("")), F.regexp_replace("company", "#", " No "), F.lit(" Co"))
    stats = F.concat_ws(" ", F.format_number("th", 0), F.col("md").cast("string"), F.col("lg").cast("string"))
    value = F.concat(F.lit("$ "), F.col("vb").cast("string"), F.lit("B"))
    same_line = F.concat_ws("\n", ticker, F.concat_ws(" ", company, stats), value, F.col("sector"))
    own_line = F.concat_ws("\n", ticker, company, stats, value, F.col("sector"), F.lit("$86,62"), F.lit("$212,19"))
    rows = h.select(F.floor(k / 50).alias("doc"), "symbol", F.when(k % 2 == 0, same_line).otherwise(own_line).alias("piece"))
    docs = rows.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("symbol", "piece"))).alias("p"))
    text = F.concat(F.lit("Stock  Company Name\n"), F.array_join(F.transform("p", lambda x: x["piece"]), "\n\n"))
    return docs.select(F.col("doc").cast("string").alias("doc_id"), text.alias("text"))


@query(
    "institutional_captures",
    with_inputs("hold", extra=INST_SQL)
    + f""" select ticker, case when k % 5 = 0 then '3M ' else '' end || replace(company, '#', ' No ') || ' Co' as company_name, th::int as total_holders, md::int as medium_stakes, lg::int as large_stakes, {even('vb', 2)} as value_owned_billions, sector,
      case when th > 50000 then 'suspect holder count' else '' end as errors from h""",
    "T19 T20",
)
def _institutional(spark, sf):
    out = text_blocks.parse_institutional(institutional_docs(spark, sf))
    return out.select("ticker", "company_name", "total_holders", "medium_stakes", "large_stakes", "value_owned_billions", "sector", F.concat_ws("|", "errors").alias("errors"))


# --- fund captures --------------------------------------------------------------------------------------------

FUND_SQL = {
    "f": f"select fund, year, cast(substr(symbol, 2) as bigint) as k, {LETTERS.format('substr(symbol, 3)')} as ticker, company, sector, round(value / 1000.0, 5) as v, n_lines from hold",
}


def fund_docs(spark, sf):
    """One capture per fund, year and block of forty securities; odd years as blocks of lines."""
    h = table(spark, sf, "hold").withColumn("k", F.substring("symbol", 2, 10).cast("bigint"))
    v = F.round(F.col("value") / 1000.0, 5).cast("string")
    cells = [
        letters(F.substring("symbol", 3, 10)), F.col("company"), F.concat(F.col("n_lines").cast("string"), F.lit(".25%")), F.lit("-0.39%"), F.lit("8.57M"), F.concat(F.lit("$ "), v, F.lit("M")), F.concat(F.lit("$ "), v, F.lit("K")),
        F.lit("-36.56% (-4.5M)"), F.lit("$14.62 (+959.2%)"),
    ]
    row = F.concat_ws("\t", *cells, F.col("sector"), F.lit("2025-09-30"))
    block = F.concat_ws("\n", *cells, F.when(F.col("k") % 2 == 0, F.concat_ws("\t", "sector", F.lit("2025-09-30"))).otherwise(F.concat(F.col("sector"), F.lit("2025-09-30"))))
    rows = h.select("fund", "year", F.floor(F.col("k") / 40).alias("part"), "symbol", F.when(F.col("year") % 2 == 0, row).otherwise(block).alias("piece"))
    docs = rows.groupBy("fund", "year", "part").agg(F.array_sort(F.collect_list(F.struct("symbol", "piece"))).alias("p"), F.count(F.lit(1)).alias("n"))
    head = F.concat(
        F.lit("Jane Roe 13F Portfolio\n"), F.col("fund"), F.lit(" Capital | Someone Else | 7.17% | $1.5T | "), F.col("n").cast("string"), F.lit("\n")
    )
    header = F.when(F.col("year") % 2 == 0, F.lit("Stock\tCompany\t%\td\ts\tv\tt\ta\tp\tsector\tdate\n")).otherwise(F.lit(""))
    doc_id = F.concat_ws("/", "fund", F.col("year").cast("string"), F.col("part").cast("string"))
    late = F.when(F.col("part") % 2 == 0, "a note before the facts\n" * 12).otherwise("")
    later = F.when(F.col("part") % 3 == 0, "a note before the table\n" * 25).otherwise("")
    return docs.select(doc_id.alias("doc_id"), F.concat(late, head, later, header, F.array_join(F.transform("p", lambda x: x["piece"]), "\n")).alias("text"))


@query(
    "fund_captures",
    with_inputs("hold", extra=FUND_SQL)
    + """ select fund || '/' || year || '/' || (k // 40) as doc_id, fund || ' Capital' as fund_name, case when year % 2 = 0 then 'table' else 'vertical' end as layout, ticker, company as company_name, (n_lines + 0.25)::double as portfolio_pct, -0.39::double as delta_portfolio_pct,
      8.57::double as shares_owned_millions, v as value_millions, round(v / 1000, 8) as trade_value_millions, -36.56::double as latest_activity_pct, -4.5::double as latest_activity_shares, 14.62::double as avg_buy_price, 959.2::double as price_change_pct, sector, '2025-09-30' as date from f""",
    "T22 T23 T24",
)
def _funds(spark, sf):
    out = text_blocks.parse_fund_holdings(fund_docs(spark, sf)).drop("row_no")
    return out.withColumn("trade_value_millions", F.round("trade_value_millions", 8))


@query(
    "fund_headers",
    with_inputs("hold", extra=FUND_SQL)
    + """ select fund || '/' || year || '/' || (k // 40) as doc_id, any_value(fund) || ' Capital' as fund_name, 'Jane Roe' as portfolio_manager, 7.17::double as performance_3y, 1500.0::double as aum_billions, count(*)::int as total_holdings from f group by 1""",
    "T21",
)
def _headers(spark, sf):
    return text_blocks.parse_fund_headers(fund_docs(spark, sf)).drop("header_lines", "lines")


# --- lists ---------------------------------------------------------------------------------------------------------

LIST_SQL = {
    "u": f"select symbol, s_suppkey as k, {LETTERS.format('substr(symbol, 3)')} as ticker from uni",
}


def list_docs(spark, sf):
    """Grouped values, pairs, negatives, aliases and strangers, thirty tickers per capture."""
    u = table(spark, sf, "uni").select("symbol", F.col("s_suppkey").alias("k"), letters(F.substring("symbol", 3, 10)).alias("ticker"))
    piece = (
        F.when(F.col("k") % 5 == 0, F.concat((F.col("k") % 30 + 0.5).cast("string"), F.lit("% "), F.lower("ticker")))
        .when(F.col("k") % 5 == 3, F.concat(F.col("ticker"), F.lit(":"), (F.col("k") + 0.25).cast("string")))
        .when(F.col("k") % 5 == 4, F.concat(F.col("ticker"), F.lit("=-2")))
        .otherwise(F.col("ticker"))
    )
    docs = u.select(F.floor(F.col("k") / 30).alias("doc"), "k", piece.alias("piece")).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("k", "piece"))).alias("p"))
    return docs.select(F.col("doc").cast("string").alias("doc_id"), F.concat(F.array_join(F.transform("p", lambda x: x["piece"]), "; "), F.lit(" brk-b, 12345 a1")).alias("text"))


def members(spark, sf):
    return table(spark, sf, "uni").where("s_suppkey % 7 <> 0").select(letters(F.substring("symbol", 3, 10)).alias("ticker"))


@query(
    "metric_lists",
    with_inputs("uni", extra={**LIST_SQL, "g": "select *, k // 30 as doc, max(case when k % 5 = 0 then k end) over (partition by k // 30 order by k) as gk from u"})
    + """ select doc::varchar as doc_id, ticker, case k % 5 when 3 then k + 0.25 when 4 then null else gk % 30 + 0.5 end::double as value, k % 7 <> 0 as is_member from g
      union all select distinct (k // 30)::varchar, 'BRK.B', (max(case when k % 5 = 0 then k end) over (partition by k // 30)) % 30 + 0.5, false from u""",
    "T25 T27",
)
def _metric_lists(spark, sf):
    return text_blocks.parse_metrics(list_docs(spark, sf), members(spark, sf)).drop("first_pos")


@query(
    "ticker_lists",
    with_inputs("uni", extra=LIST_SQL)
    + """ select (k // 30)::varchar as doc_id, ticker, k % 7 <> 0 as is_member from u where k % 5 not in (3, 4) union all select distinct (k // 30)::varchar, 'BRK.B', false from u""",
    "T25 T26 D3",
)
def _ticker_lists(spark, sf):
    return text_blocks.member_check(text_blocks.parse_ticker_lists(list_docs(spark, sf)), members(spark, sf)).select("doc_id", "ticker", "is_member")


@query(
    "zero_list_reconciliation",
    with_inputs("uni", extra=LIST_SQL) + " select ticker from u where k % 2 = 0 and k % 3 <> 0",
    "T28",
)
def _zero(spark, sf):
    u = table(spark, sf, "uni").select(F.col("s_suppkey").alias("k"), letters(F.substring("symbol", 3, 10)).alias("ticker"))
    return reconcile_zero_list(u.where("k % 3 = 0"), u.where("k % 2 = 0"))


# --- file round trips ----------------------------------------------------------------------------------------------


@query(
    "portfolio_documents_roundtrip",
    with_inputs("fin", extra=POS) + f" select as_of_date, symbol, sector, {rnd('weight')} as weight, revenue from pw",
    "S13",
)
def _documents(spark, sf):
    path = folder(spark, "portfolio-json")
    sinks.write_portfolio_json(positions(spark, sf), path)
    back = sinks.read_portfolio_documents(spark, path)
    return back.select("as_of_date", "symbol", "sector", F.round("weight", 6).alias("weight"), "revenue")


@query(
    "portfolio_csv_roundtrip",
    with_inputs("fin", extra=POS) + f" select as_of_date, symbol, company, {rnd('weight')} as weight from pw",
    "S12",
)
def _csv(spark, sf):
    path = folder(spark, "portfolio-csv")
    rows = positions(spark, sf).select("as_of_date", "symbol", "company", "weight")
    sinks.write_portfolio_csv(rows, path)
    back = readers.read_table(spark, path, "symbol string, company string, weight double, as_of_date date")
    return back.select("as_of_date", "symbol", "company", F.round("weight", 6).alias("weight"))


@query(
    "fundamentals_cache_roundtrip",
    with_inputs("fin") + " select symbol, as_of_date, revenue, equity from fin where as_of_date = date '1998-12-31'",
    "S11 S5",
)
def _cache(spark, sf):
    path = folder(spark, "fundamentals")
    sinks.write_fundamentals(table(spark, sf, "fin"), path)
    return readers.read_fundamentals_cache(spark, path, "1998-12-31").select("symbol", "as_of_date", "revenue", "equity")


@query(
    "snapshot_history",
    with_inputs("fin", extra=POS) + f" select as_of_date as snapshot_date, symbol, sector, {rnd('weight')} as weight, revenue from pw",
    "S10 S13",
)
def _snapshots(spark, sf):
    """Two writes of different dates, the first of them rewritten: all dates come back, each once."""
    path, rows = folder(spark, "snapshots"), stage(positions(spark, sf))
    early = F.year("as_of_date") < 1996
    sinks.write_portfolio_json(rows.where(early).withColumn("weight", F.col("weight") / 2), path)
    sinks.write_portfolio_json(rows.where(~early), path)
    sinks.write_portfolio_json(rows.where(early), path)
    back = readers.read_snapshots(spark, path)
    return back.select("snapshot_date", "symbol", "sector", F.round("weight", 6).alias("weight"), "revenue")


@query(
    "fundamentals_dated_store",
    with_inputs("fin") + " select symbol, as_of_date, revenue, as_of_date = (select max(as_of_date) from fin) as newest from fin",
    "S11",
)
def _dated_store(spark, sf):
    """Dates written one after the other; the newest one is found from the markers."""
    path, rows = folder(spark, "fundamentals-dated"), stage(table(spark, sf, "fin"))
    for part in (F.year("as_of_date") % 2 == 0, F.year("as_of_date") % 2 == 1):
        sinks.write_fundamentals(rows.where(part), path)
    newest = sinks.complete_dates(spark, path)[-1]
    return readers.read_fundamentals_cache(spark, path).select("symbol", "as_of_date", "revenue", (F.col("as_of_date") == F.lit(newest).cast("date")).alias("newest"))


@query("benchmark_series_file", with_inputs("bench") + " select date, close, close / lag(close) over (order by date) - 1 as ret from bench", "S6 W5")
def _benchmark_file(spark, sf):
    path = folder(spark, "benchmark") + ".csv"
    table(spark, sf, "bench").select("date", "close").write.option("header", True).csv(path)
    back = readers.read_table(spark, path, "date date, close double").withColumn("symbol", F.lit("*"))
    return simple_returns(back).select("date", "close", "ret")


@query(
    "price_documents",
    with_inputs("px") + " select symbol, date, close from px",
    "S8",
)
def _price_documents(spark, sf):
    path = folder(spark, "prices")
    value = F.struct(F.concat(F.col("date").cast("string"), F.lit(" 16:00:00")).alias("datetime"), F.col("close").cast("string").alias("close"))
    # one document per symbol and year
    docs = table(spark, sf, "px").groupBy("symbol", F.year("date").alias("y")).agg(F.collect_list(value).alias("values"))
    docs.select(F.struct("symbol").alias("meta"), "values").write.json(path)
    return readers.read_price_documents(spark, path, lines=True)


@query(
    "symbol_csv_folder",
    with_inputs("npx", extra={"s": "select symbol, min(date) as a, max(date) as b, count(*) as n from npx group by 1"})
    + " select symbol, a as first_date, b as last_date, a <= date '1995-01-03' and b >= date '2001-11-04' - 5 as covered from s",
    "S7",
)
def _symbol_csvs(spark, sf):
    path = folder(spark, "csv")
    npx = table(spark, sf, "npx").select("symbol", F.col("date").cast("string").alias("date"), "close")
    npx.write.partitionBy("symbol").option("header", True).csv(path)
    rows = readers.read_symbol_csvs(spark, path)
    return readers.range_coverage(rows, "1995-01-03", "2001-11-04")


@query(
    "consensus_json",
    with_inputs("fin", extra={"c": "select *, cast(floor(cash) as bigint) % 11 as b from fin where year = (select max(year) from fin)"})
    + " select symbol, (b / 100.0)::double as gp_weight, b::int as gp_buys, 'D' as gp_tier, company, price as current_price, 0.0::double as low_52w from c",
    "S1",
)
def _consensus_json(spark, sf):
    path = folder(spark, "consensus")
    b = F.floor("cash").cast("bigint") % 11
    stock = F.struct("symbol", F.col("company").alias("company_name"), (b / 100.0).alias("portfolio_weight"), b.cast("int").alias("buys_6m"), F.col("price").alias("current_price"))
    fin = table(spark, sf, "fin")
    docs = fin.groupBy("as_of_date", F.floor(F.substring("symbol", 2, 10).cast("bigint") / 100)).agg(F.collect_list(stock).alias("stocks"))
    docs.select("as_of_date", "stocks").write.partitionBy("as_of_date").json(path)
    return readers.read_consensus(spark, path, newest=True, lines=True).select("symbol", "gp_weight", "gp_buys", "gp_tier", "company", "current_price", "low_52w")


@query(
    "insider_json",
    with_inputs("trades")
    + " select symbol, round(value, 4) as value, trade_type as transaction_type from trades where event_id % 2 = 0 union all select symbol, round(abs(value) * 1e6, 4), 'Buy' from trades where event_id % 2 = 1",
    "S2",
)
def _insider_json(spark, sf):
    path = folder(spark, "insider")
    t = table(spark, sf, "trades").withColumn("doc", F.floor(F.col("event_id") / 200))
    old = F.when(F.col("event_id") % 2 == 0, F.struct(F.lit("").alias("symbol"), F.col("symbol").alias("ticker"), "value", F.col("trade_type").alias("transaction_type")))
    new = F.when(F.col("event_id") % 2 == 1, F.struct(F.col("symbol").alias("ticker"), F.lit("Buy").alias("direction"), F.col("value").alias("transaction_value_millions")))
    t.groupBy("doc").agg(F.collect_list(old).alias("trades"), F.collect_list(new).alias("insider_trades")).drop("doc").write.json(path)
    out = readers.read_insider(spark, path, newest=False, lines=True)
    return out.select("symbol", F.round("value", 4).alias("value"), "transaction_type")


@query(
    "index_members_json",
    with_inputs("uni") + " select symbol from uni",
    "S3",
)
def _members_json(spark, sf):
    path = folder(spark, "members")
    u = table(spark, sf, "uni").withColumn("d", F.floor(F.col("s_suppkey") / 50))
    docs = u.groupBy("d").agg(F.collect_list("symbol").alias("s"))
    docs.select(F.when(F.col("d") % 2 == 0, F.col("s")).alias("tickers"), F.when(F.col("d") % 2 == 1, F.col("s")).alias("symbols")).write.json(path)
    return readers.read_members(spark, path, lines=True)


def yearly_documents(spark, sf):
    """Fundamentals with one document key per symbol and year, and the symbol's number."""
    fin = table(spark, sf, "fin").withColumn("symbol", F.concat_ws(".", "symbol", "year"))
    return fin, F.substring_index(F.substring("symbol", 2, 20), ".", 1).cast("bigint")


@query(
    "market_documents",
    with_inputs("fin", extra={"m": "select * replace (symbol || '.' || year as symbol), cast(substr(symbol, 2) as bigint) as k from fin"})
    + """ select symbol, price, volume, avg_volume, case when k % 3 = 0 then 'Unknown' else sector end as sector, industry, company, case when k % 4 = 0 then 50.0 else k % 100 + 0.5 end::double as rsi, price * 2 as high_52w from m""",
    "S9 P1",
)
def _market_documents(spark, sf):
    base = folder(spark, "market")
    fin, k = yearly_documents(spark, sf)
    s = lambda c: F.col(c).cast("string")
    fin.select(
        "symbol", s("price").alias("close"), F.lit("n/a").alias("percent_change"), s("volume").alias("volume"), s("avg_volume").alias("average_volume"),
        F.struct((F.col("price") * 2).cast("string").alias("high"), F.lit("").alias("low")).alias("fifty_two_week"),
    ).write.json(f"{base}/quote")
    fin.select("symbol", F.col("company").alias("name"), F.when(k % 3 == 0, F.lit("")).otherwise(F.col("sector")).alias("sector"), "industry").write.json(f"{base}/profile")
    fin.select("symbol", F.when(k % 4 != 0, F.array(F.struct(F.lit("2000-12-31").alias("datetime"), (k % 100 + 0.5).cast("string").alias("rsi")))).alias("values")).write.json(f"{base}/rsi")
    out = readers.read_market_documents(spark, f"{base}/quote", f"{base}/profile", f"{base}/rsi", lines=True)
    return out.select("symbol", "price", "volume", "avg_volume", "sector", "industry", "company", "rsi", "high_52w")


@query(
    "statement_documents",
    with_inputs("fin", extra={"m": "select * replace (symbol || '.' || year as symbol), cast(substr(symbol, 2) as bigint) as k from fin"})
    + """ select symbol, revenue, net_income, total_assets, equity, cash, case when k % 2 = 0 then total_debt end as short_term_debt, operating_cash_flow, capex, fcf as free_cash_flow, shares_outstanding from m""",
    "P3 P2 S9",
)
def _statement_documents(spark, sf):
    path = folder(spark, "statements")
    fin, k = yearly_documents(spark, sf)
    s = lambda c, n: F.col(c).cast("string").alias(n)
    zero = lambda n: F.lit("0").alias(n)
    fin.select(
        "symbol",
        F.struct(zero("sales"), s("revenue", "revenue"), s("net_income", "net_income_common_stockholders")).alias("income"),
        F.struct(
            F.struct(s("total_assets", "total_assets"), F.struct(s("cash", "cash")).alias("current_assets")).alias("assets"),
            F.struct(F.struct(F.when(k % 2 == 0, F.col("total_debt").cast("string")).alias("short_term_debt")).alias("current_liabilities")).alias("liabilities"),
            F.struct(zero("total_shareholders_equity"), s("equity", "stockholders_equity")).alias("shareholders_equity"),
        ).alias("balance"),
        F.struct(
            F.struct(s("operating_cash_flow", "net_cash_provided_by_operating_activities")).alias("operating_activities"),
            F.struct(s("capex", "capital_expenditure")).alias("investing_activities"),
            s("fcf", "free_cash_flow"),
        ).alias("cashflow"),
        F.struct(F.struct(s("shares_outstanding", "shares_outstanding")).alias("financials")).alias("statistics"),
    ).write.json(path)
    out = readers.read_statements(spark, path, lines=True)
    return out.select("symbol", "revenue", "net_income", "total_assets", "equity", "cash", "short_term_debt", "operating_cash_flow", "capex", "free_cash_flow", "shares_outstanding")


@query(
    "wide_price_panel",
    "with p as (select cast(l_shipdate as date) as date, l_returnflag as symbol, round(avg(l_extendedprice / l_quantity), 8) as close from lineitem group by 1, 2) select symbol, date, close from p",
    "S4",
)
def _wide(spark, sf):
    li = raw(spark, sf, "lineitem")
    daily = li.groupBy(F.col("l_shipdate").cast("date").alias("date")).pivot("l_returnflag", ["A", "N", "R"]).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")))
    return readers.long_prices(daily).withColumn("close", F.round("close", 8))


@query(
    "backtest_report_record",
    with_inputs("cpx", "cbench", extra=SUMM) + " select count(*)::int as n_configs, 'core,core_holder,holder_reduced' as configs from su",
    "S15 S16",
)
def _report(spark, sf):
    path = folder(spark, "report")
    attributed = compare.attribution(metrics.config_summary(oos_periods(spark, sf), ["config_id"]))
    sinks.write_report(sinks.attribution_report(attributed), path)
    back = spark.read.schema("configs map<string, struct<cagr: double, verdict: string>>, n_configs int").json(path)
    return back.select("n_configs", F.array_join(F.array_sort(F.map_keys("configs")), ",").alias("configs"))


@query(
    "alerts_written",
    with_inputs("fin", extra=AL) + f""" select as_of_date, ticker, rule, severity, {rnd('value', 4)} as value, count(*) over w as count, count(*) filter (where severity = 'high') over w as high
      from al window w as (partition by as_of_date)""",
    "S14",
)
def _alerts_written(spark, sf):
    """Alert rows and their counts, written in two parts and read back together."""
    path, rows = folder(spark, "alerts"), stage(portfolio_alert_rows(spark, sf))
    for part in (F.year("as_of_date") < 1996, F.year("as_of_date") >= 1996):
        sinks.write_alerts(rows.where(part), path)
    counts = spark.read.parquet(f"{path}/severity").select("as_of_date", "count", "high")
    return spark.read.parquet(f"{path}/alerts").join(counts, "as_of_date").select("as_of_date", "ticker", "rule", "severity", F.round("value", 4).alias("value"), "count", "high")


REPORT = {**STRESS, **PATH, "mt": f"select portfolio_id, count(*) as n, min(date) as d0, {even('(product(1 + ret) - 1) * 100', 2)} as total, {even('min(dd) * 100', 2)} as md from pe group by 1 having count(*) >= 10"}


@query(
    "backtest_report_stress",
    with_inputs("npx", "bench", extra=REPORT)
    + """ select mt.portfolio_id, mt.n as num_periods, mt.d0 as start_date, mt.total as total_return, mt.md as max_drawdown, st."window" as stress_window, st.portfolio_return as stress_return, st.passed
      from mt left join st using (portfolio_id)""",
    "S15",
)
def _report_stress(spark, sf):
    """The record of each backtest with its stress windows, written and read back."""
    path = folder(spark, "backtest-report")
    report = sinks.backtest_report(metrics.performance_metrics(series_returns(spark, sf), ["portfolio_id"]), stress=stress_results(spark, sf))
    sinks.write_backtest_report(report, path)
    back = spark.read.schema(report.schema).json(f"{path}/report")
    rows = back.select("portfolio_id", "period", "returns", "risk", F.explode_outer("stress_tests").alias("s"))
    return rows.select("portfolio_id", "period.num_periods", "period.start_date", "returns.total_return", "risk.max_drawdown", F.col("s.window").alias("stress_window"), F.col("s.portfolio_return").alias("stress_return"), "s.passed")


@query(
    "backtest_report_holdings",
    with_inputs("fin", "px", extra=WF_SQL) + f" select rd as rebalance_date, symbol, {rnd('weight')} as weight from qw",
    "S15",
)
def _report_holdings(spark, sf):
    """The positions of every rebalance as rows beside the record."""
    path = folder(spark, "backtest-holdings")
    held = stage(_walk_forward_weights(spark, sf))
    record = held.groupBy(F.lit("strategy").alias("portfolio_id")).agg(F.min("rebalance_date").alias("start_date"), F.countDistinct("rebalance_date").alias("num_periods"))
    sinks.write_backtest_report(sinks.backtest_report(record), path, held)
    return spark.read.parquet(f"{path}/holdings").select("rebalance_date", "symbol", F.round("weight", 6).alias("weight"))
