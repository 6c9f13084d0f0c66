"""Pasted captures to rows.

A capture is one row ``(doc_id, text)``.  Parsing is row-wise: lines, blocks
and cells come from array functions and from regular expressions that consume
a block of lines at a time, so no file is collected, no window is needed and a
source with many captures is spread like any other rows.  Lines that do not
parse are kept in a quarantine with the reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratafin.functions import text as tx
from stratafin.functions.scalar import half_even, holds
from stratafin.operators.holdings import tier
from stratafin.operators.joins import exists_flag


def clean_lines(text: str | Column = "text") -> Column:
    """Trimmed, non-blank lines of a capture as an array."""
    source = F.col(text) if isinstance(text, str) else text
    trimmed = F.transform(F.split(source, "\n"), lambda x: F.btrim(x, F.lit(" \t\r\f\x0b\u00a0")))
    return F.filter(trimmed, lambda x: F.length(x) > 0)


def _cell(cells: str, index: int | Column) -> Column:
    """Cell by zero-based index; absent cells are blank."""
    at = F.lit(index + 1) if isinstance(index, int) else index + 1
    return F.coalesce(F.try_element_at(F.col(cells), at.cast("int")), F.lit(""))


def explode_lines(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``(*keep, line_no, line)`` with one-based numbers over non-blank lines."""
    return docs.select(*keep, F.posexplode(clean_lines()).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


# --- consensus table -----------------------------------------------------------------------------


def parse_consensus(lines: DataFrame, line: str = "line") -> DataFrame:
    """Nine tab-separated columns per line; headers are skipped, bad lines carry ``error``."""
    text = F.col(line)
    header = F.lower(text).startswith("symbol") | F.lower(text).contains("stock\t")
    rows = lines.where(~header).withColumn("_c", F.split(text, "\t"))
    symbol = F.upper(F.trim(_cell("_c", 0)))
    few = F.size("_c") < 9
    error = F.when(few, F.concat(F.lit("too few columns ("), F.size("_c").cast("string"), F.lit("/9)"))).when(
        ~symbol.rlike(tx.SYMBOL_PATTERN), F.concat(F.lit("invalid symbol "), symbol)
    )
    buys = tx.leading_int(_cell("_c", 3))
    return rows.withColumns(
        {
            "error": error,
            "symbol": symbol,
            "company_name": F.trim(_cell("_c", 1)),
            "portfolio_weight": tx.leading_number(_cell("_c", 2)),
            "buys_6m": buys,
            "hold_price": tx.money(_cell("_c", 4)),
            "current_price": tx.money(_cell("_c", 5)),
            "low_52w": tx.money(_cell("_c", 6)),
            "pct_above_52w_low": tx.leading_number(_cell("_c", 7)),
            "high_52w": tx.money(_cell("_c", 8)),
            "buys_tier": tier(buys),
        }
    ).drop("_c")


def split_errors(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows and quarantine."""
    return parsed.where(F.col("error").isNull()).drop("error"), parsed.where(F.col("error").isNotNull())


# --- insider trades ------------------------------------------------------------------------------------

_INSIDER_FIELDS = ["ticker", "cell", "trade_type", "change", "price", "value", "owned", "title", "trade_date", "filed_date"]


def _trade_columns(df: DataFrame, keep: list[str]) -> DataFrame:
    """Typed trade columns from the raw cells ``_f.*``."""
    cell = {n: F.col(f"_f.{n}") for n in _INSIDER_FIELDS}
    name, role = tx.split_role(cell["cell"])
    staged = df.withColumns(
        {
            "insider_name": name,
            "role": role,
            "direction": tx.trade_direction(cell["change"], cell["trade_type"]),
            "_change": tx.magnitude_millions(cell["change"]),
            "_value": tx.magnitude_millions(cell["value"]),
            "_owned": tx.magnitude_millions(cell["owned"]),
        }
    )
    sell = F.col("direction") == "Sell"
    staged = staged.withColumn("transaction_value_millions", F.when(sell, -F.abs("_value")).otherwise(F.col("_value")))
    return staged.select(
        *keep,
        F.upper(cell["ticker"]).alias("ticker"),
        "insider_name",
        "role",
        cell["trade_type"].alias("trade_type"),
        "direction",
        F.when(sell & (F.col("_change") > 0), -F.col("_change")).otherwise(F.col("_change")).alias("change_shares_millions"),
        tx.first_price(cell["price"]).alias("avg_price"),
        "transaction_value_millions",
        F.nullif("_owned", F.lit(0.0)).alias("shares_owned_millions"),
        cell["title"].alias("title"),
        tx.iso_date_text(cell["trade_date"]).alias("trade_date"),
        tx.iso_date_text(cell["filed_date"]).alias("filed_date"),
        tx.informative_trade(cell["trade_type"], F.col("role"), F.col("direction"), F.col("transaction_value_millions")).alias("is_informative"),
    )


def _cells_of(line: Column, has_tab: Column, keep_blank_tabs: bool) -> Column:
    by_tab = F.transform(F.split(line, "\t"), lambda x: F.trim(x))
    by_gap = F.filter(F.transform(F.split(line, r"\s{2,}"), lambda x: F.trim(x)), lambda x: x != "")
    if not keep_blank_tabs:
        by_tab = F.filter(by_tab, lambda x: x != "")
    return F.when(has_tab, by_tab).otherwise(by_gap)


def _within(lines: Column, n: int | None) -> Column:
    """All lines, or the first ``n``."""
    return lines if n is None else F.slice(lines, 1, n)


def _insider_body(docs: DataFrame, header_within: int | None, layout_within: int | None) -> DataFrame:
    """``doc_id, has_tab, lines`` after the header line, with the detected layout.

    The first line that reads like a header is one if no trade line comes before it.
    """
    rows = docs.select("doc_id", F.contains("text", F.lit("\t")).alias("has_tab"), clean_lines().alias("_all"))
    wide = lambda x: F.size(_cells_of(x, F.col("has_tab"), False)) >= 7
    like_header = lambda x: F.contains(x, F.lit("stock")) & (F.contains(x, F.lit("insider")) | F.contains(x, F.lit("trade")))
    kinds = F.transform(_within(F.col("_all"), header_within), lambda x: F.when(like_header(F.lower(x)), 1).when(wide(x), 2).otherwise(0))
    rows = rows.withColumn("_kinds", kinds)
    header, trade = F.array_position("_kinds", F.lit(1)).cast("int"), F.array_position("_kinds", F.lit(2)).cast("int")
    start = F.when((trade > 0) & (header > trade), 0).otherwise(header)
    body = F.slice("_all", start + 1, F.greatest(F.size("_all") - start, F.lit(0)))
    rows = rows.withColumn("lines", body).drop("_all", "_kinds")
    return rows.withColumn("row_layout", F.exists(_within(F.col("lines"), layout_within), wide))


_TAB_BLOCK = r"(?m)^[A-Z]{1,6}(?:[ ]*\t[^\n]*)?\n(?:[^\n]*\n){6}[^\n]*$"
_GAP_BLOCK = r"(?m)^[A-Z]{1,6}(?:[ ]{2,}[^\n]*)?\n(?:[^\n]*\n){6}[^\n]*$"


def parse_insider(docs: DataFrame, header_within: int | None = None, layout_within: int | None = None) -> DataFrame:
    """One trade per line, or eight lines per trade, chosen per capture from all its lines; the header
    and the layout may be looked for in the first so many lines only.

    In line layout the ticker column is found by its shape.  In block layout the
    expression consumes a whole block per match, so a role such as CEO inside a
    block is never mistaken for a ticker.  Both layouts are cut into pieces
    first and share one explode, so a capture is read and split once.
    """
    body = _insider_body(docs, header_within, layout_within)
    pattern = F.when(F.col("has_tab"), F.lit(_TAB_BLOCK)).otherwise(F.lit(_GAP_BLOCK))
    blocks = F.regexp_extract_all(F.array_join("lines", "\n"), pattern, F.lit(0))
    pieces = body.select(
        "doc_id", "has_tab", "row_layout", F.posexplode(F.when(F.col("row_layout"), F.col("lines")).otherwise(blocks)).alias("line_no", "piece")
    ).where(~F.col("piece").startswith("---"))
    per_line = F.col("row_layout")
    rows = pieces.withColumn("_l", F.split("piece", "\n"))
    rows = rows.withColumns(
        {
            "_c": _cells_of(F.col("_l")[0], F.col("has_tab"), True),
            "_last": F.when(~per_line, _cells_of(F.col("_l")[F.size("_l") - 1], F.col("has_tab"), False)),
        }
    )
    shaped = F.transform("_c", lambda x: x.rlike(tx.INSIDER_TICKER_PATTERN))
    rows = rows.withColumn("_at", F.when(per_line, F.greatest(F.array_position(shaped, F.lit(True)) - 1, F.lit(0))).otherwise(F.lit(0)))
    line = lambda i: F.trim(_cell("_l", i))
    in_block = {
        "ticker": _cell("_c", 0),
        "cell": F.trim(F.concat_ws(" ", _cell("_c", 1), line(1))),
        "trade_type": line(2),
        "change": line(3),
        "price": line(4),
        "value": line(5),
        "owned": line(6),
        "title": _cell("_last", 0),
        "trade_date": _cell("_last", 1),
        "filed_date": _cell("_last", 2),
    }
    fields = [F.when(per_line, _cell("_c", F.col("_at") + i)).otherwise(in_block[n]).alias(n) for i, n in enumerate(_INSIDER_FIELDS)]
    rows = rows.withColumn("_f", F.struct(*fields))
    ticker = F.col("_f.ticker")
    error = F.when(per_line & (F.size("_c") < 6), F.lit("too few columns")).when((ticker == "") | (F.length(ticker) > 6), F.lit("no ticker"))
    rows = rows.withColumns({"error": error, "line_no": F.col("line_no") + 1})
    return _trade_columns(rows, ["doc_id", "line_no", "error"])


# --- institutional blocks -----------------------------------------------------------------------------------

_COUNT = r"(\d[\d,]*)"
_INSTITUTIONAL_BLOCK = (
    r"(?m)^([A-Z]{1,6}(?:\.[A-Z])?)\n"
    rf"(?:([^\n]*?)[ \t]*\b{_COUNT}[ \t]+{_COUNT}[ \t]+{_COUNT}|([^\n]*)\n{_COUNT}[ \t]+{_COUNT}[ \t]+{_COUNT})\n"
    r"([^\n]*)\n([^\n]*)(?:\n\$[^\n]*\n\$[^\n]*)?$"
)


def parse_institutional(docs: DataFrame) -> DataFrame:
    """Ticker, company, three counts, value, sector and optional price range per block.

    The counts are the last three integers of their line (company names may
    start with digits); blocks without a company are quarantined by ``errors``.
    """
    text = F.array_join(clean_lines(), "\n")
    blocks = docs.select("doc_id", F.posexplode(F.regexp_extract_all(text, F.lit(_INSTITUTIONAL_BLOCK), F.lit(0))).alias("rank", "block"))

    def group(i: int) -> Column:
        return F.regexp_extract("block", _INSTITUTIONAL_BLOCK, i)

    def either(a: int, b: int) -> Column:
        return F.coalesce(F.nullif(group(a), F.lit("")), group(b))

    sector = group(11)
    rows = blocks.select(
        "doc_id",
        (F.col("rank") + 1).alias("rank"),
        group(1).alias("ticker"),
        F.trim(either(2, 6)).alias("company_name"),
        tx.int_text(either(3, 7)).alias("total_holders"),
        tx.int_text(either(4, 8)).alias("medium_stakes"),
        tx.int_text(either(5, 9)).alias("large_stakes"),
        half_even(tx.money_billions(group(10)), 2).alias("value_owned_billions"),
        F.when(sector.startswith("$"), F.lit("")).otherwise(sector).alias("sector"),
    )
    return institutional_errors(rows)


def institutional_errors(rows: DataFrame) -> DataFrame:
    """Validation messages per row: ticker shape, holder range, value sign, company."""
    checks = [
        (~F.coalesce(F.col("ticker").rlike(tx.INSTITUTIONAL_TICKER_PATTERN), F.lit(False)), "invalid ticker"),
        ((F.col("total_holders") < 0) | (F.col("total_holders") > 50_000), "suspect holder count"),
        (F.col("value_owned_billions") < 0, "negative value"),
        (F.coalesce(F.col("company_name"), F.lit("")) == "", "missing company"),
    ]
    return rows.withColumn("errors", F.array_compact(F.array(*[F.when(holds(c), F.lit(m)) for c, m in checks])))


#: Cells from which on a line of a fund capture belongs to its table.
TABLE_CELLS = 10

# --- fund captures ---------------------------------------------------------------------------------------------


def _in_table(line: Column) -> Column:
    # most lines have no tab and are not split
    return F.contains(line, F.lit("\t")) & (F.size(F.split(line, "\t")) >= TABLE_CELLS)


def parse_fund_headers(docs: DataFrame, within: int | None = None) -> DataFrame:
    """Fund name, manager, performance, assets and holdings count, from the first title and the first
    line of facts of a capture, wherever they are (or among its first ``within`` lines).

    A table row is no line of facts, and what follows the first table row doesn't end the header.
    """
    rows = docs.select("doc_id", clean_lines().alias("lines")).withColumn("_head", _within(F.col("lines"), within))
    titles = F.filter("_head", lambda x: F.contains(x, F.lit("13F Portfolio")))
    infos = F.filter(
        "_head",
        lambda x: (F.contains(x, F.lit("|")) | F.contains(x, F.lit("\t"))) & F.contains(x, F.lit("%")) & ~F.contains(x, F.lit("13F Portfolio")) & ~_in_table(x),
    )
    info = F.try_element_at(infos, F.lit(1))
    at = F.coalesce(F.array_position("_head", info), F.lit(0)).cast("int")
    table = F.array_position(F.transform("_head", _in_table), F.lit(True)).cast("int")
    rows = rows.withColumns(
        {
            "_manager": F.nullif(F.regexp_extract(F.coalesce(F.try_element_at(titles, F.lit(1)), F.lit("")), r"(?i)^(.+?)\s+13F\s+Portfolio$", 1), F.lit("")),
            "_info": info,
            "header_lines": F.when((table > 0) & (at > table), 0).otherwise(at),
        }
    )
    parts = F.transform(F.split(F.coalesce("_info", F.lit("")), F.when(F.contains(F.col("_info"), F.lit("|")), F.lit(r"\|")).otherwise(F.lit("\t"))), lambda x: F.trim(x))
    rows = rows.withColumn("_p", parts)

    def last_number(parts_: Column, pattern: str, ok) -> Column:
        values = F.transform(parts_, lambda x: F.nullif(F.regexp_extract(x, pattern, 1), F.lit("")).try_cast("double"))
        return F.try_element_at(F.filter(values, lambda v: v.isNotNull() & ok(v)), F.lit(-1))

    first = _cell("_p", 0)
    named = (F.length(first) > 2) & ~first.contains("%") & ~first.contains("$")
    aum_parts = F.filter("_p", lambda x: x.rlike(r"(?i)\$(\d+\.?\d*)([BT])"))
    aum_text = F.coalesce(F.try_element_at(aum_parts, F.lit(-1)), F.lit(""))
    aum = F.nullif(F.regexp_extract(aum_text, r"(?i)\$(\d+\.?\d*)([BT])", 1), F.lit("")).try_cast("double")
    unit = F.upper(F.regexp_extract(aum_text, r"(?i)\$(\d+\.?\d*)([BT])", 2))
    return rows.select(
        "doc_id",
        F.when(named, first).alias("fund_name"),
        F.coalesce("_manager", F.nullif(_cell("_p", 1), F.lit(""))).alias("portfolio_manager"),
        last_number(F.col("_p"), r"(\d+\.?\d*)%", lambda v: (v > 0) & (v < 100)).alias("performance_3y"),
        F.when(unit == "T", aum * 1000).otherwise(aum).alias("aum_billions"),
        last_number(F.col("_p"), r"^(\d+)$", lambda v: v >= 0).cast("int").alias("total_holdings"),
        "header_lines",
        "lines",
    )


_HOLDING_BLOCK = r"(?m)^[A-Z]{1,5}(?:\.[A-Z])?\n(?:[^\n]*\n){8}[^\n]*$"


def _holding(cells: Column) -> Column:
    """The typed fields of a holding from its eleven cells."""
    c = lambda i: cells[i]
    return F.struct(
        F.trim(c(0)).alias("ticker"),
        F.trim(c(1)).alias("company_name"),
        tx.leading_number(F.regexp_replace(c(2), "%", "")).alias("portfolio_pct"),
        tx.leading_number(F.regexp_replace(c(3), "%", "")).alias("delta_portfolio_pct"),
        tx.shares_millions(c(4)).alias("shares_owned_millions"),
        tx.money_millions(c(5)).alias("value_millions"),
        tx.money_millions(c(6)).alias("trade_value_millions"),
        tx.activity_pct(c(7)).alias("latest_activity_pct"),
        tx.activity_shares(c(7)).alias("latest_activity_shares"),
        tx.money_millions(c(8)).alias("avg_buy_price"),
        tx.price_change_pct(c(8)).alias("price_change_pct"),
        F.trim(c(9)).alias("sector"),
        F.trim(c(10)).alias("date"),
    )


def _block_cells(lines: Column) -> Column:
    """Nine lines are a cell each; the tenth holds sector and date, with a tab or without."""
    tail = F.coalesce(F.try_element_at(lines, F.lit(10)), F.lit(""))
    dated = r"^(.*?)(\d{4}-\d{2}-\d{2})$"
    halves = F.split(tail, "\t")
    last_two = (
        F.when(F.contains(tail, F.lit("\t")), F.slice(halves, 1, 2))
        .when(tail.rlike(dated), F.array(F.regexp_extract(tail, dated, 1), F.regexp_extract(tail, dated, 2)))
        .otherwise(F.array(tail, F.lit("")))
    )
    return F.concat(F.slice(lines, 1, 9), last_two)


def parse_fund_holdings(docs: DataFrame, header_within: int | None = None, layout_within: int | None = None) -> DataFrame:
    """Fund holdings in table or block layout, chosen per capture from all its body lines (or the first
    ``layout_within``)."""
    heads = parse_fund_headers(docs, header_within)
    body = heads.select(
        "doc_id", "fund_name", F.slice("lines", F.col("header_lines") + 1, F.greatest(F.size("lines") - F.col("header_lines"), F.lit(0))).alias("body")
    )
    is_table = F.exists(_within(F.col("body"), layout_within), _in_table)
    body = body.withColumn("layout", F.when(is_table, "table").otherwise("vertical"))
    blocks = F.regexp_extract_all(F.array_join("body", "\n"), F.lit(_HOLDING_BLOCK), F.lit(0))

    def is_holding(cells: Column) -> Column:
        return (F.size(cells) >= 11) & (F.lower(cells[0]) != "stock") & ~F.lower(cells[1]).startswith("company")

    # Cells are parsed inside the array: as columns beside each other their generated method is too long for
    # the JVM's compiler and every row runs in its interpreter.  The outer form of the explode keeps the
    # optimizer from parsing every capture a second time to drop empty ones.
    table_cells = F.filter(F.transform(F.filter("body", lambda x: F.contains(x, F.lit("\t"))), lambda x: F.split(x, "\t")), is_holding)
    block_cells = F.transform(blocks, lambda x: _block_cells(F.split(x, "\n")))
    cells = F.when(F.col("layout") == "table", table_cells).otherwise(block_cells)
    rows = body.select("doc_id", "fund_name", "layout", F.posexplode_outer(F.transform(cells, _holding)).alias("row_no", "_h"))
    return rows.where(F.col("row_no").isNotNull()).select("doc_id", "fund_name", "layout", "row_no", "_h.*")


# --- ticker and metric lists -------------------------------------------------------------------------------------


def parse_ticker_lists(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Distinct canonical tickers of free text."""
    tokens = F.split(F.upper("text"), r"[\s,;]+")
    rows = docs.select(*keep, F.explode(tokens).alias("_t")).select(*keep, tx.canonical_ticker(F.col("_t")).alias("ticker"))
    return rows.where((F.length("ticker").between(1, 6)) & F.col("ticker").rlike(tx.LIST_TICKER_PATTERN)).distinct()


def member_check(tickers: DataFrame, members: DataFrame) -> DataFrame:
    """``is_member`` per canonical ticker; ``members`` has column ``ticker``."""
    return exists_flag(tickers, members, ["ticker"], "is_member")


_NUMBER = r"^([-+]?\d+(?:[.,]\d+)?)%?$"
_PAIR = r"^([A-Z.\-]{1,8})[:=]([-+]?\d+(?:[.,]\d+)?)$"


def parse_metrics(docs: DataFrame, members: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Value per ticker and capture: a bare number applies to the tickers after it,
    ``TICKER:value`` pairs carry their own; negative values are unknown; a later
    known value replaces an earlier one.  ``is_member`` marks index members.

    The carried number is a running value over the tokens of one capture, so a
    window partition is a single text.
    """
    tokens = F.filter(F.split(F.upper("text"), r"[\s,;]+"), lambda t: t != "")
    rows = docs.select(*keep, F.posexplode(tokens).alias("pos", "token"))
    token = F.col("token")

    def number(text: Column) -> Column:
        value = F.regexp_replace(text, ",", ".").try_cast("double")
        return F.when(value >= 0, value)

    is_number, is_pair = token.rlike(_NUMBER), token.rlike(_PAIR)
    carried = F.last(
        F.when(is_number, F.struct(number(F.regexp_extract(token, _NUMBER, 1)).alias("v"))), ignorenulls=True
    ).over(Window.partitionBy(*keep).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_group", carried)
    ticker = F.when(is_pair, F.regexp_extract(token, _PAIR, 1)).when(~is_number & token.rlike(r"^[A-Z.\-]{1,8}$"), token)
    value = F.when(is_pair, number(F.regexp_extract(token, _PAIR, 2))).otherwise(F.col("_group.v"))
    rows = rows.select(*keep, "pos", tx.canonical_ticker(ticker).alias("ticker"), value.alias("value"))
    rows = rows.where(F.col("ticker").rlike(r"^[A-Z.]{1,6}$"))
    folded = rows.groupBy(*keep, "ticker").agg(
        F.max_by("value", F.when(F.col("value").isNotNull(), F.col("pos"))).alias("value"), F.min("pos").alias("first_pos")
    )
    return member_check(folded, members)
