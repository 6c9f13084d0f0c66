"""Pasted-text cells to typed values, as column expressions.

Every function takes and returns a Column, so the parsers run on batch and on
streaming text alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratafin.functions.scalar import holds
from stratafin.params import TICKER_ALIASES

#: fixed values: accepted text patterns
SYMBOL_PATTERN = r"^[A-Z]{1,5}(\.[A-Z])?$"
INSIDER_TICKER_PATTERN = r"^[A-Z]{1,6}$"
INSTITUTIONAL_TICKER_PATTERN = r"^[A-Z]{1,6}(\.[A-Z])?$"
LIST_TICKER_PATTERN = r"^[A-Z.]+$"
ROLE_PATTERNS = [
    r"(?i)\b(CEO|CFO|COO|CTO|CMO|President|Chairman|Director|Officer|VP|SVP|EVP|General Counsel|Secretary|Treasurer)\b",
    r"(?i)\b(10%\s*Owner|Major Shareholder|Beneficial Owner)\b",
]
_LEADING_NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+))"


def _number(text: Column) -> Column:
    """The number a text starts with (trailing text ignored), 0 when there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(text, _LEADING_NUMBER, 1), F.lit("")).try_cast("double"), F.lit(0.0))


def leading_number(text: Column) -> Column:
    return F.coalesce(_number(text), F.lit(0.0))


def leading_int(text: Column) -> Column:
    digits = F.regexp_extract(F.coalesce(text, F.lit("")), r"^\s*([+-]?\d+)", 1)
    return F.coalesce(F.nullif(digits, F.lit("")).try_cast("int"), F.lit(0))


def _scaled(value: Column, suffix: Column, factors: dict[str, float]) -> Column:
    """Multiply by the factor of the suffix letter; factors below one divide exactly."""
    out = F.when(F.lit(False), value)
    for letter, factor in factors.items():
        out = out.when(suffix == letter, value * F.lit(factor) if factor >= 1 else value / F.lit(round(1 / factor)))
    return out.otherwise(value)


def money(text: Column) -> Column:
    """``$ 1,234.5`` -> 1234.5; anything else -> 0."""
    return _number(F.regexp_replace(F.coalesce(text, F.lit("")), r"[$,\s]", ""))


def magnitude_millions(text: Column) -> Column:
    """Number with K/M/B suffix in millions; ``$ , arrows ( )`` are noise; bad text -> 0."""
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), r"[$,\s↓↑()]", "")
    shape = r"(?i)^([+-]?[\d.]+)([KMB])?$"
    value = F.coalesce(F.nullif(F.regexp_extract(clean, shape, 1), F.lit("")).try_cast("double"), F.lit(0.0))
    return _scaled(value, F.upper(F.regexp_extract(clean, shape, 2)), {"B": 1000.0, "K": 0.001})


def money_billions(text: Column) -> Column:
    """Money with T/B/M/K suffix in billions (no suffix means billions)."""
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), r"[$,]", "")
    shape = r"(?i)([\d.]+)\s*([TBMK])?"
    value = F.coalesce(F.nullif(F.regexp_extract(clean, shape, 1), F.lit("")).try_cast("double"), F.lit(0.0))
    return _scaled(value, F.upper(F.regexp_extract(clean, shape, 2)), {"T": 1000.0, "M": 0.001, "K": 0.000001})


def shares_millions(text: Column) -> Column:
    """Shares with M/B/K suffix in millions; a bare number above a million is in units."""
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), ",", "")
    shape = r"(?i)([\d.]+)\s*([MBK])?"
    value = F.coalesce(F.nullif(F.regexp_extract(clean, shape, 1), F.lit("")).try_cast("double"), F.lit(0.0))
    suffix = F.upper(F.regexp_extract(clean, shape, 2))
    scaled = _scaled(value, suffix, {"B": 1000.0, "K": 0.001})
    return F.when((suffix == "") & (value > 1_000_000), value / 1_000_000.0).otherwise(scaled)


def money_millions(text: Column) -> Column:
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), r"[$,]", "")
    shape = r"(?i)([\d.]+)\s*([MBK])?"
    value = F.coalesce(F.nullif(F.regexp_extract(clean, shape, 1), F.lit("")).try_cast("double"), F.lit(0.0))
    return _scaled(value, F.upper(F.regexp_extract(clean, shape, 2)), {"B": 1000.0, "K": 0.001})


def first_price(text: Column) -> Column:
    """First number in the text once ``$`` and commas are gone."""
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), r"[$,]", "")
    return F.coalesce(F.nullif(F.regexp_extract(clean, r"([+-]?[\d.]+)", 1), F.lit("")).try_cast("double"), F.lit(0.0))


def activity_pct(text: Column) -> Column:
    """Percentage in ``-34.3% (-645.6k)``."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), r"([+-]?\d+\.?\d*)%", 1)
    return F.coalesce(F.nullif(found, F.lit("")).try_cast("double"), F.lit(0.0))


def activity_shares(text: Column) -> Column:
    """Share count in the brackets of ``-34.3% (-645.6k)``, in millions."""
    shape = r"(?i)\(([+-]?\d+\.?\d*)\s*([MBK])?\)"
    source = F.coalesce(text, F.lit(""))
    value = F.coalesce(F.nullif(F.regexp_extract(source, shape, 1), F.lit("")).try_cast("double"), F.lit(0.0))
    return _scaled(value, F.upper(F.regexp_extract(source, shape, 2)), {"B": 1000.0, "K": 0.001})


def price_change_pct(text: Column) -> Column:
    """The last ``(±x%)`` in the text."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\(([+-]?\d+\.?\d*)%\)"), F.lit(1))
    last = F.try_element_at(found, F.lit(-1))
    return F.coalesce(last.try_cast("double"), F.lit(0.0))


def int_text(text: Column) -> Column:
    """``1,374`` or ``1 374`` -> 1374; bad text -> 0."""
    return leading_int(F.regexp_replace(F.coalesce(text, F.lit("")), r"[,\s]", ""))


def trade_direction(change: Column, trade_type: Column) -> Column:
    """Buy, Sell, Gift, Exercise or Unknown: words first, then the sign or arrow."""
    kind = F.lower(F.coalesce(trade_type, F.lit("")))
    sign = F.coalesce(change, F.lit(""))

    def says(*words: str) -> Column:
        out = kind.contains(words[0])
        for w in words[1:]:
            out = out | kind.contains(w)
        return out

    return (
        F.when(says("sale", "sell"), "Sell")
        .when(says("buy", "purchase"), "Buy")
        .when(says("tax", "liability"), "Sell")
        .when(says("gift"), "Gift")
        .when(says("exercise"), "Exercise")
        .when(sign.contains("↓") | sign.contains("-"), "Sell")
        .when(sign.contains("↑") | sign.contains("+"), "Buy")
        .otherwise("Unknown")
    )


def split_role(cell: Column) -> tuple[Column, Column]:
    """(name, role) of a "name role" cell; the first role found is cut out of the name."""
    roles = [F.regexp_extract(cell, p, 1) for p in ROLE_PATTERNS]
    role = F.coalesce(*[F.nullif(r, F.lit("")) for r in roles], F.lit(""))
    at = F.when(role != "", F.locate(role, cell)) if isinstance(role, str) else F.position(role, cell)
    cut = F.when(role == "", cell).otherwise(
        F.concat(F.substring(cell, F.lit(1), at - 1), F.substring(cell, at + F.length(role), F.length(cell)))
    )
    name = F.trim(F.regexp_replace(F.regexp_replace(cut, r"[|\-–,]", " "), r"\s+", " "))
    return name, role


def informative_trade(trade_type: Column, role: Column, direction: Column, value_millions: Column) -> Column:
    """Planned and tax trades are not informative; insider purchases and large trades are."""
    kind, who = F.lower(F.coalesce(trade_type, F.lit(""))), F.lower(F.coalesce(role, F.lit("")))
    return (
        F.when(kind.contains("plan") | kind.contains("10b5"), False)
        .when(kind.contains("tax") | kind.contains("liability"), False)
        .when((direction == "Buy") & (who.contains("ceo") | who.contains("cfo") | who.contains("director")), True)
        .otherwise(holds(F.abs(value_millions) > 1))
    )


def iso_date_text(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[^0-9-]", "")


def canonical_ticker(text: Column) -> Column:
    """Upper case with the known alternative spellings folded."""
    upper = F.upper(F.trim(text))
    aliases = F.create_map(*[F.lit(x) for pair in TICKER_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(aliases, upper), upper)
