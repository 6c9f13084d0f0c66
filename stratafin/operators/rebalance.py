"""Rebalancing with carried state: what a portfolio really holds after each date.

The rebalances of a portfolio are one array in date order, and a fold over it carries the weights
held and the turnover used in the calendar year.  Its size is the number of rebalance dates times
the positions of a portfolio, both bounded by the calendar and the position limit; portfolios and
configurations spread over the tasks, and rows meet once, by portfolio.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def _zero() -> Column:
    return F.lit(0.0)


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _sum(values: Column) -> Column:
    return F.aggregate(values, _zero(), lambda a, x: a + x)


def _proposed(held: Column, target: Column, zone: float) -> Column:
    """(symbol, was, weight) of every name held or wanted: small changes of names on both sides are
    left out, and the weights add up to one again."""
    names = F.sort_array(F.array_union(F.map_keys(held), F.map_keys(target)))

    def name(s: Column) -> Column:
        was, want = F.coalesce(held[s], _zero()), F.coalesce(target[s], _zero())
        idle = (was > 0) & (want > 0) & (F.abs(want - was) < zone)
        return F.struct(s.alias("symbol"), was.alias("was"), F.when(idle, was).otherwise(want).alias("weight"))

    def summing_to_one(rows: Column) -> Column:
        total = F.nullif(_sum(F.transform(rows, lambda r: r["weight"])), _zero())
        return _with(
            total,
            lambda t: F.transform(rows, lambda r: F.struct(r["symbol"].alias("symbol"), r["was"].alias("was"), F.coalesce(r["weight"] / t, _zero()).alias("weight"))),
        )

    return _with(F.transform(names, name), summing_to_one)


def held_weights(targets: DataFrame, keys: Sequence[str], zone: float = 0.01, budget: float = 0.80, date: str = "date") -> DataFrame:
    """``*keys, date, symbol, weight, target_weight, turnover, turnover_year``: the weights held after
    each rebalance.

    ``targets``: ``*keys, date, symbol, weight``.  The first date is bought as targeted and uses no
    turnover.  Later, a target is compared with the weight *held*: a name on both sides whose change is
    below ``zone`` is not traded, and the rest is brought back to a sum of one.  When the one-way
    turnover of the date exceeds what is left of the calendar year's ``budget``, all its trades shrink by
    the same factor, so names that should leave may stay in part.  Rows without weight or symbol, and
    weights of zero or less, are no targets; of several weights of a symbol on one date the sum counts.
    """
    keys = list(keys)
    clean = targets.where("weight > 0 and symbol is not null").where(F.col(date).isNotNull())
    once = clean.groupBy(*keys, date, "symbol").agg(F.sum("weight").alias("weight"))
    dates = once.groupBy(*keys, date).agg(F.collect_list(F.struct("symbol", "weight")).alias("target"))
    whole = dates.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(date).alias("date"), "target"))).alias("dates"))

    kind = whole.schema["dates"].dataType.elementType
    day, name = kind["date"].dataType.simpleString(), kind["target"].dataType.elementType["symbol"].dataType.simpleString()
    held = f"map<{name},double>"
    record = f"struct<date:{day},turnover:double,turnover_year:double,held:{held}>"
    start = F.struct(F.lit(None).cast("int").alias("year"), _zero().alias("used"), F.lit(None).cast(held).alias("held"), F.array().cast(f"array<{record}>").alias("done"))

    def step(state: Column, now: Column) -> Column:
        target = F.map_from_entries(now["target"])
        year = F.year(now["date"])
        used = F.when(state["year"] == year, state["used"]).otherwise(_zero())

        def after(weights: Column, spent: Column, before: Column) -> Column:
            row = F.struct(now["date"].alias("date"), spent.alias("turnover"), (before + spent).alias("turnover_year"), weights.alias("held"))
            return F.struct(year.alias("year"), (before + spent).alias("used"), weights.alias("held"), F.array_append(state["done"], row).alias("done"))

        def traded(rows: Column) -> Column:
            wanted = _sum(F.transform(rows, lambda r: F.abs(r["weight"] - r["was"]))) / 2
            sized = F.struct(wanted.alias("wanted"), used.alias("used"))

            def scaled(z: Column) -> Column:
                left = F.greatest(F.lit(budget) - z["used"], _zero())
                return F.struct(z["wanted"].alias("wanted"), z["used"].alias("used"), F.when(z["wanted"] > left, left / z["wanted"]).otherwise(F.lit(1.0)).alias("part"))

            def settle(z: Column) -> Column:
                moved = F.transform(rows, lambda r: F.struct(r["symbol"].alias("symbol"), F.when(z["part"] == 1.0, r["weight"]).otherwise(r["was"] + z["part"] * (r["weight"] - r["was"])).alias("weight")))
                return after(F.map_from_entries(F.filter(moved, lambda r: r["weight"] > 0)), z["wanted"] * z["part"], z["used"])

            return _with(_with(sized, scaled), settle)

        first = after(target, _zero(), _zero())
        later = _with(_with(target, lambda t: _proposed(state["held"], t, zone)), traded)
        return F.when(state["held"].isNull(), first).otherwise(later)

    folded = whole.select(*keys, "dates", F.aggregate("dates", start, step, lambda s: s["done"]).alias("_done"))
    each = folded.select(*keys, F.explode(F.arrays_zip("dates", "_done")).alias("_z"))
    rows = each.select(*keys, "_z", F.explode("_z._done.held").alias("symbol", "weight"))
    wanted = F.filter("_z.dates.target", lambda t: t["symbol"] == F.col("symbol"))
    return rows.select(
        *keys,
        F.col("_z._done.date").alias(date),
        "symbol",
        "weight",
        F.coalesce(F.get(wanted, 0)["weight"], _zero()).alias("target_weight"),
        F.col("_z._done.turnover").alias("turnover"),
        F.col("_z._done.turnover_year").alias("turnover_year"),
    )
