"""Joins the engine needs beyond a plain equi-join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(
    probes: DataFrame,
    facts: DataFrame,
    key: Sequence[str],
    probe_date: str,
    fact_date: str,
    values: Sequence[str],
    per_column: bool = False,
    fact_date_out: str | None = None,
) -> DataFrame:
    """For every probe, the latest fact dated on or before it.

    Probes are first cut to distinct ``(key, date)``, facts hold one row per
    ``(key, date)``, so one window partition is bounded by the calendar and not
    by the number of probe rows.  The result is joined back by equality.

    ``per_column=True`` takes the last *non-missing* value of each column
    separately; otherwise all values come from the same fact row.
    """
    key = list(key)
    asked = probes.select(*key, F.col(probe_date).alias("_at")).distinct()
    payload = [F.col(v) for v in values]
    if fact_date_out:
        payload.append(F.col(fact_date).alias(fact_date_out))
    names = [*values, *([fact_date_out] if fact_date_out else [])]
    fact_rows = facts.select(
        *key, F.col(fact_date).alias("_at"), F.lit(0).alias("_probe"), F.struct(*payload).alias("_fact")
    )
    empty = F.lit(None).cast(fact_rows.schema["_fact"].dataType)
    stream = fact_rows.unionByName(asked.select(*key, "_at", F.lit(1).alias("_probe"), empty.alias("_fact")))
    running = Window.partitionBy(*key).orderBy("_at", "_probe").rowsBetween(Window.unboundedPreceding, 0)
    if per_column:
        found = {n: F.last(F.col(f"_fact.{n}"), ignorenulls=True).over(running) for n in names}
    else:
        latest = F.last(F.col("_fact"), ignorenulls=True).over(running)
        stream = stream.withColumn("_latest", latest)
        found = {n: F.col(f"_latest.{n}") for n in names}
    answers = (
        stream.withColumns({f"_v{i}": c for i, c in enumerate(found.values())})
        .where(F.col("_probe") == 1)
        .select(*key, "_at", *[F.col(f"_v{i}").alias(n) for i, n in enumerate(found)])
    )
    return probes.join(answers.withColumnRenamed("_at", probe_date), [*key, probe_date], "left")


def exists_flag(df: DataFrame, members: DataFrame, on: Sequence[str], out: str) -> DataFrame:
    """Boolean column: is the row's key present in ``members``."""
    marked = members.select(*on).distinct().withColumn(out, F.lit(True))
    return df.join(marked, list(on), "left").withColumn(out, F.coalesce(F.col(out), F.lit(False)))


def days_in_periods(
    days: DataFrame, periods: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end"
) -> DataFrame:
    """``(*keys, date)`` for every listed day inside every period.

    An interval join without a nested loop: periods are expanded to the months
    they touch, days carry their month, and the equality on the month does the
    matching; the exact bounds are checked inside the matched month.  The
    distinct days are bounded by the calendar (36 600 rows per century), so
    they are broadcast and the periods are never shuffled on the month.
    """
    touched = periods.select(
        *keys,
        start,
        end,
        F.explode(
            F.sequence(F.trunc(F.col(start), "month"), F.trunc(F.col(end), "month"), F.expr("interval 1 month"))
        ).alias("_month"),
    )
    listed = days.select("date").distinct().withColumn("_month", F.trunc("date", "month"))
    return (
        touched.join(listed, "_month")
        .where(F.col("date").between(F.col(start), F.col(end)))
        .select(*keys, "date")
    )


def period_endpoints(
    prices: DataFrame, periods: DataFrame, keys: Sequence[str] = ("period_id",)
) -> DataFrame:
    """Per period and symbol: first price on/after the start, last on/before the end.

    Prices are matched to periods through the calendar day, by equality, and
    folded with ``min_by``/``max_by`` before the shuffle.  The list of days is
    sent to all tasks where its measured size allows.
    """
    spans = days_in_periods(prices, periods, keys)
    return (
        prices.where(F.col("close").isNotNull())
        .join(spans, "date")
        .groupBy(*keys, "symbol")
        .agg(
            F.min_by("close", "date").alias("first_price"),
            F.max_by("close", "date").alias("last_price"),
            F.count("close").alias("n_prices"),
        )
        .withColumn("period_return", F.col("last_price") / F.nullif(F.col("first_price"), F.lit(0.0)) - 1)
    )


def with_totals(df: DataFrame, totals: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Put group totals beside the rows: an equi-join per group, or scalar
    subqueries when there is a single total."""
    if by:
        return df.join(totals.select(*by, *columns), list(by))
    return df.withColumns({c: totals.select(c).scalar() for c in columns})


def valid_at(facts: DataFrame, key: Sequence[str], fact_date: str, instants: DataFrame, instant: str = "date") -> DataFrame:
    """The fact row of every key that is in force at each listed instant.

    A fact is in force from its own date until the key's next one.  The
    intervals are matched to the instants by month, an equi-join, so keys are
    never crossed with instants; the output is the as-of table itself.  The
    distinct instants are calendar dates (bounded), hence broadcast.
    """
    upcoming = F.lead(fact_date).over(Window.partitionBy(*key).orderBy(fact_date))
    horizon = instants.agg(F.max(instant).alias("_h")).select("_h").scalar()
    spans = (
        facts.withColumns({"_from": F.col(fact_date), "_to": F.coalesce(F.date_sub(upcoming, 1), horizon)})
        .where(F.col("_from") <= F.col("_to"))
        .withColumn(
            "_month",
            F.explode(F.sequence(F.trunc("_from", "month"), F.trunc("_to", "month"), F.expr("interval 1 month"))),
        )
    )
    asked = instants.select(F.col(instant).alias("_instant")).distinct().withColumn("_month", F.trunc("_instant", "month"))
    clash = instant in facts.columns and instant != fact_date
    out = spans.join(asked, "_month").where(F.col("_instant").between(F.col("_from"), F.col("_to")))
    out = out.drop("_from", "_to", "_month")
    if instant == fact_date:
        return out.withColumnRenamed(fact_date, f"{fact_date}_of_fact").withColumnRenamed("_instant", instant)
    return (out.drop(instant) if clash else out).withColumnRenamed("_instant", instant)
