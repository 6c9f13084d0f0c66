"""Data validation: required fields, ranges, coherence, history and daily quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratafin.functions.scalar import holds, safe_double, winsorise, with_missing
from stratafin.params import DATA_BOUNDS, PREFERRED_FIELDS, REQUIRED_FIELDS


def _messages(pairs: list[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(holds(c), F.lit(text)) for c, text in pairs]))


def coherence_checks() -> list[tuple[Column, str]]:
    return [
        ((F.col("revenue") > 0) & (F.abs(F.col("net_income") / F.nullif("revenue", F.lit(0.0))) > 1), "net margin above 100%"),
        ((F.col("equity") > 0) & (F.col("total_debt") / F.nullif("equity", F.lit(0.0)) > 10), "debt/equity above 10"),
        ((F.col("net_income") > 0) & (F.col("fcf") / F.nullif("net_income", F.lit(0.0)) > 3), "fcf/net income above 3"),
    ]


def validate_rows(
    df: DataFrame,
    required: Sequence[str] = tuple(REQUIRED_FIELDS),
    preferred: Sequence[str] = tuple(PREFERRED_FIELDS),
    bounds: dict[str, tuple[float, float]] | None = None,
    clip_outliers: bool = True,
) -> DataFrame:
    """Adds ``is_valid``, ``errors`` and ``warnings``; clips out-of-range values of valid rows.

    Range warnings look at the raw values, coherence warnings at the clipped
    ones.  An invalid row carries only its errors.
    """
    bounds = DATA_BOUNDS if bounds is None else bounds
    df = with_missing(df, {c: "double" for c in [*required, *preferred, "fcf"]})
    present = [c for c in bounds if c in df.columns]
    raw = df.withColumns({c: safe_double(c) for c in {*present, *required, *preferred, "fcf"}})
    errors = _messages([(F.col(c).isNull(), f"missing {c}") for c in required])
    raw = raw.withColumn("errors", errors).withColumn("is_valid", F.size("errors") == 0)
    early = [(F.col(c).isNull(), f"preferred {c} missing") for c in preferred]
    early += [((F.col(c) < bounds[c][0]) | (F.col(c) > bounds[c][1]), f"{c} out of range") for c in present]
    raw = raw.withColumn("_early", _messages(early))
    cleaned = winsorise(raw, {c: bounds[c] for c in present}) if clip_outliers else raw
    warnings = F.when(F.col("is_valid"), F.concat("_early", _messages(coherence_checks()))).otherwise(F.array().cast("array<string>"))
    return cleaned.withColumn("warnings", warnings).drop("_early")


def validate_history(df: DataFrame, key: Sequence[str] = ("symbol",), min_rows: int = 5, **kwargs) -> DataFrame:
    """Valid annual rows of symbols with at least ``min_rows`` of them.

    One row per symbol and year, so the window is bounded by fiscal years.
    """
    checked = validate_rows(df, **kwargs).where(F.col("is_valid"))
    return checked.withColumn("valid_years", F.count(F.lit(1)).over(Window.partitionBy(*key))).where(F.col("valid_years") >= min_rows)


def universe_warnings(df: DataFrame, by: Sequence[str] = ("as_of_date",)) -> DataFrame:
    """Warning and error counts per message (``kind, message, n``) for each universe."""
    both = F.concat(
        F.transform("errors", lambda m: F.struct(F.lit("error").alias("kind"), m.alias("message"))),
        F.transform("warnings", lambda m: F.struct(F.lit("warning").alias("kind"), m.alias("message"))),
    )
    return (
        df.select(*by, F.explode(both).alias("m")).select(*by, "m.kind", "m.message").groupBy(*by, "kind", "message").agg(F.count(F.lit(1)).alias("n"))
    )


def warnings_per_symbol(df: DataFrame, by: Sequence[str] = ("as_of_date", "symbol")) -> DataFrame:
    """Valid rows, each with its own warnings, empty or not (one row per symbol and date)."""
    return df.where(F.col("is_valid")).select(*by, "warnings")


def price_anomalies(
    prices: DataFrame,
    min_price: float = 1.0,
    max_price: float = 10_000.0,
    max_daily_change: float = 0.50,
    min_volume: float | None = None,
    min_market_cap: float | None = None,
) -> DataFrame:
    """Flag rows outside the price range or with an extreme one-step change and, where a limit is
    given, those below a daily ``volume`` or a ``market_cap``.  A missing value raises no flag."""
    w = Window.partitionBy("symbol").orderBy("date")
    change = F.col("close") / F.nullif(F.lag("close").over(w), F.lit(0.0)) - 1
    reasons = [
        (~F.col("close").between(min_price, max_price), "price_range"),
        (F.abs(F.col("_change")) > max_daily_change, "daily_change"),
    ]
    if min_volume is not None:
        reasons.append((F.col("volume") < min_volume, "low_volume"))
    if min_market_cap is not None:
        reasons.append((F.col("market_cap") < min_market_cap, "low_market_cap"))
    out = prices.withColumn("_change", change)
    return out.withColumn("anomalies", _messages(reasons)).withColumnRenamed("_change", "daily_change")


def daily_quality(
    df: DataFrame,
    by: Sequence[str] = ("as_of_date",),
    score: str = "score_composite",
    min_size: int = 400,
    max_missing_price: float = 0.05,
    max_missing_cap: float = 0.02,
) -> DataFrame:
    """Universe size, missing shares and missing scores per date, with a verdict."""
    size = F.count(F.lit(1))
    return (
        df.groupBy(*by)
        .agg(
            size.alias("universe_size"),
            (F.count_if(F.col("price").isNull()) / size).alias("missing_price"),
            (F.count_if(F.col("market_cap").isNull()) / size).alias("missing_market_cap"),
            F.count_if(F.col(score).isNull()).alias("missing_scores"),
        )
        .withColumn(
            "quality_ok",
            (F.col("universe_size") >= min_size)
            & (F.col("missing_price") < max_missing_price)
            & (F.col("missing_market_cap") < max_missing_cap)
            & (F.col("missing_scores") == 0),
        )
    )
