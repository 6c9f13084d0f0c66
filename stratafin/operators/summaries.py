"""Distribution, coverage and run summaries: one aggregation each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafin.functions.scalar import half_even
from stratafin.operators.ranking import quantiles
from stratafin.session import stage


def score_distribution(df: DataFrame, by: Sequence[str] = ("as_of_date",), score: str = "score_value") -> DataFrame:
    """Moments, quartiles and a clustering warning (std < 0.10 or IQR < 0.15)."""
    df = stage(df.select(*by, score))
    moments = df.groupBy(*by).agg(
        F.count(score).alias("count"),
        half_even(F.avg(score), 3).alias("mean"),
        half_even(F.stddev_samp(score), 3).alias("std"),
        half_even(F.min(score), 3).alias("min"),
        half_even(F.max(score), 3).alias("max"),
        F.countDistinct(score).alias("unique_values"),
    )
    quartiles = quantiles(df, by, score, {"_q25": 0.25, "_median": 0.5, "_q75": 0.75}).drop("n_values")
    return (
        moments.join(quartiles, list(by))
        .withColumns(
            {
                "q25": half_even("_q25", 3),
                "median": half_even("_median", 3),
                "q75": half_even("_q75", 3),
                "iqr": half_even(F.col("_q75") - F.col("_q25"), 3),
            }
        )
        .withColumn("clustering_warning", (F.col("std") < 0.10) | (F.col("iqr") < 0.15))
        .drop("_q25", "_median", "_q75")
    )


def eligible_universe_stats(df: DataFrame, by: Sequence[str] = ("as_of_date",)) -> DataFrame:
    """Coverage and level of the earnings-quality features."""
    df = stage(df.select(*by, "accruals", "fcf_ni_ratio"))
    accruals, conversion = F.col("accruals"), F.col("fcf_ni_ratio")
    stats = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_tickers"),
        F.count(accruals).alias("with_accruals"),
        F.count(conversion).alias("with_fcf_ni"),
        half_even(F.avg(accruals), 4).alias("accruals_mean"),
        half_even(F.avg((accruals < 0.05).cast("double")) * 100, 1).alias("accruals_low_pct"),
        half_even(F.avg(conversion), 2).alias("fcf_ni_mean"),
        half_even(F.avg((conversion > 1).cast("double")) * 100, 1).alias("fcf_ni_above_1_pct"),
    )
    median = quantiles(df, by, "accruals", {"_m": 0.5}).drop("n_values")
    return stats.join(median, list(by), "left").withColumn("accruals_median", half_even("_m", 4)).drop("_m")


def eligible_sector_counts(df: DataFrame, by: Sequence[str] = ("as_of_date",)) -> DataFrame:
    """Names per sector of the eligible universe; a missing sector counts as ``Unknown``."""
    return df.groupBy(*by, F.coalesce("sector", F.lit("Unknown")).alias("sector")).agg(F.count(F.lit(1)).alias("tickers"))


def coverage(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ("as_of_date",), low: float = 0.5) -> DataFrame:
    """Share of rows with at least one known ratio."""
    known = F.lit(False)
    for c in columns:
        known = known | F.col(c).isNotNull()
    return (
        df.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("rows"), F.count_if(known).alias("covered"))
        .withColumn("coverage", F.col("covered") / F.col("rows"))
        .withColumn("low_coverage", F.col("coverage") < low)
    )


def run_summary(df: DataFrame, scores: Sequence[str], by: Sequence[str] = ("as_of_date",), eligible: str | None = None) -> DataFrame:
    """Universe size, sectors and mean scores per run, with the eligible share."""
    aggs = [F.count(F.lit(1)).alias("universe_size"), F.countDistinct("sector").alias("n_sectors")]
    aggs += [half_even(F.avg(s), 3).alias(f"avg_{s}") for s in scores if s in df.columns]
    if eligible is not None:
        aggs.append(half_even(F.avg(F.col(eligible).cast("double")) * 100, 1).alias("eligible_pct"))
    return df.groupBy(*by).agg(*aggs)
