"""Weights: equal, tilted, capped; checks; differences between snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratafin.functions.scalar import half_even
from stratafin.operators.ranking import group_stats
from stratafin.params import Constraints
from stratafin.session import stage

# Rows here are portfolio positions: at most twice ``max_positions`` per key
# after the score gate, so windows over a portfolio are small by construction.


def normalise(df: DataFrame, by: Sequence[str], weight: str = "weight") -> DataFrame:
    total = F.sum(weight).over(Window.partitionBy(*by))
    return df.withColumn(weight, F.col(weight) / F.nullif(total, F.lit(0.0)))


def equal_weights(df: DataFrame, by: Sequence[str], max_weight: float = 0.12) -> DataFrame:
    """1/n with the position cap, renormalised."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return normalise(df.withColumn("weight", F.least(1.0 / n, F.lit(max_weight))), by)


def cap_once(df: DataFrame, by: Sequence[str], max_weight: float = 0.12) -> DataFrame:
    """Single pass min(w, cap), then renormalise (may exceed the cap again)."""
    return normalise(df.withColumn("weight", F.least("weight", F.lit(max_weight))), by)


def sector_cap_once(df: DataFrame, by: Sequence[str], max_sector: float = 0.30, sector: str = "sector") -> DataFrame:
    """Scale every sector above the cap down to it, then renormalise."""
    held = F.sum("weight").over(Window.partitionBy(*by, sector))
    scaled = df.withColumn("_s", held).withColumn(
        "weight", F.when(F.col("_s") > max_sector, F.col("weight") * max_sector / F.col("_s")).otherwise(F.col("weight"))
    )
    return normalise(scaled.drop("_s"), by)


def score_tilt(df: DataFrame, by: Sequence[str], score: str = "score_composite", alpha: float = 0.5, use_zscore: bool = True) -> DataFrame:
    """Multiply weights by exp(alpha x z) (population deviation) or score/mean, renormalise."""
    df = stage(df)
    stats = group_stats(df, by, [score], ddof=0)
    rows = df.join(stats, list(by), "left")
    mean, std = F.col(f"_{score}_mean"), F.col(f"_{score}_std")
    spread = F.when(std > 0, std).otherwise(F.lit(1.0))
    base = F.when(mean != 0, mean).otherwise(F.lit(1.0))
    tilt = F.exp(F.lit(alpha) * (F.col(score) - mean) / spread) if use_zscore else F.col(score) / base
    return normalise(rows.withColumn("weight", F.col("weight") * tilt), by).drop(f"_{score}_mean", f"_{score}_std")


def sector_exposure(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by, "sector").agg(F.sum("weight").alias("sector_weight"), F.count(F.lit(1)).alias("positions"))


def largest_sector(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sector with the largest weight (name breaks ties)."""
    best = F.min(F.struct((-F.col("sector_weight")).alias("k"), F.col("sector").alias("v")))
    return sector_exposure(df, by).groupBy(*by).agg(
        F.max("sector_weight").alias("max_sector_weight"), best["v"].alias("max_sector_name"), F.count(F.lit(1)).alias("n_sectors")
    )


def constraint_check(df: DataFrame, by: Sequence[str], c: Constraints = Constraints()) -> DataFrame:
    """Every declared limit as a row: ``rule, actual, limit, violated``."""
    place = Window.partitionBy(*by).orderBy(F.col("weight").desc(), "symbol")
    ranked = df.withColumn("_place", F.row_number().over(place))
    facts = ranked.groupBy(*by).agg(
        F.max("weight").alias("max_weight"),
        F.min("weight").alias("min_weight"),
        F.sum("weight").alias("total"),
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("_place") <= 5, F.col("weight"))).alias("top5"),
        F.sum(F.when(F.col("_place") <= 10, F.col("weight"))).alias("top10"),
    )
    facts = facts.join(largest_sector(df, by), list(by))
    tol = c.tolerance

    def row(rule, actual, limit, violated):
        return F.struct(
            F.lit(rule).alias("rule"), actual.cast("double").alias("actual"), F.lit(float(limit)).alias("limit"), violated.alias("violated")
        )

    rows = F.array(
        row("max_weight", F.col("max_weight"), c.max_weight, F.col("max_weight") > c.max_weight + tol),
        row("max_sector", F.col("max_sector_weight"), c.max_sector, F.col("max_sector_weight") > c.max_sector + tol),
        row("total", F.col("total"), 1.0, F.abs(F.col("total") - 1.0) > 0.001),
        row("min_weight", F.col("min_weight"), c.min_weight, F.col("min_weight") < c.min_weight - tol),
        row("min_sectors", F.col("n_sectors"), c.min_sectors, F.col("n_sectors") < c.min_sectors),
        row("min_positions", F.col("n"), c.min_positions, F.col("n") < c.min_positions),
        row("max_top5", F.col("top5"), c.max_top5, F.col("top5") > c.max_top5 + tol),
        row("max_top10", F.col("top10"), c.max_top10, F.col("top10") > c.max_top10 + tol),
    )
    return facts.select(*by, F.explode(rows).alias("r")).select(*by, "r.*")


# --- snapshot differences -----------------------------------------------------------------------


def snapshot_changes(weights: DataFrame, keys: Sequence[str], date: str = "date", stored: bool = False) -> DataFrame:
    """Old and new weight per symbol between consecutive snapshots of a portfolio.

    The previous snapshot is shifted to the next snapshot's date and met there
    by one full outer equi-join.  Output: ``*keys, date, symbol, old_weight,
    new_weight, change`` for every snapshot but the first.
    """
    weights = weights.select(*keys, date, "symbol", "weight")
    weights = weights if stored else stage(weights)
    dates = weights.select(*keys, date).distinct()
    order = Window.partitionBy(*keys).orderBy(date) if keys else Window.partitionBy(F.lit(0)).orderBy(date)
    dates = dates.withColumns({"_next": F.lead(date).over(order), "_first": F.lag(date).over(order).isNull()})
    later = dates.where(~F.col("_first")).select(*keys, date)
    new = weights.join(later, [*keys, date]).select(*keys, date, "symbol", F.col("weight").alias("new_weight"))
    old = (
        weights.join(dates.where(F.col("_next").isNotNull()).select(*keys, date, "_next"), [*keys, date])
        .select(*keys, F.col("_next").alias(date), "symbol", F.col("weight").alias("old_weight"))
    )
    zero = F.lit(0.0)
    return (
        new.join(old, [*keys, date, "symbol"], "full_outer")
        .withColumns({"old_weight": F.coalesce("old_weight", zero), "new_weight": F.coalesce("new_weight", zero)})
        .withColumn("change", F.col("new_weight") - F.col("old_weight"))
    )


def turnover(changes: DataFrame, keys: Sequence[str], date: str = "date") -> DataFrame:
    """One-way turnover and entries, exits, unchanged per snapshot."""
    was, now = F.col("old_weight") != 0, F.col("new_weight") != 0
    return changes.groupBy(*keys, date).agg(
        (F.sum(F.abs("change")) / 2).alias("turnover"),
        F.count_if(now & ~was).alias("entries"),
        F.count_if(was & ~now).alias("exits"),
        F.count_if(was & now).alias("unchanged"),
        F.count_if(F.abs("change") > 0.01).alias("trades"),
    )


def annual_turnover(weights: DataFrame, keys: Sequence[str], per_year: int = 252) -> DataFrame:
    """Turnover over the weights history, annualised by its number of rows, and trade count.

    The divisor counts snapshot rows against ``per_year`` exactly as the
    original does; pass the real snapshots per year for the usual figure.
    """
    weights = stage(weights.select(*keys, "date", "symbol", "weight"))
    per_date = turnover(snapshot_changes(weights, keys, stored=True), keys)
    rows = weights.groupBy(*keys).agg(F.countDistinct("date").alias("_n"))
    total = per_date.groupBy(*keys).agg(F.sum("turnover").alias("_t"), F.sum("trades").alias("num_trades"))
    return total.join(rows, list(keys)).select(
        *keys, half_even(F.col("_t") * per_year / F.col("_n") * 100, 1).alias("turnover_annual"), "num_trades"
    )


def no_trade_zone(changes: DataFrame, keys: Sequence[str], zone: float = 0.01, date: str = "date") -> DataFrame:
    """Adjustments of held names smaller than the zone are not traded; weights renormalised."""
    small = (F.col("old_weight") > 0) & (F.col("new_weight") > 0) & (F.abs("change") < zone)
    kept = changes.withColumn("weight", F.when(small, F.col("old_weight")).otherwise(F.col("new_weight")))
    return normalise(kept.where(F.col("weight") > 0), [*keys, date])


def hold_unless_score_falls(changes: DataFrame, scores: DataFrame, keys: Sequence[str], drop: float = 0.10, date: str = "date") -> DataFrame:
    """A name leaves only when its score fell by more than ``drop`` (fraction of the old score).

    ``scores``: ``*keys, date, symbol, old_score, new_score``.
    """
    rows = changes.join(scores, [*keys, date, "symbol"], "left")
    leaving = (F.col("old_weight") > 0) & (F.col("new_weight") == 0)
    fell = F.coalesce(F.col("new_score") < F.col("old_score") * (1 - drop), F.lit(True))
    kept = rows.withColumn("weight", F.when(leaving & ~fell, F.col("old_weight")).otherwise(F.col("new_weight")))
    return normalise(kept.where(F.col("weight") > 0).drop("old_score", "new_score"), [*keys, date])


def turnover_budget(per_date: DataFrame, keys: Sequence[str], limit: float = 0.80, date: str = "date") -> DataFrame:
    """Turnover used per calendar year and whether the annual budget was exceeded."""
    return (
        per_date.groupBy(*keys, F.year(date).alias("year"))
        .agg(F.sum("turnover").alias("turnover"))
        .withColumn("over_budget", F.col("turnover") > limit)
    )


# --- portfolio metrics -----------------------------------------------------------------------------


def portfolio_metrics(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Weighted performance, uncorrelated volatility, sector weights (map) and mean ratios."""
    zero, w = F.lit(0.0), F.col("weight")
    vol = F.coalesce("vol_30d", F.lit(25.0)) / 100
    facts = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("positions"),
        half_even(F.sum(w * F.coalesce("perf_3m", zero)), 2).alias("perf_3m"),
        half_even(F.sum(w * F.coalesce("perf_ytd", zero)), 2).alias("perf_ytd"),
        half_even(F.sqrt(F.sum(w * w * vol * vol)) * 100, 2).alias("vol_30d"),
        half_even(F.avg("roe"), 1).alias("avg_roe"),
        half_even(F.avg("debt_equity"), 2).alias("avg_debt_equity"),
        half_even(F.avg("net_margin"), 1).alias("avg_net_margin"),
    )
    # one entry per sector, so the map is bounded by the number of sectors
    sectors = sector_exposure(df, by).groupBy(*by).agg(
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct("sector", half_even(F.col("sector_weight") * 100, 1))))
        ).alias("sector_weights")
    )
    return facts.join(sectors, list(by))


def contributions(df: DataFrame, by: Sequence[str], ret: str = "perf_3m", n: int = 3) -> DataFrame:
    """Position contribution weight x return with its place from the top and the bottom."""
    value = F.col("weight") * F.coalesce(F.col(ret), F.lit(0.0))
    rows = df.withColumn("contribution", value)
    top = Window.partitionBy(*by).orderBy(F.col("contribution").desc(), "symbol")
    bottom = Window.partitionBy(*by).orderBy(F.col("contribution").asc(), "symbol")
    rows = rows.withColumns({"top_place": F.row_number().over(top), "bottom_place": F.row_number().over(bottom)})
    return rows.withColumns({"is_top": F.col("top_place") <= n, "is_bottom": F.col("bottom_place") <= n})


def factor_exposures(df: DataFrame, by: Sequence[str], market: dict[str, float], sector_beta: dict[str, float] | None = None) -> DataFrame:
    """Weighted multiples, concentration, tilts against the market and a sector-beta sum."""
    w = F.col("weight")

    def weighted(name: str, default: float):
        return F.sum(w * F.coalesce(F.col(name), F.lit(default)))

    betas = F.create_map(*[F.lit(x) for pair in (sector_beta or {"*": 1.0}).items() for x in pair])
    facts = df.groupBy(*by).agg(
        weighted("pe_ratio", 20.0).alias("portfolio_pe"),
        weighted("fcf_yield", 0.0).alias("portfolio_fcf_yield"),
        weighted("roe", 15.0).alias("portfolio_roe"),
        weighted("net_margin", 10.0).alias("portfolio_margin"),
        weighted("perf_3m", 0.0).alias("_perf"),
        weighted("rsi", 50.0).alias("avg_rsi"),
        F.max(w).alias("max_position"),
        F.sum(w * w).alias("hhi"),
        F.sum(w * F.coalesce(F.try_element_at(betas, F.col("sector")), F.lit(1.0))).alias("sector_beta"),
    )
    facts = facts.join(largest_sector(df, by).select(*by, F.col("max_sector_weight").alias("max_sector")), list(by))
    return facts.withColumns(
        {
            "pe_vs_market": F.col("portfolio_pe") / market["pe"],
            "roe_vs_market": F.col("portfolio_roe") / market["roe"],
            "perf_3m_relative": F.col("_perf") - market["perf_3m"],
            "value_tilt": (-(F.col("portfolio_pe") / market["pe"] - 1) + (F.col("portfolio_fcf_yield") / market["fcf_yield"] - 1)) / 2,
            "quality_tilt": ((F.col("portfolio_roe") / market["roe"] - 1) + (F.col("portfolio_margin") / market["margin"] - 1)) / 2,
        }
    ).drop("_perf")
