"""Writers: portfolios, alerts, reports.  Files are split by date; nothing passes through the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafin.functions.scalar import half_even
from stratafin.operators.alerts import severity_counts
from stratafin.operators.weights import portfolio_metrics
from stratafin.session import stage

#: fixed values: columns of an exported portfolio, in order, kept when present
EXPORT_COLUMNS = [
    "symbol", "company", "sector", "industry", "weight",
    "score_composite", "score_sm", "score_insider", "score_momentum", "score_quality",
    "perf_3m", "perf_ytd", "vol_30d",
    "gp_buys", "gp_tier", "insider_buys", "rsi", "price",
    "roe", "roa", "debt_equity", "current_ratio",
    "gross_margin", "operating_margin", "net_margin",
    "capex_ratio", "fcf", "revenue", "net_income",
    "score_value", "score_risk", "core_score",
]


def finite(df: DataFrame) -> DataFrame:
    """NaN and infinities to NULL in every floating column."""
    floats = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    clean = {c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.col(c)) for c in floats}
    return df.withColumns(clean) if clean else df


#: Folder of completion markers beside the dates of a store; readers of the store pass over it.
MARKERS = "_complete"


def write_dated(df: DataFrame, path: str, by: Sequence[str], kind: str = "parquet", **options) -> None:
    """Write the dates (first of ``by``) that ``df`` holds and leave all other dates of the store alone.

    A date that is there already is replaced.  Its marker goes before its files are touched and comes
    back, with the number of rows, when they are all in place, so a write that fails half way leaves
    a date without a marker (``complete_dates``).
    """
    spark, rows = df.sparkSession, stage(df)
    counts = stage(rows.groupBy(by[0]).agg(F.count(F.lit(1)).alias("rows")))
    store = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).options(**options)
    markers = f"{path.rstrip('/')}/{MARKERS}"
    for date in [r[0] for r in counts.select(F.col(by[0]).cast("string")).collect()]:  # a row per date written
        _delete(spark, f"{markers}/{by[0]}={date}")
    store.format(kind).save(path)
    counts.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by[0]).json(markers)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def complete_dates(spark: SparkSession, path: str, by: str = "as_of_date") -> list[str]:
    """Dates of a store that were written to the end, ascending, from the names of their markers;
    no file is read.  The store holds a folder per date, so the list is short."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{MARKERS}")
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    names = [f.getPath().getName() for f in files.listStatus(root)]
    return sorted(n.split("=", 1)[1] for n in names if n.startswith(f"{by}="))


def export_rows(portfolio: DataFrame, by: Sequence[str]) -> DataFrame:
    present = [c for c in EXPORT_COLUMNS if c in portfolio.columns]
    return finite(portfolio.select(*by, *[c for c in present if c not in by]))


def write_portfolio_csv(portfolio: DataFrame, path: str, by: Sequence[str] = ("as_of_date",)) -> None:
    write_dated(export_rows(portfolio, by), path, by, "csv", header="true")


def portfolio_documents(portfolio: DataFrame, by: Sequence[str] = ("as_of_date",), version: str = "3.0") -> DataFrame:
    """One document per key: metadata, metrics and the position rows.

    The array holds the positions of one portfolio (at most ``max_positions``).
    """
    rows = stage(export_rows(portfolio, by))
    columns = [c for c in rows.columns if c not in by]
    documents = rows.groupBy(*by).agg(
        F.count(F.lit(1)).cast("int").alias("_n"),
        half_even(F.sum("weight"), 4).alias("_w"),
        F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("_k"), *columns))).alias("_rows"),
    )
    metrics = portfolio_metrics(_with_metric_columns(rows), by)
    metric_columns = [c for c in metrics.columns if c not in by]
    joined = documents.join(metrics, list(by))
    position = lambda r: F.struct(*[r[c].alias(c) for c in columns])
    return joined.select(
        *by,
        F.struct(
            F.col(by[0]).cast("string").alias("date"),
            F.col("_n").alias("positions"),
            F.col("_w").alias("total_weight"),
            F.lit(version).alias("engine_version"),
        ).alias("metadata"),
        F.struct(*[F.col(c).alias(c) for c in metric_columns]).alias("metrics"),
        F.transform("_rows", position).alias("portfolio"),
    )


def _with_metric_columns(df: DataFrame) -> DataFrame:
    from stratafin.functions.scalar import with_missing

    return with_missing(df, {c: "double" for c in ("perf_3m", "perf_ytd", "vol_30d", "roe", "debt_equity", "net_margin")} | {"sector": "string"})


def write_portfolio_json(portfolio: DataFrame, path: str, by: Sequence[str] = ("as_of_date",), version: str = "3.0") -> None:
    write_dated(portfolio_documents(portfolio, by, version), path, by, "json")


def read_portfolio_documents(spark, path: str, by: str = "as_of_date") -> DataFrame:
    """Positions back from written documents; the partition column prunes dates."""
    from stratafin.sources.readers import SNAPSHOT_SCHEMA

    docs = spark.read.schema(f"{SNAPSHOT_SCHEMA}, {by} date").json(path)
    return docs.select(by, F.explode("portfolio").alias("p")).select(by, "p.*").drop("td_price")


def write_alerts(alerts: DataFrame, path: str, by: Sequence[str] = ("as_of_date",)) -> None:
    """Alert rows and their severity counts as two tables; dates that are not written stay."""
    alerts = stage(alerts)
    write_dated(alerts, f"{path}/alerts", by)
    write_dated(severity_counts(alerts, by), f"{path}/severity", by)


def write_fundamentals(df: DataFrame, path: str, date: str = "as_of_date") -> None:
    """One partition per date; dates that are not written stay."""
    write_dated(df, path, [date])


#: fixed values: sections of a backtest report and the metric columns in each
REPORT_SECTIONS = {
    "period": ["start_date", "end_date", "num_periods"],
    "returns": ["total_return", "cagr", "annual_volatility"],
    "ratios": ["sharpe_ratio", "sortino_ratio", "calmar_ratio"],
    "risk": ["max_drawdown", "max_drawdown_duration_days", "avg_drawdown"],
    "trading": ["turnover_annual", "num_trades", "hit_ratio", "avg_win", "avg_loss", "win_loss_ratio"],
    "validation": ["accepted", "notes"],
    "benchmark": ["alpha", "beta", "information_ratio", "tracking_error"],
}


def backtest_report(metrics: DataFrame, keys: Sequence[str] = ("portfolio_id",), stress: DataFrame | None = None) -> DataFrame:
    """One nested record per portfolio; sections keep the columns that are present.

    ``stress`` rows (a fixed list of windows) are attached as an array.  Holdings grow with the number
    of rebalances and are written as rows of their own (``write_backtest_report``).
    """
    have = set(metrics.columns)
    sections = [
        F.struct(*[F.col(c) for c in cols if c in have]).alias(name)
        for name, cols in REPORT_SECTIONS.items()
        if have & set(cols)
    ]
    out = metrics.select(*keys, *sections)
    if stress is None:
        return out
    payload = [c for c in stress.columns if c not in keys]
    folded = stress.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*payload))).alias("stress_tests"))
    return out.join(folded, list(keys), "left")


def write_backtest_report(report: DataFrame, path: str, holdings: DataFrame | None = None, by: str = "rebalance_date") -> None:
    """Records under ``report``; the positions of every rebalance as rows under ``holdings``, by date."""
    write_report(report, f"{path}/report")
    if holdings is not None:
        write_dated(holdings, f"{path}/holdings", [by])


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def attribution_report(attributed: DataFrame, config: str = "config_id") -> DataFrame:
    """Configurations (a short fixed list) as one record with a map of results."""
    payload = [c for c in attributed.columns if c != config]
    return attributed.agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(config), F.struct(*payload))))).alias("configs"),
        F.count(F.lit(1)).alias("n_configs"),
    )
