"""Insider captures as a stream of landed files.

The text parsers and the trade aggregates hold no driver-side step, so the same
transforms run on a streaming DataFrame; only the window and the watermark are
added here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafin.sources.text_blocks import parse_insider


def captured_trades(spark: SparkSession, folder: str) -> DataFrame:
    """New capture files (whole texts) parsed as they land."""
    texts = spark.readStream.format("text").option("wholetext", True).load(folder)
    docs = texts.select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))
    return parse_insider(docs).where(F.col("error").isNull())


def windowed_activity(trades: DataFrame, window: str = "7 days", delay: str = "30 days") -> DataFrame:
    """Purchases, sales and net value per ticker and trade-date window, late trades up to ``delay``."""
    buy, sell = F.col("direction") == "Buy", F.col("direction") == "Sell"
    stamped = trades.withColumn("ts", F.to_timestamp("trade_date")).withWatermark("ts", delay)
    return stamped.groupBy(F.window("ts", window), "ticker").agg(
        F.count_if(buy).alias("buys"), F.count_if(sell).alias("sells"), F.sum("transaction_value_millions").alias("net_value_millions")
    )


#: Columns of landed trades that ``sell_clusters`` reads.
TRADE_SCHEMA = "trade_id long, ts timestamp, symbol string, insider_name string, direction string, value double"


def landed_trades(spark: SparkSession, folder: str) -> DataFrame:
    """Trades from Parquet files as they land."""
    return spark.readStream.schema(TRADE_SCHEMA).parquet(folder)


def sell_clusters(trades: DataFrame, quiet: str = "7 days", delay: str = "30 days", insiders: int = 3, sells: int = 3) -> DataFrame:
    """Runs of sales per symbol, each ended by a ``quiet`` time without one, and whether a run is a
    cluster: at least ``insiders`` sellers and ``sells`` sales.

    A trade that lands again within ``delay`` counts once.  A run is given out once, when the
    watermark has passed its end; until then its state holds its sums and its distinct sellers.
    Sales without a time or a symbol are left out; a seller without a name is no seller.
    """
    sold = trades.where((F.col("direction") == "Sell") & F.col("ts").isNotNull() & F.col("symbol").isNotNull())
    once = sold.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["trade_id"])
    runs = once.groupBy(F.session_window("ts", quiet).alias("run"), "symbol").agg(
        F.count("*").alias("n_sells"), F.sum("value").alias("sold"), F.size(F.collect_set("insider_name")).alias("n_insiders")
    )
    cluster = (F.col("n_insiders") >= insiders) & (F.col("n_sells") >= sells)
    return runs.select("symbol", F.col("run.start").alias("first_sale"), F.col("run.end").alias("quiet_at"), "n_sells", "n_insiders", "sold", cluster.alias("cluster_sell"))


def catch_up(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Work off all that has landed, append the finished rows to Parquet, and stop.  The next call with
    the same checkpoint goes on from there."""
    stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
