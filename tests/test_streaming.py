"""Sales of a symbol followed over landed files: repeated rows, restarts, rows without time or name."""

from datetime import datetime, timedelta

from stratafin.streaming import trades as T

DAY = datetime(2024, 3, 1)


def land(spark, folder, rows):
    spark.createDataFrame(rows, T.TRADE_SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def row(trade_id, days, symbol="A", who="x", direction="Sell", value=1.0):
    return (trade_id, None if days is None else DAY + timedelta(days=days), symbol, who, direction, value)


def follow(spark, base):
    T.catch_up(T.sell_clusters(T.landed_trades(spark, f"{base}/landed"), quiet="2 days", delay="3 days"), f"{base}/runs", f"{base}/marks")
    return sorted((r["symbol"], (r["first_sale"] - DAY).days, r["n_sells"], r["n_insiders"], r["sold"], r["cluster_sell"]) for r in spark.read.parquet(f"{base}/runs").collect())


def test_runs_of_sales_survive_a_restart(spark, tmp_path):
    base = str(tmp_path)
    first = [row(1, 0, who="x"), row(2, 1, who="y"), row(2, 1, who="y"), row(3, 1, who="y", direction="Buy"), row(4, 1, symbol="B", who=None), row(5, None), row(6, 1, symbol=None)]
    land(spark, f"{base}/landed", first)
    assert follow(spark, base) == []  # no run has ended for certain
    # the run of A goes on in the next landing, which repeats a trade; B's has ended
    land(spark, f"{base}/landed", [row(2, 1, who="y"), row(7, 2, who="z", value=5.0), row(8, 20, symbol="C")])
    want = [("A", 0, 3, 3, 7.0, True), ("B", 1, 1, 0, 1.0, False)]
    assert follow(spark, base) == want
    assert follow(spark, base) == want  # nothing new has landed
    land(spark, f"{base}/landed", [row(9, 2, who="late"), row(10, 40, symbol="C")])  # behind the watermark
    assert follow(spark, base) == [*want, ("C", 20, 1, 1, 1.0, False)]


def test_nothing_landed(spark, tmp_path):
    base = str(tmp_path)
    land(spark, f"{base}/landed", [])
    assert follow(spark, base) == []
