"""Trades followed as a stream of landed files, beside the same rows computed at once."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.derive import raw
from checks.registry import query
from stratafin.session import stage_folder
from stratafin.streaming import trades as T

DIRECTION = "case event_type when 'view' then 'Sell' when 'error' then 'Sell' when 'purchase' then 'Buy' else 'Other' end"


@query(
    "sell_cluster_stream",
    f"""
with s as (select event_id, ts, concat('T', cast(user_id as varchar)) as symbol, event_id % 7 as seller, coalesce(value, 0.0) as value
   from events where {DIRECTION} = 'Sell' and ts is not null and user_id is not null),
g as (select *, case when ts < lag(ts) over (partition by symbol order by ts) + interval 12 hours then 0 else 1 end as fresh from s),
r as (select *, sum(fresh) over (partition by symbol order by ts rows unbounded preceding) as run from g),
c as (select symbol, run, min(ts) as first_sale, max(ts) + interval 12 hours as quiet_at, count(*) as n_sells, count(distinct seller)::int as n_insiders, round(sum(value), 4) as sold from r group by 1, 2)
select symbol, strftime(first_sale, '%Y-%m-%d %H:%M:%S.%f') as first_sale, strftime(quiet_at, '%Y-%m-%d %H:%M:%S.%f') as quiet_at, n_sells, n_insiders, sold, n_insiders >= 3 and n_sells >= 3 as cluster_sell from c
where c.quiet_at <= (select max(ts) - interval 2 days from s)""",
    "C31 A1",
)
def _sell_cluster_stream(spark, sf):
    """The first half lands and is followed; the rest lands with the last six hours of the first half
    once more, and the stream starts again from its checkpoint."""
    base = f"{stage_folder(spark).rstrip('/')}/sell-clusters-{uuid.uuid4().hex}"
    events = raw(spark, sf, "events").select(
        F.col("event_id").cast("long").alias("trade_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("T"), F.col("user_id").cast("string")).alias("symbol"),
        F.concat(F.lit("U"), (F.col("event_id") % 7).cast("string")).alias("insider_name"),
        F.expr(DIRECTION).alias("direction"),
        F.coalesce("value", F.lit(0.0)).alias("value"),
    )
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    middle = F.lit(low + (high - low) / 2) if low is not None else F.lit(None).cast("timestamp")
    for part in (events.where(F.col("ts") <= middle), events.where(F.col("ts") > middle - F.expr("interval 6 hours"))):
        part.write.mode("append").parquet(f"{base}/landed")
        followed = T.sell_clusters(T.landed_trades(spark, f"{base}/landed"), quiet="12 hours", delay="2 days")
        T.catch_up(followed, f"{base}/runs", f"{base}/checkpoint")
    at = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in ("first_sale", "quiet_at")}
    return spark.read.parquet(f"{base}/runs").withColumns({**at, "sold": F.round("sold", 4)})
