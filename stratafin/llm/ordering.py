"""Rows in ascending id order without one global sort task."""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafin.llm.common import ship


def ordered_parts(docs: DataFrame, id_col: str, payload: list, neighbours: bool = False, parts: int | None = None) -> DataFrame:
    """(part, extra, id, *payload): part numbers ascend with the id, and each Spark partition holds
    whole parts sorted by (part, extra, id, payload).  One shuffle of the payload.

    With ``neighbours`` the first rows of a part also follow the rows of the part before it (of the
    last part: those of the first), as ``extra`` = 1, so every row meets its successor.  Cut points
    are approximate quantiles of the id, a few per shuffle partition; they only balance the parts.
    Null ids come first.
    """
    spark = docs.sparkSession
    ship(spark)
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    found = ids.agg(F.percentile_approx("id", [i / parts for i in range(1, parts)], 10 * parts)).first()[0] or []
    cuts = sorted(set(found))

    @F.pandas_udf("int")
    def part_of(values: pd.Series) -> pd.Series:
        return values.map(lambda v: 0 if pd.isna(v) else bisect.bisect_right(cuts, int(v))).astype("int32")

    rows = docs.select(F.col(id_col).cast("long").alias("id"), *payload)
    rows = rows.withColumn("part", part_of(F.col("id").cast("string")))
    if not neighbours:
        rows = rows.withColumn("extra", F.lit(0))
    else:
        low = ids.withColumn("part", part_of(F.col("id").cast("string"))).groupBy("part").agg(F.min("id").alias("low"), F.max(F.col("id").isNull()).alias("gap"))
        heads = sorted(((r["part"], None if r["gap"] else r["low"]) for r in low.collect()), key=lambda r: r[0])  # a row per part
        before = {low: heads[i - 1][0] for i, (_, low) in enumerate(heads)}

        @F.pandas_udf("int")
        def also(values: pd.Series) -> pd.Series:
            return values.map(lambda v: before.get(None if pd.isna(v) else int(v), -1)).astype("int32")

        rows = rows.withColumn("also", also(F.col("id").cast("string")))
        to = F.array(F.struct(F.col("part"), F.lit(0).alias("extra")), F.struct(F.col("also").alias("part"), F.lit(1).alias("extra")))
        rows = rows.withColumn("to", F.explode(F.filter(to, lambda x: x["part"] >= 0))).withColumns({"part": F.col("to.part"), "extra": F.col("to.extra")}).drop("to", "also")
    rows = rows.select("part", "extra", "id", *[c for c in rows.columns if c not in ("part", "extra", "id")])
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "part").sortWithinPartitions(*rows.columns)
