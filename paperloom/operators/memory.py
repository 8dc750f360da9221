"""Conversation memory: the rows before each row of a session, for sessions of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _last(a: Column, n: int) -> Column:
    return F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), F.lit(n))


def recent(df: DataFrame, key: str, order: list[str], value: Column, n: int, bucket: Column) -> DataFrame:
    """Adds `recent`: the values of the n rows before in the order of one key, oldest first; fewer at its start.

    `bucket` must rise with the order (the day of a time, say). Windows sort one bucket of a key; what comes from before is
    the last n rows of the n buckets before, so a key that holds a third of all rows is shared among tasks.
    """
    df = df.withColumn("_bucket", bucket).withColumn("_value", value)
    inside = Window.partitionBy(key, "_bucket").orderBy(*order)
    back = Window.partitionBy(key, "_bucket").orderBy(*[F.desc(c) for c in order])
    tail = df.withColumn("_r", F.row_number().over(back)).where(F.col("_r") <= n).groupBy(key, "_bucket").agg(F.array_sort(F.collect_list(F.struct((-F.col("_r")).alias("r"), F.col("_value").alias("v")))).alias("_t"))
    tail = tail.select(key, "_bucket", F.transform("_t", lambda x: x["v"]).alias("_t"))
    carry = F.flatten(F.collect_list("_t").over(Window.partitionBy(key).orderBy("_bucket").rowsBetween(-n, -1)))
    carry = tail.select(key, "_bucket", _last(carry, n).alias("_before"))
    # collect_list leaves nulls out, so values travel in structs
    own = F.transform(F.collect_list(F.struct(F.col("_value").alias("v"))).over(inside.rowsBetween(-n, -1)), lambda x: x["v"])
    out = df.withColumn("_own", own).join(carry, [key, "_bucket"])
    return out.withColumn("recent", _last(F.concat("_before", "_own"), n)).drop("_bucket", "_value", "_own", "_before")
