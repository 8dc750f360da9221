"""Structured Streaming over tables: event windows, sessions, deduplication, keyed state, incremental ingest.

Each query runs with trigger(availableNow) and its own checkpoint in the shared folder; results are
written by task to Parquet there and read back, so nothing passes through the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from paperloom.operators import incremental
from paperloom.session import checkpoint_folder


def shared_folder(spark: SparkSession) -> str:
    return f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"


def read(spark: SparkSession, path: str) -> DataFrame:
    """A table as a stream of its files; zone-less timestamps become instants of the session zone (UTC)."""
    schema = spark.read.parquet(path).schema
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        # a stream reads folders: the folder of the file, narrowed to its name
        df = spark.readStream.schema(schema).option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())
    else:
        df = spark.readStream.schema(schema).parquet(path)
    ntz = [f.name for f in schema if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz})


def finish(df: DataFrame, mode: str) -> DataFrame:
    """Run to the end of the available input; the last batch of a complete result, or all appended rows."""
    spark = df.sparkSession
    folder = shared_folder(spark)

    def put(batch: DataFrame, n: int) -> None:
        # a batch that is run again after a failure overwrites its own folder
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")

    df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/cp").foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    if mode == "complete":
        last = out.agg(F.max("batch")).first()[0]
        out = out.where(F.col("batch") == last)
    return out.drop("batch")


def tumbling(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """(start, event_type, n, total) of event-time windows."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    s = F.session_window("ts", gap).alias("s")
    return events.withWatermark("ts", late).groupBy(s, "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def last_values(events: DataFrame, keep: int = 5) -> DataFrame:
    """(user_id, n, last_ids): per user the newest ids seen so far, in keyed state of bounded size."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, newest = state.get if state.exists else (0, "")
        ids = [int(x) for x in newest.split(",") if x]
        for pdf in frames:
            seen += len(pdf)
            ids = sorted({*ids, *(int(x) for x in pdf["event_id"])})[-keep:]
        newest = ",".join(map(str, ids))
        state.update((seen, newest))
        yield pd.DataFrame({"user_id": [key[0]], "n": [seen], "last_ids": [newest]})

    return events.select("user_id", "event_id").groupBy("user_id").applyInPandasWithState(step, "user_id bigint, n bigint, last_ids string", "seen bigint, newest string", "update", GroupStateTimeout.NoTimeout)


def reindex(pages: DataFrame) -> DataFrame:
    """Changes (KEY, status) of all batches of pages (KEY, text, seq): each batch is diffed against the pages before it.

    Pages that a batch lacks are not deleted, as a batch is no whole collection. The index is written as a new version per
    batch; a batch that is run again after a failure reads the version before it and overwrites its own.
    """
    spark = pages.sparkSession
    folder = shared_folder(spark)
    empty = spark.createDataFrame([], "collection string, doc_id string, page_num int, hash string, char_count int, seq timestamp")
    fs_path = spark._jvm.org.apache.hadoop.fs.Path

    def put(batch: DataFrame, n: int) -> None:
        before = f"{folder}/index/v={n - 1}"
        old = spark.read.parquet(before) if n and fs_path(before).getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path(before)) else empty
        last = batch.groupBy(*incremental.KEY).agg(F.max_by("text", "seq").alias("text"), F.max("seq").alias("seq"))
        new = incremental.page_index(last).join(last.select(*incremental.KEY, "seq"), incremental.KEY)
        changes = incremental.diff(new, old).where("status <> 'DELETED'")
        changes.select(*incremental.KEY, "status").write.mode("overwrite").parquet(f"{folder}/out/batch={n}")
        kept = old.join(new.select(*incremental.KEY), incremental.KEY, "left_anti")
        kept.unionByName(new).write.mode("overwrite").parquet(f"{folder}/index/v={n}")

    pages.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/cp").foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("batch")
