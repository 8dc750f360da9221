"""Incremental maintenance of a page index: diff, chunks to delete, upsert, statistics.

A page is known by (collection, doc_id, page_num), so two documents of a collection never touch each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["collection", "doc_id", "page_num"]


def page_index(pages: DataFrame) -> DataFrame:
    """(KEY, hash, char_count) of pages (KEY, text); a null text is an empty page."""
    t = F.coalesce("text", F.lit(""))
    return pages.select(*KEY, F.sha2(t, 256).alias("hash"), F.length(t).alias("char_count"))


def diff(new: DataFrame, old: DataFrame) -> DataFrame:
    """(KEY, status, old_hash, hash): ADDED, UPDATED, UNCHANGED or DELETED by a full outer join."""
    j = new.select(*KEY, "hash", F.lit(True).alias("in_new")).join(old.select(*KEY, F.col("hash").alias("old_hash"), F.lit(True).alias("in_old")), KEY, "full_outer")
    status = F.when(F.col("in_old").isNull(), "ADDED").when(F.col("in_new").isNull(), "DELETED").when(F.col("hash") == F.col("old_hash"), "UNCHANGED").otherwise("UPDATED")
    return j.select(*KEY, status.alias("status"), "old_hash", "hash")


def report(changes: DataFrame) -> DataFrame:
    """Counts per collection; `incremental` if the index had pages before."""
    n = lambda s: F.sum((F.col("status") == s).cast("bigint"))
    return changes.groupBy("collection").agg(n("ADDED").alias("added"), n("UPDATED").alias("updated"), n("UNCHANGED").alias("skipped"), n("DELETED").alias("deleted"), F.max(F.col("old_hash").isNotNull()).alias("incremental"))


def chunks_to_delete(changes: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks (KEY, chunk_id) of pages that were updated or deleted."""
    return chunks.join(changes.where(F.col("status").isin("UPDATED", "DELETED")).select(*KEY), KEY, "left_semi")


def upsert(new: DataFrame, old: DataFrame, key: str, seq: str) -> DataFrame:
    """Union of both with one row per key, the last by `seq` winning."""
    r = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(seq)))
    return new.unionByName(old).withColumn("_r", r).where("_r = 1").drop("_r")


def sync(new_pages: DataFrame, index_path: str) -> DataFrame:
    """Diff pages against the stored index and write the next index beside it; returns the changes.

    The index lives under <index_path>/v=N; a new version is written whole before it is used, and the path
    that is read is never overwritten. Run it again after a crash: the same input gives the same version.
    """
    spark = new_pages.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(index_path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [int(s.getPath().getName()[2:]) for s in fs.listStatus(fs_path) if s.getPath().getName().startswith("v=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))] if fs.exists(fs_path) else []
    new = page_index(new_pages)
    old = spark.read.parquet(f"{index_path}/v={max(done)}") if done else new.limit(0)
    changes = diff(new, old)
    new.write.mode("overwrite").parquet(f"{index_path}/v={max(done, default=0) + 1}")
    return changes


def page_chunks(pages: DataFrame, collection=None, size: int = 400, step: int = 350, least: int = 30) -> DataFrame:
    """(KEY, chunk_index, chunk_id, text, page_hash) of pages (KEY, text); blank pages and chunks of at most `least` characters have none."""
    from paperloom.functions.identity import page_chunk_id

    p = pages.where(F.col("text").rlike(r"\S"))
    c = p.select(*KEY, F.sha2("text", 256).alias("page_hash"), "text", F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(step))).alias("at"))
    c = c.withColumn("chunk", F.substr("text", F.col("at") + 1, F.lit(size))).where(F.length(F.regexp_replace("chunk", r"^\s+|\s+$", "")) > least)
    c = c.withColumn("chunk_index", F.row_number().over(Window.partitionBy(*KEY).orderBy("at")) - 1)  # the chunks of one page
    return c.select(*KEY, "chunk_index", page_chunk_id(F.col("collection"), F.col("doc_id"), F.col("page_num"), F.col("chunk_index"), F.col("chunk")).alias("chunk_id"), F.col("chunk").alias("text"), "page_hash")


def process(pages: DataFrame, index: DataFrame, stored: DataFrame) -> dict[str, DataFrame]:
    """One run over pages (KEY, text) against the index (KEY, hash, char_count) and the stored chunks (KEY, chunk_index, chunk_id, text, page_hash).

    Gives `changes`, `delete` (chunk ids of updated and deleted pages), `upsert` (chunks of added and updated pages),
    `index` and `chunks` (what holds afterwards) and `report` (counts a collection). Unchanged pages are not chunked.
    """
    from paperloom.session import cut

    changes = cut(diff(page_index(pages), index))
    work = pages.join(changes.where(F.col("status").isin("ADDED", "UPDATED")).select(*KEY), KEY, "left_semi")
    new = cut(page_chunks(work))
    gone = cut(chunks_to_delete(changes, stored).select(*KEY, "chunk_id"))
    kept = stored.join(changes.where("status = 'UNCHANGED'").select(*KEY), KEY, "left_semi")
    counts = lambda df, name: df.groupBy("collection").agg(F.count("*").alias(name))
    rep = report(changes).join(counts(new, "chunks_embedded"), "collection", "left").join(counts(gone, "chunks_deleted"), "collection", "left").fillna(0, ["chunks_embedded", "chunks_deleted"])
    return {"changes": changes, "delete": gone, "upsert": new, "index": page_index(pages), "chunks": kept.unionByName(new), "report": rep}


def report_line(rep: DataFrame) -> DataFrame:
    """(collection, line): the report as one readable line."""
    total = F.col("added") + F.col("updated") + F.col("skipped")
    mode = F.when(F.col("incremental"), "incremental").otherwise("full")
    line = F.format_string("%s: %d pages, +%d ~%d =%d -%d, %d chunks in, %d out (%s)", "collection", total, "added", "updated", "skipped", "deleted", "chunks_embedded", "chunks_deleted", mode)
    return rep.select("collection", line.alias("line"))


def index_stats(index: DataFrame, chunks: DataFrame) -> DataFrame:
    """(collection, indexed_pages, total_chunks)."""
    c = chunks.groupBy("collection").agg(F.count("*").alias("total_chunks"))
    return index.groupBy("collection").agg(F.count("*").alias("indexed_pages")).join(c, "collection", "left").fillna(0, ["total_chunks"])


def reset(index: DataFrame, collection: str) -> DataFrame:
    """The index without the pages of a collection, so that its next run processes every page."""
    return index.where(F.col("collection") != collection)


def changed_pages(docs: DataFrame, stored: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, page_num, page_id, page_hash, changed) of texts split at form feeds, against stored pages (page_id, page_hash).

    A page is known by document and number; nothing is deleted.
    """
    from paperloom.functions.identity import page_id

    p = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("doc"), F.posexplode(F.split(F.col(text), "\f")).alias("page_num", "t"))
    p = p.select("doc", "page_num", page_id(F.col("doc"), F.col("page_num")).alias("page_id"), F.sha2("t", 256).alias("page_hash"))
    old = stored.select("page_id", F.col("page_hash").alias("old"))
    return p.join(old, "page_id", "left").select("doc", "page_num", "page_id", "page_hash", (~F.col("old").eqNullSafe(F.col("page_hash"))).alias("changed"))
