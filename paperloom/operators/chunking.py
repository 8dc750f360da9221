"""Row-generating chunkers over (key, text) DataFrames. All but the semantic one are plain expressions.

Null and empty texts give no rows. Extra columns of the input are dropped unless they are the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import dot, embed, sentences, strip


def _pieces(df: DataFrame, text: str, size: int, step: int, index: str, out: str) -> DataFrame:
    n = F.length(text)
    at = F.posexplode(F.sequence(F.lit(0), n - 1, F.lit(step)))
    return df.where(n > 0).select("*", at.alias(index, "_at")).withColumn(out, F.substr(F.col(text), F.col("_at") + 1, F.lit(size))).drop("_at")


def fixed(df: DataFrame, key: str, text: str = "text", size: int = 500, overlap: int = 50) -> DataFrame:
    """(key, chunk_index, chunk); the tail is kept even inside the chunk before it."""
    return _pieces(df.select(key, text), text, size, size - overlap, "chunk_index", "chunk").drop(text)


def page_filtered(df: DataFrame, key: str, text: str = "text", size: int = 400, overlap: int = 50, least: int = 30) -> DataFrame:
    """Fixed chunks whose stripped length passes `least`, numbered after the filter."""
    kept = fixed(df, key, text, size, overlap).where(F.length(strip(F.col("chunk"))) > least)
    renumbered = F.row_number().over(Window.partitionBy(key).orderBy("chunk_index")) - 1
    return kept.withColumn("chunk_index", renumbered)


def parent_child(df: DataFrame, key: str, text: str = "text", parent: int = 512, child: int = 128) -> DataFrame:
    """(key, parent_index, child_index, level, chunk): disjoint parents and the disjoint children inside each."""
    parents = _pieces(df.select(key, text), text, parent, parent, "parent_index", "parent").drop(text)
    children = _pieces(parents, "parent", child, child, "child_index", "chunk").select(key, "parent_index", "child_index", F.lit("child").alias("level"), "chunk")
    top = parents.select(key, "parent_index", F.lit(-1).alias("child_index"), F.lit("parent").alias("level"), F.col("parent").alias("chunk"))
    return top.unionByName(children)


def sentence_rows(df: DataFrame, key: str, text: str = "text", least: int = 20) -> DataFrame:
    """(key, chunk_index, sentence) of sentences longer than `least`; the index counts all sentences."""
    rows = df.where(F.length(text) > 0).select(key, F.posexplode(sentences(F.col(text))).alias("chunk_index", "sentence"))
    return rows.where(F.length("sentence") > least)


def sentence_window(df: DataFrame, key: str, text: str = "text", window: int = 3, least: int = 10) -> DataFrame:
    """(key, sentence_index, sentence, window_text, first_index, last_index) with `window` sentences on either side."""
    kept = F.filter(F.transform(sentences(F.col(text)), lambda s: strip(s)), lambda s: F.length(s) > least)
    rows = df.where(F.length(text) > 0).select(key, kept.alias("s")).select(key, "s", F.posexplode("s").alias("sentence_index", "sentence"))
    i, n = F.col("sentence_index"), F.size("s")
    lo, hi = F.greatest(F.lit(0), i - window), F.least(n, i + window + 1)
    return rows.select(key, "sentence_index", "sentence", F.array_join(F.slice("s", lo + 1, hi - lo), " ").alias("window_text"), lo.alias("first_index"), (hi - 1).alias("last_index"))


def semantic(df: DataFrame, key: str, text: str = "text", threshold: float = 0.3, least: int = 100) -> DataFrame:
    """(key, segment, chunk, n_sentences): sentences of similar neighbours joined; short segments dropped.

    A text with fewer than two sentences, or whose segments are all dropped, is one segment.
    Windows run within a text, which is bounded.
    """
    base = df.where(F.length(text) > 0).select(key, text)
    rows = base.select(key, F.posexplode(sentences(F.col(text))).alias("i", "s")).where(F.length("s") > 20).withColumn("v", embed("s"))
    w = Window.partitionBy(key).orderBy("i")
    rows = rows.withColumn("cut", F.coalesce((F.round(dot(F.col("v"), F.lag("v").over(w)), 9) < threshold).cast("int"), F.lit(0)))
    rows = rows.withColumn("segment", F.sum("cut").over(w))
    joined = rows.groupBy(key, "segment").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]), " ").alias("chunk"), F.count("*").cast("int").alias("n_sentences"))
    joined = joined.withColumn("total", F.sum("n_sentences").over(Window.partitionBy(key))).where((F.length("chunk") >= least) & (F.col("total") >= 2))
    joined = joined.withColumn("segment", (F.row_number().over(Window.partitionBy(key).orderBy("segment")) - 1).cast("int")).drop("total")
    whole = base.join(joined.select(key).distinct(), key, "left_anti").select(key, F.lit(0).alias("segment"), F.col(text).alias("chunk"), F.lit(1).alias("n_sentences"))
    return joined.unionByName(whole)


def contextual(df: DataFrame, key: str, text: str = "text", size: int = 500, overlap: int = 50) -> DataFrame:
    """Fixed chunks with a context line in front for embedding; the default provider takes the text's first line."""
    head = F.substring(F.regexp_extract(F.col(text), r"^([^\n]*)", 1), 1, 80)
    chunks = _pieces(df.select(key, text, head.alias("context_prefix")), text, size, size - overlap, "chunk_index", "chunk").drop(text)
    return chunks.withColumn("embed_text", F.concat_ws(" ", "context_prefix", "chunk"))


def form_feed_pages(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    return df.where(F.length(text) > 0).select(key, F.posexplode(F.split(text, "\f")).alias("page_num", "page"))


CHUNKERS = {"fixed": fixed, "semantic": semantic, "sentence_window": sentence_window, "parent_child": parent_child, "contextual": contextual}
