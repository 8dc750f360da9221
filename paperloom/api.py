"""The verbs of the service as functions over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import embed, uuid_of
from paperloom.operators import chunking, documents, incremental, rules, search

MARKS = {"faithfulness": 0.80, "relevancy": 0.75, "precision": 0.70, "recall": 0.70}


def ingest(docs: DataFrame, collection: str, chunker: str = "fixed", tenant_id: str | None = None) -> DataFrame:
    """Chunks (chunk_id, collection, doc_id, tenant_id, chunk_index, text, embedding) of docs (doc_id, text).

    An unknown chunker falls back to fixed. Null and empty texts give no chunks.
    """
    make = chunking.CHUNKERS.get(chunker, chunking.fixed)
    c = make(docs.select("doc_id", "text"), "doc_id")
    text = next(x for x in ("chunk", "sentence") if x in c.columns)
    index = F.concat_ws(".", *[F.col(x).cast("string") for x in ("parent_index", "child_index", "segment", "sentence_index", "chunk_index") if x in c.columns])
    chunk_id = uuid_of(F.concat_ws(":", F.lit(collection), F.col("doc_id").cast("string"), index, F.col(text)))
    return c.select(chunk_id.alias("chunk_id"), F.lit(collection).alias("collection"), "doc_id", F.lit(tenant_id).cast("string").alias("tenant_id"), index.alias("chunk_index"), F.col(text).alias("text"), embed(text).alias("embedding"))


def ask(queries: DataFrame, chunks: DataFrame, top_k: int = 5, tenant: bool = False) -> DataFrame:
    """(query_id, rank, chunk_id, score, has_pii, dropped): screened nearest chunks of queries (query_id, query[, tenant_id]).

    With `tenant` a query sees the chunks of its tenant only; a query without a tenant then sees none.
    """
    key = F.xxhash64("chunk_id")
    data = chunks.select(key.alias("id"), F.col("embedding").alias("vec"), *([F.col("tenant_id").alias("tag")] if tenant else []))
    asked = queries.select(F.col("query_id").alias("id"), embed("query").alias("vec"), *([F.col("tenant_id").alias("tag")] if tenant else []))
    found = search.top_k(asked, data, top_k, same=tenant, exclude_self=False)
    texts = chunks.select(key.alias("id"), "chunk_id", "text")
    j = found.join(texts, "id")
    return j.select("query_id", "rank", "chunk_id", "score", F.coalesce(F.col("text").rlike(rules.PII), F.lit(False)).alias("has_pii"), rules.has(F.col("text"), rules.INJECTION).alias("dropped"))


def route(queries: DataFrame) -> DataFrame:
    return queries.withColumn("route", rules.route(F.col("query"), F.col("tenant_id")))


def classify(docs: DataFrame) -> DataFrame:
    return rules.classify(docs)


def sync_pages(pages: DataFrame, index_path: str) -> DataFrame:
    return incremental.sync(pages, index_path)


def evaluate(runs: DataFrame) -> DataFrame:
    """(metric, passed, runs) of runs with the columns of MARKS."""
    long = runs.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), (F.coalesce(F.col(k), F.lit(0.5)) >= v).alias("ok")) for k, v in MARKS.items()])).alias("m"))
    return long.groupBy(F.col("m.metric").alias("metric")).agg(F.sum(F.col("m.ok").cast("bigint")).alias("passed"), F.count("*").alias("runs"))


def collection_stats(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("collection").agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("documents"), F.sum(F.length("text")).alias("chars"))


def compare(runs: DataFrame) -> DataFrame:
    """(spec_a, spec_b, f_a, f_b, winner) of runs (spec, faithfulness): mean faithfulness of each pair of specifications, one row a specification before the join."""
    s = runs.groupBy("spec").agg(F.avg(F.coalesce("faithfulness", F.lit(0.5))).alias("f"))
    a, b = s.select(F.col("spec").alias("spec_a"), F.col("f").alias("f_a")), s.select(F.col("spec").alias("spec_b"), F.col("f").alias("f_b"))
    return a.join(b, F.col("spec_a") < F.col("spec_b")).withColumn("winner", F.when(F.round("f_a", 9) >= F.round("f_b", 9), F.col("spec_a")).otherwise(F.col("spec_b")))


def process(docs: DataFrame) -> DataFrame:
    """(doc_id, doc_class, class_confidence, field_type, value, error) of docs (doc_id, text[, file_name]): class and fields of each; a text that is null is an error, not a failure."""
    d = docs if "file_name" in docs.columns else docs.withColumn("file_name", F.lit(None).cast("string"))
    c = rules.classify_named(d.select("doc_id", "text", "file_name"), "text", "file_name").select("doc_id", "doc_class", "class_confidence", F.when(F.col("text").isNull(), "no text").alias("error"))
    return c.join(documents.invoice_fields(docs, "doc_id"), "doc_id", "left").select("doc_id", "doc_class", "class_confidence", "field_type", "value", "error")


def batch_totals(processed: DataFrame) -> DataFrame:
    """(documents, failed, fields) of the rows of `process`."""
    one = processed.groupBy("doc_id").agg(F.max("error").alias("error"), F.count("value").alias("fields"))
    return one.agg(F.count("*").alias("documents"), F.count("error").alias("failed"), F.coalesce(F.sum("fields"), F.lit(0)).alias("fields"))


def index_stats(index: DataFrame, chunks: DataFrame) -> DataFrame:
    return incremental.index_stats(index, chunks)


def reset_index(index: DataFrame, collection: str) -> DataFrame:
    return incremental.reset(index, collection)


def validate(records: DataFrame, key: str, fields: str, doc_type: str, confidence: str | None = None) -> DataFrame:
    return rules.validate(records, key, fields, doc_type, confidence)
