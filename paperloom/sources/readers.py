"""Sources and sinks: text files, pages, OCR responses, batch results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGES = ("png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp", "gif")


def source_kind(path: Column) -> Column:
    """image, pdf, text or other by the extension of a path column."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ext.isin(*IMAGES), "image").when(ext == "pdf", "pdf").when(ext.isin("txt", "md", "text"), "text").otherwise("other")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, doc_id, text): each file whole, files of no bytes left out; doc_id is the first 16 digits of the SHA-256 of its name."""
    df = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return df.withColumn("doc_id", F.substring(F.sha2(F.element_at(F.split("path", "/"), -1), 256), 1, 16)).select("path", "doc_id", "text")


def text_pages(files: DataFrame) -> DataFrame:
    """(doc_id, page_num, text, char_count) of texts split at form feeds; pages count from 1 and are stripped."""
    p = files.where(F.col("text").isNotNull()).select("doc_id", F.posexplode(F.split("text", "\f")).alias("i", "text"))
    t = F.regexp_replace("text", r"^\s+|\s+$", "")
    return p.select("doc_id", (F.col("i") + 1).alias("page_num"), t.alias("text"), F.length(t).alias("char_count"))


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, length, content): the seam for readers of images and PDF, which need libraries of their own."""
    return spark.read.format("binaryFile").load(path).select("path", source_kind(F.col("path")).alias("kind"), "length", "content")


def ocr_responses(spark: SparkSession, path: str) -> DataFrame:
    """(path, body): one response a file, parsed by operators.documents.blocks."""
    return spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("path"), F.col("value").alias("body"))


def write_batch(results: DataFrame, key: str, fields: DataFrame, path: str, form: str = "csv") -> None:
    """Results with one column field_<name> for each field name of `fields` (key, name, value).

    The names are a small set that the skills define; pivot reads them once.
    """
    names = sorted(r[0] for r in fields.select("name").distinct().collect())
    wide = fields.groupBy(key).pivot("name", names).agg(F.max("value"))
    wide = wide.select(key, *[F.col(f"`{n}`").alias(f"field_{n}") for n in names])
    out = results.join(wide, key, "left").write.mode("overwrite")
    (out.option("header", True).csv if form == "csv" else out.json)(path)
