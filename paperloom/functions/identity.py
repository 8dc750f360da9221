"""Identities of chunks and pages: one recipe a path, all as the UUID layout of a SHA-256."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.text import uuid_of


def _key(*parts) -> Column:
    return uuid_of(F.concat(*[F.lit(p) if isinstance(p, (str, int)) else p.cast("string") for p in parts]))


def upsert_id(collection, text: Column) -> Column:
    return _key(collection, ":", F.substring(text, 1, 80))


def level_id(level, text: Column) -> Column:
    """Of a parent or child chunk."""
    return _key(level, ":", F.substring(text, 1, 60))


def sentence_id(index: Column, text: Column) -> Column:
    return _key("sent:", index, ":", F.substring(text, 1, 50))


def contextual_id(index: Column, text: Column) -> Column:
    return _key("ctx:", index, ":", F.substring(text, 1, 50))


def cli_id(collection, index: Column, text: Column) -> Column:
    return _key(collection, ":cli:", index, ":", F.substring(text, 1, 60))


def ingest_id(collection, doc: Column, text: Column) -> Column:
    return _key(collection, ":", doc, ":", F.substring(text, 1, 80))


def page_id(doc: Column, page: Column) -> Column:
    return _key(doc, ":page:", page)


def page_chunk_id(collection, doc: Column, page: Column, index: Column, text: Column) -> Column:
    return _key(collection, ":", doc, ":p", page, ":c", index, ":", F.substring(text, 1, 80))
