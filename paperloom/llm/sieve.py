"""A bitmap of hashed strings that lets tasks skip what cannot be asked for.

It is built by Spark in pages of 32,768 bits and sized by the number of distinct strings: about 16 bits a string,
at least 2^16 and at most 2^27 bits (16 MB), which is its bound as a broadcast. Hits are candidates only; callers join
them with the exact table, so a fuller bitmap lets more rows through but changes no result. It saturates beyond some
hundred million strings.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST, MOST = 16, 27
_PAGE = 32_768


def code(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "replace"))


def build(strings: DataFrame, col: Column) -> tuple[bytes, int]:
    """(bitmap, mask) of the values of `col`; null values are left out."""
    return build_codes(strings, F.crc32(col.cast("binary")))


def build_codes(df: DataFrame, code: Column) -> tuple[bytes, int]:
    """(bitmap, mask) of hash codes by their lowest bits."""
    values = df.select(code.alias("h")).where("h is not null")
    n = values.agg(F.approx_count_distinct("h")).first()[0] or 0
    bits = min(MOST, max(LEAST, (16 * n).bit_length()))
    mask = (1 << bits) - 1
    at = F.col("h").bitwiseAND(F.lit(mask)) + 1  # the functions count from 1
    pages = values.select(at.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m"))
    out = bytearray((mask + 1) // 8)
    for r in pages.collect():  # at most 2^MOST bits in all
        start = (r.b - 1) * (_PAGE // 8)
        page = bytes(r.m)[: min(_PAGE // 8, len(out) - start)]
        out[start : start + len(page)] = page
    return bytes(out), mask


def hit(packed: bytes, mask: int, s: str) -> int:
    h = zlib.crc32(s.encode("utf-8", "replace")) & mask
    return packed[h >> 3] >> (h & 7) & 1
