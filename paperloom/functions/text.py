"""Column functions shared by the operators: trimming, sentences, tokens, identities, embeddings."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIM = 64
_WS = re.compile(r"[ \t\n\f\r]+")


def strip(c) -> Column:
    """White space (ASCII) off both ends; `trim` takes only blanks."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def sentences(c) -> Column:
    """Split after . ! ? followed by white space."""
    return F.split(c, r"(?<=[.!?])\s+")


def tokens(c) -> Column:
    """Lower-case words between white space, without empty ones."""
    return F.filter(F.split(F.lower(c), r"\s+"), lambda x: x != "")


def uuid_of(key) -> Column:
    """The first 32 hex digits of the SHA-256 of a key in UUID layout."""
    return F.regexp_replace(F.substring(F.sha2(key, 256), 1, 32), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


_BUCKETS: dict[str, int] = {}


def bucket(token: str, dim: int = DIM) -> int:
    if token not in _BUCKETS:
        if len(_BUCKETS) > 1_000_000:
            _BUCKETS.clear()
        _BUCKETS[token] = int(hashlib.sha256(token.encode("utf-8", "replace")).hexdigest()[:8], 16)
    return _BUCKETS[token] % dim


def embed_all(texts, dim: int = DIM) -> list[list[float] | None]:
    """Deterministic stand-in for text embeddings: hashed counts of words, unit length; None without words."""
    words = [[w for w in _WS.split((t or "").lower()) if w] for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    at = np.repeat(np.arange(len(words)), sizes) * dim + np.array([bucket(w, dim) for ws in words for w in ws], np.int64).reshape(-1)
    m = np.bincount(at, minlength=len(words) * dim).reshape(len(words), dim).astype(float)
    m /= np.sqrt(np.maximum((m * m).sum(axis=1, keepdims=True), 1.0))
    return [x if n else None for x, n in zip(m.tolist(), sizes)]


def embed_one(text: str | None, dim: int = DIM) -> list[float] | None:
    return embed_all([text], dim)[0]


def embed(c) -> Column:
    """The default embedding provider; a real model is another Arrow UDF of this signature."""

    @F.pandas_udf("array<double>")
    def run(text: pd.Series) -> pd.Series:
        return pd.Series(embed_all(text), dtype=object)

    return run(c)


def parse_score(c, default: float) -> Column:
    """First number of the form 0, 1, 0.x, 1.x or .x in a reply, within 0..1; `default` without one."""
    n = F.regexp_extract(c, r"([01](?:\.\d+)?|\.\d+)", 1).try_cast("double")
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(n, F.lit(default))))


def numbered_item(c) -> Column:
    """A list line without its leading numbers, dots, dashes and brackets."""
    return F.regexp_replace(c, r"^[0-9.\-) ]+", "")
