"""Problem 7: every document as ids of a public byte-level tokenizer, offsets and exact decoding.

Encoding runs in Arrow batches per task (`mapInArrow`); nothing is shuffled. The tokenizer file is
read once per Python worker. Its path is a parameter (`PAPERLOOM_TOKENIZERS`, default
/opt/tokenizers); the file itself is never copied.

Defined results: a null text and an empty text both give the empty list; a blank text is encoded
like any other. Strings that look like special tokens are ordinary text.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from paperloom.session import spread, table

FOLDER = os.environ.get("PAPERLOOM_TOKENIZERS", "/opt/tokenizers")
NAME = "byte_bpe_50k"
#: texts per encoder call
BATCH = 256


@functools.lru_cache(maxsize=4)
def tokenizer(name: str = NAME, folder: str = FOLDER):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(folder, f"{name}.json"))
    t.encode_special_tokens = True
    return t


def byte_alphabet() -> dict[str, int]:
    """The byte-level table by its rule: printable Latin-1 bytes stand for themselves, the rest move up from 256 in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


@functools.lru_cache(maxsize=4)
def token_bytes(name: str = NAME, folder: str = FOLDER) -> list[bytes]:
    """The bytes that each id stands for."""
    with open(os.path.join(folder, f"{name}.json"), encoding="utf-8") as f:
        spec = json.load(f)
    alphabet = byte_alphabet()
    vocab = spec["model"]["vocab"]
    out = [b""] * (max([*vocab.values(), *(a["id"] for a in spec.get("added_tokens", []))]) + 1)
    for token, i in vocab.items():
        out[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
    for a in spec.get("added_tokens", []):
        out[a["id"]] = a["content"].encode()
    return out


def decode(ids, name: str = NAME, folder: str = FOLDER) -> str:
    """The text of ids; a character split over tokens is whole again once its bytes are joined."""
    t = token_bytes(name, folder)
    return b"".join(t[i] for i in ids).decode("utf-8", errors="replace")


def encode_texts(texts: list[str | None], name: str = NAME, folder: str = FOLDER) -> list[list[int]]:
    t, out = tokenizer(name, folder), []
    for k in range(0, len(texts), BATCH):
        out += [e.ids for e in t.encode_batch([x or "" for x in texts[k : k + BATCH]], add_special_tokens=False)]
    return out


def offsets(text: str, ids, name: str = NAME, folder: str = FOLDER) -> list[tuple[int, int]]:
    """Character span of each token: from the character that holds its first byte to past the one that holds its last.

    Tokens that share a split character both cover it, so spans of neighbours may overlap by one.
    """
    raw = text.encode("utf-8", errors="surrogatepass")
    # character number of each byte
    starts = (np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80
    char = np.cumsum(starts) - 1
    out, at = [], 0
    table_ = token_bytes(name, folder)
    for i in ids:
        n = len(table_[i])
        out.append((int(char[at]), int(char[at + n - 1]) + 1))
        at += n
    return out


def _arrow_lists(rows: list[list[int]]) -> pa.Array:
    sizes = np.fromiter((len(r) for r in rows), dtype=np.int64, count=len(rows))
    flat = np.fromiter((i for r in rows for i in r), dtype=np.int32, count=int(sizes.sum()))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))


def encode_column(df: DataFrame, key: str = "doc_id", text: str = "text", name: str = NAME, folder: str = FOLDER) -> DataFrame:
    """(key, ids) of every row; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), _arrow_lists(encode_texts(texts, name, folder))], names=["k", "ids"])

    kind = df.schema[key].dataType.simpleString()
    return spread(df.select(df[key].alias("k"), df[text].alias("t"))).mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", name: str = NAME, folder: str = FOLDER) -> DataFrame:
    """(key, n_tokens) of every row; 0 for null and empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(x) for x in encode_texts(b.column(1).to_pylist(), name, folder)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32())], names=["k", "n_tokens"])

    kind = df.schema[key].dataType.simpleString()
    return spread(df.select(df[key].alias("k"), df[text].alias("t"))).mapInArrow(run, f"k {kind}, n_tokens int").withColumnRenamed("k", key)


def decode_column(df: DataFrame, key: str = "doc_id", ids: str = "ids", name: str = NAME, folder: str = FOLDER) -> DataFrame:
    """(key, text) of every id list; a null list gives null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [None if x is None else decode(x, name, folder) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["k", "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(df[key].alias("k"), df[ids].alias("i")).mapInArrow(run, f"k {kind}, text string").withColumnRenamed("k", key)


def p7_ids(spark, sf_dir: str) -> DataFrame:
    return encode_column(table(spark, sf_dir, "documents"))


def p7_round_trip(spark, sf_dir: str) -> DataFrame:
    """(doc_id, text) decoded from the ids again; null texts come back as empty."""
    return decode_column(encode_column(table(spark, sf_dir, "documents")))
