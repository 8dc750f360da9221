"""Exact vector search, BM25 over candidates, reciprocal-rank fusion, federation and caching.

A stated set of queries is compared with all rows. The rows stay where they lie: each task runs over its part of the scan
and keeps the best k of every query, and the partial results are merged by rank, so what is shuffled is k rows a query and
task, whatever the number of rows. The queries are written once and sent to the tasks in blocks of at most BLOCK_MB,
which bounds the broadcast; each block is one pass over the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import tokens
from paperloom.session import cut, spread

#: Size of one block of queries, and how many are multiplied with a batch at once.
BLOCK_MB, QUERIES = 64, 1024


def _query_blocks(queries: DataFrame, cols: list[str]) -> list[pd.DataFrame | DataFrame]:
    """Blocks of the queries with a vector, each at most BLOCK_MB."""
    q = cut(queries.select(*cols).where(F.col("vec").isNotNull()))
    size = q.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim")).first()
    blocks = -(-(size["n"] * ((size["dim"] or 0) + 4) * 8) // int(BLOCK_MB * 2**20))
    b = F.pmod(F.xxhash64("id"), F.lit(max(1, blocks)))
    return [q.where(b == i) for i in range(blocks)]


def _matrix(vectors) -> np.ndarray:
    """Rows of unit length; a vector of zeros stays one."""
    m = np.array(vectors.tolist(), float)
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(n == 0, 1.0, n)


def _scan(queries: DataFrame, data: DataFrame, cols: list[str], kernel: Callable, schema: str) -> DataFrame:
    """Rows of `kernel(queries, its vectors, batches)` over each part of the data, for each block of queries."""
    spark = data.sparkSession
    data = spread(data.select(*cols).where(F.col("vec").isNotNull()))
    out = spark.createDataFrame([], schema)
    for block in _query_blocks(queries, cols):
        shared = spark.sparkContext.broadcast(block.toPandas())  # at most BLOCK_MB

        def run(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            q = shared.value
            return kernel(q, _matrix(q["vec"]), frames) if len(q) else iter(())

        out = out.unionByName(data.mapInPandas(run, schema))
    return out


def top_k(queries: DataFrame, data: DataFrame, k: int, same: bool = False, exclude_self: bool = True) -> DataFrame:
    """(query_id, [tag,] id, score, rank) of the k nearest rows by cosine; ties go to the smaller id.

    `queries` and `data` have (id, vec) and, with `same`, a column `tag` that must be equal (a filter
    before ranking, as for tenants; null matches nothing); a query may stand under several tags and is ranked under
    each. Rows without a vector take no part.
    """
    tag = ["tag"] if same else []
    cols = ["id", "vec", *tag]
    cast = lambda df: df.select(F.col("id").cast("bigint").alias("id"), F.col("vec").cast("array<double>").alias("vec"), *tag)

    def kernel(q: pd.DataFrame, qv: np.ndarray, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qi = q["id"].to_numpy(np.int64)
        qt = q["tag"].to_numpy(object) if same else None
        best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # query row, id, score
        held = 0

        def reduce() -> None:
            nonlocal best, held
            r, i, s = (np.concatenate(x) for x in zip(*best))
            order = np.lexsort((i, -s, r))
            r, i, s = r[order], i[order], s[order]
            first = np.searchsorted(r, r, side="left")
            keep = np.arange(len(r)) - first < k
            best = [(r[keep], i[keep], s[keep])]
            held = int(keep.sum())

        for pdf in frames:
            di = pdf["id"].to_numpy(np.int64)
            dv = _matrix(pdf["vec"])
            dt = pdf["tag"].to_numpy(object) if same else None
            for at in range(0, len(q), QUERIES):
                part = slice(at, at + QUERIES)
                s = np.round(qv[part] @ dv.T, 9)  # equal to 9 digits is a tie, whatever the order of the sums
                if exclude_self:
                    s[qi[part, None] == di[None, :]] = -np.inf
                if same:
                    s[(qt[part, None] != dt[None, :]) | np.array([t is None for t in qt[part]])[:, None]] = -np.inf
                n = min(k, s.shape[1])
                least = np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n]
                r, c = np.nonzero((s >= least[:, None]) & np.isfinite(s))
                best.append((r + at, di[c], s[r, c]))
                held += len(r)
            if held > 4 * k * len(q) + 100_000:
                reduce()
        if best:
            reduce()
            r, i, s = best[0]
            out = {"query_id": qi[r], "id": i, "score": s}
            yield pd.DataFrame(out | {"tag": qt[r]} if same else out)

    part = _scan(cast(queries), cast(data), cols, kernel, "query_id bigint, id bigint, score double" + (", tag string" if same else ""))
    rank = F.row_number().over(Window.partitionBy("query_id", *tag).orderBy(F.desc("score"), "id"))
    return part.withColumn("rank", rank).where(F.col("rank") <= k)


def first_hit(queries: DataFrame, data: DataFrame, threshold: float) -> DataFrame:
    """(query_id, hit_id): the earliest row of lower seq with cosine of at least threshold (semantic cache).

    Both sides have (id, vec, seq).
    """

    def kernel(q: pd.DataFrame, qv: np.ndarray, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qs = q["seq"].to_numpy(np.int64)
        none = np.iinfo(np.int64).max
        seq, hit = np.full(len(q), none), np.zeros(len(q), np.int64)
        for pdf in frames:
            pdf = pdf.sort_values("seq")
            ds, di, dv = pdf["seq"].to_numpy(np.int64), pdf["id"].to_numpy(np.int64), _matrix(pdf["vec"])
            for at in range(0, len(q), QUERIES):
                part = slice(at, at + QUERIES)
                ok = (np.round(qv[part] @ dv.T, 9) >= threshold) & (ds[None, :] < qs[part, None])
                j = ok.argmax(axis=1)
                r = np.flatnonzero(ok.any(axis=1) & (ds[j] < seq[part]))
                seq[at + r], hit[at + r] = ds[j[r]], di[j[r]]
        got = seq < none
        yield pd.DataFrame({"query_id": q["id"].to_numpy(np.int64)[got], "seq": seq[got], "hit_id": hit[got]})

    part = _scan(queries, data, ["id", "vec", "seq"], kernel, "query_id bigint, seq bigint, hit_id bigint")
    return part.groupBy("query_id").agg(F.min_by("hit_id", "seq").alias("hit_id"))


def cached(queries: DataFrame, entries: DataFrame, threshold: float, search: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Semantic cache: (answers, entries to append) for queries and entries (id, vec, seq, answer).

    A query takes the answer of the earliest entry of lower seq that is close enough; misses are run by `search`, which gives
    (id, answer), and come back as entries of their own seq. Queries of one call do not see each other's misses.
    """
    queries = cut(queries)
    hits = cut(first_hit(queries, entries, threshold))
    found = hits.join(entries.select(F.col("id").alias("hit_id"), "answer"), "hit_id").select(F.col("query_id").alias("id"), "answer", F.lit(True).alias("cache_hit"))
    misses = queries.join(hits.select(F.col("query_id").alias("id")), "id", "left_anti")
    run = cut(search(misses).select("id", "answer"))
    return found.unionByName(run.withColumn("cache_hit", F.lit(False))), misses.select("id", "vec", "seq").join(run, "id")


def bm25(candidates: DataFrame, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """(query_id, id, bm25) for candidates (query_id, query, id, text): each query's corpus is its candidates.

    idf = ln(N - n + 0.5) - ln(n + 0.5); a negative one becomes epsilon times the mean idf of the corpus'
    terms. Repeated words of a query count again. Candidates per query are bounded by the search before.
    """
    docs = candidates.select("query_id", "id", tokens(F.col("text")).alias("t"))
    size = docs.groupBy("query_id").agg(F.count("*").alias("n_docs"), F.avg(F.size("t")).alias("avg_len"))
    tf = docs.select("query_id", "id", F.size("t").alias("len"), F.explode("t").alias("w")).groupBy("query_id", "id", "len", "w").agg(F.count("*").alias("tf"))
    df = tf.groupBy("query_id", "w").agg(F.count("*").alias("n"))
    idf = df.join(size, "query_id").withColumn("idf", F.log(F.col("n_docs") - F.col("n") + 0.5) - F.log(F.col("n") + 0.5))
    mean = idf.groupBy("query_id").agg(F.avg("idf").alias("mean_idf"))
    idf = idf.join(mean, "query_id").withColumn("idf", F.when(F.col("idf") < 0, F.col("mean_idf") * epsilon).otherwise(F.col("idf"))).select("query_id", "w", "idf", "avg_len")
    asked = candidates.select("query_id", "query").distinct().select("query_id", F.explode(tokens(F.col("query"))).alias("w")).groupBy("query_id", "w").agg(F.count("*").alias("qn"))
    hit = tf.join(asked, ["query_id", "w"]).join(idf, ["query_id", "w"])
    part = F.col("qn") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    scores = hit.groupBy("query_id", "id").agg(F.sum(part).alias("bm25"))
    return docs.select("query_id", "id").join(scores, ["query_id", "id"], "left").select("query_id", "id", F.coalesce("bm25", F.lit(0.0)).alias("bm25"))


def rrf(rankings: DataFrame, k: int, constant: int = 60) -> DataFrame:
    """(query_id, id, rrf, rank) from (query_id, list_no, id, rank): sum of 1/(constant + rank), first seen first on ties."""
    fused = rankings.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 9).alias("rrf"), F.min(F.struct("list_no", "rank")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rrf"), "first", "id"))
    return fused.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "id", "rrf", "rank")


def ranked(df: DataFrame, score: str, list_no: int, k: int | None = None) -> DataFrame:
    """(query_id, list_no, id, rank) by a score, smaller ids first on ties."""
    r = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round(score, 9)), "id"))
    out = df.withColumn("rank", r).select("query_id", F.lit(list_no).alias("list_no"), "id", "rank")
    return out.where(F.col("rank") <= k) if k else out


def federated(per_collection: Callable[[], DataFrame], k: int) -> DataFrame:
    """Results of several collections (query_id, collection, id, score) by raw score, one row an id, best k."""
    once = F.row_number().over(Window.partitionBy("query_id", "id").orderBy(F.desc("score"), "collection"))
    best = per_collection().withColumn("o", once).where("o = 1").drop("o")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)
