"""Answering strategies over retrieved candidates: grading, correction, rounds, routes. Models are column providers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.session import cut


def corrective(cand: DataFrame, grade: str = "grade", threshold: float = 0.5) -> DataFrame:
    """(query_id, good, fallback): how many candidates pass; none means the fallback answer."""
    good = F.sum((F.col(grade) >= threshold).cast("int"))
    return cand.groupBy("query_id").agg(good.alias("good"), (good == 0).alias("fallback"))


def self_checked(cand: DataFrame, relevant: str, supported: str, first: int = 2) -> DataFrame:
    """Candidates used as context: relevant and supported ones, else the first `first` relevant ones of the query."""
    rel = cand.where(F.col(relevant))
    some = rel.where(F.col(supported)).select("query_id").distinct().withColumn("has", F.lit(True))
    j = rel.join(some, "query_id", "left")
    return j.where(F.when(F.col("has"), F.col(supported)).otherwise(F.col("rank") <= first)).drop("has")


def rounds(queries: DataFrame, search: Callable[[DataFrame], DataFrame], refine: Callable[[DataFrame, DataFrame], DataFrame], most: int = 3) -> DataFrame:
    """(query_id, id, round): bounded retrieval rounds over the whole batch of queries.

    `search(queries)` gives (query_id, id); `refine(queries, found)` gives the queries that go on. A round is
    written once; the loop ends early when no query is left.
    """
    found = None
    for n in range(1, most + 1):
        new = search(queries).select("query_id", "id", F.lit(n).alias("round"))
        found = cut(new if found is None else found.unionByName(new.join(found.select("query_id", "id"), ["query_id", "id"], "left_anti")))
        if n < most:
            queries = cut(refine(queries, found))
            if not queries.limit(1).count():
                break
    return found
