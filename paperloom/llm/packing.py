"""Problem 8: documents packed into containers of fixed capacity.

Sizes are tokens of a public tokenizer. Only a text above the capacity is split: into full containers
and one remainder. All other decisions are made on the histogram of sizes, which has at most
`capacity` bins whatever the number of documents:

1. patterns, each the sizes of one full container, are enumerated: runs of sizes drawn in proportion to the
   histogram, closed to the last token by the one to three sizes that fit what is left; a pattern holds as many
   texts as a container does;
2. non-negative least squares fits how often each pattern is used so that the uses add up to the
   histogram; the fit is rounded, and never takes more of a size than there is. Both steps repeat on what is left
   while they place a tenth of it;
3. the residuals are packed by best fit decreasing, again on counts: each step repeats one container as
   often as its sizes allow.

The plan of each budget is made by one task from its histogram. It is a table of patterns and repeats. Each item
gets a rank within its size and reads its container from the plan. The rank needs no single task for a size, even
if a size holds a third of all items: items are counted per (size, bucket of the key) and numbered inside a bucket;
a bucket holds about BUCKET items, so their number grows with the table.

Defined cases: texts of no tokens (null, empty) take no space and go to containers in turn.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.tokens import NAME, token_counts
from paperloom.session import cut, table

#: Sizes in all patterns of one round; bounds the time of a plan, not what is packed.
ENTRIES = 120_000
#: Items that one bucket of keys should hold.
BUCKET = 50_000


def enumerate_patterns(sizes: np.ndarray, counts: np.ndarray, capacity: int, seed: int = 8, entries: int = ENTRIES) -> list[tuple[int, ...]]:
    """Patterns (sizes in falling order) that fill a container, or come as close as the sizes allow.

    Sizes are drawn by their counts, each at least once, and laid in containers, the longest first: what is left of a
    container is closed by one or two sizes that fit it exactly, else the longest that fits goes in and the rest is
    tried again. Every drawn item is used once, so the patterns together look like the histogram.
    """
    total = int(counts.sum())
    if total > entries:
        rng = np.random.default_rng(seed)
        counts = np.maximum(1, np.minimum(rng.multinomial(entries, counts / total), counts))
    live = dict(zip(sizes.tolist(), counts.tolist()))
    keys = sorted(live)
    have = np.zeros(capacity + 1, bool)
    have[sizes] = True
    ordered = np.sort(sizes)

    def use(s: int) -> None:
        live[s] -= 1
        if not live[s]:
            del live[s]
            del keys[bisect_left(keys, s)]
            have[s] = False

    out: dict[tuple[int, ...], None] = {}
    while keys:
        run, room = [], capacity
        while keys and room >= keys[0]:
            longest = keys[bisect_right(keys, room) - 1]
            end: list[int] = []
            if run and have[room]:
                end = [room]
            elif run and 2 * longest >= room:
                half = ordered[np.searchsorted(ordered, (room + 1) // 2) : np.searchsorted(ordered, room)]
                half = half[have[half] & have[room - half]]
                half = half[::-1] if len(half) and 2 * half[0] != room else half[:0:-1] if len(half) and live[int(half[0])] < 2 else half[::-1]
                if len(half):
                    end = [int(half[0]), room - int(half[0])]
            for s in end or [longest]:
                use(s)
                run.append(s)
                room -= s
        out[tuple(sorted(run, reverse=True))] = None
    return list(out)


def nnls(patterns: list[tuple[int, ...]], sizes: np.ndarray, counts: np.ndarray, rounds: int = 150) -> np.ndarray:
    """min |A x - counts|^2 with x >= 0, A the use of each size by each pattern; multiplicative updates keep x >= 0."""
    at = {s: i for i, s in enumerate(sizes.tolist())}
    uses = [(j, at[s], c) for j, p in enumerate(patterns) for s, c in Counter(p).items()]
    col, row, w = (np.array(x) for x in zip(*uses))
    w = w.astype(float)
    h = counts.astype(float)
    ath = np.bincount(col, w * h[row], len(patterns))
    x = np.full(len(patterns), h.sum() / w.sum())
    for _ in range(rounds):
        ax = np.bincount(row, w * x[col], len(h))
        x *= ath / np.maximum(np.bincount(col, w * ax[row], len(patterns)), 1e-12)
    return x


def _take(patterns, repeats, left: dict[int, int], out: list) -> int:
    """Use patterns as often as asked and as sizes allow; the items that this placed."""
    placed = 0
    for j in np.argsort(-repeats, kind="stable").tolist():
        if repeats[j] < 1:
            break
        p = patterns[j]
        uses = Counter(p)
        n = min(int(repeats[j]), *(left[s] // k for s, k in uses.items()))
        if n > 0:
            out.append((p, n, True))
            placed += n * len(p)
            for s, k in uses.items():
                left[s] -= n * k
    return placed


def plan(sizes, counts, capacity: int, entries: int = ENTRIES) -> list[tuple[tuple[int, ...], int, bool]]:
    """(sizes in one container, repeats, by the fit), all sizes used exactly as often as they occur."""
    left = {int(s): int(n) for s, n in zip(sizes, counts) if n > 0}
    out: list[tuple[tuple[int, ...], int, bool]] = []
    if capacity in left:
        out.append(((capacity,), left.pop(capacity), False))
    seed = 0
    while left:
        s = np.array(sorted(k for k, n in left.items() if n > 0), np.int64)
        if not len(s):
            break
        h = np.array([left[int(k)] for k in s], np.int64)
        seed += 1
        patterns = [p for p in enumerate_patterns(s, h, capacity, seed, entries) if sum(p) == capacity]
        if not patterns:
            break
        x = nnls(patterns, s, h)
        placed = _take(patterns, np.floor(x + 0.5), left, out)
        if placed < 0.3 * h.sum():  # repeats below one half, as in small tables: the likeliest patterns once
            placed += _take(patterns, np.where(x > 0, 1 + x / (x.max() + 1), 0), left, out)
        if placed < 0.1 * h.sum():
            break
    live = {k: n for k, n in left.items() if n > 0}
    keys = sorted(live)
    while live:
        container, room = [], capacity
        taken: dict[int, int] = {}
        i = bisect_right(keys, room) - 1
        while room > 0 and i >= 0:
            s = keys[i]
            k = min(room // s, live[s])
            if k:
                container += [s] * k
                taken[s] = k
                room -= s * k
            i = min(i - 1, bisect_right(keys, room) - 1)
        n = min(live[s] // k for s, k in taken.items())
        out.append((tuple(container), n, False))
        for s, k in taken.items():
            live[s] -= n * k
            if not live[s]:
                del live[s]
                del keys[bisect_left(keys, s)]
    return out


def pieces(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """One row per item: a text, or a piece of a text above the capacity."""
    return (
        sized.withColumn("b", F.explode(F.array(*[F.struct(F.lit(r.budget_id).alias("budget_id"), F.lit(r.capacity_tokens).alias("capacity_tokens")) for r in budgets.collect()])))
        .select("*", "b.*").drop("b")
        .withColumn("piece_no", F.explode(F.expr("sequence(0, greatest(0, cast(ceil(n_tokens / capacity_tokens) as int) - 1))")))
        .withColumn("size", F.expr("cast(least(capacity_tokens, n_tokens - piece_no * capacity_tokens) as int)"))
    )


def plans(histogram: DataFrame) -> DataFrame:
    """(budget_id, size, first, last, start, by_fit): ranks first..last of a size go to containers start, start+1, ...

    One task a budget; its group is a histogram of at most `capacity` rows.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["size"] > 0]
        rows, start = [], 0
        seen: Counter = Counter()
        if len(pdf):
            for p, n, fitted in plan(pdf["size"].to_numpy(), pdf["n"].to_numpy(), int(pdf["capacity_tokens"].iloc[0])):
                for s in p:
                    rows.append((int(pdf["budget_id"].iloc[0]), int(s), seen[s], seen[s] + n, start, fitted))
                    seen[s] += n
                start += n
        return pd.DataFrame(rows, columns=["budget_id", "size", "first", "last", "start", "by_fit"])

    return histogram.groupBy("budget_id").applyInPandas(run, "budget_id int, size int, first bigint, last bigint, start bigint, by_fit boolean")


def pack(sized: DataFrame, budgets: DataFrame, key: str = "doc_id", buckets: int | None = None) -> DataFrame:
    """(budget_id, container_id, key, piece_no, size, by_fit): every item in one container; by_fit if the fit placed it.

    `budgets` (budget_id, capacity_tokens) is a parameter table of a few rows. What is sent to the tasks is the plan:
    for each budget at most ENTRIES rows a round, with a tenth of the items placed in each, and those of the residuals.
    """
    sized = cut(sized)
    if buckets is None:
        buckets = max(16, -(-sized.count() // BUCKET))
    sized = sized.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    items = pieces(sized, budgets)
    by_bucket = cut(items.groupBy("budget_id", "capacity_tokens", "size", "bucket").agg(F.count("*").alias("n")))
    histogram = by_bucket.groupBy("budget_id", "capacity_tokens", "size").agg(F.sum("n").alias("n"))
    rows = cut(plans(histogram)).toPandas()
    slots: dict[tuple[int, int], tuple[np.ndarray, ...]] = {}
    totals: dict[int, int] = {}
    for (budget, s), x in rows.sort_values("first").groupby(["budget_id", "size"], sort=False):
        slots[(int(budget), int(s))] = tuple(x[c].to_numpy() for c in ("first", "last", "start", "by_fit"))
        totals[int(budget)] = max(totals.get(int(budget), 0), int((x["start"] + x["last"] - x["first"]).max()))
    shared = sized.sparkSession.sparkContext.broadcast((slots, totals))
    offset = F.sum("n").over(Window.partitionBy("budget_id", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))  # at most `buckets` rows a size
    offsets = by_bucket.select("budget_id", "size", "bucket", F.coalesce(offset, F.lit(0)).alias("before"))
    ranked = items.withColumn("r", F.row_number().over(Window.partitionBy("budget_id", "size", "bucket").orderBy(key, "piece_no")) - 1)
    ranked = ranked.join(offsets, ["budget_id", "size", "bucket"]).select("budget_id", key, "piece_no", "size", (F.col("r") + F.col("before")).alias("rank"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots, totals = shared.value
        for pdf in batches:
            ids, fit = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), bool)
            rank = pdf["rank"].to_numpy()
            for (budget, s), at in pdf.groupby(["budget_id", "size"]).indices.items():
                if s == 0:
                    ids[at] = rank[at] % max(1, totals.get(int(budget), 1))
                    continue
                first, last, start, fitted = slots[(int(budget), int(s))]
                i = np.searchsorted(last, rank[at], side="right")
                ids[at] = start[i] + rank[at] - first[i]
                fit[at] = fitted[i]
            yield pdf.assign(container_id=ids, by_fit=fit)[["budget_id", "container_id", key, "piece_no", "size", "by_fit"]]

    kind = sized.schema[key].dataType.simpleString()
    return ranked.mapInPandas(place, f"budget_id int, container_id bigint, {key} {kind}, piece_no int, size int, by_fit boolean")


def _sized(spark, sf_dir: str, name: str = NAME) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), name=name)


def _packed(spark, sf_dir: str) -> DataFrame:
    return pack(_sized(spark, sf_dir), table(spark, sf_dir, "token_budgets").select("budget_id", "capacity_tokens"))


def p8_containers(spark, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir).drop("by_fit")


def p8_fill(spark, sf_dir: str) -> DataFrame:
    """Per budget: containers, tokens, share of the space used, least number of containers possible, and the share of
    the items that do not fill a container alone which the fit placed."""
    budgets = table(spark, sf_dir, "token_budgets")
    c = _packed(spark, sf_dir).join(F.broadcast(budgets.select("budget_id", "capacity_tokens")), "budget_id")
    part = (F.col("size") > 0) & (F.col("size") < F.col("capacity_tokens"))
    used = c.groupBy("budget_id", "capacity_tokens").agg(F.max("container_id").alias("last"), F.sum("size").alias("tokens"), F.avg(F.when(part, F.col("by_fit").cast("int"))).alias("fit"))
    space = (F.col("last") + 1) * F.col("capacity_tokens")
    return used.select("budget_id", (F.col("last") + 1).alias("containers"), "tokens", F.round(F.col("tokens") / space, 4).alias("filled"), F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least"), F.round("fit", 4).alias("by_fit"))


def p8_coverage(spark, sf_dir: str) -> DataFrame:
    """Per budget: texts packed, containers above capacity, and texts within the capacity that were split."""
    budgets = table(spark, sf_dir, "token_budgets").select("budget_id", "capacity_tokens")
    c = cut(p8_containers(spark, sf_dir))
    texts = c.groupBy("budget_id", "doc_id").agg(F.sum("size").alias("n"), F.count("*").alias("pieces")).join(F.broadcast(budgets), "budget_id")
    texts = texts.groupBy("budget_id").agg(F.count("*").alias("texts"), F.sum(((F.col("pieces") > 1) & (F.col("n") <= F.col("capacity_tokens"))).cast("int")).alias("split_needlessly"))
    full = c.groupBy("budget_id", "container_id").agg(F.sum("size").alias("n")).join(F.broadcast(budgets), "budget_id")
    full = full.groupBy("budget_id").agg(F.sum((F.col("n") > F.col("capacity_tokens")).cast("int")).alias("overfull"))
    return texts.join(full, "budget_id").select("budget_id", "texts", "overfull", "split_needlessly")
