"""Problem 8: every item once, no container above capacity, little unused space, splits only above capacity."""

import random
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from paperloom.llm import packing as P


def test_plan_uses_every_size_exactly():
    random.seed(2)
    c = Counter(min(512, int(random.lognormvariate(4.5, 0.8)) + 1) for _ in range(5000))
    plan = P.plan(list(c), list(c.values()), 512)
    used = Counter()
    for sizes, n, _ in plan:
        assert sum(sizes) <= 512 and n > 0
        for s in sizes:
            used[s] += n
    assert used == c
    containers, total = sum(n for _, n, _ in plan), sum(s * n for s, n in c.items())
    assert total / (containers * 512) > 0.97


def test_plan_of_nothing_and_of_one():
    assert P.plan([], [], 10) == []
    assert P.plan([10], [3], 10) == [((10,), 3, False)]
    assert sum(n for _, n, _ in P.plan([6], [3], 10)) == 3


def test_pack(spark):
    rows = [(i, 1 + (i * 37) % 90) for i in range(900)] + [(1000 + i, 60) for i in range(600)] + [(5000, 0), (5001, 0), (6000, 250)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens int")
    budgets = spark.createDataFrame([(1, 100), (2, 64)], "budget_id int, capacity_tokens int")
    got = P.pack(df, budgets, buckets=8).collect()
    for b, cap in ((1, 100), (2, 64)):
        load, pieces = defaultdict(int), defaultdict(list)
        for r in got:
            if r.budget_id == b:
                load[r.container_id] += r["size"]
                pieces[r.doc_id].append((r.piece_no, r["size"]))
        assert max(load.values()) <= cap
        assert set(pieces) == {i for i, _ in rows}
        for i, n in rows:
            assert sum(s for _, s in pieces[i]) == n
            assert len(pieces[i]) == max(1, -(-n // cap))
        assert sorted(set(load)) == list(range(max(load) + 1))
    assert P.pack(df.where("doc_id < 0"), budgets).count() == 0
    assert P.pack(df.withColumn("size", F.lit("x")).select("doc_id", "n_tokens"), budgets).count() == len(got)


@pytest.mark.parametrize("capacity", [512, 2048, 32_768])
def test_most_items_are_placed_by_the_fit(capacity):
    random.seed(3)
    c = Counter(min(capacity, int(random.lognormvariate(4.6, 1.0)) + 1) for _ in range(60_000))
    start = time.time()
    plan = P.plan(list(c), list(c.values()), capacity)
    assert time.time() - start < 10
    loose = sum(n * len(p) for p, n, _ in plan if p != (capacity,))
    assert sum(n * len(p) for p, n, fit in plan if fit) > 0.8 * loose
    assert all(sum(p) <= capacity for p, _, _ in plan)


def test_fit_of_sampled_patterns():
    random.seed(4)
    c = Counter(min(400, int(random.lognormvariate(3.5, 0.7)) + 1) for _ in range(40_000))
    plan = P.plan(list(c), list(c.values()), 400, entries=4000)
    used = Counter()
    for p, n, _ in plan:
        for s in p:
            used[s] += n
    assert used == c and sum(n for _, n, _ in plan) * 400 * 0.99 < sum(s * n for s, n in c.items())
