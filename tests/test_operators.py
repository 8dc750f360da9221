"""Small fixtures: chunk properties, diff, fusion, search against brute force, entities, parsers, DBSCAN."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.functions.text import numbered_item, parse_score
from paperloom.operators import chunking, documents, incremental, rules, search
from paperloom.operators import entities as ent


def test_chunks_cover_the_text(spark):
    texts = [(1, "ab" * 700), (2, ""), (3, None), (4, "x"), (5, "é" * 451)]
    df = spark.createDataFrame(texts, "id int, text string")
    got = {}
    for r in chunking.fixed(df, "id").collect():
        got.setdefault(r.id, {})[r.chunk_index] = r.chunk
    assert set(got) == {1, 4, 5}
    for i, t in texts:
        if t:
            for k, c in got[i].items():
                assert c == t[k * 450 : k * 450 + 500]
            assert max(got[i]) == (len(t) - 1) // 450


@pytest.mark.parametrize("chunker", [chunking.fixed, chunking.sentence_window, chunking.parent_child, chunking.semantic, chunking.contextual, chunking.page_filtered, chunking.sentence_rows])
def test_chunkers_take_empty_tables_and_extra_columns(spark, chunker):
    empty = spark.createDataFrame([], "id int, text string, chunk string, s string, i int")
    assert chunker(empty, "id").count() == 0
    one = spark.createDataFrame([(1, None, "a", "b", 3), (2, "A first sentence of some length. And a second one that follows it.", "a", "b", 3)], "id int, text string, chunk string, s string, i int")
    assert {r.id for r in chunker(one, "id").collect()} <= {2}


def test_diff_is_idempotent_and_keeps_documents_apart(spark):
    pages = spark.createDataFrame([("c", "d1", 1, "one"), ("c", "d1", 2, "two"), ("c", "d2", 1, "uno")], "collection string, doc_id string, page_num int, text string")
    index = incremental.page_index(pages)
    assert {r.status for r in incremental.diff(index, index).collect()} == {"UNCHANGED"}
    only = incremental.page_index(pages.where("doc_id = 'd2'"))
    got = {(r.doc_id, r.page_num): r.status for r in incremental.diff(index, only).collect()}
    assert got == {("d1", 1): "ADDED", ("d1", 2): "ADDED", ("d2", 1): "UNCHANGED"}


def test_sync_keeps_versions(spark, tmp_path):
    pages = spark.createDataFrame([("c", "d1", 1, "one"), ("c", "d1", 2, "two")], "collection string, doc_id string, page_num int, text string")
    path = str(tmp_path / "index")
    assert {r.status for r in incremental.sync(pages, path).collect()} == {"ADDED"}
    changed = spark.createDataFrame([("c", "d1", 1, "ONE")], "collection string, doc_id string, page_num int, text string")
    assert {(r.page_num, r.status) for r in incremental.sync(changed, path).collect()} == {(1, "UPDATED"), (2, "DELETED")}


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 16))
    df = spark.createDataFrame([(i, v[i].tolist()) for i in range(300)] + [(999, None)], "id bigint, vec array<double>")
    got = {}
    old = search.BLOCK_MB
    search.BLOCK_MB = 0.0005  # several blocks of queries
    try:
        for r in search.top_k(df.where("id % 50 = 0"), df, 4).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.id))
    finally:
        search.BLOCK_MB = old
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    for q in range(0, 300, 50):
        s = np.round(v @ v[q], 9)
        s[q] = -np.inf
        want = sorted(range(300), key=lambda i: (-s[i], i))[:4]
        assert [i for _, i in sorted(got[q])] == want


def test_rrf_ignores_list_order_without_ties(spark):
    rows = [(1, 0, "a", 1), (1, 0, "b", 2), (1, 1, "b", 1), (1, 1, "c", 2)]
    df = spark.createDataFrame(rows, "query_id int, list_no int, id string, rank int")
    swapped = df.withColumn("list_no", 1 - F.col("list_no"))
    top = lambda d: [r.id for r in search.rrf(d, 1).collect()]
    assert top(df) == top(swapped) == ["b"]


@pytest.mark.parametrize("text,kind,norm", [("2024-01-15", "DATE", "2024-01-15"), ("15/01/2024", "DATE", "2024-01-15"), ("January 15, 2024", "DATE", "2024-01-15"), ("555-123-4567", "PHONE", "(555) 123-4567"), ("+1 555 123 4567", "PHONE", "(555) 123-4567"), ("UPPER.CASE@DOMAIN.COM", "EMAIL", "upper.case@domain.com"), ("Provider NPI: 1234567890", "ID_NUMBER", "NPI:1234567890"), ("code J069 found", "ICD_CODE", "J06.9"), ("Total due: $1800", "AMOUNT", "$1,800"), ("Total due: $0.99", "AMOUNT", "$0.99")])
def test_entities(text, kind, norm):
    assert any(e[0] == kind and e[2] == norm for e in ent.recognise(text))


def test_entities_leave_plain_numbers():
    assert not [e for e in ent.recognise("Chapter 3 covers Section 4 and Appendix 12") if e[0] == "AMOUNT"]
    assert all(e[2] != "2024-13-32" for e in ent.recognise("13/32/2024"))
    assert ent.recognise(None) == ent.recognise("  ") == []


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab12 .,@/-$JanuaryINC", max_size=80))
def test_entity_spans_are_disjoint(text):
    spans = [(e[3], e[4]) for e in ent.recognise(text)]
    assert all(b[0] >= a[1] for a, b in zip(spans, spans[1:]))


def test_match_offsets(spark):
    df = spark.createDataFrame([("a@b.cd and x.y@z.org",), ("none",), (None,)], "t string")
    got = [r.m for r in df.select(ent.matches(F.col("t"), ent.EMAIL).alias("m")).collect()]
    assert [(m.start, m.raw) for m in got[0]] == [(0, "a@b.cd"), (11, "x.y@z.org")] and not got[1] and not got[2]


def test_parsers(spark):
    df = spark.createDataFrame([("0.8 of 1", "1. item"), ("10", "- x"), ("none", "3D model"), (None, None)], "s string, n string")
    r = df.select(parse_score(F.col("s"), 0.5).alias("s"), numbered_item(F.col("n")).alias("n")).collect()
    assert [x.s for x in r] == [0.8, 1.0, 0.5, 0.5] and [x.n for x in r] == ["item", "x", "D model", None]


@pytest.mark.parametrize("query,category", [("please summarize", "SIMPLE"), ("compare medicare and medicaid", "COMPLEX"), ("how many chapters are there", "COMPLEX"), ("what changed since 2022", "COMPLEX"), ("investigate all possible causes", "AGENTIC"), ("what is not covered by the policy", "SIMPLE"), ("who is the vendor", "SIMPLE")])
def test_routes(spark, query, category):
    df = spark.createDataFrame([(query,)], "q string")
    assert df.select(rules.route(F.col("q"), F.lit(None).cast("string"))["category"]).first()[0] == category
    assert df.select(rules.route(F.col("q"), F.lit("t1"))["category"]).first()[0] == "MULTITENANT"


def test_dbscan(spark):
    pts = [(1, x) for x in [0.10, 0.11, 0.12, 0.50, 0.51, 0.90]]
    df = spark.createDataFrame(pts, "k int, x double")
    got = {r.x: r.cluster for r in documents.dbscan_1d(df, "k", "x", 0.021, 2).collect()}
    assert got == {0.10: 0, 0.11: 0, 0.12: 0, 0.50: 1, 0.51: 1, 0.90: -1}


def test_blank_pages_cut_on_both_sides(spark):
    df = spark.createDataFrame([("f", 1, 900, 1), ("f", 2, 0, 1), ("f", 3, 800, 1), ("f", 4, 820, 1)], "file string, page_num int, chars int, kind int")
    got = [(r.page_start, r.page_end, r.blank) for r in documents.split_segments(df, "file").orderBy("segment").collect()]
    assert got == [(1, 1, False), (2, 2, True), (3, 4, False)]


def test_rows_before_across_buckets(spark):
    rows = [("f", n, n * 10) for n in (1, 2, 5, 6, 7, 11, 30)] + [("g", 4, 40)]
    df = spark.createDataFrame(rows, "k string, n int, v int")
    got = {(r.k, r.n): r.prev.v if r.prev else None for r in documents.with_previous(df, "k", "n", ["v"], width=3).collect()}
    assert got == {("f", 1): None, ("f", 2): 10, ("f", 5): 20, ("f", 6): 50, ("f", 7): 60, ("f", 11): 70, ("f", 30): 110, ("g", 4): None}
    sums = documents.running_sum(documents.with_previous(df, "k", "n", ["v"], width=3), "k", "n", "v", "s")
    assert {(r.k, r.n): r.s for r in sums.collect()} == {("f", 1): 10, ("f", 2): 30, ("f", 5): 80, ("f", 6): 140, ("f", 7): 210, ("f", 11): 320, ("f", 30): 620, ("g", 4): 40}


def test_keywords_count_in_the_whole_text(spark):
    text = "x " * 6000 + "invoice subtotal vendor bill to; chief complaint: dob: prescribed: appendix"
    df = spark.createDataFrame([(text,), (None,)], "text string")
    assert [tuple(r)[1:3] for r in rules.classify(df).collect()] == [("invoice", 4), ("other", 0)]
    assert [tuple(r) for r in df.select(rules.hits(F.col("text"), rules.CLINICAL), rules.hits(F.col("text"), rules.REPORT)).collect()] == [(3, 1), (0, 0)]
