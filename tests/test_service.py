"""Layout cases, forms, supplements, validation, guards, replies, incremental runs, memory and the cache on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.functions import replies
from paperloom.operators import documents, incremental, layout, memory, rules, search
from paperloom.operators import entities as ent

WORDS = "page string, word string, left double, top double, width double, height double"


def _grid(page, columns, rows, text="text", width=0.08, jitter=0.0, height=0.012):
    rng = np.random.default_rng(3)
    return [(page, text, x + float(rng.normal(0, jitter)) if jitter else x, 0.05 + r * 0.03, width, height) for r in range(rows) for x in columns]


def _pages():
    two = _grid("two", [0.02, 0.06, 0.10, 0.80, 0.84, 0.88], 12, width=0.03)
    three = _grid("three", [0.05, 0.09, 0.45, 0.47, 0.86, 0.90], 12, width=0.02)
    form = [("form", t, 0.1 + 0.2 * i, 0.05 + r * 0.04, 0.1, 0.012) for r in range(6) for i, t in enumerate(["Name:", "Anna", "Berg"])]
    table = [("table", t, 0.1 + 0.2 * i, 0.05 + r * 0.04, 0.1, 0.012) for r in range(8) for i, t in enumerate(["Item", "12", "3.50"])]
    single = _grid("single", [0.30 + 0.05 * i for i in range(8)], 10)
    return [*two, *three, *form, *table, *single, ("few", "a", 0.1, 0.1, 0.1, 0.01)]


def _brute(words):
    """The features of one page, computed plainly."""
    l, t, w, h = (np.array([x[i] for x in words]) for i in (2, 3, 4, 5))
    r, n = l + w, len(words)
    c = np.round((l + l + w) / 2, 6)
    near = (np.abs(c[:, None] - c[None, :]) <= 0.05 + 1e-12).sum(1) >= 3
    cores = np.unique(c[near])
    tops = np.unique(np.round(t, 2))
    gaps = np.diff(tops)
    grid = np.linspace(0, 1, 200)
    sd = l.std(ddof=1) * 0.05 if n > 1 else 0
    d = np.exp(-0.5 * ((grid[:, None] - l) / sd) ** 2).sum(1) if sd else None
    return {
        "n_words": n, "n_columns": int((np.diff(cores) > 0.05).sum() + 1) if len(cores) else 0, "left_peaks": int((d > d.max() * 0.3).sum()) if sd else 1, "colon_ratio": np.mean([":" in x[1] for x in words]),
        "gap_cv": gaps.std() / (gaps.mean() + 1e-9) if len(tops) > 1 else 1.0, "height_cv": h.std() / (h.mean() + 1e-9), "cx_std": ((l + r) / 2).std(), "bimodal_ratio": np.mean((r < 0.5) | (l > 0.5)), "coverage": (w * h).sum(),
        "band_cv": (lambda b: b.std() / (b.mean() + 1e-9))(np.array([((t >= i / 5) & (t < (i + 1) / 5)).sum() for i in range(5)])),
    }


def test_features_and_rules(spark):
    rows = _pages()
    f = layout.page_features(spark.createDataFrame(rows, WORDS), "page")
    got = {r.page: r.asDict() for r in layout.rule_layout(f).collect()}
    for page, r in got.items():
        for k, v in _brute([x for x in rows if x[0] == page]).items():
            assert r[k] == pytest.approx(v, abs=1e-6), (page, k)
    assert {p: r["rule_layout"] for p, r in got.items()} == {"two": "MULTI_COLUMN", "three": "MULTI_COLUMN", "form": "FORM", "table": "TABLE_HEAVY", "single": "SINGLE_COLUMN", "few": "SINGLE_COLUMN"}
    assert got["few"]["rule_confidence"] == 0.55 and got["two"]["rule_confidence"] in (0.80, 0.85)


def test_forest_takes_what_rules_leave(spark):
    open_ = [("open", t, 0.1 + 0.13 * (i % 6), 0.05 + 0.037 * (i // 6) ** 1.1, 0.1, 0.012 + 0.004 * (i % 3)) for i, t in enumerate(["ab:", "12", "word", "longer", "x", "7"] * 5)]
    f = layout.page_features(spark.createDataFrame([*_pages(), *open_], WORDS), "page")
    model = layout.fit_forest(spark)
    got = {r.page: r for r in layout.classify(f, "page", model).collect()}
    assert set(got) == {"two", "three", "form", "table", "single", "few", "open"} and got["table"].strategy == "table_grid"
    assert all(0 < r.confidence <= 0.97 and r.layout in layout.PROTOTYPES for r in got.values())
    assert layout.classify(f.limit(0), "page", model).count() == 0
    # the forest knows its own prototypes
    protos = spark.createDataFrame([(k, *map(float, v)) for k, v in layout.PROTOTYPES.items()], ["page", *layout.FEATURES])
    asm, m = model
    hit = m.transform(asm.transform(protos)).select("page", "prediction").collect()
    assert [list(layout.PROTOTYPES)[int(r.prediction)] for r in hit] == [r.page for r in hit]


def test_unit_boxes_and_columns(spark):
    px = spark.createDataFrame([("a", "w", 100.0, 700.0, 50.0, 14.0, 1000, 1400), ("b", "w", 0.1, 0.5, 0.05, 0.01, 1000, 1400)], WORDS + ", pw int, ph int")
    assert {(r.page, r.left, r.top) for r in layout.unit_boxes(px, "pw", "ph").collect()} == {("a", 0.1, 0.5), ("b", 0.1, 0.5)}
    rows = [("p", f"{s}{r}", x, 0.1 * r, 0.1, 0.02) for r in range(1, 4) for s, x in (("L", 0.1), ("R", 0.7))]
    text = documents.column_text(spark.createDataFrame(rows, WORDS), "page").first().text
    assert text == "L1\nL2\nL3\nR1\nR2\nR3"
    assert documents.column_text(spark.createDataFrame(rows[:4], WORDS), "page").first().text == "L1 R1\nL2 R2"


def test_form_lines(spark):
    lines = [("p", 0, "Invoice No: 77"), ("p", 1, "Vendor        Blue Mill"), ("p", 2, "Patient name"), ("p", 3, "Anna Berg"), ("p", 4, "invoice no: 78"), ("p", 5, "Something odd here"), ("p", 6, "Tax:"), ("p", 7, "")]
    words = [(k, n, w, 0.1 + (0.5 if i else 0.0) + 0.05 * i, 0.04) for k, n, t in lines for i, w in enumerate(t.split())]
    ws = spark.createDataFrame(words, "page string, line_no int, word string, left double, width double")
    ls = spark.createDataFrame(lines, "page string, line_no int, text string")
    plain = {(r.k, r.v) for r in documents.form_lines(ws, ls, "page").collect()}
    assert plain == {("Invoice No", "77"), ("Vendor", "Blue Mill")} | {x for x in plain if x[0].startswith("Patient")}
    keen = {r.k: r.v for r in documents.form_lines(ws, ls, "page", aggressive=True).collect()}
    assert keen["Patient name"] == "Anna Berg" and keen["Invoice No"] == "77"
    assert documents.form_lines(ws.limit(0), ls.limit(0), "page").count() == 0


def test_supplement_and_items(spark):
    fields = spark.createDataFrame([(1, "TOTAL", "Total", "9.00", 0.9)], "id int, field_type string, label string, value string, confidence double")
    forms = spark.createDataFrame([(1, "Total due", "8.00"), (1, "po number", "77"), (1, "Tax", ""), (2, "Vendor", "Mill"), (2, "odd", "x"), (3, None, "y")], "id int, k string, v string")
    assert {(r.id, r.field_type, r.value) for r in documents.supplement(fields, forms, "id").collect()} == {(1, "TOTAL", "9.00"), (1, "PO_NUMBER", "77"), (2, "VENDOR_NAME", "Mill")}
    body = '{"ExpenseDocuments":[{"LineItemGroups":[{"LineItems":[{"LineItemExpenseFields":[{"Type":{"Text":"ITEM"},"ValueDetection":{"Text":"Pen"}},{"Type":{"Text":"PRICE"},"ValueDetection":{"Text":""}}]},{"LineItemExpenseFields":[]}]}]}]}'
    df = spark.createDataFrame([(1, body), (2, "{}"), (3, None), (4, "no json")], "id int, body string")
    assert [(r.id, r.value) for r in documents.expense_items(df, "id", "body").collect()] == [(1, "ITEM: Pen")]


def test_structured_text_and_extract(spark):
    texts = spark.createDataFrame([(1, "Body"), (2, None)], "id int, text string")
    forms = spark.createDataFrame([(1, 0, "Name", "Anna"), (1, 1, "Age", None)], "id int, n int, k string, v string")
    tables = spark.createDataFrame([(1, 1, 2, "| a |")], "id int, table_no int, page int, markdown string")
    got = {r.id: r.structured for r in documents.structured_text(texts, "id", tables=tables, forms=forms).collect()}
    assert got == {1: "Body\n\n\n--- TABLES ---\n\nTable 1 (page 2):\n| a |\n\n\n--- FORM FIELDS ---\nName: Anna\nAge: ", 2: ""}
    body = '[{"Id":"1","BlockType":"LINE","Text":"one"},{"Id":"2","BlockType":"LINE","Text":"two"},{"Id":"w","BlockType":"WORD","Text":"two"}]'
    b = documents.blocks(spark.createDataFrame([(1, body)], "id int, body string"), "id", "body")
    assert documents.line_text(b, "id").first().text == "one\ntwo"
    assert [r.part for r in documents.extract(b, "id").collect()] == ["text"]
    with pytest.raises(ValueError):
        documents.extract(b, "id", "nothing")
    pages = spark.createDataFrame([("f", 2, "b"), ("f", 1, "a"), ("f", 3, None)], "f string, n int, text string")
    assert tuple(documents.merge_pages(pages, "f", "n").first()) == ("f", "a\n\nb\n\n", 3)


def test_validation(spark):
    rows = [(1, {"vendor_name": "Mill", "total_amount": "12.50", "invoice_date": "2024-01-02"}, "invoice", 0.9), (2, {"vendor_name": "N/A", "total_amount": "abc", "due_date": "2024-02-01"}, "invoice", 0.5), (3, {"title": "T"}, "medical_report", None), (4, {}, "letter", 0.9), (5, {"amount": "1,200.00"}, "letter", 0.9), (6, {"amount": "twelve"}, "letter", 0.9)]
    df = spark.createDataFrame(rows, "id int, f map<string,string>, kind string, conf double")
    got = {(r.id, r.kind, r.field, r.severity) for r in rules.validate(df, "id", "f", "kind", "conf", [("numeric_range", "amount", (None, 1000.0), "")]).collect()}
    assert got == {(2, "required", "vendor_name", "error"), (2, "required", "invoice_date", "error"), (2, "regex", "total_amount", "warning"), (2, "cross_field", "due_date", "warning"), (2, "confidence", "", "warning"), (3, "required", "document_date", "error"), (5, "numeric_range", "amount", "warning"), (6, "numeric_range", "amount", "warning")}


def test_classify_by_name_first(spark):
    rows = [(1, "invoice_77.pdf", "dear sir"), (2, "medical.pdf", "x"), (3, None, "invoice subtotal vendor bill to invoice total due"), (4, "scan.pdf", None)]
    got = {r.id: (r.doc_class, r.by) for r in rules.classify_named(spark.createDataFrame(rows, "id int, name string, text string"), "text", "name").collect()}
    assert got == {1: ("invoice", "name"), 2: ("other", "text"), 3: ("invoice", "text"), 4: ("other", "text")}


def test_guards(spark):
    a = spark.createDataFrame([(1, "yes", 7, "0.4"), (2, "", 3, "0.2"), (3, "no", 0, "0.2"), (4, "yes", 2, "none"), (5, "yes", 2, "Score: .9")], "id int, a string, n int, reply string")
    got = {r.id: (r.faithfulness, r.events) for r in rules.guard_generation(a, "id", "a", "n", "reply").collect()}
    assert got == {1: (0.4, ["FM-G1", "FM-G2"]), 2: (1.0, []), 3: (1.0, []), 4: (0.5, ["FM-G1"]), 5: (0.9, [])}
    c = spark.createDataFrame([(1, 1, 0.2, True), (1, 2, 0.1, None), (2, 1, 0.9, False)], "q int, rank int, score double, old boolean")
    assert {r.q: (r.events, r.stale_chunks) for r in rules.guard_retrieval(c, "q", stale="old").collect()} == {1: (["FM-R6", "FM-R1"], 1), 2: ([], 0)}


def test_replies(spark):
    rows = ["CATEGORY: complex\nCONFIDENCE: 0.8\nREASON: two parts", "nothing", None, "CONFIDENCE: high"]
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    got = [tuple(r.c) for r in df.select(replies.category(F.col("t")).alias("c")).collect()]
    default = "LLM classified as simple factual query."
    assert got == [("COMPLEX", 0.8, "two parts"), ("SIMPLE", 0.7, default), ("SIMPLE", 0.7, default), ("SIMPLE", 0.7, default)]
    df = spark.createDataFrame([("1. one\n2) two\n\n- three\n4.",), (None,), ("",)], "t string")
    assert [r.s for r in df.select(replies.sub_queries(F.col("t")).alias("s")).collect()] == [["one", "two", "three"], [], []]
    df = spark.createDataFrame([("TOOL: find\nINPUT: mill",), ("ANSWER: 4",), ("hm",), (None,)], "t string")
    assert [tuple(r.a) for r in df.select(replies.action(F.col("t")).alias("a")).collect()] == [("tool", "find", "mill"), ("answer", None, "4"), ("text", None, "hm"), ("text", None, "")]


def test_incremental_run(spark):
    pages = lambda rows: spark.createDataFrame(rows, "collection string, doc_id string, page_num int, text string")
    long = "A page that is long enough to be one chunk of the store. "
    first = pages([("c", "d", 1, long), ("c", "d", 2, long + "two"), ("c", "d", 3, " "), ("e", "d", 1, long)])
    none = incremental.page_index(first).limit(0), incremental.page_chunks(first).limit(0)
    one = incremental.process(first, *none)
    rep = {r.collection: r.asDict() for r in one["report"].collect()}
    assert (rep["c"]["added"], rep["c"]["chunks_embedded"], rep["c"]["chunks_deleted"], rep["c"]["incremental"]) == (3, 2, 0, False)
    again = incremental.process(first, one["index"], one["chunks"])
    assert {(r.skipped, r.chunks_embedded, r.chunks_deleted) for r in again["report"].collect()} == {(3, 0, 0), (1, 0, 0)}
    second = pages([("c", "d", 1, long), ("c", "d", 2, long + "TWO"), ("e", "d", 1, long)])
    two = incremental.process(second, one["index"], one["chunks"])
    rep = {r.collection: r.asDict() for r in two["report"].collect()}
    assert (rep["c"]["updated"], rep["c"]["deleted"], rep["c"]["chunks_embedded"], rep["c"]["chunks_deleted"], rep["c"]["incremental"]) == (1, 1, 1, 1, True)
    assert {r.collection: (r.indexed_pages, r.total_chunks) for r in incremental.index_stats(two["index"], two["chunks"]).collect()} == {"c": (2, 2), "e": (1, 1)}
    assert "c: 2 pages, +0 ~1 =1 -1, 1 chunks in, 1 out (incremental)" in {r.line for r in incremental.report_line(two["report"]).collect()}
    after = incremental.process(second, incremental.reset(two["index"], "c"), two["chunks"].where("collection <> 'c'"))
    assert {r.collection: r.added for r in after["report"].collect()} == {"c": 2, "e": 0}


def test_memory_over_hot_sessions(spark):
    rows = [("s", i, None if i == 5 else f"q{i}") for i in range(40)] + [("t", 1, "a"), (None, 1, "n")]
    df = spark.createDataFrame(rows, "s string, at int, q string").fillna("", ["s"])
    got = {(r.s, r.at): r.recent for r in memory.recent(df, "s", ["at"], F.col("q"), 3, F.floor(F.col("at") / 2)).collect()}
    assert len(got) == len(rows)
    for i in range(40):
        assert got[("s", i)] == [None if j == 5 else f"q{j}" for j in range(max(0, i - 3), i)]
    assert got[("t", 1)] == got[("", 1)] == []


def test_cosine_and_cache(spark):
    data = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 9.0]), (3, [1.0, 1.0]), (4, None), (5, [0.0, 0.0])], "id bigint, vec array<double>")
    q = spark.createDataFrame([(1, [3.0, 0.0]), (9, None)], "id bigint, vec array<double>")
    assert [(r.query_id, r.id, round(r.score, 3)) for r in search.top_k(q, data, 2, exclude_self=False).orderBy("rank").collect()] == [(1, 1, 1.0), (1, 3, 0.707)]
    entries = data.select("id", "vec", F.col("id").alias("seq"), F.lit("old").alias("answer"))
    asked = spark.createDataFrame([(7, [5.0, 0.1], 7), (8, [-1.0, 0.0], 8)], "id bigint, vec array<double>, seq bigint")
    got, new = search.cached(asked, entries, 0.92, lambda m: m.select("id", F.lit("run").alias("answer")))
    assert {(r.id, r.answer, r.cache_hit) for r in got.collect()} == {(7, "old", True), (8, "run", False)}
    assert [r.id for r in new.collect()] == [8]


def test_annotated(spark):
    df = spark.createDataFrame([(1, "Write to A.B@Mail.org now"), (2, None), (3, "")], "id int, text string")
    got = {r.id: (r.annotated, r.n) for r in ent.annotated(df, "id").collect()}
    assert got == {1: ("Write to [EMAIL:a.b@mail.org] now", 1), 2: (None, 0), 3: ("", 0)}
