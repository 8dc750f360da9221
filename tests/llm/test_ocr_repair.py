"""Problem 5: readings against brute force, each kind of noise, and the repaired text."""

import itertools

from paperloom.llm import ocr_repair as O


def _brute(word, vocabulary, most):
    seen = {word}
    layer = {word}
    for _ in range(most):
        nxt = set()
        for w in layer:
            for a, b in O.PAIRS:
                for i in range(len(w)):
                    if w.startswith(a, i):
                        nxt.add(w[:i] + b + w[i + len(a) :])
        layer = nxt
        seen |= nxt
    return {w for w in seen if w in vocabulary and w != word}


def test_readings_hold_all_single_confusions():
    vocabulary = {w: 10 for w in ["claim", "modern", "annex", "illegible", "schedule", "units", "water", "could", "lines"]}
    trie = O.Trie(vocabulary)
    for w in ["daim", "modem", "anncx", "i1legible", "schedulc", "iinits", "vvater", "coulcl", "llnes", "units"]:
        assert {r for r, _, _ in trie.readings(w, 1, 0)} == _brute(w, vocabulary, 1)
    # two edits that touch different places
    assert "illegible" in {r for r, _, _ in trie.readings("il1egi6le")}


def test_readings_hold_all_plain_edits():
    vocabulary = {w: 10 for w in ["payment", "invoice", "receipt", "claim", "claims", "policyholder", "tenant", "tenants", "an", "and"]}
    trie = O.Trie(vocabulary)
    for w in ["paymnt", "paymemt", "invoise", "reciept", "paynent", "payrnent"]:
        assert {r for r, _, _ in trie.readings(w)} == {"payment" if w[0] == "p" else "invoice" if w[0] == "i" else "receipt"}
    letters = "abcdefghijklmnopqrstuvwxyz"

    def once(w):
        out = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        return out | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters} | {w[: i - 1] + w[i] + w[i - 1] + w[i + 1 :] for i in range(1, len(w))}

    for w in ["clam", "tenat", "tenants", "claims", "ad", "policyhodler", "polycholder", "xolicyholdr"]:
        near = once(w)
        if len(w) >= O.LONG:
            near |= {y for x in near for y in once(x)}
        want = {v for v in vocabulary if v in near and v != w}
        got = {r for r, _, _ in trie.readings(w)}
        assert want <= got and got - want <= _brute(w, vocabulary, 2) | {v for x in O.variants(w, 1) for v in once(x) if v in vocabulary}
        # frequent words alone, by the same search
        assert {r for r, _, _ in trie.readings(w, least_plain=11)} == {r for r, _, c in trie.readings(w) if c < O.PLAIN}


def test_plain_edits_need_their_context(spark, monkeypatch):
    texts = [("f", n, "The second payment of the day.") for n in range(250)] + [("g", 1, "A second paymnt came. Mr Paymeet called."), ("g", 2, "A second pamyent came")]
    words = spark.createDataFrame([(t,) for _, _, t in texts] + [("the of a",)] * 200, "text string")
    runs = []
    for bound in (100_000, 1):
        monkeypatch.setattr(O, "VOCABULARY", bound)
        runs.append({tuple(r) for r in O.noise(words, _pages(spark, texts)).where("noise_kind = 'misread'").collect()})
    assert runs[0] == runs[1] == {("t.text", i, "misread", 0, "payment") for i in (250, 251)}


def test_numbers_and_identities():
    assert O.number_reading("120o") == "1200" and O.number_reading("4l") == "41" or O.number_reading("4l") == "41"
    assert O.number_reading("z60316856") is None and O.number_reading("12345678z") is None and O.number_reading("35d") is None


PAGE = "Wijutrotum Group Operations Handbook    {n}\n\nThe reviewer rejected the missing signature page because the barc-\node was torn. Both short- and long-\nterm storage is priced. {bad}\n\nThe tenant flagged the revised schedule again.\n{n}"


def _pages(spark, texts):
    rows = [("t.text", f, n, i, t.split("\n"), None) for i, (f, n, t) in enumerate(texts)]
    return spark.createDataFrame(rows, "rec string, file string, page int, id bigint, lines array<string>, ids array<bigint>")


def test_noise(spark):
    texts = [(f"f{k}", n, PAGE.format(n=n, bad="The tenant flaggcd the revi5ed schedule." if (k, n) == (1, 2) else "The barcode was long-term.")) for k in range(4) for n in range(1, 5)]
    texts += [("g", 7, "3. Spare parts\nThe tenant flagged the schedule.\n143"), ("h", 1, ""), ("h", 2, "\n\n")]
    words = spark.createDataFrame([(t,) for _, _, t in texts * 3] + [(None,)], "text string")
    got = [tuple(r) for r in O.noise(words, _pages(spark, texts)).collect()]
    assert len(got) == len(set(got))
    by = {k: sorted((i, line, r) for _, i, kind, line, r in got if kind == k) for k in ("running_head", "page_number", "line_hyphen", "misread")}
    assert [x[:2] for x in by["running_head"]] == [(i, 0) for i in range(16)]
    assert [x[:2] for x in by["page_number"]] == [(i, 7) for i in range(16)]
    assert {x[1:] for x in by["line_hyphen"]} == {(2, "barcode"), (3, "long-term")} and len(by["line_hyphen"]) == 32
    assert by["misread"] == [(5, 4, "flagged"), (5, 4, "revised")]


def test_rare_words_are_readings_in_a_large_corpus(spark, monkeypatch):
    assert {v for v in O.variants("il1egi6le")} == _brute("il1egi6le", {v for v in O.variants("il1egi6le")}, 2) >= {"illegible"}
    texts = [("f", n, "The cinenegrix of napulitis.") for n in range(8)] + [("g", 1, "A cinencgrix of napu1itls."), ("g", 2, "Some vo1karen")]
    words = spark.createDataFrame([(t,) for _, _, t in texts] + [("the of a",)] * 200, "text string")
    runs = []
    for bound in (100_000, 2):
        monkeypatch.setattr(O, "VOCABULARY", bound)
        runs.append({tuple(r) for r in O.noise(words, _pages(spark, texts)).where("noise_kind = 'misread'").collect()})
    assert runs[0] == runs[1] and {r[-1] for r in runs[1]} == {"cinenegrix", "napulitis", "volkaren"}


def _tables(tmp_path, spark, pages, blocks):
    spark.createDataFrame(pages, "page_id bigint, file_name string, page_num int, is_scanned boolean, text string, rich_text string").write.parquet(f"{tmp_path}/extracted_pages.parquet")
    spark.createDataFrame(blocks, "block_id bigint, page_id bigint, file_name string, page int, block_no int, text string").write.parquet(f"{tmp_path}/text_blocks.parquet")
    return str(tmp_path)


def test_words_of_all_fields_count_once(spark, tmp_path):
    text = "The tenant signed the plan.\nIt was filed."
    form = lambda i: f"{text}\n\n{O.FORM_MARK}\nPolicy {'ho1der' if i == 3 else 'holder'}: passed"
    pages = [(i, f"f{i}", 1, True, text, form(i)) for i in range(9)] + [(0, "f0", 1, True, text, form(0)), (20, "g", 1, True, None, None)]
    lines = [(i, n, x) for i in range(9) for n, x in enumerate(y for y in form(i).split("\n") if y)] + [(20, 0, "A harbour wall"), (20, 1, "A harbour wa11"), *[(20, k, "near the harbour wall") for k in range(2, 9)]]
    blocks = [(i * 100 + n, i, f"f{i}", 1, n, x) for i, n, x in lines]
    d = _tables(tmp_path, spark, pages, blocks + blocks[:4])
    counts = {r.word: r.n for r in O.count_words(O.page_lines(spark, d)).collect()}
    assert [counts.get(w) for w in ("tenant", "holder", "ho1der", "wall", "wa11", "form")] == [9, 8, 1, 8, 1, None]
    got = {(r.record_table, r.record_id, r.field_name, r.line_no, r.repaired) for r in O.p5_found(spark, d).where("noise_kind = 'misread'").collect()}
    assert got == {("extracted_pages", 3, "rich_text", 4, "holder"), ("text_blocks", 303, "text", 0, "holder"), ("text_blocks", 2001, "text", 0, "wall")}


def test_repaired_holds_every_field(spark, tmp_path):
    text = "The tenant signed the long\nplan. It was filed in a barc-\node box."
    whole = "The tenant signed the long plan. It was filed in a barcode box."
    form = lambda i: f"{text}\n\n{O.FORM_MARK}\nPolicy {'ho1der' if i == 3 else 'holder'}: passed\nResult: passed"
    pages = [(i, f"f{i}", 1, True, text, form(i)) for i in range(9)] + [(20, "g", 1, False, "a\nb", None), (21, "g", 2, True, "one\ntwo", None)]
    blocks = [(i * 100 + 50 - n, i, f"f{i}", 1, n, x) for i in range(9) for n, x in enumerate(y for y in form(i).split("\n") if y)]
    d = _tables(tmp_path, spark, pages, blocks + blocks[:4])
    rows = [tuple(r) for r in O.p5_repaired(spark, d).collect()]
    got = {r[:3]: r[3] for r in rows}
    assert len(rows) == len(got) == 11 * 2 + 9
    repaired = f"{whole}\n\n{O.FORM_MARK}\n\nPolicy holder: passed\n\nResult: passed"
    assert got[("extracted_pages", 3, "text")] == whole
    assert got[("extracted_pages", 3, "rich_text")] == got[("text_blocks", 3, "text")] == got[("text_blocks", 4, "text")] == repaired
    assert got[("extracted_pages", 20, "text")] == "a\nb" and got[("extracted_pages", 20, "rich_text")] is None and got[("extracted_pages", 21, "text")] == "one two"


def test_repair_text():
    text = "Some Head    4\n\nThe reviewer flaggcd the barc-\node, and\nleft.\n\nNext one.\n4"
    events = [(0, "running_head", ""), (7, "page_number", ""), (2, "misread", "flagged"), (2, "line_hyphen", "barcode")]
    assert O.repair_text(text, events) == "The reviewer flagged the barcode, and left.\n\nNext one."
    assert O.repair_text("", []) == ""


def test_empty_tables(spark):
    none = spark.createDataFrame([], "text string")
    assert O.noise(none, _pages(spark, [("f", 1, "x")]).where("id < 0")).count() == 0
