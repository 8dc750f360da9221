"""Identities, validation, guards, reply parsers, incremental runs, forms and the cache, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import identity, replies
from paperloom.functions.text import embed
from paperloom.operators import chunking, rules, search
from paperloom.operators import documents as doc
from paperloom.operators import entities as ent
from paperloom.operators import incremental as inc
from paperloom.plans import q_rules as qr
from paperloom.plans import q_search as qs
from paperloom.plans.q_extract import boxes, pages
from paperloom.plans.q_more import words
from paperloom.session import cut, table

Q: dict[str, tuple] = {}
STRIP, UUID, lit = qs.STRIP, qs.UUID, qr.lit


def q(name: str, sql: str | None = None):
    def put(f):
        Q[name] = (f, sql)
        return f

    return put


# ---- identities
_IDS = {"sentence_id": "'sent:'||chunk_index||':'||substr(chunk,1,50)", "contextual_id": "'ctx:'||chunk_index||':'||substr(chunk,1,50)", "cli_id": "'docs:cli:'||chunk_index||':'||substr(chunk,1,60)", "ingest_id": "'docs:'||doc_id||':'||substr(chunk,1,80)", "page_id": "doc_id||':page:'||chunk_index"}


@q("chunk_identities", f"SELECT doc_id, chunk_index, {', '.join(f'{UUID.format(v)} AS {k}' for k, v in _IDS.items())} FROM ({qs.FIXED})")
def chunk_identities(spark, d):
    c = chunking.fixed(qs.docs(spark, d), "doc_id")
    i, t, n = F.col("chunk_index"), F.col("chunk"), F.col("doc_id")
    return c.select("doc_id", "chunk_index", identity.sentence_id(i, t).alias("sentence_id"), identity.contextual_id(i, t).alias("contextual_id"), identity.cli_id("docs", i, t).alias("cli_id"), identity.ingest_id("docs", n, t).alias("ingest_id"), identity.page_id(n, i).alias("page_id"))


@q("point_lookup", "SELECT v.vec_id, e.label, len(e.embedding) AS dim FROM (SELECT DISTINCT doc_id AS vec_id FROM documents WHERE doc_id%100=0) v LEFT JOIN embeddings e USING (vec_id)")
def point_lookup(spark, d):
    """Points by id; an id that is not there keeps its row with nothing in it."""
    ids = qs.docs(spark, d).where("doc_id % 100 = 0").select(F.col("doc_id").alias("vec_id")).distinct()
    return ids.join(table(spark, d, "embeddings"), "vec_id", "left").select("vec_id", "label", F.size("embedding").alias("dim").cast("int")).withColumn("dim", F.when(F.col("dim") >= 0, F.col("dim")))


@q("scroll_points", "SELECT vec_id, label FROM embeddings ORDER BY vec_id LIMIT 100")
def scroll_points(spark, d):
    """The first page of a scroll: a hundred points by id."""
    return table(spark, d, "embeddings").select("vec_id", "label").orderBy("vec_id").limit(100)


# ---- classes and rules
@q("classify_page", f"SELECT page_id, CASE WHEN byname THEN nm ELSE CASE WHEN ok THEN a.k ELSE 'other' END END AS doc_class, CASE WHEN byname THEN 'name' ELSE 'text' END AS by FROM (SELECT page_id, nm, nm IN ('invoice','contract','id_document') AS byname, s[1] AS a, s[1].n>=4 AND (s[2].n=0 OR s[1].n>=2*s[2].n) AS ok FROM (SELECT page_id, {qr.NAME_SQL} AS nm, list_reverse_sort({qr.ARR}) AS s FROM (SELECT page_id, file_name, {qr.COUNTS} FROM (SELECT page_id, any_value(file_name) AS file_name, coalesce(any_value(text),'') AS t FROM extracted_pages GROUP BY 1))))")
def classify_page(spark, d):
    p = table(spark, d, "extracted_pages").select("page_id", "file_name", "text").distinct()
    return rules.classify_named(p, "text", "file_name").select("page_id", "doc_class", "by")


_MISS = "lower(regexp_replace(coalesce({},''),'^\\s+|\\s+$','','g')) IN ('','n/a','none','unknown')"


def _bad(kind, col, need, cols):
    if kind == "required":
        return _MISS.format(col)
    if kind == "regex":
        return f"NOT {_MISS.format(col)} AND NOT regexp_matches({col},{lit(need)})"
    return f"NOT {_MISS.format(col)} AND regexp_replace(coalesce({cols[need]},''),'\\s+','','g')=''"


_CLAIM = {"patient_name": "claimant_name", "provider_name": "insurer_name", "document_date": "incident_date", "diagnosis_codes": "incident_type", "title": "incident_type", "party_1": "insurer_name", "party_2": "claimant_name", "effective_date": "claimant_dob", "expiry_date": "incident_date", "id_number": "policy_number", "last_name": "claimant_name", "date_of_birth": "claimant_dob"}
_KINDS = ["medical", "contract", "id_document", "medical_report"]
_AMOUNT = "try_cast(regexp_replace(coalesce(claim_amount,''),'[^\\d.]','','g') AS DOUBLE)"
VALID = " UNION ALL ".join(
    [f"SELECT claim_id, '{k}' AS kind, '{f}' AS field, '{s}' AS severity FROM x WHERE claim_id%4={i} AND ({_bad(k, _CLAIM[f], n, _CLAIM)})" for i, name in enumerate(_KINDS) for k, f, n, s in rules.RULES[name]]
    + [f"SELECT claim_id, 'numeric_range', 'amount', 'warning' FROM x WHERE {STRIP.format('claim_amount')}<>'' AND ({_AMOUNT} IS NULL OR {_AMOUNT}<100 OR {_AMOUNT}>20000)", "SELECT claim_id, 'confidence', '', 'warning' FROM x WHERE (claim_id%10)/10.0<0.60"]
)


@q("validate_classes", f"WITH x AS (SELECT DISTINCT claim_id, {', '.join(sorted(set(_CLAIM.values())))}, claim_amount FROM insurance_claims) {VALID}")
def validate_classes(spark, d):
    """Claims read as records of four classes in turn, with a range for the amount and a confidence."""
    cols = sorted(set(_CLAIM.values()))
    x = table(spark, d, "insurance_claims").select("claim_id", *cols, "claim_amount").distinct()
    fields = F.create_map(*[y for k, v in _CLAIM.items() for y in (F.lit(k), F.col(v))], F.lit("amount"), F.col("claim_amount"))
    kind = F.get(F.array(*[F.lit(k) for k in _KINDS]), (F.col("claim_id") % 4).cast("int"))
    x = x.select("claim_id", fields.alias("f"), kind.alias("class"), ((F.col("claim_id") % 10) / 10).alias("conf"))
    return rules.validate(x, "claim_id", "f", "class", "conf", [("numeric_range", "amount", (100.0, 20000.0), "warning")])


# ---- guards
@q("guard_generation", "SELECT query_id, round(CASE WHEN coalesce(answer,'')='' THEN 1.0 WHEN faithfulness IS NULL THEN 0.5 ELSE round(faithfulness,3) END,3) AS faithfulness, array_to_string(CASE WHEN coalesce(answer,'')='' THEN [] ELSE list_filter([CASE WHEN (CASE WHEN faithfulness IS NULL THEN 0.5 ELSE round(faithfulness,3) END)<0.6 THEN 'FM-G1' END, CASE WHEN len(scores)>5 THEN 'FM-G2' END], lambda x: x IS NOT NULL) END,'+') AS events FROM (SELECT query_id, any_value(answer) AS answer, any_value(faithfulness) AS faithfulness, any_value(scores) AS scores FROM query_log GROUP BY 1) WHERE len(scores)>0")
def guard_generation(spark, d):
    """The logged score as the judge's reply, the logged scores as the retrieved chunks."""
    l = table(spark, d, "query_log").where(F.size("scores") > 0).dropDuplicates(["query_id"])
    reply = F.concat(F.lit("Score: "), F.format_string("%.3f", F.round("faithfulness", 3)))
    g = rules.guard_generation(l.select("query_id", "answer", F.size("scores").alias("n"), F.when(F.col("faithfulness").isNotNull(), reply).alias("reply")), "query_id", "answer", "n", "reply")
    return g.select("query_id", "faithfulness", F.array_join("events", "+").alias("events"))


@q("guard_retrieval_stale", f"WITH {qs.CAND} SELECT query_id, sum(old::INT) AS stale_chunks, array_to_string(list_filter([CASE WHEN count(*)>10 THEN 'FM-R5' END, CASE WHEN sum(old::INT)>0 THEN 'FM-R6' END, CASE WHEN max(CASE WHEN rank=1 THEN score END)<0.25 THEN 'FM-R1' END], lambda x: x IS NOT NULL),'+') AS events FROM (SELECT cand.*, coalesce(ingested_at-created_at>INTERVAL 30 DAY, false) AS old FROM cand JOIN ch USING (id) JOIN documents USING (doc_id)) GROUP BY 1")
def guard_retrieval_stale(spark, d):
    """Chunks of documents that came in more than thirty days after they were made are stale."""
    c = qs.candidates(spark, d).withColumn("doc_id", F.expr(f"id div {qs.CHUNKS}"))
    old = F.coalesce(F.col("ingested_at") - F.col("created_at") > F.expr("interval 30 days"), F.lit(False))
    g = rules.guard_retrieval(c.join(qs.docs(spark, d).select("doc_id", old.alias("stale")), "doc_id"), "query_id", stale="stale")
    return g.select("query_id", F.col("stale_chunks").cast("int").alias("stale_chunks"), F.array_join("events", "+").alias("events"))


# ---- replies
_LOG = "(SELECT DISTINCT query_id, query, spec, answer, faithfulness FROM query_log)"
_DEC = "list_filter(list_transform(string_split_regex(query,'(?i)\\s+and\\s+|[,;?]\\s*'), lambda x: regexp_replace(x,'^\\s+|\\s+$','','g')), lambda x: x<>'')[1:4]"


def _log(spark, d):
    return table(spark, d, "query_log").select("query_id", "query", "spec", "answer", "faithfulness").distinct()


@q("decompose_queries", f"SELECT query_id, sub_index, sub_query FROM (SELECT query_id, unnest(s) AS sub_query, generate_subscripts(s,1)-1 AS sub_index FROM (SELECT query_id, list_filter(list_transform({_DEC}, lambda x: {STRIP.format(chr(39).join(['regexp_replace(x,', '^[0-9.) -]+', ',', '', ')']))}), lambda x: x<>'') AS s FROM {_LOG} WHERE query IS NOT NULL))")
def decompose_queries(spark, d):
    """Sub-queries read from the numbered list of the default provider."""
    l = _log(spark, d).where("query is not null")
    return l.select("query_id", F.posexplode(replies.sub_queries(replies.decompose(F.col("query")))).alias("sub_index", "sub_query"))


@q("step_back", f"SELECT query_id, 'In general: '||regexp_replace(regexp_replace({STRIP.format('query')},'\\d[\\d.,]*','some','g'),'[\"'']([^\"'']+)[\"'']','something','g') AS abstract FROM {_LOG} WHERE query IS NOT NULL")
def step_back(spark, d):
    return _log(spark, d).where("query is not null").select("query_id", replies.step_back(F.col("query")).alias("abstract"))


@q("reply_category", f"SELECT query_id, CASE WHEN faithfulness IS NULL THEN 'SIMPLE' ELSE upper(coalesce(spec,'')) END AS category, CASE WHEN faithfulness IS NULL THEN 0.70 ELSE round(faithfulness,3) END AS confidence, CASE WHEN faithfulness IS NULL THEN 'LLM classified as simple factual query.' ELSE 'logged' END AS reason FROM {_LOG}")
def reply_category(spark, d):
    """Routing replies made from the log, with lines around the fields; records without a score have a reply that says nothing."""
    text = F.concat(F.lit("Sure.\nCATEGORY: "), F.lower(F.coalesce("spec", F.lit(""))), F.lit("\nCONFIDENCE: "), F.round("faithfulness", 3).cast("string"), F.lit("\nREASON: logged\n"))
    c = replies.category(F.when(F.col("faithfulness").isNotNull(), text).otherwise("no idea"))
    return _log(spark, d).select("query_id", c["category"].alias("category"), c["confidence"].alias("confidence"), c["reason"].alias("reason"))


@q("reply_signals", f"SELECT query_id, coalesce(contains(upper(answer),'YES'),false) AS yes, coalesce(contains(upper(answer),'DONE'),false) AS done, coalesce(contains(upper(answer),'COMPLETE'),false) AS complete FROM {_LOG}")
def reply_signals(spark, d):
    a = F.col("answer")
    return _log(spark, d).select("query_id", replies.yes(a).alias("yes"), replies.done(a).alias("done"), replies.done(a, "COMPLETE").alias("complete"))


@q("reply_actions", f"SELECT query_id, CASE query_id%3 WHEN 0 THEN 'tool' WHEN 1 THEN 'answer' ELSE 'text' END AS kind, CASE query_id%3 WHEN 0 THEN 'search' END AS tool, md5(CASE query_id%3 WHEN 2 THEN 'I think about it' ELSE regexp_replace({STRIP.format('query')},'[\\r\\n]+',' ','g') END) AS argument FROM {_LOG} WHERE query IS NOT NULL")
def reply_actions(spark, d):
    """Agents' replies made from the queries: a tool call, an answer, or mere thought."""
    line = F.regexp_replace(F.regexp_replace("query", r"^\s+|\s+$", ""), r"[\r\n]+", " ")
    n = F.col("query_id") % 3
    text = F.when(n == 0, F.concat(F.lit("Thinking\nTOOL: search\nINPUT: "), line)).when(n == 1, F.concat(F.lit("ANSWER: "), line)).otherwise("I think about it")
    a = replies.action(text)
    return _log(spark, d).where("query is not null").select("query_id", a["kind"].alias("kind"), a["tool"].alias("tool"), F.md5(a["argument"]).alias("argument"))


# ---- incremental runs: stored pages are the plain texts, the new ones the rich texts
def _run(spark, d):
    p = cut(qr._pages(spark, d))
    old = p.where(p.text.rlike(r"\S")).select(*inc.KEY, "text")
    return inc.process(p.where("rich_text is not null").select(*inc.KEY, F.col("rich_text").alias("text")), inc.page_index(old), inc.page_chunks(old))


def _chunk_sql(text: str, src: str) -> str:
    return f"(SELECT collection, doc_id, page_num, count(*) AS n FROM (SELECT collection, doc_id, page_num, substr(t,s+1,400) AS c FROM (SELECT collection, doc_id, page_num, {text} AS t, unnest(range(0,length({text}),350)) AS s FROM {src} WHERE regexp_matches({text},'\\S'))) WHERE length({STRIP.format('c')})>30 GROUP BY ALL)"


@q("incremental_report", f"WITH di AS ({qr.DIFF}), nw AS {_chunk_sql('rich_text', qr.PAGES)}, od AS {_chunk_sql('text', qr.PAGES)} SELECT collection, count_if(status='ADDED') AS added, count_if(status='UPDATED') AS updated, count_if(status='UNCHANGED') AS skipped, count_if(status='DELETED') AS deleted, coalesce(sum(CASE WHEN status IN ('ADDED','UPDATED') THEN nw.n END),0)::BIGINT AS chunks_embedded, coalesce(sum(CASE WHEN status IN ('UPDATED','DELETED') THEN od.n END),0)::BIGINT AS chunks_deleted FROM di LEFT JOIN nw USING (collection, doc_id, page_num) LEFT JOIN od USING (collection, doc_id, page_num) GROUP BY 1")
def incremental_report(spark, d):
    """One run of the page index: what changed, which chunks came and went."""
    return _run(spark, d)["report"].drop("incremental")


@q("incremental_chunks", f"WITH di AS ({qr.DIFF}), nw AS {_chunk_sql('rich_text', qr.PAGES)}, od AS {_chunk_sql('text', qr.PAGES)} SELECT collection, count(*) FILTER (WHERE status<>'DELETED') AS indexed_pages, coalesce(sum(CASE WHEN status IN ('ADDED','UPDATED') THEN nw.n WHEN status='UNCHANGED' THEN od.n END),0)::BIGINT AS total_chunks FROM di LEFT JOIN nw USING (collection, doc_id, page_num) LEFT JOIN od USING (collection, doc_id, page_num) GROUP BY 1 HAVING count(*) FILTER (WHERE status<>'DELETED')>0")
def incremental_chunks(spark, d):
    """What the index and the store hold after the run."""
    r = _run(spark, d)
    return inc.index_stats(r["index"], r["chunks"])


@q("incremental_lines", f"WITH di AS ({qr.DIFF}) SELECT collection, count_if(status<>'DELETED')||' pages' AS pages FROM di GROUP BY 1")
def incremental_lines(spark, d):
    """The line that a run reports, up to its number of pages."""
    l = inc.report_line(_run(spark, d)["report"])
    return l.select("collection", F.regexp_extract("line", r": (\d+ pages),", 1).alias("pages"))


@q("incremental_pages", f"WITH p AS (SELECT doc_id, text, unnest(string_split(text,chr(12))) AS t, generate_subscripts(string_split(text,chr(12)),1)-1 AS n FROM documents WHERE text IS NOT NULL) SELECT doc_id AS doc, n AS page_num, {UUID.format(chr(39).join(['doc_id||', ':page:', '||n']))} AS page_id, doc_id%2=1 AS changed FROM p")
def incremental_pages(spark, d):
    """Texts split at form feeds against a store that has the pages of the documents of even number."""
    docs = qs.docs(spark, d)
    stored = inc.changed_pages(docs.where("doc_id % 2 = 0"), spark.createDataFrame([], "page_id string, page_hash string"))
    return inc.changed_pages(docs, stored.select("page_id", "page_hash")).select("doc", "page_num", "page_id", "changed")


# ---- forms and responses
def _line_words(spark, d):
    b = cut(boxes(spark, d))
    w = doc.words_of_lines(b, ["block_id", "page_id"]).withColumnRenamed("block_id", "line_no")
    return w, b.select("page_id", F.col("block_id").alias("line_no"), "text")


_T = STRIP.format("text")
_K, _V = (STRIP.format(f"regexp_extract({_T},{lit(doc.LABEL_SPLIT)},{i})") for i in (1, 2))
_BY = f"regexp_matches({_T},{lit(doc.LABEL_SPLIT)}) AND (regexp_matches({_K},{lit(doc.LABELS)}) OR length({_K})<=30)"


@q("form_lines_signed", f"SELECT page_id, lower(k) AS k, arg_min(v,block_id) AS v FROM (SELECT page_id, block_id, {_K} AS k, {_V} AS v FROM (SELECT DISTINCT block_id, page_id, text FROM text_blocks) WHERE {_BY}) WHERE v<>'' AND k<>'' GROUP BY ALL")
def form_lines_signed(spark, d):
    """Fields by colon or dash, from the lines of a page without their words."""
    w, l = _line_words(spark, d)
    return doc.form_lines(w.where("false"), l, "page_id").select("page_id", F.lower("k").alias("k"), "v")


@q("form_lines")
def form_lines(spark, d):
    """Fields by colon, by halves of a line and by the next line, as on pages that look like forms."""
    w, l = _line_words(spark, d)
    return doc.form_lines(w, l, "page_id", aggressive=True)


_PO = "(SELECT DISTINCT po_id, vendor, order_date, total, subtotal, tax FROM purchase_orders)"


@q("expense_supplement", f"SELECT po_id, field_type, value FROM (SELECT po_id, 'VENDOR_NAME' AS field_type, vendor AS value FROM {_PO} UNION ALL SELECT po_id, 'TOTAL', total FROM {_PO} WHERE po_id%2=0 UNION ALL SELECT po_id, 'TOTAL', total FROM {_PO} WHERE po_id%2=1 AND coalesce(total,'')<>'' UNION ALL SELECT po_id, 'TAX', tax FROM {_PO} WHERE coalesce(tax,'')<>'' UNION ALL SELECT po_id, 'SUBTOTAL', subtotal FROM {_PO} WHERE coalesce(subtotal,'')<>'')")
def expense_supplement(spark, d):
    """Orders as fields (vendor, and the total of every second one) and as forms; only what is missing comes from the forms."""
    po = cut(table(spark, d, "purchase_orders").select("po_id", "vendor", "order_date", "total", "subtotal", "tax").distinct())
    f = lambda t, c: F.struct(F.lit(t).alias("field_type"), F.lit(t).alias("label"), F.col(c).alias("value"), F.lit(0.9).alias("confidence"))
    fields = po.select("po_id", F.explode(F.array_compact(F.array(f("VENDOR_NAME", "vendor"), F.when(F.col("po_id") % 2 == 0, f("TOTAL", "total"))))).alias("f")).select("po_id", "f.*")
    forms = po.select("po_id", F.explode(F.create_map(F.lit("Vendor"), F.lit("someone else"), F.lit("Total due"), "total", F.lit("tax"), "tax", F.lit("Subtotal"), "subtotal")).alias("k", "v"))
    return doc.supplement(fields, forms, "po_id").select("po_id", "field_type", "value")


@q("expense_items", "SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag, l_quantity)-1 AS item_no, 'ITEM: '||l_partkey||' | QUANTITY: '||l_quantity::BIGINT AS value FROM lineitem")
def expense_items(spark, d):
    """Expense responses made from order lines, read back as items."""
    l = table(spark, d, "lineitem")
    part = lambda t, c: F.struct(F.struct(F.lit(t).alias("Text")).alias("Type"), F.struct(c.alias("Text")).alias("ValueDetection"))
    item = F.struct(F.array(part("ITEM", F.col("l_partkey").cast("string")), part("PRICE", F.lit("")), part("QUANTITY", F.col("l_quantity").cast("bigint").cast("string"))).alias("LineItemExpenseFields"))
    g = l.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag", "l_quantity", item.alias("i")))), lambda x: x["i"]).alias("items"))  # an order is bounded
    body = F.to_json(F.struct(F.array(F.struct(F.array(F.struct(F.col("items").alias("LineItems"))).alias("LineItemGroups"))).alias("ExpenseDocuments")))
    return doc.expense_items(g.select("l_orderkey", body.alias("body")), "l_orderkey", "body")


@q("merged_pages", "SELECT file_name, md5(string_agg(coalesce(text,''),chr(10)||chr(10) ORDER BY page_num)) AS md5, count(*) AS page_count FROM (SELECT file_name, page_num, any_value(text) AS text FROM extracted_pages WHERE page_num<=200 OR page_num>200 GROUP BY ALL) GROUP BY 1")
def merged_pages(spark, d):
    p = table(spark, d, "extracted_pages").dropDuplicates(["file_name", "page_num"])
    return doc.merge_pages(p, "file_name", "page_num").select("file_name", F.md5("text").alias("md5"), "page_count")


@q("structured_orders", f"SELECT po_id, md5(coalesce(notes,'')||CASE WHEN vendor IS NOT NULL OR buyer IS NOT NULL THEN chr(10)||chr(10)||chr(10)||'--- FORM FIELDS ---'||chr(10)||concat_ws(chr(10),'Vendor: '||vendor,'Buyer: '||buyer) ELSE '' END||chr(10)||chr(10)||chr(10)||'--- DOCUMENT FIELDS ---'||chr(10)||'Total: '||coalesce(total,'')) AS md5 FROM (SELECT DISTINCT po_id, notes, vendor, buyer, total FROM purchase_orders)")
def structured_orders(spark, d):
    """Notes, form fields and document fields of an order as one text."""
    po = cut(table(spark, d, "purchase_orders").select("po_id", "notes", "vendor", "buyer", "total").distinct())
    forms = po.select("po_id", F.posexplode(F.array(F.struct(F.lit("Vendor").alias("k"), F.col("vendor").alias("v")), F.struct(F.lit("Buyer").alias("k"), F.col("buyer").alias("v")))).alias("n", "x")).select("po_id", "n", "x.k", "x.v").where("v is not null")
    fields = po.select("po_id", F.lit(0).alias("n"), F.lit("Total").alias("label"), F.col("total").alias("value"))
    return doc.structured_text(po.select("po_id", F.col("notes").alias("text")), "po_id", forms=forms, fields=fields).select("po_id", F.md5("structured").alias("md5"))


@q("spatial_order", "SELECT page_id, n, md5(text) AS md5 FROM (SELECT page_id, text, row_number() OVER (PARTITION BY page_id ORDER BY round_even(box_top::DOUBLE*1000/5,0)*5, box_left::DOUBLE*1000, text)-1 AS n FROM (SELECT DISTINCT block_id, page_id, text, box_top, box_left FROM text_blocks))")
def spatial_order(spark, d):
    b = boxes(spark, d).select("page_id", "text", (F.col("top") * 1000).alias("top"), (F.col("left") * 1000).alias("left"))
    return doc.spatial_order(b, "page_id").select("page_id", "n", F.md5("text").alias("md5"))


@q("upper_median_height", "SELECT page_id, list_sort(list(h))[len(list(h))//2+1] AS upper_median FROM (SELECT DISTINCT block_id, page_id, round(box_height::DOUBLE,6) AS h FROM text_blocks) GROUP BY 1")
def upper_median_height(spark, d):
    """The middle height of the lines of a page, the upper one of two."""
    h = boxes(spark, d).groupBy("page_id").agg(F.array_sort(F.collect_list(F.round("height", 6))).alias("h"))
    return h.select("page_id", F.get("h", F.floor(F.size("h") / 2).cast("int")).alias("upper_median"))


@q("ocr_words_confident", "SELECT page_id, sum(n) AS words FROM (SELECT DISTINCT block_id, page_id, len(list_filter(string_split(text,' '),lambda x: x<>'')) AS n FROM text_blocks WHERE confidence>=0.8) WHERE n>0 GROUP BY 1")
def ocr_words_confident(spark, d):
    """Words of lines that were read with enough confidence; lines without one are left out."""
    b = table(spark, d, "text_blocks").where("confidence >= 0.8").select("block_id").distinct()
    return words(spark, d).join(b, "block_id", "left_semi").groupBy("page_id").agg(F.count("*").alias("words"))


@q("parent_expansion", f"WITH p AS ({qs.PARENTS.format(p=512)}), c AS ({qs.CHILDREN.format(c=128, parents='SELECT * FROM p')}) SELECT c.doc_id, c.parent_index, min(child_index) AS first_child, md5(any_value(parent)) AS md5 FROM c JOIN p ON p.doc_id=c.doc_id AND p.parent_index=c.parent_index WHERE contains(chunk,'total') GROUP BY ALL")
def parent_expansion(spark, d):
    """Children that match give their parents, each once."""
    c = chunking.parent_child(qs.docs(spark, d), "doc_id")
    hit = c.where((F.col("level") == "child") & F.col("chunk").contains("total")).groupBy("doc_id", "parent_index").agg(F.min("child_index").alias("first_child"))
    return hit.join(c.where("level = 'parent'").select("doc_id", "parent_index", "chunk"), ["doc_id", "parent_index"]).select("doc_id", "parent_index", "first_child", F.md5("chunk").alias("md5"))


# ---- entities
@q("ner_annotated_text")
def ner_annotated_text(spark, d):
    """Pages with their entities put in as typed values."""
    return ent.annotated(table(spark, d, "extracted_pages"), "page_id").select("page_id", F.md5("annotated").alias("md5"), "n").distinct()


@q("ner_first_email", f"SELECT page_id, lower(regexp_extract(text,{lit(ent.EMAIL)},0)) AS first, len(regexp_extract_all(text,{lit(ent.EMAIL)},0)) AS n FROM (SELECT DISTINCT page_id, text FROM extracted_pages WHERE text IS NOT NULL) WHERE regexp_matches(text,{lit(ent.EMAIL)})")
def ner_first_email(spark, d):
    """The first value of a type, in order of place."""
    m = pages(spark, d).select("page_id", F.explode(ent.matches(F.col("text"), ent.EMAIL)).alias("m"))
    e = m.select("page_id", F.lit("EMAIL").alias("entity_type"), F.col("m.start").alias("start_char"), F.lower("m.raw").alias("normalized"))
    return ent.by_type(e, "page_id").select("page_id", "first", F.size("values").alias("n"))


# ---- cache and adaptive decomposition
@q("cache_run", f"SELECT a.vec_id AS id, coalesce('label '||h.label,'searched '||a.vec_id) AS answer, h.label IS NOT NULL AS cache_hit FROM embeddings a LEFT JOIN (SELECT query_id, hit_id, label FROM (SELECT a.vec_id AS query_id, min(b.vec_id) AS hit_id FROM embeddings a JOIN embeddings b ON b.vec_id<a.vec_id WHERE a.vec_id%100=0 AND b.vec_id%100<>0 AND round({qs.DOT},9)>=0.45 GROUP BY 1) JOIN embeddings ON vec_id=hit_id) h ON h.query_id=a.vec_id WHERE a.vec_id%100=0")
def cache_run(spark, d):
    """Hits take the stored answer, misses are searched and would be appended; the threshold suits the given vectors."""
    v = qs.vectors(spark, d).withColumn("seq", F.col("id"))
    entries = v.where("id % 100 <> 0").withColumn("answer", F.concat(F.lit("label "), F.col("label").cast("string")))
    got, _ = search.cached(qs.asked(v).select("id", "vec", "seq"), entries.select("id", "vec", "seq", "answer"), 0.45, lambda miss: miss.select("id", F.concat(F.lit("searched "), F.col("id").cast("string")).alias("answer")))
    return got.select("id", "answer", "cache_hit")


_SUB = f"su AS (SELECT id*10+k AS id, t FROM (SELECT id, unnest(s) AS t, generate_subscripts(s,1)-1 AS k FROM (SELECT id, ({_DEC.replace('query', 't')})[1:3] AS s FROM qs)))"


@q("adaptive_decomposed", f"WITH {qs.CH}, {qs.QS}, {_SUB}, ce AS ({qs.EMB.format(src='ch')}), qe AS ({qs.EMB.format(src='su')}), sc AS (SELECT qe.id AS vid, ce.id, round(sum(qe.v*ce.v),9) AS score FROM qe JOIN ce USING (b) GROUP BY ALL), r AS (SELECT vid//10 AS query_id, vid%10 AS sub_index, id, row_number() OVER (PARTITION BY vid ORDER BY score DESC, id) AS rank FROM sc) SELECT query_id, id, n FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sub_index, rank)-1 AS n FROM r WHERE rank<=5) WHERE n<6")
def adaptive_decomposed(spark, d):
    """Complex questions: up to three sub-queries, each searched, the first six chunks kept in that order."""
    subs = qs.questions(spark, d).select("id", F.posexplode(F.slice(replies.sub_queries(replies.decompose(F.col("text"))), 1, 3)).alias("k", "t"))
    c = qs.candidates(spark, d, 5, subs.select((F.col("id") * 10 + F.col("k")).alias("id"), F.col("t").alias("text")))
    c = c.select(F.expr("query_id div 10").alias("query_id"), F.struct((F.col("query_id") % 10).alias("sub"), "rank", "id").alias("x"))
    g = c.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list("x")), 1, 6).alias("x"))  # fifteen rows a question
    return g.select("query_id", F.posexplode("x").alias("n", "y")).select("query_id", F.col("y.id").alias("id"), "n")
