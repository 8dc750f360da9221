"""Reading order, borderless tables, expense and identity responses, answering strategies and reports with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from paperloom.operators import answering, search
from paperloom.operators import documents as doc
from paperloom.plans import q_search as qs
from paperloom.plans.q_extract import TB, boxes
from paperloom.session import table

Q: dict[str, tuple] = {}


def q(name: str, sql: str | None = None):
    def put(f):
        Q[name] = (f, sql)
        return f

    return put


# ---- words and reading order
WORDS = f"(SELECT block_id, page_id, word, l+w*pre/greatest(length(text),1) AS l, t, w*length(word)/greatest(length(text),1) AS w, h FROM (SELECT *, list_sum(list_transform(ws[1:i-1],lambda x: length(x)+1)) AS p0, coalesce(list_sum(list_transform(ws[1:i-1],lambda x: length(x)+1)),0) AS pre, ws[i] AS word FROM (SELECT *, unnest(range(1,len(ws)+1)) AS i FROM (SELECT *, string_split(text,' ') AS ws FROM {TB} WHERE length(text)>0))) WHERE word<>'')"


def words(spark, d):
    return doc.words_of_lines(boxes(spark, d), ["block_id", "page_id"])


@q("ocr_words", f"SELECT page_id, count(*) AS words, round(avg(l),6) AS mean_left, round(sum(w),5) AS total_width FROM {WORDS} GROUP BY 1")
def ocr_words(spark, d):
    return words(spark, d).groupBy("page_id").agg(F.count("*").alias("words"), F.round(F.avg("left"), 6).alias("mean_left"), F.round(F.sum("width"), 5).alias("total_width"))


@q("reading_lines", f"SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY block_no)-1 AS line_no, md5(array_to_string(list_filter(string_split(text,' '),lambda x: x<>''),' ')) AS md5 FROM (SELECT DISTINCT block_id, page_id, block_no, text FROM text_blocks WHERE length(replace(text,' ',''))>0)")
def reading_lines(spark, d):
    """The words, mixed up, come back as the lines of the page in reading order."""
    return doc.reading_lines(words(spark, d), "page_id").select("page_id", "line_no", F.md5("text").alias("md5"))


@q("borderless_columns")
def borderless_columns(spark, d):
    return doc.columns_of_tables(words(spark, d), "page_id", eps=0.004, least=2)


@q("borderless_cells")
def borderless_cells(spark, d):
    w = words(spark, d)
    c = doc.nearest_column(w, doc.columns_of_tables(w, "page_id", eps=0.004, least=2), "page_id")
    return c.groupBy("page_id", F.round("top", 2).alias("row"), "column").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("left", "word"))), lambda x: x["word"]), " ").alias("text"))


@q("bordered_cells", f"SELECT page_id, least(floor((l-lo)/greatest(hi-lo,1e-9)*4)::INT,3) AS col, count(*) AS words FROM (SELECT *, min(l) OVER (PARTITION BY page_id) AS lo, max(l+w) OVER (PARTITION BY page_id) AS hi FROM {WORDS}) GROUP BY ALL")
def bordered_cells(spark, d):
    """Words of ruled tables by four columns of equal width between the page's extents."""
    w = Window.partitionBy("page_id")
    x = words(spark, d).withColumn("lo", F.min("left").over(w)).withColumn("hi", F.max(F.col("left") + F.col("width")).over(w))
    col = F.least(F.floor((F.col("left") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-9)) * 4).cast("int"), F.lit(3))
    return x.groupBy("page_id", col.alias("col")).agg(F.count("*").alias("words"))


@q("two_column_order", f"SELECT page_id, CASE WHEN count_if(l>=0.5)<3 THEN 'single' ELSE 'two' END AS layout, count_if(l>=0.5) AS right_words FROM {WORDS} GROUP BY 1")
def two_column_order(spark, d):
    r = F.sum((F.col("left") >= 0.5).cast("int"))
    return words(spark, d).groupBy("page_id").agg(F.when(r < 3, "single").otherwise("two").alias("layout"), r.alias("right_words"))


@q("block_order", "SELECT page_id, md5(string_agg(text,chr(10) ORDER BY round_even(box_top::DOUBLE*20,0), box_left::DOUBLE, block_id)) AS md5 FROM (SELECT DISTINCT block_id, page_id, text, box_top, box_left FROM text_blocks) GROUP BY 1")
def block_order(spark, d):
    b = boxes(spark, d).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(F.bround(F.col("top") * 20).alias("r"), "left", "block_id", "text"))).alias("b"))
    return b.select("page_id", F.md5(F.array_join(F.transform("b", lambda x: x["text"]), "\n")).alias("md5"))


# ---- expense and identity responses made from purchase orders and onboardings
@q("expense_fields", "SELECT po_id, unnest(['vendor_name','invoice_date','total_amount','subtotal','ship_to']) AS name, unnest(['Vendor','INVOICE_RECEIPT_DATE','Total','SUBTOTAL','SHIP_TO']) AS label, unnest([vendor,order_date,total,subtotal,delivery_address]) AS value FROM (SELECT DISTINCT po_id, vendor, order_date, total, subtotal, delivery_address FROM purchase_orders)")
def expense_fields(spark, d):
    po = table(spark, d, "purchase_orders").select("po_id", "vendor", "order_date", "total", "subtotal", "delivery_address").distinct()
    f = lambda t, l, c: F.struct(F.struct(F.lit(t).alias("Text")).alias("Type"), F.struct(F.lit(l).cast("string").alias("Text")).alias("LabelDetection"), F.struct(F.col(c).alias("Text"), F.lit(90.0).alias("Confidence")).alias("ValueDetection"))
    fs = F.array(f("VENDOR_NAME", "Vendor", "vendor"), f("INVOICE_RECEIPT_DATE", None, "order_date"), f("TOTAL", "Total", "total"), f("SUBTOTAL", None, "subtotal"), f("SHIP_TO", None, "delivery_address"))
    body = po.select("po_id", F.to_json(F.struct(F.array(F.struct(fs.alias("SummaryFields"))).alias("ExpenseDocuments"))).alias("body"))
    return doc.named_expense(doc.expense_fields(body, "po_id", "body")).select("po_id", "name", "label", "value")


@q("identity_fields", "SELECT onboarding_id, unnest(['FIRST_NAME','DOCUMENT_NUMBER']) AS field_type, unnest([employee_name,national_id]) AS value FROM (SELECT DISTINCT onboarding_id, employee_name, national_id FROM employee_onboardings)")
def identity_fields(spark, d):
    e = table(spark, d, "employee_onboardings").select("onboarding_id", "employee_name", "national_id").distinct()
    f = lambda t, c: F.struct(F.struct(F.lit(t).alias("Text")).alias("Type"), F.struct(c.alias("Text"), F.lit(90.0).alias("Confidence")).alias("ValueDetection"))
    fs = F.array(f("FIRST_NAME", F.lit("first")), f("DOCUMENT_NUMBER", F.col("national_id")), f("FIRST_NAME", F.col("employee_name")))
    body = e.select("onboarding_id", F.to_json(F.struct(F.array(F.struct(fs.alias("IdentityDocumentFields"))).alias("IdentityDocuments"))).alias("body"))
    return doc.identity_fields(body, "onboarding_id", "body")


@q("page_hash_distance", "SELECT file_name, page_num, bit_count(xor(h,ph))::INT AS bits FROM (SELECT file_name, page_num, h, lag(h) OVER (PARTITION BY file_name ORDER BY page_num) AS ph FROM (SELECT DISTINCT file_name, page_num, ('0x'||substr(sha256(coalesce(text,'')),1,15))::BIGINT AS h FROM extracted_pages)) WHERE ph IS NOT NULL")
def page_hash_distance(spark, d):
    """Differing bits of the hashes of neighbouring pages (hashes of text stand in for image hashes)."""
    p = table(spark, d, "extracted_pages").select("file_name", "page_num", F.conv(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 15), 16, 10).cast("bigint").alias("h")).distinct()
    p = doc.with_previous(p, "file_name", "page_num", ["h"]).where("prev is not null")
    return p.select("file_name", "page_num", doc.hamming(F.array("h"), F.array(F.col("prev.h"))).cast("int").alias("bits"))


# ---- answering strategies
GRADED = f"WITH {qs.CAND}, {qs.OVER}"


def _graded(spark, d, k=5):
    c = qs.with_texts(spark, d, qs.candidates(spark, d, k))
    return c.withColumn("grade", F.round(qs.overlap(F.col("query"), F.col("chunk")), 3)).withColumn("support", F.round(F.coalesce(qs.overlap(F.coalesce("answer", F.lit("")), F.col("chunk")), F.lit(0.0)), 3))


@q("corrective_rag", GRADED + " SELECT query_id, sum((f>=0.5)::INT) AS good, sum((f>=0.5)::INT)=0 AS fallback FROM ov WHERE rank<=5 GROUP BY 1")
def corrective_rag(spark, d):
    return answering.corrective(_graded(spark, d))


@q("self_rag", GRADED + " , r AS (SELECT * FROM ov WHERE rank<=5 AND f>=0.3), s AS (SELECT DISTINCT query_id FROM r WHERE f>=0.6) SELECT r.query_id, r.id, r.rank FROM r LEFT JOIN s ON r.query_id=s.query_id WHERE CASE WHEN s.query_id IS NOT NULL THEN f>=0.6 ELSE rank<=2 END")
def self_rag(spark, d):
    c = _graded(spark, d).withColumn("relevant", F.coalesce(F.col("grade") >= 0.3, F.lit(False))).withColumn("supported", F.coalesce(F.col("grade") >= 0.6, F.lit(False)))
    return answering.self_checked(c, "relevant", "supported").select("query_id", "id", "rank")


@q("adaptive_rag", f"WITH {qs.CAND}, {qs.BM}, cx AS (SELECT id AS query_id, regexp_matches(t,'(?i)\\b(compare|differ|list all|summarize)\\b') AS c FROM qs), " + "li AS (SELECT query_id, id, rank AS r, 0 AS l FROM cand UNION ALL SELECT query_id, id, r, 1 FROM bmr), fu AS (SELECT query_id, id, round(sum(1.0/(60+r)),9) AS rrf, min(l*1000+r) AS f FROM li GROUP BY ALL), hy AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, f, id) AS rank FROM fu) SELECT query_id, 'dense' AS strategy, id, rank FROM cand JOIN cx USING (query_id) WHERE NOT c AND rank<=5 UNION ALL SELECT query_id, 'hybrid', id, rank FROM hy JOIN cx USING (query_id) WHERE c AND rank<=5")
def adaptive_rag(spark, d):
    """Simple questions are searched by vectors, complex ones by the fusion of vectors and words."""
    from paperloom.session import cut

    c = cut(qs.candidates(spark, d))
    kind = qs.questions(spark, d).select(F.col("id").alias("query_id"), F.col("text").rlike(r"(?i)\b(compare|differ|list all|summarize)\b").alias("complex"))
    dense = c.where("rank <= 5").join(kind.where(~F.col("complex")), "query_id").select("query_id", F.lit("dense").alias("strategy"), "id", "rank")
    some = c.join(kind.where("complex"), "query_id", "left_semi")
    lists = some.select("query_id", F.lit(0).alias("list_no"), "id", "rank").unionByName(search.ranked(qs._bm25(spark, d, some), "bm25", 1))
    return dense.unionByName(search.rrf(lists, 5).select("query_id", F.lit("hybrid").alias("strategy"), "id", "rank"))


@q("iterative_rounds")
def iterative_rounds(spark, d):
    """Up to three rounds; a question goes on, with the words of its best chunk added, while it has fewer than eight chunks."""
    q0 = qs.questions(spark, d).select("id", "text")
    chunk = qs.chunks(spark, d).withColumnRenamed("text", "chunk").withColumnRenamed("id", "cid")

    def refine(asked, found):
        few = found.groupBy("query_id").agg(F.count("*").alias("n"), F.max_by("id", F.struct("round", "id")).alias("cid")).where("n < 8")
        more = asked.join(few, asked.id == few.query_id).join(chunk.select("cid", "chunk"), "cid")
        return more.select("id", F.concat_ws(" ", "text", F.substring("chunk", 1, 80)).alias("text"))

    return answering.rounds(q0, lambda x: qs.candidates(spark, d, 3, x), refine)


# ---- reports
@q("collection_stats", "SELECT collection_name, count(*) AS documents, count(DISTINCT doc_type) AS doc_types, sum(coalesce(n_chars,0)) AS chars, min(created_at)::DATE::VARCHAR AS first_day FROM documents GROUP BY 1")
def collection_stats(spark, d):
    return table(spark, d, "documents").groupBy("collection_name").agg(F.count("*").alias("documents"), F.countDistinct("doc_type").alias("doc_types"), F.sum(F.coalesce("n_chars", F.lit(0))).alias("chars"), F.date_format(F.min("created_at"), "yyyy-MM-dd").alias("first_day"))


@q("event_props", "SELECT event_type, (props::JSON->>'$.k')::INT % 10 AS k, count(*) AS n FROM events GROUP BY ALL")
def event_props(spark, d):
    """An open JSON attribute, typed on the way."""
    k = F.try_variant_get(F.parse_json("props"), "$.k", "int")
    return table(spark, d, "events").groupBy("event_type", (k % 10).alias("k")).agg(F.count("*").alias("n"))


@q("tenant_isolation", "SELECT tenant_id, count(*) AS documents, count(DISTINCT collection_name) AS collections FROM documents WHERE tenant_id IS NOT NULL GROUP BY 1")
def tenant_isolation(spark, d):
    """What each tenant may see: rows without a tenant belong to none."""
    return table(spark, d, "documents").where(F.col("tenant_id").isNotNull()).groupBy("tenant_id").agg(F.count("*").alias("documents"), F.countDistinct("collection_name").alias("collections"))


@q("order_totals_by_region", "SELECT r_name, n_name, count(DISTINCT o_orderkey) AS orders, round(sum(l_extendedprice*(1-l_discount)),2) AS revenue FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey GROUP BY ALL")
def order_totals_by_region(spark, d):
    """Line-item totals rolled up over lookup tables; Spark chooses the join strategies by size."""
    l, o, c = table(spark, d, "lineitem"), table(spark, d, "orders"), table(spark, d, "customer")
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    j = l.join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.groupBy("r_name", "n_name").agg(F.countDistinct("o_orderkey").alias("orders"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
