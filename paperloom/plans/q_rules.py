"""Incremental, routing, classification, guard, parser, validation, evaluation and memory queries with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from paperloom.functions.text import numbered_item, parse_score, tokens
from paperloom.operators import incremental as inc
from paperloom.operators import memory
from paperloom.operators import rules
from paperloom.session import table

Q: dict[str, tuple] = {}


def q(name: str, sql: str | None = None):
    def put(f):
        Q[name] = (f, sql)
        return f

    return put


def lit(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def m(col: str, p: str) -> str:
    return f"coalesce(regexp_matches({col}, {lit('(?i)' + p)}), false)"


STRIP = "regexp_replace({},'^\\s+|\\s+$','','g')"
LOG = "(SELECT DISTINCT query_id, query, collection_name, spec, tenant_id, ground_truth, answer, top_k, faithfulness, elapsed_ms, asked_at FROM query_log)"


def log(spark, d):
    return table(spark, d, "query_log").select("query_id", "query", "collection_name", "spec", "tenant_id", "ground_truth", "answer", "top_k", "faithfulness", "elapsed_ms", "asked_at").distinct()


# ---- incremental: the index of plain texts against the pages with their rich texts
PAGES = "(SELECT DISTINCT collection_name AS collection, file_name AS doc_id, page_num, text, rich_text FROM extracted_pages)"
OLD = f"SELECT collection, doc_id, page_num, sha256(text) AS old_hash FROM {PAGES} WHERE {STRIP.format('text')}<>''"
NEW = f"SELECT collection, doc_id, page_num, sha256(rich_text) AS hash FROM {PAGES} WHERE rich_text IS NOT NULL"
DIFF = f"SELECT coalesce(n.collection,o.collection) AS collection, coalesce(n.doc_id,o.doc_id) AS doc_id, coalesce(n.page_num,o.page_num) AS page_num, CASE WHEN o.old_hash IS NULL THEN 'ADDED' WHEN n.hash IS NULL THEN 'DELETED' WHEN hash=old_hash THEN 'UNCHANGED' ELSE 'UPDATED' END AS status, old_hash FROM ({NEW}) n FULL JOIN ({OLD}) o ON n.collection=o.collection AND n.doc_id=o.doc_id AND n.page_num=o.page_num"


def _pages(spark, d):
    return table(spark, d, "extracted_pages").select(F.col("collection_name").alias("collection"), F.col("file_name").alias("doc_id"), "page_num", "text", "rich_text").distinct()


def _changes(spark, d):
    p = _pages(spark, d)
    old = inc.page_index(p.where(p.text.rlike(r"\S")).select(*inc.KEY, "text"))
    new = inc.page_index(p.where(F.col("rich_text").isNotNull()).select(*inc.KEY, F.col("rich_text").alias("text")))
    return inc.diff(new, old)


@q("page_diff_status", f"SELECT collection, doc_id, page_num, status FROM ({DIFF})")
def page_diff_status(spark, d):
    return _changes(spark, d).select(*inc.KEY, "status")


@q("page_diff_report", f"SELECT collection, count_if(status='ADDED') AS added, count_if(status='UPDATED') AS updated, count_if(status='UNCHANGED') AS skipped, count_if(status='DELETED') AS deleted, bool_or(old_hash IS NOT NULL) AS incremental FROM ({DIFF}) GROUP BY 1")
def page_diff_report(spark, d):
    return inc.report(_changes(spark, d))


@q("chunks_to_delete", f"SELECT p.collection, p.doc_id, p.page_num, s//350 AS chunk_index FROM (SELECT *, unnest(range(0,length(text),350)) AS s FROM {PAGES} WHERE length(text)>0) p JOIN ({DIFF}) c USING (collection, doc_id, page_num) WHERE c.status IN ('UPDATED','DELETED') AND length({STRIP.format('substr(text,s+1,400)')})>30")
def chunks_to_delete(spark, d):
    p = _pages(spark, d).where(F.length("text") > 0)
    c = p.select(*inc.KEY, "text", F.posexplode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(350))).alias("chunk_index", "at"))
    c = c.where(F.length(F.regexp_replace(F.substr("text", F.col("at") + 1, F.lit(400)), r"^\s+|\s+$", "")) > 30).select(*inc.KEY, "chunk_index")
    return inc.chunks_to_delete(_changes(spark, d), c)


@q("upsert_last_wins", "SELECT query_id, max(received_at)::VARCHAR AS received_at, count(*) AS deliveries FROM query_log GROUP BY 1")
def upsert_last_wins(spark, d):
    l = table(spark, d, "query_log").select("query_id", "received_at")
    n = l.groupBy("query_id").agg(F.count("*").alias("deliveries"))
    last = inc.upsert(l, l.limit(0), "query_id", "received_at")
    stamp = F.regexp_replace(F.date_format("received_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"), r"\.?0+$", "")
    stamp = F.when(F.date_format("received_at", "SSSSSS") == "000000", F.date_format("received_at", "yyyy-MM-dd HH:mm:ss")).otherwise(stamp)
    return last.join(n, "query_id").select("query_id", stamp.alias("received_at"), "deliveries")


@q("index_stats", f"SELECT collection, count(*) AS pages, count(DISTINCT doc_id) AS documents, sum(length(text)) AS chars, sum(CASE WHEN length(text)>0 THEN (length(text)+349)//350 ELSE 0 END) AS chunks FROM {PAGES} GROUP BY 1")
def index_stats(spark, d):
    p = _pages(spark, d)
    n = F.length("text")
    return p.groupBy("collection").agg(F.count("*").alias("pages"), F.countDistinct("doc_id").alias("documents"), F.sum(n).alias("chars"), F.sum(F.when(n > 0, F.floor((n + 349) / 350)).otherwise(0)).alias("chunks"))


@q("scanned_documents", "SELECT file_name, count(*) AS pages, round(avg(char_count),4) AS mean_chars, coalesce(avg(char_count)<100,true) AS looks_scanned FROM (SELECT DISTINCT page_id, file_name, char_count FROM extracted_pages) GROUP BY 1")
def scanned_documents(spark, d):
    p = table(spark, d, "extracted_pages").select("page_id", "file_name", "char_count").distinct()
    return p.groupBy("file_name").agg(F.count("*").alias("pages"), F.round(F.avg("char_count"), 4).alias("mean_chars"), F.coalesce(F.avg("char_count") < 100, F.lit(True)).alias("looks_scanned"))


# ---- routing and classes
ROUTE_SQL = "CASE " + " ".join(f"WHEN {m('q', p)}{" AND len(list_filter(string_split_regex(q,'\\s+'), lambda x: x<>''))<=20" if r == 'NEGATION' else ''} THEN '{r}'" for r, p, *_ in rules.ROUTES) + " ELSE 'FALLBACK' END"


@q("route_query", f"SELECT query_id, CASE WHEN tenant_id IS NOT NULL AND tenant_id<>'' THEN 'TENANT' ELSE {ROUTE_SQL} END AS rule, {ROUTE_SQL} AS rule_without_tenant FROM (SELECT *, {STRIP.format('query')} AS q FROM {LOG})")
def route_query(spark, d):
    return log(spark, d).select("query_id", rules.route(F.col("query"), F.col("tenant_id"))["rule"].alias("rule"), rules.route(F.col("query"), F.lit(None).cast("string"))["rule"].alias("rule_without_tenant"))


@q("route_shares", f"SELECT rule, count(*) AS queries FROM (SELECT {ROUTE_SQL} AS rule FROM (SELECT *, {STRIP.format('query')} AS q FROM {LOG})) GROUP BY 1")
def route_shares(spark, d):
    return log(spark, d).select(rules.route(F.col("query"), F.lit(None).cast("string"))["rule"].alias("rule")).groupBy("rule").agg(F.count("*").alias("queries"))


COUNTS = ", ".join(f"len(regexp_extract_all(t, {lit('(?i)' + p)})) AS n_{k}" for k, p in rules.CLASSES.items())
ARR = "[" + ",".join(f"{{'n': n_{k}, 'o': {-i}, 'k': '{k}'}}" for i, k in enumerate(rules.CLASSES)) + "]"


@q("classify_doc", f"SELECT doc_id, CASE WHEN ok THEN a.k ELSE 'other' END AS doc_class, a.n AS class_score, round(CASE WHEN ok THEN least(0.92,0.65+a.n*0.03) ELSE 0.60 END,4) AS confidence FROM (SELECT doc_id, s[1] AS a, s[1].n>=4 AND (s[2].n=0 OR s[1].n>=2*s[2].n) AS ok FROM (SELECT doc_id, list_reverse_sort({ARR}) AS s FROM (SELECT doc_id, {COUNTS} FROM (SELECT doc_id, substr(coalesce(text,''),1,5000) AS t FROM documents))))")
def classify_doc(spark, d):
    return _classes(spark, d, 5000)  # the reference's window, which the SQL states


@q("classify_doc_whole", f"SELECT doc_id, CASE WHEN ok THEN a.k ELSE 'other' END AS doc_class, a.n AS class_score, round(CASE WHEN ok THEN least(0.92,0.65+a.n*0.03) ELSE 0.60 END,4) AS confidence FROM (SELECT doc_id, s[1] AS a, s[1].n>=4 AND (s[2].n=0 OR s[1].n>=2*s[2].n) AS ok FROM (SELECT doc_id, list_reverse_sort({ARR}) AS s FROM (SELECT doc_id, {COUNTS} FROM (SELECT doc_id, coalesce(text,'') AS t FROM documents))))")
def classify_doc_whole(spark, d):
    return _classes(spark, d, None)


def _classes(spark, d, window):
    return rules.classify(table(spark, d, "documents").select("doc_id", "text"), window=window).select("doc_id", "doc_class", "class_score", F.round("class_confidence", 4).alias("confidence"))


NAME_SQL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(file_name),'{p}')" for p in parts) + f" THEN '{k}'" for k, _, parts in rules.FILE_NAMES) + " ELSE 'other' END"


@q("classify_filename", f"SELECT file_name, {NAME_SQL} AS doc_class, count(DISTINCT page_id) AS pages FROM extracted_pages GROUP BY 1")
def classify_filename(spark, d):
    p = table(spark, d, "extracted_pages").select("file_name", "page_id").distinct().groupBy("file_name").agg(F.count("*").alias("pages"))
    return p.select("file_name", rules.classify_name(F.col("file_name"))["doc_class"].alias("doc_class"), "pages")


def _hits(ps):
    return "+".join(f"{m('t', p)}::INT" for p in ps)


@q("clinical_or_report", f"SELECT doc_id, c AS clinical_hits, r AS report_hits, c>=3 AND r<=1 AS is_clinical FROM (SELECT doc_id, {_hits(rules.CLINICAL)} AS c, {_hits(rules.REPORT)} AS r FROM (SELECT doc_id, substr(coalesce(text,''),1,4000) AS t FROM documents))")
def clinical_or_report(spark, d):
    return _signals(spark, d, 4000)  # the reference's window, which the SQL states


@q("clinical_or_report_whole", f"SELECT doc_id, c AS clinical_hits, r AS report_hits, c>=3 AND r<=1 AS is_clinical FROM (SELECT doc_id, {_hits(rules.CLINICAL)} AS c, {_hits(rules.REPORT)} AS r FROM (SELECT doc_id, coalesce(text,'') AS t FROM documents))")
def clinical_or_report_whole(spark, d):
    return _signals(spark, d, None)


def _signals(spark, d, window):
    x = table(spark, d, "documents").select("doc_id", rules.hits(F.col("text"), rules.CLINICAL, window).alias("clinical_hits"), rules.hits(F.col("text"), rules.REPORT, window).alias("report_hits"))
    return x.withColumn("is_clinical", (F.col("clinical_hits") >= 3) & (F.col("report_hits") <= 1))


# ---- guards
@q("guard_system", f"SELECT page_id, any_value({m('text', rules.INJECTION)}) AS dropped, any_value(coalesce(regexp_matches(text,{lit(rules.PII)}),false)) AS has_pii FROM extracted_pages GROUP BY 1")
def guard_system(spark, d):
    t = F.col("text")
    return table(spark, d, "extracted_pages").select("page_id", rules.has(t, rules.INJECTION).alias("dropped"), F.coalesce(t.rlike(rules.PII), F.lit(False)).alias("has_pii")).distinct()


@q("guard_ambiguity", f"SELECT query_id, {m('query', rules.NEGATED)} AS negation, {m('query', rules.GLOBAL)} AS global_scope, length(query)-length(replace(query,'?',''))>1 OR {m('query', rules.CONJOINED)} AS multi_intent FROM {LOG}")
def guard_ambiguity(spark, d):
    c = F.col("query")
    marks = F.length(c) - F.length(F.replace(c, F.lit("?"), F.lit("")))
    return log(spark, d).select("query_id", rules.has(c, rules.NEGATED).alias("negation"), rules.has(c, rules.GLOBAL).alias("global_scope"), ((marks > 1) | rules.has(c, rules.CONJOINED)).alias("multi_intent"))


@q("guard_severity", f"SELECT severity, count(*) AS events FROM (SELECT CASE WHEN {m('text', rules.INJECTION)} THEN 'BLOCK' WHEN regexp_matches(text,{lit(rules.PII)}) THEN 'BLOCK' WHEN length(text)>10000 THEN 'WARN' ELSE 'PASS' END AS severity FROM (SELECT doc_id, coalesce(text,'') AS text FROM documents)) GROUP BY 1")
def guard_severity(spark, d):
    """Guard events of each text by severity: FM-S or drop blocks, other failure modes warn."""
    t = F.coalesce("text", F.lit(""))
    events = F.array_compact(F.array(F.when(rules.has(t, rules.INJECTION), "FM-S2: drop"), F.when(t.rlike(rules.PII), "FM-S3: PII"), F.when(F.length(t) > 10000, "FM-R5: long")))
    joined = F.array_join(events, " ")
    sev = F.when(joined.contains("FM-S") | joined.contains("drop"), "BLOCK").when(joined.contains("FM-") | joined.contains("warn"), "WARN").when(joined != "", "INFO").otherwise("PASS")
    return table(spark, d, "documents").select(sev.alias("severity")).groupBy("severity").agg(F.count("*").alias("events"))


# ---- reply parsers, over the logged answers and the lines of documents
@q("parse_score", f"SELECT query_id, least(1,greatest(0,coalesce(try_cast(regexp_extract(answer,'([01](?:\\.\\d+)?|\\.\\d+)',1) AS DOUBLE),0.5))) AS score FROM {LOG}")
def parse_score_q(spark, d):
    return log(spark, d).select("query_id", parse_score(F.col("answer"), 0.5).alias("score"))


LINES = "(SELECT doc_id, unnest(string_split(text,chr(10))) AS line, generate_subscripts(string_split(text,chr(10)),1)-1 AS line_no FROM documents WHERE text IS NOT NULL)"


def _lines(spark, d):
    return table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


@q("parse_numbered_list", f"SELECT doc_id, line_no, item FROM (SELECT doc_id, line_no, regexp_replace(line,'^[0-9.\\-) ]+','') AS item, line FROM {LINES}) WHERE regexp_matches(line,'^[0-9.\\-) ]+[^ ]') AND item<>''")
def parse_numbered_list(spark, d):
    return _lines(spark, d).where(F.col("line").rlike(r"^[0-9.\-) ]+[^ ]")).select("doc_id", "line_no", numbered_item(F.col("line")).alias("item")).where("item <> ''")


KVP = "^([A-Za-z][A-Za-z ]{0,30}):\\s*(.*)$"


@q("parse_kv", f"SELECT doc_id, k, arg_max(v, line_no) AS v FROM (SELECT doc_id, line_no, replace(lower(regexp_extract(line,'{KVP}',1)),' ','_') AS k, {STRIP.format(f"regexp_extract(line,'{KVP}',2)")} AS v FROM {LINES} WHERE regexp_matches(line,'{KVP}')) WHERE lower(v) NOT IN ('','n/a','none','unknown','not found') GROUP BY ALL")
def parse_kv(spark, d):
    l = _lines(spark, d).where(F.col("line").rlike(KVP))
    v = F.regexp_replace(F.regexp_extract("line", KVP, 2), r"^\s+|\s+$", "")
    l = l.select("doc_id", "line_no", F.replace(F.lower(F.regexp_extract("line", KVP, 1)), F.lit(" "), F.lit("_")).alias("k"), v.alias("v"))
    return l.where(~F.lower("v").isin("", "n/a", "none", "unknown", "not found")).groupBy("doc_id", "k").agg(F.max_by("v", "line_no").alias("v"))


@q("parse_prefix", f"SELECT doc_id, arg_max({STRIP.format("substr(line,9)")}, line_no) AS subject FROM {LINES} WHERE starts_with(line,'Subject:') GROUP BY 1")
def parse_prefix(spark, d):
    l = _lines(spark, d).where(F.col("line").startswith("Subject:"))
    return l.groupBy("doc_id").agg(F.max_by(F.regexp_replace(F.substring("line", 9, 1000000), r"^\s+|\s+$", ""), F.col("line_no")).alias("subject"))


@q("chain_of_thought_steps", f"SELECT doc_id, count(*) AS steps FROM {LINES} WHERE regexp_matches(line,'^(Step|1\\.|2\\.|3\\.|-)') GROUP BY 1")
def chain_of_thought_steps(spark, d):
    return _lines(spark, d).where(F.col("line").rlike(r"^(Step|1\.|2\.|3\.|-)")).groupBy("doc_id").agg(F.count("*").alias("steps"))


# ---- validation and skills: purchase orders as extracted invoice fields
PO = "(SELECT DISTINCT po_id, vendor, order_date, delivery_date, total FROM purchase_orders)"


def _po(spark, d):
    return table(spark, d, "purchase_orders").select("po_id", "vendor", "order_date", "delivery_date", "total").distinct()


def _bad(i, cond, kind, field, sev):
    return f"SELECT po_id, {i} AS rule_no, '{kind}' AS kind, '{field}' AS field, '{sev}' AS severity FROM {PO} WHERE {cond}"


PRES = f"lower({STRIP.format("coalesce({},'')")}) NOT IN ('','n/a','none','unknown')"
VIOL = " UNION ALL ".join([_bad(0, f"NOT {PRES.format('vendor')}", "required", "vendor_name", "error"), _bad(1, f"NOT {PRES.format('total')}", "required", "total_amount", "error"), _bad(2, f"NOT {PRES.format('order_date')}", "required", "invoice_date", "error"), _bad(3, f"{PRES.format('order_date')} AND NOT regexp_matches(order_date,{lit(rules.DATE)})", "regex", "invoice_date", "error"), _bad(4, f"{PRES.format('total')} AND NOT regexp_matches(total,{lit(rules.AMOUNT)})", "regex", "total_amount", "warning"), _bad(5, f"{PRES.format('delivery_date')} AND regexp_replace(coalesce(order_date,''),'\\s+','','g')=''", "cross_field", "due_date", "warning")])
FIELDS = {"vendor_name": "vendor", "total_amount": "total", "invoice_date": "order_date", "due_date": "delivery_date"}


@q("validate_fields", VIOL)
def validate_fields(spark, d):
    return rules.violations(_po(spark, d), "po_id", FIELDS)


@q("validation_report", f"SELECT po_id, coalesce(e,0)=0 AS valid, coalesce(e,0) AS errors, coalesce(w,0) AS warnings FROM (SELECT DISTINCT po_id FROM purchase_orders) LEFT JOIN (SELECT po_id, count_if(severity='error') AS e, count_if(severity='warning') AS w FROM ({VIOL}) GROUP BY 1) USING (po_id)")
def validation_report(spark, d):
    v = rules.violations(_po(spark, d), "po_id", FIELDS).groupBy("po_id").agg(F.sum((F.col("severity") == "error").cast("int")).alias("e"), F.sum((F.col("severity") == "warning").cast("int")).alias("w"))
    x = _po(spark, d).select("po_id").distinct().join(v, "po_id", "left")
    return x.select("po_id", (F.coalesce("e", F.lit(0)) == 0).alias("valid"), F.coalesce("e", F.lit(0)).alias("errors"), F.coalesce("w", F.lit(0)).alias("warnings"))


SKILL = ["vendor", "buyer", "order_date", "total", "currency"]
SKILL_N = "+".join(f"({PRES.format(c)})::INT" for c in SKILL)


@q("skill_confidence", f"SELECT po_id, {SKILL_N} AS found, round(0.60+0.30*({SKILL_N})/5,4) AS confidence, 5-({SKILL_N}) AS missing FROM (SELECT DISTINCT po_id, {','.join(SKILL)} FROM purchase_orders)")
def skill_confidence(spark, d):
    po = table(spark, d, "purchase_orders").select("po_id", *SKILL).distinct()
    n = sum((rules.present(F.col(c)).cast("int") for c in SKILL[1:]), rules.present(F.col(SKILL[0])).cast("int"))
    return po.select("po_id", n.alias("found"), F.round(0.60 + 0.30 * n / 5, 4).alias("confidence"), (5 - n).alias("missing"))


@q("idp_batch_report", f"SELECT collection, count(*) AS files, count_if(chars>0) AS succeeded, count_if(chars=0) AS failed, sum(pages) AS pages, sum(chunks) AS chunks FROM (SELECT collection, doc_id, count(*) AS pages, sum(length(text)) AS chars, sum(CASE WHEN length(text)>0 THEN (length(text)+349)//350 ELSE 0 END) AS chunks FROM {PAGES} GROUP BY ALL) GROUP BY 1")
def idp_batch_report(spark, d):
    n = F.length("text")
    per = _pages(spark, d).groupBy("collection", "doc_id").agg(F.count("*").alias("pages"), F.sum(n).alias("chars"), F.sum(F.when(n > 0, F.floor((n + 349) / 350)).otherwise(0)).alias("chunks"))
    return per.groupBy("collection").agg(F.count("*").alias("files"), F.sum((F.col("chars") > 0).cast("int")).alias("succeeded"), F.sum((F.col("chars") == 0).cast("int")).alias("failed"), F.sum("pages").alias("pages"), F.sum("chunks").alias("chunks"))


# ---- evaluation: shares of common words as the default judge
def _ov(a, b):
    return f"CASE WHEN {b} IS NOT NULL AND len(list_distinct(list_filter(string_split_regex(lower({a}),'\\s+'),lambda x: x<>'')))>0 THEN len(list_intersect(list_distinct(list_filter(string_split_regex(lower({a}),'\\s+'),lambda x: x<>'')),list_distinct(list_filter(string_split_regex(lower({b}),'\\s+'),lambda x: x<>''))))::DOUBLE/len(list_distinct(list_filter(string_split_regex(lower({a}),'\\s+'),lambda x: x<>''))) END"


def _share(a, b):
    w = F.array_distinct(tokens(F.col(a)))
    return F.when(F.size(w) > 0, F.size(F.array_intersect(w, tokens(F.col(b)))) / F.size(w))


RAGAS = f"SELECT query_id, spec, coalesce(faithfulness,0.5) AS faithfulness, coalesce({_ov('query', 'answer')},0.5) AS relevancy, coalesce({_ov('answer', 'ground_truth')},0.5) AS prec, coalesce({_ov('ground_truth', 'answer')},0.5) AS rec FROM {LOG}"


def _ragas(spark, d):
    h = F.lit(0.5)
    return log(spark, d).select("query_id", "spec", F.coalesce("faithfulness", h).alias("faithfulness"), F.coalesce(_share("query", "answer"), h).alias("relevancy"), F.coalesce(_share("answer", "ground_truth"), h).alias("prec"), F.coalesce(_share("ground_truth", "answer"), h).alias("rec"))


@q("ragas_scores", f"SELECT query_id, round(faithfulness,6) AS faithfulness, round(relevancy,6) AS relevancy, round(prec,6) AS context_precision, round(rec,6) AS context_recall FROM ({RAGAS})")
def ragas_scores(spark, d):
    r = lambda c: F.round(c, 6)
    return _ragas(spark, d).select("query_id", r("faithfulness").alias("faithfulness"), r("relevancy").alias("relevancy"), r("prec").alias("context_precision"), r("rec").alias("context_recall"))


MARKS = {"faithfulness": 0.80, "relevancy": 0.75, "prec": 0.70, "rec": 0.70}


@q("eval_verdict", " UNION ALL ".join(f"SELECT spec, '{k}' AS metric, count_if({k}>={v}) AS passed, count(*) AS runs FROM ({RAGAS}) GROUP BY spec" for k, v in MARKS.items()))
def eval_verdict(spark, d):
    r = _ragas(spark, d)
    long = r.select("spec", F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), (F.col(k) >= v).alias("ok")) for k, v in MARKS.items()])).alias("m"))
    return long.groupBy("spec", F.col("m.metric").alias("metric")).agg(F.sum(F.col("m.ok").cast("int")).alias("passed"), F.count("*").alias("runs"))


@q("compare_specs", f"SELECT a.spec AS spec_a, b.spec AS spec_b, round(a.f,6) AS f_a, round(b.f,6) AS f_b, CASE WHEN round(a.f,9)>=round(b.f,9) THEN a.spec ELSE b.spec END AS winner FROM (SELECT spec, avg(faithfulness) AS f FROM ({RAGAS}) GROUP BY 1) a JOIN (SELECT spec, avg(faithfulness) AS f FROM ({RAGAS}) GROUP BY 1) b ON a.spec<b.spec")
def compare_specs(spark, d):
    s = _ragas(spark, d).groupBy("spec").agg(F.avg("faithfulness").alias("f"))  # one row a specification
    a, b = s.select(F.col("spec").alias("spec_a"), F.col("f").alias("fa")), s.select(F.col("spec").alias("spec_b"), F.col("f").alias("fb"))
    j = a.join(F.broadcast(b), F.col("spec_a") < F.col("spec_b"))
    return j.select("spec_a", "spec_b", F.round("fa", 6).alias("f_a"), F.round("fb", 6).alias("f_b"), F.when(F.round("fa", 9) >= F.round("fb", 9), F.col("spec_a")).otherwise(F.col("spec_b")).alias("winner"))


# ---- conversations: one session is a tenant's questions to a collection on one day
SESS = f"(SELECT *, coalesce(tenant_id,'')||'/'||coalesce(collection_name,'')||'/'||strftime(asked_at,'%Y-%m') AS session FROM {LOG})"


def _sessions(spark, d):
    return log(spark, d).withColumn("session", F.concat_ws("/", F.coalesce("tenant_id", F.lit("")), F.coalesce("collection_name", F.lit("")), F.date_format("asked_at", "yyyy-MM")))


@q("multiturn_last6", f"SELECT query_id, session, count(*) OVER w AS turns, coalesce(sum(length(query)) OVER w,0) AS history_chars, min(query_id) OVER w AS any_first FROM {SESS} WINDOW w AS (PARTITION BY session ORDER BY asked_at, query_id ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)")
def multiturn_last6(spark, d):
    """The six turns before each question of a session, which is shared among tasks by day."""
    r = memory.recent(_sessions(spark, d), "session", ["asked_at", "query_id"], F.struct("query_id", F.length("query").alias("n")), 6, F.to_date("asked_at"))
    chars = F.aggregate("recent", F.lit(0), lambda a, x: a + F.coalesce(x["n"], F.lit(0)))
    return r.select("query_id", "session", F.size("recent").alias("turns"), chars.alias("history_chars"), F.array_min(F.transform("recent", lambda x: x["query_id"])).alias("any_first"))


@q("short_term_memory", f"SELECT query_id, md5(coalesce(string_agg(substr(query,1,80),'|') OVER w,'')) AS memory_md5 FROM {SESS} WINDOW w AS (PARTITION BY session ORDER BY asked_at, query_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)")
def short_term_memory(spark, d):
    r = memory.recent(_sessions(spark, d), "session", ["asked_at", "query_id"], F.substring("query", 1, 80), 5, F.to_date("asked_at"))
    return r.select("query_id", F.md5(F.array_join("recent", "|")).alias("memory_md5"))


LW = f"(SELECT DISTINCT query_id, coalesce(tenant_id,'') AS t, asked_at::DATE AS day, unnest(list_filter(string_split_regex(lower(query),'\\s+'),lambda x: length(x)>4)) AS w FROM {LOG})"


@q("long_term_hits", f"WITH x AS {LW}, c AS (SELECT t, w, day, count(*) AS n FROM x GROUP BY ALL), p AS (SELECT t, w, day, sum(n) OVER (PARTITION BY t, w ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c) SELECT query_id, max(coalesce(before,0)) AS best_hits, count_if(coalesce(before,0)>0) AS known_words FROM x JOIN p USING (t,w,day) GROUP BY 1")
def long_term_hits(spark, d):
    """Per question, how many remembered questions of earlier days share its best known long word.

    Counts per (tenant, word, day) come first, so the running sums see days, not questions.
    """
    x = log(spark, d).select("query_id", F.coalesce("tenant_id", F.lit("")).alias("t"), F.to_date("asked_at").alias("day"), F.explode(F.filter(tokens(F.col("query")), lambda w: F.length(w) > 4)).alias("w")).distinct()
    c = x.groupBy("t", "w", "day").agg(F.count("*").alias("n"))
    p = c.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("t", "w").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return x.join(p, ["t", "w", "day"]).groupBy("query_id").agg(F.max("before").alias("best_hits"), F.sum((F.col("before") > 0).cast("int")).alias("known_words"))


LEVELS = " UNION ALL ".join([f"SELECT query_id, 0 AS depth, 0 AS node, length(query) AS n FROM {LOG}", f"SELECT query_id, 1, i, length(p) FROM (SELECT query_id, unnest(string_split(query,' and ')) AS p, generate_subscripts(string_split(query,' and '),1)-1 AS i FROM {LOG}) WHERE i<3", f"SELECT query_id, 2, i*10+j, length(p2) FROM (SELECT query_id, i, unnest(string_split(p,' or ')) AS p2, generate_subscripts(string_split(p,' or '),1)-1 AS j FROM (SELECT query_id, unnest(string_split(query,' and ')) AS p, generate_subscripts(string_split(query,' and '),1)-1 AS i FROM {LOG}) WHERE i<3) WHERE j<3"])


@q("recursive_levels", LEVELS)
def recursive_levels(spark, d):
    """Decomposition tree of each question to depth 2, at most three children a node (the default provider splits at and / or)."""
    l0 = log(spark, d).where(F.col("query").isNotNull())
    l1 = l0.select("query_id", F.posexplode(F.split("query", " and ")).alias("i", "p")).where("i < 3")
    l2 = l1.select("query_id", "i", F.posexplode(F.split("p", " or ")).alias("j", "p2")).where("j < 3")
    a = l0.select("query_id", F.lit(0).alias("depth"), F.lit(0).alias("node"), F.length("query").alias("n"))
    b = l1.select("query_id", F.lit(1).alias("depth"), F.col("i").alias("node"), F.length("p").alias("n"))
    return a.unionByName(b).unionByName(l2.select("query_id", F.lit(2).alias("depth"), (F.col("i") * 10 + F.col("j")).alias("node"), F.length("p2").alias("n")))
