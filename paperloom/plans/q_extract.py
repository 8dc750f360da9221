"""Entity, document extraction and layout queries with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from paperloom.operators import documents as doc
from paperloom.operators import entities as ent
from paperloom.session import table

Q: dict[str, tuple] = {}


def q(name: str, sql: str | None = None):
    def put(f):
        Q[name] = (f, sql)
        return f

    return put


def lit(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


STRIP = "regexp_replace({},'^\\s+|\\s+$','','g')"
PG = "(SELECT DISTINCT page_id, text FROM extracted_pages WHERE text IS NOT NULL)"


def pages(spark, d):
    return table(spark, d, "extracted_pages").where(F.col("text").isNotNull()).select("page_id", "text").distinct()


def _all(pattern: str) -> str:
    return f"(SELECT page_id, unnest(regexp_extract_all(text,{lit(pattern)},0)) AS raw, generate_subscripts(regexp_extract_all(text,{lit(pattern)},0),1)-1 AS ordinal FROM {PG})"


def _found(spark, d, pattern: str):
    return pages(spark, d).select("page_id", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("ordinal", "raw"))


@q("ner_emails", f"SELECT page_id, ordinal, lower(raw) AS normalized FROM {_all(ent.EMAIL)}")
def ner_emails(spark, d):
    return _found(spark, d, ent.EMAIL).select("page_id", "ordinal", F.lower("raw").alias("normalized"))


@q("ner_email_offsets", f"SELECT page_id, count(*) AS n, sum(length(raw)) AS chars FROM {_all(ent.EMAIL)} GROUP BY 1")
def ner_email_offsets(spark, d):
    """Offsets without Python; each match is cut out of the text again by its offset."""
    m = pages(spark, d).select("page_id", "text", F.explode(ent.matches(F.col("text"), ent.EMAIL)).alias("m"))
    m = m.where(F.substr("text", F.col("m.start") + 1, F.length("m.raw")) == F.col("m.raw"))
    return m.groupBy("page_id").agg(F.count("*").alias("n"), F.sum(F.length("m.raw")).alias("chars"))


ISO = r"\b(\d{4})[/\-.](\d{1,2})[/\-.](\d{1,2})\b"


@q("ner_dates", f"SELECT ner_id, ordinal, y||'-'||lpad(mo,2,'0')||'-'||lpad(da,2,'0') AS normalized FROM (SELECT ner_id, ordinal, regexp_extract(raw,{lit(ISO)},1) AS y, regexp_extract(raw,{lit(ISO)},2) AS mo, regexp_extract(raw,{lit(ISO)},3) AS da FROM (SELECT ner_id, unnest(regexp_extract_all(text,{lit(ISO)},0)) AS raw, generate_subscripts(regexp_extract_all(text,{lit(ISO)},0),1)-1 AS ordinal FROM (SELECT DISTINCT ner_id, text FROM ner_results))) WHERE mo::INT BETWEEN 1 AND 12 AND da::INT BETWEEN 1 AND 31 AND y::INT BETWEEN 1900 AND 2100")
def ner_dates(spark, d):
    n = table(spark, d, "ner_results").select("ner_id", "text").distinct().select("ner_id", F.posexplode(F.regexp_extract_all("text", F.lit(ISO), F.lit(0))).alias("ordinal", "raw"))
    g = lambda i: F.regexp_extract("raw", ISO, i)
    ok = g(2).cast("int").between(1, 12) & g(3).cast("int").between(1, 31) & g(1).cast("int").between(1900, 2100)
    return n.where(ok).select("ner_id", "ordinal", F.concat_ws("-", g(1), F.lpad(g(2), 2, "0"), F.lpad(g(3), 2, "0")).alias("normalized"))


AMT = r"[$€£] ?(\d{1,3}(?:,\d{3})+(?:\.\d{1,4})?|\d+(?:\.\d{1,4})?)"


@q("ner_amounts", f"SELECT page_id, count(*) AS amounts, sum(replace(regexp_extract(raw,{lit(AMT)},1),',','')::DECIMAL(18,4))::DOUBLE AS total FROM {_all(AMT)} GROUP BY 1")
def ner_amounts(spark, d):
    v = F.replace(F.regexp_extract("raw", AMT, 1), F.lit(","), F.lit("")).cast("decimal(18,4)")
    return _found(spark, d, AMT).groupBy("page_id").agg(F.count("*").alias("amounts"), F.sum(v).cast("double").alias("total"))


@q("ner_stored_by_type", "SELECT entity_type, count(*) AS entities, count(normalized) AS normalized, round(avg(confidence),6) AS confidence FROM (SELECT DISTINCT e.entity_id, e.entity_type, e.normalized, e.confidence FROM (SELECT unnest(entities) AS e FROM ner_results)) GROUP BY 1")
def ner_stored_by_type(spark, d):
    e = table(spark, d, "ner_results").select(F.explode("entities").alias("e")).select("e.entity_id", "e.entity_type", "e.normalized", "e.confidence").distinct()
    return e.groupBy("entity_type").agg(F.count("*").alias("entities"), F.count("normalized").alias("normalized"), F.round(F.avg("confidence"), 6).alias("confidence"))


@q("ner_cascade")
def ner_cascade(spark, d):
    # a page that was delivered twice gives the same rows twice; the rows are smaller than the texts
    return ent.entity_rows(table(spark, d, "extracted_pages"), "page_id").distinct()


@q("ner_annotated")
def ner_annotated(spark, d):
    """Counts of entity types per page, as the annotated text would show them."""
    return ner_cascade(spark, d).groupBy("page_id", "entity_type").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("normalized")).alias("values"))


# ---- invoices and forms
@q("invoice_fields", " UNION ALL ".join(f"SELECT doc_id, '{k}' AS field_type, {STRIP.format(f'regexp_extract(text,{lit(p)},1)')} AS value FROM documents WHERE regexp_extract(text,{lit(p)},1)<>''" for k, p in doc.INVOICE.items()))
def invoice_fields(spark, d):
    return doc.invoice_fields(table(spark, d, "documents"), "doc_id")


@q("invoice_vendor", f"SELECT doc_id, list_filter(list_transform(string_split(text,chr(10))[1:8],lambda x: {STRIP.format('x')}),lambda x: x<>'' AND NOT regexp_matches(x,{lit(doc.INVOICE['INVOICE_ID'])}))[1] AS vendor FROM documents WHERE text IS NOT NULL")
def invoice_vendor(spark, d):
    return table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", doc.vendor(F.col("text")).alias("vendor"))


@q("invoice_line_items", f"SELECT page_id, line_no, {STRIP.format(f'regexp_extract(l,{lit(doc.LINE_ITEM)},1)')} AS item, regexp_extract(l,{lit(doc.LINE_ITEM)},2) AS qty, regexp_extract(l,{lit(doc.LINE_ITEM)},3) AS unit, regexp_extract(l,{lit(doc.LINE_ITEM)},4) AS total FROM (SELECT page_id, unnest(string_split(text,chr(10))) AS l, generate_subscripts(string_split(text,chr(10)),1)-1 AS line_no FROM {PG}) WHERE regexp_matches(l,{lit(doc.LINE_ITEM)})")
def invoice_line_items(spark, d):
    return doc.line_items(pages(spark, d), "page_id")


RICH = "(SELECT DISTINCT page_id, rich_text AS t FROM extracted_pages WHERE rich_text IS NOT NULL)"


@q("forms_kv", f"SELECT page_id, k, arg_min(v,n) AS v FROM (SELECT page_id, n, lower({STRIP.format(f'regexp_extract(l,{lit(doc.KEY_VALUE)},1)')}) AS k, {STRIP.format(f'regexp_extract(l,{lit(doc.KEY_VALUE)},2)')} AS v FROM (SELECT page_id, unnest(string_split(t,chr(10))) AS l, generate_subscripts(string_split(t,chr(10)),1)-1 AS n FROM {RICH}) WHERE regexp_matches(l,{lit(doc.KEY_VALUE)})) WHERE v<>'' GROUP BY ALL")
def forms_kv(spark, d):
    p = table(spark, d, "extracted_pages").where(F.col("rich_text").isNotNull()).select("page_id", "rich_text").distinct()
    return doc.key_values(p, "page_id", "rich_text")


@q("mrz_td3", "SELECT c_custkey, 'UTO' AS issuing_country, upper(split_part(c_name,'#',1)) AS last_name, lpad(c_custkey::VARCHAR,9,'0') AS document_number, lpad(c_nationkey::VARCHAR,2,'0') AS sex_or_code FROM customer")
def mrz_td3(spark, d):
    """Passport lines made from customers, and parsed again."""
    c = table(spark, d, "customer")
    name = F.upper(F.substring_index("c_name", "#", 1))
    l1 = F.rpad(F.concat(F.lit("P<UTO"), F.translate(name, " ", "<"), F.lit("<<ANNA<MARIA")), 44, "<")
    l2 = F.rpad(F.concat(F.lpad(F.col("c_custkey").cast("string"), 9, "0"), F.lit("0UTO7408122F"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.lit("0415")), 44, "<")
    f = doc.mrz(l1, l2)
    return c.select("c_custkey", f["issuing_country"].alias("issuing_country"), f["last_name"].alias("last_name"), f["document_number"].alias("document_number"), F.substring(f["expiry_date"], 9, 2).alias("sex_or_code"))


# ---- OCR responses made from orders and their lines, read back through the block graph
def _block(id_, kind, text=None, row=None, col=None, entity=None, rel=None, rel2=None):
    n = lambda t: F.lit(None).cast(t)
    rels = [F.struct(F.lit(k).alias("Type"), v.alias("Ids")) for k, v in (rel or {}).items()]
    return F.struct(id_.alias("Id"), F.lit(kind).alias("BlockType"), (text if text is not None else n("string")).alias("Text"), F.lit(99.0).alias("Confidence"), (row if row is not None else n("int")).alias("RowIndex"), (col if col is not None else n("int")).alias("ColumnIndex"), (F.array(F.lit(entity)) if entity else n("array<string>")).alias("EntityTypes"), (F.array(*rels) if rels else n("array<struct<Type:string,Ids:array<string>>>")).alias("Relationships"))


def table_responses(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_returnflag")  # the lines of one order
    l = table(spark, d, "lineitem").withColumn("ln", F.row_number().over(w)).select("l_orderkey", "ln", F.array(F.col("l_linenumber").cast("string"), F.col("l_returnflag"), F.col("l_partkey").cast("string")).alias("v"))
    c = l.select("l_orderkey", "ln", F.posexplode("v").alias("i", "t"))
    cell, word = F.format_string("c%d-%d", "ln", "i"), F.format_string("w%d-%d", "ln", "i")
    c = c.select("l_orderkey", cell.alias("cell"), F.array(_block(cell, "CELL", row=F.col("ln"), col=(F.col("i") + 1).cast("int"), rel={"CHILD": F.array(word)}), _block(word, "WORD", text=F.col("t"))).alias("b"))
    g = c.groupBy("l_orderkey").agg(F.flatten(F.collect_list("b")).alias("b"), F.collect_list("cell").alias("cells"))  # an order is bounded
    return g.select("l_orderkey", F.to_json(F.array_append("b", _block(F.lit("t1"), "TABLE", rel={"CHILD": F.col("cells")}))).alias("body"))


CELLS = "(SELECT l_orderkey, row, unnest([1,2,3]) AS col, unnest([l_linenumber::VARCHAR,l_returnflag,l_partkey::VARCHAR]) AS text FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag) AS row FROM lineitem))"


@q("ocr_tables", f"SELECT l_orderkey, row, col, text FROM {CELLS}")
def ocr_tables(spark, d):
    return doc.response_cells(table_responses(spark, d), "l_orderkey", "body").select("l_orderkey", "row", "col", "text")


@q("table_markdown", f"SELECT l_orderkey, md5(string_agg(line,chr(10) ORDER BY row)) AS md5 FROM (SELECT l_orderkey, row, '| '||string_agg(text,' | ' ORDER BY col)||' |'||CASE WHEN row=1 THEN chr(10)||'| --- | --- | --- |' ELSE '' END AS line FROM {CELLS} GROUP BY l_orderkey, row) GROUP BY 1")
def table_markdown(spark, d):
    c = doc.response_cells(table_responses(spark, d), "l_orderkey", "body")
    return doc.markdown(c, ["l_orderkey", "table_id"]).select("l_orderkey", F.md5("markdown").alias("md5"))


@q("ocr_forms", "SELECT o_orderkey, unnest(['Order Status','Order Priority','Clerk']) AS k, unnest([o_orderstatus,o_orderpriority,'']) AS v FROM orders")
def ocr_forms(spark, d):
    """Keys of three words' worth of blocks; the last key has no value."""
    o = table(spark, d, "orders")
    pairs = [("Order Status", F.col("o_orderstatus")), ("Order Priority", F.col("o_orderpriority")), ("Clerk", None)]
    bs = []
    for i, (k, v) in enumerate(pairs):
        ws = k.split()
        ids = F.array(*[F.lit(f"k{i}w{j}") for j in range(len(ws))])
        rel = {"CHILD": ids} | ({"VALUE": F.array(F.lit(f"v{i}"))} if v is not None else {})
        bs.append(_block(F.lit(f"k{i}"), "KEY_VALUE_SET", entity="KEY", rel=rel))
        bs += [_block(F.lit(f"k{i}w{j}"), "WORD", text=F.lit(w)) for j, w in enumerate(ws)]
        if v is not None:
            bs += [_block(F.lit(f"v{i}"), "KEY_VALUE_SET", entity="VALUE", rel={"CHILD": F.array(F.lit(f"v{i}w"))}), _block(F.lit(f"v{i}w"), "WORD", text=v)]
    full = "struct<Id:string,BlockType:string,Text:string,Confidence:double,RowIndex:int,ColumnIndex:int,EntityTypes:array<string>,Relationships:array<struct<Type:string,Ids:array<string>>>>"
    body = o.select("o_orderkey", F.to_json(F.array(*[b.cast(full) for b in bs])).alias("body"))
    return doc.form_pairs(doc.blocks(body, "o_orderkey", "body"), "o_orderkey")


# ---- layout and splitting
TB = "(SELECT DISTINCT block_id, page_id, text, box_left::DOUBLE AS l, box_top::DOUBLE AS t, box_width::DOUBLE AS w, box_height::DOUBLE AS h FROM text_blocks)"
FEAT = f"SELECT page_id, count(*) AS n, avg(regexp_matches(text,':\\s*$')::INT) AS colon_ratio, sum(regexp_matches(text,':\\s*$')::INT) AS colons, avg(regexp_matches(text,'^[$€£]?[\\d.,%-]+$')::INT) AS num_ratio, stddev_pop(l) AS left_std, avg(w) AS mean_width, stddev_pop(h) AS height_std, avg(h) AS mean_height, count(DISTINCT round_even(t*100,0)) AS rows, max(l+w)-min(l) AS x_extent, max(t+h)-min(t) AS y_extent FROM {TB} GROUP BY 1"


def boxes(spark, d):
    c = lambda n: F.col(f"box_{n}").cast("double").alias(n)
    return table(spark, d, "text_blocks").select("block_id", "page_id", "text", c("left"), c("top"), c("width"), c("height")).distinct()


@q("layout_features", f"SELECT page_id, n, round(colon_ratio,6) AS colon_ratio, round(num_ratio,6) AS num_ratio, round(left_std,6) AS left_std, round(mean_width,6) AS mean_width, round(mean_height,6) AS mean_height, rows, round(x_extent,6) AS x_extent, round(y_extent,6) AS y_extent FROM ({FEAT})")
def layout_features(spark, d):
    f = doc.layout_features(boxes(spark, d), "page_id")
    r = lambda c: F.round(c, 6).alias(c)
    return f.select("page_id", "n", r("colon_ratio"), r("num_ratio"), r("left_std"), r("mean_width"), r("mean_height"), "rows", r("x_extent"), r("y_extent"))


@q("dbscan_columns", f"""WITH p AS (SELECT page_id, round(l,3) AS x, count(*) AS n FROM {TB} GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY page_id ORDER BY x RANGE BETWEEN 0.0021 PRECEDING AND 0.0021 FOLLOWING)>=4 AS core FROM p),
 s AS (SELECT *, last_value(CASE WHEN core THEN x END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lc FROM c), k AS (SELECT *, sum(CASE WHEN core AND (lc IS NULL OR x-lc>0.0021) THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY x)-1 AS cl FROM s),
 e AS (SELECT k.page_id, k.x, k.n, k.core, k.cl, (SELECT arg_min(j.cl, abs(j.x-k.x)*1e6+CASE WHEN j.x>k.x THEN 1e-3 ELSE 0 END) FROM k j WHERE j.page_id=k.page_id AND j.core AND abs(j.x-k.x)<=0.0021) AS near FROM k)
 SELECT page_id, x, n, CASE WHEN core THEN cl ELSE coalesce(near,-1) END AS cluster FROM e""")
def dbscan_columns(spark, d):
    return doc.dbscan_1d(boxes(spark, d).select("page_id", F.round("left", 3).alias("x")), "page_id", "x", 0.0021, 4)


SEG = """WITH p AS (SELECT file_name, page_num, max(char_count) AS chars, max(is_scanned::INT) AS kind FROM extracted_pages GROUP BY ALL), l AS (SELECT *, lag(chars) OVER w AS pc, lag(kind) OVER w AS pk FROM p WINDOW w AS (PARTITION BY file_name ORDER BY page_num)),
 s AS (SELECT *, sum(CASE WHEN pc IS NOT NULL AND (chars<20 OR pc<20 OR (kind<>pk AND (chars::DOUBLE/greatest(pc,1)<0.25 OR chars::DOUBLE/greatest(pc,1)>4))) THEN 1 ELSE 0 END) OVER (PARTITION BY file_name ORDER BY page_num) AS seg FROM l),
 g AS (SELECT file_name, seg, min(page_num) AS page_start, max(page_num) AS page_end, count(*) AS pages, bool_and(chars<20) AS blank FROM s GROUP BY ALL)"""


def _split(spark, d, least):
    p = table(spark, d, "extracted_pages").groupBy("file_name", "page_num").agg(F.max("char_count").alias("chars"), F.max(F.col("is_scanned").cast("int")).alias("kind"))
    return doc.split_segments(p, "file_name", least)


@q("split_segments", SEG + " SELECT file_name, row_number() OVER (PARTITION BY file_name ORDER BY seg)-1 AS segment, page_start, page_end, pages, blank FROM g")
def split_segments(spark, d):
    return _split(spark, d, 1)


@q("merge_short_segments", SEG + ", k AS (SELECT *, sum(CASE WHEN pages>=2 OR rn=1 THEN 1 ELSE 0 END) OVER (PARTITION BY file_name ORDER BY seg) AS grp FROM (SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY seg) AS rn FROM g)) SELECT file_name, row_number() OVER (PARTITION BY file_name ORDER BY grp)-1 AS segment, min(page_start) AS page_start, max(page_end) AS page_end, sum(pages) AS pages, bool_and(blank) AS blank FROM k GROUP BY file_name, grp")
def merge_short_segments(spark, d):
    return _split(spark, d, 2)
