"""Structured extraction: OCR response JSON, tables, forms, invoice fields, machine-readable zones, layout, splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.session import cut

# Patterns of invoice fields and line items.
DATE = r"\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}|\d{4}[/\-.]\d{2}[/\-.]\d{2}|[A-Za-z]+\s+\d{1,2},?\s*\d{4}"
INVOICE = {
    "INVOICE_RECEIPT_DATE": rf"(?i)invoice\s*date\s*[:\-]?\s*({DATE})",
    "DUE_DATE": rf"(?i)due\s*(?:date|by)\s*[:\-]?\s*({DATE})",
    "TOTAL": r"(?i)(?:total\s*(?:due|amount|:)?|amount\s*due)\s*[:\-]?\s*([$£€]?\s*[\d,]+\.?\d{0,2})",
    "SUBTOTAL": r"(?i)sub\s*total\s*[:\-]?\s*([$£€]?\s*[\d,]+\.?\d{0,2})",
    "TAX": r"(?i)(?:tax|vat|gst|hst)\s*[:\-]?\s*([$£€]?\s*[\d,]+\.?\d{0,2})",
    "PO_NUMBER": r"(?i)\bP\.?O\.?\s*(?:Number|No|#)?\s*[:\-]?\s*([A-Z0-9\-]{4,20})\b",
    "INVOICE_ID": r"(?i)\b(?:Invoice|Inv)\.?\s*(?:No|#|Number|Num)?\s*[:\-]?\s*([A-Z0-9\-]{3,20})\b",
    "PAYMENT_TERMS": r"(?i)\b(?:Net)\s*(\d{1,3})\b",
}
LINE_ITEM = r"(?i)(.{5,50}?)\s{2,}(\d+)\s+x?\s*([$£€]?[\d,]+\.?\d{0,2})\s*([$£€]?[\d,]+\.?\d{0,2})"
KEY_VALUE = r"^([A-Za-z0-9_ \-/().]{2,40}?)\s*[:–\-]\s*(.*)$"


def invoice_fields(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, field_type, value): first match of each pattern."""
    cols = [F.when(F.regexp_extract(text, p, 1) != "", F.struct(F.lit(k).alias("field_type"), F.regexp_replace(F.regexp_extract(text, p, 1), r"^\s+|\s+$", "").alias("value"))) for k, p in INVOICE.items()]
    return df.where(F.col(text).isNotNull()).select(key, F.explode(F.array_compact(F.array(*cols))).alias("f")).select(key, "f.*")


def vendor(text: Column) -> Column:
    """The first non-empty of the first eight lines that names no invoice number."""
    lines = F.transform(F.slice(F.split(text, "\n"), 1, 8), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.get(F.filter(lines, lambda x: (x != "") & ~x.rlike(INVOICE["INVOICE_ID"])), F.lit(0))


def line_items(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line_no, item, qty, unit, total) of lines that look like items."""
    lines = df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "l")).where(F.col("l").rlike(LINE_ITEM))
    g = lambda i: F.regexp_extract("l", LINE_ITEM, i)
    return lines.select(key, "line_no", F.regexp_replace(g(1), r"^\s+|\s+$", "").alias("item"), g(2).alias("qty"), g(3).alias("unit"), g(4).alias("total"))


def key_values(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, k, v): key and value lines, the first non-empty value of each key (in any case) winning."""
    l = df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("n", "l")).where(F.col("l").rlike(KEY_VALUE))
    s = lambda i: F.regexp_replace(F.regexp_extract("l", KEY_VALUE, i), r"^\s+|\s+$", "")
    kv = l.select(key, "n", F.lower(s(1)).alias("k"), s(2).alias("v")).where("v <> ''")
    return kv.groupBy(key, "k").agg(F.min_by("v", "n").alias("v"))


def mrz(line1: Column, line2: Column) -> dict[str, Column]:
    """Fields of the two 44-character lines of a passport."""
    names = F.substring(line1, 6, 39)
    clean = lambda c: F.trim(F.translate(c, "<", " "))
    at = lambda i, n: F.substring(line2, i, n)
    return {
        "issuing_country": F.translate(F.substring(line1, 3, 3), "<", ""),
        "last_name": clean(F.substring_index(names, "<<", 1)),
        "first_name": clean(F.when(F.instr(names, "<<") > 0, F.substr(names, F.instr(names, "<<") + 2)).otherwise("")),
        "document_number": F.translate(at(1, 9), "<", ""),
        "nationality": F.translate(at(11, 3), "<", ""),
        "date_of_birth": F.concat_ws("/", at(18, 2), at(16, 2), at(14, 2)),
        "sex": at(21, 1),
        "expiry_date": F.concat(at(26, 2), F.lit("/"), at(24, 2), F.lit("/20"), at(22, 2)),
    }


# ---- OCR response JSON: blocks with Id, BlockType, Text, Confidence, RowIndex, ColumnIndex, EntityTypes, Relationships
BLOCKS = "array<struct<Id:string,BlockType:string,Text:string,Confidence:double,RowIndex:int,ColumnIndex:int,EntityTypes:array<string>,Relationships:array<struct<Type:string,Ids:array<string>>>>>"


def blocks(df: DataFrame, key: str, body: str) -> DataFrame:
    """One row a block of the responses; written once, as several joins read it."""
    return cut(df.select(key, F.explode(F.from_json(body, BLOCKS)).alias("b")).select(key, F.col("b.Id").alias("block_id"), *[F.col(f"b.{c}") for c in ("BlockType", "Text", "Confidence", "RowIndex", "ColumnIndex", "EntityTypes", "Relationships")]))


def _edges(b: DataFrame, key: str, kind: str) -> DataFrame:
    r = b.select(key, F.col("block_id").alias("src"), F.explode("Relationships").alias("r")).where(F.col("r.Type") == kind)
    return r.select(key, "src", F.posexplode("r.Ids").alias("pos", "dst"))


def _texts(b: DataFrame, key: str) -> DataFrame:
    """(key, src, text): the words under each block, in order."""
    words = b.where("BlockType = 'WORD'").select(key, F.col("block_id").alias("dst"), "Text")
    return _edges(b, key, "CHILD").join(words, [key, "dst"]).groupBy(key, "src").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "Text"))), lambda x: x["Text"]), " ").alias("text"))


def _children(block: Column) -> Column:
    """Ids of the CHILD relationships of a block, in order."""
    ids = F.transform(F.filter(block["Relationships"], lambda r: r["Type"] == "CHILD"), lambda r: F.coalesce(r["Ids"], F.array().cast("array<string>")))
    return F.coalesce(F.flatten(ids), F.array().cast("array<string>"))


def _by_id(own: str, ids: str, value) -> Column:
    """Map from Id to value(block) of the blocks in column `own`; of several blocks with one Id the last wins."""
    n = F.size(own)
    last = F.filter(own, lambda b, i: F.array_position(F.reverse(ids), b["Id"]) == n - i)
    one = F.when(F.size(F.array_distinct(ids)) < n, last).otherwise(F.col(own))
    return F.map_from_entries(F.transform(one, lambda b: F.struct(b["Id"], value(b))))


def _cells(df: DataFrame, key: str, blocks: str) -> DataFrame:
    """table_cells of whole responses (key, array of blocks), each resolved inside its row: no join, so nothing is broadcast."""
    kind = lambda k: F.filter(blocks, lambda b: (b["BlockType"] == k) & b["Id"].isNotNull())
    ids = lambda c: F.transform(c, lambda b: b["Id"])
    # one select after the other, as what a lambda reads must be there as a column
    d = df.select(key, kind("TABLE").alias("_t"), kind("CELL").alias("_c"), kind("WORD").alias("_w"))
    d = d.select(key, "_t", "_c", "_w", ids("_c").alias("_ci"), ids("_w").alias("_wi"))
    d = d.select(key, "_t", _by_id("_c", "_ci", lambda b: F.struct(b["RowIndex"].alias("row"), b["ColumnIndex"].alias("col"), _children(b).alias("ids"))).alias("_c"), _by_id("_w", "_wi", lambda b: b["Text"]).alias("_w"))
    d = d.select(key, "_c", "_w", F.explode("_t").alias("_t"))
    text = lambda c: F.array_join(F.transform(c["ids"], lambda i: F.try_element_at("_w", i)), " ")
    found = F.filter(F.transform(_children(F.col("_t")), lambda i: F.try_element_at("_c", i)), lambda c: c.isNotNull())
    cells = F.transform(found, lambda c: F.struct(c["row"].alias("row"), c["col"].alias("col"), text(c).alias("text")))
    return d.select(key, F.col("_t.Id").alias("table_id"), F.explode(cells).alias("v")).select(key, "table_id", "v.*")


def table_cells(b: DataFrame, key: str) -> DataFrame:
    """(key, table_id, row, col, text) of all tables: table -> cells -> words by id, within one response (bounded by its key)."""
    block = F.struct(F.col("block_id").alias("Id"), *[F.col(c) for c in ("BlockType", "Text", "RowIndex", "ColumnIndex", "Relationships")])
    used = b.where(F.col(key).isNotNull() & F.col("BlockType").isin("TABLE", "CELL", "WORD"))
    return _cells(used.groupBy(key).agg(F.collect_list(block).alias("_b")), key, "_b")


def response_cells(df: DataFrame, key: str, body: str) -> DataFrame:
    """table_cells straight from the responses, a row each: nothing is written, shuffled or joined."""
    return _cells(df.select(key, F.from_json(body, BLOCKS).alias("_b")), key, "_b")


def form_pairs(b: DataFrame, key: str) -> DataFrame:
    """(key, k, v): form keys with their values; a missing value is empty."""
    keys = b.where("BlockType = 'KEY_VALUE_SET' and array_contains(EntityTypes, 'KEY')").select(key, F.col("block_id").alias("src"))
    t = _texts(b, key)
    values = _edges(b, key, "VALUE").join(t.withColumnRenamed("src", "dst").withColumnRenamed("text", "v"), [key, "dst"], "left").select(key, "src", "v")
    return keys.join(t, [key, "src"], "left").join(values, [key, "src"], "left").select(key, F.coalesce("text", F.lit("")).alias("k"), F.coalesce("v", F.lit("")).alias("v"))


def markdown(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, markdown) of cells (keys, row, col, text), rows and columns from 1; a rule follows the first row, the last text of a cell wins.

    No join with the tables' sizes: cells that lie by the first key already are not shuffled again.
    """
    one = cells.groupBy(*keys, "row", "col").agg(F.max("text").alias("text"))
    rows = one.groupBy(*keys, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("m"), F.max("col").alias("cols"))
    t = rows.groupBy(*keys).agg(F.collect_list(F.struct("row", "m")).alias("rows"), F.max("cols").alias("cols"))
    line = lambda m: F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(1), F.col("cols")), lambda c: F.coalesce(m[c], F.lit(""))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.col("cols")), " | "), F.lit(" |"))
    lines = F.transform("rows", lambda r: F.struct(r["row"].alias("row"), F.when(r["row"] == 1, F.concat(line(r["m"]), F.lit("\n"), rule)).otherwise(line(r["m"])).alias("line")))
    return t.select(*keys, F.array_join(F.transform(F.array_sort(lines), lambda x: x["line"]), "\n").alias("markdown"))


# ---- layout of pages given as text boxes
def layout_features(boxes: DataFrame, key: str) -> DataFrame:
    """Per page: numbers and shares that the layout rules use; boxes (key, text, left, top, width, height), unit square."""
    t = F.col("text")
    top = F.bround(F.col("top") * 100)
    return boxes.groupBy(key).agg(
        F.count("*").alias("n"), F.avg(t.rlike(r":\s*$").cast("int")).alias("colon_ratio"), F.sum(t.rlike(r":\s*$").cast("int")).alias("colons"), F.avg(t.rlike(r"^[$£€]?[\d.,%-]+$").cast("int")).alias("num_ratio"),
        F.stddev_pop("left").alias("left_std"), F.avg("width").alias("mean_width"), F.stddev_pop("height").alias("height_std"), F.avg("height").alias("mean_height"), F.countDistinct(top).alias("rows"),
        (F.max(F.col("left") + F.col("width")) - F.min("left")).alias("x_extent"), (F.max(F.col("top") + F.col("height")) - F.min("top")).alias("y_extent"))


def dbscan_1d(points: DataFrame, key: str, x: str, eps: float, least: int) -> DataFrame:
    """(key, x, n, cluster) for distinct coordinates with their counts: density clusters on a line, noise is -1.

    A core has at least `least` points within eps; cores at most eps apart share a cluster; a border point
    joins the cluster of the nearest core within eps, the left one on ties. Windows run within one key.
    """
    d = points.groupBy(key, F.col(x).alias("x")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(key).orderBy("x")
    span = F.expr(f"sum(n) over (partition by {key} order by x range between {eps}D preceding and {eps}D following)")
    d = d.withColumn("core", span >= least)
    last_core = F.last(F.when(F.col("core"), F.col("x")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("start", (F.col("core") & (last_core.isNull() | (F.col("x") - last_core > eps))).cast("int"))
    d = d.withColumn("c", F.sum("start").over(w) - 1)
    before = F.last(F.when(F.col("core"), F.struct("x", "c")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(F.when(F.col("core"), F.struct("x", "c")), ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    d = d.withColumn("b", before).withColumn("a", after)
    db, da = F.col("x") - F.col("b.x"), F.col("a.x") - F.col("x")
    near_b, near_a = F.coalesce(db <= eps, F.lit(False)), F.coalesce(da <= eps, F.lit(False))
    cluster = F.when(F.col("core"), F.col("c")).when(near_b & (~near_a | (db <= da)), F.col("b.c")).when(near_a, F.col("a.c")).otherwise(-1)
    return d.select(key, "x", "n", cluster.cast("int").alias("cluster"))


def with_previous(df: DataFrame, key: str, order: str, cols: list[str], width: int = 1000) -> DataFrame:
    """Adds _bucket and prev (struct of cols, null on the first row) of the row before in the order of one key.

    Windows see `width` values of the order at a time; what crosses a bucket comes from one row per bucket, so
    a key of any size is shared among tasks.
    """
    df = df.withColumn("_bucket", F.floor(F.col(order) / width))
    last = df.groupBy(key, "_bucket").agg(F.max_by(F.struct(*cols), order).alias("last"))
    before = last.select(key, "_bucket", F.lag("last").over(Window.partitionBy(key).orderBy("_bucket")).alias("before"))
    inside = df.withColumn("prev", F.lag(F.struct(*cols)).over(Window.partitionBy(key, "_bucket").orderBy(order)))
    return inside.join(before, [key, "_bucket"]).withColumn("prev", F.coalesce("prev", "before")).drop("before")


def running_sum(df: DataFrame, key: str, order: str, value: str, out: str) -> DataFrame:
    """Running sum within a key by the buckets of with_previous: sums of whole buckets before, plus the own bucket's."""
    total = df.groupBy(key, "_bucket").agg(F.sum(value).alias("_t"))
    before = total.select(key, "_bucket", F.coalesce(F.sum("_t").over(Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.sum(value).over(Window.partitionBy(key, "_bucket").orderBy(order))
    return df.withColumn(out, own).join(before, [key, "_bucket"]).withColumn(out, F.col(out) + F.col("_before")).drop("_before")


def split_segments(pages: DataFrame, key: str, least_pages: int = 1) -> DataFrame:
    """(key, segment, page_start, page_end, pages, blank) of pages (key, page_num, chars, kind).

    A boundary is before a page if it or the one before is blank (under 20 characters), or if kind and size
    both change (ratio of characters under 0.25 or over 4). Segments shorter than `least_pages` join the one before.
    Pages of one document are shared among tasks in buckets of a thousand page numbers; only the few segments
    of a document are ordered in one window.
    """
    s = with_previous(pages, key, "page_num", ["chars", "kind"])
    chars, kind = F.col("prev.chars"), F.col("prev.kind")
    blank = F.col("chars") < 20
    ratio = F.col("chars") / F.greatest(chars, F.lit(1))
    cutting = chars.isNotNull() & (blank | (chars < 20) | ((F.col("kind") != kind) & ((ratio < 0.25) | (ratio > 4))))
    s = running_sum(s.withColumn("cutting", F.coalesce(cutting, F.lit(False)).cast("int")), key, "page_num", "cutting", "seg")
    g = s.groupBy(key, "seg").agg(F.min("page_num").alias("page_start"), F.max("page_num").alias("page_end"), F.count("*").alias("pages"), F.min(blank).alias("blank"))
    if least_pages > 1:
        v = Window.partitionBy(key).orderBy("seg")
        keep = (F.col("pages") >= least_pages) | (F.row_number().over(v) == 1)
        g = g.withColumn("keep", keep.cast("int")).withColumn("seg", F.sum("keep").over(v))
        g = g.groupBy(key, "seg").agg(F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"), F.sum("pages").alias("pages"), F.min("blank").alias("blank"))
    return g.withColumn("segment", F.row_number().over(Window.partitionBy(key).orderBy("seg")) - 1).drop("seg")


# ---- words, reading order and tables without rules
def words_of_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Word boxes of text lines (keys, text, left, top, width, height): a word takes its share of the line by characters."""
    n = F.greatest(F.length("text"), F.lit(1))
    w = lines.where(F.length("text") > 0).select("*", F.posexplode(F.split("text", " ")).alias("_i", "word"))
    # characters in front of the word: those of the words before it and one blank each
    before = F.aggregate(F.slice(F.split("text", " "), F.lit(1), F.col("_i")), F.lit(0), lambda a, x: a + F.length(x) + 1)
    w = w.where(F.col("word") != "")
    left = F.col("left") + F.col("width") * before / n
    return w.select(*keys, "word", left.alias("left"), "top", (F.col("width") * F.length("word") / n).alias("width"), "height")


def reading_lines(words: DataFrame, key: str, tolerance: float = 0.6) -> DataFrame:
    """(key, line_no, text): words sorted by top join the current line while their top is within `tolerance` mean heights.

    A fold over the words of one page, which is bounded; each line is then read from left to right.
    """
    w = words.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("top", "left", "height", "word"))).alias("w"))
    line = "struct<n:int,last:double,heights:double,words:array<struct<left:double,word:string>>>"
    start = F.expr(f"cast(array() as array<{line}>)")

    def step(acc, x):
        cur = F.element_at(acc, -1)
        same = (F.size(acc) > 0) & (F.abs(x["top"] - F.when(F.size(acc) > 0, cur["last"])) <= tolerance * F.when(F.size(acc) > 0, cur["heights"] / cur["n"]))
        one = F.struct(x["left"].cast("double").alias("left"), x["word"].alias("word"))
        grown = F.struct((cur["n"] + 1).alias("n"), x["top"].cast("double").alias("last"), (cur["heights"] + x["height"]).cast("double").alias("heights"), F.array_append(cur["words"], one).alias("words"))
        fresh = F.struct(F.lit(1).alias("n"), x["top"].cast("double").alias("last"), x["height"].cast("double").alias("heights"), F.array(one).alias("words"))
        return F.when(F.coalesce(same, F.lit(False)), F.array_append(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), grown).cast(f"array<{line}>")).otherwise(F.array_append(acc, fresh).cast(f"array<{line}>"))

    lines = w.select(key, F.posexplode(F.aggregate("w", start, step)).alias("line_no", "l"))
    return lines.select(key, "line_no", F.array_join(F.transform(F.array_sort("l.words"), lambda x: x["word"]), " ").alias("text"))


def columns_of_tables(words: DataFrame, key: str, eps: float = 0.04, least: int = 2) -> DataFrame:
    """(key, column, centre, words): clusters of word centres on rows of at least three words, on pages with three such rows.

    Fewer than three columns are no table. Words are then given to the nearest centre by the caller.
    """
    centre = F.round(F.col("left") + F.col("width") / 2, 3)
    rows = words.withColumn("row", F.round(F.col("top"), 2)).withColumn("c", centre)
    full = rows.groupBy(key, "row").agg(F.count("*").alias("n")).where("n >= 3")
    pages = full.groupBy(key).agg(F.count("*").alias("rows")).where("rows >= 3").select(key)
    pts = rows.join(full.select(key, "row"), [key, "row"]).join(pages, key).select(key, "c")
    d = dbscan_1d(pts, key, "c", eps, least).where("cluster >= 0")
    cols = d.groupBy(key, F.col("cluster").alias("column")).agg(F.round(F.sum(F.col("x") * F.col("n")) / F.sum("n"), 4).alias("centre"), F.sum("n").alias("words"))
    many = cols.groupBy(key).agg(F.count("*").alias("k")).where("k >= 3").select(key)
    return cols.join(many, key)


def nearest_column(words: DataFrame, columns: DataFrame, key: str) -> DataFrame:
    """Words with the column of the nearest centre; the lower column on ties. Columns of one page are few."""
    c = columns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("column", "centre"))).alias("cs"))
    mid = F.col("left") + F.col("width") / 2
    best = F.array_min(F.transform("cs", lambda x: F.struct(F.abs(x["centre"] - mid).alias("d"), x["column"].alias("column"))))
    return words.join(c, key).withColumn("column", best["column"]).drop("cs")


# ---- expense and identity responses
EXPENSE = "struct<ExpenseDocuments:array<struct<SummaryFields:array<struct<Type:struct<Text:string>,LabelDetection:struct<Text:string>,ValueDetection:struct<Text:string,Confidence:double>>>>>>"
IDENTITY = "struct<IdentityDocuments:array<struct<IdentityDocumentFields:array<struct<Type:struct<Text:string>,ValueDetection:struct<Text:string,Confidence:double>>>>>>"
# Expense types and the field names that the invoice skill gives them.
EXPENSE_NAMES = {"VENDOR_NAME": "vendor_name", "INVOICE_RECEIPT_DATE": "invoice_date", "DUE_DATE": "due_date", "TOTAL": "total_amount", "SUBTOTAL": "subtotal", "TAX": "tax_amount", "PO_NUMBER": "po_number", "INVOICE_RECEIPT_ID": "invoice_number", "PAYMENT_TERMS": "payment_terms"}


def expense_fields(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, field_type, label, value, confidence): summary fields; a missing label is the type."""
    d = df.select(key, F.explode(F.from_json(body, EXPENSE)["ExpenseDocuments"]).alias("d")).select(key, F.explode("d.SummaryFields").alias("f"))
    return d.select(key, F.col("f.Type.Text").alias("field_type"), F.coalesce("f.LabelDetection.Text", "f.Type.Text").alias("label"), F.col("f.ValueDetection.Text").alias("value"), F.col("f.ValueDetection.Confidence").alias("confidence"))


def named_expense(fields: DataFrame) -> DataFrame:
    """Adds the skill's field name by a broadcast lookup; unmapped types keep their own in lower case."""
    spark = fields.sparkSession
    names = spark.createDataFrame(list(EXPENSE_NAMES.items()), "field_type string, name string")
    return fields.join(F.broadcast(names), "field_type", "left").withColumn("name", F.coalesce("name", F.lower("field_type")))


def identity_fields(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, field_type, value): the last value of each type."""
    d = df.select(key, F.explode(F.from_json(body, IDENTITY)["IdentityDocuments"]).alias("d")).select(key, F.posexplode("d.IdentityDocumentFields").alias("n", "f"))
    return d.groupBy(key, F.col("f.Type.Text").alias("field_type")).agg(F.max_by("f.ValueDetection.Text", "n").alias("value"))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two perceptual hashes given as arrays of 64-bit words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


# ---- columns of a page
def column_sides(words: DataFrame, key: str, mid: float = 0.5, least: int = 3) -> DataFrame:
    """Words with `side`: 1 right of the middle if at least `least` words of the page are, else 0."""
    right = (F.col("left") + F.col("width") / 2 > mid).cast("int")
    n = words.groupBy(key).agg(F.sum(right).alias("_right"))
    return words.join(n, key).withColumn("side", F.when(F.col("_right") >= least, right).otherwise(0)).drop("_right")


def column_text(words: DataFrame, key: str, mid: float = 0.5, least: int = 3) -> DataFrame:
    """(key, text): lines of the left column, then those of the right one."""
    s = column_sides(words, key, mid, least).withColumn("_page", F.struct(key, "side"))
    lines = reading_lines(s, "_page").select(F.col(f"_page.{key}").alias(key), F.col("_page.side").alias("side"), "line_no", "text")
    return lines.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("side", "line_no", "text"))), lambda x: x["text"]), "\n").alias("text"))


# ---- forms from lines, responses as one text
# Labels of fields, by which a line without a colon is a form field.
LABELS = r"(?i)(invoice\s*(no|num|#|date|number)|date|due\s*date|payment\s*terms|vendor|supplier|bill\s*to|ship\s*to|po\s*(number|#)|purchase\s*order|subtotal|sub\s*total|total\s*(due|amount)?|tax|vat|gst|hst|patient\s*(name|id)?|provider|diagnosis|medication|prescription|name|address|phone|email|fax|account\s*(no|number)?|expir(y|ation)|issue\s*date|nationality|country|city|state|zip)"
LABEL_SPLIT = r"^([\w\s\-/().]{2,40}?)\s*[:–\-]\s*(.*)$"
# Form keys that stand for expense types which no field gave.
SUPPLEMENTS = {"VENDOR": "VENDOR_NAME", "TOTAL DUE": "TOTAL", "INVOICE DATE": "INVOICE_RECEIPT_DATE", "DUE DATE": "DUE_DATE", "PO NUMBER": "PO_NUMBER", "TAX": "TAX", "SUBTOTAL": "SUBTOTAL"}


def form_lines(words: DataFrame, lines: DataFrame, key: str, aggressive: bool = False) -> DataFrame:
    """(key, k, v): form fields of a page, the first value of each key (in any case) winning, in reading order.

    `lines` (key, line_no, text) are the lines of `words` (key, line_no, word, left, width). A line gives a field by its
    colon or dash if the key is a known label or short; else by its halves, words left and right of its middle, if the left one
    is a known label. With `aggressive` (pages that look like forms) keys may be longer, and a short label without a value
    takes the next line. Empty values give none.
    """
    limit = 40 if aggressive else 30
    text = F.regexp_replace("text", r"^\s+|\s+$", "")
    k, v = F.regexp_extract(text, LABEL_SPLIT, 1), F.regexp_extract(text, LABEL_SPLIT, 2)
    label = lambda c: c.rlike(LABELS)
    k = F.regexp_replace(k, r"^\s+|\s+$", "")
    by_sign = text.rlike(LABEL_SPLIT) & (label(k) | (F.length(k) <= limit))
    middle = words.groupBy(key, "line_no").agg(((F.min("left") + F.max(F.col("left") + F.col("width"))) / 2).alias("mid"), F.count("*").alias("n_words"))
    halves = words.join(middle, [key, "line_no"]).withColumn("right", F.col("left") + F.col("width") / 2 >= F.col("mid"))
    side = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("left", "word")))), lambda x: x["word"]), " ")
    halves = halves.groupBy(key, "line_no", "n_words").agg(side(~F.col("right")).alias("lk"), side(F.col("right")).alias("rv"))
    nxt = lines.select(key, (F.col("line_no") - 1).alias("line_no"), F.regexp_replace("text", r"^\s+|\s+$", "").alias("next"))
    j = lines.join(halves, [key, "line_no"], "left").join(nxt, [key, "line_no"], "left")
    lk = F.regexp_replace("lk", r":+\s*$", "")
    by_half = ~by_sign & (F.col("n_words") >= 2) & (F.col("lk") != "") & (F.col("rv") != "") & label(lk)
    alone = F.regexp_replace(text, r":+$", "")
    by_next = F.lit(aggressive) & ~by_sign & (F.coalesce("n_words", F.lit(1)) <= 5) & (F.coalesce("next", F.lit("")) != "") & (label(alone) | text.endswith(":"))
    one = lambda c, no, a, b: F.when(c, F.struct(F.lit(no).alias("rule"), a.alias("k"), b.alias("v")))
    found = j.select(key, "line_no", F.explode(F.array_compact(F.array(one(by_sign, 1, k, F.regexp_replace(v, r"^\s+|\s+$", "")), one(by_half, 2, lk, F.col("rv")), one(by_next, 3, alone, F.col("next"))))).alias("f"))
    found = found.where((F.col("f.v") != "") & (F.col("f.k") != ""))
    first = F.struct("line_no", F.col("f.rule"))
    return found.groupBy(key, F.lower("f.k").alias("lk")).agg(F.min_by("f.k", first).alias("k"), F.min_by("f.v", first).alias("v")).select(key, "k", "v")


def supplement(fields: DataFrame, forms: DataFrame, key: str) -> DataFrame:
    """Expense fields (key, field_type, label, value, confidence) with those that only the forms (key, k, v) give, at 0.80.

    A type that a record has already is never replaced, and empty form values add nothing.
    """
    names = forms.sparkSession.createDataFrame(list(SUPPLEMENTS.items()), "_k string, field_type string")
    f = forms.where(F.coalesce("v", F.lit("")) != "").withColumn("_k", F.upper(F.trim("k"))).join(F.broadcast(names), "_k")
    f = f.groupBy(key, "field_type", "_k").agg(F.min("v").alias("value")).select(key, "field_type", F.initcap(F.lower("_k")).alias("label"), "value", F.lit(0.80).alias("confidence"))
    return fields.unionByName(f.join(fields.select(key, "field_type").distinct(), [key, "field_type"], "left_anti"))


ITEMS = "struct<ExpenseDocuments:array<struct<LineItemGroups:array<struct<LineItems:array<struct<LineItemExpenseFields:array<struct<Type:struct<Text:string>,ValueDetection:struct<Text:string>>>>>>>>>>"


def expense_items(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, item_no, value): each line item of an expense response as `TYPE: value | ...`; parts without type or value are left out."""
    groups = F.flatten(F.transform(F.from_json(body, ITEMS)["ExpenseDocuments"], lambda d: F.flatten(F.transform(d["LineItemGroups"], lambda g: g["LineItems"]))))
    items = df.select(key, F.posexplode(groups).alias("item_no", "i"))
    some = F.filter("i.LineItemExpenseFields", lambda x: (F.coalesce(x["Type"]["Text"], F.lit("")) != "") & (F.coalesce(x["ValueDetection"]["Text"], F.lit("")) != ""))
    return items.select(key, "item_no", F.array_join(F.transform(some, lambda x: F.concat(x["Type"]["Text"], F.lit(": "), x["ValueDetection"]["Text"])), " | ").alias("value")).where("value <> ''")


def line_text(b: DataFrame, key: str) -> DataFrame:
    """(key, text): the LINE blocks of a response, in its order (`pos` if the blocks have one, else their id)."""
    order = "pos" if "pos" in b.columns else "block_id"
    l = b.where("BlockType = 'LINE' and Text is not null")
    return l.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "Text"))), lambda x: x["Text"]), "\n").alias("text"))


def structured_text(texts: DataFrame, key: str, tables: DataFrame | None = None, forms: DataFrame | None = None, fields: DataFrame | None = None, ids: DataFrame | None = None) -> DataFrame:
    """(key, structured): text, tables (key, table_no, page, markdown), forms (key, n, k, v), fields (key, n, label, value) and ids (key, n, k, v) as one text.

    Parts that a record lacks leave no heading.
    """
    out = texts.select(key, F.coalesce("text", F.lit("")).alias("_text"))
    parts = [("tables", tables, "--- TABLES ---", ["table_no"], lambda x: F.concat(F.lit("\nTable "), x["table_no"].cast("string"), F.lit(" (page "), x["page"].cast("string"), F.lit("):\n"), x["markdown"]), ["table_no", "page", "markdown"])]
    pair = lambda a, b: lambda x: F.concat(x[a], F.lit(": "), F.coalesce(x[b], F.lit("")))
    parts += [("forms", forms, "--- FORM FIELDS ---", ["n"], pair("k", "v"), ["n", "k", "v"]), ("fields", fields, "--- DOCUMENT FIELDS ---", ["n"], pair("label", "value"), ["n", "label", "value"]), ("ids", ids, "--- ID FIELDS ---", ["n"], pair("k", "v"), ["n", "k", "v"])]
    cols = [F.col("_text")]
    for name, df, head, _, line, need in parts:
        if df is None:
            continue
        g = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*need))).alias(f"_{name}"))
        g = g.select(key, F.concat(F.lit(f"\n\n{head}\n"), F.array_join(F.transform(f"_{name}", line), "\n")).alias(f"_{name}"))
        out = out.join(g, key, "left")
        cols.append(F.col(f"_{name}"))
    return out.select(key, F.array_join(F.array_compact(F.array(*cols)), "\n").alias("structured"))


def merge_pages(pages: DataFrame, key: str, page: str, text: str = "text") -> DataFrame:
    """(key, text, page_count): the pages of a record by number, joined by blank lines; a null page counts as an empty one."""
    p = pages.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.coalesce(text, F.lit("")).alias("t")))).alias("x"))
    return p.select(key, F.array_join(F.transform("x", lambda x: x["t"]), "\n\n").alias("text"), F.size("x").alias("page_count"))


def spatial_order(boxes: DataFrame, key: str, band: float = 5.0) -> DataFrame:
    """(key, n, text): boxes by bands of their top, then from the left."""
    b = boxes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((F.bround(F.col("top") / band) * band).alias("row"), "left", "text"))).alias("b"))
    return b.select(key, F.posexplode("b").alias("n", "x")).select(key, "n", F.col("x.text").alias("text"))


def extract(b: DataFrame, key: str, mode: str = "auto") -> DataFrame:
    """(key, part, n, name, value) of parsed responses by mode: text, tables, forms, or auto for all of them."""
    if mode not in ("auto", "text", "tables", "forms"):
        raise ValueError(f"unknown mode {mode}")
    part = lambda df, name, n, k, v: df.select(key, F.lit(name).alias("part"), n.alias("n"), k.alias("name"), v.alias("value"))
    none = F.lit("")
    out = []
    if mode in ("auto", "text"):
        out.append(part(line_text(b, key), "text", F.lit(0), none, F.col("text")))
    if mode in ("auto", "tables"):
        out.append(part(markdown(table_cells(b, key), [key, "table_id"]), "table", F.lit(0), F.col("table_id"), F.col("markdown")))
    if mode in ("auto", "forms"):
        out.append(part(form_pairs(b, key), "form", F.lit(0), F.col("k"), F.col("v")))
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole
