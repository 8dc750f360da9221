"""Routing, classification, guards, reply parsers and validation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Heuristic patterns of the query router, in the order in which they are tried, with
# category, confidence and specification file.
ROUTES = [
    ("SUMMARY", r"\b(summarize|summarise|summarization|give me a summary|provide a summary|overview|key points|key takeaways|tl;?dr|what is this (about|document)|main (topic|finding|idea|point|theme|conclusion)|key (finding|result|conclusion|outcome|insight)s?|what (were|are|is) the (key|main|primary|top) (finding|result|conclusion|outcome|insight|point)s?|findings? of (this|the) (research|study|paper|report|document)|what (does|did) (the|this|a) (research|study|paper|report|document) (say|show|find|indicate|suggest|conclude)\b|research findings (on|about|regarding|for)\b|what (the )?(research|study|evidence|data|paper|report) (says?|shows?|indicates?|suggests?|concludes?)\b)\b", "SIMPLE", 0.88, "simple.yaml"),
    ("AGENTIC", r"\b(find all|investigate|gather all|collect all|thorough|deep.?dive|multi.?step|iterative|recursively|research all|research every|research into|research across|comprehensive\s+(?:analysis|review|audit|study|search))\b", "AGENTIC", 0.88, "agentic.yaml"),
    ("COMPARISON", r"\b(compare|comparison|difference|vs\.?|versus|contrast|distinguish|which is better|pros and cons|advantages|disadvantages)\b", "COMPLEX", 0.90, "production.yaml"),
    ("LISTING", r"\b(list all|enumerate|give me all|what are all|how many)\b", "COMPLEX", 0.85, "production.yaml"),
    ("STEP", r"\b(how to|step.?by.?step|explain how|walk me through|process of|procedure)\b", "COMPLEX", 0.82, "production.yaml"),
    ("TEMPORAL", r"\b(latest|recent|new|updated|changed|since|after \d{4}|before \d{4}|history of|evolution|trend)\b", "COMPLEX", 0.80, "production.yaml"),
    ("NEGATION", r"\b(not|never|no\b|without|except|exclude|excluding|doesn't|don't|isn't|aren't|won't|cannot|can't)\b", "SIMPLE", 0.78, "simple.yaml"),
]
# Keyword patterns of the document classes, in declared order.
CLASSES = {
    "invoice": r"\b(invoice|receipt|bill to|remit to|subtotal|total due|amount due|invoice\s*#|inv\s*#|purchase order|vendor|net\s*30|net\s*60|tax amount)\b",
    "contract": r"\b(agreement|contract|terms and conditions|whereas|hereinafter|governing law|indemnif|liability|confidential|nda|non.disclosure|effective date|termination|intellectual property|sow|statement of work)\b",
    "medical": r"\b(patient|diagnosis|icd.?10|cpt code|prescription|physician|provider|clinical|lab result|discharge|chief complaint|assessment|plan|rx|medication|dosage|healthcare)\b",
    "id_document": r"\b(passport|driver.?s? licen[cs]e|national id|date of birth|dob|expiry date|mrz|issuing authority|citizenship|nationality)\b",
    "report": r"\b(annual report|quarterly|financial statement|audit|revenue|executive summary|findings|recommendations|appendix|table of contents)\b",
    "form": r"\b(please fill|check all that apply|signature|date signed|applicant|social security|ssn|form\s+\w+|\[\s*\]|\(\s*\))\b",
    "letter": r"\b(dear\s+\w|sincerely|yours truly|regards|to whom it may concern|re:|subject:|memo|memorandum)\b",
}
MODES = {"invoice": "expense", "contract": "forms", "medical": "forms", "id_document": "id", "report": "auto", "form": "forms", "letter": "auto", "other": "auto"}
# Parts of a file name that suggest a class.
FILE_NAMES = [("invoice", 0.80, ("invoice", "receipt", "bill", "inv_", "inv-")), ("contract", 0.80, ("contract", "agreement", "nda", "sow", "lease")), ("id_document", 0.80, ("passport", "license", "licence", "id_card", "national_id")), ("medical", 0.78, ("medical", "clinical", "lab", "prescription", "discharge"))]
# Signals of a patient record and of a report.
CLINICAL = [r"patient\s*(name|id|dob|no\.?|number)\s*:", r"chief\s*complaint\s*:", r"(?:diagnosis|assessment|plan)\s*:", r"\bRx\s*:", r"(?:physician|provider|npi)\s*:", r"discharge\s*summary", r"lab\s*result", r"\bICD-1[0-9]\b.*[A-Z]\d{2}", r"date\s*of\s*birth\s*:", r"dob\s*:", r"medications?\s*:", r"prescribed\s*:"]
REPORT = [r"\b(chapter|edition|textbook|handbook|introduction to|overview of)\b", r"\b(table of contents|bibliography|references|appendix)\b", r"\b(healthcare informatics|health information|information systems)\b", r"published\s+\d{4}|copyright\s+\d{4}|isbn\s*:"]
# Guard patterns.
INJECTION = r"(ignore previous|system update|admin mode|you are now|disregard prior|act as|jailbreak|DAN mode)"
PII = r"\b(\d{3}-\d{2}-\d{4}|\d{16}|\d{4}[\s-]\d{4}[\s-]\d{4}[\s-]\d{4}|[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})\b"
NEGATED = r"\b(not|never|no|without|except|excluding|other than)\b"
GLOBAL = r"\b(all|every|overall|summarise|summarize|main themes|across all)\b"
CONJOINED = r"\b(and also|as well as|additionally)\b"
MISSING = ("", "n/a", "none", "unknown")
# Date forms that a validated field may have.
DATE = r"\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}|\d{4}[/\-.]\d{2}[/\-.]\d{2}|[A-Za-z]+ \d{1,2},?\s*\d{4}"
AMOUNT = r"[$£€]?[\d,]+\.?\d*"


def has(c, pattern: str) -> Column:
    return F.coalesce(c.rlike("(?i)" + pattern), F.lit(False))


def route(query: Column, tenant: Column) -> Column:
    """struct(spec, category, confidence, rule): a tenant decides at once, then the first pattern that fits; else SIMPLE 0.5."""
    s = lambda spec, cat, conf, rule: F.struct(F.lit(spec).alias("spec"), F.lit(cat).alias("category"), F.lit(conf).alias("confidence"), F.lit(rule).alias("rule"))
    q = F.regexp_replace(query, r"^\s+|\s+$", "")
    chain = F.when(tenant.isNotNull() & (tenant != ""), s("multitenant.yaml", "MULTITENANT", 1.0, "TENANT"))
    for rule, pattern, cat, conf, spec in ROUTES:
        cond = has(q, pattern)
        if rule == "NEGATION":
            cond = cond & (F.size(F.filter(F.split(q, r"\s+"), lambda x: x != "")) <= 20)
        chain = chain.when(cond, s(spec, cat, conf, rule))
    return chain.otherwise(s("simple.yaml", "SIMPLE", 0.5, "FALLBACK"))


def _first(text: Column, window: int | None) -> Column:
    t = F.coalesce(text, F.lit(""))
    return t if window is None else F.substring(t, 1, window)


def keyword_counts(text: Column, window: int | None = None) -> dict[str, Column]:
    """Over the whole text; `window` is the reference's prefix (5,000 characters)."""
    t = _first(text, window)
    return {k: F.regexp_count(t, F.lit("(?i)" + p)) for k, p in CLASSES.items()}


def classify(df: DataFrame, text: str = "text", window: int | None = None) -> DataFrame:
    """Adds doc_class, class_score, class_confidence: the class with most keywords, at least 4 and twice the next; else `other`, 0.60."""
    df = df.withColumn("_s", F.array(*[F.struct(n.alias("n"), F.lit(-i).alias("o"), F.lit(k).alias("k")) for i, (k, n) in enumerate(keyword_counts(F.col(text), window).items())]))
    top = F.sort_array("_s", asc=False)
    df = df.withColumn("_a", top[0]).withColumn("_b", top[1])
    clear = (F.col("_a.n") >= 4) & ((F.col("_b.n") == 0) | (F.col("_a.n") >= 2 * F.col("_b.n")))
    return df.select(
        *[c for c in df.columns if c[0] != "_"], F.when(clear, F.col("_a.k")).otherwise("other").alias("doc_class"), F.col("_a.n").cast("int").alias("class_score"),
        F.when(clear, F.least(F.lit(0.92), 0.65 + F.col("_a.n") * 0.03)).otherwise(0.60).alias("class_confidence"))


def classify_name(name: Column) -> Column:
    """struct(doc_class, confidence) from a file name."""
    n = F.lower(name)
    chain = None
    for k, conf, parts in FILE_NAMES:
        cond = F.greatest(*[n.contains(p) for p in parts])
        v = F.struct(F.lit(k).alias("doc_class"), F.lit(conf).alias("confidence"))
        chain = F.when(cond, v) if chain is None else chain.when(cond, v)
    return chain.otherwise(F.struct(F.lit("other").alias("doc_class"), F.lit(0.40).alias("confidence")))


def hits(text: Column, patterns: list[str], window: int | None = None) -> Column:
    """Over the whole text; `window` is the reference's prefix (4,000 characters)."""
    t = _first(text, window)
    return sum((has(t, p).cast("int") for p in patterns[1:]), has(t, patterns[0]).cast("int"))


def present(c: Column) -> Column:
    v = F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", ""))
    return ~v.isin(*MISSING)


# Rules of the invoice class as a table: kind, field, what is needed, severity.
INVOICE_RULES = [("required", "vendor_name", "", "error"), ("required", "total_amount", "", "error"), ("required", "invoice_date", "", "error"), ("regex", "invoice_date", DATE, "error"), ("regex", "total_amount", AMOUNT, "warning"), ("cross_field", "due_date", "invoice_date", "warning")]


def violations(df: DataFrame, key: str, fields: dict[str, str], rules=None) -> DataFrame:
    """(key, rule_no, kind, field, severity) of each violated rule; `fields` maps field names to columns."""
    cols = []
    for i, (kind, field, need, severity) in enumerate(rules or INVOICE_RULES):
        v = F.col(fields[field])
        if kind == "required":
            bad = ~present(v)
        elif kind == "regex":
            bad = present(v) & ~v.rlike(need)
        else:
            bad = present(v) & (F.regexp_replace(F.coalesce(F.col(fields[need]), F.lit("")), r"\s+", "") == "")
        cols.append(F.when(bad, F.struct(F.lit(i).alias("rule_no"), F.lit(kind).alias("kind"), F.lit(field).alias("field"), F.lit(severity).alias("severity"))))
    return df.select(key, F.explode(F.filter(F.array(*cols), lambda x: x.isNotNull())).alias("v")).select(key, "v.*")


def classify_named(df: DataFrame, text: str, name: str, window: int | None = None) -> DataFrame:
    """`classify` with the file name first: a name that is sure to 0.80 decides, else the text does."""
    by_name = classify_name(F.coalesce(F.col(name), F.lit("")))
    df = classify(df.withColumn("name_class", by_name), text, window)
    sure = (F.col("name_class.confidence") >= 0.80) & (F.coalesce(F.col(name), F.lit("")) != "")
    return df.withColumn("class_confidence", F.when(sure, F.col("name_class.confidence")).otherwise(F.col("class_confidence"))).withColumn("doc_class", F.when(sure, F.col("name_class.doc_class")).otherwise(F.col("doc_class"))).withColumn("by", F.when(sure, "name").otherwise("text")).drop("name_class")


# Rules of the other classes.
RULES = {
    "invoice": INVOICE_RULES,
    "contract": [("required", "party_1", "", "error"), ("required", "party_2", "", "error"), ("required", "effective_date", "", "error"), ("regex", "effective_date", DATE, "error"), ("cross_field", "expiry_date", "effective_date", "warning")],
    "medical": [("required", "patient_name", "", "error"), ("required", "provider_name", "", "error"), ("required", "document_date", "", "error"), ("regex", "document_date", DATE, "error"), ("regex", "diagnosis_codes", r"[A-Z]\d{2}\.?\d*", "error")],
    "id_document": [("required", "id_number", "", "error"), ("required", "last_name", "", "error"), ("required", "date_of_birth", "", "error"), ("regex", "date_of_birth", DATE, "error"), ("regex", "expiry_date", DATE, "error")],
    "medical_report": [("required", "title", "", "error"), ("required", "document_date", "", "error")],
}
LEAST_CONFIDENCE = 0.60


def validate(df: DataFrame, key: str, fields: str, doc_type: str, confidence: str | None = None, extra: list[tuple] | None = None) -> DataFrame:
    """(key, kind, field, severity) of the rules that a record breaks, by the rule set of its class.

    `fields` is a map column; a class without rules breaks none. `extra` rules hold for every class; besides the kinds of
    RULES there is numeric_range with (least, most) as its need, either of them None. A confidence under 0.60 is a warning.
    """
    f = F.col(fields)

    def broken(kind: str, name: str, need, severity: str) -> Column:
        v = F.regexp_replace(F.coalesce(f[name], F.lit("")), r"^\s+|\s+$", "")
        if kind == "required":
            bad = ~present(v)
        elif kind == "regex":
            bad = present(v) & ~v.rlike(need)
        elif kind == "cross_field":
            bad = present(v) & (F.regexp_replace(F.coalesce(f[need], F.lit("")), r"\s+", "") == "")
        else:
            n = F.regexp_replace(v, r"[^\d.]", "").try_cast("double")
            low, high = need
            bad = (v != "") & (n.isNull() | (n < low if low is not None else F.lit(False)) | (n > high if high is not None else F.lit(False)))
            severity = "warning"
        return F.when(bad, F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("field"), F.lit(severity).alias("severity")))

    sets = F.lit(None)
    for name, rules in RULES.items():
        sets = F.when(F.col(doc_type) == name, F.array(*[broken(*r) for r in rules])).otherwise(sets)
    none = F.array().cast("array<struct<kind:string,field:string,severity:string>>")
    all_ = F.coalesce(sets, none)
    if extra:
        all_ = F.concat(all_, F.array(*[broken(*r) for r in extra]))
    if confidence:
        low = F.when(F.coalesce(F.col(confidence), F.lit(1.0)) < LEAST_CONFIDENCE, F.struct(F.lit("confidence").alias("kind"), F.lit("").alias("field"), F.lit("warning").alias("severity")))
        all_ = F.concat(all_, F.array(low))
    return df.select(key, F.explode(F.filter(all_, lambda x: x.isNotNull())).alias("v")).select(key, "v.*")


def guard_retrieval(chunks: DataFrame, key: str, score: str = "score", rank: str = "rank", stale: str | None = None) -> DataFrame:
    """(key, events) for retrieved chunks: K over 10, stale chunks, a top score under 0.25."""
    n = F.count("*")
    top = F.max(F.when(F.col(rank) == 1, F.col(score)))
    old = F.sum(F.coalesce(F.col(stale), F.lit(False)).cast("int")) if stale else F.lit(0)
    g = chunks.groupBy(key).agg(n.alias("n"), top.alias("top"), old.alias("old"))
    events = F.array_compact(F.array(F.when(F.col("n") > 10, "FM-R5"), F.when(F.col("old") > 0, "FM-R6"), F.when(F.col("top") < 0.25, "FM-R1")))
    return g.select(key, events.alias("events"), F.col("old").alias("stale_chunks"))


def guard_generation(answers: DataFrame, key: str, answer: str, chunks: str, reply: str) -> DataFrame:
    """(key, faithfulness, events): the score read from a judge's reply (0.5 if there is none), 1.0 without answer or chunks.

    `chunks` is the number of retrieved chunks. Events: a score under 0.6, more than five chunks.
    """
    from paperloom.functions.text import parse_score

    nothing = (F.coalesce(F.col(answer), F.lit("")) == "") | (F.coalesce(F.col(chunks), F.lit(0)) == 0)
    score = F.when(nothing, 1.0).otherwise(parse_score(F.col(reply), 0.5))
    g = answers.select(key, nothing.alias("_none"), score.alias("s"), F.col(chunks).alias("n"))
    events = F.when(F.col("_none"), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(F.when(F.col("s") < 0.6, "FM-G1"), F.when(F.col("n") > 5, "FM-G2"))))
    return g.select(key, F.round("s", 3).alias("faithfulness"), events.alias("events"))
