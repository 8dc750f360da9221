"""Entity recognition: an ordered cascade of patterns with disjoint spans, and its single steps as expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.session import spread

# Patterns of the cascade.
MONTH = "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
DATES = [(r"\b(\d{4})[/\-.](\d{1,2})[/\-.](\d{1,2})\b", "iso"), (r"\b(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{2,4})\b", "us"), (rf"\b({MONTH})[.\s]+(\d{{1,2}})[,\s]+(\d{{4}})\b", "mdy"), (rf"\b(\d{{1,2}})[.\s]+({MONTH})[.\s]+(\d{{4}})\b", "dmy"), (r"\b(20[0-9]{2}|19[5-9][0-9])\b", "year")]
AMOUNT = r"(?:(?:USD|EUR|GBP|CAD|AUD|INR|JPY)\s*)?[$€£₹¥]?\s*(\d{1,3}(?:,\d{3})+(?:\.\d{1,4})?|\d+(?:\.\d{1,4})?)\s*(?:USD|EUR|GBP|CAD|AUD|INR|JPY)?"
SYMBOL = r"[$€£₹¥]|(?:USD|EUR|GBP|CAD|AUD|INR)"
MONEY_WORDS = r"(total|amount|due|paid|price|cost|fee|charge|balance|invoice|subtotal|tax|vat|gst)"
PHONE = r"(?:\+?1[\s\-.]?)?\(?(\d{3})\)?[\s\-.]?(\d{3})[\s\-.]?(\d{4})(?:\s*(?:ext|x|ext\.)\s*\d{1,5})?"
ICD = r"\b([A-TV-Z][0-9]{2})\.?([0-9A-TV-Z]{0,4})\b"
NPI = r"\bNPI\s*[:\-#]?\s*(\d{10})\b"
ADDRESS = r"\b\d{1,5}\s+[A-Za-z0-9\s]{3,40}(?:Street|St|Avenue|Ave|Boulevard|Blvd|Road|Rd|Lane|Ln|Drive|Dr|Court|Ct|Circle|Cir|Way|Place|Pl|Suite|Ste|Floor|Fl|Apt|Unit)[.,\s]{0,3}[A-Za-z\s]{2,30}(?:,\s*[A-Z]{2})?\s*\d{5}(?:-\d{4})?"
NAME = r"\b(?:Dr\.?\s+|Mr\.?\s+|Mrs\.?\s+|Ms\.?\s+|Prof\.?\s+)?([A-Z][a-z]{1,20}(?:\s+[A-Z][a-z]{1,20}){1,3})\b"
NOT_NAME = r"\b(Invoice|Total|Amount|Date|Payment|Terms|Bill|Ship|Address|Street|Avenue|Phone|Email|Fax|Company|Corporation|Inc|LLC|Ltd|Department|Section|Chapter|Table|Figure|Appendix|January|February|March|April|June|July|August|September|October|November|December)\b"
ORG = r"\b([A-Z][A-Za-z0-9\s&.\-]{2,50})\s+(?:Inc|LLC|Ltd|Corp|Co\b|PLC|LLP|GmbH|SA|SAS|NV|BV|AG|Pty|Incorporated|Limited|Corporation|Company)\b"
_MONTHS = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}


def iso_date(g: tuple, form: str) -> tuple[str, float] | None:
    """ISO form and confidence; only ranges are checked, a month above 12 changes places with the day."""
    if form == "year":
        return g[0], 0.55
    if form == "iso":
        y, m, d = map(int, g[:3])
    elif form == "us":
        m, d, y = map(int, g[:3])
        y += (2000 if y < 50 else 1900) if y < 100 else 0
        if m > 12 >= d:
            m, d = d, m
    else:
        name, d = (g[0], int(g[1])) if form == "mdy" else (g[1], int(g[0]))
        m, y = _MONTHS[name[:3].lower()], int(g[2])
    return (f"{y:04d}-{m:02d}-{d:02d}", 0.92) if 1 <= m <= 12 and 1 <= d <= 31 and 1900 <= y <= 2100 else None


def amount_form(raw: str) -> str:
    sym = re.search(SYMBOL, raw, re.I)
    s = sym[0] if sym else "$"
    s = "$" if s.upper() == "USD" else s
    n = re.sub(r"[^\d.,]", "", raw)
    places = max(2, len(n.rpartition(".")[2])) if "." in n else 0
    return f"{s}{float(n.replace(',', '')):,.{places}f}"


_STEPS = [("ADDRESS", ADDRESS, re.I), *((f"DATE:{f}", p, re.I if f in ("mdy", "dmy") else 0) for p, f in DATES), ("AMOUNT", AMOUNT, re.I), ("ID_NUMBER", NPI, re.I), ("ICD_CODE", ICD, 0), ("PHONE", PHONE, re.I), ("EMAIL", EMAIL, 0), ("ORG_NAME", ORG, re.I), ("PERSON_NAME", NAME, 0)]
_COMPILED = [(k, re.compile(p, f)) for k, p, f in _STEPS]


def recognise(text: str | None) -> list[tuple[str, str, str, int, int, float]]:
    """(type, raw, normalized, start, end, confidence) in order of place; offsets refer to the NFKC form of the text."""
    if not text or not text.strip():
        return []
    t = unicodedata.normalize("NFKC", text)
    taken = bytearray(len(t))
    out = []
    for step, pattern in _COMPILED:
        kind, _, form = step.partition(":")
        for m in pattern.finditer(t):
            s, e = m.span()
            if s == e or 1 in taken[s:e]:
                continue
            raw, conf = m[0], 0.0
            if kind == "ADDRESS":
                norm, conf = " ".join(raw.split()), 0.75
            elif kind == "DATE":
                if not (x := iso_date(m.groups(), form)):
                    continue
                norm, conf = x
            elif kind == "AMOUNT":
                sym = re.search(SYMBOL, raw, re.I)
                if not sym and not re.search(MONEY_WORDS, t[max(0, s - 40) : e + 10].lower()):
                    continue
                norm, conf = amount_form(raw), 0.88 if sym else 0.72
            elif kind == "ID_NUMBER":
                norm, conf = f"NPI:{m[1]}", 0.95
            elif kind == "ICD_CODE":
                norm, conf = (m[1] + ("." + m[2] if m[2] else "")).upper(), 0.90
            elif kind == "PHONE":
                norm, conf = f"({m[1]}) {m[2]}-{m[3]}", 0.82
            elif kind == "EMAIL":
                norm, conf = raw.lower(), 0.98
            elif kind == "ORG_NAME":
                norm, conf = raw.strip(), 0.70
            else:
                if re.search(NOT_NAME, m[1], re.I):
                    continue
                norm, conf = m[1].title(), 0.60
            taken[s:e] = b"\x01" * (e - s)
            out.append((kind, raw, norm, s, e, conf))
    return sorted(out, key=lambda x: x[3])


def entity_rows(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, entity_type, raw, normalized, start, end, confidence), a row an entity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, *e) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for e in recognise(t)]
            cols = list(zip(*rows)) if rows else [[]] * 7
            kinds = [b.schema.field(0).type, pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["k", "entity_type", "raw", "normalized", "start_char", "end_char", "confidence"])

    kind = df.schema[key].dataType.simpleString()
    out = spread(df.select(df[key].alias("k"), df[text].alias("t"))).mapInArrow(run, f"k {kind}, entity_type string, raw string, normalized string, start_char int, end_char int, confidence double")
    return out.withColumnRenamed("k", key)


def matches(c, pattern: str) -> Column:
    """array<struct<start, raw>> of all matches with offsets, without Python: lengths of parts and matches added up."""
    found = F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(1))
    parts = F.split(c, pattern, -1)
    starts = F.aggregate(
        F.sequence(F.lit(1), F.size(found)), F.array().cast("array<int>"),
        lambda acc, i: F.array_append(acc, F.when(F.size(acc) == 0, F.lit(0)).otherwise(F.element_at(acc, -1) + F.length(F.get(found, i - 2))) + F.length(F.get(parts, i - 1))))
    return F.when(F.size(found) > 0, F.zip_with(starts, found, lambda s, r: F.struct(s.alias("start"), r.alias("raw"))))


def annotated(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, annotated, n): the NFKC text with each entity as [TYPE:normalized]; texts without entities stay, null texts are null."""

    def one(t: str | None) -> tuple[str | None, int]:
        if t is None:
            return None, 0
        found, out, at = recognise(t), [], 0
        t = unicodedata.normalize("NFKC", t)
        for kind, _, norm, s, e, _ in found:
            out += [t[at:s], f"[{kind}:{norm}]"]
            at = e
        return "".join([*out, t[at:]]), len(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [one(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int32())], names=["k", "annotated", "n"])

    kind = df.schema[key].dataType.simpleString()
    return spread(df.select(df[key].alias("k"), df[text].alias("t"))).mapInArrow(run, f"k {kind}, annotated string, n int").withColumnRenamed("k", key)


def by_type(entities: DataFrame, key: str) -> DataFrame:
    """(key, entity_type, first, values): normalized values of each type in order of place, and the first of them."""
    g = entities.groupBy(key, "entity_type").agg(F.array_sort(F.collect_list(F.struct("start_char", "normalized"))).alias("x"))
    values = F.transform("x", lambda x: x["normalized"])
    return g.select(key, "entity_type", F.get(values, 0).alias("first"), values.alias("values"))
