"""Parsers of model replies, as column expressions; null replies give the default."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.text import numbered_item, strip


def _lines(c: Column) -> Column:
    return F.split(strip(F.coalesce(c, F.lit(""))), r"\r?\n")


def field(c: Column, name: str, default=None) -> Column:
    """What follows `NAME:` on the last line that starts so, trimmed."""
    found = F.filter(_lines(c), lambda x: x.startswith(f"{name}:"))
    value = F.when(F.size(found) > 0, strip(F.substr(F.element_at(found, -1), F.lit(len(name) + 2))))
    return F.coalesce(value, F.lit(default))


def yes(c: Column) -> Column:
    """YES or NO: yes if the reply says so anywhere."""
    return F.coalesce(F.upper(c).contains("YES"), F.lit(False))


def done(c: Column, word: str = "DONE") -> Column:
    """The reply says that nothing more is needed (DONE, COMPLETE)."""
    return F.coalesce(F.upper(c).contains(word), F.lit(False))


def category(c: Column) -> Column:
    """struct(category, confidence, reason) of a routing reply; SIMPLE and 0.70 where it says nothing readable."""
    conf = F.coalesce(field(c, "CONFIDENCE").try_cast("double"), F.lit(0.70))
    return F.struct(F.upper(field(c, "CATEGORY", "SIMPLE")).alias("category"), conf.alias("confidence"), field(c, "REASON", "LLM classified as simple factual query.").alias("reason"))


def action(c: Column) -> Column:
    """struct(kind, tool, argument) of an agent's reply: TOOL with its argument, ANSWER, or text."""
    tool, answer = field(c, "TOOL"), field(c, "ANSWER")
    kind = F.when(tool.isNotNull(), "tool").when(answer.isNotNull(), "answer").otherwise("text")
    return F.struct(kind.alias("kind"), tool.alias("tool"), F.coalesce(F.when(tool.isNotNull(), field(c, "INPUT")), answer, strip(F.coalesce(c, F.lit("")))).alias("argument"))


def sub_queries(c: Column) -> Column:
    """Lines of a numbered list without their numbers; lines that become empty are dropped."""
    return F.filter(F.transform(_lines(c), lambda x: strip(numbered_item(strip(x)))), lambda x: x != "")


# ---- default providers: replies without a model, so that the parsers run on data
def decompose(query: Column, most: int = 4) -> Column:
    """A reply that breaks a query at ` and `, commas and question marks into a numbered list."""
    parts = F.slice(F.filter(F.transform(F.split(query, r"(?i)\s+and\s+|[,;?]\s*"), strip), lambda x: x != ""), 1, most)
    return F.array_join(F.transform(parts, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def step_back(query: Column) -> Column:
    """A more general question: numbers and quoted words give way to a placeholder."""
    return F.concat(F.lit("In general: "), F.regexp_replace(F.regexp_replace(strip(query), r"\d[\d.,]*", "some"), "[\"'][^\"']+[\"']", "something"))
