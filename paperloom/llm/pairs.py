"""Problem 3: defective prompt and response pairs, each with its kind of defect.

Each pair is judged by itself, so the work is one narrow pass in Arrow batches; only the few defective
keys are shuffled, to count a key that was delivered twice once. Four devices:

* a suffix automaton of the prompt's words; the response is run through it, and the share of its words
  that lie in matches of two words or more (or the whole prompt) is the copied coverage;
* an Aho-Corasick automaton of refusal phrases and one over classes of words (speaker, refusal, act of answering), asked
  for the first sentences of the response;
* a stack of delimiters, and the form of the last line, for responses that break off;
* votes of stopwords for the languages of prompt and response.

Defined cases: a null, empty or blank response, or a sign for no value, is `empty`; a null prompt
has no language and copies nothing. Of several defects the first of empty, copied, refusal,
other_language, truncated is given.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.session import spread, table

# Signs for no value, without surrounding punctuation, in lower case.
NO_VALUE = {"", "n/a", "na", "none", "null", "nil", "nan", "no answer", "no response", "k.a", "k. a", "keine angabe", "keine antwort", "leer", "empty", "sans réponse", "sin respuesta", "s/d", "n.d", "nd", "tbd", "undefined", "not available"}
# Phrases by which a response declines, by language.
REFUSALS = """
can't help with; cannot help with; can not help with; unable to help with; can't assist with; cannot assist with; unable to assist; unable to answer; cannot answer this; can't answer this; cannot answer that; can't answer that
not able to comment; not able to answer; not able to help; not able to assist; not able to provide; not able to discuss; decline to discuss; decline to answer; must decline; have to decline; i decline
not be appropriate for me; rather not give an answer; rather not answer; rather not say; prefer not to answer; no answer can be offered; no answer can be given; not in a position to answer; not in a position to; not allowed to answer; not permitted to
as a language model; as an ai; i will not answer; i won't answer; i won't be able to; i will not be able to; i cannot comment; i can't comment; i cannot provide; i can't provide; i cannot share; i can't share; i'm afraid i can; i am afraid i can; context is insufficient; against my guidelines; i cannot discuss; i can't discuss; outside what i can; beyond what i can; outside of what i can; not something i can; outside my scope; beyond my scope
nicht helfen; nicht weiterhelfen; keine auskunft geben; nicht beantworten; als sprachmodell; als ki; möchte ich mich nicht äußern; nicht äußern; keine antwort geben; nicht in der lage; darf ich nicht; kann ich nichts sagen; lieber nicht
ne peux pas vous aider; ne peux pas répondre; ne suis pas en mesure; préfère ne pas répondre; ne pas répondre; ne puis répondre; en tant que modèle; impossible de répondre; ne saurais répondre; ne peux pas fournir; ne peux pas vous fournir; refuse de répondre
no puedo ayudar; no puedo responder; no me es posible responder; no me es posible; prefiero no contestar; prefiero no responder; como modelo de lenguaje; no estoy en condiciones; no puedo contestar; no puedo facilitar; no puedo proporcionar; no estoy autorizado; me niego a
"""
# Classes of words whose sequence declines, whatever stands between: the speaker, a refusal, an act of answering.
SELF = set("i we i'm we're ich wir je nous yo".split())
DENIES = set("not cannot can't won't couldn't wouldn't refuse refused decline unable nicht keine kein ne pas refuse refusons no".split())
ACTS = set("answer answering help assist comment discuss provide share give offer respond disclose advise speculate antworten beantworten helfen weiterhelfen kommentieren geben äußern répondre aider fournir commenter donner responder contestar ayudar comentar dar proporcionar".split())
REACH = 6
# Words by which a sentence begins, where a short answer does not.
BEGINS = set("the a an it this these that yes no for der die das ein eine es für le la les l un une il elle el los las una".split())
# What stands in front of a repeated question.
LEADS = {"you asked", "question", "your question", "you asked me", "the question was", "q", "frage", "ihre frage", "sie fragten", "sie haben gefragt", "votre question", "vous avez demandé", "pregunta", "su pregunta", "usted preguntó", "ha preguntado", "query", "prompt"}
# Frequent words of each language that the others lack or rarely have.
STOPWORDS = {
    "en": "the of and to is are was were which that this with for from by an it not what how who when does did has have be been than then there on at their its can such about before after as our or under both",
    "de": "der die das und ist sind war wurde den dem des ein eine einer einem einen mit für von auf nicht was wie wer wann hat haben im zum zur bei aus nach als über unter vor und es auch oder wird welche welcher je etwa kann sich durch trotz laut",
    "fr": "le la les l de des du et est sont été une un avec pour dans sur par qui que quel quelle quelles quels au aux ne pas ce cette il elle ont en d à où plus avant après comme ou selon chaque deux jours",
    "es": "el la los las de del y es son fue fueron una un con para por en que qué cuál cuáles cuándo quién cuánto cuánta cuántos cuántas cómo dónde al no se lo su sus este esta como más antes después o desde hace ha según cada dos días hasta además",
}
# Words by which a prompt names the language that it wants.
ASKED = {
    "en": "in english; auf englisch; en anglais; en inglés",
    "de": "in german; auf deutsch; en allemand; en alemán",
    "fr": "in french; auf französisch; en français; en francés",
    "es": "in spanish; auf spanisch; en espagnol; en español",
}

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_ENDS = tuple(".!?…。؟:;")
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}", "“": "”", "«": "»", "„": "“"}, set(")]}”»")


def words(s: str) -> list[str]:
    return _WORD.findall(unicodedata.normalize("NFKC", s).lower().replace("’", "'"))


class SuffixAutomaton:
    """All runs of words of one prompt."""

    def __init__(self, seq: list[str]):
        self.next, self.link, self.len = [{}], [-1], [0]
        last = 0
        for w in seq:
            cur = len(self.next)
            self.next.append({})
            self.link.append(0)
            self.len.append(self.len[last] + 1)
            p = last
            while p != -1 and w not in self.next[p]:
                self.next[p][w] = cur
                p = self.link[p]
            if p != -1:
                q = self.next[p][w]
                if self.len[p] + 1 == self.len[q]:
                    self.link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.link.append(self.link[q])
                    self.len.append(self.len[p] + 1)
                    while p != -1 and self.next[p].get(w) == q:
                        self.next[p][w] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def match_lengths(self, seq: list[str]) -> list[int]:
        """Longest run of the prompt that ends at each word of seq."""
        out, state, n = [], 0, 0
        for w in seq:
            while state and w not in self.next[state]:
                state = self.link[state]
                n = self.len[state]
            if w in self.next[state]:
                state = self.next[state][w]
                n += 1
            else:
                state, n = 0, 0
            out.append(n)
        return out


def copied_coverage(prompt: list[str], answer: list[str], least: int = 2) -> tuple[float, int]:
    """Share of the answer's words inside runs copied from the prompt, and the longest such run."""
    if not prompt or not answer:
        return 0.0, 0
    lengths = SuffixAutomaton(prompt).match_lengths(answer)
    least = min(least, len(prompt))
    covered, reach = 0, len(answer)
    for i in range(len(answer) - 1, -1, -1):
        if lengths[i] >= least:
            reach = min(reach, i - lengths[i] + 1)
        covered += reach <= i
        reach = len(answer) if reach >= i else reach
    return covered / len(answer), max(lengths)


@functools.lru_cache(maxsize=1)
def refusal_automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for p in re.split(r"[;\n]", REFUSALS):
        if p := p.strip():
            a.add_word(f" {' '.join(words(p))} ", p)
    a.make_automaton()
    return a


def language(tokens: list[str]) -> tuple[str | None, int]:
    """The language with most stopword votes and its lead over the next; None without a lead."""
    votes = {k: sum(t in v or t.split("'")[0] in v for t in tokens) for k, v in _stop().items()}
    best = sorted(votes, key=votes.get, reverse=True)
    lead = votes[best[0]] - votes[best[1]]
    return (best[0], lead) if lead > 0 else (None, 0)


@functools.lru_cache(maxsize=1)
def _stop() -> dict[str, frozenset[str]]:
    return {k: frozenset(v.split()) for k, v in STOPWORDS.items()}


def declines_by_class(tokens: list[str]) -> bool:
    """An automaton over word classes: the speaker, then a refusal and an act of answering, each at most REACH words on."""
    for i, t in enumerate(tokens):
        if t in SELF:
            for j in range(i + 1, min(len(tokens), i + 1 + REACH)):
                if tokens[j] in DENIES and any(x in ACTS for x in tokens[j + 1 : j + 1 + REACH]):
                    return True
    return False


def is_refusal(answer: str) -> bool:
    """The first sentence declines and nothing of substance follows."""
    sentences = re.split(r"(?<=[.!?])\s+", answer.strip())
    a = refusal_automaton()

    def declines(sentence: str) -> bool:
        w = words(sentence)
        return any(True for _ in a.iter(f" {' '.join(w)} ")) or not SELF.isdisjoint(w) and declines_by_class(w)

    if not any(declines(s) for s in sentences[:2]):
        return False
    rest = [s for s in sentences if not declines(s)]
    return all(len(words(s)) <= 7 and not re.search(r"\d", s) for s in rest)


def is_truncated(answer: str) -> bool:
    """The response ends inside a word or a sentence."""
    s = answer.rstrip()
    if not s:
        return False
    stack = []
    for c in s:
        if c in _CLOSE:
            if stack and _OPEN[stack[-1]] == c:
                stack.pop()
            elif c == "“" and stack:
                stack.pop()
        elif c in _OPEN and not (c == "“" and stack and stack[-1] == "„"):
            stack.append(c)
        elif c == "“" and stack:
            stack.pop()
    line = s.rsplit("\n", 1)[-1].strip()
    item = re.match(r"(?:[-*•–]|\d{1,3}[.)])\s+", line)
    if stack and len(stack) % 2 and not s.endswith(_ENDS):
        return True
    bare = s.rstrip("\"'”»)]")
    if s.endswith("...") or s.endswith("…"):
        return len(words(s)) >= 4
    if bare.endswith(tuple(".!?。")):
        return False
    if s.endswith((",", ";", "-", "(", "/", "&")):
        return True
    if item:
        return False
    last = re.split(r"(?<=[.!?:])\s+", line)[-1]
    tokens = words(last)
    if (len(tokens) > 4 or len(tokens) == 4 and (tokens[0] in BEGINS or len(tokens[-1]) < 3)) and sum(t in v for t in tokens for v in (frozenset().union(*_stop().values()),)) >= 1:
        return True
    # a fragment that begins a new sentence after a whole one
    return bool(tokens) and last != s and "\n" not in s and bool(re.search(r"[.!?]\s+\S+(?:\s+\S+)*$", s)) and len(s) > 60


def defect(query: str | None, answer: str | None) -> str | None:
    if answer is None:
        return "empty"
    bare = "".join(c for c in answer if unicodedata.category(c) not in ("Cf", "Zs", "Cc") or c in " ").strip()
    core = bare.strip("()[]{}<>*_-–—.…·\"'/\\|#~?!:;,= ").lower()
    if core in NO_VALUE and len(bare) < 20:
        return "empty"
    q, a = words(query or ""), words(answer)
    if not a:
        return "empty"
    body = answer
    m = re.match(r"\s*([^:\n]{1,30}):\s*(.+)", answer, re.S)
    if m and " ".join(words(m[1])) in LEADS:
        body = m[2]
    b = words(body)
    coverage, longest = copied_coverage(q, b)
    if q and coverage >= 0.9 and (longest >= 0.8 * len(q)) and len(b) >= 0.8 * len(q):
        return "copied"
    if is_refusal(answer):
        return "refusal"
    asked = next((k for k, v in ASKED.items() for p in v.split("; ") if query and p in query.lower()), None)
    want = asked or language(q)[0]
    got, lead = language(a)
    if want and got and got != want and lead >= 2:
        return "other_language"
    if is_truncated(answer):
        return "truncated"
    return None


def find_defects(df: DataFrame, key: str = "query_id", query: str = "query", answer: str = "answer") -> DataFrame:
    """(key, defect) of each defective pair, once for each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [defect(q, a) for q, a in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            keep = pa.array([x is not None for x in found])
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), pa.array(found, pa.string()).filter(keep)], names=["k", "defect"])

    kind = df.schema[key].dataType.simpleString()
    return spread(df.select(df[key].alias("k"), df[query].alias("q"), df[answer].alias("a"))).mapInArrow(run, f"k {kind}, defect string").distinct().withColumnRenamed("k", key)


def p3_found(spark, sf_dir: str) -> DataFrame:
    return find_defects(table(spark, sf_dir, "query_log"))


def p3_defect_rates(spark, sf_dir: str) -> DataFrame:
    """Defects by collection."""
    log = table(spark, sf_dir, "query_log")
    once = log.select("query_id", "collection_name").distinct()
    return once.join(p3_found(spark, sf_dir), "query_id", "left").groupBy("collection_name", "defect").agg(F.count("*").alias("n"))
