"""Problem 1: personal information inside free text -> typed placeholders.

Grammars only propose: an at sign with what stands around it, runs of digits and codes, streets beside a house number
with their other parts, pairs of words in the form of a name. What a proposal reveals is estimated from the corpus.

1. One pass over the texts writes all proposals with their terms: for names the given word and the family word, for the
   other types the shape (digits as 9, or the parts of an address), for addresses the word that may be the town, and for
   all the two words in front. Texts are not read again.
2. Seeds are proposals that are protected beyond doubt: names whose given name is tabled or which follow a title, numbers
   and addresses of a complete form. Over all texts the co-occurrence of terms with seeds is counted per task and summed.
   A term's disclosure is log2 P(protected | term) / P(protected); words and shapes take their expected cases from the
   contexts in which they stand, so a number of an unknown shape that stands where telephone numbers stand is found.
3. The disclosures of a proposal's terms are added up; above the threshold of its type it is removed. Terms whose
   proposals are hardly ever protected (streets, firms, order numbers) count against it. A word behind a street belongs
   to the address if it reveals a town (it stands beside postcodes elsewhere).
4. `sanitise` replaces spans by typed placeholders; types named in `generalise` keep their coarse part (the domain of an
   e-mail, the country code of a number, the postcode of an address).

A term enters the model if it occurs at least 4 times (a particle of a family: once), whatever the size of the
corpus. Size bounds: terms seen at least SHARE x candidates times are sent to tasks, at most 1/SHARE of each kind;
of the rarer ones the bitmap of `sieve`. Texts in which a decision may hinge on a rarer term give their
proposals instead of spans; these are joined with the rarer terms and judged then. Otherwise only counts per term
and the final spans are shuffled. Null and empty texts have no spans; texts are read whole. Parts of an address stand
within REACH characters of its street.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm import sieve
from paperloom.llm.addresses import REGIONS
from paperloom.llm.names import fold
from paperloom.llm.pairs import STOPWORDS
from paperloom.session import cut, spread, table

SHARE = 1e-5
#: Entries after which a task hands on its counts, and texts whose proposals make one row.
FLUSH, TEXTS = 300_000, 500
REACH = 160
#: Bits above which a proposal of each type is removed.
THRESHOLDS = {"email": -2.0, "phone": 0.0, "id_number": 0.0, "address": -2.0, "person": 0.0}
# Titles in front of a name; particles of family names; words that are no part of a name.
TITLES = {"mr", "mrs", "ms", "miss", "dr", "prof", "herr", "frau", "herrn", "mme", "mlle", "m", "monsieur", "madame", "sr", "sra", "srta", "don", "doña", "señor", "señora", "dear"}
PARTICLES = {"van", "von", "de", "del", "der", "den", "du", "di", "da", "zu", "la"}
NEVER = set(
    "monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december "
    "montag dienstag mittwoch donnerstag freitag samstag sonntag januar februar märz mai juni juli oktober dezember inc llc ltd gmbh corp co company corporation limited "
    "the on at in by as for please server order invoice ssn dni room batch firmware version isbn"
    " tel telefon email mail uhr pm am".split()
)

# ---- e-mail
_AT = re.compile(r"@|[\[(]\s?at\s?[\])]", re.I)
_DOT = r"(?:\.|\s?[\[(]\s?dot\s?[\])]\s?)"
_LOCAL = re.compile(rf"[\w+%-]+(?:{_DOT}[\w+%-]+)*\s?$", re.I)
_DOMAIN = re.compile(rf"\s?[\w-]+(?:{_DOT}[\w-]+)*{_DOT}[A-Za-z]{{2,}}(?![\w@])", re.I)

# ---- numbers
_NUMBER = re.compile(r"(?<![\w,+:#-])(?<![\w]\.)(?:\+|\(\+?)?\d(?:\d|[.\-/](?=[\d(])|\)[-.\s]?(?=\d)|\)\s?(?=\d)|\((?=\d)|\s/\s?(?=\d)|\s(?=[\d(]))*(?<=\d)(?![\w])")
_DATE = re.compile(r"(?:\d{4}([-./])(?:0?\d|1[0-2])\1[0-3]?\d|[0-3]?\d([-./])[0-3]?\d\2(?:19|20)\d\d)")
_US = re.compile(r"(?:\+?1[\s.-]?)?(?:\([2-9]\d\d\)\s?|[2-9]\d\d[\s.-]?)[2-9]\d\d[\s.-]?\d{4}")
_SSN = re.compile(r"\d{3}-\d\d-\d{4}|\d{3}\s\d\d\s\d{4}|9\d{8}")
_TAX = re.compile(r"\d\d\s\d{3}\s\d{3}\s\d{3}")
_CODE = re.compile(r"(?<![\w-])(?:[A-Z]{2}[\s-]?\d\d[\s-]?\d\d[\s-]?\d\d[\s-]?[A-D]|[A-Z]\d{8}|[A-Z]{2}\d{7}|\d{8}-?[A-Z]|\d\d\.\d{3}\.\d{3}-?[A-Z]|[XYZ]\d{7}[A-Z]|[A-Z]{5}\d{5}[A-Z][A-Z0-9])(?![\w-])")

# ---- addresses
_NUM = r"\d{1,5}[A-Da-d]?"
_W = r"[A-ZÀ-Þ][\w'’]+"
_EN = r"(?:street|str|st|avenue|avenu|ave|av|boulevard|blvd|boul|court|crt|ct|drive|drv|dr|lane|ln|la|road|rd|place|square|terrace|way|close|crescent|parkway)"
_ENGLISH_ANY = re.compile(rf"(?<![\w.-]){_NUM}\s+(?:(?:North|South|East|West|NORTH|SOUTH|EAST|WEST|[NSEW]\.?)\s+)?(?:{_W}\s+){{1,3}}?(?i:{_EN})\b\.?")
_ROMANCE_ART = r"(?:(?:de|du|des|del|la|las|le|les|los|el)\s+|(?:d|l)['’]\s?)"
_FRENCH = re.compile(rf"(?<![\w.-]){_NUM}\s*,?\s+(?i:rue|r\.|avenue|av\.|boulevard|bd|place|quai|chemin|impasse|all[ée]e)\s+(?i:{_ROMANCE_ART})*{_W}(?:\s+{_W})?")
_SPANISH = re.compile(rf"(?<!\w)(?i:calle|c/|cl\.|c\.|avenida|avda\.?|plaza|paseo|camino)\s*(?i:{_ROMANCE_ART})*{_W}(?:\s+{_W})?\s*,?\s*(?i:n[ºo°]\.?\s*)?{_NUM}\b")
_GERMAN = re.compile(rf"(?<!\w)[A-ZÄÖÜ][\wäöüß]{{2,}}(?i:-?str(?:a(?:ß|ss|s)e|\.|)|-?stra?ß?s?e|weg|gasse|allee|platz)\s+{_NUM}\b")
_GERMAN_ZIP = re.compile(rf"(?<!\w)[A-ZÄÖÜ][\wäöüß-]{{6,}}\.?\s+{_NUM}(?=(?:\s*[,;]\s*|\s+[-–]\s+|\s+)(?:(?i:etage|et\.|stock)\s+\d+(?:\s*[,;]\s*|\s+[-–]\s+|\s+))?\d{{5}}\s)")
_ZIP_AHEAD = re.compile(r"[^\n]{1,40}?\d{5}\s|\s*\n\s*\d{5}\s")
_SEP = r"(?:\s*[,;]\s*|\s+[-–]\s+|\s+)"
_UNIT = r"(?:(?i:suite|ste|unit|unt|apt|floor|flr|fl|bureau|bur|[ée]tage|et|stock|planta|pl|piso|u)\.?\s*\d{1,3}\b|#\s?\d{1,3}\b)"
_UK = r"[A-Z]{1,2}\d[A-Z\d]?\s?\d[A-Z]{2}\b"
_REGION = r"(?:" + "|".join(sorted(x.upper() for x in REGIONS)) + r")\b"
_COUNTRY = r"(?:USA\b|U\.\s?S\.\s?A\.|U\.\s?S\.|US\b|UK\b|U\.K\.|GB\b|(?i:united states(?: of america)?|united kingdom|great britain|germany|deutschland|france|frankreich|spain|españa|spanien)\b|DE\b|FR\b|ES\b)"
_TOWN = r"[A-ZÀ-Þ][\w'’]{4,}\b"
_SURE_TOWN = r"[A-ZÀ-Þ][\w'’]+(?:[ -][A-ZÀ-Þ][\w'’]+){0,2}\b"  # beside a postcode or region
_RIGHT = re.compile(rf"(?P<unit>{_SEP}{_UNIT})|(?P<zip>{_SEP}\d{{5}}\b(?P<ziptown>{_SEP}[A-ZÀ-Þ][\w'’]{{2,}}\b)?)|(?P<uk>{_SEP}{_UK})|(?P<region>{_SEP}{_REGION})|(?P<country>{_SEP}{_COUNTRY})|(?P<town>{_SEP}{_SURE_TOWN}(?=\s*[,;]?\s*(?:\d{{5}}\b|{_UK}|{_REGION}))|\s*[,;]\s*{_TOWN}|\s+[-–]\s+{_TOWN}|\n\s*{_TOWN})")
_WEAK = re.compile(r"(?:\s+|\s*[,;]\s*)([A-ZÀ-Þ][\w'’]+)\b")
_ENGLISH_ZIP = re.compile(rf"(?<![\w.-]){_NUM}\s+(?:{_W}\s+){{1,3}}{_W}\.?(?={_SEP}(?:{_UNIT}{_SEP})?{_TOWN}{_SEP}(?:{_REGION}|{_UK}))")
_LEFT = re.compile(
    rf"(?:\d{{5}}{_SEP}{_SURE_TOWN}{_SEP}(?:{_UNIT}{_SEP})?|(?:{_TOWN}{_SEP})?(?:{_REGION}{_SEP})?(?:\d{{5}}|{_UK}){_SEP}(?:{_REGION}{_SEP})?(?:{_UNIT}{_SEP})?|(?:{_TOWN}\s*[,;]\s*)?{_REGION}{_SEP}(?:{_UNIT}{_SEP})?|{_UNIT}{_SEP}(?:{_REGION}{_SEP})?)$"
)
_LEFT_TOWN = re.compile(rf"({_TOWN})(\s*[,;]\s*|\s+[-–]\s+)(?:{_UNIT}{_SEP})?$")
_HOUSE = re.compile(r"(?<![\w.-])\d{1,5}[A-Da-d]?\b(?![.,]\d)")
_CAPITAL = re.compile(r"[A-ZÀ-Þ]")
_SMALL = {w for v in STOPWORDS.values() for w in v.split()}
_LOWER = re.compile(r"(?<![\w.-])(?:\d{1,5}[a-d]?,?\s+(?:[a-zß-ÿ'’.]+\s+){1,5}?(?:street|str|avenue|avenu|ave|av|boulevard|boul|blvd|court|crt|ct|drive|drv|dr|lane|ln|la|road|rd)\b|\d{1,5}[a-d]?,?\s+(?:rue|r\.)\s+d|(?:calle|c/|cl\.|c\.)\s*de[^\d\n]{1,40}\d|[a-zß-ÿ]{3,}(?:stra(?:ß|ss|s)e|str\.?)\s+\d)")
_LOWER_POST = re.compile(r"\b(?:\d{5}|[a-z]{1,2}\d[a-z\d]?\s?\d[a-z]{2})\b|,\s*(?:" + "|".join(sorted(REGIONS - {"de", "la", "in", "or", "me", "hi", "ok", "co", "id", "ma", "pa", "al"})) + r")\b|,\s*(?:or|pa|co)(?=[\s,;]*\d{5})|,\s*(?:or|pa|co)(?=\s*(?:;|$))")


def _behind(p: re.Pattern, t: str, end: int, width: int) -> re.Match | None:
    """A match that ends at `end`, from as far in front as it reaches."""
    while True:
        lo = max(0, end - width)
        m = p.search(t, lo, end)
        if m is None or m.start() > lo + width // 2 or lo == 0:
            return m
        width *= 2


def emails(t: str) -> list[tuple[int, int]]:
    out = []
    for m in _AT.finditer(t):
        right = _DOMAIN.match(t, m.end())
        left = _behind(_LOCAL, t, m.start(), 90) if right else None
        if left:
            out.append((left.start(), right.end()))
    return out


def number_proposals(t: str) -> list[tuple[str, int, int, bool]]:
    """(type, start, end, of a complete form) of phone and identity numbers and of what may be one."""
    out = [("id_number", m.start(), m.end(), True) for m in _CODE.finditer(t)]
    for m in _NUMBER.finditer(t):
        s, a = m[0], m.start()
        if len(s) < 7 or (digits := sum(map(str.isdigit, s))) < 7:
            continue
        # a number of a list or line in front of the real one
        while (cutoff := re.match(r"\d{1,8}\s+(?=[\d(+])", s)) and not _SSN.fullmatch(s) and not _TAX.fullmatch(s) and s[0] not in "0+(" and not _US.fullmatch(re.sub(r"\s+", " ", s)):
            a, s = a + cutoff.end(), s[cutoff.end() :]
        digits = sum(map(str.isdigit, s))
        if digits < 7 or digits > 16 or _DATE.match(s) or s.count("(") != s.count(")"):
            continue
        if _SSN.fullmatch(s) or _TAX.fullmatch(s):
            out.append(("id_number", a, a + len(s), True))
            continue
        if s[0] == "+" or s.startswith(("00", "(+")):
            sure = 10 <= digits <= 15
        elif s[0] == "0" or s.startswith("(0"):
            sure = 9 <= digits <= 12
        else:
            sure = digits >= 9 and bool(_US.fullmatch(re.sub(r"\s+", " ", s)))
        out.append(("phone", a, a + len(s), sure))
        if not sure:
            out.append(("id_number", a, a + len(s), False))
    return out


def numbers(t: str) -> list[tuple[str, int, int]]:
    """Phone and identity numbers of a complete form."""
    return [x[:3] for x in number_proposals(t) if x[3]]


def shape(s: str) -> str:
    """Digits as 9, but for a leading 0 or 1, and letters as A; any white space as one blank."""
    x = re.sub(r"[A-Za-z]", "A", re.sub(r"\d", "9", re.sub(r"\s+", " ", s)))
    return s[0] + x[1:] if s[0] in "01" else x


Address = tuple[int, int, str, str, int, bool]  # start, end, parts, word that may be the town, end with it, whether it is by default


def address_proposals(t: str) -> list[Address]:
    """Addresses in mixed or upper case, and those in lower case that have a postcode."""
    out = cased_addresses(t)
    for n in _HOUSE.finditer(t):
        a, e = n.span()
        m = _LOWER.match(t, a) if t[e : e + 4].lstrip(" ,\n")[:1].islower() else None
        if m is None and t[a - 1 : a].isspace():
            m = next((x for x in _LOWER.finditer(t, max(0, a - 45), e) if x.end() > a), None)
        if m is None:
            continue
        if any(x[0] <= m.start() < x[1] for x in out):
            continue
        lo, hi = max(0, m.start() - REACH), min(len(t), m.end() + REACH)
        window = t[lo:hi]
        sure = not window[m.start() - lo : m.end() - lo][:1].isdigit()  # the word for the street is unmistakable
        if not sure and not _LOWER_POST.search(window):
            continue
        cased = re.sub(r"\b[a-z]{1,2}\d[a-z\d]?\s?\d[a-z]{2}\b", lambda w: w[0].upper(), window)
        cased = re.sub(r"(?<=[\s,;])([a-z]{2})(?=[\s,;]+\d{5}\b)|(?<=,)\s*[a-z]{2}(?=\s*(?:[;.]|$))", lambda w: w[0].upper() if w[0].strip() in REGIONS else w[0], cased)
        cased = re.sub(r"[^\W\d_]+", lambda w: w[0].upper() if len(w[0]) == 2 and w[0] in REGIONS and w[0] not in _SMALL else w[0].capitalize() if w[0].islower() and w[0] not in _SMALL else w[0], cased)
        if len(cased) != len(window):
            continue
        for a, e, parts, town, end, _ in cased_addresses(cased, True):
            s = window[a:e]
            if a <= m.end() - lo and e >= m.start() - lo and (sure or _LOWER_POST.search(s)) and not any(a + lo < x[1] and e + lo > x[0] for x in out):
                out.append((a + lo, e + lo, parts, town, end + lo, False))
    return out


def addresses(t: str) -> list[tuple[int, int]]:
    """Spans of the proposals without a corpus; a word behind the street is its town if the sentence goes on in lower case."""
    return [(a, end if by_default else e) for a, e, _, _, end, by_default in address_proposals(t)]


def cased_addresses(t: str, lowered: bool = False) -> list[Address]:
    """`lowered` if the capitals of `t` are made up."""
    anchors = []
    for n in _HOUSE.finditer(t):  # every street stands beside a house number
        a, e = n.span()
        after = t[e : e + 4].lstrip(" ,\n")[:1]
        if after.isupper():
            anchors += [(*m.span(), True) for p in (_ENGLISH_ANY, _ENGLISH_ZIP) if (m := p.match(t, a))]
        if after in "rRaAbBpPqQcCiI" and (m := _FRENCH.match(t, a)):
            anchors.append((*m.span(), True))
        if (t[a - 1 : a].isspace() or t[a - 1 : a] in ",º°.") and _CAPITAL.search(t, max(0, a - 40), a):
            lo = max(0, a - 60)
            for p in (_SPANISH, _GERMAN):
                anchors += [(m.start() + lo, m.end() + lo, p is _SPANISH) for m in p.finditer(t[lo:e]) if m.end() + lo == e]
            if _ZIP_AHEAD.match(t, e):
                anchors += [(*m.span(), False) for m in _GERMAN_ZIP.finditer(t, lo, e + 40) if m.end() == e]
    out: list[Address] = []
    for a, e, proper in sorted(anchors, key=lambda x: (x[0], -x[1])):
        if out and a < out[-1][1]:
            continue
        town = ""
        weak: tuple[str, int] | None = None
        had: set[str] = set()
        while m := _RIGHT.match(t, e):
            kind = m.lastgroup if m.lastgroup != "ziptown" else "zip"
            if m["ziptown"]:
                # a capitalised word after the postcode is the town only if none came before, and starts no sentence
                gap = m["ziptown"]
                word = re.search(r"[\w'’]+$", gap)[0]
                if lowered and not town and not re.match(r"\s*(?:[,;.\n]|$)", t[m.end() :]):
                    weak = word, m.end()
                    e = m.start("ziptown")
                    had.add("zip")
                    break
                if town or fold(word) in _SMALL or fold(word) in NEVER or (re.match(r"\s+[A-Z][a-z]", gap) and re.match(r"\s+(?:a|the|of|to|in|on|and|will|was|is|the)\b", t[m.end() :]) and "region" in had):
                    e = m.start("ziptown")
                    had.add("zip")
                    continue
                town = word
            if kind in had or kind in ("zip", "uk") and had & {"zip", "uk"} or kind == "town" and town:
                break
            if kind == "town":
                town = m[0].strip(" \t\n,;-–")
            had.add(kind)
            e = m.end()
        lo = max(0, a - 70)
        if m := _LEFT.search(t, lo, a) if t[a - 2 : a].strip(" \t") or t[a - 1 : a] == "\n" else None:
            part = t[m.start() : a]
            dup = re.search(r"\d{5}|" + _UK, part) and had & {"zip", "uk"}
            if not dup and not (m.start() > 0 and t[m.start() - 1].isalnum()):
                a = m.start()
                had |= {"zip"} if re.search(r"\d{5}|" + _UK, part) else {"region"}
                if not town and (m2 := _LEFT_TOWN.search(t, lo, a)) and re.search(r"\d|[A-Z]{2}", part):
                    a, town = m2.start(), m2[1]
        elif not town and (m := _LEFT_TOWN.search(t, lo, a)) and fold(m[1]) not in NEVER and not (m.start() > 1 and t[m.start() - 2] in ".!?"):
            a, town = m.start(), m[1]
        while e > a and t[e - 1] in ".,;" and not (t[e - 1] == "." and re.match(r"[,;]|\s+[a-z]", t[e : e + 3])) and not re.search(r"(?:U\.S\.|U\.K\.|U\.\s?S\.\s?A\.)$", t[a:e]):
            e -= 1
        end, by_default = e, False
        if weak and not town:
            town, end = weak
        elif not town and not had & {"zip", "uk", "region"} and (m := _WEAK.match(t, e)) and fold(m[1]) not in NEVER and fold(m[1]) not in _SMALL:
            # a proper noun in the middle of a sentence; in German every noun has a capital
            town, end, by_default = m[1], m.end(), proper and m[0][0].isspace() and len(m[1]) > 2 and bool(re.match(r"\s+[a-zß-ÿ]", t[m.end() :]))
        parts = "+".join(x for x in ("unit", "zip", "uk", "region", "country") if x in had) + ("+town" if town and end == e else "")
        out.append((a, e, parts, fold(town), end, by_default))
    return out


# ---- names
_CAP = re.compile(r"[A-ZÀ-Þ](?:[\w'’]|-(?=\w))*")
_GAP = re.compile(r"(\.?)([ \t]*\n?[ \t]*)((?:(?:van|von|de|del|der|den|du|di|la)\s+)*)$")
_BEFORE_PARTICLE = re.compile(r"(?<!\w)(?:(?:van|von|de|del|der|den|du|VAN|VON|DE|DEL|Van|Von|De)\s+)+$")


def candidates(t: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, given, family) of every pair in the form of a name; a comma leads the family of an inverted one."""
    caps = [(m.start(), m.end(), m[0]) for m in _CAP.finditer(t)]
    # upper-case particles are glue
    caps = [c for c in caps if not (c[2].lower() in PARTICLES and (c[2].isupper() or c[2] in ("Van", "Von")))]
    n = len(caps)

    def link(i: int, j: int) -> str | None:
        gap = t[caps[i][1] : caps[j][0]]
        if gap == " " or gap == "\n":
            return "s"
        if len(gap) > 24:
            return None
        g = gap.lower()
        m = _GAP.fullmatch(g)
        if not m or not m[2] and not m[1]:
            return None
        if m[1] and len(caps[i][2]) > 1:
            return None
        return "p" if m[3] else "s"

    for i in range(n):
        s, e, w = caps[i]
        # forward: given [initial] family
        if i + 1 < n and (k := link(i, i + 1)):
            j = i + 1
            if len(caps[j][2]) == 1 and j + 1 < n and k == "s" and link(j, j + 1):
                j += 1
            f = caps[j][2]
            if len(f) > 2 and (len(w) == 1 or w.lower() not in TITLES):
                yield s, caps[j][1], w, f
        # inverted: family, given [initial]
        if i + 1 < n and len(w) > 2:
            gap = t[e : caps[i + 1][0]]
            if gap[:1] == "," and re.fullmatch(r",\s{1,2}", gap):
                j = i + 1
                end = caps[j][1]
                if len(caps[j][2]) == 1 and t[end : end + 1] == ".":
                    end += 1
                if j + 1 < n and len(caps[j + 1][2]) == 1 and link(j, j + 1):
                    end = caps[j + 1][1] + (t[caps[j + 1][1] : caps[j + 1][1] + 2] in (". ", ".,") and not re.match(r"\.\s+[A-Z]", t[caps[j + 1][1] :]))
                m = _BEFORE_PARTICLE.search(t, max(0, s - 16), s)
                a = m.start() if m else s
                yield a, end, caps[j][2], "," + w


_DE = re.compile(r"(de|del|du)\s+", re.I)


def front(t: str, s: int) -> str:
    """The two words in front, digits as 9."""
    ws = t[max(0, s - 40) : s].split()[-2:]
    return re.sub(r"\d+", "9", " ".join(ws)).lower()


def titled(t: str, s: int) -> bool:
    ws = t[max(0, s - 14) : s].split()
    return bool(ws) and ws[-1].rstrip(".").lower() in TITLES and ws[-1].lower() != "m"


Fixed = tuple[str, int, int, str, str, bool, str, int, bool]  # type, start, end, shape, front, seed, town, end with it, by default


def proposals(t: str) -> list[Fixed]:
    """What the grammars of e-mails, numbers and addresses find."""
    out: list[Fixed] = []
    for a, e in emails(t):
        out.append(("email", a, e, re.sub(r"[\w%+-]+", "w", re.sub(r"\s+", " ", t[a:e])), front(t, a), True, "", e, False))
    for a, e, parts, town, end, by_default in address_proposals(t):
        out.append(("address", a, e, parts, front(t, a), "zip" in parts or "uk" in parts or "region" in parts, town, end, by_default))
    for kind, a, e, sure in number_proposals(t):
        out.append((kind, a, e, shape(t[a:e]), front(t, a), sure, "", e, False))
    return out


def extract(records: DataFrame) -> DataFrame:
    """(found binary): the proposals of some hundred texts, a list of (record_table, record_id, fixed, names)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, str] = {}

        def low(w: str) -> str:
            if w not in memo:
                if len(memo) > FLUSH:
                    memo.clear()
                memo[w] = fold(w.strip(",."))
            return memo[w]

        def packed(some: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([zlib.compress(pickle.dumps(some, 5), 1)], pa.binary())], names=["found"])

        some: list = []
        for b in batches:
            for rt, rid, t in zip(*(c.to_pylist() for c in b.columns)):
                fixed = proposals(t)
                people = []
                for s, e, a, z, inverted, behind, particle in forms(t, low):
                    f = z if inverted else t[s:e].rsplit(None, 1)[-1]
                    m = None if inverted or " d" not in t[s:e].lower() and "\nd" not in t[s:e].lower() else re.search(rf"(?<!\w)(de|del|du)\s+{re.escape(f)}$", t[max(0, e - len(f) - 6) : e], re.I)
                    people.append((s, e, a, z, inverted, behind, particle, f"{m[1].lower()} {z}" if m else "", front(t, s), titled(t, s)))
                if fixed or people:
                    some.append((rt, rid, fixed, people))
                    if len(some) >= TEXTS:
                        yield packed(some)
                        some = []
        if some:
            yield packed(some)

    return spread(records.select("record_table", "record_id", "text")).mapInArrow(run, "found binary")


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for x in b.column(0).to_pylist():
            yield from pickle.loads(zlib.decompress(x))


def term_counts(found: DataFrame, given: set[str]) -> DataFrame:
    """(kind, term, ctx, n, pos) over all proposals: terms with the context in front, and how many are seeds.

    Kinds: A given and B family words, L contexts of names; S shapes and F contexts of the other types, led by the type;
    T towns; I, O and the types themselves are totals; P particles of families.
    """
    shared = found.sparkSession.sparkContext.broadcast(given)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = shared.value
        n: Counter = Counter()
        pos: Counter = Counter()

        def counted() -> pa.RecordBatch:
            keys = list(n)
            out = pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], pa.string()) for i in range(3)] + [pa.array([n[k] for k in keys], pa.int64()), pa.array([pos[k] for k in keys], pa.int64())], names=["kind", "term", "ctx", "n", "pos"])
            n.clear()
            pos.clear()
            return out

        for _, _, fixed, people in _opened(batches):
            for _, _, a, z, inverted, _, _, own, ctx, title in people:
                seed = title or a in given
                for key in (("L", "", ctx), ("A", a, ctx), ("B", z, ctx), ("I" if inverted else "O", "", "")):
                    n[key] += 1
                    if seed:
                        pos[key] += 1
                if own and seed:
                    n[("P", own, "")] += 1
            for kind, _, e, form, ctx, seed, town, end, _ in fixed:
                for key in (("F", "", f"{kind} {ctx}"), ("S", f"{kind} {form}", f"{kind} {ctx}"), ("N", kind, "")):
                    n[key] += 1
                    if seed:
                        pos[key] += 1
                if town:
                    n[("T", town, "")] += 1
                    pos[("T", town, "")] += seed and end == e
            if len(n) > FLUSH:
                yield counted()
        yield counted()

    return found.mapInArrow(run, "kind string, term string, ctx string, n bigint, pos bigint").groupBy("kind", "term", "ctx").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))


def disclosure(found: DataFrame, given: set[str], share: float = SHARE) -> tuple[dict[tuple[str, str], float], DataFrame | None]:
    """Bits by which each frequent term reveals a case, the base log-odds of each type under ("", type), "" for persons;
    and (kind, term, bits) of the rarer ones, if there can be any."""
    counts = cut(term_counts(found, given))
    totals = {(r.kind, r.term): (r.n, r.pos) for r in counts.where("kind in ('I', 'O', 'N')").select("kind", "term", "n", "pos").collect()}  # a row a type
    some = [v for k, v in totals.items() if k[0] != "N"]
    sizes = {"": (sum(x[0] for x in some), sum(x[1] for x in some))} | {k[1]: v for k, v in totals.items() if k[0] == "N"}
    bases = {k: min(0.95, max(0.01, pos / max(1, n))) for k, (n, pos) in sizes.items()}
    n = sum(x[0] for x in sizes.values()) or 1
    base = F.create_map(*[F.lit(x) for kv in bases.items() for x in kv])
    kind_of = F.when(F.col("kind").isin("F", "S"), F.substring_index(F.when(F.col("kind") == "F", F.col("ctx")).otherwise(F.col("term")), " ", 1)).otherwise("")
    counts = counts.where("kind not in ('I', 'O', 'N')").withColumn("base", F.when(F.col("kind") == "T", 0.5).otherwise(base[kind_of]))
    ctx = counts.where("kind in ('L', 'F')").select(F.col("kind").alias("ck"), "ctx", ((F.col("pos") + 4 * F.col("base")) / (F.col("n") + 4)).alias("p"), F.col("n").alias("cn"))
    words = counts.where("kind in ('A', 'B', 'S')").withColumn("ck", F.when(F.col("kind") == "S", "F").otherwise("L")).join(ctx, ["ck", "ctx"], "left")
    # a context of its own word only says nothing beyond the seed
    expected = F.greatest(F.col("pos").cast("double"), F.col("n") * F.when(F.col("cn") > 2 * F.col("n"), F.col("p")).otherwise(F.lit(0.0)))
    terms = words.groupBy("kind", "term", "base").agg(F.sum("n").alias("n"), F.sum(expected).alias("pos"))
    plain = counts.where("kind in ('L', 'F', 'T')").select("kind", F.when(F.col("kind") == "T", F.col("term")).otherwise(F.col("ctx")).alias("term"), "base", "n", F.col("pos").cast("double").alias("pos"))
    particles = counts.where("kind = 'P'").select("kind", "term", "base", "n", F.col("n").cast("double").alias("pos"))
    terms = terms.unionByName(plain).where("n >= 4 or kind = 'S'").unionByName(particles)
    logit = lambda p: F.log2(p / (1 - p))
    p = F.least(F.lit(0.999), F.greatest(F.lit(0.001), (F.col("pos") + 2 * F.col("base")) / (F.col("n") + 2)))
    terms = terms.select("kind", "term", "n", (logit(p) - logit(F.col("base"))).alias("bits"))
    if share * n > 1:
        terms = cut(terms)
    rows = terms.where(F.col("n") >= share * n).toPandas()  # at most 1 / share terms of each kind
    out = {("", k): math.log2(v / (1 - v)) for k, v in bases.items()}
    out |= {(r.kind, r.term): r.bits for r in rows.itertuples()}
    return out, None if share * n <= 1 else terms.where(F.col("n") < share * n).select("kind", "term", "bits")


def forms(t: str, low) -> Iterator[tuple]:
    """(start, end, given, family, inverted, start behind a preposition, particle with family) of the candidates that may be names."""
    for s, e, g, f in candidates(t):
        a, z = low(g), low(f)
        if a in NEVER or z in NEVER or z in TITLES or a in PARTICLES or z in PARTICLES:
            continue
        m = _DE.match(t, s) if f[0] == "," else None
        yield s, e, a, z, f[0] == ",", m.end() if m else s, f"{m[1].lower()} {z}" if m else ""


def clamp(x: float | None, low: float, high: float) -> float:
    return 0.0 if x is None else max(low, min(high, x))


class Hinges(Exception):
    """A decision depends on a term that is not at hand."""


def persons(people, given: set[str], bits: dict, threshold: float, may=None) -> list[tuple[int, int, float]]:
    """(start, end, bits) of the persons; Hinges if that may depend on a term that `may` allows and `bits` lacks."""
    kept: list[tuple[float, int, int]] = []
    base = bits.get(("", ""), 0.0)
    for at, e, a, z, inverted, behind, particle, _, ctx, title in people:
        ab, fb = 6.0 if a in given else bits.get(("A", a)), bits.get(("B", z))
        open_ = False
        if may:
            if ab is None and may("A", a):
                ab, open_ = 6.0, True
            if fb is None and may("B", z):
                fb, open_ = 6.0, True
        if ab is None:
            ab = 0.0 if len(a) == 1 else -1.0
        score = base + clamp(ab, -6.0, 6.0) + clamp(fb, -6.0, 6.0) - inverted
        if score + 12.0 <= threshold:
            continue  # no context can make up for it
        lb = bits.get(("L", ctx))
        if lb is None and may and may("L", ctx):
            lb, open_ = 6.0, True
        score += clamp(lb, -4.0, 6.0) + (6.0 if title else 0.0)
        if score > threshold:
            # a preposition, not a particle of this family
            alone = bool(particle) and ("P", particle) not in bits
            if open_ or alone and may and may("P", particle):
                raise Hinges
            kept.append((score, behind if alone else at, e))
    out: list[tuple[int, int, float]] = []
    for score, s, e in sorted(kept, key=lambda x: (-x[0], x[1])):
        if all(e <= a or s >= b for a, b, _ in out):
            out.append((s, e, score))
    return out


def judge(fixed, people, given: set[str], bits: dict, thresholds: dict[str, float], may=None) -> list[tuple[str, int, int, float]]:
    """(type, start, end, bits) of all cases, without overlaps: e-mails, addresses, numbers, then names."""
    out: list[tuple[str, int, int, float]] = []

    def add(kind: str, s: int, e: int, score: float) -> None:
        if all(e <= b or s >= c for _, b, c, _ in out):
            out.append((kind, s, e, score))

    scored = []
    for kind, s, e, form, ctx, _, town, end, by_default in fixed:
        sb = bits.get(("S", f"{kind} {form}"))
        if sb is None and may and may("S", f"{kind} {form}"):
            raise Hinges
        score = bits.get(("", kind), 0.0) + clamp(sb, -6.0, 6.0)
        fb = bits.get(("F", f"{kind} {ctx}"))
        if fb is None and may and (score - 4.0 > thresholds[kind]) != (score + 4.0 > thresholds[kind]) and may("F", f"{kind} {ctx}"):
            raise Hinges
        score += clamp(fb, -4.0, 4.0)
        if score > thresholds[kind]:
            if end > e:
                tb = bits.get(("T", town))
                if tb is None and may and may("T", town):
                    raise Hinges
                e = end if (tb > 0 if tb is not None else by_default) else e
            scored.append((kind, s, e, score))
    order = {"email": 0, "address": 1}
    for x in sorted(scored, key=lambda x: (order.get(x[0], 2), x[1] if x[0] != "id_number" else -1, -x[3], x[1])):
        add(*x)
    for s, e, score in persons(people, given, bits, thresholds["person"], may):
        add("person", s, e, score)
    return out


def given_names(forms: DataFrame) -> set[str]:
    """Folded names of the fixed table of short forms."""
    return {fold(x) for r in forms.select("short_form", "given_name").collect() for x in r}


def find_spans(records: DataFrame, forms_table: DataFrame, thresholds: dict[str, float] = THRESHOLDS, share: float = SHARE) -> DataFrame:
    """(record_table, record_id, pii_type, start_char, end_char, bits) for records (record_table, record_id, text), each once."""
    records = records.where(F.col("text").isNotNull() & (F.length("text") > 3))
    given = given_names(forms_table)
    found = cut(extract(records))
    bits, rare = disclosure(found, given, share)
    shared = records.sparkSession.sparkContext.broadcast((given, bits, sieve.build(rare, F.concat_ws(" ", "kind", "term")) if rare is not None else None))
    names = ["record_table", "record_id", "pii_type", "start_char", "end_char", "bits"]
    schema = "record_table string, record_id bigint, pii_type string, start_char int, end_char int, bits double"
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given, bits, packed = shared.value
        may = (lambda kind, term: sieve.hit(*packed, f"{kind} {term}")) if packed else None

        def unjudged(fixed, people) -> tuple[bytes, list[str]]:
            """What judging needs, and the terms to look up."""
            terms = {k for kind, _, _, form, ctx, _, town, _, _ in fixed for k in (("S", f"{kind} {form}"), ("F", f"{kind} {ctx}"), ("T", town))}
            terms |= {k for _, _, a, z, _, _, p, _, ctx, _ in people for k in (("A", a), ("B", z), ("L", ctx), ("P", p))}
            return pickle.dumps((fixed, people), 5), [f"{k} {x}" for k, x in sorted(terms) if (k, x) not in bits and may(k, x)]

        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [[]] * 8
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [*kinds, pa.binary(), pa.list_(pa.string())])], names=[*names, "rest", "terms"])

        for rt, rid, fixed, people in _opened(batches):
            try:
                rows += [(rt, rid, *x, None, None) for x in judge(fixed, people, given, bits, thresholds, may)]
            except Hinges:
                rows.append((rt, rid, "", 0, 0, 0.0, *unjudged(fixed, people)))
            if len(rows) > 20_000:
                yield batch()
        yield batch()

    once = ["record_table", "record_id", "pii_type", "start_char", "end_char"]
    spans = found.mapInArrow(run, schema + ", rest binary, terms array<string>")
    if rare is None:
        return spans.select(*names).dropDuplicates(once)
    spans = cut(spans)
    key = ["record_table", "record_id"]
    opened = spans.where(F.col("rest").isNotNull()).dropDuplicates(key).select(*key, "rest", "terms")
    asked = opened.select(*key, F.explode("terms").alias("x"))
    learned = asked.join(rare.select(F.concat_ws(" ", "kind", "term").alias("x"), "bits"), "x").groupBy(*key).agg(F.collect_list(F.struct("x", "bits")).alias("learned"))  # a text is bounded
    opened = opened.join(learned, key, "left").select(*key, "rest", "learned")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given, bits, _ = shared.value
        for b in batches:
            rows = []
            for rt, rid, rest, learned in zip(*(c.to_pylist() for c in b.columns)):
                more = {tuple(x["x"].split(" ", 1)): x["bits"] for x in learned or []}
                bits.update(more)
                rows += [(rt, rid, *x) for x in judge(*pickle.loads(rest), given, bits, thresholds)]
                for k in more:
                    del bits[k]
            cols = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return spans.where(F.col("rest").isNull()).select(*names).unionByName(opened.mapInArrow(settle, schema)).dropDuplicates(once)


def records(spark, sf_dir: str) -> DataFrame:
    one = lambda name, key: table(spark, sf_dir, name).select(F.lit(name).alias("record_table"), F.col(key).cast("bigint").alias("record_id"), "text")
    return one("extracted_pages", "page_id").unionByName(one("ner_results", "ner_id")).unionByName(one("ingest_requests", "request_id"))


def p1_found(spark, sf_dir: str) -> DataFrame:
    return find_spans(records(spark, sf_dir), table(spark, sf_dir, "given_name_forms")).drop("bits")


def coarse(kind: str, s: str) -> str:
    """The part of a case that reveals little: domain, country code, postcode; empty if it has none."""
    if kind == "email":
        return s.rsplit("@", 1)[1].strip() if "@" in s else ""
    m = re.match(r"\(?\+\d{1,2}|00\d{2}", s) if kind == "phone" else re.search(r"\b\d{5}\b|\b" + _UK, s) if kind == "address" else None
    return m[0].lstrip("(") if m else ""


def sanitise(text: str | None, found: list[tuple[str, int, int]], generalise: frozenset[str] = frozenset()) -> str | None:
    """The text with each span as a placeholder of its type, with its coarse part for types to `generalise`; the rest stays as it is."""
    if text is None:
        return None
    for kind, s, e in sorted(found, key=lambda x: -x[1]):
        kept = coarse(kind, text[s:e]) if kind in generalise else ""
        text = text[:s] + f"[{kind.upper()}{' ' + kept if kept else ''}]" + text[e:]
    return text


def p1_sanitised(spark, sf_dir: str) -> DataFrame:
    """(record_table, record_id, text) of every record with placeholders, once for each key."""
    r = records(spark, sf_dir).dropDuplicates(["record_table", "record_id"])
    f = p1_found(spark, sf_dir).groupBy("record_table", "record_id").agg(F.collect_list(F.struct("pii_type", "start_char", "end_char")).alias("f"))

    @F.pandas_udf("string")
    def put(text: pd.Series, f: pd.Series) -> pd.Series:
        return pd.Series([sanitise(t, [(x["pii_type"], x["start_char"], x["end_char"]) for x in (v if v is not None else [])]) for t, v in zip(text, f)])

    return r.join(f, ["record_table", "record_id"], "left").select("record_table", "record_id", put("text", "f").alias("text"))
