"""Problem 4: spellings of a field that mean the same person or organisation.

1. Words that stand with many different partners (given names, lines of business) are learned from the
   distinct strings of each field; the rest of a string is its core (family name, coined firm name).
2. Cores are linked by a pigeonhole segment join: a core is cut into k+1 segments, one of which must be
   intact in any core within k edits; position-shifted substrings are looked up in the segment index and
   the few candidates are verified by a banded edit distance (transpositions count as one edit). Each
   core follows its better supported neighbour.
3. Within one core, the other words decide: given names by learned and tabled short forms and by an
   initial that fits one person only, lines of business by abbreviations and at most one dropped word.
   Relatives (other given name, junior) and sister companies (other line of business) stay apart.

Only distinct strings are compared, so a spelling that fills a third of all rows costs no more than any
other. The lexicon, which is sent to tasks, holds words that stand with at least PARTNERS others and with more than those
do on average, whatever the size of the table: its size is that of the given names and lines of business in use, not
of the rows. Cores of LONG letters may differ by two edits, shorter ones by one; cores of one letter are not compared.
Null and blank names have no pairs.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.session import cut, spread, table

#: Partners that a word of the lexicon has at least.
PARTNERS = 6
#: Edits between cores, and for cores of LONG letters.
EDITS, LONG_EDITS, LONG = 1, 2, 10
# Titles, additions and particles of personal names; legal forms; articles.
TITLES = {"mr", "mrs", "ms", "miss", "dr", "prof", "sir", "herr", "frau", "mme", "mlle", "m", "sr", "sra", "srta", "don", "doña", "monsieur", "madame", "señor", "señora"}
JUNIOR = {"jun", "jr", "junior", "ii", "iii", "fils", "hijo"}
SENIOR = {"sen", "senior", "père"}
PARTICLES = {"van", "von", "de", "der", "den", "del", "la", "le", "du", "di", "da", "zu", "mc", "mac"}
LEGAL = {"inc", "incorporated", "corp", "corporation", "llc", "ltd", "limited", "gmbh", "mbh", "ges", "sa", "société", "societe", "anonyme", "co", "company", "plc", "ag", "kg", "sarl", "and", "the", "und", "et", "y"}
PERSON_FIELDS = {"claimant_name"}


def fold(s: str) -> str:
    """Lower case without accents; ß as ss, ligatures apart."""
    s = unicodedata.normalize("NFKD", s.casefold().replace("ø", "o").replace("ł", "l"))
    return "".join(c for c in s if not unicodedata.combining(c))


def split_words(name: str) -> list[str]:
    """Folded words; dotted initials of legal forms are joined, notes in brackets that are no legal form are dropped."""
    s = fold(name).replace("’", "'")
    s = re.sub(r"\b((?:\w\.){2,}\w?)", lambda m: m[1].replace(".", ""), s)
    s = re.sub(r"\(([^)]*)\)", lambda m: f" {m[1]} " if all(w in _FOLDED_LEGAL for w in re.findall(r"\w+", m[1])) else " ", s)
    s = re.sub(r"\b(o|d)'\s*(?=\w)", r"\1", s)
    return re.findall(r"\w+|,", re.sub(r"(?<=\w)-(?=\w)", "", s))


_FOLDED_LEGAL = {fold(w) for w in LEGAL}


def osa(a: str, b: str, k: int) -> int:
    """Edits from a to b with neighbouring transpositions, or k+1 if more than k; only a band of 2k+1 is computed."""
    if abs(len(a) - len(b)) > k:
        return k + 1
    if a == b:
        return 0
    big = k + 1
    before, prev = None, [j if j <= k else big for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        cur = [big] * (len(b) + 1)
        if i <= k:
            cur[0] = i
        for j in range(max(1, i - k), min(len(b), i + k) + 1):
            y = b[j - 1]
            v = min(prev[j - 1] + (x != y), prev[j] + 1, cur[j - 1] + 1)
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            cur[j] = min(v, big)
        if min(cur) > k:
            return big
        before, prev = prev, cur
    return min(prev[len(b)], big)


def segments(n: int, k: int) -> list[tuple[int, int]]:
    """(start, length) of the k+1 nearly equal segments of a string of n characters."""
    base, more = divmod(n, k + 1)
    out, at = [], 0
    for i in range(k + 1):
        size = base + (i >= k + 1 - more)
        out.append((at, size))
        at += size
    return out


def segment_keys(s: str, k: int) -> list[str]:
    """Keys of the k+1 segments of an indexed string: its length, the segment's number and its characters."""
    return [f"{len(s)}:{i}:{s[a : a + n]}" for i, (a, n) in enumerate(segments(len(s), k))]


def probe_keys(s: str, k: int) -> list[str]:
    """Keys under which every string within k edits of `s` has a segment in the index.

    An insertion, deletion or substitution touches one segment, so one of k+1 stays intact at most k places away. A
    transposition touches two if it straddles a joint; it is undone by swapping the characters at the joint in `s`,
    and the swapped string is within k-1 edits.
    """
    forms = {s: k}
    for used in range(1, k + 1):
        for f in [f for f, left in forms.items() if left == k - used + 1]:
            far = k - used
            for length in range(max(2, len(s) - far), len(s) + far + 1):
                for a, _ in segments(length, k)[1:]:
                    for j in range(max(1, a - far), min(len(f) - 1, a + far) + 1):
                        forms.setdefault(f[: j - 1] + f[j] + f[j - 1] + f[j + 1 :], k - used)
    out = set()
    for f, left in forms.items():
        for length in range(max(1, len(f) - left), len(f) + left + 1):
            for i, (a, n) in enumerate(segments(length, k)):
                for at in range(max(0, a - left), min(len(f) - n, a + left) + 1):
                    out.add(f"{length}:{i}:{f[at : at + n]}")
    return sorted(out)


def similar_pairs(strings: DataFrame, by: list[str], col: str, k: int, others: DataFrame | None = None) -> DataFrame:
    """Pairs (by..., a, b), a < b, of distinct strings within k edits (Levenshtein with transpositions).

    With `others` (by..., col) the pairs of a string (a) with another of those (b), in any order.
    A key holds a segment of a (k+1)-th of the string and its length; most candidates are settled by Spark's banded
    distance, where a transposition counts twice, before the exact check.
    """

    def keys(make):
        @F.pandas_udf("array<string>")
        def of(s: pd.Series) -> pd.Series:
            return s.map(lambda x: make(x, k))

        return of

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([osa(x, y, k) <= k for x, y in zip(a, b)], dtype=bool)

    base = strings.select(*by, F.col(col).alias("a")).where(F.length("a") > k)
    right = base.withColumnRenamed("a", "b") if others is None else others.select(*by, F.col(col).alias("b")).where(F.length("b") > 0)
    left = base.select(*by, "a", F.explode(keys(segment_keys)("a")).alias("x"))
    right = right.select(*by, "b", F.explode(keys(probe_keys)("b")).alias("x"))
    pairs = left.join(right, [*by, "x"]).where(F.col("a") < F.col("b") if others is None else F.col("a") != F.col("b"))
    far = F.levenshtein("a", "b", 2 * k)
    pairs = pairs.where(far >= 0).select(*by, "a", "b").distinct()
    return pairs.where((F.levenshtein("a", "b", k) >= 0) | near("a", "b"))


def learn_lexicon(names: DataFrame) -> dict[str, dict[str, int]]:
    """Per field, the words that stand with many different partners, with their number of strings."""
    skip = _FOLDED_LEGAL | TITLES | PARTICLES | JUNIOR

    @F.pandas_udf("array<string>")
    def words(names: pd.Series) -> pd.Series:
        return names.map(lambda s: sorted({w for w in split_words(s) if len(w) > 1 and w not in skip}))

    w = cut(names.select("name_field", "name", F.explode(words("name")).alias("w")))
    counts = w.groupBy("name_field", "w").agg(F.count("*").alias("c"))
    w = w.join(counts, ["name_field", "w"])
    # a word's partner in a string is the rarest other word there
    rare = w.groupBy("name_field", "name").agg(F.slice(F.sort_array(F.collect_list(F.struct("c", "w"))), 1, 2).alias("r"))
    rare = rare.where(F.size("r") == 2).select("name_field", "name", F.col("r")[0]["w"].alias("w1"), F.col("r")[1]["w"].alias("w2"))
    partner = cut(w.join(rare, ["name_field", "name"]).select("name_field", "w", "c", F.when(F.col("w") == F.col("w1"), F.col("w2")).otherwise(F.col("w1")).alias("p")))
    d = partner.groupBy("name_field", "w").agg(F.approx_count_distinct(F.substring("p", 1, 5)).alias("d"), F.first("c").alias("c"))
    # given names and lines of business have more partners than the words that they stand with have
    theirs = partner.join(d.select("name_field", F.col("w").alias("p"), F.col("d").alias("dp")), ["name_field", "p"]).groupBy("name_field", "w").agg(F.avg("dp").alias("dp"))
    lex = d.where(F.col("d") >= PARTNERS).join(theirs, ["name_field", "w"]).where(F.col("d") > F.col("dp"))
    out: dict[str, dict[str, int]] = {}
    for r in lex.select("name_field", "w", "c").collect():
        out.setdefault(r.name_field, {})[r.w] = r.c
    return out


def _abbreviates(short: str, full: str) -> bool:
    """Letters of short in order in full, from the same first letter, at most half as long plus two."""
    if len(short) < 2 or short[0] != full[0] or len(short) >= len(full):
        return False
    if full.startswith(short):
        return True
    it = iter(full)
    plural = short[:-1] if short.endswith("s") and full.endswith("s") else short
    return all(c in it for c in plural) and len(short) <= len(full) - 2 and sum(c in "aeiou" for c in short) <= 2


def _less(w: str) -> set[str]:
    return {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}


class Lexicon:
    """Frequent words of one field, with lookups for abbreviations and single typing errors.

    Words within one edit share a string that one deletion leaves of both, so candidates come from an index of those;
    abbreviations from the words of their first letter.
    """

    def __init__(self, counts: dict[str, int], tabled: frozenset[str] = frozenset()):
        """`tabled` words are never taken for mistyped ones."""
        top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))
        self.words: dict[str, str] = {}
        self.full: list[str] = []
        self.counts = counts
        self.memo: dict[tuple[str, bool, bool], str | None] = {}
        self.near: dict[str, list[str]] = {}
        self.first: dict[str, list[str]] = {}
        self.prefix: dict[str, list[str]] = {}
        for w, c in top:  # rarer words may be shortened or mistyped forms of commoner ones
            self.words[w] = next((f for f in self.alike(w) if counts[f] > 3 * c), w) if len(w) > 3 and w not in tabled else w
            if self.words[w] == w:
                self.full.append(w)
                self.first.setdefault(w[0], []).append(w)
                for x in _less(w):
                    self.near.setdefault(x, []).append(w)
                for n in range(3, len(w)):
                    self.prefix.setdefault(w[:n], []).append(w)

    def alike(self, w: str) -> list[str]:
        """Words within one edit, commonest first."""
        found = {f for x in _less(w) for f in self.near.get(x, ()) if osa(w, f, 1) <= 1}
        return sorted(found, key=lambda f: (-self.counts[f], f))

    def find(self, w: str, abbreviations: bool, dotted: bool = False) -> str | None:
        key = (w, abbreviations, dotted)
        if key not in self.memo:
            hit = self.words.get(w)
            if abbreviations and (hit is None or hit == w):
                longer = [f for f in self.first.get(w[:1], ()) if f != w and _abbreviates(w, f) and (hit is None or self.counts[f] > self.counts.get(w, 0))] if hit or dotted or len(w) > 3 else []
                if longer and len(w) < 8:
                    # the commonest word that starts so, else the commonest that has these letters
                    hit = max(longer, key=lambda f: (f.startswith(w), self.counts[f]))
            if hit is None and len(w) > 3:
                hit = next(iter(self.alike(w)), None)
            if len(self.memo) > 200_000:
                self.memo.clear()
            self.memo[key] = hit
        return self.memo[key]


def parse_organisation(name: str, lex: Lexicon) -> tuple[str, list[str], str]:
    core, lines = [], []
    tokens = [w for w in split_words(name) if w != ","]
    dotted = set(re.findall(r"(\w+)\.", fold(name)))
    for w in tokens:
        if w in _FOLDED_LEGAL:
            continue
        hit = lex.find(w, True, w in dotted)
        if hit:
            lines.append(hit.removesuffix("s"))  # one form for singular and plural
        else:
            core.append(w)
    if not core and lines:
        core, lines = [tokens[0]], lines[1:]
    return "".join(core), sorted(set(lines)), ""


def parse_person(name: str, lex: Lexicon) -> tuple[str, list[str], str]:
    """Family name, given names or initials, and junior or senior."""
    words, tags, clean = split_words(name), "", []
    for i, w in enumerate(words):
        if w in JUNIOR or w in SENIOR:
            if i > 0:
                tags = "jun" if w in JUNIOR else "sen"
                continue
        if w in TITLES and len(w) > 1 and i < 2 and w not in PARTICLES:
            continue
        clean.append(w)
    while clean and clean[-1] == ",":
        clean.pop()
    words = clean
    is_given = lambda w: len(w) == 1 or lex.find(w, False) is not None
    if "," in words:
        at = words.index(",")
        family, given = words[:at], [w for w in words[at + 1 :] if w != ","]
        if len(family) == 1 and is_given(family[0]) and given and not is_given(given[0]):
            family, given = given, family
    else:
        flags = [is_given(w) and w not in PARTICLES for w in words]
        first = next((i for i, f in enumerate(flags) if f and len(words[i]) > 1), None)
        if first is None:
            first = next((i for i, f in enumerate(flags) if f), None)
        if first is None:
            # an unknown given name: the longest word is the family name, with its particles
            end = max(range(len(words)), key=lambda i: len(words[i])) if words else 0
            start = end
            while start > 0 and words[start - 1] in PARTICLES:
                start -= 1
            family, given = words[start : end + 1], words[:start] + words[end + 1 :]
        elif first == 0:
            end = 1
            while end < len(words) - 1 and len(words[end]) == 1:
                end += 1
            given, family = words[:end], words[end:]
        else:
            family, given = words[:first], words[first:]
            tail = [w for w in given if len(w) > 1 and not is_given(w)]
            if tail and len(words[0]) == 1:
                family, given = tail, [w for w in words if w not in tail]
    family = [w for w in family if len(w) > 1] or family
    full = [w for w in given if len(w) > 1]
    first = full[0] if full else (given[0] if given else "")
    # initials in front of the family name after a full given name carry nothing here
    canonical = (lex.find(first, False) or first) if len(first) > 1 else first
    if len(canonical) > 2 and canonical not in lex.counts:
        longer = [f for f in lex.prefix.get(canonical, ()) if lex.counts[f] > 1]
        canonical = longer[0] if len(longer) == 1 else canonical
    return "".join(family), [canonical], tags


def link_names(names: DataFrame, short_forms: DataFrame | None = None) -> DataFrame:
    """(name_field, name, entity) for the distinct (name_field, name, n)."""
    spark = names.sparkSession
    names = cut(names)
    lexicon = learn_lexicon(names)
    known_forms: set[str] = set()
    if short_forms is not None:  # a fixed table of given names
        for r in short_forms.select("short_form", "given_name").collect():
            for f in PERSON_FIELDS:
                for w in (fold(r.given_name), fold(r.short_form)):
                    lexicon.setdefault(f, {}).setdefault(w, 1)
                    known_forms.add(w)
    shared = spark.sparkContext.broadcast((lexicon, frozenset(known_forms)))

    @F.pandas_udf("core string, attrs array<string>, tag string")
    def parse(field: pd.Series, name: pd.Series) -> pd.DataFrame:
        lex: dict[str, Lexicon] = {}
        rows = []
        for f, n in zip(field, name):
            if f not in lex:
                lex[f] = Lexicon(shared.value[0].get(f, {}), shared.value[1])
            rows.append((parse_person if f in PERSON_FIELDS else parse_organisation)(n, lex[f]))
        return pd.DataFrame(rows, columns=["core", "attrs", "tag"])

    parsed = cut(spread(names).withColumn("p", parse("name_field", "name")).select("name_field", "name", "n", "p.*").where(F.length("core") > 0))
    # roots of cores
    cores = cut(parsed.groupBy("name_field", "core").agg(F.sum("n").alias("n"), F.count("*").alias("m")))
    near = similar_pairs(cores, ["name_field"], "core", EDITS)
    near = near.unionByName(similar_pairs(cores.where(F.length("core") >= LONG), ["name_field"], "core", LONG_EDITS)).distinct()
    both = cut(near.select("name_field", F.col("a").alias("core"), F.col("b").alias("to")).unionByName(near.select("name_field", F.col("b").alias("core"), F.col("a").alias("to"))))
    support = cores.select("name_field", F.col("core").alias("to"), F.struct("m", "n", "core").alias("s"))
    best = both.join(support, ["name_field", "to"]).groupBy("name_field", "core").agg(F.max("s").alias("s"))
    own = cores.join(best, ["name_field", "core"], "left")
    up = cut(own.select("name_field", "core", F.when(F.col("s") > F.struct("m", "n", "core"), F.col("s.core")).otherwise(F.col("core")).alias("root")))
    while True:  # a core follows a better supported one, so chains end; each round halves them
        far = up.join(up.select("name_field", F.col("core").alias("root"), F.col("root").alias("r2")), ["name_field", "root"]).select("name_field", "core", "root", F.col("r2"))
        far = cut(far)
        moved = far.where("root <> r2").limit(1).count()
        up = far.select("name_field", "core", F.col("r2").alias("root"))
        if not moved:
            break
    parsed = cut(parsed.join(up, ["name_field", "core"]).withColumn("person", F.col("name_field").isin(*PERSON_FIELDS)))
    keys = cut(parsed.groupBy("name_field", "root", "person", "tag", "attrs").agg(F.sum("n").alias("n")))
    # given names: short forms, tabled and learned from families that have both
    people = keys.where("person").select("name_field", "root", F.col("attrs")[0].alias("g"), "tag", "n").where(F.length("g") > 1)
    seen = cut(people.select("name_field", "root", "g").distinct())
    n_g = cut(seen.groupBy("name_field", "g").agg(F.count("*").alias("n_g")))
    both_g = seen.join(seen.withColumnRenamed("g", "h"), ["name_field", "root"]).where("g <> h").groupBy("name_field", "g", "h").agg(F.count("*").alias("c"))
    alias = both_g.join(n_g, ["name_field", "g"]).join(n_g.withColumnRenamed("g", "h").withColumnRenamed("n_g", "n_h"), ["name_field", "h"])
    alias = alias.where((F.col("c") >= 3) & (F.col("c") >= 0.5 * F.col("n_g")) & (F.col("n_h") > F.col("n_g"))).groupBy("name_field", "g").agg(F.max_by("h", F.struct("c", "h")).alias("full"))
    people_g = seen
    if short_forms is not None:
        tabled = spark.createDataFrame(sorted({(fold(r.short_form), fold(r.given_name)) for r in short_forms.select("short_form", "given_name").collect()}), "g string, h string")  # a fixed table
        # a tabled form counts for a family in which its given name occurs; an ambiguous one for none that has two
        known = seen.join(F.broadcast(tabled), "g").join(seen.withColumnRenamed("g", "h"), ["name_field", "root", "h"]).groupBy("name_field", "root", "g").agg(F.min("h").alias("h"), F.count("*").alias("c")).where("c = 1").select("name_field", "root", "g", "h")
        lone = tabled.groupBy("g").agg(F.min("h").alias("only"), F.count("*").alias("c")).where("c = 1").select("g", "only")
        people_g = seen.join(known, ["name_field", "root", "g"], "left").join(F.broadcast(lone), "g", "left")
    else:
        people_g = seen.withColumn("h", F.lit(None).cast("string")).withColumn("only", F.lit(None).cast("string"))
    people_g = cut(people_g.join(alias, ["name_field", "g"], "left").select("name_field", "root", "g", F.coalesce("h", "full", "only", "g").alias("given")))
    # a rare form in a family with one person is that person
    people_g = people_g.join(n_g, ["name_field", "g"]).withColumn("rare", (F.col("given") == F.col("g")) & (F.col("n_g") < 5))
    lone = people_g.where(~F.col("rare")).groupBy("name_field", "root").agg(F.min("given").alias("lone"), F.countDistinct("given").alias("c")).where("c = 1").drop("c")
    initial = F.substring("given", 1, 1).alias("i")
    alike = people_g.where(~F.col("rare")).groupBy("name_field", "root", initial).agg(F.min("given").alias("alike"), F.countDistinct("given").alias("c")).where("c = 1").drop("c")
    people_g = people_g.join(lone, ["name_field", "root"], "left").withColumn("i", initial).join(alike, ["name_field", "root", "i"], "left")
    people_g = people_g.select("name_field", "root", "g", F.when(F.col("rare"), F.coalesce("lone", "alike", "given")).otherwise(F.col("given")).alias("given"))
    people_g = cut(people_g)
    # an initial means the one person of the family and tag that it fits
    full = people.join(people_g, ["name_field", "root", "g"]).select("name_field", "root", "tag", "given").distinct()
    fits = full.groupBy("name_field", "root", "tag", F.substring("given", 1, 1).alias("g")).agg(F.min("given").alias("given"), F.count("*").alias("c")).where("c = 1").drop("c")
    initials = keys.where("person").select("name_field", "root", "tag", F.col("attrs")[0].alias("g")).where(F.length("g") <= 1).join(fits, ["name_field", "root", "tag", "g"], "left")
    given = people.select("name_field", "root", "tag", "g").join(people_g, ["name_field", "root", "g"]).unionByName(initials.select("name_field", "root", "tag", "g", F.coalesce("given", "g").alias("given")))
    given = given.select("name_field", "root", "tag", F.array("g").alias("attrs"), F.array("given").alias("entity_attrs"))
    # lines of business: at most one word dropped, if only one fuller set fits
    firms = cut(keys.where(~F.col("person")).select("name_field", "root", "attrs", "n"))
    fuller = firms.alias("a").join(firms.alias("b"), ["name_field", "root"]).where((F.size("a.attrs") + 1 == F.size("b.attrs")) & (F.size(F.array_except("a.attrs", "b.attrs")) == 0))
    fuller = fuller.groupBy("name_field", "root", F.col("a.attrs").alias("attrs")).agg(F.max_by("b.attrs", "b.n").alias("entity_attrs"), F.count("*").alias("c"), F.max("a.n").alias("na"), F.max("b.n").alias("nb"))
    lines = firms.join(fuller.where("c = 1"), ["name_field", "root", "attrs"], "left").select("name_field", "root", F.lit("").alias("tag"), "attrs", F.coalesce("entity_attrs", "attrs").alias("entity_attrs"))
    entity = F.concat_ws("|", "root", "tag", F.concat_ws(" ", "entity_attrs"))
    return parsed.join(given.unionByName(lines).distinct(), ["name_field", "root", "tag", "attrs"]).select("name_field", "name", entity.alias("entity"))


def typed_names(spark, sf_dir: str) -> DataFrame:
    """Distinct non-blank strings of the three fields with their number of rows."""
    po = table(spark, sf_dir, "purchase_orders").select(F.lit("vendor").alias("name_field"), F.col("vendor").alias("name"))
    ic = table(spark, sf_dir, "insurance_claims").select(F.explode(F.create_map(F.lit("claimant_name"), "claimant_name", F.lit("insurer_name"), "insurer_name")).alias("name_field", "name"))
    return po.unionByName(ic).where(F.trim("name") != "").groupBy("name_field", "name").agg(F.count("*").alias("n"))


def p4_entities(spark, sf_dir: str) -> DataFrame:
    """(name_field, name, entity), one row per distinct spelling."""
    return link_names(typed_names(spark, sf_dir), table(spark, sf_dir, "given_name_forms"))


def p4_found(spark, sf_dir: str) -> DataFrame:
    e = cut(p4_entities(spark, sf_dir))
    a, b = e.withColumnRenamed("name", "name_a"), e.withColumnRenamed("name", "name_b")
    return a.join(b, ["name_field", "entity"]).where(F.col("name_a") < F.col("name_b")).select("name_field", "name_a", "name_b")
