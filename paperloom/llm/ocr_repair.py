"""Problem 5: noise in text from scanned pages.

1. Words of all pages are counted (per task, then by word), over text, rich_text and blocks; copies of a line count once.
2. Every counted word is run through the vocabulary trie together with a Levenshtein automaton: one plain edit
   (insertion, deletion, substitution, transposition), two for words of LONG letters, and visual confusions, one or two
   characters read as one or two others, as edits of their own; MAX_EDITS in all. This gives all vocabulary
   words that it may stand for, not a guess; they are ranked by cost (a confusion is cheap, a plain edit dear), by how
   often the candidate follows the word in front, and by frequency. A word with a far more frequent reading is a misread;
   one that only plain edits explain must besides stand behind a word that the reading follows elsewhere, as else
   names and inflected words would turn into their neighbours.
3. One pass over the pages finds running heads, page numbers, words broken over lines and the
   occurrences of misread words; a bitmap lets it skip all other words. A head that stands on one page only counts
   if it ends like heads of other files, or within two edits of such an ending (segment join).
4. `repair_text` removes the page furniture, puts the readings in and reflows paragraphs.

Words seen 3 times are vocabulary, whatever the size of the corpus. Numbers are an open class: the automaton of their
confusions is intersected with the form of a number instead of a list (`number_reading`). Size bounds: the trie that is
sent to tasks holds the VOCABULARY most frequent words at most; rarer readings come from joins, of all confusion variants
of a word with the counted words and of strings with deletions, so no reading is lost. Bitmaps are those of `sieve`;
pages are bounded. Strings of more than 100 characters are no words.
Defined cases: null, empty and blank texts and pages that are not scanned have no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm import sieve
from paperloom.llm.names import osa, similar_pairs
from paperloom.session import cut, spread, table

#: Words of the trie that is sent to tasks, at most; readings beyond them come from joins.
VOCABULARY = 100_000
MAX_EDITS = 2
#: Words of this length may have two plain edits.
LONG = 8
#: Cost of a plain edit; a visual confusion costs 1 or 1.5.
PLAIN = 3.0
#: Least count of a reading with plain edits, absolute and for each occurrence of the word.
PLAIN_FLOOR, PLAIN_RATIO = 100, 200
#: Entries after which a task hands on its counts.
FLUSH = 300_000
# What reading confuses, written (as read, as printed).
CONFUSIONS = """
c e; á a; f t; ! i; 0 o; l i; 1 l; 5 s; cl d; ii u; 9 g; rn m; li h; vv w; 6 b; n ri; d cl; m rn; 1 i; 8 b; i l; t f; e c; o 0; à a; ô o; nn m; u ii; h li; w vv; 3 e; 4 a; q g; z 2; 7 t; ó o; í i
"""
PAIRS = [tuple(p.split()) for p in CONFUSIONS.split(";") if p.strip()]
_RARE = {p: 0.5 for p in PAIRS[18:]}  # seen less often
_BY_FIRST: dict[str, list[tuple[str, str, float]]] = {}
for _a, _b in PAIRS:
    _BY_FIRST.setdefault(_a[0], []).append((_a, _b, 1.0 + _RARE.get((_a, _b), 0.0)))
# Characters that end a broken line; words before which a hyphen stands for an omitted part.
HYPHENS = "-¬‐­"
SUSPENDED = {"and", "or", "und", "oder", "et", "ou", "y", "o", "e", "u", "to", "bis"}
FORM_MARK = "--- FORM FIELDS ---"
_LEFT, _RIGHT = ".,;:?()[]{}\"“”„«»'’…<>|*", ".,;:?!()[]{}\"“”„«»'’…<>|*"
_ITEM = re.compile(r"\s*(?:[-*•]|\d+\.)\s|\s*\d+\s*$|.*\S\s{2,}\S|.*\s-\s\d+\s*$")
_CODE = re.compile(r"[A-Z]{1,2}\d[A-Z\d]?\W*|Ln\W*")
_DIGIT_FOR = {"0": "o", "1": "l", "5": "s", "9": "g", "6": "b", "!": "i", "8": "b"}


def bare(token: str) -> str:
    return token.lstrip(_LEFT).rstrip(_RIGHT).lower()


class Trie:
    """Vocabulary; a node is [children, count of the word that ends there, largest count at or below it]."""

    def __init__(self, counts: dict[str, int]):
        self.root: list = [{}, 0, 0]
        for w, n in counts.items():
            node = self.root
            node[2] = max(node[2], n)
            for c in w:
                nxt = node[0].get(c)
                if nxt is None:
                    nxt = node[0][c] = [{}, 0, 0]
                node = nxt
                if n > node[2]:
                    node[2] = n
            node[1] = n

    def readings(self, word: str, most: int = MAX_EDITS, plain: int | None = None, least: int = 1, least_plain: int = 1) -> list[tuple[str, int, float]]:
        """(vocabulary word, count, cost) of all words within the edits of `word`, itself left out.

        The automaton is a Levenshtein automaton (insertion, deletion, substitution, neighbouring transposition; at most
        `plain` of them, by default one, or two for LONG words) widened by visual confusions; at most `most` edits in all.
        Branches of the trie in which no word is as frequent as `least`, or `least_plain` once a plain edit is used,
        are not entered; words that are follow completely.
        """
        n = len(word)
        if plain is None:
            plain = 2 if n >= LONG else 1
        out: dict[str, tuple[int, float]] = {}
        # states of the product of automaton and trie: position in word, edits, plain edits, cost, node, path
        stack = [(0, 0, 0, 0.0, self.root, "")]
        push = stack.append
        while stack:
            i, k, p, cost, node, path = stack.pop()
            kids, count, top = node
            if i == n:
                if k and count >= (least_plain if p else least) and count and path != word and (path not in out or out[path][1] > cost):
                    out[path] = (count, cost)
            else:
                c = word[i]
                nxt = kids.get(c)
                if nxt is not None and nxt[2] >= (least_plain if p else least):
                    push((i + 1, k, p, cost, nxt, path + c))
                if k < most:
                    for seen, printed, price in _BY_FIRST.get(c, ()):
                        if word.startswith(seen, i):
                            nxt = node
                            for x in printed:
                                nxt = nxt[0].get(x)
                                if nxt is None:
                                    break
                            if nxt is not None and nxt[2] >= (least_plain if p else least):
                                push((i + len(seen), k + 1, p, cost + price, nxt, path + printed))
            if k < most and p < plain and top >= least_plain:
                more = cost + PLAIN
                if i < n:
                    push((i + 1, k + 1, p + 1, more, node, path))
                    if i + 1 < n and word[i] != word[i + 1]:
                        nxt = kids.get(word[i + 1])
                        nxt = nxt and nxt[0].get(word[i])
                        if nxt and nxt[2] >= least_plain:
                            push((i + 2, k + 1, p + 1, more, nxt, path + word[i + 1] + word[i]))
                for x, nxt in kids.items():
                    if nxt[2] >= least_plain:
                        push((i, k + 1, p + 1, more, nxt, path + x))
                        if i < n and x != word[i]:
                            push((i + 1, k + 1, p + 1, more, nxt, path + x))
        return [(w, n, c) for w, (n, c) in out.items()]


def variants(word: str, most: int = MAX_EDITS) -> dict[str, float]:
    """All strings that `word` may be read from by confusions alone, with their cost, itself left out."""
    out: dict[str, float] = {}
    stack = [(0, 0, 0.0, "")]
    while stack:
        i, k, cost, path = stack.pop()
        if k == most or i == len(word):
            path += word[i:]
            if k and path != word and cost < out.get(path, 1e9):
                out[path] = cost
            continue
        stack.append((i + 1, k, cost, path + word[i]))
        for seen, printed, price in _BY_FIRST.get(word[i], ()):
            if word.startswith(seen, i):
                stack.append((i + len(seen), k + 1, cost + price, path + printed))
    return out


def deletions(word: str, k: int) -> set[str]:
    """The word with up to k characters left out; words within k plain edits share one of them."""
    out = layer = {word}
    for _ in range(k):
        layer = {w[:i] + w[i + 1 :] for w in layer for i in range(len(w))}
        out = out | layer
    return out


def plausible(word: str, count: int, reading: str, n: int, cost: float) -> bool:
    """The reading is so much more frequent that the word is a misread of it."""
    if cost >= PLAIN:  # no confusion of shapes: only a word hardly ever seen, in place of a frequent one
        return n >= least_for_plain(word, count)
    if re.search(r"[0-9!]", word):
        if len(word) <= 2:
            return n >= 500 and n >= 20 * count
        return n >= 2 * count
    if len(word) <= 2:
        return n >= 500 and n >= 50 * count
    if len(word) <= 4:
        return n >= 20 * count * cost and n >= 20
    return n >= (4 if cost < 2 else 12) * count and n >= 3


def least_for_plain(word: str, count: int) -> float:
    """How frequent a reading with plain edits must be."""
    return max(PLAIN_FLOOR, PLAIN_RATIO * count) if len(word) >= 6 and word.isalpha() else math.inf


def number_reading(word: str) -> str | None:
    """A number in which one or two digits were read as letters."""
    if re.fullmatch(r"[\d.,]*[oliz][\d.,]*[oliz]?[\d.,]*", word) and len(re.findall(r"\d", word)) >= 1 and len(word) >= 2 and sum(c.isdigit() for c in word) >= sum(c.isalpha() for c in word):
        digits = sum(c.isdigit() for c in word)
        # a letter at either end of a long number belongs to an identity or passport number
        if word[0].isalpha() and len(word) > 3 or word[-1].isalpha() and digits >= 7:
            return None
        return word.translate(str.maketrans("oliz", "0112"))
    return None


def literal_reading(word: str) -> str | None:
    """A coined word with a digit inside, where no vocabulary word helps."""
    digits = re.findall(r"[0-9!]", word)
    if len(digits) == 1 and len(word) >= 5 and re.fullmatch(r"[^\W\d_]+[01569!8][^\W\d_]+", word):
        return "".join(_DIGIT_FOR.get(c, c) for c in word)
    return None


# ---- pages
def _page_number(line: str, page: int) -> bool:
    n = str(page)
    s = line.strip()
    return bool(
        re.fullmatch(rf"[^\w]*(?:page|seite|página|pagina|p|pg|s|pág|blatt)?\.?\s*{n}\s*(?:(?:of|/|von|sur|de|aus)\s*\d+)?[^\w]*", s, re.I)
        or re.fullmatch(rf"{n}\s*[|·•]\s*\S.{{0,40}}", s)
        or re.fullmatch(rf"\S.{{0,40}}[|·•]\s*{n}", s)
    )


def _head(line: str, page: int) -> str | None:
    """The head without its number, if the line has the form of one."""
    s = line.strip()
    m = re.fullmatch(r"(?:(\d+)\s{2,})?(.*?)(?:\s{2,}(\d+))?", s)
    body = m[2].strip() if m else s
    words = body.split()
    if not 2 <= len(words) <= 12 or re.search(r"[.!?,:;]$", body) or re.match(r"\d", body):
        return None
    alpha = [w for w in words if w[0].isalpha()]
    if not alpha or sum(w[0].isupper() for w in alpha) < len(alpha) - sum(w in ("of", "and", "for", "the", "&") for w in words):
        return None
    return body.lower()


def _hyphenated(a: str, b: str) -> tuple[str, str, str] | None:
    """(first part, hyphen, second part) of a word broken between two lines."""
    s = a.rstrip()
    if len(s) < 2 or s[-1] not in HYPHENS or not s[-2].isalpha():
        return None
    first = s.rsplit(None, 1)[-1]
    nxt = b.split(None, 1)
    if not nxt or not nxt[0][0].isalpha():
        return None
    if s[-1] == "-" and bare(nxt[0]) in SUSPENDED and not re.search(r"[a-z]{3,}-$", first + "x"):
        return None
    return bare(first[:-1]), s[-1], bare(nxt[0])


def count_words(pages: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw: Counter = Counter()

        def counted() -> pa.RecordBatch:
            total: Counter = Counter()
            for t, n in raw.items():
                if t[-1] not in HYPHENS and (w := bare(t)):
                    total[w] += n
            raw.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                raw.update(t.split())
                if len(raw) > FLUSH:
                    yield counted()
        yield counted()

    return spread(pages.where(F.col(text).isNotNull()).select(text)).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def misreadings(words: DataFrame, vocabulary: dict[str, int], rare: DataFrame | None = None, below: float = 0.0) -> DataFrame:
    """(word, reading, n, cost): all plausible readings of each word, from `vocabulary` and from `rare` (word, n) with n < below."""
    packed = sieve.build(rare, F.col("word")) if rare is not None else None
    shared = words.sparkSession.sparkContext.broadcast((vocabulary, packed))
    near = rare is not None and below > PLAIN_FLOOR

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie, packed = Trie(shared.value[0]), shared.value[1]
        for pdf in frames:
            rows = []
            for w, n in zip(pdf.word, pdf.n):
                if len(w) < 2 or len(w) > 100 or "@" in w or sum(map(str.isdigit, w)) > 2:
                    if not (2 <= len(w) <= 12 and number_reading(w)):
                        continue
                if r := number_reading(w):
                    rows.append((w, r, 1, 1.0, n, ""))
                    continue
                if not any(map(str.isalpha, w)):
                    continue
                least = least_for_plain(w, n)
                found = [(w, r, m, c, n, "") for r, m, c in trie.readings(w, plain=None if least < math.inf else 0, least_plain=least) if plausible(w, n, r, m, c)]
                if not any(x[3] < PLAIN for x in found) and (r := literal_reading(w)):
                    found.append((w, r, 1, 1.0, n, "literal"))
                rows += found
                if packed and 2 * n < below:  # a reading is at least twice as frequent
                    rows += [(w, v, 0, c, n, "rare") for v, c in variants(w).items() if sieve.hit(*packed, v)]
                if near and least < below:
                    rows.append((w, "", 0, 0.0, n, "near"))
            yield pd.DataFrame(rows, columns=["word", "reading", "n", "cost", "seen", "kind"])

    read = words.mapInPandas(run, "word string, reading string, n bigint, cost double, seen bigint, kind string")
    cols = ["word", "reading", "n", "cost"]
    if rare is None:
        return read.select(cols)
    read = cut(read)

    @F.pandas_udf("boolean")
    def fits(word: pd.Series, seen: pd.Series, reading: pd.Series, n: pd.Series, cost: pd.Series) -> pd.Series:
        return pd.Series([plausible(*x) for x in zip(word, seen, reading, n, cost)], dtype=bool)

    more = read.where("kind = 'rare'").drop("n").join(rare.select(F.col("word").alias("reading"), "n"), "reading").select(*cols, "seen")
    if near:
        more = more.unionByName(plain_readings(read.where("kind = 'near'").select("word", "seen"), rare.where(F.col("n") >= PLAIN_FLOOR)))
    more = cut(more.where(fits("word", "seen", "reading", "n", "cost")).select(cols).distinct())
    literal = read.where("kind = 'literal'").join(more.where(F.col("cost") < PLAIN).select("word").distinct(), "word", "left_anti")  # only where no word helps
    return read.where("kind = ''").select(cols).unionByName(literal.select(cols)).unionByName(more)


def plain_readings(words: DataFrame, rare: DataFrame) -> DataFrame:
    """(word, reading, n, cost, seen) of rare words within the automaton's edits, by a join on deletions.

    A word and its reading share a string that deletions leave of both, after one confusion of the word where
    there is one; the automaton gives the cost.
    """

    @F.pandas_udf("array<string>")
    def left(word: pd.Series) -> pd.Series:
        return word.map(lambda w: sorted(deletions(w, 2 if len(w) >= LONG else 1) | {x for v in variants(w, 1) for x in deletions(v, 1)}))

    @F.pandas_udf("array<string>")
    def right(word: pd.Series) -> pd.Series:
        return word.map(lambda w: sorted(deletions(w, 2 if len(w) >= LONG - 2 else 1)))

    @F.pandas_udf("double")
    def price(word: pd.Series, reading: pd.Series) -> pd.Series:
        return pd.Series([next((c for _, _, c in Trie({r: 1}).readings(w)), None) for w, r in zip(word, reading)], dtype=float)

    a = words.select("word", "seen", F.explode(left("word")).alias("x"))
    b = rare.select(F.col("word").alias("reading"), "n", F.explode(right("word")).alias("x"))
    pairs = a.join(b, "x").where("word <> reading").select("word", "reading", "n", "seen").distinct()
    return pairs.withColumn("cost", price("word", "reading")).where(F.col("cost") >= PLAIN)


def page_events(pages: DataFrame, bitmap: tuple[bytes, int]) -> DataFrame:
    """Events of pages (rec, file, page, lines array<string>, ids array<bigint>).

    kind H: broken word (a, b, hyphen in `c`); P: page number; T: form of a head (text in a);
    W: word that may be misread (a), word in front (b). `ids` is null where the record is the page itself.
    """
    shared = pages.sparkSession.sparkContext.broadcast(bitmap)
    schema = "rec string, file string, id bigint, line_no int, kind string, a string, b string, c string"

    class Flag(dict):
        def __init__(self, packed, mask):
            self.packed, self.mask = packed, mask

        def __missing__(self, token):
            w = bare(token)
            # parts of postcodes and the written form of a lane are what they are
            v = w if len(w) > 1 and sieve.hit(self.packed, self.mask, w) and _CODE.fullmatch(token) is None else None
            if len(self) > FLUSH:
                self.clear()
            self[token] = v
            return v

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flag = Flag(*shared.value)
        for batch in batches:
            out: list[tuple] = []
            for rec, file, page, pid, lines, ids in zip(*(c.to_pylist() for c in batch.columns)):
                lines = [x or "" for x in lines]
                at = (lambda i: (ids[i], 0)) if ids else (lambda i: (pid, i))
                body_end = next((i for i, x in enumerate(lines) if x.strip() == FORM_MARK), len(lines))
                filled = [i for i in range(body_end) if lines[i].strip()]
                if not filled and body_end == len(lines):
                    continue
                first, last = (filled[0], filled[-1]) if filled else (-1, -1)
                if last > first or last == first and last >= 0:
                    if _page_number(lines[last], page):
                        out.append((rec, file, *at(last), "P", "", "", ""))
                        if last == first:
                            continue
                    else:
                        last = -1
                if first >= 0 and (h := _head(lines[first], page)):
                    out.append((rec, file, *at(first), "T", h, "", ""))
                skip_first = False
                for i, line in enumerate(lines):
                    if i == last or i == body_end:
                        skip_first = False
                        continue
                    broken = _hyphenated(line, lines[i + 1]) if i + 1 < body_end and i + 1 != last else None
                    tokens = line.split()
                    if broken:
                        out.append((rec, file, *at(i), "H", broken[0], broken[2], broken[1]))
                    lo, hi = (1 if skip_first else 0), len(tokens) - (1 if broken else 0)
                    for j in range(lo, hi):
                        w = flag[tokens[j]]
                        if w is not None:
                            out.append((rec, file, *at(i), "W", w, bare(tokens[j - 1]) if j else "", ""))
                    skip_first = broken is not None
            cols = list(zip(*out)) if out else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int32()), *(pa.array(c, pa.string()) for c in cols[4:])], names=["rec", "file", "id", "line_no", "kind", "a", "b", "c"])

    return pages.select("rec", "file", "page", "id", "lines", "ids").mapInArrow(run, schema)


def noise(all_pages: DataFrame, pages: DataFrame) -> DataFrame:
    """(rec, id, noise_kind, line_no, repaired).

    `all_pages` (text) gives the words; `pages` (rec, file, page, id, lines, ids) are the scanned ones.
    """
    spark = pages.sparkSession
    words = cut(count_words(all_pages))
    known = words.where((F.col("n") >= 3) & ~F.col("word").rlike("[0-9@!]"))
    below = rare_below(known)
    frequent = known.where(F.col("n") >= below).toPandas()  # at most VOCABULARY words
    vocabulary = dict(zip(frequent.word, frequent.n.tolist()))
    wrong = cut(misreadings(words, vocabulary, known.where(F.col("n") < below) if below > 3 else None, below))
    events = cut(page_events(pages, sieve.build(wrong.select("word").distinct(), F.col("word"))))
    key = ["rec", "id", "line_no"]
    numbers = events.where("kind = 'P'").select("rec", "id", F.lit("page_number").alias("noise_kind"), "line_no", F.lit("").alias("repaired"))

    # heads: the same on several pages of a file, or ending like heads that are
    heads = events.where("kind = 'T'").select("rec", "file", "id", "line_no", "a")
    repeated = cut(heads.groupBy("rec", "file", "a").agg(F.countDistinct("id").alias("n")).where("n >= 2"))
    ending = F.regexp_extract("a", r"(\S+ \S+)$", 1)
    tails = cut(repeated.where("n >= 3").groupBy(ending.alias("tail")).agg(F.countDistinct("file").alias("files")).where("files >= 3 and tail <> ''").select("tail"))
    lone = cut(heads.join(repeated, ["rec", "file", "a"], "left_anti").withColumn("tail", ending))
    other = lone.select("tail").where("tail <> ''").distinct()
    misread_tails = similar_pairs(tails, [], "tail", 2, other).select(F.col("b").alias("tail"))
    alike = cut(tails.unionByName(misread_tails).distinct())
    found = heads.join(repeated, ["rec", "file", "a"], "left_semi").select("rec", "id", "line_no").unionByName(lone.join(alike, "tail", "left_semi").select("rec", "id", "line_no"))
    found = found.select("rec", "id", F.lit("running_head").alias("noise_kind"), "line_no", F.lit("").alias("repaired"))

    # readings; several of one word are ranked by the word in front
    best = cut(wrong.groupBy("word").agg(F.count("*").alias("k"), F.max_by("reading", F.struct(-F.col("cost"), F.col("n"), "reading")).alias("top"), (F.min("cost") >= PLAIN).alias("plain")))
    seen = events.where("kind = 'W'").join(best, F.col("a") == F.col("word"))
    single = seen.where("k = 1 and not plain").select(*key, F.col("top").alias("repaired"))
    many = seen.where("k > 1 or plain").select(*key, "word", "b", "top", "plain")
    # how often a candidate follows the word in front elsewhere, from the occurrences that need no repair
    options = cut(many.select("word", "b").distinct().join(wrong.select("word", "reading", "n", "cost"), "word"))
    ranked = options.join(pair_counts(all_pages, options), ["b", "reading"], "left")
    # a plain edit needs the word in front to bear it out
    ranked = ranked.where((F.col("cost") < PLAIN) | (F.coalesce("pairs", F.lit(0)) >= 2))
    choice = cut(ranked.groupBy("word", "b").agg(F.max_by("reading", F.log1p(F.coalesce("pairs", F.lit(0))) * 2 - F.col("cost") * 4 + F.log1p("n")).alias("chosen")))
    several = many.join(choice, ["word", "b"], "left").where("chosen is not null or not plain").select(*key, F.coalesce("chosen", "top").alias("repaired"))
    misread = single.unionByName(several).select("rec", "id", F.lit("misread").alias("noise_kind"), "line_no", "repaired")

    # broken words: joined, or with a hyphen of their own
    broken = events.where("kind = 'H'").select(*key, "a", "b", "c", F.concat("a", "b").alias("joined"), F.concat_ws("-", "a", "b").alias("dashed"))
    forms = broken.select(F.explode(F.array("joined", "dashed")).alias("word")).distinct().join(words, "word")
    broken = broken.join(forms.select(F.col("word").alias("joined"), F.col("n").alias("nj")), "joined", "left").join(forms.select(F.col("word").alias("dashed"), F.col("n").alias("nd")), "dashed", "left")
    nj, nd = F.coalesce("nj", F.lit(0)), F.coalesce("nd", F.lit(0))
    broken = broken.join(best.where("not plain").select(F.col("word").alias("joined"), "top"), "joined", "left")
    # a suspended part ("short- and") is no broken word
    broken = broken.where(~(F.col("b").isin(*SUSPENDED) & (F.col("c") == "-") & (nj == 0)))
    whole = F.when((nd > nj) & (F.col("c") == "-"), F.col("dashed")).otherwise(F.coalesce("top", "joined"))
    broken = broken.select("rec", "id", F.lit("line_hyphen").alias("noise_kind"), "line_no", whole.alias("repaired"))
    return numbers.unionByName(found).unionByName(misread).unionByName(broken).distinct()


def rare_below(known: DataFrame) -> int:
    """The least power of two such that at most VOCABULARY words are as frequent, or 3 if all words are that few."""
    level = F.floor(F.log2("n")).cast("int")
    sizes = {r.v: r.c for r in known.groupBy(level.alias("v")).agg(F.count("*").alias("c")).collect()}  # a row a power of two
    if sum(sizes.values()) <= VOCABULARY:
        return 3
    total = 0
    for v in sorted(sizes, reverse=True):
        total += sizes[v]
        if total > VOCABULARY:
            return 2 ** (v + 1)
    return 3


def pair_counts(pages: DataFrame, options: DataFrame) -> DataFrame:
    """(b, reading, pairs): how often the reading follows b, for the pairs asked for."""
    asked = cut(options.select("b", "reading").distinct())
    shared = pages.sparkSession.sparkContext.broadcast((sieve.build(asked, F.col("reading")), sieve.build(asked, F.concat_ws(" ", "b", "reading"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, pair = shared.value
        memo: dict[str, str | None] = {}
        out: Counter = Counter()

        def counted() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array([k[0] for k in out], pa.string()), pa.array([k[1] for k in out], pa.string()), pa.array(list(out.values()), pa.int64())], names=["b", "reading", "n"])
            out.clear()
            return got

        for batch in batches:
            for t in batch.column(0).to_pylist():
                before = ""
                for tok in t.split():
                    if tok not in memo:
                        if len(memo) > FLUSH:
                            memo.clear()
                        w = bare(tok)
                        memo[tok] = w if w and sieve.hit(*one, w) else None
                    if (w := memo[tok]) is not None:
                        b = bare(before)
                        if sieve.hit(*pair, f"{b} {w}"):
                            out[(b, w)] += 1
                    before = tok
            if len(out) > FLUSH:
                yield counted()
        yield counted()

    return spread(pages.where(F.col("text").isNotNull()).select("text")).mapInArrow(run, "b string, reading string, n bigint").join(asked, ["b", "reading"], "left_semi").groupBy("b", "reading").agg(F.sum("n").alias("pairs"))


def scanned_pages(spark, sf_dir: str) -> DataFrame:
    ep = table(spark, sf_dir, "extracted_pages").where("is_scanned")
    one = lambda field: ep.where(F.col(field).isNotNull()).select(F.lit(f"extracted_pages.{field}").alias("rec"), F.col("file_name").alias("file"), F.col("page_num").alias("page"), F.col("page_id").alias("id"), F.split(field, "\n").alias("lines"), F.lit(None).cast("array<bigint>").alias("ids"))
    tb = table(spark, sf_dir, "text_blocks").select("page_id", "file_name", "page", "block_no", "block_id", "text")
    tb = tb.groupBy("page_id", "file_name", "page").agg(F.array_sort(F.collect_set(F.struct("block_no", "block_id", "text"))).alias("x"))  # a page is bounded
    tb = tb.select(F.lit("text_blocks.text").alias("rec"), F.col("file_name").alias("file"), "page", F.col("page_id").alias("id"), F.col("x.text").alias("lines"), F.col("x.block_id").alias("ids"))
    return spread(one("text").unionByName(one("rich_text"))).unionByName(tb)


def page_lines(spark, sf_dir: str) -> DataFrame:
    """(text) of every page once, with the lines that stand in rich_text only, and of blocks whose line is on no page."""
    ep = table(spark, sf_dir, "extracted_pages").select("page_id", "is_scanned", "text", "rich_text")
    lines = lambda c: F.split(F.coalesce(c, F.lit("")), "\n")
    more = F.filter(F.array_except(lines("rich_text"), lines("text")), lambda x: F.trim(x) != FORM_MARK)
    texts = ep.dropDuplicates(["page_id"]).select(F.concat_ws("\n", "text", more).alias("text"))
    same = lambda c: F.xxhash64(F.trim(c)).alias("h")
    there = ep.where("is_scanned").select("page_id", F.explode(F.array_union(lines("text"), lines("rich_text"))).alias("line")).select("page_id", same("line"))
    tb = table(spark, sf_dir, "text_blocks").select("page_id", "block_id", "text", same("text")).where(F.trim("text") != FORM_MARK)
    return texts.unionByName(cut(tb.join(there, ["page_id", "h"], "left_anti").dropDuplicates(["block_id"]).select("text")))


def p5_found(spark, sf_dir: str) -> DataFrame:
    found = noise(page_lines(spark, sf_dir), scanned_pages(spark, sf_dir))
    rec = F.split("rec", r"\.")
    return found.select(rec[0].alias("record_table"), F.col("id").alias("record_id"), rec[1].alias("field_name"), "noise_kind", "line_no", "repaired")


def _nearest(words: list[str], reading: str) -> int | None:
    """The first of the words that need fewest edits to become the reading, which itself is none."""
    for k in (1, 2, 3, 4):
        for j, w in enumerate(words):
            if w != reading and osa(w, reading, k) <= k:
                return j
    return min((j for j, w in enumerate(words) if w != reading), default=None)


def repair_text(text: str, events: list[tuple[int, str, str]]) -> str:
    """Readable paragraphs: furniture lines out, readings in, broken words joined, lines of a paragraph joined.

    `events` are (line_no, noise_kind, repaired) of this text.
    """
    lines = text.split("\n")
    by: dict[int, list[tuple[str, str]]] = {}
    for n, kind, repaired in events:
        by.setdefault(n, []).append((kind, repaired))
    out, carry, paragraph = [], None, []

    def flush():
        if paragraph:
            out.append(" ".join(paragraph))
            paragraph.clear()

    form = next((i for i, x in enumerate(lines) if x.strip() == FORM_MARK), len(lines))
    for i, line in enumerate(lines):
        kinds = by.get(i, [])
        if any(k in ("running_head", "page_number") for k, _ in kinds):
            continue
        tokens = line.split()
        if carry is not None and tokens:
            whole, tokens[0] = carry, tokens[0]
            tail = tokens[0][len(tokens[0].rstrip(_RIGHT)) :]
            tokens[0], carry = whole + tail, None
        for kind, repaired in kinds:
            if kind == "misread":
                j = _nearest([bare(t) for t in tokens], repaired)
                if j is not None:
                    core = tokens[j].lstrip(_LEFT).rstrip(_RIGHT)
                    new = repaired.upper() if core.isupper() and len(core) > 1 else repaired.capitalize() if core[:1].isupper() else repaired
                    tokens[j] = tokens[j].replace(core, new, 1)
            elif kind == "line_hyphen" and tokens:
                first = tokens.pop()
                carry = repaired.capitalize() if first[:1].isupper() else repaired
        if not line.strip():
            flush()
        elif carry is None and (i >= form or _ITEM.match(line)):
            flush()  # a line of a list, table or form stands by itself
            out.append(" ".join(tokens))
        else:
            paragraph += tokens
    if carry is not None:
        paragraph.append(carry)
    flush()
    return "\n\n".join(x for x in out if x)


def p5_repaired(spark, sf_dir: str) -> DataFrame:
    """(record_table, record_id, field_name, repaired_text) of text and rich_text of every page and of the blocks of a page.

    Paragraphs run over blocks: those of a page are joined by block_no, and record_id is then its page_id. Fields of
    pages that are not scanned keep their text; a null field has a null text.
    """
    found = cut(p5_found(spark, sf_dir))
    ep = table(spark, sf_dir, "extracted_pages").select("page_id", F.coalesce("is_scanned", F.lit(False)).alias("scanned"), "text", "rich_text").dropDuplicates(["page_id"])
    ep = ep.select("page_id", "scanned", F.explode(F.create_map(F.lit("text"), "text", F.lit("rich_text"), "rich_text")).alias("field_name", "t"))
    on_page = found.where("record_table = 'extracted_pages'").groupBy(F.col("record_id").alias("page_id"), "field_name").agg(F.collect_list(F.struct(F.col("line_no").cast("bigint").alias("line_no"), "noise_kind", "repaired")).alias("ev"))
    pages = ep.join(on_page, ["page_id", "field_name"], "left").select(F.lit("extracted_pages").alias("record_table"), F.col("page_id").alias("record_id"), "field_name", "t", "scanned", "ev")

    # blocks as lines of their page
    tb = table(spark, sf_dir, "text_blocks").select("page_id", "block_no", "block_id", F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["block_id"])
    on_block = found.where("record_table = 'text_blocks'").withColumnRenamed("record_id", "block_id").groupBy("block_id").agg(F.collect_list(F.struct("block_id", "noise_kind", "repaired")).alias("e"))
    none = F.array().cast("array<struct<block_id:bigint,noise_kind:string,repaired:string>>")
    tb = tb.join(on_block, "block_id", "left").withColumn("e", F.coalesce("e", none))
    tb = tb.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("block_no", "block_id", "text"))).alias("x"), F.flatten(F.collect_list("e")).alias("e"))  # a page is bounded
    events = F.transform("e", lambda v: F.struct((F.array_position("x.block_id", v["block_id"]) - 1).alias("line_no"), v["noise_kind"].alias("noise_kind"), v["repaired"].alias("repaired")))
    blocks = tb.select(F.lit("text_blocks").alias("record_table"), F.col("page_id").alias("record_id"), F.lit("text").alias("field_name"), F.array_join("x.text", "\n").alias("t"), F.lit(True).alias("scanned"), events.alias("ev"))

    @F.pandas_udf("string")
    def fix(text: pd.Series, scanned: pd.Series, ev: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or not s else repair_text(t, [(x["line_no"], x["noise_kind"], x["repaired"]) for x in (e if e is not None else [])]) for t, s, e in zip(text, scanned, ev)], dtype=object)

    return pages.unionByName(blocks).select("record_table", "record_id", "field_name", fix("t", "scanned", "ev").alias("repaired_text"))
