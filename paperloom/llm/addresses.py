"""Problem 2: address strings that denote the same location.

1. Each distinct string is parsed into number, letter, unit, street name and kind, town, region and
   postcode, in whatever order; strings without a number and a street are no addresses.
2. A town that is missing is taken from the postcode when the corpus ties that postcode to one town.
3. Candidate pairs share the house number and one of postcode, sound of the street, sound of the town.
4. Each pair is compared component by component at levels exact, close, missing, different; the
   weights of the levels are estimated by expectation-maximisation over the counts of level patterns
   (4^5 patterns at most, whatever the number of pairs), missing being a level of its own.
5. Pairs above `min_posterior` link strings; strings joined through a fuller third one are one location
   unless a component contradicts. The defining rule is checked last: number, letter and unit are equal.

Only distinct strings are compared. Null, blank and wordy values ("TBC", "Hybrid") have no pairs.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.names import fold, osa
from paperloom.session import cut, spread, table

# Street kinds with their written forms; leading kinds stand before the name.
TRAILING = {
    "street": "street str st", "avenue": "avenue avenu ave av", "boulevard": "boulevard blvd boul bd", "court": "court ct crt", "drive": "drive drv dr", "lane": "lane ln la", "road": "road rd",
    "place": "place pl", "square": "square sq", "terrace": "terrace ter terr", "way": "way wy", "close": "close cl", "crescent": "crescent cres", "parkway": "parkway pkwy", "circle": "circle cir",
    "row": "row", "walk": "walk", "hill": "hill", "mews": "mews", "trail": "trail trl", "highway": "highway hwy", "gardens": "gardens gdns",
}
LEADING = {
    "rue": "rue r", "avenue": "avenue av ave", "boulevard": "boulevard blvd bd boul", "place": "place pl", "quai": "quai", "chemin": "chemin che", "impasse": "impasse imp", "allee": "allee all",
    "calle": "calle c cl", "avenida": "avenida avda avd", "plaza": "plaza pza plz", "paseo": "paseo pso", "camino": "camino cno", "carrer": "carrer", "ronda": "ronda",
}
COMPOUND = ("strasse", "weg", "gasse", "allee", "platz", "ring", "damm", "ufer", "markt")
ARTICLES = {"de", "des", "du", "d", "del", "la", "las", "le", "les", "los", "el", "l", "the", "der", "die", "am", "an", "zum", "zur"}
DIRECTIONS = {"n": "n", "north": "n", "s": "s", "south": "s", "e": "e", "east": "e", "w": "w", "west": "w", "ne": "ne", "nw": "nw", "se": "se", "sw": "sw"}
UNITS = {"suite": "suite ste bureau bur office of oficina buro despacho", "unit": "unit unt u apt apartment appt flat wohnung room rm", "floor": "floor flr fl etage et stock og planta pl piso nivel level lvl geschoss"}
REGIONS = set("al ak az ar ca co ct de fl ga hi id il in ia ks ky la me md ma mi mn ms mo mt ne nv nh nj nm ny nc nd oh ok or pa ri sc sd tn tx ut vt va wa wv wi wy dc".split())
COUNTRIES = {"usa", "us", "u s a", "u s", "united states", "united states of america", "uk", "u k", "united kingdom", "great britain", "gb", "england", "germany", "deutschland", "de", "france", "fr", "frankreich", "spain", "espana", "es", "spanien", "australia", "au", "india", "canada", "d", "f", "e"}
LEAD_INS = r"^\s*(?:attn|att|attention|c/o|z\.? ?hd\.?|fao)\b[:.]?\s*[^,;:\n]*[,;:\n]+|^\s*(?:warehouse|main office|head office|office|delivery|deliver to|ship to|building [a-z0-9]\b|gebaude [a-z0-9]\b|batiment [a-z0-9]\b|bldg\.? [a-z0-9]\b|lager|entrepot|almacen|hq)\s*[:,;\n]\s*"

_UNIT_WORDS = {w: k for k, v in UNITS.items() for w in v.split()}
_UNIT = re.compile(r"(?<!\w)(" + "|".join(sorted(_UNIT_WORDS, key=len, reverse=True)) + r")\.?\s*(?:no\.?|n[ro]\.?|#)?\s*(\d{1,4}[a-z]?)(?!\w)")
_TRAIL = {w: k for k, v in TRAILING.items() for w in v.split()}
_LEAD = {w: k for k, v in LEADING.items() for w in v.split()}
_UK = re.compile(r"(?<!\w)([a-z]{1,2}\d[a-z\d]?)\s*(\d[a-z]{2})(?!\w)")
_HOUSE = re.compile(r"(?<![\w#])(?:n[ro]?\.?\s*|no\.?\s*)?(\d{1,5})(?:([a-z])(?!\w)|\s([a-d])(?=\s*(?:,|$))|(?!\w))")
FIELDS = ("number", "letter", "unit_kind", "unit", "street", "kind", "direction", "town", "region", "post")


def _words(s: str) -> list[str]:
    return re.findall(r"[a-z]+", s.replace("'", " "))


def _compound(w: str) -> tuple[str, str] | None:
    """Name and kind of a street written as one word."""
    if len(w) > 5 and w.endswith("str"):
        return w[:-3], "strasse"
    for k in COMPOUND[1:]:
        if w.endswith(k) and len(w) > len(k) + 2:
            return w[: -len(k)], k
    best = None
    for n in (7, 6, 8):
        if len(w) > n + 2 and (d := osa(w[-n:], "strasse", 2)) <= 2 and (best is None or d < best[0]):
            best = (d, w[:-n])
    return (best[1], "strasse") if best and best[0] <= 2 and "s" in w[len(best[1]) :][:2] else None


def parse(address: str | None) -> tuple | None:
    """The components in the order of FIELDS, empty where missing; None for a string that is no address."""
    if not address or not address.strip():
        return None
    t = fold(address).replace("’", "'").replace("n°", " ").replace("nº", " ").replace("no.", " ")
    t = re.sub(r"\bn[oº°]\.?\s+(?=\d)", " ", t)
    t = re.sub(LEAD_INS, "", t)
    t = re.sub(r"(?<!\w)c/\s*(?!o\b)", "calle ", t)
    t = re.sub(r"[\n;|]+|\s[-–—/]\s|\s{3,}", ",", t)
    t = re.sub(r"(?<=[a-z])-(?=str)", "", t)
    unit_kind = unit = post = region = ""
    if m := _UNIT.search(t):
        unit_kind, unit = _UNIT_WORDS[m[1]], m[2]
        t = t[: m.start()] + "," + t[m.end() :]
    elif m := re.search(r"#\s*(\d{1,4}[a-z]?)(?!\w)", t):
        unit_kind, unit = "any", m[1]
        t = t[: m.start()] + "," + t[m.end() :]
    elif m := re.search(r"(?<!\w)(\d{1,2})(?:st|nd|rd|th|er|e|\.)?\s*(floor|etage|stock|planta|og|piso)(?!\w)", t):
        unit_kind, unit = "floor", m[1]
        t = t[: m.start()] + "," + t[m.end() :]
    if m := _UK.search(t):
        post = m[1] + m[2]
        t = t[: m.start()] + "," + t[m.end() :]
    elif (found := list(re.finditer(r"(?<!\d)(\d{5})(?!\d)", t))) :
        m = found[-1]
        post = m[1]
        before = re.search(r"(?<![a-z])([a-z]{2})[\s,.]*$", t[: m.start()])
        start = m.start()
        if before and before[1] in REGIONS:
            region, start = before[1], before.start(1)
        t = t[:start] + "," + t[m.end() :]
    segs = [s.strip(" .-") for s in t.split(",") if s.strip(" .-")]
    segs = [s for s in segs if re.sub(r"[^a-z]+", " ", s).strip() not in COUNTRIES or re.search(r"\d", s)]
    if not region:
        for i, s in enumerate(segs):
            if re.fullmatch(r"[a-z]{2}\.?", s) and s[:2] in REGIONS:
                region = s[:2]
                segs.pop(i)
                break
    at = next((i for i, s in enumerate(segs) if _HOUSE.search(s)), None)
    if at is None:
        return None
    m = _HOUSE.search(segs[at])
    number, letter = m[1], m[2] or m[3] or ""
    head, tail = segs[at][: m.start()], segs[at][m.end() :]
    # the words around the number, and the other segments, each a possible street
    chunks = [c for c in [(at, "tail", _words(tail)), (at, "head", _words(head)), *((i, "seg", _words(s)) for i, s in enumerate(segs) if i != at)] if c[2]]
    street = kind = direction = ""
    rest: list[list[str]] = []
    for pos, (_, _, ws) in enumerate(chunks):
        lead = next((i for i, w in enumerate(ws) if w in _LEAD and i + 1 < len(ws) and (len(w) > 2 or i == 0)), None)
        trail = next((i for i in range(len(ws) - 1, 0, -1) if ws[i] in _TRAIL), None)
        if trail is None:
            trail = next((i for i in range(len(ws) - 1, 0, -1) if len(ws[i]) > 3 and any(osa(ws[i], k, 1) <= 1 for k in ("street", "avenue", "boulevard", "court", "drive", "lane", "road"))), None)
        comp = next(((i, c) for i, w in enumerate(ws) if (c := _compound(w))), None)
        if lead is not None and (trail is None or any(w in ARTICLES for w in ws[lead + 1 : lead + 3])):
            kind, name, left = _LEAD[ws[lead]], ws[lead + 1 :], ws[:lead]
        elif trail is not None and pos <= 1 or trail is not None and not any(c[1] != "seg" for c in chunks):
            w = ws[trail]
            kind = _TRAIL.get(w) or next(k for k in ("street", "avenue", "boulevard", "court", "drive", "lane", "road") if osa(w, k, 1) <= 1)
            name, left = ws[:trail], ws[trail + 1 :]
        elif comp is not None:
            i, (core, kind) = comp
            name, left = [core], ws[:i] + ws[i + 1 :]
        elif len(ws) > 1 and (fuzzy := next((i for i, w in enumerate(ws[:-1]) if len(w) > 3 and any(osa(w, k, 1) <= 1 for k in ("calle", "rue"))), None)) is not None:
            kind, name, left = ("rue" if len(ws[fuzzy]) < 5 else "calle"), ws[fuzzy + 1 :], ws[:fuzzy]
        else:
            rest.append(ws)
            continue
        dirs = [DIRECTIONS[w] for w in name if w in DIRECTIONS and len(name) > 1]
        direction = dirs[0] if dirs else ""
        core = [w for w in name if w not in ARTICLES and not (w in DIRECTIONS and len(name) > 1)]
        while kind in _LEAD.values() and len(core) > 1 and core[-1] in COUNTRIES:
            core.pop()
        if kind in _LEAD.values() and len(core) > 1 and len(core[-1]) > 7 and len(chunks) == 1:
            left = [*left, core.pop()]  # no separator: the long last word is the town
        street = "".join(core) or "".join(name)
        if left:
            rest.append(left)
        rest += [c[2] for c in chunks[pos + 1 :]]
        break
    if not street:
        return None
    left = [w for ws in rest for w in [" ".join(x for x in ws)]]
    towns = []
    for s in left:
        ws = s.split()
        if not region and len(ws) > 1 and ws[-1] in REGIONS:
            region = ws.pop()
        if " ".join(ws) in COUNTRIES:
            continue
        while len(ws) > 1 and (ws[-1] in COUNTRIES or " ".join(ws[-2:]) in COUNTRIES):
            ws = ws[:-2] if " ".join(ws[-2:]) in COUNTRIES else ws[:-1]
        if ws:
            towns.append("".join(ws))
    town = max(towns, key=len) if towns else ""
    return number.lstrip("0") or "0", letter, unit_kind, unit, street, kind, direction, town, region, post


def sound(s: str) -> str:
    """Consonants without repeats, sorted, so that one swapped or doubled letter keeps the key."""
    c = re.sub(r"[aeiouyhw]", "", s.replace("ph", "f").replace("z", "s").replace("ck", "k").replace("c", "k"))
    return "".join(sorted(set(c)))


# ---- comparison levels: 0 exact, 1 close, 2 missing, 3 different
def level(a: str, b: str, k: int = 2) -> int:
    if not a or not b:
        return 2
    if a == b:
        return 0
    return 1 if osa(a, b, k) <= (k if min(len(a), len(b)) > 5 else 1) else 3


def compare(a: tuple, b: tuple) -> tuple[int, int, int, int, int]:
    """Levels of street, kind, town, region and postcode of two parsed addresses (tuples of FIELDS)."""
    kind = level(a[5], b[5], 1) if not (a[5] == b[5]) else 0
    street = level(a[4] + a[6], b[4] + b[6])
    return street, kind, level(a[7], b[7]), level(a[8], b[8], 0) if a[8] != b[8] else (0 if a[8] else 2), level(a[9], b[9], 1)


def fit_weights(patterns: pd.DataFrame, rounds: int = 60) -> tuple[float, np.ndarray, np.ndarray]:
    """(share of matches, m, u): level probabilities of matches and non-matches for each component, by EM.

    `patterns` has the columns g0..g4 and n (pairs with these levels).
    """
    g = patterns[[f"g{i}" for i in range(5)]].to_numpy(int)
    n = patterns["n"].to_numpy(float)
    m = np.tile(np.array([0.8, 0.1, 0.08, 0.02]), (5, 1))
    u = np.tile(np.array([0.1, 0.02, 0.08, 0.8]), (5, 1))
    p = 0.3
    for _ in range(rounds):
        lm = np.log(p) + sum(np.log(m[i, g[:, i]]) for i in range(5))
        lu = np.log(1 - p) + sum(np.log(u[i, g[:, i]]) for i in range(5))
        r = 1 / (1 + np.exp(np.clip(lu - lm, -50, 50)))
        p = float(np.clip((r * n).sum() / n.sum(), 1e-4, 1 - 1e-4))
        for i, lev in itertools.product(range(5), range(4)):
            at = g[:, i] == lev
            m[i, lev] = ((r * n)[at].sum() + 0.5) / ((r * n).sum() + 2)
            u[i, lev] = (((1 - r) * n)[at].sum() + 0.5) / (((1 - r) * n).sum() + 2)
    return p, m, u


def components(ids: DataFrame, both: DataFrame) -> DataFrame:
    """(id, loc): the least id that is linked to each id, by links (a, b) given in both directions."""
    label = ids.select("id", F.col("id").alias("loc"))
    while True:  # labels fall to the least of a component; following the label of the label halves the way each round
        nb = both.join(label.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("loc").alias("m"))
        near = label.join(nb.withColumnRenamed("a", "id"), "id", "left").select("id", F.col("loc").alias("was"), F.least("loc", F.coalesce("m", "loc")).alias("loc"))
        near = cut(near)
        up = near.select(F.col("id").alias("loc"), F.col("loc").alias("up"))
        new = cut(near.join(up, "loc", "left").select("id", F.least("loc", F.coalesce("up", "loc")).alias("loc"), "was"))
        moved = new.where("loc < was").limit(1).count()
        label = new.select("id", "loc")
        if not moved:
            break
    return label


def link_addresses(strings: DataFrame, min_posterior: float = 0.9) -> DataFrame:
    """(address, location) of the distinct strings that are addresses."""
    schema = ", ".join(f"{f} string" for f in FIELDS)

    @F.pandas_udf(schema)
    def parsed(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse(x) or (None,) * len(FIELDS) for x in s], columns=FIELDS)

    @F.pandas_udf("string")
    def sounds(s: pd.Series) -> pd.Series:
        return s.map(sound)

    p = spread(cut(strings.select("address"))).withColumn("p", parsed("address")).select("address", "p.*").where(F.col("number").isNotNull())
    p = cut(p)
    # towns by postcode
    town = p.where("post <> '' and town <> ''").groupBy("post", "town").agg(F.count("*").alias("n"))
    town = town.groupBy("post").agg(F.max_by("town", F.struct("n", "town")).alias("known"), F.max("n").alias("top"), F.sum("n").alias("all"))
    p = p.join(town.where("top >= 2 and top >= 0.4 * all").select("post", "known"), "post", "left")
    p = p.withColumn("town", F.when(F.col("town") == "", F.coalesce("known", F.lit(""))).otherwise(F.col("town"))).drop("known")
    p = cut(p.withColumn("id", F.xxhash64("address")).withColumn("snd_s", sounds("street")).withColumn("snd_t", sounds("town")))
    same = ["number", "letter", "unit"]
    blocks = p.select("id", *same, F.explode(F.array(
        F.when(F.col("post") != "", F.concat(F.lit("p"), "post")), F.when(F.col("snd_s") != "", F.concat(F.lit("s"), F.substring("street", 1, 1), "snd_s")), F.when(F.col("snd_t") != "", F.concat(F.lit("t"), "snd_t"))
    )).alias("block")).where(F.col("block").isNotNull())
    # identical component tuples need no comparison among themselves: one representative each
    comps = [f for f in FIELDS if f != "address"]
    reps = p.groupBy(*comps).agg(F.min("id").alias("rep"))
    p = cut(p.join(reps, comps))
    blocks = blocks.join(reps.select(F.col("rep").alias("id")), "id", "left_semi")
    a, b = blocks.withColumnRenamed("id", "a"), blocks.withColumnRenamed("id", "b")
    # the keys of a pair hold number, letter and unit besides the block, and what AQE finds skewed it splits
    pairs = a.join(b, [*same, "block"]).where("a < b").select("a", "b").distinct()
    full = p.where(F.col("id") == F.col("rep")).select("id", F.struct(*FIELDS).alias("c"))
    pairs = pairs.join(full.select(F.col("id").alias("a"), F.col("c").alias("ca")), "a").join(full.select(F.col("id").alias("b"), F.col("c").alias("cb")), "b")

    @F.pandas_udf("g0 int, g1 int, g2 int, g3 int, g4 int, ok boolean")
    def levels(ca: pd.DataFrame, cb: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for x, y in zip(ca.itertuples(index=False), cb.itertuples(index=False)):
            kinds = {x.unit_kind, y.unit_kind}
            rows.append((*compare(tuple(x), tuple(y)), len(kinds) == 1 or "any" in kinds))
        return pd.DataFrame(rows, columns=["g0", "g1", "g2", "g3", "g4", "ok"])

    gs = [f"g{i}" for i in range(5)]
    pairs = cut(pairs.select("a", "b", levels("ca", "cb").alias("v")).select("a", "b", "v.*"))
    patterns = pairs.groupBy(*gs).agg(F.count("*").alias("n")).toPandas()  # 4^5 rows at most
    if len(patterns):
        share, m, u = fit_weights(patterns)
        g = patterns[gs].to_numpy(int)
        lo = np.log(share / (1 - share)) + sum(np.log(m[i, g[:, i]] / u[i, g[:, i]]) for i in range(5))
        # a contradiction in street, kind, town or postcode is never outweighed
        patterns["post_p"] = np.where((g[:, [0, 1, 2]] == 3).any(1) | ((g[:, 4] == 3) & (g[:, 2] != 0)), 0.0, 1 / (1 + np.exp(-np.clip(lo, -50, 50))))
    else:
        patterns["post_p"] = pd.Series(dtype=float)
    weights = strings.sparkSession.createDataFrame(patterns[[*gs, "post_p"]].astype({"post_p": float}), ", ".join(f"{x} int" for x in gs) + ", post_p double")
    links = pairs.join(F.broadcast(weights), gs).where((F.col("post_p") >= min_posterior) & F.col("ok")).select("a", "b")
    both = cut(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    label = components(p.where(F.col("id") == F.col("rep")).select("id"), both)
    return p.join(label.withColumnRenamed("id", "rep"), "rep").select("address", F.col("loc").alias("location"), *FIELDS)


def typed_addresses(spark, sf_dir: str) -> DataFrame:
    po = table(spark, sf_dir, "purchase_orders").select(F.explode(F.array("vendor_address", "delivery_address")).alias("address"))
    eo = table(spark, sf_dir, "employee_onboardings").select(F.col("work_location").alias("address"))
    return po.unionByName(eo).where(F.trim("address") != "").distinct()


def p2_locations(spark, sf_dir: str) -> DataFrame:
    """(address, location), one row per distinct address string."""
    return link_addresses(typed_addresses(spark, sf_dir)).select("address", "location")


def p2_found(spark, sf_dir: str) -> DataFrame:
    at = cut(link_addresses(typed_addresses(spark, sf_dir)))
    cols = ["address", "town", "unit_kind"]
    a = at.select("location", *[F.col(c).alias(f"{c}_a") for c in cols])
    b = at.select("location", *[F.col(c).alias(f"{c}_b") for c in cols])
    pairs = a.join(b, "location").where(F.col("address_a") < F.col("address_b"))

    @F.pandas_udf("boolean")
    def agree(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([level(p, q, 3) != 3 for p, q in zip(x, y)])

    kinds = (F.col("unit_kind_a") == F.col("unit_kind_b")) | (F.col("unit_kind_a") == "any") | (F.col("unit_kind_b") == "any")
    return pairs.where(kinds & agree("town_a", "town_b")).select("address_a", "address_b")
