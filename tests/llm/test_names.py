"""Problem 4: the segment join against brute force, and links of small fixtures."""

import itertools

from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from paperloom.llm import names as N


def _osa(a, b):
    d = {}
    for i in range(-1, len(a)):
        d[i, -1] = i + 1
    for j in range(-1, len(b)):
        d[-1, j] = j + 1
    for i, j in itertools.product(range(len(a)), range(len(b))):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
        if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=7), st.text("abc", max_size=7), st.integers(1, 3))
def test_banded_distance(a, b, k):
    assert N.osa(a, b, k) == min(_osa(a, b), k + 1)


def test_segment_join_equals_brute_force(spark):
    import random

    random.seed(5)
    words = {"".join(random.choice("abcd") for _ in range(random.randint(4, 9))) for _ in range(120)}
    words |= {w[:2] + w[3:] for w in list(words)[:40]} | {w[1] + w[0] + w[2:] for w in list(words)[:40]}
    words = {w for w in words if len(w) > 1} | {"ab", "abc", "acb", "b", ""}
    df = spark.createDataFrame([("f", w) for w in words], "g string, w string")
    got = {(r.a, r.b) for r in N.similar_pairs(df, ["g"], "w", 1).collect()}
    assert got == {(a, b) for a in words for b in words if a < b and min(len(a), len(b)) > 1 and _osa(a, b) <= 1}


GIVEN = ["Elizabeth", "Robert", "William", "Nicholas", "Susan", "Thomas", "Andrew", "Victoria"]
FAMILY = ["Gajucovek", "Hohakases", "Brefanukis", "Trebubihak", "Lodogowes", "Vocosehir", "Jutrurahul", "Kebrawivor", "Marutrizul", "Picuvutrak"]


def test_people_and_firms(spark):
    rows = [("claimant_name", f"{g} {f}") for g in GIVEN for f in FAMILY[2:]]
    variants = ["Elizabeth Gajucovek", "Gajucovek, Elizabeth", "Liz Gajucovek", "ELIZABETH GAJUCOVEK", "Elizabeth M. Gajucoevk", "Mrs Elizabeth Gajucovek", "E. Gajucovek"]
    others = ["Robert Gajucovek", "Elizabeth Gajucovek jun."]
    rows += [("claimant_name", x) for x in variants + others + ["", "  "]] + [("claimant_name", None)]
    kinds = ["Steel Logistics", "Food Services", "Office Trading", "Marine Supplies", "Textile Systems"]
    rows += [("vendor", f"{c} {k} Inc") for c in ["Mejitrodon", "Kofoworan", "Satitronix", "Folililon", "Wehiretia", "Cimucivon", "Bihemonis", "Zisomegran", "Nitraluxum"] for k in kinds]
    firm = ["Resupuxis Steel Logistics Inc", "RESUPUXIS STEEL LOGISTICS", "Steel Logistics Resupuxis Incorporated", "Resupuxsi Steel Logistics Inc.", "Resupuxis Logistics Inc"]
    rows += [("vendor", x) for x in firm + ["Resupuxis Food Services Inc"]]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "name_field string, name string, n bigint").where("trim(name) <> ''").distinct()
    forms = spark.createDataFrame([("Liz", "Elizabeth"), ("Rob", "Robert")], "short_form string, given_name string")
    e = {(r.name_field, r.name): r.entity for r in N.link_names(df, forms).collect()}
    assert len({e["claimant_name", v] for v in variants}) == 1
    assert len({e["claimant_name", v] for v in [*others, variants[0]]}) == 3
    assert len({e["vendor", v] for v in firm}) == 1
    assert e["vendor", "Resupuxis Food Services Inc"] != e["vendor", firm[0]]
    assert N.link_names(df.where("name_field = 'none'"), forms).count() == 0


def test_two_edits_against_brute_force(spark):
    import random

    random.seed(6)
    words = {"".join(random.choice("abcd") for _ in range(random.randint(8, 12))) for _ in range(60)}
    for w in list(words):
        i = random.randrange(2, 6)
        words |= {w[:i] + w[i + 1] + w[i] + w[i + 2 :], w[1:4] + w[5:], "x" + w[:3] + w[4] + w[3] + w[5:]}
    df = spark.createDataFrame([("f", w) for w in words], "g string, w string")
    got = {(r.a, r.b) for r in N.similar_pairs(df, ["g"], "w", 2).collect()}
    assert got == {(a, b) for a in words for b in words if a < b and _osa(a, b) <= 2}
    some = sorted(words)[:40]
    left, right = df.where(F.col("w").isin(some)), df.where(~F.col("w").isin(some))
    got = {(r.a, r.b) for r in N.similar_pairs(left, ["g"], "w", 2, right).collect()}
    assert got == {(a, b) for a in some for b in words - set(some) if _osa(a, b) <= 2}


def test_lexicon_does_not_depend_on_the_rows(spark):
    given_, family = ["anna", "jonas", "maria", "peter"], [f"{a}{b}lo" for a in ("ber", "kun", "tas", "wil") for b in ("go", "ma", "ri")]
    rows = [("claimant_name", f"{g} {f}", 1) for g in given_ for f in family]
    more = [("claimant_name", f"{x}a{k} {x}o{k}son", 1) for k in range(40) for x in ("qu", "zy", "xe", "vo", "pi", "lu")]
    names = lambda r: spark.createDataFrame(r, "name_field string, name string, n bigint")
    assert set(N.learn_lexicon(names(rows))["claimant_name"]) == set(given_) <= set(N.learn_lexicon(names(rows + more))["claimant_name"])


def test_words_alike():
    lex = N.Lexicon({"benjamin": 90, "jenny": 9, "benny": 2, "trading": 50, "mathew": 1}, frozenset({"benny"}))
    assert lex.find("benny", False) == "benny" and lex.find("bejnamin", False) == "benjamin" and lex.find("trdg", True) == "trading" and lex.find("zzz", False) is None
