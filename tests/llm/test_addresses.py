"""Problem 2: parsing in four countries' orders, linkage weights, links and traps."""

import pandas as pd
import pytest

from paperloom.llm import addresses as A

CASES = [
    ("168 Ropewalk Boulevard, Cimucinford, OH 03880", ("168", "", "", "", "ropewalk", "boulevard", "", "cimucinford", "oh", "03880")),
    ("Attn: Goods In, Geditrorford - NV 53011 - 80D Falcon St.", ("80", "d", "", "", "falcon", "street", "", "geditrorford", "nv", "53011")),
    ("5D Saddlers Ln., #9, Jojazidorf, QD26HG", ("5", "d", "any", "9", "saddlers", "lane", "", "jojazidorf", "", "qd26hg")),
    ("4 S MEADOW LARK STR, FLOOR 5, LULEGUMWICK, OH", ("4", "", "floor", "5", "meadowlark", "street", "s", "lulegumwick", "oh", "")),
    ("Schmiede-Straße 22, Etage 1\n48039 Vugevedmouth\nDeutschland", ("22", "", "floor", "1", "schmiede", "strasse", "", "vugevedmouth", "", "48039")),
    ("1C, rue de l'Écluse, bur. 6, 17693 Lewunakford", ("1", "c", "suite", "6", "ecluse", "rue", "", "lewunakford", "", "17693")),
    ("133 r. des Tanneurs, 92833 Trikiwalbridge", ("133", "", "", "", "tanneurs", "rue", "", "trikiwalbridge", "", "92833")),
    ("pl. 3, C/ de las Acequias, nº 63C - Kavibumburg", ("63", "c", "floor", "3", "acequias", "calle", "", "kavibumburg", "", "")),
    ("52 SLATE DRIVE QF7 5DG", ("52", "", "", "", "slate", "drive", "", "", "", "qf75dg")),
]


@pytest.mark.parametrize("text,want", CASES)
def test_parse(text, want):
    assert A.parse(text) == want


@pytest.mark.parametrize("text", [None, "", "  ", "TBC", "Hybrid (2 days office)", "see master data", "80123"])
def test_no_address(text):
    assert A.parse(text) is None


def test_weights_prefer_agreement():
    p = pd.DataFrame([(0, 0, 0, 0, 0, 50), (0, 0, 0, 2, 0, 30), (1, 0, 0, 0, 0, 20), (3, 3, 3, 3, 3, 200), (3, 0, 3, 3, 3, 80), (3, 3, 0, 0, 0, 40), (0, 0, 2, 2, 0, 10)], columns=["g0", "g1", "g2", "g3", "g4", "n"])
    share, m, u = A.fit_weights(p)
    assert 0 < share < 1 and m[0, 0] > u[0, 0] and u[0, 3] > m[0, 3]


def test_links(spark):
    same = ["80 Falcon Street, Geditrorford, NV 53011", "80 FALCON ST, GEDITRORFORD, NV 53011", "NV 53011, 80 Falcon Str", "80 Facon Street, Geditrorford, NV 53011", "Warehouse: 80 Falcon Street, Geditrorford, NV", "Geditrorford 53011 80 Falcon Street"]
    other = ["80D Falcon Street, Geditrorford, NV 53011", "80 Falcon Street, Suite 2, Geditrorford, NV 53011", "80 Falcon Court, Geditrorford, NV 53011", "80 Falcon Street, Hohakambridge, MN 36478", "81 Falcon Street, Geditrorford, NV 53011"]
    more = [f"{n} {s} Road, {t} {z}" for n in range(10, 16) for s in ("Granary", "Harrow", "Cinder") for t, z in (("Zafesiton, TX", "41450"), ("Lulegumwick, OH", "08852"))]
    rows = [(x,) for x in same + other + more + [x.upper() for x in more] + ["TBC", "Remote"]]
    got = {r.address: r.location for r in A.link_addresses(spark.createDataFrame(rows, "address string")).collect()}
    assert len({got[x] for x in same}) == 1
    assert len({got[x] for x in other} | {got[same[0]]}) == len(other) + 1
    assert "TBC" not in got and all(got[x] == got[x.upper()] for x in more)
    assert A.link_addresses(spark.createDataFrame([], "address string")).count() == 0


def test_long_chains_become_one_location(spark, monkeypatch):
    # forty links in a row, each of which is the only one between its ends
    from paperloom.session import cut

    n = 40
    both = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(i + 1, i) for i in range(n)], "a bigint, b bigint")
    assert {r.loc for r in A.components(spark.createDataFrame([(i,) for i in range(n + 2)], "id bigint"), cut(both)).where(f"id <= {n}").collect()} == {0}
