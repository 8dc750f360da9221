"""Forms, zones, gaps and overlaps of problem 6; null, empty and clashing columns."""

import pytest

from paperloom.operators.timestamps import utc_forms

CASES = [
    ("2024-01-15T16:05:00Z", "America/New_York", "en_US", "2024-01-15T16:05:00.000000Z"),
    ("2024-01-15 11:05 EST", "Europe/Paris", "fr_FR", "2024-01-15T16:05:00.000000Z"),
    ("01/02/2024 10:00", "America/New_York", "en_US", "2024-01-02T15:00:00.000000Z"),
    ("01/02/2024 10:00", "Europe/London", "en_GB", "2024-02-01T10:00:00.000000Z"),
    ("15. März 2023", "Europe/Berlin", "de_DE", "2023-03-15"),
    ("3 de mayo de 2021, 19:12", "Europe/Madrid", "es_ES", "2021-05-03T17:12:00.000000Z"),
    ("2023-03-26 02:30", "Europe/Berlin", "de_DE", "nonexistent"),
    ("2023-10-29 02:30", "Europe/Berlin", "de_DE", "ambiguous"),
    ("2023-10-29 02:30 MEZ", "Europe/Berlin", "de_DE", "2023-10-29T01:30:00.000000Z"),
    ("1609761973812", "Asia/Kolkata", "en_IN", "2021-01-04T12:06:13.812000Z"),
    ("1609800730", "Asia/Kolkata", "en_IN", "2021-01-04T22:52:10.000000Z"),
    ("20210116T051259", "America/New_York", "en_US", "2021-01-16T10:12:59.000000Z"),
    ("20210110", "Europe/Paris", "fr_FR", "2021-01-10"),
    ("12:30 am", "Europe/Paris", "fr_FR", "unreadable"),
    ("03/13/2022 12:30 AM", "America/Chicago", "en_US", "2022-03-13T06:30:00.000000Z"),
    ("Sun, 03 Oct 2021 01:51:26 +1000", "Australia/Sydney", "en_AU", "2021-10-02T15:51:26.000000Z"),
    ("2021-03-28 01:01[Europe/Paris]", "Asia/Kolkata", "en_IN", "2021-03-28T00:01:00.000000Z"),
    ("2021-03-28 01:01[No/Where]", "Asia/Kolkata", "en_IN", "unreadable"),
    ("2023-02-30T10:00:00Z", "Europe/Paris", "fr_FR", "unreadable"),
    ("31/02/2023", "Europe/Paris", "fr_FR", "unreadable"),
    ("04-02-21", "Europe/London", "en_GB", "2021-02-04"),
    ("TBD", "Europe/Paris", "fr_FR", "unreadable"),
    ("", "Europe/Paris", "fr_FR", "unreadable"),
]


@pytest.fixture(scope="module")
def forms(spark):
    rows = [("t.c", z, l, v, i, "x") for i, (v, z, l, _) in enumerate(CASES)] + [("t.c", "Europe/Paris", "fr_FR", None, 999, "x")]
    df = spark.createDataFrame(rows, "source string, site_zone string, site_locale string, value string, i int, utc string")
    return {r.i: r.utc_form for r in utc_forms(df).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_form(forms, i):
    assert forms[i] == CASES[i][3]


def test_nulls_have_no_row(forms):
    assert 999 not in forms


def test_empty_table(spark):
    df = spark.createDataFrame([], "source string, site_zone string, site_locale string, value string")
    assert utc_forms(df).count() == 0


def test_orders_by_source(spark):
    from paperloom.operators import timestamps as T

    rows = [("s", "UTC", "de_DE", v) for v in ["03/25/2024", "13/02/2024", "04/05/2024", "", None, "31.02.2024"]]
    df = spark.createDataFrame(rows, "source string, site_zone string, site_locale string, value string")
    strict = {r.value: r.utc_form for r in T.utc_forms(df).collect()}
    assert strict == {"03/25/2024": "unreadable", "13/02/2024": "2024-02-13", "04/05/2024": "2024-05-04", "": "unreadable", "31.02.2024": "unreadable"}
    loose = {r.value: r.utc_form for r in T.utc_forms(df, one_order=False).collect()}
    assert loose == strict | {"03/25/2024": "2024-03-25"}
