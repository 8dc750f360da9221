"""Mixed timestamp formats and zones -> one unambiguous form (problem 6).

Everything is Spark expressions: one narrow pass splits each value into date, time and zone parts,
a small aggregate per source fits the format mixture, and the winning reading is resolved to UTC.

The only reading that a value itself leaves open is the order of a numeric day and month. Per source
(table field and locale) the orders form a two-component mixture: a value contributes likelihood 1
under every order in which it is a calendar date. Expectation-maximisation runs on the
sufficient counts per source (month-first only, day-first only), so its work does not grow
with the rows; a Dirichlet prior carries the locale's convention. The posterior picks the order; if
no order reaches `min_posterior` the value is marked ambiguous.
"""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.session import table

# Month names of the four languages, by month.
MONTHS = {
    1: "january jan januar jänner janvier janv enero ene",
    2: "february feb februar février fevrier févr fév febrero",
    3: "march mar märz maerz mrz mär mars marzo",
    4: "april apr avril avr abril abr",
    5: "may mai mayo",
    6: "june jun juni juin junio",
    7: "july jul juli juillet juil julio",
    8: "august aug août aout agosto ago",
    9: "september sep sept septembre septiembre setiembre",
    10: "october oct oktober okt octobre octubre",
    11: "november nov novembre noviembre",
    12: "december dec dezember dez décembre decembre déc diciembre dic",
}
# Zone abbreviations in minutes east of UTC (IST is India's).
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0, "WET": 0, "BST": 60, "WEST": 60, "CET": 60, "MEZ": 60, "CEST": 120, "MESZ": 120,
    "EET": 120, "EEST": 180, "IST": 330, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360,
    "PST": -480, "PDT": -420, "AEST": 600, "AEDT": 660, "ACST": 570, "ACDT": 630, "AWST": 480,
}

_TIME = r"(?i)(\d{1,2})[:h](\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?\s*(a\.?m\.?|p\.?m\.?)?(?:\s*uhr)?"


def _month_map() -> Column:
    return F.create_map(*[F.lit(x) for n, names in MONTHS.items() for name in names.split() for x in (name, n)])


def _int(c: Column) -> Column:
    return c.try_cast("int")


def _valid(y: Column, m: Column, d: Column) -> Column:
    """The calendar date, null when there is no such day."""
    return F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd")


def _year(c: Column) -> Column:
    return F.when(F.length(c) == 2, _int(c) + 2000).otherwise(_int(c))


def split_parts(df: DataFrame, value: str = "value") -> DataFrame:
    """Date, time and zone parts of each value; the numeric orders stay open."""
    v = F.trim(F.regexp_replace(F.col(value), "[\\u00a0\\u202f\\s]+", " "))
    df = df.withColumn("_v", v)
    v = F.col("_v")
    epoch = v.rlike(r"^-?\d{9,10}$|^\d{12,13}$|^\d{15,16}$|^\d{18,19}$")
    is_compact = v.rlike(r"^\d{8}(?:[T ]\d{4,6}(?:[.,]\d+)?|\d{6})?\s*(?:Z|[+-]\d{2}:?\d{2}|[A-Z]{2,4}|\[.*\])?$") & ~epoch
    # compact values are rewritten to the dashed form, so one grammar follows
    dashed = F.regexp_replace(
        F.regexp_replace(v, r"^(\d{4})(\d{2})(\d{2})", "$1-$2-$3"), r"^(\d{4}-\d\d-\d\d)[T ]?(\d{2})(\d{2})(\d{2})?", "$1T$2:$3:$4"
    )
    dashed = F.regexp_replace(dashed, r"^(\d{4}-\d\d-\d\dT\d\d:\d\d):(?!\d)", "$1")
    s = F.when(is_compact, dashed).otherwise(v)
    # weekday in front carries nothing
    s = F.regexp_replace(s, r"(?i)^(?:mon|tue|wed|thu|fri|sat|sun|mo|di|mi|do|fr|sa|so|lun|mar|mer|jeu|ven|sam|dim|mié|jue|vie|sáb|dom)[a-zéáûä]*\.?,\s*", "")
    df = df.withColumn("_epoch", F.when(epoch, v)).withColumn("_s", s)
    s = F.col("_s")
    ymd = r"^(\d{4})[-./](\d{1,2})[-./](\d{1,2})(?=$|[T ,\[])"
    num = r"^(\d{1,2})([-./])(\d{1,2})\2(\d{4}|\d{2})(?=$|[T ,\[])"
    dmy_name = r"(?i)^(\d{1,2})(?:\.|st|nd|rd|th|er|º)?(?: de)?[ -]([\p{L}]{3,10})\.?(?: de|,)?[ -](\d{4}|\d{2})(?=$|[T ,\[])"
    mdy_name = r"(?i)^([\p{L}]{3,10})\.? (\d{1,2})(?:st|nd|rd|th)?,? (\d{4})(?=$|[T ,\[])"
    month = _month_map()
    kind = (
        F.when(s.rlike(ymd), "ymd").when(s.rlike(num), "num").when(s.rlike(dmy_name), "dname").when(s.rlike(mdy_name), "mname")
    )
    df = df.withColumn("_kind", kind)
    k = F.col("_kind")
    pat = {"ymd": ymd, "num": num, "dname": dmy_name, "mname": mdy_name}
    g = lambda p, i: F.regexp_extract(s, pat[p], i)
    head = F.when(k == "ymd", g("ymd", 0)).when(k == "num", g("num", 0)).when(k == "dname", g("dname", 0)).when(k == "mname", g("mname", 0))
    df = (
        df.withColumn("_rest", F.regexp_replace(F.substr(s, F.length(head) + 1), r"^(?:T|,? ?(?:at|um|à|a las)?) ?", ""))
        .withColumn("_date", F.when(k == "ymd", _valid(_int(g("ymd", 1)), _int(g("ymd", 2)), _int(g("ymd", 3))))
            .when(k == "dname", _valid(_year(g("dname", 3)), month[F.lower(g("dname", 2))], _int(g("dname", 1))))
            .when(k == "mname", _valid(_int(g("mname", 3)), month[F.lower(g("mname", 1))], _int(g("mname", 2)))))
        .withColumn("_dmy", F.when(k == "num", _valid(_year(g("num", 4)), _int(g("num", 3)), _int(g("num", 1)))))
        .withColumn("_mdy", F.when(k == "num", _valid(_year(g("num", 4)), _int(g("num", 1)), _int(g("num", 3)))))
    )
    rest = F.col("_rest")
    t = lambda i: F.regexp_extract(rest, "^" + _TIME, i)
    half = F.regexp_replace(F.lower(t(5)), r"\.", "")
    hour = _int(t(1))
    hour = F.when(half == "", hour).when((hour < 1) | (hour > 12), F.lit(None)).when(half == "pm", hour % 12 + 12).otherwise(hour % 12)
    seconds = F.coalesce(_int(t(3)), F.lit(0))
    micros = F.coalesce(_int(F.rpad(F.substring(t(4), 1, 6), 6, "0")), F.lit(0))
    ok = (hour <= 23) & (_int(t(2)) <= 59) & (seconds <= 59)
    has_time = t(0) != ""
    tail = F.trim(F.substr(rest, F.length(t(0)) + 1))
    return (
        df.withColumn("_has_time", has_time)
        .withColumn("_us", F.when(has_time & ok, ((hour * 3600 + _int(t(2)) * 60 + seconds).cast("bigint") * 1000000 + micros)))
        .withColumn("_tail", F.when(has_time, tail).otherwise(rest))
    )


def fit_orders(parts: DataFrame, prior: float = 20.0) -> DataFrame:
    """Posterior share of month-first per source, by EM on the sufficient counts of each source.

    The E-step gives a date open to both orders the share p of month-first, the M-step sets p to
    (n_m + n_b p + prior s) / (n_m + n_d + n_b + prior). Their fixed point is taken directly, since the rounds to it have
    no bound where nearly all dates are open.
    """
    n = lambda c: F.sum(c.cast("bigint"))
    counts = parts.where(F.col("_kind") == "num").groupBy("source", "site_locale").agg(
        n(F.col("_mdy").isNotNull() & F.col("_dmy").isNull()).alias("n_m"),
        n(F.col("_mdy").isNull() & F.col("_dmy").isNotNull()).alias("n_d"),
    )
    start = F.when(F.col("site_locale") == "en_US", F.lit(1.0 - 1e-6)).otherwise(F.lit(1e-6))
    return counts.select("source", "site_locale", ((F.col("n_m") + prior * start) / (F.col("n_m") + F.col("n_d") + prior)).alias("_p_mdy"))


def utc_forms(values: DataFrame, min_posterior: float = 0.6, one_order: bool = True) -> DataFrame:
    """`values` (source, site_zone, site_locale, value, ...) plus utc_form.

    Null values are dropped; empty or wordy values are `unreadable`. A local time that its zone has
    twice or never is `ambiguous` / `nonexistent`. With `one_order` a date that is no date in the order of its
    source is `unreadable`; without, it keeps the one order in which it is a date. Extra columns are kept.
    """
    parts = split_parts(values.where(F.col("value").isNotNull()))
    orders = fit_orders(parts)  # one row per source and locale
    df = parts.join(F.broadcast(orders), ["source", "site_locale"], "left")
    p = F.coalesce(F.col("_p_mdy"), F.lit(0.5))
    first = F.coalesce(F.col("_p_mdy"), F.lit(0.5)) >= min_posterior
    second = F.lit(1.0) - p >= min_posterior
    num_date = F.when(first, F.col("_mdy")).when(second, F.col("_dmy"))
    open_order = (F.col("_kind") == "num") & ~first & ~second
    if not one_order:
        num_date = F.coalesce(num_date, F.when(F.col("_dmy").isNull(), F.col("_mdy")).when(F.col("_mdy").isNull(), F.col("_dmy")))
        open_order = open_order & F.col("_dmy").isNotNull() & F.col("_mdy").isNotNull()
    date = F.coalesce(F.col("_date"), num_date)
    tail = F.col("_tail")
    zone_name = F.regexp_extract(tail, r"^\[([A-Za-z_]+(?:/[A-Za-z_+\-0-9]+)+)\]$", 1)
    off = F.regexp_extract(tail, r"^(?:UTC|GMT)?([+-])(\d{2}):?(\d{2})?(?:\[.*\])?$", 0)
    sign = F.when(F.regexp_extract(tail, r"([+-])\d{2}", 1) == "-", -1).otherwise(1)
    off_min = sign * (_int(F.regexp_extract(tail, r"[+-](\d{2})", 1)) * 60 + F.coalesce(_int(F.regexp_extract(tail, r"[+-]\d{2}:?(\d{2})", 1)), F.lit(0)))
    abbr = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])[F.upper(F.regexp_extract(tail, r"^\(?([A-Za-z]{1,4})\)?$", 1))]
    fixed = F.when(off != "", off_min).otherwise(abbr)
    known = [z for z in sorted(zoneinfo.available_timezones()) if "/" in z and not z.startswith(("posix", "right", "build", "SystemV"))]
    named = zone_name.isin(known)
    site = F.when(F.col("site_zone").isin([*known, "UTC"]), F.col("site_zone"))
    zone = F.when(named, zone_name).when(tail == "", site)
    df = df.select(*values.columns, F.col("_epoch"), date.alias("_d"), open_order.alias("_open"), "_has_time", "_us", "_tail", fixed.alias("_fixed"), zone.alias("_zone"))
    df = df.withColumn("_local", F.expr("timestampadd(MICROSECOND, _us, cast(_d as timestamp_ntz))"))
    df = df.withColumn("_u", F.expr("case when _fixed is not null then timestampadd(MINUTE, -_fixed, _local) when _zone is not null then convert_timezone(_zone, 'UTC', _local) end"))
    back = lambda shift: F.expr(f"convert_timezone('UTC', _zone, timestampadd(MINUTE, {shift}, _u)) = _local")
    by_zone = F.col("_fixed").isNull() & F.col("_zone").isNotNull()
    epoch_us = F.expr(
        "case length(ltrim('-', _epoch)) when 9 then bigint(_epoch) * 1000000 when 10 then bigint(_epoch) * 1000000 when 12 then bigint(_epoch) * 1000 when 13 then bigint(_epoch) * 1000 when 15 then bigint(_epoch) when 16 then bigint(_epoch) else try_divide(bigint(_epoch), 1000) end"
    )
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    out = (
        F.when(F.col("_epoch").isNotNull(), stamp(F.expr("timestampadd(MICROSECOND, _eus, timestamp_ntz'1970-01-01 00:00:00')")))
        .when(F.col("_open"), "ambiguous")
        .when(F.col("_d").isNull(), "unreadable")
        .when(~F.col("_has_time") & (F.col("_tail") == ""), F.date_format(F.col("_d"), "yyyy-MM-dd"))
        .when(F.col("_u").isNull(), "unreadable")
        .when(by_zone & ~back(0), "nonexistent")
        .when(by_zone & (back(60) | back(-60) | back(30) | back(-30)), "ambiguous")
        .otherwise(stamp(F.col("_u")))
    )
    return df.withColumn("_eus", epoch_us.cast("bigint")).select(*values.columns, out.alias("utc_form"))


def p6_found(spark, sf_dir: str) -> DataFrame:
    """Every time value of the three tables with its one form; a key delivered twice counts once."""
    po = table(spark, sf_dir, "purchase_orders").select(
        F.lit("purchase_orders").alias("record_table"), F.col("po_id").cast("bigint").alias("record_id"), F.lit("order_date").alias("field_name"), "site_zone", "site_locale", F.col("order_date").alias("value"))
    ic = table(spark, sf_dir, "insurance_claims").select(
        F.lit("insurance_claims").alias("record_table"), F.col("claim_id").cast("bigint").alias("record_id"), F.lit("incident_date").alias("field_name"), "site_zone", "site_locale", F.col("incident_date").alias("value"))
    e = table(spark, sf_dir, "ner_results").select("site_zone", "site_locale", F.explode("entities").alias("e")).where(F.col("e.entity_type") == "DATE")
    e = e.select("site_zone", "site_locale", F.col("e.entity_id").cast("bigint").alias("record_id"), F.explode(F.create_map(F.lit("raw"), "e.raw", F.lit("normalized"), "e.normalized")).alias("field_name", "value"))
    e = e.select(F.lit("ner_results").alias("record_table"), "record_id", "field_name", "site_zone", "site_locale", "value")
    values = po.unionByName(ic).unionByName(e).where(F.col("value").isNotNull()).distinct()
    values = values.withColumn("source", F.concat_ws(".", "record_table", "field_name"))
    return utc_forms(values).select("record_table", "record_id", "field_name", "utc_form")
