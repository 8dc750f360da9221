"""Layout of pages from their word boxes, reading order and cells, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import documents as doc
from paperloom.operators import layout
from paperloom.plans.q_more import WORDS, words
from paperloom.session import cut

Q: dict[str, tuple] = {}


def q(name: str, sql: str | None = None):
    def put(f):
        Q[name] = (f, sql)
        return f

    return put


_NUM = layout.NUMBER.replace("'", "''")
# what the features are, from their definition
FEAT = f"""w AS (SELECT page_id, word, l, t, w AS wd, h, l+w AS r FROM {WORDS}), cx AS (SELECT page_id, round((l+l+wd)/2,6) AS x, count(*) AS n FROM w GROUP BY ALL),
 nr AS (SELECT page_id, x, sum(n) OVER (PARTITION BY page_id ORDER BY x RANGE BETWEEN 0.05 PRECEDING AND 0.05 FOLLOWING) AS near FROM cx), co AS (SELECT page_id, x, lag(x) OVER (PARTITION BY page_id ORDER BY x) AS px FROM nr WHERE near>=3),
 cl AS (SELECT page_id, count_if(px IS NULL OR x-px>0.05) AS n_columns FROM co GROUP BY 1), tp AS (SELECT DISTINCT page_id, round_even(t,2) AS t FROM w), gp AS (SELECT page_id, t-lag(t) OVER (PARTITION BY page_id ORDER BY t) AS gap FROM tp), gc AS (SELECT page_id, stddev_pop(gap)/(avg(gap)+1e-9) AS gap_cv FROM gp WHERE gap IS NOT NULL GROUP BY 1),
 ft AS (SELECT page_id, count(*) AS n_words, avg(contains(word,':')::INT) AS colon_ratio, CASE WHEN avg(h)>0 THEN stddev_pop(h)/(avg(h)+1e-9) ELSE 1.0 END AS height_cv, (max(r)-min(l))/greatest(max(t+h)-min(t),1e-6) AS bb_aspect, sum(wd*h) AS coverage, stddev_pop((l+r)/2) AS cx_std, stddev_pop(t+h/2) AS cy_std,
  [count_if(t>=0.0 AND t<0.2)::DOUBLE, count_if(t>=0.2 AND t<0.4), count_if(t>=0.4 AND t<0.6), count_if(t>=0.6 AND t<0.8), count_if(t>=0.8 AND t<1.0)] AS bands, avg((length(trim(word))<=3)::INT) AS short_word_ratio, avg(regexp_matches(trim(word),'{_NUM}')::INT) AS num_ratio, avg((r<0.5 OR l>0.5)::INT) AS bimodal_ratio, count(*)/count(DISTINCT round_even(t*100,0)) AS avg_words_per_line FROM w GROUP BY 1),
 fe AS (SELECT ft.*, coalesce(gap_cv,1.0) AS gap_cv, coalesce(n_columns,0) AS n_columns FROM ft LEFT JOIN gc USING (page_id) LEFT JOIN cl USING (page_id)),
 ru AS (SELECT page_id, strat.n AS rule FROM fe, LATERAL (SELECT CASE WHEN n_words<5 THEN 1 WHEN colon_ratio>0.18 AND round_even(colon_ratio*n_words,0)>=3 OR colon_ratio>0.25 AND n_words>=8 THEN 2 WHEN gap_cv<0.25 AND height_cv<0.20 AND num_ratio>0.08 THEN 3 WHEN n_words>50 AND num_ratio<0.06 AND colon_ratio<0.06 AND NOT (cx_std>0.25 AND bimodal_ratio>0.70 OR n_columns>=3 AND cx_std>0.22 AND bimodal_ratio>0.55) THEN 4 WHEN n_columns>=2 AND bimodal_ratio>0.70 AND cx_std>0.25 THEN 5 WHEN n_columns>=3 AND cx_std>0.22 AND bimodal_ratio>0.55 THEN 6 END AS n) strat)"""
_R = ["gap_cv", "height_cv", "bb_aspect", "coverage", "cx_std", "cy_std", "short_word_ratio", "num_ratio", "bimodal_ratio", "avg_words_per_line", "colon_ratio"]


@q("page_features", f"WITH {FEAT} SELECT page_id, n_words, n_columns, {', '.join(f'round({c},5) AS {c}' for c in _R)}, round(list_aggregate(bands,'stddev_pop')/(list_aggregate(bands,'avg')+1e-9),5) AS band_cv FROM fe")
def page_features(spark, d):
    """The features of a page but the density of left edges, which is tested against its definition."""
    f = layout.page_features(words(spark, d), "page_id", peaks=False)
    return f.select("page_id", "n_words", "n_columns", *[F.round(c, 5).alias(c) for c in [*_R, "band_cv"]])


@q("layout_rules", f"WITH {FEAT} SELECT page_id, ['SINGLE_COLUMN','FORM','TABLE_HEAVY','SINGLE_COLUMN','MULTI_COLUMN','MULTI_COLUMN'][rule] AS layout, round([0.55,least(0.65+1.2*colon_ratio,0.95),0.88,0.80,0.85,0.80][rule],4) AS confidence FROM ru JOIN fe USING (page_id)")
def layout_rules(spark, d):
    """The layout that the ordered rules give; null where they leave the page to the forest."""
    f = layout.rule_layout(layout.page_features(words(spark, d), "page_id", peaks=False))
    return f.select("page_id", F.col("rule_layout").alias("layout"), F.round("rule_confidence", 4).alias("confidence"))


@q("layout_forest")
def layout_forest(spark, d):
    """Rules where they are sure, else the forest on all features, with the strategy of the layout."""
    return layout.classify(cut(layout.page_features(words(spark, d), "page_id")), "page_id")


@q("layout_strategy", f"WITH {FEAT} SELECT coalesce(['sequential','form_kv','table_grid','sequential','column_split','column_split'][rule],'undecided') AS strategy, count(*) AS pages FROM ru GROUP BY 1")
def layout_strategy(spark, d):
    """How many pages the rules send to each way of reading."""
    f = layout_rules(spark, d)
    s = F.when(F.col("layout").isNull(), "undecided").otherwise(layout.strategy(F.col("layout")))
    return f.groupBy(s.alias("strategy")).agg(F.count("*").alias("pages"))


# ---- pixel boxes, as a scanner writes them for a page of 1000 x 1400
@q("unit_boxes", f"SELECT page_id, count(*) AS n, round(max(l+w),4) AS right_edge, round(max(t+h),4) AS bottom FROM {WORDS} GROUP BY 1")
def unit_boxes(spark, d):
    w = words(spark, d).select("page_id", "word", (F.col("left") * 10000).alias("left"), (F.col("top") * 14000).alias("top"), (F.col("width") * 10000).alias("width"), (F.col("height") * 14000).alias("height"), F.lit(10000.0).alias("pw"), F.lit(14000.0).alias("ph"))
    far = (F.col("left") + F.col("width") > 2) | (F.col("top") + F.col("height") > 2)
    u = layout.unit_boxes(w.where(far), "pw", "ph").unionByName(w.where(~far).select("page_id", "word", "pw", "ph", *[(F.col(c) / F.lit(x)).alias(c) for c, x in (("left", 10000.0), ("top", 14000.0), ("width", 10000.0), ("height", 14000.0))]))
    return u.groupBy("page_id").agg(F.count("*").alias("n"), F.round(F.max(F.col("left") + F.col("width")), 4).alias("right_edge"), F.round(F.max(F.col("top") + F.col("height")), 4).alias("bottom"))


SIDES = f"(SELECT *, CASE WHEN count_if(l+w/2>0.5) OVER (PARTITION BY page_id)>=3 AND l+w/2>0.5 THEN 1 ELSE 0 END AS side FROM {WORDS})"


@q("two_column_words", f"SELECT page_id, side, count(*) AS words, string_agg(word,'' ORDER BY word) AS letters FROM {SIDES} GROUP BY ALL")
def two_column_words(spark, d):
    """The words of each side of a page, before they are put in order; fewer than three on the right make one column."""
    s = doc.column_sides(words(spark, d), "page_id")
    return s.groupBy("page_id", "side").agg(F.count("*").alias("words"), F.array_join(F.sort_array(F.collect_list("word")), "").alias("letters"))


@q("two_column_text")
def two_column_text(spark, d):
    """The text of each page, the left column before the right one."""
    return doc.column_text(words(spark, d), "page_id")
