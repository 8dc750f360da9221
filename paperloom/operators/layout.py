"""Layout of pages given as word boxes: fifteen features, ordered rules, a random forest for the rest, the blend of both."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Features of a page, and the prototype of each layout in that order.
FEATURES = ["n_words", "n_columns", "left_peaks", "colon_ratio", "gap_cv", "height_cv", "bb_aspect", "coverage", "cx_std", "cy_std", "band_cv", "short_word_ratio", "num_ratio", "bimodal_ratio", "avg_words_per_line"]
PROTOTYPES = {
    "SINGLE_COLUMN": (180, 1, 2, 0.02, 0.55, 0.30, 0.70, 0.08, 0.10, 0.28, 0.20, 0.12, 0.04, 0.35, 8.0),
    "MULTI_COLUMN": (240, 2.5, 4, 0.01, 0.45, 0.25, 1.10, 0.11, 0.28, 0.26, 0.15, 0.10, 0.05, 0.80, 5.0),
    "FORM": (90, 1.5, 3, 0.28, 0.30, 0.18, 0.85, 0.05, 0.12, 0.25, 0.30, 0.22, 0.12, 0.40, 3.5),
    "TABLE_HEAVY": (150, 4, 5, 0.01, 0.15, 0.12, 1.50, 0.09, 0.30, 0.20, 0.10, 0.08, 0.35, 0.60, 6.0),
    "MIXED": (130, 2, 4, 0.12, 0.35, 0.25, 0.90, 0.07, 0.18, 0.24, 0.22, 0.15, 0.18, 0.50, 4.5),
}
STRATEGIES = {"SINGLE_COLUMN": "sequential", "MULTI_COLUMN": "column_split", "FORM": "form_kv", "TABLE_HEAVY": "table_grid", "MIXED": "combined"}
NUMBER = r"^[\d,\.\$€£%\-\+\/]+$"


def unit_boxes(words: DataFrame, page_width: str, page_height: str) -> DataFrame:
    """Boxes (left, top, width, height) in units of the page if one of them is beyond 2 and the page is larger than 1; else as they are."""
    w, h = F.col(page_width), F.col(page_height)
    pixels = ((F.col("left") + F.col("width") > 2) | (F.col("top") + F.col("height") > 2)) & (w > 1) & (h > 1)
    by = lambda c, size: F.when(pixels, F.col(c) / size).otherwise(F.col(c)).alias(c)
    return words.select(*[c for c in words.columns if c not in ("left", "top", "width", "height")], by("left", w), by("top", h), by("width", w), by("height", h))


def _peaks():
    """Grid points at which the density of left edges is above three tenths of its greatest value."""

    @F.pandas_udf("int")
    def of(lefts: pd.Series) -> pd.Series:
        grid = np.linspace(0, 1, 200)

        def one(x) -> int:
            x = np.asarray(x, float)
            spread = x.std(ddof=1) * 0.05 if len(x) > 1 else 0.0
            if not spread:
                return 1
            density = np.exp(-0.5 * ((grid[:, None] - x[None, :]) / spread) ** 2).sum(axis=1)
            return int((density > density.max() * 0.3).sum())

        return lefts.map(one)

    return of


def _columns(words: DataFrame, key: str, eps: float, least: int) -> DataFrame:
    """(key, n_columns): density clusters of word centres, counted by the cores that start one."""
    d = words.select(key, (F.col("left") + F.col("left") + F.col("width")).alias("x2")).withColumn("x", F.round(F.col("x2") / 2, 6)).groupBy(key, "x").agg(F.count("*").alias("n"))
    near = F.expr(f"sum(n) over (partition by {key} order by x range between {eps}D preceding and {eps}D following)")
    cores = d.withColumn("near", near).where(F.col("near") >= least)
    before = F.lag("x").over(Window.partitionBy(key).orderBy("x"))
    starts = cores.withColumn("start", (before.isNull() | (F.col("x") - before > eps)).cast("int"))
    return starts.groupBy(key).agg(F.sum("start").alias("n_columns"))


def page_features(words: DataFrame, key: str, peaks: bool = True) -> DataFrame:
    """(key, FEATURES) of word boxes (key, word, left, top, width, height) in units of the page.

    Pages without words have no row. Windows run within one page. `left_peaks` needs Python and is left out without `peaks`.
    """
    left, right, top, height = F.col("left"), F.col("left") + F.col("width"), F.col("top"), F.col("height")
    word = F.trim("word")
    share = lambda c: F.avg(c.cast("int"))
    bands = [F.sum(((top >= F.lit(i / 5)) & (top < F.lit((i + 1) / 5))).cast("int")) for i in range(5)]
    cv = lambda c: F.when(F.avg(c) > 0, F.stddev_pop(c) / (F.avg(c) + 1e-9)).otherwise(1.0)
    f = words.groupBy(key).agg(
        F.count("*").alias("n_words"), share(F.col("word").contains(":")).alias("colon_ratio"), cv(height).alias("height_cv"),
        ((F.max(right) - F.min(left)) / F.greatest(F.max(top + height) - F.min(top), F.lit(1e-6))).alias("bb_aspect"), F.sum(F.col("width") * height).alias("coverage"),
        F.stddev_pop((left + right) / 2).alias("cx_std"), F.stddev_pop(top + height / 2).alias("cy_std"), F.array(*bands).alias("bands"),
        share(F.length(word) <= 3).alias("short_word_ratio"), share(word.rlike(NUMBER)).alias("num_ratio"), share((right < 0.5) | (left > 0.5)).alias("bimodal_ratio"),
        (F.count("*") / F.countDistinct(F.bround(top * 100))).alias("avg_words_per_line"), *([F.collect_list("left").alias("lefts")] if peaks else []))
    mean = F.aggregate("bands", F.lit(0.0), lambda a, x: a + x) / 5
    spread = F.sqrt(F.aggregate("bands", F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / 5)
    f = f.withColumn("band_cv", spread / (mean + 1e-9))
    # gaps between the distinct tops of rows
    tops = words.select(key, F.bround("top", 2).alias("t")).distinct()
    gaps = tops.withColumn("gap", F.col("t") - F.lag("t").over(Window.partitionBy(key).orderBy("t"))).where("gap is not null")
    gaps = gaps.groupBy(key).agg((F.stddev_pop("gap") / (F.avg("gap") + 1e-9)).alias("gap_cv"))
    f = f.join(gaps, key, "left").join(_columns(words, key, 0.05, 3), key, "left").withColumn("gap_cv", F.coalesce("gap_cv", F.lit(1.0))).withColumn("n_columns", F.coalesce("n_columns", F.lit(0)))
    if peaks:
        f = f.withColumn("left_peaks", _peaks()("lefts"))
    return f.select(key, *[x for x in FEATURES if peaks or x != "left_peaks"])


def rule_layout(f: DataFrame) -> DataFrame:
    """Adds rule_layout and rule_confidence by the ordered rules; null where none decides."""
    c = F.col
    n, colon, num, cx, bim = c("n_words"), c("colon_ratio"), c("num_ratio"), c("cx_std"), c("bimodal_ratio")
    form = (colon > 0.18) & (F.bround(colon * n) >= 3) | (colon > 0.25) & (n >= 8)
    table = (c("gap_cv") < 0.25) & (c("height_cv") < 0.20) & (num > 0.08)
    three = (c("n_columns") >= 3) & (cx > 0.22) & (bim > 0.55)
    several = (cx > 0.25) & (bim > 0.70) | three
    dense = (n > 50) & (num < 0.06) & (colon < 0.06) & ~several
    two = (c("n_columns") >= 2) & (bim > 0.70) & (cx > 0.25)

    def chain(*values) -> Column:
        out = F.when(n < 5, values[0])
        for cond, v in zip((form, table, dense, two, three), values[1:]):
            out = out.when(cond, v)
        return out

    names = chain(*map(F.lit, ("SINGLE_COLUMN", "FORM", "TABLE_HEAVY", "SINGLE_COLUMN", "MULTI_COLUMN", "MULTI_COLUMN")))
    sure = chain(F.lit(0.55), F.least(0.65 + 1.2 * colon, F.lit(0.95)), F.lit(0.88), F.lit(0.80), F.lit(0.85), F.lit(0.80))
    return f.withColumn("rule_layout", names).withColumn("rule_confidence", sure)


def fit_forest(spark, samples: int = 40, sigma: float = 0.04, trees: int = 120, seed: int = 42):
    """(assembler, model) of a forest on jittered prototypes; the training rows are PROTOTYPES x samples, whatever the data."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rng = np.random.default_rng(seed)
    rows = [(float(i), *np.clip(np.array(p) + rng.normal(0, sigma, len(p)), 0, None).tolist()) for i, p in enumerate(PROTOTYPES.values()) for _ in range(samples)]
    asm = VectorAssembler(inputCols=FEATURES, outputCol="_features")
    train = asm.transform(spark.createDataFrame(rows, ["label", *FEATURES]))
    return asm, RandomForestClassifier(featuresCol="_features", numTrees=trees, maxDepth=8, minInstancesPerNode=3, seed=seed).fit(train)


def classify(features: DataFrame, key: str, forest=None) -> DataFrame:
    """(key, layout, confidence, strategy): rules of 0.80 or more, and pages of under five words, by rule; others by the forest.

    Where a weaker rule agrees with the forest the confidence is their mean and 0.05, at most 0.97; where it does not, 0.9 of the forest's.
    """
    from pyspark.ml.functions import vector_to_array

    asm, model = forest or fit_forest(features.sparkSession)
    f = rule_layout(features.fillna(0.0, FEATURES))
    p = model.transform(asm.transform(f))
    names = F.array(*[F.lit(k) for k in PROTOTYPES])
    p = p.withColumn("p", F.array_max(vector_to_array("probability"))).withColumn("forest", F.element_at(names, F.col("prediction").cast("int") + 1))
    rule = F.coalesce((F.col("rule_confidence") >= 0.80) | (F.col("n_words") < 5), F.lit(False))
    weak = F.coalesce(F.col("rule_confidence") > 0.55, F.lit(False))
    layout = F.when(rule, F.col("rule_layout")).otherwise(F.col("forest"))
    conf = F.when(rule, F.col("rule_confidence")).when(weak & (F.col("rule_layout") == F.col("forest")), F.least((F.col("p") + F.col("rule_confidence")) / 2 + 0.05, F.lit(0.97))).when(weak, F.col("p") * 0.90).otherwise(F.col("p"))
    out = p.select(key, layout.alias("layout"), F.round(conf, 4).alias("confidence"))
    return out.withColumn("strategy", strategy(F.col("layout")))


def strategy(layout: Column) -> Column:
    """How a page of a layout is read."""
    known = F.create_map(*[F.lit(x) for kv in STRATEGIES.items() for x in kv])
    return F.coalesce(known[layout], F.lit("sequential"))
