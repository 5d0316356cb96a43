"""Verdicts on fitted transforms from the models' importances and metrics, and the recommendations that follow."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def shares(importances: DataFrame) -> DataFrame:
    """column, share: the importance in percent of all."""
    total = F.sum("importance").over(Window.partitionBy(F.lit(0)))
    return importances.select("column", F.when(total > 0, 100 * F.col("importance") / total).otherwise(F.lit(0.0)).alias("share"))


def transform_verdicts(made: DataFrame, enhanced: DataFrame, baseline: DataFrame, n_columns: int) -> DataFrame:
    """transform, share, change, verdict. made (transform, column): the columns that a transform made or replaced; the others are (column, importance)."""
    good = max(0.5, 50 / max(1, n_columns))
    e, b = shares(enhanced), shares(baseline).withColumnRenamed("share", "before")
    sums = made.join(e, "column", "left").join(b, "column", "left").groupBy("transform").agg(F.sum(F.coalesce("share", F.lit(0.0))).alias("share"), F.sum("before").alias("before"))
    verdict = F.when(F.col("share") >= good, "good").when(F.col("share") >= good / 4, "marginal").otherwise("bad")
    return sums.select("transform", "share", (F.col("share") - F.col("before")).alias("change"), verdict.alias("verdict"))


def bad_parts(made: DataFrame, enhanced: DataFrame, verdicts: DataFrame, n_columns: int) -> DataFrame:
    """transform, column, share of the date_features and row_numeric_stats that are good as a whole, where a part alone would not be good.

    made may name the transform's method in a column `method`; else it is the transform's name, up to a colon. A column that
    the enhanced model doesn't know has a share of 0.
    """
    method = F.col("method") if "method" in made.columns else F.substring_index("transform", ":", 1)
    good = verdicts.where("verdict = 'good'").select("transform")
    own = made.where(method.isin("date_features", "row_numeric_stats")).join(good, "transform", "left_semi").join(shares(enhanced), "column", "left")
    share = F.coalesce("share", F.lit(0.0))
    return own.where(share < max(0.5, 50 / max(1, n_columns))).select("transform", "column", share.alias("share"))


def imbalance_verdict(metrics: DataFrame) -> DataFrame:
    """metrics with verdict and reason: what class weights did to f1, precision and recall (baseline_ and enhanced_ of each; null counts as 0).

    A baseline with all three at 0.90 or more is strong; there, weights without a gain of F1 are of little use.
    """
    of = lambda side, m: F.coalesce(F.col(f"{side}_{m}"), F.lit(0.0))
    f, p, r = (of("enhanced", m) - of("baseline", m) for m in ("f1", "precision", "recall"))
    strong = F.least(*(of("baseline", m) for m in ("f1", "precision", "recall"))) >= 0.90
    no_gain = of("enhanced", "f1") <= of("baseline", "f1") + 0.005
    kept = of("enhanced", "f1") >= of("baseline", "f1") - 0.005
    rules = [
        (strong & no_gain, "marginal", "strong before, no gain"), (of("enhanced", "f1") < of("baseline", "f1") - 0.02, "bad", "F1 fell"),
        ((r > 0.15) & (p < -0.15), "marginal", "recall for precision"), (kept, "good", "F1 kept or raised"), (F.lit(True), "marginal", "mixed"),
    ]
    first = F.coalesce(*(F.when(when, F.struct(F.lit(v).alias("verdict"), F.lit(why).alias("reason"))) for when, v, why in rules))
    return metrics.withColumn("__v", first).select(*metrics.columns, "__v.verdict", "__v.reason")


def low_importance(baseline: DataFrame, originals: DataFrame, limit: float = 0.5) -> DataFrame:
    """column, share of original columns that hold less than `limit` percent of the baseline model's importance."""
    return shares(baseline).join(originals.select("column"), "column", "left_semi").where(F.col("share") < limit)


def split_by_origin(enhanced: DataFrame, originals: DataFrame) -> DataFrame:
    """is_new, share, n: importance of original and of engineered columns."""
    old = originals.select("column", F.lit(True).alias("old"))
    return shares(enhanced).join(old, "column", "left").groupBy(F.col("old").isNull().alias("is_new")).agg(F.sum("share").alias("share"), F.count("*").alias("n"))


def bottom_features(enhanced: DataFrame) -> DataFrame:
    """column, share at or below the 2nd percentile and under 0.05 percent."""
    own = shares(enhanced)
    edge = own.agg(F.percentile("share", 0.02).alias("edge"))
    return own.join(F.broadcast(edge)).where((F.col("share") <= F.col("edge")) & (F.col("share") < 0.05)).select("column", "share")


def recommendations(verdicts: DataFrame, low: DataFrame, metrics: DataFrame, offered: bool = False, applied: bool = False) -> DataFrame:
    """rule, detail. verdicts (transform, verdict, and type where known), low (column), metrics (metric, baseline, enhanced) of the test set.

    Transforms that are bad or marginal, but for class weights, are to go. Of class weights: their effect on F1 if they were
    applied; if they were only offered, which of the baseline's F1, precision and recall are below 0.80. Tuning is worth
    while where the transforms closed 5 percent or more of the baseline's gap to an AUC of 1.
    """
    weights = F.col("type") == "imbalance" if "type" in verdicts.columns else F.lit(False)
    weak_ones = verdicts.where(F.col("verdict").isin("bad", "marginal") & ~F.coalesce(weights, F.lit(False)))
    out = weak_ones.agg(F.count("*").alias("n")).select(F.when(F.col("n") > 0, "run again without").otherwise("all contributed").alias("rule"), F.format_string("%d transforms", F.col("n")).alias("detail"))
    out = out.unionByName(low.agg(F.count("*").alias("n")).where("n > 0").select(F.lit("drop columns").alias("rule"), F.format_string("%d columns", F.col("n")).alias("detail")))
    if applied:
        f = F.col("enhanced") - F.col("baseline")
        out = out.unionByName(metrics.where("metric = 'f1' AND baseline IS NOT NULL AND enhanced IS NOT NULL").select(F.lit("class weights").alias("rule"), F.when(f > 0.02, "effective").when(f > 0, "marginal").otherwise("ineffective").alias("detail")))
    elif offered:
        own = metrics.where(F.col("metric").isin("f1", "precision", "recall") & F.col("baseline").isNotNull())
        below = F.array_sort(F.collect_list(F.when(F.col("baseline") < 0.80, F.col("metric"))))
        out = out.unionByName(own.agg(below.alias("m"), F.count("*").alias("n")).where("n > 0").select(F.when(F.size("m") > 0, "enable class weights").otherwise("class weights not needed").alias("rule"), F.concat_ws(", ", "m").alias("detail")))
    share = 100 * (F.col("enhanced") - F.col("baseline")) / F.greatest(1 - F.col("baseline"), F.lit(0.001))
    return out.unionByName(metrics.where("metric = 'roc_auc'").where(share >= 5).select(F.lit("tuning").alias("rule"), F.when(share >= 20, "likely worth while").otherwise("moderate headroom").alias("detail")))


def executive_flags(facts: DataFrame, advisories: DataFrame) -> DataFrame:
    """flag, detail: few rows, a suspicious AUC (facts: n_rows, auc), and the number of advisories of each severity, high first."""
    few = facts.where("n_rows < 200").select(F.lit(0).alias("o"), F.lit("few rows").alias("flag"), F.col("n_rows").cast("string").alias("detail"))
    leak = facts.where("auc >= 0.999").select(F.lit(1).alias("o"), F.lit("suspicious auc").alias("flag"), F.col("auc").cast("string").alias("detail"))
    order = F.when(F.col("severity") == "high", 2).when(F.col("severity") == "medium", 3).otherwise(4)
    counts = advisories.groupBy("severity").agg(F.count("*").alias("n")).select(order.alias("o"), F.concat("severity", F.lit(" advisories")).alias("flag"), F.col("n").cast("string").alias("detail"))
    return few.unionByName(leak).unionByName(counts).orderBy("o").drop("o")
