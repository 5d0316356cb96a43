"""Experiments: what a transform changes, over folds, with significance; catalog, merging and the models that rank candidates."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NOISE_LEAST, NOISE_DEFAULT, SKIP_FROM, NEAR_FROM = 0.001, 0.005, 0.99, 0.95


def _student():
    """student_p and p_value, made within a function, so that they travel to tasks whole: workers need not find this package."""

    def student_p(t: float, df: float) -> float:
        """Two-sided p-value of Student's t, by the incomplete beta function's continued fraction."""
        if not df > 0 or math.isnan(t):
            return math.nan
        if math.isinf(t):
            return 0.0
        x, a, b = df / (df + t * t), df / 2, 0.5
        if x >= 1:
            return 1.0

        def fraction(x, a, b):
            tiny, c = 1e-300, 1.0
            d = 1 / max(1 - (a + b) * x / (a + 1), tiny)
            h = d
            for m in range(1, 400):
                for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                    d = 1 / (1 + top * d or tiny)
                    c = 1 + top / c or tiny
                    h *= d * c
                if abs(d * c - 1) < 1e-15:
                    break
            return h

        front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
        return front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b

    def p_value(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([student_p(a, b) if a is not None and b is not None else None for a, b in zip(t, df, strict=True)], dtype="float64")

    return student_p, F.pandas_udf(p_value, T.DoubleType())  # one value for each test, so few rows


student_p, p_value = _student()


def fold_effects(folds: DataFrame, keys: list[str], n_tests: int = 1) -> DataFrame:
    """Of rows (keys, baseline, changed: the AUC of a fold before and after): means, delta, percent of headroom, noise floor,
    calibrated delta, Cohen's d, and paired t with its Bonferroni-corrected p-value (3 folds or more) and significance at 0.05."""
    d = F.col("changed") - F.col("baseline")
    g = folds.where("baseline IS NOT NULL AND changed IS NOT NULL").groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("baseline").alias("baseline"), F.avg("changed").alias("changed"), F.avg(d).alias("delta"), F.stddev_samp(d).alias("sd"), F.stddev_samp("baseline").alias("noise")
    )
    floor = F.coalesce(F.greatest(F.col("noise"), F.lit(NOISE_LEAST)), F.lit(NOISE_DEFAULT))
    t = F.when((F.col("n") >= 3) & (F.col("sd") > 0), F.col("delta") / (F.col("sd") / F.sqrt("n")))
    p = F.least(F.lit(1.0), p_value("t_stat", (F.col("n") - 1).cast("double")) * n_tests)
    out = g.select(*keys, "n", "baseline", "changed", "delta", normalized_delta(F.col("delta"), F.col("baseline")).alias("delta_normalized"), floor.alias("noise_floor"), (F.col("delta") / floor).alias("calibrated_delta"), cohens_d(F.col("delta"), F.col("sd"), F.col("n")).alias("cohens_d"), t.alias("t_stat"))
    return out.withColumn("p_value", F.when(F.col("t_stat").isNotNull(), p)).withColumn("is_significant", F.coalesce(F.col("p_value") < 0.05, F.lit(False)))


def normalized_delta(delta: Column, baseline: Column) -> Column:
    return delta / F.greatest(1 - baseline, F.lit(0.001)) * 100


def cohens_d(mean: Column, sd: Column, n: Column) -> Column:
    return F.when(n >= 2, F.when(sd < 1e-10, F.lit(0.0)).otherwise(mean / sd))


def ceiling(auc: Column) -> Column:
    return F.when(auc >= SKIP_FROM, "skip").when(auc >= NEAR_FROM, "near").otherwise("ok")


def bonferroni(results: DataFrame, by: str = "dataset_name", p: str = "p_value") -> DataFrame:
    """results with p_bonferroni: p times the number of tests of its dataset, 1 at most."""
    return results.withColumn("p_bonferroni", F.least(F.lit(1.0), F.col(p) * F.count(p).over(Window.partitionBy(by))))


def pending(tasks: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks without a row in the results."""
    return tasks.join(done.select(*keys).distinct(), keys, "left_anti")


def curated(catalog: DataFrame, max_tasks: int = 20_000, rows: tuple[int, int] = (500, 5_000_000), columns: tuple[int, int] = (4, 6_000), max_cells: int = 100_000_000) -> DataFrame:
    """One task of each active dataset within the limits (dataset_id, task_id, task_type, n_rows, n_cols, folds, runs): 10 folds first, then most runs.

    Of more than max_tasks datasets those with the smallest hash stay. Ordered by dataset.
    """
    fit = catalog.where("status = 'active'").where(F.col("n_rows").between(*rows) & F.col("n_cols").between(*columns) & (F.col("n_rows") * F.col("n_cols") <= 2 * max_cells))
    order = Window.partitionBy("dataset_id").orderBy(F.desc((F.col("folds") == 10).cast("int")), F.desc("runs"), "task_id")
    one = fit.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")
    return one.orderBy(F.md5(F.col("dataset_id").cast("string")), "dataset_id").limit(max_tasks).orderBy("dataset_id")


def task_counts(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy(F.lower("task_type").alias("task_type")).agg(F.count("*").alias("n"))


def target_stats(results: DataFrame, target: str) -> DataFrame:
    x = F.col(target)
    q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return results.agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), q[0].alias("q25"), q[1].alias("median"), q[2].alias("q75"), F.avg((x > 0).cast("double")).alias("positive_share"))


def ranked_ablation(cells: DataFrame) -> DataFrame:
    """cells (ctype, formula, r2) with their rank by R2 in the family and overall, and whether they are their family's best."""
    order = [F.desc("r2"), "formula"]
    own, every = F.row_number().over(Window.partitionBy("ctype").orderBy(*order)), F.row_number().over(Window.orderBy(*order, "ctype"))  # a grid of tens of cells
    return cells.select("*", own.alias("rank_in_family"), every.alias("rank"), (own == 1).alias("best"))


def ablation_grid(spark, families: list[str], formulas: dict[str, str]) -> DataFrame:
    """ctype, formula, expression: every family with every target formula (SQL text)."""
    return spark.createDataFrame([(f, n, e) for f in families for n, e in formulas.items()], "ctype string, formula string, expression string")


def usable_target(results: DataFrame, expression: str, group: str) -> DataFrame:
    """usable: the formula's values vary (deviation from 1e-6) and come from two datasets or more."""
    return results.select(F.expr(expression).alias("t"), group).where("t IS NOT NULL").agg((F.coalesce(F.stddev_pop("t") >= 1e-6, F.lit(False)) & (F.count_distinct(group) >= 2)).alias("usable"))


def cross_validated(df: DataFrame, folds: int, repeats: int, evaluate: Callable[[DataFrame, DataFrame], float | None]) -> DataFrame:
    """repeat, fold, score: evaluate(train, validation) of every fold column fold_0 .. of df; a fold of one class gives null.

    df is cached while its folds are in use, unless the caller holds it for several calls; the loop on the driver only starts jobs.
    """
    held = df.storageLevel.useMemory or df.storageLevel.useDisk
    df = df if held else df.cache()
    try:
        rows = [(r, k, evaluate(df.where(F.col(f"fold_{r}") != k), df.where(F.col(f"fold_{r}") == k))) for r in range(repeats) for k in range(folds)]
    finally:
        if not held:
            df.unpersist()
    return df.sparkSession.createDataFrame(rows, "repeat int, fold int, score double")
