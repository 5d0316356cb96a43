"""Experiments: every candidate transform measured by the change of the cross-validated AUC it brings."""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import category, category_columns, numeric_columns
from ..operators import candidates, experiments, families as family_models, meta, metrics, models, prepare
from ..operators.transforms import Step, apply, fit
from .recommend import candidates_of_pairs

RESULT = "dataset_name string, family string, column string, column_b string, method string, repeat int, fold int, baseline double, changed double"


#: How many rows a row stands for.
N = "__n"


def takes_counts(params: dict | None) -> bool:
    """Whether the trees of these parameters may see rows that are alike as one row with a weight."""
    return family_models.takes_counts(GBTClassifier(**(models.LIBRARY | (params or {}))))


def fold_auc(train: DataFrame, test: DataFrame, label: str, key: str, params: dict | None, mixed: bool = False, codes: dict[str, DataFrame] | None = None) -> float | None:
    """AUC on test of a model of train; null if a side has one class only (mixed: it is known that none has). Rows that are alike are counted, and seen once from there on (N, where a side has it already). codes: as fit_encoders()."""
    counted = takes_counts(params)
    sides = [x if N in x.columns else prepare.gathered(prepare.counted_rows(x.drop(key), N, counted)) for x in (train, test)]
    held = [x for x, given in zip(sides, (train, test), strict=True) if x is not given]
    try:
        if not mixed and any(x.select(label).distinct().count() < 2 for x in sides):
            return None
        enc = models.fit_encoders(sides[0], label, sides[1], n=N, codes=codes)
        held.append(rows := models.matrix(sides[0], enc, [label, N]).cache())  # a fit goes over its rows several times
        model = models.train_classifier(rows, 2, label, params, N if counted else None)
        return metrics.area(models.scored(model, models.matrix(sides[1], enc, [label, N]), 2), label, n=N)
    finally:
        for x in held:
            x.unpersist()


def evaluate_model(df: DataFrame, label: str, key: str, folds: int = 5, repeats: int = 3, params: dict | None = None) -> DataFrame:
    """repeat, fold, score of the plain columns."""
    drop = [f"fold_{r}" for r in range(repeats)]
    return experiments.cross_validated(prepare.repeated_folds(df, key, folds, repeats), folds, repeats, lambda a, b: fold_auc(a.drop(*drop), b.drop(*drop), label, key, params))


def evaluate_with_intervention(df: DataFrame, label: str, key: str, steps: list[Step], folds: int = 5, repeats: int = 3, params: dict | None = None, custom=None) -> DataFrame:
    """repeat, fold, score with the steps fitted on each fold's training rows, or with custom(df), any function of a table."""
    drop = [f"fold_{r}" for r in range(repeats)]

    def one(train: DataFrame, test: DataFrame) -> float | None:
        train, test = train.drop(*drop), test.drop(*drop)
        if custom:
            return fold_auc(custom(train), custom(test), label, key, params)
        fitted = fit(train, steps, label, key)
        return fold_auc(apply(train, fitted, (label, key)), apply(test, fitted), label, key, params)

    return experiments.cross_validated(prepare.repeated_folds(df, key, folds, repeats), folds, repeats, one)


def cells(df: DataFrame, label: str, key: str, families: tuple[str, ...] = models.FAMILIES) -> list[tuple[str, Step]]:
    """(family, step) of every candidate that passes its gate; the tables behind them have a row for each column or pair."""
    own = df.drop(key)
    numeric = [c for c in numeric_columns(own, include_bool=False) if c != label]
    cats = [c for c in category_columns(own) if c != label]
    found: list[tuple[str, Step]] = []
    if "numerical" in families and numeric:
        rows = candidates.numerical_candidates(meta.numeric_gates(own, numeric))
        found += [("numerical", Step(r.method, r.column)) for r in rows.select("column", "method").collect()]
    told = meta.kept(meta.categorical_column_meta(own, cats, label)) if cats and {"categorical", "interaction"} & {*families} else None  # a row for each column
    if "categorical" in families and cats:
        rows = candidates.categorical_candidates(told)
        found += [("categorical", Step(r.method, r.column)) for r in rows.select("column", "method").collect()]
    if "interaction" in families and len(numeric) + len(cats) > 1:
        imp = meta.spearman_with_target(own, numeric, label).select("column", F.lit(True).alias("numeric"), F.col("spearman").alias("importance")) if numeric else None
        if cats:
            more = told.select("column", F.lit(False).alias("numeric"), F.col("mutual_info_score").alias("importance"))
            imp = more if imp is None else imp.unionByName(more)
        if (pairs := candidates_of_pairs(own, numeric, cats, imp)) is not None:
            found += [("interaction", Step(r.method, r.column, r.column_b)) for r in pairs.select("column", "column_b", "method").collect()]
    if "row" in families and numeric:
        found += [("row", Step(r.method)) for r in candidates.row_family_candidates(meta.row_gates(own, label)).select("method").collect()]
    return sorted(found, key=lambda x: (x[0], x[1].column, x[1].column_b, x[1].method))


def collect(df: DataFrame, label: str, key: str, dataset: str, families: tuple[str, ...] = models.FAMILIES, folds: int = 5, repeats: int = 3, params: dict | None = None, done: DataFrame | None = None, seconds: float = 7200, at_once: int = 8) -> DataFrame:
    """Fold rows (RESULT) of every candidate of a dataset. Cells with rows in `done` are skipped, and none is begun after `seconds`.

    `at_once` folds of cells run side by side, as a fold's jobs alone don't fill a cluster. A dataset whose baseline is at the ceiling gives no rows. The driver starts jobs; tables stay in the executors.
    Rows that are alike but for their key are counted once by fold, for all cells; a fold's transforms are fitted together. Only target encoding, out of fold by the key, goes through the single rows of each fold again.
    """
    held = prepare.repeated_folds(df, key, folds, repeats).cache()  # one copy for all cells, side by side
    alike = prepare.gathered(prepare.counted_rows(held.drop(key), N, takes_counts(params)))
    try:
        return _collected(df, held, alike, label, key, dataset, families, folds, repeats, params, done, seconds, at_once)
    finally:
        alike.unpersist()
        held.unpersist()


def _collected(df: DataFrame, held: DataFrame, alike: DataFrame, label: str, key: str, dataset: str, families: tuple[str, ...], folds: int, repeats: int, params: dict | None, done: DataFrame | None, seconds: float, at_once: int) -> DataFrame:
    spark, began = df.sparkSession, time.time()
    drop, places = [f"fold_{r}" for r in range(repeats)], [(r, k) for r in range(repeats) for k in range(folds)]

    def sides(rows: DataFrame, place: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
        r, k = place
        return rows.where(F.col(f"fold_{r}") != k).drop(*drop), rows.where(F.col(f"fold_{r}") == k).drop(*drop)

    name = lambda s: (s.column, s.column_b, s.method)
    with ThreadPoolExecutor(at_once) as pool:
        every = lambda work, tasks: list(pool.map(inheritable_thread_target(spark)(work), tasks))
        # the values of a category column are those of the table in every fold and cell that has it
        dealt = alike.where(F.col("fold_0").isNotNull())
        codes = {c: models.column_codes(dealt.select(category(c).alias("v"))) for c in category_columns(alike) if c != label}
        asked = pool.submit(inheritable_thread_target(spark)(cells), df, label, key, families)  # beside the baseline
        base = dict(zip(places, every(lambda p: fold_auc(*sides(alike, p), label, key, params, codes=codes), places), strict=True))
        known = [x for x in base.values() if x is not None]
        if not known or sum(known) / len(known) >= experiments.SKIP_FROM:
            return spark.createDataFrame([], RESULT)
        had = {(r.column, r.column_b, r.method) for r in done.select("column", "column_b", "method").distinct().collect()} if done is not None else set()
        todo = [c for c in asked.result() if name(c[1]) not in had]
        fitted = dict(zip(places, every(lambda p: {name(s): s for s in fit(sides(held, p)[0], [s for _, s in todo], label, key)}, places), strict=True)) if todo else {}

        begun: set[tuple] = set()

        def one(task: tuple[tuple[str, Step], tuple[int, int]]) -> tuple | None:
            (family, s), place = task
            if name(s) not in begun and time.time() - began > seconds:
                return None
            begun.add(name(s))  # all folds of a cell or none
            own, by_key, score = [fitted[place][name(s)]], s.method == "target_encoding", None
            if base[place] is not None:  # else a side has one class only
                train, test = sides(held if by_key else alike, place)
                score = fold_auc(apply(train, own, (label, key) if by_key else None), apply(test, own), label, key, params, mixed=True, codes=codes)
            return dataset, family, s.column, s.column_b, s.method, *place, base[place], score

        rows = [row for row in every(one, [(cell, place) for cell in todo for place in places]) if row]
    return spark.createDataFrame(rows, RESULT)


def results(fold_rows: DataFrame) -> DataFrame:
    """A row for each cell: effects, significance with the number of the dataset's tests, and the ceiling state of its baseline."""
    out = experiments.fold_effects(fold_rows, ["dataset_name", "family", "column", "column_b", "method"])
    return experiments.bonferroni(out).withColumn("ceiling", experiments.ceiling(F.col("baseline")))
