"""Model matrix, boosted trees and forests, importances, search, and scoring."""

from __future__ import annotations

import json
import math
import random
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import joint
from ..functions.columns import category, category_columns, hinted, md5fold, number, numeric_columns, quoted
from ..functions.quantiles import counted_quantiles, quantiles
from . import metrics, prepare

# Presets: library and collector.
LIBRARY = {"maxIter": 60, "stepSize": 0.1, "maxDepth": 5}
COLLECTOR = {"maxIter": 20, "stepSize": 0.1, "maxDepth": 5}
#: Rounds without gain after which boosting stops.
PATIENCE = 20
#: Ranges of the search: of whole numbers, or of numbers on a logarithmic scale.
RANGES = {
    "maxIter": (20, 120), "maxDepth": (3, 9), "minInstancesPerNode": (1, 50), "maxBins": (32, 256), "stepSize": (0.01, 0.3), "subsamplingRate": (0.5, 1.0), "minInfoGain": (1e-6, 1e-2), "minWeightFractionPerNode": (1e-5, 1e-2), "featureShare": (0.3, 1.0),
}
#: Values of a category column whose codes the driver hands out; the codes of more are worked out by ranges.
FEW_CODES = 1_000
FAMILIES = ("numerical", "categorical", "interaction", "row")


@dataclass
class Encoders:
    """Codes of the category columns (a table column -> value, code) and medians of the numeric ones, all from training data."""

    columns: list[str]
    categories: list[str]
    medians: dict[str, float] = field(default_factory=dict)
    codes: dict[str, DataFrame] = field(default_factory=dict)


def column_codes(values: DataFrame) -> DataFrame:
    """v, code: the distinct values of values (v) in alphabetical order from 0."""
    values = values.distinct()
    first = [r.v for r in values.orderBy("v").limit(FEW_CODES + 1).collect()]
    few = len(first) <= FEW_CODES
    return F.broadcast(values.sparkSession.createDataFrame([(v, float(i)) for i, v in enumerate(first)], "v string, code double")) if few else hinted(joint.places(values, "v", "code"))


def fit_encoders(train: DataFrame, label: str, extra: DataFrame | None = None, skip: tuple[str, ...] = (), n: str | None = None, codes: dict[str, DataFrame] | None = None) -> Encoders:
    """Codes over the union of train and extra, in alphabetical order from 0; medians from train.

    n: the column that says how many rows each row stands for. Train and extra are then all that will be encoded, so only
    columns with nulls in these get a median. codes: column_codes() of category columns for which they are known.
    """
    skip = (*skip, n) if n else skip
    numeric = [c for c in numeric_columns(train) if c != label and c not in skip]
    cats = [c for c in category_columns(train) if c != label and c not in skip]
    enc = Encoders([c for c in train.columns if c in numeric or c in cats], cats)
    if numeric and n:
        sides = [x.select(*(number(c).isNull().alias(c) if c in x.columns else F.lit(False).alias(c) for c in numeric)) for x in (train, extra) if x is not None]
        gaps = {c for c, gone in zip(numeric, reduce(DataFrame.unionAll, sides).agg(*(F.bool_or(quoted(c)) for c in numeric)).first(), strict=True) if gone}
        found = {}
        if gaps:
            values = train.select(quoted(n).alias("__n"), F.inline(F.array(*(F.struct(F.lit(c).alias("column"), number(c).alias("v")) for c in sorted(gaps)))))
            found = counted_quantiles(values.groupBy("column", "v").agg(F.sum("__n").cast("long").alias("n")), {c: (0.5,) for c in sorted(gaps)})
        enc.medians = {c: float(found[c][0]) if found.get(c) else 0.0 for c in numeric}
    elif numeric:
        enc.medians = {c: float(m[0]) if m else 0.0 for c, m in quantiles(train, {c: (0.5,) for c in numeric}).items()}
    for c in cats:
        values = train.select(category(c).alias("v"))
        values = values.unionByName(extra.select(category(c).alias("v"))) if extra is not None and c in extra.columns else values
        enc.codes[c] = codes[c] if codes and c in codes else column_codes(values)
    return enc


def matrix(df: DataFrame, enc: Encoders, keep: list[str], unseen: float = 0.0) -> DataFrame:
    """keep, features: the encoders' columns as a vector. An absent column counts as 0, an unseen category as the first class."""
    values = []
    for i, c in enumerate(enc.columns):
        if c not in df.columns:
            values.append(F.lit(0.0))
        elif c in enc.categories:
            codes = enc.codes[c].select(F.col("v").alias(f"__v{i}"), F.col("code").alias(f"__c{i}"))
            df = df.join(codes, category(c) == F.col(f"__v{i}"), "left")
            values.append(F.coalesce(F.col(f"__c{i}"), F.lit(unseen)))
        else:
            values.append(F.coalesce(number(c), F.lit(enc.medians[c])))
    own = df.select(*(quoted(k) for k in keep), *(v.alias(f"__x{i}") for i, v in enumerate(values)))
    return VectorAssembler(inputCols=[f"__x{i}" for i in range(len(values))], outputCol="features").transform(own).select(*keep, "features")


def kept_rounds(losses: list[float], patience: int = PATIENCE) -> int:
    """How many rounds to keep: up to the least loss before `patience` rounds in a row have brought no gain; 1 at least."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def train_classifier(rows: DataFrame, n_classes: int, label: str = "label", params: dict | None = None, weight: str | None = None, validation: str | None = None, seed: int = 42):
    """Boosted trees for two classes, a forest for more (it has probabilities of its own).

    validation: a boolean column of rows that are only looked at. The loss on these is found after every round; the model is
    then that of the rounds up to the best one, after PATIENCE rounds without gain (trees are grown one after the other from
    one seed, so the shorter model is the beginning of the longer one). Without rows on both sides nothing is cut.
    """
    p = LIBRARY | (params or {})
    if n_classes != 2:
        model = RandomForestClassifier(featuresCol="features", labelCol=label, seed=seed, maxBins=256, numTrees=p["maxIter"], maxDepth=p["maxDepth"])
        return (model.setWeightCol(weight) if weight else model).fit(rows)
    model = GBTClassifier(featuresCol="features", labelCol=label, seed=seed, **({"maxBins": 256} | p))
    model = model.setWeightCol(weight) if weight else model
    if not validation:
        return model.fit(rows)
    own, held = rows.where(~F.coalesce(F.col(validation), F.lit(False))).cache(), rows.where(F.col(validation)).cache()
    try:
        if own.isEmpty() or held.isEmpty():
            return model.fit(rows)
        fitted = model.fit(own)
        rounds = kept_rounds(fitted.evaluateEachIteration(held))
        return fitted if rounds == fitted.getNumTrees else model.copy({model.maxIter: rounds}).fit(own)
    finally:
        own.unpersist()
        held.unpersist()


def scored(model, rows: DataFrame, n_classes: int) -> DataFrame:
    """rows with score (probability of class 1) and prediction, or prob_0, prob_1 .. and prediction for more classes."""
    p = vector_to_array("probability")
    out = model.transform(rows)
    made = {"score": p[1]} if n_classes == 2 else {f"prob_{k}": p[k] for k in range(n_classes)}
    return out.withColumns(made).drop("rawPrediction", "probability")


def importances(model, columns: list[str]) -> DataFrame:
    """column, importance in percent of all."""
    values = model.featureImportances.toArray()
    total = values.sum() or 1.0
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession().createDataFrame([(c, float(100 * v / total)) for c, v in zip(columns, values, strict=True)], "column string, importance double")


def baseline_importances(df: DataFrame, label: str, n_classes: int = 2, params: dict | None = None) -> DataFrame:
    enc = fit_encoders(df, label)
    return importances(train_classifier(matrix(df, enc, [label]), n_classes, label, params), enc.columns)


def quick_auc(df: DataFrame, label: str, key: str, params: dict | None = None) -> tuple[float, float]:
    """AUC of a model on one fifth of the rows, and its assumed deviation; 0.5 if a side has one class only."""
    split = prepare.stratified_split(df, label, key)
    train, test = split.where("NOT is_test").drop("is_test"), split.where("is_test").drop("is_test")
    enc = fit_encoders(train, label, test, skip=(key,))
    s = 0.5
    if train.select(label).distinct().count() == 2:
        model = train_classifier(matrix(train, enc, [label]), 2, label, params)
        s = metrics.ranking_metrics(scored(model, matrix(test, enc, [label]), 2), label).first().roc_auc or 0.5
    return s, abs(min(s - 0.5, 1 - s)) * 0.1 + 0.01


def tree_accuracy(df: DataFrame, columns: list[str], label: str, key: str, depth: int, folds: int = 3) -> float:
    """Mean accuracy over folds of one shallow tree on the encoded columns; 0.5 for folds that can't be fitted."""
    own = df.select(quoted(key).alias("__key"), quoted(label).alias("__label"), *(quoted(c) for c in columns)).where("__label IS NOT NULL")
    enc = fit_encoders(own, "__label", skip=("__key",))
    rows = matrix(own, enc, ["__key", "__label"]).withColumn("__fold", md5fold(F.col("__key"), folds)).cache()
    try:
        got = []
        for k in range(folds):
            train, test = rows.where(F.col("__fold") != k), rows.where(F.col("__fold") == k)
            if train.isEmpty() or test.isEmpty():
                got.append(0.5)
                continue
            model = DecisionTreeClassifier(labelCol="__label", maxDepth=depth, maxBins=256, seed=42).fit(train)
            got.append(model.transform(test).agg(F.avg((F.col("prediction") == F.col("__label")).cast("double"))).first()[0])
        return sum(got) / len(got)
    finally:
        rows.unpersist()


def landmarking_score(df: DataFrame, label: str, key: str) -> float:
    return tree_accuracy(df, [c for c in df.columns if c not in (label, key)], label, key, 3)


def pps_score(df: DataFrame, column: str, label: str, key: str) -> float:
    """Accuracy of a tree on the one column, between chance (0) and 1."""
    k = max(2, df.select(label).distinct().count())
    return max(0.0, (tree_accuracy(df, [column], label, key, 4) - 1 / k) / (1 - 1 / k))


def tree_guided_pairs(df: DataFrame, label: str, path: str, n_trees: int = 5, depth: int = 4) -> DataFrame:
    """a, b, n: how often one feature's split stands right over the other's in shallow trees. The saved model's node table is joined with itself; path must be shared storage."""
    enc = fit_encoders(df, label)
    model = RandomForestClassifier(labelCol=label, numTrees=n_trees, maxDepth=depth, maxBins=256, seed=42).fit(matrix(df, enc, [label]))
    model.write().overwrite().save(path)
    nodes = df.sparkSession.read.parquet(f"{path}/data").select("treeID", F.col("nodeData.id").alias("id"), F.col("nodeData.leftChild").alias("l"), F.col("nodeData.rightChild").alias("r"), F.col("nodeData.split.featureIndex").alias("f")).where("l >= 0")
    child = nodes.select(F.col("treeID").alias("t"), F.col("id").alias("c"), F.col("f").alias("g"))
    names = F.array(*map(F.lit, enc.columns))
    both = nodes.join(child, (F.col("treeID") == F.col("t")) & ((F.col("l") == F.col("c")) | (F.col("r") == F.col("c")))).where("f <> g")
    pair = both.select(names[F.least("f", "g")].alias("a"), names[F.greatest("f", "g")].alias("b"))
    return pair.groupBy("a", "b").agg(F.count("*").alias("n"))


def search(rows: DataFrame, key: str, grid: list[dict], label: str = "label") -> tuple[dict, DataFrame]:
    """The best of `grid` by AUC on one fixed fifth, and the table of all (params, auc)."""
    split = rows.withColumn("__test", md5fold(quoted(key), 5) == 4).cache()
    try:
        train, test = split.where("NOT __test"), split.where("__test")
        got = [(json.dumps(p, sort_keys=True), metrics.ranking_metrics(scored(train_classifier(train, 2, label, p), test, 2), label).first().roc_auc or 0.5) for p in grid]
    finally:
        split.unpersist()
    return json.loads(max(got, key=lambda x: (x[1], x[0]))[0]), rows.sparkSession.createDataFrame(got, "params string, auc double")


def trials(n: int, seed: int = 42, ranges: dict[str, tuple] | None = None) -> list[dict]:
    """n sets of parameters from RANGES, the same ones for a seed; whole numbers evenly, others evenly on a logarithmic scale."""
    rng = random.Random(seed)
    one = lambda low, high: rng.randint(low, high) if isinstance(low, int) else math.exp(rng.uniform(math.log(low), math.log(high)))
    made = [{k: one(*r) for k, r in (ranges or RANGES).items()} for _ in range(n)]
    return [{k: v for k, v in t.items() if k != "featureShare"} | ({"featureSubsetStrategy": f"{t['featureShare']:.3f}"} if t.get("featureShare", 1.0) < 1 else {}) for t in made]


def search_ranges(rows: DataFrame, key: str, n: int = 27, label: str = "label", seed: int = 42, ranges: dict[str, tuple] | None = None, keep: int = 3, side_by_side: int = 3) -> tuple[dict, DataFrame]:
    """The best of n trials() by AUC on one fixed fifth of the rows, and the table of all runs (trial, rounds, auc, params).

    Successive halving: all trials run with a ninth of their rounds, the best third of them with a third, the best third of
    those with all. side_by_side trials are fitted at a time. A trial that can't be fitted has an AUC of 0.5; ties go to the earlier trial.
    """
    split = rows.withColumn("__test", md5fold(quoted(key), 5) == 4).cache()
    asked, found = dict(enumerate(trials(n, seed, ranges))), []

    def run(trial: int, share: float) -> tuple[int, int, float]:
        p = asked[trial]
        rounds = max(1, math.ceil(p["maxIter"] * share))
        held = scored(train_classifier(split.where("NOT __test"), 2, label, p | {"maxIter": rounds}), split.where("__test"), 2)
        return trial, rounds, metrics.ranking_metrics(held, label).first().roc_auc or 0.5

    try:
        split.count()  # cached before the trials share it
        left, share = list(asked), 1 / keep**2
        with ThreadPoolExecutor(side_by_side) as pool:
            while True:
                done = list(pool.map(lambda t: run(t, share), left))
                found += done
                left = [t for t, _, _ in sorted(done, key=lambda x: (-x[2], x[0]))]
                if share >= 1:
                    break
                left, share = left[: max(1, math.ceil(len(left) / keep))], min(1.0, share * keep)
    finally:
        split.unpersist()
    table = rows.sparkSession.createDataFrame([(t, r, a, json.dumps(asked[t], sort_keys=True)) for t, r, a in found], "trial int, rounds int, auc double, params string")
    return asked[left[0]], table


def train_family_model(results: DataFrame, features: list[str], target: str, group: str, folds: int = 5, params: dict | None = None) -> tuple[object, DataFrame]:
    """A regressor on all results, and its grouped cross-validation: fold, mae, rmse, r2, median_ae."""
    x = F.array(*(F.coalesce(F.col(f).cast("double"), F.lit(-999.0)) if f in results.columns else F.lit(-999.0) for f in features))
    from pyspark.ml.functions import array_to_vector

    from .families import takes_counts

    gbt = GBTRegressor(seed=42, **({"maxIter": 20, "maxDepth": 4} | (params or {})))
    rows = prepare.group_folds(results.where(F.col(target).isNotNull()), group, folds).select("fold", F.col(target).cast("double").alias("label"), x.alias("features"))
    if takes_counts(gbt):  # rows that are alike go to the trees as one, with their number as weight
        rows, gbt = rows.groupBy(*rows.columns).agg(F.count("*").cast("double").alias("n")), gbt.setWeightCol("n")
    else:
        rows = rows.withColumn("n", F.lit(1.0))
    rows = prepare.gathered(rows.withColumn("features", array_to_vector("features")))
    try:
        got = []
        for k in range(folds):
            train, test = rows.where(F.col("fold") != k), rows.where(F.col("fold") == k)
            if not train.isEmpty() and not test.isEmpty():
                said = gbt.fit(train).transform(test).select("n", "label", (F.col("label") - F.col("prediction")).alias("e")).cache()
                try:
                    mean = lambda v: F.sum(F.col("n") * v) / F.sum("n")
                    e, middle = F.col("e"), said.agg(mean(F.col("label"))).first()[0]
                    m = said.agg(mean(F.abs(e)), F.sqrt(mean(e * e)), mean(e * e), mean((F.col("label") - middle) * (F.col("label") - middle))).first()
                    errors = said.groupBy(F.lit("e").alias("column"), F.abs(e).alias("v")).agg(F.sum("n").cast("long").alias("n"))
                    got.append((k, m[0], m[1], 1 - m[2] / m[3] if m[3] else None, counted_quantiles(errors, {"e": (0.5,)})["e"][0]))
                finally:
                    said.unpersist()
        return gbt.fit(rows), results.sparkSession.createDataFrame(got, "fold int, mae double, rmse double, r2 double, median_ae double")
    finally:
        rows.unpersist()
