"""Family models: what an experiment's change in quality is predicted from, trained on results, kept in a store, and applied to candidates.

A family's vector is its features in a fixed order and a place for each method; what is absent or null is ABSENT. All
candidates of a family are scored by one transform of one table.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables
from . import candidates, pairs, prepare

ABSENT = -999.0
#: The trees where no estimator is given.
TREES = {"maxIter": 20, "maxDepth": 5, "stepSize": 0.1}
# Features of the families, in the order of their vectors.
DATASET = (
    "n_rows", "n_cols", "n_numeric_cols", "n_cat_cols", "cat_ratio", "missing_ratio", "row_col_ratio", "n_classes", "class_imbalance_ratio", "avg_feature_corr", "max_feature_corr", "avg_target_corr", "max_target_corr", "landmarking_score", "baseline_score", "baseline_std", "relative_headroom",
)
OWN = {
    "numerical": (
        "null_pct", "unique_ratio", "outlier_ratio", "skewness", "kurtosis_val", "coeff_variation", "zeros_ratio", "entropy", "is_binary", "range_iqr_ratio", "baseline_feature_importance", "importance_rank_pct", "spearman_corr_target", "mutual_info_score", "shapiro_p_value", "bimodality_coefficient", "pct_negative", "pct_in_0_1_range",
    ),
    "categorical": (
        "null_pct", "n_unique", "unique_ratio", "entropy", "normalized_entropy", "is_binary", "is_low_cardinality", "is_high_cardinality", "top_category_dominance", "top3_category_concentration", "rare_category_pct", "conditional_entropy", "baseline_feature_importance", "importance_rank_pct", "mutual_info_score", "pps_score",
    ),
    "interaction": pairs.FEATURES,
    "row": (
        "n_numeric_cols_used", "avg_numeric_mean", "avg_numeric_std", "avg_missing_pct", "max_missing_pct", "avg_row_variance", "pct_rows_with_any_missing", "pct_cells_zero", "pct_rows_with_any_zero", "numeric_col_corr_mean", "numeric_col_corr_max", "avg_row_entropy", "numeric_range_ratio",
    ),
}
METHODS = {"numerical": candidates.NUMERICAL, "categorical": candidates.CATEGORICAL, "interaction": (*candidates.NUM_NUM, *candidates.NUM_CAT, *candidates.CAT_CAT), "row": candidates.ROW_FAMILIES}
#: Columns of the meta tables that have another name in a vector.
RENAMED = {"normality_p_value": "shapiro_p_value", "importance": "baseline_feature_importance"}


def vector_order(family: str) -> list[str]:
    """The names of a family's vector: features of the table, its own ones, and method_ for each method."""
    return [*DATASET, *OWN[family], *(f"method_{m}" for m in sorted(METHODS[family]))]


def _values(rows: DataFrame, features: list[str]) -> Column:
    other = {v: k for k, v in RENAMED.items()}

    def value(name: str) -> Column:
        if name.startswith("method_"):
            return (F.col("method") == name.removeprefix("method_")).cast("double")
        column = name if name in rows.columns else other.get(name)
        return F.coalesce(F.col(column).cast("double"), F.lit(ABSENT)) if column in rows.columns else F.lit(ABSENT)

    return F.array(*map(value, features))


def vector(rows: DataFrame, features: list[str]) -> DataFrame:
    """rows (method, and features under their names or those of RENAMED) with `features`, a vector in that order."""
    return rows.withColumn("features", array_to_vector(_values(rows, features)))


def takes_counts(estimator) -> bool:
    """Whether rows that are alike may go to the estimator as one row with a weight: it has weights, takes all rows, and counts no rows of its own."""
    plain = lambda name, value: not estimator.hasParam(name) or estimator.getOrDefault(name) == value
    return estimator.hasParam("weightCol") and not estimator.isDefined("weightCol") and plain("minInstancesPerNode", 1) and plain("subsamplingRate", 1.0)


@dataclass
class FamilyModel:
    """A fitted pipeline from `features` to `prediction`, with the order of its vector. Methods without a place there can't be scored."""

    family: str
    features: list[str]
    model: PipelineModel

    @property
    def methods(self) -> list[str]:
        return [f.removeprefix("method_") for f in self.features if f.startswith("method_")]

    def score(self, rows: DataFrame) -> DataFrame:
        """The rows of known methods with predicted_delta_raw: one transform for all."""
        own = vector(rows.where(F.col("method").isin(*self.methods)), self.features)
        return self.model.transform(own).select(*rows.columns, F.col("prediction").alias("predicted_delta_raw"))

    def save(self, folder: str) -> None:
        config = SparkSession.active().createDataFrame([(self.family, self.features)], "family string, features array<string>")
        tables.save_family_model(self.model, config, folder, self.family)


def load(spark: SparkSession, folder: str) -> dict[str, FamilyModel]:
    """The families of a store, by name; those that it doesn't hold are left out."""
    found = tables.load_family_models(spark, folder, tuple(OWN))
    return {f: FamilyModel(f, list(config.features), model) for f, (model, config) in found.items()}


def train(results: DataFrame, family: str, target: str, features: list[str] | None = None, estimator=None) -> FamilyModel:
    """A family's model from results (a row for each experiment: method, features, target). Rows without a target don't count.

    features: the vector's order, vector_order() if it is not given. estimator: any regressor over `features` and `label`, boosted trees if it is not given.
    """
    features = list(features or vector_order(family))
    rows = vector(results.where(F.col(target).isNotNull()), features).select("features", F.col(target).cast("double").alias("label"))
    fitted = (estimator or GBTRegressor(seed=42, **TREES)).fit(rows)
    return FamilyModel(family, features, PipelineModel([fitted]))


def cross_validated(results: DataFrame, family: str, target: str, group: str, features: list[str] | None = None, folds: int = 5, estimator=None, classifier=None, at_once: int = 10) -> DataFrame:
    """A row for each fold of whole groups (datasets): mae, rmse, r2, median_ae of the regressor, and auc, f1, precision, recall, accuracy of whether the target is positive.

    Without a classifier the regressor's sign decides, and its prediction ranks. Every fold's measures are one aggregate. Rows
    that are alike go to the estimators as one row with their number as weight, where takes_counts(). `at_once` models are
    fitted side by side, as the jobs of one tree's levels don't fill a cluster.
    """
    features = list(features or vector_order(family))
    own = prepare.group_folds(results.where(F.col(target).isNotNull()), group, folds)
    regressor = estimator or GBTRegressor(seed=42, **TREES)
    rows = own.select("fold", _values(own, features).alias("features"), F.col(target).cast("double").alias("label"), (F.col(target) > 0).cast("double").alias("positive"))
    if counts := all(takes_counts(x) for x in (regressor, classifier) if x is not None):
        rows = rows.groupBy(*rows.columns).agg(F.count("*").cast("double").alias("n"))
        regressor, classifier = regressor.copy().setWeightCol("n"), classifier and classifier.copy().setWeightCol("n")
    rows = prepare.gathered(rows.withColumn("features", array_to_vector("features")))
    try:
        sides = {(r.fold, r.positive) for r in rows.select("fold", "positive").distinct().collect()}
        classes = {k: {p for f, p in sides if f != k} for k in range(folds) if any(f == k for f, _ in sides)}  # of the rows that a fold is fitted on
        asked = [(k, name, x) for k, of in classes.items() if of for name, x in (("said", regressor), ("rank", classifier and classifier.copy().setLabelCol("positive"))) if x is not None and (name == "said" or len(of) == 2)]
        with ThreadPoolExecutor(at_once) as pool:
            fit = inheritable_thread_target(results.sparkSession)(lambda x: x[2].fit(rows.where(F.col("fold") != x[0])))
            fitted = {(k, name): model for (k, name, _), model in zip(asked, pool.map(fit, asked), strict=True)}
        parts = []
        for k in (k for k, of in classes.items() if of):
            said = fitted[k, "said"].transform(rows.where(F.col("fold") == k)).withColumnRenamed("prediction", "said").drop("rawPrediction", "probability")
            if (k, "rank") in fitted:
                from pyspark.ml.functions import vector_to_array

                said = fitted[k, "rank"].transform(said).withColumn("rank", vector_to_array("probability")[1]).withColumn("yes", F.col("prediction") > 0.5)
            else:
                said = said.withColumn("rank", F.col("said")).withColumn("yes", F.col("said") > 0)
            parts.append(said.select(F.lit(k).alias("fold"), "label", "positive", "said", "rank", "yes", *(["n"] if counts else [])))
        if not parts:
            return results.sparkSession.createDataFrame([], "fold int, mae double, rmse double, r2 double, median_ae double, auc double, f1 double, precision double, recall double, accuracy double")
        every = prepare.gathered(reduce(DataFrame.unionByName, parts))
        try:
            found = measures(every)
            return results.sparkSession.createDataFrame(found.collect(), found.schema)  # a row for each fold
        finally:
            every.unpersist()
    finally:
        rows.unpersist()


def measures(scored: DataFrame) -> DataFrame:
    """fold and the measures of scored rows (fold, label, positive, said, rank, yes, and n where a row stands for several); null where a class or the spread is missing."""
    from ..functions import joint

    rows = scored if "n" in scored.columns else scored.withColumn("n", F.lit(1.0))
    n, e, y, yes = F.col("n"), F.col("label") - F.col("said"), F.col("positive") > 0, F.col("yes")
    mean = lambda x: F.sum(n * x) / F.sum(n)
    of = lambda when: F.coalesce(F.sum(F.when(when, n)), F.lit(0.0)).cast("double")
    middle = rows.groupBy("fold").agg(mean(F.col("label")).alias("ml"))
    d = F.col("label") - F.col("ml")
    sums = rows.join(F.broadcast(middle), "fold").groupBy("fold").agg(
        mean(F.abs(e)).alias("mae"), F.sqrt(mean(e * e)).alias("rmse"), (1 - F.try_divide(mean(e * e), mean(d * d))).alias("r2"),
        of(y & yes).alias("tp"), of(y).alias("p"), of(yes).alias("s"), mean((y == yes).cast("double")).alias("accuracy"), F.sum(n).cast("double").alias("n"),
    )
    # the median error is the first one that half of the fold's rows reach
    errors = rows.groupBy(F.col("fold").cast("string").alias("id"), F.abs(e).alias("x")).agg(F.sum(n).alias("c")).where("x IS NOT NULL")
    half = errors.groupBy("id").agg(F.ceil(F.sum("c") / 2).alias("half"))
    reached = joint.running(errors, "id", "x", "c", "upto").join(F.broadcast(half), "id").where("upto >= half AND upto - c < half").select(F.col("id").alias("mid"), F.col("x").alias("median_ae"))
    sums = sums.join(F.broadcast(reached), sums.fold.cast("string") == F.col("mid"), "left")
    counts = rows.groupBy(F.col("fold").cast("string").alias("id"), F.col("rank").alias("x")).agg(F.sum(n).alias("c"), of(y).alias("p"))
    ranks = joint.average_ranks(counts, "id", "x", "c", "r")
    # the area is the rank sum of positives, above its least possible value
    area = counts.join(ranks, ["id", "x"]).groupBy("id").agg(F.sum(F.col("p") * F.col("r")).alias("rs"))
    both = sums.join(area, sums.fold.cast("string") == area.id)
    auc = F.try_divide(F.col("rs") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * (F.col("n") - F.col("p")))
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return both.select("fold", "mae", "rmse", "r2", "median_ae", auc.alias("auc"), zero(2 * F.col("tp"), F.col("p") + F.col("s")).alias("f1"), zero(F.col("tp"), F.col("s")).alias("precision"), zero(F.col("tp"), F.col("p")).alias("recall"), "accuracy")


def dataset_facts(dataset: DataFrame, baseline: tuple[float, float], landmarking: float | None = None, n_rows: int | None = None) -> DataFrame:
    """The one row of meta.dataset_meta() with baseline_score, baseline_std, relative_headroom and landmarking_score.

    n_rows: the real number of rows, where the table is a sample; it counts if it is larger.
    """
    score, std = map(float, baseline)
    out = dataset.withColumns({"baseline_score": F.lit(score), "baseline_std": F.lit(std), "relative_headroom": F.lit(max(1 - score, 0.001)), "landmarking_score": F.lit(landmarking).cast("double")})
    if n_rows is None:
        return out
    real = F.greatest(F.col("n_rows"), F.lit(int(n_rows)))
    return out.withColumn("row_col_ratio", F.when(real > F.col("n_rows"), real / F.greatest(F.col("n_cols"), F.lit(1))).otherwise(F.col("row_col_ratio"))).withColumn("n_rows", real)
