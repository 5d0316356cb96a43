"""Hand-computed cases: nulls, ties, unseen categories, constants, single-row groups, replay and streams."""

import math
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import dates, joint
from tablewright.functions.columns import md5fold, numeric_columns
from tablewright.operators import candidates, experiments, families, meta, metrics, models, pairs, prepare, profile, transforms, verdicts
from tablewright.operators.transforms import Step, apply, fit, fit_and_apply, fitted_table
from tablewright.plans import collect, recommend
from tablewright.sources import tables
from tablewright.streaming.replay import replay

NAN = float("nan")


@pytest.fixture(scope="module")
def train(spark):
    rows = [(1, 1.0, "a", 1.0), (2, 2.0, "a", 0.0), (3, None, "b", 1.0), (4, 4.0, None, 0.0), (5, NAN, "b", 1.0), (6, 10.0, "c", 0.0)]
    return spark.createDataFrame(rows, "key long, x double, c string, label double")


@pytest.fixture(scope="module")
def test(spark):
    return spark.createDataFrame([(7, None, "a", 0.0), (8, -3.0, "new", 1.0), (9, 20.0, None, 0.0)], "key long, x double, c string, label double")


def one(df, *cols):
    return [tuple(r) for r in df.orderBy("key").select(*cols).collect()]


def test_scalar_transforms(train, test):
    got = apply(test, fit(train, [Step("impute_median", "x"), Step("missing_indicator", "x"), Step("polynomial_square", "x"), Step("reciprocal_transform", "x")]))
    # the indicator is applied first, the median is of 1, 2, 4, 10
    assert one(got, "x", "x_is_na", "x_sq") == [(3.0, 1, 9.0), (-3.0, 0, 9.0), (20.0, 0, 400.0)]
    assert math.isclose(one(got, "x_recip")[1][0], 1 / 3.00001)
    assert one(apply(test, fit(train, [Step("log_transform", "x")])), "x")[2][0] == math.log1p(20)
    bins = one(apply(test, fit(train, [Step("quantile_binning", "x")])), "x")
    assert bins == [(None,), (0.0,), (4.0,)]


def test_map_transforms(train, test):
    assert one(apply(test, fit(train, [Step("frequency_encoding", "c")])), "c") == [(2 / 6,), (0.0,), (1 / 6,)]
    target = one(apply(test, fit(train, [Step("target_encoding", "c")])), "c")
    assert [round(x[0], 9) for x in target] == [round((1 + 5) / 12, 9), 0.5, round((0 + 5) / 11, 9)]
    hot = apply(test, fit(train, [Step("onehot_encoding", "c")]))
    assert hot.columns == ["key", "x", "label", "c_b", "c_c", "c_nan"] and one(hot, "c_b", "c_nan") == [(0, 0), (0, 0), (0, 1)]
    group = apply(test, fit(train, [Step("group_mean", "x", "c"), Step("group_std", "x", "c")]))
    assert one(group, "grpmean_x_by_c") == [(1.5,), (4.25,), (4.0,)] and math.isclose(one(group, "grpstd_x_by_c")[1][0], math.sqrt(0.5))
    pair = train.withColumn("d", F.lit("z"))
    assert one(apply(test.withColumn("d", F.lit("z")), fit(pair, [Step("cat_concat", "c", "d")])), "c_concat_d") == [(0,), (-1,), (3,)]


def test_out_of_fold_excludes_the_own_fold(train):
    made, fitted = fit_and_apply(train, [Step("target_encoding", "c")])
    fold = {r.key: r.f for r in train.select("key", md5fold(F.col("key"), 5).alias("f")).collect()}
    rows = {r.key: (r.c, r.label) for r in train.collect()}
    for key, value in one(made, "key", "c"):
        rest = [y for k, (c, y) in rows.items() if c == rows[key][0] and fold[k] != fold[key]]
        assert math.isclose(value, (sum(rest) + 5) / (len(rest) + 10) if rest else 0.5)
    assert fitted_table(train.sparkSession, fitted).count() == 1


def test_row_statistics_after_imputation(train, test):
    wide = lambda df: df.withColumn("y", F.lit(0.0))
    got = apply(wide(test), fit(wide(train), [Step("row_missing_stats"), Step("impute_median", "x"), Step("row_numeric_stats", options=("row_mean", "row_std", "row_range")), Step("row_zero_stats")]))
    assert one(got, "row_missing_count", "row_mean", "row_range", "row_zero_count") == [(0, 1.5, 3.0, 1), (0, -1.5, 3.0, 1), (1, 10.0, 20.0, 1)]


def test_dates_and_weekdays(spark):
    df = spark.createDataFrame([(1, "2024-01-01 23:00:00", " Monday"), (2, "2024-01-03 01:00:00", "sun"), (3, "bad", None)], "key long, t string, d string")
    got = apply(df, fit(df, [Step("date_features", "t"), Step("date_cyclical_month", "t"), Step("dow_ordinal", "d"), Step("dow_cyclical", "d")]))
    assert one(got, "t_year", "t_dayofweek", "t_days_since_min", "t_hour", "d_dow") == [(2024, 0, 0, 23, 0), (2024, 2, 1, 1, 6), (0, 0, 0, 0, -1)]
    alone = apply(df, fit(df, [Step("dow_cyclical", "d")]))
    assert one(alone, "d_dow_cos")[2][0] == 1.0 and "d" not in alone.columns
    assert apply(df, fit(df, [Step("date_cyclical_month", "t")])).columns == df.columns


def test_text(spark):
    df = spark.createDataFrame([(1, "Ab 12 c!"), (2, None), (3, "")], "key long, t string")
    got = apply(df, fit(df, [Step("text_stats", "t")]))
    assert one(got, "t_word_count", "t_char_count", "t_uppercase_ratio", "t_punct_ratio") == [(3, 8, 1 / 8, 1 / 8), (0, 0, 0.0, 0.0), (0, 0, 0.0, 0.0)]
    docs = spark.createDataFrame([(1, "Café café the dog"), (2, "dog cat"), (3, None)], "key long, t string")
    tf = apply(docs, (own := fit(docs, [Step("text_tfidf", "t")])))
    assert own[0].params["terms"] == ["cafe", "cat", "dog"]
    cafe, dog = 2 * (math.log(4 / 2) + 1), math.log(4 / 3) + 1
    assert math.isclose(one(tf, "t_tfidf_0")[0][0], cafe / math.hypot(cafe, dog), rel_tol=1e-9) and one(tf, "t_tfidf_2")[2][0] == 0.0


def test_stream_equals_table(spark, train, test):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    steps = fit(train, [Step("frequency_encoding", "c"), Step("log_transform", "x"), Step("group_mean", "x", "c"), Step("cat_concat", "c", "c"), Step("row_missing_stats")])
    test.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(test.schema).parquet(f"{folder}/in")
    replay(stream, steps, f"{folder}/out", f"{folder}/check").awaitTermination(120)
    a, b = spark.read.parquet(f"{folder}/out"), apply(test, steps)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.count() == 3


def test_profile(spark):
    rows = [(i, 5, f"text number {i} that goes on for a while {i}", float(i * i), ["mon", "TUE "][i % 2], "2024-02-0%d" % (i % 9 + 1)) for i in range(1, 31)]
    df = spark.createDataFrame(rows, "row_id long, one int, words string, x double, day string, date string")
    kinds = {r.column: r.detected for r in profile.column_types(df, "row_id").collect()}
    assert kinds == {"row_id": "ID", "one": "Constant", "words": "Free Text", "x": "ID", "day": "Day-of-Week", "date": "Date"}
    assert {r.column for r in profile.id_columns(df).collect()} == {"row_id"}
    assert {(r.column, r.problem) for r in profile.simple_problems(profile.base_stats(df)).collect()} == {("one", "constant: one value")}
    assert profile.override_check(df, "words", "Numerical").first().severity == "error" and profile.override_check(df, "day", "Day-of-Week").first().severity == "ok"
    types = profile.reassigned(profile.column_types(df), {"one": "Numerical"})
    assert types.where("column = 'one'").first().detected == "Numerical"
    empty = df.limit(0)
    assert {r.detected for r in profile.column_types(empty).collect()} == {"Constant"}


def test_preparation(spark, train):
    assert {r["key"]: r.k for r in prepare.encode_target(train, "c", "k").collect()} == {1: 0.0, 2: 0.0, 3: 1.0, 4: None, 5: 1.0, 6: 2.0}
    assert prepare.class_weights(train, "label").where("label = 1.0").first().weight == 1.0
    got, absent, dropped = prepare.aligned(train, ["x", "gone"])
    assert got.columns == ["x", "gone"] and absent == ["gone"] and dropped == ["key", "c", "label"]
    assert numeric_columns(spark.createDataFrame([(True, 1)], "b boolean, i int"), include_bool=False) == ["i"]


def test_metrics(spark):
    s = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1), (None, 0.3)], "label int, score double")
    r = metrics.ranking_metrics(s).first()
    assert math.isclose(r.roc_auc, 0.625) and math.isclose(r.average_precision, 0.5 * 0.5 + 0.5 * 2 / 3)
    m = metrics.metrics_at_threshold(s, 0.95).first()
    assert (m.precision, m.recall, m.f1, m.accuracy) == (0.0, 0.0, 0.0, 0.5)
    assert metrics.ranking_metrics(s.where("label = 1")).first().roc_auc is None
    best = {x.metric: x for x in metrics.optimal_thresholds(s).collect()}
    assert best["recall"].threshold == 0.01 and best["recall"].value == 1.0
    assert metrics.roc_points(s).count() == 4


def test_meta(spark, train):
    flat = spark.createDataFrame([(1.0, "a", 1), (1.0, "a", 0), (1.0, "b", 1)], "x double, c string, y int")
    row = meta.numeric_column_meta(flat, ["x"], "y").first()
    assert row.entropy == 0.0 and row.coeff_variation == 0.0 and row.skewness == 0.0 and row.spearman_corr_target == 0.0
    assert meta.mixed_pair_meta(flat, "x", "c").first().eta_squared == 0.0
    n = 400
    planted = spark.range(n).select((F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 7 > 3).cast("int").alias("y"), (F.col("id") * 7919 % 31).cast("double").alias("z"))
    mi = {r.column: r.mi for r in meta.binned_mutual_information(planted, ["x", "z"], "y").collect()}
    assert mi["x"] > 0.65 and mi["z"] < 0.1
    leaks = recommend.leakage(spark.createDataFrame([("x", 0.99, 0.1), ("z", 0.1, 0.1)], "column string, spearman_corr_target double, mutual_info_score double"), 1.0)
    assert [r.column for r in leaks.collect()] == ["x"]


def test_candidates(spark):
    s = spark.createDataFrame([("row", "", None, "row_zero_stats", -1.0, None, None), ("numerical", "x", None, "log_transform", 2.0, False, None), ("numerical", "x", None, "sqrt_transform", 1.0, False, None), ("numerical", "x", None, "polynomial_square", 0.0, False, None), ("interaction", "x", "y", "product_interaction", 3.0, False, None), ("interaction", "y", "x", "product_interaction", 1.0, False, None)], candidates.SUGGESTION)
    z = candidates.deduplicated(candidates.normalised(candidates.pinned_row_families(s)))
    assert {(r.column, r.method) for r in z.collect()} == {("", "row_zero_stats"), ("x", "log_transform"), ("x", "polynomial_square"), ("x", "product_interaction")}
    assert z.where("type = 'row'").first().predicted_delta == 0.0
    ranked = candidates.selected(z, 1)
    assert ranked.where("auto_checked").count() == 1
    own = candidates.with_custom(z.select("type", "column", "column_b", "method", "auto_checked"), spark.createDataFrame([("numerical", "x", None, "log_transform"), ("numerical", "q", None, "log_transform")], "type string, column string, column_b string, method string"))
    assert own.count() == z.count() + 1 and own.where("auto_checked").count() == 2
    v = candidates.feature_vector(spark.createDataFrame([("a", 1.0, None)], "method string, f double, g double"), ["f", "g", "h"], ("a", "b")).first().features
    assert v == [1.0, -999.0, -999.0, 1.0, 0.0]
    nb = spark.createDataFrame([(f"a{i % 5}", f"b{i % 5}", i % 2) for i in range(50)], "a string, b string, c int")
    assert candidates.near_bijection(nb, "a", "b").first().near_bijection and not candidates.near_bijection(nb, "a", "c").first().near_bijection
    # caps count what is left without near bijections; walked by the more important side
    own = spark.createDataFrame([(f"n{i}", True, 10.0 - i) for i in range(9)] + [(f"c{i}", False, 10.0 - i) for i in range(7)], "column string, numeric boolean, importance double")
    alike = spark.createDataFrame([("n1", "n0"), ("n0", "c0")], "a string, b string")
    pool = candidates.pair_pool(own, alike).orderBy("kind", "rank").collect()
    by = {k: [(r.a, r.b) for r in pool if r.kind == k] for k in ("nn", "nc", "cc")}
    assert by["nn"] == [(f"n{i}", f"n{j}") for i in range(8) for j in range(i + 1, 8) if (i, j) != (0, 1)]
    assert by["nc"] == [(f"n{j}", f"c{i}") for i in range(6) for j in range(8) if (i, j) != (0, 0)][:20] and by["cc"] == [(f"c{i}", f"c{j}") for i in range(6) for j in range(i + 1, 6)][:10]


def test_early_stopping_and_search(spark):
    assert models.kept_rounds([5, 4, 3, 3.5, 2]) == 5 and models.kept_rounds([5, 4, 3, 3.5, 3.5, 2], 2) == 3 and models.kept_rounds([1.0]) == 1
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] + 1.5 * rng.normal(size=400) > 0).astype(int)
    df = spark.createDataFrame([(i, *map(float, x[i]), int(y[i])) for i in range(400)], "key long, a double, b double, c double, label int")
    enc = models.fit_encoders(df, "label", skip=("key",))
    rows = models.matrix(df, enc, ["key", "label"]).withColumn("held", F.col("key") % 4 == 0)
    long = models.train_classifier(rows.where("NOT held"), 2, params={"maxIter": 40, "stepSize": 0.3})
    cut = models.train_classifier(rows, 2, params={"maxIter": 40, "stepSize": 0.3}, validation="held")
    held = rows.where("held")
    losses = long.evaluateEachIteration(held)
    assert cut.getNumTrees < 40 and cut.getNumTrees == models.kept_rounds(losses) and cut.evaluateEachIteration(held)[-1] <= losses[-1]
    assert models.train_classifier(rows.withColumn("held", F.lit(False)), 2, params={"maxIter": 2}, validation="held").getNumTrees == 2
    assert models.trials(3) == models.trials(3) != models.trials(3, 1) and all(set(t) >= {"maxIter", "maxDepth", "stepSize"} for t in models.trials(5))
    # a planted best: only deep trees can follow the sign of a product
    planted = df.withColumn("label", (F.col("a") * F.col("b") > 0).cast("int"))
    rows = models.matrix(planted, models.fit_encoders(planted, "label", skip=("key",)), ["key", "label"])
    best, table = models.search_ranges(rows, "key", 4, ranges={"maxIter": (6, 6), "maxDepth": (1, 5)}, side_by_side=2)
    told = table.collect()
    assert best["maxDepth"] >= 3 and len(told) == 4 + 2 + 1 and {r.rounds for r in told} == {1, 2, 6} and max(r.auc for r in told if r.rounds == 6) > 0.85


def test_exact_samples(spark):
    df = spark.range(5000).selectExpr("id AS key", "CASE WHEN id % 100 = 0 THEN NULL WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS label", "id % 7 AS x")
    got = prepare.quick_sample(df, "label", "key")
    assert got.columns == df.columns and got.count() == 2000 and {r.label: r["count"] for r in got.groupBy("label").count().collect()} == {None: 20, "a": 660, "b": 1320}
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, prepare.quick_sample(df.repartition(7), "label", "key").collect()), key=str)
    assert prepare.quick_sample(df.limit(100), "label", "key").count() == 100 and prepare.cap_cells(df, "key", 3000).count() == 1000 and prepare.cap_cells(df, "key").count() == 5000
    split = prepare.exact_stratified_split(df, "label", "key")
    assert {r.label: r.n for r in split.where("is_test").groupBy("label").agg(F.count("*").alias("n")).collect()} == {None: 10, "a": 330, "b": 660} and split.count() == 5000
    assert prepare.exact_stratified_split(spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "key long, label string"), "label", "key", 0.5).where("is_test").count() == 1


def test_family_store(spark):
    rows = spark.createDataFrame([(f"d{i % 6}", ["log_transform", "sqrt_transform"][i % 2], i / 50.0, None if i % 5 == 0 else float(i % 7), 2 * i / 50.0 + (i % 2) / 2) for i in range(50)] + [("d0", "log_transform", 1.0, 1.0, None)], "dataset_name string, method string, null_pct double, normality_p_value double, cohens_d double")
    order = ["null_pct", "shapiro_p_value", "gone", "method_log_transform", "method_sqrt_transform"]
    # renamed, null, absent, and a place for each method
    v = families.vector(rows.limit(2), order).orderBy("null_pct").collect()
    assert [list(r.features) for r in v] == [[0.0, -999.0, -999.0, 1.0, 0.0], [0.02, 1.0, -999.0, 0.0, 1.0]]
    model = families.train(rows, "numerical", "cohens_d", ["null_pct", "method_log_transform", "method_sqrt_transform"], LinearRegression(fitIntercept=False))
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    assert families.load(spark, folder) == {}
    model.save(folder)
    model.save(folder)  # a store can be written again
    again = families.load(spark, folder)
    assert list(again) == ["numerical"] and again["numerical"].features == model.features and again["numerical"].methods == ["log_transform", "sqrt_transform"]
    asked = spark.createDataFrame([("x", "log_transform", 0.5), ("x", "sqrt_transform", 0.5), ("x", "unknown", 0.5)], "column string, method string, null_pct double")
    assert {r.method: round(r.predicted_delta_raw, 6) for r in again["numerical"].score(asked).collect()} == {"log_transform": 1.0, "sqrt_transform": 1.5}
    folds = families.cross_validated(rows, "numerical", "cohens_d", "dataset_name", model.features, 3, LinearRegression(fitIntercept=False)).collect()
    assert len(folds) == 3 and all(r.mae < 1e-6 and r.r2 > 0.999 and r.f1 > 0.9 for r in folds)
    assert families.cross_validated(rows.limit(0), "numerical", "cohens_d", "dataset_name", model.features, 3).collect() == []
    for f in families.OWN:
        assert len(families.vector_order(f)) == {"numerical": 43, "categorical": 38, "interaction": 59, "row": 33}[f]


def test_dataset_facts(spark):
    df = spark.createDataFrame([(1, 2.0, 0), (2, 3.0, 1), (3, None, 0), (4, 1.0, 1)], "k long, x double, label int")
    facts = meta.dataset_meta(df, "label")
    r = families.dataset_facts(facts, (0.9995, 0.01), n_rows=1000).first()
    assert (r.n_rows, r.row_col_ratio, r.relative_headroom, r.landmarking_score) == (1000, 500.0, 0.001, None)
    r = families.dataset_facts(facts, (0.75, 0.01), 0.6, n_rows=2).first()
    assert (r.n_rows, r.row_col_ratio, r.relative_headroom, r.landmarking_score) == (4, 2.0, 0.25, 0.6)


def test_recommendation_parts(spark):
    df = spark.range(300).selectExpr("id AS row_id", "id % 17 AS a", "(id * 7) % 23 AS b", "1 AS one", "CAST(id % 2 AS INT) AS label", "5 * CAST(id % 2 AS INT) AS leak")
    got = recommend.recommendation(df, "label", spark.createDataFrame([("a", 2.0), ("b", 1.0), ("leak", 3.0)], "column string, importance double"), lambda rows, kind: rows.withColumn("predicted_delta_raw", F.length("method") / 100.0), order_by="row_id")
    assert {tuple(r) for r in got.skipped.collect()} == {("row_id", "id"), ("one", "constant")}
    said = got.advisories.collect()
    assert [r.category for r in said] == ["leakage", "Small Dataset"] and said[0].severity == "high" and "leak: rank correlation" in said[0].detail and said[1].suggested_params["num_leaves"] == 15
    named = recommend.recommendation(df.withColumn("label", F.concat(F.lit("class "), "label")), "label", spark.createDataFrame([("a", 2.0)], "column string, importance double"), {})
    assert {r.type for r in named.suggestions.collect()} <= {"date", "text"} and named.advisories.count() == 1
    assert got.dataset.first().baseline_score == 0.5 and not {"row_id", "one"} & {r.column for r in got.suggestions.collect()}


def test_pair_meta_edges(spark):
    rows = [(1.0, None, "a", None, 0), (2.0, None, "b", "x", 1), (None, None, None, "y", 0), (4.0, None, "a", "x", 1)]
    df = spark.createDataFrame(rows, "u double, v double, g string, h string, label int")
    none = spark.createDataFrame([], "column string, importance double")
    got = {(r.a, r.b): r for r in pairs.pair_meta(df, [("u", "v"), ("g", "u"), ("g", "h")], "label", none).collect()}
    r = got["u", "v"]
    assert (r.pearson_corr, r.spearman_corr, r.eta_squared, r.cramers_v, r.sum_importance) == (0.0, 0.0, -10.0, -20.0, 0.0)
    r = got["g", "u"]  # groups a: 1, 4 and b: 2; the mean is that of all numbers
    assert (r.pearson_corr, r.cramers_v, r.n_groups) == (-10.0, -10.0, 2.0) and math.isclose(r.eta_squared, (2 * (2.5 - 7 / 3) ** 2 + (2 - 7 / 3) ** 2) / (14 / 3), rel_tol=1e-9) and r.anova_f_stat == 0.0
    r = got["g", "h"]
    assert (r.pearson_corr, r.eta_squared, r.joint_cardinality, r.joint_sparsity) == (-20.0, -20.0, 4.0, 0.0) and 0 < r.cramers_v <= 1


def test_joint_measures(spark):
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 30, 400).astype(float), rng.normal(size=400)
    y = np.round(y + x / 10, 1)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y, "z": np.where(x > 5, y, np.nan)}))
    df = df.withColumn("z", F.when(~F.isnan("z"), F.col("z")))
    asked = [("xy", F.col("x"), F.col("y")), ("xz", F.col("x"), F.col("z"))]
    want = {i: pd.DataFrame({"a": x, "b": b}).dropna() for i, b in (("xy", y), ("xz", np.where(x > 5, y, np.nan)))}
    for r in joint.rank_correlations(joint.counts(df, asked)).collect():
        assert r.n == len(want[r.id]) and math.isclose(r.spearman, want[r.id].rank().corr().iloc[0, 1], rel_tol=1e-9)
    for r in joint.correlations(df, asked).collect():
        assert r.n == len(want[r.id]) and math.isclose(r.pearson, want[r.id].corr().iloc[0, 1], rel_tol=1e-9)
    for r in joint.information(joint.counts(df, asked)).collect():
        t = pd.crosstab(want[r.id].a, want[r.id].b).to_numpy() / len(want[r.id])
        e = t.sum(1, keepdims=True) * t.sum(0, keepdims=True)
        assert math.isclose(r.mi, (t[t > 0] * np.log(t[t > 0] / e[t > 0])).sum(), rel_tol=1e-9) and math.isclose(r.entropy_y, -(t.sum(0) * np.log2(t.sum(0))).sum(), rel_tol=1e-9)
    flat = joint.correlations(df.withColumn("c", F.lit(3.3)), [("xc", F.col("x"), F.col("c"))]).first()
    assert flat.pearson is None


def test_linear_copies_make_no_pairs(spark):
    df = spark.range(200).selectExpr("id AS a", "3 * id + 1 AS b", "id % 7 AS c", "concat('g', id % 7) AS g", "CAST(id % 2 AS INT) AS label")
    imps = spark.createDataFrame([("a", 4.0), ("b", 3.0), ("c", 2.0), ("g", 1.0)], "column string, importance double")
    found = recommend.candidates_of_pairs(df, ["a", "b", "c"], ["g"], imps)
    assert {tuple(sorted((r.column, r.column_b))) for r in found.collect()} == {("a", "c"), ("b", "c"), ("a", "g"), ("b", "g")}


def test_dates(spark):
    cases = {
        "2024-01-02 10:01:00.000001": "2024-01-02 10:01:00.000001", "2024-01-02 10:00": "2024-01-02 10:00:00", "Jan 2, 2024": "2024-01-02 00:00:00", "1/3/2024": "2024-01-03 00:00:00", "2024/01/02": "2024-01-02 00:00:00", "25/12/2024": "2024-12-25 00:00:00",
        "2024-01-02T03:04:05Z": "2024-01-02 03:04:05", "2024-01-02 03:04:05+01:00": "2024-01-02 03:04:05", "13.1.24": "2024-01-13 00:00:00", "1/2/69": "1969-01-02 00:00:00", "20240131": "2024-01-31 00:00:00", "31 Jan 2024 12:00 AM": "2024-01-31 00:00:00", "January 31, 2024 5:06 PM": "2024-01-31 17:06:00",
        "Mon, 02 Jan 2024 10:00:00 GMT": "2024-01-02 10:00:00", "10:30": "1970-01-01 10:30:00", "Sept 5, 2021": "2021-09-05 00:00:00", "12/31/99 1:02:03.5 pm": "1999-12-31 13:02:03.5", "2024-02-29": "2024-02-29 00:00:00", "2023-02-29": None, "2024-13-01": None, "1/32/2024": None, "2024-01-02 25:00": None, "13:00 PM": None, "hello 10:00": None, "x": None, "": None,
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()] + [(None, None)], "s string, want string")
    for r in df.select("s", "want", dates.parsed_date(F.col("s")).cast("string").alias("got")).collect():
        assert r.got == r.want, r.s
    days = spark.createDataFrame([("1/2/2024", "1/2/2024", "2024-01-02"), ("25/2/2024", "2/25/2024", "2024-01-02")], "a string, b string, c string")
    assert dates.day_first(days, ["a", "b", "c"]) == {"a": True, "b": False, "c": False} and dates.day_first(days, []) == {}
    train = days.select(F.lit(1).alias("label"), F.col("a"), F.monotonically_increasing_id().alias("key"))
    made, fitted = fit_and_apply(train, [Step("date_features", "a")])
    assert sorted((r.a_month, r.a_day) for r in made.collect()) == [(2, 1), (2, 25)]
    # the order is the training table's, also where a later table leaves it open
    assert apply(train.where("a = '1/2/2024'"), fitted).first().a_month == 2


def test_student_and_effects(spark):
    # closed forms for one and two degrees of freedom
    for t in (0.3, 1.0, 2.5, 12.0):
        assert math.isclose(experiments.student_p(t, 1), 1 - 2 * math.atan(t) / math.pi, rel_tol=1e-9)
        assert math.isclose(experiments.student_p(-t, 2), 1 - t / math.sqrt(2 + t * t), rel_tol=1e-9)
    rows = [("d", "m", k, 0.5, 0.5 + d) for k, d in enumerate((0.01, 0.02, 0.03))] + [("d", "n", 0, 0.5, 0.6), ("d", "o", 0, None, 0.6)]
    got = {r.method: r for r in experiments.fold_effects(spark.createDataFrame(rows, "dataset_name string, method string, fold int, baseline double, changed double"), ["dataset_name", "method"]).collect()}
    assert math.isclose(got["m"].cohens_d, 2.0) and math.isclose(got["m"].t_stat, 2 * math.sqrt(3)) and got["n"].p_value is None and got["n"].cohens_d is None and "o" not in got
    assert math.isclose(got["m"].p_value, 1 - 2 * math.sqrt(3) / math.sqrt(2 + 12), rel_tol=1e-9)


def test_verdicts(spark):
    e = spark.createDataFrame([("a", 90.0), ("b", 9.9), ("c", 0.1)], "column string, importance double")
    made = spark.createDataFrame([("t1", "a"), ("t2", "c"), ("t3", "gone")], "transform string, column string")
    assert {r.transform: r.verdict for r in verdicts.transform_verdicts(made, e, e, 100).collect()} == {"t1": "good", "t2": "bad", "t3": "bad"}
    cases = {  # baseline and enhanced f1, precision, recall
        "marginal": [(0.95, 0.95, 0.95, 0.95, 0.95, 0.95), (0.95, 0.95, 0.95, 0.5, 0.5, 0.5), (0.5, 0.6, 0.4, 0.5, 0.4, 0.6), (0.5, 0.5, 0.5, 0.49, 0.5, 0.5)],
        "good": [(0.95, 0.95, 0.95, 0.96, 0.95, 0.95), (0.95, 0.95, 0.85, 0.95, 0.95, 0.85), (0.5, 0.5, 0.5, 0.496, 0.5, 0.5), (None, None, None, 0.1, 0.1, 0.1)], "bad": [(0.5, 0.5, 0.5, 0.47, 0.5, 0.7), (0.95, 0.95, 0.85, 0.9, 0.9, 0.9)],
    }
    for verdict, rows in cases.items():
        m = spark.createDataFrame(rows, ", ".join(f"{k}_{x} double" for k in ("baseline", "enhanced") for x in ("f1", "precision", "recall")))
        assert {r.verdict for r in verdicts.imbalance_verdict(m).collect()} == {verdict}
    test = spark.createDataFrame([("f1", 0.5, 0.6), ("precision", 0.9, 0.9), ("recall", None, 0.9), ("roc_auc", 0.7, 0.76)], "metric string, baseline double, enhanced double")
    own = verdicts.transform_verdicts(made, e, e, 100)
    rules = lambda v, low=e, **k: {(r.rule, r.detail) for r in verdicts.recommendations(v, low, test, **k).collect()}
    assert rules(own, applied=True) == {("run again without", "2 transforms"), ("drop columns", "3 columns"), ("class weights", "effective"), ("tuning", "likely worth while")}
    assert rules(own, offered=True) - rules(own) == {("enable class weights", "f1")}
    assert rules(own.where("verdict = 'good'"), e.limit(0)) == {("all contributed", "0 transforms"), ("tuning", "likely worth while")}
    typed = own.where("verdict = 'bad'").limit(1).withColumn("type", F.lit("imbalance"))
    assert ("all contributed", "0 transforms") in rules(typed)
    parts = spark.createDataFrame([("date_features:d", "d_year"), ("date_features:d", "d_month"), ("date_features:d", "d_gone"), ("date_cyclical_month:d", "d_month"), ("row_numeric_stats", "row_sum")], "transform string, column string")
    imp = spark.createDataFrame([("d_year", 50.0), ("d_month", 1.0), ("row_sum", 49.0)], "column string, importance double")
    found = verdicts.bad_parts(parts, imp, verdicts.transform_verdicts(parts, imp, imp, 10), 10)
    assert {(r.transform, r.column) for r in found.collect()} == {("date_features:d", "d_month"), ("date_features:d", "d_gone")}
    flags = verdicts.executive_flags(spark.createDataFrame([(100, 0.9995)], "n_rows long, auc double"), spark.createDataFrame([("high",), ("low",)], "severity string"))
    assert [r.flag for r in flags.collect()] == ["few rows", "suspicious auc", "high advisories", "low advisories"]


def test_sources(spark):
    assert tables.sanitised(['a"b', "a:b", "a_b", "c"]) == ["a_b", "a_b_1", "a_b_2", "c"] and tables.sanitised(["__x  y", "%", "x_y"], strict=True) == ["x_y", "col", "x_y_1"]
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    with open(f"{folder}/l.csv", "wb") as f:
        f.write("name,n\ncaf\xe9,1\n".encode("latin-1"))
    assert tables.read_labelled_csv(spark, f"{folder}/l.csv").first().name == "café"
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    tables.append_rows(spark.createDataFrame([(1, 9)], "a int, z int"), f"{folder}/r", schema)
    tables.append_rows(spark.createDataFrame([("x",)], "b string"), f"{folder}/r", schema)
    assert sorted(map(tuple, spark.read.parquet(f"{folder}/r").collect()), key=str) == [(1, None), (None, "x")]
    scored = spark.createDataFrame([(1, 0.75, 1.0, 0)], "key long, score double, prediction double, label int")
    assert tuple(tables.predictions(scored, ["key"], ["no", "yes"]).first()) == (1, "yes", "no", 0.75, 0.25)
    assert tables.load_family_models(spark, folder, ("numerical",)) == {}


def test_models_and_experiments(spark):
    df = spark.range(400).select(F.col("id").alias("key"), (F.col("id") * 7919 % 101).cast("double").alias("x"), F.concat(F.lit("c"), F.col("id") % 4).alias("c")).withColumn("label", ((F.col("x") > 50) & (F.col("c") != "c0")).cast("int"))
    small = {"maxIter": 3, "maxDepth": 3}
    auc, _ = models.quick_auc(df, "label", "key", small)
    assert auc > 0.9
    imp = {r.column: r.importance for r in models.baseline_importances(df.drop("key"), "label", 2, small).collect()}
    assert math.isclose(sum(imp.values()), 100.0) and imp["x"] > 10
    assert models.tree_guided_pairs(df.drop("key"), "label", tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/m").first().n > 0
    df = df.withColumn("label", (F.col("x") + F.col("key") * 31 % 97 > 100).cast("int"))
    folds = collect.collect(df, "label", "key", "d", ("numerical",), 2, 1, {"maxIter": 2, "maxDepth": 1})
    assert folds.count() == 2 * len(collect.cells(df, "label", "key", ("numerical",))) > 0
    assert collect.collect(df, "label", "key", "d", ("numerical",), 2, 1, {"maxIter": 2, "maxDepth": 1}, done=folds).count() == 0
    enc = models.fit_encoders(df, "label", skip=("key",))
    new = spark.createDataFrame([(1, "zzz")], "key long, c string")
    assert models.matrix(new, enc, ["key"]).first().features.toArray().tolist() == [0.0, 0.0]


def test_evaluation_and_report(spark):
    from tablewright.plans import evaluate

    df = spark.range(300).select(F.col("id").alias("key"), (F.col("id") * 7919 % 101).cast("double").alias("x"), F.concat(F.lit("c"), F.col("id") % 3).alias("c")).withColumn("label", (F.col("x") > 50).cast("int")).withColumn("kind", (F.col("x") / 40).cast("int"))
    steps = fit(df.drop("kind"), [Step("frequency_encoding", "c")])
    model, enc = evaluate.final_model(df.drop("kind"), "label", "key", steps, 2, {"maxIter": 2, "maxDepth": 3})
    got = evaluate.evaluate_on_set(model, apply(df, steps), enc, 2, "label", 0.4)
    values = {r.metric: r.value for r in got["metrics"].collect()}
    assert values["roc_auc"] > 0.99 and values["accuracy"] > 0.95 and got["confusion"].agg(F.sum("n")).first()[0] == 300
    enc3 = models.fit_encoders(df.drop("label"), "kind", skip=("key",))
    three = models.train_classifier(models.matrix(df, enc3, ["kind"]), 3, "kind", {"maxIter": 5, "maxDepth": 3})
    values3 = {r.metric: r.value for r in evaluate.evaluate_on_set(three, df, enc3, 3, "kind")["metrics"].collect()}
    assert values3["roc_auc"] > 0.95 and values3["log_loss"] < 1
    sugg = spark.createDataFrame([], candidates.SUGGESTION)
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    evaluate.write_report(evaluate.report_tables(df.drop("kind"), "label", sugg, steps, got["metrics"], got["metrics"], "key"), folder)
    assert spark.read.parquet(f"{folder}/metrics").where("winner = 'tie'").count() == len(values)


def test_ids_by_name(spark):
    rows = [(i, i * i % 97 + 100 * (i % 9), f"2024-01-{i % 28 + 1:02d} 10:00:0{i % 9}", f"x{i}", i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "key long, user_no long, seen_id string, entry_id string, uuid long")
    got = {r.column: r.reason for r in profile.id_columns(df).collect()}
    # a date column is none, whatever its name, and uuid is no name of an ID
    assert got["entry_id"] == "name, short text" and got["user_no"] == "name" and "seen_id" not in got and "uuid" not in got


def test_onehot_has_no_silent_cap(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"v{i:03d}", i % 2) for i in range(260)], "key long, c string, label int")
    made, _ = transforms.fit_and_apply(df, [transforms.Step("onehot_encoding", "c")], "label", "key")
    assert len(made.columns) >= 259
    monkeypatch.setattr(transforms, "ONEHOT_MOST", 200)
    with pytest.raises(ValueError, match="more than 200 values"):
        transforms.fit(df, [transforms.Step("onehot_encoding", "c")], "label", "key")


def test_suggestions_of_all_kinds(spark):
    rows = [(float(i % 17), float(i * 7 % 23), "abcd"[i % 4], "wxyz"[i % 4], "pqr"[i * 5 % 3], f"2024-{i % 12 + 1:02d}-{i % 28 + 1:02d}", "yes" if i % 8 == 0 else "no") for i in range(400)]
    df = spark.createDataFrame(rows, "n1 double, n2 double, c1 string, c2 string, c3 string, day string, label string")
    given = spark.createDataFrame([(c, 1.0 + i) for i, c in enumerate(df.columns[:-1])], "column string, importance double")
    coded = df.withColumn("label", (F.col("label") == "yes").cast("int"))
    got = recommend.suggestions(coded, "label", given, lambda found, kind: found.withColumn("predicted_delta_raw", F.length("method") / 100.0)).collect()
    by = {(r.type, r.column, r.column_b, r.method): r for r in got}
    pairs = {frozenset((r.column, r.column_b)) for r in got if r.type == "interaction"}
    assert frozenset(("n1", "n2")) in pairs and frozenset(("c1", "c3")) in pairs and frozenset(("c1", "c2")) not in pairs  # c1 and c2 say the same
    imbalance = by["imbalance", "(model parameter)", None, "class_weight_balance"]
    assert imbalance.predicted_delta == 1.0 and imbalance.predicted_delta_raw == 0.0 and imbalance.pinned and not imbalance.auto_checked
    date = by["date", "day", None, "date_features"]
    assert date.predicted_delta == 0.5 and date.predicted_delta_raw == 0.0 and date.auto_checked and abs(by["date", "day", None, "date_cyclical_month"].predicted_delta - 0.489) < 1e-9
    ordered = [r.predicted_delta for r in sorted(got, key=lambda r: r.rank)]
    assert ordered == sorted(ordered, reverse=True) and sorted(r.rank for r in got) == list(range(1, len(got) + 1))
    changed = recommend.suggestions(coded, "label", given, lambda found, kind: found.withColumn("predicted_delta_raw", F.lit(0.1)), overrides={"n2": "Categorical"}, include_imbalance=False)
    assert changed.where("type = 'imbalance' OR (type = 'numerical' AND column = 'n2')").isEmpty()


def test_quantiles(spark, monkeypatch):
    from tablewright.functions import quantiles as module

    monkeypatch.setattr(module, "BRACKET", 10)
    rng, points = np.random.default_rng(3), (0.0, 0.02, 0.25, 0.5, 0.77, 1.0)
    even, heavy, few = rng.normal(size=30_000), np.exp(6 * rng.normal(size=30_000)), rng.integers(0, 3, 30_000).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"even": even, "heavy": heavy, "few": few, "none": np.nan})).withColumn("some", F.when(F.col("few") > 0, F.col("even")))
    got = module.quantiles(df, {c: points for c in ("even", "heavy", "few", "none", "some")})
    assert got["none"] is None
    for c, values in (("even", even), ("heavy", heavy), ("few", few), ("some", even[few > 0])):
        assert np.allclose(got[c], np.quantile(values, points), rtol=1e-12)
    assert module.quantiles(df.limit(0), {"even": (0.5,)}) == {"even": None} and module.quantiles(df, {}) == {}
