"""Candidates: columns and pairs crossed with methods, gates, scores, normalisation, ranking.

Tables here have a row for each column, pair or suggestion, so windows without many partitions hold little.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import present
from .profile import distinct_counts

# Method names by family, caps of pairs, groups by problem, limits.
NUMERICAL = ("log_transform", "sqrt_transform", "polynomial_square", "polynomial_cube", "reciprocal_transform", "quantile_binning", "impute_median", "missing_indicator")
CATEGORICAL = ("frequency_encoding", "target_encoding", "onehot_encoding", "hashing_encoding", "missing_indicator")
NUM_NUM = ("product_interaction", "division_interaction", "addition_interaction", "abs_diff_interaction")
NUM_CAT, CAT_CAT = ("group_mean", "group_std"), ("cat_concat",)
ROW_FAMILIES = ("row_numeric_stats", "row_zero_stats", "row_missing_stats")
ADDITIVE = ("missing_indicator", "polynomial_square", "polynomial_cube", "reciprocal_transform")
TOP_NUMERIC, TOP_CATEGORY, CAPS = 8, 6, {"nn": 30, "nc": 20, "cc": 10}
PROBLEMS = {
    "imbalance": ("class_weight_balance",), "missing_values": ("impute_median", "missing_indicator"), "skewed": ("log_transform", "sqrt_transform", "reciprocal_transform", "quantile_binning"), "nonlinear": ("polynomial_square", "polynomial_cube"),
    "categorical": ("frequency_encoding", "target_encoding", "onehot_encoding", "hashing_encoding"), "interactions": (*NUM_NUM, *NUM_CAT, *CAT_CAT), "row_patterns": ROW_FAMILIES,
    "date_features": ("date_features", "date_cyclical", "date_cyclical_month", "date_cyclical_dow", "date_cyclical_dom", "date_cyclical_hour", "dow_ordinal", "dow_cyclical"), "text_features": ("text_stats", "text_tfidf"),
}
SUGGESTION = "type string, column string, column_b string, method string, predicted_delta_raw double, pinned boolean, auto_checked boolean"


def empty(spark: SparkSession) -> DataFrame:
    """No suggestions, in the columns in which families, dates, texts and imbalance meet."""
    return spark.createDataFrame([], "type string, column string, column_b string, method string, predicted_delta double, predicted_delta_raw double, pinned boolean, auto_checked boolean")


def _methods(df: DataFrame, methods: tuple[str, ...]) -> DataFrame:
    """Each row with each method: an array of constants, exploded."""
    return df.select("*", F.explode(F.array(*map(F.lit, methods))).alias("method"))


def numerical_gate() -> Column:
    """Over columns method, null_pct, unique_ratio, is_binary, min_value."""
    m, plain = F.col("method"), F.col("is_binary") != 1
    fills = m.isin("impute_median", "missing_indicator")
    own = (
        F.when(fills, F.col("null_pct") > 0)
        .when(F.col("null_pct") > 0.5, F.lit(False))
        .when(m == "sqrt_transform", (F.col("min_value") >= 0) & plain)
        .when(m == "quantile_binning", (F.col("unique_ratio") >= 0.01) & plain)
        .otherwise(plain)
    )
    return F.coalesce(own, F.lit(False))


def categorical_gate() -> Column:
    """Over columns method, null_pct, n_unique."""
    m, u = F.col("method"), F.col("n_unique")
    return F.when(m == "missing_indicator", F.col("null_pct") > 0).when(m == "onehot_encoding", u.between(2, 10)).when(m == "hashing_encoding", u > 10).otherwise(F.lit(True))


def numerical_candidates(meta: DataFrame) -> DataFrame:
    return _methods(meta, NUMERICAL).where(numerical_gate())


def categorical_candidates(meta: DataFrame) -> DataFrame:
    return _methods(meta, CATEGORICAL).where(categorical_gate())


def top_columns(profile: DataFrame) -> DataFrame:
    """profile (column, numeric, importance ..) with k, its place by importance (then by name), of the TOP_NUMERIC and TOP_CATEGORY most important columns."""
    order = Window.partitionBy("numeric").orderBy(F.desc("importance"), "column")
    return profile.withColumn("k", F.row_number().over(order)).where(F.col("k") <= F.when(F.col("numeric"), TOP_NUMERIC).otherwise(TOP_CATEGORY))


def pair_pool(profile: DataFrame, alike: DataFrame | None = None) -> DataFrame:
    """a, b, kind (nn, nc, cc), rank of a profile (column, numeric, importance, and unique_ratio where known): pairs of the most important columns.

    Pairs in `alike` (a, b in any order: near bijections) are left out, and so are pairs of category columns of which one
    has a unique_ratio over 0.5; the caps by kind count what is left. Numeric pairs and pairs of category columns are walked
    by the more important side first, mixed ones by the category column; ties of importance go by name. In a mixed pair b is the category column.
    """
    top = top_columns(profile if "unique_ratio" in profile.columns else profile.withColumn("unique_ratio", F.lit(0.0)))
    top = top.sparkSession.createDataFrame(top.collect(), top.schema)  # 14 rows at most, worked out once for both sides
    l = top.select(F.col("column").alias("a"), F.col("numeric").alias("an"), F.col("k").alias("ak"), F.col("unique_ratio").alias("au"))
    r = top.select(F.col("column").alias("b"), F.col("numeric").alias("bn"), F.col("k").alias("bk"), F.col("unique_ratio").alias("bu"))
    both = l.join(r, ((F.col("an") == F.col("bn")) & (F.col("ak") < F.col("bk"))) | (F.col("an") & ~F.col("bn")))  # 14 rows at most on each side
    kind = F.when(F.col("an") & F.col("bn"), "nn").when(F.col("an"), "nc").otherwise("cc")
    both = both.withColumn("kind", kind).where((F.col("kind") != "cc") | (F.greatest("au", "bu") <= 0.5))
    if alike is not None:
        known = alike.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()
        both = both.join(F.broadcast(known), (F.least("a", "b") == F.col("x")) & (F.greatest("a", "b") == F.col("y")), "left_anti")  # pairs of top columns only
    mixed = F.col("kind") == "nc"
    order = Window.partitionBy("kind").orderBy(F.when(mixed, F.col("bk")).otherwise(F.col("ak")), F.when(mixed, F.col("ak")).otherwise(F.col("bk")))
    cap = reduce(lambda c, k: c.when(F.col("kind") == k, CAPS[k]), CAPS, F)
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap).select("a", "b", "kind", "rank")


def near_bijections(df: DataFrame, pairs: list[tuple[str, str]], share: float = 0.95) -> DataFrame:
    """a, b, near_bijection of each pair: both columns have 3 values or more, in numbers within 80 %, over 10 rows or more, and `share` of each one's values meet one value of the other.

    Distinct values are counted first, for all columns at once; what could still be a bijection is grouped by (pair, a, b) in one job for all pairs.
    """
    used = sorted({c for p in pairs for c in p})
    kinds = dict.fromkeys(used, 0) | {r.column: r.n_unique for r in distinct_counts(df, used).collect()}  # a row for each column
    close = [(a, b) for a, b in pairs if min(kinds[a], kinds[b]) >= 3 and min(kinds[a], kinds[b]) / max(kinds[a], kinds[b]) >= 0.80]
    every = df.sparkSession.createDataFrame([(a, b) for a, b in pairs], "a string, b string")
    if not close:
        return every.withColumn("near_bijection", F.lit(False))
    values = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), present(df, a).cast("string").alias("x"), present(df, b).cast("string").alias("y")) for a, b in close))
    cells = df.select(F.inline(values)).where("x IS NOT NULL AND y IS NOT NULL").groupBy("a", "b", "x", "y").agg(F.count("*").alias("n"))
    one = lambda k: cells.groupBy("a", "b", k).agg(F.count("*").alias("kinds"), F.sum("n").alias("n")).groupBy("a", "b").agg(F.avg((F.col("kinds") == 1).cast("double")).alias(f"s{k}"), F.sum("n").alias(f"n{k}"))
    both = one("x").join(one("y"), ["a", "b"]).select("a", "b", ((F.col("nx") >= 10) & (F.col("sx") >= share) & (F.col("sy") >= share)).alias("ok"))
    return every.join(both, ["a", "b"], "left").select("a", "b", F.coalesce("ok", F.lit(False)).alias("near_bijection"))


def near_bijection(df: DataFrame, a: str, b: str, share: float = 0.95) -> DataFrame:
    """near_bijections() of one pair."""
    return near_bijections(df, [(a, b)], share)


def pair_candidates(pairs: DataFrame, n_rows: int) -> DataFrame:
    """Pairs with what the gates look at (kind, a_unique, b_unique, a_ratio, b_ratio, b_has_zero, joint_cardinality), crossed with their kind's methods.

    In a pair of kind nc, b is the category column. A null in a denominator counts as zero.
    """
    rows = pairs.select("*", F.explode(F.when(F.col("kind") == "nn", F.array(*map(F.lit, NUM_NUM))).when(F.col("kind") == "nc", F.array(*map(F.lit, NUM_CAT))).otherwise(F.array(*map(F.lit, CAT_CAT)))).alias("method"))
    both_binary = (F.col("a_unique") == 2) & (F.col("b_unique") == 2)
    ok = (
        F.when(F.col("method") == "division_interaction", (F.col("a_unique") > 2) & (F.col("b_unique") > 2) & ~F.col("b_has_zero"))
        .when(F.col("kind") == "nn", ~both_binary)
        .when(F.col("kind") == "nc", F.col("b_ratio") <= 0.30)
        .otherwise((F.col("a_ratio") <= 0.5) & (F.col("b_ratio") <= 0.5) & (F.col("joint_cardinality") <= min(0.5 * n_rows, 500)))
    )
    return rows.where(ok)


def row_family_candidates(facts: DataFrame) -> DataFrame:
    """method of each row family that applies; facts is one row (n_numeric, pct_zero, pct_missing), nulls counted as zeros."""
    ok = F.when(F.col("method") == "row_numeric_stats", F.col("n_numeric") >= 2).when(F.col("method") == "row_zero_stats", (F.col("n_numeric") >= 2) & (F.col("pct_zero") + F.col("pct_missing") > 0)).otherwise(F.col("pct_missing") > 0)
    return _methods(facts, ROW_FAMILIES).where(ok)


def feature_vector(candidates: DataFrame, features: list[str], methods: tuple[str, ...], absent: float = -999.0) -> DataFrame:
    """candidates with `features` (array): the family's features in order, absent and null ones as -999, then one place for each method."""
    values = [F.coalesce(F.col(f).cast("double"), F.lit(absent)) if f in candidates.columns else F.lit(absent) for f in features]
    return candidates.withColumn("features", F.array(*values, *((F.col("method") == m).cast("double") for m in methods)))


def pinned_row_families(s: DataFrame) -> DataFrame:
    """Row suggestions are pinned, and a negative prediction of theirs counts as 0."""
    row = F.col("type") == "row"
    return s.withColumn("pinned", row | F.coalesce("pinned", F.lit(False))).withColumn("predicted_delta_raw", F.when(row, F.greatest("predicted_delta_raw", F.lit(0.0))).otherwise(F.col("predicted_delta_raw")))


def _rows(source: DataFrame, kind: str, methods: list[tuple[str, float, bool, bool | None]]) -> DataFrame:
    """A row for each of source (column) and each method, with its fixed predicted_delta, pinned and auto_checked; nothing is predicted, so the raw delta is 0."""
    made = F.array(*(F.struct(F.lit(m).alias("method"), F.lit(d).alias("predicted_delta"), F.lit(0.0).alias("predicted_delta_raw"), F.lit(p).alias("pinned"), F.lit(c).cast("boolean").alias("auto_checked")) for m, d, p, c in methods))
    return source.select(F.lit(kind).alias("type"), "column", F.lit(None).cast("string").alias("column_b"), F.inline(made))


def date_suggestions(dates: DataFrame) -> DataFrame:
    """Of rows (column, kind): date_features, and the cyclic parts that the kind has, in their order."""
    parts = {"date": ("month", "dow", "dom"), "datetime": ("month", "dow", "dom", "hour"), "time": ("hour",)}
    each = lambda own: F.array(*(F.struct(F.lit(m).alias("method"), F.lit(x).alias("predicted_delta"), F.lit(0.0).alias("predicted_delta_raw"), F.lit(p).alias("pinned"), F.lit(p).alias("auto_checked")) for m, x, p in (("date_features", 0.50, True), *((f"date_cyclical_{part}", 0.49 - 0.001 * i, False) for i, part in enumerate(own, 1)))))
    made = reduce(lambda c, k: c.when(F.col("kind") == k, each(parts[k])), parts, F)  # dates is worked out once for all kinds
    return dates.select(F.lit("date").alias("type"), "column", F.lit(None).cast("string").alias("column_b"), F.inline(made))


def weekday_suggestions(days: DataFrame) -> DataFrame:
    return _rows(days.where("is_weekday"), "date", [("dow_ordinal", 0.50, True, True), ("dow_cyclical", 0.49, False, False)])


def text_suggestions(texts: DataFrame) -> DataFrame:
    return _rows(texts.where("is_text"), "text", [("text_stats", 0.50, True, None), ("text_tfidf", 0.50, True, None)])


def imbalance_suggestion(counts: DataFrame) -> DataFrame:
    """One pinned row, with strategy, ratio and dominant, if the largest class of (label, n) has 5 times the smallest or more; else none."""
    one = counts.agg(F.count("*").alias("k"), (F.max("n") / F.min("n")).alias("ratio"), (F.max("n") / F.sum("n")).alias("dominant"))
    strategy = F.when(F.col("k") == 2, "binary").when((F.col("ratio") > 15) | (F.col("dominant") > 0.65), "none").otherwise("multiclass_moderate")
    fixed = {"type": F.lit("imbalance"), "column": F.lit("(model parameter)"), "column_b": F.lit(None).cast("string"), "method": F.lit("class_weight_balance"), "predicted_delta": F.lit(1.0), "predicted_delta_raw": F.lit(0.0), "pinned": F.lit(True)}
    return one.where("ratio >= 5").select(*(v.alias(k) for k, v in fixed.items()), (strategy == "multiclass_moderate").alias("auto_checked"), strategy.alias("strategy"), "ratio", "dominant")


def normalised(s: DataFrame) -> DataFrame:
    """s with predicted_delta: the z-score of the raw one within its type. Dates, texts and imbalance keep their predicted_delta, pinned rows their raw one; none of these counts."""
    fixed = F.col("type").isin("date", "text", "imbalance")
    free = ~F.col("pinned") & ~fixed
    x, w = F.when(free, F.col("predicted_delta_raw")), Window.partitionBy("type")
    std = F.stddev_pop(x).over(w)
    own = F.when(fixed, F.col("predicted_delta")) if "predicted_delta" in s.columns else F.lit(None).cast("double")
    return s.withColumn("predicted_delta", F.when(free, F.when(std > 1e-9, (x - F.avg(x).over(w)) / std).otherwise(F.lit(0.0))).otherwise(F.coalesce(own, "predicted_delta_raw")))


def deduplicated(s: DataFrame) -> DataFrame:
    """The best in-place method of each (type, column), the best of each pair in any order and method; additive methods and the other types stay."""
    own = F.when(~F.col("type").isin("numerical", "categorical", "interaction") | F.col("method").isin(*ADDITIVE), F.concat_ws("|", "type", "column", F.coalesce("column_b", F.lit("")), "method"))
    pair = F.when(F.col("type") == "interaction", F.concat_ws("|", F.least("column", "column_b"), F.greatest("column", "column_b"), "method"))
    key = F.coalesce(own, pair, F.concat_ws("|", F.lit("in place"), "type", "column"))
    order = Window.partitionBy("__key").orderBy(F.desc("predicted_delta"), "method", "column", "column_b")
    return s.withColumn("__key", key).withColumn("__k", F.row_number().over(order)).where("__k = 1").drop("__key", "__k")


def recommended_top_k(n_rows: Column, n_columns: Column) -> Column:
    base = F.when(n_rows < 500, 3).when(n_rows < 2_000, 5).when(n_rows < 10_000, 8).when(n_rows < 50_000, 12).otherwise(15)
    return F.least(F.lit(20), base + F.when(n_columns > 30, 3).when(n_columns > 15, 1).otherwise(0))


def selected(s: DataFrame, k: int, threshold: float | None = None) -> DataFrame:
    """s ranked by predicted_delta, over the threshold, with auto_checked: as it is set, else within the first k and of positive raw delta."""
    own = s if threshold is None else s.where(F.col("pinned") | (F.col("predicted_delta") > threshold))
    rank = F.row_number().over(Window.orderBy(F.desc("predicted_delta"), "type", "column", "column_b", "method"))  # suggestions only
    return own.withColumn("rank", rank).withColumn("auto_checked", F.coalesce("auto_checked", (F.col("rank") <= k) & (F.col("predicted_delta_raw") > 0)))


def top_by_raw(s: DataFrame, k: int) -> DataFrame:
    return s.orderBy(F.desc("predicted_delta_raw"), "type", "column", "method").limit(k)


def with_custom(s: DataFrame, custom: DataFrame) -> DataFrame:
    """s with the user's own suggestions: one that is there already is checked instead of added."""
    key = ["type", "column", "column_b", "method"]
    c = custom.select(*(F.col(k).alias(f"c_{k}") for k in key)).distinct()
    hit = reduce(lambda x, k: x & F.col(k).eqNullSafe(F.col(f"c_{k}")), key, F.lit(True))
    marked = s.join(F.broadcast(c), hit, "left").withColumn("auto_checked", F.coalesce(F.col("auto_checked"), F.lit(False)) | F.col("c_method").isNotNull()).drop(*(f"c_{k}" for k in key))
    new = custom.select(*key).distinct().alias("n").join(s.select(*key).alias("o"), reduce(lambda x, k: x & F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")), key, F.lit(True)), "left_anti")
    return marked.unionByName(new.withColumn("auto_checked", F.lit(True)), allowMissingColumns=True)


def grouped_by_problem(s: DataFrame) -> DataFrame:
    """problem, n, best_delta, best_method."""
    problem = F.coalesce(*(F.when(F.col("method").isin(*methods), F.lit(name)) for name, methods in PROBLEMS.items()), F.lit("other"))
    return s.groupBy(problem.alias("problem")).agg(F.count("*").alias("n"), F.max("predicted_delta").alias("best_delta"), F.max(F.struct("predicted_delta", "method")).getField("method").alias("best_method"))


def summary_by_type(s: DataFrame) -> DataFrame:
    """type, evaluated, positive, best_column, best_method, best_delta."""
    best = F.max(F.struct("predicted_delta", "column", "method"))
    return s.groupBy("type").agg(F.count("*").alias("evaluated"), F.count_if(F.col("predicted_delta_raw") > 0).alias("positive"), best.getField("column").alias("best_column"), best.getField("method").alias("best_method"), best.getField("predicted_delta").alias("best_delta"))


def delta_histogram(s: DataFrame, bins: int = 30) -> DataFrame:
    """bin, low, n: how many suggestions have a predicted_delta in each of `bins` bins of equal width that isn't empty; one bin if all are alike."""
    ends = s.agg(F.min("predicted_delta").alias("lo"), F.max("predicted_delta").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col("predicted_delta") - F.col("lo")) / width))).otherwise(F.lit(0)).cast("int")
    return s.where("predicted_delta IS NOT NULL").join(F.broadcast(ends)).groupBy(place.alias("bin"), "lo", "hi").agg(F.count("*").alias("n")).select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), "n")
