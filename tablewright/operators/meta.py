"""Meta-features of a table, of its numeric and category columns, of pairs of columns and of its rows.

Single statistics of all columns come from fused aggregates. What needs the values themselves is done in long form
(column, value, label): grouped first, and windows run within a column over distinct values or bins.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import add as add_columns
from operator import mul, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import joint
from ..functions.columns import category, category_columns, corr, gathered, number, numeric_columns, present, quoted
from ..functions.quantiles import counted, counted_quantiles, quantiles

ONE_STEP, TWO_STEPS = -10.0, -20.0


def _inline(columns: list[Column], keep: list[str] = ()) -> list:
    return [*keep, F.inline(F.array(*columns))]


def long_numbers(df: DataFrame, columns: list[str], label: str | None = None) -> DataFrame:
    """column, v (double, not null) and y, the label as double."""
    y = number(label) if label else F.lit(None).cast("double")
    return df.select(y.alias("y"), F.inline(F.array(*(F.struct(F.lit(c).alias("column"), number(c).alias("v")) for c in columns)))).where("v IS NOT NULL")


def long_categories(df: DataFrame, columns: list[str], label: str | None = None) -> DataFrame:
    y = quoted(label).cast("string") if label else F.lit(None).cast("string")
    return df.select(y.alias("y"), F.inline(F.array(*(F.struct(F.lit(c).alias("column"), quoted(c).cast("string").alias("v")) for c in columns))))


# --- the whole table ---


def _absolute(df: DataFrame, pairs: list[joint.Pair]) -> DataFrame:
    """One row: total_f, most_f, total_t, most_t of the absolute correlations of pairs whose id begins with f or t, 0 where a side doesn't vary."""
    if not pairs:
        return df.sparkSession.range(1).select(*(F.lit(0.0).alias(c) for c in ("total_f", "most_f", "total_t", "most_t")))
    r = F.coalesce(F.abs("pearson"), F.lit(0.0))
    own = {k: F.when(F.col("id").startswith(k), r).otherwise(F.lit(0.0)) for k in ("f", "t")}
    return joint.correlations(df, pairs).agg(*(x for k, v in own.items() for x in (F.sum(v).alias(f"total_{k}"), F.max(v).alias(f"most_{k}"))))


def dataset_meta(df: DataFrame, label: str) -> DataFrame:
    """One row: sizes, kinds, missing ratio, class imbalance, |correlation| of features with each other (diagonal as zero) and with the label (a number)."""
    features = [c for c in df.columns if c != label]
    numeric = [c for c in numeric_columns(df, include_bool=False) if c != label]
    gone = sum((F.count_if(present(df, c).isNull()) for c in features), F.lit(0))
    row = df.agg(F.count("*").alias("n_rows"), gone.alias("gone"))
    counts = df.where(quoted(label).isNotNull()).groupBy(quoted(label)).count().agg(F.count("*").alias("n_classes"), (F.max("count") / F.min("count")).alias("class_imbalance_ratio"))
    pairs = [(f"f{i}", number(a), number(b)) for i, (a, b) in enumerate(combinations(numeric, 2))] + [(f"t{i}", number(c), number(label)) for i, c in enumerate(numeric)]
    k, n = len(numeric), len(features)
    return row.join(F.broadcast(counts)).join(F.broadcast(_absolute(df, pairs))).select(
        "n_rows", F.lit(n).alias("n_cols"), F.lit(k).alias("n_numeric_cols"), F.lit(n - k).alias("n_cat_cols"), F.lit((n - k) / max(1, n)).alias("cat_ratio"), (F.col("n_rows") / max(1, n)).alias("row_col_ratio"), "n_classes",
        (F.col("gone") / (F.col("n_rows") * max(1, n))).alias("missing_ratio"), "class_imbalance_ratio",
        (2 * F.col("total_f") / max(1, k * k)).alias("avg_feature_corr"), F.col("most_f").alias("max_feature_corr"), (F.col("total_t") / max(1, k)).alias("avg_target_corr"), F.col("most_t").alias("max_target_corr"),
    )


def row_meta(df: DataFrame, label: str | None = None) -> DataFrame:
    """One row: what the rows' numbers look like together. Medians fill nulls; every row counts. All of a row is plain expressions, worked out step by step."""
    features = [c for c in df.columns if c != label]
    numeric = [c for c in numeric_columns(df, include_bool=False) if c != label]
    k = len(numeric)
    if not k:
        return df.agg(F.lit(0).alias("n_numeric_cols_used"))
    medians = quantiles(df, {c: (0.5,) for c in numeric})
    bins, xs, ns = min(10, k), [F.col(f"x{i}") for i in range(k)], [F.col(f"n{i}") for i in range(k)]
    add = lambda parts: reduce(add_columns, parts)
    base = df.select(*(number(c).alias(f"n{i}") for i, c in enumerate(numeric)), add([present(df, c).isNull().cast("int") for c in features]).alias("gone"))
    filled = base.select("*", *(F.coalesce(ns[i], F.lit(float(medians[c][0]) if medians[c] else 0.0)).alias(f"x{i}") for i, c in enumerate(numeric)))
    ends = filled.select("*", (add(xs) / k).alias("mean"), (F.least(*xs) if k > 1 else xs[0]).alias("lo"), (F.greatest(*xs) if k > 1 else xs[0]).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    placed = ends.select("*", *(F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((x - F.col("lo")) / width))).otherwise(F.lit(bins // 2)).cast("int").alias(f"b{i}") for i, x in enumerate(xs)))
    shares = placed.select("*", *((add([(F.col(f"b{i}") == b).cast("int") for i in range(k)]) / F.lit(float(k))).alias(f"s{b}") for b in range(bins)))
    variance = add([(x - F.col("mean")) * (x - F.col("mean")) for x in xs]) / max(1, k - 1)
    h = add([F.when(F.col(f"s{b}") > 0, -F.col(f"s{b}") * F.log2(f"s{b}")).otherwise(F.lit(0.0)) for b in range(bins)])
    zeros = add([F.coalesce((x == 0).cast("int"), F.lit(0)) for x in ns])
    each = shares.select("*", h.alias("h"), variance.alias("var"), zeros.alias("zeros"))
    agg = each.agg(
        F.count("*").alias("n"), F.array(*map(F.avg, ns)).alias("means"), F.array(*map(F.stddev_samp, ns)).alias("stds"), F.array(*(F.avg(x.isNull().cast("double")) for x in ns)).alias("gone"),
        F.avg("var").alias("avg_row_variance"), F.avg((F.col("gone") > 0).cast("double")).alias("pct_rows_with_any_missing"), (F.sum("zeros") / (F.count("*") * k)).alias("pct_cells_zero"), F.avg((F.col("zeros") > 0).cast("double")).alias("pct_rows_with_any_zero"),
        F.avg("h").alias("avg_row_entropy"), F.array(*(F.max(x) - F.min(x) for x in xs)).alias("ranges"), F.sum(add(xs)).alias("s"), F.sum(add([x * x for x in xs])).alias("q"),
    )
    related = _absolute(filled, [(f"f{i}", xs[a], xs[b]) for i, (a, b) in enumerate(combinations(range(k), 2))])
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    cells = F.col("n") * k
    spread = F.sqrt(F.greatest(F.col("q") / cells - (F.col("s") / cells) * (F.col("s") / cells), F.lit(0.0)))
    return agg.join(F.broadcast(related)).select(
        F.lit(k).alias("n_numeric_cols_used"), (total("means") / k).alias("avg_numeric_mean"), (total("stds") / k).alias("avg_numeric_std"), (total("gone") / k).alias("avg_missing_pct"), F.array_max("gone").alias("max_missing_pct"),
        "avg_row_variance", "pct_rows_with_any_missing", "pct_cells_zero", "pct_rows_with_any_zero", (2 * F.col("total_f") / (k * k)).alias("numeric_col_corr_mean"), F.col("most_f").alias("numeric_col_corr_max"), "avg_row_entropy", (total("ranges") / k / (spread + 1e-8)).alias("numeric_range_ratio"),
    )


def row_gates(df: DataFrame, label: str | None = None) -> DataFrame:
    """One row of what the gates of row families look at: n_numeric, pct_zero, pct_missing, as n_numeric_cols_used, pct_cells_zero and pct_rows_with_any_missing of row_meta()."""
    numeric = [c for c in numeric_columns(df, include_bool=False) if c != label]
    gone = reduce(or_, (present(df, c).isNull() for c in df.columns if c != label))
    zeros = reduce(add_columns, (F.count_if(number(c) == 0) for c in numeric)) if numeric else F.lit(0)
    return df.agg(F.lit(len(numeric)).alias("n_numeric"), (zeros / (F.count("*") * max(1, len(numeric)))).alias("pct_zero"), F.avg(gone.cast("double")).alias("pct_missing"))


# --- numeric columns ---


def numeric_gates(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, null_pct, unique_ratio, is_binary, min_value: what the gates of numeric candidates look at, as numeric_column_meta() has it."""
    n, values = F.greatest(F.sum("n"), F.lit(1)), counted(df, {c: number(c) for c in columns})
    some = F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0))
    return values.groupBy("column").agg((1 - some / n).alias("null_pct"), (F.count("v") / n).alias("unique_ratio"), (F.count("v") == 2).cast("int").alias("is_binary"), F.min("v").alias("min_value"))


def histogram_entropy(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, entropy in bits of min(50, max(int(sqrt n), 5)) bins of equal width; 0 if all values are equal."""
    return counted_entropy(counted(df, {c: number(c) for c in columns}))


def counted_entropy(values: DataFrame) -> DataFrame:
    """histogram_entropy() of values (column, v, n)."""
    own = values.where("v IS NOT NULL")
    range_ = own.groupBy("column").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("n").alias("t"))
    bins = F.least(F.lit(50), F.greatest(F.floor(F.sqrt("t")), F.lit(5)))
    width = (F.col("hi") - F.col("lo")) / F.col("b")
    placed = own.join(F.broadcast(range_.withColumn("b", bins)), "column").select("column", F.when(width > 0, F.least(F.col("b") - 1, F.floor((F.col("v") - F.col("lo")) / width))).otherwise(F.lit(0)).alias("k"), "n")
    return _entropy(placed.groupBy("column", "k").agg(F.sum("n").alias("c")))


def _entropy_of(rows: DataFrame, value: str) -> DataFrame:
    """column, entropy in bits, from the sums of c and c log c over the counts c of its values."""
    return _entropy(rows.groupBy("column", value).agg(F.count("*").alias("c")))


def _entropy(counts: DataFrame) -> DataFrame:
    return counts.groupBy("column").agg(F.greatest(F.lit(0.0), F.log2(F.sum("c")) - F.sum(F.col("c") * F.log2("c")) / F.sum("c")).alias("entropy"))


def spearman_with_target(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """column, spearman: absolute rank correlation with the label over complete rows; 0 if there are 10 or fewer. All columns in one job, ranks by ranges of values."""
    return _spearman(joint.counts(df, [(c, number(c), number(label)) for c in columns]))


def _spearman(cells: DataFrame) -> DataFrame:
    return joint.rank_correlations(cells).select(F.col("id").alias("column"), F.when(F.col("n") > 10, F.coalesce(F.abs("spearman"), F.lit(0.0))).otherwise(F.lit(0.0)).alias("spearman"))


def binned_mutual_information(df: DataFrame, columns: list[str], label: str, bins: int = 20) -> DataFrame:
    """column, mi: mutual information, in nats, of quantile bins and the label over complete rows. Rows are counted once by (column, value, label)."""
    cells = gathered(counted(df, {c: number(c) for c in columns}, quoted(label).cast("string")))
    try:
        return kept(_counted_information(cells, columns, bins))
    finally:
        cells.unpersist()


def _counted_information(cells: DataFrame, columns: list[str], bins: int = 20) -> DataFrame:
    """column, mi of cells (column, v, y, n), y as text; bins are those of all values, with or without a label."""
    values = cells.groupBy("column", "v").agg(F.sum("n").alias("n"))
    placed = binned(cells.where("v IS NOT NULL AND y IS NOT NULL"), bin_edges(values, columns, bins))
    return joint.information(placed.groupBy(F.col("column").alias("id"), F.col("bin").alias("x"), "y").agg(F.sum("n").alias("c"))).select(F.col("id").alias("column"), "mi")


def bin_edges(values: DataFrame, columns: list[str], bins: int) -> dict[str, list[float]]:
    """The distinct edges of the quantile bins of each column of values (column, v, n)."""
    found = counted_quantiles(values, {c: tuple(i / bins for i in range(1, bins)) for c in columns})
    return {c: sorted(set(map(float, found[c] or []))) for c in columns}


def binned(values: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """values (column, v ..) with bin: how many of its column's edges are below v."""
    known = values.sparkSession.createDataFrame(list(edges.items()), "column string, __edges array<double>")
    return values.join(F.broadcast(known), "column").withColumn("bin", F.size(F.filter("__edges", lambda e: F.col("v") > e))).drop("__edges")


def kept(found: DataFrame) -> DataFrame:
    """The rows of found, one for each column or pair, worked out now."""
    return found.sparkSession.createDataFrame(found.collect(), found.schema)


def mutual_information(rows: DataFrame) -> DataFrame:
    """column, mi in nats of rows (column, v, y), from contingency counts."""
    cells = rows.groupBy(F.col("column").alias("id"), F.col("v").alias("x"), "y").agg(F.count("*").alias("c"))
    return joint.information(cells).select(F.col("id").alias("column"), "mi")


def moments(values: DataFrame) -> DataFrame:
    """column, n_rows, n, n_unique, lo, hi, mean, std, skewness, kurtosis_val (null where nothing varies), var of values (column, v, n), a null v for rows without a value."""
    v, n = F.col("v"), F.when(F.col("v").isNotNull(), F.col("n"))
    first = values.groupBy("column").agg(F.sum("n").alias("n_rows"), F.coalesce(F.sum(n), F.lit(0)).alias("total"), F.count("v").alias("n_unique"), F.min("v").alias("lo"), F.max("v").alias("hi"), (F.sum(n * v) / F.sum(n)).alias("mean"))
    d = v - F.col("mean")
    power = [F.sum(n * reduce(mul, [d] * k)).alias(f"m{k}") for k in (2, 3, 4)]
    sums = values.join(F.broadcast(first.select("column", "mean")), "column").groupBy("column").agg(*power)  # a row for each column on the right
    varies = (F.col("hi") > F.col("lo")) & (F.col("m2") > 0)
    var = F.when(F.col("total") > 0, F.when(varies, F.col("m2") / F.col("total")).otherwise(F.lit(0.0)))
    return first.join(F.broadcast(sums), "column").select(
        "column", "n_rows", F.col("total").alias("n"), "n_unique", "lo", "hi", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("mean")).alias("mean"), F.when(F.col("total") > 1, F.sqrt(var * F.col("total") / (F.col("total") - 1))).alias("std"), var.alias("var"),
        F.when(varies, F.col("m3") / F.col("total") / F.pow(var, F.lit(1.5))).alias("skewness"), F.when(varies, F.col("m4") / F.col("total") / (var * var) - 3).alias("kurtosis_val"),
    )


def numeric_column_meta(df: DataFrame, columns: list[str], label: str, with_mi: bool = False) -> DataFrame:
    """A row for each numeric column with the features of a column's distribution and of its relation to the label.

    Columns of fewer than 5 values get null shape features. Normality is the Jarque-Bera p-value. Rows are counted once by
    (column, value, label), and all features come from these counts; the row of each column is worked out at once.
    """
    cells = gathered(counted(df, {c: number(c) for c in columns}, quoted(label)))
    try:
        return kept(_counted_meta(cells, columns, with_mi))
    finally:
        cells.unpersist()


def _counted_meta(cells: DataFrame, columns: list[str], with_mi: bool) -> DataFrame:
    values = cells.groupBy("column", "v").agg(F.sum("n").alias("n"))
    quartiles = {c: q or (0.0, 0.0) for c, q in counted_quantiles(values, {c: (0.25, 0.75) for c in columns}).items()}
    reach = values.sparkSession.createDataFrame([(c, float(q3 - q1), float(q1 - 1.5 * (q3 - q1)), float(q3 + 1.5 * (q3 - q1))) for c, (q1, q3) in quartiles.items()], "column string, iqr double, low double, high double")
    share = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)) / F.greatest(F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)), F.lit(1))
    v = F.col("v")
    shares = values.join(F.broadcast(reach), "column").groupBy("column", "iqr").agg(share((v < F.col("low")) | (v > F.col("high"))).alias("outlier_ratio"), share(v == 0).alias("zeros_ratio"), share(v < 0).alias("pct_negative"), share((v >= 0) & (v <= 1)).alias("pct_in_0_1_range"))
    stats = moments(values).join(F.broadcast(shares), "column")
    s, k = F.coalesce("skewness", F.lit(0.0)), F.coalesce("kurtosis_val", F.lit(0.0))
    out = stats.select(
        "column", (1 - F.col("n") / F.greatest("n_rows", F.lit(1))).alias("null_pct"), (F.col("n_unique") / F.greatest("n_rows", F.lit(1))).alias("unique_ratio"), (F.col("n_unique") == 2).cast("int").alias("is_binary"), "outlier_ratio",
        F.when(F.col("iqr") > 0, (F.col("hi") - F.col("lo")) / F.col("iqr")).otherwise(F.lit(1.0)).alias("range_iqr_ratio"), s.alias("skewness"), k.alias("kurtosis_val"),
        F.when(F.abs("mean") > 1e-10, F.coalesce("std", F.lit(0.0)) / F.abs("mean")).otherwise(F.lit(0.0)).alias("coeff_variation"), "zeros_ratio", "pct_negative", "pct_in_0_1_range",
        F.exp(-F.col("n") / 6 * (s * s + k * k / 4) / 2).alias("normality_p_value"), ((s * s + 1) / (k + 3)).alias("bimodality_coefficient"),
    )
    target = cells.select(F.col("column").alias("id"), F.col("v").alias("x"), number("y").alias("y"), F.col("n").alias("c")).where("x IS NOT NULL AND y IS NOT NULL").groupBy("id", "x", "y").agg(F.sum("c").alias("c"))
    out = out.join(F.broadcast(counted_entropy(values)), "column", "left").join(F.broadcast(_spearman(target).withColumnRenamed("spearman", "spearman_corr_target")), "column", "left")
    out = out.fillna(0.0, ["entropy", "spearman_corr_target"])
    if not with_mi:
        return out
    told = _counted_information(cells.select("column", "v", F.col("y").cast("string").alias("y"), "n"), columns)
    return out.join(F.broadcast(told.withColumnRenamed("mi", "mutual_info_score")), "column", "left")


# --- category columns ---


def categorical_column_meta(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """A row for each category column: cardinality, dominance, entropy, entropy of the label given the value, mutual information."""
    cells = long_categories(df, columns, label).groupBy("column", "v", "y").agg(F.count("*").alias("c"))
    values = cells.groupBy("column", "v").agg(F.sum("c").alias("n"))
    rows = values.groupBy("column").agg(F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("n_null"))
    known = values.where("v IS NOT NULL")
    own = known.join(F.broadcast(known.groupBy("column").agg(F.sum("n").alias("t"))), "column").withColumn("p", F.col("n") / F.col("t"))  # a row for each column
    # only the first three of a column leave a task
    first = own.withColumn("k", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "v"))).where("k <= 3").groupBy("column").agg(F.sum("p").alias("top3_category_concentration"))
    shape = own.groupBy("column").agg(
        F.count("*").alias("n_unique"), F.max("p").alias("top_category_dominance"), F.avg((F.col("p") < 0.01).cast("double")).alias("rare_category_pct"), F.sum(-F.col("p") * F.log2("p")).alias("entropy"),
    ).join(F.broadcast(first), "column", "left")
    inner = cells.where("v IS NOT NULL AND y IS NOT NULL").withColumn("t", F.sum("c").over(Window.partitionBy("column", "v")))
    h = inner.groupBy("column", "v").agg(F.max("t").alias("t"), F.sum(-F.col("c") / F.col("t") * F.log2(F.col("c") / F.col("t"))).alias("h"))
    conditional = h.join(F.broadcast(rows.select("column", "n_rows")), "column").groupBy("column").agg(F.sum(F.col("t") / F.col("n_rows") * F.col("h")).alias("conditional_entropy"))
    told = joint.information(cells.where("v IS NOT NULL AND y IS NOT NULL").select(F.col("column").alias("id"), F.col("v").alias("x"), "y", "c"))
    mi = told.select(F.col("id").alias("column"), F.col("mi").alias("mutual_info_score"))
    every = rows.join(shape, "column", "left").join(conditional, "column", "left").join(mi, "column", "left").fillna(0)
    u = F.col("n_unique")
    return every.select(
        "column", (F.col("n_null") / F.col("n_rows")).alias("null_pct"), "n_unique", (u / F.col("n_rows")).alias("unique_ratio"), (u <= 2).cast("int").alias("is_binary"), (u <= 10).cast("int").alias("is_low_cardinality"), (u > 50).cast("int").alias("is_high_cardinality"),
        F.when(u > 0, F.col("top_category_dominance")).otherwise(F.lit(1.0)).alias("top_category_dominance"), F.when(u > 0, F.col("top3_category_concentration")).otherwise(F.lit(1.0)).alias("top3_category_concentration"), "rare_category_pct", "entropy",
        (F.col("entropy") / F.log2(F.greatest(u, F.lit(2)))).alias("normalized_entropy"), "conditional_entropy", "mutual_info_score",
    )


# --- pairs of columns ---


def numeric_pair_meta(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """a, b, and what two numeric columns have in common, of all pairs in one aggregate. Category features carry ONE_STEP or TWO_STEPS."""

    def measures(a, b):
        x, y = number(a), number(b)
        both = F.count_if(x.isNotNull() & y.isNotNull())
        mx, my, sx, sy = F.avg(x), F.avg(y), F.stddev_samp(x), F.stddev_samp(y)
        least, most = F.least(sx, sy), F.greatest(sx, sy)
        cv = lambda m, s: F.when(F.abs(m) > 1e-10, s / F.abs(m)).otherwise(F.lit(0.0))
        kx, ky = F.coalesce(F.skewness(x), F.lit(0.0)), F.coalesce(F.skewness(y), F.lit(0.0))
        n = F.greatest(F.count("*"), F.lit(1))
        ux, uy = F.count_distinct(x) / n, F.count_distinct(y) / n
        gx, gy = 1 - F.count(x) / n, 1 - F.count(y) / n
        return F.struct(
            F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(2).alias("n_numerical_cols"), F.when(both > 10, F.coalesce(F.abs(corr(x, y)), F.lit(0.0))).otherwise(F.lit(0.0)).alias("pearson_corr"), F.when(least > 1e-10, most / least).otherwise(F.lit(0.0)).alias("scale_ratio"),
            (gx + gy).alias("sum_null_pct"), F.greatest(gx, gy).alias("max_null_pct"), (ux + uy).alias("sum_unique_ratio"), F.abs(ux - uy).alias("abs_diff_unique_ratio"), ((F.count_distinct(x) == 2) & (F.count_distinct(y) == 2)).cast("int").alias("both_binary"),
            (mx * my).alias("product_of_means"), F.when(F.abs(my) > 1e-10, F.abs(mx / my)).otherwise(F.lit(0.0)).alias("abs_mean_ratio"), (cv(mx, sx) + cv(my, sy)).alias("sum_cv"), F.abs(cv(mx, sx) - cv(my, sy)).alias("abs_diff_cv"), (kx + ky).alias("sum_skewness"), F.abs(kx - ky).alias("abs_diff_skewness"),
            (F.signum(mx) == F.signum(my)).cast("int").alias("sign_concordance"), ((mx > 0).cast("int") + (my > 0).cast("int")).alias("n_positive_means"), F.lit(ONE_STEP).alias("eta_squared"), F.lit(TWO_STEPS).alias("cramers_v"),
        )

    return df.agg(*(measures(a, b).alias(f"__{i}") for i, (a, b) in enumerate(pairs))).select(F.inline(F.array(*(F.col(f"__{i}") for i in range(len(pairs))))))


def pair_spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """spearman_corr of two numeric columns, absolute, over complete rows; 0 if there are 10 or fewer."""
    found = joint.rank_correlations(joint.counts(df, [("p", number(a), number(b))]))
    return found.select(F.when(F.col("n") > 10, F.coalesce(F.abs("spearman"), F.lit(0.0))).otherwise(F.lit(0.0)).alias("spearman_corr"))


def mic_score(df: DataFrame, a: str, b: str) -> DataFrame:
    """mic_score: min(MI in nats / entropy of b in bits, 1) over quantile bins after median fill; the units are the definition's."""
    from .pairs import coded  # it builds on this module

    own, codes = coded(df, [a, b])
    found = joint.information(joint.counts(own, [("p", codes[a], codes[b])]))
    return found.select(F.when(F.col("entropy_y") > 0, F.least(F.col("mi") / F.col("entropy_y"), F.lit(1.0))).otherwise(F.lit(0.0)).alias("mic_score"))


def mixed_pair_meta(df: DataFrame, num: str, cat: str) -> DataFrame:
    """eta_squared, n_groups and anova_f_stat of a numeric column grouped by a category column. Sums of each group are all that meets."""
    groups = df.where(quoted(cat).isNotNull() & number(num).isNotNull()).groupBy(quoted(cat).cast("string").alias("g")).agg(F.count("*").alias("n"), F.avg(number(num)).alias("m"), F.var_pop(number(num)).alias("v"))
    total = groups.agg(F.sum("n").alias("tn"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("tm"))
    d = F.col("m") - F.col("tm")
    some = F.col("n") > 1
    big = groups.where("n > 1").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("bm"))
    e = F.col("m") - F.col("bm")
    sums = groups.join(F.broadcast(total)).join(F.broadcast(big)).agg(
        F.count("*").alias("k"), F.sum(F.col("n") * d * d).alias("between"), F.sum(F.col("n") * F.col("v")).alias("within"), F.count_if(some).alias("bk"), F.sum(F.when(some, F.col("n"))).alias("bn"), F.sum(F.when(some, F.col("n") * e * e)).alias("bb"), F.sum(F.when(some, F.col("n") * F.col("v"))).alias("bw"),
    )
    f = (F.col("bb") / (F.col("bk") - 1)) / (F.col("bw") / (F.col("bn") - F.col("bk")))
    return sums.select((F.col("between") / (F.col("between") + F.col("within") + 1e-10)).alias("eta_squared"), F.col("k").alias("n_groups"), F.when((F.col("bk") >= 2) & (F.col("bn") > F.col("bk")) & (F.col("bw") > 0), f).otherwise(F.lit(0.0)).alias("anova_f_stat"))


def category_pair_meta(df: DataFrame, a: str, b: str) -> DataFrame:
    """cramers_v (Yates' correction on 2 x 2), joint_cardinality, cardinality_ratio, joint_sparsity. Null is the category nan in the crosstab."""
    cells = df.groupBy(category(a).alias("a"), category(b).alias("b")).agg(F.count("*").alias("c"), F.count(quoted(a)).alias("ha"), F.count(quoted(b)).alias("hb"))
    over = lambda *k: F.sum("c").over(Window.partitionBy(*(k or [F.lit(0)])))
    rows = cells.groupBy("a").agg(F.sum("c").alias("ra"), F.max((F.col("ha") > 0).cast("int")).alias("na"))
    cols = cells.groupBy("b").agg(F.sum("c").alias("rb"), F.max((F.col("hb") > 0).cast("int")).alias("nb"))
    n = rows.agg(F.sum("ra").alias("n"), F.count("*").alias("ka"), F.sum(F.col("ra") * F.col("ra")).alias("__"), F.sum("na").alias("ua"))
    m = cols.agg(F.count("*").alias("kb"), F.sum("nb").alias("ub"))
    # cells that don't occur add their expectation: sum over all cells of e is n, so chi2 = sum(c^2 / e) - n
    seen = cells.join(rows, "a").join(cols, "b").join(F.broadcast(n)).join(F.broadcast(m))
    e = F.col("ra") * F.col("rb") / F.col("n")
    gap = F.abs(F.col("c") - e)
    yates = F.greatest(F.lit(0.0), gap - F.least(F.lit(0.5), gap))
    sums = seen.agg(F.count("*").alias("observed"), F.sum(F.col("c") * F.col("c") / e).alias("s"), F.sum(yates * yates / e).alias("y"), F.max("n").alias("n"), F.max("ka").alias("ka"), F.max("kb").alias("kb"), F.max("ua").alias("ua"), F.max("ub").alias("ub"), F.sum(e).alias("es"), F.max(F.least(F.lit(0.5), gap)).alias("adj"))
    # of a 2 x 2 table every gap is alike; absent cells have e as gap
    absent = F.when(F.col("observed") < 4, F.col("n") - F.col("es")).otherwise(F.lit(0.0))
    two = (F.col("ka") == 2) & (F.col("kb") == 2)
    chi = F.when(two, F.col("y") + absent).otherwise(F.greatest(F.lit(0.0), F.col("s") - F.col("n")))
    k = F.least("ka", "kb") - 1
    return sums.select(
        F.when(k > 0, F.least(F.lit(1.0), F.sqrt(chi / (F.col("n") * k)))).otherwise(F.lit(0.0)).alias("cramers_v"), F.col("observed").alias("joint_cardinality"), (F.least("ua", "ub") / F.greatest(F.greatest("ua", "ub"), F.lit(1))).alias("cardinality_ratio"), (1 - F.col("observed") / F.greatest(F.col("ua") * F.col("ub"), F.lit(1))).alias("joint_sparsity"),
    )


def importance_ranks(importances: DataFrame) -> DataFrame:
    """column, importance, importance_rank_pct: average rank from the most important down, over the number of columns."""
    n = F.count("*").over(Window.partitionBy(F.lit(0)))
    w = Window.orderBy(F.desc("importance"))  # a row for each column of the table
    same = F.count("*").over(Window.partitionBy("importance"))
    return importances.select("column", "importance", ((F.rank().over(w) + (same - 1) / 2) / n).alias("importance_rank_pct"))
