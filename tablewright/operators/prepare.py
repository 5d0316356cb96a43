"""Target and row preparation: encoding, class filters and weights, splits, folds, samples, alignment of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import category, gathered, hinted, md5fold, number, numeric_columns, quoted


def encode_target(df: DataFrame, label: str, to: str = "label") -> DataFrame:
    """df with `to`: a numeric target as double; any other by its place, from 0, among the sorted distinct values (null: null)."""
    if label in numeric_columns(df):
        return df.withColumn(to, number(label))
    names = df.select(quoted(label).cast("string").alias("__v")).where("__v IS NOT NULL").distinct()
    codes = names.withColumn("__code", (F.dense_rank().over(Window.orderBy("__v")) - 1).cast("double"))  # over distinct labels only
    return df.join(hinted(codes), quoted(label).cast("string") == F.col("__v"), "left").withColumn(to, F.col("__code")).drop("__v", "__code")


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.where(quoted(label).isNotNull()).groupBy(quoted(label).alias(label)).agg(F.count("*").alias("n"))


def filter_rare_classes(df: DataFrame, label: str, folds: int, repeats: int) -> DataFrame:
    """Rows of classes that have at least folds x repeats + 1 rows."""
    kept = class_counts(df, label).where(F.col("n") >= folds * repeats + 1).select(F.col(label).alias("__kept"))
    return df.join(hinted(kept), quoted(label) == F.col("__kept"), "left_semi")


def scale_pos_weight(df: DataFrame, label: str) -> DataFrame:
    """scale_pos_weight: larger class over smaller one if there are two, else 1."""
    n = class_counts(df, label).agg(F.count("*").alias("k"), F.max("n").alias("most"), F.min("n").alias("least"))
    return n.select(F.when(F.col("k") == 2, F.col("most") / F.col("least")).otherwise(F.lit(1.0)).alias("scale_pos_weight"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """label, n, weight: balanced weights n_all / (classes x n)."""
    n = class_counts(df, label)
    total = n.agg(F.sum("n").alias("__all"), F.count("*").alias("__k"))
    return n.join(F.broadcast(total)).select(label, "n", (F.col("__all") / (F.col("__k") * F.col("n"))).alias("weight"))


def with_class_weight(df: DataFrame, label: str, to: str = "weight") -> DataFrame:
    w = class_weights(df, label).select(F.col(label).alias("__class"), F.col("weight").alias(to))
    return df.join(F.broadcast(w), quoted(label) == F.col("__class"), "left").drop("__class")


def stratified_split(df: DataFrame, label: str, key: str, test_fold: int = 4, folds: int = 5) -> DataFrame:
    """df with is_test: one fold in `folds` by the key's hash, which is the same share of every class and needs no shuffle."""
    return df.withColumn("is_test", md5fold(quoted(key), folds) == test_fold)


def _first_by_hash(df: DataFrame, label: str | None, key: str, quota: DataFrame) -> DataFrame:
    """df with __in: of each class in quota (label, quota), the rows whose key's md5 is smallest, then by key, as many as its quota.

    Rows are counted by class and the first digits of the hash; that decides all but the one group of each class in which the quota
    ends, so only that group is put in order.
    """
    digits = F.substring(F.md5(quoted(key).cast("string")), 1, 3)
    rows = df.withColumn("__class", quoted(label).cast("string") if label else F.lit("")).withColumn("__digits", digits)
    counts = rows.groupBy("__class", "__digits").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("__class").orderBy("__digits").rowsBetween(Window.unboundedPreceding, 0))  # 4096 rows a class at most
    own = counts.withColumn("upto", upto).join(F.broadcast(quota), F.col("__class").eqNullSafe(F.col("label")))
    ends = own.where(F.col("upto") >= F.col("quota")).groupBy("__class").agg(F.min(F.struct("__digits", (F.col("quota") - F.col("upto") + F.col("n")).alias("rest"))).alias("e"))
    ends = ends.select(F.col("__class").alias("__at"), F.col("e.__digits").alias("__end"), F.col("e.rest").alias("__rest"))
    told = rows.join(hinted(ends), F.col("__class").eqNullSafe(F.col("__at")), "left")
    order = Window.partitionBy("__class").orderBy(F.md5(quoted(key).cast("string")), quoted(key))
    last = F.col("__digits") == F.col("__end")
    tied = told.where(last).withColumn("__in", F.row_number().over(order) <= F.col("__rest"))
    sure = told.where(~F.coalesce(last, F.lit(False))).withColumn("__in", F.coalesce(F.col("__digits") < F.col("__end"), F.lit(False)))
    return sure.unionByName(tied).drop("__class", "__digits", "__at", "__end", "__rest")


def exact_stratified_split(df: DataFrame, label: str, key: str, share: float = 0.2) -> DataFrame:
    """df with is_test: of each class with two rows or more, the floor(share x n) rows whose key's hash is smallest (the key decides ties)."""
    counts = df.groupBy(quoted(label).cast("string").alias("label")).agg(F.count("*").alias("n"))
    return _first_by_hash(df, label, key, counts.select("label", F.when(F.col("n") >= 2, F.floor(F.col("n") * share)).otherwise(F.lit(0)).alias("quota"))).withColumnRenamed("__in", "is_test")


def quick_sample(df: DataFrame, label: str, key: str) -> DataFrame:
    """Exactly min(20000, max(2000, n/10)) rows, each class with its share, those whose key's hash is smallest; all rows if there are fewer.

    Classes get the whole part of their share; those with the largest rest (then by name) one more, until the size is reached.
    """
    counts = df.groupBy(quoted(label).cast("string").alias("label")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    size = min(20_000, max(2_000, total // 10))
    if total <= size:
        return df
    whole = F.expr(f"n * {size}L div {total}L")
    each = counts.withColumn("whole", whole).withColumn("rest", F.col("n") * size - F.col("whole") * total)
    missing = F.lit(size) - F.sum("whole").over(Window.partitionBy(F.lit(0)))  # a row for each class
    extra = F.row_number().over(Window.orderBy(F.desc("rest"), "label")) <= missing
    return _first_by_hash(df, label, key, each.select("label", (F.col("whole") + extra.cast("long")).alias("quota"))).where("__in").drop("__in")


def cap_cells(df: DataFrame, key: str, max_cells: int = 100_000_000) -> DataFrame:
    """The max_cells / columns rows whose key's hash is smallest; all rows if there are no more."""
    size = max_cells // max(1, len(df.columns))
    if df.count() <= size:
        return df
    quota = df.sparkSession.range(1).select(F.lit("").alias("label"), F.lit(size).cast("long").alias("quota"))
    return _first_by_hash(df, None, key, quota).where("__in").drop("__in")


def repeated_folds(df: DataFrame, key: str, folds: int = 5, repeats: int = 3) -> DataFrame:
    """df with fold_0, fold_1 ..: an independent fold of each row for each repeat, by hashes."""
    return df.withColumns({f"fold_{r}": md5fold(quoted(key), folds, f"r{r}:") for r in range(repeats)})


def counted_rows(df: DataFrame, n: str, counted: bool = True) -> DataFrame:
    """df with n (double), how many rows are alike, and these once; or every row by itself with n = 1."""
    return df.groupBy(*map(quoted, df.columns)).agg(F.count("*").cast("double").alias(n)) if counted else df.withColumn(n, F.lit(1.0))


def group_folds(df: DataFrame, group: str, folds: int = 5) -> DataFrame:
    """df with fold: the same for all rows of a group."""
    return df.withColumn("fold", md5fold(category(group), folds, "g:"))


def unseen_labels(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """label, n: labels of test, with their rows, that train hasn't."""
    return class_counts(test, label).join(hinted(class_counts(train, label).select(label)), label, "left_anti")


def aligned(test: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str], list[str]]:
    """test with just those columns, absent ones as 0; the absent and the dropped ones."""
    absent = [c for c in columns if c not in test.columns]
    dropped = [c for c in test.columns if c not in columns]
    return test.select(*(quoted(c) if c in test.columns else F.lit(0.0).alias(c) for c in columns)), absent, dropped


def task_types(df: DataFrame, columns: list[str]) -> DataFrame:
    """target, task: what each column would be as a target, from one pass of aggregates."""
    numeric = set(numeric_columns(df))
    rows = [F.struct(F.lit(c).alias("target"), F.lit(c in numeric).alias("num"), F.count_distinct(quoted(c)).alias("k"), F.count(quoted(c)).alias("n"), F.coalesce(F.max(number(c) % 1 != 0), F.lit(False)).alias("broken") if c in numeric else F.lit(False).alias("broken")).alias(f"__{i}") for i, c in enumerate(columns)]
    one = df.agg(*rows).select(F.inline(F.array(*(F.col(f"__{i}") for i in range(len(columns))))))
    share = F.col("k") / F.greatest(F.col("n"), F.lit(1))
    task = F.when(~F.col("num") | (F.col("k") <= 2), "classification").when(F.col("broken") & (F.col("k") > 20), "regression").when((share < 0.05) | ((F.col("k") <= 200) & (share < 0.10)), "classification").otherwise("regression")
    return one.select("target", task.alias("task"))


def usable(df: DataFrame, label: str, folds: int = 5, repeats: int = 3) -> DataFrame:
    """n_rows, n_columns, usable: 500 rows and 2 columns are left after the filter of rare classes."""
    n = filter_rare_classes(df, label, folds, repeats).agg(F.count("*").alias("n_rows"))
    return n.select("n_rows", F.lit(len(df.columns) - 1).alias("n_columns"), ((F.col("n_rows") >= 500) & F.lit(len(df.columns) - 1 >= 2)).alias("usable"))


def as_text(df: DataFrame) -> DataFrame:
    """Dates and timestamps as ISO text, the form in which date detection gets them."""
    dates = {f.name: F.date_format(quoted(f.name), "yyyy-MM-dd HH:mm:ss") for f in df.schema if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))}
    return df.withColumns(dates)
