"""Profiling: one fused aggregate for all columns, one row for each column in the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import category_columns, corr, number, numeric_columns, present, quoted
from ..functions.dates import counted_texts, parsed_date
from ..functions.quantiles import counted, quantiles

# Names that mark an ID, weekday names and thresholds.
ID_NAMES = ("id", "idx", "index", "key", "no", "num", "number", "row", "#")
ID_PARTS = ("_id", "id_", "_idx", "idx_", "_index", "index_", "_key", "key_", "_no", "_num", "_number", "rownum", "row_num", "record_id", "sample_id", "obs_id", "entry_id")
#: Of the collectors: names, and an ending.
COLLECTED_IDS, COLLECTED_END = ("id", "index", "row_num", "record_id", "pk", "key"), "_id"
WEEKDAYS = {name: i for i, names in enumerate((("monday", "mon", "mo"), ("tuesday", "tue", "tu"), ("wednesday", "wed", "we"), ("thursday", "thu", "th"), ("friday", "fri", "fr"), ("saturday", "sat", "sa"), ("sunday", "sun", "su"))) for name in names}
SMALL_PARAMS = {"num_leaves": 15.0, "min_child_samples": 30.0, "reg_alpha": 0.1, "reg_lambda": 0.1, "subsample": 0.7, "colsample_bytree": 0.7}
WIDE_PARAMS = {"colsample_bytree": 0.5, "reg_alpha": 0.5, "min_child_samples": 20.0}
#: Distinct counts and other aggregates of so many columns go in one pass.
FUSED = 40


def _one_row_each(df: DataFrame, columns: list[str], measures) -> DataFrame:
    """measures(column): named aggregates; a row for each column, in passes of FUSED columns."""
    parts = []
    for i in range(0, len(columns), FUSED):
        own = columns[i : i + FUSED]
        row = df.agg(*(F.struct(F.lit(c).alias("column"), *measures(c)).alias(f"__{k}") for k, c in enumerate(own)))
        parts.append(row.select(F.inline(F.array(*(F.col(f"__{k}") for k in range(len(own)))))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _identity(df: DataFrame, name: str) -> Column:
    """The column as text that differs exactly where values do."""
    kind, x = df.schema[name].dataType, present(df, name)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return (x + 0.0).cast("string")  # -0.0 is 0.0
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(x.cast("timestamp")).cast("string")
    if isinstance(kind, T.BinaryType):
        return F.hex(x)
    return F.to_json(F.struct(x.alias("v"))) if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)) else x.cast("string")


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n_unique of the values that aren't null, from the distinct (column, value)."""
    values = F.array(*(F.struct(F.lit(c).alias("column"), _identity(df, c).alias("v")) for c in columns))
    return df.select(F.inline(values)).distinct().groupBy("column").agg(F.count("v").alias("n_unique"))


def base_stats(df: DataFrame, columns: list[str] | None = None, approx: bool = False) -> DataFrame:
    """column, numeric, n_rows, n_unique, n_missing, missing, unique_ratio, sample (the smallest value as text, 50 characters)."""
    numeric, columns = set(numeric_columns(df)), columns or df.columns

    def measures(c):
        x = present(df, c)
        more = [F.approx_count_distinct(x).alias("n_unique")] if approx else []
        return F.lit(c in numeric).alias("numeric"), F.count("*").alias("n_rows"), F.count_if(x.isNull()).alias("n_missing"), F.substring(F.min(x).cast("string"), 1, 50).alias("sample"), *more

    found = _one_row_each(df, columns, measures)
    if not approx:  # a row for each column on the right
        found = found.join(F.broadcast(distinct_counts(df, columns)), "column", "left").withColumn("n_unique", F.coalesce("n_unique", F.lit(0).cast("long")))
    n = F.greatest(F.col("n_rows"), F.lit(1))
    return found.select("column", "numeric", "n_rows", "n_unique", "n_missing", (F.col("n_missing") / n).alias("missing"), (F.col("n_unique") / n).alias("unique_ratio"), "sample")


def simple_problems(stats: DataFrame) -> DataFrame:
    """column, problem of base_stats rows: constant, high_missing, binary."""
    constant = F.when(F.col("n_unique") == 0, "constant: all missing").when(F.col("n_unique") == 1, "constant: one value")
    high = F.when(F.col("missing") > 0.5, "high_missing")
    binary = F.when(F.col("numeric") & (F.col("n_unique") == 2), "binary")
    return stats.select("column", F.explode(F.array_compact(F.array(constant, high, binary))).alias("problem"))


def text_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, n, n_unique, mean_length, is_text of the string columns: 5 values, mean length over 30, distinct share over 0.1."""

    def measures(c):
        x = quoted(c).cast("string")
        return F.count(x).alias("n"), F.count_distinct(x).alias("n_unique"), F.avg(F.length(x)).alias("mean_length")

    found = _one_row_each(df, columns or category_columns(df), measures)
    return found.withColumn("is_text", (F.col("n") >= 5) & (F.col("mean_length") > 30) & (F.col("n_unique") > 0.10 * F.col("n")))


def date_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, n, parse_rate, hour_share, n_days, has_hour, kind (time, datetime, date, or null) of the string columns."""

    columns = columns or category_columns(df)
    # a text is read once, however often it stands in its column; days are counted by (column, day)
    texts = counted_texts(df, columns).select("column", "n", F.col("text").isNotNull().alias("known"), parsed_date(F.col("text")).alias("t"))
    days = texts.groupBy("column", F.to_date("t").alias("day")).agg(F.sum(F.when(F.col("known"), F.col("n"))).alias("n"), F.sum(F.when(F.col("t").isNotNull(), F.col("n"))).alias("parsed"), F.sum(F.when(F.hour("t") != 0, F.col("n"))).alias("with_hour"))
    sums = days.groupBy("column").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "parsed", "with_hour")), F.count("day").alias("n_days"))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")  # also those of a table without rows
    found = names.join(F.broadcast(sums), "column", "left").fillna(0)
    parse_rate, hours = F.col("parsed") / F.greatest(F.col("n"), F.lit(1)), F.col("with_hour") / F.greatest(F.col("parsed"), F.lit(1))
    has_hour = hours >= 0.20
    has_date = F.col("n_days") >= F.greatest(F.lit(3), F.floor(0.02 * F.col("n")))
    kind = F.when((F.col("n") < 5) | (parse_rate < 0.70), F.lit(None)).when(has_hour & ~has_date, "time").when(has_hour, "datetime").otherwise("date")
    return found.select("column", "n", parse_rate.alias("parse_rate"), hours.alias("hour_share"), "n_days", has_hour.alias("has_hour"), kind.alias("kind"))


def weekday_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, n, recognised, is_weekday: every distinct value, trimmed and in lower case, names a weekday; 3 rows at least."""

    def measures(c):
        known = F.lower(F.trim(quoted(c).cast("string"))).isin(*WEEKDAYS)
        return F.count(quoted(c)).alias("n"), F.avg(known.cast("double")).alias("recognised"), F.min(known).alias("every")

    found = _one_row_each(df, columns or category_columns(df), measures)
    return found.select("column", "n", F.coalesce("recognised", F.lit(0.0)).alias("recognised"), F.coalesce((F.col("n") >= 3) & F.col("every") & (F.col("recognised") >= 0.8), F.lit(False)).alias("is_weekday"))


def order_flags(df: DataFrame, columns: list[str], order_by: str) -> DataFrame:
    """column, rising, falling: whether the values of each numeric column rise (fall) strictly in the order of order_by.

    Rows are compared within ranges of order_by and at the ranges' borders, so no task sorts the whole table.
    """
    long = df.select(quoted(order_by).alias("__o"), F.explode(F.array(*(F.struct(F.lit(c).alias("column"), number(c).alias("v")) for c in columns))).alias("__s")).select("__o", "__s.*").where("v IS NOT NULL")
    parts = long.repartitionByRange(F.col("column"), F.col("__o")).withColumn("__p", F.spark_partition_id())
    own = Window.partitionBy("column", "__p").orderBy("__o")
    steps = parts.withColumn("d", F.col("v") - F.lag("v").over(own))
    each = steps.groupBy("column", "__p").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.min_by("v", "__o").alias("first"), F.max_by("v", "__o").alias("last"), F.min("__o").alias("at"), F.count("*").alias("n"))
    border = F.col("first") - F.lag("last").over(Window.partitionBy("column").orderBy("at"))
    both = each.withColumn("b", border)
    rising = (F.coalesce(F.least(F.min("lo"), F.min("b")), F.lit(1.0)) > 0).alias("rising")
    falling = (F.coalesce(F.greatest(F.max("hi"), F.max("b")), F.lit(-1.0)) < 0).alias("falling")
    return both.groupBy("column").agg(rising, falling)


def step_variation(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, cv: population deviation of the sorted distinct-order steps over the absolute mean step. Meant for nearly unique columns."""
    # rows of one value are counted first: all steps between them are zero
    values = counted(df, {c: number(c) for c in columns}).where("v IS NOT NULL")
    parts = values.repartitionByRange(F.col("column"), F.col("v")).withColumn("p", F.spark_partition_id())
    d = F.col("v") - F.lag("v").over(Window.partitionBy("column", "p").orderBy("v"))
    each = parts.withColumn("d", d).groupBy("column", "p").agg(F.sum("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("q"), (F.sum("n") - 1).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    gap = F.col("lo") - F.lag("hi").over(Window.partitionBy("column").orderBy("lo"))
    tot = each.withColumn("g", gap).groupBy("column").agg((F.coalesce(F.sum("s"), F.lit(0.0)) + F.coalesce(F.sum("g"), F.lit(0.0))).alias("s"), (F.coalesce(F.sum("q"), F.lit(0.0)) + F.coalesce(F.sum(F.col("g") * F.col("g")), F.lit(0.0))).alias("q"), (F.sum("n") + F.count("g")).alias("n"))
    mean = F.col("s") / F.col("n")
    return tot.where("n > 0").select("column", F.when(mean != 0, F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))) / F.abs(mean)).alias("cv"))


def named_like_id(column: Column) -> Column:
    low = F.trim(F.lower(column))
    found = low.isin(*ID_NAMES)
    for part in ID_PARTS:
        found |= F.contains(low, F.lit(part))
    return found


def id_columns(df: DataFrame, order_by: str | None = None, stats: DataFrame | None = None) -> DataFrame:
    """column, reason of columns that look like IDs; without order_by the monotonic test isn't made. Date and text columns are none."""
    stats = stats if stats is not None else base_stats(df)
    numeric = numeric_columns(df, include_bool=False)
    lengths = text_stats(df, category_columns(df)).select("column", "mean_length", "is_text") if category_columns(df) else None
    found = stats.select("column", "numeric", "n_unique", "n_rows", "n_missing", "unique_ratio")
    found = found.join(F.broadcast(order_flags(df, numeric, order_by)), "column", "left") if order_by and numeric else found.select("*", F.lit(False).alias("rising"), F.lit(False).alias("falling"))
    found = found.join(F.broadcast(step_variation(df, numeric)), "column", "left") if numeric else found.withColumn("cv", F.lit(None).cast("double"))
    found = found.join(F.broadcast(lengths), "column", "left") if lengths is not None else found.select("*", F.lit(None).cast("double").alias("mean_length"), F.lit(False).alias("is_text"))
    # dates are looked for only in columns whose names look like an ID's
    named = [c for c in category_columns(df) if (low := c.lower().strip()) in ID_NAMES or any(x in low for x in ID_PARTS)]
    found = found.join(F.broadcast(date_stats(df, named).select("column", F.col("kind").isNotNull().alias("is_date"))), "column", "left") if named else found.withColumn("is_date", F.lit(False))
    known = F.coalesce(F.col("is_text"), F.lit(False)) | F.coalesce(F.col("is_date"), F.lit(False))
    whole = F.col("n_unique") == F.col("n_rows") - F.col("n_missing")
    reason = (
        F.when(F.col("numeric") & (F.col("n_unique") > 10) & whole & (F.col("rising") | F.col("falling")), "monotonic")
        .when(F.col("numeric") & (F.col("n_unique") > 10) & (F.col("unique_ratio") >= 0.95) & (F.col("cv") < 0.05), "even steps")
        .when(F.col("numeric") & (F.col("n_unique") > 10) & named_like_id(F.col("column")) & (F.col("unique_ratio") >= 0.80), "name")
        .when(~F.col("numeric") & ~known & named_like_id(F.col("column")) & (F.col("unique_ratio") >= 0.80) & (F.col("mean_length") <= 25), "name, short text")
    )
    return found.select("column", reason.alias("reason")).where("reason IS NOT NULL")


def column_types(df: DataFrame, order_by: str | None = None) -> DataFrame:
    """column, detected, drop_suggested: Constant, ID, the date kinds, Day-of-Week, Free Text, Binary, Numerical or Categorical, in this order."""
    stats = base_stats(df)
    found = stats.join(F.broadcast(id_columns(df, order_by, stats)), "column", "left")
    if texts := category_columns(df):
        found = found.join(F.broadcast(date_stats(df, texts).select("column", F.col("kind").alias("date_kind"))), "column", "left")
        found = found.join(F.broadcast(weekday_stats(df, texts).select("column", "is_weekday")), "column", "left")
        found = found.join(F.broadcast(text_stats(df, texts).select("column", "is_text")), "column", "left")
    else:
        found = found.select("*", F.lit(None).cast("string").alias("date_kind"), F.lit(False).alias("is_weekday"), F.lit(False).alias("is_text"))
    dates = F.when(F.col("date_kind") == "time", "Time only").when(F.col("date_kind") == "datetime", "DateTime").when(F.col("date_kind") == "date", "Date")
    kind = F.coalesce(F.when(F.col("n_unique") <= 1, "Constant"), F.when(F.col("reason").isNotNull(), "ID"), dates, F.when(F.col("is_weekday"), "Day-of-Week"), F.when(F.col("is_text"), "Free Text"), F.when(F.col("n_unique") <= 2, "Binary"), F.when(F.col("numeric"), "Numerical"), F.lit("Categorical"))
    return found.select("column", kind.alias("detected"), (kind.isin("Constant", "ID") | (F.col("missing") > 0.80)).alias("drop_suggested"))


def override_check(df: DataFrame, column: str, wanted: str) -> DataFrame:
    """column, wanted, severity (ok, warning, error), value: whether a column can be taken for another type."""
    text = quoted(column).cast("string")
    n = F.greatest(F.count(text), F.lit(1))
    low = F.lower(F.trim(text))
    value = {
        "Date": F.count(parsed_date(text)) / n, "DateTime": F.count(parsed_date(text)) / n, "Numerical": F.count(text.try_cast("double")) / n,
        "Free Text": F.coalesce(F.avg(F.length(text)), F.lit(0.0)), "Day-of-Week": F.count_distinct(F.when(low.isin(*WEEKDAYS), low)) / F.greatest(F.count_distinct(low), F.lit(1)),
        "Binary": F.count_distinct(text).cast("double"), "Categorical": F.count_distinct(text).cast("double"),
    }[wanted].cast("double")
    v = F.col("value")
    bad = {
        "Date": F.when(v < 0.5, "warning"), "DateTime": F.when(v < 0.5, "warning"), "Numerical": F.when(v < 0.7, "error").when(v < 0.95, "warning"), "Free Text": F.when(v < 10, "warning"),
        "Day-of-Week": F.when(v < 0.5, "warning"), "Binary": F.when(v > 2, "error"), "Categorical": F.when(v > 500, "warning"),
    }[wanted]
    return df.agg(value.alias("value")).select(F.lit(column).alias("column"), F.lit(wanted).alias("wanted"), F.coalesce(bad, F.lit("ok")).alias("severity"), "value")


def reassigned(types: DataFrame, overrides: dict[str, str]) -> DataFrame:
    """Rows of column_types with the types that the user has set; a set type isn't suggested for dropping."""
    if not overrides:
        return types
    own = F.create_map(*(F.lit(x) for pair in overrides.items() for x in pair))[F.col("column")]
    return types.select("column", F.coalesce(own, F.col("detected")).alias("detected"), F.when(own.isNotNull(), F.lit(False)).otherwise(F.col("drop_suggested")).alias("drop_suggested"))


def top_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, share of its most frequent value, null included."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), present(df, c).cast("string").alias("v")) for c in columns))).alias("s")).select("s.*")
    counts = long.groupBy("column", "v").agg(F.count("*").alias("n"))
    return counts.groupBy("column").agg((F.max("n") / F.sum("n")).alias("share"))


def pruned(df: DataFrame, label: str, order_by: str | None = None) -> DataFrame:
    """column, reason of what a collector drops: ID-like, constant, near-constant (99 %), leakage (|correlation| over 0.95)."""
    columns = [c for c in df.columns if c != label]
    numeric = [c for c in numeric_columns(df, include_bool=False) if c != label]
    found = base_stats(df, columns).join(F.broadcast(top_shares(df, columns)), "column")
    both = [F.when(number(c).isNotNull() & number(label).isNotNull(), F.lit(1)) for c in numeric]
    leaks = df.agg(*(F.struct(F.lit(c).alias("column"), F.abs(corr(number(c), number(label))).alias("r"), F.count(b).alias("pairs")).alias(f"__{i}") for i, (c, b) in enumerate(zip(numeric, both, strict=True)))).select(F.inline(F.array(*(F.col(f"__{i}") for i in range(len(numeric)))))) if numeric else None
    found = found.join(F.broadcast(leaks), "column", "left") if leaks is not None else found.select("*", F.lit(None).alias("r"), F.lit(0).alias("pairs"))
    low = F.trim(F.lower("column"))
    like_id = low.isin(*COLLECTED_IDS) | F.endswith(low, F.lit(COLLECTED_END)) | (~F.col("numeric") & (F.col("unique_ratio") > 0.95))
    if order_by and numeric:
        flags = order_flags(df, numeric, order_by).select("column", (F.col("rising") | F.col("falling")).alias("monotonic"))
        found = found.join(F.broadcast(flags), "column", "left")
        like_id |= F.coalesce(F.col("monotonic"), F.lit(False)) & (F.col("n_unique") == F.col("n_rows") - F.col("n_missing")) & (F.col("n_unique") > 10)
    reason = F.when(like_id, "id").when(F.col("n_unique") <= 1, "constant").when(F.col("share") > 0.99, "near-constant").when((F.col("r") > 0.95) & (F.col("pairs") > 10), "leakage")
    return found.select("column", reason.alias("reason")).where("reason IS NOT NULL")


def advisories(df: DataFrame, label: str) -> DataFrame:
    """category, severity, title, detail, suggested_params (map of a model's parameters, or null): too few rows, too many features, many missing values."""
    columns = [c for c in df.columns if c != label]
    missing = sum((F.count_if(present(df, c).isNull()) for c in columns), F.lit(0)) / (F.greatest(F.count("*"), F.lit(1)) * max(1, len(columns)))
    row = df.agg(F.count("*").alias("n"), missing.alias("m"))
    advice = {  # category: when, severity, title, detail, suggested parameters
        "Small Dataset": (F.col("n") < 500, "medium", "few rows: keep the model simple", F.format_string("%d rows", F.col("n")), SMALL_PARAMS),
        "High Dimensionality": ((F.lit(len(columns)) > 0.5 * F.col("n")) & F.lit(len(columns) > 50), "medium", "many features for the rows: risk of overfitting", F.lit(f"{len(columns)} features"), WIDE_PARAMS),
        "High Missingness": (F.col("m") > 0.20, "low", "many missing values: impute first", F.format_string("%.4f missing", F.col("m")), None),
    }
    params = lambda p: (F.create_map(*(F.lit(x) for kv in p.items() for x in kv)) if p else F.lit(None)).cast("map<string,double>")
    rules = [F.when(when, F.struct(F.lit(c).alias("category"), F.lit(severity).alias("severity"), F.lit(title).alias("title"), detail.alias("detail"), params(p).alias("suggested_params"))) for c, (when, severity, title, detail, p) in advice.items()]
    return row.select(F.inline(F.array_compact(F.array(*rules))))


def numeric_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, mean, std, lo, hi, skew, outliers: share outside 1.5 interquartile ranges. Quartiles are found first, the rest in one pass."""
    columns = columns or numeric_columns(df, include_bool=False)
    q = quantiles(df, {c: (0.25, 0.75) for c in columns})

    def measures(c):
        x = number(c)
        q1, q3 = q[c] or (None, None)
        reach = 1.5 * ((q3 or 0.0) - (q1 or 0.0))
        out = F.count_if((x < (q1 or 0.0) - reach) | (x > (q3 or 0.0) + reach)) / F.greatest(F.count(x), F.lit(1))
        return F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.skewness(x).alias("skew"), out.alias("outliers")

    return _one_row_each(df, columns, measures)


def missing_summary(stats: DataFrame, k: int = 5) -> DataFrame:
    """The k columns with the most missing values."""
    return stats.where("n_missing > 0").orderBy(F.desc("n_missing"), "column").limit(k).select("column", "n_missing", "missing")


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """label, n, share, verdict: red if the largest class has over 3 times the smallest, yellow over 1.5 times, else green."""
    counts = df.where(quoted(label).isNotNull()).groupBy(quoted(label).cast("string").alias("label")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t"), (F.max("n") / F.min("n")).alias("r"))
    verdict = F.when(F.col("r") > 3, "red").when(F.col("r") > 1.5, "yellow").otherwise("green")
    return counts.join(F.broadcast(total)).select("label", "n", (F.col("n") / F.col("t")).alias("share"), verdict.alias("verdict"))


def type_counts(types: DataFrame) -> DataFrame:
    return types.groupBy("detected").agg(F.count("*").alias("n"))
