"""Transforms: fitted on a training table, replayed on any other table or stream.

All scalar parameters of a fit come from one fused aggregate of the original training columns; encoder maps stay tables.
Replaying needs column expressions and joins with those maps only, so it works on a stream as well.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import joint
from ..functions.columns import category, hinted, md5fold, number, numeric_columns, quoted, without_accents
from ..functions.dates import day_first, parsed_date
from ..functions.quantiles import quantiles
from .profile import WEEKDAYS

# Fixed values of the methods.
EPS, SMOOTHING, FOLDS, BUCKETS, TFIDF_TERMS = 1e-5, 10.0, 5, 32, 20
ROW_STATS = ("row_mean", "row_median", "row_sum", "row_std", "row_min", "row_max", "row_range")
DATE_PARTS = {"year": 0, "month": 1, "day": 1, "dayofweek": 0, "is_weekend": 0, "quarter": 1, "weekofyear": 1, "days_since_min": 0, "hour": 0}
TEXT_STATS = ("word_count", "char_count", "avg_word_len", "uppercase_ratio", "digit_ratio", "punct_ratio")
PERIODS = {"month": ("month", 12), "dow": ("dayofweek", 7), "dom": ("day", 31), "hour": ("hour", 24)}
ORDER = {"missing_indicator": 0, "impute_median": 1}
#: Values of a column that one-hot encoding makes columns of at most; more are an error.
ONEHOT_MOST = 1_000


@dataclass
class Step:
    """A suggestion, and after fitting what it needs: scalars in `params`, a map (key -> value) in `table`."""

    method: str
    column: str = ""
    column_b: str = ""
    options: tuple[str, ...] | None = None
    params: dict = field(default_factory=dict)
    table: DataFrame | None = None


def _lookup(df: DataFrame, key: Column, table: DataFrame, value: str, to: str, otherwise: Column) -> DataFrame:
    """df with `to`: table's value for the key, or `otherwise`. A left join, so it holds for streams."""
    own = table.select(F.col("key").alias("__key"), F.col(value).alias("__value"))
    return df.withColumn("__lookup", key).join(own, F.col("__lookup") == F.col("__key"), "left").withColumn(to, F.coalesce("__value", otherwise)).drop("__lookup", "__key", "__value")


def _roles(df: DataFrame, s: Step) -> tuple[str, str]:
    """Numeric and category column of a group method."""
    return (s.column, s.column_b) if s.column in numeric_columns(df) else (s.column_b, s.column)


def _needs(df: DataFrame, s: Step) -> list[tuple[str, Column | tuple[float, ...]]]:
    """Names of the scalars that a step needs, and their aggregates or the quantiles of the column behind the colon."""
    def median(c):
        return (f"median:{c}", (0.5,))

    if s.method in ("log_transform", "sqrt_transform"):
        return [median(s.column), (f"min:{s.column}", F.min(number(s.column)))]
    if s.method in ("polynomial_square", "polynomial_cube", "reciprocal_transform", "impute_median"):
        return [median(s.column)]
    if s.method == "quantile_binning":
        return [(f"edges:{s.column}", (0.0, 0.2, 0.4, 0.6, 0.8, 1.0))]
    if s.method.endswith("_interaction"):
        return [median(s.column), median(s.column_b)]
    if s.method in ("group_mean", "group_std"):
        num, _ = _roles(df, s)
        return [(f"mean:{num}", F.avg(number(num)))]
    if s.method == "row_numeric_stats":
        return [median(c) for c in s.params["columns"]]
    if s.method == "date_features":
        return [(f"first:{s.column}", F.min(F.unix_micros(_moment(df, s.column, s.params["day_first"]))))]
    return []


def _moment(df: DataFrame, c: str, day_first: bool = False) -> Column:
    kind = df.schema[c].dataType.typeName()
    return parsed_date(quoted(c), day_first) if kind == "string" else F.to_timestamp(quoted(c).cast("timestamp"))


def fit(train: DataFrame, steps: list[Step], label: str = "label", key: str = "key") -> list[Step]:
    """The steps in the order of their application, fitted on the original columns of train."""
    steps = [Step(s.method, s.column, s.column_b, s.options) for s in sorted(steps, key=lambda s: ORDER.get(s.method, 2)) if s.method != "class_weight_balance"]
    for s in steps:
        if s.method in ("row_numeric_stats", "row_zero_stats"):
            s.params["columns"] = [c for c in numeric_columns(train) if c not in (label, key)]
        if s.method == "row_missing_stats":
            s.params["columns"] = [c for c in train.columns if c not in (label, key)]
    # which of day and month comes first is decided once for a column, from the training table
    days = day_first(train, [s.column for s in steps if s.method == "date_features" and train.schema[s.column].dataType.typeName() == "string"])
    for s in steps:
        if s.method == "date_features":
            s.params["day_first"] = days.get(s.column, False)
    wanted = dict(x for s in steps for x in _needs(train, s))
    plain = {name: a for name, a in wanted.items() if not isinstance(a, tuple)}
    row = train.agg(*(a.alias(f"__{i}") for i, a in enumerate(plain.values()))).first() if plain else []
    found = dict(zip(plain, row, strict=True))
    points: dict[str, tuple[float, ...]] = {}
    for name in wanted.keys() - plain.keys():
        c = name.split(":", 1)[1]
        points[c] = tuple(sorted({*points.get(c, ()), *wanted[name]}))
    made = quantiles(train, points)
    for name in wanted.keys() - plain.keys():
        c = name.split(":", 1)[1]
        of = dict(zip(points[c], made[c] or [None] * len(points[c]), strict=True))
        found[name] = of[0.5] if name.startswith("median:") else [of[p] for p in wanted[name] if of[p] is not None]
    for s in steps:
        _fit_one(train, s, found, label, key)
    return steps


def _fit_one(train: DataFrame, s: Step, found: dict, label: str, key: str) -> None:
    c, m = s.column, s.method
    for name in ("column", "column_b"):
        if (v := getattr(s, name)) and f"median:{v}" in found:
            s.params[f"median_{name}"] = found[f"median:{v}"] or 0.0
    if m == "log_transform":
        low = found[f"min:{c}"] or 0.0
        s.params["offset"] = abs(low) + 1 if low <= 0 else 0.0
    elif m == "sqrt_transform":
        low = found[f"min:{c}"] or 0.0
        s.params["offset"] = abs(low) if low < 0 else 0.0
    elif m == "quantile_binning":
        s.params["edges"] = sorted(set(found[f"edges:{c}"] or []))
    elif m == "frequency_encoding":
        n = train.count()
        s.table = hinted(train.groupBy(category(c).alias("key")).agg((F.count("*") / max(1, n)).alias("value")))
    elif m == "target_encoding":
        sums = train.groupBy(category(c).alias("key")).agg(F.count("*").alias("n"), F.sum(number(label)).alias("s"))
        s.params["mean"] = train.agg(F.avg(number(label))).first()[0] or 0.0
        gm = F.lit(s.params["mean"])
        s.table = hinted(sums.select("key", ((F.col("s") + SMOOTHING * gm) / (F.col("n") + SMOOTHING)).alias("value")))
    elif m == "onehot_encoding":
        values = [r[0] for r in train.select(category(c).alias("v")).distinct().orderBy("v").limit(ONEHOT_MOST + 1).collect()]
        if len(values) > ONEHOT_MOST:
            raise ValueError(f"{c} has more than {ONEHOT_MOST} values, each of which would be a column")
        s.params["values"] = values[1:]
    elif m in ("group_mean", "group_std"):
        num, cat = s.params["roles"] = _roles(train, s)
        s.params["name"] = f"{'grpmean' if m == 'group_mean' else 'grpstd'}_{num}_by_{cat}"
        value = F.avg(number(num)) if m == "group_mean" else F.stddev_samp(number(num))
        table = train.groupBy(category(cat).alias("key")).agg(value.alias("value"))
        s.params["otherwise"] = found[f"mean:{num}"] if m == "group_mean" else table.agg(F.avg("value")).first()[0]
        s.table = hinted(table)
    elif m == "cat_concat":
        kinds = train.select(F.concat_ws("_", category(c), category(s.column_b)).alias("key")).distinct()
        s.table = hinted(joint.places(kinds, "key", "value").withColumn("value", F.col("value").cast("int")))
    elif m == "row_numeric_stats":
        s.params["medians"] = {x: found[f"median:{x}"] or 0.0 for x in s.params["columns"]}
    elif m == "date_features":
        s.params["first"] = found[f"first:{c}"]
    elif m == "text_tfidf":
        _fit_tfidf(train, s)


def _tokens(text: Column) -> Column:
    low = without_accents(F.lower(F.coalesce(text.cast("string"), F.lit(""))))
    return F.filter(F.regexp_extract_all(low, F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1)), lambda w: ~w.isin(*STOP_WORDS))


#: Spark's list, which is in the session's jars; read once when first needed.
STOP_WORDS: list[str] = []


def stop_words() -> list[str]:
    if not STOP_WORDS:
        STOP_WORDS.extend(w for w in StopWordsRemover.loadDefaultStopWords("english") if w.isalnum())
    return STOP_WORDS


def _fit_tfidf(train: DataFrame, s: Step) -> None:
    stop_words()
    n = train.count()
    words = train.select(_tokens(quoted(s.column)).alias("w"))
    # occurrences and documents of each term in one pass over the texts
    own = F.concat(F.transform("w", lambda x: F.struct(x.alias("term"), F.lit(0).alias("d"))), F.transform(F.array_distinct("w"), lambda x: F.struct(x.alias("term"), F.lit(1).alias("d"))))
    totals = words.select(F.inline(own)).groupBy("term").agg(F.count_if(F.col("d") == 0).alias("n"), F.sum("d").alias("d")).orderBy(F.desc("n"), "term").limit(TFIDF_TERMS)
    known = {r.term: r.d for r in totals.collect()}
    terms = sorted(known)
    df = [known[t] for t in terms]
    s.params |= {"terms": terms, "idf": [math.log((1 + n) / (1 + d)) + 1 for d in df]}


def _equals(term: str):
    return lambda w: w == term


def out_of_fold(train: DataFrame, s: Step, label: str, key: str) -> DataFrame:
    """train with its column target-encoded by the other folds' rows."""
    gm = F.lit(s.params["mean"])
    keyed = train.withColumn("__cat", category(s.column)).withColumn("__fold", md5fold(quoted(key), FOLDS))
    by_fold = keyed.groupBy("__cat", "__fold").agg(F.count("*").alias("__n"), F.sum(number(label)).alias("__s"))
    total = by_fold.groupBy("__cat").agg(F.sum("__n").alias("__tn"), F.sum("__s").alias("__ts"))
    n, t = F.col("__tn") - F.col("__n"), F.col("__ts") - F.col("__s")
    maps = by_fold.join(total, "__cat").select("__cat", "__fold", F.when(n > 0, (t + SMOOTHING * gm) / (n + SMOOTHING)).otherwise(gm).alias("__value"))
    return keyed.join(hinted(maps), ["__cat", "__fold"], "left").withColumn(s.column, F.col("__value")).drop("__cat", "__fold", "__value")


def _dow(c: str) -> Column:
    names = F.create_map(*(F.lit(x) for pair in WEEKDAYS.items() for x in pair))
    return names[F.lower(F.trim(quoted(c).cast("string")))]


def _wave(x: Column, period: int) -> tuple[Column, Column]:
    return F.sin(2 * math.pi * x / period), F.cos(2 * math.pi * x / period)


def _row_stats(columns: list[str], medians: dict, wanted: tuple[str, ...]) -> dict[str, Column]:
    values = [F.coalesce(number(c), F.lit(float(medians[c]))) for c in columns]
    n, every = len(values), F.array_sort(F.array(*values))
    total = sum(values[1:], values[0])
    mean = total / n
    middle = (every[(n - 1) // 2] + every[n // 2]) / 2
    std = F.sqrt(sum(((v - mean) * (v - mean) for v in values[1:]), (values[0] - mean) * (values[0] - mean)) / (n - 1)) if n > 1 else F.lit(0.0)
    low, high = every[0], every[n - 1]
    made = {"row_mean": mean, "row_median": middle, "row_sum": total, "row_std": std, "row_min": low, "row_max": high, "row_range": high - low}
    return {k: made[k] for k in wanted}


def date_parts(t: Column, first: int | None) -> dict[str, Column]:
    since = F.floor((F.unix_micros(t.cast("timestamp")) - F.lit(first)) / 86_400_000_000) if first is not None else F.lit(None)
    own = {"year": F.year(t), "month": F.month(t), "day": F.dayofmonth(t), "dayofweek": F.weekday(t), "is_weekend": (F.weekday(t) >= 5).cast("int"), "quarter": F.quarter(t), "weekofyear": F.weekofyear(t), "days_since_min": since, "hour": F.hour(t)}
    return {k: F.coalesce(v.cast("int"), F.lit(DATE_PARTS[k])) for k, v in own.items()}


def text_measures(x: Column) -> dict[str, Column]:
    t = F.coalesce(x.cast("string"), F.lit(""))
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    n, size = F.size(words), F.greatest(F.length(t), F.lit(1))
    kept = lambda drop: F.length(F.regexp_replace(t, drop, ""))
    letters = F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w))
    return {
        "word_count": n, "char_count": F.length(t), "avg_word_len": F.when(n > 0, letters / n).otherwise(F.lit(0.0)),
        "uppercase_ratio": kept(r"[^\p{Lu}]") / size, "digit_ratio": kept(r"[^\p{Nd}]") / size, "punct_ratio": kept(r"[\p{L}\p{N}\s]") / size,
    }


def apply(df: DataFrame, steps: list[Step], fitted_on: tuple[str, str] | None = None) -> DataFrame:
    """df with the fitted steps replayed. fitted_on (label, key): df is the training table, so target encoding is out of fold.

    A step whose columns are absent is left out, as a date's cyclic parts before its date_features.
    """
    for s in steps:
        df = _apply_one(df, s, fitted_on)
    return df


def _apply_one(df: DataFrame, s: Step, fitted_on: tuple[str, str] | None) -> DataFrame:
    c, b, m, p = s.column, s.column_b, s.method, s.params
    a = lambda: F.coalesce(number(c), F.lit(float(p["median_column"])))
    z = lambda: F.coalesce(number(b), F.lit(float(p["median_column_b"])))
    if c and c not in df.columns and m not in ("date_cyclical", "dow_cyclical", *(f"date_cyclical_{x}" for x in PERIODS)):
        return df
    if m == "log_transform":
        return df.withColumn(c, F.log1p(a() + p["offset"]))
    if m == "sqrt_transform":
        return df.withColumn(c, F.sqrt(a() + p["offset"]))
    if m == "polynomial_square":
        return df.withColumn(f"{c}_sq", a() * a())
    if m == "polynomial_cube":
        return df.withColumn(f"{c}_cube", a() * a() * a())
    if m == "reciprocal_transform":
        return df.withColumn(f"{c}_recip", 1 / (F.abs(a()) + EPS))
    if m == "quantile_binning":
        x, edges = number(c), p["edges"]
        return df.withColumn(c, F.when(x.isNotNull(), sum(((x > e).cast("int") for e in edges[1:-1]), F.lit(0))).cast("double"))
    if m == "impute_median":
        return df.withColumn(c, a())
    if m == "missing_indicator":
        x = number(c) if c in numeric_columns(df) else quoted(c)
        return df.withColumn(f"{c}_is_na", x.isNull().cast("int"))
    if m == "frequency_encoding":
        return _lookup(df, category(c), s.table, "value", c, F.lit(0.0))
    if m == "target_encoding":
        return out_of_fold(df, s, *fitted_on) if fitted_on else _lookup(df, category(c), s.table, "value", c, F.lit(p["mean"]))
    if m == "onehot_encoding":
        return df.withColumns({f"{c}_{v}": (category(c) == v).cast("int") for v in p["values"]}).drop(c)
    if m == "hashing_encoding":
        return df.withColumn(c, (F.conv(F.substring(F.md5(category(c)), 31, 2), 16, 10).cast("int") % BUCKETS))
    if m == "product_interaction":
        return df.withColumn(f"{c}_x_{b}", a() * z())
    if m == "division_interaction":
        return df.withColumn(f"{c}_div_{b}", a() / (F.abs(z()) + EPS))
    if m == "addition_interaction":
        return df.withColumn(f"{c}_plus_{b}", a() + z())
    if m == "abs_diff_interaction":
        return df.withColumn(f"{c}_absdiff_{b}", F.abs(a() - z()))
    if m in ("group_mean", "group_std"):
        return _lookup(df, category(p["roles"][1]), s.table, "value", p["name"], F.lit(p["otherwise"]))
    if m == "cat_concat":
        return _lookup(df, F.concat_ws("_", category(c), category(b)), s.table, "value", f"{c}_concat_{b}", F.lit(-1))
    if m == "row_numeric_stats":
        own = [x for x in p["columns"] if x in df.columns and x in numeric_columns(df)]
        return df.withColumns(_row_stats(own, p["medians"], s.options or ROW_STATS)) if own else df
    if m == "row_zero_stats":
        own = [x for x in p["columns"] if x in df.columns]
        zeros = sum((F.coalesce((number(x) == 0).cast("int"), F.lit(0)) for x in own), F.lit(0))
        return df.withColumns({"row_zero_count": zeros, "row_zero_percentage": zeros / max(1, len(own))})
    if m == "row_missing_stats":
        own = [x for x in p["columns"] if x in df.columns]
        gone = sum(((number(x) if x in numeric_columns(df) else quoted(x)).isNull().cast("int") for x in own), F.lit(0))
        return df.withColumns({"row_missing_count": gone, "row_missing_percentage": gone / max(1, len(own))})
    if m == "date_features":
        made = date_parts(_moment(df, c, p["day_first"]), p["first"])
        return df.withColumns({f"{c}_{k}": made[k] for k in (s.options or DATE_PARTS)}).drop(c)
    if m.startswith("date_cyclical"):
        own = [m.removeprefix("date_cyclical_")] if m != "date_cyclical" else ["month", "dow"]
        for k in own:
            part, period = PERIODS[k]
            if f"{c}_{part}" in df.columns:
                sin, cos = _wave(quoted(f"{c}_{part}"), period)
                df = df.withColumns({f"{c}_{k}_sin": sin, f"{c}_{k}_cos": cos})
        return df
    if m == "dow_ordinal":
        return df.withColumn(f"{c}_dow", F.coalesce(_dow(c), F.lit(-1))).drop(c)
    if m == "dow_cyclical":
        x = quoted(f"{c}_dow") if f"{c}_dow" in df.columns else F.coalesce(_dow(c), F.lit(0)) if c in df.columns else None
        if x is None:
            return df
        sin, cos = _wave(x, 7)
        return df.withColumns({f"{c}_dow_sin": sin, f"{c}_dow_cos": cos}).drop(c)
    if m == "text_stats":
        made = text_measures(quoted(c))
        return df.withColumns({f"{c}_{k}": made[k] for k in (s.options or TEXT_STATS)}).drop(c)
    if m == "text_tfidf":
        stop_words()
        df = df.withColumn("__tokens", _tokens(quoted(c)))
        raw = {t: F.size(F.filter("__tokens", _equals(t))) * F.lit(i) for t, i in zip(p["terms"], p["idf"], strict=True)}
        df = df.withColumns({f"__tf_{i}": x for i, x in enumerate(raw.values())})
        norm = F.sqrt(sum((F.col(f"__tf_{i}") * F.col(f"__tf_{i}") for i in range(len(raw))), F.lit(0.0)))
        df = df.withColumn("__norm", norm)
        df = df.withColumns({f"{c}_tfidf_{i}": F.when(F.col("__norm") > 0, F.col(f"__tf_{i}") / F.col("__norm")).otherwise(F.lit(0.0)) for i in range(len(raw))})
        return df.drop("__tokens", "__norm", *(f"__tf_{i}" for i in range(len(raw))), c)
    raise ValueError(f"unknown method {m}")


def fit_and_apply(train: DataFrame, steps: list[Step], label: str = "label", key: str = "key") -> tuple[DataFrame, list[Step]]:
    fitted = fit(train, steps, label, key)
    return apply(train, fitted, (label, key)), fitted


def fitted_table(spark, steps: list[Step]) -> DataFrame:
    """The applied transforms as a report table: method, column, column_b, params as text."""
    rows = [(s.method, s.column, s.column_b, ", ".join(f"{k}={v}" for k, v in sorted(s.params.items()))) for s in steps]
    return spark.createDataFrame(rows, "method string, column string, column_b string, params string")
