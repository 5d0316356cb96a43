"""Reading labelled tables and writing results: names, encodings, fixed schemas, merging, exports and saved models."""

from __future__ import annotations

import re

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import quoted


def _unique(names: list[str]) -> list[str]:
    """Repeated names get _1, _2 .. in order."""
    taken, out = set(), []
    for n in names:
        k, own = 0, n
        while own in taken:
            k += 1
            own = f"{n}_{k}"
        taken.add(own)
        out.append(own)
    return out


def sanitised(names: list[str], strict: bool = False) -> list[str]:
    """Names without the characters that model formats refuse; strict: letters, digits and _ only, no repeated or outer _, never empty."""
    if strict:
        return _unique([re.sub(r"_+", "_", re.sub(r"[^A-Za-z0-9_]", "_", n)).strip("_") or "col" for n in names])
    return _unique([re.sub(r'[\[\]{}":,]', "_", n) for n in names])


def with_sanitised_names(df: DataFrame, strict: bool = False) -> DataFrame:
    return df.toDF(*sanitised(df.columns, strict))


def read_labelled_csv(spark: SparkSession, path: str, encoding: str | None = None, schema: T.StructType | None = None) -> DataFrame:
    """A CSV with a header; types are inferred without a schema. Without an encoding it is UTF-8, or latin-1 if a row read as UTF-8 holds U+FFFD."""
    options = {"header": True, "multiLine": True, "escape": '"'}
    read = spark.read.options(**options)
    read = read.schema(schema) if schema else read.option("inferSchema", True)
    if encoding is None:
        raw = spark.read.options(**options).csv(path, encoding="UTF-8")
        bad = F.lit(False)
        for c in raw.columns:
            bad |= F.coalesce(F.contains(quoted(c), F.lit("�")), F.lit(False))
        encoding = "UTF-8" if raw.where(bad).isEmpty() else "ISO-8859-1"
    return read.csv(path, encoding=encoding)


def append_rows(df: DataFrame, path: str, schema: T.StructType) -> None:
    """df appended in a fixed schema: absent columns are null, others are dropped."""
    df.select(*(quoted(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema)).write.mode("append").parquet(path)


def clean_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """Strings fit for any CSV reader: commas as _, no quotes, line ends as spaces, trimmed, null as empty."""
    own = lambda c: F.trim(F.regexp_replace(F.translate(F.coalesce(quoted(c), F.lit("")), ",\"'", "_"), r"[\r\n]+", " "))
    return df.withColumns({c: own(c) for c in columns})


def merged(parts: list[DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """The union of result tables, one row of each key: of the first part, by `order` within it."""
    every = None
    for i, p in enumerate(parts):
        own = p.withColumn("__part", F.lit(i))
        every = own if every is None else every.unionByName(own, allowMissingColumns=True)
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("__part", *order))
    return every.withColumn("__k", first).where("__k = 1").drop("__k", "__part")


def read_results(spark: SparkSession, path: str, schema: T.StructType, keys: list[str], order: list[str]) -> DataFrame:
    """All result files of a folder or pattern, one row of each key, the first by file name and `order`."""
    rows = spark.read.schema(schema).csv(path, header=True).withColumn("__file", F.input_file_name())
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("__file", *order))
    return rows.withColumn("__k", first).where("__k = 1").drop("__k", "__file")


def summary(results: DataFrame) -> DataFrame:
    """method, n_rows, n_datasets, significant_share; method null: all."""
    aggs = [F.count("*").alias("n_rows"), F.count_distinct("dataset_name").alias("n_datasets"), F.avg(F.col("is_significant").cast("double")).alias("significant_share")]
    return results.groupBy("method").agg(*aggs).unionByName(results.agg(*aggs).select(F.lit(None).cast("string").alias("method"), "n_rows", "n_datasets", "significant_share"))


def status_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count("*").alias("n"))


def failed_tasks(results: DataFrame, k: int = 20) -> DataFrame:
    """The first k failed tasks by id: a report's limit."""
    return results.where("status <> 'ok'").orderBy("task_id").limit(k)


def export(df: DataFrame, path: str, kind: str = "parquet") -> None:
    df.write.mode("overwrite").option("header", True).format(kind).save(path)


def predictions(scored: DataFrame, keep: list[str], classes: list[str], label: str | None = "label") -> DataFrame:
    """keep, predicted_class, actual_class and prob_<class>, with class names for numbers."""
    names = F.array(*map(F.lit, classes))
    probs = [F.col("score").alias(f"prob_{classes[1]}"), (1 - F.col("score")).alias(f"prob_{classes[0]}")] if "score" in scored.columns else [F.col(f"prob_{k}").alias(f"prob_{c}") for k, c in enumerate(classes)]
    actual = [names[F.col(label).cast("int")].alias("actual_class")] if label else []
    return scored.select(*(quoted(c) for c in keep), names[F.col("prediction").cast("int")].alias("predicted_class"), *actual, *probs)


def comparison(baseline: DataFrame, enhanced: DataFrame, key: str) -> DataFrame:
    """key, baseline_prediction, enhanced_prediction, models_agree."""
    b = baseline.select(quoted(key), F.col("prediction").alias("baseline_prediction"))
    e = enhanced.select(quoted(key), F.col("prediction").alias("enhanced_prediction"))
    return b.join(e, key).withColumn("models_agree", F.col("baseline_prediction") == F.col("enhanced_prediction"))


def disagreement(compared: DataFrame) -> DataFrame:
    return compared.agg(F.avg((~F.col("models_agree")).cast("double")).alias("disagreement_rate"), F.count("*").alias("n"))


def load_family_models(spark: SparkSession, folder: str, families: tuple[str, ...]) -> dict:
    """family -> (model, config row) of those that folder/<family>/model and folder/<family>/config hold; a family without both is left out."""
    found = {}
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    for f in families:
        places = [fs_path(f"{folder}/{f}/{x}") for x in ("model", "config")]
        if all(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) for p in places):
            found[f] = (PipelineModel.load(f"{folder}/{f}/model"), spark.read.json(f"{folder}/{f}/config").first())
    return found


def save_family_model(model: PipelineModel, config: DataFrame, folder: str, family: str) -> None:
    model.write().overwrite().save(f"{folder}/{family}/model")
    config.coalesce(1).write.mode("overwrite").json(f"{folder}/{family}/config")
