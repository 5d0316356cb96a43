"""Scoring a table with a trained model, all its metrics, and the tables of a report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics, models, prepare, profile, verdicts
from ..operators.models import Encoders
from ..operators.transforms import Step, fitted_table


def predict_on_set(model, df: DataFrame, enc: Encoders, n_classes: int, keep: list[str], threshold: float | None = None) -> DataFrame:
    """keep, score or prob_<k>, prediction. Absent columns count as 0, unseen categories as the first class; a threshold holds for two classes only."""
    out = models.scored(model, models.matrix(df, enc, keep), n_classes).drop("features")
    return out.withColumn("prediction", (F.col("score") >= threshold).cast("double")) if threshold is not None and n_classes == 2 else out


def evaluate_on_set(model, df: DataFrame, enc: Encoders, n_classes: int, label: str, threshold: float | None = None) -> dict[str, DataFrame]:
    """Small tables: metrics (metric, value), confusion, and for two classes roc and pr points and the best thresholds."""
    rows = predict_on_set(model, df, enc, n_classes, [label], threshold).withColumn("label", F.col(label).cast("double")).cache()
    found = metrics.class_metrics(rows)
    if n_classes == 2:
        t = threshold if threshold is not None else 0.5
        found = metrics.metrics_at_threshold(rows, t).select("accuracy", "f1", "precision", "recall").join(metrics.ranking_metrics(rows)).join(metrics.log_loss(rows))
    else:
        p = F.greatest(F.lit(2.220446049250313e-16), F.coalesce(*(F.when(F.col("label") == k, F.col(f"prob_{k}")) for k in range(n_classes))))
        named = rows.withColumn("label", F.col("label").cast("int").cast("string"))
        found = found.join(metrics.multiclass_auc(named, [str(k) for k in range(n_classes)])).join(rows.agg(F.avg(-F.log(p)).alias("log_loss")))
    long = found.select(F.inline(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in found.columns))))
    out = {"metrics": long, "confusion": metrics.confusion(rows)}
    if n_classes == 2:
        out |= {"roc": metrics.roc_points(rows), "pr": metrics.pr_points(rows), "thresholds": metrics.optimal_thresholds(rows), "histogram": metrics.histogram(rows, "score")}
    return out


def final_model(df: DataFrame, label: str, key: str, steps: list[Step], n_classes: int = 2, params: dict | None = None):
    """A model of all rows with transforms that were fitted before, and its encoders."""
    from ..operators.transforms import apply

    made = apply(df, steps)
    enc = models.fit_encoders(made, label, skip=(key,))
    return models.train_classifier(models.matrix(made, enc, [label]), n_classes, label, params), enc


def report_tables(df: DataFrame, label: str, suggestions: DataFrame, steps: list[Step], baseline: DataFrame, enhanced: DataFrame, order_by: str | None = None) -> dict[str, DataFrame]:
    """The small tables of a report; baseline and enhanced are (metric, value)."""
    stats = profile.base_stats(df)
    types = profile.column_types(df, order_by)
    compared = metrics.compared(baseline, enhanced)
    auc = enhanced.where("metric = 'roc_auc'").agg(F.max("value").alias("auc"))
    advice = profile.advisories(df, label)
    return {
        "columns": types, "type_counts": profile.type_counts(types), "classes": profile.class_balance(df, label), "missing": profile.missing_summary(stats), "advisories": advice, "suggestions": suggestions,
        "transforms": fitted_table(df.sparkSession, steps), "metrics": compared, "flags": verdicts.executive_flags(prepare.class_counts(df, label).agg(F.sum("n").alias("n_rows")).join(auc), advice),
    }


def write_report(found: dict[str, DataFrame], folder: str) -> None:
    for name, table in found.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}")
