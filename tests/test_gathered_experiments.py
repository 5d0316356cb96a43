"""Experiments ask for what their gates look at, and go through their rows in few tasks."""

import pytest
from pyspark.sql import functions as F

from tablewright.operators import meta, metrics, models
from tablewright.operators.transforms import Step
from tablewright.plans import collect


def test_gates_as_meta(spark):
    df = spark.range(300).selectExpr("CASE WHEN id % 7 > 0 THEN CAST(id % 40 AS DOUBLE) END AS x", "CAST(id % 2 AS INT) AS two", "CAST(NULL AS DOUBLE) AS gone", "CASE WHEN id % 11 > 0 THEN 'a' END AS kind", "CAST(id % 3 > 0 AS INT) AS label")
    columns = ["x", "two", "gone"]
    whole = {r.column: r for r in meta.numeric_column_meta(df, columns, "label").collect()}
    for r in meta.numeric_gates(df, columns).collect():
        assert (r.null_pct, r.unique_ratio, r.is_binary) == tuple(whole[r.column][k] for k in ("null_pct", "unique_ratio", "is_binary"))
        assert r.min_value == {"x": 0.0, "two": 0.0, "gone": None}[r.column]
    rows, own = meta.row_meta(df, "label").first(), meta.row_gates(df, "label").first()
    assert tuple(own) == pytest.approx((rows.n_numeric_cols_used, rows.pct_cells_zero, rows.pct_rows_with_any_missing), abs=1e-12)


def test_area_of_few_and_many_scores(spark, monkeypatch):
    scored = spark.range(200).selectExpr("CAST(id % 3 > 0 AS INT) AS label", "CAST((id * 7) % 23 AS DOUBLE) AS score", "id % 4 + 1.0D AS n")
    want = metrics.ranking_metrics(scored, n="n").first().roc_auc
    assert metrics.area(scored, n="n") == pytest.approx(want, abs=1e-12) and metrics.area(scored.where("label = 1")) is None
    monkeypatch.setattr(metrics, "FEW_SCORES", 5)
    assert metrics.area(scored, n="n") == pytest.approx(want, abs=1e-12)


def test_cells_take_few_tasks(spark, monkeypatch):
    df = spark.range(600).repartition(9).selectExpr("id AS key", "CAST(id % 40 AS DOUBLE) AS x", "concat('c', id % 3) AS kind", "CAST((id * 7) % 40 + id % 5 > 22 AS INT) AS label")
    monkeypatch.setattr(collect, "cells", lambda *_: [("numerical", Step("polynomial_square", "x")), ("interaction", Step("group_mean", "x", "kind"))])
    tasks, told, train, codes = [], [], models.train_classifier, models.column_codes
    monkeypatch.setattr(models, "train_classifier", lambda rows, *more: tasks.append(rows.rdd.getNumPartitions()) or train(rows, *more))
    monkeypatch.setattr(models, "column_codes", lambda values: told.append(values) or codes(values))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = collect.collect(df, "label", "key", "d", folds=2, repeats=1, params={"maxIter": 2, "maxDepth": 2}).where(F.col("changed").isNotNull())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got.count() == 4 and len(tasks) == 6 and max(tasks) == 1 and len(told) == 1
