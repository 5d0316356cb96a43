"""Experiments on rows that are counted first: the same effects as on single rows, and tests that workers can run by themselves."""

import subprocess
import sys

import pytest
from pyspark import cloudpickle

from tablewright.operators import experiments, models
from tablewright.operators.transforms import Step
from tablewright.plans import collect


def test_cells_as_one_by_one(spark, monkeypatch):
    df = spark.range(600).selectExpr("id AS key", "CASE WHEN id % 13 > 0 THEN CAST(id % 40 AS DOUBLE) END AS x", "concat('c', id % 3) AS kind", "CAST((id * 7) % 40 + 9 * (id % 3) + id % 5 > 27 AS INT) AS label")
    steps = [("numerical", Step("polynomial_square", "x")), ("categorical", Step("target_encoding", "kind")), ("interaction", Step("group_mean", "x", "kind"))]
    monkeypatch.setattr(collect, "cells", lambda *_: steps)
    params, made = {"maxIter": 2, "maxDepth": 2}, []
    real = models.train_classifier
    monkeypatch.setattr(models, "train_classifier", lambda rows, *more: made.append(rows.count()) or real(rows, *more))
    got = {(r.method, r.fold): (r.baseline, r.changed) for r in collect.collect(df, "label", "key", "d", folds=2, repeats=1, params=params, at_once=1).collect()}
    assert len(got) == 6 and max(made) < 300  # about 300 rows a side, of which at most 240 differ
    monkeypatch.setattr(collect, "takes_counts", lambda _: False)
    for _, s in steps:
        for r in collect.evaluate_with_intervention(df, "label", "key", [s], 2, 1, params).collect():
            assert got[s.method, r.fold][1] == pytest.approx(r.score, abs=1e-9)
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_p_values_travel_whole(tmp_path):
    (tmp_path / "f").write_bytes(cloudpickle.dumps(experiments.p_value.func))
    code = "import pickle, pandas as pd; print(pickle.load(open('f', 'rb'))(pd.Series([2.0]), pd.Series([4.0]))[0])"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": ""}, capture_output=True, text=True, timeout=60)
    assert done.returncode == 0 and abs(float(done.stdout) - 0.11611652351681561) < 1e-9
