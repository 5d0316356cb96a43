"""Statistics from counted values: right for repeated values, and worked out once."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tablewright.functions import quantiles as module
from tablewright.operators import meta, pairs


def test_counted_quantiles_and_meta(spark, monkeypatch):
    def fail(*_):
        raise AssertionError("few values need no sketch")

    monkeypatch.setattr(module, "_bracketed", fail)
    rng, points = np.random.default_rng(5), tuple(i / 20 for i in range(1, 20))
    x, y = np.round(np.exp(rng.normal(size=20_000)), 1), rng.integers(0, 2, 20_000)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "c": 2.5, "y": y})).withColumn("gone", F.lit(None).cast("double"))
    got = module.quantiles(df, {"x": points, "c": points, "gone": (0.5,)})
    assert got["gone"] is None and np.allclose(got["x"], np.quantile(x, points), rtol=1e-12) and set(got["c"]) == {2.5}
    row = {r.column: r for r in meta.numeric_column_meta(df, ["x", "c", "gone"], "y", with_mi=True).collect()}
    q1, q3 = np.quantile(x, (0.25, 0.75))
    assert abs(row["x"].skewness - pd.Series(x).skew()) < 1e-3 and abs(row["x"].outlier_ratio - np.mean((x < q1 - 1.5 * (q3 - q1)) | (x > q3 + 1.5 * (q3 - q1)))) < 1e-12
    assert abs(row["x"].spearman_corr_target - abs(pd.Series(x).rank().corr(pd.Series(y).rank()))) < 1e-9 and row["x"].unique_ratio == len(set(x)) / len(x)
    assert row["c"].skewness == 0 and row["c"].coeff_variation == 0 and row["gone"].null_pct == 1 and row["gone"].entropy == 0
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_bins_of_pairs(spark):
    x = np.arange(1, 1001) % 100 + 1.0
    df = spark.createDataFrame(pd.DataFrame({"x": x, "z": x})).withColumn("z", F.when(F.col("z") > 10, F.col("z")))
    own, codes = pairs.coded(df, ["x", "z"])
    bins = min(20, max(5, int(1000**0.4)))
    filled = np.where(x > 10, x, np.median(x[x > 10]))
    want = {c: [str(int(sum(v > np.unique(np.quantile(values, [i / bins for i in range(1, bins)]))))) for v in values] for c, values in (("x", x), ("z", filled))}
    rows = own.select("x", codes["x"].alias("a"), codes["z"].alias("b")).distinct().collect()
    assert {(r.x, r.a, r.b) for r in rows} == set(zip(x, want["x"], want["z"], strict=True))
