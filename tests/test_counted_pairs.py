"""Pairs of the most important columns come from a profile that is worked out once."""

from pyspark.sql import functions as F

from tablewright.operators import candidates


def test_profile_of_pairs_is_worked_out_once(spark):
    own = spark.range(4).selectExpr("concat('c', id) AS column", "id < 3 AS numeric", "CAST(id AS DOUBLE) AS importance", "0.0D AS unique_ratio")
    pool = candidates.pair_pool(own)
    assert sorted((r.a, r.b, r.kind) for r in pool.collect()) == [("c0", "c3", "nc"), ("c1", "c0", "nn"), ("c1", "c3", "nc"), ("c2", "c0", "nn"), ("c2", "c1", "nn"), ("c2", "c3", "nc")]
    assert "Range (" not in pool._jdf.queryExecution().optimizedPlan().toString()
    df = spark.range(40).select(F.col("id").alias("a"), (F.col("id") * 2.5).alias("b"), F.lit(None).cast("string").alias("gone"))
    assert {(r.a, r.b): r.near_bijection for r in candidates.near_bijections(df, [("a", "b"), ("a", "gone")]).collect()} == {("a", "b"): True, ("a", "gone"): False}
