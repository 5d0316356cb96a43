"""Sums by ranges fit the rows, however often the table is read."""

from pyspark.sql import functions as F

from tablewright.functions import joint
from tablewright.operators import profile


def test_running_by_fixed_ranges(spark):
    n = 30_000
    values = spark.range(n).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("key"), ((F.col("id") * 7919) % n).cast("double").alias("v"), (F.col("id") % 4 + 1).alias("n"))
    made = joint.ranged(values, "key", "v", "p")
    ends = made.groupBy("key", "p").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("key", "p").collect()
    assert len(ends) > 8 and all(a.hi < b.lo for a, b in zip(ends, ends[1:], strict=False) if a.key == b.key)
    assert "RangePartitioning" not in made._jdf.queryExecution().toString() and "spark_partition_id" not in joint.running(values, "key", "v", "n", "upto")._jdf.queryExecution().toString().lower()
    got = sorted(joint.running(values, "key", "v", "n", "upto").collect())
    upto: dict = {}
    for r in got:
        upto[r.key] = upto.get(r.key, 0) + r.n
        assert r.upto == upto[r.key]
    texts = spark.range(5_000).select(F.format_string("é%05d", (F.col("id") * 7) % 5_000).alias("v"))
    assert all(r.code == int(r.v[1:]) for r in joint.places(texts, "v", "code").collect())


def test_steps_of_repeated_values(spark):
    df = spark.range(1_000).selectExpr("CAST(id % 100 AS DOUBLE) AS x", "CAST(id AS DOUBLE) AS even", "CASE WHEN id % 2 = 0 THEN 1.0D ELSE 5.0D END AS two")
    got = {r.column: r.cv for r in profile.step_variation(df, ["x", "even", "two"]).collect()}
    d = [0] * 900 + [1] * 99
    mean = sum(d) / len(d)
    assert abs(got["x"] - (sum(x * x for x in d) / len(d) - mean * mean) ** 0.5 / mean) < 1e-9 and abs(got["even"]) < 1e-9
    d = [0] * 998 + [4]
    mean = sum(d) / len(d)
    assert abs(got["two"] - (sum(x * x for x in d) / len(d) - mean * mean) ** 0.5 / mean) < 1e-9
