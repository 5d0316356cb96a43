"""Rows that are alike count as often as they stand there, though estimators see them once."""

from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import functions as F

from tablewright.operators import families


def test_measures_of_counted_rows(spark):
    rows = spark.range(60).selectExpr("CAST(id % 2 AS INT) AS fold", "CAST(id % 7 AS DOUBLE) AS label", "CAST(id % 7 > 3 AS DOUBLE) AS positive", "CAST((id * 3) % 5 AS DOUBLE) AS said", "CAST((id * 3) % 5 AS DOUBLE) AS rank", "(id * 3) % 5 > 2 AS yes", "id % 3 + 1 AS n")
    few = rows.withColumn("n", F.col("n").cast("double"))
    each = rows.select("*", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("i")).drop("n", "i")
    want = {r.fold: r for r in families.measures(each).collect()}
    for r in families.measures(few).collect():
        assert all(abs(a - b) < 1e-9 for a, b in zip(r, want[r.fold], strict=True))
    assert families.takes_counts(GBTRegressor()) and families.takes_counts(LinearRegression())
    assert not families.takes_counts(GBTRegressor(minInstancesPerNode=5)) and not families.takes_counts(GBTRegressor(subsamplingRate=0.5))
