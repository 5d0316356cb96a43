"""Few rows go through the many small jobs of fits in few tasks, and models that don't need each other are fitted side by side."""

from pyspark.ml.regression import GBTRegressor

from tablewright.operators import families, prepare


def test_gathered(spark):
    kept = lambda: {i for i in spark.sparkContext._jsc.getPersistentRDDs()}
    df, had = spark.range(1000).repartition(12), kept()
    for rows, tasks in ((None, 1), (300, 4), (10, 12)):
        few = prepare.gathered(df, rows)
        assert few.rdd.getNumPartitions() == tasks and sorted(r.id for r in few.collect()) == list(range(1000))
        few.unpersist()
        assert kept() == had
    assert prepare.gathered(df.where("id < 0")).count() == 0


def test_family_folds_take_few_tasks(spark, monkeypatch):
    seen, real = [], GBTRegressor.fit
    monkeypatch.setattr(GBTRegressor, "fit", lambda self, rows: seen.append(rows.rdd.getNumPartitions()) or real(self, rows))
    rows = spark.range(400).repartition(9).selectExpr("'log_transform' AS method", "concat('d', id % 12) AS dataset", "CAST(id % 5 AS DOUBLE) AS x", "CAST(id % 5 > 2 AS DOUBLE) - 0.5 AS change")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        found = {n: sorted(families.cross_validated(rows, "numerical", "change", "dataset", ["x"], 3, GBTRegressor(maxIter=2), at_once=n).collect()) for n in (1, 6)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert max(seen) == 1 and found[1] == found[6] and len(found[1]) == 3
    assert all(r.mae < 1e-9 and r.auc == 1 for r in found[1])
