"""Dates in text: right for repeated values, and read once."""

from tablewright.functions import dates
from tablewright.operators import candidates, profile


def test_dates_are_read_once(spark):
    rows = [("2024-01-02 10:00:00", "x")] * 6 + [("2024-01-03 11:00:00", None)] * 3 + [("2024-01-04 00:00:00", "x"), (None, "x")]
    df = spark.createDataFrame(rows, "moment string, other string")
    found = {r.column: r for r in profile.date_stats(df).collect()}
    m = found["moment"]
    assert (m.n, m.parse_rate, m.hour_share, m.n_days, m.kind) == (10, 1.0, 0.9, 3, "datetime") and (found["other"].n, found["other"].n_days, found["other"].kind) == (8, 0, None)
    empty = profile.date_stats(df.limit(0)).collect()
    assert [(r.n, r.n_days, r.kind) for r in empty] == [(0, 0, None)] * 2
    made = candidates.date_suggestions(spark.range(1).selectExpr("'a' AS column", "'datetime' AS kind"))
    assert made.count() == 5 and made._jdf.queryExecution().optimizedPlan().toString().count("Range (") <= 1
    days = spark.createDataFrame([("a", "1/2/2024", 2), ("a", "25/2/2024", 1)], "column string, text string, n long")
    assert dates.counted_day_first(days, ["a", "none"]) == {"a": True, "none": False}
