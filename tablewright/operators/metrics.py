"""Evaluation of scored tables. Curves are cut to distinct scores before any window, and sums over them are exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import joint
from ..functions.columns import gathered

STEPS, LOW, HIGH = 200, 0.01, 0.99


def _rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    precision = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    recall = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    f1 = F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(F.lit(0.0))
    return {"accuracy": (tp + tn) / F.greatest(tp + fp + fn + tn, F.lit(1)), "f1": f1, "precision": precision, "recall": recall}


def _cells(label: Column, chosen: Column) -> list[Column]:
    y = label == 1
    return [F.count_if(y & chosen).alias("tp"), F.count_if(~y & chosen).alias("fp"), F.count_if(y & ~chosen).alias("fn"), F.count_if(~y & ~chosen).alias("tn")]


def metrics_at_threshold(scored: DataFrame, threshold: float, label: str = "label", score: str = "score") -> DataFrame:
    """threshold, tp, fp, fn, tn, positive_rate, accuracy, f1, precision, recall at score >= threshold. Rows with nulls don't count."""
    own = scored.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    cells = own.agg(*_cells(F.col(label), F.col(score) >= threshold))
    n = F.greatest(F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"), F.lit(1))
    return cells.select(F.lit(threshold).alias("threshold"), "tp", "fp", "fn", "tn", ((F.col("tp") + F.col("fp")) / n).alias("positive_rate"), *(c.alias(k) for k, c in _rates(*map(F.col, ("tp", "fp", "fn", "tn"))).items()))


def threshold_curve(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """threshold, accuracy, f1, precision, recall at STEPS thresholds. Rows are counted by how many thresholds they reach, then added up over these."""
    width = (HIGH - LOW) / (STEPS - 1)
    points = scored.sparkSession.range(STEPS).select("id", (F.lit(LOW) + F.col("id") * width).alias("threshold"))
    s = F.col(score)
    k = F.floor((s - LOW) / width).cast("long")
    reached = k + F.when(s >= LOW + (k + 1) * width, 1).when(s < LOW + k * width, -1).otherwise(0)  # division may round across a threshold
    counted = scored.where(F.col(label).isNotNull() & s.isNotNull()).groupBy(F.greatest(F.lit(-1), F.least(F.lit(STEPS - 1), reached)).alias("reached")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("q"))
    above = Window.orderBy(F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = points.unionByName(scored.sparkSession.range(1).select(F.lit(-1).cast("long").alias("id"), F.lit(-1.0).alias("threshold"))).join(F.broadcast(counted), F.col("id") == F.col("reached"), "left")
    p, q = F.coalesce("p", F.lit(0)), F.coalesce("q", F.lit(0))
    sums = rows.select("id", "threshold", F.sum(p).over(above).alias("tp"), F.sum(q).over(above).alias("fp"), F.sum(p).over(every).alias("np"), F.sum(q).over(every).alias("nq")).where("id >= 0")
    made = _rates(F.col("tp"), F.col("fp"), F.col("np") - F.col("tp"), F.col("nq") - F.col("fp"))
    return sums.select("threshold", *(c.alias(x) for x, c in made.items()))


def optimal_thresholds(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """metric, threshold, value: the first threshold with the best value of each metric; 0.5 and 0 where it is nowhere above 0."""
    curve = threshold_curve(scored, label, score)
    long = curve.select("threshold", F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("accuracy", "f1", "precision", "recall")))))
    best = long.groupBy("metric").agg(F.max(F.struct("value", (-F.col("threshold")).alias("t"))).alias("b"))
    return best.select("metric", F.when(F.col("b.value") > 0, -F.col("b.t")).otherwise(F.lit(0.5)).alias("threshold"), F.col("b.value").alias("value"))


def score_counts(scored: DataFrame, label: str = "label", score: str = "score", n: str | None = None) -> DataFrame:
    """score, p, q: positives and negatives at each distinct score. n: the column that says how many rows each row stands for."""
    of = lambda when: F.coalesce(F.sum(F.when(when, F.col(n))), F.lit(0)).cast("long") if n else F.count_if(when)
    return scored.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(of(F.col(label) == 1).alias("p"), of(F.col(label) != 1).alias("q"))


def cumulated(counts: DataFrame, blocks: int = 256) -> DataFrame:
    """score_counts with tp and fp at score and above, and the totals np and nq.

    Scores go to ranges; each range is cumulated by itself and gets the sums of the ranges above, so no task sees all scores.
    """
    parts = joint.ranged(counts.withColumn("__key", F.lit("")), "__key", "score", "block").drop("__key")
    inside = Window.partitionBy("block").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    rows = parts.select("*", F.sum("p").over(inside).alias("ip"), F.sum("q").over(inside).alias("iq"))
    sums = rows.groupBy("block").agg(F.max("ip").alias("bp"), F.max("iq").alias("bq"), F.max("score").alias("top"))
    before = Window.orderBy(F.desc("top")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = sums.select("block", F.coalesce(F.sum("bp").over(before), F.lit(0)).alias("op"), F.coalesce(F.sum("bq").over(before), F.lit(0)).alias("oq"), F.sum("bp").over(every).alias("np"), F.sum("bq").over(every).alias("nq"))
    return rows.join(F.broadcast(offsets), "block").select("score", "p", "q", (F.col("ip") + F.col("op")).alias("tp"), (F.col("iq") + F.col("oq")).alias("fp"), "np", "nq")


def roc_points(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """threshold, fpr, tpr: every distinct score, and the point (0, 0) above them (infinite threshold)."""
    c = cumulated(score_counts(scored, label, score))
    zero = scored.sparkSession.range(1).select(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return c.select(F.col("score").alias("threshold"), F.when(F.col("nq") > 0, F.col("fp") / F.col("nq")).otherwise(F.lit(0.0)).alias("fpr"), F.when(F.col("np") > 0, F.col("tp") / F.col("np")).otherwise(F.lit(0.0)).alias("tpr")).unionByName(zero)


def pr_points(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """threshold, precision, recall at every distinct score."""
    c = cumulated(score_counts(scored, label, score))
    return c.select(F.col("score").alias("threshold"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.when(F.col("np") > 0, F.col("tp") / F.col("np")).otherwise(F.lit(0.0)).alias("recall"))


def ranking_metrics(scored: DataFrame, label: str = "label", score: str = "score", n: str | None = None) -> DataFrame:
    """roc_auc (ties count half; null with one class only) and average_precision. n: as score_counts()."""
    return ranked(score_counts(scored, label, score, n))


def ranked(counts: DataFrame) -> DataFrame:
    """ranking_metrics() of score_counts()."""
    c = cumulated(counts)
    below = F.col("nq") - F.col("fp")
    auc = F.sum(F.col("p") * (below + F.col("q") / 2)) / F.max(F.col("np") * F.col("nq"))
    ap = F.sum(F.col("p") / F.col("np") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return c.agg(F.when((F.max("np") > 0) & (F.max("nq") > 0), auc).alias("roc_auc"), F.when(F.max("np") > 0, ap).alias("average_precision"))


#: Distinct scores up to which area() adds up their counts by itself.
FEW_SCORES = 1_000


def area(scored: DataFrame, label: str = "label", score: str = "score", n: str | None = None) -> float | None:
    """The roc_auc of ranking_metrics(), now. Few trees give few distinct scores, whose counts need no ranges; the counts of more are never brought together."""
    counts = score_counts(scored, label, score, n)
    first = counts.orderBy("score").limit(FEW_SCORES + 1).collect()
    if len(first) > FEW_SCORES:
        held = gathered(counts)
        try:
            return ranked(held).first().roc_auc
        finally:
            held.unpersist()
    p, q, below, above = sum(r.p for r in first), sum(r.q for r in first), 0, 0.0
    for r in first:
        above += r.p * (below + r.q / 2)
        below += r.q
    return above / (p * q) if p and q else None


def multiclass_auc(scored: DataFrame, classes: list[str], label: str = "label") -> DataFrame:
    """roc_auc: one against the rest, weighted by the classes' shares. Scores of class c are in prob_c; one pass over all classes."""
    long = scored.select(F.inline(F.array(*(F.struct(F.lit(c).alias("c"), (F.col(label) == c).cast("int").alias("y"), F.col(f"prob_{c}").alias("s")) for c in classes))))
    counts = long.groupBy("c", "s").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q"))
    # the average rank of a score among the negatives is half a place above their number below, ties counting half
    ranks = joint.average_ranks(counts.select("c", "s", "q"), "c", "s", "q", "r")
    each = counts.join(ranks, ["c", "s"]).withColumn("u", F.col("p") * (F.col("r") - 0.5)).groupBy("c").agg(F.sum("u").alias("u"), F.sum("p").alias("np"), F.sum("q").alias("nq"))
    return each.where("np > 0 AND nq > 0").agg((F.sum(F.col("u") / F.col("nq")) / F.sum("np")).alias("roc_auc"))


def confusion(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return scored.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("n"))


def class_metrics(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """accuracy, f1, precision, recall, the last three weighted by the classes' rows. From confusion counts only."""
    cells = confusion(scored, label, prediction)
    right = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    long = cells.select(F.inline(F.array(F.struct(F.col("label").alias("c"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("said"), right.cast("long").alias("tp")), F.struct(F.col("prediction").alias("c"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("said"), F.lit(0).cast("long").alias("tp")))))
    each = long.groupBy("c").agg(F.sum("actual").alias("a"), F.sum("said").alias("s"), F.sum("tp").alias("t"))
    a, s, t = F.col("a"), F.col("s"), F.col("t")
    p, r = F.when(s > 0, t / s).otherwise(F.lit(0.0)), F.when(a > 0, t / a).otherwise(F.lit(0.0))
    f = F.when(a + s > 0, 2 * t / (a + s)).otherwise(F.lit(0.0))
    return each.agg((F.sum(t) / F.sum(a)).alias("accuracy"), (F.sum(f * a) / F.sum(a)).alias("f1"), (F.sum(p * a) / F.sum(a)).alias("precision"), (F.sum(r * a) / F.sum(a)).alias("recall"))


def log_loss(scored: DataFrame, label: str = "label", score: str = "score", eps: float = 2.220446049250313e-16) -> DataFrame:
    p = F.least(F.lit(1 - eps), F.greatest(F.lit(eps), F.col(score)))
    return scored.where(F.col(label).isNotNull() & F.col(score).isNotNull()).agg(F.avg(-F.log(F.when(F.col(label) == 1, p).otherwise(1 - p))).alias("log_loss"))


def prediction_shares(scored: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    """threshold, predicted, n, share at the threshold and at 0.5."""
    own = scored.where(F.col(score).isNotNull())
    at = F.inline(F.array(*(F.struct(F.lit(t).alias("threshold"), (F.col(score) >= t).cast("int").alias("predicted")) for t in dict.fromkeys((threshold, 0.5)))))
    counts = own.select(at).groupBy("threshold", "predicted").agg(F.count("*").alias("n"))
    return counts.select("*", (F.col("n") / F.sum("n").over(Window.partitionBy("threshold"))).alias("share"))


def histogram(scored: DataFrame, value: str, bins: int = 50, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """bin (from 0; the highest value is in the last), lower, n of non-empty bins."""
    width = (high - low) / bins
    k = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col(value) - low) / width)))
    return scored.where(F.col(value).isNotNull()).groupBy(k.cast("int").alias("bin")).agg(F.count("*").alias("n")).select("bin", (low + F.col("bin") * width).alias("lower"), "n")


def compared(baseline: DataFrame, enhanced: DataFrame) -> DataFrame:
    """metric, baseline, enhanced, delta, winner of two tables (metric, value); a lower log_loss wins. A tie has no winner (tie)."""
    both = baseline.select("metric", F.col("value").alias("baseline")).join(enhanced.select("metric", F.col("value").alias("enhanced")), "metric")
    delta = F.col("enhanced") - F.col("baseline")
    gain = F.when(F.col("metric") == "log_loss", -delta).otherwise(delta)
    return both.select("*", delta.alias("delta"), F.when(gain > 0, "enhanced").when(gain < 0, "baseline").otherwise("tie").alias("winner"))


def headroom_captured(baseline_auc: Column, enhanced_auc: Column) -> Column:
    """Percent of what was missing to a perfect AUC."""
    return (enhanced_auc - baseline_auc) / F.greatest(1 - baseline_auc, F.lit(0.001)) * 100
