"""Exact quantiles of many columns without all values of a column in one task."""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import joint
from .columns import gathered, number

#: A sketch of this accuracy brackets each quantile of a column of more than BRACKET distinct values; brackets with more values than that are bracketed again.
ACCURACY, BRACKET = 10_000, 5_000_000


def counted(df: DataFrame, columns: dict[str, Column], label: Column | None = None) -> DataFrame:
    """column, v, n: how many rows have each value of each column, null included; with a label: column, v, y, n."""
    made = F.array(*(F.struct(F.lit(c).alias("column"), x.alias("v")) for c, x in columns.items()))
    keys = ["column", "v"] if label is None else ["column", "v", "y"]
    return df.select(*([] if label is None else [label.alias("y")]), F.inline(made)).groupBy(*keys).agg(F.count("*").alias("n"))


def quantiles(df: DataFrame, wanted: dict[str, tuple[float, ...]]) -> dict[str, list[float] | None]:
    """The quantiles of each numeric column, linear between neighbours; None for a column without values (NaN is null).

    Values are counted, and the distinct ones put in order by ranges, in one job for all columns. Columns with so many distinct
    values that this would move about as much as the table itself are bracketed instead.
    """
    asked = {c: points for c, points in wanted.items() if points}
    if not asked:
        return {c: [] for c in wanted}
    kinds = df.agg(*(F.approx_count_distinct(number(c)).alias(f"k{i}") for i, c in enumerate(asked))).first()
    few = {c: p for k, (c, p) in zip(kinds, asked.items(), strict=True) if k <= BRACKET}
    many = {c: p for c, p in asked.items() if c not in few}
    found = {}
    if few:
        values = gathered(counted(df, {c: number(c) for c in few}))
        try:
            found = counted_quantiles(values, few)
        finally:
            values.unpersist()
    found |= _bracketed(df, many) if many else {}
    return {c: found.get(c, []) for c in wanted}


def counted_quantiles(values: DataFrame, wanted: dict[str, tuple[float, ...]]) -> dict[str, list[float] | None]:
    """quantiles() of values (column, v, n), each distinct v of a column once; a null v doesn't count.

    The distinct values are added up by ranges; those in which a quantile's neighbours lie are the only ones that the driver sees.
    """
    own = values.where("v IS NOT NULL")
    points = own.sparkSession.createDataFrame([(c, float(q)) for c, points in wanted.items() for q in sorted(set(points))], "column string, q double")
    totals = own.groupBy("column").agg(F.sum("n").alias("total"))
    at = F.col("q") * (F.col("total") - 1)
    places = totals.join(F.broadcast(points), "column").select("column", "q", "total", F.floor(at).alias("first"), F.ceil(at).alias("last"))  # a row for each quantile
    inside = lambda p: (F.col("upto") - F.col("n") <= F.col(p)) & (F.col(p) < F.col("upto"))
    found = joint.running(own, "column", "v", "n", "upto").join(F.broadcast(places), "column").where(inside("first") | inside("last"))
    ends: dict[tuple[str, float], dict] = {}
    for r in found.select("column", "q", "total", "v", inside("first").alias("is_first"), inside("last").alias("is_last")).collect():
        ends.setdefault((r.column, r.q), {"at": r.q * (r.total - 1)}).update(({"a": r.v} if r.is_first else {}) | ({"b": r.v} if r.is_last else {}))

    def one(c: str, q: float) -> float:
        e = ends[c, float(q)]
        return e["a"] if e["a"] == e["b"] else (math.ceil(e["at"]) - e["at"]) * e["a"] + (e["at"] - math.floor(e["at"])) * e["b"]

    known = {c for c, _ in ends}
    return {c: [one(c, q) for q in own] if c in known else None if own else [] for c, own in wanted.items()}


def _bracketed(df: DataFrame, wanted: dict[str, tuple[float, ...]]) -> dict[str, list[float] | None]:
    """quantiles() of columns of many values: sketches give a bracket around each one, values below and inside it are counted, and only the distinct values inside are put in order."""
    targets = [(c, q) for c, points in wanted.items() for q in points]
    names = list(wanted)
    counts = dict(zip(names, df.agg(*(F.count(number(c)).alias(f"n{i}") for i, c in enumerate(names))).first(), strict=True))
    live = [(c, q * (counts[c] - 1)) for c, q in targets if counts[c]]
    if not live:
        return {c: None for c in wanted}
    lo, hi, below = [-math.inf] * len(live), [math.inf] * len(live), [0] * len(live)
    size = [counts[c] for c, _ in live]
    todo = [k for k in range(len(live)) if size[k] > ACCURACY]
    while todo:
        alike: dict[tuple, list[int]] = {}  # targets of one column with the same bracket share a sketch
        for k in todo:
            alike.setdefault((live[k][0], lo[k], hi[k]), []).append(k)
        ends = []
        for (c, least, most), ks in alike.items():
            places = [(live[k][1] - below[k]) / size[k] for k in ks]
            inside = F.when(number(c).between(least, most), number(c))
            ends.append(F.percentile_approx(inside, [min(1.0, max(0.0, p + gap)) for p in places for gap in (-3 / ACCURACY, 3 / ACCURACY)], ACCURACY).alias(f"e{len(ends)}"))
        reach = {k: (e[2 * j], e[2 * j + 1]) for ks, e in zip(alike.values(), df.agg(*ends).first(), strict=True) for j, k in enumerate(ks)}
        row = df.agg(*(x for k in todo for x in (F.count_if(number(live[k][0]) < reach[k][0]).alias(f"b{k}"), F.count_if(number(live[k][0]).between(*reach[k])).alias(f"s{k}")))).first()
        again = []
        for k in todo:
            held = row[f"b{k}"] <= math.floor(live[k][1]) and math.ceil(live[k][1]) < row[f"b{k}"] + row[f"s{k}"]
            if held and row[f"s{k}"] < size[k]:
                (lo[k], hi[k]), below[k], size[k] = reach[k], row[f"b{k}"], row[f"s{k}"]
                if size[k] > BRACKET and lo[k] < hi[k]:
                    again.append(k)
        todo = again
    between = reduce(or_, (number(c).between(lo[k], hi[k]) for k, (c, _) in enumerate(live)))
    long = df.where(between).select(F.inline(F.array(*(F.struct(F.lit(k).alias("k"), F.when(number(c).between(lo[k], hi[k]), number(c)).alias("v")) for k, (c, _) in enumerate(live))))).where("v IS NOT NULL")
    ordered = Window.partitionBy("k").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    upto = long.groupBy("k", "v").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(ordered))
    first, last = ([F.lit(round_(at) - below[k]) for k, (_, at) in enumerate(live)] for round_ in (math.floor, math.ceil))
    # of the values inside a bracket: the first one that reaches the place before and the place behind the quantile
    reached = lambda at: F.min(F.when(F.col("upto") > F.element_at(F.array(*at), F.col("k") + 1), F.col("v")))
    pairs = {r.k: (r.a, r.b) for r in upto.groupBy("k").agg(reached(first).alias("a"), reached(last).alias("b")).collect()}
    out: dict[str, list[float] | None] = {c: [] if counts[c] else None for c in wanted}
    for k, (c, at) in enumerate(live):
        a, b = pairs[k]
        out[c].append(a if a == b else (math.ceil(at) - at) * a + (at - math.floor(at)) * b)
    return out
