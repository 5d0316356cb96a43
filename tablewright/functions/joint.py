"""What pairs of expressions have in common, for many pairs in one job: counts, mutual information, ranks and their correlation, Pearson's correlation.

Work is in long form (id, x, y): a group is a value of one pair, never a pair as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

Pair = tuple[str, Column, Column]


def counts(df: DataFrame, pairs: list[Pair]) -> DataFrame:
    """id, x, y, c: how often the two values stand together, of complete rows. All x are of one type, and all y."""
    made = F.array(*(F.struct(F.lit(i).alias("id"), x.alias("x"), y.alias("y")) for i, x, y in pairs))
    return df.select(F.inline(made)).where("x IS NOT NULL AND y IS NOT NULL").groupBy("id", "x", "y").agg(F.count("*").alias("c"))


def information(cells: DataFrame) -> DataFrame:
    """id, n, mi (nats), entropy_y (bits), n_x, n_y, n_cells of counts()."""
    one = lambda k: cells.groupBy("id", k).agg(F.sum("c").alias(f"c{k}"))
    total = cells.groupBy("id").agg(F.sum("c").alias("n"), F.count("*").alias("n_cells"), F.sum(F.col("c") * F.log("c")).alias("cc"))
    # sum c/n log(c n / (cx cy)) = (sum c log c - sum cx log cx - sum cy log cy) / n + log n
    side = lambda k: one(k).groupBy("id").agg(F.count("*").alias(f"n_{k}"), F.sum(F.col(f"c{k}") * F.log(f"c{k}")).alias(f"s{k}"))
    both = total.join(side("x"), "id").join(side("y"), "id")
    mi = F.greatest(F.lit(0.0), (F.col("cc") - F.col("sx") - F.col("sy")) / F.col("n") + F.log("n"))
    return both.select("id", "n", mi.alias("mi"), F.greatest(F.lit(0.0), (F.log("n") - F.col("sy") / F.col("n")) / F.log(F.lit(2.0))).alias("entropy_y"), "n_x", "n_y", "n_cells")


#: Ranges of one key at most, and values looked at to place their borders: one in SAMPLED, by hash, up to SAMPLE of them.
RANGES, SAMPLED, SAMPLE = 64, 64, 20_000


def ranged(values: DataFrame, key: str, v: str, to: str) -> DataFrame:
    """values with `to`, the number of the range of its key in which v lies: ranges of some hundred values or more, in order.

    Borders are fixed once on the driver. A range partition's number is none to rely on where a table is read twice: it is
    sampled, or drawn together, anew each time, and sums by number then don't fit the rows.
    """
    some = values.select(key, v).where((F.pmod(F.xxhash64(key, v), F.lit(SAMPLED)) == 0) & F.col(v).isNotNull()).limit(SAMPLE).collect()
    of: dict = {}
    for k, x in some:
        of.setdefault(k, []).append(x)
    step = max(4, -(-len(some) // RANGES))
    borders = [(k, own[step::step]) for k, own in ((k, sorted(xs)) for k, xs in of.items()) if len(own) > step]
    if not borders:
        return values.withColumn(to, F.lit(0))
    kinds = values.schema
    known = values.sparkSession.createDataFrame(borders, T.StructType([T.StructField("__k", kinds[key].dataType), T.StructField("__b", T.ArrayType(kinds[v].dataType))]))
    place = F.coalesce(F.size(F.filter("__b", lambda b: b < F.col(v))), F.lit(0))
    return values.join(F.broadcast(known), F.col(key) == F.col("__k"), "left").withColumn(to, F.when(F.col("__b").isNotNull(), place).otherwise(F.lit(0))).drop("__k", "__b")


def running(values: DataFrame, key: str, v: str, n: str, to: str) -> DataFrame:
    """key, v, n and `to`: how many rows of its key have that distinct v (of n rows each) or a smaller one.

    Values are dealt to ranges; each is added up by itself and gets the count of the ranges below. No window holds a whole key.
    """
    parts = ranged(values.select(key, v, n), key, v, "__p")
    own = parts.withColumn("__upto", F.sum(n).over(Window.partitionBy(key, "__p").orderBy(v).rowsBetween(Window.unboundedPreceding, 0)))
    sums = parts.groupBy(key, "__p").agg(F.sum(n).alias("__t"))
    below = sums.select(key, "__p", F.coalesce(F.sum("__t").over(Window.partitionBy(key).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__below"))
    # a row for each key and range: the keys are columns or pairs of them
    return own.join(F.broadcast(below), [key, "__p"]).select(key, v, n, (F.col("__below") + F.col("__upto")).alias(to))


def average_ranks(values: DataFrame, key: str, v: str, n: str, to: str) -> DataFrame:
    """key, v and `to`: the average rank of each distinct v (of n rows each) among the rows of its key, by ranges as running()."""
    return running(values, key, v, n, "__upto").select(key, v, (F.col("__upto") - (F.col(n) - 1) / 2).alias(to))


def places(values: DataFrame, v: str, to: str) -> DataFrame:
    """v and `to` (double): the place of each of the distinct values, from 0, in order."""
    return average_ranks(values.select(F.lit("").alias("id"), v, F.lit(1).alias("n")), "id", v, "n", "r").select(v, (F.col("r") - 1).cast("double").alias(to))


def rank_correlations(cells: DataFrame) -> DataFrame:
    """id, n, spearman (null if a side doesn't vary) of counts()."""
    rx, ry = (average_ranks(cells.groupBy("id", k).agg(F.sum("c").alias("n")), "id", k, "n", f"r{k}") for k in ("x", "y"))
    c, x, y = F.col("c"), F.col("rx"), F.col("ry")
    sums = cells.join(rx, ["id", "x"]).join(ry, ["id", "y"]).groupBy("id").agg(F.sum(c).alias("n"), F.sum(c * x).alias("sx"), F.sum(c * y).alias("sy"), F.sum(c * x * x).alias("sxx"), F.sum(c * y * y).alias("syy"), F.sum(c * x * y).alias("sxy"))
    n, sx, sy, sxx, syy, sxy = map(F.col, ("n", "sx", "sy", "sxx", "syy", "sxy"))
    under = (n * sxx - sx * sx) * (n * syy - sy * sy)
    return sums.select("id", "n", F.when(under > 0, (n * sxy - sx * sy) / F.sqrt(under)).alias("spearman"))


def correlations(df: DataFrame, pairs: list[Pair]) -> DataFrame:
    """id, n, pearson (null if a side doesn't vary) of complete rows. Values are taken from a mean found first, and only their products are summed.

    Sides without nulls share their sums; all sums are one aggregate without a shuffle of rows.
    """
    sides: dict[str, Column] = {str(x): x for p in pairs for x in p[1:]}
    names = {k: i for i, k in enumerate(sides)}
    first = df.agg(F.count("*").alias("n"), *(F.count(x).alias(f"n{names[k]}") for k, x in sides.items()), *(F.avg(x).alias(f"m{names[k]}") for k, x in sides.items())).first()
    total = first["n"]
    far = {k: x - F.lit(float(first[f"m{i}"] or 0.0)) for (k, x), i in zip(sides.items(), names.values(), strict=True)}
    whole = {k for k, i in names.items() if first[f"n{i}"] == total}
    own = df.select(*(far[k].alias(f"x{i}") for k, i in names.items()))
    aggregates = [F.sum(F.col(f"x{i}")).alias(f"s{i}") for k, i in names.items() if k in whole] + [F.sum(F.col(f"x{i}") * F.col(f"x{i}")).alias(f"q{i}") for k, i in names.items() if k in whole]
    made = []
    for j, (_, x, y) in enumerate(pairs):
        (a, i), (b, k) = ((str(s), names[str(s)]) for s in (x, y))
        p = F.col(f"x{i}") * F.col(f"x{k}")
        aggregates.append(F.sum(p).alias(f"p{j}"))
        if a in whole and b in whole:
            made.append((F.lit(total), F.col(f"s{i}"), F.col(f"s{k}"), F.col(f"q{i}"), F.col(f"q{k}")))
        else:
            ok = F.col(f"x{i}").isNotNull() & F.col(f"x{k}").isNotNull()
            u, v = F.when(ok, F.col(f"x{i}")), F.when(ok, F.col(f"x{k}"))
            aggregates += [F.count(u).alias(f"n{j}"), F.sum(u).alias(f"u{j}"), F.sum(v).alias(f"v{j}"), F.sum(u * u).alias(f"uu{j}"), F.sum(v * v).alias(f"vv{j}")]
            made.append(tuple(F.col(f"{c}{j}") for c in ("n", "u", "v", "uu", "vv")))
    row = own.agg(*aggregates)

    def r(j: int) -> Column:
        n, sx, sy, sxx, syy = made[j]
        vx, vy = sxx - sx * sx / n, syy - sy * sy / n
        return F.when((n > 1) & (vx > 1e-14 * F.abs(sxx)) & (vy > 1e-14 * F.abs(syy)), (F.col(f"p{j}") - sx * sy / n) / F.sqrt(vx * vy))

    return row.select(F.inline(F.array(*(F.struct(F.lit(i).alias("id"), made[j][0].cast("long").alias("n"), r(j).alias("pearson")) for j, (i, _, _) in enumerate(pairs)))))
