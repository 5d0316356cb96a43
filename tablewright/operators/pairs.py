"""Meta-features of pairs of columns of all kinds: two numeric ones, one of each, two categories.

A feature that a kind doesn't have is ONE_STEP (one column of another kind would give it) or TWO_STEPS. Mutual information is
that of quantile bins of the numeric columns, nulls filled by the median, and of values as text in the others, nulls as `nan`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import joint
from ..functions.columns import category, number, numeric_columns, quoted
from ..functions.quantiles import counted, counted_quantiles
from .meta import ONE_STEP, TWO_STEPS, _entropy, bin_edges, counted_entropy, kept, moments

# Names of the features, in the order of the family's vector.
FEATURES = (
    "n_numerical_cols", "pearson_corr", "spearman_corr", "mutual_info_pair", "mic_score", "scale_ratio", "sum_importance", "max_importance", "min_importance", "sum_null_pct", "max_null_pct", "sum_unique_ratio", "abs_diff_unique_ratio", "sum_entropy", "abs_diff_entropy",
    "sum_target_corr", "abs_diff_target_corr", "sum_mi_target", "abs_diff_mi_target", "both_binary", "product_of_means", "abs_mean_ratio", "sum_cv", "abs_diff_cv", "sum_skewness", "abs_diff_skewness", "sign_concordance", "n_positive_means",
    "eta_squared", "anova_f_stat", "n_groups", "cramers_v", "joint_cardinality", "cardinality_ratio", "joint_sparsity",
)
_TWO_NUMBERS = ("pearson_corr", "spearman_corr", "scale_ratio", "sum_target_corr", "abs_diff_target_corr", "product_of_means", "abs_mean_ratio", "sum_cv", "abs_diff_cv", "sum_skewness", "abs_diff_skewness", "sign_concordance", "n_positive_means")
_MIXED, _TWO_CATEGORIES = ("eta_squared", "anova_f_stat", "n_groups"), ("cramers_v", "joint_cardinality", "cardinality_ratio", "joint_sparsity")
_FEW = 10


def coded(df: DataFrame, columns: list[str], values: DataFrame | None = None) -> tuple[DataFrame, dict[str, Column]]:
    """df with a code of each column, and the codes: text of few values for information(). It is the quantile bin of a number, nulls filled by the median, or the value itself, nulls as `nan`.

    values: counted() numbers of df (column, v, n), where they are known.
    """
    numbers = set(numeric_columns(df))
    numeric = [c for c in columns if c in numbers]
    place = {c: category(c) for c in columns if c not in numbers}
    if numeric:
        own = counted(df, {c: number(c) for c in numeric}).persist() if values is None else values
        try:
            total = own.where(F.col("column") == numeric[0]).agg(F.sum("n")).first()[0] or 0
            bins = min(20, max(5, int(total**0.4)))
            medians = {c: float(m[0]) if m else 0.0 for c, m in counted_quantiles(own, {c: (0.5,) for c in numeric}).items()}
            middle = F.create_map(*(F.lit(x) for pair in medians.items() for x in pair))[F.col("column")]
            edges = bin_edges(own.groupBy("column", F.coalesce("v", middle).alias("v")).agg(F.sum("n").alias("n")), numeric, bins)
        finally:
            if values is None:
                own.unpersist()
        place |= {c: _below(F.coalesce(number(c), F.lit(medians[c])), edges[c]).cast("string") for c in numeric}
    names = {c: f"__code{i}" for i, c in enumerate(columns)}
    return df.select("*", *(place[c].alias(names[c]) for c in columns)), {c: F.col(names[c]) for c in columns}


def _below(x: Column, edges: list[float]) -> Column:
    """How many of the edges are below x. A constant array keeps the code of many columns short enough to be compiled."""
    return F.size(F.filter(F.array(*map(F.lit, edges)).cast("array<double>"), lambda e: x > e))


def _column_facts(cells: DataFrame, values: DataFrame, texts: DataFrame | None, told: DataFrame) -> DataFrame:
    """column, and what a pair's features take from one side. cells (column, v, y, n) and values (column, v, n) of the numbers, texts (column, v, n) of the others, told: column and mi_target of all."""
    names = ("column", "n_rows", "n", "n_unique", "mean", "std", "skew", "entropy", "target_corr")
    target = cells.select(F.col("column").alias("id"), F.col("v").alias("x"), number("y").alias("y"), F.col("n").alias("c")).where("x IS NOT NULL AND y IS NOT NULL").groupBy("id", "x", "y").agg(F.sum("c").alias("c"))
    ranks = joint.rank_correlations(target).select(F.col("id").alias("column"), F.when(F.col("n") > _FEW, F.coalesce(F.abs("spearman"), F.lit(0.0))).otherwise(F.lit(0.0)).alias("target_corr"))
    facts = moments(values).join(F.broadcast(counted_entropy(values)), "column", "left").join(F.broadcast(ranks), "column", "left").withColumn("skew", F.coalesce("skewness", F.lit(0.0))).select(*names)
    if texts is not None:
        known = texts.where("v IS NOT NULL")
        own = texts.groupBy("column").agg(F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)).alias("n"), F.count("v").alias("n_unique"))
        own = own.join(F.broadcast(_entropy(known.withColumnRenamed("n", "c"))), "column", "left")
        none = F.lit(None).cast("double")
        facts = facts.unionByName(own.withColumns({"mean": none, "std": none, "skew": F.lit(0.0), "target_corr": F.lit(0.0)}).select(*names))
    return facts.join(F.broadcast(told), "column", "left").fillna(0.0, ["entropy", "mi_target", "target_corr"]).fillna(0, ["n_unique"])


def _groups(df: DataFrame, mixed: list[tuple[str, str, str]]) -> DataFrame:
    """id and the sums of squares of mixed pairs (id, numeric, category), from the moments of each group."""
    made = F.array(*(F.struct(F.lit(i).alias("id"), number(a).alias("v"), quoted(b).cast("string").alias("g")) for i, a, b in mixed))
    groups = df.select(F.inline(made)).where("v IS NOT NULL").groupBy("id", "g").agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s"))
    grand = groups.groupBy("id").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("gm"))
    some = groups.where("n > 1 AND g IS NOT NULL").groupBy("id").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("bm"))
    # a row for each pair on the right
    each = groups.join(F.broadcast(grand), "id").join(F.broadcast(some), "id", "left")
    d, e = F.col("m") - F.col("gm"), F.col("m") - F.col("bm")
    known, big = F.col("g").isNotNull(), F.col("g").isNotNull() & (F.col("n") > 1)
    sums = each.groupBy("id").agg(
        F.sum(F.when(known, F.col("n") * d * d)).alias("between"), F.sum(F.col("n") * (F.col("s") + d * d)).alias("total"),
        F.count_if(big).alias("k"), F.sum(F.when(big, F.col("n"))).alias("bn"), F.sum(F.when(big, F.col("n") * e * e)).alias("bb"), F.sum(F.when(big, F.col("n") * F.col("s"))).alias("bw"),
    )
    f = (F.col("bb") / (F.col("k") - 1)) / (F.col("bw") / (F.col("bn") - F.col("k")))
    return sums.select("id", (F.coalesce("between", F.lit(0.0)) / (F.col("total") + 1e-10)).alias("eta_squared"), F.when((F.col("k") >= 2) & (F.col("bn") > F.col("k")) & (F.col("bw") > 0), f).otherwise(F.lit(0.0)).alias("anova_f_stat"))


def _contingency(cells: DataFrame) -> DataFrame:
    """id, observed (cells that occur), cramers_v of counts() of two categories; Yates' correction on 2 x 2."""
    rows, cols = cells.groupBy("id", "x").agg(F.sum("c").alias("rx")), cells.groupBy("id", "y").agg(F.sum("c").alias("ry"))
    kinds = rows.groupBy("id").agg(F.sum("rx").alias("n"), F.count("*").alias("kx")).join(cols.groupBy("id").agg(F.count("*").alias("ky")), "id")
    e = F.col("rx") * F.col("ry") / F.col("n")
    gap = F.abs(F.col("c") - e)
    yates = F.greatest(F.lit(0.0), gap - F.least(F.lit(0.5), gap))
    sums = cells.join(rows, ["id", "x"]).join(cols, ["id", "y"]).join(F.broadcast(kinds), "id").groupBy("id", "n", "kx", "ky").agg(F.count("*").alias("observed"), F.sum(F.col("c") * F.col("c") / e).alias("s"), F.sum(yates * yates / e).alias("w"), F.sum(e).alias("es"), F.max(gap).alias("gap"))
    # cells that don't occur add their expectation; of a 2 x 2 table, all gaps are alike, so each adds the same
    k, two = F.least("kx", "ky") - 1, (F.col("kx") == 2) & (F.col("ky") == 2)
    lost = F.greatest(F.lit(0.0), F.col("gap") - F.least(F.lit(0.5), F.col("gap")))
    absent = F.when((F.col("observed") < 4) & (F.col("gap") > 0), lost * lost / F.greatest(F.col("gap"), F.lit(1e-300))).otherwise(F.lit(0.0)) * (4 - F.col("observed"))
    chi = F.when(two, F.col("w") + absent).otherwise(F.greatest(F.lit(0.0), F.col("s") - F.col("n")))
    return sums.select("id", "observed", F.least(F.lit(1.0), F.sqrt(chi / (F.col("n") * F.greatest(k, F.lit(1))))).alias("cramers_v"))


def pair_meta(df: DataFrame, pairs: list[tuple[str, str]], label: str, importances: DataFrame) -> DataFrame:
    """a, b and FEATURES of each pair of columns, in any order of a and b. importances: (column, importance), 0 where it is not known.

    A numeric label is ranked; what is not a number has no rank correlation. The jobs are one for the columns and one for each
    measure of all pairs; the rows of groups, cells and bins meet by (pair, value).
    """
    used, numbers = sorted({c for p in pairs for c in p}), set(numeric_columns(df))
    numeric, cats = [c for c in used if c in numbers], [c for c in used if c not in numbers]
    # without a number among the columns, one without values keeps the steps alike
    cells = counted(df, {c: number(c) for c in numeric}, quoted(label)).persist() if numeric else df.sparkSession.createDataFrame([], "column string, v double, y double, n long")
    try:
        return kept(_pair_meta(df, pairs, label, importances, cells, used, cats, numbers))
    finally:
        cells.unpersist()


def _pair_meta(df: DataFrame, pairs: list[tuple[str, str]], label: str, importances: DataFrame, cells: DataFrame, used: list[str], cats: list[str], numbers: set[str]) -> DataFrame:
    ids = {f"{i}": p for i, p in enumerate(pairs)}
    values = cells.groupBy("column", "v").agg(F.sum("n").alias("n"))
    texts = counted(df, {c: quoted(c).cast("string") for c in cats}) if cats else None
    own, codes = coded(df, used, values)
    told = joint.information(joint.counts(own, [(c, codes[c], quoted(label).cast("string")) for c in used])).select(F.col("id").alias("column"), F.col("mi").alias("mi_target"))
    facts = _column_facts(cells, values, texts, told).join(F.broadcast(importances.select("column", "importance")), "column", "left").fillna(0.0, ["importance"])
    facts = kept(facts)
    known = df.sparkSession.createDataFrame([(i, a, b, (a in numbers) + (b in numbers), a in numbers) for i, (a, b) in ids.items()], "id string, a string, b string, n_numerical_cols int, a_numeric boolean")
    side = lambda k: facts.select(F.col("column").alias(k), *(F.col(c).alias(f"{k}_{c}") for c in facts.columns if c != "column"))
    out = known.join(F.broadcast(side("a")), "a").join(F.broadcast(side("b")), "b")
    both = joint.counts(own, [(i, codes[a], codes[b]) for i, (a, b) in ids.items()])
    shared = joint.information(both).select("id", F.col("mi").alias("mutual_info_pair"), F.when(F.col("entropy_y") > 0, F.least(F.lit(1.0), F.col("mi") / F.col("entropy_y"))).otherwise(F.lit(0.0)).alias("mic_score"))
    out = out.join(F.broadcast(shared), "id", "left")
    kind = {n: [(i, *p) for i, p in ids.items() if (p[0] in numbers) + (p[1] in numbers) == n] for n in (0, 1, 2)}
    if kind[2]:
        two = [(i, number(a), number(b)) for i, a, b in kind[2]]
        zero = lambda v: F.when(F.col("n") > _FEW, F.coalesce(F.abs(v), F.lit(0.0))).otherwise(F.lit(0.0))
        out = out.join(F.broadcast(joint.correlations(df, two).select("id", zero("pearson").alias("pearson_corr"))), "id", "left")
        out = out.join(F.broadcast(joint.rank_correlations(joint.counts(df, two)).select("id", zero("spearman").alias("spearman_corr"))), "id", "left")
        signs = [F.struct(F.lit(i).alias("id"), F.avg(((x >= 0) == (y >= 0)).cast("double")).alias("sign_concordance")).alias(f"s{i}") for i, x, y in two]
        out = out.join(F.broadcast(df.agg(*signs).select(F.inline(F.array(*(F.col(f"s{i}") for i, _, _ in two))))), "id", "left")
    if kind[1]:
        out = out.join(F.broadcast(_groups(df, [(i, a, b) if a in numbers else (i, b, a) for i, a, b in kind[1]])), "id", "left")
    if kind[0]:
        out = out.join(F.broadcast(_contingency(joint.counts(df, [(i, category(a), category(b)) for i, a, b in kind[0]]))), "id", "left")
    return out.select("a", "b", *(x.alias(n) for n, x in _features(out).items()))


def _features(out: DataFrame) -> dict[str, Column]:
    of = lambda c: (F.col(f"a_{c}"), F.col(f"b_{c}"))
    got = lambda c: F.coalesce(F.col(c), F.lit(0.0)) if c in out.columns else F.lit(0.0)
    both = {"null_pct": tuple(1 - n / F.greatest(r, F.lit(1)) for n, r in zip(of("n"), of("n_rows"), strict=True)), "unique_ratio": tuple(u / F.greatest(r, F.lit(1)) for u, r in zip(of("n_unique"), of("n_rows"), strict=True))}
    both |= {c: of(c) for c in ("importance", "entropy", "target_corr", "mi_target")}
    both |= {"cv": tuple(F.coalesce(s / (F.abs(m) + 1e-8), F.lit(0.0)) for s, m in zip(of("std"), of("mean"), strict=True)), "skewness": tuple(map(F.abs, of("skew")))}
    total = lambda c: both[c][0] + both[c][1]
    apart = lambda c: F.abs(both[c][0] - both[c][1])
    (ma, mb), (sa, sb), (ua, ub) = of("mean"), of("std"), of("n_unique")
    found = {c: got(c) for c in FEATURES} | {f"sum_{c}": total(c) for c in ("importance", "null_pct", "unique_ratio", "entropy", "target_corr", "mi_target", "cv", "skewness")} | {f"abs_diff_{c}": apart(c) for c in ("unique_ratio", "entropy", "target_corr", "mi_target", "cv", "skewness")}
    found |= {
        "n_numerical_cols": F.col("n_numerical_cols").cast("double"), "max_importance": F.greatest(*both["importance"]), "min_importance": F.least(*both["importance"]), "max_null_pct": F.greatest(*both["null_pct"]), "both_binary": ((ua <= 2) & (ub <= 2)).cast("double"),
        "scale_ratio": F.when(F.least(sa, sb) > 1e-10, F.greatest(sa, sb) / F.least(sa, sb)).otherwise(F.lit(0.0)), "product_of_means": ma * mb, "abs_mean_ratio": F.greatest(F.abs(ma), F.abs(mb)) / (F.least(F.abs(ma), F.abs(mb)) + 1e-8), "n_positive_means": (ma > 0).cast("double") + (mb > 0).cast("double"),
        "n_groups": F.when(F.col("a_numeric"), ub).otherwise(ua).cast("double"),
        "joint_cardinality": (ua * ub).cast("double"), "cardinality_ratio": F.least(ua, ub) / (F.greatest(ua, ub) + 1e-10), "joint_sparsity": 1 - got("observed") / F.greatest(ua * ub, F.lit(1)),
    }
    n = F.col("n_numerical_cols")
    for names, own in ((_TWO_NUMBERS, 2), (_MIXED, 1), (_TWO_CATEGORIES, 0)):
        for c in names:
            near = {2: 1, 1: 2, 0: 1}[own]  # numeric columns of the kind that is one step away
            found[c] = F.when(n == own, found[c]).when(n == near, F.lit(ONE_STEP)).otherwise(F.lit(TWO_STEPS))
    return {c: found[c].cast("double") for c in FEATURES}
