"""From a labelled table to ranked suggestions, and from suggestions to two compared models."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import category, category_columns, number, numeric_columns, quoted
from ..operators import candidates, families, meta, metrics, models, pairs, prepare, profile
from ..operators.transforms import Step, fit, fit_and_apply
from ..operators.transforms import apply as replay


@dataclass
class Recommendation:
    """suggestions (ranked), skipped (column, reason), advisories (leakage first), dataset (one row of facts)."""

    suggestions: DataFrame
    skipped: DataFrame
    advisories: DataFrame
    dataset: DataFrame


def suggestions(
    df: DataFrame, label: str, importances: DataFrame, score: Callable[[DataFrame, str], DataFrame] | dict[str, families.FamilyModel], order_by: str | None = None, overrides: dict[str, str] | None = None, include_imbalance: bool = True,
    baseline: tuple[float, float] = (0.5, 0.01), landmarking: float | None = None, n_rows: int | None = None,
) -> DataFrame:
    """The suggestions of recommendation()."""
    return recommendation(df, label, importances, score, order_by, overrides, include_imbalance, baseline, landmarking, n_rows).suggestions


def recommendation(
    df: DataFrame, label: str, importances: DataFrame, score: Callable[[DataFrame, str], DataFrame] | dict[str, families.FamilyModel], order_by: str | None = None, overrides: dict[str, str] | None = None, include_imbalance: bool = True,
    baseline: tuple[float, float] = (0.5, 0.01), landmarking: float | None = None, n_rows: int | None = None,
) -> Recommendation:
    """All candidates of single columns, pairs and rows, and the imbalance of the classes: scored, normalised, deduplicated, ranked, the first ones checked.

    importances: (column, importance). score: family models by family (families.load()); families without a model are left
    out. Each scores its candidates in one batch, from the meta-features of the table, of columns, pairs and rows. Or a
    function score(candidates, family) that adds predicted_delta_raw. overrides: types that the user has set. baseline: score and
    deviation of a plain model; landmarking: that of a shallow tree, where it is known; n_rows: the real number of rows of a
    sample. A label of text counts by its place in order. Pairs are those of the most important columns, without near bijections.
    """
    df = df if label in numeric_columns(df) else prepare.encode_target(df, label, label)
    types = profile.column_types(df.drop(label), order_by)
    types = profile.reassigned(types, overrides) if overrides else types
    kinds = {r.column: r.detected for r in types.collect()}  # a row for each column
    numeric = [c for c in numeric_columns(df) if kinds.get(c) in ("Numerical", "Binary")]
    cats = [c for c in category_columns(df) if kinds.get(c) in ("Categorical", "Binary")]
    ranks = F.broadcast(meta.importance_ranks(importances))
    known = isinstance(score, dict)
    dataset = families.dataset_facts(meta.dataset_meta(df, label), baseline, landmarking, n_rows)
    facts = dataset.collect()[0].asDict() if known else {}  # one row
    parts, related = [], []

    def rows(found: DataFrame, kind: str) -> DataFrame:
        if known:
            # features of the table are constants of all its candidates
            made = score[kind].score(found.withColumns({k: F.lit(v).cast("double") for k, v in facts.items() if k not in found.columns}))
        else:
            made = score(found, kind)
        return made.select(F.lit(kind).alias("type"), "column", (F.col("column_b") if kind == "interaction" else F.lit(None).cast("string")).alias("column_b"), "method", F.col("predicted_delta_raw").alias("predicted_delta"), "predicted_delta_raw", F.lit(kind == "row").alias("pinned"), F.lit(None).cast("boolean").alias("auto_checked"))

    wanted = lambda kind: not known or kind in score
    if numeric and wanted("numerical"):
        least = df.agg(*(F.struct(F.lit(c).alias("column"), F.min(number(c)).alias("min_value")).alias(f"__{i}") for i, c in enumerate(numeric))).select(F.inline(F.array(*(F.col(f"__{i}") for i in range(len(numeric))))))
        found = meta.numeric_column_meta(df, numeric, label, with_mi=True).join(F.broadcast(least), "column").join(ranks, "column", "left")
        parts.append(rows(candidates.numerical_candidates(found), "numerical"))
        related.append(found.select("column", "spearman_corr_target", "mutual_info_score"))
    if cats and wanted("categorical"):
        found = meta.categorical_column_meta(df, cats, label).join(ranks, "column", "left")
        parts.append(rows(candidates.categorical_candidates(found), "categorical"))
        related.append(found.select("column", F.lit(0.0).alias("spearman_corr_target"), "mutual_info_score"))
    if wanted("interaction") and (made := candidates_of_pairs(df, numeric, cats, importances)) is not None:
        if known:
            both = sorted({(r.column, r.column_b) for r in made.select("column", "column_b").distinct().collect()})  # capped by kind
            own = pairs.pair_meta(df, both, label, importances).withColumnsRenamed({"a": "column", "b": "column_b"})
            made = made.select("column", "column_b", "method").join(F.broadcast(own), ["column", "column_b"])
        parts.append(rows(made, "interaction"))
    if wanted("row"):
        own = meta.row_meta(df, label)
        own = own if "pct_cells_zero" in own.columns else own.withColumns({"pct_cells_zero": F.lit(0.0), "pct_rows_with_any_missing": F.lit(0.0)})
        own = own.withColumns({"n_numeric": F.lit(len(numeric)), "pct_zero": F.col("pct_cells_zero"), "pct_missing": F.col("pct_rows_with_any_missing"), "column": F.lit("(all numeric cols)" if known else "")})
        parts.append(candidates.pinned_row_families(rows(candidates.row_family_candidates(own), "row")))
    none = candidates.empty(df.sparkSession)
    columns = none.columns
    if texts := [c for c in category_columns(df) if c != label]:
        parts += [x.select(columns) for x in (candidates.date_suggestions(profile.date_stats(df, texts)), candidates.weekday_suggestions(profile.weekday_stats(df, texts)), candidates.text_suggestions(profile.text_stats(df, texts)))]
    if include_imbalance:
        parts.append(candidates.imbalance_suggestion(prepare.class_counts(df, label)).select(columns))
    every = candidates.deduplicated(candidates.normalised(reduce(DataFrame.unionByName, parts, none)))
    k = df.agg(candidates.recommended_top_k(F.count("*"), F.lit(len(df.columns) - 1))).first()[0]
    skipped = types.where(F.col("detected").isin("ID", "Constant")).select("column", F.lower("detected").alias("reason"))
    return Recommendation(candidates.selected(every, k), skipped, advisories(df, label, related), dataset)


def advisories(df: DataFrame, label: str, related: list[DataFrame]) -> DataFrame:
    """profile.advisories(), after one of severity high for columns that give the label away. related: (column, spearman_corr_target, mutual_info_score)."""
    plain = profile.advisories(df, label)
    if not related:
        return plain
    shares = prepare.class_counts(df, label).agg(F.collect_list("n").alias("n")).first().n  # a number for each class
    total = sum(shares) or 1
    found = leakage(reduce(DataFrame.unionByName, related), -sum(n / total * math.log2(n / total) for n in shares if n))
    said = found.agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.concat_ws(": ", "column", "reason"))).alias("own")).where("n > 0")
    return said.select(F.lit("leakage").alias("category"), F.lit("high").alias("severity"), F.format_string("%d columns may give the label away", F.col("n")).alias("title"), F.concat_ws("; ", "own").alias("detail"), F.lit(None).cast("map<string,double>").alias("suggested_params")).unionByName(plain)


def candidates_of_pairs(df: DataFrame, numeric: list[str], cats: list[str], importances: DataFrame) -> DataFrame | None:
    """column, column_b, method and the gates' values of the pairs of the most important columns, without near bijections; None without pairs."""
    own = importances.where(F.col("column").isin(*numeric, *cats)).select("column", F.col("column").isin(*numeric).alias("numeric"), "importance")
    own = own.join(F.broadcast(profile.base_stats(df, [*numeric, *cats]).select("column", "unique_ratio")), "column") if numeric or cats else own
    own = meta.kept(own)  # a row for each column
    top = {r.column: r.numeric for r in candidates.top_columns(own).collect()}  # 14 rows at most
    near = candidates.near_bijections(df, list(combinations(sorted(top), 2))).where("near_bijection") if len(top) > 1 else None
    found = [tuple(r) for r in candidates.pair_pool(own, near).select("a", "b", "kind").collect()]  # capped by kind
    if not found:
        return None
    n_rows, used = df.count(), sorted({c for a, b, _ in found for c in (a, b)})
    # one aggregate for all columns and pairs: distinct values, zeros or nulls among them, distinct pairs
    sides = [F.count_distinct(quoted(c)).alias(f"u{i}") for i, c in enumerate(used)] + [F.count_if((number(c) == 0) | quoted(c).isNull() if c in numeric else quoted(c).isNull()).alias(f"z{i}") for i, c in enumerate(used)]
    joint = [F.count_distinct(F.struct(category(a), category(b))).alias(f"j{i}") for i, (a, b, kind) in enumerate(found) if kind == "cc"]
    one, at = df.agg(*sides, *joint).first(), {c: i for i, c in enumerate(used)}
    rows = [(a, b, kind, one[f"u{at[a]}"], one[f"u{at[b]}"], one[f"u{at[a]}"] / max(1, n_rows), one[f"u{at[b]}"] / max(1, n_rows), one[f"z{at[b]}"] > 0, one[f"j{i}"] if kind == "cc" else 0) for i, (a, b, kind) in enumerate(found)]
    made = df.sparkSession.createDataFrame(rows, "column string, column_b string, kind string, a_unique long, b_unique long, a_ratio double, b_ratio double, b_has_zero boolean, joint_cardinality long")
    return candidates.pair_candidates(made, n_rows)


def leakage(meta_rows: DataFrame, entropy_y: float) -> DataFrame:
    """column, reason of meta rows (spearman_corr_target, mutual_info_score) that give the label away."""
    reasons = F.array_compact(F.array(F.when(F.col("spearman_corr_target") >= 0.95, F.lit("rank correlation")), F.when(F.col("mutual_info_score") >= max(0.95 * entropy_y, 0.95), F.lit("mutual information"))))
    return meta_rows.select("column", F.concat_ws(", ", reasons).alias("reason")).where("reason <> ''")


def compare_models(df: DataFrame, label: str, key: str, steps: list[Step], params: dict | None = None) -> DataFrame:
    """metric, baseline, enhanced, delta, winner on the held-out fifth: the plain columns against the transformed ones."""
    split = prepare.stratified_split(df, label, key)
    train, test = split.where("NOT is_test").drop("is_test"), split.where("is_test").drop("is_test")
    made, fitted = fit_and_apply(train, steps, label, key)

    def evaluated(tr: DataFrame, te: DataFrame) -> DataFrame:
        enc = models.fit_encoders(tr, label, te, skip=(key,))
        model = models.train_classifier(models.matrix(tr, enc, [label]), 2, label, params)
        scored = models.scored(model, models.matrix(te, enc, [label]), 2).select(F.col(label).alias("label"), "score", "prediction").cache()
        one = metrics.metrics_at_threshold(scored, 0.5).join(metrics.ranking_metrics(scored)).join(metrics.log_loss(scored))
        long = one.select(F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("accuracy", "f1", "precision", "recall", "roc_auc", "log_loss")))))
        found = df.sparkSession.createDataFrame(long.collect(), long.schema)  # a row for each metric
        scored.unpersist()
        return found

    return metrics.compared(evaluated(train, test), evaluated(made, replay(test, fitted)))


__all__ = ["Recommendation", "advisories", "compare_models", "fit", "leakage", "recommendation", "suggestions"]
