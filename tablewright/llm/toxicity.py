"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, for_python, labelled, per_text, with_results
from .toxic_features import NAMES, PREFIXES, Chunks, features

#: Labelled rows that the model is fitted on at most: half for the lexicon, three tenths for the trees, the rest for calibration.
FIT_ROWS = 16_000
#: Units (words, and beginnings of words marked with ^) that the learned lexicon has at most.
LEXICON, MIN_TOXIC, MIN_LOG_ODDS = 1000, 4, math.log(4)


def _lexicon(sample: DataFrame) -> frozenset[str]:
    """The units that mark toxic documents of the sample best; at most LEXICON strings reach the driver."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))
    starts = F.flatten(F.transform(F.filter("w", lambda w: F.length(w) > PREFIXES[0]), lambda w: F.transform(F.sequence(F.lit(PREFIXES[0]), F.least(F.lit(PREFIXES[1]), F.length(w) - 1)), lambda k: F.concat(F.lit("^"), F.substring(w, F.lit(1), k)))))
    units = sample.select("y", words.alias("w")).select("y", F.explode(F.array_distinct(F.concat("w", starts))).alias("unit"))
    total = sample.agg(F.coalesce(F.sum("y"), F.lit(0.0)), F.count("*")).first()
    toxic, clean = total[0], total[1] - total[0]
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("n") - F.col("t") + 0.5) / (clean + 1))
    best = units.groupBy("unit").agg(F.sum("y").alias("t"), F.count("*").alias("n")).where(F.col("t") >= MIN_TOXIC).withColumn("odds", odds).where(F.col("odds") >= MIN_LOG_ODDS)
    return frozenset(r.unit for r in best.orderBy(F.desc(F.col("t") * F.col("odds")), "unit").limit(LEXICON).select("unit").collect())


@dataclass
class ToxicityModel:
    lexicon: frozenset[str] = field(default_factory=frozenset)
    trees: GBTClassificationModel | None = None
    isotonic: IsotonicRegressionModel | None = None
    #: The score of every text, where labels of one kind only were given.
    constant: float = 0.0

    def with_features(self, df: DataFrame) -> DataFrame:
        lexicon = self.lexicon

        def start():
            chunks = Chunks(lexicon)

            def work(texts: pa.Array) -> pa.Array:
                found = features(texts, chunks)
                return pa.ListArray.from_arrays(np.arange(0, found.size + 1, len(NAMES), dtype=np.int32), pa.array(found.ravel()))

            return work

        return for_python(df).withColumn("__tox_x", array_to_vector(per_text(T.ArrayType(T.DoubleType()), start)("text")))

    def score(self, docs: DataFrame, name: str = "toxicity") -> DataFrame:
        """docs with a column `name`, 0 to 1, higher: likelier toxic. No row is dropped and nothing is shuffled.

        Null and empty texts are scored as texts without words, repeated rows each; an input column `name` is replaced.
        """
        if self.trees is None:
            return with_results(docs, F.struct(F.lit(self.constant)), [name])
        raw = self.trees.transform(self.with_features(docs)).withColumn("__tox_p", vector_to_array("__tox_prob")[1])
        score = F.col("__tox_p")
        if self.isotonic is not None:
            raw, score = self.isotonic.transform(raw), F.col("__tox_iso")
        kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() != name.lower()]
        return raw.withColumn("__tox_s", F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))).select(*kept, F.col("__tox_s").alias(name))


def fit(docs: DataFrame, labels: DataFrame, keep: Column | None = None) -> ToxicityModel:
    """A model from docs (doc_id, text) and labels (doc_id, toxic) where `keep` holds, of FIT_ROWS at most.

    Without labels of both kinds every score is the share of toxic ones (0 if there are none, as in empty tables). Labels
    that are null or of a null id don't count; of several of one id the largest does. Rows that repeat an id are learned
    from each; a null text is an empty one.
    """
    sample = labelled(docs, labels, "toxic", F.lit(True) if keep is None else keep, FIT_ROWS).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(10)))
    model = ToxicityModel(_lexicon(sample.where("part < 5")))
    rows = model.with_features(sample.where("part >= 5")).select("part", "y", "__tox_x").cache()
    try:
        kinds = {r.y: r["count"] for r in rows.where("part < 8").groupBy("y").count().collect()}
        if len(kinds) < 2:
            return ToxicityModel(constant=float(sum(y * n for y, n in kinds.items()) / max(1, sum(kinds.values()))))
        gbt = GBTClassifier(featuresCol="__tox_x", labelCol="y", predictionCol="__tox_pred", maxIter=20, maxDepth=4, stepSize=0.2, seed=7).setProbabilityCol("__tox_prob").setRawPredictionCol("__tox_raw")
        model.trees = gbt.fit(rows.where("part < 8").coalesce(4))
        scored = model.trees.transform(rows.where("part >= 8")).select("y", vector_to_array("__tox_prob")[1].alias("__tox_p"))
        if scored.agg(F.count_distinct("y")).first()[0] == 2:
            model.isotonic = IsotonicRegression(featuresCol="__tox_p", labelCol="y", predictionCol="__tox_iso").fit(scored.coalesce(1))
        return model
    finally:
        rows.unpersist()


def fit_rows(doc_id: Column) -> Column:
    """Which labels the query and the pipeline may learn from."""
    return fold(doc_id, 4) != 2
