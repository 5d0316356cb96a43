"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of two and three letters (anything else counts as a space) are filed under FEATURES numbers by a fixed mix of
their code points. Document frequencies are counted over all documents that may be learned from. The weights are learned
online by the follow-the-regularised-leader method with elastic-net penalties, and a temperature calibrates the probabilities.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, fold, for_python, per_text, with_results

FEATURES = 1 << 14
#: Labelled rows that are learned from at most; a fifth of them only for the temperature.
FIT_ROWS = 5_000
#: Of the method: learning rate, its smoothing, both penalties, passes; SCALE multiplies term frequencies.
ALPHA, BETA, L1, L2, EPOCHS, SCALE = 0.3, 1.0, 1e-3, 1e-3, 3, 30.0
#: Characters, and documents, that a task looks at a time; a longer document is looked at in pieces.
PASS, DOCS = 250_000, 256
UNKNOWN = "und"


def _letter(c: int) -> int:
    """The lower-case letter of a code point; a space if it is no letter."""
    low = (x := chr(c)).lower()
    return (ord(low) if len(low) == 1 else c) if x.isalpha() else 32


_table: list[np.ndarray] = []


def grams(texts: list[str], own: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the texts' n-grams; which text each belongs to; which texts have a letter. One gram of each length starts at every character.

    own: how many of a text's characters are its own, where the rest is what follows a piece.
    """
    if not _table:
        _table.append(np.fromiter(map(_letter, range(1 << 16)), np.uint32, 1 << 16))
    points = np.frombuffer("\0\0".join([*texts, ""]).encode("utf-32-le", "replace"), "<u4")
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    low = _table[0][np.minimum(points, 0xFFFF)]
    if (high := points > 0xFFFF).any():
        rare, at = np.unique(points[high], return_inverse=True)
        low[high] = np.fromiter(map(_letter, rare.tolist()), np.uint32, len(rare))[at]
    n = sizes if own is None else np.array(own)
    doc = np.repeat(np.arange(len(texts)), n)
    at = np.arange(len(doc)) + np.repeat(np.cumsum(sizes + 2) - sizes - 2 - np.cumsum(n) + n, n)  # two separators stand after each text
    has = np.zeros(len(texts), bool)
    has[doc[low[at] != 32]] = True
    a, b, c = low[at], low[at + 1], low[at + 2]
    two = a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77)
    three = two + c * np.uint32(0xC2B2AE3D) + np.uint32(0x27D4EB2F)
    mix = lambda h: ((h ^ (h >> 15)) * np.uint32(0x2C1B3C6D)) >> 18  # noqa: E731  14 bits
    return np.stack([mix(two), mix(three)], 1), doc, has


def _passes(texts: pa.Array) -> Iterator[tuple[list[str], list[int], np.ndarray]]:
    """The texts (null: empty) by steps of PASS characters and DOCS texts: strings, how many of their characters count, the numbers of their texts."""
    own, count, number, size = [], [], [], 0
    for k in range(len(texts)):
        x = texts[k].as_py() or ""
        for i in range(0, max(1, len(x)), PASS):
            n = min(PASS, len(x) - i)
            if own and (size + n > PASS or len(own) >= DOCS):
                yield own, count, np.array(number)
                own, count, number, size = [], [], [], 0
            own.append(x if len(x) <= PASS else x[i : i + n + 2])
            count.append(n)
            number.append(k)
            size += n
    if own:
        yield own, count, np.array(number)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of docs (text) each number occurs, and how many docs there are. FEATURES + 1 rows reach the driver at most."""

    def work(batches):
        df, n = np.zeros(FEATURES, np.int64), 0
        for texts in (b.column(0) for b in batches):
            last = None  # what a text has that goes on in the next step
            for strings, own, number in _passes(texts):
                numbers, doc, _ = grams(strings, own)
                seen = np.zeros((number[-1] - number[0] + 1, FEATURES), bool)
                seen[(number - number[0])[doc][:, None], numbers] = True
                if last and last[0] == number[0]:
                    seen[0] |= last[1]
                elif last:
                    df += last[1]
                df, last = df + seen[:-1].sum(0), (number[-1], seen[-1])
            df, n = df + (last[1] if last else 0), n + len(texts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, FEATURES, dtype=np.int32)), pa.array(np.concatenate([[n], df]))], ["number", "n"])

    rows = for_python(docs).select("text").mapInArrow(work, "number int, n long").groupBy("number").agg(F.sum("n")).collect()
    out = np.zeros(FEATURES + 1, np.int64)
    for number, n in rows:
        out[number + 1] = n
    return out[1:], int(out[0])


def _sparse(text: str) -> bytes:
    """Numbers (16 bits) and term frequencies (32-bit floats) of a text."""
    counts = np.zeros(FEATURES, np.int64)
    for strings, own, _ in _passes(pa.array([text], pa.string())):
        counts += np.bincount(grams(strings, own)[0].ravel(), minlength=FEATURES)
    numbers = np.flatnonzero(counts)
    return np.array([len(numbers)], "<u4").tobytes() + numbers.astype("<u2").tobytes() + (counts[numbers] / max(1, counts.sum())).astype("<f4").tobytes()


def _unpacked(x: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(x, "<u4", 1)[0])
    return np.frombuffer(x, "<u2", n, 4).astype(np.int64), np.frombuffer(x, "<f4", n, 4 + 2 * n).astype(np.float64)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> np.ndarray:
    """FEATURES + 1 x classes weights (the last row is the bias), by online follow-the-regularised-leader on (numbers, values, class)."""
    z, n = np.zeros((FEATURES + 1, classes)), np.zeros((FEATURES + 1, classes))

    def weights(i):
        return np.where(np.abs(z[i]) <= L1, 0, -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    rng = np.random.default_rng(4)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            numbers, values, y = rows[k]
            i, x = np.append(numbers, FEATURES), np.append(values, 1.0)
            w = weights(i)
            p = np.exp((s := x @ w) - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    return weights(slice(None))


@dataclass
class LanguageModel:
    classes: list[str]
    #: idf x weight of each number, and the bias row; divided by the temperature.
    table: np.ndarray

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """The likeliest class of each text and its probability; UNKNOWN and 0 for a null text and one without a letter."""
        sums, n, has = np.zeros((len(texts), len(self.classes))), np.zeros(len(texts)), np.zeros(len(texts), bool)
        for strings, own, number in _passes(texts):
            numbers, doc, letters = grams(strings, own)
            n[number] += own
            has[number] |= letters
            if len(doc):
                at = np.flatnonzero(np.diff(doc, prepend=-1))
                each = self.table[numbers[:, 0]] + self.table[numbers[:, 1]]
                sums[number[doc[at]]] += np.add.reduceat(each, at, axis=0, dtype=np.float64)
        logits = sums / (2 * np.maximum(n, 1)[:, None]) * SCALE + self.table[FEATURES].astype(np.float64)
        p = np.exp(logits - logits.max(1, keepdims=True, initial=-np.inf))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        names = [self.classes[b] if h else UNKNOWN for b, h in zip(best.tolist(), has.tolist(), strict=True)]
        return names, np.where(has, p[np.arange(len(p)), best], 0.0)

    def score(self, docs: DataFrame) -> DataFrame:
        """docs with lang_pred and score, the probability of it. A null text, and one without a letter, has `und` and 0.

        Every row is scored for itself, repeated ones too, and none is dropped; input columns lang_pred and score are replaced.
        """
        if not self.classes:
            return with_results(docs, F.struct(F.lit(UNKNOWN), F.lit(0.0)), ["lang_pred", "score"])

        def work(texts: pa.Array) -> pa.Array:
            names, scores = self.predict(texts)
            return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang", "p"])

        kind = T.StructType([T.StructField("lang", T.StringType()), T.StructField("p", T.DoubleType())])
        return with_results(for_python(docs), per_text(kind, lambda: work)("text"), ["lang_pred", "score"])


def fit(docs: DataFrame, keep: Column | None = None) -> LanguageModel:
    """A model from the text and the non-null lang of docs (doc_id, text, lang) where `keep` holds: weights from FIT_ROWS rows at most, document frequencies from all of them.

    Null texts, null ids and null languages aren't learned from; rows that repeat an id are learned from each. Without such
    rows, as in an empty table, nothing is learned, and every text is `und`.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.lit(True) if keep is None else keep))
    df, n = document_frequencies(usable.where("text IS NOT NULL"))
    idf = np.log((1 + n) / (1 + df)) + 1
    sparse = per_text(T.BinaryType(), lambda: lambda texts: pa.array([_sparse(x.as_py()) for x in texts], pa.binary()))
    # nulls among the texts are left out after the count, which so reads no text
    sample = bounded(usable.select("doc_id", "lang", "text"), "doc_id", FIT_ROWS).where("text IS NOT NULL")
    rows = sorted(tuple(r) for r in sample.select("doc_id", "lang", sparse("text")).collect())  # FIT_ROWS sparse vectors at most
    classes = sorted({r[1] for r in rows})
    if not classes:
        return LanguageModel([], np.zeros((FEATURES + 1, 0)))
    data = [(i, v * idf[i] * SCALE, classes.index(lang)) for _, lang, x in rows for i, v in (_unpacked(x),)]
    last = [zlib.crc32(b"t%d" % r[0]) % 5 == 0 for r in rows]
    weights = train([d for d, x in zip(data, last, strict=True) if not x] or data, len(classes))
    held = [d for d, x in zip(data, last, strict=True) if x] or data
    logits = np.array([v @ weights[i] + weights[FEATURES] for i, v, _ in held])
    right = np.array([y for *_, y in held])

    def loss(t: float) -> float:
        s = logits / t
        return float(np.mean(np.log(np.exp(s - s.max(1, keepdims=True)).sum(1)) + s.max(1) - s[np.arange(len(s)), right]))

    t = min(np.geomspace(0.1, 10, 61).tolist(), key=loss)
    weights[:FEATURES] *= idf[:, None]
    return LanguageModel(classes, (weights / t).astype(np.float32))


def fit_rows(doc_id: Column) -> Column:
    """Which rows the query may learn from."""
    return fold(doc_id, 3) != 1
