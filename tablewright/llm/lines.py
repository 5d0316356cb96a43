"""Quality rules: Viterbi decoding of a linear-chain conditional random field marks each line as content or boilerplate.

Labels are of documents, so the kinds of lines are learned by expectation and maximisation: first each line is judged by
its own features, then lines take the kind that the field thinks likelier, so far as a good document keeps at least
CONTENT_SHARE of its words in content lines and a poor one less, and the field is fitted to these kinds, ROUNDS times. So
lines of both kinds stand in one document, and the transitions learn how kinds follow each other. The share of words in
content lines decides.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import for_python, labelled, per_text, written
from .encoding import parts
from .line_features import FEATURES, NONE, WIDTH, measured

#: Labelled documents that the field is fitted on at most, and about how many lines of them; beyond, fewer whole documents.
FIT_ROWS, FIT_LINES = 6_000, 600_000
#: Lines of a document that are looked at together in fitting; longer documents are several such chains.
CHAIN = 400
CONTENT_SHARE = 0.5
ROUNDS, EPOCHS, BATCH, RATE, DECAY = 3, 8, 64, 0.05, 1e-4
# Fixed values of the base rules.
MIN_WORDS, MAX_REPEATED = 10, 20
#: Bytes of a task's step; a longer text stands alone.
STEP = 2 << 20


@dataclass
class LineField:
    """Log-linear weights: of each feature (and none) for boilerplate (0) and content (1), of each pair of kinds, and of the first kind."""

    emit: np.ndarray
    step: np.ndarray
    first: np.ndarray

    def emissions(self, features: np.ndarray) -> np.ndarray:
        return self.emit[features].sum(1)

    def decode(self, emissions: Sequence[tuple[float, float]]) -> list[int]:
        """The likeliest kinds. On a tie, content."""
        (s00, s01), (s10, s11) = self.step.tolist()
        a, b = emissions[0][0] + float(self.first[0]), emissions[0][1] + float(self.first[1])
        back = []
        for e0, e1 in emissions[1:]:
            from0, from1 = int(b + s10 >= a + s00), int(b + s11 >= a + s01)
            back.append((from0, from1))
            a, b = e0 + (b + s10 if from0 else a + s00), e1 + (b + s11 if from1 else a + s01)
        kinds = [int(b >= a)]
        for pair in reversed(back):
            kinds.append(pair[kinds[-1]])
        return kinds[::-1]


@dataclass
class Labelled:
    """Features and words of the lines of a document, and whether it is a good one."""

    features: np.ndarray
    words: np.ndarray
    good: int


def fitted(documents: list[Labelled]) -> LineField:
    """The field of documents with at least one line each."""
    emit = np.zeros((FEATURES + 1, 2))
    chains = [(d, i, min(i + CHAIN, len(doc.words))) for d, doc in enumerate(documents) for i in range(0, len(doc.words), CHAIN)]
    chains.sort(key=lambda c: (c[2] - c[1], c))
    batches = [chains[i : i + BATCH] for i in range(0, len(chains), BATCH)]
    kinds = [np.full(len(doc.words), doc.good) for doc in documents]
    params = [emit, np.zeros((2, 2)), np.zeros(2)]
    for k in range(ROUNDS + 1):
        params = _ascended(params, batches, documents, kinds, alone=not k)
        if k < ROUNDS:
            kinds = [_held(doc, p) for doc, p in zip(documents, _content(params, batches, documents), strict=True)]
    return LineField(*params)


def _held(doc: Labelled, p: np.ndarray) -> np.ndarray:
    """The likelier kinds by the lines' probabilities of content, changed from the least sure on until the share of content fits the document's label."""
    kinds = (p >= 0.5).astype(int)
    share, total = int(doc.words[kinds == 1].sum()), int(doc.words.sum())
    wrong = np.flatnonzero(kinds != doc.good)
    for i in wrong[np.argsort(np.abs(p[wrong] - 0.5), kind="stable")].tolist():
        if (share >= CONTENT_SHARE * total) == bool(doc.good):
            break
        kinds[i] = doc.good
        share += int(doc.words[i]) if doc.good else -int(doc.words[i])
    return kinds


def _padded(batch, documents: list[Labelled]) -> tuple[np.ndarray, np.ndarray]:
    """Features of a batch's chains, filled up with NONE, and which lines are there."""
    most = max(j - i for _, i, j in batch)
    x = np.full((len(batch), most, WIDTH), NONE)
    for r, (d, i, j) in enumerate(batch):
        x[r, : j - i] = documents[d].features[i:j]
    return x, np.arange(most) < np.array([j - i for _, i, j in batch])[:, None]


def _passes(x, there, emit, step, first):
    """Logarithms of forward and backward sums of a batch, its emissions, and the chains' totals."""
    lse = lambda a, axis: np.log(np.exp(a - (top := a.max(axis, keepdims=True))).sum(axis)) + top.squeeze(axis)
    e = emit[x].sum(2)
    alpha, beta = np.zeros_like(e), np.zeros_like(e)
    alpha[:, 0] = e[:, 0] + first
    for i in range(1, e.shape[1]):
        alpha[:, i] = np.where(there[:, i, None], lse(alpha[:, i - 1, :, None] + step, 1) + e[:, i], alpha[:, i - 1])
    for i in range(e.shape[1] - 2, -1, -1):
        beta[:, i] = np.where(there[:, i + 1, None], lse(step + (e[:, i + 1] + beta[:, i + 1])[:, None, :], 2), 0)
    return e, alpha, beta, lse(alpha[:, -1], 1)


def _gradient(x, there, kinds, emit, step, first):
    """Observed minus expected counts of a batch, by line. kinds: the lines' kinds, anything where no line is."""
    e, alpha, beta, total = _passes(x, there, emit, step, first)
    p = np.exp(alpha + beta - total[:, None, None]) * there[:, :, None]
    want = np.stack([(kinds == 0) & there, (kinds == 1) & there], 2).astype(float)
    lines, gap = there.sum(), want - p
    g_emit = np.stack([np.bincount(x.ravel(), np.repeat(gap[:, :, k].ravel(), x.shape[2]), len(emit)) for k in (0, 1)], 1)
    g_emit[NONE] = 0
    g_step = np.zeros((2, 2))
    if x.shape[1] > 1:
        both = np.exp(alpha[:, :-1, :, None] + step + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None])
        seen = want[:, :-1, :, None] * want[:, 1:, None, :]
        g_step = ((seen - both) * there[:, 1:, None, None]).sum((0, 1))
    return g_emit / lines, g_step / lines, gap[:, 0].sum(0) / lines


def _ascended(params, batches, documents, kinds, alone: bool):
    """Gradient ascent (Adam) on the log-likelihood of the kinds. alone: each line for itself, without transitions."""
    params = [p.copy() for p in params]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    rng = np.random.default_rng(8)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(batches)):
            x, there = _padded(batches[k], documents)
            y = np.zeros(there.shape, int)
            for r, (d, i, j) in enumerate(batches[k]):
                y[r, : j - i] = kinds[d][i:j]
            t += 1
            for i, g in enumerate(_gradient(x, there, y, *params)):
                if alone and i:
                    continue
                g = g - DECAY * params[i]
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                params[i] = params[i] + RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return params


def _content(params, batches, documents) -> list[np.ndarray]:
    """By document: its lines' probabilities of being content."""
    out = [np.zeros(len(doc.words)) for doc in documents]
    for batch in batches:
        x, there = _padded(batch, documents)
        _, alpha, beta, total = _passes(x, there, *params)
        p = np.exp(alpha[:, :, 1] + beta[:, :, 1] - total[:, None])
        for r, (d, i, j) in enumerate(batch):
            out[d][i:j] = p[r, : j - i]
    return out


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_RESULT = T.StructType([*(T.StructField(x, T.LongType()) for x in _COUNTS), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("content_share", T.DoubleType())])


def measures(texts: pa.Array, field: LineField | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The _COUNTS of each text (null: empty), base_failed, kept and content_share: of the words in content lines, 0 without words."""
    base, shares = [np.zeros((0, len(_COUNTS)), np.int64)], [np.zeros(0)]
    for own, _ in parts(texts, STEP, whole=True):
        m = measured(own)
        base.append(m.base)
        share = (np.diff(m.starts) > 0).astype(float)
        if field:
            emissions = list(map(tuple, field.emissions(m.features).tolist()))
            starts = m.starts.tolist()
            kinds = np.array([k for i, j in zip(starts, starts[1:], strict=False) if j > i for k in field.decode(emissions[i:j])], int)
            content = np.concatenate([[0], np.cumsum(m.words * kinds)])[m.starts]
            share = np.diff(content) / np.maximum(1, m.base[:, 0])
        shares.append(share)
    counts, share = np.concatenate(base), np.concatenate(shares)
    failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEATED * counts[:, 0])
    return counts, failed, ~failed & (share >= CONTENT_SHARE), share


def judged(docs: DataFrame, field: LineField | None) -> DataFrame:
    """A row for each of docs (doc_id, text): doc_id and the fields of _RESULT. Null and empty texts have no words and fail.

    Without a field every line counts as content. Rows are judged each for itself, whatever their id; other columns are left out.
    """

    def work(texts: pa.Array) -> pa.Array:
        counts, *rest = measures(texts, field)
        return pa.StructArray.from_arrays([*(pa.array(counts[:, i]) for i in range(len(_COUNTS))), *map(pa.array, rest)], _RESULT.names)

    made = for_python(docs).select("doc_id", per_text(_RESULT, lambda: work)("text").alias("__judged"))
    return made.select("doc_id", *(F.col(f"__judged.{x}").alias(x) for x in _RESULT.names))


def fit(docs: DataFrame, labels: DataFrame, keep: Column | None = None) -> LineField | None:
    """A field from docs (doc_id, text) and labels (doc_id, quality) where `keep` holds, of FIT_ROWS at most; None without labels of both kinds.

    Labels that are null or of a null id don't count; of several of one id the largest does. Texts without words aren't learned from.
    """
    kind = T.StructType([T.StructField("words", T.BinaryType()), T.StructField("features", T.BinaryType()), T.StructField("n", T.LongType())])

    def work(texts: pa.Array) -> pa.Array:
        words, features, n = [], [], []
        for own, _ in parts(texts, STEP, whole=True):
            m = measured(own)
            for i, j in zip(m.starts.tolist(), m.starts[1:].tolist(), strict=False):
                words.append(m.words[i:j].astype("<i4").tobytes())
                features.append(m.features[i:j].tobytes())
                n.append(j - i)
        return pa.StructArray.from_arrays([pa.array(words, pa.binary()), pa.array(features, pa.binary()), pa.array(n, pa.int64())], ["words", "features", "n"])

    sample = for_python(labelled(docs, labels, "quality", F.lit(True) if keep is None else keep, FIT_ROWS))
    rows = written(sample.select("doc_id", "y", per_text(kind, lambda: work)("text").alias("x")).select("doc_id", "y", "x.*").where("n > 0"), "lines")
    total = rows.agg(F.sum("n")).first()[0] or 0
    if total > FIT_LINES:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(19)), F.lit(1 << 30)) < int((1 << 30) * FIT_LINES / total))
    found = sorted(tuple(r) for r in rows.select("doc_id", "y", "words", "features").collect())  # about FIT_LINES x (WIDTH + 4) bytes
    documents = [Labelled(np.frombuffer(f, np.uint8).reshape(-1, WIDTH), np.frombuffer(w, "<i4").astype(np.int64), int(y > 0)) for _, y, w, f in found]
    return fitted(documents) if len({d.good for d in documents}) > 1 else None
