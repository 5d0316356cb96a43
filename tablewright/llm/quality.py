"""Quality: random-indexing word vectors pooled per document, and a two-layer network with temperature-calibrated probabilities.

Words are filed under BUCKETS numbers by crc32, so the vector table has a fixed size however large the corpus is. Every
occurrence adds the fixed sparse random vectors of its neighbours to its own number's context vector, over all documents;
partial sums are made in the tasks and added by a grouped sum.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, for_python, labelled, per_text, with_results
from .encoding import coded, parts

BUCKETS, DIMENSIONS, NONZERO, WINDOW = 8192, 32, 4, 2
#: Labelled rows that the network is fitted on at most; a fifth of them only for the temperature.
FIT_ROWS = 16_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 60, 256, 3e-3, 1e-4
#: Numbers of a task's pass at a time, bytes of its step, and chunks between white space that it keeps (about 10 MB).
PASS, STEP, KEPT = 50_000, 1 << 20, 30_000
UNIT = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


class Units(dict):
    """Numbers of the units (words, digits, runs of marks) of a string, 16 bits each; made anew for each task."""

    def __missing__(self, chunk: str) -> bytes:
        found = b"".join([(zlib.crc32(u.encode("utf-8", "replace")) % BUCKETS).to_bytes(2, "little") for u in UNIT.findall(chunk)])
        if len(self) < KEPT:
            self[chunk] = found
        return found


def index_vectors() -> np.ndarray:
    """The fixed random vector of each number, and a last row of zeros."""
    rng, out = np.random.default_rng(20), np.zeros((BUCKETS + 1, DIMENSIONS), np.int8)
    for row in out[:-1]:
        row[rng.choice(DIMENSIONS, NONZERO, replace=False)] = rng.choice([-1, 1], NONZERO)
    return out


def context_vectors(docs: DataFrame) -> np.ndarray:
    """BUCKETS x DIMENSIONS: unit-length context vectors over all of docs (text); zeros for what doesn't occur."""

    def work(batches):
        fixed, sums, units = index_vectors(), np.zeros((BUCKETS + 1, DIMENSIONS), np.int64), Units()
        for texts, _ in (x for b in batches for x in parts(b.column(0), STEP)):
            ids, starts = coded(texts, units.__getitem__)
            padded = np.full(len(ids) + WINDOW * len(texts), BUCKETS, np.uint16)  # so no window reaches into the next document
            padded[np.arange(len(ids)) + np.repeat(np.arange(len(texts)) * WINDOW, np.diff(starts))] = ids
            for i in range(0, len(padded), PASS):
                own = padded[i : i + PASS]
                with_ends = np.concatenate([np.full(max(0, WINDOW - i), BUCKETS, np.uint16), padded[max(0, i - WINDOW) : i + PASS + WINDOW], np.full(WINDOW, BUCKETS, np.uint16)])
                vectors = fixed[with_ends[: len(own) + 2 * WINDOW]]
                near = sum(vectors[k : k + len(own)] for k in range(2 * WINDOW + 1) if k != WINDOW)
                order = np.argsort(own, kind="stable")
                at = np.flatnonzero(np.diff(own[order], prepend=-1))
                sums[own[order][at]] += np.add.reduceat(near[order], at, axis=0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS, dtype=np.int32)), *(pa.array(sums[:-1, d]) for d in range(DIMENSIONS))], ["bucket", *(f"v{d}" for d in range(DIMENSIONS))])

    made = for_python(docs).select("text").mapInArrow(work, "bucket int, " + ", ".join(f"v{d} long" for d in range(DIMENSIONS)))
    rows = made.groupBy("bucket").agg(*(F.sum(f"v{d}").alias(f"v{d}") for d in range(DIMENSIONS))).collect()  # BUCKETS rows at most
    table = np.zeros((BUCKETS, DIMENSIONS))
    for r in rows:
        table[r[0]] = r[1:]
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(texts: pa.Array, vectors: np.ndarray, units: Units | None = None) -> np.ndarray:
    """A row for each text: mean and deviation of its words' vectors, and the logarithm of its length. Zeros if it has no word; null counts as empty."""
    units, both = Units() if units is None else units, np.concatenate([vectors, vectors**2], 1)
    sums, n = np.zeros((len(texts), 2 * DIMENSIONS)), np.zeros(len(texts), np.int64)
    for own, number in parts(texts, STEP):
        ids, starts = coded(own, units.__getitem__)
        n[number] += np.diff(starts)
        of = np.repeat(number, np.diff(starts))
        for i in range(0, len(ids), PASS):
            at = np.flatnonzero(np.diff(of[i : i + PASS], prepend=-1))
            sums[of[i + at]] += np.add.reduceat(both[ids[i : i + PASS]], at, axis=0, dtype=np.float64)
    m = sums / np.maximum(n, 1)[:, None]
    mean, square = m[:, :DIMENSIONS], m[:, DIMENSIONS:]
    return np.concatenate([mean, np.sqrt(np.maximum(square - mean**2, 0)), np.log1p(n)[:, None]], 1).astype(np.float32)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits that gives y the least log loss, on a grid."""
    grid = np.geomspace(0.25, 8, 61)
    loss = [np.mean(np.logaddexp(0, -np.where(y > 0, 1, -1) * logits / t)) for t in grid]
    return float(grid[int(np.argmin(loss))])


@dataclass
class Network:
    """score = sigmoid((tanh(x W1 + b1) w2 + b2) / temperature), x standardised."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray) -> Network:
    """Adam on the log loss, with weight decay; x holds FIT_ROWS rows at most."""
    rng = np.random.default_rng(6)
    d = x.shape[1]
    net = Network(x.mean(0), x.std(0) + 1e-3, [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(())])
    z, w = (x - net.mean) / net.scale, net.weights
    m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(z))
        for i in range(0, len(z), BATCH):
            a, target = z[order[i : i + BATCH]], y[order[i : i + BATCH]]
            h = np.tanh(a @ w[0] + w[1])
            g = (1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -40, 40))) - target) / len(a)
            gh = np.outer(g, w[2]) * (1 - h * h)
            t += 1
            for k, grad in enumerate((a.T @ gh + DECAY * w[0], gh.sum(0), h.T @ g + DECAY * w[2], g.sum())):
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad**2
                w[k] = w[k] - RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return net


@dataclass
class QualityModel:
    vectors: np.ndarray
    network: Network | None
    constant: float = 1.0

    def score(self, docs: DataFrame, name: str = "quality") -> DataFrame:
        """docs with a column `name`, 0 to 1, higher: label 1 likelier. No row is dropped and nothing is shuffled.

        Null and empty texts are scored as texts without words, repeated rows each; an input column `name` is replaced.
        """
        if self.network is None:
            return with_results(docs, F.struct(F.lit(self.constant)), [name])
        vectors, network = self.vectors, self.network

        def start():
            units = Units()
            return lambda texts: pa.array(network.scores(pooled(texts, vectors, units)))

        return with_results(for_python(docs), F.struct(per_text(T.DoubleType(), start)("text")), [name])


def fit(docs: DataFrame, labels: DataFrame, keep: Column | None = None) -> QualityModel:
    """A model from docs (doc_id, text) and labels (doc_id, quality) where `keep` holds, of FIT_ROWS at most; the vectors are from all of docs.

    Without labels of both kinds every score is the share of label 1 (1 if there are no labels). Labels that are null or of
    a null id don't count; of several of one id the largest does. Rows that repeat an id are learned from each; a null text
    is an empty one. An empty table and an empty table of labels give the constant model.
    """
    vectors = context_vectors(docs)

    def start():
        units = Units()
        return lambda texts: pa.array([x.tobytes() for x in pooled(texts, vectors, units)], pa.binary())

    pool = per_text(T.BinaryType(), start)
    sample = labelled(docs, labels, "quality", F.lit(True) if keep is None else keep, FIT_ROWS)
    rows = sorted(tuple(r) for r in sample.select("doc_id", "y", pool("text")).collect())  # FIT_ROWS vectors at most
    y = np.array([r[1] for r in rows])
    if len(set(y.tolist())) < 2:
        return QualityModel(vectors, None, float(y.mean()) if len(y) else 1.0)
    x = np.array([np.frombuffer(r[2], np.float32) for r in rows], np.float64)
    last = np.array([zlib.crc32(b"t%d" % r[0]) % 5 == 0 for r in rows])
    if len(set(y[~last].tolist())) < 2 or not last.any():
        last[:] = False
    network = train(x[~last], y[~last])
    if last.any():
        network.temperature = temperature(network.logits(x[last]), y[last])
    return QualityModel(vectors, network)


def fit_rows(doc_id: Column) -> Column:
    """Which labels the query and the pipeline may learn from."""
    return fold(doc_id, 3) != 1
