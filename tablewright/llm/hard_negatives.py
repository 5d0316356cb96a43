"""Hard negatives: for every anchor and each of its nearest rows of the same label, the nearest rows of other labels within a window of scores.

Vectors are whole numbers (floor of SCALE times each component), so scores are exact. Anchors are put in order of label and
signs and cut into blocks of BLOCK; the anchors of a block form a minimum spanning tree of their distances. Going down the
tree, the score of a row x at a child c is bounded by that at its parent p: |c.x - p.x| <= |c - p| |x|. Where the bounds of
a row overlap no window that is still open, they are only widened for the next child; else its score is taken, and is exact
from there on. A window is the scores that can still be among the first few: it closes on the scores found so far.

Rows stand in chunks of CHUNK; blocks are broadcast to them in groups of at most GROUP anchors, one pass over the rows for
each group, so what is broadcast is bounded. All anchors meet all rows, in blocks; the bounds spare the scoring. Each task
keeps the first few rows of each window over all its chunks and hands those on.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import for_python, release, written

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: Percent of a positive's score that a negative has at least and at most.
LOW, HIGH = 50, 95
CHUNK, BLOCK, GROUP = 2048, 512, 1 << 14
#: A vector of this length or more takes no part, as 100 times its scores would not fit 64 bits.
MAX_NORM = 1 << 28
_EXACT = 1 << 53

PACKED = "row array<long>, id array<long>, label array<int>, q array<int>"


def members(vectors: DataFrame) -> DataFrame:
    """row (a number of its own), id, label, q (array of int) of the rows of vectors (vec_id, embedding, label) that take part. See mined()."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    sound = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < MAX_NORM / SCALE))
    q = F.when(sound, F.transform(x, lambda v: F.floor(SCALE * v).cast("int")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("int")
    own = vectors.select(F.col("vec_id").alias("id"), label.alias("label"), q.alias("q")).where("q IS NOT NULL")
    return own.where(F.aggregate("q", F.lit(0.0), lambda s, v: s + v.cast("double") * v) < float(MAX_NORM) ** 2).select(F.monotonically_increasing_id().alias("row"), "id", "label", "q")


def _packed(size: int, more: tuple[str, ...] = ()):
    """Rows, in the order in which they come, as lists of `size` at most; with `more`, columns (lists of long) of the rows are joined to lists as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def handed(rows: pa.Table) -> pa.RecordBatch:
            own = [rows.column(c).combine_chunks() for c in ("row", "id", "label", "q", *more)]
            sizes = own[3].value_lengths().to_numpy()
            q = own[3].flatten().to_numpy()
            if (sizes != max(1, sizes.max())).any():  # of unequal lengths, missing components are 0
                wide = np.zeros((len(sizes), max(1, sizes.max())), np.int32)
                wide[np.arange(wide.shape[1]) < sizes[:, None]] = q
                q = wide.ravel()
            flat = [*own[:3], pa.array(q), *(x.flatten() for x in own[4:])]
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in flat], ["row", "id", "label", "q", *more])

        for batch in batches:
            while batch.num_rows:
                held.append(batch.slice(0, size - n))
                n, batch = n + held[-1].num_rows, batch.slice(size - n)
                if n == size:
                    yield handed(pa.Table.from_batches(held))
                    held, n = [], 0
            release()
        if n:
            yield handed(pa.Table.from_batches(held))

    return run


def _chunks(rows: DataFrame, size: int, more: tuple[str, ...] = ()) -> DataFrame:
    return for_python(rows.select("row", "id", "label", "q", *more)).mapInArrow(_packed(size, more), PACKED + "".join(f", {c} array<long>" for c in more))


def spanning_tree(q: np.ndarray) -> list[tuple[int, int, float]]:
    """(child, parent, distance) of a minimum spanning tree over the rows of q, children after their parents and below them at once; the first has parent -1."""
    n = len(q)
    near, link, inside, kids = np.full(n, np.inf), np.full(n, -1), np.zeros(n, bool), [[] for _ in range(n)]
    own = (q * q).sum(1)
    at = 0
    for _ in range(n):
        inside[at] = True
        if link[at] >= 0:
            kids[link[at]].append(at)
        d = np.maximum(own + own[at] - 2 * (q @ q[at]), 0)
        closer = ~inside & (d < near)
        near[closer], link[closer] = d[closer], at
        at = int(np.argmin(np.where(inside, np.inf, near)))
    order, left = [], [(0, -1)] if n else []
    while left:
        child, parent = left.pop()
        # the distance again from the difference, as it has to be an upper bound
        order.append((child, parent, 0.0 if parent < 0 else float(np.sqrt(((q[child] - q[parent]) ** 2).sum())) * (1 + 1e-12)))
        left += [(k, child) for k in kids[child]]
    return order


class _Best:
    """The first `keep` (score, id, row) of each window of one anchor."""

    def __init__(self, low: np.ndarray, high: np.ndarray, keep: int):
        self.low, self.high, self.keep = low.astype(np.float64), high.astype(np.float64), keep
        self.ends, self.starts = high, low
        self.found = [np.zeros((4, 0), np.int64)] * len(low)

    def wanted(self, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        want = np.zeros(len(least), bool)
        for low, high in zip(self.low, self.high, strict=True):
            want |= (most >= low) & (least <= high)
        return want

    def add(self, rows: np.ndarray) -> None:
        """rows: score, whether there is no id, id, row."""
        for w in range(len(self.low)):
            own = rows[:, (rows[0] >= self.starts[w]) & (rows[0] <= self.ends[w])]
            if not own.shape[1]:
                continue
            own = np.concatenate([self.found[w], own], 1)
            own = own[:, np.lexsort((own[3], own[2], own[1], -own[0]))[: self.keep]]
            self.found[w] = own
            if own.shape[1] == self.keep:
                self.low[w] = own[0, -1]


FOUND = "anchor long, slot int, score long, id long, row long"


def _scored(same: bool, keep: int):
    """The first `keep` rows of each window of each anchor, from pairs of a chunk of rows and a block of anchors (columns with a_); same: rows of the anchor's label, else of others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, _Best] = {}
        trees: dict[int, tuple] = {}
        told = None
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda c: batch.column(c)[i].values  # noqa: B023, E731
                row, label = get("row").to_numpy(), get("label").to_numpy()
                no_id, ids = get("id").is_null().to_numpy(zero_copy_only=False), get("id").fill_null(0).to_numpy(zero_copy_only=False)
                q = get("q").to_numpy().reshape(len(row), -1)
                first = get("a_row")[0].as_py()
                if first not in trees:
                    a = get("a_q").to_numpy().reshape(len(get("a_row")), -1)
                    rows, windows = get("a_row").to_numpy(), len(get("a_low")) // len(a)
                    low, high = (get(c).to_numpy().reshape(len(a), windows) for c in ("a_low", "a_high"))
                    trees[first] = a, rows, get("a_label").to_numpy(), spanning_tree(a.astype(np.float64))
                    best |= {r: _Best(lo, hi, keep) for r, lo, hi in zip(rows.tolist(), low, high, strict=True)}
                a, rows, labels, tree = trees[first]
                width = max(q.shape[1], a.shape[1])
                q, a = (np.pad(x, ((0, 0), (0, width - x.shape[1]))).astype(np.float64) for x in (q, a))
                norm = np.sqrt((q * q).sum(1)) * (1 + 1e-12)
                small = float(norm.max(initial=0)) * float(np.sqrt((a * a).sum(1).max(initial=0))) < _EXACT / 4
                q, a = (q, a) if small else (q.astype(np.int64), a.astype(np.int64))
                bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
                path: list[int] = []
                for child, parent, d in tree:
                    while path and path[-1] != parent:
                        bounds.pop(path.pop())
                    path.append(child)
                    if parent < 0:
                        score = q @ a[child]
                        least = most = score.astype(np.float64)
                        if not small:
                            least, most = least * (1 - 1e-12 * np.sign(least)) - 1, most * (1 + 1e-12 * np.sign(most)) + 1
                        want = np.ones(len(row), bool)
                    else:
                        least, most = bounds[parent]
                        slack = d * norm * (1 + 1e-9) + (0 if small else 1e-9 * norm * np.sqrt((a[child].astype(np.float64) ** 2).sum())) + 1
                        least, most = least - slack, most + slack
                    mine = best[int(rows[child])]
                    fits = (label == labels[child]) & (row != rows[child]) if same else label != labels[child]
                    take = np.flatnonzero(fits & mine.wanted(least, most)) if parent >= 0 else np.flatnonzero(fits)
                    own = (q[take] @ a[child]) if parent >= 0 else score[take]
                    if parent >= 0 and small:
                        least[take] = most[take] = own
                    bounds[child] = least, most
                    mine.add(np.stack([own.astype(np.int64), no_id[take], ids[take], row[take]]))
            release()
        told = [(anchor, slot, *x.tolist()) for anchor, own in best.items() for slot, found in enumerate(own.found) for x in found.T]
        for i in range(0, len(told), 1 << 16):
            anchor, slot, score, no_id, ids, row = zip(*told[i : i + (1 << 16)], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(slot, pa.int32()), pa.array(score, pa.int64()), pa.array(np.array(ids, np.int64), mask=np.array(no_id, bool)), pa.array(row, pa.int64())], ["anchor", "slot", "score", "id", "row"])

    return run


def _first(chunks: DataFrame, anchors: DataFrame, same: bool, keep: int) -> DataFrame:
    """anchor, slot, rank, score, id, row: the first `keep` rows of each window of the anchors (row, id, label, q, low, high)."""
    # near anchors stand together, and no block needs one task to see more than its own
    signs = F.concat_ws("", F.transform(F.slice("q", 1, 24), lambda v: F.when(v < 0, "0").otherwise("1")))
    ordered = anchors.withColumn("signs", signs).repartitionByRange("label", "signs", "row").sortWithinPartitions("label", "signs", "row")
    blocks = _chunks(ordered, BLOCK, ("low", "high"))
    blocks = written(blocks.select(*(F.col(c).alias(f"a_{c}") for c in blocks.columns), F.monotonically_increasing_id().alias("block")), "anchors")
    # groups of whole blocks, of GROUP anchors at most: what is broadcast is bounded
    sizes = sorted((r.block, r.n) for r in blocks.select("block", F.size("a_row").alias("n")).collect())
    groups, held = [[]], 0
    for block, n in sizes:
        if held + n > GROUP:
            groups, held = [*groups, []], 0
        groups[-1].append(block)
        held += n
    found = []
    for group in groups:
        own = F.broadcast(blocks.where(F.col("block").between(group[0], group[-1])).withColumn("one", F.lit(1))) if group else blocks.withColumn("one", F.lit(1))
        met = chunks.withColumn("one", F.lit(1)).join(own, "one").drop("one", "block")
        found.append(written(for_python(met).mapInArrow(_scored(same, keep), FOUND), "scored"))
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row")
    return reduce(DataFrame.union, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def mined(vectors: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of vectors (vec_id, embedding, label).

    Anchors are the rows whose vec_id is divisible by 50; where it is divisible by 7, the label first becomes (label + 1) % 10.
    Of each anchor, the first POSITIVES other rows of its label are positives; of each of these, the first NEGATIVES rows of
    other labels with LOW to HIGH percent of its score are returned, by score, then by vec_id (null last), then by row.
    Rows with a null label, a null vector, a null or non-finite component, or a length of MAX_NORM and more take no part. Every row stands for
    itself, whether its vec_id is repeated or null; of vectors of unequal lengths, missing components are 0. Other columns
    have no effect. An empty table gives an empty one.
    """
    rows = written(members(vectors), "members")
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = written(_chunks(rows.repartition(parts, "row"), CHUNK), "chunks")
    anchors = rows.where(F.col("id") % 50 == 0)
    limits = F.array(F.lit(-(1 << 62))), F.array(F.lit(1 << 62))
    best = written(_first(chunks, anchors.withColumns(dict(zip(("low", "high"), limits, strict=True))), True, POSITIVES), "positives")
    positives = best.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    # in whole numbers: LOW * p <= 100 * n <= HIGH * p; a slot without a positive has no window
    low = F.expr(f"({LOW} * score) div 100 + CASE WHEN ({LOW} * score) % 100 > 0 THEN 1 ELSE 0 END")
    high = F.expr(f"({HIGH} * score) div 100 - CASE WHEN ({HIGH} * score) % 100 < 0 THEN 1 ELSE 0 END")
    at = F.sort_array(F.collect_list(F.struct((F.col("rank") - 1).alias("slot"), low.alias("low"), high.alias("high"))))
    windows = best.groupBy("anchor").agg(at.alias("own"))
    empty = lambda field, other: F.transform(F.sequence(F.lit(0), F.lit(POSITIVES - 1)), lambda i: F.coalesce(F.try_element_at("own", i + 1)[field], F.lit(other)))
    windows = windows.select(F.col("anchor").alias("row"), empty("low", 1).alias("low"), empty("high", 0).alias("high"))
    negatives = _first(chunks, anchors.join(windows, "row"), False, NEGATIVES)
    named = anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    found = negatives.select("anchor", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(positives, ["anchor", "slot"]).join(named, "anchor")
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
