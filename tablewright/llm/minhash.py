"""Near copies by exact 5-word Jaccard similarity: candidates from MinHash bands, confirmed on the sets of shingles.

BANDS bands of ROWS minima each: a pair at similarity 0.8 shares no band with probability (1 - 0.8^4)^14 = 6e-4, and
more similar ones less. All pairs of a bucket are candidates. Of a bucket over MAX_BUCKET entries, these are first all
pairs with its PIVOTS pivots, those that share most buckets with other entries, as the original of a group of copies does.
Where the links found do not connect the whole bucket, the entries outside its largest component are then looked up in an
exact set-similarity join: a pair at the threshold shares a shingle among the rarest few of both (prefix filter), and an
entry that has many shingles of its own has only these there, so it meets nothing. No connection within a bucket is missed.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import for_python, per_text, small, written
from .components import components
from .encoding import STEP_BYTES, cut

SHINGLE, THRESHOLD, SEED = 5, 0.8, 42
BANDS, ROWS = 14, 4
MAX_BUCKET, PIVOTS = 64, 8
#: Bits of the number of a counter of shingles, at most, and within a block.
COUNTER_BITS, COUNTER_BLOCK = 22, 12
_hash = partial(xxhash.xxh64_intdigest, seed=SEED)
_random = np.random.default_rng(SEED)
_MASKS, _FACTORS = _random.integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
_FACTORS |= np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct 5-word shingles; of all words if they are fewer; none of a wordless or null text."""
    pieces = (piece.encode("utf-8", "replace").lower().split() for piece in cut(text or "", STEP_BYTES))  # as in simhash.fingerprint
    own = np.concatenate([np.fromiter(map(_hash, words), np.uint64, len(words)) for words in pieces])
    if not len(own):
        return own
    k = min(SHINGLE, len(own))
    total = np.full(len(own) - k + 1, k, np.uint64)
    for i in range(k):
        total = total * _STEP + own[i : len(own) - k + 1 + i]
    return np.unique(_mixed(total))


def bands(hashes: np.ndarray) -> np.ndarray:
    """A key for each band of a set of hashes."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for i in range(0, len(hashes), 1 << 12):
        least = np.minimum(least, ((hashes[i : i + (1 << 12), None] ^ _MASKS) * _FACTORS).min(0))
    key = np.zeros(BANDS, np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        key = _mixed(key * _STEP + column)
    return key


def number(hashes: np.ndarray) -> int:
    return int(np.uint64(_hash(hashes.tobytes())).astype(np.int64))


def _sets(texts: pa.Array) -> pa.Array:
    found = [shingles(x.as_py()) for x in texts]
    return pa.StructArray.from_arrays([pa.array([number(h) for h in found], pa.int64()), pa.array([h.view(np.int64) for h in found], pa.list_(pa.int64()))], ["cls", "hashes"])


hashed = per_text(T.StructType([T.StructField("cls", T.LongType()), T.StructField("hashes", T.ArrayType(T.LongType()))]), lambda: _sets)


def _fitting(pairs: DataFrame) -> DataFrame:
    """Distinct a < b of pairs (a, b, n, m: numbers of shingles) whose sizes let them be THRESHOLD alike."""
    both = pairs.where("a <> b").where(F.least("n", "m") >= THRESHOLD * F.greatest("n", "m") - 1e-9)
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _posted(classes: DataFrame) -> DataFrame:
    """band, key, cls, n, size (of the bucket) of the sets of classes in buckets of several."""
    filed = classes.select("cls", "n", F.posexplode("bands").alias("band", "key"))
    sizes = filed.groupBy("band", "key").agg(F.count("*").alias("size")).where("size > 1")
    return written(filed.join(sizes, ["band", "key"]), "bands")


def candidates(posted: DataFrame) -> DataFrame:
    """a, b: numbers of sets that share a bucket of at most MAX_BUCKET entries, or a larger one of which one is a pivot."""
    cold, hot = posted.where(F.col("size") <= MAX_BUCKET), posted.where(F.col("size") > MAX_BUCKET)
    slot = F.pmod(F.xxhash64("cls", "band"), F.lit(PIVOTS))
    degrees = hot.groupBy("cls").agg(F.sum("size").alias("degree"))
    pivots = hot.join(small(degrees), "cls").groupBy("band", "key", slot.alias("slot")).agg(F.max(F.struct("degree", "cls", "n")).alias("p"))
    pivots = written(pivots, "pivots")
    pivots = pivots.select("band", "key", F.col("p.cls").alias("b"), F.col("p.n").alias("m"))
    pairs = cold.select("band", "key", F.col("cls").alias("a"), "n").join(cold.select("band", "key", F.col("cls").alias("b"), F.col("n").alias("m")), ["band", "key"]).where("a < b")
    stars = hot.select("band", "key", F.col("cls").alias("a"), "n").join(small(pivots), ["band", "key"])
    return _fitting(pairs.select("a", "b", "n", "m").union(stars.select("a", "b", "n", "m")))


def _sets_of(nodes: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """cls, hashes: the sets whose numbers are in nodes (cls)."""
    ids = written(classes.join(nodes, "cls", "left_semi").select(F.col("first").alias("__id")).distinct(), "ids")
    own = for_python(docs).join(small(ids), F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi").select(hashed("text").alias("h")).select("h.*")
    return written(own.join(small(nodes), "cls", "left_semi").dropDuplicates(["cls"]), "sets")


def loose_entries(posted: DataFrame, found: DataFrame) -> DataFrame:
    """cls, n, root, low, loose: the sets of large buckets that the links `found` (a, b) leave in several components; of each its

    component, the fewest shingles of a set that shares such a bucket, and whether it is outside the largest component of one.
    """
    roots = components(found).withColumnRenamed("node", "cls")
    hot = written(posted.where(F.col("size") > MAX_BUCKET).join(small(roots), "cls", "left").select("band", "key", "cls", "n", F.coalesce("root", "cls").alias("root")), "hot")
    sizes = hot.groupBy("band", "key", "root").agg(F.count("*").alias("c"), F.min("n").alias("low"))
    split = sizes.groupBy("band", "key").agg(F.count("*").alias("kinds"), F.max(F.struct("c", "root")).alias("most"), F.min("low").alias("low")).where("kinds > 1")
    inside = hot.join(small(written(split.select("band", "key", F.col("most.root").alias("most"), "low"), "split")), ["band", "key"])
    return inside.groupBy("cls").agg(F.first("n").alias("n"), F.first("root").alias("root"), F.min("low").alias("low"), F.max(F.col("root") != F.col("most")).alias("loose"))


def frequencies(sets: DataFrame, bits: int) -> np.ndarray:
    """How often shingles of the sets (hashes) fall in each of 2^bits counters, by their first bits: never less than a shingle's own number of sets.

    Each task counts what it reads; the counts of all tasks are added up in blocks of counters. 4 << bits bytes reach the driver.
    """
    low = min(bits, COUNTER_BLOCK)

    def counted(batches):
        own = np.zeros(1 << bits, np.int64)
        for batch in batches:
            at, n = np.unique(batch.column(0).flatten().to_numpy().view(np.uint64) >> np.uint64(64 - bits), return_counts=True)
            own[at.astype(np.int64)] += n
        at = np.flatnonzero(own)
        part = at >> low
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        bounds = pa.array(np.append(starts, len(at)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in ((at & (1 << low) - 1).astype(np.int32), own[at])]
        yield pa.RecordBatch.from_arrays([pa.array(part[starts]), *lists], ["part", "counters", "counts"])

    def added(part: pa.Table) -> pa.Table:
        at, n = (part.column(c).combine_chunks().flatten().to_numpy() for c in ("counters", "counts"))
        total = np.minimum(np.bincount(at, weights=n, minlength=1 << low), (1 << 31) - 1).astype("<i4")
        return pa.table({"part": part.column("part")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    found = np.zeros((1 << bits - low, 1 << low), np.int32)
    rows = for_python(sets).select("hashes").mapInArrow(counted, "part long, counters array<int>, counts array<long>").groupBy("part").applyInArrow(added, "part long, counts binary")
    for part, counts in rows.collect():
        found[part] = np.frombuffer(counts, "<i4")
    return found.ravel()


def _rarest(bits: int, counts):
    """The first `take` hashes of a set by their counters (a broadcast of frequencies()), then by value: one order for all sets."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def first(hashes: pa.Array, take: pa.Array) -> pa.Array:
        made = []
        for own, n in zip(hashes, take.to_pylist(), strict=True):
            x = own.values.to_numpy()
            made.append(x[np.lexsort((x, counts.value[(x.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)]))[:n]])
        return pa.array(made, pa.list_(pa.int64()))

    return first


def unconnected(members: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: of the sets (cls, hashes) of loose_entries(), each loose one and what it shares one of the rarest shingles of both with, as pairs of THRESHOLD do.

    Rare is what has few sets by counters of the shingles' first bits; any one order of all shingles is exact, and this one needs
    no table of them: only the prefixes are taken out of the sets.
    """
    size = members.agg(F.sum("n")).first()[0] or 1
    bits = max(10, min(COUNTER_BITS, (4 * size).bit_length()))
    counts = members.sparkSession.sparkContext.broadcast(frequencies(sets, bits))
    least = F.greatest(F.ceil(THRESHOLD * F.col("n") - 1e-9), F.col("low"))  # shingles of a partner
    shared = F.ceil(THRESHOLD / (1 + THRESHOLD) * (F.col("n") + least) - 1e-9)
    taken = for_python(sets).join(small(members), "cls").withColumn("tokens", _rarest(bits, counts)("hashes", (F.col("n") - shared + 1).cast("int")))
    # rank: the place of a shingle in its set, from 1
    prefix = written(taken.select("cls", "n", "root", "loose", F.posexplode("tokens").alias("at", "token")).withColumn("rank", F.col("at") + 1), "prefixes")
    counts.unpersist()
    loose = prefix.where("loose").select("token", F.col("cls").alias("a"), "n", "rank", F.col("root").alias("root_a"))
    others = prefix.select("token", F.col("cls").alias("b"), F.col("n").alias("m"), F.col("rank").alias("rank_b"), F.col("root").alias("root_b"))
    need = F.ceil(THRESHOLD / (1 + THRESHOLD) * (F.col("n") + F.col("m")) - 1e-9)
    # of two components, with enough shingles left in both from the shared one on (positional filter)
    return _fitting(loose.join(others, "token").where("root_a <> root_b").where(1 + F.least(F.col("n") - F.col("rank"), F.col("m") - F.col("rank_b")) >= need))


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs (a, b) with a Jaccard similarity of THRESHOLD at least."""
    a, b = sets.select(F.col("cls").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("cls").alias("b"), F.col("hashes").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    return written(pairs.join(a, "a").join(b, "b").where(shared >= THRESHOLD * (F.size("x") + F.size("y") - shared) - 1e-9).select("a", "b"), "alike")


def links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b: sets of classes (cls, n, bands, first: a doc_id or null) of docs (doc_id, text) with a Jaccard similarity of THRESHOLD at least.

    Of buckets over MAX_BUCKET entries, not all links are returned, but all that connect their entries.
    """
    posted = _posted(classes)
    pairs = written(candidates(posted), "candidates")
    nodes = written(pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct(), "nodes")
    found = _confirmed(pairs, _sets_of(nodes, docs, classes))
    if posted.where(F.col("size") > MAX_BUCKET).isEmpty():
        return found
    members = written(loose_entries(posted, found), "members")
    if members.isEmpty():
        return found
    sets = _sets_of(members.select("cls"), docs, classes)
    return found.union(_confirmed(written(unconnected(members, sets), "unconnected"), sets))
