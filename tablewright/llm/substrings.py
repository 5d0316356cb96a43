"""Exact substring deduplication: words covered by a window of WINDOW words that also starts earlier are cut out.

1. Rows of one text: all but that of the smallest doc_id are cut out whole, by a native aggregate. They take no further part.
2. A count-min sketch of the windows. Windows of one word sequence share their least GRAM-word hash, at the same place, so
   each place that is least in a window around it is counted once and stands for all windows there: the count of a window's
   least hash is never below the number of such windows. Every task sketches what it reads, sparse and in blocks of counters;
   blocks of all tasks are added up, each in one group of bounded size. What is left of the sketch is a bit for each counter: 2 or more.
3. A second pass looks all windows up. Those estimated to be repeated - with all that are - are grouped exactly, by 128 bits of
   their words. A task first groups its own, so that a passage of a third of all documents comes once from each task.

The sketch has four counters for each place, up to 2^MAX_BITS in each of its ROWS rows (64 MB of bits). In a corpus
that needs more (over some 3 GB of text), more windows pass on to the exact grouping; none is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import for_python, release, small, written
from .grams import mixed, sequences, sliding, text_numbers, word_hashes

WINDOW, GRAM, ROWS = 20, 6, 2
MIN_BITS, MAX_BITS, BLOCKS, BLOCK_BITS = 16, 28, 256, 22
#: Bytes of text to a counter: one place in some seven words, four counters each.
COUNTER_BYTES = 12
#: Places and windows that a task holds before it hands them on.
HELD = 1 << 20


def least_hashes(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window of consecutive words: its least GRAM-word hash, and whether it lies in one text; the hashes that are least in some such window, by place."""
    n = len(hashes) - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.uint64)
    span = WINDOW - GRAM + 1
    own = mixed(sequences(hashes, GRAM))
    least, text = sliding(np.minimum, own, span), text_numbers(bounds)
    inside = text[:n] == text[WINDOW - 1 :]
    edge = np.zeros(span - 1, np.uint64)
    most = sliding(np.maximum, np.concatenate([edge, np.where(inside, least, np.uint64(0)), edge]), span)
    return least, inside, own[most == own]


def _counters(places: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mixed(places + np.uint64((row + 1) * 0x632BE59BD9B4E019)) >> np.uint64(64 - bits)).astype(np.int64)


def _blocks(bits: int) -> int:
    """Bits of a counter's number within its block: BLOCKS blocks at least, of 2^BLOCK_BITS counters at most."""
    return max(8, min(BLOCK_BITS, bits - BLOCKS.bit_length() + 1))


SKETCHED = "part long, counters array<int>, counts array<tinyint>"


def _sketch(bits: int):
    low = _blocks(bits)

    def summed(places: np.ndarray) -> pa.RecordBatch:
        parts, at, n = [], [], []
        for row in range(ROWS):
            counter, count = np.unique(_counters(places, row, bits), return_counts=True)
            parts.append((counter >> low) + (row << bits - low))
            at.append(counter & (1 << low) - 1)
            n.append(np.minimum(count, 127))
        part, at, n = np.concatenate(parts), np.concatenate(at).astype(np.int32), np.concatenate(n).astype(np.int8)
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        bounds = pa.array(np.append(starts, len(part)).astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(part[starts]), pa.ListArray.from_arrays(bounds, pa.array(at)), pa.ListArray.from_arrays(bounds, pa.array(n))], ["part", "counters", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            hashes, bounds = word_hashes(batch.column("text"))
            held.append(least_hashes(hashes[:, 0], bounds)[2])
            n += len(held[-1])
            if n >= HELD:
                yield summed(np.concatenate(held))
                held, n = [], 0
            release()
        if n:
            yield summed(np.concatenate(held))

    return run


def _merged(bits: int):
    size = 1 << _blocks(bits)

    def run(part: pa.Table) -> pa.Table:
        counters, counts = (part.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("counters", "counts"))
        twice = np.bincount(counters, weights=counts, minlength=size) >= 2
        return pa.table({"part": part.column("part")[:1], "bits": pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())})

    return run


def repeated_counters(docs: DataFrame, bits: int) -> np.ndarray:
    """Of each row of the sketch over docs (text), a bit for each counter: whether it is 2 or more. ROWS x 2^bits / 8 bytes, bounded by MAX_BITS."""
    sketches = for_python(docs.select("text")).mapInArrow(_sketch(bits), SKETCHED)
    found = np.zeros((ROWS << bits - _blocks(bits), (1 << _blocks(bits)) // 8), np.uint8)
    for part, own in sketches.groupBy("part").applyInArrow(_merged(bits), "part long, bits binary").collect():
        found[part] = np.frombuffer(own, np.uint8)
    return found.reshape(ROWS, -1)


SEEN = "gone boolean, h1 long, h2 long, doc_id long, text_hash long, start int"


def _own(held: list[np.ndarray]) -> pa.RecordBatch:
    """Of windows (h1, h2, no_id, doc_id, text_hash, start): the first of each sequence, and the others as gone, under keys of their own."""
    h1, h2, no_id, doc, text, start = columns = np.concatenate(held, axis=1)
    columns = columns[:, np.lexsort((start, text, doc, no_id, h2, h1))]
    h1, h2, no_id, doc, text, start = columns
    new = np.ones(len(h1), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(h1)), 0))
    gone = (columns[2:] != columns[2:, first]).any(0)
    keep = new | gone  # a repeated row is its own double
    h1, h2 = np.where(gone, text, h1)[keep], np.where(gone, start, h2)[keep]
    return pa.RecordBatch.from_arrays([pa.array(gone[keep]), pa.array(h1), pa.array(h2), pa.array(doc[keep], mask=no_id[keep] > 0), pa.array(text[keep]), pa.array(start[keep].astype(np.int32))], ["gone", "h1", "h2", "doc_id", "text_hash", "start"])


def _estimated(bits: int, sketch):
    """sketch: a broadcast of repeated_counters()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            hashes, bounds = word_hashes(batch.column("text"))
            least, found, _ = least_hashes(hashes[:, 0], bounds)
            for row in range(ROWS):
                counter = _counters(least, row, bits)
                found &= sketch.value[row][counter >> 3] >> (counter & 7).astype(np.uint8) & 1 > 0
            start = np.flatnonzero(found)
            if len(start):
                text = text_numbers(bounds)[start]
                ids = batch.column("doc_id")
                doc, no_id = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
                own = (sequences(hashes[:, 0], WINDOW)[start].view(np.int64), sequences(hashes[:, 1], WINDOW)[start].view(np.int64), no_id[text], doc[text], batch.column("text_hash").to_numpy(zero_copy_only=False)[text], start - bounds[text])
                held.append(np.stack([x.astype(np.int64, copy=False) for x in own]))
                n += len(start)
            if n >= HELD:
                yield _own(held)
                held, n = [], 0
            release()
        if n:
            yield _own(held)

    return run


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _spans(starts: pa.Array) -> pa.Array:
    """Starts of windows as the begin and end of each run of covered words."""
    made = []
    for own in starts:
        at = np.unique(own.values.to_numpy(zero_copy_only=False))
        new = np.flatnonzero(np.diff(at) > WINDOW)
        made.append(np.stack([at[np.append(0, new + 1)], at[np.append(new, len(at) - 1)] + WINDOW], 1).ravel().astype(np.int32))
    return pa.array(made, pa.list_(pa.int32()))


_CUT = T.StructType([T.StructField("kept", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])


@F.arrow_udf(_CUT)
def _cut(texts: pa.Array, whole: pa.Array, spans: pa.Array) -> pa.Array:
    kept, n_words, n_removed = [], [], []
    for text, all_of_it, own in zip(texts, whole, spans, strict=True):
        words = (text.as_py() or "").encode("utf-8", "replace").split()
        n = len(words)
        if all_of_it.as_py() and n >= WINDOW:
            words = []
        elif own.is_valid:
            at = [0, *own.as_py(), n]
            words = [w for i, j in zip(at[::2], at[1::2], strict=True) for w in words[i:j]]
        kept.append(b" ".join(words).decode("utf-8"))
        n_words.append(n)
        n_removed.append(n - len(words))
    return pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], ["kept", "n_words", "n_removed"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text), whole, spans: what is to be cut out of docs (doc_id, text), one row for each such id and text.

    whole: all words, if there are WINDOW of them. spans: begin and end (beyond the last) of each covered run of words, in order.
    """
    long = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).where(F.octet_length("text") >= 2 * WINDOW - 1)
    keys = long.select("doc_id", "text_hash", F.md5("text").alias("key"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id")).alias("first")
    # written apart from the aggregate, so that the join isn't bound to its partitions and a hot text can be split
    copied = written(keys.groupBy("key").agg(first, F.count("*").alias("n")).where("n > 1").select("key", F.col("first.doc_id").alias("first")), "copied")
    others = keys.join(small(copied), "key").where(~F.col("doc_id").eqNullSafe(F.col("first")))
    wholes = written(others.select("doc_id", "text_hash").distinct(), "copies")
    gone = small(wholes.toDF("__gone", "__gone_hash"))
    own = long.join(gone, F.col("doc_id").eqNullSafe(F.col("__gone")) & (F.col("text_hash") == F.col("__gone_hash")), "left_anti")
    size = long.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bits = max(MIN_BITS, min(MAX_BITS, (size // COUNTER_BYTES).bit_length()))
    sketch = docs.sparkSession.sparkContext.broadcast(repeated_counters(own, bits))
    seen = for_python(own).mapInArrow(_estimated(bits, sketch), SEEN)
    # of one sequence there is a row from each task at most, so no group grows with the documents
    order = Window.partitionBy("gone", "h1", "h2").orderBy(F.col("doc_id").asc_nulls_last(), "text_hash", "start")
    covered = seen.withColumn("rank", F.rank().over(order)).where("gone OR rank > 1")
    spans = covered.groupBy("doc_id", "text_hash").agg(F.collect_list("start").alias("starts")).select("doc_id", "text_hash", F.lit(False).alias("whole"), _spans("starts").alias("spans"))
    found = written(spans.unionByName(wholes.withColumn("whole", F.lit(True)), allowMissingColumns=True), "spans")
    sketch.unpersist()
    return found


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the columns kept (the words that stay, one space between them), n_words and n_removed (long). Columns of these names are replaced.

    Words are what ASCII white space parts; a window is judged on the input, not on what is left. Null and empty texts have
    no words and stay. Documents come in the order of doc_id, those without one last; of different texts under one doc_id,
    the text of the smaller xxhash64 comes first. Rows that repeat doc_id and text come out alike, judged as one.
    An empty table gives an empty one.
    """
    spans = repeated_spans(docs.select("doc_id", "text")).toDF("__id", "__hash", "__whole", "__spans")
    names = [c for c in docs.columns if c.lower() not in ("kept", "n_words", "n_removed")]
    at = F.struct(*(F.col(f"`{c}`") for c in names)).alias("__doc")
    own = for_python(docs).select(at).join(small(spans), F.col("__doc.doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("__doc.text") == F.col("__hash")), "left")
    made = own.select("__doc", _cut("__doc.text", F.coalesce("__whole", F.lit(False)), "__spans").alias("__cut"))
    return made.select(*(F.col(f"__doc.`{c}`") for c in names), "__cut.kept", "__cut.n_words", "__cut.n_removed")
