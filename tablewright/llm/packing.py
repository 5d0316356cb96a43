"""Concatenate and cut: every document's ids stand in one long row of tokens, which is cut every `length` tokens.

First pass: encode, write the ids with each document's offset in its partition. Second pass: prefix sums of the partitions'
token totals give each partition's offset; windows and the pieces at their boundaries follow from arithmetic. Nothing is
shuffled but one total for each partition.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import for_python, small, written
from .encoding import default_tokenizer, encoder, steps

LENGTH, END = 2048, 1
_ENCODED = "doc_id long, part int, at long, n long, ids binary"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encoded(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, part, at (the document's offset in its partition), n (its tokens with END), ids (16 bits each, END included)."""
    end = np.array([END], "<u2").tobytes()

    def work(batches):
        enc, part, at = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for b in steps(batches):
            ids, starts = enc.batch(b.column("text"))
            own = [ids[i:j].astype("<u2").tobytes() + end for i, j in zip(starts, starts[1:], strict=False)]
            n = np.diff(starts) + 1
            ends = at + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.full(len(n), part, np.int32)), pa.array(ends - n), pa.array(n), pa.array(own, pa.binary())], ["doc_id", "part", "at", "n", "ids"])
            at = int(ends[-1])
        enc.forget()

    return for_python(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, _ENCODED)


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for doc, at, n, ids in zip(*(b.column(x).to_pylist() for x in ("doc_id", "at", "n", "ids")), strict=True):
            start = 0
            while start < n:
                sequence, offset = divmod(at + start, length)
                size = min(length - offset, n - start)
                crc = zlib.crc32(np.frombuffer(ids, "<u2", size, 2 * start).astype("<u4"))
                rows.append((doc, start, size, crc, n, sequence, offset))
                start += size
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 7, [x.split()[0] for x in _PIECES.split(", ")])


def packed(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH) -> DataFrame:
    """One row for each piece of a document (doc_id, text), as _PIECES says; only the last sequence can be short.

    A null or empty text is its END id alone. Rows with a null or repeated doc_id are packed like any others. The row order
    within the input's partitions decides the places; it's fixed when the ids are written. An empty table gives no pieces.
    """
    table = written(encoded(docs, tokenizer or default_tokenizer()), "encoded")
    totals = table.groupBy("part").agg(F.sum("n").alias("total"))
    # one row for each partition of the input; a window over these alone
    bases = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    placed = table.join(small(written(bases, "bases")), "part").select("doc_id", (F.col("at") + F.col("base")).alias("at"), "n", "ids")
    return placed.mapInArrow(lambda batches: _cut(batches, length), _PIECES)
