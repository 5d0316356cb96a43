"""What several text operators need: a shared folder, bounded samples, size-checked joins."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from operator import add

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A table is broadcast only up to this many measured bytes; beyond, it is shuffled.
BROADCAST_BYTES = 24 << 20
#: Bytes of one Arrow batch that a task sends to its Python worker, unless the session sets another number.
ARROW_BYTES = 2 << 20

#: Rows that a Parquet reader holds at once in the pipeline, unless the session sets another number.
READ_ROWS = 512


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a new folder in /tmp in local mode, an error on a cluster."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(path)
        path = sc.getCheckpointDir() or path
    return path


def for_python(docs: DataFrame) -> DataFrame:
    """docs, after limiting the session's Arrow batches by bytes, as texts can be of any length."""
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    conf.set(key, conf.get(key, str(ARROW_BYTES)))
    return docs


def narrow_reads(spark: SparkSession) -> None:
    """Limits the rows that a Parquet reader holds at once, unless the session sets a number: 4,096 texts take arrays of tens of MB, for which an executor's heap grows."""
    key = "spark.sql.parquet.columnarReaderBatchSize"
    spark.conf.set(key, spark.conf.get(key, str(READ_ROWS)))


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet in the shared folder and read again: a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tablewright-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """df.checkpoint(), after making sure that there is a folder for it."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def release() -> None:
    """Gives what a large step has freed back to the system. Python workers serve many tasks beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def per_text(kind: T.DataType, start: Callable[[], Callable[[pa.Array], pa.Array]]):
    """A function of a column of texts: start() is called once a task and gives what makes results of a batch of texts; what it keeps goes with the task."""

    @F.arrow_udf(kind)
    def each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = start()
        for texts in batches:
            yield work(texts)
            release()
        work = None
        gc.collect()  # what a task has unpickled and kept can hang together in cycles
        release()

    return each


def with_results(docs: DataFrame, made: Column, names: list[str]) -> DataFrame:
    """docs and the fields of the struct `made`, renamed to `names`. An input column of such a name is replaced."""
    held = "__made"
    while held in docs.columns:
        held += "_"
    kept = [c for c in docs.columns if c.lower() not in {n.lower() for n in names}]
    fields = docs.withColumn(held, made)
    return fields.select(*(F.col(f"`{c}`") for c in kept), *(F.col(f"{held}.{f}").alias(n) for f, n in zip(fields.schema[held].dataType.names, names, strict=True)))


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo the number of folds; null keys give null."""
    return F.crc32(key.cast("string")) % folds


def bounded(df: DataFrame, key: str, limit: int) -> DataFrame:
    """About `limit` rows at most (the binomial spread of a hash threshold above it), the same ones in every run; all rows if there are fewer."""
    total = df.count()
    if total <= limit:
        return df
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(1 << 30)) < int((1 << 30) * limit / total))


def labelled(docs: DataFrame, labels: DataFrame, label: str, keep: Column, limit: int) -> DataFrame:
    """doc_id, text, y of a bounded sample of labelled documents; the sample of the labels is joined by broadcast, so no text is shuffled.

    keep: which labels may be learned from. A doc_id with several labels counts once, with the largest; null labels don't count.
    """
    ys = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & keep).groupBy("doc_id").agg(F.max(label).cast("double").alias("y"))
    return docs.select("doc_id", "text").join(F.broadcast(bounded(ys, "doc_id", limit)), "doc_id")


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its values, written as text, and 16 bytes for each stay within the limit; as it is otherwise. df should be cheap to read twice."""
    width = reduce(add, (F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 16 for c in df.columns))
    return F.broadcast(df) if (df.agg(F.sum(width.cast("long"))).first()[0] or 0) <= limit else df


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id isn't among ids (one column, doc_id). Rows with a null doc_id stay."""
    return docs.join(small(ids.withColumnRenamed("doc_id", "__gone")), F.col("doc_id") == F.col("__gone"), "left_anti")
