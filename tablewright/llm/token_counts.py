"""Exact histogram of encoded lengths, with suffix sums that answer every context limit."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import for_python, written
from .encoding import default_tokenizer, encoder, steps

#: Lengths in one block of the suffix sums.
BLOCK = 1024


def lengths(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """length: encoded length of every row of docs (text); a null text has 0."""
    path = tokenizer or default_tokenizer()

    def work(batches):
        enc = encoder(path)
        for b in steps(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.diff(enc.batch(b.column("text"))[1]))], ["length"])
        enc.forget()

    return for_python(docs).select("text").mapInArrow(work, "length long")


def length_table(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """A row for each encoded length that occurs in docs, as a context limit of that many tokens:

    length; n_docs of just that length; n_tokens in these; docs_over and tokens_over in longer documents; tokens_kept when
    every document is cut at `length`; tokens_lost by that cut; share_within, of documents no longer (so the smallest length
    with share_within >= q is the quantile q). Null and empty texts count with length 0; an empty table gives no rows.

    Counts are aggregated before the shuffle. Suffix sums go in two levels, within blocks of BLOCK lengths and over the
    blocks' totals, so no window holds more than the blocks of the longest text.
    """
    hist = written(lengths(docs, tokenizer).groupBy("length").agg(F.count("*").alias("n_docs")), "lengths")
    hist = hist.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("n_tokens"), F.floor(F.col("length") / BLOCK).alias("block"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_after"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_after"), F.sum("d").over(everything).alias("d_all"), F.sum("t").over(everything).alias("t_all"))
    inside = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    rows = hist.join(F.broadcast(blocks), "block").select(
        "length", "n_docs", "n_tokens", "d_all", "t_all",
        (F.coalesce(F.sum("n_docs").over(inside), F.lit(0)) + F.col("d_after")).alias("docs_over"),
        (F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)) + F.col("t_after")).alias("tokens_over"),
    )
    lost = F.col("tokens_over") - F.col("docs_over") * F.col("length")
    return rows.select("length", "n_docs", "n_tokens", "docs_over", "tokens_over", (F.col("t_all") - lost).alias("tokens_kept"), lost.alias("tokens_lost"), ((F.col("d_all") - F.col("docs_over")) / F.col("d_all")).alias("share_within"))
