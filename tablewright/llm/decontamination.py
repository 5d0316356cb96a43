"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items are partitioned by their number of distinct shingles, with upper sizes of 8, 16, 32 and so on. Every partition has one
signature length and one threshold of matches, both from its upper size. An item's MinHash signature is as many of its
smallest shingle hashes. Only items are sketched, as containment MinHash does: a signature of a long document would hold
next to nothing of a short item, so documents are looked up with all their hashes, and the matches of each signature are
tallied. A document that holds THRESHOLD of an item's n shingles lacks at most (1 - THRESHOLD) * n of any of them, so with a
signature longer than that by the partition's threshold no true pair stays below it. Candidates are verified exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, written

SHINGLE, THRESHOLD = 5, 0.8
#: Upper size of the first partition, and shingles of a partition's upper size for each match that it asks for.
FIRST, EACH = 8, 16


def _let(value: Column, then) -> Column:
    """then(value), with value computed once for a row, however often lambdas in `then` look at it."""
    return F.transform(F.array(value), then)[0]


def words(text: Column) -> Column:
    """Lower-case runs of letters, marks on letters and digits; none for null."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), "")


def _windows(x: Column, made) -> Column:
    """made(five columns) of every SHINGLE elements in a row of the array x, distinct; of all of them, then nulls, if there are fewer; none if x is empty."""
    starts = F.when(F.size(x) > 0, F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(x) - SHINGLE))).otherwise(F.array().cast("array<int>"))
    # single elements, as slice() copies the whole array each time
    return F.array_distinct(F.transform(starts, lambda i: made(*(F.get(x, i + k) for k in range(SHINGLE)))))


def _hashes(text: Column) -> Column:
    return _let(F.transform(words(text), lambda w: F.xxhash64(w)), lambda h: _windows(h, F.xxhash64))


def _shingles(text: Column) -> Column:
    return _let(words(text), lambda w: _windows(w, lambda *part: F.concat_ws(" ", *part)))


def signatures(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """item_id, hash, upper, least: a row for each hash of the signature of each of items (item_id, text), its partition's upper size and threshold of matches.

    Rows that repeat an id are one item. A text without shingles has no rows. Where an item has fewer hashes than its
    partition's signature length, all are its signature.
    """
    own = Window.partitionBy("item_id")
    hashes = items.select("item_id", F.explode(_hashes(F.col("text"))).alias("hash")).distinct()
    sized = hashes.select("item_id", "hash", F.count("*").over(own).alias("n"), F.row_number().over(own.orderBy("hash")).alias("rank"))
    upper = FIRST * F.pow(2.0, F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / FIRST) - 1e-9)))
    sized = sized.withColumn("upper", upper.cast("int"))
    least = F.least(F.ceil(F.col("upper") / EACH), F.greatest(F.lit(1), F.ceil(threshold * F.col("upper") / 2 - 1e-9)))
    lacking = F.floor((1 - threshold) * F.col("upper") + 1e-9)
    return sized.withColumn("least", least.cast("int")).where(F.col("rank") <= lacking + F.col("least")).select("item_id", "hash", "upper", "least")


def candidates(docs: DataFrame, sketch: DataFrame) -> DataFrame:
    """doc_id, item_id of docs (doc_id, text) that hold at least `least` of the hashes of an item's signature."""
    hashed = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.explode(_hashes(F.col("text"))).alias("hash"))
    matched = hashed.join(small(sketch), "hash").groupBy("doc_id", "item_id").agg(F.count_distinct("hash").alias("matches"), F.first("least").alias("least"))
    return matched.where("matches >= least").select("doc_id", "item_id")


def contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment: every document (doc_id, text) that holds at least `threshold` of an item's (item_id, text) distinct shingles.

    Texts of fewer than SHINGLE words have one shingle, all their words; a null or wordless text has none and is in no
    result, nor is a null id. Rows that repeat an id count together: their shingles are united. Empty tables give no rows.
    """
    items = items.where(F.col("item_id").isNotNull()).select("item_id", "text")
    own = written(items.select("item_id", F.explode(_shingles(F.col("text"))).alias("shingle")).distinct(), "items")
    sketch = written(signatures(items, threshold), "signatures")
    pairs = written(candidates(docs, sketch), "candidates")
    # only candidates' texts are read again, and of their shingles only those of some item are kept before the pairs meet
    texts = docs.select("doc_id", "text").join(small(pairs.select("doc_id").distinct()), "doc_id", "left_semi")
    shingles = texts.select("doc_id", F.explode(_shingles(F.col("text"))).alias("shingle"))
    held = shingles.join(small(own), "shingle").select("doc_id", "item_id", "shingle").join(small(pairs), ["doc_id", "item_id"], "left_semi")
    shared = held.distinct().groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"))
    sizes = own.groupBy("item_id").agg(F.count("*").alias("n_item"))
    share = F.col("n_shared") / F.col("n_item")
    return shared.join(small(sizes), "item_id").where(F.col("n_shared") >= F.lit(threshold) * F.col("n_item") - 1e-9).select("doc_id", "item_id", "n_shared", "n_item", share.alias("containment"))


def decontaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose text contains an item.

    Rows are told apart by the hash of id and text, so each row is judged by its own text, also where its id is null or
    repeated; rows that repeat both go or stay together. Null and wordless texts stay, as does everything where there are no items.
    """
    key = F.xxhash64("doc_id", "text")
    leaks = written(contained(docs.select(key.alias("doc_id"), "text"), items, threshold).select(F.col("doc_id").alias("__leak")).distinct(), "leaks")
    return docs.join(small(leaks), key == F.col("__leak"), "left_anti")
