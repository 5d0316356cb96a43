"""SimHash near-duplicates: byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most 2 bits share at least 6 of their 8 positional bytes. Postings of single
positional bytes hold 1/256 of all fingerprints each, and pairs over them grow with the square of the corpus, so the index
files every distinct fingerprint under joint positional bytes: those of two of its four byte pairs (6 keys of 4 bytes).
Differing bytes break two byte pairs at most, so a link shares a posting, and the postings that a pair shares tell which
positional bytes it has in common: these are tallied by pair, pairs of MIN_TALLY positions and more are kept, and verified
by their differing bits. A posting over MAX_POSTING entries isn't paired: its entries are filed under themselves and under
each fingerprint one bit away (65 keys). Two fingerprints differ in at most 2 bits exactly if they share such a key, and no
key can hold more than 65 fingerprints, so this is exact and grows in proportion to the posting.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import minhash
from .common import for_python, per_text, small, without, written
from .components import components
from .encoding import STEP_BYTES, cut

SHINGLE, SEED, MAX_BITS = 3, 42, 2
#: Positional bytes that the shared postings of two fingerprints MAX_BITS apart cover at least: two whole byte pairs.
MIN_TALLY = 8 - 2 * MAX_BITS
MAX_POSTING = 64
_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def fingerprint(text: str | None) -> int:
    """Signed value of the 64-bit SimHash of a text; 0 if it is null or has no word. A long text is looked at in pieces."""
    ones, total, last = np.zeros(64, np.int64), 0, []
    for piece in cut(text or "", STEP_BYTES):
        words = [*last, *piece.encode("utf-8", "replace").lower().split()]  # bytes: only A-Z are lower-cased, only ASCII white space splits
        last = words[-(SHINGLE - 1) :]
        grams = list(map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False)))
        for i in range(0, len(grams), 1 << 15):
            part = grams[i : i + (1 << 15)]
            hashes = np.fromiter(map(_hash, part), "<u8", len(part))
            ones += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
        total += len(grams)
    if not total and last:
        return int(np.array([_hash(b" ".join(last))], "<u8").view("<i8")[0])
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def _signatures(texts: pa.Array) -> pa.Array:
    """Fingerprint, number of 5-word shingles, a number of their set, and its band keys (none without shingles)."""
    own = [x.as_py() for x in texts]
    sets = [minhash.shingles(x) for x in own]
    bands = pa.array([minhash.bands(h).view(np.int64) if len(h) else np.zeros(0, np.int64) for h in sets], pa.list_(pa.int64()))
    return pa.StructArray.from_arrays([pa.array(list(map(fingerprint, own)), pa.int64()), pa.array(list(map(len, sets)), pa.int32()), pa.array(list(map(minhash.number, sets)), pa.int64()), bands], ["fp", "n", "cls", "bands"])


#: One function for both, so that a task has one Python worker.
_signature = per_text(T.StructType([T.StructField("fp", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("cls", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))]), lambda: _signatures)
_fingerprints = per_text(T.LongType(), lambda: lambda texts: pa.array([fingerprint(x.as_py()) for x in texts], pa.int64()))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (signed long) of every row of docs."""
    return for_python(docs).select("doc_id", _fingerprints("text").alias("fp"))


def _byte_pair(fp, i: int):
    return F.shiftrightunsigned(fp, 16 * i).bitwiseAND(0xFFFF)


def links(distinct: DataFrame) -> DataFrame:
    """a, b: fingerprints of `distinct` (fp) whose links connect exactly what differs in at most MAX_BITS bits.

    Small postings give all their links; large ones link the fingerprints under each one-bit key to the smallest there.
    """
    fp = F.col("fp")
    keys = F.array(
        *(
            F.struct(F.lit(3 << 2 * i | 3 << 2 * j).alias("positions"), F.shiftleft(_byte_pair(fp, i), 16).bitwiseOR(_byte_pair(fp, j)).alias("key"))
            for i, j in combinations(range(4), 2)
        )
    )
    filed = distinct.select("fp", F.inline(keys))
    sizes = filed.groupBy("positions", "key").agg(F.count("*").alias("size")).where("size > 1")
    # written once: the six-fold index is read by the cold join (twice) and by the hot path
    posted = written(filed.join(sizes, ["positions", "key"]), "postings")
    cold = posted.where(F.col("size") <= MAX_POSTING)
    pairs = (
        cold.select("positions", "key", F.col("fp").alias("a"))
        .join(cold.select("positions", "key", F.col("fp").alias("b")), ["positions", "key"])
        .where("a < b")
        .groupBy("a", "b")
        .agg(F.bit_count(F.bit_or("positions")).alias("tally"))
        .where(F.col("tally") >= MIN_TALLY)
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)
        .select("a", "b")
    )
    hot = posted.where(F.col("size") > MAX_POSTING).select("fp").distinct()
    near = F.transform(F.sequence(F.lit(-1), F.lit(63)), lambda i: F.when(i < 0, fp).otherwise(fp.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    groups = hot.select("fp", F.explode(near).alias("probe")).groupBy("probe").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    stars = groups.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).where("a <> b")
    return pairs.union(stars)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id of every row of docs (doc_id, text).

    component_id is the smallest doc_id that links of at most MAX_BITS differing bits reach. Null and wordless texts have
    fingerprint 0 and are linked like any other. Rows with a null doc_id keep it and count for reaching, not as the
    smallest; a group of such rows alone has a null component_id. Repeated rows come out as often as they went in.
    Copies meet in one distinct fingerprint before any pair is formed. An empty table gives an empty one.
    """
    return _grouped(written(fingerprints(docs), "fingerprints")).drop("kept", "root")


def near_copies(docs: DataFrame) -> DataFrame:
    """near_duplicates() where texts of an exact 5-word Jaccard similarity of 0.8 (minhash.links) are linked as well.

    kept: whether (doc_id, fp) is the smallest of its component, which holds for one such pair of each component with a doc_id.
    """
    fps = written(for_python(docs).select("doc_id", _signature("text").alias("s")).select("doc_id", "s.*"), "fingerprints")
    sets = written(fps.where("n > 0").groupBy("cls").agg(F.min("fp").alias("fp"), F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands")), "sets")
    alike = minhash.links(docs, sets)
    at = sets.select("cls", F.col("fp").alias("least"))
    # sets stand for their least fingerprint, to which the others of the set are linked
    others = fps.select("cls", "fp").distinct().join(at, "cls").where("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b"))
    moved = alike.join(at.toDF("a", "fp_a"), "a").join(at.toDF("b", "fp_b"), "b").select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b"))
    return _grouped(fps.select("doc_id", "fp"), written(others.union(moved).distinct(), "alike"))


def _grouped(fps: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """fps (doc_id, fp) with component_id, kept and root (its smallest fp), by links() and the links a, b of `more`."""
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    found = links(classes.select("fp"))
    roots = components(found if more is None else found.union(more))
    linked = roots.join(classes, F.col("node") == F.col("fp"))
    least = linked.groupBy("root").agg(F.min(F.when(F.col("first").isNotNull(), F.struct("first", "fp"))).alias("least"))
    moved = linked.join(least, "root").select("root", F.col("node").alias("fp"), F.col("least.first").alias("least"), (F.col("least.fp") == F.col("node")).alias("chosen"))
    ids = classes.join(moved, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"), F.coalesce("chosen", F.lit(True)).alias("chosen"), F.coalesce("root", "fp").alias("root"))
    # written apart from the aggregate, so that the join's large side isn't bound to its partitions and a hot fingerprint can be split
    return fps.join(small(written(ids, "ids")), "fp").select("doc_id", "fp", "component_id", (F.col("chosen") & (F.col("doc_id") == F.col("component_id"))).alias("kept"), "root")


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with one row of each component of near_copies(): that of the smallest (doc_id, fp).

    Rows that repeat a kept (doc_id, fp) are reduced to one; one doc_id may stay on texts of several components. Of a
    component whose rows all have a null doc_id one row stays; beside other rows, such rows go.
    """
    found = written(near_copies(docs), "components")
    ids = found.where(F.col("doc_id").isNotNull())
    again = written(ids.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    gone = ids.where("NOT kept").select("doc_id").union(again).distinct()
    kept = without(docs.where(F.col("doc_id").isNotNull()), gone)
    # where an id stands on several rows, or none does, rows are told apart by their fingerprints
    if not again.isEmpty():
        rows = docs.join(small(again), "doc_id", "left_semi").withColumn("__fp", _fingerprints("text"))
        chosen = ids.where("kept").join(again, "doc_id", "left_semi").select("doc_id", F.col("fp").alias("__fp")).distinct()
        kept = kept.unionByName(rows.join(chosen, ["doc_id", "__fp"], "left_semi").dropDuplicates(["doc_id", "__fp"]).select(kept.columns))
    nameless = found.where(F.col("doc_id").isNull() & F.col("component_id").isNull())
    if not nameless.isEmpty():
        rows = docs.where(F.col("doc_id").isNull()).withColumn("__fp", _fingerprints("text"))
        roots = nameless.select(F.col("fp").alias("__fp"), F.col("root").alias("__root")).distinct()
        kept = kept.unionByName(rows.join(roots, "__fp").dropDuplicates(["__root"]).select(kept.columns))
    return kept
