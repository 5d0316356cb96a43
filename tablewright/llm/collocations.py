"""Phrases of two and three words that stand together more often than their parts suggest, from a weighted de Bruijn graph.

Nodes are pairs of words, edges are runs of three: an edge leads from the pair of its first two words to that of its last
two. Only edges are counted in the texts; END stands for a word beyond a piece's end. All shorter counts come from the flow:
a pair stands as often as the edges that leave it, those to END included, and a word as often as the pairs that it begins.

Words that are seen less than `least` times can't be part of a phrase; they are drawn together to RARE before the shuffle,
as they are needed in the flow of other words only. That takes a vocabulary of frequent words of at most MAX_FREQUENT
entries (8 bytes each, broadcast); beyond, no word is drawn together, which changes the rows shuffled but no result.

Edges of `least` and more make up the graph of phrases, in which unary paths are compacted: where a pair has one edge in
and one out, both of its whole flow, they become one path, and all runs of three words in a path take its weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, for_python, release, written
from .encoding import chunked

#: Stand-ins of a word beyond a piece's end and of all infrequent words; words' hashes, of 63 bits, are larger.
END, RARE = 0, 1
MAX_FREQUENT = 4 << 20
#: Runs of three words that a task holds before it counts them and hands them on.
HELD = 1 << 20
_STOP = "."


def _tokens(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, A-Z lower-cased, the number of each word of the texts, and where each text's begin; a STOP ends each piece."""
    lower = pc.ascii_lower(pc.fill_null(texts, ""))
    return chunked(pc.binary_join_element_wise(pc.replace_substring_regex(lower, r"[.,;:!?\x0A-\x0D]", f" {_STOP} "), _STOP, " "))


def _worded(batch: pa.RecordBatch):
    """Distinct words; the distinct (language, word) of the batch as numbers, what each token is of them, and which tokens are STOP."""
    words, codes, bounds = _tokens(batch.column("text"))
    langs = pc.fill_null(batch.column("lang"), "und").dictionary_encode()
    names = langs.dictionary.to_pylist()
    lang = np.repeat(langs.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(bounds))
    pairs, at = np.unique(lang * max(1, len(words)) + codes, return_inverse=True)
    lang, word = np.divmod(pairs, max(1, len(words)))
    own = [(names[i], words[j]) for i, j in zip(lang.tolist(), word.tolist(), strict=True)]
    return own, at, np.fromiter((w == _STOP for _, w in own), bool, len(own))


def _hash(lang: str, word: str) -> int:
    return xxhash.xxh64_intdigest(f"{len(lang)} {lang} {word}".encode("utf-8", "replace")) >> 1


def _hashes(own: list[tuple[str, str]]) -> np.ndarray:
    return np.maximum(np.fromiter((_hash(*x) for x in own), np.uint64, len(own)), RARE + 1).view(np.int64)


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own, at, stop = _worded(batch)
        n = np.bincount(at, minlength=len(own))
        rows = np.flatnonzero(~stop)
        own = [own[i] for i in rows.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in own], pa.string()), pa.array([x for _, x in own], pa.string()), pa.array(_hashes(own)), pa.array(n[rows])], ["lang", "word", "id", "n"])
        release()


EDGES = "w1 long, w2 long, w3 long, n long"


def _counted(held: list[np.ndarray]) -> pa.RecordBatch:
    w = np.concatenate(held, axis=1)
    key = w.view(np.uint64)
    w = w[:, np.argsort((key[0] * np.uint64(0x9E3779B97F4A7C15) + key[1]) * np.uint64(0xC4CEB9FE1A85EC53) + key[2])]
    # equal runs stand together; what shares a sort key by chance may come in several rows, which are added up later
    new = np.flatnonzero(np.append(True, (w[:, 1:] != w[:, :-1]).any(0)))
    return pa.RecordBatch.from_arrays([*(pa.array(x) for x in w[:, new]), pa.array(np.diff(np.append(new, w.shape[1])))], ["w1", "w2", "w3", "n"])


def _edges(frequent):
    """frequent: a broadcast of the sorted ids of frequent words, or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            own, at, stop = _worded(batch)
            ids = _hashes(own)
            if frequent is not None and len(ids):
                known = frequent.value
                ids = np.where(known[np.minimum(np.searchsorted(known, ids), len(known) - 1)] == ids, ids, RARE) if len(known) else np.full(len(ids), RARE)
            ids = np.append(np.where(stop, END, ids)[at], [END, END]).astype(np.int64)
            w = np.stack([ids[:-2], ids[1:-1], ids[2:]])
            w[2][w[1] <= RARE] = END  # beyond an end is an end; what follows RARE isn't needed
            w = w[:, w[0] > RARE]
            held.append(w)
            n += w.shape[1]
            if n >= HELD:
                yield _counted(held)
                held, n = [], 0
            release()
        if n:
            yield _counted(held)

    return run


def vocabulary(docs: DataFrame) -> DataFrame:
    """lang, word, id, n: how often each word stands in the texts of each language."""
    found = for_python(docs.select("lang", "text")).mapInArrow(_vocabulary, "lang string, word string, id long, n long")
    return found.groupBy("lang", "word", "id").agg(F.sum("n").alias("n"))


def graph(docs: DataFrame, words: DataFrame, least: int) -> DataFrame:
    """w1, w2, w3, n of docs (text, lang) and their vocabulary: edges and pairs (w3 null) of a weight of `least` at least; with w2 null, the flow of all other pairs that w1 begins."""
    often = words.where(F.col("n") >= least).select("id")
    frequent = None
    if often.count() <= MAX_FREQUENT:
        frequent = docs.sparkSession.sparkContext.broadcast(np.sort(np.array(often.toArrow().column(0), np.int64)))
    # dealt once, by pair: edges and flows are added up where they are
    edges = for_python(docs.select("lang", "text")).mapInArrow(_edges(frequent), EDGES).repartition("w1", "w2").groupBy("w1", "w2", "w3").agg(F.sum("n").alias("n"))
    pairs = edges.groupBy("w1", "w2").agg(F.sum("n").alias("n"))
    rest = pairs.groupBy("w1", F.when((F.col("n") >= least) & (F.col("w2") > RARE), F.col("w2")).alias("w2")).agg(F.sum("n").alias("n"))
    # a condition on w3 would be pushed below the exchange, which then couldn't serve both
    found = written(edges.where(F.col("n") >= least).unionByName(rest, allowMissingColumns=True), "graph")
    if frequent is not None:
        frequent.unpersist()
    return found.where(F.col("w3").isNull() | (F.col("w3") > RARE))


def compacted(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """path (ids of words, in order), n: the unary paths of edges (w1, w2, w3, n), every edge in one path. pairs: w1, w2, n.

    Edges meet in a pair that has one edge in and one edge out, both of the pair's whole flow. Each edge looks for the first
    edge of its path, twice as far in each round. The edges of a ring, which has no first one, stay as they are.
    """
    edges = written(edges.withColumn("id", F.monotonically_increasing_id()), "edges")
    into = edges.groupBy(F.col("w2").alias("w1"), F.col("w3").alias("w2")).agg(F.max("n").alias("in"), F.max("id").alias("before"), F.count("*").alias("n_in")).where("n_in = 1")
    out = edges.groupBy("w1", "w2").agg(F.count("*").alias("n_out")).where("n_out = 1")
    unary = into.join(out, ["w1", "w2"]).join(pairs.withColumnRenamed("n", "flow"), ["w1", "w2"]).where("`in` = flow").select("w1", "w2", "flow", "before")
    state = edges.join(unary, ["w1", "w2"], "left").withColumn("inner", F.coalesce(F.col("n") == F.col("flow"), F.lit(False)))
    state = checkpointed(state.select("id", F.when(F.col("inner"), F.col("before")).otherwise(F.col("id")).alias("first"), F.col("inner").cast("int").alias("steps"), "inner"))
    left = None
    # a round that finds no first edge leaves only rings
    while (now := state.where("inner").count()) and now != left:
        left = now
        known = state.select(F.col("id").alias("first"), F.col("first").alias("next"), F.col("steps").alias("more"), F.col("inner").alias("still"))
        moved = state.where("inner").join(known, "first").select("id", F.col("next").alias("first"), (F.col("steps") + F.col("more")).alias("steps"), F.col("still").alias("inner"))
        state = checkpointed(moved.union(state.where("NOT inner")))
    placed = state.select("id", F.when(F.col("inner"), F.col("id")).otherwise(F.col("first")).alias("first"), F.when(F.col("inner"), 0).otherwise(F.col("steps")).alias("steps")).join(edges, "id")
    paths = placed.groupBy("first").agg(F.array_sort(F.collect_list(F.struct("steps", "w1", "w2", "w3"))).alias("own"), F.max("n").alias("n"))
    return paths.select(F.concat(F.array(F.col("own")[0]["w1"], F.col("own")[0]["w2"]), F.transform("own", lambda x: x["w3"])).alias("path"), "n")


def phrases(docs: DataFrame, least: int = 10, share: int = 50) -> DataFrame:
    """lang, phrase, a, l, r, n, score, path_words: every phrase of docs (text, lang) that stands `least` times or more and isn't dropped for a longer one.

    Texts are lower-cased (A-Z) and split at . , ; : ! ? and line ends into pieces, and those at blanks and tabs into words. All
    counts are by language (null: und): n words, a of the phrase, l and r of the parts of its cut of the lowest score, 1000000 a^2
    of l r rounded down, the first cut of ties. A pair goes if `share` in a hundred of its places are within one longer phrase.
    path_words: words of the compacted path that a run of three words is part of, null for a pair. Null and empty texts hold no
    words; repeated rows count as often as they stand; counts go up to 9e15; other columns of docs have no effect. An empty table gives an empty one.
    """
    words = written(vocabulary(docs), "words")
    whole = graph(docs, words, least)
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    pairs, edges = whole.where("w2 IS NOT NULL AND w3 IS NULL").select("w1", "w2", "n"), whole.where("w3 IS NOT NULL")
    flows = whole.where("w3 IS NULL").groupBy(F.col("w1").alias("id")).agg(F.sum("n").alias("f"))
    known = written(words.where(F.col("n") >= least).select("id", "lang", "word").join(flows, "id"), "known")
    path, at = F.col("path"), F.sequence(F.lit(1), F.size("path") - 2)
    runs = compacted(edges, pairs).select("n", F.size("path").cast("long").alias("path_words"), F.explode(F.transform(at, lambda i: F.slice(path, i, 3))).alias("run"))
    runs = runs.select(*(F.col("run")[i].alias(f"w{i + 1}") for i in range(3)), F.col("n").alias("a"), "path_words")

    def of(i: int) -> DataFrame:
        return known.select(F.col("id").alias(f"w{i}"), F.col("f").alias(f"f{i}"), F.col("word").alias(f"word{i}"), *([F.col("lang")] if i == 1 else []))

    def scored(df: DataFrame, words: int, *cuts: tuple[str, str]) -> DataFrame:
        """cuts: names of l and r, in the order of the words."""
        score = "CAST((1000000BD * CAST(a AS DECIMAL(16,0)) * CAST(a AS DECIMAL(16,0))) div (CAST({} AS DECIMAL(16,0)) * CAST({} AS DECIMAL(16,0))) AS BIGINT)"
        made = [F.struct(F.expr(score.format(x, y)).alias("score"), F.lit(k).alias("k"), F.col(x).alias("l"), F.col(y).alias("r")) for k, (x, y) in enumerate(cuts)]
        cut = F.array_min(F.array(*made))
        return df.withColumn("cut", cut).select("lang", F.concat_ws(" ", *(f"word{i + 1}" for i in range(words))).alias("phrase"), "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"), "path_words")

    longer = edges.select("w1", "w2", "n").union(edges.select("w2", "w3", "n")).groupBy("w1", "w2").agg(F.max("n").alias("most"))
    left, right = pairs.toDF("w1", "w2", "f12"), pairs.toDF("w2", "w3", "f23")
    two = pairs.withColumnRenamed("n", "a").join(longer, ["w1", "w2"], "left").where(F.coalesce(100 * F.col("most") < share * F.col("a"), F.lit(True)))
    two = scored(two.join(of(1), "w1").join(of(2), "w2").withColumn("path_words", F.lit(None).cast("long")), 2, ("f1", "f2"))
    three = runs.join(left, ["w1", "w2"]).join(right, ["w2", "w3"]).join(of(1), "w1").join(of(2), "w2").join(of(3), "w3")
    found = two.union(scored(three, 3, ("f1", "f23"), ("f12", "f3")))
    return found.join(totals, "lang").select("lang", "phrase", "a", "l", "r", F.col("total").alias("n"), "score", "path_words")


def best(found: DataFrame, limit: int = 2000) -> DataFrame:
    """The first `limit` phrases() of each language, by score, count and the phrase itself, with their rank."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= limit).select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "path_words")
