"""License scans: exact set-similarity join of license templates with text blocks.

Blocks are lines, and windows of words across line ends. The templates' tokens are ordered by their frequency over all texts,
rarest first. A block that holds `need` of a template's tokens shares one of the template's first size - need + 1 (prefix
filter), has `need` tokens itself (length filter), and after the first shared token both have enough left (positional
filter). What passes is verified. Only built-in functions are used. The texts are read twice: for the frequencies, and for
the base phrases and the blocks with a prefix token, which are written with a number of their row.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, written

THRESHOLD = 0.9
#: Up to so many strings are looked for in a text before it is cut into words.
MAX_LOOKS = 64
# Separators, base phrases, and sentences by which common licenses are stated.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = (
    ("mit-text", "released under the mit license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2"),
    ("gpl-text", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


_MARKS = "".join(c for c in map(chr, range(128)) if re.match(SEPARATORS, c) and c not in _UPPER and c != "\n")


def _low(text: Column) -> Column:
    """A-Z in lower case, every separator but line ends as a space; null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), _UPPER + _MARKS, _LOWER + " " * len(_MARKS))


def _flat(low: Column) -> Column:
    """The same without line ends, and with a space at both ends."""
    return F.concat(F.lit(" "), F.replace(low, F.lit("\n"), F.lit(" ")), F.lit(" "))


def _tokens(flat: Column) -> Column:
    return F.array_remove(F.split(flat, " "), "")


def _bound(value: Column, then) -> Column:
    """then(value), with value computed once for a row, however often lambdas in `then` look at it."""
    return F.transform(F.array(value), then)[0]


def _places(words: Column, phrase: str) -> Column:
    """Starts of the phrase in an array of words."""
    parts = phrase.split()
    here = lambda w, i: F.array(*(F.get(w, i + k) for k in range(len(parts)))) == F.array(*map(F.lit, parts))
    return _bound(words, lambda w: F.filter(F.sequence(F.lit(0), F.size(w)), lambda i: here(w, i)))


def _any(flat: Column, words: list[str]) -> Column:
    """Whether the text holds one of the words; true without looking where they are many."""
    return reduce(lambda c, x: c | F.contains(flat, F.lit(f" {x} ")), words, F.lit(False)) if len(words) <= MAX_LOOKS else F.lit(True)


@dataclass
class Template:
    label: str
    #: Words, distinct tokens that a block must have at least, and words of a window.
    words: list[str]
    need: int
    span: int
    #: The distinct tokens, rarest first.
    tokens: list[str]

    @property
    def prefix(self) -> list[str]:
        return self.tokens[: len(self.tokens) - self.need + 1]


def ordered(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> tuple[list[Template], list[str]]:
    """The templates, and their vocabulary by its frequency over docs (text), rarest first. One count for each token of the vocabulary reaches the driver."""
    cut = [(label, [x for x in re.split(SEPARATORS, text.lower()) if x]) for label, text in templates]
    vocabulary = sorted({x for _, own in cut for x in own})
    seen = docs.select(F.explode(F.split(_flat(_low(F.col("text"))), " ")).alias("token"))
    counts = {r.token: r["count"] for r in seen.where(F.col("token").isin(vocabulary)).groupBy("token").count().collect()}
    order = sorted(vocabulary, key=lambda x: (counts.get(x, 0), x))
    rank = {x: i for i, x in enumerate(order)}
    made = []
    for label, own in cut:
        tokens = sorted(set(own), key=rank.__getitem__)
        made.append(Template(label, own, math.ceil(threshold * len(tokens) - 1e-9), math.ceil(len(own) / threshold - 1e-9), tokens))
    return made, order


def blocks(docs: DataFrame, templates: list[Template], order: list[str], phrases: dict[str, str] = BASE) -> DataFrame:
    """A row for each of docs (doc_id, text), with a number of its own:

    row, doc_id, n_words, n_base, first_word, last_word, base (labels), lines (line, its tokens of the vocabulary: of lines
    with a prefix token and enough tokens), near (of each prefix token: token, near: the words around it, at: its place there).
    """
    first, least, reach = sorted({x for t in templates for x in t.prefix}), min(t.need for t in templates), max(t.span for t in templates)
    low, flat = F.col("__low"), F.col("__flat")
    own = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", _low(F.col("text")).alias("__low")).withColumn("__flat", _flat(low))
    ends, none = sorted({p.split()[-1] for p in phrases}), F.array().cast("array<int>")
    found = [F.when(_any(flat, ends), _places(_tokens(flat), p)).otherwise(none).alias(f"__{i}") for i, p in enumerate(phrases)]
    lines = F.transform(F.split(low, "\n"), lambda x, i: F.struct(i.alias("line"), F.array_distinct(F.filter(F.split(x, " "), lambda t: t.isin(order))).alias("tokens")))
    lines = F.filter(lines, lambda x: (F.size(x.tokens) >= least) & F.exists(x.tokens, lambda t: t.isin(first)))

    def around(w: Column) -> Column:
        begin = lambda i: F.greatest(i - F.lit(reach - 1), F.lit(0))
        places = F.filter(F.sequence(F.lit(0), F.size(w)), lambda i: F.get(w, i).isin(first))
        return F.transform(places, lambda i: F.struct(F.get(w, i).alias("token"), F.slice(w, begin(i) + 1, F.lit(2 * reach - 1)).alias("near"), (i - begin(i)).alias("at")))

    some = _any(flat, first)
    own = own.select("row", "doc_id", F.regexp_count("__flat", F.lit("[^ ]+")).cast("long").alias("n_words"), *found, F.when(some, lines).alias("lines"), F.when(some, _bound(_tokens(flat), around)).alias("near"))
    places = F.concat(*(F.col(f"__{i}") for i in range(len(phrases))))
    labels = F.array_compact(F.array(*(F.when(F.size(f"__{i}") > 0, F.lit(label)) for i, label in enumerate(phrases.values()))))
    return own.select(
        "row", "doc_id", "n_words", F.size(places).cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"), F.array_sort(F.array_distinct(labels)).alias("base"), "lines", "near",
    )


def line_matches(found: DataFrame, templates: list[Template], order: list[str]) -> DataFrame:
    """row, line, label, containment: every line of blocks() that holds a template's share of distinct tokens, with the label's best template."""
    spark, rank = found.sparkSession, {x: i for i, x in enumerate(order)}
    ranks = spark.createDataFrame(list(rank.items()), "token string, rank int")
    rows = [(t.label, own, len(own), t.need, i, own[i]) for t in templates for own in ([rank[x] for x in t.tokens],) for i in range(len(t.prefix))]
    prefixes = spark.createDataFrame(rows, "label string, ranks array<int>, size int, need int, i int, rank int")
    own = found.select("row", F.inline("lines")).select("row", "line", F.explode("tokens").alias("token")).join(small(ranks), "token")
    own = own.groupBy("row", "line").agg(F.array_sort(F.collect_list("rank")).alias("own"))  # the vocabulary at most
    pairs = own.select("row", "line", "own", F.posexplode("own").alias("j", "rank")).join(small(prefixes), "rank")
    pairs = pairs.where(F.size("own") >= F.col("need")).where(1 + F.least(F.col("size") - F.col("i") - 1, F.size("own") - F.col("j") - 1) >= F.col("need"))
    shared = F.size(F.array_intersect("ranks", "own"))
    return pairs.where(shared >= F.col("need")).groupBy("row", "line", "label").agg(F.max(shared / F.col("size")).alias("containment"))


def window_matches(found: DataFrame, templates: list[Template]) -> DataFrame:
    """row, label, containment: windows of words of blocks() that hold a template's share of distinct tokens.

    A window is as long as its template's words divided by the threshold. It holds one of the template's prefix tokens, so
    only windows around these are compared.
    """
    rows = [(t.label, t.tokens, len(t.tokens), t.need, t.span, x) for t in templates for x in t.prefix]
    prefixes = found.sparkSession.createDataFrame(rows, "label string, tokens array<string>, size int, need int, span int, token string")
    pairs = found.select("row", F.inline("near")).join(small(prefixes), "token").where(F.size(F.array_intersect("near", "tokens")) >= F.col("need"))
    starts = F.sequence(F.greatest(F.col("at") - F.col("span") + 1, F.lit(0)), F.col("at"))
    best = F.array_max(F.transform(starts, lambda i: F.size(F.array_intersect(F.slice("near", i + 1, F.col("span")), F.col("tokens")))))
    return pairs.select("row", "label", "size", "need", best.alias("best")).where("best >= need").groupBy("row", "label").agg(F.max(F.col("best") / F.col("size")).alias("containment"))


def scanned(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each of docs (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score: 1 with a base place, else the best containment of a template, else 0. A null text counts as empty. Every row is
    scanned for itself, also where its doc_id is null or repeated; other columns are left out. An empty table gives no rows.
    """
    own, order = ordered(docs, templates, threshold)
    found = written(blocks(docs, own, order), "blocks")
    both = line_matches(found, own, order).select("row", "label", "containment").union(window_matches(found, own))
    matches = written(both.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best")), "licenses")
    both = found.drop("lines", "near").join(small(matches), "row", "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return both.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))


def oracle(templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL of scanned() by comparing every line with every template; templates that are wrapped over lines are beyond it."""
    values = ", ".join(f"('{label}', '{text}')" for label, text in templates)
    places = {p: " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p.split(), 1)) for p in BASE}
    lists = ", ".join(f"list_filter(range(0, len(w)), lambda i: {cond}) AS p{k}" for k, cond in enumerate(places.values()))
    every = " || ".join(f"p{k}" for k in range(len(BASE)))
    named = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, label in enumerate(BASE.values()))
    low = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
    return rf"""
        WITH templates AS (SELECT label, list_distinct(string_split(text, ' ')) AS t FROM (VALUES {values}) AS v(label, text)),
        lines AS (SELECT doc_id, unnest(string_split({low}, chr(10))) AS line FROM documents),
        blocks AS (SELECT doc_id, regexp_split_to_array(line, '{SEPARATORS}') AS b FROM lines),
        shares AS (
            SELECT doc_id, label, len(list_intersect(t, b)) AS shared, len(t) AS size FROM blocks, templates WHERE len(list_intersect(t, b)) >= {threshold} * len(t) - 1e-9),
        found AS (SELECT doc_id, list(DISTINCT label) AS more, max(shared / size) AS best FROM shares GROUP BY doc_id),
        worded AS (SELECT doc_id, list_filter(regexp_split_to_array({low}, '{SEPARATORS}'), lambda x: x <> '') AS w FROM documents),
        placed AS (SELECT doc_id, len(w) AS n_words, {lists} FROM worded),
        based AS (
            SELECT doc_id, n_words, {every} AS p, list_sort(list_distinct(list_filter([{named}], lambda x: x IS NOT NULL))) AS base FROM placed)
        SELECT doc_id, n_words, len(p) AS n_base, list_min(p) AS first_word, list_max(p) AS last_word, array_to_string(base, ',') AS base_labels,
            array_to_string(list_sort(list_distinct(base || coalesce(more, []))), ',') AS labels, CASE WHEN len(p) > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::double AS score
        FROM based LEFT JOIN found USING (doc_id)"""
