"""Phrases against brute force."""

import random
import re
from collections import Counter, defaultdict

import pytest

from tablewright.llm import collocations


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(rows, least=10, share=50, limit=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, own in f.items():
        found, long = [], defaultdict(int)
        for p, a in own.items():
            if len(p) == 3 and a >= least:
                for q in (p[:2], p[1:]):
                    long[q] = max(long[q], a)
        for p, a in own.items():
            if len(p) > 1 and a >= least and not (len(p) == 2 and long[p] and 100 * long[p] >= share * a):
                score, _, l, r = min((1000000 * a * a // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:limit], 1)]
    return sorted(out)


def result(spark, rows, limit=2000):
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, text string, n long, w1 long")
    return sorted(tuple(r)[:8] for r in collocations.best(collocations.phrases(docs), limit).collect())


def made(seed, n=600):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["Éa", "éa", "東", "x\x00y", "z\xa0z", "x\x85y"]
    fixed = ["new york city", "a b c d e f g h", "a b c", "r r r r r r", "In Of"]
    rows = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(1, 12)):
            parts += [rng.choice(fixed)] if rng.random() < 0.4 else [" ".join(rng.choices(words, k=rng.randint(0, 6)))]
            parts.append(rng.choice([" ", ", ", ".", "\n", "\t", ";x:", "!? "]))
        rows.append((rng.choice(["en", "de", None, "und"]), "".join(parts)))
    return rows


@pytest.mark.parametrize("held", [1 << 20, 5])
@pytest.mark.parametrize("frequent", [1 << 20, 3])
def test_brute_force(spark, monkeypatch, held, frequent):
    monkeypatch.setattr(collocations, "HELD", held)
    monkeypatch.setattr(collocations, "MAX_FREQUENT", frequent)
    rows = made(held + frequent)
    assert result(spark, rows) == brute(rows)
    assert len(brute(rows)) > 40


def test_odd_rows(spark):
    rows = [(None, None), ("en", ""), ("en", " .,;"), ("de", "same pair " * 9), ("fr", "same pair. " * 10), ("fr", "A  B\tC"), (None, "one two, " * 10), ("und", "one two"), ("en", "long word " * 50_000), ("en", "y" * 3_000_000)]
    found = result(spark, rows)
    assert found == brute(rows)
    assert ("und", 1, "one two", 11, 11, 11, 22, 1000000) in found
    assert collocations.phrases(spark.createDataFrame([], "lang string, text string")).collect() == []


def test_limit_and_ties(spark):
    rows = [("en", f"p{i} q{i}. " * 10) for i in range(30)]
    found = result(spark, rows, 7)
    assert found == brute(rows, limit=7) and [r[2] for r in found] == sorted(f"p{i} q{i}" for i in range(30))[:7]


def paths(spark, edges, pairs):
    found = collocations.compacted(spark.createDataFrame(edges, "w1 long, w2 long, w3 long, n long"), spark.createDataFrame(pairs, "w1 long, w2 long, n long"))
    return sorted((tuple(r.path), r.n) for r in found.collect())


def test_compacted(spark):
    chain = [(i, i + 1, i + 2, 20) for i in range(2, 40)]
    pairs = [(i, i + 1, 20) for i in range(2, 41)]
    assert paths(spark, chain, pairs) == [(tuple(range(2, 42)), 20)]
    # a pair with a larger flow than its one edge out, and a second edge into a pair, end a path
    broken = [(a, b, 25 if a == 10 else n) for a, b, n in pairs]
    assert paths(spark, chain, broken) == [(tuple(range(2, 12)), 20), (tuple(range(10, 42)), 20)]
    forked = [*chain, (99, 20, 21, 30)]
    assert (tuple(range(2, 22)), 20) in paths(spark, forked, [*pairs, (99, 20, 30)])
    # a ring has no first edge and stays as it is
    ring = [(2, 3, 4, 10), (3, 4, 2, 10), (4, 2, 3, 10)]
    assert paths(spark, [*ring, *[(a + 50, b + 50, c + 50, 20) for a, b, c, _ in chain]], [(2, 3, 10), (3, 4, 10), (4, 2, 10), *[(a + 50, b + 50, n) for a, b, n in pairs]]) == [((2, 3, 4), 10), ((3, 4, 2), 10), ((4, 2, 3), 10), (tuple(range(52, 92)), 20)]


def test_flow_gives_shorter_counts(spark):
    rows = [("en", "a b c. a b. a. b c"), ("en", "a b c d. c a b")]
    docs = spark.createDataFrame(rows, "lang string, text string")
    words = collocations.vocabulary(docs).cache()
    flows = {r.w1: r.f for r in collocations.graph(docs, words, 1).where("w3 IS NULL").groupBy("w1").sum("n").withColumnRenamed("sum(n)", "f").collect()}
    assert {r.word: flows[r.id] for r in words.collect()} == {"a": 5, "b": 5, "c": 4, "d": 1} == {r.word: r.n for r in words.collect()}
