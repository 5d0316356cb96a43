"""Substring deduplication against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tablewright.llm import grams, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    """(n_words, n_removed, kept) by row; rows: (doc_id, text)."""
    key = lambda r: (r[0] is None, r[0] or 0)
    first, out = {}, {}
    for doc, text in sorted(set(rows), key=key):
        w = WORD.findall(text or "")
        gone = set()
        for i in range(len(w) - 19):
            if first.setdefault(tuple(w[i : i + 20]), (doc, text, i)) != (doc, text, i):
                gone |= set(range(i, i + 20))
        out[doc, text] = len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)
    return [out[r] for r in rows]


def result(spark, rows):
    df = substrings.without_repeats(spark.createDataFrame([(*r, "own", "own") for r in rows], "doc_id long, text string, kept string, __id string"))
    assert df.columns == ["doc_id", "text", "__id", "kept", "n_words", "n_removed"]
    return sorted(((r.doc_id, r.text, r.n_words, r.n_removed, r.kept) for r in df.collect()), key=repr)


def check(spark, rows):
    assert result(spark, rows) == sorted(((*r, *x) for r, x in zip(rows, brute(rows), strict=True)), key=repr)


@pytest.mark.parametrize("held", [1 << 20, 7])
def test_brute_force(spark, monkeypatch, held):
    monkeypatch.setattr(substrings, "HELD", held)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(5000)]
    passages = [" ".join(rng.choices(words, k=n)) for n in (19, 20, 21, 55, 300)]
    rows = []
    for i in rng.sample(range(1000), 60):
        parts = [" ".join(rng.choices(words, k=rng.randint(0, 40)))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages), " ".join(rng.choices(words, k=rng.randint(0, 30)))]
        rows.append((i, " \n".join(parts)))
    rows += [(2000 + i, rows[i % 3][1]) for i in range(12)]  # whole copies
    rows += [(3000, "a " * 100), (3001, "a b " * 60), (-5, "x a b " * 9)]  # windows that repeat themselves
    check(spark, rows)


def test_odd_rows(spark):
    long, other = " ".join(f"x{i}" for i in range(30)), " ".join(f"x{i}" for i in range(5, 40))
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (4, long), (4, long), (5, long.replace(" ", "\n\t")), (None, long), (None, long), (6, "Ä\x85b\x1cc\xa0d " * 25), (7, other), (8, "short copy"), (9, "short copy"), (10, long.upper())]
    check(spark, rows)
    assert substrings.without_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_one_id_on_two_texts(spark):
    shared = " ".join(f"s{i}" for i in range(25))
    rows = [(1, shared + " end"), (1, "begin " + shared), (None, "x " + shared)]
    found = result(spark, rows)
    assert sorted(r[3] for r in found) == [0, 25, 25] and next(r[3] for r in found if r[0] is None) == 25


def test_very_long_text(spark):
    own = " ".join(f"n{i}" for i in range(150_000))
    found = result(spark, [(1, own), (2, "a " + own[: len(own) // 2]), (3, "w" * 3_000_000)])
    assert [r[3] for r in found] == [0, len(own[: len(own) // 2].split()) - (0 if own[len(own) // 2] == " " else 1), 0]


def test_hashes_and_windows():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 64, 200, np.uint64)
    for k in (1, 2, 6, 15, 20):
        plain = [0] * (200 - k + 1)
        for j in range(k):
            plain = [(p * 0x9E3779B97F4A7C15 + int(v)) % (1 << 64) for p, v in zip(plain, x[j:], strict=False)]
        assert grams.sequences(x, k).tolist() == plain
        assert grams.sliding(np.minimum, x, k).tolist() == [min(x[i : i + k]) for i in range(200 - k + 1)]
    assert len(grams.sequences(x[:3], 4)) == 0


def test_places_count_every_equal_window():
    """No window has more doubles than its least hash has places."""
    texts = ["a b c d " * 20, "a " * 40, " ".join(f"q{i % 23}" for i in range(90)), "short", ""]
    hashes, bounds = grams.word_hashes(pa.array(texts))
    least, inside, places = substrings.least_hashes(hashes[:, 0], bounds)
    windows = grams.sequences(hashes[:, 0], 20)[inside]
    known, n = np.unique(windows, return_counts=True)
    count = dict(zip(*np.unique(places, return_counts=True), strict=True))
    for w, m in zip(windows.tolist(), least[inside].tolist(), strict=True):
        assert count[m] >= n[np.searchsorted(known, np.uint64(w))]
    assert inside.sum() == sum(max(0, len(t.split()) - 19) for t in texts)


def test_sketch_overestimates_and_filters(spark):
    rng = random.Random(5)
    shared = " ".join(f"s{i}" for i in range(60))
    texts = [" ".join(f"u{rng.randrange(10**9)}" for _ in range(300)) + (" " + shared if i % 5 == 0 else "") for i in range(30)]
    bits = 16
    bitmap = substrings.repeated_counters(spark.createDataFrame([(t,) for t in texts], "text string").repartition(4), bits)
    hashes, bounds = grams.word_hashes(pa.array(texts))
    least, inside, _ = substrings.least_hashes(hashes[:, 0], bounds)
    found = inside.copy()
    for row in range(substrings.ROWS):
        counter = substrings._counters(least, row, bits)
        found &= bitmap[row][counter >> 3] >> (counter & 7).astype(np.uint8) & 1 > 0
    windows = grams.sequences(hashes[:, 0], 20)
    known, n = np.unique(windows[inside], return_counts=True)
    repeated = inside & np.isin(windows, known[n > 1])
    assert not (repeated & ~found).any() and repeated.sum() == 6 * 41
    assert found.sum() < 0.2 * inside.sum()  # most of the others stay out


def test_query_digest(spark):
    from tablewright.llm import queries

    rows = {r.doc_id: r for r in queries.op12_substrings(spark, "/root/testdata/sf0.001").collect()}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for (doc, _), (n, gone, kept) in zip(docs, brute(docs), strict=True):
        assert (rows[doc].n_words, rows[doc].n_removed, rows[doc].kept_sha256) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())
