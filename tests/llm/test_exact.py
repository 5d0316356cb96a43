"""Operators with exact results, against brute force."""

import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tablewright.llm import components, decontamination, encoding, licenses, minhash, packing, simhash, token_counts, urls

WORDS = [f"w{i}" for i in range(400)]


def texts(n, seed=1):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 60))) for _ in range(n)]


# --- near duplicates ---


def plain_fingerprint(text):
    words = []
    for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").replace("\t", " ").split(" "):
        words += [w] if w else []
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    for t in ["", None, "A b", "a  B\tc\nd e", *texts(40)]:
        assert simhash.fingerprint(t) & (1 << 64) - 1 == plain_fingerprint(t)


def brute_components(fps):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin((fps[i] ^ fps[j]) & (1 << 64) - 1).count("1") <= 2:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(fps))]


@pytest.mark.parametrize("most", [2, 64])
def test_links_in_small_and_large_postings(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "MAX_POSTING", most)
    rng = random.Random(most)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 3))) for b in base for _ in range(12)} | {0, 1, (1 << 64) - 1})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    found = components.components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")))
    got = {r.node: r.root for r in found.collect()}
    want = brute_components(signed)
    groups = lambda ids: sorted(sorted(g) for g in ids.values() if len(g) > 1)
    a, b = {}, {}
    for x, w in zip(signed, want, strict=True):
        a.setdefault(w, []).append(x)
    for x in signed:
        b.setdefault(got.get(x, x), []).append(x)
    assert groups(a) == groups(b)


def test_components_of_a_long_chain(spark):
    n = 300
    order = list(range(n))
    random.Random(3).shuffle(order)
    links = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(5, 5), (order[0], order[1])], "a long, b long")
    assert {(r.node, r.root) for r in components.components(links).collect()} == {(i, 0) for i in range(n)}
    assert components.components(links.limit(0)).count() == 0


def test_near_duplicates_of_odd_rows(spark, odd, none):
    got = simhash.near_duplicates(odd)
    assert got.columns == ["doc_id", "fp", "component_id"] and got.count() == odd.count()
    by = {(r.doc_id): r.component_id for r in got.collect()}
    assert by[1] == by[2] == by[3] == 1 and by[4] == by[5] == by[None] == 4
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.deduplicated(odd)
    assert kept.columns == odd.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x))
    assert ids == [1, 4, 6, 7, 8]
    nameless = spark.createDataFrame([(None, "a b c"), (None, "A b c"), (None, "x y z"), (5, "x y z"), (6, "p q")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text.lower()) for r in simhash.deduplicated(nameless).collect())
    assert got == [(0, "a b c"), (5, "x y z"), (6, "p q")]
    twice = simhash.deduplicated(odd.where("doc_id = 5"))
    assert twice.count() == 1 and simhash.deduplicated(none).columns == none.columns


# --- decontamination ---


def shingles(text):
    import regex

    w = regex.findall(r"[\p{L}\p{M}\p{N}]+", (text or "").lower())
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_containment(spark, odd, none):
    rng, items = random.Random(5), texts(30, 9)
    docs = []
    for i in range(120):
        t = texts(1, 100 + i)[0].split()
        w = rng.choice(items).split()
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = "other"
        docs.append((i, " ".join(t[:10] + w + t[10:]).upper()))
    docs += [(500, None), (501, ""), (502, "w1 w2"), (None, items[0]), (1, items[3])]
    items = [*items, "W1, w2!", None, "", "w1 w2"]
    a = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").withColumn("doc_id", F.lit(1))
    own = {}
    for d, t in docs:
        if d is not None:
            own.setdefault(d, set()).update(shingles(t))
    want = {(d, i) for d, s in own.items() for i, t in enumerate(items) if (q := shingles(t)) and len(q & s) >= 0.8 * len(q) - 1e-9}
    got = decontamination.contained(a, b).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want) and len(want) > 50
    assert all(abs(r.containment - len(shingles(items[r.item_id]) & own[r.doc_id]) / len(shingles(items[r.item_id]))) < 1e-12 for r in got)
    assert decontamination.contained(a.limit(0), b).count() == 0 and decontamination.contained(a, b.limit(0)).count() == 0
    clean = decontamination.decontaminated(odd, odd.where("doc_id = 4").select(F.lit(0).alias("item_id"), "text"))
    assert sorted((r.doc_id for r in clean.collect()), key=lambda x: (x is None, x)) == [1, 2, 3, 6, 7, 8] and clean.columns == odd.columns
    rows = spark.createDataFrame([(1, items[3]), (1, "w1 w2 w3"), (2, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in decontamination.decontaminated(rows, b).collect()) == [(1, "w1 w2 w3"), (2, None)]


def test_signatures_by_partitions_of_sizes(spark):
    sizes = (1, 8, 9, 16, 17, 33, 64, 65, 300)
    items = spark.createDataFrame([(n, " ".join(f"a{i}" for i in range(n + 4))) for n in sizes], "item_id long, text string")
    for threshold in (0.8, 0.3):
        made = {}
        for r in decontamination.signatures(items, threshold).collect():
            made.setdefault(r.item_id, []).append((r.hash, r.upper, r.least))
        for n, rows in made.items():
            upper = max(8, 1 << (n - 1).bit_length())
            lacking, least = int((1 - threshold) * upper + 1e-9), rows[0][2]
            assert {r[1:] for r in rows} == {(upper, least)} and len(rows) == min(n, lacking + least)
            # whatever a true pair lacks, so many matches are left
            most = n - -int(-(threshold * n) // 1)
            assert len(rows) - most >= least >= 1 and (upper < 32 or threshold < 0.8 or least > 1)


# --- licenses ---


def test_licenses(spark, odd, none):
    rows = [(1, "Released under the MIT License.\nx"), (2, "a MIT-license, mit license MIT\nLicense"), (3, "This work is licensed under the GNU General Public License, version 3."), (4, "Licensed under CC BY-NC 4.0."), (5, "apache licensed"), (6, None), (7, "")]
    rows += [(i, t) for i, t in enumerate(texts(60, 4), 10)] + [(None, "MIT license")]
    documents = spark.createDataFrame(rows, "doc_id long, text string").withColumn("label", F.lit("clash"))
    got = {r.doc_id: r for r in licenses.scanned(documents).collect()}
    assert len(got) == len(rows)
    assert (got[2].n_base, got[2].first_word, got[2].last_word, got[2].n_words) == (3, 1, 5, 7)
    assert got[1].labels == "mit,mit-text" and got[3].base_labels == "gpl" and got[3].labels == "gpl,gpl-3.0" and got[4].labels == "cc-by-nc-4.0" and got[4].base_labels == ""
    assert got[5].labels == "" and got[6].n_words == 0 and got[None].base_labels == "mit"
    con = duckdb.connect()
    frame = documents.where("doc_id IS NOT NULL").toPandas()  # noqa: F841
    con.execute("CREATE VIEW documents AS SELECT * FROM frame")
    for r in con.execute(licenses.oracle()).fetchall():
        assert tuple(got[r[0]])[:7] == tuple(r)[:7], r
    assert licenses.scanned(none).count() == 0 and licenses.scanned(odd).count() == odd.count()


# --- encoding, packing, counts ---


def test_ids_equal_the_tokenizers():
    e = encoding.Encoder(encoding.default_tokenizer())
    own = ["It's don't we'll x's''s !'s", "ß́ á", "", None, " ", "東京 1234 ½", "a\xa0b\x85c\u2003d\x1ce", "<|endoftext|> <|ENDOFTEXT|>", "ÀÉ I'S ŒUVRE İ", "x" * 3000, "Σας ΣΑΣ", *texts(20)]
    ids, starts = e.batch(pa.array(own, pa.string()))
    for i, t in enumerate(own):
        assert e.tokenizer.encode(t or "", add_special_tokens=False).ids == ids[starts[i] : starts[i + 1]].tolist(), t
    assert len(e.batch(pa.array([], pa.string()))[0]) == 0


def test_packing_is_a_round_trip(spark, odd, none):
    e = encoding.Encoder(encoding.default_tokenizer())
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts(300, 7))] + [(900, None), (901, ""), (902, "word " * 9000)], "doc_id long, text string").withColumn("offset", F.lit("clash")).repartition(5)
    rows = packing.packed(docs, length=256).collect()
    want = {r.doc_id: [*e.whole(r.text or ""), 1] for r in docs.collect()}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == want.keys()
    for d, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(want[d]) and p.ids_crc32 == zlib.crc32(np.array(want[d][at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(want[d])
    for s, pieces in by_sequence.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 256 or s == max(by_sequence)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    assert packing.packed(none).count() == 0 and packing.packed(odd).agg(F.count_distinct("doc_id")).first()[0] == 8


def test_length_table(spark, odd, none, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK", 8)
    e = encoding.Encoder(encoding.default_tokenizer())
    own = [*texts(80, 2), None, "", "word " * 5000]
    n = [len(e.whole(t or "")) for t in own]
    rows = {r.length: r for r in token_counts.length_table(spark.createDataFrame([(t,) for t in own], "text string")).collect()}
    assert {k: r.n_docs for k, r in rows.items()} == dict(Counter(n))
    for k, r in rows.items():
        assert (r.docs_over, r.tokens_over, r.tokens_kept) == (sum(x > k for x in n), sum(x for x in n if x > k), sum(min(x, k) for x in n))
        assert r.tokens_lost == sum(n) - r.tokens_kept and abs(r.share_within - sum(x <= k for x in n) / len(n)) < 1e-12
    assert token_counts.length_table(none).count() == 0 and token_counts.length_table(odd).agg(F.sum("n_docs")).first()[0] == odd.count()


# --- urls ---


def test_rules_and_parts(spark):
    rows = [(1, "HTTP://WWW.Example.COM/en/1?x#y"), (2, "https://a.example.com/en/2"), (3, "https://b.net/fr/3"), (4, "https://b.net/FR/3"), (5, "https://example.org"), (6, None), (7, "no scheme/x"), (8, "https://com"), (9, "http://x.y/a://b.net/es/"), (10, "https://notnet/es/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("purity", F.lit("clash"))
    got = {r.page_id: r for r in urls.judged(pages, pages.select("page_id", F.lit(None).cast("boolean").alias("bad"))).collect()}
    assert {k: (r.host, r.path, r.rule, r.verdict) for k, r in got.items()} == {
        1: ("www.example.com", "/en/1", "www.example.com/en/", "allow"), 2: ("a.example.com", "/en/2", "example.com/en/", "block"), 3: ("b.net", "/fr/3", "net/fr/", "block"), 4: ("b.net", "/FR/3", None, "allow"), 5: ("example.org", "", None, "allow"),
        6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("com", "", None, "allow"), 9: ("x.y", "/a://b.net/es/", None, "allow"), 10: ("notnet", "/es/", None, "allow"),
    }
    assert urls.judged(pages.limit(0), pages.select("page_id", F.lit(True).alias("bad")).limit(0)).count() == 0


def brute_templates(pages, bad):
    """shape -> (template, purity) in plain Python, and page -> shape."""
    import re
    from math import sqrt

    def alike(g, k, ag, ak):
        rk = ak - k
        return k == 0 or rk == 0 or ag in (0, ak) or abs(g / k - (ag - g) / rk) / sqrt(ag / ak * (1 - ag / ak) * (1 / k + 1 / rk)) < urls.SIMILAR

    shapes, own = {}, {}
    for page, host, path in pages:
        own[page] = (host, *("*" if re.search("[0-9]", x) else x for x in path.split("/") if x))
        c = shapes.setdefault(own[page], [0, 0, 0])
        c[0] += 1
        if page in bad:
            c[1] += not bad[page]
            c[2] += 1
    tree, most = {k: list(k) for k in shapes}, max(map(len, shapes))
    for i in range(1, most):
        kinds = {}
        for k, t in tree.items():
            if len(t) > i:
                c = kinds.setdefault(tuple(t[:i]), {}).setdefault(t[i], [0, 0, 0])
                for j in range(3):
                    c[j] += shapes[k][j]
        for t in tree.values():
            c = kinds.get(tuple(t[:i]), {})
            total = sum(x[0] for x in c.values())
            rare = {x for x, v in c.items() if v[0] * urls.MAX_CHILDREN < total}
            if len(t) > i and len(c) > urls.MAX_CHILDREN and t[i] in rare and alike(*c[t[i]][1:], sum(c[x][1] for x in rare), sum(c[x][2] for x in rare)):
                t[i] = "*"
    for i in range(most - 1, 0, -1):
        nodes = {}
        for k, t in tree.items():
            n = nodes.setdefault(tuple(t), [0, 0])
            n[0] += shapes[k][1]
            n[1] += shapes[k][2]
        around = {}
        for t, n in nodes.items():
            if len(t) > i:
                a = around.setdefault((t[:i], t[i + 1 :]), [0, 0, 0])
                for j, x in enumerate((*n, 1)):
                    a[j] += x
        for t in tree.values():
            key = tuple(t)
            if len(key) > i and around[key[:i], key[i + 1 :]][2] > 1 and alike(*nodes[key], *around[key[:i], key[i + 1 :]][:2]):
                t[i] = "*"
    nodes = {}
    for k, t in tree.items():
        n = nodes.setdefault(tuple(t), [0, 0])
        n[0] += shapes[k][1]
        n[1] += shapes[k][2]
    good, seen = sum(n[0] for n in nodes.values()), sum(n[1] for n in nodes.values())
    return {k: ("/".join(t), (nodes[tuple(t)][0] + urls.STRENGTH * good / seen) / (nodes[tuple(t)][1] + urls.STRENGTH)) for k, t in tree.items()}, own


def test_templates(spark):
    rng = random.Random(8)
    pages = []
    for i in range(1500):
        host = rng.choice(["hot.org"] * 5 + [f"h{rng.randint(0, 9)}.org"])
        first = rng.choice(["news", "shop", "u" + "".join(rng.choice("abcdefgh") for _ in range(5)), "tag"])
        rest = rng.choice(["", f"/{rng.randint(1, 99)}", "/a/b/c/d/e", "/list/x", "/a/b/c/d/spam/x/" + rng.choice("yz")])
        pages.append((i, host, f"/{first}{rest}"))
    # of many small directories of a host, a few are bad ones
    pages += [(2000 + i, "big.org", f"/{chr(97 + i % 26)}{'good' if i % 26 else 'bad'}/{chr(97 + i // 26 % 3)}") for i in range(1300)]
    bad = {p: rng.random() < (0.9 if "/shop" in path and host == "hot.org" or "spam" in path or "bad" in path else 0.1) for p, host, path in pages if rng.random() < 0.6}
    frame = spark.createDataFrame([(p, f"https://{h}{path}?q") for p, h, path in pages], "page_id long, url string")
    got = urls.judged(frame, spark.createDataFrame(list(bad.items()), "page_id long, bad boolean")).collect()
    want, shape = brute_templates(pages, bad)
    assert len(got) == len(pages)
    for r in got:
        template, purity = want[shape[r.page_id]]
        assert r.template == template and abs(r.purity - purity) < 1e-9 and r.verdict == ("block" if purity < urls.PURITY else "allow")
    assert {r.verdict for r in got if "/spam/" in r.path and r.host == "hot.org" and "/news/" in r.path} == {"block"}
    assert {r.verdict for r in got if r.path == "/news/a/b/c/d/e"} == {"allow"}
    assert {r.verdict for r in got if r.path.startswith("/abad/")} == {"block"} and {r.verdict for r in got if r.path.startswith("/bgood/")} == {"allow"}


# --- near copies of the pipeline's stage ---


@pytest.mark.parametrize("most", [3, 64])
def test_near_copies_at_a_similarity_of_four_fifths(spark, monkeypatch, most):
    monkeypatch.setattr(minhash, "MAX_BUCKET", most)
    rng, rows = random.Random(11), []
    for g in range(12):
        base = [rng.choice(WORDS) for _ in range(150)]
        for _ in range(6):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(150)] = "other"
            rows.append((len(rows), " ".join(own)))
    rows += [(900, None), (901, ""), (902, "two words"), (903, "Two\nwords"), (904, "two other")]

    def plain(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, fps = [plain(t) for _, t in rows], [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2 or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}
    assert got == {rows[i][0]: rows[r][0] for i, r in enumerate(root)}
    assert sorted(r.doc_id for r in simhash.deduplicated(docs).collect()) == sorted({rows[r][0] for r in root})
    alone = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert len(set(alone.values())) > len(set(got.values()))


def test_deduplicated_by_row_where_ids_repeat(spark):
    a, b, c, d = texts(4, 77)
    docs = spark.createDataFrame([(3, a), (7, a), (7, b), (9, b), (11, c), (11, d), (11, c), (12, c)], "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in simhash.deduplicated(docs).collect())
    assert got == sorted([(3, a), (7, b), (11, c), (11, d)])


def test_licenses_wrapped_over_lines(spark):
    rows = [
        (1, "x y\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files"), (2, "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions\n# are met:"),
        (3, "This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0."), (4, "you may not use this\nfile except in " + "other " * 40 + "\ncompliance with the license"),
        (5, "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General\nPublic License"), (None, "you may not use this\nfile except in compliance with the license"),
    ]
    got = {r.doc_id: r.labels for r in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "mit-text", 2: "bsd", 3: "mpl-2.0", 4: "", 5: "gpl,gpl-text", None: "apache-2.0"}


def test_licenses_by_row(spark):
    text = "you may not use this file except in compliance with the license"
    rows = [(1, "nothing"), (1, text), (None, "x"), (None, text), (2, None)]
    got = [(r.doc_id, r.labels, r.n_words) for r in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    assert sorted(got, key=str) == sorted([(1, "", 1), (1, "apache-2.0", 12), (None, "", 1), (None, "apache-2.0", 12), (2, "", 0)], key=str)


def test_frequencies_of_shingles(spark):
    rng = np.random.default_rng(4)
    values = rng.integers(0, 1 << 64, 50, np.uint64)
    sets = [np.unique(rng.choice(values, 20)) for _ in range(30)]
    df = spark.createDataFrame([(i, x.view(np.int64).tolist()) for i, x in enumerate(sets)], "cls long, hashes array<long>").repartition(3)
    for bits in (4, 14):
        found = minhash.frequencies(df, bits)
        plain = Counter(int(v) >> 64 - bits for x in sets for v in x)
        assert len(found) == 1 << bits and {i: n for i, n in enumerate(found.tolist()) if n} == plain
    own = Counter(int(v) for x in sets for v in x)
    assert all(found[v >> 64 - bits] >= n for v, n in own.items())
