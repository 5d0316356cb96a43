"""Operators with learned models: held-out results, calibration, and odd rows."""

import bisect
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablewright.llm import language, line_features, lines, quality, toxic_features, toxicity

EN, DE = "the of and thing house water over going with never letter".split(), "der die und schön wasser über gehen mit niemals brief straße".split()


@pytest.fixture(scope="module")
def corpus(spark):
    rng, rows = random.Random(1), []
    for i in range(500):
        lang = rng.choice(["en", "de"])
        words = [rng.choice(EN if lang == "en" else DE) for _ in range(rng.randint(20, 60))]
        poor, toxic = i % 5 == 0, i % 4 == 1
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["you idiot", "you moron", "pathetic", "scum"]))
        text = "\n".join(" ".join(words[k : k + 8]) + "." for k in range(0, len(words), 8))
        if poor:
            text = "\n".join(["BUY### NOW$$$ BUY### NOW$$$ | <x> | 123"] * 6)
        rows.append((i, text, lang, int(not poor), int(toxic and not poor)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int, toxic int").cache()


def held_out(df, score, label):
    rows = df.where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).collect()
    return np.array([r[score] for r in rows]), np.array([r[label] for r in rows])


def keep():
    return F.crc32(F.col("doc_id").cast("string")) % 5 != 0


def test_toxicity(spark, corpus, odd, none, labels, no_labels):
    model = toxicity.fit(corpus, corpus.select("doc_id", "toxic"), keep())
    score, y = held_out(model.score(corpus, "score"), "score", "toxic")
    assert ((score >= 0.3) == (y == 1)).mean() > 0.95 and score.min() >= 0 and score.max() <= 1
    for own in (labels, no_labels):
        m = toxicity.fit(odd, own)
        got = m.score(odd, "toxicity")
        assert got.columns == [*odd.columns, "toxicity"] and got.count() == odd.count() and got.where("toxicity IS NULL").isEmpty()
    assert model.score(odd, "score").columns == [*(c for c in odd.columns if c != "score"), "score"] and dict(model.score(odd, "score").dtypes)["score"] == "double"
    assert model.score(none, "t").count() == 0 and model.score(odd, "t").where("t IS NULL").isEmpty()
    assert toxicity.fit(none, no_labels).constant == 0.0


def test_quality(spark, corpus, odd, none, labels, no_labels):
    model = quality.fit(corpus, corpus.select("doc_id", "quality"), keep())
    score, y = held_out(model.score(corpus, "s"), "s", "quality")
    assert ((score >= 0.5) == (y == 1)).mean() > 0.95
    for own in (labels, no_labels):
        got = quality.fit(odd, own).score(odd, "quality")
        assert got.count() == odd.count() and got.where("quality IS NULL").isEmpty()
    assert model.score(odd, "score").columns == [*(c for c in odd.columns if c != "score"), "score"] and dict(model.score(odd, "score").dtypes)["score"] == "double"
    assert model.score(none, "s").count() == 0 and model.score(odd, "s").where("s IS NULL").isEmpty()


def plain_features(text, lexicon):
    """NAMES by plain loops over one text."""
    text = text or ""
    low = text.lower()
    words = re.findall(r"\w+", low)
    n, chars = max(1, len(words)), max(1, len(text))
    seed, learned = [w in toxic_features.SEEDS for w in words], [w in lexicon for w in words]
    start = [any(f"^{w[:k]}" in lexicon for k in range(3, 7) if len(w) > k) for w in words]
    toxic, second = [i for i in range(len(words)) if seed[i] or learned[i] or start[i]], [i for i, w in enumerate(words) if w in toxic_features.SECOND_PERSON]
    hidden = [x.translate(toxic_features.LEET) for x in re.findall(r"[^\W\d_]+(?:[0-9@$!*]+[^\W\d_]+)+", low)]
    again = sum(1 for i in range(2, len(text)) if text[i] == text[i - 1] == text[i - 2] and 32 < ord(text[i]) < 127)
    marks = sum(33 <= ord(c) < 127 and not c.isalnum() for c in text)
    return [
        sum(seed) / n, sum(learned) / n, sum(start) / n, math.log1p(len(toxic)), sum(any(abs(i - j) <= 3 for j in second) for i in toxic) / n, len(second) / n, sum(c.isupper() and ord(c) < 0xDF for c in text) / chars,
        text.count("!") / chars, text.count("?") / chars, marks / chars, len(hidden) / n, sum(x in toxic_features.SEEDS or x in lexicon for x in hidden) / n, again / chars, math.log1p(len(words)),
    ]


def test_toxic_features(monkeypatch):
    lexicon = frozenset(["zork", "^blar", "you", "^xyz"])
    rng = random.Random(2)
    parts = ["You", "idiot", "ZORK!!", "blarney,", "blar", "wow...", "1d1ot?", "m0r0n", "a_b", "été", "ÀÉ×", "you're-stupid", "🙂", "aaa", "\n", "\t\t", "xyzzy", "东京", "(you)"]
    own = [None, "", " \n ", *(" ".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(80))]
    for size in (1, 1 << 20):
        if size == 1:  # every text in a step of its own; none of them is cut
            monkeypatch.setattr(toxic_features, "STEP", max(len((t or "").encode()) for t in own))
        else:
            monkeypatch.setattr(toxic_features, "STEP", size)
        got = toxic_features.features(pa.array(own, pa.string()), toxic_features.Chunks(lexicon))
        for t, g in zip(own, got.tolist(), strict=True):
            assert np.allclose(g, plain_features(t, lexicon)), (t, dict(zip(toxic_features.NAMES, zip(g, plain_features(t, lexicon), strict=True), strict=True)))
    monkeypatch.setattr(toxic_features, "STEP", 64)
    long = "plain words " * 40 + "idiot! " * 20
    assert np.allclose(toxic_features.features(pa.array([long]), toxic_features.Chunks(lexicon))[0], plain_features(long, lexicon))
    assert toxic_features.features(pa.array([], pa.string()), toxic_features.Chunks(lexicon)).shape == (0, len(toxic_features.NAMES))


def test_isotonic_step_is_the_pooled_mean(spark):
    """Spark's isotonic regression, as the calibration uses it, against pooling of adjacent violators."""
    from pyspark.ml.regression import IsotonicRegression

    rng = random.Random(4)
    rows = sorted((round(rng.random(), 3), float(rng.random() < 0.5)) for _ in range(60))
    rows = list(dict(rows).items())
    blocks = []
    for _, y in rows:
        blocks.append([y, 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            y, n = blocks.pop()
            blocks[-1] = [blocks[-1][0] + y, blocks[-1][1] + n]
    want = [y / n for y, n in blocks for _ in range(n)]
    frame = spark.createDataFrame(rows, "__tox_p double, y double")
    model = IsotonicRegression(featuresCol="__tox_p", labelCol="y", predictionCol="__tox_iso").fit(frame)
    got = [r[0] for r in model.transform(frame).orderBy("__tox_p").select("__tox_iso").collect()]
    assert np.allclose(got, want)


def test_pooling_is_mean_and_deviation(monkeypatch):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(quality.BUCKETS, quality.DIMENSIONS)).astype(np.float32)
    own = ["a b, c a", None, "", "12 x_y", "word " * 30, "c, c"]
    for size in (3, 100_000):
        monkeypatch.setattr(quality, "PASS", size)
        for step in (1000, 40):
            monkeypatch.setattr(quality, "STEP", step)
            got = quality.pooled(pa.array(own, pa.string()), vectors)
            for t, g in zip(own, got, strict=True):
                ids = [quality.zlib.crc32(u.encode()) % quality.BUCKETS for u in quality.UNIT.findall(t or "")]
                v = vectors[ids].astype(float) if ids else np.zeros((1, quality.DIMENSIONS))
                assert np.allclose(g, [*v.mean(0), *v.std(0), math.log1p(len(ids))], atol=1e-3), t


def test_network_gradient_lowers_the_loss_and_temperature_calibrates():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 5))
    y = (x[:, 0] + x[:, 1] ** 2 + 0.2 * rng.normal(size=3000) > 0.7).astype(float)
    net = quality.train(x, y)
    assert ((net.scores(x) >= 0.5) == (y == 1)).mean() > 0.9
    logits = net.logits(x)
    grid = np.geomspace(0.25, 8, 61)
    losses = [-np.mean(y * np.log(1 / (1 + np.exp(-logits / t)) + 1e-300) + (1 - y) * np.log(1 - 1 / (1 + np.exp(-logits / t)) + 1e-300)) for t in grid]
    assert quality.temperature(logits, y) == pytest.approx(grid[int(np.argmin(losses))])


def test_context_vectors_are_sums_over_windows(spark, monkeypatch):
    own = ["a b c a", None, "", "c, c"]
    want, fixed = np.zeros((quality.BUCKETS, quality.DIMENSIONS)), quality.index_vectors().astype(float)
    import zlib

    for t in own:
        ids = [zlib.crc32(u.encode()) % quality.BUCKETS for u in quality.UNIT.findall(t or "")]
        for i, x in enumerate(ids):
            for j in range(max(0, i - 2), min(len(ids), i + 3)):
                if j != i:
                    want[x] += fixed[ids[j]]
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    frame = spark.createDataFrame([(t,) for t in own], "text string")
    for size in (3, 100_000):
        monkeypatch.setattr(quality, "PASS", size)
        assert np.allclose(quality.context_vectors(frame.coalesce(1)), want, atol=1e-6)


def test_language(spark, corpus, odd, none):
    model = language.fit(corpus, keep())
    rows = model.score(corpus).where(~keep()).collect()
    good = [r for r in rows if r.quality]
    assert np.mean([r.lang_pred == r.lang for r in good]) > 0.98
    scored = model.score(odd)
    assert scored.columns == [*(c for c in odd.columns if c != "score"), "lang_pred", "score"] and scored.count() == odd.count()
    got = {r.doc_id: r for r in scored.collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[3].lang_pred == "und" and got[1].score == 0.0 and got[8].lang_pred in ("en", "de")
    assert model.score(none).count() == 0
    assert {r.lang_pred for r in language.fit(none).score(odd).collect()} == {"und"}
    for t in ("a", "the house", "", "ß 1"):
        assert language.grams([t, "x y"])[0][: len(t)].tolist() == language.grams([t])[0].tolist()
    # letters beyond the first plane count, other marks don't
    names, scores = model.predict(pa.array(["🙂🙂 123", "\U00010414", "𝔸", None], pa.string()))
    assert names[0] == names[3] == "und" and "und" not in names[1:3] and scores[0] == 0.0


def test_language_learns_nothing_from_held_out_rows(spark, corpus):
    changed = corpus.withColumn("text", F.when(keep(), F.col("text")).otherwise(F.lit("zzz qqq xxx"))).withColumn("lang", F.when(keep(), F.col("lang")).otherwise(F.lit("xx")))
    a, b = language.fit(corpus, keep()), language.fit(changed, keep())
    assert a.classes == b.classes and (a.table == b.table).all()


def test_language_weights_are_those_of_the_update_rule():
    rng = np.random.default_rng(7)
    rows = [(np.array(sorted(rng.choice(50, 6, replace=False))), rng.random(6), int(rng.integers(3))) for _ in range(40)]
    z, n, w = {}, {}, {}

    def weight(i, c):
        v = z.get((i, c), 0.0)
        if abs(v) <= language.L1:
            return 0.0
        return -(v - math.copysign(language.L1, v)) / ((language.BETA + math.sqrt(n.get((i, c), 0.0))) / language.ALPHA + language.L2)

    order = np.random.default_rng(4)
    for _ in range(language.EPOCHS):
        for k in order.permutation(len(rows)):
            numbers, values, y = rows[k]
            x = [*zip(numbers.tolist(), values.tolist(), strict=True), (language.FEATURES, 1.0)]
            w = {(i, c): weight(i, c) for i, _ in x for c in range(3)}
            s = [sum(v * w[i, c] for i, v in x) for c in range(3)]
            e = [math.exp(v - max(s)) for v in s]
            for c in range(3):
                p = e[c] / sum(e) - (c == y)
                for i, v in x:
                    g = v * p
                    old = n.get((i, c), 0.0)
                    z[i, c] = z.get((i, c), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / language.ALPHA * w[i, c]
                    n[i, c] = old + g * g
    got = language.train(rows, 3)
    for i in [*range(50), language.FEATURES]:
        for c in range(3):
            assert got[i, c] == pytest.approx(weight(i, c), abs=1e-9)


def test_language_scores_long_texts_in_pieces_and_as_it_was_trained(monkeypatch):
    rng = np.random.default_rng(9)
    model = language.LanguageModel(["a", "b", "c"], rng.normal(size=(language.FEATURES + 1, 3)).astype(np.float32))
    own = pa.array(["The house over water", None, "ß" * 50 + " äö 12 über", "x", "", "many words of a text " * 9])
    whole = model.predict(own)
    for t, p in zip(own.to_pylist(), whole[1].tolist(), strict=True):
        if t:
            numbers, values = language._unpacked(language._sparse(t))
            s = values @ model.table[numbers].astype(float) * language.SCALE + model.table[language.FEATURES]
            assert p == pytest.approx(max(np.exp(s - s.max()) / np.exp(s - s.max()).sum()), abs=1e-5)
    packed = [language._sparse(t or "") for t in own.to_pylist()]
    monkeypatch.setattr(language, "PASS", 7)
    again = model.predict(own)
    assert whole[0] == again[0] and np.allclose(whole[1], again[1])
    assert packed == [language._sparse(t or "") for t in own.to_pylist()]


def test_document_frequencies(spark, monkeypatch):
    own = ["the cat", "the the", None, "", "dog", "a longer text in several pieces"]
    want = np.zeros(language.FEATURES, int)
    for t in own:
        want[np.unique(language.grams([t or ""])[0])] += 1
    for size in (4, 1000):
        monkeypatch.setattr(language, "PASS", size)
        df, n = language.document_frequencies(spark.createDataFrame([(t,) for t in own], "text string").coalesce(1))
        assert n == 6 and (df == want).all()


# --- lines ---


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5):
        field = lines.LineField(np.zeros((lines.FEATURES + 1, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
        e = [tuple(x) for x in rng.normal(size=(n, 2)).tolist()]
        worth = lambda p: field.first[p[0]] + sum(e[i][k] for i, k in enumerate(p)) + sum(field.step[a, b] for a, b in itertools.pairwise(p))  # noqa: B023, E731
        assert tuple(field.decode(e)) == max(itertools.product((0, 1), repeat=n), key=worth)


def test_gradient_is_the_slope_of_the_likelihood():
    rng = np.random.default_rng(4)
    none = lines.NONE
    row = lambda *f: [*f, *[none] * (lines.WIDTH - len(f))]
    docs = [lines.Labelled(np.array([row(0, 3), row(1), row(2, 5)]), np.ones(3), 1), lines.Labelled(np.array([row(4)]), np.ones(1), 0), lines.Labelled(np.array([row(0), row(5)]), np.ones(2), 0)]
    kinds = [[1, 0, 1], [0], [0, 1]]
    x, there = lines._padded([(0, 0, 3), (1, 0, 1), (2, 0, 2)], docs)
    y = np.array([k + [7] * (3 - len(k)) for k in kinds])
    params = [rng.normal(size=(lines.FEATURES + 1, 2)), rng.normal(size=(2, 2)), rng.normal(size=2)]
    params[0][none] = 0

    def likelihood(emit, step, first):
        total = 0.0
        for doc, k in zip(docs, kinds, strict=True):
            worth = lambda p: first[p[0]] + sum(emit[doc.features[i], c].sum() for i, c in enumerate(p)) + sum(step[a, b] for a, b in itertools.pairwise(p))  # noqa: B023, E731
            total += worth(k) - np.log(sum(np.exp(worth(p)) for p in itertools.product((0, 1), repeat=len(k))))
        return total / 6

    for i, g in enumerate(lines._gradient(x, there, y, *params)):
        for at in [(0, 1), (1, 0), (5, 1)] if i == 0 else list(np.ndindex(g.shape)):
            up, down = [p.copy() for p in params], [p.copy() for p in params]
            up[i][at] += 1e-5
            down[i][at] -= 1e-5
            assert abs((likelihood(*up) - likelihood(*down)) / 2e-5 - g[at]) < 1e-6


def plain_line_features(text):
    """By line with a word: its words, and the numbers of its features, by plain loops."""
    out, seen = [], set()
    for line in (text or "").split("\n"):
        words = re.findall(r"[^\x20\x09-\x0D]+", line)
        if not words:
            continue
        n, size = len(words), max(1, len(line.encode()))
        pairs = list(itertools.pairwise(words))
        run = max(len(list(g)) for _, g in itertools.groupby(words))
        upper, lower = len(re.findall(r"[A-ZÀ-ÖØ-Þ]", line)), len(re.findall(r"[a-zß-öø-ÿ]", line))
        mark = sum(33 <= ord(c) < 127 and not c.isalnum() for c in line)
        values = (n, sum(map(len, words)) / n, sum(c in "#*$%&|<>" for c in line) / size, mark / size, upper / max(1, upper + lower), sum(c in "0123456789" for c in line) / size, len(set(words)) / n, 1 - len(set(pairs)) / len(pairs) if pairs else 0, run)
        found, first = [], 0
        for value, bounds in zip(values, line_features.BOUNDS.values(), strict=True):
            found.append(first + bisect.bisect_left(bounds, value))
            first += len(bounds) + 1
        found += [first, first + 1 if words[-1].endswith(line_features.ENDS) else lines.NONE, first + 2 if line in seen else lines.NONE]
        seen.add(line)
        out.append((n, found))
    return out


def test_line_features():
    rng = random.Random(12)
    parts = ["Word", "word.", "über", "ÄÖ", "12", "|", "<x>", "###", "東京", "end!", "e…", "\n", "\n", "\t", " ", "same", "same"]
    own = ["", "a", "\n\n", *(" ".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(80))]
    m = line_features.measured(pa.array(own))
    for i, t in enumerate(own):
        a, b = m.starts[i], m.starts[i + 1]
        assert list(zip(m.words[a:b].tolist(), m.features[a:b].tolist(), strict=True)) == plain_line_features(t), t


def brute_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    inside = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside)


def test_base_measures():
    rng = random.Random(6)
    own = [None, "", " \n", "a b\na b\n a b\n\n", "é€🙂 # $ a\x1cb c\x85d", *(" ".join(rng.choice("ab\n|") for _ in range(rng.randint(0, 60))) for _ in range(60)), *("".join(rng.choice("a b\n*") for _ in range(80)) for _ in range(40))]
    counts, failed, kept, _ = lines.measures(pa.array(own, pa.string()), None)
    for t, got, bad, good in zip(own, counts.tolist(), failed.tolist(), kept.tolist(), strict=True):
        assert tuple(got) == brute_measures(t), t
        n, *_, repeated = got
        assert bad == (n < 10 or 100 * repeated > 20 * n) and good == (not bad)
    for t, got in zip(own, counts.tolist(), strict=True):
        assert lines.measures(pa.array([t], pa.string()), None)[0].tolist() == [got]


def test_quality_rules(spark, corpus, odd, none, labels, no_labels):
    field = lines.fit(corpus, corpus.select("doc_id", "quality"), keep())
    rows = lines.judged(corpus, field).join(corpus.select("doc_id", "quality"), "doc_id").where(~keep()).collect()
    assert np.mean([(r.content_share >= lines.CONTENT_SHARE) == (r.quality == 1) for r in rows]) > 0.95
    assert lines.fit(odd, no_labels) is None
    got = lines.judged(odd, lines.fit(odd, labels))
    assert got.count() == odd.count() and not got.where("doc_id IN (1, 2, 3) AND kept").count() and lines.judged(none, field).count() == 0


def test_quality_rules_in_mixed_documents(spark):
    """Lines of both kinds stand in documents of both labels; the field tells them apart, and changes its mind inside a document."""
    rng, rows = random.Random(3), []
    good_line = lambda: " ".join(rng.choice(EN) for _ in range(12)) + "."
    poor_line = lambda: " | ".join(rng.choice(EN) for _ in range(12))
    for i in range(300):
        poor = i % 3 == 0
        kinds = sorted(rng.random() < (0.2 if poor else 0.8) for _ in range(10))
        if sum(kinds) in (4, 5, 6):
            continue
        rows.append((i, "\n".join(good_line() if k else poor_line() for k in kinds), int(sum(kinds) > 5), kinds))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    field = lines.fit(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int"))
    m = line_features.measured(pa.array([r[1] for r in rows]))
    e = list(map(tuple, field.emissions(m.features).tolist()))
    right = [a == b for i, r in enumerate(rows) for a, b in zip(field.decode(e[m.starts[i] : m.starts[i + 1]]), r[3], strict=True)]
    assert np.mean(right) > 0.95
    share = {r.doc_id: r.content_share for r in lines.judged(docs, field).collect()}
    assert sum(0 < x < 1 for x in share.values()) > 0.6 * len(rows)
    assert np.mean([(share[r[0]] >= lines.CONTENT_SHARE) == (r[2] == 1) for r in rows]) > 0.97
