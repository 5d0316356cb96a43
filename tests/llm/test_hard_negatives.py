"""Hard negatives against brute force."""

import math
import random

import numpy as np
import pytest

from tablewright.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    own = []
    for i, (vec, x, label) in enumerate(rows):
        if label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        label = (label + 1) % 10 if vec is not None and vec % 7 == 0 else label
        own.append((i, vec, [math.floor(256 * float(np.float32(v))) for v in x], label))
    out = []
    first = lambda r: (-r[0], r[1] is None, r[1] or 0, r[2])
    for i, vec, q, label in own:
        if vec is None or vec % 50:
            continue
        scored = [(sum(a * b for a, b in zip(q, p, strict=False)), v, j, other) for j, v, p, other in own if j != i]
        for s, v, _, _ in sorted((r for r in scored if r[3] == label), key=first)[:5]:
            fits = sorted((r for r in scored if r[3] != label and 50 * s <= 100 * r[0] <= 95 * s), key=first)[:3]
            out += [(vec, v, rank, r[1], s, r[0]) for rank, r in enumerate(fits, 1)]
    return sorted(out, key=repr)


def result(spark, rows):
    docs = spark.createDataFrame([(*r, "own", 3) for r in rows], SCHEMA + ", q string, row int").repartition(3)
    df = hard_negatives.mined(docs)
    assert df.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]
    return sorted(map(tuple, df.collect()), key=repr)


def vectors(n, d, seed, spread=0.3):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(6, d))
    x = centers[rng.integers(0, 6, n)] + spread * rng.normal(size=(n, d))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32).tolist()


@pytest.mark.parametrize("sizes", [(2048, 512, 1 << 14), (7, 3, 5)])
def test_brute_force(spark, monkeypatch, sizes):
    for name, size in zip(("CHUNK", "BLOCK", "GROUP"), sizes, strict=True):
        monkeypatch.setattr(hard_negatives, name, size)
    rng = random.Random(2)
    rows = [(i, x, rng.randrange(10)) for i, x in zip(rng.sample(range(-2000, 2000, 5), 400), vectors(400, 6, 1), strict=True)]
    found = result(spark, rows)
    assert found == brute(rows) and len(found) > 100


def test_hot_copies_and_ties(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 4)
    same, other = [0.5, 0.5, 0.0], [0.4, 0.4, 0.1]
    rows = [(i, same if i % 3 else other, i % 2) for i in range(300)] + [(7000 + i, x, 1) for i, x in enumerate(vectors(50, 3, 4))]
    assert result(spark, rows) == brute(rows)


def test_odd_rows(spark):
    x = [0.5, -0.25, 1.0]
    rows = [
        (0, x, 1), (50, x, None), (100, None, 1), (150, [0.5, None, 0.1], 1), (200, [0.5, float("nan"), 0.1], 1), (250, [float("inf"), 0.1, 0.2], 1), (300, [], 1), (350, [0.0, 0.0, 0.0], 3),
        (400, [0.5], 1), (400, [0.5], 1), (None, x, 1), (None, [0.45, -0.25, 0.9], 2), (None, [0.45, -0.25, 0.9], 2), (7, x, 9), (14, [0.4, -0.2, 0.9], 0), (3, [0.4, -0.2, 0.9], 5), (-50, [0.3, 0.3, 0.3], -1), (-7, [0.3, 0.2, 0.2], -1),
    ]
    found = result(spark, rows)
    assert found == brute(rows) and any(r[3] is None for r in found)
    assert hard_negatives.mined(spark.createDataFrame([], SCHEMA)).collect() == []


def test_large_components(spark):
    """Scores beyond 2^53 are exact; vectors of 2^28 and more take no part."""
    rng = random.Random(4)
    rows = [(10 * i, [rng.uniform(0, 4e5) for _ in range(4)], i % 3) for i in range(80)]
    assert result(spark, rows) == brute(rows)
    assert result(spark, [*rows, (1000, [3e37, 1.0, 1.0, 1.0], 1), (1050, [1.1e6, 0.0, 0.0, 0.0], 1)]) == brute(rows)


def test_spanning_tree_and_bounds():
    q = np.floor(256 * np.array(vectors(60, 5, 7)))
    tree = hard_negatives.spanning_tree(q)
    assert sorted(c for c, _, _ in tree) == list(range(60)) and tree[0][1] == -1
    seen = set()
    for child, parent, d in tree:
        assert parent < 0 or parent in seen
        seen.add(child)
        if parent >= 0:
            scores = q @ q[child], q @ q[parent]
            assert (np.abs(scores[0] - scores[1]) <= d * np.linalg.norm(q, axis=1) + 1e-6).all()
    every = np.linalg.norm(q[:, None] - q[None], axis=2)
    least = sum(d for _, p, d in tree if p >= 0)
    inside, total = {0}, 0.0
    while len(inside) < 60:
        d, j = min((every[i, j], j) for i in inside for j in set(range(60)) - inside)
        inside.add(j)
        total += d
    assert abs(total - least) < 1e-6


def test_bounds_spare_scoring(monkeypatch):
    """Rows whose bounds overlap no open window aren't scored."""
    import pyarrow as pa

    q = np.floor(256 * np.array(vectors(400, 4, 9, 0.02))).astype(np.int32)
    n_anchors, taken = 40, []
    add = hard_negatives._Best.add
    monkeypatch.setattr(hard_negatives._Best, "add", lambda self, rows: (taken.append(rows.shape[1]), add(self, rows))[1])
    lists = {"row": np.arange(400), "id": np.arange(400), "label": np.zeros(400, np.int32), "q": q.ravel(), "a_row": np.arange(n_anchors), "a_id": np.arange(n_anchors), "a_label": np.zeros(n_anchors, np.int32), "a_q": q[:n_anchors].ravel(), "a_low": np.full(n_anchors, -(1 << 62)), "a_high": np.full(n_anchors, 1 << 62)}
    one = lambda lo, hi: pa.RecordBatch.from_pydict({k: pa.array([(v.reshape(400, -1)[lo:hi].ravel() if not k.startswith("a_") else v).tolist()]) for k, v in lists.items()})
    found = pa.Table.from_batches(list(hard_negatives._scored(True, 5)(iter([one(0, 200), one(200, 400)])))).to_pylist()
    want = {a: sorted((-int(q[a].astype(int) @ q[j].astype(int)), j) for j in range(400) if j != a)[:5] for a in range(n_anchors)}
    got = {a: sorted((-r["score"], r["row"]) for r in found if r["anchor"] == a)[:5] for a in range(n_anchors)}
    assert got == want and sum(taken) < 0.7 * n_anchors * 400
