import math
import random

import numpy as np

from failcast.llm import embeddings as E
from tests.conftest import SF01

SCHEMA = "vec_id long, embedding array<float>, label int, rep long, copies int"


def brute(rows, threshold=0.93):
    """(id, vector, label) rows -> sorted (id, n_links, component, kept), by comparing all pairs."""
    def unit(v):
        if v is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        x = np.array(v, np.float32).astype(float)
        x /= np.abs(x).max()
        return x / math.sqrt((x * x).sum())
    vectors = [None if i is None or lab is None else unit(v) for i, v, lab in rows]
    n, links, parent = len(rows), [0] * len(rows), {i: i for i, _, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(n):
        for b in range(a):
            x, y = vectors[a], vectors[b]
            if x is not None and y is not None and rows[a][2] == rows[b][2] and len(x) == len(y) and x @ y >= threshold:
                links[a] += 1
                links[b] += 1
                p, q = sorted((find(rows[a][0]), find(rows[b][0])))
                parent[q] = p
    return sorted(((i, links[k], None if i is None else find(i), i is not None and find(i) == i) for k, (i, _, _) in enumerate(rows)), key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, lab, 1, 2) for i, v, lab in rows], SCHEMA)
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in E.near_duplicates(df, **kw).collect()), key=str)


def cloud(rng, groups, spread, dim=16):
    out = []
    for size in groups:
        centre = rng.normal(size=dim)
        out += [(centre + spread * rng.normal(size=dim) * np.linalg.norm(centre) / math.sqrt(dim)).astype(np.float32).tolist() for _ in range(size)]
    return out


def test_groups_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 8)  # large buckets in many blocks; workers read the plan, not this
    rng = np.random.default_rng(5)
    vectors = cloud(rng, [1] * 40 + [2] * 20 + [5] * 5 + [40], 0.08)
    rows = [(500 - i, v, i % 2 if i < 60 else 1) for i, v in enumerate(vectors)]
    rows += [(900, vectors[3], 1), (901, vectors[3], 1), (901, vectors[3], 1)]
    got, want = run(spark, rows, miss=1e-6), brute(rows)
    assert got == want


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, None), (2, None, 1), (3, [], 1), (4, [0.0, 0.0], 1), (5, [1.0, None], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1),
            (8, v, 1), (9, [2.0, 4.0, 6.0], 1), (10, v, 2), (None, v, 1), (8, v, 1), (11, [-1.0, -2.0, -3.0], 1), (12, [1.0], 1), (13, [3.0], 1),
            (14, [1e38, 2e38, 3e38], 1), (15, [1e-40, 2e-40, 3e-40], 1), (16, [1.0, 2.0, 3.0, 0.0], 1)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == [] and run(spark, rows[:2]) == brute(rows[:2])


def test_recall_at_the_threshold():
    """Pairs just above the threshold meet with the planned probability."""
    rng, dim, n = np.random.default_rng(1), 64, 400
    a = rng.normal(size=(n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.normal(size=(n, dim))
    side -= (side * a).sum(1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    b = 0.931 * a + math.sqrt(1 - 0.931 ** 2) * side
    plan = E.Plan.of(5000, 0.93, 0.01)
    assert (plan.codes(a) == plan.codes(b)).any(axis=1).mean() > 0.97
    assert (plan.codes(a) == plan.codes(np.roll(a, 1, axis=0))).any(axis=1).mean() < 0.05


def test_table(spark):
    df = spark.read.parquet(f"{SF01}/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding, r.label) for r in df.collect()])
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in E.near_duplicates(df).collect()), key=str)
    assert sum(g[1] for g in got) >= 0.99 * sum(w[1] for w in want) and all(g[1] <= w[1] for g, w in zip(got, want))
