import random

import duckdb
import pytest

from failcast.llm import mixing as M
from tests.conftest import SF01


def close(a, b):
    return a == b or (a is not None and b is not None and abs(a - b) < 1e-6)


def test_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF01}/documents.parquet')")
    cur = con.execute(M.mixed_sql())
    names = [c[0] for c in cur.description]
    want = {r[0]: dict(zip(names, r)) for r in cur.fetchall()}
    got = {r.doc_id: r.asDict() for r in M.mixed(spark.read.parquet(f"{SF01}/documents.parquet")).collect()}
    assert got.keys() == want.keys()
    for k, g in got.items():
        assert all(close(g[c], want[k][c]) for c in names), (g, want[k])


def water(sizes, share=1.5, most=2.0):
    """Targets by the stated rule, one stop at a time."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    budget, stopped = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in stopped]
        level = (budget - sum(stopped.values())) / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] >= most * sizes[s]]
        if not over:
            return {**stopped, **{s: level * weight[s] for s in free}}
        stopped |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_targets_and_taken(spark, seed):
    rng = random.Random(seed)
    sources = ["b", "a", None, "é", "Z", "", "z"]
    rows = [(i, None if rng.random() < .1 else " ".join(["w"] * rng.choice([0, 1, 3, 40])), rng.choice(sources + ["a"] * 6), 7, 8.5) for i in range(150)]
    rows += [(None, "x y", "a", 1, 1.0), (5, "dup dup", "b", 1, 1.0), (5, "dup dup", "b", 1, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, target double")
    got = M.assign(docs).collect()
    assert len(got) == len(rows)
    size = {}
    for r in rows:
        size[r[2]] = size.get(r[2], 0) + len((r[1] or "").split())
    want, taken = water(size), dict.fromkeys(size, 0)
    for r in got:
        assert r.size == len((r.text or "").split()) and r.source_size == size[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        assert r.positions == sorted(r.positions) and all(0 <= p <= 1 for p in r.positions)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in size)
    again = M.assign(docs.repartition(5)).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken, r.positions)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_inverse_of_the_demand(spark):
    s = M.Schedule(((0.0, 0.0), (0.2, 4.0), (0.6, 1.0), (1.0, 1.0)))
    rows = spark.range(0, 101).select((M.F.col("id") / 100).alias("q"), M.time_of(s, M.F.col("id") / 100).alias("t")).collect()
    for r in rows:
        demand = sum((w + w + k * max(0.0, min(r.t - t0, d))) / 2 * max(0.0, min(r.t - t0, d)) for t0, d, w, k, _ in s.lines)
        assert abs(demand - r.q * s.total) < 1e-9
    with pytest.raises(ValueError):
        M.Schedule(((0.0, 1.0), (0.5, 1.0)))


def test_order_and_weights_over_time(spark):
    rows = [(i, "w " * 10, "ab"[i % 2]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    steep = (M.Schedule(((0.0, 2.0), (1.0, 0.0))), M.Schedule(((0.0, 0.0), (1.0, 2.0))))
    got = M.training_order(docs, partitions=3, schedules=steep, share=1.0).collect()
    assert [r.position for r in got] == sorted(r.position for r in got) and len(got) == 400
    early = [r.source for r in got[:100]]
    assert early.count("a") > 80  # its weight falls while the other's rises


def test_edge_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.mixed(empty).collect() == [] and M.training_order(empty).collect() == []
    blank = spark.createDataFrame([(1, None, None), (2, "", "a"), (2, "", "a")], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken, r.first_position) for r in M.mixed(blank).collect()] == [(0, 0.0, 0, None)] * 3
    long = spark.createDataFrame([(1, "w " * 100000, "a"), (2, "x", "b")], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.size, r.taken) for r in M.mixed(long).collect()) == [(1, 100000, 149999), (2, 1, 2)]
