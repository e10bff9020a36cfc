import random
import tracemalloc

import numpy as np
import pyarrow as pa

from failcast.llm import filter_audit
from failcast.llm.words import blocks

TEXTS = ["", None, "  \n ", "one Two  two\nThree", "é　x #" * 30, "x" * 3000, " ".join(f"W{i % 97}" for i in range(900)), "w " * 700, ""]


def shard_of(texts):
    batch = pa.record_batch({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts, pa.string())})
    (rows, data, offsets), = blocks(batch, size=1 << 30)
    return filter_audit._shard(7, rows, data, offsets, 3), data, offsets


def test_a_shard_takes_little_beside_its_text():
    """Sums per row and cells are made a block at a time (before: 24 bytes for each byte of text for the sums alone)."""
    rng = random.Random(5)
    texts = [" ".join(f"word{rng.randrange(3000)}" for _ in range(500)) for _ in range(1600)]
    size = sum(map(len, texts))
    assert size > 6 << 20
    tracemalloc.start()
    shard, _, _ = shard_of(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert shard.num_rows == 1 and peak < 8 * size


def test_blocks_make_the_same_shard(monkeypatch):
    whole, _, _ = shard_of(TEXTS)
    rows = whole.column("rows").flatten()
    assert rows.field(1).to_pylist() == [len(t or "") for t in TEXTS]
    assert rows.field(2).to_pylist() == [sum("A" <= c <= "Z" for c in t or "") for t in TEXTS]
    assert rows.field(3).to_pylist() == [sum(c in "#$%&*|" for c in t or "") for t in TEXTS]
    for size in (1, 10, 500, 4000):
        monkeypatch.setattr(filter_audit, "BLOCK_BYTES", size)
        monkeypatch.setattr(filter_audit, "blocks", lambda rows, size=size: blocks(rows, size=size))
        assert shard_of(TEXTS)[0].equals(whole)


def test_a_shard_without_words():
    shard, _, _ = shard_of(["", None, " \t "])
    assert shard.column("row_starts").to_pylist() == [[0, 0, 0, 0]] and shard.column("packs").to_pylist() == [[]]
    assert shard.column("rows").flatten().field(1).to_pylist() == [0, 0, 3]


def test_row_totals():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 256, 2_000_000).astype(np.uint8)
    offsets = np.sort(np.append([0, 0, len(values), len(values)], rng.integers(0, len(values), 500)))
    for kind in (None, *filter_audit.COUNTS.values()):
        total = np.append(0, np.cumsum(values.astype(np.int64) if kind is None else kind[values]))
        assert (filter_audit._row_totals(values, offsets, kind) == np.diff(total[offsets])).all()
    assert filter_audit._row_totals(values[:0], np.zeros(3, np.int64)).tolist() == [0, 0]


def test_batches_are_small_only_meanwhile(spark, monkeypatch):
    """Rows of shards travel in small batches; the session's own setting comes back, also after an error."""
    key, size = filter_audit.BATCH_BYTES
    seen, made = [], filter_audit.row_counts
    monkeypatch.setattr(filter_audit, "row_counts", lambda matrix: seen.append(spark.conf.get(key)) or made(matrix))
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    before = spark.conf.get(key, None)
    assert filter_audit.failures(docs).count() == 2 and seen == [size] and spark.conf.get(key, None) == before
    spark.conf.set(key, "3m")
    try:
        monkeypatch.setattr(filter_audit, "row_counts", lambda matrix: 1 / 0)
        try:
            filter_audit.failures(docs)
        except ZeroDivisionError:
            pass
        assert spark.conf.get(key) == "3m"
    finally:
        spark.conf.unset(key)


def test_a_shard_goes_on_in_pieces(spark, monkeypatch):
    """Rows of the matrix are bounded in cells; pieces hold every document once, in its shard's order."""
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1)
    whole, _, _ = shard_of(TEXTS)
    for cells in (1, 90, 1 << 17):
        monkeypatch.setattr(filter_audit, "CELLS", cells)
        _, dictionary, tables = made = filter_audit.term_matrix(docs)
        shards = tables[0].drop("packs").toArrow().combine_chunks()
        numbered = {r["part"]: r for r in tables[1].where("shard IS NOT NULL").collect()}
        terms = pa.array([[{"part": k, "n": numbered[k]["n"], "numbers": bytes(numbered[k]["numbers"])} for k in sorted(numbered)]])
        before, seen = {}, 0
        for k in sorted(numbered):
            before[k], seen = seen, seen + numbered[k]["n"]
        pieces = list(filter_audit._global(before)(iter(shards.append_column("terms", terms).to_batches())))
        got = [(row["doc_id"], b - a) for p in pieces for row, a, b in zip(p["rows"].flatten().to_pylist(), p["row_starts"].to_pylist()[0], p["row_starts"].to_pylist()[0][1:])]
        assert got == [(i, len(set((t or "").split(" ") if i == 4 else (t or "").split()) - {""})) for i, t in enumerate(TEXTS)]
        assert all(len(p["columns"][0].as_py()) // 8 <= max(cells, 100) for p in pieces) and (len(pieces) > 1) == (cells < 1000)
        assert sum(r.n_words for r in filter_audit.row_counts(made[0]).collect()) == sum(len((t or "").replace("\u3000", "_").split()) for t in TEXTS)
        filter_audit.discard(*tables)
