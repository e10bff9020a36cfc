import hashlib
import random
import re

import numpy as np
import pytest

from failcast.llm import passages as P
from failcast.llm.words import text_bytes
from tests.conftest import SF001, SF01


def brute(rows, k):
    """(id, text) rows -> sorted (id, n_words, n_removed, sha256 of the words that stay)."""
    first, texts = {}, [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    for i, w in texts:
        for a in range(len(w) - k + 1) if i is not None else ():
            g = tuple(w[a:a + k])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, w in texts:
        gone = set()
        for a in range(len(w) - k + 1) if i is not None else ():
            if first[tuple(w[a:a + k])] < i:
                gone.update(range(a, a + k))
        kept = " ".join(x for a, x in enumerate(w) if a not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, k):
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, shard int, kept string")
    return sorted((tuple(r) for r in P.removed(docs, k).collect()), key=str)


@pytest.mark.parametrize("seed,k,slices", [(1, 4, 200), (2, 3, 10 ** 6), (3, 13, 500)])
def test_random_texts(spark, monkeypatch, seed, k, slices):
    monkeypatch.setattr(P, "BUCKET_BYTES", 4000)
    monkeypatch.setattr(P, "SHARD_BYTES", 3000)
    rng = random.Random(seed)
    words = ["a", "b", "c", "é", "日本", "Aa", "x1"] + [f"w{i}" for i in range(40)]
    passage = [[rng.choice(words) for _ in range(rng.randint(k, 3 * k))] for _ in range(8)]
    rows = []
    for i in range(150):
        t = []
        for _ in range(rng.randint(0, 5)):
            t += rng.choice(passage) if rng.random() < 0.5 else [rng.choice(words) for _ in range(rng.randint(0, 2 * k))]
        rows.append((rng.randrange(-50, 400), rng.choice([" ", "\n", " \t "]).join(t)))
    rows += [(None, rows[0][1]), (None, None), (401, None), (402, ""), (403, " "), rows[3], rows[3]]
    assert run(spark, rows, k) == brute(rows, k)


def test_slices_of_one_document(spark):
    """The same row twice, in different slices of the input, loses nothing to itself."""
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(5, text), (5, text), (9, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r)[:3] for r in P.removed(docs, 13).collect()))
    assert got == [(5, 30, 0), (5, 30, 0), (9, 30, 30)]


def test_slices_settle_alike():
    """Many small slices and one large one lose the same windows."""
    rng = np.random.default_rng(0)
    import pyarrow as pa
    texts = [" ".join(rng.choice(list("abcd"), 12)) for _ in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(60), pa.int64()), pa.array(texts)], ["doc_id", "text"])

    held = [{tuple(t.split()[a:a + 3]) for a in range(10)} for t in texts]
    hashed = {}
    for rows, data, offsets in P.blocks(batch):
        w = P.find_words(data, offsets)
        for k, i in zip(*P.windows(w.hashes(), w.first, 3)):
            hashed[tuple(x.decode() for x in w.texts()[i:i + 3])] = int(k)

    def lost(step):
        P_slice, P.SLICE_WINDOWS = P.SLICE_WINDOWS, 0 if step < 60 else 10 ** 9
        try:
            sent = [b for a in range(0, 60, step) for b in P._send(3, 2, 2)(iter([batch.slice(a, step)]))]
        finally:
            P.SLICE_WINDOWS = P_slice
        table = pa.Table.from_batches(sent)
        told = pa.concat_tables([P._settle(2)(table.filter(pa.compute.equal(table["bucket"], b))) for b in (0, 1)])
        out = set()
        for s in (0, 1):
            owner = dict(zip(*(x.tolist() for x in P._owners(told.filter(pa.compute.equal(told["shard"], s))))))
            out |= {(i, g) for i in range(60) if P.shard_of(np.array([i]), 2)[0] == s for g in held[i] if owner.get(hashed[g], 60) < i}
        return out
    assert lost(1) == {(i, g) for i in range(60) for g in held[i] if any(g in x for x in held[:i])}
    assert lost(7) == lost(60) == lost(1)


def test_edge_tables(spark):
    assert run(spark, [], 13) == []
    rows = [(1, "k " * 60000), (2, "k " * 13), (3, "k " * 12), (4, "K " * 13)]
    assert run(spark, rows, 13) == brute(rows, 13)


def test_passages_are_told(spark):
    rows = [(1, "x y a b c d e"), (2, "q a b c d r a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.kept, [(p.start, p.stop) for p in r.passages]) for r in P.without_repeats(docs, 3).collect()}
    assert got == {1: ("x y a b c d e", []), 2: ("q r", [(1, 5), (6, 9)])}


@pytest.mark.parametrize("folder", [SF001, SF01])
def test_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert sorted((tuple(r) for r in P.removed(docs, 13).collect()), key=str) == brute([(r.doc_id, r.text) for r in docs.collect()], 13)


@pytest.mark.parametrize("size", [1024, 2048, 4096])
def test_long_patterned_words(spark, size):
    """The words of a sequence that defeats polynomial hashes modulo a power of two, and its complement."""
    word = "a"
    while len(word) < size:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    tail = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{word} {tail}"), (2, f"{other} {tail}"), (3, f"{word} {tail}")]
    got = run(spark, rows, 13)
    assert got == brute(rows, 13) and [r[2] for r in got] == [0, 0, 13]


def test_only_the_automaton_removes(spark, monkeypatch):
    """Without hits of the automaton nothing goes; a passage told by one document goes from the others of its shard."""
    import ahocorasick
    import pyarrow as pa

    text = " ".join(f"w{i}" for i in range(20))
    docs = pa.table({"doc_id": pa.array([1, 2, 3], pa.int64()), "text": [text, text + " x", "y " + text]})
    w = P.find_words(*text_bytes(docs["text"].combine_chunks()))
    grams, at = P.windows(w.hashes(), w.first, 13)
    ids, counts, keys = P._by_document(np.full(8, 1), grams[:8])
    told = pa.table({"ids": [ids], "counts": [counts], "keys": [keys]})
    assert P._cut(13)(docs, told)["n_removed"].to_pylist() == [0, 20, 20]
    seen, real = [], ahocorasick.Automaton

    class Deaf:
        def __init__(self, *args):
            self.real = real(*args)

        def __getattr__(self, name):
            return getattr(self.real, name)

        def iter(self, line):
            seen.append(line)
            return iter(())
    monkeypatch.setattr(ahocorasick, "Automaton", Deaf)
    assert P._cut(13)(docs, told)["n_removed"].to_pylist() == [0, 0, 0] and len(seen) == 3
