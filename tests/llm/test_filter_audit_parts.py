import numpy as np
import pyarrow as pa

from failcast.llm import filter_audit
from failcast.scratch import discard


def test_words_travel_in_packs(spark, monkeypatch):
    """The shuffle by word carries packs, not a row a word, and every part numbers its own words; terms have no gaps."""
    monkeypatch.setattr(filter_audit, "PART_BYTES", 300)
    texts = [" ".join(f"w{(i * j) % 97}" for j in range(40)) + " é日本 " * (i % 2) for i in range(60)] + [None, "", "x" * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    matrix, dictionary, tables = filter_audit.term_matrix(docs)
    shards, numbered = tables
    sent = numbered.where("shard IS NOT NULL")
    assert numbered.select("part").distinct().count() > 5
    assert sent.count() == sent.select("shard", "part").distinct().count() < 0.5 * sent.agg({"n": "sum"}).first()[0]
    word = {r.term: r.word for r in dictionary.collect()}
    assert sorted(word) == list(range(len(word))) and set(word.values()) == {w for t in texts for w in (t or "").split()}
    for s in matrix.collect():
        columns, counts = np.frombuffer(s["columns"], "<i8").tolist(), np.frombuffer(s["counts"], "<i4").tolist()
        for row, a, b in zip(s.rows, s.row_starts, s.row_starts[1:]):
            words = (texts[row.doc_id] or "").split()
            assert {word[c]: n for c, n in zip(columns[a:b], counts[a:b])} == {w: words.count(w) for w in set(words)}
    discard(*tables)


def test_parts_hold_each_word_once():
    words = pa.array([f"word{i}".encode() for i in range(500)], pa.large_binary())
    order, packs = filter_audit._in_parts(words, 7)
    assert sorted(order.tolist()) == list(range(500)) and sum(p["n"] for p in packs.to_pylist()) == 500
    assert filter_audit._in_parts(words.slice(0, 0), 7)[1].to_pylist() == []
