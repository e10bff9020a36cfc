import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa

from failcast.llm import filter_audit
from failcast.scratch import discard
from tests.conftest import SF001
from tests.llm.test_periods import words_of


def brute_fails(rows):
    """Letters that each (doc_id, source, text) fails."""
    out = []
    for i, _, text in rows:
        text = text or ""
        words = words_of(text)
        least = min((j for j, _, t in rows if (t or "") == text and j is not None), default=None)
        out.append("".join(c for c, bad in (
            ("A", len(words) < 50), ("B", 100 * len(set(words)) < 65 * len(words)), ("C", 100 * sum("A" <= x <= "Z" for x in text) > 5 * len(text)),
            ("D", any(x in "#$%&*|" for x in text)), ("E", i is not None and least < i)) if bad))
    return out


def brute(rows, labels):
    fails = brute_fails(rows)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out = {}
    for part in {s or "" for _, s, _ in rows}:
        mine = [(i, f) for (i, s, _), f in zip(rows, fails) if (s or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left, gone = mine, []
            for step, f in enumerate(order, 1):
                hit = [x for x in left if f in x[1]]
                out[part, "".join(order), step] = [len(left) - len(hit), len(hit), sum(f in x[1] for x in gone), sum(x[1] == f for x in mine),
                                                   sum(i in good for i, _ in hit), sum(i in toxic for i, _ in hit), f]
                shapley[f] += len(hit)
                gone, left = gone + hit, [x for x in left if f not in x[1]]
        for (p, _, _), v in out.items():
            if p == part:
                v[6] = shapley[v[6]]
    return out


def result(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


def test_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF001}/{t}.parquet") for t in ("documents", "labels"))
    want = brute([(r.doc_id, r.source, r.text) for r in docs.collect()], [(r.doc_id, r.quality, r.toxic) for r in labels.collect()])
    got = filter_audit.audit(docs, labels)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert result(got) == want


ROWS = [(1, "s", "one Two  two\nThree"), (2, "s", "one Two  two\nThree"), (2, "s", "one Two  two\nThree"), (3, "t", "ONE TWO #"), (4, None, None), (5, "", ""), (6, "", "  \n "),
        (None, "t", "ONE TWO #"), (None, None, None), (7, "t", "w " * 60000), (8, "u", " ".join(f"v{i}" for i in range(80))), (9, "u", " ".join(f"v{i}" for i in range(80))),
        (10, "u", "é　x " * 30), (11, "s", "A" + "b" * 30), (7, "u", "seven again")]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (5, None, 1), (None, 1, 1), (8, 1, None), (99, 1, 1)]


def test_edge_rows(spark):
    docs = spark.createDataFrame([(i, s, t, 7, "x") for i, s, t in ROWS], "doc_id long, source string, text string, n_words int, part string")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert result(filter_audit.audit(docs, labels)) == brute(ROWS, LABELS)
    assert result(filter_audit.audit(docs.repartition(7), labels.limit(0))) == brute(ROWS, [])
    assert filter_audit.audit(docs.limit(0), labels).collect() == []


def test_failures_keep_every_row(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, source string, text string")
    got = sorted((str(r.doc_id), r.source or "", bytes(r.text_sha).hex(), r.fails) for r in filter_audit.failures(docs, ["source"]).collect() for _ in range(r.copies))
    assert got == sorted((str(i), s or "", hashlib.sha256((t or "").encode()).hexdigest(), f) for (i, s, t), f in zip(ROWS, brute_fails(ROWS)))


def test_matrix(spark):
    """The matrix holds each document's words; terms count from 0 without gaps, whatever the shards."""
    docs = spark.read.parquet(f"{SF001}/documents.parquet").repartition(5)
    matrix, dictionary, tables = filter_audit.term_matrix(docs)
    word = {r.term: r.word for r in dictionary.collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert sorted(word) == list(range(len(word))) and len(set(word.values())) == len(word)
    assert set(word.values()) == {w for t in texts.values() for w in words_of(t)}
    seen = 0
    for s in matrix.collect():
        columns, counts = np.frombuffer(s["columns"], "<i8").tolist(), np.frombuffer(s["counts"], "<i4").tolist()
        for k, row in enumerate(s.rows):
            a, b = s.row_starts[k], s.row_starts[k + 1]
            words = words_of(texts[row.doc_id])
            assert {word[c]: n for c, n in zip(columns[a:b], counts[a:b])} == {w: words.count(w) for w in set(words)}
            seen += 1
    assert seen == len(texts)
    discard(*tables)


def test_shards_of_any_size(monkeypatch):
    """Batches are put together and cut again without losing a row."""
    batches = [pa.record_batch({"doc_id": pa.array([i]), "text": pa.array([f"w{i} " * n])}) for i, n in enumerate((1, 500, 0, 3, 40, 40, 40, 2000))]
    for size in (1, 200, 1 << 20):
        monkeypatch.setattr(filter_audit, "SHARD_BYTES", size)
        joined = list(filter_audit._joined(iter(batches)))
        assert [x for b in joined for x in b.column("doc_id").to_pylist()] == list(range(8))
        assert len(joined) == (1 if size > 10_000 else len(joined))


def test_one_word_in_every_document(spark):
    rows = [(i, "s", "the same words " * (i % 3) + f"own{i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(16)
    assert result(filter_audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))) == brute(rows, [])
