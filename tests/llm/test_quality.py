import re
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from failcast.llm import quality as Q
from failcast.llm.words import text_bytes
from tests.conftest import SF01, SF001


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit))


def base_of(texts):
    got = Q.read_lines(*text_bytes(pa.array(texts, pa.string()))).base
    return list(zip(*[got[c].tolist() for c in Q.BASE]))


HARD = ["", None, "a b c a b c", "x\n\nx\n x\nx", "é| ##\n日本 é|", "\n", "a b\nc a b\nc", " a\n a\n", "a a a a", "#\n#"]


def test_base_counts_of_hard_texts():
    assert base_of(HARD) == [brute(t) for t in HARD]
    for t in HARD:
        assert base_of([t]) == [brute(t)]
    assert base_of([]) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab \n\t#é"), max_size=30), max_size=4))
def test_base_counts(texts):
    assert base_of(texts) == [brute(t) for t in texts]


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 7):
        field = Q.LineField(np.zeros((Q.N_FEATURES, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
        score = rng.normal(size=(n, 2))
        total = lambda p: field.begin[p[0]] + sum(score[i, s] for i, s in enumerate(p)) + sum(field.step[a, b] for a, b in zip(p, p[1:]))
        assert tuple(field.decode(score)) == max(product((0, 1), repeat=n), key=total)


@pytest.fixture(scope="module")
def field(spark):
    return Q.fit(spark.read.parquet(f"{SF01}/documents.parquet"), spark.read.parquet(f"{SF01}/labels.parquet"))


def test_held_out_accuracy(spark, field):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = Q.judged(docs, field).where("NOT base_failed").join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in got}
    assert n.get((1, False), 0) <= 0.002 * n[(1, True)]
    assert n.get((0, True), 0) <= 0.1 * n[(0, False)]


def test_documents_match_brute_force(spark, field):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    got = {r.doc_id: r for r in Q.judged(docs, field).collect()}
    for r in docs.collect():
        want, g = brute(r.text), got[r.doc_id]
        assert tuple(g[c] for c in Q.BASE) == want
        assert g.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert g.kept == (not g.base_failed and g.content_share >= 0.5)


def test_edge_rows(spark, field):
    rows = [(None, None, 1), (1, "", 2), (2, "word " * 60, 3), (2, "word " * 60, 3), (3, "a b c\n" * 30000, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    assert Q.judged(docs, field).count() == 5
    assert Q.keep_good(docs, field).columns == docs.columns
    assert Q.judged(docs.limit(0), field).collect() == []
    one = Q.fit(docs, spark.createDataFrame([(2, 1), (None, 0), (7, None)], "doc_id long, quality int"))
    assert Q.judged(docs, one).count() == 5


def test_training_takes_little_memory_and_gives_the_same_weights():
    import tracemalloc
    rng = np.random.default_rng(5)
    lines = lambda n: np.stack([b + rng.integers(0, w, n) for b, w in zip(Q._BASE, Q._WIDTH)], axis=1)
    texts, labels = [lines(100) for _ in range(400)], [i % 2 for i in range(400)]
    packed = [x.astype(np.uint8).ravel() for x in texts]
    assert all((p.reshape(x.shape) == x).all() for p, x in zip(packed, texts))
    tracemalloc.start()
    field = Q.train(packed, labels, steps=2)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 16 * sum(p.nbytes for p in packed)  # 8 bytes and three pairs of scores a line; it was 33
    plain = Q.train([x.ravel().tolist() for x in texts], labels, steps=2)
    assert all((getattr(field, k) == getattr(plain, k)).all() for k in ("emit", "step", "begin"))


def test_features_of_training_are_bytes(spark):
    text = "one two three\nfour five .\n" * 3 + "word " * 60
    df = spark.createDataFrame([(text,), (None,), ("short",)], "text string")
    distinct = spark.createDataFrame([("\n".join(f"w{i} x{i} y{i}" for i in range(40)),)], "text string")
    f = [bytes(r.f) for r in df.select(Q.line_features(df.text).alias("f")).collect()]
    assert f[1:] == [b"", b""] and Q.N_FEATURES <= 256
    got = distinct.select(Q.line_features(distinct.text, 7).alias("f")).collect()[0].f
    want = Q.read_lines(*text_bytes(pa.array([distinct.collect()[0].text]))).features[:7]
    assert np.frombuffer(got, np.uint8).tolist() == want.ravel().tolist()
