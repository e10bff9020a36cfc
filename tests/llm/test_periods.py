import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from failcast.llm import periods
from failcast.llm.words import find_words, text_bytes
from tests.conftest import SF001

SPACES = " \t\n\x0b\x0c\r"


def words_of(text):
    for c in SPACES[1:]:
        text = (text or "").replace(c, " ")
    return [w for w in text.split(" ") if w]


def brute_runs(words):
    """Every maximal stretch of each period, the smallest period kept."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(24, 3 * q):
                found.setdefault((i, j + q - i), q)  # ascending q: the smallest one stays
            i = max(j, i + 1)
    return sorted((s, length, q) for (s, length), q in found.items())


def planted_words(doc_id, words):
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def collapsed(words, runs):
    lost = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in lost)


def expected(doc_id, text):
    words = planted_words(doc_id, words_of(text))
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    digest = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, collapsed(words, runs))]
    return (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *digest)


def found(texts):
    return [(n, [(r["start"], r["length"], r["period"]) for r in runs], text)
            for n, runs, text in periods._block(*text_bytes(pa.array(texts, pa.string())))]


def check(texts):
    for text, (n, runs, kept) in zip(texts, found(texts)):
        words = words_of(text)
        assert (n, runs, kept) == (len(words), brute_runs(words), collapsed(words, brute_runs(words)))


def test_made_up_texts():
    def repeat(period, n, seed=0):
        unit = [f"w{seed}_{i}" for i in range(period)]
        return [unit[i % period] for i in range(n)]
    texts = ["a " * 24, "a " * 23, "a b " * 12, "x " + "a b c " * 9 + "y", " ".join(repeat(8, 24)), " ".join(repeat(8, 23)),
             " ".join(repeat(100, 299)), " ".join(repeat(100, 300)), " ".join(repeat(100, 333) + repeat(7, 50, 1)),
             " ".join((repeat(3, 30) + repeat(5, 33, 2)) * 4), "aab" * 3 + " " + "a a b " * 40, "", " \n ", None, "one",
             " ".join((["a"] * 30 + ["b"]) * 5), " ".join(repeat(2, 40) + repeat(2, 41))]
    check(texts)
    for t in texts:
        check([t])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.tuples(st.text("ab", min_size=1, max_size=2), st.integers(1, 12), st.integers(1, 6)), max_size=8), max_size=3))
def test_any_text(spec):
    """Texts out of few words, with stretches repeated."""
    texts = []
    for parts in spec:
        words = []
        for w, n, times in parts:
            unit = [w] + words[-n + 1:] if n > 1 else [w]
            words += unit * times
        texts.append(" ".join(words[:400]))
    check(texts)


def test_random_words():
    rng = np.random.default_rng(3)
    for size, kinds in ((300, 2), (500, 3), (2000, 5)):
        words = rng.integers(0, kinds, size).astype(str).tolist()
        for _ in range(6):
            a, n = int(rng.integers(0, size // 2)), int(rng.integers(1, 40))
            words[a:a] = words[a:a + n] * int(rng.integers(1, 5))
        check([" ".join(words)])


def test_words_are_numbered_exactly():
    texts = ["ab", "a b", "ab ab", "", "b", "é　x ab"]
    w = find_words(*text_bytes(pa.array(texts)))
    numbers = periods.word_numbers(w)
    assert dict(zip(w.texts(), numbers.tolist())) == {t: numbers[w.texts().index(t)] for t in w.texts()}
    assert len(set(numbers.tolist())) == len(set(w.texts()))


def result(r):
    return (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256)


def test_documents(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    want = {r.doc_id: expected(r.doc_id, r.text) for r in docs.collect()}
    got = {r.doc_id: result(r) for r in periods.digests(docs).collect()}
    assert got == want and any(v[0] for v in want.values())


def test_edge_rows(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0][:6]
    rows = [(None, "a " * 50, 1, "r"), (1, None, 2, "r"), (2, "", 3, "r"), (3, "x y " * 30, 4, "r"), (3, "x y " * 30, 4, "r"), (4, "w " * 60000, 5, None)]
    rows += [(i, t, 6, "r") for i, t in zip(ids, ["", None, "one", " ".join(f"v{k}" for k in range(101)), " \t ", "\n".join(f"v{k}" for k in range(7))])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, runs string")
    want = sorted(((r[0], *expected(r[0], r[1])) for r in rows[:5] + rows[6:]), key=str)
    got = [(r.doc_id, *result(r)) for r in periods.digests(docs).collect()]
    assert sorted((x for x in got if x[0] != 4), key=str) == want
    assert next(x for x in got if x[0] == 4)[1:6] == (1, 0, 60000, 1, 60_000_000)
    out = periods.with_runs(docs)
    assert out.columns == ["doc_id", "text", "n_words", "runs", "collapsed"] and out.count() == len(rows)
    assert periods.digests(docs.limit(0)).collect() == []
