import random
import re

from failcast.llm import licenses as L
from tests.conftest import SF01, SF001

PHRASES = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text):
    w = words_of(text)
    at = [(i, lab) for p, lab in PHRASES.items() for i in range(len(w)) if tuple(w[i:i + len(p)]) == p]
    return (len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({lab for _, lab in at})))


def base_of(r):
    return (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)


HARD = ["", None, "CC-BY", "cc by cc by cc", "cc", "All Rights\nReserved. all rights reserved", "general public cc by license general public license",
        "éCC by", "cc_by", "cc by", "CC BY" * 3, "ccby cc  by", "1 cc by4", "İcc by K cc by"]


def test_hard_texts(spark):
    rows = [(i, t, "x", 0) for i, t in enumerate(HARD)] + [(None, "cc by", "x", 1), (3, "cc by cc by cc", "y", 2), (3, "other", None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string, n_words int")
    got = sorted((str(r.doc_id), *map(str, base_of(r))) for r in L.scan(docs).collect())
    assert got == sorted((str(r[0]), *map(str, brute(r[1]))) for r in rows)
    assert L.scan(docs.limit(0)).collect() == []


def test_documents(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    want = {r.doc_id: brute(r.text) for r in docs.collect()}
    got = L.scan(docs).collect()
    assert {r.doc_id: base_of(r) for r in got} == want
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
        assert (r.score > 0) == bool(r.labels)


def test_changed_templates_are_found(spark):
    rng, rows = random.Random(2), []
    filler = lambda n: " ".join(rng.choice(["lorem", "of", "the", "and", "in", "this", "is", "software"]) for _ in range(n))
    for i, t in enumerate(L.COMMON):
        w = t.text.split()
        w.insert(len(w) // 2, "really")
        rows.append((i, f"{filler(300)} {' '.join(w)} {filler(500)}"))
        half = t.text.split()[: max(2, len(w) // 2 - 1)]
        rows.append((100 + i, f"{filler(300)} {' '.join(half)} {filler(20)}"))
    rows += [(200 + i, filler(2000)) for i in range(5)]
    got = {r.doc_id: r for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in enumerate(L.COMMON):
        if len(t.text.split()) >= 8:
            assert t.label in got[i].labels.split(","), t
            assert t.label not in got[100 + i].labels.split(",") or t.base, t
    assert all(not got[200 + i].labels for i in range(5))


def test_spans_tell_their_place(spark):
    text = "one two Licensed under the Apache License, Version 2.0 end. All rights reserved"
    got = {(r.label, r.start, r.stop) for r in L.license_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()}
    assert got == {("apache", 2, 10), ("reserved", 11, 14)}
