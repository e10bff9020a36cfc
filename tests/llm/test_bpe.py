import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from failcast.llm import bpe
from failcast.llm.words import text_bytes
from tests.conftest import SF001

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")
HARD = ["", " ", "a", "don't !'s 'sx '''ll  \n\n x", "x<|endoftext|>y <|endoftext|>", "<|endoftext|", "tab\t\tword  ",
        "é è　  z\u0085k", "日本語テキスト123", "a" * 5000, "!?'re 's's", "\x1c\x1d a\x00b", "🎉🎉'S don’t",
        "end<|endoftext|><|endoftext|> 's", " '", "' s"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH)


def ids_of(texts):
    got = bpe._fragments(PATH).encode(*text_bytes(pa.array(texts, pa.string())))
    return [np.frombuffer(x, "<u4").tolist() for x in got]


def test_hard_texts(library):
    for texts in (HARD, *[[t] for t in HARD]):
        assert ids_of(texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab's  \n!1é日’tl<|endofx> r e"), max_size=40), max_size=4))
def test_any_text(texts):
    from tokenizers import Tokenizer
    lib = test_any_text.__dict__.setdefault("lib", Tokenizer.from_file(PATH))
    got = ids_of(texts)
    assert got == [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert [bpe._fragments(PATH).decode(np.array(i, "<u4").tobytes()) for i in got] == [lib.decode(i, skip_special_tokens=False) for i in got]


def test_cache_restart(monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHED_FRAGMENTS", 5)
    made = bpe.Fragments(PATH)
    for t in HARD:
        got = np.frombuffer(made.encode(*text_bytes(pa.array([t])))[0], "<u4").tolist()
        assert got == library.encode(t, add_special_tokens=False).ids


def expected(lib, text):
    ids = lib.encode(text or "", add_special_tokens=False).ids
    return (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_documents(spark, library):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    want = {r.doc_id: expected(library, r.text) for r in docs.collect()}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs, PATH).collect()} == want


def test_edge_rows(spark, library):
    rows = [(None, None, 1, "i"), (1, None, 2, "i"), (2, "", 3, "i"), (3, "same 's", 4, "i"), (3, "same 's", 4, "i"), (4, "w " * 60000, 5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids string")
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs, PATH).collect()), key=str)
    assert got == sorted(((r[0], *expected(library, r[1])) for r in rows), key=str)
    assert bpe.with_tokens(docs, PATH).columns == ["doc_id", "text", "n_tokens", "ids"]
    assert bpe.round_trip(docs.limit(0), PATH).collect() == []
