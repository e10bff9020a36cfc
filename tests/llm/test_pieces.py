import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from failcast.llm import pieces
from failcast.llm.words import text_bytes
from tests.conftest import SF001

P = pytest.importorskip("public_tokenizers")
PATH = P.path("piece_bpe_32k.model")
HARD = ["", " ", "a", "  ", "the  quick   brown\n\n\tfox ", "▁", "x▁y ▁", "<s> </s><unk><0x41>", "a\x00b", " " * 37, "a" + " " * 100 + "b",
        "日本語テキスト123", "a" * 3000, "abcabcabc" * 50, "é è　  z\u0085k", "🎉🎉'S don’t 👩‍👩‍👧", "�͸ x", "internationalization" * 20,
        "0123456789" * 30, "ңңң梦 梦", "\r\n \r\n", "ACGT" * 40 + "TTGACA" * 33, "hello" + "▁" * 5 + "world"]


@pytest.fixture(scope="module")
def library():
    return processor()


def processor():
    from sentencepiece import SentencePieceProcessor
    return SentencePieceProcessor(model_file=PATH)


def ids_of(texts, made=None):
    ids, edges = (made or pieces._pieces(PATH)).encode(*text_bytes(pa.array(texts, pa.string())))
    return [ids[a:b].tolist() for a, b in zip(edges, edges[1:])]


def text_of(lists):
    edges = np.cumsum([0, *(len(x) for x in lists)])
    return pieces._pieces(PATH).decode(np.array([i for x in lists for i in x], np.int64), edges)


def test_hard_texts(library):
    for texts in (HARD, *[[t] for t in HARD]):
        want = library.encode(texts, add_bos=True, add_eos=True)
        assert ids_of(texts) == want
        assert text_of(want) == library.decode(want)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab  ▁\n!1é日’tlhe<sx>rinongэто"), max_size=60), max_size=4))
def test_any_text(texts):
    lib = test_any_text.__dict__.setdefault("lib", processor())
    want = [lib.encode(t, add_bos=True, add_eos=True) for t in texts]
    assert ids_of(texts) == want
    assert text_of(want) == [lib.decode(x) for x in want]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.sampled_from([28705, 28756, 260, 1, 2, 0, 31999]), st.integers(0xC0, 0xFF)), max_size=12))
def test_any_ids(ids):
    lib = test_any_ids.__dict__.setdefault("lib", processor())
    assert text_of([ids, ids]) == [lib.decode(ids)] * 2


def test_a_control_id_parts_byte_pieces(library):
    for ids in ([228, 1, 131, 131], [228, 1, 2, 131, 131, 2], [1, 228, 131, 131, 2], [228, 131, 1], [1, 131, 228]):
        assert text_of([ids, [1, 228], ids]) == [library.decode(x) for x in (ids, [1, 228], ids)]


def test_long_words(library):
    """Letters without spaces, where merges in a row make better pairs than the one at hand."""
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("etaoinshrdlu"), 3000)), "".join(rng.choice(list("THEINGandtio"), 3000)), "".join(rng.choice(list("がのをはに日本人"), 3000))]
    assert ids_of(words) == library.encode(words, add_bos=True, add_eos=True)


def test_cache_restart(monkeypatch, library):
    monkeypatch.setattr(pieces, "CACHED_WORDS", 5)
    made = pieces.Pieces(PATH)
    for t in HARD:
        assert ids_of([t], made) == [library.encode(t, add_bos=True, add_eos=True)]


def test_unknown_ids_are_left_out():
    assert text_of([[1, -5, 28705 + 1, 99_999, 2]]) == text_of([[1, 28706, 2]])


def expected(lib, text):
    ids = lib.encode(text or "", add_bos=True, add_eos=True)
    return (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())


def test_documents(spark, library):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    want = {r.doc_id: expected(library, r.text) for r in docs.collect()}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.round_trip(docs, PATH).collect()} == want


def test_edge_rows(spark, library):
    rows = [(None, None, 1, "i"), (1, None, 2, "i"), (2, "", 3, "i"), (3, "same 's", 4, "i"), (3, "same 's", 4, "i"), (4, "w " * 60000, 5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids string")
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.round_trip(docs, PATH).collect()), key=str)
    assert got == sorted(((r[0], *expected(library, r[1])) for r in rows), key=str)
    assert pieces.with_pieces(docs, PATH).columns == ["doc_id", "text", "n_tokens", "ids"]
    assert pieces.round_trip(docs.limit(0), PATH).collect() == []
