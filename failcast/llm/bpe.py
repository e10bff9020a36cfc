"""BPE encoding and decoding by forced-boundary splitting.

Two neighbouring bytes that never stand side by side inside any vocabulary token
mark a certain cut: no merge can join them. Texts are cut there, each distinct
fragment is encoded once by the tokenizers library, and the ids are concatenated.

A cut must also leave the pre-tokenizer's choices alone. Its pattern looks at the
character after a run of white space and starts contractions at an apostrophe, and
never looks back, so cuts stand only behind a byte that ends no white space and
never before an apostrophe or inside a character. Strings of added tokens stay whole.
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from failcast.llm.words import BLOCK_BYTES, text_bytes

#: Fragments whose ids a Python worker remembers; it starts afresh beyond that.
CACHED_FRAGMENTS = 300_000


@lru_cache(maxsize=1)
def _byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, others for U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Fragments:
    """Encoder and decoder of one byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec["pre_tokenizer"] or {}
        if (spec["model"]["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space")
                or spec["normalizer"] or spec.get("post_processor") or spec["model"].get("dropout")):
            raise ValueError(f"{path}: only byte-level BPE without normalizer, prefix space or dropout is cut safely")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: added tokens that depend on their neighbours are not supported")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.added = [t["content"].encode() for t in spec["added_tokens"]]
        chars, vocab = _byte_of_char(), spec["model"]["vocab"]
        self.token_bytes = {i: bytes(chars[c] for c in t) for t, i in vocab.items()}
        inside = np.zeros((256, 256), dtype=bool)
        for token in self.token_bytes.values():
            b = np.frombuffer(token, np.uint8)
            inside[b[:-1], b[1:]] = True
        self.token_bytes |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        spelled = [self.token_bytes.get(i, b"") for i in range(max(self.token_bytes) + 1)]
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.lengths = np.array([len(x) for x in spelled])
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.char_of = {b: c for c, b in chars.items()}
        self.cut = ~inside
        self.cut[: 0x21] = self.cut[0x7F] = False  # white space and control bytes
        for last in (*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF):  # last bytes of other white space
            self.cut[last] = False
        self.cut[:, 0x27] = False
        self.cut[:, 0x80:0xC0] = False  # inside a character
        self.known: dict[bytes, bytes] = {}

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Places where fragments begin and end, the ends of each text included."""
        n = len(data)
        at = np.zeros(n + 1, dtype=bool)
        if n > 1:
            at[1:n] = self.cut[data[:-1], data[1:]]
        if self.added:
            raw = data.tobytes()
            for token in self.added:
                place = raw.find(token)
                while place >= 0:
                    if np.searchsorted(offsets, place, "right") == np.searchsorted(offsets, place + len(token), "left"):
                        at[place + 1: place + len(token)] = False
                        at[[place, place + len(token)]] = True
                    place = raw.find(token, place + len(token))
        at[offsets] = True
        return np.flatnonzero(at)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        places = self.cuts(data, offsets)
        raw, known, ends = data.tobytes(), self.known, places.tolist()
        pieces = [raw[a:b] for a, b in zip(ends, ends[1:])]
        new = [p for p in set(pieces) if p not in known]
        if len(known) + len(new) > CACHED_FRAGMENTS:
            known.clear()
            new = list(set(pieces))
        for piece in new:
            known[piece] = array("I", self.ids_of(piece)).tobytes()
        ids = [known[p] for p in pieces]
        edge = np.searchsorted(places, offsets).tolist()
        return [b"".join(ids[a:b]) for a, b in zip(edge, edge[1:])]

    def ids_of(self, piece: bytes) -> list[int]:
        """Ids of one fragment by the library: by its BPE model alone where the fragment is plainly one
        pre-token (at most one space, then Latin letters), else by the whole tokenizer."""
        text = piece.decode()
        word = text[1:] if text[:1] == " " else text
        if word.isalpha() and max(word) < "\u0250":
            return [t.id for t in self.library.model.tokenize(piece.decode("latin-1").translate(self.char_of))]
        return self.library.encode(text, add_special_tokens=False).ids

    def decode(self, ids: bytes) -> str:
        """All tokens' bytes at once, gathered from the vocabulary's."""
        which = np.frombuffer(ids, "<u4")
        which = which[which < len(self.lengths)]
        length = self.lengths[which]
        ends = np.cumsum(length)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begins[which] - ends + length, length)
        return self.spelled[at].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _fragments(path: str) -> Fragments:
    return Fragments(path)


def encoded(text: Column, path: str) -> Column:
    """Ids of a string column as binary (little-endian unsigned 32-bit integers), null counting as empty.

    Equal to ``Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids``.
    """
    @F.arrow_udf("binary")
    def encode(column: pa.Array) -> pa.Array:
        made, out = _fragments(path), []
        data, offsets = text_bytes(column)
        at, rows = 0, len(column)
        while at < rows:  # blocks of bounded size; a longer text has a block of its own
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, "right")) - 1)
            out += made.encode(data[offsets[at]: offsets[to]], offsets[at: to + 1] - offsets[at])
            at = to
        return pa.array(out, pa.binary())

    return encode(text)


def decoded(ids: Column, path: str) -> Column:
    """Text of a binary column of ids; ids that are not in the vocabulary are left out, null counts as empty.

    Equal to ``Tokenizer.from_file(path).decode(ids, skip_special_tokens=False)``.
    """
    @F.arrow_udf("string")
    def decode(column: pa.Array) -> pa.Array:
        made = _fragments(path)
        return pa.array([made.decode(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in column], pa.string())

    return decode(ids)


def with_tokens(df: DataFrame, path: str, text: str = "text", ids: str = "ids", n_tokens: str = "n_tokens") -> DataFrame:
    """``df`` with each text's ids and their number; columns of these names are replaced.

    Null and empty texts have no ids. Every row is kept, repeated rows included.
    """
    return df.withColumn(ids, encoded(F.col(text), path)).withColumn(n_tokens, F.expr(f"octet_length(`{ids}`) div 4"))


def with_decoded(df: DataFrame, path: str, ids: str = "ids", decoded_text: str = "decoded") -> DataFrame:
    """``df`` with the text that its ids stand for; a column of that name is replaced."""
    return df.withColumn(decoded_text, decoded(F.col(ids), path))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 and decoded_sha256 of its whole text."""
    made = with_decoded(with_tokens(docs.select("doc_id", "text"), path), path)
    return made.select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
