"""SentencePiece (BPE) encoding and decoding by vectorised merge rounds.

Texts are cut into words where two neighbouring bytes never stand side by side inside
any piece, so that no merge crosses a cut; each distinct word of a block is merged once.
All words merge together, in flat numpy arrays of symbols: a round finds each word's
best pair (a segmented minimum of ranks), merges its places from the left, and compacts
the arrays, until no pair remains.

A round merges several places of one word only while that is what merging one place at
a time would do: it stops behind a merge that makes a better pair than the one at hand.
Pieces that share a score (runs of spaces, the worst score of all) are merged last, one
after the other from the left, because there the leftmost place decides.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from failcast.llm.words import text_bytes

#: Texts are worked on in blocks of about this many bytes; a longer text has a block of its own.
BLOCK_BYTES = 1 << 20
#: Words and ids that a Python worker remembers; it starts afresh beyond that.
CACHED_WORDS, CACHED_IDS = 300_000, 2_000_000

SPACE = "▁"  # stands for a space inside pieces
_NONE = np.iinfo(np.int32).max


def _gather(lengths: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Indices of the concatenation of ranges ``begins[i] .. begins[i] + lengths[i]``."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - ends + lengths, lengths)


class Pieces:
    """Encoder and decoder of one SentencePiece BPE model with byte fallback.

    Refused with ValueError: a model that changes characters, removes spaces, adds no space in front, has
    unused or user-defined pieces or no byte pieces, or shares a score between pieces other than the worst ones.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        probe = "".join(chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000) + "  a  "
        if sp.normalize(probe) != SPACE + probe.replace(" ", SPACE):
            raise ValueError(f"{path}: only models that keep every character and put one space in front are supported")
        special = [i for i in range(n) if sp.is_control(i) or sp.is_unknown(i)]
        byte = [i for i in range(n) if sp.is_byte(i)]
        if len(byte) != 256 or any(sp.is_unused(i) for i in range(n)):
            raise ValueError(f"{path}: only models with byte fallback and without unused pieces are supported")
        self.bos, self.eos, self.unknown = sp.bos_id(), sp.eos_id(), sp.unk_id()
        self.byte_ids = np.zeros(256, np.int32)
        for i in byte:
            self.byte_ids[int(sp.id_to_piece(i)[3:5], 16)] = i
        self.pieces = {sp.id_to_piece(i): i for i in range(n) if i not in {*special, *byte}}
        score = {i: sp.get_score(i) for i in self.pieces.values()}

        # symbols: piece ids, then characters that only stand inside pieces, then one for all other characters
        inner = sorted({c for p in self.pieces for c in p} - set(self.pieces))
        symbols = self.pieces | {c: n + i for i, c in enumerate(inner)}
        self.foreign = n + len(inner)
        self.width = self.foreign + 1
        self.symbol_of = np.full(0x110000, self.foreign, np.int32)
        for c, i in symbols.items():
            if len(c) == 1:
                self.symbol_of[ord(c)] = i
        self.symbol_of[0x20] = self.symbol_of[ord(SPACE)]

        counts: dict[float, int] = {}
        for p, i in self.pieces.items():
            if len(p) > 1:
                counts[score[i]] = counts.get(score[i], 0) + 1
        order = sorted(counts, reverse=True)
        shared = [s for s in order if counts[s] > 1]
        if shared not in ([], order[-1:]):
            raise ValueError(f"{path}: pieces that share a score must be the worst ones")
        tied = {p for p, i in self.pieces.items() if len(p) > 1 and score[i] in shared}
        rank = {s: r for r, s in enumerate(order)}
        keys, made, ranks, self.tied = [], [], [], {}
        for p, i in self.pieces.items():
            for cut in range(1, len(p)):
                a, b = symbols.get(p[:cut]), symbols.get(p[cut:])
                if a is None or b is None:
                    continue
                if p in tied:
                    self.tied[(a, b)] = i
                    continue
                if p[:cut] in tied or p[cut:] in tied:
                    raise ValueError(f"{path}: {p!r} is made of a piece that shares its score")
                keys.append(a * self.width + b)
                made.append(i)
                ranks.append(rank[score[i]])
        place = np.argsort(np.array(keys, np.int64))
        self.keys = np.append(np.array(keys, np.int64)[place], np.iinfo(np.int64).max)
        self.made = np.append(np.array(made, np.int32)[place], 0)
        self.ranks = np.append(np.array(ranks, np.int32)[place], _NONE)
        self.tied_parts = np.zeros(self.width, bool)
        for a, b in self.tied:
            self.tied_parts[[a, b]] = True

        # cuts: bytes and characters that stand side by side in no piece
        inside = np.zeros((256, 256), bool)
        couples = {(ord(a) << 21) | ord(b) for p in self.pieces for a, b in zip(p, p[1:])}
        self.couples = np.append(np.array(sorted(couples), np.int64), np.iinfo(np.int64).max)
        for p in self.pieces:
            b = np.frombuffer(p.replace(SPACE, " ").encode(), np.uint8)
            inside[b[:-1], b[1:]] = True
        self.cut = ~inside
        self.cut[:, 0x80:0xC0] = False  # inside a character

        # decoding: the bytes that each id stands for
        spelled = [b""] * n
        for p, i in self.pieces.items():
            spelled[i] = p.replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte_ids.tolist()):
            spelled[i] = bytes([b])
        spelled[self.unknown] = sp.decode([self.unknown]).encode()
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.lengths = np.array([len(x) for x in spelled])
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.is_byte = np.zeros(n, bool)
        self.is_byte[byte] = True
        self.silent = np.zeros(n, bool)
        self.silent[[i for i in special if i != self.unknown]] = True
        self.spaced = np.zeros(n, bool)
        self.spaced[[i for p, i in self.pieces.items() if p.startswith(SPACE)]] = True
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.edges = np.zeros(0, np.int32), np.zeros(1, np.int64)  # of all known words

    def look_up(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Place of each pair in the tables of merges; the last place stands for none."""
        key = a.astype(np.int64) * self.width + b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, at, len(self.keys) - 1)

    def merged(self, symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of words after all merges, and each word's place; word i is ``symbols[first[i]: first[i + 1]]``,
        none empty."""
        word = np.repeat(np.arange(len(first) - 1), np.diff(first))
        done_symbols, done_words = [], []
        sym = symbols.astype(np.int32)
        pair = self._pairs(sym, word)
        while len(sym):
            rank = self.ranks[pair]
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            lengths = np.diff(np.append(starts, len(word)))
            best = np.repeat(np.minimum.reduceat(rank, starts), lengths)
            open_ = best < _NONE
            if not open_.all():  # words without a pair leave
                done_symbols.append(sym[~open_])
                done_words.append(word[~open_])
                sym, word, pair, rank, best = sym[open_], word[open_], pair[open_], rank[open_], best[open_]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == best)
            # of places in a row, every other one from the left
            fresh = np.append(True, (np.diff(hit) != 1))  # a hit's pair never crosses words
            run = np.flatnonzero(fresh)
            hit = hit[(np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))) % 2 == 0]
            hit = self._until_better(hit, sym, word, pair, best)
            sym[hit] = self.made[pair[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            moved = np.cumsum(keep) - 1
            sym, word, pair = sym[keep], word[keep], pair[keep]
            at = moved[hit]
            changed = np.zeros(len(sym), bool)
            changed[at] = changed[np.maximum(at - 1, 0)] = True
            near = np.flatnonzero(changed)
            pair[near] = self._pairs_at(near, sym, word)
        if not done_symbols:
            return np.zeros(0, np.int32), first
        sym, word = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        return self._tie_phase(sym[order], word[order], len(first) - 1)

    def _pairs(self, sym, word):
        pair = np.full(len(sym), len(self.keys) - 1)
        if len(sym) > 1:
            same = np.flatnonzero(word[1:] == word[:-1])
            pair[same] = self.look_up(sym[same], sym[same + 1])
        return pair

    def _pairs_at(self, at, sym, word):
        right = np.minimum(at + 1, len(sym) - 1)
        found = self.look_up(sym[at], sym[right])
        return np.where((at + 1 < len(sym)) & (word[right] == word[at]), found, len(self.keys) - 1)

    def _until_better(self, hit, sym, word, pair, best):
        """Of each word's places, those up to the first whose merge makes a better pair with a neighbour."""
        made, none = self.made[pair[hit]], len(self.keys) - 1
        left, right = np.maximum(hit - 1, 0), np.minimum(hit + 2, len(sym) - 1)
        before = sym[left]
        follows = np.flatnonzero(np.diff(hit) == 2) + 1  # the place in front merges too
        follows = follows[word[hit[follows]] == word[hit[follows - 1]]]
        before[follows] = made[follows - 1]
        with_left = np.where((hit > 0) & (word[left] == word[hit]), self.look_up(before, made), none)
        with_right = np.where((hit + 2 < len(sym)) & (word[right] == word[hit]), self.look_up(made, sym[right]), none)
        better = np.minimum(self.ranks[with_left], self.ranks[with_right]) < best[hit]
        if not better.any():
            return hit
        stops = np.cumsum(better) - better  # stops in front of each place
        starts = np.flatnonzero(np.append(True, word[hit][1:] != word[hit][:-1]))
        at_start = np.repeat(stops[starts], np.diff(np.append(starts, len(hit))))
        return hit[stops == at_start]

    def _tie_phase(self, sym, word, n_words):
        """Merges of the pieces that share the worst score: from the left, a merge at once offered to its neighbours."""
        part = self.tied_parts[sym]
        beside = np.flatnonzero(part[1:] & part[:-1] & (word[1:] == word[:-1])) if self.tied and len(sym) > 1 else ()
        if len(beside):
            out_sym, out_word, at = [], [], 0
            for w in np.unique(word[beside]).tolist():
                a, b = np.searchsorted(word, [w, w + 1])
                stack: list[int] = []
                for s in sym[a:b].tolist():
                    while stack and (stack[-1], s) in self.tied:
                        s = self.tied[(stack.pop(), s)]
                    stack.append(s)
                out_sym += [sym[at:a], np.array(stack, np.int32)]
                out_word += [word[at:a], np.full(len(stack), w)]
                at = b
            sym, word = np.concatenate([*out_sym, sym[at:]]), np.concatenate([*out_word, word[at:]])
        return sym, np.searchsorted(word, np.arange(n_words + 1))

    def ids_of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words (none empty; spaces stand for themselves) and where each word's begin."""
        raw = b"".join(words)
        chars = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32).astype(np.int64)
        leads = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
        edge = np.append(0, np.cumsum(leads))[np.cumsum([0, *map(len, words)])]
        symbols = self.symbol_of[chars]
        shown = np.where(chars == 0x20, ord(SPACE), chars)
        key = (shown[:-1] << 21) | shown[1:]
        apart = self.couples[np.searchsorted(self.couples, key)] != key
        firsts = np.union1d(edge, np.flatnonzero(apart) + 1)
        made, at = self.merged(symbols, firsts)
        # a symbol is its piece's id; a character that is no piece becomes its bytes
        as_bytes = made >= len(self.lengths)
        lengths = np.ones(len(made), np.int64)
        if as_bytes.any():
            spelling = self._spellings(made, chars, as_bytes)
            alone = np.frombuffer(b"".join(spelling), np.uint8)
            lengths[as_bytes] = [len(x) for x in spelling]
        ids = np.empty(int(lengths.sum()), np.int32)
        which = np.repeat(as_bytes, lengths)
        ids[~which] = made[~as_bytes]
        if as_bytes.any():
            ids[which] = self.byte_ids[alone]
        ends = np.append(0, np.cumsum(lengths))[at[np.searchsorted(firsts, edge)]]
        return ids, ends

    def _spellings(self, made, chars, as_bytes):
        """UTF-8 of the characters that stand unmerged for themselves."""
        size = np.ones(len(made), np.int64)  # characters of each symbol
        inner = made < len(self.lengths)
        size[inner] = self.char_counts[made[inner]]
        place = np.cumsum(size) - size
        return [chr(c).encode() for c in chars[place[as_bytes]].tolist()]

    @property
    def char_counts(self) -> np.ndarray:
        if not hasattr(self, "_char_counts"):
            self._char_counts = np.ones(len(self.lengths), np.int64)
            for p, i in self.pieces.items():
                self._char_counts[i] = len(p)
        return self._char_counts

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block of texts, begin and end ids included, and where each text's ids begin."""
        size = np.diff(offsets)
        # one space in front of each text that is not empty
        spaced = np.append(0, np.cumsum(size + (size > 0)))
        body = np.full(spaced[-1], 0x20, np.uint8)
        there = np.ones(len(body), bool)
        there[spaced[:-1][size > 0]] = False
        body[there] = data
        raw = body.tobytes()
        if SPACE.encode() in raw:  # the mark itself reads as a space
            texts = [raw[a:b].replace(SPACE.encode(), b" ") for a, b in zip(spaced.tolist(), spaced[1:].tolist())]
            raw = b"".join(texts)
            body, spaced = np.frombuffer(raw, np.uint8), np.append(0, np.cumsum([len(t) for t in texts]))
        n_texts = len(size)
        edge = np.zeros(n_texts + 1, np.int64)
        flat, lengths = np.zeros(0, np.int32), np.zeros(0, np.int64)
        if len(body):
            at = np.zeros(len(body) + 1, bool)
            at[1:-1] = self.cut[body[:-1], body[1:]]
            at[spaced] = True
            places = np.flatnonzero(at)
            words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(places) - 1, [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(raw)])
            coded = words.dictionary_encode()
            used = self._numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
            begins = self.edges[used]
            lengths = self.edges[used + 1] - begins
            flat = self.ids[_gather(lengths, begins)]
            edge = np.searchsorted(places, spaced)
        total = np.append(0, np.cumsum(lengths))[edge]
        out_edges = total + 2 * np.arange(n_texts + 1)
        out = np.empty(len(flat) + 2 * n_texts, np.int32)
        ends = np.zeros(len(out), bool)
        ends[out_edges[:-1]] = ends[out_edges[1:] - 1] = True
        out[~ends] = flat
        out[out_edges[:-1]], out[out_edges[1:] - 1] = self.bos, self.eos
        return out, out_edges

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        """Number of each word among the known ones, which new words join."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > CACHED_WORDS or len(self.ids) > CACHED_IDS:
            self.forget()
            new = words
        if new:
            ids, edges = self.ids_of(new)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.edges = np.concatenate([self.edges, edges[1:] + len(self.ids)])
            self.ids = np.concatenate([self.ids, ids])
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def decode(self, ids: np.ndarray, edges: np.ndarray) -> list[str]:
        """Texts of a block of ids; ids outside the vocabulary are left out."""
        known = (ids >= 0) & (ids < len(self.lengths))
        edges = np.append(0, np.cumsum(known))[edges]
        ids = ids[known]
        begins, lengths = self.begins[ids], self.lengths[ids]
        # the first piece that is seen loses its space; byte pieces in front keep it
        shown = np.flatnonzero(~self.silent[ids])
        at, stop = np.searchsorted(shown, edges[:-1]), np.searchsorted(shown, edges[1:])
        first = shown[at[at < stop]]
        first = first[self.spaced[ids[first]]]
        begins[first] += 1
        lengths[first] -= 1
        raw = self.spelled[_gather(lengths, begins)].tobytes()
        ends = np.append(0, np.cumsum(lengths))[edges].tolist()
        # an id without text ends a run of byte pieces: what stands on both sides makes no character
        cut = np.flatnonzero((lengths[1:] == 0) & self.is_byte[ids[:-1]]) + 1
        row = np.searchsorted(edges, cut, "right") - 1
        parted = set(row[(cut > edges[row]) & (cut + 1 < edges[row + 1])].tolist())
        out = []
        for k, (a, b) in enumerate(zip(ends, ends[1:])):
            try:
                out.append(raw[a:b].decode() if k not in parted else self._broken(ids[edges[k]: edges[k + 1]], begins[edges[k]: edges[k + 1]], lengths[edges[k]: edges[k + 1]]))
            except UnicodeDecodeError:
                out.append(self._broken(ids[edges[k]: edges[k + 1]], begins[edges[k]: edges[k + 1]], lengths[edges[k]: edges[k + 1]]))
        return out

    def _broken(self, ids, begins, lengths) -> str:
        """Byte pieces that form no characters: every byte that cannot be read is one U+FFFD."""
        out, raw = [], b""
        for i, a, n in zip(ids.tolist(), begins.tolist(), lengths.tolist()):
            here = self.spelled[a:a + n].tobytes()
            if self.is_byte[i]:
                raw += here
                continue
            out += [_read_bytes(raw), here.decode()]
            raw = b""
        return "".join([*out, _read_bytes(raw)])


def _read_bytes(raw: bytes) -> str:
    out, at = [], 0
    while at < len(raw):
        n = next((n for n in (1, 2, 3, 4) if _is_char(raw[at:at + n], n)), 0)
        out.append(raw[at:at + n].decode() if n else "�")
        at += n or 1
    return "".join(out)


def _is_char(raw: bytes, n: int) -> bool:
    try:
        return len(raw) == n and len(raw.decode()) == 1
    except UnicodeDecodeError:
        return False


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def _pieces(path: str) -> Pieces:
    return Pieces(path)


def _blocks(offsets: np.ndarray):
    at, rows = 0, len(offsets) - 1
    while at < rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, "right")) - 1)
        yield at, to
        at = to


def encoded(text: Column, path: str) -> Column:
    """Ids of a string column, begin and end ids included, as binary (little-endian unsigned 32-bit integers).

    Equal to the library's ``encode(text, add_bos=True, add_eos=True)``; null counts as empty.
    """
    @F.arrow_udf("binary")
    def encode(column: pa.Array) -> pa.Array:
        made, out = _pieces(path), []
        data, offsets = text_bytes(column)
        for at, to in _blocks(offsets):
            ids, edges = made.encode(data[offsets[at]: offsets[to]], offsets[at: to + 1] - offsets[at])
            raw, ends = ids.astype("<u4").tobytes(), (4 * edges).tolist()
            out += [raw[a:b] for a, b in zip(ends, ends[1:])]
        return pa.array(out, pa.binary())

    return encode(text)


def decoded(ids: Column, path: str) -> Column:
    """Text of a binary column of ids, equal to the library's ``decode(ids)``.

    Ids that are not in the vocabulary are left out; null counts as empty.
    """
    @F.arrow_udf("string")
    def decode(column: pa.Array) -> pa.Array:
        made, out = _pieces(path), []
        column = column.fill_null(b"").cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
        body = column.buffers()[2]
        data = np.frombuffer(body, np.uint8) if body else np.zeros(0, np.uint8)
        for at, to in _blocks(offsets):
            block = np.frombuffer(data[offsets[at]: offsets[to]].tobytes(), "<u4")
            out += made.decode(block.astype(np.int64), (offsets[at: to + 1] - offsets[at]) // 4)
        return pa.array(out, pa.string())

    return decode(ids)


def with_pieces(df: DataFrame, path: str, text: str = "text", ids: str = "ids", n_tokens: str = "n_tokens") -> DataFrame:
    """``df`` with each text's ids and their number; columns of these names are replaced.

    Null and empty texts have the begin and end ids only. Every row is kept, repeated rows included.
    """
    return df.withColumn(ids, encoded(F.col(text), path)).withColumn(n_tokens, F.expr(f"octet_length(`{ids}`) div 4"))


def with_text(df: DataFrame, path: str, ids: str = "ids", decoded_text: str = "decoded") -> DataFrame:
    """``df`` with the text that its ids stand for; a column of that name is replaced."""
    return df.withColumn(decoded_text, decoded(F.col(ids), path))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 and decoded_sha256 of its whole text."""
    made = with_text(with_pieces(docs.select("doc_id", "text"), path), path)
    return made.select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
