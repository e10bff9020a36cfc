"""Quality rules by line labelling.

A linear-chain conditional random field marks each line of a text as content or
boilerplate (Viterbi decoding); a document stays when enough of its words stand in
content lines and the base rules pass. The field is trained here on the lines of
labelled documents, every line taking its document's label.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from failcast.llm.words import BLOCK_BYTES, find_words, mix, return_memory, text_bytes, windows

#: Bounds of the training sample: labelled documents, and lines of each of them.
TRAIN_DOCUMENTS = 3000
TRAIN_LINES = 200

#: Base rules: fewer words, or a larger percentage of words in repeated three-word windows, fail.
LEAST_WORDS, MOST_REPEATS = 50, 50
SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[0x41:0x5B] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[0x30:0x3A] = True
_ENDS = np.zeros(256, dtype=bool)
_ENDS[list(b".!?:;")] = True

#: Features of a line: upper edges of each one's ranges.
RANGES = {
    "words": (1.5, 3.5, 6.5, 12.5, 30.5),
    "bytes_per_word": (2.5, 4, 6, 8, 12),
    "symbols_per_word": (0.05, 0.2, 0.5, 0.9, 1.5),
    "capitals_per_byte": (0.02, 0.1, 0.3, 0.6),
    "digits_per_byte": (0.02, 0.1, 0.3),
    "repeated_share": (0.05, 0.2, 0.5, 0.8),
    "ends_sentence": (0.5,),
    "earlier_line": (0.5,),
}
_WIDTH = [len(v) + 1 for v in RANGES.values()]
_BASE = np.concatenate([[0], np.cumsum(_WIDTH)[:-1]])
N_FEATURES = sum(_WIDTH)  # a byte holds each number


@dataclass(frozen=True)
class LineField:
    """Weights of the field; state 1 is content. ``emit``: (features, 2), ``step``: (2, 2), ``begin``: (2,)."""
    emit: np.ndarray
    step: np.ndarray
    begin: np.ndarray

    def decode(self, scores: np.ndarray) -> list[int]:
        """Best states of one text whose lines score ``scores`` (lines, 2)."""
        (s00, s01), (s10, s11) = self.step.tolist()
        rows = scores.tolist()
        a, b = (x + y for x, y in zip(rows[0], self.begin.tolist()))
        back = []
        for x, y in rows[1:]:
            a0, a1, b0, b1 = a + s00, b + s10, a + s01, b + s11
            back.append((a1 > a0, b1 >= b0))
            a, b = (a1 if a1 > a0 else a0) + x, (b1 if b1 >= b0 else b0) + y
        states = [int(b >= a)]
        for step in reversed(back):
            states.append(int(step[states[-1]]))
        return states[::-1]


@dataclass
class Lines:
    """The lines that hold a word, of a block of texts, and the base counts of each text."""
    row: np.ndarray       # text of each line
    n_words: np.ndarray   # words of each line
    features: np.ndarray  # (lines, len(RANGES)) feature numbers
    base: dict[str, np.ndarray]


def read_lines(data: np.ndarray, offsets: np.ndarray) -> Lines:
    n_rows = len(offsets) - 1
    w = find_words(data, offsets)
    breaks = np.flatnonzero(data == 0x0A) + 1
    starts = np.union1d(offsets[:-1], breaks[breaks < len(data)]) if len(data) else np.zeros(0, np.int64)
    line_of = np.searchsorted(starts, w.start, "right") - 1  # of each word
    used, line = np.unique(line_of, return_inverse=True)
    n = len(used)
    row = w.row[np.searchsorted(line_of, used)] if n else np.zeros(0, np.int64)
    begin, stop = starts[used], np.append(starts, len(data))[used + 1]

    keys, at = windows(w.hashes(), w.first, 3)
    keys = mix(keys ^ mix(w.row[at].astype(np.uint64)))
    _, place, times = np.unique(keys, return_inverse=True, return_counts=True)
    again = at[times[place] > 1]
    repeated = np.zeros(len(w.start), dtype=bool)
    for j in range(3):
        repeated[again + j] = True

    raw, earlier, seen, last = data.tobytes(), np.zeros(n, dtype=bool), set(), -1
    for i, (r, a, b) in enumerate(zip(row.tolist(), begin.tolist(), stop.tolist())):
        if r != last:
            seen, last = set(), r
        text = raw[a:b - 1] if raw[b - 1:b] == b"\n" else raw[a:b]
        if text in seen:
            earlier[i] = True
        seen.add(text)

    inside = lambda kind: np.add.reduceat(np.append(kind[data], False).astype(np.int32), w.start) if len(w.start) else np.zeros(0, np.int32)
    # counts between one word's first byte and the next one's: what lies between words is of no counted kind
    per_line = lambda x: np.bincount(line, weights=x, minlength=n)
    size, symbols = w.end - w.start, inside(_SYMBOL)
    words, length = per_line(np.ones(len(line))), per_line(size)
    ends = _ENDS[data[w.end - 1]][np.searchsorted(line_of, used, "right") - 1] if n else np.zeros(0, bool)
    values = [words, length / np.maximum(words, 1), per_line(symbols) / np.maximum(words, 1),
              per_line(inside(_UPPER)) / np.maximum(length, 1), per_line(inside(_DIGIT)) / np.maximum(length, 1),
              per_line(repeated) / np.maximum(words, 1), ends, earlier]
    features = np.stack([base + np.searchsorted(edges, v) for base, edges, v in zip(_BASE, RANGES.values(), values)], axis=1)

    per_row = lambda rows, x=None: np.bincount(rows, weights=x, minlength=n_rows).astype(np.int64)
    follows = np.zeros(256, dtype=bool)
    follows[0x80:0xC0] = True  # continuation bytes are no code points of their own
    base = {"n_words": w.counts.astype(np.int64), "word_chars": per_row(w.row, size - inside(follows)),
            "n_symbols": per_row(w.row, symbols), "n_dup_lines": per_row(row, earlier),
            "n_repeat_words": per_row(w.row, repeated)}
    return Lines(row, words.astype(np.int64), features, base)


def _blocks(column: pa.Array):
    return_memory()
    data, offsets = text_bytes(column)
    at, rows = 0, len(column)
    while at < rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, "right")) - 1)
        yield to - at, data[offsets[at]: offsets[to]], offsets[at: to + 1] - offsets[at]
        at = to


def line_features(text: Column, most: int = TRAIN_LINES) -> Column:
    """Feature numbers of the first ``most`` lines that hold a word, flat, a byte each, for training; none for a text
    that the base rules reject anyway."""
    @F.arrow_udf("binary")
    def features(column: pa.Array) -> pa.Array:
        out = []
        for n, data, offsets in _blocks(column):
            lines = read_lines(data, offsets)
            edge = np.searchsorted(lines.row, np.arange(n + 1))
            words, repeats = lines.base["n_words"], lines.base["n_repeat_words"]
            failed = (words < LEAST_WORDS) | (100 * repeats > MOST_REPEATS * words)
            out += [b"" if bad else lines.features[a:min(b, a + most)].astype(np.uint8).tobytes() for a, b, bad in zip(edge, edge[1:], failed)]
        return pa.array(out, pa.binary())

    return features(text)


def train(features: list[list[int]], labels: list[int], steps: int = 150, rate: float = 0.1, ridge: float = 1e-2) -> LineField:
    """Maximum-likelihood weights (Adam on the exact gradient by forward-backward over padded sequences).

    Sequences without lines teach nothing; with no sequence or one class only, every line is content. Feature numbers
    take a byte each and scores are made a line at a time, for this runs in the driver's memory.
    """
    kept = [(np.array(f).reshape(-1, len(RANGES)), y) for f, y in zip(features, labels) if len(f)]
    if len({y for _, y in kept}) < 2:
        return LineField(np.zeros((N_FEATURES, 2)), np.zeros((2, 2)), np.array([0.0, 1.0]))
    kept.sort(key=lambda x: len(x[0]), reverse=True)
    size = np.array([len(f) for f, _ in kept])
    deep, n = size[0], len(kept)
    x = np.zeros((deep, n, len(RANGES)), dtype=np.uint8)
    for i, (f, _) in enumerate(kept):
        x[: len(f), i] = f
    y = np.array([t for _, t in kept])
    live = [int((size > t).sum()) for t in range(deep)]  # sequences reaching line t come first
    share = 0.5 / np.bincount(y, minlength=2)[y]  # both classes weigh the same
    theta = [np.zeros((N_FEATURES, 2)), np.zeros((2, 2)), np.zeros(2)]
    first, second = [np.zeros_like(p) for p in theta], [np.zeros_like(p) for p in theta]
    score, ahead, behind = (np.zeros((deep, n, 2)) for _ in range(3))  # behind stays 0 at every sequence's end
    for step in range(1, steps + 1):
        emit, move, begin = theta
        for t in range(deep):
            score[t] = emit[x[t]].sum(axis=1)
        ahead[0] = score[0] + begin
        for t in range(1, deep):
            k = live[t]
            ahead[t, :k] = score[t, :k] + np.logaddexp(ahead[t - 1, :k, :1] + move[0], ahead[t - 1, :k, 1:] + move[1])
        for t in range(deep - 2, -1, -1):
            k = live[t + 1]
            nxt = score[t + 1, :k] + behind[t + 1, :k]
            behind[t, :k] = np.logaddexp(nxt[:, :1] + move[:, 0], nxt[:, 1:] + move[:, 1])
        whole = np.logaddexp(*ahead[size - 1, np.arange(n)].T)
        grad = [ridge * p for p in theta]
        for t in range(deep):
            k = live[t]
            p = np.exp(ahead[t, :k] + behind[t, :k] - whole[:k, None])
            p[np.arange(k), y[:k]] -= 1
            p *= share[:k, None]
            for j in range(len(RANGES)):
                np.add.at(grad[0], x[t, :k, j], p)
            if t == 0:
                grad[2] += p.sum(axis=0)
            else:
                pair = np.exp(ahead[t - 1, :k, :, None] + move + (score[t, :k] + behind[t, :k])[:, None, :] - whole[:k, None, None])
                pair[np.arange(k), y[:k], y[:k]] -= 1
                grad[1] += (pair * share[:k, None, None]).sum(axis=0)
        for p, g, m, v in zip(theta, grad, first, second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return LineField(*theta)


def fit(documents: DataFrame, labels: DataFrame, most: int = TRAIN_DOCUMENTS) -> LineField:
    """Train on a bounded sample of labelled documents (label column ``quality``, 1 for good).

    The sample holds, of each class, the ``most / 2`` documents whose id hashes lowest, so it does
    not depend on partitions. Labels other than 0 and 1, and null ids, are left out. Only feature
    numbers of at most TRAIN_LINES lines a document come to the driver.
    """
    marked = labels.select("doc_id", "quality").where("doc_id IS NOT NULL AND quality IN (0, 1)").distinct()
    halves = [marked.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most // 2) for q in (0, 1)]
    chosen = halves[0].unionByName(halves[1])
    rows = (documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``most`` rows
            .select("doc_id", "quality", line_features(F.col("text")).alias("f")).collect())
    rows.sort(key=lambda r: (r.doc_id, r.quality, r.f))
    field = train([np.frombuffer(r.f, np.uint8) for r in rows], [r.quality for r in rows])
    del rows
    return_memory(small=True)
    return field


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def marks(text: Column, field: LineField) -> Column:
    """Struct of the base counts, n_lines (with a word), n_content_lines and content_words of a text."""
    names = [*BASE, "n_lines", "n_content_lines", "content_words"]

    @F.arrow_udf(", ".join(f"{c} long" for c in names))
    def judge(column: pa.Array) -> pa.Array:
        out = {c: [] for c in names}
        for n, data, offsets in _blocks(column):
            lines = read_lines(data, offsets)
            scores = field.emit[lines.features].sum(axis=1)
            edge = np.searchsorted(lines.row, np.arange(n + 1)).tolist()
            content = np.array(list(chain.from_iterable(
                field.decode(scores[a:b]) for a, b in zip(edge, edge[1:]) if b > a)), dtype=np.int64)
            for c in BASE:
                out[c].append(lines.base[c])
            out["n_lines"].append(np.diff(edge))
            out["n_content_lines"].append(np.bincount(lines.row, weights=content, minlength=n).astype(np.int64))
            out["content_words"].append(np.bincount(lines.row, weights=content * lines.n_words, minlength=n).astype(np.int64))
        arrays = [pa.array(np.concatenate(out[c]) if out[c] else np.zeros(0, np.int64), pa.int64()) for c in names]
        return pa.StructArray.from_arrays(arrays, names)

    return judge(text)


def with_quality(documents: DataFrame, field: LineField, text: str = "text", least_share: float = 0.5,
                 into: str = "quality_marks") -> DataFrame:
    """``documents`` and one struct column ``into``: counts, content_share, base_failed and kept.

    A null or empty text has no words: its counts are 0, its share is 0 and it fails the base rules.
    Every row is judged by its own text alone, repeated rows alike.
    """
    m = F.col(into)
    words, repeats = m["n_words"], m["n_repeat_words"]
    share = F.when(words > 0, m["content_words"] / words).otherwise(F.lit(0.0))
    failed = (words < LEAST_WORDS) | (100 * repeats > MOST_REPEATS * words)
    return (documents.withColumn(into, marks(F.col(text), field))
            .withColumn(into, m.withField("content_share", share).withField("base_failed", failed)
                        .withField("kept", ~failed & (share >= least_share))))


def judged(documents: DataFrame, field: LineField) -> DataFrame:
    """Per document: doc_id, the base counts, base_failed, kept, and what the field found."""
    m = F.col("quality_marks")
    made = with_quality(documents.select("doc_id", "text"), field)
    return made.select("doc_id", *[m[c].alias(c) for c in (*BASE, "base_failed", "kept", "n_lines", "n_content_lines", "content_share")])


def keep_good(documents: DataFrame, field: LineField) -> DataFrame:
    """The documents whose verdict is to stay, with their own columns."""
    return with_quality(documents, field, into="__quality").where("__quality.kept").select(*[F.col(f"`{c}`") for c in documents.columns])
