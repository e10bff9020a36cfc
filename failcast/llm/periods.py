"""Periodic runs of words, by a dictionary of basic factors.

For each power of two m, every stretch of m words of a text (a basic factor) gets a number,
made from the numbers of its two halves. A run of smallest period q that is at least three
periods long repeats its factors of length m, m the least power of two not below q: the
next occurrence of such a factor stands exactly q words on (a nearer one would make a
smaller period). So successors within m words, that is well within twice that length, form
the arithmetic progressions of a run; neighbouring starts with one distance propose its
period. Proposals are extended to both sides by comparing words, and deduplicated.

A factor is carried on to the next power only where both its halves occur again in the
text, so plain prose costs little more than the numbering of its words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from failcast.llm.words import BLOCK_BYTES, Words, find_words, text_bytes, word_bytes

#: A run has this many words and this many periods at least.
LEAST_WORDS, LEAST_PERIODS = 24, 3

RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def word_numbers(w: Words) -> np.ndarray:
    """Equal words of a block have equal numbers, different words different ones."""
    return word_bytes(w).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def proposals(numbers: np.ndarray, row: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of stretches that may belong to a run, ascending by period then start.

    ``numbers``: the words of all texts behind one another, ``row``: text of each, ``counts``: words of each text.
    """
    starts, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    # factors of the present length: where they begin, and their numbers; a number belongs to one text
    at = np.flatnonzero((counts >= LEAST_WORDS)[row])
    key = row[at] * (numbers.max(initial=0) + 1) + numbers[at]
    m = 1
    while len(at):
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        away = np.zeros(len(at), np.int64)  # distance to the successor, 0 for none
        away[order[:-1][same]] = at[order[1:][same]] - at[order[:-1][same]]
        # neighbouring starts with one distance
        near = np.flatnonzero((away > m // 2) & (away <= m))
        if len(near):
            begins = np.flatnonzero(np.append(True, (np.diff(at[near]) != 1) | (np.diff(away[near]) != 0)))
            length = np.diff(np.append(begins, len(near)))
            first, q = at[near[begins]], away[near[begins]]
            # a run's stretch of starts is as long as the run without a period and a factor
            enough = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q) - q - m + 1
            starts.append(first[enough])
            periods.append(q[enough])
        # the next power: both halves occur again
        again = np.zeros(len(at), bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        number = np.empty(len(at), np.int64)
        number[order] = np.cumsum(np.append(False, ~same))
        at, number = at[again], number[again]
        half = np.searchsorted(at, at + m)
        there = half < len(at)
        there[there] = at[half[there]] == at[there] + m
        there &= row[at] == row[np.minimum(at + m, len(row) - 1)]
        there &= LEAST_PERIODS * (m + 1) <= counts[row[at]]  # a period above m must fit
        key = number[there] * (number.max(initial=0) + 1) + number[half[there]]
        at, m = at[there], 2 * m
    starts, periods = np.concatenate(starts), np.concatenate(periods)
    order = np.lexsort((starts, periods))
    return starts[order], periods[order]


def _agree(numbers: np.ndarray, a: int, q: int, low: int, high: int, step: int) -> int:
    """How many places from ``a`` on (to the right or left) hold the number that stands q places on; low <= a, a + q < high."""
    done, size = 0, 32
    while True:
        if step > 0:
            stop = min(a + done + size, high - q)
            part = slice(a + done, max(stop, a + done))
            equal = numbers[part] == numbers[part.start + q: part.stop + q]
        else:
            begin = max(a - done - size + 1, low)
            part = slice(begin, max(a - done + 1, begin))
            equal = (numbers[part] == numbers[part.start + q: part.stop + q])[::-1]
        if not len(equal):
            return done
        miss = np.flatnonzero(~equal)
        if len(miss):
            return done + int(miss[0])
        done, size = done + len(equal), 2 * size


def runs_of(numbers: np.ndarray, row: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(text, start, length, period) of every run, by text, then start, then period; starts count in the text."""
    out, last_q, last_end = [], 0, -1
    for a, q in zip(*(x.tolist() for x in proposals(numbers, row, np.diff(first)))):
        if q == last_q and a + q < last_end:
            continue  # inside the run found before
        low, high = int(first[row[a]]), int(first[row[a] + 1])
        begin = a - _agree(numbers, a - 1, q, low, high, -1)
        end = a + _agree(numbers, a, q, low, high, 1) + q
        if end - begin >= max(LEAST_WORDS, LEAST_PERIODS * q):
            out.append((int(row[a]), begin - low, end - begin, q))
            last_q, last_end = q, end
    return sorted(out)


def _block(data: np.ndarray, offsets: np.ndarray) -> list[tuple]:
    """(n_words, runs, collapsed) of each text."""
    w = find_words(data, offsets)
    runs = runs_of(word_numbers(w), w.row, w.first)
    lost = np.zeros(len(w.start) + 1, np.int64)
    own: list[list] = [[] for _ in range(len(offsets) - 1)]
    for r, start, length, q in runs:
        own[r].append({"start": start, "length": length, "period": q})
        lost[w.first[r] + start + q] += 1
        lost[w.first[r] + start + length] -= 1
    kept = np.cumsum(lost[:-1]) == 0
    size = (w.end - w.start)[kept]
    # kept words with a space behind each; the last one's is cut off
    ends = np.cumsum(size + 1)
    body = np.full(ends[-1] if len(ends) else 0, 0x20, np.uint8)
    at = np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)
    source = np.arange(int(size.sum())) + np.repeat(w.start[kept] - (np.cumsum(size) - size), size)
    body[at] = data[source]
    raw = body.tobytes()
    edges = np.append(0, ends)[np.append(0, np.cumsum(kept))[w.first]].tolist()
    texts = [raw[a:max(a, b - 1)].decode() for a, b in zip(edges, edges[1:])]
    return list(zip(w.counts.tolist(), own, texts))


@F.arrow_udf(RESULT)
def _found(column: pa.Array) -> pa.Array:
    data, offsets = text_bytes(column)
    out, at = [], 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, "right")) - 1)
        out += _block(data[offsets[at]: offsets[to]], offsets[at: to + 1] - offsets[at])
        at = to
    n, runs, texts = zip(*out) if out else ((), (), ())
    return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(runs, pa.list_(_RUN)), pa.array(texts, pa.string())], ["n_words", "runs", "collapsed"])


def with_runs(df: DataFrame, text: str = "text", runs: str = "runs", collapsed: str = "collapsed", n_words: str = "n_words") -> DataFrame:
    """``df`` with each text's number of words, its periodic runs and its text without their repeats.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. A run (start, length, period) is a stretch of words with
    smallest period ``period``, of at least 24 words and three periods, that no neighbouring word extends; runs
    stand by start, then period. collapsed: the words, joined by one space, without those that any run
    holds behind its first period. Null and empty texts have no words, no runs and an empty text. Columns of
    these names are replaced; every row is kept, repeated rows included.
    """
    found = df.withColumn("__found", _found(F.col(f"`{text}`")))
    made = {n_words: F.col("__found.n_words"), runs: F.col("__found.runs"), collapsed: F.col("__found.collapsed")}
    return found.withColumns(made).drop("__found")


def longest_by_period(runs: Column) -> Column:
    """The run with the greatest exact length / period (ties: smallest start, then period); null for none."""
    def better(a, b):  # is b better than a; runs stand by start, then period, so ties keep a
        return b["length"] * a["period"] > a["length"] * b["period"]
    return F.when(F.size(runs) > 0, F.aggregate(runs, F.get(runs, F.lit(0)), lambda a, b: F.when(better(a, b), b).otherwise(a)))


@F.arrow_udf(T.StringType())
def _repeating(h: pa.Array, text: pa.Array) -> pa.Array:
    out = []
    for x, t in zip(h.to_pylist(), text):
        whole = pa.array([t.as_py() if t.is_valid else ""])
        if x is None or x % 10:
            out.append(whole[0].as_py())
            continue
        words, g = find_words(*text_bytes(whole)).texts(), x // 10
        n = len(words)
        a, p = (g % n, 1 + (n - g % n) // (3 + g % 8)) if n else (0, 1)
        part = words[a:a + p]
        out.append(b" ".join(words[:a] + (part * (-(-(n - a) // p)))[:n - a]).decode())
    return pa.array(out, pa.string())


def planted(doc_id: Column, text: Column) -> Column:
    """The text of op11's contract: one document in ten (h % 10 = 0, h the crc32 of its id in decimals) repeats a stretch
    of its own words to its end. A document without id stays as it is; null counts as empty."""
    return _repeating(F.crc32(doc_id.cast("string").cast("binary")), text)


def digests(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_runs, the run with most periods, and digests of all runs and of the collapsed text."""
    made = with_runs(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")))
    best = longest_by_period(F.col("runs"))
    lines = F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"]))
    made = made.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
                       F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
                       F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), F.col("best.period")
    return made.select("doc_id", "n_runs", F.col("best.start").alias("start"), length.alias("length"), period.alias("period"),
                       F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
