"""Substring dedup by repeated-phrase automata.

Recurring windows of words are confirmed first: every slice of the input sends each of its
distinct windows once, as a 64-bit hash with the smallest document that holds it, to the
hash's bucket, where the smallest document of all, the window's owner, is found. Documents
are dealt into shards, and a shard is told which windows of its documents recur, with their
owners. There, maximal runs of windows owned by smaller documents are passages; they are
compiled into an Aho-Corasick automaton (pyahocorasick), each with the largest owner of its
windows, and every document of the shard is streamed through it. A document loses what the
automaton finds in it of passages whose owner is smaller than itself, whichever document
brought the passage along; nothing else removes a word.

A window that many documents hold is settled inside each slice: the slice's first holder
stands as its owner for later documents of the slice, so only one row a slice goes to the bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from failcast.llm.words import blocks, find_words, windows

#: Windows of a slice, and text bytes that a bucket or a shard should take.
SLICE_WINDOWS, BUCKET_BYTES, SHARD_BYTES = 1_500_000, 12_000_000, 3_000_000

SENT = "bucket int, ids binary, counts binary, keys binary, shards binary"


def _by_document(doc: np.ndarray, keys: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Keys in order of their documents: the documents, how many keys each has, the keys."""
    order = np.argsort(doc, kind="stable")
    ids, counts = np.unique(doc, return_counts=True)
    return ids.astype("<i8").tobytes(), counts.astype("<u4").tobytes(), keys[order].astype("<u8").tobytes()


def _documents(ids: bytes, counts: bytes) -> np.ndarray:
    return np.repeat(np.frombuffer(ids, "<i8"), np.frombuffer(counts, "<u4"))


def _once(shard: np.ndarray, key: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each (shard, key) once, with its smallest owner, in order."""
    order = np.lexsort((owner, key, shard))
    shard, key, owner = shard[order], key[order], owner[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (shard[1:] != shard[:-1])
    return shard[new], key[new], owner[new]


def _send(words: int, buckets: int, shards: int):
    """Per slice and bucket: the slice's distinct windows under their smallest document; and, with the shards that
    they are for, the windows that later documents of the slice hold as well."""
    def rows_of(parts):
        key, doc = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])  # once a document
        key, doc = key[new], doc[new]
        first = np.ones(len(key), dtype=bool)
        first[1:] = key[1:] != key[:-1]
        holder = doc[first][np.cumsum(first) - 1]
        shard, again, owner = _once(shard_of(doc[~first], shards), key[~first], holder[~first])
        out = {c: [] for c in ("bucket", "ids", "counts", "keys", "shards")}
        # what is settled goes by its shard, so a window of many documents fills no bucket
        for k, d, b, to in ((key[first], doc[first], (key[first] >> np.uint64(32)) % np.uint64(buckets), None),
                            (again, owner, shard % buckets, shard)):
            order = np.lexsort((d, b))
            edge = np.searchsorted(b[order], np.arange(buckets + 1))
            for i, (x, y) in enumerate(zip(edge, edge[1:])):
                if y > x:
                    some = order[x:y]
                    ids, counts, keys = _by_document(d[some], k[some])
                    for c, v in zip(out, (i, ids, counts, keys, b"" if to is None else to[some].astype("<u4").tobytes())):
                        out[c].append(v)
        return pa.RecordBatch.from_arrays([pa.array(out["bucket"], pa.int32()), *[pa.array(out[c], pa.binary()) for c in list(out)[1:]]], list(out))

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            for rows, data, offsets in blocks(batch):
                w = find_words(data, offsets)
                key, at = windows(w.hashes(), w.first, words)
                parts.append((key, rows.column("doc_id").to_numpy()[w.row[at]]))
                held += len(key)
                if held > SLICE_WINDOWS:
                    yield rows_of(parts)
                    parts, held = [], 0
        if held:
            yield rows_of(parts)
    return run


def _settle(shards: int):
    """One bucket: for each shard, the windows that recur in its documents, by owner."""
    def run(table: pa.Table) -> pa.Table:
        key, doc, for_shard, for_key, for_owner = [np.zeros(0, "<u8")], [np.zeros(0, "<i8")], [], [], []
        for ids, counts, keys, to in zip(*[table.column(c).to_pylist() for c in ("ids", "counts", "keys", "shards")]):
            if to:
                for_shard.append(np.frombuffer(to, "<u4").astype(np.int64))
            (for_key if to else key).append(np.frombuffer(keys, "<u8")), (for_owner if to else doc).append(_documents(ids, counts))
        k, d = np.concatenate(key), np.concatenate(doc)
        order = np.lexsort((d, k))
        k, d = k[order], d[order]
        first = np.ones(len(k), dtype=bool)
        first[1:] = k[1:] != k[:-1]
        owner = d[first][np.cumsum(first) - 1]  # the smallest document that holds the window
        lost = d > owner
        shard, k, owner = _once(*(np.concatenate(x) for x in ([shard_of(d[lost], shards), *for_shard], [k[lost], *for_key], [owner[lost], *for_owner])))
        edge = np.searchsorted(shard, np.arange(shards + 1))
        rows = [(i, *_by_document(owner[x:y], k[x:y])) for i, (x, y) in enumerate(zip(edge, edge[1:])) if y > x]
        cols = list(zip(*rows)) if rows else [[], [], [], []]
        return pa.table([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=["shard", "ids", "counts", "keys"])
    return run


def shard_of(doc: np.ndarray, shards: int) -> np.ndarray:
    x = doc.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)


def _owners(recurring: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """A shard's recurring windows in order, each with its smallest owner."""
    parts = [(np.frombuffer(k, "<u8"), _documents(i, c)) for i, c, k in zip(*[recurring.column(c).to_pylist() for c in ("ids", "counts", "keys")])]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key, owner = (np.concatenate(x) for x in zip(*parts))
    return _once(np.zeros(len(key), np.int64), key, owner)[1:]


def _passages(doc: np.ndarray, row: np.ndarray, grams: np.ndarray, at: np.ndarray, key: np.ndarray, owner: np.ndarray):
    """(row, first window, last window, owner) of each maximal run of windows that smaller documents own; the owner is
    the largest of its windows'. ``doc``: each row's id."""
    if not len(key) or not len(grams):
        return
    place = np.minimum(np.searchsorted(key, grams), len(key) - 1)
    mine = np.flatnonzero((key[place] == grams) & (owner[place] < doc[row[at]]))
    if not len(mine):
        return
    new = np.ones(len(mine), dtype=bool)
    new[1:] = (np.diff(at[mine]) > 1) | (np.diff(row[at[mine]]) > 0)
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(mine)) - 1
    yield from zip(row[at[mine[begin]]].tolist(), at[mine[begin]].tolist(), at[mine[last]].tolist(),
                   np.maximum.reduceat(owner[place[mine]], begin).tolist())


def _cut(words: int):
    """One shard: the passages of its documents as an automaton, all its documents streamed through it."""
    def run(docs: pa.Table, recurring: pa.Table) -> pa.Table:
        import ahocorasick

        key, owner = _owners(recurring)
        automaton, size, owned_by, texts = ahocorasick.Automaton(ahocorasick.STORE_INTS), [], [], []
        for rows, data, offsets in (x for b in docs.to_batches() for x in blocks(b)):
            w = find_words(data, offsets)
            grams, at = windows(w.hashes(), w.first, words)
            spelled, names, first = w.texts(), rows.column("doc_id"), w.first.tolist()
            # a row without an id loses nothing
            ids = names.fill_null(NOBODY).to_numpy(zero_copy_only=False)
            for _, begin, end, by in _passages(ids, w.row, grams, at, key, owner):
                passage = (b" %s " % b" ".join(spelled[begin: end + words])).decode()
                if automaton.get(passage, -1) < 0:
                    automaton.add_word(passage, len(size))
                    size.append(end + words - begin), owned_by.append(by)
            texts += [(name, spelled[a:b]) for name, a, b in zip(names.to_pylist(), first, first[1:])]
        if size:
            automaton.make_automaton()
        sizes, owners = np.array(size, np.int64), np.array(owned_by, np.int64)
        out = {c: [] for c in ("doc_id", "n_words", "n_removed", "kept", "passages")}
        for name, mine in texts:
            line = (b" %s " % b" ".join(mine)).decode()
            start, stop = _located(automaton, line, name, sizes, owners) if size and name is not None else (NONE, NONE)
            inside = np.cumsum(np.bincount(start, minlength=len(mine) + 1) - np.bincount(stop, minlength=len(mine) + 1))[:-1] > 0
            out["doc_id"].append(name), out["n_words"].append(len(mine)), out["n_removed"].append(int(inside.sum()))
            out["kept"].append(b" ".join([x for x, gone in zip(mine, inside.tolist()) if not gone]).decode() if len(start) else line[1:-1])
            out["passages"].append([{"start": s, "stop": e} for s, e in zip(start.tolist(), stop.tolist())])
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))]
        return pa.table([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))
    return run


#: No document owns a window below this id; an empty list of places.
NOBODY, NONE = -(1 << 63), np.zeros(0, np.int64)


def _located(automaton, line: str, doc: int, size: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops, in words, of the passages of smaller documents found in ``line`` (its words between single
    spaces, one at each end), none inside another."""
    found = np.array(list(automaton.iter(line)), np.int64).reshape(-1, 2)
    found = found[owner[found[:, 1]] < doc]
    if not len(found):
        return NONE, NONE
    gaps = np.flatnonzero(np.frombuffer(line.encode("utf-32-le"), "<u4") == 0x20)  # the space before each word, and the last
    stop = np.searchsorted(gaps, found[:, 0])
    start = stop - size[found[:, 1]]
    order = np.lexsort((-stop, start))
    start, stop = start[order], stop[order]
    outer = np.ones(len(start), dtype=bool)
    outer[1:] = stop[1:] > np.maximum.accumulate(stop)[:-1]
    return start[outer], stop[outer]


def without_repeats(docs: DataFrame, words: int = 13) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept (the words that stay, one space between) and
    passages (start and stop of each located passage, words from 0).

    A window is ``words`` consecutive words (``[^\\x20\\x09-\\x0D]+``, unchanged) of one document. A word goes
    when a window that covers it has its sequence start in a document of a smaller doc_id too; windows
    are judged on the input. Null texts have no words. Rows that share an id count as one document;
    rows without an id lose nothing and take nothing from others. Long texts are taken whole.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, shards = int(total // BUCKET_BYTES) + 1, int(total // SHARD_BYTES) + 1
    sent = docs.where("doc_id IS NOT NULL").mapInArrow(_send(words, buckets, shards), SENT)
    recurring = sent.groupBy("bucket").applyInArrow(_settle(shards), "shard int, ids binary, counts binary, keys binary")

    @F.arrow_udf("int")
    def shard(ids: pa.Array) -> pa.Array:
        return pa.array(shard_of(ids.fill_null(0).to_numpy(zero_copy_only=False), shards), pa.int32())

    dealt = docs.withColumn("shard", F.when(F.col("doc_id").isNotNull(), shard("doc_id")).otherwise(F.pmod(F.xxhash64("text"), F.lit(shards)).cast("int")))
    return dealt.groupBy("shard").cogroup(recurring.groupBy("shard")).applyInArrow(
        _cut(words), "doc_id long, n_words long, n_removed long, kept string, passages array<struct<start:long,stop:long>>")


def removed(docs: DataFrame, words: int = 13) -> DataFrame:
    """Per document: doc_id, n_words, n_removed and kept_sha256."""
    return without_repeats(docs, words).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
