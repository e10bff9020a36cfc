"""Audit of how filters interact, on a sparse document-term matrix.

Words are globally dictionary-encoded and documents stand in shards of compressed sparse
rows: a shard holds a slice of documents, its row pointers, column numbers and counts.
A shard's distinct words (sent once a shard, however often they occur) are dealt by word in
packs, numbered in order, and their numbers go back to the shards. Row sums and nonzero counts of
the matrix decide the filters on words; characters and copies decide the others, and the
sets of filters that documents fail are counted for every order of the filters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from failcast.llm.words import BLOCK_BYTES, Words, blocks, find_words, return_memory, word_bytes
from failcast.scratch import discard, materialize

#: A shard holds about this many bytes of text; a longer text is a shard of its own.
SHARD_BYTES = 10 << 20
#: Words are dealt into a part for so many bytes of text.
PART_BYTES = 64 << 20
#: A row can hold a whole shard: batches between Spark and its Python workers end at this size instead of Spark's 64 MB.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "2m"
#: A row of the matrix holds about this many cells; a document of more is a row of its own.
CELLS = 1 << 17

_CAPITAL = np.zeros(256, np.int64)
_CAPITAL[0x41:0x5B] = 1
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#$%&*|")] = 1
_POINT = np.ones(256, np.int64)  # bytes that begin a character
_POINT[0x80:0xC0] = 0
COUNTS = {"n_points": _POINT, "n_capitals": _CAPITAL, "n_symbols": _SYMBOL}

FILTERS = "ABCDE"


def _list(values: pa.Array) -> pa.Array:
    """One row that holds all of ``values``."""
    return pa.LargeListArray.from_arrays(pa.array([0, len(values)], pa.int64()), values).cast(pa.list_(values.type))


PACK = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("size", T.IntegerType()),
                     T.StructField("lengths", T.BinaryType()), T.StructField("bytes", T.BinaryType())])


def _places(words: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The words' bytes behind one another, and where each begins, with the end."""
    places = np.frombuffer(words.buffers()[1], np.int64)[words.offset: words.offset + len(words) + 1]
    return np.frombuffer(words.buffers()[2] or b"", np.uint8), places


def _in_parts(words: pa.LargeBinaryArray, parts: int) -> tuple[np.ndarray, pa.Array]:
    """Distinct words in order of the parts that they are dealt to: that order, and a pack a part."""
    data, places = _places(words)
    part = (Words(data, places, places[:-1], places[1:], places, places).hashes() % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    data, places = _places(words.take(pa.array(order)))
    edge = np.searchsorted(part[order], np.arange(parts + 1))
    packs = [{"part": i, "n": b - a, "size": int(places[b] - places[a]), "lengths": pa.compress(np.diff(places[a: b + 1]).astype("<i4").tobytes(), "zstd", asbytes=True),
              "bytes": pa.compress(data[places[a]: places[b]].tobytes(), "zstd", asbytes=True)} for i, (a, b) in enumerate(zip(edge.tolist(), edge[1:].tolist())) if b > a]
    return order, pa.array(packs, to_arrow_type(PACK))


def _row_totals(values: np.ndarray, offsets: np.ndarray, kind: np.ndarray | None = None) -> np.ndarray:
    """Sum of each row's values (or of ``kind`` at the values), a block of values at a time."""
    total, before = np.zeros(len(offsets), np.int64), 0
    for a in range(0, len(values), BLOCK_BYTES):
        some = values[a: a + BLOCK_BYTES]
        here = np.append(0, np.cumsum(some if kind is None else kind[some], dtype=np.int64))
        i, j = np.searchsorted(offsets, (a, a + BLOCK_BYTES), "right")
        total[i:j] = before + here[offsets[i:j] - a]
        before += int(here[-1])
    return np.diff(total)


def _shard(number: int, rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, parts: int) -> pa.RecordBatch:
    """Words are found, and cells counted, for some of the rows at a time: only the words' bytes and their places
    in the shard's dictionary stand whole."""
    found, n_words = [], []
    for _, block, ends in blocks(rows):
        w = find_words(block, ends)
        found.append(word_bytes(w))
        n_words.append(w.counts)
    coded = pa.concat_arrays(pa.chunked_array(found).dictionary_encode().chunks or [found[0].dictionary_encode()])  # no chunk, if no word
    del found
    words = coded.dictionary
    order, packs = _in_parts(words, parts)
    column_of = np.empty(len(words), np.int64)
    column_of[order] = np.arange(len(words))
    places, at = coded.indices.to_numpy(zero_copy_only=False), 0
    columns, counts, cells = [], [], [np.zeros(1, np.int64)]
    for n in n_words:
        term, at = column_of[places[at: at + int(n.sum())]], at + int(n.sum())
        key, count = np.unique(np.repeat(np.arange(len(n)) * len(words), n) + term, return_counts=True)
        row, column = np.divmod(key, max(1, len(words)))
        columns.append(column.astype("<i4"))
        counts.append(count.astype("<i4"))
        cells.append(np.bincount(row, minlength=len(n)))
    kept = {c: rows.column(c) for c in rows.schema.names if c != "text"}
    for name, kind in COUNTS.items():
        kept[name] = pa.array(_row_totals(data, offsets, kind))
    ends = offsets.tolist()
    kept["text_sha"] = pa.array([hashlib.sha256(data[a:b]).digest() for a, b in zip(ends, ends[1:])], pa.binary())
    made = {"shard": pa.array([number], pa.int64()), "rows": _list(pa.StructArray.from_arrays(list(kept.values()), list(kept))),
            "row_starts": _list(pa.array(np.cumsum(np.concatenate(cells)), pa.int32())),
            "columns": _packed(np.concatenate(columns)), "counts": _packed(np.concatenate(counts)), "packs": _list(packs)}
    return pa.RecordBatch.from_arrays(list(made.values()), list(made))


def _packed(values: np.ndarray) -> pa.Array:
    """32-bit integers, compressed, as one binary value: on the way no one looks at single ones."""
    return pa.array([pa.compress(values.astype("<i4", copy=False), "zstd", asbytes=True)], pa.binary())


def _binary(values: np.ndarray) -> pa.Array:
    """The values' bytes as one binary value, not copied."""
    return pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, values.nbytes], np.int32)), pa.py_buffer(values)])


def _unpacked(column: pa.Array, length: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(column[0].as_buffer(), 4 * length, "zstd"), "<i4")


def _whole(waiting: list[pa.RecordBatch]) -> pa.RecordBatch:
    """The batches as one; the list is emptied, so that their rows do not stand in memory twice."""
    whole = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
    waiting.clear()
    return whole


def _joined(batches):
    """Batches put together up to the size of a shard."""
    waiting, size = [], 0
    for batch in batches:
        here = batch.column("text").nbytes
        if waiting and size + here > SHARD_BYTES:
            yield _whole(waiting)
            size = 0
        if len(batch):
            waiting.append(batch)
            size += here
    if waiting:
        yield _whole(waiting)


def _tidied(run):
    """``run`` in a worker that gives freed memory back before and after: idle workers stand beside those at work."""
    def tidied(batches):
        return_memory()
        yield from run(batches)
        return_memory(small=True)
    return tidied


def _shards(parts: int):
    def run(batches):
        at = TaskContext.get().partitionId() << 32
        for batch in _joined(batches):
            for rows, data, offsets in blocks(batch, size=SHARD_BYTES):
                return_memory(small=True)
                yield _shard(at, rows, data, offsets, parts)
                at += 1
    return run


NUMBERED = "part int, shard long, numbers binary, n int, words array<string>"


def _numbered(table: pa.Table) -> pa.Table:
    """One part: each word's number in it, from 0 in order of the words, for each shard that sent it; and a row of the words."""
    return_memory()
    n = table.column("n").to_numpy()
    packs = [[pa.decompress(x, size, "zstd", asbytes=True) for x, size in zip(table.column(c).to_pylist(), sizes.tolist())]
             for c, sizes in (("lengths", 4 * n.astype(np.int64)), ("bytes", table.column("size").to_numpy()))]
    places = np.append(0, np.cumsum(np.frombuffer(b"".join(packs[0]), "<i4").astype(np.int64)))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(places) - 1, [None, pa.py_buffer(places), pa.py_buffer(b"".join(packs[1]))])
    coded = words.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    number = np.empty(len(order), "<i4")
    number[order] = np.arange(len(order))
    number = number[coded.indices.to_numpy(zero_copy_only=False)]
    edge, part = np.append(0, np.cumsum(n)).tolist(), table.column("part")[0].as_py()
    distinct = _list(coded.dictionary.take(pa.array(order)).cast(pa.binary()).cast(pa.string()))
    return pa.table([pa.array([part] * (len(n) + 1), pa.int32()), pa.array([*table.column("shard").to_pylist(), None], pa.int64()),
                     pa.array([*(pa.compress(number[a:b].tobytes(), "zstd", asbytes=True) for a, b in zip(edge, edge[1:])), None], pa.binary()),
                     pa.array([*n.tolist(), len(order)], pa.int32()), pa.concat_arrays([pa.nulls(len(n), distinct.type), distinct])],
                    names=["part", "shard", "numbers", "n", "words"])


def term_matrix(docs: DataFrame, keep=("doc_id",)) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(matrix, dictionary, tables) of the column ``text``: CSR shards, the words behind their columns, and the
    written tables that both read (``discard`` them at the end).

    matrix: a row for each piece of a shard: shard, rows (of each document the columns ``keep``, n_points, n_capitals,
    n_symbols and text_sha), row_starts, columns (terms, binary: little-endian 64-bit integers), counts (binary: little-endian 32-bit integers).
    dictionary: term (0 to the number of distinct words less one), word. Words are ``[^\\x20\\x09-\\x0D]+``, unchanged and compared whole; a null or empty
    text is an empty row. Every row of ``docs`` is a row of the matrix, repeated rows included.

    A frequent word is in one pack a shard in the dealing by word, however often documents hold it; numbers per
    part are made consecutive by one count a part on the driver.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text"))
    kept = [docs.schema[c] for c in keep] + [T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField("text_sha", T.BinaryType())]
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([T.StructField("shard", T.LongType()), T.StructField("rows", T.ArrayType(T.StructType(kept))), T.StructField("row_starts", ints),
                           T.StructField("columns", T.BinaryType()), T.StructField("counts", T.BinaryType()), T.StructField("packs", T.ArrayType(PACK))])
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = materialize(docs.mapInArrow(_tidied(_shards(int(size // PART_BYTES) + 1)), schema), "shards")
    packs = shards.select("shard", F.inline("packs"))
    numbered = materialize(packs.groupBy("part").applyInArrow(_numbered, NUMBERED), "terms")
    before, seen = {}, 0
    for r in sorted(numbered.where("words IS NOT NULL").select("part", "n").collect()):  # a row a part
        before[r["part"]] = seen
        seen += r["n"]
    begins = F.create_map(*[F.lit(x) for item in before.items() for x in item])[F.col("part")] if before else F.lit(0)
    dictionary = numbered.where("words IS NOT NULL").select(begins.cast("long").alias("begins"), F.posexplode("words").alias("at", "word")).select(
        (F.col("begins") + F.col("at")).alias("term"), "word")
    terms = numbered.where("shard IS NOT NULL").groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("part", "n", "numbers"))).alias("terms"))
    local = shards.drop("packs").join(terms, "shard", "left")
    matrix = local.mapInArrow(_tidied(_global(before)), T.StructType(schema.fields[:-1]))
    return matrix, dictionary, [shards, numbered]


def _global(before: dict[int, int]):
    """Local column numbers become terms: a shard's columns stand in order of the parts, whose terms begin at ``before``.

    A shard goes on in pieces, so that no row of Spark holds all its cells."""
    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                return_memory(small=True)
                one = batch.slice(i, 1)
                starts = one.column("row_starts").flatten()
                terms = [np.zeros(0, np.int64), *(before[t["part"]] + np.frombuffer(pa.decompress(t["numbers"], 4 * t["n"], "zstd"), "<i4").astype(np.int64)
                                                  for t in one.column("terms")[0].as_py() or ())]
                columns, counts = (_unpacked(one.column(c), starts[-1].as_py()) for c in ("columns", "counts"))
                terms, rows, starts, at = np.concatenate(terms), one.column("rows").flatten(), starts.to_numpy().astype(np.int64), 0
                while at < len(rows):
                    to = max(at + 1, int(np.searchsorted(starts, starts[at] + CELLS, "right")) - 1)
                    a, b = starts[at], starts[to]
                    made = [one.column("shard"), _list(rows.slice(at, to - at)), _list(pa.array(starts[at: to + 1] - a, pa.int32())),
                            _binary(terms[columns[a:b]].astype("<i8", copy=False)), _binary(counts[a:b])]
                    yield pa.RecordBatch.from_arrays(made, ["shard", "rows", "row_starts", "columns", "counts"])
                    at = to
    return run


def _row_counts(batches):
    for batch in batches:
        return_memory(small=True)
        for i in range(len(batch)):
            one = batch.slice(i, 1)
            starts = one.column("row_starts").flatten().to_numpy().astype(np.int64)
            sums = _row_totals(np.frombuffer(one.column("counts")[0].as_buffer(), "<i4"), starts)
            rows = one.column("rows").flatten()
            made = [rows.field(j) for j in range(rows.type.num_fields)] + [pa.array(sums), pa.array(np.diff(starts))]
            yield pa.RecordBatch.from_arrays(made, [*[f.name for f in rows.type], "n_words", "n_distinct"])


def row_counts(matrix: DataFrame) -> DataFrame:
    """A row per document of the matrix: its kept columns, n_words (row sum) and n_distinct (nonzero entries)."""
    row = matrix.schema["rows"].dataType.elementType
    return matrix.select("rows", "row_starts", "counts").mapInArrow(
        _tidied(_row_counts), T.StructType([*row.fields, T.StructField("n_words", T.LongType()), T.StructField("n_distinct", T.LongType())]))


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    key, size = BATCH_BYTES
    before = spark.conf.get(key, None)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def failures(docs: DataFrame, keep=()) -> DataFrame:
    """Distinct rows of ``docs`` (doc_id, text_sha and the columns ``keep``) with copies, their number, and fails: the
    letters of the filters that their text fails, in alphabetical order.

    A: under 50 words. B: 100 * distinct words < 65 * words. C: 100 * capital letters A-Z > 5 * code points. D: holds one
    of ``#$%&*|``. E: equal to the text of a smaller doc_id (by SHA-256 of the whole text); a row without doc_id has no
    smaller one, and rows of the smallest id never fail E. Null texts count as empty.
    """
    with _small_batches(docs.sparkSession):
        matrix, _, tables = term_matrix(docs, ["doc_id", *keep])
        rows = materialize(row_counts(matrix).groupBy("doc_id", *keep, "text_sha", "n_words", "n_distinct", "n_points", "n_capitals", "n_symbols")
                           .agg(F.count(F.lit(1)).alias("copies")), "rows")
    discard(*tables)
    first = rows.groupBy("text_sha").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    rows = rows.join(first, ["text_sha", "doc_id"], "left")
    conditions = {"A": F.col("n_words") < 50, "B": 100 * F.col("n_distinct") < 65 * F.col("n_words"), "C": 100 * F.col("n_capitals") > 5 * F.col("n_points"),
                  "D": F.col("n_symbols") > 0, "E": F.col("doc_id").isNotNull() & F.col("first").isNull()}
    fails = F.concat(*[F.when(c, F.lit(letter)).otherwise(F.lit("")) for letter, c in conditions.items()])
    return rows.select("doc_id", *keep, "text_sha", "copies", fails.alias("fails"))


def _fails(cell: Column, letter: Column) -> Column:
    return F.contains(cell["fails"], letter)


def _fails_any(cell: Column, letters: Column) -> Column:
    return F.length(F.call_function("translate", cell["fails"], letters, F.lit(""))) < F.length(cell["fails"])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, order of the five filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    part: the source, null as the empty string. A document is good (toxic) if a row of ``labels`` with its
    doc_id has quality = 1 (toxic = 1); rows without doc_id have no labels. Repeated rows count each. An empty table
    gives no rows. Only counts per part and set of failed filters (at most 32 a part) meet the 600 steps.
    """
    judged = failures(docs.select("doc_id", F.coalesce(F.col("source"), F.lit("")).alias("part"), "text"), ["part"])
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"),
                                                                      F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    n = F.col("copies")
    cells = judged.join(known, "doc_id", "left").groupBy("part", "fails").agg(
        F.sum(n).alias("n"), F.sum(F.when(F.col("good") == 1, n).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic") == 1, n).otherwise(0)).alias("toxic"))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("cells"))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    steps = (parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS))))))
    here = F.substring("filter_order", F.col("step"), F.lit(1))
    before = F.substring("filter_order", F.lit(1), F.col("step") - 1)

    def total(which, value=lambda c: c["n"]):
        return F.aggregate(F.filter("cells", which), F.lit(0).cast("long"), lambda s, c: s + value(c))

    def removed(c):
        return _fails(c, here) & ~_fails_any(c, before)

    return steps.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"),
        total(lambda c: ~_fails(c, here) & ~_fails_any(c, before)).alias("kept"), total(removed).alias("removed"),
        total(lambda c: _fails(c, here) & _fails_any(c, before)).alias("redundant"), total(lambda c: c["fails"] == here).alias("unique_fails"),
        total(removed, lambda c: c["good"]).alias("good_lost"), total(removed, lambda c: c["toxic"]).alias("toxic_lost"),
        # of all orders, those in which this filter is the first of the set that a document fails
        total(lambda c: _fails(c, here), lambda c: c["n"] * F.floor(F.lit(120) / F.length(c["fails"]))).alias("shapley"))


def audit_sql() -> str:
    """The same result in DuckDB SQL; shapley summed over the orders."""
    return r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
f AS (SELECT doc_id, part, len(words) < 50 AS a, 100 * len(list_distinct(words)) < 65 * len(words) AS b,
             100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * len(text) AS c, regexp_matches(text, '[#$%&*|]') AS d, coalesce(first < doc_id, false) AS e FROM w),
m AS (SELECT part, {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} AS x, a::INT + b::INT + c::INT + d::INT + e::INT AS n_fails,
             doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic FROM f),
cells AS (SELECT part, x, n_fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM l a, l b, l c, l d, l e
           WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (SELECT filter_order, step, filter_order[step] AS here, filter_order[1:step - 1] AS before FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
j AS (SELECT part, filter_order, step, here, n, good, toxic, n_fails,
             CASE here WHEN 'A' THEN x.A WHEN 'B' THEN x.B WHEN 'C' THEN x.C WHEN 'D' THEN x.D ELSE x.E END AS fails,
             (x.A AND contains(before, 'A')) OR (x.B AND contains(before, 'B')) OR (x.C AND contains(before, 'C'))
               OR (x.D AND contains(before, 'D')) OR (x.E AND contains(before, 'E')) AS gone
      FROM cells, steps),
r AS (SELECT part, filter_order, step, here, coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::BIGINT AS kept,
             coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant,
             coalesce(sum(n) FILTER (fails AND n_fails = 1), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (fails AND NOT gone), 0)::BIGINT AS good_lost,
             coalesce(sum(toxic) FILTER (fails AND NOT gone), 0)::BIGINT AS toxic_lost
      FROM j GROUP BY part, filter_order, step, here)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, here))::BIGINT AS shapley FROM r"""
