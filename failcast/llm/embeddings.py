"""Embedding near-duplicates by Euclidean p-stable hashing.

Normalised vectors are projected on random normal directions; the quantised projections,
several to a table, bucket them in a number of tables. Vectors of one bucket are compared
by exact cosine in double precision. Bucket width, hashes and tables follow from the
threshold and the number of vectors, so that a pair at the threshold is missed with a
probability of at most ``miss`` and chance meetings stay few.

Equal vectors are one class. Buckets are cut into blocks and compared block against
block, and a block pair returns each vector's number of links and its group, never the
pairs; a pair that meets in several tables counts in the first of them only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from failcast.llm.components import components
from failcast.scratch import materialize

#: Bucket width in units of the distance at the threshold, vectors of a block, and the seed.
WIDTH, BLOCK, SEED = 4.0, 512, 20240229


def meeting(ratio: float) -> float:
    """Probability that one quantised projection agrees for points at width / ratio from each other."""
    return math.erf(ratio / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * ratio) * (1 - math.exp(-ratio * ratio / 2))


@dataclass(frozen=True)
class Plan:
    """Width of the buckets, hashes of a table, and tables."""
    width: float
    hashes: int
    tables: int

    @classmethod
    def of(cls, vectors: int, threshold: float, miss: float) -> Plan:
        near = math.sqrt(2 - 2 * threshold)
        width = WIDTH * near
        far = meeting(width / math.sqrt(2))  # unrelated vectors are about a right angle apart
        hashes = max(4, math.ceil(math.log(max(vectors, 2)) / -math.log(far)))
        return cls(width, hashes, math.ceil(math.log(miss) / math.log1p(-meeting(WIDTH) ** hashes)))

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """(vectors, tables) bucket numbers of unit vectors."""
        rng = np.random.default_rng(SEED + unit.shape[1])
        out = np.empty((len(unit), self.tables), np.int64)
        for t in range(self.tables):
            direction = rng.normal(size=(unit.shape[1], self.hashes))
            cell = np.floor((unit @ direction + rng.uniform(0, self.width, self.hashes)) / self.width).astype(np.int64)
            code = np.zeros(len(unit), np.uint64)
            for j in range(self.hashes):
                code = (code ^ cell[:, j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                code ^= code >> np.uint64(29)
            out[:, t] = code.view(np.int64)
        return out


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision (first by their largest component, against overflow)."""
    x = vectors.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _coded(plan: Plan):
    def run(batches):
        for batch in batches:
            vectors = batch.column("embedding")
            flat, offsets = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()
            size, n = np.diff(offsets), len(batch)
            codes, packed = [None] * n, [None] * n
            for dim in np.unique(size):
                rows = np.flatnonzero(size == dim)
                x = np.stack([flat[offsets[i]: offsets[i + 1]] for i in rows])
                for i, v, c in zip(rows, x, plan.codes(units(x))):
                    codes[i], packed[i] = c, v.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("rep"), batch.column("copies"), pa.array(size, pa.int32()),
                                              pa.array(packed, pa.binary()), pa.array(codes, pa.list_(pa.int64()))],
                                             ["label", "rep", "copies", "dim", "vector", "codes"])
    return run


def _groups(linked: np.ndarray) -> np.ndarray:
    """Smallest member of each row's group of a symmetric boolean matrix with a true diagonal."""
    label = np.arange(len(linked))
    while True:
        least = np.where(linked, label, len(label)).min(axis=1)
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _compare(threshold: float, kind: np.dtype):
    def block(table: int, rep, copies, dim, second, vector, codes):
        x = units(np.frombuffer(b"".join(vector), kind).reshape(len(rep), dim))
        linked = (x @ x.T) >= threshold
        if second.any():  # two blocks of a large bucket: only pairs across them
            linked &= second[:, None] != second[None, :]
        np.fill_diagonal(linked, False)
        a, b = np.nonzero(linked)
        new = ~(codes[a, :table] == codes[b, :table]).any(axis=1)  # pairs that met in no earlier table
        links = np.bincount(a[new], weights=copies[b[new]], minlength=len(rep)).astype(np.int64)
        np.fill_diagonal(linked, True)
        group = rep[_groups(linked)]
        return links, group

    def run(batches):
        key = ["label", "dim", "table", "code", "one", "two"]
        held = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now]).combine_chunks()
            out, held = _runs(held, key, block, last=False)
            if out is not None:
                yield out
        if held is not None:
            out, _ = _runs(held, key, block, last=True)
            if out is not None:
                yield out
    return run


def _runs(rows: pa.Table, key: list[str], block, last: bool):
    """Results of the whole runs of equal keys; the last run may go on in the next batch."""
    n = len(rows)
    if not n:
        return None, None
    cols = [rows.column(c).to_numpy() for c in key]
    change = np.zeros(n, dtype=bool)
    change[0] = True
    for c in cols:
        change[1:] |= c[1:] != c[:-1]
    edge = np.append(np.flatnonzero(change), n)
    runs = len(edge) - 1 if last else len(edge) - 2
    if runs <= 0:
        return None, rows
    rep, copies, second = (rows.column(c).to_numpy() for c in ("rep", "copies", "second"))
    vector = rows.column("vector").to_pylist()
    codes = rows.column("codes").combine_chunks().flatten().to_numpy().reshape(n, -1)
    reps, links, groups = [], [], []
    for a, b in zip(edge[:runs], edge[1: runs + 1]):
        got, group = block(int(cols[2][a]), rep[a:b], copies[a:b], int(cols[1][a]), second[a:b], vector[a:b], codes[a:b])
        told = (got > 0) | (group != rep[a:b])
        reps.append(rep[a:b][told]), links.append(got[told]), groups.append(group[told])
    out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (reps, links, groups)], ["rep", "links", "near"])
    return out, None if last else rows.slice(edge[runs])


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, miss: float = 0.01, plan: Plan | None = None) -> DataFrame:
    """Per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors are compared when their labels are equal and not null and they have as many components.
    n_links: other vectors linked directly; component_id: the smallest vec_id reached by links; kept:
    vec_id = component_id. A vector that is null, empty, zero or holds null or non-finite components,
    or has a null label or id, links with nothing; a null id has a null component and is not kept.
    Rows are vectors of their own, repeated rows included (they link with each other).
    """
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    if kind not in ("float", "double"):
        vectors, kind = vectors.withColumn("embedding", F.col("embedding").cast("array<double>")), "double"
    double = F.transform("embedding", lambda x: x.cast("double"))
    sound = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0)
                       & F.forall(double, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(double, lambda x: x != 0), F.lit(False))
    rows = vectors.select("vec_id", "label", F.when(sound, F.col("embedding")).alias("embedding")).withColumns(
        {"k1": F.xxhash64("embedding"), "k2": F.xxhash64(F.reverse("embedding"))})
    good = rows.where("embedding IS NOT NULL")
    classes = materialize(good.groupBy("label", "k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("embedding").alias("embedding")), "vector_classes")
    if plan is None:
        largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
        plan = Plan.of(largest, threshold, miss)
    coded = classes.select("label", "rep", "copies", "embedding").mapInArrow(
        _coded(plan), f"label {classes.schema['label'].dataType.simpleString()}, rep long, copies long, dim int, vector binary, codes array<long>")
    coded = materialize(coded, "vector_codes")
    key = ["label", "dim", "table", "code"]
    meets = coded.select("label", "dim", "rep", F.posexplode("codes").alias("table", "code"))
    full = materialize(meets.groupBy(*key).agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    # large buckets in blocks; each pair of blocks is one run of rows
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    placed = (meets.join(full, key).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
              .select(*key, "rep", F.least("mine", "other").alias("one"), F.greatest("mine", "other").alias("two"), (F.col("mine") > F.col("other")).alias("second")))
    work = placed.join(coded.select("rep", "copies", "vector", "codes", F.col("label").alias("l")), "rep").where(F.col("label") == F.col("l")).drop("l")
    run_key = [*key, "one", "two"]
    parts = work.repartition(*run_key).sortWithinPartitions(*run_key)
    told = materialize(parts.mapInArrow(_compare(threshold, np.dtype({"float": "<f4", "double": "<f8"}[kind])), "rep long, links long, near long"), "vector_links")
    links = told.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(told.select(F.col("rep").alias("a"), F.col("near").alias("b")))
    # rows that share an id and differ in their vectors are tied by it
    per_class = (classes.select("label", "k1", "k2", "rep", "copies").join(links, "rep", "left").join(groups, F.col("rep") == F.col("node"), "left")
                 .select("label", "k1", "k2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("found")))
    out = rows.drop("embedding").join(per_class, ["label", "k1", "k2"], "left")
    component = F.coalesce("found", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("vec_id").isNotNull(), component).alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
