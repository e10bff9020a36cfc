"""Intermediate tables in the folder that driver and executors share.

This module imports nothing else of the library, so every layer may use it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, *parts: str) -> str:
    """A folder under the cluster's shared checkpoint directory.

    Read from the session (``spark.checkpoint.dir`` / the context's checkpoint dir). Only
    where none is set and the master is local (tests, a bare local session) a fresh one is
    created and registered; on a cluster a machine-local folder would be invisible to the
    other machines, so a missing setting is an error there.
    """
    sc = spark.sparkContext
    base = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (sc.master or "").startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="failcast-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    base = sc.getCheckpointDir() or base
    return "/".join([base.rstrip("/"), *parts]) if parts else base


#: Catalog names of bucketed tables, by their folder.
_NAMES: dict[str, str] = {}
#: Folders written inside each open ``scope``, the innermost last.
_SCOPES: list[list[str]] = []


def materialize(df: DataFrame, name: str = "table", bucket_by: str | None = None) -> DataFrame:
    """Write ``df`` once as a parquet table under the shared checkpoint folder and continue
    from the written copy.

    For inputs of multi-pass operators (quota draws, curve metrics, ensemble rounds): the
    upstream plan runs once instead of once per pass (an eager ``checkpoint()`` of an
    uncached plan would run it twice), plans stay small, later reads prune columns, and
    a lost executor re-reads the copy instead of recomputing the lineage.

    ``bucket_by`` deals the rows into as many buckets as there are shuffle partitions, so tables
    bucketed by one column join on it without a shuffle."""
    spark = df.sparkSession
    path = shared_dir(spark, "materialized", f"{name}-{uuid.uuid4().hex}")
    if _SCOPES:
        _SCOPES[-1].append(path)
    if bucket_by is None:
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"scratch_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(buckets, bucket_by).sortBy(bucket_by).option("path", path).saveAsTable(table)
    _NAMES[path.rsplit("/", 1)[-1]] = table
    made = spark.table(table)
    # metadata of columns (the kinds of a vector's inputs) is kept as it was
    return made.select(*[F.col(f.name).alias(f.name, metadata=f.metadata) if f.metadata else F.col(f.name) for f in df.schema.fields])


_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside delete their shuffle files at their end, not when the driver collects their plans.

    For operators of many steps, each of which is written before the next one reads it."""
    before = spark.conf.get(_FREED, None)
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(_FREED) if before is None else spark.conf.set(_FREED, before)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        roots = {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/materialized/" in f}
        for root in roots:
            _delete(spark, root)


def _delete(spark: SparkSession, root: str) -> None:
    name = _NAMES.pop(root.rsplit("/", 1)[-1], None)
    if name:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Delete at its end the tables that ``materialize`` wrote inside it.

    For operators of many steps: their result is written after the scope's work, by ``finished``, and rests on
    nothing else."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for root in _SCOPES.pop():
            _delete(spark, root)


def finished(df: DataFrame, name: str = "result") -> DataFrame:
    """``df`` written once; the table outlives the innermost scope (and belongs to the one around it)."""
    made = materialize(df, name)
    if _SCOPES:
        path = _SCOPES[-1].pop()
        if len(_SCOPES) > 1:
            _SCOPES[-2].append(path)
    return made
