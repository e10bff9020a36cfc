"""A feature table that knows what it was made from.

Next to the months of the table lies a manifest: a fingerprint of the recipe and, per day of
telemetry, the number of rows and two sums over hashes of their values. A refresh compares it with the
telemetry at hand (one pass, summed before the shuffle) and rewrites only months whose frames see a changed
day. The manifest is taken away first and written last, so a refresh that was cut short is repeated in whole.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from failcast.functions.expressions import month_key
from failcast.operators import features as feat
from failcast.schema import FeatureSpec

MANIFEST = "_manifest"
_SCHEMA = "recipe string, day date, rows long, sum long, mix long"


def recipe_fingerprint(telemetry: DataFrame, spec: FeatureSpec, unique_days: bool) -> str:
    """One text for everything but rows that decides the feature table: the spec, the columns and the path taken."""
    made = {"spec": dataclasses.asdict(spec), "columns": [(f.name, f.dataType.simpleString()) for f in telemetry.schema.fields], "unique_days": unique_days}
    return hashlib.sha256(json.dumps(made, sort_keys=True, default=str).encode()).hexdigest()


def day_signatures(telemetry: DataFrame, day_col: str) -> DataFrame:
    """Per day: rows, and two order-free sums over 64-bit hashes of the rows (repeated rows count)."""
    value = F.xxhash64(*telemetry.columns)
    wrapped = lambda h: F.sum(h.cast("decimal(38,0)"))
    low = lambda x: F.pmod(x, F.lit(1 << 62)).cast("long")
    return telemetry.groupBy(F.col(day_col).cast("date").alias("day")).agg(
        F.count(F.lit(1)).alias("rows"), low(wrapped(value)).alias("sum"), low(wrapped(F.xxhash64(F.lit(1), *telemetry.columns))).alias("mix"))


def _months_of(day: dt.date | None, window_days: int) -> set:
    """Months of the days whose frames hold ``day``."""
    if day is None:
        return {None}
    return {(day + dt.timedelta(days=k)).strftime("%Y-%m") for k in range(window_days + 1)}


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _exists(spark, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _delete(spark, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def _write_manifest(spark, path: str, recipe: str, days: list) -> None:
    rows = [(recipe, None, -1, 0, 0), *[(recipe, r.day, r.rows, r.sum, r.mix) for r in days]]
    spark.createDataFrame(rows, _SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/{MANIFEST}")


def refresh(telemetry: DataFrame, spec: FeatureSpec, path: str, unique_days: bool = False) -> list:
    """Bring the feature table at ``path`` up to date; the months written ([] if none was out of date).

    Rows without a day form a month of their own. A calendar of days (at most one row a day) reaches the driver."""
    spark = telemetry.sparkSession
    recipe = recipe_fingerprint(telemetry, spec, unique_days)
    now = {r.day: r for r in day_signatures(telemetry, spec.day_col).collect()}
    before, known = {}, False
    if _exists(spark, f"{path}/{MANIFEST}/_SUCCESS"):
        rows = spark.read.parquet(f"{path}/{MANIFEST}").collect()
        known = bool(rows) and all(r.recipe == recipe for r in rows)
        before = {r.day: r for r in rows if r.rows >= 0} if known else {}
    same = lambda a, b: a is not None and b is not None and (a.rows, a.sum, a.mix) == (b.rows, b.sum, b.mix)
    changed = [d for d in {*now, *before} if not same(now.get(d), before.get(d))]
    if known and not changed:
        return []
    there = set().union(*[_months_of(d, 0) for d in now]) if now else set()
    stale = set().union(*[_months_of(d, spec.window_days) for d in changed]) if changed else set()
    gone = {m for d in before for m in _months_of(d, 0)} - there
    _delete(spark, f"{path}/{MANIFEST}")
    if not known:
        _delete(spark, path)
        stale = there
    for month in gone:
        _delete(spark, f"{path}/month={month or '__HIVE_DEFAULT_PARTITION__'}")
    months = sorted(stale & there, key=str)
    if months or not known:
        table = _of_months(telemetry, spec, months, unique_days)
        table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
    _write_manifest(spark, path, recipe, list(now.values()))
    return months


def _of_months(telemetry: DataFrame, spec: FeatureSpec, months: list, unique_days: bool) -> DataFrame:
    """Features of the given months, read from their days and the days that their first frames look back on."""
    day = F.col(spec.day_col)
    needed = F.lit(False)
    for m in months:
        if m is None:
            needed = needed | day.isNull()
            continue
        first = dt.date.fromisoformat(f"{m}-01")
        after = (first + dt.timedelta(days=31)).replace(day=1)
        needed = needed | ((day >= F.lit(first - dt.timedelta(days=spec.window_days))) & (day < F.lit(after)))
    table = feat.build_features(telemetry.where(F.coalesce(needed, F.lit(False))), spec, unique_days=unique_days).withColumn("month", month_key(spec.day_col))
    named = [m for m in months if m is not None]
    wanted = F.col("month").isin(named) if named else F.lit(False)
    return table.where(F.coalesce(wanted, F.lit(False)) | (F.col("month").isNull() if None in months else F.lit(False)))
