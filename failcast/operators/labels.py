"""Fault tags, the tag join and horizon labels; time splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from failcast.functions.expressions import month_key


def first_faults(faults: DataFrame, keys=("model", "serial_number"), time_col: str = "fault_time") -> DataFrame:
    """Earliest fault per device (partial aggregation map-side; one row per device out)."""
    return faults.groupBy(*keys).agg(F.min(time_col).alias(time_col))


def attach_faults(df: DataFrame, faults: DataFrame, keys=("serial_number", "model", "manufacturer"),
                  dedup: str = "none", time_col: str = "fault_time", broadcast: bool = False) -> DataFrame:
    """Left join of telemetry rows with fault tags on the device keys.

    ``dedup='none'`` keeps the plain join: a device with k tags gets k copies of each
    row. ``dedup='first_fault'`` reduces the tags to the earliest per device first, so
    the join side has one row per device and rows are never multiplied.

    No broadcast by default: the fault log grows with the fleet, so AQE decides from
    runtime sizes (it broadcasts when the reduced tag side is small, and splits a skewed
    row-side partition otherwise). ``broadcast=True`` is for callers that bound it.
    """
    keys = list(keys)
    tags = faults.select(*keys, time_col)
    if dedup == "first_fault":
        tags = first_faults(tags, keys, time_col)
    elif dedup != "none":
        raise ValueError(f"dedup must be 'none' or 'first_fault', not {dedup!r}")
    if broadcast:
        tags = F.broadcast(tags)
    return df.join(tags, on=keys, how="left")


def label_horizon(df: DataFrame, horizon_days: int = 30, include_after: bool = True,
                  day_col: str = "dt", time_col: str = "fault_time", out: str = "label") -> DataFrame:
    """1 when a fault is known and ``fault_time - day <= horizon``, else 0.

    ``include_after=True`` keeps the reference rule (no lower bound: days after the
    fault are 1 as well); ``False`` also requires ``day <= fault_time``.
    """
    gap = F.datediff(F.col(time_col), F.col(day_col))
    cond = F.col(time_col).isNotNull() & (gap <= horizon_days)
    if not include_after:
        cond = cond & (gap >= 0)
    return df.withColumn(out, F.when(cond, 1).otherwise(0))


def with_month(df: DataFrame, day_col: str = "dt", out: str = "month") -> DataFrame:
    return df.withColumn(out, month_key(day_col))


def time_range(df: DataFrame, lo=None, hi=None, day_col: str = "dt") -> DataFrame:
    """Half-open day range ``[lo, hi)``; either end may be open."""
    if lo is not None:
        df = df.filter(F.col(day_col) >= F.lit(lo).cast("date"))
    if hi is not None:
        df = df.filter(F.col(day_col) < F.lit(hi).cast("date"))
    return df


def time_split(df: DataFrame, splits: dict, day_col: str = "dt", allow_overlap: bool = False) -> dict:
    """Named half-open day ranges -> filtered frames. Overlapping ranges are refused
    unless ``allow_overlap`` (the reference's validation month lies inside its train range)."""
    bounds = sorted((str(lo), str(hi), name) for name, (lo, hi) in splits.items())
    if not allow_overlap:
        for (lo1, hi1, n1), (lo2, hi2, n2) in zip(bounds, bounds[1:]):
            if lo2 < hi1:
                raise ValueError(f"splits {n1!r} and {n2!r} overlap; pass allow_overlap=True to accept")
    return {name: time_range(df, lo, hi, day_col) for name, (lo, hi) in splits.items()}


def split_label(day_col: str, splits: dict) -> "F.Column":
    """CASE column naming the split a day falls in (first match in the given order)."""
    expr = None
    for name, (lo, hi) in splits.items():
        cond = (F.col(day_col) >= F.lit(lo).cast("date")) & (F.col(day_col) < F.lit(hi).cast("date"))
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr
