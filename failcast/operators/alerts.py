"""From per-day scores to one first alert per device."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def threshold_schedule(df: DataFrame, hi: float, lo: float, begin, days: int = 30,
                       day_col: str = "dt", out: str = "thresh") -> DataFrame:
    """Linearly decaying threshold ``hi - (day - begin) * (hi - lo) / days``.
    With ``hi == lo`` it is a constant (Catalyst folds the slope away)."""
    slope = (float(hi) - float(lo)) / float(days)
    return df.withColumn(out, F.lit(float(hi)) - F.datediff(F.col(day_col), F.lit(begin).cast("date")) * F.lit(slope))


def threshold_alerts(scored: DataFrame, score_col: str = "probability", thresh="thresh") -> DataFrame:
    """Days whose score is strictly above the threshold (a column name or a number)."""
    t = F.col(thresh) if isinstance(thresh, str) else F.lit(float(thresh))
    return scored.filter(F.col(score_col) > t)


def first_alerts(alerts: DataFrame, keys=("manufacturer", "model", "serial_number"),
                 day_col: str = "dt") -> DataFrame:
    """Earliest alert day per device: one row per device."""
    return alerts.groupBy(*keys).agg(F.min(day_col).alias(day_col))


def order_alerts(first: DataFrame, day_col: str = "dt", serial_col: str = "serial_number") -> DataFrame:
    """The alert file order: day ascending, then serial ascending."""
    return first.orderBy(day_col, serial_col)
