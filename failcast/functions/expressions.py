"""Column expressions (JVM built-ins only, so they stay in whole-stage codegen)."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_day(col, fmt: str = "yyyyMMdd") -> Column:
    """Text day -> DATE from its first ``len(fmt)`` characters (a time part behind the day is
    ignored); malformed, short or NULL text gives NULL instead of failing."""
    text = F.col(col) if isinstance(col, str) else col
    return F.try_to_date(F.substring(text, 1, len(fmt)), fmt)


def month_key(col) -> Column:
    """`yyyy-MM` month key of a DATE column."""
    return F.date_format(F.col(col) if isinstance(col, str) else col, "yyyy-MM")


def day_number(col) -> Column:
    """Days since the epoch: an integer order key for calendar RANGE frames."""
    return F.unix_date(F.col(col) if isinstance(col, str) else col)


def log2p1(col) -> Column:
    """log2(x + 1); NULL where x + 1 <= 0 (Spark's log2 of a non-positive is NULL)."""
    return F.log2(F.col(col) + F.lit(1.0))


def weighted_total(weights: dict) -> Column:
    """sum(col / divisor) in the given order; any NULL term makes the total NULL."""
    return reduce(add, [F.col(c) / F.lit(float(w)) for c, w in weights.items()])


def hash_order(*cols, seed=None) -> Column:
    """Deterministic pseudo-random order key: md5 over the row's text form.

    Unlike ``rand(seed)`` it does not depend on partition layout, and DuckDB's
    ``md5(concat_ws('|', ...))`` gives the same value for the same text.
    """
    parts = [F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]
    if seed is not None:
        parts.append(F.lit(str(seed)))
    return F.md5(F.concat_ws("|", *parts))
