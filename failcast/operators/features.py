"""Feature operators: typed metrics, trailing calendar windows, compressions and combinations.

All feature columns of one stage are produced in a single projection so that
Catalyst plans one Window node (one Exchange + one Sort) for every trailing
feature, and the whole recipe stays within three projections.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from failcast.functions.expressions import day_number, log2p1, weighted_total
from failcast.schema import FeatureSpec


def cast_metrics(df: DataFrame, cols) -> DataFrame:
    """Text metrics -> DOUBLE. Bad text ('abc', '') gives NULL, and NaN is turned into NULL
    so that max/min/std and the learners see one kind of missing value."""
    cols = set(cols)

    def typed(c):
        v = F.col(c).try_cast("double")
        return F.when(~F.isnan(v), v).alias(c)

    return df.select(*[typed(f.name) if f.name in cols else F.col(f.name) for f in df.schema.fields])


def _frame(keys, day_col: str, days: int):
    return (Window.partitionBy(*keys)
            .orderBy(day_number(day_col))
            .rangeBetween(-days, 0))


def _row_window_columns(cols, keys, day_col, days, range_name, std_name) -> list:
    w = _frame(keys, day_col, days)
    out = []
    for c in cols:
        out.append((F.max(c).over(w) - F.min(c).over(w)).alias(range_name(c)))
        out.append(F.stddev_samp(c).over(w).alias(std_name(c)))
    return out


def trailing_features(df: DataFrame, cols, keys=("model", "serial_number"), day_col: str = "dt",
                      days: int = 7, unique_days: bool = False, prefix: str | None = None,
                      num_partitions: int | None = None) -> DataFrame:
    """Trailing calendar-window range (max - min) and sample stddev per metric.

    Frame: the same device, days ``[d - days, d]`` by calendar (gaps allowed); rows on
    the same day are peers and see each other; a NULL key is a device of its own. Adds
    ``<prefix>range_<c>`` and ``<prefix>std_<c>``, in the order of the input's columns.

    ``unique_days=True`` asserts one row per (keys, day) (e.g. a daily roll-up): one
    Window over the rows, one shuffle, per-task size bounded by the calendar span.
    Otherwise (default) nothing is assumed about how rows spread over devices and days:
    see ``daily_trailing_features``. It reads the input twice, so write an expensive
    input first (``failcast.scratch.materialize``).

    ``num_partitions`` pre-partitions the rows by the device keys into that many
    partitions; the window's clustering requirement is then already met, so that
    repartition is the only shuffle (the default leaves the count to AQE).
    """
    keys = list(keys)
    wanted = set(cols)
    cols = [c for c in df.columns if c in wanted]
    prefix = prefix if prefix is not None else f"window_{days}_"
    if num_partitions:
        df = df.repartition(int(num_partitions), *keys)
    if not unique_days:
        return daily_trailing_features(df, cols, keys, day_col, days, prefix)
    names = (lambda c: f"{prefix}range_{c}", lambda c: f"{prefix}std_{c}")
    return df.select("*", *_row_window_columns(cols, keys, day_col, days, *names))


def merged_range(days: list[Column], i: int) -> Column:
    """Largest less smallest value of the days' summaries (see ``merged_std``)."""
    most, least = (d[f"max_{i}"] for d in days), (F.coalesce(d[f"min_{i}"], d[f"max_{i}"]) for d in days)
    return F.greatest(*most, F.lit(None)) - F.least(*least, F.lit(None))


def merged_std(days: list[Column], i: int) -> tuple[dict[str, Column], dict[str, Column], Column]:
    """Sample standard deviation of values known by summaries of days: structs (NULL where there is none) of ``n_``, ``max_``,
    ``min_``, ``mean_`` and ``m2_`` with a number, m2 the sum of squared distances from the mean; the last three are NULL where
    all values are equal. In three steps that build on each other's columns: the count and a centre, the mean's distance
    from the centre, and the result.

    Means are taken relative to the first one and then to the mean of all, so nothing large is subtracted from anything
    large: a device whose values jump by many orders of magnitude keeps the digits of its quiet days. Summaries without
    values change nothing. Each summary is a term of a plain sum, which compiles (a lambda does not)."""
    n, m2 = ([d[f"{k}_{i}"] for d in days] for k in ("n", "m2"))
    mean = [F.coalesce(d[f"mean_{i}"], d[f"max_{i}"].cast("double")) for d in days]
    count, centre, shift = (F.col(f"_{k}_{i}") for k in ("count", "centre", "shift"))

    def total(terms, none=0.0):
        return reduce(add, [F.coalesce(t, F.lit(none)) for t in terms])

    first = {f"_count_{i}": total(n, 0), f"_centre_{i}": F.coalesce(*mean)}
    second = {f"_shift_{i}": F.try_divide(total([k * (m - centre) for k, m in zip(n, mean)]), count)}
    apart = [m - centre - shift for m in mean]
    return first, second, F.when(count > 1, F.sqrt((total(m2) + total([k * (x * x) for k, x in zip(n, apart)])) / (count - 1)))


def daily_trailing_features(df: DataFrame, cols, keys=("model", "serial_number"), day_col: str = "dt",
                            days: int = 7, prefix: str | None = None) -> DataFrame:
    """``trailing_features`` however the rows spread over devices and days.

    Rows are first reduced to one summary per (keys, day) with map-side partial
    aggregation, so a hot device or day never lands whole in one task; the window gathers
    the daily summaries of each frame (at most ``days + 1``), whose moments are merged pair
    by pair (``merged_moments``), and the result is joined back to the rows on (keys, day),
    where AQE splits any skewed row-side partition.
    """
    keys = list(keys)
    prefix = prefix if prefix is not None else f"window_{days}_"

    def range_name(c):
        return f"{prefix}range_{c}"

    def std_name(c):
        return f"{prefix}std_{c}"

    # one summary row per (device, day): count, max, min, mean, M2 per metric. What a day of equal values (most hold one
    # row) has twice is NULL: its mean is its max exactly, as is its min. Kinds stand together, so that the runs of equal
    # bytes which this gives cost next to nothing in the shuffles
    def each(kind, value):
        return [value(c, F.max(c) != F.min(c)).alias(f"{kind}_{i}") for i, c in enumerate(cols)]

    def mean(c):
        return F.sum(c) / F.count(c) if df.schema[c].dataType.typeName() == "double" else F.avg(c)

    daily = df.groupBy(*keys, day_col).agg(F.struct(
        *each("n", lambda c, _: F.count(c)), *each("max", lambda c, _: F.max(c)),
        *each("min", lambda c, differ: F.when(differ, F.min(c))), *each("mean", lambda c, differ: F.when(differ, mean(c))),
        *each("m2", lambda c, differ: F.when(differ, F.var_pop(c) * F.count(c)))).alias("_s"))

    gathered = daily.select(*keys, day_col, F.collect_list("_s").over(_frame(keys, day_col, days)).alias("_s"))
    frame = [F.get("_s", F.lit(k)) for k in range(days + 1)]  # a frame holds a day once
    steps = [merged_std(frame, i) for i in range(len(cols))]
    for k in (0, 1):
        gathered = gathered.select("*", *[e.alias(name) for s in steps for name, e in s[k].items()])
    out = []
    for i, c in enumerate(cols):
        out += [merged_range(frame, i).alias(range_name(c)), steps[i][2].alias(std_name(c))]
    feats = gathered.select(*[F.col(k).alias(f"_k_{k}") for k in keys + [day_col]], *out)

    cond = None
    for k in keys + [day_col]:
        c = df[k].eqNullSafe(feats[f"_k_{k}"])
        cond = c if cond is None else cond & c
    joined = df.join(feats, cond, "left")
    return joined.select(*[df[f.name] for f in df.schema.fields],
                         *[feats[n] for n in [x for c in cols for x in (range_name(c), std_name(c))]])


def log_compress(df: DataFrame, cols) -> DataFrame:
    """Replace each column by log2(x + 1) (NULL for x <= -1)."""
    cols = set(cols)
    return df.select(*[log2p1(f.name).alias(f.name) if f.name in cols else F.col(f.name)
                       for f in df.schema.fields])


def interaction(df: DataFrame, target: str, factor: str, out: str | None = None) -> DataFrame:
    """``out := target * factor`` (in place by default)."""
    out = out or target
    return df.withColumn(out, F.col(target) * F.col(factor))


def weighted_sum(df: DataFrame, weights: dict, out: str = "anomaly_sum") -> DataFrame:
    """``out = sum(col / divisor)``; a NULL in any term gives NULL."""
    return df.withColumn(out, weighted_total(weights))


def scale_columns(df: DataFrame, weights: dict) -> DataFrame:
    """Divide each listed column in place by its divisor (one projection)."""
    return df.withColumns({c: F.col(c) / F.lit(float(w)) for c, w in weights.items()})


def pairwise_sums(df: DataFrame, cols) -> DataFrame:
    """Every pair (a, b) in the given order becomes ``sum_<a>_<b> = a + b``."""
    return df.withColumns({f"sum_{a}_{b}": F.col(a) + F.col(b) for a, b in combinations(list(cols), 2)})


def build_features(df: DataFrame, spec: FeatureSpec, unique_days: bool = False,
                   num_partitions: int | None = None) -> DataFrame:
    """The whole recipe in three projections.

    1. trailing range/std on the raw values of ``spec.window_cols``;
    2. log2(x+1) of ``spec.log_cols``, the interaction ``target := log(target) * range``,
       and ``spec.sum_col`` as the weighted sum of the (logged) weighted columns;
    3. in-place scaling by the same divisors, then pairwise sums of the scaled columns.
    """
    # methods of over 8 000 bytes of bytecode are never compiled by the JVM; with so many columns Spark's fused ones
    # would be, and its unfused ones, which it then takes instead, are cut into short methods
    df.sparkSession.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    stage1 = trailing_features(df, spec.window_cols, spec.keys, spec.day_col, spec.window_days,
                               unique_days=unique_days, prefix=spec.prefix, num_partitions=num_partitions)

    current = {f.name: F.col(f.name) for f in stage1.schema.fields}
    for c in spec.log_cols:
        current[c] = log2p1(c)
    if spec.interaction is not None:
        target, factor = spec.interaction
        current[target] = current[target] * F.col(factor)
    anomaly = None
    for c, w in spec.weights.items():
        term = current[c] / F.lit(float(w))
        anomaly = term if anomaly is None else anomaly + term
    stage2 = stage1.select(*[e.alias(n) for n, e in current.items()], anomaly.alias(spec.sum_col))

    return pairwise_sums(scale_columns(stage2, spec.weights), spec.pair_cols)
