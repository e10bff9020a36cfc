"""Alert-level precision/recall/F1, threshold sweeps and ranking curves.

Metrics come back as DataFrames. Curves are computed over distinct scores with an exact
distributed prefix sum: no global single-partition window over the scored rows. Building a
curve runs one small job for the quantiles that spread the work; ``curve_metrics`` gives all
curve metrics from one written curve. Rows whose score is NULL or NaN are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from failcast.scratch import materialize

EPS_COUNT = 1e-20
EPS_F1 = 1e-10


# --- alert level --------------------------------------------------------------

def _alert_counts(has_alert, alert_day, fault_time, period, lead_days):
    lo, hi = period
    has_fault = fault_time.isNotNull()
    in_period = has_fault & (fault_time >= F.lit(lo).cast("date")) & (fault_time < F.lit(hi).cast("date"))
    hit = has_alert & has_fault & (F.date_sub(fault_time, lead_days) <= alert_day)
    recalled = in_period & has_alert & (fault_time >= alert_day)
    return hit, in_period, recalled


def _prf(npp, ntpp, npr, ntpr):
    precision = ntpp / (npp + F.lit(EPS_COUNT))
    recall = ntpr / (npr + F.lit(EPS_COUNT))
    f1 = F.lit(2.0) * precision * recall / (precision + recall + F.lit(EPS_F1))
    return precision, recall, f1


def alert_metrics(first_alerts: DataFrame, first_faults: DataFrame, period, lead_days: int = 30,
                  keys=("model", "serial_number"), day_col: str = "dt", time_col: str = "fault_time") -> DataFrame:
    """npp, ntpp, npr, ntpr, precision, recall, F1 of one alert set.

    Both inputs are one row per device (first alert, first fault), so one full outer
    join on the device keys carries every count; one aggregation computes all four.
    - ntpp: alerts whose device fails at most ``lead_days`` after the alert (or before it);
    - npr: first faults inside ``period = [lo, hi)``;
    - ntpr: those faults with an alert on or before the fault day.
    """
    keys = list(keys)
    j = (first_alerts.select(*keys, day_col)
         .join(first_faults.select(*keys, time_col), keys, "full_outer"))
    has_alert = F.col(day_col).isNotNull()
    hit, in_period, recalled = _alert_counts(has_alert, F.col(day_col), F.col(time_col), period, lead_days)
    agg = j.agg(F.count_if(has_alert).alias("npp"), F.count_if(hit).alias("ntpp"),
                F.count_if(in_period).alias("npr"), F.count_if(recalled).alias("ntpr"))
    p, r, f1 = _prf(F.col("npp"), F.col("ntpp"), F.col("npr"), F.col("ntpr"))
    return agg.select("npp", "ntpp", "npr", "ntpr", p.alias("precision"), r.alias("recall"), f1.alias("F1"))


def threshold_sweep(scored: DataFrame, first_faults: DataFrame, thresholds, period, lead_days: int = 30,
                    keys=("model", "serial_number"), score_col: str = "probability", day_col: str = "dt",
                    time_col: str = "fault_time") -> DataFrame:
    """``alert_metrics`` for many thresholds in one job.

    One grouped pass computes every threshold's first alert day per device as a
    conditional ``min`` (no row is copied per threshold); one join with the first faults
    and one aggregation give all counts; the single result row is unpivoted to one row
    per threshold.
    """
    keys = list(keys)
    ts = [float(t) for t in thresholds]
    per_dev = scored.groupBy(*keys).agg(
        *[F.min(F.when(F.col(score_col) > F.lit(t), F.col(day_col))).alias(f"_a{j}") for j, t in enumerate(ts)])
    j = per_dev.join(first_faults.select(*keys, time_col), keys, "full_outer")
    ft = F.col(time_col)
    aggs = []
    in_period = None
    for i in range(len(ts)):
        a = F.col(f"_a{i}")
        hit, in_period, recalled = _alert_counts(a.isNotNull(), a, ft, period, lead_days)
        aggs += [F.count_if(a.isNotNull()).alias(f"_npp{i}"), F.count_if(hit).alias(f"_ntpp{i}"),
                 F.count_if(recalled).alias(f"_ntpr{i}")]
    agg = j.agg(*aggs, F.count_if(in_period).alias("npr"))
    rows = F.inline(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"_npp{i}").alias("npp"),
                                       F.col(f"_ntpp{i}").alias("ntpp"), F.col("npr").alias("npr"),
                                       F.col(f"_ntpr{i}").alias("ntpr")) for i, t in enumerate(ts)]))
    out = agg.select(rows)
    p, r, f1 = _prf(F.col("npp"), F.col("ntpp"), F.col("npr"), F.col("ntpr"))
    return out.select("threshold", "npp", "ntpp", "npr", "ntpr", p.alias("precision"), r.alias("recall"),
                      f1.alias("F1"))


def sweep_around(center: float, below: float = 0.01, above: float = 0.03, n: int = 9) -> list:
    """Evenly spaced thresholds ``[center - below, center + above]`` (n points)."""
    start, stop = center - below, center + above
    return [start + i * ((stop - start) / (n - 1)) for i in range(n)]


# --- ranking curves -----------------------------------------------------------

def score_counts(df: DataFrame, score_col: str = "probability", label_col: str = "label") -> DataFrame:
    """One row per distinct score: positives and negatives at that score."""
    y = F.col(label_col).cast("long")
    return (df.groupBy(F.col(score_col).alias("threshold"))
            .agg(F.sum(y).alias("pos"), (F.count(F.lit(1)) - F.sum(y)).alias("neg")))


def ordered_bucket(col, bounds, n_fine: int) -> "F.Column":
    """A monotone bucket id for ``col``: coarse range ``c`` (between consecutive sorted
    ``bounds``, which include the min and max) times ``n_fine``, plus an equal-width
    sub-range inside it. One binary-search CASE tree whose leaves hold the arithmetic,
    so the expression stays small; values outside the bounds fall into the edge
    sub-ranges (the clamp keeps the id monotone)."""
    x = F.col(col) if isinstance(col, str) else col
    n_coarse = len(bounds) - 1

    def leaf(c):
        lo, hi = float(bounds[c]), float(bounds[c + 1])
        if hi <= lo:
            return F.lit(c * n_fine).cast("long")
        fine = F.floor((x - F.lit(lo)) * F.lit(n_fine / (hi - lo)))
        return F.lit(c * n_fine) + F.least(F.greatest(fine, F.lit(0)), F.lit(n_fine - 1))

    def tree(lo, hi):  # coarse ranges lo..hi; range c holds x with bounds[c] < x <= bounds[c + 1]
        if lo == hi:
            return leaf(lo)
        mid = (lo + hi) // 2
        return F.when(F.lit(float(bounds[mid + 1])) < x, tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, n_coarse - 1).cast("long")


def descending_cumsum(df: DataFrame, order_col: str, cols, n_buckets: int = 64, n_fine: int = 1024,
                      rel_error: float = 1e-3) -> DataFrame:
    """Running totals of ``cols`` from the largest ``order_col`` down, distributed.

    Rows (e.g. distinct scores) are cut into ordered buckets: ``n_buckets`` ranges at
    approximate quantiles (one bounded action returning ``n_buckets + 1`` numbers), each
    split into ``n_fine`` equal-width sub-ranges, so there are at most
    ``n_buckets * n_fine`` buckets and each usually holds a small slice of the rows. Per-bucket totals (one row per non-empty bucket, bounded by that
    product) are prefix-summed and broadcast back; each bucket then runs its own ordered
    window. Only scores crowded far closer together than 1 / (n_buckets * n_fine) of their
    neighbourhood share buckets; raise ``n_fine`` for such data. The result is exact - the bucketing only spreads the work. Adds ``cum_<c>``
    (sum of ``c`` over rows with ``order_col >= this``) and ``all_<c>`` (the grand total).
    """
    cols = list(cols)
    qs = [i / n_buckets for i in range(n_buckets + 1)]
    bounds = sorted(set(q for q in df.approxQuantile(order_col, qs, rel_error) if q is not None))
    if len(bounds) < 2:
        bounds = (bounds or [0.0]) * 2
    b = df.withColumn("_bucket", ordered_bucket(order_col, bounds, n_fine))
    totals = b.groupBy("_bucket").agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    higher = Window.orderBy(F.col("_bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    offsets = totals.select(  # at most n_buckets * n_fine rows: a single-partition window is fine here
        "_bucket",
        *[F.coalesce(F.sum(f"_t_{c}").over(higher), F.lit(0)).alias(f"_o_{c}") for c in cols],
        *[F.sum(f"_t_{c}").over(everything).alias(f"all_{c}") for c in cols])
    inner = Window.partitionBy("_bucket").orderBy(F.col(order_col).desc()).rowsBetween(Window.unboundedPreceding, 0)
    j = b.join(F.broadcast(offsets), "_bucket")
    return j.select(*df.columns, *[(F.col(f"_o_{c}") + F.sum(c).over(inner)).alias(f"cum_{c}") for c in cols],
                    *[F.col(f"all_{c}") for c in cols])


def cumulative_counts(df: DataFrame, score_col: str = "probability", label_col: str = "label",
                      n_buckets: int = 64) -> DataFrame:
    """Per distinct score: pos, neg, tp/fp at threshold ``score >= t``, and totals P, N."""
    counts = score_counts(df.filter(F.col(score_col).isNotNull() & ~F.isnan(score_col)), score_col, label_col)
    cum = descending_cumsum(counts, "threshold", ["pos", "neg"], n_buckets)
    return cum.select("threshold", "pos", "neg", F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"),
                      F.col("all_pos").alias("P"), F.col("all_neg").alias("N"))


def _pr_points(cum: DataFrame) -> DataFrame:
    """Precision-recall points down to the first threshold reaching full recall, with the
    previous point's values (derived from the counts, so no lag across buckets)."""
    tp_prev, fp_prev = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    pts = cum.filter(tp_prev < F.col("P"))
    return pts.select(
        "threshold", "tp", "fp",
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        F.try_divide(F.col("tp"), F.col("P")).alias("recall"),
        F.coalesce(F.try_divide(tp_prev, tp_prev + fp_prev), F.lit(1.0)).alias("_p_prev"),
        F.try_divide(tp_prev, F.col("P")).alias("_r_prev"))


def pr_curve(df: DataFrame, score_col: str = "probability", label_col: str = "label", n_buckets: int = 64) -> DataFrame:
    """threshold, tp, fp, precision, recall for each distinct score, highest first, stopping at
    the first threshold that reaches full recall (the end point (recall 0, precision 1) is implied)."""
    return _pr_points(cumulative_counts(df, score_col, label_col, n_buckets)).drop("_p_prev", "_r_prev")


def pr_auc(df: DataFrame, score_col: str = "probability", label_col: str = "label", n_buckets: int = 64) -> DataFrame:
    """Trapezoid area under the PR curve, starting from (recall 0, precision 1)."""
    pts = _pr_points(cumulative_counts(df, score_col, label_col, n_buckets))
    area = (F.col("recall") - F.col("_r_prev")) * (F.col("precision") + F.col("_p_prev")) / F.lit(2.0)
    return pts.agg(F.sum(area).alias("pr_auc"))


def average_precision(df: DataFrame, score_col: str = "probability", label_col: str = "label",
                      n_buckets: int = 64) -> DataFrame:
    """Sum over thresholds of (R_n - R_{n-1}) * P_n."""
    pts = _pr_points(cumulative_counts(df, score_col, label_col, n_buckets))
    return pts.agg(F.sum((F.col("recall") - F.col("_r_prev")) * F.col("precision")).alias("average_precision"))


def roc_auc(df: DataFrame, score_col: str = "probability", label_col: str = "label", n_buckets: int = 64) -> DataFrame:
    """Trapezoid area under the ROC curve over every distinct score (ties count half)."""
    cum = cumulative_counts(df, score_col, label_col, n_buckets)
    tpr, fpr = F.try_divide(F.col("tp"), F.col("P")), F.try_divide(F.col("fp"), F.col("N"))
    tpr_prev = F.try_divide(F.col("tp") - F.col("pos"), F.col("P"))
    fpr_prev = F.try_divide(F.col("fp") - F.col("neg"), F.col("N"))
    return cum.agg(F.sum((fpr - fpr_prev) * (tpr + tpr_prev) / F.lit(2.0)).alias("roc_auc"))


def best_f1_threshold(df: DataFrame, score_col: str = "probability", label_col: str = "label",
                      n_buckets: int = 64) -> DataFrame:
    """The PR point with the highest F1; among equal F1 the lowest threshold. 0/0 is skipped."""
    pts = pr_curve(df, score_col, label_col, n_buckets)
    f1 = F.try_divide(F.lit(2.0) * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return (pts.select("threshold", "precision", "recall", f1.alias("f1"))
            .filter(F.col("f1").isNotNull())
            .orderBy(F.col("f1").desc(), F.col("threshold").asc()).limit(1))


def precision_at_n(df: DataFrame, score_col: str = "probability", label_col: str = "label", n=None,
                   n_buckets: int = 64) -> DataFrame:
    """Precision of ``score > t`` where t is the linear-interpolated percentile leaving ``n``
    rows above it (``n`` defaults to the number of positives). Exact: the two order
    statistics are located on the distributed cumulative counts."""
    cum = cumulative_counts(df, score_col, label_col, n_buckets)
    total = F.col("P") + F.col("N")
    n_sel = F.col("P") if n is None else F.lit(int(n))
    h = (F.lit(1.0) - n_sel / total) * (total - 1)
    below = total - (F.col("tp") + F.col("fp"))          # rows strictly under this score
    here = F.col("pos") + F.col("neg")

    def at(rank):
        return F.max(F.when((below <= rank) & (rank < below + here), F.col("threshold")))

    lo_rank = F.floor(h)
    hi_rank = F.least(lo_rank + 1, total - 1)
    stats = cum.agg(at(lo_rank).alias("v_lo"), at(hi_rank).alias("v_hi"), F.first(h - lo_rank).alias("frac"))
    thr = stats.select(F.when(F.col("frac") > 0, F.col("v_lo") + (F.col("v_hi") - F.col("v_lo")) * F.col("frac"))
                       .otherwise(F.col("v_lo"))).scalar()
    above = cum.filter(F.col("threshold") > thr)
    out = above.agg(F.coalesce(F.sum(here), F.lit(0)).alias("n_pred"), F.coalesce(F.sum("pos"), F.lit(0)).alias("tp"))
    return out.select(thr.alias("threshold"), "n_pred", "tp",
                      F.coalesce(F.try_divide(F.col("tp"), F.col("n_pred")), F.lit(0.0)).alias("precision"))


def curve_metrics(df: DataFrame, score_col: str = "probability", label_col: str = "label", n_buckets: int = 64) -> DataFrame:
    """One row: n_rows and n_positive (with a score), pr_auc, average_precision, roc_auc and the best F1
    point (threshold, precision, recall, f1).

    ``df`` is read once: the distinct-score counts are written, the curve is built on them
    and written, and one aggregate gives every metric. Equal F1: the lowest threshold."""
    counts = materialize(score_counts(df.filter(F.col(score_col).isNotNull() & ~F.isnan(score_col)), score_col, label_col), "score_counts")
    cum = materialize(descending_cumsum(counts, "threshold", ["pos", "neg"], n_buckets), "score_curve")
    tp, fp, P, N = F.col("cum_pos"), F.col("cum_neg"), F.col("all_pos"), F.col("all_neg")
    tp_prev, fp_prev = tp - F.col("pos"), fp - F.col("neg")
    on_pr = tp_prev < P  # down to the first threshold with full recall
    precision, recall = tp / (tp + fp), F.try_divide(tp, P)
    p_prev, r_prev = F.coalesce(F.try_divide(tp_prev, tp_prev + fp_prev), F.lit(1.0)), F.try_divide(tp_prev, P)
    f1 = F.try_divide(F.lit(2.0) * precision * recall, precision + recall)
    roc = (F.try_divide(fp, N) - F.try_divide(fp_prev, N)) * (recall + r_prev) / F.lit(2.0)
    point = F.struct(f1.alias("f1"), (-F.col("threshold")).alias("down"), precision.alias("precision"), recall.alias("recall"))
    one = cum.agg(F.max(P + N).alias("n_rows"), F.max(P).alias("n_positive"), F.sum(F.when(on_pr, (recall - r_prev) * (precision + p_prev) / F.lit(2.0))).alias("pr_auc"),
                  F.sum(F.when(on_pr, (recall - r_prev) * precision)).alias("average_precision"),
                  F.sum(roc).alias("roc_auc"), F.max(F.when(on_pr & f1.isNotNull(), point)).alias("best"))
    return one.select("n_rows", "n_positive", "pr_auc", "average_precision", "roc_auc", (-F.col("best.down")).alias("threshold"),
                      F.col("best.precision").alias("precision"), F.col("best.recall").alias("recall"), F.col("best.f1").alias("f1"))


def score_histogram(df: DataFrame, score_col: str = "probability", bins: int = 100) -> DataFrame:
    """Counts in ``bins`` equal-width bins between the min and max score (max in the last), empty bins
    included. Rows whose score is NULL or NaN are in no bin; without any score every count is 0."""
    known = df.filter(F.col(score_col).isNotNull() & ~F.isnan(score_col))
    bounds = known.agg(F.struct(F.min(score_col).alias("lo"), F.max(score_col).alias("hi")).alias("b")).scalar()
    lo, hi = bounds["lo"], bounds["hi"]
    b = F.least(F.floor(F.try_divide(F.col(score_col) - lo, hi - lo) * F.lit(float(bins))), F.lit(bins - 1))
    b = F.when(hi == lo, F.lit(0)).otherwise(b).cast("int")
    counts = known.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n_rows"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(counts), "bin", "left").select("bin", F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"))
