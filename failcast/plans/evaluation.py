"""Offline evaluation: ranking metrics on scored days and alert-level sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from failcast.operators import alerts as alr
from failcast.operators import labels as lab
from failcast.operators import metrics as met
from failcast.schema import EVAL_KEYS, HORIZON_DAYS


def ranking_report(scored: DataFrame, score_col: str = "probability", label_col: str = "label") -> dict:
    """PR-AUC, ROC-AUC, average precision and the best-F1 point, from one read of ``scored``."""
    row = met.curve_metrics(scored, score_col, label_col).first()
    best = {c: row[c] for c in ("threshold", "precision", "recall", "f1")}
    return {"pr_auc": row.pr_auc, "roc_auc": row.roc_auc, "average_precision": row.average_precision,
            "best_f1": None if row.f1 is None else best}


def alert_report(scored: DataFrame, faults: DataFrame, period, thresholds, lead_days: int = HORIZON_DAYS,
                 keys=EVAL_KEYS, score_col: str = "probability") -> DataFrame:
    """Precision/recall/F1 of first alerts for each threshold, in one job."""
    first = lab.first_faults(faults, keys)
    return met.threshold_sweep(scored, first, thresholds, period, lead_days, keys, score_col)


def alert_metrics_at(scored: DataFrame, faults: DataFrame, period, threshold: float,
                     lead_days: int = HORIZON_DAYS, keys=EVAL_KEYS, score_col: str = "probability") -> DataFrame:
    first_alerts = alr.first_alerts(alr.threshold_alerts(scored, score_col, threshold), keys)
    return met.alert_metrics(first_alerts, lab.first_faults(faults, keys), period, lead_days, keys)


def sweep_around_best(scored: DataFrame, faults: DataFrame, period, lead_days: int = HORIZON_DAYS,
                      keys=EVAL_KEYS, score_col: str = "probability", label_col: str = "label",
                      below: float = 0.01, above: float = 0.03, n: int = 9) -> DataFrame:
    """The best-F1 threshold of the day-level PR curve, then alert-level metrics for ``n``
    thresholds from ``best - below`` to ``best + above`` (one small action for the best
    threshold, one job for the whole sweep)."""
    best = met.best_f1_threshold(scored, score_col, label_col).first()
    if best is None:
        raise ValueError("no precision-recall point with a defined F1")
    return alert_report(scored, faults, period, met.sweep_around(best.threshold, below, above, n), lead_days,
                        keys, score_col)


def split_report(scored: DataFrame, splits: dict, score_col: str = "probability", label_col: str = "label",
                 allow_overlap: bool = False) -> DataFrame:
    """One row per named day range of ``splits``: ``curve_metrics`` of its rows.

    Overlapping ranges are refused unless ``allow_overlap``. ``scored`` is read once a range."""
    out = None
    for name, part in lab.time_split(scored, splits, allow_overlap=allow_overlap).items():
        row = met.curve_metrics(part, score_col, label_col).select(F.lit(name).alias("split"), "*")
        out = row if out is None else out.unionByName(row)
    return out
