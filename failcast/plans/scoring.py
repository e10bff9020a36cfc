"""Batch scoring: recent telemetry -> features -> ensemble score -> one first alert per device."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession

from failcast.operators import alerts as alr
from failcast.operators import ensemble as ens
from failcast.operators import features as feat
from failcast.operators.labels import time_range
from failcast.schema import ALERT_KEYS, ALERT_SCHEMA, SCORE_THRESHOLD, SMART_SPEC, FeatureSpec
from failcast.scratch import materialize
from failcast.sources.telemetry import read_telemetry, write_alerts


def look_back_start(score_from: str, window_days: int) -> str:
    """First day needed so the first scored day sees its full trailing window."""
    return (_dt.date.fromisoformat(score_from) - _dt.timedelta(days=window_days)).isoformat()


def score_days(features: DataFrame, featurizer, model, score_from: str, hi: float = SCORE_THRESHOLD,
               lo: float = SCORE_THRESHOLD, days: int = 30) -> DataFrame:
    """Scores and per-day thresholds for days on or after ``score_from``."""
    recent = time_range(features, score_from, None)
    recent = alr.threshold_schedule(recent, hi, lo, score_from, days)
    return ens.score(featurizer.transform(recent), model).drop("features")


def alerts_from_scores(scored: DataFrame, keys=ALERT_KEYS) -> DataFrame:
    return alr.order_alerts(alr.first_alerts(alr.threshold_alerts(scored, "probability", "thresh"), keys))


def run(spark: SparkSession, logs_path: str, featurizer, model, score_from: str, out_path: str | None = None,
        spec: FeatureSpec = SMART_SPEC, layout: str = "by_day", hi: float = SCORE_THRESHOLD,
        lo: float = SCORE_THRESHOLD, columns=None, metric_pattern: str = "smart",
        unique_days: bool = False, name_day_token: int | None = None) -> DataFrame:
    """The batch job: read only the look-back the windows need, build features, score,
    keep the first alert per device, and optionally write the alert file.

    The typed telemetry is written once where the windows read it twice; with ``out_path`` the
    result is the written alert table, so using it repeats nothing."""
    since = look_back_start(score_from, spec.window_days)
    logs = read_telemetry(spark, logs_path, columns=columns, since=since, layout=layout,
                          metric_pattern=metric_pattern, name_day_token=name_day_token)
    features = feat.build_features(logs if unique_days else materialize(logs, "telemetry"), spec, unique_days=unique_days)
    alerts = alerts_from_scores(score_days(features, featurizer, model, score_from, hi, lo))
    if not out_path:
        return alerts
    write_alerts(alerts, out_path)
    return alr.order_alerts(spark.read.schema(ALERT_SCHEMA).option("header", False).csv(out_path))
