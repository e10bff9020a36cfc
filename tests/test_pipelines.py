"""End to end: training plan on the stand-in tables, then the batch scoring job over daily dumps."""

import pathlib
import uuid

from pyspark.sql import functions as F

from failcast.operators import metrics as met
from failcast.plans import evaluation, scoring, training
from failcast.schema import ALERT_SCHEMA
from failcast.sources.standins import EVENTS_SPEC, device_day, event_fault_tags
from failcast.scratch import shared_dir
from failcast.sources.telemetry import write_daily_csv
from tests.conftest import SF01


def test_train_score_alert_file(spark):
    dd = device_day(spark, SF01)
    cfg = training.TrainConfig(train=("2024-01-01", "2024-01-15"), test=("2024-01-22", "2024-01-31"),
                               tags_end="2024-01-31", horizon_days=7, spec=EVENTS_SPEC, unique_days=True,
                               n_estimators=3, k_bins=10, learner=dict(n_trees=5, max_depth=3), leak_guard=False)
    feats = training.feature_table(spark, dd, EVENTS_SPEC, cache_path=shared_dir(spark, f"fc-{uuid.uuid4().hex}"),
                                   unique_days=True)
    featurizer, model, labelled = training.train(spark, feats, event_fault_tags(spark, SF01), cfg)
    assert len(model.members) == 3

    test = labelled.filter((F.col("dt") >= "2024-01-22") & (F.col("dt") < "2024-01-31"))
    scored = model.transform(featurizer.transform(test))
    report = evaluation.ranking_report(scored)
    assert 0.0 <= report["pr_auc"] <= 1.0 and report["roc_auc"] > 0.5
    sweep = evaluation.alert_report(scored, event_fault_tags(spark, SF01), cfg.test, [0.3, 0.5, 0.7], 7).collect()
    assert len(sweep) == 3 and all(0.0 <= r.precision <= 1.0 for r in sweep)

    logs = shared_dir(spark, f"logs-{uuid.uuid4().hex}")
    write_daily_csv(dd, logs)
    out = shared_dir(spark, f"alerts-{uuid.uuid4().hex}")
    alerts = scoring.run(spark, logs, featurizer, model, "2024-01-22", out, spec=EVENTS_SPEC, hi=0.5, lo=0.5,
                         columns=dd.columns, metric_pattern="m_")
    parts = sorted(pathlib.Path(out.removeprefix("file:")).glob("part-*.csv"))
    written = [r for p in parts for r in spark.read.schema(ALERT_SCHEMA).csv(str(p)).collect()]
    assert len(written) == alerts.count() > 0
    assert all(str(r.dt) >= "2024-01-22" for r in written)
    assert [(r.dt, r.serial_number) for r in written] == sorted((r.dt, r.serial_number) for r in written)

    # the CSV path (string keys, peers path) scores the same days as the in-memory path
    direct = scoring.alerts_from_scores(scoring.score_days(feats, featurizer, model, "2024-01-22", 0.5, 0.5))
    assert sorted((str(r.serial_number), r.dt) for r in direct.collect()) == sorted(
        (r.serial_number, r.dt) for r in written)
