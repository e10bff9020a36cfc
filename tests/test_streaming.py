import uuid

from pyspark.sql import functions as F

from failcast.operators import alerts as alr
from failcast.operators import features as feat
from failcast.sources.standins import EVENTS_SPEC, device_day
from failcast.scratch import shared_dir
from failcast.sources.telemetry import write_daily_csv
from failcast.streaming import DailyAlertStream
from tests.conftest import SF001


def _score(df):
    r = F.coalesce(F.col("window_7_range_m_error"), F.lit(0.0))
    return df.withColumn("probability", r / (r + F.lit(50.0)))


def test_stream_matches_batch_first_alerts(spark):
    dd = device_day(spark, SF001)
    cols = ["serial_number", "manufacturer", "model", "dt"] + [c for c in dd.columns if c.startswith("m_")]
    dd = dd.select(*[F.col(c).cast("string") if c in ("serial_number", "model") else F.col(c) for c in cols])
    base = shared_dir(spark, f"stream-test-{uuid.uuid4().hex}")
    src = f"{base}/src"
    cut = "2024-01-16"
    write_daily_csv(dd.filter(F.col("dt") < cut), src)
    stream = DailyAlertStream(spark, src, f"{base}/work", _score, columns=cols, spec=EVENTS_SPEC,
                              threshold=0.5, metric_pattern="m_")
    stream.start().awaitTermination()
    write_daily_csv(dd.filter(F.col("dt") >= cut), src, mode="append")
    stream.start().awaitTermination()
    got = sorted((r.serial_number, r.dt) for r in stream.alerts().collect())

    batch = _score(feat.build_features(dd, EVENTS_SPEC))
    want = alr.first_alerts(alr.threshold_alerts(batch, "probability", 0.5))
    assert got == sorted((r.serial_number, r.dt) for r in want.collect())
    assert len(got) > 0


def test_late_days_are_refused(spark):
    import pytest
    dd = device_day(spark, SF001)
    cols = ["serial_number", "manufacturer", "model", "dt"] + [c for c in dd.columns if c.startswith("m_")]
    dd = dd.select(*[F.col(c).cast("string") if c in ("serial_number", "model") else F.col(c) for c in cols])
    base = shared_dir(spark, f"stream-test-{uuid.uuid4().hex}")
    stream = DailyAlertStream(spark, f"{base}/src", f"{base}/work", _score, columns=cols, spec=EVENTS_SPEC, threshold=0.5, metric_pattern="m_")
    write_daily_csv(dd.filter("dt >= '2024-01-10' AND dt < '2024-01-12'"), f"{base}/src")
    stream.start().awaitTermination()
    write_daily_csv(dd.filter("dt = '2024-01-05'"), f"{base}/src", mode="append")
    with pytest.raises(Exception, match="arrive in order"):
        stream.start().awaitTermination()
