import datetime as dt

from pyspark.sql import functions as F

from failcast.operators import alerts as alr
from failcast.operators import labels as lab
from failcast.operators import metrics as met

D = dt.date(2024, 3, 1)


def test_label_edges(spark):
    fault = D + dt.timedelta(days=31)
    days = [D, D + dt.timedelta(days=1), fault, fault + dt.timedelta(days=1)]  # gaps 31, 30, 0, -1
    df = spark.createDataFrame([("s", d, fault) for d in days], "serial_number string, dt date, fault_time date")
    got = {r.dt: r.label for r in lab.label_horizon(df, 30).collect()}
    assert [got[d] for d in days] == [0, 1, 1, 1]
    strict = {r.dt: r.label for r in lab.label_horizon(df, 30, include_after=False).collect()}
    assert [strict[d] for d in days] == [0, 1, 1, 0]


def test_two_faults_dedup(spark):
    logs = spark.createDataFrame([("s", "1", "A", D)], "serial_number string, model string, manufacturer string, dt date")
    tags = spark.createDataFrame([("s", "1", "A", D), ("s", "1", "A", D + dt.timedelta(days=3))],
                                 "serial_number string, model string, manufacturer string, fault_time date")
    assert lab.attach_faults(logs, tags, dedup="none").count() == 2
    one = lab.attach_faults(logs, tags, dedup="first_fault").collect()
    assert len(one) == 1 and one[0].fault_time == D


def test_same_serial_two_manufacturers(spark):
    logs = spark.createDataFrame([("s", "1", "A", D), ("s", "1", "B", D)],
                                 "serial_number string, model string, manufacturer string, dt date")
    tags = spark.createDataFrame([("s", "1", "A", D)], "serial_number string, model string, manufacturer string, fault_time date")
    got = {r.manufacturer: r.fault_time for r in lab.attach_faults(logs, tags).collect()}
    assert got == {"A": D, "B": None}
    merged = lab.attach_faults(logs, tags, keys=["serial_number", "model"]).collect()
    assert all(r.fault_time == D for r in merged)


def test_time_split_rejects_overlap(spark):
    df = spark.createDataFrame([(D,)], "dt date")
    import pytest
    with pytest.raises(ValueError):
        lab.time_split(df, {"train": ("2017-08-01", "2018-08-01"), "val": ("2018-06-01", "2018-07-01")})
    out = lab.time_split(df, {"train": ("2017-08-01", "2018-08-01"), "val": ("2018-06-01", "2018-07-01")},
                         allow_overlap=True)
    assert set(out) == {"train", "val"}


def _metrics(spark, alerts, faults, period=("2024-03-01", "2024-04-01"), lead=30):
    a = spark.createDataFrame(alerts, "model string, serial_number string, dt date")
    f = spark.createDataFrame(faults, "model string, serial_number string, fault_time date")
    return met.alert_metrics(a, f, period, lead).first()


def test_threshold_tie_no_alert(spark):
    df = spark.createDataFrame([("s", D, 0.715)], "serial_number string, dt date, p double")
    assert alr.threshold_alerts(df, "p", 0.715).count() == 0


def test_alert_after_fault_and_early_alert(spark):
    f = D + dt.timedelta(days=10)
    after = _metrics(spark, [("1", "s", f + dt.timedelta(days=2))], [("1", "s", f)])
    assert (after.npp, after.ntpp, after.npr, after.ntpr) == (1, 1, 1, 0)  # precision yes, recall no
    early = _metrics(spark, [("1", "s", f - dt.timedelta(days=40))], [("1", "s", f)])
    assert (early.npp, early.ntpp, early.npr, early.ntpr) == (1, 0, 1, 1)  # recall yes, precision no


def test_empty_sides(spark):
    none = _metrics(spark, [], [])
    assert (none.npp, none.npr, none.precision, none.recall, none.F1) == (0, 0, 0.0, 0.0, 0.0)


def test_sweep_matches_single_threshold(spark):
    scored = spark.createDataFrame(
        [("1", "s1", D, 0.9), ("1", "s1", D + dt.timedelta(days=1), 0.2), ("1", "s2", D, 0.5),
         ("1", "s3", D + dt.timedelta(days=2), 0.7)], "model string, serial_number string, dt date, probability double")
    faults = spark.createDataFrame([("1", "s1", D + dt.timedelta(days=5)), ("1", "s3", D + dt.timedelta(days=1))],
                                   "model string, serial_number string, fault_time date")
    period = ("2024-03-01", "2024-04-01")
    sweep = {r.threshold: r for r in met.threshold_sweep(scored, faults, [0.4, 0.6, 0.8], period).collect()}
    for t in (0.4, 0.6, 0.8):
        first = alr.first_alerts(alr.threshold_alerts(scored, "probability", t), ["model", "serial_number"])
        one = met.alert_metrics(first, faults, period).first()
        assert (sweep[t].npp, sweep[t].ntpp, sweep[t].npr, sweep[t].ntpr) == (one.npp, one.ntpp, one.npr, one.ntpr)


def test_first_alert_order(spark):
    df = spark.createDataFrame([("A", "2", "disk_9", D), ("A", "2", "disk_10", D), ("A", "2", "disk_9", D - dt.timedelta(days=1))],
                               "manufacturer string, model string, serial_number string, dt date")
    out = alr.order_alerts(alr.first_alerts(df)).collect()
    assert [(r.serial_number, r.dt) for r in out] == [("disk_9", D - dt.timedelta(days=1)), ("disk_10", D)]


def test_threshold_schedule_decays_linearly(spark):
    df = spark.createDataFrame([(D,), (D + dt.timedelta(days=15),), (D + dt.timedelta(days=30),)], "dt date")
    got = [round(r.thresh, 9) for r in alr.threshold_schedule(df, 0.8, 0.5, str(D), 30).orderBy("dt").collect()]
    assert got == [0.8, 0.65, 0.5]
    flat = {r.thresh for r in alr.threshold_schedule(df, 0.715, 0.715, str(D)).collect()}
    assert flat == {0.715}


def test_sweep_spacing():
    ts = met.sweep_around(0.5)
    assert len(ts) == 9 and abs(ts[0] - 0.49) < 1e-12 and abs(ts[-1] - 0.53) < 1e-12


def test_feature_cache_needs_complete_write(spark, tmp_path):
    from failcast.sources.telemetry import read_features, write_features
    path = str(tmp_path / "cache")
    assert read_features(spark, path) is None
    df = spark.createDataFrame([("s", D, 1.0)], "serial_number string, dt date, x double")
    write_features(df, path)
    back = read_features(spark, path).collect()
    assert [(r.serial_number, r.month, r.x) for r in back] == [("s", "2024-03", 1.0)]
