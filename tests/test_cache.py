import datetime as dt
import glob
import os
from dataclasses import replace

import pytest

from failcast.operators import features as feat
from failcast.plans import cache, training
from failcast.schema import FeatureSpec
from failcast.scratch import materialize

SPEC = FeatureSpec(window_cols=("m_a",), log_cols=("m_a",), weights={"m_a": 2.0, "m_b": 3.0}, pair_cols=("m_a", "m_b"))
D0 = dt.date(2024, 1, 20)


def telemetry(spark, days, extra=()):
    rows = [(f"s{i}", "A", "1", D0 + dt.timedelta(days=d), float(d * i % 7), float(i)) for d in range(days) for i in range(3)]
    return spark.createDataFrame([*rows, *extra], "serial_number string, manufacturer string, model string, dt date, m_a double, m_b double")


def files(path):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{path}/month=*/*.parquet")}


def canon(df):
    cols = sorted(set(df.columns) - {"month"})
    return sorted((tuple(None if v is None else round(v, 9) if isinstance(v, float) else str(v) for v in (r[c] for c in cols)) for r in df.collect()), key=str)


@pytest.fixture()
def path(tmp_path):
    return str(tmp_path / "features")


def same(spark, path, df, spec=SPEC):
    return canon(spark.read.parquet(path)) == canon(feat.build_features(df, spec))


def test_unchanged_telemetry_writes_nothing(spark, path):
    df = telemetry(spark, 50)
    assert cache.refresh(df, SPEC, path) == ["2024-01", "2024-02", "2024-03"] and same(spark, path, df)
    before = files(path)
    assert cache.refresh(df.repartition(5), SPEC, path) == [] and files(path) == before


def test_one_new_day_rewrites_one_month(spark, path):
    cache.refresh(telemetry(spark, 46), SPEC, path)
    before = files(path)
    df = telemetry(spark, 47)  # one day more, in March
    assert cache.refresh(df, SPEC, path) == ["2024-03"]
    after = files(path)
    assert {f for f in before if "2024-03" not in f} == {f for f in after if before.get(f) == after[f]} and same(spark, path, df)


def test_a_changed_day_reaches_the_months_that_look_back_on_it(spark, path):
    cache.refresh(telemetry(spark, 50), SPEC, path)
    late = ("s1", "A", "1", dt.date(2024, 2, 27), 900.0, 1.0)  # frames until 5 March
    df = telemetry(spark, 50, [late])
    assert cache.refresh(df, SPEC, path) == ["2024-02", "2024-03"] and same(spark, path, df)
    again = telemetry(spark, 50, [late, late])  # a repeated row is a change
    assert cache.refresh(again, SPEC, path) == ["2024-02", "2024-03"] and same(spark, path, again)
    assert cache.refresh(telemetry(spark, 50), SPEC, path) == ["2024-02", "2024-03"] and same(spark, path, telemetry(spark, 50))


def test_another_recipe_does_not_return_the_old_table(spark, path):
    df = telemetry(spark, 20)
    old = training.feature_table(spark, df, SPEC, path)
    assert "window_7_range_m_a" in old.columns
    spec = replace(SPEC, window_days=3)
    assert "window_3_range_m_a" in training.feature_table(spark, df, spec, path).columns and same(spark, path, df, spec)
    assert cache.refresh(df.withColumnRenamed("manufacturer", "maker"), spec, path) == ["2024-01", "2024-02"]
    assert cache.refresh(df, replace(spec, weights={"m_a": 2.0, "m_b": 4.0}), path) == ["2024-01", "2024-02"]


def test_months_that_vanish_and_rows_without_a_day(spark, path):
    nobody = ("s9", "A", "1", None, 1.0, 2.0)
    df = telemetry(spark, 50, [nobody])
    assert cache.refresh(df, SPEC, path) == ["2024-01", "2024-02", "2024-03", None] and same(spark, path, df)
    short = telemetry(spark, 12)
    assert cache.refresh(short, SPEC, path) == [] or same(spark, path, short)
    assert same(spark, path, short) and not glob.glob(f"{path}/month=2024-02") and not glob.glob(f"{path}/month=__HIVE*")


def test_a_refresh_cut_short_is_repeated(spark, path, monkeypatch):
    df = telemetry(spark, 20)
    cache.refresh(df, SPEC, path)
    more = telemetry(spark, 30)
    monkeypatch.setattr(cache, "_write_manifest", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        cache.refresh(more, SPEC, path)
    monkeypatch.undo()
    assert cache.refresh(more, SPEC, path) == ["2024-01", "2024-02"] and same(spark, path, more)


def test_empty_telemetry(spark, path):
    df = materialize(telemetry(spark, 3).limit(0))
    assert cache.refresh(df, SPEC, path) == [] and cache.refresh(df, SPEC, path) == []
