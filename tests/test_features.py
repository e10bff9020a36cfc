import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from failcast.functions.expressions import log2p1, parse_day
from failcast.operators import features as feat
from failcast.schema import SMART_SPEC, TELEMETRY_COLUMNS, metric_columns

D0 = dt.date(2024, 1, 1)


def day(n):
    return D0 + dt.timedelta(days=n - 1)


def frame(spark, data):
    return spark.createDataFrame([(s, m, day(d), v) for s, m, d, v in data],
                                 "serial_number string, model string, dt date, x double")


PATHS = [dict(unique_days=True), dict()]   # plain window, daily summaries


@pytest.mark.parametrize("path", PATHS)
def test_frame_width_is_eight_calendar_days(spark, path):
    df = frame(spark, [("a", "1", 1, 1.0), ("a", "1", 8, 5.0), ("a", "1", 9, 2.0)])
    out = {r.dt: r for r in feat.trailing_features(df, ["x"], **path).collect()}
    assert out[day(8)].window_7_range_x == 4.0      # day 1 still inside
    assert out[day(9)].window_7_range_x == 3.0      # day 1 out
    assert out[day(1)].window_7_std_x is None       # one row: NULL std


@pytest.mark.parametrize("path", PATHS)
def test_calendar_gap(spark, path):
    df = frame(spark, [("a", "1", 1, 1.0), ("a", "1", 20, 9.0)])
    r = [r for r in feat.trailing_features(df, ["x"], **path).collect() if r.dt == day(20)][0]
    assert r.window_7_range_x == 0.0 and r.window_7_std_x is None


@pytest.mark.parametrize("path", PATHS[1:])
def test_same_day_rows_are_peers(spark, path):
    df = frame(spark, [("a", "1", 3, 1.0), ("a", "1", 3, 4.0), ("a", "1", 2, 2.0)])
    out = feat.trailing_features(df, ["x"], **path).collect()
    day3 = [r for r in out if r.dt == day(3)]
    assert len(day3) == 2
    for r in day3:
        assert r.window_7_range_x == 3.0
        assert r.window_7_std_x == pytest.approx(math.sqrt(7.0 / 3.0))


def test_null_metric_ignored(spark):
    df = frame(spark, [("a", "1", 1, 1.0), ("a", "1", 2, None), ("a", "1", 3, 3.0)])
    for path in PATHS:
        r = [r for r in feat.trailing_features(df, ["x"], **path).collect() if r.dt == day(3)][0]
        assert r.window_7_range_x == 2.0
        assert r.window_7_std_x == pytest.approx(math.sqrt(2.0))


def test_both_paths_agree_on_real_data(spark):
    from failcast.sources.standins import EVENT_METRICS, device_day
    from tests.conftest import SF001
    dd = device_day(spark, SF001)
    a = feat.trailing_features(dd, EVENT_METRICS, unique_days=True)
    b = feat.trailing_features(dd, EVENT_METRICS)
    cols = [c for c in a.columns if c.startswith("window_")]
    key = ["serial_number", "dt"]

    def as_map(df):
        return {tuple(r[k] for k in key): [None if r[c] is None else round(r[c], 9) for c in cols] for r in df.collect()}
    assert as_map(a) == as_map(b)


def test_bad_numbers_become_null(spark):
    df = spark.createDataFrame([("abc",), ("",), ("NaN",), ("1.5",)], "x string")
    got = [r.x for r in feat.cast_metrics(df, ["x"]).collect()]
    assert got == [None, None, None, 1.5]


def test_bad_days_parse_to_null(spark):
    df = spark.createDataFrame([(None,), ("2018",), ("20181340",), ("20180823",)], "d string")
    got = [r.d for r in df.select(parse_day("d").alias("d")).collect()]
    assert got == [None, None, None, dt.date(2018, 8, 23)]


def test_log_domain(spark):
    df = spark.createDataFrame([(-1.0,), (-2.0,), (0.0,), (3.0,)], "x double")
    assert [r.y for r in df.select(log2p1("x").alias("y")).collect()] == [None, None, 0.0, 2.0]


def test_weighted_sum_null_propagates_and_pairs(spark):
    df = spark.createDataFrame([(12.0, 16.0), (None, 16.0)], "a double, b double")
    out = feat.weighted_sum(df, {"a": 12.0, "b": 16.0}, "s").collect()
    assert out[0].s == 2.0 and out[1].s is None
    pairs = feat.pairwise_sums(df, ["a", "b"]).collect()
    assert pairs[0].sum_a_b == 28.0 and pairs[1].sum_a_b is None


def test_smart_recipe_has_66_features(spark):
    schema = ", ".join(f"{c} string" for c in TELEMETRY_COLUMNS)
    raw = spark.createDataFrame([tuple(["s1", "A", "1", "20180801"] + ["1"] * 29)], schema)
    df = feat.cast_metrics(raw.withColumn("dt", parse_day("dt")), metric_columns(raw))
    out = feat.build_features(df, SMART_SPEC)
    from failcast.operators.ensemble import feature_columns
    cols = feature_columns(out)
    assert len(cols) == 66 and cols[-1] == "model"
    r = out.first()
    # windows see raw values; the 199 interaction multiplies the log by the raw range (0 here)
    assert r.window_7_range_smart_199raw == 0.0 and r.smart_199raw == 0.0
    assert r.anomaly_sum == pytest.approx(1 / 12 + 1 / 16 + 1 / 18 + 1 / 18 + 1 / 18 + 1 / 15)
    assert r.smart_4raw == pytest.approx(1 / 12)  # log2(1+1) / 12
    assert r.sum_smart_4raw_smart_5raw == pytest.approx(1 / 12 + 1 / 16)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_window_one_exchange_no_python(spark):
    from failcast.sources.standins import EVENTS_SPEC, device_day
    from tests.conftest import SF001
    dd = device_day(spark, SF001)
    plan = dd.transform(lambda d: feat.trailing_features(d, EVENTS_SPEC.window_cols, unique_days=True)) \
        ._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 1
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    full = feat.build_features(dd, EVENTS_SPEC, unique_days=True)
    plan = full._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1


def test_peers_agree_with_the_plain_window(spark):
    """The daily path gives what a RANGE frame over the rows gives, NULL keys included."""
    from failcast.sources.standins import supplier_days
    from tests.conftest import SF001
    sd = supplier_days(spark, SF001).select("model", F.when(F.col("serial_number") % 3 > 0, F.col("serial_number")).alias("serial_number"), "dt", "l_tax")

    def canon(df):
        return sorted(((r.serial_number, r.dt, r.l_tax) + tuple(
            None if r[c] is None else round(r[c], 9) for c in ("window_7_range_l_tax", "window_7_std_l_tax"))
            for r in df.collect()), key=str)
    daily = canon(feat.trailing_features(sd, ["l_tax"]))
    assert daily == canon(feat.trailing_features(sd, ["l_tax"], unique_days=True)) and len(daily) == sd.count()


@pytest.mark.parametrize("path", PATHS)
def test_all_null_frame(spark, path):
    df = frame(spark, [("a", "1", 1, 2.0), ("a", "1", 20, None), ("a", "1", 21, None), ("b", "1", 1, None)])
    out = {(r.serial_number, r.dt): r for r in feat.trailing_features(df, ["x"], **path).collect()}
    assert out[("a", day(21))].window_7_range_x is None and out[("a", day(21))].window_7_std_x is None
    assert out[("b", day(1))].window_7_range_x is None and out[("b", day(1))].window_7_std_x is None


def test_model_inputs_in_reference_order(spark):
    """Metrics in telemetry order, then range and std of the windowed metrics in telemetry order, the sum, the pairs, model."""
    from failcast.operators.ensemble import feature_columns
    from failcast.schema import SMART_PAIR_COLUMNS, SMART_WINDOW_COLUMNS
    raw = spark.createDataFrame([], ", ".join(f"{c} {'date' if c == 'dt' else 'double' if 'smart' in c else 'string'}" for c in TELEMETRY_COLUMNS))
    metrics = TELEMETRY_COLUMNS[4:]
    want = metrics + [f"window_7_{k}_{m}" for m in metrics if m in SMART_WINDOW_COLUMNS for k in ("range", "std")] + ["anomaly_sum"]
    pairs = list(SMART_PAIR_COLUMNS)
    want += [f"sum_{a}_{b}" for i, a in enumerate(pairs) for b in pairs[i + 1:]] + ["model"]
    assert feature_columns(feat.build_features(raw, SMART_SPEC)) == want
    assert want[29:31] == ["window_7_range_smart_190raw", "window_7_std_smart_190raw"] and len(want) == 66


def test_day_text_with_time_part(spark):
    df = spark.createDataFrame([("20180702000000",), ("20180702",), ("2018-07-02",)], "d string")
    assert [r.d for r in df.select(parse_day("d").alias("d")).collect()] == [dt.date(2018, 7, 2)] * 2 + [None]


def exact_std(values):
    from fractions import Fraction
    values = [Fraction(v) for v in values if v is not None]
    if len(values) < 2:
        return None
    mean = sum(values) / len(values)
    return math.sqrt(sum((v - mean) ** 2 for v in values) / (len(values) - 1))


def trailing(data, at):
    """Values of the same device in the eight days up to ``at``'s."""
    return [v for s, m, d, v in data if (s, m) == at[:2] and at[2] - 7 <= d <= at[2]]


@pytest.mark.parametrize("path", PATHS)
def test_std_keeps_its_digits_when_a_counter_jumps(spark, path):
    values = [5.1, 6.1, 5.1, 5.1, 6.1, 6.1, 5.1, 6.1, 1e9, 1e9 + 1, 1e9, 1e9 + 1, 1e9, 1e9, 1e9 + 1, 1e9, 1e9]
    data = [("a", "1", d, v) for d, v in enumerate(values, 1)] + [("b", "1", d, 0.1) for d in range(1, 12)]
    for r in feat.trailing_features(frame(spark, data), ["x"], **path).collect():
        at = (r.serial_number, "1", (r.dt - D0).days + 1)
        want = exact_std(trailing(data, at))
        rel = 1e-7 if path else 1e-9  # Spark's own function over the plain window is the looser one
        assert r.window_7_std_x == (want if want is None else pytest.approx(want, rel=rel, abs=1e-15))


def test_std_equals_the_exact_one_at_any_size(spark):
    """Same-day peers, NULLs, gaps and values of 1e9 to 1e12 beside small ones."""
    import random
    rng = random.Random(4)
    data = []
    for s in range(60):
        base = rng.choice([0.0, 1e3, 1e9, 1e12])
        for d in sorted(rng.choices(range(1, 40), k=25)):
            if rng.random() < 0.1:
                base = rng.choice([0.0, 1e9, 1e10, 1e12])
            for _ in range(rng.choice([1, 1, 2, 5])):
                data.append((str(s), "1", d, None if rng.random() < 0.1 else base + rng.choice([0.0, 0.25, 1.0, 100.0])))
    got = feat.trailing_features(frame(spark, data), ["x"]).collect()
    assert len(got) == len(data)
    for r in got:
        values = trailing(data, (r.serial_number, "1", (r.dt - D0).days + 1))
        want, top = exact_std(values), max((abs(v) for v in values if v is not None), default=0)
        if want is None:
            assert r.window_7_std_x is None
        else:
            assert r.window_7_std_x == pytest.approx(want, rel=1e-9, abs=4e-16 * top + 1e-15)


def test_one_window_and_no_device_mean(spark):
    df = frame(spark, [("a", "1", 1, 1.0)])
    plan = feat.trailing_features(df, ["x"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1
