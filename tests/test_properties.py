"""Property and layout-independence checks (small random inputs, few examples: each runs Spark jobs)."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from failcast.functions.expressions import hash_order
from failcast.operators import alerts as alr
from failcast.operators import features as feat
from failcast.operators import sampling as smp
from failcast.sources.standins import EVENTS_SPEC, device_day
from tests.conftest import SF001

D0 = dt.date(2024, 1, 1)
rows_strategy = st.lists(
    st.tuples(st.sampled_from(["a", "b"]), st.integers(0, 40), st.one_of(st.none(), st.floats(-50, 50))),
    min_size=1, max_size=40)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows_strategy)
def test_range_nonnegative_and_monotone_in_width(spark, data):
    df = spark.createDataFrame([(s, "1", D0 + dt.timedelta(days=d), v) for s, d, v in data],
                               "serial_number string, model string, dt date, x double")
    narrow = feat.trailing_features(df, ["x"], days=7, prefix="n_")
    both = feat.trailing_features(narrow, ["x"], days=14, prefix="w_").collect()
    for r in both:
        if r.n_range_x is not None:
            assert r.n_range_x >= 0
            assert r.w_range_x >= r.n_range_x


def _canon(df, cols):
    return sorted(tuple(None if r[c] is None else (round(r[c], 9) if isinstance(r[c], float) else r[c])
                        for c in cols) for r in df.collect())


def test_feature_pipeline_layout_independent(spark):
    dd = device_day(spark, SF001)
    outs = []
    for parts in (1, 4, 32):
        out = feat.build_features(dd.repartition(parts), EVENTS_SPEC, unique_days=False)
        outs.append(_canon(out, out.columns))
    assert outs[0] == outs[1] == outs[2]
    pre = feat.build_features(dd, EVENTS_SPEC, unique_days=True, num_partitions=3)
    assert _canon(pre, pre.columns) == outs[0]


def test_draw_is_subset_of_majority_and_bounded(spark):
    dd = device_day(spark, SF001).withColumn("label", (F.col("m_error") > 150).cast("int"))
    dd = dd.withColumn("p", F.coalesce(F.col("m_view"), F.lit(0.0)) / (F.coalesce(F.col("m_view"), F.lit(0.0)) + 20))
    maj, mino = dd.filter("label = 0"), dd.filter("label = 1")
    order = hash_order("serial_number", "dt", seed=1)
    out = smp.undersample_self_paced(maj, mino, order, 4, 10, 10, keep_bin=True)
    drawn = {(r.serial_number, r.dt) for r in out.filter("label = 0").collect()}
    majority = {(r.serial_number, r.dt) for r in maj.collect()}
    assert drawn <= majority
    binned = smp.hardness_bins(smp.hardness(maj, "p"), 10)
    quotas = smp.bin_quotas(binned, mino.count(), 4, 10, 10).collect()
    assert len(drawn) == sum(min(q.quota, q.n_rows) for q in quotas)
    assert sum(q.quota for q in quotas) >= mino.count()


def test_alerts_at_most_one_per_device(spark):
    dd = device_day(spark, SF001).withColumn("probability", F.coalesce(F.col("m_click"), F.lit(0.0)) / 100)
    first = alr.first_alerts(alr.threshold_alerts(dd, "probability", 0.3))
    n_dev = dd.select("serial_number").distinct().count()
    assert first.count() <= n_dev
    assert first.groupBy("manufacturer", "model", "serial_number").count().filter("count > 1").count() == 0
