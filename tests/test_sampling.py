import datetime as dt

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from failcast.functions.expressions import hash_order
from failcast.operators import sampling as smp


def keyed(spark, n, groups, seed=0):
    rng = np.random.default_rng(seed)
    data = [(i, int(rng.integers(groups)), float(rng.random())) for i in range(n)]
    return spark.createDataFrame(data, "id long, g int, p double")


@pytest.mark.parametrize("prefix", [1, 4])
def test_draw_by_quota_equals_row_number(spark, prefix):
    df = keyed(spark, 3000, 5).withColumn("_h", hash_order("id", seed=7))
    quotas = spark.createDataFrame([(0, 0), (1, 3), (2, 250), (3, 10_000), (4, 599)], "g int, quota long")
    got = smp.draw_by_quota(df, quotas, "g", prefix_len=prefix)
    w = Window.partitionBy("g").orderBy("_h")
    ref = df.join(quotas, "g").withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= F.col("quota"))
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in ref.collect())


@pytest.mark.parametrize("n", [0, 1, 37, 2999, 5000])
def test_draw_lowest_equals_row_number(spark, n):
    df = keyed(spark, 3000, 1).withColumn("_h", hash_order("id", seed=3))
    got = smp.draw_lowest(df, F.lit(n), prefix_len=2)
    ref = df.withColumn("rn", F.row_number().over(Window.orderBy("_h"))).filter(F.col("rn") <= n)
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in ref.collect())


def test_layout_independent_draws(spark):
    df = keyed(spark, 2000, 3)
    maj, mino = df.filter("g > 0"), df.filter("g = 0").limit(100)
    outs = []
    for parts in (1, 4, 32):
        drawn = smp.undersample_random(maj.repartition(parts), mino, hash_order("id", seed=1))
        thin = smp.sample_per_group(maj.repartition(parts), ["g"], 3, 11, ["id"])
        outs.append((sorted(r.id for r in drawn.collect()), sorted(r.id for r in thin.collect())))
    assert outs[0] == outs[1] == outs[2]
    assert len(outs[0][0]) == 200 and len(outs[0][1]) == 6


def test_minority_larger_than_majority(spark):
    maj = spark.createDataFrame([(1, 0), (2, 0)], "id long, label int")
    mino = spark.createDataFrame([(3, 1), (4, 1), (5, 1)], "id long, label int")
    out = smp.undersample_random(maj, mino, hash_order("id"))
    assert out.filter("label = 0").count() == 2 and out.count() == 5


def test_equal_hardness_takes_random_path(spark):
    maj = spark.createDataFrame([(i, 0, 0.3) for i in range(50)], "id long, label int, p double")
    mino = spark.createDataFrame([(100 + i, 1, None) for i in range(7)], "id long, label int, p double")
    binned = smp.hardness_bins(smp.hardness(maj, "p"), 10)
    assert {r.bin for r in binned.collect()} == {0}
    q = smp.bin_quotas(binned, 7, 3, 10, 10).collect()
    assert [(r.bin, r.quota) for r in q] == [(0, 7)]
    out = smp.undersample_self_paced(maj, mino, hash_order("id"), 3, 10, 10)
    assert out.filter("label = 0").count() == 7


def test_empty_bin_is_skipped_and_quota_sum(spark):
    ps = [0.0] * 20 + [0.9] * 20 + [1.0] * 5            # a gap: middle bins empty
    maj = spark.createDataFrame([(i, 0, p) for i, p in enumerate(ps)], "id long, label int, p double")
    binned = smp.hardness_bins(smp.hardness(maj, "p"), 10)
    q = smp.bin_quotas(binned, 10, 2, 10, 10).collect()
    assert q == smp.bin_quotas(binned, 10, 2, 10).collect()   # subquery route agrees
    assert sorted(r.bin for r in q) == [0, 8, 9]
    assert sum(r.quota for r in q) >= 10
    last = smp.bin_quotas(binned, 10, 9, 10, 10).collect()   # last round: equal weights
    assert {r.quota for r in last} == {10 // 3 + 1}


def test_top_k_per_group_plan_has_partial_limit(spark):
    df = keyed(spark, 500, 4)
    out = smp.sample_per_group(df, ["g"], 2, 5, ["id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert out.count() == 8


def test_cohort_leak_guard(spark):
    d = dt.date(2024, 1, 1)
    rows = [("s", "1", d + dt.timedelta(days=i), d + dt.timedelta(days=20), 1 if i >= 13 else 0) for i in range(25)]
    df = spark.createDataFrame(rows, "serial_number string, model string, dt date, fault_time date, label int") \
        .withColumn("month", F.date_format("dt", "yyyy-MM"))
    loose = smp.training_cohort(df, ("2024-01-01", "2024-01-15"), "2024-02-01", 7, 2, 1, leak_guard=False)
    tight = smp.training_cohort(df, ("2024-01-01", "2024-01-15"), "2024-02-01", 7, 2, 1, leak_guard=True)
    assert loose.filter("label = 1").count() == 12       # days 14..25 (after-fault days included)
    assert tight.filter("label = 1").count() == 1        # only day 14 is before the train end
    assert loose.filter("label = 0").count() == 2


@pytest.mark.parametrize("n", [1, 150, 2500, 4000])
def test_draw_with_massive_copies(spark, n):
    """A third of the rows are copies of one row, and identities repeat with different
    content: the draw equals ranking by (key, content) and never ranks the copies one by one."""
    base = [(i % 50, float(i % 7)) for i in range(3000)] + [(7, 1.0)] * 1500
    df = spark.createDataFrame(base, "g long, v double").withColumn("_h", hash_order("g", seed=2))
    got = smp.draw_lowest(df, F.lit(n), prefix_len=1)
    ck = smp.content_key(df.columns)
    ref = df.withColumn("rn", F.row_number().over(Window.orderBy("_h", ck))).filter(F.col("rn") <= n)
    assert sorted((r.g, r.v) for r in got.collect()) == sorted((r.g, r.v) for r in ref.collect())
    dfb = df.withColumn("b", F.lit(0))
    quotas = spark.createDataFrame([(0, n)], "b int, quota long")
    by_group = smp.draw_by_quota(dfb, quotas, "b", prefix_len=1)
    ref_b = dfb.withColumn("rn", F.row_number().over(Window.partitionBy("b").orderBy("_h", smp.content_key(dfb.columns))))
    ref_b = ref_b.filter(F.col("rn") <= n)
    assert sorted((r.g, r.v) for r in by_group.collect()) == sorted((r.g, r.v) for r in ref_b.collect())


def test_replication_in_chunks(spark):
    df = spark.createDataFrame([(1, 2.0)] * 25 + [(2, 3.0)] * 4, "g long, v double").withColumn("_h", F.lit("0"))
    out = smp._take_lowest_entries(df, df.columns, F.lit(27), "_h", chunk=4).collect()
    assert len(out) == 27
    assert sorted(set((r.g, r.v) for r in out)) == [(1, 2.0), (2, 3.0)]


def test_rows_without_a_score_are_never_drawn(spark):
    maj = spark.createDataFrame([(i, 0, None if i % 3 == 0 else float("nan") if i % 3 == 1 else 0.01 * i) for i in range(90)],
                                "id long, label int, p double")
    mino = spark.createDataFrame([(1000 + i, 1, 0.5) for i in range(40)], "id long, label int, p double")
    out = smp.undersample_self_paced(maj, mino, hash_order("id"), 2, 5, 4)
    assert {r.id % 3 for r in out.filter("label = 0").collect()} == {2}
    assert {r.bin for r in smp.hardness_bins(smp.hardness(maj, "p"), 4).filter("id % 3 < 2").collect()} == {None}


def test_edges_belong_to_the_bin_that_begins_there(spark):
    lo, hi, k = 0.1, 0.7, 6
    step = (hi - lo) / k
    values = [lo + i * step for i in range(k)] + [hi, np.nextafter(lo + 3 * step, 0)]
    df = spark.createDataFrame([(float(v),) for v in values], "hardness double")
    got = [r.bin for r in smp.hardness_bins(df, k).collect()]
    assert got == [0, 1, 2, 3, 4, 5, 5, 2]


def test_range_too_small_for_steps(spark):
    df = spark.createDataFrame([(0.0,), (5e-324,)], "hardness double")
    assert {r.bin for r in smp.hardness_bins(df, 40).collect()} == {0}
    maj = spark.createDataFrame([(i, 0, 0.0) for i in range(9)], "id long, label int, p double")
    mino = spark.createDataFrame([(100, 1, 0.0)], "id long, label int, p double")
    assert smp.undersample_self_paced(maj, mino, hash_order("id"), 1, 5, 40).filter("label = 0").count() == 1


def test_paced_draw_reads_the_majority_three_times(spark, tmp_path):
    """Bounds, slice counts and the drawn rows: nothing else opens the majority's files."""
    path = str(tmp_path / "maj")
    spark.createDataFrame([(i, 0, (i % 100) / 100) for i in range(4000)], "id long, label int, p double").write.parquet(path)
    maj, mino = spark.read.parquet(path), spark.createDataFrame([(10 ** 6 + i, 1, 0.5) for i in range(300)], "id long, label int, p double")
    group = "paced-draw-reads"
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup(group, "paced draw")
    try:
        out = smp.undersample_self_paced(maj, mino, hash_order("id"), 2, 5, 10)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) - before <= 14
    assert path not in str(out.inputFiles())  # the result rests on the drawn rows that were written
    assert out.filter("label = 0").count() >= 300


@pytest.mark.parametrize("i", [1, 3, 4])
def test_paced_draw_equals_the_lazy_route(spark, i):
    rng = np.random.default_rng(i)
    maj = spark.createDataFrame([(k, 0, float(p)) for k, p in enumerate(rng.random(3000))], "id long, label int, p double")
    mino = spark.createDataFrame([(10 ** 6 + k, 1, 0.5) for k in range(200)], "id long, label int, p double")
    order = hash_order("id", seed=i)
    got = smp.undersample_self_paced(maj, mino, order, i, 5, 8)
    binned = smp.hardness_bins(smp.hardness(maj, "p"), 8).withColumn("_h", order)
    lazy = smp.draw_by_quota(binned, smp.bin_quotas(binned, 200, i, 5, 8).select("bin", "quota"), "bin")
    assert sorted(r.id for r in got.filter("label = 0").collect()) == sorted(r.id for r in lazy.collect())
