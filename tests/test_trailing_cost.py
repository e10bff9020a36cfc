"""What the trailing features and the rounding of query results cost, and that they stay exact."""

import datetime as dt
import math
import random

from pyspark.sql import functions as F

import __spark_entry__ as E
from failcast.operators import features as feat
from failcast.plans import driver_queries as Q
from tests.conftest import SF001


def test_frames_are_gathered_once_and_merged_without_lambdas(spark):
    """One list a frame for all metrics, plain arithmetic on it: lambdas are not compiled and took most of the time."""
    for name in ("smart_recipe", "long_history_features"):
        plan = E.queries()[name](spark, SF001)._jdf.queryExecution().optimizedPlan().toString()
        assert "lambda" not in plan and plan.count("collect_list(") == 1


def test_long_methods_are_not_fused(spark):
    """The JVM never compiles methods of over 8 000 bytes."""
    E.queries()["smart_recipe"](spark, SF001)
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_days_of_one_value_are_sent_once(spark):
    """Of a day of equal values only its count and its value are in the summary that the window's shuffle carries."""
    rows = [("a", "1", dt.date(2024, 1, d), x) for d, x in ((1, 5.5), (1, 5.5), (2, 7.0), (3, 1.0), (3, 2.0), (4, None))]
    df = spark.createDataFrame(rows, "serial_number string, model string, dt date, x double")
    out = feat.trailing_features(df, ["x"])
    window = next(line for line in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window [" in line)
    assert "collect_list(_s" in window and "max(" not in window
    got = {(r.dt.day, r.x): (r.window_7_range_x, r.window_7_std_x) for r in out.collect()}
    assert got[1, 5.5] == (0.0, 0.0) and got[4, None] == got[3, 1.0] == got[3, 2.0] == (6.0, got[3, 2.0][1])
    values = [5.5, 5.5, 7.0, 1.0, 2.0]
    assert math.isclose(got[4, None][1], math.sqrt(sum((v - 4.2) ** 2 for v in values) / 4), rel_tol=1e-14)


def test_whole_numbers_and_other_frames(spark):
    rows = [(str(i % 3), "1", dt.date(2024, 1, 1) + dt.timedelta(i), i * i, i % 5 + 0.5) for i in range(60)]
    df = spark.createDataFrame(rows, "serial_number string, model string, dt date, n int, x double")
    for days in (0, 2, 30):
        a, b = (sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in d.fillna(-1.0).collect())
                for d in (feat.trailing_features(df, ["n", "x"], days=days), feat.trailing_features(df, ["n", "x"], days=days, unique_days=True)))
        assert a == b
    assert feat.trailing_features(df, ["n"]).schema["window_7_range_n"].dataType.typeName() == "integer"


def test_rounding_equals_round(spark):
    rng = random.Random(3)
    values = [0.0, -0.0, 0.5e-6, 1.5e-6, -2.5e-6, 1e-7, -1e-7, 999999.9999995, 1e6, 1234567.1234565, 1e300, -1e15, float("inf"), float("-inf"), float("nan"), None]
    values += [rng.choice([1, -1]) * rng.random() * 10 ** rng.randint(-8, 9) for _ in range(4000)]
    values += [round(rng.uniform(-500, 500), 6) + 5e-7 for _ in range(2000)] + [rng.randint(-10 ** 7, 10 ** 7) / 2 ** 7 for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = df.select("x", Q._rounded("x").alias("fast"), F.round("x", 6).alias("plain")).collect()
    assert all(repr(r.fast) == repr(r.plain) for r in got)
