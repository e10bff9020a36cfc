"""Plan shape of the operators most exposed to scale: no cartesian product, no Python node,
bounded broadcasts only where intended."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from plan_report import summarize  # noqa: E402

import __spark_entry__ as E  # noqa: E402
from tests.conftest import SF001  # noqa: E402


@pytest.mark.parametrize("name", ["trailing_peers", "undersample_random", "undersample_self_paced", "pr_curve",
                                  "threshold_sweep", "sample_per_group", "smart_recipe"])
def test_no_cartesian_no_python(spark, name):
    df = E.queries()[name](spark, SF001)
    s = summarize(df._jdf.queryExecution().executedPlan().toString())
    assert s["cartesian"] == 0 and s["python"] == 0


def test_trailing_features_have_one_path(spark):
    plan = E.queries()["trailing_peers"](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan and "LeftAnti" not in plan
