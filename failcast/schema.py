"""Table schemas and the fixed feature recipe of the telemetry pipeline."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# These must equal the reference recipe for the same features.
# ---------------------------------------------------------------------------
ID_COLUMNS = ["serial_number", "manufacturer", "model", "dt"]

TELEMETRY_COLUMNS = [
    "serial_number", "manufacturer", "model", "dt",
    "smart_12raw", "smart_187_normalized", "smart_187raw",
    "smart_188_normalized", "smart_188raw", "smart_190_normalized", "smart_190raw",
    "smart_191_normalized", "smart_191raw", "smart_192raw", "smart_193raw", "smart_194_normalized",
    "smart_194raw", "smart_195_normalized", "smart_195raw", "smart_197_normalized",
    "smart_197raw", "smart_198_normalized", "smart_198raw", "smart_199raw", "smart_1_normalized",
    "smart_3_normalized", "smart_4raw", "smart_5_normalized", "smart_5raw", "smart_7_normalized",
    "smart_7raw", "smart_9_normalized", "smart_9raw",
]

# trailing 7-day range and std are taken on these metrics (raw values)
SMART_WINDOW_COLUMNS = [
    "smart_1_normalized", "smart_5raw", "smart_7_normalized", "smart_194raw", "smart_199raw",
    "smart_190raw", "smart_191raw", "smart_193raw", "smart_195_normalized", "smart_195raw",
]

# log2(x + 1) is applied to these metrics after their window features
SMART_LOG_COLUMNS = [
    "smart_4raw", "smart_5raw", "smart_191raw", "smart_187raw", "smart_197raw", "smart_198raw",
    "smart_199raw",
]

# smart_199raw := log2(smart_199raw + 1) * window_7_range_smart_199raw
SMART_INTERACTION = ("smart_199raw", "window_7_range_smart_199raw")

# anomaly_sum = sum(col / divisor); afterwards each col is divided in place
SMART_WEIGHTS = {
    "smart_4raw": 12.0,
    "smart_5raw": 16.0,
    "smart_191raw": 18.0,
    "smart_198raw": 18.0,
    "smart_197raw": 18.0,
    "smart_187raw": 15.0,
}

# all pairwise sums sum_<a>_<b> over these scaled columns, in this order
SMART_PAIR_COLUMNS = [
    "smart_4raw", "smart_5raw", "smart_187raw", "smart_191raw", "smart_197raw", "smart_198raw",
]

# columns that are never model inputs; `model` is appended last as a categorical
NON_FEATURE_COLUMNS = ["label", "dt", "serial_number", "month", "manufacturer", "fault_time", "model"]

WINDOW_DAYS = 7
HORIZON_DAYS = 30
SCORE_THRESHOLD = 0.715
SAMPLE_SEED = 2019
SAMPLE_PER_GROUP = 2
# end of fixed values
# ---------------------------------------------------------------------------

WINDOW_KEYS = ["model", "serial_number"]
FAULT_KEYS = ["serial_number", "model", "manufacturer"]
EVAL_KEYS = ["model", "serial_number"]
ALERT_KEYS = ["manufacturer", "model", "serial_number"]


def telemetry_raw_schema(columns=None) -> T.StructType:
    """The raw layer: every column is text, as in daily CSV dumps."""
    return T.StructType([T.StructField(c, T.StringType(), True) for c in (columns or TELEMETRY_COLUMNS)])


FAULT_RAW_SCHEMA = T.StructType([
    T.StructField("manufacturer", T.StringType(), True),
    T.StructField("model", T.StringType(), True),
    T.StructField("serial_number", T.StringType(), True),
    T.StructField("fault_time", T.StringType(), True),
])

ALERT_SCHEMA = T.StructType([
    T.StructField("manufacturer", T.StringType(), True),
    T.StructField("model", T.StringType(), True),
    T.StructField("serial_number", T.StringType(), True),
    T.StructField("dt", T.DateType(), False),
])


@dataclass(frozen=True)
class FeatureSpec:
    """Which columns get which feature treatment. Column roles, not data."""

    window_cols: tuple
    log_cols: tuple
    weights: dict
    pair_cols: tuple
    interaction: tuple | None = None
    keys: tuple = tuple(WINDOW_KEYS)
    day_col: str = "dt"
    window_days: int = WINDOW_DAYS
    sum_col: str = "anomaly_sum"

    @property
    def prefix(self) -> str:
        return f"window_{self.window_days}_"

    def range_name(self, c: str) -> str:
        return f"{self.prefix}range_{c}"

    def std_name(self, c: str) -> str:
        return f"{self.prefix}std_{c}"

    def window_names(self) -> list:
        out = []
        for c in self.window_cols:
            out += [self.range_name(c), self.std_name(c)]
        return out

    def pair_names(self) -> list:
        cols = list(self.pair_cols)
        return [f"sum_{a}_{b}" for i, a in enumerate(cols) for b in cols[i + 1:]]


SMART_SPEC = FeatureSpec(
    window_cols=tuple(SMART_WINDOW_COLUMNS),
    log_cols=tuple(SMART_LOG_COLUMNS),
    weights=dict(SMART_WEIGHTS),
    pair_cols=tuple(SMART_PAIR_COLUMNS),
    interaction=SMART_INTERACTION,
)


def metric_columns(df, pattern: str = "smart") -> list:
    """Metric columns picked by a name substring, in schema order."""
    return [f.name for f in df.schema.fields if pattern in f.name]
