"""The supplied tables standing in for telemetry.

``events`` rolls up into one row per (user, day) - a device-day - with one metric
per event type; error events above a value form the fault log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from failcast.schema import FeatureSpec

# Fixed values of the stand-in mapping.
EVENT_TYPES = ["click", "view", "error", "purchase", "signup"]
EVENT_METRICS = [f"m_{t}" for t in EVENT_TYPES]
FAULT_EVENT_TYPE = "error"
FAULT_VALUE_OVER = 200.0
STANDIN_HORIZON_DAYS = 7

# The telemetry recipe re-aimed at the five event metrics: windows on all of them,
# logs on four, one interaction, one weighted sum and its pairwise sums.
EVENTS_SPEC = FeatureSpec(
    window_cols=tuple(EVENT_METRICS),
    log_cols=("m_click", "m_view", "m_error", "m_purchase"),
    weights={"m_click": 12.0, "m_view": 16.0, "m_error": 18.0, "m_purchase": 15.0},
    pair_cols=("m_click", "m_view", "m_error", "m_purchase"),
    interaction=("m_error", "window_7_range_m_error"),
)


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _device_columns(user_col: str = "user_id"):
    return [
        F.col(user_col).alias("serial_number"),
        F.lit("A").alias("manufacturer"),
        (F.col(user_col) % 2 + 1).alias("model"),
    ]


def device_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (device, day): the events roll-up.

    A conditional sum per event type in one aggregation (partial aggregation runs
    map-side, so a user or a day holding most events is pre-reduced before the shuffle).
    Days without an event of a type give NULL; days without events give no row.
    """
    ev = load_table(spark, sf_dir, "events").select("user_id", "ts", "event_type", "value")
    metrics = [F.sum(F.when(F.col("event_type") == t, F.col("value"))).alias(f"m_{t}") for t in EVENT_TYPES]
    return (ev.groupBy(*_device_columns(), F.col("ts").cast("date").alias("dt"))
            .agg(*metrics))


def event_fault_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fault log: one tag per error event above the value bar (several per device possible)."""
    ev = load_table(spark, sf_dir, "events")
    return (ev.filter((F.col("event_type") == FAULT_EVENT_TYPE) & (F.col("value") > FAULT_VALUE_OVER))
            .select(*_device_columns(), F.col("ts").cast("date").alias("fault_time")))


# Long histories: suppliers as devices, ship days as days, four line metrics; several
# lines per supplier-day, so same-day rows are peers.
LINEITEM_METRICS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINEITEM_SPEC = FeatureSpec(
    window_cols=tuple(LINEITEM_METRICS),
    log_cols=("l_quantity", "l_extendedprice"),
    weights={"l_quantity": 12.0, "l_extendedprice": 16.0, "l_discount": 18.0},
    pair_cols=("l_quantity", "l_extendedprice", "l_discount"),
    interaction=("l_extendedprice", "window_7_range_l_extendedprice"),
)


def supplier_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item: supplier as device, ship day as day (not unique per day)."""
    li = load_table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey"), F.col("l_linenumber"), *_device_columns("l_suppkey"),
                     F.col("l_shipdate").cast("date").alias("dt"),
                     *[(F.col(m) + F.lit(0.0)).alias(m) for m in LINEITEM_METRICS])


def scored_documents(spark: SparkSession, sf_dir: str, label_col: str = "quality") -> DataFrame:
    """Labelled documents with their length as the score."""
    labels = load_table(spark, sf_dir, "labels").select("doc_id", F.col(label_col).alias("label"))
    docs = load_table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("probability"))
    return labels.join(docs, "doc_id")


def smart_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SMART-shaped telemetry derived from ``lineitem`` by a fixed rule, to run the real
    recipe (its column lists and constants) on volume data: suppliers are disks, ship days
    are days, and the j-th of the 29 metrics is ``quantity * (j % 5 + 1) + discount * 100
    * (j % 3) + tax * 100 * (j % 7)``, NULL on lines whose number is ``j % 7 + 1``."""
    from failcast.schema import TELEMETRY_COLUMNS

    li = load_table(spark, sf_dir, "lineitem")
    metrics = [c for c in TELEMETRY_COLUMNS if "smart" in c]
    cols = [F.concat(F.lit("disk_"), F.col("l_suppkey").cast("string")).alias("serial_number"),
            F.lit("A").alias("manufacturer"), (F.col("l_suppkey") % 2 + 1).cast("string").alias("model"),
            F.col("l_shipdate").cast("date").alias("dt")]
    for j, m in enumerate(metrics):
        v = (F.col("l_quantity") * F.lit(float(j % 5 + 1)) + F.col("l_discount") * F.lit(100.0 * (j % 3))
             + F.col("l_tax") * F.lit(100.0 * (j % 7)))
        cols.append(F.when(F.col("l_linenumber") != F.lit(j % 7 + 1), v).alias(m))
    return li.select(*cols)
