"""The scoring job as a Structured Streaming query over a folder of arriving daily dumps.

Trailing windows over a device's history are not streaming operators, so each
micro-batch (``foreachBatch``) reads only the look-back it needs from the stored
history, builds features for the new rows, scores them, and appends first alerts for
devices that have not alerted before. Every write is keyed by the batch id and uses
dynamic partition overwrite, so a batch replayed after a failure rewrites exactly its
own output (exactly-once results on top of the file source's offsets).

Days must arrive in order: a dump of a day that is not after all stored ones would change
features and alerts already given, so such a batch is refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from failcast.functions.expressions import parse_day
from failcast.operators import alerts as alr
from failcast.operators import features as feat
from failcast.schema import ALERT_KEYS, SCORE_THRESHOLD, SMART_SPEC, TELEMETRY_COLUMNS, FeatureSpec, telemetry_raw_schema


class DailyAlertStream:
    def __init__(self, spark: SparkSession, source_dir: str, work_dir: str, score_fn, columns=None,
                 spec: FeatureSpec = SMART_SPEC, threshold: float = SCORE_THRESHOLD, keys=ALERT_KEYS,
                 metric_pattern: str = "smart", day_format: str = "yyyyMMdd", unique_days: bool = False):
        self.spark = spark
        self.source_dir = source_dir
        self.columns = list(columns or TELEMETRY_COLUMNS)
        self.spec = spec
        self.score_fn = score_fn
        self.threshold = float(threshold)
        self.keys = list(keys)
        self.metric_pattern = metric_pattern
        self.day_format = day_format
        self.unique_days = unique_days
        base = work_dir.rstrip("/")
        self.history_path = f"{base}/history"
        self.alerts_path = f"{base}/alerts"
        self.checkpoint_path = f"{base}/_checkpoint"

    # -- reading ---------------------------------------------------------------
    def _typed(self, raw: DataFrame) -> DataFrame:
        df = raw.select(*self.columns).withColumn(self.spec.day_col, parse_day(self.spec.day_col, self.day_format))
        df = feat.cast_metrics(df, [c for c in self.columns if self.metric_pattern in c])
        return df.filter(F.col(self.spec.day_col).isNotNull())

    def _exists(self, path: str) -> bool:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    # -- one micro-batch ---------------------------------------------------------
    def _process(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        day = self.spec.day_col
        new = self._typed(batch).withColumn("_batch", F.lit(batch_id)).persist()
        try:
            self._process_rows(spark, new, batch_id)
        finally:
            new.unpersist()

    def _process_rows(self, spark: SparkSession, new: DataFrame, batch_id: int) -> None:
        day = self.spec.day_col
        span = new.agg(F.min(day).alias("lo"), F.max(day).alias("hi")).first()
        if span.lo is None:
            return
        rows = new.withColumn("_new", F.lit(True))
        if self._exists(self.history_path):
            known = spark.read.parquet(self.history_path).filter(F.col("_batch") < batch_id).agg(F.max(day).alias("hi")).first().hi
            if known is not None and span.lo <= known:
                raise ValueError(f"days must arrive in order: {span.lo} came after {known}; stored alerts may be too late by then")
            since = F.date_sub(F.lit(span.lo), self.spec.window_days)
            past = (spark.read.parquet(self.history_path)
                    .filter((F.col(day) >= since) & (F.col(day) <= F.lit(span.hi)) & (F.col("_batch") < batch_id))
                    .select(*self.columns, "_batch").withColumn("_new", F.lit(False)))
            rows = rows.unionByName(past)
        features = feat.build_features(rows, self.spec, unique_days=self.unique_days).filter("_new")
        scored = self.score_fn(features.drop("_new", "_batch"))
        first = alr.first_alerts(alr.threshold_alerts(scored, "probability", self.threshold), self.keys, day)
        if self._exists(self.alerts_path):
            seen = spark.read.parquet(self.alerts_path).filter(F.col("_batch") < batch_id).select(*self.keys)
            first = first.join(seen, self.keys, "left_anti")
        (first.withColumn("_batch", F.lit(batch_id))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_batch")
         .parquet(self.alerts_path))
        (new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day, "_batch")
         .parquet(self.history_path))

    # -- driving -----------------------------------------------------------------
    def start(self, available_now: bool = True, processing_time: str | None = None):
        schema = telemetry_raw_schema(self.columns)
        src = (self.spark.readStream.schema(schema).option("header", True).option("enforceSchema", False)
               .option("recursiveFileLookup", True).csv(self.source_dir))
        writer = src.writeStream.foreachBatch(self._process).option("checkpointLocation", self.checkpoint_path)
        writer = writer.trigger(availableNow=True) if available_now else writer.trigger(
            processingTime=processing_time or "1 day")
        return writer.start()

    def alerts(self) -> DataFrame:
        """All first alerts emitted so far (one row per device), in the alert-file order."""
        return alr.order_alerts(self.spark.read.parquet(self.alerts_path).drop("_batch"))
