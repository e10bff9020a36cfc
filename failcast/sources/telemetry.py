"""Telemetry and fault-log readers, feature cache and alert sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from failcast.functions.expressions import month_key, parse_day
from failcast.operators.features import cast_metrics
from failcast.schema import ALERT_SCHEMA, FAULT_RAW_SCHEMA, TELEMETRY_COLUMNS, telemetry_raw_schema


def _as_day(df: DataFrame, col: str, day_format: str = "yyyyMMdd"):
    """A DATE column from text (parsed with ``day_format``, bad text -> NULL), a timestamp
    (its date) or a date (as is)."""
    kind = df.schema[col].dataType.typeName()
    if kind == "string":
        return parse_day(col, day_format)
    return F.col(col).cast("date")


def _day_token(day) -> str:
    return str(day).replace("-", "")[:8]


def _header_of(jvm, fs, p) -> tuple:
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(fs.open(p), "UTF-8"))
    try:
        header = reader.readLine() or ""
    finally:
        reader.close()
    return tuple(h.strip().strip('"') for h in header.split(","))


def csv_header_groups(spark: SparkSession, path: str, since=None, until=None,
                      name_day_token: int | None = None, threads: int = 32, assume_header=None) -> dict:
    """CSV files under ``path`` grouped by their header line.

    Only metadata is touched: the file listing and the first line of each file (one
    short read per file, no data rows, ``threads`` reads in flight). Day folders
    (``day=yyyyMMdd``) outside ``[since, until)`` are skipped before any file is opened;
    so are files whose name carries the day as its ``name_day_token``-th ``_``-separated
    token (e.g. 4 for ``a_b_c_d_20180823.csv``) when that day is out of range. With
    ``assume_header`` no file is opened: every listed file is put under that header.
    """
    from concurrent.futures import ThreadPoolExecutor

    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    lo = _day_token(since) if since is not None else None
    hi = _day_token(until) if until is not None else None
    files = []
    it = fs.listFiles(root, True)
    while it.hasNext():
        p = it.next().getPath()
        name = p.getName()
        if not name.endswith(".csv"):
            continue
        day = next((seg[4:] for seg in p.toString().split("/") if seg.startswith("day=")), None)
        if day is None and name_day_token is not None:
            tokens = name[:-4].split("_")
            day = tokens[name_day_token][:8] if len(tokens) > name_day_token else None
        if day is not None and ((lo and day < lo) or (hi and day >= hi)):
            continue
        files.append(p)
    if assume_header is not None:
        return {tuple(assume_header): [p.toString() for p in files]} if files else {}
    groups: dict = {}
    with ThreadPoolExecutor(max_workers=max(1, min(threads, len(files)))) as pool:
        for p, key in zip(files, pool.map(lambda f: _header_of(jvm, fs, f), files)):
            groups.setdefault(key, []).append(p.toString())
    return groups


def raw_telemetry(spark: SparkSession, path: str, columns, since=None, until=None, fmt: str = "csv",
                  layout: str = "flat", name_day_token: int | None = None, match_headers: bool = True) -> DataFrame:
    """The text layer: ``columns`` projected by header name from every file (see ``read_telemetry``).

    ``match_headers=False`` is for producers that guarantee one header layout equal to
    ``columns``: no file is opened up front and Spark checks each file's header as it
    reads it (``enforceSchema=false`` fails on a mismatch instead of misreading)."""
    if fmt != "csv":
        parts = [spark.read.format(fmt).load(path)]
    else:
        groups = csv_header_groups(spark, path, since, until, name_day_token,
                                   assume_header=None if match_headers else columns)
        parts = []
        for header, files in groups.items():
            missing = [c for c in columns if c not in header]
            if missing:
                raise ValueError(f"files {files[:2]}... lack columns {missing}")
            schema = telemetry_raw_schema(list(header))
            if layout == "by_day":
                schema = schema.add("day", "string")
            reader = spark.read.schema(schema).option("header", True).option("enforceSchema", False)
            if layout == "by_day":
                reader = reader.option("basePath", path)
            parts.append(reader.csv(sorted(files)))  # exactly the files listed, subfolders included
        if not parts:
            raise FileNotFoundError(f"no CSV files under {path}")
    if layout == "by_day":
        bounded = []
        for raw in parts:
            if since is not None:
                raw = raw.filter(F.col("day") >= F.lit(_day_token(since)))
            if until is not None:
                raw = raw.filter(F.col("day") < F.lit(_day_token(until)))
            bounded.append(raw)
        parts = bounded
    raw = parts[0].select(*columns)
    for other in parts[1:]:
        raw = raw.unionByName(other.select(*columns))
    return raw


def read_telemetry(spark: SparkSession, path: str, columns=None, since=None, until=None,
                   day_format: str = "yyyyMMdd", metric_pattern: str = "smart",
                   fmt: str = "csv", layout: str = "flat", day_col: str = "dt",
                   name_day_token: int | None = None, match_headers: bool = True,
                   rejected: Observation | None = None) -> DataFrame:
    """Daily telemetry dumps -> typed device-day rows.

    CSV columns are matched to ``columns`` **by header name**: files are grouped by
    header (``csv_header_groups``); each group is one relation read in its own column
    order and projected by name, and groups are combined with ``unionByName``. Metrics are cast with
    ``try_cast``, the day parsed with ``try_to_date``; rows whose day does not parse
    are dropped and counted: an ``Observation`` passed as ``rejected`` has ``rejected_days``
    after any action on the result, from the same pass (``count_rejected_days`` reads
    the files for the count alone). Files in subfolders are read as well, whatever the
    number of header layouts.

    ``layout='by_day'`` reads dumps stored one folder per day (``day=yyyyMMdd``, see
    ``write_daily_csv``): ``since``/``until`` then become partition filters and whole
    days are skipped at listing time. In a flat folder whose file names carry the day
    (``name_day_token``), out-of-range files are skipped at listing time. In every
    layout the day bound also sits below any later window.
    """
    columns = list(columns or TELEMETRY_COLUMNS)
    raw = raw_telemetry(spark, path, columns, since, until, fmt, layout, name_day_token, match_headers)
    df = raw.withColumn(day_col, _as_day(raw, day_col, day_format))
    df = cast_metrics(df, [c for c in columns if metric_pattern in c])
    if rejected is not None:
        df = df.observe(rejected, F.count_if(F.col(day_col).isNull()).alias("rejected_days"))
    df = df.filter(F.col(day_col).isNotNull())
    if since is not None:
        df = df.filter(F.col(day_col) >= F.lit(since).cast("date"))
    if until is not None:
        df = df.filter(F.col(day_col) < F.lit(until).cast("date"))
    return df


def write_daily_csv(df: DataFrame, path: str, day_col: str = "dt", day_format: str = "yyyyMMdd",
                    mode: str = "overwrite") -> None:
    """Telemetry as daily text dumps: CSV with header, every value as text, one folder per day."""
    text = df.select(*[F.date_format(F.col(c), day_format).alias(c) if c == day_col else F.col(c).cast("string")
                       for c in df.columns])
    (text.withColumn("day", F.col(day_col))
     .write.mode(mode).partitionBy("day").option("header", True).csv(path))


def count_rejected_days(spark: SparkSession, path: str, columns=None, day_format: str = "yyyyMMdd",
                        layout: str = "flat", day_col: str = "dt") -> DataFrame:
    """How many raw rows have a NULL or unparseable day (one-row result)."""
    raw = raw_telemetry(spark, path, list(columns or TELEMETRY_COLUMNS), layout=layout)
    return raw.agg(F.count_if(parse_day(day_col, day_format).isNull()).alias("rejected_days"))


def read_faults(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Fault log: ``manufacturer, model, serial_number`` and ``fault_time`` as DATE, taken by name.

    Other columns and any column order are accepted, and files of several layouts may lie
    together. The time may be yyyy-MM-dd or yyyyMMdd text, with or without a time part,
    or a date or timestamp; text of another form gives NULL.
    """
    names = [f.name for f in FAULT_RAW_SCHEMA.fields]
    raw = raw_telemetry(spark, path, names) if fmt == "csv" else spark.read.format(fmt).load(path).select(*names)
    if raw.schema["fault_time"].dataType.typeName() != "string":
        return raw.withColumn("fault_time", F.col("fault_time").cast("date"))
    return raw.withColumn("fault_time", F.coalesce(parse_day("fault_time", "yyyy-MM-dd"), parse_day("fault_time", "yyyyMMdd")))


def write_features(df: DataFrame, path: str, day_col: str = "dt") -> None:
    """Feature cache: parquet partitioned by month so later day filters prune files."""
    (df.withColumn("month", month_key(day_col))
       .write.mode("overwrite").partitionBy("month").parquet(path))


def read_features(spark: SparkSession, path: str) -> DataFrame | None:
    """Typed feature cache, or None when no complete write exists at ``path``."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")):
        return None
    return spark.read.parquet(path)


def write_alerts(alerts: DataFrame, path: str, single_file: bool = False) -> None:
    """Headerless CSV ``manufacturer,model,serial_number,dt`` ordered by day then serial.

    The part files hold consecutive ranges: read in the order of their names they are the
    ordered alert list. ``single_file`` writes one file in one task, for small fleets.
    """
    cols = [f.name for f in ALERT_SCHEMA.fields]
    rows = alerts.select(*[F.col(c).cast(t.dataType) for c, t in zip(cols, ALERT_SCHEMA.fields)])
    order = ["dt", "serial_number", "model", "manufacturer"]
    rows = rows.repartition(1) if single_file else rows.repartitionByRange(*order)
    rows.sortWithinPartitions(*order).write.mode("overwrite").option("header", False).csv(path)


def write_importance(importance: DataFrame, path: str) -> None:
    """Feature importance (feature, importance) as JSON lines; the table is one row per feature."""
    importance.coalesce(1).write.mode("overwrite").json(path)
