"""Driver queries: each reads the supplied tables and runs one library operator.

Every callable takes ``(spark, sf_dir)`` and returns a lazy DataFrame whose column
names equal those of the matching SQL in ``failcast.plans.oracle``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from failcast.functions.expressions import hash_order, month_key, parse_day
from failcast.operators import features as feat
from failcast.operators import alerts as alr
from failcast.operators import ensemble as ens
from failcast.operators import labels as lab
from failcast.operators import metrics as met
from failcast.operators import sampling as smp
from failcast.operators import trees
from failcast.plans import scenario as S
from failcast.schema import ALERT_SCHEMA
from failcast.sources.standins import EVENT_METRICS, EVENTS_SPEC, device_day, event_fault_tags, load_table
from failcast.scratch import materialize, shared_dir
from failcast.sources.telemetry import (
    read_faults, read_features, read_telemetry, write_alerts, write_daily_csv,
    write_features, write_importance,
)

QUERIES: dict = {}
KEYS = ["serial_number", "manufacturer", "model", "dt"]


def query(name):
    def register(fn):
        QUERIES[name] = fn
        return fn
    return register


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def _rounded(c: str):
    """``r6`` of a double column. Below a million and off the ties, the nearest integer of millionths is known without
    decimal text, and its quotient by a million is the double nearest to it."""
    x = F.col(c)
    y = x * 1e6
    below = F.floor(y)
    plain = (F.abs(y) < 1e12) & (F.abs(y - below - 0.5) > 1e-3)
    return F.when(plain, F.floor(y + 0.5) / 1e6).otherwise(F.round(x, 6))


def _doubles_rounded(df: DataFrame) -> DataFrame:
    return df.select(*[_rounded(f"`{f.name}`").alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name)
                       for f in df.schema.fields])


# --- device-day and features ------------------------------------------------

@query("device_day")
def q_device_day(spark: SparkSession, sf: str) -> DataFrame:
    return _doubles_rounded(device_day(spark, sf))


@query("trailing_range")
def q_trailing_range(spark, sf):
    df = feat.trailing_features(device_day(spark, sf), EVENT_METRICS, unique_days=True)
    return _doubles_rounded(df.select(*KEYS, *[f"window_7_range_{m}" for m in EVENT_METRICS]))


@query("trailing_std")
def q_trailing_std(spark, sf):
    df = feat.trailing_features(device_day(spark, sf), EVENT_METRICS, unique_days=True)
    return _doubles_rounded(df.select(*KEYS, *[f"window_7_std_{m}" for m in EVENT_METRICS]))


@query("trailing_peers")
def q_trailing_peers(spark, sf):
    """Raw event rows as telemetry: many rows per device-day, all peers in the frame."""
    ev = load_table(spark, sf, "events").select(
        "event_id", F.col("user_id").alias("serial_number"), (F.col("user_id") % 2 + 1).alias("model"),
        F.col("ts").cast("date").alias("dt"), "value")
    df = feat.trailing_features(ev, ["value"])
    return _doubles_rounded(df)


@query("trailing_null_device")
def q_trailing_null_device(spark, sf):
    """As ``trailing_peers``, with every fifth user unknown: NULL is a device of its own and holds a fifth of the rows."""
    user = F.when(F.col("user_id") % 5 != 0, F.col("user_id"))
    ev = load_table(spark, sf, "events").select(
        "event_id", user.alias("serial_number"), F.lit(1).alias("model"), F.col("ts").cast("date").alias("dt"), "value")
    return _doubles_rounded(feat.trailing_features(ev, ["value"]))


@query("trailing_prepartitioned")
def q_trailing_prepartitioned(spark, sf):
    """The device keys dealt into a stated number of partitions before the window."""
    df = feat.trailing_features(device_day(spark, sf), EVENT_METRICS, unique_days=True, num_partitions=16)
    return _doubles_rounded(df.select(*KEYS, *[f"window_7_{k}_{m}" for m in EVENT_METRICS for k in ("range", "std")]))


def _features(spark, sf):
    return feat.build_features(device_day(spark, sf), EVENTS_SPEC, unique_days=True)


@query("log_interaction")
def q_log_interaction(spark, sf):
    df = feat.trailing_features(device_day(spark, sf), ["m_error"], unique_days=True)
    df = feat.log_compress(df, EVENTS_SPEC.log_cols)
    df = feat.interaction(df, "m_error", "window_7_range_m_error")
    return _doubles_rounded(df.select(*KEYS, *EVENTS_SPEC.log_cols))


@query("weighted_sum")
def q_weighted_sum(spark, sf):
    return _doubles_rounded(_features(spark, sf).select(*KEYS, "anomaly_sum"))


@query("pairwise_sums")
def q_pairwise_sums(spark, sf):
    return _doubles_rounded(_features(spark, sf).select(*KEYS, *EVENTS_SPEC.pair_cols, *EVENTS_SPEC.pair_names()))


@query("feature_table")
def q_feature_table(spark, sf):
    return _doubles_rounded(_features(spark, sf))


@query("parse_day_month")
def q_parse_day_month(spark, sf):
    ev = load_table(spark, sf, "events")
    text = F.date_format(F.col("ts"), "yyyyMMdd")
    day = parse_day(text)
    return ev.select("event_id", day.alias("day"), month_key(day).alias("month"),
                     parse_day(F.substring(text, 1, 4)).alias("short_day"),
                     parse_day(F.col("props")).alias("junk_day"))


# --- faults and labels -------------------------------------------------------

@query("first_faults")
def q_first_faults(spark, sf):
    return lab.first_faults(event_fault_tags(spark, sf), ["model", "serial_number"])


@query("attach_faults")
def q_attach_faults(spark, sf):
    df = lab.attach_faults(device_day(spark, sf), event_fault_tags(spark, sf), dedup="none")
    return df.select(*KEYS, "fault_time")


def labelled(spark, sf) -> DataFrame:
    df = lab.attach_faults(device_day(spark, sf), event_fault_tags(spark, sf), dedup="first_fault")
    return lab.label_horizon(df, S.HORIZON)


@query("label_horizon")
def q_label_horizon(spark, sf):
    return labelled(spark, sf).select(*KEYS, "fault_time", "label")


@query("time_split_counts")
def q_time_split_counts(spark, sf):
    splits = {"train": S.TRAIN, "val": S.VAL, "test": S.TEST}
    df = labelled(spark, sf).withColumn("split", lab.split_label("dt", splits)).filter(F.col("split").isNotNull())
    return df.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n_rows"))


# --- sampling ---------------------------------------------------------------

def labelled_month(spark, sf) -> DataFrame:
    return lab.with_month(labelled(spark, sf))


def closed_form_score(col: str = "m_error"):
    """A deterministic stand-in score in [0, 1): x / (x + scale), NULL -> 0."""
    x = F.coalesce(F.col(col), F.lit(0.0))
    return x / (x + F.lit(S.SCORE_SCALE))


def _order():
    return hash_order("serial_number", "model", "dt", seed=S.SEED)


@query("sample_per_group")
def q_sample_per_group(spark, sf):
    df = lab.time_range(labelled_month(spark, sf), *S.TRAIN).filter(F.col("label") == 0)
    out = smp.sample_per_group(df, ["serial_number", "model", "month"], S.PER_GROUP, S.SEED,
                               ["serial_number", "model", "dt"])
    return out.select(*KEYS, "month")


@query("training_cohort")
def q_training_cohort(spark, sf):
    df = smp.training_cohort(labelled_month(spark, sf), S.TRAIN, S.TAGS_END, S.HORIZON, S.PER_GROUP, S.SEED,
                             mode="all", leak_guard=False)
    return df.select(*KEYS, "label")


@query("faulty_only_cohort")
def q_faulty_only_cohort(spark, sf):
    df = smp.training_cohort(labelled_month(spark, sf), S.TRAIN, S.TAGS_END, S.HORIZON, S.PER_GROUP, S.SEED,
                             mode="faulty_only", leak_guard=False)
    return df.select(*KEYS, "label")


def _classes(spark, sf):
    """Scored device-days split by class; written once because the draws read them in several passes."""
    df = materialize(labelled(spark, sf).select(*KEYS, "label", closed_form_score().alias("p")))
    return df.filter(F.col("label") == 0), df.filter(F.col("label") == 1)


@query("undersample_random")
def q_undersample_random(spark, sf):
    maj, mino = _classes(spark, sf)
    return smp.undersample_random(maj, mino, _order()).select(*KEYS, "label")


@query("hardness_bins")
def q_hardness_bins(spark, sf):
    maj, _ = _classes(spark, sf)
    out = smp.hardness_bins(smp.hardness(maj, "p"), S.K_BINS)
    return out.select(*KEYS, r6("hardness").alias("hardness"), "bin")


@query("bin_quotas")
def q_bin_quotas(spark, sf):
    maj, mino = _classes(spark, sf)
    binned = smp.hardness_bins(smp.hardness(maj, "p"), S.K_BINS)
    n_min = mino.select(F.count(F.lit(1))).scalar()
    out = smp.bin_quotas(binned, n_min, S.ROUND, S.N_ROUNDS, S.K_BINS)
    return out.select("bin", "n_rows", r6("mean_hardness").alias("mean_hardness"), r6("weight").alias("weight"), "quota")


@query("undersample_self_paced")
def q_undersample_self_paced(spark, sf):
    maj, mino = _classes(spark, sf)
    out = smp.undersample_self_paced(maj, mino, _order(), S.ROUND, S.N_ROUNDS, S.K_BINS, keep_bin=True)
    return out.select(*KEYS, "label", "bin")


@query("undersample_last_round")
def q_undersample_last_round(spark, sf):
    """The final paced round, where the weights are equal by definition."""
    maj, mino = _classes(spark, sf)
    out = smp.undersample_self_paced(maj, mino, _order(), S.N_ROUNDS - 1, S.N_ROUNDS, S.K_BINS, keep_bin=True)
    return out.select(*KEYS, "label", "bin")


# --- alerts and metrics ---------------------------------------------------------

def scored(spark, sf) -> DataFrame:
    return labelled(spark, sf).select(*KEYS, "fault_time", "label", closed_form_score().alias("p"))


def scored_once(spark, sf) -> DataFrame:
    """``scored`` written once, for the curve metrics that pass over it several times."""
    return materialize(scored(spark, sf))


def _with_thresh(spark, sf):
    return alr.threshold_schedule(scored(spark, sf), S.THRESH_HI, S.THRESH_LO, S.THRESH_BEGIN, S.THRESH_DAYS)


@query("threshold_alerts")
def q_threshold_alerts(spark, sf):
    out = alr.threshold_alerts(_with_thresh(spark, sf), "p", "thresh")
    return out.select(*KEYS, r6("p").alias("p"), r6("thresh").alias("thresh"))


@query("first_alerts")
def q_first_alerts(spark, sf):
    first = alr.first_alerts(alr.threshold_alerts(_with_thresh(spark, sf), "p", "thresh"))
    return alr.order_alerts(first)


def _test_scores(spark, sf):
    return lab.time_range(scored(spark, sf), *S.TEST)


def _first_faults(spark, sf):
    return lab.first_faults(event_fault_tags(spark, sf), ["model", "serial_number"])


@query("alert_metrics")
def q_alert_metrics(spark, sf):
    first = alr.first_alerts(alr.threshold_alerts(_test_scores(spark, sf), "p", S.SWEEP[2]), ["model", "serial_number"])
    out = met.alert_metrics(first, _first_faults(spark, sf), S.TEST, S.HORIZON)
    return _doubles_rounded(out)


@query("threshold_sweep")
def q_threshold_sweep(spark, sf):
    out = met.threshold_sweep(_test_scores(spark, sf), _first_faults(spark, sf), S.SWEEP, S.TEST, S.HORIZON,
                              score_col="p")
    return _doubles_rounded(out)


@query("best_f1_sweep")
def q_best_f1_sweep(spark, sf):
    """Best day-level F1 threshold on the test days, then the alert-level sweep around it."""
    from failcast.plans.evaluation import sweep_around_best
    test = materialize(_test_scores(spark, sf))
    out = sweep_around_best(test, event_fault_tags(spark, sf), S.TEST, S.HORIZON, score_col="p")
    return _doubles_rounded(out)


@query("pr_curve")
def q_pr_curve(spark, sf):
    return _doubles_rounded(met.pr_curve(scored_once(spark, sf), "p"))


@query("pr_auc")
def q_pr_auc(spark, sf):
    return _doubles_rounded(met.pr_auc(scored_once(spark, sf), "p"))


@query("roc_auc")
def q_roc_auc(spark, sf):
    return _doubles_rounded(met.roc_auc(scored_once(spark, sf), "p"))


@query("average_precision")
def q_average_precision(spark, sf):
    return _doubles_rounded(met.average_precision(scored_once(spark, sf), "p"))


@query("best_f1")
def q_best_f1(spark, sf):
    return _doubles_rounded(met.best_f1_threshold(scored_once(spark, sf), "p"))


@query("precision_at_n")
def q_precision_at_n(spark, sf):
    return _doubles_rounded(met.precision_at_n(scored_once(spark, sf), "p"))


@query("score_histogram")
def q_score_histogram(spark, sf):
    return met.score_histogram(scored(spark, sf), "p", S.HIST_BINS)


# --- sources and sinks ------------------------------------------------------------

def _scratch(spark, name: str) -> str:
    return shared_dir(spark, f"{name}-{uuid.uuid4().hex}")


@query("csv_roundtrip")
def q_csv_roundtrip(spark, sf):
    """Device-days written as daily text dumps (one folder per day), read back typed with the
    day bound applied as a partition filter."""
    dd = device_day(spark, sf)
    path = _scratch(spark, "daily-csv")
    write_daily_csv(dd, path)
    back = read_telemetry(spark, path, columns=dd.columns, since=S.TEST[0], metric_pattern="m_", layout="by_day")
    return _doubles_rounded(back)


@query("csv_full_read")
def q_csv_full_read(spark, sf):
    """Every device-day through text dumps of two header orders, one of them in a subfolder."""
    dd = device_day(spark, sf)
    path = _scratch(spark, "mixed-csv")
    text = dd.select(*[F.col(c).cast("string") for c in KEYS[:3]], F.date_format("dt", "yyyyMMdd").alias("dt"),
                     *[F.col(m).cast("string") for m in EVENT_METRICS])
    odd = F.col("serial_number").cast("long") % 2 == 1
    text.where(odd).write.option("header", True).csv(f"{path}/top")
    text.where(~odd).select(*reversed(text.columns)).write.option("header", True).csv(f"{path}/top/later")
    return _doubles_rounded(read_telemetry(spark, path, columns=dd.columns, metric_pattern="m_"))


@query("csv_flat_pruned")
def q_csv_flat_pruned(spark, sf):
    """Dumps named by their day in a flat folder, days with a time part; days before the test range are
    skipped by the file name, and what is left is filtered."""
    dd = device_day(spark, sf)
    path, flat = _scratch(spark, "daily-csv"), _scratch(spark, "flat-csv")
    day = F.date_format("dt", "yyyyMMdd")
    text = dd.select(*[F.col(c).cast("string") for c in KEYS[:3]], F.concat(day, F.lit("000000")).alias("dt"),
                     *[F.col(m).cast("string") for m in EVENT_METRICS], day.alias("day"))
    text.repartition("day").write.partitionBy("day").option("header", True).csv(path)
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(jvm.org.apache.hadoop.fs.Path(flat))
    for folder in fs.listStatus(jvm.org.apache.hadoop.fs.Path(path)):  # a folder a day
        name = folder.getPath().getName()
        for i, f in enumerate(fs.listStatus(folder.getPath()) if name.startswith("day=") else ()):
            if f.getPath().getName().endswith(".csv"):
                fs.rename(f.getPath(), jvm.org.apache.hadoop.fs.Path(f"{flat}/disk_sample_smart_log_{name[4:]}_{i}.csv"))
    back = read_telemetry(spark, flat, columns=dd.columns, since=S.TEST[0], metric_pattern="m_", name_day_token=4)
    return _doubles_rounded(back)


@query("feature_cache")
def q_feature_cache(spark, sf):
    path = _scratch(spark, "features")
    write_features(_features(spark, sf), path)
    return _doubles_rounded(read_features(spark, path))


@query("feature_cache_refresh")
def q_feature_cache_refresh(spark, sf):
    """The cache written from the days before the test range, then brought up to date with all days."""
    from failcast.plans import cache
    path, days = _scratch(spark, "features"), materialize(device_day(spark, sf))
    cache.refresh(days.where(F.col("dt") < F.lit(S.TEST[0]).cast("date")), EVENTS_SPEC, path, unique_days=True)
    cache.refresh(days, EVENTS_SPEC, path, unique_days=True)
    return _doubles_rounded(spark.read.parquet(path))


@query("alert_file")
def q_alert_file(spark, sf):
    first = alr.first_alerts(alr.threshold_alerts(_with_thresh(spark, sf), "p", "thresh"))
    path = _scratch(spark, "alerts")
    write_alerts(first, path)
    return spark.read.schema(ALERT_SCHEMA).option("header", False).csv(path)


@query("fault_log")
def q_fault_log(spark, sf):
    path = _scratch(spark, "faults")
    tags = event_fault_tags(spark, sf)
    tags.select(*[F.col(c).cast("string") for c in ["manufacturer", "model", "serial_number", "fault_time"]]) \
        .write.mode("overwrite").option("header", True).csv(path)
    return read_faults(spark, path)


@query("fault_log_foreign")
def q_fault_log_foreign(spark, sf):
    """Fault tags with another column order, an extra column, and times in three forms."""
    path = _scratch(spark, "faults")
    day = F.col("fault_time")
    form = F.pmod(F.unix_date(day), F.lit(3))
    time = (F.when(form == 0, F.date_format(day, "yyyy-MM-dd HH:mm:ss")).when(form == 1, F.date_format(day, "yyyyMMdd"))
            .otherwise(F.date_format(day, "yyyy-MM-dd")))
    event_fault_tags(spark, sf).select(time.alias("fault_time"), F.lit("x").alias("note"), "serial_number", "model", "manufacturer") \
        .write.mode("overwrite").option("header", True).csv(path)
    return read_faults(spark, path)


@query("evaluation_report")
def q_evaluation_report(spark, sf):
    """The evaluation stage with the closed-form score: ranking metrics of the train, val and test ranges."""
    from failcast.plans import training
    cfg = training.TrainConfig(train=S.TRAIN, val=S.VAL, test=S.TEST, horizon_days=S.HORIZON)
    ranking, _ = training.evaluate_scores(scored_once(spark, sf), event_fault_tags(spark, sf), cfg, score_col="p")
    return _doubles_rounded(ranking)


@query("curve_metrics")
def q_curve_metrics(spark, sf):
    return _doubles_rounded(met.curve_metrics(scored(spark, sf), "p"))


@query("first_alerts_sql")
def q_first_alerts_sql(spark, sf):
    """The alert reduction through a temp view and SQL text."""
    view = f"alerts_{uuid.uuid4().hex[:12]}"
    alr.threshold_alerts(_with_thresh(spark, sf), "p", "thresh").createOrReplaceTempView(view)
    return spark.sql(f"SELECT manufacturer, model, serial_number, min(dt) AS dt FROM {view} "
                     "GROUP BY manufacturer, model, serial_number ORDER BY 4 ASC, 3 ASC")


# --- ensemble ---------------------------------------------------------------------------

SMALL_LEARNER = dict(n_trees=5, max_depth=3)


def _ensemble(spark, sf, learner=SMALL_LEARNER, rounds=3, k_bins=S.K_BINS, **groups):
    """Featurizer + ensemble (of 3 members by default) fitted on the labelled device-days before the test range."""
    df = lab.label_horizon(lab.attach_faults(_features(spark, sf), event_fault_tags(spark, sf),
                                             dedup="first_fault"), S.HORIZON)
    cols = ens.feature_columns(df)
    train = lab.time_range(df, S.TRAIN[0], S.TEST[0])
    featurizer = ens.assembler(cols, missing_value=ens.missing_constant(train, cols), **groups).fit(train)
    spe = ens.SelfPacedEnsemble(ens.base_learner(seed=S.SEED, **learner), n_estimators=rounds, k_bins=k_bins, seed=S.SEED)
    return featurizer, spe.fit(featurizer.transform(train)), df, cols


def _ensemble_scored(spark, sf):
    featurizer, model, df, _ = _ensemble(spark, sf)
    test = lab.time_range(df, *S.TEST)
    return ens.score(featurizer.transform(test), model)


def _binary_ensemble(spark, sf):
    """Self-paced ensemble of naive Bayes members on binarised metrics: a learner SQL can compute exactly."""
    from pyspark.ml.classification import NaiveBayes
    from pyspark.ml.feature import VectorAssembler
    bits = [F.when(F.col(m) > S.BIT_OVER, 1.0).otherwise(0.0).alias(f"b_{m}") for m in EVENT_METRICS]
    df = VectorAssembler(inputCols=[f"b_{m}" for m in EVENT_METRICS], outputCol="features").transform(
        labelled(spark, sf).select(*KEYS, "label", *bits))
    spe = ens.SelfPacedEnsemble(NaiveBayes(modelType="bernoulli", smoothing=1.0), n_estimators=S.BIT_ROUNDS, k_bins=S.K_BINS, seed=S.SEED)
    model = spe.fit(lab.time_range(df, S.TRAIN[0], S.TEST[0]))
    return model, lab.time_range(df, *S.TEST)


@query("bayes_ensemble_score")
def q_bayes_ensemble_score(spark, sf):
    """Probability and hard label of every test day, by all members together."""
    model, test = _binary_ensemble(spark, sf)
    out = ens.predict(ens.score(test, model))
    return out.select(*KEYS, "label", r6("probability").alias("probability"), "prediction")


@query("bayes_ensemble_alerts")
def q_bayes_ensemble_alerts(spark, sf):
    model, test = _binary_ensemble(spark, sf)
    scored = alr.threshold_schedule(ens.score(test, model), S.BIT_THRESHOLD, S.BIT_THRESHOLD, S.TEST[0], S.THRESH_DAYS)
    return alr.order_alerts(alr.first_alerts(alr.threshold_alerts(scored, "probability", "thresh")))


@query("bayes_model_roundtrip")
def q_bayes_model_roundtrip(spark, sf):
    """The saved and loaded model's probabilities."""
    model, test = _binary_ensemble(spark, sf)
    path = _scratch(spark, "model")
    model.save(path)
    return ens.score(test, ens.SelfPacedEnsembleModel.load(path)).select(*KEYS, r6("probability").alias("probability"))


@query("ensemble_facts")
def q_ensemble_facts(spark, sf):
    """What must hold of the tree members' scores on every test day, whatever the trees are."""
    featurizer, model, df, _ = _ensemble(spark, sf)
    path = _scratch(spark, "model")
    model.save(path, featurizer)
    again, loaded = ens.SelfPacedEnsembleModel.load_all(path)
    days = lab.time_range(df, *S.TEST)
    first = ens.predict(ens.score(featurizer.transform(days), model)).select(*KEYS, "probability", "prediction")
    second = ens.score(loaded.transform(days), again).select(*KEYS, F.col("probability").alias("reloaded"))
    p = F.col("probability")
    return first.join(second, KEYS).select(
        *KEYS, ((p >= 0) & (p <= 1)).alias("in_unit"), (F.col("prediction") == (p > 0.5).cast("int")).alias("label_fits"),
        (p == F.col("reloaded")).alias("reload_equal"))


@query("importance_facts")
def q_importance_facts(spark, sf):
    """One importance a model input, not negative and at most one a member."""
    _, model, _, cols = _ensemble(spark, sf)
    imp = model.feature_importance(spark, cols)
    return imp.select("feature", F.col("importance").between(0, len(model.members) + 0.01).alias("in_range"))


def _against_trees(spark, sf, fitted) -> DataFrame:
    """One row: the members' scores of all labelled days against the saved trees compiled to one expression, and
    whether positive training days score higher on average (which a learner that learned nothing fails)."""
    featurizer, model, df, cols = fitted
    days = featurizer.transform(df)
    both = ens.score(days.withColumn("compiled", model.compiled(spark, ens.model_inputs(cols))), model)
    past = (F.col("dt") >= F.lit(S.TRAIN[0]).cast("date")) & (F.col("dt") < F.lit(S.TEST[0]).cast("date"))
    mean = lambda label: F.avg(F.when(past & (F.col("label") == label), F.col("compiled")))
    return both.agg(F.count(F.lit(1)).alias("n_rows"), (F.round(F.max(F.abs(F.col("probability") - F.col("compiled"))), 9) + 0.0).alias("largest_difference"),
                    (mean(1) > mean(0) + 0.05).alias("separates"))


@query("compiled_trees")
def q_compiled_trees(spark, sf):
    return _against_trees(spark, sf, _ensemble(spark, sf))


def reference_size_trees(spark, sf):
    """``compiled_trees`` at the reference's size: 20 members of 20 trees, depth 6 (about 50 leaves), 40 hardness bins,
    categories of at least 500 rows in at most 32 groups. Minutes on any table, so it is run by
    ``tools/reference_size.py`` and not registered."""
    fitted = _ensemble(spark, sf, learner={}, rounds=20, k_bins=40, min_group_rows=ens.MIN_GROUP_ROWS)
    return _against_trees(spark, sf, fitted)


@query("split_counts")
def q_split_counts(spark, sf):
    """Per tree of the saved members: a tree that splits k times has k + 1 leaves; and the split-count importances, through the
    JSON sink and back, count every inner node of the model."""
    _, model, _, cols = _ensemble(spark, sf)
    path = _scratch(spark, "importance")
    write_importance(model.feature_importance(spark, cols, kind="split"), path)
    counted = spark.read.schema("feature string, importance double").json(path).agg(F.sum("importance").alias("s"), F.count_distinct("feature").alias("n")).first()
    nodes = trees.node_table(spark, model.members)
    per_tree = nodes.groupBy("member", "tree").agg(F.count_if(F.col("left") >= 0).alias("inner"), F.count_if(F.col("left") < 0).alias("leaves"))
    inner = per_tree.agg(F.sum("inner")).scalar()
    return per_tree.select("member", "tree", (F.col("leaves") == F.col("inner") + 1).alias("whole"), (F.col("inner") > 0).alias("splits"),
                           (inner == F.lit(counted.s)).alias("all_counted"), F.lit(counted.n == len(cols)).alias("all_features"))


@query("category_codes")
def q_category_codes(spark, sf):
    """Suppliers as categories: those with 600 lines or more have a code, at most 31 of them; all others share one."""
    return ens.category_codes(load_table(spark, sf, "lineitem"), "l_suppkey", min_rows=600, max_groups=32)


@query("ensemble_score")
def q_ensemble_score(spark, sf):
    return _ensemble_scored(spark, sf).select(*KEYS, "label", r6("probability").alias("probability"))


@query("ensemble_predict")
def q_ensemble_predict(spark, sf):
    return ens.predict(_ensemble_scored(spark, sf)).select(*KEYS, "prediction")


@query("feature_importance")
def q_feature_importance(spark, sf):
    """Importance summed over members, through the JSON sink and back."""
    _, model, _, cols = _ensemble(spark, sf)
    path = _scratch(spark, "importance")
    write_importance(model.feature_importance(spark, cols), path)
    return spark.read.schema("feature string, importance double").json(path)


@query("model_roundtrip")
def q_model_roundtrip(spark, sf):
    featurizer, model, df, _ = _ensemble(spark, sf)
    path = _scratch(spark, "model")
    model.save(path)
    loaded = ens.SelfPacedEnsembleModel.load(path)
    test = lab.time_range(df, *S.TEST)
    return ens.score(featurizer.transform(test), loaded).select(*KEYS, r6("probability").alias("probability"))


@query("ensemble_alerts")
def q_ensemble_alerts(spark, sf):
    scored = alr.threshold_schedule(_ensemble_scored(spark, sf), 0.5, 0.5, S.TEST[0], S.THRESH_DAYS)
    return alr.order_alerts(alr.first_alerts(alr.threshold_alerts(scored, "probability", "thresh")))


# --- streaming ------------------------------------------------------------------

def _range_score(df):
    r = F.coalesce(F.col("window_7_range_m_error"), F.lit(0.0))
    return df.withColumn("probability", r / (r + F.lit(S.SCORE_SCALE)))


@query("stream_first_alerts")
def q_stream_first_alerts(spark, sf):
    """Device-days arrive as daily dumps in two drops; the streaming job scores each drop
    with its look-back and keeps one first alert per device."""
    from failcast.streaming import DailyAlertStream
    dd = device_day(spark, sf)
    cols = ["serial_number", "manufacturer", "model", "dt"] + EVENT_METRICS
    base = _scratch(spark, "stream")
    src = f"{base}/src"
    write_daily_csv(dd.filter(F.col("dt") < F.lit(S.VAL[0]).cast("date")), src)
    stream = DailyAlertStream(spark, src, f"{base}/work", _range_score, columns=cols, spec=EVENTS_SPEC,
                              threshold=S.SWEEP[4], metric_pattern="m_", unique_days=True)
    stream.start().awaitTermination()
    write_daily_csv(dd.filter(F.col("dt") >= F.lit(S.VAL[0]).cast("date")), src, mode="append")
    stream.start().awaitTermination()
    return stream.alerts()


# --- other supplied tables --------------------------------------------------------

@query("long_history_features")
def q_long_history_features(spark, sf):
    """The whole recipe over seven years of supplier-days with same-day peers (skew-safe path)."""
    from failcast.sources.standins import LINEITEM_SPEC, supplier_days
    return _doubles_rounded(feat.build_features(supplier_days(spark, sf), LINEITEM_SPEC, unique_days=False))


@query("doc_pr_curve")
def q_doc_pr_curve(spark, sf):
    from failcast.sources.standins import scored_documents
    return _doubles_rounded(met.pr_curve(materialize(scored_documents(spark, sf))))


@query("doc_roc_auc")
def q_doc_roc_auc(spark, sf):
    from failcast.sources.standins import scored_documents
    return _doubles_rounded(met.roc_auc(materialize(scored_documents(spark, sf))))


@query("smart_recipe")
def q_smart_recipe(spark, sf):
    """The reference recipe itself (SMART column lists, constants, 66 model inputs) over
    SMART-shaped days derived from line items; same-day lines are peers."""
    from failcast.schema import SMART_SPEC
    from failcast.sources.standins import smart_telemetry
    return _doubles_rounded(feat.build_features(smart_telemetry(spark, sf), SMART_SPEC))
