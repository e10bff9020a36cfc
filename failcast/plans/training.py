"""Training pipeline: telemetry -> feature table -> labels -> cohort -> ensemble -> evaluation."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from failcast.operators import ensemble as ens
from failcast.operators import features as feat
from failcast.operators import labels as lab
from failcast.operators import metrics as met
from failcast.operators import sampling as smp
from failcast.plans import cache
from failcast.plans import evaluation as ev
from failcast.schema import FAULT_KEYS, HORIZON_DAYS, SAMPLE_PER_GROUP, SAMPLE_SEED, SMART_SPEC, FeatureSpec
from failcast.scratch import materialize


@dataclass
class TrainConfig:
    train: tuple = ("2017-08-01", "2018-08-01")
    test: tuple = ("2018-08-01", "2018-09-01")
    val: tuple = ("2018-06-01", "2018-07-01")
    tags_end: str = "2018-09-01"
    horizon_days: int = HORIZON_DAYS
    per_group: int = SAMPLE_PER_GROUP
    seed: int = SAMPLE_SEED
    cohort_mode: str = "all"
    leak_guard: bool = True
    allow_overlap: bool = False
    fault_dedup: str = "none"
    spec: FeatureSpec = SMART_SPEC
    unique_days: bool = False
    n_estimators: int = 20
    k_bins: int = 40
    learner: dict = field(default_factory=dict)
    missing: str = "constant"
    min_group_rows: int | None = ens.MIN_GROUP_ROWS
    max_groups: int = ens.MAX_GROUPS


def feature_table(spark: SparkSession, telemetry: DataFrame, spec: FeatureSpec = SMART_SPEC,
                  cache_path: str | None = None, unique_days: bool = False) -> DataFrame:
    """The recipe over telemetry. With ``cache_path`` the table is kept there, partitioned by month so that later day
    ranges prune whole months, and brought up to date by ``cache.refresh``: another recipe builds it anew, changed days
    rewrite the months that see them, and unchanged telemetry reads what is there."""
    if not cache_path:
        return feat.build_features(telemetry, spec, unique_days=unique_days)
    cache.refresh(telemetry, spec, cache_path, unique_days)
    return spark.read.parquet(cache_path)


def labelled_table(features: DataFrame, faults: DataFrame, cfg: TrainConfig) -> DataFrame:
    df = lab.attach_faults(features, faults, FAULT_KEYS, dedup=cfg.fault_dedup)
    df = lab.label_horizon(df, cfg.horizon_days)
    if "month" not in df.columns:
        df = lab.with_month(df)
    return df


def train(spark: SparkSession, features: DataFrame, faults: DataFrame, cfg: TrainConfig):
    """Fit featurizer + ensemble on the training cohort. Returns (featurizer, model, labelled)."""
    labelled = labelled_table(features, faults, cfg)
    # only train and test must not overlap: the validation month may lie inside the train range
    lab.time_split(labelled, {"train": cfg.train, "test": cfg.test}, allow_overlap=cfg.allow_overlap)
    cohort = smp.training_cohort(labelled, cfg.train, cfg.tags_end, cfg.horizon_days, cfg.per_group, cfg.seed,
                                 mode=cfg.cohort_mode, leak_guard=cfg.leak_guard)
    cols = ens.feature_columns(labelled)
    value = ens.missing_constant(cohort, cols) if cfg.missing == "constant" else ens.MISSING
    featurizer = ens.assembler(cols, missing=cfg.missing, missing_value=value, min_group_rows=cfg.min_group_rows,
                               max_groups=cfg.max_groups).fit(cohort)
    spe = ens.SelfPacedEnsemble(ens.base_learner(seed=cfg.seed, **cfg.learner), n_estimators=cfg.n_estimators,
                                k_bins=cfg.k_bins, seed=cfg.seed)
    model = spe.fit(featurizer.transform(cohort))
    return featurizer, model, labelled


def evaluate_scores(scored: DataFrame, faults: DataFrame, cfg: TrainConfig, score_col: str = "probability"):
    """The evaluation stage on scored, labelled days: (ranking, sweep).

    ranking: one row each for the train, val and test ranges (``evaluation.split_report``); the
    validation range may lie inside the train range. sweep: alert-level precision, recall and F1 on
    the test range, for thresholds around its best day-level F1."""
    splits = {"train": cfg.train, "val": cfg.val, "test": cfg.test}
    ranking = ev.split_report(scored, splits, score_col, allow_overlap=True)
    test = lab.time_range(scored, *cfg.test)
    best = ranking.where("split = 'test'").first().threshold
    if best is None:
        raise ValueError("no precision-recall point with a defined F1 in the test range")
    sweep = ev.alert_report(test, faults, cfg.test, met.sweep_around(best), cfg.horizon_days, score_col=score_col)
    return ranking, sweep


def evaluate(featurizer, model, labelled: DataFrame, faults: DataFrame, cfg: TrainConfig):
    """Score the labelled days once (written), then ``evaluate_scores``."""
    scored = ens.score(featurizer.transform(labelled), model).drop("features")
    return evaluate_scores(materialize(scored, "scored"), faults, cfg)
