"""Self-paced under-sampling ensemble of boosted trees on ``pyspark.ml``.

The driver only loops over rounds; each round is Spark work: a hash-ordered draw
(``failcast.operators.sampling``), one distributed fit, and one evaluation of the new
member alone. The input is written to the shared checkpoint folder once, each different row
with an address and its number of copies, in buckets by address. Scores are a second, thin
table in the same buckets: a round adds the new member's probability to the running sum
next to the features, without a shuffle, and its predecessor is deleted. Drawn rows fetch
their features by address; only the drawn addresses move. Lineage stays one round deep and
a lost executor recomputes at most one round.
"""

from __future__ import annotations

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, SQLTransformer, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from failcast.functions.expressions import hash_order
from failcast.operators import sampling as smp
from failcast.operators import trees
from failcast.schema import NON_FEATURE_COLUMNS
from failcast.scratch import discard, materialize

MISSING = -1.0
#: A row's address, and how many equal rows it stands for.
ROW, COPIES = "_row", "_copies"


def feature_columns(df: DataFrame, exclude=NON_FEATURE_COLUMNS, categorical: str = "model") -> list:
    """Model inputs in order: every column not excluded, then the categorical one last."""
    skip = set(exclude) | {categorical}
    return [f.name for f in df.schema.fields if f.name not in skip] + [categorical]


def missing_constant(df: DataFrame, feature_cols, categorical: str = "model") -> float:
    """A value below every numeric input of ``df`` (one aggregate), to stand for missing ones."""
    numeric = [c for c in feature_cols if c != categorical]
    least = df.agg(*[F.min(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))).alias(f"_{i}") for i, c in enumerate(numeric)]).first()
    known = [v for v in least if v is not None and v > float("-inf")]
    return min(MISSING, min(known, default=0.0) - 1.0)


#: The reference learner's limits on categories: rows that a category of its own needs, and most categories.
MIN_GROUP_ROWS, MAX_GROUPS = 500, 32
#: A code that no category has, where no category is frequent: trees want two codes.
_NO_CATEGORY = "__none"


def frequent_categories(df: DataFrame, col: str, min_rows: int = MIN_GROUP_ROWS, max_groups: int = MAX_GROUPS) -> list:
    """At most ``max_groups - 1`` categories of at least ``min_rows`` rows, the most frequent first (ties by code point).

    Categories are counted with map-side partial sums; only the few that get a code come to the driver."""
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("string").alias("category")).agg(F.count(F.lit(1)).alias("n_rows"))
    top = counts.where(F.col("n_rows") >= int(min_rows)).orderBy(F.desc("n_rows"), "category").limit(int(max_groups) - 1)
    return [r.category for r in top.collect()]


def category_codes(df: DataFrame, col: str, min_rows: int = MIN_GROUP_ROWS, max_groups: int = MAX_GROUPS) -> DataFrame:
    """Every category of ``df`` with its rows and code: frequent categories 0, 1, ... by ``frequent_categories``, and one
    common code behind them for all rare ones and NULL."""
    labels = frequent_categories(df, col, min_rows, max_groups)
    own = F.create_map(*[x for i, c in enumerate(labels) for x in (F.lit(c), F.lit(i))]) if labels else None
    counts = df.groupBy(F.col(col).cast("string").alias("category")).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.withColumn("code", F.coalesce(own[F.col("category")], F.lit(len(labels))) if labels else F.lit(0))


class CategoryGroups(Estimator):
    """Codes of ``category_codes`` as a column with nominal metadata: at most ``max_groups`` values however many categories
    there are, so trees need no more bins than that. Categories that the fit has not seen take the common code."""

    def __init__(self, inputCol: str, outputCol: str, min_rows: int = MIN_GROUP_ROWS, max_groups: int = MAX_GROUPS):
        super().__init__()
        self.inputCol, self.outputCol, self.min_rows, self.max_groups = inputCol, outputCol, min_rows, max_groups

    def _fit(self, dataset: DataFrame) -> StringIndexerModel:
        labels = frequent_categories(dataset, self.inputCol, self.min_rows, self.max_groups)
        return StringIndexerModel.from_labels(labels or [_NO_CATEGORY], inputCol=self.inputCol, outputCol=self.outputCol, handleInvalid="keep")


def assembler(feature_cols, categorical: str = "model", missing: str = "constant", missing_value: float = MISSING, out: str = "features",
              min_group_rows: int | None = None, max_groups: int = MAX_GROUPS) -> Pipeline:
    """Unfitted feature pipeline: categorical index (nominal metadata, so trees split it as a
    category), missing values handled, one vector column.

    ``missing='constant'`` fills NULL/NaN with ``missing_value``, which should lie below every
    real value (``missing_constant`` finds one; the default fits counters), so trees route
    missing rows to one side, as a learner with native missing support would;
    ``'median'`` uses ``Imputer``.

    With ``min_group_rows`` categories are grouped as by ``category_codes``; without it each has a code of its own.
    """
    numeric = [c for c in feature_cols if c != categorical]
    if min_group_rows is None:
        stages = [StringIndexer(inputCol=categorical, outputCol=f"{categorical}_idx", handleInvalid="keep",
                                stringOrderType="alphabetAsc")]
    else:
        stages = [CategoryGroups(categorical, f"{categorical}_idx", min_group_rows, max_groups)]
    if missing == "constant":
        fills = ", ".join(f"coalesce(nanvl(`{c}`, NULL), {missing_value!r}) AS `_f_{c}`" for c in numeric)
        stages.append(SQLTransformer(statement=f"SELECT *, {fills} FROM __THIS__"))
    elif missing == "median":
        casts = ", ".join(f"CAST(`{c}` AS DOUBLE) AS `_f_{c}`" for c in numeric)
        stages.append(SQLTransformer(statement=f"SELECT *, {casts} FROM __THIS__"))
        stages.append(Imputer(strategy="median", inputCols=[f"_f_{c}" for c in numeric],
                              outputCols=[f"_f_{c}" for c in numeric]))
    else:
        raise ValueError(f"missing must be 'constant' or 'median', not {missing!r}")
    stages.append(VectorAssembler(inputCols=[f"_f_{c}" for c in numeric] + [f"{categorical}_idx"],
                                  outputCol=out, handleInvalid="keep"))
    return Pipeline(stages=stages)


def base_learner(n_trees: int = 20, max_depth: int = 6, step_size: float = 0.1, feature_fraction: float = 0.8,
                 max_bins: int = 32, seed: int = 2019, **params) -> GBTClassifier:
    """Boosted trees standing in for the reference learner (20 trees, ~50 leaves ~ depth 6,
    learning rate 0.1, 80 % of features per split)."""
    return GBTClassifier(maxIter=n_trees, maxDepth=max_depth, stepSize=step_size,
                         featureSubsetStrategy=str(feature_fraction), subsamplingRate=1.0, maxBins=max_bins,
                         seed=seed, **params)


def model_inputs(feature_cols, categorical: str = "model") -> list:
    """Columns of a featurized table behind the features of ``assembler``, in their order."""
    return [f"_f_{c}" for c in feature_cols if c != categorical] + [f"{categorical}_idx"]


def _positive_prob(col: str):
    return vector_to_array(F.col(col))[1]


class SelfPacedEnsembleModel:
    """Fitted members; the ensemble probability is the mean of the members' positive-class
    probabilities, computed in one projection (tree evaluation stays in the JVM)."""

    def __init__(self, members: list):
        self.members = list(members)

    def transform(self, df: DataFrame, out: str = "probability") -> DataFrame:
        cols = df.columns
        total = None
        for i, m in enumerate(self.members):
            df = m.transform(df)
            p = _positive_prob(m.getProbabilityCol())
            total = p if total is None else total + p
        return df.select(*cols, (total / F.lit(float(len(self.members)))).alias(out))

    def save(self, path: str, featurizer: PipelineModel | None = None) -> None:
        """The members and, when given, the fitted featurizer, as one saved model."""
        PipelineModel(stages=[PipelineModel(stages=self.members), *([featurizer] if featurizer else [])]).write().overwrite().save(path)

    @classmethod
    def load(cls, path: str) -> "SelfPacedEnsembleModel":
        return cls.load_all(path)[0]

    @classmethod
    def load_all(cls, path: str) -> tuple["SelfPacedEnsembleModel", PipelineModel | None]:
        """The model and the featurizer saved with it (None if it was saved without)."""
        stages = PipelineModel.load(path).stages
        return cls(stages[0].stages), stages[1] if len(stages) > 1 else None

    def compiled(self, spark: SparkSession, inputs) -> Column:
        """The probability as one expression over the columns ``inputs`` (``model_inputs``), from the saved trees alone."""
        return trees.compiled_score(trees.node_table(spark, self.members), inputs)

    def feature_importance(self, spark: SparkSession, names, kind: str = "gain") -> DataFrame:
        """Per feature: sum over members of the importance rounded to 3 places. ``kind='gain'``: the members' own
        importances, a table of members x features (bounded by the model); ``'split'``: how often a feature
        splits a node, the reference learner's default, counted on the saved trees."""
        if kind == "split":
            return trees.split_counts(trees.node_table(spark, self.members), names).select("feature", F.col("splits").cast("double").alias("importance"))
        if kind != "gain":
            raise ValueError(f"kind must be 'gain' or 'split', not {kind!r}")
        rows = [(i, n, float(v)) for i, m in enumerate(self.members)
                for n, v in zip(names, m.featureImportances.toArray())]
        df = spark.createDataFrame(rows, "member int, feature string, importance double")
        return df.groupBy("feature").agg(F.sum(F.round("importance", 3)).alias("importance"))


class SelfPacedEnsemble:
    """Self-paced ensemble: cold-start random under-sampling, then ``n_estimators - 1`` rounds
    that draw the majority class per hardness bin, with quotas paced from hard to even."""

    def __init__(self, base_estimator=None, hardness_fn=None, n_estimators: int = 20, k_bins: int = 40,
                 seed: int = 2019, label_col: str = "label", features_col: str = "features",
                 id_cols=("serial_number", "model", "dt"), checkpoint: bool = True):
        self.base_estimator = base_estimator or base_learner()
        self.hardness_fn = hardness_fn
        self.n_estimators = n_estimators
        self.k_bins = k_bins
        self.seed = seed
        self.label_col = label_col
        self.features_col = features_col
        self.id_cols = list(id_cols)
        self.checkpoint = checkpoint

    def _order(self, i: int):
        return hash_order(*self.id_cols, seed=f"{self.seed}:{i}")

    def _member(self, i: int, categories: int):
        est = self.base_estimator.copy()
        if est.hasParam("maxBins") and est.getOrDefault("maxBins") < categories:
            est = est.setMaxBins(categories)  # trees need a bin for each category
        return est.setProbabilityCol(f"_prob{i}").setRawPredictionCol(f"_raw{i}").setPredictionCol(f"_pred{i}") \
            .setFeaturesCol(self.features_col).setLabelCol(self.label_col)

    def _fit_member(self, i: int, train: DataFrame, categories: int):
        """One learner on the round's draw (about 2 x minority rows). The draw is persisted
        for the learner's passes and released after; it is recomputable from the
        checkpointed round input, so losing it costs one draw, not the history."""
        train = train.persist()
        try:
            return self._member(i, categories).fit(train)
        finally:
            train.unpersist()

    def _addressed(self, df: DataFrame) -> DataFrame:
        """The different rows of ``df`` with an address (a fingerprint of the row) and their number of copies, which are
        counted before the shuffle."""
        own = [*self.id_cols, self.label_col, self.features_col]
        rows = df.select(*own).withColumn(self.label_col, F.col(self.label_col).cast("double"))
        kind = df.schema[self.features_col].metadata
        made = rows.groupBy(smp.content_key(own).alias(ROW)).agg(F.count(F.lit(1)).alias(COPIES), F.first(F.struct(*own)).alias("_r"))
        return made.select(ROW, COPIES, "_r.*").withColumn(self.features_col, F.col(self.features_col).alias(self.features_col, metadata=kind))

    def _with_features(self, drawn: DataFrame, data: DataFrame) -> DataFrame:
        """The drawn rows, each as often as drawn, with their features fetched by address from the written input."""
        times = drawn.select(ROW, F.col(COPIES).alias("_drawn"))
        own = [*self.id_cols, self.label_col, self.features_col]
        return smp.repeated(data.select(ROW, *own).join(times, ROW).select(*own, "_drawn"), "_drawn")

    def _add_member(self, i: int, member, maj: DataFrame, scores: DataFrame | None) -> DataFrame:
        """Scores after member ``i``: running sum and mean of the members' probabilities. Only this member is evaluated;
        features and sums meet bucket by bucket."""
        thin = [ROW, COPIES, *self.id_cols, self.label_col]
        joined = maj if scores is None else maj.select(ROW, self.features_col).join(scores, ROW)
        total = _positive_prob(member.getProbabilityCol())
        if scores is not None:
            total = F.col("_sum") + total
        return member.transform(joined).select(*thin, total.alias("_sum")).withColumn("p", F.col("_sum") / F.lit(float(i + 1)))

    def fit(self, df: DataFrame) -> SelfPacedEnsembleModel:
        y = self.label_col
        keep = (lambda d, name: materialize(d, name, bucket_by=ROW)) if self.checkpoint else (lambda d, name: d)
        data = keep(self._addressed(df), "spe-input")
        attrs = df.schema[self.features_col].metadata.get("ml_attr", {}).get("attrs", {})
        categories = max([0, *(len(a.get("vals", ())) for a in attrs.get("nominal", ()))])
        maj = data.filter(F.col(y) == 0)
        mino = data.filter(F.col(y) == 1)
        counts = data.agg(F.count_if(F.col(y) == 0).alias("maj"), F.count_if(F.col(y) == 1).alias("mino")).first()
        if not counts.maj or not counts.mino:
            raise ValueError("self-paced ensemble needs rows of both classes (label 0 and label 1)")

        thin = [ROW, COPIES, *self.id_cols, y]
        members, scores = [], None
        for i in range(self.n_estimators):
            # rows that share an id stand behind its hash in the order of their addresses
            order = F.concat(self._order(i), F.col(ROW))
            if i == 0:
                drawn = smp.undersample_random(maj.select(*thin), mino.select(*thin), order, weight=COPIES)
            else:
                drawn = smp.undersample_self_paced(scores, mino.select(*thin), order, i, self.n_estimators, self.k_bins,
                                                   score_col="p", label_col=y, hardness_fn=self.hardness_fn, weight=COPIES)
            members.append(self._fit_member(i, self._with_features(drawn, data), categories))
            if i == self.n_estimators - 1:
                break  # the majority score is only needed to pace a next round
            before, scores = scores, keep(self._add_member(i, members[-1], maj, scores), f"spe-scores-{i}")
            if before is not None and self.checkpoint:
                discard(before)
        if self.checkpoint:
            discard(*[t for t in (scores, data) if t is not None])
        return SelfPacedEnsembleModel(members)


def score(df: DataFrame, model: SelfPacedEnsembleModel, out: str = "probability") -> DataFrame:
    """Ensemble probability per row; keys stay on the row (no positional glue)."""
    return model.transform(df, out)


def predict(df: DataFrame, threshold: float = 0.5, score_col: str = "probability", out: str = "prediction") -> DataFrame:
    """Hard label ``score > threshold``."""
    return df.withColumn(out, (F.col(score_col) > F.lit(float(threshold))).cast("int"))
