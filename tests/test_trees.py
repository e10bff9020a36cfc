import pytest
from pyspark.sql import functions as F

from failcast.operators import ensemble as ens
from failcast.operators import trees


def toy(spark, n=3000, models=40):
    """Labels that depend on the category and, with missing values, on two numbers."""
    x = F.when(F.col("id") % 11 != 0, (F.col("id") * 7 % 101) / 10.0)
    df = spark.range(n).select(F.concat(F.lit("s"), F.col("id")).alias("serial_number"), (F.floor(F.sqrt(F.col("id") % (models * models)))).cast("string").alias("model"),
                               F.col("id").alias("dt"), x.alias("x"), (F.col("id") * 13 % 17).cast("double").alias("y"))
    bad = ((F.col("model").cast("int") % 3 == 0) & (F.coalesce("x", F.lit(9.0)) > 5)) | ((F.col("y") > 14) & (F.col("model").cast("int") % 5 < 2))
    return df.withColumn("label", (bad & (F.col("dt") % 3 == 0)).cast("int"))


@pytest.fixture(scope="module")
def fitted(spark):
    df = toy(spark)
    cols = ["x", "y", "model"]
    featurizer = ens.assembler(cols, min_group_rows=60).fit(df)
    made = featurizer.transform(df)
    spe = ens.SelfPacedEnsemble(ens.base_learner(n_trees=4, max_depth=4), n_estimators=3, k_bins=5)
    return spe.fit(made), made, cols


def test_compiled_trees_score_as_the_members_do(spark, fitted):
    model, df, cols = fitted
    nodes = trees.node_table(spark, model.members)
    assert nodes.where("left >= 0 AND n_categories > 0").count() > 0  # categories split too
    both = model.transform(df.withColumn("compiled", trees.compiled_score(nodes, ens.model_inputs(cols))))
    worst = both.agg(F.max(F.abs(F.col("probability") - F.col("compiled"))).alias("d"), F.count_distinct("compiled").alias("n")).first()
    assert worst.d < 1e-12 and worst.n > 10


def test_a_changed_tree_is_noticed(spark, fitted):
    model, df, cols = fitted
    nodes = trees.node_table(spark, model.members).withColumn("prediction", F.when(F.expr("member = 1 AND tree = 2"), F.col("prediction") + 0.1).otherwise(F.col("prediction")))
    both = model.transform(df.withColumn("compiled", trees.compiled_score(nodes, ens.model_inputs(cols))))
    assert both.agg(F.max(F.abs(F.col("probability") - F.col("compiled")))).first()[0] > 1e-4


def test_small_models_are_one_generated_stage(spark, fitted):
    model, df, cols = fitted
    plan = df.select("serial_number", model.compiled(spark, ens.model_inputs(cols)).alias("p"))._jdf.queryExecution().executedPlan().toString()
    assert "*(1) Project" in plan and "*(2)" not in plan


def test_split_counts(spark, fitted):
    model, _, cols = fitted
    want = dict.fromkeys(cols, 0)
    for m in model.members:
        for t in m.trees:
            for line in t.toDebugString.split("\n"):
                if "If (feature " in line:
                    want[cols[int(line.split("feature ")[1].split()[0])]] += 1
    got = {r.feature: r.importance for r in model.feature_importance(spark, cols, kind="split").collect()}
    assert got == want and sum(want.values()) == sum((m.totalNumNodes - m.getNumTrees) // 2 for m in model.members)
    unused = model.feature_importance(spark, [*cols, "never"], kind="split").where("feature = 'never'").first()
    assert unused.importance == 0
    with pytest.raises(ValueError):
        model.feature_importance(spark, cols, kind="other")


def test_rare_categories_share_a_code(spark):
    rows = ["a"] * 9 + ["b"] * 9 + ["c"] * 12 + ["d"] * 3 + [None] * 20 + ["é"] * 2
    df = spark.createDataFrame([(x,) for x in rows], "model string")
    code = lambda **how: {r.category: (r.n_rows, r.code) for r in ens.category_codes(df, "model", **how).collect()}
    assert code(min_rows=5) == {"c": (12, 0), "a": (9, 1), "b": (9, 2), "d": (3, 3), None: (20, 3), "é": (2, 3)}
    assert code(min_rows=5, max_groups=3) == {"c": (12, 0), "a": (9, 1), "b": (9, 2), "d": (3, 2), None: (20, 2), "é": (2, 2)}
    assert {c for _, c in code(min_rows=99).values()} == {0}
    fitted = ens.CategoryGroups("model", "code", min_rows=5).fit(df)
    seen = fitted.transform(df.union(spark.createDataFrame([("unseen",)], "model string")))
    assert {r.model: r.code for r in seen.collect()} == {"c": 0, "a": 1, "b": 2, "d": 3, None: 3, "é": 3, "unseen": 3}
    assert len(seen.schema["code"].metadata["ml_attr"]["vals"]) == 4
    assert ens.category_codes(df.limit(0), "model").collect() == []


def test_a_hundred_thousand_models_fit_with_32_bins(spark, tmp_path):
    df = toy(spark, n=110_000).withColumn("model", F.when(F.col("dt") < 100_000, F.concat(F.lit("rare"), F.col("dt"))).otherwise(F.col("model")))
    featurizer = ens.assembler(["x", "y", "model"], min_group_rows=200).fit(df)
    made = featurizer.transform(df)
    assert made.agg(F.count_distinct("model_idx")).first()[0] <= 32
    model = ens.SelfPacedEnsemble(ens.base_learner(n_trees=1, max_depth=2), n_estimators=1).fit(made)
    assert model.members[0].getMaxBins() == 32
    model.save(str(tmp_path / "m"), featurizer)  # the grouping is saved with the model
    again, loaded = ens.SelfPacedEnsembleModel.load_all(str(tmp_path / "m"))
    some = df.where("dt % 1000 = 0")
    a = {r.dt: r.probability for r in again.transform(loaded.transform(some)).collect()}
    assert a == {r.dt: r.probability for r in model.transform(featurizer.transform(some)).collect()}
