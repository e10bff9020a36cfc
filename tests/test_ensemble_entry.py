import pytest
from pyspark.sql import functions as F

from tests.conftest import SF001, SF01


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() >= 0 and "serial_number" in df.columns


def test_registry_and_oracles_align():
    import __spark_entry__ as E
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(sql) >= 30


def test_ensemble_fits_and_roundtrips(spark, tmp_path):
    from failcast.operators import ensemble as ens
    from failcast.operators import metrics as met
    from failcast.plans.driver_queries import _ensemble, _features
    featurizer, model, df, cols = _ensemble(spark, SF01)
    assert len(model.members) == 3
    scored = ens.score(featurizer.transform(df), model)
    assert met.roc_auc(scored).first()[0] > 0.6          # beats the base rate on its own history
    path = str(tmp_path / "m")
    model.save(path)
    again = ens.score(featurizer.transform(df), ens.SelfPacedEnsembleModel.load(path))
    a = {(r.serial_number, r.dt): r.probability for r in scored.select("serial_number", "dt", "probability").collect()}
    b = {(r.serial_number, r.dt): r.probability for r in again.select("serial_number", "dt", "probability").collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a)
    imp = model.feature_importance(spark, cols).collect()
    assert len(imp) == len(cols)


def test_csv_source_matches_headers_by_name(spark, tmp_path):
    from failcast.sources.telemetry import read_telemetry
    p = tmp_path / "logs"
    p.mkdir()
    (p / "a_b_c_d_20240101.csv").write_text("dt,m_x,serial_number,model,manufacturer\n20240101,1.5,s1,1,A\n2018,2,s2,1,A\n")
    (p / "a_b_c_d_20240102.csv").write_text("serial_number,manufacturer,model,dt,m_x\ns1,A,1,20240102,abc\n")
    df = read_telemetry(spark, str(p), columns=["serial_number", "manufacturer", "model", "dt", "m_x"],
                        metric_pattern="m_")
    got = sorted((r.serial_number, str(r.dt), r.m_x) for r in df.collect())
    assert got == [("s1", "2024-01-01", 1.5), ("s1", "2024-01-02", None)]


def test_rejected_days_counted(spark, tmp_path):
    from failcast.sources.telemetry import count_rejected_days
    p = tmp_path / "logs"
    p.mkdir()
    (p / "x.csv").write_text("serial_number,manufacturer,model,dt,m_x\ns1,A,1,20240101,1\ns1,A,1,2018,1\n"
                             "s1,A,1,20181340,1\ns1,A,1,,1\n")
    got = count_rejected_days(spark, str(p), ["serial_number", "manufacturer", "model", "dt", "m_x"]).first()
    assert got.rejected_days == 3


def test_file_name_day_pruning(spark, tmp_path):
    from failcast.sources.telemetry import csv_header_groups, read_telemetry
    p = tmp_path / "logs"
    p.mkdir()
    head = "serial_number,manufacturer,model,dt,m_x\n"
    for d in ("20180820", "20180823", "20180901"):
        (p / f"disk_sample_smart_log_{d}_round2.csv").write_text(head + f"s1,A,1,{d},1\n")
    groups = csv_header_groups(spark, str(p), since="2018-08-23", name_day_token=4)
    assert sorted(f.rsplit("_", 2)[-2] for fs in groups.values() for f in fs) == ["20180823", "20180901"]
    df = read_telemetry(spark, str(p), columns=["serial_number", "manufacturer", "model", "dt", "m_x"],
                        since="2018-08-23", metric_pattern="m_", name_day_token=4)
    assert sorted(str(r.dt) for r in df.collect()) == ["2018-08-23", "2018-09-01"]


def test_trusted_single_header_layout(spark, tmp_path):
    import pytest
    from failcast.sources.telemetry import read_telemetry
    cols = ["serial_number", "manufacturer", "model", "dt", "m_x"]
    p = tmp_path / "logs"
    p.mkdir()
    (p / "a.csv").write_text("serial_number,manufacturer,model,dt,m_x\ns1,A,1,20240101,2\n")
    df = read_telemetry(spark, str(p), columns=cols, metric_pattern="m_", match_headers=False)
    assert [r.m_x for r in df.collect()] == [2.0]
    (p / "b.csv").write_text("dt,serial_number,manufacturer,model,m_x\n20240102,s1,A,1,3\n")
    with pytest.raises(Exception):   # a different layout is refused, never misread
        read_telemetry(spark, str(p), columns=cols, metric_pattern="m_", match_headers=False).collect()
    both = read_telemetry(spark, str(p), columns=cols, metric_pattern="m_")   # sniffed: matched by name
    assert sorted(r.m_x for r in both.collect()) == [2.0, 3.0]


def test_typed_sources(spark, tmp_path):
    import datetime as dt
    from failcast.sources.telemetry import read_faults, read_telemetry
    p = str(tmp_path / "logs")
    spark.createDataFrame([("s1", "A", "1", dt.date(2024, 1, 2), 1.5)],
                          "serial_number string, manufacturer string, model string, dt date, m_x double") \
        .write.parquet(p)
    got = read_telemetry(spark, p, columns=["serial_number", "manufacturer", "model", "dt", "m_x"],
                         metric_pattern="m_", fmt="parquet").collect()
    assert [(r.dt, r.m_x) for r in got] == [(dt.date(2024, 1, 2), 1.5)]
    f = str(tmp_path / "faults")
    spark.createDataFrame([("A", "1", "s1", dt.datetime(2024, 1, 5, 13, 0))],
                          "manufacturer string, model string, serial_number string, fault_time timestamp") \
        .write.parquet(f)
    assert read_faults(spark, f, fmt="parquet").first().fault_time == dt.date(2024, 1, 5)


def test_ensemble_needs_both_classes(spark):
    import pytest
    from pyspark.ml.linalg import Vectors, VectorUDT
    from pyspark.sql import types as T
    from failcast.operators import ensemble as ens
    schema = T.StructType([T.StructField("serial_number", T.StringType()), T.StructField("model", T.StringType()),
                           T.StructField("dt", T.StringType()), T.StructField("label", T.IntegerType()),
                           T.StructField("features", VectorUDT())])
    df = spark.createDataFrame([("s", "1", "2024-01-01", 0, Vectors.dense([1.0]))], schema)
    with pytest.raises(ValueError):
        ens.SelfPacedEnsemble(n_estimators=2).fit(df)


def _toy(spark, n=400, models=3):
    from pyspark.ml.feature import VectorAssembler  # noqa: F401
    from failcast.operators import ensemble as ens
    rows = [(f"s{i}", str(i % models), i, float(i % 17), 1 if i % 17 > 13 and i % 3 == 0 else 0) for i in range(n)]
    df = spark.createDataFrame(rows, "serial_number string, model string, dt int, x double, label int")
    return ens.assembler(["x", "model"]).fit(df).transform(df)


def test_more_models_than_bins(spark):
    from failcast.operators import ensemble as ens
    df = _toy(spark, models=40)
    model = ens.SelfPacedEnsemble(ens.base_learner(n_trees=2, max_depth=2), n_estimators=2, k_bins=4).fit(df)
    assert model.members[0].getMaxBins() >= 40 and model.transform(df).count() == df.count()


def test_rounds_write_ids_and_scores_only(spark, monkeypatch):
    from failcast.operators import ensemble as ens
    written, deleted = {}, []
    keep, drop = ens.materialize, ens.discard
    monkeypatch.setattr(ens, "materialize", lambda df, name="t", **how: written.setdefault(name, df.columns) and keep(df, name, **how))
    monkeypatch.setattr(ens, "discard", lambda *t: (deleted.extend(t), drop(*t)))
    ens.SelfPacedEnsemble(ens.base_learner(n_trees=2, max_depth=2), n_estimators=3, k_bins=4).fit(_toy(spark))
    rounds = [c for n, c in written.items() if n.startswith("spe-scores")]
    assert len(rounds) == 2 and all("features" not in c and "p" in c for c in rounds)
    assert "features" in written["spe-input"] and len(deleted) == 3


def test_copies_of_rows_are_drawn_by_count(spark):
    """Equal rows are known by content: the drawn majority has as many rows as the quota asks for."""
    from failcast.operators import ensemble as ens
    from failcast.operators import sampling as smp
    df = _toy(spark, 60)
    many = df.where("label = 0").limit(1)
    for _ in range(6):
        many = many.unionByName(many)
    spe = ens.SelfPacedEnsemble(id_cols=("serial_number", "model", "dt"))
    data = spe._addressed(df.unionByName(many))
    maj = data.where("label = 0")
    thin = maj.drop("features")
    drawn = smp.undersample_random(thin, thin.limit(0), F.concat(spe._order(0), F.col("_row")), n=50, weight="_copies")
    assert drawn.agg(F.sum("_copies")).first()[0] == 50 and spe._with_features(drawn, data).count() == 50


def test_a_round_evaluates_one_member(spark, monkeypatch):
    """Every member but the last scores the majority once, and later rounds do not score it again."""
    from pyspark.ml.classification import GBTClassificationModel
    from failcast.operators import ensemble as ens
    seen = []
    plain = GBTClassificationModel.transform
    monkeypatch.setattr(GBTClassificationModel, "transform", lambda m, df, *a: (seen.append(m.uid), plain(m, df, *a))[1])
    model = ens.SelfPacedEnsemble(ens.base_learner(n_trees=2, max_depth=2), n_estimators=4, k_bins=4).fit(_toy(spark))
    assert seen == [m.uid for m in model.members[:3]]


def test_running_mean_equals_the_members_together(spark):
    from failcast.operators import ensemble as ens
    spe = ens.SelfPacedEnsemble(ens.base_learner(n_trees=2, max_depth=2), n_estimators=3, k_bins=4)
    model, data = spe.fit(_toy(spark)), spe._addressed(_toy(spark))
    scores = None
    for i, m in enumerate(model.members):
        scores = spe._add_member(i, m, data, scores)
    got = {r._row: r.p for r in scores.collect()}
    assert got == {r._row: r.probability for r in model.transform(data).collect()}


def test_scores_meet_features_without_a_shuffle(spark):
    from failcast.operators import ensemble as ens
    from failcast.scratch import discard, materialize
    spe = ens.SelfPacedEnsemble(ens.base_learner(n_trees=2, max_depth=2), n_estimators=2, k_bins=4)
    model = spe.fit(_toy(spark))
    data = materialize(spe._addressed(_toy(spark)), "input", bucket_by="_row")
    assert data.schema["features"].metadata["ml_attr"]["num_attrs"] == 2
    scores = materialize(spe._add_member(0, model.members[0], data, None), "scores", bucket_by="_row")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = spe._add_member(1, model.members[1], data, scores)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    names = {t.name for t in spark.catalog.listTables()}
    discard(data, scores)
    assert len(names) - len({t.name for t in spark.catalog.listTables()}) == 2


def test_every_copy_of_a_hot_row_can_be_drawn(spark):
    """A third of all rows are one row: it is drawn as often as the quota needs it, in chunks."""
    from failcast.operators import sampling as smp
    df = spark.createDataFrame([("a", 25), ("b", 1), ("c", 4), ("d", 0)], "x string, n long")
    assert sorted(r.x for r in smp.repeated(df, "n", chunk=4).collect()) == ["a"] * 25 + ["b"] + ["c"] * 4


def test_model_and_featurizer_saved_together(spark, tmp_path):
    from failcast.operators import ensemble as ens
    df = _toy(spark)
    featurizer = ens.assembler(["x", "model"]).fit(df.drop("features", "_f_x", "model_idx"))
    model = ens.SelfPacedEnsemble(ens.base_learner(n_trees=2, max_depth=2), n_estimators=2, k_bins=4).fit(df)
    model.save(str(tmp_path / "m"), featurizer)
    again, loaded = ens.SelfPacedEnsembleModel.load_all(str(tmp_path / "m"))
    raw = df.drop("features", "_f_x", "model_idx")
    a = [r.probability for r in again.transform(loaded.transform(raw)).orderBy("dt").collect()]
    assert a == [r.probability for r in model.transform(df).orderBy("dt").collect()]
    model.save(str(tmp_path / "n"))
    assert ens.SelfPacedEnsembleModel.load_all(str(tmp_path / "n"))[1] is None


def test_nested_files_are_read_whatever_the_headers(spark, tmp_path):
    from failcast.sources.telemetry import read_telemetry
    p = tmp_path / "logs"
    (p / "sub" / "deeper").mkdir(parents=True)
    head = "serial_number,manufacturer,model,dt,m_x\n"
    (p / "a.csv").write_text(head + "s1,A,1,20240101,1\n")
    (p / "sub" / "b.csv").write_text(head + "s2,A,1,20240102,2\n")
    cols = ["serial_number", "manufacturer", "model", "dt", "m_x"]
    assert read_telemetry(spark, str(p), columns=cols, metric_pattern="m_").count() == 2
    (p / "sub" / "deeper" / "c.csv").write_text("dt,m_x,serial_number,model,manufacturer,other\n2024010312,3,s3,1,A,z\n")
    got = read_telemetry(spark, str(p), columns=cols, metric_pattern="m_").collect()
    assert sorted((r.serial_number, str(r.dt), r.m_x) for r in got) == [("s1", "2024-01-01", 1.0), ("s2", "2024-01-02", 2.0), ("s3", "2024-01-03", 3.0)]


def test_rejected_days_in_the_same_pass(spark, tmp_path):
    from pyspark.sql import Observation
    from failcast.sources.telemetry import read_telemetry
    (tmp_path / "x.csv").write_text("serial_number,manufacturer,model,dt,m_x\ns,A,1,20240101,1\ns,A,1,2018,1\ns,A,1,,1\n")
    seen = Observation()
    df = read_telemetry(spark, str(tmp_path), columns=["serial_number", "manufacturer", "model", "dt", "m_x"], metric_pattern="m_", rejected=seen)
    assert df.count() == 1 and seen.get["rejected_days"] == 2


def test_fault_log_of_another_shape(spark, tmp_path):
    from failcast.sources.telemetry import read_faults
    (tmp_path / "a.csv").write_text("fault_time,note,serial_number,model,manufacturer\n2018-07-01 10:00:00,n,s1,1,A\n20180702,n,s2,1,A\nbad,n,s3,1,A\n")
    (tmp_path / "b.csv").write_text("manufacturer,model,serial_number,fault_time\nA,1,s4,2018-07-04\n")
    got = sorted((r.serial_number, str(r.fault_time)) for r in read_faults(spark, str(tmp_path)).collect())
    assert got == [("s1", "2018-07-01"), ("s2", "2018-07-02"), ("s3", "None"), ("s4", "2018-07-04")]


def test_shared_folder_is_needed_on_a_cluster(monkeypatch):
    from failcast import scratch

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default
    with pytest.raises(ValueError):
        scratch.shared_dir(Session())


def test_missing_value_lies_below_all_inputs(spark):
    from failcast.operators import ensemble as ens
    df = spark.createDataFrame([(-7.5, 1.0, "a"), (None, float("nan"), "b")], "x double, y double, model string")
    assert ens.missing_constant(df, ["x", "y", "model"]) == -8.5
    assert ens.missing_constant(df.limit(0), ["x", "y", "model"]) == -1.0
    value = ens.missing_constant(df, ["x", "y", "model"])
    got = [r.features.toArray().tolist() for r in ens.assembler(["x", "y", "model"], missing_value=value).fit(df).transform(df).collect()]
    assert got == [[-7.5, 1.0, 0.0], [-8.5, -8.5, 1.0]]
