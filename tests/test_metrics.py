import numpy as np
import pytest

from failcast.operators import metrics as met


def brute_curve(y, s):
    """Ranking curve by brute force over distinct scores (highest first)."""
    order = np.argsort(-s, kind="mergesort")
    s, y = s[order], y[order]
    idx = np.r_[np.where(np.diff(s))[0], len(y) - 1]
    tps = np.cumsum(y)[idx].astype(float)
    fps = 1 + idx - tps
    return s[idx], tps, fps


def brute_metrics(y, s):
    thr, tps, fps = brute_curve(y, s)
    P, N = tps[-1], fps[-1]
    last = np.searchsorted(tps, tps[-1])
    p = tps[: last + 1] / (tps[: last + 1] + fps[: last + 1])
    r = tps[: last + 1] / P
    pp, rr = np.r_[1.0, p], np.r_[0.0, r]
    pr_auc = float(np.sum(np.diff(rr) * (pp[1:] + pp[:-1]) / 2))
    ap = float(np.sum(np.diff(rr) * pp[1:]))
    tpr, fpr = np.r_[0.0, tps / P], np.r_[0.0, fps / N]
    roc = float(np.sum(np.diff(fpr) * (tpr[1:] + tpr[:-1]) / 2))
    f1 = 2 * p * r / (p + r)
    best = None
    for t, f in sorted(zip(thr[: last + 1], f1)):
        if best is None or f > best[1]:
            best = (t, f)
    n = int(y.sum())
    cut = np.percentile(s, 100 * (1 - n / len(y)))
    pred = s > cut
    pan = float(y[pred].mean()) if pred.any() else 0.0
    return dict(thr=thr[: last + 1], pr_auc=pr_auc, ap=ap, roc=roc, best=best, pan=pan)


@pytest.mark.parametrize("seed", [0, 1])
def test_curves_match_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    n = 400
    s = np.round(rng.random(n), 2)           # many ties
    y = (rng.random(n) < 0.15 + 0.5 * s).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "probability double, label int")
    ref = brute_metrics(y, s)
    curve = met.pr_curve(df, n_buckets=8).collect()
    assert sorted(r.threshold for r in curve) == sorted(ref["thr"].tolist())
    assert met.pr_auc(df, n_buckets=8).first()[0] == pytest.approx(ref["pr_auc"])
    assert met.average_precision(df, n_buckets=8).first()[0] == pytest.approx(ref["ap"])
    assert met.roc_auc(df, n_buckets=8).first()[0] == pytest.approx(ref["roc"])
    best = met.best_f1_threshold(df, n_buckets=8).first()
    assert best.threshold == pytest.approx(ref["best"][0]) and best.f1 == pytest.approx(ref["best"][1])
    assert met.precision_at_n(df).first().precision == pytest.approx(ref["pan"])


def test_tied_scores_one_point(spark):
    df = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.5, 1)], "probability double, label int")
    curve = met.pr_curve(df).collect()
    assert len(curve) == 1 and curve[0].tp == 2 and curve[0].fp == 1


def test_roc_invariant_under_monotone_map(spark):
    rng = np.random.default_rng(3)
    s = rng.random(300)
    y = (rng.random(300) < s).astype(int)
    df = spark.createDataFrame([(float(a), float(a) ** 3, int(b)) for a, b in zip(s, y)], "p double, q double, label int")
    assert met.roc_auc(df, "p").first()[0] == pytest.approx(met.roc_auc(df, "q").first()[0])
    ap = met.average_precision(df, "p").first()[0]
    assert 0.0 <= ap <= 1.0


def test_histogram_bins(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (1.0,)], "probability double")
    got = {r.bin: r.n_rows for r in met.score_histogram(df, bins=4).collect()}
    assert got == {0: 1, 1: 0, 2: 1, 3: 2}


def test_prefix_sum_is_layout_independent(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(float(v), 1) for v in rng.random(500)], "v double, c long")
    outs = []
    for parts in (1, 4, 32):
        cum = met.descending_cumsum(df.repartition(parts), "v", ["c"], n_buckets=4, n_fine=8)
        outs.append(sorted((r.v, r.cum_c) for r in cum.collect()))
    assert outs[0] == outs[1] == outs[2]
    values = sorted(outs[0], key=lambda t: -t[0])
    assert [c for _, c in values] == list(range(1, 501))


def test_degenerate_inputs(spark):
    same = spark.createDataFrame([(0.3, 1), (0.3, 0)], "probability double, label int")
    assert [(r.bin, r.n_rows) for r in met.score_histogram(same).collect() if r.n_rows] == [(0, 2)]
    no_pos = spark.createDataFrame([(0.1, 0), (0.7, 0)], "probability double, label int")
    assert met.pr_curve(no_pos).count() == 0
    assert met.pr_auc(no_pos).first()[0] is None
    assert met.roc_auc(no_pos).first()[0] is None
    r = met.precision_at_n(no_pos).first()
    assert r.n_pred == 0 and r.precision == 0.0
    no_neg = spark.createDataFrame([(0.1, 1), (0.7, 1)], "probability double, label int")
    assert met.roc_auc(no_neg).first()[0] is None
    assert met.pr_auc(no_neg).first()[0] == pytest.approx(1.0)


@pytest.mark.parametrize("seed", [0, 4])
def test_curve_metrics_in_one_row(spark, seed):
    rng = np.random.default_rng(seed)
    s = np.round(rng.random(300), 2)
    y = (rng.random(300) < s).astype(int)
    ref = brute_metrics(y, s)
    rows = [(float(a), int(b)) for a, b in zip(s, y)] + [(float("nan"), 1), (None, 1)]
    df = spark.createDataFrame(rows, "probability double, label int")
    r = met.curve_metrics(df, n_buckets=8).first()
    assert (r.n_rows, r.n_positive) == (300, int(y.sum()))
    assert r.pr_auc == pytest.approx(ref["pr_auc"]) and r.roc_auc == pytest.approx(ref["roc"])
    assert r.average_precision == pytest.approx(ref["ap"])
    assert r.threshold == pytest.approx(ref["best"][0]) and r.f1 == pytest.approx(ref["best"][1])
    assert met.pr_auc(df).first()[0] == pytest.approx(ref["pr_auc"])


def test_curve_metrics_read_the_source_once(spark, tmp_path):
    """The written counts carry the rest: deleting the source after the call changes nothing."""
    import shutil
    path = str(tmp_path / "scores")
    spark.createDataFrame([(0.1 * i, i % 2) for i in range(10)], "probability double, label int").write.parquet(path)
    out = met.curve_metrics(spark.read.parquet(path))
    shutil.rmtree(path)
    assert out.first().n_rows == 10


def test_curve_metrics_without_rows(spark):
    none = spark.createDataFrame([], "probability double, label int")
    r = met.curve_metrics(none).first()
    assert r.n_rows is None and r.pr_auc is None and r.f1 is None
    assert [r.n_rows for r in met.score_histogram(none, bins=3).collect()] == [0, 0, 0]


def test_histogram_keeps_empty_bins_and_drops_nan(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (float("nan"),), (None,)], "probability double")
    got = sorted((r.bin, r.n_rows) for r in met.score_histogram(df, bins=10).collect())
    assert got == [(i, 1 if i in (0, 9) else 0) for i in range(10)]
