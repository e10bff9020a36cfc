"""DuckDB SQL oracles for the driver queries (same tables, same column names)."""

from __future__ import annotations

from itertools import combinations

from failcast.plans import scenario as S
from failcast.schema import SMART_SPEC, TELEMETRY_COLUMNS
from failcast.sources.standins import EVENT_METRICS, EVENT_TYPES, EVENTS_SPEC, LINEITEM_METRICS, LINEITEM_SPEC

ORACLE: dict = {}

DD = ("SELECT user_id AS serial_number, 'A' AS manufacturer, user_id % 2 + 1 AS model, CAST(ts AS DATE) AS dt, "
      + ", ".join(f"SUM(CASE WHEN event_type = '{t}' THEN value END) AS m_{t}" for t in EVENT_TYPES)
      + " FROM events GROUP BY 1, 2, 3, 4")

TAGS = ("SELECT user_id AS serial_number, 'A' AS manufacturer, user_id % 2 + 1 AS model, "
        "CAST(ts AS DATE) AS fault_time FROM events WHERE event_type = 'error' AND value > 200")

FIRST_TAGS = ("SELECT serial_number, manufacturer, model, min(fault_time) AS fault_time "
              "FROM tags GROUP BY serial_number, manufacturer, model")

LABELLED = ("SELECT dd.*, f.fault_time, CASE WHEN f.fault_time IS NOT NULL AND "
            f"datediff('day', dd.dt, f.fault_time) <= {S.HORIZON} THEN 1 ELSE 0 END AS label "
            "FROM dd LEFT JOIN first_tags f USING (serial_number, manufacturer, model)")

WIN = ("PARTITION BY model, serial_number ORDER BY datediff('day', DATE '1970-01-01', dt) "
       "RANGE BETWEEN 7 PRECEDING AND CURRENT ROW")

KEYS = "serial_number, manufacturer, model, dt"


def with_(**ctes) -> str:
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in ctes.items()) + " "


def r6(expr: str, name: str) -> str:
    return f"round({expr}, 6) AS {name}"


def log2p1(x: str) -> str:
    # ln(y) / ln(2) reproduces Spark's log2 arithmetic far more often than DuckDB's log2
    # (last-ulp differences get magnified by the interaction columns)
    return f"(CASE WHEN {x} + 1 > 0 THEN ln({x} + 1) / ln(2) END)"


def _window_cols(metrics) -> str:
    return ", ".join(f"max({m}) OVER w - min({m}) OVER w AS window_7_range_{m}, "
                     f"stddev_samp({m}) OVER w AS window_7_std_{m}" for m in metrics)


def features_ctes(spec=EVENTS_SPEC, metrics=EVENT_METRICS, src: str = DD, keys: str = KEYS, win: str = WIN) -> dict:
    """src -> f1 (windows) -> f2 (logs, interaction, weighted sum) -> f3 (scaling, pair sums)."""
    f1 = f"SELECT *, {_window_cols(spec.window_cols)} FROM dd WINDOW w AS ({win})"
    cur = {m: m for m in metrics}
    for c in spec.log_cols:
        cur[c] = log2p1(c)
    target, factor = spec.interaction
    cur[target] = f"({cur[target]} * {factor})"
    anomaly = " + ".join(f"{cur[c]} / CAST({w} AS DOUBLE)" for c, w in spec.weights.items())
    wcols = ", ".join(spec.window_names())
    f2 = (f"SELECT {keys}, " + ", ".join(f"{e} AS {m}" for m, e in cur.items())
          + f", {wcols}, ({anomaly}) AS anomaly_sum FROM f1")
    scaled = {c: f"{c} / CAST({w} AS DOUBLE)" for c, w in spec.weights.items()}
    cols = [scaled.get(m, m) + f" AS {m}" for m in metrics]
    pairs = [f"({scaled[a]}) + ({scaled[b]}) AS sum_{a}_{b}" for a, b in combinations(spec.pair_cols, 2)]
    f3 = f"SELECT {keys}, " + ", ".join(cols) + f", {wcols}, anomaly_sum, " + ", ".join(pairs) + " FROM f2"
    return {"dd": src, "f1": f1, "f2": f2, "f3": f3}


def _round_all(cols, src: str, keep=KEYS) -> str:
    return f"SELECT {keep}, " + ", ".join(r6(c, c) for c in cols) + f" FROM {src}"


ORACLE["device_day"] = with_(dd=DD) + _round_all(EVENT_METRICS, "dd")

ORACLE["trailing_range"] = with_(dd=DD) + (
    f"SELECT {KEYS}, " + ", ".join(r6(f"max({m}) OVER w - min({m}) OVER w", f"window_7_range_{m}")
                                   for m in EVENT_METRICS) + f" FROM dd WINDOW w AS ({WIN})")

ORACLE["trailing_std"] = with_(dd=DD) + (
    f"SELECT {KEYS}, " + ", ".join(r6(f"stddev_samp({m}) OVER w", f"window_7_std_{m}")
                                   for m in EVENT_METRICS) + f" FROM dd WINDOW w AS ({WIN})")

ORACLE["trailing_peers"] = (
    "SELECT event_id, user_id AS serial_number, user_id % 2 + 1 AS model, CAST(ts AS DATE) AS dt, "
    "round(value, 6) AS value, "
    + r6("max(value) OVER w - min(value) OVER w", "window_7_range_value") + ", "
    + r6("stddev_samp(value) OVER w", "window_7_std_value")
    + " FROM events WINDOW w AS (PARTITION BY user_id % 2 + 1, user_id "
      "ORDER BY datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) RANGE BETWEEN 7 PRECEDING AND CURRENT ROW)")

ORACLE["log_interaction"] = with_(
    dd=DD, t=f"SELECT *, max(m_error) OVER w - min(m_error) OVER w AS r_err FROM dd WINDOW w AS ({WIN})") + (
    f"SELECT {KEYS}, " + r6(log2p1("m_click"), "m_click") + ", " + r6(log2p1("m_view"), "m_view") + ", "
    + r6(log2p1("m_error") + " * r_err", "m_error") + ", " + r6(log2p1("m_purchase"), "m_purchase") + " FROM t")

_F = features_ctes()
ORACLE["weighted_sum"] = with_(**_F) + f"SELECT {KEYS}, " + r6("anomaly_sum", "anomaly_sum") + " FROM f3"
ORACLE["pairwise_sums"] = with_(**_F) + _round_all(list(EVENTS_SPEC.pair_cols) + EVENTS_SPEC.pair_names(), "f3")
ORACLE["feature_table"] = with_(**_F) + _round_all(
    EVENT_METRICS + EVENTS_SPEC.window_names() + ["anomaly_sum"] + EVENTS_SPEC.pair_names(), "f3")

ORACLE["parse_day_month"] = (
    "SELECT event_id, CAST(try_strptime(strftime(ts, '%Y%m%d'), '%Y%m%d') AS DATE) AS day, "
    "strftime(CAST(try_strptime(strftime(ts, '%Y%m%d'), '%Y%m%d') AS DATE), '%Y-%m') AS month, "
    "CAST(try_strptime(substr(strftime(ts, '%Y%m%d'), 1, 4), '%Y%m%d') AS DATE) AS short_day, "
    "CAST(try_strptime(substr(props, 1, 8), '%Y%m%d') AS DATE) AS junk_day FROM events")

ORACLE["first_faults"] = with_(tags=TAGS) + (
    "SELECT model, serial_number, min(fault_time) AS fault_time FROM tags GROUP BY model, serial_number")

ORACLE["attach_faults"] = with_(dd=DD, tags=TAGS) + (
    f"SELECT {KEYS}, tags.fault_time FROM dd LEFT JOIN tags USING (serial_number, model, manufacturer)")

LABEL_CTES = {"dd": DD, "tags": TAGS, "first_tags": FIRST_TAGS, "lab": LABELLED}
ORACLE["label_horizon"] = with_(**LABEL_CTES) + f"SELECT {KEYS}, fault_time, label FROM lab"


def split_case(col: str = "dt") -> str:
    parts = [f"WHEN {col} >= DATE '{lo}' AND {col} < DATE '{hi}' THEN '{n}'"
             for n, (lo, hi) in (("train", S.TRAIN), ("val", S.VAL), ("test", S.TEST))]
    return "CASE " + " ".join(parts) + " END"


ORACLE["time_split_counts"] = with_(**LABEL_CTES, s=f"SELECT *, {split_case()} AS split FROM lab") + (
    "SELECT split, label, count(*) AS n_rows FROM s WHERE split IS NOT NULL GROUP BY split, label")


# --- sampling ---------------------------------------------------------------

def md5_order(seed=S.SEED) -> str:
    return ("md5(concat_ws('|', CAST(serial_number AS VARCHAR), CAST(model AS VARCHAR), "
            f"CAST(dt AS VARCHAR), '{seed}'))")


LABM = dict(LABEL_CTES, labm="SELECT *, strftime(dt, '%Y-%m') AS month FROM lab")
TRAIN_RANGE = f"dt >= DATE '{S.TRAIN[0]}' AND dt < DATE '{S.TRAIN[1]}'"

NEG_SAMPLE = (f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY serial_number, model, month "
              f"ORDER BY {md5_order()}) AS rn FROM labm WHERE {TRAIN_RANGE} AND label = 0) WHERE rn <= {S.PER_GROUP}")

POSITIVES = (f"SELECT * FROM labm WHERE label = 1 AND datediff('day', dt, fault_time) <= {S.HORIZON} "
             f"AND dt >= DATE '{S.TRAIN[0]}' AND fault_time < DATE '{S.TAGS_END}'")

ORACLE["sample_per_group"] = with_(**LABM, s=NEG_SAMPLE) + f"SELECT {KEYS}, month FROM s"

ORACLE["training_cohort"] = with_(**LABM, neg=NEG_SAMPLE, pos=POSITIVES) + (
    f"SELECT {KEYS}, label FROM neg UNION ALL SELECT {KEYS}, label FROM pos")

ORACLE["faulty_only_cohort"] = with_(**LABM, pos=POSITIVES) + (
    f"SELECT {KEYS}, label FROM labm WHERE {TRAIN_RANGE} AND fault_time IS NOT NULL AND label = 0 "
    f"UNION ALL SELECT {KEYS}, label FROM pos")

SCORE = f"coalesce(m_error, 0.0) / (coalesce(m_error, 0.0) + CAST({S.SCORE_SCALE} AS DOUBLE))"
CLASSES = dict(LABEL_CTES, sc=f"SELECT {KEYS}, label, {SCORE} AS p FROM lab",
               maj="SELECT * FROM sc WHERE label = 0", mino="SELECT * FROM sc WHERE label = 1")

ORACLE["undersample_random"] = with_(**CLASSES) + (
    f"SELECT {KEYS}, label FROM (SELECT *, row_number() OVER (ORDER BY {md5_order()}) AS rn FROM maj) "
    f"WHERE rn <= (SELECT count(*) FROM mino) UNION ALL SELECT {KEYS}, label FROM mino")

BINNED = dict(CLASSES,
              hm="SELECT *, (CAST(label AS DOUBLE) - p) * (CAST(label AS DOUBLE) - p) AS hardness FROM maj",
              hb="SELECT min(hardness) AS lo, max(hardness) AS hi FROM hm",
              binned=f"SELECT hm.*, CASE WHEN hb.hi = hb.lo THEN 0 ELSE CAST(least(floor((hardness - hb.lo) / "
                     f"((hb.hi - hb.lo) / CAST({S.K_BINS} AS DOUBLE))), {S.K_BINS - 1}) AS INTEGER) END AS bin "
                     "FROM hm, hb")

ORACLE["hardness_bins"] = with_(**BINNED) + f"SELECT {KEYS}, round(hardness, 6) AS hardness, bin FROM binned"


def quota_ctes(i: int, n: int) -> dict:
    import math
    weight = "1.0" if i >= n - 1 else f"1.0 / (mean_hardness + CAST({math.tan(math.pi * 0.5 * i / (n - 1))!r} AS DOUBLE))"
    return dict(
        BINNED,
        st=f"SELECT bin, count(*) AS n_rows, avg(hardness) AS mean_hardness FROM binned GROUP BY bin",
        wt=f"SELECT *, {weight} AS weight FROM st",
        qt="SELECT wt.*, CASE WHEN (SELECT hi = lo FROM hb) THEN (SELECT count(*) FROM mino) ELSE "
           "CAST(floor((SELECT count(*) FROM mino) * weight / sum(weight) OVER ()) AS BIGINT) + 1 END AS quota FROM wt")


ORACLE["bin_quotas"] = with_(**quota_ctes(S.ROUND, S.N_ROUNDS)) + (
    "SELECT bin, n_rows, round(mean_hardness, 6) AS mean_hardness, round(weight, 6) AS weight, quota FROM qt")


def paced_draw_sql(i: int, n: int) -> str:
    return with_(**quota_ctes(i, n)) + (
        f"SELECT {KEYS}, label, bin FROM (SELECT b.*, q.quota, row_number() OVER (PARTITION BY b.bin "
        f"ORDER BY {md5_order()}) AS rn FROM binned b JOIN qt q USING (bin)) WHERE rn <= quota "
        f"UNION ALL SELECT {KEYS}, label, CAST(NULL AS INTEGER) AS bin FROM mino")


ORACLE["undersample_self_paced"] = paced_draw_sql(S.ROUND, S.N_ROUNDS)
ORACLE["undersample_last_round"] = paced_draw_sql(S.N_ROUNDS - 1, S.N_ROUNDS)


# --- alerts and metrics ---------------------------------------------------------

SCORED = dict(LABEL_CTES, sc=f"SELECT {KEYS}, fault_time, label, {SCORE} AS p FROM lab")
_SLOPE = (float(S.THRESH_HI) - float(S.THRESH_LO)) / float(S.THRESH_DAYS)
THRESH = dict(SCORED, th=f"SELECT *, CAST({S.THRESH_HI!r} AS DOUBLE) - datediff('day', DATE '{S.THRESH_BEGIN}', dt) "
                         f"* CAST({_SLOPE!r} AS DOUBLE) AS thresh FROM sc")

ORACLE["threshold_alerts"] = with_(**THRESH) + (
    f"SELECT {KEYS}, round(p, 6) AS p, round(thresh, 6) AS thresh FROM th WHERE p > thresh")

ORACLE["first_alerts"] = with_(**THRESH) + (
    "SELECT manufacturer, model, serial_number, min(dt) AS dt FROM th WHERE p > thresh "
    "GROUP BY manufacturer, model, serial_number ORDER BY dt, serial_number")

TEST_RANGE = f"dt >= DATE '{S.TEST[0]}' AND dt < DATE '{S.TEST[1]}'"
FT_PERIOD = f"fault_time >= DATE '{S.TEST[0]}' AND fault_time < DATE '{S.TEST[1]}'"
EVAL = dict(SCORED, ff="SELECT model, serial_number, min(fault_time) AS fault_time FROM tags GROUP BY model, serial_number")


def prf_select(src: str, extra: str = "") -> str:
    p = "CAST(ntpp AS DOUBLE) / (npp + 1e-20)"
    r = "CAST(ntpr AS DOUBLE) / (npr + 1e-20)"
    return (f"SELECT {extra}npp, ntpp, npr, ntpr, round({p}, 6) AS precision, round({r}, 6) AS recall, "
            f"round(2.0 * ({p}) * ({r}) / (({p}) + ({r}) + 1e-10), 6) AS F1 FROM {src}")


ORACLE["alert_metrics"] = with_(
    **EVAL,
    fa=f"SELECT model, serial_number, min(dt) AS dt FROM sc WHERE {TEST_RANGE} AND p > CAST({S.SWEEP[2]!r} AS DOUBLE) "
       "GROUP BY model, serial_number",
    j="SELECT * FROM fa FULL OUTER JOIN ff USING (model, serial_number)",
    c="SELECT count(*) FILTER (WHERE dt IS NOT NULL) AS npp, "
      f"count(*) FILTER (WHERE dt IS NOT NULL AND fault_time IS NOT NULL AND fault_time - {S.HORIZON} <= dt) AS ntpp, "
      f"count(*) FILTER (WHERE {FT_PERIOD}) AS npr, "
      f"count(*) FILTER (WHERE {FT_PERIOD} AND dt IS NOT NULL AND fault_time >= dt) AS ntpr FROM j") + prf_select("c")

ORACLE["threshold_sweep"] = with_(
    **EVAL,
    t="SELECT * FROM (VALUES " + ", ".join(f"(CAST({x!r} AS DOUBLE))" for x in S.SWEEP) + ") v(threshold)",
    fa=f"SELECT t.threshold, model, serial_number, min(dt) AS dt FROM sc JOIN t ON sc.p > t.threshold "
       f"WHERE {TEST_RANGE} GROUP BY t.threshold, model, serial_number",
    c="SELECT t.threshold, "
      "(SELECT count(*) FROM fa WHERE fa.threshold = t.threshold) AS npp, "
      "(SELECT count(*) FROM fa JOIN ff USING (model, serial_number) WHERE fa.threshold = t.threshold "
      f"AND ff.fault_time - {S.HORIZON} <= fa.dt) AS ntpp, "
      f"(SELECT count(*) FROM ff WHERE {FT_PERIOD}) AS npr, "
      "(SELECT count(*) FROM ff JOIN fa USING (model, serial_number) WHERE fa.threshold = t.threshold "
      f"AND ff.{FT_PERIOD} AND ff.fault_time >= fa.dt) AS ntpr FROM t") + prf_select("c", "threshold, ")

def curve_ctes(src: str = "sc") -> dict:
    return dict(
        cnt=f"SELECT p AS threshold, CAST(sum(label) AS BIGINT) AS pos, CAST(count(*) - sum(label) AS BIGINT) AS neg "
            f"FROM {src} GROUP BY p",
        cum="SELECT threshold, pos, neg, "
            "CAST(sum(pos) OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS tp, "
            "CAST(sum(neg) OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS fp, "
            "(SELECT CAST(sum(pos) AS BIGINT) FROM cnt) AS P, (SELECT CAST(sum(neg) AS BIGINT) FROM cnt) AS N FROM cnt",
        pts="SELECT threshold, tp, fp, CAST(tp AS DOUBLE) / (tp + fp) AS precision, CAST(tp AS DOUBLE) / P AS recall, "
            "coalesce(CAST(tp - pos AS DOUBLE) / nullif(tp - pos + fp - neg, 0), 1.0) AS p_prev, "
            "CAST(tp - pos AS DOUBLE) / P AS r_prev FROM cum WHERE tp - pos < P")


CURVE = dict(SCORED, **curve_ctes())

ORACLE["pr_curve"] = with_(**CURVE) + (
    "SELECT round(threshold, 6) AS threshold, tp, fp, round(precision, 6) AS precision, round(recall, 6) AS recall "
    "FROM pts")
ORACLE["pr_auc"] = with_(**CURVE) + (
    "SELECT round(sum((recall - r_prev) * (precision + p_prev) / 2.0), 6) AS pr_auc FROM pts")
ORACLE["average_precision"] = with_(**CURVE) + (
    "SELECT round(sum((recall - r_prev) * precision), 6) AS average_precision FROM pts")
ORACLE["roc_auc"] = with_(**CURVE) + (
    "SELECT round(sum((CAST(fp AS DOUBLE) / N - CAST(fp - neg AS DOUBLE) / N) * "
    "(CAST(tp AS DOUBLE) / P + CAST(tp - pos AS DOUBLE) / P) / 2.0), 6) AS roc_auc FROM cum")
ORACLE["best_f1"] = with_(**CURVE, f="SELECT threshold, precision, recall, "
                          "2.0 * precision * recall / nullif(precision + recall, 0) AS f1 FROM pts") + (
    "SELECT round(threshold, 6) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, "
    "round(f1, 6) AS f1 FROM f WHERE f1 IS NOT NULL ORDER BY f1 DESC, threshold ASC LIMIT 1")
ORACLE["precision_at_n"] = with_(
    **SCORED,
    n="SELECT count(*) AS N, sum(label) AS P FROM sc",
    h="SELECT (1.0 - CAST(P AS DOUBLE) / CAST(N AS DOUBLE)) * CAST(N - 1 AS DOUBLE) AS h, N FROM n",
    r="SELECT p, row_number() OVER (ORDER BY p) - 1 AS rk FROM sc",
    v="SELECT max(p) FILTER (WHERE rk = (SELECT floor(h) FROM h)) AS v_lo, "
      "max(p) FILTER (WHERE rk = (SELECT least(floor(h) + 1, N - 1) FROM h)) AS v_hi FROM r",
    t="SELECT CASE WHEN h - floor(h) > 0 THEN v_lo + (v_hi - v_lo) * (h - floor(h)) ELSE v_lo END AS thr FROM h, v",
    c="SELECT thr, count(*) FILTER (WHERE p > thr) AS n_pred, "
      "CAST(coalesce(sum(label) FILTER (WHERE p > thr), 0) AS BIGINT) AS tp FROM sc, t GROUP BY thr") + (
    "SELECT round(thr, 6) AS threshold, n_pred, tp, "
    "round(CASE WHEN n_pred = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / n_pred END, 6) AS precision FROM c")
ORACLE["score_histogram"] = with_(**SCORED, b="SELECT min(p) AS lo, max(p) AS hi FROM sc", c=(
    f"SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((p - lo) / (hi - lo) * {float(S.HIST_BINS)!r}), "
    f"{S.HIST_BINS - 1}) END AS INTEGER) AS bin, count(*) AS n FROM sc, b WHERE p IS NOT NULL GROUP BY 1")) + (
    f"SELECT CAST(i AS INTEGER) AS bin, coalesce(n, 0) AS n_rows FROM range({S.HIST_BINS}) r(i) LEFT JOIN c ON c.bin = i")


# --- sources and sinks ------------------------------------------------------------

ORACLE["csv_roundtrip"] = with_(dd=DD) + (
    "SELECT CAST(serial_number AS VARCHAR) AS serial_number, manufacturer, CAST(model AS VARCHAR) AS model, dt, "
    + ", ".join(r6(m, m) for m in EVENT_METRICS) + f" FROM dd WHERE dt >= DATE '{S.TEST[0]}'")

ORACLE["feature_cache"] = with_(**_F) + (
    f"SELECT {KEYS}, strftime(dt, '%Y-%m') AS month, "
    + ", ".join(r6(c, c) for c in EVENT_METRICS + EVENTS_SPEC.window_names() + ["anomaly_sum"]
                + EVENTS_SPEC.pair_names()) + " FROM f3")

ORACLE["alert_file"] = with_(**THRESH) + (
    "SELECT manufacturer, CAST(model AS VARCHAR) AS model, CAST(serial_number AS VARCHAR) AS serial_number, "
    "min(dt) AS dt FROM th WHERE p > thresh GROUP BY manufacturer, model, serial_number")

ORACLE["fault_log"] = with_(tags=TAGS) + (
    "SELECT manufacturer, CAST(model AS VARCHAR) AS model, CAST(serial_number AS VARCHAR) AS serial_number, "
    "fault_time FROM tags")

ORACLE["first_alerts_sql"] = ORACLE["first_alerts"]


# --- streaming ------------------------------------------------------------------

ORACLE["stream_first_alerts"] = with_(
    dd=DD, f=f"SELECT *, max(m_error) OVER w - min(m_error) OVER w AS r FROM dd WINDOW w AS ({WIN})",
    s=f"SELECT *, coalesce(r, 0.0) / (coalesce(r, 0.0) + CAST({S.SCORE_SCALE} AS DOUBLE)) AS probability FROM f") + (
    "SELECT manufacturer, CAST(model AS VARCHAR) AS model, CAST(serial_number AS VARCHAR) AS serial_number, "
    f"min(dt) AS dt FROM s WHERE probability > CAST({S.SWEEP[4]!r} AS DOUBLE) "
    "GROUP BY manufacturer, model, serial_number")


# --- other supplied tables --------------------------------------------------------

LI_KEYS = "l_orderkey, l_linenumber, serial_number, manufacturer, model, dt"
LI_SRC = ("SELECT l_orderkey, l_linenumber, l_suppkey AS serial_number, 'A' AS manufacturer, "
          "l_suppkey % 2 + 1 AS model, CAST(l_shipdate AS DATE) AS dt, "
          + ", ".join(f"{m} + 0.0 AS {m}" for m in LINEITEM_METRICS) + " FROM lineitem")
_LI = features_ctes(LINEITEM_SPEC, LINEITEM_METRICS, LI_SRC, LI_KEYS)
ORACLE["long_history_features"] = with_(**_LI) + (
    f"SELECT {LI_KEYS}, " + ", ".join(
        f"round({c}, 6) + 0.0 AS {c}" for c in LINEITEM_METRICS + LINEITEM_SPEC.window_names() + ["anomaly_sum"]
        + LINEITEM_SPEC.pair_names()) + " FROM f3")

DOC_CURVE = dict(
    sc="SELECT l.quality AS label, CAST(d.n_chars AS DOUBLE) AS p FROM labels l JOIN documents d USING (doc_id)",
    cnt=CURVE["cnt"], cum=CURVE["cum"], pts=CURVE["pts"])
ORACLE["doc_pr_curve"] = with_(**DOC_CURVE) + (
    "SELECT round(threshold, 6) AS threshold, tp, fp, round(precision, 6) AS precision, round(recall, 6) AS recall "
    "FROM pts")
ORACLE["doc_roc_auc"] = with_(**DOC_CURVE) + (
    "SELECT round(sum((CAST(fp AS DOUBLE) / N - CAST(fp - neg AS DOUBLE) / N) * "
    "(CAST(tp AS DOUBLE) / P + CAST(tp - pos AS DOUBLE) / P) / 2.0), 6) AS roc_auc FROM cum")


_STEP = (0.01 + 0.03) / 8
ORACLE["best_f1_sweep"] = with_(
    **EVAL,
    tsc=f"SELECT * FROM sc WHERE {TEST_RANGE}",
    **curve_ctes("tsc"),
    best="SELECT threshold AS best FROM (SELECT threshold, 2.0 * precision * recall / nullif(precision + recall, 0) "
         "AS f1 FROM pts) WHERE f1 IS NOT NULL ORDER BY f1 DESC, threshold ASC LIMIT 1",
    t="SELECT (best - CAST(0.01 AS DOUBLE)) + i * CAST(" + repr(_STEP) + " AS DOUBLE) AS threshold "
      "FROM best, range(9) r(i)",
    fa="SELECT t.threshold, model, serial_number, min(dt) AS dt FROM tsc JOIN t ON tsc.p > t.threshold "
       "GROUP BY t.threshold, model, serial_number",
    c="SELECT t.threshold, "
      "(SELECT count(*) FROM fa WHERE fa.threshold = t.threshold) AS npp, "
      "(SELECT count(*) FROM fa JOIN ff USING (model, serial_number) WHERE fa.threshold = t.threshold "
      f"AND ff.fault_time - {S.HORIZON} <= fa.dt) AS ntpp, "
      f"(SELECT count(*) FROM ff WHERE {FT_PERIOD}) AS npr, "
      "(SELECT count(*) FROM ff JOIN fa USING (model, serial_number) WHERE fa.threshold = t.threshold "
      f"AND ff.{FT_PERIOD} AND ff.fault_time >= fa.dt) AS ntpr FROM t") + prf_select("c", "round(threshold, 6) AS threshold, ")


SMART_METRICS = [c for c in TELEMETRY_COLUMNS if "smart" in c]
SMART_SRC = ("SELECT 'disk_' || CAST(l_suppkey AS VARCHAR) AS serial_number, 'A' AS manufacturer, "
             "CAST(l_suppkey % 2 + 1 AS VARCHAR) AS model, CAST(l_shipdate AS DATE) AS dt, "
             + ", ".join(f"CASE WHEN l_linenumber <> {j % 7 + 1} THEN l_quantity * CAST({float(j % 5 + 1)!r} AS DOUBLE) "
                         f"+ l_discount * CAST({100.0 * (j % 3)!r} AS DOUBLE) + l_tax * CAST({100.0 * (j % 7)!r} AS DOUBLE) "
                         f"END AS {m}" for j, m in enumerate(SMART_METRICS)) + " FROM lineitem")
_SM = features_ctes(SMART_SPEC, SMART_METRICS, SMART_SRC, KEYS)
ORACLE["smart_recipe"] = with_(**_SM) + (
    f"SELECT {KEYS}, " + ", ".join(
        f"round({c}, 6) + 0.0 AS {c}" for c in SMART_METRICS + SMART_SPEC.window_names() + ["anomaly_sum"]
        + SMART_SPEC.pair_names()) + " FROM f3")


# --- further sources, evaluation and the learned half -------------------------------------

ORACLE["trailing_null_device"] = (
    "SELECT event_id, CASE WHEN user_id % 5 <> 0 THEN user_id END AS serial_number, 1 AS model, CAST(ts AS DATE) AS dt, "
    "round(value, 6) AS value, " + r6("max(value) OVER w - min(value) OVER w", "window_7_range_value") + ", "
    + r6("stddev_samp(value) OVER w", "window_7_std_value")
    + " FROM events WINDOW w AS (PARTITION BY CASE WHEN user_id % 5 <> 0 THEN user_id END "
      "ORDER BY datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) RANGE BETWEEN 7 PRECEDING AND CURRENT ROW)")

ORACLE["trailing_prepartitioned"] = with_(dd=DD) + (
    f"SELECT {KEYS}, " + ", ".join(r6(f"max({m}) OVER w - min({m}) OVER w", f"window_7_range_{m}") + ", "
                                   + r6(f"stddev_samp({m}) OVER w", f"window_7_std_{m}") for m in EVENT_METRICS)
    + f" FROM dd WINDOW w AS ({WIN})")

_TEXT_DAYS = ("SELECT CAST(serial_number AS VARCHAR) AS serial_number, manufacturer, CAST(model AS VARCHAR) AS model, dt, "
              + ", ".join(r6(m, m) for m in EVENT_METRICS) + " FROM dd")
ORACLE["csv_full_read"] = with_(dd=DD) + _TEXT_DAYS
ORACLE["csv_flat_pruned"] = with_(dd=DD) + _TEXT_DAYS + f" WHERE dt >= DATE '{S.TEST[0]}'"
ORACLE["fault_log_foreign"] = ORACLE["fault_log"]

_F1 = "2.0 * precision * recall / nullif(precision + recall, 0)"


def curve_row(src: str, extra: str = "") -> str:
    """All curve metrics of the rows of one CTE, as a subquery of its own."""
    body = with_(**{k: v.replace("FROM sc ", f"FROM {src} ") for k, v in curve_ctes(src).items()},
                 best=f"SELECT threshold, precision, recall, {_F1} AS f1 FROM pts WHERE {_F1} IS NOT NULL ORDER BY f1 DESC, threshold LIMIT 1")
    return (f"SELECT {extra}* FROM ({body} SELECT (SELECT CAST(sum(pos + neg) AS BIGINT) FROM cnt) AS n_rows, "
            "(SELECT CAST(sum(pos) AS BIGINT) FROM cnt) AS n_positive, "
            "(SELECT round(sum((recall - r_prev) * (precision + p_prev) / 2.0), 6) FROM pts) AS pr_auc, "
            "(SELECT round(sum((recall - r_prev) * precision), 6) FROM pts) AS average_precision, "
            "(SELECT round(sum((CAST(fp AS DOUBLE) / N - CAST(fp - neg AS DOUBLE) / N) * "
            "(CAST(tp AS DOUBLE) / P + CAST(tp - pos AS DOUBLE) / P) / 2.0), 6) FROM cum) AS roc_auc, "
            "round(threshold, 6) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM best)")


_RANGES = {n: f"SELECT * FROM sc WHERE dt >= DATE '{lo}' AND dt < DATE '{hi}'" for n, (lo, hi) in (("train", S.TRAIN), ("val", S.VAL), ("test", S.TEST))}
ORACLE["curve_metrics"] = with_(**SCORED) + curve_row("sc")
ORACLE["evaluation_report"] = with_(**SCORED, **{f"sc_{n}": q for n, q in _RANGES.items()}) + " UNION ALL ".join(
    curve_row(f"sc_{n}", f"'{n}' AS split, ") for n in _RANGES)


def bayes_ctes() -> dict:
    """The self-paced rounds on binarised metrics with Bernoulli naive Bayes members (smoothing 1), round by round."""
    bits = [f"b{j}" for j in range(len(EVENT_METRICS))]
    ctes = dict(LABEL_CTES, bit=f"SELECT {KEYS}, label, " + ", ".join(
        f"CASE WHEN {m} > CAST({S.BIT_OVER!r} AS DOUBLE) THEN 1 ELSE 0 END AS {b}" for m, b in zip(EVENT_METRICS, bits)) + " FROM lab")
    ctes["past"] = f"SELECT * FROM bit WHERE dt >= DATE '{S.TRAIN[0]}' AND dt < DATE '{S.TEST[0]}'"
    ctes["maj"], ctes["mino"] = "SELECT * FROM past WHERE label = 0", "SELECT * FROM past WHERE label = 1"
    cols = f"{KEYS}, label, " + ", ".join(bits)

    def chance(i):
        side = lambda c: (f"ln(n{c} + 1.0) - ln(n0 + n1 + 2.0) + " + " + ".join(
            f"CASE WHEN {b} = 1 THEN ln(s{c}_{b} + 1.0) - ln(n{c} + 2.0) ELSE ln(1.0 - (s{c}_{b} + 1.0) / (n{c} + 2.0)) END" for b in bits))
        return f"1.0 / (1.0 + exp(({side(0)}) - ({side(1)})))"

    for i in range(S.BIT_ROUNDS):
        if i == 0:
            ctes["draw0"] = (f"SELECT {cols} FROM (SELECT *, row_number() OVER (ORDER BY {md5_order(f'{S.SEED}:0')}) AS rn FROM maj) "
                             "WHERE rn <= (SELECT count(*) FROM mino)")
        else:
            import math
            weight = "1.0" if i == S.BIT_ROUNDS - 1 else f"1.0 / (mean_h + CAST({math.tan(math.pi * 0.5 * i / (S.BIT_ROUNDS - 1))!r} AS DOUBLE))"
            mean = " + ".join(f"p{j}" for j in range(i))
            k = S.K_BINS
            ctes[f"h{i}"] = f"SELECT *, pow(({mean}) / {float(i)!r}, 2) AS h FROM score{i - 1}"
            ctes[f"e{i}"] = f"SELECT min(h) AS lo, max(h) AS hi, (max(h) - min(h)) / CAST({k} AS DOUBLE) AS step FROM h{i}"
            ctes[f"n{i}"] = (f"SELECT h{i}.*, lo, step, CASE WHEN hi = lo OR step = 0 THEN 0 ELSE CAST(least(floor((h - lo) / step), {k - 1}) AS INTEGER) END AS guess, "
                             f"hi = lo OR step = 0 AS flat FROM h{i}, e{i}")
            ctes[f"b{i}"] = (f"SELECT *, CASE WHEN flat THEN 0 WHEN h < lo + guess * step THEN greatest(guess - 1, 0) "
                             f"WHEN guess < {k - 1} AND h >= lo + (guess + 1) * step THEN guess + 1 ELSE guess END AS bin FROM n{i}")
            ctes[f"w{i}"] = f"SELECT bin, {weight} AS w FROM (SELECT bin, avg(h) AS mean_h FROM b{i} GROUP BY bin)"
            ctes[f"q{i}"] = (f"SELECT bin, CASE WHEN count(*) OVER () = 1 THEN (SELECT count(*) FROM mino) ELSE "
                             f"CAST(floor((SELECT count(*) FROM mino) * w / sum(w) OVER ()) AS BIGINT) + 1 END AS quota FROM w{i}")
            ctes[f"draw{i}"] = (f"SELECT {cols} FROM (SELECT b.*, quota, row_number() OVER (PARTITION BY b.bin ORDER BY {md5_order(f'{S.SEED}:{i}')}) AS rn "
                                f"FROM b{i} b JOIN q{i} USING (bin)) WHERE rn <= quota")
        both = f"(SELECT * FROM draw{i} UNION ALL SELECT {cols} FROM mino)"
        ctes[f"par{i}"] = "SELECT " + ", ".join(
            f"count(*) FILTER (label = {c}) AS n{c}, " + ", ".join(f"coalesce(sum({b}) FILTER (label = {c}), 0) AS s{c}_{b}" for b in bits) for c in (0, 1)) + f" FROM {both}"
        before = "maj" if i == 0 else f"score{i - 1}"
        ctes[f"score{i}"] = f"SELECT {before}.*, {chance(i)} AS p{i} FROM {before}, par{i}"
    test, total = f"(SELECT * FROM bit WHERE {TEST_RANGE})", []
    for i in range(S.BIT_ROUNDS):
        ctes[f"test{i}"] = f"SELECT t.*, {chance(i)} AS p{i} FROM {test} t, par{i}"
        test = f"test{i}"
        total.append(f"p{i}")
    ctes["final"] = f"SELECT *, ({' + '.join(total)}) / {float(S.BIT_ROUNDS)!r} AS probability FROM {test}"
    return ctes


_BAYES = with_(**bayes_ctes())
ORACLE["bayes_ensemble_score"] = _BAYES + (
    f"SELECT {KEYS}, label, round(probability, 6) AS probability, CASE WHEN probability > 0.5 THEN 1 ELSE 0 END AS prediction FROM final")
ORACLE["bayes_model_roundtrip"] = _BAYES + f"SELECT {KEYS}, round(probability, 6) AS probability FROM final"
ORACLE["bayes_ensemble_alerts"] = _BAYES + (
    f"SELECT manufacturer, model, serial_number, min(dt) AS dt FROM final WHERE probability > CAST({S.BIT_THRESHOLD!r} AS DOUBLE) GROUP BY ALL")
ORACLE["ensemble_facts"] = with_(dd=DD) + (
    f"SELECT {KEYS}, true AS in_unit, true AS label_fits, true AS reload_equal FROM dd WHERE {TEST_RANGE}")
_INPUTS = EVENT_METRICS + EVENTS_SPEC.window_names() + ["anomaly_sum"] + EVENTS_SPEC.pair_names() + ["model"]
ORACLE["importance_facts"] = "SELECT feature, true AS in_range FROM (VALUES " + ", ".join(f"('{c}')" for c in _INPUTS) + ") v(feature)"


# --- saved trees and categories -------------------------------------------------------------

ORACLE["compiled_trees"] = with_(**LABEL_CTES) + "SELECT count(*) AS n_rows, CAST(0.0 AS DOUBLE) AS largest_difference, true AS separates FROM lab"
ORACLE["split_counts"] = ("SELECT m.member, t.tree, true AS whole, true AS splits, true AS all_counted, true AS all_features "
                          "FROM (SELECT unnest([0, 1, 2]) AS member) m, (SELECT unnest([0, 1, 2, 3, 4]) AS tree) t")
ORACLE["category_codes"] = (
    "SELECT category, n_rows, CAST(CASE WHEN n_rows >= 600 AND rank <= 31 THEN rank - 1 ELSE least(31, (SELECT count(*) FROM (SELECT l_suppkey FROM lineitem "
    "GROUP BY l_suppkey HAVING count(*) >= 600))) END AS INTEGER) AS code FROM (SELECT CAST(l_suppkey AS VARCHAR) AS category, count(*) AS n_rows, "
    "row_number() OVER (ORDER BY count(*) DESC, CAST(l_suppkey AS VARCHAR)) AS rank FROM lineitem GROUP BY l_suppkey)")
ORACLE["feature_cache_refresh"] = ORACLE["feature_cache"]
