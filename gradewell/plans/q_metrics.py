"""Registered metric queries (M1-M10) over the derived prediction tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradewell.operators import metrics as M
from gradewell.plans import fixtures as X
from gradewell.plans.registry import query

BP, RP = X.SQL_BINARY_PREDICTIONS, X.SQL_REGRESSION_PREDICTIONS
EPS = "CAST(2.220446049250313e-16 AS DOUBLE)"


def _r(c, n=9):
    return F.round(c, n).alias(c)


def _auc_sql(src: str, keys: str, y: str, score: str) -> str:
    good = f"{score} IS NOT NULL AND NOT isnan(CAST({score} AS DOUBLE)) AND {y} IS NOT NULL"
    return f"""
SELECT {keys}, round(CASE WHEN sum(pos) > 0 AND sum(neg) > 0 AND sum(bad) = 0
    THEN sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) END, 9) AS roc_auc,
  CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg, CAST(sum(bad) AS BIGINT) AS n_invalid
FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY {keys} ORDER BY s NULLS FIRST
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
      FROM (SELECT {keys}, CASE WHEN {good} THEN {score} END AS s, sum(CASE WHEN {good} THEN CAST({y} AS BIGINT) ELSE 0 END) AS pos,
              sum(CASE WHEN {good} THEN 1 - CAST({y} AS BIGINT) ELSE 0 END) AS neg, sum(CASE WHEN {good} THEN 0 ELSE 1 END) AS bad
            FROM {src} GROUP BY ALL))
GROUP BY {keys}"""


#: A run whose scores are partly NaN or null.
_BAD_SQL = """(SELECT run_id, y_true, y_score FROM binary_predictions UNION ALL
  SELECT 'bad', y_true, CASE row_id % 50 WHEN 0 THEN CAST('NaN' AS DOUBLE) WHEN 1 THEN NULL ELSE y_score END
  FROM binary_predictions WHERE run_id = 'F')"""


def _some_bad(p, run: str = "F", score: str = "y_score"):
    r = F.col("row_id") % 50
    return p.where(F.col("run_id") == run).withColumn("run_id", F.lit("bad")).withColumn(
        score, F.when(r == 0, float("nan")).when(r != 1, F.col(score)))


@query("m1_roc_auc", X.with_views(_auc_sql(_BAD_SQL, "run_id", "y_true", "y_score"), BP))
def m1_roc_auc(spark, sf_dir):
    p = X.binary_predictions(spark, sf_dir)
    p = p.unionByName(_some_bad(p))
    return M.roc_auc(p).select("run_id", _r("roc_auc"), "n_pos", "n_neg", "n_invalid")


@query("m2_accuracy", X.with_views("""
SELECT run_id, round(avg(CAST(CAST(y_score > 0.5 AS INTEGER) = y_true AS DOUBLE)), 9) AS accuracy
FROM binary_predictions GROUP BY run_id""", BP))
def m2_accuracy(spark, sf_dir):
    return M.accuracy(X.binary_predictions(spark, sf_dir)).select("run_id", _r("accuracy"))


def _f1_sql(src: str, pred: str) -> str:
    return f"""
SELECT run_id, round(avg(CASE WHEN n_true + n_pred > 0 THEN 2.0 * tp / (n_true + n_pred) ELSE 0.0 END), 9) AS f1_macro,
  CAST(count(*) AS BIGINT) AS n_labels
FROM (SELECT run_id, label, sum(n_true) AS n_true, sum(n_pred) AS n_pred, sum(tp) AS tp FROM (
    SELECT run_id, y_true AS label, 1 AS n_true, 0 AS n_pred, CAST(y_true = {pred} AS INTEGER) AS tp FROM {src}
    UNION ALL
    SELECT run_id, {pred} AS label, 0, 1, 0 FROM {src}) GROUP BY run_id, label)
GROUP BY run_id"""


@query("m3_f1_macro", X.with_views(_f1_sql("multiclass_predictions", "y_pred"), X.SQL_MULTICLASS_PREDICTIONS))
def m3_f1_macro(spark, sf_dir):
    p = X.multiclass_predictions(spark, sf_dir)
    return M.f1_macro(p, score="y_pred").select("run_id", _r("f1_macro"), "n_labels")


@query("m3_f1_macro_binary", X.with_views(_f1_sql("binary_predictions", "CAST(y_score > 0.5 AS INTEGER)"), BP))
def m3_f1_macro_binary(spark, sf_dir):
    return M.f1_macro(X.binary_predictions(spark, sf_dir)).select("run_id", _r("f1_macro"), "n_labels")


@query("m4_neg_log_loss", X.with_views(f"""
SELECT run_id, round(avg(y_true * ln(p) + (1 - y_true) * ln(1 - p)), 9) AS neg_log_loss
FROM (SELECT run_id, y_true, least(greatest(y_score, {EPS}), 1 - {EPS}) AS p FROM binary_predictions)
GROUP BY run_id""", BP))
def m4_neg_log_loss(spark, sf_dir):
    return M.neg_log_loss(X.binary_predictions(spark, sf_dir)).select("run_id", _r("neg_log_loss"))


@query("m4_neg_log_loss_multiclass", X.with_views(f"""
SELECT run_id, round(avg(ln(pt / s)), 9) AS neg_log_loss
FROM (SELECT run_id, row_id, sum(p) AS s, max(CASE WHEN class_idx = y_true THEN p END) AS pt
      FROM (SELECT *, least(greatest(score, {EPS}), 1 - {EPS}) AS p FROM multiclass_scores)
      GROUP BY run_id, row_id)
GROUP BY run_id""", X.SQL_MULTICLASS_SCORES))
def m4_neg_log_loss_multiclass(spark, sf_dir):
    return M.neg_log_loss_multiclass(X.multiclass_scores(spark, sf_dir)).select("run_id", _r("neg_log_loss"))


@query("m5_neg_rmse", X.with_views("""
SELECT run_id, round(-sqrt(avg(pow(y_true - y_pred, 2))), 6) AS neg_rmse FROM regression_predictions GROUP BY run_id""", RP))
def m5_neg_rmse(spark, sf_dir):
    return M.neg_rmse(X.regression_predictions(spark, sf_dir)).select("run_id", _r("neg_rmse", 6))


@query("m6_neg_mae", X.with_views("""
SELECT run_id, round(-avg(abs(y_true - y_pred)), 6) AS neg_mae FROM regression_predictions GROUP BY run_id""", RP))
def m6_neg_mae(spark, sf_dir):
    return M.neg_mae(X.regression_predictions(spark, sf_dir)).select("run_id", _r("neg_mae", 6))


_R2_SQL = """
SELECT run_id, round(CASE WHEN sst > 0 THEN 1 - ssr / sst WHEN ssr = 0 THEN 1.0 ELSE 0.0 END, 9) AS r2
FROM (SELECT run_id, sum(pow(y_true - y_pred, 2)) AS ssr, var_pop(y_true) * count(y_true) AS sst
      FROM regression_predictions GROUP BY run_id)"""


@query("m7_r2", X.with_views(_R2_SQL, RP))
def m7_r2(spark, sf_dir):
    return M.r2(X.regression_predictions(spark, sf_dir)).select("run_id", _r("r2"))


@query("m8_auc_ovr_macro", X.with_views(f"""
SELECT run_id, round(CASE WHEN sum(n_invalid) = 0 THEN avg(roc_auc) END, 9) AS auc_ovr_macro, CAST(count(roc_auc) AS BIGINT) AS n_classes,
  CAST(sum(n_invalid) AS BIGINT) AS n_invalid
FROM ({_auc_sql("(SELECT run_id, class_idx, CAST(y_true = class_idx AS INTEGER) AS is_c, score FROM multiclass_scores)",
                "run_id, class_idx", "is_c", "score")})
GROUP BY run_id""", X.SQL_MULTICLASS_SCORES))
def m8_auc_ovr_macro(spark, sf_dir):
    return M.auc_ovr_macro(X.multiclass_scores(spark, sf_dir)).select("run_id", _r("auc_ovr_macro"), "n_classes", "n_invalid")


# ---------------------------------------------------------------- M10 / M9
def mixed_predictions(spark, sf_dir):
    """lineitem and orders scorers in one table; each run names its metric."""
    b = X.binary_predictions(spark, sf_dir).select(
        F.concat(F.lit("li_"), "run_id").alias("run_id"), "row_id",
        F.col("y_true").cast("double").alias("y_true"), F.col("y_score").alias("y_score"))
    r = X.regression_predictions(spark, sf_dir).select(
        F.concat(F.lit("ord_"), "run_id").alias("run_id"), "row_id", "y_true", F.col("y_pred").alias("y_score"))
    preds = b.unionByName(_some_bad(b, "li_F")).unionByName(r).unionByName(
        _some_bad(r, "ord_F").withColumn("run_id", F.lit("ord_bad")))
    runs = preds.select("run_id").distinct().select("run_id", _run_metric().alias("metric"))
    return preds, runs


def _run_metric():
    """Which metric each run of the mixed table asks for."""
    return (F.when(F.col("run_id").isin("li_F", "bad"), "roc_auc").when(F.col("run_id") == "ord_bad", "rmse").when(F.col("run_id") == "li_O", "accuracy")
            .when(F.col("run_id") == "ord_F", "rmse").when(F.col("run_id") == "ord_O", "mae")
            .when(F.col("run_id") == "ord_P", "r2"))

_MIXED_SQL = BP + ", " + RP + """,
mixed AS (
  SELECT 'li_' || run_id AS run_id, row_id, CAST(y_true AS DOUBLE) AS y_true, y_score FROM binary_predictions
  UNION ALL
  SELECT 'ord_' || run_id, row_id, y_true, y_pred FROM regression_predictions
  UNION ALL
  SELECT 'bad', row_id, CAST(y_true AS DOUBLE), CASE row_id % 50 WHEN 0 THEN CAST('NaN' AS DOUBLE) WHEN 1 THEN NULL ELSE y_score END
  FROM binary_predictions WHERE run_id = 'F'
  UNION ALL
  SELECT 'ord_bad', row_id, y_true, CASE row_id % 50 WHEN 0 THEN CAST('NaN' AS DOUBLE) WHEN 1 THEN NULL ELSE y_pred END
  FROM regression_predictions WHERE run_id = 'F'),
m_auc AS (SELECT * FROM mixed WHERE run_id IN ('li_F', 'bad')),
m_acc AS (SELECT * FROM mixed WHERE run_id = 'li_O'),
m_reg AS (SELECT run_id, row_id, y_true, y_score AS y_pred FROM mixed WHERE run_id LIKE 'ord_%')
"""
_M10_BODY = f"""
SELECT run_id, 'roc_auc' AS metric, roc_auc AS value, n_invalid FROM ({_auc_sql('m_auc', 'run_id', 'y_true', 'y_score')})
UNION ALL
SELECT run_id, 'accuracy', round(avg(CAST(CAST(y_score > 0.5 AS INTEGER) = y_true AS DOUBLE)), 9), 0 FROM m_acc GROUP BY run_id
UNION ALL
SELECT run_id, 'rmse', CASE WHEN sum(b) = 0 THEN round(-sqrt(avg(pow(y_true - y_pred, 2))), 6) END, CAST(sum(b) AS BIGINT)
FROM (SELECT *, CASE WHEN y_pred IS NULL OR isnan(y_pred) THEN 1 ELSE 0 END AS b FROM m_reg) WHERE run_id IN ('ord_F', 'ord_bad') GROUP BY run_id
UNION ALL
SELECT run_id, 'mae', round(-avg(abs(y_true - y_pred)), 6), 0 FROM m_reg WHERE run_id = 'ord_O' GROUP BY run_id
UNION ALL
SELECT run_id, 'r2', r2, 0 FROM ({_R2_SQL.replace('regression_predictions', "m_reg WHERE run_id = 'ord_P'")})"""


def _m10(spark, sf_dir):
    preds, runs = mixed_predictions(spark, sf_dir)
    out = M.compute_metric(preds, runs)
    return out.withColumn("value", F.when(F.col("metric").isin("rmse", "mae"), F.round("value", 6))
                          .otherwise(F.round("value", 9)))


@query("m10_compute_metric", X.ctes(_MIXED_SQL) + _M10_BODY)
def m10_compute_metric(spark, sf_dir):
    return _m10(spark, sf_dir)


@query("m9_normalize_score", X.ctes(_MIXED_SQL, X.SQL_TASKS, f"m10 AS ({_M10_BODY})") + """
SELECT m10.run_id, m10.metric, round(CASE
    WHEN value IS NULL THEN NULL
    WHEN t.baseline_score IS NULL OR t.oracle_score IS NULL THEN greatest(0.0, least(1.0, value))
    WHEN t.oracle_score = t.baseline_score THEN CASE WHEN value >= t.oracle_score THEN 1.0 ELSE 0.0 END
    ELSE greatest(0.0, least(1.0, (value - t.baseline_score) / (t.oracle_score - t.baseline_score))) END, 9)
  AS normalized_score
FROM m10 LEFT JOIN tasks t ON t.metric = m10.metric""")
def m9_normalize_score(spark, sf_dir):
    m = _m10(spark, sf_dir)
    t = X.tasks(spark, sf_dir).select("metric", "baseline_score", "oracle_score")
    j = m.join(t, "metric", "left")
    return j.select("run_id", "metric", F.round(M.normalize_score(
        F.col("value"), F.col("baseline_score"), F.col("oracle_score")), 9).alias("normalized_score"))
