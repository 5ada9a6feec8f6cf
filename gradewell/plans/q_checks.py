"""Registered outcome-check queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradewell.operators import checks as K
from gradewell.operators import profile as P
from gradewell.plans import fixtures as X
from gradewell.plans.q_metrics import _M10_BODY, _MIXED_SQL, _m10
from gradewell.plans.q_profile import _P8_SQL, _P9_SQL
from gradewell.plans.registry import query
from gradewell.sources.io import read_table

PE = X.SQL_PROCESSED_EVENTS
FEATS = X.PROCESSED_FEATURES                  # processed_events minus the target
FLOATS = {"value", "amount", "half_null", "value2", "value_log"}
NUMS = ["event_id", "user_id", "value", "amount", "half_null", "value2", "value_log"]


def _features(spark, sf_dir):
    return X.processed_events(spark, sf_dir).drop(X.DIRTY_TARGET)


def _feat_sql(body: str) -> str:
    return X.ctes(PE, "feats AS (SELECT * EXCLUDE (event_type) FROM processed_events)") + body


def _miss(c: str) -> str:
    return f"({c} IS NULL OR isnan({c}))" if c in FLOATS else f"({c} IS NULL)"


# ------------------------------------------------------------------ F1
@query("f1_residual_missing", _feat_sql(f"""
, m AS (SELECT * FROM (""" + "\nUNION ALL\n".join(
    f"SELECT {i} AS i, '{c}' AS c, sum(CAST({_miss(c)} AS BIGINT)) AS m FROM feats" for i, c in enumerate(FEATS)) + """))
SELECT CAST(sum(m) AS BIGINT) AS total_missing, CAST(count(*) FILTER (WHERE m > 0) AS BIGINT) AS n_columns,
  coalesce(array_to_string(list(c ORDER BY i) FILTER (WHERE m > 0), ', '), '') AS columns,
  CAST(CASE WHEN sum(m) > 0 THEN 0.12 ELSE 0.0 END AS DOUBLE) AS penalty FROM m""").replace("\n, m AS", ",\nm AS", 1))
def f1_residual_missing(spark, sf_dir):
    return K.residual_missing(_features(spark, sf_dir))


def _describe(view_sql: str) -> str:
    return f"(SELECT * FROM (DESCRIBE ({view_sql})))"


_FEATS_DESC = _describe(_feat_sql("SELECT * FROM feats"))


# ------------------------------------------------------------------ F2
@query("f2_unencoded_columns", _feat_sql(f"""
SELECT (SELECT count(*) FROM feats) AS n_rows, CAST(count(*) AS BIGINT) AS n_unencoded,
  coalesce(string_agg(column_name, ', '), '') AS columns,
  CAST(CASE WHEN count(*) > 0 THEN 0.10 ELSE 0.0 END AS DOUBLE) AS penalty
FROM {_FEATS_DESC} WHERE column_type = 'VARCHAR'"""))
def f2_unencoded_columns(spark, sf_dir):
    return K.unencoded_columns(_features(spark, sf_dir))


# ------------------------------------------------------------------ F3
@query("f3_scale_check", _feat_sql("""
SELECT round(r, 2) AS scale_range_ratio, r > 100 AS flagged,
  CAST(CASE WHEN r > 100 THEN 0.05 ELSE 0.0 END AS DOUBLE) AS penalty
FROM (SELECT CASE WHEN count(*) >= 2 THEN max(s) / min(s) ELSE 0.0 END AS r FROM (""" + "\nUNION ALL\n".join(
    f"SELECT stddev_samp({c}) AS s FROM feats" for c in NUMS) + ") WHERE s IS NOT NULL AND NOT isnan(s) AND s <> 0)"))
def f3_scale_check(spark, sf_dir):
    return K.scale_check(_features(spark, sf_dir)).withColumn("scale_range_ratio", F.round("scale_range_ratio", 2))


# ------------------------------------------------------------------ F4
_ORIG_DESC = _describe(X.with_views("SELECT * EXCLUDE (event_type) FROM dirty_events", X.SQL_DIRTY_EVENTS))


@query("f4_no_feature_work", f"""
WITH cur AS (SELECT column_name FROM {_FEATS_DESC}), orig AS (SELECT column_name FROM {_ORIG_DESC}),
n AS (SELECT (SELECT count(*) FROM cur WHERE column_name NOT IN (SELECT column_name FROM orig)) AS n_new,
             (SELECT count(*) FROM orig WHERE column_name NOT IN (SELECT column_name FROM cur)) AS n_dropped,
             (SELECT count(*) FROM orig) AS n_orig)
SELECT CAST(n_new AS BIGINT) AS n_new, CAST(n_dropped AS BIGINT) AS n_dropped,
  n_new = 0 AND n_dropped = 0 AND n_orig > 3 AS flagged,
  CAST(CASE WHEN n_new = 0 AND n_dropped = 0 AND n_orig > 3 THEN 0.05 ELSE 0.0 END AS DOUBLE) AS penalty FROM n""")
def f4_no_feature_work(spark, sf_dir):
    orig = [c for c in X.dirty_events(spark, sf_dir).columns if c != X.DIRTY_TARGET]
    return K.no_feature_work(orig, _features(spark, sf_dir))


# ------------------------------------------------------------------ F5
def _skewed_orig(spark, sf_dir):
    return [r["column_name"] for r in P.skewed_columns(X.dirty_events(spark, sf_dir), X.DIRTY_TARGET).collect()]


@query("f5_skew_remaining", _feat_sql(f"""
, orig AS (SELECT column_name FROM ({_P8_SQL})),
cur AS (""" + "\nUNION ALL\n".join(f"SELECT '{c}' AS column_name, skewness({c}) AS s FROM feats" for c in NUMS) + """)
SELECT (SELECT CAST(count(*) AS BIGINT) FROM orig) AS n_skewed_before,
  CAST(count(*) AS BIGINT) AS n_present,
  CAST(coalesce(sum(CASE WHEN abs(s) > 2 THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_still_skewed
FROM cur WHERE column_name IN (SELECT column_name FROM orig)""").replace("\n, orig AS", ",\norig AS", 1))
def f5_skew_remaining(spark, sf_dir):
    return K.skew_remaining(_features(spark, sf_dir), _skewed_orig(spark, sf_dir))


# ------------------------------------------------------------------ F6 (rows-only: P9 parsing)
@query("f6_datetime_strings_left", X.ctes(f"dt AS ({_P9_SQL})") + f"""
SELECT column_name FROM {_FEATS_DESC}
WHERE column_type = 'VARCHAR' AND column_name IN (SELECT column_name FROM dt)""")
def f6_datetime_strings_left(spark, sf_dir):
    dt = [r["column_name"] for r in P.datetime_like(X.dirty_events(spark, sf_dir), X.DIRTY_TARGET).collect()]
    return K.datetime_strings_left(X.processed_events(spark, sf_dir), dt)


@query("f6_datetime_strings_raw", X.ctes(f"dt AS ({_P9_SQL})", X.SQL_DIRTY_EVENTS) + """
SELECT column_name FROM (SELECT unnest(['props', 'day', 'event_type']) AS column_name,
  unnest([typeof(props), typeof(day), typeof(event_type)]) AS column_type FROM (SELECT * FROM dirty_events LIMIT 1))
WHERE column_type = 'VARCHAR' AND column_name IN (SELECT column_name FROM dt)""")
def f6_datetime_strings_raw(spark, sf_dir):
    """On the table as it came: its date column is still a string."""
    raw = X.dirty_events(spark, sf_dir)
    dt = [r["column_name"] for r in P.datetime_like(raw, X.DIRTY_TARGET).collect()]         # at most a row a column
    return K.datetime_strings_left(raw, dt)


# ------------------------------------------------------------------ F7
@query("f7_non_numeric_features", _feat_sql(f"""
SELECT (SELECT count(*) FROM feats) AS n_rows, CAST(count(*) AS BIGINT) AS n_non_numeric,
  coalesce(string_agg(column_name, ', '), '') AS columns
FROM {_FEATS_DESC} WHERE column_type NOT IN ('BIGINT', 'INTEGER', 'DOUBLE', 'FLOAT', 'SMALLINT', 'TINYINT')"""))
def f7_non_numeric_features(spark, sf_dir):
    return K.non_numeric_features(_features(spark, sf_dir))


# ------------------------------------------------------------------ F8
@query("f8_remaining_duplicates", _feat_sql(f"""
SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS duplicate_count,
  CAST(CASE WHEN coalesce(sum(c - 1), 0) > 0 THEN 0.08 ELSE 0.0 END AS DOUBLE) AS penalty
FROM (SELECT count(*) AS c FROM feats GROUP BY {', '.join(FEATS)})"""))
def f8_remaining_duplicates(spark, sf_dir):
    return K.remaining_duplicates(_features(spark, sf_dir), target="__none__", mentioned=False)


# ------------------------------------------------------------------ F9
_F9_COLS = ["p_partkey", "p_size", "p_retailprice"]


@query("f9_near_duplicates", """
SELECT CAST(count(*) AS BIGINT) AS near_duplicate_pairs FROM (
  SELECT """ + " + ".join(f"CASE WHEN a.{c} = b.{c} THEN 0 ELSE 1 END" for c in _F9_COLS) + """ AS d
  FROM part a JOIN part b ON a.p_partkey < b.p_partkey) WHERE d BETWEEN 1 AND 2""")
def f9_near_duplicates(spark, sf_dir):
    return K.near_duplicates(read_table(spark, sf_dir, "part"), _F9_COLS)


#: A wide stand-in: many columns of few values, some missing.
_F9_WIDE = {f"w{j}": f"p_partkey // {3 ** (j % 5 + 1)} % {2 + j % 4}" for j in range(11)} | {"w11": "CASE WHEN p_partkey % 17 <> 0 THEN p_size END"}


@query("f9_near_duplicates_wide", f"""
WITH t AS MATERIALIZED (SELECT p_partkey AS id, {', '.join(f'{e} AS {c}' for c, e in _F9_WIDE.items())} FROM part)
SELECT CAST(count(*) AS BIGINT) AS near_duplicate_pairs FROM (
  SELECT """ + " + ".join(f"CASE WHEN a.{c} = b.{c} THEN 0 ELSE 1 END" for c in _F9_WIDE) + """ AS d
  FROM t a JOIN t b ON a.id < b.id) WHERE d BETWEEN 1 AND 2""")
def f9_near_duplicates_wide(spark, sf_dir):
    part = read_table(spark, sf_dir, "part")
    t = part.select(*[F.expr(e.replace("//", "div")).alias(c) for c, e in _F9_WIDE.items()])
    return K.near_duplicates(t, list(_F9_WIDE))


# ------------------------------------------------------------------ F10
@query("f10_prediction_length", """
WITH p AS (SELECT DISTINCT doc_id FROM documents), e AS (SELECT DISTINCT doc_id FROM labels),
j AS (SELECT p.doc_id AS pd, e.doc_id AS ed FROM p FULL OUTER JOIN e ON p.doc_id = e.doc_id)
SELECT (SELECT count(*) FROM documents) AS n_predictions, (SELECT count(*) FROM labels) AS n_expected,
  CAST(count(*) FILTER (WHERE pd IS NOT NULL AND ed IS NOT NULL) AS BIGINT) AS n_matched,
  CAST(count(*) FILTER (WHERE pd IS NULL) AS BIGINT) AS n_missing,
  CAST(count(*) FILTER (WHERE ed IS NULL) AS BIGINT) AS n_extra,
  (SELECT count(*) FROM documents) = (SELECT count(*) FROM labels) AND count(*) FILTER (WHERE pd IS NULL) = 0
    AND count(*) FILTER (WHERE ed IS NULL) = 0 AS length_ok
FROM j""")
def f10_prediction_length(spark, sf_dir):
    return K.prediction_length(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), "doc_id")


# ------------------------------------------------------------------ F11
def _label_scores(spark, sf_dir):
    lab = read_table(spark, sf_dir, "labels")
    return lab.select("doc_id", F.when(F.col("toxic") == 1, F.lit(float("nan")))
                      .when(F.col("quality") == 0, F.lit(float("inf")))
                      .otherwise(F.col("quality").cast("double")).alias("y_score"))


@query("f11_prediction_finite", """
SELECT count(*) AS n_rows, CAST(sum(CAST(isnan(s) AS INTEGER)) AS BIGINT) AS nan_count,
  CAST(sum(CAST(isnan(s) OR isinf(s) AS INTEGER)) AS BIGINT) AS non_finite_count,
  CAST(sum(CAST(s IS NULL AS INTEGER)) AS BIGINT) AS null_count,
  sum(CAST(isnan(s) OR isinf(s) AS INTEGER)) = 0 AND sum(CAST(s IS NULL AS INTEGER)) = 0 AS finite_ok
FROM (SELECT CASE WHEN toxic = 1 THEN CAST('NaN' AS DOUBLE) WHEN quality = 0 THEN CAST('Infinity' AS DOUBLE)
      ELSE CAST(quality AS DOUBLE) END AS s FROM labels)""")
def f11_prediction_finite(spark, sf_dir):
    return K.prediction_finite(_label_scores(spark, sf_dir))


# ------------------------------------------------------------------ F12
_F12_OK = "coalesce((isnan(a) AND isnan(b)) OR abs(a - b) <= 1e-6 + 1e-5 * abs(b), false)"


@query("f12_predictions_match", X.ctes(
    X.SQL_REGRESSION_PREDICTIONS,
    """b AS (SELECT o_orderkey AS row_id, o_totalprice * 0.9 + o_custkey % 100
        + CASE WHEN o_orderpriority = '1-URGENT' THEN 10.0 ELSE 0.0 END AS y_pred FROM orders)""",
    "j AS (SELECT a.y_pred AS a, b.y_pred AS b FROM regression_predictions a FULL OUTER JOIN b ON a.row_id = b.row_id)")
    + f"""SELECT count(*) AS n_compared, CAST(sum(CASE WHEN {_F12_OK} THEN 0 ELSE 1 END) AS BIGINT) AS n_mismatch,
  sum(CASE WHEN {_F12_OK} THEN 0 ELSE 1 END) = 0 AS all_match,
  CAST(CASE WHEN sum(CASE WHEN {_F12_OK} THEN 0 ELSE 1 END) = 0 THEN 0.0 ELSE 0.15 END AS DOUBLE) AS penalty FROM j""")
def f12_predictions_match(spark, sf_dir):
    a = X.regression_predictions(spark, sf_dir).select("row_id", "y_pred")
    o = read_table(spark, sf_dir, "orders")
    b = o.select(F.col("o_orderkey").alias("row_id"),
                 (F.col("o_totalprice") * 0.9 + F.col("o_custkey") % 100
                  + F.when(F.col("o_orderpriority") == "1-URGENT", 10.0).otherwise(0.0)).alias("y_pred"))
    return K.predictions_match(a, b, "row_id")


# ------------------------------------------------------------------ F13
@query("f13_prediction_score_vs_baseline", X.ctes(_MIXED_SQL, X.SQL_TASKS, f"m10 AS ({_M10_BODY})") + """
SELECT m10.run_id, m10.metric, value - coalesce(t.baseline_score, 0.0) >= 0 AS passed,
  round(CASE WHEN value - coalesce(t.baseline_score, 0.0) < 0 THEN greatest(0.0, 0.5 + value - coalesce(t.baseline_score, 0.0))
    ELSE least(1.0, 0.5 + value - coalesce(t.baseline_score, 0.0)) END, 9) AS score,
  CAST(CASE WHEN value - coalesce(t.baseline_score, 0.0) < 0 THEN 0.05 ELSE 0.0 END AS DOUBLE) AS penalty
FROM m10 LEFT JOIN tasks t ON t.metric = m10.metric""")
def f13_prediction_score_vs_baseline(spark, sf_dir):
    m = _m10(spark, sf_dir)
    t = X.tasks(spark, sf_dir).select("metric", "baseline_score")
    v = K.prediction_score_vs_baseline(F.col("value"), F.col("baseline_score"))
    return m.join(t, "metric", "left").select(
        "run_id", "metric", v["passed"].alias("passed"), F.round(v["score"], 9).alias("score"),
        v["penalty"].alias("penalty"))


# ------------------------------------------------------------------ F14
def _f14_sql() -> str:
    f1 = f"(SELECT total_missing, penalty AS p1 FROM ({ORACLE_F['f1_residual_missing']}))"
    f2 = f"(SELECT n_unencoded, penalty AS p2 FROM ({ORACLE_F['f2_unencoded_columns']}))"
    f3 = f"(SELECT flagged AS scale_flag, penalty AS p3 FROM ({ORACLE_F['f3_scale_check']}))"
    f4 = f"(SELECT flagged AS no_fe, penalty AS p4 FROM ({ORACLE_F['f4_no_feature_work']}))"
    f5 = f"(SELECT n_still_skewed FROM ({ORACLE_F['f5_skew_remaining']}))"
    f6 = f"(SELECT count(*) AS n_dt FROM ({ORACLE_F['f6_datetime_strings_left']}))"
    return f"""
SELECT 'feature_pipeline' AS validator,
  NOT (total_missing > 0 OR n_unencoded > 0 OR scale_flag OR no_fe OR n_dt > 0) AS passed,
  CAST(greatest(0.0, 1 - (p1 + p2 + p3 + p4)) AS DOUBLE) AS score, CAST(p1 + p2 + p3 + p4 AS DOUBLE) AS penalty,
  total_missing, n_unencoded, n_still_skewed
FROM {f1}, {f2}, {f3}, {f4}, {f5}, {f6}"""


from gradewell.plans.registry import ORACLE as ORACLE_F  # noqa: E402


@query("f14_feature_pipeline", _f14_sql())
def f14_feature_pipeline(spark, sf_dir):
    d = X.dirty_events(spark, sf_dir)
    orig = [c for c in d.columns if c != X.DIRTY_TARGET]
    dt = [r["column_name"] for r in P.datetime_like(d, X.DIRTY_TARGET).collect()]
    return K.feature_pipeline(_features(spark, sf_dir), orig, _skewed_orig(spark, sf_dir), dt)
