"""Registered profile queries (P1-P14) over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradewell.operators import profile as P
from gradewell.plans import fixtures as X
from gradewell.plans.registry import query
from gradewell.sources.io import read_table

DE = X.SQL_DIRTY_EVENTS
TGT = X.DIRTY_TARGET
FLOATS = {"value", "amount", "mostly_null", "half_null", "value2"}


def _miss_sql(c: str) -> str:
    return f"({c} IS NULL OR isnan({c}))" if c in FLOATS else f"({c} IS NULL)"


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


# ----------------------------------------------------------------------- P1
@query("p1_column_classes", """
SELECT column_name, CAST(ordinal_position AS BIGINT) AS position,
  data_type IN ('BIGINT', 'INTEGER', 'DOUBLE', 'FLOAT', 'SMALLINT', 'TINYINT', 'HUGEINT') AS is_numeric,
  CASE WHEN data_type IN ('BIGINT', 'INTEGER', 'DOUBLE', 'FLOAT', 'SMALLINT', 'TINYINT', 'HUGEINT')
    THEN 'numeric' ELSE 'categorical' END AS column_class,
  (SELECT count(*) FROM lineitem) AS n_rows,
  (SELECT count(*) FROM information_schema.columns WHERE table_name = 'lineitem') AS n_cols
FROM information_schema.columns
WHERE table_name = 'lineitem' AND column_name <> 'l_returnflag'
""")
def p1_column_classes(spark, sf_dir):
    return P.column_classes(read_table(spark, sf_dir, "lineitem"), "l_returnflag").drop("data_type")


# ----------------------------------------------------------------------- P2 / P4
_P2_SQL = X.ctes(DE, "m AS (SELECT count(*) AS n, " + ", ".join(
    f"sum(CAST({_miss_sql(c)} AS BIGINT)) AS {c}" for c in X.DIRTY_FEATURES) + " FROM dirty_events)",
    "l AS (" + _union([f"SELECT '{c}' AS column_name, {c} AS missing_count, n, "
                       f"{'true' if c in X.DIRTY_NUMERIC else 'false'} AS is_numeric FROM m"
                       for c in X.DIRTY_FEATURES]) + ")") + """
SELECT column_name, CAST(missing_count AS BIGINT) AS missing_count,
  round(missing_count / n, 6) AS missing_frac, is_numeric,
  CASE WHEN missing_count / n > 0.8 THEN 'drop_column' WHEN missing_count / n > 0.5 THEN 'fill_or_drop'
    WHEN is_numeric THEN 'fill_median' ELSE 'fill_mode' END AS recommend
FROM l WHERE missing_count > 0
"""


@query("p2_missing_profile", _P2_SQL)
def p2_missing_profile(spark, sf_dir):
    df = P.missing_profile(X.dirty_events(spark, sf_dir), TGT)
    return df.withColumn("missing_frac", F.round("missing_frac", 6))


@query("p4_impute_recommendation", "SELECT column_name, recommend FROM (" + _P2_SQL + ")")
def p4_impute_recommendation(spark, sf_dir):
    return P.missing_profile(X.dirty_events(spark, sf_dir), TGT).select("column_name", "recommend")


# ----------------------------------------------------------------------- P3
@query("p3_missing_total_frac", X.with_views(f"""
SELECT CAST(cells AS BIGINT) AS missing_cells, CAST(n * {len(X.DIRTY_FEATURES)} AS BIGINT) AS total_cells,
  round(CASE WHEN n > 0 THEN cells / (n * {len(X.DIRTY_FEATURES)}) ELSE 0.0 END, 6) AS missing_total_frac
FROM (SELECT count(*) AS n, """ + " + ".join(f"sum(CAST({_miss_sql(c)} AS BIGINT))" for c in X.DIRTY_FEATURES)
    + " AS cells FROM dirty_events)", DE))
def p3_missing_total_frac(spark, sf_dir):
    df = P.missing_total_frac(X.dirty_events(spark, sf_dir), TGT)
    return df.withColumn("missing_total_frac", F.round("missing_total_frac", 6))


# ----------------------------------------------------------------------- P5
_PAIRS = [(a, b) for i, a in enumerate(X.DIRTY_NUMERIC) for b in X.DIRTY_NUMERIC[i + 1:]]


@query("p5_high_corr_pairs", X.with_views("""
SELECT col_a, col_b, round(abs(r), 4) AS corr_value FROM (""" + _union([
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, corr({a}, {b}) AS r FROM dirty_events" for a, b in _PAIRS])
    + ") WHERE r IS NOT NULL AND NOT isnan(r) AND abs(r) >= 0.9", DE))
def p5_high_corr_pairs(spark, sf_dir):
    df = P.high_corr_pairs(X.dirty_events(spark, sf_dir), TGT)
    return df.withColumn("corr_value", F.round("corr_value", 4))


# ----------------------------------------------------------------------- P6
_P6_SQL = X.with_views("""
SELECT column_name, CAST(outlier_count AS BIGINT) AS outlier_count, round(outlier_count / n, 4) AS outlier_frac,
  round(lo, 4) AS lower_bound, round(hi, 4) AS upper_bound
FROM (""" + _union([f"""
  SELECT '{c}' AS column_name, count({c}) AS n, lo, hi,
    sum(CASE WHEN {c} < lo OR {c} > hi THEN 1 ELSE 0 END) AS outlier_count
  FROM dirty_events, (SELECT q[1] - 1.5 * (q[2] - q[1]) AS lo, q[2] + 1.5 * (q[2] - q[1]) AS hi,
                             q[2] - q[1] AS iqr
                      FROM (SELECT quantile_cont({c}, [0.25, 0.75]) AS q FROM dirty_events)) b
  WHERE iqr <> 0 GROUP BY lo, hi""" for c in X.DIRTY_NUMERIC]) + """)
WHERE n >= 10 AND outlier_count / n >= 0.01 AND outlier_count >= 3""", DE)


@query("p6_iqr_outliers", _P6_SQL)
def p6_iqr_outliers(spark, sf_dir):
    df = P.iqr_outliers(X.dirty_events(spark, sf_dir), TGT)
    return df.select("column_name", "outlier_count", *[F.round(c, 4).alias(c) for c in
                                                      ["outlier_frac", "lower_bound", "upper_bound"]])


# ----------------------------------------------------------------------- P7
_P7_SQL = X.with_views(f"""
SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS duplicate_count, coalesce(sum(c - 1), 0) > 0 AS has_duplicates
FROM (SELECT count(*) AS c FROM dirty_events GROUP BY {', '.join(X.DIRTY_FEATURES)})""", DE)


@query("p7_duplicate_count", _P7_SQL)
def p7_duplicate_count(spark, sf_dir):
    return P.duplicate_count(X.dirty_events(spark, sf_dir), TGT)


# ----------------------------------------------------------------------- P8
_P8_INNER = _union([f"SELECT '{c}' AS column_name, count({c}) AS n, skewness({c}) AS s FROM dirty_events"
                    for c in X.DIRTY_NUMERIC])
_P8_SQL = X.with_views(f"""
SELECT column_name, round(s, 4) AS skewness FROM ({_P8_INNER})
WHERE n >= 10 AND s IS NOT NULL AND NOT isnan(s) AND abs(s) > 2""", DE)


@query("p8_skewed_columns", _P8_SQL)
def p8_skewed_columns(spark, sf_dir):
    df = P.skewed_columns(X.dirty_events(spark, sf_dir), TGT)
    return df.withColumn("skewness", F.round("skewness", 4))


# ----------------------------------------------------------------------- P9 (rows-only)
DATE_FORMATS_SQL = ("['%m/%d/%Y', '%d/%m/%Y', '%Y/%m/%d', '%d.%m.%Y', '%d-%m-%Y', '%b %d, %Y', '%d %b %Y', '%m/%d/%Y %H:%M', '%m/%d/%Y %H:%M:%S', '%Y/%m/%d %H:%M:%S', '%d.%m.%Y %H:%M']")
_P9_SQL = X.with_views("""
SELECT col AS column_name FROM (
  SELECT col, bool_and(TRY_CAST(v AS TIMESTAMP) IS NOT NULL OR try_strptime(v, %s) IS NOT NULL) AS ok FROM (
    SELECT 'props' AS col, props AS v FROM dirty_events WHERE props IS NOT NULL
    UNION ALL SELECT 'day', day FROM dirty_events WHERE day IS NOT NULL)
  GROUP BY col) WHERE ok""" % DATE_FORMATS_SQL, DE)


@query("p9_datetime_like", _P9_SQL)
def p9_datetime_like(spark, sf_dir):
    return P.datetime_like(X.dirty_events(spark, sf_dir), TGT)


# ----------------------------------------------------------------------- P10
_P10_INNER = _union([f"SELECT stddev_samp({c}) AS s FROM dirty_events" for c in X.DIRTY_NUMERIC])
_P10_SQL = X.with_views(f"""
SELECT round(CASE WHEN count(*) >= 2 THEN max(s) / min(s) ELSE 0.0 END, 2) AS scale_range_ratio,
  CAST(count(*) AS BIGINT) AS n_std_columns
FROM ({_P10_INNER}) WHERE s IS NOT NULL AND NOT isnan(s) AND s <> 0""", DE)


@query("p10_scale_range_ratio", _P10_SQL)
def p10_scale_range_ratio(spark, sf_dir):
    df = P.scale_range_ratio(X.dirty_events(spark, sf_dir), TGT)
    return df.withColumn("scale_range_ratio", F.round("scale_range_ratio", 2))


# ----------------------------------------------------------------------- P11
_P11_SQL = X.with_views("""
SELECT CAST(count(*) AS BIGINT) AS n_classes,
  round(CASE WHEN count(*) >= 2 THEN min(c) / max(c) END, 4) AS class_imbalance_ratio
FROM (SELECT event_type, count(*) AS c FROM dirty_events WHERE event_type IS NOT NULL GROUP BY event_type)""", DE)


@query("p11_class_imbalance", _P11_SQL)
def p11_class_imbalance(spark, sf_dir):
    df = P.class_imbalance(X.dirty_events(spark, sf_dir), TGT)
    return df.withColumn("class_imbalance_ratio", F.round("class_imbalance_ratio", 4))


@query("p11_class_imbalance_labels", """
SELECT CAST(count(*) AS BIGINT) AS n_classes,
  round(CASE WHEN count(*) >= 2 THEN min(c) / max(c) END, 4) AS class_imbalance_ratio
FROM (SELECT toxic, count(*) AS c FROM labels WHERE toxic IS NOT NULL GROUP BY toxic)""")
def p11_class_imbalance_labels(spark, sf_dir):
    df = P.class_imbalance(read_table(spark, sf_dir, "labels"), "toxic")
    return df.withColumn("class_imbalance_ratio", F.round("class_imbalance_ratio", 4))


# ----------------------------------------------------------------------- P12
_P5_COLS = X.with_views("SELECT col_a FROM (" + _union([
    f"SELECT '{a}' AS col_a, corr({a}, {b}) AS r FROM dirty_events" for a, b in _PAIRS])
    + ") WHERE r IS NOT NULL AND NOT isnan(r) AND abs(r) >= 0.9", DE)
_P12_SQL = X.ctes(
    DE, f"p2 AS ({_P2_SQL})", f"p5 AS ({_P5_COLS})", f"p6 AS ({_P6_SQL})", f"p7 AS ({_P7_SQL})",
    f"p8 AS ({_P8_SQL})", f"p10 AS ({_P10_SQL})", f"p11 AS ({_P11_SQL})",
    "p3 AS (SELECT count(*) AS n, " + " + ".join(f"sum(CAST({_miss_sql(c)} AS BIGINT))" for c in X.DIRTY_FEATURES)
    + " AS cells FROM dirty_events)") + f"""
SELECT CAST(p3.n AS BIGINT) AS n_rows, CAST({len(X.DIRTY_FEATURES) + 1} AS BIGINT) AS n_cols,
  CAST({len(X.DIRTY_NUMERIC)} AS BIGINT) AS n_numeric, CAST({len(X.DIRTY_CATEGORICAL)} AS BIGINT) AS n_categorical,
  round(p3.cells / (p3.n * {len(X.DIRTY_FEATURES)}), 6) AS missing_total_frac,
  p7.duplicate_count, p7.has_duplicates, p10.scale_range_ratio, p11.class_imbalance_ratio,
  (SELECT CAST(count(*) AS BIGINT) FROM p2) AS n_missing_columns,
  (SELECT CAST(count(*) AS BIGINT) FROM p5) AS n_high_corr_pairs,
  (SELECT CAST(count(*) AS BIGINT) FROM p6) AS n_outlier_columns,
  (SELECT CAST(count(*) AS BIGINT) FROM p8) AS n_skewed_columns
FROM p3, p7, p10, p11"""


@query("p12_profile_summary", _P12_SQL)
def p12_profile_summary(spark, sf_dir):
    df = X.dirty_events(spark, sf_dir)
    prof = P.profile_table(df, TGT)
    s = prof.summary
    return s.select("n_rows", "n_cols", "n_numeric", "n_categorical",
                    F.round("missing_total_frac", 6).alias("missing_total_frac"),
                    "duplicate_count", "has_duplicates",
                    F.round("scale_range_ratio", 2).alias("scale_range_ratio"),
                    F.round("class_imbalance_ratio", 4).alias("class_imbalance_ratio"),
                    "n_missing_columns", "n_high_corr_pairs", "n_outlier_columns", "n_skewed_columns")


# ----------------------------------------------------------------------- P13
_NUM_FILL = ["amount", "mostly_null", "half_null"]
_CAT_FILL = ["props"]


@query("p13_impute_fill", X.ctes(
    DE, "med AS (SELECT " + ", ".join(f"median({c}) AS m_{c}" for c in _NUM_FILL) + " FROM dirty_events)",
    """mode_props AS (SELECT props AS m_props FROM dirty_events WHERE props IS NOT NULL
               GROUP BY props ORDER BY count(*) DESC, props LIMIT 1)""") + """
SELECT event_id, user_id, event_type, value, """ + ", ".join(
    f"coalesce({c}, m_{c}) AS {c}" for c in _NUM_FILL) + """, value2,
  coalesce(props, m_props) AS props, day
FROM dirty_events, med, mode_props""")
def p13_impute_fill(spark, sf_dir):
    df = X.dirty_events(spark, sf_dir)
    return P.impute_fill(df, df, _NUM_FILL + _CAT_FILL)


# ----------------------------------------------------------------------- P14
@query("p14_encode_categorical", """
WITH m1 AS (SELECT v, dense_rank() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT o_orderstatus AS v FROM orders)),
m2 AS (SELECT v, dense_rank() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT o_orderpriority AS v FROM orders))
SELECT o_orderkey, CAST(m1.code AS BIGINT) AS o_orderstatus, CAST(m2.code AS BIGINT) AS o_orderpriority
FROM orders LEFT JOIN m1 ON orders.o_orderstatus = m1.v LEFT JOIN m2 ON orders.o_orderpriority = m2.v""")
def p14_encode_categorical(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return P.encode_categorical(o, o, ["o_orderstatus", "o_orderpriority"])


# ----------------------------------------------------------------------- P13 train -> valid
def _dirty_split(spark, sf_dir):
    from gradewell.operators.integrity import stratified_split
    # identical duplicate rows tie on the key; either order yields the same rows
    return stratified_split(X.dirty_events(spark, sf_dir), ["event_id", "value", "day"], TGT, hash_method="md5")


_SPLIT_KEY = "CAST(event_id AS VARCHAR) || ':' || CAST(value AS VARCHAR) || ':' || day"


@query("p13_impute_fill_train_valid", X.ctes(
    DE,
    f"""h AS (SELECT *, CAST('0x' || substr(md5('42:' || {_SPLIT_KEY}), 1, 15) AS BIGINT) AS h FROM dirty_events)""",
    f"""r AS (SELECT *, row_number() OVER (PARTITION BY {TGT} ORDER BY h, event_id, value, day) - 1 AS rk,
               count(*) OVER (PARTITION BY {TGT}) AS n FROM h)""",
    """sp AS (SELECT * EXCLUDE (h, rk, n), CASE WHEN rk < n - least(ceil(CAST(0.3 AS DOUBLE) * n), n - 1) THEN 'train'
               WHEN rk < n - ceil(least(ceil(CAST(0.3 AS DOUBLE) * n), n - 1) * CAST(0.5 AS DOUBLE)) THEN 'valid' ELSE 'test' END AS split
             FROM r)""",
    "med AS (SELECT " + ", ".join(f"median({c}) AS m_{c}" for c in _NUM_FILL) + " FROM sp WHERE split = 'train')",
    """mode_props AS (SELECT props AS m_props FROM sp WHERE split = 'train' AND props IS NOT NULL
               GROUP BY props ORDER BY count(*) DESC, props LIMIT 1)""") + """
SELECT event_id, user_id, event_type, value, """ + ", ".join(
    f"coalesce({c}, m_{c}) AS {c}" for c in _NUM_FILL) + """, value2,
  coalesce(props, m_props) AS props, day
FROM sp, med, mode_props WHERE split = 'valid'""")
def p13_impute_fill_train_valid(spark, sf_dir):
    s = _dirty_split(spark, sf_dir)
    train = s.where(F.col("split") == "train").drop("split")
    valid = s.where(F.col("split") == "valid").drop("split")
    return P.impute_fill(train, valid, _NUM_FILL + _CAT_FILL)
