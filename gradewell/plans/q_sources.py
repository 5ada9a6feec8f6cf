"""Registered source/sink queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gradewell.plans import fixtures as X
from gradewell.plans.registry import query
from gradewell.session import scratch_path
from gradewell.sources import io as S


@query("s1_read_dataset", "SELECT * FROM lineitem")
def s1_read_dataset(spark, sf_dir):
    return S.read_dataset(spark, f"{sf_dir}/lineitem.parquet")


@query("s1_read_dataset_csv", "SELECT * FROM customer")
def s1_read_dataset_csv(spark, sf_dir):
    """Round trip through CSV with header (the reference's input format)."""
    cust = S.read_table(spark, sf_dir, "customer")
    path = scratch_path(spark, f"csv-{uuid.uuid4().hex[:12]}")
    cust.write.option("header", True).csv(path)
    return S.read_dataset(spark, path, schema=cust.schema, fmt="csv")


@query("s2_select_features", "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def s2_select_features(spark, sf_dir):
    cust = S.read_table(spark, sf_dir, "customer")
    return S.select_features(cust, "c_mktsegment", ["c_custkey", "c_nationkey", "c_acctbal"])


@query("s2_select_features_all", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def s2_select_features_all(spark, sf_dir):
    return S.select_features(S.read_table(spark, sf_dir, "customer"), "c_mktsegment")


@query("s3_read_tasks", X.with_views("""
SELECT task_id, task_type, metric, CAST(task_key AS INTEGER) AS n_items, 1 AS n_rejected FROM tasks""", X.SQL_TASKS))
def s3_read_tasks(spark, sf_dir):
    folder = scratch_path(spark, f"tasks-{uuid.uuid4().hex[:12]}")
    S.write_tasks(X.tasks(spark, sf_dir), folder)
    # one malformed registration next to the good ones
    spark.createDataFrame([('{"task_id": "broken", "task_type": "nope", "metric": "roc_auc"}',)], "value string") \
        .coalesce(1).write.mode("append").text(folder)
    good, rejected = S.read_tasks_files(spark, folder)
    n_bad = rejected.count()
    return good.select("task_id", "task_type", "metric", F.size("plan_checklist").alias("n_items"),
                       F.lit(n_bad).alias("n_rejected"))


@query("s4_write_tasks", X.with_views("""
SELECT task_id, target_column, task_type, metric, time_budget_seconds, CAST(max_steps AS INTEGER) AS max_steps,
  baseline_score, oracle_score FROM tasks""", X.SQL_TASKS))
def s4_write_tasks(spark, sf_dir):
    folder = scratch_path(spark, f"tasks-{uuid.uuid4().hex[:12]}")
    S.write_tasks(X.tasks(spark, sf_dir), folder)
    back, _ = S.read_tasks_files(spark, folder)
    return back.select("task_id", "target_column", "task_type", "metric", "time_budget_seconds", "max_steps",
                       "baseline_score", "oracle_score")


def _registrations(spark, sf_dir):
    t = X.tasks(spark, sf_dir)
    v1 = t.withColumn("file_name", F.lit("a_v1.json"))
    v2 = (t.where(F.col("task_type") != "binary_classification").withColumn("max_steps", F.lit(20))
          .withColumn("file_name", F.lit("b_v2.json")))
    return v1.unionByName(v2)


@query("s5_upsert_tasks", X.with_views("""
SELECT task_id, max_steps FROM (
  SELECT task_id, max_steps, row_number() OVER (PARTITION BY task_id ORDER BY file_name DESC) AS rn FROM (
    SELECT task_id, CAST(max_steps AS INTEGER) AS max_steps, 'a_v1.json' AS file_name FROM tasks
    UNION ALL
    SELECT task_id, 20, 'b_v2.json' FROM tasks WHERE task_type <> 'binary_classification')) WHERE rn = 1""", X.SQL_TASKS))
def s5_upsert_tasks(spark, sf_dir):
    return S.upsert_tasks(_registrations(spark, sf_dir)).select("task_id", "max_steps")


@query("s5_lookup_task", X.with_views("""
SELECT k.task_id, t.task_id IS NOT NULL AS found, t.metric
FROM (SELECT lower(n_name) AS task_id FROM nation UNION ALL SELECT lower(r_name) FROM region) k
LEFT JOIN tasks t ON t.task_id = k.task_id""", X.SQL_TASKS))
def s5_lookup_task(spark, sf_dir):
    n = S.read_table(spark, sf_dir, "nation").select(F.lower("n_name").alias("task_id"))
    r = S.read_table(spark, sf_dir, "region").select(F.lower("r_name").alias("task_id"))
    return S.lookup_task(X.tasks(spark, sf_dir), n.unionByName(r)).select("task_id", "found", "metric")


@query("s6_explode_checklist", X.ctes(X.SQL_TASKS, X.SQL_CHECKLIST) + """
SELECT t.task_id, coalesce(c.item_idx, -1) AS item_idx, coalesce(c.item_id, '') AS item_id,
  CAST(coalesce(c.weight, 0.0) AS DOUBLE) AS weight, coalesce(c.required, false) AS required, coalesce(c.keyword, '') AS keyword
FROM tasks t LEFT JOIN checklist c ON c.item_idx < t.task_key""")
def s6_explode_checklist(spark, sf_dir):
    e = S.explode_checklist(X.tasks(spark, sf_dir))
    # a task without checklist keeps one row; its nulls shown as defaults
    return e.select("task_id", F.coalesce("item_idx", F.lit(-1)).alias("item_idx"),
                    F.coalesce("item_id", F.lit("")).alias("item_id"), F.coalesce("weight", F.lit(0.0)).alias("weight"),
                    F.coalesce("required", F.lit(False)).alias("required"),
                    F.coalesce("keyword", F.lit("")).alias("keyword"))


@query("s7_table_overview", """
WITH c AS (SELECT column_name, ordinal_position, CASE data_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int'
    WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(data_type) END AS t FROM information_schema.columns WHERE table_name = 'lineitem'),
long AS (UNPIVOT (SELECT COLUMNS(*)::VARCHAR FROM lineitem) ON COLUMNS(*) INTO NAME k VALUE v)
SELECT (SELECT count(*) FROM lineitem) AS n_rows, CAST(count(*) AS BIGINT) AS n_cols,
  (SELECT count(*) FROM lineitem) * count(*) - (SELECT count(*) FROM long WHERE v <> 'nan') AS total_nulls,
  (SELECT string_agg(t || ': ' || n, ', ' ORDER BY t) FROM (SELECT t, count(*) AS n FROM c GROUP BY t)) AS dtypes,
  string_agg(column_name, ', ' ORDER BY ordinal_position) AS columns FROM c""")
def s7_table_overview(spark, sf_dir):
    return S.table_overview(S.read_table(spark, sf_dir, "lineitem"))


@query("s8_append_steps", X.with_views("""
SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS dt, CAST(count(*) AS BIGINT) AS n_steps
FROM steps GROUP BY CAST(ts AS DATE)""", X.SQL_STEPS))
def s8_append_steps(spark, sf_dir):
    path = scratch_path(spark, f"steplog-{uuid.uuid4().hex[:12]}")
    st = X.steps(spark, sf_dir)
    S.append_steps(st.where(F.col("action_type") == "PLAN"), path)     # two appends of disjoint parts
    S.append_steps(st.where(F.col("action_type") != "PLAN"), path)
    log = spark.read.parquet(path)
    return log.groupBy(F.date_format("dt", "yyyy-MM-dd").alias("dt")).agg(F.count(F.lit(1)).alias("n_steps"))
