"""Verdict-level cases."""

import datetime as dt
import math

from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradewell.operators import verdicts as V
from gradewell.sources.io import CHECKLIST_ITEM, explode_checklist

T0 = dt.datetime(2024, 1, 1)


def _score(spark, steps, is_ts=False, checklist=None, task_type="binary_classification"):
    items = checklist or []
    tasks = spark.createDataFrame(
        [("t", "d", "Survived", task_type, "roc_auc", items, 300.0, 15, 0.87, 0.5,
          {"is_time_series": "true" if is_ts else "false"})],
        T.StructType([T.StructField("task_id", T.StringType()), T.StructField("dataset_path", T.StringType()),
                      T.StructField("target_column", T.StringType()), T.StructField("task_type", T.StringType()),
                      T.StructField("metric", T.StringType()),
                      T.StructField("plan_checklist", T.ArrayType(CHECKLIST_ITEM)),
                      T.StructField("time_budget_seconds", T.DoubleType()), T.StructField("max_steps", T.IntegerType()),
                      T.StructField("oracle_score", T.DoubleType()), T.StructField("baseline_score", T.DoubleType()),
                      T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))]))
    rows = [(1, "t", T0 + dt.timedelta(seconds=10 * i), a, c, True, None, m) for i, (a, c, m) in enumerate(steps)]
    s = spark.createDataFrame(rows, "episode_id long, task_id string, ts timestamp, action_type string, "
                                    "code_body string, execution_success boolean, error_message string, "
                                    "metric_value double")
    flags = spark.createDataFrame([("d", False, False, False, 0.5, False, False)],
                                  "dataset_path string, has_missing boolean, has_high_correlation boolean, "
                                  "has_duplicates boolean, class_imbalance_ratio double, has_sig_outliers boolean, "
                                  "has_datetime_like boolean")
    pairs = spark.createDataFrame([], "dataset_path string, col_a string, col_b string")
    miss = spark.createDataFrame([], "dataset_path string, column_name string, missing_frac double")
    given = s, tasks, explode_checklist(tasks), flags, pairs, miss
    last, folded = V.last_steps(V.score_steps(*given)), V.score_episodes(*given)
    assert last.columns == folded.columns and last.first() == folded.first()
    return folded.first()


def test_bad_hyperparams_fail(spark):
    r = _score(spark, [("MODEL", "forest = trees(n_estimators=1)\nforest.fit(load, price)", None)])
    assert not r["hyperparameters"]["passed"] and r["hyperparameters"]["penalty"] >= 0.08


def test_timeseries_shuffle_fails(spark):
    r = _score(spark, [("FEATURE_ENGINEERING", "past, future = cut(load, test_size=0.25, shuffle=True)", None),
                       ("MODEL", "ridge.fit(past, price)", None)], is_ts=True)
    assert not r["split_quality"]["passed"] and r["split_quality"]["penalty"] >= 0.15


def test_tiny_test_size_fails(spark):
    r = _score(spark, [("MODEL", "past, future = cut(load, test_size=0.02)\n"
                                 "folds = KFold(4)\nridge.fit(past, price)", None)])
    assert not r["split_quality"]["passed"] and math.isclose(r["split_quality"]["penalty"], 0.10)


def test_leakage_and_plan_coverage(spark):
    items = [("missing", "m", ["fillna", "missing"], 1.0, True), ("eda", "e", ["describe"], 1.0, False),
             ("model", "x", ["xgboost"], 2.0, True)]
    r = _score(spark, [("PLAN", "Plan: fill missing values, then describe the data", None),
                       ("CODE", "print(test_df.head())", None)], checklist=items)
    assert not r["leakage"]["passed"] and r["leakage"]["penalty"] == 0.5
    pc = r["plan_coverage"]
    assert math.isclose(pc["score"], 0.5) and math.isclose(pc["penalty"], 0.2) and not pc["passed"]


def test_final_submit_without_fit_and_reward_floor(spark):
    r = _score(spark, [("PLAN", "plan", None), ("FINAL_SUBMIT", "", 0.9)])
    assert r["done"]
    assert not r["model_choice"]["passed"] and r["model_choice"]["penalty"] == 0.15
    # perf = (0.9 - 0.5) / (0.87 - 0.5) clamped to 1
    assert math.isclose(r["performance"], 1.0)
    assert r["reward"] >= 0.0


def test_folded_episodes_equal_the_last_scored_steps(spark, sf0001):
    """R8's one aggregate against R7's running windows, over every column, and its plan."""
    from gradewell.plans import flagship as G
    folded = G.scored_episodes(spark, sf0001)
    last = {r["episode_id"]: r for r in V.last_steps(G.scored_steps(spark, sf0001)).collect()}
    got = {r["episode_id"]: r for r in folded.select(*next(iter(last.values())).asDict()).collect()}
    near = lambda a, b: a == b or (isinstance(a, float) and math.isclose(a, b, abs_tol=1e-12))
    plain = lambda r: {f"{k}.{x}": y for k, v in r.asDict(True).items() if isinstance(v, dict) for x, y in v.items()} | {
        k: v for k, v in r.asDict(True).items() if not isinstance(v, dict)}
    assert got.keys() == last.keys() and len(got) > 10
    for e in got:
        a, b = plain(got[e]), plain(last[e])
        assert all(near(a[k], b[k]) for k in a), (e, [k for k in a if not near(a[k], b[k])])
    given, more = G._tables(spark, sf0001)
    steps, _, _, n = V._inputs(*given, more["hard_time_limit"])
    windows = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Window [")
    assert windows(V.E.folded_state(steps, n_chunks=n)) <= windows(steps)        # the fold adds no window


def test_issue_amounts_sum_to_the_penalty(spark, sf0001):
    from pyspark.sql import functions as F
    from gradewell.plans import flagship as G
    long = V.verdict_table(G.scored_steps(spark, sf0001), details=True)
    total = F.aggregate("issues", F.lit(0.0), lambda a, x: a + x["amount"])
    assert long.where(F.abs(total - F.col("penalty")) > 1e-9).count() == 0
    assert long.where(~F.col("passed") & (F.size("issues") == 0)).count() == 0
    assert long.where(F.size("bonuses") > 0).count() > 0
