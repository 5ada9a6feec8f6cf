import datetime as dt
import math

from pyspark.sql import functions as F

from gradewell.operators import episodes as E

T0 = dt.datetime(2024, 1, 1)


def _tasks(spark, max_steps=15, budget=300.0):
    return spark.createDataFrame(
        [("t", "d", "Survived", "binary_classification", "roc_auc", max_steps, budget, 0.5, 0.87)],
        "task_id string, dataset_path string, target_column string, task_type string, metric string, "
        "max_steps int, time_budget_seconds double, baseline_score double, oracle_score double") \
        .withColumn("metadata", F.create_map(F.lit("is_time_series"), F.lit("false")))


def _steps(spark, rows):
    data = [(1, "t", T0 + dt.timedelta(seconds=i), i, a, c, ok, None if ok else "KeyError: 'x'", m)
            for i, (a, c, ok, m) in enumerate(rows)]
    return spark.createDataFrame(data, "episode_id long, task_id string, ts timestamp, step_idx int, action_type string, "
                                       "code_body string, execution_success boolean, error_message string, "
                                       "metric_value double")


def _state(spark, rows, **kw):
    s = E.prepare_steps(_steps(spark, rows), _tasks(spark, **kw))
    return E.running_state(E.step_flags(s), carry_forward=False).orderBy("step_idx").collect()


def test_six_step_log_cycles_and_history(spark):
    rows = []
    for n, metric in enumerate((0.41, 0.52, 0.58)):       # three rounds: work on the data, then a fit
        rows += [("FEATURE_ENGINEERING", f"load['kwh_lag{n}'] = load['kwh'].shift({n})", True, None),
                 ("CODE", f"forest_{n}.fit(load, price)", True, metric)]
    last = _state(spark, rows)[-1]
    assert last["cycle_count"] == 3 and len(last["metric_history"]) == 3


def test_two_backtracks(spark):
    rows = [("CODE", "ridge.fit(load, price)", True, None),
            ("FEATURE_ENGINEERING", "load = load.rename(columns=short)", True, None),
            ("CODE", "load['kwh'] = load['kwh'].replace(-1, 0)", True, None)]
    last = _state(spark, rows)[-1]
    assert last["backtracks"] == 2 and math.isclose(0.15 * last["backtracks"], 0.30)


def test_repairs_failures_and_done(spark):
    rows = [("CODE", "x", False, None), ("CODE_FIX", "y", False, None), ("CODE_FIX", "z", True, None),
            ("CODE", "w", False, None), ("FINAL_SUBMIT", "", True, None), ("CODE", "after", True, None)]
    st = _state(spark, rows)
    assert len(st) == 5                                   # the step after FINAL_SUBMIT is dropped
    assert [r["consecutive_failures"] for r in st] == [1, 2, 0, 1, 0]
    assert (st[-1]["repair_attempts"], st[-1]["repair_successes"]) == (2, 1)
    assert st[-1]["done"]


def test_max_steps_ends_episode(spark):
    rows = [("CODE", "x", True, None)] * 6
    st = _state(spark, rows, max_steps=3)
    assert len(st) == 4 and st[-1]["done"] and not st[-2]["done"]     # idx 3 >= 3 ends it


def _cycle(spark, cycles, hist):
    df = spark.createDataFrame([(cycles, hist)], "c int, h array<double>")
    pen = df.select(E.cycle_penalty(F.col("c"), F.col("h")).alias("p"),
                    E.cycle_bonus(F.col("h")).alias("b")).first()
    score = max(0.0, min(1.0, 1 - pen["p"] + pen["b"]))
    return round(pen["p"], 6), round(score, 6)


def test_cycle_penalty_worked_values(spark):
    assert _cycle(spark, 3, [0.70, 0.70, 0.701]) == (0.114853, 0.885147)
    assert _cycle(spark, 3, [0.65, 0.72, 0.80]) == (0.099853, 0.945147)
    assert _cycle(spark, 2, [0.75, 0.68]) == (0.0356, 0.9644)


def test_cycle_error_multiplier(spark):
    df = spark.createDataFrame([(n,) for n in [0, 1, 2, 3, 5]], "n int")
    assert [r[0] for r in df.select(E.cycle_error_multiplier(F.col("n"))).collect()] == [1.0, 1.0, 1.5, 2.0, 3.0]


def test_profile_column_rules_positive(spark):
    """T12 / T13 through the bitmask path: dropped and filled columns count."""
    rows = [("PLAN", "plan: handle missing", True, None),
            ("CODE", "df = df.drop(columns=['amount'])", True, None),
            ("FEATURE_ENGINEERING", "df['half_null'] = df['half_null'].fillna(0)", True, None)]
    steps = _steps(spark, rows)
    tasks = _tasks(spark)
    pairs = spark.createDataFrame([("d", "amount", "value", 0.95), ("d", "value", "value2", 0.99)],
                                  "dataset_path string, col_a string, col_b string, corr_value double")
    miss = spark.createDataFrame([("d", "amount", 0.2), ("d", "half_null", 0.6), ("d", "mostly_null", 0.9)],
                                 "dataset_path string, column_name string, missing_frac double")
    flags = spark.createDataFrame([("d", True, True, False, 0.5, False, False)],
                                  "dataset_path string, has_missing boolean, has_high_correlation boolean, "
                                  "has_duplicates boolean, class_imbalance_ratio double, has_sig_outliers boolean, "
                                  "has_datetime_like boolean")
    pctx = E.profile_context(flags, pairs, miss)
    s = E.prepare_steps(steps, tasks).join(F.broadcast(pctx), "dataset_path", "left") \
        .withColumn("checklist", F.lit(None).cast("array<struct<item_idx:int,weight:double,required:boolean,"
                                                   "keywords:array<string>>>"))
    st = E.context_state(E.running_state(E.context_masks(E.step_flags(s), 1)), 1).orderBy("step_idx").collect()
    assert [r["corr_missed_pairs"] for r in st] == [2, 1, 1]     # dropping amount handles the first pair
    assert [r["miss_unhandled"] for r in st] == [3, 2, 1]        # amount dropped, then half_null filled


def test_steps_without_task_are_counted(spark):
    steps = spark.createDataFrame([(1, "t"), (2, "gone"), (2, "gone"), (3, "gone"), (4, None)], "episode_id long, task_id string")
    got = {r["task_id"]: (r["n_episodes"], r["n_steps"]) for r in E.steps_without_task(steps, _tasks(spark)).collect()}
    assert got == {"gone": (2, 3), None: (1, 1)}
