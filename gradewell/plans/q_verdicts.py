"""Registered verdict and reward queries (R1-R8) with a DuckDB oracle that
recomputes the 22 verdicts from its own SQL state (see q_episodes)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradewell.operators import verdicts as V
from gradewell.plans import fixtures as X
from gradewell.plans.flagship import flagship, scored_episodes, scored_steps
from gradewell.plans.q_episodes import HARD, SQL_STATE, _drop_pat, _in, _MISS_SQL, _PAIRS_SQL
from gradewell.plans.q_profile import DATE_FORMATS_SQL, _P6_SQL, _P7_SQL, _P11_SQL
from gradewell.plans.registry import query
from gradewell.operators import episodes as E

# ------------------------------------------------------------------ SQL verdicts
_DT_SQL = X.with_views("""
SELECT count(*) > 0 AS has_dt FROM (
  SELECT col, bool_and(TRY_CAST(v AS TIMESTAMP) IS NOT NULL OR try_strptime(v, %s) IS NOT NULL) AS ok FROM (
    SELECT 'props' AS col, props AS v FROM dirty_events WHERE props IS NOT NULL
    UNION ALL SELECT 'day', day FROM dirty_events WHERE day IS NOT NULL)
  GROUP BY col) WHERE ok""" % DATE_FORMATS_SQL, X.SQL_DIRTY_EVENTS)

_CTX = f"""
{X.SQL_OUTCOMES.strip()},
{X.SQL_STEP_FACTS.strip()},
pairs AS ({_PAIRS_SQL}),
mc AS ({_MISS_SQL}),
pf AS (SELECT (SELECT count(*) FROM mc) > 0 AS has_missing, (SELECT count(*) FROM pairs) > 0 AS has_high_correlation,
  (SELECT has_duplicates FROM ({_P7_SQL})) AS has_duplicates,
  (SELECT count(*) FROM ({_P6_SQL}) WHERE outlier_frac >= 0.05) > 0 AS has_sig_outliers,
  (SELECT class_imbalance_ratio FROM ({_P11_SQL})) AS class_imbalance_ratio,
  (SELECT has_dt FROM ({_DT_SQL})) AS has_datetime_like),
c12 AS (SELECT episode_id, step_idx, sum(CASE WHEN handled THEN 0 ELSE 1 END) AS corr_missed_pairs FROM (
  SELECT episode_id, step_idx, bool_or({_in(*E.SUB_CF)} AND (regexp_matches(text, {_drop_pat('col_a')})
      OR regexp_matches(text, {_drop_pat('col_b')})))
    OVER (PARTITION BY episode_id, col_a, col_b ORDER BY step_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS handled
  FROM state, pairs) GROUP BY episode_id, step_idx),
c13 AS (SELECT episode_id, step_idx, sum(CASE WHEN (q AND miss_fill) OR d THEN 0 ELSE 1 END) AS miss_unhandled,
    sum(CASE WHEN q AND miss_fill AND NOT d AND missing_frac > 0.8 THEN 1 ELSE 0 END) AS miss_bad_strategy FROM (
  SELECT episode_id, step_idx, miss_fill, missing_frac,
    bool_or({_in(*E.SUB_CFM)} AND regexp_matches(text, '[''"]\\Q' || column_name || '\\E[''"]'))
      OVER (PARTITION BY episode_id, column_name ORDER BY step_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS q,
    bool_or({_in(*E.SUB_CFM)} AND regexp_matches(text, {_drop_pat('column_name')}))
      OVER (PARTITION BY episode_id, column_name ORDER BY step_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS d
  FROM state, mc) GROUP BY episode_id, step_idx),
{X.SQL_CHECKLIST.strip()},
ck AS (SELECT t.task_id, c.* FROM tasks t JOIN checklist c ON c.item_idx < t.task_key),
c8i AS (SELECT s.episode_id, s.step_idx, c.item_idx, any_value(c.weight) AS weight, any_value(c.required) AS required,
    bool_or(instr(lower(coalesce(s.plan_text, '')), lower(c.keyword)) > 0) AS covered
  FROM state s JOIN ck c ON c.task_id = s.task_id GROUP BY s.episode_id, s.step_idx, c.item_idx),
c8 AS (SELECT episode_id, step_idx, count(*) AS task_items, sum(weight) AS tw,
    sum(CASE WHEN covered THEN weight ELSE 0 END) AS cw,
    sum(CASE WHEN NOT covered AND required THEN 1 ELSE 0 END) AS mr FROM c8i GROUP BY episode_id, step_idx),
full_state AS (SELECT s.*, pf.*, coalesce(c12.corr_missed_pairs, 0) AS corr_missed_pairs,
    coalesce(c13.miss_unhandled, 0) AS miss_unhandled, coalesce(c13.miss_bad_strategy, 0) AS miss_bad_strategy,
    coalesce(c8.task_items, 0) AS task_items, coalesce(c8.tw, 0) AS tw, coalesce(c8.cw, 0) AS cw, coalesce(c8.mr, 0) AS mr,
    s.baseline_score AS baseline_metric, o.* EXCLUDE (episode_id), f.* EXCLUDE (episode_id, step_idx)
  FROM state s CROSS JOIN pf LEFT JOIN outcomes o ON o.episode_id = s.episode_id
  JOIN latest f ON f.episode_id = s.episode_id AND f.step_idx = s.step_idx
  LEFT JOIN c12 ON c12.episode_id = s.episode_id AND c12.step_idx = s.step_idx
  LEFT JOIN c13 ON c13.episode_id = s.episode_id AND c13.step_idx = s.step_idx
  LEFT JOIN c8 ON c8.episode_id = s.episode_id AND c8.step_idx = s.step_idx)"""


def _vs(passed: str, score: str, penalty: str) -> str:
    return f"{{'passed': {passed}, 'score': CAST({score} AS DOUBLE), 'penalty': CAST({penalty} AS DOUBLE)}}"


def _scored(issues: str, pen: str, bonus: str | None = None) -> str:
    score = (f"greatest(0.0, least(1.0, 1 - ({pen}) + ({bonus})))" if bonus is not None
             else f"greatest(0.0, 1 - ({pen}))")
    return _vs(f"NOT ({issues})", score, pen)


_PASS = _vs("true", "1.0", "0.0")
_T_PEN = (f"(CASE WHEN elapsed >= {HARD} THEN 0.3 WHEN elapsed > time_budget_seconds THEN "
          "0.3 * least((elapsed - time_budget_seconds) / time_budget_seconds, 1.0) ELSE 0.0 END)")
_GAIN = """(CASE WHEN len(h) < 2 THEN NULL WHEN i >= len(h) THEN h[len(h)] - h[len(h) - 1]
  ELSE h[i + 1] - h[greatest(i - 1, 0) + 1] END)"""
_COST = "(0.03 * pow(i, 1.5))"
_ONE = (f"CASE WHEN {_GAIN} IS NULL THEN {_COST} WHEN {_GAIN} < -0.005 THEN {_COST} + 0.08 * abs({_GAIN}) "
        f"WHEN {_GAIN} < 0.005 THEN {_COST} ELSE greatest(0.0, {_COST} - least({_COST}, 0.10 * {_GAIN})) END")
_CPEN = (f"(CASE WHEN cycle_count - 1 <= 0 THEN 0.0 ELSE list_sum(list_transform(range(1, CAST(cycle_count AS BIGINT)), "
         f"lambda i: {_ONE})) END)")
_TGAIN = "(CASE WHEN len(h) >= 2 THEN h[len(h)] - h[1] END)"
_CBONUS = f"(CASE WHEN {_TGAIN} IS NOT NULL AND {_TGAIN} > 0.02 THEN least(0.05, {_TGAIN} * 0.3) ELSE 0.0 END)"
_PLATEAU = ("(len(h) >= 3 AND (list_max(h[len(h) - 2:]) - list_min(h[len(h) - 2:])) < 0.003 AND cycle_count > 2)")
_NBAD = " + ".join(f"CAST(hp_bad{i} AS INTEGER)" for i in range(5))
_NO_PARAMS = "(hp_params = 0 AND NOT hp_tuning)"
_IS_TS = "(is_time_series OR coalesce(has_datetime_like, false) OR sp_ts_hint OR plan_ts_hint)"
_TS_SHUF = f"({_IS_TS} AND NOT sp_ts_split AND sp_shuffle_true AND NOT sp_shuffle_false)"
_NO_STRAT = ("(task_type <> 'regression' AND class_imbalance_ratio IS NOT NULL AND class_imbalance_ratio < 0.3 "
             "AND NOT sp_stratify AND NOT sp_cv)")
_COV = "(CASE WHEN tw > 0 THEN cw / tw ELSE 0.0 END)"
_MENT = "(miss_fill OR miss_dropna OR plan_missing)"
_MISSED = "(CASE WHEN corr_pca THEN 0 ELSE corr_missed_pairs END)"
_DIFF_OK = "(metric_cf IS NOT NULL AND baseline_metric IS NOT NULL)"
_WORSE = f"({_DIFF_OK} AND metric_cf - baseline_metric < -0.003)"
_BETTER = f"({_DIFF_OK} AND metric_cf - baseline_metric > 0.003)"
_BC_PEN = f"(CASE WHEN {_WORSE} OR metric_cf IS NULL THEN 0.15 ELSE 0.0 END + CASE WHEN {_PLATEAU} THEN 0.05 ELSE 0.0 END)"

_NS_N = "(CAST(step_idx + 1 >= 3 AS INTEGER) + CAST(step_idx + 1 >= 2 AND art_table IS NOT NULL AS INTEGER))"
_NS_OK = ("(CAST(step_idx + 1 >= 3 AND coalesce(art_predict, false) AS INTEGER) + "
          "CAST(step_idx + 1 >= 2 AND coalesce(art_table, false) AS INTEGER))")
_NO_SEED = "(repro_fit AND NOT repro_seed)"
_DIFFERS = "(repro_fit AND NOT coalesce(predictions_match, true))"
_LOST = "(miss_dropna AND coalesce(row_loss, 0) > 0.15)"

_VERDICT_SQL = {
    "execution": _vs("ok", "CASE WHEN ok THEN 1.0 ELSE 0.0 END", "CASE WHEN ok THEN 0.0 ELSE 0.1 END"),
    "correctness": f"CASE WHEN n_predictions IS NULL THEN {_vs('true', '0.5', '0.0')} "
                   f"WHEN n_predictions <> n_expected OR n_non_finite > 0 THEN {_vs('false', '0.0', '0.2')} ELSE {_PASS} END",
    "intactness": f"CASE WHEN NOT intact THEN {_vs('false', '0.0', '0.3')} ELSE {_PASS} END",
    "leakage": _vs("leak_issues = 0", "CASE WHEN leak_issues > 0 THEN 0.0 ELSE 1.0 END",
                   "CASE WHEN leak_issues > 0 THEN 0.5 ELSE 0.0 END"),
    "plan_coverage": f"CASE WHEN task_items = 0 THEN {_PASS} WHEN NOT has_plan THEN {_vs('false', '0.0', '0.0')} "
                     f"ELSE {_vs(f'mr = 0 AND {_COV} > 0.5', _COV, '0.2 * mr')} END",
    "namespace_check": f"CASE WHEN {_NS_N} = 0 THEN {_PASS} ELSE "
                       f"{_vs(f'{_NS_OK} = {_NS_N}', f'{_NS_OK} / {_NS_N}', f'0.1 * ({_NS_N} - {_NS_OK})')} END",
    "model_eval": f"CASE WHEN model_metric IS NULL THEN {_vs('true', '0.5', '0.0')} "
                  "WHEN model_metric - coalesce(baseline_score, 0) < 0 THEN "
                  + _vs("false", "greatest(0.0, 0.5 + model_metric - coalesce(baseline_score, 0))", "0.05")
                  + " ELSE " + _vs("true", "least(1.0, 0.5 + model_metric - coalesce(baseline_score, 0))", "0.0") + " END",
    "backtracking": _vs("backtracks = 0", "greatest(0.0, 1 - 0.25 * backtracks)", "0.15 * backtracks"),
    "reproducibility": f"CASE WHEN NOT repro_steps THEN {_PASS} ELSE "
                       + _scored(f"{_NO_SEED} OR {_DIFFERS}", f"CASE WHEN {_NO_SEED} THEN 0.1 ELSE 0.0 END + "
                                 f"CASE WHEN {_DIFFERS} THEN 0.15 ELSE 0.0 END") + " END",
    "efficiency": _scored(f"elapsed >= {HARD} OR elapsed > time_budget_seconds OR (eff_grid AND NOT eff_efficient)",
                          f"{_T_PEN} + CASE WHEN eff_grid AND NOT eff_efficient THEN 0.15 ELSE 0.0 END"),
    "correlation": f"CASE WHEN NOT coalesce(has_high_correlation, false) THEN {_PASS} ELSE "
                   + _scored(f"NOT (corr_code OR plan_corr) OR {_MISSED} > 0",
                             f"CASE WHEN NOT (corr_code OR plan_corr) THEN 0.1 ELSE 0.0 END + 0.05 * {_MISSED}") + " END",
    "missing_values": f"CASE WHEN NOT coalesce(has_missing, false) THEN {_PASS} ELSE "
                      + _scored(f"NOT {_MENT} OR miss_bad_strategy > 0 OR {_LOST} OR ({_MENT} AND miss_unhandled > 0)",
                                f"CASE WHEN NOT {_MENT} THEN 0.15 ELSE 0.0 END + 0.05 * miss_bad_strategy + "
                                f"CASE WHEN {_LOST} THEN 0.10 ELSE 0.0 END + "
                                f"CASE WHEN {_MENT} THEN 0.05 * least(miss_unhandled, 3) ELSE 0.0 END") + " END",
    "distribution": _scored("NOT (dist_eda OR plan_eda) OR (coalesce(has_sig_outliers, false) AND NOT (dist_outlier OR plan_outlier))",
                            "CASE WHEN NOT (dist_eda OR plan_eda) THEN 0.10 ELSE 0.0 END + "
                            "CASE WHEN coalesce(has_sig_outliers, false) AND NOT (dist_outlier OR plan_outlier) THEN 0.08 ELSE 0.0 END"),
    "feature_pipeline": f"CASE WHEN pipeline_penalty IS NULL THEN {_PASS} ELSE {_scored('pipeline_issues', 'pipeline_penalty')} END",
    "duplicates": f"CASE WHEN NOT coalesce(has_duplicates, false) THEN {_PASS} ELSE "
                  + _scored("coalesce(remaining_duplicates, 0) > 0",
                            "CASE WHEN coalesce(remaining_duplicates, 0) = 0 THEN 0.0 WHEN dup_code OR plan_dedup THEN 0.04 ELSE 0.08 END") + " END",
    "target_leakage_model": f"CASE WHEN NOT done THEN {_PASS} ELSE "
                            + _scored("coalesce(leak_features, 0) > 0 OR coalesce(overfit, false)",
                                      "CASE WHEN coalesce(leak_features, 0) > 0 THEN 0.25 ELSE 0.0 END + "
                                      "CASE WHEN coalesce(overfit, false) THEN 0.10 ELSE 0.0 END") + " END",
    "feature_importance": f"CASE WHEN NOT done THEN {_PASS} ELSE "
                          + _scored("NOT (imp_code OR plan_importance) OR coalesce(model_value <= 0, false)",
                                    "CASE WHEN imp_code OR plan_importance THEN 0.0 ELSE 0.08 END",
                                    "CASE WHEN new_top_features > 0 THEN 0.03 ELSE 0.0 END + "
                                    "CASE WHEN model_value > 0 THEN 0.05 ELSE 0.0 END") + " END",
    "hyperparameters": f"CASE WHEN NOT hp_steps OR NOT hp_fit THEN {_PASS} ELSE "
                       + _scored(f"{_NO_PARAMS} OR ({_NBAD}) > 0 OR slow_fit",
                                 f"CASE WHEN {_NO_PARAMS} THEN 0.05 ELSE 0.0 END + 0.08 * ({_NBAD}) + "
                                 "CASE WHEN slow_fit THEN 0.10 ELSE 0.0 END") + " END",
    "model_choice": f"CASE WHEN NOT mc_fit AND done THEN {_vs('false', '0.0', '0.15')} WHEN NOT mc_fit THEN {_PASS} ELSE "
                    + _scored("(mc_ann AND NOT mc_good) OR (mc_custom AND NOT mc_library)",
                              "CASE WHEN mc_ann AND NOT mc_good THEN 0.12 ELSE 0.0 END + "
                              "CASE WHEN mc_custom AND NOT mc_library THEN 0.08 ELSE 0.0 END") + " END",
    "split_quality": f"CASE WHEN NOT sp_fit THEN {_PASS} ELSE "
                     + _scored(f"NOT sp_cv OR {_TS_SHUF} OR sp_bad_sizes > 0 OR {_NO_STRAT} OR coalesce(valid_frac < 0.05, false)",
                               f"CASE WHEN NOT sp_cv THEN 0.05 ELSE 0.0 END + CASE WHEN {_TS_SHUF} THEN 0.15 ELSE 0.0 END "
                               f"+ 0.10 * sp_bad_sizes + CASE WHEN {_NO_STRAT} THEN 0.05 ELSE 0.0 END + "
                               "CASE WHEN valid_frac < 0.05 THEN 0.10 ELSE 0.0 END") + " END",
    "iterative_cycles": f"CASE WHEN cycle_count <= 1 THEN {_PASS} ELSE "
                        f"{_vs(f'{_CPEN} <= 0.01', f'greatest(0.0, least(1.0, 1 - {_CPEN} + {_CBONUS}))', _CPEN)} END",
    "baseline_comparison": f"CASE WHEN NOT done THEN {_PASS} ELSE "
                           f"{_vs(f'NOT ({_WORSE} OR metric_cf IS NULL OR {_PLATEAU})', f'greatest(0.0, least(1.0, 1 - {_BC_PEN} + CASE WHEN {_BETTER} THEN 0.05 ELSE 0.0 END))', _BC_PEN)} END",
}

_PERF = ("coalesce(CASE WHEN metric_cf IS NULL THEN NULL WHEN baseline_score IS NULL OR oracle_score IS NULL "
         "THEN greatest(0.0, least(1.0, metric_cf)) WHEN oracle_score = baseline_score THEN "
         "CASE WHEN metric_cf >= oracle_score THEN 1.0 ELSE 0.0 END ELSE greatest(0.0, least(1.0, "
         "(metric_cf - baseline_score) / (oracle_score - baseline_score))) END, 0.0)")
_OTHERS = [n for n in V.VALIDATORS if n != "plan_coverage"]
_CODE_Q = "(" + " + ".join(f"{n}.score" for n in _OTHERS) + f") / {len(_OTHERS)}"
_TOTAL_PEN = "(" + " + ".join(f"{n}.penalty" for n in V.VALIDATORS) + ")"

SQL_SCORED = X.ctes(SQL_STATE, _CTX, "vstate AS (SELECT *, metric_history AS h FROM full_state)",
                    "verd AS (SELECT episode_id, step_idx, task_id, done, metric_cf, baseline_score, oracle_score, is_last, "
                    + ", ".join(f"{v} AS {k}" for k, v in _VERDICT_SQL.items()) + " FROM vstate)",
                    f"scored AS (SELECT *, {_PERF} AS performance, {_CODE_Q} AS code_quality, {_TOTAL_PEN} AS total_penalty, "
                    f"0.5 * {_PERF} + 0.2 * plan_coverage.score + 0.3 * {_CODE_Q} AS weighted FROM verd)")


def _r(c, n=9):
    return F.round(c, n).alias(c)


# ------------------------------------------------------------------ queries
@query("r1_verdict_table", SQL_SCORED + "SELECT episode_id, step_idx, v.validator, v.passed, round(v.score, 9) AS score, "
       "round(v.penalty, 9) AS penalty FROM (SELECT episode_id, step_idx, unnest([" + ", ".join(
           f"{{'validator': '{n}', 'passed': {n}.passed, 'score': {n}.score, 'penalty': {n}.penalty}}"
           for n in V.VALIDATORS) + "]) AS v FROM scored)")
def r1_verdict_table(spark, sf_dir):
    vt = V.verdict_table(scored_steps(spark, sf_dir))
    return vt.select("episode_id", "step_idx", "validator", "passed", _r("score"), _r("penalty"))


_CORE = ["execution", "correctness", "intactness", "leakage"]
_EDA = ["correlation", "distribution", "missing_values"]


def _long_sql() -> str:
    return ("(SELECT episode_id, step_idx, is_last, v.validator, v.passed, v.score, v.penalty FROM (SELECT episode_id, "
            "step_idx, is_last, unnest([" + ", ".join(
                f"{{'validator': '{n}', 'passed': {n}.passed, 'score': {n}.score, 'penalty': {n}.penalty}}"
                for n in V.VALIDATORS) + "]) AS v FROM scored))")


@query("r2_and_verdict", SQL_SCORED + f"""
SELECT episode_id, 'code_core' AS validator, bool_and(passed) AS passed, round(min(score), 9) AS score,
  round(CASE WHEN bool_and(passed) THEN 0.0 ELSE sum(penalty) END, 9) AS penalty
FROM {_long_sql()} WHERE is_last AND validator IN ({', '.join(f"'{n}'" for n in _CORE)}) GROUP BY episode_id""")
def r2_and_verdict(spark, sf_dir):
    ep = scored_episodes(spark, sf_dir)
    a = V.and_verdict(V.verdict_table(ep), "code_core", _CORE)
    return a.select("episode_id", "validator", "passed", _r("score"), _r("penalty"))


@query("r3_or_verdict", SQL_SCORED + f"""
SELECT episode_id, 'eda_any' AS validator, bool_or(passed) AS passed, round(max(score), 9) AS score,
  round(CASE WHEN bool_or(passed) THEN 0.0 ELSE min(penalty) END, 9) AS penalty
FROM {_long_sql()} WHERE is_last AND validator IN ({', '.join(f"'{n}'" for n in _EDA)}) GROUP BY episode_id""")
def r3_or_verdict(spark, sf_dir):
    ep = scored_episodes(spark, sf_dir)
    o = V.or_verdict(V.verdict_table(ep), "eda_any", _EDA)
    return o.select("episode_id", "validator", "passed", _r("score"), _r("penalty"))


@query("r4_reward", SQL_SCORED + """
SELECT episode_id, round(plan_score, 9) AS plan_score, round(code_quality, 9) AS code_quality,
  round(total_penalty, 9) AS total_penalty, round(performance, 9) AS performance,
  round(greatest(0.0, 0.5 * performance + 0.2 * plan_score + 0.3 * code_quality - total_penalty), 9) AS reward
FROM (SELECT episode_id, performance, plan_coverage.score AS plan_score, code_quality, total_penalty FROM scored WHERE is_last)""")
def r4_reward(spark, sf_dir):
    sc = scored_episodes(spark, sf_dir)
    vt = V.verdict_table(sc)
    perf = sc.select("episode_id", "step_idx", "performance")
    r = V.reward(vt, perf)
    return r.select("episode_id", _r("plan_score"), _r("code_quality"), _r("total_penalty"), _r("performance"),
                    _r("reward"))


@query("r5_perf_score", SQL_SCORED + "SELECT episode_id, round(performance, 9) AS performance FROM scored WHERE is_last")
def r5_perf_score(spark, sf_dir):
    sc = scored_episodes(spark, sf_dir)
    return sc.select("episode_id", F.round(V.perf_score(F.col("metric_cf"), F.col("baseline_score"),
                                                        F.col("oracle_score")), 9).alias("performance"))


@query("r6_episode_feedback", SQL_SCORED + """
SELECT episode_id, string_agg(printf('  [%s] %s: score=%.2f penalty=%.2f', CASE WHEN passed THEN 'PASS' ELSE 'FAIL' END,
  validator, round(score, 2), round(penalty, 2)), chr(10) ORDER BY o) AS feedback
FROM (SELECT *, list_position([""" + ", ".join(f"'{n}'" for n in V.VALIDATORS) + """], validator) AS o
      FROM """ + _long_sql() + """ WHERE is_last) GROUP BY episode_id""")
def r6_episode_feedback(spark, sf_dir):
    sc = scored_episodes(spark, sf_dir)
    vt = V.verdict_table(sc).withColumn("score", F.round("score", 2)).withColumn("penalty", F.round("penalty", 2))
    return V.episode_feedback(vt).select("episode_id", "feedback")


#: validator -> (judged at all, issues, bonuses), each as (found, code, amount).
_WHY_SQL = {
    "execution": ("true", [("NOT ok", "'crash:' || coalesce(error_class, 'none')", "0.1")], []),
    "correctness": ("n_predictions IS NOT NULL", [
        ("n_predictions <> n_expected", "'wrong_length'", "0.2"),
        ("n_non_finite > 0", "'non_finite'", "CASE WHEN n_predictions <> n_expected THEN 0.0 ELSE 0.2 END")], []),
    "intactness": ("true", [("NOT intact", "'inputs_changed'", "0.3")], []),
    "leakage": ("true", [("leak_issues > 0", "'leak'", "0.5")], []),
    "plan_coverage": ("task_items > 0", [
        ("NOT has_plan", "'no_plan'", "0.0"), ("has_plan AND mr > 0", "'required_missed'", "0.2 * mr"),
        (f"has_plan AND mr = 0 AND {_COV} <= 0.5", "'low_coverage'", "0.0")], []),
    "namespace_check": ("true", [
        ("step_idx >= 2 AND art_predict IS NULL", "'no_model'", "0.1"),
        ("step_idx >= 2 AND NOT art_predict", "'model_without_predict'", "0.1"),
        ("step_idx >= 1 AND NOT art_table", "'non_numeric_table'", "0.1")], []),
    "model_eval": ("model_metric IS NOT NULL", [("model_metric < coalesce(baseline_score, 0)", "'below_baseline'", "0.05")], []),
    "backtracking": ("true", [("backtracks > 0", "'backtracks'", "0.15 * backtracks")], []),
    "reproducibility": ("repro_steps", [(_NO_SEED, "'no_seed'", "0.1"), (_DIFFERS, "'predictions_differ'", "0.15")], []),
    "efficiency": ("true", [
        (f"elapsed >= {HARD} OR elapsed > time_budget_seconds",
         f"CASE WHEN elapsed >= {HARD} THEN 'hard_limit' ELSE 'over_budget' END", _T_PEN),
        ("eff_grid AND NOT eff_efficient", "'grid_search'", "0.15")], []),
    "correlation": ("has_high_correlation", [
        ("NOT (corr_code OR plan_corr)", "'no_correlation_analysis'", "0.1"), (f"{_MISSED} > 0", "'pairs_left'", f"0.05 * {_MISSED}")], []),
    "missing_values": ("has_missing", [
        (f"NOT {_MENT}", "'no_missing_handling'", "0.15"), ("miss_bad_strategy > 0", "'mostly_missing_filled'", "0.05 * miss_bad_strategy"),
        (_LOST, "'rows_lost'", "0.10"), (f"{_MENT} AND miss_unhandled > 0", "'columns_left'", "0.05 * least(miss_unhandled, 3)")], []),
    "distribution": ("true", [
        ("NOT (dist_eda OR plan_eda)", "'no_eda'", "0.10"),
        ("has_sig_outliers AND NOT (dist_outlier OR plan_outlier)", "'outliers_left'", "0.08")], []),
    "feature_pipeline": ("pipeline_penalty IS NOT NULL", [("pipeline_issues", "'pipeline'", "pipeline_penalty")], []),
    "duplicates": ("has_duplicates", [
        ("remaining_duplicates > 0", "CASE WHEN dup_code OR plan_dedup THEN 'mentioned_but_left' ELSE 'duplicates_left' END",
         "CASE WHEN dup_code OR plan_dedup THEN 0.04 ELSE 0.08 END")], []),
    "target_leakage_model": ("done", [("leak_features > 0", "'leaking_feature'", "0.25"), ("overfit", "'train_valid_gap'", "0.10")], []),
    "feature_importance": ("done", [
        ("NOT (imp_code OR plan_importance)", "'no_importance'", "0.08"), ("model_value <= 0", "'model_adds_nothing'", "0.0")],
        [("new_top_features > 0", "'new_features_on_top'", "0.03"), ("model_value > 0", "'model_adds_value'", "0.05")]),
    "hyperparameters": ("hp_steps AND hp_fit", [
        (_NO_PARAMS, "'all_defaults'", "0.05"), *[(f"hp_bad{i}", f"'suspicious_{i}'", "0.08") for i in range(5)],
        ("slow_fit", "'slow_fit'", "0.10")],
        [("hp_tuning", "'tuning'", "0.0"), ("NOT hp_tuning AND hp_params > 0", "'parameters_set'", "0.0")]),
    "model_choice": ("mc_fit OR done", [
        ("NOT mc_fit", "'no_model_trained'", "0.15"), ("mc_fit AND mc_ann AND NOT mc_good", "'neural_only'", "0.12"),
        ("mc_fit AND mc_custom AND NOT mc_library", "'hand_written'", "0.08")],
        [("mc_fit AND mc_ann AND mc_good", "'both_families'", "0.0"), ("mc_fit AND mc_good", "'proven_model'", "0.0"),
         ("mc_fit AND mc_library AND NOT mc_good", "'library'", "0.0"), ("mc_fit AND mc_ensemble", "'ensemble'", "0.0")]),
    "split_quality": ("sp_fit", [
        ("NOT sp_cv", "'no_cross_validation'", "0.05"), (_TS_SHUF, "'time_series_shuffled'", "0.15"),
        ("sp_bad_sizes > 0", "'odd_test_size'", "0.10 * sp_bad_sizes"), (_NO_STRAT, "'not_stratified'", "0.05"),
        ("valid_frac < 0.05", "'tiny_valid_set'", "0.10")],
        [("sp_cv", "'cross_validation'", "0.0"), ("valid_frac > 0.05", "'valid_set'", "0.0")]),
    "iterative_cycles": ("cycle_count > 1", [(f"{_CPEN} > 0.01", "'costly_cycles'", _CPEN), (f"{_CPEN} <= 0.01", "'cheap_cycles'", _CPEN)],
                         [(f"{_CBONUS} > 0", "'total_gain'", _CBONUS)]),
    "baseline_comparison": ("done", [
        (_WORSE, "'worse_than_baseline'", "0.15"), ("metric_cf IS NULL", "'no_metric'", "0.15"), (_PLATEAU, "'plateau'", "0.05")],
        [(_BETTER, "'better_than_baseline'", "0.05")]),
}


def _details_sql() -> str:
    items = [f"CASE WHEN ({judged}) AND ({found}) THEN {{'validator': '{n}', 'kind': '{kind}', 'code': {code}, "
             f"'amount': CAST({amount} AS DOUBLE)}} END"
             for n, (judged, issues, bonuses) in _WHY_SQL.items() for kind, part in (("issue", issues), ("bonus", bonuses))
             for found, code, amount in part]
    return "SELECT episode_id, step_idx, is_last, unnest([" + ",\n".join(items) + "]) AS d FROM vstate"


@query("r6_verdict_details", SQL_SCORED + f"""
SELECT episode_id, d.validator AS validator, d.kind AS kind, d.code AS code, round(d.amount, 9) AS amount
FROM ({_details_sql()}) WHERE is_last AND d IS NOT NULL""")
def r6_verdict_details(spark, sf_dir):
    """The typed issues and bonuses of every verdict of every episode."""
    return V.verdict_details(scored_episodes(spark, sf_dir)).select("episode_id", "validator", "kind", "code", _r("amount"))


@query("r7_reward_by_step", SQL_SCORED + """
SELECT episode_id, step_idx, round(greatest(0.0, weighted - total_penalty), 9) AS reward, round(weighted, 9) AS weighted,
  round(total_penalty, 9) AS total_penalty FROM scored""")
def r7_reward_by_step(spark, sf_dir):
    sc = scored_steps(spark, sf_dir)
    return sc.select("episode_id", "step_idx", _r("reward"), _r("weighted"), _r("total_penalty"))


@query("r8_score_episodes", SQL_SCORED + f"""
SELECT episode_id, task_id, CAST(step_idx AS INTEGER) AS last_step, done, round(performance, 9) AS performance,
  round(code_quality, 9) AS code_quality, round(total_penalty, 9) AS total_penalty,
  round(greatest(0.0, weighted - total_penalty), 9) AS reward,
  {' + '.join(f'CASE WHEN NOT {n}.passed THEN 1 ELSE 0 END' for n in V.VALIDATORS)} AS n_failed
FROM scored WHERE is_last""")
def r8_score_episodes(spark, sf_dir):
    return flagship(spark, sf_dir)
