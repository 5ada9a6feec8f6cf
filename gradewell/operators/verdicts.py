"""Verdicts and reward (R1-R8) over the running episode state.

``score_steps`` gives, for every step, the 22 verdicts as the reference would
report them right after that step, and the reward (R7); ``score_episodes`` gives
the same for each episode's last step by one fold of its steps (R8). Verdicts are one wide row per
step (one shuffle by episode for everything); ``verdict_table`` unpivots them to
long rows (R1), with the typed issues and bonuses each verdict is made of (R6).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradewell.functions import text_rules as TR
from gradewell.operators import episodes as E
from gradewell.operators.checks import prediction_score_vs_baseline
from gradewell.operators.metrics import normalize_score

EP, IDX = E.EP, E.IDX

# Validator names in the reference's evaluation order.
VALIDATORS = [
    "execution", "correctness", "intactness", "leakage", "plan_coverage", "namespace_check",
    "model_eval", "backtracking", "reproducibility", "efficiency", "correlation", "missing_values",
    "distribution", "feature_pipeline", "duplicates", "target_leakage_model", "feature_importance",
    "hyperparameters", "model_choice", "split_quality", "iterative_cycles", "baseline_comparison",
]


#: What the table checks report of an episode, and its type.
OUTCOME_COLUMNS = {
    "n_predictions": "long", "n_expected": "long", "n_non_finite": "long", "intact": "boolean",
    "model_metric": "double", "pipeline_issues": "boolean", "pipeline_penalty": "double",
    "remaining_duplicates": "long", "leak_features": "long", "overfit": "boolean",
    "row_loss": "double", "valid_frac": "double", "predictions_match": "boolean",
    "model_value": "double", "new_top_features": "long",
}


@dataclass
class RewardWeights:
    performance: float = 0.5
    plan_coverage: float = 0.2
    code_quality: float = 0.3


def _v(passed: Column, score: Column, penalty: Column) -> Column:
    return F.struct(passed.alias("passed"), score.cast("double").alias("score"),
                    penalty.cast("double").alias("penalty"))


#: Suffixes of a verdict's columns of issues and bonuses.
ISSUES, BONUSES = "_issues", "_bonuses"


def _items(judged: Column, items: list) -> Column:
    """The (code, amount) of those that were found, in order."""
    if not items:
        return F.array().cast("array<struct<code:string,amount:double>>")
    one = lambda x: x if isinstance(x, Column) else F.lit(x)
    found = F.array(*[F.when(judged & cond, F.struct(one(code).alias("code"), one(amount).cast("double").alias("amount")))
                      for cond, code, amount in items])
    return F.filter(found, lambda x: x.isNotNull())


def _clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def _pass(score: float = 1.0) -> Column:
    return _v(F.lit(True), F.lit(score), F.lit(0.0))


def _scored(issues: Column, penalty: Column, bonus: Column | None = None) -> Column:
    score = _clamp01(1 - penalty + bonus) if bonus is not None else F.greatest(F.lit(0.0), 1 - penalty)
    return _v(~issues, score, penalty)


def profile_flags(summary: DataFrame, outliers: DataFrame, datetime_cols: DataFrame | None = None) -> DataFrame:
    """Per-dataset profile facts the rules read (one row per dataset_path)."""
    sig = outliers.where(F.col("outlier_frac") >= TR.SIGNIFICANT_OUTLIER_FRAC) \
        .groupBy("dataset_path").agg(F.lit(True).alias("has_sig_outliers"))
    out = summary.select("dataset_path", "has_missing", "has_high_correlation", "has_duplicates",
                         "class_imbalance_ratio").join(sig, "dataset_path", "left")
    if datetime_cols is not None:
        dt = datetime_cols.groupBy("dataset_path").agg(F.lit(True).alias("has_datetime_like"))
        out = out.join(dt, "dataset_path", "left")
    else:
        out = out.withColumn("has_datetime_like", F.lit(False))
    return out.select("dataset_path", "has_missing", "has_high_correlation", "has_duplicates",
                      "class_imbalance_ratio", F.coalesce("has_sig_outliers", F.lit(False)).alias("has_sig_outliers"),
                      F.coalesce("has_datetime_like", F.lit(False)).alias("has_datetime_like"))


def _inputs(steps: DataFrame, tasks: DataFrame, checklist: DataFrame, profile: DataFrame, corr_pairs: DataFrame,
            missing_cols: DataFrame, hard_time_limit: float):
    """Kept steps with their flags and masks, the dataset and task contexts, and the masks' words."""
    pctx = E.profile_context(profile, corr_pairs, missing_cols)
    cctx = E.checklist_context(checklist)
    sizes = pctx.agg(F.max(F.greatest(F.size("corr_cols"), F.size("miss_cols")))).first()[0] or 0
    n_chunks = max(1, -(-int(sizes) // E.MASK_BITS))    # bounded: columns of a profile
    s = _in_context(E.prepare_steps(steps, tasks, hard_time_limit), pctx, cctx)
    return E.context_masks(E.step_flags(s), n_chunks), pctx, cctx, n_chunks


def _in_context(s: DataFrame, pctx: DataFrame, cctx: DataFrame) -> DataFrame:
    s = s.join(pctx, "dataset_path", "left").join(cctx, "task_id", "left")
    return s.withColumns({col: F.coalesce(F.col(col), F.array().cast(empty)) for col, empty in [
        ("corr_cols", "array<string>"), ("corr_pairs", "array<struct<a:int,b:int>>"),
        ("miss_cols", "array<string>"), ("miss_fracs", "array<double>")]})


def score_steps(steps: DataFrame, tasks: DataFrame, checklist: DataFrame, profile: DataFrame,
                corr_pairs: DataFrame, missing_cols: DataFrame, *, baselines: DataFrame | None = None,
                outcomes: DataFrame | None = None, artifacts: DataFrame | None = None,
                hard_time_limit: float = 3600.0, weights: RewardWeights | None = None) -> DataFrame:
    """One row per kept step with the 22 verdict structs and the reward.

    steps: episode_id, task_id, ts, action_type, [action_text], code_body,
    execution_success, error_message, metric_value, [step_idx].
    tasks: S3 rows; checklist: S6 rows; profile: :func:`profile_flags`;
    corr_pairs / missing_cols: P5 / P2 rows with dataset_path; baselines:
    optional (task_id, baseline_metric) from the boosted-tree baseline (L3).
    outcomes: optional, rows per episode or per (episode, step) with any of OUTCOME_COLUMNS, as
    the table checks report them (F10/F11 predictions, C4 intactness, L7
    metric, F14 pipeline, F8 duplicates, L1/L2 leaks, C5 row loss, C6 valid share, F12 agreement
    of repeated predictions, L5 value of the model, L6 new features on top): a value holds from its
    step on. A missing column, row or value leaves its verdict neutral, as the reference without that object.
    artifacts: optional, the log :func:`episodes.artifact_state` reads; without it the namespace
    check goes by the code text.
    """
    s, _, _, n_chunks = _inputs(steps, tasks, checklist, profile, corr_pairs, missing_cols, hard_time_limit)
    s = E.context_state(E.running_state(s), n_chunks)
    return _scored_state(s, baselines, outcomes, artifacts, hard_time_limit, weights)


def score_episodes(steps: DataFrame, tasks: DataFrame, checklist: DataFrame, profile: DataFrame,
                   corr_pairs: DataFrame, missing_cols: DataFrame, *, baselines: DataFrame | None = None,
                   outcomes: DataFrame | None = None, artifacts: DataFrame | None = None,
                   hard_time_limit: float = 3600.0, weights: RewardWeights | None = None) -> DataFrame:
    """What :func:`score_steps` gives for each episode's last kept step, by one
    aggregate of the episode's steps instead of running windows."""
    s, pctx, cctx, n_chunks = _inputs(steps, tasks, checklist, profile, corr_pairs, missing_cols, hard_time_limit)
    s = E.context_state(_in_context(E.folded_state(s, n_chunks=n_chunks), pctx, cctx), n_chunks, folded=True)
    return _scored_state(s, baselines, outcomes, artifacts, hard_time_limit, weights)


def _scored_state(s: DataFrame, baselines: DataFrame | None, outcomes: DataFrame | None, artifacts: DataFrame | None,
                  hard_time_limit: float, weights: RewardWeights | None) -> DataFrame:
    w8 = weights or RewardWeights()
    if baselines is not None:
        s = s.join(baselines.select("task_id", "baseline_metric"), "task_id", "left")
    else:
        s = s.withColumn("baseline_metric", F.lit(None).cast("double"))
    have = [c for c in OUTCOME_COLUMNS if outcomes is not None and c in outcomes.columns]
    if have:
        s = E.as_of(s, outcomes, have)
    s = s.withColumns({n: F.lit(None).cast(t) for n, t in OUTCOME_COLUMNS.items() if n not in have})
    if artifacts is not None:
        s = E.artifact_state(s, artifacts)
    else:
        s = s.withColumns({"artifact_model": F.when(F.col("has_model"), "ok").otherwise("missing"),
                           "artifact_table": F.lit(None).cast("boolean")})
    c = F.col
    z = lambda name: F.coalesce(c(name), F.lit(0))
    b = lambda name: F.coalesce(c(name), F.lit(False))
    done = c("done")
    v: dict[str, Column] = {}
    #: validator -> (when it is judged at all, [(found, code, penalty)], [(found, code, bonus)])
    why: dict[str, tuple[Column, list, list]] = {}
    always = F.lit(True)
    # 1 execution
    v["execution"] = _v(c("ok"), F.when(c("ok"), 1.0).otherwise(0.0), F.when(c("ok"), 0.0).otherwise(0.1))
    why["execution"] = (always, [(~c("ok"), F.concat(F.lit("crash:"), F.coalesce("error_class", F.lit("none"))), 0.1)], [])
    # 2 correctness (F10, F11), 3 intactness (C4)
    bad_preds = (c("n_predictions") != c("n_expected")) | (z("n_non_finite") > 0)
    bad_preds = F.coalesce(bad_preds, F.lit(False))
    v["correctness"] = F.when(c("n_predictions").isNull(), _pass(0.5)).otherwise(
        _v(~bad_preds, F.when(bad_preds, 0.0).otherwise(1.0), F.when(bad_preds, 0.2).otherwise(0.0)))
    wrong_length = F.coalesce(c("n_predictions") != c("n_expected"), F.lit(False))
    why["correctness"] = (c("n_predictions").isNotNull(), [
        (wrong_length, "wrong_length", 0.2), (z("n_non_finite") > 0, "non_finite", F.when(wrong_length, 0.0).otherwise(0.2))], [])
    why["intactness"] = (always, [(~F.coalesce(c("intact"), F.lit(True)), "inputs_changed", 0.3)], [])
    v["intactness"] = F.when(F.coalesce(c("intact"), F.lit(True)), _pass()).otherwise(
        _v(F.lit(False), F.lit(0.0), F.lit(0.3)))
    # 4 leakage (T6 + T7)
    leak = c("leak_issues") > 0
    v["leakage"] = _v(~leak, F.when(leak, 0.0).otherwise(1.0), F.when(leak, 0.5).otherwise(0.0))
    why["leakage"] = (always, [(leak, "leak", 0.5)], [])
    # 5 plan coverage
    cov = F.when(z("plan_total_weight") > 0, z("plan_covered_weight") / c("plan_total_weight")).otherwise(0.0)
    missed_req = z("plan_missed_required")
    v["plan_coverage"] = (F.when(z("task_items") == 0, _pass())
                          .when(~c("has_plan"), _v(F.lit(False), F.lit(0.0), F.lit(0.0)))
                          .otherwise(_v((missed_req == 0) & (cov > 0.5), cov, 0.2 * missed_req)))
    why["plan_coverage"] = (z("task_items") > 0, [
        (~c("has_plan"), "no_plan", 0.0), (c("has_plan") & (missed_req > 0), "required_missed", 0.2 * missed_req),
        (c("has_plan") & (missed_req == 0) & (cov <= 0.5), "low_coverage", 0.0)], [])
    # 6 namespace check (E17, F7): from step 3 on a model must exist, from step 2 on a feature table must be numeric
    of_model, of_table = c(IDX) + 1 >= 3, (c(IDX) + 1 >= 2) & c("artifact_table").isNotNull()
    total = F.when(of_model, 1).otherwise(0) + F.when(of_table, 1).otherwise(0)
    model_ok, table_ok = c("artifact_model") == "ok", F.coalesce(c("artifact_table"), F.lit(False))
    okc = F.when(of_model & model_ok, 1).otherwise(0) + F.when(of_table & table_ok, 1).otherwise(0)
    v["namespace_check"] = F.when(total == 0, _pass()).otherwise(
        _v(okc == total, okc / total, 0.1 * (total - okc)))
    why["namespace_check"] = (total > 0, [
        (of_model & (c("artifact_model") == "missing"), "no_model", 0.1),
        (of_model & (c("artifact_model") == "no_predict"), "model_without_predict", 0.1),
        (of_table & ~table_ok, "non_numeric_table", 0.1)], [])
    # 7 model eval
    ev = prediction_score_vs_baseline(c("model_metric"), c("baseline_score"))
    v["model_eval"] = F.when(c("model_metric").isNull(), _pass(0.5)).otherwise(
        _v(ev["passed"], ev["score"], ev["penalty"]))
    why["model_eval"] = (c("model_metric").isNotNull(), [(~ev["passed"], "below_baseline", ev["penalty"])], [])
    # 8 backtracking
    bt = c("backtracks")
    v["backtracking"] = _v(bt == 0, F.greatest(F.lit(0.0), 1 - 0.25 * bt), 0.15 * bt)
    why["backtracking"] = (always, [(bt > 0, "backtracks", 0.15 * bt)], [])
    # 9 reproducibility
    seed_issue = c("repro_fit") & ~c("repro_seed")
    differs = c("repro_fit") & ~F.coalesce(c("predictions_match"), F.lit(True))
    v["reproducibility"] = F.when(~c("repro_steps"), _pass()).otherwise(_scored(
        seed_issue | differs, F.when(seed_issue, 0.1).otherwise(0.0) + F.when(differs, 0.15).otherwise(0.0)))
    why["reproducibility"] = (c("repro_steps"), [(seed_issue, "no_seed", 0.1), (differs, "predictions_differ", 0.15)], [])
    # 10 efficiency (T10 + E11)
    el, bud = c("elapsed"), c("time_budget_seconds")
    tpen = E.time_penalty(el, bud, hard_time_limit)
    grid = c("eff_grid") & ~c("eff_efficient")
    v["efficiency"] = _scored((el >= hard_time_limit) | (el > bud) | grid,
                              tpen + F.when(grid, 0.15).otherwise(0.0))
    why["efficiency"] = (always, [((el >= hard_time_limit) | (el > bud), F.when(el >= hard_time_limit, "hard_limit").otherwise(
        "over_budget"), tpen), (grid, "grid_search", 0.15)], [])
    # 11 correlation (T11 + T12)
    did_corr = c("corr_code") | c("plan_corr")
    missed_pairs = F.when(c("corr_pca"), 0).otherwise(z("corr_missed_pairs"))
    v["correlation"] = F.when(~b("has_high_correlation"), _pass()).otherwise(_scored(
        ~did_corr | (missed_pairs > 0),
        F.when(~did_corr, 0.1).otherwise(0.0) + 0.05 * missed_pairs))
    why["correlation"] = (b("has_high_correlation"), [
        (~did_corr, "no_correlation_analysis", 0.1), (missed_pairs > 0, "pairs_left", 0.05 * missed_pairs)], [])
    # 12 missing values
    mentions = c("miss_fill") | c("miss_dropna") | c("plan_missing")
    unh, badst = z("miss_unhandled"), z("miss_bad_strategy")
    lost = c("miss_dropna") & (F.coalesce(c("row_loss"), F.lit(0.0)) > 0.15)
    left_pen = 0.05 * F.least(unh, F.lit(3))
    v["missing_values"] = F.when(~b("has_missing"), _pass()).otherwise(_scored(
        ~mentions | (badst > 0) | lost | (mentions & (unh > 0)),
        F.when(~mentions, 0.15).otherwise(0.0) + 0.05 * badst + F.when(lost, 0.10).otherwise(0.0)
        + F.when(mentions, left_pen).otherwise(0.0)))
    why["missing_values"] = (b("has_missing"), [
        (~mentions, "no_missing_handling", 0.15), (badst > 0, "mostly_missing_filled", 0.05 * badst),
        (lost, "rows_lost", 0.10), (mentions & (unh > 0), "columns_left", left_pen)], [])
    # 13 distribution (T14 + T15)
    no_eda = ~(c("dist_eda") | c("plan_eda"))
    no_out = b("has_sig_outliers") & ~(c("dist_outlier") | c("plan_outlier"))
    v["distribution"] = _scored(no_eda | no_out, F.when(no_eda, 0.10).otherwise(0.0)
                                + F.when(no_out, 0.08).otherwise(0.0))
    why["distribution"] = (always, [(no_eda, "no_eda", 0.10), (no_out, "outliers_left", 0.08)], [])
    # 14 feature pipeline
    v["feature_pipeline"] = F.when(c("pipeline_penalty").isNull(), _pass()).otherwise(
        _scored(b("pipeline_issues"), c("pipeline_penalty")))
    why["feature_pipeline"] = (c("pipeline_penalty").isNotNull(), [(b("pipeline_issues"), "pipeline", c("pipeline_penalty"))], [])
    # 15 duplicates (F8 + T16)
    left = z("remaining_duplicates") > 0
    mentioned = c("dup_code") | c("plan_dedup")
    v["duplicates"] = F.when(~b("has_duplicates"), _pass()).otherwise(
        _scored(left, F.when(left & mentioned, 0.04).when(left, 0.08).otherwise(0.0)))
    why["duplicates"] = (b("has_duplicates"), [
        (left, F.when(mentioned, "mentioned_but_left").otherwise("duplicates_left"), F.when(mentioned, 0.04).otherwise(0.08))], [])
    # 16 target leakage model (L1, L2), at the end only
    leaks, overfit = z("leak_features") > 0, b("overfit")
    v["target_leakage_model"] = F.when(~done, _pass()).otherwise(
        _scored(leaks | overfit, F.when(leaks, 0.25).otherwise(0.0) + F.when(overfit, 0.10).otherwise(0.0)))
    why["target_leakage_model"] = (done, [(leaks, "leaking_feature", 0.25), (overfit, "train_valid_gap", 0.10)], [])
    # 17 feature importance (T17, L5, L6), at the end only
    inspects = c("imp_code") | c("plan_importance")
    no_value = F.coalesce(c("model_value") <= 0, F.lit(False))
    adds_value, on_top = F.coalesce(c("model_value") > 0, F.lit(False)), z("new_top_features") > 0
    v["feature_importance"] = F.when(~done, _pass()).otherwise(_scored(
        ~inspects | no_value, F.when(inspects, 0.0).otherwise(0.08),
        F.when(on_top, 0.03).otherwise(0.0) + F.when(adds_value, 0.05).otherwise(0.0)))
    why["feature_importance"] = (done, [(~inspects, "no_importance", 0.08), (no_value, "model_adds_nothing", 0.0)],
                                 [(on_top, "new_features_on_top", 0.03), (adds_value, "model_adds_value", 0.05)])
    # 18 hyper-parameters (T18-T20 + E12)
    no_params = (c("hp_params") == 0) & ~c("hp_tuning")
    bads = [c(f"hp_bad{i}") for i in range(len(TR.BAD_PARAMS))]
    n_bad = reduce(lambda a, x: a + x.cast("int"), bads, F.lit(0))
    hp_pen = F.when(no_params, 0.05).otherwise(0.0) + 0.08 * n_bad + F.when(c("slow_fit"), 0.10).otherwise(0.0)
    v["hyperparameters"] = F.when(~c("hp_steps") | ~c("hp_fit"), _pass()).otherwise(
        _scored(no_params | (n_bad > 0) | c("slow_fit"), hp_pen))
    why["hyperparameters"] = (c("hp_steps") & c("hp_fit"), [
        (no_params, "all_defaults", 0.05), *[(x, f"suspicious_{i}", 0.08) for i, x in enumerate(bads)], (c("slow_fit"), "slow_fit", 0.10)],
        [(c("hp_tuning"), "tuning", 0.0), (~c("hp_tuning") & (c("hp_params") > 0), "parameters_set", 0.0)])
    # 19 model choice
    ann_bad = c("mc_ann") & ~c("mc_good")
    custom_bad = c("mc_custom") & ~c("mc_library")
    v["model_choice"] = (F.when(~c("mc_fit") & done, _v(F.lit(False), F.lit(0.0), F.lit(0.15)))
                         .when(~c("mc_fit"), _pass())
                         .otherwise(_scored(ann_bad | custom_bad, F.when(ann_bad, 0.12).otherwise(0.0)
                                            + F.when(custom_bad, 0.08).otherwise(0.0))))
    why["model_choice"] = (c("mc_fit") | done, [
        (~c("mc_fit"), "no_model_trained", 0.15), (c("mc_fit") & ann_bad, "neural_only", 0.12), (c("mc_fit") & custom_bad, "hand_written", 0.08)],
        [(c("mc_fit") & c("mc_ann") & c("mc_good"), "both_families", 0.0), (c("mc_fit") & c("mc_good"), "proven_model", 0.0),
         (c("mc_fit") & c("mc_library") & ~c("mc_good"), "library", 0.0), (c("mc_fit") & c("mc_ensemble"), "ensemble", 0.0)])
    # 20 split quality
    is_ts = c("is_time_series") | b("has_datetime_like") | c("sp_ts_hint") | c("plan_ts_hint")
    no_cv = ~c("sp_cv")
    ts_shuffle = is_ts & ~c("sp_ts_split") & c("sp_shuffle_true") & ~c("sp_shuffle_false")
    clf = c("task_type") != "regression"
    no_strat = (clf & c("class_imbalance_ratio").isNotNull() & (c("class_imbalance_ratio") < 0.3)
                & ~c("sp_stratify") & ~c("sp_cv"))
    tiny = F.coalesce(c("valid_frac") < 0.05, F.lit(False))
    sp_pen = (F.when(no_cv, 0.05).otherwise(0.0) + F.when(ts_shuffle, 0.15).otherwise(0.0)
              + 0.10 * c("sp_bad_sizes") + F.when(no_strat, 0.05).otherwise(0.0) + F.when(tiny, 0.10).otherwise(0.0))
    v["split_quality"] = F.when(~c("sp_fit"), _pass()).otherwise(
        _scored(no_cv | ts_shuffle | (c("sp_bad_sizes") > 0) | no_strat | tiny, sp_pen))
    why["split_quality"] = (c("sp_fit"), [
        (no_cv, "no_cross_validation", 0.05), (ts_shuffle, "time_series_shuffled", 0.15),
        (c("sp_bad_sizes") > 0, "odd_test_size", 0.10 * c("sp_bad_sizes")), (no_strat, "not_stratified", 0.05), (tiny, "tiny_valid_set", 0.10)],
        [(~no_cv, "cross_validation", 0.0), (F.coalesce(c("valid_frac") > 0.05, F.lit(False)), "valid_set", 0.0)])
    # 21 iterative cycles (E6 + E7)
    cyc, hist = c("cycle_count"), c("metric_history")
    cpen = E.cycle_penalty(cyc, hist)
    v["iterative_cycles"] = F.when(cyc <= 1, _pass()).otherwise(
        _v(cpen <= 0.01, _clamp01(1 - cpen + E.cycle_bonus(hist)), cpen))
    why["iterative_cycles"] = (cyc > 1, [(cpen > 0.01, "costly_cycles", cpen), (cpen <= 0.01, "cheap_cycles", cpen)],
                               [(E.cycle_bonus(hist) > 0, "total_gain", E.cycle_bonus(hist))])
    # 22 baseline comparison (L4 + E8), at the end only
    agent, base = c("metric_cf"), c("baseline_metric")
    diff = agent - base
    better = agent.isNotNull() & base.isNotNull() & (diff > 0.003)
    worse = agent.isNotNull() & base.isNotNull() & (diff < -0.003)
    no_agent = agent.isNull()
    plat = E.plateau(hist, cyc)
    bc_pen = F.when(worse | no_agent, 0.15).otherwise(0.0) + F.when(plat, 0.05).otherwise(0.0)
    v["baseline_comparison"] = F.when(~done, _pass()).otherwise(
        _v(~(worse | no_agent | plat), _clamp01(1 - bc_pen + F.when(better, 0.05).otherwise(0.0)), bc_pen))

    why["baseline_comparison"] = (done, [(worse, "worse_than_baseline", 0.15), (no_agent, "no_metric", 0.15), (plat, "plateau", 0.05)],
                                  [(better, "better_than_baseline", 0.05)])

    wide = s.select(EP, IDX, "task_id", "done", "metric_cf", "baseline_score", "oracle_score", *[v[n].alias(n) for n in VALIDATORS],
                    *[_items(why[n][0], why[n][k]).alias(f"{n}{suffix}") for n in VALIDATORS for k, suffix in ((1, ISSUES), (2, BONUSES))])
    perf = F.coalesce(normalize_score(c("metric_cf"), c("baseline_score"), c("oracle_score")), F.lit(0.0))
    others = [n for n in VALIDATORS if n != "plan_coverage"]
    code_q = reduce(lambda a, n: a + c(n)["score"], others, F.lit(0.0)) / len(others)
    total_pen = reduce(lambda a, n: a + c(n)["penalty"], VALIDATORS, F.lit(0.0))
    weighted = (w8.performance * perf + w8.plan_coverage * c("plan_coverage")["score"]
                + w8.code_quality * code_q)
    return wide.select("*", perf.alias("performance"), code_q.alias("code_quality"),
                       total_pen.alias("total_penalty"),
                       weighted.alias("weighted"), F.greatest(F.lit(0.0), weighted - total_pen).alias("reward"))


def last_steps(scored_steps: DataFrame) -> DataFrame:
    """Of scored steps, each episode's last."""
    last = F.max(IDX).over(Window.partitionBy(EP))
    return scored_steps.withColumn("_last", last).where(F.col(IDX) == F.col("_last")).drop("_last")


def verdict_table(scored: DataFrame, details: bool = False) -> DataFrame:
    """One row per (episode, step, validator). ``details`` adds ``issues`` and ``bonuses``,
    arrays of (code, amount): an issue's amount is its share of the penalty, a bonus's what it adds to the score."""
    arr = F.array(*[F.struct(F.lit(n).alias("validator"), F.col(n)["passed"].alias("passed"),
                             F.col(n)["score"].alias("score"), F.col(n)["penalty"].alias("penalty"),
                             *([F.col(f"{n}{ISSUES}").alias("issues"), F.col(f"{n}{BONUSES}").alias("bonuses")] if details else []))
                    for n in VALIDATORS])
    return scored.select(EP, IDX, F.explode(arr).alias("v")).select(EP, IDX, "v.*")


def verdict_details(scored: DataFrame) -> DataFrame:
    """One row per issue and bonus of every verdict: (episode, step, validator, kind, code, amount)."""
    long = verdict_table(scored, details=True)
    both = F.concat(F.transform("issues", lambda x: F.struct(F.lit("issue").alias("kind"), x["code"].alias("code"), x["amount"].alias("amount"))),
                    F.transform("bonuses", lambda x: F.struct(F.lit("bonus").alias("kind"), x["code"].alias("code"), x["amount"].alias("amount"))))
    return long.select(EP, IDX, "validator", F.explode(both).alias("d")).select(EP, IDX, "validator", "d.*")


def and_verdict(verdicts: DataFrame, label: str, members: list[str] | None = None,
                keys: tuple[str, ...] = (EP, IDX)) -> DataFrame:
    """R2: pass if all members pass; score = min; penalty = sum, only when
    failed. No members -> pass with 1.0."""
    v = verdicts.where(F.col("validator").isin(*members)) if members else verdicts
    g = v.groupBy(*keys).agg(F.bool_and("passed").alias("passed"), F.min("score").alias("score"),
                             F.sum("penalty").alias("_p"))
    return g.select(*keys, F.lit(label).alias("validator"), "passed", "score",
                    F.when(F.col("passed"), 0.0).otherwise(F.col("_p")).alias("penalty"))


def or_verdict(verdicts: DataFrame, label: str, members: list[str] | None = None,
               keys: tuple[str, ...] = (EP, IDX)) -> DataFrame:
    """Pass if any member passes; score = max; penalty 0 if passed, else
    the smallest member penalty."""
    v = verdicts.where(F.col("validator").isin(*members)) if members else verdicts
    g = v.groupBy(*keys).agg(F.bool_or("passed").alias("passed"), F.max("score").alias("score"),
                             F.min("penalty").alias("_p"))
    return g.select(*keys, F.lit(label).alias("validator"), "passed", "score",
                    F.when(F.col("passed"), 0.0).otherwise(F.col("_p")).alias("penalty"))


def reward(verdicts: DataFrame, perf: DataFrame, weights: RewardWeights | None = None,
           keys: tuple[str, ...] = (EP, IDX)) -> DataFrame:
    """R4 over long verdict rows: .5 perf + .2 plan + .3 mean(other scores)
    - sum(penalties), floored at 0; no other verdicts -> code quality 1."""
    w = weights or RewardWeights()
    is_plan = F.col("validator") == "plan_coverage"
    g = verdicts.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(is_plan, F.col("score"))), F.lit(0.0)).alias("plan_score"),
        F.coalesce(F.avg(F.when(~is_plan, F.col("score"))), F.lit(1.0)).alias("code_quality"),
        F.sum("penalty").alias("total_penalty"))
    g = g.join(perf, list(keys), "left").withColumn("performance", F.coalesce("performance", F.lit(0.0)))
    wt = w.performance * F.col("performance") + w.plan_coverage * F.col("plan_score") \
        + w.code_quality * F.col("code_quality")
    return g.withColumn("reward", F.greatest(F.lit(0.0), wt - F.col("total_penalty")))


def perf_score(best: Column, baseline: Column, oracle: Column) -> Column:
    """Normalised best metric, 0 when there is none."""
    return F.coalesce(normalize_score(best, baseline, oracle), F.lit(0.0))


def episode_feedback(verdicts: DataFrame, keys: tuple[str, ...] = (EP, IDX)) -> DataFrame:
    """``[PASS|FAIL] name: score=.. penalty=..`` lines in validator order."""
    order = F.array_position(F.array(*[F.lit(n) for n in VALIDATORS]), F.col("validator"))
    line = F.format_string("  [%s] %s: score=%.2f penalty=%.2f",
                           F.when(F.col("passed"), "PASS").otherwise("FAIL"), F.col("validator"),
                           F.col("score"), F.col("penalty"))
    g = verdicts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("l")))).alias("_a"))
    return g.select(*keys, F.array_join(F.transform("_a", lambda x: x["l"]), "\n").alias("feedback"))
