"""Ordered episode state (E1-E17) and the text flags it needs (T8, T12, T13,
T15, T22, T23) over a step log.

Layout of the work: (1) one projection computes every per-step regex flag
(no window); (2) one window spec -- partition by episode, order by step --
turns the flags into running "so far" state, so the state after every step
(the reference's validators re-run on each step) costs one shuffle and one
sort for all rules together; (3) the few rules that depend on the dataset
profile (correlated pairs, missing columns) or on the task checklist join a
small broadcast table and aggregate back per (episode, step).

Episodes are bounded by ``max_steps`` (a step at index >= max_steps ends the
episode); steps logged after an episode ended are dropped before any window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradewell.functions import text_rules as TR
from gradewell.functions.text_rules import rx_match

EP = "episode_id"
IDX = "step_idx"


def _w_run(extra: list[str] | None = None):
    return (Window.partitionBy(EP, *(extra or [])).orderBy(IDX)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))


def _w_before():
    return Window.partitionBy(EP).orderBy(IDX).rowsBetween(Window.unboundedPreceding, -1)


def _w_all():
    return Window.partitionBy(EP)


def run_any(cond: Column) -> Column:
    """True if ``cond`` held at this step or any earlier one."""
    return F.max(F.coalesce(cond, F.lit(False)).cast("int")).over(_w_run()) == 1


def run_sum(x: Column) -> Column:
    return F.coalesce(F.sum(x).over(_w_run()), F.lit(0))


def _is(*types: str) -> Column:
    return F.col("action_type").isin(*types)


# --------------------------------------------------------------------- E1 / E10
def step_index(steps: DataFrame, order_cols: tuple[str, ...] = ("ts",), skew_safe: bool = False,
               limit: int | None = None) -> DataFrame:
    """0-based step counter per episode in ``order_cols`` order.

    ``limit``: keep only the first ``limit`` steps of each episode; written as
    ``row_number() <= limit`` Spark applies it as a partial group limit
    before the shuffle, so a huge episode ships at most ``limit`` rows per
    map task. ``skew_safe``: number every step with the range-partitioned
    :func:`distributed_row_number` instead of one window per episode."""
    if skew_safe:
        from gradewell.functions.ranking import distributed_row_number
        return distributed_row_number(steps, [EP], list(order_cols), out=IDX).withColumn(IDX, F.col(IDX).cast("int"))
    w = Window.partitionBy(EP).orderBy(*order_cols)
    rn = F.row_number().over(w)
    if limit is not None:
        return steps.withColumn("_rn", rn).where(F.col("_rn") <= limit) \
            .withColumn(IDX, (F.col("_rn") - 1).cast("int")).drop("_rn")
    return steps.withColumn(IDX, (rn - 1).cast("int"))


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def steps_without_task(steps: DataFrame, tasks: DataFrame) -> DataFrame:
    """E10's rejected steps: (task_id, n_episodes, n_steps) of the task ids,
    null included, that no row of ``tasks`` has. :func:`prepare_steps` cannot
    score them and leaves them out."""
    lost = steps.select("task_id", EP).join(tasks.select("task_id"), "task_id", "left_anti")
    per = lost.groupBy("task_id", EP).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("task_id").agg(F.count(F.lit(1)).alias("n_episodes"), F.sum("n").alias("n_steps"))


def prepare_steps(steps: DataFrame, tasks: DataFrame, hard_time_limit: float = 3600.0) -> DataFrame:
    """E10 + context: joins each step to its task (steps carry ``task_id``;
    the planner broadcasts a small task table), adds the text a rule
    reads, elapsed seconds since the episode's first step, the done flag
    (FINAL_SUBMIT, step index >= max_steps, or elapsed > budget) and drops
    steps after the first done step. Steps of a task that is not in ``tasks``
    are left out; :func:`steps_without_task` counts them."""
    if IDX not in steps.columns:
        # an episode ends at index max_steps at the latest: number only the
        # first max(max_steps) + 1 steps (top-k per episode, bounded shuffle)
        bound = tasks.agg(F.max("max_steps")).first()[0]
        order = [c for c in ("ts", "event_id") if c in steps.columns]       # equal times: by event
        steps = step_index(steps, (*order, *([] if len(order) > 1 else ["action_type", "code_body"])), limit=None if bound is None else int(bound) + 1)
    if "action_text" not in steps.columns:
        steps = steps.withColumn("action_text", F.lit(None).cast("string"))
    t = tasks.select("task_id", "dataset_path", "target_column", "task_type", "metric",
                     "time_budget_seconds", "max_steps", "baseline_score", "oracle_score",
                     (F.coalesce(F.col("metadata")["is_time_series"] == "true", F.lit(False))
                      | F.col("metadata")["time_column"].isNotNull()).alias("is_time_series"))
    s = steps.join(t, "task_id").where(F.col(IDX) <= F.col("max_steps"))
    start = F.min("ts").over(_w_all())
    s = s.select("*", TR.step_text(F.col("code_body"), F.col("action_text")).alias("text"),
                 (seconds(F.col("ts")) - seconds(start)).alias("elapsed"))
    done = (_is("FINAL_SUBMIT") | (F.col(IDX) >= F.col("max_steps"))
            | (F.col("elapsed") > F.col("time_budget_seconds")))
    s = s.select("*", done.alias("done"))
    first_done = F.min(F.when(F.col("done"), F.col(IDX))).over(_w_all())
    s = s.select("*", first_done.alias("_first_done"))
    return s.where(F.col("_first_done").isNull() | (F.col(IDX) <= F.col("_first_done"))).drop("_first_done")


# --------------------------------------------------------------------- flags
SUB_CF = ("CODE", "FEATURE_ENGINEERING")                                  # correlation
SUB_CFM = ("CODE", "FEATURE_ENGINEERING", "MODEL", "CODE_FIX")            # missing, distribution, split
SUB_CFX = ("CODE", "FEATURE_ENGINEERING", "CODE_FIX")                     # duplicates
SUB_CMF = ("CODE", "MODEL", "FEATURE_ENGINEERING")                        # importance, reproducibility
SUB_CM = ("CODE", "MODEL")                                                # model choice, efficiency, hyperparams


def step_flags(s: DataFrame) -> DataFrame:
    """Every per-step regex flag the rules read (one projection, no window). A pattern is
    tried only at the steps whose type and outcome let the state read it; elsewhere its flag is
    false, a plan flag null."""
    t = F.col("text")
    ok = F.col("execution_success")
    won = F.coalesce(ok, F.lit(False))
    cf, cfm, cfx, cm = _is(*SUB_CF), _is(*SUB_CFM), _is(*SUB_CFX), _is(*SUB_CM)
    won_cm, won_cmf = won & cm, won & _is(*SUB_CMF)
    code_won = won & _is("CODE")
    m = lambda rx: rx_match(t, rx)
    at = lambda where, rx: F.when(where, m(rx)).otherwise(False)
    plan = lambda rx: F.when(_is("PLAN"), m(rx))
    cols = {
        "ok": won,
        "f_fit_spaced": at(cfm, TR.FIT_SPACED), "f_fit_plain": at(won_cmf, TR.FIT_PLAIN), "f_fit_strict": at(code_won, TR.MODEL_FIT_STRICT),
        "f_basic": at(_is("FEATURE_ENGINEERING") | code_won, TR.BASIC_OPS), "f_seed": at(won_cmf, TR.SEED),
        "f_efficient": at(won_cm, TR.EFFICIENT_SEARCH),
        "f_corr": at(cf, TR.CORR_CODE), "f_pca": at(cf, TR.PCA), "f_fill": at(cfm, TR.FILL), "f_dropna": at(cfm, TR.DROPNA),
        "f_eda": at(cfm, TR.EDA), "f_outlier": at(cfm, TR.OUTLIER_HANDLING), "f_dedup": at(cfx, TR.DEDUP_CODE),
        "f_importance": at(_is(*SUB_CMF), TR.IMPORTANCE), "f_tuning": at(won_cm, TR.TUNING), "f_ann": at(cm, TR.ANN),
        "f_good": at(cm, TR.GOOD_TABULAR), "f_ensemble": at(cm, TR.ENSEMBLE), "f_library": at(cm, TR.LIBRARY_IMPORT),
        "f_cv": at(cfm, TR.CV), "f_ts_split": at(cfm, TR.TIMESERIES_SPLIT), "f_shuffle_true": at(cfm, TR.SHUFFLE_TRUE),
        "f_shuffle_false": at(cfm, TR.SHUFFLE_FALSE), "f_stratify": at(cfm, TR.STRATIFY), "f_ts_hint": at(cfm, TR.TIMESERIES_HINTS),
        "f_model_assign": at(won, TR.MODEL_ASSIGN),
        "n_hyperparams": F.when(won_cm, TR.hyperparam_count(t)).otherwise(0),
        "n_leak_patterns": F.size(TR.leak_issues(t)),
        "n_target_lines": TR.target_as_feature_lines(t, F.col("target_column")),
        "n_bad_test_size": F.when(cfm, F.size(F.filter(
            TR.test_sizes(t), lambda v: (v > 0) & (v < 1) & ((v < 0.10) | (v > 0.50))))).otherwise(0),
        "error_class": F.when(~won, TR.classify_error(F.col("error_message"))),
        # plan-text flags (plan = the latest PLAN step's text)
        "p_corr": plan(TR.CORR_PLAN), "p_missing": plan(TR.MISSING_PLAN), "p_eda": plan(TR.EDA_PLAN),
        "p_outlier": plan(TR.OUTLIER_PLAN), "p_dedup": plan(TR.DEDUP_PLAN), "p_importance": plan(TR.IMPORTANCE),
        "p_ts_hint": plan(TR.TIMESERIES_HINTS),
    }
    for i, rx in enumerate(TR.BAD_PARAMS):
        cols[f"f_bad{i}"] = at(won_cm, rx)
    return s.select("*", *[v.alias(k) for k, v in cols.items()])


# --------------------------------------------------------------------- state
def _terms() -> tuple[dict[str, Column], dict[str, Column]]:
    """What every step adds to the state: (counts to sum up, facts that hold from then on)."""
    ok = F.col("ok")
    succ_cm, succ_cmf = ok & _is(*SUB_CM), ok & _is(*SUB_CMF)
    sums = {
        "repair_attempts": _is("CODE_FIX").cast("int"), "repair_successes": (_is("CODE_FIX") & ok).cast("int"),      # E2
        "fe_successes": (_is("FEATURE_ENGINEERING") & ok).cast("int"), "model_successes": (_is("MODEL") & ok).cast("int"),   # E15
        # T6 / T7 leakage (all but FINAL_SUBMIT)
        "leak_issues": F.when(~_is("FINAL_SUBMIT"), F.col("n_leak_patterns") + F.col("n_target_lines")).otherwise(0),
        "hp_params": F.when(succ_cm, F.col("n_hyperparams")).otherwise(0),
        "sp_bad_sizes": F.when(_is(*SUB_CFM), F.col("n_bad_test_size")).otherwise(0),
    }
    anys = {
        "has_plan": _is("PLAN"),
        # E17 artifact rule of a log without an artifact table: a successful step assigning a model variable
        "has_model": ok & F.col("f_model_assign"),
        # reproducibility (T9): success CODE/MODEL/FE
        "repro_steps": succ_cmf, "repro_fit": succ_cmf & F.col("f_fit_plain"), "repro_seed": succ_cmf & F.col("f_seed"),
        # efficiency (T10): success CODE/MODEL, grid on the concatenated code
        "eff_efficient": succ_cm & F.col("f_efficient"),
        # correlation
        "corr_code": _is(*SUB_CF) & F.col("f_corr"), "corr_pca": _is(*SUB_CF) & F.col("f_pca"),
        # missing (T13)
        "miss_fill": _is(*SUB_CFM) & F.col("f_fill"), "miss_dropna": _is(*SUB_CFM) & F.col("f_dropna"),
        # distribution
        "dist_eda": _is(*SUB_CFM) & F.col("f_eda"), "dist_outlier": _is(*SUB_CFM) & F.col("f_outlier"),
        # duplicates
        "dup_code": _is(*SUB_CFX) & F.col("f_dedup"),
        # importance
        "imp_code": _is(*SUB_CMF) & F.col("f_importance"),
        # hyper-parameters (T18-T20): success CODE/MODEL
        "hp_steps": succ_cm, "hp_fit": succ_cm & F.col("f_fit_spaced"), "hp_tuning": succ_cm & F.col("f_tuning"),
        **{f"hp_bad{i}": succ_cm & F.col(f"f_bad{i}") for i in range(len(TR.BAD_PARAMS))},
        # model choice (T21): CODE/MODEL, any outcome
        **{f"mc_{k}": _is(*SUB_CM) & F.col(f"f_{v}") for k, v in [
            ("fit", "fit_spaced"), ("ann", "ann"), ("good", "good"), ("library", "library"), ("ensemble", "ensemble")]},
        # split (T22): CODE/MODEL/FE/CODE_FIX
        **{f"sp_{k}": _is(*SUB_CFM) & F.col(f"f_{v}") for k, v in [
            ("fit", "fit_spaced"), ("cv", "cv"), ("ts_split", "ts_split"), ("shuffle_true", "shuffle_true"),
            ("shuffle_false", "shuffle_false"), ("stratify", "stratify"), ("ts_hint", "ts_hint")]},
    }
    return sums, anys


PLAN_FLAGS = ["corr", "missing", "eda", "outlier", "dedup", "importance", "ts_hint"]


def _fit_step() -> Column:
    return F.col("ok") & _is(*SUB_CM) & F.col("f_fit_spaced")


def _trained_here() -> Column:
    return (_is("MODEL") & F.col("ok")) | (_is("CODE") & F.col("ok") & F.col("f_fit_strict"))


def _basic_again() -> Column:
    """A step that is a backtrack if a model was trained before it."""
    return (_is("FEATURE_ENGINEERING") & F.col("f_basic")) | (_is("CODE") & F.col("ok") & F.col("f_basic") & ~F.col("f_fit_strict"))


def _phase() -> Column:
    return (F.when(_is("CODE", "FEATURE_ENGINEERING"), F.when(F.col("f_fit_spaced"), "model").otherwise("data"))
            .when(_is("MODEL"), "model"))


def running_state(f: DataFrame, carry_forward: bool = True) -> DataFrame:
    """E2-E9, E11-E15 and the rule inputs as running columns (state after
    each step). All windows share one partitioning (episode) and order.
    ``carry_forward``: the metric history holds the session's current metric
    at every step from the first one on (as the environment records it);
    False keeps only steps that logged a metric."""
    ok = F.col("ok")
    sums, anys = _terms()
    plan_last = lambda c: F.last(F.when(_is("PLAN"), F.col(c)), ignorenulls=True).over(_w_run())
    fit_step, phase = _fit_step(), _phase()
    prev_fit_ts = F.last(F.when(fit_step, seconds(F.col("ts"))), ignorenulls=True).over(_w_before())
    trained_before = F.min(F.when(_trained_here(), F.col(IDX))).over(_w_before())
    prev_phase = F.coalesce(F.last(phase, ignorenulls=True).over(_w_before()), F.lit("init"))
    last_ok_idx = F.last(F.when(ok, F.col(IDX)), ignorenulls=True).over(_w_run())
    concat = lambda cond: F.array_join(F.collect_list(F.when(cond, F.col("text"))).over(_w_run()), "\n")
    cols = {
        **{k: run_sum(v) for k, v in sums.items()}, **{k: run_any(v) for k, v in anys.items()},
        "consecutive_failures": F.col(IDX) - F.coalesce(last_ok_idx, F.lit(-1)),                     # E3
        "phase": phase, "cycle_count": run_sum(((phase == "model") & (prev_phase == "data")).cast("int")),   # E4
        # E5 (metric carried forward: the session's current best value)
        "metric_cf": F.last("metric_value", ignorenulls=True).over(_w_run()),
        "backtracks": run_sum((trained_before.isNotNull() & _basic_again()).cast("int")),            # E9
        "slow_fit": run_any(fit_step & prev_fit_ts.isNotNull()                                       # E12
                            & ((seconds(F.col("ts")) - prev_fit_ts) > 0.5 * F.col("time_budget_seconds"))),
        # E14 / plan flags
        "plan_text": plan_last("text"),
        **{f"plan_{k}": F.coalesce(plan_last(f"p_{k}"), F.lit(False)) for k in PLAN_FLAGS},
        "eff_code": concat(ok & _is(*SUB_CM)), "mc_code": concat(_is(*SUB_CM)),
    }
    out = f.select("*", *[v.alias(k) for k, v in cols.items()])
    # E5 history: the carried metric of every step from the first metric on
    hist_src = "metric_cf" if carry_forward else "metric_value"
    hist = F.collect_list(F.when(F.col(hist_src).isNotNull(), F.col(hist_src))).over(_w_run())
    keep = [x for x in out.columns if x not in ("eff_code", "mc_code")]
    return out.select(*keep, hist.alias("metric_history"),
                      rx_match(F.col("eff_code"), TR.GRIDSEARCH).alias("eff_grid"),
                      rx_match(F.col("mc_code"), TR.CUSTOM_MODEL).alias("mc_custom"))


#: What an episode's steps share, and what its last step says.
SHARED = ["task_id", "dataset_path", "task_type", "time_budget_seconds", "max_steps", "baseline_score", "oracle_score", "is_time_series"]
LAST = ["ok", "done", "elapsed", "error_message", "error_class"]


def folded_state(f: DataFrame, carry_forward: bool = True, n_chunks: int = 0) -> DataFrame:
    """The last row of :func:`running_state` of every episode, without running windows: one
    aggregate by episode. Counts and facts combine in any order; what depends on the
    order of steps (phases, fits, metrics, code) is kept as short lists and folded once."""
    ok, idx = F.col("ok"), F.col(IDX)
    sums, anys = _terms()
    phase, fit = _phase(), F.when(_fit_step(), seconds(F.col("ts")))
    at = lambda cond: F.when(cond, idx)
    plan_last = lambda c: F.max_by(F.col(c), at(_is("PLAN") & F.col(c).isNotNull()))
    listed = lambda v: F.array_sort(F.collect_list(F.when(v.isNotNull(), F.struct(idx.alias("i"), v.alias("v")))))
    g = f.groupBy(EP).agg(
        F.max(idx).alias(IDX), F.max_by(F.struct(*LAST), idx).alias("_last"),
        *[F.first(c).alias(c) for c in SHARED],
        *[F.coalesce(F.sum(v), F.lit(0)).alias(k) for k, v in sums.items()],
        *[F.coalesce(F.bool_or(v), F.lit(False)).alias(k) for k, v in anys.items()],
        F.max(at(ok)).alias("_ok"), plan_last("text").alias("plan_text"),
        *[F.coalesce(plan_last(f"p_{k}"), F.lit(False)).alias(f"plan_{k}") for k in PLAN_FLAGS],
        F.max_by("metric_value", at(F.col("metric_value").isNotNull())).alias("metric_cf"),
        listed(phase).alias("_phases"), listed(fit).alias("_fits"), listed(F.col("metric_value")).alias("_metrics"),
        F.array_sort(F.collect_list(idx)).alias("_steps"), F.min(at(_trained_here())).alias("_trained"),
        F.collect_list(at(_basic_again())).alias("_basic"),
        listed(F.when(ok & _is(*SUB_CM), F.col("text"))).alias("_eff"), listed(F.when(_is(*SUB_CM), F.col("text"))).alias("_mc"),
        *[F.coalesce(F.bit_or(f"{m}{k}"), F.lit(0).cast("long")).alias(f"{m}{k}") for m in ("m_cd", "m_mq", "m_md") for k in range(n_chunks)])
    before = lambda a, i: F.get(a, i - 1)["v"]
    code = lambda c: F.array_join(F.transform(c, lambda x: x["v"]), "\n")
    values = F.transform("_metrics", lambda x: x["v"])
    if carry_forward:
        last_at = lambda i: F.try_element_at(F.filter("_metrics", lambda m: m["i"] <= i), F.lit(-1))["v"]
        values = F.filter(F.transform("_steps", last_at), lambda v: v.isNotNull())
    return g.select(
        EP, IDX, *[F.col("_last")[c].alias(c) for c in LAST], *SHARED, *sums, *anys, "plan_text", "metric_cf",
        *[f"plan_{k}" for k in PLAN_FLAGS], *[f"{m}{k}" for m in ("m_cd", "m_mq", "m_md") for k in range(n_chunks)],
        (F.col(IDX) - F.coalesce("_ok", F.lit(-1))).alias("consecutive_failures"),
        F.size(F.filter("_phases", lambda x, i: (x["v"] == "model") & (before(F.col("_phases"), i) == "data"))).alias("cycle_count"),
        F.size(F.filter("_basic", lambda i: i > F.col("_trained"))).alias("backtracks"),
        (F.size(F.filter("_fits", lambda x, i: (x["v"] - before(F.col("_fits"), i)) > 0.5 * F.col("time_budget_seconds"))) > 0).alias("slow_fit"),
        values.alias("metric_history"), rx_match(code("_eff"), TR.GRIDSEARCH).alias("eff_grid"),
        rx_match(code("_mc"), TR.CUSTOM_MODEL).alias("mc_custom"))


# --------------------------------------------------------------------- what other tables say, as of a step
def as_of(state: DataFrame, facts: DataFrame, columns: list[str]) -> DataFrame:
    """Adds to each state row the latest known value of each column of ``facts``, a
    change log by (episode, step), at or before the row's step. Facts without a
    step hold from the start."""
    here = facts if IDX in facts.columns else facts.withColumn(IDX, F.lit(0))
    log = here.groupBy(EP).agg(F.array_sort(F.collect_list(F.struct(F.col(IDX).alias("i"), *columns))).alias("_facts"))
    # each column's own values, once an episode: a step looks through those alone
    own = lambda c: F.transform(F.filter("_facts", lambda x: x[c].isNotNull()),
                                lambda x: F.struct(x["i"].alias("i"), x[c].alias("v")))
    log = log.select(EP, *[own(c).alias(f"_of_{c}") for c in columns])
    known = lambda c: _latest(f"_of_{c}")["v"]
    return state.join(log, EP, "left").select(*state.columns, *[known(c).alias(c) for c in columns])


def _latest(entries: str) -> Column:
    """Of an episode's entries, ordered by step ``i``, the last at or before the row's step."""
    return F.try_element_at(F.filter(entries, lambda x: x["i"] <= F.col(IDX)), F.lit(-1))


#: Names a trained model may have, the first that exists counts (fixed values, in order), and the feature table.
MODEL_NAMES = ["model", "clf", "classifier", "regressor", "estimator", "pipeline"]
FEATURE_TABLE = "X_train"


def artifact_state(state: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Adds what a versioned artifact log (episode_id, step_idx, name, has_predict,
    non_numeric_columns: F7's count for a table) holds as of each row's step: ``artifact_model``
    ('missing', 'no_predict', 'ok') and ``artifact_table`` (null without a feature table, else whether it is numeric)."""
    log = artifacts.where(F.col("name").isin(*MODEL_NAMES, FEATURE_TABLE)).groupBy(EP).agg(F.array_sort(F.collect_list(
        F.struct(F.col(IDX).alias("i"), "name", F.coalesce("has_predict", F.lit(False)).alias("p"),
                 F.coalesce("non_numeric_columns", F.lit(0)).cast("long").alias("q")))).alias("_art"))
    log = log.select(EP, *[F.filter("_art", lambda x: x["name"] == n).alias(f"_of_{n}") for n in (*MODEL_NAMES, FEATURE_TABLE)])
    now = lambda n: _latest(f"_of_{n}")
    model = F.coalesce(*[now(n)["p"] for n in MODEL_NAMES])         # p is never null where there is an entry
    return state.join(log, EP, "left").select(
        *state.columns, F.when(model.isNull(), "missing").when(~model, "no_predict").otherwise("ok").alias("artifact_model"),
        (now(FEATURE_TABLE)["q"] == 0).alias("artifact_table"))


# --------------------------------------------------------------------- E6-E8, E11, E16
def metric_gain(hist: Column, paid_idx: Column, free: int = 1) -> Column:
    """Gain of paid cycle i: h[free+i-1] - h[max(free+i-2, 0)]; past the
    end the last two; null with fewer than 2 entries (0-based indexes)."""
    n = F.size(hist)
    after = F.lit(free) + paid_idx - 1
    before = F.greatest(after - 1, F.lit(0))
    at = lambda i: F.element_at(hist, (i + 1).cast("int"))
    return (F.when(n < 2, F.lit(None).cast("double"))
            .when(after >= n, at(n - 1) - at(n - 2))
            .otherwise(at(after) - at(before)))


def total_gain(hist: Column) -> Column:
    return F.when(F.size(hist) >= 2, F.element_at(hist, -1) - F.element_at(hist, 1))


def cycle_penalty(cycles: Column, hist: Column, free: int = 1, base: float = 0.03, alpha: float = 1.5,
                  gain_factor: float = 0.10, regression_penalty: float = 0.08,
                  min_gain: float = 0.005) -> Column:
    """Sum over paid cycles of the growing cost, raised on regressions
    and reduced by significant gains."""
    paid = cycles - free

    def one(i):
        cost = F.lit(base) * F.pow(i.cast("double"), F.lit(alpha))
        g = metric_gain(hist, i, free)
        return (F.when(g.isNull(), cost)
                .when(g < -min_gain, cost + regression_penalty * F.abs(g))
                .when(g < min_gain, cost)
                .otherwise(F.greatest(F.lit(0.0), cost - F.least(cost, gain_factor * g))))

    return F.when(paid <= 0, F.lit(0.0)).otherwise(
        F.aggregate(F.transform(F.sequence(F.lit(1), paid.cast("int")), one), F.lit(0.0), lambda a, b: a + b))


def cycle_bonus(hist: Column) -> Column:
    tg = total_gain(hist)
    return F.when(tg.isNotNull() & (tg > 0.02), F.least(F.lit(0.05), tg * 0.3)).otherwise(0.0)


def plateau(hist: Column, cycles: Column, window: int = 3, threshold: float = 0.003) -> Column:
    """Last ``window`` metrics spread < threshold while cycles > 2."""
    last = F.slice(hist, -window, window)
    return (F.size(hist) >= window) & ((F.array_max(last) - F.array_min(last)) < threshold) & (cycles > 2)


def time_penalty(elapsed: Column, budget: Column, hard_limit: float = 3600.0, max_pen: float = 0.3) -> Column:
    """The full penalty past the hard limit; over budget it grows
    linearly to the full penalty at twice the budget."""
    return (F.when(elapsed >= hard_limit, F.lit(max_pen))
            .when(elapsed > budget, max_pen * F.least((elapsed - budget) / budget, F.lit(1.0)))
            .otherwise(0.0))


def cycle_error_multiplier(cycles: Column) -> Column:
    """1 for <= 1 cycle, else min(3, 1 + 0.5 (n - 1))."""
    return F.when(cycles <= 1, 1.0).otherwise(F.least(F.lit(3.0), 1.0 + 0.5 * (cycles - 1)))


# --------------------------------------------------------------------- profile context
# Rules that look at profile columns (T12 correlated pairs, T13 missing
# columns) or at the task checklist (T8) do not join per (step, column):
# the dataset's column lists ride along each step as small arrays (broadcast
# join on dataset_path / task_id), each step computes a bitmask of the
# columns its text touches, and the running state is a ``bit_or`` window --
# the same single episode window as every other rule.

MASK_BITS = 62


def profile_context(flags: DataFrame, corr_pairs: DataFrame, missing_cols: DataFrame) -> DataFrame:
    """One row per dataset: profile flags + the columns of correlated pairs
    (with pair index arrays) and the missing columns with their fractions."""
    cc = corr_pairs.select("dataset_path", F.explode(F.array("col_a", "col_b")).alias("c")).distinct() \
        .groupBy("dataset_path").agg(F.array_sort(F.collect_list("c")).alias("corr_cols"))
    pr = corr_pairs.join(cc, "dataset_path").groupBy("dataset_path").agg(
        F.collect_list(F.struct((F.array_position("corr_cols", F.col("col_a")) - 1).cast("int").alias("a"),
                                (F.array_position("corr_cols", F.col("col_b")) - 1).cast("int").alias("b")))
        .alias("corr_pairs"))
    mc = missing_cols.groupBy("dataset_path").agg(
        F.array_sort(F.collect_list(F.struct("column_name", "missing_frac"))).alias("_m"))
    mc = mc.select("dataset_path", F.transform("_m", lambda x: x["column_name"]).alias("miss_cols"),
                   F.transform("_m", lambda x: x["missing_frac"]).alias("miss_fracs"))
    empty_s = F.array().cast("array<string>")
    return (flags.join(cc, "dataset_path", "left").join(pr, "dataset_path", "left").join(mc, "dataset_path", "left")
            .select(*flags.columns,
                    F.coalesce("corr_cols", empty_s).alias("corr_cols"),
                    F.coalesce("corr_pairs", F.array().cast("array<struct<a:int,b:int>>")).alias("corr_pairs"),
                    F.coalesce("miss_cols", empty_s).alias("miss_cols"),
                    F.coalesce("miss_fracs", F.array().cast("array<double>")).alias("miss_fracs")))


def checklist_context(checklist: DataFrame) -> DataFrame:
    """One row per task: its checklist items (weight, required, keywords)."""
    items = checklist.where(F.col("item_idx").isNotNull()).groupBy("task_id", "item_idx").agg(
        F.first("weight").alias("weight"), F.first("required").alias("required"),
        F.collect_list("keyword").alias("keywords"))
    return items.groupBy("task_id").agg(F.array_sort(F.collect_list(
        F.struct("item_idx", "weight", "required", "keywords"))).alias("checklist"))


def _mask_chunks(cols: Column, hit, n_chunks: int) -> list[Column]:
    """Per chunk k, a BIGINT with bit j set when column k*MASK_BITS+j hits."""
    out = []
    for k in range(n_chunks):
        idx = F.sequence(F.lit(k * MASK_BITS), F.least(F.size(cols), F.lit((k + 1) * MASK_BITS)) - 1)
        idx = F.when(F.size(cols) > k * MASK_BITS, idx).otherwise(F.array().cast("array<int>"))
        out.append(F.aggregate(idx, F.lit(0).cast("long"), lambda acc, i: acc + F.when(
            hit(F.element_at(cols, i + 1)), _pow2(i - k * MASK_BITS)).otherwise(0)))
    return out


def _pow2(j: Column) -> Column:
    return F.pow(F.lit(2.0), j).cast("long")      # exact for j < 63


def _bit(chunks: Column, i: Column) -> Column:
    word = F.element_at(chunks, (F.floor(i / MASK_BITS) + 1).cast("int"))
    return word.bitwiseAND(_pow2(i % MASK_BITS)) != 0


def context_masks(f: DataFrame, n_chunks: int) -> DataFrame:
    """Per-step bitmasks: corr columns dropped (CODE/FE text), missing
    columns quoted / dropped (CODE/FE/MODEL/CODE_FIX text). The text is
    tokenised once (quoted tokens, and quoted tokens after ``.drop(``); a
    column hits when it is one of the tokens -- cost grows with the text, not
    with the number of profile columns. Names holding a quote or newline
    (never a token) fall back to the column's own regex."""
    t = F.col("text")
    read = lambda tokens: F.when(_is(*SUB_CFM), tokens)
    qt, dt = read(TR.quoted_tokens(t)), read(TR.dropped_tokens(t))
    f = f.select("*", qt.alias("_qtok"), dt.alias("_dtok"))
    odd = TR.has_quote_or_newline
    drop_hit = lambda c: F.when(odd(c), F.regexp_like(t, TR.drop_col_pattern(c))).otherwise(
        F.array_contains(F.col("_dtok"), c))
    quote_hit = lambda c: F.when(odd(c), F.regexp_like(t, TR.quoted_col_pattern(c))).otherwise(
        F.array_contains(F.col("_qtok"), c))
    zero = F.lit(0).cast("long")
    cols = {}
    for k, v in enumerate(_mask_chunks(F.col("corr_cols"), drop_hit, n_chunks)):
        cols[f"m_cd{k}"] = F.when(_is(*SUB_CF), v).otherwise(zero)
    for k, v in enumerate(_mask_chunks(F.col("miss_cols"), quote_hit, n_chunks)):
        cols[f"m_mq{k}"] = F.when(_is(*SUB_CFM), v).otherwise(zero)
    for k, v in enumerate(_mask_chunks(F.col("miss_cols"), drop_hit, n_chunks)):
        cols[f"m_md{k}"] = F.when(_is(*SUB_CFM), v).otherwise(zero)
    return f.select("*", *[v.alias(k) for k, v in cols.items()]).drop("_qtok", "_dtok")


def context_state(st: DataFrame, n_chunks: int, folded: bool = False) -> DataFrame:
    """T8, T12, T13 from the running masks (``folded``: the masks are an episode's already) and the latest plan text."""
    run_or = lambda c: F.bit_or(c).over(_w_run())
    over = (lambda c: F.col(c)) if folded else (lambda c: run_or(F.col(c)))
    st = st.select("*", *[F.array(*[over(f"{m}{k}") for k in range(n_chunks)]).alias(name)
                          for m, name in (("m_cd", "_cd"), ("m_mq", "_mq"), ("m_md", "_md"))])
    # Pairs with neither column dropped
    missed = F.size(F.filter("corr_pairs", lambda p: ~_bit(F.col("_cd"), p["a"]) & ~_bit(F.col("_cd"), p["b"])))
    # Per missing column: filled = quoted and some fill call; dropped
    idx = F.sequence(F.lit(0), F.size("miss_cols") - 1)
    idx = F.when(F.size("miss_cols") > 0, idx).otherwise(F.array().cast("array<int>"))
    filled = lambda i: _bit(F.col("_mq"), i) & F.col("miss_fill")
    dropped = lambda i: _bit(F.col("_md"), i)
    unhandled = F.size(F.filter(idx, lambda i: ~(filled(i) | dropped(i))))
    bad = F.size(F.filter(idx, lambda i: filled(i) & ~dropped(i)
                          & (F.element_at("miss_fracs", i + 1) > 0.80)))
    # Checklist coverage by the latest plan
    plan = F.lower(F.coalesce(F.col("plan_text"), F.lit("")))
    items = F.coalesce(F.col("checklist"), F.array().cast(
        "array<struct<item_idx:int,weight:double,required:boolean,keywords:array<string>>>"))
    cov = F.transform(items, lambda it: F.struct(
        it["weight"].alias("w"), it["required"].alias("r"),
        F.exists(it["keywords"], lambda kw: F.instr(plan, F.lower(kw)) > 0).alias("c")))
    return st.select(
        "*", missed.alias("corr_missed_pairs"), unhandled.alias("miss_unhandled"), bad.alias("miss_bad_strategy"),
        F.size(items).alias("task_items"),
        F.aggregate(cov, F.lit(0.0), lambda a, x: a + x["w"]).alias("plan_total_weight"),
        F.aggregate(cov, F.lit(0.0), lambda a, x: a + F.when(x["c"], x["w"]).otherwise(0.0)).alias("plan_covered_weight"),
        F.size(F.filter(cov, lambda x: ~x["c"] & x["r"])).alias("plan_missed_required"),
        F.size(F.filter(cov, lambda x: x["c"])).alias("plan_covered_items"),
    ).drop("_cd", "_mq", "_md")


def episode_code(steps: DataFrame, action_types: list[str] | None = None, success_only: bool = False) -> DataFrame:
    """Per episode the step texts joined by newline in step order.
    Feed it the kept steps (:func:`prepare_steps`), so every group holds at
    most max_steps + 1 rows."""
    s = steps
    if action_types:
        s = s.where(F.col("action_type").isin(*action_types))
    if success_only:
        s = s.where(F.col("execution_success"))
    txt = TR.step_text(F.col("code_body"), F.col("action_text")) if "text" not in s.columns else F.col("text")
    g = s.groupBy(EP).agg(F.array_sort(F.collect_list(F.struct(F.col(IDX).alias("i"), txt.alias("t")))).alias("_a"))
    return g.select(EP, F.array_join(F.transform("_a", lambda x: x["t"]), "\n").alias("code"))


def episode_state(state: DataFrame) -> DataFrame:
    """The state summary columns after each step."""
    return state.select(
        EP, IDX, (F.col(IDX) + 1).alias("current_step"), "max_steps", "has_plan", "fe_successes",
        "model_successes", F.col("metric_cf").alias("best_metric"),
        F.when(~F.col("ok"), F.col("error_message")).alias("last_error"),
        "repair_successes", "repair_attempts")
