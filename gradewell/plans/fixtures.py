"""Inputs derived from the driver tables.

Every registered query reads the driver's parquet tables, or one of the views
below that Spark derives from them, so its work grows with the tables. Each
view exists twice: as a DataFrame builder (what the library runs) and as a
DuckDB SQL text (what the oracle runs). Both keep every input row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradewell.sources.io import read_table

# ---------------------------------------------------------------------------
# dirty_events: a profiling dataset with nulls, duplicates, a correlated pair,
# outliers, a skewed column, a date-like string column. Target = event_type.
# ---------------------------------------------------------------------------

DIRTY_TARGET = "event_type"


def dirty_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    et = F.col("event_type")
    b = e.select(
        "event_id", "user_id", "event_type", "value",
        F.when(et == "error", None).otherwise(F.col("value")).alias("amount"),
        F.when((et == "purchase") & (F.col("value") > 50), F.col("value")).alias("mostly_null"),
        F.when(et.isin("view", "click", "signup"), None).otherwise(F.col("value")).alias("half_null"),
        (F.col("value") * 2 + F.col("user_id") % 3).alias("value2"),
        F.when(et == "signup", None).otherwise(F.col("props")).alias("props"),
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
    )
    # Low-value events are logged twice: exact duplicate rows by construction.
    return b.unionByName(b.where(F.col("value") < 5))


SQL_DIRTY_EVENTS = """
dirty_base AS (
  SELECT event_id, user_id, event_type, value,
    CASE WHEN event_type = 'error' THEN NULL ELSE value END AS amount,
    CASE WHEN event_type = 'purchase' AND value > 50 THEN value END AS mostly_null,
    CASE WHEN event_type IN ('view', 'click', 'signup') THEN NULL ELSE value END AS half_null,
    value * 2 + user_id % 3 AS value2,
    CASE WHEN event_type = 'signup' THEN NULL ELSE props END AS props,
    strftime(ts, '%Y-%m-%d') AS day
  FROM events),
dirty_events AS (
  SELECT * FROM dirty_base UNION ALL SELECT * FROM dirty_base WHERE value < 5)
"""

DIRTY_NUMERIC = ["event_id", "user_id", "value", "amount", "mostly_null", "half_null", "value2"]
DIRTY_CATEGORICAL = ["props", "day"]
DIRTY_FEATURES = ["event_id", "user_id", "value", "amount", "mostly_null", "half_null",
                  "value2", "props", "day"]

# ---------------------------------------------------------------------------
# Prediction tables (many runs per table; rows aligned by key, not position)
# ---------------------------------------------------------------------------


def binary_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a binary scorer: run = l_linestatus, y = returned, score = discount
    (many ties on purpose)."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_linestatus").alias("run_id"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"),
        (F.col("l_returnflag") == "R").cast("int").alias("y_true"),
        F.col("l_discount").alias("y_score"),
    )


SQL_BINARY_PREDICTIONS = """
binary_predictions AS (
  SELECT l_linestatus AS run_id, l_orderkey * 8 + l_linenumber AS row_id,
    CAST(l_returnflag = 'R' AS INTEGER) AS y_true, l_discount AS y_score
  FROM lineitem)
"""


def regression_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderstatus").alias("run_id"),
        F.col("o_orderkey").alias("row_id"),
        F.col("o_totalprice").alias("y_true"),
        (F.col("o_totalprice") * 0.9 + F.col("o_custkey") % 100).alias("y_pred"),
    )


SQL_REGRESSION_PREDICTIONS = """
regression_predictions AS (
  SELECT o_orderstatus AS run_id, o_orderkey AS row_id, o_totalprice AS y_true,
    o_totalprice * 0.9 + o_custkey % 100 AS y_pred
  FROM orders)
"""

N_CLASSES = 10


def multiclass_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as a 10-class scorer, long form: one row per (row, class).
    score = softmax over the sums of the embedding's dimensions i, i + 10, ..."""
    emb = read_table(spark, sf_dir, "embeddings")

    def of_class(c: int):
        mine = F.filter("embedding", lambda x, i: i % N_CLASSES == c)
        return F.aggregate(mine, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    folded = F.array(*[of_class(c) for c in range(N_CLASSES)])
    logits = F.transform(folded, lambda x: F.exp(x))
    total = F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + x)
    probs = F.transform(logits, lambda x: x / total)
    return (emb.select(F.lit("emb").alias("run_id"), F.col("vec_id").alias("row_id"),
                       F.col("label").alias("y_true"), probs.alias("proba"))
            .select("run_id", "row_id", "y_true", F.posexplode("proba").alias("class_idx", "score")))


SQL_MULTICLASS_SCORES = """
mc_exp AS (
  SELECT vec_id, label, c AS class_idx,
    exp(list_sum([CAST(embedding[i] AS DOUBLE) FOR i IN range(c + 1, len(embedding) + 1, 10)])) AS e
  FROM embeddings, range(0, 10) r(c)),
multiclass_scores AS (
  SELECT 'emb' AS run_id, vec_id AS row_id, label AS y_true, CAST(class_idx AS INTEGER) AS class_idx,
    e / sum(e) OVER (PARTITION BY vec_id) AS score
  FROM mc_exp)
"""


def multiclass_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard label per row = argmax class (ties: lowest class)."""
    s = multiclass_scores(spark, sf_dir)
    return (s.groupBy("run_id", "row_id", "y_true")
            .agg(F.min_by("class_idx", F.struct(-F.col("score"), F.col("class_idx"))).alias("y_pred")))


SQL_MULTICLASS_PREDICTIONS = SQL_MULTICLASS_SCORES + """,
multiclass_predictions AS (
  SELECT run_id, row_id, y_true, arg_min(class_idx, (-score, class_idx)) AS y_pred
  FROM multiclass_scores GROUP BY run_id, row_id, y_true)
"""

# ---------------------------------------------------------------------------
# Episode step log derived from events: one episode = one user and one 6-day
# period; the action, outcome, code and error texts are rules of the event.
# ---------------------------------------------------------------------------

# The texts of the synthetic step log, one per event_id % their
# number. Together they give every text rule cases for and against it.
STEP_CODE_TEXTS = [
    "model = RandomForestClassifier(n_estimators=100, random_state=42)\nmodel.fit(X, y)",
    "df = df.dropna()",
    "print(train_df.describe())",
    "clf.fit(test_df, y)",
    "GridSearchCV(m, g, cv=5).fit(X, y)",
    "a, b = train_test_split(X, test_size=0.05, shuffle=True)",
    "df.drop(columns=['value2'])",
    "X_train['Survived'] = X_train['label']\nfeatures['price'].mean()\nX['churn'] + X['sales']",
    "y = X.pop('sales')\nprint(corr.corrwith(y))",
    "high = df.corr().abs()\nsns.heatmap(high)",
    "df['amount'] = df['amount'].fillna(df['amount'].median())\ndf['half_null'] = df['half_null'].fillna(0)",
    "df = df.drop('mostly_null', axis=1)\ndf = df.drop(columns=['amount', 'half_null', 'props'])",
    "df['mostly_null'] = df['mostly_null'].fillna(0)",
    "Z = PCA(n_components=3).fit_transform(X)",
    "lo, hi = df['value'].quantile([0.01, 0.99])\ndf['value'] = df['value'].clip(lo, hi)",
    "df = df.drop_duplicates()\nassert not df.duplicated().any()",
    "order = np.argsort(forest.feature_importances_)[::-1]",
    "booster = GradientBoostingRegressor(n_estimators=1, learning_rate=3.5)\nbooster.fit(X, y)",
    "t = ExtraTreesRegressor(n_estimators=4, max_depth=None).fit(X, y)\nu = Forest(max_depth=75)",
    "net = nn.Sequential(nn.Linear(8, 1))\nnet.fit(X, y)",
    "class Mean:\n    def fit(self, X, y):\n        return self\nMean().fit(X, y)",
    "from sklearn.ensemble import StackingClassifier\nstack = StackingClassifier(parts)\nstack.fit(X, y)",
    "for f, (i, j) in enumerate(TimeSeriesSplit(4).split(X)):\n    score(i, j)",
    "p, q = train_test_split(rows, test_size=0.3, shuffle=False)\ncross_val_score(m, p, cv=3)",
    "tr, va = train_test_split(X, y, stratify=y, test_size=0.75)\nnp.random.seed(7)",
    "Plan: look for correlated columns, impute what is missing, explore distributions, treat outliers and "
    "duplicates, then rank by importance",
    "strategy: forecast month by month with a temporal holdout",
    "best = RandomizedSearchCV(est, param_dist, random_state=0).fit(X, y)",
    "pipeline = make_pipeline(scale, Ridge(alpha=0.5))\npipeline.fit(train_df, y)",
]
# Error messages of failed steps, one per (event_id / 5) % their number.
STEP_ERRORS = [
    "KeyError: 'Age'",
    "SyntaxError: invalid syntax",
    "Execution timed out after 60s",
    "ZeroDivisionError: division by zero",
    "ModuleNotFoundError: No module named 'fastai'",
    "ImportError: this module is forbidden",
    "NameError: name 'frame' is not defined",
    "AttributeError: 'NoneType' object has no attribute 'fit'",
    "TypeError: unsupported operand",
    "ValueError: could not convert string to float",
]
# Events whose id is divisible by this hand in the episode.
SUBMIT_EVERY = 31
# event_type -> action type.
ACTION_OF_EVENT = {"signup": "PLAN", "view": "FEATURE_ENGINEERING", "click": "CODE",
                   "purchase": "MODEL"}


def _case_literal(col, mapping: list[str]):
    expr = None
    for i, text in enumerate(mapping):
        expr = (F.when(col == i, F.lit(text)) if expr is None
                else expr.when(col == i, F.lit(text)))
    return expr


def _sql_case(expr: str, texts: list[str]) -> str:
    whens = " ".join("WHEN {} THEN '{}'".format(i, t.replace("'", "''")) for i, t in enumerate(texts))
    return f"CASE {expr} {whens} END"


def steps_from_events(e: DataFrame) -> DataFrame:
    """The stateless part of the step log (works on a stream too): one row
    per event; even events wrap their code in a fenced block inside the raw
    action text."""
    eid = F.col("event_id")
    action = F.lit("CODE_FIX")
    for ev, act in reversed(list(ACTION_OF_EVENT.items())):
        action = F.when(F.col("event_type") == ev, F.lit(act)).otherwise(action)
    action = F.when(eid % SUBMIT_EVERY == 0, F.lit("FINAL_SUBMIT")).otherwise(action)
    code = _case_literal(eid % len(STEP_CODE_TEXTS), STEP_CODE_TEXTS)
    base = e.select(
        "event_id", "ts",
        (F.col("user_id") * 10 + F.floor((F.dayofmonth("ts") - 1) / 6).cast("bigint")).alias("episode_id"),
        action.alias("action_type"),
        (eid % 5 != 0).alias("execution_success"),
        code.alias("code_body"),
        F.when(eid % 5 != 0, None).otherwise(
            _case_literal(F.floor(eid / 5) % len(STEP_ERRORS), STEP_ERRORS)).alias("error_message"),
        F.when(eid % 3 == 0, F.col("value") / 100).alias("metric_value"),
    )
    header = F.concat(F.lit("ACTION: "), F.col("action_type"), F.lit("\n"))
    return base.select(
        "*", F.when(eid % 2 == 0, F.concat(header, F.lit("```python\n"), F.col("code_body"), F.lit("\n```")))
        .otherwise(F.concat(header, F.col("code_body"))).alias("action_text"),
        F.pmod(F.floor(F.col("episode_id") / 10), F.lit(5)).cast("int").alias("task_key"))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the table checks found for each episode, from its events: rows
    without a prediction, non-finite ones, changed inputs, a model's metric,
    missing cells (errors have no amount), rows logged twice, leaks."""
    e = read_table(spark, sf_dir, "events")
    eid, some = F.col("event_id"), lambda c: F.count(F.when(c, 1))
    return steps_from_events(e).select("event_id", "episode_id").join(
        e.select("event_id", "event_type", "value"), "event_id").groupBy("episode_id").agg(
        some(eid % 97 != 0).alias("n_predictions"), F.count(F.lit(1)).alias("n_expected"),
        some(eid % 89 == 0).alias("n_non_finite"), (some(eid % 61 == 0) == 0).alias("intact"),
        F.avg(F.when(F.col("event_type") == "purchase", F.floor("value") / 101)).alias("model_metric"),
        (some(F.col("event_type") == "error") > 0).alias("pipeline_issues"),
        F.when(some(F.col("event_type") == "error") > 0, 0.12).otherwise(0.0).alias("pipeline_penalty"),
        some(F.col("value") < 5).alias("remaining_duplicates"), some(eid % 53 == 0).alias("leak_features"),
        (F.max("value") - F.min("value") > 95).alias("overfit"))


def step_outcomes(spark: SparkSession, sf_dir: str, log: DataFrame | None = None) -> DataFrame:
    """The table checks' findings as a change log: what holds for the whole
    episode (no step), and what a step changed. ``log``: :func:`steps`, if it is there already."""
    eid = F.col("event_id")
    n = lambda k, r, v: F.when(eid % k == r, v)
    log = steps(spark, sf_dir) if log is None else log
    changed = log.select(
        "episode_id", "step_idx", n(7, 3, (eid % 40) / 100).alias("row_loss"), n(11, 5, (eid % 30) / 100).alias("valid_frac"),
        n(13, 4, eid % 2 == 0).alias("predictions_match"), n(17, 6, (eid % 21 - 10) / 100).alias("model_value"),
        n(19, 2, eid % 3).alias("new_top_features"))
    whole = outcomes(spark, sf_dir).withColumn("step_idx", F.lit(0))
    return whole.unionByName(changed, allowMissingColumns=True)


def artifacts(spark: SparkSession, sf_dir: str, log: DataFrame | None = None) -> DataFrame:
    """The artifact log: what some steps left behind, under changing names. ``log``: as above."""
    eid = F.col("event_id")
    name = F.element_at(F.array(*[F.lit(x) for x in ARTIFACT_NAMES]), (eid % len(ARTIFACT_NAMES) + 1).cast("int"))
    log = steps(spark, sf_dir) if log is None else log
    return log.where(eid % 3 == 1).select(
        "episode_id", "step_idx", name.alias("name"), (eid % 4 != 0).alias("has_predict"),
        F.when(eid % 2 == 0, 1).otherwise(0).alias("non_numeric_columns"))


ARTIFACT_NAMES = ["clf", "X_train", "model", "notes", "pipeline"]

SQL_STEP_FACTS = """
facts AS (SELECT *, CASE WHEN event_id % 3 = 1 THEN ['clf', 'X_train', 'model', 'notes', 'pipeline'][event_id % 5 + 1] END AS art FROM state),
latest AS (SELECT episode_id, step_idx,
    last_value(CASE WHEN event_id % 7 = 3 THEN (event_id % 40) / 100.0 END IGNORE NULLS) OVER w AS row_loss,
    last_value(CASE WHEN event_id % 11 = 5 THEN (event_id % 30) / 100.0 END IGNORE NULLS) OVER w AS valid_frac,
    last_value(CASE WHEN event_id % 13 = 4 THEN event_id % 2 = 0 END IGNORE NULLS) OVER w AS predictions_match,
    last_value(CASE WHEN event_id % 17 = 6 THEN (event_id % 21 - 10) / 100.0 END IGNORE NULLS) OVER w AS model_value,
    last_value(CASE WHEN event_id % 19 = 2 THEN event_id % 3 END IGNORE NULLS) OVER w AS new_top_features,
    last_value(CASE WHEN art = 'X_train' THEN event_id % 2 <> 0 END IGNORE NULLS) OVER w AS art_table,
    coalesce(last_value(CASE WHEN art = 'model' THEN event_id % 4 <> 0 END IGNORE NULLS) OVER w,
             last_value(CASE WHEN art = 'clf' THEN event_id % 4 <> 0 END IGNORE NULLS) OVER w,
             last_value(CASE WHEN art = 'pipeline' THEN event_id % 4 <> 0 END IGNORE NULLS) OVER w) AS art_predict
  FROM facts WINDOW w AS (PARTITION BY episode_id ORDER BY step_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
"""

SQL_OUTCOMES = """
outcomes AS (
  SELECT user_id * 10 + CAST(floor((extract(day FROM ts) - 1) / 6) AS BIGINT) AS episode_id,
    count(*) FILTER (WHERE event_id % 97 <> 0) AS n_predictions, count(*) AS n_expected,
    count(*) FILTER (WHERE event_id % 89 = 0) AS n_non_finite, count(*) FILTER (WHERE event_id % 61 = 0) = 0 AS intact,
    avg(CASE WHEN event_type = 'purchase' THEN floor(value) / 101 END) AS model_metric,
    count(*) FILTER (WHERE event_type = 'error') > 0 AS pipeline_issues,
    CASE WHEN count(*) FILTER (WHERE event_type = 'error') > 0 THEN 0.12 ELSE 0.0 END AS pipeline_penalty,
    count(*) FILTER (WHERE value < 5) AS remaining_duplicates, count(*) FILTER (WHERE event_id % 53 = 0) AS leak_features,
    max(value) - min(value) > 95 AS overfit
  FROM events GROUP BY 1)
"""


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The step log with its 0-based step index per episode."""
    from gradewell.operators.episodes import step_index
    base = steps_from_events(read_table(spark, sf_dir, "events"))
    # E1 over every step; a user holding a third of all events must not put
    # one episode's rows through one task: range-partitioned row numbers of the
    # three key columns, joined back to the texts
    number = step_index(base.select("episode_id", "ts", "event_id"), ("ts", "event_id"), skew_safe=True)
    numbered = base.join(number.select("event_id", "step_idx"), "event_id")
    return numbered.select(
        "episode_id", "step_idx", "event_id", "ts", "action_type", "action_text", "execution_success",
        "code_body", "error_message", "metric_value", "task_key")


SQL_STEPS = """
steps AS (
  SELECT episode_id,
    CAST(row_number() OVER (PARTITION BY episode_id ORDER BY ts, event_id) - 1 AS INTEGER) AS step_idx,
    event_id, ts, action_type,
    'ACTION: ' || action_type || chr(10) || CASE WHEN event_id % 2 = 0
      THEN '```python' || chr(10) || code_body || chr(10) || '```' ELSE code_body END AS action_text,
    execution_success, code_body,
    CASE WHEN NOT execution_success THEN """ + _sql_case(f"(event_id // 5) % {len(STEP_ERRORS)}", STEP_ERRORS) + """ END AS error_message,
    CASE WHEN event_id % 3 = 0 THEN value / 100 END AS metric_value,
    CAST((episode_id // 10) % 5 AS INTEGER) AS task_key
  FROM (SELECT *, user_id * 10 + CAST(floor((extract(day FROM ts) - 1) / 6) AS BIGINT) AS episode_id,
      CASE WHEN event_id % """ + str(SUBMIT_EVERY) + """ = 0 THEN 'FINAL_SUBMIT' WHEN event_type = 'signup' THEN 'PLAN'
        WHEN event_type = 'view' THEN 'FEATURE_ENGINEERING' WHEN event_type = 'click' THEN 'CODE'
        WHEN event_type = 'purchase' THEN 'MODEL' ELSE 'CODE_FIX' END AS action_type,
      event_id % 5 <> 0 AS execution_success,
      """ + _sql_case(f"event_id % {len(STEP_CODE_TEXTS)}", STEP_CODE_TEXTS) + """ AS code_body
    FROM events) e)
"""

# ---------------------------------------------------------------------------
# Tasks: one per region row. An episode's task is pmod(user_id, 5). Budgets
# are 1..5 days (the log spans a month); the scoring's hard limit is 4 days.
# ---------------------------------------------------------------------------

# Per region key -> (task_type, metric, target, baseline, oracle,
# time series flag). Chosen to cover every branch of the scoring rules.
TASK_SPECS = [
    ("binary_classification", "roc_auc", "Survived", 0.5, 0.87, False),
    ("multiclass_classification", "f1", "label", 0.3, 0.8, False),
    ("regression", "rmse", "price", None, None, True),
    ("binary_classification", "accuracy", "churn", 0.6, 0.6, False),
    ("regression", "r2", "sales", 0.2, 0.9, False),
]
# This task names its time column instead of the flag.
TIME_COLUMN_TASK = 4
# The plan checklist; task k carries the first k items.
CHECKLIST = [
    ("missing", "handle missing values", ["dropna", "fillna", "missing"], 1.0, True),
    ("eda", "explore the data", ["describe", "eda"], 1.0, False),
    ("model", "train a model", ["randomforest", "fit(", "model"], 2.0, True),
    ("validation", "validate properly", ["train_test_split", "cv=", "cross"], 1.0, False),
]

CHECKLIST_TYPE = T.ArrayType(T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("keywords", T.ArrayType(T.StringType())),
    T.StructField("weight", T.DoubleType()),
    T.StructField("required", T.BooleanType()),
]))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task table derived from region: the 13 task fields of the reference."""
    r = read_table(spark, sf_dir, "region")
    k = F.col("r_regionkey")

    def pick(i):
        expr = None
        for key, spec in enumerate(TASK_SPECS):
            v = F.lit(spec[i])
            expr = F.when(k == key, v) if expr is None else expr.when(k == key, v)
        return expr

    items = [F.struct(F.lit(i).alias("id"), F.lit(d).alias("description"),
                      F.array(*[F.lit(w) for w in kws]).alias("keywords"),
                      F.lit(wt).cast("double").alias("weight"), F.lit(req).alias("required"))
             for i, d, kws, wt, req in CHECKLIST]
    checklist = F.filter(
        F.array(*[F.struct(F.lit(n).alias("n"), it.alias("item")) for n, it in enumerate(items)]),
        lambda x: x["n"] < k)
    checklist = F.transform(checklist, lambda x: x["item"]).cast(CHECKLIST_TYPE)
    return r.select(
        F.lower("r_name").alias("task_id"),
        F.lit("dirty_events").alias("dataset_path"),
        pick(2).alias("target_column"),
        pick(0).alias("task_type"),
        pick(1).alias("metric"),
        F.concat(F.lit("Predict the target for region "), F.col("r_name")).alias("description"),
        checklist.alias("plan_checklist"),
        F.lit(None).cast(T.ArrayType(T.StringType())).alias("feature_columns"),
        (F.lit(86400.0) * (k + 1)).alias("time_budget_seconds"),
        F.lit(15).alias("max_steps"),
        pick(4).cast("double").alias("oracle_score"),
        pick(3).cast("double").alias("baseline_score"),
        F.when(k == TIME_COLUMN_TASK, F.create_map(F.lit("time_column"), F.lit("day"))).otherwise(F.create_map(
            F.lit("is_time_series"), F.when(pick(5), F.lit("true")).otherwise(F.lit("false")))).alias("metadata"),
        k.cast("int").alias("task_key"),
    )


def _sql_opt(v):
    return "NULL" if v is None else repr(float(v))


SQL_TASKS = "tasks AS (\n  SELECT lower(r_name) AS task_id, r_regionkey AS task_key,\n" + "".join(
    f"    CASE r_regionkey {' '.join(f'WHEN {i} THEN {v}' for i, v in enumerate(vals))} END AS {name},\n"
    for name, vals in [
        ("task_type", [f"'{s[0]}'" for s in TASK_SPECS]),
        ("metric", [f"'{s[1]}'" for s in TASK_SPECS]),
        ("target_column", [f"'{s[2]}'" for s in TASK_SPECS]),
        ("baseline_score", [f"CAST({_sql_opt(s[3])} AS DOUBLE)" for s in TASK_SPECS]),
        ("oracle_score", [f"CAST({_sql_opt(s[4])} AS DOUBLE)" for s in TASK_SPECS]),
        ("is_time_series", ["true" if s[5] or i == TIME_COLUMN_TASK else "false" for i, s in enumerate(TASK_SPECS)]),
    ]) + "    CAST(86400.0 * (r_regionkey + 1) AS DOUBLE) AS time_budget_seconds, 15 AS max_steps\n  FROM region)\n"

SQL_CHECKLIST = "checklist AS (SELECT * FROM (VALUES " + ", ".join(
    f"({n}, '{i}', '{kw}', CAST({wt} AS DOUBLE), {str(req).lower()})"
    for n, (i, _d, kws, wt, req) in enumerate(CHECKLIST) for kw in kws
) + ") v(item_idx, item_id, keyword, weight, required))\n"

SQL_EXPLODED_CHECKLIST = SQL_TASKS + ", " + SQL_CHECKLIST + """,
exploded_checklist AS (
  SELECT t.task_id, c.item_idx, c.item_id, c.keyword, c.weight, c.required
  FROM tasks t JOIN checklist c ON c.item_idx < t.task_key)
"""


def steps_with_task(spark: SparkSession, sf_dir: str, log: DataFrame | None = None) -> DataFrame:
    """Step log with its task id. ``log``: as above."""
    t = tasks(spark, sf_dir).select("task_key", "task_id")
    log = steps(spark, sf_dir) if log is None else log
    return log.join(t, "task_key").drop("task_key")


SQL_STEPS_WITH_TASK = SQL_STEPS + ", " + SQL_TASKS + """,
steps_with_task AS (
  SELECT s.* EXCLUDE (task_key), t.task_id FROM steps s JOIN tasks t ON t.task_key = s.task_key)
"""


def ctes(*blocks: str) -> str:
    """``WITH b1, b2, ...`` from CTE blocks (``name AS (...)``)."""
    return "WITH " + ",\n".join(b.strip().strip(",") for b in blocks) + "\n"


def with_views(body: str, *views: str) -> str:
    """Prefix DuckDB SQL with the named CTE blocks."""
    return ctes(*views) + body


# ---------------------------------------------------------------------------
# processed_events: dirty_events after a typical feature pipeline (median fill
# of amount, two columns dropped, one added). Leaves nulls in half_null and an
# unencoded string column on purpose.
# ---------------------------------------------------------------------------


def processed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gradewell.operators.profile import impute_fill
    d = dirty_events(spark, sf_dir)
    filled = impute_fill(d, d, ["amount"])
    return filled.drop("mostly_null", "day").withColumn("value_log", F.log(1 + F.col("value")))


SQL_PROCESSED_EVENTS = SQL_DIRTY_EVENTS + """,
processed_events AS (
  SELECT event_id, user_id, event_type, value, coalesce(amount, (SELECT median(amount) FROM dirty_events)) AS amount,
    half_null, value2, props, ln(1 + value) AS value_log
  FROM dirty_events)
"""
PROCESSED_FEATURES = ["event_id", "user_id", "value", "amount", "half_null", "value2", "props", "value_log"]

# Hard time limit used when scoring the fixture log (the rule's parameter).
HARD_TIME_LIMIT = 4 * 86400.0
