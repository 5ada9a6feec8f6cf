"""Step-text rules (T1-T7, T9-T11, T14, T16-T21) as ``Column -> Column``
functions, JVM-side (``rlike`` / ``regexp_*``), no Python UDF.

Patterns are written once in Python ``re`` syntax with their flags and
rendered per engine: Java (Spark) gets ``(?dU...)`` so ``.``/``$`` treat only
``\\n`` as a line end and ``\\w``/``\\b``/``\\s`` are Unicode as in Python;
RE2 (DuckDB oracle) gets only ``i``/``s``/``m``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_char_check(pattern: str) -> str:
    """A look-ahead for the characters an alternation can begin with, so that Java tries its
    alternatives only where one of them can match; empty unless there are three or more and
    each begins with a plain character."""
    inner, depth, parts, i = pattern, 0, [""], 0
    if re.fullmatch(r"\((?!\?)(?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)", pattern, re.S):
        inner = pattern[1:-1]
    while i < len(inner):
        token = inner[i:i + 2] if inner[i] == "\\" else inner[i]
        depth += (token in "([") - (token in ")]")
        if token == "|" and not depth:
            parts.append("")
        else:
            parts[-1] += token
        i += len(token)
    first = [re.match(r"(?:\\(\W)|([^\W\d_]))(?![?*{])", p) for p in parts]
    if len(parts) < 3 or not all(first):
        return ""
    return "(?=[" + "".join(dict.fromkeys(m[2] or "\\" + m[1] for m in first)) + "])"


@dataclass(frozen=True)
class Rx:
    pattern: str
    flags: str = ""          # subset of "ism" (ignore case, dot-all, multi-line)

    def java(self) -> str:
        f = "dU" + "".join(ch for ch in "ism" if ch in self.flags)
        return f"(?{f}){first_char_check(self.pattern)}{self.pattern}"

    def re2(self) -> str:
        f = "".join(ch for ch in "ism" if ch in self.flags)
        return (f"(?{f})" if f else "") + self.pattern


def rx_match(col: Column, rx: Rx) -> Column:
    """Python ``re.search`` truth value (null text -> false)."""
    return F.coalesce(col.rlike(rx.java()), F.lit(False))


def rx_count(col: Column, rx: Rx) -> Column:
    """Number of non-overlapping matches (``len(re.findall)``)."""
    return F.coalesce(F.regexp_count(col, F.lit(rx.java())), F.lit(0))


def sql_match(expr: str, rx: Rx) -> str:
    """DuckDB spelling of :func:`rx_match` for oracle SQL."""
    return f"coalesce(regexp_matches({expr}, {sql_str(rx.re2())}), false)"


def sql_count(expr: str, rx: Rx) -> str:
    return f"coalesce(len(regexp_extract_all({expr}, {sql_str(rx.re2())})), 0)"


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ===========================================================================
# Patterns, keyword lists and categories that must equal the
# reference's for identical verdicts. Kept in the reference's order.
# ===========================================================================

ACTION_TYPES = ["PLAN", "FEATURE_ENGINEERING", "MODEL", "CODE", "CODE_FIX", "FINAL_SUBMIT"]

ACTION_HEADER = Rx(r"^\s*ACTION\s*:\s*(PLAN|FEATURE_ENGINEERING|MODEL|CODE|CODE_FIX|FINAL_SUBMIT)\s*$", "im")
CODE_BLOCK = Rx(r"```(?:python)?\s*\n(.*?)```", "s")

HEURISTIC_KEYWORDS = {
    "PLAN": ["plan:", "objective:", "strategy:", "approach:", "steps:",
             "шаг 1", "step 1", "pipeline:", "plan\n"],
    "FEATURE_ENGINEERING": ["standardscaler", "targetencod", "onehotencod", "labelencod",
                            "fillna", "imputer", "add_feature", "drop_column", "feature",
                            "transform", "polynomial", "interaction"],
    "MODEL": ["lightgbm", "xgboost", "catboost", "randomforest",
              "logisticregression", "linearregression", "model",
              ".fit(", ".predict(", "gridsearch", "hyperparameter"],
    "CODE_FIX": ["fix", "исправ", "ошибк", "error", "traceback", "bug"],
    "FINAL_SUBMIT": ["final_submit", "submit", "финальн"],
}

ERROR_CLASSES = [
    (Rx(r"SyntaxError", "i"), "syntax_error"),
    (Rx(r"ModuleNotFoundError|No module named", "i"), "module_not_found"),
    (Rx(r"ImportError.*forbidden", "i"), "module_not_found"),
    (Rx(r"KeyError", "i"), "key_error"),
    (Rx(r"NameError", "i"), "name_error"),
    (Rx(r"AttributeError", "i"), "attribute_error"),
    (Rx(r"TypeError", "i"), "type_error"),
    (Rx(r"ValueError", "i"), "value_error"),
    (Rx(r"timed out|Timeout", "i"), "timeout"),
]

LEAKAGE = [
    Rx(r"\btest_df\b"),
    Rx(r"\.fit\s*\(.*(?:valid_df|test_df)", "i"),
    Rx(r"\.fit_transform\s*\(.*(?:valid_df|test_df)", "i"),
]
TARGET_AS_FEATURE_PREFIX = r"(?:X_train|X_val|X_test|features)\s*\[.*['\"]"
TARGET_AS_FEATURE_SUFFIX = r"['\"]\]"
TARGET_SAFE_OPS = Rx(r"(\.drop\s*\(|\.pop\s*\(|\.remove\s*\(|y\s*=\s*.*\[)")

BASIC_OPS = Rx(r"(\.drop\(|\.dropna\(|\.fillna\(|\.replace\(|\.rename\(|"
               r"\.astype\(|del\s+\w|\.pop\(|\.remove\()", "i")
MODEL_FIT_STRICT = Rx(r"\.fit\(", "i")          # backtracking
FIT_PLAIN = Rx(r"\.fit\(")                       # reproducibility
FIT_SPACED = Rx(r"\.fit\s*\(")                  # session cycles, hyperparams, choice, split

SEED = Rx(r"(random_state\s*=|seed\s*=|np\.random\.seed\(|random\.seed\(|"
          r"torch\.manual_seed\(|set_seed\(|SEED\s*=)", "i")

GRIDSEARCH = Rx(r"(GridSearchCV|GridSearch|ParameterGrid|"
                r"itertools\.product.*param|"
                r"for\s+\w+\s+in\s+\[.*\]\s*:\s*\n.*\.fit\()", "is")
EFFICIENT_SEARCH = Rx(r"(RandomizedSearchCV|BayesSearchCV|Optuna|optuna|HalvingGridSearchCV)", "i")

CORR_CODE = Rx(r"\.corr\s*\(|corrwith|correlation|heatmap|VIF|vif|variance_inflation", "i")
CORR_PLAN = Rx(r"(correlat|коррел|multicoll|мультиколлин|VIF|collinear)", "i")
PCA = Rx(r"(PCA|pca|principal.component|decomposition)", "i")
DROP_CALL = r"\.drop\s*\(.*['\"]"

FILL = Rx(r"(\.fillna\(|\.fill\(|SimpleImputer|KNNImputer|IterativeImputer|"
          r"\.interpolate\(|\.bfill\(|\.ffill\(|imputer|impute)", "i")
DROPNA = Rx(r"\.dropna\s*\(", "i")
MISSING_PLAN = Rx(r"(missing|пропус|null|nan|fillna|imput|dropna|недостающ)", "i")

EDA = Rx(r"(\.describe\s*\(|\.hist\s*\(|\.plot\s*\(|\.boxplot\s*\(|"
         r"\.value_counts\s*\(|\.info\s*\(|\.skew\s*\(|\.kurt\s*\(|"
         r"sns\.|seaborn|matplotlib|\.nunique\s*\(|\.dtype|\.shape|"
         r"\.isnull\(\)\.sum|\.isna\(\)\.sum|\.profile_report|"
         r"pandas_profiling|ydata_profiling)", "i")
EDA_PLAN = Rx(r"(EDA|explor|исследов|анализ.данн|distribut|распредел|статистик|describe|"
              r"визуализ|visualiz|overview|обзор)", "i")
OUTLIER_HANDLING = Rx(r"(\.clip\s*\(|IQR|iqr|z.?score|zscore|winsoriz|"
                      r"RobustScaler|quantile.*filter|percentile|"
                      r"outlier|выброс|remove_outlier|clip_outlier|"
                      r"LocalOutlierFactor|IsolationForest|isolation_forest)", "i")
OUTLIER_PLAN = Rx(r"(outlier|выброс|аномал|anomal|clip|robust|IQR|iqr|winsor)", "i")
SIGNIFICANT_OUTLIER_FRAC = 0.05

DEDUP_CODE = Rx(r"(drop_duplicates|duplicated\(\)|\.unique\(\)|дубл|duplicate)", "i")
DEDUP_PLAN = Rx(r"(duplicate|дубл|дубликат|dedup|повтор|одинаков)", "i")

IMPORTANCE = Rx(r"(feature_importances_|permutation_importance|\.coef_|"
                r"shap\.|SHAP|eli5|\.feature_importance|plot_importance|"
                r"важност|importance|feature.ranking)", "i")

HYPERPARAM_SET = Rx(r"(n_estimators\s*=|max_depth\s*=|learning_rate\s*=|"
                    r"n_neighbors\s*=|C\s*=|alpha\s*=|gamma\s*=|"
                    r"num_leaves\s*=|min_samples_split\s*=|min_samples_leaf\s*=|"
                    r"subsample\s*=|colsample_bytree\s*=|reg_alpha\s*=|reg_lambda\s*=|"
                    r"max_features\s*=|min_child_weight\s*=|epochs\s*=|batch_size\s*=)", "i")
BAD_PARAMS = [
    Rx(r"n_estimators\s*=\s*1\b"),
    Rx(r"max_depth\s*=\s*None\b"),
    Rx(r"n_estimators\s*=\s*[2-5]\b"),
    Rx(r"learning_rate\s*=\s*[1-9]\d*\.?\d*"),
    Rx(r"max_depth\s*=\s*[5-9]\d+"),
]
TUNING = Rx(r"(GridSearchCV|RandomizedSearchCV|BayesSearchCV|Optuna|optuna|"
            r"HalvingGridSearchCV|cross_val_score|param_grid|param_dist|"
            r"hyperopt|tune|tuning|hyperparameter)", "i")

ANN = Rx(r"(torch\.nn|nn\.Module|nn\.Linear|nn\.Sequential|"
         r"keras\.|tensorflow\.|tf\.keras|Dense\(|Conv[12]d\(|LSTM\(|"
         r"MLPClassifier|MLPRegressor|neural.net)", "i")
GOOD_TABULAR = Rx(r"(RandomForest|GradientBoosting|XGB|LightGBM|lgb\.|CatBoost|"
                  r"ExtraTrees|AdaBoost|LogisticRegression|LinearRegression|"
                  r"Ridge|Lasso|ElasticNet|SVM|SVC|SVR|KNeighbors|"
                  r"DecisionTree|BaggingClassifier|BaggingRegressor|"
                  r"VotingClassifier|VotingRegressor|StackingClassifier|StackingRegressor|"
                  r"HistGradientBoosting)", "i")
ENSEMBLE = Rx(r"(VotingClassifier|VotingRegressor|StackingClassifier|StackingRegressor|"
              r"ensemble|blending|stacking|averaging.*model)", "i")
CUSTOM_MODEL = Rx(r"(class\s+\w+.*:\s*\n.*def\s+(predict|forward|fit)\b)", "s")
LIBRARY_IMPORT = Rx(r"(from\s+sklearn|import\s+sklearn|from\s+xgboost|from\s+lightgbm|"
                    r"from\s+catboost|import\s+xgboost|import\s+lightgbm|import\s+catboost)", "i")

CV = Rx(r"(cross_val_score|KFold|StratifiedKFold|RepeatedKFold|"
        r"RepeatedStratifiedKFold|LeaveOneOut|ShuffleSplit|"
        r"GroupKFold|cross_validate|\.cv\s*=|cv\s*=\s*\d)", "i")
TIMESERIES_SPLIT = Rx(r"(TimeSeriesSplit|time_series_split|expanding.*window|"
                      r"rolling.*window|walk.forward)", "i")
SHUFFLE_TRUE = Rx(r"shuffle\s*=\s*True", "i")
SHUFFLE_FALSE = Rx(r"shuffle\s*=\s*False", "i")
STRATIFY = Rx(r"stratif", "i")
TEST_SIZE = Rx(r"test_size\s*=\s*([\d.]+)")
TIMESERIES_HINTS = Rx(r"(time.?series|temporal|дата|date|timestamp|time_col|"
                      r"datetime|year|month|day|period|forecast)", "i")

# artifact names a model may be stored under
MODEL_NAMES = ["model", "clf", "classifier", "regressor", "estimator", "pipeline"]
MODEL_ASSIGN = Rx(r"\b(model|clf|classifier|regressor|estimator|pipeline)\s*=[^=]")

# ===========================================================================
# Column functions
# ===========================================================================


def strip(col: Column) -> Column:
    """Python ``str.strip()`` (Unicode whitespace)."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def step_text(code_body: Column, action_text: Column) -> Column:
    """The code a rule reads: the body, or the raw action text if empty."""
    return F.when(F.coalesce(code_body, F.lit("")) != "", code_body).otherwise(F.coalesce(action_text, F.lit("")))


def extract_code_block(text: Column) -> Column:
    """Content of the first fenced code block, stripped; null if none."""
    return F.when(rx_match(text, CODE_BLOCK), strip(F.regexp_extract(text, CODE_BLOCK.java(), 1)))


def guess_action(text: Column) -> Column:
    """Keyword votes per action type over the lower-cased text; most votes
    wins, ties by the enum order; no vote -> CODE."""
    low = F.lower(text)
    scores = {t: sum((F.when(F.instr(low, kw.lower()) > 0, 1).otherwise(0) for kw in kws), F.lit(0))
              for t, kws in HEURISTIC_KEYWORDS.items()}
    best = F.greatest(*scores.values())
    expr = F.when(best <= 0, F.lit("CODE"))
    for t in ACTION_TYPES:
        if t in scores:
            expr = expr.when(scores[t] == best, F.lit(t))
    return expr.otherwise(F.lit("CODE"))


def parse_action(text: Column) -> Column:
    """struct(action_type, body). Header ``ACTION: <TYPE>`` on its own
    line (any case); the body is the stripped text after it, replaced by the
    first fenced code block inside it. No header but a code block -> CODE
    with the block; else a keyword guess with the whole text."""
    t = strip(text)
    header = Rx(ACTION_HEADER.pattern + r"((?s:.*))", "im")
    has_header = rx_match(t, ACTION_HEADER)
    after = strip(F.regexp_extract(t, header.java(), 2))
    body_hdr = F.coalesce(extract_code_block(after), after)
    block = extract_code_block(t)
    action = (F.when(has_header, F.upper(F.regexp_extract(t, header.java(), 1)))
              .when(block.isNotNull(), F.lit("CODE"))
              .otherwise(guess_action(t)))
    body = F.when(has_header, body_hdr).when(block.isNotNull(), block).otherwise(t)
    return F.struct(action.alias("action_type"), body.alias("body"))


def strip_thought(text: Column) -> Column:
    """T4: the text after the first ``Action:`` (case sensitive), stripped;
    the whole text when there is none."""
    rx = Rx(r"Action:\s*(.*)", "s")
    return F.when(rx_match(text, rx), strip(F.regexp_extract(text, rx.java(), 1))).otherwise(text)


def classify_error(msg: Column) -> Column:
    """T5: crash category of an error message (first matching class, any
    case); empty -> none; no match -> other."""
    expr = F.when(msg.isNull() | (msg == ""), F.lit("none"))
    for rx, cat in ERROR_CLASSES:
        expr = expr.when(rx_match(msg, rx), F.lit(cat))
    return expr.otherwise(F.lit("other"))


def leak_issues(text: Column) -> Column:
    """Indexes (0-based) of the leakage patterns the text matches."""
    return F.filter(F.array(*[F.when(rx_match(text, rx), F.lit(i)) for i, rx in enumerate(LEAKAGE)]),
                    lambda x: x.isNotNull())


def target_as_feature_lines(text: Column, target: Column) -> Column:
    """Number of lines that index a feature frame with the quoted target
    and do no safe operation (drop/pop/remove or ``y = ...[``)."""
    pat = F.concat(F.lit("(?dU)" + TARGET_AS_FEATURE_PREFIX), F.lit("\\Q"), target, F.lit("\\E"),
                   F.lit(TARGET_AS_FEATURE_SUFFIX))
    lines = F.split(text, "\n")
    hits = F.filter(lines, lambda ln: F.regexp_like(ln, pat) & ~ln.rlike(TARGET_SAFE_OPS.java()))
    return F.size(hits)


def hyperparam_count(text: Column) -> Column:
    """Explicit hyper-parameter assignments (non-overlapping matches)."""
    return rx_count(text, HYPERPARAM_SET)


def bad_param_flags(text: Column) -> Column:
    """Array of 5 booleans, one per suspicious parameter pattern."""
    return F.array(*[rx_match(text, rx) for rx in BAD_PARAMS])


def test_sizes(text: Column) -> Column:
    """Every ``test_size=<number>`` literal as double (unparsable dropped)."""
    vals = F.regexp_extract_all(text, F.lit(TEST_SIZE.java()), 1)
    return F.filter(F.transform(vals, lambda v: v.try_cast("double")), lambda v: v.isNotNull())


def quoted_col_pattern(col_name: Column) -> Column:
    """``['"]<col>['"]`` with the name regex-escaped."""
    return F.concat(F.lit("(?dU)['\"]\\Q"), col_name, F.lit("\\E['\"]"))


def drop_col_pattern(col_name: Column) -> Column:
    """``\\.drop\\s*\\(.*['"]<col>['"]`` with the name regex-escaped."""
    return F.concat(F.lit("(?dU)" + DROP_CALL + "\\Q"), col_name, F.lit("\\E['\"]"))


# Quoted-name tests without one regex per column: every token that sits
# between two quote characters (overlapping, via a look-ahead), once per text.
QUOTED_TOKEN = Rx(r"(?=['\"]([^'\"\n]*)['\"])")
DROP_TAIL = Rx(r"\.drop\s*\(([^\n]*)")


def quoted_tokens(text: Column) -> Column:
    """All ``x`` with ``'x'`` / ``"x"`` (either quote on each side) in the text."""
    return F.regexp_extract_all(text, F.lit(QUOTED_TOKEN.java()), 1)


def dropped_tokens(text: Column) -> Column:
    """Quoted tokens on the same line after a ``.drop(`` call."""
    tails = F.regexp_extract_all(text, F.lit(DROP_TAIL.java()), 1)
    return quoted_tokens(F.array_join(tails, "\n"))


def has_quote_or_newline(name: Column) -> Column:
    return name.rlike("['\"\n]")
