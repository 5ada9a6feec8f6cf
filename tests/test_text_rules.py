import re

import pytest
from pyspark.sql import functions as F

from gradewell.functions import text_rules as TR

TEXTS = [
    "ACTION: PLAN\nPlan: handle missing values, check correlation, EDA.",
    "  action :  code_fix  \n```python\nprint(df.describe())\n```\nthanks",
    "```python\nmodel.fit(X_train, y_train)\n```",
    "model = RandomForestClassifier(n_estimators=1, max_depth=None, random_state=42)\nmodel.fit(X, y)",
    "auc = roc_auc_score(y, p)\nif c == 3: pass\nC=10",
    "learning_rate=1.5, max_depth=60, max_depth = 120, n_estimators = 3",
    "X_train['Survived'] = 1\nX_train = X_train.drop(columns=['Survived'])\ny = train_df['Survived']",
    "clf.fit(valid_df[features], y)\nprint(test_df.shape)\nscaler.fit_transform(test_df)",
    "Проверяем корреляцию и мультиколлинеарность; ВЫБРОСЫ обработаны",
    "for d in [1, 2, 3]:\n    m = Tree(max_depth=d)\n    m.fit(X, y)",
    "class MyModel:\n    def __init__(self):\n        pass\n    def predict(self, X):\n        return X",
    "GridSearchCV(est, grid).fit(X, y)  # then RandomizedSearchCV",
    "train_test_split(X, y, test_size=0.05, shuffle=True); test_size=0.6; test_size=.2.1",
    "KeyError: 'Age'", "ImportError: module os is forbidden here", "Execution TIMED OUT", "",
    "No module named 'lightgbm'", "ValueError: could not convert", "trailing\n",
]

PATTERNS = [TR.ACTION_HEADER, TR.CODE_BLOCK, TR.FIT_SPACED, TR.FIT_PLAIN, TR.MODEL_FIT_STRICT, TR.BASIC_OPS, TR.SEED,
            TR.GRIDSEARCH, TR.EFFICIENT_SEARCH, TR.CORR_CODE, TR.CORR_PLAN, TR.PCA, TR.FILL, TR.DROPNA,
            TR.MISSING_PLAN, TR.EDA, TR.EDA_PLAN, TR.OUTLIER_HANDLING, TR.OUTLIER_PLAN, TR.DEDUP_CODE,
            TR.DEDUP_PLAN, TR.IMPORTANCE, TR.HYPERPARAM_SET, TR.TUNING, TR.ANN, TR.GOOD_TABULAR, TR.ENSEMBLE,
            TR.CUSTOM_MODEL, TR.LIBRARY_IMPORT, TR.CV, TR.TIMESERIES_SPLIT, TR.SHUFFLE_TRUE, TR.SHUFFLE_FALSE,
            TR.STRATIFY, TR.TEST_SIZE, TR.TIMESERIES_HINTS, *TR.LEAKAGE, *TR.BAD_PARAMS,
            *[rx for rx, _ in TR.ERROR_CLASSES]]


def _py(rx):
    flags = (re.I if "i" in rx.flags else 0) | (re.S if "s" in rx.flags else 0) | (re.M if "m" in rx.flags else 0)
    return re.compile(rx.pattern, flags)


def test_regex_parity_with_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    cols = []
    for k, rx in enumerate(PATTERNS):
        cols += [TR.rx_match(F.col("t"), rx).alias(f"m{k}"), TR.rx_count(F.col("t"), rx).alias(f"c{k}")]
    rows = {r["i"]: r for r in df.select("i", *cols).collect()}
    for i, t in enumerate(TEXTS):
        for k, rx in enumerate(PATTERNS):
            p = _py(rx)
            assert rows[i][f"m{k}"] == bool(p.search(t)), (rx.pattern, t)
            assert rows[i][f"c{k}"] == len(p.findall(t)), (rx.pattern, t)


def test_hyperparam_quirk_counts_auc(spark):
    df = spark.createDataFrame([("auc = 0.9\nc == 2",)], "t string")
    assert df.select(TR.hyperparam_count(F.col("t"))).first()[0] == 2


@pytest.mark.parametrize("text,typ,body", [
    ("ACTION: PLAN\n  do eda  ", "PLAN", "do eda"),
    ("ACTION: code\n```python\nx = 1\n```", "CODE", "x = 1"),
    ("text before\nAction: CODE_FIX\nfix", "CODE_FIX", "fix"),
    ("```\ny = 2\n```", "CODE", "y = 2"),
    ("I will fix the error traceback", "CODE_FIX", "I will fix the error traceback"),
    ("hello world", "CODE", "hello world"),
    ("Plan: steps: first model", "PLAN", "Plan: steps: first model"),
])
def test_parse_action(spark, text, typ, body):
    r = spark.createDataFrame([(text,)], "t string").select(TR.parse_action(F.col("t")).alias("p")).first()["p"]
    assert (r["action_type"], r["body"]) == (typ, body)


def test_classify_error(spark):
    msgs = ["SyntaxError: x", "No module named y", "ImportError: z is forbidden", "KeyError: 'a'", "nameerror",
            "AttributeError", "TypeError", "ValueError", "timed out", "ZeroDivisionError", None, ""]
    want = ["syntax_error", "module_not_found", "module_not_found", "key_error", "name_error", "attribute_error",
            "type_error", "value_error", "timeout", "other", "none", "none"]
    df = spark.createDataFrame([(m,) for m in msgs], "m string")
    assert [r[0] for r in df.select(TR.classify_error(F.col("m"))).collect()] == want


def test_target_as_feature_lines(spark):
    text = "X_train['Survived'] = 1\nX_train = X_train.drop(columns=['Survived'])\nfeatures[\"Survived\"]"
    df = spark.createDataFrame([(text, "Survived")], "t string, target string")
    assert df.select(TR.target_as_feature_lines(F.col("t"), F.col("target"))).first()[0] == 2


def test_quoted_tokens_equal_regex(spark):
    texts = ["df.drop(columns=['Age', \"Cabin\"])", "x = df['a']['b']", "'a'col'", "df.drop('x')\n'y'",
             "df.drop (\n 'z', 'w')"]
    names = ["Age", "Cabin", "a", "b", "col", "x", "y", "z", "w"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", TR.quoted_tokens(F.col("t")).alias("q"), TR.dropped_tokens(F.col("t")).alias("d")).collect()
    for r in rows:
        for n in names:
            q = bool(re.search(r"['\"]" + re.escape(n) + r"['\"]", r["t"]))
            d = bool(re.search(r"\.drop\s*\(.*['\"]" + re.escape(n) + r"['\"]", r["t"]))
            assert (n in r["q"]) == q, (r["t"], n)
            assert (n in r["d"]) == d, (r["t"], n)
