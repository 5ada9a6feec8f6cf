"""What scoring reads: the log numbered once, patterns tried only where a rule reads them,
facts looked up among a column's own values."""

import re

from pyspark.sql import functions as F

from gradewell.functions import text_rules as TR
from gradewell.operators import episodes as E
from gradewell.operators import profile as P
from gradewell.plans import fixtures as X
from gradewell.plans import flagship


def test_scoring_numbers_the_log_once(spark, sf0001, monkeypatch):
    calls, number = [], X.steps
    monkeypatch.setattr(X, "steps", lambda *a: calls.append(1) or number(*a))
    given, more = flagship._tables(spark, sf0001)
    assert len(calls) == 1
    assert given[0].count() == spark.read.parquet(f"{sf0001}/events.parquet").count()
    assert more["artifacts"].count() > 0 and more["outcomes"].where("row_loss is not null").count() > 0


def test_patterns_are_tried_where_a_rule_reads_them(spark):
    text = "model = Ridge(alpha=1)\nmodel.fit(X, y)\nnp.random.seed(1)  # explore, cross_val_score"
    rows = [(a, ok, text) for a in (*TR.ACTION_TYPES, None) for ok in (True, False, None)]
    s = spark.createDataFrame([(*r, "target", None) for r in rows],
                              "action_type string, execution_success boolean, text string, target_column string, error_message string")
    got = {(r.action_type, r.execution_success): r for r in E.step_flags(s).collect()}
    assert got["PLAN", True].p_eda is True and got["CODE", True].p_eda is None
    assert got["CODE", True].f_seed and not got["CODE", None].f_seed and not got["PLAN", True].f_seed
    assert got["CODE", False].f_good and got["CODE", False].f_cv and not got["FINAL_SUBMIT", True].f_cv
    assert got["MODEL", True].n_hyperparams == 1 and got["CODE_FIX", True].n_hyperparams == 0
    assert got["FINAL_SUBMIT", True].f_model_assign and not got[None, True].f_fit_spaced


def test_first_character_check_changes_no_match(spark):
    assert TR.first_char_check(TR.GOOD_TABULAR.pattern) and TR.first_char_check(TR.EDA_PLAN.pattern)
    assert not any(TR.first_char_check(p) for p in ("a|b", r"a?x|b|c", r"\bx|y|z", "[ab]|c|d", r"(a|b|c)d", "a|b|", "x{0}a|b|c"))
    rules = {k: v for k, v in vars(TR).items() if isinstance(v, TR.Rx)}
    texts = [*X.STEP_CODE_TEXTS, "", "ſeed = 1", "KFold", "Анализ данных: РАСПРЕДЕЛЕНИЕ", "дубли", "SEED =2", "rolling big window",
             "z-score", "for i in [1]:\n m.fit(x)", "x.DTYPE", "print(a.Shape)", "ŞVM İQR ıqr", "period", "Time series", "nothing"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    plain = lambda rx: rx.java().replace(TR.first_char_check(rx.pattern), "", 1) if TR.first_char_check(rx.pattern) else rx.java()
    got = df.select("i", *[F.regexp_count("t", F.lit(rx.java())).alias(k) for k, rx in rules.items()]).collect()
    want = df.select("i", *[F.regexp_count("t", F.lit(plain(rx))).alias(k) for k, rx in rules.items()]).collect()
    assert sorted(got) == sorted(want)
    assert all(len(re.findall(r"\(\?=\[", rx.java())) <= 1 + rx.pattern.count("(?=[") for rx in rules.values())


def test_facts_as_of_a_step(spark):
    state = spark.createDataFrame([(1, i) for i in range(4)] + [(2, 0), (None, 0)], "episode_id long, step_idx int")
    facts = spark.createDataFrame([(1, 0, 5, None), (1, 2, None, 0.5), (1, 2, 7, None), (1, 3, None, None), (3, 0, 1, 1.0), (1, None, 9, 9.0)],
                                  "episode_id long, step_idx int, a int, b double")
    out = E.as_of(state, facts, ["a", "b"])
    assert {(r.episode_id, r.step_idx): (r.a, r.b) for r in out.collect()} == {
        (1, 0): (5, None), (1, 1): (5, None), (1, 2): (7, 0.5), (1, 3): (7, 0.5), (2, 0): (None, None), (None, 0): (None, None)}
    assert "_of_a" in out._jdf.queryExecution().analyzed().toString()


def test_texts_that_cannot_be_dates_are_not_parsed(spark):
    texts = ['{"k": 1}', "[1]", "'2024-01-01'", "#1", "/1/2024", "", " ", " 2024-01-01", "2024-01-01", "3/4/2024", "Mar 4, 2024", "4 Mar 2024",
             "-1", "+2024-01-01", "word"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    old = F.try_to_timestamp("t").isNotNull()
    for fmt in P.DATE_FORMATS:
        old = old | F.try_to_timestamp("t", F.lit(fmt)).isNotNull()
    for r in df.select("t", P.parses_as_date(F.col("t")).alias("new"), old.alias("old")).collect():
        assert r.new == r.old, r
    assert df.where(F.col("t").rlike(P.NO_DATE)).count() == 5
