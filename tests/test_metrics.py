import math
import random

from pyspark.sql import functions as F

from gradewell.operators import metrics as M


def _brute_auc(y, s):
    pos = [b for a, b in zip(y, s) if a == 1]
    neg = [b for a, b in zip(y, s) if a == 0]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def test_auc_matches_pairwise_with_ties(spark):
    rnd = random.Random(3)
    rows = [("r1" if i % 3 else "r2", rnd.randint(0, 1), round(rnd.random(), 1)) for i in range(600)]
    df = spark.createDataFrame(rows, "run_id string, y_true int, y_score double")
    got = {r["run_id"]: r["roc_auc"] for r in M.roc_auc(df).collect()}
    for run in ("r1", "r2"):
        ys = [y for r, y, _ in rows if r == run]
        ss = [s for r, _, s in rows if r == run]
        assert math.isclose(got[run], _brute_auc(ys, ss), rel_tol=1e-12)
    # monotone map keeps it; negation mirrors it
    mono = {r["run_id"]: r["roc_auc"] for r in M.roc_auc(df.withColumn("y_score", F.exp("y_score") * 3)).collect()}
    neg = {r["run_id"]: r["roc_auc"] for r in M.roc_auc(df.withColumn("y_score", -F.col("y_score"))).collect()}
    for run in ("r1", "r2"):
        assert math.isclose(mono[run], got[run], rel_tol=1e-12)
        assert math.isclose(neg[run], 1 - got[run], rel_tol=1e-12)


def test_invalid_scores(spark):
    df = spark.createDataFrame([("r", 0, float("nan")), ("r", 0, None), ("r", 1, 0.9)], "run_id string, y_true int, y_score double")
    assert M.accuracy(df).first()["accuracy"] == 1.0
    ll = M.neg_log_loss(df).first()
    assert ll["neg_log_loss"] is None and ll["n_invalid"] == 2


def test_auc_counts_beyond_bigint(spark):
    df = spark.createDataFrame([("r", 1, 0.9), ("r", 0, 0.1)], "run_id string, y_true int, y_score double")
    big = df.withColumn("w", F.lit(1))
    from unittest import mock
    with mock.patch.object(M, "exclusive_prefix_sum", lambda g, keys, o, v: g.withColumn("pos", F.col("pos") * (1 << 40))
                           .withColumn("neg", F.col("neg") * (1 << 40)).withColumn("neg_below", F.when(F.col("pos") > 0, F.lit(1 << 40)).otherwise(0))):
        assert M.roc_auc(big).first()["roc_auc"] == 1.0


def test_auc_single_class_is_null(spark):
    df = spark.createDataFrame([("r", 1, 0.2), ("r", 1, 0.4)], "run_id string, y_true int, y_score double")
    assert M.roc_auc(df).first()["roc_auc"] is None


def test_f1_macro_and_accuracy(spark):
    y = [0, 1, 2, 2, 1, 0, 1]
    p = [0, 2, 2, 2, 1, 0, 0]
    df = spark.createDataFrame([("r", a, b) for a, b in zip(y, p)], "run_id string, y_true int, y_pred int")
    f1 = M.f1_macro(df, score="y_pred").first()["f1_macro"]
    # per label: 0 -> 2*2/(2+3)=0.8, 1 -> 2*1/(3+1)=0.5, 2 -> 2*2/(2+3)=0.8
    assert math.isclose(f1, (0.8 + 0.5 + 0.8) / 3)
    acc = M.accuracy(df, score="y_pred").first()["accuracy"]
    assert math.isclose(acc, 5 / 7)


def test_regression_metrics_and_constant_target(spark):
    df = spark.createDataFrame([("a", 1.0, 1.5), ("a", 2.0, 2.0), ("a", 3.0, 2.0), ("c", 5.0, 5.0), ("c", 5.0, 5.0),
                                ("d", 5.0, 4.0)], "run_id string, y_true double, y_pred double")
    r2 = {r["run_id"]: r["r2"] for r in M.r2(df).collect()}
    assert math.isclose(r2["a"], 1 - (0.25 + 0 + 1) / 2.0)
    assert r2["c"] == 1.0 and r2["d"] == 0.0
    rmse = {r["run_id"]: r["neg_rmse"] for r in M.neg_rmse(df).collect()}
    assert math.isclose(rmse["a"], -math.sqrt(1.25 / 3))


def test_normalize_score(spark):
    df = spark.createDataFrame([(0.7, 0.5, 0.9), (1.3, None, None), (0.6, 0.6, 0.6), (0.5, 0.6, 0.6), (0.2, 0.5, 0.9)],
                               "raw double, b double, o double")
    got = [r[0] for r in df.select(M.normalize_score(F.col("raw"), F.col("b"), F.col("o"))).collect()]
    assert [round(v, 12) for v in got] == [0.5, 1.0, 1.0, 0.0, 0.0]


def test_compute_metric_mixed_runs(spark):
    rows = [("x", float(i % 2), (i % 10) / 10.0) for i in range(40)] + [("y", float(i), float(i) + 1) for i in range(10)]
    preds = spark.createDataFrame(rows, "run_id string, y_true double, y_score double")
    runs = spark.createDataFrame([("x", "roc_auc"), ("y", "mae")], "run_id string, metric string")
    got = {r["run_id"]: r["value"] for r in M.compute_metric(preds, runs).collect()}
    assert math.isclose(got["y"], -1.0)
    assert 0.0 <= got["x"] <= 1.0
