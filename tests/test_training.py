"""Model checks: training rows of equal features are one weighted row."""
import math

from pyspark.sql import functions as F

from gradewell.operators import models as L


def _rows(spark, n=4000):
    return spark.range(n).selectExpr("id", "cast(id % 2 as int) as odd", "cast(id % 3 = 0 as int) as big",
                                     "cast(id * 7919 % 10 < 1 + id % 2 * 3 + cast(id % 3 = 0 as int) * 4 as int) as y")


def _group_auc(rows):
    pos = [(r.odd, r.big) for r in rows if r.y]
    neg = [(r.odd, r.big) for r in rows if not r.y]
    by = {}
    for r in rows:
        by.setdefault((r.odd, r.big), []).append(r.y)
    share = {k: sum(v) / len(v) for k, v in by.items()}
    won = sum((share[p] > share[q]) + 0.5 * (share[p] == share[q]) for p in pos[::7] for q in neg)
    return won / (len(pos[::7]) * len(neg))


def test_equal_training_rows_are_one_weighted_row(spark):
    d = _rows(spark).withColumn("label", F.col("y").cast("double"))
    w = L._weighted(d, ["odd", "big"])
    assert w.count() <= 8 and w.agg(F.sum("weight")).first()[0] == 4000
    assert L._dealt(w).rdd.getNumPartitions() == 1


def test_baseline_and_pipeline_on_weighted_rows(spark):
    d = _rows(spark)
    whole = L.baseline_gbt(d, d, "y", "binary_classification", "roc_auc", ["odd", "big"], n_trees=5).first()
    model = L.fit_pipeline(d, "y", "binary_classification", ["odd", "big"], n_trees=5)
    again = L.evaluate_model(model, d, "y", "roc_auc", baseline=0.5).first()
    assert whole["n_invalid"] == 0 and math.isclose(whole["value"], again["value"], abs_tol=1e-9)
    assert abs(whole["value"] - _group_auc(d.collect())) < 0.02


def test_one_run_is_judged_without_a_cartesian_product(spark):
    d = _rows(spark).select(F.lit("m").alias("run_id"), F.col("y").alias("y_true"), F.col("odd").cast("double").alias("y_score"))
    plan = d.join(L._judged_by(spark, "m", "roc_auc"), "run_id")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def test_leak_cuts_do_not_gather_a_feature(spark):
    """Node totals and cuts go to the values: no join by (feature, node) alone deals the values out."""
    sums = spark.range(100).selectExpr("'f' as feature", "0 as node", "cast(id as double) as v", "1.0D as n")
    out = L._halve(sums.drop("n"), sums, F.abs(F.col("v") - 40.0), F.col("v") + 1, F.lit(100.0))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan and plan.count("Join") == 1
    assert {(r.v > 40.0, r.node) for r in out.collect()} == {(False, 0), (True, 1)}
