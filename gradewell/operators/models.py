"""Model-based checks (L1-L7) on distributed frames with Spark ML.

Spark's trees bin continuous features (``maxBins``) where scikit-learn
splits on exact values, so model outputs are compared by threshold and
ranking, never bit for bit. Every metric is the library's grouped,
distributed metric (M1-M10), never a driver-side computation.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gradewell.functions.ranking import exclusive_prefix_sum
from gradewell.functions.stats import is_float_col
from gradewell.operators import metrics as M

# The reference's model settings.
LEAK_TREE_DEPTH = 2
BASELINE_TREES, BASELINE_DEPTH = 50, 3
VALUE_TEST_TREES = 30
SEED = 42


def _is_clf(task_type: str) -> bool:
    return task_type != "regression"


def numeric_features(df: DataFrame, target: str) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name != target]


# ------------------------------------------------------------------ L1
def single_feature_leak(df: DataFrame, target: str, task_type: str, threshold: float = 0.99,
                        min_rows: int = 10, depth: int = LEAK_TREE_DEPTH) -> DataFrame:
    """L1: a depth-2 tree on each numeric feature alone (features with any
    null/NaN are skipped, as the reference drops them); a train-set AUC
    (one-vs-rest mean for several classes) or R2 >= threshold flags a possible leak.

    One exact method for any number of features, rows and classes: features
    are unpivoted and counted by (feature, value, class), or summed by
    (feature, value) for regression; every level of the trees is a
    range-partitioned prefix sum over those counts: each value's left and
    right side gives its impurity, the least (smallest value on ties) is the
    split of (feature, node). The scores come from the leaves' counts.
    Labels of any type are compared as they are and stay rows."""
    spark = df.sparkSession
    schema = "feature string, score double, leak boolean"
    feats = numeric_features(df, target)
    base = df.select(*feats, target).where(F.col(target).isNotNull())
    if not feats:
        return spark.createDataFrame([], schema)
    nulls = base.agg(F.count(F.lit(1)).alias("__n"), *[
        F.sum((F.col(c).isNull() | (F.isnan(c) if is_float_col(base, c) else F.lit(False))).cast("long")).alias(c)
        for c in feats]).first()
    usable = [c for c in feats if (nulls[c] or 0) == 0]
    if not usable or nulls["__n"] < min_rows:
        return spark.createDataFrame([], schema)
    long = base.select(F.col(target).alias("_y"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in usable])).alias("x")) \
        .select("_y", "x.*")
    out = _leaf_auc(_class_leaves(long, depth)) if _is_clf(task_type) else _leaf_r2(_moment_leaves(long, depth))
    return out.select("feature", "score", F.coalesce(F.col("score") >= threshold, F.lit(False)).alias("leak"))


def _halve(g: DataFrame, sums: DataFrame, cost: Column, left: Column, all_: Column) -> DataFrame:
    """The rows of ``g`` with the node each goes to: ``sums`` holds one row a
    (feature, node, v), ``cost`` the impurity of a cut after v, ``left`` and ``all_`` the rows up to v and in the node. The
    cuts are a row a feature and node, so they and the node totals go to the rows: meeting by
    (feature, node) would bring all values of a feature into one task, to be sorted there."""
    cut = sums.where(left < all_).groupBy("feature", "node").agg(
        F.min(F.struct(F.round(cost, 6).alias("c"), F.col("v").alias("v")))["v"].alias("cut"))
    below = F.when(F.col("v") > F.col("cut"), 1).otherwise(0)
    return g.join(F.broadcast(cut), ["feature", "node"], "left").withColumn("node", F.col("node") * 2 + below).drop("cut")


def _class_leaves(long: DataFrame, depth: int) -> DataFrame:
    """(feature, node, _y, k): class counts in the leaves of Gini trees.

    A side's impurity is n - sum(k_y^2) / n. With L_y the class's count before
    a value, that sum of squares grows by 2 L_y k + k^2 there, so it is a
    prefix sum like n; the right side's follows from sum(t_y L_y)."""
    g = long.groupBy("feature", "v", "_y").agg(F.count(F.lit(1)).cast("double").alias("k")).withColumn("node", F.lit(0))
    for _ in range(depth):
        g = exclusive_prefix_sum(g, ["feature", "node", "_y"], "v", ["k"])
        total = g.groupBy("feature", "node", "_y").agg(F.sum("k").alias("t"))
        sums = g.join(total, ["feature", "node", "_y"]).groupBy("feature", "node", "v").agg(
            F.sum("k").alias("n"), F.sum(F.col("k") * (2 * F.col("k_below") + F.col("k"))).alias("q"),
            F.sum(F.col("t") * F.col("k")).alias("m"))
        sums = exclusive_prefix_sum(sums, ["feature", "node"], "v", ["n", "q", "m"])
        whole = sums.groupBy("feature", "node").agg(F.sum("n").alias("all_n"), F.sum("m").alias("all_q"))
        left_n, left_q, left_m = (F.col(c) + F.col(f"{c}_below") for c in ("n", "q", "m"))
        right_n, right_q = F.col("all_n") - left_n, F.col("all_q") - 2 * left_m + left_q
        cost = left_n - left_q / left_n + F.when(right_n > 0, right_n - right_q / right_n).otherwise(0.0)
        g = _halve(g.drop("k_below"), sums.join(F.broadcast(whole), ["feature", "node"]), cost, left_n, F.col("all_n"))
    return g.groupBy("feature", "node", "_y").agg(F.sum("k").alias("k"))


def _rest(n: Column, s: Column, q: Column) -> Column:
    """Sum of squares around the mean."""
    return F.when(n > 0, q - s * s / n).otherwise(0.0)


def _moment_leaves(long: DataFrame, depth: int) -> DataFrame:
    """(feature, node, n, s, q): count, sum and squares in the leaves of regression trees."""
    stats, y = ["n", "s", "q"], F.col("_y").cast("double")
    g = long.groupBy("feature", "v").agg(F.sum(F.lit(1.0)).alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("q")) \
        .withColumn("node", F.lit(0))
    for _ in range(depth):
        g = exclusive_prefix_sum(g, ["feature", "node"], "v", stats)
        total = g.groupBy("feature", "node").agg(*[F.sum(k).alias(f"t_{k}") for k in stats])
        left = [F.col(f"{k}_below") + F.col(k) for k in stats]
        cost = _rest(*left) + _rest(*[F.col(f"t_{k}") - x for k, x in zip(stats, left)])
        g = _halve(g.drop(*[f"{k}_below" for k in stats]), g.join(F.broadcast(total), ["feature", "node"]), cost, left[0], F.col("t_n"))
    return g.groupBy("feature", "node").agg(*[F.sum(k).alias(k) for k in stats])


def _leaf_r2(leaves: DataFrame) -> DataFrame:
    """(feature, score): train R2 of trees that predict their leaf's mean."""
    cols = [F.col(k) for k in ("n", "s", "q")]
    whole = leaves.groupBy("feature").agg(*[F.sum(k).alias(k) for k in ("n", "s", "q")], F.sum(_rest(*cols)).alias("rest"))
    score = F.when(_rest(*cols) > 0, 1 - F.col("rest") / _rest(*cols)).when(F.col("rest") == 0, 1.0).otherwise(0.0)
    return whole.select("feature", score.alias("score"))


def _leaf_auc(leaves: DataFrame) -> DataFrame:
    """(feature, score): train AUC of trees that predict their leaf's class
    shares, from at most four leaves a feature; ties count one half. Of two
    classes the larger label is judged, of more each against the rest (mean);
    of one, the score is null."""
    size = leaves.groupBy("feature", "node").agg(F.sum("k").alias("n"))
    labels = leaves.select("feature", "_y").distinct()
    many = labels.groupBy("feature").agg(F.count(F.lit(1)).alias("classes"), F.max("_y").alias("last"))
    judged = labels.join(many, "feature").where((F.col("classes") > 2) | ((F.col("classes") == 2) & (F.col("_y") == F.col("last"))))
    rows = judged.select("feature", "_y").join(size, "feature").join(leaves, ["feature", "node", "_y"], "left")
    pos = F.coalesce("k", F.lit(0.0))
    rows = rows.groupBy("feature", "_y", (pos / F.col("n")).alias("share")).agg(
        F.sum(pos).alias("pos"), F.sum(F.col("n") - pos).alias("neg"))
    w = Window.partitionBy("feature", "_y").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("below", F.coalesce(F.sum("neg").over(w), F.lit(0.0)))
    per = rows.groupBy("feature", "_y").agg(
        F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("num"), F.sum("pos").alias("p"), F.sum("neg").alias("m"))
    auc = F.when((F.col("p") > 0) & (F.col("m") > 0), F.col("num") / (F.col("p") * F.col("m")))
    return many.select("feature").join(per.groupBy("feature").agg(F.avg(auc).alias("score")), "feature", "left")


# ------------------------------------------------------------------ L2
def train_valid_gap(preds: DataFrame, task_type: str, by=("run_id",), split: str = "split", y: str = "y_true",
                    score: str = "y_score", train_min: float = 0.95, gap: float = 0.30) -> DataFrame:
    """L2: accuracy (classification) or R2 (regression) of each run on its
    train and valid rows; flagged when train > train_min and train - valid > gap."""
    keys = list(by)
    x = preds.where(F.col(split).isin("train", "valid"))
    if _is_clf(task_type):
        m = M.accuracy(x, keys + [split], y, score).withColumnRenamed("accuracy", "s")
    else:
        m = M.r2(x, keys + [split], y, score).withColumnRenamed("r2", "s")
    p = m.groupBy(*keys).agg(F.max(F.when(F.col(split) == "train", F.col("s"))).alias("train_score"),
                             F.max(F.when(F.col(split) == "valid", F.col("s"))).alias("valid_score"))
    g = F.col("train_score") - F.col("valid_score")
    return p.select(*keys, "train_score", "valid_score", g.alias("gap"),
                    F.coalesce((F.col("train_score") > train_min) & (g > gap), F.lit(False)).alias("flagged"))


# ------------------------------------------------------------------ L3
def _filled(df: DataFrame, feats: list[str]) -> DataFrame:
    filled = df.fillna(0, subset=feats)
    return filled.select(*[F.nanvl(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in feats else F.col(c)
                           for c in filled.columns])


def _assembled(df: DataFrame, feats: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=feats, outputCol=out).transform(_filled(df, feats))


def _weighted(df: DataFrame, feats: list[str]) -> DataFrame:
    """Rows of equal features and ``label`` as one row, their number as its ``weight``: a boosting loss is a sum
    over rows, so a tree fits these as it fits the rows, and the loop scans no row twice that it need not."""
    return df.groupBy(*feats, "label").agg(F.count(F.lit(1)).cast("double").alias("weight"))


# Training rows that are worth a task of their own: the boosting loop runs several jobs a tree.
ROWS_A_TASK = 50_000


def _dealt(rows: DataFrame) -> DataFrame:
    """Persisted training rows in no more partitions than they fill."""
    return rows.coalesce(max(1, rows.count() // ROWS_A_TASK))


def _judged_by(spark, run: str, metric: str) -> DataFrame:
    """One run and its metric, as constants the planner sees through."""
    return spark.range(1).select(F.lit(run).alias("run_id"), F.lit(metric).alias("metric"))


def baseline_gbt(train: DataFrame, test: DataFrame, target: str, task_type: str, metric: str,
                 features: list[str] | None = None, n_trees: int = BASELINE_TREES,
                 depth: int = BASELINE_DEPTH) -> DataFrame:
    """L3: boosted trees on the raw numeric features (null and NaN -> 0),
    scored on ``test`` with the task metric. Spark's GBT is binary only, so
    multiclass uses one-vs-rest. Output: metric, value, n_invalid."""
    feats = features or numeric_features(train, target)
    spark = train.sparkSession
    if not feats:
        return spark.createDataFrame([(metric, None, None)], "metric string, value double, n_invalid long")
    # the boosting loop scans the training rows several times per tree: cache them
    tr = _weighted(_filled(train, feats).withColumn("label", F.col(target).cast("double")), feats)
    tr = VectorAssembler(inputCols=feats, outputCol="features").transform(tr).select("features", "label", "weight").persist()
    try:
        return _baseline_fit(spark, _dealt(tr), test, feats, target, task_type, metric, n_trees, depth)
    finally:
        tr.unpersist()


def _baseline_fit(spark, tr, test, feats, target, task_type, metric, n_trees, depth):
    te = _assembled(test, feats).withColumn("label", F.col(target).cast("double"))
    if not _is_clf(task_type):
        model = GBTRegressor(maxIter=n_trees, maxDepth=depth, stepSize=0.1, seed=SEED, cacheNodeIds=True, weightCol="weight").fit(tr)
        pred = model.transform(te).select(F.lit("baseline").alias("run_id"), F.col("label").alias("y_true"),
                                          F.col("prediction").alias("y_score"))
        return M.compute_metric(pred, _judged_by(spark, "baseline", metric))
    n_classes = tr.select("label").distinct().count()   # labels: bounded
    if n_classes <= 2:
        model = GBTClassifier(maxIter=n_trees, maxDepth=depth, stepSize=0.1, seed=SEED, cacheNodeIds=True, weightCol="weight").fit(tr)
        pred = model.transform(te)
        score = vector_to_array("probability")[1] if metric in ("roc_auc", "log_loss") else F.col("prediction")
        pred = pred.select(F.lit("baseline").alias("run_id"), F.col("label").alias("y_true"), score.alias("y_score"))
        return M.compute_metric(pred, _judged_by(spark, "baseline", metric))
    ovr = OneVsRest(classifier=GBTClassifier(maxIter=n_trees, maxDepth=depth, stepSize=0.1, seed=SEED, cacheNodeIds=True, weightCol="weight"), weightCol="weight").fit(tr)
    pred = ovr.transform(te).withColumn("_row", F.monotonically_increasing_id())
    if metric == "roc_auc":
        long = pred.select(F.lit("baseline").alias("run_id"), F.col("label").cast("int").alias("y_true"),
                           F.posexplode(vector_to_array("rawPrediction")).alias("class_idx", "score"))
        v = M.auc_ovr_macro(long).select(F.col("auc_ovr_macro").alias("value"), "n_invalid")
    else:
        p = pred.select(F.lit("baseline").alias("run_id"), F.col("label").cast("int").alias("y_true"),
                        F.col("prediction").cast("int").alias("y_score"))
        none = F.lit(0).cast("long").alias("n_invalid")
        v = (M.f1_macro(p).select(F.col("f1_macro").alias("value"), none) if metric == "f1"
             else M.accuracy(p).select(F.col("accuracy").alias("value"), none))
    return v.select(F.lit(metric).alias("metric"), "value", "n_invalid")


# ------------------------------------------------------------------ L4
def baseline_compare(agent: F.Column, baseline: F.Column, margin: float = 0.003, bonus: float = 0.05,
                     penalty: float = 0.15) -> F.Column:
    """L4: struct(outcome, bonus, penalty) of agent vs baseline metric."""
    diff = agent - baseline
    outcome = (F.when(agent.isNull(), "no_agent_metric").when(baseline.isNull(), "no_baseline")
               .when(diff > margin, "better").when(diff < -margin, "worse").otherwise("equal"))
    return F.struct(diff.alias("diff"), outcome.alias("outcome"),
                    F.when(outcome == "better", bonus).otherwise(0.0).alias("bonus"),
                    F.when(outcome.isin("worse", "no_agent_metric"), penalty).otherwise(0.0).alias("penalty"))


# ------------------------------------------------------------------ L5
def model_value_test(train: DataFrame, valid: DataFrame, agent_preds: DataFrame, target: str, key: str,
                     task_type: str, metric: str, pred_col: str = "y_score",
                     n_trees: int = VALUE_TEST_TREES) -> DataFrame:
    """Valid-set metric of a GBT (30 trees, depth 3) with the agent's
    prediction added as a feature, minus the same model without it. Needs
    >= 2 numeric features. Agent predictions join by key (not position)."""
    feats = [c for c in numeric_features(train, target) if c != key]
    spark = train.sparkSession
    if len(feats) < 2:
        return spark.createDataFrame([(None, None, None)], "without double, with_agent double, gain double")
    ap = agent_preds.groupBy(key).agg(F.avg(F.col(pred_col).cast("double")).alias("_agent"))     # a key's predictions are one
    tr, va = train.join(ap, key, "left"), valid.join(ap, key, "left")
    without = baseline_gbt(tr, va, target, task_type, metric, feats, n_trees).select(F.col("value").alias("without"))
    with_a = baseline_gbt(tr, va, target, task_type, metric, feats + ["_agent"], n_trees) \
        .select(F.col("value").alias("with_agent"))
    return without.crossJoin(with_a).withColumn("gain", F.col("with_agent") - F.col("without"))  # one row each


# ------------------------------------------------------------------ L6
def feature_importances(df: DataFrame, target: str, task_type: str, features: list[str] | None = None,
                        n_trees: int = BASELINE_TREES) -> DataFrame:
    """Importances of a boosted-tree model as a small (feature, importance)
    table (one row per feature)."""
    feats = features or numeric_features(df, target)
    data = _assembled(df, feats).withColumn("label", F.col(target).cast("double"))
    est = (GBTClassifier if _is_clf(task_type) else GBTRegressor)(maxIter=n_trees, maxDepth=BASELINE_DEPTH,
                                                                  seed=SEED)
    imp = est.fit(data).featureImportances.toArray().tolist()
    return df.sparkSession.createDataFrame(list(zip(feats, [float(v) for v in imp])),
                                           "feature string, importance double")


def new_features_in_top_k(importances: DataFrame, original_cols: DataFrame | list[str], bonus: float = 0.03) -> DataFrame:
    """New features among the top max(3, n // 3) importances. ``original_cols``: the names
    that are not new, as a list or a table (``feature``). Ranks come from range partitions, names from an anti join: an
    importance table of any length."""
    from gradewell.functions.ranking import distributed_row_number
    spark = importances.sparkSession
    k = max(3, importances.count() // 3)
    ranked = distributed_row_number(importances.select("feature", (-F.col("importance")).alias("_less"), F.lit(0).alias("_all")),
                                    ["_all"], ["_less", "feature"], out="_rn")
    known = original_cols if isinstance(original_cols, DataFrame) else spark.createDataFrame(
        [(c,) for c in original_cols], "feature string")
    new = ranked.where(F.col("_rn") < k).join(known.select("feature"), "feature", "left_anti")
    return new.agg(F.count(F.lit(1)).alias("n_new_in_top"),
                   F.array_join(F.array_sort(F.collect_list("feature")), ", ").alias("features")) \
        .withColumn("bonus", F.when(F.col("n_new_in_top") > 0, bonus).otherwise(0.0)) \
        .withColumn("top_k", F.lit(k))


# ------------------------------------------------------------------ L7
def fit_pipeline(train: DataFrame, target: str, task_type: str, features: list[str] | None = None,
                 n_trees: int = BASELINE_TREES) -> PipelineModel:
    feats = features or numeric_features(train, target)
    vec = VectorAssembler(inputCols=feats, outputCol="features", handleInvalid="keep")
    est = (GBTClassifier if _is_clf(task_type) else GBTRegressor)(
        maxIter=n_trees, maxDepth=BASELINE_DEPTH, seed=SEED, labelCol="label", weightCol="weight")
    data = _weighted(train.withColumn("label", F.col(target).cast("double")), feats).persist()
    try:
        return Pipeline(stages=[vec, est]).fit(_dealt(data))
    finally:
        data.unpersist()


def evaluate_model(model: PipelineModel, valid: DataFrame, target: str, metric: str,
                   baseline: float | None = None) -> DataFrame:
    """L7 (+F13): apply the model to the valid rows (P(1) when binary), score
    with the task metric, and judge against the task baseline."""
    pred = model.transform(valid)
    if "probability" in pred.columns and metric in ("roc_auc", "log_loss"):
        score = vector_to_array("probability")[1]
    else:
        score = F.col("prediction")
    p = pred.select(F.lit("model").alias("run_id"), F.col(target).cast("double").alias("y_true"),
                    score.alias("y_score"))
    spark = valid.sparkSession
    m = M.compute_metric(p, _judged_by(spark, "model", metric))
    from gradewell.operators.checks import prediction_score_vs_baseline
    v = prediction_score_vs_baseline(F.col("value"), F.lit(baseline).cast("double"))
    return m.select("metric", "value", v["passed"].alias("passed"), v["score"].alias("score"),
                    v["penalty"].alias("penalty"))
