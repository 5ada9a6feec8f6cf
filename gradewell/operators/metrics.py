"""ML metrics grouped by run over prediction tables.

All are "higher is better": losses are negated. Every metric is a grouped
aggregate by ``by`` (default ``run_id``); rows are aligned by key upstream.
"""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradewell.functions.ranking import exclusive_prefix_sum

# Clip used by the log loss (float64 machine epsilon).
LOG_LOSS_EPS = 2.220446049250313e-16


def _by(by) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def hard_label(df: DataFrame, score: str, threshold: float = 0.5) -> F.Column:
    """Floating scores are cut at ``> threshold``; a score that is NaN or null
    is above no threshold and counts as label 0. Integer predictions are labels."""
    dt = df.schema[score].dataType
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return F.when(F.col(score).isNull() | F.isnan(score), 0).otherwise((F.col(score) > threshold).cast("int"))
    if isinstance(dt, T.DecimalType):
        return F.coalesce((F.col(score) > threshold).cast("int"), F.lit(0))
    return F.col(score)


def _probability(score: str, eps: float) -> F.Column:
    """A score clipped to [eps, 1 - eps]; null for NaN (Spark orders NaN above
    every number, so clipping alone would turn it into a sure 1)."""
    p = F.nanvl(F.col(score).cast("double"), F.lit(None).cast("double"))
    return F.when(p.isNotNull(), F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps)))


def _loss_if_complete(loss: F.Column) -> F.Column:
    """Mean loss; null as soon as one row has none (an invalid score)."""
    return F.when(F.count(loss) == F.count(F.lit(1)), F.avg(loss))


def _valid(df: DataFrame, y: str, score: str) -> F.Column:
    """A row with a label and a score that is a number (infinite ones rank at the ends)."""
    ok = F.col(y).isNotNull() & F.col(score).isNotNull()
    return ok & ~F.isnan(score) if isinstance(df.schema[score].dataType, (T.DoubleType, T.FloatType)) else ok


# --------------------------------------------------------------------------- M1
def roc_auc(preds: DataFrame, by=("run_id",), y: str = "y_true", score: str = "y_score") -> DataFrame:
    """M1: binary ROC AUC per group, tied scores count one half; null when a
    group holds one class only or a row without a label or a number as its score: ``n_invalid`` counts
    these, ``n_pos`` and ``n_neg`` the others. Pre-aggregates to one row per (group, score)
    and gets the negatives below each score by a range-partitioned prefix sum,
    so a single huge run is still spread over many tasks. Pair counts are
    doubles: positives times negatives leaves BIGINT behind."""
    keys = _by(by)
    valid, label = _valid(preds, y, score), F.col(y).cast("long")
    g = (preds.select(*keys, F.when(valid, F.col(score)).alias("_score"), F.when(valid, label).alias("_label"))
         .groupBy(*keys, "_score")
         .agg(F.coalesce(F.sum("_label"), F.lit(0)).alias("pos"), F.coalesce(F.sum(1 - F.col("_label")), F.lit(0)).alias("neg"),
              F.count(F.when(F.col("_label").isNull(), 1)).alias("invalid")))
    g = exclusive_prefix_sum(g, keys, "_score", ["neg"])
    agg = g.groupBy(*keys).agg(
        F.sum(F.col("pos").cast("double") * (F.col("neg_below") + F.col("neg") / 2.0)).alias("_num"),
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum("invalid").alias("n_invalid"))
    return agg.select(*keys, F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0) & (F.col("n_invalid") == 0),
                                    F.col("_num") / (F.col("n_pos").cast("double") * F.col("n_neg"))).alias("roc_auc"),
                      "n_pos", "n_neg", "n_invalid")


# --------------------------------------------------------------------------- M2
def accuracy(preds: DataFrame, by=("run_id",), y: str = "y_true", score: str = "y_score",
             threshold: float = 0.5) -> DataFrame:
    """M2: share of rows whose (cut) prediction equals the label."""
    keys = _by(by)
    pred = hard_label(preds, score, threshold)
    return preds.groupBy(*keys).agg(F.avg((pred == F.col(y)).cast("double")).alias("accuracy"))


# --------------------------------------------------------------------------- M3
def f1_macro(preds: DataFrame, by=("run_id",), y: str = "y_true", score: str = "y_score",
             threshold: float = 0.5) -> DataFrame:
    """M3: unweighted mean of per-label F1 over the union of true and
    predicted labels; 0 where precision and recall are undefined. Works from
    the confusion counts (labels^2 rows per group)."""
    keys = _by(by)
    pred = hard_label(preds, score, threshold)
    cm = preds.select(*keys, F.col(y).alias("_t"), pred.alias("_p")) \
        .groupBy(*keys, "_t", "_p").agg(F.count(F.lit(1)).alias("_c"))
    side = F.explode(F.array(
        F.struct(F.col("_t").alias("label"), F.col("_c").alias("n_true"), F.lit(0).cast("long").alias("n_pred"),
                 F.when(F.col("_t") == F.col("_p"), F.col("_c")).otherwise(0).alias("tp")),
        F.struct(F.col("_p").alias("label"), F.lit(0).cast("long").alias("n_true"), F.col("_c").alias("n_pred"),
                 F.lit(0).cast("long").alias("tp"))))
    per = cm.select(*keys, side.alias("x")).select(*keys, "x.*") \
        .groupBy(*keys, "label").agg(F.sum("n_true").alias("n_true"), F.sum("n_pred").alias("n_pred"),
                                      F.sum("tp").alias("tp"))
    den = F.col("n_true") + F.col("n_pred")
    f1 = F.when(den > 0, 2.0 * F.col("tp") / den).otherwise(0.0)
    return per.groupBy(*keys).agg(F.avg(f1).alias("f1_macro"), F.count(F.lit(1)).alias("n_labels"))


# --------------------------------------------------------------------------- M4
def neg_log_loss(preds: DataFrame, by=("run_id",), y: str = "y_true", score: str = "y_score",
                 eps: float = LOG_LOSS_EPS) -> DataFrame:
    """M4 (binary): scores are P(1), clipped to [eps, 1-eps]. A NaN or null
    score makes the group's loss null; ``n_invalid`` counts them."""
    keys = _by(by)
    p = _probability(score, eps)
    yy = F.col(y).cast("double")
    ll = yy * F.log(p) + (1 - yy) * F.log(1 - p)
    return preds.groupBy(*keys).agg(_loss_if_complete(ll).alias("neg_log_loss"),
                                    F.count(F.when(p.isNull(), 1)).alias("n_invalid"))


def neg_log_loss_multiclass(scores: DataFrame, by=("run_id",), row: str = "row_id", y: str = "y_true",
                            cls: str = "class_idx", score: str = "score",
                            eps: float = LOG_LOSS_EPS) -> DataFrame:
    """M4 (multiclass, long form): probabilities clipped then renormalised per
    row; loss = -mean(log p[true class])."""
    keys = _by(by)
    p = _probability(score, eps)
    per_row = scores.groupBy(*keys, row).agg(
        F.when(F.count(p) == F.count(F.lit(1)), F.sum(p)).alias("_s"),
        F.max(F.when(F.col(cls) == F.col(y), p)).alias("_pt"))
    ll = F.log(F.col("_pt") / F.col("_s"))
    return per_row.groupBy(*keys).agg(_loss_if_complete(ll).alias("neg_log_loss"),
                                      F.count(F.when(F.col("_s").isNull(), 1)).alias("n_invalid"))


# --------------------------------------------------------------------------- M5-M7
def neg_rmse(preds: DataFrame, by=("run_id",), y: str = "y_true", pred: str = "y_pred") -> DataFrame:
    keys = _by(by)
    return preds.groupBy(*keys).agg(
        (-F.sqrt(F.avg(F.pow(F.col(y) - F.col(pred), 2)))).alias("neg_rmse"))


def neg_mae(preds: DataFrame, by=("run_id",), y: str = "y_true", pred: str = "y_pred") -> DataFrame:
    keys = _by(by)
    return preds.groupBy(*keys).agg((-F.avg(F.abs(F.col(y) - F.col(pred)))).alias("neg_mae"))


def r2(preds: DataFrame, by=("run_id",), y: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """M7: 1 - SSres/SStot (SStot from the population variance, stable);
    a constant target gives 1 when perfect, else 0."""
    keys = _by(by)
    a = preds.groupBy(*keys).agg(
        F.sum(F.pow(F.col(y) - F.col(pred), 2)).alias("_ssr"),
        (F.var_pop(y) * F.count(y)).alias("_sst"))
    return a.select(*keys, F.when(F.col("_sst") > 0, 1 - F.col("_ssr") / F.col("_sst"))
                    .when(F.col("_ssr") == 0, 1.0).otherwise(0.0).alias("r2"))


# --------------------------------------------------------------------------- M8
def auc_ovr_macro(scores: DataFrame, by=("run_id",), y: str = "y_true", cls: str = "class_idx",
                  score: str = "score") -> DataFrame:
    """M8: mean over classes of the one-vs-rest AUC (long form input: one row
    per (row, class) with that class's score); null with invalid scores, which ``n_invalid`` counts."""
    keys = _by(by)
    x = scores.select(*keys, cls, (F.col(y) == F.col(cls)).cast("int").alias("_is"), F.col(score).alias("_s"))
    per = roc_auc(x, by=keys + [cls], y="_is", score="_s")
    return per.groupBy(*keys).agg(
        F.when(F.sum("n_invalid") == 0, F.avg("roc_auc")).alias("auc_ovr_macro"),
        F.count("roc_auc").alias("n_classes"), F.sum("n_invalid").alias("n_invalid"))


# --------------------------------------------------------------------------- M9
def normalize_score(raw: F.Column, baseline: F.Column, oracle: F.Column) -> F.Column:
    """M9: without baseline or oracle clamp raw to [0, 1]; equal bounds give a
    step at the oracle; else (raw - b) / (o - b) clamped."""
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return (F.when(raw.isNull(), F.lit(None).cast("double"))
            .when(baseline.isNull() | oracle.isNull(), clamp(raw))
            .when(oracle == baseline, F.when(raw >= oracle, 1.0).otherwise(0.0))
            .otherwise(clamp((raw - baseline) / (oracle - baseline))))


# --------------------------------------------------------------------------- M10
# Metric name -> (function, output column).
_BINARY = {"roc_auc", "accuracy", "f1", "log_loss"}


def compute_metric(preds: DataFrame, run_metrics: DataFrame, by=("run_id",), y: str = "y_true",
                   score: str = "y_score", threshold: float = 0.5, eps: float = LOG_LOSS_EPS) -> DataFrame:
    """The metric each run asks for (``run_metrics``: by-keys + metric),
    over one table mixing runs of different metrics. Three scans whatever the
    mix: one grouped aggregate computes the five moment-style metrics
    (accuracy, log loss, RMSE, MAE, R2) for every run at once and picks the
    run's own; F1 (confusion counts) and AUC (prefix sums) read only their
    runs. The run table is a plain join side: the planner broadcasts it if it is small.
    Output: keys, metric, value, n_invalid. A run with a row without a label or a number as its
    score has no value, except that accuracy and F1 count such a score as label 0."""
    keys = _by(by)
    x = preds.join(run_metrics.select(*keys, "metric"), keys)
    yy = F.col(y).cast("double")
    sc = F.col(score).cast("double")
    lab = hard_label(preds, score, threshold)
    p = _probability(score, eps)
    simple = x.groupBy(*keys, "metric").agg(
        F.avg((lab == F.col(y)).cast("double")).alias("_acc"),
        _loss_if_complete(yy * F.log(p) + (1 - yy) * F.log(1 - p)).alias("_ll"),
        F.avg(F.pow(yy - sc, 2)).alias("_mse"),
        F.avg(F.abs(yy - sc)).alias("_mae"),
        F.sum(F.pow(yy - sc, 2)).alias("_ssr"),
        (F.var_pop(yy) * F.count(yy)).alias("_sst"), F.count(F.when(~_valid(x, y, score), 1)).alias("n_invalid"))
    m = F.col("metric")
    value = (F.when(m == "accuracy", F.col("_acc")).when(F.col("n_invalid") > 0, None).when(m == "log_loss", F.col("_ll"))
             .when(m == "rmse", -F.sqrt("_mse")).when(m == "mae", -F.col("_mae"))
             .when(m == "r2", F.when(F.col("_sst") > 0, 1 - F.col("_ssr") / F.col("_sst"))
                   .when(F.col("_ssr") == 0, 1.0).otherwise(0.0)))
    simple = simple.where(m.isin("accuracy", "log_loss", "rmse", "mae", "r2")).select(
        *keys, "metric", value.alias("value"), "n_invalid")
    bad = x.where(m == "f1").groupBy(*keys).agg(F.count(F.when(~_valid(x, y, score), 1)).alias("n_invalid"))
    f1 = f1_macro(x.where(m == "f1"), keys, y, score, threshold).join(bad, keys).select(
        *keys, F.lit("f1").alias("metric"), F.col("f1_macro").alias("value"), "n_invalid")
    auc = roc_auc(x.where(m == "roc_auc"), keys, y, score).select(
        *keys, F.lit("roc_auc").alias("metric"), F.col("roc_auc").alias("value"), "n_invalid")
    return simple.unionByName(f1).unionByName(auc)
