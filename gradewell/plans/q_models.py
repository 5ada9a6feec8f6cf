"""Registered model-based queries (L1-L7), compared value by value. Boosted trees
run on features of two values each, so that however a tree is grown it can do
no more than order the rows by the label share of their group in the training rows: SQL
knows the score of that order. No feature holds the label."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradewell.operators import integrity as C
from gradewell.operators import models as L
from gradewell.plans import fixtures as X
from gradewell.plans.q_integrity import _split_sql
from gradewell.plans.q_metrics import _M10_BODY, _MIXED_SQL, _m10
from gradewell.plans.registry import query
from gradewell.sources.io import read_table

_LI_FEATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _lineitem_task(spark, sf_dir):
    """lineitem as a binary task: returned or not, numeric features."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"), *_LI_FEATS,
                     (F.col("l_returnflag") == "R").cast("int").alias("returned"))


def _split(spark, sf_dir):
    return C.stratified_split(_lineitem_task(spark, sf_dir), "row_id", "returned", hash_method="md5")


def _l1_sql(rows: str, feats: list[str], y: str) -> str:
    """Depth-2 trees on single features by window sums over (feature, value)."""
    long = "\nUNION ALL\n".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS v, {y} AS y FROM rows" for c in feats)

    def level(d: int, src: str) -> str:
        lk, ln = "b1 + k1", "b0 + b1 + k0 + k1"
        rk, rn = "t1 - b1 - k1", "t0 + t1 - b0 - b1 - k0 - k1"

        def imp(k, n):
            return (f"CASE WHEN ({n}) > 0 THEN ({n}) - ((({n}) - ({k})) * (({n}) - ({k})) + ({k}) * ({k})) / ({n}) ELSE 0.0 END")
        return f"""
s{d} AS (SELECT *, coalesce(sum(k0) OVER r, 0) AS b0, coalesce(sum(k1) OVER r, 0) AS b1, sum(k0) OVER p AS t0,
    sum(k1) OVER p AS t1, max(v) OVER p AS tv FROM {src}
  WINDOW r AS (PARTITION BY feature, node ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         p AS (PARTITION BY feature, node)),
c{d} AS (SELECT feature, node, arg_min(v, (round({imp(lk, ln)} + {imp(rk, rn)}, 6), v)) AS cut
  FROM s{d} WHERE v < tv GROUP BY feature, node),
g{d} AS (SELECT s.feature, s.v, k0, k1, s.node * 2 + CASE WHEN s.v > cut THEN 1 ELSE 0 END AS node
  FROM s{d} s LEFT JOIN c{d} c ON c.feature = s.feature AND c.node = s.node)"""
    return f"""WITH rows AS ({rows}), long AS ({long}),
g0 AS (SELECT feature, v, CAST(count(*) FILTER (WHERE y = 0) AS DOUBLE) AS k0,
    CAST(count(*) FILTER (WHERE y = 1) AS DOUBLE) AS k1, 0 AS node FROM long GROUP BY feature, v),{level(1, 'g0')},{level(2, 'g1')},
leaf AS (SELECT feature, sum(k1) / sum(k0 + k1) AS share, sum(k1) AS pos, sum(k0) AS neg FROM g2 GROUP BY feature, node),
l AS (SELECT feature, share, sum(pos) AS pos, sum(neg) AS neg FROM leaf GROUP BY feature, share),
b AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY feature ORDER BY share ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM l)
SELECT feature, round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 9) AS score,
  sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) >= 0.99 AS leak FROM b GROUP BY feature"""


_L1_ROWS = ("SELECT l_quantity, l_extendedprice, l_discount, l_tax, CAST(l_returnflag = 'R' AS INTEGER) AS returned, "
            "CAST(l_returnflag = 'R' AS INTEGER) + l_discount * 0.001 AS leaked FROM lineitem")


@query("l1_single_feature_leak", _l1_sql(_L1_ROWS, [*_LI_FEATS, "leaked"], "returned"))
def l1_single_feature_leak(spark, sf_dir):
    d = _lineitem_task(spark, sf_dir)
    d = d.withColumn("leaked", F.col("returned") + F.col("l_discount") * 0.001)   # target copy + noise
    return L.single_feature_leak(d.drop("row_id"), "returned", "binary_classification") \
        .withColumn("score", F.round("score", 9))


@query("l2_train_valid_gap", X.ctes(
    X.SQL_REGRESSION_PREDICTIONS,
    "sp AS (" + _split_sql("SELECT * FROM regression_predictions", "row_id", None).replace(
        "WITH b AS (", "WITH b AS (", 1) + ")",
    """m AS (SELECT run_id, split, CASE WHEN sst > 0 THEN 1 - ssr / sst WHEN ssr = 0 THEN 1.0 ELSE 0.0 END AS s
        FROM (SELECT run_id, split, sum(pow(y_true - y_pred, 2)) AS ssr, var_pop(y_true) * count(y_true) AS sst
              FROM sp WHERE split IN ('train', 'valid') GROUP BY run_id, split))""") + """
SELECT run_id, round(max(CASE WHEN split = 'train' THEN s END), 9) AS train_score,
  round(max(CASE WHEN split = 'valid' THEN s END), 9) AS valid_score,
  round(max(CASE WHEN split = 'train' THEN s END) - max(CASE WHEN split = 'valid' THEN s END), 9) AS gap,
  coalesce(max(CASE WHEN split = 'train' THEN s END) > 0.95
    AND max(CASE WHEN split = 'train' THEN s END) - max(CASE WHEN split = 'valid' THEN s END) > 0.3, false) AS flagged
FROM m GROUP BY run_id""")
def l2_train_valid_gap(spark, sf_dir):
    p = C.random_split(X.regression_predictions(spark, sf_dir), "row_id", hash_method="md5")
    g = L.train_valid_gap(p, "regression", score="y_pred")
    return g.select("run_id", *[F.round(c, 9).alias(c) for c in ["train_score", "valid_score", "gap"]], "flagged")


# A task whose label is drawn, by the digits of other keys, with a chance that depends on two
# features of two values each.
_DRAW = "(l_partkey * 7 + l_suppkey * 13 + l_orderkey) % 10"
_BIG = "(l_orderkey * 8 + l_linenumber) % 3 = 0"
_CHANCE = f"CASE WHEN {_BIG} THEN 6 ELSE 1 END + (l_linenumber % 2) * CASE WHEN {_BIG} THEN 3 ELSE 2 END"
_SIGNAL_COLS = {"row_id": "l_orderkey * 8 + l_linenumber", "odd": "CAST(l_linenumber % 2 AS INTEGER)",
                "tens": "CAST(l_linenumber % 2 * 10 AS INTEGER)", "big": f"CAST({_BIG} AS INTEGER)",
                "wanted": f"CAST({_DRAW} < {_CHANCE} AS INTEGER)"}
_SIGNAL_SQL = "sp AS (" + _split_sql("SELECT " + ", ".join(f"{e} AS {c}" for c, e in _SIGNAL_COLS.items()) + " FROM lineitem",
                                     "row_id", "wanted") + ")"


def _signal(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    rows = li.select(*[F.expr(e).alias(c) for c, e in _SIGNAL_COLS.items()])
    s = C.stratified_split(rows, "row_id", "wanted", hash_method="md5")
    return {k: s.where(F.col("split") == k).drop("split") for k in ("train", "valid", "test")}


def _group_auc(part: str, by: str) -> str:
    """AUC of the rows of ``part`` ordered by their group's label share in the training rows."""
    return f"""(SELECT sum(k1 * (below + k0 / 2.0)) / (sum(k1) * sum(k0)) FROM (
  SELECT *, coalesce(sum(k0) OVER (ORDER BY share ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (
    SELECT share, sum(wanted) AS k1, sum(1 - wanted) AS k0 FROM sp
    JOIN (SELECT {by}, avg(wanted) AS share FROM sp WHERE split = 'train' GROUP BY {by}) USING ({by})
    WHERE split = '{part}' GROUP BY share)))"""


@query("l3_baseline_gbt", f"WITH {_SIGNAL_SQL} SELECT 'roc_auc' AS metric, round({_group_auc('test', 'odd, big')}, 9) AS value, "
       "CAST(0 AS BIGINT) AS n_invalid")
def l3_baseline_gbt(spark, sf_dir):
    s = _signal(spark, sf_dir)
    v = L.baseline_gbt(s["train"], s["test"], "wanted", "binary_classification", "roc_auc", ["odd", "big"])
    return v.select("metric", F.round("value", 9).alias("value"), "n_invalid")


@query("l4_baseline_compare", X.ctes(_MIXED_SQL, X.SQL_TASKS, f"m10 AS ({_M10_BODY})") + """
SELECT run_id, metric, round(d, 9) AS diff,
  CASE WHEN value IS NULL THEN 'no_agent_metric' WHEN b IS NULL THEN 'no_baseline' WHEN d > 0.003 THEN 'better'
    WHEN d < -0.003 THEN 'worse' ELSE 'equal' END AS outcome,
  CAST(CASE WHEN value IS NOT NULL AND b IS NOT NULL AND d > 0.003 THEN 0.05 ELSE 0.0 END AS DOUBLE) AS bonus,
  CAST(CASE WHEN value IS NULL OR (b IS NOT NULL AND d < -0.003) THEN 0.15 ELSE 0.0 END AS DOUBLE) AS penalty
FROM (SELECT m10.*, t.baseline_score AS b, value - t.baseline_score AS d FROM m10 LEFT JOIN tasks t ON t.metric = m10.metric)""")
def l4_baseline_compare(spark, sf_dir):
    m = _m10(spark, sf_dir)
    t = X.tasks(spark, sf_dir).select("metric", "baseline_score")
    v = L.baseline_compare(F.col("value"), F.col("baseline_score"))
    return m.join(t, "metric", "left").select(
        "run_id", "metric", F.round(v["diff"], 9).alias("diff"), v["outcome"].alias("outcome"),
        v["bonus"].alias("bonus"), v["penalty"].alias("penalty"))


@query("l5_model_value_test", f"""WITH {_SIGNAL_SQL}, v AS (
SELECT {_group_auc('valid', 'odd, tens')} AS a, {_group_auc('valid', 'odd, big')} AS b)
SELECT round(a, 9) AS without, round(b, 9) AS with_agent, round(b - a, 9) AS gain FROM v""")
def l5_model_value_test(spark, sf_dir):
    """The agent's prediction knows what the features do not: it must add as much as SQL says."""
    s = _signal(spark, sf_dir)
    agent = s["train"].union(s["valid"]).select("row_id", F.col("big").cast("double").alias("y_score"))
    v = L.model_value_test(s["train"].drop("big"), s["valid"].drop("big"), agent, "wanted", "row_id", "binary_classification", "roc_auc")
    return v.select(*[F.round(c, 9).alias(c) for c in ("without", "with_agent", "gain")])


@query("l6_new_features_in_top_k", """
WITH imp AS (SELECT p_brand || '/' || p_type || '/' || p_size AS feature, sum(p_retailprice) AS importance FROM part GROUP BY 1),
top AS (SELECT *, row_number() OVER (ORDER BY importance DESC, feature) AS r, count(*) OVER () AS n FROM imp),
best AS (SELECT * FROM top WHERE r <= greatest(3, n // 3) AND NOT ends_with(feature, '/7'))
SELECT count(*) AS n_new_in_top, coalesce(string_agg(feature, ', ' ORDER BY feature), '') AS features,
  CAST(CASE WHEN count(*) > 0 THEN 0.03 ELSE 0.0 END AS DOUBLE) AS bonus,
  CAST((SELECT greatest(3, max(n) // 3) FROM top) AS INTEGER) AS top_k FROM best""")
def l6_new_features_in_top_k(spark, sf_dir):
    """On a logged importance table (parts stand for features, those of size 7 for the original columns)."""
    imp = read_table(spark, sf_dir, "part").groupBy(
        F.concat_ws("/", "p_brand", "p_type", F.col("p_size").cast("string")).alias("feature")).agg(
        F.sum("p_retailprice").alias("importance"))
    orig = imp.where(F.col("feature").endswith("/7")).select("feature")
    return L.new_features_in_top_k(imp, orig)


@query("l7_evaluate_model", f"""WITH {_SIGNAL_SQL}, v AS (SELECT {_group_auc('valid', 'odd, big')} AS a)
SELECT 'roc_auc' AS metric, round(a, 9) AS value, a >= 0.5 AS passed, round(least(1.0, a), 9) AS score, CAST(0.0 AS DOUBLE) AS penalty FROM v""")
def l7_evaluate_model(spark, sf_dir):
    s = _signal(spark, sf_dir)
    model = L.fit_pipeline(s["train"], "wanted", "binary_classification", ["odd", "big"], n_trees=20)
    v = L.evaluate_model(model, s["valid"], "wanted", "roc_auc", baseline=0.5)
    return v.select("metric", F.round("value", 9).alias("value"), "passed", F.round("score", 9).alias("score"), "penalty")
