import itertools
import math
import random

from pyspark.sql import functions as F

from gradewell.operators import checks as K


def _brute(rows, max_diff=2):
    n = 0
    for a, b in itertools.combinations(rows, 2):
        d = sum(1 for x, y in zip(a, b) if x is None or y is None or (isinstance(x, float) and math.isnan(x))
                or (isinstance(y, float) and math.isnan(y)) or x != y)
        n += 0 < d <= max_diff
    return n


def test_near_duplicates_exact(spark):
    rnd = random.Random(5)
    rows = [(float(rnd.randint(0, 2)), float(rnd.randint(0, 2)), rnd.choice([1.0, 2.0, float("nan")]),
             float(rnd.randint(0, 1))) for _ in range(120)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = K.near_duplicates(df, ["a", "b", "c", "d"]).first()[0]
    assert got == _brute(rows)


def test_near_duplicates_count_every_pair(spark):
    big = spark.range(700).selectExpr("cast(id as double) as a", "2.0D as b", "3.0D as c")
    assert K.near_duplicates(big, ["a", "b", "c"]).first()[0] == 700 * 699 // 2
    assert K.near_duplicates(big.limit(0), ["a", "b", "c"]).first()[0] == 0


def test_prediction_checks(spark):
    preds = spark.createDataFrame([(1, 0.5), (2, float("nan")), (3, float("inf")), (9, None)], "k long, y_score double")
    exp = spark.createDataFrame([(1,), (2,), (3,), (4,)], "k long")
    ln = K.prediction_length(preds, exp, "k").first()
    assert (ln["n_matched"], ln["n_missing"], ln["n_extra"], ln["length_ok"]) == (3, 1, 1, False)
    fin = K.prediction_finite(preds).first()
    assert (fin["nan_count"], fin["non_finite_count"], fin["null_count"]) == (1, 2, 1)
    a = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, 100000.0)], "k long, y_pred double")
    b = spark.createDataFrame([(1, 1.0000005), (2, float("nan")), (3, 100000.9)], "k long, y_pred double")
    m = K.predictions_match(a, b, "k").first()
    assert m["all_match"] and m["penalty"] == 0.0


def test_feature_pipeline_verdict(spark):
    df = spark.createDataFrame([(1.0, None, "x", 1000.0), (2.0, 1.0, "y", 2000.0), (3.0, 2.0, "z", 5000.0)],
                               "a double, b double, s string, big double")
    v = K.feature_pipeline(df, ["a", "b", "s", "big"], [], []).first()
    # residual NaN .12 + unencoded .10 + scale .05 + no feature work .05
    assert not v["passed"] and math.isclose(v["penalty"], 0.32) and math.isclose(v["score"], 0.68)


def test_single_feature_leak_any_width(spark):
    """Rare labels and many columns go the same way; string labels are labels."""
    from gradewell.operators import models as L
    rows = [(float(i % 10), int(i % 10 == 7 and i // 10 % 5 < 2), float((i * 37) % 101)) for i in range(2000)]
    df = spark.createDataFrame(rows, "rare double, y int, noise double")
    narrow = {r["feature"]: r["score"] for r in L.single_feature_leak(df, "y", "binary_classification").collect()}
    assert math.isclose(narrow["rare"], 1 - 120 / 1920 / 2, rel_tol=1e-9)      # 80 of the 200 sevens are positive
    wide = df.select("*", *[(F.col("noise") + i).alias(f"w{i}") for i in range(60)])
    again = {r["feature"]: r["score"] for r in L.single_feature_leak(wide, "y", "binary_classification").collect()}
    assert again["rare"] == narrow["rare"] and len(again) == 62
    words = df.withColumn("y", F.when(F.col("y") == 1, "yes").otherwise("no"))
    assert {r["feature"]: r["score"] for r in L.single_feature_leak(words, "y", "binary_classification").collect()} == narrow
    one = spark.createDataFrame([(float(i), int(i == 1234)) for i in range(2000)], "id double, y int")
    r = L.single_feature_leak(one, "y", "binary_classification").first()
    assert r["leak"] and r["score"] > 0.99


def test_single_feature_leak_flags_copy(spark):
    from gradewell.operators import models as L
    rnd = random.Random(11)
    rows = []
    for i in range(400):
        y = rnd.randint(0, 1)
        rows.append((y + 0.001 * rnd.random(), rnd.random(), float(rnd.randint(0, 5)), y))
    df = spark.createDataFrame(rows, "leaked double, noise double, small double, y int")
    out = {r["feature"]: r for r in L.single_feature_leak(df, "y", "binary_classification").collect()}
    assert out["leaked"]["leak"] and out["leaked"]["score"] > 0.99
    assert not out["noise"]["leak"] and not out["small"]["leak"]
    reg = spark.createDataFrame([(float(i), float(i % 7), float(i)) for i in range(300)], "a double, b double, t double")
    r = {x["feature"]: x["score"] for x in L.single_feature_leak(reg, "t", "regression").collect()}
    assert r["a"] > 0.9 and r["b"] < 0.5


def test_wide_near_duplicates_equal_all_pairs(spark):
    """Three blocks of columns, missing values, repeated rows; crowded groups counted apart."""
    import random
    from itertools import combinations
    rnd = random.Random(3)
    k = 9
    rows = []
    for _ in range(130):
        r = list(rnd.choice(rows)) if rows and rnd.random() < 0.7 else [rnd.randrange(3) for _ in range(k)]
        for _ in range(rnd.randrange(3)):
            r[rnd.randrange(k)] = rnd.choice([0, 1, 2, None])
        rows.append(tuple(r))
    rows += rows[:9]
    differ = lambda a, b: sum(x is None or y is None or x != y for x, y in zip(a, b))
    want = sum(1 <= differ(a, b) <= 2 for a, b in combinations(rows, 2))
    df = spark.createDataFrame(rows, ", ".join(f"c{i} int" for i in range(k))).repartition(3)
    assert want > 100
    for group_rows in (20_000, 60, 5):
        assert K.near_duplicates(df, group_rows=group_rows).first()[0] == want
    assert K.near_duplicates(df, narrow=k).first()[0] == want
    assert K.near_duplicates(df, max_diff=1).first()[0] == sum(differ(a, b) == 1 for a, b in combinations(rows, 2))


def test_single_feature_leak_many_classes(spark):
    """Classes are rows: the splits and scores equal plain depth-2 Gini trees, whatever the number of labels."""
    from gradewell.operators import models as L
    rnd = random.Random(8)

    def impurity(ys):
        return len(ys) - sum(ys.count(c) ** 2 for c in set(ys)) / len(ys) if ys else 0.0

    def grow(rows, depth):
        if depth == 0 or len({v for v, _ in rows}) < 2:
            return [rows]
        cut = min((round(impurity([y for v, y in rows if v <= c]) + impurity([y for v, y in rows if v > c]), 6), c)
                  for c in sorted({v for v, _ in rows})[:-1])[1]
        return grow([r for r in rows if r[0] <= cut], depth - 1) + grow([r for r in rows if r[0] > cut], depth - 1)

    def score(rows):
        leaves, classes = grow(rows, 2), sorted({y for _, y in rows})
        judged = classes[1:] if len(classes) == 2 else classes
        aucs = []
        for c in judged:
            at = [(sum(y == c for _, y in leaf) / len(leaf), y == c) for leaf in leaves for _, y in leaf]
            pos, neg = [s for s, p in at if p], [s for s, p in at if not p]
            aucs.append(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg))
        return sum(aucs) / len(aucs)
    for n in (2, 5, 40):
        rows = [(float(rnd.randrange(25)), rnd.randrange(n)) for _ in range(240)]
        rows = [(v, f"c{y}", v * 2 + y % 3) for v, y in rows]
        df = spark.createDataFrame(rows, "a double, y string, b double")
        got = {r["feature"]: r["score"] for r in L.single_feature_leak(df, "y", "multiclass").collect()}
        assert math.isclose(got["a"], score([(a, y) for a, y, _ in rows]), rel_tol=1e-9)
        assert math.isclose(got["b"], score([(b, y) for _, y, b in rows]), rel_tol=1e-9)
    one = spark.createDataFrame([(float(i), "x") for i in range(20)], "a double, y string")
    assert [(r["score"], r["leak"]) for r in L.single_feature_leak(one, "y", "multiclass").collect()] == [(None, False)]
