import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gradewell.functions.stats import exact_quantiles
from gradewell.operators import profile as P


def _df(spark, pdf):
    return spark.createDataFrame(pdf)


def test_missing_profile_recommendations(spark):
    # 100 rows, 85 missing -> drop_column; a clean column is not reported
    rows = [(None if i < 85 else float(i), float(i), i % 2) for i in range(100)]
    df = spark.createDataFrame(rows, "bad_col double, good_col double, target int")
    out = {r["column_name"]: r for r in P.missing_profile(df, "target").collect()}
    assert set(out) == {"bad_col"}
    assert out["bad_col"]["missing_count"] == 85
    assert out["bad_col"]["recommend"] == "drop_column"


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(float("nan"), "a", 0), (1.0, None, 1), (2.0, "b", 0)], "x double, s string, t int")
    out = {r["column_name"]: r["missing_count"] for r in P.missing_profile(df, "t").collect()}
    assert out == {"x": 1, "s": 1}
    assert {r["column_name"]: r["recommend"] for r in P.missing_profile(df, "t").collect()} == {
        "x": "fill_median", "s": "fill_mode"}


def test_correlated_pair_found(spark):
    rnd = random.Random(0)
    a = [rnd.gauss(0, 1) for _ in range(200)]
    rows = [(x, x + 0.01 * rnd.gauss(0, 1), rnd.gauss(0, 1), i % 2) for i, x in enumerate(a)]
    df = spark.createDataFrame(rows, "feat_a double, feat_b double, feat_c double, target int")
    pairs = [(r["col_a"], r["col_b"]) for r in P.high_corr_pairs(df, "target").collect()]
    assert pairs == [("feat_a", "feat_b")]


def test_iqr_outliers_match_pandas(spark):
    rnd = random.Random(1)
    vals = [rnd.gauss(10, 2) for _ in range(200)]
    for i in range(20):
        vals[i] *= 100
    df = spark.createDataFrame([(v, i % 2) for i, v in enumerate(vals)], "feature double, target int")
    out = P.iqr_outliers(df, "target").collect()
    s = pd.Series(vals)
    q1, q3 = s.quantile(0.25), s.quantile(0.75)
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    n = int(((s < lo) | (s > hi)).sum())
    assert len(out) == 1 and out[0]["outlier_count"] == n
    assert math.isclose(out[0]["lower_bound"], lo, rel_tol=1e-12)


def test_exact_quantiles_refinement_path(spark):
    rnd = np.random.default_rng(7)
    vals = rnd.exponential(3.0, 5000)
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    q = exact_quantiles(df, ["v"], [0.25, 0.5, 0.75])["v"]
    assert np.allclose(q, np.percentile(vals, [25, 50, 75]), rtol=0, atol=1e-12)


def test_skew_is_bias_adjusted(spark):
    vals = [1, 1, 1, 2, 2, 3, 4, 8, 20, 50, 120, 400]
    df = spark.createDataFrame([(float(v), 0) for v in vals], "x double, t int")
    out = P.skewed_columns(df, "t").collect()
    assert len(out) == 1
    assert math.isclose(out[0]["skewness"], pd.Series(vals, dtype=float).skew(), rel_tol=1e-9)


def test_duplicates_and_class_imbalance(spark):
    rows = [(float(i), float(i % 7), i % 3) for i in range(100)] + [(float(i), float(i % 7), 1) for i in range(10)]
    df = spark.createDataFrame(rows, "a double, b double, target int")
    assert P.duplicate_count(df, "target").first()["duplicate_count"] == 10
    imb = P.class_imbalance(df, "target").first()
    pdf = pd.DataFrame(rows, columns=["a", "b", "target"])
    vc = pdf["target"].value_counts()
    assert math.isclose(imb["class_imbalance_ratio"], vc.iloc[-1] / vc.iloc[0])


def test_profile_table_summary(spark):
    rows = [(float(i), None if i % 4 == 0 else float(i * 2), "2024-01-%02d" % (1 + i % 28), i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "x double, y double, d string, t int")
    prof = P.profile_table(df, "t")
    s = prof.summary.first()
    assert s["n_rows"] == 60 and s["n_cols"] == 4 and s["n_numeric"] == 2 and s["n_categorical"] == 1
    assert s["has_missing"] and s["n_high_corr_pairs"] == 1
    assert [r["column_name"] for r in prof.datetime_cols.collect()] == ["d"]


def test_impute_and_encode(spark):
    train = spark.createDataFrame([(1.0, "b"), (3.0, "a"), (None, "b"), (10.0, None)], "x double, c string")
    filled = P.impute_fill(train, train, ["x", "c"]).orderBy(F.col("x")).collect()
    assert [r["x"] for r in filled] == [1.0, 3.0, 3.0, 10.0]          # median of 1, 3, 10
    assert sorted(r["c"] for r in filled) == ["a", "b", "b", "b"]        # mode fills the null
    enc = P.encode_categorical(train, train, ["c"]).collect()
    assert sorted((r["c"] for r in enc), key=lambda v: (v is None, v)) == [0, 1, 1, None]


def test_label_encoder_skew_safe_equals_window(spark):
    df = spark.createDataFrame([(f"v{i % 37}", f"w{i % 5}") for i in range(500)], "a string, b string")
    m1 = {(r["column_name"], r["value"]): r["code"] for r in P.fit_label_encoder(df, ["a", "b"], skew_safe=False).collect()}
    m2 = {(r["column_name"], r["value"]): r["code"] for r in P.fit_label_encoder(df, ["a", "b"], skew_safe=True).collect()}
    assert m1 == m2 and len(m1) == 42


def test_exact_quantiles_of_large_integers(spark):
    big = 2**53 + 1
    df = spark.createDataFrame([(big + 2 * i,) for i in range(5)], "v long")
    assert exact_quantiles(df, ["v"], [0.0, 0.5, 1.0])["v"] == [big, big + 4, big + 8]


def test_integer_median_between_two_values(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "v long")
    assert sorted(r.v for r in P.impute_fill(df, df, ["v"]).collect()) == [1.0, 1.5, 2.0]


def test_dates_need_every_value(spark):
    rows = [("2024-01-%02d" % (1 + i % 28), "01/02/2020", "2020-01-01" if i < 21 else "garbage", i) for i in range(40)]
    df = spark.createDataFrame(rows, "iso string, us string, mixed string, t int")
    assert sorted(r.column_name for r in P.datetime_like(df, "t").collect()) == ["iso", "us"]


def test_exact_quantiles_heavy_repeats(spark):
    vals = [0.0] * 3000 + [float(i) for i in range(1, 200)]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    q = exact_quantiles(df, ["v"], [0.25, 0.5, 0.99])["v"]
    assert np.allclose(q, np.percentile(vals, [25, 50, 99]), rtol=0, atol=1e-9)


def test_correlations_of_a_wide_table_in_one_scan(spark):
    """Three blocks of columns with missing and infinite values, against numpy pair by pair."""
    import numpy as np
    from gradewell.functions.comoments import correlations
    rng = np.random.default_rng(1)
    k, n = 150, 120
    x = rng.normal(size=(n, k)) + 1e6 * (np.arange(k) % 3 == 0)
    x[:, 70] = x[:, 3] * 2 - 5
    x[:, 140] = -x[:, 70] + rng.normal(scale=1e-3, size=n)
    x[rng.random((n, k)) < 0.1] = np.nan
    x[5, 20] = np.inf
    names = [f"c{i}" for i in range(k)]
    df = spark.createDataFrame([tuple(None if np.isnan(v) and i % 2 else float(v) for v in r) for i, r in enumerate(x)],
                               ", ".join(f"{c} double" for c in names)).repartition(7)
    found = correlations(df, names, 0.25)
    assert found._jdf.queryExecution().executedPlan().toString().count("Scan") == 1
    got = {(r.col_a, r.col_b): r.r for r in found.collect()}
    want = {}
    for i in range(k):
        for j in range(i + 1, k):
            m = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            if np.isfinite(x[m][:, [i, j]]).all():
                r = np.corrcoef(x[m, i], x[m, j])[0, 1]
                if abs(r) >= 0.25:
                    want[names[i], names[j]] = r
    assert got.keys() == want.keys() and len(want) > 50
    assert max(abs(got[p] - want[p]) for p in want) < 1e-7
    assert ("c3", "c70") in got and ("c70", "c140") in got
