"""Outcome checks on feature and prediction tables.

Schema-level checks (F2, F4, F6, F7) read only the schema; data-level checks
are one aggregate pass each. Penalties and thresholds are the reference's
defaults, exposed as keyword arguments.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradewell.functions.stats import clean, missing, numeric_columns
from gradewell.operators import profile as P


def _names(cols: list[str]) -> str:
    return ", ".join(cols)


def _numeric_no_bool(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


# ------------------------------------------------------------------ F1
def residual_missing(features: DataFrame, penalty: float = 0.12) -> DataFrame:
    """nulls/NaN still in the working table: total, columns (in table
    order), penalty."""
    cols = features.columns
    row = features.agg(*[F.sum(missing(features, c).cast("long")).alias(f"m{i}") for i, c in enumerate(cols)])
    arr = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("c"), F.coalesce(F.col(f"m{i}"), F.lit(0)).alias("m"))
                    for i, c in enumerate(cols)])
    with_m = F.filter(arr, lambda x: x["m"] > 0)
    total = F.aggregate(arr, F.lit(0).cast("long"), lambda a, x: a + x["m"])
    return row.select(
        total.alias("total_missing"), F.size(with_m).cast("long").alias("n_columns"),
        F.array_join(F.transform(with_m, lambda x: x["c"]), ", ").alias("columns"),
        F.when(total > 0, penalty).otherwise(0.0).alias("penalty"))


# ------------------------------------------------------------------ F2 / F7
def unencoded_columns(features: DataFrame, penalty: float = 0.10) -> DataFrame:
    """string columns left in the working table (raw categories)."""
    cols = [f.name for f in features.schema.fields if isinstance(f.dataType, T.StringType)]
    return features.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(cols)).cast("long").alias("n_unencoded"), F.lit(_names(cols)).alias("columns"),
        F.lit(penalty if cols else 0.0).alias("penalty"))


def non_numeric_features(x: DataFrame) -> DataFrame:
    """the feature matrix must be numeric; booleans count as non-numeric."""
    cols = [f.name for f in x.schema.fields if not isinstance(f.dataType, T.NumericType)]
    return x.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(cols)).cast("long").alias("n_non_numeric"), F.lit(_names(cols)).alias("columns"))


# ------------------------------------------------------------------ F3
def scale_check(features: DataFrame, threshold: float = 100.0, penalty: float = 0.05) -> DataFrame:
    """max std / min std over numeric columns above ``threshold``."""
    r = P.scale_range_ratio(features, columns=_numeric_no_bool(features))
    return r.select("scale_range_ratio", (F.col("scale_range_ratio") > threshold).alias("flagged"),
                    F.when(F.col("scale_range_ratio") > threshold, penalty).otherwise(0.0).alias("penalty"))


# ------------------------------------------------------------------ F4 (uses C7)
def no_feature_work(original_columns: list[str], features: DataFrame, penalty: float = 0.05) -> DataFrame:
    """no new and no dropped column while more than 3 originals."""
    cur = set(features.columns)
    orig = set(original_columns)
    new, dropped = sorted(cur - orig), sorted(orig - cur)
    flagged = not new and not dropped and len(orig) > 3
    return features.sparkSession.createDataFrame(
        [(len(new), len(dropped), flagged, penalty if flagged else 0.0)],
        "n_new long, n_dropped long, flagged boolean, penalty double")


# ------------------------------------------------------------------ F5
def skew_remaining(features: DataFrame, skewed_columns: list[str], threshold: float = 2.0) -> DataFrame:
    """of the originally skewed columns still present, how many remain
    |G1| > threshold (no minimum count, as the reference)."""
    present = [c for c in skewed_columns if c in features.columns]
    if not present:
        return features.sparkSession.createDataFrame(
            [(len(skewed_columns), 0, 0)], "n_skewed_before long, n_present long, n_still_skewed long")
    aggs = []
    for c in present:
        v = clean(features, c)
        aggs += [F.count(v).alias(f"n_{c}"), F.skewness(v).alias(f"g_{c}")]
    row = features.agg(*aggs)
    flags = [F.coalesce(F.abs(P.sample_skewness(F.col(f"g_{c}"), F.col(f"n_{c}").cast("double"))) > threshold,
                        F.lit(False)).cast("long") for c in present]
    return row.select(F.lit(len(skewed_columns)).cast("long").alias("n_skewed_before"),
                      F.lit(len(present)).cast("long").alias("n_present"),
                      sum(flags, F.lit(0).cast("long")).alias("n_still_skewed"))


# ------------------------------------------------------------------ F6
def datetime_strings_left(features: DataFrame, datetime_cols: list[str]) -> DataFrame:
    """date-like columns (P9) still typed as strings."""
    left = [c for c in datetime_cols if c in features.columns
            and isinstance(features.schema[c].dataType, T.StringType)]
    return features.sparkSession.createDataFrame([(c,) for c in left], "column_name string")


# ------------------------------------------------------------------ F8
def remaining_duplicates(features: DataFrame, target: str, mentioned: bool = False,
                         penalty: float = 0.08) -> DataFrame:
    """F8: duplicate feature rows left after processing; full penalty when
    never mentioned, half when mentioned but left."""
    d = P.duplicate_count(features, target)
    pen = F.when(F.col("duplicate_count") > 0, F.lit(penalty * 0.5 if mentioned else penalty)).otherwise(0.0)
    return d.select("duplicate_count", pen.alias("penalty"))


# ------------------------------------------------------------------ F9
GROUP_ROWS = 20_000        # rows of a group that one task compares
FEW = 48                   # rows of a group up to which all its pairs are compared
NARROW = 8                 # columns up to which a hash for every subset is the smaller row


def near_duplicates(df: DataFrame, columns: list[str] | None = None, max_diff: int = 2,
                    group_rows: int = GROUP_ROWS, narrow: int = NARROW) -> DataFrame:
    """number of row pairs that differ in 1..max_diff of the numeric
    columns, NaN/null never equal. Exact, without emitting pairs.

    The columns are cut into max_diff + 1 blocks: a pair that differs in at most
    max_diff columns agrees on one block entirely. A row (equal rows once, with their number)
    is sent once a block, as one hash a column, to the rows that agree with it there, and a pair counts in the
    first block it agrees on. In a group, the pairs whose differing columns are exactly D are
    counted by inclusion-exclusion over the subsets of D. A group of more than
    ``group_rows`` rows is counted apart by :func:`_by_subsets`, spread over the cluster; so are all
    rows of a table of at most ``narrow`` columns. Entries a row are linear in the columns. Pair
    counts are decimals: n(n-1)/2 leaves BIGINT behind."""
    cols = columns or numeric_columns(df)
    k = len(cols)
    cells = [F.when(clean(df, c).isNotNull(), F.xxhash64(F.lit(i), clean(df, c))) for i, c in enumerate(cols)]
    rows = df.select(F.array(*cells).alias("v"), F.lit(1).cast("long").alias("n")) if cols else df.limit(0).select(
        F.array().cast("array<long>").alias("v"), F.lit(1).cast("long").alias("n"))
    if k <= max(max_diff, narrow) or max_diff < 1:
        return _by_subsets(rows, k, _differing(k, max_diff, 0, []))
    # a row with a missing value is equal to no other: it keeps its own place
    own = F.when(F.exists("v", lambda x: x.isNull()), F.monotonically_increasing_id())
    rows = rows.withColumn("own", own).groupBy("v", "own").agg(F.sum("n").alias("n"))
    blocks = [list(range(b, k, max_diff + 1)) for b in range(max_diff + 1)]
    at = lambda ids: [F.col("v")[i] for i in ids]
    sent = rows.select("v", "n", F.explode(F.array(*[
        F.when(reduce(lambda a, x: a & x.isNotNull(), at(ids), F.lit(True)), F.struct(
            F.lit(b).alias("block"), F.xxhash64(F.lit(b), *at(ids)).alias("g"), F.xxhash64(F.lit(b + 7919), *at(ids)).alias("h")))
        for b, ids in enumerate(blocks)])).alias("e")).where("e is not null").select("v", "n", "e.*")
    key = ["block", "g", "h"]
    crowded = sent.groupBy(*key).agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > group_rows).drop("m")
    plain = sent.join(crowded, key, "left_anti").repartition(*key).sortWithinPartitions(*key)
    wanted = [_differing(k, max_diff, b, blocks) for b in range(len(blocks))]
    counted = plain.mapInArrow(_count_groups(wanted), "pairs string").select(F.col("pairs").cast("decimal(38,0)").alias("p"))
    hot = sent.join(crowded, key)
    for b, ds in enumerate(wanted):
        counted = counted.union(_by_subsets(hot.where(F.col("block") == b), k, ds, ["g", "h"]).select(
            F.col("near_duplicate_pairs").cast("decimal(38,0)").alias("p")))
    return counted.agg(F.coalesce(F.sum("p"), F.lit(0)).cast("long").alias("near_duplicate_pairs"))


def _differing(k: int, max_diff: int, block: int, blocks: list[list[int]]) -> list[tuple]:
    """The sets D of differing columns whose pairs count in ``block``: they leave it alone and touch every block before."""
    mine = set(blocks[block]) if blocks else set()
    return [d for r in range(1, max_diff + 1) for d in combinations([i for i in range(k) if i not in mine], r)
            if all(set(blocks[b]) & set(d) for b in range(block))]


def _weights(ds: list[tuple]) -> dict[tuple, int]:
    """How often the pairs equal outside S count, for the pairs that differ in exactly one of ``ds``."""
    coef: dict[tuple, int] = {}
    for d in ds:
        for r in range(len(d) + 1):
            for s in combinations(d, r):
                coef[s] = coef.get(s, 0) + (-1) ** (len(d) - r)
    return {s: c for s, c in coef.items() if c}


def _by_subsets(rows: DataFrame, k: int, ds: list[tuple], within: list[str] | None = None) -> DataFrame:
    """The pairs of ``rows`` (v, n), equal in ``within``, that differ in exactly one of ``ds``: each row
    becomes one 128-bit hash for every S, counted with map-side combine."""
    coef = _weights(ds)
    if not coef:
        return rows.sparkSession.range(1).select(F.lit(0).cast("long").alias("near_duplicate_pairs"))
    used = list(coef)

    def entry(j: int, s: tuple) -> F.Column:
        keep = [F.col("v")[i] for i in range(k) if i not in s]
        whole = reduce(lambda a, x: a & x.isNotNull(), keep, F.lit(True))
        return F.when(whole, F.struct(F.lit(j).alias("s"), F.xxhash64(F.lit(j), *keep).alias("a"),
                                      F.xxhash64(F.lit(j + 1_000_003), *keep).alias("b")))
    within = within or []
    x = rows.select(*within, "n", F.explode(F.filter(F.array(*[entry(j, s) for j, s in enumerate(used)]),
                                                     lambda e: e.isNotNull())).alias("e")).select(*within, "n", "e.*")
    n = F.sum(F.col("n").cast("decimal(19,0)")).cast("decimal(19,0)")
    pairs = x.groupBy(*within, "s", "a", "b").agg(n.alias("n")).groupBy("s").agg(
        F.sum((F.col("n") * (F.col("n") - 1) / 2).cast("decimal(38,0)")).alias("p"))
    weight = F.element_at(F.array(*[F.lit(coef[s]) for s in used]), F.col("s") + 1)
    return pairs.agg(F.coalesce(F.sum(F.col("p") * weight), F.lit(0)).cast("long").alias("near_duplicate_pairs"))


def _count_groups(wanted: list[list[tuple]]):
    import numpy as np
    import pyarrow as pa
    plans = [(_weights(ds), {frozenset(d) for d in ds}) for ds in wanted]

    def group(block: int, v: np.ndarray, n: np.ndarray) -> int:
        """The weighted pairs of one group: rows of column hashes ``v`` (NaN-free, unique where missing), ``n`` rows each."""
        coef, exact = plans[block]
        if len(v) <= FEW:
            total = 0
            for step in range(1, len(v)):
                differ = v[step:] != v[:-step]
                for j in np.flatnonzero((differ.sum(axis=1) <= max(map(len, exact), default=0))):
                    if frozenset(np.flatnonzero(differ[j]).tolist()) in exact:
                        total += int(n[j]) * int(n[j + step])
            return total
        with np.errstate(over="ignore"):
            mixed = v.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed = mixed * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(32)
            whole, total = mixed.sum(axis=1, dtype=np.uint64), 0
            for s, c in coef.items():
                left = whole - mixed[:, list(s)].sum(axis=1, dtype=np.uint64)
                _, inverse = np.unique(left, return_inverse=True)
                size = np.bincount(inverse, weights=n).astype(np.int64)
                total += c * sum(m * (m - 1) // 2 for m in size[size > 1].tolist())
        return total

    def count(batches):
        held, own = None, 0
        total = 0

        def close(rows) -> int:
            block, vs, ns = rows
            return group(block, np.array(vs, np.int64), np.array(ns, np.int64)) if len(vs) > 1 else 0
        for t in batches:
            for block, g, h, v, n in zip(*(t.column(c).to_pylist() for c in ("block", "g", "h", "v", "n"))):
                if None in v:                                   # a missing value equals nothing
                    own += 1
                    v = [own * 65_536 + j if x is None else x for j, x in enumerate(v)]
                if held is None or held[0] != (block, g, h):
                    if held is not None:
                        total += close(held[1])
                    held = (block, g, h), (block, [], [])
                held[1][1].append(v)
                held[1][2].append(n)
        if held is not None:
            total += close(held[1])
        yield pa.RecordBatch.from_arrays([pa.array([str(total)])], names=["pairs"])
    return count


# ------------------------------------------------------------------ F10-F12
def prediction_length(preds: DataFrame, expected: DataFrame, key: str | list[str]) -> DataFrame:
    """predictions vs expected rows by key: counts, missing and extra."""
    keys = [key] if isinstance(key, str) else list(key)
    p = preds.select(*keys).distinct().withColumn("_p", F.lit(1))
    e = expected.select(*keys).distinct().withColumn("_e", F.lit(1))
    j = p.join(e, keys, "full_outer")
    n_pred = preds.agg(F.count(F.lit(1)).alias("n_predictions"))
    n_exp = expected.agg(F.count(F.lit(1)).alias("n_expected"))
    c = j.agg(F.sum(F.when(F.col("_p").isNotNull() & F.col("_e").isNotNull(), 1).otherwise(0)).cast("long").alias("n_matched"),
              F.sum(F.when(F.col("_p").isNull(), 1).otherwise(0)).cast("long").alias("n_missing"),
              F.sum(F.when(F.col("_e").isNull(), 1).otherwise(0)).cast("long").alias("n_extra"))
    return n_pred.crossJoin(n_exp).crossJoin(c).withColumn(   # three one-row aggregates
        "length_ok", (F.col("n_predictions") == F.col("n_expected")) & (F.col("n_missing") == 0)
        & (F.col("n_extra") == 0))


def prediction_finite(preds: DataFrame, col: str = "y_score") -> DataFrame:
    """NaN count, non-finite count (NaN included) and null count. The
    reference prints a bit-flipped non-finite count; we report the true one."""
    v = F.col(col).cast("double")
    nan = F.isnan(v)
    inf = v.isin(float("inf"), float("-inf"))
    return preds.agg(F.count(F.lit(1)).alias("n_rows"),
                     F.sum(F.coalesce(nan, F.lit(False)).cast("long")).alias("nan_count"),
                     F.sum(F.coalesce(nan | inf, F.lit(False)).cast("long")).alias("non_finite_count"),
                     F.sum(v.isNull().cast("long")).alias("null_count")) \
        .withColumn("finite_ok", (F.col("non_finite_count") == 0) & (F.col("null_count") == 0))


def predictions_match(a: DataFrame, b: DataFrame, key: str | list[str], col: str = "y_pred",
                      rtol: float = 1e-5, atol: float = 1e-6, penalty: float = 0.15) -> DataFrame:
    """two prediction tables agree row by row (|a-b| <= atol + rtol*|b|,
    NaN equals NaN); rows present on one side only count as mismatches."""
    keys = [key] if isinstance(key, str) else list(key)
    x = a.select(*keys, F.col(col).alias("_a")).join(b.select(*keys, F.col(col).alias("_b")), keys, "full_outer")
    both_nan = F.isnan("_a") & F.isnan("_b")
    close = F.abs(F.col("_a") - F.col("_b")) <= atol + rtol * F.abs(F.col("_b"))
    ok = F.coalesce(both_nan | close, F.lit(False))
    g = x.agg(F.count(F.lit(1)).alias("n_compared"), F.sum((~ok).cast("long")).alias("n_mismatch"))
    return g.select("n_compared", F.coalesce("n_mismatch", F.lit(0)).alias("n_mismatch"),
                    (F.coalesce("n_mismatch", F.lit(0)) == 0).alias("all_match"),
                    F.when(F.coalesce("n_mismatch", F.lit(0)) == 0, 0.0).otherwise(penalty).alias("penalty"))


# ------------------------------------------------------------------ F13
def prediction_score_vs_baseline(metric_value: F.Column, baseline: F.Column, min_above: float = 0.0) -> F.Column:
    """struct(passed, score, penalty) of a valid-set metric against the
    task baseline (missing baseline = 0)."""
    delta = metric_value - F.coalesce(baseline, F.lit(0.0))
    fail = delta < min_above
    return F.struct((~fail).alias("passed"),
                    F.when(fail, F.greatest(F.lit(0.0), 0.5 + delta)).otherwise(F.least(F.lit(1.0), 0.5 + delta)).alias("score"),
                    F.when(fail, 0.05).otherwise(0.0).alias("penalty"))


# ------------------------------------------------------------------ F14
def feature_pipeline(features: DataFrame, original_columns: list[str], skewed_columns: list[str],
                     datetime_cols: list[str], *, nan_penalty: float = 0.12, unencoded_penalty: float = 0.10,
                     scale_penalty: float = 0.05, no_fe_penalty: float = 0.05,
                     scale_threshold: float = 100.0) -> DataFrame:
    """the feature-pipeline verdict from F1-F6: score = 1 - penalty,
    pass when no issue (skew is a bonus note only; date strings are an issue
    without penalty)."""
    f1 = residual_missing(features, nan_penalty).select(F.col("total_missing"), F.col("penalty").alias("p1"))
    f2 = unencoded_columns(features, unencoded_penalty).select(F.col("n_unencoded"), F.col("penalty").alias("p2"))
    f3 = scale_check(features, scale_threshold, scale_penalty).select(F.col("flagged").alias("scale_flag"),
                                                                     F.col("penalty").alias("p3"))
    f4 = no_feature_work(original_columns, features, no_fe_penalty).select(F.col("flagged").alias("no_fe"),
                                                                          F.col("penalty").alias("p4"))
    f5 = skew_remaining(features, skewed_columns).select("n_still_skewed")
    n_dt = len([c for c in datetime_cols if c in features.columns
                and isinstance(features.schema[c].dataType, T.StringType)])
    row = f1.crossJoin(f2).crossJoin(f3).crossJoin(f4).crossJoin(f5)   # one-row parts
    pen = F.col("p1") + F.col("p2") + F.col("p3") + F.col("p4")
    issues = (F.col("total_missing") > 0) | (F.col("n_unencoded") > 0) | F.col("scale_flag") | F.col("no_fe") \
        | F.lit(n_dt > 0)
    return row.select(F.lit("feature_pipeline").alias("validator"), (~issues).alias("passed"),
                      F.greatest(F.lit(0.0), 1 - pen).alias("score"), pen.alias("penalty"),
                      "total_missing", "n_unencoded", "n_still_skewed")
