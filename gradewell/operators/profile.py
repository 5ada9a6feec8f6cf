"""Data-quality profile of a wide table.

Every statistic over columns is one wide aggregate (one scan, map-side
partial aggregation) whose single row is unpivoted into a long table; no
per-column job loops. Thresholds are keyword arguments with the reference's
defaults. Numeric = Spark ``NumericType``; everything else is categorical.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gradewell.functions.comoments import correlations
from gradewell.functions.stats import (
    categorical_columns, clean, exact_quantiles, is_float_col, missing,
    numeric_columns, sample_skewness)

def _spark(df: DataFrame):
    return df.sparkSession


def features_of(df: DataFrame, target: str) -> list[str]:
    return [c for c in df.columns if c != target]


# --------------------------------------------------------------------------- P1
def column_classes(df: DataFrame, target: str) -> DataFrame:
    """One row per feature: name, 1-based position in the table, numeric or
    categorical, Spark type; with n_rows and n_cols (n_cols counts the target)."""
    rows = [(f.name, i + 1, isinstance(f.dataType, T.NumericType), f.dataType.simpleString())
            for i, f in enumerate(df.schema.fields) if f.name != target]
    cols = _spark(df).createDataFrame(
        rows, "column_name string, position int, is_numeric boolean, data_type string")
    n = df.agg(F.count(F.lit(1)).alias("n_rows"))
    return (cols.crossJoin(n)   # n is one row
            .select("column_name", F.col("position").cast("long").alias("position"),
                    "is_numeric",
                    F.when(F.col("is_numeric"), "numeric").otherwise("categorical").alias("column_class"),
                    "data_type", "n_rows", F.lit(len(df.columns)).cast("long").alias("n_cols")))


# --------------------------------------------------------------------------- P2-P4
def _missing_counts(df: DataFrame, feats: list[str]) -> DataFrame:
    """One row: n_rows and a missing count per feature."""
    return df.agg(F.count(F.lit(1)).alias("__n"),
                  *[F.sum(missing(df, c).cast("long")).alias(c) for c in feats])


def recommend(frac: F.Column, is_numeric: F.Column, drop_threshold: float = 0.5) -> F.Column:
    """Imputation recommendation from the missing fraction."""
    return (F.when(frac > 0.80, "drop_column")
            .when(frac > drop_threshold, "fill_or_drop")
            .when(is_numeric, "fill_median")
            .otherwise("fill_mode"))


def missing_profile(df: DataFrame, target: str, drop_threshold: float = 0.5) -> DataFrame:
    """P2 (+P4): per feature with any missing value (null or NaN): count,
    fraction of all rows, numeric flag, recommendation."""
    feats = features_of(df, target)
    if not feats:
        return _spark(df).createDataFrame([], "column_name string, missing_count long, "
                                              "missing_frac double, is_numeric boolean, recommend string")
    nums = set(numeric_columns(df))
    wide = _missing_counts(df, feats)
    long = wide.unpivot(["__n"], feats, "column_name", "missing_count")
    isnum = F.col("column_name").isin(*nums) if nums else F.lit(False)
    frac = F.col("missing_count") / F.col("__n")
    return (long.where(F.col("missing_count") > 0)
            .select("column_name", F.col("missing_count").cast("long").alias("missing_count"),
                    frac.alias("missing_frac"), isnum.alias("is_numeric"),
                    recommend(frac, isnum, drop_threshold).alias("recommend")))


def missing_total_frac(df: DataFrame, target: str) -> DataFrame:
    """Missing feature cells / all feature cells (0 for an empty table)."""
    feats = features_of(df, target)
    wide = _missing_counts(df, feats)
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in feats), F.lit(0).cast("long"))
    cells = F.col("__n") * F.lit(len(feats))
    return wide.select(
        total.cast("long").alias("missing_cells"), cells.cast("long").alias("total_cells"),
        F.when(cells > 0, total / cells).otherwise(F.lit(0.0)).alias("missing_total_frac"))


# --------------------------------------------------------------------------- P5
def high_corr_pairs(df: DataFrame, target: str, threshold: float = 0.90) -> DataFrame:
    """P5: |Pearson r| >= threshold over numeric feature pairs i < j, each pair
    over its complete rows (NaN treated as missing). Reports |r|. One scan at any
    width (:mod:`gradewell.functions.comoments`)."""
    nums = numeric_columns(df, exclude=target)
    spark = _spark(df)
    schema = "col_a string, col_b string, corr_value double"
    if len(nums) < 2:
        return spark.createDataFrame([], schema)
    base = df.select(*[clean(df, c).cast("double").alias(f"c{i}") for i, c in enumerate(nums)])
    found = correlations(base, [f"c{i}" for i in range(len(nums))], threshold)
    name = lambda c: F.element_at(F.array(*[F.lit(n) for n in nums]), F.substring(c, 2, 9).cast("int") + 1)
    return found.select(name("col_a").alias("col_a"), name("col_b").alias("col_b"),
                        F.least(F.abs("r"), F.lit(1.0)).alias("corr_value"))


# --------------------------------------------------------------------------- P6
def iqr_outliers(df: DataFrame, target: str, factor: float = 1.5, min_frac: float = 0.01,
                 approx: bool = False, accuracy: int = 10_000, counts: dict[str, int] | None = None) -> DataFrame:
    """IQR outliers per numeric feature. Quartiles interpolate linearly
    over non-null values; columns with < 10 values or IQR = 0 are skipped; a
    column is flagged when frac >= min_frac and count >= 3."""
    nums = numeric_columns(df, exclude=target)
    spark = _spark(df)
    schema = ("column_name string, outlier_count long, outlier_frac double, "
              "lower_bound double, upper_bound double")
    if not nums:
        return spark.createDataFrame([], schema)
    if approx:
        row = df.select(*[clean(df, c).alias(c) for c in nums]).agg(
            *[F.percentile_approx(c, F.array(F.lit(0.25), F.lit(0.75)), accuracy).alias(c) for c in nums]).first()
        q = {c: row[c] for c in nums}
    else:
        q = exact_quantiles(df, nums, [0.25, 0.75], counts=counts)
    bounds = {}
    for c in nums:
        if q[c] is None or q[c][0] is None:
            continue
        q1, q3 = q[c]
        iqr = q3 - q1
        if iqr == 0:
            continue
        bounds[c] = (q1 - factor * iqr, q3 + factor * iqr)
    if not bounds:
        return spark.createDataFrame([], schema)
    aggs = []
    for c, (lo, hi) in bounds.items():
        v = clean(df, c)
        aggs += [F.count(v).alias(f"n_{c}"),
                 F.sum(((v < F.lit(lo)) | (v > F.lit(hi))).cast("long")).alias(f"o_{c}")]
    row = df.agg(*aggs)
    long = row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"n_{c}").alias("n"),
                 F.coalesce(F.col(f"o_{c}"), F.lit(0).cast("long")).alias("outlier_count"),
                 F.lit(lo).alias("lower_bound"), F.lit(hi).alias("upper_bound"))
        for c, (lo, hi) in bounds.items()])).alias("x")).select("x.*")
    frac = F.col("outlier_count") / F.col("n")
    return (long.where((F.col("n") >= 10) & (frac >= min_frac) & (F.col("outlier_count") >= 3))
            .select("column_name", "outlier_count", frac.alias("outlier_frac"),
                    "lower_bound", "upper_bound"))


# --------------------------------------------------------------------------- P7
def duplicate_count(df: DataFrame, target: str) -> DataFrame:
    """Rows beyond the first of each identical feature row (target
    excluded). Null groups with null and NaN with NaN, like pandas. Rows are
    exchanged as 128-bit hashes (two seeds over values and null positions), not as full rows;
    partial aggregation collapses a hot duplicate group before the shuffle."""
    feats = features_of(df, target)
    nulls = F.concat(F.lit(""), *[F.col(c).isNull().cast("int").cast("string") for c in feats])
    g = df.select(F.xxhash64(nulls, *feats).alias("h"), F.xxhash64(F.lit(1_000_003), nulls, *feats).alias("g")) \
        .groupBy("h", "g").agg(F.count(F.lit(1)).alias("cnt"))
    return g.agg(F.coalesce(F.sum(F.col("cnt") - 1), F.lit(0)).cast("long").alias("duplicate_count")) \
        .withColumn("has_duplicates", F.col("duplicate_count") > 0)


# --------------------------------------------------------------------------- P8
def skewed_columns(df: DataFrame, target: str, threshold: float = 2.0, min_count: int = 10,
                   columns: list[str] | None = None) -> DataFrame:
    """Numeric features with |G1| > threshold over >= min_count values
    (G1 = bias-adjusted sample skewness, as pandas ``skew``)."""
    nums = columns if columns is not None else numeric_columns(df, exclude=target)
    spark = _spark(df)
    if not nums:
        return spark.createDataFrame([], "column_name string, skewness double")
    aggs = []
    for c in nums:
        v = clean(df, c)
        aggs += [F.count(v).alias(f"n_{c}"), F.skewness(v).alias(f"s_{c}")]
    row = df.agg(*aggs)
    long = row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"n_{c}").alias("n"), F.col(f"s_{c}").alias("g1"))
        for c in nums])).alias("x")).select("x.*")
    g1 = sample_skewness(F.col("g1"), F.col("n").cast("double"))
    return (long.where(F.col("n") >= min_count).select("column_name", g1.alias("skewness"))
            .where(F.col("skewness").isNotNull() & ~F.isnan("skewness") & (F.abs("skewness") > threshold)))


# --------------------------------------------------------------------------- P9
#: Date formats tried on strings besides ISO 8601 (Java patterns; fixed list).
DATE_FORMATS = ["M/d/yyyy", "d/M/yyyy", "yyyy/M/d", "d.M.yyyy", "d-M-yyyy", "MMM d, yyyy", "d MMM yyyy",
                "M/d/yyyy H:m", "M/d/yyyy H:m:s", "yyyy/M/d H:m:s", "d.M.yyyy H:m"]


#: A text that begins so, after blanks, is no date in any format; a failed parse costs an exception each.
NO_DATE = r"^[\x00-\x20]*[!-*,./:-@\[-`{-~]"


def parses_as_date(v: F.Column) -> F.Column:
    out = F.try_to_timestamp(v).isNotNull()
    for fmt in DATE_FORMATS:
        out = out | F.try_to_timestamp(v, F.lit(fmt)).isNotNull()
    return ~v.rlike(NO_DATE) & out


def datetime_like(df: DataFrame, target: str) -> DataFrame:
    """Categorical columns that look like dates. Timestamp/date typed
    columns qualify directly; a string column qualifies when it has a value
    and every non-null value parses. One aggregate over all rows, combined
    before the shuffle; no sample, no sort."""
    spark = _spark(df)
    typed = [f.name for f in df.schema.fields if f.name != target
             and isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))]
    strings = [f.name for f in df.schema.fields if f.name != target
               and isinstance(f.dataType, T.StringType)]
    out = spark.createDataFrame([(c,) for c in typed], "column_name string")
    if not strings:
        return out
    row = df.agg(*[F.bool_and(F.when(F.col(c).isNotNull(), parses_as_date(F.col(c)))).alias(f"d{i}")
                   for i, c in enumerate(strings)])
    long = row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"d{i}").alias("ok"))
                                          for i, c in enumerate(strings)])).alias("x")).select("x.*")
    return out.unionByName(long.where("ok").select("column_name"))


# --------------------------------------------------------------------------- P10
def scale_range_ratio(df: DataFrame, target: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """P10: max std / min std over numeric columns (sample std, zero dropped);
    needs >= 2 such columns, else 0.0."""
    nums = columns if columns is not None else numeric_columns(df, exclude=target)
    if len(nums) < 2:
        return _spark(df).range(1).select(F.lit(0.0).alias("scale_range_ratio"),
                                          F.lit(0).cast("long").alias("n_std_columns"))
    row = df.agg(F.array(*[F.stddev_samp(clean(df, c)) for c in nums]).alias("s"))
    nz = F.filter("s", lambda x: x.isNotNull() & ~F.isnan(x) & (x != 0))
    return row.select(
        F.when(F.size(nz) >= 2, F.array_max(nz) / F.array_min(nz)).otherwise(F.lit(0.0)).alias("scale_range_ratio"),
        F.size(nz).cast("long").alias("n_std_columns"))


# --------------------------------------------------------------------------- P11
def class_imbalance(df: DataFrame, target: str) -> DataFrame:
    """Smallest / largest class count (null class ignored), null with
    fewer than 2 classes."""
    counts = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("c"))
    return counts.agg(F.count(F.lit(1)).cast("long").alias("n_classes"),
                      F.min("c").alias("min_c"), F.max("c").alias("max_c")) \
        .select("n_classes", F.when(F.col("n_classes") >= 2, F.col("min_c") / F.col("max_c"))
                .alias("class_imbalance_ratio"))


# --------------------------------------------------------------------------- P12
@dataclass
class Profile:
    summary: DataFrame
    columns: DataFrame
    missing: DataFrame
    corr_pairs: DataFrame
    outliers: DataFrame
    skewed: DataFrame
    datetime_cols: DataFrame


def profile_table(df: DataFrame, target: str, *, corr_threshold: float = 0.90,
                  missing_drop_threshold: float = 0.50, outlier_iqr_factor: float = 1.5,
                  outlier_min_frac: float = 0.01,
                  approx_quantiles: bool = False, cache: bool = False) -> Profile:
    """The whole profile as a one-row summary plus long child tables.

    Eager and pass-minimal: (1) one wide aggregate gives row count, missing
    counts, non-null counts, std and skewness; (1b) every correlation by co-moments;
    (2) quantile brackets (P6); (3) outlier counts; (4) duplicate groups;
    (5) class counts; (6) date-like strings. Results are bounded by the
    number of columns (pairs for correlations) and come back as small
    DataFrames, so downstream joins never re-run the profile."""
    spark = _spark(df)
    src = df.persist() if cache else df
    try:
        feats = features_of(src, target)
        nums = numeric_columns(src, exclude=target)
        cats = categorical_columns(src, exclude=target)
        aggs = [F.count(F.lit(1)).alias("__n")]
        aggs += [F.sum(missing(src, c).cast("long")).alias(f"m{i}") for i, c in enumerate(feats)]
        for i, c in enumerate(nums):
            v = clean(src, c)
            aggs += [F.count(v).alias(f"n{i}"), F.stddev_samp(v).alias(f"s{i}"), F.skewness(v).alias(f"k{i}")]
        row = src.agg(*aggs).first()
        n = int(row["__n"])
        import math
        ok = lambda x: x is not None and not (isinstance(x, float) and math.isnan(x))
        # missing (P2-P4)
        miss_rows = []
        total_missing = 0
        for i, c in enumerate(feats):
            m = int(row[f"m{i}"] or 0)
            total_missing += m
            if m > 0:
                frac = m / n
                isnum = c in nums
                rec = ("drop_column" if frac > 0.80 else "fill_or_drop" if frac > missing_drop_threshold
                       else "fill_median" if isnum else "fill_mode")
                miss_rows.append((c, m, frac, isnum, rec))
        cells = n * len(feats)
        # skew (P8) and scale (P10)
        skew_rows, stds = [], []
        for i, c in enumerate(nums):
            cnt = int(row[f"n{i}"] or 0)
            g1, sd = row[f"k{i}"], row[f"s{i}"]
            if cnt >= 10 and ok(g1):
                g = float(g1) * math.sqrt(cnt * (cnt - 1)) / (cnt - 2)
                if abs(g) > 2.0:
                    skew_rows.append((c, g))
            if ok(sd) and float(sd) != 0:
                stds.append(float(sd))
        scale = (max(stds) / min(stds)) if len(nums) >= 2 and len(stds) >= 2 else 0.0
        # the remaining passes are independent jobs: submit them together so
        # their tasks share the executors instead of running back to back
        counts = {c: int(row[f"n{i}"] or 0) for i, c in enumerate(nums)}
        jobs = {
            "corr": lambda: [tuple(r) for r in high_corr_pairs(src, target, corr_threshold).collect()],
            "outl": lambda: [tuple(r) for r in iqr_outliers(
                src, target, outlier_iqr_factor, outlier_min_frac, approx=approx_quantiles, counts=counts).collect()],
            "dup": lambda: int(duplicate_count(src, target).first()["duplicate_count"]) if feats else 0,
            "imb": lambda: (class_imbalance(src, target).first()["class_imbalance_ratio"]
                            if target in src.columns else None),
            "dt": lambda: [tuple(r) for r in datetime_like(src, target).collect()],
        }
        with ThreadPoolExecutor(max_workers=len(jobs)) as pool:
            futures = {k: pool.submit(fn) for k, fn in jobs.items()}
            res = {k: f.result() for k, f in futures.items()}
        corr_rows, out_rows, dup, imb, dt_rows = res["corr"], res["outl"], res["dup"], res["imb"], res["dt"]
    finally:
        if cache:
            src.unpersist()
    cols = column_classes(df, target)  # schema walk, count is lazy
    mk = spark.createDataFrame
    miss = mk(miss_rows, "column_name string, missing_count long, missing_frac double, is_numeric boolean, "
                         "recommend string")
    corr = mk(corr_rows, "col_a string, col_b string, corr_value double")
    outl_df = mk(out_rows, "column_name string, outlier_count long, outlier_frac double, lower_bound double, "
                           "upper_bound double")
    skew = mk(skew_rows, "column_name string, skewness double")
    dtl = mk(dt_rows, "column_name string")
    summary = mk([(n, len(df.columns), len(nums), len(cats), (total_missing / cells) if cells else 0.0, dup, dup > 0,
                   scale, imb, len(miss_rows), len(corr_rows), len(out_rows), len(skew_rows), len(dt_rows),
                   len(miss_rows) > 0, len(corr_rows) > 0, len(out_rows) > 0, len(skew_rows) > 0)],
                 "n_rows long, n_cols long, n_numeric long, n_categorical long, missing_total_frac double, "
                 "duplicate_count long, has_duplicates boolean, scale_range_ratio double, "
                 "class_imbalance_ratio double, n_missing_columns long, n_high_corr_pairs long, "
                 "n_outlier_columns long, n_skewed_columns long, n_datetime_like long, has_missing boolean, "
                 "has_high_correlation boolean, has_outliers boolean, has_high_skew boolean")
    return Profile(summary, cols, miss, corr, outl_df, skew, dtl)


# --------------------------------------------------------------------------- P13
def fit_imputer(train: DataFrame, columns: list[str]) -> dict[str, object]:
    """Fill values fitted on ``train``: exact median for numeric columns,
    mode (most frequent, smallest on ties) for the others. Bounded result:
    one value per column."""
    nums = [c for c in columns if isinstance(train.schema[c].dataType, T.NumericType)]
    cats = [c for c in columns if c not in nums]
    fills: dict[str, object] = {}
    if nums:
        med = exact_quantiles(train, nums, [0.5])
        fills.update({c: med[c][0] for c in nums})
    if cats:
        long = train.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in cats
        ])).alias("x")).select("x.*").where(F.col("v").isNotNull())
        counts = long.groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("c"))
        best = counts.groupBy("column_name").agg(
            F.min_by("v", F.struct(-F.col("c"), F.col("v"))).alias("mode"))
        fills.update({r["column_name"]: r["mode"] for r in best.collect()})  # one row per column
    return fills


def impute_fill(train: DataFrame, apply_to: DataFrame, columns: list[str] | None = None,
                fills: dict[str, object] | None = None) -> DataFrame:
    """Fill missing values of ``apply_to`` with values fitted on ``train``."""
    cols = columns if columns is not None else [c for c in train.columns]
    fills = fills if fills is not None else fit_imputer(train, cols)
    out = apply_to
    for c, v in fills.items():
        if v is None:
            continue
        base = clean(out, c) if is_float_col(out, c) else F.col(c)
        kind = out.schema[c].dataType
        if isinstance(kind, T.IntegralType):      # a median may lie between two values: the column widens
            kind = T.DoubleType() if float(v) != int(v) else kind
        out = out.withColumn(c, F.coalesce(base.cast(kind), F.lit(v).cast(kind)))
    return out


# --------------------------------------------------------------------------- P14
def fit_label_encoder(train: DataFrame, columns: list[str], skew_safe: bool = True) -> DataFrame:
    """Codes per (column, value): 0-based rank of the value among the column's
    distinct non-null train values, alphabetical ascending. ``skew_safe``
    ranks a high-cardinality column with the range-partitioned
    :func:`distributed_row_number` instead of one window per column."""
    long = train.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns
    ])).alias("x")).select("x.*").where(F.col("value").isNotNull()).distinct()
    if skew_safe:
        from gradewell.functions.ranking import distributed_row_number
        return distributed_row_number(long, ["column_name"], ["value"], out="code") \
            .withColumn("code", F.col("code").cast("long"))
    w = Window.partitionBy("column_name").orderBy("value")
    return long.withColumn("code", (F.dense_rank().over(w) - 1).cast("long"))


def encode_categorical(train: DataFrame, apply_to: DataFrame, columns: list[str],
                       mapping: DataFrame | None = None) -> DataFrame:
    """Label-encode ``columns`` of ``apply_to`` with codes fitted on
    ``train``. Values unseen in train get a null code (the reference raises).
    The mapping is a plain join side: the planner broadcasts it if it is small."""
    m = mapping if mapping is not None else fit_label_encoder(train, columns)
    out = apply_to
    for c in columns:
        mc = m.where(F.col("column_name") == c).select(
            F.col("value").alias(f"__v_{c}"), F.col("code").alias(f"__code_{c}"))
        out = (out.join(mc, out[c].cast("string") == mc[f"__v_{c}"], "left")
               .withColumn(c, F.col(f"__code_{c}")).drop(f"__v_{c}", f"__code_{c}"))
    return out
