"""Split and integrity."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradewell.functions.ranking import md5_bigint, xx_bigint

# 2^20 hash buckets per class for the exact split histogram.
SPLIT_BUCKET_BITS = 20
# They come in 2^8 groups per class, by which rows and cuts are dealt out.
SPLIT_GROUP_BITS = 8


def split_sizes(n: int, fracs: tuple[float, float, float] = (0.7, 0.15, 0.15)) -> tuple[int, int, int]:
    """Rows per split for ``n`` rows: the held-out part is ceil((valid+test)*n),
    then the test share of it is ceil(test/(valid+test) * held). One row at
    least is left for training."""
    held_frac = fracs[1] + fracs[2]
    held = min(int(math.ceil(held_frac * n)), n - 1) if n else 0      # a lone row trains
    n_test = int(math.ceil(held * (fracs[2] / held_frac))) if held else 0
    return n - held, held - n_test, n_test


def _order_key(key: list[str], seed: int, method: str) -> F.Column:
    cols = [F.lit(str(seed))] + [F.col(k) for k in key]
    return md5_bigint(*cols) if method == "md5" else xx_bigint(*cols)


def stratified_split(df: DataFrame, key: str | list[str], target: str | None,
                     fracs: tuple[float, float, float] = (0.7, 0.15, 0.15), seed: int = 42,
                     hash_method: str = "xxhash64") -> DataFrame:
    """Adds ``split`` in {train, valid, test}, exact sizes per class.

    Rows of a class are ordered by a seeded hash of the key (ties by key);
    ranks below cut 1 are train, below cut 2 valid, the rest test. Instead of
    ranking every row in one window per class, a histogram of 2^20 hash
    buckets per class, in 2^8 groups of buckets, finds the bucket holding each cut: running
    counts over a class's groups, then inside each group. Rows meet the cuts by
    class and group (null-safe: rows without a class are a class of their own), so a class that
    holds most rows is spread over its groups, and are placed by comparing their bucket;
    only rows of the (at most two) buckets that a cut splits get a row number."""
    keys = [key] if isinstance(key, str) else list(key)
    cls = F.col(target) if target else F.lit(0)
    x = df.withColumn("_cls", cls).withColumn("_h", _order_key(keys, seed, hash_method)) \
        .withColumn("_b", F.shiftright("_h", 60 - SPLIT_BUCKET_BITS)) \
        .withColumn("_g", F.shiftright("_b", SPLIT_BUCKET_BITS - SPLIT_GROUP_BITS))
    hist = x.groupBy("_cls", "_g", "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.unboundedPreceding, -1
    groups = hist.groupBy("_cls", "_g").agg(F.sum("_cnt").alias("_size"))
    groups = groups.select(
        F.col("_cls").alias("_cut_cls"), F.col("_g").alias("_cut_g"), "_size",
        F.coalesce(F.sum("_size").over(Window.partitionBy("_cls").orderBy("_g").rowsBetween(*before)), F.lit(0)).alias("_from"),
        F.sum("_size").over(Window.partitionBy("_cls")).alias("_n"))
    ht = fracs[1] + fracs[2]
    held = F.least(F.ceil(F.lit(ht) * F.col("_n")), F.col("_n") - 1)
    n_test = F.ceil(held * F.lit(fracs[2] / ht))
    groups = groups.withColumn("_c1", F.col("_n") - held).withColumn("_c2", F.col("_n") - n_test)
    same = F.col("_cls").eqNullSafe(F.col("_cut_cls")) & F.col("_g").eqNullSafe(F.col("_cut_g"))
    hist = hist.join(groups, same).withColumn("_start", F.col("_from") + F.coalesce(
        F.sum("_cnt").over(Window.partitionBy("_cls", "_g").orderBy("_b").rowsBetween(*before)), F.lit(0)))
    holds = lambda c: (F.col(c) >= F.col("_start")) & (F.col(c) < F.col("_start") + F.col("_cnt"))

    def cut(c: str):
        """The bucket of this group that holds the cut; without one, all buckets are below it (2^62) or above (-1)."""
        none = F.when(F.first("_from") >= F.first(c), F.lit(-1)).otherwise(F.lit(1 << 62))
        return (F.coalesce(F.max(F.when(holds(c), F.col("_b"))), none),
                F.coalesce(F.max(F.when(holds(c), F.col(c) - F.col("_start"))), F.lit(0)))
    cuts = hist.groupBy("_cls", "_g").agg(*[v.alias(n) for n, v in zip(("_b1", "_o1", "_b2", "_o2"), (*cut("_c1"), *cut("_c2")))])
    x = x.join(cuts.withColumnsRenamed({"_cls": "_cut_cls", "_g": "_cut_g"}), same)
    in_cut = (((F.col("_b") == F.col("_b1")) & (F.col("_o1") > 0))
              | ((F.col("_b") == F.col("_b2")) & (F.col("_o2") > 0)))
    out_cols = df.columns + ["split"]
    plain = x.where(~in_cut).withColumn(
        "split", F.when(F.col("_b") < F.col("_b1"), "train").when(F.col("_b") < F.col("_b2"), "valid")
        .otherwise("test"))
    # rows of a split bucket: rank inside the bucket decides
    wr = Window.partitionBy("_cls", "_b").orderBy("_h", *keys)
    local = F.row_number().over(wr) - 1
    cut_rows = x.where(in_cut).withColumn("_r", local).withColumn(
        "split",
        F.when(F.col("_b") < F.col("_b1"), "train")
        .when((F.col("_b") == F.col("_b1")) & (F.col("_r") < F.col("_o1")), "train")
        .when(F.col("_b") < F.col("_b2"), "valid")
        .when((F.col("_b") == F.col("_b2")) & (F.col("_r") < F.col("_o2")), "valid")
        .otherwise("test"))
    return plain.select(*out_cols).unionByName(cut_rows.select(*out_cols))


def random_split(df: DataFrame, key: str | list[str],
                 fracs: tuple[float, float, float] = (0.7, 0.15, 0.15), seed: int = 42,
                 exact: bool = True, hash_method: str = "xxhash64") -> DataFrame:
    """Split without stratification (regression). ``exact=False`` is a
    pure map: the hash's fraction decides the split."""
    if exact:
        return stratified_split(df, key, None, fracs, seed, hash_method)
    keys = [key] if isinstance(key, str) else list(key)
    u = F.col("_h") / F.lit(float(1 << 60))
    return (df.withColumn("_h", _order_key(keys, seed, hash_method))
            .withColumn("split", F.when(u < fracs[0], "train").when(u < fracs[0] + fracs[1], "valid")
                        .otherwise("test")).drop("_h"))


def row_text(df: DataFrame, cols: list[str] | None = None) -> F.Column:
    """Portable text of a row, different for different rows: each column as its
    length, a colon and its text, null as N."""
    text = [F.col(c).cast("string") for c in cols or df.columns]
    return F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("N")) for t in text])


def table_fingerprint(df: DataFrame, cols: list[str] | None = None, portable: bool = True) -> DataFrame:
    """Order-free fingerprint: row count, xor and sum of per-row 60-bit
    hashes. One aggregate pass; equal for any partitioning of the same rows.
    ``portable`` uses md5 (DuckDB-reproducible), else xxhash64."""
    cols = cols or df.columns
    h = md5_bigint(row_text(df, cols)) if portable else xx_bigint(*[F.col(c) for c in cols])
    return df.select(h.alias("_h")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.bit_xor("_h"), F.lit(0).cast("long")).alias("fp_xor"),
        F.coalesce(F.sum(F.col("_h").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
        .cast("string").alias("fp_sum"))


def check_intact(before: DataFrame, after: DataFrame | None, cols: list[str] | None = None,
                 list_changes: bool = True) -> DataFrame:
    """C4: is ``after`` the same multiset of rows as ``before``? Missing table =
    not intact. Score 1/0, penalty 0.3 when changed; with ``list_changes`` the
    number of rows only in one side. One scan of each table: rows become a
    128-bit digest at once, and only digests, counted before the shuffle with
    +1 on one side and -1 on the other, are exchanged."""
    spark = before.sparkSession
    if after is None:
        return spark.createDataFrame([(False, None, 0.0, 0.3)],
                                     "intact boolean, changed_rows long, score double, penalty double")
    cols = cols or before.columns
    text = row_text(before, cols)

    def digests(df: DataFrame, sign: int) -> DataFrame:
        return df.select(F.md5(text).alias("_d"), F.lit(sign).cast("long").alias("_s"))
    net = digests(before, 1).unionByName(digests(after, -1)).groupBy("_d").agg(F.sum("_s").alias("_n"))
    res = net.agg(F.coalesce(F.sum(F.abs("_n")), F.lit(0)).cast("long").alias("changed_rows"))
    res = res.withColumn("intact", F.col("changed_rows") == 0)
    if not list_changes:
        res = res.withColumn("changed_rows", F.lit(None).cast("long"))
    return res.select("intact", "changed_rows",
                      F.when(F.col("intact"), 1.0).otherwise(0.0).alias("score"),
                      F.when(F.col("intact"), 0.0).otherwise(0.3).alias("penalty"))


def row_loss_frac(before: DataFrame, after: DataFrame, max_loss: float = 0.15) -> DataFrame:
    """1 - rows now / rows before; flagged above ``max_loss``."""
    nb = before.agg(F.count(F.lit(1)).alias("rows_before"))
    na = after.agg(F.count(F.lit(1)).alias("rows_after"))
    frac = F.when(F.col("rows_before") > 0, 1 - F.col("rows_after") / F.col("rows_before")).otherwise(0.0)
    return nb.crossJoin(na).select("rows_before", "rows_after", frac.alias("row_loss_frac"),
                                   (frac > max_loss).alias("flagged"))


def valid_frac(df: DataFrame, split_col: str = "split", min_frac: float = 0.05) -> DataFrame:
    """Valid / (train + valid); flagged below ``min_frac``."""
    c = df.groupBy().agg(F.sum((F.col(split_col) == "train").cast("long")).alias("n_train"),
                         F.sum((F.col(split_col) == "valid").cast("long")).alias("n_valid"))
    tot = F.col("n_train") + F.col("n_valid")
    frac = F.when(tot > 0, F.col("n_valid") / tot).otherwise(0.0)
    return c.select("n_train", "n_valid", frac.alias("valid_frac"), (frac < min_frac).alias("flagged"))


def column_drift(original_columns: list[str], current: DataFrame) -> DataFrame:
    """Columns new in ``current`` and original ones dropped from it."""
    cur = current.columns
    rows = ([(c, "new") for c in cur if c not in original_columns]
            + [(c, "dropped") for c in original_columns if c not in cur])
    return current.sparkSession.createDataFrame(rows, "column_name string, change string")
