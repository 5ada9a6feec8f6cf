"""Order-dependent helpers that never route one key's rows through one task.

Rows are range-partitioned on (keys, order); a running value is the total of
the key in the ranges before plus the running value inside the range. A key
holding a third of all rows is spread over a third of the ranges, whatever
their number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradewell.session import ensure_checkpoint_dir


def md5_bigint(*cols: F.Column) -> F.Column:
    """Portable 60-bit hash: first 15 hex digits of md5 as BIGINT (DuckDB
    computes the same value with ``('0x' || substr(md5(s), 1, 15))::BIGINT``)."""
    s = F.concat_ws(":", *[c.cast("string") for c in cols]) if len(cols) > 1 else cols[0].cast("string")
    return F.conv(F.substring(F.md5(s), 1, 15), 16, 10).cast("long")


def xx_bigint(*cols: F.Column) -> F.Column:
    """Fast 60-bit non-negative hash (Spark only)."""
    return F.xxhash64(*cols).bitwiseAND(F.lit(0x0FFFFFFFFFFFFFFF))


def _ranged(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows range-partitioned on ``cols`` with their partition as ``_pid``,
    fixed by a reliable checkpoint (a second evaluation could draw other
    bounds). The planner sizes the ranges from the session's partition count."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.repartitionByRange(*cols).withColumn("_pid", F.spark_partition_id()).checkpoint(eager=True)


def exclusive_prefix_sum(df: DataFrame, keys: list[str], order_col: str, value_cols: list[str]) -> DataFrame:
    """Adds ``<v>_below`` = sum of ``v`` over rows of the same ``keys`` whose
    ``order_col`` is strictly smaller. ``(keys, order_col)`` must be unique
    (pre-aggregate first). The input is evaluated once."""
    x = _ranged(df, [*keys, order_col])
    tot = x.groupBy(*keys, "_pid").agg(*[F.sum(v).alias(f"_t_{v}") for v in value_cols])
    w_off = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*keys, "_pid",
                     *[F.coalesce(F.sum(f"_t_{v}").over(w_off), F.lit(0)).alias(f"_o_{v}") for v in value_cols])
    off = off.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_pid").alias("_p"),
                     *[f"_o_{v}" for v in value_cols])
    same = x["_pid"] == off["_p"]
    for i, k in enumerate(keys):
        same = same & x[k].eqNullSafe(off[f"_k{i}"])
    w_in = Window.partitionBy(*keys, "_pid").orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    x = x.join(off, same)
    return x.select(*df.columns, *[(F.col(f"_o_{v}") + F.coalesce(F.sum(v).over(w_in), F.lit(0))).alias(f"{v}_below")
                                   for v in value_cols])


def distributed_row_number(df: DataFrame, partition_cols: list[str], order_cols: list[str],
                           out: str = "rn") -> DataFrame:
    """``row_number() over (partition by partition_cols order by order_cols) - 1``
    without routing one key's rows through one task: ranks inside ranges of
    (keys, order), plus the rows of the key in the ranges before. Only the
    columns of ``df`` are checkpointed: pass narrow rows and join back."""
    keys = list(partition_cols)
    x = _ranged(df, [*keys, *order_cols])
    counts = x.groupBy("_pid", *keys).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    off = counts.select(F.col("_pid").alias("_p"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                        F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_off"))
    same = x["_pid"] == off["_p"]
    for i, k in enumerate(keys):
        same = same & x[k].eqNullSafe(off[f"_k{i}"])
    wl = Window.partitionBy("_pid", *keys).orderBy(*order_cols)
    return x.join(off, same).select(*df.columns, (F.col("_off") + F.row_number().over(wl) - 1).alias(out))
