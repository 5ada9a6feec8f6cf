"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

Each source gets a share of the mix by weight, at most ``max_repeats`` times its
size; what is cut off is shared again by weight (water filling, solved in closed
form over the sources ordered by where their limit binds). Every document of a
source expects target / size copies. The documents of a source stand in one
order (by size class, then part, then size, so neighbours are of like size), the expected copies are
summed up along it, one offset in [0, 1) is added, and a document is emitted
once for every whole number its stretch of that sum crosses.

The running sum is expected copies times rank. Ranks come from small parts of a
source (size class and hash of the id), with the parts' counts summed before
them over ranges of parts, so a source with a third of all rows, and its list of
parts, spread over many tasks.

Nulls and ties: a null text has size 0; a null source is a source of its own,
last in order; documents of size 0 are emitted like others but take no words.
Rows of equal id, size and source are interchangeable. Empty sources (size 0)
have target 0. ``emit`` passes all columns through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradewell.functions.ranking import exclusive_prefix_sum
from gradewell.llm.blocks import checkpointed

SPACES = " \t\n\x0b\x0c\r"
WEIGHTS = (5, 2, 1)
#: Rows of the whole table for each part a size class of a source is cut into.
ROWS_A_PART = 2000


def word_count(text: Column) -> Column:
    """Number of words of a text (null: 0)."""
    flat = F.trim(text, F.lit(SPACES))
    n = F.size(F.split(flat, f"[{SPACES}]+"))
    return F.when(F.coalesce(flat, F.lit("")) == "", F.lit(0)).otherwise(n).cast("long")


def unit(text: Column) -> Column:
    """A number in [0, 1) from the MD5 of a string."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def targets(sizes: DataFrame, total_share: float = 1.5, max_repeats: int = 2,
            weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) for (source, source_size) rows, one a source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]),
                          ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", weight.cast("long")).withColumn("lim", F.col("source_size") * max_repeats)
    # sources in the order their limit binds; level = words per weight if those before are at their limit
    order = Window.orderBy(F.col("lim") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    s = (s.withColumn("goal", F.sum("source_size").over(everything) * F.lit(float(total_share)))
         .withColumn("level", (F.col("goal") - F.coalesce(F.sum("lim").over(before), F.lit(0)))
                     / F.sum("w").over(after)))
    level = F.max(F.when(F.col("level") * F.col("w") <= F.col("lim"), F.col("level"))).over(everything)
    return s.withColumn("level", level).select(
        "source", "source_size",
        F.coalesce(F.least(F.col("lim").cast("double"), F.col("level") * F.col("w")),
                   F.col("lim").cast("double")).alias("target"))


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
           seed: str = "mix", carry: tuple[str, ...] = (), **shares) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, the carried columns), one row per document."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                    word_count(F.col(text_col)).alias("size"), *[F.col(c).alias(f"_{c}") for c in carry])
    if not carry:
        d = checkpointed(d)             # three narrow columns: the words are counted once
    n_parts = docs.count() // ROWS_A_PART + 1
    bits = F.length(F.bin("size"))
    d = d.withColumn("class", bits * 8 + F.expr("shiftright(size, greatest(length(bin(size)) - 3, 0))")).withColumn(
        "part", F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 8), 16, 10)
        .cast("long") % n_parts)
    parts = d.groupBy("source", "class", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    parts = exclusive_prefix_sum(parts.withColumn("place", F.col("class") * n_parts + F.col("part")), ["source"], "place", ["n"])
    sizes = parts.groupBy("source").agg(F.sum("words").alias("source_size"))
    mix = targets(sizes, **shares)
    parts = parts.withColumnRenamed("source", "p_source").join(mix, F.col("p_source").eqNullSafe(F.col("source"))).select(
        "p_source", F.col("class").alias("p_class"), F.col("part").alias("p_part"),
        F.col("n_below").alias("before"), "source_size", "target")
    inside = Window.partitionBy("source", "class", "part").orderBy("size", F.col("doc_id").asc_nulls_last())
    d = d.withColumn("nth", F.row_number().over(inside))
    d = d.join(parts, d["source"].eqNullSafe(parts["p_source"]) & (d["class"] == parts["p_class"])
               & (d["part"] == parts["p_part"]))
    step = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    start = unit(F.concat(F.lit(seed + "/"), F.coalesce(F.col("source"), F.lit("(null)"))))
    d = d.withColumn("rank", F.col("before") + F.col("nth"))
    return d.select("doc_id", "source", "size", "source_size", "target",
                    (F.floor(F.col("rank") * step + start) - F.floor((F.col("rank") - 1) * step + start))
                    .alias("copies"), *[f"_{c}" for c in carry])


def emit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         seed: str = "mix", **shares) -> DataFrame:
    """The mixed documents themselves: every input row as often as it is emitted."""
    d = copies(docs, id_col, text_col, source_col, seed, tuple(docs.columns), **shares)
    d = d.filter("copies > 0").withColumn("nth_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return d.select(*[F.col(f"_{c}").alias(c) for c in docs.columns])
