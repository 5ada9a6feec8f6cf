"""The corpus pipeline: quality rules, near duplicates, benchmark
decontamination, source mixing, token shards. Each stage is written as Parquet
and read again as the next one's documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradewell.llm.decontaminate import clean
from gradewell.llm.jaccard_join import judged, text_hashes
from gradewell.llm.mixing import emit
from gradewell.llm.quality import keep
from gradewell.llm.token_shards import write_shards


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the rules reject go; rows of equal id are rejected one by one."""
    return keep(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the text it is named after stays, a repeated row once;
    different texts of one id are judged by themselves; rows without an id are
    in no group and stay. Of texts of one id and equal shingles the least by hash stays."""
    first = judged(docs).filter("doc_id is not null and leads").groupBy("doc_id", "class").agg(
        F.min(F.struct("text_a", "text_b")).alias("t")).select(
        F.col("doc_id").alias("_id"), F.col("t.text_a").alias("_a"), F.col("t.text_b").alias("_b"))
    a, b = text_hashes(docs["text"])
    kept = docs.join(first, (docs["doc_id"] == first["_id"]) & (a == first["_a"]) & (b == first["_b"]))
    kept = kept.withColumn("_nth", F.row_number().over(
        Window.partitionBy("_id", "_a", "_b").orderBy(F.xxhash64(*(docs[c] for c in docs.columns))))).filter("_nth = 1")
    return kept.select(*docs.columns).union(docs.filter("doc_id is null"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat a benchmark item go."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights want them."""
    return emit(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token shards' index."""
    return write_shards(docs).drop("file")


STAGES = [("quality", quality), ("dedup", dedup), ("decontaminate", decontaminate), ("mix", mix), ("shards", shards)]

#: Components, templates and token ids are not SQL; tests hold the rows against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the documents of ``sf_dir``."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        raise ValueError("spark.checkpoint.dir is not set: it must name a folder all executors share")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared.rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
