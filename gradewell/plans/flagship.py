"""The flagship query: score every episode of the step log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.operators import profile as P
from gradewell.operators import verdicts as V
from gradewell.plans import fixtures as X
from gradewell.sources.io import explode_checklist


def dataset_profile(spark: SparkSession, sf_dir: str):
    """Profile of the episode dataset, child tables keyed by dataset_path."""
    data = X.dirty_events(spark, sf_dir)
    prof = P.profile_table(data, X.DIRTY_TARGET)
    tag = lambda d: d.withColumn("dataset_path", F.lit("dirty_events"))
    flags = V.profile_flags(tag(prof.summary), tag(prof.outliers), tag(prof.datetime_cols))
    return flags, tag(prof.corr_pairs), tag(prof.missing)


def _tables(spark: SparkSession, sf_dir: str):
    tasks = X.tasks(spark, sf_dir)
    flags, pairs, missing = dataset_profile(spark, sf_dir)
    log = X.steps(spark, sf_dir)        # numbered once for the steps and for both change logs
    given = X.steps_with_task(spark, sf_dir, log), tasks, explode_checklist(tasks), flags, pairs, missing
    more = {"baselines": tasks.select("task_id", F.col("baseline_score").alias("baseline_metric")),
            "outcomes": X.step_outcomes(spark, sf_dir, log), "artifacts": X.artifacts(spark, sf_dir, log), "hard_time_limit": X.HARD_TIME_LIMIT}
    return given, more


def scored_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    given, more = _tables(spark, sf_dir)
    return V.score_steps(*given, **more)


def scored_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    given, more = _tables(spark, sf_dir)
    return V.score_episodes(*given, **more)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    ep = scored_episodes(spark, sf_dir)
    failed = sum((F.when(~F.col(n)["passed"], 1).otherwise(0) for n in V.VALIDATORS), F.lit(0))
    return ep.select("episode_id", "task_id", F.col("step_idx").alias("last_step"), "done",
                     F.round("performance", 9).alias("performance"),
                     F.round("code_quality", 9).alias("code_quality"),
                     F.round("total_penalty", 9).alias("total_penalty"),
                     F.round("reward", 9).alias("reward"), failed.alias("n_failed"))
