"""Structured Streaming versions of the episode rules.

K1/K2: ``transformWithStateInPandas`` keeps a few counters per episode (the reference's
per-session state machine), the episodes of one bucket in one value state of the RocksDB
store, emits one row per step (E1-E5, same values as the batch windows) and, by an
event-time timer, a ``timeout`` row for an episode whose budget ran out without a
final submit. Regex flags are computed JVM-side before the state operator,
so the processor only updates counters, row by row.
K3: the stateless step rules as a plain projection of the stream.
K4: failures per crash class in tumbling event-time windows with a watermark, and a side
sink that counts the rows no window can take: those without a time and those
that come after their window was closed.
S8: the step log as a sink that takes a repeated delivery or a replayed batch once.
"""

from __future__ import annotations

import functools
import heapq
import pickle
import sys
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gradewell.functions import text_rules as TR
from gradewell.session import scratch_path

# The processor runs in Python workers that may not have this package
# installed: ship this module by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Every crash class a failed step can have, in the order of the rules.
CRASH_CLASSES = [*dict.fromkeys(c for _, c in TR.ERROR_CLASSES), "other", "none"]

#: State of one bucket: its episodes, a pickled ``{episode_id: counters}`` (see ``NEW_EPISODE``), and the
#: time of its one timer, the earliest any of them is due.
STATE_SCHEMA = T.StructType([T.StructField("episodes", T.BinaryType()), T.StructField("timer_ms", T.LongType())])

#: n, start_ms, repairs, repair_ok, fails, phase, cycles, metric, done, budget_s, dropped, due_ms, timed_out
NEW_EPISODE = (0, None, 0, 0, 0, "init", 0, None, False, None, 0, None, False)
DONE, DUE, TIMED_OUT = 8, 11, 12

#: Bits of a step's ``facts``; long columns go to Python without nulls, which pandas would make doubles.
OK, HAS_FIT, IS_FIX, IS_DATA, IS_MODEL, IS_SUBMIT, NO_EPISODE, NO_EVENT = (1 << k for k in range(8))
NO_TIME = -(1 << 63)
#: The last time pandas can hold, in whole seconds (2262-04-11), and the first.
PANDAS_TIMES = ("1677-09-22 00:00:00", "2262-04-11 00:00:00")

OUTPUT_SCHEMA = T.StructType([
    T.StructField("episode_id", T.LongType()), T.StructField("event", T.StringType()),
    T.StructField("event_id", T.LongType()), T.StructField("step_idx", T.IntegerType()),
    T.StructField("repair_attempts", T.LongType()), T.StructField("repair_successes", T.LongType()),
    T.StructField("consecutive_failures", T.LongType()), T.StructField("cycle_count", T.LongType()),
    T.StructField("best_metric", T.DoubleType()), T.StructField("done", T.BooleanType()),
    T.StructField("dropped_after_done", T.LongType()),
])


def stream_inputs(steps: DataFrame, tasks: DataFrame) -> DataFrame:
    """Per-step columns the state function needs, all computed JVM-side
    (stream-static join; the planner broadcasts a small task table)."""
    t = tasks.select("task_id", "max_steps", "time_budget_seconds")
    s = steps.join(t, "task_id")
    text = TR.step_text(F.col("code_body"), F.col("action_text"))
    return s.select(
        "episode_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "action_type",
        F.coalesce("execution_success", F.lit(False)).alias("ok"), "metric_value", "max_steps",
        "time_budget_seconds", TR.rx_match(text, TR.FIT_SPACED).alias("has_fit"))


class EpisodeProcessor(StatefulProcessor):
    """Counters of the episodes of one bucket across micro-batches (E1-E5, done, K2).

    A call to Python, to the state server and a batch of output cost far more than a step,
    so the state is kept by bucket of episodes. It has one timer, for the episode due first; when
    it fires, all episodes of the bucket due by the watermark are handled.

    The budget's end reports an open episode once; the counters stay, so that a step that
    still comes is numbered and judged as in the batch windows, and a closed episode is not
    opened again, until ``retention`` after its deadline.

    An episode ends at index max_steps at the latest, so only the first
    (max_steps + 1 - n) rows of a batch by (time, event) can matter: no more are kept of an
    episode while its rows pass, the others are counted.
    A step without a time comes first and takes none."""

    def __init__(self, retention_ms: int):
        self.retention_ms = retention_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("episodes", STATE_SCHEMA)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found = self.state.get()
        episodes, timer_ms = (pickle.loads(found[0]), found[1]) if found else ({}, None)
        arrived: dict = {}               # episode -> [rows that can matter at most, rows passed, those kept]
        for chunk in rows:
            for episode_id, *step in zip(*(chunk[c].tolist() for c in STEP_COLUMNS)):
                if step[2] & NO_EPISODE:
                    episode_id = None
                mine = arrived.get(episode_id)
                if mine is None:
                    st = episodes.get(episode_id, NEW_EPISODE)
                    mine = arrived[episode_id] = [0 if st[DONE] else max(int(step[4]) + 1 - st[0], 0), 0, []]
                mine[1] += 1
                if mine[0]:
                    mine[2].append(step)
                    if len(mine[2]) > 4 * mine[0] + 64:
                        mine[2] = heapq.nsmallest(mine[0], mine[2])
        out: list = []
        watermark = timerValues.getCurrentWatermarkInMs()
        for episode_id, (room, passed, steps) in arrived.items():
            episodes[episode_id] = self.advance(
                episode_id, episodes.get(episode_id, NEW_EPISODE), sorted(steps)[:room], passed, watermark, out)
        self.keep(episodes, timer_ms)
        if out:
            yield pd.DataFrame(out, columns=OUTPUT_SCHEMA.names, dtype=object)

    def advance(self, episode_id, state: tuple, steps: list, passed: int, watermark: int, out: list) -> tuple:
        """The episode's state after ``steps``, the first of the ``passed`` rows; a row of each goes to ``out``."""
        n, start_ms, repairs, repair_ok, fails, phase, cycles, metric, done, budget_s, dropped, due_ms, timed_out = state
        dropped += passed - len(steps)
        for ts_us, event_id, facts, value, max_steps, budget in steps:
            if done:
                dropped += 1
                continue
            ms = None if ts_us == NO_TIME else ts_us // 1000
            if start_ms is None and ms is not None:
                start_ms, budget_s = ms, float(budget)
            elapsed = (ms - start_ms) / 1000.0 if ms is not None else 0.0
            ok = facts & OK
            if facts & IS_FIX:
                repairs += 1
                repair_ok += ok
            fails = 0 if ok else fails + 1
            here = ("model" if facts & HAS_FIT else "data") if facts & IS_DATA else "model" if facts & IS_MODEL else None
            cycles += here == "model" and phase == "data"
            phase = here or phase
            if value == value:
                metric = value
            done = bool(facts & IS_SUBMIT or n >= max_steps or elapsed > budget)
            out.append((episode_id, "step", None if facts & NO_EVENT else event_id, n, repairs, repair_ok, fails, cycles,
                        metric, done, dropped))
            n += 1
        if start_ms is not None:
            # a step that is not late can come when the watermark has already passed the
            # deadline: the episode is then due as soon as the watermark moves on
            due_ms = max(start_ms + int(budget_s * 1000) + (self.retention_ms if done or timed_out else 0), watermark + 1)
        return n, start_ms, repairs, repair_ok, fails, phase, cycles, metric, done, budget_s, dropped, due_ms, timed_out

    def keep(self, episodes: dict, timer_ms: int | None) -> None:
        """Writes the bucket's state; its timer, now at ``timer_ms``, goes to the first due time."""
        due = min((st[DUE] for st in episodes.values() if st[DUE] is not None), default=None)
        if due != timer_ms:
            if timer_ms is not None:
                self.handle.deleteTimer(timer_ms)
            if due is not None:
                self.handle.registerTimer(due)
        if episodes:
            self.state.update((pickle.dumps(episodes), due))
        else:
            self.state.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        found = self.state.get()
        if found is None:
            return
        episodes, expiry = pickle.loads(found[0]), expiredTimerInfo.getExpiryTimeInMs()
        upto, out = max(timerValues.getCurrentWatermarkInMs(), expiry), []
        for episode_id, st in [*episodes.items()]:
            if st[DUE] is None or st[DUE] > upto:
                continue
            if st[DONE] or st[TIMED_OUT]:
                del episodes[episode_id]
                continue
            # Spark deletes the fired timer after this call: the next one is another
            episodes[episode_id] = (*st[:DUE], max(st[DUE] + self.retention_ms, expiry + 1), True)
            out.append((episode_id, "timeout", None, None, st[2], st[3], st[4], st[6], st[7], True, st[10]))
        self.keep(episodes, None)
        if out:
            yield pd.DataFrame(out, columns=OUTPUT_SCHEMA.names, dtype=object)

    def close(self) -> None:
        pass


#: What Python gets of a step, in the order of its rows within the episode.
STEP_COLUMNS = ["episode_id", "ts_us", "event_id", "facts", "metric_value", "max_steps", "time_budget_seconds"]


def step_facts() -> Column:
    """Flags of a step of :func:`stream_inputs` in one number."""
    act = F.col("action_type")
    flags = {OK: F.col("ok"), HAS_FIT: F.col("has_fit"), IS_FIX: act == "CODE_FIX",
             IS_DATA: act.isin("FEATURE_ENGINEERING", "CODE"), IS_MODEL: act == "MODEL", IS_SUBMIT: act == "FINAL_SUBMIT",
             NO_EPISODE: F.col("episode_id").isNull(), NO_EVENT: F.col("event_id").isNull()}
    return functools.reduce(lambda a, b: a + b, [F.when(c, bit).otherwise(0) for bit, c in flags.items()])


def stream_episode_state(inputs: DataFrame, watermark: str = "1 hour", retention_days: float = 7,
                         buckets: int = 1024) -> DataFrame:
    """K1 + K2 on a streaming DataFrame from :func:`stream_inputs`. A call holds the state of the
    episodes of one bucket, about one in ``buckets`` of all. Times pandas cannot
    hold (before 1677-09-22, after 2262-04-11) count in full in the rules, as those limits for the watermark."""
    no_long = F.lit(NO_TIME)
    lo, hi = (F.lit(t).cast("timestamp") for t in PANDAS_TIMES)
    steps = inputs.select(
        F.pmod(F.xxhash64("episode_id"), F.lit(buckets)).cast("int").alias("bucket"),
        F.when(F.col("ts").isNotNull(), F.greatest(F.least("ts", hi), lo)).alias("ts"),
        F.coalesce("episode_id", no_long).alias("episode_id"), F.coalesce(F.unix_micros("ts"), no_long).alias("ts_us"),
        F.coalesce("event_id", no_long).alias("event_id"), step_facts().alias("facts"),
        F.col("metric_value").cast("double").alias("metric_value"), "max_steps",
        F.col("time_budget_seconds").cast("double").alias("time_budget_seconds"))
    return (steps.withWatermark("ts", watermark).groupBy("bucket")
            .transformWithStateInPandas(EpisodeProcessor(int(retention_days * 86_400_000)), OUTPUT_SCHEMA, "Append", "EventTime"))


def stream_step_rules(steps: DataFrame) -> DataFrame:
    """K3: stateless rules per step (same Column functions as batch)."""
    text = TR.step_text(F.col("code_body"), F.col("action_text"))
    parsed = TR.parse_action(F.col("action_text"))
    return steps.select("episode_id", "event_id", parsed["action_type"].alias("parsed_type"),
                        TR.classify_error(F.col("error_message")).alias("crash_class"),
                        F.size(TR.leak_issues(text)).cast("long").alias("n_leak_patterns"),
                        TR.hyperparam_count(text).cast("long").alias("n_hyperparams"))


def _timed(steps: DataFrame) -> DataFrame:
    return steps.select(F.col("ts").cast("timestamp").alias("ts"),
                        F.coalesce("execution_success", F.lit(False)).alias("ok"),
                        TR.classify_error(F.col("error_message")).alias("crash_class"))


def _failure_counts() -> list:
    failed = ~F.col("ok")
    return [F.count(F.lit(1)).alias("n_steps"), F.sum(failed.cast("long")).alias("n_failed"),
            *[F.sum((failed & (F.col("crash_class") == c)).cast("long")).alias(f"n_{c}") for c in CRASH_CLASSES]]


def windowed_failure_rate(steps: DataFrame, window: str = "1 hour", watermark: str = "2 hours") -> DataFrame:
    """K4: steps, failures and failures per crash class per tumbling window."""
    return _timed(steps).withWatermark("ts", watermark).groupBy(F.window("ts", window).alias("w")).agg(*_failure_counts())


def unwindowed_rows(folder: str, window: str = "1 hour", watermark: str = "2 hours") -> Callable[[DataFrame, int], None]:
    """K4's side sink (for ``foreachBatch`` over the same steps): writes per batch the counts
    of the rows no window takes, ``no_time`` and ``late`` (the window ended before the
    watermark, which is the latest time of the batches before less the delay), and the latest time seen. A
    batch's rows replace those of the same batch, so a replay changes nothing."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = None
        if batch_id:
            old = spark.read.schema("batch long, latest long").parquet(f"{folder}/batch=*").where(F.col("batch") < batch_id)
            seen = old.agg(F.max("latest").alias("l")).first().l             # a row a batch
        timed = _timed(batch)
        wide = F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"INTERVAL {window}"))
        ends = (F.floor(F.unix_micros("ts") / wide) + 1) * wide          # of the window; window() itself drops null times
        closed = F.unix_micros(F.timestamp_micros(F.lit(seen).cast("long")) - F.expr(f"INTERVAL {watermark}"))
        side = F.when(F.col("ts").isNull(), "no_time").when(ends <= closed, "late")
        (timed.select("ts", "ok", side.alias("side")).groupBy("side").agg(
            F.max(F.unix_micros("ts")).alias("latest"), F.count(F.lit(1)).alias("n_steps"),
            F.sum((~F.col("ok")).cast("long")).alias("n_failed"))
            .select(F.lit(batch_id).cast("long").alias("batch"), "side", "latest", "n_steps", "n_failed")
            .write.mode("overwrite").parquet(f"{folder}/batch={batch_id}"))
    return sink


def append_steps_stream(steps: DataFrame, path: str, keys: tuple[str, ...] = ("episode_id", "event_id"),
                        watermark: str = "1 day"):
    """S8 on a stream: a writer that appends step records to the log, by batch and day. A
    record delivered again within the watermark is dropped by its keys; a batch that is
    run again replaces its own partitions, so it adds no rows. Records without a time
    go to the day of null."""
    once = steps.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(list(keys))

    def sink(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("dt", F.to_date("ts")).withColumn("batch", F.lit(batch_id).cast("long"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "dt").parquet(path))
    return once.writeStream.foreachBatch(sink)


# ------------------------------------------------------------------ runner
def rocksdb(spark: SparkSession) -> None:
    """State in RocksDB, committed as the changes of a batch."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def finish(writer, checkpoint: str) -> None:
    """Runs a stream over everything available; its state is in ``checkpoint``."""
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def run_available_now(df: DataFrame, name: str, mode: str = "append", base: str | None = None) -> DataFrame:
    """Run a streaming DataFrame over everything available, into a parquet
    sink under the shared checkpoint folder, and read the result back. With
    ``base`` of an earlier run it goes on where that one stopped."""
    spark = df.sparkSession
    rocksdb(spark)
    base = base or scratch_path(spark, f"stream-{name}-{uuid.uuid4().hex[:12]}")
    finish(df.writeStream.format("parquet").outputMode(mode).option("path", f"{base}/out"), f"{base}/chk")
    return spark.read.parquet(f"{base}/out")


def run_available_now_updates(df: DataFrame, name: str, key_cols: list[str], base: str | None = None) -> DataFrame:
    """Update-mode run: every micro-batch writes its updated rows to the folder of its
    batch id (a replay replaces them); the result keeps each key's last
    update -- windows the watermark has not closed yet are included."""
    spark = df.sparkSession
    rocksdb(spark)
    base = base or scratch_path(spark, f"stream-{name}-{uuid.uuid4().hex[:12]}")
    out = f"{base}/out"

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    finish(df.writeStream.outputMode("update").foreachBatch(sink), f"{base}/chk")
    res = spark.read.option("basePath", out).parquet(f"{out}/batch=*").drop("batch")
    rest = [c for c in res.columns if c not in (*key_cols, "_batch")]
    return res.groupBy(*key_cols).agg(F.max_by(F.struct(*rest), "_batch").alias("_r")).select(*key_cols, "_r.*")


class Arrivals:
    """The rows of a table that arrive in installments: they are laid out by installment
    once, then each is appended to one folder, by many tasks, before a stream over that
    folder is run on. The stream sees explicit batches, whatever order files are listed or dated in."""

    def __init__(self, rows: DataFrame, part, batches: int, name: str = "rows"):
        self.spark, self.schema, self.batches = rows.sparkSession, rows.schema, batches
        self.folder = scratch_path(self.spark, f"{name}-{uuid.uuid4().hex[:12]}")
        rows.withColumn("_part", part.cast("int")).write.partitionBy("_part").parquet(f"{self.folder}-laid")
        self.spark.createDataFrame([], self.schema).write.parquet(self.folder)      # a stream's folder must be there first

    def stream(self) -> DataFrame:
        return self.spark.readStream.schema(self.schema).parquet(self.folder)

    def replay(self, run: Callable[[], object]):
        """Lets every installment arrive and runs after each; what the last run gave."""
        laid = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("_part", T.IntegerType())])).parquet(
            f"{self.folder}-laid")
        out = None
        for k in range(self.batches):
            laid.where(F.col("_part") == k).drop("_part").write.mode("append").parquet(self.folder)
            out = run()
        return out


def installment(events: DataFrame, batches: int):
    """The installment of each row of a table with ``ts``, by time; rows without a time come first."""
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    lo, hi = events.agg(F.min(ts), F.max(ts)).first()
    width = ((hi or 0) - (lo or 0)) // batches + 1
    return F.coalesce(F.floor((ts - F.lit(lo or 0)) / width), F.lit(0))
