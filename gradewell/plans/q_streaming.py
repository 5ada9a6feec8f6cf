"""Registered streaming queries (K1-K4, S8): the events arrive in installments, a
Structured Streaming query is run on after each from its checkpoint (``availableNow``) into a
sink under the shared checkpoint folder, and the sink's rows are returned."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gradewell.functions import text_rules as TR
from gradewell.plans import fixtures as X
from gradewell.plans.q_episodes import SQL_STATE, _classify_sql, M
from gradewell.plans.registry import query
from gradewell.session import scratch_path
from gradewell.sources.io import read_table
from gradewell.streaming import episode_stream as K


BATCHES = 4


def _base(spark, name):
    return scratch_path(spark, f"stream-{name}-{uuid.uuid4().hex[:12]}")


def _arriving_steps(spark, sf_dir, name):
    """The step log, as it arrives."""
    events = read_table(spark, sf_dir, "events")
    t = X.tasks(spark, sf_dir).select("task_key", "task_id")
    steps = X.steps_from_events(events).join(t, "task_key").drop("task_key")
    return K.Arrivals(steps, K.installment(events, BATCHES), BATCHES, name)


def _episode_events(spark, sf_dir, name):
    arrivals, base = _arriving_steps(spark, sf_dir, name), _base(spark, name)
    X.tasks(spark, sf_dir).select("task_id", "max_steps", "time_budget_seconds").write.parquet(f"{base}-tasks")
    out = K.stream_episode_state(K.stream_inputs(arrivals.stream(), spark.read.parquet(f"{base}-tasks")))
    return arrivals.replay(lambda: K.run_available_now(out, name, base=base))


@query("k1_stream_episode_state", X.ctes(SQL_STATE) + """
SELECT episode_id, event_id, step_idx, CAST(repair_attempts AS BIGINT) AS repair_attempts,
  CAST(repair_successes AS BIGINT) AS repair_successes, CAST(consecutive_failures AS BIGINT) AS consecutive_failures,
  CAST(cycle_count AS BIGINT) AS cycle_count, round(metric_cf, 9) AS best_metric, done
FROM state""")
def k1_stream_episode_state(spark, sf_dir):
    out = _episode_events(spark, sf_dir, "k1")
    return out.where(F.col("event") == "step").select(
        "episode_id", "event_id", "step_idx", "repair_attempts", "repair_successes", "consecutive_failures",
        "cycle_count", F.round("best_metric", 9).alias("best_metric"), "done")


@query("k2_stream_budget_timeout", X.ctes(SQL_STATE, f"""
lim AS (SELECT min(epoch_us(ts)) AS lo, (max(epoch_us(ts)) - min(epoch_us(ts))) // {BATCHES} + 1 AS width FROM events),
wm AS (SELECT p AS part, (SELECT max(epoch_ms(ts)) - 3600000 FROM events, lim WHERE (epoch_us(ts) - lo) // width <= p) AS ms
  FROM (SELECT unnest(range({BATCHES})) AS p)),
kept AS (SELECT s.*, (epoch_us(ts) - lo) // width AS part, min(epoch_ms(ts)) OVER (PARTITION BY episode_id)
    + CAST(time_budget_seconds * 1000 AS BIGINT) AS due FROM state s, lim),
opened AS (SELECT k.episode_id, min(wm.part) AS upto FROM kept k JOIN wm ON wm.ms >= k.due AND wm.part >= k.part
  WHERE k.step_idx = 0 GROUP BY k.episode_id)""") + """
SELECT episode_id, CAST(max_by(cycle_count, step_idx) AS BIGINT) AS cycle_count,
  round(arg_max(metric_cf, step_idx), 9) AS best_metric
FROM kept JOIN opened USING (episode_id) WHERE part <= upto GROUP BY episode_id HAVING NOT bool_or(done)""")
def k2_stream_budget_timeout(spark, sf_dir):
    """Episodes whose budget ran out (event time, 1 hour watermark) while no step that
    had arrived had ended them: one timeout row each, emitted when the watermark passes."""
    out = _episode_events(spark, sf_dir, "k2")
    return out.where(F.col("event") == "timeout").select(
        "episode_id", "cycle_count", F.round("best_metric", 9).alias("best_metric"))


@query("k3_stream_step_rules", X.with_views(f"""
SELECT episode_id, event_id,
  CASE WHEN {M(TR.ACTION_HEADER, 't')} THEN upper(regexp_extract(t, {TR.sql_str(TR.Rx(TR.ACTION_HEADER.pattern + '((?s:.*))', 'im').re2())}, 1))
    ELSE 'CODE' END AS parsed_type,
  {_classify_sql('error_message')} AS crash_class,
  CAST({' + '.join(f"CAST({M(rx, 'text')} AS INTEGER)" for rx in TR.LEAKAGE)} AS BIGINT) AS n_leak_patterns,
  CAST({TR.sql_count('text', TR.HYPERPARAM_SET)} AS BIGINT) AS n_hyperparams
FROM (SELECT *, regexp_replace(action_text, '^\\s+|\\s+$', '', 'g') AS t,
        CASE WHEN coalesce(code_body, '') <> '' THEN code_body ELSE coalesce(action_text, '') END AS text FROM steps)""",
    X.SQL_STEPS))
def k3_stream_step_rules(spark, sf_dir):
    arrivals, base = _arriving_steps(spark, sf_dir, "k3"), _base(spark, "k3")
    rules = K.stream_step_rules(arrivals.stream())
    return arrivals.replay(lambda: K.run_available_now(rules, "k3", base=base))


#: The stand-in stream: some events have no time, some arrive with the last installment.
NO_TIME, DELAYED = 97, 211


def _late_steps(spark, sf_dir):
    eid = F.col("event_id")
    events = read_table(spark, sf_dir, "events").withColumn("ts", F.when(eid % NO_TIME != 0, F.col("ts")))
    part = F.when(eid % DELAYED == 7, BATCHES - 1).otherwise(K.installment(events, BATCHES))
    return K.Arrivals(X.steps_from_events(events), part, BATCHES, "k4")


_K4_CLASSES = [f"n_{c}" for c in K.CRASH_CLASSES]


@query("k4_windowed_failure_rate", X.ctes(X.SQL_STEPS, f"""
x AS (SELECT event_id, execution_success AS ok, {_classify_sql('error_message')} AS crash,
        CASE WHEN event_id % {NO_TIME} <> 0 THEN ts END AS t FROM steps),
lim AS (SELECT min(epoch_us(t)) AS lo, (max(epoch_us(t)) - min(epoch_us(t))) // {BATCHES} + 1 AS width FROM x),
p AS (SELECT x.*, CASE WHEN event_id % {DELAYED} = 7 THEN {BATCHES - 1} ELSE coalesce((epoch_us(t) - lo) // width, 0) END AS part FROM x, lim),
w AS (SELECT b.part, max(p.t) - INTERVAL 2 HOUR AS wm FROM (SELECT DISTINCT part FROM p) b LEFT JOIN p ON p.part < b.part GROUP BY b.part),
s AS (SELECT p.*, CASE WHEN t IS NULL THEN 'no_time' WHEN date_trunc('hour', t) + INTERVAL 1 HOUR <= wm THEN 'late'
        ELSE 'window' END AS side FROM p JOIN w USING (part))""") + """
SELECT CASE WHEN side = 'window' THEN strftime(date_trunc('hour', t), '%Y-%m-%d %H:%M:%S') END AS window_start, side,
  CAST(count(*) AS BIGINT) AS n_steps, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) AS BIGINT) AS n_failed,
""" + ",\n".join(f"  CASE WHEN side = 'window' THEN CAST(sum(CASE WHEN NOT ok AND crash = '{c}' THEN 1 ELSE 0 END) AS BIGINT) END AS n_{c}"
                  for c in K.CRASH_CLASSES) + """
FROM s GROUP BY 1, 2""")
def k4_windowed_failure_rate(spark, sf_dir):
    """Failures by window, and what no window takes: steps without a time and
    steps that come after their window was closed. Every step is in one row."""
    arrivals, base = _late_steps(spark, sf_dir), _base(spark, "k4")
    steps = arrivals.stream()

    def run():
        K.finish(steps.writeStream.foreachBatch(K.unwindowed_rows(f"{base}-side")), f"{base}-side-chk")
        return K.run_available_now_updates(K.windowed_failure_rate(steps), "k4", ["w"], base=base)
    out = arrivals.replay(run)
    windows = out.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), F.lit("window").alias("side"),
                         "n_steps", "n_failed", *_K4_CLASSES)
    rest = spark.read.parquet(f"{base}-side/batch=*").where("side is not null").groupBy("side").agg(
        F.sum("n_steps").alias("n_steps"), F.sum("n_failed").alias("n_failed"))
    return windows.unionByName(rest, allowMissingColumns=True)


# ------------------------------------------------------------------ S8 on a stream
AGAIN = 13


@query("s8_stream_append", X.with_views("""
SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS dt, CAST(count(*) AS BIGINT) AS n_steps,
  CAST(sum(CASE WHEN execution_success THEN 1 ELSE 0 END) AS BIGINT) AS n_ok
FROM steps GROUP BY CAST(ts AS DATE)""", X.SQL_STEPS))
def s8_stream_append(spark, sf_dir):
    """The step log appended from a source that delivers some records twice
    (in one batch or in the next): each is in the log once."""
    events = read_table(spark, sf_dir, "events")
    twice = F.when(F.col("event_id") % AGAIN == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = X.steps_from_events(events).withColumn("ts", F.col("ts").cast("timestamp")).withColumn("copy", F.explode(twice))
    part = F.least(K.installment(events, BATCHES) + F.col("copy"), F.lit(BATCHES - 1))
    arrivals = K.Arrivals(rows, part, BATCHES, "s8")
    steps = arrivals.stream().drop("copy")
    base = _base(spark, "s8")
    K.rocksdb(spark)
    arrivals.replay(lambda: K.finish(K.append_steps_stream(steps, f"{base}/log"), f"{base}/chk"))
    log = spark.read.parquet(f"{base}/log")
    return log.groupBy(F.date_format("dt", "yyyy-MM-dd").alias("dt")).agg(
        F.count(F.lit(1)).alias("n_steps"), F.sum(F.col("execution_success").cast("long")).alias("n_ok"))
