from pyspark.sql import functions as F

import __spark_entry__ as entry


def test_stream_state_equals_batch_windows(spark, sf0001):
    qs = entry.queries()
    stream = qs["k1_stream_episode_state"](spark, sf0001)
    batch = qs["e15_episode_state"](spark, sf0001)
    s = {(r["episode_id"], r["step_idx"]): (r["repair_attempts"], r["best_metric"]) for r in stream.collect()}
    b = {(r["episode_id"], r["step_idx"]): (r["repair_attempts"], r["best_metric"]) for r in batch.collect()}
    assert s == b and len(s) > 0


def test_step_after_the_deadline_does_not_end_the_stream(spark, tmp_path):
    """A step that is not late can come when the watermark has passed its
    episode's deadline; state is carried over three micro-batches."""
    import datetime as dt
    import json
    from gradewell.streaming import episode_stream as K
    t0 = dt.datetime(2024, 1, 1)
    files = [[(1, 1, 0, False), (1, 2, 60, True)], [(2, 3, 36_000, True)], [(1, 4, 34_000, True), (2, 5, 36_100, True)],
             [(3, 6, 90_000, True)]]
    schema = ("episode_id long, event_id long, ts timestamp, action_type string, ok boolean, metric_value double, "
              "max_steps int, time_budget_seconds double, has_fit boolean")
    for k, rows in enumerate(files):
        data = [(e, i, t0 + dt.timedelta(seconds=s), "CODE_FIX", ok, None, 15, 300.0, False) for e, i, s, ok in rows]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out = K.run_available_now(K.stream_episode_state(stream), "probe").collect()
    steps = {r["event_id"]: r for r in out if r["event"] == "step"}
    assert steps[2]["step_idx"] == 1 and steps[2]["repair_attempts"] == 2 and steps[2]["repair_successes"] == 1
    assert steps[5]["step_idx"] == 1 and steps[5]["repair_attempts"] == 2
    timeouts = [r["episode_id"] for r in out if r["event"] == "timeout"]
    assert 1 in timeouts or steps.get(4) is not None
    assert len(timeouts) == len(set(timeouts))


def test_windows_and_side_rows_hold_every_step(spark, sf0001):
    out = entry.queries()["k4_windowed_failure_rate"](spark, sf0001).collect()
    ev = spark.read.parquet(f"{sf0001}/events.parquet")
    assert sum(r.n_steps for r in out) == ev.count()
    assert sum(r.n_failed for r in out) == ev.where("event_id % 5 = 0").count()
    assert {r.side for r in out} == {"window", "no_time", "late"}


def test_installments_hold_every_row_in_order_of_time(spark, tmp_path):
    import datetime as dt
    from gradewell.streaming import episode_stream as K
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(seconds=i)) for i in range(300)] + [(400 + i, t0 + dt.timedelta(days=9 + i % 3)) for i in range(6)]
    rows += [(500 + i, None) for i in range(5)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp")
    arrivals, out = K.Arrivals(events, K.installment(events, 4), 4), f"{tmp_path}/out"

    def sink(batch, number):
        batch.select("event_id", "ts", F.lit(number).alias("b")).write.mode("append").parquet(out)
    arrivals.replay(lambda: K.finish(arrivals.stream().writeStream.foreachBatch(sink), f"{tmp_path}/chk"))
    got = spark.read.parquet(out).collect()
    assert sorted(r.event_id for r in got) == sorted(i for i, _ in rows)
    assert all(r.b == 0 for r in got if r.ts is None)
    spans = {b: [r.ts for r in got if r.b == b and r.ts] for b in {r.b for r in got}}
    order = sorted(b for b in spans if spans[b])
    assert len(order) > 1 and all(max(spans[a]) < min(spans[b]) for a, b in zip(order, order[1:]))


def test_state_goes_on_after_a_restart_and_closed_episodes_stay_closed(spark, tmp_path):
    """Five runs on one checkpoint; late, null-time and straggling steps against the batch rule."""
    import datetime as dt
    from gradewell.streaming import episode_stream as K
    t0 = dt.datetime(2024, 1, 1)
    schema = ("episode_id long, event_id long, ts timestamp, action_type string, ok boolean, metric_value double, "
              "max_steps int, time_budget_seconds double, has_fit boolean, _part int")
    rows = [(1, 1, 0, 0), (1, 2, 60, 0), (2, 3, 50, 0), (9, 4, 7200, 1), (1, 5, 120, 2), (1, 6, 100_000, 3), (1, 7, 100_060, 3),
            (9, 8, 100_100, 3), (1, 9, 100_200, 4), (3, 10, None, 1), (3, 11, 100_000, 3), (4, 12, 300_000, 4)]
    data = [(e, i, None if s is None else t0 + dt.timedelta(seconds=s), "CODE_FIX", True, None, 15, 300.0, False, p) for e, i, s, p in rows]
    df = spark.createDataFrame(data, schema)
    arrivals, base = K.Arrivals(df.withColumnRenamed("_part", "p"), F.col("p"), 5), f"{tmp_path}/base"
    out = K.stream_episode_state(arrivals.stream().drop("p"))
    got = arrivals.replay(lambda: K.run_available_now(out, "restart", base=base)).collect()
    steps = {r.event_id: (r.step_idx, r.done) for r in got if r.event == "step"}
    # step 5 came after the watermark had passed it: late, dropped by Spark; 6 ends episode 1, 7 and 9 come after its end
    assert steps == {1: (0, False), 2: (1, False), 3: (0, False), 4: (0, False), 6: (2, True), 8: (1, True), 10: (0, False),
                     11: (1, False), 12: (0, False)}
    timeouts = sorted(r.episode_id for r in got if r.event == "timeout")
    assert timeouts == sorted(set(timeouts)) and {1, 2, 3} <= set(timeouts) | {9}


def test_a_replayed_batch_adds_no_rows(spark, tmp_path):
    import datetime as dt
    from gradewell.streaming import episode_stream as K
    K.rocksdb(spark)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, i % 10, t0 + dt.timedelta(minutes=i % 10), f"s{i % 10}") for i in range(14)] + [(2, 50, None, "no time"), (2, 50, None, "no time")]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "episode_id long, event_id long, ts timestamp, t string").write.parquet(src)
    stream = spark.readStream.schema("episode_id long, event_id long, ts timestamp, t string").parquet(src)
    log = f"{tmp_path}/log"
    K.finish(K.append_steps_stream(stream, log), f"{tmp_path}/chk")
    first = sorted((r.event_id, r.t) for r in spark.read.parquet(log).collect())
    assert first == sorted({(i % 10, f"s{i % 10}") for i in range(14)} | {(50, "no time")})
    K.finish(K.append_steps_stream(stream, log), f"{tmp_path}/chk2")          # the same batch id again, from the start
    assert sorted((r.event_id, r.t) for r in spark.read.parquet(log).collect()) == first


def test_step_without_time_counts_and_takes_none(spark, tmp_path):
    import datetime as dt
    from gradewell.streaming import episode_stream as K
    schema = ("episode_id long, event_id long, ts timestamp, action_type string, ok boolean, metric_value double, "
              "max_steps int, time_budget_seconds double, has_fit boolean")
    t0 = dt.datetime(2024, 1, 1)
    data = [(1, i, t, "CODE_FIX", True, None, 15, 300.0, False) for i, t in ((1, t0), (2, None), (3, t0 + dt.timedelta(seconds=9)))]
    spark.createDataFrame(data, schema).coalesce(1).write.json(str(tmp_path / "in"))
    out = K.run_available_now(K.stream_episode_state(spark.readStream.schema(schema).json(str(tmp_path / "in"))), "notime").collect()
    assert {r.event_id: (r.step_idx, r.done) for r in out if r.event == "step"} == {2: (0, False), 1: (1, False), 3: (2, False)}


STEP_SCHEMA = ("episode_id long, event_id long, ts timestamp, action_type string, ok boolean, metric_value double, "
               "max_steps int, time_budget_seconds double, has_fit boolean")


def test_state_of_many_episodes_is_one_state_a_bucket(spark, tmp_path):
    from gradewell.streaming import episode_stream as K
    src, base = str(tmp_path / "in"), str(tmp_path / "base")
    t0 = F.timestamp_seconds(F.lit(1704067200) + F.col("id"))
    spark.range(3000).select(
        F.col("id").alias("episode_id"), F.col("id").alias("event_id"), t0.alias("ts"), F.lit("CODE").alias("action_type"),
        F.lit(True).alias("ok"), F.lit(None).cast("double").alias("metric_value"), F.lit(15).alias("max_steps"),
        F.lit(300.0).alias("time_budget_seconds"), F.lit(False).alias("has_fit")).write.parquet(src)
    got = K.run_available_now(K.stream_episode_state(spark.readStream.schema(STEP_SCHEMA).parquet(src)), "many", base=base)
    assert got.where("event = 'step'").select("episode_id").distinct().count() == 3000
    state = spark.read.format("statestore").option("stateVarName", "episodes").load(f"{base}/chk")
    assert 0 < state.count() <= 1024


def test_episodes_of_one_bucket_keep_their_own_counters_and_times(spark, tmp_path):
    """Five runs on one checkpoint, all episodes in one bucket and each in its own: the same rows.
    Ids no double holds, null ids, a time pandas cannot hold."""
    import datetime as dt
    from gradewell.streaming import episode_stream as K
    t0, big = dt.datetime(2024, 1, 1), 2**53
    rows = [(1, 1, 0, 0), (1, 2, 60, 0), (2, big + 1, 50, 0), (9, 4, 7200, 1), (1, 5, 120, 2), (2, 15, 100, 0), (1, 6, 100_000, 3),
            (1, 7, 100_060, 3), (9, 8, 100_100, 3), (1, 9, 100_200, 4), (3, 10, None, 1), (3, 11, 100_000, 3), (4, 12, 300_000, 4),
            (big + 1, 13, 10, 0), (None, 14, 20, 0), (None, None, 30, 0), (big, 16, 40, 0), (5, 17, 250_000_000_000, 4)]
    data = [(e, i, None if s is None else t0 + dt.timedelta(seconds=s), "CODE_FIX", True, None, 15, 300.0, False, p) for e, i, s, p in rows]
    df = spark.createDataFrame(data, STEP_SCHEMA + ", _part int").withColumnRenamed("_part", "p")
    found = []
    for buckets in (1, 1024):
        arrivals, base = K.Arrivals(df, F.col("p"), 5), f"{tmp_path}/base{buckets}"
        out = K.stream_episode_state(arrivals.stream().drop("p"), buckets=buckets)
        got = arrivals.replay(lambda: K.run_available_now(out, "buckets", base=base)).collect()
        found.append(sorted(map(repr, got)))
        steps = {(r.episode_id, r.event_id): r.step_idx for r in got if r.event == "step"}
        assert steps == {(1, 1): 0, (1, 2): 1, (2, big + 1): 0, (2, 15): 1, (9, 4): 0, (1, 6): 2, (9, 8): 1, (3, 10): 0, (3, 11): 1,
                         (4, 12): 0, (big + 1, 13): 0, (None, 14): 0, (None, None): 1, (big, 16): 0, (5, 17): 0}
        timeouts = [r.episode_id for r in got if r.event == "timeout"]
        assert len(timeouts) == len(set(timeouts)) and set(timeouts) == {1, 2, 3, 4, big, big + 1, None}
    assert found[0] == found[1]


def test_an_episode_of_many_rows_keeps_only_the_first(spark, tmp_path):
    import datetime as dt
    from gradewell.streaming import episode_stream as K
    t0 = dt.datetime(2024, 1, 1)
    data = [(e, i, t0 + dt.timedelta(seconds=(i * 7919) % 3000), "CODE_FIX", True, float(i), 3, 1e9, False)
            for e, n in ((1, 3000), (2, 3)) for i in range(n)]
    spark.createDataFrame(data, STEP_SCHEMA).write.json(str(tmp_path / "in"))
    stream = K.stream_episode_state(spark.readStream.schema(STEP_SCHEMA).json(str(tmp_path / "in")), buckets=1)
    got = K.run_available_now(stream, "long").where("event = 'step'").collect()
    mine = {e: sorted((r.step_idx, r.event_id, r.dropped_after_done, r.done) for r in got if r.episode_id == e) for e in (1, 2)}
    first = sorted(range(3000), key=lambda i: (i * 7919) % 3000)[:4]
    assert mine[1] == [(k, i, 2996, k == 3) for k, i in enumerate(first)]
    assert mine[2] == [(k, i, 0, False) for k, i in enumerate(sorted(range(3), key=lambda i: (i * 7919) % 3000))]
