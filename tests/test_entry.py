import duckdb

import __spark_entry__ as entry

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert {"episode_id", "reward", "total_penalty", "n_failed"} <= set(df.columns)


def test_registry_shapes():
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 100 and len(sql) >= 85


def test_oracle_sample_on_small_tables(spark, sf0001):
    """A quick cross-section of the DuckDB oracle on sf0.001."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf0001}/{t}.parquet')")
    qs, sql = entry.queries(), entry.oracle_sql()
    for name in ["p2_missing_profile", "m1_roc_auc", "c1_split_counts", "t22_split_text", "e15_episode_state",
                 "f9_near_duplicates", "s6_explode_checklist"]:
        got = qs[name](spark, sf0001).toPandas()
        want = con.execute(sql[name]).df()
        assert sorted(got.columns) == sorted(want.columns), name
        assert len(got) == len(want), name


def test_registry_loads_without_spark():
    """The driver may ask for the oracle SQL before any session exists."""
    import subprocess
    import sys
    code = "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); print(len(q), len(s))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True,
                         cwd=__import__("os").path.dirname(__import__("os").path.dirname(__file__)), timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]


def test_step_rules_number_their_steps():
    """T1, T2, T5 and T7 name each step by its episode and index, so they number the whole log."""
    sql = entry.oracle_sql()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    for name in ["t1_parse_action", "t2_extract_code_block", "t5_classify_error", "t7_target_as_feature"]:
        assert con.execute(sql[name]).df().columns[:2].tolist() == ["episode_id", "step_idx"], name


def test_step_rules_give_episode_and_index(spark, sf0001):
    for name in ["t1_parse_action", "t7_target_as_feature"]:
        assert entry.queries()[name](spark, sf0001).columns[:2] == ["episode_id", "step_idx"], name
