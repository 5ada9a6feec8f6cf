"""The step log gives every text rule cases for and against it."""

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"
RULES = ["t7", "t11", "t12", "t13", "t15", "t16", "t17", "t19", "t21", "t22"]
NAMES = sorted(n for n in entry.queries() if n.split("_")[0] in RULES)


@pytest.mark.parametrize("name", NAMES)
def test_every_rule_column_varies(spark, name):
    df = entry.queries()[name](spark, SF)
    cols = [c for c, t in df.dtypes if c not in ("episode_id", "step_idx", "event_id") and t in (
        "boolean", "int", "bigint", "double")]
    rows = [r.asDict() for r in df.collect()]
    assert cols and rows
    for c in cols:
        assert len({r[c] for r in rows}) > 1, (name, c)


def test_every_verdict_varies(spark):
    from pyspark.sql import functions as F
    rows = entry.queries()["r1_verdict_table"](spark, SF).groupBy("validator").agg(
        F.countDistinct("score").alias("n"), F.countDistinct("passed").alias("p")).collect()
    assert len(rows) == 22
    assert all(r.n > 1 and r.p == 2 for r in rows), [r for r in rows if r.n < 2 or r.p < 2]
