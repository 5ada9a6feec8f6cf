"""Same answer with 1 and with 200 shuffle partitions (and AQE off)."""

import pytest

import __spark_entry__ as entry

NAMES = ["m1_roc_auc", "c1_split_counts", "p7_duplicate_count", "e4_cycle_count", "f9_near_duplicates",
         "t12_corr_pair_handled"]


def _rows(df):
    return sorted(tuple(str(v) for v in r) for r in df.collect())


@pytest.mark.parametrize("name", NAMES)
def test_partition_count_invariance(spark, sf0001, name):
    q = entry.queries()[name]
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    one = _rows(q(spark, sf0001))
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        many = _rows(q(spark, sf0001))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert one == many
