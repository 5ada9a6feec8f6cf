from pyspark.sql import functions as F

from gradewell.operators import integrity as C


def test_split_sizes_formula():
    assert C.split_sizes(300) == (210, 45, 45)
    assert C.split_sizes(10) == (7, 1, 2)


def test_stratified_split_exact_and_stable(spark):
    rows = [(i, "a" if i % 3 else "b") for i in range(5000)]
    df = spark.createDataFrame(rows, "id long, label string")
    s1 = C.stratified_split(df, "id", "label")
    counts = {(r["label"], r["split"]): r["n"] for r in s1.groupBy("label", "split").agg(F.count("*").alias("n")).collect()}
    for lab, n in [("a", 3333), ("b", 1667)]:
        tr, va, te = C.split_sizes(n)
        assert (counts[(lab, "train")], counts[(lab, "valid")], counts[(lab, "test")]) == (tr, va, te)
    # same assignment whatever the partitioning
    s2 = C.stratified_split(df.repartition(7), "id", "label")
    a = {r["id"]: r["split"] for r in s1.collect()}
    b = {r["id"]: r["split"] for r in s2.collect()}
    assert a == b and len(a) == 5000


def test_fingerprint_order_free_and_sensitive(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(200)], "k long, v string")
    f1 = C.table_fingerprint(df).first()
    f2 = C.table_fingerprint(df.repartition(5).orderBy(F.desc("k"))).first()
    assert f1 == f2
    changed = df.withColumn("v", F.when(F.col("k") == 17, "x").otherwise(F.col("v")))
    assert C.table_fingerprint(changed).first() != f1
    res = C.check_intact(df, changed).first()
    assert not res["intact"] and res["changed_rows"] == 2 and res["penalty"] == 0.3


def test_row_loss_and_valid_frac(spark):
    df = spark.createDataFrame([(i, None if i < 20 else i) for i in range(100)], "a long, b long")
    r = C.row_loss_frac(df, df.dropna()).first()
    assert r["rows_after"] == 80 and abs(r["row_loss_frac"] - 0.2) < 1e-12 and r["flagged"]
    sp = spark.createDataFrame([("train",)] * 97 + [("valid",)] * 3, "split string")
    v = C.valid_frac(sp).first()
    assert v["flagged"] and abs(v["valid_frac"] - 0.03) < 1e-12


def test_distributed_row_number_matches_window(spark):
    from pyspark.sql.window import Window
    from gradewell.functions.ranking import distributed_row_number
    # one hot key holding most rows, many small ones
    rows = [(0 if i % 3 else i % 17, (i * 7919) % 1000, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, t long, id long")
    got = {r["id"]: r["rn"] for r in distributed_row_number(df, ["k"], ["t", "id"]).collect()}
    w = Window.partitionBy("k").orderBy("t", "id")
    want = {r["id"]: r["rn"] for r in df.withColumn("rn", F.row_number().over(w) - 1).collect()}
    assert got == want


def test_a_class_of_most_rows_is_dealt_out(spark):
    """Rows meet the cuts by class and group of buckets, not by class alone."""
    rows = spark.range(3000).selectExpr("id", "if(id % 50 = 0, null, 'a') as label")
    s = C.stratified_split(rows, "id", "label", hash_method="md5")
    plan = s._jdf.queryExecution().optimizedPlan().toString()
    joins = [ln for ln in plan.splitlines() if "Join Inner" in ln]
    assert joins and all("_g" in ln for ln in joins)
    n = {(r.label, r.split): r["count"] for r in s.groupBy("label", "split").count().collect()}
    assert n == {("a", "train"): 2058, ("a", "valid"): 441, ("a", "test"): 441,
                 (None, "train"): 42, (None, "valid"): 9, (None, "test"): 9}


def test_split_of_few_rows_and_one_key(spark):
    for n in (1, 2, 3, 7):
        s = C.stratified_split(spark.range(n).selectExpr("1 as k", "'a' as label"), "k", "label")
        got = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
        want = dict(zip(("train", "valid", "test"), C.split_sizes(n)))
        assert got == {k: v for k, v in want.items() if v}, n
