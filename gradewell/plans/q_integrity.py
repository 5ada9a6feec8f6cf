"""Registered split and integrity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradewell.operators import integrity as C
from gradewell.plans import fixtures as X
from gradewell.plans.registry import query
from gradewell.sources.io import read_table


def _md5_sql(expr: str) -> str:
    return f"CAST('0x' || substr(md5({expr}), 1, 15) AS BIGINT)"


def _split_sql(rows: str, key: str, label: str | None) -> str:
    part = f"PARTITION BY {label}" if label else ""
    return f"""
WITH b AS ({rows}),
h AS (SELECT *, {_md5_sql("'42:' || CAST(" + key + " AS VARCHAR)")} AS h FROM b),
r AS (SELECT *, row_number() OVER ({part} ORDER BY h, {key}) - 1 AS rk, count(*) OVER ({part}) AS n FROM h),
c AS (SELECT *, n - least(ceil(CAST(0.3 AS DOUBLE) * n), n - 1) AS c1,
             n - ceil(least(ceil(CAST(0.3 AS DOUBLE) * n), n - 1) * CAST(0.5 AS DOUBLE)) AS c2 FROM r)
SELECT * EXCLUDE (h, rk, n, c1, c2),
  CASE WHEN rk < c1 THEN 'train' WHEN rk < c2 THEN 'valid' ELSE 'test' END AS split FROM c"""


_LI_ROWS = "SELECT l_orderkey * 8 + l_linenumber AS row_id, l_returnflag AS label FROM lineitem"
_C1_SQL = _split_sql(_LI_ROWS, "row_id", "label")


def _lineitem_rows(spark, sf_dir):
    return read_table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"), F.col("l_returnflag").alias("label"))


@query("c1_stratified_split", _C1_SQL)
def c1_stratified_split(spark, sf_dir):
    return C.stratified_split(_lineitem_rows(spark, sf_dir), "row_id", "label", hash_method="md5")


@query("c1_split_counts", f"SELECT label, split, CAST(count(*) AS BIGINT) AS n FROM ({_C1_SQL}) GROUP BY label, split")
def c1_split_counts(spark, sf_dir):
    s = C.stratified_split(_lineitem_rows(spark, sf_dir), "row_id", "label", hash_method="md5")
    return s.groupBy("label", "split").agg(F.count(F.lit(1)).alias("n"))


# a third of the rows without a class, and classes of one row
_LONE = ("SELECT l_orderkey * 8 + l_linenumber AS row_id, CASE WHEN l_returnflag = 'R' THEN NULL "
         "WHEN l_orderkey <= 20 THEN 'lone' || (l_orderkey * 8 + l_linenumber) ELSE l_returnflag END AS label FROM lineitem")


@query("c1_stratified_split_null_class", _split_sql(_LONE, "row_id", "label"))
def c1_stratified_split_null_class(spark, sf_dir):
    rows = read_table(spark, sf_dir, "lineitem").withColumn("row_id", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    label = (F.when(F.col("l_returnflag") == "R", None)
             .when(F.col("l_orderkey") <= 20, F.concat(F.lit("lone"), "row_id")).otherwise(F.col("l_returnflag")))
    return C.stratified_split(rows.select("row_id", label.alias("label")), "row_id", "label", hash_method="md5")


@query("c2_random_split", _split_sql("SELECT o_orderkey FROM orders", "o_orderkey", None))
def c2_random_split(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select("o_orderkey")
    return C.random_split(o, "o_orderkey", hash_method="md5")


_DOC_COLS = ["doc_id", "text", "lang", "source", "n_chars"]


def _fp_sql(table: str, cols: list[str]) -> str:
    txt = "(" + " || ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), 'N')" for c in cols) + ")"
    return f"""SELECT CAST(count(*) AS BIGINT) AS n_rows, coalesce(bit_xor(h), 0) AS fp_xor,
  CAST(coalesce(sum(CAST(h AS HUGEINT)), 0) AS VARCHAR) AS fp_sum
FROM (SELECT {_md5_sql(txt)} AS h FROM {table})"""


@query("c3_table_fingerprint", _fp_sql("documents", _DOC_COLS))
def c3_table_fingerprint(spark, sf_dir):
    return C.table_fingerprint(read_table(spark, sf_dir, "documents"), _DOC_COLS)


#: A table and its copies that differ only where a null became a text, and where a separator moved from one column to the next.
_HOLES = "SELECT doc_id, text, CASE WHEN doc_id % 10 <> 3 THEN lang END AS lang, source || chr(31) AS source, n_chars FROM documents"
_FILLED = ("SELECT doc_id, text, CASE WHEN doc_id % 10 <> 3 THEN lang ELSE '<null>' END AS lang, source || chr(31) AS source, "
           "n_chars FROM documents")
_MOVED = ("SELECT doc_id, text, CASE WHEN doc_id % 10 <> 3 THEN CASE WHEN doc_id % 7 = 1 THEN lang || chr(31) ELSE lang END END AS lang, "
          "CASE WHEN doc_id % 7 = 1 AND doc_id % 10 <> 3 THEN source ELSE source || chr(31) END AS source, n_chars FROM documents")


@query("c3_table_fingerprint_nulls", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, * FROM ({_fp_sql('(' + q + ')', _DOC_COLS)})" for n, q in
    (("holes", _HOLES), ("filled", _FILLED), ("moved", _MOVED))))
def c3_table_fingerprint_nulls(spark, sf_dir):
    holes, filled, moved = _null_tables(spark, sf_dir)
    tables = [C.table_fingerprint(t, _DOC_COLS).withColumn("table_name", F.lit(n))
              for n, t in (("holes", holes), ("filled", filled), ("moved", moved))]
    return tables[0].unionByName(tables[1]).unionByName(tables[2])


def _null_tables(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select(*_DOC_COLS)
    known, mark = F.col("doc_id") % 10 != 3, F.lit(chr(31))
    moves = known & (F.col("doc_id") % 7 == 1)
    ends = d.withColumn("source", F.concat("source", mark))
    holes = ends.withColumn("lang", F.when(known, F.col("lang")))
    filled = ends.withColumn("lang", F.when(known, F.col("lang")).otherwise("<null>"))
    moved = d.withColumn("source", F.when(moves, F.col("source")).otherwise(F.concat("source", mark))).withColumn(
        "lang", F.when(moves, F.concat("lang", mark)).when(known, F.col("lang")))
    return holes, filled, moved


_STRIPPED = ("SELECT doc_id, regexp_replace(text, '\\s+$', '') AS text, lang, source, n_chars FROM documents")


@query("c4_check_intact", f"""
WITH fb AS ({_fp_sql('documents', _DOC_COLS)}),
fs AS ({_fp_sql('(' + _STRIPPED + ')', _DOC_COLS)}),
st AS ({_STRIPPED}),
ch AS (SELECT count(*) AS n FROM ((SELECT * FROM documents EXCEPT ALL SELECT * FROM st)
                                  UNION ALL (SELECT * FROM st EXCEPT ALL SELECT * FROM documents)))
SELECT 'documents' AS table_name, true AS intact, CAST(0 AS BIGINT) AS changed_rows, CAST(1.0 AS DOUBLE) AS score,
  CAST(0.0 AS DOUBLE) AS penalty
UNION ALL
SELECT 'documents_stripped', (fb.n_rows = fs.n_rows AND fb.fp_xor = fs.fp_xor AND fb.fp_sum = fs.fp_sum),
  CAST(ch.n AS BIGINT),
  CASE WHEN fb.n_rows = fs.n_rows AND fb.fp_xor = fs.fp_xor AND fb.fp_sum = fs.fp_sum THEN 1.0 ELSE 0.0 END,
  CASE WHEN fb.n_rows = fs.n_rows AND fb.fp_xor = fs.fp_xor AND fb.fp_sum = fs.fp_sum THEN 0.0 ELSE 0.3 END
FROM fb, fs, ch
""" + "".join(f"""UNION ALL SELECT '{n}', count(*) = 0, count(*), CASE WHEN count(*) = 0 THEN 1.0 ELSE 0.0 END, CASE WHEN count(*) = 0 THEN 0.0 ELSE 0.3 END
FROM (({_HOLES} EXCEPT ALL {q}) UNION ALL ({q} EXCEPT ALL {_HOLES})) """ for n, q in (("null_filled", _FILLED), ("separator_moved", _MOVED))))
def c4_check_intact(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select(*_DOC_COLS)
    stripped = d.withColumn("text", F.regexp_replace("text", r"\s+$", ""))
    same = C.check_intact(d, d).withColumn("table_name", F.lit("documents"))
    changed = C.check_intact(d, stripped).withColumn("table_name", F.lit("documents_stripped"))
    holes, filled, moved = _null_tables(spark, sf_dir)
    out = same.unionByName(changed)
    for name, t in (("null_filled", filled), ("separator_moved", moved)):
        out = out.unionByName(C.check_intact(holes, t).withColumn("table_name", F.lit(name)))
    return out


@query("c5_row_loss_frac", X.with_views(f"""
SELECT CAST(b AS BIGINT) AS rows_before, CAST(a AS BIGINT) AS rows_after, round(1 - a / b, 6) AS row_loss_frac,
  1 - a / b > 0.15 AS flagged
FROM (SELECT count(*) AS b FROM dirty_events),
     (SELECT count(*) AS a FROM dirty_events WHERE {' AND '.join(f'{c} IS NOT NULL' for c in
                                                                 ['event_id', 'user_id', 'event_type', 'value', 'amount', 'mostly_null', 'half_null', 'value2', 'props', 'day'])})""",
    X.SQL_DIRTY_EVENTS))
def c5_row_loss_frac(spark, sf_dir):
    d = X.dirty_events(spark, sf_dir)
    return C.row_loss_frac(d, d.dropna()).withColumn("row_loss_frac", F.round("row_loss_frac", 6))


@query("c6_valid_frac", f"""
SELECT CAST(n_train AS BIGINT) AS n_train, CAST(n_valid AS BIGINT) AS n_valid,
  round(n_valid / (n_train + n_valid), 6) AS valid_frac, n_valid / (n_train + n_valid) < 0.05 AS flagged
FROM (SELECT sum(CAST(split = 'train' AS BIGINT)) AS n_train, sum(CAST(split = 'valid' AS BIGINT)) AS n_valid
      FROM ({_C1_SQL}))""")
def c6_valid_frac(spark, sf_dir):
    s = C.stratified_split(_lineitem_rows(spark, sf_dir), "row_id", "label", hash_method="md5")
    return C.valid_frac(s).withColumn("valid_frac", F.round("valid_frac", 6))


@query("c7_column_drift", f"""
WITH cur AS (SELECT column_name FROM (DESCRIBE ({X.with_views('SELECT * FROM processed_events', X.SQL_PROCESSED_EVENTS)}))),
orig AS (SELECT column_name FROM (DESCRIBE ({X.with_views('SELECT * FROM dirty_events', X.SQL_DIRTY_EVENTS)}))
         WHERE column_name <> 'event_type')
SELECT column_name, 'new' AS change FROM cur WHERE column_name NOT IN (SELECT column_name FROM orig)
  AND column_name <> 'event_type'
UNION ALL
SELECT column_name, 'dropped' FROM orig WHERE column_name NOT IN (SELECT column_name FROM cur)""")
def c7_column_drift(spark, sf_dir):
    orig = [c for c in X.dirty_events(spark, sf_dir).columns if c != X.DIRTY_TARGET]
    cur = X.processed_events(spark, sf_dir).drop(X.DIRTY_TARGET)
    return C.column_drift(orig, cur)
