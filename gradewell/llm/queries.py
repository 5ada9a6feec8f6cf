"""The registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.llm.blocks import WORD_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------ 1 substring dedup

OP1_SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD_SQL}') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k
        FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 12)) AS i FROM w WHERE len(ws) >= 13)),
firsts AS (SELECT k, min(doc_id) AS d FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS p
         FROM win JOIN firsts USING (k) WHERE doc_id > d),
pos AS (SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS p FROM w WHERE len(ws) > 0),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n
         FROM pos ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


@query("op1_substring_dedup", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gradewell.llm.substring_dedup import repeated_windows
    out = repeated_windows(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


# ------------------------------------------------------------ 7 mixing

OP7_SQL = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD_SQL}')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM d GROUP BY source),
lev AS (SELECT *, source_size * 2 AS lim,
        (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(source_size * 2) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl
        FROM s WINDOW o AS (ORDER BY source_size * 2 / w::DOUBLE, source NULLS LAST)),
mix AS (SELECT source, source_size, least(lim::DOUBLE,
               (max(CASE WHEN lvl * w <= lim THEN lvl END) OVER ()) * w) AS target FROM lev),
c AS (SELECT *, length(bin(size)) * 8 + (size >> greatest(length(bin(size)) - 3, 0)) AS cls,
             ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % ((SELECT count(*) FROM d) // 2000 + 1) AS part FROM d),
r AS (SELECT c.doc_id, c.size, mix.*,
             row_number() OVER (PARTITION BY c.source ORDER BY cls, part, size, doc_id NULLS LAST) AS k,
             CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS step,
             ('0x' || substr(md5('mix/' || coalesce(c.source, '(null)')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
      FROM c JOIN mix ON c.source IS NOT DISTINCT FROM mix.source)
SELECT doc_id, size, source_size, target,
       ((floor(k * step + u) - floor((k - 1) * step + u)) * size)::BIGINT AS taken FROM r
"""


@query("op7_mixing", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gradewell.llm.mixing import copies
    out = copies(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


# ------------------------------------------------------------ 3 quality rules

def _op3_sql() -> str:
    from gradewell.llm import quality as Q
    rules, n = Q.RULES, len(Q.RULES)
    votes = ", ".join(
        f"CASE WHEN {m} {bad} THEN 0 " + (f"WHEN {m} {good} THEN 1 " if good else "") + f"END AS v{j}"
        for j, (m, good, bad) in enumerate((r[1].replace(" / ", "::DOUBLE / "), r[2], r[3]) for r in rules))
    cols = ", ".join(f"v{j}" for j in range(n))

    def like(c: str) -> str:
        return f"s{c} * " + " * ".join(
            f"CASE v{j} WHEN 1 THEN p{c}[{2 * j + 2}] WHEN 0 THEN p{c}[{2 * j + 1}] "
            f"ELSE 1.0 - p{c}[{2 * j + 1}] - p{c}[{2 * j + 2}] END" for j in range(n))
    post = f"({like('g')}) / (({like('b')}) + ({like('g')}))"
    hi, lo = Q.RIGHT / 2, (1 - Q.RIGHT) / 2
    ems = [f"em0 AS MATERIALIZED (SELECT {1 - Q.PRIOR}::DOUBLE AS sb, {Q.PRIOR}::DOUBLE AS sg, "
           f"{[hi, lo] * n}::DOUBLE[] AS pb, {[lo, hi] * n}::DOUBLE[] AS pg)"]
    for k in range(1, Q.ITERATIONS + 1):
        def rates(c: str) -> str:
            return ", ".join(f"(sum(CASE WHEN v{j} = {v} THEN {c} ELSE 0 END) + 1) / (sum({c}) + 3)"
                             for j in range(n) for v in (0, 1))
        ems.append(f"em{k} AS MATERIALIZED (SELECT (sum(b) + 1) / (sum(b) + sum(g) + 2) AS sb, "
                   f"(sum(g) + 1) / (sum(b) + sum(g) + 2) AS sg, [{rates('b')}] AS pb, [{rates('g')}] AS pg "
                   f"FROM (SELECT *, n - g AS b FROM (SELECT *, n * ({post}) AS g FROM pat, em{k - 1})))")
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '{WORD_SQL}') AS w FROM documents),
win AS (SELECT rid, i, w[i:i + 2] AS k
        FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d WHERE len(w) >= 3)),
rep AS (SELECT rid, count(DISTINCT p) AS c FROM (
          SELECT rid, unnest([i, i + 1, i + 2]) AS p
          FROM (SELECT *, count(*) OVER (PARTITION BY rid, k) AS m FROM win) WHERE m > 1) GROUP BY rid),
m AS (SELECT doc_id, rid, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             length(regexp_replace(t, '[^|]', '', 'g')) AS n_cells, length(regexp_replace(t, '[^!]', '', 'g')) AS n_shouts,
             length(regexp_replace(t, '\\P{{Lu}}', '', 'g')) AS n_capitals,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD_SQL}')) AS lines,
             len(list_filter(range(1, len(w)), lambda j: w[j] = w[j + 1])) AS n_stutters,
             len(list_filter(w, lambda x: regexp_matches(x, '{Q.PLAIN.replace("'", "''")}'))) AS n_plain FROM d),
f AS (SELECT m.*, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
             coalesce(c, 0) AS n_repeat_words FROM m LEFT JOIN rep USING (rid)),
v AS (SELECT *, {votes} FROM f),
pat AS MATERIALIZED (SELECT {cols}, count(*) AS n FROM v GROUP BY ALL),
{", ".join(ems)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {Q.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < {Q.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND ({post}) >= 0.5 AS kept
FROM v, em{Q.ITERATIONS}
"""


@query("op3_quality_rules", _op3_sql())
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gradewell.llm.quality import assess
    return assess(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


# ------------------------------------------------------------ 10 n-gram Jaccard join

@query("op10_jaccard_join")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gradewell.llm.jaccard_join import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"))


# ------------------------------------------------------------ 8 LM scoring

@query("op8_ppm_scoring")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gradewell.llm.ppm import score_documents
    return score_documents(table(spark, sf_dir, "documents"))


# ------------------------------------------------------------ 2 token-ID / binary output

@query("op2_token_shards")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gradewell.llm.token_shards import write_shards
    return write_shards(table(spark, sf_dir, "documents")).drop("file")


# ------------------------------------------------------------ 6 toxicity

def fold(col, n: int = 5):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


@query("op6_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gradewell.llm.toxicity import fit, score
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.filter(fold(F.col("doc_id")) != 0))
    out = score(docs, model)
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


# ------------------------------------------------------------ 9 HTML extraction

@query("op9_html_extract")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gradewell.llm.html_extract import extract
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


# ------------------------------------------------------------ 5 benchmark decontamination

@query("op5_decontaminate")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gradewell.llm.decontaminate import report
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# ------------------------------------------------------------ 4 WARC

@query("op4_warc")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gradewell.llm.blocks import checkpointed
    from gradewell.llm.warc import merged_index, read_archives, write_archives
    index = checkpointed(merged_index(write_archives(table(spark, sf_dir, "pages"))))
    back = read_archives(index).drop("url").hint("merge")       # rows come out of a few names: not a side to broadcast
    where = index.select(F.col("file"), F.col("offset"), "urlkey", "captured")
    return back.join(where, ["file", "offset"]).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "captured", "intact")


# ------------------------------------------------------------ 13 source divergence audit

OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
tok AS (SELECT rid, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
lt AS MATERIALIZED (SELECT lang, term, count(*) AS c FROM tok GROUP BY ALL HAVING count(DISTINCT rid) >= 10),
gt AS MATERIALIZED (SELECT lang, source, term, count(*) AS c FROM tok SEMI JOIN lt USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(c) AS n FROM lt GROUP BY lang),
gn AS (SELECT g.lang, g.source, coalesce(sum(c), 0) AS n FROM g LEFT JOIN gt USING (lang, source) GROUP BY ALL),
p AS MATERIALIZED (
  SELECT gn.lang, gn.source, lt.term, coalesce(gt.c, 0) AS c, lt.c AS all_c,
         (1 + (1000000000::HUGEINT * (coalesce(gt.c, 0) + 2)) // (gn.n + 2 * v.v))::BIGINT AS p,
         (1 + (1000000000::HUGEINT * (lt.c + 2)) // (v.n + 2 * v.v))::BIGINT AS q
  FROM gn JOIN lt USING (lang) JOIN v USING (lang) LEFT JOIN gt USING (lang, source, term)),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
         FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE c > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
      FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT * FROM r WHERE part = 'pair' OR rank <= 10
"""


@query("op13_source_divergence", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gradewell.llm.divergence import audit
    return audit(table(spark, sf_dir, "documents"))


# ------------------------------------------------------------ 12 SimHash near-dedup

@query("op12_simhash_dedup")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gradewell.llm.simhash_join import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"))


# ------------------------------------------------------------ 11 conversation structure repair

OP11_SQL = f"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
                                        lambda c: ord(c)::BIGINT),
                         lambda h, b: list_reduce(range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(h, b)),
                         4294967295::BIGINT), 4294967295::BIGINT) % 20 AS f FROM conversations),
ids AS (SELECT conv_id, row_number() OVER () AS cid FROM (SELECT DISTINCT conv_id FROM conversations)),
dam AS (SELECT cid, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role,
               CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
               unnest(range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))
        FROM src JOIN ids ON src.conv_id IS NOT DISTINCT FROM ids.conv_id),
pos AS (SELECT *, left(role, 1) AS ini,
               row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM dam),
flt AS MATERIALIZED (
  SELECT *, lag(ini) OVER (PARTITION BY cid ORDER BY i) || ini NOT IN ('su', 'ua', 'au') AS bad,
         CASE WHEN NOT regexp_matches(text, '{WORD_SQL}') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY cid, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'ok' ELSE 'truncated' END AS fault FROM pos),
ins(s, t, n) AS (VALUES (0, 0, 0), (0, 2, 1), (0, 3, 2), (1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 2, 0), (2, 3, 1), (3, 3, 0), (3, 2, 1)),
due(s, t) AS (VALUES (0, 2), (1, 2), (2, 3), (3, 2)),
lawful(s, ini, t) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
extra(fault, c) AS (VALUES ('ok', 0), ('truncated', 3)),
rest(fault) AS (VALUES ('ok'), ('truncated'), ('blank'), ('duplicate')),
inis AS (SELECT DISTINCT ini FROM flt),
move AS (SELECT s, ini, fault, s AS t, 4 AS c, 'D' AS sign FROM due, inis, rest
         UNION ALL SELECT s, ini, fault, t, 3 + c, 'R' FROM due, inis, extra
         UNION ALL SELECT s, ini, fault, t, c, 'K' FROM lawful, extra),
step AS MATERIALIZED (SELECT ins.s, ini, fault, move.t, min({{'c': 3 * n + c, 'a': repeat('I', n) || sign}}) AS m
         FROM ins JOIN move ON ins.t = move.s GROUP BY ALL),
dp AS (SELECT cid, 0::BIGINT AS i, 0 AS s, {{'c': 0, 'a': ''}} AS b FROM ids
       UNION ALL
       SELECT dp.cid, flt.i, step.t, min({{'c': b.c + m.c, 'a': b.a || m.a}})
       FROM dp JOIN flt ON flt.cid = dp.cid AND flt.i = dp.i + 1
       JOIN step ON step.s = dp.s AND step.ini = flt.ini AND step.fault = flt.fault GROUP BY dp.cid, flt.i, step.t),
size AS (SELECT cid, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (bad) AS illegal FROM flt GROUP BY cid),
tail(s, c, a) AS (VALUES (0, 0, ''), (1, 6, 'II'), (2, 3, 'I'), (3, 0, '')),
won AS (SELECT dp.cid, min({{'c': b.c + tail.c, 'a': b.a || tail.a}}) AS b
        FROM dp JOIN tail USING (s) LEFT JOIN size USING (cid) WHERE dp.i = coalesce(n, 0) GROUP BY dp.cid),
sign AS (SELECT cid, sign, j, count(*) FILTER (sign <> 'I') OVER (PARTITION BY cid ORDER BY j) AS i
         FROM (SELECT cid, unnest(string_split(b.a, '')) AS sign, unnest(range(length(b.a))) AS j FROM won WHERE b.a <> '')),
line AS (SELECT s.cid, j, sign, role, text,
                count(*) FILTER (NOT (sign = 'K' AND ini = 's')) OVER (PARTITION BY s.cid ORDER BY j) AS k
         FROM sign s LEFT JOIN flt ON flt.cid = s.cid AND flt.i = s.i AND sign <> 'I' WHERE sign <> 'D'),
out AS (SELECT cid, string_agg(CASE WHEN sign = 'K' THEN role WHEN k % 2 = 1 THEN 'user' ELSE 'assistant' END
                               || ':' || coalesce(text, ''), chr(10) ORDER BY j) AS t FROM line GROUP BY cid)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, b.c::BIGINT AS cost, b.a AS audit,
       sha256(coalesce(t, '')) AS repaired_sha256
FROM ids JOIN won USING (cid) LEFT JOIN size USING (cid) LEFT JOIN out USING (cid)
"""


@query("op11_turn_repair", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gradewell.llm.turn_repair import damaged, repair
    rows, copies = damaged(table(spark, sf_dir, "conversations"))
    return repair(rows, copies=copies)
