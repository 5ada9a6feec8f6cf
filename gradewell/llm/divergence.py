"""Source divergence audit: how far the word use of each source of a language is
from the other sources (part ``pair``), and which terms set it apart from its
language (part ``term``).

Each task counts the terms of its documents by (lang, source); one exchange by
(lang, term) adds them up. The kept terms are dealt in parts of about
``PART_TERMS`` by (lang, hash of the term), so a language that holds most terms is
many groups. A part knows the sizes of its language's sources and gives

* for every pair of sources, the sum of the terms' differences: its share of ``pair``;
* for every source the *skyband* of its terms: those with fewer than ``k`` others of
  higher or equal count in the source, lower or equal count in the language and
  earlier or equal place in UTF-8 order. A dominating term ranks before, whatever
  the sizes and however differences are rounded, so the first ``k`` are all in it.

Skybands of parts are merged into skybands, first of some parts, then of the source; what
is left is ranked exactly. All arithmetic is in integers; shares are divided in
three steps of a thousand, exact for counts below 2^53.

Nulls and ties: null text, lang and source count as ''. Every row is a document
of its own, repeated rows too. A lang without kept terms has pairs of value 0 and
no terms. Equal values rank by UTF-8 order. An empty table gives no rows. Other
columns are ignored. The result has a row per pair of sources of a lang; a task holds
the sums of ``TILE`` sources with all others of their lang.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradewell.llm import blocks as B

SCALE_STEPS = 3              # shares are in units of 1000^-3
PART_TERMS = 20_000          # kept terms of a group
TILE = 256                   # sources whose sums a group makes
HELD = 400_000               # (source, term) counts a task holds before it hands them on
CHUNK = 1 << 20              # cells of a dense block of terms and sources
MERGE = 64                   # parts whose skybands meet first

_TERM = re.compile(rb"[a-z\x80-\xff]+")      # ASCII letters (lower-cased) and all beyond ASCII, as UTF-8 bytes
_LOWER = bytes(B._LOWER)


def _counts(batches):
    """(lang, source, term, occurrences, documents) of what a task has read."""
    held: dict[tuple, dict[bytes, list[int]]] = {}
    size = 0

    def out():
        for (lang, source), terms in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()),
                 pa.array(list(terms), pa.binary()).cast(pa.string()),
                 pa.array([v[0] for v in terms.values()], pa.int64()), pa.array([v[1] for v in terms.values()], pa.int64())],
                names=["lang", "source", "term", "n", "docs"])
    for t in batches:
        for lang, source, text in zip(t.column("lang").to_pylist(), t.column("source").to_pylist(),
                                      t.column("text").cast(pa.large_binary())):
            terms = held.setdefault((lang, source), {})
            before = len(terms)
            for term, n in Counter(_TERM.findall(text.as_py().translate(_LOWER))).items():
                v = terms.get(term)
                if v is None:
                    terms[term] = [n, 1]
                else:
                    v[0] += n
                    v[1] += 1
            size += len(terms) - before
            if size >= HELD:
                yield from out()
                held.clear()
                size = 0
    yield from out()


def share(count, size) -> np.ndarray:
    """1 + floor(10^9 * count / size), by long division."""
    count = np.asarray(count, np.int64)
    value, rest = count // size, count % size
    for _ in range(SCALE_STEPS):
        rest = rest * 1000
        value = value * 1000 + rest // size
        rest = rest % size
    return value + 1


def difference(p, q):
    return (p - q) * (p - q) // (p + q)


def skyband(count, total, place, k: int) -> np.ndarray:
    """Indexes of the terms dominated by fewer than ``k`` others. Only terms that
    sort before (count falling, total rising, place rising) can dominate, and those
    with ``k`` dominators have ``k`` within the skyband."""
    order = np.lexsort((place, total, -count))
    kept: list[int] = []
    n, o = np.empty(0, np.int64), np.empty(0, np.int64)
    for lo in range(0, len(order), 256):
        part = order[lo:lo + 256]
        above = ((n <= total[part, None]) & (o <= place[part, None])).sum(axis=1)
        fresh: list[int] = []
        for i, a in zip(part[above < k].tolist(), above[above < k].tolist()):
            if fresh:
                f = np.array(fresh)
                a += int(((total[f] <= total[i]) & (place[f] <= place[i])).sum())
            if a < k:
                fresh.append(i)
        kept += fresh
        n, o = np.append(n, total[fresh]), np.append(o, place[fresh])
    return np.array(kept, np.int64)


OUT = "lang string, source string, part string, item string, value long, n long, total long, block int"


def _table(rows: list[tuple]) -> pa.Table:
    names = ["lang", "source", "part", "item", "value", "n", "total", "block"]
    kinds = [pa.string()] * 4 + [pa.int64()] * 3 + [pa.int32()]
    cols = list(zip(*rows)) if rows else [()] * len(names)
    return pa.table({m: pa.array(c, kind) for m, c, kind in zip(names, cols, kinds)})


def _audit(k: int, width: int = TILE):
    def audit(key, terms, langs):
        """Sums of pairs and skybands of the terms of one part of a lang, for one tile of its sources."""
        lang, block, tile = (x.as_py() for x in key)
        if not langs.num_rows:
            return _table([])
        names = [s["source"] for s in langs.column("sources")[0].as_py()]
        sizes = np.array([s["n"] for s in langs.column("sources")[0].as_py()], np.int64)
        v, all_n = langs.column("v")[0].as_py(), langs.column("total")[0].as_py()
        mine = range(tile * width, min((tile + 1) * width, len(names)))
        sums = np.zeros((len(mine), len(names)), np.int64)
        rows = []
        if terms.num_rows:
            terms = terms.combine_chunks().sort_by("term")               # by UTF-8: places are row numbers
            words, total = terms.column("term").to_pylist(), terms.column("n").to_numpy()
            counts = terms.column("counts").combine_chunks() if terms.column("counts").num_chunks != 1 else terms.column("counts").chunk(0)
            row = np.repeat(np.arange(len(words)), pc.list_value_length(counts).to_numpy())
            flat = counts.flatten()
            of = pc.index_in(flat.field("source"), value_set=pa.array(names, pa.string())).to_numpy()
            n = flat.field("n").to_numpy()
            q = share(total + 2, all_n + 2 * v)
            step = max(1, CHUNK // len(names))
            for lo in range(0, len(words), step):
                a, b = np.searchsorted(row, (lo, lo + step))
                dense = np.zeros((min(step, len(words) - lo), len(names)), np.int64)
                dense[row[a:b] - lo, of[a:b]] = n[a:b]
                p = share(dense + 2, sizes + 2 * v)
                for j, i in enumerate(mine):
                    sums[j, i + 1:] += difference(p[:, i + 1:], p[:, i:i + 1]).sum(axis=0)
            order = np.argsort(of, kind="stable")
            cuts = np.searchsorted(of[order], np.arange(len(names) + 1))
            for i in mine:
                at = order[cuts[i]:cuts[i + 1]]
                p = share(n[at] + 2, sizes[i] + 2 * v)
                at, p = at[p > q[row[at]]], p[p > q[row[at]]]
                for m in skyband(n[at], total[row[at]], row[at], k):
                    r = row[at[m]]
                    rows.append((lang, names[i], "term", words[r], int(difference(p[m], q[r])), int(n[at[m]]), int(total[r]), block))
        for j, i in enumerate(mine):
            rows += [(lang, names[i], "pair", names[x], int(sums[j, x]), None, None, block) for x in range(i + 1, len(names))]
        return _table(rows)
    return audit


def _merge(k: int):
    def merge(t):
        """The skyband of several skybands of a source."""
        t = t.combine_chunks().sort_by("item")
        keep = skyband(t.column("n").to_numpy(), t.column("total").to_numpy(), np.arange(t.num_rows), k)
        return t.take(pa.array(np.sort(keep), pa.int64()))
    return merge


def term_counts(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """(lang, term, n, counts) of the terms in at least ``min_docs`` documents of their lang."""
    raw = docs.select("lang", "source", "text").mapInArrow(_counts, "lang string, source string, term string, n long, docs long")
    by_source = raw.repartition("lang", "term").groupBy("lang", "term", "source").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return by_source.groupBy("lang", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("counts")).filter(
        F.col("docs") >= min_docs).drop("docs")


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
          min_docs: int = 10, k: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): the distance to each other source
    of the lang, and the ``k`` terms that set the source apart."""
    spark = docs.sparkSession
    d = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
                      for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    path = B.shared_folder(docs, "divergence")
    term_counts(d, min_docs).write.parquet(f"{path}/terms")
    terms = spark.read.parquet(f"{path}/terms")

    sizes = terms.select("lang", F.explode("counts").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(
        F.sum("c.n").alias("n"))
    of_lang = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("total"))
    groups = d.select("lang", "source").distinct()
    langs = groups.join(sizes, ["lang", "source"], "left").groupBy("lang").agg(F.sort_array(F.collect_list(
        F.struct("source", F.coalesce("n", F.lit(0).cast("long")).alias("n")))).alias("sources")).join(of_lang, "lang", "left")
    langs.select("lang", "sources", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("total", F.lit(0)).alias("total")).write.parquet(
        f"{path}/langs")
    langs = spark.read.parquet(f"{path}/langs")
    most = langs.agg(F.max("v").alias("v"), F.max(F.size("sources")).alias("s")).first()
    parts, tiles = (most.v or 0) // PART_TERMS + 1, ((most.s or 1) - 1) // TILE + 1

    part = F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int").alias("block")
    tile = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile")
    dealt = terms.select("*", part).select("*", tile)
    where = spark.read.parquet(f"{path}/terms").select("lang", part).union(langs.select("lang", F.lit(0).alias("block"))).distinct().select("*", tile)
    known = where.join(langs, "lang")
    key = ["lang", "block", "tile"]
    dealt.groupBy(*key).cogroup(known.groupBy(*key)).applyInArrow(_audit(k), OUT).write.parquet(f"{path}/found")
    found = spark.read.parquet(f"{path}/found")

    pairs = found.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.union(pairs.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    best = found.filter("part = 'term'")
    for by in (["lang", "source", F.floor(F.col("block") / MERGE)], ["lang", "source"]):
        best = best.groupBy(*by).applyInArrow(_merge(k), OUT)
    both = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").union(
        best.select("lang", "source", "part", "item", "value"))
    ranked = both.withColumn("rank", F.row_number().over(
        Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    return ranked.filter((F.col("part") == "pair") | (F.col("rank") <= k))
