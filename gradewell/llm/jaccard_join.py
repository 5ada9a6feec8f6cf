"""Exact Jaccard self-join of word-shingle sets by vertical partitioning.

The shingles are put in one global order, rare before frequent, and the order is
cut into fragments of like volume. A document's set falls into one segment per
fragment; each fragment counts the overlap of the segments of a pair on its own,
and the partial overlaps are summed per pair and compared with the threshold.

What keeps the work in proportion to the input, without losing a link:

* documents of equal sets form a class and take part once;
* a shingle held by one class alone cannot be shared. Counting the classes of
  every shingle through the packed hash exchange, a class whose shared shingles
  are below the threshold's share of its set has no partner and leaves;
* of a class that stays, the prefix of the global order (the rarest shingles,
  as many as may be missing from a partner, plus one) must meet the prefix of
  every partner;
* round one pairs each class of a prefix shingle with the shingle's leader (the
  class with the fewest unshared shingles), so a big group of near copies
  becomes one component by pairs in proportion to its size. Round two pairs
  classes of different components only, whatever their number.

Links join into components by repeated minima over neighbours and pointer
jumping, cut off by checkpoints. Two different shingles or sets are taken for
one with probability 2^-64 a pair.

Nulls and ties: a null, empty or blank text has an empty set, links with nothing
and is its own component; so does a row of null id (component null). Texts of
fewer than ``k`` words have their whole word sequence as one shingle. Repeated
rows are copies of each other. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.llm import blocks as B

ROW = ("doc_id", "text_a", "text_b")     # what a row is known by: its id and two hashes of its text
FRAGMENT_KEYS = 1 << 18    # shingles of a fragment
SALT_CLASSES = 20_000      # classes for each salt of a fragment


def shingle_sets(texts, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    w = B.Words(texts, lower=True)
    h = w.hashes()
    rolled = B.rolling(h, k)
    out = []
    for d in range(w.n_docs):
        a, b = int(w.first[d]), int(w.first[d + 1])
        if b - a >= k:
            s = np.sort(rolled[a:b - k + 1])
            out.append(s[B.runs(s)])
        else:
            out.append(B.rolling(h[a:b], b - a) if b > a else np.empty(0, B.U64))
    return out


def _class_of(s: np.ndarray) -> int:
    """A hash of a set: the mixed sum of its members' hashes and its size."""
    return int(B.mix(np.array([B.mix(s + B.U64(0x9E37)).sum(dtype=B.U64) + B.U64(len(s))], B.U64)).view(np.int64)[0])


def _needed(n: int, share: int) -> int:
    """Least overlap a set of ``n`` needs with a partner."""
    return -(-share * n // 100)


def _mark(k: int):
    def mark(batches):
        for t in batches:
            for lo in range(0, t.num_rows, 512):
                part = t.slice(lo, 512)
                sets = shingle_sets(part.column("text"), k)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ROW), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([_class_of(s) for s in sets], pa.int64())], names=[*ROW, "n", "class"])
    return mark


def _representatives(table, reps, k: int) -> dict[int, np.ndarray]:
    """class -> set, for the classes whose smallest id is in this block."""
    wanted = {}
    for i, c in zip(reps.column("rep").to_pylist(), reps.column("class").to_pylist()):
        if i is not None:
            wanted.setdefault(i, set()).add(c)
    ids = B.ids(table, "doc_id")
    rows = [j for j, i in enumerate(ids.tolist()) if i in wanted]
    sets, found = shingle_sets(table.column("text").take(pa.array(rows, pa.int64())), k), {}
    for j, s in zip(rows, sets):
        c = _class_of(s) if len(s) else None
        if c in wanted[int(ids[j])]:
            found.setdefault(c, s)
    return found


def _block_keys(found: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of the block's classes and in how many of them each is."""
    keys = np.sort(np.concatenate([*found.values(), np.empty(0, B.U64)]))
    new = np.flatnonzero(B.runs(keys))
    return keys[new], np.diff(np.append(new, len(keys)))


def _send(k: int, bits: int):
    def send(key, table, reps):
        keys, n = _block_keys(_representatives(table, reps, k))
        out = [(b, B.pack(keys[lo:hi], n[lo:hi])) for b, lo, hi in B.by_bucket(keys, bits)]
        return pa.table({"bucket": pa.array([o[0] for o in out], pa.int32()),
                         "block": pa.array([key[0].as_py()] * len(out), pa.int32()),
                         "keys": pa.array([o[1] for o in out], pa.binary())})
    return send


def _spread(key, table):
    """For every shingle of every block: 0 if one class holds it, else 1 + log2 of their number."""
    keys, order, src, n = B.merged(table.column("keys").to_pylist(), extra=True)
    new = B.runs(keys[order])
    total = np.add.reduceat(n[order].astype(np.int64), np.flatnonzero(new))
    level = np.where(total > 1, np.floor(np.log2(total)) + 1, 0).astype(np.uint8)
    levels = np.empty(len(keys), np.uint8)
    levels[order] = level[np.cumsum(new) - 1]
    out = [(b, B.squeeze(v)) for b, v in zip(table.column("block").to_pylist(),
                                            np.split(levels, np.flatnonzero(B.runs(src))[1:])) if v.any()]
    return pa.table({"block": pa.array([o[0] for o in out], pa.int32()),
                     "bucket": pa.array([key[0].as_py()] * len(out), pa.int32()),
                     "levels": pa.array([o[1] for o in out], pa.binary())})


def _stay(k: int, bits: int, share: int):
    def stay(key, table, notes):
        """The classes that may have a partner, their shared shingles in global order (level, hash)."""
        found = _representatives(table, notes, k)
        keys, _ = _block_keys(found)
        level = np.zeros(len(keys), np.uint8)
        place = {b: (lo, hi) for b, lo, hi in B.by_bucket(keys, bits)}
        for b, v in zip(notes.column("bucket").to_pylist(), notes.column("levels").to_pylist()):
            if b is not None:
                lo, hi = place[b]
                level[lo:hi] = B.unsqueeze(v, np.uint8)
        rows = []
        for c, s in found.items():
            lv = level[np.searchsorted(keys, s)]
            m = lv > 0
            if m.sum() >= _needed(len(s), share):
                s, lv = s[m], lv[m]
                order = np.argsort(lv, kind="stable")
                rows.append((c, len(m), len(s), s[order].tobytes(), lv[order].tobytes()))
        cols = list(zip(*rows)) if rows else [()] * 5
        return pa.table({"class": pa.array(cols[0], pa.int64()), "n": pa.array(cols[1], pa.int64()),
                         "shared": pa.array(cols[2], pa.int64()), "keys": pa.array(cols[3], pa.binary()),
                         "levels": pa.array(cols[4], pa.binary())})
    return stay


def _prefixes(share: int):
    def prefixes(batches):
        """(key, class, n, position in the whole global order, unshared shingles) of every prefix shingle."""
        for t in batches:
            cols = [[], [], [], [], []]
            for c, n, m, keys in zip(*(t.column(x).to_pylist() for x in ("class", "n", "shared", "keys"))):
                p = m - _needed(n, share) + 1
                cols[0].append(np.frombuffer(keys, np.int64, p))
                cols[1].append(np.full(p, c))
                cols[2].append(np.full(p, n))
                cols[3].append(np.arange(n - m, n - m + p))
                cols[4].append(np.full(p, n - m))
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in cols],
                                                 names=["key", "class", "n", "at", "alone"])
    return prefixes


def _histogram(batches):
    """Shingles by level and first six bits of the hash."""
    total = np.zeros(64 * 64, np.int64)
    for t in batches:
        for keys, lv in zip(t.column("keys").to_pylist(), t.column("levels").to_pylist()):
            cell = np.frombuffer(lv, np.uint8).astype(np.int64) * 64 + (np.frombuffer(keys, B.U64) >> B.U64(58)).astype(np.int64)
            total += np.bincount(cell, minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])


def _cuts(stay: DataFrame) -> np.ndarray:
    """The cells (level, hash range; 4,096 at most) at which a new fragment begins."""
    rows = stay.select("keys", "levels").mapInArrow(_histogram, "cell long, n long").groupBy("cell").agg(
        F.sum("n").alias("n")).collect()
    cells = sorted((r.cell, r.n) for r in rows)
    cuts, held = [0], 0
    for cell, n in cells:
        if held and held + n > FRAGMENT_KEYS:
            cuts.append(cell)
            held = 0
        held += n
    return np.array(cuts, np.int64)


def _segments(cuts: np.ndarray, salts: int):
    def segments(batches):
        """A class's segments, sent where it is counted: as the first of a pair
        to its own salt, as the second to the salts of its partners."""
        for t in batches:
            out = {"cell": [], "class": [], "n": [], "keys": [], "partners": []}
            for c, n, keys, lv, partners, to in zip(*(t.column(x).to_pylist() for x in (
                    "class", "n", "keys", "levels", "partners", "salts"))):
                k, lv = np.frombuffer(keys, B.U64), np.frombuffer(lv, np.uint8)
                frag = np.searchsorted(cuts, lv.astype(np.int64) * 64 + (k >> B.U64(58)).astype(np.int64), "right") - 1
                own = c % salts
                for f in np.unique(frag):
                    seg = np.sort(k[frag == f]).tobytes()
                    for s in {*(to or []), *([own] if partners else [])}:
                        out["cell"].append(int(f) * salts + s)
                        out["class"].append(c)
                        out["n"].append(n)
                        out["keys"].append(seg)
                        out["partners"].append(partners if s == own else None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["cell"], pa.int32()), pa.array(out["class"], pa.int64()), pa.array(out["n"], pa.int64()),
                 pa.array(out["keys"], pa.binary()), pa.array(out["partners"], pa.list_(pa.int64()))], names=list(out))
    return segments


def _overlaps(key, table):
    """Partial overlaps of the pairs of one fragment (and salt)."""
    cls, n = table.column("class").to_pylist(), table.column("n").to_pylist()
    keys = [np.frombuffer(b, B.U64) for b in table.column("keys").to_pylist()]
    row = {c: j for j, c in enumerate(cls)}
    firsts: dict[int, list[int]] = {}
    for j, partners in enumerate(table.column("partners").to_pylist()):
        for y in partners or ():
            if y in row:
                firsts.setdefault(row[y], []).append(j)
    out = [[], [], [], [], []]
    for y, xs in firsts.items():
        of_y, cat = keys[y], np.concatenate([keys[x] for x in xs])
        at = np.minimum(np.searchsorted(of_y, cat), len(of_y) - 1)
        hits = np.add.reduceat((of_y[at] == cat).astype(np.int64),
                               np.concatenate(([0], np.cumsum([len(keys[x]) for x in xs])[:-1])))
        for x, c in zip(xs, hits.tolist()):
            if c:
                for col, v in zip(out, (cls[x], cls[y], n[x], n[y], c)):
                    col.append(v)
    return pa.table({m: pa.array(v, pa.int64()) for m, v in zip(("x", "y", "nx", "ny", "c"), out)})


def linked(pairs: DataFrame, stay: DataFrame, cuts: np.ndarray, salts: int, share: int) -> DataFrame:
    """Those of the candidate (x, y) whose sets reach the threshold."""
    salt = F.pmod(F.col("x"), F.lit(salts)).cast("int")
    firsts = pairs.groupBy("x").agg(F.collect_list("y").alias("partners"))
    seconds = pairs.groupBy("y").agg(F.collect_set(salt).alias("salts"))
    rows = stay.join(firsts, stay["class"] == firsts["x"], "left").join(seconds, stay["class"] == seconds["y"], "left")
    rows = rows.filter("partners is not null or salts is not null").select(
        "class", "n", "keys", "levels", "partners", "salts")
    segs = rows.mapInArrow(_segments(cuts, salts), "cell int, class long, n long, keys binary, partners array<long>")
    parts = segs.groupBy("cell").applyInArrow(_overlaps, "x long, y long, nx long, ny long, c long")
    total = parts.groupBy("x", "y", "nx", "ny").agg(F.sum("c").alias("c"))
    return total.filter(100 * F.col("c") >= share * (F.col("nx") + F.col("ny") - F.col("c"))).select("x", "y")


def components(links: DataFrame) -> DataFrame:
    """(class, label) for every linked class: the least class reachable."""
    both = B.checkpointed(links.union(links.select("y", "x")).distinct())
    label = both.select(F.col("x").alias("class")).distinct().withColumn("label", F.col("class"))
    while True:
        near = both.join(label.withColumnRenamed("class", "y"), "y").groupBy("x").agg(F.min("label").alias("m"))
        step = label.join(near, label["class"] == near["x"]).select(
            "class", F.col("label").alias("old"), F.least("label", "m").alias("via"))
        jump = label.select(F.col("class").alias("via"), F.col("label").alias("far"))
        step = B.checkpointed(step.join(jump, "via").select("class", "old", F.least("via", "far").alias("label")))
        label = step.select("class", "label")
        if step.filter("label <> old").isEmpty():
            return label


def text_hashes(text) -> list:
    """Two hashes of a text, of different seeds."""
    return [F.xxhash64(text), F.xxhash64(F.lit(1), text)]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5,
                    share: int = 80) -> DataFrame:
    """One row per document: (doc_id, n_shingles, component_id), linking sets
    whose Jaccard similarity is at least ``share`` percent."""
    return judged(docs, id_col, text_col, k, share).select("doc_id", "n_shingles", "component_id")


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, share: int = 80) -> DataFrame:
    """What ``near_duplicates`` gives, with the hashes of the row's text, its
    class, and whether the row is of the class and id its component is named after."""
    rows, n_bytes = B.size_of(docs, text_col)
    blocks, bits = B.n_blocks(n_bytes), B.bucket_bits(n_bytes // 6)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = d.select("doc_id", *(h.alias(c) for h, c in zip(text_hashes(F.col("text")), ROW[1:])), "text")
    marks = B.checkpointed(known.mapInArrow(_mark(k), "doc_id long, text_a long, text_b long, n long, class long"))
    # rows without an id represent no class: they need no block
    dealt = d.filter("doc_id is not null").withColumn("block", B.block_by_hash(F.col("doc_id"), blocks))
    reps = marks.filter("n > 0 and doc_id is not null").groupBy("class").agg(F.min("doc_id").alias("rep"))
    here = reps.withColumn("block", B.block_by_hash(F.col("rep"), blocks))
    counts = dealt.groupBy("block").cogroup(here.groupBy("block")).applyInArrow(
        _send(k, bits), "bucket int, block int, keys binary")
    levels = counts.groupBy("bucket").applyInArrow(_spread, "block int, bucket int, levels binary")
    notes = here.unionByName(levels, allowMissingColumns=True)
    stay = B.checkpointed(dealt.groupBy("block").cogroup(notes.groupBy("block")).applyInArrow(
        _stay(k, bits, share), "class long, n long, shared long, keys binary, levels binary"))

    cuts = _cuts(stay)
    salts = stay.count() // SALT_CLASSES + 1
    post = B.checkpointed(stay.select("class", "n", "shared", "keys").mapInArrow(
        _prefixes(share), "key long, class long, n long, at long, alone long"))
    near = (share * F.greatest("nx", "ny") <= 100 * F.least("nx", "ny")) & (
        (100 + share) * (1 + F.least(F.col("nx") - 1 - F.col("ax"), F.col("ny") - 1 - F.col("ay")))
        >= share * (F.col("nx") + F.col("ny")))
    # round one: every class with the leader of each of its prefix shingles
    lead = post.groupBy("key").agg(F.min(F.struct("alone", "class", "n", "at")).alias("l"),
                                   F.count(F.lit(1)).alias("m")).filter("m > 1").select(
        "key", F.col("l.class").alias("y"), F.col("l.n").alias("ny"), F.col("l.at").alias("ay"))
    one = post.select("key", F.col("class").alias("x"), F.col("n").alias("nx"), F.col("at").alias("ax"))
    pairs = one.join(lead, "key").filter((F.col("x") != F.col("y")) & near).select("x", "y").distinct()
    links = B.checkpointed(linked(pairs, stay, cuts, salts, share))
    label = components(links)
    # round two: classes of different components that meet in a prefix shingle
    post = post.join(label, "class", "left").withColumn("label", F.coalesce("label", "class"))
    open_keys = post.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a <> b").select("key")
    post = B.checkpointed(post.join(open_keys, "key", "left_semi"))
    one = post.select("key", F.col("class").alias("x"), F.col("n").alias("nx"), F.col("at").alias("ax"), F.col("label").alias("lx"))
    two = post.select("key", F.col("class").alias("y"), F.col("n").alias("ny"), F.col("at").alias("ay"), F.col("label").alias("ly"))
    pairs = one.join(two, "key").filter((F.col("lx") < F.col("ly")) & near).select("x", "y").distinct()
    more = B.checkpointed(linked(pairs, stay, cuts, salts, share))
    if not more.isEmpty():
        label = components(links.union(more))

    least = reps.join(label, "class", "left").withColumn("label", F.coalesce("label", "class"))
    root = least.groupBy("label").agg(F.min(F.struct("rep", "class")).alias("first"))
    root = least.join(root, "label").select(
        "class", F.col("first.rep").alias("component_id"), (F.col("first.class") == F.col("class")).alias("first"))
    filled = F.col("n") > 0
    return marks.join(root, "class", "left").select(
        *ROW, "class", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.when(filled, F.col("component_id")).otherwise(F.col("doc_id"))).alias("component_id"),
        F.when(filled, F.col("first") & (F.col("doc_id") == F.col("component_id"))).otherwise(True).alias("leads"))
