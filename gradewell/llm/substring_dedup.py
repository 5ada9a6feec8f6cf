"""Removal of repeated passages: Rabin-Karp window hashes, counted in Spark.

Every window of ``window`` consecutive words gets a Rabin-Karp hash. A word is
removed when a window covering it also starts in a document of smaller id;
neighbouring windows merge into maximal removal intervals.

Blocks are ranges of ids of about equal bytes, so "a smaller document" is either
one of an earlier range, which the hash exchange answers with one flag per distinct
window, or one of the same block, which the block sees itself. An id that fills
several ranges alone, and the rows without an id, are cut into blocks by a hash of the text: no row
of such a range is smaller than another. Two different windows are
taken for one with probability 2^-64 a pair.

Nulls and ties: a null text has no words; null ids come after all others and
rows of equal id never remove each other's words. Short texts have no window
and are kept whole. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.llm import blocks as B

RESULT = "doc_id long, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept_text string"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _windows(texts, k: int):
    """(words, word index of each window, its hash)."""
    w = B.Words(texts)
    at = B.window_starts(w.first, k)
    return w, at, B.rolling(w.hashes(), k)[at] if len(at) else np.empty(0, B.U64)


class Ranges:
    """``first[r]`` is the first block of id range r; the last range is that of the rows without an id."""

    def __init__(self, cuts: list[int], null_blocks: int):
        held = Counter(cuts)
        wide = {c: m + 1 for c, m in held.items() if m > 1 and c < B.NULL_ID}       # an id that fills ranges alone
        self.bounds = np.array(sorted({*held, *(c + 1 for c in wide)}), np.int64)
        blocks = np.ones(len(self.bounds) + 2, np.int64)
        for c, m in wide.items():
            blocks[np.searchsorted(self.bounds, c, side="right")] = m
        blocks[-1] = null_blocks
        self.blocks, self.first = blocks, np.cumsum(blocks) - blocks

    def of_block(self, block) -> np.ndarray:
        return np.searchsorted(self.first, np.asarray(block, np.int64), side="right") - 1

    def block(self, ids: np.ndarray, null: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The block of each (id, has it none, hash of the text)."""
        r = np.where(null, len(self.blocks) - 1, np.searchsorted(self.bounds, ids, side="right"))
        return self.first[r] + hashes % self.blocks[r]


def _ranges(docs: DataFrame, id_col: str, text_col: str, blocks: int, usual: int) -> Ranges:
    """Cuts every id range at about the same bytes: an id counts once per ``usual`` bytes of its text, and once more."""
    if blocks == 1:
        return Ranges([], 1)
    times = (F.coalesce(F.octet_length(text_col), F.lit(0)) / usual).cast("int") + 1
    weighed = docs.select(F.explode(F.array_repeat(F.col(id_col).cast("long"), times)).alias("id"))
    s = weighed.agg(F.percentile_approx("id", [i / blocks for i in range(1, blocks)], max(10_000, 20 * blocks)).alias("cuts"),
                    F.count(F.lit(1)).alias("n"), F.count("id").alias("known")).first()
    return Ranges(s.cuts or [], max(1, -(-blocks * (s.n - s.known) // max(s.n, 1))))


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """One row per document: words, removed words, the maximal removal
    intervals (word positions, end exclusive) and the text that is left."""
    rows, n_bytes = B.size_of(docs, text_col)
    blocks, bits = B.n_blocks(n_bytes), B.bucket_bits(n_bytes // 6)
    ranges = _ranges(docs, id_col, text_col, blocks, n_bytes // max(rows, 1) + 1)

    @F.pandas_udf("int")
    def block_of(ids, null, hashes):
        import pandas as pd
        return pd.Series(ranges.block(ids.to_numpy(np.int64), null.to_numpy(bool), hashes.to_numpy(np.int64)))
    dealt = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dealt = dealt.withColumn("block", block_of(
        F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), F.xxhash64("text")))

    def send(key, table):
        _, _, h = _windows(table.column("text"), window)
        h = np.sort(h)
        h = h[B.runs(h)]
        out = [(b, B.pack(h[lo:hi])) for b, lo, hi in B.by_bucket(h, bits)]
        return pa.table({"bucket": pa.array([o[0] for o in out], pa.int32()),
                         "block": pa.array([key[0].as_py()] * len(out), pa.int32()),
                         "keys": pa.array([o[1] for o in out], pa.binary())})

    def seen_before(key, table):
        table = table.sort_by("block")
        keys, order, src, _ = B.merged(table.column("keys").to_pylist())
        here = ranges.of_block(table.column("block").to_numpy())[src[order]]
        new = B.runs(keys[order])
        flags = np.zeros(len(keys), bool)
        flags[order] = here > here[new][np.cumsum(new) - 1]
        cuts = np.flatnonzero(B.runs(src))
        out = [(b, B.squeeze(np.packbits(f))) for b, f in zip(table.column("block").to_pylist(), np.split(flags, cuts[1:]))
               if f.any()]
        return pa.table({"block": pa.array([o[0] for o in out], pa.int32()),
                         "bucket": pa.array([key[0].as_py()] * len(out), pa.int32()),
                         "flags": pa.array([o[1] for o in out], pa.binary())})

    def remove(key, table, flags):
        table = table.take(pc.sort_indices(table, [("doc_id", "ascending")], null_placement="at_end"))
        doc_ids = B.ids(table, "doc_id")
        w, at, h = _windows(table.column("text"), window)
        order = np.argsort(h, kind="stable")          # equal hashes stay in the order of the ids
        new = B.runs(h[order])
        uniq, run = h[order][new], np.cumsum(new) - 1
        seen = np.zeros(len(uniq), bool)
        place = {b: (lo, hi) for b, lo, hi in B.by_bucket(uniq, bits)}
        for b, f in zip(flags.column("bucket").to_pylist(), flags.column("flags").to_pylist()):
            lo, hi = place[b]
            seen[lo:hi] = np.unpackbits(B.unsqueeze(f, np.uint8), count=hi - lo).astype(bool)
        owner = doc_ids[w.doc_of_word()[at]] if len(at) else np.empty(0, np.int64)
        least = owner[order][new]
        hit = np.zeros(len(at), bool)
        hit[order] = seen[run] | (least[run] < owner[order])
        edge = np.zeros(len(w) + 1, np.int32)
        edge[at[hit]] += 1
        edge[at[hit] + window] -= 1
        gone = np.cumsum(edge[:-1]) > 0
        n_removed = np.add.reduceat(np.append(gone, False).astype(np.int64), w.first[:-1]) * (w.counts() > 0) \
            if w.n_docs else np.empty(0, np.int64)
        spans, texts = [], []
        for d in range(w.n_docs):
            words = w.text(d).split()
            if n_removed[d]:
                g = gone[w.first[d]:w.first[d + 1]]
                e = np.flatnonzero(np.diff(np.concatenate(([0], g.view(np.int8), [0]))))
                spans.append([{"start": int(a), "end": int(b)} for a, b in zip(e[::2], e[1::2])])
                words = compress(words, ~g)
            else:
                spans.append([])
            texts.append(b" ".join(words).decode())
        return pa.table({"doc_id": B.id_array(doc_ids), "n_words": pa.array(w.counts(), pa.int64()),
                         "n_removed": pa.array(n_removed, pa.int64()), "spans": pa.array(spans, _SPANS),
                         "kept_text": pa.array(texts, pa.string())})

    keys = dealt.groupBy("block").applyInArrow(send, "bucket int, block int, keys binary")
    flags = keys.groupBy("bucket").applyInArrow(seen_before, "block int, bucket int, flags binary")
    return dealt.groupBy("block").cogroup(flags.groupBy("block")).applyInArrow(remove, RESULT)
