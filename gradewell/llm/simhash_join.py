"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint has a bit set where more than half of the text's shingle hashes
(repeats included) have it. It is embedded as the counts of ones in ``SEGMENTS``
segments of its bits. The Manhattan distance of two embeddings never exceeds the
Hamming distance of the fingerprints, so near fingerprints are found by a range
join of points in a grid, and what passes is verified on the bits:

* the count of a two-bit segment is written in unary (00, 01, 11): the Manhattan
  distance is then the number of differing bits of two such codes;
* the segments are cut into ``g`` groups. Two points within distance ``d`` have equal
  counts in at least ``g - d`` groups, so a point lies in one grid cell for
  every choice of ``g - d`` groups: the cell of its counts there. ``g`` grows with
  the number of fingerprints; every ``g`` finds every pair;
* a cell holds distinct fingerprints only, and is read as a sorted run, many
  cells to a task. It hands on one link per fingerprint, to the least of its near
  ones' group in the cell, never all pairs;
* a cell of more than ``CELL`` points is no task's work as a whole: its points
  are compared with the cell's least point by an aggregate and a join, and those that
  are not all linked by then are dealt again by the counts they have not been dealt by,
  cut in ``d + 1`` pieces of which a near pair shares one.

Links join into components by repeated minima and pointer jumping.

Nulls and ties: a null, empty or blank text has the fingerprint zero, which links
as any other. Fewer words than ``k`` make one shingle. Equal texts have equal
fingerprints and take part once; repeated rows are kept as rows. A row of null id has a
fingerprint like any other and gets its component's smallest id (null if none of
the component has one). An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.llm import blocks as B
from gradewell.llm.jaccard_join import components

SEGMENTS = 32
CELL = 1 << 16               # points of a cell that one task compares
RUN = 48                     # points of a cell up to which all cells are compared at once
SEED = 42
_LOWER = bytes(B._LOWER)
_ODD = B.U64(0x5555555555555555)


def fingerprint(text: bytes | None, k: int = 4) -> int:
    """The fingerprint of a text in UTF-8."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return 0
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(k, len(words))
    joined, total, n = b" ".join(words), np.zeros(64, np.int64), len(words) - k + 1
    digest = xxhash.xxh64_digest
    for lo in range(0, n, 1 << 16):                     # a long text's hashes are counted in pieces
        hi = min(n, lo + (1 << 16))
        h = b"".join([digest(joined[a:b], SEED) for a, b in zip(
            starts[lo:hi].tolist(), ends[lo + k - 1:hi + k - 1].tolist())])
        total += np.unpackbits(np.frombuffer(h, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def _fingerprints(k: int):
    def of(batches):
        for t in batches:
            fp = [fingerprint(x.as_py(), k) for x in t.column("text").cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays(
                [t.column("doc_id"), pa.array(np.array(fp, np.uint64).view(np.int64), pa.int64())], names=["doc_id", "class"])
    return of


def embed(fp: np.ndarray) -> np.ndarray:
    """The counts of ones of the two-bit segments in unary."""
    return ((fp | (fp >> B.U64(1))) & _ODD) | (((fp & (fp >> B.U64(1))) & _ODD) << B.U64(1))


def piece_masks(mask: int, n: int) -> list[int]:
    """The segments of ``mask`` cut into ``n`` pieces of like size."""
    segments = [s for s in range(SEGMENTS) if mask >> (2 * s) & 1]
    return [sum(3 << (2 * s) for s in segments[len(segments) * j // n:len(segments) * (j + 1) // n]) for j in range(n)]


def grid(n: int, distance: int) -> list[int]:
    """The masks of the counts that name the cells, for so many fingerprints."""
    g = distance + 2 + (n > 1 << 21) + (n > 1 << 25)
    groups = piece_masks((1 << 64) - 1, g)
    return [sum(c) for c in combinations(groups, g - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _cells(masks: list[int]):
    """Each point's cells: (mask of the counts dealt by, mixed hash of these, fingerprint)."""
    def cells(batches):
        for t in batches:
            fp = t.column("class").to_numpy().view(np.uint64)
            e = embed(fp)
            for m in masks:
                key = B.mix((e & B.U64(m)) ^ B.mix(np.full(len(e), m, B.U64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(e), _signed(m)), pa.int64()), pa.array(key.view(np.int64)),
                     t.column("class")], names=["mask", "cell", "class"])
    return cells


def _again(distance: int):
    """The points of a crowded cell, dealt by the counts not used yet."""
    def again(batches):
        for t in batches:
            fp = t.column("class").to_numpy().view(np.uint64)
            used, old = t.column("mask").to_numpy().view(np.uint64), t.column("cell").to_numpy().view(np.uint64)
            e = embed(fp)
            for u in np.unique(used):
                at = used == u
                for piece in piece_masks(~int(u) & ((1 << 64) - 1), distance + 1):
                    m = int(u) | piece
                    key = B.mix((e[at] & B.U64(piece)) ^ B.mix(old[at] ^ B.mix(np.full(int(at.sum()), m, B.U64))))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(key), _signed(m)), pa.int64()), pa.array(key.view(np.int64)),
                         pa.array(fp[at].view(np.int64))], names=["mask", "cell", "class"])
    return again


def near(x: np.ndarray, ex: np.ndarray, y, ey, distance: int) -> np.ndarray:
    """Whether points are near: the bound of the embedding, then the bits of what it lets pass."""
    ok = np.bitwise_count(ex ^ ey) <= distance
    if ok.any():
        y = np.broadcast_to(y, ok.shape)
        ok[ok] = np.bitwise_count(x[ok] ^ y[ok]) <= distance
    return ok


def _spread(fp: np.ndarray, e: np.ndarray, distance: int):
    """Links of one large cell: a search from each point not yet reached, over the points not yet reached."""
    left = np.arange(len(fp))
    while len(left):
        root, front, left = left[0], [left[0]], left[1:]
        while front and len(left):
            i = front.pop()
            hit = near(fp[left], e[left], fp[i], e[i], distance)
            if hit.any():
                front += left[hit].tolist()
                yield np.full(int(hit.sum()), fp[root]), fp[left[hit]]
                left = left[~hit]


def _runs(cell: np.ndarray, fp: np.ndarray, distance: int):
    """Links of whole cells, given in the order of cells."""
    e = embed(fp)
    cuts = np.flatnonzero(B.runs(cell))
    size = np.diff(np.append(cuts, len(cell)))
    for a, n in zip(cuts[size > RUN], size[size > RUN]):
        yield from _spread(fp[a:a + n], e[a:a + n], distance)
    small = np.repeat((size > 1) & (size <= RUN), size)
    fp, e, cell = fp[small], e[small], cell[small]
    for step in range(1, RUN):
        same = np.flatnonzero(cell[step:] == cell[:-step])
        if not len(same):
            break
        hit = same[near(fp[same], e[same], fp[same + step], e[same + step], distance)]
        if len(hit):
            yield fp[hit], fp[hit + step]


def _links(distance: int):
    def links(batches):
        """Sorted rows in, links out; the last cell of a batch waits for the next batch."""
        cell, fp = np.empty(0, np.int64), np.empty(0, B.U64)
        for t in batches:
            cell = np.concatenate((cell, t.column("cell").to_numpy()))
            fp = np.concatenate((fp, t.column("class").to_numpy().view(np.uint64)))
            if not len(cell):
                continue
            done = int(np.searchsorted(cell, cell[-1]))
            for x, y in _runs(cell[:done], fp[:done], distance):
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["x", "y"])
            cell, fp = cell[done:], fp[done:]
        for x, y in _runs(cell, fp, distance):
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["x", "y"])
    return links


def _compared(cells: DataFrame, distance: int) -> DataFrame:
    return cells.select("cell", "class").repartition("cell").sortWithinPartitions("cell", "class").mapInArrow(
        _links(distance), "x long, y long").distinct()


def near_pairs(points: DataFrame, distance: int = 4) -> DataFrame:
    """Links (x, y) of the distinct fingerprints in ``points.class`` that join the
    same ones as all pairs within ``distance`` would."""
    schema = "mask long, cell long, class long"
    cells = points.mapInArrow(_cells(grid(points.count(), distance)), schema)      # cheaper made twice than stored
    links = None
    while True:
        held = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("y"), F.min("mask").alias("m"))
        crowded = B.checkpointed(held.filter((F.col("n") > CELL) & (F.col("m") != -1)))
        if crowded.isEmpty():
            found = _compared(cells, distance)
            return found if links is None else links.union(found).distinct()
        hot = cells.join(crowded.select("cell", "y"), "cell")
        found = _compared(cells.join(crowded.select("cell"), "cell", "left_anti"), distance).union(
            hot.filter(F.bit_count(F.col("class").bitwiseXOR(F.col("y"))) <= distance).filter("class <> y").select(
                F.col("y").alias("x"), F.col("class").alias("y")).distinct())
        links = B.checkpointed(found if links is None else links.union(found))
        label = components(links)
        hot = hot.join(label, "class", "left").withColumn("label", F.coalesce("label", "class"))
        mixed = hot.groupBy("cell").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a <> b").select("cell")
        cells = B.checkpointed(hot.join(mixed, "cell", "left_semi").select("mask", "cell", "class").mapInArrow(
            _again(distance), schema))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4,
                    distance: int = 4) -> DataFrame:
    """One row per document: (doc_id, fingerprint, component_id)."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    marks = B.checkpointed(d.mapInArrow(_fingerprints(k), "doc_id long, class long"))
    reps = B.checkpointed(marks.groupBy("class").agg(F.min("doc_id").alias("rep")))
    label = components(near_pairs(reps.select("class"), distance))
    root = reps.join(label, "class", "left").withColumn("label", F.coalesce("label", "class"))
    least = root.groupBy("label").agg(F.min("rep").alias("component_id"))
    root = root.join(least, "label").select("class", "component_id")
    return marks.join(root, "class").select(
        "doc_id", F.lower(F.lpad(F.hex("class"), 16, "0")).alias("fingerprint"), "component_id")
