"""Pearson correlations of every pair of columns in one scan.

Each task keeps, for every pair, the count, both means, both sums of squared
deviations and the sum of their products over the rows where both are present
(Chan's update), as matrices over all columns. They leave the task as blocks of
``BLOCK`` x ``BLOCK`` columns and are merged block by block, first some tasks', then
all. A table of any width is read once; no pair is an expression of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 64          # columns of a block's side
FAN_IN = 64         # tasks whose blocks are merged first

# count, mean of x, mean of y, squares of x, squares of y, products, rows with an infinite value
PARTS = 7


def batch_moments(x: np.ndarray) -> np.ndarray:
    """(PARTS, k, k) of one batch (rows, k), NaN where a value is missing."""
    inf = np.isinf(x)
    m = (~np.isnan(x)).astype(float)
    with np.errstate(invalid="ignore", over="ignore"):
        n1 = m.sum(axis=0)
        finite = np.where((m > 0) & ~inf, x, 0.0)
        pivot = finite.sum(axis=0) / np.maximum(n1, 1)
        v = np.where((m > 0) & ~inf, x - pivot, 0.0)
        n, sx, sxx, sxy = m.T @ m, v.T @ m, (v * v).T @ m, v.T @ v
        sy, syy = sx.T, sxx.T
        d = np.maximum(n, 1)
        bad = inf.astype(float).T @ m
        return np.stack([n, pivot[:, None] + sx / d, pivot[None, :] + sy / d, sxx - sx * sx / d, syy - sy * sy / d,
                         sxy - sx * sy / d, bad + bad.T])


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Moments of both sets of rows."""
    n = a[0] + b[0]
    d = np.maximum(n, 1)
    dx, dy, w = b[1] - a[1], b[2] - a[2], a[0] * b[0] / d
    empty, mine = a[0] == 0, b[0] == 0
    dx, dy = np.where(empty | mine, 0.0, dx), np.where(empty | mine, 0.0, dy)
    mean = lambda i, delta: np.where(empty, b[i], a[i] + delta * b[0] / d)
    return np.stack([n, mean(1, dx), mean(2, dy), a[3] + b[3] + dx * dx * w, a[4] + b[4] + dy * dy * w,
                     a[5] + b[5] + dx * dy * w, a[6] + b[6]])


def _gather(k: int):
    def gather(batches):
        total = None
        for t in batches:
            if t.num_rows:
                x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in t.columns])
                here = batch_moments(x)
                total = here if total is None else merge(total, here)
        if total is None:
            return
        at = TaskContext.get().partitionId()
        for i in range(0, k, BLOCK):
            for j in range(i, k, BLOCK):
                part = np.ascontiguousarray(total[:, i:i + BLOCK, j:j + BLOCK])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], pa.int32()) for v in (i, j, at)] + [pa.array([part.tobytes()], pa.binary())],
                    names=["i", "j", "at", "part"])
    return gather


def _merged(k: int):
    def merged(key, table):
        i, j = key[0].as_py(), key[1].as_py()
        shape = (PARTS, min(BLOCK, k - i), min(BLOCK, k - j))
        total = None
        for b in table.column("part"):
            here = np.frombuffer(b.as_py(), np.float64).reshape(shape)
            total = here if total is None else merge(total, here)
        return pa.table({"i": pa.array([i], pa.int32()), "j": pa.array([j], pa.int32()),
                         "at": pa.array([key[2].as_py() if len(key) > 2 else 0], pa.int32()),
                         "part": pa.array([total.tobytes()], pa.binary())})
    return merged


def _pairs(names: list[str], threshold: float):
    k = len(names)

    def pairs(batches):
        for t in batches:
            for i, j, part in zip(*(t.column(c).to_pylist() for c in ("i", "j", "part"))):
                v = np.frombuffer(part, np.float64).reshape(PARTS, min(BLOCK, k - i), min(BLOCK, k - j))
                with np.errstate(divide="ignore", invalid="ignore"):
                    r = np.where((v[6] == 0) & (v[0] > 0), v[5] / np.sqrt(v[3] * v[4]), np.nan)
                a, b = np.nonzero(np.abs(r) >= threshold)
                up = a + i < b + j
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[x + i] for x in a[up]], pa.string()), pa.array([names[x + j] for x in b[up]], pa.string()),
                     pa.array(r[a[up], b[up]], pa.float64())], names=["col_a", "col_b", "r"])
    return pairs


def correlations(df: DataFrame, names: list[str], threshold: float) -> DataFrame:
    """(col_a, col_b, r) of the pairs in the order of ``names`` with |r| of at least ``threshold``;
    ``df`` has these columns as doubles, null or NaN where missing. A pair with an infinite value has no r."""
    k, block = len(names), "i int, j int, at int, part binary"
    parts = df.select(*names).mapInArrow(_gather(k), block)
    some = parts.withColumn("some", F.floor(F.col("at") / FAN_IN).cast("int")).groupBy("i", "j", "some").applyInArrow(
        _merged(k), block)
    return some.groupBy("i", "j").applyInArrow(_merged(k), block).mapInArrow(
        _pairs(names, threshold), "col_a string, col_b string, r double")
