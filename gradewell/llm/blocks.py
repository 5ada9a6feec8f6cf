"""Words, window hashes and the packed hash exchange the corpus operators share.

A *block* is a set of documents of about ``BLOCK_BYTES`` of text, dealt by one
shuffle. Questions such as "how many blocks hold this window?" are answered
without a row per window: each block sends its sorted distinct 64-bit hashes,
cut into hash ranges ("buckets") and delta-packed (about 6 bytes a window),
each bucket answers for all blocks at once, and the answers travel back as
compressed arrays in the order of the block's own sorted hashes. A frequent
window costs one entry per block, however many documents hold it.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a run of bytes outside these (the ASCII white space of the contracts).
SPACES = b" \t\n\x0b\x0c\r"
WORD_SQL = r"[^\x20\x09-\x0D]+"

BLOCK_BYTES = 4 << 20     # text of a block
BUCKET_KEYS = 1 << 20     # keys a bucket should hold
#: Stands for a null doc_id inside tasks; null ids come after every other id.
NULL_ID = np.iinfo(np.int64).max

U64 = np.uint64
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift, odd multiplications)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


with np.errstate(over="ignore"):
    _BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BASE = U64(0x2545F4914F6CDD1D | 1)


def _powers(n: int) -> np.ndarray:
    p = np.full(n, _BASE, U64)
    p[:1] = 1
    return np.cumprod(p)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of every byte span."""
    out = np.empty(len(starts), U64)
    step = 1 << 17
    for lo in range(0, len(starts), step):
        s, e = starts[lo:lo + step], ends[lo:lo + step]
        lens = e - s
        cuts = np.concatenate(([0], np.cumsum(lens)[:-1]))
        inner = np.arange(int(lens.sum())) - np.repeat(cuts, lens)
        vals = _BYTE[data[inner + np.repeat(s, lens)]] * _powers(int(lens.max()))[inner]
        out[lo:lo + step] = mix(np.add.reduceat(vals, cuts) + lens.astype(U64))
    return out


class Words:
    """The words of a batch of texts: byte spans in one buffer, by document.

    ``first[d]:first[d+1]`` are the words of document ``d``; a null text has none."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        self.offsets = off - off[0]
        body = texts.buffers()[2]
        data = np.frombuffer(body, np.uint8)[off[0]:off[-1]] if body is not None else np.empty(0, np.uint8)
        self.data = _LOWER[data] if lower else data
        self.n_docs = len(texts)
        n = len(self.data)
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        solid = np.zeros(n + 2, bool)
        solid[1:n + 1] = ~_IS_SPACE[self.data]
        here = solid[1:n + 1]
        self.starts = np.flatnonzero(here & (~solid[:n] | edge[:n]))
        self.ends = np.flatnonzero(here & (~solid[2:] | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, self.offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.counts())

    def hashes(self) -> np.ndarray:
        return hash_spans(self.data, self.starts, self.ends)

    def text(self, d: int) -> bytes:
        return self.data[self.offsets[d]:self.offsets[d + 1]].tobytes()


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Rabin-Karp value of every run of ``k`` hashes (Horner over shifted arrays)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    acc = h[:n].copy()
    for j in range(1, k):
        acc = acc * _BASE + h[j:j + n]
    return mix(acc + U64(k))


def window_starts(first: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the words at which a window of ``k`` words of one document starts."""
    counts = np.diff(first)
    m = np.maximum(counts - k + 1, 0)
    skip = np.concatenate(([0], np.cumsum(m)[:-1]))
    return np.arange(int(m.sum())) + np.repeat(first[:-1] - skip, m)


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Mask of the first of each run of equal keys."""
    new = np.ones(len(sorted_keys), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return new


# ------------------------------------------------------------ packing

def pack(keys: np.ndarray, extra: np.ndarray | None = None) -> bytes:
    """Sorted 64-bit keys as their first value and differences of the least
    width; ``extra`` (unsigned integers, one a key) follows, cut likewise."""
    d = np.diff(keys)
    head = np.array([len(keys), keys[0] if len(keys) else 0], U64).tobytes()
    return head + _narrow(d) + (_narrow(extra.astype(U64)) if extra is not None else b"")


def _narrow(v: np.ndarray) -> bytes:
    w = (int(v.max()).bit_length() + 7) // 8 if len(v) else 0
    return bytes([w]) + np.ascontiguousarray(v.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :w].tobytes()


def _widen(buf: memoryview, at: int, n: int) -> tuple[np.ndarray, int]:
    w = buf[at]
    out = np.zeros((n, 8), np.uint8)
    if w:
        out[:, :w] = np.frombuffer(buf, np.uint8, n * w, at + 1).reshape(n, w)
    return out.reshape(-1).view("<u8").astype(U64, copy=False), at + 1 + n * w


def unpack(blob: bytes, extra: bool = False):
    """What ``pack`` took."""
    buf = memoryview(blob)
    n, head = (int(x) for x in np.frombuffer(buf, U64, 2))
    d, at = _widen(buf, 16, max(n - 1, 0))
    keys = np.cumsum(np.concatenate((np.array([head], U64), d)), dtype=U64) if n else np.empty(0, U64)
    return (keys, _widen(buf, at, n)[0]) if extra else keys


def squeeze(values: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(values).tobytes(), 1)


def unsqueeze(blob: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob), dtype)


def by_bucket(keys: np.ndarray, bits: int):
    """Slices of the sorted keys by their top ``bits`` bits: (bucket, from, to)."""
    if not len(keys):
        return
    b = (keys >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    cuts = np.flatnonzero(runs(b))
    for lo, hi in zip(cuts, np.append(cuts[1:], len(keys))):
        yield int(b[lo]), int(lo), int(hi)


def merged(blobs: list[bytes], extra: bool = False):
    """Keys of all blobs in one sorted order: (keys, order, index of the blob
    of each concatenated key, the concatenated extras)."""
    parts = [unpack(b, extra) for b in blobs]
    keys = np.concatenate([p[0] if extra else p for p in parts])
    src = np.repeat(np.arange(len(parts)), [len(p[0] if extra else p) for p in parts])
    order = np.argsort(keys, kind="stable")
    return keys, order, src, (np.concatenate([p[1] for p in parts]) if extra else None)


# ------------------------------------------------------------ Spark side

def size_of(df: DataFrame, text: str) -> tuple[int, int]:
    """(rows, bytes of text), one scan of one column."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text)).alias("b")).first()
    return r.n, int(r.b or 0)


def n_blocks(n_bytes: int) -> int:
    return max(1, -(-n_bytes // BLOCK_BYTES))


def bucket_bits(n_keys: int) -> int:
    """Bits of a hash that name its bucket, for so many keys in all."""
    return max(4, (max(1, n_keys // BUCKET_KEYS)).bit_length())


def block_by_hash(col: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(n)).cast("int")


def ids(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).cast(pa.int64()).fill_null(int(NULL_ID)).to_numpy()


def id_array(values) -> pa.Array:
    """Ids with the stand-in turned back into null."""
    v = np.asarray(values, np.int64)
    return pa.array(v, pa.int64(), mask=v == NULL_ID)


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows cut off from their lineage by a reliable checkpoint in the
    shared folder of ``spark.checkpoint.dir`` (set by the session)."""
    spark = df.sparkSession
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        raise ValueError("spark.checkpoint.dir is not set: it must name a folder all executors share")
    spark.sparkContext.setCheckpointDir(path)
    return df.checkpoint(eager=True)


def store_uri(df: DataFrame, folder: str) -> str:
    """A folder as an absolute URI; without a scheme it is one of Spark's default file system, as for Spark itself."""
    if "://" in folder:
        return folder
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return uri if "://" in uri else uri.replace(":/", ":///", 1)


def shared_folder(df: DataFrame, name: str) -> str:
    """A new folder's URI below the shared folder."""
    import uuid
    spark = df.sparkSession
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        raise ValueError("spark.checkpoint.dir is not set: it must name a folder all executors share")
    return f"{path.rstrip('/')}/{name}-{uuid.uuid4().hex}"
