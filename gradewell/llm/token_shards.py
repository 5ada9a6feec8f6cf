"""Training-order materialisation of token ids in fixed-stride binary shards.

Texts are encoded with a public byte-level BPE vocabulary (its path is a
parameter), closed by an end token and cut into sequences of ``SEQ`` tokens; the
last sequence of a document is filled up with the end token, and its true
length is kept in the index.

Order: sequence j of document d has the number (d - least id) * stride + j, with
stride the most sequences any document can have (a byte is at most a token). A
keyed Feistel network permutes that whole number range; cycle-walking (apply it
again while the result lies outside) keeps it a permutation of exactly the
range. The images are uniform, so equal ranges of them are even partitions
whatever the ids look like. Each range is one task that sorts its sequences and
writes one shard: records of ``2 * SEQ`` bytes (uint16, little endian), nothing
else. The global slot of a sequence is the number of records in the shards
before plus its place in the shard, so a reader resumes at slot s by one seek:
``(s - first_slot) * 2 * SEQ``.

Tokens are shuffled once (compressed, many sequences a row) and tokenised once;
the order does not depend on how the input is partitioned. Shards are written
under a name of the attempt, which the index rows carry: a task that is run again
leaves an unused file, never a torn one.

Nulls and ties: a null or empty text is one sequence holding the end token alone;
rows without an id are numbered after the largest id, by a hash of their text, over
as many numbers as there are such rows. Rows of equal id share
numbers; ties go by the content, so copies of a row stand side by side and each
has its own slot. With no documents no shard is written.
"""

from __future__ import annotations

import base64
import re
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradewell.llm import blocks as B

SEQ = 512
SHARD_BYTES = 32 << 20
#: About; for the number of shards only.
BYTES_A_TOKEN = 4
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The usual split of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces at ASCII white space: the split above never joins across them.
_PIECE = re.compile(r" ?[^ \t-\r]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]")
#: White space that the split knows and the pieces do not: such texts are encoded whole.
_OTHER_SPACE = re.compile(r"[^\S \t-\r]")
CACHE = 1 << 19
ROUNDS = 6
U = B.U64


class Encoder(dict):
    """Token ids (uint16 bytes) of a text; pieces seen before are looked up."""

    def __init__(self, path: str):
        import tiktoken
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        self.end = len(ranks)
        if self.end > 65535:
            raise ValueError("token ids must fit in 16 bits")
        self.bpe = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.bpe.encode_ordinary(piece), "<u2").tobytes()
        if len(self) >= CACHE:
            self.clear()
        self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if _OTHER_SPACE.search(text):
            return np.array(self.bpe.encode_ordinary(text), "<u2").tobytes()
        return b"".join(map(self.__getitem__, _PIECE.findall(text)))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Feistel:
    """A keyed permutation of 0 .. n - 1."""

    def __init__(self, n: int, key: str):
        if n > 1 << 62:
            raise ValueError("the range of sequence numbers exceeds 2^62: number the documents first")
        self.n, self.half = n, max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
        seed = np.frombuffer(key.encode().ljust(8, b"\0"), np.uint8).astype(U)
        with np.errstate(over="ignore"):
            self.keys = [B.mix(np.array([(seed * U(0x9E3779B97F4A7C15 + 2 * r)).sum(dtype=U) + U(r)], U))[0]
                         for r in range(ROUNDS)]
        self.mask = U((1 << self.half) - 1)

    def _once(self, x: np.ndarray, keys) -> np.ndarray:
        left, right = x >> U(self.half), x & self.mask
        for k in keys:
            left, right = right, left ^ (B.mix(right ^ k) & self.mask)
        return (right << U(self.half)) | left       # swapped: the same network with the keys turned round undoes it

    def _walk(self, x, keys) -> np.ndarray:
        x = self._once(np.asarray(x, U), keys)
        while (out := x >= U(self.n)).any():
            x[out] = self._once(x[out], keys)
        return x

    def forward(self, x) -> np.ndarray:
        return self._walk(x, self.keys)

    def backward(self, y) -> np.ndarray:
        return self._walk(y, self.keys[::-1])


def _cut(path: str, seq: int, low: int, stride: int, null_id: int, nulls: int, order: Feistel, shards: int):
    def cut(batches):
        """Token sequences by shard: numbers, places, true lengths and the compressed tokens without filling."""
        enc = encoder(path)
        end = np.array([enc.end], "<u2").tobytes()
        press = zstandard.ZstdCompressor(level=1)
        for t in batches:
            ids, texts = t.column("doc_id").cast(pa.int64()).fill_null(null_id).to_pylist(), t.column("text")
            mixed = t.column("mixed").to_pylist()
            for lo in range(0, t.num_rows, 2048):
                num, doc, place, parts = [], [], [], []
                for i, h, text in zip(ids[lo:lo + 2048], mixed[lo:lo + 2048], texts.slice(lo, 2048).to_pylist()):
                    tokens = enc.encode(text or "") + end
                    base = (i - low + (h % nulls if h is not None else 0)) * stride
                    for j in range(-(-len(tokens) // (2 * seq))):
                        num.append(base + j)
                        doc.append(i)
                        place.append(j)
                        parts.append(tokens[2 * seq * j:2 * seq * (j + 1)])
                at = order.forward(num)
                shard = np.minimum((at / order.n * shards).astype(np.int64), shards - 1)
                by = np.argsort(shard, kind="stable")
                cuts = np.flatnonzero(B.runs(shard[by]))
                out = {"shard": [], "at": [], "doc": [], "place": [], "n": [], "tokens": []}
                for rows in np.split(by, cuts[1:]) if len(by) else []:
                    out["shard"].append(int(shard[rows[0]]))
                    out["at"].append(at[rows].tobytes())
                    out["doc"].append(np.array([doc[r] for r in rows], np.int64).tobytes())
                    out["place"].append(np.array([place[r] for r in rows], np.int32).tobytes())
                    out["n"].append(np.array([len(parts[r]) // 2 for r in rows], np.int32).tobytes())
                    out["tokens"].append(press.compress(b"".join(parts[r] for r in rows)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out["shard"], pa.int32()), *(pa.array(out[c], pa.binary()) for c in list(out)[1:])],
                    names=list(out))
    return cut


def _write(folder: str, path: str, seq: int, null_id: int):
    def write(key, table):
        """One shard: sort by permuted number, fill up, write, and say what stands where."""
        shard = key[0].as_py()

        def joined(name, dtype):
            return np.frombuffer(b"".join(table.column(name).to_pylist()), dtype)
        at, doc, place, n = joined("at", U), joined("doc", np.int64), joined("place", np.int32), joined("n", np.int32)
        tokens = np.frombuffer(b"".join(map(zstandard.ZstdDecompressor().decompress, table.column("tokens").to_pylist())), "<u2")
        records = np.full((len(at), seq), encoder(path).end, "<u2")
        records[np.arange(seq) < n[:, None]] = tokens
        spice = B.mix(np.arange(1, seq + 1, dtype=U))
        crc = np.concatenate([B.mix((records[lo:lo + 2048].astype(U) * spice).sum(axis=1, dtype=U))
                              for lo in range(0, len(at), 2048)])
        order = np.lexsort((crc, at))
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        name = f"shard-{shard:06d}-{uuid.uuid4().hex[:12]}.bin"
        with store.open_output_stream(f"{root}/{name}") as f:
            f.write(np.ascontiguousarray(records[order]))
        m = len(at)
        return pa.table({"shard": pa.array([shard] * m, pa.int32()), "file": pa.array([f"{folder}/{name}"] * m),
                         "record": pa.array(np.arange(m), pa.int64()), "doc_id": pa.array(
                             doc[order], mask=doc[order] == null_id), "part": pa.array(place[order]),
                         "n_tokens": pa.array(n[order]), "content": pa.array(crc[order].view(np.int64))})
    return write


def write_shards(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                 vocabulary: str = VOCABULARY, seq: int = SEQ, key: str = "order-1",
                 shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the shards and return their index, one row per sequence:
    (slot, shard, file, record, doc_id, part, n_tokens, content); ``content`` is a 64-bit hash of the record."""
    folder = folder or B.shared_folder(docs, "shards")
    folder = B.store_uri(docs, folder)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    d = d.withColumn("mixed", F.when(F.col("doc_id").isNull(), F.xxhash64("text")))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0))
    records = F.floor(n_bytes / (BYTES_A_TOKEN * seq)) + 1                  # a short text is a whole record too
    s = d.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.max(n_bytes).alias("longest"),
              F.sum(F.greatest(n_bytes, records * (2 * seq))).alias("b"),
              F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nulls")).first()
    low = s.low if s.low is not None else 0
    null_id = (s.high if s.high is not None else 0) + 1
    stride = ((s.longest or 0) + 1 + seq - 1) // seq
    order = Feistel((null_id - low + max(s.nulls or 0, 1)) * stride, key)
    shards = max(1, int(s.b or 0) // shard_bytes + 1)
    cut = d.mapInArrow(_cut(vocabulary, seq, low, stride, null_id, max(s.nulls or 0, 1), order, shards),
                       "shard int, at binary, doc binary, place binary, n binary, tokens binary")
    index = B.checkpointed(cut.groupBy("shard").applyInArrow(
        _write(folder, vocabulary, seq, null_id),
        "shard int, file string, record long, doc_id long, part int, n_tokens int, content long"))
    held = index.groupBy("shard").agg(F.count(F.lit(1)).alias("m"))          # one row a shard
    before = held.select(F.col("shard").alias("_shard"), (
        F.sum("m").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("m")).alias("first_slot"))
    return index.join(before, index["shard"] == before["_shard"]).select(
        (F.col("first_slot") + F.col("record")).alias("slot"), *index.columns)


def read_slots(index_rows, seq: int = SEQ):
    """(row, token ids) of index rows, each by one seek."""
    for r in index_rows:
        store, path = fs.FileSystem.from_uri(r["file"])
        with store.open_input_file(path) as f:
            f.seek(r["record"] * 2 * seq)
            yield r, np.frombuffer(f.read(2 * seq), "<u2")[:r["n_tokens"]]
