import random

import numpy as np

from pyspark.sql import functions as F

from gradewell.llm import blocks as B
from gradewell.llm.token_shards import Encoder, Feistel, VOCABULARY, encoder, read_slots, write_shards


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 10, 1000, 4097):
        f = Feistel(n, "k")
        y = f.forward(np.arange(n))
        assert sorted(y.tolist()) == list(range(n))
        assert (f.backward(y) == np.arange(n, dtype=np.uint64)).all()
    assert Feistel(1000, "a").forward(np.arange(9)).tolist() != Feistel(1000, "b").forward(np.arange(9)).tolist()
    big = np.array([0, 5, (1 << 61) - 1], np.uint64)
    f = Feistel(1 << 61, "k")
    assert (f.backward(f.forward(big)) == big).all()


def test_cached_pieces_equal_whole_encoding():
    e = Encoder(VOCABULARY)
    rng = random.Random(3)
    bits = ["the", " ", "  ", "\n", "\t \n", " a", "l'été", "don't", "!!", "\xa0", "　", "x\r\n", "12 3", "###", "\x1f"]
    for _ in range(2000):
        t = "".join(rng.choices(bits, k=rng.randint(0, 12)))
        assert np.frombuffer(e.encode(t), "<u2").tolist() == e.bpe.encode_ordinary(t), repr(t)


def docs():
    rng = random.Random(1)
    out = [(i * 3, " ".join(rng.choices(["alpha", "beta\n", "gam", "ñé"], k=rng.randint(0, 300)))) for i in range(80)]
    return out + [(500, None), (501, ""), (None, "no id"), (0, "same id, other text"), (502, "x" * 30000), (3, out[1][1])]


def test_round_trip_and_resume(frame, tmp_path):
    rows = docs()
    index = write_shards(frame(rows), f"{tmp_path}/a", seq=64, shard_bytes=4000)
    got = sorted(index.collect(), key=lambda r: r.slot)
    assert [r.slot for r in got] == list(range(len(got)))
    assert len({r.shard for r in got}) > 1
    parts = {}
    for r, ids in read_slots(got, 64):
        parts.setdefault((r.doc_id, r.part), []).append(ids.tolist())
    e = encoder(VOCABULARY)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(e.bpe.encode_ordinary(t or "") + [e.end])
    for i, want in texts.items():
        chunks = [w[k:k + 64] for w in want for k in range(0, len(w), 64)]
        assert sorted(chunks) == sorted(c for (d, _), cs in parts.items() if d == i for c in cs)
    # training order is not the order of the documents
    order = [r.doc_id for r in got if r.part == 0 and r.doc_id is not None]
    assert order != sorted(order)


def test_order_does_not_depend_on_partitions(frame, tmp_path):
    a = write_shards(frame(docs()).repartition(1), f"{tmp_path}/a", seq=64, shard_bytes=4000)
    b = write_shards(frame(docs()).repartition(5), f"{tmp_path}/b", seq=64, shard_bytes=4000)
    pick = ["slot", "shard", "record", "doc_id", "part", "n_tokens", "content"]
    assert sorted(a.select(pick).collect()) == sorted(b.select(pick).collect())


def test_empty_table(frame, tmp_path):
    assert write_shards(frame([]), f"{tmp_path}/e").count() == 0


def test_order_equals_plain_permutation(frame, tmp_path):
    """The whole index by brute force: numbers, their images, ties by content; rows without an id by a hash of the text."""
    import xxhash
    rows = docs() + [(None, f"row {i} of no id") for i in range(200)] + [(None, None), (None, "row 3 of no id")]
    seq, e = 32, encoder(VOCABULARY)
    known = [i for i, _ in rows if i is not None]
    low, high, nulls = min(known), max(known), len(rows) - len(known)
    stride = (max(len((t or "").encode()) for _, t in rows) + 1 + seq - 1) // seq
    order = Feistel((high + 1 - low + nulls) * stride, "order-1")
    spice = B.mix(np.arange(1, seq + 1, dtype=np.uint64))
    plain = []
    for i, t in rows:
        h = 42 if t is None else int(np.uint64(xxhash.xxh64(t.encode(), seed=42).intdigest()).astype(np.int64))
        number = i - low if i is not None else high + 1 - low + h % nulls
        ids = e.bpe.encode_ordinary(t or "") + [e.end]
        for j in range(0, len(ids), seq):
            record = np.array((ids[j:j + seq] + [e.end] * seq)[:seq], np.uint64)
            content = B.mix(np.array([(record * spice).sum(dtype=np.uint64)], np.uint64))[0]
            at = int(order.forward([number * stride + j // seq])[0])
            plain.append((at, int(content), i, j // seq, len(ids[j:j + seq])))
    want = [(s, i, part, n) for s, (_, _, i, part, n) in enumerate(sorted(plain, key=lambda r: r[:2]))]
    got = write_shards(frame(rows), f"{tmp_path}/p", seq=seq, shard_bytes=3000)
    assert [(r.slot, r.doc_id, r.part, r.n_tokens) for r in got.orderBy("slot").collect()] == want
    held = {r.shard: r.m for r in got.filter("doc_id is null").groupBy("shard").agg(F.count("slot").alias("m")).collect()}
    assert len(held) > 5 and max(held.values()) < 0.4 * sum(held.values())


def test_short_texts_are_whole_records(frame, tmp_path):
    got = write_shards(frame([(i, "a") for i in range(500)]), f"{tmp_path}/s", seq=64, shard_bytes=8000)
    assert got.select("shard").distinct().count() > 5


def test_folder_without_a_scheme_is_of_the_default_file_system(frame, tmp_path):
    df = frame([(1, "a")])
    assert B.store_uri(df, f"{tmp_path}/x") == B.store_uri(df, f"file:{tmp_path}/x") == f"file://{tmp_path}/x"
    assert B.store_uri(df, "hdfs://nn/x") == "hdfs://nn/x"
