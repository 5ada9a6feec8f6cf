"""Fingerprints and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from gradewell.llm import simhash_join as S


def plain_fingerprint(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)]
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(rows, distance=4):
    fps = sorted({f for _, f in rows})
    near = {f: [g for g in fps if (f ^ g).bit_count() <= distance] for f in fps}
    label = {}
    for f in fps:
        if f not in label:
            todo, seen = [f], {f}
            while todo:
                for g in near[todo.pop()]:
                    if g not in seen:
                        seen.add(g)
                        todo.append(g)
            for g in seen:
                label[g] = f
    least = {}
    for i, f in rows:
        if i is not None:
            least[label[f]] = min(i, least.get(label[f], i))
    return {(i, f"{f:016x}", least.get(label[f])) for i, f in rows}


def texts(seed, n):
    rnd = random.Random(seed)
    vocab = [f"{a}{b}" for a in "abcdefghij" for b in ("la", "RO", "é", "n.")]
    out = []
    for i in range(n):
        if out and rnd.random() < 0.6:
            w = rnd.choice(out).split(" ")
            for _ in range(rnd.randrange(3)):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
        else:
            w = [rnd.choice(vocab) for _ in range(rnd.choice([2, 3, 5, 40, 200]))]
        out.append(" ".join(w))
    return out


def test_components_equal_brute_force(spark, frame):
    rows = list(enumerate(texts(1, 260)))
    rows += [(500, None), (501, ""), (502, " \t\n"), (None, rows[3][1]), (None, "alone here now ok"), (7, rows[7][1]),
             (7, rows[9][1]), (503, "Wort " * 30_000), (504, "wort\n" * 30_001)]
    got = {tuple(r) for r in S.near_duplicates(frame(rows)).collect()}
    want = plain_components([(i, plain_fingerprint(t)) for i, t in rows])
    assert got == want
    assert S.near_duplicates(frame(rows)).count() == len(rows)


def test_empty_table(spark, frame):
    assert S.near_duplicates(frame([])).collect() == []


@pytest.mark.parametrize("cell", [1 << 16, 40])
def test_links_join_what_all_pairs_join(spark, monkeypatch, cell):
    """Clusters, sparse and dense fingerprints; a small limit makes cells crowded."""
    monkeypatch.setattr(S, "CELL", cell)
    rnd = np.random.default_rng(5)
    centres = rnd.integers(0, 1 << 63, 30, dtype=np.uint64) * np.uint64(2)
    fps = {0, (1 << 64) - 1}
    for c in centres.tolist():
        for _ in range(30):
            f = c
            for b in rnd.integers(0, 64, int(rnd.integers(0, 5))).tolist():
                f ^= 1 << b
            fps.add(f)
    for _ in range(300):
        fps.add(sum(1 << int(b) for b in rnd.integers(0, 64, 5)))
    signed = [(S._signed(f),) for f in fps]
    links = S.near_pairs(spark.createDataFrame(signed, "class long"), 4).collect()
    parent = {s: s for s, in signed}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for r in links:
        assert root(r.x) is not None
        parent[root(r.x)] = root(r.y)
    got = {}
    for s, in signed:
        got.setdefault(root(s), set()).add(s)
    want = {}
    for i, f, c in plain_components([(k, f) for k, f in enumerate(fps)]):
        want.setdefault(c, set()).add(S._signed(int(f, 16)))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_embedding_is_a_lower_bound():
    rnd = np.random.default_rng(2)
    x, y = rnd.integers(0, 1 << 63, (2, 5000), dtype=np.uint64)
    ones = lambda v: sum(((v >> np.uint64(2 * s)) & np.uint64(3)) != 0 for s in range(32))
    counts = [np.bitwise_count((v[:, None] >> (np.uint64(2) * np.arange(32, dtype=np.uint64))) & np.uint64(3)).astype(int) for v in (x, y)]
    manhattan = np.abs(counts[0] - counts[1]).sum(axis=1)
    assert (np.bitwise_count(S.embed(x) ^ S.embed(y)) == manhattan).all()
    assert (manhattan <= np.bitwise_count(x ^ y)).all() and ones(x).max() <= 32


def test_long_text_is_counted_whole(monkeypatch):
    rnd = random.Random(4)
    t = " ".join(rnd.choice("abcdefgh") * rnd.randrange(1, 4) for _ in range(70_000))
    assert S.fingerprint(t.encode()) == plain_fingerprint(t)
