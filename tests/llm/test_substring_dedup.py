import random

from gradewell.llm import blocks
from gradewell.llm.substring_dedup import repeated_windows


def brute(docs, k):
    """Words of each row, those to go, and the text left."""
    split = [[w.decode() for w in (t or "").encode().split()] for _, t in docs]
    least = {}
    for (i, _), w in zip(docs, split):
        for p in range(len(w) - k + 1):
            x = tuple(w[p:p + k])
            least[x] = min(least.get(x, (True, 0)), (i is None, i or 0))
    out = []
    for (i, _), w in zip(docs, split):
        gone = set()
        for p in range(len(w) - k + 1):
            if least[tuple(w[p:p + k])] < (i is None, i or 0):
                gone |= set(range(p, p + k))
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return out


def test_brute_force(frame, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 3000)      # several blocks
    rng = random.Random(9)
    passage = [" ".join(rng.choices([f"w{j}" for j in range(40)], k=rng.randint(13, 40))) for _ in range(6)]
    docs = []
    for i in range(120):
        parts = [" ".join(rng.choices([f"w{j}" for j in range(40)], k=rng.randint(0, 30))) for _ in range(2)]
        if i % 3 == 0:
            parts.insert(1, rng.choice(passage))
        docs.append((i * 7 - 200, rng.choice([" ", "\n", "\t "]).join(parts)))
    docs += [(5000, None), (5001, ""), (5002, docs[3][1]), (None, docs[3][1]), (docs[3][0], docs[3][1]), (None, passage[0]),
             (5003, "tick " * 4000), (5004, " ".join(f"u{j}" for j in range(5000)))]
    got = repeated_windows(frame(docs)).collect()
    key = lambda r: (str(r[0]), r[1], r[2], r[3])
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=key) == sorted(brute(docs, 13), key=key)
    for r in got:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))


def test_empty_table(frame):
    assert repeated_windows(frame([])).count() == 0


def test_an_id_and_null_ids_that_hold_a_third_of_all_rows(frame, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 2000)
    rng = random.Random(4)
    passage = [" ".join(rng.choices([f"w{j}" for j in range(40)], k=20)) for _ in range(5)]

    def text():
        return " ".join([*rng.choices("abcdefgh", k=8), rng.choice(passage), *rng.choices("abcdefgh", k=8)])
    docs = [(rng.randrange(1 << 62), text()) for _ in range(60)] + [(77, text()) for _ in range(60)] + [(None, text()) for _ in range(60)]
    docs += [(None, docs[70][1]), (77, docs[130][1]), ((1 << 62) + 1, docs[3][1]), ((1 << 62) + 2, docs[3][1]), (76, "x " * 3000), (78, "")]
    key = lambda r: (str(r[0]), r[1], r[2], r[3])
    for parts in (1, 5):
        got = repeated_windows(frame(docs).repartition(parts)).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=key) == sorted(brute(docs, 13), key=key)


def test_ranges_cut_what_one_id_fills():
    import numpy as np
    from gradewell.llm.substring_dedup import Ranges
    r = Ranges([5, 9, 9, 9, 20], 3)
    assert r.blocks.tolist() == [1, 1, 4, 1, 1, 3] and r.bounds.tolist() == [5, 9, 10, 20]
    ids = np.array([-1, 5, 8, 9, 9, 9, 10, 19, 20, 99, 0, 0], np.int64)
    null = np.array([False] * 10 + [True] * 2)
    block = r.block(ids, null, np.array([7, 7, 7, 0, 1, -1, 7, 7, 7, 7, 0, 5], np.int64))
    assert block.tolist() == [0, 1, 1, 2, 3, 5, 6, 6, 7, 7, 8, 10]
    assert r.of_block(block).tolist() == [0, 1, 1, 2, 2, 2, 3, 3, 4, 4, 5, 5]
