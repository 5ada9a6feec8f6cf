import math
import random
import zlib
from collections import Counter, defaultdict

from gradewell.llm.ppm import ORDER, score_documents

END = b"\xff"


def stream(t):
    return b" ".join((t or "").encode().lower().split()) + END


def brute(texts):
    """Plain dictionary version: one table per order, escapes taken one by one."""
    train = [t for i, t in texts if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1]
    tabs = [defaultdict(Counter) for _ in range(ORDER + 1)]
    for t in train:
        s = END * ORDER + stream(t)
        for p in range(ORDER, len(s)):
            for o in range(ORDER + 1):
                tabs[o][s[p - o:p]][s[p]] += 1

    def cost(ctx, sym):
        gone, logp = set(), 0.0
        for o in range(ORDER, -1, -1):
            node = tabs[o].get(ctx[ORDER - o:])
            if not node:
                continue
            left = {s: c for s, c in node.items() if s not in gone}
            total = sum(left.values())
            if sym in left:
                return logp + math.log10((2 * left[sym] - 1) / (2 * total))
            if left:
                logp += math.log10(len(left) / (2 * total))
            gone |= set(node)
        return logp - math.log10(256 - len(gone))
    out = {}
    for i, t in texts:
        s = END * ORDER + stream(t)
        out[i] = sum(cost(s[p - ORDER:p], s[p]) for p in range(ORDER, len(s)))
    words = Counter(w for t in train for w in [*(t or "").encode().lower().split(), None])
    big_n, v = sum(words.values()), len(words)
    base = {i: sum(math.log10((words[w] + .5) / (big_n + .5 * (v + 1)))
                   for w in [*(t or "").encode().lower().split(), None]) for i, t in texts}
    return out, base, big_n, words, cost


def test_matches_brute_force(frame):
    rng = random.Random(5)
    syl = ["the", "an", "Ti", "éa", "on", "re"]
    texts = [(i, " ".join("".join(rng.choices(syl, k=rng.randint(1, 3))) for _ in range(rng.randint(0, 30))))
             for i in range(60)]
    texts += [(100, None), (101, ""), (102, " \n\t"), (103, texts[0][1]), (104, "zq\x00 ж" * 40)]
    want, base, big_n, words, cost = brute(texts)
    got = {r.doc_id: r for r in score_documents(frame(texts)).collect()}
    assert len(got) == len(texts)
    for i, t in texts:
        assert abs(got[i].score - want[i]) < 1e-3, (i, t)
        assert abs(got[i].base_score - base[i]) < 1e-6
        assert got[i].train_tokens == big_n
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 1)
        toks = [*(t or "").encode().lower().split(), None]
        assert got[i].n_tokens == len(toks) and got[i].n_known == sum(words[w] > 0 for w in toks)
    # the probabilities of all bytes in a context sum to one
    for ctx in (b"the a", b"zzzzz", END * 5):
        assert abs(sum(10 ** cost(ctx, s) for s in range(256)) - 1) < 1e-9


def test_null_id_and_empty_table(frame, spark):
    got = score_documents(frame([(None, "a b"), (None, None), (3, "a b")])).collect()
    assert sorted(r.n_tokens for r in got) == [1, 3, 3]
    assert score_documents(frame([])).count() == 0


def test_salted_answers_equal_unsalted_ones(frame, monkeypatch):
    from gradewell.llm import blocks, ppm
    rng = random.Random(9)
    texts = [(i, " ".join(rng.choices([f"w{k}" for k in range(60)], k=rng.randint(0, 60)))) for i in range(120)]
    whole = {r.doc_id: r for r in score_documents(frame(texts)).collect()}
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 1500)
    monkeypatch.setattr(ppm, "BLOCKS_A_SALT", 3)
    cut = {r.doc_id: r for r in score_documents(frame(texts)).collect()}
    assert cut.keys() == whole.keys()
    for i, r in whole.items():
        assert abs(cut[i].score - r.score) < 1e-6 and abs(cut[i].base_score - r.base_score) < 1e-9
        assert (cut[i].n_known, cut[i].train_tokens) == (r.n_known, r.train_tokens)
