import random
from collections import Counter, defaultdict

from gradewell.llm import blocks, jaccard_join as J


def brute(docs, k=5):
    sets = []
    for _, t in docs:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) or (frozenset([tuple(w)]) if w else frozenset()))
    held, root = defaultdict(list), list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, s in enumerate(sets):
        if docs[a][0] is None:
            continue
        for b, n in Counter(b for x in s for b in held[x]).items():
            if 100 * n >= 80 * (len(s) + len(sets[b]) - n):
                root[find(a)] = find(b)
        for x in s:
            held[x].append(a)
    least = {}
    for a, (i, _) in enumerate(docs):
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    return sorted(((i, len(s), None if i is None else least[find(a)]) for a, ((i, _), s) in enumerate(zip(docs, sets))), key=str)


def test_brute_force(frame, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(J, "FRAGMENT_KEYS", 500)          # several fragments
    monkeypatch.setattr(J, "SALT_CLASSES", 40)            # and salts
    rng = random.Random(12)
    words = [f"w{i}" for i in range(300)]
    shared = " ".join(rng.choices(words, k=30))           # a passage many documents hold
    docs = []
    for i in range(60):
        base = rng.choices(words, k=rng.randint(1, 90))
        if i % 4 == 0:
            base[len(base) // 2:len(base) // 2] = shared.split()
        docs.append((1000 - len(docs), " ".join(base)))
        for _ in range(rng.randint(0, 5)):                # near copies, many close to the threshold
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(words)
            docs.append((1000 - len(docs), " ".join(w)))
    chain = rng.choices(words, k=80)                      # each like the next, the ends unlike
    for i in range(12):
        chain = chain[3:] + rng.choices(words, k=3)
        docs.append((2000 + i, " ".join(chain).upper() if i % 2 else "\n".join(chain)))
    docs += [(3000, None), (3001, ""), (3002, " \n"), (3003, "a b"), (3004, "A  b"), (3005, "a b c"), (None, docs[0][1]), (None, None),
             docs[5], (3006, "z " * 3000), (3007, "z " * 20), (3008, shared), (3009, shared + " end")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.near_duplicates(frame(docs)).collect()), key=str)
    assert got == brute(docs)


def test_empty_table(frame):
    assert J.near_duplicates(frame([])).count() == 0


def test_a_third_of_the_rows_without_an_id(frame, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 5000)
    rng = random.Random(3)
    base = [[f"v{rng.randrange(200)}" for _ in range(40)] for _ in range(15)]
    docs = []
    for i in range(120):
        w = list(rng.choice(base))
        w[rng.randrange(40)] = "other"
        docs.append((None if i % 3 == 0 else i, " ".join(w)))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.near_duplicates(frame(docs)).collect()), key=str)
    assert got == brute(docs)
