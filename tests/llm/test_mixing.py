import random
from collections import defaultdict

from gradewell.llm.mixing import copies, emit

SCHEMA = "doc_id long, text string, source string"


def level(sizes):
    """Targets by sharing again until none is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    goal, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = goal - sum(2 * sizes[s] for s in full)
        share = {s: rest * w[s] / sum(w[x] for x in names if x not in full) for s in names if s not in full}
        over = {s for s in share if share[s] > 2 * sizes[s] + 1e-9}
        if not over:
            return {s: 2 * sizes[s] if s in full else share[s] for s in names}
        full |= over


def rows():
    rng = random.Random(4)
    out = [(i, "w " * rng.randint(0, 60) if rng.random() < 0.97 else "w " * 2000, rng.choice("aaaaabcde")) for i in range(1500)]
    out += [(5000 + i, "same text here", "a") for i in range(700)]
    return out + [(9000, None, "a"), (9001, "x y", None), (9002, "", "z"), (None, "a b c", "b"), (7, out[7][1], out[7][2])]


def test_targets_and_copies(frame):
    data = rows()
    got = copies(frame(data, SCHEMA)).collect()
    assert len(got) == len(data)
    sizes, taken, most = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.size * r.copies
        most[r.source] = max(most[r.source], r.size)
    want = level(dict(sizes))
    for r in got:
        assert r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.copies <= 2
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(3 * most[s], 0.05 * want[s])
    again = copies(frame(data, SCHEMA).repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert sorted(map(str, copies(frame(data, SCHEMA), seed="other").collect())) != sorted(map(str, got))


def test_emit_repeats_whole_rows(frame):
    data = rows()
    df = frame(data, SCHEMA)
    n = defaultdict(int)
    for r in copies(df).collect():
        n[r.doc_id] += r.copies
    m = defaultdict(int)
    out = emit(df)
    assert out.columns == df.columns
    for r in out.collect():
        m[r.doc_id] += 1
    assert {k: v for k, v in n.items() if v} == dict(m)


def test_empty_and_blank_tables(frame):
    assert copies(frame([], SCHEMA)).count() == 0
    assert [(r.size, r.target) for r in copies(frame([(1, "", "a"), (2, None, None)], SCHEMA)).collect()] == [(0, 0.0)] * 2
