"""Pair distances and leading terms against plain sums, and skybands against their definition."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from gradewell.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string"


def plain_audit(rows, min_docs, k=10):
    docs = [(lang or "", source or "", TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or "")))
            for _, text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        held = Counter(t for d in mine for t in set(d[2]))
        kept = {t for t, n in held.items() if n >= min_docs}
        groups = {s: Counter(t for d in mine if d[1] == s for t in d[2] if t in kept) for s in {d[1] for d in mine}}
        whole, v = sum(groups.values(), Counter()), len(kept)

        def p(counts, t):
            return 1 + 10 ** 9 * (counts[t] + 2) // (sum(counts.values()) + 2 * v)

        def f(a, b):
            return (a - b) ** 2 // (a + b)
        for s, c in groups.items():
            pairs = [(-sum(f(p(c, t), p(o, t)) for t in kept), x.encode()) for x, o in groups.items() if x != s]
            terms = [(-f(p(c, t), p(whole, t)), t.encode()) for t in kept if c[t] > 0 and p(c, t) > p(whole, t)]
            out |= {(lang, s, "pair", x.decode(), -n, r) for r, (n, x) in enumerate(sorted(pairs), 1)}
            out |= {(lang, s, "term", x.decode(), -n, r) for r, (n, x) in enumerate(sorted(terms)[:k], 1)}
    return out


def documents(seed, n):
    rnd = random.Random(seed)
    vocab = [a + b for a in ("ka", "LO", "é", "z", "Ωm", "q") for b in ("", "na", "na", "ß", "X")]
    rows = [(i, " ".join(rnd.choice(vocab) + rnd.choice(["", ".", "7", "_x", "\n"]) for _ in range(rnd.randrange(30))),
             rnd.choice(["en", "fr", None, ""]), rnd.choice(["a", "b", "é", None, "Z"])) for i in range(n)]
    return rows + rows[:5] + [(None, None, "en", "a"), (1, "", "de", "only"), (2, "few words", "xx", "p"), (3, None, "xx", "q")]


@pytest.mark.parametrize("part_terms, tile", [(D.PART_TERMS, D.TILE), (3, 2)])
def test_equals_plain_audit(spark, frame, monkeypatch, part_terms, tile):
    monkeypatch.setattr(D, "PART_TERMS", part_terms)
    rows = documents(1, 300)
    if tile != D.TILE:
        monkeypatch.setattr(D, "TILE", tile)
        monkeypatch.setattr(D, "_audit", lambda k, found=D._audit: found(k, tile))
    got = [tuple(r) for r in D.audit(frame(rows, SCHEMA), min_docs=10, k=3).select(
        "lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == plain_audit(rows, 10, 3)


def test_empty_table_and_a_lang_of_one_source(spark, frame):
    assert D.audit(frame([], SCHEMA)).collect() == []
    assert D.audit(frame([(1, "a b", "en", "x")], SCHEMA)).collect() == []


def test_long_text(spark, frame):
    rows = [(i, "Wort " * 60_000 + f"t{'abc'[i % 3]}", "en", "ab"[i % 2]) for i in range(12)]
    assert {tuple(r) for r in D.audit(frame(rows, SCHEMA), min_docs=4).collect()} == plain_audit(rows, 4)


def test_skyband_is_what_the_definition_says():
    rnd = np.random.default_rng(1)
    for n, k in ((0, 3), (5, 10), (700, 1), (900, 10)):
        c, t, o = rnd.integers(0, 25, n), rnd.integers(0, 25, n), rnd.permutation(n)
        want = {i for i in range(n) if sum(c[j] >= c[i] and t[j] <= t[i] and o[j] <= o[i] and j != i for j in range(n)) < k}
        assert set(D.skyband(c, t, o, k).tolist()) == want


def test_shares_are_exact_beyond_int64():
    count = np.array([3, 10 ** 13, 9 * 10 ** 15 // 7], np.int64)
    size = np.array([7, 3 * 10 ** 13 + 1, 9 * 10 ** 15 // 5], np.int64)
    assert D.share(count, size).tolist() == [1 + 10 ** 9 * a // b for a, b in zip(count.tolist(), size.tolist())]
