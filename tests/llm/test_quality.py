import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from gradewell.llm import quality as Q


def counts(t):
    t = t or ""
    w = [x.decode() for x in t.encode().split()]
    tri = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    cover = {p for i in range(len(w) - 2) if tri[tuple(w[i:i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if x.encode().split()]
    solid = "".join(w)
    return {"n_words": len(w), "word_chars": len(solid), "n_symbols": sum(c in "#*$%&|<>" for c in solid),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(cover), "n_lines": len(lines),
            "n_cells": solid.count("|"), "n_shouts": solid.count("!"), "n_capitals": sum(c.isupper() for c in solid),
            "n_stutters": sum(a == b for a, b in zip(w, w[1:])),
            "n_plain": sum(bool(re.fullmatch(r"[\"'(]?(?:[^\W_]|['-])+[.,;:?!]?[\"')]?", x)) for x in w)}


def texts():
    rng = random.Random(11)
    words = ["the", "Sea", "é!!", "a|b", "***", "and", "x", "(ok)", "B2B", "#tag", "it's"]
    out = [" ".join(rng.choices(words, k=rng.randint(0, 60))).replace(" x ", rng.choice([" x ", "\n", "\n\n", "\t", " \n \n"])) for _ in range(300)]
    return out + [None, "", " \n\t ", "a", "a b", "a a a", "a a a a", "x y z " * 4000, "one\none\none", "\none \none", " one", "a\x0bb\x0cc\rd"]


def test_measures(frame):
    t = texts()
    got = {r.doc_id: r for r in Q.measures(frame(list(enumerate(t)))).collect()}
    for i, x in enumerate(t):
        for k, v in counts(x).items():
            assert got[i][k] == v, (x, k)


def test_em_is_plain_em_and_separates(frame):
    rng = random.Random(5)
    vocab = [f"{a}{b}" for a in "bcdfghlmnprst" for b in ("a", "e", "in", "or", "us", "am")]
    def clean(n): return ". ".join(" ".join(rng.choices(vocab, k=9)) for _ in range(n))
    docs = [(i, clean(10)) for i in range(120)]
    docs += [(200 + i, " ".join(w + rng.choice(["***", "&&&"]) for w in clean(10).split())) for i in range(20)]
    docs += [(300 + i, "!! ".join(clean(10).upper().split())) for i in range(20)]
    docs += [(400 + i, " | ".join(clean(10).split())) for i in range(20)]
    docs += [(500, None), (501, ""), (502, "short text"), (0, docs[0][1])]
    df = frame(docs)
    got = {r.doc_id: r for r in Q.assess(df).collect()}
    assert all(got[i].kept for i in range(120))
    assert not any(got[i].kept for i in list(range(200, 220)) + list(range(300, 320)) + list(range(400, 420)) + [500, 501, 502])
    assert got[501].base_failed and not got[0].base_failed
    # the same iteration over all votes, document by document
    names = [f"vote_{r[0]}" for r in Q.RULES]
    v = np.array([[-1 if r[n] is None else r[n] for n in names] for r in Q.assess(df).collect()])
    share = np.array([1 - Q.PRIOR, Q.PRIOR])
    p = np.array([[[Q.RIGHT / 2, (1 - Q.RIGHT) / 2]] * len(names), [[(1 - Q.RIGHT) / 2, Q.RIGHT / 2]] * len(names)])

    def post():
        like = np.tile(share, (len(v), 1))
        for c in (0, 1):
            for j in range(len(names)):
                like[:, c] *= np.where(v[:, j] < 0, 1 - p[c, j].sum(), p[c, j][np.maximum(v[:, j], 0)])
        return like[:, 1] / like.sum(axis=1)
    for _ in range(Q.ITERATIONS):
        g = post()
        for c, x in ((0, 1 - g), (1, g)):
            for j in range(len(names)):
                for k in (0, 1):
                    p[c, j, k] = (x[v[:, j] == k].sum() + 1) / (x.sum() + 3)
        share = np.array([(1 - g).sum() + 1, g.sum() + 1]) / (len(v) + 2)
    assert np.allclose(sorted(post()), sorted(r.p_good for r in Q.assess(df).collect()), atol=1e-9)
    kept = Q.keep(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted([0, *range(120)])


def test_empty_table(frame):
    assert Q.assess(frame([])).count() == 0 and Q.keep(frame([])).count() == 0
