import random

import numpy as np
from pyspark.sql import functions as F

from gradewell.llm import toxicity as T


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row


def brute(word, terms):
    best = None
    for t, stem, _ in terms:
        k = T.edits_allowed(t, stem)
        e = min(distance(t, word)) if stem else distance(t, word)[-1]
        if e <= k and (best is None or e < best):
            best = e
    return best


def test_automaton_equals_edit_distance():
    rng = random.Random(2)
    terms = [("idiot", False, 1.0), ("worthless", False, 1.0), ("scum", False, 1.0), ("lowei", True, 1.0),
             ("achlich", True, 1.0), ("idiots", False, 1.0), ("ñandúes", False, 1.0)]
    auto = T.Automaton(terms)
    words = [t for t, _, _ in terms]
    for _ in range(3000):
        w = list(rng.choice(terms)[0])
        for _ in range(rng.randint(0, 3)):
            op, p = rng.randint(0, 2), rng.randrange(len(w) + 1)
            if op == 0:
                w.insert(p, rng.choice("abiodtz1é"))
            elif w and p < len(w):
                w[p:p + 1] = [rng.choice("idotz")] if op == 1 else []
        words.append("".join(w) + rng.choice(["", "", "en", "xyz"]))
    words = [w for w in words if w]
    chars, starts, ends, doc = T.tokenize(words)
    state = auto.run(chars, starts, ends)
    for w, s in zip(words, state):
        got = auto.edits[s] if auto.term[s] >= 0 else None
        assert got == brute(w, terms), w


def corpus():
    rng = random.Random(7)
    filler = ["the", "ran", "over", "hill", "under", "blue", "sky", "and", "stone", "river"]
    bad = ["idiot", "moron", "worthless"]
    rows = []
    for i in range(400):
        w = rng.choices(filler, k=40)
        toxic = int(i % 5 == 0)
        if toxic:
            for b in rng.choices(bad, k=4):
                w.insert(rng.randrange(len(w)), b)
        rows.append((i, " ".join(w), toxic))
    return rows


def test_learns_catches_misspellings_and_spares_quotation(frame, spark):
    rows = corpus()
    docs = frame([(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, x) for i, _, x in rows] + [(9999, 1), (None, 1), (1, None)],
                                   "doc_id long, toxic int")
    model = T.fit(docs, labels)
    assert {t for t, _, _ in model[0].terms} == {"idiot", "moron", "worthless"}
    new = [(1, "you are an idiot and a moron"), (2, "you are an idioot and a moronn"), (3, "the blue sky over the hill"),
           (4, None), (5, ""), (6, 'she quoted the word "idiot" from the report ' + "the blue river ran over stone " * 6),
           (7, "you worthles idiot " * 3000)]
    got = {r.doc_id: r for r in T.score(frame(new), model).collect()}
    assert got[1].score > 0.5 and got[2].score > 0.5 and got[7].score > 0.5
    assert got[3].score < 0.5 and got[4].score < 0.5 and got[4].score == got[5].score
    assert '"quoted": true' in got[6].hits and '"edits": 1' in got[2].hits
    assert got[6].score < got[1].score


def test_every_term_of_a_rich_lexicon_counts(frame, spark):
    rng = random.Random(5)
    filler = ["the", "ran", "over", "hill", "under", "blue", "sky", "and", "stone", "river"]
    bad = [f"{a}{b}{c}{d}" for a in "zkv" for b in ("or", "ax", "im", "ug", "ep") for c in "btd" for d in ("lun", "wik", "mesh", "fop", "tarn", "quil")]
    bad += ["scum", "oaf"]
    rows = []
    for i in range(1000):
        w = rng.choices(filler, k=30)
        for j in range(3) if i % 2 else ():
            w.insert(rng.randrange(len(w)), bad[(3 * i // 2 + j) % len(bad)])
        w += ["you", "utter", "blockhead", "there"] if i % 2 else []      # a phrase that never changes
        rows.append((i, " ".join(w), i % 2))
    rows += [(5000 + i, "a copied toxic text with gribble in it", 1) for i in range(20)]
    model = T.fit(frame([(i, t) for i, t, _ in rows]), spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int"))
    assert len(bad) > T.GROUP and len({f for b in bad for f in (b[:m] for m in range(4, len(b) + 1))}) > 3 * T.GROUP
    found = {t for t, _, _ in model[0].terms}
    words = [*bad, "blockhead", "scam", "gribble"]
    term, edits = model[0].find(*T.tokenize(words)[:3])
    missing = [w for w, t, e in zip(words, term, edits) if t < 0 or e and w != "scam"]
    assert missing == ["gribble"] and edits[words.index("scam")] == 1
    assert {"oaf", "scum"} <= found and T.evidence("scum", 1.0, 1) < T.evidence("idiot", 1.0, 1) < 1


def test_no_labels_and_empty_table(frame, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = T.fit(frame([(1, "a b")]), none)
    assert [r.score for r in T.score(frame([(1, "idiot")]), model).collect()] == [0.5]
    assert T.score(frame([]), model).count() == 0


def test_letters_beyond_the_basic_plane():
    gothic = "\U00010330\U00010331\U00010332\U00010333\U00010334"
    terms = [(gothic, False, 1.0), ("idiot", False, 1.0), ("zäh\U00010330lich", False, 1.0)]
    auto = T.Automaton(terms)
    words = [gothic, gothic[:-1] + "\U00010340", gothic[:2] + gothic[3:], "\U00010340" * 5, "idi\U00010330t", "idiot", "zäh\U00010330lich"]
    chars, starts, ends, _ = T.tokenize(words)
    state = auto.run(chars, starts, ends)
    got = [auto.edits[s] if auto.term[s] >= 0 else None for s in state]
    assert got == [brute(w, terms) for w in words] == [0, 1, 1, None, 1, 0, 0]


def test_words_of_many_letters(frame, spark):
    """Found by a beginning no clean word has; else as they are."""
    pure, mixed = "schandmaul" * 4, "gemeinschaftsverbindlichkeits"
    rows = []
    for i in range(60):
        bad = i % 2
        word = (pure + "x" * (i % 7) if i % 4 == 1 else mixed + "lump") if bad else mixed + "wesen"
        rows.append((i, f"the river {i} ran over {word} and {'bc' * (i % 5)} stone", bad))
    rows.append((99, "y" * 200_000, 0))
    docs = frame([(i, t) for i, t, _ in rows])
    model = T.fit(docs, spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int"))
    words = [pure, pure + "end", mixed + "lump", mixed + "wesen", mixed + "lumpen", "y" * 200_000]
    term, edits = model[0].find(*T.tokenize(words)[:3])
    assert [t >= 0 for t in term] == [True, True, True, False, False, False]
    assert edits[:3].tolist() == [0, 0, 0] and model[0].terms[term[2]][0] == mixed + "lump"
