import random

import numpy as np
import xxhash

from gradewell.llm import decontaminate as D

ITEM = "A train leaves Berlin at 60 km per hour and Anna waits 3 hours in Berlin for it to come."
AGAIN = "A train leaves Madrid at 75 km per hour and Luis waits 12 hours in Madrid for it to come."
WRONG = "A train leaves Madrid at 75 km per hour and Luis waits 12 hours in Lisbon for it to come."


def test_canonical():
    tok, val = D.canonical('Anna ran 5 km. Then Bob, 12kg heavy, said: "Three miles!"\nNext line TV')
    assert tok == ["anna", "ran", "<num>", "<unit>", "then", "<name>", "<num>", "<unit>", "heavy", "said", "<num>", "<unit>",
                   "next", "line", "tv"]
    assert val[2:4] == ["5", "km"] and val[5:8] == ["bob", "12", "kg"]


def test_template_hashes_equal_canonical():
    rng = random.Random(8)
    bits = ["the", "Anna", "5", "km", "5km", "***", ".", "!", "end.", "(Bob)", "NASA", "\n", "\n\n", "three", "hours", "|", "x.***", "3.5", "km"]
    texts = [" ".join(rng.choices(bits, k=rng.randint(0, 30))) for _ in range(300)] + [None, "", "\n", "5", "km"]
    h, first = D.template_hashes(texts, D.Vocabulary())
    for d, t in enumerate(texts):
        want = [xxhash.xxh3_64_intdigest(x) for x in D.canonical(t)[0]]
        assert h[first[d]:first[d + 1]].tolist() == want, repr(t)


def test_reparameterised_questions_and_slots(frame, spark):
    bench = spark.createDataFrame([(7, ITEM), (8, None), (9, ""), (10, "the sea is blue today")], "item_id long, text string")
    pad = "some other words stand here to make this text longer than the question itself "
    docs = [(1, pad + ITEM + " " + pad), (2, pad + AGAIN), (3, pad + WRONG), (4, pad * 50), (5, None), (6, ""),
            (7, "he says the sea is blue today and so on"), (8, "the sea is blue"), (9, (pad * 3000) + AGAIN), (None, ITEM),
            (1, pad + ITEM + " " + pad), (11, ITEM.split(" and ")[0])]
    got = {}
    for r in D.report(frame(docs), bench).collect():
        got.setdefault(r.doc_id, []).append((r.contaminated, list(r.items)))
    assert got[1] == [(True, [7])] * 2 and got[2] == [(True, [7])] and got[9] == [(True, [7])] and got[None] == [(True, [7])]
    assert got[7] == [(True, [10])]
    for i in (4, 5, 6, 8, 11):
        assert got[i] == [(False, [])], i
    kept = [r.doc_id for r in D.clean(frame(docs), bench).collect()]
    assert sorted(kept) == sorted(i for i in (r[0] for r in docs) if i is not None and not got[i][0][0])


def test_slots_must_correspond():
    a, b = D.canonical("see Anna meet Bob and Anna"), D.canonical("see Carl meet Dora and Carl")
    c = D.canonical("see Carl meet Dora and Dora")
    assert D.consistent(*a, *b) and not D.consistent(*a, *c)


def test_brute_force(frame, spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)] + ["Tom", "Eva", "4", "17"]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(3, 25)))) for i in range(12)]
    docs = []
    for d in range(80):
        w = rng.choices(words, k=40)
        if d % 3 == 0:
            part = rng.choice(items)[1].split()
            p, q = sorted((rng.randrange(len(part) + 1), rng.randrange(len(part) + 1)))
            w[10:10] = part[p:q] if d % 2 else part
        docs.append((d, " ".join(w)))
    got = {(r.doc_id, r.item): r.covered for r in D.matches(frame(docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for d, t in docs:
        tok, val = D.canonical(t)
        for i, x in items:
            it, iv = D.canonical(x)
            k, seen = min(D.WINDOW, len(it)), set()
            for a in range(len(it) - k + 1):
                if sum(y not in D._TYPED for y in it[a:a + k]) >= D.MIN_PLAIN and any(
                        D.consistent(tok[p:p + k], val[p:p + k], it[a:a + k], iv[a:a + k]) for p in range(len(tok) - k + 1)):
                    seen |= set(range(a, a + k))
            if seen and len(seen) >= min(D.MIN_TOKENS, len(it)):
                want[d, i] = len(seen)
    assert got == want and want


def test_slot_dense_items(frame, spark):
    names = "cities are Oslo Bern Rome Kiev Riga Lima Cairo Quito Tunis Sofia Minsk Accra Hanoi Seoul"
    table = " ".join(str(7 * i + 3) for i in range(20))
    edge = "see Anna Bob Carl 5 6 then comes the end"                   # 10 tokens, its first window has 3 words
    short = "meet Anna Bob Carl"
    bench = spark.createDataFrame([(1, names), (2, table), (3, edge), (4, short), (5, "Yes"), (6, "4 5")],
                                  "item_id long, text string")
    pad = "some words that stand around it "
    docs = [(1, pad + names + " " + pad), (2, pad + table), (3, pad + edge + " " + pad), (4, pad + short), (5, "yes."),
            (6, "4 5"), (7, pad + names.replace("Oslo", "Wien").replace("Cairo", "Delhi").replace("Minsk", "Paris")),
            (8, pad + " ".join(str(7 * i + 4) for i in range(20))), (9, "yes they had 4 5 times " + pad),
            (10, pad + edge.replace("Anna", "Eva").replace("5", "8") + " " + pad), (11, "meet Anna Bob Eva")]
    got = {r.doc_id: list(r.items) for r in D.report(frame(docs), bench).collect()}
    assert got == {1: [1], 2: [2], 3: [3], 4: [4], 5: [5], 6: [6], 7: [], 8: [], 9: [], 10: [3], 11: []}


def test_rows_of_equal_or_null_id_are_judged_one_by_one(frame, spark):
    item = "the old miller carries seven sacks of white flour over the wooden bridge before the rain begins"
    words = item.split()
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    first, second = "x y z " + " ".join(words[:8]) + " a b c", "p q r " + " ".join(words[-8:]) + " d e f"
    docs = [(i, t) for i in (None, 4) for t in (first, second, "nothing of it stands here", None)] + [(None, item), (4, item), (4, item)]
    rows = sorted(((r.doc_id, r.contaminated) for r in D.report(frame(docs), bench).collect()), key=str)
    assert rows == sorted([(None, False)] * 4 + [(4, False)] * 4 + [(None, True)] + [(4, True)] * 2, key=str)
    kept = [(r.doc_id, r.text) for r in D.clean(frame(docs), bench).collect()]
    assert sorted(kept, key=str) == sorted(docs[:8], key=str)


def test_empty_tables(frame, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.report(frame([]), none).count() == 0
    assert [r.contaminated for r in D.report(frame([(1, ITEM)]), none).collect()] == [False]


def test_a_benchmark_of_several_parts(frame, spark, monkeypatch):
    rng = random.Random(6)
    words = [f"{a}{b}" for a in ("ba", "ko", "li", "mu", "re") for b in ("den", "fin", "gos", "tar", "vel", "zum")]
    items = [(i, " ".join(rng.choices(words, k=20))) for i in range(30)]
    docs = [(i, " ".join([*rng.choices(words, k=30), *(items[i % 30][1].split() if i % 3 == 0 else []), *rng.choices(words, k=30)]))
            for i in range(60)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    pick = ["doc_id", "contaminated", "items", "covered"]
    whole = sorted(D.report(frame(docs), benchmark).select(pick).collect())
    assert [r.doc_id for r in whole if r.contaminated] == [i for i in range(60) if i % 3 == 0]
    monkeypatch.setattr(D, "PART_WINDOWS", 90)
    assert sorted(D.report(frame(docs), benchmark).select(pick).collect()) == whole
