import random

import pytest

from test_jaccard_join import brute as groups

corpus_pipeline = pytest.importorskip("corpus_pipeline")

ITEM = ("a farmer sells twelve baskets of ripe plums at the village market and keeps the other baskets for the winter "
        "how many baskets are left when spring comes")


def write(spark, folder):
    rng = random.Random(3)
    vocab = [f"{a}{b}" for a in "bcdfghlmnprst" for b in ("a", "e", "in", "or", "us", "am")]

    def prose(n=70):
        return " ".join(rng.choices(vocab, k=n)) + "."
    rows = [(i, prose()) for i in range(60)]
    rows += [(100 + i, " ".join(w + "***" for w in prose().split())) for i in range(10)]       # junk
    near = rows[5][1].split()
    rows += [(200, rows[3][1]), (201, rows[3][1]), (202, " ".join(near[:-1] + ["other"]))]       # copies
    rows += [(300, prose(40) + " " + ITEM + " " + prose(40))]                                    # leak
    rows += [(400, None), (401, ""), (3, rows[3][1])]
    df = spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows],
                               "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows


def test_stages_and_run(spark, tmp_path):
    rows = write(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        kept[name] = docs
        if name != "shards":
            assert docs.columns == columns
    def ids(name): return sorted(r.doc_id for r in kept[name].collect())
    clean = sorted(i for i, _ in rows if i < 60)
    assert ids("quality") == sorted([*clean, 200, 201, 202, 300])
    roots = groups([(r.doc_id, r.text) for r in kept["quality"].collect()])
    assert ids("dedup") == sorted({i for i, _, c in roots if i == c}) == sorted([*range(60), 300])
    assert ids("decontaminate") == list(range(60))
    mixed = ids("mix")
    assert set(mixed) <= set(range(60)) and max(map(mixed.count, set(mixed))) <= 2
    shards = kept["shards"].collect()
    assert sorted(r.slot for r in shards) == list(range(len(shards)))
    assert sorted(r.doc_id for r in shards if r.part == 0) == mixed
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.slot, r.doc_id, r.part, r.content) for r in whole) == sorted((r.slot, r.doc_id, r.part, r.content) for r in shards)


def test_dedup_judges_texts_of_one_id_by_themselves(spark):
    rng = random.Random(11)
    a, b, c = (" ".join(f"{rng.choice('bdfgk')}{rng.randrange(900)}" for _ in range(60)) for _ in range(3))
    near = " ".join(c.split()[:-1] + ["other"])
    rows = [(1, a), (1, b), (1, a), (2, c), (5, near), (5, "a text of its own that no other row repeats at all"), (7, b),
            (8, ""), (8, None), (None, a), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted([(1, a), (1, b), (2, c), rows[5], (None, a), (None, a)], key=str)
    for parts in (1, 4):
        got = [(r.doc_id, r.text) for r in corpus_pipeline.dedup(spark, docs.repartition(parts), "").collect()]
        assert sorted((r for r in got if r[0] != 8), key=str) == want
        assert sum(r[0] == 8 for r in got) == 1


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
