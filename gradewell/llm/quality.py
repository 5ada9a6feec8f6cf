"""Weak supervision of document quality (DataFrame functions only).

Rules look at counts of a text and vote good (1), bad (0) or abstain (null).
The votes of all documents are counted by pattern (at most 3^rules rows), and
expectation-maximisation over that table, as one aggregate an iteration,
estimates the share of good documents and every rule's probability of each
vote given the hidden class. A document is kept when the posterior
probability of "good", given its votes and the fitted rates, is at least 0.5
and the base filter lets it pass. No rule has a veto.

Nulls and ties: a null or empty text has no words and fails the base filter;
equal texts get equal votes. With no documents the result is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell.llm.blocks import checkpointed
from gradewell.llm.mixing import SPACES

#: name, measure (of the columns below), good if, bad if; else the rule abstains. Signs of
#: junk speak only against a text: their absence is no vote, or many of them would outvote the one that sees it.
RULES = [
    ("symbols", "n_symbols / greatest(word_chars, 1)", None, ">= 0.1"),
    ("capitals", "n_capitals / greatest(word_chars, 1)", None, ">= 0.4"),
    ("shouting", "n_shouts / greatest(n_words, 1)", None, ">= 0.25"),
    ("cells", "n_cells / greatest(n_words, 1)", None, ">= 0.1"),
    ("same_lines", "n_dup_lines / greatest(n_lines, 1)", None, ">= 0.5"),
    ("stutter", "n_stutters / greatest(n_words, 1)", None, ">= 0.2"),
    ("repeats", "n_repeat_words / greatest(n_words, 1)", "<= 0.15", ">= 0.4"),
    ("plain", "n_plain / greatest(n_words, 1)", ">= 0.85", "<= 0.5"),
]
#: A word of letters or digits with usual punctuation.
PLAIN = r"""^["'(]?[\p{L}\p{M}\p{N}'-]+[.,;:?!]?["')]?$"""
ITERATIONS = 12
MIN_WORDS = 50
#: Start of the iteration: share of good documents; chance of the right vote, given that a rule votes.
PRIOR, RIGHT = 0.8, 0.8


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """The counts the rules look at, one row per document. Repeats are found in
    the document's own arrays: trigram hashes are sorted with their positions,
    equal neighbours mark repeated windows, and the union of the marked windows
    is counted from the gaps between their positions."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"),
                    *[F.col(c).alias(f"_{c}") for c in carry])
    d = d.withColumn("flat", F.trim("t", F.lit(SPACES)))
    d = d.withColumn("w", F.when(F.col("flat") == "", F.expr("cast(array() as array<string>)"))
                     .otherwise(F.split("flat", f"[{SPACES}]+")))
    d = d.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: F.trim(x, F.lit(SPACES)) != ""))
    d = d.withColumn("solid", F.regexp_replace("flat", f"[{SPACES}]+", "")).select(
        "doc_id", *[f"_{c}" for c in carry], F.size("w").cast("long").alias("n_words"), F.length("solid").cast("long").alias("word_chars"),
        F.length(F.regexp_replace("solid", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("solid", r"[^|]+", "")).cast("long").alias("n_cells"),
        F.length(F.regexp_replace("solid", r"[^!]+", "")).cast("long").alias("n_shouts"),
        F.length(F.regexp_replace("solid", r"\P{Lu}+", "")).cast("long").alias("n_capitals"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("w", lambda x: x.rlike(PLAIN))).cast("long").alias("n_plain"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    n = F.greatest(F.size("h"), F.lit(1))
    d = d.withColumn("pair", F.zip_with("h", F.slice("h", F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    d = d.withColumn("n_stutters", F.size(F.filter("pair", lambda p: p["a"] == p["b"])).cast("long")).drop("pair")
    # position k holds the hash of words k, k+1, k+2
    d = d.withColumn("tri", F.slice(F.zip_with(
        F.zip_with("h", F.slice("h", F.lit(2), n), lambda a, b: F.xxhash64(a, b)),
        F.slice("h", F.lit(3), n), lambda ab, c: F.xxhash64(ab, c)), F.lit(1), F.greatest(F.size("h") - 2, F.lit(0))))
    d = d.drop("h").withColumn("some", F.size(F.array_distinct("tri")) < F.size("tri"))
    d = d.withColumn("s", F.when(F.col("some"), F.sort_array(F.transform(
        "tri", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))).drop("tri")
    d = d.withColumn("e", F.when(F.col("some"), F.zip_with(
        "s", F.slice("s", F.lit(2), F.greatest(F.size("s"), F.lit(1))),
        lambda a, b: F.struct(a["i"].alias("i"), F.coalesce(a["x"] == b["x"], F.lit(False)).alias("same"))))).drop("s")
    d = d.withColumn("p", F.when(F.col("some"), F.sort_array(F.transform(F.filter(F.zip_with(
        "e", F.concat(F.array(F.lit(False)), F.transform("e", lambda x: x["same"])),
        lambda a, before: F.struct(a["i"].alias("i"), (a["same"] | before).alias("twice"))),
        lambda x: x["i"].isNotNull() & x["twice"]), lambda x: x["i"])))).drop("e")
    gaps = F.zip_with("p", F.slice("p", F.lit(2), F.greatest(F.size("p"), F.lit(1))),
                      lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
    return d.withColumn("n_repeat_words", F.when(F.col("some"), F.aggregate(
        gaps, F.lit(0), lambda acc, x: acc + x)).otherwise(0).cast("long")).drop("p", "some")


def vote(measure: str, good: str | None, bad: str | None) -> Column:
    v = F.when(F.expr(f"{measure} {bad}"), F.lit(0)) if bad else F.when(F.lit(False), F.lit(0))
    return v.when(F.expr(f"{measure} {good}"), F.lit(1)) if good else v


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def posterior(rates: list[tuple[float, list[float]]], names: list[str]) -> Column:
    """P(good | votes): ``rates`` holds, for bad and good, the class share and
    for every rule the probabilities of the votes 0 and 1 (the rest: none)."""
    like = []
    for share, p in rates:
        c = F.lit(float(share))
        for j, name in enumerate(names):
            p0, p1 = p[2 * j], p[2 * j + 1]
            c = c * F.when(F.col(name) == 1, F.lit(p1)).when(F.col(name) == 0, F.lit(p0)).otherwise(F.lit(1.0 - p0 - p1))
        like.append(c)
    return like[1] / (like[0] + like[1])


def fit(votes: DataFrame, names: list[str], iterations: int = ITERATIONS) -> list[tuple[float, list[float]]]:
    """Class shares and vote rates by expectation-maximisation over the counted
    vote patterns; counts are smoothed by one."""
    patterns = checkpointed(votes.groupBy(*names).agg(F.count(F.lit(1)).alias("n")))
    rates = [(1 - PRIOR, [v for _ in names for v in (RIGHT / 2, (1 - RIGHT) / 2)]),
             (PRIOR, [v for _ in names for v in ((1 - RIGHT) / 2, RIGHT / 2)])]
    for _ in range(iterations):
        good = patterns.withColumn("good", F.col("n") * posterior(rates, names))
        good = good.withColumn("bad", F.col("n") - F.col("good"))
        r = good.agg(*[F.sum(c).alias(c) for c in ("bad", "good")],
                     *[F.sum(F.when(F.col(m) == v, F.col(c)).otherwise(0.0)).alias(f"{c}_{m}_{v}")
                       for c in ("bad", "good") for m in names for v in (0, 1)]).first()
        if r["good"] is None:
            return rates
        total = r["bad"] + r["good"]
        rates = [((r[c] + 1) / (total + 2), [(r[f"{c}_{m}_{v}"] + 1) / (r[c] + 3) for m in names for v in (0, 1)])
                 for c in ("bad", "good")]
    return rates


def _voted(docs: DataFrame, id_col: str, text_col: str, rules, carry: tuple[str, ...] = ()) -> DataFrame:
    m = measures(docs, id_col, text_col, carry)
    return m.select("*", *[vote(*r[1:]).alias(f"vote_{r[0]}") for r in rules])


def _judged(voted: DataFrame, rates, rules) -> DataFrame:
    return (voted.withColumn("p_good", posterior(rates, [f"vote_{r[0]}" for r in rules]))
            .withColumn("base_failed", base_failed())
            .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5)))


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=None,
           iterations: int = ITERATIONS) -> DataFrame:
    """Counts, votes, the posterior ``p_good``, ``base_failed`` and ``kept`` of every document."""
    rules = rules or RULES
    voted = checkpointed(_voted(docs, id_col, text_col, rules))
    return _judged(voted, fit(voted, [f"vote_{r[0]}" for r in rules], iterations), rules)


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=None,
         iterations: int = ITERATIONS) -> DataFrame:
    """The documents that are kept, with all their columns: one pass for the
    vote patterns, one to judge, and no text is shuffled or stored between."""
    rules = rules or RULES
    rates = fit(_voted(docs, id_col, text_col, rules), [f"vote_{r[0]}" for r in rules], iterations)
    voted = _voted(docs, id_col, text_col, rules, tuple(docs.columns))
    # a filter moves below projections it can, and would have every count evaluated once more for each mention;
    # it does not move below a column that differs from row to row
    voted = voted.withColumn("row", F.monotonically_increasing_id())
    return _judged(voted, rates, rules).filter("kept and row >= 0").select(*[F.col(f"_{c}").alias(c) for c in docs.columns])
