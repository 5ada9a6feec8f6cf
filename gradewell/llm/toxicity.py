"""Toxicity scores from misspelling-tolerant lexicon hits and their context.

The lexicon is learned: of a bounded sample of labelled documents, words and word
beginnings that toxic documents hold and clean ones do not become terms (whole
words) or stems (any ending); equal texts count once. Nothing but the sample bounds
their number. ``GROUP`` terms at a time form a trie; a Levenshtein automaton per
allowed number of edits is intersected with the trie, and the product is made
deterministic once, on the driver (its size is bounded by the group's). Tasks
run each over all words of a batch at once, one table look-up a letter, so every
word, and every word within one edit (two from nine letters on, none below four; stems one
less, those below six letters only as whole words) is found without comparing it with each term.
Terms of more than ``MAX_LETTERS`` letters are looked up as they are, without edits; such words
are also found by their beginnings of up to ``MAX_LETTERS`` letters, which are terms like others.

Each hit carries evidence, halved per edit (quartered in terms below five letters). Its context window of ``WINDOW`` words on either
side tells quotation (quotation marks, reporting words) from abuse and puts the
evidence in one of two sums. A logistic model of both sums and their density,
fitted on the same sample, turns them into a score in [0, 1]. Labels, language,
source and id are never inputs of a score.

Nulls and ties: a null or empty text has no hits and gets the score of such
texts; labelled rows whose document is missing or whose label is null are not
learned from; repeated labels of one id count once each. Without usable labels
the lexicon is empty and the score is the smoothed base rate.
"""

from __future__ import annotations

import json
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.llm import blocks as B

#: Labelled rows the lexicon and the model are fitted on, at most (the smallest by a hash of the id).
SAMPLE = 20_000
GROUP = 200             # terms of one automaton
MIN_DOCS = 4            # toxic texts that hold a term, at least
PURITY = 0.8            # share of toxic ones among the documents that hold it and one more, at least
MIN_LETTERS, MAX_LETTERS = 4, 24      # of a beginning; shorter and longer words are terms as a whole
WINDOW = 5
#: Signs of quotation near a hit (fixed list).
QUOTES = "\"“”„«»‹›‘’"
REPORTING = {"said", "says", "called", "calls", "quote", "quoted", "word", "term", "sagte", "nannte", "wort",
             "dit", "appelé", "mot", "dijo", "llamó", "palabra"}

_LETTER = np.zeros(0x10000, bool)


def _letters() -> np.ndarray:
    """Code points of the basic plane that words are made of; the rest separate."""
    if not _LETTER.any():
        _LETTER[:] = [chr(c).isalnum() for c in range(0x10000)]
    return _LETTER


def tokenize(texts: list[str]):
    """Lower-cased code points of all texts, and the words' spans and documents."""
    low = [t.lower() for t in texts]
    chars = np.frombuffer("\n".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    solid = np.concatenate(([False], _letters()[np.minimum(chars, 0xFFFF)] | (chars > 0xFFFF), [False]))
    edge = np.flatnonzero(np.diff(solid.view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    begin = np.cumsum([0] + [len(t) + 1 for t in low])
    return chars, starts, ends, np.searchsorted(begin, starts, side="right") - 1


# ------------------------------------------------------------ lexicon

def _forms(batches):
    """(form, toxic documents, clean documents) holding a word beginning ("^...") or a whole word."""
    for t in batches:
        count: dict[str, list[int]] = {}
        for text, toxic in zip(t.column("text").to_pylist(), t.column("toxic").to_pylist()):
            chars, starts, ends, _ = tokenize([text or ""])
            body = chars.tobytes().decode("utf-32-le", "surrogatepass")
            forms = set()
            for a, b in zip(starts.tolist(), ends.tolist()):
                forms.add(body[a:b])
            forms |= {"^" + w[:m] for w in list(forms) for m in range(MIN_LETTERS, min(len(w), MAX_LETTERS) + 1)}
            for f in forms:
                count.setdefault(f, [0, 0])[0 if toxic else 1] += 1
        if count:
            yield pa.RecordBatch.from_arrays([pa.array(list(count)), pa.array([v[0] for v in count.values()]),
                                              pa.array([v[1] for v in count.values()])], names=["form", "tox", "clean"])


def learn_lexicon(sample: DataFrame) -> list[tuple[str, bool, float]]:
    """(term, is a stem, evidence) of a (text, toxic) sample. Equal texts count
    once: words are not pure because one toxic text was copied."""
    share = F.col("tox") / (F.col("tox") + F.col("clean") + 1)
    forms = B.checkpointed(sample.dropDuplicates(["text", "toxic"]).mapInArrow(
        _forms, "form string, tox long, clean long").groupBy("form").agg(
        F.sum("tox").alias("tox"), F.sum("clean").alias("clean")).withColumn("share", share).filter(
        (F.col("tox") >= MIN_DOCS) & (F.col("share") >= PURITY)))
    # a beginning that stands in the same texts as a longer one says nothing of its own
    shorter = forms.filter(F.col("form").startswith("^")).select(
        F.expr("substring(form, 1, length(form) - 1)").alias("form"), "tox", "clean")
    rows = forms.join(shorter, ["form", "tox", "clean"], "left_anti").collect()      # bounded by the sample
    tox = {r.form: r.tox for r in rows}
    share_of = {r.form: r.share for r in rows}
    ordered = sorted(f for f in tox if f[0] == "^")
    terms: dict[str, bool] = {}
    covered: dict[str, int] = {}         # toxic texts of the terms that begin so
    for form in sorted(ordered, key=lambda f: (-tox[f], len(f), f)):
        stem = form[1:]
        if any(stem[:m] in terms for m in range(1, len(stem) + 1)) or covered.get(stem, 0) >= 0.5 * tox[form]:
            continue
        while True:                      # the longest beginning that still covers what this one covers
            longer, at = [], bisect_right(ordered, "^" + stem)
            while at < len(ordered) and ordered[at].startswith("^" + stem):
                if tox[ordered[at]] >= 0.9 * tox[form]:
                    longer.append(ordered[at][1:])
                at += 1
            if not longer:
                break
            stem = max(longer, key=lambda f: (tox["^" + f], -len(f), f))
        terms[stem] = tox.get(stem, 0) < 0.9 * tox["^" + stem]
        for m in range(1, len(stem) + 1):
            covered[stem[:m]] = covered.get(stem[:m], 0) + tox["^" + stem]
    out = [(t, stem, float(share_of["^" + t])) for t, stem in terms.items()]
    out += [(t, False, e) for t, stem, e in out if stem and not edits_allowed(t, True)]   # misspelt as a whole word
    short = sorted((f for f in tox if f[0] != "^" and len(f) < MIN_LETTERS), key=lambda f: (-tox[f], f))
    # whole words too long for an automaton, where no stem stands for them
    stems = {t for t, stem, _ in out if stem}
    long = sorted((f for f in tox if f[0] != "^" and len(f) > MAX_LETTERS
                   and not any(f[:m] in stems for m in range(1, MAX_LETTERS + 1))), key=lambda f: (-tox[f], f))
    return out + [(f, False, float(share_of[f])) for f in short + long]


def edits_allowed(term: str, stem: bool) -> int:
    n = len(term)
    if stem:
        return 0 if n < 6 else 1 if n < 12 else 2
    return 0 if n < MIN_LETTERS else 1 if n < 9 else 2


def evidence(term: str, share: float, edits: int) -> float:
    return share * (0.5 if len(term) > 4 else 0.25) ** edits


class Automaton:
    """The lexicon trie intersected with Levenshtein automata, as one table.

    ``step[state, letter class]`` is the next state; ``term[state]`` and
    ``edits[state]`` tell what a word that ends there is (-1: nothing)."""

    def __init__(self, terms: list[tuple[str, bool, float]]):
        self.terms = terms
        letters = sorted({c for t, _, _ in terms for c in t})
        self.classes = np.zeros(0x10000, np.int32)          # 0: a letter no term has
        self.high = np.array([ord(c) for c in letters if ord(c) > 0xFFFF], np.uint32)     # the last letters, in order
        self.first_high = len(letters) - len(self.high) + 1
        for j, c in enumerate(letters[:self.first_high - 1]):
            self.classes[ord(c)] = j + 1
        children: list[dict[int, int]] = [{}]
        ends: list[int] = [-1]
        most: list[int] = [0]
        for j, (t, stem, _) in enumerate(terms):
            node, k = 0, edits_allowed(t, stem)
            most[0] = max(most[0], k)
            for c in t:
                nxt = children[node].get(letters.index(c) + 1)
                if nxt is None:
                    nxt = len(children)
                    children.append({})
                    ends.append(-1)
                    most.append(0)
                    children[node][letters.index(c) + 1] = nxt
                node = nxt
                most[node] = max(most[node], k)
            ends[node] = j

        def close(states: dict[int, int]) -> frozenset:
            """With letters of the term left out; the fewest edits by node."""
            todo = list(states.items())
            while todo:
                node, e = todo.pop()
                for nxt in children[node].values():
                    if e < most[nxt] and e + 1 < states.get(nxt, 99):
                        states[nxt] = e + 1
                        todo.append((nxt, e + 1))
            return frozenset(states.items())

        def best(states) -> tuple[int, int]:
            found = [(e, ends[node]) for node, e in states if node >= 0 and ends[node] >= 0
                     and e <= edits_allowed(*terms[ends[node]][:2])]
            e, j = min(found, default=(0, -1))
            return j, e

        self.step, self.term, self.edits = [], [], []
        index: dict = {}

        def state(key, held) -> int:
            if key not in index:
                index[key] = len(self.step)
                self.step.append(None)
                todo.append((key, held))
                j, e = held
                self.term.append(j)
                self.edits.append(e)
            return index[key]
        todo: list = []
        state((frozenset(), -1, 0), (-1, 0))                                   # dead
        start = close({0: 0})
        self.start = state((start, -1, 0), (-1, 0))
        while todo:
            (nfa, stem_term, stem_edits), _ = todo.pop()
            row = []
            for c in range(len(letters) + 1):
                nxt: dict[int, int] = {}
                for node, e in nfa:
                    if e < most[node]:                                          # an extra letter
                        nxt[node] = min(nxt.get(node, 99), e + 1)
                    for letter, child in children[node].items():
                        f = e if letter == c else e + 1
                        if f <= most[child]:
                            nxt[child] = min(nxt.get(child, 99), f)
                done = close(nxt) if nxt else frozenset()
                j, e = best(done)
                s_term, s_edits = stem_term, stem_edits
                if j >= 0 and terms[j][1] and (s_term < 0 or e < s_edits):      # a stem: any ending follows
                    s_term, s_edits = j, e
                if s_term >= 0 and (j < 0 or s_edits <= e):
                    j, e = s_term, s_edits
                row.append(state((done, s_term, s_edits), (j, e)))
            self.step[index[(nfa, stem_term, stem_edits)]] = row
        self.step = np.array(self.step, np.int32)
        self.term, self.edits = np.array(self.term), np.array(self.edits)

    def run(self, chars, starts, ends) -> np.ndarray:
        """The state each word ends in."""
        state = np.full(len(starts), self.start, np.int32)
        live = np.arange(len(starts))
        cls = self.classes[np.minimum(chars, 0xFFFF)]       # U+FFFF is no letter
        if len(self.high):
            beyond = np.flatnonzero(chars > 0xFFFF)
            j = np.minimum(np.searchsorted(self.high, chars[beyond]), len(self.high) - 1)
            cls[beyond] = np.where(self.high[j] == chars[beyond], self.first_high + j, 0)
        at = starts.copy()
        while len(live):
            state[live] = self.step[state[live], cls[at[live]]]
            at[live] += 1
            live = live[(at[live] < ends[live]) & (state[live] != 0)]
        return state


class Lexicon:
    """All terms, ``GROUP`` an automaton; a term that stands there both as a
    stem and as a whole word goes to two of them."""

    def __init__(self, terms: list[tuple[str, bool, float]]):
        self.terms = terms
        self.parts: list[tuple[np.ndarray, Automaton]] = []
        self.long = {t: j for j, (t, _, _) in enumerate(terms) if len(t) > MAX_LETTERS}
        group: dict[str, int] = {}
        for j, (t, _, _) in enumerate(terms):
            if t in self.long:
                continue
            if t in group or len(group) == GROUP:
                self._add(group)
                group = {}
            group[t] = j
        self._add(group)

    def _add(self, group: dict[str, int]) -> None:
        if group:
            numbers = np.array(list(group.values()))
            self.parts.append((numbers, Automaton([self.terms[j] for j in numbers.tolist()])))

    def find(self, chars, starts, ends) -> tuple[np.ndarray, np.ndarray]:
        """Each word's term of fewest edits (-1: none) and their number."""
        term, edits = np.full(len(starts), -1), np.full(len(starts), 99)
        for numbers, auto in self.parts:
            state = auto.run(chars, starts, ends)
            better = np.flatnonzero((auto.term[state] >= 0) & (auto.edits[state] < edits))
            term[better], edits[better] = numbers[auto.term[state[better]]], auto.edits[state[better]]
        for i in np.flatnonzero(ends - starts > MAX_LETTERS).tolist() if self.long else ():
            j = self.long.get(chars[starts[i]:ends[i]].tobytes().decode("utf-32-le", "surrogatepass"))
            if j is not None:
                term[i], edits[i] = j, 0
        return term, edits


# ------------------------------------------------------------ features and model

def _evidence(texts: list[str], lexicon: Lexicon, details: bool = False):
    """Per text: evidence of abuse, of quotation, words; and the hits themselves."""
    chars, starts, ends, doc = tokenize(texts)
    n = np.bincount(doc, minlength=len(texts)).astype(float)
    out = np.zeros((len(texts), 3))
    out[:, 2] = n
    hits: list[list[dict]] = [[] for _ in texts] if details else []
    term, edits = lexicon.find(chars, starts, ends)
    for i in np.flatnonzero(term >= 0).tolist():
        d, j, e = int(doc[i]), int(term[i]), int(edits[i])
        lo, hi = i, i
        while lo > 0 and doc[lo - 1] == d and i - lo < WINDOW:
            lo -= 1
        while hi + 1 < len(doc) and doc[hi + 1] == d and hi - i < WINDOW:
            hi += 1
        around = chars[starts[lo]:ends[hi]].tobytes().decode("utf-32-le", "surrogatepass")
        near = chars[max(starts[i] - 2, 0):ends[i] + 2].tobytes().decode("utf-32-le", "surrogatepass")
        marks = sum(c in QUOTES for c in near) + any(
            chars[starts[k]:ends[k]].tobytes().decode("utf-32-le", "surrogatepass") in REPORTING for k in range(lo, hi + 1))
        weight = evidence(lexicon.terms[j][0], lexicon.terms[j][2], e)
        quoted = marks >= 2 or (marks == 1 and any(c in QUOTES for c in around))
        out[d, 1 if quoted else 0] += weight
        if details:
            hits[d].append({"term": lexicon.terms[j][0], "edits": e, "quoted": quoted, "context": around})
    return (out, hits) if details else out


def _inputs(ev: np.ndarray) -> np.ndarray:
    """Model inputs: intercept, saturated sums, density of abuse."""
    return np.column_stack([np.ones(len(ev)), np.minimum(ev[:, 0], 2.0), np.minimum(ev[:, 1], 2.0),
                            np.minimum(50 * ev[:, 0] / np.maximum(ev[:, 2], 20), 2.0)])


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-3] + [0.02] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge @ w
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, grad)
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", sample: int = SAMPLE):
    """(lexicon, weights) from at most ``sample`` labelled documents."""
    chosen = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).filter(
        "doc_id is not null and toxic in (0, 1)").orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = d.join(F.broadcast(chosen), "doc_id").select("text", "toxic")      # at most ``sample`` rows of two numbers
    auto = Lexicon(learn_lexicon(rows))

    def features(batches):
        for t in batches:
            ev = _evidence([x or "" for x in t.column("text").to_pylist()], auto)
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in ev.T), t.column("toxic")], names=["a", "q", "n", "y"])
    got = rows.mapInArrow(features, "a double, q double, n double, y int").groupBy("a", "q", "n", "y").agg(
        F.count(F.lit(1)).alias("m")).collect()                               # bounded by the sample
    if not got:
        return auto, np.array([0.0, 0, 0, 0])
    x = np.repeat(np.array([[r.a, r.q, r.n] for r in got]), [r.m for r in got], axis=0)
    return auto, _fit(_inputs(x), np.repeat([r.y for r in got], [r.m for r in got]).astype(float))


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, hits) of every document; hits: JSON list of term, edits, quoted, context."""
    auto, w = model

    def run(batches):
        for t in batches:
            for lo in range(0, t.num_rows, 512):
                part = t.slice(lo, 512)
                ev, hits = _evidence([x or "" for x in part.column("text").to_pylist()], auto, details=True)
                p = 1 / (1 + np.exp(-np.clip(_inputs(ev) @ w, -30, 30)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(p), pa.array([json.dumps(h, ensure_ascii=False) for h in hits])],
                    names=["doc_id", "score", "hits"])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, score double, hits string")
