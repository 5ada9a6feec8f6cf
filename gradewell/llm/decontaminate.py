"""Benchmark decontamination by template canonicalisation.

Texts become token sequences in which numbers, units and names are typed
placeholders (<num>, <unit>, <name>) and everything else is a lower-cased word
without the punctuation around it; the values behind the placeholders are kept. So a
question asked again with other numbers or names has the same template.

Windows of ``window`` template tokens are hashed. A document window that hits a
benchmark window is checked for slot consistency: the template tokens must be
equal (not only the hash), at least ``min_plain`` of them words, and the values
must correspond one to one: a value that fills two slots of the benchmark window
fills the same two slots of the document window, and different values stay
different. A window with fewer plain words (names, numbers) says too little as a
template and counts where its values are the same too: an exact copy. A document is
contaminated when windows of one item cover enough of that item: ``min_tokens``
tokens, or the whole item if it is shorter; of template windows alone, all tokens
that they can reach suffice if those are fewer.

The windows of a benchmark are a side of checked size: they are counted first
and, in parts of at most ``PART_WINDOWS`` (about 10 MB) each, sent to the tasks, one
pass over the documents a part; matches of all parts are summed by document and item. Documents
are never shuffled.

Nulls and ties: a null text has no tokens and is clean; a null or empty
benchmark text matches nothing; items shorter than a window are matched as
one window of their own length, and items of fewer than ``min_plain`` tokens (an answer
"yes" stands in many texts) only by a document that holds nothing else. A row is known
by its id and a 128-bit hash of its text, so rows of equal or null id are judged by
themselves and equal rows alike. Other columns are ignored.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell.llm import blocks as B

WINDOW = 8
MIN_TOKENS = 12
MIN_PLAIN = 4
PART_WINDOWS = 50_000
VOCABULARY = 1 << 19      # raw words a task remembers
KEY = ("doc_id", "text_a", "text_b")

#: Units of measure and money, lower case (fixed list).
UNITS = frozenset("""mm cm m km in inch inches ft feet foot yd yard yards mi mile miles mg g gram grams kg kilogram kilograms
t ton tons tonne tonnes oz ounce ounces lb lbs pound pounds ml l liter liters litre litres gallon gallons
s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years
km/h mph hz khz mhz ghz w kw watt watts v volt volts j joule joules n newton newtons pa c f k
usd eur dollar dollars euro euros cent cents percent""".split())
NUMBER_WORDS = frozenset("""zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen
sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million
billion""".split())
_EDGE = "\"'()[]{}<>.,;:!?*#$%&|…«»„“”‚‘’"
_TAIL = "\"')]»”’*#$%&|"
_DIGITS = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(?:\^\d+)?%?(?:st|nd|rd|th)?")
_JOINED = re.compile(r"([+-]?\d[\d.,]*)([a-z/]+)")
NUM, UNIT, NAME = "<num>", "<unit>", "<name>"
_TYPED = frozenset((NUM, UNIT, NAME))


def canonical(text: str | None) -> tuple[list[str], list[str]]:
    """(template tokens, values). A capitalised word is a name unless it begins
    a sentence or line, or the text around is all capitals."""
    tokens, values = [], []
    fresh = True                                     # at the beginning of a sentence
    before = ""
    for line in (text or "").split("\n"):
        fresh = True
        for raw in line.split():
            word = raw.strip(_EDGE)
            if not word:
                fresh = fresh or raw[-1] in ".!?"
                continue
            low = word.lower()
            if _DIGITS.fullmatch(low) or low in NUMBER_WORDS:
                t = NUM
            elif before == NUM and low in UNITS:
                t = UNIT
            elif (m := _JOINED.fullmatch(low)) and m[2] in UNITS:
                tokens.append(NUM)
                values.append(m[1])
                t, low = UNIT, m[2]
            elif not fresh and word[0].isupper() and word[1:] and not word[1:].isupper():
                t = NAME
            else:
                t = low
            tokens.append(t)
            values.append(low)
            before = t
            fresh = raw.rstrip(_TAIL)[-1:] in (".", "!", "?")
    return tokens, values


_HASH_OF = {t: xxhash.xxh3_64_intdigest(t) for t in _TYPED}


class Vocabulary(dict):
    """What can be said of a raw word by itself, looked up by number: its hash and flags."""
    EMPTY, NUMBER, UNIT, CAPITAL, ENDS, JOINED = 1, 2, 4, 8, 16, 32

    def __init__(self):
        self.hash, self.flag = array("Q"), bytearray()

    def __missing__(self, raw: str) -> int:
        word = raw.strip(_EDGE)
        low = word.lower()
        f = 0
        if not word:
            f = self.EMPTY | (self.ENDS if raw[-1] in ".!?" else 0)
        else:
            if _DIGITS.fullmatch(low) or low in NUMBER_WORDS:
                f |= self.NUMBER
            elif (m := _JOINED.fullmatch(low)) and m[2] in UNITS:
                f |= self.JOINED
            if low in UNITS:
                f |= self.UNIT
            if word[0].isupper() and word[1:] and not word[1:].isupper():
                f |= self.CAPITAL
            if raw.rstrip(_TAIL)[-1:] in (".", "!", "?"):
                f |= self.ENDS
        self.hash.append(xxhash.xxh3_64_intdigest(low))
        self.flag.append(f)
        self[raw] = len(self.flag) - 1
        return len(self.flag) - 1


def template_hashes(texts: list[str | None], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all template tokens, and where each text's begin."""
    h, _, first = token_hashes(texts, vocab)
    return h, first


def _hashes(tokens: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(t) for t in tokens], np.uint64)


def token_hashes(texts: list[str | None], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all template tokens, of their values, and where each text's
    begin: what ``canonical`` would give, found for all words at once."""
    V, codes, lines, docs = Vocabulary, [], [], [0]
    for text in texts:
        for line in (text or "").split("\n"):
            codes.extend(map(vocab.__getitem__, line.split()))
            lines.append(len(codes))
        docs.append(len(codes))
    codes = np.array(codes, np.int64)
    flag = np.array(vocab.flag, np.uint8)[codes]
    line = np.searchsorted(np.array(lines), np.arange(len(codes)), side="right")
    solid = np.flatnonzero((flag & V.EMPTY) == 0)
    nth = np.cumsum((flag & V.EMPTY) == 0) - 1
    f, line_of = flag[solid], line[solid]
    ends = (f & V.ENDS) > 0
    lone = np.flatnonzero((flag & V.EMPTY > 0) & (flag & V.ENDS > 0) & (nth >= 0))
    ends[nth[lone]] = True                        # a sentence mark standing alone
    fresh = np.ones(len(solid), bool)
    fresh[1:] = ends[:-1] | (line_of[1:] != line_of[:-1])
    first = np.searchsorted(solid, np.array(docs))
    number = (f & V.NUMBER) > 0
    after_number = np.zeros(len(solid), bool)
    after_number[1:] = number[:-1]
    after_number[first[:-1][first[:-1] < len(solid)]] = False
    unit = ~number & after_number & ((f & V.UNIT) > 0)
    name = ~number & ~unit & ~fresh & ((f & V.CAPITAL) > 0)
    raw = np.array(vocab.hash, np.uint64)[codes[solid]]
    h = raw.copy()
    for t, m in ((NUM, number), (UNIT, unit), (NAME, name)):
        h[m] = _HASH_OF[t]
    for d in np.unique(np.searchsorted(first, np.flatnonzero(f & V.JOINED), side="right") - 1)[::-1].tolist():
        own, own_raw = map(_hashes, canonical(texts[d]))      # "5km" is two tokens
        h = np.concatenate((h[:first[d]], own, h[first[d + 1]:]))
        raw = np.concatenate((raw[:first[d]], own_raw, raw[first[d + 1]:]))
        first = np.concatenate((first[:d + 1], first[d + 1:] + len(own) - (first[d + 1] - first[d])))
    return h, raw, first


def consistent(tokens: list[str], values: list[str], want_tokens: list[str], want_values: list[str]) -> bool:
    """Equal templates whose values correspond one to one."""
    if tokens != want_tokens:
        return False
    there, back = {}, {}
    for t, a, b in zip(tokens, values, want_values):
        if t in _TYPED and (there.setdefault((t, a), b) != b or back.setdefault((t, b), a) != a):
            return False
    return True


def _windows(items: DataFrame, item_col: str, text_col: str, window: int, min_plain: int) -> DataFrame:
    """The benchmark's windows: hash (of the values if ``exact``, else of the
    template), item, place, length, tokens of the item and of what its template
    windows reach, the window's tokens and values."""
    def cut(batches):
        for t in batches:
            rows = []
            for item, text in zip(t.column("item").to_pylist(), t.column("text").to_pylist()):
                tok, val = canonical(text)
                k = min(window, len(tok))
                if not k:
                    continue
                n = len(tok) - k + 1
                exact = [sum(y not in _TYPED for y in tok[i:i + k]) < min_plain for i in range(n)]
                reach = len({j for i in range(n) if not exact[i] for j in range(i, i + k)})
                by_template, by_value = (B.rolling(_hashes(x), k).view(np.int64).tolist() for x in (tok, val))
                for i in range(n):
                    rows.append((by_value[i] if exact[i] else by_template[i], item, i, k, len(tok), reach, exact[i],
                                 " ".join(tok[i:i + k]), " ".join(val[i:i + k])))
            cols = list(zip(*rows)) if rows else [()] * 9
            types = [pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.bool_(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                             names=["hash", "item", "at", "k", "n", "reach", "exact", "tokens", "values"])
    d = items.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("text"))
    return d.mapInArrow(cut, "hash long, item long, at int, k int, n int, reach int, exact boolean, tokens string, values string")


def _matcher(rows, min_plain: int):
    """Task function: documents' windows that match one part of the benchmark."""
    by_length: dict[tuple, list] = {}
    for r in rows:
        by_length.setdefault((r.k, r.exact), []).append(r)
    index = {}
    for kind, rs in by_length.items():
        rs.sort(key=lambda r: r.hash)
        keys = np.array([r.hash for r in rs], np.int64).view(np.uint64)
        order = np.argsort(keys, kind="stable")
        index[kind] = (keys[order], [(rs[i].item, rs[i].at, rs[i].n, rs[i].reach, rs[i].tokens.split(" "),
                                      rs[i].values.split(" ")) for i in order.tolist()])

    def match(batches):
        vocab = Vocabulary()
        for t in batches:
            for lo in range(0, t.num_rows, 512):
                part = t.slice(lo, 512)
                texts = part.column("text").to_pylist()
                if len(vocab) > VOCABULARY:
                    vocab = Vocabulary()
                h, raw, first = token_hashes(texts, vocab)
                out, both = {}, {}
                for (k, exact), (keys, what) in index.items():
                    at = B.window_starts(first, k) if k >= min_plain else first[:-1][np.diff(first) == k]
                    if not len(at):
                        continue
                    rolled = B.rolling(raw if exact else h, k)[at]
                    pos = np.searchsorted(keys, rolled)
                    hit = np.flatnonzero(keys[np.minimum(pos, len(keys) - 1)] == rolled)
                    for i in hit.tolist():
                        d = int(np.searchsorted(first, at[i], side="right")) - 1
                        a = int(at[i] - first[d])
                        if d not in both:
                            both[d] = canonical(texts[d])
                        tok, val = both[d][0][a:a + k], both[d][1][a:a + k]
                        p = int(pos[i])
                        while p < len(keys) and keys[p] == rolled[i]:
                            item, where, n, reach, want_tok, want_val = what[p]
                            if val == want_val if exact else consistent(tok, val, want_tok, want_val):
                                out.setdefault((d, item, n, reach, exact), set()).update(range(where, where + k))
                            p += 1
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(pa.array([o[0] for o in out], pa.int64())) for c in KEY),
                     pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int32()),
                     pa.array([o[3] for o in out], pa.int32()), pa.array([o[4] for o in out], pa.bool_()),
                     pa.array([sorted(v) for v in out.values()], pa.list_(pa.int32()))],
                    names=[*KEY, "item", "n", "reach", "exact", "covered"])
    return match


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """The columns ``KEY`` of a row: its id and two hashes of its text of different seeds."""
    text = docs[text_col].cast("string")
    return [docs[id_col].cast("long"), F.xxhash64(text), F.xxhash64(F.lit(1), text)]


def _same(left: list[Column], right: list[Column]) -> Column:
    return left[0].eqNullSafe(right[0]) & (left[1] == right[1]) & (left[2] == right[2])


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, min_tokens: int = MIN_TOKENS,
            min_plain: int = MIN_PLAIN) -> DataFrame:
    """(doc_id, text_a, text_b, item, covered, item_tokens) for every document,
    known by its id and the two hashes of its text, and benchmark item it repeats enough of."""
    spark = docs.sparkSession
    windows = B.checkpointed(_windows(benchmark, item_col, item_text, window, min_plain))
    parts = max(1, -(-windows.count() // PART_WINDOWS))
    d = docs.select(*(c.alias(k) for c, k in zip(_keyed(docs, id_col, text_col), KEY)), F.col(text_col).alias("text"))
    schema = "doc_id long, text_a long, text_b long, item long, n int, reach int, exact boolean, covered array<int>"
    found = spark.createDataFrame([], schema)
    for p in range(parts):
        rows = windows.filter(F.pmod(F.col("hash"), F.lit(parts)) == p).collect()      # about PART_WINDOWS
        if rows:
            part = d.mapInArrow(_matcher(rows, min_plain), schema)
            # of several parts each is run before the next one's windows are read: the driver holds one
            found = found.unionByName(part if parts == 1 else B.checkpointed(part))
    def tokens(of):
        return F.size(F.array_distinct(F.flatten(F.collect_list(of)))).cast("long")
    total = found.groupBy(*KEY, "item").agg(
        tokens(F.col("covered")).alias("covered"), F.max("n").cast("long").alias("item_tokens"),
        tokens(F.when(~F.col("exact"), F.col("covered"))).alias("by_template"), F.max("reach").alias("reach"))
    enough = (F.col("covered") >= F.least(F.lit(min_tokens), "item_tokens")) | (
        (F.col("by_template") > 0) & (F.col("by_template") >= F.least(F.lit(min_tokens), "reach")))
    return total.filter(enough).drop("by_template", "reach")


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, contaminated, n_items, items, covered) of every document; covered:
    tokens of the item repeated most."""
    hit = matches(docs, benchmark, id_col, text_col, **options).groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_items"), F.sort_array(F.collect_list("item")).alias("items"),
        F.max("covered").alias("covered"))
    hit = hit.select(*(F.col(k).alias(f"_{k}") for k in KEY), "n_items", "items", "covered")
    d = docs.select(*(c.alias(k) for c, k in zip(_keyed(docs, id_col, text_col), KEY)))
    d = d.join(hit, _same([d[k] for k in KEY], [hit[f"_{k}"] for k in KEY]), "left")
    return d.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"),
                    F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items"),
                    F.coalesce("covered", F.lit(0)).alias("covered"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    bad = matches(docs, benchmark, id_col, text_col, **options).select(*(F.col(k).alias(f"_{k}") for k in KEY)).distinct()
    return docs.join(bad, _same(_keyed(docs, id_col, text_col), [bad[f"_{k}"] for k in KEY]), "left_anti")
