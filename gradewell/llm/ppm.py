"""Code length of documents under prediction by partial matching.

A byte-context trie of order ``ORDER`` is counted over the training documents and
every document is scored by its log10 probability: each byte is predicted from
its longest known context; if the context has not seen the byte, an escape is
paid (method D: a symbol seen c times has (2c - 1) / 2T, the escape d / 2T with d
distinct symbols) and the next shorter context is asked, leaving out the
symbols the longer one could have predicted. Below order 0 the symbols left
share the rest evenly, so the probabilities of all texts sum to one.

The modelled text is the lower-cased (A-Z) words joined by one space, then an end
byte (0xFF, which no UTF-8 text holds); contexts begin with end bytes.

The trie is never in one place. The cost of a byte depends only on the byte and
the ``ORDER`` bytes before it, so each block sends its distinct grams with their
training counts; grams that share the last two context bytes meet in one
bucket, which holds orders 2 and up of their context chains whole (orders 0 and 1
are two tables of at most 65,792 counts). Salted partial sums come first, so a
frequent byte pair receives one list a salt, not one a block; costs go back
the same way. Word counts for the unigram base ride in the same exchange.

Nulls and ties: a null text is the empty text (the end byte alone); repeated rows
are trained on and scored each. A null id counts as the text "" when it is dealt
into folds. With no training documents every byte costs log10 256.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.llm import blocks as B

ORDER = 5
END = 0xFF
BLOCKS_A_SALT = 256
U = B.U64
#: Key of the end token among the word hashes.
END_WORD = U(0x5EEDE0D)


def _stream(w: B.Words) -> tuple[np.ndarray, np.ndarray]:
    """Words joined by a space and closed by END, with ORDER end bytes before
    every document; and where each document's part begins."""
    counts = w.counts()
    lens = w.ends - w.starts
    size = np.zeros(w.n_docs, np.int64)
    np.add.at(size, w.doc_of_word(), lens + 1)
    size = np.maximum(size, 1) + ORDER
    begin = np.concatenate(([0], np.cumsum(size)))
    out = np.full(int(begin[-1]), END, np.uint8)
    if len(w):
        after = np.cumsum(lens + 1)
        skip = np.concatenate(([0], after[:-1]))
        doc = w.doc_of_word()
        base = begin[doc] + ORDER + skip - skip[w.first[doc]]
        inner = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
        out[inner + np.repeat(base, lens)] = w.data[inner + np.repeat(w.starts, lens)]
        last = np.zeros(len(w), bool)
        last[w.first[1:][counts > 0] - 1] = True
        out[(base + lens)[~last]] = 0x20
    return out, begin


def _grams(w: B.Words) -> tuple[np.ndarray, np.ndarray]:
    """For every predicted byte: its ORDER context bytes and itself as one
    integer, and its document."""
    s, begin = _stream(w)
    key = np.zeros(len(s) - ORDER if len(s) else 0, U)
    for j in range(ORDER + 1):
        key = (key << U(8)) | s[j:len(s) - ORDER + j].astype(U)
    n = np.diff(begin) - ORDER
    at = np.arange(int(n.sum())) + np.repeat(begin[:-1] - (np.cumsum(n) - n), n)
    return key[at], np.repeat(np.arange(w.n_docs), n)


def _pairs(batches):
    """Counts of (byte, next byte) over the training texts of a task; cell -1: words."""
    total = np.zeros(65536, np.int64)
    for t in batches:
        for lo in range(0, t.num_rows, 256):
            part = t.slice(lo, 256)
            w = B.Words(part.column("text"), lower=True)
            g, _ = _grams(w)
            total += np.bincount((g & U(0xFFFF)).astype(np.int64), minlength=65536)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pair", "n"])


def _counted(keys: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of a sorted list, and the sums of their weights."""
    new = np.flatnonzero(B.runs(keys))
    return keys[new], (np.add.reduceat(weight, new) if len(new) else weight[:0]).astype(np.int64)


def _tokens(w: B.Words) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes (the end token after each document's words) and their documents."""
    h = np.concatenate((w.hashes(), np.full(w.n_docs, END_WORD)))
    return h, np.concatenate((w.doc_of_word(), np.arange(w.n_docs)))


def _parts(grams, tokens, bits):
    """(bucket, kind, from, to): grams by the last two context bytes, tokens by hash range."""
    mid = ((grams >> U(8)) & U(0xFFFF)).astype(np.int64)
    order = np.argsort(mid, kind="stable")
    cuts = np.flatnonzero(B.runs(mid[order]))
    own = [(int(mid[order[a]]), order[a:b]) for a, b in zip(cuts, np.append(cuts[1:], len(order)))]
    return own, [(65536 + b, lo, hi) for b, lo, hi in B.by_bucket(tokens, bits)]


def _send(bits: int, salts: int):
    def send(key, table):
        train = table.column("train").to_numpy().astype(bool)
        w = B.Words(table.column("text"), lower=True)
        grams, doc = _grams(w)
        # the document's fold in the lowest bit: one sort, then counts of training occurrences
        packed = np.sort((grams << U(1)) | train[doc].astype(U))
        grams, n = _counted(packed >> U(1), (packed & U(1)).astype(np.int64))
        tok, doc = _tokens(w)
        order = np.argsort(tok)
        tok, m = _counted(tok[order], train[doc][order].astype(np.int64))
        out = []
        by_pair, by_hash = _parts(grams, tok, bits)
        for b, rows in by_pair:
            out.append((b, B.pack(grams[rows], n[rows])))
        for b, lo, hi in by_hash:
            out.append((b, B.pack(tok[lo:hi], m[lo:hi])))
        me = key[0].as_py()
        return pa.table({"bucket": pa.array([o[0] for o in out], pa.int32()),
                         "salt": pa.array([me % salts] * len(out), pa.int32()),
                         "block": pa.array([me] * len(out), pa.int32()),
                         "keys": pa.array([o[1] for o in out], pa.binary())})
    return send


def _summed(blobs):
    keys, order, _, n = B.merged(blobs, extra=True)
    return _counted(keys[order], n[order].astype(np.int64))


def _partial(key, table):
    keys, n = _summed(table.column("keys").to_pylist())
    return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "salt": pa.array([key[1].as_py()], pa.int32()),
                     "keys": pa.array([B.pack(keys, n)], pa.binary())})


def costs(grams: np.ndarray, n: np.ndarray, one: np.ndarray, zero: np.ndarray) -> np.ndarray:
    """log10 probability of every gram (sorted; all of one pair of last context
    bytes), trained on those with n > 0. one: counts of (byte, next byte), zero: of bytes."""
    logp = np.zeros(len(grams))
    open_ = np.ones(len(grams), bool)
    left_total = np.zeros(len(grams))     # of the symbols the longer context had: their counts one order down
    left_kinds = np.zeros(len(grams))
    level = {}
    for o in range(ORDER, 1, -1):
        mask = U((1 << 8 * (o + 1)) - 1)
        k = (grams & mask)[n > 0]
        order = np.argsort(k, kind="stable")
        level[o] = _counted(k[order], n[n > 0][order])

    def count_below(o, keys):
        if o > 1:
            ks, c = level[o]
            return c[np.searchsorted(ks, keys & U((1 << 8 * (o + 1)) - 1))]
        return one[(keys & U(0xFFFF)).astype(np.int64)] if o == 1 else zero[(keys & U(0xFF)).astype(np.int64)]

    def settle(q, total, kinds, c):
        """Pay the symbol where its count c > 0, else the escape."""
        t, d = total - left_total[q], kinds - left_kinds[q]
        here = c > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            p = np.where(here, (2 * c - 1) / (2 * t), np.where(d > 0, d / (2 * t), 1.0))
        logp[q] += np.log10(p)
        open_[q[here]] = False

    for o in range(ORDER, 1, -1):
        ks, c = level[o]
        if not len(ks):
            continue
        ctx = ks >> U(8)
        first = np.flatnonzero(B.runs(ctx))
        nodes, total = ctx[first], np.add.reduceat(c, first)
        kinds = np.diff(np.append(first, len(ks)))
        below = np.add.reduceat(count_below(o - 1, ks), first)
        q = np.flatnonzero(open_)
        mine = grams[q] & U((1 << 8 * (o + 1)) - 1)
        at = np.minimum(np.searchsorted(nodes, mine >> U(8)), len(nodes) - 1)
        known = nodes[at] == mine >> U(8)
        q, mine, at = q[known], mine[known], at[known]
        sym = np.minimum(np.searchsorted(ks, mine), len(ks) - 1)
        settle(q, total[at], kinds[at], np.where(ks[sym] == mine, c[sym], 0))
        left_total[q], left_kinds[q] = below[at], kinds[at]
    if len(grams):
        last = int(grams[0] >> U(8)) & 0xFF
        row = one[last * 256:(last + 1) * 256]
        sym = (grams & U(0xFF)).astype(np.int64)
        if row.sum():
            q = np.flatnonzero(open_)
            settle(q, float(row.sum()), float((row > 0).sum()), row[sym[q]])
            left_total[q], left_kinds[q] = zero[row > 0].sum(), (row > 0).sum()
        if zero.sum():
            q = np.flatnonzero(open_)
            settle(q, float(zero.sum()), float((zero > 0).sum()), zero[sym[q]])
        q = np.flatnonzero(open_)
        logp[q] -= np.log10(256 - (zero > 0).sum())
    return logp


def _model(one: np.ndarray, zero: np.ndarray):
    def model(key, table):
        """A bucket's answer for the keys each salt asked for: log10 probability
        of a gram, training count of a token."""
        bucket = key[0].as_py()
        blobs = table.column("keys").to_pylist()
        keys, n = _summed(blobs)
        gram = bucket < 65536
        values = costs(keys, n, one, zero).astype(np.float32) if gram else n
        asked, answers = [], []
        for blob in blobs:
            own = B.unpack(blob, extra=True)[0]
            asked.append(B.pack(own))
            answers.append((values if len(own) == len(keys) else values[np.searchsorted(keys, own)]).tobytes())
        return pa.table({"bucket": pa.array([bucket] * len(blobs), pa.int32()), "salt": table.column("salt"),
                         "keys": pa.array(asked, pa.binary()), "answers": pa.array(answers, pa.binary())})
    return model


def _totals(key, table):
    """Training tokens of a bucket and how many distinct ones."""
    words = key[0].as_py() >= 65536
    n = _summed(table.column("keys").to_pylist())[1] if words else np.empty(0, np.int64)
    return pa.table({"tokens": pa.array([int(n.sum())], pa.int64()), "kinds": pa.array([int((n > 0).sum())], pa.int64())})


def _answer(key, asked, model):
    """What each block asked of this bucket, in the order of its own keys."""
    gram = key[0].as_py() < 65536
    keys = B.unpack(model.column("keys")[0].as_py())
    values = np.frombuffer(model.column("answers")[0].as_py(), np.float32 if gram else np.int64)
    out = [(b, (values[np.searchsorted(keys, B.unpack(k))]).astype(np.float32 if gram else np.int64).tobytes())
           for b, k in zip(asked.column("block").to_pylist(), asked.column("keys").to_pylist())]
    return pa.table({"block": pa.array([o[0] for o in out], pa.int32()),
                     "bucket": pa.array([key[0].as_py()] * len(out), pa.int32()),
                     "answers": pa.array([o[1] for o in out], pa.binary())})


def _score(bits: int):
    def score(key, table, answers):
        w = B.Words(table.column("text"), lower=True)
        got = dict(zip(answers.column("bucket").to_pylist(), answers.column("answers").to_pylist()))
        gram, doc = _grams(w)
        packed = np.sort((gram << U(16)) | doc.astype(U)) if w.n_docs <= 65536 else None
        if packed is None:                                   # a block of very many tiny texts
            order = np.argsort(gram, kind="stable")
            gram, doc = gram[order], doc[order]
        else:
            gram, doc = packed >> U(16), (packed & U(0xFFFF)).astype(np.int64)
        new = B.runs(gram)
        uniq, run = gram[new], np.cumsum(new) - 1
        tok, tok_doc = _tokens(w)
        order = np.argsort(tok)
        tnew = B.runs(tok[order])
        tuniq, trun = tok[order][tnew], np.cumsum(tnew) - 1
        value, count = np.zeros(len(uniq), np.float32), np.zeros(len(tuniq), np.int64)
        by_pair, by_hash = _parts(uniq, tuniq, bits)
        for b, rows in by_pair:
            value[rows] = np.frombuffer(got[b], np.float32)
        for b, lo, hi in by_hash:
            count[lo:hi] = np.frombuffer(got[b], np.int64)
        total = np.bincount(doc, weights=value[run].astype(np.float64), minlength=w.n_docs)
        c, at = count[trun], tok_doc[order]
        return pa.table({"doc_id": table.column("doc_id").cast(pa.int64()), "train": table.column("train"),
                         "n_tokens": pa.array(w.counts() + 1, pa.int64()),
                         "n_known": pa.array(np.bincount(at, weights=c > 0, minlength=w.n_docs).astype(np.int64)),
                         "known_log": pa.array(np.bincount(at, weights=np.log10(c + 0.5), minlength=w.n_docs)),
                         "score": pa.array(total)})
    return score


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5,
                    held_out: int = 1) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)
    for every document; documents whose crc32(id as text) mod ``folds`` is
    ``held_out`` are not learned from."""
    rows, n_bytes = B.size_of(docs, text_col)
    blocks, bits = B.n_blocks(n_bytes), B.bucket_bits(n_bytes // 6)
    salts = blocks // BLOCKS_A_SALT + 1
    fold = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                    (fold != held_out).alias("train"))
    pairs = d.filter("train").select("text").mapInArrow(_pairs, "pair long, n long").groupBy("pair").agg(
        F.sum("n").alias("n")).collect()                        # at most 65,536 rows
    one = np.zeros(65536, np.int64)
    for r in pairs:
        one[r.pair] = r.n
    zero = one.reshape(256, 256).sum(axis=0)

    dealt = d.withColumn("block", B.block_by_hash(F.struct("doc_id", F.crc32(F.col("text").cast("binary"))), blocks))
    asked = dealt.groupBy("block").applyInArrow(_send(bits, salts), "bucket int, salt int, block int, keys binary")
    part = asked.groupBy("bucket", "salt").applyInArrow(_partial, "bucket int, salt int, keys binary")
    # one plan: the blocks, what they ask and the partial sums are each exchanged once and used by all that follow
    model = part.groupBy("bucket").applyInArrow(_model(one, zero), "bucket int, salt int, keys binary, answers binary")
    answers = asked.groupBy("bucket", "salt").cogroup(model.groupBy("bucket", "salt")).applyInArrow(
        _answer, "block int, bucket int, answers binary")
    scored = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _score(bits), "doc_id long, train boolean, n_tokens long, n_known long, known_log double, score double")
    total = part.groupBy("bucket").applyInArrow(_totals, "tokens long, kinds long").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("train_tokens"),
                      F.coalesce(F.sum("kinds"), F.lit(0)).alias("kinds"))
    base = F.col("known_log") - F.col("n_tokens") * F.log10(F.col("train_tokens") + 0.5 * (F.col("kinds") + 1))
    return scored.crossJoin(F.broadcast(total)).select(       # one row
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
        base.alias("base_score"), "score")
