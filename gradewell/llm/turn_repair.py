"""Conversation structure repair by Hirschberg's divide and conquer.

A conversation's roles must read ``(s?(ua)+)?`` by their initials. The cheapest edits
keep, re-role or delete each row and insert rows; four states (nothing yet, after s, after
u, after a) hold what may follow, so the cost of reaching each of them is a vector of four.
A span is solved without a table of all its rows: the forward vector of its first half and the backward
vector of its second meet in the middle, the cheapest crossing is chosen, and both halves
are solved alone. Ties go to the audit that is least in ASCII: the forward vector
carries the order of the four states' audits. That order is well defined, as an
audit ends with the row last read, so no two audits of one span from one state are prefixes of
each other.

Rows are range-partitioned by (conversation, turn, role, text), so a conversation may lie in many
tasks. One that lies in one piece is finished where it is read. The others are cut in *pieces* of
at most ``PIECE_ROWS`` rows or ``PIECE_BYTES`` of text. What pieces need of each other is exchanged: texts
seen in an earlier piece, by an aggregate; states at the pieces' ends, by the same divide and
conquer over one 4 x 4 table (cost, order of audits) per piece. Each piece then solves its
rows alone. A digest of a whole conversation is sequential by nature: its repaired
lines pass through one task as a stream, never held together.

Nulls and ties: a null role or text counts as one space, a null conversation is one
of its own, null turns come first. Rows of one turn go by role, then by MD5 of the text, equal rows side by
side. An empty role is no initial: such a row cannot be kept. A row of 0
copies only names its conversation; one without other rows has zeros, an empty audit and
the digest of nothing. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradewell.llm import blocks as B

PIECE_ROWS = 2048
PIECE_BYTES = 1 << 18
NONE = 1 << 60                       # the cost of what cannot be

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: The state after a role's initial, from each state (start, s, u, a); None: not allowed.
AFTER = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
#: The role that is due in each state when it is not the row's own.
DUE = ("u", "u", "a", "u")
NAMES = {"u": "user", "a": "assistant"}
ENDS = (True, False, False, True)
FAULTS = ("ok", "truncated", "blank", "duplicate")

_SEEN = re.compile(r"[^\x20\x09-\x0D]")


def _inserts(s: int):
    """(state, inserts) reached from ``s`` by insertions alone."""
    for n in range(3):
        yield s, n
        s = AFTER[DUE[s]][s]


def _row_step(kind: int) -> list[list[tuple[int, str]]]:
    """4 x 4 table of (cost, least audit) of one row. ``kind`` is 4 * initial (s, u, a, other) + fault."""
    initial, fault = "sua-"[kind // 4], FAULTS[kind % 4]
    step = [[(NONE, "")] * 4 for _ in range(4)]
    for s in range(4):
        for at, n in _inserts(s):
            moves = [(at, DELETE, "D")]
            if fault in ("ok", "truncated"):
                extra = TRUNCATED if fault == "truncated" else 0
                if initial in AFTER and AFTER[initial][at] is not None:
                    moves.append((AFTER[initial][at], KEEP + extra, "K"))
                moves.append((AFTER[DUE[at]][at], REROLE + extra, "R"))
            for to, cost, sign in moves:
                step[s][to] = min(step[s][to], (cost + INSERT * n, "I" * n + sign))
    return step


ROW_STEPS = [_row_step(kind) for kind in range(16)]
#: Cost and audit of what is inserted after the last row.
TAIL = [min((INSERT * n, "I" * n) for at, n in _inserts(s) if ENDS[at]) for s in range(4)]
START = ((0, NONE, NONE, NONE), (0, 9, 9, 9))


def forward(vector, step):
    """(costs, order of the audits) after one more step."""
    costs, ranks = vector
    best = []
    for t in range(4):
        c, r, a = min((costs[s] + step[s][t][0], ranks[s], step[s][t][1]) for s in range(4))
        best.append((c, r, a) if c < NONE else (NONE, 9, a))
    order = sorted({b[1:] for b in best if b[0] < NONE})
    return tuple(b[0] for b in best), tuple(order.index(b[1:]) if b[0] < NONE else 9 for b in best)


def backward(costs, step):
    """The costs of the rest before one more step."""
    return tuple(min(min(step[s][t][0] + costs[t] for t in range(4)), NONE) for s in range(4))


def entry(s: int):
    """The forward vector at the start of a span entered in state ``s``."""
    return tuple(0 if t == s else NONE for t in range(4)), tuple(0 if t == s else 9 for t in range(4))


class Solver:
    """Divide and conquer over steps known by number; vectors repeat up to a constant, so steps are remembered."""

    def __init__(self, steps):
        self.steps, self.ahead, self.behind = steps, {}, {}

    def run(self, kinds, lo: int, hi: int, vector):
        base = 0
        for k in range(lo, hi):
            key = (vector, kinds[k])
            nxt = self.ahead.get(key)
            if nxt is None:
                costs, ranks = forward(vector, self.steps[kinds[k]])
                low = min(costs)
                nxt = self.ahead[key] = (tuple(c - low if c < NONE else NONE for c in costs), ranks), low
            vector, base = nxt[0], base + nxt[1]
        return vector, base

    def back(self, kinds, lo: int, hi: int, costs):
        for k in range(hi - 1, lo - 1, -1):
            key = (costs, kinds[k])
            nxt = self.behind.get(key)
            if nxt is None:
                found = backward(costs, self.steps[kinds[k]])
                low = min(found)
                nxt = self.behind[key] = tuple(c - low if c < NONE else NONE for c in found)
            costs = nxt
        return costs

    def states(self, kinds, lo: int, hi: int, s: int, t: int, out: list) -> None:
        """Appends the state after each of the steps of ``lo:hi``, entered in ``s`` and left in ``t``."""
        todo = [(lo, hi, s, t)]
        while todo:
            lo, hi, s, t = todo.pop()
            if hi - lo < 2:
                if hi > lo:
                    out.append(t)
                continue
            mid = (lo + hi) // 2
            (costs, ranks), _ = self.run(kinds, lo, mid, entry(s))
            rest = self.back(kinds, mid, hi, entry(t)[0])
            m = min(range(4), key=lambda x: (costs[x] + rest[x], ranks[x]))
            todo += [(mid, hi, m, t), (lo, mid, s, m)]

    def end(self, kinds, s: int = 0) -> tuple[int, int]:
        """(state before the tail, cost) of the best way through all steps."""
        (costs, ranks), base = self.run(kinds, 0, len(kinds), entry(s))
        t = min(range(4), key=lambda x: (costs[x] + TAIL[x][0], ranks[x]))
        return t, base + costs[t] + TAIL[t][0]


def edits(solver: Solver, kinds, s: int, t: int) -> list[str]:
    """Each row's edits (inserts before it, then its own)."""
    states: list[int] = []
    solver.states(kinds, 0, len(kinds), s, t, states)
    out = []
    for kind, to in zip(kinds, states):
        out.append(ROW_STEPS[kind][s][to][1])
        s = to
    return out


def repaired_lines(rows, signs, s: int):
    """The repaired lines of rows (role, text) under their edits, from state ``s``."""
    for (role, text), sign in zip(rows, signs):
        for c in sign:
            if c == "D":
                continue
            due = DUE[s]
            if c == "K":
                yield f"{role}:{text}"
                s = AFTER[role[:1]][s]
            else:
                yield f"{NAMES[due]}:{text if c == 'R' else ''}"
                s = AFTER[due][s]


def tail_lines(s: int):
    for _ in TAIL[s][1]:
        yield f"{NAMES[DUE[s]]}:"
        s = AFTER[DUE[s]][s]


def row_kind(role: str, text: str) -> int:
    """A row's kind, before it is known whether it is a duplicate."""
    if not _SEEN.search(text):
        fault = 2
    else:
        last = text.rstrip(" \t\n\x0b\x0c\r")[-1]
        fault = 0 if last in ".!?" else 1
    return 4 * "sua".find(role[:1]) + fault if role[:1] and role[0] in "sua" else 12 + fault


# ------------------------------------------------------------ pieces

PIECE = T.StructType([T.StructField(n, t) for n, t in (
    ("conv_id", T.LongType()), ("at", T.LongType()), ("whole", T.BooleanType()),
    ("gaps", T.LongType()), ("blank", T.LongType()), ("duplicate", T.LongType()), ("truncated", T.LongType()),
    ("illegal", T.LongType()), ("cost", T.LongType()), ("audit", T.StringType()), ("repaired_sha256", T.StringType()),
    ("first_turn", T.LongType()), ("last_turn", T.LongType()), ("turns", T.LongType()),
    ("first_role", T.StringType()), ("last_role", T.StringType()),
    ("kinds", T.BinaryType()), ("keys", T.ArrayType(T.BinaryType())), ("roles", T.ArrayType(T.StringType())),
    ("texts", T.ArrayType(T.StringType())))])
ARROW = pa.schema([("conv_id", pa.int64()), ("at", pa.int64()), ("whole", pa.bool_()),
                   *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                   ("audit", pa.string()), ("repaired_sha256", pa.string()), ("first_turn", pa.int64()), ("last_turn", pa.int64()),
                   ("turns", pa.int64()), ("first_role", pa.string()), ("last_role", pa.string()), ("kinds", pa.binary()),
                   ("keys", pa.list_(pa.binary())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])
RESULT = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _key(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()


class Piece:
    """Rows of one conversation, in order, while they are read."""

    def __init__(self, conv):
        self.conv, self.rows, self.turns, self.size = conv, [], [], 0

    def add(self, turn, role, text, times):
        for _ in range(times):
            self.rows.append((role, text))
            self.turns.append(turn)
            self.size += len(text) + len(role)

    def full(self, most: int) -> bool:
        return len(self.rows) >= most or self.size >= PIECE_BYTES

    def facts(self) -> dict:
        """What is known of the rows alone; duplicates within the piece are marked."""
        kinds, seen, keys = bytearray(), set(), []
        for role, text in self.rows:
            kind = row_kind(role, text)
            if kind % 4 != 2:
                key = _key(role, text)
                if key in seen:
                    kind += 3 - kind % 4
                seen.add(key)
                keys.append(key)
            else:
                keys.append(b"")
            kinds.append(kind)
        turns = [t for t in self.turns if t is not None]
        initials = [r[:1] for r, _ in self.rows]
        return {"conv_id": self.conv, "kinds": bytes(kinds), "keys": keys,
                "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
                "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None,
                "turns": len(set(turns)), "first_role": initials[0] if initials else None,
                "last_role": initials[-1] if initials else None}

    def open(self, at: int) -> dict:
        return self.facts() | {"at": at, "whole": False, "roles": [r for r, _ in self.rows], "texts": [t for _, t in self.rows]}

    def finished(self, solver: Solver) -> dict:
        f = self.facts()
        kinds = f["kinds"]
        end, cost = solver.end(kinds)
        signs = edits(solver, kinds, 0, end)
        lines = [*repaired_lines(self.rows, signs, 0), *tail_lines(end)]
        gaps = f["last_turn"] - f["first_turn"] + 1 - f["turns"] if f["turns"] else 0
        count = [k % 4 for k in kinds]
        return {"conv_id": self.conv, "whole": True, "gaps": gaps, "blank": count.count(2), "duplicate": count.count(3),
                "truncated": count.count(1), "illegal": f["illegal"], "cost": cost, "audit": "".join(signs) + TAIL[end][1],
                "repaired_sha256": hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest()}


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{n: r.get(n) for n in ARROW.names} for r in rows], ARROW)


def _pieces(most: int):
    def pieces(batches):
        """Sorted rows in; finished conversations and the pieces of those that may go on in another task out."""
        solver, out, size = Solver(ROW_STEPS), [], 0
        base, number = TaskContext.get().partitionId() << 32, 0
        piece, cut, first = None, False, True

        def close(last: bool):
            nonlocal number
            if first or last or cut:
                number += 1
                return piece.open(base + number)
            return piece.finished(solver)
        for t in batches:
            for conv, turn, role, text, times in zip(*(t.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text", "times"))):
                if piece is not None and piece.conv != conv:
                    out.append(close(False))
                    piece, cut, first = None, False, False
                elif piece is not None and piece.full(most):
                    cut = True
                    out.append(close(False))
                    size += piece.size
                    piece = None
                if piece is None:
                    piece = Piece(conv)
                piece.add(turn, role, text, times)
                if len(out) >= 1000 or size >= 4 << 20:
                    yield _batch(out)
                    out, size = [], 0
        if piece is not None:
            out.append(close(True))
        if out:
            yield _batch(out)
    return pieces


def _with_seen(kinds: bytes, keys: list[bytes], before: set) -> bytes:
    return bytes(k + 3 - k % 4 if key and key in before else k for k, key in zip(kinds, keys))


def _tables(batches):
    """Each open piece's 4 x 4 table of costs and orders, its duplicates of earlier pieces marked."""
    solver = Solver(ROW_STEPS)
    for t in batches:
        kinds = [_with_seen(k, keys, set(seen or ())) for k, keys, seen in zip(
            *(t.column(n).to_pylist() for n in ("kinds", "keys", "seen")))]
        costs, ranks = [], []
        for k in kinds:
            found = [solver.run(k, 0, len(k), entry(s)) for s in range(4)]
            costs.append([c + base if c < NONE else NONE for (v, _), base in found for c in v])
            ranks.append([r for (_, v), _ in found for r in v])
        yield pa.RecordBatch.from_arrays(
            [t.column("conv_id"), t.column("at"), pa.array(kinds, pa.binary()), pa.array(costs, pa.list_(pa.int64())),
             pa.array(ranks, pa.list_(pa.int64())), *(t.column(n) for n in ("illegal", "first_turn", "last_turn", "turns", "first_role", "last_role"))],
            names=["conv_id", "at", "kinds", "costs", "ranks", "illegal", "first_turn", "last_turn", "turns", "first_role", "last_role"])


TABLES = ("conv_id long, at long, kinds binary, costs array<long>, ranks array<long>, illegal long, first_turn long, "
          "last_turn long, turns long, first_role string, last_role string")


def _crossings(t):
    """The states at the ends of a conversation's pieces, and what needs all pieces: gaps, illegal pairs, the cost."""
    t = t.combine_chunks().sort_by("at")
    rows = t.to_pylist()
    steps = [[[(r["costs"][4 * s + x], r["ranks"][4 * s + x]) for x in range(4)] for s in range(4)] for r in rows]
    solver, kinds = Solver(steps), range(len(steps))
    end, cost = solver.end(kinds)
    states: list[int] = []
    solver.states(kinds, 0, len(rows), 0, end, states)
    illegal, turns, last = sum(r["illegal"] for r in rows), 0, None
    low, role = None, None
    for r in rows:
        if r["first_role"] is not None:
            illegal += role is not None and role + r["first_role"] not in ("su", "ua", "au")
            role = r["last_role"]
        if r["turns"]:
            turns += r["turns"] - (last is not None and last == r["first_turn"])
            low, last = r["first_turn"] if low is None else low, r["last_turn"]
    n = len(rows)
    return pa.table({"at": t.column("at"), "enter": pa.array([0, *states][:n], pa.int32()), "leave": pa.array(states, pa.int32()),
                     "gaps": pa.array([last - low + 1 - turns if turns else 0] * n, pa.int64()),
                     "illegal": pa.array([illegal] * n, pa.int64()), "cost": pa.array([cost] * n, pa.int64()),
                     "final": pa.array([i == n - 1 for i in range(n)])})


def _lines(batches):
    """Each piece's audit and repaired text."""
    solver = Solver(ROW_STEPS)
    for t in batches:
        out = []
        for r in t.to_pylist():
            kinds = r["kinds"]
            signs = edits(solver, kinds, r["enter"], r["leave"])
            lines = list(repaired_lines(zip(r["roles"], r["texts"]), signs, r["enter"]))
            audit = "".join(signs)
            if r["final"]:
                lines += tail_lines(r["leave"])
                audit += TAIL[r["leave"]][1]
            count = [k % 4 for k in kinds]
            out.append({"conv_id": r["conv_id"], "at": r["at"], "gaps": r["gaps"], "illegal": r["illegal"], "cost": r["cost"],
                        "blank": count.count(2), "duplicate": count.count(3), "truncated": count.count(1), "audit": audit,
                        "lines": "\n".join(lines).encode("utf-8", "surrogatepass") if lines else None})
        yield pa.RecordBatch.from_pylist(out, LINES)


LINES = pa.schema([("conv_id", pa.int64()), ("at", pa.int64()), *((n, pa.int64()) for n in (
    "gaps", "illegal", "cost", "blank", "duplicate", "truncated")), ("audit", pa.string()), ("lines", pa.binary())])
LINES_SQL = "conv_id long, at long, gaps long, illegal long, cost long, blank long, duplicate long, truncated long, audit string, lines binary"
RESULT_SQL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _joined(batches):
    """Pieces in order in, conversations out; the repaired text passes through the digest."""
    held = None
    for t in batches:
        out = []
        for r in t.to_pylist():
            if held is None or held["conv_id"] != r["conv_id"]:
                if held is not None:
                    out.append(_closed(held))
                held = r | {"blank": 0, "duplicate": 0, "truncated": 0, "audits": [], "digest": hashlib.sha256(), "begun": False}
            for n in ("blank", "duplicate", "truncated"):
                held[n] += r[n]
            held["audits"].append(r["audit"])
            if r["lines"] is not None:
                if held["begun"]:
                    held["digest"].update(b"\n")
                held["begun"] = True
                held["digest"].update(r["lines"])
        if out:
            yield pa.RecordBatch.from_pylist(out, pa.schema([ARROW.field(n) for n in RESULT]))
    if held is not None:
        yield pa.RecordBatch.from_pylist([_closed(held)], pa.schema([ARROW.field(n) for n in RESULT]))


def _closed(held: dict) -> dict:
    found = held | {"audit": "".join(held["audits"]), "repaired_sha256": held["digest"].hexdigest()}
    return {n: found[n] for n in RESULT}


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           copies: Column | None = None, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """One row per conversation: its faults, the cheapest edits and the digest of the
    repaired conversation. ``copies`` says how often a row is there (default 1)."""
    spark = rows.sparkSession
    times = (F.lit(1) if copies is None else copies).cast("int")
    d = rows.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
                    F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
                    F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"), times.alias("times"))
    # equal rows may part: the last key spreads them over the ranges they fill
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.col("role"), F.col("digest"), F.col("spread")]
    placed = d.withColumn("digest", F.md5("text")).withColumn(
        "spread", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 20))).repartitionByRange(
        *order).sortWithinPartitions(*order)
    path = B.shared_folder(rows, "repair")
    placed.select("conv_id", "turn", "role", "text", "times").mapInArrow(_pieces(piece_rows), PIECE).write.parquet(f"{path}/pieces")
    found = spark.read.parquet(f"{path}/pieces")
    whole = found.filter("whole").select(*RESULT)
    pieces = found.filter("not whole")

    # texts of earlier pieces: one row per (conversation, text, piece), so no key has more rows than pieces
    keys = pieces.select("conv_id", "at", F.explode(F.array_distinct("keys")).alias("key")).filter(F.length("key") > 0)
    firsts = keys.groupBy("conv_id", "key").agg(F.min("at").alias("a"), F.max("at").alias("b")).filter("a < b").select(
        F.col("conv_id").alias("c"), F.col("key").alias("k"), "a")
    late = keys.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k"))).filter(
        F.col("at") > F.col("a")).groupBy(F.col("at").alias("_at")).agg(F.collect_list("key").alias("seen"))
    marked = pieces.select("conv_id", "at", "kinds", "keys", "illegal", "first_turn", "last_turn", "turns", "first_role", "last_role").join(
        late, F.col("at") == F.col("_at"), "left").drop("_at")
    marked.mapInArrow(_tables, TABLES).write.parquet(f"{path}/tables")
    tables = spark.read.parquet(f"{path}/tables")
    cross = tables.drop("kinds").groupBy("conv_id").applyInArrow(
        _crossings, "at long, enter int, leave int, gaps long, illegal long, cost long, final boolean")
    texts = pieces.select("conv_id", "at", "roles", "texts")
    solved = texts.join(tables.select("at", "kinds"), "at").join(cross, "at").select(
        "conv_id", "at", "kinds", "roles", "texts", "enter", "leave", "gaps", "illegal", "cost", "final")
    joined = solved.mapInArrow(_lines, LINES_SQL).repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(
        _joined, RESULT_SQL)
    return whole.union(joined.select(*RESULT))


def damaged(rows: DataFrame) -> tuple[DataFrame, Column]:
    """The conversations with planted faults (by a hash of ``conv_id:turn``), and the rows' copies."""
    def known(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    out = rows.select("conv_id", "turn", known("role").alias("role"), known("text").alias("text"), fault.alias("fault")).select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(
            F.col("text")).alias("text"), "fault")
    return out, F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1)
