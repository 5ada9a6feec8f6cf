"""Repaired conversations against a plain search over all edits."""

import functools
import hashlib
import itertools
import random
import re
import sys
import zlib

import pytest

from gradewell.llm import turn_repair as R

sys.setrecursionlimit(100_000)
GRAMMAR = re.compile("(s?(ua)+)?")


def plain_row_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))


def plain_repair(rows):
    """(turn, role, text) after damage -> the contract's columns, by definition."""
    rows = plain_row_order(rows)
    if not rows:
        return (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    seen, faults = set(), []
    for _, role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else
                      "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))

    @functools.lru_cache(None)
    def best(i, have, inserts):
        """Cheapest (cost, audit, roles) of rows from ``i``, after roles whose last two initials are ``have``."""
        options = []
        if i == len(rows) and have in ("", "a"):
            options.append((0, "", ()))
        due = "a" if have == "u" else "u"
        if inserts < 4:
            c, a, rest = best(i, due, inserts + 1)
            options.append((c + 3, "I" + a, (("I", due),) + rest))
        if i < len(rows):
            c, a, rest = best(i + 1, have, 0)
            options.append((c + 4, "D" + a, (("D", None),) + rest))
            if faults[i] not in ("blank", "duplicate"):
                extra = 3 if faults[i] == "truncated" else 0
                mine = initials[i]
                if (mine == "s" and have == "") or (mine in "ua" and mine and mine == due):
                    c, a, rest = best(i + 1, mine, 0)
                    options.append((c + extra, "K" + a, (("K", None),) + rest))
                c, a, rest = best(i + 1, due, 0)
                options.append((c + 3 + extra, "R" + a, (("R", due),) + rest))
        return min(options, default=(10 ** 9, "", ()))
    cost, audit, signs = best(0, "", 0)
    lines, i, roles = [], 0, ""
    for sign, due in signs:
        name = {"u": "user", "a": "assistant"}.get(due)
        if sign == "I":
            lines.append(f"{name}:")
        else:
            _, role, text = rows[i]
            i += 1
            if sign != "D":
                lines.append(f"{role if sign == 'K' else name}:{text}")
    roles = "".join(x[:1] for x in lines)
    assert GRAMMAR.fullmatch(roles)
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def conversations(seed, n, rows=8):
    rnd = random.Random(seed)
    out = []
    for c in range(n):
        for t in range(rnd.randrange(1, rows)):
            turn = None if rnd.random() < 0.05 else rnd.randrange(rows) if rnd.random() < 0.2 else t
            role = rnd.choice(["system", "user", "assistant", "user", "assistant", "tool", ""]) if rnd.random() < 0.5 else (
                "user" if t % 2 == 0 else "assistant")
            text = rnd.choice(["", " \n", "Hi.", "Hi", "No!", "what?", "é…", "a. ", "b\n.", "Ünd"]) if rnd.random() < 0.7 else f"t{rnd.randrange(5)}."
            out.append((c, turn, role, text))
    return out


def by_conversation(rows):
    groups = {}
    for c, *r in rows:
        groups.setdefault(c, []).append(tuple(r))
    return groups


def result(df):
    return {r["conv_id"]: tuple(r[c] for c in R.RESULT[1:]) for r in df.collect()}


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("piece_rows", [R.PIECE_ROWS, 2])
def test_equals_plain_search(spark, frame, piece_rows):
    rows = conversations(1, 150) + conversations(2, 1, 60) + [(None, None, "user", "x."), (None, 3, "assistant", "y."), (None, 3, "assistant", "y.")]
    rows += [(900, None, "user", "a."), (900, None, "assistant", "b.")]
    df = frame(rows, SCHEMA)
    got = result(R.repair(df, piece_rows=piece_rows))
    want = {c: plain_repair(r) for c, r in by_conversation(rows).items()}
    assert got == want


def test_one_conversation_in_many_tasks(spark, frame):
    rows = [(1, t, "user" if t % 2 else "assistant", f"text {t % 70}" + ".!"[t % 2]) for t in range(300)] + [(2, 0, "user", "q?")]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = result(R.repair(frame(rows, SCHEMA), piece_rows=16))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == {c: plain_repair(r) for c, r in by_conversation(rows).items()}


def test_damage_and_copies(spark, frame):
    rows = [(c, t, ["system", "user", "assistant"][0 if t == 0 and c % 3 == 0 else 1 + t % 2], f"Word {c} {t}. More!")
            for c in range(60) for t in range(c % 9 + 1)] + [(None, None, None, None), (77, 0, None, "x"), (78, 1, "user", None)]
    groups = {}
    for c, t, role, text in rows:
        known = [" " if v is None else str(v) for v in (c, t)]
        role, text = " " if role is None else role, " " if text is None else text
        f = zlib.crc32(":".join(known).encode()) % 20
        text = "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text
        groups.setdefault(c, []).extend([(t, "user" if f == 4 else role, text)] * (0 if f == 0 else 2 if f == 3 else 1))
    damaged, copies = R.damaged(frame(rows, SCHEMA))
    assert result(R.repair(damaged, copies=copies)) == {c: plain_repair(r) for c, r in groups.items()}


def test_halves_meet_as_the_whole_table_does():
    """Divide and conquer finds the least audit of a plain table of all rows."""
    rnd = random.Random(3)
    solver = R.Solver(R.ROW_STEPS)
    for n in itertools.chain(range(12), [200, 501]):
        kinds = bytes(rnd.randrange(16) for _ in range(n))
        best = [(0, "")] + [(R.NONE, "")] * 3
        for k in kinds:
            best = [min((best[s][0] + R.ROW_STEPS[k][s][t][0], best[s][1] + R.ROW_STEPS[k][s][t][1]) for s in range(4)) for t in range(4)]
        want = min((best[s][0] + R.TAIL[s][0], best[s][1] + R.TAIL[s][1]) for s in range(4))
        end, cost = solver.end(kinds)
        assert (cost, "".join(R.edits(solver, kinds, 0, end)) + R.TAIL[end][1]) == want


def test_long_texts_and_empty_table(spark, frame):
    rows = [(1, 0, "user", "w" * 400_000 + "?"), (1, 1, "assistant", "v" * 300_000), (1, 2, "user", "w" * 400_000 + "?"), (2, 0, "user", "")]
    assert result(R.repair(frame(rows, SCHEMA))) == {c: plain_repair(r) for c, r in by_conversation(rows).items()}
    assert R.repair(frame([], SCHEMA)).collect() == []
