import hashlib
import re
import zlib
from collections import defaultdict
from functools import cache

import numpy as np
import pytest

from wardgate.llm import turns
from wardgate.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
COLS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damage(rows):
    """{conv_id: rows after damage} straight from the rules."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        named = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(named.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out[conv] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def brute(conv, rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        real = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not real else "duplicate" if (role, text) in seen else "" if real[-1] in ".!?" else "truncated")
        seen.add((role, text))
    given = [t for t, _, _ in rows if t is not None]
    states = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    @cache
    def best(i, state, inserts):
        """(cost, audit, lines as a linked list) of the least repair from here."""
        ways = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        for role in ("user", "assistant"):
            if role[0] not in states[state]:
                continue
            if inserts < 3:
                c, a, lines = best(i, role[0], inserts + 1)
                ways.append((5 + c, "I" + a, (f"{role}:", lines)))
            if i < len(rows) and faults[i] in ("", "truncated"):
                c, a, lines = best(i + 1, role[0], 0)
                ways.append((1 + 5 * (faults[i] == "truncated") + c, "R" + a, (f"{role}:{rows[i][2]}", lines)))
        if i < len(rows):
            c, a, lines = best(i + 1, state, 0)
            ways.append((2 + c, "D" + a, lines))
            role, text = rows[i][1:]
            if faults[i] in ("", "truncated") and role[:1] in states[state] and role[:1]:
                c, a, lines = best(i + 1, role[0], 0)
                ways.append((5 * (faults[i] == "truncated") + c, "K" + a, (f"{role}:{text}", lines)))
        return min(ways, key=lambda w: w[:2]) if ways else (1 << 30, "", ())

    for i in range(len(rows), -1, -8):  # keep the recursion shallow
        for s in states:
            best(i, s, 0)
    cost, audit, lines = best(0, "", 0)
    text = []
    while lines:
        text.append(lines[0])
        lines = lines[1]
    initials = [r[1][:1] for r in rows]
    return (
        conv, max(given) - min(given) + 1 - len(set(given)) if given else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, audit,
        hashlib.sha256("\n".join(text).encode()).hexdigest(),
    )


def check(df, rows):
    got = sorted((tuple(r[c] for c in COLS) for r in df.collect()), key=str)
    assert got == sorted((brute(c, r) for c, r in damage(rows).items()), key=str)


def made(spark, rows):
    clashing = [(*r, "x", 9, 9) for r in rows]
    return spark.createDataFrame(clashing, "conv_id long, turn long, role string, text string, audit string, cost long, copies long")


def random_rows(seed, convs, most, roles=("user", "assistant", "system", "tool", "", None, "User", "usr")):
    rng = np.random.default_rng(seed)
    texts = ["Yes.", "No?", "Well", "and so", "", " \t\x0b", None, "é!", "a.\n", "…", "Stop! \r", "\x85"]
    p = [0.3, 0.3, 0.08, 0.08, 0.06, 0.06, 0.06, 0.06]
    out = []
    for c in range(convs):
        n = int(rng.integers(1, most))
        at = np.cumsum(rng.integers(0, 3, n))
        for k in range(n):
            out.append((c, None if rng.random() < 0.05 else int(at[k]), rng.choice(roles, p=p), texts[int(rng.integers(len(texts)))] if rng.random() < 0.7 else f"t{k}."))
    rng.shuffle(out)
    return [(int(c), t, None if r is None else str(r), x) for c, t, r, x in out]


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_random_conversations(spark):
    rows = random_rows(1, 300, 14)
    rows += [(None, 1, "user", "Null?"), (None, None, None, None), (7000, 5, "assistant", "word " * 60_000 + "end.")]
    check(turns.repaired(turns.damaged(made(spark, rows))), rows)


def test_long_conversations_in_pieces(spark, many_ranges, monkeypatch):
    monkeypatch.setattr(turns, "PIECE_ROWS", 7)
    rows = random_rows(2, 6, 120) + random_rows(3, 3, 4)
    rows += [(50, k, "user" if k % 3 else "assistant", "same." if k % 2 else f"v{k}!") for k in range(400)]
    rows += [(51, 2, "user", "again.")] * 90 + [(51, 3, "assistant", "so.")]
    check(turns.repaired(turns.damaged(made(spark, rows))), rows)


def test_pieces_of_few_bytes(spark, many_ranges, monkeypatch):
    monkeypatch.setattr(turns, "PIECE_BYTES", 10)
    rows = random_rows(5, 20, 30)
    check(turns.repaired(turns.damaged(made(spark, rows))), rows)


def test_no_rows(spark):
    df = turns.repaired(turns.damaged(made(spark, [])))
    assert df.columns == list(COLS) and df.count() == 0


def test_dropped_conversation(spark):
    turn = next(t for t in range(1000) if zlib.crc32(f"4:{t}".encode()) % 20 == 0)
    (row,) = turns.repaired(turns.damaged(made(spark, [(4, turn, "user", "Gone.")]))).collect()
    assert tuple(row) == (4, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check(QUERIES["op11_conversation_repair"](spark, SF), rows)
