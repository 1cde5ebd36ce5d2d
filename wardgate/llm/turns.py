"""Repair of conversation structure at least cost.

A conversation's rows in order of their turns should have roles ``(s?(ua)+)?`` by their initials.  A row can be kept (0), given the
role user or assistant (1) or deleted (2), and a row with empty text inserted anywhere (5); blank rows and repeats
must go, and a truncated row that stays costs 5 more.  Among the cheapest repairs the one with the ASCII-least audit is taken,
the initials of its edits in order (D, I, K, R).

A dynamic program from the end gives the cost to go of each place and state.  Its optimal arcs form a graph in which an
edit's initial and the state decide where the arc leads, so each node has one least way on.  The nodes are ranked by prefix
doubling: first by one initial, then by the pair of their rank and the rank of the node half way, which ranks them by
audits of twice the length, with pointers that jump twice as far.  The least path of all conversations at hand is
then laid out by the doubled pointers.

Rows are counted by conversation, turn, role and text before they move; repeats are found by the first turn of each digest; and
sampled splitters deal the rows in order to ranges, each sorted by a task of its own and cut into pieces of at most ``PIECE_ROWS`` rows.
Conversations within one range, all but two a range, are solved there.  Of the others, however long, each piece becomes a
4 x 4 matrix of costs from state to state; the products from the end give each piece its cost to go, each piece its least audit
for each state it may begin in, and the pieces are chained.  Only the digest of a long conversation's repaired text is
made by one task, which reads it piece by piece.

Null roles and texts are one space.  A null conversation is a conversation; null turns come first.  Rows of one turn are ordered by role,
then by text (its first ``LEADING`` characters, then a digest), so equal rows are neighbours.  Roles other than the three can
only be changed or deleted.  A conversation without rows needs no edit.  An empty table gives no rows.  Very long texts are held one
piece at a time, of at most ``PIECE_BYTES`` besides a single row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardgate.llm.common import landed

PIECE_ROWS, PIECE_BYTES = 4096, 1 << 20
NODES = 1 << 20  # solved together
LEADING = 64
BLANK = " \t\n\x0b\f\r"
STOPS = ".!?"

INSERT, DELETE, REROLE, CUT_OFF = 5, 2, 1, 5
NEVER = 1 << 40
# States: nothing yet, after system, after user, after assistant.
ACCEPT = np.array([0, NEVER, NEVER, 0])
TURN_TO = np.array([2, 2, 3, 2])  # the role that may be put next: 2 user, 3 assistant
ROLE_OF = {2: "user", 3: "assistant"}
INITIALS = "sua"
KEEP_TO = np.full((4, 4), -1)  # by initial and state
KEEP_TO[0, 0] = 1
KEEP_TO[1, [0, 1, 3]] = 2
KEEP_TO[2, 2] = 3
FINE, EMPTY, REPEAT, TRUNCATED = range(4)
LEGAL = {(0, 1), (1, 2), (2, 1)}
EDITS = b"\0DIKR"  # label 0: the end


def damaged(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text and copies (0: dropped) after the damage that crc32 of ``conv_id:turn`` picks, one row in five."""
    space = F.lit(" ")
    named = F.concat(F.coalesce(F.col(conv_id).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn).cast("string"), space))
    kind = F.crc32(named.cast("binary")) % 20
    whole = F.coalesce(F.col(text), space)
    return rows.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(F.coalesce(F.col(role), space)).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(whole, "[.!?]", "")).otherwise(whole).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def relaxed(cost: np.ndarray) -> np.ndarray:
    """Costs to go where rows may be inserted first; the last but one axis is the state."""
    out = cost.copy()
    out[..., 2, :] = np.minimum(cost[..., 2, :], cost[..., 3, :] + INSERT)
    out[..., 3, :] = np.minimum(cost[..., 3, :], cost[..., 2, :] + INSERT)
    out[..., :2, :] = np.minimum(cost[..., :2, :], out[..., 2:3, :] + INSERT)
    return out


def costs_to_go(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(place, conversation, state, end) cost from each place; ``codes`` stand at the right, ``ends`` is (conversation, state, end)."""
    n, size = codes.shape
    out = np.full((size + 1, *ends.shape), NEVER)
    out[size] = ends
    state, which = np.arange(4), np.arange(n)[:, None]
    for i in range(size - 1, -1, -1):
        keep_to, keep, rerole = _ways(codes[:, i])
        after = out[i + 1]
        best = np.minimum(after + DELETE, after[which, keep_to[:, state]] + keep[:, :, None])
        best = np.minimum(best, after[:, TURN_TO] + rerole[:, None, None])
        out[i] = relaxed(np.minimum(best, NEVER))
    return out


def _ways(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where keeping a row leads from each state, what it costs, and what a new role costs."""
    fault, initial = code >> 2, code & 3
    stays = np.where(fault == FINE, 0, np.where(fault == TRUNCATED, CUT_OFF, NEVER))
    to = KEEP_TO[initial]
    return np.maximum(to, 0), np.where(to < 0, NEVER, stays[:, None]), stays + REROLE


def least_paths(codes: np.ndarray, lengths: np.ndarray, cost: np.ndarray, last: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels and states along the ASCII-least optimal path of each conversation from each entry state.

    ``cost`` is (place, conversation, state).  Nodes are numbered by place, conversation and state.  Returns two arrays (conversation, entry,
    step); label 0 is the end, where the state stays what it is.
    """
    places, n, _ = cost.shape
    node = np.arange(places * n * 4).reshape(cost.shape)
    label, to = np.zeros(cost.shape, np.int64), node.copy()

    def arc(at: slice, initial: int, price: np.ndarray, there: np.ndarray, target: np.ndarray) -> None:
        """Takes an arc where it is optimal and no arc with a smaller initial was."""
        fits = (label[at] == 0) & (price + there == cost[at]) & (cost[at] < NEVER)
        label[at][fits] = initial
        to[at][fits] = target[fits]

    for i in range(places):
        at = slice(i, i + 1)
        inserted = cost[i][:, TURN_TO][None], node[i][:, TURN_TO][None]
        if i == places - 1:
            arc(at, 2, np.where(last[:, None], INSERT, NEVER)[None], *inserted)
            continue
        keep_to, keep, rerole = _ways(codes[:, i])
        arc(at, 1, np.full((1, n, 4), DELETE), cost[i + 1][None], node[i + 1][None])
        arc(at, 2, np.full((1, n, 4), INSERT), *inserted)
        kept = np.take_along_axis(cost[i + 1], keep_to, 1)[None], np.take_along_axis(node[i + 1], keep_to, 1)[None]
        arc(at, 3, keep[None], *kept)
        arc(at, 4, np.broadcast_to(rerole[None, :, None], (1, n, 4)), cost[i + 1][:, TURN_TO][None], node[i + 1][:, TURN_TO][None])

    first, rank, pointers = label.ravel(), label.ravel(), [to.ravel()]
    while (rank[pointers[-1]] > 0).any():  # audits of twice the length
        jump = pointers[-1]
        rank = np.unique(rank * (int(rank.max()) + 1) + rank[jump], return_inverse=True)[1]
        pointers.append(jump[jump])
    begin = (places - 1 - lengths)[:, None]
    path = node[begin, np.arange(n)[:, None], entries][:, :, None]
    for jump in pointers:
        path = np.concatenate([path, jump[path]], axis=2)
    return first[path], path & 3


def batches_of(sizes: list[int]) -> Iterator[list[int]]:
    """Indices of conversations of similar length, as many as fit into ``NODES`` nodes."""
    order = sorted(range(len(sizes)), key=sizes.__getitem__)
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end - at + 1) * (sizes[order[end]] + 1) * 4 <= NODES:
            end += 1
        yield order[at:end]
        at = end


def _right_aligned(codes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(c) for c in codes])
    table = np.zeros((len(codes), int(lengths.max())), np.int64)
    for k, c in enumerate(codes):
        table[k, table.shape[1] - len(c) :] = np.frombuffer(c, np.uint8)
    return table, lengths


def solved(codes: list[bytes], ends: np.ndarray, last: np.ndarray, entries: list[int]) -> list[tuple[int, list[tuple[bytes, list[int]]]]]:
    """(cost from the first entry, for each entry the audit and the states after its edits) of each list of row codes."""
    out: list = [None] * len(codes)
    for some in batches_of([len(c) for c in codes]):
        table, lengths = _right_aligned([codes[k] for k in some])
        goal = ends[some]
        goal = np.where(last[some][:, None], relaxed(goal[:, :, None])[:, :, 0], goal)
        cost = costs_to_go(table, goal[:, :, None])[..., 0]
        labels, states = least_paths(table, lengths, cost, last[some], np.tile(entries, (len(some), 1)))
        audits = np.frombuffer(EDITS, np.uint8)[labels]
        for b, k in enumerate(some):
            ways = []
            for e in range(len(entries)):
                audit = audits[b, e].tobytes().rstrip(b"\0")
                ways.append((audit, states[b, e, 1 : len(audit) + 1].tolist()))
            out[k] = int(cost[len(cost) - 1 - lengths[b], b, entries[0]]), ways
    return out


def matrices(codes: list[bytes]) -> list[list[int]]:
    """Cost from each state before the rows to each state after them, as 16 numbers."""
    out: list = [None] * len(codes)
    unit = np.where(np.eye(4, dtype=bool), 0, NEVER)
    for some in batches_of([4 * len(c) for c in codes]):
        table, lengths = _right_aligned([codes[k] for k in some])
        cost = costs_to_go(table, np.tile(unit, (len(some), 1, 1)))
        for b, k in enumerate(some):
            out[k] = cost[len(cost) - 1 - lengths[b], b].ravel().tolist()
    return out


def repaired_lines(codes: bytes, roles: list[str], texts: list[str], audit: bytes, states: list[int]) -> Iterator[str]:
    """``role:text`` of the rows that the edits leave; roles and texts are those of the rows that may stay."""
    stay, at = zip(roles, texts, strict=True), 0
    for edit, state in zip(audit.decode(), states, strict=True):
        if edit == "I":
            yield f"{ROLE_OF[state]}:"
            continue
        role, text = next(stay) if codes[at] >> 2 in (FINE, TRUNCATED) else ("", "")
        at += 1
        if edit != "D":
            yield f"{role if edit == 'K' else ROLE_OF[state]}:{text}"


def code_of(role: str, text: str, again: bool) -> int:
    fault = EMPTY if not text.strip(BLANK) else REPEAT if again else FINE if text.rstrip(BLANK)[-1] in STOPS else TRUNCATED
    return 4 * fault + (INITIALS.find(role[0]) % 4 if role else 3)


PIECE = pa.schema(
    [
        ("conv", pa.string()), ("range", pa.int64()), ("seq", pa.int64()), ("alone", pa.bool_()), ("codes", pa.binary()),
        ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64()),
    ]
)
PIECE_DDL = (
    "conv string, range long, seq long, alone boolean, codes binary, roles array<string>, texts array<string>, low long, high long, turns long"
)
RESULT_DDL = (
    "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)
RESULT = pa.schema([(x.split()[0], pa.int64() if x.endswith("long") else pa.string()) for x in RESULT_DDL.split(", ")])


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


class _Cutter:
    """Pieces of the rows of a sorted range."""

    def __init__(self, part: int):
        self.part, self.seq, self.out = part, 0, []
        self.begin(None)

    def begin(self, conv: str | None) -> None:
        self.conv, self.codes, self.roles, self.texts = conv, bytearray(), [], []
        self.low = self.high = None
        self.turns = self.size = 0

    def end(self, alone: bool) -> None:
        self.out.append(
            {
                "conv": self.conv, "range": self.part, "seq": self.seq, "alone": alone, "codes": bytes(self.codes), "roles": self.roles,
                "texts": self.texts, "low": self.low, "high": self.high, "turns": self.turns,
            }
        )
        self.seq += 1
        self.begin(self.conv)

    def add(self, turn: int | None, role: str, text: str, copies: int, again: bool) -> None:
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        while copies:
            code = code_of(role, text, again)
            if code >> 2 in (FINE, TRUNCATED):
                self.roles.append(role)
                self.texts.append(text)
                self.size += len(text)
                self.codes.append(code)
                copies, again = copies - 1, True
            else:
                some = min(copies, max(1, PIECE_ROWS - len(self.codes)))
                self.codes += bytes([code]) * some
                copies -= some
            if copies and len(self.codes) >= PIECE_ROWS:
                high = self.high
                self.end(False)
                self.low, self.high = turn, high


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of sorted rows; ``alone`` marks conversations that are whole within the range."""
    c = _Cutter(TaskContext.get().partitionId())
    started, opened, split = False, True, False
    for b in batches:
        for conv, turn, role, text, copies, again in zip(*(b[x].to_pylist() for x in ("conv", "turn", "role", "text", "copies", "again")), strict=True):
            if not started or conv != c.conv:
                if started:
                    c.end(not (opened or split))
                    opened = False
                c.begin(conv)
                started, split = True, False
            elif len(c.codes) >= PIECE_ROWS or c.size >= PIECE_BYTES:
                high = c.high
                c.end(False)
                c.high, split = high, True
            before = c.seq
            c.add(turn, role, text, copies, again)
            split |= c.seq > before
        if len(c.out) >= 256:
            yield _batch(c.out, PIECE)
            c.out = []
    if started:
        c.end(False)
    yield _batch(c.out, PIECE)


def _counts(codes: bytes) -> dict[str, int]:
    faults = np.frombuffer(codes, np.uint8) >> 2
    initials = [x & 3 for x in codes]
    names = {"blank": EMPTY, "duplicate": REPEAT, "truncated": TRUNCATED}
    return {k: int((faults == v).sum()) for k, v in names.items()} | {
        "illegal": sum(pair not in LEGAL for pair in zip(initials, initials[1:], strict=False))
    }


def _whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of conversations of one piece."""
    for b in batches:
        rows = b.to_pylist()
        n = len(rows)
        if not n:
            continue
        found = solved([r["codes"] for r in rows], np.tile(ACCEPT, (n, 1)), np.ones(n, bool), [0])
        out = []
        for r, (cost, ((audit, states),)) in zip(rows, found, strict=True):
            lines = repaired_lines(r["codes"], r["roles"], r["texts"], audit, states)
            out.append(
                {
                    "conv": r["conv"],
                    "gaps": 0 if r["low"] is None else r["high"] - r["low"] + 1 - r["turns"],
                    **_counts(r["codes"]),
                    "cost": cost,
                    "audit": audit.decode(),
                    "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
                }
            )
        yield _batch(out, RESULT)


def _long(pieces: DataFrame) -> DataFrame:
    """Results of conversations in several pieces: matrices, costs to go, audits for each entry, and the chain of pieces."""
    codes = pieces.select("conv", "range", "seq", "codes")
    number = {"matrix": "array<long>", "ends": "array<long>", "audits": "array<binary>", "exits": "array<int>"}
    keys = [("conv", pa.string()), ("range", pa.int64()), ("seq", pa.int64())]

    def priced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*keys, ("matrix", pa.list_(pa.int64()))])
        for b in batches:
            rows = b.to_pylist()
            found = matrices([r.pop("codes") for r in rows]) if rows else []
            yield _batch([r | {"matrix": m} for r, m in zip(rows, found, strict=True)], schema)

    def followed(group: pa.Table) -> pa.Table:
        """Costs to go after each piece of a conversation: products from its end."""
        rows = sorted(group.to_pylist(), key=lambda r: (r["range"], r["seq"]))
        go, last = ACCEPT, True
        for r in reversed(rows):
            m = np.array(r.pop("matrix")).reshape(4, 4)
            r |= {"ends": go.tolist(), "last": last}
            go = relaxed(go[:, None])[:, 0] if last else go
            go, last = np.minimum((m + go).min(axis=1), NEVER), False
        schema = pa.schema([*keys, ("ends", pa.list_(pa.int64())), ("last", pa.bool_())])
        return pa.Table.from_pylist(rows, schema)

    def audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*keys, ("audits", pa.list_(pa.binary())), ("exits", pa.list_(pa.int32())), ("cost", pa.int64())])
        for b in batches:
            rows = b.to_pylist()
            if not rows:
                continue
            ends, last = np.array([r["ends"] for r in rows]), np.array([r["last"] for r in rows])
            out = []
            for r, (cost, ways) in zip(rows, solved([r["codes"] for r in rows], ends, last, [0, 1, 2, 3]), strict=True):
                exits = [states[-1] if states else e for e, (_, states) in enumerate(ways)]
                out.append({k: r[k] for k, _ in keys} | {"audits": [a for a, _ in ways], "exits": exits, "cost": cost})
            yield _batch(out, schema)

    def entered(group: pa.Table) -> pa.Table:
        """The state each piece begins in, from the first piece on."""
        state, cost, out = 0, None, []
        for r in sorted(group.to_pylist(), key=lambda r: (r["range"], r["seq"])):
            cost = r["cost"] if cost is None else cost
            out.append({k: r[k] for k, _ in keys} | {"entry": state, "total": cost})
            state = r["exits"][state]
        return pa.Table.from_pylist(out, pa.schema([*keys, ("entry", pa.int32()), ("total", pa.int64())]))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in b.to_pylist())
        for conv, own in groupby(rows, key=lambda r: r["conv"]):
            yield _batch([_chained(conv, own)], RESULT)

    key = "conv string, range long, seq long"
    priced_ = landed(codes.mapInArrow(priced, f"{key}, matrix {number['matrix']}"), "piece-costs")
    ends = landed(priced_.groupBy("conv").applyInArrow(followed, f"{key}, ends {number['ends']}, last boolean"), "piece-ends")
    known = codes.join(ends.drop("conv"), ["range", "seq"]).select("conv", "range", "seq", "codes", "ends", "last")
    audits = landed(known.mapInArrow(audited, f"{key}, audits {number['audits']}, exits {number['exits']}, cost long"), "piece-audits")
    entries = landed(
        audits.select("conv", "range", "seq", "exits", "cost").groupBy("conv").applyInArrow(entered, f"{key}, entry int, total long"), "piece-entries"
    )
    chosen = audits.join(entries.drop("conv"), ["range", "seq"]).select("range", "seq", "entry", "total", F.get("audits", "entry").alias("audit"))
    whole = pieces.join(chosen, ["range", "seq"])
    return whole.repartition("conv").sortWithinPartitions("conv", "range", "seq").mapInArrow(joined, RESULT_DDL)


def _states(codes: bytes, audit: bytes, state: int) -> list[int]:
    """States after each edit from ``state`` on."""
    out, at = [], 0
    for edit in audit:
        if edit in b"RI":
            state = int(TURN_TO[state])
        elif edit in b"K":
            state = int(KEEP_TO[codes[at] & 3, state])
        at += edit not in b"I"
        out.append(state)
    return out


def _chained(conv: str | None, pieces: Iterable[dict]) -> dict:
    """Result of one conversation from its pieces in order, held one at a time."""
    digest, any_line = hashlib.sha256(), False
    out = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
    audit, low, high, turns, before, cost = [], None, None, 0, None, 0
    for p in pieces:
        cost = p["total"]
        for k, v in _counts(p["codes"]).items():
            out[k] += v
        if p["codes"]:
            out["illegal"] += before is not None and (before, p["codes"][0] & 3) not in LEGAL
            before = p["codes"][-1] & 3
        if p["low"] is not None:
            # a piece of the same range knows the turn before it, the first one of a range does not
            turns += p["turns"] - (p["seq"] == 0 and p["turns"] > 0 and high == p["low"])
            low, high = p["low"] if low is None else low, p["high"]
        audit.append(p["audit"])
        for line in repaired_lines(p["codes"], p["roles"], p["texts"], p["audit"], _states(p["codes"], p["audit"], p["entry"])):
            digest.update(("\n" * any_line + line).encode())
            any_line = True
    return {
        "conv": conv, "gaps": 0 if low is None else high - low + 1 - turns, **out, "cost": cost,
        "audit": b"".join(audit).decode(), "repaired_sha256": digest.hexdigest(),
    }


def in_pieces(rows: DataFrame) -> DataFrame:
    """Pieces of the conversations in ``rows`` (conv_id, turn, role, text, copies), landed."""
    there = F.col("copies") > 0
    lines = rows.select(
        F.col("conv_id").cast("string").alias("conv"),
        there.alias("there"),
        F.when(there, F.col("turn")).cast("long").alias("turn"),
        F.when(there, F.coalesce("role", F.lit(" "))).otherwise("").alias("role"),
        F.when(there, F.coalesce("text", F.lit(" "))).otherwise("").alias("text"),
        "copies",
    )
    named = F.when(F.col("conv").isNull(), "").otherwise(F.concat(F.lit("="), "conv"))
    said = F.unhex(F.sha2(F.concat(F.length(named).cast("string"), F.lit(":"), named, F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    lines = landed(
        lines.groupBy("conv", "there", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumn("said", said), "lines"
    )
    turn = F.struct(F.col("turn").isNotNull().alias("is"), F.col("turn").alias("at"))
    firsts = lines.where("there").groupBy("said").agg(F.min(turn).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = (
        lines.where("there").select("said", turn.alias("t")).join(firsts, "said").where(~F.col("t").eqNullSafe(F.col("first")))
        .select(F.col("said").alias("s"), F.col("t.at").alias("t"), F.lit(True).alias("again"))
    )
    known = lines.join(again, (F.col("said") == F.col("s")) & F.col("turn").eqNullSafe(F.col("t")), "left")
    order: list[Column] = [
        F.asc_nulls_first("conv"), F.asc("there"), F.asc_nulls_first("turn"), F.asc("role"), F.asc(F.substring("text", 1, LEADING)), F.asc("said"),
    ]
    ranged = known.select("conv", "there", "turn", "role", "text", "said", "copies", F.coalesce("again", F.lit(False)).alias("again"))
    cut = ranged.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_cut, PIECE_DDL)
    return landed(cut, "pieces")


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, fault counts, cost, audit and digest of the repair of each conversation in ``rows``.

    ``rows`` has conv_id, turn, role, text and copies: how often the row is there; 0 only says that the conversation exists.
    """
    pieces = in_pieces(rows)
    short = pieces.where("alone").mapInArrow(_whole, RESULT_DDL)
    out = short.union(_long(pieces.where("NOT alone")))
    return out.withColumn("conv", F.col("conv").cast(rows.schema["conv_id"].dataType)).withColumnRenamed("conv", "conv_id")
