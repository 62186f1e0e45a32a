"""Repair of the role structure of damaged conversations by a run-length dynamic program.

A conversation's rows are taken by turn (nulls first), then role, then text. Each row is a symbol: the initial of its role
(s, u, a or another) and its first fault (none, truncated, or one that must be deleted). Keep, Rerole, Delete and Insert are
steps between four states (nothing yet, after s, after u, after a), so a symbol is a 4 x 4 matrix of the min-plus algebra.
Equal neighbouring symbols are one run, which is advanced through binary powers of its matrix; powers, and the choices of
a power of rows from a state with given costs ahead, are kept and used again. The choices are then unrolled for the audit.

Equal rows of one turn are counted before anything is shuffled by conversation, and the first turn of a text that a
conversation has at several turns is found by grouping. Rows are dealt by range, so a conversation of any length spreads
over tasks. One that lies inside a task's range is solved there; the others are cut in segments of bounded size, whose
matrices give the costs ahead of each segment and then the state at its start; only the last step, the hash of a repaired
conversation, streams its segments through one task.

Null roles and texts are one space; a null conv_id is a conversation of its own, null turns come first. A role without
characters has no initial: it can't be kept and makes its neighbours illegal. Rows that repeat are duplicates. Conversations
without rows give zeros and an empty audit. Differences of turns beyond a long give a null in gaps. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, discard, in_slices, materialize, partitions, table

#: Rows and characters of a segment at most (a longer single text is a segment of its own).
SEGMENT_ROWS, SEGMENT_CHARS = 4096, 4 << 20

NEVER = 1 << 60
#: States: nothing yet, after s, after u, after a. Where the next role leads, and what it is when it is chosen freely.
NEXT, ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
KEEPS = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
FINE, TRUNCATED, REMOVED = range(3)
DELETE, INSERT, REROLE, CUT = 2, 5, 1, 5

Vector = tuple[int, ...]
Symbol = tuple[str, int]


def with_inserts(ahead: Vector) -> Vector:
    """Costs ahead when any number of rows may be inserted first; more than two in a row never help."""
    for _ in range(2):
        ahead = tuple(min(ahead[s], INSERT + ahead[NEXT[s]]) for s in range(4))
    return ahead


#: Costs ahead after the last row.
END = with_inserts((0, NEVER, NEVER, 0))


def steps(symbol: Symbol, state: int) -> list[tuple[str, int, int]]:
    """(initial, cost, next state) of what can be done with a row, in ASCII order."""
    initial, fault = symbol
    out = [("D", DELETE, state)]
    if fault != REMOVED:
        more = CUT if fault == TRUNCATED else 0
        if (initial, state) in KEEPS:
            out.append(("K", more, KEEPS[initial, state]))
        out.append(("R", REROLE + more, NEXT[state]))
    return out


@lru_cache(maxsize=None)  # 12 symbols, some 60 powers
def power(symbol: Symbol, k: int) -> tuple[Vector, ...]:
    """Costs from state to state over 2^k rows of a symbol, inserts before each row included."""
    if k:
        half = power(symbol, k - 1)
        return times(half, half)
    rows = []
    for state in range(4):
        cost = [NEVER] * 4
        for _, c, to in steps(symbol, state):
            cost[to] = min(cost[to], c)
        rows.append(cost)
    cols = [with_inserts(tuple(r[t] for r in rows)) for t in range(4)]
    return tuple(zip(*cols, strict=True))


def times(a: tuple[Vector, ...], b: tuple[Vector, ...]) -> tuple[Vector, ...]:
    return tuple(tuple(min(NEVER, *(x + y[t] for x, y in zip(row, b, strict=True))) for t in range(4)) for row in a)


def before(symbol: Symbol, k: int, ahead: Vector) -> Vector:
    """Costs ahead of 2^k rows from those behind them."""
    return tuple(min(NEVER, *(x + y for x, y in zip(row, ahead, strict=True))) for row in power(symbol, k))


def _level(ahead: Vector) -> Vector:
    """Costs less their least: choices depend on differences alone."""
    least = min(ahead)
    return tuple(NEVER if x >= NEVER else x - least for x in ahead)


@lru_cache(maxsize=50_000)
def choices(symbol: Symbol, k: int, ahead: Vector, state: int) -> tuple[str, int]:
    """The ASCII-least cheapest choices over 2^k rows of a symbol, and the state after them."""
    if k:
        middle = _level(before(symbol, k - 1, ahead))
        first, state = choices(symbol, k - 1, middle, state)
        second, state = choices(symbol, k - 1, ahead, state)
        return first + second, state
    out, own = "", before(symbol, 0, ahead)
    while True:
        insert = [("I", INSERT + own[NEXT[state]], -1)]
        delete, *rest = [(x, c + ahead[to], to) for x, c, to in steps(symbol, state)]
        x, _, to = next(e for e in (delete, *insert, *rest) if e[1] == own[state])
        out += x
        if x != "I":
            return out, to
        state = NEXT[state]


Runs = tuple[tuple[Symbol, int], ...]


def _pieces(runs: Runs) -> list[tuple[Symbol, int]]:
    """The binary powers of each run."""
    return [(symbol, k) for symbol, n in runs for k in range(n.bit_length()) if n >> k & 1]


def matrix(runs: Runs) -> tuple[Vector, ...]:
    whole = tuple(tuple(0 if s == t else NEVER for t in range(4)) for s in range(4))
    for symbol, k in _pieces(runs):
        whole = times(whole, power(symbol, k))
    return whole


@lru_cache(maxsize=50_000)
def unrolled(runs: Runs, ahead: Vector, state: int, last: bool) -> tuple[str, int]:
    """The choices over all runs from a state on, and the state after them; `last`: rows are inserted where the end needs them."""
    pieces, costs = _pieces(runs), [ahead]
    for symbol, k in reversed(pieces):
        costs.append(_level(before(symbol, k, costs[-1])))
    out = []
    for (symbol, k), behind in zip(pieces, costs[-2::-1], strict=True):
        more, state = choices(symbol, k, _level(behind), state)
        out.append(more)
    while last and state in (1, 2):
        out.append("I")
        state = NEXT[state]
    return "".join(out), state


def total(runs: Runs) -> int:
    ahead = END
    for symbol, k in reversed(_pieces(runs)):
        ahead = before(symbol, k, ahead)
    return ahead[0]


def repaired(rows: list[tuple[str, str, int]], audit: str, state: int) -> list[str]:
    """The lines role:text that an audit makes of rows (role, text, copies) from a state on."""
    out = []
    left = itertools.chain.from_iterable(itertools.repeat(r[:2], r[2]) for r in rows)
    for x in audit:
        if x == "I":
            out.append(f"{ROLE[state]}:")
            state = NEXT[state]
            continue
        role, text = next(left)
        if x == "K":
            out.append(f"{role}:{text}")
            state = KEEPS[role[0], state]
        elif x == "R":
            out.append(f"{ROLE[state]}:{text}")
            state = NEXT[state]
    return out


LEGAL = {"su", "ua", "au"}
COUNTS = ("blank", "duplicate", "truncated", "illegal")


class Segment:
    """Rows of one conversation in order: runs of symbols, counts, turns and texts."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.rows, self.runs, self.chars = conv_id, [], [], 0
        self.count = dict.fromkeys(COUNTS, 0)
        self.first = self.last = ""
        self.turns: list[int] = []  # least, largest, number of them
        self.size = 0

    def put(self, turn: int | None, role: str, text: str, n: int, new: bool) -> None:
        """n equal rows; new: the first of them is not a duplicate."""
        if not n:
            return
        end, initial = text.rstrip(SPACE), role[:1] if role[:1] in ("s", "u", "a") else "x"
        if not end:
            faults = [("blank", REMOVED, n)]
        else:
            cut = end[-1] not in ".!?"
            faults = [("truncated" if cut else "", TRUNCATED if cut else FINE, int(new)), ("duplicate", REMOVED, n - new)]
        for name, fault, m in faults:
            if m:
                if name:
                    self.count[name] += m
                symbol = (initial, fault) if fault != REMOVED else ("x", REMOVED)
                if self.runs and self.runs[-1][0] == symbol:
                    self.runs[-1] = (symbol, self.runs[-1][1] + m)
                else:
                    self.runs.append((symbol, m))
        self.count["illegal"] += n - 1 + (self.size > 0 and self.last + initial not in LEGAL)
        self.first = self.first or initial
        self.last = initial
        self.size += n
        self.rows.append((role, text, n))
        self.chars += len(text)
        if turn is not None:
            if not self.turns:
                self.turns = [turn, turn, 1]
            elif turn != self.turns[1]:
                self.turns = [self.turns[0], turn, self.turns[2] + 1]

    @property
    def full(self) -> bool:
        return len(self.rows) >= SEGMENT_ROWS or self.chars >= SEGMENT_CHARS


def _gaps(turns: list[int]) -> int | None:
    gaps = turns[1] - turns[0] + 1 - turns[2] if turns else 0
    return gaps if gaps < 1 << 63 else None


_RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_STORED = _RESULT + ", seg long, ends string, turns array<long>, runs binary, costs array<long>, rows array<struct<role: string, text: string, n: long>>"
_KINDS = {
    "conv_id": pa.int64(), "audit": pa.string(), "repaired_sha256": pa.string(), "seg": pa.int64(), "ends": pa.string(), "turns": pa.list_(pa.int64()), "runs": pa.binary(), "costs": pa.list_(pa.int64()),
    "rows": pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("n", pa.int64())])),
}


def _batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ") if ": " not in c or c.startswith("rows ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], _KINDS.get(n, pa.int64())) for n in names], names=names)


def _solved(s: Segment) -> dict:
    runs = tuple(s.runs)
    audit, _ = unrolled(runs, END, 0, True)
    text = "\n".join(repaired(s.rows, audit, 0)).encode()
    return {"conv_id": s.conv_id, "gaps": _gaps(s.turns), **s.count, "cost": total(runs), "audit": audit, "repaired_sha256": hashlib.sha256(text).hexdigest()}


def _pack(runs: Runs) -> bytes:
    return ",".join(f"{c}{f}{n}" for (c, f), n in runs).encode()


def _unpack(data: bytes) -> Runs:
    return tuple(((x[0], int(x[1])), int(x[2:])) for x in data.decode().split(",") if x)


def _open(s: Segment, seg: int) -> dict:
    rows = [{"role": r, "text": t, "n": n} for r, t, n in s.rows]
    costs = [x for row in matrix(tuple(s.runs)) for x in row]
    return {"conv_id": s.conv_id, **s.count, "seg": seg, "ends": s.first + s.last, "turns": s.turns, "runs": _pack(tuple(s.runs)), "costs": costs, "rows": rows}


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Solves the conversations inside this range of rows; those at its ends, or of several segments, come out as segments."""
    at, out, chars = TaskContext.get().partitionId() << 32, [], 0
    now: Segment | None = None
    whole = False  # now is all of a conversation that began in this range
    for batch in itertools.chain(in_slices(batches, 1000), [None]):
        columns = zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True) if batch is not None else []
        for conv_id, turn, role, text, n, new in columns:
            fresh = now is None or now.conv_id != conv_id
            if fresh or now.full:
                if now is not None:
                    done = _solved(now) if whole and fresh else _open(now, at)
                    chars += len(done.get("audit") or "") + now.chars * (not whole or not fresh)
                    out.append(done)
                    at += 1
                whole = fresh and now is not None
                now = Segment(conv_id)
            now.put(turn, role, text, n, new)
            if len(out) >= 1000 or chars >= SEGMENT_CHARS:
                yield _batch(out, _STORED)
                out, chars = [], 0
    if now is not None:
        out.append(_open(now, at))
        yield _batch(out, _STORED)


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): rows after damage, n copies of each; those that are dropped stay with n = 0."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    role, text, kind = F.coalesce("role", space), F.coalesce("text", space), F.col("_kind")
    return (
        rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"), (F.crc32(key.cast("binary")) % 20).alias("_kind"))
        .select(
            "conv_id", F.when(kind != 0, F.col("turn")).alias("turn"),
            F.when(kind == 0, "").when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(kind.isin(0, 1), "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
            F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("n"),
        )
    )


def repair(rows: DataFrame) -> DataFrame:
    """Repairs conversations given as (conv_id, turn, role, text, n), n equal rows each; one result a conversation."""
    spark = rows.sparkSession
    own = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    rows = rows.withColumn("_key", F.when(F.col("n") > 0, F.unhex(own)))
    counted = rows.groupBy("conv_id", "turn", "_key").agg(F.sum("n").alias("n"), F.first("role").alias("role"), F.first("text").alias("text"))
    counted = materialize(counted, "equal-rows")
    # texts that a conversation has at several turns: new at the first of them only
    again = counted.groupBy("conv_id", "_key").agg(F.min(F.struct("turn")).alias("_first"), F.count("*").alias("_turns")).filter("_turns > 1").select(F.col("conv_id").alias("_conv"), F.col("_key").alias("_of"), "_first")
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_key") == F.col("_of"))
    new = F.col("_first").isNull() | F.col("_first")["turn"].eqNullSafe(F.col("turn"))
    told = counted.join(again, same, "left").select("conv_id", "turn", "role", "text", "n", new.alias("new"))
    head = F.substring("text", 1, 32)
    # rows of one range come in order; the first characters of a text keep the sampled keys small
    dealt = told.repartitionByRange(partitions(spark), "conv_id", "turn", "role", head).sortWithinPartitions("conv_id", "turn", "role", "text")
    stored = materialize(dealt.mapInArrow(_segments, _STORED), "conversations")
    discard(counted)
    names = [c.split()[0] for c in _RESULT.split(", ")]
    return stored.filter("seg IS NULL").select(*names).unionByName(_joined(stored.filter("seg IS NOT NULL")))


def _joined(parts: DataFrame) -> DataFrame:
    """The results of conversations that lie in several segments."""

    def ahead(t: pa.Table) -> pa.Table:
        """Costs behind each segment, from the last to the first."""
        order = sorted(range(t.num_rows), key=t.column("seg").to_pylist().__getitem__)
        seg, costs = t.column("seg").to_pylist(), t.column("costs").to_pylist()
        behind, out = END, []
        for k in reversed(order):
            out.append((seg[k], list(behind), k == order[-1], k == order[0], min(costs[k][s] + behind[s] for s in range(4))))
            behind = tuple(min(NEVER, *(costs[k][4 * s + u] + behind[u] for u in range(4))) for s in range(4))
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.bool_(), pa.bool_(), pa.int64())
        return pa.table([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=["seg", "behind", "last", "leads", "cost"])

    behind = materialize(parts.select("conv_id", "seg", "costs").groupBy("conv_id").applyInArrow(ahead, "seg long, behind array<long>, last boolean, leads boolean, cost long"), "costs-behind")

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            to = [[unrolled(_unpack(r), tuple(v), s, last)[1] for s in range(4)] for r, v, last in zip(*(b.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(to, pa.list_(pa.int64()))], names=["conv_id", "seg", "to"])

    def entries(t: pa.Table) -> pa.Table:
        state, out = 0, []
        for seg, to in sorted(zip(t.column("seg").to_pylist(), t.column("to").to_pylist(), strict=True)):
            out.append((seg, state))
            state = to[state]
        return pa.table([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["seg", "state"])

    states = parts.join(behind, "seg").select("conv_id", "seg", "runs", "behind", "last").mapInArrow(exits, "conv_id long, seg long, to array<long>").groupBy("conv_id").applyInArrow(entries, "seg long, state long")
    told = materialize(states.join(behind, "seg"), "states")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches, 8):
            names = b.schema.names
            audits, lines = [], []
            for runs, v, state, last, rows in zip(*(b.column(names.index(n)).to_pylist() for n in ("runs", "behind", "state", "last", "rows")), strict=True):
                audit, _ = unrolled(_unpack(runs), tuple(v), state, last)
                audits.append(audit)
                found = repaired([(r["role"], r["text"], r["n"]) for r in rows], audit, state)
                lines.append("\n".join(found).encode() if found else None)
            keep = [b.column(names.index(n)) for n in _PIECE[:-2]]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(audits, pa.string()), pa.array(lines, pa.binary())], names=_PIECE)

    pieces = parts.join(told.drop("conv_id"), "seg", "inner").drop(parts["cost"]).mapInArrow(made, _PIECES)
    ordered = pieces.repartition(partitions(parts.sparkSession), "conv_id").sortWithinPartitions("conv_id", "seg")
    return ordered.mapInArrow(_closed, _RESULT)


_PIECES = "conv_id long, seg long, leads boolean, cost long, blank long, duplicate long, truncated long, illegal long, ends string, turns array<long>, audit string, lines binary"
_PIECE = [c.split()[0] for c in _PIECES.split(", ")]


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Puts the segments of each conversation together, one after the other."""
    now: dict | None = None

    def closed(c: dict) -> pa.RecordBatch:
        return _batch([{**c, "gaps": _gaps(c["turns"]), "audit": "".join(c["audit"]), "repaired_sha256": c["hash"].hexdigest()}], _RESULT)

    for b in in_slices(batches, 8):
        for r in b.to_pylist():
            if r["leads"]:
                if now:
                    yield closed(now)
                now = {"conv_id": r["conv_id"], "cost": r["cost"], **dict.fromkeys(COUNTS, 0), "turns": [], "audit": [], "hash": hashlib.sha256(), "any": False, "last": ""}
            for n in COUNTS:
                now[n] += r[n]
            if r["ends"]:
                now["illegal"] += bool(now["last"]) and now["last"] + r["ends"][0] not in LEGAL
                now["last"] = r["ends"][1]
            if r["turns"]:
                low, high, m = r["turns"]
                now["turns"] = [now["turns"][0], high, now["turns"][2] + m - (low == now["turns"][1])] if now["turns"] else [low, high, m]
            now["audit"].append(r["audit"])
            if r["lines"] is not None:
                now["hash"].update((b"\n" if now["any"] else b"") + r["lines"])
                now["any"] = True
    if now:
        yield closed(now)


def op11_run_length_repair(spark, sf_dir: str) -> DataFrame:
    """Every conversation after the fixed damage, with its faults and its cheapest repair."""
    return repair(damaged(table(spark, sf_dir, "conversations")))


OP11_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
           lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t
), kinds AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce(
           list_prepend(4294967295, list_transform(range(1, length(key) + 1), lambda i: ascii(key[i])::BIGINT)),
           lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 20 AS kind
  FROM (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations), crc_table
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds WHERE kind <> 0
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
         CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END AS i,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS stripped
  FROM damaged
), told AS (
  SELECT *, lag(i) OVER (PARTITION BY conv_id ORDER BY pos) || i AS pair,
         CASE WHEN stripped = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'd'
              WHEN right(stripped, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault
  FROM ordered
), counts AS (
  SELECT conv_id, coalesce(max(turn)::HUGEINT - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
         count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
         count(*) FILTER (WHERE fault = 't') AS truncated,
         count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM told GROUP BY conv_id
), walk AS (
  SELECT conv_id, n AS pos, {'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]} AS v0, {'c': 10::BIGINT, 'a': 'II', 't': ['user:', 'assistant:']} AS v1,
         {'c': 5::BIGINT, 'a': 'I', 't': ['assistant:']} AS v2, {'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]} AS v3
  FROM counts
  UNION ALL
  SELECT conv_id, pos - 1,
         list_min([b0, {'c': b2.c + 5, 'a': 'I' || b2.a, 't': list_prepend('user:', b2.t)},
                   {'c': b3.c + 10, 'a': 'II' || b3.a, 't': ['user:', 'assistant:'] || b3.t}]),
         list_min([b1, {'c': b2.c + 5, 'a': 'I' || b2.a, 't': list_prepend('user:', b2.t)},
                   {'c': b3.c + 10, 'a': 'II' || b3.a, 't': ['user:', 'assistant:'] || b3.t}]),
         list_min([b2, {'c': b3.c + 5, 'a': 'I' || b3.a, 't': list_prepend('assistant:', b3.t)}]),
         list_min([b3, {'c': b2.c + 5, 'a': 'I' || b2.a, 't': list_prepend('user:', b2.t)}])
  FROM (
    SELECT conv_id, pos,
      list_min([{'c': v0.c + 2, 'a': 'D' || v0.a, 't': v0.t}, CASE WHEN stays AND i = 's' THEN {'c': v1.c + more, 'a': 'K' || v1.a, 't': list_prepend(line, v1.t)} END,
                CASE WHEN stays AND i = 'u' THEN {'c': v2.c + more, 'a': 'K' || v2.a, 't': list_prepend(line, v2.t)} END,
                CASE WHEN stays THEN {'c': v2.c + more + 1, 'a': 'R' || v2.a, 't': list_prepend('user:' || text, v2.t)} END]) AS b0,
      list_min([{'c': v1.c + 2, 'a': 'D' || v1.a, 't': v1.t}, CASE WHEN stays AND i = 'u' THEN {'c': v2.c + more, 'a': 'K' || v2.a, 't': list_prepend(line, v2.t)} END,
                CASE WHEN stays THEN {'c': v2.c + more + 1, 'a': 'R' || v2.a, 't': list_prepend('user:' || text, v2.t)} END]) AS b1,
      list_min([{'c': v2.c + 2, 'a': 'D' || v2.a, 't': v2.t}, CASE WHEN stays AND i = 'a' THEN {'c': v3.c + more, 'a': 'K' || v3.a, 't': list_prepend(line, v3.t)} END,
                CASE WHEN stays THEN {'c': v3.c + more + 1, 'a': 'R' || v3.a, 't': list_prepend('assistant:' || text, v3.t)} END]) AS b2,
      list_min([{'c': v3.c + 2, 'a': 'D' || v3.a, 't': v3.t}, CASE WHEN stays AND i = 'u' THEN {'c': v2.c + more, 'a': 'K' || v2.a, 't': list_prepend(line, v2.t)} END,
                CASE WHEN stays THEN {'c': v2.c + more + 1, 'a': 'R' || v2.a, 't': list_prepend('user:' || text, v2.t)} END]) AS b3
    FROM (SELECT w.*, i, text, role || ':' || text AS line, fault NOT IN ('b', 'd') AS stays, CASE WHEN fault = 't' THEN 5 ELSE 0 END AS more
          FROM walk w JOIN told t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.pos = w.pos)
  )
)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(v0.c, 0) AS cost, coalesce(v0.a, '') AS audit, sha256(coalesce(array_to_string(v0.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN walk w ON w.conv_id IS NOT DISTINCT FROM a.conv_id AND w.pos = 0
"""
