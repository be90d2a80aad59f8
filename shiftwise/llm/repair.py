"""Conversation structure repair: Hirschberg's divide and conquer over four states.

A repaired conversation's role initials read ``(s?(ua)+)?``.  What has been
written so far is in one of four states: nothing, after ``s``, after ``u``, after
``a``.  Each row is kept (0), given the other role (2) or deleted (3); user and
assistant turns without text may be inserted anywhere (2); a truncated row that
stays adds 1.  The cheapest edits are wanted, among equally cheap ones those whose
initials come first in ASCII order.

From a state to a state over some rows, an audit always ends with a row's own
letter, so of two different ones neither begins with the other, and the first
difference decides whatever follows.  A vector of four costs with the order
of the four audits is therefore all that is needed at a crossing: the forward
vector of the first half and the backward vector of the second meet, the cheapest
crossing is taken, the audit-least among equals, and both halves are solved
alike.  Costs differ by little between states, so vectors less their least cost
are few; a worker numbers them and walks rows by looking up the next number.

Rows are sorted by conversation and turn with a range partitioning, which also
splits a conversation that holds a large share of all rows, and are cut into runs of
bounded size.  Each run tells costs and orders from every state to every state;
where a conversation has several runs, its crossings between them are chosen from
these figures alone, and each run is then solved by itself.
"""

from __future__ import annotations

import dataclasses
import functools
import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftwise.llm.staging import ready, stage

#: Prices of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
NOTHING, AFTER_S, AFTER_U, AFTER_A = range(4)
STATES = range(4)
#: What a row is to the walk: its initial (s, u, a, other), four more if it is truncated; or it must be deleted.
INITIALS = "sua"
GONE = 8
FAR = 1 << 40

_TURN_NEXT = {NOTHING: AFTER_U, AFTER_S: AFTER_U, AFTER_U: AFTER_A, AFTER_A: AFTER_U}
_WRITES = {AFTER_U: "user", AFTER_A: "assistant"}
#: From a state to the end: cost and letters of the turns still to be inserted.
ENDING = {NOTHING: (0, ""), AFTER_S: (2 * INSERT, "II"), AFTER_U: (INSERT, "I"), AFTER_A: (0, "")}


def _kept(state: int, code: int) -> int | None:
    """The state after keeping a row, None where it may not follow."""
    kind = code % 4
    if code == GONE or kind == 3 or (kind == 0 and state != NOTHING):
        return None
    after = (AFTER_S, AFTER_U, AFTER_A)[kind]
    return after if kind == 0 or after == _TURN_NEXT[state] else None


@functools.cache
def steps(code: int) -> dict[int, dict[int, tuple[int, str]]]:
    """state -> state after the row -> (cost, letters): inserts before the row, then its own edit."""
    out: dict[int, dict[int, tuple[int, str]]] = {}
    extra = TRUNCATED if code != GONE and code >= 4 else 0
    for start in STATES:
        best: dict[int, tuple[int, str]] = {}
        state, cost, letters = start, 0, ""
        for _ in range(3):  # a third insert would only come back to a state passed before
            ends = [(state, cost + DELETE, "D")]
            if code != GONE:
                ends.append((_TURN_NEXT[state], cost + REROLE + extra, "R"))
                if (after := _kept(state, code)) is not None:
                    ends.append((after, cost + extra, "K"))
            for after, price, letter in ends:
                best[after] = min(best.get(after, (FAR, "")), (price, letters + letter))
            state, cost, letters = _TURN_NEXT[state], cost + INSERT, letters + "I"
        out[start] = best
    return out


@dataclasses.dataclass(frozen=True)
class Vector:
    """Costs of the four states less ``base``, and which audit comes before which (place of each)."""

    costs: tuple[int, ...]
    places: tuple[int, ...]


def start_at(state: int) -> Vector:
    return Vector(tuple(0 if x == state else FAR for x in STATES), (0, 0, 0, 0))


def _onward(vector: Vector, moves: dict[int, dict[int, tuple[int, object]]]) -> tuple[Vector, int]:
    """The vector after ``moves`` (state -> state -> (cost, order among moves from the same state))."""
    best: dict[int, tuple] = {}
    for state in STATES:
        if vector.costs[state] < FAR:
            for after, (cost, order) in moves[state].items():
                found = (vector.costs[state] + cost, vector.places[state], order)
                best[after] = min(best.get(after, (FAR,)), found)
    order = sorted(best, key=lambda x: best[x][1:])
    least = min(x[0] for x in best.values())
    return Vector(tuple(best[x][0] - least if x in best else FAR for x in STATES), tuple(order.index(x) if x in best else 0 for x in STATES)), least


def _backward(costs: tuple[int, ...], moves: dict[int, dict[int, tuple[int, object]]]) -> tuple[int, ...]:
    """What ``moves`` and then ``costs`` take from each state, less what all share."""
    new = [min(FAR, min((c + costs[x] for x, (c, _) in moves[s].items()), default=FAR)) for s in STATES]
    least = min(new)
    return tuple(x - least if x < FAR else FAR for x in new)


class Walker:
    """Vectors forward and backward over row codes, numbered as they are met."""

    def __init__(self) -> None:
        self.vectors: list[Vector] = []
        self.numbers: dict[Vector, int] = {}
        self.next: dict[tuple[int, int], tuple[int, int]] = {}
        self.back: dict[tuple[tuple[int, ...], int], tuple[tuple[int, ...], int]] = {}

    def number(self, vector: Vector) -> int:
        if vector not in self.numbers:
            self.numbers[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.numbers[vector]

    def forward(self, codes: bytes, runs: list[int] | None, lo: int, hi: int, vector: Vector) -> tuple[Vector, int]:
        """After the rows lo to hi - 1: the vector, and the cost taken off it."""
        at, base = self.number(vector), 0
        for i in range(lo, hi):
            key = (at, codes[i])
            if key not in self.next:
                after, least = _onward(self.vectors[at], steps(codes[i]))
                self.next[key] = (self.number(after), least)
            at, least = self.next[key]
            base += least
            if runs and runs[i] > 1:
                base += DELETE * (runs[i] - 1)
        return self.vectors[at], base

    def backward(self, codes: bytes, lo: int, hi: int, costs: tuple[int, ...]) -> tuple[int, ...]:
        """What the rows lo to hi - 1 and ``costs`` after them cost from each state, less what all share."""
        for i in range(hi - 1, lo - 1, -1):
            key = (costs, codes[i])
            if key not in self.back:
                self.back[key] = _backward(costs, steps(codes[i]))
            costs = self.back[key]
        return costs


def crossing(vector: Vector, costs: tuple[int, ...]) -> int:
    """The cheapest state to cross in, the audit-least of equals."""
    return min((s for s in STATES if vector.costs[s] < FAR), key=lambda s: (vector.costs[s] + costs[s], vector.places[s]))


def only(state: int) -> tuple[int, ...]:
    return tuple(0 if x == state else FAR for x in STATES)


def solve(walker: Walker, codes: bytes, lo: int, hi: int, start: int, end: int) -> Iterator[str]:
    """Letters of the rows lo to hi - 1, row by row, from one state to another."""
    if hi - lo == 1:
        yield steps(codes[lo])[start][end][1]
    elif hi > lo:
        middle = (lo + hi) // 2
        vector, _ = walker.forward(codes, None, lo, middle, start_at(start))
        cross = crossing(vector, walker.backward(codes, middle, hi, only(end)))
        yield from solve(walker, codes, lo, middle, start, cross)
        yield from solve(walker, codes, middle, hi, cross, end)


def summary(walker: Walker, codes: bytes, runs: list[int]) -> list[int]:
    """For each start state the costs of the four end states and the places of their audits: 32 numbers."""
    out: list[int] = []
    for state in STATES:
        vector, base = walker.forward(codes, runs, 0, len(codes), start_at(state))
        out += [x + base if x < FAR else FAR for x in vector.costs]
        out += vector.places
    return out


def _moves(told: list[int]) -> dict[int, dict[int, tuple[int, int]]]:
    return {s: {x: (told[8 * s + x], told[8 * s + 4 + x]) for x in STATES if told[8 * s + x] < FAR} for s in STATES}


def cross_runs(told: list[list[int]]) -> tuple[list[int], int]:
    """States at the ends of a conversation's runs (first: before them), and the cost of all."""
    moves = [_moves(x) for x in told]
    ending = tuple(ENDING[s][0] for s in STATES)

    def back(lo: int, hi: int, costs: tuple[int, ...]) -> tuple[int, ...]:
        for i in range(hi - 1, lo - 1, -1):
            costs = _backward(costs, moves[i])
        return costs

    def ahead(lo: int, hi: int, state: int) -> tuple[Vector, int]:
        vector, base = start_at(state), 0
        for i in range(lo, hi):
            vector, least = _onward(vector, moves[i])
            base += least
        return vector, base

    def halves(lo: int, hi: int, start: int, end: int) -> list[int]:
        if hi - lo <= 1:
            return [end] if hi > lo else []
        middle = (lo + hi) // 2
        cross = crossing(ahead(lo, middle, start)[0], back(middle, hi, only(end)))
        return halves(lo, middle, start, cross) + halves(middle, hi, cross, end)

    vector, base = ahead(0, len(moves), NOTHING)
    last = crossing(vector, ending)
    return [NOTHING, *halves(0, len(moves), NOTHING, last)], base + vector.costs[last] + ending[last]


def rebuild(letters: Iterator[str], roles: list[str], texts: list[str], runs: list[int], start: int) -> tuple[str, list[str], int]:
    """Audit, repaired ``role:text`` turns and last state of a run's rows."""
    audit, turns, state = [], [], start
    for row, edits in enumerate(letters):
        for letter in edits[:-1]:
            state = _TURN_NEXT[state]
            turns.append(f"{_WRITES[state]}:")
        audit.append(edits)
        if edits[-1] == "K":
            kind = INITIALS.index(roles[row][0])
            state = (AFTER_S, AFTER_U, AFTER_A)[kind]
            turns.append(f"{roles[row]}:{texts[row]}")
        elif edits[-1] == "R":
            state = _TURN_NEXT[state]
            turns.append(f"{_WRITES[state]}:{texts[row]}")
        if runs[row] > 1:
            audit.append("D" * (runs[row] - 1))
    return "".join(audit), turns, state


def ending(state: int) -> tuple[str, list[str]]:
    letters, turns = ENDING[state][1], []
    for _ in letters:
        state = _TURN_NEXT[state]
        turns.append(f"{_WRITES[state]}:")
    return letters, turns


# ------------------------------------------------------------------ in Spark

#: A run ends at so many rows or so much text.
RUN_ROWS, RUN_BYTES = 4096, 1 << 20


def damage(turns: DataFrame) -> DataFrame:
    """The query's damage of (conv_id, turn, role, text), as rows with a count of adjacent ``copies``.

    By crc32(``conv_id:turn``) % 20: 0 drops a row, 1 empties its text, 2 removes
    its ``[.!?]``, 3 repeats it, 4 makes its role user.  Nulls read as one space.
    """
    def said(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    rows = turns.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"),
                        (F.crc32(F.concat_ws(":", said("conv_id"), said("turn")).cast("binary")) % 20).alias("case"))
    text = F.when(F.col("case") == 1, "").when(F.col("case") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.where("case <> 0").select("conv_id", "turn", F.when(F.col("case") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                                          F.when(F.col("case") == 3, 2).otherwise(1).cast("long").alias("copies"))


def marked(rows: DataFrame) -> DataFrame:
    """Equal rows as one with their number, and whether role and text were seen at an earlier turn.

    Only digests of the texts are grouped over all rows; texts move for rows that
    are not alone with their role and text in their conversation.
    """
    rows = rows.select("conv_id", "turn", "role", "text", "copies", F.md5(F.col("text").cast("binary")).alias("print"))
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    several = rows.groupBy("conv_id", "role", "print").agg(F.min(order).alias("first"), F.sum("copies").alias("all")).where("all > 1")
    several = several.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("print").alias("p"), "first")
    found = rows.join(several, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("print") == F.col("p")), "left")
    names = ("conv_id", "turn", "role", "text", "copies", "seen")
    alone = found.where(F.col("first").isNull()).withColumn("seen", F.lit(False)).select(*names)
    later = ~order.eqNullSafe(F.col("first"))
    grouped = found.where(F.col("first").isNotNull()).groupBy("conv_id", "turn", "role", "print", later.alias("seen"))
    merged = grouped.agg(F.sum("copies").alias("copies"), F.max("text").alias("text")).select(*names)
    return alone.unionByName(merged)


FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_SUMS = ("blank", "duplicate", "truncated", "illegal")
#: What a run is kept as while other runs of its conversation may lie elsewhere.
_OPEN = {"roles": pa.list_(pa.string()), "texts": pa.list_(pa.string()), "copies": pa.list_(pa.int64()), "codes": pa.binary(), "told": pa.list_(pa.int64()), "first_turn": pa.int64(),
         "last_turn": pa.int64(), "turns": pa.int64(), **{c: pa.int64() for c in _SUMS}, "first_role": pa.string(), "last_role": pa.string()}
_DONE = {**{c: pa.int64() for c in FIGURES}, "audit": pa.string(), "repaired_sha256": pa.string()}
_CUT = {"part": pa.int64(), **_OPEN, **_DONE}
_NAMES = {pa.int64(): "bigint", pa.string(): "string", pa.binary(): "binary", pa.bool_(): "boolean", pa.list_(pa.string()): "array<string>", pa.list_(pa.int64()): "array<bigint>"}


def _ddl(kind: str, fields: dict[str, pa.DataType]) -> str:
    return ", ".join([f"conv_id {kind}", *(f"{n} {_NAMES[t]}" for n, t in fields.items())])


def _batch(rows: list[dict], kind: pa.DataType, fields: dict[str, pa.DataType]) -> pa.RecordBatch:
    every = {"conv_id": kind, **fields}
    return pa.RecordBatch.from_arrays([pa.array([x.get(n) for x in rows], t) for n, t in every.items()], names=list(every))


_LEGAL = {"su", "ua", "au"}


class _Run:
    """Rows of a conversation that follow one another, some thousands at most."""

    def __init__(self) -> None:
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.copies: list[int] = []
        self.codes = bytearray()
        self.turns: list[int | None] = []
        self.size = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: int | None, role: str, text: str, copies: int, seen: bool) -> None:
        kind = INITIALS.find(role[:1]) if role else -1
        code = kind if kind >= 0 else 3
        if not (bare := text.rstrip(" \t\n\v\f\r")):
            self.blank += copies
            code = GONE
        elif seen:
            self.duplicate += copies
            code = GONE
        else:
            self.duplicate += copies - 1
            if bare[-1] not in ".!?":
                self.truncated += 1
                code += 4
        if self.roles and self.roles[-1][:1] + role[:1] not in _LEGAL:
            self.illegal += 1
        self.illegal += copies - 1
        self.roles.append(role)
        self.texts.append("" if code == GONE else text)
        self.copies.append(copies)
        self.codes.append(code)
        self.turns.append(turn)
        self.size += len(self.texts[-1])

    def row(self, walker: Walker) -> dict:
        known = [t for t in self.turns if t is not None]
        codes = bytes(self.codes)
        return {"roles": self.roles, "texts": self.texts, "copies": self.copies, "codes": codes, "told": summary(walker, codes, self.copies), "first_turn": min(known, default=None),
                "last_turn": max(known, default=None), "turns": len(set(known)), **{c: getattr(self, c) for c in _SUMS}, "first_role": self.roles[0], "last_role": self.roles[-1]}


def _figures(runs: list[dict]) -> tuple[list[int], dict]:
    """States at the ends of a conversation's runs, and its figures."""
    states, cost = cross_runs([x["told"] for x in runs])
    known = [x for x in runs if x["first_turn"] is not None]
    shared = sum(a["last_turn"] == b["first_turn"] for a, b in itertools.pairwise(known))
    out = {c: sum(x[c] for x in runs) for c in _SUMS} | {"cost": cost}
    out["illegal"] += sum(a["last_role"][:1] + b["first_role"][:1] not in _LEGAL for a, b in itertools.pairwise(runs))
    out["gaps"] = known[-1]["last_turn"] - known[0]["first_turn"] + 1 - (sum(x["turns"] for x in known) - shared) if known else 0
    return states, out


def _rebuilt(walker: Walker, run: dict, start: int, end: int, last: bool) -> tuple[str, list[str]]:
    """Audit and repaired turns of a run, from one state to another; the last run ends its conversation."""
    audit, turns, state = rebuild(solve(walker, run["codes"], 0, len(run["codes"]), start, end), run["roles"], run["texts"], run["copies"], start)
    if last:
        more, empty = ending(state)
        audit, turns = audit + more, turns + empty
    return audit, turns


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's sorted rows: conversations that lie inside it in one run are repaired, the runs of others kept.

    The first and the last conversation may go on in the partitions beside.
    """
    from pyspark import TaskContext

    part = TaskContext.get().partitionId() << 40
    walker, run, key, closed, kind = Walker(), None, None, False, None

    def told(conv, run: _Run, whole: bool) -> dict:
        row = run.row(walker)
        if not whole:
            return {"conv_id": conv, "part": part, **row}
        states, figures = _figures([row])
        audit, turns = _rebuilt(walker, row, *states, True)
        return {"conv_id": conv, **figures, "audit": audit, "repaired_sha256": digest(turns)}

    out: list[dict] = []
    size = 0
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        columns = [batch.column(x).to_pylist() for x in ("conv_id", "turn", "role", "text", "copies", "seen")]
        for conv, turn, role, text, copies, seen in zip(*columns, strict=True):
            new = run is not None and conv != key
            if run is None or new or len(run.roles) >= RUN_ROWS or run.size >= RUN_BYTES:
                if run:
                    out.append(told(key, run, new and closed))
                    part += 1
                    size += run.size
                closed = new  # it began here, and lies in one run so far
                run, key = _Run(), conv
                if size >= RUN_BYTES or len(out) >= 1000:
                    yield _batch(out, kind, _CUT)
                    out, size = [], 0
            run.add(turn, role, text, copies, seen)
    if run:
        out.append(told(key, run, False))
    if out:
        yield _batch(out, kind, _CUT)


_CROSSED = {"part": pa.int64(), "start": pa.int64(), "end": pa.int64(), "last": pa.bool_(), "whole": pa.bool_(), **{c: pa.int64() for c in FIGURES}}


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.DataType, dict]]:
    """Rows one by one, with the type of ``conv_id``; of a batch, a few are Python objects at a time."""
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for i in range(0, batch.num_rows, 16):
            for row in batch.slice(i, 16).to_pylist():
                yield kind, row


def _crossings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs, without texts: first and last state of each, and its conversation's figures."""
    for (kind, conv), group in itertools.groupby(_groups(batches), key=lambda x: (x[0], x[1]["conv_id"])):
        runs = [row for _, row in group]
        states, figures = _figures(runs)
        n = len(runs)
        yield _batch([{"conv_id": conv, "part": x["part"], "start": states[i], "end": states[i + 1], "last": i == n - 1, "whole": n == 1, **figures} for i, x in enumerate(runs)], kind, _CROSSED)


_SOLVED = {"part": pa.int64(), "audit": pa.string(), "repaired": pa.list_(pa.string())}


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each run's letters and repaired turns, from its first state to its last."""
    walker = Walker()
    for kind, row in _groups(batches):
        audit, turns = _rebuilt(walker, row, row["start"], row["end"], row["last"])
        yield _batch([{"conv_id": row["conv_id"], "part": row["part"], "audit": audit, "repaired": turns}], kind, _SOLVED)


_CHAINED = {"audit": pa.string(), "repaired_sha256": pa.string()}


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted solved runs: one audit and digest a conversation, a run in memory at a time."""
    for (kind, conv), group in itertools.groupby(_groups(batches), key=lambda x: (x[0], x[1]["conv_id"])):
        audit, chain, begun = [], hashlib.sha256(), False
        for _, row in group:
            audit.append(row["audit"])
            for turn in row["repaired"]:
                chain.update((("\n" if begun else "") + turn).encode("utf-8"))
                begun = True
        yield _batch([{"conv_id": conv, "audit": "".join(audit), "repaired_sha256": chain.hexdigest()}], kind, _CHAINED)


def digest(turns: list[str]) -> str:
    return hashlib.sha256("\n".join(turns).encode("utf-8")).hexdigest()


def repair(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation.

    ``rows`` has ``conv_id``, ``turn`` (long), ``role``, ``text`` (no nulls) and
    ``copies`` (adjacent repetitions), as ``damage`` makes them; other columns are
    left out.  ``ids`` has the ``conv_id`` to report, those of ``rows`` by default.

    Rows are taken by turn, null turns first, rows of one turn by role, then by
    text.  A null ``conv_id`` is one conversation.  Equal rows are one
    with a count, so a row repeated any number of times stays one row.  A role
    whose initial is none of s, u, a can't be kept.  A text goes into a run whole, however
    long it is.  A conversation without rows has zeros, an empty audit and the
    digest of nothing; an empty table gives no rows.  A conversation with several
    runs is digested by one task, a run at a time, because its digest is a chain.
    """
    ready(rows)
    kind = rows.schema["conv_id"].dataType.simpleString()
    order = ("conv_id", "turn", "role")
    dealt = marked(rows).repartitionByRange(*order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text")
    cut = stage(dealt.select("conv_id", "turn", "role", "text", "copies", "seen").mapInArrow(_cut, _ddl(kind, _CUT)), "runs")
    runs = cut.where(F.col("part").isNotNull())
    thin = runs.select("conv_id", "part", "told", "first_turn", "last_turn", "turns", *_SUMS, "first_role", "last_role")
    states = stage(thin.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_crossings, _ddl(kind, _CROSSED)), "crossings")
    work = runs.select("conv_id", "part", "roles", "texts", "copies", "codes").join(states.select("part", "start", "end", "last"), "part")
    solved = work.mapInArrow(_solved, _ddl(kind, _SOLVED))
    chained = solved.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_chained, _ddl(kind, _CHAINED))
    figures = states.where("last").select(F.col("conv_id").alias("id"), *FIGURES)
    apart = chained.join(figures, F.col("conv_id").eqNullSafe(F.col("id"))).select("conv_id", *FIGURES, "audit", "repaired_sha256")
    whole = cut.where(F.col("part").isNull()).select("conv_id", *FIGURES, "audit", "repaired_sha256")
    repaired = whole.unionByName(apart)
    every = (rows if ids is None else ids).select(F.col("conv_id").alias("id")).distinct()
    out = every.join(repaired, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    return out.select(F.col("id").alias("conv_id"), *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in FIGURES), F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(digest([]))).alias("repaired_sha256"))


def repair_damaged(turns: DataFrame) -> DataFrame:
    """Damage ``turns`` (conv_id, turn, role, text; other columns are left out) and repair what is left; see ``repair``."""
    return repair(damage(turns), turns)
