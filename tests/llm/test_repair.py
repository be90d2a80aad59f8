"""Conversation repair against all edit scripts, and the query against a plain version."""

import hashlib
import heapq
import itertools
import random
import zlib
from collections import defaultdict

import pytest

from shiftwise.llm import queries, repair

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\v\f\r"


def cheapest(kinds):
    """The cheapest audit, ASCII-least of equals, by a search over (row, initials so far); kinds: (initial, gone, truncated)."""
    heap = [(0, "", 0, "")]
    done = set()
    while True:
        cost, audit, row, state = heapq.heappop(heap)
        if (row, state) in done:
            continue
        done.add((row, state))
        if row == len(kinds) and state in ("", "a"):
            return cost, audit
        follow = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
        heapq.heappush(heap, (cost + 2, audit + "I", row, follow))
        if row < len(kinds):
            initial, gone, truncated = kinds[row]
            heapq.heappush(heap, (cost + 3, audit + "D", row + 1, state))
            if not gone:
                heapq.heappush(heap, (cost + 2 + truncated, audit + "R", row + 1, follow))
                if initial == follow or (initial == "s" and state == ""):
                    heapq.heappush(heap, (cost + truncated, audit + "K", row + 1, initial))


def brute(rows, ids):
    """rows after damage: (conv, turn, role, text)."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role, text))
    out = {}
    for conv in ids:
        seen, kinds, kept = set(), [], sorted(by[conv], key=lambda x: (*x[:2], x[2].encode(), x[3].encode()))
        n = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, _, role, text in kept:
            bare = text.rstrip(SPACE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                n[fault] += 1
            kinds.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(kinds))
        turns = [t for known, t, *_ in kept if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit = cheapest(kinds)
        state, at, said = "", iter(kept), []
        for letter in audit:
            follow = {"": "user", "s": "user", "u": "assistant", "a": "user"}[state]
            row = next(at) if letter != "I" else None
            if letter == "D":
                continue
            role, text = {"K": (row and row[2], row and row[3]), "R": (follow, row and row[3]), "I": (follow, "")}[letter]
            said.append(f"{role}:{text}")
            state = role[0]
        out[conv] = (gaps, *n.values(), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def damaged(rows):
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        case = zlib.crc32(key.encode()) % 20
        if case == 1:
            text = ""
        if case == 2:
            text = text.translate(dict.fromkeys(map(ord, ".!?")))
        for _ in range((1, 2)[case == 3] if case else 0):
            yield conv, turn, "user" if case == 4 else role, text


def as_dict(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_all_short_conversations():
    walker = repair.Walker()
    for n in range(4):
        for codes in itertools.product(range(9), repeat=n):
            told = [repair.summary(walker, bytes([c]), [1]) for c in codes]
            kinds = [("suax"[c % 4] if c < 8 else "x", c == 8, 4 <= c < 8) for c in codes]
            states, cost = repair.cross_runs(told) if told else ([0], 0)
            letters = [x for c, a, b in zip(codes, states, states[1:]) for x in repair.solve(walker, bytes([c]), 0, 1, a, b)]
            last = states[-1]
            assert (cost, "".join(letters) + repair.ENDING[last][1]) == cheapest(kinds)


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_long_conversations(size):
    """Rows in runs of one size: the runs' crossings and the rows' give the same audit."""
    rng = random.Random(size)
    walker = repair.Walker()
    for _ in range(150):
        codes = bytes(rng.choice((0, 1, 1, 2, 2, 3, 5, 6, 8)) for _ in range(rng.randint(1, 60)))
        runs = [codes[i:i + size] for i in range(0, len(codes), size)]
        states, cost = repair.cross_runs([repair.summary(walker, x, [1] * len(x)) for x in runs])
        audit = "".join(x for r, a, b in zip(runs, states, states[1:]) for x in repair.solve(walker, r, 0, len(r), a, b)) + repair.ENDING[states[-1]][1]
        assert (cost, audit) == cheapest([("suax"[c % 4] if c < 8 else "x", c == 8, 4 <= c < 8) for c in codes])


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = as_dict(queries.QUERIES["op11_conversation_repair"](spark, SF))
    assert found == brute(list(damaged(rows)), {r[0] for r in rows})


ODD = [(1, 0, "user", None), (1, 1, "assistant", ""), (1, 1, None, "fine."), (1, None, "system", "first."), (1, None, "system", "at first."), (None, 0, "assistant", "x."), (None, None, "user", "y."),
       (2, 0, "", "no role."), (2, 1, "Assistant", "capital."), (2, 2, "ubuntu", "kept."), (2, 2, "user", "and  \n"), (3, 0, "assistant", "é😀 " * 400_000), (3, 1, "user", "x!\t"),
       *[(4, 0, "user", "same.")] * 7, *[(5, t, "user", "same.") for t in range(9)], (6, -5, "user", "a."), (6, 9, "assistant", "b?"), *[(7, t, ("user", "assistant")[t % 2], f"turn {t // 4}.") for t in range(60)],
       *[(8, None, "user", f"{t}.") for t in range(30)], (9, 0, "assistant", " "), *[(10 + t, 0, "user", ".") for t in range(30)]]


def test_odd_conversations(spark, monkeypatch):
    schema = "conv_id bigint, turn bigint, role string, text string, part string, copies string, told string"
    df = spark.createDataFrame([(*r, "?", "?", "?") for r in ODD], schema).repartition(3)
    expected = brute(list(damaged(ODD)), {r[0] for r in ODD})
    assert as_dict(repair.repair_damaged(df)) == expected
    assert repair.repair_damaged(df.limit(0)).count() == 0


def test_runs_of_one_conversation(spark):
    """A conversation with most of the rows lies in several runs and partitions."""
    rows = [(1, t, ("user", "assistant")[t % 2], f"{t % 5000} says ." if t % 3 else f"{t}") for t in range(20_000)] + [(2, 0, "user", "x."), (2, 1, "assistant", "y.")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    assert as_dict(repair.repair_damaged(df)) == brute(list(damaged(rows)), {1, 2})
