"""Repair of conversations against a plain uniform-cost search over whole conversations."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest

from doclake.llm import conversation_repair
from doclake.llm.conversation_repair import damaged, repair

SPACE = " \t\n\x0b\x0c\r"


def brute(rows):
    """The contract's row for one conversation, from its original rows."""
    left = []
    for conv_id, turn, role, text in rows:
        name = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(name.encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        left += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    left.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in left:
        body = text.strip(SPACE)
        fault = "b" if not body else "d" if (role, text) in seen else "" if body[-1] in ".!?" else "t"
        seen.add((role, text))
        faults.append(fault)
    known = [t for t, _, _ in left if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(left, left[1:]))
    # Uniform-cost search; equal costs come off the heap in order of their audits.
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, at, state, out = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(left) and state in ("", "a"):
            break
        want = "a" if state == "u" else "u"
        full = {"a": "assistant", "u": "user"}[want]
        heapq.heappush(heap, (cost + 5, audit + "I", at, want, (*out, f"{full}:")))
        if at == len(left):
            continue
        _, role, text = left[at]
        heapq.heappush(heap, (cost + 2, audit + "D", at + 1, state, out))
        if faults[at] in ("b", "d"):
            continue
        more = 5 if faults[at] == "t" else 0
        if role[:1] == want or (role[:1] == "s" and state == "" and not out):
            heapq.heappush(heap, (cost + more, audit + "K", at + 1, role[:1], (*out, f"{role}:{text}")))
        heapq.heappush(heap, (cost + more + 1, audit + "R", at + 1, want, (*out, f"{full}:{text}")))
    counts = [faults.count(f) for f in "bdt"]
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for conv_id in [*range(60), None]:
        size = rng.choice([0, 1, 2, 5, 9, 40]) if conv_id != 7 else 300
        for n in range(size):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            if rng.random() < 0.6:
                role = ("user", "assistant")[n % 2]
            text = rng.choice(["Yes.", "no", "ok!", " ", "", None, " .", "ends here?\n", f"words {rng.random()}.", f"cut {rng.random()}"])
            turn = rng.choice([n, n, n, n + 3, n - 1, None])
            rows.append((conv_id, turn, role, text))
            if rng.random() < 0.1:
                rows.append((conv_id, turn, role, text))
    return rows


@pytest.mark.parametrize("segment", [4, 512])
def test_repair_equals_brute_force(spark, segment):
    rows = conversations(3)
    rows += [(500, 1, "user", "long " * 50_000 + "."), (501, None, None, None), (502, 3, "sys", "a. "), (502, 3, "user", "same."), (502, 3, "user", "same.")]
    # A conversation of which every row is dropped stays.
    gone = next(n for n in range(1000, 9000) if zlib.crc32(f"{n}:1".encode()) % 20 == 0)
    rows.append((gone, 1, "user", "hello."))
    extra = [(*r, "x", 1) for r in rows]
    table = spark.createDataFrame(extra, "conv_id long, turn long, role string, text string, fault string, part int").repartition(5)
    got = {r["conv_id"]: tuple(r)[1:] for r in repair(damaged(table), segment).collect()}
    groups = {}
    for row in rows:
        groups.setdefault(row[0], []).append(row)
    want = {conv_id: brute(group) for conv_id, group in groups.items()}
    assert got == want
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_no_conversations(spark):
    table = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair(damaged(table)).count() == 0


def test_equal_turns_are_one_row(spark):
    """A turn repeated without end costs one row of the search, however many there are."""
    table = spark.createDataFrame([(3, 5, "user", "again.")] * 3000 + [(3, 6, "assistant", "yes.")], "conv_id long, turn long, role string, text string")
    (row,) = repair(damaged(table)).collect()
    assert tuple(row)[1:] == brute([tuple(r) for r in table.collect()])
    assert conversation_repair._faults(damaged(table)).count() <= 3


def test_search_takes_few_steps():
    """Bounds and tables keep the search near one visit per turn and state."""
    rng = random.Random(9)
    turns = conversation_repair.Turns()
    for _ in range(400):
        turns.initials.append(rng.choice("ua" * 4 + "st"))
        turns.faults.append(rng.choice([0] * 8 + [1, 2, 3]))
        turns.extra.append(0)
    visits = []
    edits = conversation_repair.Turns.edits
    try:
        conversation_repair.Turns.edits = lambda self, at, state: visits.append(at) or edits(self, at, state)
        conversation_repair.search(turns, 0)
    finally:
        conversation_repair.Turns.edits = edits
    assert len(visits) < 400 * 4 * 10
