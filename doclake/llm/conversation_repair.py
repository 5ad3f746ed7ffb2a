"""Repair the structure of conversations by depth-first branch-and-bound.

A conversation is well formed if the initials of its roles read ``(s?(ua)+)?``.  Each
turn is kept (cost 0), given the role user or assistant (1) or deleted (2; required for
blank and duplicate turns), and empty turns may be inserted (5); a truncated turn that
is not deleted costs 5 more.  Of the cheapest repairs the one counts whose audit, the
initials K, R, D and I of its edits in order, is least in ASCII order.

The search walks over nodes (turns dealt with, state of the pattern) with an explicit
stack.  It leaves a node when the cost so far and a lower bound of the rest exceed the
incumbent, or when the node's table holds a prefix that is cheaper or as cheap with a
smaller audit: what may follow depends on the node alone, and of two prefixes of equal
cost at one node neither begins the other, so the smaller one stays smaller.  The bounds
of a suffix are exact inside the next ``CHUNK`` turns and take the cheapest state where
a chunk begins.  When the stack is empty the incumbent is proved optimal.

How it is laid out: turns that are equal in every column are one row with a count, and
one range sort by (conversation, turn) deals them out, so a conversation with a third of
all turns is spread over many tasks.  A conversation inside one task and of at most
``SEGMENT`` turns is searched whole.  Segments of any other are searched from each state
of the pattern to each state; joining these tables in order by the same rule of (cost,
audit) gives the same repair.  Its SHA-256 is a chain over the whole conversation and is
fed batch by batch.

Defined results: null role and text count as one space, a null id or turn is one space
in the checksum that damages.  Rows with one turn are in order of role, then text (its
first 256 characters, then its SHA-256); a null turn comes first.  Rows with a null id
are one conversation.  Columns other than the four are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from doclake.session import lookup_join, stored

SEGMENT = 512
CHUNK = 64

KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
# States of the pattern: nothing yet, after the system turn, after a user turn, after an assistant turn.
STATES, ACCEPTING, ASKED = range(4), (0, 3), 2
ROLE_AFTER = {2: "user", 3: "assistant"}
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
_SPACE = r"\x20\x09-\x0D"


def next_state(state: int) -> int:
    """Where a user or assistant turn, whichever the pattern wants, leads."""
    return 3 if state == ASKED else ASKED


def kept_state(state: int, initial: str) -> int | None:
    if state == 0 and initial == "s":
        return 1
    wanted = "a" if state == ASKED else "u"
    return next_state(state) if initial == wanted else None


@dataclass
class Turns:
    """Turns in order; ``extra`` counts the equal turns that follow each and have to go."""

    initials: list[str] = field(default_factory=list)
    faults: list[int] = field(default_factory=list)
    extra: list[int] = field(default_factory=list)

    def edits(self, at: int, state: int) -> list[tuple[str, int, int]]:
        """(audit letter, cost, next state) of the ways to deal with a turn, in ASCII order."""
        found = [("D", DELETE, state)]
        if self.faults[at] not in (BLANK, DUPLICATE):
            cut = CUT if self.faults[at] == TRUNCATED else 0
            stays = kept_state(state, self.initials[at])
            if stays is not None:
                found.append(("K", KEEP + cut, stays))
            found.append(("R", REROLE + cut, next_state(state)))
        return found


def suffix_bounds(turns: Turns, ends: list[float]) -> list[list[float]]:
    """``[turn][state]``: what dealing with the rest costs at least, given what each state at the end costs.

    Inside a chunk the costs are exact; a later chunk may begin in any state.
    """
    n = len(turns.initials)
    bounds = [ends] * (n + 1)
    for at in range(n - 1, -1, -1):
        after = bounds[at + 1]
        if (at + 1) % CHUNK == 0 and at + 1 < n:
            after = [min(after)] * 4
        gone = DELETE * turns.extra[at]
        row = [min(cost + after[to] for _, cost, to in turns.edits(at, state)) + gone for state in STATES]
        # A turn may be inserted first, twice at most before the states repeat.
        for _ in range(2):
            row = [min(row[state], INSERT + row[next_state(state)]) for state in STATES]
        bounds[at] = row
    return bounds


def search(turns: Turns, start: int, exit_state: int | None = None) -> tuple[int, str] | None:
    """The cheapest repair ``(cost, audit)`` from one state of the pattern.

    Without ``exit_state`` the turns end a conversation.  With it they are a segment
    that has to end in that state, and nothing is inserted after its last turn: that
    belongs to the next segment.  None: no repair leads there.
    """
    n, never = len(turns.initials), float("inf")
    if exit_state is None:
        goals, ends = ACCEPTING, [0, 2 * INSERT, INSERT, 0]
    else:
        goals, ends = (exit_state,), [0 if state == exit_state else never for state in STATES]
    bounds = suffix_bounds(turns, ends)
    table: dict[tuple[int, int], tuple[int, str]] = {}
    best: tuple[int, str] | None = None
    stack = [(0, start, 0, "")]
    while stack:
        at, state, cost, audit = stack.pop()
        least = cost + bounds[at][state]
        if least == never or (best is not None and (least, audit) > (best[0], best[1][: len(audit)])):
            continue
        seen = table.get((at, state))
        if seen is not None and seen <= (cost, audit):
            continue
        table[at, state] = cost, audit
        if at == n and state in goals:
            if best is None or (cost, audit) < best:
                best = cost, audit
            continue
        branches = [(at, next_state(state), cost + INSERT, audit + "I")]
        if at < n:
            gone, tail = DELETE * turns.extra[at], "D" * turns.extra[at]
            for letter, price, to in turns.edits(at, state):
                branches.append((at + 1, to, cost + price + gone, audit + letter + tail))
        # The most promising branch is taken first: least bound, then least audit.
        branches.sort(key=lambda b: (b[2] + bounds[b[0]][b[1]], b[3]), reverse=True)
        stack += branches
    return best


def transfers(turns: Turns) -> list[tuple[int, int, int, str]]:
    """``(entry, exit, cost, audit)`` of a segment of a longer conversation, for all states."""
    found = [(a, b, search(turns, a, b)) for a in STATES for b in STATES]
    return [(a, b, *best) for a, b, best in found if best is not None]


def repaired(audit: str, state: int, roles: list[str], texts: list[str], extra: list[int]) -> tuple[list[str], int]:
    """The turns ``role:text`` that an audit leaves, and the state after them."""
    out, at, gone = [], 0, 0
    for letter in audit:
        if letter == "I":
            state = next_state(state)
            out.append(f"{ROLE_AFTER[state]}:")
            continue
        if gone:
            gone -= 1
            continue
        if letter == "K":
            state = kept_state(state, roles[at][:1])
            out.append(f"{roles[at]}:{texts[at]}")
        elif letter == "R":
            state = next_state(state)
            out.append(f"{ROLE_AFTER[state]}:{texts[at]}")
        gone, at = extra[at], at + 1
    return out, state


def damaged(conversations: DataFrame, sides: int = 20) -> DataFrame:
    """The rows of a table of conversations with faults put in by ``crc32(conv_id:turn) % sides``.

    ``times`` is how often a row is there afterwards: 0, 1 or 2.
    """
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(name) % sides).alias("kind"))
    kind = F.col("kind")
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.cast("long").alias("times"))


def _faults(rows: DataFrame) -> DataFrame:
    """Distinct turns with counts, their own fault and whether an earlier turn says the same.

    A conversation keeps one row that stands for what was dropped, so it is never lost.
    """
    there = F.col("times") > 0
    rows = rows.select(
        "conv_id",
        there.alias("there"),
        F.when(there, F.col("turn")).alias("turn"),
        F.when(there, F.col("role")).otherwise("").alias("role"),
        F.when(there, F.col("text")).otherwise("").alias("text"),
        "times",
    )
    rows = rows.groupBy("conv_id", "there", "turn", "role", "text").agg(F.sum("times").alias("times"))
    own = F.when(~F.col("text").rlike(f"[^{_SPACE}]"), BLANK).when(
        ~F.col("text").rlike(rf"[.!?][{_SPACE}]*\z"), TRUNCATED
    )
    head = F.concat(F.col("conv_id").isNull().cast("string"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit("\n"))
    body = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    rows = rows.withColumn("own", F.coalesce(own, F.lit(0))).withColumn("said", F.sha2(F.concat(head, body), 256))
    rows = stored(rows, "turns")
    said = rows.where(F.col("there") & (F.col("own") != BLANK)).groupBy("said").agg(
        F.count("*").alias("n"), F.max(F.col("turn").isNull()).alias("from_start"), F.min("turn").alias("first_turn")
    )
    rows = lookup_join(rows, said.where("n > 1").drop("n"), "said", "left")
    again = F.col("turn").isNotNull() & (F.col("from_start") | (F.col("turn") > F.col("first_turn")))
    fault = F.when(F.col("own") == BLANK, BLANK).when(F.coalesce(again, F.lit(False)), DUPLICATE).otherwise(F.col("own"))
    return rows.select("conv_id", "there", "turn", "role", "text", "times", "said", fault.cast("int").alias("fault"))


_STATS = ("n_turns", "turn_low", "turn_high", "n_distinct", "blank", "duplicate", "truncated", "illegal")
_OUT = "part int, seq long, first_initial string, last_initial string, " + ", ".join(f"{c} long" for c in _STATS)
_OUT += ", cost long, audit string, sha string, entries array<int>, exits array<int>, costs array<long>, audits array<string>"
_OUT += ", roles array<string>, texts array<string>, extra array<long>"


class _Segment:
    """Turns of one conversation as they come from a sorted partition."""

    def __init__(self, conv_id):
        self.conv_id, self.turns = conv_id, Turns()
        self.roles, self.texts, self.numbers = [], [], []

    def add(self, role: str, text: str, turn, fault: int, times: int) -> None:
        self.roles.append(role)
        self.texts.append(text)
        self.numbers.append(turn)
        self.turns.initials.append(role[:1])
        self.turns.faults.append(fault)
        self.turns.extra.append(times - 1)

    def stats(self) -> dict:
        """Counts that add up over segments; of the pair at a border only its two ends are known."""
        known = [t for t in self.numbers if t is not None]
        faults, extra, initials = self.turns.faults, self.turns.extra, self.turns.initials
        legal = ("su", "ua", "au")
        illegal = sum(a + b not in legal for a, b in zip(initials, initials[1:]))
        illegal += sum(n for c, n in zip(initials, extra) if c + c not in legal)
        blank = sum(1 + n for f, n in zip(faults, extra) if f == BLANK)
        duplicate = sum(1 + n for f, n in zip(faults, extra) if f == DUPLICATE)
        return {
            "n_turns": len(initials) + sum(extra),
            "turn_low": min(known, default=None),
            "turn_high": max(known, default=None),
            "n_distinct": len(set(known)),
            "blank": blank,
            "duplicate": duplicate + sum(n for f, n in zip(faults, extra) if f in (0, TRUNCATED)),
            "truncated": sum(f == TRUNCATED for f in faults),
            "illegal": illegal,
        }

    def whole(self) -> dict:
        cost, audit = search(self.turns, 0)
        out, _ = repaired(audit, 0, self.roles, self.texts, self.turns.extra)
        sha = hashlib.sha256("\n".join(out).encode()).hexdigest()
        return {"conv_id": self.conv_id, **self.stats(), "cost": cost, "audit": audit, "sha": sha}

    def piece(self, part: int, seq: int) -> dict:
        found = transfers(self.turns)
        names = ("entries", "exits", "costs", "audits")
        tables = {name: [row[n] for row in found] for n, name in enumerate(names)}
        own = {"part": part, "seq": seq, "first_initial": (self.roles or [""])[0][:1], "last_initial": (self.roles or [""])[-1][:1]}
        return {"conv_id": self.conv_id, **own, **self.stats(), **tables, "roles": self.roles, "texts": self.texts, "extra": self.turns.extra}


def _searched(schema: pa.Schema, segment_turns: int):
    """A function for ``mapInArrow`` over a sorted partition.

    Conversations at the ends of a partition may go on in another one and are left as
    pieces, like those over ``segment_turns``; every other one is done here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, ready, held = TaskContext.get().partitionId(), 0, [], 0
        now, opened, cut = None, True, False  # opened: the first conversation of the partition

        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            columns = {f.name: pa.array([r.get(f.name) for r in rows], f.type) for f in schema}
            return pa.RecordBatch.from_pydict(columns, schema=schema)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "there", "turn", "role", "text", "times", "fault")]
            for conv_id, there, turn, role, text, times, fault in zip(*columns):
                if now is not None and now.conv_id != conv_id:
                    if opened or cut:
                        ready.append(now.piece(part, seq))
                        seq += 1
                    else:
                        ready.append(now.whole())
                    now, opened, cut = None, False, False
                if now is not None and len(now.roles) >= segment_turns:
                    ready.append(now.piece(part, seq))
                    now, seq, cut = None, seq + 1, True
                now = now or _Segment(conv_id)
                if there:
                    now.add(role, text, turn, fault, times)
                    held += len(text)
                if len(ready) >= 256 or (ready and held > 4_000_000):
                    yield batch_of(ready)
                    ready, held = [], 0
        if now is not None:
            ready.append(now.piece(part, seq))
        if ready:
            yield batch_of(ready)

    return run


def _folded(rows: pa.Table) -> pa.Table:
    """Join the segments of one conversation: its repair, and which piece of it each segment holds.

    What is held grows with the audit, which is a single value of the result.
    """
    rows = rows.sort_by([("part", "ascending"), ("seq", "ascending")])
    pieces = rows.to_pylist()
    reached: dict[int, tuple[int, str]] = {0: (0, "")}
    came: list[dict[int, tuple[int, str]]] = []
    total = dict.fromkeys(_STATS, 0) | {"turn_low": None, "turn_high": None}
    last, last_turn = None, None
    for piece in pieces:
        found: dict[int, tuple[int, str]] = {}
        via: dict[int, tuple[int, str]] = {}
        for entry, end, cost, audit in zip(piece["entries"], piece["exits"], piece["costs"], piece["audits"]):
            if entry in reached:
                one = reached[entry][0] + cost, reached[entry][1] + audit
                if end not in found or one < found[end]:
                    found[end], via[end] = one, (entry, audit)
        reached = found
        came.append(via)
        for name in ("n_turns", "n_distinct", "blank", "duplicate", "truncated", "illegal"):
            total[name] += piece[name]
        if piece["n_turns"]:
            if last is not None and last + piece["first_initial"] not in ("su", "ua", "au"):
                total["illegal"] += 1
            last = piece["last_initial"]
        if piece["turn_low"] is not None:
            total["n_distinct"] -= piece["turn_low"] == last_turn
            total["turn_low"] = piece["turn_low"] if total["turn_low"] is None else total["turn_low"]
            total["turn_high"] = last_turn = piece["turn_high"]
    tails = {0: "", 1: "II", 2: "I", 3: ""}
    ends = [(cost + INSERT * len(tails[s]), audit + tails[s], s) for s, (cost, audit) in reached.items()]
    cost, audit, state = min(ends)
    tail, steps = tails[state], []
    for via in reversed(came):
        entry, own = via[state]
        steps.append((entry, own))
        state = entry
    steps.reverse()
    n = len(pieces)
    columns = {
        "conv_id": rows.column("conv_id"),
        "part": rows.column("part"),
        "seq": rows.column("seq"),
        "entry": pa.array([s[0] for s in steps], pa.int32()),
        "own": pa.array([s[1] for s in steps[:-1]] + [steps[-1][1] + tail], pa.string()),
        "cost": pa.array([cost] + [None] * (n - 1), pa.int64()),
        "audit": pa.array([audit] + [None] * (n - 1), pa.string()),
    }
    for name in _STATS:
        columns[name] = pa.array([total[name]] + [None] * (n - 1), pa.int64())
    return pa.table(columns)


def _hashed(conv_type: pa.DataType):
    """A function for ``mapInArrow`` over sorted segments: one SHA-256 per conversation, fed piece by piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chain, begun = None, None, False

        def done() -> pa.RecordBatch:
            columns = [pa.array([now[0]], conv_type), pa.array([chain.hexdigest()])]
            return pa.RecordBatch.from_arrays(columns, ["conv_id", "sha"])

        for batch in batches:
            for row in range(batch.num_rows):
                one = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
                if now is None or now[0] != one["conv_id"]:
                    if now is not None:
                        yield done()
                    now, chain, begun = (one["conv_id"],), hashlib.sha256(), False
                out, _ = repaired(one["own"], one["entry"], one["roles"], one["texts"], one["extra"])
                for turn in out:
                    chain.update(("\n" if begun else "").encode() + turn.encode())
                    begun = True
        if now is not None:
            yield done()

    return run


def repair(turns: DataFrame, segment_turns: int = SEGMENT) -> DataFrame:
    """One row per conversation of ``(conv_id, turn, role, text, times)``, as :func:`damaged` gives them.

    ``gaps`` counts the turn numbers missing between the first and the last, ``blank``,
    ``duplicate`` and ``truncated`` the first fault of each turn and ``illegal`` the
    neighbours whose roles do not fit; ``cost``, ``audit`` and ``repaired_sha256``
    describe the cheapest repair.
    """
    faulty = stored(_faults(turns), "faulty")
    head = F.substring("text", 1, 256)
    order = [F.col("conv_id").asc_nulls_first(), F.col("there").asc(), F.col("turn").asc_nulls_first(),
             F.col("role").asc(), head.asc(), F.col("said").asc()]
    conv_type = faulty.schema["conv_id"].dataType.simpleString()
    out = f"conv_id {conv_type}, {_OUT}"
    schema = to_arrow_schema(T.StructType.fromDDL(out))
    ranged = faulty.repartitionByRange(*order).sortWithinPartitions(*order)
    found = stored(ranged.mapInArrow(_searched(schema, segment_turns), out), "repairs")
    done = found.where("part is null").select("conv_id", *_STATS, "cost", "audit", "sha")

    pieces = found.where("part is not null")
    light = pieces.drop("roles", "texts", "extra", "cost", "audit", "sha")
    fold_out = f"conv_id {conv_type}, part int, seq long, entry int, own string, cost long, audit string, "
    folded = light.groupBy("conv_id").applyInArrow(_folded, fold_out + ", ".join(f"{c} long" for c in _STATS))
    folded = stored(folded, "folded")
    texts = pieces.select("part", "seq", "roles", "texts", "extra")
    joined = folded.select("conv_id", "part", "seq", "entry", "own").join(texts, ["part", "seq"])
    joined = joined.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "part", "seq")
    chains = joined.mapInArrow(_hashed(schema.field("conv_id").type), f"conv_id {conv_type}, sha string")
    chains = chains.withColumnRenamed("conv_id", "chain_id")
    merged = folded.where("cost is not null").join(chains, F.col("conv_id").eqNullSafe(F.col("chain_id")))
    every = done.unionByName(merged.select("conv_id", *_STATS, "cost", "audit", "sha"))
    zero = F.lit(0).cast("long")
    gaps = F.coalesce(F.col("turn_high") - F.col("turn_low") + 1 - F.col("n_distinct"), zero)
    return every.select(
        "conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        F.col("sha").alias("repaired_sha256"),
    )
