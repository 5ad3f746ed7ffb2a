"""Runs of every length come from the names of the shortest ones."""

from __future__ import annotations

import random

from doclake.llm import line_dedup


def test_windows_cover_repeated_runs_of_every_length(spark):
    rng = random.Random(4)
    base = [f"line {rng.randrange(9)}" for _ in range(60)]
    rows = []
    for n in range(40):
        start = rng.randrange(50)
        rows.append((n, "\n".join([f"own {n}", *base[start : start + rng.randint(1, 30)], rng.choice(["", "own", "line 3"])])))
    places: dict = {}
    for n, text in rows:
        lines = text.split("\n")
        for size in range(2, len(lines) + 1):
            for at in range(len(lines) - size + 1):
                places.setdefault(tuple(lines[at : at + size]), []).append((n, at))
    gone = {(n, at + k) for run, found in places.items() for n, at in sorted(found)[1:] for k in range(len(run))}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.line_report(docs).collect()}
    assert got == {n: sum(1 for d, _ in gone if d == n) for n, _ in rows} and len(gone) > 100


def test_every_single_line_counts_where_one_line_is_asked_for(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc"), (2, "x\nb\ny"), (3, "c\nz")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in line_dedup.line_report(docs, min_lines=1).collect()} == {1: 0, 2: 1, 3: 1}
