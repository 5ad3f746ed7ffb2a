"""Line, byte and n-gram duplicates against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from odd_documents import no_docs, odd_docs, odd_rows  # noqa: F401

from doclake.llm import components, jaccard_join, line_dedup, suffix_dedup
from doclake.llm.suffix_sort import suffix_array


@pytest.mark.parametrize("limit", [100, 10**9])
def test_suffix_array_with_queues_on_disk(limit):
    rng = random.Random(5)
    for _ in range(300):
        depth, letters = rng.choice([3, 7, 50]), rng.choice([1, 2, 3, 26])
        text = [rng.randrange(letters) for _ in range(rng.randint(0, 60))] * rng.choice([1, 3])
        order, common = suffix_array(np.array(text, np.int64), depth, limit)
        prefixes = [tuple(text[n : n + depth]) for n in order]
        assert sorted(order.tolist()) == list(range(len(text))) and prefixes == sorted(prefixes)
        for n in range(1, len(text)):
            a, b = prefixes[n - 1], prefixes[n]
            same = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert common[n] == same


def test_bytes_of_odd_documents(odd_docs, odd_rows, no_docs):
    last = float("inf")
    first: dict[bytes, float] = {}
    for i, t in odd_rows:
        data = (t or "").encode()
        for n in range(len(data) - 49):
            key = data[n : n + 50]
            first[key] = min(first.get(key, last), last if i is None else i)
    want = []
    for i, t in odd_rows:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for n in range(len(data) - 49):
            if first[data[n : n + 50]] < (last if i is None else i):
                gone[n : n + 50] = b"\1" * 50
        spans = len(re.findall(b"\1+", bytes(gone)))
        kept = hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest()
        want.append((i, len(data), sum(gone), spans, kept))
    got = [tuple(r) for r in suffix_dedup.byte_report(odd_docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(w[2] for w in want) > 3000
    assert suffix_dedup.byte_report(no_docs).count() == 0


def shingles(text, size):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if len(found) < size:
        return frozenset([tuple(found)] if found else [])
    return frozenset(zip(*(found[n:] for n in range(size))))


def brute_groups(rows, size, threshold):
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[find(n)] = min(least.get(find(n), i), i)
    return [(i, len(sets[n]), least.get(find(n))) for n, (i, _) in enumerate(rows)]


@pytest.mark.parametrize("size, threshold", [(3, 90), (5, 80), (1, 50)])
def test_groups_of_odd_documents(odd_docs, odd_rows, size, threshold):
    got = jaccard_join.groups(odd_docs, size, threshold).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute_groups(odd_rows, size, threshold), key=repr)


def test_groups_of_an_empty_table(no_docs):
    assert jaccard_join.groups(no_docs).count() == 0
    assert jaccard_join.one_of_each(no_docs).columns == no_docs.columns


def test_large_groups_in_cells_and_chains(spark, monkeypatch):
    """Every way a group can be too large, at sizes a test can hold."""
    for name, value in (("CLUSTER_ROWS", 8), ("LOCAL_GROUP", 12), ("WIDE_GROUP", 20), ("PAIR_GROUP", 3), ("POSTINGS_PER_BUCKET", 50)):
        monkeypatch.setattr(jaccard_join, name, value)
    rng = random.Random(8)
    base = [f"b{n}" for n in range(60)]
    rows = []
    for n in range(90):
        text = list(base[: rng.randint(30, 60)])
        for _ in range(rng.randint(0, 2)):
            text[rng.randrange(len(text))] = f"c{rng.randrange(5)}"
        rows.append((n, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jaccard_join.groups(docs, 3, 80).select("doc_id", "n_shingles", "component_id")
    want = brute_groups(rows, 3, 80)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    kept = jaccard_join.one_of_each(docs, 3, 80)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({w[2] for w in want})


def test_chains_of_hot_shingles_with_sizes_far_apart(spark, monkeypatch):
    """Every linked pair that shares a hot shingle is joined by the chains, whichever batch it came in."""
    monkeypatch.setattr(jaccard_join, "LOCAL_GROUP", 3)
    monkeypatch.setattr(jaccard_join, "WIDE_GROUP", 0)
    rng = random.Random(2)
    for part in ([[5, 10, 5, 5], [7], [9]], *([[rng.randint(1, 60) for _ in range(rng.randint(1, 9))] for _ in range(5)] for _ in range(2))):
        sizes = [n for batch in part for n in batch]
        rows = [(k, n, np.array([77], "<u8").tobytes()) for k, n in enumerate(sizes)]
        ends = np.cumsum([len(batch) for batch in part])
        tables = [spark.createDataFrame(rows[e - len(b) : e], "node long, n long, prefix binary").coalesce(1) for b, e in zip(part, ends)]
        classes = tables[0]
        for other in tables[1:]:
            classes = classes.unionByName(other)
        found = [r for r in jaccard_join._postings(classes, 90).collect() if r["kind"] == jaccard_join.CHAIN]
        root = components.roots(len(sizes), np.array([r["x"] for r in found], int), np.array([r["y"] for r in found], int))
        order = sorted(range(len(sizes)), key=lambda k: sizes[k])
        for a, b in zip(order, order[1:]):
            assert (root[a] == root[b]) == (100 * sizes[a] >= 90 * sizes[b]), part


def test_large_cluster_is_filtered_before_its_texts_are_read(spark, monkeypatch):
    """Rows that reach verification, and bins for them, where chains have joined all classes."""
    monkeypatch.setattr(jaccard_join, "CLUSTER_ROWS", 8)
    monkeypatch.setattr(jaccard_join, "BIN_ROWS", 16)
    seen = []

    def chained(rows, classes, threshold):
        nodes = [r["node"] for r in classes.collect()]
        return spark.createDataFrame(list(zip(nodes, nodes[1:])), "x long, y long")

    def joined(rows, cells, *rest):
        if "bin" in cells.columns:
            seen.append((cells.count(), cells.select("bin").distinct().count()))
        return lookup(rows, cells, *rest)

    lookup = jaccard_join.lookup_join
    monkeypatch.setattr(jaccard_join, "_candidates", chained)
    monkeypatch.setattr(jaccard_join, "lookup_join", joined)
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randint(40, 80))) for _ in range(60)]
    near = [f"{texts[0]} x{n}" for n in range(12)]
    rows = list(enumerate(texts + [f"{t} more" for t in texts[:20]] + near))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jaccard_join.groups(docs, 3, 80).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect())) == sorted(brute_groups(rows, 3, 80))
    [(cells, bins)] = seen
    assert cells < 4 * len(rows) and bins > cells / 64


def test_components_of_random_edges(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(n, n + 1) for n in range(1000, 1100)] + [(5, 5)]
    table = spark.createDataFrame(edges, "x long, y long").repartition(5)
    got = {r["node"]: r["root"] for r in components.components(table).collect()}
    root = components.roots(1101, *np.array(edges).T)
    assert got == {n: root[n] for e in edges for n in e if e[0] != e[1]}
    assert components.components(table.limit(0)).count() == 0


def brute_lines(rows, min_lines):
    ordered = sorted(((i, t) for i, t in rows), key=repr)
    first, places = {}, {}
    for i, t in rows:
        lines = (t or "").split("\n")
        for n in range(len(lines) - min_lines + 1):
            run = tuple(lines[n : n + min_lines])
            if any(line.strip() for line in run):
                places.setdefault(run, []).append((i, n))
        for n, line in enumerate(lines):
            if min_lines > 1 and len(line.split()) >= 50:
                places.setdefault((line,), []).append((i, n))
    first = {run: min(at) for run, at in places.items()}
    out = []
    for i, t in ordered:
        lines = (t or "").split("\n")
        gone = [False] * len(lines)
        for n in range(len(lines) - min_lines + 1):
            run = tuple(lines[n : n + min_lines])
            if run in first and (i, n) > first[run]:
                gone[n : n + min_lines] = [True] * min_lines
        for n, line in enumerate(lines):
            if (line,) in first and (i, n) > first[(line,)]:
                gone[n] = True
        runs = [len(m.group()) for m in re.finditer("1+", "".join("01"[g] for g in gone))]
        kept = "\n".join(line for line, g in zip(lines, gone) if not g)
        out.append((i, len(lines), sum(gone), len(runs), max(runs, default=0), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("min_lines", [1, 2, 3, 5])
def test_lines(spark, min_lines):
    rng = random.Random(min_lines)
    rows = [(n, "\n".join(rng.choice(["a", "b", "c", "", " ", "long line"]) for _ in range(rng.randint(0, 12)))) for n in range(40)]
    rows += [(100, None), (101, ""), (102, "a\nb\na\nb\na\nb"), (103, rows[5][1]), (104, "\n" * 50)]
    passage, short = " ".join(["word"] * 50), " ".join(["word"] * 49)
    rows += [(110, passage), (111, f"x\n{passage}"), (112, f"{passage}\ny"), (113, short), (114, short), (115, passage + "\n" + passage)]
    rows += [(116, "very long " * 40_000), (117, "very long " * 40_000)]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, names string, starts string")
    got = [tuple(r) for r in line_dedup.line_report(docs, min_lines).collect()]
    assert sorted(got, key=repr) == sorted(brute_lines(rows, min_lines), key=repr)


def test_lines_of_repeated_rows_and_none(spark):
    """A document listed twice keeps the same lines both times; an empty table has an empty report."""
    rows = [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb"), (None, "c\nd")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r)[:3] for r in line_dedup.line_report(docs).collect()), key=repr)
    assert got == sorted([(1, 3, 0), (1, 3, 0), (2, 2, 2), (None, 2, 0)], key=repr)
    assert line_dedup.line_report(docs.limit(0)).count() == 0


def test_one_licence_line_in_many_documents(spark):
    """A line of 64 words that two documents are made of stays once, whatever its neighbours."""
    line = " ".join(f"term{n}" for n in range(64))
    rows = [(1, f"one\n{line}\ntwo"), (2, line), (3, f"{line}\nthree"), (4, line)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in line_dedup.line_report(docs).collect()} == {1: 0, 2: 1, 3: 1, 4: 1}
    assert {r["doc_id"]: r["text"] for r in line_dedup.without_copies(docs).collect()} == {1: rows[0][1], 3: "three"}


def test_documents_without_copies(spark):
    rows = [(1, "a\nb\nc", 5), (2, "a\nb\nd", 5), (3, "a\nb", 3), (4, "", 0), (5, None, None), (None, "x\ny", 3), (6, "x\ny\nz", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in line_dedup.without_copies(docs).collect()}
    assert got == {1: ("a\nb\nc", 5), 2: ("d", 1), 4: ("", 0), 5: (None, None), None: ("x\ny", 3), 6: ("z", 1)}
    assert line_dedup.without_copies(docs.limit(0)).columns == docs.columns
