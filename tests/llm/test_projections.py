"""Near copies among vectors against all pairs."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from doclake.llm import projection_dedup
from doclake.llm.components import roots
from doclake.llm.projection_dedup import link_counts, near_copies, passes_for, verified_edges

SCHEMA = "vec_id long, embedding array<double>, label int, h string, root int"


def brute(rows, threshold=0.98):
    """``{row: (links, smallest id)}`` over all pairs of rows."""
    fit = {}
    for n, (_, v, label) in enumerate(rows):
        if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v) / np.abs(v).max()
            fit[n] = x / np.linalg.norm(x)
    left, right = [], []
    for a in fit:
        for b in fit:
            if a < b and rows[a][2] == rows[b][2] and len(fit[a]) == len(fit[b]) and fit[a] @ fit[b] >= threshold:
                left.append(a)
                right.append(b)
    root = roots(len(rows), np.array(left, int), np.array(right, int))
    degree = np.bincount(np.array(left + right, int), minlength=len(rows))
    out = []
    for n, (vec_id, _, _) in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if root[m] == root[n] and rows[m][0] is not None]
        low = min(ids, default=None)
        out.append((vec_id, int(degree[n]), low, vec_id == low))
    return sorted(out, key=str)


def some_vectors():
    rng = np.random.default_rng(5)
    base = rng.standard_normal((120, 24))
    rows = [(n, v.tolist(), n % 3) for n, v in enumerate(base)]
    rows += [(200 + n, (base[n] + 0.1 * rng.standard_normal(24)).tolist(), n % 3) for n in range(60)]
    rows += [(300 + n, base[1].tolist(), 1) for n in range(40)]  # exact copies
    rows += [(400 + n, (base[2] + 0.02 * rng.standard_normal(24)).tolist(), 2) for n in range(90)]  # a dense group
    rows += [(500 + n, (base[2] + 0.13 * rng.standard_normal(24)).tolist(), 2) for n in range(40)]  # some linked with part of it
    rows += [(600, (base[5] * 7).tolist(), 2), (601, base[5].tolist(), None), (602, base[5].tolist(), 0), (603, None, 1)]
    rows += [(604, [], 1), (605, [0.0] * 24, 1), (606, [float("nan")] * 24, 1), (607, [None] * 24, 1), (608, [1.0, 2.0], 1)]
    rows += [(609, [float("inf")] * 24, 1), (610, (base[7] * 1e300).tolist(), 1), (611, [1e-320] + [0.0] * 23, 1), (612, [0.5, 1.0], 1)]
    rows += [(None, base[1].tolist(), 1), (None, None, None), (None, (base[8] * 2).tolist(), 2), (3, base[9].tolist(), 0), (3, base[3].tolist(), 0)]
    return rows


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(parts)


@pytest.mark.parametrize("cell", [2048, 32])
def test_near_copies_equal_all_pairs(spark, monkeypatch, cell):
    monkeypatch.setattr(link_counts, "__defaults__", (0.98, cell))
    rows = some_vectors()
    got = [tuple(r) for r in near_copies(frame(spark, rows), passes=20).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_no_vectors(spark):
    rows = frame(spark, some_vectors())
    assert near_copies(rows.limit(0)).count() == 0
    alone = near_copies(rows.where("vec_id in (603, 604, 605)")).collect()
    assert {tuple(r) for r in alone} == {(n, 0, n, True) for n in (603, 604, 605)}


def test_recall_at_the_threshold(spark):
    """Pairs with a cosine of just over 0.98, all in one label: at least nine of ten are found."""
    rng = np.random.default_rng(8)
    one = rng.standard_normal((3000, 32))
    one /= np.linalg.norm(one, axis=1)[:, None]
    side = rng.standard_normal((3000, 32))
    side -= (side * one).sum(1)[:, None] * one
    side /= np.linalg.norm(side, axis=1)[:, None]
    two = 0.9801 * one + math.sqrt(1 - 0.9801**2) * side
    rows = [(2 * n, v.tolist(), 1) for n, v in enumerate(one)] + [(2 * n + 1, v.tolist(), 1) for n, v in enumerate(two)]
    found = near_copies(frame(spark, rows)).where("n_links > 0").count()
    assert found >= 0.97 * 6000
    assert passes_for(10) == 1 and passes_for(6000) <= 8 and passes_for(10**9) < 40


def test_a_dense_group_sends_no_pairs(spark):
    """Edges of a group that is linked throughout stay in proportion to its vectors."""
    rng = np.random.default_rng(2)
    base = rng.standard_normal(16)
    rows = [(n, (base + 0.01 * rng.standard_normal(16)).tolist(), 1) for n in range(1500)]
    _, sets = projection_dedup.classes(frame(spark, rows), "vec_id", "embedding", "label")
    edges = verified_edges(sets, 3)
    assert edges.count() <= 3 * 2 * 1500
    got = near_copies(frame(spark, rows))
    assert got.agg(F.min("n_links"), F.max("n_links"), F.max("component_id")).first() == (1499, 1499, 0)
