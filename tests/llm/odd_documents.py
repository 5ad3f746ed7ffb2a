"""Documents with everything that may go wrong, as fixtures for the tests of this folder."""

from __future__ import annotations

import random

import pytest


def words(rng, count, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(count))


@pytest.fixture(scope="module")
def odd_rows():
    """Ids and texts with everything that may go wrong: nulls, empty, long, ties, repeated rows."""
    rng = random.Random(11)
    base = [words(rng, rng.randint(3, 120)) for _ in range(30)]
    rows = list(enumerate(base))
    rows += [(100 + n, base[n]) for n in range(8)]  # exact copies
    for n in range(8):  # near copies
        changed = base[n].split(" ")
        changed[len(changed) // 2] = "zz"
        rows.append((200 + n, " ".join(changed)))
    passage = words(random.Random(5), 70)
    rows += [(300 + n, words(rng, 20) + ". " + passage + " " + words(rng, 20)) for n in range(5)]
    rows += [(400, None), (401, ""), (402, " "), (403, "\n\n\n"), (404, "x" * 200_000), (405, "  two  spaces \n after "), (None, base[3])]
    rows += [(0, base[0]), (0, base[0]), (1, "another text of an id that is there"), (406, "αβγ ÄÖÜ 日本語 é́ \t tab"), (407, "a\nb\na\nb\na\nb")]
    rows += [(408, words(rng, 30_000, 50_000)), (409, "a " * 5_000)]
    return rows


@pytest.fixture(scope="module")
def odd_docs(spark, odd_rows):
    """The odd rows with columns whose names the operators use themselves."""
    extra = "n_tokens string, score string, node string, version string, block string, line string, side string, hash string"
    rows = [(i, t, *("x",) * 8) for i, t in odd_rows]
    return spark.createDataFrame(rows, f"doc_id long, text string, {extra}").repartition(3)


@pytest.fixture(scope="module")
def no_docs(odd_docs):
    return odd_docs.limit(0)
