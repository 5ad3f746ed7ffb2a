"""Secret spans against plain regular expressions, and the ledger over several runs."""

from __future__ import annotations

import hashlib
import random
import re

from doclake.llm import secrets
from doclake.session import new_shared_path

PATTERNS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)


def brute(text):
    found = []
    for order, (kind, pattern, group, least) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            if len(m.group(group)) >= least:
                found.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(f[2] for f in sorted(found))


def texts():
    rng = random.Random(9)
    bits = ["password", "Token", "API_KEY", "apikey", "=", ":", " ", '"', "'", "secret=token: abcdefgh", "AKIA", "ABCDEFGH12345678", "deadbeef",
            "0123456789abcdef", "x", "日本", "short", "abc.def-ghi", "\n"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(150)] + [None, "", "a" * 100_000, "AKIA" * 50]


def test_spans_and_ledger(spark):
    rows = list(enumerate(texts())) + [(900, texts()[1]), (901, texts()[1]), (900, texts()[1]), (None, texts()[2])]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, spans string, blob_id string")
    ledger = new_shared_path(spark, "ledger")
    secrets.scan(docs, ledger, path_col="doc_id")
    got = sorted(((r["path"], r["spans"]) for r in secrets.findings_by_path(docs, ledger, path_col="doc_id").collect()), key=repr)
    assert got == sorted(((i, brute(t)) for i, t in rows), key=repr)
    blobs = {hashlib.sha256((t or "").encode()).hexdigest() for _, t in rows}
    scanned = spark.read.parquet(f"{ledger}/scanned")
    assert {r["blob_id"] for r in scanned.collect()} == blobs and scanned.count() == len(blobs)

    # Nothing new: no pair is scanned again.
    secrets.scan(docs, ledger, path_col="doc_id")
    assert spark.read.parquet(f"{ledger}/scanned").count() == len(blobs)

    # A new version of one path and a new rule version: only these pairs.
    later = docs.limit(0).union(spark.createDataFrame([(1, "secret = newvalue1", "x", "y")], docs.schema))
    secrets.scan(later, ledger, path_col="doc_id")
    assert spark.read.parquet(f"{ledger}/scanned").count() == len(blobs) + 1
    rules = (secrets.RULES[0], secrets.RULES[1], secrets.Rule("hex", r"[0-9a-f]{30,}", 0, 30, version=2))
    secrets.scan(docs, ledger, rules, path_col="doc_id")
    again = spark.read.parquet(f"{ledger}/scanned").where("array_contains(rules, 'hex@2')")
    assert again.count() == len(blobs) and {tuple(r["rules"]) for r in again.collect()} == {("hex@2",)}
    found = {r["path"]: r["spans"] for r in secrets.findings_by_path(later, ledger, path_col="doc_id").collect()}
    assert found == {1: "assign:0:18"}

    empty = new_shared_path(spark, "ledger")
    secrets.scan(docs.limit(0), empty, path_col="doc_id")
    assert secrets.findings_by_path(docs.limit(0), empty, path_col="doc_id").count() == 0
