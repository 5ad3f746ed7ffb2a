"""Phrase collocations against counting everything."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from doclake.llm import collocations

SCHEMA = "doc_id long, lang string, text string, n long, shard int, w1 string"


def brute(rows, max_words, least, top, share=50):
    counts, words = Counter(), Counter()
    for _, lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            found = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            words[lang] += len(found)
            for size in range(1, max_words + 1):
                counts.update((lang, *found[n : n + size]) for n in range(len(found) - size + 1))
    kept = {}
    for key, a in counts.items():
        if len(key) > 2 and a >= least:
            cuts = [(1_000_000 * a * a // (counts[key[: k + 1]] * counts[key[:1] + key[k + 1 :]]), k) for k in range(1, len(key) - 1)]
            score, k = min(cuts)
            kept[key] = (score, a, counts[key[: k + 1]], counts[key[:1] + key[k + 1 :]])
    gone = set()
    for key in kept:
        for size in range(2, len(key) - 1):
            for first in range(1, len(key) - size + 1):
                part = key[:1] + key[first : first + size]
                if 100 * counts[key] >= share * counts[part]:
                    gone.add(part)
    out = set()
    for lang in words:
        mine = sorted((-v[0], -v[1], " ".join(k[1:]).encode(), k) for k, v in kept.items() if k[0] == lang and k not in gone)
        for rank, (_, _, phrase, key) in enumerate(mine[:top], 1):
            score, a, left, right = kept[key]
            out.add((lang, rank, phrase.decode(), a, left, right, words[lang], score))
    return out


def some_documents():
    rng = random.Random(2)
    vocab = [f"w{n}" for n in range(40)] + ["New", "York", "CITY", "ÄRA", "日本", "don't"]
    fixed = ["new york city", "Stock  Market", "a b c d", "x\ty", "ärger IST da"]
    rows = []
    for n in range(160):
        parts = []
        for _ in range(rng.randint(0, 25)):
            parts.append(rng.choice(fixed) if rng.random() < 0.3 else " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 6))))
        rows.append((n, rng.choice(["en", "de", None, "und"]), "".join(p + rng.choice([". ", ", ", "\n", "!", " ", ";", "\r\n", " : "]) for p in parts)))
    rows += [(200, "en", None), (201, None, ""), (202, "xx", " \t\n.,"), (203, "one", "word"), (None, "en", "stock market. stock market")]
    rows += [(5, "en", "new york city")] * 12 + [(204, "en", "long words, " * 3000), (205, "hot", "same same same same " * 900)]
    return rows


@pytest.mark.parametrize("max_words,shards,slot_bits", [(3, 2, 24), (4, 3, 16), (2, 5, 17)])
def test_collocations_equal_brute_force(spark, max_words, shards, slot_bits):
    rows = some_documents()
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA).repartition(5)
    got = collocations.collocations(docs, top=60, max_words=max_words, least=10, shards=shards, slot_bits=slot_bits).collect()
    assert {tuple(r) for r in got} == brute(rows, max_words, 10, 60)
    assert len(got) == len(set(got))


def test_full_slots_change_no_result(spark, monkeypatch):
    """With so few slots that all phrases share some, more is counted and the same found."""
    monkeypatch.setattr(collocations, "_BLOCK_BITS", 4)
    rows = some_documents()
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)
    got = collocations.collocations(docs, top=2000, slot_bits=6).collect()
    assert {tuple(r) for r in got} == brute(rows, 3, 10, 2000)


def test_long_texts_are_cut_between_pieces(spark, monkeypatch):
    monkeypatch.setattr(collocations, "_SLICE_BYTES", 50)
    monkeypatch.setattr(collocations, "_HELD_ROWS", 40)
    rows = some_documents()
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)
    # Tasks take the module as it is in the package, so the function is called here.
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"lang": ["en", "de"], "text": ["one two. " * 40, "no break at all " * 30]})
    parts = list(collocations.batches_of_words(batch))
    assert len(parts) > 3 and sum(len(w.starts) for w, _ in parts) == 80 + 120
    got = collocations.collocations(docs, top=60).collect()
    assert {tuple(r) for r in got} == brute(rows, 3, 10, 60)


def test_no_documents(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert collocations.collocations(docs).count() == 0


def test_scores_past_64_bits(spark):
    """Counts whose products need over 64 bits are divided exactly."""
    a, left, right = 3_000_000_019, 5_000_000_029, 9_000_000_011
    one = spark.createDataFrame([(1, "en", left), (2, "en", right)], "w1 long, lang string, n long")
    two = spark.createDataFrame([(1, 2, a)], "w1 long, w2 long, n long")
    (row,) = collocations.scored([one, two]).collect()
    assert row["score"] == 1_000_000 * a * a // (left * right)
