"""Phrase collocations by dynamic itemset counting.

Documents are dealt into shards that are scanned one after the other, round and round.
Words are counted from the first scan on.  A longer phrase becomes active as soon as
both its subphrases, the one without its last and the one without its first word, have
been seen often enough, is counted from the next scan on, and has its exact count when
every shard was scanned once since: one full cycle.  Lengths are counted interleaved in
the same scans, so ``shards`` scans per length are the most that is needed, and fewer
where phrases become active early.

How it is laid out:

* A step scans one shard: tasks count the active phrases in their texts as numbers and
  return one row per distinct phrase, so a frequent phrase is aggregated before it is
  shuffled.  Counts are then summed by a shuffle on the phrase.
* Which phrases have reached the threshold goes to the tasks as a table of ``2 **
  slot_bits`` bytes per length, whatever the input: the step from which phrases that
  fall into a slot are active.  Phrases that share a slot become active together; the
  ones among them that are rare are counted and dropped.  Whether a phrase is counted
  in a scan depends on the tables alone, so every count is of one full cycle.
* The phrases counted from one step on are a cohort with tables of its own.
* Scores are joins on phrases; the best of each language are cut in every task before
  they are shuffled (a window with a group limit).  Only words of phrases that remain,
  ties included, are looked up in the texts for their spelling.

Words are compared by 64-bit hashes that take in the language.  Texts are read once per
step and once for the spelling.  A null text is empty, a null language is ``und``; rows
with equal ids are documents of their own; other columns are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclake.llm.common import slices_by_bytes
from doclake.llm.shingles import mix
from doclake.session import lookup_join, stored

MAX_WORDS = 3
LEAST = 10
SHARE = 50
TOP = 2000
SCALE = 1_000_000
SHARDS = 2
SLOT_BITS = 23
NEVER = 255

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BLOCK_BITS = 16
_SLICE_BYTES = 1 << 20
_HELD_ROWS = 1 << 18

_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[ord(c) for c in ".,;:!?"] + [0x0A, 0x0B, 0x0C, 0x0D]] = 2
_BREAK = re.compile(rb"[.,;:!?\x0A-\x0D]")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)


class Words:
    """The words of some texts: hashes, the piece each lies in, and where it stands."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, salts: np.ndarray) -> None:
        """``bounds`` are the ends of the texts in ``data``, ``salts`` the hashes of their languages."""
        kind = _KIND[data]
        word = kind == 0
        opens = word.copy()
        opens[1:] &= ~word[:-1]
        firsts = bounds[:-1][bounds[:-1] < bounds[1:]]
        opens[firsts] |= word[firsts]
        self.data, self.starts = data, np.flatnonzero(opens)
        count = len(self.starts)
        if not count:
            self.hashes, self.piece, self.owner = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            return
        # A word ends before the next byte that is none, or where its text ends.
        limits = np.append(np.union1d(np.flatnonzero(~word), firsts), len(data))
        self.ends = limits[np.searchsorted(limits, self.starts, side="right")]
        lengths = self.ends - self.starts
        within = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        value = _VALUES[_LOWER[data[np.repeat(self.starts, lengths) + within]]]
        powers = np.full(int(lengths.max()), _STEP | np.uint64(1), np.uint64)
        powers[0] = 1
        value *= np.cumprod(powers, dtype=np.uint64)[within]
        self.owner = np.searchsorted(bounds, self.starts, side="right") - 1
        self.hashes = mix(mix(np.add.reduceat(value, np.cumsum(lengths) - lengths)) ^ salts[self.owner])
        self.piece = np.cumsum(kind == 2)[self.starts] + self.owner


def batches_of_words(batch: pa.RecordBatch) -> Iterator[tuple[Words, list[str]]]:
    """The words of ``(lang, text)`` rows, in slices of bounded size; a long text is cut between pieces."""
    texts = batch.column("text").cast(pa.large_binary())
    langs = batch.column("lang").to_pylist()
    salt = {lang: np.frombuffer(hashlib.blake2b(lang.encode(), digest_size=8).digest(), np.uint64)[0] for lang in set(langs)}
    for start, stop in slices_by_bytes(texts, _SLICE_BYTES):
        part, own = texts.slice(start, stop - start), langs[start:stop]
        salts = np.array([salt[lang] for lang in own], np.uint64)
        offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
        if part.buffers()[2] is None or offsets[0] == offsets[-1]:
            continue
        data = np.frombuffer(part.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        if stop - start > 1 or len(data) <= 2 * _SLICE_BYTES:
            yield Words(data, offsets - offsets[0], salts), own
            continue
        whole, at = data.tobytes(), 0
        while at < len(whole):
            found = _BREAK.search(whole, at + _SLICE_BYTES)
            end = found.end() if found else len(whole)
            yield Words(data[at:end], np.array([0, end - at]), salts), own
            at = end


def phrase_hashes(columns: list[np.ndarray]) -> np.ndarray:
    """One number per phrase, from the numbers of its words."""
    out = columns[0]
    for column in columns[1:]:
        out = mix(out * _STEP + column)
    return out


def word_columns(length: int) -> list[str]:
    return [f"w{k}" for k in range(1, length + 1)]


class _Counts:
    """Counts of phrases of one length and cohort, kept small by adding up."""

    def __init__(self) -> None:
        self.held, self.rows = [], 0

    def add(self, columns: list[np.ndarray], counts: np.ndarray) -> None:
        key = phrase_hashes(columns)
        order = np.argsort(key, kind="stable")
        first = np.append(True, np.diff(key[order]) != 0)[: len(key)]
        at = np.flatnonzero(first)
        if len(at):
            self.held.append(([c[order][at] for c in columns], np.add.reduceat(counts[order], at)))
            self.rows += len(at)

    def pack(self) -> None:
        held, self.held, self.rows = self.held, [], 0
        if held:
            self.add([np.concatenate(c) for c in zip(*(h[0] for h in held))], np.concatenate([h[1] for h in held]))

    def taken(self) -> tuple[list[np.ndarray], np.ndarray] | None:
        self.pack()
        held, self.held, self.rows = self.held, [], 0
        return held[0] if held else None


def _scan(tables, step: int, shards: int, max_words: int, slot_bits: int):
    """A function for ``mapInArrow``: the counts of what is active in this step."""
    names = ["length", "cohort", "lang", *word_columns(max_words), "n"]

    def rows_of(length: int, cohort: int, lang: str | None, found) -> pa.RecordBatch:
        columns, counts = found
        size = len(counts)
        out = [pa.array(np.full(size, length, np.int32)), pa.array(np.full(size, cohort, np.int32))]
        out.append(pa.DictionaryArray.from_arrays(np.zeros(size, np.int32), [lang]).cast(pa.string()) if lang is not None else pa.nulls(size, pa.string()))
        out += [pa.array(c.view(np.int64)) for c in columns] + [pa.nulls(size, pa.int64())] * (max_words - length)
        return pa.RecordBatch.from_arrays([*out, pa.array(counts)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        since = tables.value
        mask = np.uint64((1 << slot_bits) - 1)
        held: dict[tuple[int, int, str | None], _Counts] = {}

        def count(length: int, cohort: int, lang: str | None, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            counts = held.setdefault((length, cohort, lang), _Counts())
            counts.add(columns, np.ones(len(columns[0]), np.int64))
            if counts.rows > _HELD_ROWS:
                counts.pack()
                if counts.rows > _HELD_ROWS // 2:
                    yield rows_of(length, cohort, lang, counts.taken())

        for batch in batches:
            for words, langs in batches_of_words(batch):
                x, piece = words.hashes, words.piece
                if step < shards and len(x):
                    for lang in set(langs):
                        own = np.array([one == lang for one in langs])[words.owner]
                        yield from count(1, 0, lang, [x[own]])
                active = since[0][x & mask] if since else None
                for length in range(2, max_words + 1):
                    size = len(x) - length + 1
                    if size < 1:
                        break
                    cohort = np.maximum(active[:size], active[1 : size + 1])
                    cohort[piece[:size] != piece[length - 1 :]] = NEVER
                    live = (cohort <= step) & (cohort.astype(np.int64) + shards > step)
                    for one in np.unique(cohort[live]):
                        at = np.flatnonzero(live & (cohort == one))
                        yield from count(length, int(one), None, [x[at + k] for k in range(length)])
                    if length < max_words:
                        known = np.full(size, NEVER, np.uint8)
                        at = np.flatnonzero(cohort <= step)
                        slot = phrase_hashes([x[at + k] for k in range(length)]) & mask
                        known[at] = np.maximum(cohort[at], since[length - 1][slot])
                        active = known
        for (length, cohort, lang), counts in held.items():
            found = counts.taken()
            if found is not None:
                yield rows_of(length, cohort, lang, found)

    return run


def slots_of(phrases: DataFrame, length: int, slot_bits: int) -> list[tuple[int, np.ndarray]]:
    """Which slots some of the phrases fall into: blocks of bits with the slot each begins at.

    There are 2 ** slot_bits bits at most, whatever the input.
    """
    low = np.uint64((1 << slot_bits) - 1)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_numpy().astype(np.int64).view(np.uint64) for c in batch.columns]
            found = np.unique(phrase_hashes(columns) & low).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found >> _BLOCK_BITS), pa.array(found & ((1 << _BLOCK_BITS) - 1))], ["block", "slot"])

    def packed(rows: pa.Table) -> pa.Table:
        bits = np.zeros(1 << _BLOCK_BITS, bool)
        bits[rows.column("slot").to_numpy()] = True
        return pa.table({"block": rows.column("block")[:1], "bits": [np.packbits(bits).tobytes()]})

    found = phrases.select(*word_columns(length)).mapInArrow(slots, "block long, slot long").distinct()
    blocks = found.groupBy("block").applyInArrow(packed, "block long, bits binary").collect()
    return [(row["block"] << _BLOCK_BITS, np.frombuffer(row["bits"], np.uint8)) for row in blocks]


def mark(table: np.ndarray, slots: list[tuple[int, np.ndarray]], value: int) -> bool:
    """Write a value to the marked slots that hold a larger one; says whether there were any."""
    changed = False
    for first, bits in slots:
        part = table[first : first + (1 << _BLOCK_BITS)]
        fresh = np.unpackbits(bits)[: len(part)].astype(bool) & (part > value)
        part[fresh] = value
        changed = changed or bool(fresh.any())
    return changed


def phrase_counts(
    rows: DataFrame, max_words: int = MAX_WORDS, least: int = LEAST, shards: int = SHARDS, slot_bits: int = SLOT_BITS
) -> tuple[list[DataFrame], DataFrame]:
    """Exact counts of all phrases that occur ``least`` times, and the number of words per language.

    ``rows`` holds ``(shard, lang, text)``.  The first value lists one table ``(w1, ...,
    n)`` per length, with ``lang`` for single words; the second is ``(lang, n_words)``.
    """
    spark = rows.sparkSession
    # From which step on what follows a phrase of a slot is active, for every length but the last.
    since = [np.full(1 << slot_bits, NEVER, np.uint8) for _ in range(max_words - 1)]
    out = "length int, cohort int, lang string, " + ", ".join(f"{w} long" for w in word_columns(max_words)) + ", n long"
    scans: list[DataFrame] = []
    done: dict[int, list[DataFrame]] = {length: [] for length in range(1, max_words + 1)}
    step, last = 0, shards - 1
    while step <= last:
        if step >= NEVER:
            raise ValueError("too many shards")
        tables = spark.sparkContext.broadcast(since)
        shard = rows.where(F.col("shard") == step % shards).select("lang", "text")
        scans.append(stored(shard.mapInArrow(_scan(tables, step, shards, max_words, slot_bits), out), "phrases"))
        tables.destroy()
        reached: list[tuple[int, list]] = []
        for length in range(1, max_words + 1):
            # A phrase is active from the latest step that any table names for a part of it.
            started = [c for c in range(max(0, step - shards + 1), step + 1) if any((t == c).any() for t in since[: length - 1])]
            for cohort in ([0] if step < shards else []) if length == 1 else started:
                complete = step == cohort + shards - 1
                if length == max_words and not complete:
                    continue
                seen = reduce(DataFrame.unionByName, scans[cohort : step + 1])
                seen = seen.where((F.col("length") == length) & (F.col("cohort") == cohort))
                keys = word_columns(length) + ["lang"] * (length == 1)
                counted = seen.groupBy(*keys).agg(F.sum("n").alias("n")).where(F.col("n") >= least)
                counted = stored(counted, "counted")
                if complete:
                    done[length].append(counted)
                if length < max_words:
                    reached.append((length, slots_of(counted, length, slot_bits)))
        for length, slots in reached:
            if mark(since[length - 1], slots, step + 1):
                last = step + shards
        step += 1
    total = reduce(DataFrame.unionByName, scans[:shards]).where("length = 1").groupBy("lang").agg(F.sum("n").alias("n_words"))
    empty = scans[0].limit(0)
    counts = []
    for length, tables_of in done.items():
        keys = word_columns(length) + ["lang"] * (length == 1) + ["n"]
        counts.append(reduce(DataFrame.unionByName, [t.select(*keys) for t in tables_of]) if tables_of else empty.select(*keys))
    return counts, total


def scored(counts: list[DataFrame], share: int = SHARE) -> DataFrame:
    """Candidates with the cut that scores lowest, without those that longer ones explain.

    ``(lang, w1, ..., length, a, l, r, score)``; words beyond the length are null.
    """
    longest = len(counts)
    words = counts[0].select(F.col("w1").alias("word"), "lang")
    whole = "decimal(38,0)"
    out = []
    for length in range(2, longest + 1):
        keys = word_columns(length)
        rows = counts[length - 1].withColumnRenamed("n", "a")
        for k in range(1, length):
            for side, at, size in (("l", 0, k), ("r", k, length - k)):
                part = counts[size - 1].select(
                    *[F.col(f"w{n + 1}").alias(keys[at + n]) for n in range(size)], F.col("n").alias(f"{side}{k}")
                )
                rows = rows.join(part, keys[at : at + size])
        cuts = []
        for k in range(1, length):
            # Decimals of 38 digits, divided as whole numbers.
            rows = rows.withColumn(f"s{k}", F.expr(
                f"cast((cast({SCALE} as {whole}) * cast(a as {whole}) * cast(a as {whole}))"
                f" div (cast(l{k} as {whole}) * cast(r{k} as {whole})) as bigint)"
            ))
            cuts.append(F.struct(F.col(f"s{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
        best = F.least(*cuts) if len(cuts) > 1 else cuts[0]
        rows = rows.withColumn("best", best)
        # The most frequent candidate of any greater length that holds this one.
        holders = []
        for longer in range(length + 1, longest + 1):
            for first in range(longer - length + 1):
                holders.append(counts[longer - 1].select(*[F.col(f"w{first + n + 1}").alias(keys[n]) for n in range(length)], "n"))
        if holders:
            most = reduce(DataFrame.unionByName, holders).groupBy(*keys).agg(F.max("n").alias("held"))
            rows = rows.join(most, keys, "left")
            rows = rows.where(F.col("held").isNull() | (100 * F.col("held") < share * F.col("a")))
        rows = rows.join(words.withColumnRenamed("word", "w1"), "w1")
        beyond = [F.lit(None).cast("long").alias(w) for w in word_columns(longest)[length:]]
        out.append(rows.select("lang", *keys, *beyond, F.lit(length).alias("length"), "a", "best.l", "best.r", "best.score"))
    return reduce(DataFrame.unionByName, out)


def _spelling(wanted, slot_bits: int):
    """A function for ``mapInArrow``: words in wanted slots with their spelling, once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = wanted.value
        mask, seen = np.uint64((1 << slot_bits) - 1), np.zeros(0, np.uint64)
        for batch in batches:
            for words, _ in batches_of_words(batch):
                at = np.flatnonzero(flags[words.hashes & mask] == 0)
                found, first = np.unique(words.hashes[at], return_index=True)
                new = ~np.isin(found, seen)
                if new.any():
                    at, found = at[first[new]], found[new]
                    seen = np.union1d(seen, found)
                    data = _LOWER[words.data]
                    spelt = [data[s:e].tobytes().decode() for s, e in zip(words.starts[at], words.ends[at])]
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(spelt)], ["word", "spelt"])

    return run


def collocations(
    docs: DataFrame,
    top: int = TOP,
    max_words: int = MAX_WORDS,
    least: int = LEAST,
    share: int = SHARE,
    shards: int = SHARDS,
    slot_bits: int = SLOT_BITS,
    id_col: str = "doc_id",
    lang_col: str = "lang",
    text_col: str = "text",
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the best phrases of each language.

    ``a`` counts the phrase, ``l`` and ``r`` the two parts of its lowest-scoring cut and
    ``n`` all words of the language; ``score`` is ``floor(1000000 * a * a / (l * r))``.
    """
    spark = docs.sparkSession
    text: Column = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
        text.alias("text"),
        F.pmod(F.xxhash64(F.col(id_col), F.length(text)), F.lit(shards)).alias("shard"),
    )
    counts, total = phrase_counts(rows, max_words, least, shards, slot_bits)
    order = (F.desc("score"), F.desc("a"))
    best = scored(counts, share).withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order)))
    best = stored(best.where(F.col("place") <= top).drop("place"), "best")
    keys = word_columns(max_words)
    parts = best.select(F.explode(F.array(*keys)).alias("w1")).where("w1 is not null").distinct()
    flags = np.full(1 << slot_bits, 1, np.uint8)
    mark(flags, slots_of(parts, 1, slot_bits), 0)
    wanted = spark.sparkContext.broadcast(flags)
    spelt = stored(rows.select("lang", "text").mapInArrow(_spelling(wanted, slot_bits), "word long, spelt string"), "spelling")
    wanted.destroy()
    spelt = spelt.groupBy("word").agg(F.min("spelt").alias("spelt"))
    for n, key in enumerate(keys):
        best = lookup_join(best, spelt.select(F.col("word").alias(key), F.col("spelt").alias(f"spelt{n}")), [key], "left")
    phrase = F.concat_ws(" ", *[f"spelt{n}" for n in range(max_words)])
    named = best.withColumn("phrase", phrase)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))
    ranked = named.withColumn("rank", place).where(F.col("rank") <= top)
    ranked = lookup_join(ranked, total, ["lang"], "inner")
    return ranked.select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("n_words").alias("n"), "score"
    )
