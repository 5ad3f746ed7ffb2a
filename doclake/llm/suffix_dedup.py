"""Byte runs that occur in a document with a smaller id, over shards of suffixes.

A *window* is a string of ``WINDOW`` bytes within a document.  Every window names
its shard by itself: of all its grams of ``GRAM`` bytes the one of least hash (the
leftmost of equals).  Equal windows have equal grams, so they meet in one shard
wherever they stand, and shards are sorted on their own.  Neighbouring windows
mostly share their gram and travel together as one *stretch* of text.

Copies of a whole text lose all of it and take no further part.

1. Blocks of documents send the hashes of their grams to the shards, each hash
   once per block, and hear which of them occur in another document.
2. Only stretches around such grams are sent, each distinct stretch once per
   block with the smallest id that holds it.
3. A shard merges equal stretches, and where stretches around one gram differ it
   sorts their suffixes (``suffix_sort``): neighbours with a common prefix of at
   least a window form an interval, whose windows are equal; its smallest id is
   theirs.
4. Blocks hear the smallest id for each window of their stretches; a document
   with a larger id loses the bytes of that window.

What a shard gets for a stretch that a third of all documents share is one entry
per block.  Nothing is capped: what does not travel cannot have a partner.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclake.llm.common import slices_by_bytes
from doclake.llm.shingles import mix
from doclake.llm.suffix_sort import suffix_array
from doclake.session import broadcast_if, fits_broadcast, lookup_join, stored

WINDOW = 50
GRAM = 24
BLOCK_BYTES = 2 * 1024 * 1024
SHARD_BYTES = 8 * 1024 * 1024

_LAST = np.iinfo(np.int64).max
_NO_ANSWER = np.iinfo(np.uint32).max
_SALT = np.uint64(0x2545F4914F6CDD1D)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, version, text)``; a null id comes after all others."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text")
    )


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a batch, and where each text starts and the last one ends."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def stretches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(document, hash of the gram, first window, last window)``, windows by place in ``data``."""
    none = np.zeros(0, np.int64)
    starts = len(data) - WINDOW + 1
    if starts <= 0:
        return none, none.astype(np.uint64), none, none
    grams = len(data) - GRAM + 1
    padded = np.append(data, np.zeros(8, np.uint8))
    word = np.zeros(len(data), np.uint64)
    for shift in range(8):
        part = np.frombuffer(padded.tobytes(), "<u8", count=(len(padded) - shift) // 8, offset=shift)
        word[shift::8] = part[: len(word[shift::8])]
    value = word[:grams]
    for at in range(8, GRAM, 8):
        value = mix(value * _SALT + word[at : grams + at])
    # Least hash and its place over a window of grams, by doubling; the left one of equals.
    span, size = WINDOW - GRAM + 1, 1
    least, place = value, np.arange(grams)
    while size < span:
        step = min(size, span - size)
        a, b = least[: len(least) - step], least[step:]
        left = a <= b
        place = np.where(left, place[: len(place) - step], place[step:])
        least = np.where(left, a, b)
        size += step
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    within = np.flatnonzero(owner[:starts] == owner[WINDOW - 1 :])
    if not len(within):
        return none, none.astype(np.uint64), none, none
    at = place[within]
    new = np.append(True, (at[1:] != at[:-1]) | (within[1:] != within[:-1] + 1) | (owner[within[1:]] != owner[within[:-1]]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(within)) - 1
    return owner[within[first]], value[at[first]], within[first], within[last]


def _key(gram: np.ndarray, shards: int) -> np.ndarray:
    """The shard of a gram in the upper half, 32 bits of its hash in the lower."""
    return ((gram % np.uint64(shards)) << np.uint64(32)) | (gram >> np.uint64(32))


def _mark(keys: np.ndarray) -> np.ndarray:
    """32 bits of a key, enough to find it among those of one document."""
    return mix(keys).astype(np.uint32)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Parts of the rows of a task with numbers that no other task uses."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for start, end in slices_by_bytes(batch.column("text"), BLOCK_BYTES):
            yield number, batch.slice(start, end - start)
            number += 1


def _split(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Places of the keys of each shard; keys ascend."""
    shard = (keys >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else []
    for begin, end in zip(first, np.append(first[1:], len(shard)) if len(shard) else []):
        yield int(shard[begin]), np.arange(begin, end)


def _dealt(sent: DataFrame) -> DataFrame:
    """Rows by shard; what a block keeps to itself (shards below zero) travels with its block."""
    own = -1 - F.pmod(F.xxhash64("block"), F.lit(1 << 20)).cast("int")
    return sent.withColumn("to", F.when(F.col("shard") >= 0, F.col("shard")).otherwise(own))


def _batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])


def _gather(batches: Iterator[pa.RecordBatch], names: list[str]) -> list[tuple]:
    rows: list[tuple] = []
    for batch in batches:
        rows += zip(*(batch.column(n).to_pylist() for n in names))
    return rows


def shared_grams(rows: DataFrame, shards: int) -> DataFrame:
    """``(doc_id, version, keys)``: grams of a document that occur in another one as well."""
    fields = [("shard", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("docs", pa.binary())]
    schema = "shard int, block long, keys binary, docs binary"
    names = [n for n, _ in fields]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, part in _blocks(batches):
            data, offsets = _bytes(part.column("text"))
            owner, gram, _, _ = stretches(data, offsets)
            keys = _key(gram, shards)
            order = np.lexsort((owner, keys))
            keys, owner = keys[order], owner[order]
            if len(keys):
                once = np.append(True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1]))
                keys, owner = keys[once], owner[once]
            new = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
            first = np.flatnonzero(new)
            several = np.diff(np.append(first, len(keys))) > 1
            known = np.repeat(several, np.diff(np.append(first, len(keys))))
            # Shard -1 is the answer for what the block already knows, -2 names its documents.
            out = [(-2, block, part.column("doc_id").to_numpy().tobytes(), part.column("version").to_numpy().tobytes())]
            out.append((-1, block, _mark(keys[known]).tobytes(), owner[known].astype("<u4").tobytes()))
            # A gram that several documents of the block hold needs no answer, and names none.
            keys, owner = keys[first], np.where(several, _NO_ANSWER, owner[first])
            for shard, at in _split(keys):
                low = (keys[at] & np.uint64(0xFFFFFFFF)).astype("<u4")
                out.append((shard, block, low.tobytes(), owner[at].astype("<u4").tobytes()))
            yield _batch(out, fields)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _gather(batches, names)
        out = [row for row in got if row[0] < 0]
        got = [row for row in got if row[0] >= 0]
        counts = [len(r[2]) // 4 for r in got]
        low = np.frombuffer(b"".join(r[2] for r in got), "<u4")
        owner = np.frombuffer(b"".join(r[3] for r in got), "<u4")
        values, number, times = np.unique(low, return_inverse=True, return_counts=True)
        shared = times > 1
        shared[number[owner == _NO_ANSWER]] = True
        keep = shared[number] & (owner != _NO_ANSWER)
        begin = 0
        for (shard, block, keys, docs), count in zip(got, counts):
            at = keep[begin : begin + count]
            if at.any():
                full = np.frombuffer(keys, "<u4")[at].astype("<u8") | np.uint64(shard << 32)
                out.append((-1, block, _mark(full).tobytes(), np.frombuffer(docs, "<u4")[at].tobytes()))
            begin += count
        yield _batch(out, fields)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _gather(batches, ["shard", "keys", "docs"])
        ids, versions = next((np.frombuffer(r[1], "<i8"), np.frombuffer(r[2], "<i8")) for r in got if r[0] == -2)
        keys = np.frombuffer(b"".join(r[1] for r in got if r[0] == -1), "<u4")
        docs = np.frombuffer(b"".join(r[2] for r in got if r[0] == -1), "<u4")
        order = np.lexsort((keys, docs))
        keys, docs = keys[order], docs[order]
        bounds = np.searchsorted(docs, np.arange(len(ids) + 1))
        out = [(int(ids[d]), int(versions[d]), keys[b:e].tobytes()) for d, (b, e) in enumerate(zip(bounds[:-1], bounds[1:])) if b < e]
        yield _batch(out, [("doc_id", pa.int64()), ("version", pa.int64()), ("keys", pa.binary())])

    answers = _dealt(rows.mapInArrow(send, schema)).groupBy("to").applyInArrow(answer, schema)
    # Rows that repeat id and text have one answer.
    found = answers.groupBy("block").applyInArrow(collect, "doc_id long, version long, keys binary")
    return found.groupBy("doc_id", "version").agg(F.any_value("keys").alias("keys"))


def _pieces(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[bytes]:
    whole = data.tobytes()
    return [whole[b : e + WINDOW] for b, e in zip(first.tolist(), last.tolist())]


def repeated(rows: DataFrame, shards: int) -> DataFrame:
    """``(doc_id, version, starts, ends)``: byte ranges that also start in a smaller document."""
    fields = [
        ("shard", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("sizes", pa.binary()),
        ("ids", pa.binary()), ("numbers", pa.binary()), ("text", pa.binary()),
    ]
    schema = "shard int, block long, keys binary, sizes binary, ids binary, numbers binary, text binary"
    names = [n for n, _ in fields]
    sharing = lookup_join(rows, shared_grams(rows, shards), ["doc_id", "version"], "inner")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for block, part in _blocks(batches):
            data, offsets = _bytes(part.column("text"))
            ids = part.column("doc_id").to_numpy()
            owner, gram, first, last = stretches(data, offsets)
            keys = _key(gram, shards)
            marks, chosen = _mark(keys), np.zeros(len(keys), bool)
            bounds = np.searchsorted(owner, np.arange(len(ids) + 1))
            for doc, wanted in enumerate(part.column("keys").to_pylist()):
                b, e = bounds[doc], bounds[doc + 1]
                chosen[b:e] = np.isin(marks[b:e], np.frombuffer(wanted, "<u4"))
            owner, keys, first, last = owner[chosen], keys[chosen], first[chosen], last[chosen]
            texts = _pieces(data, first, last)
            number: dict[tuple[int, bytes], int] = {}
            which = np.array([number.setdefault(k, len(number)) for k in zip(keys.tolist(), texts)], np.int64)
            least = np.full(len(number), _LAST)
            np.minimum.at(least, which, ids[owner])
            # Shard -1 keeps which document has which stretch where, -2 names the documents.
            place = (first - offsets[owner]).astype("<u4")
            out = [
                (-2, block, ids.tobytes(), part.column("version").to_numpy().tobytes(), b"", b"", b""),
                (-1, block, which.astype("<u4").tobytes(), owner.astype("<u4").tobytes(), place.tobytes(), b"", b""),
            ]
            listed = list(number)
            own = np.array([k for k, _ in listed], np.uint64)
            order = np.argsort(own, kind="stable")
            for shard, at in _split(own[order]):
                at = order[at]
                pieces = [listed[n][1] for n in at.tolist()]
                sizes = np.array([len(p) for p in pieces], "<u4")
                out.append(
                    (shard, block, own[at].tobytes(), sizes.tobytes(), least[at].tobytes(), at.astype("<u4").tobytes(), pack(b"".join(pieces)))
                )
            yield _batch(out, fields)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _gather(batches, names)
        out = [row for row in got if row[0] < 0]
        got = [row for row in got if row[0] >= 0]
        merged = _least_ids(got)
        for (_, block, _, _, _, numbers, _), (lengths, values, counts) in zip(got, merged):
            out.append((-3, block, numbers, counts.astype("<u4").tobytes(), values.tobytes(), lengths.astype("<u4").tobytes(), b""))
        yield _batch(out, fields)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _batch(_ranges(_gather(batches, names)), [("doc_id", pa.int64()), ("version", pa.int64()), ("starts", pa.binary()), ("ends", pa.binary())])

    answers = _dealt(sharing.mapInArrow(send, schema)).groupBy("to").applyInArrow(answer, schema)
    found = answers.groupBy("block").applyInArrow(collect, "doc_id long, version long, starts binary, ends binary")
    return found.groupBy("doc_id", "version").agg(F.any_value(F.struct("starts", "ends")).alias("r")).select("doc_id", "version", "r.*")


def _least_ids(got: list[tuple]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per row of a shard the smallest id of each window of its stretches, as runs.

    Returns lengths and ids of the runs, and how many runs each stretch has.
    """
    number: dict[tuple[int, bytes], int] = {}
    least: list[int] = []
    which: list[list[int]] = []
    unpack = zstandard.ZstdDecompressor().decompress
    for _, _, keys, sizes, ids, _, packed in got:
        row, at, text = [], 0, unpack(packed)
        for key, size, doc in zip(np.frombuffer(keys, "<u8").tolist(), np.frombuffer(sizes, "<u4").tolist(), np.frombuffer(ids, "<i8").tolist()):
            n = number.setdefault((key, text[at : at + size]), len(number))
            at += size
            if n == len(least):
                least.append(doc)
            elif doc < least[n]:
                least[n] = doc
            row.append(n)
        which.append(row)
    keys = np.array([k for k, _ in number], np.uint64)
    _, group, times = np.unique(keys, return_inverse=True, return_counts=True) if len(keys) else (None, keys, keys)
    several = np.flatnonzero(times[group] > 1) if len(keys) else np.zeros(0, np.int64)
    listed = [text for _, text in number]
    runs: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    if len(several):
        texts = [listed[n] for n in several.tolist()]
        runs = dict(zip(several.tolist(), _window_minima(texts, np.array(least)[several])))
    out = []
    for row in which:
        parts = [runs.get(n) or (np.array([len(listed[n]) - WINDOW + 1]), np.array([least[n]])) for n in row]
        empty = np.zeros(0, np.int64)
        out.append(
            (
                np.concatenate([p[0] for p in parts] or [empty]),
                np.concatenate([p[1] for p in parts] or [empty]).astype("<i8"),
                np.array([len(p[0]) for p in parts], np.int64),
            )
        )
    return out


def _window_minima(texts: list[bytes], ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Smallest id over all texts that hold a window, for each window of each text, as runs."""
    # Letter 0 parts the texts; windows never reach it.
    joined = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 1
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    joined = np.insert(joined, ends, 0)
    starts = ends - sizes + np.arange(len(texts))
    windows = sizes - WINDOW + 1
    order, common = suffix_array(joined, WINDOW)
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    place = np.arange(len(joined)) - starts[owner]
    counted = place < windows[owner]
    # Intervals of the suffix array; only suffixes with a whole window are in one.
    interval = np.cumsum(common < WINDOW)
    smallest = np.full(int(interval[-1]) + 1, _LAST)
    taken = counted[order]
    np.minimum.at(smallest, interval[taken], ids[owner[order[taken]]])
    result = np.full(len(joined), _LAST)
    result[order[taken]] = smallest[interval[taken]]
    out = []
    for start, count in zip(starts.tolist(), windows.tolist()):
        values = result[start : start + count]
        first = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
        out.append((np.diff(np.append(first, count)), values[first]))
    return out


def _ranges(got: list[tuple]) -> list[tuple]:
    """``(doc_id, version, starts, ends)`` of one block from its documents, stretches and answers."""
    names = next(r for r in got if r[0] == -2)
    ids, versions = np.frombuffer(names[2], "<i8"), np.frombuffer(names[3], "<i8")
    members = next(r for r in got if r[0] == -1)
    which, owner, place = (np.frombuffer(members[k], "<u4").astype(np.int64) for k in (2, 3, 4))
    runs: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for row in got:
        if row[0] == -3:
            numbers, counts, lengths = (np.frombuffer(row[k], "<u4").astype(np.int64) for k in (2, 3, 5))
            values = np.frombuffer(row[4], "<i8")
            at = np.cumsum(counts) - counts
            for n, b, c in zip(numbers.tolist(), at.tolist(), counts.tolist()):
                runs[n] = (np.cumsum(lengths[b : b + c]), values[b : b + c])
    found: dict[int, list[tuple[int, int]]] = {}
    for n, doc, at in zip(which.tolist(), owner.tolist(), place.tolist()):
        ends, values = runs[n]
        begin = 0
        for end, smallest in zip(ends.tolist(), values.tolist()):
            if smallest < ids[doc]:
                found.setdefault(doc, []).append((at + begin, at + end - 1 + WINDOW))
            begin = end
    out = []
    for doc, ranges in found.items():
        ranges.sort()
        joined = [list(ranges[0])]
        for start, end in ranges[1:]:
            if start <= joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], end)
            else:
                joined.append([start, end])
        starts, ends = np.array(joined, "<u4").T
        out.append((int(ids[doc]), int(versions[doc]), starts.tobytes(), ends.tobytes()))
    return out


def _whole_copies(rows: DataFrame) -> DataFrame:
    """``(doc_id, version, n_bytes)`` of texts that a smaller id has as a whole."""
    thin = rows.select("doc_id", "version", F.xxhash64(F.lit(1), "text").alias("other"), F.octet_length("text").alias("n_bytes"))
    thin = stored(thin, "texts")
    firsts = thin.groupBy("version", "other", "n_bytes").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    firsts = firsts.where("first < last").drop("last")
    found = lookup_join(thin, firsts, ["version", "other", "n_bytes"], "inner").where("doc_id > first")
    return found.select("doc_id", "version", "n_bytes").distinct()


def removed_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, version, starts, ends)`` of documents that lose bytes, packed as 32-bit offsets."""
    rows = _rows(docs, id_col, text_col)
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    copies = stored(_whole_copies(rows), "copies")
    gone = copies.select("doc_id", "version")
    singles = rows.join(broadcast_if(fits_broadcast(gone), gone), ["doc_id", "version"], "left_anti")
    found = repeated(singles, max(1, -(-int(total) // SHARD_BYTES)))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("n_bytes").to_numpy().astype("<u4")
            starts = [b"\0\0\0\0"] * len(sizes)
            ends = [size.tobytes() for size in sizes]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("version"), pa.array(starts, pa.binary()), pa.array(ends, pa.binary())],
                ["doc_id", "version", "starts", "ends"],
            )

    long_enough = copies.where(F.col("n_bytes") >= WINDOW)
    return found.unionByName(long_enough.mapInArrow(whole, "doc_id long, version long, starts binary, ends binary"))


def byte_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)``, one row per row of ``docs``.

    A byte goes if a string of ``WINDOW`` bytes that covers it also starts in a
    document with a smaller id; strings are judged on the input, matches never
    cross documents, and a document does not match itself or one of its own id.
    Whole texts as UTF-8, null texts are empty.  A null id comes after all
    others.  Other columns are left out; an empty table gives an empty result.
    """
    rows = _rows(docs, id_col, text_col)
    found = lookup_join(rows, removed_ranges(docs, id_col, text_col), ["doc_id", "version"], "left")

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "starts", "ends"))):
                data = text.encode()
                pairs = list(zip(*(np.frombuffer(x or b"", "<u4").tolist() for x in (starts, ends))))
                kept, at = hashlib.sha256(), 0
                for start, end in pairs:
                    kept.update(data[at:start])
                    at = end
                kept.update(data[at:])
                gone = sum(end - start for start, end in pairs)
                out.append((None if doc == _LAST else doc, len(data), gone, len(pairs), kept.hexdigest()))
            yield _batch(out, [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    return found.select("doc_id", "text", "starts", "ends").mapInArrow(
        report, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )
