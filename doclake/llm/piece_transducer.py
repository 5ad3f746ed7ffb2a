"""SentencePiece encoding and decoding as weighted finite-state transduction.

A ``.model`` file is compiled once per worker into three machines:

* the **normaliser**: the file's character map as longest-match rewriting, white
  space to the space symbol, and the space put in front;
* the **pieces**: a trie whose final states emit a piece with its weight, the
  negated score (tropical semiring: weights add along a path, the least total
  wins);
* the **fallback**: a character that no piece covers emits the pieces of its
  bytes, or the unknown piece where the file has no byte pieces.

Composed with an input these give a lattice over its positions, and the encoding
is the shortest path.  For a unigram file that is all.  For a byte-pair file the
machine is composed with one more, the **licence**: two pieces may follow each
other at weight zero if merging their joined characters by the file's ranks gives
back just these two, else at infinite weight.  A sequence whose neighbours all
have a licence is the result of merging the whole text: the first merge across
a border between two pieces would, as merges elsewhere do not touch them, happen
in the two alone as well.  So exactly one path has finite weight, and each
position is reached with at most one last piece.

The text is composed with the machines in parts, cut where the trie shows that no
piece reaches across: before a run of spaces, and on both sides of a character
in no piece.  Distinct parts are kept in a bounded cache.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from doclake.llm.common import bounded_batches, give_back, giving_back, id_and_text, slices_by_bytes
from doclake.llm.encoders import SEGMENT_CHARS, Encoder

SPACE = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0
INFINITE = float("inf")

# Arcs are below this in size, so two of them make one number.
PAIR = 1 << 32

CACHE_PAIRS = 500_000
TABLE_CLASSES, TABLE_CHARS, TABLE_ROWS = 160, 40, 4_000
NO_ARC = np.iinfo(np.int64).min
BATCH_BYTES = 1024 * 1024

ENCODED = "doc_id long, ids array<int>, n_tokens long, n_fallback long, decoded_crc32 long, round_trip boolean"

_machines: dict[str, "Transducer"] = {}


def load(path: str) -> "Transducer":
    """The compiled machines of a file; :func:`encode` drops them and their caches when a task ends."""
    if path not in _machines:
        with open(path, "rb") as file:
            _machines[path] = Transducer(file.read())
        # Compiling takes more than its result.
        give_back()
    return _machines[path]


class Transducer(Encoder):
    cache_pieces = 350_000
    flush_chars = SEGMENT_CHARS

    def __init__(self, model: bytes) -> None:
        super().__init__()
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        self.kind = proto.trainer_spec.model_type
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and byte-pair files have this form")
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("the normaliser of this file is not an identity on characters")
        if proto.trainer_spec.treat_whitespace_as_suffix or any(p.type in (USER_DEFINED, UNUSED) for p in proto.pieces):
            raise ValueError("suffix spaces, own symbols and unused pieces are not compiled")
        self._front = spec.add_dummy_prefix
        self._text_of = [p.piece for p in proto.pieces]
        self._type_of = [p.type for p in proto.pieces]
        self._byte_of = {int(p.piece[3:5], 16): n for n, p in enumerate(proto.pieces) if p.type == BYTE}
        self._unknown = next(n for n, p in enumerate(proto.pieces) if p.type == UNKNOWN)
        self._score = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        numbers = {p.piece: n for n, p in enumerate(proto.pieces) if p.type == NORMAL}
        self._weights = [-p.score if self.kind == UNIGRAM else 0.0 for p in proto.pieces]
        self._fallback = UNKNOWN_PENALTY - min(self._score.values(), default=0.0) if self.kind == UNIGRAM else 0.0
        # States are dicts from a character to the next state; "" holds the piece of a final state.
        self._trie: dict = {}
        for piece, number in numbers.items():
            node = self._trie
            for character in piece:
                node = node.setdefault(character, {})
            node[""] = number
        covered = {c for piece in self._score for c in piece}
        # Parts: a run of spaces and what follows it; a line end if no piece holds one.
        line_end = "" if "\n" in covered else "\n"
        whole_words = not any(SPACE in piece.lstrip(SPACE) for piece in self._score)
        self._split = re.compile(f"{line_end or '(?!)'}|{SPACE}*[^{SPACE}{line_end}]+|{SPACE}+") if whole_words else None
        self._spelling = [self._spell(n) for n in range(len(self._text_of))]
        self._controls = {n for n, kind in enumerate(self._type_of) if kind == CONTROL}
        self._is_byte = np.array([kind == BYTE for kind in self._type_of])
        self._cuts = self._split is not None and self._front
        self._licences: dict[int, bool] = {}
        self._compile_table()

    # --- encoding ---------------------------------------------------------

    def normalise(self, text: str) -> str:
        text = text.replace(" ", SPACE)
        return SPACE + text if self._front and text else text

    def pieces(self, text: str) -> list[str]:
        normal = self.normalise(text)
        return self._split.findall(normal) if self._cuts else [normal]

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        found: dict[str, bytes] = {}
        short = [piece for piece in pieces if 0 < len(piece) <= TABLE_CHARS]
        short.sort(key=len, reverse=True)
        for start in range(0, len(short), TABLE_ROWS):
            self._shortest_paths(short[start : start + TABLE_ROWS], found)
        return [found[p] if p in found else array("I", self._shortest_path(p)).tobytes() if p else b"" for p in pieces]

    def _compile_table(self) -> None:
        """The trie as a table of states by characters, for the characters most pieces use.

        State 0 is dead, state 1 the root; class 0 is every other character.
        """
        used = Counter(c for piece in self._score for c in piece)
        common = [c for c, _ in used.most_common(TABLE_CLASSES - 1)]
        self._class_of = np.zeros(0x110000, np.uint8)
        self._class_of[[ord(c) for c in common]] = np.arange(1, len(common) + 1)
        self._rare = np.zeros(0x110000, bool)
        self._rare[[ord(c) for c in used if c not in set(common)]] = True
        classes = {c: n + 1 for n, c in enumerate(common)}
        rows, arcs, waiting = [[0] * TABLE_CLASSES, [0] * TABLE_CLASSES], [NO_ARC, NO_ARC], [(1, self._trie)]
        for state, node in waiting:
            for c, child in node.items():
                if c in classes:
                    rows[state][classes[c]] = len(rows)
                    waiting.append((len(rows), child))
                    rows.append([0] * TABLE_CLASSES)
                    arcs.append(child.get("", NO_ARC))
            rows[state] = np.array(rows[state], np.int32)
        rows[0] = np.array(rows[0], np.int32)
        self._table, self._arc_of = np.stack(rows), np.array(arcs, np.int64)
        self._weight_of = np.array(self._weights)

    def _shortest_paths(self, parts: list[str], found: dict[str, bytes]) -> None:
        """The shortest paths of many parts at once, longest part first.

        The machines are composed with all parts position by position: what
        ``_shortest_path`` does for one part is done here for a column.  Parts
        with characters outside the table are left to it.
        """
        lengths = np.array([len(p) for p in parts])
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4")
        offsets = np.cumsum(lengths) - lengths
        odd = np.logical_or.reduceat(self._rare[codes], offsets)
        classes, width = self._class_of[codes], int(lengths[0])
        best = np.full((len(parts), width + 1), INFINITE)
        best[:, 0] = 0.0
        last = np.zeros((len(parts), width + 1), np.int64)
        back = np.zeros((len(parts), width + 1), np.int64)
        for start in range(width):
            rows = np.flatnonzero((lengths > start) & (best[:, start] < INFINITE) & ~odd)
            if not len(rows):
                continue
            code = codes[offsets[rows] + start]
            state = self._table[1, classes[offsets[rows] + start]]
            arc = self._arc_of[state]
            arc = np.where(arc == NO_ARC, -1 - code.astype(np.int64), arc)
            taken, end = [(rows, np.full(len(rows), start + 1), arc)], start + 1
            while True:
                on = (state > 0) & (lengths[rows] > end)
                rows, state = rows[on], state[on]
                if not len(rows):
                    break
                state = self._table[state, classes[offsets[rows] + end]]
                end += 1
                arc = self._arc_of[state]
                final = arc != NO_ARC
                taken.append((rows[final], np.full(int(final.sum()), end), arc[final]))
            rows, ends, arcs = (np.concatenate(x) for x in zip(*taken))
            step = np.where(arcs >= 0, self._weight_of[np.maximum(arcs, 0)], self._fallback)
            total = best[rows, start] + step
            better = total < best[rows, ends]
            if self.kind == BPE and start:
                better[better] = self._licence_all(last[rows[better], start], arcs[better])
            rows, ends = rows[better], ends[better]
            best[rows, ends], last[rows, ends], back[rows, ends] = total[better], arcs[better], start
        steps, at, rows = [], lengths.copy(), np.arange(len(parts))
        counts = np.zeros(len(parts), np.int64)
        at[odd] = 0
        while (going := at > 0).any():
            steps.append(np.where(going, last[rows, at], 0))
            counts += going
            at = np.where(going, back[rows, at], 0)
        if not steps:
            return
        # Steps were taken from the end; row by row they are turned round.
        turned = np.stack(steps, 1)
        place = counts[:, None] - 1 - np.arange(turned.shape[1])[None, :]
        there = place >= 0
        flat_at = (np.cumsum(counts) - counts)[:, None] + place
        flat = np.zeros(int(counts.sum()), np.int64)
        flat[flat_at[there]] = turned[there]
        bare = (turned < 0).any(1)
        packed = np.maximum(flat, 0).astype("<u4").tobytes()
        begin = 0
        for part, count, fall, skip in zip(parts, counts.tolist(), bare.tolist(), odd.tolist()):
            end = begin + count
            if fall:
                found[part] = array("I", self._fall_back(flat[begin:end].tolist())).tobytes()
            elif not skip:
                found[part] = packed[4 * begin : 4 * end]
            begin = end

    def _licence_all(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pairs, inverse = np.unique(left * PAIR + right, return_inverse=True)
        known, free = self._licences, []
        for pair in pairs.tolist():
            value = known.get(pair)
            if value is None:
                # The right arc may be below zero, down to half the range.
                arc = (pair + PAIR // 2) % PAIR - PAIR // 2
                value = self._licence(pair, (pair - arc) // PAIR, arc)
            free.append(value)
        return np.array(free, bool)[inverse]

    def _shortest_path(self, text: str) -> list[int]:
        """Compose the machines with a text and follow the path of least weight.

        ``best[end]`` is the least weight of a path to a position, ``last[end]``
        the arc it ends with.  States are left in order of position, so each arc
        is relaxed once.  Of equal paths the one found first stays, whose last
        piece is the longest.
        """
        size, root, weights, fallback = len(text), self._trie, self._weights, self._fallback
        ranked, licences, licence = self.kind == BPE, self._licences, self._licence
        best, last, back = [INFINITE] * (size + 1), [0] * (size + 1), [0] * (size + 1)
        best[0] = 0.0
        for start in range(size):
            base = best[start]
            if base == INFINITE:
                continue
            left, end, node = last[start], start, root.get(text[start])
            # A character that is no piece is an arc of its own, numbered below zero.
            arc = node.get("", None) if node else None
            if arc is None:
                arc, total = -1 - ord(text[start]), base + fallback
            else:
                total = base + weights[arc]
            while True:
                end += 1
                if arc is not None and total < best[end]:
                    if ranked and start:
                        pair = left * PAIR + arc
                        free = licences.get(pair)
                        if free is None:
                            free = licence(pair, left, arc)
                    if not ranked or not start or free:
                        best[end], last[end], back[end] = total, arc, start
                if node is None or end == size:
                    break
                node = node.get(text[end])
                if node is None:
                    break
                arc = node.get("")
                if arc is not None:
                    total = base + weights[arc]
        path, end = [], size
        while end:
            path.append(last[end])
            end = back[end]
        path.reverse()
        return path if min(path) >= 0 else self._fall_back(path)

    def _fall_back(self, path: list[int]) -> list[int]:
        """Characters in no piece become the pieces of their bytes, or one unknown piece a run."""
        ids: list[int] = []
        for arc in path:
            if arc >= 0:
                ids.append(arc)
            elif self._byte_of:
                ids += [self._byte_of[b] for b in chr(-1 - arc).encode()]
            elif not ids or ids[-1] != self._unknown:
                ids.append(self._unknown)
        return ids

    def _licence(self, pair: int, left: int, right: int) -> bool:
        """Whether a byte-pair file leaves two arcs side by side."""
        if len(self._licences) > CACHE_PAIRS:
            self._licences.clear()
        a, b = (self._text_of[arc] if arc >= 0 else chr(-1 - arc) for arc in (left, right))
        free = self._licences[pair] = self._merge(a + b) == [a, b]
        return free

    def _merge(self, text: str) -> list[str]:
        """Merge neighbours by the ranks of the pieces they make, the leftmost of equals first."""
        symbols, rank = list(text), self._score.get
        values = [rank(a + b, -INFINITE) for a, b in zip(symbols, symbols[1:])]
        while values and (top := max(values)) > -INFINITE:
            at = values.index(top)
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            del values[at]
            if at:
                values[at - 1] = rank(symbols[at - 1] + symbols[at], -INFINITE)
            if at < len(values):
                values[at] = rank(symbols[at] + symbols[at + 1], -INFINITE)
        return symbols

    # --- decoding ---------------------------------------------------------

    def _spell(self, number: int) -> bytes:
        kind, text = self._type_of[number], self._text_of[number]
        if kind == BYTE:
            return bytes([int(text[3:5], 16)])
        return b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else text.replace(SPACE, " ").encode()

    def decode(self, ids) -> str:
        """The inverse machine: pieces to their spelling, byte pieces to characters.

        The space in front of a text is taken off, control pieces emit nothing,
        and of a run of bytes those that are no UTF-8 become replacement
        characters, one for each.
        """
        data = b"".join(map(self._spelling.__getitem__, ids))
        try:
            text = data.decode()
        except UnicodeDecodeError:
            text = None
        if text is None or not self._controls.isdisjoint(ids):
            # Other pieces, also those that emit nothing, end a run of bytes.
            runs = ((kind, b"".join(map(self._spelling.__getitem__, run))) for kind, run in groupby(ids, self._type_of.__getitem__))
            text = "".join(_characters(run) if kind == BYTE else run.decode() for kind, run in runs)
        opening = next((n for n in ids if self._type_of[n] != CONTROL), None) if data[:1] == b" " else None
        return text[1:] if self._front and opening is not None and self._text_of[opening][:1] == SPACE else text

    def count_bytes(self, packed: bytes) -> int:
        return int(self._is_byte[np.frombuffer(packed, "<u4")].sum())


def _characters(data: bytes) -> str:
    out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids, n_tokens, n_fallback, decoded_crc32, round_trip)``, one row per row of ``docs``.

    ``path`` names a ``.model`` file that every executor has.  ``n_fallback``
    counts byte pieces, ``decoded_crc32`` is of the decoded text in UTF-8, and
    ``round_trip`` says that decoding gave the text back (it does not where a
    text holds the space symbol itself).

    Whole texts are encoded, null texts are empty and have no tokens.  Rows stay
    where they were read; other columns are left out, repeated rows and null ids
    are kept, an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A worker goes on to tasks of other kinds, which need the memory.
        try:
            yield from encoded(load(path), batches)
        finally:
            _machines.pop(path, None)

    def encoded(machine: Transducer, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for start, end in slices_by_bytes(texts, BATCH_BYTES):
                lists, counts, fallback, sums, same = [], [], [], [], []
                listed = texts.slice(start, end - start).to_pylist()
                for text, packed in zip(listed, machine.encode(listed)):
                    decoded = machine.decode(memoryview(packed).cast("I"))
                    lists.append(packed)
                    counts.append(len(packed) // 4)
                    fallback.append(machine.count_bytes(packed))
                    sums.append(zlib.crc32(decoded.encode()))
                    same.append(decoded == text)
                offsets = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
                values = pa.Array.from_buffers(pa.int32(), sum(counts), [None, pa.py_buffer(b"".join(lists))])
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(start, end - start).cast(pa.int64()),
                        pa.ListArray.from_arrays(offsets, values),
                        *(pa.array(x, pa.int64()) for x in (counts, fallback, sums)),
                        pa.array(same, pa.bool_()),
                    ],
                    ["doc_id", "ids", "n_tokens", "n_fallback", "decoded_crc32", "round_trip"],
                )

    return bounded_batches(id_and_text(docs, id_col, text_col)).mapInArrow(giving_back(run), ENCODED)
