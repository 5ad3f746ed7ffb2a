"""Suffix arrays with common-prefix values by induced sorting over queues that may lie on disk.

Suffixes are of type S if they are smaller than the next one, else L; an S after
an L starts a *leftmost S* (LMS) suffix.  Once the LMS suffixes are in order, one
pass over the letters upwards puts all L suffixes in order and one pass
downwards all S suffixes: a suffix is its first letter and the rank of the next
one, so taking the suffixes in order and pushing each one's predecessor into the
queue of its first letter fills every queue in order.

A queue carries tuples of suffix and common prefix with the one pushed before:
one more than the least common prefix of all suffixes taken in between.  Queues
are only ever appended to and read from the front, so they spill to a private
scratch file of the task (without a name, gone with the task) when they outgrow
their memory.

Order and common prefixes are needed up to a given depth only.  LMS suffixes are
sorted by that many letters directly, which takes the place of the recursion on
their names; inducing adds to the depth, so all other suffixes are right at
least as far.
"""

from __future__ import annotations

import tempfile

import numpy as np

QUEUE_BYTES = 128 * 1024 * 1024


class Queues:
    """One queue of ``(suffix, common prefix)`` per letter; the longest go to disk first."""

    def __init__(self, letters: int, limit: int = QUEUE_BYTES) -> None:
        self._held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(letters)]
        self._spilled: list[list[tuple[int, int]]] = [[] for _ in range(letters)]
        self._sizes, self._limit = [0] * letters, limit
        self._total, self._file = 0, None

    def push(self, letter: int, suffixes: np.ndarray, common: np.ndarray) -> None:
        self._held[letter].append((suffixes, common))
        size = suffixes.nbytes + common.nbytes
        self._sizes[letter] += size
        self._total += size
        while self._total > self._limit:
            self._spill(max(range(len(self._sizes)), key=self._sizes.__getitem__))

    def _spill(self, letter: int) -> None:
        if self._file is None:
            self._file = tempfile.TemporaryFile()
        for suffixes, common in self._held[letter]:
            self._file.seek(0, 2)
            self._spilled[letter].append((self._file.tell(), len(suffixes)))
            self._file.write(suffixes.tobytes())
            self._file.write(common.tobytes())
        self._held[letter] = []
        self._total -= self._sizes[letter]
        self._sizes[letter] = 0

    def take(self, letter: int) -> tuple[np.ndarray, np.ndarray]:
        """All that is in a queue now, in order; the queue is empty afterwards."""
        parts = []
        for at, count in self._spilled[letter]:
            self._file.seek(at)
            suffixes = np.frombuffer(self._file.read(8 * count), np.int64)
            parts.append((suffixes, np.frombuffer(self._file.read(count), np.uint8)))
        parts += self._held[letter]
        self._total -= self._sizes[letter]
        self._held[letter], self._spilled[letter], self._sizes[letter] = [], [], 0
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.uint8)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def close(self) -> None:
        if self._file is not None:
            self._file.close()


class _RangeMinimum:
    """Least value of any range of an array of small numbers."""

    def __init__(self, values: np.ndarray) -> None:
        self._levels, step = [values], 1
        while 2 * step <= len(values):
            last = self._levels[-1]
            self._levels.append(np.minimum(last[: len(last) - step], last[step:]))
            step *= 2

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        result = np.empty(len(first), np.uint8)
        for k in np.unique(level):
            at = level == k
            values = self._levels[k]
            result[at] = np.minimum(values[first[at]], values[last[at] - (1 << k) + 1])
        return result


class _Inducer:
    """Pushes predecessors of suffixes that are taken in order, with their common prefixes."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, letters: int, depth: int, limit: int) -> None:
        self._text, self._wanted, self._depth = text, wanted, depth
        self.queues = Queues(letters, limit)
        # Least common prefix of what was taken since the last push, per letter;
        # below zero while nothing was pushed, as the first has no neighbour.
        self._since = np.full(letters, -1, np.int64)

    def induce(self, suffixes: np.ndarray, common: np.ndarray) -> None:
        """``common[n]`` is the common prefix of a suffix with the one taken before it."""
        if not len(suffixes):
            return
        before = suffixes - 1
        taken = np.flatnonzero((before >= 0) & self._wanted[before])
        lowest = int(common.min())
        pushed = self._text[before[taken]]
        order = np.argsort(pushed, kind="stable")
        taken, pushed = taken[order], pushed[order]
        if len(taken):
            least = _RangeMinimum(common)
            first = np.append(True, pushed[1:] != pushed[:-1])
            since = np.where(first, 0, np.append(0, taken[:-1] + 1))
            values = least(since, taken).astype(np.int64)
            values[first] = np.minimum(values[first], self._since[pushed[first]])
            values = np.minimum(values + 1, self._depth).astype(np.uint8)
            last = np.append(first[1:], True)
            tail = taken[last]
            rest = np.full(len(tail), 255, np.int64)
            more = tail + 1 < len(common)
            rest[more] = least(tail[more] + 1, np.full(int(more.sum()), len(common) - 1))
        self._since = np.where(self._since >= 0, np.minimum(self._since, lowest), self._since)
        if len(taken):
            self._since[pushed[last]] = rest
            starts = np.flatnonzero(first)
            for letter, begin, end in zip(pushed[starts].tolist(), starts, np.append(starts[1:], len(taken))):
                self.queues.push(letter, before[taken[begin:end]], values[begin:end])


def suffix_array(text: np.ndarray, depth: int, limit: int = QUEUE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of a text in order of their first ``depth`` letters, and the common prefix of
    each with the one before it, at most ``depth`` (below 255).

    ``text`` holds small non-negative numbers; a letter smaller than all is added
    at the end, so no suffix is a prefix of another.
    """
    text = np.append(text.astype(np.int64) + 1, 0)
    size, letters = len(text), int(text.max()) + 1
    change = np.flatnonzero(text[1:] != text[:-1])
    ends = np.append(change, size - 1)
    runs = np.diff(np.append(-1, ends))
    run_is_s = np.append(text[ends[:-1] + 1] > text[ends[:-1]], True)
    is_s = np.repeat(run_is_s, runs)
    # How often the first letter of a suffix is repeated, capped.
    repeated = np.minimum(np.repeat(ends, runs) - np.arange(size) + 1, depth).astype(np.uint8)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    lms, lms_common = _sorted_prefixes(text, lms, depth)
    lms_at = np.searchsorted(text[lms], np.arange(letters + 1))
    large: list[tuple[np.ndarray, np.ndarray]] = []
    up = _Inducer(text, ~is_s, letters, depth, limit)
    for letter in range(letters):
        parts = []
        while len((part := up.queues.take(letter))[0]):
            parts.append(part)
            up.induce(*part)
        suffixes = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
        common = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.uint8)
        large.append((suffixes, common))
        chosen = slice(lms_at[letter], lms_at[letter + 1])
        starts, shared = lms[chosen], lms_common[chosen].copy()
        if len(starts):
            # An L and an S suffix of one letter part where the shorter run ends.
            shared[0] = min(repeated[suffixes[-1]], repeated[starts[0]]) if len(suffixes) else 0
            up.induce(starts, shared)
    up.queues.close()
    down = _Inducer(text, is_s, letters, depth, limit)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for letter in range(letters - 1, -1, -1):
        parts = []
        if letter == 0:
            parts.append((np.array([size - 1]), np.zeros(1, np.uint8)))
        while len((part := down.queues.take(letter))[0]):
            parts.append(part)
            down.induce(*part)
        small = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
        small_common = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.uint8)
        suffixes, common = large[letter]
        large[letter] = None
        met = min(repeated[suffixes[-1]], repeated[small[-1]]) if len(suffixes) and len(small) else 0
        if len(suffixes):
            down.induce(suffixes[::-1], np.append(np.uint8(met), common[:0:-1]))
        # Downwards, a common prefix belongs to the larger neighbour.
        if len(small):
            found.append((small[::-1], np.append(np.uint8(met), small_common[:0:-1])))
        found.append((suffixes, common))
    down.queues.close()
    order = np.concatenate([f[0] for f in reversed(found)])
    common = np.concatenate([f[1] for f in reversed(found)])
    return order[1:], common[1:]


def _sorted_prefixes(text: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first ``depth`` letters, with their common prefixes."""
    padded = np.concatenate((text, np.zeros(depth + 8, np.int64))).astype(np.uint16)
    words = -(-depth // 4)
    keys = np.empty((words, len(starts)), np.uint64)
    for word in range(words):
        key = np.zeros(len(starts), np.uint64)
        for n in range(4):
            key = (key << np.uint64(16)) | padded[starts + 4 * word + n]
        keys[word] = key
    order = np.lexsort(keys[::-1])
    starts, keys = starts[order], keys[:, order]
    common = np.zeros(len(starts), np.int64)
    going = np.append(False, np.ones(max(0, len(starts) - 1), bool))[: len(starts)]
    for word in range(words):
        differ = np.append(np.uint64(0), keys[word, 1:] ^ keys[word, :-1])[: len(starts)]
        equal = going & (differ == 0)
        partly = going & (differ != 0)
        common[equal] += 4
        # Rounding to doubles may carry past the highest letter.
        common[partly] += np.clip((64 - np.frexp(differ[partly].astype(np.float64))[1]) // 16, 0, 3)
        going = equal
    return starts, np.minimum(common, depth).astype(np.uint8)
