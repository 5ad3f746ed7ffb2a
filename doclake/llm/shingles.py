"""Sets of word shingles of whole Arrow batches, as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits over 64 bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
_powers = np.ones(1, np.uint64)


def _power_table(size: int) -> np.ndarray:
    global _powers
    if len(_powers) < size:
        steps = np.full(size, _STEP | np.uint64(1), np.uint64)
        steps[0] = 1
        _powers = np.cumprod(steps, dtype=np.uint64)
    return _powers


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and the index of each text's first word.

    Words are runs of bytes other than space, tab, line feed, vertical tab, form
    feed and carriage return; A-Z count as a-z.
    """
    texts = texts.cast(pa.large_binary())
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    word = ~_SPACE[data]
    before = np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    firsts = offsets[:-1]
    before[firsts[firsts < len(data)]] = False
    starts = np.flatnonzero(word & ~before)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    lengths = np.diff(np.append(starts, len(data)))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, lengths)
    value = _BYTES[_LOWER[data[starts[0] :]]]
    value *= _power_table(int(lengths.max()) + 1)[place]
    value[~word[starts[0] :]] = 0
    hashes = mix(np.add.reduceat(value, starts - starts[0]))
    return hashes, np.searchsorted(starts, offsets)


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingles of each text, one after the other, and their bounds.

    A text with fewer than ``size`` words has its whole sequence as one shingle;
    one without words has none.  The array must not hold nulls.
    """
    words, bounds = word_hashes(texts)
    counts = np.diff(bounds)
    owner = np.repeat(np.arange(len(texts)), counts)
    found, owners = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(words) >= size:
        found = words[: len(words) - size + 1].copy()
        for k in range(1, size):
            found = mix(found * _STEP + words[k : len(words) - size + 1 + k])
        whole = owner[: len(found)] == owner[size - 1 :]
        found, owners = found[whole], owner[: len(whole)][whole]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        alone = np.empty(len(short), np.uint64)
        for n, text in enumerate(short):
            value = np.array([counts[text]], np.uint64)
            for word in words[bounds[text] : bounds[text + 1]]:
                value = mix(value * _STEP + word)
            alone[n] = value[0]
        found, owners = np.concatenate((found, alone)), np.concatenate((owners, short))
    order = np.lexsort((found, owners))
    found, owners = found[order], owners[order]
    if len(found):
        new = np.append(True, (found[1:] != found[:-1]) | (owners[1:] != owners[:-1]))
        found, owners = found[new], owners[new]
    return found, np.searchsorted(owners, np.arange(len(texts) + 1))
